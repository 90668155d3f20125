"""The prefix trie of conversations: one node for every different beginning, with counts of members, children, leaves and savings.

A conversation is a sequence of turns; its beginnings of 0, 1, 2 .. turns are its line from the root down. Equal beginnings of
different conversations are one node.

How the nodes are counted
-------------------------
1. A turn becomes a digest, and a beginning the sum of its turns' digests, each hashed together with its place, in four limbs. So
   a beginning's digest is a running sum and its parent's digest is a subtraction. Running sums are taken in chunks of ``CHUNK``
   turns, with the totals of the earlier chunks added; a conversation of any length is many short pieces of work.
2. The lines are dealt to shards: a shard holds the chunks of whole families of conversations. A shard enumerates its different
   digests, gives each a slot by a minimal perfect hash, verifies every slot against the stored digest, and scatters counts and
   smallest members into flat arrays. Its nodes, one row each, are added up over the shards.
3. Every node has one owner, its smallest member. What a node adds to all nodes above it is handed to the owner's shard, where it
   is scattered into the slots and accumulated through the array of parent slots, deepest nodes first. What lies in later chunks of
   a line arrives at the last node of its chunk. Subtree sums of a shard are again added up over the shards: since a node is
   counted at its owner alone, nothing is counted twice.
4. The members that end at a node are dealt by ranges of (node, conv_id), joined to pieces of text, and the pieces of a node are
   hashed as they stream by in order; memory is bounded also where a third of all conversations end at one node.

A node that all conversations share is one row a shard. Digests of 128 bits name nodes; that all members of a node agree on
parent, turn and bytes is checked while they are added up, and the job fails otherwise.

Cases: NULL role or text is empty; turns are ordered with NULL first, equal ones by their digest, and repeated rows are turns of
their own; rows with a NULL conv_id belong to no conversation; an empty table has no nodes; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from splitclock.llm.common import column, groups_of, numbers, table, written
from splitclock.llm.places import placed

CHUNK = 4096
SHARD = 50_000
PIECE = 4096
LIMBS = range(4)
NODE = ["hi", "lo"]
EMPTY = hashlib.sha256(b"").hexdigest()

_TRIE = "shard long, hi long, lo long, phi long, plo long, depth long, bytes long, mark long, n long, least long"
_SUMS = "hi long, lo long, leaves long, saved long"


class PerfectHash:
    """A minimal perfect hash of different 128-bit keys: n keys get the slots 0 .. n-1, and any other key gets -1.

    On each level the keys that fall alone into a place of a bit array are done; their slot is the number of set bits before. The
    others go on to the next level. The keys are kept by slot, so that a look-up is verified.
    """

    def __init__(self, hi: np.ndarray, lo: np.ndarray):
        self.levels: list[tuple[np.uint64, np.ndarray, np.ndarray]] = []
        self.hi, self.lo = np.zeros(len(hi), np.uint64), np.zeros(len(hi), np.uint64)
        left, done = np.arange(len(hi)), 0
        while len(left):
            if len(self.levels) > 200:
                raise ValueError("the keys are not different")
            seed = np.uint64(len(self.levels) + 1)
            place = self._place(hi[left], lo[left], seed, 2 * len(left) + 8)
            alone = np.bincount(place, minlength=2 * len(left) + 8) == 1
            slot = np.cumsum(alone) - alone + done
            self.levels.append((seed, alone, slot))
            hit = alone[place]
            self.hi[slot[place[hit]]], self.lo[slot[place[hit]]] = hi[left[hit]], lo[left[hit]]
            done += int(alone.sum())
            left = left[~hit]

    @staticmethod
    def _place(hi: np.ndarray, lo: np.ndarray, seed: np.uint64, size: int) -> np.ndarray:
        x = (hi ^ (lo >> np.uint64(7))) * (np.uint64(0x9E3779B97F4A7C15) + np.uint64(2) * seed) + lo * seed
        x ^= x >> np.uint64(31)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(29)
        return (x % np.uint64(size)).astype(np.int64)

    def slots(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        out, open_ = np.full(len(hi), -1, np.int64), np.arange(len(hi))
        for seed, alone, slot in self.levels:
            if not len(open_):
                break
            place = self._place(hi[open_], lo[open_], seed, len(alone))
            hit = alone[place]
            out[open_[hit]] = slot[place[hit]]
            open_ = open_[~hit]
        known = out >= 0
        known[known] = (self.hi[out[known]] == hi[known]) & (self.lo[out[known]] == lo[known])
        return np.where(known, out, -1)


def _columns(rows: pa.Table, *names: str) -> list[np.ndarray]:
    return [rows.column(n).to_numpy().astype(np.int64, copy=False) for n in names]


def _keys(rows: pa.Table, hi: str = "hi", lo: str = "lo") -> tuple[np.ndarray, np.ndarray]:
    return tuple(x.view(np.uint64) for x in _columns(rows, hi, lo))


def _hashed(hi: np.ndarray, lo: np.ndarray) -> PerfectHash:
    order = np.lexsort((lo, hi))
    first = order[groups_of([hi[order], lo[order]])[:-1]]
    return PerfectHash(hi[first], lo[first])


def _chunk(depth: np.ndarray) -> np.ndarray:
    return np.maximum(depth - 1, 0) // CHUNK


def _counted(rows: pa.Table) -> pa.Table:
    """A shard's lines as nodes: occurrences and smallest members scattered into slots."""
    hi, lo = _keys(rows)
    nodes = _hashed(hi, lo)
    slot, size = nodes.slots(hi, lo), len(nodes.hi)
    n, least = np.bincount(slot, minlength=size), np.full(size, np.iinfo(np.int64).max)
    np.minimum.at(least, slot, _columns(rows, "conv_id")[0])
    one = np.empty(size, np.int64)
    one[slot] = np.arange(len(slot))
    mark = _columns(rows, "mark")[0]
    if (mark != mark[one][slot]).any():
        raise ValueError("two different beginnings have one digest")
    own = rows.take(pa.array(one)).drop_columns(["conv_id"])
    return own.append_column("n", pa.array(n)).append_column("least", pa.array(least))


def _accumulated(rows: pa.Table) -> pa.Table:
    """Subtree sums of a shard: weights scattered into slots, then added to the parents' slots from the deepest nodes up."""
    hi, lo = _keys(rows)
    nodes = _hashed(hi, lo)
    slot, size = nodes.slots(hi, lo), len(nodes.hi)
    depth, parent = np.zeros(size, np.int64), np.full(size, -1, np.int64)
    at, line = _columns(rows, "depth", "line")
    depth[slot] = at
    trie = line == 1
    own_depth, above = at[trie], nodes.slots(*(x[trie] for x in _keys(rows, "phi", "plo")))
    parent[slot[trie]] = np.where((own_depth > 0) & (_chunk(own_depth) == _chunk(own_depth - 1)), above, -1)
    sums = []
    for name in ("leaves", "saved"):
        total = np.zeros(size, np.int64)
        np.add.at(total, slot, _columns(rows, name)[0])
        sums.append(total)
    order = np.argsort(-depth, kind="stable")
    cuts = groups_of([depth[order]])
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        from_ = order[a:b]
        to = parent[from_]
        from_, to = from_[to >= 0], to[to >= 0]
        for total in sums:
            np.add.at(total, to, total[from_])
    return pa.table([nodes.hi.view(np.int64), nodes.lo.view(np.int64), *sums], names=["hi", "lo", "leaves", "saved"])


def _ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (node, conv_id) as pieces of comma-joined ids."""
    for batch in batches:
        if not batch.num_rows:
            continue
        hi, lo, conv = (numbers(batch, c) for c in (*NODE, "conv_id"))
        out = []
        cuts = groups_of([hi, lo])
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            for k in range(a, b, PIECE):
                own = conv[k : min(k + PIECE, b)]
                out.append((hi[a], lo[a], own[0], ",".join(map(str, own.tolist()))))
        h, l_, first, ids = zip(*out, strict=True)
        yield pa.record_batch([pa.array(h, pa.int64()), pa.array(l_, pa.int64()), pa.array(first, pa.int64()), pa.array(ids)], names=["hi", "lo", "first", "ids"])


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of every node's pieces, which come sorted; only the state of one digest is held."""
    last, digest, done = None, None, []

    def rows() -> pa.RecordBatch:
        out = pa.record_batch([pa.array([d[0][0] for d in done], pa.int64()), pa.array([d[0][1] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.string())], names=["hi", "lo", "ends_sha256"])
        done.clear()
        return out

    for batch in batches:
        for hi, lo, ids in zip(numbers(batch, "hi").tolist(), numbers(batch, "lo").tolist(), column(batch, "ids").to_pylist(), strict=True):
            if (hi, lo) == last:
                digest.update(b",")
            else:
                if last is not None:
                    done.append((last, digest.hexdigest()))
                last, digest = (hi, lo), hashlib.sha256()
            digest.update(ids.encode())
        if len(done) >= 8192:
            yield rows()
    if last is not None:
        done.append((last, digest.hexdigest()))
        yield rows()


def _named(depth: Column, limbs: list[Column]) -> list[Column]:
    """The two halves of a beginning's digest."""
    return [F.xxhash64(F.lit(k), depth.cast("bigint"), *limbs) for k in (1, 2)]


def lines(turns: DataFrame) -> DataFrame:
    """(conv_id, family, depth, hi, lo, phi, plo, bytes, mark) for every turn: the beginning that ends with it, and its parent.

    ``turns`` has conv_id, family, depth (1, 2 .. without gaps), digest (text) and bytes."""
    limb = [F.conv(F.substring(F.sha2(F.concat_ws(":", "depth", "digest"), 256), 8 * k + 1, 8), 16, 10).cast("bigint").alias(f"l{k}") for k in LIMBS]
    turns = turns.select("*", F.floor((F.col("depth") - 1) / CHUNK).alias("chunk"), *limb)
    inside = W.partitionBy("conv_id", "chunk").orderBy("depth").rowsBetween(W.unboundedPreceding, 0)
    summed = turns.withColumns({f"s{k}": F.sum(f"l{k}").over(inside) for k in LIMBS})
    long = turns.groupBy("conv_id", "chunk").agg(F.max("depth").alias("last"), *[F.sum(f"l{k}").alias(f"t{k}") for k in LIMBS])
    earlier = W.partitionBy("conv_id").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    carry = long.select("conv_id", "chunk", *[F.sum(f"t{k}").over(earlier).alias(f"t{k}") for k in LIMBS]).where("chunk > 0")
    summed = summed.join(carry, ["conv_id", "chunk"], "left").withColumns({f"s{k}": F.col(f"s{k}") + F.coalesce(f"t{k}", F.lit(0)) for k in LIMBS})
    own = _named(F.col("depth"), [F.col(f"s{k}") for k in LIMBS])
    above = _named(F.col("depth") - 1, [F.col(f"s{k}") - F.col(f"l{k}") for k in LIMBS])
    named = summed.select("conv_id", "family", "depth", own[0].alias("hi"), own[1].alias("lo"), above[0].alias("phi"), above[1].alias("plo"), "bytes", "digest")
    return named.withColumn("mark", F.xxhash64("depth", "phi", "plo", "bytes", "digest")).drop("digest")


def trie(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """The nodes of all beginnings: (hi, lo, phi, plo, depth, conv_id, parent_conv_id, n_convs, n_children, n_leaves, saved,
    ends_sha256). ``turns`` as for `lines`; ``conversations`` has conv_id, family and turns (how many), also those without any."""
    zero = [F.lit(0).cast("bigint")] * 4
    root = _named(F.lit(0), zero)
    none = F.lit(None).cast("bigint")
    at_root = conversations.select("conv_id", "family", F.lit(0).cast("bigint").alias("depth"), root[0].alias("hi"), root[1].alias("lo"), none.alias("phi"), none.alias("plo"), F.lit(0).cast("bigint").alias("bytes"), F.lit(0).cast("bigint").alias("mark"))
    below = written(lines(turns).unionByName(at_root), "lines")
    shards = max(1, math.ceil(below.count() / SHARD))
    chunk = F.floor(F.greatest(F.col("depth") - 1, F.lit(0)) / CHUNK)
    shard = F.pmod(F.xxhash64("family", chunk), F.lit(shards)).alias("shard")
    given = below.select(shard, *NODE, "phi", "plo", "depth", "bytes", "mark", "conv_id")
    tries = written(given.groupBy("shard").applyInArrow(_counted, _TRIE), "tries")
    # One row a node: what all shards agree on, and what they add up.
    same = {c: F.min(c) for c in ("phi", "plo", "depth", "bytes", "mark")}
    nodes = tries.groupBy(*NODE).agg(*[c.alias(n) for n, c in same.items()], F.max("mark").alias("other"), F.sum("n").alias("n_convs"), F.min("least").alias("conv_id"))
    nodes = nodes.withColumn("depth", F.when(F.col("mark") == F.col("other"), F.col("depth")).otherwise(F.raise_error(F.lit("two different beginnings have one digest")))).drop("mark", "other")
    nodes = written(nodes, "nodes")
    children = nodes.where("phi is not null").groupBy(F.col("phi").alias("hi"), F.col("plo").alias("lo")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = written(nodes.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("bigint"))), "nodes")
    # What a node adds to the nodes above it goes to its owner's shard.
    family = conversations.select("conv_id", "family")
    weight = nodes.join(family, "conv_id").select("conv_id", "family", *NODE, "phi", "plo", "depth", (F.col("n_children") == 0).cast("bigint").alias("leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"))
    weight = written(weight, "weights")
    later = weight.where(chunk > 0).groupBy("conv_id", (chunk - 1).alias("chunk")).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    border = below.where((F.col("depth") > 0) & (F.col("depth") % CHUNK == 0)).withColumn("chunk", chunk)
    up = W.partitionBy("conv_id").orderBy(F.desc("chunk")).rowsBetween(W.unboundedPreceding, 0)
    carried = border.join(later, ["conv_id", "chunk"], "left").withColumns({c: F.coalesce(F.sum(c).over(up), F.lit(0).cast("bigint")) for c in ("leaves", "saved")})
    added = [frame.select(shard, *NODE, "phi", "plo", "depth", "leaves", "saved", F.lit(0).cast("bigint").alias("line")) for frame in (weight, carried)]
    zeros = [F.lit(0).cast("bigint").alias(c) for c in ("leaves", "saved")]
    shaped = tries.select("shard", *NODE, "phi", "plo", "depth", *zeros, F.lit(1).cast("bigint").alias("line")).unionAll(added[0]).unionAll(added[1])
    shaped = shaped.withColumns({c: F.coalesce(c, F.lit(0).cast("bigint")) for c in ("phi", "plo")})
    sums = shaped.groupBy("shard").applyInArrow(_accumulated, _SUMS).groupBy(*NODE).agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved"))
    ends = below.join(conversations.select("conv_id", "turns"), "conv_id").where(F.col("depth") == F.col("turns")).select(*NODE, "conv_id")
    pieces = ends.repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id").mapInArrow(_ids, "hi long, lo long, first long, ids string")
    ends = pieces.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(_streamed, "hi long, lo long, ends_sha256 string")
    parents = nodes.select(F.col("hi").alias("phi"), F.col("lo").alias("plo"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(sums, NODE).join(ends, NODE, "left").join(parents, ["phi", "plo"], "left")
    return out.select(*NODE, "phi", "plo", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))


def rebuilt(conversations: DataFrame, family: int = 5, heads: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations that share beginnings: ``turns`` and ``conversations`` as `trie` takes them.

    Conversation c begins with the first h turns of conversation c - c % family, and goes on with its own after its first h;
    h is the CRC-32 of the decimal c modulo ``heads``. The remainder of a negative id is positive."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn"), F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256).alias("digest"), F.octet_length(text).cast("bigint").alias("bytes")
    )
    turns, convs = placed(rows, ["conv_id"], ["turn", "digest"], "turns")
    turns, convs = written(turns, "turns"), written(convs, "conversations")
    rest = F.pmod("conv_id", F.lit(family))
    base = (F.col("conv_id") - rest).alias("family")
    head = (F.crc32(F.col("conv_id").cast("string")) % heads).alias("head")
    bases = convs.where(rest == 0).select(F.col("conv_id").alias("family"), F.col("held").alias("base_turns"))
    follows = F.col("conv_id") != F.col("family")
    begun = F.least(F.col("head"), F.coalesce("base_turns", F.lit(0).cast("bigint")))
    listed = convs.select("conv_id", base, head, "held").join(bases, "family", "left")
    count = F.when(follows, begun + F.greatest(F.col("held") - F.col("head"), F.lit(0))).otherwise(F.col("held"))
    listed = written(listed.select("conv_id", "family", "head", count.alias("turns")), "listed")
    own = turns.select("*", base, head).where(~follows | (F.col("place") >= F.col("head"))).join(bases, "family", "left")
    depth = F.when(follows, begun + F.col("place") - F.col("head")).otherwise(F.col("place")) + 1
    own = own.select("conv_id", "family", depth.alias("depth"), "digest", "bytes")
    first = turns.where((rest == 0) & (F.col("place") < heads - 1)).select(F.col("conv_id").alias("family"), "place", "digest", "bytes")
    copied = listed.where(follows).select("conv_id", "family", "head").join(first, "family").where("place < head").select("conv_id", "family", (F.col("place") + 1).alias("depth"), "digest", "bytes")
    return own.unionByName(copied), listed


def trie_query(spark, sf_dir: str) -> DataFrame:
    found = trie(*rebuilt(table(spark, sf_dir, "conversations")))
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), "ends_sha256")


ORACLE = """
WITH RECURSIVE turns AS (
  SELECT conv_id, digest, bytes, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) - 1 AS place
  FROM (SELECT conv_id, turn, strlen(coalesce(text, '')) AS bytes, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest FROM conversations WHERE conv_id IS NOT NULL)
), bits AS (  -- the CRC-32 of the decimal conv_id
  SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS t, 0 AS k, CAST(4294967295 AS BIGINT) AS c FROM turns
  UNION ALL
  SELECT conv_id, t, k + 1, CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END
  FROM (SELECT conv_id, t, k, CASE WHEN k % 8 = 0 THEN xor(c, CAST(ascii(substr(t, k // 8 + 1, 1)) AS BIGINT)) ELSE c END AS x FROM bits WHERE k < 8 * length(t))
), convs AS (
  SELECT conv_id, conv_id - (conv_id % 5 + 5) % 5 AS base, xor(c, 4294967295) % 9 AS h FROM bits WHERE k = 8 * length(t)
), parts AS (
  SELECT c.conv_id, 0 AS part, t.place, t.digest, t.bytes FROM convs c JOIN turns t ON t.conv_id = c.base AND t.place < h
  UNION ALL
  SELECT c.conv_id, 1, t.place, t.digest, t.bytes FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.place >= h
), seq AS (
  SELECT conv_id, digest, bytes, row_number() OVER (PARTITION BY conv_id ORDER BY part, place) AS depth FROM parts
), lines AS (
  SELECT conv_id, depth, bytes, string_agg(digest, '') OVER (PARTITION BY conv_id ORDER BY depth) AS node FROM seq
  UNION ALL
  SELECT conv_id, 0, 0, '' FROM convs
), nodes AS (
  SELECT node, depth, any_value(bytes) AS bytes, min(conv_id) AS conv_id, count(*) AS n_convs, substr(node, 1, length(node) - 64) AS parent FROM lines GROUP BY node, depth
), children AS (
  SELECT parent AS node, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY parent
), below AS (
  SELECT DISTINCT a.node AS top, b.node FROM lines a JOIN lines b ON a.conv_id = b.conv_id AND b.depth >= a.depth
), sums AS (
  SELECT top AS node, count(*) FILTER (c.n IS NULL) AS n_leaves, CAST(sum((n.n_convs - 1) * n.bytes) AS BIGINT) AS saved FROM below JOIN nodes n ON n.node = below.node LEFT JOIN children c ON c.node = n.node GROUP BY top
), ends AS (
  SELECT node, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS digest FROM (SELECT conv_id, arg_max(node, depth) AS node FROM lines GROUP BY conv_id) GROUP BY node
)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children, s.n_leaves, s.saved AS saved_tokens, coalesce(e.digest, sha256('')) AS ends_sha256
FROM nodes n LEFT JOIN nodes p ON p.node = n.parent AND n.depth > 0 LEFT JOIN children c ON c.node = n.node JOIN sums s ON s.node = n.node LEFT JOIN ends e ON e.node = n.node
"""
