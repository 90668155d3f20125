"""A Merkle manifest of a dataset: every row has a digest, a proof, and a root to check it against.

A row's leaf is the SHA-256 of its fields, each as its length, a colon and its value. The leaves of a source, in order of doc_id,
are the base of a tree in which every three neighbours make the node above; the tops of all sources, in order of the sources,
are the base of one more tree, whose top is the root. A node is the SHA-256 of its children's digests in hexadecimal; the last
run of a level may be shorter, and even a single node in it is hashed again.

How the trees are made
----------------------
1. Spark expressions hash the rows; only ids and digests travel from here on. `places.placed` numbers the leaves of a source,
   however many it has.
2. A superblock is ``3 ** LEVELS`` consecutive nodes. Superblocks are reduced to their tops, which are the nodes of the next round;
   the number of rounds is the logarithm of the largest tree to the base 2,187.
3. From the top down, the nodes of a round and the outer nodes that they need (the siblings of their superblock's top, up to the
   root) are cogrouped by superblock. There each node's local siblings are found by local reduction and joined to the outer ones.
   In the last round, that of the leaves, the same function folds every (given or tampered) leaf up to a root.

A group of a cogroup holds whole superblocks, about ``BLOCKS`` of them; a source with a third of all rows is many superblocks.

Cases: NULL fields are ``-``, and a NULL source is a source of its own, the first; rows with a NULL doc_id come first in their
source and are not tampered with; repeated doc_ids are ordered by leaf, and equal rows have equal leaves, so that any order of
them gives the same digests. Empty texts have length 0. An empty table gives no rows and has no root. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splitclock.llm.common import table, written
from splitclock.llm.places import placed

FAN = 3
LEVELS = 7
#: Superblocks of a group, about.
BLOCKS = 4
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]

_NODE = "tree long, place long, held long, digest binary"
_PATH = "tree long, place long, lefts array<string>, rights array<string>, subroot string, root string"


def hashed(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def field(value: Column) -> Column:
    as_text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(as_text).cast("string"), F.lit(":"), as_text))


def leaf(fields: list[Column]) -> Column:
    """The leaf digest of a row, as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*map(field, fields)), 256))


def depth_of(held: int) -> int:
    """How many levels stand above the base of a tree of ``held`` nodes."""
    depth, width = 0, 1
    while width < held:
        depth, width = depth + 1, width * FAN
    return depth


def levels_of(digests: list[str], depth: int) -> list[list[str]]:
    """The nodes of ``depth`` levels above ``digests``, the base first."""
    levels = [digests]
    for _ in range(depth):
        below = levels[-1]
        levels.append([hashed("".join(below[k : k + FAN])) for k in range(0, len(below), FAN)])
    return levels


def siblings(levels: list[list[str]], k: int) -> tuple[list[str], list[str]]:
    """What stands left and right of node ``k``'s line in each run, joined, from the base up."""
    lefts, rights = [], []
    for level in levels[:-1]:
        run = k - k % FAN
        lefts.append("".join(level[run:k]))
        rights.append("".join(level[k + 1 : run + FAN]))
        k //= FAN
    return lefts, rights


def fold(digest: str, lefts: list[str], rights: list[str]) -> str:
    for left, right in zip(lefts, rights, strict=True):
        digest = hashed(left + digest + right)
    return digest


def _blocks(nodes: pd.DataFrame, size: int) -> Iterator[tuple[int, int, pd.DataFrame]]:
    """The superblocks among ``nodes``, each in order: (tree, superblock, its rows)."""
    nodes = nodes.sort_values(["tree", "place"], kind="stable")
    tree, block = nodes["tree"].to_numpy(), nodes["place"].to_numpy() // size
    cuts = np.flatnonzero((tree[1:] != tree[:-1]) | (block[1:] != block[:-1])) + 1
    for a, b in zip([0, *cuts], [*cuts, len(tree)], strict=True):
        if a < b:
            yield int(tree[a]), int(block[a]), nodes.iloc[a:b]


def _dealt(nodes: DataFrame, groups: int, levels: int) -> DataFrame:
    return nodes.withColumn("g", F.pmod(F.xxhash64("tree", F.floor(F.col("place") / FAN**levels)), F.lit(groups)))


def _groups(total: int, levels: int) -> int:
    return max(1, math.ceil(total / (BLOCKS * FAN**levels)))


def _tops(nodes: DataFrame, total: int, levels: int) -> DataFrame:
    """The nodes of the next round: the top of every superblock."""

    def run(given: pd.DataFrame) -> pd.DataFrame:
        out = []
        for tree, block, own in _blocks(given, FAN**levels):
            held = int(own["held"].iloc[0])
            top = levels_of([d.hex() for d in own["digest"]], min(levels, depth_of(held)))[-1][0]
            out.append((tree, block, -(-held // FAN**levels), bytes.fromhex(top)))
        return pd.DataFrame(out, columns=["tree", "place", "held", "digest"])

    return _dealt(nodes.select("tree", "place", "held", "digest"), _groups(total, levels), levels).groupBy("g").applyInPandas(run, _NODE)


def _outer_of(outer: pd.DataFrame) -> dict[tuple[int, int], tuple]:
    return {(int(r.tree), int(r.place)): (list(r.lefts), list(r.rights), r.subroot, r.root) for r in outer.itertuples(index=False)}


def _cogrouped(nodes: DataFrame, outer: DataFrame, total: int, levels: int, run, schema: str) -> DataFrame:
    """``outer`` holds one row for each superblock of ``nodes``, by the place of its top in the round above."""
    n = _groups(total, levels)
    above = outer.withColumn("g", F.pmod(F.xxhash64("tree", "place"), F.lit(n)))
    return _dealt(nodes, n, levels).groupBy("g").cogroup(above.groupBy("g")).applyInPandas(run, schema)


def _spread(nodes: DataFrame, outer: DataFrame, total: int, levels: int) -> DataFrame:
    """The way up from every node of a round."""

    def run(given: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        paths, out = _outer_of(above), []
        for tree, block, own in _blocks(given, FAN**levels):
            lefts, rights, subroot, root = paths[tree, block]
            digests = [d.hex() for d in own["digest"]]
            nodes_ = levels_of(digests, min(levels, depth_of(int(own["held"].iloc[0]))))
            for k, place in enumerate(own["place"]):
                a, b = siblings(nodes_, k)
                out.append((tree, place, a + lefts, b + rights, subroot, root))
        return pd.DataFrame(out, columns=["tree", "place", "lefts", "rights", "subroot", "root"])

    return _cogrouped(nodes, outer, total, levels, run, _PATH)


def _finished(leaves: DataFrame, outer: DataFrame, total: int, levels: int, proofs: bool) -> DataFrame:
    """Every leaf with its proof, and the root that its present content folds up to."""

    def run(given: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        paths, out = _outer_of(above), []
        for tree, block, own in _blocks(given, FAN**levels):
            lefts, rights, subroot, root = paths[tree, block]
            digests = [d.hex() for d in own["digest"]]
            nodes_ = levels_of(digests, min(levels, depth_of(int(own["held"].iloc[0]))))
            outer_proof = [x + y for x, y in zip(lefts, rights, strict=True)]
            outer_bytes = "".join(outer_proof).encode()
            known: dict[str, str] = {}  # what the superblock's top becomes, folded once for every different top
            for k, (doc, now) in enumerate(zip(own["doc_id"], own["present"], strict=True)):
                a, b = siblings(nodes_, k)
                proof = [x + y for x, y in zip(a, b, strict=True)]
                digest = hashlib.sha256("".join(proof).encode())
                digest.update(outer_bytes)
                top = fold(now.hex() if now is not None else digests[k], a, b)
                if top not in known:
                    known[top] = fold(top, lefts, rights)
                row = (doc, digests[k], subroot, root, digest.hexdigest(), known[top])
                out.append((*row, a + lefts, b + rights) if proofs else row)
        names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", *(["lefts", "rights"] if proofs else [])]
        made = pd.DataFrame(out, columns=names)
        made["doc_id"] = made["doc_id"].astype("Int64")
        return made

    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string"
    return _cogrouped(leaves, outer, total, levels, run, schema + (", lefts array<string>, rights array<string>" if proofs else ""))


def _climb(nodes: DataFrame, largest: int, total: int, trees: int, levels: int) -> tuple[list[tuple[DataFrame, int]], DataFrame]:
    """The rounds below the tops of all trees, and the tops."""
    rounds = []
    while largest > 1:
        rounds.append((nodes, total))
        nodes = written(_tops(nodes, total, levels), "tops")
        largest, total = -(-largest // FAN**levels), total // FAN**levels + trees
    return rounds, nodes


def manifest(docs: DataFrame, altered: Column | None = None, proofs: bool = False, levels: int = LEVELS) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root) of every row of ``docs``; digests are lowercase hexadecimal.

    ``altered`` is a text to hold against the manifest instead of the row's own (NULL: the text is as it was): folded_root is the
    root that it leads to with the row's original siblings. With ``proofs`` the siblings themselves follow: ``lefts`` and
    ``rights``, what stands on either side of the row's line, level by level from the leaf up. A superblock is ``levels`` high.
    """
    spark = docs.sparkSession
    given = docs.select(*FIELDS, (F.lit(None).cast("string") if altered is None else altered).alias("altered"))
    plain = [F.col(c) for c in FIELDS]
    rows = given.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        leaf(plain).alias("digest"),
        F.when(F.col("altered").isNotNull(), leaf([*plain[:-1], F.col("altered")])).alias("present"),
    )
    leaves, sources = placed(rows, ["source"], ["doc_id", "digest"], "leaves")
    sources = written(sources, "sources")
    shape = sources.agg(F.max("held").alias("largest"), F.sum("held").alias("total"), F.count(F.lit(1)).alias("trees")).first()
    if not shape["trees"]:
        return _finished(leaves.withColumn("tree", F.lit(0).cast("bigint")), spark.createDataFrame([], _PATH), 0, levels, proofs)
    ranked, _ = placed(sources.withColumnRenamed("held", "rows"), [], ["source"], "ranks")
    ranked = written(ranked.select(F.col("source").alias("named"), F.col("place").alias("tree")), "trees")
    leaves = leaves.join(ranked, F.col("source").eqNullSafe(F.col("named"))).select("tree", "place", "held", "doc_id", "digest", "present")
    leaves = written(leaves, "leaves")
    # Up: first every source's tree, then the tree over their tops.
    below, subroots = _climb(leaves, shape["largest"], shape["total"], shape["trees"], levels)
    base = subroots.select(F.lit(0).cast("bigint").alias("tree"), F.col("tree").alias("place"), F.lit(shape["trees"]).alias("held"), "digest")
    above, top = _climb(base, shape["trees"], shape["trees"], 1, levels)
    # Down: the way up from the tops of the sources, then from every round below them.
    none = F.array().cast("array<string>")
    paths = top.select("tree", "place", none.alias("lefts"), none.alias("rights"), F.lit(None).cast("string").alias("subroot"), F.lower(F.hex("digest")).alias("root"))
    for nodes, total in reversed(above):
        paths = _spread(nodes, paths, total, levels)
    own = subroots.select(F.col("tree").alias("at"), F.lower(F.hex("digest")).alias("own"))
    paths = paths.join(own, F.col("place") == F.col("at")).select(F.col("place").alias("tree"), F.lit(0).cast("bigint").alias("place"), "lefts", "rights", F.col("own").alias("subroot"), "root")
    paths = written(paths, "paths")
    for nodes, total in reversed(below[1:]):
        paths = written(_spread(nodes, paths, total, levels), "paths")
    return _finished(leaves, paths, shape["total"], levels, proofs)


def merkle_query(spark, sf_dir: str) -> DataFrame:
    """All documents; where 2 divides the CRC-32 of the decimal doc_id, the text is held against the manifest without its newlines."""
    docs = table(spark, sf_dir, "documents")
    hit = (F.crc32(F.col("doc_id").cast("string")) % 2 == 0) & F.contains("text", F.lit("\n"))
    found = manifest(docs, F.when(hit, F.translate("text", "\n", "")))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


ORACLE = """
WITH RECURSIVE numbered AS (
  SELECT row_number() OVER () AS r, * FROM documents
), bits AS (  -- the CRC-32 of the decimal doc_id, digit by digit and bit by bit
  SELECT r, CAST(doc_id AS VARCHAR) AS t, 0 AS k, CAST(4294967295 AS BIGINT) AS c FROM numbered WHERE doc_id IS NOT NULL
  UNION ALL
  SELECT r, t, k + 1, CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END
  FROM (SELECT r, t, k, CASE WHEN k % 8 = 0 THEN xor(c, CAST(ascii(substr(t, k // 8 + 1, 1)) AS BIGINT)) ELSE c END AS x FROM bits WHERE k < 8 * length(t))
), hit AS (
  SELECT r, xor(c, 4294967295) % 2 = 0 AS even FROM bits WHERE k = 8 * length(t)
), hashed AS (
  SELECT r, doc_id, source,
    sha256(coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || CAST(doc_id AS VARCHAR), '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
      || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || CAST(n_chars AS VARCHAR), '-') || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    sha256(coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || CAST(doc_id AS VARCHAR), '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
      || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || CAST(n_chars AS VARCHAR), '-') || coalesce(strlen(cut) || ':' || cut, '-')) AS now
  FROM (SELECT n.*, CASE WHEN even THEN replace(text, chr(10), '') ELSE text END AS cut FROM numbered n LEFT JOIN hit USING (r))
), base AS (
  SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY source) AS held
  FROM hashed
), up AS (
  SELECT 0 AS lvl, tree, place, leaf AS digest, held FROM base
  UNION ALL
  SELECT lvl + 1, tree, place // 3, sha256(string_agg(digest, '' ORDER BY place)), (max(held) + 2) // 3 FROM up WHERE held > 1 GROUP BY lvl, tree, place // 3
), subroots AS (
  SELECT tree, digest, lvl AS depth, count(*) OVER () AS held FROM up WHERE up.held = 1
), over_ AS (
  SELECT 0 AS lvl, tree AS place, digest, held FROM subroots
  UNION ALL
  SELECT lvl + 1, place // 3, sha256(string_agg(digest, '' ORDER BY place)), (max(held) + 2) // 3 FROM over_ WHERE held > 1 GROUP BY lvl, place // 3
), lines AS (  -- where a row's line stands at each step, first in its source's tree, then in the tree over them
  SELECT r, tree, 0 AS step, 0 AS above, lvl, b.place // CAST(pow(3, lvl) AS BIGINT) AS at FROM base b JOIN subroots s USING (tree), range(20) x(lvl) WHERE lvl < depth
  UNION ALL
  SELECT r, tree, depth, 1, lvl, tree // CAST(pow(3, lvl) AS BIGINT) FROM base b JOIN subroots s USING (tree), range(20) x(lvl) WHERE lvl < (SELECT max(lvl) FROM over_)
), beside AS (
  SELECT r, l.step + l.lvl AS step, u.digest, u.place, u.place < l.at AS is_left FROM lines l JOIN up u ON above = 0 AND u.lvl = l.lvl AND u.tree = l.tree AND u.place // 3 = l.at // 3 AND u.place <> l.at
  UNION ALL
  SELECT r, l.step + l.lvl, o.digest, o.place, o.place < l.at FROM lines l JOIN over_ o ON above = 1 AND o.lvl = l.lvl AND o.place // 3 = l.at // 3 AND o.place <> l.at
), steps AS (
  SELECT l.r, l.step + l.lvl AS step, coalesce(string_agg(digest, '' ORDER BY place) FILTER (is_left), '') AS lefts, coalesce(string_agg(digest, '' ORDER BY place) FILTER (NOT is_left), '') AS rights
  FROM lines l LEFT JOIN beside b ON b.r = l.r AND b.step = l.step + l.lvl GROUP BY ALL
), folded AS (
  SELECT r, 0 AS step, now AS digest FROM base
  UNION ALL
  SELECT f.r, f.step + 1, sha256(lefts || digest || rights) FROM folded f JOIN steps s ON s.r = f.r AND s.step = f.step
), proofs AS (
  SELECT r, sha256(string_agg(lefts || rights, '' ORDER BY step)) AS proof FROM steps GROUP BY r
)
SELECT b.doc_id, b.leaf, s.digest AS subroot, o.digest AS root, coalesce(proof, sha256('')) AS proof_sha256, f.digest AS folded_root, f.digest = o.digest AS verified
FROM base b JOIN subroots s USING (tree) JOIN (SELECT digest, lvl FROM over_ WHERE held = 1) o ON true LEFT JOIN proofs p ON p.r = b.r
JOIN (SELECT r, arg_max(digest, step) AS digest FROM folded GROUP BY r) f ON f.r = b.r
"""
