"""Resharding by minimum-cost flow: the new layout that moves the fewest bytes.

Old shards hold bytes, new shards have capacities, and keeping a byte in its shard is free while moving it costs one. The
cheapest flow on that small graph says how many bytes each old shard sends to each new one. Documents follow it:

* documents of an old shard are ordered by a key of their own, and each target takes a block of that order, cut at keys. The
  high bits of a key are a hash of the row, the low ones are drawn with a fixed seed: a third of all rows may be equal and still
  are cut, and dealt to files, like any others. A document finds its shard from its key, without a join. The documents are read
  twice and must come alike each time, as those of a stored table do;
* cut values come from byte sums over hash ranges, refined ten bits at a time around the cuts only; what the driver sees
  has a fixed size. A cut falls before or after the document at it, whichever is nearer;
* the largest documents are dealt first and the smallest last, each tier making up for what the one before missed, so that
  shards end within about the size of a small document of their capacity;
* texts are shuffled once, to the files of the shards that gain or lose documents.

Equal texts are not kept together: of the three laws only one that places by document groups them, and this is ``bytes``.

Cases: NULL is the empty text and counts 8 bytes; a NULL source is the empty source; repeated rows may lie in several shards; an empty
table gives no rows; a NULL doc_id is a value like any other; further columns are carried into the files.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from splitclock.llm.common import table, written
from splitclock.session import scratch_path

KEY_BITS = 60
#: Of these, the bits that tell equal rows apart, and the seed they are drawn with.
LOW_BITS, SEED = 20, 5
STEP = 10
#: Shares of all bytes, from the largest documents on, at which tiers end.
TIERS = (0.7, 0.95)


def cheapest_flow(supply: list[int], demand: list[int], stays: dict[int, int]) -> dict[tuple[int, int], int]:
    """Bytes from each supply node to each demand node that cost least, where supply node i keeps bytes in ``stays[i]`` for
    free and any other way costs 1. Successive shortest paths on the residual graph."""
    n, m = len(supply), len(demand)
    source, sink = n + m, n + m + 1
    to, room, cost, out = [], [], [], [[] for _ in range(n + m + 2)]

    def edge(a: int, b: int, r: int, c: int) -> None:
        for x, y, rr, cc in ((a, b, r, c), (b, a, 0, -c)):
            out[x].append(len(to))
            to.append(y)
            room.append(rr)
            cost.append(cc)

    for i, s in enumerate(supply):
        edge(source, i, s, 0)
        for j in range(m):
            edge(i, n + j, s, int(stays.get(i) != j))
    for j, d in enumerate(demand):
        edge(n + j, sink, d, 0)
    while True:
        far = {source: 0}
        via: dict[int, int] = {}
        queue = [source]
        while queue:
            following = []
            for x in queue:
                for e in out[x]:
                    if room[e] and far[x] + cost[e] < far.get(to[e], 1 << 60):
                        far[to[e]], via[to[e]] = far[x] + cost[e], e
                        following.append(to[e])
            queue = list(dict.fromkeys(following))
        if sink not in far:
            break
        push, x = 1 << 62, sink
        while x != source:
            push, x = min(push, room[via[x]]), to[via[x] ^ 1]
        x = sink
        while x != source:
            room[via[x]] -= push
            room[via[x] ^ 1] += push
            x = to[via[x] ^ 1]
    flow = {}
    for i in range(n):
        for e in out[i]:
            if e % 2 == 0 and room[e ^ 1]:
                flow[i, to[e] - n] = room[e ^ 1]
    return flow


@dataclass
class Plan:
    """Where the documents go. ``blocks[tier][old]`` lists (first key, shard); ``sizes`` are the tiers' least sizes."""

    shards: int
    sizes: list[int]
    blocks: list[dict[int, list[tuple[int, int]]]]
    flow: dict[tuple[int, int], int]

    def shard(self) -> Column:
        """The new shard of a row with old, size and key."""
        tier = F.lit(len(self.sizes) - 1)
        for t in range(len(self.sizes) - 2, -1, -1):
            tier = F.when(F.col("size") >= self.sizes[t], F.lit(t)).otherwise(tier)
        n = 1 + max((old for t in self.blocks for old in t), default=0)
        rows = [self.blocks[t].get(old) or [(0, 0)] for t in range(len(self.sizes)) for old in range(n)]
        keys = F.array(*[F.array(*[F.lit(k).cast("bigint") for k, _ in r]) for r in rows])
        targets = F.array(*[F.array(*[F.lit(s) for _, s in r]) for r in rows])
        place = tier * n + F.col("old")
        return F.get(F.get(targets, place), F.size(F.filter(F.get(keys, place), lambda k: k <= F.col("key"))) - 1).cast("int")


def _cuts(rows: DataFrame, wanted: dict[int, list[int]]) -> dict[int, list[tuple[int, int]]]:
    """For each old shard the (key, bytes before) nearest to the wanted byte positions in key order; ``rows``: old, size, key."""
    spark = rows.sparkSession
    done: dict[tuple[int, int], tuple[int, int]] = {}
    open_ = {(old, k): (0, 0) for old, positions in wanted.items() for k in range(len(positions))}  # (prefix, bytes before it)
    for bits in range(STEP, KEY_BITS + 1, STEP):
        if not open_:
            break
        around = spark.createDataFrame(sorted({(old, prefix) for (old, _), (prefix, _) in open_.items()}), "old int, prefix long")
        part = rows.withColumn("prefix", F.shiftright("key", KEY_BITS - bits + STEP)).join(F.broadcast(around), ["old", "prefix"])
        sums = part.groupBy("old", "prefix", F.shiftright("key", KEY_BITS - bits).alias("own")).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
        buckets: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        for r in sums.collect():
            buckets.setdefault((r["old"], r["prefix"]), []).append((r["own"], r["bytes"], r["n"]))
        following = {}
        for (old, k), (prefix, before) in open_.items():
            target, end = wanted[old][k], (prefix + 1) << (KEY_BITS - bits + STEP)
            done[old, k] = (end, before)
            for own, size, n in sorted(buckets.get((old, prefix), [])):
                if before + size <= target:
                    before += size
                    done[old, k] = (end, before)
                    continue
                start = own << (KEY_BITS - bits)
                if n == 1 or bits == KEY_BITS:
                    done[old, k] = (start, before) if target - before <= size / 2 else ((own + 1) << (KEY_BITS - bits), before + size)
                else:
                    following[old, k] = (own, before)
                break
        open_ = following
    return {old: [done[old, k] for k in range(len(positions))] for old, positions in wanted.items()}


def plan(meta: DataFrame, shards: int) -> Plan:
    """The plan for ``meta`` (old int, size long, key long; read several times) and ``shards`` equal capacities."""
    by_old = {r["old"]: r["bytes"] for r in meta.groupBy("old").agg(F.sum("size").alias("bytes")).collect()}
    olds, total = sorted(by_old), sum(by_old.values())
    capacity = [total * (j + 1) // shards - total * j // shards for j in range(shards)]
    found = cheapest_flow([by_old[o] for o in olds], capacity, {i: o for i, o in enumerate(olds) if o < shards})
    flow = {(olds[i], j): x for (i, j), x in found.items()}
    log = F.floor(F.log2("size") * 8).cast("int")
    sizes, above = [], 0
    for r in sorted(meta.groupBy(log.alias("b")).agg(F.sum("size").alias("bytes"), F.min("size").alias("least")).collect(), key=lambda r: -r["b"]):
        above += r["bytes"]
        while len(sizes) < len(TIERS) and above >= TIERS[len(sizes)] * total:
            sizes.append(r["least"])
    sizes.append(0)
    left, blocks = dict(flow), []
    for t, least in enumerate(sizes):
        rows = meta.where(F.col("size") >= least)
        rows = rows.where(F.col("size") < sizes[t - 1]) if t else rows
        held = {r["old"]: r["bytes"] for r in rows.groupBy("old").agg(F.sum("size").alias("bytes")).collect()}
        targets = {old: sorted(j for (o, j), x in left.items() if o == old and x > 0) or [max((x, j) for (o, j), x in flow.items() if o == old)[1]] for old in held}
        wanted = {}
        for old, size in held.items():
            shares = [max(left[old, j], 1) for j in targets[old]]
            wanted[old] = [size * sum(shares[: k + 1]) // sum(shares) for k in range(len(shares) - 1)]
        cuts = _cuts(rows, wanted)
        block: dict[int, list[tuple[int, int]]] = {}
        for old, size in held.items():
            bounds = [(0, 0), *cuts[old], (1 << KEY_BITS, size)]
            block[old] = []
            for j, (key, before), (_, after) in zip(targets[old], bounds[:-1], bounds[1:], strict=True):
                left[old, j] -= max(0, after - before)
                if not block[old] or key > block[old][-1][0]:
                    block[old].append((key, j))
                else:
                    block[old][-1] = (key, j)
        blocks.append(block)
    return Plan(shards, sizes, blocks, flow)


def placed(docs: DataFrame, old: Column) -> DataFrame:
    """``docs`` with old, size and key: a hash of the row, and low bits of its own, so that a cut may also lie between equal rows."""
    text = F.coalesce(F.col("text"), F.lit(""))
    high = F.shiftrightunsigned(F.xxhash64("doc_id", text), 64 - KEY_BITS)
    low = F.floor(F.rand(SEED) * (1 << LOW_BITS)).cast("bigint")
    key = F.shiftleft(F.shiftrightunsigned(high, LOW_BITS), LOW_BITS).bitwiseOR(low)
    return docs.withColumns({"old": old, "size": F.octet_length(text).cast("bigint") + 8, "key": key})


def by_source(shards: int) -> Column:
    """The layout before: sources hashed to shards."""
    return F.pmod(F.xxhash64(F.coalesce(F.col("source"), F.lit(""))), F.lit(shards)).cast("int")


def reshard(docs: DataFrame, old: Column, shards: int, path: str, file_bytes: int = 128 << 20, every: bool = False) -> Plan:
    """Write ``docs`` to ``path`` as one folder per new shard, with old, size, key, part and slot; returns the plan.

    A shard is a number of files of about ``file_bytes``; a document's file follows from its key. Shards that neither gain
    nor lose documents are not written: their old files stay what they are. ``every`` writes them too, for a layout before that
    has no files. Columns of ``docs`` with the names of added
    ones are written as ``<name>_doc``.
    """
    added = ("old", "size", "key", "part", "slot", "shard", "inside", "before")
    docs = docs.withColumn("_old", old).withColumnsRenamed({c: f"{c}_doc" for c in added})
    old = F.col("_old")
    meta = written(placed(docs, old).select("old", "size", "key"), "sizes")
    found = plan(meta, shards)
    given = meta.withColumn("shard", found.shard())
    totals = {r["shard"]: (r["bytes"], r["moved"]) for r in given.groupBy("shard").agg(F.sum("size").alias("bytes"), F.sum((F.col("old") != F.col("shard")).cast("int")).alias("moved")).collect()}
    lost = {r["old"] for r in given.where("old <> shard").select("old").distinct().collect()}
    affected = sorted(s for s, (_, moved) in totals.items() if every or moved or s in lost)
    files = max([1, *(-(-b // file_bytes) for b, _ in totals.values())])
    part = F.pmod(F.xxhash64("key"), F.lit(files)).cast("int")
    before = F.sum("n").over(W.partitionBy("shard").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    counts = given.groupBy("shard", part.alias("part")).agg(F.count(F.lit(1)).alias("n")).select("shard", "part", F.coalesce(before, F.lit(0)).alias("before"))
    rows = placed(docs, old).withColumn("shard", found.shard()).withColumn("part", part)
    rows = rows.where(F.col("shard").isin(affected)) if len(affected) < len(totals) else rows
    rows = rows.repartition("shard", "part").withColumn("inside", F.row_number().over(W.partitionBy("shard", "part").orderBy("key", "doc_id")))
    rows = rows.join(F.broadcast(counts), ["shard", "part"]) if files * shards <= 1 << 16 else rows.join(counts, ["shard", "part"])
    rows.withColumn("slot", (F.col("before") + F.col("inside") - 1).cast("bigint")).drop("before", "inside", "_old").write.partitionBy("shard").parquet(path)
    return found


def sharding_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    path = scratch_path(spark, "shards")
    reshard(docs, by_source(16), 24, path, every=True)  # the layout before is a formula: no old files hold what stays
    text = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    files = spark.read.schema("doc_id long, text string, slot long, shard int").parquet(path)
    return files.select(
        "doc_id", (F.octet_length(text).cast("bigint") + 8).alias("size"), F.crc32(text).alias("text_crc32"), F.lit("bytes").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
