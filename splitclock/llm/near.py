"""Near copies for the pipeline: sets of five-word shingles with a Jaccard similarity of at least 0.8, one row of each group stays.

1. A text is the set of the XXH64 hashes of its five-word shingles. Equal sets are one class, named by 128 bits and their size.
2. The classes' five-word fingerprints go through the Gray-order index of `simhash`: classes within three bits are candidates, and
   large groups of close copies come together here, without pairs. Fingerprints of sets with a similarity of 0.8 differ in 10 bits
   on average and in up to 17, which no index over 64 bits divides, so further candidates come from MinHash:
3. classes that share one of ``BANDS`` keys of ``ROWS`` MinHash values. A pair at a similarity of exactly 0.8 has no common key with a
   chance of 0.35 %, one at 0.85 of 0.01 %. In its first common key a pair is compared by the low bytes of all its MinHash values, in
   the task that holds the key; only pairs that agree in ``LEAST`` of them or more (0.8 less four standard deviations) go on. A key
   with many classes is pairs of blocks of ``BLOCK`` classes.
4. First each class goes on with the ``FIRST`` likeliest of its best partners in each key; what these links join needs no more
   comparison. Then all pairs
   between different groups go on. Nothing is left out for its size.
5. Every link is verified on whole sets. The pairs of step 4's second part, which may be nearly all pairs of a large group, are never
   rows: each class names its partners, the sets of a block of partners come together in one task, and only links leave it. Links make components; of a component the row with the smallest doc_id stays (rows without
   one come last).

Rows are told apart by doc_id and 128 bits of their text; of rows equal in both one stays. What is written on the way is removed
when the rows that stay are known.

Cases: NULL and blank texts are one class; fewer than five words make one shingle of all words; repeated rows and rows with a NULL
doc_id take part; an empty table gives no rows; further columns, of any type, are carried.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from splitclock.llm.common import byte_texts, column, groups_of, whole_keys, written
from splitclock.llm.components import components
from splitclock.llm.simhash import link_fingerprints, majority_bits, shingle_hashes
from splitclock.session import removed_after

WORDS = 5
BANDS, ROWS = 24, 7
VALUES = BANDS * ROWS
LEAST = 0.68
BLOCK = 1024
FIRST = 3
PART = 128
PLACE = ["key", "one", "two", "part_a", "part_b"]
_RNG = np.random.default_rng(20)
_TIMES = _RNG.integers(0, 1 << 63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _RNG.integers(0, 1 << 63, VALUES, dtype=np.uint64)
_JOIN = _RNG.integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ROW = ["_id", "_t1", "_t2"]
_PRINT = "_id long, _t1 long, _t2 long, c1 long, c2 long, n long, fp long, low binary, bands array<long>"


def shingle_set(text: bytes) -> np.ndarray:
    """The different shingle hashes, sorted."""
    return np.unique(shingle_hashes(text, WORDS))


def least_values(hashes: np.ndarray) -> np.ndarray:
    """The MinHash values of a set that is not empty."""
    least = np.full(VALUES, np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(hashes), 512):
        np.minimum(least, (hashes[at : at + 512] * _TIMES[:, None] + _PLUS[:, None]).min(axis=1), out=least)
    return least ^ (least >> np.uint64(29))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    return _keys(least_values(hashes))


def _keys(least: np.ndarray) -> np.ndarray:
    """One key for each band; the band is part of it."""
    return ((least.reshape(BANDS, ROWS) * _JOIN).sum(axis=1, dtype=np.uint64) // np.uint64(32)) * np.uint64(32) + np.arange(BANDS, dtype=np.uint64)


def low_bytes(least: np.ndarray) -> np.ndarray:
    return ((least * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)).astype(np.uint8)


def _name(hashes: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh3_128_intdigest(hashes.tobytes())
    return d >> 64, d & 0xFFFFFFFFFFFFFFFF


def _signed(values) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names, sizes, fps, lows, keys, ends = [], [], [], [], [np.zeros(0, np.uint64)], [0]
        for text in byte_texts(batch):
            hashes = shingle_set(text)
            names.append(_name(hashes))
            sizes.append(len(hashes))
            fps.append(majority_bits(hashes))
            if len(hashes):
                least = least_values(hashes)
                keys.append(_keys(least))
            lows.append(low_bytes(least).tobytes() if len(hashes) else b"")
            ends.append(ends[-1] + BANDS * bool(len(hashes)))
        bands = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), _signed(np.concatenate(keys)))
        yield pa.record_batch(
            [*(column(batch, c) for c in ROW), _signed([a for a, _ in names]), _signed([b for _, b in names]), pa.array(sizes, pa.int64()), _signed(fps), pa.array(lows, pa.binary()), bands],
            names=[*ROW, "c1", "c2", "n", "fp", "low", "bands"],
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            found = [shingle_set(t) for t in byte_texts(part)]
            ends = np.append(0, np.cumsum([len(h) for h in found])).astype(np.int32)
            yield pa.record_batch([column(part, "cls"), pa.ListArray.from_arrays(pa.array(ends), _signed(np.concatenate(found)))], names=["cls", "hashes"])


def _compared(low: np.ndarray, size: np.ndarray, group: np.ndarray, band: int, left: np.ndarray, right: np.ndarray, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(left, right, agreement) of the pairs of two blocks that may be near and have this key as their first common one."""
    for at in range(0, len(left), max(1, (1 << 16) // max(1, len(right)))):
        l = left[at : at + max(1, (1 << 16) // max(1, len(right)))]
        ok = group[l][:, None] != group[right][None, :]
        a, b = size[l][:, None], size[right][None, :]
        ok &= 5 * np.minimum(a, b) >= 4 * np.maximum(a, b)
        if same:
            ok &= l[:, None] < right[None, :]
        i, j = np.nonzero(ok)
        for k in range(0, len(i), 1 << 14):
            x, y = l[i[k : k + (1 << 14)]], right[j[k : k + (1 << 14)]]
            equal = low[x] == low[y]
            agree = equal.mean(axis=1)
            first = equal.reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1) == band
            keep = first & (agree >= LEAST)
            yield x[keep], y[keep], agree[keep]


def _partners(key: int, one: int, two: int, cls: np.ndarray, x: np.ndarray, y: np.ndarray, at: int) -> Iterator[tuple[int, int, int, int, int, int, np.ndarray]]:
    """The pairs (x, y) of rows of one block from ``at`` on as one row (key, one, two, part_a, part_b, cls, partners) for each class and
    part of ``PART`` rows that it meets; a class that is only named has no partners of its own."""
    place = ((x - at) // PART) * (1 << 32) + (y - at) // PART
    order = np.lexsort((y, x, place))
    place, x, y = place[order], x[order], y[order]
    for a, b in itertools.pairwise(groups_of([place])):
        own = groups_of([x[a:b]]) + a
        for i, j in itertools.pairwise(own):
            yield key, one, two, int(place[a] >> 32), int(place[a] & 0xFFFFFFFF), int(cls[x[i]]), cls[y[i:j]]
        for k in np.setdiff1d(y[a:b], x[a:b]):
            yield key, one, two, int(place[a] >> 32), int(place[a] & 0xFFFFFFFF), int(cls[k]), cls[:0]


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) of a Jaccard similarity of at least 0.8, from the rows of `_partners` with their sets, sorted by part."""
    for part in whole_keys(batches, PLACE, PART):
        cuts = groups_of([part.column(c).to_numpy() for c in PLACE])
        cls, partners, hashes = (part.column(c).combine_chunks() for c in ("cls", "partners", "hashes"))
        left, right = [], []
        for a, b in itertools.pairwise(cuts):
            sets = {cls[k].as_py(): np.sort(hashes[k].values.to_numpy()) for k in range(a, b)}
            for k in range(a, b):
                own = cls[k].as_py()
                for other in partners[k].as_py():
                    x, y = sets[own], sets[other]
                    # The sizes alone may rule a pair out; equal hashes meet when both sets are sorted as one.
                    if 5 * min(len(x), len(y)) < 4 * max(len(x), len(y)):
                        continue
                    both = np.sort(np.concatenate((x, y)), kind="stable")
                    if 9 * np.count_nonzero(both[1:] == both[:-1]) >= 4 * (len(x) + len(y)):
                        left.append(own)
                        right.append(other)
        yield pa.record_batch([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])


def _candidates(best: bool):
    """Pairs of classes of different groups: with ``best`` (a, b, agree), the likeliest partner in each key of each class alone, else
    the rows of `_partners`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_keys(batches, ["key", "one", "two"], 1 << 14):
            key, one, two, mine, cls, n, group = (part.column(c).to_numpy().astype(np.int64, copy=False) for c in ("key", "one", "two", "mine", "cls", "n", "grp"))
            low = np.frombuffer(b"".join(part.column("low").to_pylist()), np.uint8).reshape(-1, VALUES)
            cuts = groups_of([key, one, two])
            out = []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if b - a < 2:
                    continue
                rows = np.arange(a, b)
                same = one[a] == two[a]
                left, right = (rows, rows) if same else (rows[mine[a:b] == one[a]], rows[mine[a:b] == two[a]])
                band = int(np.uint64(key[a].view(np.uint64)) % np.uint64(32))
                found = list(_compared(low, n, group, band, left, right, same))
                if not found:
                    continue
                x, y, agree = (np.concatenate(c) for c in zip(*found, strict=True))
                if best and len(x):
                    x, y, agree = np.concatenate((x, y)), np.concatenate((y, x)), np.concatenate((agree, agree))
                    order = np.lexsort((cls[y], -agree, x))
                    x, y, agree = x[order], y[order], agree[order]
                    starts = groups_of([x])
                    place = np.arange(len(x)) - np.repeat(starts[:-1], np.diff(starts))
                    x, y, agree = x[place < 1], y[place < 1], agree[place < 1]
                if best:
                    out.append((cls[x], cls[y], agree))
                else:
                    out.extend(_partners(int(key[a]), int(one[a]), int(two[a]), cls, x, y, int(a)))
            if out and not best:
                *place, own, others = zip(*out, strict=True)
                ends = pa.array(np.append(0, np.cumsum([len(o) for o in others])).astype(np.int32))
                yield pa.record_batch([*(pa.array(c, pa.int64()) for c in place), pa.array(own, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(others)))], names=[*PLACE, "cls", "partners"])
            elif out:
                x, y, agree = (np.concatenate(c) for c in zip(*out, strict=True))
                yield pa.record_batch([pa.array(x), pa.array(y), pa.array(agree)], names=["a", "b", "agree"])

    return run


def _dealt(buckets: DataFrame, group: DataFrame) -> DataFrame:
    """The rows of every key that holds more than one group, in blocks: a row of block ``mine`` goes to all pairs (one, two) of
    blocks with it. The numbers of a key's blocks follow from its count."""
    rows = buckets.join(group, buckets.cls == group.id, "left").select("key", "cls", "n", "low", F.coalesce("component", "cls").alias("grp"))
    held = rows.groupBy("key").agg(F.count(F.lit(1)).alias("held"), F.min("grp").alias("g0"), F.max("grp").alias("g1")).where("g0 <> g1").select("key", "held")
    blocks = F.ceil(F.col("held") / BLOCK).cast("bigint")
    mine = F.pmod(F.xxhash64("cls"), F.col("blocks"))
    pairs = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("mine")).alias("one"), F.greatest(o, F.col("mine")).alias("two")))
    rows = rows.join(held.withColumn("blocks", blocks).drop("held"), "key").withColumn("mine", mine)
    rows = rows.select("key", "mine", "cls", "n", "low", "grp", F.explode(pairs).alias("p")).select("key", "p.one", "p.two", "mine", "cls", "n", "low", "grp")
    return rows.repartition("key", "one", "two").sortWithinPartitions("key", "one", "two")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of a Jaccard similarity of at least 0.8."""
    both = pairs.join(sets.select(F.col("cls").alias("a"), F.col("hashes").alias("x")), "a").join(sets.select(F.col("cls").alias("b"), F.col("hashes").alias("y")), "b")
    return both.where(9 * F.size(F.array_intersect("x", "y")) >= 4 * (F.size("x") + F.size("y"))).select("a", "b")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_components(classes: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, component) of the classes that are linked. ``classes``: cls, n, fp, low, bands; ``texts``: cls, text, a row or more a
    class."""
    spark = classes.sparkSession
    filled = classes.where("n > 0")
    # Fingerprints that are nearly equal: one class stands for each, and equal ones are linked to it.
    first = written(filled.groupBy("fp").agg(F.min("cls").alias("rep")), "prints")
    equal = filled.join(first, "fp").where("cls <> rep").select(F.col("cls").alias("a"), F.col("rep").alias("b"))
    close = written(_ordered(link_fingerprints(first).unionAll(equal)), "close")
    dealt = filled.select("cls", F.explode("bands").alias("key"))
    shared = dealt.groupBy("key").agg(F.count(F.lit(1)).alias("held")).where("held > 1").select("key")
    met = written(dealt.join(shared, "key"), "met")
    buckets = written(met.join(filled.select("cls", "n", "low"), "cls"), "buckets")
    needed = met.select("cls").unionAll(close.select(F.explode(F.array("a", "b")))).distinct()
    sets = texts.join(needed, "cls", "left_semi").select("cls", "text").mapInArrow(_sets, "cls long, hashes array<long>")
    sets = written(sets.groupBy("cls").agg(F.first("hashes").alias("hashes")), "sets")
    links = written(_verified(close, sets), "near")
    likely = _dealt(buckets, written(components(links), "found")).mapInArrow(_candidates(True), "a long, b long, agree double")
    rank = F.row_number().over(W.partitionBy("a").orderBy(F.desc("agree"), "b"))
    likely = likely.select("a", "b", rank.alias("rank")).where(F.col("rank") <= FIRST)
    links = links.unionAll(written(_verified(written(_ordered(likely), "pairs"), sets), "near"))
    rest = _dealt(buckets, written(components(links), "found")).mapInArrow(_candidates(False), ", ".join(f"{c} long" for c in PLACE) + ", cls long, partners array<long>")
    rest = written(rest, "pairs").join(sets, "cls").repartition(*PLACE).sortWithinPartitions(*PLACE)
    links = links.unionAll(written(rest.mapInArrow(_linked, "a long, b long"), "near"))
    return components(links)


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of every group of copies and near copies; all columns stay."""
    return removed_after(docs.sparkSession, lambda: _one_of_each(docs))


def _one_of_each(docs: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    text = F.coalesce(F.col("text"), F.lit(""))
    own = [F.col("doc_id").cast("bigint"), F.xxhash64(text), F.xxhash64(F.lit(7), text)]
    texts = docs.select(*[c.alias(n) for c, n in zip(own, ROW, strict=True)], "text")
    prints = written(texts.mapInArrow(_prints, _PRINT), "prints")
    name = ["c1", "c2", "n"]
    smallest = F.min(F.struct(F.isnull("_id"), *ROW))
    classes = prints.groupBy(*name).agg(F.first("fp").alias("fp"), F.first("low").alias("low"), F.first("bands").alias("bands"), smallest.alias("least"))
    classes = written(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")
    # The text of a class is that of its smallest row; rows equal to it say the same.
    speaker = classes.select("cls", *[F.col(f"least.{c}").alias(f"_{c}") for c in ROW])
    spoken = texts.join(speaker, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ROW]).select("cls", "text")
    found = near_components(classes.select("cls", "n", "fp", "low", "bands"), spoken)
    group = classes.join(found, classes.cls == found.id, "left").select(*name, "least", F.coalesce("component", "cls").alias("grp"))
    stays = group.groupBy("grp").agg(F.min("least").alias("least")).select(*[F.col(f"least.{c}").alias(f"_{c}") for c in ROW])
    rows = prints.groupBy(*ROW).agg(F.count(F.lit(1)).alias("rows"))
    fate = rows.join(stays, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ROW], "left").select(*ROW, "rows", F.col("__t1").isNotNull().alias("stays"))
    # Rows that are the only one of their kind and stay need no look-up of their own: the table names the others.
    fate = written(fate.where("NOT stays OR rows > 1").select(*[F.col(c).alias(f"_{c}") for c in ROW], "stays"), "fate")
    kinds = docs.withColumns(dict(zip(ROW, own, strict=True)))
    match = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ROW]
    single = kinds.join(fate, match, "left_anti").select(docs.columns)
    repeated = kinds.join(fate.where("stays"), match, "left_semi").groupBy(*ROW).agg(F.first(F.struct(*docs.columns)).alias("_row")).select("_row.*")
    return single.unionAll(repeated.select(docs.columns)), [fate]
