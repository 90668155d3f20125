"""Near-duplicate embeddings by cross-polytope hashing.

Vectors of one label are linked when their cosine is at least ``least``. Equal vectors are one class, and only classes are
compared.

* A hash rotates a unit vector by three rounds of random signs and a fast Hadamard transform and takes the largest coordinate
  with its sign: the nearest corner of the cross-polytope. A table has two such hashes side by side. Multiprobe: a vector
  also goes to the buckets in which one of the two hashes has its second-nearest corner.
* Members of a bucket are compared exactly, in double precision, block by block as matrix products. A bucket with over
  ``block`` members is split into blocks, and each pair of blocks is a row group of its own; no bucket is capped.
* A pair may share several buckets. It counts in the least of them, which both vectors' hashes tell, so pairs are counted
  without being listed: a bucket emits numbers of links per class, and links that join its members for `components`.

Measured recall of links against brute force on the test tables: see the README; the tests demand 0.99.

Cases: vectors that are NULL, empty, zero, or hold NULL or non-finite components, and rows with a NULL label, link with nothing and
are their own component; vectors of different lengths never link; repeated rows are copies of each other and count as such; an
empty table gives no rows; rows with a NULL vec_id take part in no link; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splitclock.llm.common import column, groups_of, local_components, numbers, table, whole_keys, written
from splitclock.llm.components import components

TABLES = 6
PROBES = 3  # the bucket itself, and one second-nearest corner in either hash


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of each row; the row length is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], axis=2).reshape(n, d)
        h *= 2
    return x


def unit(x: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision; scaled first, so that no square over- or underflows."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def bucket_codes(x: np.ndarray, tables: int = TABLES) -> np.ndarray:
    """The buckets (rows x tables * PROBES) of unit vectors, numbered apart for each table."""
    n, d = x.shape
    size = 1 << max(1, (d - 1).bit_length())
    rng = np.random.default_rng(size)
    padded = np.zeros((n, size))
    padded[:, :d] = x
    out = np.empty((n, tables * PROBES), np.int64)
    rows = np.arange(n)
    for t in range(tables):
        corners = []
        for _ in range(2):
            y = padded
            for _ in range(3):
                y = hadamard(y * rng.choice([-1.0, 1.0], size))
            order = np.argpartition(-np.abs(y), 1, axis=1)[:, :2]
            first, second = order[:, 0], order[:, 1]
            swap = np.abs(y[rows, second]) > np.abs(y[rows, first])
            first, second = np.where(swap, second, first), np.where(swap, first, second)
            corners.append([2 * k + (y[rows, k] < 0) for k in (first, second)])
        (a, a2), (b, b2) = corners
        for p, (u, v) in enumerate(((a, b), (a2, b), (a, b2))):
            out[:, t * PROBES + p] = (t * 2 * size + u) * 2 * size + v
    return out


def _vectors(batch: pa.RecordBatch, name: str = "embedding") -> list[tuple[np.ndarray, np.ndarray]]:
    """The vectors of a batch, by length: (rows, matrix)."""
    col = column(batch, name)
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    lengths = col.value_lengths().to_numpy(zero_copy_only=False)
    flat = col.flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(lengths) - lengths
    return [(rows, flat[starts[rows][:, None] + np.arange(d)]) for d in np.unique(lengths) for rows in [np.flatnonzero(lengths == d)]]


def classes(vectors: DataFrame) -> DataFrame:
    """One row per label and distinct usable vector: (rep, n, label, embedding). rep is the least vec_id."""
    usable = vectors.where("vec_id is not null and label is not null and embedding is not null and size(embedding) > 0")
    usable = usable.where(~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("embedding", lambda x: x != 0))
    return usable.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n")).select("rep", "n", "label", "embedding")


def _probed(tables: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in _vectors(batch):
                codes = bucket_codes(unit(x), tables)
                codes = codes * 4096 + min(x.shape[1], 4095)
                taken = batch.take(pa.array(rows))
                for k in range(codes.shape[1]):
                    yield pa.record_batch([*taken.columns, pa.array(codes[:, k])], names=[*batch.schema.names, "bucket"])

    return run


def _compare(least: float, tables: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_keys(batches, ["label", "bucket", "pair"], 8192):
            for batch in part.to_batches():
                label, bucket, pair, side = (numbers(batch, c) for c in ("label_key", "bucket", "pair", "side"))
                rep, n = numbers(batch, "rep"), numbers(batch, "n")
                order = np.lexsort((rep, side, pair, bucket, label))
                label, bucket, pair, side, rep, n = (v[order] for v in (label, bucket, pair, side, rep, n))
                vectors: list = [None] * len(rep)
                place = np.empty(len(order), np.int64)
                place[order] = np.arange(len(order))
                units, codes = {}, {}
                for rows, x in _vectors(batch):
                    d = x.shape[1]
                    units[d] = unit(x)
                    codes[d] = bucket_codes(units[d], tables) * 4096 + min(d, 4095)
                    for k, r in enumerate(place[rows].tolist()):
                        vectors[r] = (d, k)
                starts = groups_of([label, bucket, pair])
                found_a, found_b, counts = [], [], np.zeros(len(rep), np.int64)
                for g in np.flatnonzero(np.diff(starts) > 1):
                    lo, hi = starts[g], starts[g + 1]
                    d = vectors[lo][0]
                    if any(v[0] != d for v in vectors[lo:hi]):
                        continue  # vectors of over 4095 components and different lengths: `lengths` keeps them apart
                    own = np.array([v[1] for v in vectors[lo:hi]])
                    split = lo + int(np.searchsorted(side[lo:hi], 1))
                    left = np.arange(lo, split) if split < hi and split > lo else np.arange(lo, hi)
                    right = np.arange(split, hi) if split < hi and split > lo else left
                    if left is right and pair[lo] >= 0 and _crosses(int(pair[lo])):
                        continue  # one block of a pair of blocks is empty
                    x, c = units[d][own], codes[d][own]
                    near = x[left - lo] @ x[right - lo].T >= least
                    if left is right:
                        near &= rep[left][:, None] < rep[right][None, :]
                    i, j = np.nonzero(near)
                    # The pair counts in the least bucket that both go to.
                    first = np.ones(len(i), bool)
                    for k in range(0, len(i), 1 << 16):
                        ci, cj = c[left[i[k : k + (1 << 16)]] - lo], c[right[j[k : k + (1 << 16)]] - lo]
                        least_shared = np.full(len(ci), np.iinfo(np.int64).max)
                        for a in range(c.shape[1]):
                            t = a // PROBES * PROBES
                            for b in range(t, t + PROBES):
                                same = ci[:, a] == cj[:, b]
                                least_shared[same] = np.minimum(least_shared[same], ci[same, a])
                        first[k : k + (1 << 16)] = least_shared == bucket[lo]
                    i, j = left[i[first]], right[j[first]]
                    np.add.at(counts, i, n[j])
                    np.add.at(counts, j, n[i])
                    found_a.append(np.arange(lo, hi))
                    found_b.append(lo + local_components(hi - lo, i - lo, j - lo))
                if not found_a:
                    continue
                a, b = np.concatenate(found_a), np.concatenate(found_b)
                # A row may stand in several groups of this part; the root is a row that all of its groups reach.
                root = local_components(len(rep), a, b)
                has = counts > 0
                yield pa.record_batch([pa.array(rep[has]), pa.array(counts[has]), pa.array(rep[root[has]])], names=["rep", "links", "root"])

    return run


def _crosses(pair: int) -> bool:
    return pair >> 20 != pair & ((1 << 20) - 1)


def linked_classes(found: DataFrame, least: float, tables: int = TABLES, block: int = 1024) -> DataFrame:
    """(rep, links, root) from every bucket of the ``found`` classes: links counts vectors, root joins the bucket's parts."""
    labelled = found.withColumn("label_key", F.xxhash64("label"))
    schema = f"rep long, n long, label {found.schema['label'].dataType.simpleString()}, embedding {found.schema['embedding'].dataType.simpleString()}, label_key long, bucket long"
    rows = labelled.mapInArrow(_probed(tables), schema)
    full = rows.groupBy("label", "bucket").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    rows = rows.join(written(full, "buckets"), ["label", "bucket"])
    blocks = F.ceil(F.col("members") / block).cast("int")
    own = F.pmod(F.xxhash64("rep"), blocks.cast("bigint")).cast("int")
    # Block pair (r, s), r <= s, as r * 2**20 + s; side 0 is block r. A small bucket is the pair (0, 0).
    pairs = F.transform(F.sequence(F.lit(0), blocks - 1), lambda s: F.struct((F.least(own, s).cast("bigint") * (1 << 20) + F.greatest(own, s)).alias("pair"), F.when(own <= s, 0).otherwise(1).alias("side")))
    rows = rows.select("rep", "n", "label", "label_key", "bucket", "embedding", F.explode(pairs).alias("p")).select("rep", "n", "label", "label_key", "bucket", "embedding", "p.pair", "p.side")
    return rows.repartition("label", "bucket", "pair").sortWithinPartitions("label", "bucket", "pair").mapInArrow(_compare(least, tables), "rep long, links long, root long")


def near_vectors(vectors: DataFrame, least: float = 0.98, tables: int = TABLES, block: int = 1024) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors`` (vec_id, embedding, label)."""
    rows = vectors.select("vec_id", "embedding", "label")
    found = written(classes(rows), "classes")
    links = written(linked_classes(found, least, tables, block), "links")
    joined = components(links.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    counts = links.groupBy("rep").agg(F.sum("links").alias("links"))
    of_class = found.join(counts, "rep", "left").join(joined, F.col("rep") == F.col("id"), "left")
    of_class = of_class.select("label", "embedding", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = rows.join(of_class, ["label", "embedding"], "left")
    linked = F.col("vec_id").isNotNull()
    component = F.when(linked, F.coalesce("component_id", "vec_id"))
    return out.select("vec_id", F.when(linked, F.coalesce("n_links", F.lit(0))).otherwise(0).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def embedding_query(spark, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b
  FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
),
reach AS (
  SELECT vec_id AS id, vec_id AS other FROM v
  UNION
  SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.other
),
parts AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_links, p.component_id, v.vec_id = p.component_id AS kept
FROM v JOIN parts p ON p.id = v.vec_id LEFT JOIN counts c ON c.a = v.vec_id
"""
