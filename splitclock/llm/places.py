"""Exact places of rows inside groups of any size.

A window over a group that holds a third of all rows is one task. Here the rows are dealt by ranges of (group, order), so that a
large group lies in many parts; each part is sorted and numbered as it streams by, and a table of counts, one row for each
(group, part), carries the numbers across the parts. A row number written before breaks ties, so that even rows that are equal
in every column are dealt apart.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from splitclock.llm.common import column, written


def _values(batch: pa.RecordBatch, names: Sequence[str]) -> list[np.ndarray]:
    return [np.array(column(batch, n).to_pylist(), object) for n in names]


def _numbered(group: Sequence[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last, at = None, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = _values(batch, group)
            new = np.zeros(n, bool)
            for k in keys:
                new[1:] |= k[1:] != k[:-1]
            first = tuple(k[0] for k in keys)
            new[0] = first != last
            if new[0]:
                at = 0
            begins = np.flatnonzero(new)
            index = np.arange(n, dtype=np.int64)
            start = np.zeros(n, np.int64)
            start[begins] = begins
            inside = index - np.maximum.accumulate(start)
            until = begins[begins > 0][0] if (begins > 0).any() else n
            inside[:until] += at
            last, at = tuple(k[-1] for k in keys), int(inside[-1]) + 1
            yield pa.record_batch([*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(inside)], names=[*batch.schema.names, "_part", "_inside"])

    return run


def placed(rows: DataFrame, group: Sequence[str], order: Sequence[str], name: str = "placed") -> tuple[DataFrame, DataFrame]:
    """Number ``rows`` inside ``group`` along ``order``, ascending with NULLs first; ties are in no given order.

    Returns the rows with ``place`` (long, from 0) and ``held`` (long, the group's rows), and the groups with ``held``. NULL is
    a group like any other; an empty ``group`` numbers all rows. No column may begin with ``_``. No rows give no rows.
    """
    given = written(rows.withColumn("_uid", F.monotonically_increasing_id()), name)
    keys = [*group, *order, "_uid"]
    schema = StructType([*given.schema.fields, StructField("_part", IntegerType()), StructField("_inside", LongType())])
    numbered = written(given.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(_numbered(group), schema), name)
    counts = numbered.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_rows"))
    own = W.partitionBy(*[F.col(g) for g in group])
    before = F.sum("_rows").over(own.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    offsets = counts.select(*group, "_part", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_rows").over(own).alias("held"))
    other = offsets.select(*[F.col(c).alias(f"_{c}") for c in (*group, "_part")], "_before", "held")
    same = F.col("_part") == F.col("__part")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_{g}"))
    out = numbered.join(other, same).withColumn("place", F.col("_before") + F.col("_inside"))
    groups = offsets.groupBy(*group).agg(F.max("held").alias("held"))
    return out.select(*rows.columns, "place", "held"), groups
