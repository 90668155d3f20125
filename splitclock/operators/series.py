"""Ordered computations that stay bounded per task when one key is hot.

A plain ``W.partitionBy(key)`` puts every row of a key into one task. With a third of all rows under one key that
task never ends. The helpers here cut a key's series into blocks, work inside the blocks, and carry small per-block
totals across:

* ``with_position``   exact row number inside a key, from row numbers inside blocks plus block offsets;
* ``in_chunks``       equal-sized chunks of a positioned series, with a halo of neighbouring rows so that frames such
                      as "previous 15 rows" or "one point before and after" are complete;
* ``carry_before``    totals of all earlier chunks of a key, for frames that reach back to the start;
* ``group_stats``     unordered statistics of a group as aggregate plus join, where the aggregate is combined on the
                      map side and adaptive execution splits a skewed join;
* ``exact_quantiles`` percentiles with linear interpolation, from positions in value buckets.

Keys must not be NULL. Block columns must be non-decreasing along the order.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from splitclock.session import stored

CHUNK = 4096
#: Fine value buckets per octave: neighbours differ by about 3e-7 of their value.
FINE = 1 << 21
#: Rows of a table that may be sent to every task.
SENT = 100_000


def group_stats(df: DataFrame, keys: Sequence[str], aggs: Mapping[str, Column], where: Column | None = None, base: DataFrame | None = None, write: bool = False) -> DataFrame:
    """Add group statistics to every row; ``where`` limits the rows that count, not the rows that stay. ``base`` holds
    the same rows before columns were added, to aggregate from. With ``write`` the statistics are written first: their size is known
    when the join is planned, so that rows are not shuffled to a few groups."""
    source = base if base is not None else df
    source = source.where(where) if where is not None else source
    stats = source.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()])
    return df.join(stored(stats) if write else stats, list(keys), "left" if where is not None else "inner")


def block_offsets(df: DataFrame, keys: Sequence[str], block: Sequence[str], aggs: Mapping[str, Column] | None = None) -> DataFrame:
    """One row per (keys, block): rows before the block, and each aggregate's total before the block."""
    named = {"_rows": F.count(F.lit(1)), **(aggs or {})}
    totals = df.groupBy(*keys, *block).agg(*[c.alias(n) for n, c in named.items()])
    before = W.partitionBy(*keys).orderBy(*block).rowsBetween(W.unboundedPreceding, -1)
    out = totals.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
    for n in aggs or {}:
        merge = F.min if n.startswith("min_") else F.max if n.startswith("max_") else F.sum
        out = out.withColumn(n, merge(n).over(before))
    return out.drop("_rows")


def with_position(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    block: Sequence[str],
    name: str = "position",
    aggs: Mapping[str, Column] | None = None,
    base: DataFrame | None = None,
) -> DataFrame:
    """Add the 1-based row number of each row inside ``keys`` along ``order``.

    ``base`` holds the same rows before columns were added; offsets are counted there, so that a chain of such steps
    reads its growing input once per step and not twice.
    ``aggs`` adds totals over all earlier blocks (names starting ``min_``/``max_`` combine by minimum/maximum).
    """
    inside = W.partitionBy(*keys, *block).orderBy(*order)
    offsets = block_offsets(df if base is None else base, keys, block, aggs)
    numbered = df.withColumn("_inside", F.row_number().over(inside))
    joined = numbered.join(offsets, [*keys, *block])
    return joined.withColumn(name, (F.col("_before") + F.col("_inside")).cast("bigint")).drop("_before", "_inside")


def in_chunks(df: DataFrame, keys: Sequence[str], position: str, before: int = 0, after: int = 0, size: int = CHUNK) -> DataFrame:
    """Copy rows into chunks of ``size`` positions; rows near an edge also go to the neighbour as halo.

    Adds ``_chunk`` and ``_core`` (the row belongs to this chunk). Window by ``(*keys, _chunk)``, then keep
    ``_core`` rows with ``core``.
    """
    if max(before, after) > size:
        raise ValueError("a chunk must be at least as long as its halo")
    zero_based = F.col(position) - 1
    own = F.floor(zero_based / size).cast("bigint")
    inside = zero_based % size
    targets = F.array_compact(
        F.array(
            own,
            F.when(inside >= size - before, own + 1) if before else F.lit(None).cast("bigint"),
            F.when((inside < after) & (own > 0), own - 1) if after else F.lit(None).cast("bigint"),
        )
    )
    return df.withColumn("_own", own).withColumn("_chunk", F.explode(targets)).withColumn("_core", F.col("_chunk") == F.col("_own")).drop("_own")


def core(df: DataFrame) -> DataFrame:
    return df.where("_core").drop("_chunk", "_core")


def chunk_window(keys: Sequence[str], *order: Column | str):
    return W.partitionBy(*keys, "_chunk").orderBy(*order)


def carry_before(df: DataFrame, keys: Sequence[str], position: str, aggs: Mapping[str, Column], size: int = CHUNK) -> DataFrame:
    """Join onto every row the totals over all earlier chunks of its key (NULL in the first chunk)."""
    chunked = df.withColumn("_block", F.floor((F.col(position) - 1) / size).cast("bigint"))
    return chunked.join(block_offsets(chunked, keys, ["_block"], aggs).drop("_before"), [*keys, "_block"])


def running_sum(df: DataFrame, keys: Sequence[str], position: str, value: Column, name: str, size: int = CHUNK) -> DataFrame:
    """Inclusive running sum along ``position``."""
    valued = df.withColumn("_v", value)
    carried = carry_before(valued, keys, position, {"_carry": F.sum("_v")}, size)
    inside = W.partitionBy(*keys, "_block").orderBy(position).rowsBetween(W.unboundedPreceding, 0)
    total = F.coalesce(F.col("_carry"), F.lit(0.0)) + F.coalesce(F.sum("_v").over(inside), F.lit(0.0))
    return carried.withColumn(name, total).drop("_v", "_carry", "_block")


def log_bucket(value: Column, per_octave: int = 512) -> Column:
    """A coarse, order-preserving bucket of a double of any sign and size."""
    scaled = F.floor(F.log2(F.abs(value) * F.lit(2.0**60) + 1.0) * per_octave).cast("int")
    return F.when(value < 0, -scaled - 1).otherwise(scaled)


def beside(small: DataFrame) -> DataFrame:
    """``small``, written and counted, as the side of a join that is sent or hashed. The planner takes a written table for as small as
    its files: rows of few different values would go through the driver, however many they are."""
    small = stored(small)
    return small.hint("broadcast" if small.count() <= SENT else "shuffle_hash")


def values_at(df: DataFrame, keys: Sequence[str], value: str, places: Mapping[str, Column]) -> DataFrame:
    """Per key the values at 1-based places of the sorted values, and their number ``_n``. A place is an expression of ``_n``.

    Values are narrowed down by counts: coarse buckets, then fine ones inside the buckets that hold a wanted place, then
    the distinct values of those. Equal values are one row with a count, so a value that most rows have is no group.
    """
    rows = df.where(F.col(value).isNotNull()).select(*keys, value).withColumn("_bucket", log_bucket(F.col(value)))

    def wanted(before: Column, count: Column) -> Column:
        out = F.lit(False)
        for place in places.values():
            out = out | ((place > before) & (place <= before + count))
        return out

    def up_to(*group: str, order: str):
        return F.coalesce(F.sum("_rows").over(W.partitionBy(*group).orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))

    coarse = rows.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    coarse = coarse.withColumns({"_before": up_to(*keys, order="_bucket"), "_n": F.sum("_rows").over(W.partitionBy(*keys))})
    coarse = coarse.where(wanted(F.col("_before"), F.col("_rows"))).select(*keys, "_bucket", "_before", "_n")
    distinct = rows.join(beside(coarse), [*keys, "_bucket"]).groupBy(*keys, "_bucket", "_before", "_n", value).agg(F.count(F.lit(1)).alias("_rows"))
    distinct = stored(distinct.withColumn("_fine", log_bucket(F.col(value), FINE)))
    fine = distinct.groupBy(*keys, "_bucket", "_before", "_n", "_fine").agg(F.sum("_rows").alias("_rows"))
    fine = fine.withColumn("_start", F.col("_before") + up_to(*keys, "_bucket", order="_fine"))
    fine = fine.where(wanted(F.col("_start"), F.col("_rows"))).select(*keys, "_bucket", "_fine", "_start")
    hits = distinct.join(beside(fine), [*keys, "_bucket", "_fine"])
    hits = hits.withColumn("_at", F.col("_start") + up_to(*keys, "_bucket", "_fine", order=value))
    found = [F.max(F.when((place > F.col("_at")) & (place <= F.col("_at") + F.col("_rows")), F.col(value))).alias(name) for name, place in places.items()]
    return hits.groupBy(*keys).agg(F.max("_n").alias("_n"), *found)


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, quantiles: Mapping[str, float]) -> DataFrame:
    """Percentiles with linear interpolation between the two neighbouring values, per key."""
    places = {}
    for k, q in enumerate(quantiles.values()):
        rank = (F.col("_n") - 1) * F.lit(float(q))
        places |= {f"_low{k}": F.floor(rank) + 1, f"_high{k}": F.ceil(rank) + 1}
    out = []
    for k, (name, q) in enumerate(quantiles.items()):
        rank = (F.col("_n") - 1) * F.lit(float(q))
        out.append((F.col(f"_low{k}") + (F.col(f"_high{k}") - F.col(f"_low{k}")) * (rank - F.floor(rank))).alias(name))
    return values_at(df, keys, value, places).select(*keys, *out)
