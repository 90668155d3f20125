"""Connected components of a graph held as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splitclock.llm.common import written


def _stars(links: DataFrame) -> DataFrame:
    """One round: every node's larger neighbours, then every node's smaller neighbours, are linked to the smallest one.

    Only minima are aggregated and joined back; a node with very many neighbours is a skewed join, not a group.
    """
    both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    down = large.groupBy("a").agg(F.min("b").alias("m"))
    moved = large.join(down, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(down.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """``links`` (a, b long): undirected. Returns one row (id, component) per node that a link names; the component is
    the smallest node reachable. NULLs and self links are ignored; no links give no rows."""
    state = written(
        links.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").cast("bigint").alias("a"), F.least("a", "b").cast("bigint").alias("b"))
        .distinct(),
        "links",
    )
    sign = None
    for _ in range(rounds):
        mark = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % 1_000_003)).first()
        if mark == sign or not mark[0]:
            break
        sign = mark
        state = written(_stars(state), "links")
    else:
        raise RuntimeError(f"the components are not stable after {rounds} rounds")
    return state.select(F.col("a").alias("id"), F.col("b").alias("component")).unionAll(
        state.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    )
