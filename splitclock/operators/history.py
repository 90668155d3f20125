"""Leak-free driver history: every value comes from rows before the current one.

A driver enters a stage of a rally once, so a (driver, rally) group is as long as the rally has stages. That is the
block of all series here; a driver's whole career is never one task's work.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from splitclock.functions.scoring import (
    NOT_STARTED,
    TREND_DOWN,
    TREND_FLAT,
    TREND_UNKNOWN,
    TREND_UP,
    momentum_factor,
    momentum_status,
)
from splitclock.functions.text import numeric_prefix
from splitclock.operators.series import (
    CHUNK,
    block_offsets,
    chunk_window,
    core,
    exact_quantiles,
    group_stats,
    in_chunks,
    log_bucket,
    running_sum,
    with_position,
)
from splitclock.session import discard, stored

DRIVER = ("driver_id",)
#: All that the history of a row is computed from.
SERIES = ["driver_id", "surface", "rally_date", "rally_id", "stage_number", "result_id", "stage_length_km", "ratio_to_class_best"]
RALLY_ORDER = ("rally_date", "rally_id")


def _stage_order(block: Sequence[str]) -> list[str]:
    return [*block, "stage_number", "result_id"]


def positioned(df: DataFrame, keys: Sequence[str] = DRIVER, block: Sequence[str] = RALLY_ORDER, name: str = "position", aggs=None, base: DataFrame | None = None) -> DataFrame:
    return with_position(df, keys, _stage_order(block), block, name, aggs, base)


def _positioned_by(place: str, df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """`positioned` where ``place`` holds the position in the driver's series: it orders the rows of any key that has the driver."""
    blocked = df.withColumn("_block", F.floor((F.col(place) - 1) / CHUNK))
    return with_position(blocked, keys, [place], ["_block"], name).drop("_block")


def history_overall(df: DataFrame, lookback: int = 15, block: Sequence[str] = RALLY_ORDER, size: int = CHUNK, base: DataFrame | None = None, place: str | None = None) -> DataFrame:
    """Rookie flag, stages so far, best so far, mean and sample deviation of the last ``lookback`` earlier rows, and
    momentum (mean of the five before the last five, minus the last five; 0 under ten rows). ``place`` is the column that holds the
    position, if an earlier step has numbered the rows."""
    r = F.col("ratio_to_class_best")
    w = chunk_window(DRIVER, "position")
    if place:
        # Both the join and the windows are by driver and chunk: rows are shuffled once.
        before = (df if base is None else base).withColumn("_chunk", F.floor((F.col(place) - 1) / size).cast("bigint"))
        chunked = in_chunks(df.withColumn("position", F.col(place)), DRIVER, "position", before=lookback, size=size)
        chunked = chunked.join(block_offsets(before, DRIVER, ["_chunk"], {"min_before": F.min(r)}).drop("_before"), [*DRIVER, "_chunk"])
        best = F.least(F.col("min_before"), F.min(r).over(w.rowsBetween(W.unboundedPreceding, -1)))
        chunked = chunked.withColumn("driver_best_ratio_season", best).drop("min_before")
    else:
        placed = positioned(df, block=block, aggs={"min_before": F.min(r)}, base=base)
        in_rally = W.partitionBy("driver_id", *block).orderBy(*_stage_order(block)).rowsBetween(W.unboundedPreceding, -1)
        best = F.least(F.col("min_before"), F.min(r).over(in_rally))
        chunked = in_chunks(placed.withColumn("driver_best_ratio_season", best).drop("min_before"), DRIVER, "position", before=lookback, size=size)
    done = F.col("position") - 1
    trend = F.avg(r).over(w.rowsBetween(-10, -6)) - F.avg(r).over(w.rowsBetween(-5, -1))
    return core(
        chunked.withColumns(
            {
                "driver_stages_completed": done,
                "is_rookie": done == 0,
                "driver_mean_ratio_overall": F.avg(r).over(w.rowsBetween(-lookback, -1)),
                "driver_std_ratio_surface": F.stddev_samp(r).over(w.rowsBetween(-lookback, -1)),
                "driver_momentum": F.when(done >= 10, trend).when(done > 0, 0.0),
            }
        )
    ).drop("position")


def history_surface(df: DataFrame, lookback: int = 15, block: Sequence[str] = RALLY_ORDER, size: int = CHUNK, base: DataFrame | None = None, place: str | None = None) -> DataFrame:
    """Mean of the last ``lookback`` earlier rows on the same surface (NULL when there is none)."""
    keys = ("driver_id", "surface")
    placed = _positioned_by(place, df, keys, "position") if place else positioned(df, keys, block, base=base)
    chunked = in_chunks(placed, keys, "position", before=lookback, size=size)
    w = chunk_window(keys, "position").rowsBetween(-lookback, -1)
    return core(chunked.withColumn("driver_mean_ratio_surface", F.avg("ratio_to_class_best").over(w))).drop("position")


def history_rally(df: DataFrame, block: Sequence[str] = RALLY_ORDER) -> DataFrame:
    """Mean of the driver's earlier stages in this rally, and of the last three of them."""
    w = W.partitionBy("driver_id", *block).orderBy(*_stage_order(block))
    r = F.col("ratio_to_class_best")
    return df.withColumns(
        {
            "driver_avg_ratio_this_rally": F.avg(r).over(w.rowsBetween(W.unboundedPreceding, -1)),
            "driver_last3_ratio_same_rally": F.avg(r).over(w.rowsBetween(-3, -1)),
        }
    )


def history_short_stage(
    df: DataFrame, short_km: float = 7.0, last: int = 10, least: int = 3, block: Sequence[str] = RALLY_ORDER, size: int = CHUNK, base: DataFrame | None = None, place: str | None = None
) -> DataFrame:
    """Mean of the last ten earlier short stages (NULL under three).

    The short rows form their own series with its trailing mean; every row looks up the entry of its count of
    earlier short rows, so no list of earlier values is ever built.
    """
    short = F.coalesce(F.col("stage_length_km") < short_km, F.lit(False)).cast("int")
    flagged = df.withColumn("_short", short)
    source = flagged if base is None else base.withColumn("_short", short)
    if place:
        counted = running_sum(flagged, DRIVER, place, F.col("_short"), "_k", size).withColumn("_k", (F.col("_k") - F.col("_short")).cast("bigint"))
        own = _positioned_by(place, source.where("_short = 1"), DRIVER, "_k")
    else:
        counted = positioned(flagged, block=block, aggs={"_short_before": F.sum("_short")}, base=source)
        in_rally = W.partitionBy("driver_id", *block).orderBy(*_stage_order(block)).rowsBetween(W.unboundedPreceding, -1)
        earlier = F.coalesce(F.col("_short_before"), F.lit(0)) + F.coalesce(F.sum("_short").over(in_rally), F.lit(0))
        counted = counted.withColumn("_k", earlier.cast("bigint")).drop("_short_before", "position")
        own = positioned(source.where("_short = 1"), block=block, name="_k")
    chunked = in_chunks(own, DRIVER, "_k", before=last - 1, size=size)
    trailing = F.avg("ratio_to_class_best").over(chunk_window(DRIVER, "_k").rowsBetween(-(last - 1), 0))
    lookup = core(chunked.withColumn("driver_short_stage_ratio", trailing)).where(F.col("_k") >= least).select("driver_id", "_k", "driver_short_stage_ratio")
    return counted.join(lookup, ["driver_id", "_k"], "left").drop("_k", "_short")


def history_features(df: DataFrame, lookback: int = 15, block: Sequence[str] = RALLY_ORDER, place: str | None = None) -> DataFrame:
    """All driver history columns of the feature matrix, with their fallbacks to the overall mean.

    ``place`` names the position in the driver's series of rows that have been numbered and have the columns of `history_rally`: the
    columns of the order need not walk any further. What a step wrote is removed when the next has read it.
    """
    if place:
        on_surface = stored(history_surface(df, lookback, place=place))
        short = stored(history_short_stage(on_surface, base=df, place=place))
        discard(on_surface)
        out = stored(history_overall(short, lookback, base=df, place=place))
        discard(short)
        late = ["driver_mean_ratio_surface", "driver_short_stage_ratio"]
        out = out.select(*[c for c in out.columns if c not in late], *late)
    else:
        out = history_overall(history_rally(df, block), lookback, block, base=df)
        out = history_short_stage(history_surface(out, lookback, block, base=df), block=block, base=df)
    overall = F.col("driver_mean_ratio_overall")
    return out.withColumns(
        {
            "driver_mean_ratio_surface": F.coalesce("driver_mean_ratio_surface", overall),
            "driver_short_stage_ratio": F.coalesce("driver_short_stage_ratio", overall),
        }
    )


def expanding_baseline(df: DataFrame, block: Sequence[str] = ("rally_id",), base: DataFrame | None = None, place: str | None = None) -> DataFrame:
    """Mean of all previous ratios; the driver's overall mean on the first row. ``place`` names a column for the position in the
    driver's series, for steps that follow."""
    r = F.col("ratio_to_class_best")
    source = df if base is None else base
    out = positioned(df, block=block, aggs={"_sum_before": F.sum(r)}, base=source)
    in_rally = W.partitionBy("driver_id", *block).orderBy(*_stage_order(block)).rowsBetween(W.unboundedPreceding, -1)
    earlier = F.coalesce(F.col("_sum_before"), F.lit(0.0)) + F.coalesce(F.sum(r).over(in_rally), F.lit(0.0))
    out = group_stats(out.withColumn("_earlier", earlier), DRIVER, {"_mean": F.avg(r)}, base=source)
    value = F.when(F.col("position") > 1, F.col("_earlier") / (F.col("position") - 1)).otherwise(F.col("_mean"))
    out = out.withColumn("baseline_ratio", value).drop("_sum_before", "_earlier", "_mean")
    return out.withColumnRenamed("position", place) if place else out.drop("position")


def rolling_baseline(df: DataFrame, window: int = 15, block: Sequence[str] = RALLY_ORDER, size: int = CHUNK, base: DataFrame | None = None, place: str | None = None) -> DataFrame:
    """Mean of the previous ``window`` ratios; the mean over all rows where there is no previous row. ``place`` is the column that
    holds the position, if an earlier step has numbered the rows."""
    placed = df.withColumn("position", F.col(place)) if place else positioned(df, block=block, base=base)
    chunked = in_chunks(placed, DRIVER, "position", before=window, size=size)
    w = chunk_window(DRIVER, "position").rowsBetween(-window, -1)
    rolled = core(chunked.withColumn("_rolled", F.avg("ratio_to_class_best").over(w)))
    overall = (df if base is None else base).agg(F.avg("ratio_to_class_best")).scalar()
    return rolled.withColumn("baseline_ratio", F.coalesce("_rolled", overall)).drop("_rolled", "position")


def rolling_momentum(df: DataFrame, block: Sequence[str] = RALLY_ORDER, size: int = CHUNK, base: DataFrame | None = None) -> DataFrame:
    """Mean of the last three rows including this one, over the mean of the six rows ending three back; plus the
    running stage count, which is taken as it is where the rows have it."""
    placed = df if "driver_stage_count" in df.columns else positioned(df, block=block, name="driver_stage_count", base=base)
    chunked = in_chunks(placed, DRIVER, "driver_stage_count", before=8, size=size)
    w = chunk_window(DRIVER, "driver_stage_count")
    recent = F.avg("ratio_to_class_best").over(w.rowsBetween(-2, 0))
    older = F.avg("ratio_to_class_best").over(w.rowsBetween(-8, -3))
    return core(chunked.withColumn("momentum_factor", F.coalesce(recent / F.when(older == 0, 1.0).otherwise(older), F.lit(1.0))))


def driver_stage_count(df: DataFrame, block: Sequence[str] = RALLY_ORDER) -> DataFrame:
    return positioned(df, block=block, name="driver_stage_count")


def driver_means(df: DataFrame) -> DataFrame:
    """Career mean and career mean on this surface. They include the current row: use them for description, and the
    history columns for training."""
    r = F.col("ratio_to_class_best")
    # One row a driver and surface holds both means, so that the rows meet them in one join.
    per_surface = df.groupBy("driver_id", "surface").agg(F.sum(r).alias("_s"), F.count(r).alias("_c"))
    career = W.partitionBy("driver_id")
    mean = lambda s, c: F.try_divide(s, c)
    means = per_surface.select("driver_id", "surface", mean(F.sum("_s").over(career), F.sum("_c").over(career)).alias("driver_avg_ratio"), mean(F.col("_s"), F.col("_c")).alias("driver_surface_ratio"))
    return df.join(means, ["driver_id", "surface"])


def stage_progress(df: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """Share of the rally's stage range that lies behind a stage. ``base`` holds the same rows before columns were added."""
    s = F.col("stage_number")
    out = group_stats(df, ["rally_id"], {"_lo": F.min(s), "_hi": F.max(s)}, base=base, write=base is not None)
    return out.withColumn("stage_progress", (s - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + 1e-6)).drop("_lo", "_hi")


# Weights of a driver's rallies, newest first; later ones share the last weight.
RALLY_WEIGHTS = [0.40, 0.30, 0.20, 0.10]


def usable_ratios(df: DataFrame) -> DataFrame:
    return df.where((F.col("time_seconds") > 0) & (F.col("ratio_to_class_best") > 0))


def driver_rally_form(df: DataFrame, rallies: int = 5) -> DataFrame:
    """Mean ratio and stage count of each driver's newest rallies (by the number inside the rally id)."""
    per_rally = usable_ratios(df).groupBy("driver_id", "rally_id").agg(
        F.avg("ratio_to_class_best").alias("avg_ratio"), F.count(F.lit(1)).alias("stage_count")
    )
    newest = W.partitionBy("driver_id").orderBy(numeric_prefix(F.col("rally_id")).desc(), F.col("rally_id").desc())
    return per_rally.withColumn("recency", F.row_number().over(newest)).where(F.col("recency") <= rallies)


def recency_weighted_baseline(df: DataFrame, rallies: int = 5) -> DataFrame:
    """Baseline ratio per driver: the newest rallies weighted .4/.3/.2/.1/.1, rescaled to sum to one."""
    weights = F.array(*[F.lit(w) for w in RALLY_WEIGHTS])
    w = F.element_at(weights, F.least(F.col("recency"), F.lit(len(RALLY_WEIGHTS))))
    return (
        driver_rally_form(df, rallies)
        .groupBy("driver_id")
        .agg(
            (F.sum(w * F.col("avg_ratio")) / F.sum(w)).alias("baseline_ratio"),
            F.count(F.lit(1)).alias("data_points"),
            F.sum("stage_count").alias("total_stages"),
            F.max(F.when(F.col("recency") == 1, F.col("avg_ratio"))).alias("recent_rally_avg"),
            F.avg("avg_ratio").alias("all_avg"),
        )
    )


def rally_momentum(df: DataFrame, baseline: str = "baseline_ratio") -> DataFrame:
    """Form in the running rally before each stage, against the driver's baseline (a column of ``df``)."""
    w = W.partitionBy("driver_id", "rally_id").orderBy("stage_number", "result_id").rowsBetween(W.unboundedPreceding, -1)
    out = df.withColumns(
        {"stages_analyzed": F.count("ratio_to_class_best").over(w), "rally_avg": F.avg("ratio_to_class_best").over(w)}
    )
    return momentum_columns(out, baseline)


def momentum_columns(df: DataFrame, baseline: str = "baseline_ratio") -> DataFrame:
    """Momentum, factor and status from ``rally_avg`` and a baseline column."""
    b = F.col(baseline)
    momentum = F.when(F.col("rally_avg").isNotNull() & (b > 0), (b - F.col("rally_avg")) / b).otherwise(0.0)
    return df.withColumn("momentum", momentum).withColumns(
        {
            "momentum_factor": momentum_factor(F.col("momentum")),
            "momentum_status": F.when(F.col("rally_avg").isNull(), NOT_STARTED).otherwise(momentum_status(F.col("momentum"))),
        }
    )


def latest_rally_momentum(df: DataFrame, baselines: DataFrame) -> DataFrame:
    """Momentum of each driver over the newest rally driven, for requests outside a running rally."""
    per_rally = driver_rally_form(df, 1).select("driver_id", F.col("avg_ratio").alias("rally_avg"), F.col("stage_count").alias("stages_analyzed"))
    return momentum_columns(per_rally.join(baselines.select("driver_id", "baseline_ratio"), "driver_id"))


def live_momentum(live: DataFrame, baselines: DataFrame) -> DataFrame:
    """Momentum per (driver, rally) from raw live rows: class leader, ratio, mean and the class-position trend."""
    from splitclock.operators.facts import class_position, ratio_to_class_best

    placed = class_position(ratio_to_class_best(live))
    trend = position_trend(placed)
    form = placed.groupBy("driver_id", "rally_id").agg(
        F.avg("ratio_to_class_best").alias("rally_avg"), F.count(F.lit(1)).alias("stages_analyzed")
    )
    joined = form.join(trend, ["driver_id", "rally_id"]).join(baselines.select("driver_id", "baseline_ratio"), "driver_id")
    return momentum_columns(joined)


def trend_of(places: Column, first: Column, last: Column) -> Column:
    """Better, worse or the same place at the end of ``places`` stages."""
    return F.when(places < 2, TREND_UNKNOWN).when(last < first, TREND_UP).when(last > first, TREND_DOWN).otherwise(TREND_FLAT)


def position_trend(df: DataFrame) -> DataFrame:
    """Last class position against the first of the last three, per (driver, rally)."""
    newest = W.partitionBy("driver_id", "rally_id").orderBy(F.col("stage_number").desc(), F.col("result_id").desc())
    last3 = df.withColumn("_age", F.row_number().over(newest)).where("_age <= 3")
    pos = F.struct("_age", "class_position")
    ends = last3.groupBy("driver_id", "rally_id").agg(
        F.min(pos)["class_position"].alias("_last"), F.max(pos)["class_position"].alias("_first"), F.count(F.lit(1)).alias("_n")
    )
    return ends.select("driver_id", "rally_id", trend_of(F.col("_n"), F.col("_first"), F.col("_last")).alias("position_trend"))


def last_n_history(df: DataFrame, n: int = 15) -> DataFrame:
    """The newest ``n`` timed rows of each driver, by the number in the rally id, then the stage."""
    newest = W.partitionBy("driver_id").orderBy(
        numeric_prefix(F.col("rally_id")).desc(), F.col("stage_number").desc(), F.col("result_id").desc()
    )
    return df.where(F.col("time_seconds") > 0).withColumn("recency", F.row_number().over(newest)).where(F.col("recency") <= n)


def form_5v5(history: DataFrame) -> DataFrame:
    """Newest five ratios against the five before, per driver; needs ten rows for a verdict."""
    r, age = F.col("ratio_to_class_best"), F.col("recency")
    agg = history.groupBy("driver_id").agg(
        F.count(r).alias("n"),
        F.avg(r).alias("_all"),
        F.avg(F.when(age <= 5, r)).alias("_new"),
        F.avg(F.when((age > 5) & (age <= 10), r)).alias("_old"),
    )
    enough = F.col("n") >= 10
    delta = F.when(enough, (F.col("_old") - F.col("_new")) * 100).otherwise(0.0)
    label = F.when(~enough, "Yetersiz veri").when(delta > 2.0, "Hizlaniyor").when(delta < -2.0, "Yavasliyor").otherwise("Stabil")
    return agg.select(
        "driver_id",
        "n",
        F.when(enough, F.col("_new")).otherwise(F.col("_all")).alias("recent_avg_ratio"),
        F.when(enough, F.col("_old")).otherwise(F.col("_all")).alias("historical_avg_ratio"),
        delta.alias("momentum_delta"),
        label.alias("momentum"),
        F.when(enough & (delta > 2.0), 0.99).when(enough & (delta < -2.0), 1.01).otherwise(1.0).alias("form_factor"),
    )


def carry_last_state(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each row's ``prev_*`` values from the driver's previous stage in the same rally."""
    w = W.partitionBy("driver_id", "rally_id").orderBy("stage_number", "result_id")
    return df.withColumns({f"prev_{c}": F.lag(c).over(w) for c in columns})


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row per key, the first along ``order``. Combined on the map side: a hot key sends one row per task."""
    rest = [c for c in df.columns if c not in keys]
    order_cols = [F.col(o) if isinstance(o, str) else o for o in order]
    picked = F.min_by(F.struct(*rest), F.struct(*order_cols)).alias("_row")
    return df.groupBy(*keys).agg(picked).select(*keys, "_row.*").select(*df.columns)


def value_ranks(counts: DataFrame, keys: Sequence[str], value: str, name: str, rows: str = "_n") -> DataFrame:
    """(keys, value, ``name``): the rank of each value with ties at their mean rank, from counted values; ``rows`` says how many rows
    a line of ``counts`` stands for. Safe for one large group."""
    per_value = counts.groupBy(*keys, value).agg(F.sum(rows).alias("_ties"))
    per_value = per_value.withColumn("_bucket", log_bucket(F.col(value)))
    offsets = block_offsets(per_value, keys, ["_bucket"], {"_below": F.sum("_ties")}).drop("_before")
    inside = W.partitionBy(*keys, "_bucket").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    below = F.coalesce(F.col("_below"), F.lit(0)) + F.coalesce(F.sum("_ties").over(inside), F.lit(0))
    return per_value.join(offsets, [*keys, "_bucket"]).select(*keys, value, (below + (F.col("_ties") + 1) / 2).alias(name))


def average_rank(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Rank with ties at their mean rank, from the running count of distinct values; safe for one large group."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    return df.join(value_ranks(counts, keys, value, name), [*keys, value])


def column_medians(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Medians of several columns in one pass over their values: one row per key with a map column -> median."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in columns]))
    long = df.select(*keys, pairs.alias("_p")).select(*keys, F.col("_p.c").alias("_column"), F.col("_p.v").alias("_value"))
    medians = exact_quantiles(long, [*keys, "_column"], "_value", {"_median": 0.5})
    per_column = [F.max(F.when(F.col("_column") == c, F.col("_median"))).alias(c) for c in columns]
    return medians.groupBy(*keys).agg(F.struct(*per_column).alias("_medians"))


def impute_surface_median(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fill a rookie's missing values with the surface's median."""
    out = df.join(column_medians(df, ["surface"], columns), "surface", "left")
    fill = {c: F.when(F.col("is_rookie"), F.coalesce(c, f"_medians.{c}")).otherwise(F.col(c)) for c in columns}
    return out.withColumns(fill).drop("_medians")


def impute_median(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fill what is still missing with the column's median over all rows."""
    medians = column_medians(df, [], columns).scalar()
    out = df.withColumn("_medians", medians)
    return out.withColumns({c: F.coalesce(c, f"_medians.{c}") for c in columns}).drop("_medians")


def asof_previous_stage(stages: DataFrame) -> DataFrame:
    """For each stage of a rally the latest earlier stage that has results. One row per stage comes in, so a group is
    as long as a rally."""
    w = W.partitionBy("rally_id").orderBy("stage_number").rowsBetween(W.unboundedPreceding, -1)
    held = F.last(F.when(F.col("result_count") > 0, F.col("stage_number")), ignorenulls=True).over(w)
    return stages.withColumn("previous_stage", held)
