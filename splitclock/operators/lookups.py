"""Joins: stage context, driver resolution, key lookups, name matching, nearest stages."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from splitclock.functions.text import (
    build_driver_id,
    normalize_event_name,
    normalize_name_key,
    numeric_prefix,
    similarity,
    word_set,
)
from splitclock.operators.history import first_per_key
from splitclock.operators.series import beside, block_offsets, log_bucket

ACCEPTED_ERROR_PCT = 15.0


def geometry_fields(results: DataFrame, geometry: DataFrame, key: str = "stage_id") -> DataFrame:
    """Geometry columns that the results do not have themselves, plus the join key."""
    return geometry.select(key, *[c for c in geometry.columns if c != key and c not in results.columns])


def results_left_geometry(results: DataFrame, geometry: DataFrame) -> DataFrame:
    return results.join(geometry_fields(results, geometry), "stage_id", "left")


def results_inner_geometry(results: DataFrame, geometry: DataFrame) -> DataFrame:
    """Only stages whose geometry has hairpin data."""
    return results.join(geometry_fields(results, geometry.where(F.col("hairpin_density").isNotNull())), "stage_id")


def stage_key_match(left: DataFrame, right: DataFrame) -> DataFrame:
    """Match on the stage id, and where that finds nothing on (rally, number). Two equi joins in place of an OR."""
    fields = [c for c in right.columns if c not in ("stage_id", "rally_id", "stage_number")]
    by_id = right.select("stage_id", F.struct(*fields).alias("_by_id"))
    by_number = first_per_key(right.select("rally_id", "stage_number", *fields), ["rally_id", "stage_number"], fields)
    by_number = by_number.select("rally_id", "stage_number", F.struct(*fields).alias("_by_number"))
    joined = left.join(by_id, "stage_id", "left").join(by_number, ["rally_id", "stage_number"], "left")
    hit = F.coalesce("_by_id", "_by_number")
    return joined.where(hit.isNotNull()).select(*left.columns, *[hit[f].alias(f) for f in fields])


def effective_surface(override: Column, own: Column, rally: Column, incoming: Column) -> Column:
    """A stage's own surface where it overrides, else the rally's, else what came in (lower case)."""
    return F.coalesce(
        F.when(override == 1, own), F.nullif(rally, F.lit("")), F.nullif(F.lower(F.trim(incoming)), F.lit(""))
    )


def stage_context(requests: DataFrame, stages: DataFrame, rallies: DataFrame, geometry: DataFrame) -> DataFrame:
    """Everything known of the requested stages: surface, length and the state of the geometry.

    ``requests``: stage_id, rally_id, stage_number and optionally surface, stage_length_km.
    """
    have = set(requests.columns)
    asked_surface = F.col("q.surface") if "surface" in have else F.lit(None).cast("string")
    asked_km = F.col("q.stage_length_km") if "stage_length_km" in have else F.lit(None).cast("double")
    active = geometry.where(F.coalesce("is_active", F.lit(1)) == 1) if "is_active" in geometry.columns else geometry
    joined = (
        requests.alias("q")
        .join(stages.alias("s"), F.col("q.stage_id") == F.col("s.stage_id"), "left")
        .join(rallies.alias("r"), F.col("s.rally_id") == F.col("r.rally_id"), "left")
        .join(active.alias("g"), F.col("s.stage_id") == F.col("g.stage_id"), "left")
    )
    known = F.coalesce(F.when(F.col("s.surface_override") == 1, F.col("s.surface")), F.col("r.surface"), F.col("g.surface"))
    length = F.coalesce(
        F.nullif(F.col("s.length_km"), F.lit(0.0)), F.nullif(F.col("g.distance_km"), F.lit(0.0)), F.nullif(asked_km, F.lit(0.0)), F.lit(15.0)
    )
    extra = [F.col(f"q.{c}") for c in requests.columns if c not in ("stage_id", "rally_id", "stage_number", "surface", "stage_length_km", "stage_name")]
    return joined.select(
        *extra,
        F.col("q.stage_id"),
        F.col("q.rally_id"),
        F.coalesce("s.stage_number", "q.stage_number").alias("stage_number"),
        F.coalesce("s.stage_name", "q.stage_id").alias("stage_name"),
        F.coalesce(asked_surface, known, F.lit("gravel")).alias("surface"),
        length.alias("stage_length_km"),
        F.col("g.elevation_status"),
        F.col("g.geometry_status"),
        *[F.col(f"g.{c}") for c in geometry.columns if c in GEOMETRY_INPUTS],
    )


GEOMETRY_INPUTS = (
    "distance_km", "hairpin_count", "hairpin_density", "turn_count", "turn_density", "total_ascent", "total_descent",
    "elevation_gain", "max_grade", "avg_abs_grade", "avg_curvature", "max_curvature", "p95_curvature",
    "curvature_density", "straight_percentage", "curvy_percentage",
)


def driver_classes(results: DataFrame) -> DataFrame:
    """The class a driver is listed with: the largest name among the driver's results."""
    return results.groupBy("driver_id").agg(
        F.max("car_class").alias("car_class"), F.coalesce(F.max("normalized_class"), F.max("car_class")).alias("normalized_class")
    )


def drivers_with_results(drivers: DataFrame, results: DataFrame) -> DataFrame:
    """Drivers with at least one timed result, with their class; one row per display name."""
    timed = driver_classes(results.where(F.col("time_seconds") > 0))
    joined = drivers.select("driver_id", "display_name").join(timed, "driver_id")
    return first_per_key(joined, ["display_name"], ["driver_id"])


def resolve_driver(requests: DataFrame, drivers: DataFrame, aliases: DataFrame, results: DataFrame | None = None) -> DataFrame:
    """Find the driver of each request by id, then by exact name or alias, then by name key; else make an id.

    ``requests``: any columns with driver_id and driver_name, either may be NULL. The lookup tables are reduced to
    one row per key first (primary alias before others, then display name), so no join multiplies rows.
    """
    known = drivers.select("driver_id", "display_name", "normalized_name_key")
    names = known.select("driver_id", "display_name", F.col("display_name").alias("name"), F.lit(0).alias("rank")).unionByName(
        aliases.join(known, "driver_id").select(
            "driver_id", "display_name", F.col("alias_name").alias("name"), F.when(F.col("is_primary") == 1, 0).otherwise(1).alias("rank")
        )
    )
    keys = known.select("driver_id", "display_name", F.col("normalized_name_key").alias("key"))
    by_name = first_per_key(names, ["name"], ["rank", "display_name", "driver_id"]).select(
        F.col("name").alias("_n"), F.struct("driver_id", "display_name").alias("_by_name")
    )
    by_key = first_per_key(keys, ["key"], ["display_name", "driver_id"]).select(F.col("key").alias("_k"), F.struct("driver_id", "display_name").alias("_by_key"))
    by_id = known.select(F.col("driver_id").alias("_i"), F.struct("driver_id", "display_name").alias("_by_id"))
    r = requests.withColumn("_key", normalize_name_key(F.col("driver_name")))
    joined = (
        r.join(by_id, F.col("driver_id") == F.col("_i"), "left")
        .join(by_name, F.col("driver_name") == F.col("_n"), "left")
        .join(by_key, F.col("_key") == F.col("_k"), "left")
    )
    hit = F.coalesce("_by_id", "_by_name", "_by_key")
    shown = F.coalesce("driver_name", "driver_id", F.lit("Unknown Driver"))
    keep = [c for c in requests.columns if c not in ("driver_id", "driver_name")]
    out = joined.select(
        *keep,
        F.coalesce(hit["driver_id"], "driver_id", build_driver_id(shown)).alias("driver_id"),
        F.coalesce(hit["display_name"], shown).alias("driver_name"),
        hit.isNotNull().alias("resolved"),
    )
    if results is not None:
        mine = [c for c in ("car_class", "normalized_class") if c not in out.columns]
        out = out.join(driver_classes(results).select("driver_id", *mine), "driver_id", "left")
    return out


def candidate_key_lookup(requests: DataFrame, lookup: DataFrame, candidates: Column, key: str, request_id: str) -> DataFrame:
    """Try each request's candidate keys in order; the first that exists wins. Requests without a hit drop out."""
    tries = requests.select(request_id, F.posexplode(candidates).alias("_pos", key))
    hits = tries.join(lookup, key)
    fields = [c for c in hits.columns if c not in (request_id, "_pos")]
    return hits.groupBy(request_id).agg(F.min_by(F.struct(*fields), "_pos").alias("_hit")).select(request_id, "_hit.*")


def history_reference_pace(requests: DataFrame, results: DataFrame, tolerance: float = 0.15) -> DataFrame:
    """Leader pace on stages of like class, surface and length (within ``tolerance``), with fixed-speed fallback.

    The lengths of a (class, surface) are sorted once, and a request is two places in that order: running totals at its longest
    length less those before its shortest give sum and count. So do the different stages: those that begin by the longest length,
    less those that end before the shortest, less those that have lengths on both sides of the span and none inside. The work
    follows the lengths and the requests, not their pairs; totals are decimals, so that differences are exact.
    """
    timed = results.where((F.col("stage_length_km") > 0) & F.col("time_seconds").isNotNull() & F.col("car_class").isNotNull() & F.col("surface").isNotNull())
    best = timed.where("time_seconds > 0").groupBy("stage_id", "car_class").agg(F.min("time_seconds").alias("_best"))
    lengths = timed.groupBy("stage_id", "car_class", "surface", F.col("stage_length_km").alias("_x")).agg(F.count(F.lit(1)).alias("_n"))
    pace = lengths.join(best, ["stage_id", "car_class"]).withColumn("_sum", (F.col("_best") / F.col("_x") * F.col("_n")).cast("decimal(28,9)"))
    of_stage = W.partitionBy("stage_id", "car_class", "surface").orderBy("_x")
    pace = pace.withColumns({"_next": F.lead("_x").over(of_stage), "_before": F.lag("_x").over(of_stage)})
    # A gap between two lengths of a stage that can hold a whole span. Spans of equal limits, but for rounding, are no such gaps.
    gap = F.coalesce(F.col("_next") > F.col("_x") * ((1 + tolerance) / (1 - tolerance) * (1 + 1e-12)), F.lit(False))
    marks = {"_first": F.col("_before").isNull(), "_last": F.col("_next").isNull(), "_opens": gap}
    pace = pace.withColumns({n: c.cast("bigint") for n, c in marks.items()})
    totals = ["_sum", "_n", "_first", "_last", "_opens", "_closes"]
    keys = ["car_class", "surface"]
    zero = lambda c: F.lit(0).cast("decimal(28,9)" if c == "_sum" else "bigint").alias(c)
    opened = pace.select(*keys, "_x", *totals[:-1], zero("_closes"))
    closed = pace.where("_opens = 1").select(*keys, F.col("_next").alias("_x"), *[zero(c) for c in totals[:-1]], F.lit(1).cast("bigint").alias("_closes"))
    points = opened.unionAll(closed).groupBy(*keys, "_x").agg(*[F.sum(c).cast("decimal(28,9)" if c == "_sum" else "bigint").alias(c) for c in totals])
    want = requests.select(*keys, "stage_length_km").where("stage_length_km > 0 AND car_class IS NOT NULL AND surface IS NOT NULL").distinct()
    asked = F.array(*[F.struct((F.col("stage_length_km") * (1 + sign * tolerance)).alias("_x"), F.lit(side).alias("_side")) for sign, side in ((-1, 0), (1, 2))])
    asked = want.select(*keys, "stage_length_km", F.explode(asked).alias("a")).select(*keys, "stage_length_km", "a.*", *[zero(c) for c in totals])
    line = points.select(*keys, F.lit(None).cast("double").alias("stage_length_km"), "_x", F.lit(1).alias("_side"), *totals).unionAll(asked)
    # Shortest lengths stand before equal points, longest ones behind them. Blocks along the line bound the windows.
    line = line.withColumn("_block", log_bucket(F.col("_x")))
    carry = block_offsets(line, keys, ["_block"], {f"_c{c}": F.sum(c) for c in totals}).drop("_before")
    inside = W.partitionBy(*keys, "_block").orderBy("_x", "_side").rowsBetween(W.unboundedPreceding, 0)
    line = line.withColumns({f"_i{c}": F.sum(c).over(inside) for c in totals}).where("_side <> 1").join(carry, [*keys, "_block"])
    at = {c: F.col(f"_i{c}") + F.coalesce(f"_c{c}", F.lit(0)) for c in totals}
    low, high = (lambda c, side=side: F.max(F.when(F.col("_side") == side, at[c])) for side in (0, 2))
    count, stages = high("_n") - low("_n"), high("_first") - low("_last") - (low("_opens") - high("_closes"))
    found = line.groupBy(*keys, "stage_length_km").agg((high("_sum") - low("_sum")).cast("double").alias("_total"), count.alias("_count"), stages.alias("stage_count"))
    found = found.select(*keys, "stage_length_km", F.when(F.col("_count") > 0, F.col("_total") / F.col("_count")).alias("seconds_per_km"), "stage_count")
    out = requests.join(found, ["car_class", "surface", "stage_length_km"], "left")
    fallback = 3600.0 / F.when(F.col("surface") == "asphalt", 80.0).otherwise(70.0)
    return out.withColumns(
        {
            "reference_time": F.col("stage_length_km") * F.coalesce("seconds_per_km", fallback),
            "stage_count": F.coalesce("stage_count", F.lit(0).cast("bigint")),
        }
    )


def compare_predictions(log: DataFrame, actuals: DataFrame, accepted_pct: float = ACCEPTED_ERROR_PCT) -> DataFrame:
    """Close pending predictions: matched with error and verdict, or actual_missing. Other rows pass unchanged.

    ``actuals``: rally_id, stage_id, driver_id, time_seconds and optionally ``seq``; the last positive time of a
    driver counts.
    """
    seq = F.col("seq") if "seq" in actuals.columns else F.lit(0)
    last = (
        actuals.where(F.col("time_seconds") > 0)
        .groupBy("rally_id", "stage_id", "driver_id")
        .agg(F.max_by("time_seconds", F.struct(seq, "time_seconds")).alias("_actual"))
    )
    joined = log.join(last, ["rally_id", "stage_id", "driver_id"], "left")
    pending = F.col("comparison_status") == "pending"
    hit = pending & F.col("_actual").isNotNull()
    error = F.abs(F.col("predicted_time") - F.col("_actual")) / F.col("_actual") * 100
    old = lambda c: F.col(c) if c in log.columns else F.lit(None)
    return joined.withColumns(
        {
            "actual_time": F.when(hit, F.col("_actual")).otherwise(old("actual_time")),
            "error_pct": F.when(hit, error).otherwise(old("error_pct")),
            "accepted": F.when(hit, (error <= accepted_pct).cast("int")).otherwise(old("accepted")),
            "comparison_status": F.when(hit, "matched").when(pending, "actual_missing").otherwise(F.col("comparison_status")),
        }
    ).drop("_actual")


def log_with_names(log: DataFrame, drivers: DataFrame) -> DataFrame:
    named = log.join(drivers.select("driver_id", "display_name"), "driver_id", "left")
    return named.withColumn("driver_name", F.coalesce("display_name", F.col("driver_id").cast("string"))).drop("display_name")


def optional_filters(df: DataFrame, *, flag: str | None = None, flags: str = "data_quality_flags", **equals) -> DataFrame:
    """Apply only the filters that were given."""
    tests = [F.col(name) == value for name, value in equals.items() if value is not None]
    if flag is not None:
        tests.append(has_flag(F.col(flags), flag))
    return reduce(lambda d, t: d.where(t), tests, df)


def has_flag(flags: Column, flag: str) -> Column:
    """Exact element test; part of a flag's name does not match."""
    return F.coalesce(F.array_contains(flags, flag), F.lit(False))


def name_like(name: Column, parts: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [name.like(f"%{p}%") for p in parts])


def attach_profiles(df: DataFrame, profiles: DataFrame) -> DataFrame:
    """Driver geometry profile columns; 1.0 for an unknown factor, 0.0 for the confidence of an absent profile."""
    from splitclock.functions.scoring import confidence_numeric

    cols = {
        "driver_hairpin_perf": "hairpin_performance",
        "driver_climb_perf": "climb_performance",
        "driver_curvature_sens": "curvature_sensitivity",
        "driver_grade_perf": "grade_performance",
    }
    p = profiles.select(
        "driver_id",
        *[F.nullif(F.col(src), F.lit(0.0)).alias(name) for name, src in cols.items()],
        confidence_numeric(F.col("confidence")).alias("driver_profile_confidence"),
    )
    out = df.join(p, "driver_id", "left")
    out = out.withColumns({name: F.coalesce(name, F.lit(1.0)) for name in cols})
    return out.withColumn("driver_profile_confidence", F.coalesce("driver_profile_confidence", F.lit(0.0)))


def fuzzy_match_best(files: DataFrame, events: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Best event for each file name.

    ``files``: file_name. ``events``: rally_id, rally_name. A pair without a common word scores half its sequence
    ratio, which is below 0.5 unless the names are equal, so for thresholds of 0.5 and more only pairs that share a
    word are scored: an equi join on words replaces the all-pairs product. Distinct normalised names are scored once.
    """
    if threshold < 0.5:
        raise ValueError("pairs without a common word are only ruled out from a threshold of 0.5 on")
    f = files.withColumn("_f", normalize_event_name(F.regexp_replace("file_name", r"\.[^.]*$", "")))
    e = events.withColumn("_e", normalize_event_name(F.coalesce("rally_name", "rally_id")))
    pairs = _word_pairs(f.select("_f").distinct(), e.select("_e").distinct())
    scored = pairs.withColumn("confidence", similarity(F.col("_f"), F.col("_e"))).where(F.col("confidence") >= threshold)
    best_event = e.groupBy("_e").agg(F.max(F.struct(numeric_prefix(F.col("rally_id")).alias("n"), "rally_id", "rally_name")).alias("_event"))
    best = (
        scored.join(best_event, "_e")
        .groupBy("_f")
        .agg(F.max(F.struct(F.col("confidence").alias("score"), "_event.n", "_event.rally_id", "_event.rally_name")).alias("_b"))
    )
    out = f.join(best, "_f", "left")
    score = F.col("_b.score")
    kind = F.when(F.col("_b").isNull(), "none").when(score > 0.9, "exact").otherwise("fuzzy")
    return out.select("file_name", F.col("_b.rally_id").alias("rally_id"), F.col("_b.rally_name").alias("rally_name"), score.alias("confidence"), kind.alias("match_type"))


def _word_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    lw = left.select("_f", F.explode(word_set(F.col("_f"))).alias("_w"))
    rw = right.select("_e", F.explode(word_set(F.col("_e"))).alias("_w"))
    return lw.join(rw, "_w").select("_f", "_e").distinct()


def fuzzy_match_stage(routes: DataFrame, stages: DataFrame, threshold: float = 0.45) -> DataFrame:
    """Best stage of the same rally for each route file.

    ``routes``: file_name, rally_id, route_name, distance_km, route_number (may be NULL). A single stage with the
    right number wins outright; several of them are the only candidates; else all stages of the rally are. Score is
    0.7 name + 0.3 distance, the name part raised by 0.25 for an equal number. Pairs stay inside one rally.
    """
    s = stages.select("rally_id", "stage_id", "stage_name", "stage_number", "stage_length_km")
    pairs = routes.join(s, "rally_id")
    same = F.coalesce(F.col("route_number") == F.col("stage_number"), F.lit(False))
    hits = pairs.groupBy("file_name", "rally_id").agg(F.count_if(same).alias("_hits"))
    pairs = pairs.join(hits, ["file_name", "rally_id"]).where((F.col("_hits") == 0) | same)
    stem = F.regexp_replace("file_name", r"\.[^.]*$", "")
    target = normalize_event_name(F.col("stage_name"))
    name_score = F.greatest(similarity(normalize_event_name(F.coalesce("route_name", stem)), target), similarity(normalize_event_name(stem), target))
    name_score = F.when(same, F.least(F.lit(1.0), name_score + 0.25)).otherwise(name_score)
    longest = F.greatest(F.col("stage_length_km"), F.col("distance_km"), F.lit(1.0))
    distance = F.greatest(F.lit(0.0), 1.0 - F.abs(F.col("stage_length_km") - F.col("distance_km")) / longest)
    usable = (F.col("stage_length_km") > 0) & (F.col("distance_km") > 0)
    score = F.when(usable, name_score * 0.7 + distance * 0.3).otherwise(name_score)
    sure = same & (F.col("_hits") == 1)
    scored = pairs.withColumn("_score", score).where(sure | (F.col("_score") >= threshold))
    best = F.min(F.struct((-F.col("_score")).alias("s"), "stage_number", "stage_id"))
    return scored.groupBy("file_name", "rally_id").agg(best.alias("_b")).select("file_name", "rally_id", F.col("_b.stage_id").alias("stage_id"), (-F.col("_b.s")).alias("score"))


def suggest_stage_mapping(routes: DataFrame, stages: DataFrame) -> DataFrame:
    """Best stage by name alone for each route, whatever the score."""
    pairs = routes.join(stages.select("rally_id", "stage_id", "stage_name", "stage_number"), "rally_id")
    score = similarity(normalize_event_name(F.col("route_name")), normalize_event_name(F.col("stage_name")))
    best = F.min(F.struct((-F.col("_s")).alias("s"), "stage_number", "stage_id"))
    out = pairs.withColumn("_s", score).where("_s > 0").groupBy("file_name", "rally_id").agg(best.alias("_b"))
    return out.select("file_name", "rally_id", F.col("_b.stage_id").alias("stage_id"), (-F.col("_b.s")).alias("confidence"))


def contains_match(left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct pairs of names of which one contains the other (case ignored).

    If ``y`` lies inside ``x``, every three-letter piece of ``y`` does too. Each shorter name is looked up by the one
    of its pieces that is rarest among the other side's names, so a common piece never decides the join.
    """
    la, lb = left.select(a).distinct(), right.select(b).distinct()
    one = _contained(la, a, lb, b).select(a, b)
    two = _contained(lb, b, la, a).select(a, b)
    return one.unionByName(two).distinct()


def _pieces(text: Column, n: int) -> Column:
    count = F.greatest(F.length(text) - n + 1, F.lit(0))
    starts = F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substr(text, i, F.lit(n))))


def _contained(outer: DataFrame, o: str, inner: DataFrame, i: str) -> DataFrame:
    """Pairs where the inner name lies inside the outer one."""
    ot, it = F.lower(F.col(o)), F.lower(F.col(i))
    out_pieces = outer.select(o, F.explode(F.concat(_pieces(ot, 1), _pieces(ot, 2), _pieces(ot, 3))).alias("_p"))
    freq = out_pieces.groupBy("_p").agg(F.count(F.lit(1)).alias("_c"))
    length = F.length(it)
    own = F.when(length >= 3, _pieces(it, 3)).when(length == 2, _pieces(it, 2)).otherwise(_pieces(it, 1))
    in_pieces = inner.where(length > 0).select(i, F.explode(own).alias("_p"))
    # A piece missing on the outer side means no match at all, so it may drop out here.
    rarest = in_pieces.join(freq, "_p", "left").groupBy(i).agg(F.min_by("_p", F.coalesce("_c", F.lit(0))).alias("_p"))
    return out_pieces.join(rarest, "_p").where(ot.contains(it)).select(o, i)


def elevation_grid_join(samples: DataFrame, elevations: DataFrame) -> DataFrame:
    """Elevations by six-decimal position key; NULL where the grid has none."""
    key = F.format_string("%.6f,%.6f", F.col("lat"), F.col("lon"))
    grid = beside(elevations.select("grid_key", "elevation"))
    return samples.withColumn("grid_key", key).join(grid, "grid_key", "left")


def stage_route_map(stages: DataFrame, mapping: DataFrame) -> DataFrame:
    """One route may serve several stages (repeat passes): a many-to-one left join through the mapping."""
    return stages.join(mapping, ["rally_id", "stage_number"], "left")


def similar_stages(geometry: DataFrame, k: int = 10, cell: int = 1024) -> DataFrame:
    """The ``k`` nearest other stages by |hairpins per km| + |km|/10 + |ascent|/100 differences, ties by id (`nearest.nearest`)."""
    from splitclock.operators.nearest import nearest

    dims = [F.col("hairpin_density"), F.col("distance_km") / 10, F.col("total_ascent") / 100]
    found = nearest(geometry.select(F.col("stage_id").alias("id"), *[c.alias(n) for c, n in zip(dims, ("x", "y", "z"))]), k, cell)
    return found.select(F.col("id").alias("stage_id"), F.col("other").alias("similar_id"), F.col("distance").alias("similarity_score"), "rank")
