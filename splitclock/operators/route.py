"""Route geometry on long point tables: one row per (route_id, seq).

``seq`` is dense, so routes are cut into chunks of consecutive points with a halo of neighbours. Every window runs
inside a chunk; sums over a route are carried from chunk to chunk. A route of any length spreads over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from splitclock.functions.geo import bearing_deg, circumradius, curvature_3pt, haversine_m, hypot, local_x, local_y, turn_angle, utm36_xy, wrap_pi
from splitclock.operators.series import (
    CHUNK,
    chunk_window,
    core,
    exact_quantiles,
    in_chunks,
    running_sum,
    values_at,
    with_position,
)
from splitclock.session import stored

KEY = ["route_id"]


def _count() -> Column:
    return F.count(F.lit(1))


def segments(points: DataFrame, size: int = CHUNK) -> DataFrame:
    """Each point with its distance in metres from the point before (NULL for the first)."""
    c = in_chunks(points, KEY, "seq", before=1, size=size)
    w = chunk_window(KEY, "seq")
    return core(c.withColumn("segment_m", haversine_m(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon"))))


def route_distance(points: DataFrame, size: int = CHUNK) -> DataFrame:
    return segments(points, size).groupBy("route_id").agg((F.coalesce(F.sum("segment_m"), F.lit(0.0)) / 1000).alias("distance_km"))


def known_altitudes(points: DataFrame) -> DataFrame:
    """Points with a known altitude (0 stands for unknown), renumbered so that neighbours pair up again."""
    rows = points.where(F.col("alt") != 0).withColumn("_b", F.floor(F.col("seq") / CHUNK))
    return with_position(rows, KEY, ["seq"], ["_b"], "alt_seq").drop("_b")


def altitude_steps(points: DataFrame, size: int = CHUNK) -> DataFrame:
    c = in_chunks(known_altitudes(points), KEY, "alt_seq", before=1, size=size)
    w = chunk_window(KEY, "alt_seq")
    rise = F.col("alt") - F.lag("alt").over(w)
    run = haversine_m(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon"))
    return core(c.withColumns({"rise_m": rise, "run_m": run}))


def ascent_descent(points: DataFrame, size: int = CHUNK) -> DataFrame:
    """Metres up, metres down and the altitude range over known altitudes."""
    r = F.col("rise_m")
    return altitude_steps(points, size).groupBy("route_id").agg(
        F.coalesce(F.sum(F.when(r > 0, r)), F.lit(0.0)).alias("total_ascent"), F.coalesce(F.sum(F.when(r < 0, -r)), F.lit(0.0)).alias("total_descent"),
        F.min("alt").alias("min_altitude"), F.max("alt").alias("max_altitude"),
    )


def grades_raw(points: DataFrame, size: int = CHUNK) -> DataFrame:
    """Largest, mean and mean absolute grade in percent between known altitudes."""
    grade = F.when(F.col("run_m") > 0, F.col("rise_m") / F.col("run_m") * 100)
    return altitude_steps(points, size).groupBy("route_id").agg(F.max(grade).alias("max_grade"), F.avg(grade).alias("avg_grade"), F.avg(F.abs(grade)).alias("avg_abs_grade"))


def vertices(points: DataFrame, size: int = CHUNK) -> DataFrame:
    """Inner points with the turn angle in degrees and the three-point curvature."""
    c = in_chunks(points, KEY, "seq", before=1, after=1, size=size)
    w = chunk_window(KEY, "seq")
    lat, lon = F.col("lat"), F.col("lon")
    plat, plon, nlat, nlon = F.lag("lat").over(w), F.lag("lon").over(w), F.lead("lat").over(w), F.lead("lon").over(w)
    c = c.withColumns({"_plat": plat, "_plon": plon, "_nlat": nlat, "_nlon": nlon})
    p1, p2, n1, n2 = (F.col(x) for x in ("_plat", "_plon", "_nlat", "_nlon"))
    out = core(c).where(p1.isNotNull() & n1.isNotNull())
    # Bearings and local metres become columns of their own, so that nothing below computes them twice.
    out = out.select(
        "route_id", "seq", bearing_deg(p1, p2, lat, lon).alias("_in"), bearing_deg(lat, lon, n1, n2).alias("_out"),
        local_x(lat, lon, p2).alias("_x1"), local_y(lat, lon, p1).alias("_y1"), local_x(lat, lon, n2).alias("_x3"), local_y(lat, lon, n1).alias("_y3"),
    )
    bend = curvature_3pt(F.col("_x1"), F.col("_y1"), F.col("_x3"), F.col("_y3"))
    return out.select("route_id", "seq", turn_angle(F.col("_in"), F.col("_out")).alias("turn_deg"), bend.alias("curvature"))


def turn_summary(points: DataFrame, hairpin_deg: float = 120.0, turn_deg: float = 45.0, size: int = CHUNK) -> DataFrame:
    a = F.col("turn_deg")
    counts = vertices(points, size).groupBy("route_id").agg(F.count_if(a > hairpin_deg).alias("hairpin_count"), F.count_if(a > turn_deg).alias("turn_count"))
    out = counts.join(route_distance(points, size), KEY)
    per_km = lambda c: F.coalesce(F.try_divide(F.col(c).cast("double"), F.col("distance_km")), F.lit(0.0))
    return out.withColumns({"hairpin_density": per_km("hairpin_count"), "turn_density": per_km("turn_count")})


def curvature_summary(points: DataFrame, high: float = 0.01, straight: float = 0.001, size: int = CHUNK) -> DataFrame:
    v = vertices(points, size)
    k = F.col("curvature")
    stats = v.groupBy("route_id").agg(
        F.avg(k).alias("avg_curvature"), F.max(k).alias("max_curvature"), F.count_if(k > high).alias("_high"),
        (F.count_if(k < straight) * F.lit(100.0) / _count()).alias("straight_percentage"), (F.count_if(k > high) * F.lit(100.0) / _count()).alias("curvy_percentage"),
    )
    out = stats.join(exact_quantiles(v, KEY, "curvature", {"p95_curvature": 0.95}), KEY).join(route_distance(points, size), KEY)
    return out.withColumn("curvature_density", F.coalesce(F.try_divide(F.col("_high").cast("double"), F.col("distance_km")), F.lit(0.0))).drop("_high", "distance_km")


def utm_points(points: DataFrame, long_series: bool = True) -> DataFrame:
    x, y = utm36_xy(F.col("lat"), F.col("lon"), long_series)
    return points.withColumns({"x": x, "y": y})


def resample_path(points: DataFrame, step: float = 10.0, planar: bool = True, size: int = CHUNK, keep_end: bool = False) -> DataFrame:
    """Points every ``step`` metres along the line, by linear interpolation.

    A segment owns the samples in (start, end] of its arc length and the first point owns sample 0, so each segment
    emits its own samples and nothing is searched. ``planar`` measures in UTM metres and interpolates x/y; otherwise
    distances are great circles and lat/lon is interpolated. ``keep_end`` adds the line's last point when no sample
    falls on it. Samples are numbered from 0 in ``sample``.
    """
    a, b = ("x", "y") if planar else ("lat", "lon")
    pts = utm_points(points) if planar else points
    c = in_chunks(pts, KEY, "seq", before=1, size=size)
    w = chunk_window(KEY, "seq")
    c = c.withColumns({"_pa": F.lag(a).over(w), "_pb": F.lag(b).over(w)})
    length = hypot(F.col(a) - F.col("_pa"), F.col(b) - F.col("_pb")) if planar else haversine_m(F.col("_pa"), F.col("_pb"), F.col("lat"), F.col("lon"))
    seg = core(c.withColumn("_len", F.coalesce(length, F.lit(0.0))))
    seg = running_sum(seg, KEY, "seq", F.col("_len"), "_end", size)
    start = F.col("_end") - F.col("_len")
    first = F.when(F.col("_pa").isNull(), F.lit(0).cast("bigint")).otherwise(F.floor(start / step) + 1)
    last = F.when(F.col("_pa").isNull(), F.lit(0).cast("bigint")).otherwise(F.floor(F.col("_end") / step))
    numbers = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
    s = seg.withColumn("_start", start).withColumn("sample", F.explode(numbers))
    t = F.when(F.col("_len") > 0, (F.col("sample") * F.lit(step) - F.col("_start")) / F.col("_len")).otherwise(0.0)
    at = lambda prev, cur: F.coalesce(F.col(prev) + t * (F.col(cur) - F.col(prev)), F.col(cur))
    out = s.select("route_id", "sample", at("_pa", a).alias(a), at("_pb", b).alias(b))
    if keep_end:
        ends = seg.groupBy("route_id").agg(F.max(F.struct("seq", "_end", a, b)).alias("e"))
        off = F.col("e._end") - F.floor(F.col("e._end") / step) * step
        extra = ends.where(off > 0).select("route_id", (F.floor(F.col("e._end") / step) + 1).alias("sample"), F.col(f"e.{a}").alias(a), F.col(f"e.{b}").alias(b))
        out = out.unionByName(extra)
    return out


def smooth_path(samples: DataFrame, half: int = 3, columns=("x", "y"), size: int = CHUNK) -> DataFrame:
    """Centred mean over ``2 * half + 1`` samples, shorter at the ends of the line."""
    placed = samples.withColumn("_p", F.col("sample") + 1)
    c = in_chunks(placed, KEY, "_p", before=half, after=half, size=size)
    w = chunk_window(KEY, "_p").rowsBetween(-half, half)
    return core(c.withColumns({f"s{n}": F.avg(n).over(w) for n in columns})).drop("_p")


def heading_curvature(samples: DataFrame, step: float = 10.0, half: int = 3, size: int = CHUNK, zero_is_positive: bool = False, short_as_is: bool = True) -> DataFrame:
    """Smoothed samples with signed curvature (heading change per metre), circumradius and sign change. One shuffle:
    smoothing, headings and sign changes all fit into a halo of ``half + 2`` samples.

    ``short_as_is`` leaves lines with fewer samples than the smoothing window unsmoothed. ``zero_is_positive`` gives a
    curvature of exactly 0 the positive sign instead of a sign of its own.
    """
    placed = samples.withColumn("_p", F.col("sample") + 1)
    c = in_chunks(placed, KEY, "_p", before=half + 2, after=half + 1, size=size)
    w = chunk_window(KEY, "_p")
    smooth = w.rowsBetween(-half, half)
    # Only a whole short line has so few samples in its first chunk.
    short = (F.col("_chunk") == 0) & (_count().over(W.partitionBy(*KEY, "_chunk")) < 2 * half + 1) if short_as_is else F.lit(False)
    c = c.withColumns({f"s{n}": F.when(short, F.col(n)).otherwise(F.avg(n).over(smooth)) for n in ("x", "y")})
    c = c.withColumns({"_px": F.lag("sx").over(w), "_py": F.lag("sy").over(w), "_nx": F.lead("sx").over(w), "_ny": F.lead("sy").over(w)})
    turn = F.atan2(F.col("_ny") - F.col("sy"), F.col("_nx") - F.col("sx")) - F.atan2(F.col("sy") - F.col("_py"), F.col("sx") - F.col("_px"))
    c = c.withColumn("signed_curvature", wrap_pi(turn) / step)
    c = c.withColumn("radius_m", F.when(F.col("signed_curvature").isNotNull(), circumradius(*[F.col(n) for n in ("_px", "_py", "sx", "sy", "_nx", "_ny")])))
    now = F.col("signed_curvature")
    sign = F.when(now < 0, -1).when(now.isNotNull(), 1) if zero_is_positive else F.signum(now).cast("int")
    c = c.withColumn("_sign", sign)
    c = c.withColumn("sign_change", F.coalesce(F.lag("_sign").over(w) != F.col("_sign"), F.lit(False)))
    return core(c).select("route_id", "sample", "sx", "sy", "signed_curvature", "radius_m", "sign_change")


def path_features(points: DataFrame, variant: str = "analyzer", step: float = 10.0, hairpin_m: float = 20.0, size: int = CHUNK) -> DataFrame:
    """Curvature figures of a route from its 10 m samples.

    ``variant="analyzer"``: planar resampling, length n x step, end curvatures counted as 0, interpolated percentiles,
    a curvature of exactly 0 has its own sign. ``variant="optimized"``: great-circle resampling with the end point
    kept, short projection series, length (n - 1) x step, inner samples only, the 95th percentile by index.
    """
    optimized = variant == "optimized"
    if optimized:
        samples = utm_points(resample_path(points, step, planar=False, size=size, keep_end=True), long_series=False)
    else:
        samples = resample_path(points, step, size=size)
    bends = heading_curvature(samples, step, size=size, zero_is_positive=optimized, short_as_is=not optimized).withColumn("_abs", F.abs("signed_curvature"))
    k = F.col("_abs") if optimized else F.coalesce("_abs", F.lit(0.0))
    # Sums and percentiles read the bends several times: the samples are walked once.
    bends = stored(bends.select("route_id", "_abs", k.alias("k"), "radius_m", "sign_change"))
    hairpin = F.coalesce(F.col("radius_m") < hairpin_m, F.lit(False))
    g = bends.groupBy("route_id").agg(
        _count().alias("geometry_points"), (F.sum("_abs") * step).alias("curvature_sum"), F.avg("k").alias("avg_curvature"), F.max("k").alias("max_curvature"),
        F.count("k").alias("_k"), F.count_if(F.col("k") < 0.005).alias("_straight"), F.count_if(hairpin).alias("hairpin_count"),
        F.avg(F.when(hairpin, F.col("k"))).alias("avg_hairpin_curvature"), F.count_if("sign_change").alias("sign_changes"),
    )
    g = g.where(F.col("geometry_points") >= 3)
    intervals = F.col("geometry_points") - (1 if optimized else 0)
    g = g.withColumn("distance_km", F.greatest(intervals * F.lit(step) / 1000, F.lit(0.001)))
    if optimized:
        p95 = index_quantile(bends, "k", 0.95, "p95_curvature")
    else:
        p95 = exact_quantiles(bends, KEY, "k", {"p50_curvature": 0.5, "p95_curvature": 0.95})
    km = F.col("distance_km")
    out = g.join(p95, KEY).withColumns(
        {
            "curvature_density": F.col("curvature_sum") / km, "hairpin_density": F.col("hairpin_count") / km, "straight_ratio": F.col("_straight") / F.col("_k"),
            "sign_changes_per_km": F.col("sign_changes") / km, "avg_turn_length": F.coalesce(F.try_divide(km * 1000, F.col("sign_changes")), F.lit(0.0)),
            "avg_hairpin_curvature": F.coalesce("avg_hairpin_curvature", F.lit(0.0)),
        }
    )
    return out.drop("_k", "_straight")


def index_quantile(df: DataFrame, value: str, q: float, name: str) -> DataFrame:
    """The value at zero-based place int(q * n) of the sorted values."""
    return values_at(df, KEY, value, {name: F.floor(F.col("_n") * F.lit(q)) + 1}).select("route_id", name)


def elevation_knots(samples: DataFrame, every: int = 20) -> DataFrame:
    """Every ``every``-th sample and the last one of each route. The samples are walked once."""
    samples = stored(samples)
    last = samples.groupBy("route_id").agg(F.max("sample").alias("_last"))
    return samples.join(last, KEY).where((F.col("sample") % every == 0) | (F.col("sample") == F.col("_last"))).withColumn("_k", F.ceil(F.col("sample") / every) + 1)


def sparse_elevation(knots: DataFrame, every: int = 20, size: int = CHUNK) -> DataFrame:
    """Elevation of every sample from sparse knots (route_id, sample, elevation), by linear interpolation.

    Each pair of neighbouring knots emits its own samples; a route without any elevation gets zeros.
    """
    k = knots.withColumn("_k", (F.ceil(F.col("sample") / every) + 1).cast("bigint"))
    c = in_chunks(k.withColumn("_e", F.coalesce("elevation", F.lit(0.0))), KEY, "_k", after=1, size=size)
    w = chunk_window(KEY, "_k")
    c = core(c.withColumns({"_x2": F.lead("sample").over(w), "_y2": F.lead("_e").over(w)}))
    own = F.when(F.col("_x2").isNull(), F.array("sample")).otherwise(F.sequence(F.col("sample"), F.col("_x2") - 1))
    s = c.select("route_id", F.col("sample").alias("_x1"), F.col("_e").alias("_y1"), "_x2", "_y2", F.explode(own).alias("sample"))
    t = (F.col("sample") - F.col("_x1")) / (F.col("_x2") - F.col("_x1"))
    return s.select("route_id", "sample", F.coalesce(F.col("_y1") + t * (F.col("_y2") - F.col("_y1")), F.col("_y1")).alias("elevation"))


def grade_features(elevations: DataFrame, step: float = 10.0, size: int = CHUNK) -> DataFrame:
    """Ascent, descent and grade statistics over samples; the first sample has grade 0."""
    c = in_chunks(elevations.withColumn("_p", F.col("sample") + 1), KEY, "_p", before=1, size=size)
    rise = F.coalesce(F.col("elevation") - F.lag("elevation").over(chunk_window(KEY, "_p")), F.lit(0.0))
    g = core(c.withColumn("rise", rise)).withColumns({"grade": F.col("rise") / step * 100, "abs_grade": F.abs(F.col("rise") / step * 100)})
    g = stored(g.select("route_id", "rise", "grade", "abs_grade"))
    r = F.col("rise")
    stats = g.groupBy("route_id").agg(
        F.sum(F.when(r > 0, r).otherwise(0.0)).alias("total_ascent"), F.sum(F.when(r > 0, 0.0).otherwise(-r)).alias("total_descent"), F.max("abs_grade").alias("max_grade"), F.min("grade").alias("min_grade"),
        F.avg("abs_grade").alias("avg_abs_grade"), F.stddev_pop("grade").alias("grade_std"),
    )
    return stats.join(exact_quantiles(g, KEY, "abs_grade", {"p95_grade": 0.95}), KEY)


def corner_census(points: DataFrame, size: int = CHUNK) -> DataFrame:
    """Corners by sharpness, climb, mean slope, and the straight sections, from lines as drawn."""
    legs = _legs(points, size)
    a, d = F.col("turn_deg"), F.col("leg_m")
    rise = F.col("rise_m")
    slope = F.when(d > 0, F.abs(F.degrees(F.atan2(rise, d))))
    g = legs.groupBy("route_id").agg(
        (F.sum(d) / 1000).alias("distance_km"), F.count_if(a > 15).alias("corners"), F.count_if(a > 45).alias("sharp"), F.count_if((a > 15) & (a <= 45)).alias("medium"),
        F.count_if((a > 5) & (a <= 15)).alias("gentle"), F.coalesce(F.avg(F.when(a > 15, a)), F.lit(0.0)).alias("avg_corner_deg"), F.coalesce(F.max(F.when(a > 15, a)), F.lit(0.0)).alias("max_corner_deg"),
        F.sum(F.when(rise > 0, rise).otherwise(0.0)).alias("elevation_gain_m"), F.sum(F.when(rise > 0, 0.0).otherwise(-rise)).alias("elevation_loss_m"), F.coalesce(F.avg(slope), F.lit(0.0)).alias("avg_abs_slope_deg"),
    )
    out = g.join(_run_totals(legs, size), KEY, "left")
    zero = F.lit(0.0)
    return out.withColumns(
        {
            "straight_km": F.coalesce("straight_km", zero), "longest_straight_km": F.coalesce("longest_straight_km", zero), "straight_sections": F.coalesce("straight_sections", F.lit(0).cast("bigint")),
            "straightness_pct": F.coalesce(F.try_divide(F.coalesce("straight_km", zero) * 100, F.col("distance_km")), zero),
        }
    )


def _legs(points: DataFrame, size: int) -> DataFrame:
    """One row per leg (point to next point) with its length, rise and the turn at its end (NULL on the last leg)."""
    c = in_chunks(points, KEY, "seq", after=2, size=size)
    w = chunk_window(KEY, "seq")
    c = c.withColumns({f"_{n}{i}": F.lead(n, i).over(w) for n in ("lat", "lon") for i in (1, 2)} | {"_alt1": F.lead("alt", 1).over(w)})
    c = core(c).where(F.col("_lat1").isNotNull())
    lat, lon, a1, o1, a2, o2 = (F.col(n) for n in ("lat", "lon", "_lat1", "_lon1", "_lat2", "_lon2"))
    c = c.select(
        "route_id", "seq", haversine_m(lat, lon, a1, o1).alias("leg_m"), (F.col("_alt1") - F.col("alt")).alias("rise_m"),
        bearing_deg(lat, lon, a1, o1).alias("_in"), F.when(a2.isNotNull(), bearing_deg(a1, o1, a2, o2)).alias("_out"),
    )
    return c.withColumn("turn_deg", turn_angle(F.col("_in"), F.col("_out"))).drop("_in", "_out")


def _run_totals(legs: DataFrame, size: int) -> DataFrame:
    runs = straight_runs_of(legs, size)
    return runs.groupBy("route_id").agg((F.sum("run_m") / 1000).alias("straight_km"), (F.max("run_m") / 1000).alias("longest_straight_km"), _count().alias("straight_sections"))


def straight_runs_of(legs: DataFrame, size: int = CHUNK) -> DataFrame:
    """Runs of legs that end in a turn of at most 5 degrees (the last leg always counts). The run number is the count
    of breaks so far, so a run is a group."""
    marked = legs.withColumn("_break", F.coalesce(F.col("turn_deg") > 5, F.lit(False)).cast("double"))
    numbered = running_sum(marked, KEY, "seq", F.col("_break"), "_run", size)
    return numbered.where("_break = 0").groupBy("route_id", "_run").agg(F.sum("leg_m").alias("run_m")).where("run_m > 0").select("route_id", F.col("_run").cast("bigint").alias("run"), "run_m")


def straight_runs(points: DataFrame, size: int = CHUNK) -> DataFrame:
    return straight_runs_of(_legs(points, size), size)


def geometric_features(points: DataFrame, size: int = CHUNK) -> DataFrame:
    """All figures of the as-drawn analysis in one row per route of at least three points."""
    out = turn_summary(points, size=size).join(curvature_summary(points, size=size), KEY)
    out = out.join(ascent_descent(points, size), KEY, "left").join(grades_raw(points, size), KEY, "left")
    fill = ["total_ascent", "total_descent", "min_altitude", "max_altitude", "max_grade", "avg_grade", "avg_abs_grade"]
    out = out.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in fill})
    return out.withColumn("elevation_gain", F.col("max_altitude") - F.col("min_altitude"))
