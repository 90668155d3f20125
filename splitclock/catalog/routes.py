"""Queries over route geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from splitclock import fixtures as fx
from splitclock.catalog.registry import query, rounded, with_ctes
from splitclock.functions import geo
from splitclock.operators import lookups as lk
from splitclock.operators import route
from splitclock.session import stored


def _hav(a1, o1, a2, o2):
    h = f"(pow(sin(radians({a2} - {a1}) / 2), 2) + cos(radians({a1})) * cos(radians({a2})) * pow(sin(radians({o2} - {o1}) / 2), 2))"
    return f"(2 * 6371000.0::DOUBLE * atan2(sqrt({h}), sqrt(1 - {h})))"


def _bear(a1, o1, a2, o2):
    return f"""((degrees(atan2(sin(radians({o2} - {o1})) * cos(radians({a2})), cos(radians({a1})) * sin(radians({a2})) - sin(radians({a1})) * cos(radians({a2})) * cos(radians({o2} - {o1})))) + 360) % 360)"""


def _fold(x):
    return f"CASE WHEN abs({x}) > 180 THEN 360 - abs({x}) ELSE abs({x}) END"


def _utm(long: bool) -> tuple[str, str]:
    e2 = 0.081819191**2
    e4, e6, ep = e2 * e2, e2**3, e2 / (1 - e2)
    lit = lambda v: f"{v!r}::DOUBLE"
    phi, t, c = "radians(lat)", "pow(tan(radians(lat)), 2)", f"({lit(ep)} * pow(cos(radians(lat)), 2))"
    n = f"(6378137.0::DOUBLE / sqrt(1 - {lit(e2)} * pow(sin({phi}), 2)))"
    a = f"((radians(lon) - radians(33.0::DOUBLE)) * cos({phi}))"
    m = f"({lit(1 - e2 / 4 - 3 * e4 / 64 - (5 * e6 / 256 if long else 0))} * {phi} - {lit(3 * e2 / 8 + 3 * e4 / 32 + (45 * e6 / 1024 if long else 0))} * sin(2 * {phi}) + {lit(15 * e4 / 256 + (45 * e6 / 1024 if long else 0))} * sin(4 * {phi})"
    m += f" - {lit(35 * e6 / 3072)} * sin(6 * {phi}))" if long else ")"
    x5 = f"(5 - 18 * {t} + {t} * {t} + 72 * {c}" + (f" - {lit(58 * ep)})" if long else ")")
    x = f"({a} + (1 - {t} + {c}) * pow({a}, 3) / 6 + {x5} * pow({a}, 5) / 120)"
    y = f"(pow({a}, 2) / 2 + (5 - {t} + 9 * {c} + 4 * {c} * {c}) * pow({a}, 4) / 24"
    y += f" + (61 - 58 * {t} + {t} * {t} + 600 * {c} - {lit(330 * ep)}) * pow({a}, 6) / 720)" if long else ")"
    return f"(0.9996::DOUBLE * {n} * {x} + 500000)", f"(0.9996::DOUBLE * (6378137.0::DOUBLE * {m} + {n} * tan({phi}) * {y}))"


R = "PARTITION BY route_id ORDER BY seq"
SEG = fx.POINTS + f""",
seg AS MATERIALIZED (SELECT *, {_hav('plat', 'plon', 'lat', 'lon')} AS segment_m FROM (SELECT *, lag(lat) OVER ({R}) AS plat, lag(lon) OVER ({R}) AS plon FROM pt)),
dist AS (SELECT route_id, coalesce(sum(segment_m), 0) / 1000 AS distance_km FROM seg GROUP BY 1)
"""
ALT = fx.POINTS + f""",
alts AS MATERIALIZED (SELECT *, alt - palt AS rise_m, {_hav('plat', 'plon', 'lat', 'lon')} AS run_m FROM (SELECT *, lag(lat) OVER ({R}) AS plat, lag(lon) OVER ({R}) AS plon, lag(alt) OVER ({R}) AS palt FROM pt WHERE alt <> 0))
"""
_LX = "(CASE WHEN {lo} < lon THEN -1 ELSE 1 END * " + _hav("lat", "lon", "lat", "{lo}") + ")"
_LY = "(CASE WHEN {la} < lat THEN -1 ELSE 1 END * " + _hav("lat", "lon", "{la}", "lon") + ")"
VERT = SEG + f""",
nb AS (SELECT *, lead(lat) OVER ({R}) AS nlat, lead(lon) OVER ({R}) AS nlon FROM seg),
xy AS (SELECT *, {_LX.format(lo='plon')} AS x1, {_LY.format(la='plat')} AS y1, {_LX.format(lo='nlon')} AS x3, {_LY.format(la='nlat')} AS y3,
  {_bear('lat', 'lon', 'nlat', 'nlon')} - {_bear('plat', 'plon', 'lat', 'lon')} AS db FROM nb WHERE plat IS NOT NULL AND nlat IS NOT NULL),
vert AS MATERIALIZED (SELECT route_id, seq, {_fold('db')} AS turn_deg,
  CASE WHEN sqrt(x1*x1+y1*y1) * sqrt(x3*x3+y3*y3) * sqrt((x3-x1)*(x3-x1)+(y3-y1)*(y3-y1)) < 0.001 THEN 0.0 ELSE 2 * abs(x1*y3 - x3*y1) / (sqrt(x1*x1+y1*y1) * sqrt(x3*x3+y3*y3) * sqrt((x3-x1)*(x3-x1)+(y3-y1)*(y3-y1))) END AS curvature FROM xy)
"""
UX, UY = _utm(True)
SX, SY = _utm(False)
PLANAR = fx.POINTS + f""",
up AS MATERIALIZED (SELECT route_id, seq, {UX} AS x, {UY} AS y FROM pt),
ul AS (SELECT *, lag(x) OVER ({R}) AS px, lag(y) OVER ({R}) AS py FROM up),
ud AS (SELECT *, coalesce(sqrt((x-px)*(x-px)+(y-py)*(y-py)), 0) AS len FROM ul),
ue AS MATERIALIZED (SELECT *, sum(len) OVER ({R} ROWS UNBOUNDED PRECEDING) AS d1 FROM ud),
samples AS MATERIALIZED (
  SELECT route_id, n AS sample, CASE WHEN len > 0 THEN px + (n * 10.0::DOUBLE - (d1 - len)) / len * (x - px) ELSE x END AS x, CASE WHEN len > 0 THEN py + (n * 10.0::DOUBLE - (d1 - len)) / len * (y - py) ELSE y END AS y
  FROM (SELECT *, unnest(CASE WHEN px IS NULL THEN [0::BIGINT] ELSE range(CAST(floor((d1 - len) / 10) AS BIGINT) + 1, CAST(floor(d1 / 10) AS BIGINT) + 1) END) AS n FROM ue))
"""
GREAT = SEG + f""",
ge AS MATERIALIZED (SELECT route_id, seq, lat, lon, plat, plon, coalesce(segment_m, 0) AS len, sum(coalesce(segment_m, 0)) OVER ({R} ROWS UNBOUNDED PRECEDING) AS d1 FROM seg),
inner_s AS (
  SELECT route_id, n AS sample, CASE WHEN len > 0 THEN plat + (n * 10.0::DOUBLE - (d1 - len)) / len * (lat - plat) ELSE lat END AS lat, CASE WHEN len > 0 THEN plon + (n * 10.0::DOUBLE - (d1 - len)) / len * (lon - plon) ELSE lon END AS lon
  FROM (SELECT *, unnest(CASE WHEN plat IS NULL THEN [0::BIGINT] ELSE range(CAST(floor((d1 - len) / 10) AS BIGINT) + 1, CAST(floor(d1 / 10) AS BIGINT) + 1) END) AS n FROM ge)),
last_p AS (SELECT route_id, arg_max(lat, seq) AS lat, arg_max(lon, seq) AS lon, arg_max(d1, seq) AS d1 FROM ge GROUP BY 1),
gsamples AS MATERIALIZED (SELECT * FROM inner_s UNION ALL SELECT route_id, CAST(floor(d1 / 10) AS BIGINT) + 1, lat, lon FROM last_p WHERE d1 - floor(d1 / 10) * 10 > 0)
"""


def _bend(source: str, zero_positive: bool) -> str:
    s = "PARTITION BY route_id ORDER BY sample"
    sign = "CASE WHEN sc < 0 THEN -1 ELSE 1 END" if zero_positive else "sign(sc)"
    psign = "CASE WHEN psc < 0 THEN -1 ELSE 1 END" if zero_positive else "sign(psc)"
    return f""",
sm AS (SELECT route_id, sample, avg(x) OVER ({s} ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS sx, avg(y) OVER ({s} ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS sy FROM {source}),
sn AS (SELECT *, lag(sx) OVER ({s}) AS px, lag(sy) OVER ({s}) AS py, lead(sx) OVER ({s}) AS nx, lead(sy) OVER ({s}) AS ny FROM sm),
st AS (SELECT *, atan2(ny - sy, nx - sx) - atan2(sy - py, sx - px) AS dh, sqrt((sx-nx)*(sx-nx)+(sy-ny)*(sy-ny)) AS a, sqrt((px-nx)*(px-nx)+(py-ny)*(py-ny)) AS b, sqrt((px-sx)*(px-sx)+(py-sy)*(py-sy)) AS c FROM sn),
sc AS (SELECT *, CASE WHEN dh > pi() THEN dh - 2 * pi() WHEN dh < -pi() THEN dh + 2 * pi() ELSE dh END / 10 AS sc, sqrt(greatest(0, (a+b+c)/2 * ((a+b+c)/2-a) * ((a+b+c)/2-b) * ((a+b+c)/2-c))) AS area FROM st),
bend AS MATERIALIZED (SELECT route_id, sample, sx, sy, sc AS signed_curvature, CASE WHEN sc IS NULL THEN NULL WHEN area > 1e-9 THEN a*b*c/(4*area) ELSE 'infinity'::DOUBLE END AS radius_m,
  psc IS NOT NULL AND sc IS NOT NULL AND {psign} <> {sign} AS sign_change FROM (SELECT *, lag(sc) OVER ({s}) AS psc FROM sc))
"""


def points(spark, d):
    return fx.route_points(spark, d)


@query("haversine_m", with_ctes(SEG, "SELECT route_id, seq, round(segment_m, 4) AS segment_m FROM seg"))
def haversine_m(spark, d):
    return rounded(route.segments(points(spark, d)).select("route_id", "seq", "segment_m"), 4)


@query("turn_angle", with_ctes(VERT, "SELECT route_id, seq, round(turn_deg, 4) AS turn_deg FROM vert"))
def turn_angle(spark, d):
    return rounded(route.vertices(points(spark, d)).select("route_id", "seq", "turn_deg"), 4)


@query("bearing_deg", with_ctes(fx.POINTS, f"SELECT route_id, seq, round({_bear('38.0', '28.0', 'lat', 'lon')}, 4) AS bearing FROM pt"))
def bearing_deg(spark, d):
    start = (F.lit(38.0), F.lit(28.0))
    return rounded(points(spark, d).select("route_id", "seq", geo.bearing_deg(*start, F.col("lat"), F.col("lon")).alias("bearing")), 4)


@query("route_distance", with_ctes(SEG, "SELECT route_id, round(distance_km, 6) AS distance_km FROM dist"))
def route_distance(spark, d):
    return rounded(route.route_distance(points(spark, d)))


@query(
    "ascent_descent",
    with_ctes(ALT, "SELECT route_id, coalesce(sum(rise_m) FILTER (WHERE rise_m > 0), 0) AS total_ascent, coalesce(-sum(rise_m) FILTER (WHERE rise_m < 0), 0) AS total_descent, min(alt) AS min_altitude, max(alt) AS max_altitude FROM alts GROUP BY 1"),
)
def ascent_descent(spark, d):
    return route.ascent_descent(points(spark, d))


@query("altitude_range", with_ctes(fx.POINTS, "SELECT route_id, max(alt) - min(alt) AS elevation_gain FROM pt WHERE alt <> 0 GROUP BY 1"))
def altitude_range(spark, d):
    return route.ascent_descent(points(spark, d)).select("route_id", (F.col("max_altitude") - F.col("min_altitude")).alias("elevation_gain"))


@query("grades_raw", with_ctes(ALT, "SELECT route_id, round(max(g), 4) AS max_grade, round(avg(g), 4) AS avg_grade, round(avg(abs(g)), 4) AS avg_abs_grade FROM (SELECT route_id, CASE WHEN run_m > 0 THEN rise_m / run_m * 100 END AS g FROM alts) GROUP BY 1"))
def grades_raw(spark, d):
    return rounded(route.grades_raw(points(spark, d)), 4)


@query("curvature_3pt", with_ctes(VERT, "SELECT route_id, seq, round(curvature, 7) AS curvature FROM vert"))
def curvature_3pt(spark, d):
    return rounded(route.vertices(points(spark, d)).select("route_id", "seq", "curvature"), 7)


@query("local_xy", with_ctes(fx.POINTS, f"SELECT route_id, seq, round({_LX.format(lo='28.05')}, 3) AS x, round({_LY.format(la='38.02')}, 3) AS y FROM pt"))
def local_xy(spark, d):
    lat, lon = F.col("lat"), F.col("lon")
    return rounded(points(spark, d).select("route_id", "seq", geo.local_x(lat, lon, F.lit(28.05)).alias("x"), geo.local_y(lat, lon, F.lit(38.02)).alias("y")), 3)


TURN_SQL = """SELECT route_id, hairpin_count, turn_count, round(hairpin_count / distance_km, 5) AS hairpin_density, round(turn_count / distance_km, 5) AS turn_density, round(distance_km, 6) AS distance_km
  FROM (SELECT route_id, count(*) FILTER (WHERE turn_deg > 120) AS hairpin_count, count(*) FILTER (WHERE turn_deg > 45) AS turn_count FROM vert GROUP BY 1) JOIN dist USING (route_id)"""


@query("turn_summary", with_ctes(VERT, TURN_SQL))
def turn_summary(spark, d):
    return rounded(route.turn_summary(points(spark, d)), hairpin_density=5, turn_density=5)


@query(
    "curvature_summary",
    with_ctes(
        VERT,
        """SELECT route_id, round(avg(curvature), 6) AS avg_curvature, round(max(curvature), 6) AS max_curvature, round(quantile_cont(curvature, 0.95), 6) AS p95_curvature, round(count(*) FILTER (WHERE curvature > 0.01) / any_value(distance_km), 6) AS curvature_density,
           round(count(*) FILTER (WHERE curvature < 0.001) * 100.0::DOUBLE / count(*), 6) AS straight_percentage, round(count(*) FILTER (WHERE curvature > 0.01) * 100.0::DOUBLE / count(*), 6) AS curvy_percentage FROM vert JOIN dist USING (route_id) GROUP BY 1""",
    ),
)
def curvature_summary(spark, d):
    return rounded(route.curvature_summary(points(spark, d)))


@query("utm36_xy", with_ctes(fx.POINTS, f"SELECT route_id, seq, round({UX}, 3) AS x, round({UY}, 3) AS y, round({SX}, 3) AS short_x, round({SY}, 3) AS short_y FROM pt"))
def utm36_xy(spark, d):
    x, y = geo.utm36_xy(F.col("lat"), F.col("lon"))
    sx, sy = geo.utm36_xy(F.col("lat"), F.col("lon"), long_series=False)
    return rounded(points(spark, d).select("route_id", "seq", x.alias("x"), y.alias("y"), sx.alias("short_x"), sy.alias("short_y")), 3)


@query("resample_path", with_ctes(PLANAR, "SELECT route_id, sample, round(x, 3) AS x, round(y, 3) AS y FROM samples"))
def resample_path(spark, d):
    return rounded(route.resample_path(points(spark, d)), 3)


@query("resample_path_great_circle", with_ctes(GREAT, "SELECT route_id, sample, round(lat, 8) AS lat, round(lon, 8) AS lon FROM gsamples"))
def resample_path_great_circle(spark, d):
    return rounded(route.resample_path(points(spark, d), planar=False, keep_end=True), 8)


@query(
    "smooth_path",
    with_ctes(PLANAR, "SELECT route_id, sample, round(avg(x) OVER w, 3) AS sx, round(avg(y) OVER w, 3) AS sy FROM samples WINDOW w AS (PARTITION BY route_id ORDER BY sample ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)"),
)
def smooth_path(spark, d):
    return rounded(route.smooth_path(route.resample_path(points(spark, d))).select("route_id", "sample", "sx", "sy"), 3)


@query("heading_curvature", with_ctes(PLANAR + _bend("samples", False), "SELECT route_id, sample, round(signed_curvature, 6) AS signed_curvature, round(abs(signed_curvature), 6) AS curvature FROM bend"))
def heading_curvature(spark, d):
    b = route.heading_curvature(route.resample_path(points(spark, d)))
    return rounded(b.select("route_id", "sample", "signed_curvature", F.abs("signed_curvature").alias("curvature")))


@query("circumradius", with_ctes(PLANAR + _bend("samples", False), "SELECT route_id, sample, radius_m < 20 AS hairpin, round(CASE WHEN radius_m < 500 THEN radius_m END, 2) AS radius_m FROM bend WHERE signed_curvature IS NOT NULL"))
def circumradius(spark, d):
    b = route.heading_curvature(route.resample_path(points(spark, d))).where("signed_curvature IS NOT NULL")
    r = F.col("radius_m")
    return rounded(b.select("route_id", "sample", (r < 20).alias("hairpin"), F.when(r < 500, r).alias("radius_m")), 2)


PATH_SQL = """SELECT route_id, count(*) AS geometry_points, round(sum(abs(signed_curvature)) * 10, 4) AS curvature_sum, round(avg(k), 6) AS avg_curvature, round(max(k), 6) AS max_curvature, round(quantile_cont(k, 0.5), 6) AS p50_curvature,
  round(quantile_cont(k, 0.95), 6) AS p95_curvature, count(*) FILTER (WHERE radius_m < 20) AS hairpin_count, round(count(*) FILTER (WHERE k < 0.005) / CAST(count(*) AS DOUBLE), 6) AS straight_ratio, round(count(*) / 100.0::DOUBLE, 4) AS distance_km,
  round(coalesce(avg(k) FILTER (WHERE radius_m < 20), 0.0), 6) AS avg_hairpin_curvature FROM (SELECT *, coalesce(abs(signed_curvature), 0.0) AS k FROM bend) GROUP BY 1"""


@query("path_features", with_ctes(PLANAR + _bend("samples", False), PATH_SQL))
def path_features(spark, d):
    p = route.path_features(points(spark, d))
    out = p.select("route_id", "geometry_points", "curvature_sum", "avg_curvature", "max_curvature", "p50_curvature", "p95_curvature", "hairpin_count", "straight_ratio", "distance_km", "avg_hairpin_curvature")
    return rounded(out, curvature_sum=4, distance_km=4)


OPT_SQL = """SELECT route_id, any_value(total) AS geometry_points, round(sum(k) * 10, 4) AS curvature_sum, round(max(k), 6) AS max_curvature, round(list_sort(list(k))[CAST(floor(count(*) * 0.95::DOUBLE) AS BIGINT) + 1], 6) AS p95_curvature,
  count(*) FILTER (WHERE radius_m < 20) AS hairpin_count, round(count(*) FILTER (WHERE k < 0.005) / CAST(count(*) AS DOUBLE), 6) AS straight_ratio, round((any_value(total) - 1) / 100.0::DOUBLE, 4) AS distance_km
  FROM (SELECT *, abs(signed_curvature) AS k, count(*) OVER (PARTITION BY route_id) AS total FROM bend) WHERE k IS NOT NULL GROUP BY 1"""


@query("path_features_optimized", with_ctes(GREAT + f", gs AS (SELECT route_id, sample, {SX} AS x, {SY} AS y FROM gsamples)" + _bend("gs", True), OPT_SQL))
def path_features_optimized(spark, d):
    p = route.path_features(points(spark, d), variant="optimized")
    out = p.select("route_id", "geometry_points", "curvature_sum", "max_curvature", "p95_curvature", "hairpin_count", "straight_ratio", "distance_km")
    return rounded(out, curvature_sum=4, distance_km=4)


def _knots(spark, d):
    """Every 20th sample of the great-circle path with the elevation its grid cell has, where it has one."""
    s = route.resample_path(points(spark, d), planar=False, keep_end=True)
    k = stored(route.elevation_knots(s))
    grid = k.where("(sample / 20) % 9 <> 8").select(F.format_string("%.6f,%.6f", "lat", "lon").alias("grid_key"), (F.lit(200.0) + (F.col("sample") * 7 + F.col("route_id")) % 90).alias("elevation"))
    return lk.elevation_grid_join(k, grid.groupBy("grid_key").agg(F.max("elevation").alias("elevation")))


KNOTS = GREAT + """,
raw_knot AS MATERIALIZED (SELECT g.*, printf('%.6f,%.6f', lat, lon) AS grid_key FROM gsamples g JOIN (SELECT route_id, max(sample) AS last_s FROM gsamples GROUP BY 1) USING (route_id) WHERE sample % 20 = 0 OR sample = last_s),
grid AS (SELECT grid_key, max(200.0::DOUBLE + (sample * 7 + route_id) % 90) AS elevation FROM raw_knot WHERE (sample / 20.0::DOUBLE) % 9 <> 8 GROUP BY 1),
knot AS MATERIALIZED (SELECT k.route_id, k.sample, g.elevation FROM raw_knot k LEFT JOIN grid g USING (grid_key)),
filled AS (SELECT route_id, sample, coalesce(elevation, 0.0) AS e, lead(sample) OVER (PARTITION BY route_id ORDER BY sample) AS s2, lead(coalesce(elevation, 0.0)) OVER (PARTITION BY route_id ORDER BY sample) AS e2 FROM knot),
elev AS MATERIALIZED (SELECT route_id, n AS sample, CASE WHEN s2 IS NULL THEN e ELSE e + (n - sample) / CAST(s2 - sample AS DOUBLE) * (e2 - e) END AS elevation FROM (SELECT *, unnest(CASE WHEN s2 IS NULL THEN [sample] ELSE range(sample, s2) END) AS n FROM filled)),
grade AS (SELECT route_id, sample, coalesce(elevation - lag(elevation) OVER (PARTITION BY route_id ORDER BY sample), 0.0) AS rise FROM elev)
"""


@query("elevation_grid_join", with_ctes(KNOTS, "SELECT route_id, count(*) AS knots, round(avg(CASE WHEN elevation IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS hit_rate FROM knot GROUP BY 1"))
def elevation_grid_join(spark, d):
    return rounded(_knots(spark, d).groupBy("route_id").agg(F.count(F.lit(1)).alias("knots"), F.avg(F.col("elevation").isNotNull().cast("double")).alias("hit_rate")))


@query("sparse_elevation", with_ctes(KNOTS, "SELECT route_id, sample, round(elevation, 6) AS elevation FROM elev"))
def sparse_elevation(spark, d):
    return rounded(route.sparse_elevation(_knots(spark, d).select("route_id", "sample", "elevation")))


@query(
    "grade_features",
    with_ctes(
        KNOTS,
        """SELECT route_id, round(sum(greatest(rise, 0)), 4) AS total_ascent, round(sum(greatest(-rise, 0)), 4) AS total_descent, round(max(abs(rise)) * 10, 4) AS max_grade, round(min(rise) * 10, 4) AS min_grade, round(avg(abs(rise)) * 10, 4) AS avg_abs_grade,
           round(stddev_pop(rise * 10), 4) AS grade_std, round(quantile_cont(abs(rise) * 10, 0.95), 4) AS p95_grade FROM grade GROUP BY 1""",
    ),
)
def grade_features(spark, d):
    return rounded(route.grade_features(route.sparse_elevation(_knots(spark, d).select("route_id", "sample", "elevation"))), 4)


LEGS = fx.POINTS + f""",
lg AS (SELECT *, lead(lat) OVER ({R}) AS a1, lead(lon) OVER ({R}) AS o1, lead(alt) OVER ({R}) AS e1, lead(lat, 2) OVER ({R}) AS a2, lead(lon, 2) OVER ({R}) AS o2 FROM pt),
leg AS MATERIALIZED (SELECT route_id, seq, {_hav('lat', 'lon', 'a1', 'o1')} AS leg_m, e1 - alt AS rise_m, CASE WHEN a2 IS NOT NULL THEN {_fold(_bear('a1', 'o1', 'a2', 'o2') + ' - ' + _bear('lat', 'lon', 'a1', 'o1'))} END AS turn_deg FROM lg WHERE a1 IS NOT NULL),
runs AS MATERIALIZED (SELECT route_id, run, sum(leg_m) AS run_m FROM (SELECT *, CAST(sum(CASE WHEN turn_deg > 5 THEN 1 ELSE 0 END) OVER ({R} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM leg) WHERE turn_deg IS NULL OR turn_deg <= 5 GROUP BY 1, 2 HAVING sum(leg_m) > 0)
"""


@query("straight_runs", with_ctes(LEGS, "SELECT route_id, run, round(run_m, 4) AS run_m FROM runs"))
def straight_runs(spark, d):
    return rounded(route.straight_runs(points(spark, d)), 4)


@query(
    "corner_census",
    with_ctes(
        LEGS,
        """SELECT l.*, round(coalesce(straight_km, 0.0), 6) AS straight_km, round(coalesce(longest_straight_km, 0.0), 6) AS longest_straight_km, coalesce(straight_sections, 0) AS straight_sections, round(coalesce(straight_km, 0.0) * 100 / km, 4) AS straightness_pct FROM (
           SELECT route_id, sum(leg_m) / 1000 AS km, count(*) FILTER (WHERE turn_deg > 15) AS corners, count(*) FILTER (WHERE turn_deg > 45) AS sharp, count(*) FILTER (WHERE turn_deg > 15 AND turn_deg <= 45) AS medium, count(*) FILTER (WHERE turn_deg > 5 AND turn_deg <= 15) AS gentle,
             round(coalesce(avg(turn_deg) FILTER (WHERE turn_deg > 15), 0.0), 4) AS avg_corner_deg, round(coalesce(max(turn_deg) FILTER (WHERE turn_deg > 15), 0.0), 4) AS max_corner_deg, sum(greatest(rise_m, 0)) AS elevation_gain_m, sum(greatest(-rise_m, 0)) AS elevation_loss_m,
             round(avg(CASE WHEN leg_m > 0 THEN abs(degrees(atan2(rise_m, leg_m))) END), 4) AS avg_abs_slope_deg FROM leg GROUP BY 1) l
           LEFT JOIN (SELECT route_id, sum(run_m) / 1000 AS straight_km, max(run_m) / 1000 AS longest_straight_km, count(*) AS straight_sections FROM runs GROUP BY 1) USING (route_id)""".replace("SELECT l.*", "SELECT l.* EXCLUDE (km), round(km, 6) AS distance_km"),
    ),
)
def corner_census(spark, d):
    out = route.corner_census(points(spark, d))
    return rounded(out, avg_corner_deg=4, max_corner_deg=4, avg_abs_slope_deg=4, straightness_pct=4)
