"""From a folder of route files to merged stage geometry."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splitclock.functions.classes import is_stage_placemark
from splitclock.functions.text import stage_number_from_text
from splitclock.operators.geometry import geometry_payload, merge_geometry
from splitclock.operators.lookups import fuzzy_match_stage
from splitclock.operators.merge import Merge
from splitclock.operators.route import ascent_descent, path_features, route_distance
from splitclock.session import cut
from splitclock.sources.kml import kml_points


@dataclass
class Corpus:
    """Merged geometry and one status row per file."""

    merge: Merge
    files: DataFrame


def process_corpus(files: DataFrame, stages: DataFrame, master: DataFrame, now: str | None = None) -> Corpus:
    """``files``: path, content, rally_id. ``stages``: the stage list the routes are matched with.

    Points are parsed once and written; matching, features and merge then read that table. Where two files claim one
    stage the better match wins.
    """
    points = cut(kml_points(files))
    marks = points.groupBy("route_id").agg(F.min("path").alias("path"), F.min("name").alias("route_name"), F.count(F.lit(1)).alias("points"))
    routes = marks.join(route_distance(points), "route_id").join(files.select("path", "rally_id"), "path")
    routes = routes.where((F.col("points") >= 3) & is_stage_placemark(F.col("route_name"), F.col("distance_km")))
    routes = routes.select("route_id", "path", "rally_id", "route_name", "distance_km", stage_number_from_text(F.col("route_name")).alias("route_number"))
    matched = fuzzy_match_stage(routes.withColumnRenamed("route_id", "file_name"), stages)
    best = matched.groupBy("stage_id").agg(F.min_by(F.struct("file_name", "rally_id"), F.struct((-F.col("score")).alias("s"), "file_name")).alias("b"))
    best = cut(best.select("stage_id", F.col("b.file_name").alias("route_id"), F.col("b.rally_id").alias("rally_id")))
    chosen = points.join(best.select("route_id"), "route_id", "left_semi")
    features = path_features(chosen).join(ascent_descent(chosen), "route_id", "left")
    rows = features.join(best, "route_id").join(routes.select("route_id", F.col("path").alias("kml_file"), F.col("route_name").alias("stage_name")), "route_id")
    payload = cut(geometry_payload(rows.drop("route_id"), "path_analyzer", now))
    merge = merge_geometry(master, payload, "route_corpus", now=now)
    used = routes.join(best.select("route_id", "stage_id"), "route_id").groupBy("path").agg(F.count(F.lit(1)).alias("stages_processed"))
    parsed = marks.groupBy("path").agg(F.count(F.lit(1)).alias("routes"))
    status = files.select("path").join(parsed, "path", "left").join(used, "path", "left")
    label = F.when(F.col("routes").isNull(), "parse_failed").when(F.col("stages_processed").isNull(), "no_match").otherwise("success")
    status = status.select("path", F.coalesce("stages_processed", F.lit(0).cast("bigint")).alias("stages_processed"), label.alias("status"))
    return Corpus(merge, status)
