"""Fixed table schemas and the helpers that bring a DataFrame into one of them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


_ATOMS = {
    "STRING": T.StringType(), "INT": T.IntegerType(), "BIGINT": T.LongType(), "DOUBLE": T.DoubleType(),
    "TIMESTAMP": T.TimestampType(), "ARRAY<STRING>": T.ArrayType(T.StringType()),
}


def _schema(text: str) -> T.StructType:
    """A flat schema from ``name TYPE, ...``; usable without a running session."""
    pairs = (field.split() for field in text.split(","))
    return T.StructType([T.StructField(name, _ATOMS[kind]) for name, kind in pairs])


STAGE_RESULTS = _schema(
    "result_id STRING, rally_id STRING, rally_name STRING, stage_number INT, stage_name STRING, "
    "stage_length_km DOUBLE, stage_id STRING, car_number STRING, driver_name STRING, raw_driver_name STRING, "
    "driver_id STRING, co_driver_name STRING, car_class STRING, normalized_class STRING, vehicle STRING, "
    "time_str STRING, time_seconds DOUBLE, diff_str STRING, diff_seconds DOUBLE, surface STRING, "
    "source_run_id STRING, status STRING, ratio_to_class_best DOUBLE, class_position INT"
)

# The sixteen columns of an older result table; the other columns are derived on ingest.
LEGACY_RESULTS = _schema(
    "result_id STRING, rally_id STRING, rally_name STRING, stage_number INT, stage_name STRING, "
    "stage_length_km DOUBLE, car_number STRING, driver_name STRING, co_driver_name STRING, car_class STRING, "
    "vehicle STRING, time_str STRING, time_seconds DOUBLE, diff_str STRING, diff_seconds DOUBLE, surface STRING"
)

STAGE_GEOMETRY = _schema(
    "stage_id STRING, rally_id STRING, rally_name STRING, stage_name STRING, stage_number INT, surface STRING, "
    "distance_km DOUBLE, curvature_sum DOUBLE, curvature_density DOUBLE, p95_curvature DOUBLE, "
    "max_curvature DOUBLE, avg_curvature DOUBLE, hairpin_count INT, hairpin_density DOUBLE, turn_count INT, "
    "turn_density DOUBLE, straight_ratio DOUBLE, sign_changes_per_km DOUBLE, total_ascent DOUBLE, "
    "total_descent DOUBLE, max_grade DOUBLE, avg_grade DOUBLE, avg_abs_grade DOUBLE, max_elevation DOUBLE, "
    "min_elevation DOUBLE, min_altitude DOUBLE, max_altitude DOUBLE, elevation_gain DOUBLE, geometry_points INT, "
    "elevation_api_calls INT, cache_hit_rate DOUBLE, straight_percentage DOUBLE, curvy_percentage DOUBLE, "
    "geometry_json STRING, analyzer_version STRING, analysis_version STRING, kml_file STRING, source_kml STRING, "
    "processed_at STRING, analyzed_at STRING, elevation_status STRING, geometry_status STRING, "
    "geometry_hash STRING, validated_at STRING, is_active INT"
)

PREDICTION_LOG = _schema(
    "prediction_id BIGINT, run_id STRING, rally_id STRING, stage_id STRING, driver_id STRING, "
    "predicted_time DOUBLE, confidence DOUBLE, used_geometry INT, data_quality_flags ARRAY<STRING>, "
    "model_version STRING, predicted_at TIMESTAMP, actual_time DOUBLE, error_pct DOUBLE, accepted INT, "
    "compared_at TIMESTAMP, comparison_status STRING, resolved_issue_types ARRAY<STRING>, "
    "resolution_note STRING, resolved_at TIMESTAMP, resolution_source STRING"
)

EVENT_RESULT = _schema(
    "position STRING, car_number STRING, driver_name STRING, nationality STRING, car_class STRING, team STRING, "
    "car_model STRING, time_str STRING, time_diff STRING, status STRING"
)

EVENT_STAGE = _schema("stage_number INT, stage_name STRING, stage_length_km DOUBLE").add("results", T.ArrayType(EVENT_RESULT))

EVENT_DOCUMENT = _schema("rally_id STRING, rally_name STRING, surface STRING").add("stages", T.ArrayType(EVENT_STAGE))

BATCH_REQUEST = _schema("rally_id STRING, stage_id STRING, stage_name STRING, stage_number INT, surface STRING").add(
    "drivers", T.ArrayType(_schema("driver_id STRING, driver_name STRING, normalized_class STRING, surface STRING"))
)

MANUAL_SHEET = _schema(
    "rally_name STRING, rally_date STRING, stage_name STRING, stage_number INT, stage_length_km DOUBLE, "
    "surface STRING, day_or_night STRING, driver_name STRING, car_model STRING, car_class STRING, "
    "time_str STRING, status STRING, overall_position INT, class_position INT"
)

STAGE_MAPPING = _schema(
    "rally_id STRING, stage_name STRING, kml_file STRING, base_stage_name STRING, pass_number INT"
)

POINTS = _schema("route_id STRING, seq BIGINT, lat DOUBLE, lon DOUBLE, alt DOUBLE")


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Fail at plan time when a required column is absent."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}")
    return df


def _cast(col: Column, source: T.DataType, target: T.DataType) -> Column:
    if source == target:
        return col
    if isinstance(target, (T.ArrayType, T.StructType, T.MapType)):
        return col.cast(target)
    return col.try_cast(target)


def align(df: DataFrame, schema: T.StructType, renames: Mapping[str, str] | None = None) -> DataFrame:
    """Project ``df`` onto ``schema``: old column names are taken over, absent columns become typed NULLs and
    values that do not fit the column's type become NULL. ``renames`` maps old name to new name."""
    renames = renames or {}
    have = {f.name: f.dataType for f in df.schema.fields}
    out = []
    for field in schema.fields:
        sources = [field.name] if field.name in have else []
        sources += [old for old, new in renames.items() if new == field.name and old in have]
        if sources:
            col = F.coalesce(*[_cast(F.col(s), have[s], field.dataType) for s in sources])
        else:
            col = F.lit(None).cast(field.dataType)
        out.append(col.alias(field.name))
    return df.select(*out)
