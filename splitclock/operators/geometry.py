"""Stage geometry records: canonical form, quality, near duplicates, overlays and the ordered merge."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from splitclock.functions.scoring import elevation_status, geometry_status
from splitclock.functions.text import build_stage_id, clean_text, to_number
from splitclock.operators.lookups import effective_surface
from splitclock.operators.merge import Merge, merge_upsert
from splitclock.operators.series import chunk_window, core, in_chunks, running_sum, with_position
from splitclock.schemas import STAGE_GEOMETRY
from splitclock.session import cut

DOUBLES = [f.name for f in STAGE_GEOMETRY.fields if isinstance(f.dataType, T.DoubleType)]
COUNTS = ["hairpin_count", "turn_count", "geometry_points", "elevation_api_calls"]
TEXTS = [f.name for f in STAGE_GEOMETRY.fields if isinstance(f.dataType, T.StringType)]

# How far two records of one stage may differ and still be the same route (absolute, relative).
TOLERANCES = {
    "distance_km": (0.05, 0.01),
    "total_ascent": (20.0, 0.05),
    "total_descent": (20.0, 0.05),
    "max_grade": (1.0, 0.15),
    "p95_curvature": (0.0005, 0.2),
}
HAIRPIN_TOLERANCE = 1


def geometry_hash(df: DataFrame | None = None, prefix: str = "") -> Column:
    """SHA-1 of the stored document, else of seven rounded metrics in a fixed text form."""
    c = lambda n: F.col(prefix + n)
    metrics = F.concat_ws(
        "|", c("stage_id"), *[F.format_string(f"%.{d}f", F.coalesce(c(n), F.lit(0.0))) for n, d in (("distance_km", 4), ("total_ascent", 2), ("total_descent", 2), ("p95_curvature", 6))],
        F.coalesce(c("hairpin_count"), F.lit(0)).cast("string"), F.coalesce(c("source_kml"), c("kml_file"), F.lit("")),
    )
    return F.sha1(F.coalesce(F.nullif(c("geometry_json"), F.lit("")), metrics))


def _nz(a: str, b: str) -> Column:
    """First of two numbers that is neither NULL nor 0 (0 stands for unknown); else the second."""
    return F.coalesce(F.nullif(F.col(a), F.lit(0.0)), F.col(b))


def _status_columns(df: DataFrame, now: str | None) -> DataFrame:
    km, up, down, grade = (F.col(c) for c in ("distance_km", "total_ascent", "total_descent", "max_grade"))
    red = geometry_status(km, up, down, grade)
    stamp = F.coalesce("validated_at", "analyzed_at", "processed_at", F.lit(now))
    return df.withColumns(
        {
            "elevation_status": elevation_status(km, up, down, grade, _nz("max_elevation", "max_altitude"), _nz("min_elevation", "min_altitude")),
            "geometry_status": red,
            "validated_at": F.when(red == "validated", stamp),
        }
    )


def geometry_quality(df: DataFrame, now: str | None = None) -> DataFrame:
    """Elevation state, geometry state and validation time of geometry rows."""
    return _status_columns(_complete(df), now)


def _complete(df: DataFrame) -> DataFrame:
    have = set(df.columns)
    add = {f.name: F.lit(None).cast(f.dataType) for f in STAGE_GEOMETRY.fields if f.name not in have}
    return df.withColumns(add) if add else df


def canonicalize_geometry(df: DataFrame, source_label: str, stages: DataFrame | None = None, rallies: DataFrame | None = None, now: str | None = None, extra: Sequence[str] = ()) -> DataFrame:
    """Bring rows of any analyser into the geometry schema. Rows without a stage key keep NULL ``stage_id``; the
    caller counts and drops them."""
    d = _complete(df)
    num = {c: to_number(F.col(c)) for c in DOUBLES} | {c: to_number(F.col(c)).cast("int") for c in COUNTS}
    txt = {c: clean_text(F.col(c)) for c in TEXTS if c != "geometry_json"}
    d = d.withColumns(num | txt).withColumn("stage_number", to_number(F.col("stage_number")).cast("int"))
    d = d.withColumn("stage_id", F.coalesce("stage_id", build_stage_id(F.col("rally_id"), F.col("stage_number"))))
    d = d.withColumn("stage_number", F.coalesce("stage_number", F.regexp_extract("stage_id", r"_ss(\d+)$", 1).try_cast("int")))
    override = own = rally = F.lit(None).cast("string")
    if stages is not None:
        s = stages.select("stage_id", F.col("surface_override").alias("_o"), F.col("surface").alias("_s"))
        d = d.join(s, "stage_id", "left")
        override, own = F.col("_o"), F.col("_s")
    if rallies is not None:
        d = d.join(rallies.select("rally_id", F.col("surface").alias("_r")), "rally_id", "left")
        rally = F.col("_r")
    version = F.coalesce("analysis_version", "analyzer_version", F.lit(source_label))
    kml = F.coalesce("source_kml", "kml_file")
    seen = F.coalesce("analyzed_at", "processed_at", F.lit(now))
    high, low = _nz("max_elevation", "max_altitude"), _nz("min_elevation", "min_altitude")
    straight = F.coalesce("straight_percentage", F.col("straight_ratio") * 100)
    d = d.withColumns(
        {
            "surface": effective_surface(override, own, rally, F.col("surface")), "stage_name": F.coalesce("stage_name", "stage_id"),
            "analyzer_version": F.coalesce("analyzer_version", version), "analysis_version": version, "kml_file": F.coalesce("kml_file", kml), "source_kml": kml,
            "processed_at": F.coalesce("processed_at", seen), "analyzed_at": seen, "max_elevation": high, "min_elevation": low,
            "max_altitude": _nz("max_altitude", "max_elevation"), "min_altitude": _nz("min_altitude", "min_elevation"),
            "straight_percentage": straight, "is_active": F.lit(1),
        }
    )
    d = d.withColumns(
        {
            "curvy_percentage": F.coalesce("curvy_percentage", F.greatest(F.lit(0.0), 100.0 - F.col("straight_percentage"))),
            "elevation_gain": F.coalesce("elevation_gain", F.abs(F.col("max_elevation") - F.col("min_elevation"))),
        }
    )
    d = d.withColumn("geometry_hash", F.coalesce("geometry_hash", geometry_hash()))
    d = _status_columns(d, now)
    return d.select(*[F.col(f.name).cast(f.dataType) for f in STAGE_GEOMETRY.fields], *extra)


def near_duplicate(a: str = "a", b: str = "b") -> Column:
    """Are two records close enough to be one route? ``a`` and ``b`` name struct columns."""
    tests = []
    for f, (absolute, relative) in TOLERANCES.items():
        x, y = F.col(f"{a}.{f}"), F.col(f"{b}.{f}")
        limit = F.greatest(F.lit(absolute), F.greatest(F.abs(x), F.abs(y), F.lit(1.0)) * relative)
        tests.append(F.when(x.isNull() & y.isNull(), True).otherwise(F.coalesce(F.abs(x - y) <= limit, F.lit(False))))
    x, y = F.col(f"{a}.hairpin_count"), F.col(f"{b}.hairpin_count")
    tests.append(F.coalesce(F.abs(x - y) <= HAIRPIN_TOLERANCE, F.lit(True)))
    return reduce(lambda p, q: p & q, tests)


def _present(col: Column, dtype: T.DataType) -> Column:
    return F.when(~col.isin("", "unknown"), col) if isinstance(dtype, T.StringType) else col


def _has_fingerprint(prefix: str) -> Column:
    c = lambda n: F.col(f"{prefix}.{n}")
    numbers = [F.coalesce(c(n).cast("double"), F.lit(0.0)) != 0 for n in ("distance_km", "total_ascent", "total_descent", "hairpin_count", "p95_curvature")]
    texts = [F.coalesce(_present(c(n), T.StringType()), F.lit("")) != "" for n in ("geometry_json", "source_kml", "kml_file")]
    return reduce(lambda p, q: p | q, numbers + texts)


def overlay_geometry(df: DataFrame, old: str, new: str, extra: Sequence[str] = (), now: str | None = None) -> DataFrame:
    """Known values of the new record over the old one. The hash follows the new record only when that carries any
    geometry of its own."""
    out = {"stage_id": F.coalesce(F.col(f"{old}.stage_id"), F.col(f"{new}.stage_id"))}
    for f in STAGE_GEOMETRY.fields:
        if f.name not in ("stage_id", "geometry_hash"):
            out[f.name] = F.coalesce(_present(F.col(f"{new}.{f.name}"), f.dataType), F.col(f"{old}.{f.name}"))
    fresh = F.when(_has_fingerprint(new), F.col(f"{new}.geometry_hash"))
    out["geometry_hash"] = F.coalesce(fresh, F.col(f"{old}.geometry_hash"))
    d = df.select(*[c.alias(n) for n, c in out.items()], *extra)
    d = d.withColumns(
        {
            "analysis_version": F.coalesce("analysis_version", "analyzer_version"), "source_kml": F.coalesce("source_kml", "kml_file"),
            "kml_file": F.coalesce("kml_file", "source_kml"), "processed_at": F.coalesce("processed_at", "analyzed_at"),
            "analyzed_at": F.coalesce("analyzed_at", "processed_at"),
        }
    )
    d = d.withColumn("geometry_hash", F.coalesce("geometry_hash", geometry_hash()))
    return _status_columns(d, now).withColumn("is_active", F.coalesce(F.nullif("is_active", F.lit(0)), F.lit(1)))


OUTCOMES = ("inserted", "metadata_updated", "near_duplicate", "conflict")


def merge_step(master: DataFrame, incoming: DataFrame, now: str | None = None) -> DataFrame:
    """Outcome of at most one canonical incoming row per stage: a row per incoming stage with ``outcome`` and the
    record the master holds afterwards (``result``)."""
    names = [f.name for f in STAGE_GEOMETRY.fields]
    m = _complete(master).select(F.col("stage_id").alias("_id"), F.struct(*names).alias("a"))
    i = incoming.select(F.col("stage_id").alias("_id"), F.struct(*names).alias("i"))
    both = i.join(m, "_id", "left")
    fresh = both.where(F.col("a").isNull()).select("_id", F.lit("inserted").alias("outcome"), F.col("i").alias("result"), F.col("i").alias("candidate"))
    known = overlay_geometry(both.where(F.col("a").isNotNull()), "a", "i", extra=("_id", "a"), now=now).select("_id", "a", F.struct(*names).alias("b"))
    same = F.coalesce(F.col("a.geometry_hash") == F.col("b.geometry_hash"), F.lit(False))
    outcome = F.when(same, "metadata_updated").when(near_duplicate("a", "b"), "near_duplicate").otherwise("conflict")
    known = known.withColumn("outcome", outcome)
    known = known.select("_id", "outcome", F.when(F.col("outcome") == "conflict", F.col("a")).otherwise(F.col("b")).alias("result"), F.col("b").alias("candidate"))
    return fresh.unionByName(known).withColumnRenamed("_id", "stage_id")


def merge_geometry(
    master: DataFrame, incoming: DataFrame, source_label: str, order: str | None = None, stages: DataFrame | None = None,
    rallies: DataFrame | None = None, replace_existing: bool = False, now: str | None = None,
) -> Merge:
    """Merge geometry rows into the master.

    Without ``order`` each stage occurs at most once and the merge is one join. With it, several rows of a stage apply
    one after the other, since each changes what the next is compared with: round ``n`` joins every stage's n-th row.
    Rows equal to their predecessor need no round of their own: after a conflict they conflict again, else they are
    counted as metadata. So the number of rounds is the largest number of different successive versions of one stage,
    and only the stages of the batch take part in them.
    """
    kept = (order,) if order else ()
    # Steps, counts and conflicts read the batch and its outcomes several times: write both once.
    canonical = cut(canonicalize_geometry(incoming, source_label, stages, rallies, now, extra=kept))
    keyed = canonical.where(F.col("stage_id").isNotNull())
    base = _complete(master).select(*[F.col(f.name).cast(f.dataType) for f in STAGE_GEOMETRY.fields])
    if replace_existing:
        base = base.where(F.lit(False))
    if order is None:
        steps = cut(merge_step(base, keyed, now))
        merged = merge_upsert(base, steps.select("result.*"), ["stage_id"])
    else:
        names = [f.name for f in STAGE_GEOMETRY.fields]
        placed = with_position(keyed.withColumn("_b", F.floor(F.col(order) / 4096)), ["stage_id"], [order], ["_b"], "_pos").drop("_b")
        chunked = in_chunks(placed.withColumn("_h", F.xxhash64(*names)), ["stage_id"], "_pos", before=1)
        repeated = F.coalesce(F.col("_h") == F.lag("_h").over(chunk_window(["stage_id"], "_pos")), F.lit(False))
        marked = core(chunked.withColumn("_repeat", repeated)).drop("_h")
        # The round of a row: how many rows up to it differ from their predecessor.
        numbered = cut(running_sum(marked, ["stage_id"], "_pos", F.when(F.col("_repeat"), 0).otherwise(1), "_round").withColumn("_round", F.col("_round").cast("int")).drop("_pos"))
        todo = numbered.where("NOT _repeat").drop("_repeat")
        rounds = todo.agg(F.max("_round")).first()[0] or 0
        touched = todo.select("stage_id").distinct()
        open_, steps = cut(base.join(touched, "stage_id", "left_semi")), None
        for n in range(1, rounds + 1):
            step = cut(merge_step(open_, todo.where(F.col("_round") == n), now).withColumn("_round", F.lit(n)))
            open_ = cut(merge_upsert(open_, step.select("result.*"), ["stage_id"]))
            steps = step if steps is None else steps.unionByName(step)
        merged = base.join(touched, "stage_id", "left_anti").unionByName(open_)
        if steps is None:
            steps = merge_step(base, keyed, now).withColumn("_round", F.lit(0))
        again = numbered.where("_repeat").select("stage_id", "_round").join(steps, ["stage_id", "_round"])
        steps = steps.unionByName(again.withColumn("outcome", F.when(F.col("outcome") == "conflict", "conflict").otherwise("metadata_updated")))
    outcomes = steps.select("stage_id", "outcome")
    conflicts = steps.where("outcome = 'conflict'").select(
        F.lit("stage_geometry").alias("entity_type"), F.col("stage_id").alias("entity_key"), F.lit("same_stage_id_different_route").alias("conflict_type"),
        F.to_json("result").alias("master_payload"), F.to_json("candidate").alias("incoming_payload"),
    )
    skipped = canonical.where(F.col("stage_id").isNull()).agg(F.count(F.lit(1))).scalar()
    log = outcomes.agg(F.lit("geometry_merge").alias("merge_scope"), F.lit(source_label).alias("source_path"), *[F.count_if(F.col("outcome") == o).alias(f"{o}_rows") for o in OUTCOMES]).withColumn("skipped_rows", skipped)
    return Merge(merged, conflicts, log, outcomes)


def enrich_geometry(geometry: DataFrame, stages: DataFrame, version: str = "legacy_geometry_import_v1") -> DataFrame:
    """Fill what older geometry rows lack: number, surface, altitudes, gain, versions, hash and state."""
    g = _complete(geometry)
    g = g.withColumn("stage_id", F.coalesce("stage_id", build_stage_id(F.col("rally_id"), F.col("stage_number"))))
    g = g.join(stages.select("stage_id", F.col("surface").alias("_s")), "stage_id", "left")
    z = F.lit(0.0)
    gain = F.abs(F.coalesce("max_elevation", "max_altitude", z) - F.coalesce("min_elevation", "min_altitude", z))
    g = g.withColumn("geometry_hash", F.coalesce("geometry_hash", geometry_hash())).withColumns(
        {
            "stage_number": F.coalesce("stage_number", F.regexp_extract("stage_id", r"_ss(\d+)$", 1).try_cast("int")), "surface": F.coalesce(F.nullif("surface", F.lit("")), "_s"),
            "elevation_gain": F.coalesce("elevation_gain", gain), "min_altitude": F.coalesce("min_altitude", "min_elevation"), "max_altitude": F.coalesce("max_altitude", "max_elevation"),
            "analysis_version": F.coalesce("analysis_version", F.lit(version)), "source_kml": F.coalesce("source_kml", "kml_file"), "analyzed_at": F.coalesce("analyzed_at", "processed_at"),
        }
    )
    km, up, down, grade = (F.col(c) for c in ("distance_km", "total_ascent", "total_descent", "max_grade"))
    state = geometry_status(km, up, down, grade)
    g = g.withColumns(
        {
            "elevation_status": elevation_status(km, up, down, grade, F.col("max_elevation"), F.col("min_elevation")), "geometry_status": state,
            "validated_at": F.when(state == "validated", F.coalesce("validated_at", "analyzed_at", "processed_at")).otherwise(F.col("validated_at")),
        }
    )
    return g.select(*[f.name for f in STAGE_GEOMETRY.fields])


def sync_stage_catalog(geometry: DataFrame, rallies: DataFrame, stages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Upsert rallies and stages from geometry rows; a known rally keeps its surface, a known stage its length where
    the geometry has none. The first row of a rally names its surface."""
    from splitclock.operators.history import first_per_key

    g = geometry.where(F.col("stage_id").isNotNull() & F.col("rally_id").isNotNull() & F.col("stage_number").isNotNull())
    name = F.coalesce("rally_name", "rally_id") if "rally_name" in geometry.columns else F.col("rally_id")
    new_r = g.select("rally_id", name.alias("_name"), F.col("surface").alias("_surface"), "stage_number", "stage_id")
    new_r = first_per_key(new_r, ["rally_id"], [F.col("_surface").isNull(), "stage_number", "stage_id"]).drop("stage_number", "stage_id")
    out_r = rallies.join(new_r, "rally_id", "full").select("rally_id", F.coalesce("_name", "rally_name").alias("rally_name"), F.coalesce("surface", "_surface").alias("surface"))
    j = g.join(out_r.select("rally_id", F.col("surface").alias("_rs")), "rally_id").join(stages.select("stage_id", F.col("length_km").alias("_km")), "stage_id", "left")
    differs = F.coalesce(F.col("surface") != F.col("_rs"), F.lit(False))
    new_s = j.select(
        "stage_id", "rally_id", "stage_number", F.coalesce("stage_name", "stage_id").alias("stage_name"), F.when(differs, F.col("surface")).alias("surface"),
        differs.cast("int").alias("surface_override"), F.coalesce("distance_km", "_km").alias("length_km"), F.lit("matched").alias("match_status"),
    )
    return out_r, merge_upsert(stages, new_s, ["stage_id"])


def sheet_overlay(master: DataFrame, sheet: DataFrame, now: str | None = None) -> Merge:
    """Sparse rows of a sheet (NULL keeps the stored value) laid over the geometry of the stages they name."""
    named = sheet.withColumn("stage_id", clean_text(F.col("stage_id"))).where(F.col("stage_id").isNotNull())
    return merge_geometry(master, named, "sheet_import", now=now)


def geometry_payload(features: DataFrame, analyzer_version: str, now: str | None = None) -> DataFrame:
    """Analyser output as a geometry row: missing metrics are 0, percentages come from the straight ratio."""
    d = _complete(features)
    straight = F.coalesce("straight_percentage", F.col("straight_ratio") * 100, F.lit(0.0))
    zero = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in DOUBLES if c not in ("straight_percentage", "curvy_percentage", "elevation_gain", "cache_hit_rate")}
    zero |= {c: F.coalesce(F.col(c).cast("int"), F.lit(0)) for c in COUNTS}
    d = d.withColumn("straight_percentage", straight).withColumns(zero)
    version = F.coalesce("analyzer_version", F.lit(analyzer_version))
    d = d.withColumns(
        {
            "curvy_percentage": F.coalesce("curvy_percentage", F.greatest(F.lit(0.0), 100.0 - F.col("straight_percentage"))), "analyzer_version": version, "analysis_version": version,
            "cache_hit_rate": F.coalesce("cache_hit_rate", F.lit(0.0)), "kml_file": F.coalesce("kml_file", "source_kml"), "source_kml": F.coalesce("source_kml", "kml_file"),
            "processed_at": F.lit(now), "analyzed_at": F.lit(now),
        }
    )
    metrics = [c for c in DOUBLES + COUNTS if c != "elevation_gain"]
    return d.withColumn("geometry_json", F.to_json(F.struct(*metrics))).select(*[f.name for f in STAGE_GEOMETRY.fields])
