"""Master dimensions built from the result table: drivers, aliases, rallies, stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splitclock.functions.text import build_driver_id, build_stage_id, clean_text, normalize_name_key
from splitclock.operators.aggregates import majority_value


def display_name_rank(name: Column, count: Column) -> Column:
    """Sort key of spellings: most used, fewest capitals, shortest, alphabetical."""
    capitals = F.length(F.regexp_replace(name, r"[^\p{Lu}]", ""))
    return F.struct((-count).alias("c"), capitals.alias("u"), F.length(name).alias("l"), name.alias("n"))


def needs_manual_review(variants: Column, longest: Column, shortest: Column, token_counts: Column) -> Column:
    """Spellings of one key whose lengths or word counts differ too much to be merged unseen."""
    far = longest >= F.greatest(F.lit(12.0), shortest * 1.7)
    return (variants > 1) & (far | (token_counts > 1))


def _spellings(results: DataFrame) -> DataFrame:
    name = F.trim("driver_name")
    counted = results.where(F.coalesce(name, F.lit("")) != "").groupBy(name.alias("alias_name")).agg(F.count(F.lit(1)).alias("count"))
    return counted.withColumn("normalized_name_key", normalize_name_key(F.col("alias_name"))).where("normalized_name_key <> ''")


def build_drivers(results: DataFrame) -> DataFrame:
    """One driver per name key with the best spelling, and whether a person should look at the merge."""
    tokens = F.size(F.split("normalized_name_key", " "))
    rank = display_name_rank(F.col("alias_name"), F.col("count"))
    length = F.length("alias_name")
    g = _spellings(results).groupBy("normalized_name_key").agg(
        F.min(rank)["n"].alias("display_name"), F.count(F.lit(1)).alias("variants"), F.max(length).alias("_long"), F.min(length).alias("_short"),
        F.countDistinct(tokens).alias("_tokens"),
    )
    review = needs_manual_review(F.col("variants"), F.col("_long"), F.col("_short"), F.col("_tokens"))
    return g.select(
        build_driver_id(F.col("display_name")).alias("driver_id"), "display_name", "normalized_name_key", F.when(review, "review").otherwise("auto").alias("merge_review_status")
    )


def build_aliases(results: DataFrame, drivers: DataFrame) -> DataFrame:
    j = _spellings(results).join(drivers, "normalized_name_key")
    return j.select(
        "driver_id", "alias_name", "normalized_name_key", (F.col("alias_name") == F.col("display_name")).cast("int").alias("is_primary"),
        F.col("merge_review_status").alias("merge_status"), "count",
    )


def alias_report(aliases: DataFrame) -> DataFrame:
    """Keys with more than one spelling, as one nested row per key."""
    pair = F.struct("alias_name", "count")
    return (
        aliases.groupBy("normalized_name_key", "driver_id")
        .agg(F.count(F.lit(1)).alias("variants"), F.max(F.col("merge_status") == "review").alias("requires_manual_review"), F.array_sort(F.collect_list(pair)).alias("aliases"))
        .where("variants > 1")
    )


def with_stage_id(results: DataFrame) -> DataFrame:
    made = build_stage_id(F.col("rally_id"), F.col("stage_number"))
    own = clean_text(F.col("stage_id")) if "stage_id" in results.columns else F.lit(None)
    return results.withColumn("stage_id", F.coalesce(own, made)).withColumn("surface", F.lower(F.trim("surface")))


def build_rallies(results: DataFrame, order: str = "result_id") -> DataFrame:
    """Majority name and surface per rally."""
    r = with_stage_id(results).where(F.col("rally_id").isNotNull())
    ids = r.select("rally_id").distinct()
    names = majority_value(r, ["rally_id"], "rally_name", [order])
    surfaces = majority_value(r, ["rally_id"], "surface", [order])
    out = ids.join(names, "rally_id", "left").join(surfaces, "rally_id", "left")
    return out.select("rally_id", F.coalesce("rally_name", "rally_id").alias("rally_name"), "surface")


def build_stages(results: DataFrame, rallies: DataFrame, geometry: DataFrame | None = None, order: str = "result_id") -> DataFrame:
    """Majority name, length and surface per stage; surface only where it overrides the rally's; stages known only
    from geometry are added."""
    r = with_stage_id(results).where(F.col("stage_id").isNotNull())
    key = ["stage_id"]
    base = r.groupBy("stage_id").agg(F.min_by(F.struct("rally_id", "stage_number"), order).alias("_k")).select("stage_id", "_k.*")
    for value in ("stage_name", "stage_length_km", "surface"):
        base = base.join(majority_value(r, key, value, [order]), key, "left")
    if geometry is not None:
        only = geometry.join(base, key, "left_anti").select(
            "stage_id", "rally_id", "stage_number", "stage_name", F.col("distance_km").alias("stage_length_km"), F.lower(F.trim("surface")).alias("surface")
        )
        base = base.unionByName(only)
        base = base.join(geometry.select("stage_id", F.lit("matched").alias("match_status")).distinct(), key, "left")
    else:
        base = base.withColumn("match_status", F.lit(None).cast("string"))
    out = base.join(rallies.select("rally_id", F.col("surface").alias("_rally_surface")), "rally_id", "left")
    differs = F.coalesce(F.nullif("surface", F.lit("")) != F.nullif("_rally_surface", F.lit("")), F.lit(False))
    return out.select(
        "stage_id", "rally_id", F.coalesce("stage_number", F.regexp_extract("stage_id", r"_ss(\d+)$", 1).try_cast("int")).alias("stage_number"),
        F.coalesce("stage_name", "stage_id").alias("stage_name"), F.when(differs, F.col("surface")).alias("surface"), differs.cast("int").alias("surface_override"),
        F.col("stage_length_km").alias("length_km"), F.coalesce("match_status", F.lit("results_only")).alias("match_status"),
    )


def backfill_result_keys(results: DataFrame, run_id: str) -> DataFrame:
    """Fill keys that are NULL; the driver id is always derived from the trimmed name."""
    return results.withColumns(
        {
            "stage_id": F.coalesce("stage_id", build_stage_id(F.col("rally_id"), F.col("stage_number"))),
            "raw_driver_name": F.coalesce("raw_driver_name", "driver_name"),
            "driver_id": build_driver_id(F.col("driver_name")),
            "source_run_id": F.coalesce("source_run_id", F.lit(run_id)),
            "status": F.coalesce("status", F.lit("FINISHED")),
        }
    )


def fix_driver_names(results: DataFrame) -> DataFrame:
    """Rows of names with several letter-case spellings get the standard spelling."""
    from splitclock.functions.text import turkish_title
    from splitclock.operators.aggregates import name_variants

    std = name_variants(results, turkish_title).select("name_key", "standard_name")
    j = results.join(std, F.upper("driver_name") == F.col("name_key"), "left")
    return j.withColumn("driver_name", F.coalesce("standard_name", "driver_name")).drop("name_key", "standard_name")


