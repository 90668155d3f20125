"""Conflict-aware merges of incoming results into a master table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from splitclock.functions.classes import normalize_class
from splitclock.functions.text import build_driver_id, build_stage_id, clean_text
from splitclock.operators.facts import class_position
from splitclock.operators.series import group_stats
from splitclock.schemas import STAGE_RESULTS, align
from splitclock.session import stored

# The fields whose difference makes an incoming row a conflict.
COMPARE_FIELDS = [
    "rally_id", "rally_name", "stage_number", "stage_name", "stage_length_km", "car_number", "raw_driver_name",
    "co_driver_name", "car_class", "vehicle", "time_str", "time_seconds", "diff_str", "diff_seconds", "surface", "status",
]
NO_RESULT = ("DNF", "DNS", "DSQ", "RET", "N/A", "—")
DERIVED = ("ratio_to_class_best", "class_position")


@dataclass
class Merge:
    """What a merge gives back: the new master, the conflicts, one row of counts, and the label of every incoming row (what a row
    differs in is in ``conflicts``; `classify_incoming` says it of all rows)."""

    merged: DataFrame
    conflicts: DataFrame
    log: DataFrame
    outcomes: DataFrame


def status_derive(status: Column, seconds: Column) -> Column:
    """A given status, else FINISHED when there is a time, else UNKNOWN."""
    return F.coalesce(F.nullif(status, F.lit("")), F.when(seconds != 0, "FINISHED").otherwise("UNKNOWN"))


def page_status(time_text: Column) -> Column:
    """Status of a results-page row: the marker itself, DNS for an empty time, else OK."""
    t = F.upper(F.coalesce(time_text, F.lit("")))
    return F.when(t == "", "DNS").when(t.isin(*NO_RESULT), t).otherwise("OK")


def canonicalize_results(df: DataFrame, source_run_id: str | None = None, extra: Sequence[str] = ()) -> DataFrame:
    """Trim, fill in and derive every column of the result table from whatever columns the source has."""
    kept = [f for f in df.schema.fields if f.name in extra]
    a = align(df.drop(*DERIVED), T.StructType(STAGE_RESULTS.fields + kept))
    rally = clean_text(F.col("rally_id"))
    raw_name = F.coalesce(clean_text(F.col("raw_driver_name")), clean_text(F.col("driver_name")))
    stage_id = F.coalesce(clean_text(F.col("stage_id")), build_stage_id(rally, F.col("stage_number")))
    driver_id = F.coalesce(clean_text(F.col("driver_id")), build_driver_id(raw_name))
    car = clean_text(F.col("car_number"))
    made_id = F.concat(F.coalesce(rally, F.lit("")), F.lit("_ss"), F.coalesce(F.col("stage_number").cast("string"), F.lit("None")), F.lit("_"), F.coalesce(car, driver_id))
    car_class = clean_text(F.col("car_class"))
    return a.select(
        F.coalesce(F.nullif("result_id", F.lit("")), made_id).alias("result_id"), rally.alias("rally_id"),
        F.coalesce(clean_text(F.col("rally_name")), rally).alias("rally_name"), "stage_number",
        F.coalesce(clean_text(F.col("stage_name")), stage_id).alias("stage_name"), "stage_length_km", stage_id.alias("stage_id"),
        car.alias("car_number"), F.coalesce(clean_text(F.col("driver_name")), raw_name).alias("driver_name"), raw_name.alias("raw_driver_name"),
        driver_id.alias("driver_id"), clean_text(F.col("co_driver_name")).alias("co_driver_name"), car_class.alias("car_class"),
        F.coalesce(F.nullif("normalized_class", F.lit("")), normalize_class(car_class)).alias("normalized_class"),
        clean_text(F.col("vehicle")).alias("vehicle"), clean_text(F.col("time_str")).alias("time_str"), "time_seconds",
        clean_text(F.col("diff_str")).alias("diff_str"), "diff_seconds", F.lower(clean_text(F.col("surface"))).alias("surface"),
        (F.lit(source_run_id) if source_run_id else F.col("source_run_id")).alias("source_run_id"),
        status_derive(F.col("status"), F.col("time_seconds")).alias("status"), *extra,
    )


def _comparable(prefix: str, field: str) -> Column:
    c = F.col(f"{prefix}.{field}")
    return c if field in ("stage_number", "stage_length_km", "time_seconds", "diff_seconds") else F.nullif(F.trim(c), F.lit(""))


def _equal(a: str, b: str) -> Column:
    out = F.lit(True)
    for f in COMPARE_FIELDS:
        out = out & _comparable(a, f).eqNullSafe(_comparable(b, f))
    return out


def _difference(master: str, incoming: str) -> Column:
    return F.array_compact(
        F.array(
            *[
                F.when(
                    ~_comparable(master, f).eqNullSafe(_comparable(incoming, f)),
                    F.struct(F.lit(f).alias("field"), F.col(f"{master}.{f}").cast("string").alias("master"), F.col(f"{incoming}.{f}").cast("string").alias("incoming")),
                )
                for f in COMPARE_FIELDS
            ]
        )
    )


def classify_incoming(master: DataFrame, incoming: DataFrame, order: str) -> DataFrame:
    """Label canonical incoming rows insert / skipped / conflict / duplicate.

    The first row of an id within the batch (by ``order``) counts as known: a later equal row is a duplicate and is
    dropped; a later different row is compared with the master row, or with that first row where the master has none.
    First rows are found by a map-side combined minimum and joined to the repeated ids only; an id that fills a third of
    the batch is a skewed join, which adaptive execution splits, and no one task's work.
    """
    return _with_payloads(_classified(master, incoming, order))


def _classified(master: DataFrame, incoming: DataFrame, order: str) -> DataFrame:
    """The label of each row beside the row itself, the first one of its id where that was sent again, and the master's."""
    fields = [c for c in incoming.columns if c != order]
    places = incoming.groupBy("result_id").agg(F.min(order).alias("_first"), F.count(F.lit(1)).alias("_sent"))
    i = incoming.select("result_id", F.col(order).alias("_seq"), F.struct(*fields).alias("i")).join(places, "result_id")
    first = i.where((F.col("_sent") > 1) & (F.col("_seq") == F.col("_first"))).select("result_id", F.col("i").alias("f"))
    known = master.select("result_id", F.struct(*[c for c in fields if c in master.columns]).alias("m"))
    j = i.join(first, "result_id", "left").join(known, "result_id", "left")
    is_first = F.col("_seq") == F.col("_first")
    new = F.col("m").isNull()
    label = (
        F.when(~is_first & _equal("f", "i"), "duplicate").when(new & is_first, "insert")
        .when(~new & _equal("m", "i"), "skipped").otherwise("conflict")
    )
    return j.select("result_id", "_seq", (~is_first).alias("repeated"), label.alias("outcome"), "i", "f", "m")


def _with_payloads(classified: DataFrame) -> DataFrame:
    """What an incoming row differs in and both rows as text, where a report asks for it."""
    new = F.col("m").isNull()
    diff = F.when(new, _difference("f", "i")).otherwise(_difference("m", "i"))
    payload = F.when(new, F.to_json("f")).otherwise(F.to_json("m"))
    return classified.select("result_id", "_seq", "repeated", "outcome", "i", diff.alias("diff"), payload.alias("master_payload"), F.to_json("i").alias("incoming_payload"))


def _fingerprint(prefix: str) -> Column:
    """128 bits of the compared fields, equal where `_equal` holds: rows meet by these before they meet as rows."""
    numbers = ("stage_number", "stage_length_km", "time_seconds", "diff_seconds")
    fields = [(_comparable(prefix, f) + F.lit(0.0) if f in numbers else _comparable(prefix, f)).alias(f) for f in COMPARE_FIELDS]
    return F.unhex(F.md5(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})))


def _numbered(canonical: DataFrame) -> DataFrame:
    """A canonical batch, written, with the number of each row in ``_row``."""
    return stored(canonical.withColumn("_row", F.monotonically_increasing_id()))


def _labelled(master: DataFrame, batch: DataFrame, order: str) -> DataFrame:
    """The label of each row of a numbered batch as in `classify_incoming`, and its ``_row``: ids and fingerprints are shuffled and
    written, rows are not."""
    own = batch.alias("i").select("i.result_id", F.col(f"i.{order}").alias("_seq"), "i._row", _fingerprint("i").alias("_own"))
    places = own.groupBy("result_id").agg(F.min("_seq").alias("_first"), F.count(F.lit(1)).alias("_sent"))
    i = own.join(places, "result_id")
    first = i.where((F.col("_sent") > 1) & (F.col("_seq") == F.col("_first"))).select("result_id", F.col("_own").alias("_f"))
    known = master.alias("m").select("m.result_id", _fingerprint("m").alias("_m"))
    is_first = F.col("_seq") == F.col("_first")
    new = F.col("_m").isNull()
    label = (
        F.when(~is_first & F.col("_f").eqNullSafe(F.col("_own")), "duplicate").when(new & is_first, "insert")
        .when(~new & (F.col("_m") == F.col("_own")), "skipped").otherwise("conflict")
    )
    j = i.join(first, "result_id", "left").join(known, "result_id", "left")
    return stored(j.select("result_id", "_seq", (~is_first).alias("repeated"), label.alias("outcome"), "_row"))


def _inserted(batch: DataFrame, labelled: DataFrame, order: str) -> DataFrame:
    return batch.join(labelled.where("outcome = 'insert'").select("_row"), "_row").drop("_row", order)


def merge_results(master: DataFrame, incoming: DataFrame, run_id: str, order: str = "seq", recompute: bool = True) -> Merge:
    """Insert new ids, skip equal rows, keep the master and report a conflict for different ones.

    ``incoming`` carries its arrival order in ``order``. With ``recompute`` class, ids, ratio and position of the
    whole table are derived anew. Store ``merged`` as a new version (``sources.tables.replace_table``) before building
    dimensions from it; each of them reads it several times.
    """
    batch = _numbered(canonicalize_results(incoming, run_id, extra=(order,)))
    # Inserted rows, conflicts and counts all read the labels: write them once.
    labelled = _labelled(master, batch, order)
    merged = master.unionByName(_inserted(batch, labelled, order), allowMissingColumns=True)
    if recompute:
        merged = recompute_derived(merged)
    return Merge(merged, _conflicts(master, batch, labelled, order), merge_counts(labelled, run_id, "results_merge"), labelled.drop("_row"))


def _conflicts(master: DataFrame, batch: DataFrame, labelled: DataFrame, order: str) -> DataFrame:
    """The report of the conflicts. Only rows whose id has one are compared field by field."""
    ids = labelled.where("outcome = 'conflict'").select("result_id")
    known, sent = (df.join(ids, "result_id", "left_semi") for df in (master, batch.drop("_row")))
    return _with_payloads(_classified(known, sent, order)).where("outcome = 'conflict'").select(
        F.lit("stage_results").alias("entity_type"), F.col("result_id").alias("entity_key"), F.lit("result_id_payload_mismatch").alias("conflict_type"),
        "master_payload", "incoming_payload", "diff",
    )


def merge_counts(labelled: DataFrame, run_id: str, scope: str) -> DataFrame:
    o = F.col("outcome")
    return labelled.agg(
        F.lit(run_id).alias("merge_run_id"), F.lit(scope).alias("merge_scope"), F.count(F.lit(1)).alias("incoming_rows"),
        F.count_if(o == "insert").alias("inserted_rows"), F.count_if(o == "skipped").alias("skipped_rows"), F.count_if(o == "conflict").alias("conflict_rows"),
        F.count_if(F.col("repeated")).alias("incoming_duplicate_rows"),
    )


def group_keys() -> dict[str, Column]:
    """The stage and the class whose rows share a leader, from a row's own columns."""
    return {
        "stage_id": build_stage_id(F.col("rally_id"), F.col("stage_number")),
        "normalized_class": F.when(F.coalesce("car_class", F.lit("")) == "", "Unknown").otherwise(normalize_class(F.col("car_class"))),
    }


def rederived(df: DataFrame) -> DataFrame:
    """Class, driver, stage and status of every row, from the row alone."""
    raw = F.coalesce("raw_driver_name", "driver_name")
    return df.drop(*DERIVED).withColumns({**group_keys(), "raw_driver_name": raw, "driver_id": build_driver_id(raw), "status": F.coalesce("status", F.lit("FINISHED"))})


def recompute_derived(df: DataFrame, write: bool = False) -> DataFrame:
    """Class, driver, stage, ratio and position for every row; untimed rows keep NULL ratio and position. With ``write`` the rows and
    the leaders are written first, so that names are made once and the leaders join by their size."""
    return _placed(stored(rederived(df)) if write else rederived(df), write)


def _placed(base: DataFrame, write: bool = False) -> DataFrame:
    """Ratio and position of rows that have their class and stage."""
    keys = ("stage_id", "normalized_class")
    best = group_stats(base, keys, {"_best": F.min("time_seconds")}, where=F.col("time_seconds") > 0, write=write)
    timed = F.col("time_seconds") > 0
    rated = best.withColumn("ratio_to_class_best", F.when(timed, F.col("time_seconds") / F.col("_best"))).drop("_best")
    # The places walk the columns they need alone.
    places = class_position(base.select("result_id", "time_seconds", *keys), keys).select("result_id", F.col("class_position").cast("int"))
    return rated.join(places, "result_id", "left")


GROUP = ("stage_id", "normalized_class")
#: The folders of a stored result table. A table keeps the number it was made with.
PARTS = 256


def _home(result_id: Column) -> Column:
    """The rally that an id names: what stands before its first ``_ss``. Rows of another rally are strays."""
    return F.substring_index(result_id, "_ss", 1)


def _part(home: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(home, F.lit(""))), F.lit(parts)).cast("int")


def _strays(df: DataFrame) -> DataFrame:
    """(rally_id, home) of rows that do not lie in the folder of their own rally."""
    rally = F.coalesce("rally_id", F.lit(""))
    return df.select(rally.alias("rally"), _home(F.col("result_id")).alias("home")).where("rally <> home").distinct()


def store_results(df: DataFrame, root: str, parts: int = PARTS) -> None:
    """Store a canonical result table below ``root`` for `merge_stored`: derived columns included, in folders by a hash of the rally
    that the ids name. A large folder is many files, written by many tasks."""
    full = align(recompute_derived(df, write=True), STAGE_RESULTS).withColumn("part", _part(_home(F.col("result_id")), parts))
    full.hint("rebalance", F.col("part")).write.mode("overwrite").partitionBy("part").parquet(f"{root}/results")
    _strays(df).write.mode("overwrite").parquet(f"{root}/strays")


def stored_results(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(T.StructType([*STAGE_RESULTS.fields, T.StructField("part", T.IntegerType())])).parquet(f"{root}/results")


def merge_stored(spark: SparkSession, root: str, incoming: DataFrame, run_id: str, order: str = "seq", parts: int = PARTS) -> Merge:
    """`merge_results` with ``recompute`` on a stored table, in place: the work follows the batch and not the table.

    Read are the folders of the rallies that the batch's ids or rows name. Derived anew are the (stage, class) groups that got a
    row. Written are the folders that hold a row of such a group; their new content is stored beside the table first, so that a
    replacement that broke off can be done again. A batch sent twice changes nothing the second time.

    ``merged`` has the rows of the replaced folders.
    """
    batch = _numbered(canonicalize_results(incoming, run_id, extra=(order,)))
    home = _home(F.col("result_id"))
    strays = spark.read.schema("rally string, home string").parquet(f"{root}/strays")
    rallies = batch.select(F.coalesce("rally_id", F.lit("")).alias("rally")).distinct()
    names = rallies.select(F.col("rally").alias("home")).unionAll(batch.select(home.alias("home"))).unionAll(strays.join(rallies, "rally").select("home"))
    touched = names.select(_part(F.col("home"), parts).alias("part")).distinct()
    read = _in_parts(stored_results(spark, root), touched)
    known = read.drop("part")
    labelled = _labelled(known, batch, order)
    # The report reads the rows of conflicts later, when the folders they are in now have been replaced.
    met = stored(known.drop(*DERIVED).join(labelled.where("outcome = 'conflict'").select("result_id"), "result_id", "left_semi"))
    conflicts = _conflicts(met, batch, labelled, order)
    # A stored row has its own class, stage and driver already; only the inserted ones get theirs.
    inserted = stored(align(rederived(align(_inserted(batch, labelled, order), STAGE_RESULTS)), STAGE_RESULTS).withColumn("part", _part(home, parts)))
    # Rows of a group that got a row, old and new, are derived anew; the other rows of their folders are copied.
    groups = stored(inserted.select(*[F.col(c).alias(f"_{c}") for c in GROUP]).distinct())
    in_group = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in GROUP]
    old = read.join(groups, in_group, "left_semi")
    again = align(_placed(old.unionByName(inserted).drop("part", *DERIVED), write=True), STAGE_RESULTS)
    written = _named(old.select("part").unionAll(inserted.select("part")))
    same = read.where(F.col("part").isin(written)).join(groups, in_group, "left_anti")
    fresh = stored(again.unionByName(align(same, STAGE_RESULTS)).withColumn("part", _part(home, parts)))
    fresh.hint("rebalance", F.col("part")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(f"{root}/results")
    _strays(inserted).write.mode("append").parquet(f"{root}/strays")
    return Merge(fresh.drop("part"), conflicts, merge_counts(labelled, run_id, "results_merge"), labelled.drop("_row"))


def _named(parts: DataFrame) -> list[int]:
    return [r["part"] for r in parts.distinct().collect()]


def _in_parts(table: DataFrame, touched: DataFrame) -> DataFrame:
    """The rows of some folders. There are no more folders than the table was made with, so they are named in the scan, and the
    others' files are not opened."""
    return table.where(F.col("part").isin(_named(touched)))


def append_new(master: DataFrame, incoming: DataFrame, key: str, order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows whose key the master does not have (one per key, the first along ``order``), and the counts."""
    from splitclock.operators.history import first_per_key

    one = first_per_key(incoming, [key], order)
    fresh = one.join(master.select(key), key, "left_anti").select(*incoming.columns)
    saved = fresh.agg(F.count(F.lit(1)).alias("saved"))
    total = incoming.agg(F.count(F.lit(1))).scalar()
    return fresh, saved.withColumn("skipped", total - F.col("saved"))


def merge_upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """New rows replace old ones with the same key; other old rows stay."""
    kept = old.join(new.select(*keys), list(keys), "left_anti")
    return kept.select(*old.columns).unionByName(new, allowMissingColumns=True)
