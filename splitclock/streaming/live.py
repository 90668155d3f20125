"""The live feed as Structured Streaming jobs over result files."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState

from splitclock.operators.facts import class_best, ratio_to_class_best
from splitclock.operators.history import momentum_columns, trend_of
from splitclock.operators.lookups import compare_predictions
from splitclock.plans.predict import LiveHistory, log_predictions, predict_live


def stream_results(spark: SparkSession, folder: str, schema: T.StructType, format: str = "json", files_per_trigger: int | None = None) -> DataFrame:
    """Result rows as they arrive in files; rows without id or time are not results yet."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.format(format).load(folder).where(F.col("result_id").isNotNull() & (F.col("time_seconds") > 0))


def _remember(batch: DataFrame, path: str, batch_id: int) -> None:
    """Store a micro-batch by rally; a repeated batch replaces itself."""
    batch.write.mode("overwrite").partitionBy("rally_id").parquet(f"{path}/batch={batch_id}")


def _remembered(batch: DataFrame, path: str, batch_id: int) -> DataFrame:
    """Stored rows of the rallies that ``batch`` names; other rallies' files are not read."""
    schema = T.StructType([*batch.schema.fields, T.StructField("batch", T.IntegerType())])
    stored = batch.sparkSession.read.schema(schema).parquet(path).where(F.col("batch") <= batch_id)
    return stored.join(batch.select("rally_id").distinct(), "rally_id", "left_semi")


def stream_dedup(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Store results sent for the first time, whenever they arrive: nothing is late, and an id is never forgotten.

    The ids seen are keyed state, one entry for each ``result_id``, so that neither the rally (which may be NULL or change) nor
    what was stored before matters. Of rows with one id in one micro-batch any may be the one that stays.
    """
    return rows.dropDuplicates(["result_id"]).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_class_best(rows: DataFrame) -> DataFrame:
    """Running class leader and finishers per stage, for ``update`` output. State is one row per (stage, class)."""
    return class_best(rows, ("stage_id", "car_class"), driver="driver_id")


def _start(rows: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    return rows.writeStream.outputMode(mode).foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _latest(held: pd.DataFrame, new: pd.DataFrame, by: list[str]) -> pd.DataFrame:
    """One row for each result_id: the last along ``by``; of equal ones the one that came last."""
    both = new if held.empty else pd.concat([held, new], ignore_index=True)
    return both.sort_values(by, kind="stable").drop_duplicates("result_id", keep="last")


def _state_frame(state: GroupState, columns: list[str]) -> pd.DataFrame:
    return pd.DataFrame(dict(zip(columns, state.get, strict=True))) if state.exists else pd.DataFrame({c: [] for c in columns})


def _lists(df: pd.DataFrame, columns: list[str]) -> tuple:
    return tuple([None if pd.isna(v) else v for v in df[c].tolist()] for c in columns)


def _arrays(fields: dict[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, T.ArrayType(t)) for n, t in fields.items()])


def stage_standings(rows: DataFrame, order: str | None = None) -> DataFrame:
    """A stream of changed standings: the ratio to the class leader and the place in class of every result that they changed for.

    State is what is known of a stage, keyed by (rally, stage): one entry for each result. A corrected result replaces its entry
    (the one with the largest ``order`` counts, else the last to arrive; of equal ones in a micro-batch the slowest), also in
    another class, and changes all whose leader or place it changes. The field of a stage bounds a key. ``version`` grows with
    every change of a stage. NULL rallies are a rally of their own.
    """
    kind = {f.name: f.dataType for f in rows.schema.fields}
    fields = {c: kind[c] for c in ("result_id", "driver_id", "stage_number", "car_class", "time_seconds")}
    fields |= {"_order": kind[order] if order else T.LongType(), "ratio_to_class_best": T.DoubleType(), "class_position": T.LongType()}
    names = list(fields)
    out = T.StructType([T.StructField(c, kind[c]) for c in ("rally_id", "driver_id", "result_id", "stage_number")])
    out = out.add("ratio_to_class_best", "double").add("class_position", "long").add("version", "long")

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        columns = [*names, "version"]
        held = _state_frame(state, columns)
        version = int(held["version"].max()) + 1 if len(held) else 0
        new = pd.concat(list(frames), ignore_index=True)
        new = new.assign(_order=new[order] if order else version)[names[:6]].sort_values(["_order", "time_seconds"], kind="stable")
        now = _latest(held[names[:6]], new, ["_order"]).sort_values(["time_seconds", "result_id"], kind="stable")
        in_class = now.groupby("car_class", dropna=False, sort=False)
        now["ratio_to_class_best"] = now["time_seconds"] / in_class["time_seconds"].transform("min")
        now["class_position"] = in_class.cumcount() + 1
        before = held.set_index("result_id")[["ratio_to_class_best", "class_position", "version"]].rename(columns=lambda c: f"_{c}")
        now = now.join(before, on="result_id")
        same = (now["ratio_to_class_best"] == now["_ratio_to_class_best"]) & (now["class_position"] == now["_class_position"])
        now["version"] = now["_version"].where(same, version).astype("int64")
        state.update(_lists(now, columns))
        yield now[~same].assign(rally_id=key[0])[out.fieldNames()]

    keyed = rows.select("rally_id", "stage_id", *dict.fromkeys([*names[:5], *([order] if order else [])])).groupBy("rally_id", "stage_id")
    return keyed.applyInPandasWithState(update, out, _arrays(fields | {"version": T.LongType()}), "append", "NoTimeout")


def rally_form(changes: DataFrame, buckets: int = 8) -> DataFrame:
    """A stream of (driver, rally) rows with the mean ratio, the number of stages and the places that a trend needs, of the
    drivers that ``changes`` (from `stage_standings`) names.

    State is keyed by rally and ``buckets`` parts of its drivers: the newest standing of each of their results.
    """
    kind = {f.name: f.dataType for f in changes.schema.fields}
    names = ["driver_id", "result_id", "stage_number", "ratio_to_class_best", "class_position", "version"]
    out = T.StructType([T.StructField("driver_id", kind["driver_id"]), T.StructField("rally_id", kind["rally_id"])])
    out = out.add("rally_avg", "double").add("stages_analyzed", "long").add("_places", "long").add("_first", "long").add("_last", "long")

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(frames), ignore_index=True)[names]
        now = _latest(_state_frame(state, names), new, ["version"])
        state.update(_lists(now, names))
        touched = now[now["driver_id"].isin(new["driver_id"])].sort_values(["stage_number", "result_id"], kind="stable")
        by = touched.groupby("driver_id", sort=False)
        form = by["ratio_to_class_best"].agg(rally_avg="mean", stages_analyzed="size")
        last3 = by.tail(3).groupby("driver_id", sort=False)["class_position"].agg(_places="size", _first="first", _last="last")
        yield form.join(last3).reset_index().assign(rally_id=key[0])[out.fieldNames()]

    keyed = changes.withColumn("_part", F.pmod(F.xxhash64("driver_id"), F.lit(buckets))).groupBy("rally_id", "_part")
    return keyed.applyInPandasWithState(update, out, _arrays({c: kind[c] for c in names}), "update", "NoTimeout")


def stream_momentum(rows: DataFrame, baselines: DataFrame, root: str, checkpoint: str, order: str | None = None) -> StreamingQuery:
    """Running form per (driver, rally): a late or corrected time changes its class leader and with it everybody's ratio.

    Two streams over keyed state. The first turns results into changed standings, an append-only table below ``root``; the second
    keeps the form of each driver from it and writes, for each of its micro-batches, the drivers whose form changed, to
    ``root/form``. Neither reads what an earlier micro-batch wrote. Drivers without a baseline have no momentum.
    """
    changes = stage_standings(rows, order)
    first = changes.writeStream.format("parquet").option("path", f"{root}/changes").option("checkpointLocation", f"{checkpoint}/changes").trigger(availableNow=True).start()
    first.awaitTermination()

    def handle(batch: DataFrame, batch_id: int) -> None:
        form = batch.withColumn("position_trend", trend_of(F.col("_places"), F.col("_first"), F.col("_last"))).drop("_places", "_first", "_last")
        form = momentum_columns(form.join(baselines.select("driver_id", "baseline_ratio"), "driver_id"))
        form.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{root}/form/batch={batch_id}")

    again = rows.sparkSession.readStream.schema(changes.schema).parquet(f"{root}/changes")
    return _start(rally_form(again), handle, f"{checkpoint}/form", "update")


def stream_compare_predict(rows: DataFrame, requests: DataFrame, history: DataFrame | LiveHistory, root: str, checkpoint: str) -> StreamingQuery:
    """Per micro-batch: close the pending predictions of the stages that came in, then predict each rally's next stage.

    ``requests``: one row per (driver, stage) with the columns of ``predict.predict_live``; ``history`` as there. What `live_history`
    made is not made again for each micro-batch. The log below ``root`` is only appended
    to: a batch writes the predictions it closed and those it made, in `LOG_PARTS` folders by stage, and of earlier rows reads the
    folders of its own stages alone. `newest_log` merges on read; `compact_log` bounds what a reader goes through. A repeated batch replaces
    itself.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        _remember(batch, f"{root}/seen", batch_id)
        # Only what the form is made of is read of all that the rallies have sent, and the leaders go to the rows.
        seen = _remembered(batch, f"{root}/seen", batch_id).select("rally_id", "stage_id", "stage_number", "driver_id", F.col("car_class").alias("normalized_class"), "time_seconds")
        live = ratio_to_class_best(seen, write=True)
        last = batch.groupBy("rally_id").agg(F.max("stage_number").alias("_last"))
        following = requests.join(last, "rally_id").where(F.col("stage_number") == F.col("_last") + 1).drop("_last")
        own = log_predictions(predict_live(following, history, live), "live").withColumns(
            {"actual_time": F.lit(None).cast("double"), "error_pct": F.lit(None).cast("double"), "accepted": F.lit(None).cast("int")}
        )
        if batch_id > 0:
            arrived = batch.select("stage_id").distinct()
            parts = [r["part"] for r in arrived.select(_log_part()).distinct().collect()]
            schema = T.StructType([*own.schema.fields, T.StructField("batch", T.IntegerType()), T.StructField("part", T.IntegerType())])
            before = spark.read.schema(schema).parquet(f"{root}/log").where((F.col("batch") < batch_id) & F.col("part").isin(parts)).drop("part")
            pending = _newest(before.join(arrived, "stage_id", "left_semi")).where("comparison_status = 'pending'")
            actual = batch.select("rally_id", "stage_id", "driver_id", "time_seconds")
            own = own.unionByName(compare_predictions(pending, actual).select(*own.columns))
        own.withColumn("part", _log_part()).hint("rebalance", F.col("part")).write.mode("overwrite").partitionBy("part").parquet(f"{root}/log/batch={batch_id}")

    return _start(rows, handle, checkpoint)


LOG_PARTS = 16


def _log_part() -> Column:
    return F.pmod(F.xxhash64("stage_id"), F.lit(LOG_PARTS)).cast("int").alias("part")


def _log_rows(spark: SparkSession, root: str) -> DataFrame:
    """All rows of the log with their ``batch``."""
    return spark.read.parquet(f"{root}/log").drop("part")


def _newest(log: DataFrame) -> DataFrame:
    """One row for each prediction: a closed one stays; of pending ones the last counts."""
    rank = F.struct(F.col("comparison_status") != "pending", F.col("batch"))
    fields = [c for c in log.columns if c not in ("prediction_id", "batch")]
    return log.groupBy("prediction_id").agg(F.max_by(F.struct(*fields), rank).alias("_r")).select("prediction_id", "_r.*")


def newest_log(spark: SparkSession, root: str) -> DataFrame:
    """The log as it stands: one row for each prediction."""
    return _newest(_log_rows(spark, root))


def compact_log(spark: SparkSession, root: str) -> int:
    """Write the log as it stands to a folder of its own, ``root/log-<n>``, and return n, the last batch in it: a reader of old
    predictions takes that and goes through later batches alone (``compacted_log``)."""
    log = _log_rows(spark, root)
    last = log.agg(F.max("batch")).first()[0]
    _newest(log.where(F.col("batch") <= last)).write.mode("overwrite").parquet(f"{root}/log-{last}")
    return last


def compacted_log(spark: SparkSession, root: str, last: int) -> DataFrame:
    """`newest_log` from the log compacted up to batch ``last`` and the batches after it."""
    old = spark.read.parquet(f"{root}/log-{last}").withColumn("batch", F.lit(last))
    return _newest(old.unionByName(_log_rows(spark, root).where(F.col("batch") > last).select(*old.columns)))
