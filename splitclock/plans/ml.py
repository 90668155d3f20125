"""Gradient-boosted models over the feature sets, their scores and their explanations."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from splitclock.functions.scoring import clip
from splitclock.operators.aggregates import random_split, regression_metrics
from splitclock.operators.series import with_position
from splitclock.plans.features import CATEGORICAL
from splitclock.session import stored


def boosted_pipeline(
    features: Sequence[str], label: str, categorical: Sequence[str] = (), iterations: int = 300, depth: int = 6, step: float = 0.05, leaf: int = 20, subsample: float = 1.0,
    validation: str | None = None, seed: int = 42, bins: int = 64,
) -> Pipeline:
    """Text columns are indexed (unseen values get an index of their own), everything is one vector, trees follow.
    ``bins`` must be above the number of values of any text column."""
    indexers = [StringIndexer(inputCol=c, outputCol=f"{c}_index", handleInvalid="keep") for c in categorical]
    inputs = [f for f in features if f not in categorical] + [f"{c}_index" for c in categorical]
    assembler = VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="keep")
    trees = GBTRegressor(
        labelCol=label, featuresCol="features", predictionCol="prediction", maxIter=iterations, maxDepth=depth, stepSize=step, minInstancesPerNode=leaf, subsamplingRate=subsample, maxBins=bins, seed=seed,
        checkpointInterval=20,
    )
    if validation:
        trees = trees.setValidationIndicatorCol(validation)
    return Pipeline(stages=[*indexers, assembler, trees])


def _for_boosting(rows: DataFrame) -> DataFrame:
    """The rows in no more parts than the cluster has cores. On every level of every tree each part sends the statistics of all nodes,
    features and bins, however few its rows are: what is shuffled and kept on disk follows the parts, not the rows."""
    return rows.coalesce(rows.sparkSession.sparkContext.defaultParallelism)


def model_inputs(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """The features as a model takes them: numbers with 0 and texts with ``unknown`` for what is missing."""
    numeric = [f for f in features if f not in CATEGORICAL]
    return rows.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in numeric} | {c: F.coalesce(c, F.lit("unknown")) for c in CATEGORICAL if c in features})


def correction_rows(rows: DataFrame, features: Sequence[str], label: str = "correction_factor", key: str = "result_id") -> DataFrame:
    """The rows that a correction model is trained on and judged by, written, with ``split`` and ``_early`` by key hash."""
    filled = model_inputs(rows, features)
    early = F.pmod(F.xxhash64(F.col(key), F.lit(7)), F.lit(10)) == 0
    # Boosting reads its rows once per tree level: write them before.
    return stored(random_split(filled.select(key, label, *features), key).withColumn("_early", early))


def train_correction_model(rows: DataFrame, features: Sequence[str], label: str = "correction_factor", key: str = "result_id", **params) -> tuple[PipelineModel, DataFrame, DataFrame]:
    """Train on 80 % of the rows (by key hash), a tenth of them deciding when to stop. Gives the model, its metrics on
    the other 20 %, and those rows with predictions. ``rows`` may be what `correction_rows` wrote."""
    data = rows if "_early" in rows.columns else correction_rows(rows, features, label, key)
    texts = [c for c in CATEGORICAL if c in features]
    values = data.agg(F.greatest(F.lit(0), F.lit(0), *[F.count_distinct(c) for c in texts])).first()[0]
    pipeline = boosted_pipeline(features, label, texts, validation="_early", bins=max(64, values + 2), **params)
    model = pipeline.fit(_for_boosting(data.where("split = 'train'")))
    held_out = stored(model.transform(data.where("split = 'val'")).select(key, label, *features, "prediction"))
    return model, regression_metrics(held_out, label, "prediction"), held_out


def ratio_rows(matrix: DataFrame, features: Sequence[str], label: str = "ratio_to_class_best") -> DataFrame:
    """The rows that a ratio model is trained on and judged by, written; ``_early`` tells those that decide when to stop."""
    values = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features]
    return stored(matrix.select("result_id", label, "split", *values, (F.col("split") == "val").alias("_early")))


def train_ratio_model(matrix: DataFrame, features: Sequence[str], label: str = "ratio_to_class_best", **params) -> tuple[PipelineModel, DataFrame]:
    """Train on the earliest 70 % of rallies, stop by the next 15 %; metrics on all three parts, clipped to 1..1.35.

    ``matrix`` carries a ``split`` column (see ``aggregates.temporal_split``); it may be what `ratio_rows` wrote. Without validation
    rows the training rows stand in.
    """
    settings = {"iterations": 500, "depth": 8, "step": 0.03, "subsample": 0.8} | params
    data = matrix if "_early" in matrix.columns else ratio_rows(matrix, features, label)
    has_validation = not data.where("split = 'val'").isEmpty()
    fit_on = data.where("split <> 'test'")
    model = boosted_pipeline(features, label, validation="_early" if has_validation else None, **settings).fit(_for_boosting(fit_on))
    scored = stored(model.transform(data).select("split", label, "prediction"))
    metrics = None
    for part in ("train", "val", "test"):
        one = regression_metrics(scored.where(F.col("split") == part), label, "prediction", 1.0, 1.35).withColumn("split", F.lit(part))
        metrics = one if metrics is None else metrics.unionByName(one)
    return model, metrics


def apply_correction(model: PipelineModel, rows: DataFrame, low: float = 0.85, high: float = 1.15) -> DataFrame:
    """Clipped correction for rows with hairpin data; 1.0 and ``fallback`` for the others. A stage without any hairpin
    counts as one without geometry."""
    usable = F.coalesce(F.col("hairpin_density") > 0, F.lit(False))
    scored = model.transform(rows.where(usable)).select(*rows.columns, clip(F.col("prediction"), low, high).alias("geometric_correction"), F.lit("geometric").alias("geometric_mode"))
    rest = rows.where(~usable).select(*rows.columns, F.lit(1.0).alias("geometric_correction"), F.lit("fallback").alias("geometric_mode"))
    return scored.unionByName(rest)


def model_importance(spark: SparkSession, model: PipelineModel) -> DataFrame:
    """Gain importance per feature. The list is as long as the model is wide."""
    names = model.stages[-2].getInputCols()
    values = model.stages[-1].featureImportances.toArray()
    return spark.createDataFrame([(n, float(v)) for n, v in zip(names, values)], "feature STRING, importance DOUBLE")


def top_importance(importance: DataFrame, n: int = 20) -> DataFrame:
    return importance.orderBy(F.col("importance").desc(), "feature").limit(n)


def _shuffled(rows: DataFrame, features: Sequence[str], key: str, seed: int) -> DataFrame:
    """Rows with a second set of feature values taken from another row, as a random permutation of all rows.

    Two hash orders of the keys number the rows independently; joining equal numbers pairs every row with a random
    other one. The numbering is by hash blocks, so no task sees all rows.
    """

    def numbered(df: DataFrame, salt: int) -> DataFrame:
        h = F.xxhash64(F.col(key), F.lit(salt))
        return with_position(df.withColumns({"_h": h, "_b": F.shiftright(h, 52)}), [], ["_h", key], ["_b"], "_place").drop("_h", "_b")

    other = numbered(rows.select(key, F.struct(*features).alias("_other")), seed * 2 + 1).drop(key)
    return numbered(rows, seed * 2).join(other, "_place").drop("_place")


def permutation_importance(model: PipelineModel, rows: DataFrame, features: Sequence[str], label: str, key: str = "result_id", repeats: int = 10) -> DataFrame:
    """Mean loss of R2 when one feature's values are shuffled. Per repeat, each row becomes one copy per feature and
    all copies are scored in one pass. A repeat ends with its losses written, so that its shuffled rows leave the disk before the next."""
    var = rows.agg(F.var_pop(label)).scalar()
    err = (F.col(label) - F.col("prediction")) * (F.col(label) - F.col("prediction"))
    base = model.transform(rows.select(key, label, *features)).agg(F.avg(err)).scalar()
    names = F.array(*[F.lit(f) for f in features])
    out = None
    for seed in range(1, repeats + 1):
        pairs = _shuffled(rows.select(key, label, *features), features, key, seed).withColumn("feature", F.explode(names))
        swapped = pairs.withColumns({f: F.when(F.col("feature") == f, F.col(f"_other.{f}")).otherwise(F.col(f)) for f in features}).drop("_other")
        loss = stored(model.transform(swapped).groupBy("feature").agg(F.avg(err).alias("mse")))
        out = loss if out is None else out.unionByName(loss)
    return out.withColumn("importance", (F.col("mse") - base) / var).groupBy("feature").agg(F.avg("importance").alias("importance"))


def attribution(model: PipelineModel, rows: DataFrame, features: Sequence[str], key: str = "result_id") -> DataFrame:
    """Contribution of each numeric feature to each prediction: how far the prediction moves when the feature is set
    to its mean. A row is scored once more for each feature where it stands; nothing is shuffled.

    These are not Shapley values: contributions of interacting features do not add up to the prediction.
    """
    numeric = [f for f in features if f not in CATEGORICAL]
    means = rows.agg(F.struct(*[F.avg(f).alias(f) for f in numeric])).scalar()
    *prepare, assembler, trees = model.stages
    scored = model.transform(rows.where(F.col(key).isNotNull()).select(key, *features)).withColumn("_mean", means)
    scored = scored.withColumns({f"_mean_{f}": F.col(f"_mean.{f}") for f in numeric}).drop("_mean")
    inputs, kept = assembler.getInputCols(), [key, *numeric, "prediction"]
    for f in numeric:
        moved = assembler.copy().setInputCols([f"_mean_{f}" if c == f else c for c in inputs]).setOutputCol(f"_with_{f}")
        scored = trees.copy().setFeaturesCol(f"_with_{f}").setPredictionCol(f"_p_{f}").transform(moved.transform(scored)).drop(f"_with_{f}")
    scored = scored.select(*kept, *[(F.col("prediction") - F.col(f"_p_{f}")).alias(f"_c_{f}") for f in numeric])
    total = reduce(add, [F.abs(f"_c_{f}") for f in numeric])
    parts = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value"), F.col(f"_c_{f}").alias("contribution")) for f in numeric])
    c = F.col("contribution")
    out = scored.select(key, total.alias("_total"), F.inline(parts))
    return out.select(key, "feature", "value", "contribution", F.coalesce(F.try_divide(F.abs(c) * 100, F.col("_total")), F.lit(0.0)).alias("share_pct"), F.when(c > 0, "increases").otherwise("decreases").alias("direction"))


def top_contributions(attributions: DataFrame, n: int = 5, key: str = "result_id") -> DataFrame:
    """The strongest ``n`` contributions of each sign per prediction."""
    from pyspark.sql import Window as W

    rows = attributions.where("contribution <> 0")
    w = W.partitionBy(key, "direction").orderBy(F.abs("contribution").desc(), "feature")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def save_model(model: PipelineModel, root: str, version: str, metrics: DataFrame) -> str:
    """Write the model and its metrics under a version, and point ``latest`` at it."""
    path = f"{root}/{version}"
    model.write().overwrite().save(f"{path}/model")
    metrics.write.mode("overwrite").json(f"{path}/metrics")
    metrics.sparkSession.createDataFrame([(version,)], "version STRING").coalesce(1).write.mode("overwrite").json(f"{root}/latest")
    return path


def load_model(spark: SparkSession, root: str, version: str | None = None) -> PipelineModel:
    if version is None:
        version = spark.read.schema("version STRING").json(f"{root}/latest").first()["version"]
    return PipelineModel.load(f"{root}/{version}/model")


