"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: int | str = "*", memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench; on a cluster use the session you are given."""
    n = "8" if cpus == "*" else str(cpus)
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("splitclock")
        .config("spark.sql.shuffle.partitions", n)
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach. The cluster names it in ``spark.checkpoint.dir``; a temporary one is made only
    in local mode, where one machine is the whole cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("name a folder that the driver and all executors share in spark.checkpoint.dir")
    path = tempfile.mkdtemp(prefix="splitclock-")
    spark.sparkContext.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    path = shared_dir(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(path)
    return df.checkpoint(eager=True)


#: Spark's switch that removes the shuffle files of a query when the query has ended.
REMOVE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries that run in here leave no shuffle files: what they wrote is read from its own files. Without this the files of all steps
    stay on disk until the driver collects its garbage."""
    before = spark.conf.get(REMOVE_SHUFFLES, None)
    spark.conf.set(REMOVE_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(REMOVE_SHUFFLES)
        else:
            spark.conf.set(REMOVE_SHUFFLES, before)


#: What was written below the shared folder since the innermost `removed_after` began.
_scopes: list[list[str]] = []


def scratch_table(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it again: the lineage ends there, and lost executors lose nothing."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    if _scopes:
        _scopes[-1].append(path)
    return _written_in(path, [df], compression)


def _written_in(path: str, parts: Iterable[DataFrame], compression: str) -> DataFrame:
    """The rows of ``parts``, written one after the other to one folder; a part's shuffle files leave the disk before the next."""
    for df in parts:
        with shuffles_removed(df.sparkSession):
            df.write.mode("append").option("compression", compression).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def removed_after(spark: SparkSession, work: Callable[[], tuple[DataFrame, list[DataFrame]]]) -> DataFrame:
    """Do ``work``, then remove what it wrote on the way, but for the written tables it names as still read by its result."""
    _scopes.append([])
    try:
        out, kept = work()
    finally:
        paths = _scopes.pop()
    for path in paths:
        if path in {df.scratch for df in kept}:
            if _scopes:
                _scopes[-1].append(path)
            continue
        _remove(spark, path)
    return out


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(*written: DataFrame) -> None:
    """Remove what `stored` wrote and nothing will read again."""
    for df in written:
        _remove(df.sparkSession, df.scratch)


def stored_join(left: DataFrame, right: DataFrame, key: str, parts: int = 4) -> DataFrame:
    """`stored` of the inner join on a number that both sides were written with. It is done in ``parts``, each over all columns of its
    share of the rows, so that the disk holds the shuffled rows of one part and never those of both tables."""
    path = scratch_path(left.sparkSession, "stored")
    if _scopes:
        _scopes[-1].append(path)
    share = F.pmod(F.col(key), F.lit(parts))
    out = _written_in(path, [left.where(share == k).join(right.where(share == k), key) for k in range(parts)], "zstd")
    out._is_stored = True
    return out


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it again. What reads it later takes only its columns.
    What has just been read so is not written a second time."""
    if getattr(df, "_is_stored", False):
        return df
    out = scratch_table(df, "stored", "zstd")
    out._is_stored = True
    return out


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    import uuid

    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
