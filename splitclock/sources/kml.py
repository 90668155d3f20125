"""Route files (KML, and KMZ archives) as points and properties."""

from __future__ import annotations

import io
import os
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter
from urllib.parse import quote
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINT_ROWS = T.StructType(
    [
        T.StructField("path", T.StringType()), T.StructField("placemark", T.IntegerType()), T.StructField("name", T.StringType()), T.StructField("seq", T.LongType()),
        T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType()), T.StructField("alt", T.DoubleType()), T.StructField("properties", T.MapType(T.StringType(), T.StringType())),
    ]
)


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _document(path: str, content: bytes) -> ElementTree.Element | None:
    """Root of the document, from the archive's first route file where it is one; None for a broken file."""
    try:
        if path.lower().endswith(".kmz"):
            with zipfile.ZipFile(io.BytesIO(content)) as archive:
                inner = [n for n in archive.namelist() if n.endswith(".kml")]
                if not inner:
                    return None
                content = archive.read(inner[0])
        return ElementTree.fromstring(content)
    except (zipfile.BadZipFile, ElementTree.ParseError):
        return None


def _tokens(element: ElementTree.Element) -> Iterator[tuple[float, float, float]]:
    """(lat, lon, alt) of every readable ``lon,lat[,alt]`` below an element; altitude 0 where there is none."""
    for node in element.iter():
        if _local(node.tag) == "coordinates" and node.text:
            for token in node.text.split():
                parts = token.split(",")
                try:
                    yield float(parts[1]), float(parts[0]), float(parts[2]) if len(parts) > 2 else 0.0
                except (ValueError, IndexError):
                    continue


def _name(element: ElementTree.Element, default: str) -> str:
    for node in element.iter():
        if _local(node.tag) == "name" and node.text and node.text.strip():
            return node.text.strip()
    return default


def _properties(element: ElementTree.Element) -> dict[str, str]:
    out = {}
    for node in element.iter():
        if _local(node.tag) == "Data" and node.get("name"):
            value = next((c.text for c in node if _local(c.tag) == "value"), None)
            out[node.get("name")] = (value or "").strip()
        elif _local(node.tag) == "SimpleData" and node.get("name"):
            out[node.get("name")] = (node.text or "").strip()
    return out


def _points(path: str, content: bytes) -> Iterator[tuple]:
    root = _document(path, content)
    if root is None:
        return
    stem = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    marks = [n for n in root.iter() if _local(n.tag) == "Placemark"]
    emitted = False
    for i, mark in enumerate(marks):
        name, props = _name(mark, stem), _properties(mark)
        for seq, (lat, lon, alt) in enumerate(_tokens(mark), start=1):
            emitted = True
            yield path, i, name, seq, lat, lon, alt, props
    if not emitted:
        name = _name(root, stem)
        for seq, (lat, lon, alt) in enumerate(_tokens(root), start=1):
            yield path, 0, name, seq, lat, lon, alt, {}


def kml_points(files: DataFrame) -> DataFrame:
    """Points of every placemark of ``files`` (path, content). A file is read whole in one task."""
    names = POINT_ROWS.fieldNames()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                yield pd.DataFrame(list(_points(path, bytes(content))), columns=names)

    rows = files.select("path", "content").mapInPandas(run, POINT_ROWS)
    return rows.withColumn("route_id", F.concat("path", F.lit("#"), "placemark"))


ROUTE_FILES = r"\.(kml|kmz)$"


def read_route_files(spark: SparkSession, folder: str, pattern: str = ROUTE_FILES) -> DataFrame:
    """Route files of a folder with path and content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.where(F.lower("path").rlike(pattern))


#: Folders that the files of `write_texts` are dealt to; Spark lists so many by a job.
FOLDERS = 64
NO_KEY = "__HIVE_DEFAULT_PARTITION__"


def write_texts(rows: DataFrame, folder: str) -> None:
    """One text file ``<key>=<value>.txt`` for each value of the first column of ``rows``, with a line for each text in the second.

    On a mounted file system tasks write and name the files themselves: Spark's writer makes a folder and starts programs
    for the rights of each file there. In other stores it is Spark's writer, and the files are parts in a folder a key.
    """
    key, line = rows.columns
    where = rows.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
    store = where.getFileSystem(rows.sparkSession._jsc.hadoopConfiguration())
    if store.getUri().getScheme() != "file":
        rows.repartition(key).write.partitionBy(key).text(folder)
        return
    root = where.toUri().getPath()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = 0
        lines = (row for batch in batches for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        for k, own in groupby(lines, itemgetter(0)):
            name = f"{key}={NO_KEY if k is None else quote(str(k), safe='')}.txt"
            to = os.path.join(root, f"{zlib.crc32(name.encode()) % FOLDERS:02d}")
            os.makedirs(to, exist_ok=True)
            begun = os.path.join(to, f".{uuid.uuid4().hex}")  # a task that is run again replaces whole files
            with open(begun, "w", encoding="utf-8", newline="\n") as out:
                out.writelines(f"{text or ''}\n" for _, text in own)
            os.replace(begun, os.path.join(to, name))
            files += 1
        yield pa.record_batch([pa.array([files], pa.int64())], names=["files"])

    os.makedirs(root, exist_ok=True)
    rows.repartition(key).sortWithinPartitions(key).mapInArrow(run, "files long").agg(F.sum("files")).collect()


def unprocessed_files(inventory: DataFrame, log: DataFrame) -> DataFrame:
    """Files of an inventory that the log does not hold with this size and date. ``log``: path, size_kb, modified, status."""
    return inventory.join(log.where("status = 'done'").select("path", "size_kb", "modified"), ["path", "size_kb", "modified"], "left_anti").select(*inventory.columns)


def log_processed(log: DataFrame, files: DataFrame, status: str = "done") -> DataFrame:
    """The log with one row per path, the newest outcome; files seen before get their row replaced."""
    from splitclock.operators.merge import merge_upsert

    return merge_upsert(log, files.select("path", "size_kb", "modified", F.lit(status).alias("status")), ["path"])


def file_inventory(spark: SparkSession, folder: str, pattern: str = ROUTE_FILES) -> DataFrame:
    """Name, size and date of every route file; the contents are not read."""
    files = read_route_files(spark, folder, pattern)
    return files.select(
        F.element_at(F.split("path", "/"), -1).alias("name"), "path", F.round(F.col("length") / 1024, 1).alias("size_kb"), F.to_date("modificationTime").alias("modified")
    )
