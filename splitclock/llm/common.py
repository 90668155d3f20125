"""Small helpers the training-data operators share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from splitclock.session import scratch_table

#: What is white space between words: the ASCII blanks, as ``bytes.split()`` takes them.
BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Write a table below the shared folder and read it again, under a name.
written = scratch_table


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A column by name (the first of that name)."""
    return batch.column(batch.schema.get_field_index(name))


def texts(batch: pa.RecordBatch, name: str = "text") -> Iterator[str]:
    """The texts of a batch one by one, NULL as the empty text."""
    for value in column(batch, name):
        yield value.as_py() or ""


def byte_texts(batch: pa.RecordBatch, name: str = "text") -> Iterator[bytes]:
    """The texts of a batch as UTF-8 bytes one by one, NULL as no bytes."""
    col = column(batch, name)
    if pa.types.is_large_string(col.type) or pa.types.is_string(col.type):
        col = col.cast(pa.large_binary())
    for value in col:
        yield value.as_py() or b""


def numbers(batch: pa.RecordBatch, name: str, dtype=np.int64) -> np.ndarray:
    return column(batch, name).to_numpy(zero_copy_only=False).astype(dtype, copy=False)


def whole_keys(batches: Iterable[pa.RecordBatch], keys: list[str], rows: int) -> Iterator[pa.Table]:
    """Join the batches of a partition sorted by ``keys`` into tables of about ``rows`` rows that never cut a key.

    The caller bounds the rows of a key; then a table is bounded too.
    """
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count < rows:
            continue
        table_ = pa.Table.from_batches(held).combine_chunks()
        last = np.zeros(table_.num_rows, bool)
        for k in keys:
            values = table_.column(k).combine_chunks()
            values = values if isinstance(values, pa.Array) else values.chunk(0)
            v = values.to_numpy(zero_copy_only=False)
            last |= v != v[-1]
        ends = int(np.flatnonzero(last)[-1]) + 1 if last.any() else 0
        if ends:
            yield table_.slice(0, ends)
            rest = table_.slice(ends)
            held, count = rest.to_batches(), rest.num_rows
        else:
            held = table_.to_batches()
    if count:
        yield pa.Table.from_batches(held).combine_chunks()


def groups_of(keys: list[np.ndarray]) -> np.ndarray:
    """Where the groups of equal keys start in sorted rows, with the number of rows as the last entry."""
    n = len(keys[0])
    if not n:
        return np.zeros(1, np.int64)
    new = np.ones(n, bool)
    new[1:] = False
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.append(np.flatnonzero(new), n)


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest reachable number of each of 0 .. n-1 over the links (a, b)."""
    label = np.arange(n)
    while len(a):
        la, lb = label[a], label[b]
        open_ = la != lb
        if not open_.any():
            break
        a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label = jumped
    return label
