"""Helpers shared by the operators of this subpackage.

Text always travels as UTF-8 bytes: ``documents(df)`` casts once in the JVM so
that Arrow hands workers bytes and nobody encodes twice.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that are split into words at a time; bounds a worker's word lists.
SLICE_BYTES = 2 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, what: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which driver and executors share.

    Where the session names none, one of this machine is made and set, but only if
    driver and executors are one process; on a cluster that is refused.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, what: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, what)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def held_out(doc_id: str | Column = "doc_id", folds: int = 5) -> Column:
    """Rows that no model learns from: crc32 of the id's text has remainder 0. A null id counts as held out."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % folds == 0, F.lit(True))


def utf8(text: str = "text") -> Column:
    """The text's UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Consecutive rows of the batches with about ``limit`` bytes of text each (one long text may exceed it)."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text)).cast(pa.binary())  # a view, also of strings
        at = 0
        while at < batch.num_rows:
            got, n, end = [], 0, at
            while end < batch.num_rows and (not got or n < limit):
                got.append(column[end].as_py() or b"")
                n += len(got[-1])
                end += 1
            yield batch.slice(at, end - at), got
            at = end


def text_slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """As ``slices``, with the texts as an Arrow array of bytes without nulls."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text)).cast(pa.binary()).fill_null(b"")
        ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            end = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(at, end - at), column.slice(at, end - at)
            at = end


_REMEMBERED: dict = {}


def remembered(what, make):
    """What a worker keeps between tasks, of one operator at a time: another operator's memory is given back first."""
    if what not in _REMEMBERED:
        if _REMEMBERED:
            _REMEMBERED.clear()
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # only where the C library can
                ctypes.CDLL(None).malloc_trim(0)
        _REMEMBERED[what] = make()
    return _REMEMBERED[what]


class Numbering(dict):
    """Numbers things from 0 in the order in which they are first looked up."""

    def __missing__(self, key):
        n = self[key] = len(self)
        return n
