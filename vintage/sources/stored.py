"""Intermediate tables that several branches of a plan read: written once to the session's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def stored(df: DataFrame, what: str) -> DataFrame:
    """``df`` written below ``spark.checkpoint.dir`` and read back, so that branches do not repeat its scans; unchanged where the session names no such folder."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        return df
    path = f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shared_folder(spark, what: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which driver and executors share, for tables and streams that queries write.

    Where the session names none, driver and executors have to be one process: a temporary folder then serves both.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"
