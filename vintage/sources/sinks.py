"""Sinks that survive repetition: append-only snapshots and keyed merges with a commit manifest.

Data files are written first, under a name of this attempt; one small manifest
table is written last and names them. What no manifest names was never
committed: readers do not see it. A batch whose number a manifest already has is not written
again, so that a batch or a driver that is run twice changes nothing, whichever step
failed before. Only Spark writes and reads, so any shared store works. One writer at
a time per table.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions.scalars import partition_of

c = F.col
_MANIFEST = "batch string, version long, files string, rows long, dataset_hash string, missing_pct double, buckets map<int, string>"


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Committed batches of a table; none where it does not exist yet."""
    try:
        return spark.read.schema(_MANIFEST).parquet(f"{path}/manifest")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], _MANIFEST)


def dataset_hash(df: DataFrame) -> tuple[Column, Column]:
    """Aggregates for a digest of all rows that does not depend on their order: repeated rows count."""
    row = F.xxhash64(*(c(k) for k in sorted(df.columns))).cast("decimal(38,0)")
    return F.sum(row), F.sum(row * F.pmod(row, F.lit(1_000_003)))


def with_quality(df: DataFrame, features: list[str]) -> DataFrame:
    """``missingness_pct`` and ``quality_score`` of each row over its features."""
    missing = sum((c(k).isNull().cast("int") for k in features), F.lit(0))
    x = df.withColumn("missingness_pct", F.round(missing / max(1, len(features)) * 100, 2))
    return x.withColumn("quality_score", F.round(F.greatest(F.lit(0.0), 100 - c("missingness_pct")), 2))


def _with_bucket(schema: StructType) -> StructType:
    return StructType([*schema.fields, StructField("_bucket", IntegerType())])


def _commit(df: DataFrame, path: str, batch: str, version: int, files: str, buckets: dict[int, str] | None = None) -> None:
    spark = df.sparkSession
    written = spark.read.schema(df.schema).parquet(f"{path}/{files}") if files else df.limit(0)
    missing = sum((c(k).isNull().cast("long") for k in df.columns), F.lit(0).cast("long"))
    a, b = dataset_hash(df)
    got = written.agg(F.count("*").alias("n"), a.alias("a"), b.alias("b"), F.sum(missing).alias("m")).first()
    digest = spark.range(1).select(F.sha2(F.concat_ws("|", F.lit(str(got.n)), F.lit(str(got.a)), F.lit(str(got.b))), 256)).first()[0]
    row = (batch, version, files, got.n, digest, round((got.m or 0) / max(1, got.n * len(df.columns)) * 100, 6), buckets or {})
    spark.createDataFrame([row], _MANIFEST).coalesce(1).write.mode("append").parquet(f"{path}/manifest")


def append_snapshot(df: DataFrame, path: str, batch: str, locked: str | None = None) -> bool:
    """Appends ``df`` as batch ``batch``; False, and nothing changes, if the batch is committed already.

    ``locked``: name of a date column whose rows must not lie in the locked research partition; the write is refused if one does.
    """
    refuse_locked(df, locked)
    known = manifest(df.sparkSession, path)
    if not known.where(c("batch") == batch).isEmpty():
        return False
    files = f"data/{batch}-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{files}")
    _commit(df, path, batch, 0, files)
    return True


def read_snapshots(spark: SparkSession, path: str, schema) -> DataFrame:
    """All committed batches, with their ``batch``."""
    out = None
    for r in manifest(spark, path).select("batch", "files").orderBy("batch").collect():  # one row a batch
        part = spark.read.schema(schema).parquet(f"{path}/{r.files}").withColumn("batch", F.lit(r.batch))
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], schema).withColumn("batch", F.lit(None).cast("string"))


def merge(df: DataFrame, path: str, batch: str, keys: list[str], newest: list[str], buckets: int = 16, locked: str | None = None) -> bool:
    """Merges ``df`` into a table of one row per key: of rows of equal key the last by ``newest`` stays, an incoming row if equal.

    Rows lie in buckets of their key. Only buckets that get rows are written anew, as files of this attempt; the manifest says
    for each bucket which files hold it. A repeated batch changes nothing and gives False.
    """
    refuse_locked(df, locked)
    spark = df.sparkSession
    last = manifest(spark, path).orderBy(c("version").desc()).limit(1).collect()
    if not manifest(spark, path).where(c("batch") == batch).isEmpty():
        return False
    held, version = (dict(last[0].buckets), last[0].version + 1) if last else ({}, 0)
    own = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    incoming = df.withColumns({"_bucket": own, "_new": F.lit(1)})
    touched = [r[0] for r in incoming.select("_bucket").distinct().collect()]  # at most the number of buckets
    files = f"data/{batch}-{uuid.uuid4().hex}"
    for name in {held[b] for b in touched if b in held}:
        which = [b for b in touched if held.get(b) == name]
        old = spark.read.schema(_with_bucket(df.schema)).parquet(f"{path}/{name}").where(c("_bucket").isin(which))
        incoming = incoming.unionByName(old.withColumn("_new", F.lit(0)))
    rows = F.struct(*df.columns)
    latest = incoming.groupBy("_bucket", *(c(k).alias(f"_key_{k}") for k in keys)).agg(F.max_by(rows, F.struct(*newest, "_new")).alias("row")).select("_bucket", "row.*")
    latest.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{path}/{files}")
    _commit(df, path, batch, version, files, held | dict.fromkeys(touched, files))
    return True


def read_merged(spark: SparkSession, path: str, schema) -> DataFrame:
    """The current rows of a merged table."""
    last = manifest(spark, path).orderBy(c("version").desc()).limit(1).collect()
    out = spark.createDataFrame([], schema)
    held = dict(last[0].buckets) if last else {}
    for name in sorted(set(held.values())):
        which = [b for b, f in held.items() if f == name]
        out = out.unionByName(spark.read.schema(_with_bucket(out.schema)).parquet(f"{path}/{name}").where(c("_bucket").isin(which)).drop("_bucket"))
    return out


def refuse_locked(df: DataFrame, column: str | None) -> None:
    """Raises if a row's date lies in the locked out-of-sample partition."""
    if column and not df.where(partition_of(c(column)) == "LOCKED_OOS").limit(1).isEmpty():
        raise PermissionError(f"rows of the locked partition must not change ({column})")


def reconcile_predictions(predictions: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Predictions with the outcome that was recorded for them; the status follows from the join and is never written. Outcomes of unknown predictions are refused by an anti-join of the caller (:func:`orphans`)."""
    first = outcomes.groupBy("prediction_id").agg(F.min_by(F.struct(*(k for k in outcomes.columns if k != "prediction_id")), "resolved_at").alias("o"))
    x = predictions.join(first, "prediction_id", "left")
    return x.select(*predictions.columns, F.when(c("o").isNotNull(), "RESOLVED").otherwise("PENDING").alias("status"), "o.*")


def orphans(predictions: DataFrame, outcomes: DataFrame) -> DataFrame:
    return outcomes.join(predictions.select("prediction_id"), "prediction_id", "left_anti")


def save_calibration(table: DataFrame, path: str) -> None:
    """A calibration table as JSON lines, one file set per save."""
    table.write.mode("overwrite").json(path)


def load_calibration(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)
