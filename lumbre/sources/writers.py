"""Sinks: result tables, partitioned folds, run metadata."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumbre.session import ContractError


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_folds(df: DataFrame, path: str, fold: str = "fold", split: str = "split") -> None:
    """One folder per fold and part."""
    df.write.mode("overwrite").partitionBy(fold, split).parquet(path)


def append_fold_rows(df: DataFrame, path: str, run: str = "run") -> None:
    """Append metric rows; readers keep one row per key (``latest_rows``).

    Every call writes a folder of its own, so writers at the same time share no temporary files, and a folder counts from
    the moment its job has committed.
    """
    df.withColumn("written_at", F.current_timestamp()).write.partitionBy(run).parquet(f"{path}/write={uuid.uuid4().hex}")


def committed_writes(spark: SparkSession, path: str) -> list[str]:
    """Folders of appends that have committed."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    marks = jvm.org.apache.hadoop.fs.Path(f"{path}/write=*/_SUCCESS")
    found = marks.getFileSystem(conf).globStatus(marks)
    return sorted(s.getPath().getParent().toString() for s in (found or []))


def latest_rows(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """One row per key of an append-only table: the last one written, so a retried append changes nothing."""
    folders = committed_writes(spark, path)
    if not folders:
        raise ContractError(f"no complete append in {path}")
    rows = spark.read.option("basePath", path).parquet(*folders).drop("write")
    value = F.struct(*[c for c in rows.columns if c not in keys])
    return rows.groupBy(*keys).agg(F.max_by(value, F.struct("written_at", F.xxhash64(value))).alias("v")).select(*keys, "v.*")


def rebuild_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_metadata(spark: SparkSession, path: str, **fields) -> None:
    """One JSON row of run metadata with a timestamp."""
    columns = [F.lit(v).alias(k) for k, v in sorted(fields.items())]
    spark.range(1).select(*columns, F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("created_at")).coalesce(1).write.mode("overwrite").json(path)
