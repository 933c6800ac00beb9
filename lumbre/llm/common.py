"""Shared pieces: white space rules, tables in the shared folder, tokeniser files."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumbre.session import ensure_checkpoint_dir

#: White space between words, as a character class body for Java's and Python's regular expressions.
SPACE = r"\x20\x09-\x0D"
WORD = f"[^{SPACE}]+"


def text_of(name: str) -> Column:
    """A text column; null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def shared_path(spark: SparkSession, kind: str) -> str:
    """A new folder's path in the shared checkpoint folder; the folder goes when the application ends."""
    ensure_checkpoint_dir(spark)
    context = spark.sparkContext
    path = f"{context.getCheckpointDir()}/{kind}-{uuid.uuid4().hex}"
    hadoop_path = context._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return path


def shared_table(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet to the shared checkpoint folder and read it back: it cuts lineage, and a lost executor costs the running tasks only."""
    path = shared_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def tokenizer_path(name: str = "piece_bpe_32k.model", folder: str | None = None) -> str:
    """Place of a vocabulary file; ``folder`` overrides the installed one."""
    if folder:
        return f"{folder.rstrip('/')}/{name}"
    import public_tokenizers

    return str(public_tokenizers.path(name))
