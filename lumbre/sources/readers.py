"""Scans: tables with contracts, separator sniffing, run summaries with an error side table, freshness, content hashes."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumbre.session import ContractError, assert_empty

_CORRUPT = "_corrupt_record"


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, null_value: str = "NaN") -> DataFrame:
    """CSV with header and declared schema; ``NaN`` is null."""
    return spark.read.csv(path, header=True, schema=schema, nullValue=null_value, mode="FAILFAST")


def sniff_separator(spark: SparkSession, path: str, candidates: str = ",;\t|") -> str:
    """Separator that occurs most often in the header line."""
    first = spark.read.text(path).first()
    if first is None:
        raise ContractError(f"empty file: {path}")
    return max(candidates, key=lambda s: (first[0].count(s), -candidates.index(s)))


def read_labels_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV of unknown separator, all columns as text, byte-order mark and blanks removed from the header."""
    raw = spark.read.csv(path, header=True, sep=sniff_separator(spark, path))
    return raw.toDF(*[" ".join(c.replace("﻿", "").split()) for c in raw.columns])


def header_of(spark: SparkSession, path: str) -> list[str]:
    return spark.read.csv(path, header=True).columns


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files under a folder, recursively, each once, with length and modification time; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length", "modificationTime").dropDuplicates(["path"])


def read_run_summaries(
    spark: SparkSession, path: str, schema: T.StructType, pattern: str = "*.json", newer_than: str | None = None, whole_files: bool = False
) -> tuple[DataFrame, DataFrame]:
    """JSON documents, one per line (or per file): (good rows, error rows), each with its file path.

    ``newer_than`` (ISO timestamp) keeps only files written after a launch.
    """
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).option("wholetext", str(whole_files).lower())
    if newer_than:
        reader = reader.option("modifiedAfter", newer_than)
    wanted = T.StructType([*schema.fields, T.StructField(_CORRUPT, T.StringType())])
    parsed = reader.text(path).select(
        F.col("_metadata.file_path").alias("file_path"),
        F.from_json("value", wanted, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}).alias("row"),
    )
    good = parsed.filter(F.col(f"row.{_CORRUPT}").isNull()).select("row.*", "file_path").drop(_CORRUPT)
    bad = parsed.filter(F.col(f"row.{_CORRUPT}").isNotNull()).select("file_path", F.col(f"row.{_CORRUPT}").alias("content"))
    return good, bad


def stale_files(spark: SparkSession, path: str, launched_at: str, pattern: str = "*") -> DataFrame:
    """Files that are older than the launch: a mix of old and new artifacts is an error of the caller's choice."""
    return list_files(spark, path, pattern).filter(F.col("modificationTime") < F.lit(launched_at).cast("timestamp"))


def assert_fresh(spark: SparkSession, path: str, launched_at: str, pattern: str = "*") -> None:
    """A mix of files from before and after a launch is an error."""
    assert_empty(stale_files(spark, path, launched_at, pattern).select("name", "modificationTime"), "files older than the launch")


#: Bytes of a file that one task hashes.
PART_BYTES = 64 * 2**20


def content_parts(spark: SparkSession, path: str, pattern: str = "*", part_bytes: int = PART_BYTES) -> DataFrame:
    """(path, file_length, begin, length, sha256): digests of byte ranges of every file, each read by one task as a stream.

    A range has the lines that begin in its ``part_bytes``; they are read as bytes, so any file can be hashed, and no cell holds more than a line.  The cuts
    depend on the contents and on ``part_bytes`` only.  An empty file has no part, and the scan does not list it.
    """
    # A session of its own: ranges must not depend on the settings, files or cores of the caller's.
    own = spark.newSession()
    for name, value in (("maxPartitionBytes", part_bytes), ("openCostInBytes", part_bytes), ("minPartitionNum", 1)):
        own.conf.set(f"spark.sql.files.{name}", str(value))
    lines = own.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).option("lineSep", "\n").text(path)
    placed = lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("file_length"), F.col("_metadata.file_block_start").alias("begin"), F.col("value").cast("binary").alias("line"))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        key, state, length = None, None, 0
        for batch in batches:
            for path_, size, begin, line in zip(*(batch.column(c).to_pylist() for c in ("path", "file_length", "begin", "line"))):
                if (path_, begin) != key:
                    if key is not None:
                        done.append((key[0], file_length, key[1], length, state.hexdigest()))
                    key, file_length, state, length = (path_, begin), size, sha256(), 0
                state.update(line)
                state.update(b"\n")
                length += len(line) + 1
        if key is not None:
            done.append((key[0], file_length, key[1], length, state.hexdigest()))
        types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate(types)], ["path", "file_length", "begin", "length", "sha256"])

    return placed.mapInArrow(digests, "path string, file_length long, begin long, length long, sha256 string")


def content_hashes(spark: SparkSession, path: str, pattern: str = "*", part_bytes: int = PART_BYTES) -> DataFrame:
    """(name, length, n_parts, sha256) of every input file: the SHA-256 of its length and the digests of its parts in order, so files of any size have one.

    Equal contents have equal hashes, also under other settings of the session.  It is not the SHA-256 of the whole file.
    """
    parts = content_parts(spark, path, pattern, part_bytes)
    listed = parts.groupBy("path", "file_length").agg(F.count(F.lit(1)).alias("n_parts"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("begin", "sha256"))), lambda x: x["sha256"]), "").alias("all"))
    # File listings of two sessions meet by path; every file is one row.
    hashed = listed.select(F.col("path").alias("file"), "n_parts", F.sha2(F.concat_ws(":", F.col("file_length").cast("string"), "all"), 256).alias("sha256"))
    files = list_files(hashed.sparkSession, path, pattern)
    plain = F.regexp_replace(F.col("path"), "^file:/+", "/")
    joined = files.join(hashed, plain == F.regexp_replace(F.col("file"), "^file:/+", "/"))
    return joined.select("name", "length", "n_parts", "sha256")


def readability(spark: SparkSession, path: str, id_column: str, min_bytes: int = 10, pattern: str = "*.csv") -> DataFrame:
    """Per text file: size is not trivial, the id is in the header, and at least one row follows."""
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(path)
    # Lines of a block are numbered in order, and the header is the first line of the first block.
    placed = lines.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("length"), F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("place"))
    per = placed.groupBy("path", "length").agg(F.count_if(F.trim("value") != "").alias("n_lines"), F.min_by("value", "place").alias("header"))
    named = F.array_contains(F.split(F.regexp_replace("header", '^\\x{FEFF}|"', ""), "[,;\t|]"), id_column)
    ok = (F.col("length") >= min_bytes) & named & (F.col("n_lines") >= 2)
    return per.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", "n_lines", ok.cast("int").alias("readable"))


def read_results_table(spark: SparkSession, name: str | None = None, jdbc: dict[str, str] | None = None) -> DataFrame:
    """Stored results from a catalogue table, or through JDBC with the given options."""
    if name:
        return spark.table(name)
    if jdbc:
        return spark.read.format("jdbc").options(**jdbc).load()
    raise ContractError("give a table name or JDBC options")


def split_metadata(files: DataFrame, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """File metadata with every required field, and an error table with the missing fields named."""
    missing = F.array_join(F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in required])), ",")
    marked = files.withColumn("missing", missing)
    return marked.filter("missing = ''").drop("missing"), marked.filter("missing <> ''")
