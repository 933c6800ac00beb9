"""Sources and sinks: the given tables written to and read back from the shared folder of the cluster."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumbre.functions.numeric import rounded
from lumbre.plans.base import OOF_SQL, table
from lumbre.plans.registry import query
from lumbre.plans.result_queries import FOLD_SQL, fold_metrics
from lumbre.plans.split_queries import _folds, folds_sql
from lumbre.plans.base import COHORT_SQL
from lumbre.session import ensure_checkpoint_dir
from lumbre.sources import readers as R
from lumbre.sources import writers as W
from lumbre.operators.splits import split_table


def _shared_path(spark, name: str) -> str:
    """A fresh folder next to the session's checkpoints, which every executor can reach."""
    ensure_checkpoint_dir(spark)
    context = spark.sparkContext
    path = f"{context.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    # The copy goes when the application ends.
    where.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


@query(
    "csv_round_trip",
    "SELECT c_mktsegment, count(*) AS n, count(c_acctbal) AS n_balance, round(sum(c_acctbal), 2) AS balance FROM (SELECT c_mktsegment, CASE WHEN c_custkey % 9 <> 0 THEN c_acctbal END AS c_acctbal FROM customer) GROUP BY c_mktsegment",
)
def csv_round_trip(spark, sf_dir):
    path = _shared_path(spark, "customer-csv")
    balance = F.when(F.col("c_custkey") % 9 != 0, F.col("c_acctbal").cast("string")).otherwise("NaN")
    W.write_csv(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", balance.alias("c_acctbal")), path)
    back = R.read_csv(spark, path, "c_custkey long, c_mktsegment string, c_acctbal double")
    return back.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.count("c_acctbal").alias("n_balance"), rounded(F.sum("c_acctbal"), 2).alias("balance"))


@query("sniffed_csv_scan", "SELECT n_regionkey AS region_id, count(*) AS n FROM nation GROUP BY n_regionkey")
def sniffed_csv_scan(spark, sf_dir):
    path = _shared_path(spark, "nation-csv")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_regionkey").alias(" region_id "))
    nation.write.csv(path, header=True, sep=";")
    return R.read_labels_csv(spark, path).groupBy(F.col("region_id").cast("int").alias("region_id")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "json_run_summaries",
    """SELECT CASE WHEN event_id % 50 = 0 THEN 'broken' ELSE event_type END AS kind, count(*) AS n, round(sum(CASE WHEN event_id % 50 <> 0 THEN value END), 2) AS total FROM events GROUP BY 1""",
)
def json_run_summaries(spark, sf_dir):
    path = _shared_path(spark, "events-json")
    events = table(spark, sf_dir, "events")
    good = F.to_json(F.struct("event_id", "event_type", "value"))
    events.select(F.when(F.col("event_id") % 50 == 0, F.concat(F.lit("{broken "), good)).otherwise(good).alias("value")).write.text(path)
    schema = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType())])
    rows, errors = R.read_run_summaries(spark, path, schema, "*")
    a = rows.groupBy(F.col("event_type").alias("kind")).agg(F.count(F.lit(1)).alias("n"), rounded(F.sum("value"), 2).alias("total"))
    b = errors.groupBy(F.lit("broken").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.lit(None).cast("double").alias("total"))
    return a.unionByName(b)


@query(
    "partitioned_fold_sink",
    f"""WITH {COHORT_SQL}, {folds_sql()} SELECT CAST(f.f AS INT) AS fold, CASE WHEN fold = f.f THEN 'test' ELSE 'train' END AS split, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids
FROM folds, (SELECT unnest(range(1, 6)) AS f) f GROUP BY ALL""",
)
def partitioned_fold_sink(spark, sf_dir):
    path = _shared_path(spark, "folds")
    W.write_folds(split_table(_folds(spark, sf_dir), ["id"], 5), path)
    return spark.read.parquet(path).groupBy("fold", "split").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))


@query(
    "idempotent_metric_append",
    f"""WITH {OOF_SQL}, {FOLD_SQL} SELECT run, label, count(*) AS n, round(sum(f1), 9) AS f1 FROM fm GROUP BY run, label""",
)
def idempotent_metric_append(spark, sf_dir):
    path = _shared_path(spark, "fold-metrics")
    rows = fold_metrics(spark, sf_dir).select("run", "fold", "label", "f1")
    W.append_fold_rows(rows, path)
    # A writer that failed after its commit tries again with some of its rows.
    W.append_fold_rows(rows.filter("fold < 3"), path)
    kept = W.latest_rows(spark, path, ["run", "fold", "label"])
    return kept.groupBy("run", "label").agg(F.count(F.lit(1)).alias("n"), rounded(F.sum("f1")).alias("f1"))


@query("rebuilt_summary_table", "SELECT p_brand, count(*) AS n, round(avg(p_retailprice), 6) AS mean_price FROM part GROUP BY p_brand")
def rebuilt_summary_table(spark, sf_dir):
    path = _shared_path(spark, "summary")
    part = table(spark, sf_dir, "part")
    summary = part.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), rounded(F.avg("p_retailprice"), 6).alias("mean_price"))
    W.rebuild_table(summary.limit(0), path)
    W.rebuild_table(summary, path)
    return spark.read.parquet(path)


@query(
    "metadata_with_error_table",
    """SELECT CASE WHEN n_chars % 13 = 0 AND n_chars % 2 = 0 THEN 'lang,source' WHEN n_chars % 13 = 0 THEN 'lang' WHEN n_chars % 2 = 0 THEN 'source' ELSE 'complete' END AS missing, count(*) AS n FROM documents GROUP BY 1""",
)
def metadata_with_error_table(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.when(F.col("n_chars") % 13 != 0, F.col("lang")).alias("lang"), F.when(F.col("n_chars") % 2 != 0, F.col("source")).alias("source")
    )
    good, bad = R.split_metadata(docs, ["lang", "source"])
    both = good.select(F.lit("complete").alias("missing")).unionByName(bad.select("missing"))
    return both.groupBy("missing").agg(F.count(F.lit(1)).alias("n"))


@query(
    "fresh_run_summaries",
    "SELECT event_type AS kind, count(*) AS n, round(sum(value), 2) AS total, (SELECT count(*) FROM (SELECT 1) s) AS stale_folders FROM events WHERE event_id % 3 > 0 GROUP BY event_type",
)
def fresh_run_summaries(spark, sf_dir):
    """Summaries written after a launch count; those of an earlier run are found as stale."""
    path, rows = _shared_path(spark, "fresh-summaries"), table(spark, sf_dir, "events")
    as_json = F.to_json(F.struct("event_id", "event_type", "value")).alias("value")
    rows.filter("event_id % 3 = 0").select(as_json).write.text(f"{path}/before")
    launch = F.date_format(F.max("modificationTime") + F.expr("INTERVAL 1 SECOND"), "yyyy-MM-dd'T'HH:mm:ss")
    launched = R.list_files(spark, path, "part-*").agg(launch.alias("t")).first()["t"]
    # Times of files have whole seconds in some stores.
    time.sleep(2)
    rows.filter("event_id % 3 > 0").select(as_json).write.text(f"{path}/after")
    schema = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType())])
    fresh, _ = R.read_run_summaries(spark, path, schema, "part-*", newer_than=launched)
    stale = R.stale_files(spark, path, launched, "part-*").select(F.element_at(F.split("path", "/"), -2).alias("folder")).distinct().agg(F.count(F.lit(1)).alias("stale_folders"))
    return fresh.groupBy(F.col("event_type").alias("kind")).agg(F.count(F.lit(1)).alias("n"), rounded(F.sum("value"), 2).alias("total")).join(F.broadcast(stale), how="cross")  # one row


@query(
    "readable_tables",
    """SELECT 'good' AS kind, count(*) AS n_rows, 1 AS readable FROM part UNION ALL SELECT 'no id', count(*), 0 FROM part UNION ALL SELECT 'no rows', 0, 0""",
)
def readable_tables(spark, sf_dir):
    """Files with the id in their header and rows after it; files without the id; files with a header alone."""
    path, part = _shared_path(spark, "readable"), table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    kinds = {"good": part, "no id": part.withColumnRenamed("p_partkey", "number"), "no rows": part.limit(0)}
    out = None
    for number, (kind, rows) in enumerate(kinds.items()):
        rows.write.option("header", True).csv(f"{path}/{number}")
        found = R.readability(spark, f"{path}/{number}", "p_partkey").agg(F.sum(F.col("n_lines") - 1).alias("n_rows"), F.min("readable").alias("readable"))
        one = found.select(F.lit(kind).alias("kind"), "n_rows", "readable")
        out = one if out is None else out.unionByName(one)
    return out


@query("input_content_hashes")
def input_content_hashes(spark, sf_dir):
    return R.content_hashes(spark, sf_dir, "*.parquet").select("name", "length", "n_parts", "sha256")


@query("file_discovery")
def file_discovery(spark, sf_dir):
    return R.list_files(spark, sf_dir, "*.parquet").select("name", "length")
