"""Cohort tables that the queries derive from the given tables, with their SQL twins.

``cohort``: one row per order with 0/1 predictors, two numeric predictors and two labels.
``oof``: long out-of-fold table (run, fold, id, label, y_true, score) over the cohort.
``doc_cohort``: labelled documents with text-derived flags.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumbre.functions.keys import hash_unit

FLAGS = ["urgent", "low_priority", "early", "heavy", "discounted", "many_lines"]
LABELS = ["returned", "open_line"]
NUMERIC = ["amount", "qty"]
RUNS = ["r1", "r2", "r3"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.count(F.lit(1)).alias("n_lines"),
            F.sum("l_quantity").alias("qty"),
            F.max("l_discount").alias("max_discount"),
            F.count_if(F.col("l_returnflag") == "R").alias("n_ret"),
            F.count_if(F.col("l_linestatus") == "O").alias("n_open"),
        )
    )
    orders = table(spark, sf_dir, "orders")

    def flag(condition) -> F.Column:
        return F.coalesce(condition.cast("int"), F.lit(0))

    return orders.join(lines, orders.o_orderkey == lines.l_orderkey, "left").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_totalprice").alias("amount"),
        "qty",
        flag(F.col("o_orderpriority") == "1-URGENT").alias("urgent"),
        flag(F.col("o_orderpriority") == "5-LOW").alias("low_priority"),
        flag(F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp")).alias("early"),
        flag(F.col("qty") > 100).alias("heavy"),
        flag(F.col("max_discount") >= 0.09).alias("discounted"),
        flag(F.col("n_lines") >= 5).alias("many_lines"),
        flag(F.col("n_ret") >= 2).alias("returned"),
        flag(F.col("n_open") >= 3).alias("open_line"),
    )


COHORT_SQL = """
lines AS (
  SELECT l_orderkey, count(*) AS n_lines, sum(l_quantity) AS qty, max(l_discount) AS max_discount,
         sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS n_ret,
         sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS n_open
  FROM lineitem GROUP BY l_orderkey),
cohort AS (
  SELECT o_orderkey AS id, o_totalprice AS amount, qty,
         CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS urgent,
         CASE WHEN o_orderpriority = '5-LOW' THEN 1 ELSE 0 END AS low_priority,
         CASE WHEN o_orderdate < TIMESTAMP '1998-01-01' THEN 1 ELSE 0 END AS early,
         CASE WHEN qty > 100 THEN 1 ELSE 0 END AS heavy,
         CASE WHEN max_discount >= 0.09 THEN 1 ELSE 0 END AS discounted,
         CASE WHEN n_lines >= 5 THEN 1 ELSE 0 END AS many_lines,
         CASE WHEN n_ret >= 2 THEN 1 ELSE 0 END AS returned,
         CASE WHEN n_open >= 3 THEN 1 ELSE 0 END AS open_line
  FROM orders LEFT JOIN lines ON o_orderkey = l_orderkey)
"""


def label_rows(frame: DataFrame, ids: list[str], labels: list[str] = LABELS) -> DataFrame:
    """Wide labels to (ids, label, y_true)."""
    return frame.select(*ids, *labels).unpivot(ids, labels, "label", "y_true")


def oof(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = label_rows(cohort(spark, sf_dir), ["id"])
    runs = long.withColumn("run", F.explode(F.array(*[F.lit(r) for r in RUNS])))
    unit = hash_unit(F.col("run"), F.col("label"), F.col("id"))
    fold = F.floor(hash_unit("fold", F.col("id")) * 5).cast("int") + 1
    score = (F.floor(unit * 800) + 200 * F.col("y_true")) / F.lit(1000.0)
    return runs.select(
        "run", fold.alias("fold"), "id", "label", "y_true", score.alias("score"), (score >= 0.5).cast("int").alias("pred")
    )


def sql_unit(*parts: str) -> str:
    """SQL for the number in [0, 1) of the md5 of the joined parts."""
    text = " || '|' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"(CAST('0x' || substr(md5({text}), 1, 8) AS UBIGINT) / 4294967296.0)"


def sql_md5(*parts: str) -> str:
    text = " || '|' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"md5({text})"


LONG_LABELS_SQL = """
long_labels AS (
  SELECT id, 'returned' AS label, returned AS y_true FROM cohort
  UNION ALL SELECT id, 'open_line', open_line FROM cohort)
"""

OOF_SQL = (
    COHORT_SQL
    + ","
    + LONG_LABELS_SQL
    + f""",
scored AS (
  SELECT run, CAST(floor({sql_unit("'fold'", "id")} * 5) AS INT) + 1 AS fold, id, label, y_true,
         (floor({sql_unit("run", "label", "id")} * 800) + 200 * y_true) / 1000.0 AS score
  FROM long_labels, (SELECT unnest(['r1', 'r2', 'r3']) AS run)),
oof AS (SELECT *, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS pred FROM scored)
"""
)


def doc_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    joined = docs.join(labels, "doc_id")
    return joined.select(
        F.col("doc_id").alias("id"),
        "lang",
        "source",
        F.col("n_chars").cast("double").alias("n_chars"),
        (F.col("lang") == "en").cast("int").alias("english"),
        F.col("text").contains("http").cast("int").alias("has_link"),
        F.col("text").contains("@").cast("int").alias("has_at"),
        F.col("text").contains("\n").cast("int").alias("has_break"),
        "quality",
        "toxic",
    )


DOC_SQL = """
doc_cohort AS (
  SELECT d.doc_id AS id, lang, source, CAST(n_chars AS DOUBLE) AS n_chars,
         CASE WHEN lang = 'en' THEN 1 ELSE 0 END AS english,
         CASE WHEN contains(text, 'http') THEN 1 ELSE 0 END AS has_link,
         CASE WHEN contains(text, '@') THEN 1 ELSE 0 END AS has_at,
         CASE WHEN contains(text, chr(10)) THEN 1 ELSE 0 END AS has_break,
         quality, toxic
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)
"""
DOC_FLAGS = ["english", "has_link", "has_at", "has_break"]
DOC_LABELS = ["quality", "toxic"]
