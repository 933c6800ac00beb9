"""Guards, selections, scans and profiles over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumbre.functions import keys as K
from lumbre.functions import text as X
from lumbre.functions.numeric import rounded
from lumbre.operators import eda as E
from lumbre.operators import joins as J
from lumbre.operators import prepare as P
from lumbre.operators import pu as U
from lumbre.plans.base import COHORT_SQL, FLAGS, cohort, sql_md5, table
from lumbre.plans.registry import query
from lumbre.plans.source_queries import _shared_path
from lumbre.sources import readers as R
from lumbre.sources import writers as W


@query(
    "alignment_guard",
    f"""WITH {COHORT_SQL} SELECT o_orderstatus, count(*) AS n, CAST(sum(returned) AS BIGINT) AS returned FROM cohort JOIN orders ON id = o_orderkey GROUP BY o_orderstatus""",
)
def alignment_guard(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus")
    both = J.aligned(orders, cohort(spark, sf_dir).select("id", "returned"), "id")
    return both.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("returned").cast("bigint")).alias("returned"))


@query("projected_header_scan", "SELECT c_nationkey, count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS keys FROM customer GROUP BY c_nationkey")
def projected_header_scan(spark, sf_dir):
    path = _shared_path(spark, "customer-header")
    W.write_csv(table(spark, sf_dir, "customer").drop("c_acctbal"), path)
    present = [c for c in ("c_custkey", "c_nationkey", "c_acctbal") if c in R.header_of(spark, path)]
    rows = spark.read.csv(path, header=True).select(*[F.col(c).cast("bigint").alias(c) for c in present])
    return rows.groupBy(F.col("c_nationkey").cast("int").alias("c_nationkey")).agg(F.count(F.lit(1)).alias("n"), F.sum("c_custkey").alias("keys"))


@query("catalogue_results", "SELECT s_nationkey, count(*) AS n, round(sum(s_acctbal), 2) AS balance FROM supplier GROUP BY s_nationkey")
def catalogue_results(spark, sf_dir):
    table(spark, sf_dir, "supplier").createOrReplaceTempView("lumbre_supplier_results")
    return R.read_results_table(spark, "lumbre_supplier_results").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n"), rounded(F.sum("s_acctbal"), 2).alias("balance"))


@query("run_metadata_row", "SELECT 'parts' AS kind, count(*) AS n_rows, CAST(max(p_size) AS BIGINT) AS largest, 1 AS dated FROM part")
def run_metadata_row(spark, sf_dir):
    path = _shared_path(spark, "metadata")
    facts = table(spark, sf_dir, "part").agg(F.count(F.lit(1)).alias("n"), F.max("p_size").alias("largest")).first()
    W.write_metadata(spark, path, kind="parts", n_rows=facts["n"], largest=facts["largest"])
    return spark.read.json(path).select("kind", "n_rows", "largest", F.col("created_at").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d$").cast("int").alias("dated"))


@query(
    "selected_columns",
    """SELECT l_returnflag, CAST(sum(l_linenumber) AS BIGINT) AS line_numbers, count(DISTINCT l_linestatus) AS n_status, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY l_returnflag""",
)
def selected_columns(spark, sf_dir):
    rows = P.drop_containing(table(spark, sf_dir, "lineitem"), "key")
    flags = P.select_prefixes(rows, ["l_quantity"], ["l_line", "l_return"])
    chosen = P.select_present(flags, ["l_returnflag", "l_linenumber", "l_linestatus", "l_quantity", "l_absent"])
    return chosen.groupBy("l_returnflag").agg(
        F.sum(F.col("l_linenumber").cast("bigint")).alias("line_numbers"), F.countDistinct("l_linestatus").alias("n_status"), rounded(F.sum("l_quantity"), 2).alias("quantity")
    )


@query(
    "kept_predictors",
    f"""WITH {COHORT_SQL}, l AS ({" UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS v FROM cohort" for c in FLAGS)}),
k AS (SELECT feature, sum(v) AS ones, sum(1 - v) AS zeros FROM l GROUP BY feature) SELECT feature, CAST(ones AS DOUBLE) AS total FROM k WHERE least(ones, zeros) >= 50""",
)
def kept_predictors(spark, sf_dir):
    kept = P.kept_predictors(cohort(spark, sf_dir), ["id"], FLAGS, 50)
    names = [c for c in kept.columns if c != "id"]
    return kept.agg(*[F.sum(c).alias(c) for c in names]).select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("total")) for c in names])))


@query("disjoint_parts", "SELECT count(*) AS n_small, (SELECT count(*) FROM part WHERE p_size > 25) AS n_large FROM part WHERE p_size <= 25")
def disjoint_parts(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    small, large = part.filter("p_size <= 25"), part.filter("p_size > 25")
    J.assert_disjoint(small, large, "p_partkey", "parts on both sides")
    return small.agg(F.count(F.lit(1)).alias("n_small")).join(large.agg(F.count(F.lit(1)).alias("n_large")), how="cross")  # one row on each side


@query("trailing_numbers", "SELECT TRY_CAST(regexp_extract(p_brand, '#(\\d+)', 1) AS INT) AS number, count(*) AS n FROM part GROUP BY 1")
def trailing_numbers(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(X.trailing_number(F.col("p_brand"), "#").alias("number")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "feature_set_variants",
    """WITH o AS (SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY o_custkey), e AS (SELECT user_id, count(*) AS n_events FROM events GROUP BY user_id)
SELECT 'orders' AS variant, count(*) AS n, CAST(coalesce(sum(n_orders), 0) AS BIGINT) AS total FROM customer LEFT JOIN o ON c_custkey = o_custkey
UNION ALL SELECT 'events', count(*), CAST(coalesce(sum(n_events), 0) AS BIGINT) FROM customer LEFT JOIN e ON c_custkey = user_id""",
)
def feature_set_variants(spark, sf_dir):
    base = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    variants = {
        "orders": table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count(F.lit(1)).alias("value")),
        "events": table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id")).agg(F.count(F.lit(1)).alias("value")),
    }
    each = [t.select(F.lit(name).alias("variant"), "value") for name, t in J.feature_sets(base, variants, "id").items()]
    return J.union_tables(each).groupBy("variant").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("value"), F.lit(0)).alias("total"))


@query("header_map_cells", "SELECT event_type, count(*) AS n, CAST(sum(user_id) AS BIGINT) AS users FROM events GROUP BY event_type")
def header_map_cells(spark, sf_dir):
    head = F.concat_ws("\n", F.concat(F.lit("Kind = "), "event_type"), F.lit("no pair"), F.concat(F.lit("user=  "), F.col("user_id").cast("string")))
    cells = table(spark, sf_dir, "events").select(X.header_map(head).alias("m"))
    return cells.groupBy(F.col("m")["Kind"].alias("event_type")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("m")["user"].cast("bigint")).alias("users"))


@query("hash_ordered_subset", f"SELECT p_partkey, p_size FROM part ORDER BY {sql_md5("'11'", 'p_partkey')}, p_partkey LIMIT 40")
def hash_ordered_subset(spark, sf_dir):
    return U.first_in_hash_order(table(spark, sf_dir, "part"), ["p_partkey"], 40, 11).select("p_partkey", "p_size")


_PROFILE = [("doc_id", True), ("text", False), ("lang", False), ("source", False), ("n_chars", True)]


@query(
    "dataset_profile_columns",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) AS n_rows, count(*) - count({c}) AS n_null, count(DISTINCT {c}) AS n_unique, {f"CAST(min({c}) AS DOUBLE)" if n else "CAST(NULL AS DOUBLE)"} AS least,
  {f"CAST(max({c}) AS DOUBLE)" if n else "CAST(NULL AS DOUBLE)"} AS greatest FROM documents"""
        for c, n in _PROFILE
    ),
)
def dataset_profile_columns(spark, sf_dir):
    return E.dataset_profile(table(spark, sf_dir, "documents"), [c for c, _ in _PROFILE])


@query(
    "outlier_share",
    """WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events GROUP BY event_type)
SELECT e.event_type, count(value) AS n, CAST(sum(CASE WHEN value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a) THEN 1 ELSE 0 END) AS BIGINT) AS n_outliers,
  round(sum(CASE WHEN value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a) THEN 1 ELSE 0 END) / CAST(count(value) AS DOUBLE), 9) AS share
FROM events e JOIN q ON e.event_type = q.event_type GROUP BY e.event_type""",
)
def outlier_share(spark, sf_dir):
    return E.outlier_share(table(spark, sf_dir, "events"), ["event_type"], "value").withColumn("share", rounded(F.col("share")))


@query(
    "class_mix_of_grid",
    """WITH c AS (SELECT p_type, p_size, count(*) AS n FROM part GROUP BY ALL), a AS (SELECT p_type, count(*) AS n_all FROM part GROUP BY p_type)
SELECT c.p_type, p_size, n, round(n / CAST(n_all AS DOUBLE), 9) AS share FROM c JOIN a ON c.p_type = a.p_type""",
)
def class_mix_of_grid(spark, sf_dir):
    return E.class_mix(table(spark, sf_dir, "part"), ["p_type"], "p_size").withColumn("share", rounded(F.col("share")))


@query(
    "configuration_defaults",
    """SELECT CASE WHEN p_size % 3 = 0 THEN 'auto' ELSE CAST(p_size AS VARCHAR) END AS depth, p_brand AS model, 'cpu' AS device, count(*) AS n FROM part GROUP BY ALL""",
)
def configuration_defaults(spark, sf_dir):
    given = F.create_map(F.lit("model"), F.col("p_brand"), F.lit("depth"), F.when(F.col("p_size") % 3 != 0, F.col("p_size").cast("string")), F.lit("device"), F.lit("gpu"))
    settings = table(spark, sf_dir, "part").select(K.with_defaults(given, {"depth": "auto", "device": "any"}, {"device": "cpu"}).alias("s"))
    return settings.groupBy(*[F.col("s")[k].alias(k) for k in ("depth", "model", "device")]).agg(F.count(F.lit(1)).alias("n"))


_PRINTS = {
    "region": "r_regionkey r_name", "nation": "n_nationkey n_name n_regionkey", "customer": "c_custkey c_name c_nationkey c_mktsegment", "supplier": "s_suppkey s_name s_nationkey", "part": "p_partkey p_name p_brand p_type p_size",
    "orders": "o_orderkey o_custkey o_orderstatus o_orderpriority", "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_returnflag l_linestatus", "events": "event_id user_id event_type props",
    "documents": "doc_id text lang source n_chars", "embeddings": "vec_id label", "pages": "page_id url html", "benchmark": "item_id text", "labels": "doc_id quality toxic", "conversations": "conv_id turn role text",
}


@query(
    "input_fingerprints",
    " UNION ALL ".join(
        f"""SELECT '{t}' AS "table", count(*) AS n_rows, CAST(sum(CAST('0x' || substr(md5({" || '|' || ".join(f"coalesce(CAST({c} AS VARCHAR), '')" for c in cs.split())}), 1, 8) AS BIGINT)) AS BIGINT) AS fingerprint FROM {t}"""
        for t, cs in _PRINTS.items()
    ),
)
def input_fingerprints(spark, sf_dir):
    """Rows and an order-free sum of row hashes for each table: the same for any files that hold the same rows."""

    def row_hash(columns: list[str]) -> F.Column:
        text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
        return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")

    each = [table(spark, sf_dir, t).agg(F.lit(t).alias("table"), F.count(F.lit(1)).alias("n_rows"), F.sum(row_hash(cs.split())).alias("fingerprint")) for t, cs in _PRINTS.items()]
    return J.union_tables(each)
