"""Cleaning, recoding, selection, joins and set operations over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumbre.functions import keys as K
from lumbre.functions import numeric as N
from lumbre.functions import text as X
from lumbre.functions.numeric import rounded
from lumbre.operators import joins as J
from lumbre.operators import prepare as P
from lumbre.plans.base import COHORT_SQL, FLAGS, LABELS, cohort, table
from lumbre.plans.registry import query

# Multi-label cells built from document columns: blanks, repeats and the missing marker occur.
CELL_SQL = """cells AS (SELECT doc_id, lang, source,
  CASE WHEN n_chars % 7 = 0 THEN 'X' WHEN n_chars % 7 = 1 THEN '' ELSE lang || ' , ' || source || ',' || lang || ' ' END AS cell FROM documents),
parsed AS (SELECT doc_id, lang, source, cell, coalesce((SELECT list(DISTINCT trim(p) ORDER BY trim(p))
  FROM (SELECT unnest(string_split(cell, ',')) AS p) WHERE lower(trim(p)) NOT IN ('', 'x', 'nan', 'none')), []) AS labels FROM cells)"""


def cells(spark, sf_dir):
    rest = F.col("n_chars") % 7
    made = F.when(rest == 0, "X").when(rest == 1, "").otherwise(F.concat("lang", F.lit(" , "), "source", F.lit(","), "lang", F.lit(" ")))
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", made.alias("cell"))


@query(
    "canonical_cells",
    f"WITH {CELL_SQL} SELECT doc_id, array_to_string(labels, ',') AS cell, CAST(len(labels) AS INT) AS n_labels FROM parsed",
)
def canonical_cells(spark, sf_dir):
    return cells(spark, sf_dir).select("doc_id", X.canonical_cell(F.col("cell")).alias("cell"), F.size(X.split_labels(F.col("cell"))).alias("n_labels"))


@query(
    "multi_hot_labels",
    f"""WITH {CELL_SQL}, v AS (SELECT DISTINCT unnest(labels) AS label FROM parsed)
SELECT lang, 'has_' || label AS label, CAST(sum(CASE WHEN list_contains(labels, label) THEN 1 ELSE 0 END) AS BIGINT) AS n FROM parsed, v GROUP BY ALL
UNION ALL SELECT lang, 'no_label', CAST(sum(CASE WHEN len(labels) = 0 THEN 1 ELSE 0 END) AS BIGINT) FROM parsed GROUP BY lang""",
)
def multi_hot_labels(spark, sf_dir):
    rows = cells(spark, sf_dir)
    vocabulary = P.label_vocabulary(rows, "cell")
    hot = P.multi_hot(rows, "cell", vocabulary, "no_label", "has_")
    names = [*("has_" + v for v in vocabulary), "no_label"]
    sums = hot.groupBy("lang").agg(*[F.sum(F.col(c).cast("bigint")).alias(c) for c in names])
    return sums.unpivot(["lang"], names, "label", "n")


@query(
    "three_state_labels",
    f"""WITH {CELL_SQL}, t AS (SELECT CASE WHEN list_contains(labels, 'en') THEN 1 ELSE 0 END AS a,
  CASE WHEN list_contains(labels, 'src1') THEN 1 ELSE 0 END AS b, CASE WHEN len(labels) = 0 THEN 1 ELSE 0 END AS n FROM parsed)
SELECT CASE WHEN a + b + n = 0 THEN 'off_target' ELSE a || '|' || b || '|' || n END AS labelset, count(*) AS n FROM t GROUP BY 1""",
)
def three_state_labels(spark, sf_dir):
    kept, off = P.three_state_labels(cells(spark, sf_dir), "cell", "en", "src1")
    both = kept.select("labelset").unionByName(off.select(F.lit("off_target").alias("labelset")))
    return both.groupBy("labelset").agg(F.count(F.lit(1)).alias("n"))


_ACCENT_SQL = f"regexp_replace(translate(lower(text), '{X.ACCENTED}', '{X.UNACCENTED}'), '\\p{{M}}+', '', 'g')"


@query(
    "normalised_text",
    f"""SELECT doc_id, md5(trim(regexp_replace({_ACCENT_SQL}, '\\s+', ' ', 'g'))) AS normalised_md5,
  length(trim(regexp_replace({_ACCENT_SQL}, '\\s+', ' ', 'g'))) AS n FROM documents""",
)
def normalised_text(spark, sf_dir):
    clean = X.normalise_text(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(clean).alias("normalised_md5"), F.length(clean).cast("bigint").alias("n"))


@query("slug_names", "SELECT page_id, regexp_replace(url, '[^A-Za-z0-9_-]', '_', 'g') AS slug FROM pages")
def slug_names(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.slug(F.col("url")).alias("slug"))


@query(
    "missing_marker_levels",
    """WITH t AS (SELECT CASE WHEN n_chars % 5 = 0 THEN ' X ' WHEN n_chars % 5 = 1 THEN 'NaN' ELSE source END AS raw FROM documents)
SELECT CASE WHEN lower(trim(raw)) IN ('', 'x', 'nan', 'none') THEN 'missing' ELSE trim(raw) END AS level, count(*) AS n FROM t GROUP BY 1""",
)
def missing_marker_levels(spark, sf_dir):
    raw = F.when(F.col("n_chars") % 5 == 0, " X ").when(F.col("n_chars") % 5 == 1, "NaN").otherwise(F.col("source"))
    return table(spark, sf_dir, "documents").groupBy(X.missing_to_null(raw, "missing").alias("level")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "category_recode",
    """SELECT CASE c_mktsegment WHEN 'FURNITURE' THEN 'HOME' WHEN 'HOUSEHOLD' THEN 'HOME' WHEN 'AUTOMOBILE' THEN 'MACHINERY' ELSE c_mktsegment END AS segment,
  count(*) AS n FROM customer GROUP BY 1""",
)
def category_recode(spark, sf_dir):
    merged = X.recode(F.col("c_mktsegment"), {"FURNITURE": "HOME", "HOUSEHOLD": "HOME", "AUTOMOBILE": "MACHINERY"})
    return table(spark, sf_dir, "customer").groupBy(merged.alias("segment")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "two_value_recode",
    """SELECT l_returnflag, CAST(sum(CASE WHEN l_linestatus = 'O' THEN 1 WHEN l_linestatus = 'F' THEN 0 END) AS BIGINT) AS open_lines,
  CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS positives FROM lineitem GROUP BY l_returnflag""",
)
def two_value_recode(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(
        F.sum(X.two_value_recode(F.col("l_linestatus"), "O", "F").cast("bigint")).alias("open_lines"),
        F.sum(X.free_label_binary(F.col("l_returnflag"), "R").cast("bigint")).alias("positives"),
    )


@query(
    "yes_no_parse",
    """WITH t AS (SELECT CASE o_orderstatus WHEN 'F' THEN ' Sí ' WHEN 'O' THEN 'NO' ELSE 'p' END AS raw FROM orders)
SELECT CASE WHEN raw = ' Sí ' THEN 'S' WHEN raw = 'NO' THEN 'N' ELSE 'P' END AS answer, count(*) AS n FROM t GROUP BY 1""",
)
def yes_no_parse(spark, sf_dir):
    raw = F.when(F.col("o_orderstatus") == "F", " Sí ").when(F.col("o_orderstatus") == "O", "NO").otherwise("p")
    return table(spark, sf_dir, "orders").groupBy(X.yes_no(raw).alias("answer")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "numeric_coercion",
    """SELECT lang, count(TRY_CAST(replace(source, 'src', '') AS DOUBLE)) AS n_numeric, count(TRY_CAST(source AS DOUBLE)) AS n_raw_numeric,
  sum(TRY_CAST(replace(source, 'src', '') AS DOUBLE)) AS total FROM documents GROUP BY lang""",
)
def numeric_coercion(spark, sf_dir):
    stripped = N.number(F.regexp_replace("source", "src", ""))
    return table(spark, sf_dir, "documents").groupBy("lang").agg(
        F.count(stripped).alias("n_numeric"), F.count(N.number(F.col("source"))).alias("n_raw_numeric"), F.sum(stripped).alias("total")
    )


@query(
    "json_params",
    """SELECT event_type, CAST(json_extract_string(props, '$.k') AS INT) AS k, count(*) AS n FROM events GROUP BY ALL""",
)
def json_params(spark, sf_dir):
    k = J.params_struct(F.col("props"))["k"].cast("int")
    return table(spark, sf_dir, "events").groupBy("event_type", k.alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "duplicate_configurations",
    """WITH t AS (SELECT props, min(event_id) AS kept, count(*) AS n FROM events GROUP BY props HAVING count(*) > 1)
SELECT sha256('{"k":"' || json_extract_string(props, '$.k') || '"}') AS configuration, n, kept FROM t""",
)
def duplicate_configurations(spark, sf_dir):
    from lumbre.operators.eda import duplicate_configurations as duplicates

    return duplicates(table(spark, sf_dir, "events"), K.canonical_params(F.col("props")), "event_id")


@query(
    "configuration_ids",
    """SELECT p_partkey, sha256('{"p_brand":"' || p_brand || '","p_size":' || p_size || ',"p_type":"' || p_type || '"}') AS config_id FROM part""",
)
def configuration_ids(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", K.configuration_id(["p_type", "p_size", "p_brand"]).alias("config_id"))


@query(
    "paired_seeds",
    """SELECT n_nationkey, CAST(CAST('0x' || substr(sha256('42|' || n_nationkey || '|' || n_name), 1, 8) AS UBIGINT) % 2147483647 AS BIGINT) AS seed FROM nation""",
)
def paired_seeds(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", K.stable_seed(42, F.col("n_nationkey"), F.col("n_name")).alias("seed"))


@query(
    "clinical_grouping",
    f"""WITH {COHORT_SQL} SELECT greatest(urgent, low_priority) AS priority_any, greatest(heavy, many_lines) AS size_any, discounted, count(*) AS n
FROM cohort GROUP BY ALL""",
)
def clinical_grouping(spark, sf_dir):
    grouped = P.group_flags(cohort(spark, sf_dir), {"priority_any": ["urgent", "low_priority"], "size_any": ["heavy", "many_lines"]}, drop=["early"])
    return grouped.groupBy("priority_any", "size_any", "discounted").agg(F.count(F.lit(1)).alias("n"))


@query(
    "row_label_counts",
    f"""WITH {COHORT_SQL} SELECT returned + open_line AS n_labels, CASE WHEN returned + open_line = 0 THEN 1 ELSE 0 END AS none,
  returned || '|' || open_line AS signature, count(*) AS n FROM cohort GROUP BY ALL""",
)
def row_label_counts(spark, sf_dir):
    labels = [F.col(c) for c in LABELS]
    return cohort(spark, sf_dir).groupBy(
        N.row_sum(labels).alias("n_labels"), N.none_of(labels).alias("none"), F.concat_ws("|", *labels).alias("signature")
    ).agg(F.count(F.lit(1)).alias("n"))


_RULES = {
    "small_order": [("qty", "<=", 50.0)],
    "large_urgent": [("qty", ">", 120.0), ("urgent", "==", 1.0)],
    "cheap": [("amount", "<=", 100000.0)],
    "early_discounted": [("early", "==", 1.0), ("discounted", "==", 1.0)],
}


@query(
    "rule_catalogue",
    f"""WITH {COHORT_SQL}, m AS (
  SELECT 'small_order' AS rule_id, id, returned, open_line FROM cohort WHERE qty <= 50
  UNION ALL SELECT 'large_urgent', id, returned, open_line FROM cohort WHERE qty > 120 AND urgent = 1
  UNION ALL SELECT 'cheap', id, returned, open_line FROM cohort WHERE amount <= 100000
  UNION ALL SELECT 'early_discounted', id, returned, open_line FROM cohort WHERE early = 1 AND discounted = 1)
SELECT rule_id, count(*) AS n, CAST(sum(returned) AS BIGINT) AS n_returned, CAST(sum(open_line) AS BIGINT) AS n_open FROM m GROUP BY rule_id""",
)
def rule_catalogue(spark, sf_dir):
    members = P.apply_rule_catalogue(cohort(spark, sf_dir), ["id", *LABELS], _RULES)
    return members.groupBy("rule_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("returned").cast("bigint")).alias("n_returned"), F.sum(F.col("open_line").cast("bigint")).alias("n_open")
    )


@query(
    "predictor_audit",
    f"""WITH {COHORT_SQL}, x AS (SELECT *, CASE WHEN id < 0 THEN 1 END AS never, 7 AS fixed, CASE WHEN id % 400 = 3 THEN 1 ELSE 0 END AS rare FROM cohort),
l AS ({" UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM x" for c in ["amount", "qty", *FLAGS, "never", "fixed", "rare"])}),
s AS (SELECT feature, count(*) - count(value) AS n_missing, count(DISTINCT value) AS n_unique, count(value) AS present,
  count(CASE WHEN value = 1 THEN 1 END) AS ones, count(CASE WHEN value = 0 THEN 1 END) AS zeros FROM l GROUP BY feature),
r AS (SELECT *, CASE WHEN present = 0 THEN 'all_missing' WHEN ones + zeros = present AND least(ones, zeros) < 100 THEN 'rare_binary'
  WHEN ones + zeros <> present AND n_unique < 2 THEN 'constant' ELSE 'kept' END AS reason FROM s)
SELECT feature, CASE WHEN reason = 'kept' THEN 1 ELSE 0 END AS kept, reason, n_missing, n_unique,
  CASE WHEN ones + zeros = present THEN ones END AS n_positive FROM r""",
)
def predictor_audit(spark, sf_dir):
    x = cohort(spark, sf_dir).withColumns(
        {"never": F.when(F.col("id") < 0, 1), "fixed": F.lit(7), "rare": (F.col("id") % 400 == 3).cast("int")}
    )
    return P.predictor_audit(x, ["amount", "qty", *FLAGS, "never", "fixed", "rare"], 100)


@query(
    "column_health",
    f"""WITH {COHORT_SQL}, x AS (SELECT amount, qty, 7.0 AS fixed, CAST(urgent AS DOUBLE) AS urgent FROM cohort),
l AS ({" UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM x" for c in ["amount", "qty", "fixed", "urgent"])})
SELECT feature, count(*) - count(value) AS n_null, CASE WHEN count(value) = 0 THEN 1 ELSE 0 END AS all_null,
  CASE WHEN min(value) = max(value) THEN 1 ELSE 0 END AS constant, CASE WHEN count(*) > count(value) THEN 1 ELSE 0 END AS any_null FROM l GROUP BY feature""",
)
def column_health(spark, sf_dir):
    return P.column_health(cohort(spark, sf_dir).withColumn("fixed", F.lit(7.0)), ["amount", "qty", "fixed", "urgent"])


@query(
    "numeric_feature_columns",
    """SELECT column_name AS feature FROM (DESCRIBE SELECT * FROM orders) WHERE column_type IN ('TINYINT', 'SMALLINT', 'INTEGER', 'BIGINT', 'FLOAT', 'DOUBLE') AND column_name <> 'o_orderkey'""",
)
def numeric_feature_columns(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    names = P.numeric_feature_columns(orders.drop("o_orderdate"), ["o_orderkey"])
    # Names are schema metadata; they are attached to the table they were found in.
    return orders.agg(F.array(*[F.lit(n) for n in names]).alias("f"), F.count(F.lit(1)).alias("n")).select(F.explode("f").alias("feature"))


@query(
    "complete_cases",
    f"WITH {COHORT_SQL} SELECT returned, count(*) AS n, round(sum(qty), 3) AS qty FROM cohort WHERE qty IS NOT NULL AND amount IS NOT NULL GROUP BY returned",
)
def complete_cases(spark, sf_dir):
    return P.complete_cases(cohort(spark, sf_dir), ["qty", "amount"]).groupBy("returned").agg(
        F.count(F.lit(1)).alias("n"), rounded(F.sum("qty"), 3).alias("qty")
    )


@query(
    "exclude_single_label_rows",
    f"""WITH {COHORT_SQL} SELECT CASE WHEN open_line = 1 AND returned = 0 THEN 'excluded' ELSE 'kept' END AS part, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids
FROM cohort GROUP BY 1""",
)
def exclude_single_label_rows(spark, sf_dir):
    kept, gone = P.split_off_only_label(cohort(spark, sf_dir), "open_line", ["returned"])
    both = kept.select(F.lit("kept").alias("part"), "id").unionByName(gone.select(F.lit("excluded").alias("part"), "id"))
    return both.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))


@query(
    "binary_targets",
    "SELECT quality, toxic, count(*) AS n FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY ALL",
)
def binary_targets(spark, sf_dir):
    return P.binary_targets(table(spark, sf_dir, "labels"), ["quality", "toxic"]).groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("n"))


@query(
    "label_mode_derived",
    """WITH l AS (SELECT *, CASE WHEN quality = 0 THEN 1 ELSE 0 END AS stored FROM labels)
SELECT 'include_none' AS mode, quality, toxic, stored AS none, count(*) AS n FROM l GROUP BY ALL UNION ALL SELECT 'exclude_none', quality, toxic, NULL, count(*) FROM l GROUP BY ALL
UNION ALL SELECT 'derive_none', quality, toxic, CASE WHEN quality + toxic = 0 THEN 1 ELSE 0 END, count(*) FROM l GROUP BY ALL""",
)
def label_mode_derived(spark, sf_dir):
    """All modes; the stored label says something else than the derived one."""
    stored = table(spark, sf_dir, "labels").withColumn("none", (F.col("quality") == 0).cast("int"))
    out = None
    for mode in ("include_none", "exclude_none", "derive_none"):
        frame, names = P.label_mode(stored, ["quality", "toxic", "none"], "none", mode)
        one = frame.select(F.lit(mode).alias("mode"), "quality", "toxic", (F.col("none") if "none" in names else F.lit(None).cast("int")).alias("none"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("mode", "quality", "toxic", "none").agg(F.count(F.lit(1)).alias("n"))


@query(
    "renamed_like_columns",
    "SELECT c_mktsegment AS segment, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer GROUP BY c_mktsegment",
)
def renamed_like_columns(spark, sf_dir):
    """Headers with accents, other case, blanks and a byte-order mark are found by their plain names."""
    given = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("\ufeff SÉGMENT  "), F.col("c_acctbal").alias("Bálance  Año"))
    named = P.rename_like(P.rename_like(given, "segment"), "balance", "saldo", "balance ano")
    return named.groupBy("segment").agg(F.count(F.lit(1)).alias("n"), rounded(F.sum("balance"), 2).alias("balance"))


@query(
    "right_split_labels",
    """WITH t AS (SELECT p_name AS x, suffix(p_name, 'e') AS s FROM part UNION ALL SELECT c_name, FALSE FROM customer)
SELECT CASE WHEN contains(x, ' ') THEN regexp_extract(x, '^(.*) [^ ]*$', 1) ELSE x END AS head, CASE WHEN contains(x, ' ') THEN regexp_extract(x, '([^ ]*)$', 1) END AS tail,
  count(*) AS n, count(CASE WHEN s THEN 1 END) AS n_suffix FROM t GROUP BY ALL""",
)
def right_split_labels(spark, sf_dir):
    types = table(spark, sf_dir, "part").select(X.right_split(F.col("p_name"), " ").alias("p"), F.endswith("p_name", F.lit("e")).cast("int").alias("s"))
    names = table(spark, sf_dir, "customer").select(X.right_split(F.col("c_name"), " ").alias("p"), F.lit(0).alias("s"))
    return types.unionByName(names).groupBy("p.head", "p.tail").agg(F.count(F.lit(1)).alias("n"), F.sum("s").alias("n_suffix"))


@query(
    "row_text_search",
    "SELECT p_partkey, p_name, p_brand FROM part WHERE contains(lower(concat_ws(' ', p_partkey, p_name, p_brand, p_type)), 'red') ORDER BY p_retailprice DESC, p_partkey",
)
def row_text_search(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_retailprice")
    hits = P.search_rows(part.drop("p_retailprice"), "red").select("p_partkey")
    return part.join(hits, "p_partkey", "left_semi").orderBy(F.desc("p_retailprice"), "p_partkey").select("p_partkey", "p_name", "p_brand")


@query(
    "variant_filter",
    "SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events WHERE event_type IN ('click', 'view') GROUP BY event_type",
)
def variant_filter(spark, sf_dir):
    return P.keep_variants(table(spark, sf_dir, "events"), "event_type", ["click", "view"]).groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), rounded(F.sum("value"), 2).alias("total")
    )


# ---- joins and set operations -------------------------------------------------------------------


@query(
    "left_join_trimmed_key",
    """SELECT c_mktsegment, count(*) AS n_customers, count(o_orderkey) AS n_orders FROM customer
LEFT JOIN orders ON trim(CAST(c_custkey AS VARCHAR)) = trim(CAST(o_custkey AS VARCHAR)) GROUP BY c_mktsegment""",
)
def left_join_trimmed_key(spark, sf_dir):
    left = table(spark, sf_dir, "customer").select(F.concat(F.col("c_custkey").cast("string"), F.lit("  ")).alias("key"), "c_mktsegment")
    right = table(spark, sf_dir, "orders").select(F.concat(F.lit(" "), F.col("o_custkey").cast("string")).alias("key"), "o_orderkey")
    return J.left_on_trimmed_key(left, right, "key").groupBy("c_mktsegment").agg(
        F.count(F.lit(1)).alias("n_customers"), F.count("o_orderkey").alias("n_orders")
    )


@query(
    "inner_then_left_join",
    """SELECT lang, quality, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars, count(e.label) AS n_embedded, CAST(coalesce(sum(e.label), 0) AS BIGINT) AS classes, count(b.text) AS n_items
FROM documents d JOIN labels l ON d.doc_id = l.doc_id LEFT JOIN embeddings e ON e.vec_id = d.doc_id LEFT JOIN benchmark b ON b.item_id = d.doc_id GROUP BY lang, quality""",
)
def inner_then_left_join(spark, sf_dir):
    """Labelled documents, then what two further tables know of them."""
    embedded = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label").alias("class"))
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.col("text").alias("item"))
    joined = J.inner_then_left(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), table(spark, sf_dir, "labels"), "doc_id", [embedded, items])
    return joined.groupBy("lang", "quality").agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"), F.count("class").alias("n_embedded"), F.coalesce(F.sum(F.col("class").cast("bigint")), F.lit(0)).alias("classes"), F.count("item").alias("n_items")
    )


@query(
    "validated_one_to_one_join",
    "SELECT o_orderstatus, count(*) AS n, round(avg(o_totalprice), 6) AS mean_price FROM orders GROUP BY o_orderstatus",
)
def validated_one_to_one_join(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    joined = J.one_to_one(orders.select("o_orderkey", "o_orderstatus"), orders.select("o_orderkey", "o_totalprice"), "o_orderkey", ["o_totalprice"])
    return joined.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), rounded(F.avg("o_totalprice"), 6).alias("mean_price"))


@query(
    "cascading_join_report",
    """SELECT 'normalised' AS strategy, count(*) AS n_rows, count(DISTINCT d.doc_id) AS n_ids, count(quality) AS n_with_all_targets
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
)
def cascading_join_report(spark, sf_dir):
    features = table(spark, sf_dir, "documents").select(F.format_string("DOC-%08d", "doc_id").alias("doc"))
    labels = table(spark, sf_dir, "labels").select(F.concat(F.lit("doc "), F.format_string("%08d", "doc_id")).alias("label_id"), "quality", "toxic")
    _, report = J.cascading_join(features, labels, "doc", "label_id", ["quality", "toxic"])
    return report


@query(
    "variant_merge",
    """WITH t AS (SELECT user_id, event_type, sum(value) AS total, count(*) AS n FROM events WHERE event_type IN ('click', 'view') GROUP BY ALL)
SELECT user_id, round(max(CASE WHEN event_type = 'click' THEN total END), 2) AS click_total, max(CASE WHEN event_type = 'click' THEN n END) AS click_n,
  round(max(CASE WHEN event_type = 'view' THEN total END), 2) AS view_total, max(CASE WHEN event_type = 'view' THEN n END) AS view_n FROM t GROUP BY user_id""",
)
def variant_merge(spark, sf_dir):
    per = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.sum("value").alias("total"), F.count(F.lit(1)).alias("n"))
    wide = J.merge_variants(per, "user_id", "event_type", ["click", "view"], ["total", "n"])
    return wide.withColumns({c: rounded(F.col(c), 2) for c in ("click_total", "view_total")})


@query(
    "last_non_null_fold",
    """SELECT user_id, arg_max(CASE WHEN event_type = 'click' THEN value END, CASE WHEN event_type = 'click' THEN event_id END) AS last_click,
  arg_max(CASE WHEN event_type = 'view' THEN value END, CASE WHEN event_type = 'view' THEN event_id END) AS last_view FROM events GROUP BY user_id""",
)
def last_non_null_fold(spark, sf_dir):
    wide = table(spark, sf_dir, "events").select(
        "user_id", "event_id", F.when(F.col("event_type") == "click", F.col("value")).alias("last_click"),
        F.when(F.col("event_type") == "view", F.col("value")).alias("last_view"),
    )
    return J.last_non_null(wide, "user_id", "event_id", ["last_click", "last_view"])


@query(
    "key_set_differences",
    """WITH k AS (SELECT doc_id, 'documents' AS t FROM documents UNION ALL SELECT doc_id, 'labels' FROM labels UNION ALL SELECT item_id, 'benchmark' FROM benchmark)
SELECT doc_id, concat_ws(',', CASE WHEN count(CASE WHEN t = 'benchmark' THEN 1 END) = 0 THEN 'benchmark' END,
  CASE WHEN count(CASE WHEN t = 'documents' THEN 1 END) = 0 THEN 'documents' END, CASE WHEN count(CASE WHEN t = 'labels' THEN 1 END) = 0 THEN 'labels' END) AS missing_in
FROM k GROUP BY doc_id HAVING count(DISTINCT t) < 3""",
)
def key_set_differences(spark, sf_dir):
    tables = {
        "documents": table(spark, sf_dir, "documents").select("doc_id"),
        "labels": table(spark, sf_dir, "labels").select("doc_id"),
        "benchmark": table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id")),
    }
    return J.key_differences(tables, "doc_id")


@query(
    "missing_with_reason",
    "SELECT doc_id, 'no label' AS reason FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
)
def missing_with_reason(spark, sf_dir):
    return J.missing_with_reason(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id", "no label")


@query(
    "shared_cohort",
    """SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels INTERSECT SELECT vec_id FROM embeddings""",
)
def shared_cohort(spark, sf_dir):
    return J.shared_cohort(
        [table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "doc_id")], "doc_id"
    )


@query(
    "source_coverage",
    """WITH k AS (SELECT doc_id FROM documents UNION SELECT doc_id FROM labels UNION SELECT page_id FROM pages)
SELECT CASE WHEN doc_id IN (SELECT doc_id FROM documents) THEN 1 ELSE 0 END AS has_documents,
  CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 1 ELSE 0 END AS has_labels,
  CASE WHEN doc_id IN (SELECT page_id FROM pages) THEN 1 ELSE 0 END AS has_pages, count(*) AS n FROM k GROUP BY ALL""",
)
def source_coverage(spark, sf_dir):
    tables = {
        "documents": table(spark, sf_dir, "documents"),
        "labels": table(spark, sf_dir, "labels"),
        "pages": table(spark, sf_dir, "pages").withColumnRenamed("page_id", "doc_id"),
    }
    matrix = J.coverage_matrix(tables, "doc_id")
    return matrix.groupBy("has_documents", "has_labels", "has_pages").agg(F.count(F.lit(1)).alias("n"))


@query(
    "set_differences_both_ways",
    """SELECT doc_id, 'first_only' AS side FROM labels WHERE doc_id NOT IN (SELECT page_id FROM pages)
UNION ALL SELECT page_id, 'second_only' FROM pages WHERE page_id NOT IN (SELECT doc_id FROM labels)""",
)
def set_differences_both_ways(spark, sf_dir):
    return J.set_differences(table(spark, sf_dir, "labels"), table(spark, sf_dir, "pages").withColumnRenamed("page_id", "doc_id"), "doc_id")


@query(
    "id_intersection_and_union",
    """SELECT (SELECT count(*) FROM (SELECT doc_id FROM labels INTERSECT SELECT page_id FROM pages)) AS n_both,
  (SELECT count(*) FROM (SELECT doc_id FROM labels UNION SELECT page_id FROM pages)) AS n_any""",
)
def id_intersection_and_union(spark, sf_dir):
    a = table(spark, sf_dir, "labels").select("doc_id")
    b = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"))
    sides = J.coverage_matrix({"a": a, "b": b}, "doc_id")
    return sides.agg(F.count_if((F.col("has_a") == 1) & (F.col("has_b") == 1)).alias("n_both"), F.count(F.lit(1)).alias("n_any"))


@query(
    "union_all_tables",
    """SELECT kind, count(*) AS n, count(lang) AS n_lang, count(quality) AS n_quality FROM (
  SELECT 'documents' AS kind, lang, NULL AS quality FROM documents UNION ALL SELECT 'labels', NULL, quality FROM labels) GROUP BY kind""",
)
def union_all_tables(spark, sf_dir):
    a = table(spark, sf_dir, "documents").select(F.lit("documents").alias("kind"), "lang")
    b = table(spark, sf_dir, "labels").select(F.lit("labels").alias("kind"), "quality")
    return J.union_tables([a, b]).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count("lang").alias("n_lang"), F.count("quality").alias("n_quality"))


@query("order_preserving_dedup", "SELECT p_brand, min(p_partkey) AS first_position FROM part GROUP BY p_brand")
def order_preserving_dedup(spark, sf_dir):
    return J.ordered_dedup(table(spark, sf_dir, "part"), "p_brand", "p_partkey")


@query(
    "manifest_grid",
    """WITH a AS (SELECT r_name AS target, row_number() OVER (ORDER BY r_name) - 1 AS i FROM region),
b AS (SELECT v AS feature_set, i FROM (VALUES ('clinical', 0), ('combined', 1)) t(v, i)), s AS (SELECT v AS seed, v - 1 AS i FROM (VALUES (1), (2), (3)) t(v))
SELECT CAST((a.i * 2 + b.i) * 3 + s.i AS BIGINT) AS task_id, target, feature_set, CAST(seed AS INT) AS seed, count(n_nationkey) AS n_nations
FROM a CROSS JOIN b CROSS JOIN s JOIN region ON r_name = target LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY ALL""",
)
def manifest_grid(spark, sf_dir):
    regions = table(spark, sf_dir, "region")
    # Axis values of a grid are settings: a bounded list.
    targets = [r[0] for r in regions.select("r_name").orderBy("r_name").collect()]
    grid = J.manifest(spark, {"target": targets, "feature_set": ["clinical", "combined"], "seed": [1, 2, 3]})
    sizes = regions.join(table(spark, sf_dir, "nation"), F.col("n_regionkey") == F.col("r_regionkey"), "left").groupBy("r_name").agg(
        F.count("n_nationkey").alias("n_nations")
    )
    return grid.join(sizes, grid.target == sizes.r_name).select("task_id", "target", "feature_set", "seed", "n_nations")


@query(
    "mask_combinations",
    """WITH s AS (SELECT unnest(range(1, 32)) AS m), t AS (SELECT m, event_type, row_number() OVER (PARTITION BY m ORDER BY event_type) - 1 AS i
  FROM s, (SELECT DISTINCT event_type FROM events))
SELECT string_agg(event_type, '+' ORDER BY event_type) AS combination, CAST(count(*) AS INT) AS size FROM t WHERE (m >> i) & 1 = 1 GROUP BY m""",
)
def mask_combinations(spark, sf_dir):
    kinds = sorted(r[0] for r in table(spark, sf_dir, "events").select("event_type").distinct().collect())
    return J.non_empty_subsets(spark, kinds)


@query(
    "paired_method_deltas",
    """WITH t AS (SELECT r.r_name, n.n_name, l_linestatus AS method, avg(l_discount) AS discount, avg(l_quantity) AS quantity
  FROM lineitem JOIN supplier s ON l_suppkey = s_suppkey JOIN nation n ON s_nationkey = n_nationkey JOIN region r ON n_regionkey = r_regionkey GROUP BY ALL)
SELECT a.r_name, a.n_name, round(a.discount, 9) AS "F_discount", round(b.discount, 9) AS "O_discount", round(b.discount - a.discount, 9) AS delta_discount,
  round(a.quantity, 6) AS "F_quantity", round(b.quantity, 6) AS "O_quantity", round(b.quantity - a.quantity, 6) AS delta_quantity
FROM t a JOIN t b ON a.r_name = b.r_name AND a.n_name = b.n_name AND a.method = 'F' AND b.method = 'O'""",
)
def paired_method_deltas(spark, sf_dir):
    out = J.paired_deltas(method_metrics(spark, sf_dir), ["r_name", "n_name"], "method", "F", "O", ["discount", "quantity"])
    digits = {"F_discount": 9, "O_discount": 9, "delta_discount": 9, "F_quantity": 6, "O_quantity": 6, "delta_quantity": 6}
    return out.select("r_name", "n_name", *[rounded(F.col(c), d).alias(c) for c, d in digits.items()])


def method_metrics(spark, sf_dir):
    """Metric rows per nation and method: the line status plays the role of two compared methods."""
    per_supplier = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", F.col("l_linestatus").alias("method")).agg(
        F.sum("l_discount").alias("d"), F.sum("l_quantity").alias("q"), F.count(F.lit(1)).alias("n")
    )
    places = (
        table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", "n_name", "r_name")
    )
    return per_supplier.join(places, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("r_name", "n_name", "method").agg(
        (F.sum("d") / F.sum("n")).alias("discount"), (F.sum("q") / F.sum("n")).alias("quantity")
    )


@query(
    "common_metric_deltas",
    """WITH t AS (SELECT l_linestatus AS arm, l_returnflag AS run, avg(l_discount) AS discount, avg(l_tax) AS tax FROM lineitem GROUP BY ALL),
l AS (SELECT arm, run, 'discount' AS metric, discount AS value FROM t UNION ALL SELECT arm, run, 'tax', tax FROM t WHERE arm = 'F' OR run <> 'A')
SELECT a.run, a.metric, round(a.value, 9) AS value_a, round(b.value, 9) AS value_b, round(b.value - a.value, 9) AS delta
FROM l a JOIN l b ON a.run = b.run AND a.metric = b.metric AND a.arm = 'F' AND b.arm = 'O'""",
)
def common_metric_deltas(spark, sf_dir):
    wide = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linestatus").alias("arm"), F.col("l_returnflag").alias("run")).agg(
        F.avg("l_discount").alias("discount"), F.avg("l_tax").alias("tax")
    )
    long = wide.unpivot(["arm", "run"], ["discount", "tax"], "metric", "value").filter("metric <> 'tax' OR arm = 'F' OR run <> 'A'")
    out = J.metric_deltas(long.filter("arm = 'F'"), long.filter("arm = 'O'"), ["run"])
    return out.select("run", "metric", *[rounded(F.col(c)).alias(c) for c in ("value_a", "value_b", "delta")])


@query(
    "target_differences",
    """SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'missing in second' ELSE 'different' END AS difference
FROM labels a LEFT JOIN (SELECT doc_id, quality, CASE WHEN doc_id % 10 = 0 THEN 1 - toxic ELSE toxic END AS toxic FROM labels WHERE quality = 1) b ON a.doc_id = b.doc_id
WHERE b.doc_id IS NULL OR a.toxic <> b.toxic""",
)
def target_differences(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    other = labels.filter("quality = 1").withColumn("toxic", F.when(F.col("doc_id") % 10 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    return J.target_differences(labels, other, ["doc_id"], ["quality", "toxic"])
