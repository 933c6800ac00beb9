"""Exploratory statistics over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumbre.functions import numeric as N
from lumbre.functions import text as X
from lumbre.functions.keys import hash_order
from lumbre.functions.numeric import rounded
from lumbre.operators import correlation as C
from lumbre.operators import eda as E
from lumbre.operators.association import melt
from lumbre.operators.ordered import best_row, exact_quantiles, hash_rank, row_rank, top_rows
from lumbre.plans.base import COHORT_SQL, FLAGS, LABELS, cohort, table
from lumbre.plans.prepare_queries import CELL_SQL, cells
from lumbre.plans.registry import query


@query(
    "cohort_integrity",
    """SELECT count(*) AS n_rows, count(DISTINCT o_custkey) AS n_ids, count(*) - count(o_custkey) AS n_null_ids,
  count(o_custkey) - count(DISTINCT o_custkey) AS n_duplicates FROM orders""",
)
def cohort_integrity(spark, sf_dir):
    return E.cohort_integrity(table(spark, sf_dir, "orders"), "o_custkey")


@query(
    "null_counts",
    f"""WITH {COHORT_SQL} SELECT 'amount' AS "column", count(*) - count(amount) AS n_null, count(*) AS n_rows FROM cohort
UNION ALL SELECT 'qty', count(*) - count(qty), count(*) FROM cohort""",
)
def null_counts(spark, sf_dir):
    return E.null_counts(cohort(spark, sf_dir), ["amount", "qty"])


def describe_sql(columns: list[str], source: str) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS sd, CAST(min({c}) AS DOUBLE) AS min,
  round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS q50, round(quantile_cont({c}, 0.75), 6) AS q75, CAST(max({c}) AS DOUBLE) AS max FROM {source}"""
        for c in columns
    )


_DESCRIBED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("describe_numeric", describe_sql(_DESCRIBED, "lineitem"))
def describe_numeric(spark, sf_dir):
    out = E.describe(table(spark, sf_dir, "lineitem"), _DESCRIBED)
    return out.select("feature", "n", *[rounded(F.col(c), 6).alias(c) for c in ("mean", "sd", "q25", "q50", "q75")], "min", "max")


@query(
    "describe_categories",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_unique, arg_max(v, (n, v)) AS top, max(n) AS top_n
  FROM (SELECT {c} AS v, count(*) AS n FROM part GROUP BY {c})"""
        for c in ("p_brand", "p_type", "p_name")
    ),
)
def describe_categories(spark, sf_dir):
    return E.describe_categories(table(spark, sf_dir, "part"), ["p_brand", "p_type", "p_name"])


@query(
    "frequency_table",
    """SELECT p_type AS level, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM part), 6) AS percent FROM part GROUP BY p_type""",
)
def frequency_table(spark, sf_dir):
    return E.frequencies(table(spark, sf_dir, "part"), F.col("p_type")).withColumn("percent", rounded(F.col("percent"), 6))


@query(
    "multi_label_frequency_table",
    f"""WITH {CELL_SQL}, e AS (SELECT unnest(CASE WHEN len(labels) = 0 THEN ['missing'] ELSE labels END) AS level FROM parsed)
SELECT level, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM documents), 6) AS percent FROM e GROUP BY level""",
)
def multi_label_frequency_table(spark, sf_dir):
    return E.frequencies(cells(spark, sf_dir), F.col("cell"), explode_labels=True).withColumn("percent", rounded(F.col("percent"), 6))


@query(
    "group_rates",
    f"""WITH {COHORT_SQL}, g AS (SELECT c.returned, c_mktsegment FROM cohort c JOIN orders o ON c.id = o.o_orderkey JOIN customer ON o_custkey = c_custkey)
SELECT c_mktsegment, count(*) AS n, CAST(sum(returned) AS BIGINT) AS positives, CAST(count(*) - sum(returned) AS BIGINT) AS negatives,
  round(100.0 * sum(returned) / count(*), 6) AS rate_percent FROM g GROUP BY c_mktsegment HAVING count(*) >= 20""",
)
def group_rates(spark, sf_dir):
    segments = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("id"), "c_mktsegment"
    )
    out = E.group_rates(cohort(spark, sf_dir).join(segments, "id"), ["c_mktsegment"], "returned", 20)
    return out.withColumn("rate_percent", rounded(F.col("rate_percent"), 6))


@query(
    "label_summary",
    f"""WITH {COHORT_SQL} SELECT 'returned' AS label, CAST(sum(returned) AS BIGINT) AS support, round(avg(returned), 9) AS share FROM cohort
UNION ALL SELECT 'open_line', CAST(sum(open_line) AS BIGINT), round(avg(open_line), 9) FROM cohort
UNION ALL SELECT 'none', count(CASE WHEN returned + open_line = 0 THEN 1 END), round(avg(CASE WHEN returned + open_line = 0 THEN 1.0 ELSE 0.0 END), 9) FROM cohort""",
)
def label_summary(spark, sf_dir):
    return E.label_summary(cohort(spark, sf_dir), LABELS).withColumn("share", rounded(F.col("share")))


@query(
    "label_coherence",
    f"""WITH {COHORT_SQL} SELECT 'heavy_has_lines' AS "check", count(CASE WHEN NOT (heavy = 0 OR many_lines = 1) THEN 1 END) AS n_violations,
  CASE WHEN count(CASE WHEN NOT (heavy = 0 OR many_lines = 1) THEN 1 END) = 0 THEN 1 ELSE 0 END AS holds FROM cohort
UNION ALL SELECT 'flags_binary', count(CASE WHEN NOT (urgent IN (0, 1) AND urgent + low_priority <= 1) THEN 1 END),
  CASE WHEN count(CASE WHEN NOT (urgent IN (0, 1) AND urgent + low_priority <= 1) THEN 1 END) = 0 THEN 1 ELSE 0 END FROM cohort""",
)
def label_coherence(spark, sf_dir):
    checks = {
        "heavy_has_lines": (F.col("heavy") == 0) | (F.col("many_lines") == 1),
        "flags_binary": F.col("urgent").isin(0, 1) & (F.col("urgent") + F.col("low_priority") <= 1),
    }
    return E.label_coherence(cohort(spark, sf_dir), checks)


@query("labels_per_row", f"WITH {COHORT_SQL} SELECT returned + open_line AS n_labels, count(*) AS n FROM cohort GROUP BY 1")
def labels_per_row(spark, sf_dir):
    return E.labels_per_row(cohort(spark, sf_dir), LABELS)


@query(
    "label_cooccurrence",
    f"WITH {COHORT_SQL} "
    + " UNION ALL ".join(
        f"SELECT '{a}' AS label_a, '{b}' AS label_b, CAST(sum({a} * {b}) AS BIGINT) AS n FROM cohort"
        for a in ("returned", "open_line", "heavy") for b in ("returned", "open_line", "heavy")
    ),
)
def label_cooccurrence(spark, sf_dir):
    return E.label_cooccurrence(cohort(spark, sf_dir), [*LABELS, "heavy"])


@query("label_combinations", f"WITH {COHORT_SQL} SELECT returned || '' || open_line || '' || heavy AS labelset, count(*) AS n FROM cohort GROUP BY 1")
def label_combinations(spark, sf_dir):
    return E.label_combinations(cohort(spark, sf_dir), [*LABELS, "heavy"])


@query("label_cardinality", f"WITH {COHORT_SQL} SELECT round(avg(returned + open_line), 9) AS cardinality, round(avg(returned + open_line) / 2, 9) AS density FROM cohort")
def label_cardinality(spark, sf_dir):
    return E.label_cardinality(cohort(spark, sf_dir), LABELS).select(*[rounded(F.col(c)).alias(c) for c in ("cardinality", "density")])


@query(
    "crosstab_row_normalised",
    """SELECT lang, source, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY lang) AS DOUBLE), 9) AS row_share FROM documents GROUP BY lang, source""",
)
def crosstab_row_normalised(spark, sf_dir):
    return E.crosstab(table(spark, sf_dir, "documents"), "lang", "source").withColumn("row_share", rounded(F.col("row_share")))


@query(
    "count_pivot",
    "SELECT l_returnflag, "
    + ", ".join(f"count(CASE WHEN l_linestatus = '{v}' THEN 1 END) AS n_{v}" for v in "OF") + ", "
    + ", ".join(f"round(100.0 * count(CASE WHEN l_linestatus = '{v}' THEN 1 END) / count(*), 6) AS percent_{v}" for v in "OF")
    + " FROM lineitem GROUP BY l_returnflag",
)
def count_pivot(spark, sf_dir):
    out = E.count_pivot(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus", ["O", "F"])
    return out.withColumns({c: rounded(F.col(c), 6) for c in ("percent_O", "percent_F")})


_MOMENT_SQL = """SELECT {k} count({v}) AS n, round(avg({v}), 6) AS mean, round(stddev_samp({v}), 6) AS sd, min({v}) AS min, round(quantile_cont({v}, 0.25), 6) AS q25,
  round(quantile_cont({v}, 0.5), 6) AS q50, round(quantile_cont({v}, 0.75), 6) AS q75, max({v}) AS max,
  round(quantile_cont({v}, 0.75) - quantile_cont({v}, 0.25), 6) AS iqr,
  round((avg({v} ** 3) - 3 * avg({v}) * avg({v} ** 2) + 2 * avg({v}) ** 3) / stddev_pop({v}) ** 3, 5) AS skewness, round(kurtosis_pop({v}) + 3, 5) AS kurtosis FROM {t}"""


@query("univariate_moments", _MOMENT_SQL.format(k="event_type,", v="value", t="events") + " GROUP BY event_type")
def univariate_moments(spark, sf_dir):
    out = E.moments(table(spark, sf_dir, "events"), ["event_type"], "value")
    return out.select(
        "event_type", "n", "min", "max", *[rounded(F.col(c), 6).alias(c) for c in ("mean", "sd", "q25", "q50", "q75", "iqr")],
        *[rounded(F.col(c), 5).alias(c) for c in ("skewness", "kurtosis")],
    )


@query("univariate_moments_overall", _MOMENT_SQL.format(k="", v="o_totalprice", t="orders").replace("{v}", "o_totalprice"))
def univariate_moments_overall(spark, sf_dir):
    out = E.moments(table(spark, sf_dir, "orders"), [], "o_totalprice")
    return out.select(
        "n", "min", "max", *[rounded(F.col(c), 6).alias(c) for c in ("mean", "sd", "q25", "q50", "q75", "iqr")],
        *[rounded(F.col(c), 5).alias(c) for c in ("skewness", "kurtosis")],
    )


@query(
    "iqr_outliers",
    """WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events GROUP BY event_type)
SELECT event_id, e.event_type, value, round(a - 1.5 * (b - a), 6) AS lower, round(b + 1.5 * (b - a), 6) AS upper FROM events e JOIN q ON e.event_type = q.event_type
WHERE value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)""",
)
def iqr_outliers(spark, sf_dir):
    out = E.iqr_outliers(table(spark, sf_dir, "events"), ["event_type"], "value")
    return out.select("event_id", "event_type", "value", rounded(F.col("lower"), 6).alias("lower"), rounded(F.col("upper"), 6).alias("upper"))


_EDGES = [0.0, 50000.0, 150000.0, 300000.0, 500000.0, 1000000.0]


@query(
    "rates_per_bin",
    f"""WITH {COHORT_SQL}, b AS (SELECT * FROM (VALUES (0, 0.0, 50000.0, '[0, 50000)'), (1, 50000.0, 150000.0, '[50000, 150000)'),
  (2, 150000.0, 300000.0, '[150000, 300000)'), (3, 300000.0, 500000.0, '[300000, 500000)'), (4, 500000.0, 1000000.0, '[500000, 1e+06)')) t(bin_index, lo, hi, bin)),
l AS (SELECT amount, 'returned' AS label, returned AS y FROM cohort UNION ALL SELECT amount, 'open_line', open_line FROM cohort),
k AS (SELECT bin_index, lo, hi, bin, label FROM b, (VALUES ('returned'), ('open_line')) v(label))
SELECT CAST(bin_index AS INT) AS bin_index, bin, count(y) AS n, k.label, round(avg(y), 9) AS rate FROM k LEFT JOIN l ON amount >= lo AND amount < hi AND l.label = k.label GROUP BY ALL""",
)
def rates_per_bin(spark, sf_dir):
    return E.rates_per_bin(cohort(spark, sf_dir), "amount", _EDGES, LABELS).withColumn("rate", rounded(F.col("rate")))


@query(
    "grouped_summary",
    f"""WITH {COHORT_SQL}, l AS (SELECT returned, 'amount' AS feature, amount AS v FROM cohort UNION ALL SELECT returned, 'qty', qty FROM cohort)
SELECT returned, feature, count(v) AS n, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.25), 6) AS q25, round(quantile_cont(v, 0.5), 6) AS q50,
  round(quantile_cont(v, 0.75), 6) AS q75 FROM l GROUP BY returned, feature""",
)
def grouped_summary(spark, sf_dir):
    out = E.grouped_summary(cohort(spark, sf_dir), ["amount", "qty"], ["returned"])
    return out.select("returned", "feature", "n", *[rounded(F.col(c), 6).alias(c) for c in ("mean", "q25", "q50", "q75")])


# ---- correlation over the embedding components ---------------------------------------------------

_DIMS = 64


def embedding_columns(spark, sf_dir):
    """Embedding components as 64 numeric feature columns, with 0/1 class columns."""
    vectors = table(spark, sf_dir, "embeddings")
    return vectors.select(
        "vec_id", "label", *[F.col("embedding")[i].cast("double").alias(f"f{i}") for i in range(_DIMS)],
        (F.col("label") < 5).cast("int").alias("low_class"), (F.col("label") % 2).cast("int").alias("odd_class"),
    )


_FEATURES = [f"f{i}" for i in range(_DIMS)]
_EMB_SQL = f"""emb AS (SELECT vec_id, label, CAST(i AS INT) AS i, CAST(embedding[i + 1] AS DOUBLE) AS v FROM embeddings, range({_DIMS}) t(i)),
pairs AS (SELECT a.i, b.i AS j, 'f' || a.i AS feature_a, 'f' || b.i AS feature_b, count(*) AS n, corr(a.v, b.v) AS r
  FROM emb a JOIN emb b ON a.vec_id = b.vec_id AND a.i < b.i GROUP BY a.i, b.i)"""


def _pairs(spark, sf_dir):
    return C.correlation_pairs(embedding_columns(spark, sf_dir), _FEATURES)


@query("correlation_matrix", f"WITH {_EMB_SQL} SELECT i, j, feature_a, feature_b, n, round(r, 8) AS r FROM pairs")
def correlation_matrix(spark, sf_dir):
    return _pairs(spark, sf_dir).withColumn("r", rounded(F.col("r"), 8))


@query(
    "redundant_columns",
    f"WITH {_EMB_SQL} SELECT feature_b AS feature, count(*) AS n_partners, round(max(abs(r)), 8) AS max_abs_r FROM pairs WHERE abs(r) >= 0.15 GROUP BY feature_b",
)
def redundant_columns(spark, sf_dir):
    return C.redundant_columns(_pairs(spark, sf_dir), 0.15).withColumn("max_abs_r", rounded(F.col("max_abs_r"), 8))


@query(
    "perfect_correlation_columns",
    """SELECT 'gross' AS feature, 'l_extendedprice' AS kept_instead FROM lineitem HAVING corr(l_extendedprice, 2 * l_extendedprice + 1) > 0.999999""",
)
def perfect_correlation_columns(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumn("gross", 2 * F.col("l_extendedprice") + 1)
    return C.perfect_duplicates(C.correlation_pairs(lines, ["l_extendedprice", "l_quantity", "gross", "l_tax"]), 1e-9)


@query(
    "mean_abs_correlation",
    f"""WITH {_EMB_SQL}, s AS (SELECT feature_a AS feature, abs(r) AS a FROM pairs UNION ALL SELECT feature_b, abs(r) FROM pairs)
SELECT feature, round(avg(a), 8) AS mean_abs_r, count(a) AS n_pairs FROM s GROUP BY feature""",
)
def mean_abs_correlation(spark, sf_dir):
    return C.mean_abs_correlation(_pairs(spark, sf_dir)).withColumn("mean_abs_r", rounded(F.col("mean_abs_r"), 8))


@query("correlation_distribution", f"WITH {_EMB_SQL} SELECT CAST(least(floor(abs(r) / 0.1), 9) AS INT) AS band, count(*) AS n_pairs FROM pairs GROUP BY 1")
def correlation_distribution(spark, sf_dir):
    return C.pair_distribution(_pairs(spark, sf_dir))


@query(
    "top_label_correlations",
    f"""WITH {_EMB_SQL}, y AS (SELECT vec_id, 'low_class' AS label, CASE WHEN label < 5 THEN 1 ELSE 0 END AS y FROM embeddings
  UNION ALL SELECT vec_id, 'odd_class', label % 2 FROM embeddings),
c AS (SELECT y.label, 'f' || i AS feature, corr(v, y) AS r, count(*) AS n FROM emb JOIN y ON emb.vec_id = y.vec_id GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY abs(r) DESC, feature) AS rank FROM c)
SELECT label, feature, round(r, 8) AS r, n, CAST(rank AS INT) AS rank FROM k WHERE rank <= 10""",
)
def top_label_correlations(spark, sf_dir):
    pairs = C.correlation_pairs(embedding_columns(spark, sf_dir), [*_FEATURES, "low_class", "odd_class"])
    both = ~(F.col("feature_a").isin("low_class", "odd_class") & F.col("feature_b").isin("low_class", "odd_class"))
    return C.top_label_features(pairs.filter(both), ["low_class", "odd_class"], 10).withColumn("r", rounded(F.col("r"), 8))


@query(
    "high_variance_features",
    f"""WITH {_EMB_SQL}, v AS (SELECT 'f' || i AS feature, var_samp(v) AS variance FROM emb GROUP BY i)
SELECT feature, round(variance, 8) AS variance FROM v ORDER BY variance DESC, feature LIMIT 10""",
)
def high_variance_features(spark, sf_dir):
    long = melt(embedding_columns(spark, sf_dir), [], _FEATURES)
    top = long.groupBy("feature").agg(F.var_samp("value").alias("variance")).orderBy(F.desc("variance"), "feature").limit(10)
    return top.withColumn("variance", rounded(F.col("variance"), 8))


# ---- series metadata: users as patients, event types as series ------------------------------------

SERIES_SQL = """files AS (SELECT event_id, user_id, event_type AS series, CAST(json_extract_string(props, '$.k') AS INT) AS k, value,
  CASE WHEN CAST(json_extract_string(props, '$.k') AS INT) % 11 = 0 THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS INT) // 10 END AS rows_,
  round(value / 10.0, 0) * 1.25 AS position FROM events)"""


def files(spark, sf_dir):
    k = F.from_json("props", "map<string,string>")["k"].cast("int")
    return table(spark, sf_dir, "events").select(
        "event_id", "user_id", F.col("event_type").alias("series"), k.alias("k"), "value",
        F.when(k % 11 != 0, F.floor(k / 10).cast("int")).alias("rows_"),
        (F.round(F.col("value") / 10.0, 0) * 1.25).alias("position"),
    )


@query(
    "series_summary",
    f"""WITH {SERIES_SQL}, c AS (SELECT user_id, series, rows_, count(*) AS c, min(event_id) AS first FROM files WHERE rows_ IS NOT NULL GROUP BY ALL),
m AS (SELECT user_id, series, arg_min(rows_, (-c, first)) AS height, count(*) AS n_heights FROM c GROUP BY user_id, series),
f AS (SELECT user_id, series, count(*) AS n_files, count(rows_) AS n_images, min(event_id) AS example, count(k) - count(DISTINCT k) AS n_duplicate_instances FROM files GROUP BY ALL)
SELECT f.user_id, f.series, n_files, n_images, height, coalesce(n_heights, 0) AS n_heights, CASE WHEN n_heights > 1 THEN 1 ELSE 0 END AS inconsistent,
  example, n_duplicate_instances FROM f LEFT JOIN m ON f.user_id = m.user_id AND f.series = m.series""",
)
def series_summary(spark, sf_dir):
    rows = files(spark, sf_dir)
    keys = ["user_id", "series"]
    heights = E.mode_per_key(rows, keys, "rows_", "event_id").select(*keys, F.col("mode").alias("height"), F.col("n_distinct").alias("n_heights"))
    counts = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_files"), F.count("rows_").alias("n_images"), F.min("event_id").alias("example"),
        (F.count("k") - F.countDistinct("k")).alias("n_duplicate_instances"),
    )
    return counts.join(heights, keys, "left").withColumns(
        {"n_heights": F.coalesce("n_heights", F.lit(0)), "inconsistent": N.flag(F.col("n_heights") > 1)}
    )


GEOMETRY_SQL = """d AS (SELECT user_id, series, round_even(position, 3) AS p, count(*) AS c FROM files GROUP BY ALL),
g AS (SELECT *, p - lag(p) OVER (PARTITION BY user_id, series ORDER BY p) AS gap FROM d),
geo AS (SELECT user_id, series, count(*) AS n_positions, CAST(sum(c) - count(*) AS BIGINT) AS n_duplicates, median(gap) AS median_gap, stddev_pop(gap) AS sd_gap,
  max(p) - min(p) + median(gap) AS coverage FROM g GROUP BY user_id, series)"""


@query(
    "slice_geometry",
    f"WITH {SERIES_SQL}, {GEOMETRY_SQL} SELECT user_id, series, n_positions, n_duplicates, round(median_gap, 6) AS median_gap, round(sd_gap, 6) AS sd_gap, round(coverage, 6) AS coverage FROM geo",
)
def slice_geometry(spark, sf_dir):
    out = E.series_geometry(files(spark, sf_dir), ["user_id", "series"], "position")
    return out.select("user_id", "series", "n_positions", "n_duplicates", *[rounded(F.col(c), 6).alias(c) for c in ("median_gap", "sd_gap", "coverage")])


@query(
    "main_series_selection",
    f"""WITH {SERIES_SQL}, s AS (SELECT user_id, series, count(*) AS n_files, count(rows_) AS n_images, count(DISTINCT position) AS n_positions FROM files GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN n_images = n_files THEN 1 ELSE 0 END DESC, n_images DESC, n_positions DESC, n_files DESC, series) AS place
  FROM s WHERE series <> 'error' AND n_images > 0)
SELECT user_id, series, n_files, n_images, n_positions FROM k WHERE place = 1""",
)
def main_series_selection(spark, sf_dir):
    series = files(spark, sf_dir).groupBy("user_id", "series").agg(
        F.count(F.lit(1)).alias("n_files"), F.count("rows_").alias("n_images"), F.countDistinct("position").alias("n_positions")
    )
    complete = (F.col("n_images") == F.col("n_files")).cast("int")
    candidates = series.filter("series <> 'error' AND n_images > 0")
    return best_row(candidates, ["user_id"], [complete.desc(), F.desc("n_images"), F.desc("n_positions"), F.desc("n_files"), F.col("series")])


@query(
    "series_alerts",
    f"""WITH {SERIES_SQL}, s AS (SELECT user_id, series, count(*) AS n_files, count(rows_) AS n_images, count(k) - count(DISTINCT k) AS dup FROM files GROUP BY ALL)
SELECT user_id, series, concat_ws('; ', CASE WHEN series = 'error' THEN 'other modality' END, CASE WHEN n_images < 5 THEN 'few images' END,
  CASE WHEN dup > 0 THEN 'duplicate instance' END, CASE WHEN n_images < n_files THEN 'missing geometry' END) AS alerts FROM s
WHERE series = 'error' OR n_images < 5 OR dup > 0 OR n_images < n_files""",
)
def series_alerts(spark, sf_dir):
    series = files(spark, sf_dir).groupBy("user_id", "series").agg(
        F.count(F.lit(1)).alias("n_files"), F.count("rows_").alias("n_images"), (F.count("k") - F.countDistinct("k")).alias("dup")
    )
    text = N.alerts(
        {
            "other modality": F.col("series") == "error", "few images": F.col("n_images") < 5, "duplicate instance": F.col("dup") > 0,
            "missing geometry": F.col("n_images") < F.col("n_files"),
        }
    )
    return series.select("user_id", "series", text.alias("alerts")).filter("alerts <> ''")


@query("count_by_shape", "SELECT p_size, p_type, count(*) AS n FROM part GROUP BY p_size, p_type")
def count_by_shape(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_size", "p_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "feature_name_taxonomy",
    """WITH n AS (SELECT lower(p_type) || '_' || replace(p_name, ' ', '_') || '_' || lower(replace(p_brand, '#', '')) AS name FROM part)
SELECT CASE WHEN regexp_extract(name, '^(economy|standard|promo|small|medium|large)_', 1) = '' THEN 'other' ELSE regexp_extract(name, '^(economy|standard|promo|small|medium|large)_', 1) END AS mask,
  CASE WHEN regexp_extract(name, '(?:^|_)(red|blue|green|hot|cold)_', 1) = '' THEN 'other' ELSE regexp_extract(name, '(?:^|_)(red|blue|green|hot|cold)_', 1) END AS channel,
  CASE WHEN regexp_extract(name, '_(ring|widget|bolt|gear|gizmo)_', 1) = '' THEN 'other' ELSE regexp_extract(name, '_(ring|widget|bolt|gear|gizmo)_', 1) END AS family,
  count(*) AS n FROM n GROUP BY ALL""",
)
def feature_name_taxonomy(spark, sf_dir):
    name = F.concat_ws("_", F.lower("p_type"), F.regexp_replace("p_name", " ", "_"), F.lower(F.regexp_replace("p_brand", "#", "")))
    parts = X.feature_name_parts(
        name, ["economy", "standard", "promo", "small", "medium", "large"], ["red", "blue", "green", "hot", "cold"], ["ring", "widget", "bolt", "gear", "gizmo"]
    )
    return table(spark, sf_dir, "part").select(parts.alias("p")).groupBy("p.mask", "p.channel", "p.family").agg(F.count(F.lit(1)).alias("n"))


@query(
    "class_ratio",
    f"""WITH {COHORT_SQL} SELECT 'returned' AS label, CAST(sum(returned) AS BIGINT) AS positives, CAST(sum(1 - returned) AS BIGINT) AS negatives,
  round(sum(1 - returned) / CAST(sum(returned) AS DOUBLE), 9) AS positive_weight FROM cohort
UNION ALL SELECT 'open_line', CAST(sum(open_line) AS BIGINT), CAST(sum(1 - open_line) AS BIGINT), round(sum(1 - open_line) / CAST(sum(open_line) AS DOUBLE), 9) FROM cohort""",
)
def class_ratio(spark, sf_dir):
    return E.class_ratio(cohort(spark, sf_dir), LABELS).withColumn("positive_weight", rounded(F.col("positive_weight")))


@query("any_positive_dedup", "SELECT o_custkey, max(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS positive, count(*) AS n_rows FROM orders GROUP BY o_custkey")
def any_positive_dedup(spark, sf_dir):
    return E.any_positive(table(spark, sf_dir, "orders"), "o_custkey", F.col("o_orderstatus") == "F")


@query(
    "dataset_profile",
    """SELECT count(*) AS n_rows, count(DISTINCT source) AS n_sources, count(DISTINCT lang) AS n_langs, CAST(sum(n_chars) AS BIGINT) AS n_chars,
  count(*) - count(text) AS n_null_text FROM documents""",
)
def dataset_profile(spark, sf_dir):
    return table(spark, sf_dir, "documents").agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("source").alias("n_sources"), F.countDistinct("lang").alias("n_langs"),
        F.sum("n_chars").alias("n_chars"), F.count_if(F.col("text").isNull()).alias("n_null_text"),
    )


@query(
    "feature_count_reduction",
    """SELECT p_type AS method, min(n) AS min_n, max(n) AS max_n, count(*) AS n_sets FROM (SELECT p_type, p_brand, count(*) AS n FROM part GROUP BY ALL) GROUP BY p_type""",
)
def feature_count_reduction(spark, sf_dir):
    sets = table(spark, sf_dir, "part").groupBy("p_type", "p_brand").agg(F.count(F.lit(1)).alias("n"))
    return sets.groupBy(F.col("p_type").alias("method")).agg(F.min("n").alias("min_n"), F.max("n").alias("max_n"), F.count(F.lit(1)).alias("n_sets"))


# ---- ranking, sorting, sampling -------------------------------------------------------------------


@query(
    "top_rows_per_group",
    """WITH k AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, l_extendedprice, row_number() OVER (PARTITION BY l_suppkey
  ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS position FROM lineitem)
SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, l_extendedprice, CAST(position AS INT) AS position FROM k WHERE position <= 5""",
)
def top_rows_per_group(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return top_rows(lines, ["l_suppkey"], [F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey"], 5)


@query(
    "representative_rows",
    """WITH m AS (SELECT event_type, median(value) AS med FROM events GROUP BY event_type),
k AS (SELECT e.event_type, event_id, value, row_number() OVER (PARTITION BY e.event_type ORDER BY abs(value - med), event_id) AS place FROM events e JOIN m ON e.event_type = m.event_type)
SELECT event_type, event_id, value FROM k WHERE place = 1""",
)
def representative_rows(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_type", "event_id", "value")
    medians = exact_quantiles(events, ["event_type"], "value", [0.5]).select("event_type", F.col("quantiles")[0].alias("med"))
    near = events.join(medians, "event_type").withColumn("gap", F.abs(F.col("value") - F.col("med")))
    return best_row(near, ["event_type"], [F.col("gap"), F.col("event_id")]).select("event_type", "event_id", "value")


@query(
    "global_ranking",
    """SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders""",
)
def global_ranking(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return row_rank(orders, [], [("o_totalprice", False), ("o_orderkey", True)]).select("o_orderkey", "rank")


@query(
    "head_and_tail_extremes",
    """SELECT 'head' AS side, p_partkey, p_retailprice FROM (SELECT * FROM part ORDER BY p_retailprice, p_partkey LIMIT 10)
UNION ALL SELECT 'tail', p_partkey, p_retailprice FROM (SELECT * FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 10)""",
)
def head_and_tail_extremes(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    head = part.orderBy("p_retailprice", "p_partkey").limit(10).select(F.lit("head").alias("side"), "*")
    tail = part.orderBy(F.desc("p_retailprice"), "p_partkey").limit(10).select(F.lit("tail").alias("side"), "*")
    return head.unionByName(tail)


@query(
    "largest_absolute_values",
    "SELECT c_custkey, c_acctbal FROM customer ORDER BY abs(c_acctbal) DESC, c_custkey LIMIT 20",
)
def largest_absolute_values(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal").orderBy(F.abs("c_acctbal").desc(), "c_custkey").limit(20)


@query(
    "seeded_sample",
    "SELECT doc_id, source FROM documents ORDER BY md5('2024|' || doc_id), doc_id LIMIT 50",
)
def seeded_sample(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return docs.orderBy(hash_order(2024, F.col("doc_id")), "doc_id").limit(50)


@query(
    "pick_list_union",
    """WITH a AS (SELECT doc_id FROM documents ORDER BY n_chars DESC, doc_id LIMIT 5), b AS (SELECT doc_id FROM documents ORDER BY n_chars, doc_id LIMIT 5),
c AS (SELECT doc_id FROM documents ORDER BY md5('7|' || doc_id) LIMIT 5) SELECT doc_id FROM a UNION SELECT doc_id FROM b UNION SELECT doc_id FROM c""",
)
def pick_list_union(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    picks = [
        docs.orderBy(F.desc("n_chars"), "doc_id").limit(5), docs.orderBy("n_chars", "doc_id").limit(5),
        docs.orderBy(hash_order(7, F.col("doc_id"))).limit(5),
    ]
    return picks[0].unionByName(picks[1]).unionByName(picks[2]).select("doc_id").distinct()


@query(
    "evenly_spaced_rows",
    """WITH r AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY md5('spacing|' || event_id), event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT event_id, user_id FROM r WHERE n <= 8 OR i IN (SELECT round_even(j * (n - 1) / 7.0, 0) FROM range(8) t(j))""",
)
def evenly_spaced_rows(spark, sf_dir):
    placed = hash_rank(table(spark, sf_dir, "events").select("event_id", "user_id"), ["user_id"], ["event_id"], "spacing", "place", "size")
    return E.evenly_spaced(placed, ["user_id"], "place", "size", 8).select("event_id", "user_id")


@query(
    "stride_subsample",
    """WITH r AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM events) SELECT event_id, user_id FROM r WHERE i % 10 = 0""",
)
def stride_subsample(spark, sf_dir):
    placed = row_rank(table(spark, sf_dir, "events").select("event_id", "user_id"), ["user_id"], [("event_id", True)], "place")
    return placed.filter((F.col("place") - 1) % 10 == 0).select("event_id", "user_id")


@query(
    "consecutive_differences",
    """WITH d AS (SELECT DISTINCT l_suppkey, l_extendedprice AS p FROM lineitem), g AS (SELECT l_suppkey, p - lag(p) OVER (PARTITION BY l_suppkey ORDER BY p) AS gap FROM d)
SELECT l_suppkey, count(gap) AS n_gaps, round(min(gap), 4) AS min_gap, round(max(gap), 4) AS max_gap FROM g GROUP BY l_suppkey""",
)
def consecutive_differences(spark, sf_dir):
    from lumbre.operators.ordered import previous_value

    distinct = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_extendedprice").alias("p")).distinct()
    gap = F.col("p") - F.col("previous")
    return previous_value(distinct, ["l_suppkey"], "p").groupBy("l_suppkey").agg(
        F.count(gap).alias("n_gaps"), rounded(F.min(gap), 4).alias("min_gap"), rounded(F.max(gap), 4).alias("max_gap")
    )


# ---- numeric scalars --------------------------------------------------------------------------------


@query(
    "scaled_windows",
    """SELECT l_suppkey, round(avg((least(greatest(l_extendedprice, 1000.0), 50000.0) - 1000.0) / 49000.0), 9) AS narrow,
  round(avg((least(greatest(l_extendedprice, 0.0), 100000.0)) / 100000.0), 9) AS wide, round(avg(1 / (1 + exp(-(l_quantity - 25) / 10))), 9) AS squashed FROM lineitem GROUP BY l_suppkey""",
)
def scaled_windows(spark, sf_dir):
    price = F.col("l_extendedprice")
    windows = F.array(N.window_scale(price, 1000, 50000), N.window_scale(price, 0, 100000))
    return table(spark, sf_dir, "lineitem").select("l_suppkey", windows.alias("w"), N.sigmoid((F.col("l_quantity") - 25) / 10).alias("s")).groupBy(
        "l_suppkey"
    ).agg(*[rounded(F.avg(F.col("w")[i])).alias(n) for i, n in enumerate(("narrow", "wide"))], rounded(F.avg("s")).alias("squashed"))


@query(
    "z_scores_per_group",
    """WITH m AS (SELECT l_returnflag, avg(l_quantity) AS mu, stddev_pop(l_quantity) AS sd FROM lineitem GROUP BY l_returnflag)
SELECT l.l_returnflag, l_quantity, count(*) AS n, round(max((l_quantity - mu) / sd), 9) AS z FROM lineitem l JOIN m ON l.l_returnflag = m.l_returnflag GROUP BY ALL""",
)
def z_scores_per_group(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity")
    stats = lines.groupBy("l_returnflag").agg(F.avg("l_quantity").alias("mu"), F.stddev_pop("l_quantity").alias("sd"))
    counts = lines.groupBy("l_returnflag", "l_quantity").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(stats, "l_returnflag").select("l_returnflag", "l_quantity", "n", rounded(N.z_score(F.col("l_quantity"), F.col("mu"), F.col("sd"))).alias("z"))


@query(
    "robust_min_max",
    """WITH q AS (SELECT event_type, quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.995) AS hi FROM events GROUP BY event_type)
SELECT e.event_type, event_id, round((least(greatest(value, lo), hi) - lo) / (hi - lo), 8) AS scaled FROM events e JOIN q ON e.event_type = q.event_type""",
)
def robust_min_max(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_type", "event_id", "value")
    q = exact_quantiles(events, ["event_type"], "value", [0.01, 0.995]).select("event_type", F.col("quantiles")[0].alias("lo"), F.col("quantiles")[1].alias("hi"))
    return events.join(q, "event_type").select("event_type", "event_id", rounded(N.min_max(F.col("value"), F.col("lo"), F.col("hi")), 8).alias("scaled"))


@query(
    "linear_rescale",
    """SELECT user_id, round(sum(value * coalesce(CASE WHEN event_type = 'click' THEN 2.0 END, 1.0) + coalesce(CASE WHEN event_type = 'view' THEN -10.0 END, 0.0)), 4) AS total
FROM events GROUP BY user_id""",
)
def linear_rescale(spark, sf_dir):
    slope, intercept = F.when(F.col("event_type") == "click", 2.0), F.when(F.col("event_type") == "view", -10.0)
    return table(spark, sf_dir, "events").groupBy("user_id").agg(rounded(F.sum(N.linear_rescale(F.col("value"), slope, intercept)), 4).alias("total"))


_E3 = "CAST(embedding[{}] AS DOUBLE)"


@query(
    "slice_projection",
    f"""WITH v AS (SELECT vec_id, {", ".join(f"{_E3.format(i)} AS v{i}" for i in range(1, 10))} FROM embeddings),
c AS (SELECT *, v2 * v6 - v3 * v5 AS n1, v3 * v4 - v1 * v6 AS n2, v1 * v5 - v2 * v4 AS n3 FROM v)
SELECT vec_id, round((v7 * n1 + v8 * n2 + v9 * n3) / sqrt(n1 * n1 + n2 * n2 + n3 * n3), 9) AS projection FROM c""",
)
def slice_projection(spark, sf_dir):
    e = F.transform("embedding", lambda x: x.cast("double"))
    normal = N.unit3(N.cross3(F.slice(e, 1, 3), F.slice(e, 4, 3)))
    return table(spark, sf_dir, "embeddings").select("vec_id", rounded(N.dot3(F.slice(e, 7, 3), normal)).alias("projection"))


@query(
    "size_fallback",
    """SELECT p_partkey, round(coalesce(CASE WHEN p_size % 3 = 0 THEN CAST(p_size AS DOUBLE) END, power(6 * p_retailprice / pi(), 1.0 / 3)), 9) AS diameter FROM part""",
)
def size_fallback(spark, sf_dir):
    given = F.when(F.col("p_size") % 3 == 0, F.col("p_size").cast("double"))
    return table(spark, sf_dir, "part").select("p_partkey", rounded(F.coalesce(given, N.sphere_diameter(F.col("p_retailprice")))).alias("diameter"))


@query(
    "quality_checks",
    """WITH s AS (SELECT count(*) AS n, min(l_discount) AS lo, max(l_discount) AS hi, count(*) - count(l_tax) AS nulls FROM lineitem)
SELECT 'rows' AS "check", CASE WHEN n > 0 THEN 'PASS' ELSE 'FAIL' END AS status, CAST(n AS DOUBLE) AS value FROM s
UNION ALL SELECT 'discount_range', CASE WHEN lo >= 0 AND hi <= 0.05 THEN 'PASS' ELSE 'WARN' END, hi FROM s
UNION ALL SELECT 'tax_nulls', CASE WHEN nulls = 0 THEN 'PASS' ELSE 'FAIL' END, CAST(nulls AS DOUBLE) FROM s""",
)
def quality_checks(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").agg(
        F.count(F.lit(1)).alias("n"), F.min("l_discount").alias("lo"), F.max("l_discount").alias("hi"), F.count_if(F.col("l_tax").isNull()).alias("nulls")
    )

    def check(name, ok, bad, value):
        return F.struct(F.lit(name).alias("check"), F.when(ok, "PASS").otherwise(bad).alias("status"), value.cast("double").alias("value"))

    checks = F.array(
        check("rows", F.col("n") > 0, "FAIL", F.col("n")),
        check("discount_range", (F.col("lo") >= 0) & (F.col("hi") <= 0.05), "WARN", F.col("hi")),
        check("tax_nulls", F.col("nulls") == 0, "FAIL", F.col("nulls")),
    )
    return s.select(F.inline(checks))
