"""Contingency, exact tests and false-discovery control over the order and document cohorts."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumbre.functions.numeric import rounded
from lumbre.operators import association as A
from lumbre.plans.base import COHORT_SQL, DOC_FLAGS, DOC_LABELS, DOC_SQL, FLAGS, LABELS, cohort, doc_cohort
from lumbre.plans.registry import query


def _pairs_sql(source: str, flags: list[str], labels: list[str]) -> str:
    parts = [
        f"SELECT '{f}' AS feature, '{l}' AS label, {f} AS x, {l} AS y FROM {source}" for f in flags for l in labels
    ]
    return f"""pairs AS ({" UNION ALL ".join(parts)}),
tabs AS (SELECT feature, label,
  CAST(sum(x * y) AS BIGINT) AS a, CAST(sum(x * (1 - y)) AS BIGINT) AS b,
  CAST(sum((1 - x) * y) AS BIGINT) AS c, CAST(sum((1 - x) * (1 - y)) AS BIGINT) AS d
  FROM pairs GROUP BY feature, label)"""


_RATES_SQL = """rates AS (SELECT *, a / CAST(nullif(a + b, 0) AS DOUBLE) AS rate_exposed,
  c / CAST(nullif(c + d, 0) AS DOUBLE) AS rate_unexposed,
  CASE WHEN a + b = 0 OR c + d = 0 OR a + c = 0 OR b + d = 0 THEN NULL
       WHEN b * c = 0 THEN CAST('Infinity' AS DOUBLE)
       ELSE CAST(a AS DOUBLE) * d / (CAST(b AS DOUBLE) * c) END AS odds_ratio FROM tabs)"""

_FISHER_SQL = """ks AS (SELECT feature, label, a, b, c, d,
  unnest(range(greatest(0, a - d), least(a + b, a + c) + 1)) AS k FROM tabs),
lw AS (SELECT *,
  lgamma(a + b + 1.0) + lgamma(c + d + 1.0) + lgamma(a + c + 1.0) + lgamma(b + d + 1.0) - lgamma(a + b + c + d + 1.0) AS base
  FROM ks),
w AS (SELECT *, base - lgamma(k + 1.0) - lgamma(a + b - k + 1.0) - lgamma(a + c - k + 1.0) - lgamma(d - a + k + 1.0) AS lp,
  base - lgamma(a + 1.0) - lgamma(b + 1.0) - lgamma(c + 1.0) - lgamma(d + 1.0) AS lo FROM lw),
ps AS (SELECT feature, label,
  least(1.0, sum(CASE WHEN lp <= lo + 1e-7 THEN exp(lp) ELSE 0 END)) AS p_two_sided,
  least(1.0, sum(CASE WHEN k >= a THEN exp(lp) ELSE 0 END)) AS p_greater FROM w GROUP BY feature, label)"""

_BH_SQL = """q AS (SELECT ps.*,
  p_two_sided * count(*) OVER () / row_number() OVER (ORDER BY p_two_sided, feature, label) AS q_all,
  p_two_sided * count(*) OVER (PARTITION BY label) / row_number() OVER (PARTITION BY label ORDER BY p_two_sided, feature) AS q_label
  FROM ps),
bh AS (SELECT feature, label, p_two_sided, p_greater,
  least(1.0, min(q_all) OVER (ORDER BY p_two_sided DESC, feature DESC, label DESC ROWS UNBOUNDED PRECEDING)) AS p_adjusted_all,
  least(1.0, min(q_label) OVER (PARTITION BY label ORDER BY p_two_sided DESC, feature DESC ROWS UNBOUNDED PRECEDING)) AS p_adjusted_label
  FROM q)"""

_HEAD = f"WITH {COHORT_SQL}, {_pairs_sql('cohort', FLAGS, LABELS)}"


@query(
    "contingency_tables",
    f"""{_HEAD}, {_RATES_SQL}
SELECT feature, label, a, b, c, d, round(rate_exposed, 9) AS rate_exposed, round(rate_unexposed, 9) AS rate_unexposed,
  round(rate_exposed - rate_unexposed, 9) AS rate_difference, round(odds_ratio, 6) AS odds_ratio FROM rates""",
)
def contingency_tables(spark, sf_dir):
    out = A.with_rates(A.contingency(cohort(spark, sf_dir), FLAGS, LABELS))
    return out.select(
        "feature", "label", "a", "b", "c", "d",
        *[rounded(F.col(c)).alias(c) for c in ("rate_exposed", "rate_unexposed", "rate_difference")],
        rounded(F.col("odds_ratio"), 6).alias("odds_ratio"),
    )


_ASSOC_OUT = """SELECT r.feature, r.label, a, b, c, d, round(odds_ratio, 6) AS odds_ratio,
  round(p_two_sided, 8) AS p_two_sided, round(p_greater, 8) AS p_greater,
  round(p_adjusted_all, 8) AS p_adjusted_all, round(p_adjusted_label, 8) AS p_adjusted_label
FROM rates r JOIN bh ON r.feature = bh.feature AND r.label = bh.label"""


def _association(df, flags, labels):
    out = A.association_table(df, flags, labels)
    return out.select(
        "feature", "label", "a", "b", "c", "d", rounded(F.col("odds_ratio"), 6).alias("odds_ratio"),
        *[rounded(F.col(c), 8).alias(c) for c in ("p_two_sided", "p_greater", "p_adjusted_all", "p_adjusted_label")],
    )


@query("fisher_association", f"{_HEAD}, {_RATES_SQL}, {_FISHER_SQL}, {_BH_SQL} {_ASSOC_OUT}")
def fisher_association(spark, sf_dir):
    return _association(cohort(spark, sf_dir), FLAGS, LABELS)


@query(
    "fisher_association_documents",
    f"WITH {DOC_SQL}, {_pairs_sql('doc_cohort', DOC_FLAGS, DOC_LABELS)}, {_RATES_SQL}, {_FISHER_SQL}, {_BH_SQL} {_ASSOC_OUT}",
)
def fisher_association_documents(spark, sf_dir):
    return _association(doc_cohort(spark, sf_dir), DOC_FLAGS, DOC_LABELS)


_PREV_SQL = " UNION ALL ".join(
    f"SELECT '{f}' AS feature, count(*) AS n, CAST(sum({f}) AS BIGINT) AS n_positive, round(avg({f}), 9) AS prevalence FROM cohort"
    for f in FLAGS
)


@query("feature_prevalence", f"WITH {COHORT_SQL} {_PREV_SQL}")
def feature_prevalence(spark, sf_dir):
    out = A.prevalence(cohort(spark, sf_dir), FLAGS)
    return out.withColumn("prevalence", rounded(F.col("prevalence")))


@query("rare_features", f"WITH {COHORT_SQL}, prev AS ({_PREV_SQL}) SELECT feature, n_positive FROM prev WHERE prevalence < 0.25")
def rare_features(spark, sf_dir):
    return A.prevalence(cohort(spark, sf_dir), FLAGS).filter("prevalence < 0.25").select("feature", "n_positive")


@query(
    "prevalence_contrast",
    f"WITH {COHORT_SQL} "
    + " UNION ALL ".join(
        f"""SELECT '{f}' AS feature, round(avg(CASE WHEN returned = 1 THEN {f} END), 9) AS share_positive,
  round(avg(CASE WHEN returned = 0 THEN {f} END), 9) AS share_negative,
  round(avg(CASE WHEN returned = 1 THEN {f} END) - avg(CASE WHEN returned = 0 THEN {f} END), 9) AS share_difference FROM cohort"""
        for f in FLAGS
    ),
)
def prevalence_contrast(spark, sf_dir):
    out = A.prevalence_contrast(cohort(spark, sf_dir), FLAGS, "returned")
    return out.select("feature", *[rounded(F.col(c)).alias(c) for c in ("share_positive", "share_negative", "share_difference")])
