"""Subgroup discovery over the order cohort: search, diversity, cross-validation, stability, permutations."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumbre.functions.numeric import rounded
from lumbre.operators import prepare as P
from lumbre.operators import subgroups as G
from lumbre.plans.base import COHORT_SQL, FLAGS, LABELS, NUMERIC, cohort, sql_md5, table
from lumbre.plans.registry import query
from lumbre.plans.split_queries import _folds, folds_sql

FEATURES = [*FLAGS, *NUMERIC]
TARGETS = [*LABELS, "none"]
ARMS = [G.Arm(t, t, 0.10) for t in TARGETS]


def _frame(spark, sf_dir):
    return cohort(spark, sf_dir).withColumn("none", (F.col("returned") + F.col("open_line") == 0).cast("int"))


# ---- SQL twin of the search ------------------------------------------------------------------------


def _selector_sql() -> str:
    melted = " UNION ALL ".join(f"SELECT s, part, id, '{f}' AS feature, CAST({f} AS DOUBLE) AS value FROM xs" for f in FEATURES)
    return f"""ml AS ({melted}), tr AS (SELECT * FROM ml WHERE part = 'train' AND value IS NOT NULL),
kd AS (SELECT s, feature, count(CASE WHEN value NOT IN (0, 1) THEN 1 END) AS other, max(value) AS hi FROM tr GROUP BY s, feature),
sv AS (SELECT s, feature, '==' AS op, 1.0::DOUBLE AS value FROM kd WHERE other = 0 AND hi = 1
  UNION ALL SELECT s, feature, op, value FROM (SELECT DISTINCT s, feature, unnest(quantile_cont(value, [0.25, 0.5, 0.75])) AS value FROM tr
    WHERE (s, feature) IN (SELECT (s, feature) FROM kd WHERE other > 0) GROUP BY s, feature), (VALUES ('<='), ('>')) o(op)),
sel AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY feature, value, CASE WHEN op = '>' THEN 1 ELSE 0 END) AS idx,
  feature || ' ' || op || ' ' || CASE WHEN op = '==' THEN CAST(CAST(value AS BIGINT) AS VARCHAR)
    ELSE regexp_replace(CAST(CAST(round(value, 6) AS DECIMAL(38, 6)) AS VARCHAR), '(\\.\\d+?)0+$', '\\1') END AS txt FROM sv),
mem AS (SELECT m.s, m.part, m.id, idx, m.feature FROM ml m JOIN sel ON m.s = sel.s AND m.feature = sel.feature
  WHERE CASE op WHEN '==' THEN m.value = sel.value WHEN '<=' THEN m.value <= sel.value ELSE m.value > sel.value END),
tot AS (SELECT s, count(*) AS n_rows, sum(returned) AS a_returned, sum(open_line) AS a_open_line, sum(none) AS a_none FROM xs WHERE part = 'train' GROUP BY s)"""


def _level_sql(d: int, arms: list[G.Arm], beam: int, top: int) -> str:
    if d == 1:
        raw = """g1 AS (SELECT mem.s, NULL AS parent, mem.idx, mem.idx AS last, count(*) AS n_covered, sum(returned) AS returned, sum(open_line) AS open_line, sum(none) AS none,
  md5(string_agg(CAST(mem.id AS VARCHAR), ',' ORDER BY mem.id)) AS cover FROM mem JOIN xs ON mem.s = xs.s AND mem.id = xs.id WHERE mem.part = 'train' GROUP BY mem.s, mem.idx),
n1 AS (SELECT g1.*, a.arm, 1 AS parent_rank, txt AS rule_key, [feature] AS used FROM g1 JOIN sel ON g1.s = sel.s AND g1.idx = sel.idx, arms a)"""
    else:
        raw = f"""g{d} AS (SELECT p.s, p.rule_key AS parent, m.idx, m.idx AS last, count(*) AS n_covered, sum(returned) AS returned, sum(open_line) AS open_line, sum(none) AS none,
  md5(string_agg(CAST(m.id AS VARCHAR), ',' ORDER BY m.id)) AS cover
  FROM (SELECT DISTINCT s, rule_key, last, used FROM t{d - 1} WHERE rank <= {beam}) p JOIN m{d - 1} r ON r.s = p.s AND r.rule_key = p.rule_key
  JOIN mem m ON m.s = p.s AND m.id = r.id AND m.idx > p.last AND NOT list_contains(p.used, m.feature)
  JOIN xs ON xs.s = m.s AND xs.id = m.id WHERE m.part = 'train' GROUP BY p.s, p.rule_key, m.idx),
n{d} AS (SELECT g{d}.*, t.arm, t.rank AS parent_rank, t.rule_key || '|' || txt AS rule_key, list_append(t.used, feature) AS used
  FROM g{d} JOIN sel ON g{d}.s = sel.s AND g{d}.idx = sel.idx JOIN t{d - 1} t ON t.s = g{d}.s AND t.rule_key = g{d}.parent AND t.rank <= {beam})"""
    member = (
        "m1 AS (SELECT DISTINCT t1.s, t1.rule_key, mem.id, mem.part FROM t1 JOIN mem ON mem.s = t1.s AND mem.idx = t1.last)"
        if d == 1
        else f"""m{d} AS (SELECT DISTINCT t.s, t.rule_key, r.id, r.part FROM t{d} t JOIN m{d - 1} r ON r.s = t.s AND r.rule_key = t.parent
  JOIN mem ON mem.s = t.s AND mem.idx = t.last AND mem.id = r.id)"""
    )
    return f"""{raw},
w{d} AS (SELECT n{d}.s, n{d}.arm, parent, rule_key, used, last, n_rows, n_covered, cover, parent_rank, idx,
  CASE a.target WHEN 'returned' THEN returned WHEN 'open_line' THEN open_line ELSE none END AS hit,
  CASE a.target WHEN 'returned' THEN a_returned WHEN 'open_line' THEN a_open_line ELSE a_none END AS n_positive
  FROM n{d} JOIN tot ON n{d}.s = tot.s JOIN arms a ON a.arm = n{d}.arm AND a.max_depth >= {d} WHERE n_covered >= greatest(1, ceil(a.min_coverage * n_rows)) AND n_covered < n_rows),
f{d} AS (SELECT *, CAST(n_covered AS DOUBLE) / n_rows AS coverage, CAST(n_covered AS DOUBLE) / n_rows * (CAST(hit AS DOUBLE) / n_covered - CAST(n_positive AS DOUBLE) / n_rows) AS wracc
  FROM w{d} QUALIFY row_number() OVER (PARTITION BY s, arm, cover ORDER BY parent_rank, idx) = 1),
t{d} AS (SELECT *, {d} AS rule_length, row_number() OVER (PARTITION BY s, arm ORDER BY wracc DESC, coverage DESC, rule_key DESC) AS rank FROM f{d} WHERE wracc > 0
  QUALIFY row_number() OVER (PARTITION BY s, arm ORDER BY wracc DESC, coverage DESC, rule_key DESC) <= {max(beam, top)}),
{member}"""


def beam_sql(arms: list[G.Arm], depth: int, beam: int = 100, top: int = 100) -> str:
    """CTEs up to ``rules``; expects ``xs(s, part, id, features, targets)`` before it."""
    values = ", ".join(f"('{a.name}', '{a.target}', {a.min_coverage}::DOUBLE, {a.max_depth or depth})" for a in arms)
    levels = ",\n".join(_level_sql(d, arms, beam, top) for d in range(1, depth + 1))
    union = " UNION ALL ".join(
        f"SELECT s, arm, rule_key, rule_length, n_rows, n_covered, n_positive, hit, coverage, wracc FROM t{d} WHERE rank <= {top}" for d in range(1, depth + 1)
    )
    members = " UNION ALL ".join(f"SELECT s, rule_key, id, part FROM m{d}" for d in range(1, depth + 1))
    return f"""arms AS (SELECT * FROM (VALUES {values}) v(arm, target, min_coverage, max_depth)), {_selector_sql()},
{levels}, al AS ({union}),
rules AS (SELECT *, row_number() OVER (PARTITION BY s, arm ORDER BY wracc DESC, coverage DESC, rule_length, rule_key DESC) AS rank FROM al
  QUALIFY row_number() OVER (PARTITION BY s, arm ORDER BY wracc DESC, coverage DESC, rule_length, rule_key DESC) <= {top}),
rm AS ({members})"""


def diverse_sql(limit: float, picks: int) -> str:
    steps = []
    for k in range(1, picks + 1):
        earlier = " AND ".join(
            f"NOT EXISTS (SELECT 1 FROM jc JOIN p{i} ON jc.s = p{i}.s AND jc.arm = p{i}.arm AND jc.a = p{i}.rank WHERE jc.s = r.s AND jc.arm = r.arm AND jc.b = r.rank)" for i in range(1, k)
        )
        after = f"AND r.rank > (SELECT q.rank FROM p{k - 1} q WHERE q.s = r.s AND q.arm = r.arm) AND {earlier}" if k > 1 else ""
        steps.append(f"p{k} AS (SELECT s, arm, min(rank) AS rank, {k} AS choice FROM rules r WHERE TRUE {after} GROUP BY s, arm)")
    union = " UNION ALL ".join(f"SELECT * FROM p{k}" for k in range(1, picks + 1))
    return f"""fm AS (SELECT r.s, r.arm, r.rank, r.n_covered, m.id FROM rules r JOIN rm m ON m.s = r.s AND m.rule_key = r.rule_key AND m.part = 'train'),
jp AS (SELECT a.s, a.arm, a.rank AS a, b.rank AS b, count(*) / CAST(any_value(a.n_covered) + any_value(b.n_covered) - count(*) AS DOUBLE) AS jaccard
  FROM fm a JOIN fm b ON a.s = b.s AND a.arm = b.arm AND a.id = b.id AND a.rank < b.rank GROUP BY a.s, a.arm, a.rank, b.rank),
jc AS (SELECT * FROM jp WHERE jaccard > {limit}), {", ".join(steps)}, picks AS ({union})"""


_FULL_SQL = f"{COHORT_SQL}, xs AS (SELECT 'full' AS s, 'train' AS part, *, CASE WHEN returned + open_line = 0 THEN 1 ELSE 0 END AS none FROM cohort)"
_RULE_OUT = """SELECT arm, rule_key, CAST(rule_length AS INT) AS rule_length, CAST(rank AS INT) AS rank, n_covered, CAST(hit AS BIGINT) AS n_positive_covered,
  round(coverage, 9) AS coverage, round(wracc, 9) AS wracc FROM rules"""


def _full(spark, sf_dir, arms=None, depth=2, **kw):
    # Written once: selectors and patterns read the cohort several times.
    frame = G.durable(_frame(spark, sf_dir).withColumn("s", F.lit("full")))
    selectors = G.durable(G.make_selectors(frame, ["s"], FEATURES))
    patterns = G.durable(G.make_patterns(frame, ["s"], FEATURES, TARGETS, selectors, ["s"]))
    rules = G.beam_search(patterns, selectors, ["s"], ["s"], arms or ARMS, depth, **kw)
    return selectors, patterns, rules


def _rule_rows(rules):
    return rules.select("arm", "rule_key", "rule_length", "rank", "n_covered", "n_positive_covered", rounded(F.col("coverage")).alias("coverage"), rounded(F.col("wracc")).alias("wracc"))


@query(
    "subgroup_selectors",
    f"""WITH {_FULL_SQL}, {_selector_sql()} SELECT CAST(idx AS INT) AS idx, feature, op, round(value, 6) AS value, txt AS text FROM sel""",
)
def subgroup_selectors(spark, sf_dir):
    frame = _frame(spark, sf_dir).withColumn("s", F.lit("full"))
    return G.make_selectors(frame, ["s"], FEATURES).select("idx", "feature", "op", rounded(F.col("value"), 6).alias("value"), "text")


@query("subgroup_beam_search", f"WITH {_FULL_SQL}, {beam_sql(ARMS, 3)} {_RULE_OUT}")
def subgroup_beam_search(spark, sf_dir):
    return _rule_rows(_full(spark, sf_dir, depth=3)[2])


@query("subgroup_narrow_beam", f"WITH {_FULL_SQL}, {beam_sql(ARMS, 3, 4, 10)} {_RULE_OUT}")
def subgroup_narrow_beam(spark, sf_dir):
    return _rule_rows(_full(spark, sf_dir, depth=3, beam_width=4, top_candidates=10)[2])


@query(
    "subgroup_diverse_rules",
    f"""WITH {_FULL_SQL}, {beam_sql(ARMS, 2)}, {diverse_sql(0.8, 5)}
SELECT r.arm, CAST(choice AS INT) AS choice, rule_key, n_covered, round(wracc, 9) AS wracc FROM rules r JOIN picks ON r.s = picks.s AND r.arm = picks.arm AND r.rank = picks.rank""",
)
def subgroup_diverse_rules(spark, sf_dir):
    _, patterns, rules = _full(spark, sf_dir)
    return G.diverse_rules(rules, patterns, ["s"]).select("arm", "choice", "rule_key", "n_covered", rounded(F.col("wracc")).alias("wracc"))


@query(
    "rule_overlap_jaccard",
    f"""WITH {_FULL_SQL}, {beam_sql(ARMS, 2, 20, 20)}, {diverse_sql(0.8, 1)} SELECT arm, CAST(a AS INT) AS a, CAST(b AS INT) AS b, round(jaccard, 9) AS jaccard FROM jp""",
)
def rule_overlap_jaccard(spark, sf_dir):
    _, patterns, rules = _full(spark, sf_dir, beam_width=20, top_candidates=20)
    return G.rule_overlaps(rules, patterns, ["s"]).select("arm", "a", "b", rounded(F.col("jaccard")).alias("jaccard"))


_SENSITIVITY = [G.Arm(f"{t}@{c}/{d}", t, c, d) for t in LABELS for c in (0.05, 0.2, 0.4) for d in (1, 2, 3)]


@query("subgroup_sensitivity", f"WITH {_FULL_SQL}, {beam_sql(_SENSITIVITY, 3, 30, 20)} {_RULE_OUT}")
def subgroup_sensitivity(spark, sf_dir):
    """Coverages by depths as arms of one search."""
    return _rule_rows(_full(spark, sf_dir, _SENSITIVITY, 3, beam_width=30, top_candidates=20)[2])


# ---- metrics of a rule catalogue --------------------------------------------------------------------

_CATALOGUE = {
    "heavy": [("heavy", "==", 1.0)],
    "small": [("qty", "<=", 60.0)],
    "urgent_heavy": [("urgent", "==", 1.0), ("heavy", "==", 1.0)],
    "nobody": [("amount", ">", 1e12)],
    "everybody": [("amount", ">", -1.0)],
}
_CAT_COND = {
    "heavy": "heavy = 1", "small": "qty <= 60", "urgent_heavy": "urgent = 1 AND heavy = 1", "nobody": "amount > 1e12", "everybody": "amount > -1"
}
_METRIC_NAMES = ["coverage", "support", "global_prevalence", "subgroup_prevalence", "risk_difference", "lift", "sensitivity", "wracc", "odds_ratio"]


@query(
    "subgroup_metrics",
    f"""WITH {COHORT_SQL}, q AS ({" UNION ALL ".join(
        f"SELECT '{r}' AS rule_id, '{t}' AS target, count(*) AS n, count(CASE WHEN {c} THEN 1 END) AS cov, sum({t}) AS pos, coalesce(sum(CASE WHEN {c} THEN {t} END), 0) AS hit FROM cohort"
        for r, c in _CAT_COND.items() for t in LABELS)}),
d AS (SELECT *, CAST(cov AS DOUBLE) / n AS coverage, CAST(hit AS DOUBLE) / n AS support, CAST(pos AS DOUBLE) / n AS gp, CAST(hit AS DOUBLE) / nullif(cov, 0) AS sp,
  CAST(hit AS DOUBLE) / pos AS sensitivity FROM q),
fi AS (SELECT rule_id, target, CAST(hit AS BIGINT) AS a, CAST(cov - hit AS BIGINT) AS b, CAST(pos - hit AS BIGINT) AS c, CAST(n - cov - pos + hit AS BIGINT) AS d FROM q WHERE cov > 0 AND cov < n),
ks AS (SELECT *, unnest(range(greatest(a, a - d), least(a + b, a + c) + 1)) AS k FROM fi),
pv AS (SELECT rule_id, target, sum(exp(lgamma(a + b + 1.0) + lgamma(c + d + 1.0) + lgamma(a + c + 1.0) + lgamma(b + d + 1.0) - lgamma(a + b + c + d + 1.0)
  - lgamma(k + 1.0) - lgamma(a + b - k + 1.0) - lgamma(a + c - k + 1.0) - lgamma(d - a + k + 1.0))) AS p FROM ks GROUP BY ALL)
SELECT d.rule_id, d.target, n AS n_rows, cov AS n_covered, CAST(pos AS BIGINT) AS n_positive, CAST(hit AS BIGINT) AS n_positive_covered, round(coverage, 9) AS coverage, round(support, 9) AS support,
  round(gp, 9) AS global_prevalence, round(sp, 9) AS subgroup_prevalence, round(sp - gp, 9) AS risk_difference, round(sp / gp, 9) AS lift, round(sensitivity, 9) AS sensitivity,
  round(CASE WHEN cov = 0 THEN 0 ELSE coverage * (sp - gp) END, 9) AS wracc,
  round(CASE WHEN cov = 0 OR cov = n THEN NULL WHEN (cov - hit) * (pos - hit) = 0 THEN CAST('Infinity' AS DOUBLE) ELSE CAST(hit AS DOUBLE) * (n - cov - pos + hit) / (CAST(cov - hit AS DOUBLE) * (pos - hit)) END, 6) AS odds_ratio,
  CASE WHEN p IS NOT NULL THEN round(least(1.0, p), 8) END AS fisher_p FROM d LEFT JOIN pv ON d.rule_id = pv.rule_id AND d.target = pv.target""",
)
def subgroup_metrics(spark, sf_dir):
    frame = cohort(spark, sf_dir)
    sums = [F.count(F.lit(1)).alias("n")]
    for t in LABELS:
        sums.append(F.sum(F.col(t).cast("bigint")).alias(f"p_{t}"))
        for r, rule in _CATALOGUE.items():
            hit = P.rule_condition(rule)
            sums += [F.count_if(hit).alias(f"c_{r}_{t}"), F.coalesce(F.sum(F.when(hit, F.col(t).cast("bigint"))), F.lit(0)).alias(f"h_{r}_{t}")]
    rows = F.array(
        *[
            F.struct(
                F.lit(r).alias("rule_id"), F.lit(t).alias("target"), F.col("n").alias("n_rows"), F.col(f"c_{r}_{t}").alias("n_covered"),
                F.col(f"p_{t}").alias("n_positive"), F.col(f"h_{r}_{t}").alias("n_positive_covered"),
            )
            for r in _CATALOGUE for t in LABELS
        ]
    )
    counts = frame.agg(*sums).select(F.inline(rows))
    out = G.with_one_sided_p(G.subgroup_metrics(counts), ["rule_id", "target"])
    digits = {**{m: 9 for m in _METRIC_NAMES}, "odds_ratio": 6, "fisher_p": 8}
    return out.select("rule_id", "target", "n_rows", "n_covered", "n_positive", "n_positive_covered", *[rounded(F.col(m), d).alias(m) for m, d in digits.items()])


# ---- cross-validated discovery ----------------------------------------------------------------------

_CV_ARMS = [G.Arm(t, t, 0.10) for t in LABELS]
#: Configurations of the consensus: coverages by depths.
_CONFIGURATIONS = [G.Arm(f"{t}@{c}/{d}", t, c, d) for t in LABELS for c in (0.05, 0.2) for d in (1, 2)]


def _cv_sql(arms: list[G.Arm]) -> str:
    return f"""{COHORT_SQL}, {folds_sql()}, xs AS (SELECT k.k AS s, CASE WHEN f.fold = k.k THEN 'test' ELSE 'train' END AS part, c.*, CASE WHEN c.returned + c.open_line = 0 THEN 1 ELSE 0 END AS none
  FROM cohort c JOIN folds f ON c.id = f.id, (SELECT CAST(unnest(range(1, 6)) AS INT) AS k) k), {beam_sql(arms, 2, 30, 30)}, {diverse_sql(0.8, 5)},
ch AS (SELECT r.*, choice, arms.target FROM rules r JOIN picks ON r.s = picks.s AND r.arm = picks.arm AND r.rank = picks.rank JOIN arms ON arms.arm = r.arm),
tp AS (SELECT s, part, count(*) AS n, sum(returned) AS p_returned, sum(open_line) AS p_open_line FROM xs GROUP BY s, part),
ev AS (SELECT ch.s, ch.arm, ch.target, ch.rule_key, ch.choice, tp.part, tp.n AS n_rows, CASE ch.target WHEN 'returned' THEN p_returned ELSE p_open_line END AS n_positive,
  count(rm.id) AS n_covered, coalesce(sum(CASE ch.target WHEN 'returned' THEN xs.returned ELSE xs.open_line END), 0) AS hit
  FROM ch JOIN tp ON tp.s = ch.s LEFT JOIN rm ON rm.s = ch.s AND rm.rule_key = ch.rule_key AND rm.part = tp.part LEFT JOIN xs ON xs.s = rm.s AND xs.id = rm.id GROUP BY ALL),
em AS (SELECT *, CAST(n_covered AS DOUBLE) / n_rows AS coverage, CAST(hit AS DOUBLE) / nullif(n_covered, 0) AS sp, CAST(n_positive AS DOUBLE) / n_rows AS gp FROM ev),
ew AS (SELECT *, CASE WHEN n_covered = 0 THEN 0 ELSE coverage * (sp - gp) END AS wracc, regexp_replace(rule_key, '((?:<=|>)) [-0-9.]+', '\\1', 'g') AS structure FROM em)"""


_CV_SQL = _cv_sql(_CV_ARMS)


def _cross_validated(spark, sf_dir, arms=None):
    frame = G.durable(_frame(spark, sf_dir))
    folds = _folds(spark, sf_dir, rows=frame).select("id", "fold")
    # The cohort with its folds is written once; all parts of the search read that.
    cohort_rows = G.durable(frame.join(folds, "id"))
    rows = cohort_rows.withColumn("s", F.explode(F.sequence(F.lit(1), F.lit(5))))
    part = F.when(F.col("fold") == F.col("s"), "test").otherwise("train")
    train = rows.filter("fold <> s")
    selectors = G.durable(G.make_selectors(train, ["s"], FEATURES))
    patterns = G.durable(G.make_patterns(rows, ["s"], FEATURES, TARGETS, selectors, ["s"], part))
    rules = G.beam_search(patterns, selectors, ["s"], ["s"], arms or _CV_ARMS, 2, 30, 30)
    chosen = G.durable(G.diverse_rules(rules, patterns, ["s"]))
    counts = G.evaluate_rules(chosen, patterns, ["s"], TARGETS)
    names = chosen.select("s", "arm", "rule_key", F.col("structure_value_key").alias("structure"), "choice", "rule")
    return G.subgroup_metrics(counts).join(names, ["s", "arm", "rule_key"]), selectors, chosen


@query(
    "subgroup_cross_validation",
    f"""WITH {_CV_SQL} SELECT s AS fold, arm, rule_key, structure, CAST(choice AS INT) AS choice, part, n_rows, n_covered, CAST(hit AS BIGINT) AS n_positive_covered, round(wracc, 9) AS wracc FROM ew""",
)
def subgroup_cross_validation(spark, sf_dir):
    rows = _cross_validated(spark, sf_dir)[0]
    return rows.select(F.col("s").alias("fold"), "arm", "rule_key", "structure", "choice", "part", "n_rows", "n_covered", "n_positive_covered", rounded(F.col("wracc")).alias("wracc"))


_STABILITY_NAMES = ["mean_test_wracc", "median_test_wracc", "mean_test_coverage", "mean_test_prevalence", "mean_test_risk_difference", "mean_test_lift", "selection_stability"]


@query(
    "subgroup_stability",
    f"""WITH {_CV_SQL}, pf AS (SELECT arm, s, structure, min(rule_key) AS ex, max(wracc) AS w, avg(coverage) AS c, avg(sp) AS sp, avg(sp - gp) AS rd, avg(sp / gp) AS l FROM ew WHERE part = 'test' GROUP BY ALL)
SELECT arm, structure, min(ex) AS rule_example, count(*) AS folds_selected, round(avg(w), 9) AS mean_test_wracc, round(median(w), 9) AS median_test_wracc, round(avg(c), 9) AS mean_test_coverage,
  round(avg(sp), 9) AS mean_test_prevalence, round(avg(rd), 9) AS mean_test_risk_difference, round(avg(l), 9) AS mean_test_lift, round(count(*) / 5.0, 9) AS selection_stability FROM pf GROUP BY arm, structure""",
)
def subgroup_stability(spark, sf_dir):
    rows = _cross_validated(spark, sf_dir)[0].filter("part = 'test'")
    out = G.stability(rows, ["arm"], ["s"], "structure", 5)
    return out.select("arm", "structure", "rule_example", "folds_selected", *[rounded(F.col(c)).alias(c) for c in _STABILITY_NAMES])


@query(
    "subgroup_consensus",
    f"""WITH {_cv_sql(_CONFIGURATIONS)}, o AS (SELECT target, structure, arm AS config, s, max(wracc) AS wracc FROM ew WHERE part = 'test' GROUP BY ALL),
a AS (SELECT target, structure, count(DISTINCT config) AS n_configs, count(*) AS n_cells, avg(wracc) AS m, avg(CASE WHEN wracc > 0 THEN 1.0 ELSE 0.0 END) AS sh FROM o GROUP BY target, structure)
SELECT target, structure, n_configs, n_cells, round(m, 9) AS mean_test_wracc, round(sh, 9) AS share_positive,
  CASE WHEN m > 0 AND sh >= 0.6 AND n_configs / 4.0 >= 0.75 AND n_cells / 20.0 >= 0.5 THEN 'strong' WHEN m > 0 AND sh >= 0.6 AND n_configs / 4.0 >= 0.5 AND n_cells / 20.0 >= 0.25 THEN 'moderate' ELSE 'none' END AS consensus FROM a""",
)
def subgroup_consensus(spark, sf_dir):
    """Coverages by depths are the configurations; only the test parts of the folds count."""
    rows = _cross_validated(spark, sf_dir, _CONFIGURATIONS)[0].filter("part = 'test'")
    rows = rows.withColumn("target", F.substring_index("arm", "@", 1)).withColumnRenamed("arm", "config")
    out = G.consensus_class(rows, ["target", "structure"], "config", ["s"], 4, 20)
    return out.select("target", "structure", "n_configs", "n_cells", rounded(F.col("mean_test_wracc")).alias("mean_test_wracc"), rounded(F.col("share_positive")).alias("share_positive"), "consensus")


@query(
    "structure_cover_stability",
    f"""WITH {_CV_SQL}, st AS (SELECT DISTINCT arm, structure, s, rule_key FROM ew),
me AS (SELECT arm, structure, st.s, st.rule_key, id FROM st JOIN rm ON rm.s = st.s AND rm.rule_key = st.rule_key),
sz AS (SELECT st.arm, st.structure, st.s, st.rule_key, count(id) AS n FROM st LEFT JOIN me ON me.arm = st.arm AND me.s = st.s AND me.rule_key = st.rule_key GROUP BY ALL),
bo AS (SELECT a.arm, a.structure, a.s AS sa, a.rule_key AS ra, b.s AS sb, b.rule_key AS rb, count(*) AS n_both FROM me a JOIN me b ON a.arm = b.arm AND a.structure = b.structure AND a.id = b.id AND a.s < b.s GROUP BY ALL),
ja AS (SELECT x.arm, x.structure, CASE WHEN x.n + y.n = 0 THEN 1.0 ELSE coalesce(n_both, 0) / CAST(x.n + y.n - coalesce(n_both, 0) AS DOUBLE) END AS j
  FROM sz x JOIN sz y ON x.arm = y.arm AND x.structure = y.structure AND x.s < y.s LEFT JOIN bo ON bo.arm = x.arm AND bo.structure = x.structure AND sa = x.s AND ra = x.rule_key AND sb = y.s AND rb = y.rule_key)
SELECT arm, structure, count(*) AS n_pairs, round(avg(j), 9) AS mean, round(min(j), 9) AS min, round(quantile_cont(j, 0.25), 9) AS q25, round(median(j), 9) AS median, round(quantile_cont(j, 0.75), 9) AS q75, round(max(j), 9) AS max
FROM ja GROUP BY arm, structure""",
)
def structure_cover_stability(spark, sf_dir):
    """Jaccard of the covers that rules of one structure from different folds have on the whole cohort."""
    _, selectors, chosen = _cross_validated(spark, sf_dir)
    out = G.structure_stability(cohort(spark, sf_dir), FEATURES, chosen, selectors, ["s"], ["arm", "structure_value_key"])
    return out.select("arm", F.col("structure_value_key").alias("structure"), "n_pairs", *[rounded(F.col(c)).alias(c) for c in ("mean", "min", "q25", "median", "q75", "max")])


@query(
    "cut_point_stability",
    f"""WITH {_CV_SQL}, u AS (SELECT arm, s, structure, unnest(string_split(rule_key, '|')) AS piece FROM ew WHERE part = 'test'),
v AS (SELECT arm, u.structure, sel.feature || ' ' || sel.op AS shape, sel.value FROM u JOIN sel ON sel.s = u.s AND sel.txt = u.piece AND sel.op <> '==')
SELECT arm, structure, shape, count(*) AS n, round(median(value), 6) AS median, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) AS iqr, round(max(value) - min(value), 6) AS range FROM v GROUP BY ALL""",
)
def cut_point_stability(spark, sf_dir):
    _, selectors, chosen = _cross_validated(spark, sf_dir)
    out = G.cut_point_stability(chosen, selectors, ["s"], ["arm"], "structure_value_key")
    return out.select("arm", F.col("structure_value_key").alias("structure"), "shape", "n", *[rounded(F.col(c), 6).alias(c) for c in ("median", "iqr", "range")])


@query(
    "paired_ablation",
    f"""WITH {_CV_SQL}, pc AS (SELECT s, avg(CASE WHEN arm = 'returned' THEN wracc END) AS a, avg(CASE WHEN arm = 'open_line' THEN wracc END) AS b FROM ew WHERE part = 'test' GROUP BY s)
SELECT 'targets' AS comparison, count(*) AS n_cells, round(avg(b - a), 9) AS mean_delta, count(CASE WHEN b - a > 1e-12 THEN 1 END) AS wins, count(CASE WHEN abs(b - a) <= 1e-12 THEN 1 END) AS ties,
  count(CASE WHEN b - a < -1e-12 THEN 1 END) AS losses FROM pc WHERE a IS NOT NULL AND b IS NOT NULL""",
)
def paired_ablation(spark, sf_dir):
    rows = _cross_validated(spark, sf_dir)[0].filter("part = 'test'").withColumn("comparison", F.lit("targets"))
    return G.paired_ablation(rows, ["comparison"], ["s"], "arm", "returned", "open_line").withColumn("mean_delta", rounded(F.col("mean_delta")))


@query(
    "same_structure_overlap",
    f"""WITH {COHORT_SQL}, t AS (SELECT CASE WHEN amount < 150000 THEN 'low' ELSE 'high' END AS g, id, urgent, heavy, discounted FROM cohort),
mm AS (SELECT g, 'urgent' AS r, id FROM t WHERE urgent = 1 UNION ALL SELECT g, 'heavy', id FROM t WHERE heavy = 1 UNION ALL SELECT g, 'discounted', id FROM t WHERE discounted = 1),
sz AS (SELECT g, r, (SELECT count(*) FROM mm WHERE mm.g = gg.g AND mm.r = rr.r) AS n FROM (SELECT DISTINCT g FROM t) gg, (VALUES ('urgent'), ('heavy'), ('discounted'), ('never_1'), ('never_2')) rr(r)),
b AS (SELECT x.g, x.r AS a, y.r AS b, count(*) AS n_both FROM mm x JOIN mm y ON x.g = y.g AND x.id = y.id AND x.r < y.r GROUP BY ALL)
SELECT sa.g, sa.r AS a, sb.r AS b, CAST(sa.n AS BIGINT) AS n_a, CAST(sb.n AS BIGINT) AS n_b, coalesce(n_both, 0) AS n_both,
  round(CASE WHEN sa.n + sb.n - coalesce(n_both, 0) = 0 THEN 1.0 ELSE CAST(coalesce(n_both, 0) AS DOUBLE) / (sa.n + sb.n - coalesce(n_both, 0)) END, 9) AS jaccard
FROM sz sa JOIN sz sb ON sa.g = sb.g AND sa.r < sb.r LEFT JOIN b ON b.g = sa.g AND b.a = sa.r AND b.b = sb.r""",
)
def same_structure_overlap(spark, sf_dir):
    rows = cohort(spark, sf_dir).withColumn("g", F.when(F.col("amount") < 150000, "low").otherwise("high"))
    names = F.array_compact(F.array(*[F.when(F.col(c) == 1, F.lit(c)) for c in ("urgent", "heavy", "discounted")]))
    members = rows.select("g", "id", F.explode(names).alias("r"))
    every = rows.select("g").distinct().select("g", F.explode(F.array(*[F.lit(x) for x in ("urgent", "heavy", "discounted", "never_1", "never_2")])).alias("r"))
    sizes = every.join(members.groupBy("g", "r").agg(F.count(F.lit(1)).alias("size")), ["g", "r"], "left").withColumn("size", F.coalesce("size", F.lit(0)))
    return G.jaccard_pairs(members, ["g"], "r", "id", sizes).withColumn("jaccard", rounded(F.col("jaccard")))


# ---- permutations -----------------------------------------------------------------------------------

_PERM_ARM = [G.Arm("returned", "returned", 0.10)]
PERMUTATIONS = 1000
#: Permutations of the small query that is held against SQL.
_N_PERM = 9


def _permutation_p(spark, sf_dir, permutations):
    rows = G.durable(cohort(spark, sf_dir).select("id", *FEATURES, "returned").withColumn("all", F.lit(1)))
    # The predictors are the same in every permutation: one set of selectors serves all, and a row's pattern is made once.
    selectors = G.durable(G.make_selectors(rows, ["all"], FEATURES))
    each = G.durable(G.make_patterns(rows, ["id", "all"], FEATURES, ["returned"], selectors, ["all"]))
    patterns = G.durable(G.permutation_patterns(each, ["id"], "returned", 99, permutations))
    rules = G.durable(G.beam_search(patterns, selectors, ["s", "all"], ["all"], _PERM_ARM, 2, 20, 20))
    best = rules.filter("s > 0").groupBy("s").agg(F.max("wracc").alias("w"))
    null_scores = spark.range(1, permutations + 1).select(F.col("id").cast("int").alias("s")).join(best, "s", "left").select(
        F.lit("returned").alias("arm"), F.coalesce("w", F.lit(0.0)).alias("max_wracc")
    )
    out = G.permutation_p(rules.filter("s = 0").select("arm", "rule_key", "wracc"), null_scores, ["arm"], permutations)
    return out.select("rule_key", *[rounded(F.col(c)).alias(c) for c in ("wracc", "null_mean", "null_q95", "p_adjusted")])


@query("subgroup_permutation_p")
def subgroup_permutation_p(spark, sf_dir):
    return _permutation_p(spark, sf_dir, PERMUTATIONS)


@query(
    "subgroup_permutation_p_small",
    f"""WITH {COHORT_SQL}, pr AS (SELECT c.* EXCLUDE (returned), CAST(p AS INT) AS s, 0 AS none,
  CASE WHEN row_number() OVER (PARTITION BY p ORDER BY {sql_md5("'99'", 'p', 'id')}, id) <= sum(returned) OVER (PARTITION BY p) THEN 1 ELSE 0 END AS shuffled, returned
  FROM cohort c, (SELECT unnest(range(0, {_N_PERM + 1})) AS p)),
xs AS (SELECT * EXCLUDE (shuffled, returned), 'train' AS part, CASE WHEN s = 0 THEN returned ELSE shuffled END AS returned FROM pr), {beam_sql(_PERM_ARM, 2, 20, 20)},
nl AS (SELECT k.s, coalesce(max(wracc), 0) AS w FROM (SELECT DISTINCT s FROM xs WHERE s > 0) k LEFT JOIN rules ON rules.s = k.s GROUP BY k.s)
SELECT rule_key, round(wracc, 9) AS wracc, round((SELECT avg(w) FROM nl), 9) AS null_mean, round((SELECT quantile_cont(w, 0.95) FROM nl), 9) AS null_q95,
  round((1 + (SELECT count(*) FROM nl WHERE w >= rules.wracc)) / {_N_PERM + 1}.0, 9) AS p_adjusted FROM rules WHERE s = 0""",
)
def subgroup_permutation_p_small(spark, sf_dir):
    return _permutation_p(spark, sf_dir, _N_PERM)


_MEASURES = ["size", "depth", "centre"]


@query(
    "matched_feature_sets",
    f"""WITH {COHORT_SQL}, g AS (SELECT l_orderkey AS id, max(l_quantity) AS size, avg(CASE WHEN l_discount > 0.02 THEN l_discount END) AS depth, avg(CASE WHEN l_returnflag <> 'N' THEN l_extendedprice END) AS centre
  FROM lineitem GROUP BY l_orderkey),
j AS (SELECT c.*, size, depth, centre FROM cohort c LEFT JOIN g ON g.id = c.id), m AS (SELECT * FROM j WHERE size IS NOT NULL AND depth IS NOT NULL AND centre IS NOT NULL)
SELECT 'full' AS feature_set, {len(FLAGS)}::BIGINT AS n_features, count(*) AS n, CAST(sum(returned) AS BIGINT) AS n_returned, CAST(sum(heavy) AS BIGINT) AS n_heavy, NULL AS depth FROM j
UNION ALL SELECT 'matched', {len(FLAGS)}, count(*), CAST(sum(returned) AS BIGINT), CAST(sum(heavy) AS BIGINT), NULL FROM m
UNION ALL SELECT 'geometry', {len(FLAGS) + 3}, count(*), CAST(sum(returned) AS BIGINT), CAST(sum(heavy) AS BIGINT), round(avg(depth), 9) FROM m""",
)
def matched_feature_sets(spark, sf_dir):
    """Flags of all orders, of those with all measures, and flags with measures, which come from a table of their own."""
    lines = table(spark, sf_dir, "lineitem")
    geometry = lines.groupBy(F.col("l_orderkey").alias("id")).agg(
        F.max("l_quantity").alias("size"), F.avg(F.when(F.col("l_discount") > 0.02, F.col("l_discount"))).alias("depth"), F.avg(F.when(F.col("l_returnflag") != "N", F.col("l_extendedprice"))).alias("centre")
    )
    out = None
    for name, part in P.matched_feature_sets(cohort(spark, sf_dir), geometry, "id", FLAGS, _MEASURES, ["returned"]).items():
        depth = rounded(F.avg("depth")) if "depth" in part.columns else F.lit(None).cast("double")
        one = part.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("returned").cast("bigint")).alias("n_returned"), F.sum(F.col("heavy").cast("bigint")).alias("n_heavy"), depth.alias("depth"))
        one = one.select(F.lit(name).alias("feature_set"), F.lit(len(part.columns) - 2).cast("bigint").alias("n_features"), "n", "n_returned", "n_heavy", "depth")
        out = one if out is None else out.unionByName(one)
    return out
