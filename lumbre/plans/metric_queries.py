"""Out-of-fold metrics and threshold choice."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumbre.functions.numeric import rounded
from lumbre.operators import metrics as M
from lumbre.operators import thresholds as T
from lumbre.plans.base import LABELS, OOF_SQL, oof
from lumbre.plans.registry import query


def _round(df, keys, names, digits=9):
    return df.select(*keys, *[rounded(F.col(n), digits).alias(n) for n in names])


def conf_sql(keys: str, source: str = "oof") -> str:
    return f"""SELECT {keys}, sum(y_true * pred) AS tp, sum((1 - y_true) * pred) AS fp,
  sum(y_true * (1 - pred)) AS fn, sum((1 - y_true) * (1 - pred)) AS tn FROM {source} GROUP BY {keys}"""


BINARY_SQL = {
    "precision": "coalesce(tp / nullif(tp + fp, 0), 0)",
    "recall": "coalesce(tp / nullif(tp + fn, 0), 0)",
    "specificity": "coalesce(tn / nullif(tn + fp, 0), 0)",
    "npv": "coalesce(tn / nullif(tn + fn, 0), 0)",
    "f1": "coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)",
    "jaccard": "coalesce(tp / nullif(tp + fp + fn, 0), 0)",
    "accuracy": "(tp + tn) / (tp + tn + fp + fn)",
    "balanced_accuracy": "(tp / (tp + fn) + tn / (tn + fp)) / 2",
    "gmean": "sqrt((tp / (tp + fn)) * (tn / (tn + fp)))",
    "mcc": "coalesce((tp * tn - fp * fn) / nullif(sqrt(tp + fp) * sqrt(tp + fn) * sqrt(tn + fp) * sqrt(tn + fn), 0), 0)",
}
EXTRA_SQL = {
    "fpr": "fp / (fp + tn)",
    "fnr": "fn / (fn + tp)",
    "cohen_kappa": """((tp + fp + fn + tn) * (tp + tn) - ((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)))
      / ((tp + fp + fn + tn) * (tp + fp + fn + tn) - ((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)))""",
}


def _doubles(select: str) -> str:
    return f"""SELECT * REPLACE (CAST(tp AS DOUBLE) AS tp, CAST(fp AS DOUBLE) AS fp, CAST(fn AS DOUBLE) AS fn, CAST(tn AS DOUBLE) AS tn)
  FROM ({select})"""


def _list(exprs: dict[str, str], digits: int = 9) -> str:
    return ", ".join(f"round({e}, {digits}) AS {n}" for n, e in exprs.items())


_KEYS = ["run", "fold", "label"]


@query(
    "confusion_metrics",
    f"""WITH {OOF_SQL}, c AS ({_doubles(conf_sql('run, fold, label'))})
SELECT run, fold, label, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn,
  CAST(tp + fn AS BIGINT) AS support, CAST(tp + fp AS BIGINT) AS predicted_positive, {_list(BINARY_SQL)} FROM c""",
)
def confusion_metrics(spark, sf_dir):
    out = M.with_confusion_metrics(M.confusion(oof(spark, sf_dir), _KEYS), 0.0, list(BINARY_SQL))
    return _round(out, [*_KEYS, "tp", "fp", "fn", "tn", "support", "predicted_positive"], list(BINARY_SQL))


def auc_sql(keys: str, source: str = "oof") -> str:
    on = " AND ".join(f"d.{k.strip()} = t.{k.strip()}" for k in keys.split(","))
    d_keys = ", ".join(f"d.{k.strip()}" for k in keys.split(","))
    return f"""SELECT {d_keys}, sum(d.pos * (d.neg_below + d.neg / 2.0)) / (any_value(t.p) * any_value(t.n)) AS roc_auc,
  sum(d.pos * d.tp_ge / (d.tp_ge + d.fp_ge)) / any_value(t.p) AS average_precision
FROM (SELECT *, coalesce(sum(neg) OVER (PARTITION BY {keys} ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_below,
        sum(pos) OVER (PARTITION BY {keys} ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS tp_ge,
        sum(neg) OVER (PARTITION BY {keys} ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS fp_ge
      FROM (SELECT {keys}, score, CAST(sum(y_true) AS DOUBLE) AS pos, CAST(sum(1 - y_true) AS DOUBLE) AS neg
            FROM {source} GROUP BY {keys}, score)) d
JOIN (SELECT {keys}, CAST(sum(y_true) AS DOUBLE) AS p, CAST(sum(1 - y_true) AS DOUBLE) AS n FROM {source} GROUP BY {keys}) t ON {on}
GROUP BY {d_keys}"""


@query(
    "score_metrics",
    f"""WITH {OOF_SQL}, a AS ({auc_sql('run, fold, label')})
SELECT run, fold, label, round(roc_auc, 9) AS roc_auc, round(average_precision, 9) AS average_precision FROM a""",
)
def score_metrics(spark, sf_dir):
    return _round(M.score_metrics(oof(spark, sf_dir), _KEYS), _KEYS, ["roc_auc", "average_precision"])


@query(
    "pooled_score_metrics",
    f"""WITH {OOF_SQL}, a AS ({auc_sql('run, label')})
SELECT run, label, round(roc_auc, 9) AS roc_auc, round(average_precision, 9) AS average_precision FROM a""",
)
def pooled_score_metrics(spark, sf_dir):
    return _round(M.score_metrics(oof(spark, sf_dir), ["run", "label"]), ["run", "label"], ["roc_auc", "average_precision"])


@query(
    "brier_score",
    f"""WITH {OOF_SQL} SELECT run, label, round(avg(power(least(greatest(score, 0.0), 1.0) - y_true, 2)), 9) AS brier_score
FROM oof GROUP BY run, label""",
)
def brier_score(spark, sf_dir):
    return _round(M.brier(oof(spark, sf_dir), ["run", "label"]), ["run", "label"], ["brier_score"])


_REPORT = {**BINARY_SQL, **EXTRA_SQL}


@query(
    "label_report",
    f"""WITH {OOF_SQL}, c AS ({_doubles(conf_sql('run, label'))}), a AS ({auc_sql('run, label')}),
b AS (SELECT run, label, avg(power(score - y_true, 2)) AS brier_score FROM oof GROUP BY run, label)
SELECT c.run, c.label, CAST(tp + fn AS BIGINT) AS support, CAST(tp + fp AS BIGINT) AS predicted_positive, {_list(_REPORT)},
  round(roc_auc, 9) AS roc_auc, round(average_precision, 9) AS average_precision, round(brier_score, 9) AS brier_score
FROM c JOIN a ON c.run = a.run AND c.label = a.label JOIN b ON c.run = b.run AND c.label = b.label""",
)
def label_report(spark, sf_dir):
    out = M.label_report(oof(spark, sf_dir), ["run", "label"])
    return _round(out, ["run", "label", "support", "predicted_positive"], [*_REPORT, "roc_auc", "average_precision", "brier_score"])


_AVG = ["f1", "precision", "recall", "jaccard"]
AVERAGED_SQL = ", ".join(
    [f"avg({n}) AS {n}_macro, coalesce(sum({n} * (tp + fn)) / nullif(sum(tp + fn), 0), 0) AS {n}_weighted" for n in _AVG]
)
_AVG_NAMES = [f"{n}_{k}" for k in ("micro", "macro", "weighted") for n in _AVG]


def averaged_sql(keys: str, source: str = "oof") -> str:
    """CTE text for per-key averaged metrics named ``av``."""
    using = keys
    return f"""c AS ({_doubles(conf_sql(keys + ', label', source))}),
pl AS (SELECT *, {", ".join(f"{BINARY_SQL[n]} AS {n}" for n in _AVG)} FROM c),
mac AS (SELECT {keys}, {AVERAGED_SQL} FROM pl GROUP BY {keys}),
pool AS (SELECT {keys}, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, sum(tn) AS tn FROM c GROUP BY {keys}),
mic AS (SELECT {keys}, {", ".join(f"{BINARY_SQL[n]} AS {n}_micro" for n in _AVG)} FROM pool),
av AS (SELECT * FROM mac JOIN mic USING ({using}))"""


_ROW_NAMES = [
    "subset_accuracy", "zero_one_loss", "hamming_loss", "hamming_score", "f1_samples", "precision_samples", "recall_samples", "jaccard_samples"
]
ROW_SQL = """rws AS (SELECT run, fold, id, CAST(sum(y_true * pred) AS DOUBLE) AS tp, CAST(sum((1 - y_true) * pred) AS DOUBLE) AS fp,
  CAST(sum(y_true * (1 - pred)) AS DOUBLE) AS fn, count(*) AS n FROM oof GROUP BY run, fold, id),
ra AS (SELECT run, fold, count(*) AS n_rows, avg(CASE WHEN fp + fn = 0 THEN 1.0 ELSE 0.0 END) AS subset_accuracy,
  1 - avg(CASE WHEN fp + fn = 0 THEN 1.0 ELSE 0.0 END) AS zero_one_loss,
  avg((fp + fn) / n) AS hamming_loss, 1 - avg((fp + fn) / n) AS hamming_score,
  avg(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)) AS f1_samples, avg(coalesce(tp / nullif(tp + fp, 0), 0)) AS precision_samples,
  avg(coalesce(tp / nullif(tp + fn, 0), 0)) AS recall_samples, avg(coalesce(tp / nullif(tp + fp + fn, 0), 0)) AS jaccard_samples
  FROM rws GROUP BY run, fold)"""


@query(
    "multilabel_report",
    f"""WITH {OOF_SQL}, {averaged_sql('run, fold')}, {ROW_SQL}
SELECT av.run, av.fold, n_rows, {", ".join(f"round({n}, 9) AS {n}" for n in _AVG_NAMES + _ROW_NAMES)}
FROM av JOIN ra ON av.run = ra.run AND av.fold = ra.fold""",
)
def multilabel_report(spark, sf_dir):
    out = M.multilabel_report(oof(spark, sf_dir), ["run", "fold"])
    return _round(out, ["run", "fold", "n_rows"], _AVG_NAMES + _ROW_NAMES)


_SCORE_AVG = [f"{m}_{k}" for m in ("roc_auc", "average_precision") for k in ("macro", "weighted", "micro")]


@query(
    "averaged_score_metrics",
    f"""WITH {OOF_SQL}, a AS ({auc_sql('run, fold, label')}), pooled AS ({auc_sql('run, fold')}),
s AS (SELECT run, fold, label, sum(y_true) AS p FROM oof GROUP BY run, fold, label),
m AS (SELECT a.run, a.fold, avg(roc_auc) AS roc_auc_macro, avg(average_precision) AS average_precision_macro,
  sum(roc_auc * p) / sum(p) AS roc_auc_weighted, sum(average_precision * p) / sum(p) AS average_precision_weighted
  FROM a JOIN s ON a.run = s.run AND a.fold = s.fold AND a.label = s.label GROUP BY a.run, a.fold)
SELECT m.run, m.fold, round(roc_auc_macro, 9) AS roc_auc_macro, round(roc_auc_weighted, 9) AS roc_auc_weighted,
  round(average_precision_macro, 9) AS average_precision_macro, round(average_precision_weighted, 9) AS average_precision_weighted,
  round(roc_auc, 9) AS roc_auc_micro, round(average_precision, 9) AS average_precision_micro
FROM m JOIN pooled ON m.run = pooled.run AND m.fold = pooled.fold""",
)
def averaged_score_metrics(spark, sf_dir):
    return _round(M.averaged_score_metrics(oof(spark, sf_dir), ["run", "fold"]), ["run", "fold"], _SCORE_AVG)


@query(
    "label_ranking_metrics",
    f"""WITH {OOF_SQL},
x AS (SELECT a.run, a.fold, a.id, a.label, a.y_true, a.score,
  sum(CASE WHEN b.score >= a.score THEN 1 ELSE 0 END) AS rank_all,
  sum(CASE WHEN b.score >= a.score AND b.y_true = 1 THEN 1 ELSE 0 END) AS rank_true,
  sum(CASE WHEN b.score >= a.score AND b.y_true = 0 THEN 1 ELSE 0 END) AS wrong, sum(b.y_true) AS np, sum(1 - b.y_true) AS nn
  FROM oof a JOIN oof b ON a.run = b.run AND a.fold = b.fold AND a.id = b.id GROUP BY ALL),
rr AS (SELECT run, fold, id, max(np) AS np, max(nn) AS nn, avg(CASE WHEN y_true = 1 THEN rank_true / CAST(rank_all AS DOUBLE) END) AS ap,
  sum(CASE WHEN y_true = 1 THEN wrong ELSE 0 END) AS wrong, max(CASE WHEN y_true = 1 THEN rank_all ELSE 0 END) AS depth
  FROM x GROUP BY run, fold, id)
SELECT run, fold, round(avg(CASE WHEN np = 0 OR nn = 0 THEN 1.0 ELSE ap END), 9) AS label_ranking_average_precision,
  round(avg(CASE WHEN np = 0 OR nn = 0 THEN 0.0 ELSE wrong / CAST(np * nn AS DOUBLE) END), 9) AS label_ranking_loss,
  round(avg(depth), 9) AS coverage_error, round(avg(coalesce(ap, 0)), 9) AS average_precision_samples,
  CAST(NULL AS DOUBLE) AS roc_auc_samples
FROM rr GROUP BY run, fold""",
)
def label_ranking_metrics(spark, sf_dir):
    names = ["label_ranking_average_precision", "label_ranking_loss", "coverage_error", "average_precision_samples", "roc_auc_samples"]
    return _round(M.ranking_metrics(oof(spark, sf_dir), ["run", "fold"]), ["run", "fold"], names)


DERIVED_SQL = """derived AS (
  SELECT run, fold, id, label, y_true, pred, score FROM oof
  UNION ALL
  SELECT run, fold, id, 'no_event', 1 - max(y_true), 1 - max(pred), 1 - max(score) FROM oof GROUP BY run, fold, id)"""


@query(
    "derived_state_metrics",
    f"""WITH {OOF_SQL}, {DERIVED_SQL}, c AS ({_doubles(conf_sql('run, label', 'derived'))}), a AS ({auc_sql('run, label', 'derived')})
SELECT c.run, c.label, CAST(tp + fn AS BIGINT) AS support, round({BINARY_SQL['f1']}, 9) AS f1, round({BINARY_SQL['precision']}, 9) AS precision,
  round({BINARY_SQL['recall']}, 9) AS recall, round(roc_auc, 9) AS roc_auc, round(average_precision, 9) AS average_precision
FROM c JOIN a ON c.run = a.run AND c.label = a.label""",
)
def derived_state_metrics(spark, sf_dir):
    three = M.with_derived_state(oof(spark, sf_dir), ["run", "fold"], "id", "no_event", "complement")
    out = M.label_report(three, ["run", "label"])
    return _round(out, ["run", "label", "support"], ["f1", "precision", "recall", "roc_auc", "average_precision"])


@query(
    "derived_state_without_score",
    f"""WITH {OOF_SQL}, {DERIVED_SQL}, {averaged_sql('run, fold', 'derived')}
SELECT run, fold, round(f1_micro, 9) AS f1_micro, round(f1_macro, 9) AS f1_macro, round(f1_weighted, 9) AS f1_weighted FROM av""",
)
def derived_state_without_score(spark, sf_dir):
    three = M.with_derived_state(oof(spark, sf_dir), ["run", "fold"], "id", "no_event", "none")
    return _round(M.averaged_metrics(three, ["run", "fold"]), ["run", "fold"], ["f1_micro", "f1_macro", "f1_weighted"])


@query(
    "outcome_classes",
    f"""WITH {OOF_SQL} SELECT run, label, CASE WHEN y_true = 1 AND pred = 1 THEN 'TP' WHEN pred = 1 THEN 'FP'
  WHEN y_true = 1 THEN 'FN' ELSE 'TN' END AS outcome, count(*) AS n FROM oof GROUP BY ALL""",
)
def outcome_classes(spark, sf_dir):
    return oof(spark, sf_dir).groupBy("run", "label", M.outcome_class().alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


GRID_SQL = "grid AS (SELECT CAST(i AS INT) + 1 AS step, (10 + 5 * i) / 100.0 AS threshold FROM range(17) t(i))"


def grid_sql(keys: str) -> str:
    return f"""{GRID_SQL},
gc AS (SELECT {keys}, step, threshold, CAST(sum(CASE WHEN score >= threshold THEN y_true ELSE 0 END) AS DOUBLE) AS tp,
  CAST(sum(CASE WHEN score >= threshold THEN 1 - y_true ELSE 0 END) AS DOUBLE) AS fp,
  CAST(sum(CASE WHEN score < threshold THEN y_true ELSE 0 END) AS DOUBLE) AS fn,
  CAST(sum(CASE WHEN score < threshold THEN 1 - y_true ELSE 0 END) AS DOUBLE) AS tn FROM oof, grid GROUP BY {keys}, step, threshold)"""


@query(
    "grid_threshold_curve",
    f"""WITH {OOF_SQL}, {grid_sql('run, fold, label')},
m AS (SELECT *, {BINARY_SQL['f1']} AS f1, {BINARY_SQL['precision']} AS precision, {BINARY_SQL['recall']} AS recall FROM gc),
k AS (SELECT *, row_number() OVER (PARTITION BY run, fold, label ORDER BY f1 DESC, round(abs(threshold - 0.5), 9), threshold) AS place FROM m)
SELECT run, fold, label, threshold, round(f1, 9) AS f1, round(precision, 9) AS precision, round(recall, 9) AS recall,
  CASE WHEN place = 1 THEN 1 ELSE 0 END AS selected FROM k""",
)
def grid_threshold_curve(spark, sf_dir):
    out = T.grid_threshold_curve(oof(spark, sf_dir), _KEYS)
    return _round(out, [*_KEYS, "threshold", "selected"], ["f1", "precision", "recall"])


@query(
    "tuned_threshold_predictions",
    f"""WITH {OOF_SQL}, {grid_sql('run, fold, label')},
m AS (SELECT *, {BINARY_SQL['f1']} AS f1 FROM gc),
k AS (SELECT *, row_number() OVER (PARTITION BY run, fold, label ORDER BY f1 DESC, round(abs(threshold - 0.5), 9), threshold) AS place FROM m),
t AS (SELECT o.run, o.label, o.y_true, CASE WHEN o.score >= k.threshold THEN 1 ELSE 0 END AS pred FROM oof o
  JOIN k ON o.run = k.run AND o.fold = k.fold AND o.label = k.label AND k.place = 1)
SELECT run, label, CAST(sum(y_true * pred) AS BIGINT) AS tp, CAST(sum((1 - y_true) * pred) AS BIGINT) AS fp,
  CAST(sum(y_true * (1 - pred)) AS BIGINT) AS fn, CAST(sum((1 - y_true) * (1 - pred)) AS BIGINT) AS tn FROM t GROUP BY run, label""",
)
def tuned_threshold_predictions(spark, sf_dir):
    rows = oof(spark, sf_dir)
    chosen = T.grid_threshold_curve(rows, _KEYS).filter("selected = 1")
    return M.confusion(T.apply_thresholds(rows, chosen, _KEYS), ["run", "label"])


_OBS_SQL = f"""
d AS (SELECT run, fold, label, score, row_number() OVER (PARTITION BY run, fold, label ORDER BY score) - 1 AS i,
  count(*) OVER (PARTITION BY run, fold, label) AS m FROM (SELECT DISTINCT run, fold, label, score FROM oof)),
g AS (SELECT d.run, d.fold, d.label, j, any_value(m) AS m FROM d, range(201) r(j) WHERE m > 201 GROUP BY d.run, d.fold, d.label, j),
qs AS (SELECT g.run, g.fold, g.label, lo.score + (hi.score - lo.score) * (CASE WHEN j * (g.m - 1) % 200 = 0 THEN 1.0 ELSE j * (g.m - 1) / 200.0 - floor(j * (g.m - 1) / 200.0) END) AS threshold
  FROM g JOIN d lo ON lo.run = g.run AND lo.fold = g.fold AND lo.label = g.label AND lo.i = floor(j * (g.m - 1) / 200.0)
  JOIN d hi ON hi.run = g.run AND hi.fold = g.fold AND hi.label = g.label AND hi.i = ceil(j * (g.m - 1) / 200.0)),
cand AS (SELECT run, fold, label, threshold FROM qs UNION SELECT run, fold, label, score FROM d WHERE m <= 201
  UNION SELECT DISTINCT run, fold, label, 0.0 FROM d UNION SELECT DISTINCT run, fold, label, 1.0 FROM d),
oc AS (SELECT cand.run, cand.fold, cand.label, threshold, CAST(sum(CASE WHEN score >= threshold THEN y_true ELSE 0 END) AS DOUBLE) AS tp,
  CAST(sum(CASE WHEN score >= threshold THEN 1 - y_true ELSE 0 END) AS DOUBLE) AS fp,
  CAST(sum(CASE WHEN score < threshold THEN y_true ELSE 0 END) AS DOUBLE) AS fn,
  CAST(sum(CASE WHEN score < threshold THEN 1 - y_true ELSE 0 END) AS DOUBLE) AS tn
  FROM cand JOIN oof ON oof.run = cand.run AND oof.fold = cand.fold AND oof.label = cand.label GROUP BY ALL),
om AS (SELECT *, {BINARY_SQL['gmean']} AS gmean, {BINARY_SQL['mcc']} AS mcc, {BINARY_SQL['f1']} AS f1 FROM oc),
ok AS (SELECT *, row_number() OVER (PARTITION BY run, fold, label ORDER BY gmean DESC, mcc DESC, f1 DESC, abs(threshold - 0.5), threshold DESC) AS place FROM om)
"""


@query(
    "observed_score_threshold",
    f"""WITH {OOF_SQL}, {_OBS_SQL}
SELECT run, fold, label, round(threshold, 9) AS threshold, round(gmean, 9) AS gmean, round(mcc, 9) AS mcc, round(f1, 9) AS f1 FROM ok WHERE place = 1""",
)
def observed_score_threshold(spark, sf_dir):
    return _round(T.observed_threshold(oof(spark, sf_dir), _KEYS), _KEYS, ["threshold", "gmean", "mcc", "f1"])


@query(
    "joint_threshold_search",
    f"""WITH {OOF_SQL}, {grid_sql('run, label')},
j AS (SELECT a.run, a.threshold AS ta, b.threshold AS tb, a.step * 17 + b.step AS combo,
  2 * (a.tp + b.tp) / nullif(2 * (a.tp + b.tp) + a.fp + b.fp + a.fn + b.fn, 0) AS f1_micro,
  (coalesce(2 * a.tp / nullif(2 * a.tp + a.fp + a.fn, 0), 0) + coalesce(2 * b.tp / nullif(2 * b.tp + b.fp + b.fn, 0), 0)) / 2 AS f1_macro
  FROM gc a JOIN gc b ON a.run = b.run AND a.label = 'returned' AND b.label = 'open_line'),
k AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY f1_micro DESC, round(f1_macro, 12) DESC,
  CASE WHEN ta = 0.5 AND tb = 0.5 THEN 0 ELSE 1 END, combo) AS place FROM j)
SELECT run, ta AS threshold_returned, tb AS threshold_open_line, round(f1_micro, 9) AS f1_micro, round(f1_macro, 9) AS f1_macro FROM k WHERE place = 1""",
)
def joint_threshold_search(spark, sf_dir):
    out = T.joint_thresholds(oof(spark, sf_dir), ["run"], LABELS)
    return _round(out, ["run", "threshold_returned", "threshold_open_line"], ["f1_micro", "f1_macro"])
