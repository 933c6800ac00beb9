"""Collecting, verifying and ranking results derived from the out-of-fold table."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumbre.functions.numeric import rounded
from lumbre.operators import joins as J
from lumbre.operators import metrics as M
from lumbre.operators import results as R
from lumbre.plans.base import OOF_SQL, oof, table
from lumbre.plans.metric_queries import BINARY_SQL, _doubles, averaged_sql, conf_sql
from lumbre.plans.prepare_queries import method_metrics
from lumbre.plans.registry import query

_METRICS = ["f1", "precision", "recall", "gmean"]
FOLD_SQL = f"""c AS ({_doubles(conf_sql('run, fold, label'))}),
fm AS (SELECT run, fold, label, {", ".join(f"{BINARY_SQL[m]} AS {m}" for m in _METRICS)} FROM c),
fl AS ({" UNION ALL ".join(f"SELECT run, fold, label, '{m}' AS metric, {m} AS value FROM fm" for m in _METRICS)})"""


def fold_metrics(spark, sf_dir):
    return M.with_confusion_metrics(M.confusion(oof(spark, sf_dir), ["run", "fold", "label"]), 0.0, _METRICS)


def _fold_long(spark, sf_dir):
    return R.long_metrics(fold_metrics(spark, sf_dir), ["run", "fold", "label"], _METRICS)


def _summary(name: str, deviation: str, sd_sql: str, keys: str):
    key_list = keys.split(", ")

    @query(
        name,
        f"""WITH {OOF_SQL}, {FOLD_SQL} SELECT {keys}, metric, count(value) AS n, round(avg(value), 9) AS mean, round({sd_sql}, 9) AS sd, round(min(value), 9) AS min, round(max(value), 9) AS max
FROM fl GROUP BY {keys}, metric""",
    )
    def run(spark, sf_dir):
        out = R.fold_summary(_fold_long(spark, sf_dir), key_list, deviation)
        return out.select(*key_list, "metric", "n", *[rounded(F.col(c)).alias(c) for c in ("mean", "sd", "min", "max")])

    return run


_summary("fold_summary_sample_sd", "sample", "stddev_samp(value)", "run, label")
_summary("fold_summary_population_sd", "population", "stddev_pop(value)", "run")
_summary("fold_summary_zero_sd", "sample_or_zero", "coalesce(stddev_samp(value), 0)", "run, label, fold")


@query(
    "family_summary",
    f"""WITH {OOF_SQL}, {FOLD_SQL} SELECT run, count(*) AS n_runs, round(avg(f1), 9) AS f1_mean, round(stddev_samp(f1), 9) AS f1_sd, round(avg(gmean), 9) AS gmean_mean, round(stddev_samp(gmean), 9) AS gmean_sd
FROM fm GROUP BY run""",
)
def family_summary(spark, sf_dir):
    out = R.family_summary(fold_metrics(spark, sf_dir), ["run"], ["f1", "gmean"])
    return out.select("run", "n_runs", *[rounded(F.col(c)).alias(c) for c in ("f1_mean", "f1_sd", "gmean_mean", "gmean_sd")])


@query(
    "mean_rows_appended",
    f"""WITH {OOF_SQL}, {FOLD_SQL} SELECT run, label, CAST(fold AS VARCHAR) AS fold, round(f1, 9) AS f1, round(recall, 9) AS recall FROM fm
UNION ALL SELECT run, label, 'mean', round(avg(f1), 9), round(avg(recall), 9) FROM fm GROUP BY run, label""",
)
def mean_rows_appended(spark, sf_dir):
    out = R.with_mean_rows(fold_metrics(spark, sf_dir), ["run", "label"], "fold", ["f1", "recall"])
    return out.select("run", "label", "fold", rounded(F.col("f1")).alias("f1"), rounded(F.col("recall")).alias("recall"))


@query(
    "paired_delta_summary",
    """WITH t AS (SELECT r.r_name, n.n_name, l_linestatus AS method, avg(l_discount) AS discount, avg(l_quantity) AS quantity
  FROM lineitem JOIN supplier s ON l_suppkey = s_suppkey JOIN nation n ON s_nationkey = n_nationkey JOIN region r ON n_regionkey = r_regionkey GROUP BY ALL),
d AS (SELECT a.r_name, b.discount - a.discount AS dd, b.quantity - a.quantity AS dq FROM t a JOIN t b ON a.r_name = b.r_name AND a.n_name = b.n_name AND a.method = 'F' AND b.method = 'O')
SELECT r_name, count(*) AS n_pairs, round(avg(dd), 9) AS delta_discount_mean, round(coalesce(stddev_samp(dd), 0), 9) AS delta_discount_sd, count(CASE WHEN dd < 0 THEN 1 END) AS wins_discount,
  round(avg(dq), 6) AS delta_quantity_mean, round(coalesce(stddev_samp(dq), 0), 6) AS delta_quantity_sd, count(CASE WHEN dq > 0 THEN 1 END) AS wins_quantity FROM d GROUP BY r_name""",
)
def paired_delta_summary(spark, sf_dir):
    deltas = J.paired_deltas(method_metrics(spark, sf_dir), ["r_name", "n_name"], "method", "F", "O", ["discount", "quantity"])
    out = R.paired_delta_summary(deltas, ["r_name"], ["discount", "quantity"], ("discount",))
    digits = {"delta_discount_mean": 9, "delta_discount_sd": 9, "delta_quantity_mean": 6, "delta_quantity_sd": 6}
    return out.withColumns({c: rounded(F.col(c), d) for c, d in digits.items()})


@query(
    "stored_metric_verification",
    f"""WITH {OOF_SQL}, {FOLD_SQL}, st AS (SELECT run, fold, label, metric, CASE WHEN metric = 'f1' AND fold = 2 THEN value + 0.001 ELSE value END AS value FROM fl WHERE NOT (metric = 'recall' AND fold = 5))
SELECT f.run, f.fold, f.label, f.metric, CASE WHEN st.value IS NULL THEN 'missing' ELSE 'different' END AS problem FROM fl f LEFT JOIN st
  ON f.run = st.run AND f.fold = st.fold AND f.label = st.label AND f.metric = st.metric WHERE st.value IS NULL OR abs(st.value - f.value) > 1e-6""",
)
def stored_metric_verification(spark, sf_dir):
    fresh = _fold_long(spark, sf_dir)
    stored = fresh.filter("NOT (metric = 'recall' AND fold = 5)").withColumn(
        "value", F.col("value") + F.when((F.col("metric") == "f1") & (F.col("fold") == 2), 0.001).otherwise(0.0)
    )
    return R.metric_mismatches(stored, fresh, ["run", "fold", "label"]).drop("stored", "recomputed")


@query(
    "stored_prediction_verification",
    f"""WITH {OOF_SQL}, p AS (SELECT run, label, score, CASE WHEN score = 0.5 THEN 0 WHEN id % 1000 = 7 THEN 1 - pred ELSE pred END AS pred FROM oof),
m AS (SELECT *, pred <> CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS mismatch, abs(score - 0.5) <= 1e-7 AS tie FROM p)
SELECT run, label, count(*) AS n, count(CASE WHEN mismatch AND tie THEN 1 END) AS n_ties, count(CASE WHEN mismatch AND NOT tie THEN 1 END) AS n_invalid,
  round(max(CASE WHEN mismatch AND NOT tie THEN abs(score - 0.5) END), 9) AS max_difference FROM m GROUP BY run, label""",
)
def stored_prediction_verification(spark, sf_dir):
    pred = F.when(F.col("score") == 0.5, 0).when(F.col("id") % 1000 == 7, 1 - F.col("pred")).otherwise(F.col("pred"))
    out = R.prediction_check(oof(spark, sf_dir).withColumn("pred", pred), ["run", "label"], F.lit(0.5))
    return out.withColumn("max_difference", rounded(F.col("max_difference")))


@query(
    "threshold_per_fold_check",
    f"""WITH {OOF_SQL}, t AS (SELECT run, fold, CASE WHEN run = 'r2' AND fold = 3 AND id % 2 = 0 THEN 0.4 ELSE 0.5 END AS threshold FROM oof),
s AS (SELECT run, fold, CASE WHEN run = 'r3' AND fold = 1 THEN 0.6 ELSE 0.5 END AS expected FROM oof GROUP BY run, fold),
p AS (SELECT run, fold, min(threshold) AS lo, max(threshold) AS hi FROM t GROUP BY run, fold)
SELECT p.run, p.fold, CASE WHEN lo <> hi THEN 'several values' ELSE 'differs from summary' END AS problem FROM p JOIN s ON p.run = s.run AND p.fold = s.fold WHERE lo <> hi OR lo <> expected""",
)
def threshold_per_fold_check(spark, sf_dir):
    rows = oof(spark, sf_dir)
    used = F.when((F.col("run") == "r2") & (F.col("fold") == 3) & (F.col("id") % 2 == 0), 0.4).otherwise(0.5)
    summary = rows.select("run", "fold").distinct().withColumn("threshold", F.when((F.col("run") == "r3") & (F.col("fold") == 1), 0.6).otherwise(0.5))
    return R.threshold_per_fold(rows.withColumn("threshold", used), ["run", "fold"], "threshold", summary)


_RUN_SQL = f"""{averaged_sql('run')}, rf AS (SELECT run, count(DISTINCT fold) AS n_folds FROM oof GROUP BY run),
runs AS (SELECT av.run AS config_id, f1_micro, f1_macro, n_folds, CASE WHEN av.run = 'r1' THEN 'oom' ELSE 'OK ' END AS status FROM av JOIN rf ON av.run = rf.run)"""


def _runs(spark, sf_dir):
    rows = oof(spark, sf_dir)
    folds = rows.groupBy("run").agg(F.countDistinct("fold").alias("n_folds"))
    table_ = M.averaged_metrics(rows, ["run"]).join(folds, "run").withColumnRenamed("run", "config_id")
    return table_.select("config_id", "f1_micro", "f1_macro", "n_folds", F.when(F.col("config_id") == "r1", "oom").otherwise("OK ").alias("status"))


@query(
    "best_complete_candidate",
    f"""WITH {OOF_SQL}, {_RUN_SQL} SELECT config_id, round(f1_micro, 9) AS f1_micro, n_folds FROM runs WHERE lower(trim(status)) = 'ok' AND n_folds = 5
ORDER BY runs.f1_micro DESC, f1_macro DESC, config_id DESC LIMIT 1""",
)
def best_complete_candidate(spark, sf_dir):
    return R.best_complete_candidate(_runs(spark, sf_dir), 5).select("config_id", rounded(F.col("f1_micro")).alias("f1_micro"), "n_folds")


@query(
    "follow_up_grid",
    f"""WITH {OOF_SQL}, {FOLD_SQL}, top AS (SELECT run, fold, label, f1 FROM fm ORDER BY f1 DESC, run, fold, label LIMIT 5)
SELECT run, fold, label, round(f1, 9) AS f1, sampler FROM top, (VALUES ('smote'), ('random_over_sampler')) v(sampler)""",
)
def follow_up_grid(spark, sf_dir):
    runs = fold_metrics(spark, sf_dir).select("run", "fold", "label", "f1")
    out = R.follow_up_grid(runs, [F.desc("f1"), F.col("run"), F.col("fold"), F.col("label")], 5, "sampler", ["smote", "random_over_sampler"])
    return out.withColumn("f1", rounded(F.col("f1")))


@query(
    "extreme_cases",
    f"""WITH {OOF_SQL}, k AS (SELECT run, label, y_true, pred, id, score, row_number() OVER (PARTITION BY run, label, y_true, pred ORDER BY score DESC, id) AS place FROM oof)
SELECT run, label, y_true, pred, id, score FROM k WHERE place = 1""",
)
def extreme_cases(spark, sf_dir):
    rows = oof(spark, sf_dir).select("run", "label", "y_true", "pred", "id", "score")
    return R.extreme_cases(rows, ["run", "label", "y_true", "pred"], "id")


@query(
    "priority_cases",
    f"""WITH {OOF_SQL}, h AS (SELECT o.run, o.label, o.id, o.score, CASE WHEN pred = 1 THEN 'tp' ELSE 'fn' END AS kind, c.returned * c.open_line AS multi FROM oof o JOIN cohort c ON o.id = c.id WHERE y_true = 1),
a AS (SELECT *, row_number() OVER (PARTITION BY run, label, kind ORDER BY multi DESC, CASE WHEN kind = 'tp' THEN -score ELSE score END, id) AS i FROM h),
b AS (SELECT *, row_number() OVER (PARTITION BY run, label ORDER BY CASE WHEN i = 1 THEN 0 ELSE 1 END, CASE WHEN kind = 'tp' THEN 0 ELSE 1 END, i) AS position FROM a)
SELECT run, label, id, kind, CAST(position AS INT) AS position FROM b WHERE position <= 6""",
)
def priority_cases(spark, sf_dir):
    from lumbre.plans.base import cohort

    multi = cohort(spark, sf_dir).select("id", (F.col("returned") * F.col("open_line")).alias("multi"))
    rows = oof(spark, sf_dir).join(multi, "id")
    return R.priority_cases(rows, ["run", "label"], "id", "multi", 6).select("run", "label", "id", "kind", "position")


@query(
    "run_status_matrix",
    """WITH s AS (SELECT p_type, p_name || ' ' || p_partkey AS name, CASE WHEN p_size > 48 THEN 'oom' WHEN p_size > 45 THEN 'error' ELSE 'ok' END AS status FROM part)
SELECT p_type, count(*) AS n_runs, count(CASE WHEN status = 'ok' THEN 1 END) AS n_ok, count(CASE WHEN status = 'oom' THEN 1 END) AS n_oom, count(CASE WHEN status = 'error' THEN 1 END) AS n_error,
  CASE WHEN count(CASE WHEN status = 'ok' THEN 1 END) = count(*) THEN 1 ELSE 0 END AS all_ok, CASE WHEN count(CASE WHEN status = 'oom' THEN 1 END) > 0 THEN 1 ELSE 0 END AS any_oom,
  CASE WHEN count(CASE WHEN status = 'error' THEN 1 END) > 0 THEN 1 ELSE 0 END AS any_error, coalesce(string_agg(name, ' | ' ORDER BY name) FILTER (status = 'oom'), '') AS oom_names,
  coalesce(string_agg(name, ' | ' ORDER BY name) FILTER (status = 'error'), '') AS error_names FROM s GROUP BY p_type""",
)
def run_status_matrix(spark, sf_dir):
    name = F.concat_ws(" ", "p_name", "p_partkey")
    runs = table(spark, sf_dir, "part").select("p_type", name.alias("name"), F.when(F.col("p_size") > 48, "oom").when(F.col("p_size") > 45, "error").otherwise("ok").alias("status"))
    return R.status_matrix(runs, "p_type", ["ok", "oom", "error"], "name")


@query(
    "best_per_family",
    """WITH s AS (SELECT p_type, p_partkey, p_retailprice, CASE WHEN p_size > 40 THEN 'oom' WHEN p_size > 30 THEN 'error' ELSE 'ok' END AS status FROM part),
k AS (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY CASE status WHEN 'ok' THEN 0 WHEN 'oom' THEN 1 ELSE 2 END, p_retailprice DESC, p_partkey) AS place FROM s)
SELECT p_type, p_partkey, status, p_retailprice FROM k WHERE place = 1""",
)
def best_per_family(spark, sf_dir):
    runs = table(spark, sf_dir, "part").select(
        "p_type", "p_partkey", F.when(F.col("p_size") > 40, "oom").when(F.col("p_size") > 30, "error").otherwise("ok").alias("status"), "p_retailprice"
    )
    return R.best_per_family(runs, "p_type", [R.status_order("status", ["ok", "oom", "error"]), F.desc("p_retailprice"), F.col("p_partkey")])


@query(
    "incomplete_runs",
    """WITH t AS (SELECT user_id, count(DISTINCT event_type) AS n FROM events WHERE value > 60 GROUP BY user_id),
m AS (SELECT t.user_id, string_agg(e, ',' ORDER BY e) AS missing FROM t, (VALUES ('click'), ('error'), ('purchase'), ('signup'), ('view')) v(e)
  WHERE NOT EXISTS (SELECT 1 FROM events x WHERE x.user_id = t.user_id AND x.event_type = e AND x.value > 60) GROUP BY t.user_id) SELECT user_id, missing FROM m""",
)
def incomplete_runs(spark, sf_dir):
    artifacts = table(spark, sf_dir, "events").filter("value > 60").select("user_id", "event_type")
    return R.incomplete_runs(artifacts, "user_id", "event_type", ["click", "error", "purchase", "signup", "view"])


@query(
    "attribution_importance",
    """WITH a AS (SELECT label, 'f' || i AS feature, CAST(embedding[i + 1] AS DOUBLE) AS value FROM embeddings, range(64) t(i))
SELECT label, feature, round(avg(abs(value)), 9) AS mean_abs, round(avg(value), 9) AS mean_signed, count(*) AS n FROM a GROUP BY label, feature""",
)
def attribution_importance(spark, sf_dir):
    long = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "value")).select(
        "label", F.concat(F.lit("f"), F.col("i").cast("string")).alias("feature"), F.col("value").cast("double").alias("value")
    )
    out = M.attribution_importance(long, ["label"])
    return out.withColumns({c: rounded(F.col(c)) for c in ("mean_abs", "mean_signed")})
