"""Feature preparation and cross-validated models over the order cohort and the embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumbre.functions.numeric import rounded
from lumbre.operators import metrics as M
from lumbre.operators import models as L
from lumbre.operators import preparation_models as R
from lumbre.operators.association import melt
from lumbre.operators.pu import adjust_scores, conceal_positives, label_frequency
from lumbre.plans.base import COHORT_SQL, FLAGS, LABELS, NUMERIC, cohort
from lumbre.plans.eda_queries import _FEATURES, embedding_columns
from lumbre.plans.metric_queries import auc_sql
from lumbre.plans.registry import query
from lumbre.plans.split_queries import _folds, folds_sql
from lumbre.session import durable

_FOLDED_SQL = f"{COHORT_SQL}, {folds_sql()}, fc AS (SELECT c.*, f.fold FROM cohort c JOIN folds f ON c.id = f.id)"


def _folded(spark, sf_dir):
    rows = durable(cohort(spark, sf_dir))
    return rows.join(_folds(spark, sf_dir, rows=rows).select("id", "fold"), "id")


@query(
    "train_only_median_imputation",
    f"""WITH {_FOLDED_SQL}, k AS (SELECT CAST(unnest(range(1, 6)) AS INT) AS k), m AS (SELECT k, median(qty) AS med FROM fc, k WHERE fold <> k GROUP BY k)
SELECT k.k AS fold, round(med, 6) AS median, count(*) AS n_test, count(*) - count(qty) AS n_filled, round(avg(coalesce(qty, med)), 6) AS mean_test FROM fc JOIN k ON fc.fold = k.k JOIN m ON m.k = k.k GROUP BY k.k, med""",
)
def train_only_median_imputation(spark, sf_dir):
    rows = _folded(spark, sf_dir).select("id", "fold", "qty")
    train = rows.select("qty", F.explode(F.filter(F.sequence(F.lit(1), F.lit(5)), lambda k: k != F.col("fold"))).alias("fold"))
    medians = R.fit_medians(train, ["fold"], ["qty"])
    test = melt(rows, ["fold"], ["qty"])
    filled = R.impute_long(test.withColumn("missing", F.col("value").isNull().cast("int")), medians, ["fold"])
    out = filled.groupBy("fold").agg(F.count(F.lit(1)).alias("n_test"), F.sum(F.col("missing").cast("bigint")).alias("n_filled"), rounded(F.avg("value"), 6).alias("mean_test"))
    return out.join(medians.select("fold", rounded(F.col("median"), 6).alias("median")), "fold")


_EMB_LONG_SQL = "emb AS (SELECT vec_id, label, 'f' || i AS feature, CAST(embedding[i + 1] AS DOUBLE) AS v FROM embeddings, range(64) t(i))"


@query(
    "variance_threshold",
    f"WITH {_EMB_LONG_SQL} SELECT feature, round(var_pop(v), 9) AS variance FROM emb GROUP BY feature HAVING var_pop(v) > 0.0155",
)
def variance_threshold(spark, sf_dir):
    long = melt(embedding_columns(spark, sf_dir), [], _FEATURES)
    fitted = R.fit_scaler(long, [])
    kept = R.keep_varying(fitted, fitted, [], 0.0155)
    return kept.select("feature", rounded(F.col("variance")).alias("variance"))


@query(
    "scaled_features",
    f"""WITH {_EMB_LONG_SQL}, s AS (SELECT feature, avg(v) AS mu, stddev_pop(v) AS sd, min(v) AS lo, max(v) AS hi FROM emb WHERE vec_id % 5 <> 0 GROUP BY feature)
SELECT emb.feature, round(avg((v - mu) / sd), 8) AS standard, round(avg((v - lo) / (hi - lo)), 8) AS min_max FROM emb JOIN s ON emb.feature = s.feature WHERE vec_id % 5 = 0 GROUP BY emb.feature""",
)
def scaled_features(spark, sf_dir):
    # A train / test split by design: the scales come from the train rows, the means from the test rows.
    long = melt(embedding_columns(spark, sf_dir), ["vec_id"], _FEATURES)
    fitted = R.fit_scaler(long.filter("vec_id % 5 <> 0"), [])
    test = long.filter("vec_id % 5 = 0")
    a = R.scale_long(test, fitted, []).groupBy("feature").agg(rounded(F.avg("value"), 8).alias("standard"))
    b = R.scale_long(test, fitted, [], "min_max").groupBy("feature").agg(rounded(F.avg("value"), 8).alias("min_max"))
    return a.join(b, "feature")


_ANOVA_SQL = f"""{_EMB_LONG_SQL}, m AS (SELECT feature, avg(v) AS g, count(*) AS n FROM emb GROUP BY feature),
c AS (SELECT feature, label, avg(v) AS mu, count(*) AS n FROM emb GROUP BY feature, label),
b AS (SELECT c.feature, sum(c.n * (mu - g) ** 2) AS ssb, count(*) AS k, any_value(m.n) AS n FROM c JOIN m ON c.feature = m.feature GROUP BY c.feature),
w AS (SELECT emb.feature, sum((v - mu) ** 2) AS ssw FROM emb JOIN c ON emb.feature = c.feature AND emb.label = c.label GROUP BY emb.feature),
f AS (SELECT b.feature, (ssb / (k - 1)) / (ssw / (n - k)) AS f_value FROM b JOIN w ON b.feature = w.feature)"""


@query("anova_f_values", f"WITH {_ANOVA_SQL} SELECT feature, round(f_value, 6) AS f_value FROM f")
def anova_f_values(spark, sf_dir):
    long = melt(embedding_columns(spark, sf_dir), ["label"], _FEATURES)
    return R.anova_f(long, [], "label").withColumn("f_value", rounded(F.col("f_value"), 6))


@query(
    "select_k_best",
    f"WITH {_ANOVA_SQL} SELECT feature, round(f_value, 6) AS f_value, CAST(row_number() OVER (ORDER BY f.f_value DESC, feature) AS INT) AS rank FROM f QUALIFY row_number() OVER (ORDER BY f.f_value DESC, feature) <= 20",
)
def select_k_best(spark, sf_dir):
    long = melt(embedding_columns(spark, sf_dir), ["label"], _FEATURES).withColumn("set", F.lit("embedding"))
    best = R.select_k_best(R.anova_f(long, ["set"], "label"), ["set"], 20)
    return best.select("feature", rounded(F.col("f_value"), 6).alias("f_value"), "rank")


@query(
    "clinical_z_scores",
    f"""WITH {_FOLDED_SQL}, m AS (SELECT avg(amount) AS mu, stddev_pop(amount) AS sd FROM fc WHERE fold > 2)
SELECT fold, count(*) AS n, round(avg((amount - mu) / sd), 8) AS mean_z, round(stddev_pop((amount - mu) / sd), 8) AS sd_z FROM fc, m GROUP BY fold""",
)
def clinical_z_scores(spark, sf_dir):
    long = melt(_folded(spark, sf_dir), ["fold"], ["amount"])
    fitted = R.fit_scaler(long.filter("fold > 2"), [])
    z = R.scale_long(long, fitted, [])
    return z.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), rounded(F.avg("value"), 8).alias("mean_z"), rounded(F.stddev_pop("value"), 8).alias("sd_z"))


@query(
    "prior_model_scores",
    f"""WITH {_FOLDED_SQL}, l AS (SELECT fold, id, 'returned' AS label, returned AS y FROM fc UNION ALL SELECT fold, id, 'open_line', open_line FROM fc), k AS (SELECT CAST(unnest(range(1, 6)) AS INT) AS k),
p AS (SELECT k, label, avg(y) AS score FROM l, k WHERE fold <> k GROUP BY k, label)
SELECT l.fold, l.label, CAST(sum(y) AS BIGINT) AS positives, count(*) AS n, round(max(score), 9) AS score FROM l JOIN p ON l.fold = p.k AND l.label = p.label GROUP BY l.fold, l.label""",
)
def prior_model_scores(spark, sf_dir):
    long = _folded(spark, sf_dir).select("id", "fold", *LABELS).unpivot(["id", "fold"], LABELS, "label", "y_true")
    out = L.prior_scores(long, ["id"])
    return out.groupBy("fold", "label").agg(F.sum(F.col("y_true").cast("bigint")).alias("positives"), F.count(F.lit(1)).alias("n"), rounded(F.max("score")).alias("score"))


_NB_FEATURES = [*FLAGS, "amount"]
_NB_SQL = f"""{_FOLDED_SQL}, k AS (SELECT CAST(unnest(range(1, 6)) AS INT) AS k),
ml AS ({" UNION ALL ".join(f"SELECT id, fold, '{f}' AS feature, CAST({f} AS DOUBLE) AS v FROM fc" for f in _NB_FEATURES)}),
ll AS (SELECT id, fold, 'returned' AS label, returned AS y FROM fc UNION ALL SELECT id, fold, 'open_line', open_line FROM fc),
va AS (SELECT k, max(v) AS widest FROM (SELECT k, feature, var_pop(v) AS v FROM ml, k WHERE fold <> k GROUP BY k, feature) GROUP BY k),
mo AS (SELECT k.k, feature, label, y, avg(v) AS mu, var_pop(v) + 1e-9 * max(widest) AS var, count(*) AS n FROM ml JOIN ll ON ml.id = ll.id JOIN k ON ml.fold <> k.k JOIN va ON va.k = k.k GROUP BY k.k, feature, label, y),
d AS (SELECT ml.id, ml.fold, ll.label, ll.y AS y_true, sum(CASE WHEN mo.y = 1 THEN 1 ELSE -1 END * (-0.5 * ln(2 * pi() * var) - (v - mu) ** 2 / (2 * var))) AS d,
  max(CASE WHEN mo.y = 1 THEN n END) AS n1, max(CASE WHEN mo.y = 0 THEN n END) AS n0
  FROM ml JOIN ll ON ml.id = ll.id JOIN mo ON mo.k = ml.fold AND mo.feature = ml.feature AND mo.label = ll.label GROUP BY ml.id, ml.fold, ll.label, ll.y),
nb AS (SELECT id, fold, label, y_true, 1 / (1 + exp(-(d + ln(n1 / CAST(n0 AS DOUBLE))))) AS score FROM d)"""


def _nb(spark, sf_dir):
    return L.gaussian_nb_scores(durable(_folded(spark, sf_dir)), ["id"], _NB_FEATURES, LABELS)


@query("gaussian_nb_oof", f"WITH {_NB_SQL} SELECT id, fold, label, y_true, round(score, 6) AS score FROM nb")
def gaussian_nb_oof(spark, sf_dir):
    return _nb(spark, sf_dir).select("id", "fold", "label", "y_true", rounded(F.col("score"), 6).alias("score"))


@query(
    "gaussian_nb_fold_metrics",
    f"""WITH {_NB_SQL}, nr AS (SELECT id, fold, label, y_true, round(score, 6) AS score FROM nb), a AS ({auc_sql('fold, label', 'nr')})
SELECT fold, label, round(roc_auc, 6) AS roc_auc, round(average_precision, 6) AS average_precision FROM a""",
)
def gaussian_nb_fold_metrics(spark, sf_dir):
    scores = durable(_nb(spark, sf_dir).withColumn("score", F.round("score", 6)))
    out = M.score_metrics(scores, ["fold", "label"])
    return out.select("fold", "label", rounded(F.col("roc_auc"), 6).alias("roc_auc"), rounded(F.col("average_precision"), 6).alias("average_precision"))


# ---- Spark ML estimators: iterative, so without an SQL twin ---------------------------------------------

_MODEL_FEATURES = [*FLAGS, *NUMERIC]
_LOGISTIC = L.Candidate("logistic_regression", (("regParam", 0.01), ("maxIter", 50)), True)
_TREE = L.Candidate("decision_tree", (("maxDepth", 4),))


def _model_rows(spark, sf_dir):
    rows = _folded(spark, sf_dir).withColumn("none", (F.col("returned") + F.col("open_line") == 0).cast("int"))
    return durable(rows)


@query(
    "single_class_scores",
    f"""WITH {_FOLDED_SQL} SELECT arm, fold, count(*) AS n, arm::DOUBLE AS low, arm::DOUBLE AS high FROM fc, (VALUES (0), (1)) a(arm) GROUP BY ALL""",
)
def single_class_scores(spark, sf_dir):
    """Train rows of one class only give that class as the score of every test row."""
    rows, out = _model_rows(spark, sf_dir), None
    for arm in (0, 1):
        for fold in range(1, 6):
            train, test = rows.filter((F.col("fold") != fold) & (F.col("returned") == arm)), rows.filter(F.col("fold") == fold)
            one = L.fit_score(train, test, _MODEL_FEATURES, "returned", ["id"], _TREE).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("low"), F.max("score").alias("high"))
            one = one.select(F.lit(arm).alias("arm"), F.lit(fold).alias("fold"), "n", "low", "high")
            out = one if out is None else out.unionByName(one)
    return out


@query("logistic_oof_metrics")
def logistic_oof_metrics(spark, sf_dir):
    scores = L.multi_label_scores(_model_rows(spark, sf_dir), [1, 2, 3, 4, 5], _MODEL_FEATURES, LABELS, ["id"], _LOGISTIC)
    return M.score_metrics(durable(scores), ["fold", "label"])


@query("chain_oof_metrics")
def chain_oof_metrics(spark, sf_dir):
    scores = L.multi_label_scores(_model_rows(spark, sf_dir), [1, 2, 3, 4, 5], _MODEL_FEATURES, LABELS, ["id"], _TREE, "chain")
    return M.score_metrics(durable(scores), ["label"])


@query("nested_candidate_selection")
def nested_candidate_selection(spark, sf_dir):
    rows = _model_rows(spark, sf_dir)
    out = L.nested_selection(rows, [1, 2, 3, 4, 5], _MODEL_FEATURES, "returned", ["id"], [_LOGISTIC, _TREE], "pu_elkan_noto")
    return out


@query("pu_formulations_under_concealment")
def pu_formulations_under_concealment(spark, sf_dir):
    """Positives hidden in the train folds, truth kept for the test: naive, clean-negative, bagging and Elkan-Noto scores.

    Clean negatives are the rows without any observed label: what is hidden is not known to the training.
    """
    rows = _model_rows(spark, sf_dir)
    hidden = durable(conceal_positives(rows, ["fold"], ["id"], "returned", 0.3, 5))
    observed = hidden.withColumns({"truth": F.col("y_true"), "returned": F.col("y_observed")}).drop("y_true", "y_observed")
    observed = durable(observed.withColumn("none", (F.col("returned") + F.col("open_line") == 0).cast("int")))
    parts, nullable = [], R.nullable_columns(observed, _MODEL_FEATURES)
    for formulation in ("supervised_clean_negatives", "pu_naive", "pu_bagging"):
        scores = L.cross_validated_scores(observed, [1, 2, 3, 4, 5], _MODEL_FEATURES, "returned", ["id"], _TREE, 3, formulation=formulation, bags=3, nullable=nullable)
        # Written one by one: a union of joins by the same key would have all their sorts in one task.
        scores = durable(scores)
        if formulation == "pu_naive":
            # c comes from the observed labels of the out-of-fold rows.
            c = label_frequency(scores, ["label"]).select("label", "c")
            adjusted = scores.join(c, "label").withColumn("score", adjust_scores(F.col("score"), F.col("c"))).drop("c")
            parts.append(adjusted.drop("y_true").withColumn("formulation", F.lit("pu_elkan_noto")))
        parts.append(scores.drop("y_true").withColumn("formulation", F.lit(formulation)))
    out = L.with_truth(parts, observed.select("id", F.col("truth").alias("y_true")), ["id"])
    return M.score_metrics(durable(out), ["formulation"])


@query("subgroup_model_comparison")
def subgroup_model_comparison(spark, sf_dir):
    rows = _model_rows(spark, sf_dir)
    scores = L.specialised_and_general(rows, [1, 2, 3, 4, 5], _MODEL_FEATURES, "returned", ["id"], "discounted", _TREE)
    return M.score_metrics(durable(scores), ["arm"])


@query("subgroup_model_deltas")
def subgroup_model_deltas(spark, sf_dir):
    """Five best features, inner thresholds, and paired deltas of the two arms per fold."""
    rows = _model_rows(spark, sf_dir)
    best_five = L.Candidate("decision_tree", (("maxDepth", 4),), k_best=5)
    scores = durable(L.specialised_and_general(rows, [1, 2, 3, 4, 5], _MODEL_FEATURES, "returned", ["id"], "discounted", best_five, thresholds=True))
    return L.arm_deltas(scores, ["fold", "label"], ["f1", "precision", "recall"])


@query("resampled_model_metrics")
def resampled_model_metrics(spark, sf_dir):
    """Over-sampling, best features and components, each fitted inside the train folds."""
    rows = _model_rows(spark, sf_dir)
    arms = {
        "plain": L.Candidate("decision_tree", (("maxDepth", 4),)), "copies": L.Candidate("decision_tree", (("maxDepth", 4),), sampler="random"),
        "best_and_components": L.Candidate("decision_tree", (("maxDepth", 4),), k_best=5, pca=0.95, sampler="random"),
    }
    out = None
    for name, candidate in arms.items():
        # Written one by one: a union of joins by the same key would have all their sorts in one task.
        one = durable(L.cross_validated_scores(rows, [1, 2, 3], _MODEL_FEATURES, "returned", ["id"], candidate, 3)).withColumn("arm", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return M.score_metrics(out, ["arm", "fold"])


@query("pca_explained_variance")
def pca_explained_variance(spark, sf_dir):
    rows = embedding_columns(spark, sf_dir)
    prepared = R.fit_preparation(rows, _FEATURES, R.nullable_columns(rows, _FEATURES))
    scaled = prepared.apply(rows)
    _, _, count, explained = R.fit_pca(scaled.select(*prepared.kept), prepared.kept, 0.90)
    return scaled.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows", F.posexplode(F.array(*[F.lit(v) for v in explained])).alias("component", "explained"), F.lit(count).alias("n_kept")
    )
