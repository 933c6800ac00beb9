"""Cross-validated model jobs over tables: Spark ML estimators, PU formulations, nested selection.

Every job returns an out-of-fold table (fold, id, label, y_true, score), so metrics and thresholds
come from the same operators for all models.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import partial, reduce

from pyspark.ml.classification import (
    DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, NaiveBayes, RandomForestClassifier,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumbre.functions.numeric import reaches, sigmoid
from lumbre.operators.joins import paired_deltas
from lumbre.operators.metrics import confusion, score_metrics, with_confusion_metrics
from lumbre.operators.neighbours import smote
from lumbre.operators.parallel import side_by_side
from lumbre.operators.preparation_models import Preparation, anova_of_moments, apply_pca, class_moments, fit_pca, fit_preparation, nullable_columns, prepared_moments, select_k_best
from lumbre.operators.pu import adjust_scores, label_frequency, oversample, pu_bags, training_subset
from lumbre.operators.splits import stratified_folds
from lumbre.operators.thresholds import grid_threshold_curve, observed_threshold
from lumbre.session import ContractError, durable


@dataclass(frozen=True)
class Candidate:
    """A classifier family with its parameters, by Spark ML names."""

    family: str
    params: tuple[tuple[str, object], ...] = field(default=())
    balanced: bool = False
    #: Steps that are fitted on the train rows only: best features by ANOVA, share of variance for PCA, over-sampling.
    k_best: int | None = None
    pca: float | None = None
    sampler: str | None = None

    def params_json(self) -> str:
        steps = {n: v for n, v in (("k_best", self.k_best), ("pca", self.pca), ("sampler", self.sampler)) if v is not None}
        return json.dumps({**dict(self.params), **steps, "balanced": self.balanced}, sort_keys=True)


_FAMILIES: dict[str, Callable[..., object]] = {
    "logistic_regression": LogisticRegression, "linear_svm": LinearSVC, "random_forest": RandomForestClassifier, "gradient_boosting": GBTClassifier,
    "decision_tree": DecisionTreeClassifier, "gaussian_nb": NaiveBayes, "mlp": MultilayerPerceptronClassifier,
}


def build_estimator(candidate: Candidate, n_features: int, seed: int):
    """Spark ML estimator for a candidate (``dummy`` has none: it scores the train prevalence)."""
    if candidate.family not in _FAMILIES:
        raise ContractError(f"unknown model family {candidate.family}")
    params = {"featuresCol": "__x", "labelCol": "__y", **dict(candidate.params)}
    if candidate.family in ("random_forest", "gradient_boosting", "decision_tree", "mlp"):
        params.setdefault("seed", seed)
    if candidate.family == "gaussian_nb":
        params["modelType"] = "gaussian"
    if candidate.family == "mlp":
        params["layers"] = [n_features, *params.pop("hidden", [16]), 2]
    if candidate.balanced:
        if candidate.family == "mlp":
            raise ContractError("the multilayer perceptron takes no class weights")
        params["weightCol"] = "__w"
    return _FAMILIES[candidate.family](**params)


def _fit_vectors(train: DataFrame, features: list[str], candidate: Candidate, per_class: Callable[[], DataFrame]) -> tuple[Callable[[DataFrame], DataFrame], int]:
    """Feature selection and PCA of prepared train rows: a function that adds the array ``__a``, and its length; ``per_class`` gives their class moments."""
    if candidate.k_best and candidate.k_best < len(features):
        best = select_k_best(anova_of_moments(per_class(), []), [], candidate.k_best)
        chosen = {r["feature"] for r in best.select("feature").collect()}
        features = [f for f in features if f in chosen] or features
    if candidate.pca is None:
        return lambda df: df.withColumn("__a", F.array(*[F.col(f).cast("double") for f in features])), len(features)
    fitted = fit_pca(train.select(*features), features, candidate.pca)
    return lambda df: apply_pca(df, fitted).withColumnRenamed("components", "__a"), fitted[2]


def _resampled(rows: DataFrame, ids: list[str], sampler: str, seed: int) -> DataFrame:
    """Train rows (ids, __a, __t) with as many positives as negatives: copies, or synthetic rows between neighbours."""
    if sampler == "random":
        return oversample(rows, [], ids, "__t", seed).select("__a", "__t")
    if sampler != "smote":
        raise ContractError(f"unknown sampler {sampler}")
    numbered = durable(rows.select(F.lit("all").alias("group_all"), F.col(ids[0]).cast("bigint").alias("row_id"), "__a", "__t"))
    made = smote(numbered, "group_all", "row_id", "__a", "__t", 5, seed)
    return numbered.select("__a", "__t").unionByName(made.select("__a", F.lit(1).alias("__t")))


def fit_score(
    train: DataFrame, test: DataFrame, features: list[str], target: str, ids: list[str], candidate: Candidate, seed: int = 0, min_variance: float = 0.0,
    nullable: list[str] | None = None, prepared: Preparation | None = None,
) -> DataFrame:
    """Fit on train, score test: (ids, score). One class only in train gives that class as constant score.

    ``prepared`` reuses a preparation that was fitted on the same train rows.
    """
    # One look at the train rows for the share, the scales and the choice of features.
    moments = class_moments(train, features if prepared is None or candidate.k_best else [], target)
    share = moments.positive_share()
    if candidate.family == "dummy" or share in (0.0, 1.0):
        return test.select(*ids, F.lit(float(share)).alias("score"))
    prep = prepared or fit_preparation(train, features, features if nullable is None else nullable, "standard", min_variance, moments)
    vectors, width = _fit_vectors(prep.apply(train), prep.kept, candidate, lambda: prepared_moments(train, prep, moments, target))
    rows = vectors(prep.apply(train)).select(*ids, "__a", F.col(target).cast("int").alias("__t"))
    if candidate.sampler:
        rows, share = _resampled(rows, ids, candidate.sampler, seed), 0.5
    weight = F.when(F.col("__t") == 1, 0.5 / share).otherwise(0.5 / (1 - share))
    rows = rows.select(array_to_vector("__a").alias("__x"), F.col("__t").cast("double").alias("__y"), weight.alias("__w"))
    model = build_estimator(candidate, width, seed).fit(rows)
    scored = model.transform(vectors(prep.apply(test)).withColumn("__x", array_to_vector("__a")))
    if "probability" in scored.columns:
        score = vector_to_array("probability")[1]
    else:
        score = sigmoid(vector_to_array("rawPrediction")[1])
    return scored.select(*ids, score.alias("score"))


def with_truth(parts: list[DataFrame], truth: DataFrame, keys: list[str]) -> DataFrame:
    """Scores of all cells beside the rows of ``truth`` with the same keys, by one join.

    One join in each cell would be a union of joins by the same keys: Spark keeps their partitioning, so one task has the sorts of all cells
    at once, and as each cell alone is small, it gets the rows of many.
    """
    return truth.join(reduce(DataFrame.unionByName, parts), keys)


def _bag_scores(train: DataFrame, test: DataFrame, features: list[str], target: str, none_label: str, ids: list[str], candidate: Candidate, formulation: str, seed: int, bags: int, nullable: list[str] | None) -> DataFrame:
    """(ids, score) of a formulation; bagging has a row for each bag, which ``_averaged`` puts together."""
    if formulation != "pu_bagging":
        return fit_score(training_subset(train, target, none_label, formulation), test, features, target, ids, candidate, seed, nullable=nullable)
    bagged = durable(pu_bags(train, [], ids, target, bags, 1.0, seed))

    def one_bag(b: int) -> DataFrame:
        return fit_score(bagged.filter(F.col("bag") == b), test, features, target, ids, candidate, seed + b, nullable=nullable)

    return reduce(DataFrame.unionByName, side_by_side(partial(one_bag, b) for b in range(1, bags + 1)))


def _averaged(scores: DataFrame, keys: list[str], formulation: str) -> DataFrame:
    return scores.groupBy(*keys).agg(F.avg("score").alias("score")) if formulation == "pu_bagging" else scores


def fit_score_formulation(train: DataFrame, test: DataFrame, features: list[str], target: str, none_label: str, ids: list[str], candidate: Candidate, formulation: str, seed: int = 0, bags: int = 15, nullable: list[str] | None = None) -> DataFrame:
    """Supervised, naive and bagging formulations; Elkan-Noto scores are adjusted later, from out-of-fold scores."""
    return _averaged(_bag_scores(train, test, features, target, none_label, ids, candidate, formulation, seed, bags, nullable), ids, formulation)


def _fold_scores(df: DataFrame, folds: list[int], features: list[str], target: str, ids: list[str], candidate: Candidate, seed: int, fold: str, none_label: str, formulation: str, bags: int, nullable: list[str]) -> DataFrame:
    """(fold, ids, score) of one candidate, with a row for each bag."""

    def one_fold(f: int) -> DataFrame:
        train, test = df.filter((F.col(fold) != f) & F.col(fold).isin(*folds)), df.filter(F.col(fold) == f)
        return _bag_scores(train, test, features, target, none_label, ids, candidate, formulation, seed + f, bags, nullable).withColumn(fold, F.lit(f))

    return reduce(DataFrame.unionByName, side_by_side(partial(one_fold, f) for f in folds))


def cross_validated_scores(df: DataFrame, folds: list[int], features: list[str], target: str, ids: list[str], candidate: Candidate, seed: int = 0, fold: str = "fold", none_label: str = "none", formulation: str = "pu_naive", bags: int = 15, nullable: list[str] | None = None) -> DataFrame:
    """Out-of-fold table of one candidate: each fold is scored by a model fitted on the other folds.

    ``nullable`` are the features that may be missing, where the caller knows them.
    """
    nullable = nullable_columns(df, features) if nullable is None else nullable
    scores = _fold_scores(df, folds, features, target, ids, candidate, seed, fold, none_label, formulation, bags, nullable)
    scores = _averaged(scores, [fold, *ids], formulation)
    return with_truth([scores], df.select(*ids, F.col(target).alias("y_true")), ids).select(F.col(fold), *ids, F.lit(target).alias("label"), "y_true", "score")


def multi_label_scores(df: DataFrame, folds: list[int], features: list[str], targets: list[str], ids: list[str], candidate: Candidate, strategy: str = "independent", seed: int = 0) -> DataFrame:
    """One model per label, or a chain in which a label's model also sees the labels before it.

    In a chain, train rows use the true earlier labels and test rows the predicted ones.
    """
    nullable = nullable_columns(df, features)

    def one_fold(f: int) -> list[DataFrame]:
        parts = []
        train, test = df.filter(F.col("fold") != f), df.filter(F.col("fold") == f)
        if strategy == "independent":
            prepared = fit_preparation(train, features, nullable)
            for t in targets:
                scored = fit_score(train, test, features, t, ids, candidate, seed + f, prepared=prepared)
                parts.append(scored.select(F.lit(f).alias("fold"), *ids, F.lit(t).alias("label"), "score"))
            return parts
        earlier: list[str] = []
        for t in targets:
            inputs = [*features, *[f"__chain_{e}" for e in earlier]]
            chained = train.withColumns({f"__chain_{e}": F.col(e).cast("double") for e in earlier}) if earlier else train
            scored = durable(fit_score(chained, test, inputs, t, ids, candidate, seed + f, nullable=nullable))
            parts.append(scored.select(F.lit(f).alias("fold"), *ids, F.lit(t).alias("label"), "score"))
            test = test.join(scored.select(*ids, (F.col("score") >= 0.5).cast("double").alias(f"__chain_{t}")), ids)
            earlier.append(t)
        return parts

    parts = [p for parts in side_by_side(partial(one_fold, f) for f in folds) for p in parts]
    keys = ["fold", *ids] if strategy == "independent" else ids
    joined = with_truth(parts, df.select(*keys, *[F.col(t).alias(f"__y_{t}") for t in targets]), keys)
    y_true = F.coalesce(*[F.when(F.col("label") == t, F.col(f"__y_{t}")) for t in targets])
    return joined.select(F.col("fold").cast("int").alias("fold"), *ids, "label", y_true.alias("y_true"), "score")


def nested_selection(df: DataFrame, folds: list[int], features: list[str], target: str, ids: list[str], candidates: list[Candidate], formulation: str = "pu_naive", seed: int = 0, bags: int = 15) -> DataFrame:
    """Inner results of every (outer fold, candidate), ranked by AP, G-mean, MCC, then candidate order.

    ``folds`` are the outer folds; the inner ones are all others of the table, so a candidate is chosen on the rows that its refit will see.
    """
    nullable, keys = nullable_columns(df, features), ["outer_fold", "candidate"]
    # One row for each fold, a setting.
    every = sorted(r["fold"] for r in df.filter("fold is not null").select("fold").distinct().collect())

    def one_cell(outer: int, i: int) -> DataFrame:
        inner = [f for f in every if f != outer]
        scores = _fold_scores(df, inner, features, target, ids, candidates[i], seed + 100 * outer, "fold", "none", formulation, bags, nullable)
        return scores.withColumns({"outer_fold": F.lit(outer), "candidate": F.lit(i)})

    cells = reduce(DataFrame.unionByName, side_by_side(partial(one_cell, outer, i) for outer in folds for i in range(len(candidates))))
    scores = _averaged(cells, [*keys, "fold", *ids], formulation)
    joined = with_truth([scores], df.select(*ids, F.col(target).alias("y_true")), ids)
    inner_oof = durable(joined.select(*keys, *ids, F.lit(target).alias("label"), "y_true", "score"))
    c = label_frequency(inner_oof, keys).select(*keys, "c")
    adjusted = inner_oof.join(c, keys).withColumn("c", F.when(F.lit(formulation == "pu_elkan_noto"), F.col("c")).otherwise(F.lit(1.0)))
    adjusted = durable(adjusted.withColumn("score", F.when(F.lit(formulation == "pu_elkan_noto"), adjust_scores(F.col("score"), F.col("c"))).otherwise(F.col("score"))))
    merged = score_metrics(adjusted, keys).select(*keys, "average_precision").join(observed_threshold(adjusted, keys), keys).join(
        adjusted.groupBy(*keys).agg(F.first("c").alias("c")), keys
    )
    from pyspark.sql import Window as W

    order = [F.coalesce("average_precision", F.lit(-1.0)).desc(), F.desc("gmean"), F.desc("mcc"), F.col("candidate")]
    # A handful of candidates per outer fold.
    return merged.withColumn("rank", F.row_number().over(W.partitionBy("outer_fold").orderBy(*order)))


def nested_cross_validation(df: DataFrame, folds: list[int], features: list[str], target: str, ids: list[str], candidates: list[Candidate], formulation: str = "pu_naive", seed: int = 0, bags: int = 15) -> DataFrame:
    """Outer out-of-fold table: per outer fold the best inner candidate is refitted and its threshold applied."""
    best = nested_selection(df, folds, features, target, ids, candidates, formulation, seed, bags).filter("rank = 1").collect()
    nullable = nullable_columns(df, features)

    def one_fold(row) -> DataFrame:
        outer, chosen = row["outer_fold"], candidates[row["candidate"]]
        train, test = df.filter(F.col("fold") != outer), df.filter(F.col("fold") == outer)
        raw = _bag_scores(train, test, features, target, "none", ids, chosen, formulation, seed + outer, bags, nullable)
        score = adjust_scores(F.col("score"), F.lit(row["c"])) if formulation == "pu_elkan_noto" else F.col("score")
        return raw.select(
            F.lit(outer).alias("fold"), *ids, score.alias("score"), F.lit(row["threshold"]).alias("threshold"),
            F.lit(row["candidate"]).alias("candidate"), F.lit(chosen.family).alias("family"), F.lit(chosen.params_json()).alias("params_json"),
        )

    keys, rest = ["fold", *ids], ["threshold", "candidate", "family", "params_json"]
    scores = _averaged(reduce(DataFrame.unionByName, side_by_side(partial(one_fold, row) for row in best)), [*keys, *rest], formulation)
    joined = with_truth([scores], df.select(*keys, F.col(target).alias("y_true")), keys)
    oof = joined.select(F.col("fold").cast("int").alias("fold"), *ids, F.lit(target).alias("label"), "y_true", "score", *rest)
    return oof.withColumn("pred", reaches(F.col("score"), F.col("threshold")).cast("int"))


def specialised_and_general(df: DataFrame, folds: list[int], features: list[str], target: str, ids: list[str], member: str, candidate: Candidate, seed: int = 0, thresholds: bool = False) -> DataFrame:
    """A model fitted on subgroup train rows next to one fitted on all train rows, scored on the same subgroup test rows.

    With ``thresholds`` each arm's threshold comes from inner folds of its own train rows, and ``pred`` from it.
    """
    nullable = nullable_columns(df, features)

    def one_cell(f: int, arm: str) -> DataFrame:
        train, test = df.filter(F.col("fold") != f), df.filter((F.col("fold") == f) & (F.col(member) == 1))
        rows = train if arm == "general" else train.filter(F.col(member) == 1)
        scored = fit_score(rows, test, features, target, ids, candidate, seed + f, nullable=nullable)
        out = scored.select(F.lit(arm).alias("arm"), F.lit(f).alias("fold"), *ids, "score")
        if thresholds:
            chosen, _ = inner_threshold(rows, features, target, ids, candidate, seed + f, nullable)
            out = out.withColumns({"threshold": F.lit(chosen), "pred": reaches(F.col("score"), F.lit(chosen)).cast("int")})
        return out

    parts, keys = side_by_side(partial(one_cell, f, arm) for f in folds for arm in ("general", "specialised")), ["fold", *ids]
    joined = with_truth(parts, df.filter(F.col(member) == 1).select(*keys, F.col(target).alias("y_true")), keys)
    rest = ["threshold", "pred"] if thresholds else []
    return joined.select("arm", F.col("fold").cast("int").alias("fold"), *ids, F.lit(target).alias("label"), "y_true", "score", *rest)


def arm_deltas(oof: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Metrics of both arms on identical rows, side by side with specialised - general."""
    counts = with_confusion_metrics(confusion(oof, [*keys, "arm"]), 0.0)
    return paired_deltas(counts, keys, "arm", "general", "specialised", metrics)


def inner_threshold(train: DataFrame, features: list[str], target: str, ids: list[str], candidate: Candidate, seed: int = 0, nullable: list[str] | None = None) -> tuple[float, int]:
    """Grid threshold from inner out-of-fold scores with ``min(4, minority)`` folds; 0.5 when the minority has fewer than two rows."""
    counts = train.agg(F.count_if(F.col(target) == 1).alias("p"), F.count_if(F.col(target) == 0).alias("n")).first()
    k = min(4, counts["p"], counts["n"])
    if k < 2:
        return 0.5, 0
    folded = durable(stratified_folds(train, ids, [target], k, seed, out="__inner"))
    oof = cross_validated_scores(folded, list(range(1, k + 1)), features, target, ids, candidate, seed, fold="__inner", nullable=nullable)
    chosen = grid_threshold_curve(oof, ["label"]).filter("selected = 1").first()
    return float(chosen["threshold"]), k


# ---- closed-form models: all folds and labels in one job ----------------------------------------------


def prior_scores(labelled: DataFrame, ids: list[str]) -> DataFrame:
    """Dummy model: every row of a fold gets the prevalence of the other folds. Input: fold, ids, label, y_true."""
    per = labelled.groupBy("label", "fold").agg(F.sum(F.col("y_true").cast("bigint")).alias("p"), F.count(F.lit(1)).alias("n"))
    all_ = per.groupBy("label").agg(F.sum("p").alias("all_p"), F.sum("n").alias("all_n"))
    priors = per.join(all_, "label").select("label", "fold", ((F.col("all_p") - F.col("p")) / (F.col("all_n") - F.col("n"))).alias("score"))
    return labelled.join(priors, ["label", "fold"]).select("fold", *ids, "label", "y_true", "score")


def gaussian_nb_scores(df: DataFrame, ids: list[str], features: list[str], labels: list[str], smoothing: float = 1e-9) -> DataFrame:
    """Gaussian naive Bayes, cross-validated over ``fold`` for all labels at once.

    Class moments of "all other folds" are total moments minus those of the fold, so the rows are read
    once for the fit whatever the number of folds, and scored where they are: only the moments, one
    array per (label, fold), are joined to them. Input features must not be missing.
    """
    centres = df.agg(*[F.avg(F.col(f).cast("double")).alias(f) for f in features]).first()
    values = F.array(*[F.col(f).cast("double") - centres[f] for f in features])
    entries = F.array(*[F.struct(F.lit(lab).alias("label"), F.col(lab).cast("int").alias("y")) for lab in labels])
    rows = df.select(*ids, "fold", values.alias("x"), F.explode(entries).alias("e")).select(*ids, "fold", "x", "e.label", F.col("e.y").alias("y_true"))
    part = rows.select("fold", "label", F.col("y_true").alias("y"), F.posexplode("x").alias("i", "v")).groupBy("i", "label", "y", "fold").agg(
        F.count("v").alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q")
    )
    part = durable(part)
    total = part.groupBy("i", "label", "y").agg(F.sum("n").alias("all_n"), F.sum("s").alias("all_s"), F.sum("q").alias("all_q"))
    # Every (fold, label) gets a row for both classes, also where the fold itself has none of a class.
    cells = part.select("i", "label", "fold").distinct()
    rest = total.join(cells, ["i", "label"]).join(part, ["i", "label", "y", "fold"], "left").select(
        "i", "label", "y", "fold", (F.col("all_n") - F.coalesce("n", F.lit(0))).alias("n"), (F.col("all_s") - F.coalesce("s", F.lit(0.0))).alias("s"),
        (F.col("all_q") - F.coalesce("q", F.lit(0.0))).alias("q"),
    )
    pooled = rest.groupBy("i", "label", "fold").agg(F.sum("n").alias("an"), F.sum("s").alias("as"), F.sum("q").alias("aq"))
    spread = pooled.withColumn("av", F.col("aq") / F.col("an") - F.pow(F.col("as") / F.col("an"), 2)).groupBy("label", "fold").agg(F.max("av").alias("widest"))
    mean = F.col("s") / F.col("n")
    moments = rest.join(spread, ["label", "fold"]).select(
        "i", "label", "y", "fold", "n", mean.alias("mu"), (F.col("q") / F.col("n") - mean * mean + smoothing * F.col("widest")).alias("var")
    )
    wide = moments.groupBy("i", "label", "fold").agg(*[F.max(F.when(F.col("y") == y, F.col(c))).alias(f"{c}{y}") for y in (0, 1) for c in ("mu", "var", "n")])
    # One row per (label, fold), with one entry per feature.
    packed = wide.groupBy("label", "fold").agg(
        F.array_sort(F.collect_list(F.struct("i", "mu0", "var0", "mu1", "var1"))).alias("m"), F.max("n1").alias("n1"), F.max("n0").alias("n0")
    )

    def gain(x, m):
        one = -0.5 * F.log(2 * F.pi() * m["var1"]) - F.pow(x - m["mu1"], 2) / (2 * m["var1"])
        zero = -0.5 * F.log(2 * F.pi() * m["var0"]) - F.pow(x - m["mu0"], 2) / (2 * m["var0"])
        return one - zero

    joined = rows.join(F.broadcast(packed), ["label", "fold"])
    log_odds = F.aggregate(F.zip_with("x", "m", gain), F.lit(0.0), lambda a, b: a + b) + F.log(F.col("n1") / F.col("n0"))
    return joined.select("fold", *ids, "label", "y_true", (1 / (1 + F.exp(-log_odds))).alias("score"))
