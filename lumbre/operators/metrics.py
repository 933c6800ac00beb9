"""Metrics of out-of-fold tables: confusion counts, score metrics, multi-label averages.

Input is long: group keys, ``id``, ``label``, ``y_true`` (0/1), ``pred`` (0/1), ``score``.
Runs, folds and labels are grouping keys, so one job evaluates every experiment.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumbre.functions.numeric import clip, confusion_metrics, ratio
from lumbre.operators.ordered import SMALL_KEY, bounds_if_large, running_totals
from lumbre.session import durable


def confusion(oof: DataFrame, keys: list[str]) -> DataFrame:
    """True and false positives and negatives per key."""
    y, p = F.col("y_true") == 1, F.col("pred") == 1
    return oof.groupBy(*keys).agg(
        F.count_if(y & p).alias("tp"),
        F.count_if(~y & p).alias("fp"),
        F.count_if(y & ~p).alias("fn"),
        F.count_if(~y & ~p).alias("tn"),
    )


def with_confusion_metrics(counts: DataFrame, empty: float | None = 0.0, names: list[str] | None = None) -> DataFrame:
    """Add the binary metrics; ``empty`` is the family's value for an empty denominator."""
    metrics = confusion_metrics(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn"), empty)
    return counts.select(
        "*",
        (F.col("tp") + F.col("fn")).alias("support"),
        (F.col("tp") + F.col("fp")).alias("predicted_positive"),
        *[c.alias(n) for n, c in metrics.items() if names is None or n in names],
    )


def _brier() -> F.Column:
    return F.avg(F.pow(clip(F.col("score"), 0, 1) - F.col("y_true"), 2)).alias("brier_score")


def brier(oof: DataFrame, keys: list[str]) -> DataFrame:
    """Brier score on scores clipped to [0, 1]."""
    return oof.groupBy(*keys).agg(_brier())


def _score_counts(oof: DataFrame, keys: list[str]) -> DataFrame:
    usable = F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") != float("inf"))
    top = F.col("score") == float("inf")
    return oof.groupBy(*keys, F.when(usable, F.col("score")).alias("score")).agg(
        F.sum(F.col("y_true").cast("bigint")).alias("pos"), F.sum((1 - F.col("y_true")).cast("bigint")).alias("neg"),
        F.count_if(top & (F.col("y_true") == 1)).alias("inf_pos"), F.count_if(top & (F.col("y_true") == 0)).alias("inf_neg"),
    )


def score_table(oof: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key and distinct score with positive and negative counts (map-side combined).

    Rows whose score is missing or not finite are counted under a null score, those with a score of plus infinity
    among them in columns of their own. The table is written once, since ranking it needs several looks and its input may be expensive.
    """
    return durable(_score_counts(oof, keys))


def score_metrics(oof: DataFrame, keys: list[str], most: int | None = None) -> DataFrame:
    """ROC AUC (ties averaged) and average precision (steps over distinct scores) per key.

    Null with one class only, or when any score of the key is missing or not finite.
    ``most`` is a number of rows that no key exceeds, if the caller knows one: keys that are small for one window are ranked in
    the pass that reads the rows, which are shuffled once and not written.
    """
    known = F.col("score").isNotNull()
    if most is not None and most <= SMALL_KEY:
        # Rows without a usable score come first and count nothing.
        table = _score_counts(oof.repartition(*keys), keys)
        sums = _rank_sums(running_totals(table.withColumns({c: F.when(known, F.col(c)) for c in ("pos", "neg")}), keys, "score", ["pos", "neg"], []), keys)
    else:
        table = score_table(oof, keys)
        ranked = table.filter(known)
        cum = running_totals(ranked, keys, "score", ["pos", "neg"], bounds_if_large(ranked, "score", keys))
        unusable = table.groupBy(*keys).agg(F.count_if(~known).alias("__bad"))
        sums = unusable.join(_rank_sums(cum, keys).drop("__bad"), keys, "left")
    both = (F.col("__bad") == 0) & (F.col("n_positive") > 0) & (F.col("n_negative") > 0)
    p, n = F.col("n_positive").cast("double"), F.col("n_negative").cast("double")
    return sums.select(
        *keys,
        F.when(both, F.col("__u") / F.nullif(p * n, F.lit(0.0))).alias("roc_auc"),
        F.when(both, F.col("__ap") / F.nullif(p, F.lit(0.0))).alias("average_precision"),
        F.coalesce("n_positive", F.lit(0)).alias("n_positive"),
        F.coalesce("n_negative", F.lit(0)).alias("n_negative"),
    )


def _rank_sums(cum: DataFrame, keys: list[str]) -> DataFrame:
    """Sums behind both metrics per key, from running totals over its scores."""
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    all_pos, all_neg = F.col("total_pos").cast("double"), F.col("total_neg").cast("double")
    at_least_pos = all_pos - F.col("cum_pos") + pos
    at_least = at_least_pos + all_neg - F.col("cum_neg") + neg
    return cum.groupBy(*keys).agg(
        F.sum(pos * (F.col("cum_neg") - neg / 2)).alias("__u"),
        F.sum(pos * at_least_pos / at_least).alias("__ap"),
        F.max("total_pos").alias("n_positive"),
        F.max("total_neg").alias("n_negative"),
        F.count_if(F.col("score").isNull()).alias("__bad"),
    )


def label_report(oof: DataFrame, keys: list[str], empty: float | None = None) -> DataFrame:
    """Per-label report: confusion metrics, AUC, AP and Brier score, one row per key."""
    y, p = F.col("y_true") == 1, F.col("pred") == 1
    counts = oof.groupBy(*keys).agg(
        F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"), _brier()
    )
    scores = score_metrics(oof, keys).select(*keys, "roc_auc", "average_precision")
    return with_confusion_metrics(counts, empty).join(scores, keys, "left")


def averaged_metrics(oof: DataFrame, keys: list[str]) -> DataFrame:
    """Micro, macro and support-weighted F1, precision, recall and Jaccard per key, from label counts."""
    names = ["f1", "precision", "recall", "jaccard"]
    per_label = with_confusion_metrics(confusion(oof, [*keys, "label"]), 0.0, names)
    aggs = [F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")]
    for n in names:
        aggs.append(F.avg(n).alias(f"{n}_macro"))
        aggs.append(ratio(F.sum(F.col(n) * F.col("support")), F.sum("support").cast("double"), 0.0).alias(f"{n}_weighted"))
    pooled = per_label.groupBy(*keys).agg(*aggs)
    micro = confusion_metrics(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn"), 0.0)
    return pooled.select(
        *keys, *[micro[n].alias(f"{n}_micro") for n in names], *[f"{n}_macro" for n in names], *[f"{n}_weighted" for n in names]
    )


def row_metrics(oof: DataFrame, keys: list[str], id_col: str = "id") -> DataFrame:
    """Metrics that need the whole label set of a row: samples averages, subset accuracy, Hamming loss."""
    y, p = F.col("y_true") == 1, F.col("pred") == 1
    per_row = oof.groupBy(*keys, id_col).agg(
        F.count_if(y & p).cast("double").alias("tp"),
        F.count_if(~y & p).cast("double").alias("fp"),
        F.count_if(y & ~p).cast("double").alias("fn"),
        F.count(F.lit(1)).cast("double").alias("n"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    wrong = (fp + fn) / F.col("n")
    subset = F.avg((fp + fn == 0).cast("double"))
    return per_row.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        subset.alias("subset_accuracy"),
        (1 - subset).alias("zero_one_loss"),
        F.avg(wrong).alias("hamming_loss"),
        (1 - F.avg(wrong)).alias("hamming_score"),
        F.avg(ratio(2 * tp, 2 * tp + fp + fn, 0.0)).alias("f1_samples"),
        F.avg(ratio(tp, tp + fp, 0.0)).alias("precision_samples"),
        F.avg(ratio(tp, tp + fn, 0.0)).alias("recall_samples"),
        F.avg(ratio(tp, tp + fp + fn, 0.0)).alias("jaccard_samples"),
    )


def multilabel_report(oof: DataFrame, keys: list[str], id_col: str = "id") -> DataFrame:
    return averaged_metrics(oof, keys).join(row_metrics(oof, keys, id_col), keys)


def averaged_score_metrics(oof: DataFrame, keys: list[str]) -> DataFrame:
    """AUC and AP averaged over labels (macro, weighted by positives) and pooled (micro).

    A label with one class makes macro and weighted null, as an undefined AUC does in the source metric.
    """
    per_label = score_metrics(oof, [*keys, "label"])
    aggs = []
    for m in ("roc_auc", "average_precision"):
        complete = F.count(m) == F.count(F.lit(1))
        aggs.append(F.when(complete, F.avg(m)).alias(f"{m}_macro"))
        weighted = ratio(F.sum(F.col(m) * F.col("n_positive")), F.sum("n_positive").cast("double"))
        aggs.append(F.when(complete, weighted).alias(f"{m}_weighted"))
    pooled = score_metrics(oof, keys).select(
        *keys, F.col("roc_auc").alias("roc_auc_micro"), F.col("average_precision").alias("average_precision_micro")
    )
    return per_label.groupBy(*keys).agg(*aggs).join(pooled, keys)


def ranking_metrics(oof: DataFrame, keys: list[str], id_col: str = "id") -> DataFrame:
    """Label-ranking AP, ranking loss, coverage error, and AP / AUC averaged over rows.

    The label set of a row is gathered in one array; its length is the number of labels.
    """
    sets = oof.groupBy(*keys, id_col).agg(F.collect_list(F.struct("y_true", "score")).alias("s"))
    s = F.col("s")
    pos, neg = F.filter(s, lambda x: x["y_true"] == 1), F.filter(s, lambda x: x["y_true"] == 0)
    rows = sets.select(*keys, s.alias("s"), pos.alias("pos"), neg.alias("neg"))
    one_sided = (F.size("pos") == 0) | (F.size("neg") == 0)

    def share_ranked():
        def one(x):
            above_true = F.size(F.filter("pos", lambda z: z["score"] >= x["score"]))
            above_all = F.size(F.filter("s", lambda z: z["score"] >= x["score"]))
            return above_true / above_all

        return F.aggregate(F.transform("pos", one), F.lit(0.0), lambda a, b: a + b) / F.nullif(F.size("pos"), F.lit(0))

    pairs = (F.size("pos") * F.size("neg")).cast("double")
    wrong = F.aggregate(
        F.transform("pos", lambda x: F.size(F.filter("neg", lambda z: z["score"] >= x["score"]))), F.lit(0), lambda a, b: a + b
    )
    better = F.aggregate(
        F.transform(
            "pos",
            lambda x: F.size(F.filter("neg", lambda z: z["score"] < x["score"]))
            + F.size(F.filter("neg", lambda z: z["score"] == x["score"])) / 2,
        ),
        F.lit(0.0),
        lambda a, b: a + b,
    )
    weakest = F.array_min(F.transform("pos", lambda x: x["score"]))
    depth = F.when(F.size("pos") == 0, 0).otherwise(F.size(F.filter("s", lambda z: z["score"] >= weakest)))
    per_row = rows.select(
        *keys,
        F.when(one_sided, F.lit(1.0)).otherwise(share_ranked()).alias("lrap"),
        F.when(one_sided, F.lit(0.0)).otherwise(wrong / F.nullif(pairs, F.lit(0.0))).alias("loss"),
        depth.cast("double").alias("depth"),
        F.coalesce(share_ranked(), F.lit(0.0)).alias("ap"),
        F.when(~one_sided, better / F.nullif(pairs, F.lit(0.0))).alias("auc"),
    )
    return per_row.groupBy(*keys).agg(
        F.avg("lrap").alias("label_ranking_average_precision"),
        F.avg("loss").alias("label_ranking_loss"),
        F.avg("depth").alias("coverage_error"),
        F.avg("ap").alias("average_precision_samples"),
        F.when(F.count("auc") == F.count(F.lit(1)), F.avg("auc")).alias("roc_auc_samples"),
    )


def with_derived_state(oof: DataFrame, keys: list[str], id_col: str, name: str, score: str = "none") -> DataFrame:
    """Append the state "no label at all" as one more label.

    ``score='none'`` leaves its score null; ``score='complement'`` uses one minus the largest score.
    """
    derived_score = F.lit(None).cast("double") if score == "none" else 1 - F.max("score")
    derived = oof.groupBy(*keys, id_col).agg(
        (1 - F.max("y_true")).alias("y_true"), (1 - F.max("pred")).alias("pred"), derived_score.alias("score")
    )
    columns = [*keys, id_col, "label", "y_true", "pred", "score"]
    return oof.select(*columns).unionByName(derived.withColumn("label", F.lit(name)).select(*columns))


def outcome_class(y_true: str = "y_true", pred: str = "pred") -> F.Column:
    y, p = F.col(y_true) == 1, F.col(pred) == 1
    return F.when(y & p, "TP").when(~y & p, "FP").when(y & ~p, "FN").otherwise("TN")


def attribution_importance(attributions: DataFrame, keys: list[str]) -> DataFrame:
    """Mean absolute and mean signed attribution per key and feature."""
    return attributions.groupBy(*keys, "feature").agg(
        F.avg(F.abs("value")).alias("mean_abs"), F.avg("value").alias("mean_signed"), F.count("value").alias("n")
    )
