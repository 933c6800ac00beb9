"""Collecting, verifying, summarising and ranking experiment results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumbre.functions.numeric import approx_equal, reaches
from lumbre.operators.ordered import best_row, top_rows
from lumbre.session import ContractError

# Tolerance of stored scores that lie on a threshold, and of stored metrics.
TIE_TOLERANCE = 1e-7
METRIC_RTOL, METRIC_ATOL = 1e-10, 1e-12


def long_metrics(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    return df.select(*keys, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(keys, metrics, "metric", "value")


def fold_summary(metrics: DataFrame, keys: list[str], deviation: str = "sample") -> DataFrame:
    """Mean, sd, min and max over folds of a long metric table.

    ``deviation``: ``sample`` (n - 1), ``population`` (n), or ``sample_or_zero`` (0 for a single row).
    """
    sd = {
        "sample": F.stddev_samp("value"),
        "population": F.stddev_pop("value"),
        "sample_or_zero": F.when(F.count("value") > 1, F.stddev_samp("value")).otherwise(F.lit(0.0)),
    }
    if deviation not in sd:
        raise ContractError("deviation must be sample, population or sample_or_zero")
    return metrics.groupBy(*keys, "metric").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), sd[deviation].alias("sd"), F.min("value").alias("min"), F.max("value").alias("max")
    )


def family_summary(runs: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    aggs = []
    for m in metrics:
        aggs += [F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_sd")]
    return runs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_runs"), *aggs)


def paired_delta_summary(deltas: DataFrame, keys: list[str], metrics: list[str], lower_is_better: tuple[str, ...] = ()) -> DataFrame:
    """Mean and sd of paired deltas and the number of wins; for some metrics a negative delta wins."""
    aggs = [F.count(F.lit(1)).alias("n_pairs")]
    for m in metrics:
        d = F.col(f"delta_{m}")
        won = d < 0 if m in lower_is_better else d > 0
        aggs += [
            F.avg(d).alias(f"delta_{m}_mean"),
            F.when(F.count(d) > 1, F.stddev_samp(d)).otherwise(F.lit(0.0)).alias(f"delta_{m}_sd"),
            F.count_if(won).alias(f"wins_{m}"),
        ]
    return deltas.groupBy(*keys).agg(*aggs)


def metric_mismatches(stored: DataFrame, recomputed: DataFrame, keys: list[str]) -> DataFrame:
    """Stored metrics that differ from recomputed ones, or that one side lacks."""
    a = stored.select(*keys, "metric", F.col("value").alias("stored"), F.lit(1).alias("__a"))
    b = recomputed.select(*keys, "metric", F.col("value").alias("recomputed"), F.lit(1).alias("__b"))
    kind = (
        F.when(F.col("__a").isNull(), "missing").when(F.col("__b").isNull(), "extra")
        .when(~approx_equal(F.col("stored"), F.col("recomputed"), METRIC_ATOL, METRIC_RTOL), "different")
    )
    return a.join(b, [*keys, "metric"], "full").select(*keys, "metric", "stored", "recomputed", kind.alias("problem")).filter("problem is not null")


def prediction_check(oof: DataFrame, keys: list[str], threshold: Column) -> DataFrame:
    """Stored predictions against ``score >= threshold``: mismatches within and beyond the tie tolerance."""
    mismatch = F.col("pred") != reaches(F.col("score"), threshold).cast("int")
    distance = F.when(~F.isnan("score"), F.abs(F.col("score") - threshold))
    tie = F.coalesce(distance <= TIE_TOLERANCE, F.lit(False))
    return oof.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(mismatch & tie).alias("n_ties"), F.count_if(mismatch & ~tie).alias("n_invalid"),
        F.max(F.when(mismatch & ~tie, distance)).alias("max_difference"),
    )


def threshold_per_fold(oof: DataFrame, keys: list[str], threshold: str, summary: DataFrame) -> DataFrame:
    """Folds with several threshold values, or with a value other than the summary's."""
    per = oof.groupBy(*keys).agg(F.min(threshold).alias("low"), F.max(threshold).alias("high"))
    joined = per.join(summary.select(*keys, F.col(threshold).alias("expected")), keys, "full")
    problem = (
        F.when(F.col("low").isNull(), "fold missing").when(F.col("expected").isNull(), "summary missing")
        .when(F.col("low") != F.col("high"), "several values")
        .when(~approx_equal(F.col("low"), F.col("expected"), METRIC_ATOL, METRIC_RTOL), "differs from summary")
    )
    return joined.select(*keys, problem.alias("problem")).filter("problem is not null")


def complete_candidates(runs: DataFrame, n_folds: int) -> DataFrame:
    """Runs that may compete: status ok, every fold done, finite main metric."""
    micro = F.col("f1_micro")
    return runs.filter(
        (F.lower(F.trim("status")) == "ok") & (F.col("n_folds") == n_folds) & micro.isNotNull() & ~F.isnan(micro) & (F.abs(micro) != float("inf"))
    )


def best_complete_candidate(runs: DataFrame, n_folds: int) -> DataFrame:
    """Best complete run by micro F1, macro F1, then the larger configuration id."""
    return complete_candidates(runs, n_folds).orderBy(F.desc("f1_micro"), F.desc_nulls_last("f1_macro"), F.desc("config_id")).limit(1)


def follow_up_grid(runs: DataFrame, order: list[Column], k: int, column: str, options: list) -> DataFrame:
    """The k best runs emitted again with one option changed."""
    top = runs.orderBy(*order).limit(k)
    return top.withColumn(column, F.explode(F.array(*[F.lit(o) for o in options])))


def extreme_cases(oof: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """Highest score per key, the smaller id first among equals."""
    return best_row(oof, keys, [F.desc("score"), F.col(id_col)])


def priority_cases(oof: DataFrame, keys: list[str], id_col: str, multi: str, quota: int) -> DataFrame:
    """Cases among true positives rows: one TP and one FN first, then back-fill to the quota.

    Rows positive for several labels come first; then TP by falling and FN by rising score.
    """
    hit = oof.filter("y_true = 1").withColumn("kind", F.when(F.col("pred") == 1, "tp").otherwise("fn"))
    signed = F.when(F.col("kind") == "tp", -F.col("score")).otherwise(F.col("score"))
    # At most ``quota`` rows of each kind can be picked, so both steps stay group-limited.
    short = top_rows(hit, [*keys, "kind"], [F.desc(multi), signed, F.col(id_col)], quota, "__in_kind")
    lead = F.when(F.col("__in_kind") == 1, 0).otherwise(1)
    order = [lead, F.when(F.col("kind") == "tp", 0).otherwise(1), F.col("__in_kind")]
    return top_rows(short, keys, order, quota, "position").drop("__in_kind")


def status_matrix(runs: DataFrame, family: str, statuses: list[str], name: str | None = None) -> DataFrame:
    """Runs per family and status, with all-ok and any-failure flags; with ``name``, the sorted names of the runs that failed, joined by `` | ``.

    The names of a family are a report for a reader: one cell holds those of its failed runs.
    """
    counts = [F.count_if(F.col("status") == s).alias(f"n_{s}") for s in statuses]
    listed = [F.array_join(F.sort_array(F.collect_list(F.when(F.col("status") == s, F.col(name).cast("string")))), " | ").alias(f"{s}_names") for s in statuses if s != "ok"] if name else []
    wide = runs.groupBy(family).agg(F.count(F.lit(1)).alias("n_runs"), *counts, *listed)
    return wide.withColumns(
        {"all_ok": (F.col("n_ok") == F.col("n_runs")).cast("int"), **{f"any_{s}": (F.col(f"n_{s}") > 0).cast("int") for s in statuses if s != "ok"}}
    )


def status_order(status: str, order: list[str]) -> Column:
    """Sort key of a categorical status."""
    out = F.lit(len(order))
    for i, s in reversed(list(enumerate(order))):
        out = F.when(F.col(status) == s, i).otherwise(out)
    return out


def best_per_family(runs: DataFrame, family: str, order: list[Column]) -> DataFrame:
    return best_row(runs, [family], order)


def with_mean_rows(folds: DataFrame, keys: list[str], fold: str, metrics: list[str]) -> DataFrame:
    """The per-fold table with a mean row per key (fold ``mean``)."""
    rows = folds.select(*keys, F.col(fold).cast("string").alias(fold), *metrics)
    means = folds.groupBy(*keys).agg(*[F.avg(m).alias(m) for m in metrics]).withColumn(fold, F.lit("mean"))
    return rows.unionByName(means)


def incomplete_runs(artifacts: DataFrame, run: str, name: str, expected: list[str]) -> DataFrame:
    """Runs that lack some of the expected artifacts, with the missing names."""
    have = artifacts.groupBy(run).agg(F.collect_set(F.when(F.col(name).isin(*expected), F.col(name))).alias("__has"))
    lacking = F.array_except(F.array(*[F.lit(e) for e in expected]), F.col("__has"))
    return have.select(run, F.array_join(F.array_sort(lacking), ",").alias("missing")).filter("missing <> ''")
