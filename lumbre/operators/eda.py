"""Exploratory statistics: frequencies, label summaries, moments, bins, series summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumbre.functions.numeric import ratio, row_sum
from lumbre.functions.text import missing_to_null, split_labels
from lumbre.operators.association import melt
from lumbre.operators.ordered import exact_quantiles, previous_value
from lumbre.session import ContractError


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join in which a null key equals a null key; the columns of ``left``, then the others of ``right``."""
    named = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    match = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys])
    return left.join(named, match).drop(*[f"__r_{k}" for k in keys])


def cohort_integrity(df: DataFrame, id_col: str, expected: int | None = None) -> DataFrame:
    """Rows, distinct ids, duplicate rows and nulls of the id, in one row; another number of ids than expected is an error."""
    if expected is not None:
        found = df.select(F.countDistinct(id_col)).first()[0]
        if found != expected:
            raise ContractError(f"{found} ids instead of {expected}")
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.countDistinct(id_col).alias("n_ids"),
        F.count_if(F.col(id_col).isNull()).alias("n_null_ids"),
    ).withColumn("n_duplicates", F.col("n_rows") - F.col("n_null_ids") - F.col("n_ids"))


def null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns], F.count(F.lit(1)).alias("__n"))
    return wide.select("__n", *columns).unpivot(["__n"], columns, "column", "n_null").select("column", "n_null", F.col("__n").alias("n_rows"))


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, mean, sd, minimum, exact quartiles and maximum per numeric column."""
    long = melt(df, [], columns)
    moments = long.groupBy("feature").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"),
        F.min("value").alias("min"), F.max("value").alias("max"),
    )
    quartiles = exact_quantiles(long, ["feature"], "value", [0.25, 0.5, 0.75])
    return moments.join(quartiles, "feature").select(
        "feature", "n", "mean", "sd", "min",
        *[F.col("quantiles")[i].alias(f"q{25 * (i + 1)}") for i in range(3)], "max",
    )


def describe_categories(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, distinct values and most frequent value per text column."""
    long = melt(df, [], columns, as_type="string").filter("value is not null")
    counts = long.groupBy("feature", "value").count()
    return counts.groupBy("feature").agg(
        F.sum("count").alias("n"), F.count(F.lit(1)).alias("n_unique"),
        F.max_by("value", F.struct("count", F.col("value"))).alias("top"), F.max("count").alias("top_n"),
    )


def moments(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, mean, sd (n - 1), quartiles, IQR, biased skewness and Pearson kurtosis."""
    stats = df.groupBy(*keys).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.min(value).alias("min"),
        F.max(value).alias("max"), F.skewness(value).alias("skewness"), (F.kurtosis(value) + 3).alias("kurtosis"),
    )
    q = exact_quantiles(df, keys, value, [0.25, 0.5, 0.75]).select(*keys, "quantiles")
    joined = join_null_safe(stats, q, keys) if keys else stats.join(F.broadcast(q), how="cross")  # one row on each side
    return joined.select(
        *keys, "n", "mean", "sd", "min", *[F.col("quantiles")[i].alias(f"q{25 * (i + 1)}") for i in range(3)], "max",
        (F.col("quantiles")[2] - F.col("quantiles")[0]).alias("iqr"), "skewness", "kurtosis",
    )


def iqr_outliers(df: DataFrame, keys: list[str], value: str, factor: float = 1.5) -> DataFrame:
    """Rows outside the quartiles by more than ``factor`` times the IQR, with the bounds."""
    q = exact_quantiles(df, keys, value, [0.25, 0.75]).select(
        *keys,
        (F.col("quantiles")[0] - factor * (F.col("quantiles")[1] - F.col("quantiles")[0])).alias("lower"),
        (F.col("quantiles")[1] + factor * (F.col("quantiles")[1] - F.col("quantiles")[0])).alias("upper"),
    )
    joined = join_null_safe(df, q, keys) if keys else df.join(F.broadcast(q), how="cross")  # one row of bounds
    return joined.filter((F.col(value) < F.col("lower")) | (F.col(value) > F.col("upper")))


def frequencies(df: DataFrame, column: Column, name: str = "level", explode_labels: bool = False, missing: str | None = "missing") -> DataFrame:
    """Counts and percentage of the cohort; multi-label cells count every label they hold."""
    if explode_labels:
        labels = split_labels(column)
        items = F.when(F.size(labels) == 0, F.array(F.lit(missing))).otherwise(labels)
        levels = df.select(F.explode(items).alias(name))
    else:
        levels = df.select(missing_to_null(column, missing).alias(name))
    counts = levels.groupBy(name).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1)).alias("__total"))
    # ``total`` is one row.
    return counts.join(F.broadcast(total), how="cross").select(name, "n", (100.0 * F.col("n") / F.col("__total")).alias("percent"))


def group_rates(df: DataFrame, keys: list[str], label: str, min_n: int = 0) -> DataFrame:
    """Size, positives, complement and rate in percent per group, for groups of at least ``min_n`` rows."""
    stats = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("bigint")).alias("positives"))
    return stats.filter(F.col("n") >= min_n).select(
        *keys, "n", "positives", (F.col("n") - F.col("positives")).alias("negatives"), (100.0 * F.col("positives") / F.col("n")).alias("rate_percent")
    )


def label_summary(df: DataFrame, labels: list[str], none_name: str = "none") -> DataFrame:
    """Support and share per label, including the derived "none"."""
    full = df.select(*labels, (row_sum([F.col(c) for c in labels]) == 0).cast("int").alias(none_name))
    long = melt(full, [], [*labels, none_name], "label", "y", "int")
    return long.groupBy("label").agg(F.sum(F.col("y").cast("bigint")).alias("support"), F.avg("y").alias("share"))


def label_coherence(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """One row per check: whether it holds in every row, and in how many it does not."""
    wide = df.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in checks.items()])
    return wide.unpivot([], list(checks), "check", "n_violations").withColumn("holds", (F.col("n_violations") == 0).cast("int"))


def labels_per_row(df: DataFrame, labels: list[str]) -> DataFrame:
    return df.groupBy(row_sum([F.col(c) for c in labels]).cast("int").alias("n_labels")).agg(F.count(F.lit(1)).alias("n"))


def label_cooccurrence(df: DataFrame, labels: list[str]) -> DataFrame:
    """Rows positive for both labels, for every ordered pair (the diagonal is the support)."""
    pairs = [(a, b) for a in labels for b in labels]
    entries = F.array(
        *[F.struct(F.lit(a).alias("label_a"), F.lit(b).alias("label_b"), (F.col(a) * F.col(b)).cast("bigint").alias("v")) for a, b in pairs]
    )
    return df.select(F.explode(entries).alias("e")).groupBy("e.label_a", "e.label_b").agg(F.sum("e.v").alias("n"))


def label_combinations(df: DataFrame, labels: list[str]) -> DataFrame:
    combo = F.concat_ws("", *[F.col(c).cast("string") for c in labels])
    return df.groupBy(combo.alias("labelset")).agg(F.count(F.lit(1)).alias("n"))


def label_cardinality(df: DataFrame, labels: list[str]) -> DataFrame:
    total = row_sum([F.col(c) for c in labels])
    return df.agg(F.avg(total).alias("cardinality"), (F.avg(total) / len(labels)).alias("density"))


def crosstab(df: DataFrame, row: str, column: str) -> DataFrame:
    """Counts per pair with the share within the row level."""
    counts = df.filter(F.col(row).isNotNull() & F.col(column).isNotNull()).groupBy(row, column).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(row).agg(F.sum("n").alias("__t"))
    return counts.join(totals, row).select(row, column, "n", (F.col("n") / F.col("__t")).alias("row_share"))


def count_pivot(df: DataFrame, row: str, column: str, levels: list) -> DataFrame:
    """Counts and row percentages as columns, one pair per level."""
    wide = df.groupBy(row).agg(
        F.count(F.lit(1)).alias("__n"), *[F.count_if(F.col(column) == v).alias(f"n_{v}") for v in levels]
    )
    return wide.select(row, *[f"n_{v}" for v in levels], *[(100.0 * F.col(f"n_{v}") / F.col("__n")).alias(f"percent_{v}") for v in levels])


def outlier_share(df: DataFrame, keys: list[str], value: str, factor: float = 1.5) -> DataFrame:
    """Rows, rows outside the IQR bounds and their share, per key."""
    outside = iqr_outliers(df, keys, value, factor).groupBy(*keys).agg(F.count(F.lit(1)).alias("__out"))
    sizes = df.groupBy(*keys).agg(F.count(value).alias("n"))
    named = outside.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    match = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys])
    both = sizes.join(named, match, "left").withColumn("n_outliers", F.coalesce("__out", F.lit(0)))
    return both.select(*keys, "n", "n_outliers", (F.col("n_outliers") / F.nullif(F.col("n"), F.lit(0))).alias("share"))


def dataset_profile(df: DataFrame, columns: list[str], cheap: bool = False) -> DataFrame:
    """Per column: rows, nulls, distinct values and, for numbers, their range. The cheap form reads no value twice: it leaves the distinct values to a sketch."""
    distinct = (lambda c: F.approx_count_distinct(c)) if cheap else (lambda c: F.countDistinct(c))
    numeric = {c for c, t in df.dtypes if t in ("int", "bigint", "double", "float", "smallint", "tinyint")}
    none = F.lit(None).cast("double")
    facts = [
        F.struct(
            F.lit(c).alias("column"), F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col(c).isNull()).alias("n_null"), distinct(c).alias("n_unique"),
            (F.min(F.col(c).cast("double")) if c in numeric else none).alias("least"), (F.max(F.col(c).cast("double")) if c in numeric else none).alias("greatest"),
        )
        for c in columns
    ]
    return df.agg(F.array(*facts).alias("facts")).select(F.inline("facts"))


def class_mix(grid: DataFrame, keys: list[str], value: str) -> DataFrame:
    """How the settings of a grid share out over the classes of one column, per key: count and share."""
    counts = grid.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    totals = grid.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_all"))
    joined = join_null_safe(counts, totals, keys) if keys else counts.join(F.broadcast(totals), how="cross")  # one row of totals
    return joined.select(*keys, value, "n", (F.col("n") / F.col("n_all")).alias("share"))


def bin_names(edges: list[float]) -> list[str]:
    """Names ``[a, b)`` of left-closed bins; an edge has all its digits where six would change it."""
    digits = [f"{e:g}" if float(f"{e:g}") == e else repr(float(e)) for e in edges]
    return [f"[{a}, {b})" for a, b in zip(digits, digits[1:])]


def bin_index(value: Column, edges: list[float]) -> Column:
    """Number of the left-closed bin ``[a, b)``, from 0; null outside the edges."""
    out = None
    for i, (a, b) in enumerate(zip(edges, edges[1:])):
        here = (value >= a) & (value < b)
        out = F.when(here, i) if out is None else out.when(here, i)
    return out


def rates_per_bin(df: DataFrame, value: str, edges: list[float], labels: list[str]) -> DataFrame:
    """Label rates per bin with bin sizes; empty bins stay with n = 0."""
    spark = df.sparkSession
    bins = spark.createDataFrame(list(enumerate(bin_names(edges))), "bin_index int, bin string")
    stats = df.withColumn("bin_index", bin_index(F.col(value), edges)).filter("bin_index is not null").groupBy("bin_index").agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(F.col(c).cast("double")).alias(c) for c in labels]
    )
    wide = bins.join(stats, "bin_index", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return wide.unpivot(["bin_index", "bin", "n"], labels, "label", "rate")


def grouped_summary(df: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """Mean and exact quartiles of each column per outcome group."""
    long = melt(df, keys, columns)
    means = long.groupBy(*keys, "feature").agg(F.count("value").alias("n"), F.avg("value").alias("mean"))
    q = exact_quantiles(long, [*keys, "feature"], "value", [0.25, 0.5, 0.75]).select(*keys, "feature", "quantiles")
    return join_null_safe(means, q, [*keys, "feature"]).select(
        *keys, "feature", "n", "mean", *[F.col("quantiles")[i].alias(f"q{25 * (i + 1)}") for i in range(3)]
    )


def mode_per_key(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """Most frequent non-missing value per key; among equals the one seen first."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__c"), F.min(order).alias("__first"))
    return counts.groupBy(*keys).agg(
        F.min_by(value, F.struct((-F.col("__c")).alias("c"), "__first")).alias("mode"), F.count(F.lit(1)).alias("n_distinct")
    )


def series_geometry(df: DataFrame, keys: list[str], position: str, digits: int = 3) -> DataFrame:
    """Distinct rounded positions, duplicates, median and population sd of the gaps, coverage."""
    rounded = df.filter(F.col(position).isNotNull()).select(*keys, F.bround(position, digits).alias("p"))
    distinct = rounded.groupBy(*keys, "p").agg(F.count(F.lit(1)).alias("c"))
    size = distinct.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_positions"), (F.sum("c") - F.count(F.lit(1))).alias("n_duplicates"), (F.max("p") - F.min("p")).alias("__span")
    )
    gaps = previous_value(distinct.drop("c"), keys, "p").select(*keys, (F.col("p") - F.col("previous")).alias("gap")).filter("gap > 1e-3")
    medians = exact_quantiles(gaps, keys, "gap", [0.5]).select(*keys, F.col("quantiles")[0].alias("median_gap"))
    spread = gaps.groupBy(*keys).agg(F.stddev_pop("gap").alias("sd_gap"))
    return (
        size.join(medians, keys, "left").join(spread, keys, "left").withColumn("coverage", F.col("__span") + F.col("median_gap")).drop("__span")
    )


def class_ratio(df: DataFrame, labels: list[str]) -> DataFrame:
    """Positives, negatives, negative-to-positive ratio and positive weight per label."""
    long = melt(df, [], labels, "label", "y", "int")
    sums = long.groupBy("label").agg(F.sum(F.col("y").cast("bigint")).alias("positives"), F.sum((1 - F.col("y")).cast("bigint")).alias("negatives"))
    return sums.withColumn("positive_weight", ratio(F.col("negatives").cast("double"), F.col("positives").cast("double")))


def any_positive(df: DataFrame, key: str, flag: Column) -> DataFrame:
    """One row per key: positive when any of its rows is."""
    return df.groupBy(key).agg(F.max(F.coalesce(flag.cast("int"), F.lit(0))).alias("positive"), F.count(F.lit(1)).alias("n_rows"))


def duplicate_configurations(df: DataFrame, canonical: Column, name: str) -> DataFrame:
    """Configurations that occur more than once in canonical form, with the name that stays."""
    return (
        df.withColumn("__hash", F.sha2(canonical, 256)).groupBy("__hash")
        .agg(F.count(F.lit(1)).alias("n"), F.min(name).alias("kept")).filter("n > 1").select(F.col("__hash").alias("configuration"), "n", "kept")
    )


def evenly_spaced(df: DataFrame, keys: list[str], place: str, size: str, k: int) -> DataFrame:
    """k evenly spaced rows per group from a table with 1-based places and group sizes; all rows of small groups."""
    last = F.col(size) - 1
    at = F.col(place) - 1
    step = F.lit(k - 1)
    hits = F.exists(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.bround(i * last / step) == at)
    return df.filter((F.col(size) <= k) | hits)
