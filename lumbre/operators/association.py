"""Contingency tables, Fisher exact tests, false-discovery control, prevalence contrasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lumbre.functions.numeric import ratio
from lumbre.operators.ordered import row_rank, running_minimum


def melt(df: DataFrame, ids: list[str], columns: list[str], name: str = "feature", value: str = "value", as_type: str = "double") -> DataFrame:
    """Wide to long with one common value type."""
    casted = df.select(*ids, *[F.col(c).cast(as_type).alias(c) for c in columns])
    return casted.unpivot(ids, columns, name, value)


def contingency(df: DataFrame, features: list[str], labels: list[str]) -> DataFrame:
    """2x2 counts for every (feature, label) pair of 0/1 columns.

    Only the features are unpivoted; the labels stay as conditional sums, so a row is expanded by
    the number of features and then reduced on the map side to one row per feature and task.
    """
    long = melt(df, labels, features, as_type="int").filter("value is not null")
    sums = [F.count(F.lit(1)).alias("n"), F.sum("value").alias("n_exposed")]
    for i, lab in enumerate(labels):
        sums.append(F.sum(F.col(lab).cast("bigint")).alias(f"__pos_{i}"))
        sums.append(F.sum((F.col(lab) * F.col("value")).cast("bigint")).alias(f"__hit_{i}"))
    per_feature = long.groupBy("feature").agg(*sums)
    pairs = F.array(
        *[F.struct(F.lit(lab).alias("label"), F.col(f"__pos_{i}").alias("pos"), F.col(f"__hit_{i}").alias("hit")) for i, lab in enumerate(labels)]
    )
    flat = per_feature.select("feature", "n", "n_exposed", F.explode(pairs).alias("s"))
    return flat.select(
        "feature",
        F.col("s.label").alias("label"),
        F.col("s.hit").alias("a"),
        (F.col("n_exposed") - F.col("s.hit")).alias("b"),
        (F.col("s.pos") - F.col("s.hit")).alias("c"),
        (F.col("n") - F.col("n_exposed") - F.col("s.pos") + F.col("s.hit")).alias("d"),
    )


def with_rates(tables: DataFrame) -> DataFrame:
    """Rates in the exposed and the unexposed, their difference, and the sample odds ratio."""
    a, b, c, d = (F.col(x).cast("double") for x in "abcd")
    exposed, unexposed = ratio(a, a + b), ratio(c, c + d)
    margin_empty = (a + b == 0) | (c + d == 0) | (a + c == 0) | (b + d == 0)
    odds = F.when(margin_empty, F.lit(None).cast("double")).when(b * c == 0, F.lit(float("inf"))).otherwise(a * d / F.nullif(b * c, F.lit(0.0)))
    return tables.select(
        "*",
        exposed.alias("rate_exposed"),
        unexposed.alias("rate_unexposed"),
        (exposed - unexposed).alias("rate_difference"),
        odds.alias("odds_ratio"),
    )


def _log_factorial_step(start: str, end: str) -> str:
    """SQL text of ``ln(end!) - ln(start!)`` without cancellation for large arguments.

    Both arguments are moved up by ten, where Stirling's series is exact to double precision, and
    the ten factors are divided out again.
    """

    def series(n: str) -> str:
        sq = f"(1d / ({n} * {n}))"
        return f"((1d/12 - {sq} * (1d/360 - {sq} * (1d/1260 - {sq} * (1d/1680 - {sq} / 1188d)))) / {n})"

    def ten_factors(n: str) -> str:
        q = f"({n} * ({n} + 11))"
        return f"(({q} + 10) * ({q} + 18) * ({q} + 24) * ({q} + 28) * ({q} + 30))"

    low, high, move = f"({start} + 10d)", f"({end} + 10d)", f"({end} - {start})"
    raised = f"{move} * ln({low}) + ({high} + 0.5d) * log1p({move} / {low}) - {move} + {series(high)} - {series(low)}"
    return f"({raised} - ln({ten_factors(end)} / {ten_factors(start)}))"


def fisher_exact(tables: DataFrame, keys: list[str], chunk: int = 10_000) -> DataFrame:
    """Add two-sided and one-sided ("greater") exact p-values to 2x2 tables ``a b c d``.

    Weights relative to the most likely table are summed over the support, so no factorial of the
    sample size is needed. The support is cut to the range around the mode in which weights are
    above double precision, which has about ``sqrt(n)`` tables, and that range is spread in chunks.
    """
    a, b, c, d = (F.col(x).cast("double") for x in "abcd")
    r1, r2, c1, n = a + b, c + d, a + c, a + b + c + d
    base = tables.select(
        *keys, "a", "b", "c", "d",
        r1.alias("__r1"), r2.alias("__r2"), c1.alias("__c1"),
        F.greatest(F.lit(0.0), c1 - r2).alias("__min"), F.least(r1, c1).alias("__max"),
        F.floor((r1 + 1) * (c1 + 1) / (n + 2)).cast("double").alias("__m"),
        F.sqrt(r1 * r2 * c1 * (n - c1) / (F.greatest(n, F.lit(1.0)) * F.greatest(n, F.lit(1.0)) * F.greatest(n - 1, F.lit(1.0)))).alias("__sd"),
    ).withColumn("__mode", F.least(F.greatest(F.col("__m"), F.col("__min")), F.col("__max")))
    def weight(k: str) -> Column:
        m = "__mode"
        steps = [
            _log_factorial_step(k, m),
            _log_factorial_step(f"(__r1 - {k})", f"(__r1 - {m})"),
            _log_factorial_step(f"(__c1 - {k})", f"(__c1 - {m})"),
            _log_factorial_step(f"(__r2 - __c1 + {k})", f"(__r2 - __c1 + {m})"),
        ]
        return F.expr(f"exp({' + '.join(steps)})")

    # Tables farther out than the observed one plus nine deviations change no digit of the sums.
    own = F.least(F.abs(F.col("a") - F.col("__mode")), F.col("__sd") * 31)
    reach = F.ceil(own + F.col("__sd") * 9 + 200).cast("double")
    base = base.withColumn("__wobs", weight("cast(a as double)"))
    base = base.withColumn("__lo", F.greatest(F.col("__min"), F.col("__mode") - reach).cast("bigint")).withColumn(
        "__hi", F.least(F.col("__max"), F.col("__mode") + reach).cast("bigint")
    )

    starts = base.withColumn("__start", F.explode(F.sequence("__lo", "__hi", F.lit(chunk).cast("bigint"))))
    # An explicit partition count, so that small rows with much work behind them are not merged.
    width = int(tables.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = starts.repartition(width, *keys, "__start")
    ks = spread.withColumn("__k", F.explode(F.sequence(F.col("__start"), F.least(F.col("__start") + chunk - 1, F.col("__hi")))))
    weighed = ks.withColumn("__w", weight("cast(__k as double)"))
    limit = F.col("__wobs") * (1 + 1e-7)
    sums = weighed.groupBy(*keys).agg(
        F.sum("__w").alias("__all"),
        F.coalesce(F.sum(F.when(F.col("__w") <= limit, F.col("__w"))), F.lit(0.0)).alias("__two"),
        F.coalesce(F.sum(F.when(F.col("__k") >= F.col("a"), F.col("__w"))), F.lit(0.0)).alias("__up"),
        F.max("__wobs").alias("__own"),
    )
    p_values = sums.select(
        *keys,
        F.least(F.lit(1.0), F.greatest(F.col("__two"), F.col("__own")) / F.col("__all")).alias("p_two_sided"),
        F.least(F.lit(1.0), F.greatest(F.col("__up"), F.col("__own")) / F.col("__all")).alias("p_greater"),
    )
    return tables.join(p_values, keys, "left")


#: Tests up to which adjustment takes one window per scope.
FEW_TESTS = 100_000


def benjamini_hochberg(tests: DataFrame, p: str, scope: list[str], keys: list[str], out: str = "p_adjusted", few: int = FEW_TESTS) -> DataFrame:
    """False-discovery adjusted p-values within ``scope`` (empty: over all tests); null p stays null.

    More than ``few`` tests are ranked from the largest p by a range sort, and the running minimum goes from partition to partition.
    """
    scoped, ks = (tests, scope) if scope else (tests.withColumn("__scope", F.lit(0)), ["__scope"])
    present = F.col(p).isNotNull()
    if tests.count() > few:
        known = row_rank(scoped.filter(present), ks, [(p, False), *[(k, False) for k in keys]], "__down", "__m")
        # The largest p has rank m, so q = p * m / (m - place + 1).
        known = known.withColumn("__q", F.col(p) * F.col("__m") / (F.col("__m") - F.col("__down") + 1))
        least = running_minimum(known, ks, [("__down", True)], "__q", "__least")
        done = least.select(*tests.columns, F.least("__least", F.lit(1.0)).alias(out))
        return done.unionByName(tests.filter(~present).withColumn(out, F.lit(None).cast("double")))
    by_p = W.partitionBy(*ks, present).orderBy(F.col(p), *[F.col(k) for k in keys])
    m = F.count(p).over(W.partitionBy(*ks, present))
    raw = scoped.withColumn("__q", F.col(p) * m / F.row_number().over(by_p))
    down = W.partitionBy(*ks, present).orderBy(F.col(p).desc(), *[F.col(k).desc() for k in keys]).rowsBetween(W.unboundedPreceding, 0)
    return raw.withColumn(out, F.when(present, F.least(F.min("__q").over(down), F.lit(1.0)))).drop("__q", "__scope")


def association_table(df: DataFrame, features: list[str], labels: list[str]) -> DataFrame:
    """Counts, rates, odds ratio, exact p and adjusted p (over all pairs and within a label)."""
    keys = ["feature", "label"]
    tested = fisher_exact(with_rates(contingency(df, features, labels)), keys)
    overall = benjamini_hochberg(tested, "p_two_sided", [], keys, "p_adjusted_all")
    return benjamini_hochberg(overall, "p_two_sided", ["label"], keys, "p_adjusted_label")


def prevalence(df: DataFrame, features: list[str]) -> DataFrame:
    """Positives and share per 0/1 feature."""
    return (
        melt(df, [], features)
        .groupBy("feature")
        .agg(F.count("value").alias("n"), F.sum("value").cast("bigint").alias("n_positive"))
        .withColumn("prevalence", ratio(F.col("n_positive").cast("double"), F.col("n").cast("double")))
    )


def prevalence_contrast(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """Share of each feature in the two classes of a label, and the difference."""
    return (
        melt(df, [label], features)
        .groupBy("feature")
        .agg(
            F.avg(F.when(F.col(label) == 1, F.col("value"))).alias("share_positive"),
            F.avg(F.when(F.col(label) == 0, F.col("value"))).alias("share_negative"),
        )
        .withColumn("share_difference", F.col("share_positive") - F.col("share_negative"))
    )
