"""Joins with stated contracts, coverage reports, manifests and set checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumbre.functions.text import strip_accents
from lumbre.session import ContractError, assert_empty


def trimmed_key(df: DataFrame, key: str) -> DataFrame:
    return df.withColumn(key, F.trim(F.col(key).cast("string")))


def left_on_trimmed_key(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return trimmed_key(left, key).join(trimmed_key(right, key), key, "left")


def inner_then_left(left: DataFrame, inner: DataFrame, key: str, more: list[DataFrame]) -> DataFrame:
    """Rows that both tables have, then the columns of further tables where they have the key; keys of ``more`` are checked to be unique."""
    out = left.join(inner, key)
    for table in more:
        assert_empty(duplicate_keys(table, [key]), f"duplicate {key} in a table that is joined on the left")
        out = out.join(table, key, "left")
    return out


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).count().filter("count > 1")


def one_to_one(left: DataFrame, right: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Left join after checking that keys are unique on both sides and that no added value is missing."""
    assert_empty(duplicate_keys(left, [key]), f"duplicate {key} on the left")
    assert_empty(duplicate_keys(right, [key]), f"duplicate {key} on the right")
    joined = left.join(right.select(key, *columns), key, "left")
    assert_empty(joined.filter(" OR ".join(f"`{c}` IS NULL" for c in columns)).select(key), "missing values after the join")
    return joined


def normalised_id(column: Column) -> Column:
    """Lower case, no accents, letters and digits only, no leading zeros."""
    return F.regexp_replace(F.regexp_replace(strip_accents(column.cast("string")), "[^a-z0-9]", ""), "^0+(?=.)", "")


def cascading_join(
    features: DataFrame, labels: DataFrame, key: str, label_key: str, targets: list[str], mapping: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Direct key, else normalised key, else mapping table: the first with any match serves all rows.

    Returns the joined table and a one-row report.
    """
    spark = features.sparkSession
    wanted = labels.select(F.col(label_key).alias("__l"), *targets)
    plans: list[tuple[str, DataFrame]] = [("direct", features.join(wanted, F.col(key) == F.col("__l"), "left"))]
    norm = wanted.withColumn("__l", normalised_id(F.col("__l")))
    plans.append(("normalised", features.join(norm, normalised_id(F.col(key)) == F.col("__l"), "left")))
    if mapping is not None:
        routes = mapping.filter(F.col(label_key).isNotNull()).select(F.col(key), F.trim(F.col(label_key).cast("string")).alias("__m"))
        plans.append(("mapping", features.join(routes, key, "left").join(wanted, F.col("__m") == F.col("__l"), "left").drop("__m")))
    complete = " AND ".join(f"`{t}` IS NOT NULL" for t in targets)
    for name, joined in plans:
        if not joined.filter(complete).isEmpty():
            if name == "normalised":
                # Labels that become one id would multiply the rows of the table.
                assert_empty(duplicate_keys(norm, ["__l"]), "labels with one normalised id")
            out = joined.drop("__l")
            report = out.agg(
                F.lit(name).alias("strategy"), F.count(F.lit(1)).alias("n_rows"), F.countDistinct(key).alias("n_ids"),
                F.count_if(F.expr(complete)).alias("n_with_all_targets"),
            )
            return out, report
    raise ContractError("no labels matched by any strategy")


def merge_variants(df: DataFrame, key: str, variant: str, names: list[str], columns: list[str]) -> DataFrame:
    """One row per key with the columns of every variant, prefixed; duplicates per variant are an error."""
    chosen = df.filter(F.col(variant).isin(*names))
    assert_empty(duplicate_keys(chosen, [key, variant]), "duplicate rows per key and variant")
    picks = [
        F.max(F.when(F.col(variant) == n, F.col(c))).alias(f"{n}_{c}") for n in names for c in columns
    ]
    return chosen.groupBy(key).agg(*picks)


def last_non_null(df: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """Fold the rows of a key into one: per column the last value that is not null."""
    return df.groupBy(key).agg(
        *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns]
    )


def key_differences(tables: dict[str, DataFrame], key: str) -> DataFrame:
    """Keys that are not in every table, with the tables that lack them. Empty when the key sets are equal."""
    tagged = reduce(
        DataFrame.unionByName, [t.select(F.col(key)).distinct().withColumn("__t", F.lit(n)) for n, t in tables.items()]
    )
    names = F.array(*[F.lit(n) for n in tables])
    return (
        tagged.groupBy(key)
        .agg(F.collect_set("__t").alias("__has"))
        .select(key, F.array_join(F.array_sort(F.array_except(names, F.col("__has"))), ",").alias("missing_in"))
        .filter("missing_in <> ''")
    )


def aligned(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One-to-one join of tables that must have the same ids, each once; anything else is an error."""
    for table in (left, right):
        assert_empty(table.groupBy(key).count().filter((F.col("count") > 1) | F.col(key).isNull()), "ids that repeat or are missing")
    assert_empty(key_differences({"left": left, "right": right}, key), "tables with different ids")
    return left.join(right, key)


def missing_with_reason(ids: DataFrame, other: DataFrame, key: str, reason: str) -> DataFrame:
    return ids.select(key).distinct().join(other.select(key), key, "left_anti").withColumn("reason", F.lit(reason))


def shared_cohort(tables: list[DataFrame], key: str) -> DataFrame:
    """Keys present in every table."""
    return reduce(lambda a, b: a.join(b.select(key), key, "left_semi"), [tables[0].select(key).distinct(), *tables[1:]])


def coverage_matrix(tables: dict[str, DataFrame], key: str) -> DataFrame:
    """One row per key with a 0/1 column per table, from one shuffle of the key columns."""
    tagged = reduce(DataFrame.unionByName, [t.select(key).withColumn("__t", F.lit(n)) for n, t in tables.items()])
    return tagged.groupBy(key).agg(*[F.max((F.col("__t") == n).cast("int")).alias(f"has_{n}") for n in tables])


def paired_deltas(df: DataFrame, keys: list[str], method: str, base: str, other: str, metrics: list[str]) -> DataFrame:
    """Both methods side by side with ``other - base`` deltas; a key with one method only is an error."""
    aggs = [F.count_if(F.col(method) == m).alias(f"__n_{i}") for i, m in enumerate((base, other))]
    for m in metrics:
        aggs.append(F.max(F.when(F.col(method) == base, F.col(m))).alias(f"{base}_{m}"))
        aggs.append(F.max(F.when(F.col(method) == other, F.col(m))).alias(f"{other}_{m}"))
    wide = df.filter(F.col(method).isin(base, other)).groupBy(*keys).agg(*aggs)
    assert_empty(wide.filter("__n_0 <> 1 OR __n_1 <> 1").select(*keys), "methods are not paired")
    return wide.drop("__n_0", "__n_1").withColumns({f"delta_{m}": F.col(f"{other}_{m}") - F.col(f"{base}_{m}") for m in metrics})


def metric_deltas(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """``b - a`` over the metrics that both arms have, on long metric tables."""
    return a.select(*keys, "metric", F.col("value").alias("value_a")).join(
        b.select(*keys, "metric", F.col("value").alias("value_b")), [*keys, "metric"]
    ).withColumn("delta", F.col("value_b") - F.col("value_a"))


def target_differences(a: DataFrame, b: DataFrame, keys: list[str], targets: list[str]) -> DataFrame:
    """Keys whose targets differ between two arms, or that one arm lacks."""
    left = a.select(*keys, F.struct(*targets).alias("__a"))
    right = b.select(*keys, F.struct(*targets).alias("__b"))
    return left.join(right, keys, "full").filter(~F.col("__a").eqNullSafe(F.col("__b"))).select(
        *keys, F.when(F.col("__a").isNull(), "missing in first").when(F.col("__b").isNull(), "missing in second").otherwise("different").alias("difference")
    )


def manifest(spark: SparkSession, axes: dict[str, list], first_id: int = 0) -> DataFrame:
    """Numbered grid of settings in product order (the last axis varies fastest).

    The task number is arithmetic on the positions, so no global sort or single-task window is needed.
    """
    sizes = [len(v) for v in axes.values()]
    total = 1
    for n in sizes:
        total *= n
    base = spark.range(total).select((F.col("id") + first_id).alias("task_id"), F.col("id").alias("__i"))
    columns, stride = [], total
    for (name, values), n in zip(axes.items(), sizes):
        stride //= n
        place = (F.floor(F.col("__i") / stride) % n + 1).cast("int")
        columns.append(F.element_at(F.array(*[F.lit(v) for v in values]), place).alias(name))
    return base.select("task_id", *columns)


def non_empty_subsets(spark: SparkSession, items: list[str]) -> DataFrame:
    """All non-empty subsets of a small set, by size and then by position."""
    n = len(items)
    members = F.filter(
        F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(F.shiftright(F.col("id"), 0).bitwiseAND(F.pow(F.lit(2), i).cast("bigint")) > 0, i)),
        lambda i: i.isNotNull(),
    )
    names = F.array(*[F.lit(x) for x in items])
    return spark.range(1, 2**n).select(
        F.array_join(F.transform(members, lambda i: F.element_at(names, (i + 1).cast("int"))), "+").alias("combination"),
        F.size(members).alias("size"),
    )


def feature_sets(base: DataFrame, variants: dict[str, DataFrame], key: str) -> dict[str, DataFrame]:
    """Wide feature table joined with each clinical variant."""
    return {name: base.join(v, key, "left") for name, v in variants.items()}


def ordered_dedup(df: DataFrame, value: str, order: str) -> DataFrame:
    """Distinct values with the place of their first occurrence."""
    return df.groupBy(value).agg(F.min(order).alias("first_position"))


def union_tables(tables: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def set_differences(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys on one side only, both ways."""
    left = a.select(key).distinct().join(b.select(key), key, "left_anti").withColumn("side", F.lit("first_only"))
    right = b.select(key).distinct().join(a.select(key), key, "left_anti").withColumn("side", F.lit("second_only"))
    return left.unionByName(right)


def assert_disjoint(a: DataFrame, b: DataFrame, key: str, what: str) -> None:
    assert_empty(a.select(key).join(b.select(key), key, "left_semi"), what)


def params_struct(json_text: Column) -> Column:
    return F.from_json(json_text, T.MapType(T.StringType(), T.StringType()))
