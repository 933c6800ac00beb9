"""Column selection, cleaning, recoding, predictor audit and target checks."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumbre.functions.numeric import any_flag, finite, number, row_sum
from lumbre.functions.text import split_labels
from lumbre.operators.association import melt
from lumbre.session import ContractError, assert_empty

# Column-name endings that mark metadata of a feature table.
METADATA_SUFFIXES = ("preproc_name", "image_path", "image_size", "image_spacing")


def drop_present(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    return df.drop(*[c for c in columns if c in df.columns])


def select_present(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    return df.select(*[c for c in columns if c in df.columns])


def drop_containing(df: DataFrame, part: str) -> DataFrame:
    return df.drop(*[c for c in df.columns if part in c])


def select_prefixes(df: DataFrame, ids: list[str], prefixes: Iterable[str]) -> DataFrame:
    starts = tuple(prefixes)
    return df.select(*ids, *[c for c in df.columns if c not in ids and c.startswith(starts)])


def _plain(name: str) -> str:
    text = unicodedata.normalize("NFKD", name.replace("﻿", ""))
    return " ".join("".join(ch for ch in text if not unicodedata.combining(ch)).lower().split())


def rename_like(df: DataFrame, target: str, *candidates: str) -> DataFrame:
    """Rename the first column that matches a candidate regardless of case, accents and blanks."""
    by_name = {_plain(c): c for c in reversed(df.columns)}
    for candidate in (target, *candidates):
        found = by_name.get(_plain(candidate))
        if found:
            return df.withColumnRenamed(found, target)
    raise ContractError(f"no column like {target}")


def _is_metadata(name: str, excluded: set[str]) -> bool:
    return name in excluded or any(name == s or name.endswith(f"_{s}") for s in METADATA_SUFFIXES)


def numeric_feature_columns(df: DataFrame, excluded: Iterable[str]) -> list[str]:
    """Feature columns with at least one numeric value, ids, labels and metadata excluded; one pass."""
    candidates = [c for c in df.columns if not _is_metadata(c, set(excluded))]
    counts = df.agg(*[F.count(number(F.col(c).cast("string"))).alias(c) for c in candidates]).first()
    return [c for c in candidates if counts[c] > 0]


def coerce_numeric(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    return df.withColumns({c: number(F.col(c)) for c in columns})


def group_flags(df: DataFrame, groups: dict[str, list[str]], drop: Iterable[str] = ()) -> DataFrame:
    """OR-groups over source flags; sources and the named descriptors are removed."""
    made = {name: any_flag([F.col(c) for c in cols if c in df.columns]) for name, cols in groups.items()}
    sources = {c for cols in groups.values() for c in cols} | set(drop)
    return drop_present(df.withColumns(made), sources - set(groups))


def selector_condition(feature: str, op: str, value: float) -> Column:
    """``==``, ``<=`` or ``>`` on a numeric feature; missing is false."""
    x = number(F.col(feature))
    conditions: dict[str, Callable[[], Column]] = {"==": lambda: x == value, "<=": lambda: x <= value, ">": lambda: x > value}
    if op not in conditions:
        raise ContractError(f"unsupported operator {op}")
    return F.coalesce(conditions[op](), F.lit(False))


def rule_condition(rule: Iterable[tuple[str, str, float]]) -> Column:
    out = F.lit(True)
    for feature, op, value in rule:
        out = out & selector_condition(feature, op, value)
    return out


def apply_rule_catalogue(df: DataFrame, ids: list[str], rules: dict[str, list[tuple[str, str, float]]]) -> DataFrame:
    """Long (rule_id, id) membership of a named rule catalogue, in one scan."""
    hits = F.array_compact(F.array(*[F.when(rule_condition(rule), F.lit(name)) for name, rule in rules.items()]))
    return df.select(*ids, F.explode(hits).alias("rule_id"))


def keep_variants(df: DataFrame, column: str, names: list[str]) -> DataFrame:
    kept = df.filter(F.col(column).isin(*names))
    if kept.isEmpty():
        raise ContractError(f"no rows for {column} in {names}")
    return kept


def split_off_only_label(df: DataFrame, label: str, others: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows whose only positive label is ``label`` are excluded; returns (kept, excluded)."""
    only = (F.coalesce(F.col(label), F.lit(0)) == 1) & (row_sum([F.col(c) for c in others]) == 0)
    return df.filter(~only), df.filter(only)


def binary_targets(df: DataFrame, targets: list[str]) -> DataFrame:
    """Coerce targets to 0/1 integers; rows with a missing target go, other values are an error."""
    coerced = coerce_numeric(df, targets).na.drop(subset=targets)
    wrong = coerced.filter(" OR ".join(f"`{t}` NOT IN (0, 1)" for t in targets))
    assert_empty(wrong.select(*targets), "targets outside 0/1")
    return coerced.withColumns({t: F.col(t).cast("int") for t in targets})


def predictor_audit(df: DataFrame, columns: list[str], min_count: int) -> DataFrame:
    """One row per candidate predictor: kept or not, reason, missing, distinct and positive counts."""
    long = melt(df.select(*[number(F.col(c)).alias(c) for c in columns]), [], columns)
    stats = long.groupBy("feature").agg(
        F.count_if(F.col("value").isNull()).alias("n_missing"),
        F.countDistinct("value").alias("n_unique"),
        F.count_if(F.col("value") == 1).alias("ones"),
        F.count_if(F.col("value") == 0).alias("zeros"),
        F.count("value").alias("present"),
    )
    is_binary = F.col("ones") + F.col("zeros") == F.col("present")
    reason = (
        F.when(F.col("present") == 0, "all_missing")
        .when(is_binary & (F.least("ones", "zeros") < min_count), "rare_binary")
        .when(~is_binary & (F.col("n_unique") < 2), "constant")
        .otherwise("kept")
    )
    return stats.select(
        "feature", (reason == "kept").cast("int").alias("kept"), reason.alias("reason"), "n_missing", "n_unique",
        F.when(is_binary, F.col("ones")).alias("n_positive"),
    )


def kept_predictors(df: DataFrame, ids: list[str], columns: list[str], min_count: int) -> DataFrame:
    kept = {r["feature"] for r in predictor_audit(df, columns, min_count).filter("kept = 1").collect()}
    return df.select(*ids, *[number(F.col(c)).alias(c) for c in columns if c in kept])


def column_health(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: nulls after removing NaN and infinities, distinct values, all-null and constant flags."""
    long = melt(df.select(*[finite(F.col(c).cast("double")).alias(c) for c in columns]), [], columns)
    stats = long.groupBy("feature").agg(
        F.count_if(F.col("value").isNull()).alias("n_null"), F.count(F.lit(1)).alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi")
    )
    return stats.select(
        "feature", "n_null",
        (F.col("n_null") == F.col("n")).cast("int").alias("all_null"),
        F.coalesce((F.col("lo") == F.col("hi")).cast("int"), F.lit(0)).alias("constant"),
        (F.col("n_null") > 0).cast("int").alias("any_null"),
    )


def complete_cases(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.na.drop(subset=columns)


def search_rows(df: DataFrame, text: str) -> DataFrame:
    """Rows in which any column contains the text, ignoring case."""
    return df.filter(F.lower(F.concat_ws(" ", *[F.col(c).cast("string") for c in df.columns])).contains(text.lower()))


def label_vocabulary(df: DataFrame, cell: str) -> list[str]:
    """Sorted labels of a multi-label column; a vocabulary, so bounded."""
    return sorted(r[0] for r in df.select(F.explode(split_labels(F.col(cell)))).distinct().collect())


def multi_hot(df: DataFrame, cell: str, vocabulary: list[str], none_name: str | None = None, prefix: str = "") -> DataFrame:
    """One 0/1 column per label, and one for "no label" when a name is given."""
    labels = split_labels(F.col(cell))
    made = {prefix + v.replace(" ", "_"): F.array_contains(labels, v).cast("int") for v in vocabulary}
    if none_name:
        made[none_name] = (F.size(labels) == 0).cast("int")
    return df.withColumns(made)


def three_state_labels(df: DataFrame, cell: str, first: str, second: str) -> tuple[DataFrame, DataFrame]:
    """Labels ``first``, ``second``, ``none`` from a multi-label cell, with signature; rows with other labels only are split off."""
    labels = split_labels(F.col(cell))
    a, b = F.array_contains(labels, first).cast("int"), F.array_contains(labels, second).cast("int")
    none = (F.size(labels) == 0).cast("int")
    made = df.select("*", a.alias(first), b.alias(second), none.alias("none")).withColumn(
        "labelset", F.concat_ws("|", *[F.col(c).cast("string") for c in (first, second, "none")])
    )
    off_target = (F.col(first) + F.col(second) + F.col("none")) == 0
    return made.filter(~off_target), made.filter(off_target)


def matched_feature_sets(clinical: DataFrame, geometry: DataFrame, key: str, predictors: list[str], measures: list[str], targets: list[str]) -> dict[str, DataFrame]:
    """Three feature sets with their targets: all rows, the rows whose measures are all known, and those with the measures as further predictors."""
    numbers = geometry.select(key, *[F.col(m).try_cast("double").alias(m) for m in measures])
    joined = clinical.select(key, *predictors, *targets).join(numbers, key, "left")
    matched = complete_cases(joined, measures)
    return {"full": joined.drop(*measures), "matched": matched.drop(*measures), "geometry": matched}


def label_mode(df: DataFrame, targets: list[str], none_label: str, mode: str) -> tuple[DataFrame, list[str]]:
    """``include_none``, ``exclude_none`` or ``derive_none`` handling of the no-event label."""
    events = [t for t in targets if t != none_label]
    if mode == "include_none":
        return df, list(targets)
    if not events:
        raise ContractError("no event labels are left")
    if mode == "exclude_none":
        return df, events
    if mode == "derive_none":
        return df.withColumn(none_label, (row_sum([F.col(e) for e in events]) == 0).cast("int")), [*events, none_label]
    raise ContractError("mode must be include_none, exclude_none or derive_none")
