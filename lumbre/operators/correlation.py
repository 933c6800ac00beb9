"""Pairwise-complete Pearson correlation of many numeric columns.

Each task multiplies its Arrow batches into one small matrix of sums, so a row is read once and
nothing of size rows x pairs is ever produced.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumbre.operators.ordered import top_rows

#: Columns of a tile. A wider table is read once for each pair of tiles, two tiles' columns at a time.
TILE = 512

_SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")


def correlation_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """(i, j, feature_a, feature_b, n, r) for all pairs i < j in column order; values that are not finite count as missing."""
    numeric = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    # One mean per column; used as a shift so that the sums stay well conditioned.
    finite = lambda c: ~F.isnan(c) & (F.abs(c) != float("inf"))
    centre = numeric.agg(*[F.avg(F.when(finite(c), F.col(c))).alias(c) for c in columns]).first()
    shift = np.array([centre[c] if centre[c] is not None else 0.0 for c in columns])
    starts = range(0, len(columns), TILE)
    tiles = [(a, b) for a in starts for b in starts if a <= b]
    summed = [_tile_sums(numeric, columns, shift, a, b) for a, b in tiles]
    schema = "i int, j int, " + ", ".join(f"{n} double" for n in _SUMS)
    each = reduce(DataFrame.unionByName, summed) if summed else df.sparkSession.createDataFrame([], schema)
    pooled = each.groupBy("i", "j").agg(*[F.sum(n).alias(n) for n in _SUMS])
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")
    spread = (F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n")) * (F.col("syy") - F.col("sy") * F.col("sy") / F.col("n"))
    names = F.array(*[F.lit(c) for c in columns])
    return pooled.filter("n > 0").select(
        "i", "j",
        F.element_at(names, F.col("i") + 1).alias("feature_a"),
        F.element_at(names, F.col("j") + 1).alias("feature_b"),
        F.col("n").cast("bigint").alias("n"),
        F.when(spread > 0, cov / F.sqrt(F.abs(spread))).alias("r"),
    )


def _tile_sums(numeric: DataFrame, columns: list[str], shift: np.ndarray, a: int, b: int) -> DataFrame:
    """Sums of each task over the pairs of the tiles that begin at ``a`` and ``b``; only their columns are read."""
    left, right = columns[a : a + TILE], columns[b : b + TILE] if b > a else []
    width = len(left)
    upper_i, upper_j = np.triu_indices(width, 1) if not right else (x.ravel() for x in np.meshgrid(range(width), range(width, width + len(right)), indexing="ij"))
    number = np.array([*range(a, a + width), *range(b, b + len(right))])
    moved = shift[number]

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for batch in batches:
            x = batch.to_numpy(dtype=float) - moved
            m = np.isfinite(x).astype(float)
            x = np.where(m > 0, x, 0.0)
            part = [m.T @ m, x.T @ m, m.T @ x, (x * x).T @ m, m.T @ (x * x), x.T @ x]
            total = part if total is None else [a + b for a, b in zip(total, part)]
        if total is not None:
            yield pd.DataFrame(
                {"i": number[upper_i], "j": number[upper_j], **{name: t[upper_i, upper_j] for name, t in zip(_SUMS, total)}}
            )

    return numeric.select(*left, *right).mapInPandas(sums, "i int, j int, " + ", ".join(f"{n} double" for n in _SUMS))


def redundant_columns(pairs: DataFrame, limit: float = 0.95) -> DataFrame:
    """Later column of every pair with ``abs(r)`` at or above the limit."""
    return pairs.filter(F.abs("r") >= limit).groupBy(F.col("feature_b").alias("feature")).agg(
        F.count(F.lit(1)).alias("n_partners"), F.max(F.abs("r")).alias("max_abs_r")
    )


def perfect_duplicates(pairs: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """Columns with perfect correlation to an earlier column, which is the one that stays."""
    return pairs.filter(F.abs("r") >= 1 - tolerance).groupBy(F.col("feature_b").alias("feature")).agg(
        F.min_by("feature_a", "i").alias("kept_instead")
    )


def mean_abs_correlation(pairs: DataFrame) -> DataFrame:
    """Mean absolute correlation of each column with all others."""
    sides = pairs.select(F.explode(F.array("feature_a", "feature_b")).alias("feature"), F.abs("r").alias("a"))
    return sides.groupBy("feature").agg(F.avg("a").alias("mean_abs_r"), F.count("a").alias("n_pairs"))


def pair_distribution(pairs: DataFrame, width: float = 0.1) -> DataFrame:
    """Number of pairs per band of absolute correlation."""
    band = F.least(F.floor(F.abs("r") / width), F.lit(int(round(1 / width)) - 1)).cast("int")
    return pairs.filter("r is not null").groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n_pairs"))


def label_correlation(pairs: DataFrame, labels: list[str]) -> DataFrame:
    """(label, feature, r) from a pair table that includes the labels as columns."""
    a_is, b_is = F.col("feature_a").isin(*labels), F.col("feature_b").isin(*labels)
    return pairs.filter(a_is != b_is).select(
        F.when(a_is, F.col("feature_a")).otherwise(F.col("feature_b")).alias("label"),
        F.when(a_is, F.col("feature_b")).otherwise(F.col("feature_a")).alias("feature"),
        "r", "n",
    )


def top_label_features(pairs: DataFrame, labels: list[str], k: int) -> DataFrame:
    """The k features with the largest absolute correlation per label."""
    table = label_correlation(pairs, labels).filter("r is not null")
    return top_rows(table, ["label"], [F.abs("r").desc(), F.col("feature")], k, "rank")
