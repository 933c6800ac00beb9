"""Positive-unlabeled label operators and resampling, in fixed pseudo-random orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumbre.functions.keys import hash_order, joined
from lumbre.functions.numeric import clip
from lumbre.operators.ordered import hash_rank
from lumbre.session import ContractError, assert_empty, broadcast_if_small, durable

#: Copies of one row that one array holds.
PIECE = 1_000


def training_subset(df: DataFrame, target: str, none_label: str, formulation: str) -> DataFrame:
    """Clean negatives keep positives and rows without any event; the other formulations keep all rows."""
    if formulation == "supervised_clean_negatives":
        return df.filter((F.col(target) == 1) | (F.col(none_label) == 1))
    return df


def conceal_positives(df: DataFrame, keys: list[str], ids: list[str], target: str, fraction: float, seed) -> DataFrame:
    """Hide a fraction of the positives: ``y_true`` stays, ``y_observed`` becomes 0 for hidden rows.

    Hidden per key: ``max(1, floor(p * fraction + 0.5))`` but never all; none for fraction 0.
    """
    if not 0.0 <= fraction < 1.0:
        raise ContractError("fraction must be in [0, 1)")
    ranked = hash_rank(df, [*keys, target], ids, seed, "__rank", "__p")
    n_hidden = F.least(F.greatest(F.lit(1), F.floor(F.col("__p") * F.lit(fraction) + 0.5)), F.col("__p") - 1)
    hidden = ((F.col(target) == 1) & (F.col("__rank") <= n_hidden)).cast("int") if fraction else F.lit(0)
    made = ranked.withColumn("is_hidden", hidden)
    return made.select(
        *df.columns, F.col(target).alias("y_true"), "is_hidden",
        F.when(F.col("is_hidden") == 1, 0).otherwise(F.col(target)).alias("y_observed"),
    )


def concealment_violations(hidden_ids: DataFrame, train: DataFrame, test: DataFrame, id_col: str, target: str) -> DataFrame:
    """Hidden ids in the test part, outside the train part, or not positive."""
    in_test = hidden_ids.join(test.select(id_col), id_col, "left_semi").withColumn("violation", F.lit("in test part"))
    outside = hidden_ids.join(train.select(id_col), id_col, "left_anti").withColumn("violation", F.lit("outside train part"))
    not_positive = hidden_ids.join(train.filter(F.col(target) == 0).select(id_col), id_col, "left_semi").withColumn("violation", F.lit("not positive"))
    columns = [id_col, "violation"]
    return in_test.select(*columns).unionByName(outside.select(*columns)).unionByName(not_positive.select(*columns))


def label_frequency(oof: DataFrame, keys: list[str], low: float = 1e-3, empty: float | None = 1.0) -> DataFrame:
    """Elkan-Noto label frequency c: mean score of observed positives, clipped to [low, 1]; ``empty`` without positives."""
    usable = F.when((F.col("y_true") == 1) & ~F.isnan("score"), F.col("score"))
    mean = F.avg(usable)
    value = F.when(mean.isNull(), F.lit(empty)).otherwise(F.greatest(F.least(mean, F.lit(1.0)), F.lit(low)))
    return oof.groupBy(*keys).agg(value.alias("c"), F.count(usable).alias("n_positive"))


def class_prior(oof: DataFrame, keys: list[str], c_low: float = 0.05, low: float = 1e-3, high: float = 0.99, empty: str = "null") -> DataFrame:
    """Class prior: share of observed positives over c, clipped; without positives null, or an error with ``empty="error"``."""
    c = label_frequency(oof, keys, c_low, None).select(*keys, "c")
    if empty == "error":
        assert_empty(c.filter("c IS NULL"), "keys without observed positives")
    shares = oof.groupBy(*keys).agg(F.avg(F.col("y_true").cast("double")).alias("share"))
    return shares.join(c, keys).select(*keys, "c", clip(F.col("share") / F.col("c"), low, high).alias("prior"))


def adjust_scores(score: Column, c: Column) -> Column:
    return clip(score / c, 0.0, 1.0)


def pu_bags(df: DataFrame, keys: list[str], ids: list[str], target: str, bags: int, ratio: float, seed) -> DataFrame:
    """Every positive in every bag, plus ``round(p * ratio)`` unlabeled rows drawn per bag."""
    copies = df.withColumn("bag", F.explode(F.sequence(F.lit(1), F.lit(bags))))
    sizes = df.groupBy(*keys).agg(F.sum(F.col(target).cast("bigint")).alias("__p")) if keys else df.agg(F.sum(F.col(target).cast("bigint")).alias("__p"))
    ranked = hash_rank(copies.filter(F.col(target) == 0), [*keys, "bag"], ids, joined(seed, F.col("bag")), "__rank")
    # ``sizes`` has one row per key.
    with_size = ranked.join(broadcast_if_small(sizes), keys) if keys else ranked.join(F.broadcast(sizes), how="cross")
    drawn = with_size.filter(F.col("__rank") <= F.greatest(F.lit(1), F.bround(F.col("__p") * F.lit(ratio)).cast("bigint")))
    columns = [*df.columns, "bag"]
    return copies.filter(F.col(target) == 1).select(*columns).unionByName(drawn.select(*columns))


def mean_bag_scores(scores: DataFrame, ids: list[str]) -> DataFrame:
    return scores.groupBy(*ids).agg(F.avg("score").alias("score"), F.countDistinct("bag").alias("n_bags"))


def sample_negatives(df: DataFrame, ids: list[str], target: str, per_positive: float, seed) -> DataFrame:
    """All positives and the first ``positives * per_positive`` negatives in hash order."""
    positives = df.filter(F.col(target) == 1)
    size = positives.agg(F.count(F.lit(1)).alias("__p"))
    ranked = hash_rank(df.filter(F.col(target) == 0), [], ids, seed, "__rank")
    drawn = ranked.join(F.broadcast(size), how="cross").filter(F.col("__rank") <= F.col("__p") * per_positive)  # one row
    return positives.unionByName(drawn.select(*df.columns))


def oversample(df: DataFrame, keys: list[str], ids: list[str], target: str, seed, out: str = "copy") -> DataFrame:
    """Repeat minority rows until the classes are equal: whole copies first, then a hash-ordered top-up."""
    pos, neg = F.count_if(F.col(target) == 1), F.count_if(F.col(target) == 0)
    # Written once: its size is counted before the join reads it.
    sizes = durable(df.groupBy(*keys).agg(pos.alias("__p"), neg.alias("__n")) if keys else df.agg(pos.alias("__p"), neg.alias("__n")))
    ranked = hash_rank(df, [*keys, target], ids, seed, "__rank", "__size")
    # ``sizes`` has one row per key.
    both = ranked.join(broadcast_if_small(sizes), keys) if keys else ranked.join(F.broadcast(sizes), how="cross")
    goal = F.greatest("__p", "__n")
    copies = F.floor(goal / F.col("__size")) + F.when(F.col("__rank") <= goal % F.col("__size"), 1).otherwise(0)
    # One class only: nothing to balance.
    copies = F.when((F.col("__p") == 0) | (F.col("__n") == 0), F.lit(1)).otherwise(copies)
    # In pieces, so that no array holds all copies of a row.
    pieces = both.withColumn("__copies", copies.cast("bigint")).withColumn("__piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("__copies") - 1) / PIECE))))
    first, last = F.col("__piece") * PIECE + 1, F.least((F.col("__piece") + 1) * PIECE, F.col("__copies"))
    return pieces.select(*df.columns, F.explode(F.sequence(first, last)).alias(out))


def balanced_subset(df: DataFrame, ids: list[str], target: str, size: int, seed) -> DataFrame:
    """Half positives, the rest negatives, topped up from unused rows; every step in hash order."""
    ranked = hash_rank(df, [target], ids, seed, "__rank", "__size")
    counts = {r[0]: r[1] for r in df.groupBy(target).count().collect()}
    n_pos = min(size // 2, counts.get(1, 0))
    n_neg = min(size - n_pos, counts.get(0, 0))
    n_pos = min(counts.get(1, 0), size - n_neg)
    if sum(counts.values()) <= size:
        return df
    take = F.when(F.col(target) == 1, n_pos).otherwise(n_neg)
    return ranked.filter(F.col("__rank") <= take).select(*df.columns)


def first_in_hash_order(df: DataFrame, ids: list[str], n: int, seed) -> DataFrame:
    return df.orderBy(hash_order(seed, *[F.col(c) for c in ids]), *ids).limit(n)
