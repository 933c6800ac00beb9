"""Cross-validation splits as tables, in a fixed pseudo-random order, with leakage checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumbre.functions.keys import hash_order, joined
from lumbre.operators.ordered import hash_rank
from lumbre.session import ContractError, durable


def signature(labels: list[str]) -> Column:
    """Label-set signature such as ``1|0``."""
    return F.concat_ws("|", *[F.col(c).cast("int").cast("string") for c in labels])


def _counts(df: DataFrame, column: Column) -> dict[str, int]:
    """Rows per signature; one entry per label combination, so bounded by the labels."""
    return {r[0]: r[1] for r in df.groupBy(column.alias("s")).count().collect()}


def _pool_rare(column: Column, counts: dict[str, int], least: int, name: str) -> tuple[Column, dict[str, int]]:
    rare = sorted(s for s, n in counts.items() if n < least)
    if not rare:
        return column, counts
    pooled = {s: n for s, n in counts.items() if n >= least}
    pooled[name] = sum(counts[s] for s in rare)
    return F.when(column.isin(*rare), F.lit(name)).otherwise(column), pooled


def with_strata(df: DataFrame, labels: list[str], n_splits: int, out: str = "stratum") -> DataFrame:
    """Label-set strata: rare sets pooled, else label counts capped at two, else an error."""
    sets = signature(labels)
    column, counts = _pool_rare(sets, _counts(df, sets), n_splits, "rare")
    if min(counts.values()) < n_splits:
        total = F.least(sum(F.col(c).cast("int") for c in labels), F.lit(2)).cast("string")
        column, counts = _pool_rare(total, _counts(df, total), n_splits, "rare")
        if min(counts.values()) < n_splits:
            raise ContractError("not enough rows per label-set stratum")
    return df.withColumn(out, column)


def with_simple_strata(df: DataFrame, labels: list[str], out: str = "stratum") -> DataFrame:
    """Label-set strata with sets of fewer than two rows pooled."""
    column, _ = _pool_rare(signature(labels), _counts(df, signature(labels)), 2, "RARE_LABELSET")
    return df.withColumn(out, column)


def stratified_folds(df: DataFrame, ids: list[str], stratum: list[str], k: int, seed, out: str = "fold", repeat: str | None = None) -> DataFrame:
    """Fold 1..k per row: rank in hash order within the stratum, modulo k.

    Each stratum starts where the one before stopped, so both strata and folds are balanced to one row.
    """
    keys = ([repeat] if repeat else []) + stratum
    seed_col = joined(seed, F.col(repeat)) if repeat else seed
    ranked = hash_rank(df, keys, ids, seed_col, "__rank")
    sizes = df.groupBy(*keys).count()
    # One row per stratum: the window runs over the label sets of one repeat.
    before = W.partitionBy(*([repeat] if repeat else [F.lit(0)])).orderBy(*stratum).rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select(*keys, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__start"))
    fold = ((F.col("__rank") - 1 + F.col("__start")) % k + 1).cast("int")
    return ranked.join(starts, keys).withColumn(out, fold).select(*df.columns, out)


def repeated_stratified_folds(df: DataFrame, ids: list[str], stratum: str, k: int, repeats: int, seed) -> DataFrame:
    """Stratified folds for every repeat, each with its own order."""
    copies = df.withColumn("repeat", F.explode(F.array(*[F.lit(r) for r in range(repeats)])))
    return stratified_folds(copies, ids, [stratum], k, seed, repeat="repeat")


def plain_folds(df: DataFrame, ids: list[str], k: int, seed, out: str = "fold") -> DataFrame:
    ranked = hash_rank(df, [], ids, seed, "__rank")
    return ranked.withColumn(out, ((F.col("__rank") - 1) % k + 1).cast("int")).drop("__rank")


def policy_folds(df: DataFrame, ids: list[str], labels: list[str], k: int, seed, policy: str = "auto") -> DataFrame:
    """``kfold``, ``labelset_stratified`` (strict) or ``auto`` (stratified when every set has k rows)."""
    if policy == "kfold":
        return plain_folds(df, ids, k, seed)
    if policy not in ("auto", "labelset_stratified"):
        raise ContractError("policy must be auto, labelset_stratified or kfold")
    _, counts = _pool_rare(signature(labels), _counts(df, signature(labels)), 2, "RARE_LABELSET")
    least = min(counts.values()) if counts else 0
    if len(counts) >= 2 and least >= k:
        strata = with_simple_strata(df, labels, "__stratum")
        return stratified_folds(strata, ids, ["__stratum"], k, seed).drop("__stratum")
    if policy == "labelset_stratified":
        raise ContractError(f"smallest label set has {least} rows, fewer than {k} folds")
    return plain_folds(df, ids, k, seed)


def split_table(assigned: DataFrame, ids: list[str], k: int, fold: str = "fold") -> DataFrame:
    """Long (fold, split, id): a row is test in its own fold and train in all others."""
    each = F.explode(F.sequence(F.lit(1), F.lit(k))).alias("__f")
    return assigned.select(*ids, F.col(fold).alias("__own"), each).select(
        F.col("__f").alias("fold"), F.when(F.col("__own") == F.col("__f"), "test").otherwise("train").alias("split"), *ids
    )


def nested_split(assigned: DataFrame, ids: list[str], k: int, fold: str = "fold") -> DataFrame:
    """Inner folds of an outer fold are the test parts of the other outer folds."""
    pairs = F.explode(
        F.array(*[F.struct(F.lit(o).alias("fold"), F.lit(i).alias("inner_fold")) for o in range(1, k + 1) for i in range(1, k + 1) if i != o])
    ).alias("p")
    own = F.col(fold)
    role = F.when(own == F.col("p.fold"), "test_outer").when(own == F.col("p.inner_fold"), "val_inner").otherwise("train_inner")
    return assigned.select(*ids, fold, pairs).select(F.col("p.fold").alias("outer_fold"), "p.inner_fold", role.alias("split"), *ids)


def holdout(df: DataFrame, ids: list[str], stratum: str, share: float, seed, out: str = "split") -> DataFrame:
    """Stratified hold-out; without strata when there is one stratum only or one of fewer than two rows."""
    sizes = df.groupBy(stratum).count().agg(F.count(F.lit(1)).alias("strata"), F.min("count").alias("least")).first()
    keys = [stratum] if sizes["strata"] >= 2 and sizes["least"] >= 2 else []
    ranked = hash_rank(df, keys, ids, seed, "__rank", "__size")
    want = F.round(F.col("__size") * F.lit(share))
    if not keys:
        want = F.least(F.greatest(want, F.lit(1)), F.col("__size") - 1)
    return ranked.withColumn(out, F.when(F.col("__rank") <= want, "val").otherwise("train")).drop("__rank", "__size")


def group_split(df: DataFrame, group: str, share: float, seed, out: str = "split") -> DataFrame:
    """All rows of a group on one side; the share is taken over groups."""
    groups = hash_rank(df.select(group).distinct(), [], [group], seed, "__rank", "__size")
    want = F.greatest(F.lit(1), F.bround(F.col("__size") * F.lit(share)).cast("bigint"))
    sides = groups.select(group, F.when(F.col("__rank") <= want, "val").otherwise("train").alias(out))
    return df.join(sides, group)


def align_splits(splits: DataFrame, cohort_ids: DataFrame, id_col: str = "id") -> DataFrame:
    """Stored folds for the current cohort; a fold without train rows gets the complement of its test."""
    kept = splits.join(cohort_ids, id_col, "left_semi")
    # Fold numbers are settings: a short list.
    empty = [r["fold"] for r in kept.groupBy("fold").agg(F.count_if(F.col("split") == "train").alias("n")).filter("n = 0").collect()]
    tests = kept.filter("split = 'test'")
    if not empty:
        return kept.select("fold", "split", id_col)
    all_pairs = cohort_ids.select(id_col, F.explode(F.array(*[F.lit(f) for f in empty])).alias("fold"))
    train = all_pairs.join(tests, ["fold", id_col], "left_anti").withColumn("split", F.lit("train"))
    return kept.select("fold", "split", id_col).unionByName(train.select("fold", "split", id_col))


def split_violations(splits: DataFrame, cohort_ids: DataFrame, k: int, id_col: str = "id") -> DataFrame:
    """Violations of a train / test table: overlap, ids missing or extra, wrong folds, not exactly one test."""
    per = splits.groupBy("fold", id_col).agg(
        F.count_if(F.col("split") == "train").alias("train"),
        F.count_if(F.col("split") == "test").alias("test"),
        F.count_if(~F.col("split").isin("train", "test")).alias("other"),
    )
    expected = cohort_ids.select(F.col(id_col), F.explode(F.sequence(F.lit(1), F.lit(k))).alias("fold"), F.lit(1).alias("__want"))
    sides = per.join(expected, ["fold", id_col], "full")
    kind = (
        F.when(F.col("__want").isNull(), "unexpected fold or id")
        .when(F.col("train").isNull(), "id missing from fold")
        .when(F.col("other") > 0, "unknown split name")
        .when((F.col("train") > 0) & (F.col("test") > 0), "train and test overlap")
    )
    in_fold = sides.select("fold", id_col, kind.alias("violation")).filter("violation is not null")
    tests = per.groupBy(id_col).agg(F.count_if(F.col("test") > 0).alias("n")).filter("n <> 1")
    cover = tests.select(F.lit(None).cast("int").alias("fold"), id_col, F.lit("not in exactly one test fold").alias("violation"))
    return in_fold.unionByName(cover)


def assignment_violations(splits: DataFrame, cohort_ids: DataFrame, names: list[str], id_col: str = "id") -> DataFrame:
    """Violations of a one-level assignment: unknown names, id in several splits, missing or extra ids."""
    per = splits.groupBy(id_col).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.col("split").isin(*names)).alias("unknown")
    )
    sides = per.join(cohort_ids.select(id_col, F.lit(1).alias("__want")), id_col, "full")
    kind = (
        F.when(F.col("__want").isNull(), "extra id")
        .when(F.col("n").isNull(), "missing id")
        .when(F.col("unknown") > 0, "unknown split name")
        .when(F.col("n") > 1, "id in several splits")
    )
    return sides.select(id_col, kind.alias("violation")).filter("violation is not null")


def oof_violations(oof: DataFrame, cohort_ids: DataFrame, k: int, id_col: str = "id", keys: list[str] | None = None) -> DataFrame:
    """Violations of an out-of-fold table: duplicate, missing and extra ids, missing folds, for each of its ``keys`` (run, label)."""
    keys = keys or []
    per = oof.groupBy(*keys, id_col).agg(F.count(F.lit(1)).alias("n"))
    # One row: the runs and labels of the table are settings.
    listed = oof.agg(F.collect_set(F.struct(F.lit(0).alias("__one"), *keys)).alias("__keys"))
    wanted = cohort_ids.select(id_col, F.lit(1).alias("__want"))
    wanted = wanted.join(F.broadcast(listed), how="cross").select(F.explode("__keys").alias("k"), id_col, "__want").select(*[F.col(f"k.{c}").alias(c) for c in keys], id_col, "__want")
    sides = per.join(wanted, [*keys, id_col], "full")
    kind = F.when(F.col("__want").isNull(), "extra id").when(F.col("n").isNull(), "missing id").when(F.col("n") > 1, "duplicate id")
    ids = sides.select(*keys, F.col(id_col).cast("string").alias("subject"), kind.alias("violation")).filter("violation is not null")
    want = listed.select(F.explode("__keys").alias("k")).select(*[F.col(f"k.{c}").alias(c) for c in keys], F.explode(F.sequence(F.lit(1), F.lit(k))).alias("fold"))
    folds = want.join(oof.select(*keys, "fold").distinct(), [*keys, "fold"], "left_anti")
    return ids.unionByName(folds.select(*keys, F.col("fold").cast("string").alias("subject"), F.lit("missing fold").alias("violation")))


def permuted_labels(df: DataFrame, ids: list[str], label: str, permutations: int, seed, bits: str = "y_permuted") -> DataFrame:
    """Label permutations with the positive count kept: the rows of lowest hash rank become positive."""
    copies = df.select(*ids, label, F.explode(F.sequence(F.lit(1), F.lit(permutations))).alias("permutation"))
    positives = copies.groupBy("permutation").agg(F.sum(label).alias("__p"))
    ranked = hash_rank(copies, ["permutation"], ids, joined(seed, F.col("permutation")), "__rank")
    return ranked.join(positives, "permutation").select(
        *ids, "permutation", label, (F.col("__rank") <= F.col("__p")).cast("int").alias(bits)
    )


#: Hex digits by which a cell is narrowed in a round, and the rows of a cell that are put in order.
CELL_DIGITS, CELL_ROWS = 2, 10_000


def hash_cuts(pairs: DataFrame, wanted: DataFrame, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(order, cut): for each order the ``wanted``-th smallest of its hashes, from ``pairs`` (order, h) and ``wanted`` (order, wanted).

    Each task counts its hashes by order and first digits; only the cell around the wanted rank is narrowed, digit by digit, until it is small, and only its
    rows are shuffled and ordered.  ``wanted`` has one row for each order, a setting.  None wanted gives a cut below all hashes, more than there are one above.
    """
    cells = wanted.filter("wanted > 0").select("order", F.col("wanted").cast("bigint").alias("wanted"), F.lit("").alias("cell"), F.lit(0).cast("bigint").alias("before"))
    digits = 0
    while True:
        inside = pairs.join(F.broadcast(cells), "order").filter(F.startswith("h", F.col("cell")))
        digits += CELL_DIGITS
        counts = inside.groupBy("order", "wanted", "before", F.substring("h", 1, digits).alias("cell")).agg(F.count(F.lit(1)).alias("n"))
        upto = F.sum("n").over(W.partitionBy("order").orderBy("cell")) + F.col("before")
        around = counts.withColumn("upto", upto).filter((F.col("upto") >= F.col("wanted")) & (F.col("upto") - F.col("n") < F.col("wanted")))
        around = durable(around.select("order", "wanted", "cell", (F.col("upto") - F.col("n")).alias("before"), "n"))
        cells = around.drop("n")
        most = around.agg(F.max("n").alias("n")).first()["n"]
        # Rows with one and the same hash cannot be narrowed further.
        if most is None or most <= cell_rows or digits >= 32:
            break
    last = pairs.join(F.broadcast(cells), "order").filter(F.startswith("h", F.col("cell")))
    place = F.row_number().over(W.partitionBy("order").orderBy("h")) + F.col("before")
    found = last.withColumn("place", place).filter(F.col("place") == F.col("wanted")).select("order", F.col("h").alias("cut"))
    # A hash is hexadecimal: every one is above the empty text and below "g".
    return durable(wanted.join(found, "order", "left").select("order", F.when(F.col("wanted") > 0, F.coalesce("cut", F.lit("g"))).otherwise(F.lit("")).alias("cut")))


def permutation_cuts(df: DataFrame, ids: list[str], permutations: int, seed, wanted: int, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(permutation, cut): rows whose hash is at or below the cut are the permutation's positives.

    The same positives as ``permuted_labels`` gives for distinct ids, without shuffling the rows of any permutation.
    """
    hashes = df.select(F.explode(F.sequence(F.lit(1), F.lit(permutations))).alias("order"), *ids)
    hashes = hashes.select("order", hash_order(joined(seed, F.col("order")), *[F.col(i) for i in ids]).alias("h"))
    orders = df.sparkSession.range(1, permutations + 1).select(F.col("id").cast("int").alias("order"), F.lit(wanted).alias("wanted"))
    return hash_cuts(hashes, orders, cell_rows).withColumnRenamed("order", "permutation")
