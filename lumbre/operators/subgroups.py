"""Subgroup discovery: level-wise beam search for interpretable rules.

Rows are first folded into distinct patterns of matching selectors with their counts, per search key.
All levels then work on that table only, as vertical bitmaps: coverage, positives, duplicate covers and overlaps are sums
over patterns. Folds, targets, settings and permutations are keys, so all searches share each job.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumbre.functions.digests import Messages
from lumbre.functions.keys import hash_order, joined
from lumbre.operators.association import fisher_exact, melt
from lumbre.operators.covers import extension_counts, pattern_blocks
from lumbre.operators.ordered import best_row, exact_quantiles, top_rows
from lumbre.session import BROADCAST_ROW_LIMIT, ContractError, broadcast_if_small, durable

# Quantiles that give the cut points of numeric features.
CUT_QUANTILES = [0.25, 0.5, 0.75]
_COMPARE = {"==": np.equal, "<=": np.less_equal, ">": np.greater}


@dataclass(frozen=True)
class Arm:
    """One search over the rows of a search key: a target, a minimum coverage, and a depth (by default the deepest level of the search)."""

    name: str
    target: str
    min_coverage: float = 0.10
    max_depth: int | None = None


def _value_text(op: str, value: str) -> Column:
    """Whole numbers for ``==``; else six digits, without trailing zeros but at least one."""
    v = F.col(value)
    fixed = F.regexp_replace(F.round(v, 6).cast("decimal(38,6)").cast("string"), r"(\.\d+?)0+$", "$1")
    return F.when(F.col(op) == "==", v.cast("bigint").cast("string")).otherwise(fixed)


def make_selectors(train: DataFrame, keys: list[str], features: list[str], absence: bool = False, absence_features: tuple[str, ...] = ()) -> DataFrame:
    """Numbered selectors per key: ``== 1`` for 0/1 features (``== 0`` on request), ``<=`` / ``>`` at distinct quartiles else."""
    # One row per key, with one entry for each feature; it decides which features are unpivoted, and is read several times.
    x = {f: F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double")) for f in features}
    facts = [
        F.struct(
            F.lit(f).alias("feature"), F.count(v).alias("__n"), F.count_if(~v.isin(0.0, 1.0)).alias("__other"), F.max((v == 0).cast("int")).alias("__zero"), F.max((v == 1).cast("int")).alias("__one")
        )
        for f, v in x.items()
    ]
    grouped = train.groupBy(*keys) if keys else train.groupBy()
    kinds = durable(grouped.agg(F.array(*facts).alias("__f")).select(*keys, F.inline("__f")).filter("__n > 0"))
    measured = {r["feature"] for r in kinds.filter("__other > 0").select("feature").distinct().collect()}
    long = melt(train, keys, [f for f in features if f in measured] or features[:1]).filter("value is not null AND NOT isnan(value)")
    wants_zero = F.lit(absence) | F.col("feature").isin(*absence_features) if absence_features else F.lit(absence)
    values = F.array_compact(
        F.array(F.when((F.col("__zero") == 1) & wants_zero, F.lit(0.0)), F.when(F.col("__one") == 1, F.lit(1.0)))
    )
    binary = kinds.filter("__other = 0").select(*keys, "feature", F.lit("==").alias("op"), F.explode(values).alias("value"))
    numeric = long.join(kinds.filter("__other > 0").select(*keys, "feature"), [*keys, "feature"], "left_semi")
    cuts = exact_quantiles(numeric, [*keys, "feature"], "value", CUT_QUANTILES)
    cut_rows = cuts.select(*keys, "feature", F.explode(F.array_distinct("quantiles")).alias("value"))
    both = cut_rows.select(*keys, "feature", F.explode(F.array(F.lit("<="), F.lit(">"))).alias("op"), "value")
    every = binary.unionByName(both)
    # A few selectors per feature and key.
    place = W.partitionBy(*keys if keys else [F.lit(0)]).orderBy("feature", "value", F.when(F.col("op") == ">", 1).otherwise(0))
    position = F.array_position(F.array(*[F.lit(f) for f in features]), F.col("feature")).cast("int")
    return every.select(
        *keys, F.row_number().over(place).alias("idx"), "feature", position.alias("pos"), "op", "value",
        F.concat_ws(" ", "feature", "op", _value_text("op", "value")).alias("text"),
        F.concat_ws(" ", "feature", "op").alias("shape"),
        F.when(F.col("op") == "==", F.concat_ws(" ", "feature", "op", _value_text("op", "value"))).otherwise(F.concat_ws(" ", "feature", "op")).alias("shape_with_value"),
    )


def _holding(rules: list[list], kept: list[str], xs: list[str]):
    """Adds ``__held``: one bit for each selector of the row's key, set where it holds.  A missing value satisfies none."""

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = batch.column("__k").to_numpy()
            x = [pc.fill_null(batch.column(c), float("nan")).to_numpy(zero_copy_only=False) for c in xs]
            for k in np.unique(of):
                at = np.flatnonzero(of == k)
                held = np.zeros((-(-max(1, len(rules[k])) // 8) * 8, len(at)), np.uint8)
                for bit, (_, pos, op, value) in enumerate(rules[k]):
                    held[bit] = _COMPARE[op](x[pos - 1][at], value)
                packed = np.ascontiguousarray(np.packbits(held, axis=0).T)
                ends = pa.py_buffer(np.arange(0, packed.size + 1, packed.shape[1], dtype=np.int32))
                bits = pa.Array.from_buffers(pa.binary(), len(at), [None, ends, pa.py_buffer(packed)])
                rows = pa.array(at)
                yield pa.RecordBatch.from_arrays([*[batch.column(c).take(rows) for c in kept], bits], [*kept, "__held"])

    return hold


def _listing(rules: list[list], kept: list[str]):
    """The numbers of the selectors that hold, from their bits."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            patterns = []
            for k, held in zip(batch.column("__k").to_pylist(), batch.column("__held").to_pylist()):
                bits = np.unpackbits(np.frombuffer(held, np.uint8))
                patterns.append([rules[k][i][0] for i in np.flatnonzero(bits)])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(patterns, pa.list_(pa.int32()))], [*kept, "pattern"])

    return name


def make_patterns(frame: DataFrame, search: list[str], features: list[str], targets: list[str], selectors: DataFrame, selector_keys: list[str], part: Column | None = None) -> DataFrame:
    """Rows folded to (search, part, pattern of selector numbers, n, positives per target)."""
    # Selectors are a few for each feature and key: the tasks get them whole, by the number of their key.
    found = selectors.select(*selector_keys, "idx", "pos", "op", "value").collect()
    listed: dict[tuple, list] = {}
    for r in found:
        listed.setdefault(tuple(r[k] for k in selector_keys), []).append((r["idx"], r["pos"], r["op"], r["value"]))
    rules = [sorted(of) for of in listed.values()]
    types = ", ".join(f"`__key_{k}` {selectors.schema[k].dataType.simpleString()}" for k in selector_keys)
    numbers = frame.sparkSession.createDataFrame([(*key, n) for n, key in enumerate(listed)], f"{types}{', ' if types else ''}__k int")
    xs = [f"__x{i}" for i in range(len(features))]
    rows = frame.select(
        *search, (part if part is not None else F.lit("train")).alias("part"),
        *[F.col(f).cast("double").alias(x) for f, x in zip(features, xs)], *[F.col(t).cast("bigint").alias(t) for t in targets],
    )
    # One row per key.
    numbers = broadcast_if_small(numbers)
    joined = rows.join(numbers, reduce(and_, [F.col(k) == F.col(f"__key_{k}") for k in selector_keys])) if selector_keys else rows.join(F.broadcast(numbers), how="cross")
    kept = [*search, "part", *targets, "__k"]
    types = ", ".join(f"`{c}` {joined.schema[c].dataType.simpleString()}" for c in kept)
    coded = joined.select(*kept, *xs).mapInArrow(_holding(rules, kept, xs), f"{types}, __held binary")
    folded = coded.groupBy(*search, "part", "__k", "__held").agg(F.count(F.lit(1)).alias("n"), *[F.sum(t).alias(t) for t in targets])
    kept = [*search, "part", "n", *targets]
    types = ", ".join(f"`{c}` {folded.schema[c].dataType.simpleString()}" for c in kept)
    named = folded.mapInArrow(_listing(rules, kept), f"{types}, pattern array<int>").select(*search, "part", "pattern", "n", *targets)
    return named.withColumns({"__h1": F.xxhash64("pattern"), "__h2": F.xxhash64(F.lit("second"), "pattern")})


def permuted_patterns(each: DataFrame, cuts: DataFrame, ids: list[str], target: str, seed) -> DataFrame:
    """Patterns of the true labels (s = 0) and of every permutation, from one pattern per row.

    ``each`` comes from ``make_patterns`` with the ids among its keys; ``cuts`` has the largest hash of each permutation's positives.  Every task adds up
    its rows by pattern and permutation, so no row of a permutation is shuffled; sizes of patterns are the same in all permutations.
    """
    keys = [c for c in each.columns if c not in (*ids, "n", target)]
    totals = durable(each.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum(target).alias(target)))
    limits = cuts.agg(F.array_sort(F.collect_list(F.struct("permutation", "cut"))).alias("cuts"))  # one entry per permutation
    rows = each.select(*ids, "__h1", "__h2", "n").join(F.broadcast(limits), how="cross")
    copies = rows.select(*ids, "__h1", "__h2", "n", F.explode("cuts").alias("c"))
    positive = hash_order(joined(seed, F.col("c.permutation")), *[F.col(i) for i in ids]) <= F.col("c.cut")
    hits = copies.filter(positive).groupBy(F.col("c.permutation").alias("s"), "__h1", "__h2").agg(F.sum("n").alias("__hit"))
    null = totals.drop(target).join(F.broadcast(limits), how="cross").select("*", F.explode("cuts.permutation").alias("s")).drop("cuts")
    null = null.join(hits, ["s", "__h1", "__h2"], "left").withColumn(target, F.coalesce("__hit", F.lit(0).cast("bigint"))).drop("__hit")
    return totals.withColumn("s", F.lit(0)).unionByName(null)


#: Standard deviations by which a permutation's cut may miss its expected place before its rows are read again; rows of one step.
CUT_SPREAD, STEP_ROWS = 5.0, 16_384
_FULL = 2.0**64


def _near_cuts(kept: list[str], seed, spans: list[tuple[int, int, int]]):
    """(s, __p, h, n): rows of each pattern ``__p`` by permutation; those whose hash is below the span are one row without ``h``, those above have none.

    ``spans`` has (permutation, first, last) with numbers of the first 16 hex digits.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        below: dict[int, np.ndarray] = {}
        prefixes = [f"{seed}|{s}|" for s, _, _ in spans]
        for batch in batches:
            for start in range(0, batch.num_rows, STEP_ROWS):
                piece = batch.slice(start, STEP_ROWS)
                ids = [[v for v in row if v is not None] for row in zip(*[piece.column(c).to_pylist() for c in kept])]
                # A missing id leaves no part, as in ``concat_ws``.
                tails = ["|".join(row) for row in ids]
                bare = [not row for row in ids]
                messages = Messages(tails)
                p, n = piece.column("__p").to_numpy(), piece.column("n").to_numpy()
                found = []
                for k, ((s, first, last), prefix) in enumerate(zip(spans, prefixes)):
                    head, rest = messages.hashes(prefix, bare)
                    under = head < np.uint64(first)
                    sums = np.bincount(p[under], n[under]).astype(np.int64)
                    total = below.get(k)
                    if total is None or len(total) < len(sums):
                        below[k] = total = np.concatenate([total if total is not None else np.zeros(0, np.int64), np.zeros(len(sums) - (0 if total is None else len(total)), np.int64)])
                    total[: len(sums)] += sums
                    at = np.flatnonzero((head <= np.uint64(last)) & ~under)
                    if len(at):
                        found.append((np.full(len(at), s, np.int32), p[at], np.stack([head[at], rest[at]], axis=1), n[at]))
                if found:
                    s, at, h, size = (np.concatenate(c) for c in zip(*found))
                    text = [f"{a:016x}{b:016x}" for a, b in h.tolist()]
                    yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(at), pa.array(text), pa.array(size)], ["s", "__p", "h", "n"])
        for k, total in below.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), spans[k][0], np.int32)), pa.array(at), pa.nulls(len(at), pa.string()), pa.array(total[at])], ["s", "__p", "h", "n"])

    return count


def permutation_patterns(each: DataFrame, ids: list[str], target: str, seed, permutations: int, spread: float = CUT_SPREAD) -> DataFrame:
    """Patterns of the true labels (s = 0) and of every permutation, as ``permuted_patterns`` gives them, from one look at the hashes.

    ``each`` comes from ``make_patterns`` with the ids among its keys.  A permutation's cut lies near the share of positives among all hashes; a task adds
    up the rows that are surely below it by pattern and keeps only those around it, about the square root of the rows, for which the cut is then found
    exactly.  A permutation whose cut lies elsewhere is read again with a wider span.
    """
    spark = each.sparkSession
    keys = [c for c in each.columns if c not in (*ids, "n", target)]
    totals = durable(each.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum(target).alias(target)))
    size = totals.agg(F.sum("n").alias("n"), F.sum(target).alias("p")).first()
    rows, wanted = int(size["n"] or 0), int(size["p"] or 0)
    # Distinct patterns are few: their number depends on the selectors.
    numbers = durable(totals.select("__h1", "__h2").distinct().withColumn("__p", F.row_number().over(W.orderBy("__h1", "__h2")).cast("bigint") - 1))
    numbered = each.join(broadcast_if_small(numbers), ["__h1", "__h2"]).select(*[F.col(c).cast("string").alias(c) for c in ids], "__p", "n")
    types = "s int, __p long, h string, n long"
    hits, left, wide = None, list(range(1, permutations + 1)) if wanted else [], spread
    while left:
        share = wanted / rows
        reach = wide * (share * (1 - share) / rows) ** 0.5 + wide * wide / rows
        first, last = max(0, int((share - reach) * _FULL)), min(2**64 - 1, int((share + reach) * _FULL))
        if wide > 1e6:
            first, last = 0, 2**64 - 1
        near = numbered.mapInArrow(_near_cuts(ids, seed, [(s, first, last) for s in left]), types)
        near = durable(near.groupBy("s", "__p", "h").agg(F.sum("n").alias("n")))
        # Rows around a cut: about the square root of all.
        upto = near.groupBy("s", "h").agg(F.sum("n").alias("c")).withColumn("upto", F.sum("c").over(W.partitionBy("s").orderBy(F.col("h").asc_nulls_first())))
        around = upto.groupBy("s").agg(F.min(F.when(F.col("upto") >= wanted, F.struct("upto", "h"))).alias("cut"))
        cuts = around.filter("cut.h IS NOT NULL").select("s", "cut.h").collect()
        # One row for each permutation.
        table = spark.createDataFrame([(r["s"], r["h"]) for r in cuts], "s int, __cut string")
        one = near.join(F.broadcast(table), "s").filter("h IS NULL OR h <= __cut").groupBy("s", "__p").agg(F.sum("n").alias("__hit"))
        hits = one if hits is None else hits.unionByName(one)
        done = {r["s"] for r in cuts}
        left, wide = [s for s in left if s not in done], wide * 100
    null = totals.drop(target).join(broadcast_if_small(numbers), ["__h1", "__h2"]).withColumn("s", F.explode(F.sequence(F.lit(1), F.lit(permutations))))
    if hits is None:
        null = null.withColumn(target, F.lit(0).cast("bigint"))
    else:
        null = null.join(hits, ["s", "__p"], "left").withColumn(target, F.coalesce("__hit", F.lit(0).cast("bigint"))).drop("__hit")
    return totals.withColumn("s", F.lit(0)).unionByName(null.drop("__p"))


def _match(a: DataFrame, b: DataFrame, keys: list[str], rows: int | None = None) -> DataFrame:
    """Equi-join on the keys; ``b`` is broadcast when its known or counted size is small."""
    if rows is None:
        return a.join(broadcast_if_small(b), keys)
    return a.join(F.broadcast(b) if rows <= BROADCAST_ROW_LIMIT else b, keys)


def beam_search(
    patterns: DataFrame,
    selectors: DataFrame,
    search: list[str],
    selector_keys: list[str],
    arms: list[Arm],
    max_depth: int = 3,
    beam_width: int = 100,
    top_candidates: int = 100,
) -> DataFrame:
    """Best rules per (search, arm) with counts, weighted relative accuracy and rank.

    Per level: extend the beam by later selectors on unused features, keep covers of at least the
    minimum size that are not everything, one rule per distinct cover, positive accuracy only.
    """
    for arm in arms:
        if not 0 < arm.min_coverage <= 1:
            raise ContractError("min_coverage must be in (0, 1]")
    spark = patterns.sparkSession
    targets = sorted({a.target for a in arms})
    train = patterns.filter("part = 'train'")
    totals = durable(train.groupBy(*search).agg(F.sum("n").alias("n_rows"), *[F.sum(t).alias(f"__all_{t}") for t in targets]))
    n_search = totals.count()
    arm_table = spark.createDataFrame([(a.name, a.target, float(a.min_coverage)) for a in arms], "arm string, target string, min_coverage double")
    # Every search key starts each of its arms with the empty rule.
    parents = totals.select(*search, F.explode(F.array(*[F.lit(a.name) for a in arms])).alias("arm")).select(
        *search, "arm", F.array().cast("array<int>").alias("rule"), F.lit(0).alias("last"), F.array().cast("array<int>").alias("used"),
        F.lit("").alias("rule_key"), F.lit("").alias("structure_key"), F.lit("").alias("structure_value_key"), F.lit(1).alias("rank"),
    )
    by_feature = selectors.groupBy(*selector_keys, "pos").agg(F.collect_list("idx").alias("__own"))
    selector_info = selectors.select(*selector_keys, F.col("idx").alias("sel"), "pos", "text", "shape", "shape_with_value").join(by_feature, [*selector_keys, "pos"])
    # One entry per selector: the size is fixed by the features and the search keys.
    selector_info = broadcast_if_small(selector_info)
    blocks = pattern_blocks(train, search, targets)
    depths = {a.name: a.max_depth or max_depth for a in arms}
    levels: list[DataFrame] = []
    n_parents = n_search * len(arms)
    for depth in range(1, max(depths.values()) + 1):
        going = [name for name, deepest in depths.items() if deepest >= depth]
        if len(going) < len(arms):
            parents = parents.filter(F.col("arm").isin(*going))
        # Counts are shared by all arms that have the parent in their beam.
        unique_parents = parents.select(*search, "rule", "last", "used").dropDuplicates([*search, "rule"])
        counts = extension_counts(blocks, unique_parents, search, targets)
        beams = parents.select(*search, "rule", "arm", "used", "rule_key", "structure_key", "structure_value_key", F.col("rank").alias("__parent_rank"))
        long = _match(counts, beams, [*search, "rule"], n_parents)
        named = long.join(selector_info, [*selector_keys, "sel"])
        full = _match(named, totals, search, n_search).join(F.broadcast(arm_table), "arm")
        pick = F.coalesce(*[F.when(F.col("target") == t, F.col(t)) for t in targets])
        pick_all = F.coalesce(*[F.when(F.col("target") == t, F.col(f"__all_{t}")) for t in targets])
        least = F.greatest(F.lit(1), F.ceil(F.col("min_coverage") * F.col("n_rows")))
        sep = F.when(F.col("rule_key") == "", "").otherwise("|")
        kept = full.filter((F.col("n_covered") >= least) & (F.col("n_covered") < F.col("n_rows"))).select(
            *search, "arm", "target", "__parent_rank", "sel", "__c1", "__c2", "n_rows", "n_covered",
            pick.alias("n_positive_covered"), pick_all.alias("n_positive"),
            F.concat("rule", F.array("sel")).alias("rule"), F.concat("used", "__own").alias("used"),
            F.concat("rule_key", sep, "text").alias("rule_key"), F.concat("structure_key", sep, "shape").alias("structure_key"),
            F.concat("structure_value_key", sep, "shape_with_value").alias("structure_value_key"),
        )
        first = best_row(kept, [*search, "arm", "__c1", "__c2", "n_covered"], [F.col("__parent_rank"), F.col("sel")])
        coverage = F.col("n_covered") / F.col("n_rows")
        gain = F.col("n_positive_covered") / F.col("n_covered") - F.col("n_positive") / F.col("n_rows")
        scored = first.withColumns({"coverage": coverage, "wracc": coverage * gain}).filter("wracc > 0")
        order = [F.desc("wracc"), F.desc("coverage"), F.desc("rule_key")]
        ranked = top_rows(scored, [*search, "arm"], order, max(beam_width, top_candidates), "rank")
        columns = [
            *search, "arm", "target", "rule", "used", "rule_key", "structure_key", "structure_value_key", "rank",
            "n_rows", "n_covered", "n_positive", "n_positive_covered", "coverage", "wracc", F.col("sel").alias("last"),
        ]
        level = durable(ranked.select(*columns).withColumn("rule_length", F.lit(depth)))
        levels.append(level.filter(F.col("rank") <= top_candidates))
        parents = level.filter(F.col("rank") <= beam_width)
        n_parents = level.count()
        if not n_parents:
            break
    union = levels[0]
    for level in levels[1:]:
        union = union.unionByName(level)
    order = [F.desc("wracc"), F.desc("coverage"), F.col("rule_length"), F.desc("rule_key")]
    unique = best_row(union.drop("rank", "last", "used"), [*search, "arm", "rule_key"], order)
    return top_rows(unique, [*search, "arm"], order, top_candidates, "rank")


def rule_overlaps(rules: DataFrame, patterns: DataFrame, search: list[str]) -> DataFrame:
    """Jaccard of the train covers for every pair of rules of a (search, arm): at most top_candidates^2 / 2 pairs.

    The covering rules of a pattern are listed once; pairs are added up on the map side.
    """
    sized = rules.select(*search, "arm", F.col("rank"), "rule", "n_covered")
    lists = sized.groupBy(*search, "arm").agg(F.array_sort(F.collect_list(F.struct("rank", "rule", "n_covered"))).alias("__rules"))
    met = _match(patterns.filter("part = 'train'"), lists, search)
    hits = F.transform(
        F.filter("__rules", lambda r: F.forall(r["rule"], lambda i: F.array_contains("pattern", i))), lambda r: r["rank"]
    )
    covered = met.select(*search, "arm", "n", hits.alias("__hit"))
    pairs = covered.select(*search, "arm", "n", "__hit", F.explode("__hit").alias("a")).select(
        *search, "arm", "n", "a", F.explode(F.filter("__hit", lambda b: b > F.col("a"))).alias("b")
    )
    both = pairs.groupBy(*search, "arm", "a", "b").agg(F.sum("n").alias("n_both"))
    size_a = sized.select(*search, "arm", F.col("rank").alias("a"), F.col("n_covered").alias("n_a"))
    size_b = sized.select(*search, "arm", F.col("rank").alias("b"), F.col("n_covered").alias("n_b"))
    joined = both.join(size_a, [*search, "arm", "a"]).join(size_b, [*search, "arm", "b"])
    return joined.withColumn("jaccard", F.col("n_both") / (F.col("n_a") + F.col("n_b") - F.col("n_both")))


def diverse_rules(rules: DataFrame, patterns: DataFrame, search: list[str], max_rules: int = 5, max_jaccard: float = 0.80) -> DataFrame:
    """Greedy choice in rank order: skip a rule that overlaps a chosen one too much, stop at ``max_rules``."""
    close = rule_overlaps(rules, patterns, search).filter(F.col("jaccard") > max_jaccard)
    conflicts = close.groupBy(*search, "arm", F.col("b").alias("rank")).agg(F.collect_list("a").alias("__close"))
    listed = rules.select(*search, "arm", "rank").join(conflicts, [*search, "arm", "rank"], "left")
    # The list holds at most top_candidates rules per (search, arm).
    ordered = listed.groupBy(*search, "arm").agg(
        F.array_sort(F.collect_list(F.struct("rank", F.coalesce("__close", F.array().cast("array<int>")).alias("c")))).alias("__list")
    )
    chosen = F.aggregate(
        "__list",
        F.array().cast("array<int>"),
        lambda acc, r: F.when((F.size(acc) < max_rules) & ~F.arrays_overlap(r["c"], acc), F.concat(acc, F.array(r["rank"]))).otherwise(acc),
    )
    picks = ordered.select(*search, "arm", F.posexplode(chosen).alias("__p", "rank")).withColumn("choice", F.col("__p") + 1).drop("__p")
    return rules.join(picks, [*search, "arm", "rank"])


def evaluate_rules(rules: DataFrame, patterns: DataFrame, search: list[str], targets: list[str]) -> DataFrame:
    """Counts of unchanged rules on every part (train, test): the cut points stay those of the train part."""
    keys = [*search, "arm", "rule_key"]
    defs = rules.select(*keys, "target", "rule")
    met = _match(patterns, defs, search)
    hit = F.forall("rule", lambda i: F.array_contains("pattern", i))
    y = F.coalesce(*[F.when(F.col("target") == t, F.col(t)) for t in targets])
    return met.groupBy(*keys, "part").agg(
        F.sum("n").alias("n_rows"), F.sum(y).alias("n_positive"),
        F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias("n_covered"), F.coalesce(F.sum(F.when(hit, y)), F.lit(0)).alias("n_positive_covered"),
    )


def subgroup_metrics(counts: DataFrame) -> DataFrame:
    """Coverage, support, prevalences, risk difference, lift, sensitivity, accuracy gain and odds ratio from counts."""
    n, cov = F.col("n_rows").cast("double"), F.col("n_covered").cast("double")
    pos, hit = F.col("n_positive").cast("double"), F.col("n_positive_covered").cast("double")
    zero = F.lit(0.0)
    prevalence, inside = pos / F.nullif(n, zero), hit / F.nullif(cov, zero)
    a, b, c = hit, cov - hit, pos - hit
    d = n - cov - c
    proper = (cov > 0) & (cov < n)
    margin_empty = (a + c == 0) | (b + d == 0)
    odds = F.when(~proper | margin_empty, F.lit(None).cast("double")).when(b * c == 0, F.lit(float("inf"))).otherwise(a * d / F.nullif(b * c, zero))
    return counts.select(
        "*",
        (cov / F.nullif(n, zero)).alias("coverage"), (hit / F.nullif(n, zero)).alias("support"), prevalence.alias("global_prevalence"),
        inside.alias("subgroup_prevalence"), (inside - prevalence).alias("risk_difference"),
        F.when(prevalence > 0, inside / F.nullif(prevalence, zero)).alias("lift"), (hit / F.nullif(pos, zero)).alias("sensitivity"),
        F.when(cov == 0, zero).otherwise(cov / F.nullif(n, zero) * (inside - prevalence)).alias("wracc"), odds.alias("odds_ratio"),
    )


def with_one_sided_p(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """Add the exact one-sided p of a subgroup; null for an empty or full cover."""
    tables = metrics.select(
        *keys, F.col("n_positive_covered").alias("a"), (F.col("n_covered") - F.col("n_positive_covered")).alias("b"),
        (F.col("n_positive") - F.col("n_positive_covered")).alias("c"),
        (F.col("n_rows") - F.col("n_covered") - F.col("n_positive") + F.col("n_positive_covered")).alias("d"),
    ).filter("a + b > 0 AND c + d > 0")
    return metrics.join(fisher_exact(tables, keys).select(*keys, F.col("p_greater").alias("fisher_p")), keys, "left")


def stability(test_rows: DataFrame, keys: list[str], fold_keys: list[str], structure: str, total_splits: int) -> DataFrame:
    """Two levels: per fold and structure, then per structure; share of the splits that selected it."""
    per_fold = test_rows.groupBy(*keys, *fold_keys, structure).agg(
        F.min("rule_key").alias("rule_example"), F.max("wracc").alias("wracc"),
        *[F.avg(c).alias(c) for c in ("coverage", "subgroup_prevalence", "risk_difference", "lift")],
    )
    # One row per fold and structure, so the exact percentile holds few values per group.
    out = per_fold.groupBy(*keys, structure).agg(
        F.min("rule_example").alias("rule_example"), F.count(F.lit(1)).alias("folds_selected"), F.avg("wracc").alias("mean_test_wracc"),
        F.percentile("wracc", 0.5).alias("median_test_wracc"), F.avg("coverage").alias("mean_test_coverage"),
        F.avg("subgroup_prevalence").alias("mean_test_prevalence"), F.avg("risk_difference").alias("mean_test_risk_difference"), F.avg("lift").alias("mean_test_lift"),
    )
    return out.withColumn("selection_stability", F.col("folds_selected") / total_splits)


def permutation_p(observed: DataFrame, null_scores: DataFrame, keys: list[str], permutations: int) -> DataFrame:
    """Search-adjusted p per rule: (1 + null maxima at or above the observed) / (B + 1), with null mean and 95 % quantile.

    ``null_scores`` has the best accuracy gain per permutation (0 when no rule was found).
    """
    summary = null_scores.groupBy(*keys).agg(
        F.avg("max_wracc").alias("null_mean"), F.percentile("max_wracc", 0.95).alias("null_q95"), F.array_sort(F.collect_list("max_wracc")).alias("__null")
    )
    above = F.size(F.filter("__null", lambda v: v >= F.col("wracc")))
    joined = observed.join(summary, keys) if keys else observed.join(F.broadcast(summary), how="cross")
    return joined.withColumn("p_adjusted", (1 + above) / F.lit(permutations + 1.0)).drop("__null")


def consensus_class(cells: DataFrame, keys: list[str], config: str, fold_keys: list[str], n_configs: int, n_cells: int) -> DataFrame:
    """Strong: in >= 75 % of configurations and >= 50 % of cells; moderate: 50 % and 25 %; both need mean test
    gain above 0 that is positive in >= 60 % of the cells that have the rule."""
    one = cells.groupBy(*keys, config, *fold_keys).agg(F.max("wracc").alias("wracc"))
    out = one.groupBy(*keys).agg(
        F.countDistinct(config).alias("n_configs"), F.count(F.lit(1)).alias("n_cells"), F.avg("wracc").alias("mean_test_wracc"),
        F.avg((F.col("wracc") > 0).cast("double")).alias("share_positive"),
    )
    config_share, cell_share = F.col("n_configs") / n_configs, F.col("n_cells") / n_cells
    useful = (F.col("mean_test_wracc") > 0) & (F.col("share_positive") >= 0.60)
    label = (
        F.when(useful & (config_share >= 0.75) & (cell_share >= 0.50), "strong")
        .when(useful & (config_share >= 0.50) & (cell_share >= 0.25), "moderate")
        .otherwise("none")
    )
    return out.withColumns({"config_share": config_share, "cell_share": cell_share, "consensus": label})


def cut_point_stability(rules: DataFrame, selectors: DataFrame, selector_keys: list[str], keys: list[str], structure: str) -> DataFrame:
    """Median, IQR and range of the cut points of each selector of a structure over the folds."""
    parts = rules.select(*keys, *[k for k in selector_keys if k not in keys], structure, F.explode("rule").alias("idx"))
    cuts = parts.join(selectors.filter("op <> '=='").select(*selector_keys, "idx", "shape", "value"), [*selector_keys, "idx"])
    # Values per group: at most one per fold and configuration.
    q = cuts.groupBy(*keys, structure, "shape").agg(
        F.count(F.lit(1)).alias("n"), F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"),
        (F.max("value") - F.min("value")).alias("range"),
    )
    return q.select(*keys, structure, "shape", "n", F.col("q")[1].alias("median"), (F.col("q")[2] - F.col("q")[0]).alias("iqr"), "range")


def structure_stability(frame: DataFrame, features: list[str], rules: DataFrame, selectors: DataFrame, search: list[str], keys: list[str]) -> DataFrame:
    """Distribution of the Jaccard values between covers of rules that share ``keys`` but come from different searches (folds).

    Rules of all searches are applied to the same rows, and rows are folded once to the sets of rules that they match, so covers of different
    searches meet as sums over those sets.  The number of rules is a setting.
    """
    parts = rules.select(*search, *keys, "rule_key", F.explode("rule").alias("idx")).join(selectors.select(*search, "idx", "pos", "op", "value"), [*search, "idx"])
    packed = parts.groupBy(*search, *keys, "rule_key").agg(F.collect_list(F.struct("pos", "op", "value")).alias("parts"))
    names = F.struct(*search, *keys, "rule_key")
    listed = durable(packed.agg(F.array_sort(F.collect_list(F.struct(names.alias("name"), "parts"))).alias("all")))
    rows = frame.select(F.array(*[F.col(f).cast("double") for f in features]).alias("__x")).join(F.broadcast(listed), how="cross")  # one row

    def holds(s: Column) -> Column:
        x = F.element_at("__x", s["pos"])
        known = F.when(~F.isnan(x), x)
        return F.coalesce(F.when(s["op"] == "==", known == s["value"]).when(s["op"] == "<=", known <= s["value"]).otherwise(known > s["value"]), F.lit(False))

    numbered = F.transform("all", lambda r, i: F.struct(r["parts"].alias("parts"), i.alias("i")))
    matched = F.transform(F.filter(numbered, lambda r: F.forall(r["parts"], holds)), lambda r: r["i"])
    sets = durable(rows.select(matched.alias("m")).groupBy("m").agg(F.count(F.lit(1)).alias("n")))
    each = listed.select(F.posexplode("all").alias("i", "r")).select("i", "r.name.*")
    sizes = each.join(sets.select(F.explode("m").alias("i"), "n").groupBy("i").agg(F.sum("n").alias("size")), "i", "left").withColumn("size", F.coalesce("size", F.lit(0)))
    both = sets.select("n", "m", F.explode("m").alias("a")).select("n", "a", F.explode("m").alias("b")).filter("a < b").groupBy("a", "b").agg(F.sum("n").alias("n_both"))
    left = sizes.select(*keys, F.col("i").alias("a"), F.struct(*search).alias("__a"), F.col("size").alias("n_a"))
    right = sizes.select(*keys, F.col("i").alias("b"), F.struct(*search).alias("__b"), F.col("size").alias("n_b"))
    pairs = left.join(right, keys).filter("a < b AND __a <> __b").join(both, ["a", "b"], "left").withColumn("n_both", F.coalesce("n_both", F.lit(0)))
    union = F.col("n_a") + F.col("n_b") - F.col("n_both")
    overlap = pairs.select(*keys, F.when(union == 0, F.lit(1.0)).otherwise(F.col("n_both") / F.nullif(union, F.lit(0))).alias("jaccard"))
    # Pairs of a structure: at most the square of its rules.
    q = overlap.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_pairs"), F.avg("jaccard").alias("mean"), F.min("jaccard").alias("min"), F.max("jaccard").alias("max"), F.percentile("jaccard", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q")
    )
    return q.select(*keys, "n_pairs", "mean", "min", F.col("q")[0].alias("q25"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q75"), "max")


def paired_ablation(cells: DataFrame, keys: list[str], fold_keys: list[str], arm: str, base: str, other: str) -> DataFrame:
    """Mean difference of the mean test gain and win / tie / loss counts over the folds that both arms have."""
    per = cells.groupBy(*keys, *fold_keys).agg(
        F.avg(F.when(F.col(arm) == base, F.col("wracc"))).alias("a"), F.avg(F.when(F.col(arm) == other, F.col("wracc"))).alias("b")
    ).filter("a is not null AND b is not null")
    d = F.col("b") - F.col("a")
    near = F.abs(d) <= 1e-12
    return per.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_cells"), F.avg(d).alias("mean_delta"), F.count_if(~near & (d > 0)).alias("wins"), F.count_if(near).alias("ties"),
        F.count_if(~near & (d < 0)).alias("losses"),
    )


def jaccard_pairs(members: DataFrame, keys: list[str], set_col: str, id_col: str, sizes: DataFrame) -> DataFrame:
    """Jaccard of id sets within a key; ``sizes`` lists every set, so empty sets count (two empty sets: 1).

    ``sizes`` has one row per set and each key holds few sets (rules); the sets of one id are listed once.
    """
    per_id = members.groupBy(*keys, id_col).agg(F.array_sort(F.collect_set(set_col)).alias("__s"))
    both = per_id.select(*keys, "__s", F.explode("__s").alias("a")).select(
        *keys, "a", F.explode(F.filter("__s", lambda b: b > F.col("a"))).alias("b")
    ).groupBy(*keys, "a", "b").agg(F.count(F.lit(1)).alias("n_both"))
    left = sizes.select(*keys, F.col(set_col).alias("a"), F.col("size").alias("n_a"))
    right = sizes.select(*keys, F.col(set_col).alias("b"), F.col("size").alias("n_b"))
    joined = left.join(right, keys) if keys else left.join(broadcast_if_small(right), how="cross")  # sets, not rows
    pairs = joined.filter("a < b").join(both, [*keys, "a", "b"], "left").withColumn("n_both", F.coalesce("n_both", F.lit(0)))
    union = F.col("n_a") + F.col("n_b") - F.col("n_both")
    return pairs.withColumn("jaccard", F.when(union == 0, F.lit(1.0)).otherwise(F.col("n_both") / F.nullif(union, F.lit(0))))
