"""Order-based building blocks that never put one whole group into one task.

A plain window over ``partitionBy(key)`` sends every row of a key to one task. Here a group is
cut into buckets that follow the wanted order, the window runs per ``(key, bucket)``, and the
totals of the earlier buckets are added from a table with one row per ``(key, bucket)``.

Ranks and neighbours under a composite order go over a range sort of (key, order) instead: a key of any size lies in
neighbouring partitions, a row's place in its partition is known, and what goes from one partition to the next is one small row for each
partition and key.  Columns of the order may have any type that sorts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lumbre.functions.keys import hash_order
from lumbre.session import broadcast_if_small, durable

_EMPTY = "__all"
#: Rows of a bucket, about, and the most cut points that one expression holds.
BUCKET_ROWS, MOST_BUCKETS = 500_000, 1_024
#: Rows of a key up to which one window ranks it.
SMALL_KEY = 500_000


def _keyed(df: DataFrame, keys: list[str]) -> tuple[DataFrame, list[str]]:
    return (df, keys) if keys else (df.withColumn(_EMPTY, F.lit(0)), [_EMPTY])


def _add_bucket_offsets(df: DataFrame, keys: list[str], bucket: str, order: list[Column], values: dict[str, Column]) -> DataFrame:
    """Inclusive running totals of ``values`` plus ``total_*`` per key, given an order-following bucket.

    Key and bucket form one struct: structs with null fields still compare as equal, and window, sums
    and join all partition by it, so the rows are shuffled once.
    """
    placed = df.withColumn("__g", F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.col(bucket).alias("bucket")))
    local = W.partitionBy("__g").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    rows = placed.select("*", *[F.sum(v).over(local).alias(f"__run_{n}") for n, v in values.items()])
    sums = placed.groupBy("__g").agg(*[F.sum(v).alias(f"__sum_{n}") for n, v in values.items()])
    parts = [F.col(f"__g.k{i}") for i in range(len(keys))]
    before = W.partitionBy(*parts).orderBy("__g.bucket").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*parts)
    offsets = sums.select(
        F.col("__g").alias("__k"),
        *[F.coalesce(F.sum(f"__sum_{n}").over(before), F.lit(0)).alias(f"__off_{n}") for n in values],
        *[F.sum(f"__sum_{n}").over(whole).alias(f"total_{n}") for n in values],
    )
    joined = rows.join(offsets, F.col("__g") == F.col("__k"))
    return joined.select(
        *[F.col(c) for c in df.columns if c not in (bucket, _EMPTY)],
        *[(F.col(f"__run_{n}") + F.col(f"__off_{n}")).alias(f"cum_{n}") for n in values],
        *[F.col(f"total_{n}") for n in values],
    )


def quantile_bounds(df: DataFrame, column: str, buckets: int, relative_error: float = 0.002) -> list[float]:
    """Cut points (a bounded list) that split the rows into about equal parts."""
    probs = [i / buckets for i in range(1, buckets)]
    return df.approxQuantile(column, probs, relative_error) or []


def _bucket_of(column: Column, bounds: list[float]) -> Column:
    """Number of cut points below the value: a bucket index that follows the value order."""
    cuts = sorted(set(bounds))

    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(column > F.lit(float(cuts[middle])), search(middle + 1, high)).otherwise(search(low, middle))

    return F.when(column.isNull(), F.lit(-1)).otherwise(search(0, len(cuts)))


def running_totals(
    df: DataFrame,
    keys: list[str],
    order: str,
    values: list[str],
    bounds: list[float] | None = None,
    buckets: int = 64,
) -> DataFrame:
    """Add ``cum_v`` (running total by ascending ``order``, the row included) and ``total_v`` per key.

    ``order`` must be numeric and unique within a key, as after ``groupBy(keys, order)``.
    """
    cuts = quantile_bounds(df, order, buckets) if bounds is None else bounds
    data, ks = _keyed(df, keys)
    if not cuts:
        # The caller has checked that every key is small: one window per key is enough.
        run = W.partitionBy(*ks).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
        whole = W.partitionBy(*ks)
        return data.select(
            *df.columns, *[F.sum(v).over(run).alias(f"cum_{v}") for v in values], *[F.sum(v).over(whole).alias(f"total_{v}") for v in values]
        )
    data = data.withColumn("__bucket", _bucket_of(F.col(order).cast("double"), cuts))
    return _add_bucket_offsets(data, ks, "__bucket", [F.col(order)], {v: F.col(v) for v in values})


def bounds_if_large(df: DataFrame, order: str, keys: list[str], small: int = SMALL_KEY, buckets: int = 64) -> list[float]:
    """Cut points where a key has more than ``small`` rows, none where each is small enough for one window; the number of buckets follows the rows."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).agg(F.max("__n").alias("most"), F.sum("__n").alias("rows")).first()
    if (sizes["most"] or 0) <= small:
        return []
    count = min(MOST_BUCKETS, max(buckets, sizes["rows"] // BUCKET_ROWS))
    return quantile_bounds(df, order, count, min(0.002, 0.1 / count))


def hash_rank(df: DataFrame, keys: list[str], ids: list[str], seed, out: str = "rank", size: str | None = None) -> DataFrame:
    """Rank 1..n of every row within its key, in the fixed pseudo-random order of the seed.

    The first hex digits of the hash are the bucket: equal shares by construction.
    """
    data, ks = _keyed(df.withColumn("__h", hash_order(seed, *[F.col(c) for c in ids])), keys)
    data = data.withColumn("__bucket", F.substring("__h", 1, 3)).withColumn("__one", F.lit(1).cast("bigint"))
    ranked = _add_bucket_offsets(data, ks, "__bucket", [F.col("__h"), *[F.col(c) for c in ids]], {"rank": F.col("__one")})
    kept = [F.col(c) for c in df.columns] + [F.col("cum_rank").alias(out)]
    if size:
        kept.append(F.col("total_rank").alias(size))
    return ranked.select(*kept)


#: ``monotonically_increasing_id`` holds the partition above this many bits.
_ROW_BITS = 33


def range_sorted(df: DataFrame, keys: list[str], order: list[tuple[str, bool]]) -> DataFrame:
    """``df`` sorted by ranges of keys and order and written once, with ``__at`` (a number that follows the sort) and ``__part``.

    Rows that are equal in all these columns are spread by a row number, so no value can fill a partition.  Nulls of the order come last.
    """
    sort = [F.col(k).asc_nulls_first() for k in keys] + [F.col(c).asc_nulls_last() if up else F.col(c).desc_nulls_last() for c, up in order]
    spread = df.withColumn("__row", F.monotonically_increasing_id())
    placed = spread.repartitionByRange(*sort, F.col("__row")).sortWithinPartitions(*sort, F.col("__row")).drop("__row")
    return durable(placed.withColumn("__at", F.monotonically_increasing_id())).withColumn("__part", F.shiftright("__at", _ROW_BITS))


def _group(keys: list[str]) -> Column:
    """Keys as one struct: structs with null fields compare as equal in joins."""
    return F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]) if keys else F.struct(F.lit(0).alias("k0"))


def row_rank(df: DataFrame, keys: list[str], order: list[tuple[str, bool]], out: str = "rank", size: str | None = None) -> DataFrame:
    """Exact row number within the key under a composite order ``[(column, ascending), ...]``; ``size`` adds the number of rows of the key."""
    placed = range_sorted(df, keys, order).withColumn("__g", _group(keys))
    cuts = placed.groupBy("__g", "__part").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    # One row for each partition and key.
    whole = W.partitionBy("__g")
    before = F.sum("__n").over(whole.orderBy("__part")) - F.col("__n")
    shifts = cuts.select("__g", "__part", (before - F.col("__first") + 1).alias("__shift"), F.sum("__n").over(whole).alias("__size"))
    ranked = placed.join(broadcast_if_small(shifts), ["__g", "__part"])
    more = [F.col("__size").alias(size)] if size else []
    return ranked.select(*[F.col(c) for c in df.columns], (F.col("__at") + F.col("__shift")).cast("bigint").alias(out), *more)


def previous_value(df: DataFrame, keys: list[str], order: str, out: str = "previous") -> DataFrame:
    """Add the next smaller value of ``order`` within the key (null for the first); values must be distinct per key.

    Neighbours inside a partition are one step in its order; the last row of each partition is what the next one starts from.
    """
    placed = range_sorted(df, keys, [(order, True)]).withColumn("__g", _group(keys))
    # A partition of the range sort is a bounded group.
    local = W.partitionBy("__part").orderBy("__at")
    rows = placed.withColumns({"__near": F.lag(F.struct("__g", F.col(order).alias("v"))).over(local), "__start": F.row_number().over(local) == 1})
    ends = placed.groupBy("__part").agg(F.max_by(F.struct("__g", F.col(order).alias("v")), "__at").alias("__end"))
    # One row for each partition.
    edges = ends.select("__part", F.lag("__end").over(W.partitionBy(F.lit(0)).orderBy("__part")).alias("__edge"))
    joined = rows.join(broadcast_if_small(edges), "__part")
    near = F.when(F.col("__start"), F.col("__edge")).otherwise(F.col("__near"))
    return joined.select(*[F.col(c) for c in df.columns], F.when(near["__g"] == F.col("__g"), near["v"]).alias(out))


def running_minimum(df: DataFrame, keys: list[str], order: list[tuple[str, bool]], value: str, out: str) -> DataFrame:
    """Smallest ``value`` so far under the order within the key, the row included; a partition passes on one row for each key."""
    placed = range_sorted(df, keys, order).withColumn("__g", _group(keys))
    local = W.partitionBy("__g", "__part").orderBy("__at").rowsBetween(W.unboundedPreceding, 0)
    rows = placed.withColumn("__run", F.min(value).over(local))
    least = placed.groupBy("__g", "__part").agg(F.min(value).alias("__least"))
    earlier = F.min("__least").over(W.partitionBy("__g").orderBy("__part").rowsBetween(W.unboundedPreceding, -1))
    joined = rows.join(broadcast_if_small(least.select("__g", "__part", earlier.alias("__before"))), ["__g", "__part"])
    return joined.select(*[F.col(c) for c in df.columns], F.least("__run", "__before").alias(out))


#: Rows of one key inside the brackets of its quantiles that are put in order by one task, and cells by which a bracket is narrowed.
BRACKET_ROWS, BRACKET_CELLS = 1_000_000, 1_000


def _narrowed(data: DataFrame, ks: list[str], bracket: DataFrame, probs: list[float], limit: int) -> DataFrame:
    """``bracket`` with every bracket narrowed until it holds at most ``limit`` rows, or one value only.

    In a round the rows inside a bracket are counted by cells of equal width, with the smallest and largest value of each; the new bracket spans the cells
    that hold the wanted ranks.  Only counts are shuffled.  Keys with few rows stay as they are.
    """
    index = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(p).alias("p")) for i, p in enumerate(probs)])).alias("e")
    names = [f"__b_{k}" for k in ks]
    place = (F.col("__n") - 1) * F.col("p")
    each = bracket.filter(F.col("__n") > limit).select(*names, "__n", "__lo", "__hi", index)
    each = each.select(*names, "__n", F.col("e.i").alias("i"), F.col("e.p").alias("p"), F.get("__lo", F.col("e.i")).alias("lo"), F.get("__hi", F.col("e.i")).alias("hi"))
    open_ones = durable(each.withColumns({"first": F.floor(place), "last": F.ceil(place)}).drop("p"))
    done = []
    while not open_ones.isEmpty():
        match = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__b_{k}")) for k in ks])
        met = data.join(broadcast_if_small(open_ones), match)
        inside = (F.col("__v") >= F.col("lo")) & (F.col("__v") <= F.col("hi"))
        span = F.col("hi") - F.col("lo")
        finite = (F.abs("lo") < float("inf")) & (F.abs("hi") < float("inf")) & (span < float("inf")) & (span > 0)
        width = F.when(finite, (F.col("__v") - F.col("lo")) / F.nullif(span, F.lit(0.0)) * BRACKET_CELLS).otherwise(F.signum("__v") * F.log1p(F.abs("__v")) * 10)
        cell = F.when(F.col("__v") < F.col("lo"), F.lit(None).cast("bigint")).otherwise(F.floor(width))
        keys = [*names, "__n", "i", "lo", "hi", "first", "last"]
        counts = met.filter(F.col("__v") <= F.col("hi")).groupBy(*keys, cell.alias("cell")).agg(F.count(F.lit(1)).alias("c"), F.min("__v").alias("low"), F.max("__v").alias("high"))
        upto = F.sum("c").over(W.partitionBy(*names, "i").orderBy(F.col("low")))
        ranked = counts.withColumn("upto", upto).filter("cell IS NOT NULL")
        hit = ranked.filter((F.col("upto") > F.col("first")) & (F.col("upto") - F.col("c") <= F.col("last")))
        spans = hit.groupBy(*keys).agg(F.min("low").alias("new_lo"), F.max("high").alias("new_hi"), F.sum("c").alias("rows"))
        spans = durable(spans)
        stuck = (F.col("new_lo") == F.col("lo")) & (F.col("new_hi") == F.col("hi"))
        ready = (F.col("rows") <= limit) | (F.col("new_lo") == F.col("new_hi")) | stuck
        done.append(spans.filter(ready).select(*names, "i", F.col("new_lo").alias("lo"), F.col("new_hi").alias("hi")))
        open_ones = spans.filter(~ready).select(*names, "__n", "i", F.col("new_lo").alias("lo"), F.col("new_hi").alias("hi"), "first", "last")
    if not done:
        return bracket
    lists = reduce(DataFrame.unionByName, done).groupBy(*[F.col(n).alias(f"{n}_") for n in names]).agg(F.array_sort(F.collect_list(F.struct("i", "lo", "hi"))).alias("of"))
    joined = bracket.join(lists, reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(f"{n}_")) for n in names]), "left")
    return durable(joined.select(*names, "__n", F.coalesce("of.lo", "__lo").alias("__lo"), F.coalesce("of.hi", "__hi").alias("__hi")))


def exact_quantiles(
    df: DataFrame,
    keys: list[str],
    value: str,
    probs: list[float],
    out: str = "quantiles",
    accuracy: int = 20_000,
    limit: int = BRACKET_ROWS,
) -> DataFrame:
    """Exact linear-interpolation quantiles per key as an array, without sorting whole groups.

    A sketch brackets each quantile. Values inside a bracket stay as they are, all others collapse
    to one count per zone on the map side, so only a sliver of the rows is shuffled and ordered.
    Where the sliver of a key may still have more than ``limit`` rows, its brackets are narrowed in rounds first.
    """
    probs = sorted(probs)
    data, ks = _keyed(df.select(*keys, F.col(value).cast("double").alias("__v")).filter(F.col("__v").isNotNull() & ~F.isnan("__v")), keys)
    margin = 2.0 / accuracy
    # One sketch for both ends.
    ends = F.array(*[F.lit(max(0.0, p - margin)) for p in probs], *[F.lit(min(1.0, p + margin)) for p in probs])
    inf = float("inf")
    small = F.col("__n") <= 2 * accuracy
    bracket = data.groupBy(*ks).agg(
        F.count(F.lit(1)).alias("__n"),
        F.percentile_approx("__v", ends, accuracy).alias("__ends"),
    ).select(
        *[F.col(k).alias(f"__b_{k}") for k in ks],
        "__n",
        F.when(small, F.array(*[F.lit(-inf) for _ in probs])).otherwise(F.slice("__ends", 1, len(probs))).alias("__lo"),
        F.when(small, F.array(*[F.lit(inf) for _ in probs])).otherwise(F.slice("__ends", len(probs) + 1, len(probs))).alias("__hi"),
    )
    # One row per key, written once: its size decides whether the rows have to move to it.
    bracket = durable(bracket)
    largest = bracket.agg(F.max("__n").alias("n")).first()["n"] or 0
    if largest > 2 * accuracy and largest * 2 * margin * len(probs) > limit:
        bracket = _narrowed(data, ks, bracket, probs, limit)
    bracket = broadcast_if_small(bracket)
    match = None
    for k in ks:
        here = F.col(k).eqNullSafe(F.col(f"__b_{k}"))
        match = here if match is None else match & here
    zone = sum((F.col("__hi")[i] < F.col("__v")).cast("int") for i in range(len(probs)))
    inside = F.col("__v") >= F.coalesce(F.try_element_at(F.col("__lo"), F.col("__zone") + 1), F.lit(inf))
    zoned = data.join(bracket, match).withColumn("__zone", zone)
    collapsed = zoned.groupBy(
        *ks, "__n", "__zone", F.when(inside & (F.col("__zone") < len(probs)), F.col("__v")).alias("__x")
    ).agg(F.count(F.lit(1)).alias("__c"))
    # Group rows here: zone counts plus the few distinct values inside the brackets.
    run = W.partitionBy(*ks).orderBy("__zone", F.col("__x").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0)
    cum = collapsed.withColumn("__cum", F.sum("__c").over(run))

    def at(position: Column) -> Column:
        return F.min(F.when(F.col("__cum") > position, F.col("__x")))

    aggs = []
    for i, p in enumerate(probs):
        place = (F.col("__n") - 1) * F.lit(p)
        aggs += [at(F.floor(place)).alias(f"__a{i}"), at(F.ceil(place)).alias(f"__c{i}")]
    picked = cum.groupBy(*ks, "__n").agg(*aggs)
    values = []
    for i, p in enumerate(probs):
        place = (F.col("__n") - 1) * F.lit(p)
        part = place - F.floor(place)
        low, high = F.col(f"__a{i}"), F.col(f"__c{i}")
        values.append(F.when(part == 0, low).otherwise(low + (high - low) * part))
    return picked.select(*keys, F.col("__n").alias("n_values"), F.array(*values).alias(out))


def top_rows(df: DataFrame, keys: list[str], order: list[Column], k: int, out: str = "position") -> DataFrame:
    """First ``k`` rows per key. Spark limits each task's rows per key before the shuffle for this form."""
    window = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(window)).filter(F.col(out) <= k)


def best_row(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Best row per key under the order."""
    return top_rows(df, keys, order, 1, "__best").drop("__best")
