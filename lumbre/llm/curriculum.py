"""Mixing sources to target weights over training time.

Targets: a share of all words is dealt to the sources by weight; no source gives more than its words times ``repeats``; what is left over
is dealt again by weight.  Each source has a schedule: its weight moves linearly over training time from 0 to 1.  The integral
of the schedule is the part of the target that is wanted by then; its inverse gives the time at which a word of the source is used.
A source's documents lie on its axis of words in an order by hash, pass after pass; a copy is taken if its middle lies below
the target, at the time of its middle.  Copies are sorted by that time.

Running sums: a source is cut into buckets by hash, windows run inside a bucket, and a bucket's beginning comes from the sums of the
buckets before it; the number of buckets follows the number of rows, so a source with a third of all rows is many tasks.
Sources are ranked by a range sort; targets take a few sums over one row per source.

Defined cases: a null text has no words; a null source is a source, the last in order; documents without words add nothing and are
used where they lie; rows that repeat are documents of their own; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lumbre.llm.common import WORD, shared_table, text_of

WEIGHTS = (5, 2, 1)
#: Weight at the start and at the end of training, by place of the source.
SCHEDULES = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))
SHARE_PERCENT = 150
REPEATS = 2
#: Rows of a bucket, about.
BUCKET_ROWS = 20_000


def ranked_sources(sizes: DataFrame) -> DataFrame:
    """Adds ``rank`` from 0 in order of ``source``, null last: a range sort, then the places before each part."""
    placed = shared_table(sizes.orderBy(F.col("source").asc_nulls_last()).withColumns({"part": F.spark_partition_id(), "place": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))
    # One number for each part of the sort.
    counts = {r["part"]: r["n"] for r in placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = sorted(counts)
    before = dict(zip(parts, itertools.accumulate([0, *(counts[p] for p in parts)])))
    offset = F.create_map(*[F.lit(x) for p in parts for x in (p, before[p])])[F.col("part")] if parts else F.lit(0)
    return placed.withColumn("rank", F.col("place") + offset).drop("part", "place")


def with_targets(sources: DataFrame, share_percent: int = SHARE_PERCENT, repeats: int = REPEATS) -> DataFrame:
    """Adds ``target`` to (source_size, weight): by weight, none above ``repeats`` times its size."""
    limit = F.col("source_size") * F.lit(float(repeats))
    level, full = None, -1
    while True:
        capped = F.lit(False) if level is None else limit <= F.col("weight") * F.lit(level)
        row = sources.agg(F.sum("source_size").alias("all"), F.sum(F.when(capped, limit)).alias("given"), F.sum(F.when(~capped, F.col("weight"))).alias("open"), F.count_if(capped).alias("full")).first()
        if row["full"] == full or not row["open"]:
            break
        full, level = row["full"], ((row["all"] or 0) * share_percent / 100 - (row["given"] or 0.0)) / row["open"]
    return sources.withColumn("target", F.least(limit, F.col("weight") * F.lit(float(level or 0.0))))


def time_of(share: Column, start: Column, end: Column) -> Column:
    """Time at which the integral of a weight that moves from ``start`` to ``end`` reaches ``share`` of its whole."""
    slope = (end - start) / (start + end)
    bottom = (1 - slope) + F.sqrt((1 - slope) * (1 - slope) + slope * share * 4)
    return F.when(bottom > 0, share * 2 / bottom).otherwise(F.lit(0.0))


def schedule_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = WEIGHTS, schedules: tuple = SCHEDULES, share_percent: int = SHARE_PERCENT, repeats: int = REPEATS
) -> DataFrame:
    """One row per row of ``docs``: doc_id, digest, size, source_size, target, taken, positions (times of its copies, in order)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_of(text_col)).alias("digest"), F.col(source_col).cast("string").alias("source"), F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long").alias("size"))
    rows = rows.withColumns({"order": F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), "row_no": F.monotonically_increasing_id()})
    rows = shared_table(rows)
    buckets = 1
    while buckets * BUCKET_ROWS < rows.count() and buckets < 2**28:
        buckets *= 2
    # A key without nulls, and the first bits of the order.
    rows = rows.withColumns({"key": F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col("source"))), "bucket": F.floor(F.conv(F.substring("order", 1, 8), 16, 10).cast("double") / (2**32 / buckets)).cast("long")})
    sums = shared_table(rows.groupBy("key", "bucket").agg(F.first("source").alias("source"), F.sum("size").alias("words")))
    sources = ranked_sources(sums.groupBy("key").agg(F.first("source").alias("source"), F.sum("words").alias("source_size")))
    pick = lambda values: F.array(*[F.lit(float(v)) for v in values])[F.col("rank") % len(values)]
    sources = sources.withColumns({"weight": pick(weights), "start": pick([s for s, _ in schedules]), "end": pick([e for _, e in schedules])})
    sources = with_targets(shared_table(sources), share_percent, repeats).drop("source")
    before = W.partitionBy("key").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    begins = sums.withColumn("begin", F.coalesce(F.sum("words").over(before), F.lit(0))).drop("source", "words").join(sources, "key")
    inside = W.partitionBy("key", "bucket").orderBy("order", F.col("doc_id").asc_nulls_last(), "row_no").rowsBetween(W.unboundedPreceding, -1)
    placed = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(begins, ["key", "bucket"])
    middles = F.transform(F.sequence(F.lit(0), F.lit(repeats - 1)), lambda k: F.col("begin") + F.col("inside") + k * F.col("source_size") + F.col("size") / 2)
    wanted = F.filter(middles, lambda m: m < F.col("target"))
    out = placed.withColumn("wanted", wanted)
    positions = F.transform("wanted", lambda m: time_of(m / F.col("target"), F.col("start"), F.col("end")))
    return out.select("doc_id", "digest", "size", "source_size", "target", (F.size("wanted") * F.col("size")).cast("long").alias("taken"), positions.alias("positions"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **settings) -> DataFrame:
    """``docs`` in training order: a row for each copy that is taken, all columns as they were."""
    plan = schedule_documents(docs, id_col, text_col, source_col, **settings)
    plan = plan.groupBy(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest")).agg(F.flatten(F.collect_list("positions")).alias("_positions"))
    key = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(id_col).alias("_did"), F.xxhash64(text_of(text_col)).alias("_ddigest"))
    # Rows that repeat have their copies together on one of them.
    one = key.dropDuplicates(["_did", "_ddigest"])
    both = one.join(plan, one["_did"].eqNullSafe(plan["_id"]) & (one["_ddigest"] == plan["_digest"]))
    return both.select("_row", F.explode("_positions").alias("_at")).orderBy("_at", F.col(f"_row.`{id_col}`")).select("_row.*")


_SHARE_SQL = "((before + e * source_size + size / 2.0) / target)"
_BOTTOM_SQL = f"((1 - slope) + sqrt((1 - slope) * (1 - slope) + slope * {_SHARE_SQL} * 4))"
_TIME_SQL = f"CASE WHEN {_BOTTOM_SQL} > 0 THEN {_SHARE_SQL} * 2 / {_BOTTOM_SQL} ELSE 0 END"
SQL = rf"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                  md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS o FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
             CAST([{", ".join(map(str, WEIGHTS))}][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)}] AS DOUBLE) AS weight,
             CAST([{", ".join(str(s) for s, _ in SCHEDULES)}][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(SCHEDULES)}] AS DOUBLE) AS first_weight,
             CAST([{", ".join(str(e) for _, e in SCHEDULES)}][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(SCHEDULES)}] AS DOUBLE) AS last_weight FROM d GROUP BY source),
r AS (SELECT *, {REPEATS}.0 * source_size / weight AS full_at, {REPEATS}.0 * source_size AS most FROM s),
-- Level for each number of sources that are full, in the order in which they fill; the right one is the first that fills no more.
f AS (SELECT *, row_number() OVER (ORDER BY full_at, source) AS k,
             coalesce(sum(most) OVER (ORDER BY full_at, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS given,
             sum(weight) OVER (ORDER BY full_at DESC, source DESC) AS open FROM r),
l AS (SELECT *, ((SELECT sum(source_size) FROM s) * {SHARE_PERCENT}.0 / 100 - given) / open AS level FROM f),
level AS (SELECT level FROM l WHERE full_at > level OR k = (SELECT max(k) FROM l) ORDER BY k LIMIT 1),
t AS (SELECT source, source_size, least(CAST(most AS DOUBLE), weight * CAST(level AS DOUBLE)) AS target, (last_weight - first_weight) / (first_weight + last_weight) AS slope FROM r, level),
c AS (SELECT d.*, source_size, target, slope, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY o, doc_id NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (SELECT count(*) FROM range({REPEATS}) x(e) WHERE before + e * source_size + size / 2.0 < target) AS BIGINT) AS taken,
       round((SELECT min({_TIME_SQL}) FROM range({REPEATS}) x(e) WHERE before + e * source_size + size / 2.0 < target), 9) AS first_position,
       round((SELECT max({_TIME_SQL}) FROM range({REPEATS}) x(e) WHERE before + e * source_size + size / 2.0 < target), 9) AS last_position
FROM c
"""
