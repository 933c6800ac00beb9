"""Exact deduplication with two Bloom passes.

Pass 1 counts the bit positions of all text hashes and keeps those that more than one row hits, as bitmaps.
Pass 2 tests every row against the bitmaps: a row with a position of its own is unique and passes straight through; only
rows that may repeat are shuffled and compared by the SHA-256 of their whole text.  The filter has no false negatives, so
results are exact; its size only decides how many unique rows take the long way.

Defined cases: a null text counts as empty; an empty table gives an empty table; of rows that repeat with the same id one
stays; a null id is larger than every other id, and ``keep_id`` is null where a group has no other.  Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumbre.llm.common import SPACE, shared_table, text_of

#: Bits of one bitmap row, fixed by Spark's bitmap functions.
BITMAP_BITS = 32_768
BITS_PER_ROW = 16
#: Largest filter, 32 MB as bitmaps: the proven bound of what is broadcast.
MAX_FILTER_BITS = 2**28


def normalised(text_col: str) -> Column:
    """The text with each run of white space as one space."""
    return F.regexp_replace(text_of(text_col), f"[{SPACE}]+", " ")


def _positions(digest: Column, bits: int) -> list[Column]:
    """Two bit numbers from 1 to ``bits``."""
    return [F.pmod(F.xxhash64(F.lit(seed), digest), F.lit(bits)) + 1 for seed in (1, 2)]


def _bit_is_set(bitmap: Column, position: Column) -> Column:
    offset = (position - 1) % BITMAP_BITS
    byte = F.conv(F.hex(F.substring(bitmap, F.floor(offset / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.call_function("shiftright", byte, (offset % 8).cast("int")).bitwiseAND(F.lit(1)) == 1, F.lit(False))


def repeated_positions(rows: DataFrame, bits: int) -> DataFrame:
    """(bucket, bitmap) of the bit positions that two rows or more hit; at most ``bits`` / 8 bytes in all."""
    hits = rows.select(F.explode(F.array_distinct(F.array(*_positions(F.col("_digest"), bits)))).alias("_at"))
    often = hits.groupBy("_at").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    return often.groupBy(F.expr("bitmap_bucket_number(_at)").alias("_bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(_at))").alias("_bitmap"))


def possibly_repeated(rows: DataFrame, bloom: DataFrame, bits: int) -> DataFrame:
    """``rows`` with ``_maybe``: false is certain, true has to be checked.  The filter is broadcast, bounded by ``bits``."""
    first, second = _positions(F.col("_digest"), bits)
    out = rows.withColumns({"_p1": first, "_p2": second})
    for k in (1, 2):
        side = F.broadcast(bloom.select(F.col("_bucket").alias(f"_b{k}"), F.col("_bitmap").alias(f"_m{k}")))
        out = out.join(side, F.expr(f"bitmap_bucket_number(_p{k})") == F.col(f"_b{k}"), "left")
    maybe = _bit_is_set(F.col("_m1"), F.col("_p1")) & _bit_is_set(F.col("_m2"), F.col("_p2"))
    return out.withColumn("_maybe", maybe).drop("_p1", "_p2", "_b1", "_b2", "_m1", "_m2")


def filter_bits(rows: int, bits_per_row: int = BITS_PER_ROW) -> int:
    """A power of two near ``bits_per_row`` bits for each row, within the bounds of the filter."""
    return min(MAX_FILTER_BITS, max(BITMAP_BITS, 2 ** max(1, (rows * bits_per_row - 1)).bit_length()))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits_per_row: int = BITS_PER_ROW) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, and its place ``row_no``."""
    digest = F.sha2(normalised(text_col), 256)
    rows = shared_table(docs.select(F.col(id_col).alias("doc_id"), digest.alias("_digest"), F.monotonically_increasing_id().alias("row_no")))
    bits = filter_bits(rows.count(), bits_per_row)
    marked = possibly_repeated(rows, repeated_positions(rows, bits), bits)
    alone = marked.filter("NOT _maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("_digest").alias("text_sha256"), "row_no")
    again = marked.filter("_maybe").select("doc_id", "_digest", "row_no")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("row_no").alias("row"))
    groups = again.groupBy(F.col("_digest").alias("_of")).agg(F.min(order).alias("_first"), F.count(F.lit(1)).alias("group_size"))
    checked = again.join(groups, again["_digest"] == groups["_of"]).select(
        "doc_id", F.col("_first.id").alias("keep_id"), "group_size", (F.col("row_no") == F.col("_first.row")).alias("kept"), F.col("_digest").alias("text_sha256"), "row_no"
    )
    return alone.unionByName(checked)


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits_per_row: int = BITS_PER_ROW) -> DataFrame:
    """``docs`` without repeated texts, all columns as they were.

    Rows that the filter clears go straight from the scan to the result; only the others are shuffled, whole, by their digest.
    """
    names = [F.col(f"`{c}`") for c in docs.columns]
    hashed = docs.select(F.struct(*names).alias("_row"), F.sha2(normalised(text_col), 256).alias("_digest"))
    hashes = hashed.select("_digest")
    bits = filter_bits(docs.count(), bits_per_row)
    # Only the bitmaps are kept: a few bytes for each row.
    bloom = shared_table(repeated_positions(hashes, bits))
    marked = possibly_repeated(hashed, bloom, bits)
    order = F.struct(F.col(f"_row.`{id_col}`").isNull().alias("none"), F.col(f"_row.`{id_col}`").alias("id"))
    again = marked.filter("_maybe")
    first = again.groupBy("_digest").agg(F.min_by("_row", order).alias("_row"))
    return marked.filter("NOT _maybe").select("_row.*").unionByName(first.select("_row.*"))
