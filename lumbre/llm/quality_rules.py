"""Quality rules of a document and of its host: repeated windows, repeated lines, lines that many documents of a host share.

Line frequency across documents: lines are normalised (lower case, white space as one space, trimmed) and hashed; per host
the distinct documents that hold a line are counted; a line above the host's limit is removed from every document but the
one with the smallest id; a document that loses most of its characters that way is rejected.

Distinct documents are distinct by their whole text, so exact copies count once: copies are left to deduplication.

Defined cases: a null text counts as empty, a null host is a host of its own, a document without words fails the base rules,
rows that repeat with one id and text get one verdict each, an empty table gives an empty table.  Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumbre.llm.common import SPACE, WORD, text_of

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: A line is above the limit if so many distinct documents of its host hold it, however large the host is.
LINE_DOCS = 10
#: A document is depleted if less than so many percent of its characters are left.
MIN_LEFT_PERCENT = 20


def _pairs(values: str, gap: int, size: Column) -> Column:
    """Hash of each value with the one ``gap`` further."""
    n = F.greatest(size - gap, F.lit(0))
    return F.zip_with(F.slice(values, F.lit(1), n), F.slice(values, F.lit(gap + 1), n), lambda x, y: F.xxhash64(x, y))


def _covered(windows: str) -> Column:
    """Number of words in windows that occur twice or more; ``windows`` has one hash for each start.

    Windows are sorted by hash, so equal ones are neighbours; the length of the union of their spans is one pass over starts.
    """
    placed = F.sort_array(F.transform(F.col(windows), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    size = F.size(windows)
    none = F.array(F.lit(None).cast("struct<h:bigint,i:int>"))
    before, after = F.concat(none, F.slice(placed, F.lit(1), size - 1)), F.concat(F.slice(placed, F.lit(2), size - 1), none)
    equal = F.zip_with(F.arrays_zip(placed.alias("own"), before.alias("before")), after, lambda x, y: F.when((x["own"]["h"] == x["before"]["h"]) | (x["own"]["h"] == y["h"]), x["own"]["i"]))
    starts = F.sort_array(F.filter(equal, lambda i: i.isNotNull()))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    return F.aggregate(
        starts,
        start,
        lambda a, i: F.struct((a["n"] + i + WINDOW - F.greatest(a["end"], i.cast("long"))).alias("n"), (i + WINDOW).cast("long").alias("end")),
        lambda a: a["n"],
    )


def base_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "host") -> DataFrame:
    """_id, _host, _text, _digest and the measures of each document on its own."""
    out = docs.select(F.col(id_col).alias("_id"), F.col(host_col).cast("string").alias("_host"), text_of(text_col).alias("_text"))
    out = out.withColumn("_digest", F.xxhash64("_text"))
    out = out.withColumn("_hashes", F.transform(F.regexp_extract_all("_text", F.lit(f"({WORD})"), F.lit(1)), lambda w: F.xxhash64(w)))
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    out = out.select(
        "*",
        F.size("_hashes").cast("long").alias("n_words"),
        F.length(F.regexp_replace("_text", f"[{SPACE}]+", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        lines.alias("_lines"),
    )
    out = out.withColumn("_two", _pairs("_hashes", 1, F.size("_hashes")))
    out = out.withColumn("_four", _pairs("_two", 2, F.size("_two")))
    out = out.withColumn("_eight", _pairs("_four", 4, F.size("_four")))
    out = out.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
    repeats = F.size("_eight") > F.size(F.array_distinct("_eight"))
    out = out.withColumn("n_repeat_words", F.when(repeats, _covered("_eight")).otherwise(F.lit(0).cast("long")))
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    return out.withColumn("base_failed", failed).drop("_hashes", "_two", "_four", "_eight")


def normalised_line(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), f"[{SPACE}]+", " "))


def document_lines(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """(_id, _host, _digest, _line, _times, _chars): each distinct normalised line of each document, hashed; _chars without spaces."""
    text = text_of(text_col)
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    each = docs.select(F.col(id_col).alias("_id"), F.col(host_col).cast("string").alias("_host"), F.xxhash64(text).alias("_digest"), F.explode(F.transform(lines, normalised_line)).alias("_l"))
    return each.select("_id", "_host", "_digest", F.xxhash64("_l").alias("_line"), F.length(F.replace("_l", F.lit(" "), F.lit(""))).cast("long").alias("_chars"))


def frequent_lines(lines: DataFrame, min_docs: int = LINE_DOCS) -> DataFrame:
    """(_host, _line, _first): lines above their host's limit and the smallest id that holds them.

    A hot line or host is summed on the map side and never gathered: first by text, then by line.
    """
    texts = lines.groupBy("_host", "_line", "_digest").agg(F.min("_id").alias("_first"))
    counts = texts.groupBy("_host", "_line").agg(F.count(F.lit(1)).alias("_n"), F.min("_first").alias("_first"))
    return counts.filter(F.col("_n") >= min_docs).select("_host", "_line", "_first")


def line_frequency_verdicts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "host", min_docs: int = LINE_DOCS, min_left_percent: int = MIN_LEFT_PERCENT
) -> DataFrame:
    """One row per document: doc_id, the base measures, ``removed_chars`` and ``kept``."""
    lines = document_lines(docs, id_col, text_col, host_col)
    often = frequent_lines(lines, min_docs).select(F.col("_host").alias("_h"), F.col("_line").alias("_l"), "_first")
    # Each occurrence counts, so a line that a document repeats is removed as often.
    cut = lines.join(often, lines["_host"].eqNullSafe(often["_h"]) & (lines["_line"] == often["_l"])).filter(~F.col("_id").eqNullSafe(F.col("_first")))
    # One row of a repeated document stands for all of them.
    rows = docs.groupBy(F.col(id_col).alias("_rid"), F.xxhash64(text_of(text_col)).alias("_rdigest"), F.col(host_col).cast("string").alias("_rhost")).agg(F.count(F.lit(1)).alias("_copies"))
    lost = cut.groupBy("_id", "_digest", "_host").agg(F.sum("_chars").alias("_lost"))
    lost = lost.join(rows, lost["_id"].eqNullSafe(rows["_rid"]) & (lost["_digest"] == rows["_rdigest"]) & lost["_host"].eqNullSafe(rows["_rhost"])).select("_rid", "_rdigest", "_rhost", (F.col("_lost") / F.col("_copies")).cast("long").alias("_lost"))
    base = base_rules(docs, id_col, text_col, host_col).drop("_text", "_lines")
    both = base.join(lost, base["_id"].eqNullSafe(lost["_rid"]) & (base["_digest"] == lost["_rdigest"]) & base["_host"].eqNullSafe(lost["_rhost"]), "left")
    removed = F.coalesce(F.col("_lost"), F.lit(0).cast("long"))
    kept = ~F.col("base_failed") & ((F.col("word_chars") - removed) * 100 >= F.col("word_chars") * min_left_percent)
    return both.select(F.col("_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", removed.alias("removed_chars"), kept.alias("kept"))


def remove_frequent_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "host", min_docs: int = LINE_DOCS) -> DataFrame:
    """``docs`` with ``clean_text``: the text without lines above their host's limit, in order.

    A document's frequent lines come as an array of hashes, from one join per line and one group per document.
    """
    lines = document_lines(docs, id_col, text_col, host_col)
    often = frequent_lines(lines, min_docs).select(F.col("_host").alias("_h"), F.col("_line").alias("_l"), "_first")
    cut = lines.join(often, lines["_host"].eqNullSafe(often["_h"]) & (lines["_line"] == often["_l"])).filter(~F.col("_id").eqNullSafe(F.col("_first")))
    bad = cut.groupBy("_id", "_digest", "_host").agg(F.collect_set("_line").alias("_bad"))
    names = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(F.struct(*names).alias("_row"), F.col(id_col).alias("_rid"), F.xxhash64(text_of(text_col)).alias("_rdigest"), F.col(host_col).cast("string").alias("_rhost"), text_of(text_col).alias("_t"))
    both = rows.join(bad, rows["_rid"].eqNullSafe(bad["_id"]) & (rows["_rdigest"] == bad["_digest"]) & rows["_rhost"].eqNullSafe(bad["_host"]), "left")
    left = F.array_join(F.filter(F.split("_t", "\n"), lambda x: ~F.array_contains("_bad", F.xxhash64(normalised_line(x)))), "\n")
    return both.select("_row.*", F.when(F.col("_bad").isNull(), F.col("_t")).otherwise(left).alias("clean_text"))


SQL = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS s FROM w, unnest(range(1, len(ws) - 6)) r(i)),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM g),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat FROM c, range(8) x(k) WHERE n > 1 GROUP BY doc_id),
l AS (SELECT doc_id, source, t, line FROM d, unnest(string_split(t, chr(10))) u(line) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM l GROUP BY doc_id),
n AS (SELECT doc_id, source, t, trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS line FROM l),
often AS (SELECT source, line, min(doc_id) AS first FROM n GROUP BY source, line HAVING count(DISTINCT t) >= {LINE_DOCS}),
lost AS (SELECT doc_id, sum(length(replace(n.line, ' ', ''))) AS chars FROM n
         JOIN often o ON n.source IS NOT DISTINCT FROM o.source AND n.line = o.line WHERE doc_id <> first GROUP BY doc_id),
m AS (SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(chars, 0) AS BIGINT) AS lost
      FROM d JOIN w ON d.doc_id = w.doc_id LEFT JOIN dup ON d.doc_id = dup.doc_id LEFT JOIN r ON d.doc_id = r.doc_id LEFT JOIN lost ON d.doc_id = lost.doc_id),
b AS (SELECT *, n_words < {MIN_WORDS} OR n_repeat_words * 100 > n_words * {MAX_REPEAT_PERCENT} AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND (word_chars - lost) * 100 >= word_chars * {MIN_LEFT_PERCENT} AS kept
FROM b
"""
