"""WARC archives of pages: written by Spark's text sink, read back by verified chains of record boundaries.

A record is a header, a blank line, ``Content-Length`` bytes and two line breaks, so the sink's line separator is the record's end and
the source's line separator is the version line that starts a record.  Payloads may hold that line too: the pieces between version
lines are only *candidates*.  Each task emits, for the candidates of its byte range, where the record's successor has to start, and follows
those links inside the range.  From the start of each file, pointer jumping over the links that leave a range finds the one place where
the chain enters each range; only records on that chain are kept, and other pieces belong to the payload around them.

Of pages with equal payloads of at least ``MIN_REVISIT`` bytes, the one with the largest id is a ``response``; the others are ``revisit``
records without payload, which name it and keep the HTTP header with the payload's length.

Defined cases: a null html is an empty payload; a null id is written as an empty id and is smaller than all others; rows that repeat the
largest id of equal payloads are all responses; a null url has no target line, line breaks in a url are percent-encoded; an empty table
writes no archive, and reading none gives no rows; records after a broken link are not returned, and ``chain_ends`` names
such files; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumbre.llm.common import shared_table, text_of
from lumbre.session import broadcast_if_small

# Fixed values of the format.
MAGIC = "WARC/1.1\r\n"
BREAK = "\r\n"
BLANK = "\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Smallest payload in bytes that a revisit replaces.
MIN_REVISIT = 1000
#: Copies of a payload's row when its group is too numerous to be sent to every task: a hot payload then has that many keys.
SALT = 32
ID_PREFIX = "urn:page:"


# -- writing --------------------------------------------------------------------------------------------------------------


def with_roles(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, payload, bytes, digest, refers_to): ``refers_to`` is the page that a revisit repeats, null for responses."""
    payload = text_of(html_col)
    rows = pages.select(
        F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"), F.octet_length(payload).cast("long").alias("bytes"),
        F.sha1(payload.cast("binary")).alias("digest"), F.sha2(payload, 256).alias("equal"),
    )
    large = rows.filter(F.col("bytes") >= MIN_REVISIT)
    groups = shared_table(large.groupBy("equal").agg(F.max("page_id").alias("head"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("equal", "head"))
    side = broadcast_if_small(groups)
    if side is groups:
        salted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALT)).cast("int")).join(salted, ["equal", "salt"], "left")
    else:
        joined = rows.join(side, "equal", "left")
    refers = F.when((F.col("bytes") >= MIN_REVISIT) & ~F.col("page_id").eqNullSafe(F.col("head")), F.col("head"))
    return joined.select("page_id", "url", "payload", "bytes", "digest", refers.alias("refers_to"))


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing for a null value."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(BREAK)), F.lit(""))


def _id(page_id: Column) -> Column:
    return F.concat(F.lit(f"<{ID_PREFIX}"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def record_text(date: str) -> Column:
    """A record without the blank line that ends it, from the columns of ``with_roles``."""
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{BREAK}Content-Type: text/html; charset=utf-8{BREAK}Content-Length: "), F.col("bytes").cast("string"), F.lit(BLANK))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    header = F.concat(
        F.lit(f"{MAGIC}WARC-Type: "), F.when(revisit, "revisit").otherwise("response"), F.lit(BREAK),
        _line("WARC-Record-ID", _id(F.col("page_id"))), _line("WARC-Date", F.lit(date)), _line("WARC-Target-URI", url),
        _line("Content-Type", F.lit("application/http;msgtype=response")), _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        _line("WARC-Refers-To", F.when(revisit, _id(F.col("refers_to")))), _line("WARC-Profile", F.when(revisit, F.lit(REVISIT_PROFILE))),
        _line("Content-Length", F.octet_length(block).cast("string")),
    )
    return F.concat(header, F.lit(BREAK), block)


def write_archives(pages: DataFrame, path: str, date: str = "2020-01-01T00:00:00Z") -> None:
    """Archives under ``path``, one for each task, committed by Spark; ``date`` is the capture time of all records."""
    with_roles(pages).select(record_text(date).alias("value")).write.option("lineSep", BLANK).text(path)


# -- candidates -----------------------------------------------------------------------------------------------------------

#: Instead of a record's start: the piece belongs to none.
NO_RECORD = -1


def _scan(spark: SparkSession, path: str) -> DataFrame:
    """Pieces between version lines, in the order of the bytes of each range: file, range, file_size, value, size, to.

    ``size`` counts the piece and the version line after it; ``to`` is the distance from the piece's start to the start of its successor
    if the piece can be a record.
    """
    found = spark.read.option("lineSep", MAGIC).text(path)
    head = F.substring_index("value", BLANK, 1)
    length = F.regexp_extract(F.concat(F.lit(BREAK), head, F.lit(BREAK)), r"\r\nContent-Length: (\d{1,18})\r\n", 1)
    record = (F.instr("value", BLANK) > 0) & F.startswith(head, F.lit("WARC-Type: ")) & (length != "")
    to = F.when(record, F.octet_length(head) + 2 * len(BLANK) + len(MAGIC) + length.try_cast("long"))
    return found.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("range"), F.col("_metadata.file_size").alias("file_size"),
        F.col("value"), (F.octet_length("value") + len(MAGIC)).cast("long").alias("size"), to.alias("to"),
    )


class _Places:
    """Start of each piece relative to its range, from batch to batch; a range's pieces come one after the other."""

    def __init__(self) -> None:
        self.key, self.at = None, 0

    def of(self, batch: pa.RecordBatch) -> tuple[np.ndarray, list[tuple[tuple, int, int]]]:
        """Starts of a batch's pieces, and the (range, begin, end) runs in it."""
        keys = list(zip(batch.column("file").to_pylist(), batch.column("range").to_pylist()))
        size = batch.column("size").to_numpy()
        starts, runs, begin = np.zeros(len(keys), np.int64), [], 0
        for end in range(1, len(keys) + 1):
            if end == len(keys) or keys[end] != keys[begin]:
                if keys[begin] != self.key:
                    self.key, self.at = keys[begin], 0
                ends = self.at + np.cumsum(size[begin:end])
                starts[begin:end] = np.concatenate([[self.at], ends[:-1]])
                self.at = int(ends[-1])
                runs.append((keys[begin], begin, end))
                begin = end
        return starts, runs


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each candidate the place where its chain leaves the range, and one row for each range with its bytes."""
    places, key, starts, targets = _Places(), None, [], []

    def done():
        begin, to = np.concatenate(starts), np.concatenate(targets)
        leaves = {}
        # From the end: a successor inside the range is known before the records that lead to it.
        for s, t in zip(begin[::-1].tolist(), to[::-1].tolist()):
            if t >= 0:
                leaves[s] = leaves.get(t, t)
        n = len(leaves)
        cells = [[key[0]] * (n + 1), [key[1]] * (n + 1), [*leaves, -1], [*leaves.values(), places_end]]
        return pa.RecordBatch.from_arrays([pa.array(cells[0], pa.string()), *[pa.array(c, pa.int64()) for c in cells[1:]]], ["file", "range", "start", "leaves"])

    places_end = 0
    for batch in batches:
        begin, runs = places.of(batch)
        to = np.where(batch.column("to").is_valid().to_numpy(zero_copy_only=False), begin + pc.fill_null(batch.column("to"), 0).to_numpy(), -1)
        for run, a, b in runs:
            if run != key:
                if starts:
                    yield done()
                key, starts, targets = run, [], []
            starts.append(begin[a:b])
            targets.append(to[a:b])
            places_end = int(begin[b - 1] + batch.column("size")[b - 1].as_py())
    if starts:
        yield done()


def _entries(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(file, range, base, entry): where the chain from the file's start enters each range, relative to the range; and the chains' ends.

    ``base`` is where the range's first piece starts.  Starts count from the version line before the first record, so a file's first record
    starts at ``len(MAGIC)``.
    """
    scan = _scan(spark, path)
    sizes = scan.select("file", "file_size").distinct()
    links = shared_table(scan.select("file", "range", "size", "to").mapInArrow(_links, "file string, range long, start long, leaves long"))
    before = F.coalesce(F.sum("leaves").over(W.partitionBy("file").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranges = shared_table(links.filter("start = -1").select("file", "range", before.alias("base")))
    hops = links.filter("start >= 0").join(broadcast_if_small(ranges), ["file", "range"]).select("file", "range", "base", (F.col("base") + F.col("start")).alias("at"), (F.col("base") + F.col("leaves")).alias("to"))
    # Only places that a link from another range names, and each file's first record, can be entries.
    named = hops.select("file", F.col("to").alias("at")).distinct()
    first = ranges.select("file").distinct().select("file", F.lit(len(MAGIC)).cast("long").alias("at"))
    stops = shared_table(hops.join(named.union(first).distinct(), ["file", "at"], "left_semi"))
    jump = stops.select("file", "at", "to")
    reached, known = shared_table(first.join(stops.select("file", "at"), ["file", "at"], "left_semi")), -1
    # Every round doubles the length of the links, so the chain over n ranges takes log2(n) rounds.
    while (n := reached.count()) > known:
        known = n
        step = reached.join(jump, ["file", "at"]).select("file", F.col("to").alias("at")).join(stops.select("file", "at"), ["file", "at"], "left_semi")
        reached = shared_table(reached.union(step).distinct())
        over = jump.select("file", F.col("at").alias("to"), F.col("to").alias("_far"))
        jump = shared_table(jump.join(over, ["file", "to"]).select("file", "at", F.col("_far").alias("to")))
    entered = shared_table(stops.join(reached, ["file", "at"], "left_semi"))
    ends = sizes.join(entered.groupBy("file").agg(F.max("to").alias("to")), "file", "left").select("file", (F.col("to") == F.col("file_size") + len(MAGIC)).alias("complete"), (F.col("to") - len(MAGIC)).alias("end"), "file_size")
    entries = ranges.join(entered.select("file", "range", F.col("at").alias("entry")), ["file", "range"], "left")
    return shared_table(entries.select("file", "range", "base", (F.col("entry") - F.col("base")).alias("entry"))), ends


def chain_ends(spark: SparkSession, path: str) -> DataFrame:
    """(file, complete, end, file_size): whether each file's chain ends with the file, and else where it breaks."""
    return _entries(spark, path)[1].withColumn("complete", F.coalesce("complete", F.lit(False)))


# -- records --------------------------------------------------------------------------------------------------------------


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to each piece its start in the file and the start of the record that it belongs to: null if that began in an earlier range."""
    places, key, expected, current = _Places(), None, -1, None
    for batch in batches:
        begin, runs = places.of(batch)
        to, base, entry = (batch.column(c).to_pylist() for c in ("to", "base", "entry"))
        record: list[int | None] = []
        for run, a, b in runs:
            if run != key:
                key, expected, current = run, -1 if entry[a] is None else entry[a], None
                if begin[a] == 0 and base[a] == 0:
                    current = NO_RECORD
            for i in range(a, b):
                if begin[i] == expected:
                    current, expected = (NO_RECORD, -1) if to[i] is None else (int(begin[i]) + base[i], int(begin[i]) + to[i])
                elif begin[i] > expected >= 0:
                    # The chain breaks inside this piece.
                    current, expected = NO_RECORD, -1
                record.append(current)
        start = begin + batch.column("base").to_numpy()
        yield pa.RecordBatch.from_arrays(
            [batch.column("file"), pa.array(start, pa.int64()), pa.array(record, pa.int64()), batch.column("size"), batch.column("to"), batch.column("value")],
            ["file", "start", "record", "size", "to", "value"],
        )


def _whole_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, offset, value): the bytes of each record after its version line."""
    entries, _ = _entries(spark, path)
    scan = _scan(spark, path).withColumn("value", F.col("value").cast("binary")).drop("file_size")
    side = broadcast_if_small(entries)
    placed = scan.join(side, ["file", "range"])
    if side is entries:
        # Too many ranges to send to every task: pieces meet their range by a shuffle and are put in order again.
        order = scan.withColumn("_order", F.monotonically_increasing_id())
        placed = order.join(side, ["file", "range"]).repartition("file", "range").sortWithinPartitions("file", "range", "_order").drop("_order")
    pieces = placed.mapInArrow(_walk, "file string, start long, record long, size long, to long, value binary")
    # A head that is as long as its record says needs no other piece.  The last record of a file has no version line after it.
    whole = F.col("start").eqNullSafe(F.col("record")) & (F.col("size") == F.col("to"))
    alone = pieces.filter(whole).select("file", F.col("start").alias("offset"), "value")
    rest = pieces.filter(~whole & (F.coalesce("record", F.lit(0)) != NO_RECORD))
    # Pieces at a range's beginning belong to the last record that starts before them, if it reaches that far.
    head = F.when(F.col("start") == F.col("record"), F.struct("start", (F.col("start") + F.col("to")).alias("end")))
    rest = rest.withColumn("_head", F.last(head, True).over(W.partitionBy("file").orderBy("start").rowsBetween(W.unboundedPreceding, 0)))
    inside = rest.filter(F.col("start") < F.col("_head.end"))
    grouped = inside.groupBy("file", F.col("_head.start").alias("offset"))
    joined = grouped.agg(F.sort_array(F.collect_list(F.struct("start", "value"))).alias("of"))
    # Binary pieces are joined as text; a foreign archive's bytes outside UTF-8 are kept.
    return alone.unionByName(joined.select("file", "offset", F.array_join(F.transform("of", lambda x: x["value"].cast("string")), MAGIC).cast("binary").alias("value")))


def _field(head: Column, name: str) -> Column:
    found = F.regexp_extract(F.concat(F.lit(BREAK), head, F.lit(BREAK)), rf"\r\n{name}: ([^\r\n]*)\r\n", 1)
    return F.when(found != "", found)


def _page_id(value: Column) -> Column:
    return F.regexp_extract(value, rf"^<{ID_PREFIX}(-?\d+)>$", 1).try_cast("long")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record: file, offset, record_type, page_id, url, refers_to, payload_bytes, payload_digest, payload, intact.

    Length and digest of a response are taken from its payload; ``intact`` says that they agree with its header.  A revisit has no payload, and
    length and digest of the payload that it repeats.
    """
    text = F.col("value").cast("string")
    parsed = _whole_records(spark, path).withColumn("head", F.substring_index(text, BLANK, 1))
    length = _field(F.col("head"), "Content-Length").try_cast("int")
    parsed = parsed.withColumn("block", F.substring("value", F.octet_length("head") + len(BLANK) + 1, length)).withColumn("http", F.substring_index(F.col("block").cast("string"), BLANK, 1))
    parsed = parsed.withColumn("payload", F.substring("block", F.octet_length("http") + len(BLANK) + 1, F.octet_length("block")))
    kind, said = _field(F.col("head"), "WARC-Type"), F.regexp_extract(F.coalesce(_field(F.col("head"), "WARC-Payload-Digest"), F.lit("")), "^sha1:(.*)$", 1)
    stated = _field(F.col("http"), "Content-Length").try_cast("long")
    response = F.col("record_type") == "response"
    rows = parsed.select(
        "file", (F.col("offset") - len(MAGIC)).alias("offset"), kind.alias("record_type"), _page_id(_field(F.col("head"), "WARC-Record-ID")).alias("page_id"), _field(F.col("head"), "WARC-Target-URI").alias("url"),
        _page_id(F.coalesce(_field(F.col("head"), "WARC-Refers-To"), F.lit(""))).alias("refers_to"), "payload", said.alias("said"), stated.alias("stated"),
    )
    own = F.octet_length("payload").cast("long")
    return rows.select(
        "file", "offset", "record_type", "page_id", "url", "refers_to", F.when(response, own).otherwise(F.col("stated")).alias("payload_bytes"),
        F.when(response, F.sha1("payload")).otherwise(F.col("said")).alias("payload_digest"), F.when(response, F.col("payload")).alias("payload"),
        (~response | ((F.sha1("payload") == F.col("said")) & (own == F.col("stated")))).alias("intact"),
    )


SQL = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
q AS (SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, sha1(b) AS payload_digest, max(page_id) OVER (PARTITION BY b) AS head FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= {MIN_REVISIT} AND head <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {MIN_REVISIT} AND head <> page_id THEN head END AS refers_to FROM q
"""
