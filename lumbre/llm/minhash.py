"""Near-duplicate detection with b-bit MinHash.

1. One scan makes, for each document, its shingle set's size and hash, the hashes of its bands of minima, and the low two bits
   of every minimum, packed.  Documents with one and the same set become one node.
2. Nodes that share a band are candidates.  Within a band's bucket every node meets the bucket's first node; pairs whose
   similarity, estimated from equal bits and corrected for chance, is near the threshold or above are confirmed on full sets, unless
   their parity bits prove that they differ too much.
3. What the confirmed links leave apart is compared across components, again within buckets, so that no link between
   components is lost; a bucket's largest part, joined by then, is never paired with itself.
4. Components are found by star steps over the links.

With 48 bands of 6 minima a pair at the threshold of 0.8 is missed with a chance of 5e-7; the estimate's slack is more
than five standard deviations.  Lower similarities need more bands (parameters).

Defined cases: a null or empty text, or one without words, has an empty set and is linked with nothing; rows that repeat are
linked as equal texts; a null id never names a component that has another id; an empty table gives an empty table.
Only the id and the text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumbre.llm.common import shared_table, text_of
from lumbre.llm.components import components
from lumbre.llm.shingles import BASE, mix, shingle_set

BANDS, ROWS = 48, 6
#: How far below the threshold an estimate may be and still be confirmed on full sets.
SLACK = 0.16
#: Bits that shingles toggle.  Two sets differ in at least as many shingles as these bits differ, which bounds their similarity from above.
PARITY_BITS = 2048
SIGNATURE = "doc_id {id}, digest long, row_no long, n_shingles long, set_1 long, set_2 long, bands array<long>, low array<long>, high array<long>, parity array<long>"


def minima(shingles: np.ndarray, count: int) -> np.ndarray:
    """``count`` minima of 32-bit hashes of the shingles."""
    random = np.random.Generator(np.random.PCG64(7))
    factors = random.integers(0, 2**32, count, dtype=np.uint32) | np.uint32(1)
    terms = random.integers(0, 2**32, count, dtype=np.uint32)
    least = np.full(count, 2**32 - 1, np.uint32)
    values = (mix(shingles) >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(values), 2048):
        part = values[at : at + 2048, None]
        hashed = part * factors[None, :] + terms[None, :]
        hashed ^= hashed >> np.uint32(15)
        hashed *= np.uint32(0x2C1B3C6D)
        np.minimum(least, hashed.min(axis=0), out=least)
    return least


def _longs(bits: np.ndarray) -> list[int]:
    packed = np.packbits(bits.astype(bool))
    return np.frombuffer(np.pad(packed, (0, -len(packed) % 8)).tobytes(), np.int64).tolist()


def signature(text: bytes, words: int, bands: int, rows: int) -> tuple:
    """(size, two hashes of the set, band hashes, packed lowest bits, packed second bits, parity bits)."""
    shingles = shingle_set(text, words)
    if not len(shingles):
        return 0, 0, 0, [], [], [], []
    least = minima(shingles, bands * rows)
    bucket = np.arange(bands, dtype=np.uint64)
    for column in least.reshape(bands, rows).T:
        bucket = mix(bucket * BASE + column.astype(np.uint64))
    sums = mix(shingles).sum(dtype=np.uint64), mix(shingles * BASE).sum(dtype=np.uint64)
    return len(shingles), *(int(x.astype(np.int64)) for x in sums), bucket.astype(np.int64).tolist(), _longs(least & 1), _longs(least & 2), _longs(np.bincount((shingles % np.uint64(PARITY_BITS)).astype(np.int64), minlength=PARITY_BITS) & 1)


def _signatures(words: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                made = [signature((x.as_py() or "").encode(), words, bands, rows) for x in part["text"]]
                columns = list(zip(*made))
                arrays = [pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 3 + [pa.list_(pa.int64())] * 4)]
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["digest"], part["row_no"], *arrays], ["doc_id", "digest", "row_no", "n_shingles", "set_1", "set_2", "bands", "low", "high", "parity"])

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [shingle_set((x.as_py() or "").encode(), words).astype(np.int64) for x in part["text"]]
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part["node"], pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))], ["node", "shingles"])

    return run


def similar_bits(longs: int, count: int) -> Column:
    """Similarity from the packed bits of sides a and b: equal pairs of bits, corrected for equality by chance."""
    apart = sum((F.bit_count((F.col("a_low")[k].bitwiseXOR(F.col("b_low")[k])).bitwiseOR(F.col("a_high")[k].bitwiseXOR(F.col("b_high")[k]))) for k in range(longs)), F.lit(0))
    chance = 0.25
    return (1 - apart / count - chance) / (1 - chance)


def can_reach(percent: int) -> Column:
    """False if the parity bits of sides a and b prove their similarity lower than ``percent``."""
    apart = sum((F.bit_count(F.col("a_parity")[k].bitwiseXOR(F.col("b_parity")[k])) for k in range(PARITY_BITS // 64)), F.lit(0))
    both = F.col("a_n") + F.col("b_n")
    return (both - apart) * 100 >= (both + apart) * percent


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, threshold_percent: int = 80, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """One row per row of ``docs``: doc_id, digest (xxhash64 of the text), n_shingles, component_id, kept (one row per component)."""
    count, longs = bands * rows, -(-bands * rows // 64)
    plain = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).withColumn("digest", F.xxhash64("text"))
    id_type = plain.schema["doc_id"].dataType.simpleString()
    signed = shared_table(plain.withColumn("row_no", F.monotonically_increasing_id()).mapInArrow(_signatures(words, bands, rows), SIGNATURE.format(id=id_type)))
    full = signed.filter("n_shingles > 0")
    classes = full.groupBy("set_1", "set_2", "n_shingles").agg(F.min("row_no").alias("node"))
    nodes = full.join(classes.select("node"), full["row_no"] == F.col("node"), "left_semi").withColumnRenamed("row_no", "node")

    bits = nodes.select("node", "n_shingles", "low", "high", "parity")
    side = {s: bits.select(F.col("node").alias(s), F.col("n_shingles").alias(f"{s}_n"), F.col("low").alias(f"{s}_low"), F.col("high").alias(f"{s}_high"), F.col("parity").alias(f"{s}_parity")) for s in "ab"}
    sizes_fit = F.least("a_n", "b_n") * 100 >= F.greatest("a_n", "b_n") * threshold_percent
    near = sizes_fit & (similar_bits(longs, count) >= threshold_percent / 100 - SLACK) & can_reach(threshold_percent)

    each = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = each.groupBy(F.col("bucket").alias("of")).agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = shared_table(each.join(shared, each["bucket"] == shared["of"]).select("bucket", "node", "first"))

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) whose full sets are as similar as asked."""
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        keys = nodes.join(wanted, "node").select("node", F.col("doc_id").alias("k_id"), F.col("digest").alias("k_digest"))
        texts = plain.join(keys, plain["digest"] == keys["k_digest"]).filter(F.col("doc_id").eqNullSafe(F.col("k_id"))).dropDuplicates(["node"]).select("node", "text")
        sets = texts.mapInArrow(_sets(words), "node long, shingles array<long>")
        sets = shared_table(sets)
        both = pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("s_b")), "b").join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("s_a")), "a")
        common = F.size(F.array_intersect("s_a", "s_b"))
        return both.withColumn("common", common).filter(F.col("common") * 100 >= (F.size("s_a") + F.size("s_b") - F.col("common")) * threshold_percent).select("a", "b")

    first = members.filter("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()
    first = shared_table(first.join(side["b"], "b").join(side["a"], "a").filter(near).select("a", "b"))
    links = components(confirmed(first)).select(F.col("node").alias("a"), F.col("component").alias("b"))
    links = shared_table(links)

    labelled = members.join(links.select(F.col("a").alias("node"), F.col("b").alias("component")), "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component"))
    apart = labelled.groupBy(F.col("bucket").alias("of")).agg(F.min("component").alias("main"), F.max("component").alias("last")).filter("main < last")
    open_members = shared_table(labelled.join(apart, labelled["bucket"] == apart["of"]).select("bucket", "node", "component", "main").join(bits, "node"))
    left, right = (open_members.select(F.col("bucket").alias(f"{s}_bucket"), F.col("node").alias(s), F.col("component").alias(f"{s}_component"), F.col("main").alias(f"{s}_main"), F.col("n_shingles").alias(f"{s}_n"), F.col("low").alias(f"{s}_low"), F.col("high").alias(f"{s}_high"), F.col("parity").alias(f"{s}_parity")) for s in "ab")
    once = (F.col("b_component") == F.col("b_main")) | (F.col("a") < F.col("b"))
    across = left.filter("a_component <> a_main").join(right, (F.col("a_bucket") == F.col("b_bucket")) & (F.col("a_component") != F.col("b_component")) & once & near)
    rest = shared_table(across.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(first, ["a", "b"], "left_anti"))
    found = components(links.unionByName(confirmed(rest)))

    of_row = full.join(classes, ["set_1", "set_2", "n_shingles"]).select("doc_id", "digest", "row_no", "n_shingles", "node")
    of_row = of_row.join(found, "node", "left").select("doc_id", "digest", "row_no", "n_shingles", F.coalesce("component", "node").alias("component"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("row_no").alias("row"))
    heads = of_row.groupBy(F.col("component").alias("head_of")).agg(F.min(order).alias("head"))
    linked = of_row.join(heads, of_row["component"] == heads["head_of"]).select("doc_id", "digest", "n_shingles", F.col("head.id").alias("component_id"), (F.col("row_no") == F.col("head.row")).alias("kept"))
    empty = signed.filter("n_shingles = 0").select("doc_id", "digest", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    return linked.unionByName(empty)


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, threshold_percent: int = 80) -> DataFrame:
    """``docs`` with one document of each group, the one with the smallest id; all columns as they were."""
    verdicts = near_duplicates(docs, id_col, text_col, words, threshold_percent)
    # A key may stand for rows that repeat: of those one stays, and all stay if the text has no words.
    lose = verdicts.groupBy(F.col("doc_id").alias("l_id"), F.col("digest").alias("l_digest")).agg(F.count_if("kept").alias("stay"), F.count(F.lit(1)).alias("n")).filter("stay < n")
    # Rows are structs beside their key, so that no column of the user meets a name of this module.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(f"`{id_col}`").alias("r_id"), F.xxhash64(text_of(f"`{text_col}`")).alias("r_digest"))
    same = (F.col("r_digest") == F.col("l_digest")) & F.col("r_id").eqNullSafe(F.col("l_id"))
    rest = rows.join(lose.filter("stay = 0").select("l_id", "l_digest"), same, "left_anti")
    repeated = lose.filter("stay > 0").select("l_id", "l_digest")
    plain = rest.join(repeated, same, "left_anti")
    one = rest.join(repeated, same).groupBy("l_id", "l_digest").agg(F.first("_row").alias("_row"))
    return plain.select("_row.*").unionByName(one.select("_row.*"))
