"""Merkle manifest of a table: one tree for each group of rows, one tree over the groups' roots, and proofs for every row.

A node is the SHA-256, in hex, of its up to eight children's hex digests; levels are built while more than one node remains.

Trees are cut into aligned subtrees (blocks) of ``BLOCK_LEVELS`` levels below their root.  A block is one row: its digests are stored in van Emde
Boas order, in which a subtree is its upper half followed by its lower halves, each stored the same way.  ``address`` finds a node
by arithmetic alone and serves both the construction of a block and the look-up of siblings.  The roots of a band of blocks are the
leaves of the next band, until every tree has one root; proofs go down the bands again, one small row for each block.

Defined cases: a null value is written ``-``; a null group comes first and is a group of its own; rows of a group are ordered by id (null
first), then by digest, so rows that repeat are leaves of their own; a group of one row has that leaf as root; an empty table has no
rows and no root; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumbre.llm.common import shared_table
from lumbre.llm.places import numbered

ARITY = 8
#: Levels of a block below its root; a block has ARITY ** BLOCK_LEVELS leaves at most, 37 KB of digests.
BLOCK_LEVELS = 3
BLOCK_LEAVES = ARITY**BLOCK_LEVELS
DIGEST = 32


# -- van Emde Boas order ------------------------------------------------------------------------------------------------


def tree_size(levels: int) -> int:
    return (ARITY**levels - 1) // (ARITY - 1)


def address(levels: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Places of the nodes ``index`` at ``depth`` (root: 0) in the layout of a tree of ``levels`` levels."""
    if levels == 1:
        return np.zeros_like(index)
    top = levels // 2
    if depth < top:
        return address(top, depth, index)
    width = ARITY ** (depth - top)
    return tree_size(top) + index // width * tree_size(levels - top) + address(levels - top, depth - top, index % width)


@lru_cache(maxsize=64)
def level_addresses(levels: int, depth: int) -> tuple[int, ...]:
    return tuple(address(levels, depth, np.arange(ARITY**depth)).tolist())


def shape(leaves: int) -> list[int]:
    """Numbers of nodes by depth, root first, of the tree over ``leaves`` leaves."""
    counts = [leaves]
    while counts[0] > 1:
        counts.insert(0, -(-counts[0] // ARITY))
    return counts


def block_shape(block: int, count: int) -> list[int]:
    """The same for one block of a tree of ``count`` leaves; blocks beside others keep all their levels."""
    if count <= BLOCK_LEAVES:
        return shape(count)
    leaves = min(BLOCK_LEAVES, count - block * BLOCK_LEAVES)
    return [-(-leaves // ARITY ** (BLOCK_LEVELS - d)) for d in range(BLOCK_LEVELS + 1)]


def hash_text(text: str) -> bytes:
    return sha256(text.encode("ascii")).digest()


def build_block(leaves: list[bytes], counts: list[int]) -> bytes:
    """The digests of a block in van Emde Boas order; places of absent nodes are zero."""
    levels = len(counts)
    nodes = bytearray(DIGEST * tree_size(levels))
    for depth in range(levels - 1, -1, -1):
        places = level_addresses(levels, depth)
        if depth < levels - 1:
            below = level_addresses(levels, depth + 1)
            child = [nodes[DIGEST * a : DIGEST * a + DIGEST].hex() for a in below[: counts[depth + 1]]]
            leaves = [hash_text("".join(child[ARITY * i : ARITY * i + ARITY])) for i in range(counts[depth])]
        for a, digest in zip(places, leaves):
            nodes[DIGEST * a : DIGEST * a + DIGEST] = digest
    return bytes(nodes)


def level_texts(nodes: bytes, counts: list[int]) -> list[list[str]]:
    """Hex digests by depth, read through the addresses."""
    return [[nodes[DIGEST * a : DIGEST * a + DIGEST].hex() for a in level_addresses(len(counts), d)[:n]] for d, n in enumerate(counts)]


def block_paths(texts: list[list[str]], upper: tuple[tuple[str, str], ...]) -> list[tuple[tuple[str, str], ...]]:
    """For each leaf its siblings to the left and to the right, level by level from the leaf, then ``upper``."""
    paths = [upper]
    for level in texts[1:]:
        below = []
        for i in range(len(level)):
            start = i // ARITY * ARITY
            below.append((("".join(level[start:i]), "".join(level[i + 1 : start + ARITY])), *paths[i // ARITY]))
        paths = below
    return paths


def fold(digest: str, path: tuple[tuple[str, str], ...]) -> str:
    for left, right in path:
        digest = sha256(f"{left}{digest}{right}".encode("ascii")).hexdigest()
    return digest


def path_text(path: tuple[tuple[str, str], ...]) -> str:
    return "/".join(f"{left}|{right}" for left, right in path)


def path_of(text: str) -> tuple[tuple[str, str], ...]:
    return tuple(tuple(level.split("|")) for level in text.split("/")) if text else ()


# -- bands of blocks ------------------------------------------------------------------------------------------------------


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        nodes, roots = [], []
        rows = zip(batch.column("block").to_pylist(), batch.column("count").to_pylist(), batch.column("digests").to_pylist())
        for block, count, digests in rows:
            counts = block_shape(block, count)
            nodes.append(build_block(digests, counts))
            roots.append(nodes[-1][:DIGEST])
        keep = [batch.column(c) for c in ("tree", "block", "count", "items")]
        yield pa.RecordBatch.from_arrays([*keep, pa.array(nodes, pa.binary()), pa.array(roots, pa.binary())], ["tree", "block", "count", "items", "nodes", "root"])


def _band(nodes: DataFrame) -> DataFrame:
    """Blocks over ``nodes`` (tree, index, count, digest, item): tree, block, count, items, nodes, root, final."""
    each = nodes.withColumn("block", F.expr(f"`index` DIV {BLOCK_LEAVES}"))
    # At most BLOCK_LEAVES rows meet in a group.
    groups = each.groupBy("tree", "block").agg(F.max("count").alias("count"), F.sort_array(F.collect_list(F.struct("index", "digest", "item"))).alias("of"))
    lists = groups.select("tree", "block", "count", F.col("of.digest").alias("digests"), F.col("of.item").alias("items"))
    item = lists.schema["items"].dataType.simpleString()
    built = lists.mapInArrow(_build, f"tree string, block long, count long, items {item}, nodes binary, root binary")
    return shared_table(built.withColumn("final", F.col("count") <= BLOCK_LEAVES))


def build_trees(nodes: DataFrame) -> list[DataFrame]:
    """All bands over ``nodes`` (tree, index, count, digest, item), leaves first.  A tree ends in the band where it has one block."""
    bands = [_band(nodes)]
    while not (rest := bands[-1].filter("NOT final")).isEmpty():
        upper = rest.select("tree", F.col("block").alias("index"), F.expr(f"(`count` - 1) DIV {BLOCK_LEAVES} + 1").alias("count"), F.col("root").alias("digest"), F.struct(F.col("block").alias("id")).alias("item"))
        bands.append(_band(upper))
    return bands


def tree_roots(bands: list[DataFrame]) -> DataFrame:
    """(tree, root): one row for each tree."""
    parts = [b.filter("final").select("tree", "root") for b in bands]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        paths, row = [], []
        columns = [batch.column(c).to_pylist() for c in ("block", "count", "nodes", "path")]
        for k, (block, count, nodes, path) in enumerate(zip(*columns)):
            found = block_paths(level_texts(nodes, block_shape(block, count)), path_of(path))
            paths += [path_text(p) for p in found]
            row += [k] * len(found)
        at = pa.array(row, pa.int64())
        names = ["tree", "subroot", "top"]
        yield pa.RecordBatch.from_arrays([batch.column("items").flatten(), *[batch.column(c).take(at) for c in names], pa.array(paths, pa.string())], ["item", *names, "path"])


def _under(band: DataFrame, starts: DataFrame, upper: DataFrame | None) -> DataFrame:
    """The blocks of a band with the path of their root."""
    out = band.filter("final").join(starts, "tree")
    if upper is not None:
        inner = upper.select("tree", F.col("item.id").alias("block"), "subroot", "top", "path")
        out = out.unionByName(band.filter("NOT final").join(inner, ["tree", "block"]), allowMissingColumns=False)
    return out


def leaf_blocks(bands: list[DataFrame], starts: DataFrame) -> DataFrame:
    """The leaf blocks with the paths of their roots; ``starts`` is (tree, subroot, top, path), the path of each tree's root."""
    upper = None
    for band in reversed(bands[1:]):
        item = band.schema["items"].dataType.elementType.simpleString()
        upper = shared_table(_under(band, starts, upper).mapInArrow(_expand, f"item {item}, tree string, subroot string, top string, path string"))
    return _under(bands[0], starts, upper)


def _prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: dict[str, list] = {c: [] for c in ("leaf", "proof_sha256", "folded_root")}
        row = []
        items = batch.column("items").flatten()
        changed = iter(items.field("changed").to_pylist())
        columns = [batch.column(c).to_pylist() for c in ("block", "count", "nodes", "path")]
        for k, (block, count, nodes, path) in enumerate(zip(*columns)):
            texts = level_texts(nodes, block_shape(block, count))
            for leaf, found in zip(texts[-1], block_paths(texts, path_of(path))):
                other = next(changed)
                out["leaf"].append(leaf)
                out["proof_sha256"].append(sha256("".join(side for level in found for side in level).encode("ascii")).hexdigest())
                out["folded_root"].append(fold(leaf if other is None else other.hex(), found))
                row.append(k)
        at = pa.array(row, pa.int64())
        taken = [batch.column(c).take(at) for c in ("subroot", "top")]
        yield pa.RecordBatch.from_arrays([items.field("id"), *taken, *[pa.array(v, pa.string()) for v in out.values()]], ["id", "subroot", "top", *out])


# -- manifest of a table --------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Manifest:
    """Bands of the trees of the groups, and of the tree over their roots."""

    groups: list[DataFrame]
    top: list[DataFrame]


def field_text(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(columns: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*[field_text(c) for c in columns]), 256))


def build_manifest(rows: DataFrame, id_col: str, group_col: str, fields: dict[str, Column], changed: dict[str, Column] | None = None, where: Column | None = None) -> Manifest:
    """The trees over ``rows``; a leaf hashes ``fields`` in their order.

    ``changed`` replaces fields in the rows of ``where``: what those rows look like when they are checked against the manifest.
    """
    other = leaf_digest([(changed or {}).get(name, value) for name, value in fields.items()])
    group = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit(""))
    altered = F.when(F.lit(False) if where is None else where, other)
    leaves = shared_table(
        rows.select(group.alias("tree"), F.col(id_col).alias("id"), leaf_digest(list(fields.values())).alias("digest"), altered.alias("changed"), F.monotonically_increasing_id().alias("row"))
    )
    # The row number only spreads equal leaves over partitions.
    placed = numbered(leaves, "tree", [F.col("id"), F.col("digest"), F.col("row")])
    groups = build_trees(placed.select("tree", F.col("_index").alias("index"), F.col("_count").alias("count"), "digest", F.struct("id", "changed").alias("item")))
    roots = numbered(tree_roots(groups).withColumn("all", F.lit("")), "all", [F.col("tree")])
    top = build_trees(roots.select(F.col("all").alias("tree"), F.col("_index").alias("index"), F.col("_count").alias("count"), F.col("root").alias("digest"), F.struct(F.col("tree").alias("of"), "root").alias("item")))
    return Manifest(groups, top)


def prove(manifest: Manifest) -> DataFrame:
    """One row for each leaf: id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    start = tree_roots(manifest.top).select("tree", F.lit("").alias("subroot"), F.lower(F.hex("root")).alias("top"), F.lit("").alias("path"))
    over = leaf_blocks(manifest.top, start)
    item = over.schema["items"].dataType.elementType.simpleString()
    named = over.mapInArrow(_expand, f"item {item}, tree string, subroot string, top string, path string")
    starts = shared_table(named.select(F.col("item.of").alias("tree"), F.lower(F.hex("item.root")).alias("subroot"), "top", "path"))
    blocks = leaf_blocks(manifest.groups, starts)
    id_type = blocks.schema["items"].dataType.elementType["id"].dataType.simpleString()
    proofs = blocks.mapInArrow(_prove, f"id {id_type}, subroot string, top string, leaf string, proof_sha256 string, folded_root string")
    return proofs.select("id", "leaf", "subroot", F.col("top").alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == F.col("top")).alias("verified"))


def documents_manifest(docs: DataFrame) -> Manifest:
    """The manifest of ``documents``; where 3 divides the id's CRC-32, the check sees the text in lower case (A-Z)."""
    fields = {c: F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")}
    lower = F.translate(F.col("text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return build_manifest(docs, "doc_id", "lang", fields, {"text": lower}, hit)


#: CRC-32 of an ASCII string, bit by bit.
CRC32_SQL = """xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split({0}, ''), lambda x: ascii(x)::UBIGINT)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]), lambda a, z: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384::UBIGINT) ELSE a >> 1 END)))"""

_FIELD = "coalesce(CAST(octet_length(encode(CAST({0} AS VARCHAR))) AS VARCHAR) || ':' || CAST({0} AS VARCHAR), '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", "{0}")) + ")"
SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce('=' || lang, '') AS g, {_LEAF.format("text")} AS leaf,
  {_LEAF.format("CASE WHEN " + CRC32_SQL.format("CAST(doc_id AS VARCHAR)") + " % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END")} AS seen FROM documents),
l AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY g) AS n FROM d),
t AS (SELECT g, 0 AS lvl, idx, leaf AS h, n FROM l UNION ALL
  SELECT g, lvl + 1, idx // 8, sha256(string_agg(h, '' ORDER BY idx)), (any_value(n) + 7) // 8 FROM t WHERE n > 1 GROUP BY g, lvl, idx // 8),
s AS (SELECT g, h AS subroot, lvl AS height, row_number() OVER (ORDER BY g) - 1 AS place, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (SELECT 0 AS lvl, place AS idx, subroot AS h, n FROM s UNION ALL
  SELECT lvl + 1, idx // 8, sha256(string_agg(h, '' ORDER BY idx)), (any_value(n) + 7) // 8 FROM u WHERE n > 1 GROUP BY lvl, idx // 8),
nodes AS (SELECT g, lvl, idx, h FROM t WHERE n > 1 UNION ALL SELECT s.g, s.height + u.lvl, u.idx, u.h FROM s, u WHERE u.n > 1),
f AS (SELECT l.g, doc_id, leaf, seen AS h, idx, 0 AS lvl, '' AS proof, s.place, s.height FROM l JOIN s ON l.g = s.g UNION ALL
  SELECT f.g, doc_id, any_value(leaf), sha256(string_agg(CASE WHEN nodes.idx = cur THEN f.h ELSE nodes.h END, '' ORDER BY nodes.idx)), cur // 8, f.lvl + 1,
    any_value(proof) || coalesce(string_agg(nodes.h, '' ORDER BY nodes.idx) FILTER (nodes.idx <> cur), ''), any_value(place), any_value(height)
  FROM (SELECT *, CASE WHEN lvl = height THEN place ELSE idx END AS cur FROM f) f JOIN nodes ON nodes.g = f.g AND nodes.lvl = f.lvl AND nodes.idx // 8 = cur // 8 GROUP BY f.g, doc_id, f.lvl, cur),
r AS (SELECT h AS root, lvl AS top FROM u WHERE n = 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, h AS folded_root, h = root AS verified FROM f JOIN s ON f.g = s.g, r WHERE f.lvl = s.height + r.top
"""
