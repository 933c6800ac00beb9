"""Repair of conversation structure: the cheapest edits after which the roles read ``(s?(ua)+)?``.

An edit keeps a row (K), changes its role (R), deletes it (D), or inserts an empty turn (I).  A row's pattern is its role's initial and its fault,
two characters.  The choice is a shortest path in a DAG whose nodes are (letters written, rows read, state of the roles) and whose weights are single
integers: the cost in the high digits, below it one digit of base 5 for each place of the audit string, zero where the string has ended.  Adding an
edge adds its cost and its letter at its place, so the least integer is the least cost and, among equals, the least string.

Rows are dealt to blocks of ``BLOCK_ROWS``.  A block's paths from every state to every state are found by themselves, in parallel; in a block the
last letter belongs to its last row, so two different strings of a block differ before either ends, and the blocks of a conversation are joined
from the end by the same integer minimum.  Only patterns, two characters a row, meet by conversation; texts do not.  The digest of
a repaired conversation is a stream over its sorted rows, as no hash of one string can be taken in parts.

Defined cases: a null role or text is one space; a null id is a conversation of its own, its part of the damage key is one space, as is a null turn's;
rows are ordered by turn (null first), then role, then text's digest; an empty role has no initial and is never kept; a conversation whose rows are
all dropped is returned with zeros; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumbre.llm.common import SPACE, shared_table
from lumbre.llm.merkle import CRC32_SQL
from lumbre.llm.places import numbered
from lumbre.session import broadcast_if_small

BLOCK_ROWS = 32
#: Keys that the rows of one repeated text are dealt to.
SALT = 32
# Costs of edits, and letters by the order of their characters; digit 0 ends the string.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
LETTERS = ".DIKR"
BASE = len(LETTERS)
#: States: nothing yet, after the system turn, after a user turn, after a reply.
START, SYSTEM, USER, REPLY = range(4)
NEXT_TURN = {START: ("u", USER), SYSTEM: ("u", USER), USER: ("a", REPLY), REPLY: ("u", USER)}
#: What ends a conversation in each state: inserted turns, their cost.
TAILS = {START: "", SYSTEM: "II", USER: "I", REPLY: ""}
ROLE_NAMES = {"u": "user", "a": "assistant"}


# -- one block ------------------------------------------------------------------------------------------------------------


def row_edges(pattern: str, state: int) -> list[tuple[int, str, int]]:
    """(cost, letter, next state) of the edits that read one row: its initial and its fault (``b``, ``d``, ``t`` or ``-``)."""
    initial, fault = pattern
    edges = [(DELETE, "D", state)]
    if fault not in "bd":
        extra = TRUNCATED if fault == "t" else 0
        wanted, following = NEXT_TURN[state]
        if initial == wanted:
            edges.append((extra, "K", following))
        if initial == "s" and state == START:
            edges.append((extra, "K", SYSTEM))
        edges.append((REROLE + extra, "R", following))
    return edges


@lru_cache(maxsize=20_000)
def block_paths(pattern: str, entry: int) -> tuple[tuple[int, int, str], ...]:
    """(exit state, cost, letters): the least path through a block from ``entry`` to each state, its last letter reading the last row."""
    n = len(pattern) // 2
    width = 2 * n  # one inserted turn before each row: a pair of them would only add its cost
    place = [BASE ** (width - 1 - p) for p in range(width)]
    cost_unit = BASE**width
    best: dict[tuple[int, int], int] = {(0, entry): 0}
    ends: dict[int, int] = {}
    for p in range(width):
        following: dict[tuple[int, int], int] = {}
        for (row, state), weight in best.items():
            edges = [(cost, letter, row + 1, to) for cost, letter, to in row_edges(pattern[2 * row : 2 * row + 2], state)]
            if p - row <= row:
                edges.append((INSERT, "I", row, NEXT_TURN[state][1]))
            for cost, letter, at, to in edges:
                total = weight + cost * cost_unit + LETTERS.index(letter) * place[p]
                node, where = ((to, ends) if at == n else ((at, to), following))
                if node not in where or total < where[node]:
                    where[node] = total
        best = following
    out = []
    for state, weight in sorted(ends.items()):
        cost, digits = divmod(weight, cost_unit)
        letters = "".join(LETTERS[digits // place[p] % BASE] for p in range(width)).rstrip(".")
        out.append((state, cost, letters))
    return tuple(out)


def join_blocks(blocks: list[list[tuple[int, int, int, str]]]) -> tuple[int, list[tuple[int, str]], str]:
    """Cost, each block's (entry, letters) and the tail of the least path through all blocks.

    ``blocks`` lists (entry, exit, cost, letters) in the order of the rows.
    """
    ahead = {state: len(tail) * INSERT for state, tail in TAILS.items()}
    chosen: list[dict[int, tuple[int, str]]] = []
    for block in reversed(blocks):
        width = max(len(letters) for *_, letters in block)
        unit, least = BASE**width, {}
        for entry, leaving, cost, letters in block:
            digits = 0
            for letter in letters.ljust(width, "."):
                digits = digits * BASE + LETTERS.index(letter)
            weight = (cost + ahead[leaving]) * unit + digits
            if entry not in least or weight < least[entry][0]:
                least[entry] = (weight, leaving, letters)
        ahead = {entry: weight // unit for entry, (weight, _, _) in least.items()}
        chosen.append({entry: (leaving, letters) for entry, (_, leaving, letters) in least.items()})
    state, path = START, []
    for options in reversed(chosen):
        leaving, letters = options[state]
        path.append((state, letters))
        state = leaving
    return ahead[START], path, TAILS[state]


def written(state: int, letters: str, initials: str) -> list[tuple[str, str]]:
    """For each row of a block the role of the turn inserted before it, and its own role's initial, ``-`` if deleted and ``=`` if kept; empty for none."""
    out, inserted, row = [], "", 0
    for letter in letters:
        wanted, following = NEXT_TURN[state]
        if letter == "I":
            inserted, state = wanted, following
            continue
        if letter == "D":
            out.append((inserted, "-"))
        elif letter == "K":
            state = SYSTEM if initials[row] == "s" else following
            out.append((inserted, "="))
        else:
            out.append((inserted, wanted))
            state = following
        inserted, row = "", row + 1
    return out


# -- rows -----------------------------------------------------------------------------------------------------------------


def damaged(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text) after a damage that the row's key decides; nulls of role and text are one space."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col(id_col).cast("string"), space), F.lit(":"), F.coalesce(F.col(turn_col).cast("string"), space))
    rows = turns.select(
        F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), space).alias("role"), F.coalesce(F.col(text_col).cast("string"), space).alias("text"),
        (F.crc32(key.cast("binary")) % 20).alias("kind"),
    ).filter("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def placed_rows(rows: DataFrame) -> DataFrame:
    """(key, turn, role, text, same, place): rows at their places in their conversation, written once; ``same`` is the text's digest."""
    key = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    told = rows.select(key.alias("key"), "turn", "role", "text", F.sha2("text", 256).alias("same"), F.monotonically_increasing_id().alias("row"))
    # The row number only spreads equal rows over partitions.
    return numbered(told, "key", [F.col("turn"), F.col("role"), F.col("same"), F.col("row")]).withColumnRenamed("_index", "place").drop("row", "_count")


def with_faults(placed: DataFrame) -> DataFrame:
    """(key, turn, place, pattern): initial and first fault of each of ``placed_rows``, without the texts."""
    firsts = placed.groupBy("key", "role", "same").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    firsts = shared_table(firsts)
    side = broadcast_if_small(firsts)
    on = ["key", "role", "same"]
    if side is firsts:
        side = firsts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        placed, on = placed.withColumn("salt", F.pmod("place", F.lit(SALT)).cast("int")), [*on, "salt"]
    joined = placed.join(side, on, "left")
    bare = F.regexp_replace("text", f"[{SPACE}]+", "")
    fault = F.when(bare == "", "b").when(F.col("place") > F.col("first"), "d").when(~F.substring(bare, -1, 1).isin(".", "!", "?"), "t").otherwise("-")
    first = F.substring("role", 1, 1)
    initial = F.when(first.isin("s", "u", "a"), first).otherwise("o")
    return shared_table(joined.select("key", "turn", "place", F.concat(initial, fault).alias("pattern")))


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, block, pattern) to (key, block, pattern, entry, exit, cost, letters)."""
    for batch in batches:
        rows = []
        for key, block, pattern in zip(*(batch.column(c).to_pylist() for c in ("key", "block", "pattern"))):
            for entry in (START,) if block == 0 else (START, SYSTEM, USER, REPLY):
                rows += [(key, block, pattern, entry, *path) for path in block_paths(pattern, entry)]
        names = ["key", "block", "pattern", "entry", "leaving", "cost", "letters"]
        types = [pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)


def _join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each conversation: its audit, cost and the marks of each block's rows."""
    for batch in batches:
        out: list[tuple] = []
        for key, paths in zip(batch.column("key").to_pylist(), batch.column("paths").to_pylist()):
            blocks: dict[int, list] = {}
            initials: dict[int, str] = {}
            for p in paths:
                blocks.setdefault(p["block"], []).append((p["entry"], p["leaving"], p["cost"], p["letters"]))
                initials[p["block"]] = p["pattern"][::2]
            order = sorted(blocks)
            cost, path, tail = join_blocks([blocks[b] for b in order])
            marks = []
            for b, (state, letters) in zip(order, path):
                rows = written(state, letters, initials[b])
                marks.append({"block": b, "before": "".join(x or "." for x, _ in rows), "own": "".join(y for _, y in rows)})
            whole = "".join(initials[b] for b in order)
            illegal = sum(whole[i : i + 2] not in ("su", "ua", "au") for i in range(len(whole) - 1))
            out.append((key, cost, "".join(letters for _, letters in path) + tail, illegal, len(tail), marks))
        mark = pa.list_(pa.struct([("block", pa.int64()), ("before", pa.string()), ("own", pa.string())]))
        types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int32(), mark]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], ["key", "cost", "audit", "illegal", "tail", "marks"])


def choose_edits(rows: DataFrame) -> DataFrame:
    """(key, cost, audit, illegal, tail, marks) of each conversation of ``with_faults``; ``marks`` has the edits of each block's rows."""
    each = rows.withColumn("block", F.expr(f"place DIV {BLOCK_ROWS}"))
    patterns = each.groupBy("key", "block").agg(F.sort_array(F.collect_list(F.struct("place", "pattern"))).alias("of"))
    patterns = patterns.select("key", "block", F.array_join("of.pattern", "").alias("pattern"))
    paths = patterns.mapInArrow(_solve, "key string, block long, pattern string, entry int, leaving int, cost long, letters string")
    whole = paths.groupBy("key").agg(F.collect_list(F.struct("block", "pattern", "entry", "leaving", "cost", "letters")).alias("paths"))
    return shared_table(whole.mapInArrow(_join, "key string, cost long, audit string, illegal long, tail int, marks array<struct<block:long,before:string,own:string>>"))


def repaired_rows(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """(key, place, turn, before, edit, role, text): rows of the repaired conversations in their places.

    ``before`` is the role of an empty turn inserted before the row, ``edit`` is K, R or D; a deleted row has role and text null.  The empty turns
    at the end are rows of place null with edit I.
    """
    marks = edits.select("key", F.explode("marks").alias("m")).select("key", F.col("m.block").alias("block"), "m.before", "m.own")
    each = rows.withColumn("block", F.expr(f"place DIV {BLOCK_ROWS}")).join(marks, ["key", "block"])
    at = (F.col("place") % BLOCK_ROWS + 1).cast("int")
    inserted, own = F.substring("before", at, F.lit(1)), F.substring("own", at, F.lit(1))
    name = lambda mark: F.when(mark == "u", ROLE_NAMES["u"]).when(mark == "a", ROLE_NAMES["a"])
    role = F.when(own == "=", F.col("role")).otherwise(name(own))
    out = each.select(
        "key", "place", "turn", name(inserted).alias("before"), F.when(own == "=", "K").when(own == "-", "D").otherwise("R").alias("edit"), role.alias("role"), F.when(own != "-", F.col("text")).alias("text")
    )
    last = edits.filter("tail > 0").select("key", F.explode(F.when(F.col("tail") == 1, F.array(F.lit("assistant"))).otherwise(F.array(F.lit("user"), F.lit("assistant")))).alias("role"))
    turn = out.schema["turn"].dataType
    added = last.select("key", F.lit(None).cast("long").alias("place"), F.lit(None).cast(turn).alias("turn"), F.lit(None).cast("string").alias("before"), F.lit("I").alias("edit"), "role", F.lit("").alias("text"))
    return out.unionByName(added)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One hash for each run of a key in sorted rows; memory holds one batch."""
    key, state, done = None, None, []
    for batch in batches:
        for k, piece in zip(batch.column("key").to_pylist(), batch.column("piece").to_pylist()):
            if k != key:
                if key is not None:
                    done.append((key, state.hexdigest()))
                key, state, begun = k, sha256(), False
            if piece is not None:
                state.update((("\n" if begun else "") + piece).encode())
                begun = True
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], pa.string()) for i in (0, 1)], ["key", "repaired_sha256"])
            done = []
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.string()), pa.array([state.hexdigest()], pa.string())], ["key", "repaired_sha256"])


def repaired_digests(repaired: DataFrame) -> DataFrame:
    """(key, repaired_sha256): the hash of the ``role:text`` lines of each repaired conversation, streamed over its sorted rows."""
    before = F.concat("before", F.lit(":"))
    piece = F.when(F.col("role").isNull(), before).otherwise(F.concat_ws("\n", before, F.concat("role", F.lit(":"), "text")))
    pieces = repaired.select("key", F.col("place").isNull().alias("end"), "place", F.col("role").alias("_role"), piece.alias("piece"))
    # At the end a user turn comes before a reply.
    order = ["key", F.col("end"), F.col("place"), F.col("_role").desc()]
    return pieces.repartition("key").sortWithinPartitions(*order).select("key", "piece").mapInArrow(_digest, "key string, repaired_sha256 string")


def audit_conversations(turns: DataFrame, placed: DataFrame, rows: DataFrame, edits: DataFrame) -> DataFrame:
    """One row for each conversation of ``turns``: counts of faults, cost, audit and digest, from its placed rows, their faults and their repair."""
    digests = repaired_digests(repaired_rows(placed, edits))
    fault = F.substring("pattern", 2, 1)
    count = lambda letter: F.count_if(fault == letter)
    told = rows.groupBy("key").agg(
        (F.max("turn") - F.min("turn") + 1).cast("long").alias("span"), count("b").alias("blank"), count("d").alias("duplicate"), count("t").alias("truncated")
    )
    turns_of = rows.filter("turn IS NOT NULL").select("key", "turn").distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n_turns"))
    each = turns.select("conv_id", F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("key")).distinct()
    out = each.join(told, "key", "left").join(turns_of, "key", "left").join(edits.select("key", "cost", "audit", "illegal"), "key", "left").join(digests, "key", "left")
    zero = lambda name: F.coalesce(F.col(name), F.lit(0).cast("long")).alias(name)
    return out.select(
        "conv_id", F.coalesce(F.col("span") - F.col("n_turns"), F.lit(0).cast("long")).alias("gaps"), *[zero(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(sha256(b"").hexdigest())).alias("repaired_sha256"),
    )


def repair_damaged(turns: DataFrame) -> DataFrame:
    """Damage, repair and audit of ``turns`` (conv_id, turn, role, text)."""
    placed = placed_rows(damaged(turns))
    rows = with_faults(placed)
    return audit_conversations(turns, placed, rows, choose_edits(rows))


SQL = rf"""
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  {CRC32_SQL.format("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS kind FROM conversations),
g AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM k, range(2) c(n) WHERE kind <> 0 AND (n = 0 OR kind = 3)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i, regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g') AS bare FROM g),
r AS (SELECT conv_id, turn, role, text, i, left(role, 1) AS c, CASE WHEN bare = '' THEN 'b' WHEN i > min(i) OVER (PARTITION BY conv_id, role, text) THEN 'd' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '-' END AS fault,
  lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair FROM o),
m(e, q, z, need, x, cost, ins) AS (VALUES ('D', -1, -1, '', '', 3, ''),
  ('K', 0, 1, 's', '', 0, ''), ('K', 0, 2, 'u', '', 0, ''), ('K', 1, 2, 'u', '', 0, ''), ('K', 2, 3, 'a', '', 0, ''), ('K', 3, 2, 'u', '', 0, ''),
  ('R', 0, 2, '', 'user', 2, ''), ('R', 1, 2, '', 'user', 2, ''), ('R', 2, 3, '', 'assistant', 2, ''), ('R', 3, 2, '', 'user', 2, ''),
  ('IK', 0, 3, 'a', '', 2, 'user'), ('IK', 1, 3, 'a', '', 2, 'user'), ('IK', 2, 2, 'u', '', 2, 'assistant'), ('IK', 3, 3, 'a', '', 2, 'user'),
  ('IR', 0, 3, '', 'assistant', 4, 'user'), ('IR', 1, 3, '', 'assistant', 4, 'user'), ('IR', 2, 2, '', 'user', 4, 'assistant'), ('IR', 3, 3, '', 'assistant', 4, 'user')),
w AS (SELECT conv_id, 1::BIGINT AS i, 0 AS q, {{'c': 0, 'a': '', 't': []::VARCHAR[]}} AS b FROM (SELECT DISTINCT conv_id FROM r) UNION ALL
  SELECT w.conv_id, w.i + 1, CASE m.q WHEN -1 THEN w.q ELSE m.z END, min({{'c': b.c + m.cost + CASE WHEN fault = 't' AND e <> 'D' THEN 1 ELSE 0 END, 'a': b.a || e,
    't': list_concat(list_concat(b.t, CASE WHEN ins = '' THEN [] ELSE [ins || ':'] END), CASE WHEN e = 'D' THEN [] ELSE [CASE WHEN x = '' THEN role ELSE x END || ':' || text] END)}})
  FROM w JOIN r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i JOIN m ON m.q IN (-1, w.q) AND (e = 'D' OR fault NOT IN ('b', 'd')) AND (need = '' OR need = r.c) GROUP BY ALL),
z AS (SELECT w.conv_id, min({{'c': b.c + CASE q WHEN 1 THEN 4 WHEN 2 THEN 2 ELSE 0 END, 'a': b.a || CASE q WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END,
    't': list_concat(b.t, CASE q WHEN 1 THEN ['user:', 'assistant:'] WHEN 2 THEN ['assistant:'] ELSE [] END)}}) AS b
  FROM w JOIN (SELECT conv_id, max(i) AS n FROM r GROUP BY conv_id) l ON l.conv_id IS NOT DISTINCT FROM w.conv_id AND w.i = n + 1 GROUP BY w.conv_id),
f AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
  count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id)
SELECT a.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(z.b.c, 0) AS BIGINT) AS cost, coalesce(z.b.a, '') AS audit, sha256(coalesce(array_to_string(z.b.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM a.conv_id
"""
