"""Chat examples by prefix-target expansion: every assistant turn is an example of its own, with all turns before it as context and
only its own text under the loss.

A turn is written as ``[role]text</s>``; turns follow each other.  Inside roles and texts the characters of control strings are escaped
(``~`` as ``~0``, ``[`` as ``~1``, ``]`` as ``~2``, ``<`` as ``~3``), so no text can hold one, and every text can be read back.

The examples of a conversation share their context: example k is the conversation's formatted text up to the end of its reply.  It is
stored once with the spans of the examples; ``expand`` makes each example's strings, which grow with the square of the turns.

Turns after the last reply belong to no example; they stay in the formatted text, outside every example and every loss span.

Defined cases: a null text or role is empty; turns are ordered by number (null first), then role and text; rows that repeat are turns
of their own; a null id is a conversation; a conversation without replies has no examples; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumbre.llm.common import text_of

REPLY_ROLE = "assistant"
OPEN, CLOSE, END = "[", "]", "</s>"
#: Fixed order: the escape character first, and last when reading back.
ESCAPES = (("~", "~0"), ("[", "~1"), ("]", "~2"), ("<", "~3"))


def escaped(text: Column) -> Column:
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def format_conversations(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, formatted, spans): one row per conversation; a span has ``begin`` and ``end`` of a reply's text in characters from 0."""
    head = F.concat(F.lit(OPEN), escaped(text_of(role_col)), F.lit(CLOSE))
    each = turns.select(
        F.col(id_col).alias("conv_id"),
        F.struct(F.col(turn_col).alias("turn"), text_of(role_col).alias("role"), text_of(text_col).alias("text"), head.alias("head"), F.concat(escaped(text_of(text_col)), F.lit(END)).alias("body")).alias("t"),
    )
    whole = each.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<begin:int,end:int>>").alias("spans"))
    # Lengths only: a turn's beginning is the sum of the lengths before it.
    lengths = F.transform("t", lambda x: F.struct(F.length(x["head"]).alias("head"), F.length(x["body"]).alias("body"), (x["role"] == REPLY_ROLE).alias("reply")))
    whole = whole.select("conv_id", F.array_join(F.transform("t", lambda x: F.concat(x["head"], x["body"])), "").alias("formatted"), lengths.alias("lengths"))
    ends = F.aggregate(
        "lengths",
        empty,
        lambda a, x: F.struct(
            (a["at"] + x["head"] + x["body"]).alias("at"),
            F.when(x["reply"], F.concat(a["spans"], F.array(F.struct((a["at"] + x["head"]).alias("begin"), (a["at"] + x["head"] + x["body"] - len(END)).alias("end"))))).otherwise(a["spans"]).alias("spans"),
        ),
        lambda a: a["spans"],
    )
    return whole.select("conv_id", "formatted", ends.alias("spans"))


def examples(formatted: DataFrame, every: bool = False) -> DataFrame:
    """(conv_id, formatted, n_examples, example, context_end, reply, chars): one row per example; the context is the formatted text up to context_end.

    With ``every``, a conversation without replies has one row without an example.
    """
    explode = F.posexplode_outer if every else F.posexplode
    each = formatted.select("conv_id", "formatted", F.size("spans").alias("n_examples"), explode("spans").alias("example", "span"))
    reply = F.substring("formatted", F.col("span.begin") + 1, F.col("span.end") - F.col("span.begin"))
    return each.select("conv_id", "formatted", "n_examples", "example", F.col("span.begin").alias("context_end"), reply.alias("reply"), (F.col("span.end") + len(END)).alias("chars"))


def expand(formatted: DataFrame, every: bool = False) -> DataFrame:
    """(conv_id, example, prompt, completion): the strings of each example; only the completion is trained, its end mark is not.

    With ``every``, also ``last``, whether no example follows, and there ``tail``, the formatted text outside all examples.
    """
    made = examples(formatted, every)
    columns = ["conv_id", "example", F.substring("formatted", F.lit(1), F.col("context_end")).alias("prompt"), F.col("reply").alias("completion")]
    if every:
        last = F.col("example").isNull() | (F.col("example") + 1 == F.col("n_examples"))
        columns += [last.alias("last"), F.when(last, F.substring("formatted", F.coalesce("chars", F.lit(0)) + 1, F.lit(2**31 - 1))).alias("tail")]
    return made.select(*columns)


def read_back(formatted: Column) -> Column:
    """Turns (role, text) of a formatted conversation."""
    parts = F.filter(F.split(formatted, END, -1), lambda x: x != "")
    return F.transform(parts, lambda x: F.struct(unescaped(F.substring_index(F.substring(x, 2, 2**31 - 1), CLOSE, 1)).alias("role"), unescaped(F.substring_index(x, CLOSE, -1)).alias("text")))


def digests(formatted: DataFrame) -> DataFrame:
    """What the examples say: the texts under the loss, and the turns, read back from the last example and the tail after it.

    Prompts are measured row by row; only completions and the last example's strings are gathered.
    """
    string = F.when(F.col("example").isNotNull(), F.concat("prompt", "completion", F.lit(END)))
    rows = expand(formatted, every=True).select(
        "conv_id", F.when(F.col("example").isNotNull(), F.struct("example", "completion")).alias("reply"),
        F.length(string).cast("long").alias("chars"), F.when(F.col("last"), F.concat(F.coalesce(string, F.lit("")), "tail")).alias("text"),
    )
    # Of a conversation's rows one has the text.
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("reply")).alias("replies"), F.coalesce(F.sum("chars"), F.lit(0).cast("long")).alias("formatted_chars"), F.max("text").alias("text"))
    loss = F.array_join(F.transform("replies", lambda x: unescaped(x["completion"])), "")
    turns = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    out = whole.select("conv_id", "formatted_chars", loss.alias("loss"), read_back(F.col("text")).alias("turns"), F.size("replies").cast("long").alias("n_examples"))
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars", "n_examples"
    )



SQL = """
WITH t AS (SELECT conv_id, turn, role, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations
           UNION ALL SELECT -1, n, CASE n WHEN 0 THEN 'user' ELSE 'assistant' END, CASE n WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) q(n)),
e AS (SELECT *, CAST(length(r) + length(regexp_replace(r, '[^~<\\[\\]]', '', 'g')) + 2 AS BIGINT) AS head, CAST(length(x) + length(regexp_replace(x, '[^~<\\[\\]]', '', 'g')) + 4 AS BIGINT) AS body FROM t),
c AS (SELECT *, sum(head + body) OVER (PARTITION BY conv_id ORDER BY turn, r, x ROWS UNBOUNDED PRECEDING) AS upto FROM e)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || x || chr(10), '' ORDER BY turn, r, x)) AS turns_sha256,
       CAST(coalesce(sum(length(x)) FILTER (r = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(x, '' ORDER BY turn, r, x) FILTER (r = 'assistant'), '')) AS loss_sha256,
       CAST(coalesce(sum(upto) FILTER (r = 'assistant'), 0) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""
