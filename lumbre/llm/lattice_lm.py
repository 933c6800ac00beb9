"""Language-model scores from a lattice over subword pieces.

The pieces and their scores are those of an existing vocabulary.  The probability of a word is the sum over all its
segmentations into pieces, by a forward recursion in log space; piece weights start at the vocabulary's scores and are fitted to
the training words by expected counts (forward and backward).  A word seen in training has one more arc, the word
itself, with its discounted count; the discount is what the lattice of pieces shares out, so unseen words keep a probability.
A text's probability is that of its words and one end, summed over the classes of training documents (languages), each with
its own weights: P(text) = sum of P(class) * product of P(word | class).

Scale: counts are by word and task before they are shuffled; the lattice sees each distinct word once for each round; only
piece weights (vocabulary x classes) are shipped to all tasks.  Word scores reach documents by blocks of documents: a block's distinct
words are joined with the word table and the block is scored in one task.  The number of blocks grows with the tokens.

Defined cases: a null text is empty and scores as the end alone; a null id is not held out; a null class is a class; classes beyond
the most frequent MAX_CLASSES share one; repeated rows are counted and scored each; without training rows all words are unseen
and the vocabulary's scores alone decide; an empty table gives an empty table.  Other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumbre.llm.common import shared_table, text_of, tokenizer_path
from lumbre.llm.lattice import MARK, NEVER, expected_counts, log_likelihoods, pieces

MAX_CLASSES = 8
ROUNDS = 3
#: Weight of the vocabulary's own scores, in words.
PRIOR = 300.0
#: Tokens of one block of documents.
BLOCK_TOKENS = 4_000_000
#: Distinct words that a counting task holds before it emits them.
HELD_WORDS = 400_000
#: Words of one call of the lattice.
LATTICE_WORDS = 60_000
LN10 = math.log(10)


def words_of(text: str | None) -> list[bytes]:
    """Words between white space, A-Z in lower case."""
    return (text or "").encode().lower().split()


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 7 == 2, F.lit(False))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(class, word, in training, in all) of a task; the word is null for ends."""
    kinds: dict[tuple[str | None, bool], Counter] = {}

    def emit():
        for (kind, train), counts in kinds.items():
            keys, n = list(counts), np.fromiter(counts.values(), np.int64, len(counts))
            yield pa.RecordBatch.from_arrays([pa.array([kind] * len(keys), pa.string()), pa.array(keys, pa.binary()).cast(pa.string()), pa.array(n if train else n * 0), pa.array(n)], ["class", "word", "trained", "n"])
        kinds.clear()

    for batch in batches:
        for text, kind, held in zip(batch["text"], batch["class"].to_pylist(), batch["held"].to_pylist()):
            counts = kinds.setdefault((kind, not held), Counter())
            counts.update(words_of(text.as_py()))
            counts[None] += 1
        if sum(map(len, kinds.values())) > HELD_WORDS:
            yield from emit()
    yield from emit()


def _large(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches put together, so that many words have the same length."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= LATTICE_WORDS:
            yield pa.Table.from_batches(held)
            held, rows = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _expect(model_file: str, logs: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = pieces(model_file)
        total = np.zeros((v.size, logs.shape[1]))
        for batch in _large(batches):
            of = batch["k"].to_numpy()
            words, weight = batch["word"].to_pylist(), 1 / batch["c"].to_numpy()
            for k in np.unique(of):
                rows = np.flatnonzero(of == k)
                total[:, k] += expected_counts(v, [MARK + words[i] for i in rows], logs[:, k], weight[rows])
        piece, k = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(piece.astype(np.int32)), pa.array(total[piece, k])], ["k", "piece", "e"])

    return run


def _score_words(model_file: str, logs: np.ndarray, discount: np.ndarray, left: np.ndarray, size: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = pieces(model_file)
        for batch in _large(batches):
            counts = batch["counts"].combine_chunks().flatten().to_numpy().astype(float).reshape(batch.num_rows, -1)
            spelled = log_likelihoods(v, [MARK + w for w in batch["word"].to_pylist()], logs) + left
            with np.errstate(divide="ignore"):
                whole = np.maximum(np.log(np.maximum(counts - discount, 0) / size), NEVER)
            p = np.logaddexp(spelled, whole).astype(np.float32)
            ends = pa.array(np.arange(0, p.size + 1, p.shape[1], dtype=np.int32))
            yield from pa.table([batch["word"], batch["c"], pa.ListArray.from_arrays(ends, pa.array(p.ravel()))], ["word", "c", "p"]).combine_chunks().to_batches()

    return run


def _block_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    blocks: dict[int, set[bytes]] = {}

    def emit():
        for block, words in blocks.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(words), block)), pa.array(list(words), pa.binary()).cast(pa.string())], ["block", "word"])
        blocks.clear()

    for batch in batches:
        for text, block in zip(batch["text"], batch["block"].to_pylist()):
            blocks.setdefault(block, set()).update(words_of(text.as_py()))
        if sum(map(len, blocks.values())) > 4 * HELD_WORDS:
            yield from emit()
    yield from emit()


def _score_documents(start: np.ndarray, tokens: int, distinct: int, ends: int):
    unit = tokens + distinct + 1

    def run(docs: pa.Table, words: pa.Table) -> pa.Table:
        p = words["p"].combine_chunks().flatten().to_numpy().astype(float).reshape(-1, len(start))
        c = words["c"].to_numpy()
        base = np.log10((c + 1) / unit)
        at = dict(zip(words["word"].combine_chunks().cast(pa.binary()).to_pylist(), range(len(c))))
        rows = []
        for text in docs["text"]:
            own = words_of(text.as_py())
            i = np.fromiter(map(at.__getitem__, own), np.int64, len(own))
            logs = start + (p[i].sum(axis=0) if len(own) else 0)
            top = logs.max()
            rows.append((len(own) + 1, int((c[i] > 0).sum()) + (ends > 0), base[i].sum() + math.log10((ends + 1) / unit), (top + math.log(np.exp(logs - top).sum())) / LN10))
        n, known, b, s = zip(*rows)
        return pa.table([docs["doc_id"], docs["held"], pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array([tokens] * len(n), pa.int64()), pa.array(b, pa.float64()), pa.array(s, pa.float64())], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def lattice_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", class_col: str = "lang", model_file: str | None = None, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row per row of ``docs``."""
    model_file = model_file or tokenizer_path()
    plain = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"), F.col(class_col).cast("string").alias("class"), held_out(id_col).alias("held"))
    counted = plain.select("text", "class", "held").mapInArrow(_count, "class string, word string, trained long, n long")
    counts = shared_table(counted.groupBy("class", "word").agg(F.sum("trained").alias("trained"), F.sum("n").alias("n")))

    by_class = counts.groupBy("class").agg(F.sum("trained").alias("trained"), F.sum(F.when(F.col("word").isNull(), F.col("trained"))).alias("docs"))
    frequent = [r["class"] for r in by_class.filter("trained > 0").orderBy(F.desc("trained"), F.asc_nulls_first("class")).limit(MAX_CLASSES).collect()]
    # Classes after the most frequent, and those without training rows, share the last number, if there are any.
    number = F.lit(len(frequent))
    for k, name in reversed(list(enumerate(frequent))):
        number = F.when(F.col("class").eqNullSafe(F.lit(name)), F.lit(k)).otherwise(number)
    numbered = counts.withColumn("k", number)
    classes = len(frequent) + (by_class.count() > len(frequent) or not frequent)
    facts = {
        r["k"]: r
        for r in numbered.groupBy("k", "word").agg(F.sum("trained").alias("trained"), F.sum("n").alias("n")).groupBy("k").agg(
            F.sum("trained").alias("size"), F.sum("n").alias("n"), F.sum(F.when(F.col("word").isNull(), F.col("trained"))).alias("docs"),
            F.count_if(F.col("word").isNotNull() & (F.col("trained") > 0)).alias("types"), F.count_if(F.col("word").isNotNull() & (F.col("trained") == 1)).alias("once"),
            F.count_if(F.col("word").isNotNull() & (F.col("trained") == 2)).alias("twice"),
        ).collect()
    }
    fact = lambda name: np.array([float(facts[k][name] or 0) if k in facts else 0.0 for k in range(classes)])
    docs_of, types = fact("docs"), fact("types")
    tokens, ends = int(fact("size").sum()), int(docs_of.sum())
    size = fact("size") + 1e-9
    discount = (fact("once") + 0.5) / (fact("once") + 2 * fact("twice") + 1)
    # A class without training words leaves all to the pieces, and an end for every other token.
    left = np.log(np.where(types > 0, discount * types / size, 0.5))
    end = np.log(np.where(docs_of > 0, docs_of / size, 0.5))
    start = np.log((docs_of + 1e-9) / (docs_of + 1e-9).sum()) + end

    v = pieces(model_file)
    logs = _log_weights(v.prior()[:, None] * PRIOR, classes)
    # The pieces are there for words unlike those seen, so a word weighs the less the more often it was seen.
    trained = numbered.filter("trained > 0 AND word IS NOT NULL").groupBy("k", "word").agg(F.sum("trained").alias("c"))
    for _ in range(rounds if tokens else 0):
        found = trained.mapInArrow(_expect(model_file, logs), "k int, piece int, e double").groupBy("k", "piece").agg(F.sum("e").alias("e")).toPandas()
        weights = np.repeat(v.prior()[:, None] * PRIOR, classes, axis=1)
        np.add.at(weights, (found["piece"].to_numpy(), found["k"].to_numpy()), found["e"].to_numpy())
        logs = _log_weights(weights, classes)

    vocabulary = numbered.filter("word IS NOT NULL").groupBy("word").agg(
        F.sum("trained").alias("c"), F.array(*[F.sum(F.when(F.col("k") == k, F.col("trained")).otherwise(0)) for k in range(classes)]).alias("counts")
    )
    scored = shared_table(vocabulary.select("word", "c", "counts").mapInArrow(_score_words(model_file, logs, discount, left, size), "word string, c long, p array<float>"))
    distinct = scored.filter("c > 0").count() + (ends > 0)

    blocks = max(1, math.ceil(fact("n").sum() / BLOCK_TOKENS))
    dealt = plain.select("doc_id", "held", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).alias("block")).repartition(blocks, "block")
    words = dealt.mapInArrow(_block_words, "block long, word string").join(scored, "word").select("block", "word", "c", "p")
    # A block of empty texts has no words; the outer side of cogroup keeps it.
    id_type = plain.schema["doc_id"].dataType.simpleString()
    return dealt.groupBy("block").cogroup(words.groupBy("block")).applyInArrow(
        _score_documents(start, tokens, distinct, ends), f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )


def _log_weights(weights: np.ndarray, classes: int) -> np.ndarray:
    """Log of normalised weights by class, with a last row for no piece."""
    weights = np.broadcast_to(weights, (len(weights), classes))
    with np.errstate(divide="ignore"):
        logs = np.log(weights / weights.sum(axis=0))
    return np.vstack([np.maximum(logs, NEVER), np.full((1, classes), NEVER)])
