"""N-best segmentation into the pieces of a sentencepiece vocabulary, and back to text.

A forward Viterbi pass gives, for every position, the best score of a way from the start.  A backward A* search from the end
takes these scores as its heuristic; they are exact, so complete segmentations leave the queue in order of score.

No usable piece has the word mark inside or spans a line break, so the lattice of a text is a chain of small lattices (units: a mark
with what follows, a line break, what follows a line break).  The best segmentation of the text is that of its units; the N best
change only units among the N - 1 with the least loss of their second-best way, and are merged from the A* results of those.
The result equals a search over the lattice of the whole text.

A character without a piece is spelled in bytes, as is the word mark where the text itself has one, so decoding gives the text back,
white space included.  A space stands before the text, as sentencepiece adds it.

Defined cases: a null text is empty; an empty text has the one segmentation of the added space; fewer than N segmentations give
fewer results; of equal scores the order is fixed by the search; repeated rows give repeated results; other columns are kept, but
``piece_ids``, ``n_best`` and ``decoded`` are replaced.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, fields
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumbre.llm.common import tokenizer_path
from lumbre.llm.lattice import MARK, Pieces, by_length, codes_of, pieces

#: Units that a worker remembers before it forgets those that it has met once only.
REMEMBERED = 100_000
#: Documents that are segmented together.
TOGETHER = 1_000
#: What spelling a character in bytes costs below the lowest score.
SPELLING = 10.0
TYPE = "array<struct<score: double, changes: array<struct<at: int, drop: int, ids: array<int>>>>>"


class Vocabulary:
    """Pieces and scores of a model file; ``starts`` also has every beginning of a piece."""

    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.score = [model.get_score(i) for i in range(model.get_piece_size())]
        self.bytes_of: list[bytes] = []
        self.byte_ids = [0] * 256
        self.starts: dict[str, int] = {}
        for i, score in enumerate(self.score):
            piece = model.id_to_piece(i)
            self.bytes_of.append(piece.replace(MARK, " ").encode())
            if model.is_byte(i):
                self.byte_ids[int(piece[1:-1], 16)] = i
                self.bytes_of[i] = bytes([int(piece[1:-1], 16)])
            # Runs of the word mark carry a score that forbids them; the mark alone is needed for spaces.
            elif not (model.is_control(i) or model.is_unknown(i)) and (score > -1e8 or piece == MARK):
                self.starts[piece] = i
                for k in range(1, len(piece)):
                    self.starts.setdefault(piece[:k], -1)
        self.spelled = min(s for s in self.score if s > -1e8) - SPELLING
        self.score[self.starts[MARK]] = self.spelled

    def arcs(self, unit: str) -> list[tuple[int, int, tuple[int, ...], float]]:
        """(start, end, pieces, score) of a unit, by start."""
        out = []
        for i in range(len(unit)):
            alone = False
            for j in range(i + 1, len(unit) + 1):
                piece = self.starts.get(unit[i:j])
                if piece is None:
                    break
                if piece >= 0:
                    out.append((i, j, (piece,), self.score[piece]))
                    alone = alone or j == i + 1
            if not alone:
                out.append((i, i + 1, tuple(self.byte_ids[b] for b in unit[i].encode()), self.spelled))
        return out

    @staticmethod
    def viterbi(length: int, arcs: list) -> tuple[list[float], list]:
        """Best score to each position, and the arc it comes by."""
        best, by = [0.0] + [-1e300] * length, [None] * (length + 1)
        for arc in arcs:
            score = best[arc[0]] + arc[3]
            if score > best[arc[1]]:
                best[arc[1]], by[arc[1]] = score, arc
        return best, by

    def summary(self, text: str) -> tuple[float, float, tuple[int, ...]]:
        """Score of the best way through a unit, loss of the second best (infinite if there is none), pieces of the best."""
        unit = _marked(text)
        if unit == MARK and text == MARK:
            return self.spelled, float("inf"), tuple(self.byte_ids[b] for b in unit.encode())
        arcs = self.arcs(unit)
        best, by = self.viterbi(len(unit), arcs)
        path, at = [], len(unit)
        while at:
            path.append(by[at])
            at = by[at][0]
        rest = [-1e300] * len(unit) + [0.0]
        chosen, second = set(map(id, path)), -1e300
        for arc in reversed(arcs):
            after = arc[3] + rest[arc[1]]
            if after > rest[arc[0]]:
                rest[arc[0]] = after
            if best[arc[0]] + after > second and id(arc) not in chosen:
                second = best[arc[0]] + after
        loss = best[-1] - second if second > -1e299 else float("inf")
        return best[-1], loss, tuple(i for arc in reversed(path) for i in arc[2])

    def n_best(self, text: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The ``n`` best ways through a unit by backward A* search, best first; the first is the Viterbi path."""
        score, loss, first = self.summary(text)
        if n == 1 or loss == float("inf"):
            return [(score, first)]
        unit = _marked(text)
        arcs = self.arcs(unit)
        best, _ = self.viterbi(len(unit), arcs)
        into: list[list] = [[] for _ in range(len(unit) + 1)]
        for arc in arcs:
            into[arc[1]].append(arc)
        queue, made, found = [(-best[-1], 0, len(unit), 0.0, ())], 0, []
        while queue and len(found) <= n:
            estimate, _, at, behind, ids = heapq.heappop(queue)
            if at == 0:
                found.append((-estimate, ids))
                continue
            for arc in into[at]:
                made += 1
                heapq.heappush(queue, (-(best[arc[0]] + arc[3] + behind), made, arc[0], arc[3] + behind, arc[2] + ids))
        return [(score, first), *(x for x in found if x[1] != first)][:n]


def _marked(text: str) -> str:
    return MARK + text[1:] if text[0] == " " else text


@lru_cache(maxsize=2)
def vocabulary(model_file: str) -> Vocabulary:
    return Vocabulary(model_file)


@dataclass
class Known:
    """What is known of units: score, loss of the second-best way, number of pieces; ``pieces`` has those of all units one after the other."""

    scores: np.ndarray
    losses: np.ndarray
    lengths: np.ndarray
    pieces: np.ndarray

    @staticmethod
    def joined(parts: list[Known]) -> Known:
        return Known(*(np.concatenate([getattr(p, f.name) for p in parts]) for f in fields(Known)))


def nothing_known() -> Known:
    return Known(np.empty(0), np.empty(0), np.empty(0, np.int64), np.empty(0, np.int32))


def summaries(v: Vocabulary, table: Pieces, texts: list[str]) -> tuple[list[int], Known]:
    """What ``Vocabulary.summary`` says of each unit, for many at once, with the order of the units in it.

    Units of one length are a matrix; the recursions are those of the single unit, step by step for all rows.
    """
    units = [MARK if t == MARK else _marked(t) for t in texts]
    scores = np.array([*v.score, 0.0])
    order: list[int] = []
    parts, odd = [nothing_known()], []
    for rows in by_length(units):
        if rows.size:
            plain, known = _summarise(table, scores, texts, units, rows)
            order += rows[plain].tolist()
            odd += rows[~plain].tolist()
            parts.append(known)
    # Units with a character that is spelled are few and go one by one.
    for r in odd:
        score, loss, ids = v.summary(texts[r])
        parts.append(Known(np.array([score]), np.array([loss]), np.array([len(ids)]), np.array(ids, np.int32)))
    return order + odd, Known.joined(parts)


def _summarise(table: Pieces, scores: np.ndarray, texts: list[str], units: list[str], rows: np.ndarray) -> tuple[np.ndarray, Known]:
    """Which of the rows need no spelling, and what is known of those."""
    codes = codes_of("".join(units[r] for r in rows)).reshape(len(rows), -1)
    n, length = codes.shape
    arcs: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
    odd = np.array([texts[r] == MARK for r in rows])
    for start in range(length):
        on, h = np.arange(n), np.zeros(n, np.uint64)
        for end in range(start + 1, min(length, start + table.longest) + 1):
            h = table.extended(h, codes[on, end - 1])
            goes_on, found = table.find(h)
            hit = np.flatnonzero(found < table.size)
            if end == start + 1:
                odd |= found == table.size
            if hit.size:
                arcs[start, end] = on[hit], found[hit]
            if not goes_on.any():
                break
            if not goes_on.all():
                on, h = on[goes_on], h[goes_on]
    best = np.full((length + 1, n), -1e300)
    best[0] = 0
    by = np.zeros((length + 1, n), np.int32)
    by_piece = np.zeros((length + 1, n), np.int32)
    for end in range(1, length + 1):
        for start in range(max(0, end - table.longest), end):
            if (start, end) in arcs:
                on, found = arcs[start, end]
                score = best[start, on] + scores[found]
                better = score > best[end, on]
                on = on[better]
                best[end, on], by[end, on], by_piece[end, on] = score[better], start, found[better]
    rest = np.full((length + 1, n), -1e300)
    rest[length] = 0
    for start in range(length - 1, -1, -1):
        for end in range(start + 1, min(length, start + table.longest) + 1):
            if (start, end) in arcs:
                on, found = arcs[start, end]
                rest[start, on] = np.maximum(rest[start, on], scores[found] + rest[end, on])
    chosen = np.full((length + 1, n), -1, np.int32)
    path = np.full((length, n), -1, np.int32)
    at, every = np.full(n, length), np.arange(n)
    at[odd] = 0
    for step in range(length):
        live = every[at > 0]
        if not live.size:
            break
        ends = at[live]
        chosen[ends, live] = by[ends, live]
        path[length - 1 - step, live] = by_piece[ends, live]
        at[live] = by[ends, live]
    second = np.full(n, -1e300)
    for (start, end), (on, found) in arcs.items():
        other = chosen[end, on] != start
        on = on[other]
        second[on] = np.maximum(second[on], best[start, on] + scores[found[other]] + rest[end, on])
    loss = np.where(second > -1e299, best[length] - second, np.inf)
    plain = ~odd
    path = path.T[plain]
    used = path >= 0
    return plain, Known(best[length][plain], loss[plain], used.sum(axis=1), path[used])


class _Memory:
    """What a worker knows of units, by number: times met, and N best ways when asked."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.known, self.starts, self.met = nothing_known(), np.empty(0, np.int64), np.empty(0, np.int64)
        self.ways: dict[int, list] = {}

    def learn(self, units: list[str], known: Known) -> None:
        self.number.update(zip(units, range(len(self.met), len(self.met) + len(units))))
        self._hold(Known.joined([self.known, known]))
        self.met = np.concatenate((self.met, np.zeros(len(units), np.int64)))

    def _hold(self, known: Known) -> None:
        self.known, self.starts = known, np.cumsum(known.lengths) - known.lengths

    def forget(self) -> None:
        """Keep units met twice or more; of too many of those, none."""
        keep = self.met > 1
        if keep.sum() > REMEMBERED // 2:
            keep[:] = False
        place = (np.cumsum(keep) - 1).tolist()
        kept, k = keep.tolist(), self.known
        self.number = {unit: place[i] for unit, i in self.number.items() if kept[i]}
        self._hold(Known(k.scores[keep], k.losses[keep], k.lengths[keep], k.pieces[np.repeat(keep, k.lengths)]))
        self.met, self.ways = self.met[keep] // 2, {}


_memories: dict[str, _Memory] = {}


def cut_units(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The units of all texts, one after the other, and where those of each text begin and end.

    A unit begins at a space, a line break or a word mark, and after a line break or a word mark; the cuts are found in the UTF-8 bytes.
    """
    spaced = pc.binary_join_element_wise(pa.scalar(" "), texts, pa.scalar(""))
    ends = np.frombuffer(spaced.buffers()[1], np.int32)[spaced.offset : spaced.offset + len(spaced) + 1]
    data = np.frombuffer(spaced.buffers()[2], np.uint8)[: ends[-1]]
    cuts = np.zeros(len(data) + 1, bool)
    breaks = data == 10
    cuts[:-1] = breaks | (data == 32)
    cuts[1:] |= breaks
    first, second, third = MARK.encode()
    marks = np.flatnonzero((data[:-2] == first) & (data[1:-1] == second) & (data[2:] == third))
    cuts[marks] = cuts[marks + 3] = True
    cuts[-1] = False
    at = np.flatnonzero(cuts)
    offsets = np.append(at, len(data)).astype(np.int32)
    return pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(data)), np.searchsorted(at, ends)


def segment(model_file: str, texts: pa.Array, n: int) -> tuple[pa.Array, list[list]]:
    """For each text: pieces of the best segmentation, and (score, changes) of the ``n`` best.

    A change (at, drop, ids) puts ids in the place of ``drop`` pieces of the best segmentation from ``at``.
    """
    v = vocabulary(model_file)
    memory = _memories.setdefault(model_file, _Memory())
    if len(memory.number) > REMEMBERED:
        memory.forget()
    units, ends = cut_units(texts)
    # Only different units are looked up.
    coded = units.dictionary_encode()
    names = coded.dictionary.to_pylist()
    new = [u for u in names if u not in memory.number]
    order, known = summaries(v, pieces(model_file), new)
    memory.learn([new[k] for k in order], known)
    numbers = np.fromiter(map(memory.number.__getitem__, names), np.int64, len(names))[coded.indices.to_numpy()]
    memory.met += np.bincount(numbers, minlength=len(memory.met))
    lengths = memory.known.lengths[numbers]
    upto = np.concatenate(([0], np.cumsum(lengths)))
    # Place of each piece in what is known: where its unit's pieces start, and its place among them.
    source = np.repeat(memory.starts[numbers] - upto[:-1], lengths) + np.arange(upto[-1])
    lists = pa.ListArray.from_arrays(pa.array(upto[ends].astype(np.int32)), pa.array(memory.known.pieces[source]))
    scores, losses = memory.known.scores[numbers], memory.known.losses[numbers]
    ways = []
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
        ways.append(_ways(v, memory, units, numbers[a:b], scores[a:b], losses[a:b], upto[a : b + 1], a, n))
    return lists, ways


def _ways(v: Vocabulary, memory: _Memory, units: pa.Array, numbers: np.ndarray, scores: np.ndarray, loss: np.ndarray, upto: np.ndarray, first: int, n: int) -> list:
    best = float(scores.sum())
    merged: list[tuple[float, tuple]] = [(0.0, ())]
    # The n - 1 units with the least loss, the first of equal ones.
    limit = -np.inf if n == 1 else np.partition(loss, n - 2)[n - 2] if n <= len(loss) else np.inf
    loose = np.flatnonzero(loss < limit).tolist()
    loose = sorted(loose + np.flatnonzero((loss == limit) & (loss < np.inf))[: n - 1 - len(loose)].tolist())
    for at in loose:
        k = int(numbers[at])
        if k not in memory.ways:
            memory.ways[k] = v.n_best(units[first + at].as_py(), n)
        top, ways = float(memory.known.scores[k]), memory.ways[k]
        merged = heapq.nsmallest(n, ((lost + top - score, changed + ((at, ids),) if j else changed) for lost, changed in merged for j, (score, ids) in enumerate(ways)), key=lambda x: x[0])
    return [(best - lost, [{"at": int(upto[at] - upto[0]), "drop": int(upto[at + 1] - upto[at]), "ids": list(ids)} for at, ids in changed]) for lost, changed in merged]


def _texts(lists: pa.ListArray, bytes_of: list[bytes]) -> pa.Array:
    """The text of each list of pieces, without the space that was added before it."""
    ends, ids = lists.offsets.to_numpy(), lists.values.to_numpy()
    return pa.array([b"".join(map(bytes_of.__getitem__, ids[a:b].tolist())).decode("utf-8", "replace")[1:] for a, b in zip(ends, ends[1:])], pa.string())


def _encode(model_file: str, n: int, text_at: int, decoded: bool):
    kind = pa.list_(pa.struct([("score", pa.float64()), ("changes", pa.list_(pa.struct([("at", pa.int32()), ("drop", pa.int32()), ("ids", pa.list_(pa.int32()))])))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(at, TOGETHER)
                lists, made = segment(model_file, part.column(0).field(text_at).cast(pa.string()).fill_null(""), n)
                ways = pa.array([[{"score": s, "changes": c} for s, c in w] for w in made], kind)
                columns, names = [part.column(0), lists, ways], ["_row", "piece_ids", "n_best"]
                if decoded:
                    columns, names = [*columns, _texts(lists, vocabulary(model_file).bytes_of)], [*names, "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _decode(model_file: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bytes_of = vocabulary(model_file).bytes_of
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                lists = part.column(1).fill_null([]) if part.column(1).null_count else part.column(1)
                yield pa.RecordBatch.from_arrays([part.column(0), _texts(lists, bytes_of)], ["_row", "decoded"])

    return run


def _whole(df: DataFrame) -> Column:
    """A row as one struct, so that no column of the user meets a name of this module."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row")


def encode_n_best(docs: DataFrame, n: int = 4, text_col: str = "text", model_file: str | None = None, decoded: bool = False) -> DataFrame:
    """``docs`` with ``piece_ids`` of the best segmentation and ``n_best``: score and changes to piece_ids of each of the N best.

    With ``decoded``, also the text that the pieces give back, made in the same pass.  Columns of these names are replaced.
    """
    rows = docs.select(_whole(docs))
    new = {"piece_ids": "array<int>", "n_best": TYPE, **({"decoded": "string"} if decoded else {})}
    schema = rows.withColumns({name: F.lit(None).cast(kind) for name, kind in new.items()}).schema
    made = rows.mapInArrow(_encode(model_file or tokenizer_path(), n, docs.columns.index(text_col), decoded), schema)
    kept = [F.col(f"_row.`{c}`").alias(c) for c in docs.columns if c not in new]
    return made.select(*kept, *new)


def decode(encoded: DataFrame, model_file: str | None = None) -> DataFrame:
    """``encoded`` with ``decoded``, the text of ``piece_ids``; a column of that name is replaced."""
    rows = encoded.select(_whole(encoded), F.col("piece_ids"))
    made = rows.mapInArrow(_decode(model_file or tokenizer_path()), rows.select("_row", F.lit(None).cast("string").alias("decoded")).schema)
    kept = [F.col(f"_row.`{c}`").alias(c) for c in encoded.columns if c != "decoded"]
    return made.select(*kept, "decoded")
