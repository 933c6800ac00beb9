"""The lattice of vocabulary pieces over words, for many words at once, in NumPy.

Words of one length form a matrix of code points.  The recursions run over positions and, at each, over the pieces that end
there; every step handles all words of the matrix.  All sums over segmentations are in log space.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from lumbre.llm.shingles import mix

MARK = "▁"
NEVER = -1e30
STEP = np.uint64(0xD6E8FEB86659FD93)
SLOTS = 1 << 20
#: Cells of one matrix of words; bounds memory whatever the batch.
CELLS = 1_000_000


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


class Pieces:
    """A sentencepiece vocabulary: normal pieces by hash of their code points, byte pieces, and the vocabulary's own scores."""

    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.size = model.get_piece_size()
        self.scores = np.array([model.get_score(i) for i in range(self.size)])
        self.text = [model.id_to_piece(i) for i in range(self.size)]
        self.byte_ids = np.zeros(256, np.int64)
        self.normal: dict[str, int] = {}
        for i, piece in enumerate(self.text):
            if model.is_byte(i):
                self.byte_ids[int(piece[1:-1], 16)] = i
            # Runs of the word mark carry a score that forbids them; the mark alone is needed before words without a marked piece.
            elif not (model.is_control(i) or model.is_unknown(i)) and (self.scores[i] > -1e8 or piece == MARK):
                self.normal[piece] = i
        self.longest = max(map(len, self.normal))
        # All beginnings of pieces; a beginning that is no piece has the number ``size``.
        starts: dict[int, int] = {}
        for piece, i in self.normal.items():
            h = 0
            for c in piece:
                h = (h + ord(c) + 1) * int(STEP) % 2**64
                starts.setdefault(h, self.size)
            starts[h] = i
        self.keys = np.array([*starts, 0], np.uint64)
        self.numbers = np.array([*starts.values(), self.size], np.int64)
        self.slots = [np.full(SLOTS, len(starts), np.int32) for _ in range(4)]
        waiting = np.arange(len(starts))
        for slots, at in zip(self.slots, self._places(self.keys)):
            # The first of those that share a slot takes it; the others go to the next table.
            _, first = np.unique(at[waiting], return_index=True)
            slots[at[waiting[first]]] = waiting[first]
            waiting = np.delete(waiting, first)
        if len(waiting):
            raise ValueError("piece table too full")

    @staticmethod
    def extended(h: np.ndarray, codes: np.ndarray) -> np.ndarray:
        return (h + codes.astype(np.uint64) + np.uint64(1)) * STEP

    @staticmethod
    def _places(h: np.ndarray) -> list[np.ndarray]:
        m = mix(h)
        return [(m >> np.uint64(s)).astype(np.int64) & (SLOTS - 1) for s in (0, 14, 28, 42)]

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes begin a piece, and the numbers of those that are one (``size`` for the others)."""
        last = len(self.keys) - 1
        at = np.full(len(h), last, np.int32)
        for slots, place in zip(self.slots, self._places(h)):
            k = slots[place]
            np.copyto(at, k, where=(self.keys[k] == h) & (k < last))
        return at < last, self.numbers[at]

    def prior(self) -> np.ndarray:
        """Probabilities from the vocabulary's scores.  They are minus ranks, so weights fall with the rank; pieces that may not be used have none."""
        weight = np.zeros(self.size)
        usable = list(self.normal.values())
        weight[usable] = 1 / np.minimum(2.0 - self.scores[usable], self.size)
        weight[self.byte_ids] = 1 / self.size
        return weight / weight.sum()


@lru_cache(maxsize=2)
def pieces(model_file: str) -> Pieces:
    return Pieces(model_file)


def by_length(words: list[str]) -> list[np.ndarray]:
    """Row numbers of ``words`` in groups of one length and at most CELLS code points, or one word."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(lengths, kind="stable")
    out = []
    for group in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
        if len(group):
            step = max(1, CELLS // max(1, int(lengths[group[0]])))
            out += [group[k : k + step] for k in range(0, len(group), step)]
    return out


class Lattice:
    """All segmentations of words of one length: arcs (start, end) with the rows that have them and their piece numbers.

    Arcs of one character are there for every row; a character without a piece is spelled in bytes.
    """

    def __init__(self, vocabulary: Pieces, words: list[str]):
        self.v = vocabulary
        self.codes = codes_of("".join(words)).reshape(len(words), -1)
        self.length = self.codes.shape[1]
        self.single: list[np.ndarray] = []
        self.arcs: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for start in range(self.length):
            rows, h = np.arange(len(words)), np.zeros(len(words), np.uint64)
            for end in range(start + 1, min(self.length, start + vocabulary.longest) + 1):
                h = vocabulary.extended(h, self.codes[rows, end - 1])
                goes_on, found = vocabulary.find(h)
                if end == start + 1:
                    self.single.append(found)
                elif (hit := np.flatnonzero(found < vocabulary.size)).size:
                    self.arcs[start, end] = rows[hit], found[hit]
                if not goes_on.any():
                    break
                if not goes_on.all():
                    rows, h = rows[goes_on], h[goes_on]

    def weights(self, logs: np.ndarray) -> tuple[list, dict]:
        """Weights by class of the arcs of one character, and of the longer ones; ``logs`` has a row for each piece and a last one."""
        single = []
        for start, found in enumerate(self.single):
            w = logs[found]
            if (alone := np.flatnonzero(found == self.v.size)).size:
                chars, at = np.unique(self.codes[alone, start], return_inverse=True)
                spelled = np.array([logs[self.v.byte_ids[list(chr(c).encode())]].sum(axis=0) for c in chars])
                w[alone] = spelled[at]
            single.append(w)
        return single, {k: logs[found] for k, (_, found) in self.arcs.items()}

    def forward(self, weights: tuple[list, dict], classes: int) -> np.ndarray:
        """Log of the summed weight of all ways to each position: (length + 1, words, classes).

        The way over the last character alone exists always; the others are added relative to it.
        """
        single, longer = weights
        out = np.zeros((self.length + 1, len(self.codes), classes))
        for end in range(1, self.length + 1):
            last, total = out[end - 1] + single[end - 1], np.ones((len(self.codes), classes))
            for start in range(max(0, end - self.v.longest), end - 1):
                if (start, end) in longer:
                    rows = self.arcs[start, end][0]
                    total[rows] += np.exp(out[start, rows] + longer[start, end] - last[rows])
            out[end] = last + np.log(total)
        return out

    def backward(self, weights: tuple[list, dict], classes: int) -> np.ndarray:
        single, longer = weights
        out = np.zeros((self.length + 1, len(self.codes), classes))
        for start in range(self.length - 1, -1, -1):
            first, total = out[start + 1] + single[start], np.ones((len(self.codes), classes))
            for end in range(start + 2, min(self.length, start + self.v.longest) + 1):
                if (start, end) in longer:
                    rows = self.arcs[start, end][0]
                    total[rows] += np.exp(longer[start, end] + out[end, rows] - first[rows])
            out[start] = first + np.log(total)
        return out

    def expected(self, logs: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected uses of each piece over ``counts`` of the words, for one class."""
        single, longer = weights = self.weights(logs[:, None])
        ahead, behind = self.forward(weights, 1)[..., 0], self.backward(weights, 1)[..., 0]
        used, shares = [], []
        for (start, end), (rows, found) in self.arcs.items():
            used.append(found)
            shares.append(np.exp(ahead[start, rows] + longer[start, end][:, 0] + behind[end, rows] - ahead[-1, rows]) * counts[rows])
        for start, found in enumerate(self.single):
            share = np.exp(ahead[start] + single[start][:, 0] + behind[start + 1] - ahead[-1]) * counts
            used.append(found)
            shares.append(share)
            for row in np.flatnonzero(found == self.v.size):
                spelled = self.v.byte_ids[list(chr(self.codes[row, start]).encode())]
                used.append(spelled)
                shares.append(np.full(len(spelled), share[row]))
        return np.bincount(np.concatenate(used), np.concatenate(shares), self.v.size + 1)[:-1]


def log_likelihoods(vocabulary: Pieces, words: list[str], logs: np.ndarray) -> np.ndarray:
    """Log of the marginal probability of each word, by class: (words, classes)."""
    out = np.zeros((len(words), logs.shape[1]))
    for rows in by_length(words):
        if len(words[rows[0]]):
            lattice = Lattice(vocabulary, [words[r] for r in rows])
            out[rows] = lattice.forward(lattice.weights(logs), logs.shape[1])[-1]
    return out


def expected_counts(vocabulary: Pieces, words: list[str], logs: np.ndarray, counts: np.ndarray) -> np.ndarray:
    total = np.zeros(vocabulary.size)
    for rows in by_length(words):
        if len(words[rows[0]]):
            total += Lattice(vocabulary, [words[r] for r in rows]).expected(logs, counts[rows])
    return total
