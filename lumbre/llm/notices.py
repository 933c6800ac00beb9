"""Search for short licence notices, exact and with a few errors.

Texts become lower-case words joined by single spaces.  A notice that may have k errors is split into k + 1 pieces; whatever has at
most k errors contains one of the pieces unchanged (pigeonhole), so exact searches for the pieces find all places worth a look.
Around each the regular-expression library verifies the notice with bounded errors and gives its span.

Errors are letters: a digit is never changed into another, and the number at the end of a notice has to be exact.

Defined cases: a null text is empty; a text without notices has no labels and a score of 0; places are counted whole, overlapping ones
too; repeated rows give repeated results; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumbre.llm.common import text_of

# Notices and labels.
BASE_NOTICES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)
MORE_NOTICES = (
    ("creative commons attribution noncommercial", "cc-by-nc"),
    ("creative commons attribution sharealike", "cc-by-sa"),
    ("gnu affero general public license", "agpl"),
    ("gnu general public license version 2", "gpl-2"),
    ("gnu general public license version 3", "gpl-3"),
    ("gnu lesser general public license", "lgpl"),
    ("mozilla public license version 2", "mpl-2"),
    ("redistribution and use in source and binary forms", "bsd"),
)
#: A notice may have one error for so many letters; shorter ones have to be exact.
LETTERS_PER_ERROR = 12
#: Bytes of words: digits, a-z and all bytes beyond ASCII; A-Z turns into a-z, the rest into spaces.
TABLE = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
SPANS = "array<struct<label: string, start_word: bigint, found: string, errors: int>>"


@dataclass(frozen=True)
class Notice:
    phrase: str
    label: str
    errors: int
    #: (piece, its distance from the beginning of the phrase)
    seeds: tuple[tuple[bytes, int], ...]
    pattern: regex.Pattern


def notice(phrase: str, label: str, letters_per_error: int = LETTERS_PER_ERROR) -> Notice:
    errors = len(phrase) // letters_per_error
    words = phrase.split(" ")
    tail = f" {words[-1]}" if words[-1].isdigit() else ""
    free = phrase[: len(phrase) - len(tail)]
    cuts = [len(free) * k // (errors + 1) for k in range(errors + 2)]
    seeds = tuple((free[a:b].encode(), a) for a, b in zip(cuts, cuts[1:]))
    # Between spaces, so that it begins and ends with a word.
    pattern = regex.compile(f"(?b)(?<= )(?:{regex.escape(free, literal_spaces=True)}){{e<={errors}:[^0-9]}}{tail}(?= )")
    return Notice(phrase, label, errors, seeds, pattern)


def normalised_words(text: str | None) -> bytes:
    """Words joined by single spaces, with a space at either end."""
    return b" " + b" ".join((text or "").encode().translate(TABLE).split()) + b" "


def places(data: bytes, piece: bytes) -> Iterator[int]:
    at = data.find(piece)
    while at >= 0:
        yield at
        at = data.find(piece, at + 1)


class _Words:
    """Numbers of words by the place of the space before them; the spaces are looked up once, and only if asked."""

    def __init__(self, data: bytes):
        self.data, self.spaces = data, None

    def __call__(self, place: int) -> int:
        if self.spaces is None:
            self.spaces = np.flatnonzero(np.frombuffer(self.data, np.uint8) == 32)
        return int(np.searchsorted(self.spaces, place))


def _window(data: bytes, begin: int, end: int) -> tuple[int, str]:
    """Text between the spaces around a span, and where it begins."""
    begin, end = max(0, begin), min(len(data), end)
    a, b = data.rfind(b" ", 0, begin + 1), data.find(b" ", max(end - 1, 0))
    a, b = max(a, 0), len(data) if b < 0 else b + 1
    return a, data[a:b].decode()


def find_fuzzy(data: bytes, one: Notice) -> dict[int, tuple[int, str]]:
    """Errors and text of each verified place, by the byte at which it begins."""
    found: dict[int, tuple[int, str]] = {}
    for begin in sorted({at - offset for seed, offset in one.seeds for at in places(data, seed)}):
        reach = 4 * one.errors + 1  # a letter has up to four bytes
        start, text = _window(data, begin - reach, begin + len(one.phrase) + reach)
        for m in one.pattern.finditer(text, overlapped=True):
            at = start + len(text[: m.start()].encode())
            errors = sum(m.fuzzy_counts)
            if at not in found or errors < found[at][0]:
                found[at] = (errors, m[0])
    return found


def scan(text: str | None, base: list[Notice], more: list[Notice]) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, spans."""
    data = normalised_words(text)
    words = data.count(b" ") - 1 if len(data) > 2 else 0
    starts, base_labels, spans, score = [], set(), {}, 0.0
    word_at = _Words(data)
    for one in base:
        exact = [word_at(at) for at in places(data, f" {one.phrase} ".encode())]
        if exact:
            starts += exact
            base_labels.add(one.label)
    for one in [*base, *more]:
        for at, (errors, got) in find_fuzzy(data, one).items():
            spans[one.label, word_at(at - 1)] = (got, errors)
            score = max(score, 1 - errors / len(one.phrase))
    labels = base_labels | {label for label, _ in spans}
    rows = [{"label": k, "start_word": w, "found": g, "errors": e} for (k, w), (g, e) in sorted(spans.items(), key=lambda x: (x[0][1], x[0][0]))]
    return words, len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base_labels)), ",".join(sorted(labels)), score, rows


def _scan_batches(letters_per_error: int):
    kind = pa.list_(pa.struct([("label", pa.string()), ("start_word", pa.int64()), ("found", pa.string()), ("errors", pa.int32())]))
    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), kind]
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, more = ([notice(p, x, letters_per_error) for p, x in group] for group in (BASE_NOTICES, MORE_NOTICES))
        for batch in batches:
            made = [scan(x.as_py(), base, more) for x in batch["_text"]]
            columns = zip(*made) if made else [[]] * len(types)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(list(c), t) for c, t in zip(columns, types))], ["doc_id", *names])

    return run


def scan_notices(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", letters_per_error: int = LETTERS_PER_ERROR) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, and ``spans`` of all verified places."""
    plain = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("_text"))
    kind = plain.schema["doc_id"].dataType.simpleString()
    return plain.mapInArrow(
        _scan_batches(letters_per_error), f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans {SPANS}"
    )
