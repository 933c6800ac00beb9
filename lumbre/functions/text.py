"""Column functions over text cells: multi-label cells, accents, names, headers."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F



def _base_letter(letter: str) -> str:
    """What is left of a letter when its marks are taken off."""
    return "".join(c for c in unicodedata.normalize("NFKD", letter) if not unicodedata.combining(c))


# Letters below U+2000 that are one base letter with marks, by Unicode's own decompositions.
_MARKED = {chr(c): base for c in range(0xC0, 0x2000) if chr(c).isalpha() and len(base := _base_letter(chr(c))) == 1 and base != chr(c)}
ACCENTED, UNACCENTED = "".join(_MARKED), "".join(_MARKED.values())
#: Marks that stand by themselves.
MARKS = r"\p{M}+"
# Cell contents that mean "missing".
MISSING_MARKERS = ("", "x", "nan", "none")


def strip_accents(text: Column) -> Column:
    """Lower-case the text, replace marked letters by their base letter and remove marks of their own."""
    return F.regexp_replace(F.translate(F.lower(text), ACCENTED, UNACCENTED), MARKS, "")


def normalise_text(text: Column) -> Column:
    """Lower-case, strip accents, collapse white space, trim."""
    return F.trim(F.regexp_replace(strip_accents(text), r"\s+", " "))


def is_missing_marker(text: Column) -> Column:
    return text.isNull() | F.lower(F.trim(text)).isin(*MISSING_MARKERS)


def missing_to_null(text: Column, level: str | None = None) -> Column:
    """Replace missing markers by null, or by an explicit level when one is given."""
    return F.when(is_missing_marker(text), F.lit(level)).otherwise(F.trim(text))


def split_labels(cell: Column, sep: str = ",") -> Column:
    """Parse a multi-label cell to a sorted array of distinct labels; missing gives an empty array."""
    parts = F.transform(F.split(cell, sep), lambda p: F.trim(p))
    kept = F.filter(parts, lambda p: ~F.lower(p).isin(*MISSING_MARKERS))
    return F.coalesce(F.array_sort(F.array_distinct(kept)), F.array().cast("array<string>"))


def canonical_cell(cell: Column, sep: str = ",") -> Column:
    """Trim, drop blanks around separators, deduplicate and sort a multi-label cell."""
    return F.array_join(split_labels(cell, sep), sep)


def slug(text: Column) -> Column:
    return F.regexp_replace(text, r"[^A-Za-z0-9_-]", "_")


def label_to_name(label: str) -> str:
    """Column name for a label value."""
    return label.strip().replace(" ", "_")


def yes_no(text: Column) -> Column:
    """Free-text yes / no to 'S' / 'N'; other text passes through in upper case."""
    clean = normalise_text(text)
    return (
        F.when(clean.isin("si", "s", "yes", "y", "1", "true"), "S")
        .when(clean.isin("no", "n", "0", "false"), "N")
        .otherwise(F.upper(clean))
    )


def two_value_recode(text: Column, positive: str, negative: str) -> Column:
    return F.when(text == positive, 1).when(text == negative, 0)


def free_label_binary(label: Column, positive) -> Column:
    return F.coalesce((label == F.lit(positive)).cast("int"), F.lit(0))


def recode(text: Column, mapping: dict[str, str]) -> Column:
    """Merge category synonyms; values that are not in the mapping stay as they are."""
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return F.coalesce(F.try_element_at(table, text), text)


def header_map(text: Column, pair_sep: str = "\n", key_sep: str = "=") -> Column:
    """``key = value`` lines to a map with trimmed keys and values."""
    lines = F.filter(F.split(text, pair_sep), lambda line: F.instr(line, key_sep) > 0)
    pairs = F.transform(
        lines,
        lambda line: F.struct(
            F.trim(F.substring_index(line, key_sep, 1)).alias("k"),
            F.trim(F.regexp_replace(line, f"^[^{key_sep}]*{key_sep}", "")).alias("v"),
        ),
    )
    return F.map_from_entries(pairs)


def number_list(text: Column) -> Column:
    """White-space separated numbers to ``array<double>``; text that is no number gives null."""
    return F.transform(F.split(F.trim(text), r"\s+"), lambda p: p.try_cast("double"))


def feature_name_parts(name: Column, masks: list[str], channels: list[str], families: list[str]) -> Column:
    """Parse ``mask_channel_imagetype_family_feature`` names to a struct."""
    mask_re = "^(" + "|".join(masks) + ")_"
    channel_re = "(?:^|_)(" + "|".join(channels) + ")_"
    family_re = "_(" + "|".join(families) + ")_"
    rest = F.regexp_replace(F.regexp_replace(name, mask_re, ""), "^(" + "|".join(channels) + ")_", "")

    def blank(c: Column) -> Column:
        return F.when(c == "", F.lit("other")).otherwise(c)

    return F.struct(
        blank(F.regexp_extract(name, mask_re, 1)).alias("mask"),
        blank(F.regexp_extract(name, channel_re, 1)).alias("channel"),
        blank(F.regexp_extract(rest, r"^([^_]+)_", 1)).alias("image_type"),
        blank(F.regexp_extract(name, family_re, 1)).alias("family"),
    )


def right_split(text: Column, separator: str) -> Column:
    """Struct of what stands before and after the last separator; without one the whole text is the head and the tail is null."""
    found = F.instr(text, separator) > 0
    tail = F.substring_index(text, separator, -1)
    head = F.substring(text, F.lit(1), F.length(text) - F.length(tail) - len(separator))
    return F.struct(F.when(found, head).otherwise(text).alias("head"), F.when(found, tail).alias("tail"))


def trailing_number(text: Column, marker: str) -> Column:
    """Number that follows a marker in a file or configuration label (for example a batch size)."""
    return F.regexp_extract(text, marker + r"(\d+)", 1).try_cast("int")
