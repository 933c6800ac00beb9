"""Stable keys: hash order, paired seeds, configuration ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Modulus of the paired seed.
SEED_MODULUS = 2147483647


def joined(*parts, sep: str = "|") -> Column:
    return F.concat_ws(sep, *[(p if isinstance(p, Column) else F.lit(p)).cast("string") for p in parts])


def stable_seed(*parts) -> Column:
    """Seed from the first 8 hex digits of the SHA-256 of the parts."""
    return (F.conv(F.substring(F.sha2(joined(*parts), 256), 1, 8), 16, 10).cast("bigint") % SEED_MODULUS).cast("bigint")


def hash_order(seed, *ids) -> Column:
    """Text whose sort order is a fixed pseudo-random order of the ids for this seed."""
    return F.md5(joined(seed, *ids))


def hash_unit(seed, *ids) -> Column:
    """Number in [0, 1) that depends only on the seed and the ids."""
    return F.conv(F.substring(hash_order(seed, *ids), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def configuration_id(columns: list[str]) -> Column:
    """SHA-256 of the sorted-key JSON of a configuration row."""
    return F.sha2(sorted_json(columns), 256)


def sorted_json(columns: list[str]) -> Column:
    return F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})


def with_defaults(params: Column, defaults: dict[str, str], overwrite: dict[str, str] | None = None) -> Column:
    """Map of settings with defaults for missing fields and fixed values for others; null settings are empty."""
    def literal(values: dict[str, str]) -> Column:
        return F.create_map(*[F.lit(x) for pair in values.items() for x in pair]) if values else F.from_json(F.lit("{}"), "map<string,string>")

    fixed = overwrite or {}
    given = F.map_filter(F.coalesce(params, F.from_json(F.lit("{}"), "map<string,string>")), lambda k, v: v.isNotNull() & ~k.isin(*fixed))
    missing = F.map_filter(literal({k: v for k, v in defaults.items() if k not in fixed}), lambda k, _: ~F.coalesce(F.map_contains_key(given, k), F.lit(False)))
    return F.map_concat(given, missing, literal(fixed))


def canonical_params(json_text: Column) -> Column:
    """JSON object text with its keys in sorted order, so that equal settings compare equal."""
    entries = F.array_sort(F.map_entries(F.from_json(json_text, "map<string,string>")))
    return F.to_json(F.map_from_entries(entries))
