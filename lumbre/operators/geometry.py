"""Point and voxel tables: distances, lookups with an affine map, mask geometry, slice choice."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from lumbre.functions.numeric import sphere_diameter
from lumbre.operators.cell_pyramid import CellPyramid
from lumbre.operators.ordered import exact_quantiles, top_rows


def _same_place(points: DataFrame, found: DataFrame, keys: list[str], coords: list[str]) -> tuple[DataFrame, list[Column]]:
    """``found`` with names of its own, and the condition that ties its places to those of ``points``."""
    renamed = found.withColumnsRenamed({c: f"__o_{c}" for c in [*keys, *coords]})
    return renamed, [F.col(k) == F.col(f"__o_{k}") for k in keys] + [F.col(c).cast("double") == F.col(f"__o_{c}") for c in coords]


def far_from(points: DataFrame, others: DataFrame, keys: list[str], coords: list[str], distance: float) -> DataFrame:
    """Points at least ``distance`` away from every other point of the same key; keys without others keep all, as do points without a finite coordinate."""
    near = CellPyramid(others, keys, coords).nearest(points, distance)
    places, same = _same_place(points, near.select(*keys, *coords), keys, coords)
    return points.join(places, same, "left_anti")


def nearest_distance(points: DataFrame, others: DataFrame, keys: list[str], ids: list[str], coords: list[str], out: str = "distance") -> DataFrame:
    """Exact distance from each point to the nearest other point of its key; null when the key has none.

    Points without a finite coordinate on every axis match nothing, on either side.
    """
    places, same = _same_place(points, CellPyramid(others, keys, coords).nearest(points).withColumnRenamed("distance", "__nearest"), keys, coords)
    return points.join(places, same, "left").select(*keys, *ids, F.col("__nearest").alias(out))


#: Voxels along the last axis that one number holds.
CELL_BITS = 5
_CELL = 1 << CELL_BITS


def _cell(axis: str) -> Column:
    return F.shiftright(F.col(axis).cast("bigint"), CELL_BITS)


def _bit(axis: str) -> str:
    """SQL for the place of a voxel in its cell."""
    return f"CAST(CAST(`{axis}` AS BIGINT) & {_CELL - 1} AS INT)"


def neighbour_cells(inside: DataFrame, keys: list[str], axes: list[str]) -> DataFrame:
    """(keys, axes but the last, __cell, __bits): places one step along an axis from an inside voxel, as bits of cells along the last axis."""
    *plane, line = axes
    bits = inside.groupBy(*keys, *plane, _cell(line).alias("__cell")).agg(F.bit_or(F.expr(f"shiftleft(1L, {_bit(line)})")).alias("__bits"))

    def moved(step: dict[str, int], cell: int, value: Column) -> Column:
        return F.struct(*[(F.col(a) + step.get(a, 0)).alias(a) for a in plane], (F.col("__cell") + cell).alias("__cell"), value.alias("__bits"))

    b = F.col("__bits")
    along = F.shiftleft(b, 1).bitwiseOR(F.shiftright(b, 1)).bitwiseAND((1 << _CELL) - 1)
    steps = [moved({}, 0, along), moved({}, 1, F.shiftright(b, _CELL - 1)), moved({}, -1, F.shiftleft(b.bitwiseAND(1), _CELL - 1))]
    steps += [moved({a: s}, 0, b) for a in plane for s in (-1, 1)]
    around = bits.select(*keys, F.explode(F.filter(F.array(*steps), lambda m: m["__bits"] != 0)).alias("m")).select(*keys, "m.*")
    return around.groupBy(*keys, *plane, "__cell").agg(F.bit_or("__bits").alias("__bits"))


def boundary_voxels(inside: DataFrame, outside: DataFrame, keys: list[str], axes: list[str]) -> DataFrame:
    """Outside voxels with an inside neighbour along an axis: the only ones that can be nearest to an inside voxel.

    Whole-numbered voxels are bits of cells along the last axis, so a task never holds six neighbours of each of its voxels.
    """
    if not all(isinstance(df.schema[a].dataType, IntegralType) for df in (inside, outside) for a in axes):
        steps = [tuple(s if i == j else 0 for i in range(len(axes))) for j in range(len(axes)) for s in (-1, 1)]
        moved = F.explode(F.array(*[F.struct(*[(F.col(a) + d).alias(a) for a, d in zip(axes, step)]) for step in steps])).alias("m")
        return outside.join(inside.select(*keys, moved).select(*keys, "m.*"), [*keys, *axes], "left_semi")
    *plane, line = axes
    rest = [c for c in outside.columns if c not in (*keys, *axes)]
    met = outside.withColumn("__cell", _cell(line)).join(neighbour_cells(inside, keys, axes), [*keys, *plane, "__cell"])
    on = F.expr(f"shiftright(__bits, {_bit(line)}) & 1") == 1
    return met.filter(on).select(*keys, *axes, *rest)


def inverse3(m: Column) -> Column:
    """Inverse of a row-major 3x3 matrix given as an array of nine numbers; null when it is singular."""

    def minor(a: int, b: int, c: int, d: int) -> Column:
        return m[a] * m[d] - m[b] * m[c]

    det = m[0] * minor(4, 5, 7, 8) - m[1] * minor(3, 5, 6, 8) + m[2] * minor(3, 4, 6, 7)
    rows = [
        minor(4, 5, 7, 8), -minor(1, 2, 7, 8), minor(1, 2, 4, 5),
        -minor(3, 5, 6, 8), minor(0, 2, 6, 8), -minor(0, 2, 3, 5),
        minor(3, 4, 6, 7), -minor(0, 1, 6, 7), minor(0, 1, 3, 4),
    ]
    return F.when(det != 0, F.array(*[r / F.nullif(det, F.lit(0.0)) for r in rows]))


def world_to_voxel(points: DataFrame, geometry: DataFrame, key: str, coords: list[str]) -> DataFrame:
    """Voxel coordinates and inside flag from ``direction`` (9), ``origin`` (3), ``spacing`` (3), ``dim`` (3); other keys drop out."""
    maps = geometry.select(key, "origin", "spacing", "dim", inverse3(F.col("direction")).alias("__inv"))
    joined = points.join(maps, key)
    shifted = [F.col(c) - F.col("origin")[i] for i, c in enumerate(coords)]
    voxel = [
        (F.col("__inv")[3 * r] * shifted[0] + F.col("__inv")[3 * r + 1] * shifted[1] + F.col("__inv")[3 * r + 2] * shifted[2]) / F.col("spacing")[r]
        for r in range(3)
    ]
    named = joined.select(*points.columns, "dim", *[v.alias(f"voxel_{a}") for v, a in zip(voxel, "xyz")])
    inside = reduce(lambda x, y: x & y, [(F.col(f"voxel_{a}") >= 0) & (F.col(f"voxel_{a}") < F.col("dim")[i]) for i, a in enumerate("xyz")])
    return named.withColumn("inside", F.coalesce(inside, F.lit(False)).cast("int")).drop("dim")


def intensity_stats(voxels: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Minimum, p1, p5, p25, p50, p75, p95, p99, maximum, mean and population sd per key."""
    stats = voxels.groupBy(*keys).agg(
        F.count(value).alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd")
    )
    probs = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]
    q = exact_quantiles(voxels, keys, value, probs).select(*keys, "quantiles")
    names = ["p01", "p05", "p25", "p50", "p75", "p95", "p99"]
    return stats.join(q, keys).select(*keys, "n", "min", *[F.col("quantiles")[i].alias(n) for i, n in enumerate(names)], "max", "mean", "sd")


def mask_geometry(voxels: DataFrame, keys: list[str], axes: list[str], mask: str, reference: str, spacing: list[str], dims: list[str]) -> DataFrame:
    """Per key: voxels and volume of a mask, sphere diameter, box, rounded centroid (centre when empty), overlap, border touch."""
    on = F.col(mask) == 1
    aggs = [
        F.count_if(on).alias("n_voxels"), F.count_if(on & (F.col(reference) == 1)).alias("n_overlap"), F.count_if(~F.col(mask).isin(0, 1)).alias("n_not_binary"),
        *[F.min(F.when(on, F.col(a))).alias(f"min_{a}") for a in axes], *[F.max(F.when(on, F.col(a))).alias(f"max_{a}") for a in axes],
        *[F.avg(F.when(on, F.col(a))).alias(f"__mean_{a}") for a in axes], *[F.max(d).alias(f"__{d}") for d in dims],
        *[F.max(s).alias(f"__{s}") for s in spacing],
    ]
    per = voxels.groupBy(*keys).agg(*aggs)
    volume = reduce(lambda a, b: a * b, [F.col(f"__{s}") for s in spacing]) * F.col("n_voxels")
    touches = reduce(lambda a, b: a | b, [(F.col(f"min_{a}") == 0) | (F.col(f"max_{a}") == F.col(f"__{d}") - 1) for a, d in zip(axes, dims)])
    return per.select(
        *keys, "n_voxels", "n_not_binary", volume.alias("volume"), F.when(F.col("n_voxels") > 0, sphere_diameter(volume)).alias("diameter"),
        *[f"min_{a}" for a in axes], *[f"max_{a}" for a in axes],
        *[F.coalesce(F.bround(f"__mean_{a}", 0).cast("bigint"), F.floor(F.col(f"__{d}") / 2).cast("bigint")).alias(f"centre_{a}") for a, d in zip(axes, dims)],
        F.when(F.col("n_voxels") > 0, F.col("n_overlap") / F.nullif(F.col("n_voxels"), F.lit(0))).alias("overlap"),
        F.coalesce(touches, F.lit(False)).cast("int").alias("touches_border"),
    )


def weight_share(df: DataFrame, keys: list[str], weight: str, mask: str) -> DataFrame:
    """Share of a weight that lies inside a mask; 0 when there is no weight."""
    total, inside = F.sum(weight), F.sum(F.when(F.col(mask) == 1, F.col(weight)).otherwise(0.0))
    return df.groupBy(*keys).agg(F.when(total > 0, inside / F.nullif(total, F.lit(0.0))).otherwise(F.lit(0.0)).alias("share"))


def neighbour_rows(centres: DataFrame, keys: list[str], centre: str, size: str, count: int) -> DataFrame:
    """Row numbers at offsets around a centre, clipped to the ends of the series."""
    radius = count // 2
    offsets = F.explode(F.sequence(F.lit(-radius), F.lit(radius))).alias("offset")
    return centres.select(*keys, centre, size, offsets).select(
        *keys, "offset", F.least(F.greatest(F.col(centre) + F.col("offset"), F.lit(0)), F.col(size) - 1).alias("position")
    )


def representative_slices(slices: DataFrame, keys: list[str], position: str, area: str, score: str, n: int) -> DataFrame:
    """The n slices of largest mask area, numbered in spatial order; by score where no slice has area, nearest the middle where none has a score."""
    has_area = slices.groupBy(*keys).agg(F.max(area).alias("__top"), F.max(score).alias("__best"), ((F.min(position) + F.max(position)) / 2).alias("__middle"))
    by_place = -F.abs(F.col(position) - F.col("__middle"))
    measure = F.when(F.col("__top") > 0, F.col(area)).when(F.col("__best").isNotNull(), F.col(score)).otherwise(by_place)
    ranked = top_rows(slices.join(has_area, keys), keys, [measure.desc_nulls_last(), F.col(position)], n, "__place")
    # n rows per key from here on.
    return top_rows(ranked.drop("__top", "__place"), keys, [F.col(position)], n, "slice_order")
