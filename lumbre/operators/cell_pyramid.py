"""Nearest distances through a pyramid of occupied cells.

The targets of a key are covered by one cell; a cell with more than ``LEAF`` targets is cut into 4 parts on every axis, round by round, and each cell keeps the
count and the exact box of its targets.  Points go down the same rounds: a box bounds the distance to its nearest target from both sides, so before any
target is read a point is left with the few cells that may hold the nearest one.  Crowded cells are cut until they are small, wherever they lie, and a far
point meets boxes and not targets.

Cells are numbered by a hash of their place; two cells of a key that share a number would be searched together, which changes no result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumbre.session import broadcast_if_small, durable

#: Targets of a cell that is not cut; bits by which an axis is cut in a round; most rounds.
LEAF, BITS, MOST_ROUNDS = 64, 2, 25
#: Rounding of squared distances: bounds are moved apart by this share.
SLACK = 1e-12


def is_placed(coords: list[str]) -> Column:
    """Whether a point has a finite coordinate on every axis."""
    return reduce(lambda a, b: a & b, [F.coalesce(~F.isnan(c) & (F.abs(c) != float("inf")), F.lit(False)) for c in coords])


def squared(a: list, b: list) -> Column:
    return reduce(lambda x, y: x + y, [(p - q) * (p - q) for p, q in zip(a, b)])


def _cell(keys: list[str], axes: int, level: int) -> Column:
    """Number of the cell of a target at a level, from its place in the unit cube."""
    if not level:
        return F.lit(0).cast("bigint")
    size = float(2 ** (BITS * level))
    return F.xxhash64(F.lit(level), *[F.least(F.floor(F.col(f"__u{i}") * size), F.lit(int(size) - 1).cast("bigint")) for i in range(axes)])


def _boxes(rows: DataFrame, keys: list[str], coords: list[str], by: list) -> DataFrame:
    sides = [f(c).alias(f"__{n}{i}") for i, c in enumerate(coords) for n, f in (("lo", F.min), ("hi", F.max))]
    return rows.groupBy(*keys, *by).agg(F.count(F.lit(1)).alias("__n"), *sides)


class CellPyramid:
    """Levels of cells over ``targets`` (keys, coords): distinct and finite places, written once."""

    def __init__(self, targets: DataFrame, keys: list[str], coords: list[str], leaf: int = LEAF):
        self.keys, self.coords, self.leaf = keys, coords, leaf
        axes = range(len(coords))
        plain = targets.filter(is_placed(coords)).select(*keys, *[F.col(c).cast("double").alias(c) for c in coords]).distinct()
        root = durable(_boxes(plain, keys, coords, []))
        extent = F.greatest(*[F.col(f"__hi{i}") - F.col(f"__lo{i}") for i in axes], F.lit(0.0))
        whole = root.select(*keys, *[F.col(f"__lo{i}") for i in axes], extent.alias("__extent"))
        joined = plain.join(broadcast_if_small(whole), keys)
        place = [F.coalesce((F.col(c) - F.col(f"__lo{i}")) / F.nullif(F.col("__extent"), F.lit(0.0)), F.lit(0.0)).alias(f"__u{i}") for i, c in enumerate(coords)]
        self.targets = durable(joined.select(*keys, *coords, *place))
        self.levels = [root.withColumns({"__parent": F.lit(-1).cast("bigint"), "__cell": F.lit(0).cast("bigint")})]
        large = self.levels[0].filter(F.col("__n") > leaf)
        while len(self.levels) <= MOST_ROUNDS and not large.isEmpty():
            level = len(self.levels)
            inside = self.targets.withColumn("__parent", _cell(keys, len(coords), level - 1)).join(broadcast_if_small(large.select(*keys, F.col("__cell").alias("__parent"))), [*keys, "__parent"], "left_semi")
            self.levels.append(durable(_boxes(inside, keys, coords, ["__parent", _cell(keys, len(coords), level).alias("__cell")])))
            large = self.levels[-1].filter(F.col("__n") > leaf)

    def _bounded(self, met: DataFrame) -> DataFrame:
        """Squared distance bounds of points (``__p0`` ...) to boxes."""
        points, lows, highs = ([F.col(f"__{n}{i}") for i in range(len(self.coords))] for n in ("p", "lo", "hi"))
        zero = F.lit(0.0)
        outside = [F.greatest(low - p, p - high, zero) for p, low, high in zip(points, lows, highs)]
        across = [F.greatest(F.abs(p - low), F.abs(high - p)) for p, low, high in zip(points, lows, highs)]
        low, high = (reduce(lambda x, y: x + y, [s * s for s in sides]) for sides in (outside, across))
        return met.withColumns({"__least": low * (1 - SLACK), "__most": high * (1 + SLACK)})

    def nearest(self, points: DataFrame, within: float | None = None) -> DataFrame:
        """(keys, coords, distance): for every distinct place of ``points`` whose key has targets, the distance to the nearest one.

        With ``within``, only places nearer than that are returned, and the distance is an upper bound of the nearest one below it.
        """
        keys, coords = self.keys, self.coords
        spots = points.filter(is_placed(coords)).select(*keys, *[F.col(c).cast("double").alias(c) for c in coords]).distinct()
        spots = durable(spots.withColumn("__pid", F.monotonically_increasing_id()))
        own = [F.col(c).alias(f"__p{i}") for i, c in enumerate(coords)]
        limit = F.lit(float("inf") if within is None else float(within) ** 2)
        open_cells = spots.select("__pid", *keys, *own).withColumn("__parent", F.lit(-1).cast("bigint"))
        leaves: list[DataFrame] = []
        settled: list[DataFrame] = []
        best = None
        for number, cells in enumerate(self.levels):
            met = self._bounded(open_cells.join(broadcast_if_small(cells), [*keys, "__parent"])).filter(F.col("__least") < limit if within is not None else F.lit(True))
            met = durable(met.select("__pid", *keys, *[f"__p{i}" for i in range(len(coords))], "__cell", "__n", "__least", "__most"))
            bounds = met.groupBy("__pid").agg(F.min("__most").alias("__most"))
            best = durable((bounds if best is None else best.unionByName(bounds)).groupBy("__pid").agg(F.min("__most").alias("__most")))
            kept = met.drop("__most").join(best, "__pid").filter(F.col("__least") <= F.col("__most"))
            if within is not None:
                # A whole cell is near: the point needs no further look.
                near = durable(best.filter(F.col("__most") < limit))
                settled.append(near.select("__pid", F.sqrt("__most").alias("distance")))
                kept = kept.filter(F.col("__most") >= limit)
            last = number + 1 == len(self.levels)
            done = F.lit(True) if last else F.col("__n") <= self.leaf
            leaves.append(durable(kept.filter(done).select("__pid", *keys, *[f"__p{i}" for i in range(len(coords))], "__cell", "__least").withColumn("__level", F.lit(number))))
            open_cells = durable(kept.filter(~done).select("__pid", *keys, *[f"__p{i}" for i in range(len(coords))], F.col("__cell").alias("__parent")))
            if open_cells.isEmpty():
                break
        found = []
        for number, cells in enumerate(leaves):
            # Bounds of later levels close leaves of earlier ones.
            wanted = cells.join(best, "__pid").filter((F.col("__least") <= F.col("__most")) & (F.lit(True) if within is None else F.col("__most") >= limit)).drop("__most")
            if wanted.isEmpty():
                continue
            here = self.targets.withColumn("__cell", _cell(keys, len(coords), number)).select(*keys, "__cell", *[F.col(c).alias(f"__t{i}") for i, c in enumerate(coords)])
            distance = squared([F.col(f"__p{i}") for i in range(len(coords))], [F.col(f"__t{i}") for i in range(len(coords))])
            found.append(wanted.join(here, [*keys, "__cell"]).groupBy("__pid").agg(F.min(distance).alias("d")))
        every = [f.filter(F.col("d") < limit if within is not None else F.lit(True)).select("__pid", F.sqrt("d").alias("distance")) for f in found] + settled
        if not every:
            return spots.limit(0).select(*keys, *coords, F.lit(0.0).alias("distance"))
        smallest = reduce(DataFrame.unionByName, every).groupBy("__pid").agg(F.min("distance").alias("distance"))
        return spots.join(smallest, "__pid").select(*keys, *coords, "distance")
