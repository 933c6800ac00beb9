"""Column functions over numbers, with an explicit policy for empty denominators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def reaches(score: Column, threshold: Column) -> Column:
    """``score >= threshold``; a score that is missing or not a number never reaches one."""
    return F.coalesce(~F.isnan(score.cast("double")) & (score >= threshold), F.lit(False))


def ratio(num: Column, den: Column, empty: float | None = None) -> Column:
    """``num / den``; an empty denominator gives ``empty`` (null, or a number such as 0.0)."""
    return F.when(den == 0, F.lit(empty).cast("double")).otherwise(num / F.nullif(den, F.lit(0)))


def rounded(value: Column, digits: int = 9) -> Column:
    return F.round(value.cast("double"), digits)


def half_even(value: Column, digits: int) -> Column:
    """Round with ties to even, as numeric libraries do for presentation."""
    return F.bround(value.cast("double"), digits)


def number(value: Column) -> Column:
    """Numeric coercion: text that is no number, and NaN, become null."""
    as_double = value.try_cast("double")
    return F.when(~F.isnan(as_double), as_double)


def finite(value: Column) -> Column:
    """NaN and the infinities become null."""
    return F.when((~F.isnan(value)) & (F.abs(value) != F.lit(float("inf"))), value)


def flag(value: Column) -> Column:
    """0/1 integer of a condition; null counts as 0."""
    return F.coalesce(value.cast("int"), F.lit(0))


def any_flag(columns: list[Column]) -> Column:
    """Row OR over flags: missing counts as 0, values are clipped to 0..1."""
    clean = [F.least(F.greatest(F.coalesce(c.try_cast("double").cast("int"), F.lit(0)), F.lit(0)), F.lit(1)) for c in columns]
    if not clean:
        return F.lit(0)
    return clean[0] if len(clean) == 1 else F.greatest(*clean)


def row_sum(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0)) for c in columns])


def none_of(columns: list[Column]) -> Column:
    """1 when every flag is 0."""
    return (row_sum(columns) == 0).cast("int")


def sigmoid(x: Column, limit: float = 50.0) -> Column:
    return 1.0 / (1.0 + F.exp(-F.greatest(F.least(x, F.lit(limit)), F.lit(-limit))))


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(float(high))), F.lit(float(low)))


def z_score(x: Column, mean: Column, sd: Column) -> Column:
    """Standard score; a zero or missing deviation counts as 1."""
    return (x - mean) / F.when(sd.isNull() | (sd == 0), F.lit(1.0)).otherwise(sd)


def window_scale(x: Column, low: float, high: float) -> Column:
    """Clip to ``[low, high]`` and scale to ``[0, 1]``."""
    return (clip(x, low, high) - F.lit(float(low))) / F.lit(float(high) - float(low))


def min_max(x: Column, low: Column, high: Column) -> Column:
    """Clip to the bounds and scale; a degenerate range gives 0."""
    return F.when(high <= low, F.lit(0.0)).otherwise(
        (F.greatest(F.least(x, high), low) - low) / F.nullif(high - low, F.lit(0.0))
    )


def linear_rescale(x: Column, slope: Column, intercept: Column) -> Column:
    return x * F.coalesce(slope, F.lit(1.0)) + F.coalesce(intercept, F.lit(0.0))


def cross3(a: Column, b: Column) -> Column:
    """Cross product of two 3-vectors given as arrays."""
    return F.array(
        a[1] * b[2] - a[2] * b[1],
        a[2] * b[0] - a[0] * b[2],
        a[0] * b[1] - a[1] * b[0],
    )


def dot3(a: Column, b: Column) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def unit3(a: Column) -> Column:
    norm = F.sqrt(dot3(a, a))
    return F.when(norm > 0, F.array(a[0] / norm, a[1] / norm, a[2] / norm))


def sphere_diameter(volume: Column) -> Column:
    """Diameter of the sphere of a given volume."""
    return F.pow(6.0 * volume / F.lit(3.141592653589793), F.lit(1.0 / 3.0))


def approx_equal(a: Column, b: Column, atol: float = 1e-8, rtol: float = 1e-5) -> Column:
    """Equality within tolerances; two nulls are equal, one null is not."""
    near = F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b)
    return F.coalesce(near, a.isNull() & b.isNull())


def alerts(rules: dict[str, Column]) -> Column:
    """Names of the rules that hold in the row, joined by ``'; '``."""
    hits = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in rules.items()]))
    return F.array_join(hits, "; ")


def confusion_metrics(tp: Column, fp: Column, fn: Column, tn: Column, empty: float | None = 0.0) -> dict[str, Column]:
    """Binary metrics from confusion counts; ``empty`` is the value of an empty denominator."""
    tp, fp, fn, tn = (c.cast("double") for c in (tp, fp, fn, tn))
    n = tp + fp + fn + tn
    recall = ratio(tp, tp + fn, empty)
    specificity = ratio(tn, tn + fp, empty)
    r0, s0 = ratio(tp, tp + fn, 0.0), ratio(tn, tn + fp, 0.0)
    mcc_den = F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)
    expected = (tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)
    balanced = (
        F.when((tp + fn == 0) & (tn + fp == 0), F.lit(None).cast("double"))
        .when(tp + fn == 0, s0)
        .when(tn + fp == 0, r0)
        .otherwise((r0 + s0) / 2)
    )
    return {
        "precision": ratio(tp, tp + fp, 0.0),
        "recall": r0,
        "specificity": specificity,
        "npv": ratio(tn, tn + fn, empty),
        "fpr": ratio(fp, fp + tn, empty),
        "fnr": ratio(fn, fn + tp, empty),
        "f1": ratio(2 * tp, 2 * tp + fp + fn, 0.0),
        "jaccard": ratio(tp, tp + fp + fn, 0.0),
        "accuracy": ratio(tp + tn, n, empty),
        "balanced_accuracy": balanced,
        "gmean": F.sqrt(r0 * s0),
        "mcc": ratio(tp * tn - fp * fn, mcc_den, 0.0),
        "cohen_kappa": ratio(n * (tp + tn) - expected, n * n - expected, empty),
        "sensitivity": recall,
    }
