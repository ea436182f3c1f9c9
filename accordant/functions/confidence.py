"""Row expressions over annotator confidences."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, functions as F


def bin_edges(bins: int = 10) -> list[float]:
    """Edges of equal bins over [0, 1] as the exact doubles of an evenly spaced grid."""
    step = 1.0 / bins
    return [i * step for i in range(bins)] + [1.0]


def confidence_bin(conf: Column, bins: int = 10) -> Column:
    """Index of the right-closed bin; 0 belongs to the first, values outside [0, 1] to none.

    Counting the inner edges below the value keeps exact edge values in the right bin, where
    arithmetic such as ``ceil(x * 10)`` slips.
    """
    inner = bin_edges(bins)[1:-1]
    index = reduce(add, [(conf > F.lit(e)).cast("int") for e in inner], F.lit(0))
    return F.when((conf >= 0.0) & (conf <= 1.0), index)


def quadrant(correct: Column, conf: Column, threshold: float = 0.9) -> Column:
    high = conf >= F.lit(threshold)
    return (F.when(correct & high, "correct_high").when(correct, "correct_low")
            .when(high, "wrong_high").otherwise("wrong_low"))


def mean_confidence(columns: Sequence[str]) -> Column:
    """Mean of the confidences that are present; null when none is."""
    cols = [F.col(c) for c in columns]
    total = reduce(add, [F.coalesce(c, F.lit(0.0)) for c in cols])
    present = reduce(add, [c.isNotNull().cast("int") for c in cols])
    return F.try_divide(total, present)


def std_confidence(columns: Sequence[str]) -> Column:
    """Population deviation across the annotators of one row."""
    cols = [F.col(c) for c in columns]
    mean = reduce(add, cols) / F.lit(float(len(cols)))
    return F.sqrt(reduce(add, [(c - mean) * (c - mean) for c in cols]) / F.lit(float(len(cols))))


def logit(p: Column, eps: float = 1e-6) -> Column:
    clipped = F.greatest(F.least(p, F.lit(1.0 - eps)), F.lit(eps))
    return F.ln(clipped / (F.lit(1.0) - clipped))
