"""Factor coding for designed experiments."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import combinations
from operator import mul

from pyspark.sql import Column, DataFrame, functions as F


def sign(column: Column, low: object, high: object) -> Column:
    """-1 for the low level, +1 for the high level, null otherwise."""
    return F.when(column == F.lit(low), -1).when(column == F.lit(high), 1)


def products(factors: Sequence[str]) -> dict[str, Column]:
    """Every interaction column: ``B``, ``C``, ``BC``, ..."""
    return {"".join(c): reduce(mul, [F.col(f) for f in c])
            for size in range(1, len(factors) + 1) for c in combinations(factors, size)}


def treatment(factors: Sequence[str]) -> Column:
    """Lower-case letters of the factors at +1, ``(1)`` when none is."""
    letters = F.concat(*[F.when(F.col(f) == 1, f.lower()).otherwise("") for f in factors])
    return F.when(letters == "", "(1)").otherwise(letters)


def code_factors(df: DataFrame, levels: Mapping[str, tuple[str, object, object]]) -> DataFrame:
    """Add coded factors, their interactions and the treatment label.

    ``levels`` maps a factor letter to (column, low level, high level).
    """
    coded = df.withColumns({f: sign(F.col(c), lo, hi) for f, (c, lo, hi) in levels.items()})
    factors = list(levels)
    inter = {n: c for n, c in products(factors).items() if len(n) > 1}
    return coded.withColumns({**inter, "treatment": treatment(factors)})


def length_class(df: DataFrame, by: Sequence[str], length: str = "text_len", out: str = "size_class",
                 short: str = "curto", long: str = "longo") -> DataFrame:
    """Split at the group's exact median length; the median itself counts as short.

    The median's state is the distinct lengths with their counts, so it does not grow with
    the rows.
    """
    from accordant.operators.joins import measured, null_safe_join

    cut = measured(df.groupBy(*by).agg(F.median(length).alias("median_len")))
    return null_safe_join(df, cut, list(by)).withColumn(
        out, F.when(F.col(length) <= F.col("median_len"), short).otherwise(long))
