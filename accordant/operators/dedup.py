"""Duplicates by key, without gathering the copies of one key in a task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from accordant.operators.joins import rejoin_keys


def keep_first(df: DataFrame, key: str, order: str | Column | Sequence[str]) -> DataFrame:
    """One row per key: the first in the given explicit order.

    An aggregate instead of a window, so copies combine on the map side and a text that
    makes up a third of the table shrinks to one row per task before the shuffle.
    """
    rank = F.struct(*order) if isinstance(order, (list, tuple)) else order
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return df.groupBy(*rejoin_keys(key)).agg(F.min_by(row, rank).alias("__row")).select("__row.*")


def duplicate_groups(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return (df.groupBy(*rejoin_keys(key)).agg(F.count(F.lit(1)).alias("copies")).drop("__spread")
            .filter((F.col("copies") > 1) & F.col(key).isNotNull()))


def duplicate_members(df: DataFrame, key: str) -> DataFrame:
    """Every row whose key occurs more than once, with the count of its copies.

    The right side has one row per key; a hot key on the left is split by AQE.
    """
    return df.join(duplicate_groups(df, key), key)


def uniqueness(df: DataFrame, key: str) -> DataFrame:
    """One row: rows, distinct keys and whether the key is unique."""
    per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("c"))
    return per_key.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n_rows"),
                       F.count(key).alias("n_keys"),
                       (F.coalesce(F.max("c"), F.lit(0)) <= 1).alias("is_unique"))


def require_unique(df: DataFrame, key: str, what: str = "table") -> None:
    """Raise when a key occurs twice."""
    found = uniqueness(df, key).first()
    if not found["is_unique"]:
        raise ValueError(f"{what}: {found['n_rows']} rows for {found['n_keys']} values of {key!r}")
