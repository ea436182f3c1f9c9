"""Join helpers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from accordant.sources.workspace import stored


def measured(small: DataFrame) -> DataFrame:
    """Write a small derived table to the shared folder so that the planner knows its real size.

    An aggregate's size is unknown at planning time and guessed as its input's, so a join
    against it would shuffle the large side.  A written table's size is a fact: under
    ``spark.sql.autoBroadcastJoinThreshold`` it is broadcast, beyond it the join stays a
    shuffle join whose hot keys AQE splits.  Unlike a cached plan, it can neither be lost with
    an executor nor be taken for the result of the same query on changed files.
    """
    return stored(small, "measured")


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys that may hold nulls, keeping the left copy of each key."""
    if not keys:
        raise ValueError("at least one key is needed")
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    cond = reduce(and_, [left[k].eqNullSafe(renamed[f"__r_{k}"]) for k in keys])
    return left.join(renamed, cond, how).drop(*[f"__r_{k}" for k in keys])


def rejoin_keys(*keys: str) -> list[Column]:
    """Grouping columns for a table that is about to be joined by ``keys``.

    AQE splits a hot partition only where both join inputs come straight from an exchange.
    A table grouped by the join keys would keep its grouping's partitioning instead; grouping
    by the keys and their hash gives the same groups and leaves the join its own exchange,
    which moves one narrow row per key.
    """
    return [*[F.col(k) for k in keys], F.xxhash64(*keys).alias("__spread")]


def distinct_keys(df: DataFrame, *keys: str) -> DataFrame:
    """The distinct keys of a table, ready to be joined to a side where a key may be hot."""
    return df.select(*rejoin_keys(*keys)).distinct().drop("__spread")
