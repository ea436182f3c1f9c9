"""Seeded sampling, stratified splits and fold assignment.

Order comes from a hash of the row identity and the seed, so a sample does not depend on
partitioning, retries or cluster size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from accordant.functions import text as T
from accordant.operators import ranking


def shuffled_sample(df: DataFrame, identity: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows in seeded random order (all rows when there are fewer)."""
    order = T.shuffle_key(identity, seed)
    limit = df.sparkSession.range(1).select(F.lit(n).cast("bigint").alias("k"))
    return ranking.smallest(df, order, ranking.hash_bucket(order), limit, identity)


def class_sample(df: DataFrame, condition: Column, identity: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows of one class for inspection."""
    return shuffled_sample(df.filter(condition), identity, n, seed)


def capped_per_group(df: DataFrame, group: str, identity: str, n: int, seed: int = 42) -> DataFrame:
    """At most ``n`` seeded random rows of each group."""
    order = T.shuffle_key(identity, seed)
    limits = df.select(group).distinct().withColumn("k", F.lit(n).cast("bigint"))
    return ranking.smallest(df, order, ranking.hash_bucket(order), limits, identity, [group])


def stratified_halves(df: DataFrame, label: str, identity: str, seed: int = 42,
                      names: tuple[str, str] = ("val", "test")) -> DataFrame:
    """Split every class into two halves that differ by at most one row."""
    ranked = ranking.rank_by_hash(df, T.shuffle_key(identity, seed), identity, [label], "__rank")
    half = F.when(F.col("__rank") % 2 == 1, names[0]).otherwise(names[1])
    return ranked.withColumn("split", half).drop("__rank")


def safe_folds(df: DataFrame, label: str, k: int = 5) -> DataFrame:
    """One row: ``k`` lowered to the smallest class, but never under 2."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.greatest(F.lit(2), F.least(F.lit(k), F.min("n"))).cast("int").alias("k"))


def stratified_folds(df: DataFrame, label: str, identity: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Add ``fold``: the class-wise hash rank modulo the safe number of folds."""
    folds = safe_folds(df, label, k)
    ranked = ranking.rank_by_hash(df, T.shuffle_key(identity, seed), identity, [label], "__rank")
    return (ranked.withColumn("fold", ((F.col("__rank") - 1) % folds.scalar()).cast("int"))
            .drop("__rank"))
