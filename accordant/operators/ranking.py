"""Exact ranks and order statistics without sorting a whole group in one task.

A plain ``row_number() over (partition by label order by key)`` puts a class, which may hold
a third of all rows, into one task.  Here the order is cut into value buckets first: bucket
counts give each bucket its offset, and only the rows of one bucket are ordered together.
Counts per (group, bucket) are as many as groups times buckets, independent of the rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from accordant.operators.joins import measured, null_safe_join

BUCKETS = 4096


def hash_bucket(order: Column, buckets: int = BUCKETS) -> Column:
    """Bucket of a hex order key by its leading digits; follows the key's own order."""
    word = F.conv(F.substring(order, 1, 8), 16, 10).cast("double")
    return F.floor(word / F.lit(4294967296.0) * F.lit(buckets)).cast("int")


def _group_keys(groups: Sequence[str]) -> dict[str, Column]:
    """The group columns as null-free strings, so that window and join share one partitioning."""
    return {f"__k{i}": F.coalesce(F.col(g).cast("string"), F.lit("\u0000"))
            for i, g in enumerate(groups)}


def _offsets(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    counts = df.groupBy(*keys, "__bucket").agg(F.count(F.lit(1)).alias("__size"))
    earlier = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(
        Window.unboundedPreceding, -1)
    return counts.withColumn("__before", F.coalesce(F.sum("__size").over(earlier), F.lit(0)))


def rank_by_hash(df: DataFrame, order: Column, identity: str, groups: Sequence[str] = (),
                 out: str = "rank", buckets: int = BUCKETS) -> DataFrame:
    """Number the rows of each group 1..n by a hex order key, then identity.

    The window and the join on the bucket offsets use the same keys: one exchange of the rows.
    """
    keys = _group_keys(groups)
    keyed = (df.withColumns({"__order": order, **keys})
             .withColumn("__bucket", hash_bucket(F.col("__order"), buckets)))
    offsets = _offsets(keyed, list(keys)).drop("__size")
    within = Window.partitionBy(*keys, "__bucket").orderBy("__order", identity)
    ranked = keyed.withColumn("__row", F.row_number().over(within))
    return (ranked.join(offsets, [*keys, "__bucket"])
            .withColumn(out, F.col("__row").cast("bigint") + F.col("__before"))
            .drop(*keys, "__order", "__bucket", "__row", "__before"))


def smallest(df: DataFrame, order: Column, bucket: Column, limits: DataFrame, identity: str,
             groups: Sequence[str] = ()) -> DataFrame:
    """The first rows of each group in the given order, as many as ``limits`` (groups, k) says.

    ``bucket`` must not fall as ``order`` rises.  The bucket counts tell, per group, which
    bucket the limit cuts; rows in earlier buckets are kept as they are and only the rows of
    that one bucket are ordered.  Groups without a limit return no row.
    """
    keyed = df.withColumns({"__order": order, "__bucket": bucket})
    counted = keyed.withColumns(_group_keys(groups))
    keys = list(_group_keys(groups))
    spans = _offsets(counted, keys)
    caps = limits.withColumns(_group_keys(groups)).select(*keys, F.col("k").alias("__k"))
    caps = spans.join(caps, keys) if keys else spans.withColumn("__k", caps.scalar())
    room = F.col("__k") - F.col("__before")
    partly = (F.col("__size") > room) & (room >= 0)
    cuts = measured(caps.groupBy(*keys).agg(
        F.min(F.when(partly, F.struct(F.col("__bucket").alias("at"), room.alias("room")))).alias("__cut")))
    if keys:
        placed = counted.join(cuts, keys)
    else:
        placed = counted.withColumn("__cut", cuts.scalar())
    whole = placed.filter(F.col("__cut").isNull() | (F.col("__bucket") < F.col("__cut.at")))
    within = Window.partitionBy(*keys, "__bucket").orderBy("__order", identity)
    edge = (placed.filter(F.col("__bucket") == F.col("__cut.at"))
            .withColumn("__row", F.row_number().over(within))
            .filter(F.col("__row") <= F.col("__cut.room")).drop("__row"))
    return whole.unionByName(edge).drop(*keys, "__order", "__bucket", "__cut")


def around_rank(df: DataFrame, column: str, k: int, most: int = 50_000, accuracy: int = 10_000) -> tuple[Any, Any, int]:
    """(lo, hi, before): the k-th smallest value lies in [lo, hi], ``before`` rows are smaller than lo,
    and the range holds at most ``most`` rows or a single value.

    A sketch proposes a range around the rank, an exact count checks it, and a range that is still
    too large is narrowed in the same way.  The driver holds two values and a count.
    """
    part, before = df.select(F.col(column).alias("v")), 0
    n, lo, hi = part.agg(F.count("v"), F.min("v"), F.max("v")).first()
    while n > most and lo < hi:
        at, slack = (k - before) / n, 3.0 / accuracy
        marks = part.agg(F.percentile_approx("v", F.array(F.lit(max(0.0, at - slack)), F.lit(min(1.0, at + slack))), F.lit(accuracy))).first()[0]
        a, b = (lo if at <= slack else marks[0]), (hi if at >= 1 - slack else marks[1])
        under, upto = part.agg(F.count_if(F.col("v") < a), F.count_if(F.col("v") <= b)).first()
        if k - before <= under:  # the sketch erred: the rank is below its range
            a, b, under, upto = lo, a, 0, part.filter(F.col("v") <= a).count()
        elif k - before > upto:
            a, b, under, upto = b, hi, part.filter(F.col("v") < b).count(), n
        if (a, b) == (lo, hi):
            break  # two values at most, each on many rows
        part, before, n, lo, hi = part.filter(F.col("v").between(a, b)), before + under, upto - under, a, b
    return lo, hi, before


def first_by(df: DataFrame, column: str, k: int, identity: str) -> DataFrame:
    """The k rows smallest by ``column``, then identity; only the rows around the limit are ordered."""
    if k <= 0:
        return df.limit(0)
    lo, hi, before = around_rank(df, column, k)
    if lo is None:
        return df
    edge = df.filter(F.col(column).between(lo, hi)).orderBy(column, identity).limit(k - before)
    return df.filter(F.col(column) < lo).unionByName(edge)


def _brackets(data: DataFrame, fractions: Sequence[float], groups: Sequence[str],
              accuracy: int, whole: bool = False) -> DataFrame:
    """Per group, the row count and value bounds that enclose each order statistic.

    The sketch's rank error is ``n / accuracy``; marks three times as far out nearly always hold.
    """
    slack = 1.0 if whole else 3.0 / accuracy
    marks = [m for f in fractions for m in (max(0.0, f - slack), min(1.0, f + slack))]
    sketch = F.percentile_approx("__v", F.array(*[F.lit(m) for m in marks]), F.lit(accuracy))
    parts = data.groupBy(*groups).agg(F.count("__v").alias("n"), sketch.alias("marks"),
                                      F.min("__v").alias("lo"), F.max("__v").alias("hi"))
    pieces = F.array(*[
        F.struct(F.lit(f).alias("fraction"), F.col("n"),
                 F.when(F.lit(f <= slack), F.col("lo")).otherwise(F.col("marks")[2 * i]).alias("lo"),
                 F.when(F.lit(f >= 1 - slack), F.col("hi")).otherwise(F.col("marks")[2 * i + 1]).alias("hi"))
        for i, f in enumerate(fractions)])
    return parts.select(*groups, pieces.alias("__b"))


def exact_quantiles(df: DataFrame, value: str, fractions: Sequence[float],
                    groups: Sequence[str] = (), accuracy: int = 20000) -> DataFrame:
    """Exact linearly interpolated quantiles of a column, one row per group and fraction.

    A sketch brackets each quantile; one more pass counts the rows under the bracket and keeps
    the distinct values inside it, about ``6 / accuracy`` of the rows, so no task holds the
    column.  A value shared by many rows is counted, not repeated.  The counts also tell whether
    a bracket holds its quantile; where one misses, the extremes take its place and the values
    between are counted instead.
    """
    data = df.filter(F.col(value).isNotNull()).select(*groups, F.col(value).cast("double").alias("__v"))
    brackets = measured(_brackets(data, fractions, groups, accuracy))
    found = measured(_within_brackets(data, brackets, groups))
    if not found.filter("not held").isEmpty():
        wide = _brackets(data, fractions, groups, accuracy, whole=True)
        found = found.filter("held").unionByName(_within_brackets(data, measured(wide), groups).join(
            found.filter("not held").select(*groups, "fraction"), [*groups, "fraction"], "left_semi"))
    return found.select(*groups, "fraction", "quantile")


def _within_brackets(data: DataFrame, brackets: DataFrame, groups: Sequence[str]) -> DataFrame:
    """The quantiles read off inside their brackets, and whether each bracket ``held`` its own."""
    hinted = (null_safe_join(data, brackets, list(groups)) if groups
              else data.withColumn("__b", brackets.scalar()))
    cells = (hinted.select(*groups, "__v", F.explode("__b").alias("b"))
             .filter(F.col("__v") <= F.col("b.hi"))
             .withColumn("__in", F.when(F.col("__v") >= F.col("b.lo"), F.col("__v")))
             .groupBy(*groups, F.col("b.fraction").alias("fraction"), F.col("b.n").alias("__n"), "__in")
             .agg(F.count(F.lit(1)).alias("__c")))
    upto = (Window.partitionBy(*groups, "fraction").orderBy(F.asc_nulls_first("__in"))
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    at = F.col("fraction") * (F.col("__n") - 1)
    ranked = cells.withColumn("__upto", F.sum("__c").over(upto))

    def nth(position: Column) -> Column:
        return F.min(F.when((F.col("__upto") > position) & F.col("__in").isNotNull(), F.col("__in")))

    low, high = F.floor(at), F.ceil(at)
    under = F.coalesce(F.max(F.when(F.col("__in").isNull(), F.col("__c"))), F.lit(0))
    return (ranked.withColumns({"__low": low, "__high": high})
            .groupBy(*groups, "fraction", "__n")
            .agg(nth(F.col("__low")).alias("__a"), nth(F.col("__high")).alias("__z"), under.alias("__under"), F.max("__upto").alias("__all"))
            .select(*groups, "fraction",
                    (F.col("__a") + (F.col("__z") - F.col("__a")) * (at - low)).alias("quantile"),
                    ((F.col("__under") <= low) & (F.col("__all") > high)).alias("held")))


def average_ranks(df: DataFrame, value: str, splits: int = 1024) -> DataFrame:
    """Distinct values with their average rank (ties share the mean rank).

    Rows are first counted per value, so a value held by a third of all rows is one row.
    Approximate quantiles cut the values into ranges; ranks are exact within and across them.
    """
    counts = (df.filter(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("value"))
              .agg(F.count(F.lit(1)).alias("c")))
    marks = counts.approxQuantile("value", [i / splits for i in range(1, splits)], 0.25 / splits)
    edges = [float("-inf"), *sorted(set(marks)), float("inf")]
    cut = Bucketizer(splits=edges, inputCol="value", outputCol="range", handleInvalid="keep")
    placed = cut.transform(counts)
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = (placed.groupBy("range").agg(F.sum("c").alias("rows"))
              .withColumn("before", F.coalesce(F.sum("rows").over(earlier), F.lit(0))).drop("rows"))
    within = (Window.partitionBy("range").orderBy("value")
              .rowsBetween(Window.unboundedPreceding, -1))
    below = F.coalesce(F.sum("c").over(within), F.lit(0))
    return (placed.withColumn("below", below).join(ranges, "range")
            .select("value", (F.col("before") + F.col("below") + (F.col("c") + 1) / 2.0).alias("rank")))
