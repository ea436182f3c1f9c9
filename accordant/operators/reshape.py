"""Wide and long forms of annotation tables; the one-row-per-annotator dataset."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from accordant.functions import text as T
from accordant.operators.consensus import annotator_name, paired_vote_columns
from accordant.operators.labels import describe


def wide_to_long(df: DataFrame, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """One row per key and annotator, carrying the seat so that order is not lost."""
    seats = F.array(*[F.struct(F.lit(annotator_name(c)).alias("annotator"),
                               F.lit(i).alias("annotator_idx"), F.col(c).alias("label"))
                      for i, c in enumerate(columns)])
    return df.select(*keys, F.explode(seats).alias("s")).select(*keys, "s.*")


def long_to_wide(long: DataFrame, annotators: Sequence[str], keys: Sequence[str],
                 value: str = "label", suffix: str = "_consensus") -> DataFrame:
    """One row per key with a column per annotator.

    Plain conditional aggregates over the known annotators: bounded state per key whatever
    the number of copies, and no job to discover the pivot values.
    """
    picks = [F.max(F.when(F.col("annotator") == a, F.col(value))).alias(f"{a}{suffix}")
             for a in annotators]
    return long.groupBy(*keys).agg(*picks)


def perspectives(df: DataFrame, columns: Sequence[str] | None = None, *,
                 meanings: Mapping[str, str] | None = None, exclude: Sequence[int] = (-1,),
                 keep: Sequence[str] = ()) -> DataFrame:
    """One row per text and annotator with a valid integer label.

    Text is stripped and keyed once per text, before the annotators fan out.
    """
    columns = list(columns or paired_vote_columns(df.columns))
    stripped = df.select(*keep, T.strip(F.coalesce(F.col("text"), F.lit(""))).alias("text"), *columns)
    seats = F.array(*[
        F.struct(F.expr(f"try_cast(`{c}` AS INT)").alias("label"), F.lit(annotator_name(c)).alias("llm"))
        for c in columns])
    long = (stripped.select(*keep, F.md5("text").alias("text_id"), "text", F.explode(seats).alias("s"))
            .select(*keep, "text_id", "text", "s.label", "s.llm")
            .filter(F.col("label").isNotNull() & ~F.col("label").isin(*exclude)))
    return describe(long, meanings) if meanings is not None else long


def perspective_stats(df: DataFrame, columns: Sequence[str], long: DataFrame) -> DataFrame:
    """One row: texts, rows and rows removed for lack of a valid label."""
    offered = df.agg((F.count(F.lit(1)) * F.lit(len(columns))).alias("n"))
    per_text = long.groupBy("text_id").agg(F.count(F.lit(1)).alias("c"))
    return (per_text.agg(F.count(F.lit(1)).alias("texts"), F.coalesce(F.sum("c"), F.lit(0)).alias("rows"))
            .withColumn("removed", offered.scalar() - F.col("rows")))
