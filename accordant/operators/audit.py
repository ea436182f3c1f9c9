"""What a selection removed: overview, correctness, classes and error recall.

Input rows carry ``dataset``, ``selection`` (kept or removed), ``removal_reason``,
``consensus_level`` and ``is_correct``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def judged(df: DataFrame, exclude_levels: Sequence[str] = ("low",), label: str = "resolved_annotation",
           truth: str = "ground_truth") -> DataFrame:
    """Kept and removed rows with ``is_correct``, without the lowest agreement level.

    A row without a truth counts as not correct.
    """
    rows = df.filter(F.col("selection").isin("kept", "removed") & ~F.col("consensus_level").isin(*exclude_levels))
    return rows.withColumn("is_correct", F.coalesce(F.col(label) == F.col(truth), F.lit(False)))


def combine(kept: DataFrame, removed: DataFrame) -> DataFrame:
    """Kept and removed tables as one, marked by ``selection``."""
    return kept.withColumn("selection", F.lit("kept")).unionByName(
        removed.withColumn("selection", F.lit("removed")), allowMissingColumns=True)


def _removed() -> Column:
    return F.col("selection") == "removed"


def _wrong() -> Column:
    return ~F.col("is_correct")


def overview(rows: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return rows.groupBy("dataset").agg(
        n.alias("total"), F.count_if(~_removed()).alias("kept"), F.count_if(_removed()).alias("removed"),
        F.count_if(F.col("removal_reason") == "redundant").alias("removed_redundant"),
        F.count_if(F.col("removal_reason") == "noise").alias("removed_noise"),
        (F.count_if(_removed()) / n).alias("reduction_rate"))


def removed_correctness(rows: DataFrame) -> DataFrame:
    n, right = F.count(F.lit(1)), F.count_if("is_correct")
    return rows.filter(_removed()).groupBy("dataset").agg(
        n.alias("n"), right.alias("correct"), (n - right).alias("wrong"),
        (F.lit(100.0) * right / n).alias("pct_correct"), (F.lit(100.0) * (n - right) / n).alias("pct_wrong"))


def removed_by_level(rows: DataFrame, levels: Sequence[str] = ("high", "medium")) -> DataFrame:
    """Removed rows per agreement level, as counts and shares of the dataset."""
    counts = rows.filter(_removed()).groupBy("dataset").agg(
        *[F.count_if(F.col("consensus_level") == v).alias(v) for v in levels])
    total = sum((F.col(v) for v in levels[1:]), F.col(levels[0]))
    return counts.withColumns({f"pct_{v}": F.lit(100.0) * F.try_divide(F.col(v), total) for v in levels})


def removed_error_rate(rows: DataFrame, by: str) -> DataFrame:
    """Error rate of removed rows by dataset and ``by`` (agreement level or removal reason)."""
    return rows.filter(_removed()).groupBy("dataset", by).agg(
        F.count(F.lit(1)).alias("n"), (F.lit(100.0) * F.avg(_wrong().cast("double"))).alias("pct_error"))


def filter_quality(rows: DataFrame) -> DataFrame:
    """Error rates of removed and kept rows, and the share of all errors that was removed."""
    out, wrong = _removed(), _wrong()

    def rate(side: Column) -> Column:
        return F.avg(F.when(side, F.col("is_correct").cast("double")))

    errors = F.count_if(wrong)
    return rows.groupBy("dataset").agg(
        rate(out).alias("acc_removed"), rate(~out).alias("acc_kept"),
        (F.lit(100.0) * (1.0 - rate(out))).alias("pct_error_removed"),
        (F.lit(100.0) * (1.0 - rate(~out))).alias("pct_error_kept"),
        (F.lit(100.0) * F.try_divide(F.count_if(out & wrong), errors)).alias("error_recall"),
        errors.alias("errors"))


def class_removal(rows: DataFrame, label: str = "ground_truth") -> DataFrame:
    """Removal rate of each class beside the dataset's mean rate.

    The mean comes from the class table, which has one row per dataset and class.
    """
    per_class = rows.groupBy("dataset", F.col(label).alias("class")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(_removed()).alias("removed"))
    mean = per_class.groupBy("dataset").agg((F.lit(100.0) * F.sum("removed") / F.sum("n")).alias("mean_pct"))
    return per_class.withColumn("pct_removed", F.lit(100.0) * F.col("removed") / F.col("n")).join(mean, "dataset")


def status_profile(rows: DataFrame, length: str = "text_len", confidence: str = "mean_confidence") -> DataFrame:
    """Median text length and mean confidence of kept and removed rows, side by side."""
    def pair(name: str, agg, value: str) -> list[Column]:
        return [agg(F.when(_removed(), F.col(value))).alias(f"{name}_removed"),
                agg(F.when(~_removed(), F.col(value))).alias(f"{name}_kept")]

    return rows.groupBy("dataset").agg(*pair("median_len", F.median, length), *pair("mean_conf", F.avg, confidence))


def synthesis(rows: DataFrame, levels: Sequence[str] = ("high", "medium")) -> DataFrame:
    """The main figures of the audit in one table per dataset, from one aggregate."""
    out, wrong = _removed(), _wrong()
    removed, kept = F.count_if(out), F.count_if(~out)

    def pct(part: Column, whole: Column) -> Column:
        return F.lit(100.0) * F.try_divide(part, whole)

    return rows.groupBy("dataset").agg(
        removed.alias("removed"), pct(removed, F.count(F.lit(1))).alias("pct_reduction"),
        pct(F.count_if(out & ~wrong), removed).alias("pct_correct"), pct(F.count_if(out & wrong), removed).alias("pct_wrong"),
        pct(F.count_if(out & (F.col("consensus_level") == levels[0])),
            F.count_if(out & F.col("consensus_level").isin(*levels))).alias(f"pct_{levels[0]}"),
        pct(F.count_if(out & wrong), removed).alias("pct_error_removed"),
        pct(F.count_if(~out & wrong), kept).alias("pct_error_kept"),
        pct(F.count_if(out & wrong), F.count_if(wrong)).alias("error_recall"))
