"""Confidence calibration: reliability, ECE, balanced Brier score, quadrants."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from accordant.functions import confidence as K, text as T
from accordant.operators import ranking
from accordant.operators.consensus import annotator_name
from accordant.operators.joins import null_safe_join


def long_confidences(df: DataFrame, columns: Sequence[str], conf_suffix: str = "_rep1_conf",
                     keep: Sequence[str] = (), truth: str = "ground_truth") -> DataFrame:
    """One row per text and annotator: model, label, confidence and truth."""
    seats = F.array(*[
        F.struct(F.lit(annotator_name(c)).alias("model"), F.col(c).alias("label"),
                 F.col(annotator_name(c) + conf_suffix).alias("conf")) for c in columns])
    kept = [*keep, truth] if truth in df.columns else list(keep)
    return df.select(*kept, F.explode(seats).alias("s")).select(*kept, "s.*")


def scored(long: DataFrame, bins: int = 10, truth: str = "ground_truth") -> DataFrame:
    """Rows with label, confidence and truth, with ``correct`` and the confidence bin."""
    return (long.dropna(subset=["conf", "label", truth])
            .withColumns({"correct": (F.col("label") == F.col(truth)).cast("int"),
                          "bin": K.confidence_bin(F.col("conf"), bins)}))


def reliability(scores: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Mean confidence, accuracy and count of every filled bin."""
    return (scores.filter(F.col("bin").isNotNull()).groupBy(*by, "bin")
            .agg(F.avg("conf").alias("mean_conf"), F.avg("correct").alias("accuracy"),
                 F.count(F.lit(1)).alias("n")))


def expected_calibration_error(scores: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """ECE per group.  Rows outside the bins stay in the denominator."""
    bins = scores.groupBy(*by, "bin").agg(
        F.avg("conf").alias("mean_conf"), F.avg("correct").alias("accuracy"),
        F.count(F.lit(1)).alias("n"))
    gap = F.when(F.col("bin").isNotNull(),
                 F.col("n") * F.abs(F.col("accuracy") - F.col("mean_conf"))).otherwise(F.lit(0.0))
    return bins.groupBy(*by).agg((F.sum(gap) / F.sum("n")).alias("ece"))


def quadrants(scores: DataFrame, threshold: float = 0.9, by: Sequence[str] = ("model",)) -> DataFrame:
    """Counts of correct/wrong by high/low confidence."""
    right, high = F.col("correct") == 1, F.col("conf") >= F.lit(threshold)
    return scores.groupBy(*by).agg(
        F.count_if(right & high).alias("correct_high"), F.count_if(right & ~high).alias("correct_low"),
        F.count_if(~right & high).alias("wrong_high"), F.count_if(~right & ~high).alias("wrong_low"))


def confidence_by_class(long: DataFrame, classes: Sequence[int] | None = None,
                        invalid: int = -1) -> DataFrame:
    """Mean confidence by model and predicted class; pivoted when the classes are given."""
    rows = long.filter(F.col("label") != F.lit(invalid))
    if classes is None:
        return rows.groupBy("model", F.col("label").alias("class")).agg(F.avg("conf").alias("mean_conf"))
    wide = rows.groupBy("model").pivot("label", list(classes)).agg(F.avg("conf"))
    return wide.select("model", *[F.col(f"`{c}`").alias(f"class_{c}") for c in classes])


def confidence_gap(scores: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    right = F.avg(F.when(F.col("correct") == 1, F.col("conf")))
    wrong = F.avg(F.when(F.col("correct") == 0, F.col("conf")))
    return scores.groupBy(*by).agg(right.alias("conf_correct"), wrong.alias("conf_wrong"),
                                   (right - wrong).alias("gap"))


def balanced_rows(scores: DataFrame, identity: str, by: Sequence[str] = ("model",),
                  seed: int = 42) -> DataFrame:
    """Per group and bin, equally many correct and wrong rows, drawn by seeded hash.

    The smaller side is kept whole; only the bucket cut by the limit is ordered, so a bin
    with a third of all rows never meets in one task.
    """
    inside = scores.filter(F.col("bin").isNotNull())
    sides = inside.groupBy(*by, "bin").agg(
        F.least(F.count_if(F.col("correct") == 1), F.count_if(F.col("correct") == 0)).alias("k"))
    both = F.explode(F.array(F.lit(0), F.lit(1))).alias("correct")
    limits = sides.filter(F.col("k") > 0).select(*by, "bin", both, "k")
    order = T.shuffle_key(identity, seed)
    return ranking.smallest(inside, order, ranking.hash_bucket(order), limits, identity,
                            [*by, "bin", "correct"])


def balanced_brier(scores: DataFrame, identity: str, by: Sequence[str] = ("model",),
                   seed: int = 42) -> DataFrame:
    """Brier score over the balanced rows; null for a group without a two-sided bin."""
    err = F.col("conf") - F.col("correct")
    known = scores.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"))
    score = balanced_rows(scores, identity, by, seed).groupBy(*by).agg(F.avg(err * err).alias("bbs"))
    return known.join(score, list(by), "left").drop("rows")


def balanced_brier_by_bin(scores: DataFrame, identity: str, by: Sequence[str] = ("model",),
                          seed: int = 42) -> DataFrame:
    """Balanced Brier score per bin beside the mean confidence of the whole bin."""
    err = F.col("conf") - F.col("correct")
    score = (balanced_rows(scores, identity, by, seed).groupBy(*by, "bin")
             .agg(F.avg(err * err).alias("bbs_bin")))
    whole = scores.groupBy(*by, "bin").agg(F.avg("conf").alias("mean_conf"))
    return score.join(whole, [*by, "bin"])


def hit_rate_by_bin(df: DataFrame, conf: str, correct: str, by: Sequence[str] = (),
                    bins: int = 10) -> DataFrame:
    """Share of correct rows and count per confidence bin, over all or by group."""
    slot = K.confidence_bin(F.col(conf), bins)
    return (df.withColumn("bin", slot).filter(F.col("bin").isNotNull()).groupBy(*by, "bin")
            .agg(F.avg(F.col(correct).cast("double")).alias("hit_rate"), F.count(F.lit(1)).alias("n")))


def calibration_comparison(scores: DataFrame, identity: str, by: Sequence[str] = ("model",),
                           seed: int = 42) -> DataFrame:
    """ECE and balanced Brier score side by side."""
    return expected_calibration_error(scores, by).join(balanced_brier(scores, identity, by, seed), list(by))


def confidence_profile(df: DataFrame, by: Sequence[str], confidence: str = "mean_confidence", correct: str = "correct") -> DataFrame:
    """Per group: rows, mean and quartiles of the confidence, and the hit rate.

    Quartiles are exact and interpolated; a group may hold any share of the rows.  Rows without a confidence count
    for the hit rate only.
    """
    means = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(confidence).alias("mean"), F.min(confidence).alias("min"),
                                F.max(confidence).alias("max"), F.avg(correct).alias("hit_rate"))
    found = ranking.exact_quantiles(df, confidence, [0.25, 0.5, 0.75], by)
    at = [F.max(F.when(F.col("fraction") == f, F.col("quantile"))).alias(name) for f, name in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))]
    return null_safe_join(means, found.groupBy(*by).agg(*at), list(by), "left")
