"""Per-text vote resolution and its summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from accordant.functions import text as T, votes as V

SUFFIX = "_consensus"


def vote_columns(columns: Sequence[str]) -> list[str]:
    """Annotator label columns: the name carries ``_consensus`` and no ``_score``."""
    found = [c for c in columns if SUFFIX in c and "_score" not in c]
    if not found:
        raise ValueError("no annotator column named *_consensus")
    return found


def paired_vote_columns(columns: Sequence[str], suffix: str = SUFFIX) -> list[str]:
    """Annotator label columns that come with their ``*_score`` companion."""
    known = set(columns)
    found = [c for c in columns if c.endswith(suffix) and c != suffix and f"{c}_score" in known]
    if not found:
        raise ValueError(f"no annotator column ending in {suffix} with a score column beside it")
    return found


def annotator_name(column: str) -> str:
    return column.replace(SUFFIX, "")


def _strategy(name: str | None) -> V.Strategy:
    if name is None:
        return V.flag_for_review
    if name not in V.STRATEGIES:
        raise ValueError(f"unknown strategy {name!r}; known: {sorted(V.STRATEGIES)}")
    return V.STRATEGIES[name]


def resolve(df: DataFrame, columns: Sequence[str] | None = None, *, threshold: float = 0.8,
            strategy: str | None = "majority_vote",
            params: Mapping[str, Any] | None = None) -> DataFrame:
    """Add the consensus columns.  A projection: one scan, no shuffle.

    Rows at or above ``threshold`` take the mode; the rest go to ``strategy``
    (``None`` leaves them unresolved).
    """
    columns = list(columns or vote_columns(df.columns))
    rule = _strategy(strategy)
    staged, ballot, helpers = V.tally(df, columns, [annotator_name(c) for c in columns], params)
    score = F.col("consensus_score")
    # Majority gives the mode on either side of the threshold.
    resolved = F.col("most_common_annotation") if rule is V.majority_vote else F.when(
        score >= F.lit(threshold), F.col("most_common_annotation")).otherwise(rule(ballot))
    return (
        staged.withColumns({
            "all_annotations": F.array(*ballot.votes),
            "unique_annotations": ballot.distinct,
            "most_common_annotation": ballot.mode,
            "most_common_count": ballot.top,
            "consensus_score": ballot.top / F.lit(ballot.seats),
            "is_problematic": ballot.tied,
        })
        .withColumns({
            "consensus_level": V.level(score),
            "resolved_annotation": resolved,
        })
        .withColumn("needs_review", F.col("resolved_annotation").isNull())
        .drop(*helpers)
    )


def agreement_pattern(df: DataFrame, columns: Sequence[str] | None = None,
                      out: str = "pattern") -> DataFrame:
    """Add the signature of the vote group sizes."""
    columns = list(columns or vote_columns(df.columns))
    staged, ballot, helpers = V.tally(df, columns)
    return staged.withColumn(out, V.pattern(ballot)).drop(*helpers)


def vote_entropy(df: DataFrame, columns: Sequence[str] | None = None,
                 out: str = "entropy") -> DataFrame:
    columns = list(columns or vote_columns(df.columns))
    staged, ballot, helpers = V.tally(df, columns)
    return staged.withColumn(out, V.entropy_bits(ballot)).drop(*helpers)


def problematic_cases(df: DataFrame, columns: Sequence[str] | None = None, *,
                      threshold: float = 0.6, as_text: bool = False,
                      keep: Sequence[str] = ("text_id",)) -> DataFrame:
    """Rows whose top share is under ``threshold``, with their vote counts and entropy."""
    columns = list(columns or vote_columns(df.columns))
    staged, ballot, _ = V.tally(df, columns)
    score = ballot.top / F.lit(ballot.seats)
    shown: list[Column] = [F.col(c) for c in keep]
    if "text" in df.columns:
        shown.append(T.excerpt("text").alias("text"))
    return staged.filter(score < F.lit(threshold)).select(
        *shown,
        score.alias("consensus_score"),
        (V.vote_map_text(ballot) if as_text else V.vote_map(ballot)).alias("annotations"),
        V.entropy_bits(ballot).alias("entropy"),
    )


def repetition_consensus(long: DataFrame, keys: Sequence[str] = ("text_id", "annotator")) -> DataFrame:
    """One label per text and annotator over its repetitions.

    The mode wins, the earliest repetition breaks ties.  Two hash aggregations; the first
    one combines on the map side, so many copies of one text do not meet in a task.
    """
    per_label = long.groupBy(*keys, "label").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("rep").alias("first_rep"),
        F.sum("elapsed_sec").alias("elapsed_sec"),
    )
    return per_label.groupBy(*keys).agg(
        F.max_by("label", F.struct(F.col("n"), -F.col("first_rep"))).alias("label"),
        (F.max("n") / F.sum("n")).alias("score"),
        F.sum("n").alias("repetitions"),
        F.sum("elapsed_sec").alias("elapsed_sec"),
    )


def confidence_split(df: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Mark each row ``high_confidence`` or ``needs_review`` by its consensus score."""
    return df.withColumn(
        "subset",
        F.when(F.col("consensus_score") >= F.lit(threshold), "high_confidence")
        .otherwise("needs_review"))


def valid_for_evaluation(df: DataFrame, invalid: int = -1) -> DataFrame:
    """Rows with a usable resolved label."""
    return df.filter(F.col("resolved_annotation").isNotNull()
                     & (F.col("resolved_annotation") != F.lit(invalid)))


def consensus_universe(df: DataFrame, invalid: int = -1, min_votes: int = 2) -> DataFrame:
    """Rows with valid truth, valid label and at least ``min_votes`` equal votes."""
    return df.filter(
        (F.col("ground_truth") != F.lit(invalid))
        & (F.col("resolved_annotation") != F.lit(invalid))
        & (F.col("most_common_count") >= F.lit(min_votes)))


def stats(df: DataFrame) -> DataFrame:
    """Counts and shares by level, ties and open reviews: one aggregate."""
    n = F.count(F.lit(1))

    def pair(name: str, cond: Column) -> list[Column]:
        hits = F.count_if(cond)
        return [hits.alias(name), (hits / n).alias(f"{name}_share")]

    level = F.col("consensus_level")
    return df.agg(
        n.alias("total"),
        *pair("high", level == "high"),
        *pair("medium", level == "medium"),
        *pair("low", level == "low"),
        *pair("problematic", F.col("is_problematic")),
        *pair("needs_review", F.col("needs_review")),
    )


def summary(df: DataFrame) -> DataFrame:
    """Mean, exact median, deviation and level counts of the consensus score.

    The score takes one value per seat count, so the exact median's buffer stays tiny.
    """
    level = F.col("consensus_level")
    return df.agg(
        F.count(F.lit(1)).alias("total_texts"),
        F.avg("consensus_score").alias("consensus_mean"),
        F.median("consensus_score").alias("consensus_median"),
        F.stddev_samp("consensus_score").alias("consensus_std"),
        F.count_if(level == "high").alias("high_consensus"),
        F.count_if(level == "medium").alias("medium_consensus"),
        F.count_if(level == "low").alias("low_consensus"),
    )


def level_distribution(df: DataFrame) -> DataFrame:
    return df.groupBy("consensus_level").agg(F.count(F.lit(1)).alias("n"))


def score_histogram(df: DataFrame, bins: int = 20, column: str = "consensus_score",
                    lo: float = 0.0, hi: float = 1.0) -> DataFrame:
    """Equal-width histogram over [lo, hi]; the last bin is closed, empty bins are left out."""
    place = F.floor((F.col(column) - F.lit(lo)) * F.lit(bins) / F.lit(hi - lo))
    slot = F.least(place, F.lit(bins - 1)).cast("int")
    return df.groupBy(slot.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def throughput(long: DataFrame) -> DataFrame:
    """Calls, total and mean seconds, and calls per second by annotator."""
    return long.groupBy("annotator").agg(
        F.count(F.lit(1)).alias("calls"),
        F.sum("elapsed_sec").alias("total_sec"),
        F.avg("elapsed_sec").alias("avg_sec"),
        F.try_divide(F.count(F.lit(1)), F.sum("elapsed_sec")).alias("calls_per_sec"),
    )
