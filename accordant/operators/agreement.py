"""Agreement between annotators: raw pairs, Cohen, Fleiss, Krippendorff."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from accordant.functions import votes as V
from accordant.operators.consensus import annotator_name, vote_columns

# Lower cuts of the kappa bands and their names.
KAPPA_BANDS = ((0.8, "Excelente"), (0.6, "Bom"), (0.4, "Moderado"), (0.2, "Fraco"))
KAPPA_LOWEST = "Muito Fraco"


def interpret(kappa: Column) -> Column:
    """Name of the kappa band; an undefined kappa falls into the lowest one."""
    band = F.lit(KAPPA_LOWEST)
    for cut, name in reversed(KAPPA_BANDS):
        band = F.when(kappa > cut, name).otherwise(band)
    return band


#: Up to so many annotators the pairs are written out in one aggregate; beyond, generated code would grow with their square.
WRITTEN_OUT = 16


def gram_counts(df: DataFrame, columns: Sequence[str], rows: int = 4096) -> DataFrame:
    """(i, j, agreeing) for i < j: in how many rows two annotators gave the same label; pairs without any are left out.

    Agreement over all labels is the sum of products of indicator matrices (rows x annotators), one per label.  Tasks
    multiply blocks of rows and add the products up; what they return, and hold, is annotators x annotators at most.
    """
    def count(batches):
        import numpy as np
        import pyarrow as pa

        total = np.zeros((len(columns), len(columns)), dtype=np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                codes = [c.cast(pa.int64()) for c in part.columns]
                seen = np.column_stack([np.asarray(c.is_valid()) for c in codes])
                votes = np.column_stack([np.asarray(c.fill_null(0)) for c in codes])
                for label in np.unique(votes[seen]):
                    one = ((votes == label) & seen).astype(np.float32)
                    total += (one.T @ one).astype(np.int64)
        i, j = np.nonzero(np.triu(total, 1))
        yield pa.RecordBatch.from_pydict({"i": i, "j": j, "agreeing": total[i, j]}, schema=pa.schema([("i", pa.int32()), ("j", pa.int32()), ("agreeing", pa.int64())]))

    votes = df.select(*[F.col(f"`{c}`").cast("long").alias(f"v{k}") for k, c in enumerate(columns)])
    return votes.mapInArrow(count, "i int, j int, agreeing bigint").groupBy("i", "j").agg(F.sum("agreeing").alias("agreeing"))


def _all_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The rows of ``_pair_counts`` from ``gram_counts``; the pairs come from a range, so the plan stays small."""
    n = len(columns)
    names = F.array(*[F.lit(annotator_name(c)) for c in columns])
    i, j = (F.col("id") / n).cast("int").alias("i"), (F.col("id") % n).cast("int").alias("j")
    pairs = df.sparkSession.range(n * n).select(i, j).filter("i < j")
    counted = pairs.join(gram_counts(df, columns), ["i", "j"], "left")
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return counted.select(F.get(names, "i").alias("annotator_1"), F.get(names, "j").alias("annotator_2"), "i", "j",
                          F.coalesce("agreeing", F.lit(0)).alias("agreeing"), total.alias("n"))


def _pair_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per pair i < j with the agreeing and total rows: a single aggregate."""
    if len(columns) > WRITTEN_OUT:
        return _all_pairs(df, columns)
    pairs = list(combinations(range(len(columns)), 2))
    sums = [F.count_if(V.same(F.col(columns[i]), F.col(columns[j]))).alias(f"p{i}_{j}")
            for i, j in pairs]
    wide = df.agg(F.count(F.lit(1)).alias("n"), *sums)
    names = [annotator_name(c) for c in columns]
    rows = F.array(*[
        F.struct(F.lit(names[i]).alias("annotator_1"), F.lit(names[j]).alias("annotator_2"),
                 F.lit(i).alias("i"), F.lit(j).alias("j"),
                 F.col(f"p{i}_{j}").alias("agreeing")) for i, j in pairs])
    return wide.select("n", F.explode(rows).alias("p")).select("p.*", "n")


def pairwise_agreement(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Full symmetric table (annotator_1, annotator_2, agreement) with ones on the diagonal."""
    columns = list(columns or vote_columns(df.columns))
    pairs = _pair_counts(df, columns)
    value = F.try_divide(F.col("agreeing"), F.col("n"))
    both = F.array(
        F.struct(F.col("annotator_1").alias("annotator_1"), F.col("annotator_2").alias("annotator_2"),
                 value.alias("agreement")),
        F.struct(F.col("annotator_2").alias("annotator_1"), F.col("annotator_1").alias("annotator_2"),
                 value.alias("agreement")),
    )
    off = pairs.select(F.explode(both).alias("e")).select("e.*")
    names = F.array(*[F.lit(annotator_name(c)) for c in columns])
    diagonal = (df.agg(F.count(F.lit(1)).alias("n")).select(F.explode(names).alias("annotator_1"))
                .select("annotator_1", F.col("annotator_1").alias("annotator_2"),
                        F.lit(1.0).alias("agreement")))
    return off.unionByName(diagonal)


def to_matrix(pairs: DataFrame, value: str, names: Sequence[str], row: str = "annotator_1",
              col: str = "annotator_2") -> DataFrame:
    """Pivot a long pair table into a square one; the column list is known, so no extra job."""
    return (pairs.groupBy(F.col(row).alias("annotator")).pivot(col, list(names))
            .agg(F.first(value)))


def _label_marginals(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    seats = F.array(*[F.struct(F.lit(i).alias("seat"), F.col(c).alias("label"))
                      for i, c in enumerate(columns)])
    return (df.select(F.explode(seats).alias("s")).select("s.*")
            .groupBy("seat", "label").agg(F.count(F.lit(1)).alias("m")))


def cohen_kappa(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Kappa of every annotator pair; null when chance agreement is complete.

    Observed agreement is one aggregate, the label marginals another; only their results,
    one row per annotator and label, are joined.
    """
    columns = list(columns or vote_columns(df.columns))
    left = _label_marginals(df, columns)
    right = left.select(F.col("seat").alias("seat2"), "label", F.col("m").alias("m2"))
    chance = (left.join(right, "label").filter(F.col("seat") < F.col("seat2"))
              .groupBy(F.col("seat").alias("i"), F.col("seat2").alias("j"))
              .agg(F.sum(F.col("m").cast("double") * F.col("m2")).alias("hits")))
    kappa = F.col("cohens_kappa")
    po = F.col("agreeing") / F.col("n")
    pe = F.coalesce("hits", F.lit(0.0)) / F.col("n").cast("double") / F.col("n")
    return (_pair_counts(df, columns).join(chance, ["i", "j"], "left")
            .select("annotator_1", "annotator_2",
                    F.try_divide(po - pe, F.lit(1.0) - pe).alias("cohens_kappa"))
            .withColumn("interpretation", interpret(kappa)))


def symmetric(pairs: DataFrame, value: str, names: Sequence[str]) -> DataFrame:
    """Long pair table to a symmetric one with ones on the diagonal, as (a, b, value)."""
    ends = F.array(F.struct(F.col("annotator_1").alias("a"), F.col("annotator_2").alias("b")),
                   F.struct(F.col("annotator_2").alias("a"), F.col("annotator_1").alias("b")))
    off = pairs.select(F.explode(ends).alias("e"), F.col(value).alias("v")).select("e.a", "e.b", "v")
    one = F.explode(F.array(*[F.lit(n) for n in names])).alias("a")
    diagonal = pairs.agg(F.count(F.lit(1)).alias("n")).select(one).select(
        "a", F.col("a").alias("b"), F.lit(1.0).alias("v"))
    return off.unionByName(diagonal)


def fleiss_kappa(df: DataFrame, columns: Sequence[str] | None = None, *,
                 categories: Sequence[int]) -> DataFrame:
    """Fleiss' kappa over a fixed category list: one pass, one row.

    Votes outside the categories are not counted, yet every seat stays in the denominators.
    """
    columns = list(columns or vote_columns(df.columns))
    k = len(columns)
    votes = [F.col(c) for c in columns]

    def count_of(category: int) -> Column:
        return sum((V.same(v, F.lit(category)).cast("int") for v in votes[1:]),
                   V.same(votes[0], F.lit(category)).cast("int"))

    per_category = {f"__c{i}": count_of(c) for i, c in enumerate(categories)}
    squares = sum((F.col(c) * F.col(c) for c in list(per_category)[1:]),
                  F.col("__c0") * F.col("__c0"))
    totals = (df.select(*columns).withColumns(per_category)
              .agg(F.count(F.lit(1)).alias("n"), F.sum(squares).alias("sq"),
                   *[F.sum(c).alias(c) for c in per_category]))
    n = F.col("n").cast("double")
    p_bar = (F.col("sq") - n * k) / (n * (k * (k - 1)))
    shares = [F.col(c) / (n * k) for c in per_category]
    p_e = sum((s * s for s in shares[1:]), shares[0] * shares[0])
    kappa = F.when(p_e == 1.0, F.lit(1.0)).otherwise(F.try_divide(p_bar - p_e, F.lit(1.0) - p_e))
    return (totals.filter(F.col("n") > 0)
            .select(F.col("n").alias("items"), p_bar.alias("p_bar"), p_e.alias("p_e"),
                    kappa.alias("fleiss_kappa"))
            .withColumn("interpretation", interpret(F.col("fleiss_kappa"))))


def krippendorff_alpha(df: DataFrame, columns: Sequence[str] | None = None, *,
                       invalid: int | None = -1) -> DataFrame:
    """Nominal alpha from coincidence counts; rows with fewer than two usable votes drop out."""
    columns = list(columns or vote_columns(df.columns))
    usable = [F.when(F.col(c) != F.lit(invalid), F.col(c)) if invalid is not None else F.col(c)
              for c in columns]
    units = df.select(F.array_compact(F.array(*usable)).alias("votes")).filter(F.size("votes") >= 2)
    m = F.size("votes").cast("double")
    matches = F.aggregate(
        "votes", F.lit(0), lambda acc, x: acc + F.size(F.filter("votes", lambda y: y == x)))
    seen = units.agg(F.sum((m * m - matches) / (m - 1.0)).alias("d_o"), F.sum(m).alias("n"))
    spread = (units.select(F.explode("votes").alias("label")).groupBy("label")
              .agg(F.count(F.lit(1)).cast("double").alias("c"))
              .agg(F.sum(F.col("c") * F.col("c")).alias("sq")))
    n = F.col("n")
    d_e = (n * n - spread.scalar()) / (n - 1.0)
    return seen.select(n.cast("bigint").alias("pairable_votes"),
                       (F.lit(1.0) - F.try_divide(F.col("d_o"), d_e)).alias("alpha"))
