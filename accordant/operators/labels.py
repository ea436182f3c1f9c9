"""Label descriptions, category inference and label distribution."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import chain

from pyspark.sql import DataFrame, Window, functions as F

from accordant.functions.tails import chi2_sf
from accordant.operators.joins import measured


def describe(df: DataFrame, meanings: Mapping[str, str] | DataFrame, label: str = "label",
             out: str = "label_description") -> DataFrame:
    """Add the meaning of each label: a literal map, or a left join with (label, description)."""
    if isinstance(meanings, DataFrame):
        named = meanings.select(F.col(meanings.columns[0]).cast("string").alias("__label"),
                                F.col(meanings.columns[1]).alias(out))
        return df.join(measured(named), F.col(label).cast("string") == F.col("__label"), "left").drop("__label")
    if not meanings:
        return df.withColumn(out, F.lit(None).cast("string"))
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(meanings.items())])
    return df.withColumn(out, F.try_element_at(table, F.col(label).cast("string")))


def label_schema(df: DataFrame) -> DataFrame:
    """Distinct labels with their description and a dense id in label order."""
    pairs = df.select("label", "label_description").distinct()
    return pairs.orderBy("label")


def encode(df: DataFrame, label: str, out: str = "class_index") -> DataFrame:
    """Add the 0-based position of the label among the sorted distinct labels."""
    codes = df.select(label).filter(F.col(label).isNotNull()).distinct().withColumn(
        out, (F.row_number().over(Window.orderBy(label)) - 1).cast("int"))
    return df.join(measured(codes), label, "left")


def infer_categories(df: DataFrame, columns: Sequence[str], invalid: int | None = -1) -> DataFrame:
    """Sorted distinct integer labels over several columns, without nulls and the sentinel."""
    values = F.explode(F.array(*[F.expr(f"try_cast(`{c}` AS INT)") for c in columns]))
    found = df.select(values.alias("label")).filter(F.col("label").isNotNull())
    if invalid is not None:
        found = found.filter(F.col("label") != F.lit(invalid))
    return found.distinct().orderBy("label")


def category_list(df: DataFrame, columns: Sequence[str], invalid: int | None = -1,
                  at_most: int = 10_000) -> list[int]:
    """The inferred categories as a Python list; refuses a column that is no label."""
    rows = infer_categories(df, columns, invalid).take(at_most + 1)
    if len(rows) > at_most:
        raise ValueError(f"more than {at_most} distinct labels in {list(columns)}")
    return [r["label"] for r in rows]


def distribution(df: DataFrame, label: str = "label") -> DataFrame:
    """Count and share of every label."""
    counts = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n"))
    return counts.withColumn("share", F.col("n") / total.scalar())


def uniformity(df: DataFrame, label: str = "label", p_value: bool = True) -> DataFrame:
    """Chi-square test of equal label frequencies, as one row."""
    counts = df.filter(F.col(label).isNotNull()).groupBy(label).agg(
        F.count(F.lit(1)).cast("double").alias("n"))
    sums = counts.agg(F.count(F.lit(1)).alias("classes"), F.sum("n").alias("total"),
                      F.sum(F.col("n") * F.col("n")).alias("sq"))
    out = sums.select(
        "classes", (F.col("sq") * F.col("classes") / F.col("total") - F.col("total")).alias("chi2"),
        (F.col("classes") - 1).alias("df"))
    return out.withColumn("p_value", chi2_sf(F.col("chi2"), F.col("df"))) if p_value else out
