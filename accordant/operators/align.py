"""Joins between annotations, ground truth, folds and id lists.

Every id list is deduplicated first, so each join has at most one match per key on its right
side; copies on the left stay where they are and a hot key there is split by AQE.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from accordant.functions import text as T
from accordant.operators.dedup import keep_first, require_unique
from accordant.operators.joins import distinct_keys


def attach_truth(annotations: DataFrame, truth: DataFrame, order: str, key: str = "text_id",
                 column: str = "ground_truth") -> DataFrame:
    """Left join of the first truth per key."""
    wanted = list(dict.fromkeys([key, order, column]))
    first = keep_first(truth.select(*wanted), key, order).select(key, column)
    return annotations.join(first, key, "left")


def align_one_to_one(truth: DataFrame, annotated: DataFrame, truth_label: str,
                     annotated_label: str, key: str = "text_id", check: bool = True) -> DataFrame:
    """Inner join of two tables with unique keys: text and both labels side by side."""
    if check:
        require_unique(truth, key, "ground truth")
        require_unique(annotated, key, "annotations")
    right = annotated.select(key, F.col(annotated_label).alias("annotated_label"))
    return (truth.select(key, "text", F.col(truth_label).alias("truth_label")).join(right, key))


def keep_ids(df: DataFrame, ids: DataFrame, key: str = "text_id") -> DataFrame:
    return df.join(distinct_keys(ids, key), key, "left_semi")


def drop_ids(df: DataFrame, ids: DataFrame, key: str = "text_id") -> DataFrame:
    return df.join(distinct_keys(ids, key), key, "left_anti")


def drop_invalid(df: DataFrame, label: str = "label", key: str = "text_id", invalid: int = -1) -> DataFrame:
    """Drop every row of a key that carries the invalid label anywhere."""
    return drop_ids(df, df.filter(F.col(label) == F.lit(invalid)), key)


def remaining_texts(texts: DataFrame, done: DataFrame, key: str = "text_id") -> DataFrame:
    """Texts without an annotation yet."""
    return drop_ids(texts, done, key)


def remove_annotated_texts(texts: DataFrame, done: DataFrame, text: str = "text") -> DataFrame:
    """Texts that do not occur verbatim among the annotated ones.

    Matched by the md5 of the raw text, so that the shuffle key is short whatever the text.
    """
    ids = done.select(F.md5(F.col(text)).alias("__raw"))
    return drop_ids(texts.withColumn("__raw", F.md5(F.col(text))), ids, "__raw").drop("__raw")


def train_rows(folds: DataFrame, annotated: DataFrame, key: str = "text_id") -> DataFrame:
    """Annotated rows of every fold's training ids, all folds in one join."""
    wanted = distinct_keys(folds.filter(F.col("split") == "train"), "fold", key)
    return annotated.join(wanted, key)


def split_coverage(folds: DataFrame, annotated: DataFrame, key: str = "text_id") -> DataFrame:
    """Per fold: training rows, annotated rows found, their ratio and the missing ids."""
    per_id = (folds.filter(F.col("split") == "train").groupBy("fold", key)
              .agg(F.count(F.lit(1)).alias("fold_rows")))
    have = annotated.groupBy(key).agg(F.count(F.lit(1)).alias("rows"))
    return (per_id.join(have, key, "left").groupBy("fold").agg(
        F.sum("fold_rows").alias("fold_rows"),
        F.coalesce(F.sum("rows"), F.lit(0)).alias("annotated_rows"),
        F.count_if(F.col("rows").isNull()).alias("missing_ids"))
        .withColumn("coverage", F.try_divide(F.col("annotated_rows"), F.col("fold_rows"))))


def without_leakage(evaluation: DataFrame, train: DataFrame, key: str = "text_id") -> DataFrame:
    """Evaluation rows whose id is not in the training rows of the same fold."""
    return evaluation.join(distinct_keys(train, "fold", key), ["fold", key], "left_anti")


def align_folds(folds: DataFrame, annotated: DataFrame, key: str = "text_id",
                allow_duplicate_ids: bool = False) -> DataFrame:
    """Training rows with annotated labels, evaluation rows with true labels, free of leakage.

    ``folds`` holds (fold, split, key, label) and, if it must, text; the result has the same columns.
    Without text every join is narrow, and the caller fetches each text once, at the end.
    """
    if not allow_duplicate_ids:
        require_unique(annotated, key, "annotations")
    cols = [c for c in ("fold", "split", key, "text", "label") if c in folds.columns]
    train = train_rows(folds, annotated, key).withColumn("split", F.lit("train"))
    evaluation = without_leakage(folds.filter(F.col("split") != "train"), train, key)
    return train.select(*cols).unionByName(evaluation.select(*cols))


def pair_folds(left: DataFrame, right: DataFrame, value: str = "f1_macro") -> DataFrame:
    """Fold scores of two systems over their common folds, with the difference."""
    a = left.select("dataset", "fold", F.col(value).alias("value_a"))
    b = right.select("dataset", "fold", F.col(value).alias("value_b"))
    return a.join(b, ["dataset", "fold"]).withColumn("diff", F.col("value_a") - F.col("value_b"))


def id_overlap(left: DataFrame, right: DataFrame, key: str = "text_id") -> DataFrame:
    """Distinct ids in both tables and in only one of them."""
    marks = (left.select(key, F.lit(1).alias("l"), F.lit(0).alias("r"))
             .unionByName(right.select(key, F.lit(0).alias("l"), F.lit(1).alias("r"))))
    seen = marks.groupBy(key).agg(F.max("l").alias("l"), F.max("r").alias("r"))
    return seen.agg(F.count_if((F.col("l") == 1) & (F.col("r") == 1)).alias("in_both"),
                    F.count_if((F.col("l") == 1) & (F.col("r") == 0)).alias("only_left"),
                    F.count_if((F.col("l") == 0) & (F.col("r") == 1)).alias("only_right"))


def whitespace_report(left: DataFrame, right: DataFrame, text: str = "text") -> DataFrame:
    """Newline edges of both sides and id matches before and after stripping, as one row."""
    def edges(df: DataFrame, tag: str) -> DataFrame:
        return df.agg(F.count_if(T.starts_with_newline(text)).alias(f"{tag}_starts_newline"),
                      F.count_if(T.ends_with_newline(text)).alias(f"{tag}_ends_newline"))

    def matches(make) -> DataFrame:
        a, b = (d.select(make(F.col(text)).alias("text_id")) for d in (left, right))
        return id_overlap(a, b).select("in_both")

    both = edges(right, "right")
    return (edges(left, "left")
            .withColumns({c: both.select(c).scalar() for c in both.columns})
            .withColumns({"ids_matching_raw": matches(F.md5).scalar(),
                          "ids_matching_stripped": matches(T.text_id).scalar()}))
