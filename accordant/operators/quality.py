"""Label quality against ground truth, all from one confusion count per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from accordant.operators.consensus import annotator_name

INVALID = -1
_MACRO = ("accuracy", "f1_macro", "precision_macro", "recall_macro")


def clean_label(label: Column | str, errors: Sequence[str] = ("ERROR", "", "N/A")) -> Column:
    """Error tokens, nulls and anything that is no integer become -1."""
    raw = (F.col(label) if isinstance(label, str) else label).cast("string")
    return F.coalesce(F.when(~raw.isin(*errors), raw.try_cast("int")), F.lit(INVALID))


def confusion(df: DataFrame, truth: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """Counts by (groups, truth, prediction).  Partial aggregation leaves a few rows per task."""
    return df.groupBy(*by, F.col(truth).alias("gt"), F.col(pred).alias("pred")).agg(
        F.count(F.lit(1)).alias("n"))


def _weighed(counts: DataFrame, kept: Column) -> DataFrame:
    """Counts set to zero where the condition fails.

    A filter would be pushed below the count, and the rows it drops could no longer be
    counted in the same scan.
    """
    return counts.withColumn("n", F.when(kept, F.col("n")).otherwise(F.lit(0).cast("bigint")))


def per_class(counts: DataFrame, by: Sequence[str] = (), carry: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support of every class seen in truth or prediction.

    ``carry`` names further count columns to add up beside them; with it, classes without a
    counted row stay in the table.
    """
    zero, none = F.lit(0.0), F.lit(0).cast("bigint")
    hit = F.when(F.col("gt") == F.col("pred"), F.col("n")).otherwise(none)
    ends = F.array(
        F.struct(F.col("gt").alias("label"), hit.alias("tp"), F.col("n").alias("support"),
                 none.alias("predicted"), *[F.col(c).alias(c) for c in carry]),
        F.struct(F.col("pred").alias("label"), none.alias("tp"), none.alias("support"),
                 F.col("n").alias("predicted"), *[none.alias(c) for c in carry]),
    )
    sums = (counts.select(*by, F.explode(ends).alias("e")).select(*by, "e.*")
            .groupBy(*by, "label")
            .agg(*[F.sum(c).alias(c) for c in ("tp", "support", "predicted", *carry)]))
    if not carry:
        sums = sums.filter(F.col("support") + F.col("predicted") > 0)
    return sums.withColumns({
        "precision": F.coalesce(F.try_divide(F.col("tp"), F.col("predicted")), zero),
        "recall": F.coalesce(F.try_divide(F.col("tp"), F.col("support")), zero),
        "f1": F.coalesce(F.try_divide(F.lit(2) * F.col("tp"), F.col("support") + F.col("predicted")), zero),
    })


def macro(classes: DataFrame, by: Sequence[str] = (), carry: Sequence[str] = ()) -> DataFrame:
    seen = F.col("support") + F.col("predicted") > 0
    return classes.groupBy(*by).agg(
        F.sum("support").alias("n"),
        F.try_divide(F.sum("tp"), F.sum("support")).alias("accuracy"),
        *[F.avg(F.when(seen, F.col(m))).alias(f"{m}_macro") for m in ("f1", "precision", "recall")],
        *[F.sum(c).alias(c) for c in carry],
    )


def macro_metrics(df: DataFrame, truth: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy and macro precision, recall and F1 by group over rows with both labels."""
    both = df.filter(F.col(truth).isNotNull() & F.col(pred).isNotNull())
    return macro(per_class(confusion(both, truth, pred, by), by), by)


def model_metrics(df: DataFrame, columns: Sequence[str], truth: str = "ground_truth") -> DataFrame:
    """Metrics of every annotator over rows with a truth, best macro F1 first.

    Rows where either label is -1 count in coverage but not in the quality figures.
    """
    seats = F.array(*[F.struct(F.lit(annotator_name(c)).alias("model"), clean_label(c).alias("pred"))
                      for c in columns])
    long = (df.filter(F.col(truth).isNotNull())
            .select(F.col(truth).cast("int").alias("gt"), F.explode(seats).alias("s"))
            .select("gt", "s.model", "s.pred"))
    counts = long.groupBy("model", "gt", "pred").agg(F.count(F.lit(1)).alias("n")).withColumns({
        "answers": F.col("n"), "usable": F.when(F.col("pred") != INVALID, F.col("n")).otherwise(0)})
    valid = _weighed(counts, (F.col("gt") != INVALID) & (F.col("pred") != INVALID))
    carry = ["answers", "usable"]
    scores = macro(per_class(valid, ["model"], carry), ["model"], carry)
    coverage = F.try_divide(F.col("usable"), F.col("answers"))
    return (scores.select("model", coverage.alias("coverage"), *[F.coalesce(m, F.lit(0.0)).alias(m) for m in _MACRO])
            .withColumns({"error_rate": 1 - F.col("accuracy"),
                          "invalid_predictions_rate": 1 - F.col("coverage")})
            .orderBy(F.desc("f1_macro"), "model"))


def accuracy(df: DataFrame, truth: str = "ground_truth", pred: str = "resolved_annotation") -> DataFrame:
    both = df.filter(F.col(truth).isNotNull() & F.col(pred).isNotNull())
    return both.agg(F.count(F.lit(1)).alias("n"),
                    F.avg((F.col(truth) == F.col(pred)).cast("double")).alias("accuracy"))


def classification_report(df: DataFrame, truth: str = "ground_truth",
                          pred: str = "resolved_annotation", by: Sequence[str] = ()) -> DataFrame:
    """Per-class rows plus ``accuracy``, ``macro avg`` and ``weighted avg``.

    The summary rows are grouping-set margins over the per-class table, which has one row
    per class whatever the size of the input.
    """
    both = df.filter(F.col(truth).isNotNull() & F.col(pred).isNotNull())
    classes = per_class(confusion(both, truth, pred, by), by)
    names = ("precision", "recall", "f1")
    weight = F.col("support")
    rows = classes.select(*by, F.col("label").cast("string").alias("class"), *names, "support")
    total = classes.groupBy(*by).agg(
        F.sum("support").alias("support"),
        F.try_divide(F.sum("tp"), F.sum("support")).alias("accuracy"),
        *[F.avg(m).alias(f"macro_{m}") for m in names],
        *[F.try_divide(F.sum(F.col(m) * weight), F.sum(weight)).alias(f"weighted_{m}") for m in names],
    )
    acc = F.col("accuracy")
    margins = F.array(
        F.struct(F.lit("accuracy").alias("class"), *[acc.alias(m) for m in names]),
        F.struct(F.lit("macro avg").alias("class"), *[F.col(f"macro_{m}").alias(m) for m in names]),
        F.struct(F.lit("weighted avg").alias("class"), *[F.col(f"weighted_{m}").alias(m) for m in names]),
    )
    summary = total.select(*by, "support", F.explode(margins).alias("m")).select(
        *by, "m.class", *[f"m.{m}" for m in names], "support")
    return rows.unionByName(summary)


def confusion_matrix(df: DataFrame, categories: Sequence[int], truth: str = "ground_truth",
                     pred: str = "resolved_annotation") -> DataFrame:
    """Square matrix over ``categories``: truth in rows, one ``pred_<c>`` column per class."""
    inside = df.filter(F.col(truth).isin(*categories) & F.col(pred).isin(*categories))
    cells = (inside.groupBy(F.col(truth).alias("ground_truth")).pivot(pred, list(categories))
             .agg(F.count(F.lit(1))).na.fill(0))
    every = inside.agg(F.count(F.lit(1)).alias("n")).select(
        F.explode(F.array(*[F.lit(c) for c in categories])).alias("ground_truth"))
    wide = every.join(cells, "ground_truth", "left")
    return wide.select("ground_truth", *[
        F.coalesce(F.col(f"`{c}`"), F.lit(0).cast("bigint")).alias(f"pred_{c}") for c in categories])


def cell_metrics(df: DataFrame, by: Sequence[str], cell: Sequence[str],
                 truth: str = "ground_truth", pred: str = "resolved_annotation") -> DataFrame:
    """Quality by design cell with coverage of the cell within its outer group.

    ``n_total`` counts all rows of the outer group, whatever their truth or label, so cells that lose
    rows do not add up to it.
    """
    keys = [*by, *cell]
    cells = macro_metrics(df, truth, pred, keys).withColumnRenamed("n", "n_covered")
    totals = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_total"))
    return (cells.join(totals, list(by)) if by else
            cells.withColumn("n_total", totals.scalar())).withColumn(
        "coverage", F.try_divide(F.col("n_covered"), F.col("n_total")))


def covered_metrics(df: DataFrame, by: Sequence[str], truth: str = "ground_truth",
                    pred: str = "resolved_annotation", tie: str = "is_problematic") -> DataFrame:
    """Quality over rows with a valid label and no tie, with their share of all rows by group."""
    covered = F.col(pred).isNotNull() & (F.col(pred) != INVALID) & ~F.col(tie)
    usable = df.filter(F.col(truth).isNotNull() & (F.col(truth) != INVALID))
    counts = usable.groupBy(*by, F.col(truth).alias("gt"), F.col(pred).alias("pred"), covered.alias("covered")).agg(
        F.count(F.lit(1)).alias("n"))
    carried = counts.withColumns({
        "n_total": F.col("n"), "n_covered": F.when(F.col("covered"), F.col("n")).otherwise(0)})
    carry = ["n_total", "n_covered"]
    scores = macro(per_class(_weighed(carried, F.col("covered")), by, carry), by, carry).drop("n")
    return scores.withColumn("coverage", F.try_divide(F.col("n_covered"), F.col("n_total")))


def ensemble_gain(df: DataFrame, columns: Sequence[str], truth: str = "ground_truth",
                  pred: str = "resolved_annotation") -> DataFrame:
    """Ensemble accuracy against the best single annotator, as one row."""
    best = model_metrics(df, columns, truth).agg(
        F.max_by("model", F.struct("accuracy", "model")).alias("best_model"),
        F.max("accuracy").alias("best_accuracy"))
    valid = df.filter((F.col(pred) != INVALID) & (F.col(truth) != INVALID))
    return best.withColumn("ensemble_accuracy", accuracy(valid, truth, pred).select("accuracy").scalar()) \
        .withColumn("delta", F.col("ensemble_accuracy") - F.col("best_accuracy"))
