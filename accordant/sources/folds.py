"""Cross-validation folds and fold scores from files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F


def fold_numbers(spark: SparkSession, path: str, prefix: str) -> set[int]:
    """The numbers of all folders ``<prefix><number>`` in a folder, from one listing."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in system.listStatus(root)] if system.exists(root) else []
    return {int(n[len(prefix):]) for n in names if n.startswith(prefix) and n[len(prefix):].isdigit()}


def read_folds(spark: SparkSession, path: str, train: str = "train_fold_", evaluation: str = "test_fold_") -> DataFrame:
    """All folds as one table with ``fold`` and ``split``.

    Folds are numbered from 0 and end at the first missing number, however many there are.  The
    folder is listed once per kind and read in two scans; the fold comes from the path.
    """
    present = fold_numbers(spark, path, train) & fold_numbers(spark, path, evaluation)
    found = next(i for i in range(len(present) + 1) if i not in present)
    if not found:
        raise ValueError(f"no folds under {path}")

    def part(prefix: str, split: str) -> DataFrame:
        files = [f"{path}/{prefix}{i}" for i in range(found)]
        return (spark.read.parquet(*files)
                .withColumn("fold", F.regexp_extract("_metadata.file_path", rf"/{prefix}(\d+)", 1).cast("int"))
                .withColumn("split", F.lit(split)))

    return part(train, "train").unionByName(part(evaluation, "val"), allowMissingColumns=True)


def scores_from_wide(df: DataFrame, prefix: str = "mac", key: str = "dataset",
                     out: str = "f1_macro") -> DataFrame:
    """Columns ``mac0``, ``mac1``, ... to one row per fold, without the empty cells."""
    cols = [c for c in df.columns if c.startswith(prefix) and c[len(prefix):].isdigit()]
    return (df.unpivot(key, cols, "column", out).filter(F.col(out).isNotNull())
            .select(key, F.substring(F.col("column"), len(prefix) + 1, 9).cast("int").alias("fold"), out))


def scores_from_json(df: DataFrame, column: str = "value", metric: str = "eval_f1_macro",
                     keep: Sequence[str] = (), out: str = "f1_macro") -> DataFrame:
    """Fold metrics stored as ``{"folds": {"0": {metric: value}}}`` to one row per fold."""
    shape = "struct<folds:map<string,map<string,double>>>"
    folds = F.from_json(F.col(column), shape)["folds"]
    return (df.select(*keep, F.explode(folds).alias("fold", "metrics"))
            .select(*keep, F.col("fold").cast("int").alias("fold"),
                    F.try_element_at("metrics", F.lit(metric)).alias(out)))
