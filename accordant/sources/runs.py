"""Choosing runs of an experiment by their ``run_id`` partition."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from accordant.operators.joins import measured

# Fixed value: run names that are replications start with a timestamp of this form.
RUN_PATTERN = r"^\d{4}-\d{2}-\d{2}_\d{2}-\d{2}-\d{2}"


def latest_run(df: DataFrame, run: str = "run_id") -> DataFrame:
    """Rows of the greatest run id; on a partitioned table the scan is pruned to it."""
    return df.filter(F.col(run) == df.agg(F.max(run)).scalar())


def last_runs(df: DataFrame, n: int, by: str = "dataset", run: str = "run_id") -> DataFrame:
    """Rows of the last ``n`` timestamped runs of each dataset, with the replicate number.

    Only the distinct (dataset, run) pairs are ranked.
    """
    pairs = df.select(by, run).filter(F.col(run).rlike(RUN_PATTERN)).distinct()
    newest = Window.partitionBy(by).orderBy(F.desc(run))
    oldest = Window.partitionBy(by).orderBy(run)
    kept = (pairs.withColumn("__age", F.row_number().over(newest)).filter(F.col("__age") <= n)
            .withColumn("replica", F.row_number().over(oldest)).drop("__age"))
    return df.join(measured(kept), [by, run])


def run_from_path(df: DataFrame, out: str = "run_id") -> DataFrame:
    """Take the run id from the file path of tables stored one folder per run."""
    return df.withColumn(out, F.regexp_extract(
        F.col("_metadata.file_path"), r"/(\d{4}-\d{2}-\d{2}_\d{2}-\d{2}-\d{2}[^/]*)/", 1))
