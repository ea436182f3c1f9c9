"""Consensus over votes that arrive in any order.

Votes of a text may come batches apart.  Each batch is folded to tallies, one row per text and label, and appended to a
table of tallies; tallies of different batches add up, so a text's consensus is always that of all its votes so far.
When a text's level changes, the running counts give up the old level and take the new one.  Tallies, counts and the
number of the batch are committed together: a batch repeated after a failure changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter

from accordant.functions import votes as V
from accordant.sources.keyed import KeyedTable


def tallies(spark: SparkSession, path: str, digits: int = 1) -> KeyedTable:
    """The table of tallies below ``path``, by text; its rows add up per text and label."""
    return KeyedTable(spark, path, "text_id", "text_id string, label int, n bigint, first_rep int", digits=digits, merge_after=1 << 30)


def tally(votes: DataFrame) -> DataFrame:
    """One row per text and label of (text_id, rep, label) votes."""
    return votes.groupBy(F.col("text_id").cast("string").alias("text_id"), F.col("label").cast("int").alias("label")).agg(
        F.count(F.lit(1)).alias("n"), F.min("rep").cast("int").alias("first_rep"))


def added(rows: DataFrame) -> DataFrame:
    return rows.groupBy("text_id", "label").agg(F.sum("n").alias("n"), F.min("first_rep").alias("first_rep"))


def consensus(rows: DataFrame) -> DataFrame:
    """(text_id, label, score, repetitions, level): the commonest label, of equally common ones the one voted first."""
    per_text = added(rows).groupBy("text_id").agg(
        F.max_by("label", F.struct(F.col("n"), -F.col("first_rep"))).alias("label"),
        (F.max("n") / F.sum("n")).alias("score"), F.sum("n").alias("repetitions"))
    return per_text.withColumn("level", V.level(F.col("score")))


def _per_level(rows: DataFrame) -> dict[str, int]:
    return {r["level"]: r["n"] for r in consensus(rows).groupBy("level").agg(F.count(F.lit(1)).alias("n")).collect()}  # three rows


def consensus_stream(votes: DataFrame, path: str, checkpoint: str, *, merge_after: int = 16, digits: int = 1) -> DataStreamWriter:
    """A writer that keeps the consensus of a stream of (text_id, rep, label) votes below ``path``.

    Of the tallies only the prefixes that a batch holds are read.  Parts are added up into one once there are
    ``merge_after`` of them.  A vote that the source delivers twice counts twice.
    """

    def one_batch(batch: DataFrame, batch_id: int) -> None:
        table = tallies(batch.sparkSession, path, digits)
        seen = table.version()
        if seen.facts.get("batch_id", -1) >= batch_id:
            return
        part = table.write(tally(batch))
        new = table.part(part).drop("written_at")
        prefixes = table.wanted_prefixes(new)
        old = table.rows(seen, prefixes).select(*table.columns).join(new.select("text_id").distinct(), "text_id", "left_semi")
        counts = dict(seen.facts.get("counts", {}))
        for sign, levels in ((-1, _per_level(old)), (1, _per_level(old.unionByName(new)))):
            for level, n in levels.items():
                counts[level] = counts.get(level, 0) + sign * n
        done = table.append(part, seen, batch_id=batch_id, counts={k: n for k, n in counts.items() if n})
        if len(done.parts) >= merge_after:
            table.replace(added(table.rows(done).select(*table.columns)), done)

    return votes.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint)


def current_consensus(spark: SparkSession, path: str) -> DataFrame:
    """The consensus of every text over the votes that have arrived."""
    return consensus(tallies(spark, path).rows())


def current_levels(spark: SparkSession, path: str) -> DataFrame:
    """(consensus_level, n): texts per level, as of the last committed batch; no table is read."""
    counts = tallies(spark, path).version().facts.get("counts", {})
    return spark.createDataFrame(sorted(counts.items()), "consensus_level string, n bigint")
