"""Resumable annotation of a growing table, and running consensus counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from accordant.operators.align import remaining_texts
from accordant.operators.dedup import keep_first
from accordant.sources.keyed import KeyedTable


def done_keys(spark: SparkSession, sink: str, key: str = "text_id", **layout) -> KeyedTable:
    """The keys that are annotated in ``sink``, with the batch that did it; merged once there are many parts."""
    return KeyedTable(spark, f"{sink}-keys", key, f"`{key}` string, batch_id bigint", **layout)


def annotate_stream(texts: DataFrame, annotate: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str,
                    key: str = "text_id", order: str = "text_id", **layout) -> DataStreamWriter:
    """A writer that annotates texts not yet in the sink, batch by batch.

    Copies inside a batch are reduced to the first, texts stored by earlier batches are left out by an anti join with
    the table of done keys, of which only the prefixes that the batch holds are read.  Each batch writes its own
    ``batch_id`` partition with overwrite, so a batch repeated after a failure replaces its rows instead of adding to
    them: its own keys, if they were committed already, do not count as done.
    """

    def one_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        table = done_keys(spark, sink, key, **layout)
        seen = table.version()
        fresh = keep_first(batch, key, order)
        if seen.parts:
            done = table.rows(seen, table.wanted_prefixes(batch)).filter(F.col("batch_id") != batch_id).select(key)
            fresh = remaining_texts(fresh, done, key)
        annotate(fresh).write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")
        keys = spark.read.parquet(f"{sink}/batch_id={batch_id}").select(F.col(key).cast("string").alias(key)).distinct()
        keys = keys.withColumn("batch_id", F.lit(batch_id).cast("long"))
        if seen.facts.get("batch_id", -1) < batch_id:
            table.append(table.write(keys), seen, batch_id=batch_id)
            return
        # A repeated batch, or a lost checkpoint: what this batch holds now takes the place of what it held.
        others = table.rows(seen).filter(F.col("batch_id") != batch_id).select(key, "batch_id")
        table.replace(others.unionByName(keys), seen)

    return texts.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint)


def run_available(writer: DataStreamWriter, timeout: float | None = None) -> StreamingQuery:
    """Process what is there and stop; a later call continues from the checkpoint."""
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination(timeout)
    return query


def level_counts(consensus: DataFrame) -> DataFrame:
    """Running count of texts per agreement level; the state is three counters."""
    return consensus.groupBy("consensus_level").agg(F.count(F.lit(1)).alias("n"))


def write_level_counts(consensus: DataFrame, table: str, checkpoint: str) -> DataStreamWriter:
    """The running counts as a Parquet table, replaced as a whole at each trigger."""
    def replace(batch: DataFrame, _: int) -> None:
        batch.coalesce(1).write.mode("overwrite").parquet(table)

    return (level_counts(consensus).writeStream.outputMode("complete").foreachBatch(replace)
            .option("checkpointLocation", checkpoint))
