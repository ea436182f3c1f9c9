"""Annotation as a distributed table function with a user-supplied annotator.

The annotator is a Python callable from a pandas frame of requests (``model``, ``rep``,
``prompt``, ``params``) to a frame with ``content`` and, optionally, ``thinking`` and
``logprobs`` (a list of token/logprob pairs per row).  Everything around it, fan-out, cache
lookup, parsing and voting, is DataFrame work.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from accordant.functions import responses, text as T
from accordant.operators.consensus import repetition_consensus
from accordant.sources.keyed import KeyedTable
from accordant.sources.workspace import stored

Annotator = Callable[[pd.DataFrame], pd.DataFrame]

RESPONSE = ("content string, thinking string, logprobs array<struct<token:string,logprob:double>>, "
            "elapsed_sec double, error string")


def expand_variants(models: Sequence[str], configs: Mapping[str, Mapping[str, Any]]) -> list[tuple[str, str]]:
    """(name, parameters as JSON) of every model and of its alternative parameter sets.

    Variants are named ``<model>_alt1``, ``<model>_alt2``, ... and carry their own parameters.
    """
    out = []
    for model in models:
        config = configs.get(model, {})
        out.append((model, json.dumps(config.get("default_params", {}), sort_keys=True)))
        out += [(f"{model}_alt{i}", json.dumps(alt, sort_keys=True))
                for i, alt in enumerate(config.get("alternative_params", ()), 1)]
    return out


def annotator_table(spark: SparkSession, models: Sequence[str],
                    configs: Mapping[str, Mapping[str, Any]]) -> DataFrame:
    return spark.createDataFrame(expand_variants(models, configs), "annotator string, params string")


def requests(texts: DataFrame, models: Sequence[tuple[str, str]] | Sequence[str], reps: int = 1,
             keep: Sequence[str] = ("text_id",), prompt: str = "prompt") -> DataFrame:
    """One row per text, annotator and repetition, with the cache key of the call.

    The annotators are a short literal list, so this is an explode, not a join.
    """
    pairs = [m if isinstance(m, tuple) else (m, "{}") for m in models]
    calls = F.array(*[
        F.struct(F.lit(name).alias("annotator"), F.lit(i).alias("annotator_idx"),
                 F.lit(params).alias("params"), F.lit(rep).alias("rep"))
        for i, (name, params) in enumerate(pairs) for rep in range(reps)])
    return (texts.select(*keep, "text", prompt, F.explode(calls).alias("c"))
            .select(*keep, "text", prompt, "c.*")
            .withColumn("cache_key", T.cache_key("annotator", "text", "rep")))


def call(reqs: DataFrame, annotator: Annotator, parallelism: int | None = None,
         prompt: str = "prompt") -> DataFrame:
    """Run the annotator over distinct requests; one output row per ``cache_key``.

    ``parallelism`` is the number of tasks and so the number of concurrent calls.  Requests
    are spread by their unique key, which a retried task sees again in the same split.  A
    failing batch is retried row by row; a failing row yields its error text.
    """
    sent = reqs.select("cache_key", F.col("annotator").alias("model"), "rep", "params", F.col(prompt).alias("prompt"))
    return _answered(sent.repartition(parallelism, "cache_key") if parallelism else sent.repartition("cache_key"), annotator)


def _answered(spread: DataFrame, annotator: Annotator) -> DataFrame:
    """The annotator's responses to requests where they lie."""

    def run(batches):
        import time

        import pandas as pd

        def one(frame):
            start = time.perf_counter()
            answer = annotator(frame.drop(columns=["cache_key"]).reset_index(drop=True))
            spent = (time.perf_counter() - start) / max(len(frame), 1)
            out = pd.DataFrame({"cache_key": frame["cache_key"].to_numpy()})
            for name in ("content", "thinking", "logprobs"):
                out[name] = list(answer[name]) if name in answer else None
            return out.assign(elapsed_sec=spent, error=None)

        for batch in batches:
            try:
                yield one(batch)
                continue
            except Exception:  # noqa: BLE001 - find the failing rows below
                pass
            for i in range(len(batch)):
                row = batch.iloc[i:i + 1]
                try:
                    yield one(row)
                except Exception as e:  # noqa: BLE001
                    yield pd.DataFrame({"cache_key": row["cache_key"].to_numpy(), "content": [None],
                                        "thinking": [None], "logprobs": [None], "elapsed_sec": [0.0],
                                        "error": [f"{type(e).__name__}: {e}"]})

    return spread.mapInPandas(run, f"cache_key string, {RESPONSE}")


def response_store(spark: SparkSession, path: str, **layout: Any) -> KeyedTable:
    """The stored responses below ``path``, by cache key."""
    return KeyedTable(spark, path, "cache_key", f"cache_key string, {RESPONSE}", live="error IS NULL", **layout)


def failure_log(spark: SparkSession, path: str) -> KeyedTable:
    """Every failed call, beside the store; a key may fail several times."""
    return KeyedTable(spark, f"{path}-errors", "cache_key", "cache_key string, error string, failed_at timestamp")


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """One response per key, the first one written."""
    return response_store(spark, path).first_rows()


def failed_calls(spark: SparkSession, path: str) -> DataFrame:
    """Every failed call beside the cache, with its error text and time."""
    return failure_log(spark, path).rows().select("cache_key", "error", F.col("failed_at").alias("written_at"))


def cache_statistics(reqs: DataFrame, cache: str) -> DataFrame:
    """One row: requests, their distinct keys, how many requests the cache answers (``hits``) or not
    (``misses``), and the keys it holds."""
    held = read_cache(reqs.sparkSession, cache).select("cache_key", F.lit(True).alias("held"))
    return (reqs.select("cache_key").join(held, "cache_key", "left")
            .agg(F.count(F.lit(1)).alias("requests"), F.count_distinct("cache_key").alias("keys"),
                 F.count("held").alias("hits"), F.count_if(F.col("held").isNull()).alias("misses"))
            .withColumn("stored", held.agg(F.count(F.lit(1))).scalar()))


def _with_prompts(misses: DataFrame, keyed: DataFrame, parallelism: int | None) -> DataFrame:
    """Requests with their prompts, spread by text: a prompt is moved once for all calls of its text.

    It comes from the row of one (annotator, repetition); requests of texts without such a row are left out.
    """
    one = misses.select(F.min(F.struct("annotator", "rep", "params"))).first()[0]
    first = F.lit(False) if one is None else (
        F.col("annotator").eqNullSafe(one["annotator"]) & F.col("rep").eqNullSafe(one["rep"]) & F.col("params").eqNullSafe(one["params"]))
    prompts = keyed.filter(first).groupBy("text_md5").agg(F.any_value("prompt").alias("prompt"))
    if parallelism:
        misses, prompts = misses.repartition(parallelism, "text_md5"), prompts.repartition(parallelism, "text_md5")
    return misses.join(prompts, "text_md5").select("cache_key", F.col("annotator").alias("model"), "rep", "params", "prompt")


def call_with_cache(reqs: DataFrame, annotator: Annotator, cache: str,
                    parallelism: int | None = None) -> DataFrame:
    """Every request with its response; only keys absent from the store are called.

    Copies of a text share one key and one call.  Of the store only the key prefixes that the requests hold are
    read, and only their keys.  Keys are moved without prompts, and a prompt once for all its calls.  New responses are written once, as the store's next part; failures are no answers, go
    to the log beside it too, and a request whose call failed now returns with its error.
    """
    spark = reqs.sparkSession
    store = response_store(spark, cache)
    seen = store.version()
    keyed = reqs.withColumn("text_md5", F.md5(F.coalesce("text", F.lit(""))))
    misses = keyed.groupBy("cache_key").agg(*[F.any_value(c).alias(c) for c in ("annotator", "rep", "params", "text_md5")])
    prefixes = None
    if seen.parts:
        prefixes = store.wanted_prefixes(reqs)
        misses = misses.join(store.rows(seen, prefixes).select("cache_key"), "cache_key", "left_anti")
    misses = stored(misses, "misses")
    part = store.write(_answered(_with_prompts(misses, keyed, parallelism), annotator))
    if store.part(part).count() < misses.count():  # texts of which the first call was not requested
        rest = misses.join(store.part(part).select("cache_key"), "cache_key", "left_anti")
        prompts = keyed.groupBy("cache_key").agg(F.any_value("prompt").alias("prompt"))
        part = store.write(store.part(part).drop("written_at").unionByName(call(rest.join(prompts, "cache_key"), annotator, parallelism)))
    failed = store.part(part).filter("error IS NOT NULL")
    if not failed.isEmpty():
        log = failure_log(spark, cache)
        log.append(log.write(failed.select("cache_key", "error", F.col("written_at").alias("failed_at"))), log.version())
    answers = store.first_rows(store.append(part, seen), prefixes)
    return reqs.join(answers.unionByName(failed.drop("written_at")), "cache_key", "left")


def parse(responses_df: DataFrame, categories: Sequence[int]) -> DataFrame:
    """Add ``label`` and ``confidence``; a failed or missing call has label -1."""
    label = responses.extract_label(F.col("content"), categories)
    return (responses_df.withColumn("label", label)
            .withColumn("confidence", responses.label_confidence(F.col("label"), F.col("logprobs"))))


def to_wide(parsed: DataFrame, models: Sequence[str], reps: int, key: str = "text_id") -> DataFrame:
    """Annotation table: labels and confidences per repetition, consensus, share and time.

    Conditional aggregates over the known annotators and repetitions; a text that occurs many
    times keeps a constant-size state.
    """
    per_rep = []
    for m in models:
        for r in range(reps):
            hit = (F.col("annotator") == m) & (F.col("rep") == r)
            per_rep += [F.max(F.when(hit, F.col("label"))).alias(f"{m}_rep{r + 1}"),
                        F.max(F.when(hit, F.col("confidence"))).alias(f"{m}_rep{r + 1}_conf")]
    wide = parsed.groupBy(key).agg(*per_rep)
    votes = repetition_consensus(parsed, (key, "annotator"))
    picks = []
    for m in models:
        mine = F.col("annotator") == m
        picks += [F.max(F.when(mine, F.col("label"))).alias(f"{m}_consensus"),
                  F.max(F.when(mine, F.col("score"))).alias(f"{m}_consensus_score"),
                  F.max(F.when(mine, F.col("elapsed_sec"))).alias(f"{m}_annotation_time_sec")]
    return wide.join(votes.groupBy(key).agg(*picks), key)
