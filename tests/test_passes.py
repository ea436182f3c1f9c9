"""What is moved, and how often, where requests or sparse rows are many."""

import pandas as pd
from pyspark.sql import functions as F

from accordant.operators import annotate as N
from accordant.sources.workspace import fresh_path, stored


def echo():
    def annotate(frame):
        return pd.DataFrame({"content": [f"{m}/{r}/{p}" for m, r, p in zip(frame["model"], frame["rep"], frame["prompt"])]})

    return annotate


def test_a_prompt_is_moved_once_for_all_its_calls(spark):
    texts = spark.createDataFrame([("a", "A?"), ("b", "B?"), ("b", "B?")], "text string, prompt string").withColumn("text_id", F.col("text"))
    reqs = N.requests(texts, ["m1", "m2"], 3).withColumn("text_md5", F.md5(F.coalesce("text", F.lit(""))))
    misses = stored(reqs.groupBy("cache_key").agg(*[F.any_value(c).alias(c) for c in ("annotator", "rep", "params", "text_md5")]), "misses")
    sent = N._with_prompts(misses, reqs, None)
    assert sorted(r.prompt for r in sent.filter("model = 'm2' and rep = 2").collect()) == ["A?", "B?"]
    moved = [line for line in sent._jdf.queryExecution().executedPlan().toString().splitlines() if "hashpartitioning" in line]
    assert moved and all("text_md5" in line for line in moved)


def test_texts_without_the_first_call_are_answered_too(spark):
    texts = spark.createDataFrame([("a", "A?"), ("b", "B?"), ("b", "B?")], "text string, prompt string").withColumn("text_id", F.col("text"))
    reqs = N.requests(texts, ["m1", "m2"], 2).filter("text <> 'b' or annotator = 'm2' and rep = 1")
    cache = fresh_path(spark, "responses")
    got = sorted((r.text_id, r.content) for r in N.call_with_cache(reqs, echo(), cache, 3).collect())
    assert got == [("a", "m1/0/A?"), ("a", "m1/1/A?"), ("a", "m2/0/A?"), ("a", "m2/1/A?"), ("b", "m2/1/B?"), ("b", "m2/1/B?")]
    assert N.read_cache(spark, cache).count() == 5
