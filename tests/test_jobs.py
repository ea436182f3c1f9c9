import pandas as pd
import pytest

from accordant.operators import annotate as N
from accordant.plans import jobs
from accordant.sources.workspace import fresh_path
from accordant.streaming import incremental
from workload.jobs import marker_annotator


def flaky():
    def annotate(frame):
        import pandas as pd

        if (frame["prompt"] == "boom").any():
            raise RuntimeError("no answer")
        return pd.DataFrame({"content": ["1"] * len(frame)})

    return annotate


def prompts_frame(spark, texts):
    return spark.createDataFrame([(t, t, t) for t in texts], "text_id string, text string, prompt string")


def test_failing_calls_become_invalid_labels(spark):
    reqs = N.requests(prompts_frame(spark, ["a", "boom", "c"]), ["m"], 2)
    out = N.parse(reqs.join(N.call(reqs, flaky(), parallelism=1), "cache_key"), [0, 1]).collect()
    got = {(r["text_id"], r["rep"]): (r["label"], r["error"]) for r in out}
    assert len(got) == 6 and got[("a", 0)] == (1, None)
    assert got[("boom", 1)] == (-1, "RuntimeError: no answer")


def test_cache_calls_each_key_once(spark):
    cache = fresh_path(spark, "cache")
    first = N.requests(prompts_frame(spark, ["a", "a", "b"]), ["m"], 1)
    assert N.call_with_cache(first, flaky(), cache).count() == 3
    assert N.read_cache(spark, cache).count() == 2
    more = N.requests(prompts_frame(spark, ["b", "c", "boom"]), ["m"], 1)
    out = {r["text_id"]: r["content"] for r in N.call_with_cache(more, flaky(), cache).collect()}
    assert out == {"b": "1", "c": "1", "boom": None}
    assert N.read_cache(spark, cache).count() == 3  # a failed call is not stored


def test_variants(spark):
    configs = {"m": {"default_params": {"t": 0}, "alternative_params": [{"t": 1}, {"t": 2}]}}
    assert N.expand_variants(["m", "n"], configs) == [("m", '{"t": 0}'), ("m_alt1", '{"t": 1}'), ("m_alt2", '{"t": 2}'), ("n", "{}")]
    assert N.annotator_table(spark, ["m"], configs).count() == 3


def test_annotation_job(spark):
    texts = spark.createDataFrame([("one",), (" one ",), ("two",)], "text string")
    truth = spark.createDataFrame([("f97c5d29941bfb1b2fdab0874906ab82", 3)], "text_id string, ground_truth int")
    out = jobs.annotation_job(texts, marker_annotator(), ["m1", "m2"], categories=[0, 1, 2, 3], meanings={"0": "x"},
                              reps=2, truth=truth, order="text")
    rows = {r["text"].strip(): r for r in out.collect()}
    assert set(rows) == {"one", "two"} and rows["one"]["ground_truth"] == 3 and rows["two"]["ground_truth"] is None
    r = rows["two"]
    assert {r["m1_rep1"], r["m1_rep2"]} >= {r["m1_consensus"]} and 0 < r["m1_rep1_conf"] <= 1
    assert r["m1_consensus_score"] in (0.5, 1.0) and r["text_len"] == 3


def test_consensus_job(spark):
    pdf = pd.DataFrame({"text_id": ["a", "a", "b", "c"], "text": ["A", "A", "B", "C"], "n": [1, 2, 3, 4], "x_consensus": [0, 1, 1, 1],
                        "y_consensus": [0, 1, 0, 1], "ground_truth": [0, 0, 1, 1]})
    rep = jobs.consensus_job(spark.createDataFrame(pdf), dataset="d", order="n", output=fresh_path(spark, "job"))
    assert rep.categories == [0, 1] and rep.models == ["x", "y"] and rep.table.count() == 3
    s = rep.summary.first()
    assert s["dataset"]["total_texts"] == 3 and s["config"]["total_models"] == 2
    assert s["results"]["high_consensus"] == 2 and len(s["validation"]["classification_report"]) == 5
    assert {r["text_id"] for r in rep.problematic.collect()} == {"b"}


def test_stream_skips_done_and_survives_a_repeated_batch(spark):
    source, sink, state = (fresh_path(spark, n) for n in ("in", "out", "state"))
    seen = []

    def annotate(batch):
        seen.append(sorted(r["text_id"] for r in batch.select("text_id").collect()))
        return batch.select("text_id")

    def run(checkpoint):
        stream = spark.readStream.schema("text_id string").parquet(source)
        incremental.run_available(incremental.annotate_stream(stream, annotate, sink, checkpoint))

    spark.createDataFrame([("a",), ("a",), ("b",)], "text_id string").coalesce(1).write.mode("append").parquet(source)
    run(state)
    spark.createDataFrame([("b",), ("c",)], "text_id string").coalesce(1).write.mode("append").parquet(source)
    run(state)
    assert seen == [["a", "b"], ["c"]]
    assert sorted(r["text_id"] for r in spark.read.parquet(sink).collect()) == ["a", "b", "c"]
    # A lost checkpoint replays batch 0 over everything: it replaces its own rows only.
    run(fresh_path(spark, "state"))
    assert sorted(r["text_id"] for r in spark.read.parquet(sink).collect()) == ["a", "b", "c"]


def test_perspectives_job_reuses_the_table(spark):
    df = spark.createDataFrame([("t", 1, 1.0)], "text string, a_consensus int, a_consensus_score double")
    path = fresh_path(spark, "persp")
    assert jobs.perspectives_job(spark, df, path).count() == 1
    assert jobs.perspectives_job(spark, df.filter("false"), path).count() == 1
    assert jobs.perspectives_job(spark, df.filter("false"), path, force=True).count() == 0


@pytest.mark.parametrize("partitions", [1, 8])
def test_results_do_not_depend_on_partitions(spark, partitions):
    from workload.catalogue import REGISTRY

    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        for name in ("fold_assignment", "balanced_sample", "shuffled_sample"):
            got = sorted(map(tuple, REGISTRY[name].query(spark, "/root/testdata/sf0.001").collect()))
            key = f"{name}"
            assert _SEEN.setdefault(key, got) == got
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


_SEEN: dict = {}
