"""Committed versions, the keyed table and what rests on them."""

import hashlib
from pathlib import Path
from urllib.parse import urlparse

import pandas as pd
import pytest
from pyspark.sql import functions as F

from accordant.operators import annotate as N
from accordant.plans import jobs
from accordant.sources import artefacts
from accordant.sources.keyed import KeyedTable
from accordant.sources.versions import Version, Versions, built, digest
from accordant.sources.workspace import fresh_path
from accordant.streaming import incremental

SHAPE = "k string, v long"


def rows(spark, pairs):
    return spark.createDataFrame(pairs, SHAPE)


def pairs_of(df):
    return sorted(map(tuple, df.collect()))


def local(path):
    return Path(urlparse(path).path)


def test_commits_are_numbered_and_exclusive(spark):
    v = Versions(spark, fresh_path(spark, "t"))
    assert v.latest() == Version() and v.numbers() == []
    first = v.commit(Version(), ["part=a"], colour="red")
    assert first.number == 1 and v.latest() == first and v.read(1).facts == {"colour": "red"}
    assert v.commit(Version(), ["part=b"]) is None  # somebody was first
    second = v.commit(first, ["part=a", "part=b"])
    assert v.latest() == second and v.numbers() == [1, 2]
    assert not [p for p in local(v.path).glob("_commits/.*") if p.suffix != ".crc"]


def test_digest_knows_rows_not_order(spark):
    df = spark.createDataFrame([(1, "a", {"x": 1, "y": 2}), (2, None, None)], "i int, s string, m map<string,int>")
    same = spark.createDataFrame([(2, None, None), (1, "a", {"y": 2, "x": 1})], "i int, s string, m map<string,int>")
    assert digest(df) == digest(same.select("m", "s", "i").repartition(3))
    assert len({digest(d) for d in (df, df.union(df), df.limit(0), df.limit(1), df.withColumn("s", F.lit("a")), df.drop("m"))}) == 6


def test_built_again_only_if_something_changed(spark):
    path, calls = fresh_path(spark, "b"), []

    def build():
        calls.append(1)
        return spark.range(len(calls))

    assert built(spark, path, build, made_from={"p": 1}).count() == 1
    assert built(spark, path, build, made_from={"p": 1}).count() == 1 and len(calls) == 1
    assert built(spark, path, build, made_from={"p": 2}).count() == 2
    old = built(spark, path, build, made_from={"p": 2})
    assert built(spark, path, build, made_from={"p": 2}, force=True).count() == 3
    assert old.count() == 2  # who reads a version keeps it
    assert Versions(spark, path).vacuum() == 2


def test_half_written_tables_are_not_read(spark):
    path = fresh_path(spark, "h")
    half = Versions(spark, path)
    spark.range(5).write.parquet(f"{half.folder(half.new_part())}/rows")  # a job that ended before its commit
    assert artefacts.load_or_build(spark, path, lambda: spark.range(3)).count() == 3

    def fails(folder):
        raise RuntimeError("no report")

    with pytest.raises(RuntimeError):
        built(spark, path, lambda: spark.range(9), made_from="new", with_it=fails)
    assert artefacts.load_or_build(spark, path, lambda: spark.range(4)).count() == 3


def test_two_jobs_build_the_same_table(spark):
    path = fresh_path(spark, "r")

    def build_while_another_commits():
        if not Versions(spark, path).numbers():
            built(spark, path, lambda: spark.range(7), made_from="same")
        return spark.range(8)

    assert built(spark, path, build_while_another_commits, made_from="same").count() == 7


def test_selection_job_follows_rows_and_options(spark):
    def table(n):
        data = [(f"t{i}", " ".join(f"{'ab'[i % 2]}{(i * j) % 11}" for j in range(1, 9)), i % 2) for i in range(n)]
        return spark.createDataFrame(data, "text_id string, text string, resolved_annotation int")

    path = fresh_path(spark, "selection")
    one = jobs.selection_job(table(24), path)
    assert one.count() == 24 and {"selection", "removal_reason"} <= set(one.columns)
    assert sorted(jobs.selection_job(table(24).repartition(3), path).inputFiles()) == sorted(one.inputFiles())
    # New texts do not vanish, other options are not answered with the old rows.
    assert jobs.selection_job(table(30), path).count() == 30
    assert artefacts.selection_report(spark, path).first()["total_instances"] == 30
    other = jobs.selection_job(table(30), path, beta=0.5)
    assert other.filter("removal_reason = 'redundant'").count() == 15 and artefacts.selection_report(spark, path).first()["beta"] == 0.5


def test_tracked_perspectives(spark):
    df = spark.createDataFrame([("t", 1, 1.0), ("u", 0, 1.0)], "text string, a_consensus int, a_consensus_score double")
    path = fresh_path(spark, "persp")
    for part, n in ((df.limit(1), 1), (df, 2), (df.repartition(2), 2)):
        assert jobs.perspectives_job(spark, part, path, track=True).count() == n
    assert Versions(spark, path).latest().number == 2


def test_keyed_table_grows_and_merges(spark):
    t = KeyedTable(spark, fresh_path(spark, "k"), "k", SHAPE, merge_after=4)
    want = {}
    for i in range(10):
        seen = t.version()
        batch = [(f"key{i}-{j}", i * 10 + j) for j in range(6)]
        want.update(batch)
        version = t.append(t.write(rows(spark, batch)), seen, note=i)
        assert len(version.parts) < 4 and version.facts["unique"] and version.facts["note"] == i
    assert pairs_of(t.first_rows()) == sorted(want.items())
    files = sum(1 for p in t.version().parts for _ in local(t.versions.folder(p)).rglob("*.parquet"))
    assert files <= 3 * 16
    assert t.versions.vacuum() > 5 and pairs_of(t.first_rows()) == sorted(want.items())
    assert t.clear().parts == () and t.first_rows().count() == 0
    assert pairs_of(t.get(["key1-1"])) == []


def test_keyed_table_answers_once_after_a_race(spark):
    t = KeyedTable(spark, fresh_path(spark, "k"), "k", SHAPE)
    start = t.version()
    mine, theirs = t.write(rows(spark, [("a", 1), ("b", 2)])), t.write(rows(spark, [("b", 3), ("c", 4)]))
    t.append(mine, start)
    late = t.append(theirs, start)
    assert not late.facts["unique"]
    assert pairs_of(t.first_rows()) == [("a", 1), ("b", 2), ("c", 4)] and t.rows().count() == 4
    assert pairs_of(t.get(["b", "c", "d"])) == [("b", 2), ("c", 4)]
    merged = t.merge()
    assert merged.facts["unique"] and len(merged.parts) == 1 and pairs_of(t.rows().select("k", "v")) == [("a", 1), ("b", 2), ("c", 4)]
    assert t.merge() == merged


def test_rows_that_are_no_answers(spark):
    t = KeyedTable(spark, fresh_path(spark, "k"), "k", SHAPE, live="v IS NOT NULL")
    t.append(t.write(rows(spark, [("a", None), ("b", 2)])), t.version())
    assert pairs_of(t.first_rows()) == [("b", 2)]
    t.append(t.write(rows(spark, [("a", 5)])), t.version())
    assert pairs_of(t.first_rows()) == [("a", 5), ("b", 2)] and len(t.version().parts) == 2
    t.merge()
    assert pairs_of(t.rows().select("k", "v")) == [("a", 5), ("b", 2)]


def test_lookup_reads_the_wanted_prefixes_only(spark):
    t = KeyedTable(spark, fresh_path(spark, "k"), "k", SHAPE, digits=2)
    keys = [(f"k{i}", i) for i in range(400)]
    t.replace(rows(spark, keys), t.version())
    wanted = ["k7", "k300"]
    prefixes = sorted({hashlib.md5(k.encode()).hexdigest()[:2] for k in wanted})
    assert sorted(t.wanted_prefixes(rows(spark, [(k, 0) for k in wanted]))) == prefixes
    few = t.rows(prefixes=prefixes)
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "prefix" in plan.split("PartitionFilters")[1].split("]")[0]
    read = {f.split("prefix=")[1].split("/")[0] for f in few.select(F.input_file_name().alias("f")).distinct().toPandas()["f"]}
    assert read == set(prefixes)
    assert pairs_of(t.get(wanted)) == [("k300", 300), ("k7", 7)]
    plan = t.get(wanted)._jdf.queryExecution().executedPlan().toString()
    assert "In(k" in plan or "Or(EqualTo(k" in plan


def test_calls_are_made_and_written_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def model(frame):
        made.add(len(frame))
        if (frame["prompt"] == "bad").any():
            raise RuntimeError("no answer")
        return pd.DataFrame({"content": ["CLASSIFICATION: " + p for p in frame["prompt"]]})

    def reqs(texts, reps=1):
        df = spark.createDataFrame([(t,) for t in texts], "text string").withColumns({"text_id": F.md5("text"), "prompt": F.col("text")})
        return N.requests(df, ["m"], reps)

    cache = f"{tmp_path.as_uri()}/cache"
    first = N.call_with_cache(reqs(["a", "b", "a"]), model, cache)
    assert made.value == 2 and first.count() == 3 and first.count() == 3 and made.value == 2
    assert N.call_with_cache(reqs(["a", "c"]), model, cache).filter("content is not null").count() == 2 and made.value == 3
    for _ in range(2):  # a failure is called again, and logged each time
        N.call_with_cache(reqs(["bad"]), model, cache)
    assert N.failed_calls(spark, cache).count() == 2 and N.read_cache(spark, cache).count() == 3
    store = N.response_store(spark, cache)
    assert store.version().facts["unique"]
    got = N.call_with_cache(reqs(["a", "b", "c", "bad"]), model, cache).collect()
    assert sorted((r["text"], r["content"]) for r in got if r["error"] is None) == [(t, f"CLASSIFICATION: {t}") for t in "abc"]


def test_stream_over_many_batches_keeps_few_files(spark):
    source, sink, state = (fresh_path(spark, n) for n in ("in", "out", "state"))
    n = 50
    for i in range(n):
        spark.createDataFrame([(f"t{i}",), (f"t{max(0, i - 1)}",)], "text_id string").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("text_id string").option("maxFilesPerTrigger", 1).parquet(source)
    incremental.run_available(incremental.annotate_stream(stream, lambda b: b.select("text_id"), sink, state, merge_after=8))
    assert sorted(r["text_id"] for r in spark.read.parquet(sink).collect()) == sorted(f"t{i}" for i in range(n))
    table = incremental.done_keys(spark, sink, merge_after=8)
    version = table.version()
    assert len(version.parts) < 8 and table.rows(version).count() == n and version.facts["batch_id"] == n - 1
    assert sum(1 for p in version.parts for _ in local(table.versions.folder(p)).rglob("*.parquet")) <= 8 * 16


def test_a_replayed_batch_with_other_rows_takes_the_old_ones_place(spark):
    sink = fresh_path(spark, "out")

    def run(texts):
        source = fresh_path(spark, "in")
        spark.createDataFrame([(t,) for t in texts], "text_id string").coalesce(1).write.parquet(source)
        stream = spark.readStream.schema("text_id string").parquet(source)
        incremental.run_available(incremental.annotate_stream(stream, lambda b: b.select("text_id"), sink, fresh_path(spark, "state")))

    run(["a", "b"])
    run(["b", "c"])  # batch 0 again: a is not done any more
    assert sorted(r["text_id"] for r in spark.read.parquet(sink).collect()) == ["b", "c"]
    assert sorted(r["text_id"] for r in incremental.done_keys(spark, sink).rows().collect()) == ["b", "c"]
