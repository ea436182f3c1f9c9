"""Operators at sizes that a written-out plan or a single window would not bear."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from accordant.operators import agreement, calibration, consensus, design, intervals
from accordant.sources.workspace import fresh_path
from accordant.streaming import incremental, late_votes


def votes(spark, n_rows, n_seats, seed=1):
    rng = random.Random(seed)
    rows = []
    for _ in range(n_rows):
        truth = rng.randrange(4)
        rows.append(tuple(None if rng.random() < 0.05 else -1 if rng.random() < 0.03 else truth if rng.random() < 0.7 else rng.randrange(4) for _ in range(n_seats)))
    columns = [f"m{i}_consensus" for i in range(n_seats)]
    return rows, columns, spark.createDataFrame(rows, ", ".join(f"{c} int" for c in columns))


def test_products_count_like_the_written_out_pairs(spark):
    rows, columns, df = votes(spark, 300, 6)
    assert columns and len(columns) < agreement.WRITTEN_OUT
    by_pair = {(r.i, r.j): (r.annotator_1, r.annotator_2, r.agreeing, r.n) for r in agreement._pair_counts(df, columns).collect()}
    assert {(r.i, r.j): (r.annotator_1, r.annotator_2, r.agreeing, r.n) for r in agreement._all_pairs(df.repartition(5), columns).collect()} == by_pair
    assert agreement._all_pairs(df.limit(0), columns).count() == 15


def test_three_hundred_annotators(spark):
    rows, columns, df = votes(spark, 60, 300)
    table = np.array([[np.nan if v is None else v for v in r] for r in rows])
    got = {(r.annotator_1, r.annotator_2): r.agreement for r in agreement.pairwise_agreement(df, columns).collect()}
    assert len(got) == 300 * 300
    kappa = {(r.annotator_1, r.annotator_2): r.cohens_kappa for r in agreement.cohen_kappa(df, columns).collect()}
    assert len(kappa) == 300 * 299 // 2
    for i, j in itertools.islice(itertools.combinations(range(300), 2), 0, None, 997):
        po = np.mean(table[:, i] == table[:, j])
        assert got[f"m{i}", f"m{j}"] == got[f"m{j}", f"m{i}"] == pytest.approx(po)
        labels = [x for x in (-1, 0, 1, 2, 3)]
        pe = sum(np.mean(table[:, i] == x) * np.mean(table[:, j] == x) for x in labels) + np.mean(np.isnan(table[:, i])) * 0
        assert kappa[f"m{i}", f"m{j}"] == pytest.approx((po - pe) / (1 - pe))


def want_bh(p):
    p = np.asarray(p, dtype=float)
    order = np.argsort(-p, kind="stable")
    ranks = len(p) - np.arange(len(p))
    running = np.minimum.accumulate(p[order] * len(p) / ranks)
    out = np.empty(len(p))
    out[order] = np.minimum(running, 1)
    return out


@pytest.mark.parametrize("part_rows", [7, 50, 10_000])
def test_adjustment_does_not_depend_on_the_ranges(spark, part_rows):
    rng = random.Random(4)
    rows = [(i, rng.choice(["a", "b", None]), rng.choice([None, 0.0, 1.0, round(rng.random() ** 4, 3), rng.random() * 1e-6])) for i in range(600)]
    df = spark.createDataFrame(rows, "id int, g string, p double")
    got = {r.id: r for r in intervals.adjust(df, "p", ["g"], part_rows=part_rows).collect()}
    assert set(got) == {i for i, _, p in rows if p is not None}
    for g in ("a", "b", None):
        own = [(i, p) for i, h, p in rows if h == g and p is not None]
        for (i, p), q in zip(own, want_bh([p for _, p in own])):
            assert got[i].p_bh == pytest.approx(q) and got[i].p_bonferroni == pytest.approx(min(1, p * len(own)))
            assert got[i].significant_bh == (q < 0.05)
    assert intervals.adjust(df.filter("p IS NULL"), "p", ["g"]).count() == 0


def test_one_family_of_a_million_tests(spark):
    n = 1_000_000
    df = spark.range(n).select("id", F.pow((F.xxhash64("id") % 1_000_003 + 1_000_003) / F.lit(2_000_006.0), 3).alias("p"))
    out = intervals.adjust(df, "p", part_rows=50_000)
    got = out.select("id", "p", "p_bh").toPandas().sort_values("id")
    assert len(got) == n and np.allclose(got["p_bh"], want_bh(got["p"]))


def test_confidence_profile(spark):
    rows = [("a", 0.1, 1), ("a", 0.5, 0), ("a", 0.9, 1), ("a", None, 1), (None, 0.4, 0), (None, 0.6, 1), ("b", None, 0)]
    df = spark.createDataFrame(rows, "g string, mean_confidence double, correct int")
    got = {r.g: r for r in calibration.confidence_profile(df, ["g"]).collect()}
    assert (got["a"].n, got["a"].median, got["a"].q1, got["a"].q3, got["a"].hit_rate) == (4, 0.5, pytest.approx(0.3), pytest.approx(0.7), 0.75)
    assert (got[None].n, got[None].median, got[None].hit_rate) == (2, 0.5, 0.5) and got["b"].median is None and got["b"].n == 1


def test_pairs_of_five_thousand_levels(spark):
    n = 5_000
    df = spark.range(4 * n).select((F.col("id") % n).alias("level"), (F.xxhash64("id") % 1000).cast("double").alias("y"))
    pairs = design.level_differences(df, "y", "level", inference=False)
    got = pairs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("level_2") - F.col("level_1")).alias("d"), F.count_if(F.col("level_1") >= F.col("level_2")).alias("bad")).first()
    assert (got["n"], got["d"], got["bad"]) == (n * (n - 1) // 2, sum(k * (n - k) for k in range(n)), 0)
    few = df.filter("level < 40")
    rows = lambda tile: sorted(map(tuple, design.level_differences(few, "y", "level", tile=tile).collect()))
    assert rows(7) == rows(1000) and len(rows(7)) == 780


def test_late_votes_end_where_the_batch_ends(spark):
    rng = random.Random(2)
    votes = [(f"t{i}", rep, rng.randrange(3)) for i in range(40) for rep in range(1, 6)]
    rng.shuffle(votes)
    source, path, state = (fresh_path(spark, n) for n in ("votes", "tallies", "progress"))
    shape = "text_id string, rep int, label int"

    def run(checkpoint):
        live = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(source)
        incremental.run_available(late_votes.consensus_stream(live, path, checkpoint, merge_after=3))

    for k in range(0, len(votes), 40):
        spark.createDataFrame(votes[k : k + 40], shape).coalesce(1).write.mode("append").parquet(source)
        run(state)
        so_far = spark.createDataFrame(votes[: k + 40], shape).withColumn("elapsed_sec", F.lit(0.0))
        want = consensus.repetition_consensus(so_far, ["text_id"]).select("text_id", "label", "score", "repetitions")
        got = late_votes.current_consensus(spark, path)
        assert sorted(map(tuple, got.drop("level").collect())) == sorted(map(tuple, want.collect()))
        levels = {r["level"]: r["n"] for r in got.groupBy("level").agg(F.count(F.lit(1)).alias("n")).collect()}
        assert {r["consensus_level"]: r["n"] for r in late_votes.current_levels(spark, path).collect()} == levels
    before = sorted(map(tuple, late_votes.current_consensus(spark, path).collect()))
    run(fresh_path(spark, "lost"))  # a lost checkpoint replays batches whose numbers are committed
    assert sorted(map(tuple, late_votes.current_consensus(spark, path).collect())) == before
    assert len(late_votes.tallies(spark, path).version().parts) < 3
