"""Cases that once went wrong: caps on folds, doubled cache rows, crowded buckets, lost rows."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from accordant.operators import annotate as N, design as D, quality as Q, ranking as K, selection as S, training as TR
from accordant.sources import folds as FO, workspace


def write_folds(spark, root, numbers):
    rows = [(i, i, "x") for i in numbers]
    df = spark.createDataFrame(rows, "n int, v int, text string").coalesce(1)
    df.write.partitionBy("n").parquet(f"{root}/raw")
    jvm = spark.sparkContext._jvm
    fs = jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    util, conf = jvm.org.apache.hadoop.fs.FileUtil, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    for i in numbers:
        for kind in ("train_fold_", "test_fold_"):
            util.copy(fs, path(f"{root}/raw/n={i}"), fs, path(f"{root}/{kind}{i}"), False, conf)


def test_folds_end_at_the_first_gap(spark, tmp_path):
    root = tmp_path.as_uri()
    write_folds(spark, root, [0, 1, 2, 4])
    assert {r.fold for r in FO.read_folds(spark, root).collect()} == {0, 1, 2}


def test_fold_numbers_have_no_limit(spark, tmp_path):
    for i in range(1203):
        (tmp_path / f"train_fold_{i}").mkdir()
    assert FO.fold_numbers(spark, tmp_path.as_uri(), "train_fold_") == set(range(1203))


def test_cache_answers_each_key_once(spark, tmp_path):
    cache = f"{tmp_path.as_uri()}/cache"
    texts = spark.createDataFrame([("a",), ("b",), ("bad",), ("a",)], "text string").withColumns({"text_id": F.md5("text"), "prompt": F.col("text")})
    reqs = N.requests(texts, ["m"], 1)

    def model(frame):
        if (frame["prompt"] == "bad").any():
            raise RuntimeError("no answer")
        return pd.DataFrame({"content": ["CLASSIFICATION: " + p for p in frame["prompt"]]})

    first = N.call_with_cache(reqs, model, cache)
    assert first.count() == 4 and first.filter("error is not null").count() == 1
    spark.read.parquet(cache).write.mode("append").parquet(f"{cache}-copy")
    spark.read.parquet(f"{cache}-copy").write.mode("append").parquet(cache)
    again = N.call_with_cache(reqs, model, cache)
    assert again.count() == 4 and N.read_cache(spark, cache).count() == 2
    assert "no answer" in N.failed_calls(spark, cache).first()["error"]
    stats = N.cache_statistics(reqs, cache).first()
    assert (stats["requests"], stats["keys"], stats["hits"], stats["misses"], stats["stored"]) == (4, 3, 3, 1, 2)


@pytest.mark.parametrize("spread", [0, 6])
def test_a_draw_orders_few_rows(spark, spread):
    n = 1_000_000
    df = spark.range(n).select("id", (F.pow(F.lit(10.0), -(F.col("id") % (spread + 1)).cast("double")) / n).alias("w"))
    keyed = df.withColumn("k", S.draw_key(F.col("w"), "id", 1))
    lo, hi, before = K.around_rank(keyed, "k", 250_000)
    inside = keyed.filter(F.col("k").between(lo, hi)).count()
    assert inside <= 50_000 and before < 250_000 <= before + inside
    assert keyed.filter(F.col("k") < lo).count() == before
    drawn = S.weighted_sample(df, "w", "id", spark.createDataFrame([(250_000,)], "k long"), 1)
    assert drawn.count() == 250_000 and drawn.select("id").distinct().count() == 250_000


def test_first_by_with_ties(spark):
    df = spark.range(1000).select("id", (F.col("id") % 3).cast("double").alias("v"))
    got = sorted(r.id for r in K.first_by(df, "v", 400, "id").collect())
    assert got == sorted([i for i in range(1000) if i % 3 == 0] + [i for i in range(1000) if i % 3 == 1][:66])
    assert K.first_by(df, "v", 0, "id").count() == 0 and K.first_by(df, "v", 5000, "id").count() == 1000


def test_quantiles_of_small_and_large_groups(spark):
    df = spark.range(30_000).select((F.col("id") % 7).alias("g"), F.pow(F.lit(1.7), (F.col("id") % 101).cast("double")).alias("v"))
    df = df.unionByName(spark.createDataFrame([(9, 1.0), (9, 5.0), (9, 2.0)], "g long, v double"))
    pdf = df.toPandas()
    got = {(r.g, r.fraction): r.quantile for r in K.exact_quantiles(df, "v", [0.1, 0.5, 0.75], ["g"], accuracy=200).collect()}
    for g, part in pdf.groupby("g"):
        for f in (0.1, 0.5, 0.75):
            assert got[(g, f)] == pytest.approx(part["v"].quantile(f), rel=1e-12)


def test_durbin_watson_by_text(spark):
    rows = [(f"id{i:05d}", float((i * 37) % 11)) for i in range(500)]
    e = [v for _, v in rows]
    want = sum((a - b) ** 2 for a, b in zip(e[1:], e)) / sum(v * v for v in e)
    df = spark.createDataFrame(rows, "o string, e double").repartition(7)
    assert D.durbin_watson(df, "e", "o", range_rows=60).first()[0] == pytest.approx(want)


def test_a_lost_row_breaks_the_partition(spark):
    rows = [("d", "a", 1, 1), ("d", "a", 0, 1), ("d", "b", 1, 1)]
    shape = "dataset string, cell string, ground_truth int, resolved_annotation int"
    whole = Q.cell_metrics(spark.createDataFrame(rows, shape), ["dataset"], ["cell"])
    lost = Q.cell_metrics(spark.createDataFrame([*rows, ("d", "b", None, 1)], shape), ["dataset"], ["cell"])
    assert [r.is_partition for r in D.partition_check(whole, ["dataset"]).collect()] == [True]
    assert [r.is_partition for r in D.partition_check(lost, ["dataset"]).collect()] == [False]


def test_cross_validation_scores_and_comparison(spark):
    rows = []
    for fold in range(2):
        for i in range(40):
            label = i % 2
            split = "val" if i % 4 // 2 == fold else "train"
            rows.append((fold, split, f"{'good fine' if label else 'bad poor'} text number{i}", label))
    df = spark.createDataFrame(rows, "fold int, split string, text string, label int")
    make = lambda: TR.default_estimator(dims=256, iterations=20)
    scores = TR.cross_validate(df, [0, 1], make)
    assert sorted((r.fold, r.n, r.f1_macro) for r in scores.collect()) == [(0, 20, 1.0), (1, 20, 1.0)]
    assert TR.cv_summary(scores).count() >= 1
    assert TR.compare_label_sources(scores, scores, "d").count() == 1


def test_no_folder_is_an_error(spark):
    named = dict(workspace._NAMED)
    workspace.use_folder(None)

    class Bare:
        class conf:
            get = staticmethod(lambda key, default=None: default)

    try:
        assert not workspace.is_named(Bare)
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            workspace.shared_root(Bare)
    finally:
        workspace._NAMED.update(named)
