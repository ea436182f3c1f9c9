"""Duplicates, joins, folds, sources: keys, leakage, skew, run choice."""

import pytest
from pyspark.sql import functions as F

from accordant.operators import align as J, dedup as D, labels as B, reshape as U
from accordant.sources import artefacts, datasets, folds as FO, runs
from accordant.sources.workspace import fresh_path, shared_root


def test_keep_first_and_reports(spark):
    df = spark.createDataFrame([(3, "a", "x"), (1, "a", "y"), (2, "b", None), (4, None, "z"), (5, None, "w")], "o int, k string, v string")
    assert {(r["o"], r["v"]) for r in D.keep_first(df, "k", "o").collect()} == {(1, "y"), (2, None), (4, "z")}
    assert [tuple(r) for r in D.duplicate_groups(df, "k").collect()] == [("a", 2)]
    assert D.duplicate_members(df, "k").count() == 2
    assert D.uniqueness(df, "k").first()["is_unique"] is False
    with pytest.raises(ValueError, match="values of 'k'"):
        D.require_unique(df, "k")
    D.require_unique(df, "o")


def test_align_needs_unique_keys(spark):
    truth = spark.createDataFrame([("a", "t", 1), ("a", "t", 1)], "text_id string, text string, gt int")
    ann = spark.createDataFrame([("a", 0)], "text_id string, label int")
    with pytest.raises(ValueError, match="ground truth"):
        J.align_one_to_one(truth, ann, "gt", "label")
    got = J.align_one_to_one(truth.distinct(), ann, "gt", "label").first()
    assert (got["truth_label"], got["annotated_label"]) == (1, 0)


def test_invalid_label_drops_the_whole_text(spark):
    df = spark.createDataFrame([("a", 1), ("a", -1), ("b", 2)], "text_id string, label int")
    assert [tuple(r) for r in J.drop_invalid(df).collect()] == [("b", 2)]


def test_folds_are_free_of_leakage(spark):
    folds = spark.createDataFrame(
        [(0, "train", "a", "A", 1), (0, "val", "a", "A", 1), (0, "val", "b", "B", 2), (1, "train", "b", "B", 2), (1, "val", "a", "A", 1),
         (1, "train", "c", "C", 3)], "fold int, split string, text_id string, text string, label int")
    ann = spark.createDataFrame([("a", "A", 9), ("b", "B", 8)], "text_id string, text string, label int")
    out = {(r["fold"], r["split"], r["text_id"], r["label"]) for r in J.align_folds(folds, ann).collect()}
    assert out == {(0, "train", "a", 9), (0, "val", "b", 2), (1, "train", "b", 8), (1, "val", "a", 1)}
    cover = {r["fold"]: (r["fold_rows"], r["annotated_rows"], r["missing_ids"], r["coverage"]) for r in J.split_coverage(folds, ann).collect()}
    assert cover == {0: (1, 1, 0, 1.0), 1: (2, 1, 1, 0.5)}
    twice = ann.union(ann)
    with pytest.raises(ValueError):
        J.align_folds(folds, twice)
    assert J.align_folds(folds, twice, allow_duplicate_ids=True).filter("split = 'train'").count() == 4


@pytest.fixture
def small_partitions(spark):
    """Thresholds at which a few kilobytes count as a skewed partition, and no broadcast."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
                "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
                "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100KB",
                "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def skewed_plan(df):
    df.collect()
    return "skew=true" in df._jdf.queryExecution().executedPlan().toString()


def test_hot_key_is_split_at_run_time(spark, small_partitions):
    """A key with a third of the rows meets a side with one row per key: AQE splits it."""
    rows = spark.range(0, 60000, 1, 8).select(
        "id", F.sha2(F.col("id").cast("string"), 256).alias("payload"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.md5(F.col("id").cast("string"))).alias("text_id"))
    keep = J.keep_ids(rows, rows)
    assert skewed_plan(keep) and keep.count() == 60000
    drop = J.drop_ids(rows, rows.filter("id < 1000"))
    assert skewed_plan(drop) and drop.filter("text_id = 'hot'").count() == 0
    truth = rows.select("text_id", "id", (F.col("id") % 7).alias("ground_truth"))
    joined = J.attach_truth(rows, truth, "id")
    assert skewed_plan(joined) and joined.count() == 60000
    members = D.duplicate_members(rows, "text_id")
    assert skewed_plan(members) and members.count() == 20000


def test_common_term_is_split_at_run_time(spark, small_partitions):
    from accordant.operators import weighting as W

    docs = spark.range(0, 100000, 1, 8).select(
        "id", F.concat(F.lit("common "), F.sha2(F.col("id").cast("string"), 256)).alias("text"))
    out = W.tfidf(docs, "id", stop_words=[], min_df=1)
    assert skewed_plan(out) and out.filter("term = 'common'").count() == 100000


def test_perspectives_drop_bad_labels(spark):
    df = spark.createDataFrame([(" t ", "1", "x"), (None, "-1", "2")], "text string, a_consensus string, b_consensus string")
    out = U.perspectives(df, ["a_consensus", "b_consensus"], meanings={"1": "one"}).collect()
    assert {(r["text"], r["label"], r["llm"], r["label_description"]) for r in out} == {("t", 1, "a", "one"), ("", 2, "b", None)}


def test_labels(spark):
    df = spark.createDataFrame([("7",), ("-1",), ("x",), (None,), ("7",)], "l string")
    assert [r[0] for r in B.infer_categories(df, ["l"]).collect()] == [7]
    assert B.category_list(df, ["l"], invalid=None) == [-1, 7]
    with pytest.raises(ValueError):
        B.category_list(spark.range(50).withColumnRenamed("id", "l"), ["l"], at_most=10)
    enc = spark.createDataFrame([(10,), (2,), (None,), (10,)], "l int")
    assert {(r["l"], r["class_index"]) for r in B.encode(enc, "l", "class_index").collect()} == {(2, 0), (10, 1), (None, None)}


def test_dataset_precedence_and_splits(spark):
    root = fresh_path(spark, "dataset")
    for split, text in (("train", "a"), ("test", "b")):
        spark.createDataFrame([(text, 1)], "text string, label int").write.parquet(f"{root}/{split}")
    spec = datasets.DatasetSpec(path=root, combine_splits=("train", "validation", "test"), meanings={"1": "yes"})
    got = datasets.load_texts(spark, spec).collect()
    assert {(r["text"], r["label_description"]) for r in got} == {("a", "yes"), ("b", "yes")}
    assert datasets.load_texts(spark, datasets.DatasetSpec(path=root, split="test")).count() == 1
    assert datasets.load_texts(spark, datasets.DatasetSpec(path=root, file="train", split="test")).first()["text"] == "a"
    with pytest.raises(ValueError, match="none of the splits"):
        datasets.read_splits(spark, root, ["dev"])
    with pytest.raises(ValueError, match="missing columns"):
        datasets.load_texts(spark, datasets.DatasetSpec(path=root, split="test", text_column="body"))
    cat = datasets.Catalogue({"d": spec})
    assert cat.names() == ["d"] and cat.info("d")["path"] == root and cat.table(spark).count() == 1
    with pytest.raises(ValueError, match="unknown dataset"):
        cat.info("e")


def test_runs(spark):
    df = spark.createDataFrame([("d", r) for r in ("2026-01-01_00-00-00", "2026-01-02_00-00-00", "2026-01-03_00-00-00", "three models")],
                               "dataset string, run_id string")
    assert {(r["run_id"][:10], r["replica"]) for r in runs.last_runs(df, 2).collect()} == {("2026-01-02", 1), ("2026-01-03", 2)}
    assert runs.latest_run(df.filter("run_id like '2026%'")).first()["run_id"] == "2026-01-03_00-00-00"
    root = fresh_path(spark, "runs")
    df.filter("run_id like '2026%'").write.parquet(f"{root}/2026-01-09_10-00-00/annotations")
    assert runs.run_from_path(spark.read.parquet(f"{root}/2026-01-09_10-00-00/annotations")).first()["run_id"] == "2026-01-09_10-00-00"


def test_fold_files_end_at_the_first_gap(spark):
    root = fresh_path(spark, "folds")
    one = spark.createDataFrame([("t",)], "text string")
    for i in (0, 1, 3):
        one.write.parquet(f"{root}/train_fold_{i}")
        one.write.parquet(f"{root}/test_fold_{i}")
    got = FO.read_folds(spark, root)
    assert {(r["fold"], r["split"]) for r in got.collect()} == {(0, "train"), (0, "val"), (1, "train"), (1, "val")}
    with pytest.raises(ValueError):
        FO.read_folds(spark, root, train="none_")


def test_fold_scores(spark):
    wide = spark.createDataFrame([("d", 0.5, None), ("e", 0.1, 0.2)], "dataset string, mac0 double, mac1 double")
    assert {tuple(r) for r in FO.scores_from_wide(wide).collect()} == {("d", 0, 0.5), ("e", 0, 0.1), ("e", 1, 0.2)}
    js = spark.createDataFrame([('{"folds": {"0": {"eval_f1_macro": 0.7, "eval_loss": 1}}}',)], "value string")
    assert tuple(FO.scores_from_json(js).first()) == (0, 0.7)


def test_csv_keeps_line_breaks_and_quotes(spark):
    rows = [("k1", 'say "hi",\nthen go'), ("k2", "plain")]
    path = fresh_path(spark, "csv")
    artefacts.write_csv(spark.createDataFrame(rows, "text_id string, text string"), path)
    back = artefacts.read_annotations_csv(spark, path, "text_id string, text string")
    assert {tuple(r) for r in back.collect()} == set(rows)


def test_load_or_build_builds_once(spark):
    path, calls = fresh_path(spark, "table"), []

    def build():
        calls.append(1)
        return spark.range(3)

    for force in (False, False, True):
        assert artefacts.load_or_build(spark, path, build, force).count() == 3
    assert len(calls) == 2


def test_shared_root_follows_the_session(spark):
    local = shared_root(spark)
    assert shared_root(spark) == local
