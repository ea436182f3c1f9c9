"""Bucketed ranks and order statistics against a plain sort."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from accordant.functions import text as T
from accordant.operators import ranking as R, regression as G, sampling as S


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    # One group holds a third of the rows, one is null.
    return spark.createDataFrame(
        [(i, "hot" if i % 3 == 0 else rng.choice(["a", "b", None]), rng.choice([1.0, rng.random()])) for i in range(900)],
        "id long, g string, v double").cache()


def order_of(df):
    pdf = df.withColumn("o", T.shuffle_key("id", 42)).toPandas()
    return pdf.sort_values(["o", "id"])


@pytest.mark.parametrize("buckets", [1, 7, 4096])
def test_rank_by_hash(rows, buckets):
    got = R.rank_by_hash(rows, T.shuffle_key("id", 42), "id", ["g"], buckets=buckets).toPandas()
    assert len(got) == 900
    want = order_of(rows)
    want["r"] = want.groupby(want["g"].fillna("null")).cumcount() + 1
    assert dict(zip(got["id"], got["rank"])) == dict(zip(want["id"], want["r"]))


@pytest.mark.parametrize("n", [0, 1, 57, 300, 10_000])
def test_smallest_per_group(spark, rows, n):
    order = T.shuffle_key("id", 42)
    limits = rows.select("g").distinct().withColumn("k", F.lit(n).cast("long"))
    got = R.smallest(rows, order, R.hash_bucket(order, 16), limits, "id", ["g"]).toPandas()
    want = order_of(rows)
    want = want[want.groupby(want["g"].fillna("null")).cumcount() < n]
    assert sorted(got["id"]) == sorted(want["id"]) and list(got.columns) == ["id", "g", "v"]


def test_shuffled_sample_is_partition_free(rows):
    a = {r["id"] for r in S.shuffled_sample(rows.repartition(1), "id", 100).collect()}
    b = {r["id"] for r in S.shuffled_sample(rows.repartition(7), "id", 100).collect()}
    assert a == b and len(a) == 100
    assert a == set(order_of(rows)["id"][:100])


@pytest.mark.parametrize("accuracy", [50, 20000])
def test_exact_quantiles(rows, accuracy):
    """With a coarse sketch the bracket path decides; it must still be exact."""
    got = {(r["g"], r["fraction"]): r["quantile"] for r in
           R.exact_quantiles(rows, "v", [0.0, 0.25, 0.5, 0.9, 1.0], ["g"], accuracy).collect()}
    for g, part in rows.toPandas().groupby("g", dropna=False):
        key = None if pd.isna(g) else g
        for f in (0.0, 0.25, 0.5, 0.9, 1.0):
            assert got[(key, f)] == pytest.approx(np.quantile(part["v"], f), abs=1e-12)


def test_quantiles_over_all(rows):
    got = {r["fraction"]: r["quantile"] for r in R.exact_quantiles(rows, "v", [0.1, 0.5], accuracy=60).collect()}
    v = rows.toPandas()["v"]
    assert got == {f: pytest.approx(np.quantile(v, f)) for f in (0.1, 0.5)}


@pytest.mark.parametrize("splits", [2, 16, 1024])
def test_average_ranks(rows, splits):
    got = {r["value"]: r["rank"] for r in R.average_ranks(rows, "v", splits).collect()}
    pdf = rows.toPandas()
    assert got == dict(zip(pdf["v"], pdf["v"].rank()))


def test_spearman(spark):
    rng = np.random.default_rng(1)
    x = np.round(rng.random(400), 2)
    y = np.round(x + rng.random(400), 1)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y}))
    want = np.corrcoef(pd.Series(x).rank(), pd.Series(y).rank())[0, 1]
    assert G.spearman(df, ["x", "y"]).first()["rho"] == pytest.approx(want, abs=1e-12)


def test_folds_are_balanced(rows):
    labelled = rows.filter("g is not null")
    out = S.stratified_folds(labelled, "g", "id", 4).groupBy("g", "fold").count().toPandas()
    for _, part in out.groupby("g"):
        assert len(part) == 4 and part["count"].max() - part["count"].min() <= 1


def test_safe_folds(spark):
    df = spark.createDataFrame([(i, "a" if i < 20 else "b") for i in range(23)], "id long, g string")
    assert S.safe_folds(df, "g", 5).first()["k"] == 3
    assert S.safe_folds(df.filter("id < 21"), "g", 5).first()["k"] == 2


def test_halves(rows):
    out = S.stratified_halves(rows, "g", "id").groupBy("g").pivot("split", ["val", "test"]).count().collect()
    assert all(0 <= r["val"] - r["test"] <= 1 for r in out)
