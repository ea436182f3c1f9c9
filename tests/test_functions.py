import hashlib
import math

import pytest
from pyspark.sql import functions as F

from accordant.functions import coding, confidence as K, prompts, responses as R, tails, text as T


def test_strip_matches_python(spark):
    spaces = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    texts = [s + "a " + s + "b" + s + "\n" for s in spaces] + ["", " ", "plain", "​x​"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(T.strip("t"), T.text_id("t"), T.text_len("t")).collect()
    assert len(spaces) == 29
    for t, r in zip(texts, got):
        assert tuple(r) == (t.strip(), hashlib.md5(t.strip().encode()).hexdigest(), len(t))


def test_cache_key(spark):
    df = spark.createDataFrame([("é text",)], "t string")
    want = hashlib.md5('m|é text|{"rep": 2}'.encode()).hexdigest()
    assert df.select(T.cache_key(F.lit("m"), "t", F.lit(2))).first()[0] == want


def test_uniform_is_stable_and_open_at_zero(spark):
    df = spark.range(5000).select(T.uniform("id", 7).alias("u")).agg(F.min("u"), F.max("u"), F.avg("u")).first()
    assert 0 < df[0] and df[1] <= 1 and abs(df[2] - 0.5) < 0.02


@pytest.mark.parametrize("answer,label", [
    ("3", 3), ("Class: -2 or 4", -1), ("x CLASSIFICATION: 1", 1), ("", -1), (None, -1), ("none", -1), ("7", -1),
    ("99999999999999", -1), (" +2 ", 2), ("classification: 9, 2", -1), ("CLASSIFICATION: 9 CLASSIFICATION:\n 0 \n", 0),
    ("1_0", -1), ("0_3", 3), ("answer 2.", 2), ("   ", -1), ("-1", -1)])
def test_labels(spark, answer, label):
    df = spark.createDataFrame([(answer,)], "c string")
    r = df.select(R.extract_label(F.col("c"), [0, 1, 2, 3]).alias("l"), R.is_valid(F.col("c"), [0, 1, 2, 3]).alias("v")).first()
    assert r["l"] == label and r["v"] is (label != -1)


def test_confidence_outside_reasoning(spark):
    schema = "label int, lp array<struct<token:string,logprob:double>>"
    rows = [(2, [("<think>", 0.0), ("2", -3.0), ("</think>", 0.0), (" 2", -0.1), ("2", -5.0)]),
            (2, [("<think>", 0.0), ("2", -3.0)]), (2, []), (2, None), (-1, [("-1", -0.5)])]
    got = [r[0] for r in spark.createDataFrame(rows, schema).select(R.label_confidence(F.col("label"), F.col("lp"))).collect()]
    assert got == [pytest.approx(math.exp(-0.1)), None, None, None, pytest.approx(math.exp(-0.5))]


def test_bins(spark):
    cases = {0.0: 0, 0.1: 0, 0.2: 1, 0.3: 2, 0.30000000000000004: 2, 0.6: 5, 0.7: 6, 0.95: 9, 1.0: 9, 1.2: None, -0.1: None}
    df = spark.createDataFrame([(c,) for c in cases], "c double")
    assert [r[0] for r in df.select(K.confidence_bin(F.col("c"))).collect()] == list(cases.values())


def test_row_confidence(spark):
    df = spark.createDataFrame([(0.2, 0.4, None), (0.2, 0.4, 0.9)], "a double, b double, c double")
    got = df.select(K.mean_confidence(["a", "b", "c"]), K.std_confidence(["a", "b", "c"])).collect()
    assert got[0][0] == pytest.approx(0.3) and got[0][1] is None
    assert got[1][0] == pytest.approx(0.5) and got[1][1] == pytest.approx(math.sqrt((0.09 + 0.01 + 0.16) / 3))


def test_logit_clips(spark):
    a, b, c = spark.range(1).select(*[K.logit(F.lit(p)) for p in (0.0, 0.5, 1.0)]).first()
    assert a == pytest.approx(math.log(1e-6 / (1 - 1e-6))) and b == 0.0 and c == pytest.approx(-a, rel=1e-6)


def test_prompts(spark):
    df = spark.createDataFrame([("has {text} and {categories} inside",)], "text string")
    got = df.select(prompts.render("D: {description}|{description_lower}|{categories}|{text}|", "text",
                                   meanings={"0": "no", "1": "yes"}, description="News item")).first()[0]
    assert got == "D: News item|news item|- 0: no\n- 1: yes|has {text} and {categories} inside|"
    for name in prompts.TEMPLATES:
        assert "{" not in df.select(prompts.render(name, F.lit("T"), meanings={"0": "no"}, examples=F.lit("E"))).first()[0]
    assert prompts.numbered(["a", "b"]) == {"0": "a", "1": "b"}


def test_tails():
    n = tails.numeric()
    assert n.t_critical(0.95, 16) == pytest.approx(2.119905, abs=1e-6)
    assert n.f_critical(0.95, 3, 12) == pytest.approx(3.490295, abs=1e-6)
    assert n.normal_critical(0.95) == pytest.approx(1.959963985, abs=1e-9)
    assert n.t_two_sided(12.706204736, 1) == pytest.approx(0.05, abs=1e-9)
    assert n.chi2_sf(7.814727903, 3) == pytest.approx(0.05, abs=1e-9)
    assert n.chi2_sf(0.5, 3) == pytest.approx(0.918891411655, abs=1e-9)
    assert n.f_sf(0.0, 3, 12) == 1.0 and n.chi2_sf(0.0, 2) == 1.0


def test_tail_columns(spark):
    df = spark.createDataFrame([(2.0, 10), (None, 10)], "t double, df int")
    p = [r[0] for r in df.select(tails.t_two_sided(F.col("t"), F.col("df"))).collect()]
    assert p[0] == pytest.approx(0.07338803477, abs=1e-9) and p[1] is None
    one = spark.range(1).select(tails.f_sf(F.lit(3.490295), F.lit(3), F.lit(12)), tails.chi2_sf(F.lit(3.841459), F.lit(1)),
                                tails.normal_two_sided(F.lit(1.96)), tails.t_critical(F.lit(16))).first()
    assert [round(x, 4) for x in one] == [0.05, 0.05, 0.05, 2.1199]


def test_factor_coding(spark):
    df = spark.createDataFrame([("x", "lo"), ("y", "hi"), ("y", "lo")], "d string, s string")
    rows = coding.code_factors(df, {"B": ("d", "x", "y"), "C": ("s", "lo", "hi")}).collect()
    assert [(r["B"], r["C"], r["BC"], r["treatment"]) for r in rows] == [(-1, -1, 1, "(1)"), (1, 1, 1, "bc"), (1, -1, -1, "b")]
