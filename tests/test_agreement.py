import pytest

from accordant.operators import agreement as A, quality as Q
from tests.test_votes import COLS, GOLDEN


@pytest.fixture(scope="module")
def golden(spark):
    truth = {"t1": 0, "t2": 0, "t3": 0, "t4": 1, "t5": 2, "t6": 1}
    return spark.createDataFrame([(r[0], *r[1], truth[r[0]]) for r in GOLDEN],
                                 "id string, a_consensus int, b_consensus int, c_consensus int, ground_truth int")


def test_fleiss(golden):
    r = A.fleiss_kappa(golden, COLS, categories=[0, 1, 2]).first()
    assert r["fleiss_kappa"] == pytest.approx(0.233183856502, abs=1e-12)
    assert r["p_bar"] == pytest.approx(0.472222, abs=1e-6) and r["p_e"] == pytest.approx(0.311728, abs=1e-6)
    assert r["interpretation"] == "Fraco"


def test_fleiss_of_one_category(spark):
    df = spark.createDataFrame([(1, 1), (1, 1)], "a_consensus int, b_consensus int")
    assert A.fleiss_kappa(df, categories=[1]).first()["fleiss_kappa"] == 1.0


def test_pairs(golden):
    got = {(r["annotator_1"], r["annotator_2"]): r["agreement"] for r in A.pairwise_agreement(golden, COLS).collect()}
    assert got[("a", "b")] == pytest.approx(2 / 3) and got[("a", "c")] == pytest.approx(1 / 3) and got[("b", "c")] == 0.5
    assert all(got[(x, y)] == got[(y, x)] for x, y in got) and got[("a", "a")] == 1.0 and len(got) == 9


def test_cohen(golden):
    got = {(r["annotator_1"], r["annotator_2"]): r["cohens_kappa"] for r in A.cohen_kappa(golden, COLS).collect()}
    assert got == {("a", "b"): pytest.approx(0.538462, abs=1e-6), ("a", "c"): pytest.approx(0.076923, abs=1e-6),
                   ("b", "c"): pytest.approx(0.25)}


def test_cohen_degenerate(spark):
    df = spark.createDataFrame([(1, 1), (1, 1)], "a_consensus int, b_consensus int")
    r = A.cohen_kappa(df).first()
    assert r["cohens_kappa"] is None and r["interpretation"] == "Muito Fraco"


def test_krippendorff(spark):
    # Three raters, missing votes; alpha worked out by hand from the coincidence matrix.
    df = spark.createDataFrame([(1, 1, None), (2, 2, 2), (1, 2, 2), (3, None, None)], "a_consensus int, b_consensus int, c_consensus int")
    r = A.krippendorff_alpha(df).first()
    # units: 2, 3, 3 votes; n = 8, counts 3 ones and 5 twos; D_o = 2, D_e = 30 / 7
    assert r["pairable_votes"] == 8 and r["alpha"] == pytest.approx(1 - 2 / (30 / 7))


def test_model_metrics_without_valid_rows(spark):
    df = spark.createDataFrame([(0, -1), (1, -1)], "ground_truth int, a_consensus int")
    r = Q.model_metrics(df, ["a_consensus"]).first()
    assert (r["accuracy"], r["f1_macro"], r["error_rate"], r["coverage"]) == (0.0, 0.0, 1.0, 0.0)


def test_report_and_matrix(golden):
    rows = {r["class"]: r for r in Q.classification_report(golden, pred="a_consensus").collect()}
    assert rows["0"]["support"] == 3 and rows["0"]["precision"] == pytest.approx(2 / 3)
    assert rows["accuracy"]["precision"] == pytest.approx(0.5)
    matrix = {r["ground_truth"]: r for r in Q.confusion_matrix(golden, [0, 1, 2], pred="a_consensus").collect()}
    assert matrix[0]["pred_0"] == 2 and matrix[0]["pred_1"] == 1 and matrix[1]["pred_2"] == 0


def test_clean_label(spark):
    df = spark.createDataFrame([("3",), ("ERROR",), ("",), ("N/A",), (None,), ("x",)], "v string")
    assert [r[0] for r in df.select(Q.clean_label("v")).collect()] == [3, -1, -1, -1, -1, -1]
