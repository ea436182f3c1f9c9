"""Vote resolution against hand-computed rows and a brute-force counter."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from accordant.functions import votes as V
from accordant.operators import consensus as C

GOLDEN = [
    # id, votes, unique, mode, count, score, level, tie, weighted, unanimous, outliers, entropy
    ("t1", (0, 0, 0), 1, 0, 3, 1.0, "high", False, 0, 0, 0, 0.0),
    ("t2", (0, 0, 1), 2, 0, 2, 2 / 3, "medium", False, 0, None, None, 0.918296),
    ("t3", (1, 1, 0), 2, 1, 2, 2 / 3, "medium", False, 1, None, None, 0.918296),
    ("t4", (0, 1, 2), 3, 0, 1, 1 / 3, "low", True, 0, None, None, 1.584963),
    ("t5", (2, 2, 2), 1, 2, 3, 1.0, "high", False, 2, 2, 2, 0.0),
    ("t6", (-1, 1, 1), 2, 1, 2, 2 / 3, "medium", False, 1, None, None, 0.918296),
]
COLS = ["a_consensus", "b_consensus", "c_consensus"]
WEIGHTS = {"a": 1.30, "b": 1.25, "c": 1.20}


@pytest.fixture(scope="module")
def golden(spark):
    return spark.createDataFrame([(r[0], *r[1]) for r in GOLDEN], "id string, a_consensus int, b_consensus int, c_consensus int")


def test_golden_rows(golden):
    out = {r["id"]: r for r in C.vote_entropy(C.resolve(golden, COLS), COLS).collect()}
    for id_, votes, unique, mode, count, score, level, tie, *_, entropy in GOLDEN:
        r = out[id_]
        assert (r["all_annotations"], r["unique_annotations"], r["most_common_annotation"], r["most_common_count"]) == (
            list(votes), unique, mode, count)
        assert r["consensus_score"] == score and r["consensus_level"] == level and r["is_problematic"] is tie
        assert r["resolved_annotation"] == mode and r["needs_review"] is False
        assert r["entropy"] == pytest.approx(entropy, abs=1e-6)


@pytest.mark.parametrize("strategy,at", [("weighted_vote", 8), ("unanimous_only", 9), ("remove_outliers", 10)])
def test_golden_strategies(golden, strategy, at):
    out = C.resolve(golden, COLS, strategy=strategy, params={"weights": WEIGHTS})
    assert {r["id"]: r["resolved_annotation"] for r in out.collect()} == {r[0]: r[at] for r in GOLDEN}


def test_threshold_without_strategy(golden):
    out = C.resolve(golden, COLS, strategy=None)
    assert {r["id"] for r in out.filter("needs_review").collect()} == {"t2", "t3", "t4", "t6"}


def test_unknown_strategy(golden):
    with pytest.raises(ValueError, match="unknown strategy"):
        C.resolve(golden, COLS, strategy="loudest")


def test_registered_strategy(golden):
    @V.strategy("last_seat")
    def last_seat(ballot):
        return ballot.votes[-1]

    try:
        out = C.resolve(golden, COLS, strategy="last_seat")
        assert out.filter("id = 't4'").first()["resolved_annotation"] == 2
    finally:
        del V.STRATEGIES["last_seat"]


def brute(votes):
    cast = [v for v in votes if v is not None]
    counts = Counter(cast)
    if not counts:
        return None, 0, 0, False
    top = max(counts.values())
    mode = next(v for v in cast if counts[v] == top)
    return mode, top, len(counts), list(counts.values()).count(top) > 1


@pytest.mark.parametrize("seats", [1, 2, 3, 5, 6, 7, 9])
def test_against_counter(spark, seats):
    """Unrolled and array forms agree with a counter, abstentions included."""
    rng = random.Random(seats)
    rows = [[rng.choice([None, -1, 0, 1, 2]) for _ in range(seats)] for _ in range(150)]
    names = [f"m{i}_consensus" for i in range(seats)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, " + ", ".join(f"{n} int" for n in names))
    out = C.resolve(df, names)
    assert out.filter("most_common_count < 0").count() == 0  # a pushed-down filter compiles too
    for r in out.collect():
        mode, top, distinct, tie = brute(rows[r["id"]])
        assert (r["most_common_annotation"], r["most_common_count"], r["unique_annotations"], r["is_problematic"]) == (
            mode, top, distinct, tie)
        assert r["consensus_score"] == top / seats


def test_map_and_pattern(golden):
    bad = C.problematic_cases(golden, COLS, keep=("id",)).collect()
    assert [(r["id"], r["annotations"]) for r in bad] == [("t4", {0: 1, 1: 1, 2: 1})]
    assert bad[0]["entropy"] == pytest.approx(math.log2(3))
    patterns = {r["id"]: r["pattern"] for r in C.agreement_pattern(golden, COLS).collect()}
    assert patterns == {"t1": "3x0", "t2": "2x1", "t3": "2x1", "t4": "1x1x1", "t5": "3x0", "t6": "2x1"}


def test_column_rules():
    cols = ["a_consensus", "a_consensus_score", "b_consensus", "consensus_score", "text"]
    assert C.vote_columns(cols) == ["a_consensus", "b_consensus"]
    assert C.paired_vote_columns(cols) == ["a_consensus"]
    with pytest.raises(ValueError):
        C.vote_columns(["text"])


def test_no_shuffle(golden):
    plan = C.resolve(golden, COLS)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_repetitions(spark):
    rows = [("t", "m", 0, 5, 1.0), ("t", "m", 1, 7, 1.0), ("t", "m", 2, 7, 1.0), ("t", "n", 0, 3, 0.5), ("t", "n", 1, 4, 0.5)]
    df = spark.createDataFrame(rows, "text_id string, annotator string, rep int, label int, elapsed_sec double")
    got = {r["annotator"]: (r["label"], round(r["score"], 6), r["elapsed_sec"]) for r in C.repetition_consensus(df).collect()}
    assert got == {"m": (7, 0.666667, 3.0), "n": (3, 0.5, 1.0)}


def test_stats_add_up(golden):
    s = C.stats(C.resolve(golden, COLS)).first()
    assert s["high"] + s["medium"] + s["low"] == s["total"] == 6
    assert F is not None
