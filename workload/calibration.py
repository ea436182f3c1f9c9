"""Confidence and calibration queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from accordant.functions import confidence as K
from accordant.operators import calibration as L, ranking
from workload.agreement import r9
from workload.base import CATEGORIES, CONFS, VOTES, annotations, register, with_votes

EDGES = K.bin_edges(10)[1:-1]


def sql_bin(x: str) -> str:
    return "cast(" + " + ".join(f"({x} > {e!r}::DOUBLE)::int" for e in EDGES) + " as int)"


CAL = f"""
cal AS (SELECT doc_id, annotator AS model, label, conf, dataset, (label = ground_truth)::int AS correct, {sql_bin('conf')} AS bin
        FROM long WHERE ground_truth IS NOT NULL)"""


def rows(spark, sf_dir, keep=("doc_id", "dataset")):
    return L.scored(L.long_confidences(annotations(spark, sf_dir), VOTES, keep=keep))


@register("reliability_bins", with_votes("""
SELECT model, bin, round(avg(conf), 9) AS mean_conf, round(avg(correct), 9) AS accuracy, count(*) AS n
FROM cal GROUP BY 1, 2""", CAL))
def reliability(spark, sf_dir):
    return r9(L.reliability(rows(spark, sf_dir)), "mean_conf", "accuracy")


ECE = """
ece AS (SELECT model, sum(n * abs(a - c)) / sum(n) AS ece FROM
        (SELECT model, bin, count(*) AS n, avg(correct) AS a, avg(conf) AS c FROM cal GROUP BY 1, 2) GROUP BY model)"""


@register("ece", with_votes("SELECT model, round(ece, 9) AS ece FROM ece", CAL, ECE))
def ece(spark, sf_dir):
    return r9(L.expected_calibration_error(rows(spark, sf_dir)), "ece")


@register("confidence_quadrants", with_votes("""
SELECT model, count(*) FILTER (WHERE correct = 1 AND conf >= 0.9) AS correct_high,
       count(*) FILTER (WHERE correct = 1 AND conf < 0.9) AS correct_low,
       count(*) FILTER (WHERE correct = 0 AND conf >= 0.9) AS wrong_high,
       count(*) FILTER (WHERE correct = 0 AND conf < 0.9) AS wrong_low FROM cal GROUP BY model""", CAL))
def quadrants(spark, sf_dir):
    return L.quadrants(rows(spark, sf_dir))


@register("quadrant_class", with_votes("""
SELECT doc_id, model, (case when correct = 1 then 'correct_' else 'wrong_' end) ||
       (case when conf >= 0.9 then 'high' else 'low' end) AS quadrant FROM cal""", CAL))
def quadrant_class(spark, sf_dir):
    return rows(spark, sf_dir).select(
        "doc_id", "model", K.quadrant(F.col("correct") == 1, F.col("conf")).alias("quadrant"))


@register("conf_by_class", with_votes("""
SELECT annotator AS model, round(avg(conf) FILTER (WHERE label = 0), 9) AS class_0,
       round(avg(conf) FILTER (WHERE label = 1), 9) AS class_1, round(avg(conf) FILTER (WHERE label = 2), 9) AS class_2,
       round(avg(conf) FILTER (WHERE label = 3), 9) AS class_3 FROM long GROUP BY 1"""))
def by_class(spark, sf_dir):
    long = L.long_confidences(annotations(spark, sf_dir), VOTES)
    return r9(L.confidence_by_class(long, CATEGORIES), *[f"class_{c}" for c in CATEGORIES])


@register("confidence_gap", with_votes("""
SELECT model, round(avg(conf) FILTER (WHERE correct = 1), 9) AS conf_correct,
       round(avg(conf) FILTER (WHERE correct = 0), 9) AS conf_wrong,
       round(avg(conf) FILTER (WHERE correct = 1) - avg(conf) FILTER (WHERE correct = 0), 9) AS gap
FROM cal GROUP BY model""", CAL))
def gap(spark, sf_dir):
    return r9(L.confidence_gap(rows(spark, sf_dir)), "conf_correct", "conf_wrong", "gap")


BALANCED = """
sized AS (SELECT *, row_number() OVER (PARTITION BY model, bin, correct ORDER BY md5(doc_id::VARCHAR || '|42'), doc_id) AS rk,
                 count(*) FILTER (WHERE correct = 1) OVER (PARTITION BY model, bin) AS yes,
                 count(*) FILTER (WHERE correct = 0) OVER (PARTITION BY model, bin) AS no FROM cal),
bal AS (SELECT * FROM sized WHERE rk <= least(yes, no))"""


@register("balanced_sample", with_votes("SELECT doc_id, model, bin, correct FROM bal", CAL, BALANCED))
def balanced(spark, sf_dir):
    return L.balanced_rows(rows(spark, sf_dir), "doc_id").select("doc_id", "model", "bin", "correct")


@register("brier_balanced", with_votes("""
SELECT model, round(avg((conf - correct) * (conf - correct)), 9) AS bbs FROM bal GROUP BY model""", CAL, BALANCED))
def brier(spark, sf_dir):
    return r9(L.balanced_brier(rows(spark, sf_dir), "doc_id"), "bbs")


@register("brier_balanced_by_bin", with_votes("""
SELECT model, bin, round(bbs_bin, 9) AS bbs_bin, round(mean_conf, 9) AS mean_conf FROM
  (SELECT model, bin, avg((conf - correct) * (conf - correct)) AS bbs_bin FROM bal GROUP BY 1, 2)
  JOIN (SELECT model, bin, avg(conf) AS mean_conf FROM cal GROUP BY 1, 2) USING (model, bin)""", CAL, BALANCED))
def brier_bins(spark, sf_dir):
    return r9(L.balanced_brier_by_bin(rows(spark, sf_dir), "doc_id"), "bbs_bin", "mean_conf")


@register("ece_vs_brier", with_votes("""
SELECT model, round(ece, 9) AS ece, round(bbs, 9) AS bbs FROM ece JOIN
  (SELECT model, avg((conf - correct) * (conf - correct)) AS bbs FROM bal GROUP BY model) USING (model)""",
    CAL, BALANCED, ECE))
def comparison(spark, sf_dir):
    return r9(L.calibration_comparison(rows(spark, sf_dir), "doc_id"), "ece", "bbs")


@register("confidence_bins", with_votes(f"""
SELECT doc_id, {sql_bin('ann_a_conf')} AS bin_a, {sql_bin('ann_b_conf')} AS bin_b, {sql_bin('ann_c_conf')} AS bin_c FROM v"""))
def bins(spark, sf_dir):
    return annotations(spark, sf_dir).select(
        "doc_id", *[K.confidence_bin(F.col(c)).alias(f"bin_{c[4]}") for c in CONFS])


@register("mean_confidence", with_votes("""
SELECT doc_id, round((ann_a_conf + ann_b_conf + ann_c_conf) / 3, 9) AS mean_confidence FROM v"""))
def mean_confidence(spark, sf_dir):
    return r9(annotations(spark, sf_dir).select("doc_id", K.mean_confidence(CONFS).alias("mean_confidence")),
              "mean_confidence")


@register("confidence_quantiles", with_votes("""
SELECT model, fraction, round(quantile, 9) AS quantile FROM (
  SELECT annotator AS model, unnest([0.25::DOUBLE, 0.5::DOUBLE, 0.75::DOUBLE]) AS fraction,
         unnest(quantile_cont(conf, [0.25, 0.5, 0.75])) AS quantile FROM long GROUP BY annotator)"""))
def quantiles(spark, sf_dir):
    long = L.long_confidences(annotations(spark, sf_dir), VOTES)
    return r9(ranking.exact_quantiles(long, "conf", [0.25, 0.5, 0.75], ["model"]), "quantile")
