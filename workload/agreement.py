"""Agreement and label-quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from accordant.operators import agreement as A, consensus as C, quality as Q
from workload.base import ANNOTATORS, CATEGORIES, VOTES, annotations, register, with_votes
from workload.consensus import majority

NAMES = list(ANNOTATORS)


def r9(df, *cols):
    return df.withColumns({c: F.round(c, 9) for c in cols})


@register("pairwise_agreement", with_votes("""
SELECT a.annotator AS annotator_1, b.annotator AS annotator_2,
       case when a.annotator = b.annotator then 1e0 else avg((a.label = b.label)::int) end AS agreement
FROM long a JOIN long b USING (doc_id) GROUP BY 1, 2"""))
def pairwise(spark, sf_dir):
    return A.pairwise_agreement(annotations(spark, sf_dir), VOTES)


@register("pairwise_matrix", with_votes("""
SELECT a.annotator AS annotator,
       avg((a.label = (select label from long z where z.doc_id = a.doc_id and z.annotator = 'ann_a'))::int) AS ann_a,
       avg((a.label = (select label from long z where z.doc_id = a.doc_id and z.annotator = 'ann_b'))::int) AS ann_b,
       avg((a.label = (select label from long z where z.doc_id = a.doc_id and z.annotator = 'ann_c'))::int) AS ann_c
FROM long a GROUP BY 1"""))
def pairwise_matrix(spark, sf_dir):
    return A.to_matrix(A.pairwise_agreement(annotations(spark, sf_dir), VOTES), "agreement", NAMES)


BAND = ("case when {0} > 0.8 then 'Excelente' when {0} > 0.6 then 'Bom' when {0} > 0.4 then 'Moderado' "
        "when {0} > 0.2 then 'Fraco' else 'Muito Fraco' end")

KAPPA = """
pairs AS (SELECT a.annotator AS a1, b.annotator AS a2, a.label AS l1, b.label AS l2
          FROM long a JOIN long b ON a.doc_id = b.doc_id AND a.seat < b.seat),
obs AS (SELECT a1, a2, avg((l1 = l2)::int) AS po, count(*) AS n FROM pairs GROUP BY 1, 2),
m1 AS (SELECT a1, a2, l1 AS label, count(*) AS m FROM pairs GROUP BY ALL),
m2 AS (SELECT a1, a2, l2 AS label, count(*) AS m FROM pairs GROUP BY ALL),
kap AS (SELECT a1, a2, (po - pe) / (1 - pe) AS kappa FROM obs JOIN
        (SELECT a1, a2, sum((m1.m / n::DOUBLE) * (m2.m / n::DOUBLE)) AS pe
         FROM m1 JOIN m2 USING (a1, a2, label) JOIN obs USING (a1, a2) GROUP BY 1, 2) USING (a1, a2))"""


@register("cohen_kappa", with_votes(f"""
SELECT a1 AS annotator_1, a2 AS annotator_2, round(kappa, 9) AS cohens_kappa, {BAND.format('kappa')} AS interpretation
FROM kap""", KAPPA))
def cohen(spark, sf_dir):
    return r9(A.cohen_kappa(annotations(spark, sf_dir), VOTES), "cohens_kappa")


@register("kappa_matrix", with_votes("""
SELECT a AS annotator, max(case when b = 'ann_a' then v end) AS ann_a, max(case when b = 'ann_b' then v end) AS ann_b,
       max(case when b = 'ann_c' then v end) AS ann_c
FROM (SELECT a1 AS a, a2 AS b, round(kappa, 9) AS v FROM kap UNION ALL SELECT a2, a1, round(kappa, 9) FROM kap
      UNION ALL SELECT DISTINCT annotator, annotator, 1e0 FROM long) GROUP BY a""", KAPPA))
def kappa_matrix(spark, sf_dir):
    pairs = A.symmetric(cohen(spark, sf_dir), "cohens_kappa", NAMES)
    return A.to_matrix(pairs, "v", NAMES, row="a", col="b")


@register("fleiss_kappa", with_votes(f"""
SELECT items, round(p_bar, 9) AS p_bar, round(p_e, 9) AS p_e, round((p_bar - p_e) / (1 - p_e), 9) AS fleiss_kappa,
       {BAND.format('((p_bar - p_e) / (1 - p_e))')} AS interpretation
FROM (SELECT count(*) AS items, avg((sq - 3) / 6e0) AS p_bar FROM
        (SELECT v.doc_id, coalesce(sum(n * n) FILTER (WHERE label <> -1), 0) AS sq
         FROM v LEFT JOIN tally USING (doc_id) GROUP BY v.doc_id)),
     (SELECT sum(s * s) AS p_e FROM (SELECT count(*) / (3e0 * (SELECT count(*) FROM v)) AS s
                                     FROM long WHERE label <> -1 GROUP BY label))"""))
def fleiss(spark, sf_dir):
    return r9(A.fleiss_kappa(annotations(spark, sf_dir), VOTES, categories=CATEGORIES),
              "p_bar", "p_e", "fleiss_kappa")


@register("krippendorff_alpha", with_votes("""
SELECT cast(n as bigint) AS pairable_votes, round(1 - (n - 1) * d / (n * n - sq), 9) AS alpha
FROM (SELECT sum(m) AS n, sum((m * m - ss) / (m - 1)) AS d FROM
        (SELECT doc_id, sum(n)::DOUBLE AS m, sum(n * n) AS ss FROM tally WHERE label <> -1 GROUP BY doc_id) WHERE m >= 2),
     (SELECT sum(c * c) AS sq FROM (SELECT label, sum(n)::DOUBLE AS c FROM tally
        WHERE label <> -1 AND doc_id IN (SELECT doc_id FROM tally WHERE label <> -1 GROUP BY doc_id HAVING sum(n) >= 2)
        GROUP BY label))"""))
def alpha(spark, sf_dir):
    return r9(A.krippendorff_alpha(annotations(spark, sf_dir), VOTES), "alpha")


def classes_sql(src: str, by: str) -> str:
    """CTE ``cls``: per-class counts and scores from ``src`` (groups, gt, pred, n)."""
    g = f"{by}, " if by else ""
    return f"""
cls AS (SELECT {g}label, tp, support, predicted,
               case when predicted > 0 then tp / predicted else 0 end AS prec,
               case when support > 0 then tp / support else 0 end AS rec,
               2 * tp / (support + predicted) AS f1
        FROM (SELECT {g}label, sum(tp)::DOUBLE AS tp, sum(s)::DOUBLE AS support, sum(p)::DOUBLE AS predicted FROM
               (SELECT {g}gt AS label, case when gt = pred then n else 0 end AS tp, n AS s, 0 AS p FROM {src}
                UNION ALL SELECT {g}pred, 0, 0, n FROM {src}) GROUP BY {g}label))"""


MODEL = """
conf AS (SELECT annotator AS model, ground_truth AS gt, label AS pred, count(*) AS n FROM long
         WHERE ground_truth IS NOT NULL GROUP BY ALL),
good AS (SELECT * FROM conf WHERE gt <> -1 AND pred <> -1)"""
_MODEL_SELECT = """
SELECT model, round(accuracy, 9) AS accuracy, round(f1_macro, 9) AS f1_macro, round(precision_macro, 9) AS precision_macro,
       round(recall_macro, 9) AS recall_macro, round(coverage, 9) AS coverage, round(1 - accuracy, 9) AS error_rate,
       round(1 - coverage, 9) AS invalid_predictions_rate
FROM (SELECT model, sum(tp) / sum(support) AS accuracy, avg(f1) AS f1_macro, avg(prec) AS precision_macro,
             avg(rec) AS recall_macro FROM cls GROUP BY model)
JOIN (SELECT model, sum(n) FILTER (WHERE pred <> -1) / sum(n)::DOUBLE AS coverage FROM conf GROUP BY model) USING (model)"""


@register("model_metrics", with_votes(_MODEL_SELECT, MODEL, classes_sql("good", "model")))
def model_metrics(spark, sf_dir):
    return r9(Q.model_metrics(annotations(spark, sf_dir), VOTES), "accuracy", "f1_macro", "precision_macro",
              "recall_macro", "coverage", "error_rate", "invalid_predictions_rate")


@register("clean_labels", with_votes("""
SELECT doc_id, cast(coalesce(try_cast(nullif(nullif(nullif(raw, 'ERROR'), ''), 'N/A') as int), -1) as int) AS label
FROM (SELECT doc_id, case ann_a when -1 then 'ERROR' when 0 then 'N/A' when 1 then '' else ann_a::VARCHAR end AS raw
      FROM v)"""))
def clean_labels(spark, sf_dir):
    vote = F.col("ann_a_consensus")
    raw = (F.when(vote == -1, "ERROR").when(vote == 0, "N/A").when(vote == 1, "")
           .otherwise(vote.cast("string")))
    return annotations(spark, sf_dir).select("doc_id", Q.clean_label(raw).alias("label"))


_RESOLVED = """
conf AS (SELECT ground_truth AS gt, mode AS pred, count(*) AS n FROM c
         WHERE ground_truth IS NOT NULL AND mode <> -1 GROUP BY ALL)"""


def scored(spark, sf_dir):
    return C.valid_for_evaluation(majority(spark, sf_dir))


@register("consensus_accuracy", with_votes("""
SELECT count(*) AS n, round(avg((mode = ground_truth)::int), 9) AS accuracy FROM c
WHERE ground_truth IS NOT NULL AND mode <> -1"""))
def accuracy(spark, sf_dir):
    return r9(Q.accuracy(scored(spark, sf_dir)), "accuracy")


@register("classification_report", with_votes("""
SELECT label::VARCHAR AS class, round(prec, 9) AS precision, round(rec, 9) AS recall, round(f1, 9) AS f1,
       support::BIGINT AS support FROM cls
UNION ALL SELECT 'accuracy', round(sum(tp) / sum(support), 9), round(sum(tp) / sum(support), 9),
       round(sum(tp) / sum(support), 9), sum(support)::BIGINT FROM cls
UNION ALL SELECT 'macro avg', round(avg(prec), 9), round(avg(rec), 9), round(avg(f1), 9), sum(support)::BIGINT FROM cls
UNION ALL SELECT 'weighted avg', round(sum(prec * support) / sum(support), 9), round(sum(rec * support) / sum(support), 9),
       round(sum(f1 * support) / sum(support), 9), sum(support)::BIGINT FROM cls""", _RESOLVED, classes_sql("conf", "")))
def report(spark, sf_dir):
    return r9(Q.classification_report(scored(spark, sf_dir)), "precision", "recall", "f1")


@register("confusion_matrix", with_votes("""
SELECT gt AS ground_truth, coalesce(sum(n) FILTER (WHERE pred = 0), 0)::BIGINT AS pred_0,
       coalesce(sum(n) FILTER (WHERE pred = 1), 0)::BIGINT AS pred_1,
       coalesce(sum(n) FILTER (WHERE pred = 2), 0)::BIGINT AS pred_2,
       coalesce(sum(n) FILTER (WHERE pred = 3), 0)::BIGINT AS pred_3 FROM conf GROUP BY gt""", _RESOLVED))
def matrix(spark, sf_dir):
    return Q.confusion_matrix(scored(spark, sf_dir), CATEGORIES)


@register("prediction_metrics", with_votes("""
SELECT sum(support)::BIGINT AS n, round(sum(tp) / sum(support), 9) AS accuracy, round(avg(f1), 9) AS f1_macro,
       round(avg(prec), 9) AS precision_macro, round(avg(rec), 9) AS recall_macro FROM cls""",
    _RESOLVED, classes_sql("conf", "")))
def prediction_metrics(spark, sf_dir):
    return r9(Q.macro_metrics(scored(spark, sf_dir), "ground_truth", "resolved_annotation"),
              "accuracy", "f1_macro", "precision_macro", "recall_macro")


_COVERED = """
u AS (SELECT * FROM c WHERE ground_truth IS NOT NULL AND ground_truth <> -1),
conf AS (SELECT dataset, run_id, ground_truth AS gt, mode AS pred, count(*) AS n FROM u
         WHERE mode <> -1 AND NOT tied GROUP BY ALL)"""


@register("covered_metrics", with_votes("""
SELECT dataset, run_id, n_total, n_covered, round(accuracy, 9) AS accuracy, round(f1_macro, 9) AS f1_macro,
       round(precision_macro, 9) AS precision_macro, round(recall_macro, 9) AS recall_macro,
       round(n_covered / n_total::DOUBLE, 9) AS coverage
FROM (SELECT dataset, run_id, count(*) AS n_total, count(*) FILTER (WHERE mode <> -1 AND NOT tied) AS n_covered
      FROM u GROUP BY 1, 2)
LEFT JOIN (SELECT dataset, run_id, sum(tp) / sum(support) AS accuracy, avg(f1) AS f1_macro, avg(prec) AS precision_macro,
           avg(rec) AS recall_macro FROM cls GROUP BY 1, 2) USING (dataset, run_id)""",
    _COVERED, classes_sql("conf", "dataset, run_id")))
def covered(spark, sf_dir):
    return r9(Q.covered_metrics(majority(spark, sf_dir), ["dataset", "run_id"]),
              "accuracy", "f1_macro", "precision_macro", "recall_macro", "coverage")


@register("ensemble_gain", with_votes("""
SELECT best_model, round(best_accuracy, 9) AS best_accuracy, round(e, 9) AS ensemble_accuracy, round(e - best_accuracy, 9) AS delta
FROM (SELECT annotator AS best_model, avg((label = ground_truth)::int) AS best_accuracy FROM long
      WHERE ground_truth IS NOT NULL AND label <> -1 GROUP BY 1 ORDER BY 2 DESC, 1 DESC LIMIT 1),
     (SELECT avg((mode = ground_truth)::int) AS e FROM c WHERE ground_truth IS NOT NULL AND mode <> -1)"""))
def ensemble(spark, sf_dir):
    return r9(Q.ensemble_gain(majority(spark, sf_dir), VOTES), "best_accuracy", "ensemble_accuracy", "delta")
