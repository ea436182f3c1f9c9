"""TF-IDF, instance selection and its audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from accordant.functions import confidence as K
from accordant.operators import audit as A, consensus as C, quality as Q, selection as S, weighting as W
from accordant.plans import jobs
from accordant.sources import artefacts
from accordant.sources.workspace import fresh_path, stored
from workload.agreement import r9
from workload.base import CONFS, annotations, digits, register, sql_digits, table, with_votes
from workload.consensus import majority
from workload.tables import UNIQ, deduped

STOP = ["the", "and", "of", "la", "le", "de", "der", "die", "und", "el", "en", "un"]
SQL_STOP = ", ".join(f"'{w}'" for w in STOP)

TERMS = f"""
tc AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term
        FROM documents) WHERE term NOT IN ({SQL_STOP}) GROUP BY ALL),
tdf AS (SELECT term, count(*) AS df FROM tc GROUP BY term HAVING count(*) >= 2),
raw AS (SELECT doc_id, term, tf, df, (1 + ln(tf::DOUBLE)) * (ln((1e0 + (SELECT count(*) FROM documents)) / (1e0 + df)) + 1) AS r
        FROM tc JOIN tdf USING (term))"""


@register("tfidf_weights", f"""WITH {TERMS}
SELECT doc_id, term, tf, df, round(r / sqrt(sum(r * r) OVER (PARTITION BY doc_id)), 8) AS weight FROM raw""")
def tfidf_weights(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return W.tfidf(docs, "doc_id", stop_words=STOP).select(
        "doc_id", "term", "tf", "df", F.round("weight", 8).alias("weight"))


@register("tfidf_vocabulary", f"""WITH {TERMS} SELECT term, df, sum(tf)::BIGINT AS occurrences FROM raw GROUP BY ALL""")
def tfidf_vocabulary(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counts = W.term_counts(docs, "doc_id", stop_words=STOP)
    return W.vocabulary(counts)


# Class probabilities drawn per row: the selection rules can then be checked to the row.
PROBS = f"""
pr0 AS (SELECT doc_id, ground_truth, {', '.join(f"({sql_digits(f'p{c}', 1)} + 1)::DOUBLE * (case when ground_truth = {c} then 3 else 1 end) AS w{c}" for c in range(4))}
        FROM v WHERE ground_truth IS NOT NULL),
prb AS (SELECT doc_id, ground_truth, w0 / (w0 + w1 + w2 + w3) AS p0, w1 / (w0 + w1 + w2 + w3) AS p1, w2 / (w0 + w1 + w2 + w3) AS p2,
               w3 / (w0 + w1 + w2 + w3) AS p3 FROM pr0),
prd AS (SELECT *, greatest(p0, p1, p2, p3) AS top, cast(case greatest(p0, p1, p2, p3) when p0 then 0 when p1 then 1 when p2 then 2 else 3 end as int) AS pred,
               -(p0 * ln(p0) + p1 * ln(p1) + p2 * ln(p2) + p3 * ln(p3)) AS h FROM prb),
inv AS (SELECT *, case when pred = ground_truth then top else 0e0 end AS a0, case when pred <> ground_truth then
          1 - (h - min(h) FILTER (WHERE pred <> ground_truth) OVER ()) / ((max(h) FILTER (WHERE pred <> ground_truth) OVER ())
               - (min(h) FILTER (WHERE pred <> ground_truth) OVER ())) else 0e0 end AS n0 FROM prd),
wts AS (SELECT *, a0 / sum(a0) OVER () AS alpha, n0 / sum(n0) OVER () AS noise FROM inv)"""


def drawn_probabilities(spark, sf_dir):
    key = F.col("doc_id").cast("string")
    rows = annotations(spark, sf_dir).filter("ground_truth is not null")
    raw = [(digits(f"p{c}", key, 1) + 1).cast("double") * F.when(F.col("ground_truth") == c, 3.0).otherwise(1.0)
           for c in range(4)]
    staged = rows.select("doc_id", F.col("ground_truth").alias("class_index"), F.explode(F.array(F.array(*raw))).alias("w"))
    total = F.col("w")[0] + F.col("w")[1] + F.col("w")[2] + F.col("w")[3]
    return staged.select("doc_id", "class_index", F.transform("w", lambda x: x / total).alias("probs"))


@register("selection_weights", with_votes("""
SELECT doc_id, pred, round(alpha, 12) AS alpha, round(noise, 12) AS noise FROM wts""", PROBS))
def selection_weights(spark, sf_dir):
    return S.removal_weights(drawn_probabilities(spark, sf_dir)).select(
        "doc_id", "pred", F.round("alpha", 12).alias("alpha"), F.round("noise", 12).alias("noise"))


def sql_u(seed: str) -> str:
    return f"((('0x' || substr(md5(doc_id::VARCHAR || '{seed}'), 1, 8))::BIGINT + 1) / 4294967296e0)"


@register("selection_removals", with_votes(f"""
SELECT doc_id, 'redundant' AS removal_reason FROM (SELECT doc_id, row_number() OVER (ORDER BY -ln({sql_u('42-redundant')}) / alpha, doc_id) AS rk FROM wts WHERE alpha > 0)
WHERE rk <= (SELECT least(floor(count(*) * 0.25), count(*) FILTER (WHERE alpha > 0)) FROM wts)
UNION ALL
SELECT doc_id, 'noise' FROM (SELECT doc_id, row_number() OVER (ORDER BY -ln({sql_u('42-noise')}) / noise, doc_id) AS rk FROM wts WHERE noise > 0)
WHERE rk <= (SELECT least(floor(count(*) FILTER (WHERE pred <> ground_truth) * 0.5), count(*) FILTER (WHERE noise > 0)) FROM wts)""", PROBS))
def selection_removals(spark, sf_dir):
    return S.mark_removals(S.removal_weights(drawn_probabilities(spark, sf_dir)), "doc_id")


@register("weighted_sample", with_votes(f"""
SELECT doc_id FROM v ORDER BY -ln({sql_u('9')}) / ann_a_conf, doc_id LIMIT 250"""))
def weighted_sample(spark, sf_dir):
    limit = spark.range(1).select(F.lit(250).cast("bigint").alias("k"))
    rows = annotations(spark, sf_dir).select("doc_id", CONFS[0])
    return S.weighted_sample(rows, CONFS[0], "doc_id", limit, 9).select("doc_id")


@register("exclude_unlabeled", with_votes("""
SELECT doc_id, mode IS NULL OR mode = -1 AS is_excluded FROM c"""))
def exclude_unlabeled(spark, sf_dir):
    return S.mark_unlabeled(majority(spark, sf_dir)).select("doc_id", "is_excluded")


@register("bio_is")
def bio_is(spark, sf_dir):
    """Reduction, removals and weak-classifier scores over the deduplicated table."""
    rows = deduped(spark, sf_dir).select("text_id", "text", "resolved_annotation", "consensus_level", "ground_truth")
    selected, report = S.filter_annotations(rows)
    path = fresh_path(spark, "selection")
    artefacts.write_selection(selected, report, path)
    return spark.read.json(f"{path}/report")


@register("selection_job_totals", with_votes("""
SELECT count(*) AS total_instances, count(*) FILTER (WHERE mode <> -1) AS labeled_instances, count(*) FILTER (WHERE mode = -1) AS excluded_instances,
       cast(floor(0.25 * count(*) FILTER (WHERE mode <> -1)) AS bigint) AS removed_redundant, true AS reused FROM uniq""", UNIQ))
def selection_job_totals(spark, sf_dir):
    """A stored selection: the counts its rules fix, and that a second call reuses the stored rows."""
    rows = stored(deduped(spark, sf_dir).select("text_id", "text", "resolved_annotation", "consensus_level", "ground_truth"), "unique")
    path = fresh_path(spark, "selection")
    done = jobs.selection_job(rows, path)
    again = jobs.selection_job(rows, path)
    what = F.col("selection")
    counts = done.agg(
        F.count(F.lit(1)).alias("total_instances"), F.count_if(what != "excluded").alias("labeled_instances"),
        F.count_if(what == "excluded").alias("excluded_instances"), F.count_if(F.col("removal_reason") == "redundant").alias("removed_redundant"))
    return counts.withColumn("reused", F.lit(sorted(done.inputFiles()) == sorted(again.inputFiles())))


# Outcome of a selection by hash digits, so that the audit can be checked row by row.
MARK = f"""
mk AS (SELECT c.*, case when roll < 16384 then 'redundant' when roll < 24576 then 'noise' end AS reason,
              case when mode = -1 then 'excluded' when roll < 24576 then 'removed' else 'kept' end AS selection,
              (ann_a_conf + ann_b_conf + ann_c_conf) / 3 AS conf
       FROM (SELECT *, {sql_digits('mark', 1)} AS roll FROM c) c),
jd AS (SELECT *, coalesce(mode = ground_truth, false) AS ok FROM mk WHERE selection <> 'excluded' AND lvl <> 'low')"""


def judged(spark, sf_dir):
    roll = digits("mark", F.col("doc_id").cast("string"), 1)
    rows = majority(spark, sf_dir).withColumns({
        "removal_reason": F.when(roll < 16384, "redundant").when(roll < 24576, "noise"),
        "selection": F.when(F.col("resolved_annotation") == -1, "excluded").when(roll < 24576, "removed").otherwise("kept"),
        "mean_confidence": K.mean_confidence(CONFS)})
    return A.judged(rows)


@register("filter_overview", with_votes("""
SELECT dataset, count(*) AS total, count(*) FILTER (WHERE selection = 'kept') AS kept, count(*) FILTER (WHERE selection = 'removed') AS removed,
       count(*) FILTER (WHERE reason = 'redundant') AS removed_redundant, count(*) FILTER (WHERE reason = 'noise') AS removed_noise,
       round(avg((selection = 'removed')::int), 9) AS reduction_rate FROM jd GROUP BY 1""", MARK))
def overview(spark, sf_dir):
    return r9(A.overview(judged(spark, sf_dir)), "reduction_rate")


@register("removed_correctness", with_votes("""
SELECT dataset, count(*) AS n, count(*) FILTER (WHERE ok) AS correct, count(*) FILTER (WHERE NOT ok) AS wrong,
       round(100 * avg(ok::int), 9) AS pct_correct, round(100 * avg((NOT ok)::int), 9) AS pct_wrong
FROM jd WHERE selection = 'removed' GROUP BY 1""", MARK))
def removed_correctness(spark, sf_dir):
    return r9(A.removed_correctness(judged(spark, sf_dir)), "pct_correct", "pct_wrong")


@register("removed_by_level", with_votes("""
SELECT dataset, count(*) FILTER (WHERE lvl = 'high') AS high, count(*) FILTER (WHERE lvl = 'medium') AS medium,
       round(100 * avg((lvl = 'high')::int), 9) AS pct_high, round(100 * avg((lvl = 'medium')::int), 9) AS pct_medium
FROM jd WHERE selection = 'removed' GROUP BY 1""", MARK))
def removed_by_level(spark, sf_dir):
    return r9(A.removed_by_level(judged(spark, sf_dir)), "pct_high", "pct_medium")


@register("error_by_level", with_votes("""
SELECT dataset, lvl AS consensus_level, count(*) AS n, round(100 * avg((NOT ok)::int), 9) AS pct_error
FROM jd WHERE selection = 'removed' GROUP BY 1, 2""", MARK))
def error_by_level(spark, sf_dir):
    return r9(A.removed_error_rate(judged(spark, sf_dir), "consensus_level"), "pct_error")


@register("error_by_reason", with_votes("""
SELECT dataset, reason AS removal_reason, count(*) AS n, round(100 * avg((NOT ok)::int), 9) AS pct_error
FROM jd WHERE selection = 'removed' GROUP BY 1, 2""", MARK))
def error_by_reason(spark, sf_dir):
    return r9(A.removed_error_rate(judged(spark, sf_dir), "removal_reason"), "pct_error")


@register("error_recall", with_votes("""
SELECT dataset, round(ar, 9) AS acc_removed, round(ak, 9) AS acc_kept, round(100 * (1 - ar), 9) AS pct_error_removed,
       round(100 * (1 - ak), 9) AS pct_error_kept, round(100 * er / nullif(errors, 0)::DOUBLE, 9) AS error_recall, errors
FROM (SELECT dataset, avg(ok::int) FILTER (WHERE selection = 'removed') AS ar, avg(ok::int) FILTER (WHERE selection = 'kept') AS ak,
             count(*) FILTER (WHERE NOT ok AND selection = 'removed') AS er, count(*) FILTER (WHERE NOT ok) AS errors FROM jd GROUP BY 1)""", MARK))
def error_recall(spark, sf_dir):
    return r9(A.filter_quality(judged(spark, sf_dir)), "acc_removed", "acc_kept", "pct_error_removed", "pct_error_kept", "error_recall")


@register("class_removal_rate", with_votes("""
SELECT dataset, ground_truth AS class, count(*) AS n, count(*) FILTER (WHERE selection = 'removed') AS removed,
       round(100 * avg((selection = 'removed')::int), 9) AS pct_removed, round(100 * any_value(m), 9) AS mean_pct
FROM (SELECT *, avg((selection = 'removed')::int) OVER (PARTITION BY dataset) AS m FROM jd) GROUP BY 1, 2""", MARK))
def class_removal(spark, sf_dir):
    return r9(A.class_removal(judged(spark, sf_dir)), "pct_removed", "mean_pct")


@register("status_profile", with_votes("""
SELECT dataset, median(text_len) FILTER (WHERE selection = 'removed') AS median_len_removed,
       median(text_len) FILTER (WHERE selection = 'kept') AS median_len_kept,
       round(avg(conf) FILTER (WHERE selection = 'removed'), 9) AS mean_conf_removed,
       round(avg(conf) FILTER (WHERE selection = 'kept'), 9) AS mean_conf_kept FROM jd GROUP BY 1""", MARK))
def status_profile(spark, sf_dir):
    return r9(A.status_profile(judged(spark, sf_dir)), "mean_conf_removed", "mean_conf_kept")


@register("audit_synthesis", with_votes("""
SELECT dataset, removed, round(pct_reduction, 8) AS pct_reduction, round(100 * ok_r, 8) AS pct_correct, round(100 * (1 - ok_r), 8) AS pct_wrong,
       round(100 * high_r, 8) AS pct_high, round(100 * (1 - ok_r), 8) AS pct_error_removed, round(100 * (1 - ok_k), 8) AS pct_error_kept,
       round(100 * er / nullif(errors, 0)::DOUBLE, 8) AS error_recall
FROM (SELECT dataset, count(*) FILTER (WHERE selection = 'removed') AS removed, 100 * avg((selection = 'removed')::int) AS pct_reduction,
             avg(ok::int) FILTER (WHERE selection = 'removed') AS ok_r, avg(ok::int) FILTER (WHERE selection = 'kept') AS ok_k,
             avg((lvl = 'high')::int) FILTER (WHERE selection = 'removed') AS high_r,
             count(*) FILTER (WHERE NOT ok AND selection = 'removed') AS er, count(*) FILTER (WHERE NOT ok) AS errors FROM jd GROUP BY 1)""", MARK))
def synthesis(spark, sf_dir):
    out = A.synthesis(judged(spark, sf_dir))
    return out.withColumns({c: F.round(c, 8) for c in out.columns if c.startswith("pct_") or c == "error_recall"})


@register("kept_removed_union", with_votes("""
SELECT selection, count(*) AS n, count(reason) AS with_reason FROM mk WHERE selection <> 'excluded' GROUP BY 1""", MARK))
def kept_removed_union(spark, sf_dir):
    roll = digits("mark", F.col("doc_id").cast("string"), 1)
    rows = C.valid_for_evaluation(majority(spark, sf_dir)).withColumn("roll", roll)
    reason = F.when(roll < 16384, "redundant").otherwise("noise")
    both = A.combine(rows.filter("roll >= 24576"), rows.filter("roll < 24576").withColumn("removal_reason", reason))
    return both.groupBy("selection").agg(F.count(F.lit(1)).alias("n"), F.count("removal_reason").alias("with_reason"))
