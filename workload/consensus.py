"""Vote resolution queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from accordant.operators import agreement as A, consensus as C
from workload.base import (ANNOTATORS, VOTES, WEIGHTS, annotations, drawn_vote, register, repetitions, sql_digits, sql_vote,
                           table, with_draws, with_votes)


def _resolved(strategy):
    def run(spark, sf_dir):
        out = C.resolve(annotations(spark, sf_dir), VOTES, strategy=strategy,
                        params={"weights": WEIGHTS})
        return out.select(
            "doc_id", "text_id", "unique_annotations", "most_common_annotation",
            "most_common_count", "consensus_score", "consensus_level", "is_problematic",
            "resolved_annotation", "needs_review")
    return run


def _resolved_sql(rule: str, *ctes: str) -> str:
    return with_votes(f"""
SELECT doc_id, text_id, labels AS unique_annotations, mode AS most_common_annotation, top AS most_common_count,
       score AS consensus_score, lvl AS consensus_level, tied AS is_problematic,
       resolved AS resolved_annotation, resolved IS NULL AS needs_review
FROM (SELECT c.*, case when score >= 0.8 then mode else {rule} end AS resolved FROM c {'LEFT JOIN w USING (doc_id)' if ctes else ''})
""", *ctes)


_WEIGHTED = """
w AS (SELECT doc_id, label AS best FROM (
        SELECT doc_id, label, row_number() OVER (PARTITION BY doc_id ORDER BY sum(wt) DESC, min(seat)) AS rk
        FROM (SELECT *, case seat when 1 then 130 when 2 then 125 else 120 end AS wt FROM long)
        GROUP BY doc_id, label) WHERE rk = 1)"""

register("consensus_majority", _resolved_sql("mode"))(_resolved("majority_vote"))
register("consensus_weighted", _resolved_sql("best", _WEIGHTED))(_resolved("weighted_vote"))
register("consensus_unanimous", _resolved_sql("case when labels = 1 then mode end"))(_resolved("unanimous_only"))
register("consensus_remove_outliers", _resolved_sql(
    "(select case when count(*) = 1 then min(label) end from tally t where t.doc_id = c.doc_id and t.n / 3e0 >= 0.3)"
))(_resolved("remove_outliers"))
register("consensus_flag_review", _resolved_sql("cast(null as int)"))(_resolved("flag_for_review"))
register("consensus_threshold_only", _resolved_sql("cast(null as int)"))(_resolved(None))


def majority(spark, sf_dir):
    return C.resolve(annotations(spark, sf_dir), VOTES)


@register("consensus_votes_list", with_votes("""
SELECT doc_id, concat_ws(',', ann_a, ann_b, ann_c) AS votes FROM v"""))
def votes_list(spark, sf_dir):
    out = majority(spark, sf_dir)
    return out.select("doc_id", F.array_join(
        F.transform("all_annotations", lambda v: v.cast("string")), ",").alias("votes"))


@register("consensus_summary", with_votes("""
SELECT count(*) AS total_texts, round(avg(score), 9) AS consensus_mean, median(score) AS consensus_median,
       round(stddev_samp(score), 9) AS consensus_std,
       count(*) FILTER (WHERE lvl = 'high') AS high_consensus,
       count(*) FILTER (WHERE lvl = 'medium') AS medium_consensus,
       count(*) FILTER (WHERE lvl = 'low') AS low_consensus FROM c"""))
def summary(spark, sf_dir):
    return (C.summary(majority(spark, sf_dir))
            .withColumns({c: F.round(c, 9) for c in ("consensus_mean", "consensus_std")}))


@register("consensus_stats", with_votes("""
SELECT count(*) AS total,
  count(*) FILTER (WHERE lvl = 'high') AS high, avg((lvl = 'high')::int) AS high_share,
  count(*) FILTER (WHERE lvl = 'medium') AS medium, avg((lvl = 'medium')::int) AS medium_share,
  count(*) FILTER (WHERE lvl = 'low') AS low, avg((lvl = 'low')::int) AS low_share,
  count(*) FILTER (WHERE tied) AS problematic, avg(tied::int) AS problematic_share,
  count(*) FILTER (WHERE mode IS NULL) AS needs_review, avg((mode IS NULL)::int) AS needs_review_share
FROM c"""))
def stats(spark, sf_dir):
    return C.stats(majority(spark, sf_dir))


@register("consensus_levels", with_votes(
    "SELECT lvl AS consensus_level, count(*) AS n FROM c GROUP BY lvl"))
def levels(spark, sf_dir):
    return C.level_distribution(majority(spark, sf_dir))


@register("score_histogram", with_votes(
    "SELECT cast(least(floor(score * 20), 19) as int) AS bin, count(*) AS n FROM c GROUP BY 1"))
def histogram(spark, sf_dir):
    return C.score_histogram(majority(spark, sf_dir))


@register("agreement_pattern", with_votes("""
SELECT pattern, count(*) AS n FROM (
  SELECT doc_id, case when count(*) = 1 then '3x0' else string_agg(n::VARCHAR, 'x' ORDER BY n DESC) end AS pattern
  FROM tally GROUP BY doc_id) GROUP BY pattern"""))
def pattern(spark, sf_dir):
    return (C.agreement_pattern(annotations(spark, sf_dir), VOTES)
            .groupBy("pattern").agg(F.count(F.lit(1)).alias("n")))


@register("vote_entropy", with_votes("SELECT doc_id, round(entropy, 9) AS entropy FROM c"))
def entropy(spark, sf_dir):
    return C.vote_entropy(annotations(spark, sf_dir), VOTES).select(
        "doc_id", F.round("entropy", 9).alias("entropy"))


@register("problematic_cases", with_votes("""
SELECT c.doc_id, c.text_id, substr(c.text, 1, 100) AS text, score AS consensus_score, m.annotations,
       round(entropy, 9) AS entropy
FROM c JOIN (SELECT doc_id, string_agg(label || ':' || n, ',' ORDER BY label) AS annotations
             FROM tally GROUP BY doc_id) m USING (doc_id)
WHERE score < 0.6"""))
def problematic(spark, sf_dir):
    return (C.problematic_cases(annotations(spark, sf_dir), VOTES, as_text=True,
                                keep=("doc_id", "text_id"))
            .withColumn("entropy", F.round("entropy", 9)))


@register("confidence_split", with_votes("""
SELECT case when score >= 0.8 then 'high_confidence' else 'needs_review' end AS subset,
       count(*) AS n, count(*) FILTER (WHERE tied) AS ties FROM c GROUP BY 1"""))
def split(spark, sf_dir):
    return (C.confidence_split(majority(spark, sf_dir)).groupBy("subset")
            .agg(F.count(F.lit(1)).alias("n"), F.count_if("is_problematic").alias("ties")))


@register("consensus_universe", with_votes("""
SELECT doc_id, ground_truth, mode AS resolved_annotation, top AS most_common_count FROM c
WHERE ground_truth <> -1 AND mode <> -1 AND top >= 2"""))
def universe(spark, sf_dir):
    return C.consensus_universe(majority(spark, sf_dir)).select(
        "doc_id", "ground_truth", "resolved_annotation", "most_common_count")


@register("valid_for_evaluation", with_votes(
    "SELECT doc_id, mode AS resolved_annotation FROM c WHERE mode <> -1"))
def valid(spark, sf_dir):
    return C.valid_for_evaluation(majority(spark, sf_dir)).select("doc_id", "resolved_annotation")


@register("accuracy_by_level", with_votes("""
SELECT lvl AS consensus_level, count(*) AS n, count(*) FILTER (WHERE mode = ground_truth) AS hits,
       count(*) FILTER (WHERE mode = ground_truth) / count(*)::DOUBLE AS accuracy
FROM c WHERE ground_truth IS NOT NULL AND ground_truth <> -1 AND mode <> -1 GROUP BY lvl"""))
def accuracy_by_level(spark, sf_dir):
    scored = C.valid_for_evaluation(majority(spark, sf_dir)).filter("ground_truth <> -1")
    hits = F.count_if(F.col("resolved_annotation") == F.col("ground_truth"))
    return scored.groupBy("consensus_level").agg(
        F.count(F.lit(1)).alias("n"), hits.alias("hits"),
        (hits / F.count(F.lit(1))).alias("accuracy"))


_REPS = ",\n".join([f"""
reps AS ({' UNION ALL '.join(
    f"SELECT doc_id, '{m}' AS annotator, {r} AS rep, {sql_vote(f'{m}|{r}', lo, 'gt0', 4)} AS label, "
    f"{sql_digits(f'{m}|{r}', 13)} / 1024e0 AS elapsed_sec FROM d0"
    for m, lo in ANNOTATORS.items() for r in (1, 2, 3))})"""])


@register("repetition_consensus", with_votes("""
SELECT doc_id, annotator, label, n / 3e0 AS score, cast(3 as bigint) AS repetitions, elapsed_sec FROM (
  SELECT doc_id, annotator, label, count(*) AS n,
         sum(sum(elapsed_sec)) OVER (PARTITION BY doc_id, annotator) AS elapsed_sec,
         row_number() OVER (PARTITION BY doc_id, annotator ORDER BY count(*) DESC, min(rep)) AS rk
  FROM reps GROUP BY doc_id, annotator, label) WHERE rk = 1""", _REPS))
def repetition_consensus(spark, sf_dir):
    return C.repetition_consensus(repetitions(spark, sf_dir), keys=("doc_id", "annotator"))


@register("annotation_throughput", with_votes("""
SELECT annotator, count(*) AS calls, sum(elapsed_sec) AS total_sec, avg(elapsed_sec) AS avg_sec,
       count(*) / sum(elapsed_sec) AS calls_per_sec FROM reps GROUP BY annotator""", _REPS))
def throughput(spark, sf_dir):
    return C.throughput(repetitions(spark, sf_dir))


# --- the same questions over the order lines -------------------------------------------------

def line_votes(spark, sf_dir):
    """Votes keyed by order line, three classes from the return flag."""
    key = F.concat(F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"))
    lines = with_draws(table(spark, sf_dir, "lineitem"), list(ANNOTATORS), key)
    flag = F.col("l_returnflag")
    truth = F.when(flag == "A", 0).when(flag == "N", 1).otherwise(2).cast("int")
    seats = [drawn_vote(i, truth, lo, 3).alias(f"{m}_consensus") for i, (m, lo) in enumerate(ANNOTATORS.items())]
    return lines.select("l_orderkey", "l_linenumber", truth.alias("ground_truth"),
                        F.explode(F.array(F.struct(*seats))).alias("drawn")).select(
        "l_orderkey", "l_linenumber", "ground_truth", "drawn.*")


_KEY = "(l_orderkey || '-' || l_linenumber)"
_FLAG = "cast(case l_returnflag when 'A' then 0 when 'N' then 1 else 2 end as int)"
LINES = f"""WITH lv AS (SELECT {_FLAG} AS gt, {', '.join(f"{sql_vote(m, lo, _FLAG, 3, _KEY)} AS {m}" for m, lo in ANNOTATORS.items())} FROM lineitem),
lr AS (SELECT *, case when ann_a = ann_b or ann_a = ann_c then ann_a when ann_b = ann_c then ann_b else ann_a end AS mode,
              case when ann_a = ann_b and ann_b = ann_c then 3 when ann_a = ann_b or ann_a = ann_c or ann_b = ann_c then 2 else 1 end AS top FROM lv)"""


@register("line_consensus", LINES + """
SELECT case top when 3 then 'high' when 2 then 'medium' else 'low' end AS consensus_level, count(*) AS n,
       count(*) FILTER (WHERE mode = gt) AS hits, count(*) FILTER (WHERE mode = gt) / count(*)::DOUBLE AS accuracy
FROM lr WHERE mode <> -1 GROUP BY 1""")
def line_consensus(spark, sf_dir):
    scored = C.valid_for_evaluation(C.resolve(line_votes(spark, sf_dir), VOTES))
    hits = F.count_if(F.col("resolved_annotation") == F.col("ground_truth"))
    return scored.groupBy("consensus_level").agg(F.count(F.lit(1)).alias("n"), hits.alias("hits"),
                                                 (hits / F.count(F.lit(1))).alias("accuracy"))


@register("line_agreement", LINES + """,
ll AS (SELECT unnest([ann_a, ann_b, ann_c]) AS label FROM lv)
SELECT count(*) AS items, round(any_value(pb), 9) AS p_bar, round(any_value(pe), 9) AS p_e,
       round((any_value(pb) - any_value(pe)) / (1 - any_value(pe)), 9) AS fleiss_kappa
FROM lv, (SELECT avg((s - 3) / 6e0) AS pb FROM (SELECT list_sum([pow(len(list_filter([ann_a, ann_b, ann_c], lambda x: x = k)), 2) for k in [0, 1, 2]]) AS s FROM lv)),
     (SELECT sum(p * p) AS pe FROM (SELECT count(*) / (3e0 * (SELECT count(*) FROM lv)) AS p FROM ll WHERE label <> -1 GROUP BY label))""")
def line_agreement(spark, sf_dir):
    out = A.fleiss_kappa(line_votes(spark, sf_dir), VOTES, categories=[0, 1, 2]).drop("interpretation")
    return out.withColumns({c: F.round(c, 9) for c in ("p_bar", "p_e", "fleiss_kappa")})
