"""Annotation runs, streaming, training sets and whole jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from accordant.functions import text as T
from accordant.operators import align as J, annotate as N, consensus as C, training as TR
from accordant.plans import jobs
from accordant.sources.versions import Version
from accordant.sources.workspace import fresh_path, stored
from accordant.streaming import incremental, late_votes
from workload.agreement import BAND, r9
from workload.base import ANNOTATORS, CATEGORIES, DESCRIPTIONS, VOTES, annotations, language_label, register, sql_strip, table, with_votes
from workload.consensus import majority
from workload.tables import CV, DESC, FOLDS, UNIQ, cv_folds, deduped

MODELS = ["m1", "m2"]


#: Words that mark a language, by label (DESCRIPTIONS); a model leaves out one of each per repetition.
MARKERS = [("und", "die", "der"), ("the", "and", "of"), ("que", "el", "los"), ("le", "les", "des")]


def left_out(model: str, rep: int) -> int:
    return (rep + MODELS.index(model)) % 3


def marker_annotator():
    """Names the language of a prompt by its marker words, with add-one shares as confidence."""
    def annotate(frame):
        import math

        import pandas as pd

        skip = [left_out(m, r) for m, r in zip(frame["model"], frame["rep"])]
        counts = pd.DataFrame(index=frame.index)
        for label, words in enumerate(MARKERS):
            found = [frame["prompt"].str.count(f" {w} ") for w in words]
            counts[label] = sum(n.where([k != i for k in skip], 0) for i, n in enumerate(found))
        labels, most, total = counts.idxmax(axis=1), counts.max(axis=1), counts.sum(axis=1)
        return pd.DataFrame({
            "content": [f"CLASSIFICATION: {v}" for v in labels],
            "logprobs": [[{"token": str(v), "logprob": math.log((1 + m) / (4 + n))}] for v, m, n in zip(labels, most, total)]})

    return annotate


def prompts_of(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.withColumns({"text_id": T.text_id("text"), "prompt": F.col("text")})


def _times(prompt: str, word: str) -> str:
    return f"((length({prompt}) - length(replace({prompt}, ' {word} ', ''))) // {len(word) + 2})"


def rule_sql(prompt: str, model: str, rep: int) -> tuple[str, str]:
    """SQL for the annotator's label and confidence."""
    c = ["(" + " + ".join(_times(prompt, w) for i, w in enumerate(words) if i != left_out(model, rep)) + ")" for words in MARKERS]
    label = f"list_position([{', '.join(c)}], greatest({', '.join(c)})) - 1"
    return f"cast({label} AS int)", f"(1 + greatest({', '.join(c)})) / (4e0 + {' + '.join(c)})"


CALLS = "calls AS (" + " UNION ALL ".join(
    f"SELECT doc_id, '{m}' AS model, {r} AS rep, {rule_sql('text', m, r)[0]} AS label, {rule_sql('text', m, r)[1]} AS conf FROM documents"
    for m in MODELS for r in range(3)) + ")"


@register("annotate_job", f"""WITH {CALLS}
SELECT doc_id, model AS annotator, cast(rep as int) AS rep, label, round(conf, 9) AS confidence FROM calls""")
def annotate_job(spark, sf_dir):
    reqs = N.requests(prompts_of(spark, sf_dir), MODELS, 3, keep=("doc_id", "text_id"))
    cache = fresh_path(spark, "responses")
    answered = N.call_with_cache(reqs, marker_annotator(), cache)
    return N.parse(answered, CATEGORIES).select("doc_id", "annotator", "rep", "label", F.round("confidence", 9).alias("confidence"))


@register("cached_calls", """
SELECT count(*) AS requests, count(DISTINCT cache_key) AS calls FROM (
  SELECT md5(model || '|' || text || '|{"rep": ' || rep || '}') AS cache_key
  FROM documents, (SELECT unnest(['m1', 'm2']) AS model), (SELECT unnest([0, 1, 2]) AS rep))""")
def cached_calls(spark, sf_dir):
    """Requests against responses stored: the second run adds no call."""
    docs = prompts_of(spark, sf_dir)
    cache = fresh_path(spark, "responses")
    N.call_with_cache(N.requests(docs, MODELS, 2, keep=("doc_id",)), marker_annotator(), cache)
    both = N.call_with_cache(N.requests(docs, MODELS, 3, keep=("doc_id",)), marker_annotator(), cache)
    # A job that chose the same keys at the same time: the cache still answers each key once.
    store = N.response_store(spark, cache)
    store.append(store.write(store.rows().limit(50)), Version())
    again = N.call_with_cache(N.requests(docs, MODELS, 3, keep=("doc_id",)), marker_annotator(), cache)
    stored_calls = N.read_cache(spark, cache).agg(F.count(F.lit(1)))
    both = both.unionByName(again).groupBy("cache_key", "doc_id", "rep", "annotator").agg(F.max("content").alias("content"), F.count(F.lit(1)).alias("n")).filter("n = 2")
    return both.filter(F.col("content").isNotNull()).agg(F.count(F.lit(1)).alias("requests")).withColumn(
        "calls", stored_calls.scalar())


@register("cache_statistics", """
WITH k AS (SELECT md5(model || '|' || text || '|{"rep": ' || rep || '}') AS cache_key, rep
           FROM documents, (SELECT unnest(['m1', 'm2']) AS model), (SELECT unnest([0, 1, 2]) AS rep))
SELECT count(*) AS requests, count(DISTINCT cache_key) AS keys, count(*) FILTER (WHERE rep < 2) AS hits, count(*) FILTER (WHERE rep = 2) AS misses,
       count(DISTINCT cache_key) FILTER (WHERE rep < 2) AS stored FROM k""")
def cache_statistics(spark, sf_dir):
    """What a run of three repetitions would find after one of two."""
    docs = prompts_of(spark, sf_dir)
    cache = fresh_path(spark, "responses")
    N.call_with_cache(N.requests(docs, MODELS, 2, keep=("doc_id",)), marker_annotator(), cache)
    return N.cache_statistics(N.requests(docs, MODELS, 3, keep=("doc_id",)), cache)


@register("annotation_wide", f"""WITH {CALLS},
one AS (SELECT doc_id, model, label, count(*) AS n, row_number() OVER (PARTITION BY doc_id, model ORDER BY count(*) DESC, min(rep)) AS rk
        FROM calls GROUP BY doc_id, model, label)
SELECT doc_id, max(label) FILTER (WHERE model = 'm1' AND rep = 0) AS m1_rep1, max(label) FILTER (WHERE model = 'm2' AND rep = 2) AS m2_rep3,
       round(max(conf) FILTER (WHERE model = 'm1' AND rep = 1), 9) AS m1_rep2_conf,
       (SELECT label FROM one WHERE one.doc_id = calls.doc_id AND model = 'm1' AND rk = 1) AS m1_consensus,
       (SELECT n / 3e0 FROM one WHERE one.doc_id = calls.doc_id AND model = 'm2' AND rk = 1) AS m2_consensus_score
FROM calls GROUP BY doc_id""")
def annotation_wide(spark, sf_dir):
    reqs = N.requests(prompts_of(spark, sf_dir), MODELS, 3, keep=("doc_id", "text_id"))
    answered = N.call_with_cache(reqs, marker_annotator(), fresh_path(spark, "responses"))
    wide = N.to_wide(N.parse(answered, CATEGORIES), MODELS, 3, "doc_id")
    return wide.select("doc_id", "m1_rep1", "m2_rep3", F.round("m1_rep2_conf", 9).alias("m1_rep2_conf"),
                       "m1_consensus", "m2_consensus_score")


@register("model_variants", """
SELECT doc_id, annotator FROM documents, (SELECT unnest(['m1', 'm1_alt1', 'm1_alt2', 'm2']) AS annotator)""")
def model_variants(spark, sf_dir):
    configs = {"m1": {"default_params": {"temperature": 0}, "alternative_params": [{"temperature": 0.5}, {"temperature": 1.0}]}}
    pairs = N.expand_variants(MODELS, configs)
    return N.requests(prompts_of(spark, sf_dir), pairs, 1, keep=("doc_id",)).select("doc_id", "annotator")


@register("stream_resume", f"""
SELECT text_id, {rule_sql('text', 'm1', 0)[0]} AS label FROM (
  SELECT text, md5({sql_strip('text')}) AS text_id, row_number() OVER (PARTITION BY md5({sql_strip('text')}) ORDER BY doc_id % 2, doc_id) AS rk FROM documents) WHERE rk = 1""")
def stream_resume(spark, sf_dir):
    """Annotate half of the documents, then all of them: the second run does only the rest."""
    source, sink, state = (fresh_path(spark, n) for n in ("incoming", "annotated", "progress"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    shape = "doc_id bigint, text string"

    def annotate(batch):
        reqs = N.requests(batch.withColumn("prompt", F.col("text")), ["m1"], 1)
        answers = reqs.drop("prompt", "text").join(N.call(reqs, marker_annotator()), "cache_key")
        return N.parse(answers, CATEGORIES).select("text_id", "label")

    def run():
        texts = spark.readStream.schema(shape).parquet(source).withColumn("text_id", T.text_id("text"))
        incremental.run_available(incremental.annotate_stream(texts, annotate, sink, state, order="doc_id"))

    docs.filter(F.col("doc_id") % 2 == 0).write.mode("append").parquet(source)
    run()
    docs.write.mode("append").parquet(source)
    run()
    return spark.read.parquet(sink).select("text_id", "label")


@register("stream_level_counts", with_votes("SELECT lvl AS consensus_level, count(*) AS n FROM c GROUP BY lvl"))
def stream_level_counts(spark, sf_dir):
    """Running counts over an annotation table that arrives in two parts."""
    source, out, state = (fresh_path(spark, n) for n in ("votes", "levels", "progress"))
    votes = annotations(spark, sf_dir).select("doc_id", *VOTES)
    shape = votes.schema

    def run():
        live = C.resolve(spark.readStream.schema(shape).parquet(source), VOTES)
        incremental.run_available(incremental.write_level_counts(live, out, state))

    votes.filter(F.col("doc_id") % 2 == 0).write.mode("append").parquet(source)
    run()
    votes.filter(F.col("doc_id") % 2 == 1).write.mode("append").parquet(source)
    run()
    return spark.read.parquet(out)


@register("stream_late_votes", with_votes("""
SELECT doc_id::VARCHAR AS text_id, label, round(n / total::DOUBLE, 9) AS score, total::BIGINT AS repetitions FROM (
  SELECT doc_id, label, n, sum(n) OVER (PARTITION BY doc_id) AS total, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS rk
  FROM (SELECT doc_id, label, count(*) AS n, min(seat) AS first FROM long GROUP BY doc_id, label)) WHERE rk = 1"""))
def stream_late_votes(spark, sf_dir):
    """The votes of a text arrive apart and in any order; what stands in the end is the consensus of all of them."""
    seats = F.array(*[F.struct(F.lit(i + 1).alias("rep"), F.col(v).alias("label")) for i, v in enumerate(VOTES)])
    votes = annotations(spark, sf_dir).select(F.col("doc_id").cast("string").alias("text_id"), F.explode(seats).alias("v")).select("text_id", "v.*")
    source, path, state = (fresh_path(spark, n) for n in ("votes", "tallies", "progress"))
    turn = F.pmod(F.xxhash64("text_id", "rep"), F.lit(3))
    for k in range(3):
        votes.filter((turn == k) & F.col("label").isNotNull()).write.mode("append").parquet(source)
        live = spark.readStream.schema("text_id string, rep int, label int").parquet(source)
        incremental.run_available(late_votes.consensus_stream(live, path, state, merge_after=3))
    out = late_votes.current_consensus(spark, path)
    return out.select("text_id", "label", F.round("score", 9).alias("score"), "repetitions")


@register("stream_late_levels", with_votes("""
SELECT case when s >= 0.8 then 'high' when s >= 0.6 then 'medium' else 'low' end AS consensus_level, count(*) AS n FROM (
  SELECT doc_id, max(n) / sum(n)::DOUBLE AS s FROM (SELECT doc_id, label, count(*) AS n FROM long GROUP BY doc_id, label) GROUP BY doc_id) GROUP BY 1"""))
def stream_late_levels(spark, sf_dir):
    """Running counts per level, with every change of a text's level taken back from the old one."""
    seats = F.array(*[F.struct(F.lit(i + 1).alias("rep"), F.col(v).alias("label")) for i, v in enumerate(VOTES)])
    votes = annotations(spark, sf_dir).select(F.col("doc_id").cast("string").alias("text_id"), F.explode(seats).alias("v")).select("text_id", "v.*")
    source, path, state = (fresh_path(spark, n) for n in ("votes", "tallies", "progress"))
    for seat in (3, 1, 2):
        votes.filter((F.col("rep") == seat) & F.col("label").isNotNull()).write.mode("append").parquet(source)
        live = spark.readStream.schema("text_id string, rep int, label int").parquet(source)
        incremental.run_available(late_votes.consensus_stream(live, path, state))
    return late_votes.current_levels(spark, path)


# --- training sets ---------------------------------------------------------------------------

def _selected(rows):
    return rows.filter("consensus_level = 'high'").select("text")


@register("training_set_aggregated", with_votes(f"""
SELECT text_id, label, {DESC} AS label_description, count(*) AS n FROM (SELECT text_id, mode AS label, text FROM uniq)
WHERE label <> -1 AND text_id NOT IN (SELECT text_id FROM c WHERE score < 0.6)
  AND text_id IN (SELECT text_id FROM uniq WHERE lvl <> 'low') GROUP BY ALL""", UNIQ))
def training_set(spark, sf_dir):
    rows = deduped(spark, sf_dir)
    bad = C.problematic_cases(annotations(spark, sf_dir), VOTES)
    out = TR.aggregated_set(rows, meanings=DESCRIPTIONS, problematic=bad,
                            selected=rows.filter("consensus_level <> 'low'").select("text"))
    return out.groupBy("text_id", "label", "label_description").agg(F.count(F.lit(1)).alias("n"))


@register("training_set_perspectives", with_votes("""
SELECT text_id, label, annotator AS llm, count(*) AS n FROM long JOIN d0 USING (doc_id) WHERE label <> -1
  AND text_id NOT IN (SELECT text_id FROM c WHERE score < 0.6) AND text_id IN (SELECT text_id FROM c WHERE lvl = 'high') GROUP BY ALL"""))
def training_set_perspectives(spark, sf_dir):
    rows = majority(spark, sf_dir)
    bad = C.problematic_cases(annotations(spark, sf_dir), VOTES)
    out = TR.perspective_set(annotations(spark, sf_dir), problematic=bad, selected=_selected(rows))
    return out.groupBy("text_id", "label", "llm").agg(F.count(F.lit(1)).alias("n"))


@register("training_folds", with_votes("""
SELECT fold, 'train' AS split, label, count(*) AS n FROM tr WHERE label <> -1 GROUP BY ALL
UNION ALL SELECT fold, 'val', label, count(*) FROM cv WHERE split = 'val' AND NOT EXISTS
  (SELECT 1 FROM tr WHERE tr.fold = cv.fold AND tr.text_id = cv.text_id AND tr.label <> -1) GROUP BY ALL""", FOLDS, UNIQ, CV))
def training_folds(spark, sf_dir):
    annotated = TR.aggregated_set(deduped(spark, sf_dir))
    out = jobs.training_job(cv_folds(spark, sf_dir), annotated)
    return out.groupBy("fold", "split", "label").agg(F.count(F.lit(1)).alias("n"))


@register("training_folds_per_annotator", with_votes("""
SELECT fold, split, count(*) AS n, count(DISTINCT text_id) AS texts FROM (
  SELECT t.fold, 'train' AS split, text_id FROM long JOIN d0 USING (doc_id) JOIN (SELECT DISTINCT fold, text_id FROM cv WHERE split = 'train') t USING (text_id) WHERE long.label <> -1
  UNION ALL SELECT fold, 'val', text_id FROM cv WHERE split = 'val' AND NOT EXISTS
    (SELECT 1 FROM (SELECT DISTINCT fold, text_id FROM cv WHERE split = 'train') t WHERE t.fold = cv.fold AND t.text_id = cv.text_id
     AND t.text_id IN (SELECT text_id FROM long JOIN d0 USING (doc_id) WHERE long.label <> -1))) GROUP BY ALL""", FOLDS, UNIQ, CV))
def training_folds_per_annotator(spark, sf_dir):
    """Every annotator's vote is a training row, so ids repeat."""
    votes = TR.perspective_set(annotations(spark, sf_dir))
    out = jobs.training_job(cv_folds(spark, sf_dir), votes, per_annotator=True)
    return out.groupBy("fold", "split").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("text_id").alias("texts"))


def aligned_texts(spark, sf_dir, folds):
    """Aligned folds, each text fetched once at the end."""
    unique = deduped(spark, sf_dir)
    return jobs.training_job(folds, TR.aggregated_set(unique)).join(unique.select("text_id", "text"), "text_id")


@register("cv_eval")
def cv_eval(spark, sf_dir):
    """Folds trained on annotated labels and scored on true ones, with mean and deviation."""
    unique = stored(deduped(spark, sf_dir).select("text_id", "text", "resolved_annotation"), "unique")
    rows = stored(jobs.training_job(cv_folds(spark, sf_dir), TR.aggregated_set(unique)), "aligned", ["fold"])
    return TR.cv_summary(TR.cross_validate(rows, CATEGORIES, texts=TR.prepare(unique.select("text_id", "text"))))


#: Metrics of a constant prediction: its own class has precision and recall, all others have none.
_CONSTANT = """
hits AS (SELECT fold, label, count(*) AS n FROM (SELECT DISTINCT fold, doc_id, text_id, label FROM cv WHERE split = 'val' AND NOT EXISTS
           (SELECT 1 FROM tr WHERE tr.fold = cv.fold AND tr.text_id = cv.text_id AND tr.label <> -1)) WHERE label BETWEEN 0 AND 3 GROUP BY ALL),
best AS (SELECT fold, label AS pred FROM (SELECT fold, label, row_number() OVER (PARTITION BY fold ORDER BY count(*) DESC, label) AS rk
         FROM tr WHERE label BETWEEN 0 AND 3 GROUP BY fold, label) WHERE rk = 1),
folded AS (SELECT fold, sum(n)::BIGINT AS n, coalesce(sum(n) FILTER (WHERE label = pred), 0) / sum(n) AS acc, max((label = pred)::INT) AS seen,
                  count(*) + 1 - max((label = pred)::INT) AS k FROM hits JOIN best USING (fold) GROUP BY fold)"""


@register("cv_majority", with_votes("""
SELECT fold, n, round(acc, 9) AS accuracy, round(2 * acc / (1 + acc) / k, 9) AS f1_macro, round(acc / k, 9) AS precision_macro, round(seen / k::DOUBLE, 9) AS recall_macro
FROM folded""", FOLDS, UNIQ, CV, _CONSTANT))
def cv_majority(spark, sf_dir):
    """The baseline of the folds: an estimator of the user's own, trained on annotated and scored on true labels."""
    rows = stored(aligned_texts(spark, sf_dir, cv_folds(spark, sf_dir)), "aligned", ["fold"])
    return r9(TR.cross_validate(rows, CATEGORIES, TR.MajorityLabel), "accuracy", "f1_macro", "precision_macro", "recall_macro")


@register("cv_majority_summary", with_votes("""
SELECT metric, round(avg(v), 9) AS mean, round(stddev_pop(v), 9) AS std, count(*) AS folds FROM (
  SELECT 'accuracy' AS metric, acc AS v FROM folded UNION ALL SELECT 'f1_macro', 2 * acc / (1 + acc) / k FROM folded
  UNION ALL SELECT 'precision_macro', acc / k FROM folded UNION ALL SELECT 'recall_macro', seen / k::DOUBLE FROM folded) GROUP BY metric""", FOLDS, UNIQ, CV, _CONSTANT))
def cv_majority_summary(spark, sf_dir):
    rows = stored(aligned_texts(spark, sf_dir, cv_folds(spark, sf_dir)), "aligned", ["fold"])
    return r9(TR.cv_summary(TR.cross_validate(rows, CATEGORIES, TR.MajorityLabel)), "mean", "std")


@register("cv_compare_sources")
def cv_compare(spark, sf_dir):
    """The same folds trained on true and on consensus labels."""
    unique = stored(deduped(spark, sf_dir).select("text_id", "text", "resolved_annotation"), "unique")
    folds = stored(cv_folds(spark, sf_dir), "folds")
    consensus = stored(jobs.training_job(folds, TR.aggregated_set(unique)), "aligned", ["fold"])
    truth = folds.filter("split = 'train'").select("fold", "text_id", F.col("label").alias("true")).groupBy(
        "fold", "text_id").agg(F.min("true").alias("true"))
    gold = stored(consensus.join(truth, ["fold", "text_id"], "left").withColumn(
        "label", F.when(F.col("split") == "train", F.coalesce("true", "label")).otherwise(F.col("label"))).drop("true"), "gold", ["fold"])
    texts = TR.prepare(unique.select("text_id", "text"))
    return TR.compare_label_sources(TR.cross_validate(gold, CATEGORIES, texts=texts),
                                    TR.cross_validate(consensus, CATEGORIES, texts=texts), "documents")


# --- whole jobs ------------------------------------------------------------------------------

@register("consensus_job_summary", with_votes("""
SELECT count(*) AS total_texts, round(avg(top / 3e0), 9) AS consensus_mean, count(*) FILTER (WHERE lvl = 'high') AS high_consensus,
       round((p_bar - p_e) / (1 - p_e), 9) AS fleiss_kappa, 7::BIGINT AS report_rows
FROM uniq, (SELECT avg((sq - 3) / 6e0) AS p_bar FROM (SELECT u.doc_id, coalesce(sum(n * n) FILTER (WHERE label <> -1), 0) AS sq
            FROM uniq u LEFT JOIN tally USING (doc_id) GROUP BY u.doc_id)),
     (SELECT sum(s * s) AS p_e FROM (SELECT count(*) / (3e0 * (SELECT count(*) FROM uniq)) AS s
            FROM long WHERE label <> -1 AND doc_id IN (SELECT doc_id FROM uniq) GROUP BY label))
GROUP BY p_bar, p_e""", UNIQ))
def consensus_job_summary(spark, sf_dir):
    report = jobs.consensus_job(annotations(spark, sf_dir), dataset="documents", order="doc_id",
                                categories=CATEGORIES, output=fresh_path(spark, "experiment"))
    s = report.summary
    return s.select(
        F.col("dataset.total_texts").alias("total_texts"), F.round("results.consensus_mean", 9).alias("consensus_mean"),
        F.col("results.high_consensus").alias("high_consensus"), F.round("metrics.fleiss_kappa", 9).alias("fleiss_kappa"),
        F.size("validation.classification_report").cast("bigint").alias("report_rows"))


@register("experiment_summary_fields", with_votes(f"""
SELECT 'documents' AS name, count(*) AS total_texts, '0,1,2,3' AS categories, true AS has_ground_truth, 'ann_a,ann_b,ann_c' AS models, 3 AS total_models,
       0.8::DOUBLE AS threshold, 'majority_vote' AS strategy, round(avg(score), 9) AS consensus_mean, round(median(score), 9) AS consensus_median,
       count(*) FILTER (WHERE lvl = 'high') AS high, count(*) FILTER (WHERE lvl = 'medium') AS medium, count(*) FILTER (WHERE lvl = 'low') AS low,
       round(any_value(kappa), 9) AS fleiss_kappa, {BAND.format('any_value(kappa)')} AS interpretation,
       round(avg((mode = ground_truth)::INT) FILTER (WHERE ground_truth <> -1 AND mode <> -1), 9) AS accuracy,
       count(*) FILTER (WHERE ground_truth <> -1 AND mode <> -1) AS support
FROM uniq, (SELECT (p_bar - p_e) / (1 - p_e) AS kappa FROM
     (SELECT avg((sq - 3) / 6e0) AS p_bar FROM (SELECT u.doc_id, coalesce(sum(n * n) FILTER (WHERE label <> -1), 0) AS sq
            FROM uniq u LEFT JOIN tally USING (doc_id) GROUP BY u.doc_id)),
     (SELECT sum(s * s) AS p_e FROM (SELECT count(*) / (3e0 * (SELECT count(*) FROM uniq)) AS s
            FROM long WHERE label <> -1 AND doc_id IN (SELECT doc_id FROM uniq) GROUP BY label)))""", UNIQ))
def experiment_summary_fields(spark, sf_dir):
    """Every field of the nested summary row, as the job writes it and reads it back from JSON."""
    path = fresh_path(spark, "experiment")
    s = jobs.consensus_job(annotations(spark, sf_dir), dataset="documents", order="doc_id", categories=CATEGORIES, output=path).summary
    s = spark.read.schema(s.schema).json(f"{path}/summary")
    overall = F.filter("validation.classification_report", lambda r: r["class"] == "accuracy")[0]
    return s.select(
        "dataset.name", "dataset.total_texts", F.array_join(F.transform("dataset.categories", lambda c: c.cast("string")), ",").alias("categories"),
        "dataset.has_ground_truth", F.array_join("config.models", ",").alias("models"), "config.total_models",
        F.col("config.consensus_threshold").alias("threshold"), F.col("config.consensus_strategy").alias("strategy"),
        F.round("results.consensus_mean", 9).alias("consensus_mean"), F.round("results.consensus_median", 9).alias("consensus_median"),
        F.col("results.high_consensus").alias("high"), F.col("results.medium_consensus").alias("medium"), F.col("results.low_consensus").alias("low"),
        F.round("metrics.fleiss_kappa", 9).alias("fleiss_kappa"), F.col("metrics.fleiss_interpretation").alias("interpretation"),
        F.round(overall["f1"], 9).alias("accuracy"), overall["support"].cast("long").alias("support"))


@register("experiment_summary_json")
def experiment_summary(spark, sf_dir):
    report = jobs.consensus_job(annotations(spark, sf_dir), dataset="documents", order="doc_id", categories=CATEGORIES)
    return report.summary.select(F.to_json(F.struct("*")).alias("summary"))


@register("perspectives_job", with_votes("""
SELECT annotator AS llm, count(*) AS n FROM long WHERE label <> -1 GROUP BY 1"""))
def perspectives_job(spark, sf_dir):
    path = fresh_path(spark, "perspectives")
    jobs.perspectives_job(spark, annotations(spark, sf_dir), path, meanings=DESCRIPTIONS)
    again = jobs.perspectives_job(spark, annotations(spark, sf_dir), path, meanings=DESCRIPTIONS)
    return again.groupBy("llm").agg(F.count(F.lit(1)).alias("n"))


@register("annotation_job", f"""
SELECT count(*) AS texts, sum(text_len)::BIGINT AS chars, count(*) FILTER (WHERE m1 = m2) AS agreeing FROM (
  SELECT text_len, {rule_sql('p', 'm1', 0)[0]} AS m1, {rule_sql('p', 'm2', 0)[0]} AS m2
  FROM (SELECT length(text) AS text_len, 'Q: ' || text || chr(10) || '- 0: german' || chr(10) || '- 1: english' || chr(10) || '- 2: spanish' || chr(10) || '- 3: french' AS p
        FROM (SELECT text, row_number() OVER (PARTITION BY md5({sql_strip('text')}) ORDER BY doc_id) AS rk FROM documents) WHERE rk = 1))""")
def annotation_job(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    wide = jobs.annotation_job(docs, marker_annotator(), MODELS, categories=CATEGORIES, meanings=DESCRIPTIONS,
                               template="Q: {text}\n{categories}", order="doc_id", cache=fresh_path(spark, "responses"))
    return wide.agg(F.count(F.lit(1)).alias("texts"), F.sum("text_len").cast("bigint").alias("chars"),
                    F.count_if(F.col("m1_consensus") == F.col("m2_consensus")).alias("agreeing"))
