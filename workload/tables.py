"""Joins, duplicates, sampling, folds, reshaping, labels, sources and responses."""

from __future__ import annotations

from pyspark.sql import functions as F

from accordant.functions import coding, prompts, responses as R, text as T
from accordant.operators import align as J, consensus as C, dedup as D, labels as B, reshape as U, sampling as S
from accordant.sources import artefacts, datasets, folds as FO, runs
from accordant.sources.workspace import fresh_path
from workload.agreement import r9, classes_sql
from workload.base import (ANNOTATORS, CATEGORIES, DESCRIPTIONS, VOTES, annotations, digits, register,
                           repetitions, sql_digits, sql_strip, table, with_votes)
from workload.consensus import majority


def rows_n():
    return F.count(F.lit(1))


# --- duplicates ------------------------------------------------------------------------------

UNIQ = """
uniq AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY text_id ORDER BY doc_id) AS rk FROM c) WHERE rk = 1)"""


def deduped(spark, sf_dir):
    """The consensus table with one row per text."""
    cols = ["doc_id", "text_id", "text", "text_len", "dataset", "run_id", "ground_truth", *VOTES,
            *[f"{v}_score" for v in VOTES]]
    return C.resolve(D.keep_first(annotations(spark, sf_dir).select(*cols), "text_id", "doc_id"), VOTES)


@register("text_id_dedup", with_votes("SELECT doc_id, text_id, text_len, ground_truth FROM uniq", UNIQ))
def text_id_dedup(spark, sf_dir):
    rows = annotations(spark, sf_dir).select("doc_id", "text_id", "text_len", "ground_truth")
    return D.keep_first(rows, "text_id", "doc_id")


@register("text_identity", with_votes("SELECT doc_id, text_id, text_len, substr(text, 1, 100) AS head FROM v"))
def text_identity(spark, sf_dir):
    return annotations(spark, sf_dir).select("doc_id", "text_id", "text_len", T.excerpt("text").alias("head"))


@register("duplicate_report", with_votes("""
SELECT doc_id, text_id, copies FROM (SELECT doc_id, text_id, count(*) OVER (PARTITION BY text_id) AS copies FROM v)
WHERE copies > 1"""))
def duplicate_report(spark, sf_dir):
    return D.duplicate_members(annotations(spark, sf_dir).select("doc_id", "text_id"), "text_id").select(
        "doc_id", "text_id", "copies")


@register("uniqueness_check", with_votes("""
SELECT count(*) AS n_rows, count(DISTINCT text_id) AS n_keys, count(*) = count(DISTINCT text_id) AS is_unique FROM v"""))
def uniqueness(spark, sf_dir):
    return D.uniqueness(annotations(spark, sf_dir), "text_id")


# --- joins -----------------------------------------------------------------------------------

@register("annotations_join_gt", with_votes("""
SELECT v.doc_id, v.text_id, g.ground_truth FROM v LEFT JOIN
  (SELECT text_id, arg_min(quality, doc_id) AS ground_truth FROM v JOIN labels USING (doc_id) GROUP BY text_id) g USING (text_id)"""))
def join_gt(spark, sf_dir):
    ann = annotations(spark, sf_dir)
    truth = (ann.select("doc_id", "text_id").join(table(spark, sf_dir, "labels"), "doc_id")
             .select("doc_id", "text_id", F.col("quality").alias("ground_truth")))
    return J.attach_truth(ann.select("doc_id", "text_id"), truth, "doc_id").select(
        "doc_id", "text_id", "ground_truth")


@register("align_gt_annotations", with_votes("""
SELECT text_id, md5(text) AS text_digest, ground_truth AS truth_label, mode AS annotated_label FROM uniq
WHERE ground_truth IS NOT NULL""", UNIQ))
def align(spark, sf_dir):
    full = deduped(spark, sf_dir)
    truth = full.filter("ground_truth is not null").select("text_id", "text", "ground_truth")
    out = J.align_one_to_one(truth, full.select("text_id", "resolved_annotation"), "ground_truth",
                             "resolved_annotation")
    return out.withColumn("text_digest", F.md5("text")).drop("text")


@register("drop_invalid_texts", with_votes("""
SELECT doc_id, text_id, mode AS label FROM c WHERE text_id NOT IN (SELECT text_id FROM c WHERE mode = -1)"""))
def drop_invalid(spark, sf_dir):
    rows = majority(spark, sf_dir).select("doc_id", "text_id", F.col("resolved_annotation").alias("label"))
    return J.drop_invalid(rows).select("doc_id", "text_id", "label")


@register("drop_problematic_texts", with_votes("""
SELECT doc_id, text_id FROM c WHERE text_id NOT IN (SELECT text_id FROM c WHERE score < 0.6)"""))
def drop_problematic(spark, sf_dir):
    rows = majority(spark, sf_dir)
    bad = C.problematic_cases(annotations(spark, sf_dir), VOTES)
    return J.drop_ids(rows.select("doc_id", "text_id"), bad).select("doc_id", "text_id")


@register("keep_selected_texts", with_votes("""
SELECT doc_id, text_id FROM c WHERE text_id IN (SELECT text_id FROM c WHERE lvl = 'high')"""))
def keep_selected(spark, sf_dir):
    rows = majority(spark, sf_dir)
    return J.keep_ids(rows.select("doc_id", "text_id"), rows.filter("consensus_level = 'high'")).select(
        "doc_id", "text_id")


@register("resume_antijoin", with_votes("""
SELECT doc_id, text_id FROM v WHERE text_id NOT IN (SELECT text_id FROM v JOIN labels USING (doc_id))"""))
def resume(spark, sf_dir):
    ids = annotations(spark, sf_dir).select("doc_id", "text_id")
    done = ids.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    return J.remaining_texts(ids, done).select("doc_id", "text_id")


@register("remove_by_raw_text", """
SELECT doc_id, md5(text) AS raw_id FROM documents WHERE text NOT IN (SELECT text FROM documents JOIN labels USING (doc_id))""")
def remove_by_text(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    return J.remove_annotated_texts(docs, done).select("doc_id", F.md5("text").alias("raw_id"))


@register("id_overlap", with_votes("""
SELECT count(*) FILTER (WHERE l AND r) AS in_both, count(*) FILTER (WHERE l AND NOT r) AS only_left,
       count(*) FILTER (WHERE r AND NOT l) AS only_right
FROM (SELECT text_id, bool_or(ann_a = ann_b) AS l, bool_or(ann_b = ann_c) AS r FROM v GROUP BY text_id)"""))
def overlap(spark, sf_dir):
    ann = annotations(spark, sf_dir)
    a, b, c = VOTES
    return J.id_overlap(ann.filter(F.col(a) == F.col(b)), ann.filter(F.col(b) == F.col(c)))


@register("whitespace_report", with_votes("""
SELECT (SELECT count(*) FROM d0 WHERE text LIKE chr(10) || '%') AS left_starts_newline,
       (SELECT count(*) FROM d0 WHERE text LIKE '%' || chr(10)) AS left_ends_newline,
       (SELECT count(*) FROM o WHERE text LIKE chr(10) || '%') AS right_starts_newline,
       (SELECT count(*) FROM o WHERE text LIKE '%' || chr(10)) AS right_ends_newline,
       (SELECT count(*) FROM (SELECT DISTINCT md5(text) AS i FROM d0 INTERSECT SELECT DISTINCT md5(text) FROM o)) AS ids_matching_raw,
       (SELECT count(DISTINCT text_id) FROM d0) AS ids_matching_stripped""",
    "o AS (SELECT doc_id, case doc_id % 3 when 0 then text || chr(10) when 1 then chr(10) || text else text end AS text FROM documents)"))
def whitespace(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    padded = docs.withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("\n")))
                             .when(F.col("doc_id") % 3 == 1, F.concat(F.lit("\n"), "text")).otherwise(F.col("text")))
    return J.whitespace_report(docs, padded)


# --- sampling and folds ----------------------------------------------------------------------

@register("shuffled_sample", with_votes("""
SELECT doc_id, text_id FROM v ORDER BY md5(doc_id || '|42'), doc_id LIMIT 300"""))
def shuffled(spark, sf_dir):
    return S.shuffled_sample(annotations(spark, sf_dir).select("doc_id", "text_id"), "doc_id", 300)


@register("class_sample", with_votes("""
SELECT doc_id FROM v WHERE ground_truth = 1 ORDER BY md5(doc_id || '|42'), doc_id LIMIT 10"""))
def class_sample(spark, sf_dir):
    return S.class_sample(annotations(spark, sf_dir).select("doc_id", "ground_truth"),
                          F.col("ground_truth") == 1, "doc_id", 10).select("doc_id")


@register("capped_sample", with_votes("""
SELECT doc_id, dataset FROM (SELECT doc_id, dataset, row_number() OVER (PARTITION BY dataset ORDER BY md5(doc_id || '|7'), doc_id) AS rk FROM v)
WHERE rk <= 12"""))
def capped(spark, sf_dir):
    return S.capped_per_group(annotations(spark, sf_dir).select("doc_id", "dataset"), "dataset", "doc_id", 12, seed=7)


@register("stratified_halves", with_votes("""
SELECT doc_id, case when row_number() OVER (PARTITION BY ground_truth ORDER BY md5(doc_id || '|42'), doc_id) % 2 = 1
       then 'val' else 'test' end AS split FROM v"""))
def halves(spark, sf_dir):
    return S.stratified_halves(annotations(spark, sf_dir).select("doc_id", "ground_truth"), "ground_truth",
                               "doc_id").select("doc_id", "split")


FOLDS = """
folds AS (SELECT doc_id, text_id, gt0 AS label, cast((row_number() OVER (PARTITION BY gt0 ORDER BY md5(doc_id || '|42'), doc_id) - 1)
            % (SELECT greatest(2, least(5, min(n))) FROM (SELECT count(*) AS n FROM d0 GROUP BY gt0)) AS int) AS fold FROM d0)"""


def fold_assignment_rows(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    from workload.base import language_label
    rows = docs.select("doc_id", "text", T.text_id("text").alias("text_id"), language_label(F.col("lang")).alias("label"))
    return S.stratified_folds(rows, "label", "doc_id", 5)


@register("fold_assignment", with_votes("SELECT doc_id, label, fold FROM folds", FOLDS))
def fold_assignment(spark, sf_dir):
    return fold_assignment_rows(spark, sf_dir).select("doc_id", "label", "fold")


def cv_folds(spark, sf_dir):
    """(fold, split, text_id, label): every row trains in all folds but its own.  Texts stay behind."""
    rows = fold_assignment_rows(spark, sf_dir)
    each = F.explode(F.array(*[F.lit(i) for i in range(5)])).alias("f")
    return rows.select("doc_id", "text_id", "label", "fold", each).select(
        F.col("f").alias("fold"), F.when(F.col("f") == F.col("fold"), "val").otherwise("train").alias("split"),
        "doc_id", "text_id", "label")


CV = """
cv AS (SELECT f.fold AS fold, case when f.fold = folds.fold then 'val' else 'train' end AS split, doc_id, text_id, label
       FROM folds, (SELECT DISTINCT fold FROM folds) f),
tr AS (SELECT t.fold, u.doc_id, u.text_id, u.mode AS label FROM uniq u
       JOIN (SELECT DISTINCT fold, text_id FROM cv WHERE split = 'train') t USING (text_id)),
ev AS (SELECT fold, doc_id, text_id, label FROM cv WHERE split = 'val'
       AND NOT EXISTS (SELECT 1 FROM tr WHERE tr.fold = cv.fold AND tr.text_id = cv.text_id))"""


def annotated_texts(spark, sf_dir):
    return deduped(spark, sf_dir).select("text_id", "text", F.col("resolved_annotation").alias("label"))


@register("fold_train_semijoin", with_votes("SELECT fold, text_id, label FROM tr", FOLDS, UNIQ, CV))
def fold_train(spark, sf_dir):
    return J.train_rows(cv_folds(spark, sf_dir), annotated_texts(spark, sf_dir)).select("fold", "text_id", "label")


@register("fold_leakage_antijoin", with_votes("SELECT fold, doc_id, text_id, label FROM ev", FOLDS, UNIQ, CV))
def fold_leakage(spark, sf_dir):
    cv = cv_folds(spark, sf_dir)
    train = J.train_rows(cv, annotated_texts(spark, sf_dir))
    return J.without_leakage(cv.filter("split = 'val'"), train).select("fold", "doc_id", "text_id", "label")


@register("split_coverage", with_votes("""
SELECT fold, cast(sum(n) as bigint) AS fold_rows, cast(sum(have) as bigint) AS annotated_rows,
       count(*) FILTER (WHERE have = 0) AS missing_ids, sum(have) / sum(n)::DOUBLE AS coverage
FROM (SELECT fold, text_id, count(*) AS n, max((text_id IN (SELECT text_id FROM uniq WHERE lvl <> 'low'))::int) AS have
      FROM cv WHERE split = 'train' GROUP BY 1, 2) GROUP BY fold""", FOLDS, UNIQ, CV))
def coverage(spark, sf_dir):
    have = deduped(spark, sf_dir).filter("consensus_level <> 'low'")
    return J.split_coverage(cv_folds(spark, sf_dir), have.select("text_id"))


@register("cv_alignment", with_votes("""
SELECT fold, 'train' AS split, text_id, label, count(*) AS n FROM tr GROUP BY ALL
UNION ALL SELECT fold, 'val', text_id, label, count(*) FROM ev GROUP BY ALL""", FOLDS, UNIQ, CV))
def cv_alignment(spark, sf_dir):
    out = J.align_folds(cv_folds(spark, sf_dir), annotated_texts(spark, sf_dir))
    return out.groupBy("fold", "split", "text_id", "label").agg(rows_n().alias("n"))


# --- reshaping -------------------------------------------------------------------------------

DESC = "case label when 0 then 'german' when 1 then 'english' when 2 then 'spanish' when 3 then 'french' end"


@register("perspectivism", with_votes(f"""
SELECT doc_id, text_id, length({sql_strip('text')})::INT AS chars, label, annotator AS llm, {DESC} AS label_description
FROM long JOIN d0 USING (doc_id) WHERE label <> -1"""))
def perspectivism(spark, sf_dir):
    return (U.perspectives(annotations(spark, sf_dir), meanings=DESCRIPTIONS, keep=["doc_id"])
            .select("doc_id", "text_id", T.text_len("text").alias("chars"), "label", "llm", "label_description"))


@register("perspective_stats", with_votes("""
SELECT count(DISTINCT text_id) FILTER (WHERE label <> -1) AS texts, count(*) FILTER (WHERE label <> -1) AS rows,
       count(*) FILTER (WHERE label = -1) AS removed FROM long JOIN d0 USING (doc_id)"""))
def perspective_stats(spark, sf_dir):
    ann = annotations(spark, sf_dir)
    return U.perspective_stats(ann, VOTES, U.perspectives(ann))


@register("wide_to_long", with_votes(
    "SELECT doc_id, annotator, cast(seat - 1 as int) AS annotator_idx, label FROM long"))
def to_long(spark, sf_dir):
    return U.wide_to_long(annotations(spark, sf_dir), VOTES, ["doc_id"])


@register("long_to_wide", with_votes("""
SELECT doc_id, ann_a AS ann_a_consensus, ann_b AS ann_b_consensus, ann_c AS ann_c_consensus FROM v"""))
def to_wide(spark, sf_dir):
    return U.long_to_wide(to_long(spark, sf_dir), list(ANNOTATORS), ["doc_id"])


# --- labels ----------------------------------------------------------------------------------

@register("category_infer", with_votes("""
SELECT DISTINCT label FROM (SELECT label FROM long UNION ALL SELECT ground_truth FROM v) WHERE label IS NOT NULL AND label <> -1"""))
def categories(spark, sf_dir):
    return B.infer_categories(annotations(spark, sf_dir), [*VOTES, "ground_truth"])


@register("label_schema", f"""
SELECT DISTINCT label, {DESC} AS label_description FROM
  (SELECT cast(case lang when 'de' then 0 when 'en' then 1 when 'es' then 2 else 3 end as int) AS label FROM documents)""")
def label_schema(spark, sf_dir):
    return B.label_schema(load_texts(spark, sf_dir))


@register("label_encoding", "SELECT doc_id, cast(dense_rank() OVER (ORDER BY source) - 1 as int) AS class_index FROM documents")
def label_encoding(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return B.encode(docs, "source").select("doc_id", "class_index")


@register("label_distribution", with_votes("""
SELECT ground_truth AS label, count(*) AS n, count(*) / (SELECT count(ground_truth) FROM v)::DOUBLE AS share
FROM v WHERE ground_truth IS NOT NULL GROUP BY 1"""))
def label_distribution(spark, sf_dir):
    rows = annotations(spark, sf_dir).select(F.col("ground_truth").alias("label"))
    return B.distribution(rows)


@register("chi2_uniform", with_votes("""
SELECT count(*) AS classes, round(sum((n - e) * (n - e) / e), 6) AS chi2, count(*) - 1 AS df FROM
  (SELECT n, avg(n) OVER () AS e FROM (SELECT count(*) AS n FROM v WHERE ground_truth IS NOT NULL GROUP BY ground_truth))"""))
def chi2(spark, sf_dir):
    rows = annotations(spark, sf_dir).select(F.col("ground_truth").alias("label"))
    return B.uniformity(rows, p_value=False).withColumn("chi2", F.round("chi2", 6))


@register("chi2_uniform_p")
def chi2_p(spark, sf_dir):
    return B.uniformity(annotations(spark, sf_dir).select(F.col("ground_truth").alias("label")))


# --- sources ---------------------------------------------------------------------------------

def spec(sf_dir):
    return datasets.DatasetSpec(path=sf_dir, file="documents.parquet", label_column="label", meanings=DESCRIPTIONS)


def load_texts(spark, sf_dir):
    from workload.base import language_label
    docs = datasets.read_dataset(spark, spec(sf_dir))
    return B.describe(docs.select("doc_id", "text", language_label(F.col("lang")).alias("label")), DESCRIPTIONS)


@register("load_texts", f"""
SELECT doc_id, length(text)::INT AS chars, label, {DESC} AS label_description FROM
 (SELECT doc_id, text, cast(case lang when 'de' then 0 when 'en' then 1 when 'es' then 2 else 3 end as int) AS label FROM documents)""")
def loaded(spark, sf_dir):
    return load_texts(spark, sf_dir).select("doc_id", T.text_len("text").alias("chars"), "label", "label_description")


@register("describe_by_join", "SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def describe_join(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return B.describe(table(spark, sf_dir, "customer"), nation, "c_nationkey", "n_name").select("c_custkey", "n_name")


@register("combine_splits", """
SELECT split, count(*) AS n, cast(sum(length(text)) as bigint) AS chars FROM (
  SELECT doc_id, text, case when doc_id % 2 = 0 then 'train' else 'test' end AS split FROM documents) GROUP BY split""")
def combine_splits(spark, sf_dir):
    root = fresh_path(spark, "splits")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    for name, odd in (("train", 0), ("test", 1)):
        (docs.filter(F.col("doc_id") % 2 == odd).withColumn("origin", F.lit(name))
         .write.parquet(f"{root}/{name}"))
    both = datasets.read_dataset(spark, datasets.DatasetSpec(
        path=root, combine_splits=("train", "validation", "test")))
    return both.groupBy(F.col("origin").alias("split")).agg(
        rows_n().alias("n"), F.sum(T.text_len("text")).alias("chars"))


@register("latest_run", with_votes("SELECT doc_id, run_id FROM v WHERE run_id = (SELECT max(run_id) FROM v)"))
def latest(spark, sf_dir):
    return runs.latest_run(annotations(spark, sf_dir)).select("doc_id", "run_id")


@register("last_runs", with_votes("""
SELECT doc_id, dataset, run_id, replica FROM v JOIN (
  SELECT dataset, run_id, cast(row_number() OVER (PARTITION BY dataset ORDER BY run_id) as int) AS replica FROM (
    SELECT dataset, run_id, row_number() OVER (PARTITION BY dataset ORDER BY run_id DESC) AS age
    FROM (SELECT DISTINCT dataset, run_id FROM v)) WHERE age <= 2) USING (dataset, run_id)"""))
def last(spark, sf_dir):
    return runs.last_runs(annotations(spark, sf_dir), 2).select("doc_id", "dataset", "run_id", "replica")


@register("runs_from_paths", with_votes("SELECT run_id, count(*) AS n FROM v GROUP BY run_id"))
def runs_from_paths(spark, sf_dir):
    root = fresh_path(spark, "runs")
    ann = annotations(spark, sf_dir).select("doc_id", F.col("run_id").alias("folder"))
    ann.write.partitionBy("folder").parquet(root)
    named = (spark.read.parquet(root).withColumn(
        "run_id", F.regexp_extract("_metadata.file_path", r"folder=([^/]+)/", 1)))
    return named.groupBy("run_id").agg(rows_n().alias("n"))


@register("export_consensus", with_votes("""
SELECT case when score >= 0.8 then 'high_confidence' else 'needs_review' end AS subset, count(*) AS n,
       cast(sum(mode) as bigint) AS label_sum FROM c GROUP BY 1"""))
def export_consensus(spark, sf_dir):
    path = fresh_path(spark, "consensus")
    artefacts.write_consensus(majority(spark, sf_dir).drop("text"), path)
    return spark.read.parquet(path).groupBy("subset").agg(
        rows_n().alias("n"), F.sum("resolved_annotation").alias("label_sum"))


@register("csv_roundtrip_dedup", with_votes("""
SELECT text_id, doc_id, md5(text) AS raw_id, ann_a FROM uniq""", UNIQ))
def csv_roundtrip(spark, sf_dir):
    path = fresh_path(spark, "annotations-csv")
    artefacts.write_csv(annotations(spark, sf_dir).select("text_id", "doc_id", "text", F.col(VOTES[0]).alias("ann_a")), path)
    back = artefacts.read_annotations_csv(
        spark, path, "text_id string, doc_id bigint, text string, ann_a int", order="doc_id")
    return back.select("text_id", "doc_id", F.md5("text").alias("raw_id"), "ann_a")


@register("save_annotated", with_votes("SELECT doc_id, ann_a AS ann_a_consensus FROM v"))
def save_annotated(spark, sf_dir):
    path = fresh_path(spark, "annotated")
    rows = annotations(spark, sf_dir).select("doc_id", VOTES[0], "ground_truth")
    artefacts.write_annotated(rows, path, include_ground_truth=False)
    return spark.read.parquet(path)


@register("reuse_materialised", with_votes("SELECT lvl AS consensus_level, count(*) AS n FROM c GROUP BY lvl"))
def reuse(spark, sf_dir):
    path = fresh_path(spark, "stored-consensus")
    build = lambda: majority(spark, sf_dir).select("doc_id", "consensus_level")
    artefacts.load_or_build(spark, path, build)
    return artefacts.load_or_build(spark, path, build).groupBy("consensus_level").agg(rows_n().alias("n"))


@register("fold_discovery", with_votes("""
SELECT fold, split, count(*) AS n FROM cv GROUP BY ALL""", FOLDS, UNIQ, CV))
def fold_discovery(spark, sf_dir):
    root = fresh_path(spark, "folds")
    cv = cv_folds(spark, sf_dir).select("fold", "split", "doc_id", "text_id", "label")
    for i in range(5):
        one = cv.filter(F.col("fold") == i)
        one.filter("split = 'train'").drop("fold", "split").write.parquet(f"{root}/train_fold_{i}")
        one.filter("split = 'val'").drop("fold", "split").write.parquet(f"{root}/test_fold_{i}")
    return FO.read_folds(spark, root).groupBy("fold", "split").agg(rows_n().alias("n"))


SCORE = """
acc AS (SELECT dataset, cast(substr(run_id, 10, 1) as int) - 1 AS fold, avg((mode = ground_truth)::int) AS f1_macro
        FROM c WHERE ground_truth IS NOT NULL GROUP BY 1, 2)"""


def fold_scores(spark, sf_dir):
    rows = majority(spark, sf_dir).filter("ground_truth is not null")
    fold = (F.substring("run_id", 10, 1).cast("int") - 1).alias("fold")
    hit = (F.col("resolved_annotation") == F.col("ground_truth")).cast("double")
    return rows.groupBy("dataset", fold).agg(F.avg(hit).alias("f1_macro"))


@register("fold_scores_wide", with_votes("SELECT dataset, cast(fold as int) AS fold, round(f1_macro, 9) AS f1_macro FROM acc", SCORE))
def scores_wide(spark, sf_dir):
    wide = fold_scores(spark, sf_dir).groupBy("dataset").pivot("fold", list(range(10))).agg(F.first("f1_macro"))
    named = wide.select("dataset", *[F.col(f"`{i}`").alias(f"mac{i}") for i in range(10)])
    return r9(FO.scores_from_wide(named), "f1_macro")


@register("fold_scores_json", with_votes("SELECT dataset, cast(fold as int) AS fold, round(f1_macro, 9) AS f1_macro FROM acc", SCORE))
def scores_json(spark, sf_dir):
    root = fresh_path(spark, "fold-metrics")
    entry = F.struct(F.col("fold").cast("string").alias("key"),
                     F.create_map(F.lit("eval_f1_macro"), F.col("f1_macro")).alias("value"))
    docs = fold_scores(spark, sf_dir).groupBy("dataset").agg(
        F.to_json(F.struct(F.map_from_entries(F.collect_list(entry)).alias("folds"))).alias("value"))
    docs.write.parquet(root)
    return r9(FO.scores_from_json(spark.read.parquet(root), keep=["dataset"]), "f1_macro")


# --- responses and prompts -------------------------------------------------------------------

# How an annotator words its vote: eight shapes, picked by a hash digit of the row.
def response_text(vote, shape):
    word = vote.cast("string")
    return (F.when(shape == 0, word).when(shape == 1, F.concat(F.lit("Class: "), word, F.lit(" or 4")))
            .when(shape == 2, F.concat(F.lit("1) tone 2) topic CLASSIFICATION: "), word))
            .when(shape == 3, F.lit("")).when(shape == 4, F.lit(None).cast("string"))
            .when(shape == 5, F.lit("none")).when(shape == 6, F.lit("99999999999999"))
            .otherwise(F.concat(F.lit("CLASSIFICATION: 9 no, CLASSIFICATION:\n"), word, F.lit("\n"))))


SQL_RESPONSE = f"""
rsp AS (SELECT doc_id, ann_a, case shape when 0 then ann_a::VARCHAR when 1 then 'Class: ' || ann_a || ' or 4'
          when 2 then '1) tone 2) topic CLASSIFICATION: ' || ann_a when 3 then '' when 4 then null when 5 then 'none'
          when 6 then '99999999999999' else 'CLASSIFICATION: 9 no, CLASSIFICATION:' || chr(10) || ann_a || chr(10) end AS content
        FROM (SELECT v.doc_id, ann_a, {sql_digits('shape', 1, 'v.doc_id::VARCHAR')} % 8 AS shape FROM v)),
num AS (SELECT doc_id, content, try_cast(nullif(regexp_extract(content[-1], '-?\\d+'), '') AS int) AS n
        FROM (SELECT doc_id, string_split(content, 'CLASSIFICATION:') AS content FROM rsp))"""


def response_rows(spark, sf_dir):
    shape = digits("shape", F.col("doc_id").cast("string"), 1) % 8
    return annotations(spark, sf_dir).select(
        "doc_id", F.col(VOTES[0]).alias("vote"), response_text(F.col(VOTES[0]), shape).alias("content"))


@register("parse_responses", with_votes("""
SELECT doc_id, cast(case when n IN (0, 1, 2, 3) then n else -1 end as int) AS label, coalesce(n IN (0, 1, 2, 3), false) AS valid FROM num""",
    SQL_RESPONSE))
def parse(spark, sf_dir):
    content = F.col("content")
    return response_rows(spark, sf_dir).select(
        "doc_id", R.extract_label(content, CATEGORIES).alias("label"), R.is_valid(content, CATEGORIES).alias("valid"))


@register("parse_document_texts", """
SELECT doc_id, cast(case when n IN (0, 1, 2, 3) then n else -1 end as int) AS label FROM
 (SELECT doc_id, try_cast(nullif(regexp_extract(string_split(text, 'CLASSIFICATION:')[-1], '-?\\d+'), '') AS int) AS n FROM documents)""")
def parse_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", R.extract_label(F.col("text"), CATEGORIES).alias("label"))


@register("label_confidence", with_votes(f"""
SELECT doc_id, round(case when ann_a < 0 then null when {sql_digits('shape', 1, 'doc_id::VARCHAR')} % 3 = 0 then null
       else exp(-({sql_digits('lp', 1, 'doc_id::VARCHAR')} / 65536e0)) end, 9) AS confidence FROM v"""))
def label_confidence(spark, sf_dir):
    key = F.col("doc_id").cast("string")
    vote = F.col("vote").cast("string")
    lp = -(digits("lp", key, 1).cast("double") / 65536.0)

    def tok(token, logprob):
        return F.struct(token.alias("token"), logprob.alias("logprob"))

    inside = [tok(F.lit("<think>"), F.lit(0.0)), tok(vote, F.lit(-3.0)), tok(F.lit(" </think>\n"), F.lit(0.0))]
    answer = F.when(digits("shape", key, 1) % 3 == 0, F.lit("?")).otherwise(F.concat(F.lit(" "), vote))
    answer = F.when(F.col("vote") < 0, F.lit("?")).otherwise(answer)
    logprobs = F.array(*inside, tok(answer, lp), tok(vote, F.lit(-9.0)))
    # The closing token repeats the label only where the answer already carried it.
    logprobs = F.when(answer == "?", F.slice(logprobs, 1, 4)).otherwise(logprobs)
    return r9(response_rows(spark, sf_dir).select(
        "doc_id", R.label_confidence(F.col("vote"), logprobs).alias("confidence")), "confidence")


@register("prompt_rendering", """
SELECT doc_id, md5('Text: ' || text || chr(10) || 'Which category number fits this text?' || chr(10) ||
       '- 0: german' || chr(10) || '- 1: english' || chr(10) || '- 2: spanish' || chr(10) || '- 3: french') AS prompt_id FROM documents""")
def prompt(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.md5(prompts.render("simple", "text", meanings=DESCRIPTIONS)).alias("prompt_id"))


@register("few_shot_prompt", """
WITH ex AS (SELECT string_agg('Text: ' || text || chr(10) || 'Category: ' || item_id, chr(10) || chr(10) ORDER BY item_id) AS e
  FROM (SELECT * FROM benchmark ORDER BY item_id LIMIT 4))
SELECT doc_id, md5('Examples' || chr(10) || e || chr(10) || 'Now: ' || text) AS prompt_id FROM documents, ex""")
def few_shot(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select("item_id", "text", F.col("item_id").alias("category"))
    shown = prompts.example_block(items, "item_id", shots=4).scalar()
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(prompts.render(
        "Examples\n{examples}\nNow: {text}", "text", meanings=DESCRIPTIONS, examples=shown)).alias("prompt_id"))


@register("category_block", """
SELECT source, '- docs: ' || count(*) || chr(10) || '- langs: ' || count(DISTINCT lang) AS block FROM documents GROUP BY source""")
def category_block(spark, sf_dir):
    grouped = table(spark, sf_dir, "documents").groupBy("source").agg(
        rows_n().cast("string").alias("n"), F.count_distinct("lang").cast("string").alias("l"))
    return grouped.select("source", prompts.category_block_column(
        F.create_map(F.lit("docs"), F.col("n"), F.lit("langs"), F.col("l"))).alias("block"))


@register("cache_keys", """
SELECT doc_id, rep, md5('ann_a|' || text || '|{"rep": ' || rep || '}') AS cache_key FROM documents, (SELECT unnest([0, 1, 2])::INT AS rep)""")
def cache_keys(spark, sf_dir):
    reps = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("rep")
    return table(spark, sf_dir, "documents").select("doc_id", "text", reps).select(
        "doc_id", "rep", T.cache_key(F.lit("ann_a"), "text", "rep").alias("cache_key"))


# --- factor coding ---------------------------------------------------------------------------

@register("length_split", with_votes("""
SELECT doc_id, m AS median_len, case when text_len <= m then 'curto' else 'longo' end AS size_class
FROM v JOIN (SELECT dataset, median(text_len) AS m FROM v GROUP BY 1) USING (dataset)"""))
def length_split(spark, sf_dir):
    rows = annotations(spark, sf_dir).select("doc_id", "dataset", "text_len")
    return coding.length_class(rows, ["dataset"]).select("doc_id", "median_len", "size_class")
