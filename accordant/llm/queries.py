"""The registered queries of this subpackage; ``SQL`` holds the statements of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from accordant.llm import ann, bpe, exact_dedup, frames, hard_negatives, line_dedup, near_dedup, ngram_join, packing, pii, secrets, toxicity, vector_codes
from accordant.llm.common import finite, floored, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the documents, by id hash, are the snapshot; the others arrive as a batch."""
    docs = table(spark, sf_dir, "documents")
    out = exact_dedup.duplicates(docs, F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0)
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


SQL["op8_exact_dedup"] = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)
"""


@query
def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secrets.scan(docs, secrets.train(docs))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.Model:
    """Trained on the labelled rows that are not held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    known = labels.filter(~toxicity.held_out()).select("doc_id", "toxic")
    # Labels are the narrow side at every size; hashing them spares a sort of the texts.
    return toxicity.train(docs.select("doc_id", "text").join(known.hint("shuffle_hash"), "doc_id"))


@query
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = toxicity.score(docs, toxicity_model(spark, sf_dir))
    return found.select("doc_id", F.coalesce(toxicity.held_out(), F.lit(False)).alias("held_out"), "score", "predicted")


@query
def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), capacity=2048)


@query
def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode(table(spark, sf_dir, "documents")))


@query
def op5_token_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written and read back; the digests come from the files."""
    manifest = frames.write(table(spark, sf_dir, "documents"))
    return frames.read(manifest, with_ids=False).drop("ids")


@query
def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


@query
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every judged line with its component and whether it stays."""
    out = line_dedup.decide(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.col("line_no").cast("long").alias("line_no"), "component", "kept")


@query
def op4_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = pii.pseudonymise(docs, key="corpus-key")
    spans = F.array_join(F.transform("pii", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return out.select("doc_id", "text", F.size("pii").cast("long").alias("n_pii"), spans.alias("spans"))


@query
def op1_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = ann.usual_length(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding").filter("vec_id is not null")
    model = ann.fit(vectors, id_col="vec_id", vector_col="embedding")
    out = ann.search(vectors, vectors.filter("vec_id % 20 = 0"), model, id_col="vec_id", vector_col="embedding", k=20)
    return out.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


@query
def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents").select("doc_id", "text"), width=3, percent=90)


def _components_sql(percent: int, kept: str = "") -> str:
    """Shingle sets, links by counted intersections, and the least id reachable over them."""
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM d),
n AS MATERIALIZED (SELECT d.doc_id, count(g) AS n FROM d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id),
b AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM b JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * common >= {percent} * (x.n + y.n - common)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS other FROM n UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.other = e.a)
SELECT doc_id, n AS n_shingles, min(other) AS component_id{kept} FROM r JOIN n USING (doc_id) GROUP BY doc_id, n
"""


SQL["op11_ngram_join"] = _components_sql(90)
SQL["op9_near_dedup"] = _components_sql(85, ", min(other) = doc_id AS kept")


@query
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").filter(F.col("label").isNotNull() & finite("embedding"))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.select("vec_id", label.alias("label"), floored("embedding", 256).alias("v"))
    return hard_negatives.mine(rows, F.col("vec_id") % 100 == 0)


#: Components that are null, NaN or infinite, as DuckDB sees them.
_BROKEN = "len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) > 0"

SQL["op12_hard_negatives"] = f"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND NOT {_BROKEN}),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
    list_sum(list_transform(list_zip(a.e, b.e), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5
"""


@query
def op13_orchard_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"), scale=4096, parts=8, entries=16, rounds=6)


def _codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Every round in statements of its own: distances of all parts to all entries, the nearest, floored means."""
    ctes = [f"""kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND NOT {_BROKEN})""",
            f"""x AS MATERIALIZED (SELECT vec_id, label, p, v[p * len(v) // {parts} + 1:(p + 1) * len(v) // {parts}] AS u FROM kept, range({parts}) r(p))""",
            f"""c0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS k, u AS c FROM x
  QUALIFY row_number() OVER (PARTITION BY p ORDER BY vec_id) <= {entries})"""]
    nearest = """(SELECT vec_id, label, p, u, arg_min(k, (d, k)) AS k, min(d) AS d FROM (SELECT vec_id, label, x.p, u, k,
    list_sum(list_transform(list_zip(u, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM x JOIN c{0} ON x.p = c{0}.p) GROUP BY vec_id, label, p, u)"""
    for r in range(rounds):
        ctes.append(f"""m{r} AS MATERIALIZED (SELECT p, k, list(floor_mean ORDER BY i) AS c FROM (SELECT p, k, i,
    CASE WHEN sum(u[i]) % count(*) < 0 THEN sum(u[i]) // count(*) - 1 ELSE sum(u[i]) // count(*) END::BIGINT AS floor_mean
    FROM {nearest.format(r)}, (SELECT unnest(range(1, max(len(u)) + 1)) AS i FROM x) GROUP BY p, k, i) GROUP BY p, k)""")
        ctes.append(f"c{r + 1} AS MATERIALIZED (SELECT c{r}.p, c{r}.k, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} ON c{r}.p = m{r}.p AND c{r}.k = m{r}.k)")
    ctes.append(f"f AS (SELECT vec_id, label, string_agg(printf('%02x', k), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM {nearest.format(rounds)} GROUP BY vec_id, label)")
    ctes.append(f"h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, k)) AS codebooks_sha256 FROM c{rounds})")
    return "WITH " + ",\n".join(ctes) + "\nSELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM f, h"


SQL["op13_orchard_codes"] = _codes_sql()
