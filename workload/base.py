"""Annotation tables derived by Spark from the given tables, and the same tables as SQL.

Votes come from ``documents``: the language gives the true label, and md5 digits of the row
key decide, per annotator, whether the vote is right, wrong or invalid.  The SQL spells the
same recipe, so both engines see equal rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from accordant.functions import text as T

ANNOTATORS = {"ann_a": 55000, "ann_b": 50000, "ann_c": 45000}
VOTES = [f"{m}_consensus" for m in ANNOTATORS]
CONFS = [f"{m}_rep1_conf" for m in ANNOTATORS]
CATEGORIES = [0, 1, 2, 3]
WEIGHTS = {"ann_a": 1.30, "ann_b": 1.25, "ann_c": 1.20}
DESCRIPTIONS = {"0": "german", "1": "english", "2": "spanish", "3": "french"}

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    query: Query
    sql: str | None


REGISTRY: dict[str, Entry] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(fn: Query) -> Query:
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        REGISTRY[name] = Entry(fn, sql)
        return fn

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def digits(tag: str, key: Column, start: int) -> Column:
    """Four hex digits of md5(tag|key) as an integer in [0, 65536)."""
    return _word(F.md5(F.concat(F.lit(f"{tag}|"), key)), start)


def _word(digest: Column, start: int) -> Column:
    return F.conv(F.substring(digest, start, 4), 16, 10).cast("int")


def with_draws(df: DataFrame, tags: list[str], key: Column) -> DataFrame:
    """Add, per tag, three drawn integers; each digest is computed once per row."""
    hashed = df.withColumns({f"__h{i}": F.md5(F.concat(F.lit(f"{t}|"), key)) for i, t in enumerate(tags)})
    words = {f"__w{i}_{start}": _word(F.col(f"__h{i}"), start) for i in range(len(tags)) for start in (1, 5, 9, 13)}
    return hashed.withColumns(words).drop(*[f"__h{i}" for i in range(len(tags))])


def drawn_vote(i: int, truth: Column, right_below: int, classes: int) -> Column:
    roll = F.col(f"__w{i}_1")
    wrong = (truth + 1 + F.col(f"__w{i}_5") % (classes - 1)) % classes
    return (F.when(roll < right_below, truth).when(roll < 64500, wrong).otherwise(F.lit(-1))
            .cast("int"))


def drawn_confidence(i: int) -> Column:
    return (F.col(f"__w{i}_9") + 1).cast("double") / F.lit(65536.0)


def language_label(lang: Column) -> Column:
    return (F.when(lang == "de", 0).when(lang == "en", 1).when(lang == "es", 2).otherwise(3)
            .cast("int"))


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide annotation table: one row per document."""
    key = F.col("doc_id").cast("string")
    docs = with_draws(table(spark, sf_dir, "documents"), list(ANNOTATORS), key)
    gt0 = language_label(F.col("lang"))
    seats = []
    for i, (m, lo) in enumerate(ANNOTATORS.items()):
        seats += [drawn_vote(i, gt0, lo, 4).alias(f"{m}_consensus"),
                  F.lit(1.0).alias(f"{m}_consensus_score"),
                  drawn_confidence(i).alias(f"{m}_rep1_conf")]
    # One-element explode: the drawn votes are computed once per row and later filters work
    # on them as columns, as they would on a stored annotation table.
    return docs.select(
        "doc_id", "text",
        T.text_id("text").alias("text_id"),
        T.text_len("text").cast("int").alias("text_len"),
        F.col("source").alias("dataset"),
        F.format_string("2026-01-%02d_08-00-00", digits("run", key, 1) % 5 + 1).alias("run_id"),
        F.when(F.col("doc_id") % 50 != 0, gt0).alias("ground_truth"),
        F.explode(F.array(F.struct(*seats))).alias("drawn"),
    ).select("doc_id", "text", "text_id", "text_len", "dataset", "run_id", "ground_truth",
             "drawn.*")


def repetitions(spark: SparkSession, sf_dir: str, reps: int = 3) -> DataFrame:
    """Long annotation table: one row per document, annotator and repetition."""
    calls = [(m, i, r, lo) for i, (m, lo) in enumerate(ANNOTATORS.items())
             for r in range(1, reps + 1)]
    docs = with_draws(table(spark, sf_dir, "documents"), [f"{m}|{r}" for m, _, r, _ in calls],
                      F.col("doc_id").cast("string"))
    gt0 = language_label(F.col("lang"))
    rows = F.array(*[
        F.struct(
            F.lit(m).alias("annotator"), F.lit(i).alias("annotator_idx"), F.lit(r).alias("rep"),
            drawn_vote(at, gt0, lo, 4).alias("label"), drawn_confidence(at).alias("confidence"),
            (F.col(f"__w{at}_13").cast("double") / F.lit(1024.0)).alias("elapsed_sec"),
        ) for at, (m, i, r, lo) in enumerate(calls)])
    return docs.select("doc_id", F.explode(rows).alias("call")).select("doc_id", "call.*")


# --- the same tables as SQL ------------------------------------------------------------------

# The whitespace class that stripping removes, spelled out for RE2.
_WS = r"[\t\n\x0b\x0c\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def sql_strip(expr: str) -> str:
    return f"regexp_replace({expr}, '^{_WS}+|{_WS}+$', '', 'g')"


def sql_digits(tag: str, start: int, key: str = "doc_id::VARCHAR") -> str:
    return f"cast('0x' || substr(md5('{tag}|' || {key}), {start}, 4) as int)"


def sql_vote(tag: str, lo: int, truth: str, classes: int, key: str = "doc_id::VARCHAR") -> str:
    return (f"cast(case when {sql_digits(tag, 1, key)} < {lo} then {truth} "
            f"when {sql_digits(tag, 1, key)} < 64500 then "
            f"({truth} + 1 + {sql_digits(tag, 5, key)} % {classes - 1}) % {classes} else -1 end as int)")


def sql_conf(tag: str, key: str = "doc_id::VARCHAR") -> str:
    return f"(({sql_digits(tag, 9, key)} + 1) / 65536e0)"


_GT0 = "cast(case lang when 'de' then 0 when 'en' then 1 when 'es' then 2 else 3 end as int)"

# v: wide votes.  long: one row per vote with its seat.  tally: label counts per document.
# res: mode, its count and the number of labels that share the top count.
VOTES_SQL = f"""
d0 AS (SELECT doc_id, text, source AS dataset, md5({sql_strip('text')}) AS text_id,
              cast(length(text) as int) AS text_len, {_GT0} AS gt0,
              printf('2026-01-%02d_08-00-00', {sql_digits('run', 1)} % 5 + 1) AS run_id
       FROM documents),
v AS (SELECT doc_id, text, text_id, text_len, dataset, run_id,
             case when doc_id % 50 <> 0 then gt0 end AS ground_truth,
             {', '.join(f"{sql_vote(m, lo, 'gt0', 4)} AS {m}, {sql_conf(m)} AS {m}_conf" for m, lo in ANNOTATORS.items())}
      FROM d0),
long AS (SELECT doc_id, 1 AS seat, 'ann_a' AS annotator, ann_a AS label, ann_a_conf AS conf, ground_truth, dataset FROM v
         UNION ALL SELECT doc_id, 2, 'ann_b', ann_b, ann_b_conf, ground_truth, dataset FROM v
         UNION ALL SELECT doc_id, 3, 'ann_c', ann_c, ann_c_conf, ground_truth, dataset FROM v),
tally AS (SELECT doc_id, label, count(*) AS n, min(seat) AS first_seat FROM long GROUP BY doc_id, label),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first_seat) AS rk,
                  max(n) OVER (PARTITION BY doc_id) AS top FROM tally),
res AS (SELECT doc_id, cast(count(*) as int) AS labels, cast(max(top) as int) AS top,
               max(case when rk = 1 then label end) AS mode,
               count(*) FILTER (WHERE n = top) AS leaders,
               abs(sum(-(n / 3e0) * log2(n / 3e0))) AS entropy
        FROM ranked GROUP BY doc_id),
c AS (SELECT v.*, res.labels, res.top, res.mode, res.top / 3e0 AS score, res.leaders > 1 AS tied, res.entropy,
             case when res.top / 3e0 >= 0.8 then 'high' when res.top / 3e0 >= 0.6 then 'medium' else 'low' end AS lvl
      FROM v JOIN res USING (doc_id))
"""


def with_votes(select: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([VOTES_SQL, *ctes]) + "\n" + select
