"""Exact duplicates of an incoming batch against an immutable snapshot.

The snapshot's distinct digests are dealt into buckets by digest prefix, and each bucket gets
a static binary fuse filter.  Incoming digests are first grouped among themselves, so the
copies within a batch meet the filters once; a filter's positives are joined with the exact
digests of its bucket, and what is left is compared by its bytes.

Bounds: digests are uniform, so a bucket holds about ``bucket_keys`` keys at any input size
(the number of buckets is taken from the counts).  Copies are combined before each shuffle, so
a text that makes up a third of all rows is one row per task.  Texts move only for rows that
have a partner.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from accordant.llm.common import ascii_lower, whole_text
from accordant.llm.fuse import build, probe
from accordant.operators.joins import distinct_keys
from accordant.sources.workspace import stored

FILTER = "bucket int, seed int, length int, segments int, prints binary"


def sha256_digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _keys(digests: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(bytes(d)[8:16].ljust(8, b"\0") for d in digests), dtype=np.uint64)


def build_filters(digests: DataFrame) -> DataFrame:
    """One filter per bucket from (bucket, digest) rows with distinct digests."""

    def one(group: pd.DataFrame) -> pd.DataFrame:
        seed, length, segments, prints = build(_keys(group["digest"]))
        return pd.DataFrame({"bucket": group["bucket"].iloc[:1], "seed": seed, "length": length, "segments": segments, "prints": [prints]})

    return digests.select("bucket", "digest").groupBy("bucket").applyInPandas(one, FILTER)


def screen(incoming: DataFrame, filters: DataFrame) -> DataFrame:
    """The (bucket, digest) rows that their bucket's filter may hold."""

    def one(group: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        if not len(found) or not len(group):
            return group.iloc[:0]
        f = found.iloc[0]
        return group[probe(_keys(group["digest"]), int(f.seed), int(f.length), int(f.segments), f.prints)]

    return incoming.select("bucket", "digest").groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInPandas(one, "bucket int, digest binary")


def duplicates(docs: DataFrame, in_snapshot: Column, *, id_col: str = "doc_id", text_col: str = "text",
               normalise=ascii_lower, digest=sha256_digest, bucket_keys: int = 16_384) -> DataFrame:
    """Group equal texts of a snapshot and the batch that follows it.

    ``in_snapshot`` tells the two apart (null: batch).  Texts are equal if they are the same bytes
    after ``normalise``; a null text is an empty one.  Of a group the largest id stays.  Returns one
    row per input row: id, ``digest``, ``keep_id``, ``group_size``, ``kept``.  Repeated ids are repeated
    rows: each counts, and each is marked.  Rows without an id count too and give way to rows with one; of a
    group without any id ``keep_id`` is null and all rows are kept, as they cannot be told apart.  Other columns of
    ``docs`` are ignored.
    """
    base = docs.select(F.col(id_col).alias("__id"), normalise(whole_text(text_col)).alias("__text"), F.coalesce(in_snapshot, F.lit(False)).alias("__old"))
    rows = stored(base.select("__id", digest(F.col("__text")).alias("digest"), "__old"), "digests")
    n = rows.count()
    buckets = max(8, -(-n // bucket_keys))
    bucket = F.pmod(F.hash("digest"), F.lit(buckets)).cast("int").alias("bucket")
    groups = rows.groupBy("digest", "__old").agg(F.count(F.lit(1)).alias("n")).select("digest", "__old", "n", bucket)
    old, new = groups.filter("__old"), groups.filter("not __old")
    maybe = screen(new, build_filters(old))
    across = maybe.select("digest").join(old.select("digest"), "digest", "left_semi")
    within = groups.filter("n > 1").select("digest")
    partnered = distinct_keys(across.unionByName(within), "digest")
    members = rows.join(partnered, "digest", "left_semi").select("__id", "digest")
    # Byte check: the whole text is part of the key, so equal digests of unlike texts stay apart.
    asked = distinct_keys(members, "__id").withColumnRenamed("__id", "__asked")
    texts = base.select("__id", "__text").join(asked, F.col("__id").eqNullSafe(F.col("__asked")), "left_semi")
    # A repeated id may carry several texts, so the digest is taken from the text itself.
    texts = texts.select("__id", "__text", digest(F.col("__text")).alias("digest"))
    exact = texts.groupBy("digest", "__text").agg(F.max("__id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    exact = stored(exact, "exact")
    shared = stored(exact.groupBy("digest").agg(F.count(F.lit(1)).alias("v")).filter("v > 1").select("digest"), "shared-digests")
    if shared.isEmpty():
        out = rows.select("__id", "digest").join(exact.select("digest", "keep_id", "group_size"), "digest", "left")
    else:
        single = exact.join(shared, "digest", "left_anti").select("digest", "keep_id", "group_size")
        plain = rows.join(shared, "digest", "left_anti").select("__id", "digest").join(single, "digest", "left")
        apart = texts.join(exact.join(shared, "digest", "left_semi"), ["digest", "__text"]).select("__id", "digest", "keep_id", "group_size")
        out = plain.unionByName(apart)
    # Rows without a partner have no group here; a group without any id has no id to keep.
    keep = F.when(F.col("group_size").isNull(), F.col("__id")).otherwise(F.col("keep_id"))
    return out.select(F.col("__id").alias(id_col), "digest", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), keep.eqNullSafe(F.col("__id")).alias("kept"))
