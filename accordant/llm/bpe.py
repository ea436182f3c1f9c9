"""Byte-level BPE over whole documents, long ones in overlapping chunks.

A long text is cut into chunks that overlap; each chunk is pre-tokenised by itself, in parallel.
A scan that starts inside a pre-token falls into step again soon: the first boundary that a chunk
and its predecessor share in the overlap is a true one, and from it on both scans agree.  The
text is cut there and the pieces are encoded, again in parallel.  Where an overlap holds no shared
boundary (one pre-token covers it), the piece simply goes on to the text's end.
"""

from __future__ import annotations

import hashlib

import numpy as np
import regex
from pyspark.sql import Column, DataFrame, Window, functions as F

from accordant.llm.common import arrow_map, whole_text
from accordant.llm.tokens import byte_level, packed
from accordant.sources.workspace import stored

#: Code points before a chunk's end within which a boundary could still move: the pattern's longest contraction and one more.
_UNSURE = 4


def _starts(pattern: str, text: str) -> list[int]:
    return [m.start() for m in regex.finditer(pattern, text)]


def chunk_count(n: Column, chunk: int, overlap: int) -> Column:
    return F.greatest(F.lit(1), F.ceil((n - overlap) / chunk)).cast("int")


def chunks_of(rows: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """(key, i, part): the overlapping chunks of each (key, text)."""
    number = chunk_count(F.char_length("text"), chunk, overlap)
    parts = F.transform(F.sequence(F.lit(0), number - 1), lambda i: F.substring(F.col("text"), i * chunk + 1, F.lit(chunk + overlap)))
    return rows.select("key", F.posexplode(parts).alias("i", "part"))


def stitches(chunks: DataFrame, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """(key, i, piece, a, b): the stretch [a, b) of chunk i that belongs to a piece; null b is the chunk's end.

    A piece begins at a chunk's first boundary that its predecessor shares, and is numbered by that
    chunk.  After a chunk without one, nothing is known any more and the piece goes on.
    """

    def scan(columns: dict[str, list]) -> dict[str, list]:
        head, tail = [], []
        for part in columns["part"]:
            sure = [s for s in _starts(pattern, part) if s <= len(part) - _UNSURE]
            head.append([s for s in sure if s <= overlap])
            tail.append([s - chunk for s in sure if s >= chunk])
        return {"key": columns["key"], "i": columns["i"], "head": head, "tail": tail}

    # Chunks of one text go to different tasks; only boundaries in the overlaps move on.
    seen = arrow_map(chunks.repartition(F.xxhash64("key", "i")), scan, "key binary, i int, head array<int>, tail array<int>", rows=16)
    order = Window.partitionBy("key").orderBy("i")
    at = F.array_min(F.array_intersect(F.lag("tail").over(order), F.col("head")))
    joined = seen.dropDuplicates(["key", "i"]).select("key", "i", F.when(F.col("i") == 0, 0).otherwise(at).alias("at"))
    unbroken = F.min(F.col("at").isNotNull()).over(order)
    sound = joined.select("key", "i", F.when(unbroken, F.col("at")).alias("at"))
    piece = F.max(F.when(F.col("at").isNotNull(), F.col("i"))).over(order)
    last = F.lead("i").over(order).isNull()
    end = F.when(~last, chunk + F.coalesce(F.lead("at").over(order), F.lit(0)))
    return sound.select("key", "i", piece.alias("piece"), F.coalesce("at", F.lit(0)).alias("a"), end.alias("b"), (F.lead("at").over(order).isNull() & ~last).alias("open"))


def encode(docs: DataFrame, *, vocabulary: str = "byte_bpe_multi_50k.tiktoken", id_col: str = "doc_id", text_col: str = "text",
           chunk: int = 16_384, overlap: int = 512) -> DataFrame:
    """(id, ids) per row: ``ids`` packs the tokens as little-endian unsigned 32-bit integers.

    Null texts are empty and have no ids; repeated rows are returned as often, rows without an id too;
    other columns are left out.
    """
    if overlap <= 2 * _UNSURE or chunk <= overlap:
        raise ValueError("a chunk must be longer than its overlap, and that longer than 8")
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"))
    is_long = chunk_count(F.char_length("text"), chunk, overlap) > 1

    def plain(columns: dict[str, list]) -> dict[str, list]:
        return {"id": columns["id"], "ids": [packed(byte_level(vocabulary).encode(t)) for t in columns["text"]]}

    short = arrow_map(rows.filter(~is_long), plain, f"id {kind}, ids binary", rows=64)

    # Id and text behind the id's length, so that no two rows share a key; -1 marks a missing id.
    name = F.col("id").cast("string")
    named = F.concat(F.coalesce(F.length(name), F.lit(-1)).cast("string"), F.lit(":"), F.coalesce(name, F.lit("")), "text")
    keyed = rows.filter(is_long).withColumn("key", F.unhex(F.sha2(named, 256)))
    chunks = chunks_of(keyed, chunk, overlap)
    known = stored(stitches(chunks, byte_level(vocabulary).pattern, chunk, overlap), "stitches")
    cut = F.substring(F.col("part"), F.col("a") + 1, F.coalesce(F.col("b") - F.col("a"), F.char_length("part")))
    # The stitches are the narrow side of the join; hashing them spares a sort of the chunks.
    slices = chunks.join(known.hint("shuffle_hash"), ["key", "i"]).select("key", "i", "piece", "open", cut.alias("text"))

    def piece(columns: dict[str, list]) -> dict[str, list]:
        return {"key": columns["key"], "piece": columns["piece"], "ids": [packed(byte_level(vocabulary).encode(t)) for t in columns["text"]]}

    # Nearly every piece lies in one chunk; one that goes on is put together first.
    one = slices.filter(~F.col("open") & (F.col("piece") == F.col("i"))).select("key", "piece", "text")
    several = slices.filter(F.col("open") | (F.col("piece") != F.col("i"))).groupBy("key", "piece").agg(F.array_sort(F.collect_set(F.struct("i", "text"))).alias("s"))
    several = several.select("key", "piece", F.array_join(F.col("s.text"), "").alias("text"))
    coded = arrow_map(one.unionByName(several), piece, "key binary, piece int, ids binary", rows=16)
    whole = coded.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("piece", "ids"))).alias("parts"))
    whole = whole.select("key", F.aggregate("parts", F.lit(b""), lambda done, p: F.concat(done, p["ids"])).alias("ids"))
    long = keyed.select("id", "key").join(whole, "key").select("id", "ids")
    return short.unionByName(long).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, *, vocabulary: str = "byte_bpe_multi_50k.tiktoken", id_col: str = "doc_id") -> DataFrame:
    """(id, bytes): the raw bytes of each row's packed ``ids``, one after the other; null ids are none."""
    kind = encoded.schema[id_col].dataType.simpleString()

    def one(columns: dict[str, list]) -> dict[str, list]:
        return {"id": columns["id"], "bytes": [byte_level(vocabulary).decode_packed(i or b"") for i in columns["ids"]]}

    out = arrow_map(encoded.select(F.col(id_col).alias("id"), "ids"), one, f"id {kind}, bytes binary", rows=64)
    return out.withColumnRenamed("id", id_col)


def digests(encoded: DataFrame, *, vocabulary: str = "byte_bpe_multi_50k.tiktoken", id_col: str = "doc_id") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of packed ``ids``; the ids are decoded for the last."""
    kind = encoded.schema[id_col].dataType.simpleString()

    def one(columns: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"id": columns["id"], "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for ids in columns["ids"]:
            out["n_tokens"].append(len(ids) // 4)
            numbers = np.frombuffer(ids, dtype="<u4").tolist()
            out["ids_sha256"].append(hashlib.sha256(",".join(map(str, numbers)).encode()).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(byte_level(vocabulary).decode(numbers)).hexdigest())
        return out

    rows = encoded.select(F.col(id_col).alias("id"), F.coalesce("ids", F.lit(b"")).alias("ids"))
    return arrow_map(rows, one, f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string", rows=64).withColumnRenamed("id", id_col)
