"""Best-fit packing of token pieces after dominance reduction.

Only lengths decide a packing, and there are at most ``capacity`` of them: Spark counts the pieces
of each length, the driver packs the counts (never the pieces), and each piece finds its place
from its rank within its length.

Reduction (Martello and Toth): a small set that holds the longest open piece and dominates every
alternative is fixed for good.  A set dominates another if the other's pieces can be dealt to
its own so that none exceeds the piece it replaces.  What no rule fixes is packed best-fit by
falling length.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from accordant.llm.common import arrow_map, whole_text
from accordant.llm.tokens import byte_level, packed
from accordant.sources.workspace import stored

#: A packed form: ((length, times), ...) in order of place, and how many sequences have it.
Pattern = tuple[tuple[tuple[int, int], ...], int]


def reduce_dominated(counts: dict[int, int], capacity: int) -> tuple[list[Pattern], dict[int, int]]:
    """Sets fixed by dominance, and the counts left for best fit."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] += n
    fixed: list[Pattern] = []

    def smallest(k: int, without: int) -> list[int]:
        """The k smallest open pieces beside one of length ``without``."""
        out: list[int] = []
        left[without] -= 1
        for length in np.flatnonzero(left):
            out += [int(length)] * int(min(left[length], k - len(out)))
            if len(out) >= k:
                break
        left[without] += 1
        return out

    def best_pair(room: int, without: int) -> int:
        """The largest sum of two open pieces within ``room``."""
        left[without] -= 1
        open_ = np.flatnonzero(left)
        most, i, j = 0, 0, len(open_) - 1
        while i <= j:
            a, b = int(open_[i]), int(open_[j])
            if a + b > room or (i == j and left[a] < 2):
                j -= 1
            else:
                most = max(most, a + b)
                i += 1
        left[without] += 1
        return most

    for length in range(capacity, 0, -1):
        while left[length] > 0:
            room = capacity - length
            left[length] -= 1
            fits = np.flatnonzero(left[: room + 1])
            left[length] += 1
            if not len(fits):
                fixed.append((((length, 1),), int(left[length])))
                left[length] = 0
                break
            partner = int(fits[-1])
            small = smallest(3, length)
            alone = len(small) < 2 or small[0] + small[1] > room  # one more piece fits at most
            two = len(small) < 3 or sum(small) > room  # two more at most
            if not (partner == room or alone or (two and best_pair(room, length) <= partner)):
                break
            n = int(left[length] // 2 if partner == length else min(left[length], left[partner]))
            fixed.append((((length, 2),) if partner == length else ((length, 1), (partner, 1)), n))
            left[length] -= n
            left[partner] -= n
    return fixed, {int(v): int(left[v]) for v in np.flatnonzero(left)}


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best fit by falling length; equal sequences are filled together."""
    open_: dict[int, list[Pattern]] = defaultdict(list)  # by room left
    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            room = next((r for r in range(length, capacity + 1) if open_[r]), None)
            form, many = ((), n) if room is None else open_[room].pop()
            room = capacity if room is None else room
            times = min(room // length, n)
            full = min(many, n // times)
            if many > full and form:
                open_[room].append((form, many - full))
            open_[room - times * length].append(((*form, (length, times)), full))
            n -= full * times
    return [p for groups in open_.values() for p in groups]


def slots(patterns: list[Pattern]) -> pd.DataFrame:
    """Rows (length, first rank, first sequence, times, offset): the piece of rank first + i stands in
    sequence + i // times at offset + (i % times) * length."""
    rank: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for form, many in patterns:
        offset = 0
        for length, times in form:
            rows.append((length, rank[length], sequence, times, offset))
            rank[length] += times * many
            offset += times * length
        sequence += many
    return pd.DataFrame(rows, columns=["length", "first", "sequence", "times", "offset"]).sort_values(["length", "first"], ignore_index=True)


def plan(counts: dict[int, int], capacity: int) -> pd.DataFrame:
    """Places for all pieces of these lengths; its size depends on the number of lengths only."""
    fixed, rest = reduce_dominated(counts, capacity)
    return slots(fixed + best_fit(rest, capacity))


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: full ones, after a first that may be shorter."""
    head = n % capacity or min(n, capacity)
    return [(0, head), *((s, capacity) for s in range(head, n, capacity))]


#: Fixed value: the added token of the 50k byte-level vocabulary, which its rank file does not hold.
ADDED = {"<|endoftext|>": 50256}


def pieces(docs: DataFrame, *, capacity: int = 2048, vocabulary: str = "byte_bpe_50k.tiktoken", added: dict[str, int] = ADDED, end_id: int = 0,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32) of every document, its end id included.

    Strings of ``added`` in a text are their ids, as in the tokenizers library.  Rows without an id and repeated ids
    are each cut.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def one(columns: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in ("id", "piece", "start", "length", "ids_crc32")}
        for i, text in zip(columns["id"], columns["text"]):
            ids = packed([*byte_level(vocabulary).encode_with(text, added), end_id])
            for piece, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                for name, v in zip(out, (i, piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]))):
                    out[name].append(v)
        return out

    rows = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"))
    out = arrow_map(rows, one, f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint", rows=64)
    return out.withColumnRenamed("id", id_col)


def pack(pieces: DataFrame, *, capacity: int = 2048, bucket_rows: int = 20_000) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to a stored table of pieces with a ``length`` of 1 to ``capacity``.

    Ranks within a length are counted by hash buckets of about ``bucket_rows`` rows, so one length that
    holds a third of all pieces is ranked by many tasks.  Equal rows get different places.  An empty
    table gives an empty table; a null or other length is an error.
    """
    spark = pieces.sparkSession
    total = pieces.count()
    bad = pieces.filter(F.col("length").isNull() | ~F.col("length").between(1, capacity)).limit(1).count()
    if bad:
        raise ValueError(f"lengths must be from 1 to {capacity}")
    names = pieces.columns
    buckets = max(1, -(-total // bucket_rows))
    keyed = pieces.withColumn("__bucket", F.pmod(F.xxhash64(*names), F.lit(buckets)))
    sizes = keyed.groupBy("length", "__bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = stored(sizes.withColumn("__base", F.coalesce(F.sum("n").over(before), F.lit(0))), "piece-counts")
    counts = {int(r.length): int(r.n) for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = spark.sparkContext.broadcast(plan(counts, capacity))
    within = Window.partitionBy("length", "__bucket").orderBy(*names)
    ranked = keyed.withColumn("__row", F.row_number().over(within) - 1).join(sizes.drop("n"), ["length", "__bucket"])
    ranked = ranked.select(*names, (F.col("__base") + F.col("__row")).alias("__rank"))

    def place(columns: dict[str, list]) -> dict[str, list]:
        at = places.value
        length, rank = np.array(columns["length"]), np.array(columns.pop("__rank"))
        scale = np.int64(1) << 44
        row = np.searchsorted(at["length"].to_numpy() * scale + at["first"].to_numpy(), length * scale + rank, side="right") - 1
        found = at.iloc[row]
        i, times = rank - found["first"].to_numpy(), found["times"].to_numpy()
        return columns | {"sequence_id": found["sequence"].to_numpy() + i // times, "offset": found["offset"].to_numpy() + i % times * length}

    schema = ", ".join(f"`{c}` {t}" for c, t in pieces.dtypes)
    return arrow_map(ranked, place, f"{schema}, sequence_id bigint, offset bigint", rows=8192)


def pack_documents(docs: DataFrame, *, capacity: int = 2048, **options) -> DataFrame:
    """Encode, cut and pack whole documents; null texts are empty and still hold their end id."""
    return pack(stored(pieces(docs, capacity=capacity, **options), "pieces"), capacity=capacity)
