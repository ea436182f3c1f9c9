"""Vector codes: each part of a vector becomes the number of its nearest codebook entry, found by Orchard's search.

For every entry of a codebook the other entries are listed by distance.  The search for a point starts at one
entry and goes down that entry's list; an entry that is nearer (or as near, with a smaller number) becomes the
current one and its own list is taken up from the start.  Entries seen are marked and not measured again.  By the
triangle inequality no entry farther from the current one than twice the current distance can be nearer, so the
list ends there.  All arithmetic is on integers, so results do not depend on partitions or order.

Codebooks are trained in rounds: tasks add up the parts that fall to each entry, Spark adds the tasks' sums, and only
those sums (entries x vector length) reach the driver.  Vectors are written to the shared folder once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from accordant.llm.common import finite, floored, of_one_length
from accordant.operators.joins import rejoin_keys
from accordant.sources.workspace import stored


class Orchard:
    """Exact nearest entries of one codebook, (entries, width) integers; ties to the smaller number."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.between = ((entries[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)
        self.lists = np.argsort(self.between, axis=1, kind="stable")

    def nearest(self, x: np.ndarray, start: int = 0) -> tuple[np.ndarray, np.ndarray, int]:
        """(entry, squared distance) of each row of ``x``, and how many distances were measured.

        All rows walk at once; each has its own current entry, place in that entry's list and marks.
        """
        n, k = len(x), len(self.entries)
        current = np.full(n, start, dtype=np.int64)
        best = ((x - self.entries[start]) ** 2).sum(axis=1)
        seen = np.zeros((n, k), dtype=bool)
        seen[:, start] = True
        place = np.zeros(n, dtype=np.int64)
        walking, measured = np.arange(n), n
        while len(walking):
            walking = walking[place[walking] < k]
            entry = self.lists[current[walking], place[walking]]
            near = self.between[current[walking], entry] <= 4 * best[walking]
            walking, entry = walking[near], entry[near]
            place[walking] += 1
            new = ~seen[walking, entry]
            rows, entry = walking[new], entry[new]
            seen[rows, entry] = True
            measured += len(rows)
            d = ((x[rows] - self.entries[entry]) ** 2).sum(axis=1)
            better = (d < best[rows]) | ((d == best[rows]) & (entry < current[rows]))
            rows = rows[better]
            current[rows], best[rows], place[rows] = entry[better], d[better], 0
        return current, best, measured


@dataclass
class Codebooks:
    entries: np.ndarray  #: (parts, entries, width) integers

    def __post_init__(self):
        self.searches = [Orchard(e) for e in self.entries]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry per part, squared distance summed over parts) of each row."""
        found = [s.nearest(p) for s, p in zip(self.searches, np.split(x, len(self.entries), axis=1))]
        return np.stack([c for c, *_ in found], axis=1), sum(d for _, d, _ in found)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """The vectors that the codes stand for."""
        return np.concatenate([e[c] for e, c in zip(self.entries, codes.T)], axis=1)

    def digest(self) -> str:
        """sha256 of all components by part, entry and place, as decimals joined by commas."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, width)


def _slices(it: Iterator[pa.RecordBatch], rows: int = 4096) -> Iterator[pa.RecordBatch]:
    for batch in it:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def improved(vectors: DataFrame, books: Codebooks) -> Codebooks:
    """One round: every part goes to its nearest entry, which becomes the floored mean of its parts; unused ones stay."""
    parts, entries, width = books.entries.shape

    def add(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts, entries, width), dtype=np.int64), np.zeros((parts, entries), dtype=np.int64)
        for batch in _slices(it):
            x = _matrix(batch.column("v"), parts * width)
            codes, _ = books.encode(x)
            for p, own in enumerate(np.split(x, parts, axis=1)):
                np.add.at(sums[p], codes[:, p], own)
                counts[p] += np.bincount(codes[:, p], minlength=entries)
        p, e = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(p, width)), pa.array(np.repeat(e, width)), pa.array(np.tile(np.arange(width), len(p))),
             pa.array(sums[p, e].ravel()), pa.array(np.repeat(counts[p, e], width))], names=["part", "entry", "place", "total", "n"])

    rows = vectors.select("v").mapInArrow(add, "part bigint, entry bigint, place bigint, total bigint, n bigint")
    new = books.entries.copy()
    for r in rows.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
        new[r["part"], r["entry"], r["place"]] = r["total"] // r["n"]
    return Codebooks(new)


def integer_vectors(vectors: DataFrame, *, id_col: str, vector_col: str, scale: int, also: tuple[str, ...] = ()) -> DataFrame:
    """Written rows (id, ``also``, v) of the finite vectors of the usual length, as floored integers."""
    some = of_one_length(vectors.filter(finite(vector_col)), vector_col)
    return stored(some.select(F.col(id_col).alias("id"), *also, floored(vector_col, scale).alias("v")), "integer-vectors")


def train(integers: DataFrame, *, parts: int = 8, entries: int = 16, rounds: int = 6) -> Codebooks | None:
    """Codebooks of integer vectors (id, v), begun with the vectors of the ``entries`` smallest ids; None without rows.

    Equal ids are ordered by their vectors, null ids come last; fewer rows than ``entries`` make a smaller codebook.
    Raises ValueError if the length is not a multiple of ``parts``, or if squared distances could pass a long.
    """
    first = integers.orderBy(F.asc_nulls_last("id"), "v").select("v").limit(entries).collect()
    if not first:
        return None
    size = len(first[0]["v"])
    if not size or size % parts:
        raise ValueError(f"vectors of {size} components do not split into {parts} equal parts")
    # Largest magnitude first: floor can give -2^63, whose absolute value is no long.
    span = integers.select(F.max(F.array_max("v")), F.min(F.array_min("v"))).first()
    if 16 * size * max(abs(span[0]), abs(span[1])) ** 2 >= 1 << 63:
        raise ValueError("components are too large for squared distances in a long")
    x = np.array([r["v"] for r in first], dtype=np.int64)
    books = Codebooks(np.stack(np.split(x, parts, axis=1)))
    for _ in range(rounds):
        books = improved(integers, books)
    return books


def encode(integers: DataFrame, books: Codebooks, also: tuple[str, ...] = ()) -> DataFrame:
    """(id, ``also``, code, error): the entries' numbers, two hex digits a part, and the summed squared distances."""
    parts, _, width = books.entries.shape
    out_names = ["id", *also]

    def one(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(it):
            codes, error = books.encode(_matrix(batch.column("v"), parts * width))
            text = [c.tobytes().hex() for c in codes.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in out_names], pa.array(text), pa.array(error)], names=[*out_names, "code", "error"])

    kinds = ", ".join(f"`{c}` {integers.schema[c].dataType.simpleString()}" for c in out_names)
    return integers.select(*out_names, "v").mapInArrow(one, f"{kinds}, code string, error bigint")


def compress(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = 4096,
             parts: int = 8, entries: int = 16, rounds: int = 6) -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256), one row per vector kept.

    Vectors that are null or hold a null or non-finite component are left out, and so are those of another length
    than most.  Repeated rows and ids are each coded; null ids are coded and come last when the codebooks begin.
    ``label_error`` is the error summed over the rows of equal label, null labels together.  No rows give no rows;
    other columns are ignored.
    """
    if entries > 256:
        raise ValueError("a code has two hex digits a part, so at most 256 entries")
    source = vectors.select(F.col(id_col).alias("__id"), F.col(label_col).alias("__label"), F.col(vector_col).alias("__vector"))
    rows = integer_vectors(source, id_col="__id", vector_col="__vector", scale=scale, also=("__label",))
    books = train(rows, parts=parts, entries=entries, rounds=rounds)
    if books is None:
        return rows.select(F.col("id").alias(id_col), F.lit("").alias("code"), F.lit(0).cast("long").alias("error"),
                           F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    coded = stored(encode(rows, books, ("__label",)), "coded")
    # Grouped by label and hash, so that the join has its own exchange and a hot label can be split.
    per_label = coded.groupBy(*rejoin_keys("__label")).agg(F.sum("error").alias("label_error")).withColumnRenamed("__label", "__of").drop("__spread")
    out = coded.join(stored(per_label, "label-errors"), F.col("__label").eqNullSafe(F.col("__of")))
    return out.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
