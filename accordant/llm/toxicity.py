"""Toxic passages by maximum-scoring segments of token log-odds.

Training counts tokens by label over all labelled rows (Spark adds the partial counts of the
tasks).  A token's score is its log-odds of standing in a toxic text, smoothed by a Dirichlet
prior: words shrink towards their first letters, and those towards the base rate, so that a
rare form of a known stem is scored too.  In a text, a linear scan finds every maximal scoring
segment.  Scores follow the extreme-value law of such maxima (Karlin and Altschul): with the
rate and scale measured on clean training texts, each segment gets an expected number of equally
good ones by chance, and a text is summed up over its significant segments.

Bounds: tokens live in ``2 ** bits`` hash slots, so the counts that reach the driver and the table
that goes to the tasks are 2 ** bits rows at any vocabulary.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from accordant.llm.common import arrow_filter, arrow_map, fit_sample, whole_text

WORD = re.compile(r"[^\W\d_]+")
STEM = 5
_SLOTS: dict[int, dict[str, tuple[int, int]]] = {}


def slots_of(words: list[str], bits: int, room: int = 200_000) -> np.ndarray:
    """Slots of each word and of its stem, (n, 2).  The dictionary only saves hashing."""
    known = _SLOTS.setdefault(bits, {})
    if len(known) > room:
        known.clear()
    mask = (1 << bits) - 1
    for w in set(words).difference(known):
        known[w] = zlib.crc32(w.encode()) & mask, zlib.crc32(b"^" + w[:STEM].encode()) & mask
    return np.array([known[w] for w in words], dtype=np.int64).reshape(-1, 2)


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def token_counts(labelled: DataFrame, *, bits: int = 20) -> DataFrame:
    """(slot, toxic, clean) from (text, toxic) rows: in how many texts of each label a token stands."""

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = 1 << bits
        sums = np.zeros((2, size), dtype=np.int64)
        for batch in it:
            for start in range(0, batch.num_rows, 64):
                cols = batch.slice(start, 64).to_pydict()
                for toxic in (0, 1):
                    words = [w for t, y in zip(cols["text"], cols["toxic"]) if y == toxic for w in set(words_of(t))]
                    if words:
                        sums[toxic] += np.bincount(slots_of(words, bits).ravel(), minlength=size)
        used = np.flatnonzero(sums.any(axis=0))
        for part in np.array_split(used, max(1, len(used) // 50_000)):
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(sums[1][part]), pa.array(sums[0][part])], names=["slot", "toxic", "clean"])

    rows = labelled.mapInArrow(count, "slot bigint, toxic bigint, clean bigint")
    return rows.groupBy("slot").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def dense_counts(counts: DataFrame, bits: int) -> np.ndarray:
    """(2, slots) array of clean and toxic counts: the tasks pack their rows, so the driver gets bytes, 12 a slot."""

    def pack(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            packed = [batch.column(c).to_numpy().astype(kind).tobytes() for c, kind in (("slot", "<u4"), ("clean", "<f4"), ("toxic", "<f4"))]
            yield pa.RecordBatch.from_arrays([pa.array([p], type=pa.binary()) for p in packed], names=["slot", "clean", "toxic"])

    out = np.zeros((2, 1 << bits), dtype=np.float32)
    for r in counts.mapInArrow(pack, "slot binary, clean binary, toxic binary").collect():
        slot = np.frombuffer(r["slot"], dtype="<u4")
        out[0, slot], out[1, slot] = np.frombuffer(r["clean"], dtype="<f4"), np.frombuffer(r["toxic"], dtype="<f4")
    return out


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), left to right, in linear time.

    Runs of tokens of one sign are joined first; then the list of candidates is kept so that
    each candidate's left sum is the least since the one it could join with.
    """
    if not len(scores):
        return []
    positive = scores > 0
    if not positive.any():
        return []
    starts = np.flatnonzero(np.concatenate([[True], positive[1:] != positive[:-1]]))
    sums = np.add.reduceat(scores, starts)
    ends = np.append(starts[1:], len(scores))
    total, kept = 0.0, []  # kept: [start, end, sum before, sum after, index of the nearest one with a smaller sum before]
    for a, b, s in zip(starts.tolist(), ends.tolist(), sums.tolist()):
        if s <= 0:
            total += s
            continue
        start, left, total = a, total, total + s
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= left:
                j = kept[j][4]
            if j < 0 or kept[j][3] >= total:
                kept.append((start, b, left, total, j))
                break
            start, left = kept[j][0], kept[j][2]
            del kept[j:]
    return [(a, b, right - left) for a, b, left, right, _ in kept]


@dataclass
class Model:
    bits: int
    counts: np.ndarray  #: (2, slots): clean and toxic counts
    base: float  #: share of toxic tokens
    prior: float = 10.0
    floor: float = -1.0
    drift: float = 1.0
    rate: float = 1.0
    log_scale: float = 0.0
    weights: np.ndarray = field(default_factory=lambda: np.array([-4.0, 1.0, 0.0, 0.0]))
    known: dict[str, float] = field(default_factory=dict, repr=False)

    def slot_scores(self, slots: np.ndarray, clean_less: np.ndarray | int = 0, toxic_less: np.ndarray | int = 0) -> np.ndarray:
        """Smoothed log-odds less the drift, of (word, stem) slots; the ``less`` are taken from their counts first."""
        clean, toxic = self.counts[0][slots] - clean_less, self.counts[1][slots] - toxic_less
        stem = (toxic[:, 1] + self.prior * self.base) / (toxic[:, 1] + clean[:, 1] + self.prior)
        p = (toxic[:, 0] + self.prior * stem) / (toxic[:, 0] + clean[:, 0] + self.prior)
        p = np.clip(p, 1e-9, 1 - 1e-9)
        return np.maximum(np.log(p / (1 - p)) - math.log(self.base / (1 - self.base)), self.floor) - self.drift

    def token_scores(self, text: str, room: int = 200_000) -> np.ndarray:
        words = words_of(text)
        if len(self.known) > room:
            self.known.clear()
        new = list(set(words).difference(self.known))
        if new:
            self.known.update(zip(new, self.slot_scores(slots_of(new, self.bits)).tolist()))
        return np.fromiter(map(self.known.__getitem__, words), dtype=float, count=len(words))

    def own_scores(self, text: str, toxic: int) -> np.ndarray:
        """Token scores of a text that was counted under a label, as they would be had it not been."""
        words = words_of(text)
        if not words:
            return np.zeros(0)
        distinct = sorted(set(words))
        slots = slots_of(distinct, self.bits)
        _, at, n = np.unique(slots, return_inverse=True, return_counts=True)
        own = n[at].reshape(-1, 2)
        found = dict(zip(distinct, self.slot_scores(slots, own * (toxic == 0), own * (toxic == 1)).tolist()))
        return np.fromiter(map(found.__getitem__, words), dtype=float, count=len(words))

    def passages(self, text: str, least: float = 3.0, toxic: int | None = None) -> list[tuple[int, int, float]]:
        """Segments (first word, end word, v) where exp(-v) equally good ones are expected by chance, v > ``least``.

        ``toxic`` is the label of a text that was counted.
        """
        scores = self.token_scores(text) if toxic is None else self.own_scores(text, toxic)
        shift = self.log_scale + math.log(max(len(scores), 1))
        return [(a, b, v) for a, b, s in segments(scores) if (v := self.rate * s - shift) > least]

    def features(self, text: str, toxic: int | None = None) -> tuple[float, float, float]:
        """Best segment, sum over the significant segments, and their number."""
        found = [v for *_, v in self.passages(text, least=-1e9, toxic=toxic)]
        strong = [v for v in found if v > 3.0]
        return max([-5.0, *found]), math.log1p(sum(strong)), math.log1p(len(strong))

    def score(self, features) -> np.ndarray:
        z = self.weights[0] + np.asarray(features, dtype=float).reshape(-1, 3) @ self.weights[1:]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def chance_rate(scores: np.ndarray, weights: np.ndarray) -> float:
    """The positive root of sum(weight * exp(rate * score)) = 1; the mean score must be negative."""
    p = weights / weights.sum()
    low, high = 1e-3, 1.0
    value = lambda r: np.log(np.dot(p, np.exp(np.minimum(r * scores, 500))))
    if scores.max() <= 0:
        return 1.0
    while value(high) < 0 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if value(mid) < 0 else (low, mid)
    return high


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, steps: int = 50) -> np.ndarray:
    """Weights (intercept first) of a ridge logistic regression, by Newton's method."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    ridge = np.diag([1e-6] + [penalty] * (a.shape[1] - 1))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p) + 1e-9)[:, None]) + ridge, a.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(labelled: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", bits: int = 20,
          max_rows: int = 4_000, **options) -> Model:
    """Fit on labelled rows; rows without a label are left out, null texts are empty.

    Token counts cover every labelled row.  Extreme-value scale and final weights are fitted on the
    ``max_rows`` rows of smallest id hash, as (words, features) rows, never texts; each of these is scored as if it had
    not been counted itself, as a new text would be.  Without both labels
    among the rows the counts alone decide.
    """
    rows = labelled.filter(F.col(label_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), whole_text(text_col).alias("text"), F.col(label_col).cast("int").alias("toxic"))
    table = dense_counts(token_counts(rows.select("text", "toxic"), bits=bits), bits)
    model = Model(bits, table, float((table[1].sum(dtype=float) + 1) / (table.sum(dtype=float) + 2)), **options)
    spark = labelled.sparkSession
    first = spark.sparkContext.broadcast(model)

    def clean_scores(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A histogram of token scores and, per text, words and the raw best segment."""
        for batch in it:
            for start in range(0, batch.num_rows, 64):
                cols = batch.slice(start, 64).to_pydict()
                out: dict[str, list] = {"toxic": [], "words": [], "best": [], "bins": []}
                for text, y in zip(cols["text"], cols["toxic"]):
                    s = first.value.own_scores(text, y)
                    out["toxic"].append(y)
                    out["words"].append(len(s))
                    out["best"].append(max((v for *_, v in segments(s)), default=0.0))
                    out["bins"].append(np.bincount(np.clip((s + 2) * 10, 0, 255).astype(np.int64), minlength=256).tolist())
                yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("toxic", pa.int32()), ("words", pa.int64()), ("best", pa.float64()), ("bins", pa.list_(pa.int64()))]))

    sample = fit_sample(rows, "id", max_rows).select("text", "toxic")
    seen = sample.mapInArrow(clean_scores, "toxic int, words bigint, best double, bins array<bigint>").toPandas()
    first.destroy()
    if len(seen) and (seen["toxic"] == 0).any():
        clean = seen[(seen["toxic"] == 0) & (seen["words"] > 0)]
        bins = np.sum(np.stack(clean["bins"]), axis=0) if len(clean) else np.ones(256)
        model.rate = chance_rate(np.arange(256) / 10 - 2 + 0.05, bins.astype(float))
        if len(clean):
            model.log_scale = float(np.mean(model.rate * clean["best"] - np.log(clean["words"])) - np.euler_gamma)
    if seen["toxic"].nunique() == 2:
        tuned = spark.sparkContext.broadcast(model)
        got = arrow_map(sample, lambda c: {"toxic": c["toxic"], **dict(zip(("a", "b", "c"), map(list, zip(*map(tuned.value.features, c["text"], c["toxic"])))))}, "toxic int, a double, b double, c double", rows=64).toPandas()
        tuned.destroy()
        model.weights = logistic(got[["a", "b", "c"]].to_numpy(), got["toxic"].to_numpy(dtype=float))
    return model


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted, segments) per row: ``segments`` lists each significant passage as first
    word, end word and -log of its expected number by chance.  Null and empty texts are scored too."""
    kind = docs.schema[id_col].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def one(columns: dict[str, list]) -> dict[str, list]:
        m = sent.value
        p = m.score([m.features(t) for t in columns["text"]])
        found = [[{"first": a, "end": b, "value": v} for a, b, v in m.passages(t)] for t in columns["text"]]
        return {"id": columns["id"], "score": p.tolist(), "predicted": (p >= 0.5).astype(int).tolist(), "segments": found}

    rows = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"))
    out = arrow_map(rows, one, f"id {kind}, score double, predicted int, segments array<struct<first:bigint,end:bigint,value:double>>", rows=64)
    return out.withColumnRenamed("id", id_col)


def reject(docs: DataFrame, model: Model, *, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows, all columns kept, whose text scores below ``threshold``; a null text is an empty one."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return arrow_filter(docs, text_col, lambda texts: (sent.value.score([sent.value.features(t or "") for t in texts]) < threshold).tolist())


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose labels are kept from training."""
    return F.crc32(F.col(id_col).cast("string")) % 5 == 0
