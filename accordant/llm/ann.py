"""Approximate nearest neighbours by learned partitions, for the largest inner product.

On a bounded sample the neighbour graph is cut into parts of equal size; a linear softmax
classifier learns to tell a vector's part, with the parts of its neighbours as soft targets, and
so carries the partition to all vectors.  Every row is indexed in its most probable part; a query
goes to its several most probable ones and is ranked there by exact inner products.  How many
suffices is measured on the sample.

Bounds: the sample (``max_rows`` vectors) and the classifier are all that the driver holds.  A part is
split into blocks of ``block_rows`` vectors and its queries into chunks, so a part that draws a third of
all rows is many units of work; each unit returns at most k rows a query.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from accordant.llm.common import arrow_map, fit_sample
from accordant.sources.workspace import stored


def usable(vector: str | Column) -> Column:
    """Neither null, empty, zero nor holding a null or non-finite component."""
    v = F.col(vector) if isinstance(vector, str) else vector
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k largest inner products of each row with the others."""
    out = np.empty((len(x), k), dtype=np.int64)
    for start in range(0, len(x), 1024):
        s = x[start : start + 1024] @ x.T
        s[np.arange(len(s)), np.arange(start, start + len(s))] = -np.inf
        out[start : start + 1024] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def _halves(nodes: np.ndarray, a: np.ndarray, b: np.ndarray, rng: np.random.Generator, steps: int = 60, passes: int = 20) -> np.ndarray:
    """Which half each node is in: a spectral cut at the median, then gainful swaps.  a, b: edge ends, by place in nodes."""
    n = len(nodes)
    degree = np.maximum(np.bincount(a, minlength=n), 1).astype(float)
    root = np.sqrt(degree)
    trivial = root / np.linalg.norm(root)
    v = rng.standard_normal(n)
    for _ in range(steps):
        v -= trivial * (trivial @ v)
        v = v + np.bincount(a, weights=(v / root)[b], minlength=n) / root
        v /= np.linalg.norm(v) + 1e-12
    side = np.zeros(n, dtype=bool)
    side[np.argsort(v / root, kind="stable")[n // 2 :]] = True
    for _ in range(passes):
        across = np.bincount(a, weights=(side[a] != side[b]).astype(float), minlength=n)
        gain = 2 * across - np.bincount(a, minlength=n)
        left, right = np.flatnonzero(~side), np.flatnonzero(side)
        left, right = left[np.argsort(-gain[left], kind="stable")], right[np.argsort(-gain[right], kind="stable")]
        m = min(len(left), len(right))
        good = int(np.count_nonzero(gain[left[:m]] + gain[right[:m]] > 0)) // 2
        if not good:
            break
        side[left[:good]], side[right[:good]] = True, False
    return side


def balanced_parts(neighbours: np.ndarray, parts: int, seed: int = 1) -> np.ndarray:
    """Parts (a power of two) of equal size, up to one node, by recursive bisection of the graph."""
    n, k = neighbours.shape
    rng = np.random.default_rng(seed)
    ends = np.repeat(np.arange(n), k), neighbours.ravel()
    a, b = np.concatenate(ends), np.concatenate(ends[::-1])
    label = np.zeros(n, dtype=np.int64)
    groups = [np.arange(n)]
    while len(groups) < parts:
        new = []
        for nodes in groups:
            place = np.full(n, -1)
            place[nodes] = np.arange(len(nodes))
            own = (place[a] >= 0) & (place[b] >= 0)
            side = _halves(nodes, place[a[own]], place[b[own]], rng)
            new += [nodes[~side], nodes[side]]
        groups = new
    for i, nodes in enumerate(groups):
        label[nodes] = i
    return label


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit_classifier(x: np.ndarray, target: np.ndarray, steps: int = 300, rate: float = 0.05, decay: float = 1e-4) -> np.ndarray:
    """Weights (dimensions + 1, parts) of a softmax regression on soft targets, by Adam."""
    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros((a.shape[1], target.shape[1]))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        g = a.T @ (softmax(a @ w) - target) / len(a) + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


@dataclass
class Partitions:
    weights: np.ndarray
    scale: float
    probes: int

    @property
    def parts(self) -> int:
        return self.weights.shape[1]

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([x / self.scale, np.ones(len(x))]) @ self.weights

    def best(self, x: np.ndarray, k: int) -> np.ndarray:
        return np.argsort(-self.logits(x), axis=1, kind="stable")[:, :k]


def fit(vectors: DataFrame, *, id_col: str, vector_col: str, parts: int = 16, max_rows: int = 8_192, graph: int = 10, k: int = 20, recall: float = 0.93) -> Partitions:
    """Fit on the about ``max_rows`` usable rows of smallest id hash.

    ``probes`` is the least number of parts in which that share of the sample's true k neighbours
    (within the sample, over every fourth vector) is found.
    """
    sample = fit_sample(vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")), "id", max_rows)
    rows = sorted((tuple(r) for r in sample.collect()), key=lambda r: (r[0], tuple(r[1])))
    x = np.array([v for _, v in rows], dtype=float)
    if len(x) < 8 * parts:  # too few to learn from: one part holds all
        return Partitions(np.zeros(((x.shape[1] if len(x) else 0) + 1, 1)), 1.0, 1)
    scale = float(np.sqrt((x * x).sum(axis=1).mean()) / np.sqrt(x.shape[1]))
    near = neighbour_graph(x, min(graph, len(x) - 1))
    label = balanced_parts(near, parts)
    target = np.zeros((len(x), parts))
    np.add.at(target, (np.arange(len(x)), label), 1.0)
    for j in range(near.shape[1]):
        np.add.at(target, (np.arange(len(x)), label[near[:, j]]), 1.0)
    model = Partitions(fit_classifier(x / scale, target / target.sum(axis=1, keepdims=True)), scale, parts)
    probe = np.arange(0, len(x), 4)
    true = neighbour_graph(x, min(k, len(x) - 1))[probe]
    order = model.best(x[probe], parts)
    home = model.best(x, 1)[:, 0]
    rank = np.argsort(order, axis=1)  # of each part, per query
    need = np.take_along_axis(rank, home[true], axis=1)
    share = [(need < p).mean() for p in range(1, parts + 1)]
    model.probes = next((p for p, s in enumerate(share, 1) if s >= recall), parts)
    return model


def _top(queries: np.ndarray, q_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """The k best (query, id, score) per query, itself left out, ties to the smaller id.

    Products of the block choose who is near enough; the scores are then summed row by row, so that
    equal vectors get equal scores wherever they stand.
    """
    out = []
    for start in range(0, len(queries), 256):
        s = queries[start : start + 256] @ x.T
        for row, q, i in zip(s, queries[start : start + 256], q_ids[start : start + 256]):
            row[ids == i] = -np.inf
            edge = np.partition(row, len(row) - k)[len(row) - k] if len(row) > k else -np.inf
            near = np.flatnonzero((row >= edge - 1e-9 * max(1.0, abs(edge) if np.isfinite(edge) else 1.0)) & np.isfinite(row))
            score = (x[near] * q).sum(axis=1)
            best = np.lexsort((ids[near], -score))[:k]
            out += [(int(i), int(ids[near[j]]), float(score[j])) for j in best]
    return out


def search(vectors: DataFrame, queries: DataFrame, model: Partitions, *, id_col: str, vector_col: str, k: int = 20,
           block_rows: int = 8_192, chunk_rows: int = 4_096) -> DataFrame:
    """(query_id, rank, id, score): each query's k best among all vectors but those of its own id.

    Rows without an id or with an unusable vector take no part.  Ids are taken as unique; a pair that
    repeated rows give twice counts once.
    """
    sent = vectors.sparkSession.sparkContext.broadcast(model)

    def routed(probes: int):
        def one(columns: dict[str, list]) -> dict[str, list]:
            x = np.array(columns["v"], dtype=float)
            return columns | {"part": sent.value.best(x, probes).tolist()} if len(x) else columns | {"part": []}

        return one

    def placed(df: DataFrame, probes: int) -> DataFrame:
        rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).filter(F.col("id").isNotNull() & usable("v"))
        return arrow_map(rows, routed(probes), "id bigint, v array<double>, part array<int>", rows=4096).select("id", "v", F.explode("part").alias("part"))

    base, asked = stored(placed(vectors, 1), "ann-index"), stored(placed(queries, model.probes), "ann-queries")
    blocks = base.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("blocks"))
    chunks = asked.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / chunk_rows).cast("int").alias("chunks"))
    sizes = F.broadcast(stored(blocks.join(chunks, "part"), "ann-sizes"))  # one row a part
    v = base.join(sizes, "part").withColumn("block", F.pmod(F.xxhash64("id", "v"), F.col("blocks")).cast("int")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    q = asked.join(sizes, "part").withColumn("chunk", F.pmod(F.xxhash64("id", "v"), F.col("chunks")).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    names = ["part", "block", "chunk"]

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        x, w = np.stack(right["v"].to_numpy()), np.stack(left["v"].to_numpy())
        return pd.DataFrame(_top(w, left["id"].to_numpy(), x, right["id"].to_numpy(), k), columns=["query_id", "id", "score"])

    found = q.select("id", "v", *names).groupBy(*names).cogroup(v.select("id", "v", *names).groupBy(*names)).applyInPandas(meet, "query_id bigint, id bigint, score double")
    once = found.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def usual_length(vectors: DataFrame, vector_col: str) -> DataFrame:
    """Usable vectors of the commonest length; an inner product needs one length."""
    good = vectors.filter(usable(vector_col))
    first = good.groupBy(F.size(vector_col).alias("n")).count().orderBy(F.desc("count"), "n").first()
    return good.filter(F.size(vector_col) == (first.n if first else 0))
