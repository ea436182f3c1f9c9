"""Hard negatives by threshold joins in the manner of L2AP.

An anchor's positives are its best rows of the same label; the negatives of an anchor and a positive are the best rows of
other labels whose score lies in a window below the positive's.  Scores are inner products of integer vectors.

Rows are dealt into blocks, anchors into chunks; a task joins one block with one chunk and returns its best few rows
per anchor or window, which suffices, as the best of all rows are among the best of their blocks.  Within a block:

* Dimensions are taken in order of energy, in groups.  A row's first groups are left out of the inverted index as
  long as the norm of what is left out, times the largest norm of an anchor, is below the threshold: a row that meets
  an anchor only there cannot reach it.  Rows are sorted by where their index begins, so a posting list is one slice.
* Partial scores are accumulated from the last group to the first.  A pair is dropped once its partial score plus the
  product of the remaining norms is below the threshold; rows that survive their postings get the rest of their
  score from the rows themselves.
* Thresholds start high and are lowered for the anchors whose windows are not full yet, down to the window's own end
  (or, for positives, to all rows).  So every result is exact.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from accordant.llm.common import of_one_length
from accordant.sources.workspace import stored

#: Norms are rounded up by so much, so that a bound in floating point never falls below the true one.
_UP = 1 + 1e-9


def _group_norms(x: np.ndarray, group: int) -> np.ndarray:
    """(rows, groups + 1): norm of the first 0, 1, ... groups of dimensions."""
    squares = x.astype(float) ** 2
    sums = squares.reshape(len(x), -1, group).sum(axis=2)
    return np.sqrt(np.column_stack([np.zeros(len(x)), np.cumsum(sums, axis=1)])) * _UP


class BlockIndex:
    """Rows whose inner products with given vectors reach given thresholds, exactly."""

    def __init__(self, rows: np.ndarray, group: int = 8):
        self.group = group
        width = rows.shape[1]
        self.order = np.argsort((rows.astype(float) ** 2).sum(axis=0), kind="stable")
        self.pad = -width % group if width else group
        self.rows = self._arranged(rows)
        self.norms = _group_norms(self.rows, group)
        self.groups = self.norms.shape[1] - 1
        self.longest = float(self.norms[:, -1].max(initial=0.0))

    def _arranged(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x[:, self.order], ((0, 0), (0, self.pad)))

    def above(self, vectors: np.ndarray, least: np.ndarray, dense: float = 0.25, step: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(vector, row, score) of all pairs with score >= the vector's threshold, up to rounding of the threshold."""
        out = [self._above(vectors[s : s + step], least[s : s + step], dense) for s in range(0, len(vectors), step)]
        at = [np.full(len(o[0]), s * step) for s, o in enumerate(out)]
        return tuple(np.concatenate(c) if c else np.zeros(0, dtype=np.int64) for c in ([o[0] + a for o, a in zip(out, at)], [o[1] for o in out], [o[2] for o in out]))

    def _above(self, vectors: np.ndarray, least: np.ndarray, dense: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, g = self._arranged(vectors), self.group
        q_norms = _group_norms(q, g)
        slack = 1e-9 * q_norms[:, -1].max(initial=0.0) * self.longest
        floor = least - slack
        # What is left out of the index: the first groups, while nothing that lies only there can reach any threshold.
        begins = np.maximum((self.norms * q_norms[:, -1].max(initial=0.0) < floor.min(initial=np.inf)).sum(axis=1) - 1, 0)
        by_begin = np.argsort(begins, kind="stable")
        begins = begins[by_begin]
        rows, norms = self.rows[by_begin], self.norms[by_begin]
        posted = np.searchsorted(begins, np.arange(self.groups), side="right")  # rows with postings in each group
        score = np.zeros((len(q), len(rows)), dtype=q.dtype)
        c = self.groups
        alive = np.ones((len(q), posted[-1] if self.groups else 0), dtype=bool)
        while c > 0:
            c -= 1
            n = posted[c]
            score[:, :n] += q[:, c * g : (c + 1) * g] @ rows[:n, c * g : (c + 1) * g].T
            alive = score[:, :n] + q_norms[:, c, None] * norms[None, :n, c] >= floor[:, None]
            if alive.mean() <= dense if n else True:
                break
        a, b = np.nonzero(alive)
        # Rows whose postings ended before: their rest is what the index leaves out.
        ended = np.arange(alive.shape[1], posted[-1] if self.groups else 0)
        if len(ended):
            rest = score[:, ended] + q_norms[:, begins[ended]] * norms[ended, begins[ended]][None, :] >= floor[:, None]
            a2, b2 = np.nonzero(rest)
            a, b, level = np.concatenate([a, a2]), np.concatenate([b, ended[b2]]), np.concatenate([np.full(len(a), c), begins[ended[b2]]])
        else:
            level = np.full(len(a), c)
        total = score[a, b]
        for k in range(int(level.max(initial=0)) - 1, -1, -1):
            due = np.flatnonzero(level > k)
            total[due] += (q[a[due], k * g : (k + 1) * g] * rows[b[due], k * g : (k + 1) * g]).sum(axis=1)
            ok = np.ones(len(a), dtype=bool)
            ok[due] = total[due] + q_norms[a[due], k] * norms[b[due], k] >= floor[a[due]]
            a, b, total, level = a[ok], b[ok], total[ok], level[ok]
        ok = total >= floor[a]  # exact where sums are exact; callers compare integers
        return a[ok], by_begin[b[ok]], total[ok]


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to smaller ids."""
    return np.lexsort((ids, -score))[:k]


def best_rows(index: BlockIndex, ids: np.ndarray, vectors: np.ndarray, own: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(vector, row, score) of the k best rows of each vector, rows of its own id left out."""
    reach = np.sqrt((vectors.astype(float) ** 2).sum(axis=1)) * index.longest
    out, share = [], 0.8
    open_ = np.arange(len(vectors))
    while len(open_):
        least = reach[open_] * share if share > 0.1 else np.full(len(open_), -np.inf)
        a, b, s = index.above(vectors[open_], least)
        other = ids[b] != own[open_[a]]
        a, b, s = a[other], b[other], s[other]
        cuts = np.searchsorted(a[(order := np.argsort(a, kind="stable"))], np.arange(len(open_) + 1))
        left = []
        for i in range(len(open_)):
            mine = order[cuts[i] : cuts[i + 1]]
            if len(mine) < k and share > 0.1:
                left.append(open_[i])
                continue
            out += [(int(open_[i]), int(b[m]), int(s[m])) for m in mine[_best(s[mine], ids[b[mine]], k)]]
        open_, share = np.array(left, dtype=np.int64), share * 0.8
    return out


def window_rows(index: BlockIndex, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, own: np.ndarray,
                windows: list[list[tuple[int, int]]], k: int) -> list[tuple[int, int, int, int]]:
    """(vector, window, row, score) of the k best rows of another label in each window (least, most) of each vector."""
    out = []
    open_ = [(i, w) for i, ws in enumerate(windows) for w in range(len(ws))]
    share = 0.02
    while open_:
        start = {}
        for i, w in open_:
            least, most = windows[i][w]
            start[i, w] = least if share > 0.5 else max(least, int(most - share * abs(most)))
        who = sorted({i for i, _ in open_})
        place = {i: n for n, i in enumerate(who)}
        lowest = np.full(len(who), np.inf)
        for (i, _), t in start.items():
            lowest[place[i]] = min(lowest[place[i]], t)
        a, b, s = index.above(vectors[who], lowest)
        other = labels[b] != own[np.array(who, dtype=np.int64)[a]]
        a, b, s = a[other], b[other], s[other]
        cuts = np.searchsorted(a[(order := np.argsort(a, kind="stable"))], np.arange(len(who) + 1))
        left = []
        for i, w in open_:
            mine = order[cuts[place[i]] : cuts[place[i] + 1]]
            mine = mine[(s[mine] >= start[i, w]) & (s[mine] <= windows[i][w][1])]
            if len(mine) < k and start[i, w] > windows[i][w][0]:
                left.append((i, w))
                continue
            out += [(i, w, int(b[m]), int(s[m])) for m in mine[_best(s[mine], ids[b[mine]], k)]]
        open_, share = left, share * 2
    return out


def _stacked(column: pd.Series) -> np.ndarray:
    """Integer vectors as one matrix: of doubles, which multiply faster, where products are exact in them."""
    x = np.stack(column.to_list()).astype(np.int64)
    return x.astype(float) if (x.astype(float) ** 2).sum(axis=1).max(initial=0.0) < 2.0**50 else x


def _same_kind(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (a, b) if a.dtype == b.dtype else (a.astype(np.int64), b.astype(np.int64))


def _parts(n: int, size: int) -> int:
    return max(1, -(-n // size))


def _dealt(df: DataFrame, parts: Column | int) -> Column:
    return F.pmod(F.xxhash64("id", "v"), parts if isinstance(parts, Column) else F.lit(parts)).cast("int")


def _every(parts: Column | int) -> Column:
    """As many rows as there are parts, numbered."""
    return F.explode(F.sequence(F.lit(0), (parts if isinstance(parts, Column) else F.lit(parts)) - 1))


def positives(rows: DataFrame, anchors: DataFrame, k: int, block_rows: int, chunk_rows: int) -> DataFrame:
    """(id, akey, positive_rank, positive_id, positive_score): the k best other rows of each anchor's label."""
    n = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).join(
        anchors.groupBy("label").agg(F.count(F.lit(1)).alias("m")), "label").select(
        "label", F.ceil(F.col("n") / block_rows).cast("int").alias("blocks"), F.ceil(F.col("m") / chunk_rows).cast("int").alias("chunks"))
    n = stored(n, "blocks-per-label")
    names = ["unit_label", "block", "chunk", "query", "id", "akey", "v"]
    members = rows.join(n, "label").withColumn("block", _dealt(rows, F.col("blocks"))).withColumn("chunk", _every(F.col("chunks")))
    members = members.select(F.col("label").alias("unit_label"), "block", "chunk", F.lit(False).alias("query"), "id", F.lit(0).cast("long").alias("akey"), "v")
    asked = anchors.join(n, "label").withColumn("chunk", _dealt(anchors, F.col("chunks"))).withColumn("block", _every(F.col("blocks")))
    asked = asked.select(F.col("label").alias("unit_label"), "block", "chunk", F.lit(True).alias("query"), "id", "akey", "v")

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        q, r = frame[frame["query"]], frame[~frame["query"]]
        found = []
        if len(q) and len(r):
            x, y = _same_kind(_stacked(q["v"]), _stacked(r["v"]))
            ids, qid, akey = r["id"].to_numpy(), q["id"].to_numpy(), q["akey"].to_numpy()
            found = [(qid[i], akey[i], ids[j], s) for i, j, s in best_rows(BlockIndex(y), ids, x, qid, k)]
        return pd.DataFrame(found, columns=["id", "akey", "positive_id", "positive_score"])

    got = members.select(*names).unionByName(asked.select(*names)).groupBy("unit_label", "block", "chunk").applyInPandas(
        one, "id bigint, akey bigint, positive_id bigint, positive_score bigint")
    best = Window.partitionBy("id", "akey").orderBy(F.desc("positive_score"), "positive_id")
    return got.withColumn("positive_rank", F.row_number().over(best)).filter(F.col("positive_rank") <= k)


def mine(vectors: DataFrame, anchor: Column, *, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "v", n_positives: int = 5,
         n_negatives: int = 5, low: int = 80, high: int = 100, block_rows: int = 4096, chunk_rows: int = 1024) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows where ``anchor`` holds.

    ``vector_col`` holds integers.  Negatives satisfy low * positive <= 100 * negative <= high * positive, best first,
    ties to smaller ids; an anchor with fewer rows in reach returns fewer.  Rows without id, label or vector, with a
    null in it, or of another length than most take no part.  A row is another row of an anchor if its id differs; of
    repeated ids each row counts, and anchors equal in all are one.  Empty tables give no rows; other columns are
    ignored.  Ids are integers.  Raises ValueError if scores could pass a long.

    Every block meets every chunk of anchors: the work is the anchors times the rows, in units of bounded size.
    """
    whole = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    some = whole.filter("id is not null and label is not null and v is not null").filter(F.forall("v", lambda x: x.isNotNull()))
    rows = stored(of_one_length(some, "v").withColumn("akey", F.xxhash64("id", "label", "v")), "vectors")
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("anchor").alias("m"),
                     F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))).alias("longest")).first()
    if facts["n"] and facts["longest"] * max(low, high, 100) >= 2.0**62:
        raise ValueError("components are too large for scores in a long")
    anchors = stored(rows.filter("anchor").select("id", "label", "akey", "v").distinct(), "anchors")
    found = stored(positives(rows, anchors, n_positives, block_rows, chunk_rows), "positives")
    windows = found.filter("positive_score >= 0").groupBy("id", "akey").agg(F.sort_array(F.collect_list(F.array(F.col("positive_rank").cast("long"), "positive_id", "positive_score"))).alias("windows"))
    blocks, chunks = _parts(facts["n"], block_rows), _parts(facts["m"], chunk_rows)
    names = ["block", "chunk", "id", "akey", "label", "v", "windows"]
    asked = anchors.join(windows, ["id", "akey"])
    asked = asked.withColumn("chunk", _dealt(asked, chunks)).withColumn("block", _every(blocks)).select(*names)
    members = rows.withColumn("block", _dealt(rows, blocks)).withColumn("chunk", _every(chunks)).withColumn(
        "windows", F.lit(None).cast(asked.schema["windows"].dataType)).select(*names)

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        is_query = frame["windows"].notna()
        q, r = frame[is_query], frame[~is_query]
        out = []
        if len(q) and len(r):
            x, y = _same_kind(_stacked(q["v"]), _stacked(r["v"]))
            ids, labels = r["id"].to_numpy(), r["label"].to_numpy()
            qid, akey, own = q["id"].to_numpy(), q["akey"].to_numpy(), q["label"].to_numpy()
            wins = [[tuple(map(int, w)) for w in ws] for ws in q["windows"]]
            spans = [[(-(-low * p // 100), high * p // 100) for *_, p in ws] for ws in wins]
            for i, w, j, s in window_rows(BlockIndex(y), ids, labels, x, own, spans, n_negatives):
                rank, pid, p = wins[i][w]
                out.append((qid[i], akey[i], rank, pid, p, ids[j], s))
        return pd.DataFrame(out, columns=["id", "akey", "positive_rank", "positive_id", "positive_score", "negative_id", "negative_score"])

    got = members.unionByName(asked).groupBy("block", "chunk").applyInPandas(
        one, "id bigint, akey bigint, positive_rank int, positive_id bigint, positive_score bigint, negative_id bigint, negative_score bigint")
    best = Window.partitionBy("id", "akey", "positive_rank").orderBy(F.desc("negative_score"), "negative_id")
    ranked = got.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= n_negatives)
    return ranked.select(F.col("id").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score")
