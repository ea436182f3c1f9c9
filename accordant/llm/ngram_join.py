"""Exact Jaccard join of word n-gram sets by partitioning the universe of shingles.

Sets whose Jaccard similarity reaches the threshold differ in at most H shingles, H following from their sizes.  Sizes
are cut into bands; each band deals all shingles by hash into more than H segments.  A set is indexed under each of its
segment subsets.  Now give segment i of the larger set of a pair a tolerance: 0 (the other's subset is equal), 1 (it
differs by one shingle at most) or none.  If tolerance + 1 adds up to more than H over the segments, some segment of a
linked pair stays within its tolerance, or the sets would differ too much.

Allocation: a set looks up its segments at tolerance 0 and leaves out those with the longest lists, as many as it can
spare.  Where too many segments are empty, it takes the segments with most shingles at tolerance 1: it also looks up
their subsets with one shingle deleted, and the sets of that band are indexed under the one-deletion neighbours of
just these segments (or, where theirs is empty, under the empty subset).  Bands of long texts have a few segments to
spare, which costs less there; short texts are few shingles to delete.

Sets that meet in a list form coarse groups, and those are compared on their full sets in blocks of bounded size, a
group's blocks first in themselves and with a few pivots.  What is still apart then meets only within the lists it
shares.  So a list of near copies costs about its length, and tasks return spanning links, never all pairs.

Bounds: the driver holds the (band, segment) pairs that were asked for at tolerance 1, at most the number of segments
of all bands, which is less than the shingles of the longest text.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from accordant.llm.common import arrow_map, whole_text
from accordant.llm.graph import components
from accordant.llm.near_dedup import intersections, shingle_hashes
from accordant.sources.workspace import stored

_U = np.uint64
_EMPTY = bytes(8)


class Bands:
    """Size bands and their segments, for links of at least ``percent``.

    Every set that a set of band k can be linked with is in band k - 1, k or k + 1.  Sets too small to differ
    from a linked one have no band (-1).
    """

    def __init__(self, percent: int, spare: int = 4, spare_from: int = 64):
        if not 50 <= percent <= 100:
            raise ValueError("percent must be between 50 and 100")
        self.percent, self.spare, self.spare_from = percent, spare, spare_from
        self.starts = [-(-percent // (100 - percent))] if percent < 100 else [1 << 62]

    def _reach(self, k: int) -> None:
        while len(self.starts) <= k + 1:
            b = self.starts[-1]
            self.starts.append(max(b * 100 // self.percent + 1, b * 100**3 // self.percent**3))

    def of(self, size: int) -> int:
        if size < self.starts[0]:
            return -1
        while self.starts[-1] <= size:
            self._reach(len(self.starts))
        return int(np.searchsorted(self.starts, size, side="right")) - 1

    def last(self, k: int) -> int:
        """The largest size of band k."""
        self._reach(k)
        return self.starts[k + 1] - 1

    @lru_cache(maxsize=None)  # noqa: B019 - a handful of bands
    def segments(self, k: int) -> int:
        most = self.last(k)
        return (100 - self.percent) * most // self.percent + 1 + (self.spare if most >= self.spare_from else 0)

    def needed(self, size: int, k: int) -> int:
        """What the tolerances of a set must add up to, for links with sets of band k that are not larger; 0 if none can be."""
        other = min(size, self.last(k))
        if 100 * other < self.percent * size:
            return 0
        return (100 - self.percent) * (size + other) // (100 + self.percent) + 1


def _mixed(hashes: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        m = (hashes ^ (hashes >> _U(31))) * _U(0x9E3779B97F4A7C15)
        m = (m ^ (m >> _U(29))) * _U(0xBF58476D1CE4E5B9)
        return m ^ (m >> _U(32))


class Dealt:
    """One set's shingles dealt into segments; a subset's name is the sum of its shingles' mixed hashes, never 0 but for the empty one."""

    def __init__(self, hashes: np.ndarray, segments: int):
        place = (hashes % _U(segments)).astype(np.int64)
        order = np.argsort(place, kind="stable")
        self.mixed = _mixed(hashes)[order]
        self.counts = np.bincount(place, minlength=segments)
        self.starts = np.cumsum(self.counts) - self.counts
        self.names = np.zeros(segments, dtype=_U)
        full = np.flatnonzero(self.counts)
        if len(full):
            self.names[full] = np.maximum(np.add.reduceat(self.mixed, self.starts[full]), _U(1))

    def neighbours(self, i: int) -> list[bytes]:
        """Names of segment i less one shingle each."""
        n = self.counts[i]
        if n == 1:
            return [_EMPTY]
        with np.errstate(over="ignore"):
            less = self.names[i] - self.mixed[self.starts[i] : self.starts[i] + n]
        return [v.tobytes() for v in np.maximum(less, _U(1))]

    def allocation(self, needed: int) -> tuple[int, np.ndarray, np.ndarray]:
        """(segments that can be left out, those at tolerance 1, empty ones looked up too)."""
        full = np.flatnonzero(self.counts)
        short = needed - len(full)
        none = np.zeros(0, dtype=np.int64)
        if short <= 0:
            return -short, none, none
        widened = full[np.argsort(-self.counts[full], kind="stable")[:short]]
        return 0, widened, np.flatnonzero(self.counts == 0)[: max(0, short - len(full))]


_SUBSETS = "array<struct<band:int,segment:int,name:binary>>"


def signatures(docs: DataFrame, bands: Bands, *, width: int) -> DataFrame:
    """One row per row of (id, text): set size, digest, a 64-bit handle, and the subsets by which it is indexed and looks up.

    ``own`` has the names of all segments under the set's own band, where it is indexed and looks up; ``low`` those under
    the band below, where it only looks up.  ``own_free`` and ``low_free`` say how many lists it can leave out;
    ``widened`` are the further subsets it looks up.
    """
    kind = docs.schema["id"].dataType.simpleString()

    def one(columns: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {c: [] for c in ("n_shingles", "key", "handle", "band", "own", "own_free", "low", "low_free", "widened")}
        for text in columns["text"]:
            h = shingle_hashes(text, width)
            key = xxhash.xxh3_128_digest(h.tobytes())
            band = bands.of(len(h))
            names, free, widened = [None, None], [0, 0], []
            for side, k in enumerate((band, band - 1)):
                needed = bands.needed(len(h), k) if k >= 0 else 0
                if not needed:
                    continue
                dealt = Dealt(h, bands.segments(k))
                names[side] = dealt.names.tobytes()
                free[side], more, none = dealt.allocation(needed)
                widened += [{"band": k, "segment": int(i), "name": v} for i in more for v in dealt.neighbours(int(i))]
                widened += [{"band": k, "segment": int(i), "name": _EMPTY} for i in none]
            row = (len(h), key, int.from_bytes(key[:8], "little", signed=True), band, names[0], free[0], names[1], free[1], widened)
            for values, value in zip(out.values(), row):
                values.append(value)
        return {"id": columns["id"], **out}

    schema = f"id {kind}, n_shingles bigint, key binary, handle bigint, band int, own binary, own_free int, low binary, low_free int, widened {_SUBSETS}"
    return arrow_map(docs, one, schema, rows=64)


def neighbour_subsets(docs: DataFrame, bands: Bands, asked: dict[int, list[int]], *, width: int) -> DataFrame:
    """(handle, widened): the one-deletion neighbours, in the segments that were asked for, of all sets of those bands."""

    def one(columns: dict[str, list]) -> dict[str, list]:
        handles, subsets = [], []
        for text in columns["text"]:
            h = shingle_hashes(text, width)
            band = bands.of(len(h))
            found = []
            if band in asked:
                dealt = Dealt(h, bands.segments(band))
                for i in asked[band]:
                    names = dealt.neighbours(i) if dealt.counts[i] else [_EMPTY]
                    found += [{"band": band, "segment": i, "name": v} for v in names]
            handles.append(int.from_bytes(xxhash.xxh3_128_digest(h.tobytes())[:8], "little", signed=True))
            subsets.append(found)
        return {"handle": handles, "widened": subsets}

    return arrow_map(docs.select("text"), one, f"handle bigint, widened {_SUBSETS}", rows=64).filter("size(widened) > 0")


def _listed(names: str, band: Column) -> Column:
    """The list of each segment that is not empty; band, segment and subset name it."""
    each = F.transform(F.sequence(F.lit(0), (F.length(names) / 8).cast("int") - 1), lambda i: F.struct(i.alias("i"), F.substring(names, i * 8 + 1, F.lit(8)).alias("name")))
    return F.transform(F.filter(each, lambda s: s["name"] != F.lit(_EMPTY)), lambda s: F.xxhash64(band, s["i"], s["name"]))


def lookups(rows: DataFrame, neighbours: DataFrame | None) -> DataFrame:
    """(handle, list, side, free): side 0 is indexed and looks up, 1 and 2 look up, 3 is indexed."""

    def side(df: DataFrame, lists: Column, number: int, free: Column) -> DataFrame:
        return df.select("handle", F.explode(lists).alias("list"), F.lit(number).alias("side"), free.cast("int").alias("free"))

    subsets = F.transform("widened", lambda s: F.xxhash64(s["band"], s["segment"], s["name"]))
    out = side(rows.filter("own is not null"), _listed("own", F.col("band")), 0, F.col("own_free"))
    out = out.unionByName(side(rows.filter("low is not null"), _listed("low", F.col("band") - 1), 1, F.col("low_free")))
    if neighbours is None:
        return out
    out = out.unionByName(side(rows.filter("size(widened) > 0"), subsets, 2, F.lit(0)))
    return out.unionByName(side(neighbours, subsets, 3, F.lit(0)))


def shared_lists(found: DataFrame) -> DataFrame:
    """(handle, list, lead): who meets in the lists that remain after allocation; ``lead`` is the least handle of a list."""
    facts = found.groupBy("list").agg(F.min("handle").alias("lead"), F.max("handle").alias("most")).filter("lead != most")
    # Lists of one set alone are most of them; those that are shared are the narrow side, and hashing them spares a sort of all.
    facts = stored(facts.select("list", "lead"), "lists").hint("shuffle_hash")
    # Copies are one handle; should two sets share one, the more careful allocation holds.
    hits = found.join(facts, "list").groupBy("list", "handle", "side").agg(F.min("free").alias("free"), F.min("lead").alias("lead"))
    hits = stored(hits, "hits")
    lengths = hits.groupBy("list", F.xxhash64("list").alias("spread")).agg(F.count(F.lit(1)).alias("length"), F.max(F.col("side").isin(0, 3)).alias("indexed"))
    known = hits.filter("side < 3").join(lengths.filter("indexed").select("list", "length"), "list")
    dearest = Window.partitionBy("handle", "side").orderBy(F.desc("length"), "list")
    taken = known.withColumn("place", F.row_number().over(dearest)).filter("place > free")
    taken = stored(taken.groupBy("list", F.xxhash64("list").alias("spread")).agg(F.lit(1).alias("taken")).select("list"), "taken-lists")
    return stored(hits.join(taken, "list").select("handle", "list", "lead").distinct(), "meetings")


def spanning(keys: list[bytes], sets: list[np.ndarray], percent: int) -> list[tuple[bytes, bytes]]:
    """Links that connect exactly what the pairs with 100 * intersection >= percent * union connect."""
    size = np.array([len(s) for s in sets])
    near = 100 * np.minimum(size[:, None], size[None, :]) >= percent * np.maximum(size[:, None], size[None, :])
    np.fill_diagonal(near, False)
    some = np.flatnonzero(near.any(axis=0))
    if len(some) < 2:
        return []
    both = intersections([sets[i] for i in some])
    n = size[some]
    linked = 100 * both >= percent * (n[:, None] + n[None, :] - both)
    root = np.arange(len(some))
    links = []
    left = np.ones(len(some), dtype=bool)
    for i in range(len(some)):
        if not left[i]:
            continue
        front = np.array([i])
        left[i] = False
        while len(front):
            front = np.flatnonzero(linked[front].any(axis=0) & left)
            left[front] = False
            root[front] = i
            links += [(keys[some[j]], keys[some[i]]) for j in front]
    return links


def _compared(units: DataFrame, percent: int) -> DataFrame:
    """Spanning links among the members of each (unit, part)."""

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        links = []
        for _, g in frame.groupby("part"):
            g = g.drop_duplicates("key")
            links += spanning(g["key"].tolist(), [np.frombuffer(s, dtype=_U) for s in g["hashes"]], percent)
        return pd.DataFrame(links, columns=["a", "b"])

    return units.select("unit", "part", "key", "hashes").groupBy("unit").applyInPandas(one, "a binary, b binary")


def _blocks(count: Column, shingles: Column, block: int, block_shingles: int) -> Column:
    return F.greatest(F.ceil(count / block), F.ceil(shingles / block_shingles)).cast("int")


def exact_links(members: DataFrame, meetings: DataFrame, percent: int, block: int, block_shingles: int, pivots: int) -> DataFrame:
    """(a, b) links that connect what exact comparison connects, from stored members (grp, handle, key, n_shingles, hashes)."""
    sizes = members.groupBy("grp").agg(F.count(F.lit(1)).alias("count"), F.sum("n_shingles").alias("shingles"))
    sizes = stored(sizes.select("grp", "count", _blocks(F.col("count"), F.col("shingles"), block, block_shingles).alias("blocks")), "group-sizes")
    total = members.agg(F.coalesce(_blocks(F.count(F.lit(1)), F.sum("n_shingles"), block, block_shingles), F.lit(0))).first()[0]
    shared = max(1, 4 * total)
    known = members.join(sizes, "grp")
    small = known.filter("blocks = 1").select(F.pmod(F.xxhash64("grp"), F.lit(shared)).alias("unit"), F.xxhash64("grp").alias("part"), "key", "hashes")
    large = known.filter("blocks > 1").withColumn("i", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    chosen = F.pmod(F.xxhash64(F.lit(7), F.col("key")), F.col("count")) < pivots
    pivot = large.filter(chosen).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    first = large.unionByName(pivot).select(F.xxhash64("grp", "i").alias("unit"), F.xxhash64("grp").alias("part"), "key", "hashes")
    links = stored(_compared(small.unionByName(first), percent), "links")
    big = stored(large.select("handle", "key", "n_shingles"), "large-members")
    if big.isEmpty():
        return links
    # What is still apart in groups of several blocks meets within the lists it shares.
    parts = components(links, "a", "b").withColumnsRenamed({"node": "key", "root": "piece"})
    placed = stored(big.join(parts, "key", "left").select("handle", "key", "n_shingles", F.coalesce("piece", "key").alias("piece")), "pieces")
    apart = stored(meetings.select("handle", "list").join(placed, "handle").select("list", "key", "n_shingles", "piece").distinct(), "list-members")
    lists = apart.groupBy("list").agg(F.min("piece").alias("a"), F.max("piece").alias("b"), F.count(F.lit(1)).alias("count"), F.sum("n_shingles").alias("shingles"),
                                      F.sum(F.xxhash64("key").cast("decimal(38,0)")).alias("mark")).filter("a != b")
    # Lists with the same members are compared once.
    lists = lists.groupBy("mark", "count", "shingles").agg(F.min("list").alias("list"))
    lists = stored(lists.select("list", _blocks(F.col("count"), F.col("shingles"), block, block_shingles).alias("blocks")), "lists-apart")
    # Members are read from the shared folder once for all lists they stand in.
    met = apart.select("list", "key").join(lists, "list").withColumn("i", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    met = met.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pair = F.xxhash64("list", F.least("i", "j"), F.greatest("i", "j"))
    unit = F.when(F.col("blocks") == 1, F.pmod(pair, F.lit(shared))).otherwise(pair)
    met = met.select(unit.alias("unit"), pair.alias("part"), "key").distinct()
    return links.unionByName(_compared(met.join(members.select("key", "hashes").dropDuplicates(["key"]), "key"), percent))


def join(docs: DataFrame, *, width: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text", block: int = 256,
         block_shingles: int = 1_000_000, pivots: int = 8) -> DataFrame:
    """(id, n_shingles, component_id): one row per row, linked where 100 * intersection >= percent * union.

    Words are runs without ASCII white space, A-Z lower-cased; a text of fewer words than ``width`` is one shingle, one
    without words or null has an empty set, is linked with nothing and is its own component.  ``component_id`` is the
    least id reachable over links.  Rows of equal sets are linked whatever their ids; repeated ids are each
    returned; rows without an id take part, and a component of only such rows has a null id.  Shingles are compared by
    64-bit hashes.  Empty tables give no rows; other columns are ignored.
    """
    bands = Bands(percent)
    source = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"))
    rows = stored(signatures(source, bands, width=width), "set-signatures")
    some = rows.filter("n_shingles > 0")
    classes = stored(some.groupBy("key").agg(F.min("id").alias("least"), F.min("handle").alias("handle"), F.min("n_shingles").alias("n_shingles")), "classes")
    asked: dict[int, list[int]] = {}
    for r in rows.select(F.explode("widened").alias("w")).select("w.band", "w.segment").distinct().collect():
        asked.setdefault(r["band"], []).append(r["segment"])
    neighbours = stored(neighbour_subsets(source, bands, asked, width=width), "neighbours") if asked else None
    meetings = shared_lists(lookups(rows, neighbours))
    groups = stored(components(meetings.filter("handle != lead").select("handle", "lead").distinct(), "handle", "lead"), "coarse-groups")
    # One row of each class that meets another brings its set; texts move once, joined by hash without a sort.
    bearers = classes.join(groups, classes["handle"] == groups["node"]).select(F.col("root").alias("grp"), "key", "handle", F.col("least").alias("bearer"))

    def full(columns: dict[str, list]) -> dict[str, list]:
        sets = [shingle_hashes(t, width) for t in columns["text"]]
        return {"grp": columns["grp"], "handle": columns["handle"], "key": columns["key"], "own": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets],
                "n_shingles": list(map(len, sets)), "hashes": [s.tobytes() for s in sets]}

    texts = source.join(bearers.hint("shuffle_hash"), F.col("id").eqNullSafe(F.col("bearer"))).select("grp", "handle", "key", "text")
    sets = arrow_map(texts, full, "grp bigint, handle bigint, key binary, own binary, n_shingles bigint, hashes binary", rows=64)
    members = stored(sets.filter("own = key").drop("own").dropDuplicates(["grp", "key"]), "members")
    parts = components(exact_links(members, meetings, percent, block, block_shingles, pivots), "a", "b")
    joined = classes.select("key", "least").join(parts.withColumnRenamed("node", "key"), "key", "left").select("key", "least", F.coalesce("root", "key").alias("root"))
    joined = stored(joined, "class-parts")
    least = joined.groupBy("root", F.xxhash64("root").alias("spread")).agg(F.min("least").alias("component_id"))
    named = stored(joined.join(least, "root").select("key", "component_id"), "components")
    out = rows.select("id", "n_shingles", "key").join(named, "key", "left")
    return out.select(F.col("id").alias(id_col), "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))
