"""Near duplicates of whole documents by HyperMinHash, confirmed on full shingle sets.

Each document's hashed shingles are kept as one register per bucket: the leading-zero count of the
bucket's smallest hash and the mantissa bits after it.  Documents with equal sets are one class.
Bands of registers deal the classes into buckets; classes that share a bucket, directly or through
others, form a coarse group that holds every link of its members.  Within a group, pairs whose
collision-corrected estimate allows the threshold are compared on their full sets.

Large groups are worked in blocks.  Each block is linked in itself and with a few pivots of the
group; what then hangs together needs no further comparison, and only members outside
the group's largest part meet all blocks again.  So a group of near copies costs about as many
comparisons as it has members, and no pair within a group is ever emitted: tasks return
spanning links only.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from accordant.llm.common import arrow_map, whole_text
from accordant.llm.graph import components
from accordant.sources.workspace import stored

BUCKET_BITS, MANTISSA = 7, 10
REGISTERS = 1 << BUCKET_BITS
EMPTY = 0xFFFF
#: Chance that registers of different elements agree: same leading-zero count, then same mantissa.
COLLISION = 2.0**-MANTISSA / 3
_U = np.uint64


class _WordHashes(dict):
    """word -> 64-bit hash; only saves hashing."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


_WORDS = _WordHashes()


def shingle_hashes(text: str, width: int) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles.  Words are runs without ASCII white space, A-Z
    lower-cased; fewer words than ``width`` are one shingle, no words none."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, dtype=_U)
    h = np.fromiter(map(_WORDS.__getitem__, words), dtype=_U, count=len(words))
    width = min(width, len(h))
    with np.errstate(over="ignore"):
        mixed = np.full(len(h) - width + 1, width, dtype=_U)
        for k in range(width):
            mixed = (mixed ^ h[k : len(h) - width + 1 + k]) * _U(0x9E3779B97F4A7C15)
            mixed ^= mixed >> _U(29)
        mixed *= _U(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> _U(32)
    return np.unique(mixed)


def registers(hashes: np.ndarray) -> np.ndarray:
    """HyperMinHash registers (leading zeros, then mantissa bits) of sorted hashes."""
    out = np.full(REGISTERS, EMPTY, dtype=np.uint16)
    bucket = (hashes >> _U(64 - BUCKET_BITS)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(hashes) else np.zeros(0, dtype=int)
    rest = hashes[first] << _U(BUCKET_BITS)
    zeros = np.zeros(len(first), dtype=np.int64)
    for step in (32, 16, 8, 4, 2, 1):
        low = (rest >> _U(64 - step)) == 0
        zeros += step * low
        rest = np.where(low, rest << _U(step), rest)
    mantissa = ((rest << _U(1)) >> _U(64 - MANTISSA)).astype(np.int64)
    out[bucket[first]] = (np.minimum(zeros, 62) << MANTISSA) | mantissa
    return out


#: For each register, the order in which it looks for a filled one if its own bucket is empty.
_ORDER = np.stack([np.random.default_rng(k).permutation(REGISTERS) for k in range(REGISTERS)])


def densified(regs: np.ndarray) -> np.ndarray:
    """Registers without empty ones: an empty bucket borrows from the first filled one in its order.

    Each register of two sets then agrees with about their Jaccard similarity, however small the
    sets; without this, a band of a short text would rest on one shingle.
    """
    filled = regs != EMPTY
    if filled.all() or not filled.any():
        return regs
    empty = np.flatnonzero(~filled)
    order = _ORDER[empty]
    out = regs.copy()
    out[empty] = regs[order[np.arange(len(empty)), filled[order].argmax(axis=1)]]
    return out


def estimates(regs: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(collision-corrected Jaccard estimates, registers they rest on) of all rows against all others."""
    f, k = np.zeros((len(regs), len(others))), np.zeros((len(regs), len(others)))
    full = others != EMPTY
    for i, r in enumerate(regs):
        used = full | (r != EMPTY)
        k[i] = used.sum(axis=1)
        f[i] = ((others == r) & used).sum(axis=1)
    share = f / np.maximum(k, 1)
    return (share - COLLISION) / (1 - COLLISION), k


def intersections(sets: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Exact intersection sizes of all sets with all others, by products of their incidence matrix."""
    n = len(sets)
    if n == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([[len(sets[0]), both], [both, len(sets[1])]])
    who = np.repeat(np.arange(n), [len(s) for s in sets])
    _, at, many = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = many > 1
    place = np.cumsum(shared) - 1
    keep = shared[at]
    who, at = who[keep], place[at[keep]]
    order = np.argsort(at, kind="stable")
    who, at = who[order], at[order]
    total = np.zeros((n, n), dtype=np.int64)
    width = int(place[-1]) + 1 if len(place) else 0
    for start in range(0, width, columns):
        lo, hi = np.searchsorted(at, [start, start + columns])
        dense = np.zeros((n, min(columns, width - start)), dtype=np.float32)
        dense[who[lo:hi], at[lo:hi] - start] = 1
        total += (dense @ dense.T).astype(np.int64)
    return total


def spanning_links(keys: list[bytes], sets: list[np.ndarray], regs: np.ndarray, percent: int) -> list[tuple[bytes, bytes]]:
    """Links that connect exactly what the pairs with 100 * intersection >= percent * union connect."""
    estimate, used = estimates(regs, regs)
    t = percent / 100
    slack = 5 * np.sqrt(t * (1 - t) / np.maximum(used, 1)) + 0.02
    maybe = estimate >= t - slack
    np.fill_diagonal(maybe, False)
    links: list[tuple[bytes, bytes]] = []
    for part in _parts(maybe):
        if len(part) == 1:
            continue
        sub = [sets[i] for i in part]
        both = intersections(sub)
        size = np.array([len(s) for s in sub])
        linked = (100 * both >= percent * (size[:, None] + size[None, :] - both)) & maybe[np.ix_(part, part)]
        links += [(keys[part[i]], keys[part[group[0]]]) for group in _parts(linked) for i in group[1:]]
    return links


def _parts(linked: np.ndarray) -> list[list[int]]:
    """Connected parts of a symmetric boolean matrix."""
    left, out = np.ones(len(linked), dtype=bool), []
    for i in range(len(linked)):
        if not left[i]:
            continue
        left[i] = False
        part, front = [i], [i]
        while front:
            new = np.flatnonzero(linked[front].any(axis=0) & left)
            left[new] = False
            front = new.tolist()
            part += front
        out.append(part)
    return out


def signatures(docs: DataFrame, *, width: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, key, registers): ``key`` is a 128-bit digest of the whole set; registers are densified."""
    kind = docs.schema[id_col].dataType.simpleString()

    def one(columns: dict[str, list]) -> dict[str, list]:
        sets = [shingle_hashes(t, width) for t in columns["text"]]
        return {"id": columns["id"], "n_shingles": list(map(len, sets)), "key": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets],
                "registers": [densified(registers(s)).tobytes() for s in sets]}

    rows = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"))
    return arrow_map(rows, one, f"id {kind}, n_shingles bigint, key binary, registers binary", rows=64)


def band_keys(regs: Column, per_band: int) -> Column:
    """One hash per band of registers."""
    size = 2 * per_band
    return F.transform(F.sequence(F.lit(0), F.lit(REGISTERS // per_band - 1)), lambda b: F.xxhash64(b, F.substring(regs, b * size + 1, F.lit(size))))


def coarse_groups(classes: DataFrame, per_band: int) -> DataFrame:
    """(key, grp) of the classes that share a band bucket with others, directly or through others."""
    bands = stored(classes.select("key", F.explode(band_keys(F.col("registers"), per_band)).alias("bucket")), "bands")
    shared = bands.groupBy("bucket").agg(F.min("key").alias("lead"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("bucket", "lead")
    # The added column leaves the join its own exchange, so that a bucket with many classes can be split.
    shared = stored(shared, "shared-buckets")
    edges = bands.join(shared, "bucket").filter("key != lead").select("key", "lead").distinct()
    return components(edges, "key", "lead").select(F.col("node").alias("key"), F.col("root").alias("grp"))


def _links_in(units: DataFrame, percent: int) -> DataFrame:
    """Spanning links of the members of each (unit, grp)."""

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        links = []
        for _, g in frame.groupby("grp"):
            g = g.drop_duplicates("key")
            sets = [np.frombuffer(s, dtype=_U) for s in g["hashes"]]
            links += spanning_links(g["key"].tolist(), sets, np.stack([registers(s) for s in sets]), percent)
        return pd.DataFrame(links, columns=["a", "b"])

    return units.select("unit", "grp", "key", "hashes").groupBy("unit").applyInPandas(one, "a binary, b binary")


def exact_links(members: DataFrame, percent: int, block: int, pivots: int) -> DataFrame:
    """(a, b) links that connect what exact comparison connects, from stored (grp, key, hashes) rows."""
    sizes = stored(members.groupBy("grp").agg(F.count(F.lit(1)).alias("size")), "group-sizes")
    total = sizes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    shared_units = max(1, -(-total // block))
    known = members.join(sizes, "grp")
    blocks = F.ceil(F.col("size") / block).cast("int")
    small = known.filter(F.col("size") <= block).withColumn("unit", F.pmod(F.xxhash64("grp"), F.lit(shared_units)))
    large = known.filter(F.col("size") > block).withColumn("i", F.pmod(F.xxhash64("key"), blocks).cast("int"))
    # Units are work for one call; should two hashes be equal, one call does both.
    unit = lambda kind, i, j: F.xxhash64(F.lit(kind), F.col("grp"), i, j)
    # Pivots: of each group the members of smallest hash, about ``pivots`` of them, found by a threshold instead of a sort.
    chosen = F.pmod(F.xxhash64(F.lit(7), F.col("key")), F.col("size")) < pivots
    pivot = large.filter(chosen).withColumn("i", F.explode(F.sequence(F.lit(0), blocks - 1)))
    first = large.unionByName(pivot).withColumn("unit", unit(1, F.col("i"), F.lit(0)))
    names = ["unit", "grp", "key", "hashes"]
    links = stored(_links_in(small.select(*names).unionByName(first.select(*names)), percent), "links")
    # What is still apart in groups of several blocks.
    big = stored(large.select("grp", "key", "size"), "large-members")
    if big.isEmpty():
        return links
    parts = components(links, "a", "b").withColumnsRenamed({"node": "key"})
    placed = stored(big.join(parts, "key", "left").select("grp", "key", "size", F.coalesce("root", "key").alias("part")), "parts")
    per_part = placed.groupBy("grp", "part").agg(F.count(F.lit(1)).alias("n"))
    main = per_part.groupBy("grp").agg(F.max_by("part", F.struct("n", "part")).alias("main"), F.sum("n").alias("all"), F.max("n").alias("most"))
    main = stored(main.filter("most < all").select("grp", "main", (F.col("all") - F.col("most")).alias("outside")), "main-parts")
    again = members.join(placed.select("grp", "key", "size", "part"), ["grp", "key"]).join(main, "grp")
    rests = F.ceil(F.col("outside") / block).cast("int")
    every = again.withColumn("j", F.pmod(F.xxhash64("key"), blocks).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), rests - 1)))
    outside = again.filter("part != main").withColumn("i", F.pmod(F.xxhash64(F.lit(11), F.col("key")), rests).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), blocks - 1)))
    met = every.unionByName(outside).withColumn("unit", unit(2, F.col("i"), F.col("j")))
    return links.unionByName(_links_in(met.select(*names), percent))


def near_duplicates(docs: DataFrame, *, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text",
                    per_band: int = 5, block: int = 256, pivots: int = 8) -> DataFrame:
    """Group documents whose shingle sets overlap by at least ``percent`` of their union.

    Returns one row per input row: id, ``n_shingles``, ``component_id`` (the least id reachable over links),
    ``kept`` (whether it is that one).  A text without words, or null, has an empty set, is linked with
    nothing and is its own component.  Rows of equal sets are linked whatever their ids; repeated ids are
    each marked; other columns are ignored.
    """
    source = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    rows = stored(signatures(source, width=width, id_col="__id", text_col="__text"), "signatures")
    some = rows.filter("n_shingles > 0")
    classes = stored(some.groupBy("key").agg(F.min("id").alias("least"), F.first("registers").alias("registers")), "classes")
    groups = stored(coarse_groups(classes.select("key", "registers"), per_band), "coarse-groups")
    # One document of each grouped class brings its set; texts move once, joined by hash without a sort.
    bearers = groups.join(classes.select("key", "least"), "key").select("grp", "key", F.col("least").alias("id"))

    def full(columns: dict[str, list]) -> dict[str, list]:
        sets = [shingle_hashes(t, width) for t in columns["text"]]
        return {"grp": columns["grp"], "key": columns["key"], "own": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets], "hashes": [s.tobytes() for s in sets]}

    bearers = bearers.hint("shuffle_hash")
    texts = source.select(F.col("__id").alias("own_id"), whole_text("__text").alias("text"))
    texts = texts.join(bearers, texts.own_id.eqNullSafe(bearers.id)).select("grp", "key", "text")
    sets = arrow_map(texts, full, "grp binary, key binary, own binary, hashes binary", rows=64)
    members = stored(sets.filter("own = key").select("grp", "key", "hashes").dropDuplicates(["grp", "key"]), "members")
    parts = components(exact_links(members, percent, block, pivots), "a", "b")
    joined = classes.select("key", "least").join(parts.withColumnRenamed("node", "key"), "key", "left").select("key", "least", F.coalesce("root", "key").alias("root"))
    joined = stored(joined, "class-parts")
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    named = joined.join(least, "root").select("key", "component_id")
    out = rows.join(named, "key", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), (component == F.col("id")).alias("kept"))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows, all columns kept, without the documents that ``near_duplicates`` marks as copies.

    Rows that share an id go only if each of them is marked; rows without an id stay.
    """
    marks = near_duplicates(docs.select(id_col, text_col), id_col=id_col, text_col=text_col, **options)
    gone = marks.groupBy(F.col(id_col).alias("__id")).agg(F.max("kept").alias("kept")).filter("not kept").select("__id")
    # The ids are the narrow side; hashing them spares a sort of the texts.
    gone = stored(gone, "copies").hint("shuffle_hash")
    return docs.join(gone, docs[id_col] == gone["__id"], "left_anti")
