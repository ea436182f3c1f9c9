"""Fuzzy line deduplication by MinHash, in DataFrame expressions only.

Every line is read whole, as the shingles of ``width`` characters that begin at each of its characters.
MinHash values over the shingles are banded for high recall; lines that share a band bucket are
compared with the bucket's centre by the exact Jaccard similarity of their sets.  One byte
of each minimum, by a bound of several standard errors, rules pairs out before their texts are moved, in the rounds
after the first as a condition of the join that would make the pair.  Distributed
union-find joins the links.  A bucket whose lines then hang together is done; in any other one, lines outside
of its largest group meet all others as leaders, up to 64 of them, then sixteen times as many, and so on until
all hang together or all have met.  There the sets' sizes and a parity sketch, which never rules out a pair that
reaches the threshold, keep pairs of looser copies from being made.  One line of each component stays.

Bounds: copies of a line are one row after the first, map-side combined, aggregate.  The keys of a bucket
are counted in one task, which spills if they are many; texts and pairs of a bucket are never gathered:
leaders are drawn by hash and joined, so a round makes a few pairs per member.  The one broadcast is a set of hash slots of fixed
size; it spares moving lines without a partner and may pass too many, never too few.
"""

from __future__ import annotations

import random
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from accordant.llm.common import whole_text
from accordant.llm.graph import components
from accordant.operators.joins import rejoin_keys
from accordant.sources.workspace import stored

#: Slots of the broadcast filter: at most this many rows, whatever the input.
SLOTS = 1 << 21
#: Classes of shingles, and minima of each class.
CLASSES, MINIMA = 4, 10


def signs_of(line: Column) -> Column:
    """The line with four bytes to a character, so that any character is found without counting from the start."""
    return F.encode(line, "UTF-32")


def _starts(signs: Column, width: int) -> Column:
    """The bytes at which shingles begin, from 1; a line shorter than ``width`` is one shingle."""
    return F.sequence(F.lit(1), F.greatest(F.lit(1), F.octet_length(signs) - (4 * width - 1)), F.lit(4))


def _shingle(signs: Column, at: Column, width: int) -> Column:
    return F.substring(signs, at, F.lit(4 * width))


def shingle_set(line: Column, width: int) -> Column:
    """The distinct shingles of a line, hashed to 64 bits.

    The signs are an outer lambda's variable, so the line is encoded once and not per shingle.  Lambdas are interpreted,
    so copies are left out outside of them, in generated code.
    """
    each = lambda u: F.transform(_starts(u, width), lambda at: F.xxhash64(_shingle(u, at, width)))
    return F.array_distinct(F.transform(F.array(signs_of(line)), each)[0])


def once(df: DataFrame, *keep: str, **columns: Column) -> DataFrame:
    """The columns ``keep`` and new ones, which are computed once a row.

    The planner would write a costly expression out in every filter over it, those that it adds by itself included;
    it does not move filters below the explode of one struct.  They are made before it, in generated code.
    """
    made = df.select(*keep, *[c.alias(k) for k, c in columns.items()])
    made = made.select(*keep, F.explode(F.array(F.struct(*columns))).alias("__made"))
    return made.select(*keep, *[F.col(f"__made.{k}").alias(k) for k in columns])


def line_rows(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc, line_no, key, line) of the lines of at least ``min_chars`` characters."""
    lines = docs.select("doc", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.filter(F.char_length("line") >= min_chars).select("doc", "line_no", F.xxhash64("line").alias("key"), "line")


def band_places(n_bands: int, n_rows: int) -> list[list[tuple[int, int]]]:
    """The (class, minimum) pairs of each band: classes in turn, every minimum in two bands or so."""
    rng, pools, out = random.Random(3), [[] for _ in range(CLASSES)], []
    for b in range(n_bands):
        band: list[tuple[int, int]] = []
        for r in range(n_rows):
            c = (b + r) % CLASSES
            if not any((c, k) not in band for k in pools[c]):
                pools[c] += rng.sample(range(MINIMA), MINIMA)
            k = next(k for k in pools[c] if (c, k) not in band)
            pools[c].remove(k)
            band.append((c, k))
        out.append(band)
    return out


#: Minima whose bytes go into one long; the highest byte stays free, so that sums stay in range.
_PER_LONG = 7
_LOW7, _HIGH = int("7f" * _PER_LONG, 16), int("80" * _PER_LONG, 16)


def sketch(minima: list[Column]) -> Column:
    """One byte of each minimum, seven to a long; a missing minimum is 0."""
    # As few operations as will do: the compiler leaves methods beyond 8,000 bytes to be interpreted.
    byte = [F.coalesce(m, F.lit(0)).bitwiseAND(0xFF00).cast("long") for m in minima]
    longs = [byte[i : i + _PER_LONG] for i in range(0, len(byte), _PER_LONG)]
    placed = lambda part: [F.shiftright(part[0], 8), *[F.shiftleft(b, 8 * i) if i else b for i, b in enumerate(part[1:])]]
    return F.struct(*[reduce(Column.bitwiseOR, placed(part)).alias(f"s{k}") for k, part in enumerate(longs)])


def agreeing(a: str, b: str, minima: int = CLASSES * MINIMA) -> Column:
    """How many bytes two sketches have in common: zero bytes of their difference, counted without a loop."""
    out = F.lit(0)
    for k in range(-(-minima // _PER_LONG)):
        z = F.col(f"{a}.s{k}").bitwiseXOR(F.col(f"{b}.s{k}"))
        nonzero = (z.bitwiseAND(F.lit(_LOW7)) + F.lit(_LOW7)).bitwiseOR(z).bitwiseAND(F.lit(_HIGH))
        out = out + min(_PER_LONG, minima - k * _PER_LONG) - F.bit_count(nonzero)
    return out


def may_reach(percent: int, errors: float = 3.5) -> Column:
    """Whether lines with sketches ``x`` and ``y``, resting on ``seen`` and ``met`` shingles, may be similar enough.

    Lines whose minima rest on few shingles are given a wider margin; a pair at the threshold is ruled out with odds
    of some 1 in 4,000.
    """
    t = percent / 100
    margin = errors * F.sqrt(t * (1 - t) / F.least(F.lit(CLASSES * MINIMA), "seen", "met"))
    return agreeing("x", "y") >= F.floor(CLASSES * MINIMA * (t - margin))


#: Longs of a parity sketch.
PARITY = 16


def parities(texts: DataFrame, width: int) -> DataFrame:
    """(key, n, o): the size of each line's set, and for each of 64 ``PARITY`` bits whether an odd number of its shingles fall on it."""
    each = once(texts, "key", s=shingle_set(F.col("line"), width)).select("key", F.explode("s").alias("h"))
    bit = F.expr("shiftleft(1L, cast(shiftrightunsigned(h, 16) & 63 AS int))")
    words = each.groupBy("key", F.col("h").bitwiseAND(PARITY - 1).alias("w")).agg(F.bit_xor(bit).alias("bits"), F.count(F.lit(1)).alias("c"))
    longs = [F.coalesce(F.bit_xor(F.when(F.col("w") == k, F.col("bits"))), F.lit(0).cast("long")).alias(f"p{k}") for k in range(PARITY)]
    flat = words.groupBy("key").agg(F.sum("c").alias("n"), *longs)
    return flat.select("key", "n", F.struct(*[f"p{k}" for k in range(PARITY)]).alias("o"))


def can_reach(percent: int) -> Column:
    """Whether sets of ``n`` and ``m`` shingles with parity sketches ``o`` and ``q`` can be similar enough.

    Each shingle that only one of them has changes one bit, so differing bits are at most as many as such shingles:
    what is ruled out is below the threshold for certain.
    """
    bits = sum((F.bit_count(F.col(f"o.p{k}").bitwiseXOR(F.col(f"q.p{k}"))) for k in range(PARITY)), F.lit(0))
    return (100 + percent) * F.greatest(bits, F.abs(F.col("n") - F.col("m"))) <= (100 - percent) * (F.col("n") + F.col("m"))


def minima_names(places: list[list[tuple[int, int]]]) -> list[str]:
    """The columns of the minima that bands use."""
    return [f"m{c}_{k}" for c, k in sorted({p for band in places for p in band})]


def _masks() -> list[int]:
    """What each minimum's hash function XORs the first one with."""
    rng = random.Random(1)
    return [((k << 28) | rng.getrandbits(28)) - (1 << 31) for k in rng.sample(range(16), MINIMA)]


def unfolded(lines: DataFrame, width: int) -> DataFrame:
    """(key, h): a hash of every shingle of the lines."""
    each = lines.select("key", signs_of(F.col("line")).alias("u")).select("key", "u", F.explode(_starts(F.col("u"), width)).alias("at"))
    return each.select("key", F.hash(_shingle(F.col("u"), F.col("at"), width)).alias("h"))


def minima(lines: DataFrame, *, width: int, places: list[list[tuple[int, int]]]) -> DataFrame:
    """(key, minima, seen): the MinHash values of each distinct line, and on how many shingles those of all classes rest.

    Shingles are unfolded inside generated code and the aggregate takes the minima as they come.
    A shingle falls into one of ``CLASSES`` classes by its hash and counts for that class's minima
    only, which saves most of the work; a band takes its values from different classes.  A further hash
    function is the first one XORed with a constant, whose first bits differ within a class.
    """
    # Copies are combined first; what follows needs no further exchange.
    each = unfolded(lines.groupBy("key").agg(F.min("line").alias("line")), width)
    masks = _masks()
    least = each.groupBy("key", F.col("h").bitwiseAND(CLASSES - 1).alias("c")).agg(*[F.min(F.col("h").bitwiseXOR(F.lit(m))).alias(f"m{k}") for k, m in enumerate(masks)])
    # Classes have no hash in common, so their shingles add up.
    least = least.withColumn("seen", F.size(F.array_distinct(F.array(*[F.col(f"m{k}").bitwiseXOR(F.lit(m)) for k, m in enumerate(masks)]))))
    used = sorted({p for band in places for p in band})
    return least.groupBy("key").agg(*[F.min(F.when(F.col("c") == c, F.col(f"m{k}"))).alias(f"m{c}_{k}") for c, k in used], F.sum("seen").cast("int").alias("seen"))


def band_hashes(places: list[list[tuple[int, int]]]) -> Column:
    """One hash per band of the minima it holds."""
    return F.array(*[F.xxhash64(F.lit(b), *[f"m{c}_{k}" for c, k in band]) for b, band in enumerate(places)])


def _slot(key: str | Column) -> Column:
    return F.pmod(key if isinstance(key, Column) else F.col(key), F.lit(SLOTS))


def only_near(df: DataFrame, keys: DataFrame, column: str = "key") -> DataFrame:
    """Rows whose hash slot is one of the keys' slots; the broadcast holds at most ``SLOTS`` rows."""
    slots = keys.select(_slot(column).alias("slot")).distinct()
    return df.join(F.broadcast(slots), _slot(column) == F.col("slot"), "left_semi")


def similar(pairs: DataFrame, texts: DataFrame, *, width: int, percent: int) -> DataFrame:
    """The pairs whose sets, built where the lines meet, share at least ``percent`` percent of their union."""
    # A line is far smaller than its set, so lines travel.
    left, right = texts.select("key", "line"), texts.select(F.col("key").alias("lead"), F.col("line").alias("other"))
    lines = pairs.join(left, "key").join(right, "lead")
    sets = once(lines, "key", "lead", s=shingle_set(F.col("line"), width), t=shingle_set(F.col("other"), width))
    sizes = once(sets, "key", "lead", both=F.size(F.array_intersect("s", "t")), sum=F.size("s") + F.size("t"))
    return sizes.filter(100 * F.col("both") >= percent * (F.col("sum") - F.col("both"))).select("key", "lead")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("key", "lead")).alias("key"))


def links(lines: DataFrame, *, width: int, n_bands: int, n_rows: int, percent: int, leaders: int = 64) -> DataFrame:
    """(a, b) keys of lines whose sets share at least ``percent`` percent of their union."""
    places = band_places(n_bands, n_rows)
    signed = stored(minima(lines, width=width, places=places), "line-minima")
    # One exchange finds the lines that share a bucket; of a bucket only keys are sorted, and spilled if they are many.
    members, same = signed.select("key", F.explode(band_hashes(places)).alias("bucket")), Window.partitionBy("bucket")
    pending = stored(members.withColumn("size", F.count(F.lit(1)).over(same)).filter("size > 1"), "line-members")
    # A line that meets many others is the best centre of its buckets.
    degree = pending.groupBy("key").agg(F.sum("size").alias("degree"))
    centre = F.max_by("key", F.col("degree") * SLOTS + _slot("key")).over(same).alias("centre")
    first = pending.select("key", "bucket").join(degree, "key").select("key", centre).filter("key != centre")
    first = first.select(F.greatest("key", "centre").alias("key"), F.least("key", "centre").alias("lead")).distinct()
    traits = only_near(signed, pending).select("key", sketch([F.col(m) for m in minima_names(places)]).alias("x"), "seen")
    traits = stored(traits, "line-traits")
    # Pairs of a member and its centre are no more than members; both sketches come to a pair, not to all places of a line.
    other = traits.select(F.col("key").alias("lead"), F.col("x").alias("y"), F.col("seen").alias("met"))
    pairs = stored(first.join(traits, "key").join(other, "lead").filter(may_reach(percent)).select("key", "lead"), "line-pairs")
    # Texts are moved for lines that were paired or may be, not for all that share a bucket with one other line.
    pending = pending.filter("size > 2").select("key", "bucket")
    wanted = _ends(pairs).unionByName(pending.select("key")).distinct()
    texts = only_near(lines.select("key", "line"), wanted).join(wanted, "key", "left_semi").groupBy("key", "line").agg(F.lit(1))
    texts = stored(texts.select("key", "line"), "line-texts")
    found, count = None, 0
    while True:
        # Rounds pair some of the lines, and only texts of about those are moved.
        taken = stored(similar(pairs, only_near(texts, _ends(pairs)), width=width, percent=percent), "line-links")
        found = taken if found is None else found.unionByName(taken)
        pending = pending.filter(F.col("outside") > count).drop("most", "outside") if count else pending
        if pending.isEmpty():
            return found.select(F.col("key").alias("a"), F.col("lead").alias("b"))
        # A bucket that hangs together has no link left that would matter.  In any other one, lines outside of the largest
        # group are the next leaders; once all of them have met the others, every pair has met or hangs together.
        parts = components(found, "key", "lead").withColumnRenamed("node", "key")
        placed = stored(pending.drop("root").join(parts, "key", "left").withColumn("root", F.coalesce("root", "key")), "line-members")
        groups = placed.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("rows"))
        apart = groups.groupBy(*rejoin_keys("bucket")).agg(F.max_by("root", "rows").alias("most"), (F.sum("rows") - F.max("rows")).alias("outside")).drop("__spread")
        pending = placed.join(apart.filter("outside > 0"), "bucket")
        if not count:
            # Only lines of such buckets get their sketches along, and the larger one that rules pairs out for certain.
            pending = stored(pending, "line-members")
            exact = parities(only_near(texts, pending).join(pending.select("key").distinct(), "key", "left_semi"), width)
            pending = pending.join(only_near(traits, pending).join(exact, "key"), "key")
        pending = stored(pending, "line-members")
        if pending.isEmpty():
            return found.select(F.col("key").alias("a"), F.col("lead").alias("b"))
        count = max(leaders, 16 * count)
        drawn = pending.filter((F.col("root") != F.col("most")) & (F.pmod(F.xxhash64("key", "bucket"), F.col("outside")) < count))
        lead = drawn.select(F.col("bucket").alias("at"), F.col("key").alias("lead"), F.col("root").alias("lead_root"), F.col("x").alias("y"), F.col("seen").alias("met"),
                            F.col("n").alias("m"), F.col("o").alias("q"))
        # Lines that hang together already need not meet again; what may not reach the threshold never leaves the join.
        met = pending.join(lead, (F.col("bucket") == F.col("at")) & (F.col("root") != F.col("lead_root")) & may_reach(percent) & can_reach(percent))
        pairs = stored(met.select(F.greatest("key", "lead").alias("key"), F.least("key", "lead").alias("lead")).distinct(), "line-pairs")


def decide(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, n_bands: int = 20, n_rows: int = 5,
           percent: int = 80, min_chars: int = 20) -> DataFrame:
    """One row per line of at least ``min_chars`` characters: doc (id, digest of the text), line_no from 0,
    ``component``, ``kept``.

    Of all lines in a component the first stays, by id, text digest and number.  Shorter lines are not
    judged and always stay.  Null and empty texts have no such lines; null ids come first.  Rows that
    agree in id and text are one document and get one decision.
    """
    rows = docs.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(whole_text(text_col)).alias("digest")).alias("doc"), whole_text(text_col).alias("text"))
    lines = line_rows(rows, min_chars)
    parts = components(links(lines.select("key", "line"), width=width, n_bands=n_bands, n_rows=n_rows, percent=percent), "a", "b")
    parts = stored(parts.select(F.col("node").alias("key"), "root"), "line-parts")
    placed = stored(lines.select("doc", "line_no", "key").join(parts, "key", "left").select("doc", "line_no", F.coalesce("root", "key").alias("component")), "line-places")
    where = [F.col("doc.id").alias("id"), F.col("doc.digest").alias("digest"), F.col("line_no")]
    # The first line by three minima, each an aggregate over plain columns.
    flat = placed.select(*where, "component", F.col("id").isNotNull().alias("named"))
    # Grouped by component and hash, so that the join has its own exchange and a component of very many lines can be split.
    first = flat.groupBy(*rejoin_keys("component")).agg(F.min(F.struct("named", "id", "digest", "line_no")).alias("first")).drop("__spread")
    me = F.struct("named", "id", "digest", "line_no")
    return flat.join(first, "component").select("id", "digest", "line_no", "component", (me.eqNullSafe(F.col("first"))).alias("kept"))


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents with the lines that ``decide`` drops taken out; all rows and columns stay.

    A null text stays null; a text that loses every line is empty.
    """
    drops = decide(docs, id_col=id_col, text_col=text_col, **options).filter("not kept").groupBy(F.col("id").alias("__id"), F.col("digest").alias("__digest")).agg(F.collect_set("line_no").alias("__drop"))
    # The rows travel as one column, so that no name of theirs can meet one of ours.
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.xxhash64(whole_text(text_col)).alias("__h"), F.col(id_col).alias("__own"))
    joined = keyed.join(drops.hint("shuffle_hash"), F.col("__h").eqNullSafe(F.col("__digest")) & F.col("__own").eqNullSafe(F.col("__id")), "left")
    old = F.col("__row")[text_col]
    left = F.array_join(F.filter(F.split(old, "\n"), lambda x, i: ~F.array_contains("__drop", i)), "\n")
    text = F.when(F.col("__drop").isNull(), old).otherwise(left)
    return joined.select(*[(text if c == text_col else F.col("__row")[c]).alias(c) for c in docs.columns])
