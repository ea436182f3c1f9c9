"""The n-gram Jaccard join against brute force."""

import random

import numpy as np
import pytest

from accordant.llm import ngram_join
from accordant.llm.near_dedup import shingle_hashes

SHAPE = "doc_id long, text string, id string, key string, handle string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], SHAPE)


def shingles(text, width):
    words = "".join(c.lower() if c.isascii() else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def want(rows, width, percent):
    sets = [shingles(t, width) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if sets[i] and doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return sorted(((doc, len(sets[i]), least.get(find(i)) if sets[i] else doc) for i, (doc, _) in enumerate(rows)), key=str)


def got(df, **options):
    return sorted(map(tuple, ngram_join.join(df, **options).collect()), key=str)


def edited(words, n, rng):
    words = list(words)
    for _ in range(n):
        at = rng.randrange(len(words) + 1)
        move = rng.randrange(3)
        if move == 0 and len(words) > 1:
            del words[min(at, len(words) - 1)]
        elif move == 1:
            words.insert(at, f"e{rng.randrange(50)}")
        else:
            words[min(at, len(words) - 1)] = f"e{rng.randrange(50)}"
    return words


def families(rng, sizes, copies, most):
    """Texts of given lengths, each with copies that differ in up to a few words."""
    out = []
    for n in sizes:
        base = [f"w{rng.randrange(3000)}" for _ in range(n)]
        out.append(base)
        out += [edited(base if rng.random() < 0.6 else rng.choice(out[-3:]), rng.randint(0, most), rng) for _ in range(copies)]
    return [" ".join(w) for w in out]


def test_bands_and_tolerances():
    for percent in (50, 80, 90, 95, 99):
        bands = ngram_join.Bands(percent)
        for n in range(1, 700):
            k = bands.of(n)
            for m in range(-(-percent * n // 100), n + 1):
                # The most that a set of size m and one of size n may differ in when linked.
                both = -(-percent * (n + m) // (100 + percent))
                differ = n + m - 2 * both
                if both > m:
                    continue
                j = bands.of(m)
                if j < 0:
                    assert differ == 0
                    continue
                assert j in (k, k - 1)
                assert differ < bands.needed(n, j) <= bands.segments(j)
    assert ngram_join.Bands(100).of(10**9) == -1


def test_allocation_adds_up():
    rng = np.random.default_rng(2)
    for n, segments, needed in ((9, 2, 2), (12, 6, 5), (10, 9, 9), (3, 5, 5), (80, 13, 9)):
        for _ in range(30):
            dealt = ngram_join.Dealt(rng.integers(0, 2**63, n).astype(np.uint64), segments)
            free, widened, empty = dealt.allocation(needed)
            full = np.count_nonzero(dealt.counts)
            assert full - free + len(widened) + len(empty) >= needed and (dealt.counts[widened] > 0).all() and (dealt.counts[empty] == 0).all()


def test_neighbours_lose_one_shingle_each():
    h = shingle_hashes("a b c d e f g h i j k l m n o p q r s t", 3)
    dealt = ngram_join.Dealt(h, 4)
    for i in range(4):
        own = h[h % np.uint64(4) == i]
        less = sorted(ngram_join.Dealt(np.delete(own, j), 4).names[i].tobytes() for j in range(len(own)))
        assert sorted(dealt.neighbours(i)) == less


@pytest.mark.parametrize("width,percent", [(3, 90), (1, 80), (2, 95), (5, 60)])
def test_join_equals_brute_force(spark, width, percent):
    rng = random.Random(percent)
    texts = families(rng, [3, 4, 9, 10, 11, 12, 14, 16, 20, 25, 30, 40, 60, 80, 120, 200], 9, 3)
    texts += [None, "", " \t\n", "a", "A", "a b", "A  B", "É b", "é b", "a b c", "a\x0bb\x0cc", "x\xa0y z"]
    rows = list(enumerate(texts)) + [(3, texts[3]), (4, texts[60]), (None, texts[61]), (None, None), (None, "only here"), (None, "only HERE")]
    rng.shuffle(rows)
    expected = want(rows, width, percent)
    assert len({c for *_, c in expected}) < len(rows) - 20
    assert got(docs(spark, rows).repartition(3), width=width, percent=percent) == expected


@pytest.mark.parametrize("block,pivots", [(8, 1), (16, 4)])
def test_large_groups_in_blocks(spark, block, pivots):
    """A chain of near copies, a group of copies of one text, and texts that share most of their shingles without a link."""
    rng = random.Random(9)
    chain = [[f"c{i}" for i in range(60)]]
    for step in range(70):
        chain.append([*chain[-1][1:], f"n{step}"])
    star = [f"s{i}" for i in range(40)]
    texts = [" ".join(w) for w in chain] + [" ".join(edited(star, 1, rng)) for _ in range(60)]
    texts += [" ".join([*star[:34], *(f"u{i}x{j}" for j in range(6))]) for i in range(50)]
    rows = [(i * 7 % 1009, t) for i, t in enumerate(texts)]
    assert got(docs(spark, rows), percent=90, block=block, pivots=pivots) == want(rows, 3, 90)
    assert got(docs(spark, rows), percent=90, block_shingles=500, pivots=pivots) == want(rows, 3, 90)


def test_empty_segments_still_find_every_link(spark):
    """At 50 % there are about as many segments as shingles, so many are empty: tolerance 1 must carry the links."""
    rng = random.Random(4)
    rows = list(enumerate(families(rng, [4, 5, 6, 7, 8, 9, 11, 13, 15, 18, 22, 27], 8, 3)))
    df = docs(spark, rows)
    signed = ngram_join.signatures(df.selectExpr("doc_id AS id", "text"), ngram_join.Bands(50), width=1)
    assert signed.filter("size(widened) > 0").count() > 30
    assert got(df, percent=50, width=1) == want(rows, 1, 50)


def test_empty_and_single(spark):
    empty = ngram_join.join(docs(spark, [(1, "a")]).limit(0))
    assert empty.columns == ["doc_id", "n_shingles", "component_id"] and empty.count() == 0
    assert got(docs(spark, [(1, "a b c d")])) == [(1, 2, 1)]
    long = " ".join(f"w{i}" for i in range(40_000))
    assert got(docs(spark, [(2, long), (1, long + " end"), (3, long[: len(long) // 2])])) == [(1, 39999, 1), (2, 39998, 1), (3, shingles(long[: len(long) // 2], 3).__len__(), 3)]
