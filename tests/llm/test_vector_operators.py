"""Vector codes and hard negatives against brute force."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from accordant.llm import hard_negatives, vector_codes
from accordant.llm.common import finite, floored

SHAPE = "vec_id long, embedding array<float>, label int, id string, v string, __label string, windows string"


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def table(spark, rows):
    return spark.createDataFrame([(i, v, y, "a", "b", "c", "d") for i, v, y in rows], SHAPE)


def vectors(n, width, rng, labels=3):
    out = [(i, [rng.gauss(0, 0.3) for _ in range(width)], rng.randrange(labels)) for i in range(n)]
    return [(i, np.float32(v).tolist(), y) for i, v, y in out]


# --- codes ---------------------------------------------------------------------------------

def test_orchard_equals_full_search_and_measures_less():
    rng = np.random.default_rng(3)
    centres = rng.integers(-4000, 4000, (32, 8))
    x = centres[rng.integers(0, 32, 3000)] + rng.integers(-60, 60, (3000, 8))
    search = vector_codes.Orchard(centres)
    code, distance, measured = search.nearest(x)
    full = ((x[:, None, :] - centres[None, :, :]) ** 2).sum(axis=2)
    assert (code == full.argmin(axis=1)).all() and (distance == full.min(axis=1)).all()
    assert measured < 0.8 * full.size


def test_orchard_ties_go_to_the_smaller_number():
    entries = np.array([[4, 0], [0, 0], [0, 0], [2, 2], [2, -2], [4, 0]])
    x = np.array([[2, 0], [0, 0], [4, 0], [3, 1], [1, 1]])
    full = ((x[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)
    for start in range(len(entries)):
        code, distance, _ = vector_codes.Orchard(entries).nearest(x, start)
        assert code.tolist() == full.argmin(axis=1).tolist() and distance.tolist() == full.min(axis=1).tolist()


def want_codes(rows, scale, parts, entries, rounds):
    """Plain Python: every distance, whole numbers only."""
    kept = [(i, [math.floor(scale * float(x)) for x in v], y) for i, v, y in rows if usable(v)]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    width = len(kept[0][1]) // parts
    part = lambda v, p: v[p * width : (p + 1) * width]
    books = [[part(v, p) for _, v, _ in first] for p in range(parts)]
    away = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda u, book: min((away(u, c), k) for k, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            falls = [near(part(v, p), books[p])[1] for _, v, _ in kept]
            for k in range(len(books[p])):
                own = [part(v, p) for (_, v, _), f in zip(kept, falls) if f == k]
                if own:
                    books[p][k] = [sum(c) // len(own) for c in zip(*own)]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    out = []
    for i, v, y in kept:
        found = [near(part(v, p), books[p]) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), y))
    label = {}
    for *_, e, y in out:
        label[y] = label.get(y, 0) + e
    return sorted(((i, c, e, label[y], digest) for i, c, e, y in out), key=str)


def odd_rows(width, rng):
    rows = vectors(120, width, rng)
    rows += [(200, None, 1), (201, [None] + [0.1] * (width - 1), 1), (202, [math.nan] * width, 1), (203, [math.inf] + [0.0] * (width - 1), 0)]
    rows += [(204, [0.0] * width, None), (205, rows[3][1], None), (None, rows[4][1], 2), (7, rows[9][1], 1), rows[11], rows[11], (-3, rows[12][1], 0)]
    return rows


@pytest.mark.parametrize("entries,rounds", [(16, 6), (3, 2), (200, 1)])
def test_codes_equal_brute_force(spark, entries, rounds):
    rows = odd_rows(8, random.Random(5))
    got = vector_codes.compress(table(spark, rows).repartition(5), scale=4096, parts=4, entries=entries, rounds=rounds)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == want_codes(rows, 4096, 4, entries, rounds)


def test_codes_of_few_and_no_rows(spark):
    one = table(spark, [(5, [0.5, -0.25], None)])
    got = vector_codes.compress(one, parts=2).collect()
    assert [(r.vec_id, r.code, r.error, r.label_error) for r in got] == [(5, "0000", 0, 0)]
    empty = vector_codes.compress(one.limit(0), parts=2)
    assert empty.count() == 0 and empty.columns == vector_codes.compress(one, parts=2).columns
    # A vector of another length than most takes no part; a length that does not split is refused.
    mixed = table(spark, [(1, [0.5, 0.5], 1), (2, [0.5, 0.25], 1), (3, [], 1), (4, [1.0], 1)])
    assert sorted(r.vec_id for r in vector_codes.compress(mixed, parts=2).collect()) == [1, 2]
    with pytest.raises(ValueError):
        vector_codes.compress(one, parts=4)
    with pytest.raises(ValueError):
        vector_codes.compress(table(spark, [(1, [3e38, 0.0], 1)]), parts=2)


def test_codes_decode_near_the_vectors():
    rng = np.random.default_rng(1)
    x = rng.integers(-50, 50, (400, 8))
    books = vector_codes.Codebooks(np.stack(np.split(x[:64], 4, axis=1)))
    codes, error = books.encode(x)
    assert (((books.decode(codes) - x) ** 2).sum(axis=1) == error).all()
    assert (error[:64] == 0).all()


# --- hard negatives ------------------------------------------------------------------------

def want_negatives(rows, is_anchor, positives=5, negatives=5, low=80, high=100):
    kept = [(i, v, y) for i, v, y in rows if i is not None and y is not None and v is not None and None not in v]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a, av, ay in sorted(set((i, tuple(v), y) for i, v, y in kept if is_anchor(i))):
        best = sorted(((-dot(av, v), i) for i, v, y in kept if y == ay and i != a))[:positives]
        other = sorted(((-dot(av, v), i) for i, v, y in kept if y != ay))
        for p, pid in best:
            window = [(n, i) for n, i in other if low * -p <= 100 * -n <= high * -p][:negatives]
            out += [(a, pid, r, i, -p, -n) for r, (n, i) in enumerate(window, 1)]
    return sorted(out)


def mined(df, **options):
    return sorted(map(tuple, hard_negatives.mine(df, F.col("vec_id") % 10 == 0, **options).collect()))


def integers(rows, scale=64):
    return [(i, None if v is None else [None if x is None or not math.isfinite(x) else math.floor(scale * x) for x in v], y) for i, v, y in rows]


@pytest.mark.parametrize("width,block_rows,chunk_rows", [(12, 4096, 1024), (12, 20, 3), (3, 16, 4), (24, 50, 100)])
def test_negatives_equal_brute_force(spark, width, block_rows, chunk_rows):
    rng = random.Random(width)
    rows = vectors(260, width, rng, labels=4)
    rows = [(i, v if i % 5 else [abs(x) for x in v], y) for i, v, y in rows]
    rows += [(500, None, 1), (510, [None] + [0.1] * (width - 1), 1), (520, [0.0] * width, 1), (530, rows[10][1], None), (None, rows[20][1], 2)]
    rows += [(600 + i, rows[10][1], rows[10][2]) for i in range(40)] + [(700 + i, rows[10][1], (rows[10][2] + 1) % 4) for i in range(40)]
    whole = integers(rows)
    df = spark.createDataFrame([(i, v, y, "a", "b", "c") for i, v, y in whole], "vec_id long, v array<long>, label int, id string, akey string, windows string")
    want = want_negatives(whole, lambda i: i % 10 == 0)
    assert len(want) > 200 and mined(df.repartition(3), block_rows=block_rows, chunk_rows=chunk_rows) == want
    assert mined(df, n_positives=2, n_negatives=3, low=50, high=95) == want_negatives(whole, lambda i: i % 10 == 0, 2, 3, 50, 95)


def test_negatives_of_small_tables(spark):
    shape = "vec_id long, v array<long>, label int"
    assert mined(spark.createDataFrame([], shape)) == []
    assert mined(spark.createDataFrame([(10, [1, 2], 1)], shape)) == []
    assert mined(spark.createDataFrame([(10, [1, 2], 1), (11, [1, 2], 1), (12, [1, 2], 2), (13, [1, 2, 3], 2)], shape)) == [(10, 11, 1, 12, 5, 5)]
    # A zero score has a window of zero, a negative score none.
    assert mined(spark.createDataFrame([(10, [0, 0], 1), (11, [1, 2], 1), (12, [1, 2], 2)], shape)) == [(10, 11, 1, 12, 0, 0)]
    assert mined(spark.createDataFrame([(10, [1, 0], 1), (11, [-1, 2], 1), (12, [-1, 2], 2)], shape)) == []
    # Values beyond the exact range of doubles.
    big = 2**24 + 1
    assert mined(spark.createDataFrame([(10, [big, 1], 1), (11, [big, 3], 1), (12, [big, 3], 2), (13, [big, 4], 2)], shape)) == [(10, 11, 1, 12, big * big + 3, big * big + 3)]
    with pytest.raises(ValueError):
        mined(spark.createDataFrame([(10, [2**40, 1], 1)], shape))


def test_index_returns_every_pair_above_the_threshold():
    rng = np.random.default_rng(7)
    rows = (rng.standard_normal((500, 20)) * rng.gamma(1.0, 20.0, (500, 1))).astype(np.int64)
    asked = (rng.standard_normal((70, 20)) * 30).astype(np.int64)
    full = asked @ rows.T
    for kind in (float, np.int64):
        index = hard_negatives.BlockIndex(rows.astype(kind))
        for share in (0.9, 0.5, 0.1, -np.inf):
            least = np.full(70, full.max() * share)
            a, b, s = index.above(asked.astype(kind), least)
            want = np.argwhere(full >= least[:, None])
            assert sorted(zip(a, b)) == sorted(map(tuple, want)) and (s == full[a, b]).all()


def test_floors_and_finite_vectors(spark):
    df = table(spark, [(1, [-0.1, 0.1], 1), (2, [math.nan, 0.0], 1), (3, None, 1), (4, [None, 1.0], 1), (5, [], 1)])
    got = df.filter(finite("embedding")).select("vec_id", floored("embedding", 256).alias("f")).collect()
    assert [(r.vec_id, r.f) for r in got] == [(1, [math.floor(256 * float(np.float32(-0.1))), 25]), (5, [])]
