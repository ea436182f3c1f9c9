"""Encoders, frames, packing, search and the pipeline."""

import collections
import io
import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from accordant.llm import ann, bpe, frames, packing, tokens
from accordant.llm.queries import QUERIES

SHAPE = "doc_id long, text string, ids string, key string"
ODD = ["", "a  b", "a   b  c \n\n  d\n e", "  lead", "trail  ", "I'll  've 's", "<|endoftext|> <|startoftext|>", "日本語 テキスト", "ſ İ Σ ΣΑΣ", "\r\n \r\n", " ", "é́ x", "\x85 a\xa0c", "²³ ¼ ªº", None]


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], SHAPE)


def mixed(n, seed=1):
    rng = random.Random(seed)
    letters = [chr(i) for i in range(0x250)] + list(" 'sabcRe\n" * 30)
    return ["".join(rng.choices(letters, k=rng.randrange(120))) for _ in range(n)]


def test_encoders_equal_the_libraries():
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    whole.encode_special_tokens = True
    lower = tokens.word_level("word_bpe_49k.json")
    ranks, multi = tokens.byte_level("byte_bpe_50k.tiktoken"), tokens.byte_level("byte_bpe_multi_50k.tiktoken")
    for t in [x or "" for x in ODD] + mixed(200):
        assert ranks.encode(t) == whole.encode(t, add_special_tokens=False).ids
        assert lower.encode(t) == tokens.packed(lower.tokenizer.encode(t, add_special_tokens=False).ids)
        assert multi.encode(t) == multi.full.encode_ordinary(t) and multi.decode(multi.encode(t)) == t.encode()


@pytest.mark.parametrize("sizes", [{}, {"chunk": 40, "overlap": 12}, {"chunk": 200, "overlap": 60}])
def test_chunked_bpe(spark, sizes):
    texts = ODD + mixed(40, 2) + ["a" * 500 + " b " + "1" * 300 + " " * 200 + "z", "don't we're " * 50 + "'" * 100 + "\n\n" * 40, "ab " * 100]
    df = docs(spark, texts)
    df = df.unionByName(df.limit(3))
    whole = tokens.byte_level("byte_bpe_multi_50k.tiktoken").full
    encoded = bpe.encode(df, **sizes)
    want = sorted((r.doc_id, tokens.packed(whole.encode_ordinary(r.text or ""))) for r in df.collect())
    assert sorted((r.doc_id, bytes(r.ids)) for r in encoded.collect()) == want
    assert {(r.doc_id, bytes(r.bytes)) for r in bpe.decode(encoded).collect()} == {(i, (t or "").encode()) for i, t in enumerate(texts)}
    assert bpe.encode(df.limit(0)).count() == 0


def test_frame_file_is_seekable_and_checked():
    out = io.BytesIO()
    writer = frames.Writer(out, frame_ids=10)
    rows = [(5 * i, tokens.packed(list(range(i)))) for i in range(20)]
    for i, ids in rows:
        writer.add(i, ids)
    writer.close()
    raw = out.getvalue()
    reader = frames.Reader(io.BytesIO(raw), len(raw))
    assert [(i, ids) for _, i, _, ids in reader.read()] == rows and len(reader.frames) > 5
    opened = []
    reader.frame = lambda k, f=reader.frame: opened.append(k) or f(k)
    assert [(i, ids) for _, i, _, ids in reader.read([35])] == [rows[7]] and len(opened) == 1
    broken = bytearray(raw)
    broken[20] ^= 1
    with pytest.raises(Exception):
        list(frames.Reader(io.BytesIO(bytes(broken)), len(raw)).read())
    empty = io.BytesIO()
    frames.Writer(empty).close()
    assert list(frames.Reader(empty, len(empty.getvalue())).read()) == []


def test_frames_round_trip(spark):
    texts = ODD + mixed(60, 3)
    df = docs(spark, texts).repartition(5)
    manifest = frames.write(df, rows_per_file=16, frame_ids=64)
    got = {r.doc_id: r for r in frames.read(manifest).collect()}
    lower, start = tokens.word_level("word_bpe_49k.json"), 0
    for i, t in enumerate(texts):
        ids = lower.encode(t or "") + tokens.packed([2])
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32, bytes(got[i].ids)) == (start, len(ids) // 4, zlib.crc32(ids), ids)
        start += len(ids) // 4
    assert manifest.count() > 2 and {r.doc_id for r in frames.read(manifest, [3, 40]).collect()} == {3, 40}
    assert frames.read(frames.write(df.limit(0))).count() == 0


def test_packing_plan_is_whole_and_tight():
    for seed in range(8):
        rng = random.Random(seed)
        capacity = rng.choice([10, 50, 2048])
        counts = collections.Counter(min(capacity, max(1, int(rng.lognormvariate(3, 1)))) for _ in range(rng.choice([1, 30, 3000])))
        fixed, rest = packing.reduce_dominated(dict(counts), capacity)
        seen = collections.Counter()
        forms = fixed + packing.best_fit(rest, capacity)
        for form, many in forms:
            assert sum(n * t for n, t in form) <= capacity and many > 0
            for n, t in form:
                seen[n] += t * many
        assert seen == counts
        bound = -(-sum(n * c for n, c in counts.items()) // capacity)
        assert sum(m for _, m in forms) <= 11 / 9 * bound + 1


def optimal(items, capacity):
    best = [len(items)]

    def place(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + items[i] <= capacity and bins[k] not in bins[:k]:
                place(i + 1, bins[:k] + [bins[k] + items[i]] + bins[k + 1:])
        place(i + 1, bins + [items[i]])

    place(0, [])
    return best[0]


def test_reduction_keeps_the_optimum():
    rng = random.Random(9)
    for _ in range(60):
        items = sorted((rng.randint(1, 20) for _ in range(9)), reverse=True)
        fixed, rest = packing.reduce_dominated(dict(collections.Counter(items)), 20)
        left = sorted((n for n, c in rest.items() for _ in range(c)), reverse=True)
        assert sum(m for _, m in fixed) + (optimal(left, 20) if left else 0) == optimal(items, 20)


def test_pack(spark):
    rng = random.Random(10)
    texts = ODD + [" ".join(f"w{rng.randrange(99)}" for _ in range(rng.randrange(1, 90))) for _ in range(150)] + ["same words here"] * 60
    df = docs(spark, texts)
    rows = packing.pack_documents(df.unionByName(df.limit(2)), capacity=32).collect()
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
        ids = tokens.packed([*whole.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 0])
        assert r.ids_crc32 == zlib.crc32(ids[4 * r.start: 4 * (r.start + r.length)])
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 32
    assert packing.cut(5, 4) == [(0, 1), (1, 4)] and packing.cut(8, 4) == [(0, 4), (4, 4)] and packing.cut(1, 4) == [(0, 1)]
    assert packing.pack_documents(df.limit(0)).count() == 0


def test_balanced_parts_and_recall(spark):
    rng = np.random.default_rng(11)
    centre = rng.standard_normal((12, 16))
    x = centre[rng.integers(0, 12, 1500)] + 0.4 * rng.standard_normal((1500, 16))
    label = ann.balanced_parts(ann.neighbour_graph(x, 8), 8)
    assert np.bincount(label).max() - np.bincount(label).min() <= 1
    rows = [(i, v.tolist(), "c") for i, v in enumerate(x)] + [(5000, None, "c"), (5001, [0.0] * 16, "c"), (5002, [float("nan")] + [1.0] * 15, "c"),
                                                             (5003, [None] + [1.0] * 15, "c"), (5004, [1.0], "c"), (5005, x[0].tolist(), "c"), (5006, [], "c")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, part string")
    vectors = ann.usual_length(df, "embedding")
    assert vectors.count() == 1501
    model = ann.fit(vectors, id_col="vec_id", vector_col="embedding", parts=8)
    out = ann.search(vectors, vectors.filter("vec_id % 20 = 0"), model, id_col="vec_id", vector_col="embedding", k=10, block_rows=100, chunk_rows=16).collect()
    ids, whole = np.append(np.arange(1500), 5005), np.vstack([x, x[0]])
    found = collections.defaultdict(dict)
    for r in out:
        found[r.query_id][r.rank] = (r.id, r.score)
    hits = 0
    for q in found:
        s = whole @ whole[list(ids).index(q)]
        s[ids == q] = -np.inf
        best = ids[np.lexsort((ids, -s))[:10]]
        assert sorted(found[q]) == list(range(1, 14))
        hits += len(set(best) & {i for i, _ in found[q].values()})
        assert all(abs(v - float(np.dot(whole[list(ids).index(i)], whole[list(ids).index(q)]))) < 1e-9 for i, v in found[q].values())
    assert len(found) == 75 and hits / (10 * len(found)) > 0.9
    few = ann.search(vectors.limit(3), vectors.limit(3), ann.fit(vectors.limit(3), id_col="vec_id", vector_col="embedding"), id_col="vec_id", vector_col="embedding").collect()
    assert len(few) == 6
    none = ann.fit(df.limit(0), id_col="vec_id", vector_col="embedding")
    assert ann.search(df.limit(0), df.limit(0), none, id_col="vec_id", vector_col="embedding").count() == 0


def test_pipeline(spark):
    docs_in = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    rows = out.collect()
    assert {r.doc_id for r in rows} <= {r.doc_id for r in docs_in.collect()} and len(rows) > 100
    bins = collections.Counter()
    for r in rows:
        bins[r.sequence_id] += r.length
    assert max(bins.values()) <= 2048 and 4 <= len(corpus_pipeline.STAGES) <= 5


def test_stages_keep_columns_and_take_nothing(spark):
    shape = "doc_id long, text string, lang string, source string, n_chars long"
    df = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (None, "word " * 40 + "token = 'abcdefghijklmnop1234'", "en", "s", 9)], shape)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, df, "/root/testdata/sf0.001")
        assert got.columns == df.columns and got.count() == 4, name
        assert stage(spark, df.limit(0), "/root/testdata/sf0.001").count() == 0, name


def test_every_operator_has_one_query():
    assert sorted(int(n.split("_")[0][2:]) for n in QUERIES if n.startswith("op")) == list(range(1, 14))
