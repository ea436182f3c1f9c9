"""The pipeline against all five stages in plain Python on the smallest table; leaving any stage out changes the result."""

import collections
import zlib

import pytest

pytest.importorskip("corpus_pipeline")

import corpus_pipeline  # noqa: E402
from accordant.llm import secrets, tokens, toxicity  # noqa: E402

SMALL = "/root/testdata/sf0.001"


def parts(n, pairs):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in pairs:
        root[find(a)] = find(b)
    return [find(i) for i in range(n)]


def similar(sets, percent):
    holders = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            holders[g].append(i)
    for i, s in enumerate(sets):
        for j, n in collections.Counter(j for g in s for j in holders[g] if j > i).items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                yield i, j


def without_toxic(docs, model):
    return {i: t for i, t in docs.items() if model.score([model.features(t or "")])[0] < 0.5}


def without_lines(docs):
    places = [(i, n, x) for i in sorted(docs) for n, x in enumerate((docs[i] or "").split("\n")) if len(x) >= 20]
    lines = sorted({x for *_, x in places})
    group = dict(zip(lines, parts(len(lines), similar([{x[k : k + 5] for k in range(len(x) - 4)} for x in lines], 80))))
    first, gone = set(), set()
    for i, n, x in places:
        if group[x] in first:
            gone.add((i, n))
        first.add(group[x])
    return {i: t if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in gone) for i, t in docs.items()}


def without_copies(docs):
    ids, sets = sorted(docs), []
    for i in ids:
        words = "".join(c.lower() if c.isascii() else c for c in docs[i] or "").encode().split()
        sets.append({tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set())
    root = parts(len(ids), similar(sets, 80))
    least = {}
    for i, r in zip(ids, root):
        least.setdefault(r, i)
    return {i: docs[i] for i, r, s in zip(ids, root, sets) if least[r] == i or not s}


def masked(docs, table):
    return {i: t if not t else secrets.redact(t, secrets.all_spans(t, table)[1]) for i, t in docs.items()}


def pieces(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = set()
    for i, t in docs.items():
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 0]
        head = len(ids) % 2048 or 2048
        for k, start in enumerate([0, *range(head, len(ids), 2048)]):
            own = ids[:head] if start == 0 else ids[start : start + 2048]
            out.add((i, k, start, len(own), zlib.crc32(tokens.packed(own))))
    return out


def test_pipeline_equals_plain_python(spark):
    frame = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = frame.columns
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").filter(~toxicity.held_out()).select("doc_id", "toxic")
    docs = {r.doc_id: r.text for r in frame.select("doc_id", "text").collect()}
    model = toxicity.train(frame.select("doc_id", "text").join(labels, "doc_id"))
    wants, steps = [], [lambda d: without_toxic(d, model), without_lines, without_copies]
    for step in steps:
        docs = step(docs)
        wants.append(docs)
    current = frame
    for (name, stage), want in zip(corpus_pipeline.STAGES, wants):
        current = corpus_pipeline.stored(stage(spark, current, SMALL), "test-stage")
        assert current.columns == columns
        assert {r.doc_id: r.text for r in current.select("doc_id", "text").collect()} == want, name
    sizes = [frame.count(), *map(len, wants)]
    assert sizes[0] > sizes[1] and sizes[2] > sizes[3] and wants[0] != wants[1]  # each stage does something here
    docs = masked(docs, secrets.train(current))
    assert docs != wants[-1]
    rows = corpus_pipeline.run(spark, SMALL).collect()
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows} == pieces(docs) and len(rows) == len(pieces(docs))
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        places.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(places, places[1:])) and places[0][0] == 0 and sum(n for _, n in places) <= 2048
