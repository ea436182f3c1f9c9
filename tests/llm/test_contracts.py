"""Rows without an id, special strings in texts, and clashing keys, against unaltered libraries and plain Python."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from accordant.llm import bpe, exact_dedup, frames, packing, tokens, toxicity

SHAPE = "doc_id long, text string"

SPECIAL = ["<|endoftext|>", "a<|endoftext|>b", "<|startoftext|> x <|endoftext|><|endoftext|>", "two  spaces  <|endoftext|>  \n\n tail", "É<|endoftext|>ß 12",
           "<|ENDOFTEXT|>", "<|endoftext", "plain text, don't", "日本<|startoftext|>語", " ", "<|endoftext|> " * 40, "it's<|endoftext|>'s"]


def library(name):
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name))


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def random_texts(n, seed):
    rng = random.Random(seed)
    parts = ["<|endoftext|>", "<|startoftext|>", " ", "  ", "\n", "word", "Word", "'s", "12", "é", "—", "x<|", "|>"]
    return ["".join(rng.choices(parts, k=rng.randrange(12))) for _ in range(n)]


def test_encoders_equal_the_unaltered_libraries():
    whole, lower = library("byte_bpe_50k.json"), library("word_bpe_49k.json")
    ranks, words = tokens.byte_level("byte_bpe_50k.tiktoken"), tokens.word_level("word_bpe_49k.json")
    for t in SPECIAL + random_texts(400, 3):
        assert ranks.encode_with(t, packing.ADDED) == ids_of(whole, t), t
        assert words.encode(t) == tokens.packed(ids_of(lower, t)), t


def test_pieces_and_frames_of_special_texts(spark):
    rows = list(enumerate([*SPECIAL, None, ""]))
    df = spark.createDataFrame(rows, SHAPE)
    whole, lower = library("byte_bpe_50k.json"), library("word_bpe_49k.json")
    got = {r.doc_id: (r.length, r.ids_crc32) for r in packing.pieces(df).collect()}
    want = {i: [*ids_of(whole, t), 0] for i, t in rows}
    assert got == {i: (len(ids), zlib.crc32(tokens.packed(ids))) for i, ids in want.items()}
    want = {i: [*ids_of(lower, t), 2] for i, t in rows}
    got = {r.doc_id: np.frombuffer(r.ids, dtype="<u4").tolist() for r in frames.read(frames.write(df)).collect()}
    assert got == want


def test_frames_give_missing_ids_back(spark):
    rows = [(None, "a"), (3, "b"), (None, None), (-5, "c"), (3, "b"), (0, "d")]
    out = frames.read(frames.write(spark.createDataFrame(rows, SHAPE), rows_per_file=2)).collect()
    lower = library("word_bpe_49k.json")
    assert sorted((r.doc_id, bytes(r.ids)) for r in out if r.doc_id is not None) == sorted((i, tokens.packed([*ids_of(lower, t), 2])) for i, t in rows if i is not None)
    assert [r.doc_id for r in sorted(out, key=lambda r: r.start)][:2] == [None, None]
    assert sorted(r.n_tokens for r in out if r.doc_id is None) == [1, 2]
    ends = [r.start + r.n_tokens for r in sorted(out, key=lambda r: r.start)]
    assert [0, *ends[:-1]] == sorted(r.start for r in out)


def test_long_rows_do_not_share_a_key(spark):
    tail = "x " * 60
    rows = [(None, "5|" + tail), (5, tail), (None, "5:" + tail), (1, "5:" + tail), (15, ":" + tail), (None, tail), (-1, tail), (None, "-1:" + tail)]
    multi = tokens.byte_level("byte_bpe_multi_50k.tiktoken").full
    got = bpe.encode(spark.createDataFrame(rows, SHAPE), chunk=40, overlap=12).collect()
    assert sorted((str(r.doc_id), bytes(r.ids)) for r in got) == sorted((str(i), tokens.packed(multi.encode_ordinary(t))) for i, t in rows)


@pytest.mark.parametrize("side", [True, False, "odd"])
def test_exact_groups_of_rows_without_ids(spark, side):
    rows = [(None, "same"), (None, "SAME"), (1, "same"), (None, "two"), (None, "Two"), (None, "alone"), (4, None), (None, ""), (4, "same"), (7, "other"), (None, "same")]
    df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, place int")
    old = F.col("place") % 2 == 1 if side == "odd" else F.lit(side)
    got = exact_dedup.duplicates(df, old, bucket_keys=4).collect()
    want = []
    for i, t in rows:
        same = [j for j, u in rows if (u or "").lower() == (t or "").lower()]
        keep = max((j for j in same if j is not None), default=None)
        want.append((i, keep, len(same), i == keep))
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got), key=str) == sorted(want, key=str)


# --- toxicity ------------------------------------------------------------------------------

def test_counts_come_packed(spark):
    rows = spark.createDataFrame([("a b a", 1), ("b c", 0), ("", 0), ("c", 1)], "text string, toxic int")
    counts = toxicity.token_counts(rows, bits=10)
    dense = toxicity.dense_counts(counts, 10)
    assert {(r.slot, r.clean, r.toxic) for r in counts.collect()} == {(int(s), int(dense[0, s]), int(dense[1, s])) for s in np.flatnonzero(dense.any(axis=0))}
    assert toxicity.dense_counts(counts.limit(0), 10).sum() == 0


def test_own_scores_leave_the_text_out(spark):
    rng = random.Random(1)
    texts = [(" ".join(rng.choice(["bad", "badly", "good", "goods", "w%d" % rng.randrange(9)]) for _ in range(12)), rng.randrange(2)) for _ in range(30)]

    def counted(rows):
        return toxicity.dense_counts(toxicity.token_counts(spark.createDataFrame(rows, "text string, toxic int"), bits=12), 12)

    model = toxicity.Model(12, counted(texts), 0.4)
    for k in (0, 7):
        without = toxicity.Model(12, counted(texts[:k] + texts[k + 1 :]), 0.4)
        assert np.allclose(model.own_scores(*texts[k]), without.token_scores(texts[k][0]))
    assert len(model.own_scores("", 1)) == 0


def test_probabilities_hold_on_new_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", "toxic")
    model = toxicity.train(docs.select("doc_id", "text").join(labels.filter(~toxicity.held_out()), "doc_id"), bits=18)
    new = docs.join(labels.filter(toxicity.held_out()), "doc_id")
    rows = toxicity.score(new, model).join(labels, "doc_id").select("score", "toxic").collect()
    p, y = np.array([[r.score, r.toxic] for r in rows]).T
    p = np.clip(p, 1e-6, 1 - 1e-6)
    loss = -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))
    share = y.mean()
    assert len(rows) > 100 and loss < 0.5 * -(share * np.log(share) + (1 - share) * np.log(1 - share)), loss
    print("held-out log-loss", loss, "accuracy", np.mean((p >= 0.5) == y))
