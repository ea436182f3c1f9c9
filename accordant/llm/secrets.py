"""Secret scans: fixed patterns, plus character Markov models for what no pattern names.

Two first-order character models, one of random strings and one of ordinary identifiers, score
every long run of key-like characters; a run whose log-likelihood ratio per character says
"random" is a secret.  Random samples are the values that the fixed patterns found, with drawn
strings over the usual alphabets; ordinary samples are the words and compounds of the same texts.
"""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
from pyspark.sql import DataFrame, functions as F

from accordant.llm.common import arrow_map, arrow_replace, fit_sample, whole_text

KINDS = ("assign", "access", "hex", "markov")
#: The base patterns.  Letters of the first match in either case, ASCII only.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")

#: Runs that the models judge: as long as the shortest value of the base patterns.
RUN = re.compile(r"[A-Za-z0-9+/_=-]{12,}")
_WORD = re.compile(r"[A-Za-z0-9+/_=-]{4,}")
ALPHABETS = ("0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
             "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")
SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_AT = {c: i + 1 for i, c in enumerate(SYMBOLS)}
#: Byte to symbol, 0 for the start.
_TABLE = np.zeros(256, dtype=np.int64)
for _c, _i in _AT.items():
    _TABLE[ord(_c)] = _i


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns in code points, by start, then kind as listed."""
    found = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return [(a, b, KINDS[k]) for a, b, k in sorted(found, key=lambda s: (s[0], s[2]))]


def written(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def _codes(run: str) -> np.ndarray:
    return _TABLE[np.frombuffer(run.encode("ascii"), dtype=np.uint8)]


def transitions(runs: list[str]) -> np.ndarray:
    """How often each symbol follows each other one; row 0 is the start."""
    n = len(SYMBOLS) + 1
    if not runs:
        return np.zeros((n, n))
    codes = np.concatenate([np.concatenate([[0], _codes(r)]) for r in runs])
    pair = codes[:-1] * n + codes[1:]
    return np.bincount(pair[codes[1:] > 0], minlength=n * n).reshape(n, n).astype(float)


def ratio_table(secret: np.ndarray, plain: np.ndarray, smoothing: float = 0.5) -> np.ndarray:
    """Log of (random / ordinary) per transition from their counts, each model smoothed towards its own symbol rates."""

    def model(count: np.ndarray) -> np.ndarray:
        rate = (count.sum(axis=0) + smoothing) / (count.sum() + smoothing * count.shape[1])
        weight = smoothing * count.shape[1]
        return np.log((count + weight * rate) / (count.sum(axis=1, keepdims=True) + weight))

    return model(secret) - model(plain)


def samples_of(text: str) -> tuple[list[str], list[str]]:
    """(random, ordinary) runs of one text: base matches against all other words."""
    secret, plain, end = [], [], 0
    for a, b, _ in base_spans(text):
        if a < end:
            continue
        plain += _WORD.findall(text, end, a)
        secret += RUN.findall(text, a, b)
        end = b
    return secret, plain + _WORD.findall(text, end)


def drawn_runs(count: int, seed: int = 7) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choices(ALPHABETS[i % len(ALPHABETS)], k=rng.randint(20, 48))) for i in range(count)]


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_rows: int = 2_000, drawn: int = 2_000) -> np.ndarray:
    """Fit both models on a bounded sample: about ``max_rows`` rows by the hash of id and text, their texts whole.

    The labels of the sample are the base patterns: their values are random strings, all other words ordinary ones.
    To the random ones come ``drawn`` strings over the usual alphabets of keys, as few samples hold every alphabet.
    Transitions are counted in the tasks; the driver gets their sums.  Without rows the drawn strings stand alone.
    """
    sample = fit_sample(docs.select(id_col, whole_text(text_col).alias("t")), id_col, max_rows, "t")
    size = len(SYMBOLS) + 1

    def counted(columns: dict[str, list]) -> dict[str, list]:
        both = np.zeros((2, size, size))
        for text in columns["t"]:
            for k, runs in enumerate(samples_of(text)):
                both[k] += transitions(runs)
        at = np.flatnonzero(both)
        return {"place": at.tolist(), "n": both.ravel()[at].astype(int).tolist()}

    sums = np.zeros(2 * size * size)
    for row in arrow_map(sample.select("t"), counted, "place bigint, n bigint").groupBy("place").agg(F.sum("n").alias("n")).collect():
        sums[row.place] = row.n
    secret, plain = sums.reshape(2, size, size)
    return ratio_table(secret + transitions(drawn_runs(drawn)), plain)


def markov_spans(text: str, table: np.ndarray, taken: list[tuple[int, int, str]], per_char: float = 0.75, least: float = 20.0) -> list[tuple[int, int, str]]:
    """Runs more like random strings than identifiers, unless base spans cover them.

    A run that only begins or ends in a base span is given whole, or the rest of the key would stay.  Numbers are
    neither identifiers nor keys and are left to the base patterns.
    """
    out = []
    for m in RUN.finditer(text):
        if m.group().isdigit():
            continue
        codes = _codes(m.group())
        llr = table[np.concatenate([[0], codes[:-1]]), codes].sum()
        if llr >= least and llr >= per_char * len(codes) and not covered(m.start(), m.end(), taken):
            out.append((m.start(), m.end(), "markov"))
    return out


def covered(start: int, end: int, spans: list[tuple[int, int, str]]) -> bool:
    """Whether spans, in order of their starts, leave nothing of start to end."""
    for a, b, _ in spans:
        if a > start:
            break
        start = max(start, b)
    return start >= end


def all_spans(text: str, table: np.ndarray) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base spans, base and Markov spans)."""
    base = base_spans(text)
    more = markov_spans(text, table, base)
    order = {k: i for i, k in enumerate(KINDS)}
    return base, sorted(base + more, key=lambda s: (s[0], order[s[2]]))


def redact(text: str, spans: list[tuple[int, int, str]], mark: str = "[SECRET]") -> str:
    """The text with every span, overlapping ones merged, replaced by ``mark``."""
    parts, end = [], 0
    for a, b, _ in sorted(spans):
        if a >= end:
            parts += [text[end:a], mark]
        end = max(end, b)
    return "".join([*parts, text[end:]])


SCAN = "n_assign bigint, n_access bigint, n_hex bigint, n_markov bigint, base_sha256 string, spans string, redacted string"


def scan(docs: DataFrame, table: np.ndarray, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: counts by kind, the digest of the base spans, all spans, and the text
    with them masked (``redacted``).  Null texts are read as empty; rows without an id and repeated rows are each
    scanned; other columns are ignored."""
    kind = docs.schema[id_col].dataType.simpleString()

    def one(columns: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in ("id", *(f.split()[0] for f in SCAN.split(", ")))}
        for i, text in zip(columns["id"], columns["text"]):
            base, spans = all_spans(text, table)
            kinds = [k for _, _, k in spans]
            values = [i, *(kinds.count(k) for k in KINDS), hashlib.sha256(written(base).encode()).hexdigest(), written(spans), redact(text, spans) if spans else text]
            for name, value in zip(out, values):
                out[name].append(value)
        return out

    rows = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"))
    return arrow_map(rows, one, f"id {kind}, {SCAN}").withColumnRenamed("id", id_col)


def mask(docs: DataFrame, table: np.ndarray, *, text_col: str = "text") -> DataFrame:
    """All rows and columns, secrets in ``text_col`` masked; null texts stay null."""

    def one(texts: list) -> list:
        return [t if not t or not (spans := all_spans(t, table)[1]) else redact(t, spans) for t in texts]

    return arrow_replace(docs, text_col, one)
