"""Reading a label and its confidence out of an annotator's raw response."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from accordant.functions.text import strip

# The answer marker, the reasoning tags and the sentinel of an invalid answer.
MARKER = "CLASSIFICATION:"
THINK_OPEN, THINK_CLOSE = "<think>", "</think>"
INVALID = -1


def answer_number(content: Column) -> Column:
    """The integer an answer states, or null.

    Text after the last marker counts.  A bare integer literal is taken whole, including a
    sign and digit-group underscores; otherwise the first run of digits is used.
    """
    # Part after the last marker; the whole answer when there is none.
    tail = strip(F.element_at(F.split(content, MARKER), -1))
    grouped = tail.rlike(r"^[+-]?\d+(_\d+)+$")
    digits = F.when(grouped, F.regexp_replace(tail, "_", "")).otherwise(
        F.regexp_extract(tail, r"-?\d+", 0))
    return F.when(digits != "", digits).try_cast("int")


def extract_label(content: Column, categories: Sequence[int]) -> Column:
    """The stated category, or -1 for an empty, unreadable or unknown answer."""
    number = answer_number(content)
    return F.when(number.isin(*categories), number).otherwise(F.lit(INVALID))


def is_valid(content: Column, categories: Sequence[int]) -> Column:
    return extract_label(content, categories).isin(*categories)


def label_confidence(label: Column, logprobs: Column) -> Column:
    """``exp(logprob)`` of the first token outside the reasoning tags that equals the label.

    ``logprobs`` is an array of (token, logprob); null when no token matches.
    """
    want = label.cast("string")
    start = F.struct(F.lit(False).alias("inside"), F.lit(None).cast("double").alias("found"))

    def step(state: Column, item: Column) -> Column:
        token = strip(item["token"])
        tag = token.isin(THINK_OPEN, THINK_CLOSE)
        inside = F.when(token == THINK_OPEN, True).when(token == THINK_CLOSE, False).otherwise(state["inside"])
        hit = ~tag & ~state["inside"] & (token == want) & state["found"].isNull()
        found = F.when(F.coalesce(hit, F.lit(False)), item["logprob"]).otherwise(state["found"])
        return F.struct(F.coalesce(inside, state["inside"]).alias("inside"), found.alias("found"))

    return F.exp(F.aggregate(logprobs, start, step, lambda s: s["found"]))
