"""Vote arithmetic over a fixed set of annotator columns.

The seats are unrolled into plain comparisons, so a row is resolved inside generated code
without arrays, maps or a shuffle.  ``tally`` stages the shared sub-results as helper columns;
``Ballot`` names them for the strategies.  A null vote is an abstention: it keeps the
denominator and cannot win.  The order of the seats breaks ties.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import add, or_
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

# Consensus level cuts, annotator weights and the outlier share.
LEVEL_HIGH, LEVEL_MEDIUM = 0.8, 0.6
DEFAULT_WEIGHTS = {
    "deepseek-r1-8b": 1.20,
    "qwen3-8b": 1.25,
    "gemma3-4b": 0.95,
    "mistral-7b": 1.10,
    "llama3.1-8b": 1.30,
}
OUTLIER_SHARE = 0.3

_PREFIX = "__seat_"
# Up to this many seats the comparisons are unrolled; beyond it array functions keep the
# expression small when a later filter is pushed through the projection.
_UNROLLED = 6
_SEATS = 255


def _total(terms: Sequence[Column]) -> Column:
    return reduce(add, terms)


def _max(terms: Sequence[Column]) -> Column:
    return terms[0] if len(terms) == 1 else F.greatest(*terms)


def same(a: Column, b: Column) -> Column:
    """Equality that is false, not null, when a side is missing."""
    return F.coalesce(a == b, F.lit(False))


def _equals(value: Column) -> Callable[[Column], Column]:
    return lambda x: x == value


@dataclass(frozen=True)
class Ballot:
    """The votes of one row and the staged results the strategies work on.

    Later filters are pushed through the projection and carry these expressions with them, so
    each result mentions the shared ``code`` once instead of once per seat.
    """

    names: tuple[str, ...]
    votes: tuple[Column, ...]
    counts: tuple[Column, ...]
    firsts: tuple[Column, ...]
    code: Column
    params: Mapping[str, Any] = field(default_factory=dict)

    @property
    def seats(self) -> int:
        return len(self.votes)

    def pick(self, wins: Sequence[Column]) -> Column:
        """The vote of the first seat whose condition holds."""
        return F.coalesce(*[F.when(w, v) for w, v in zip(wins, self.votes)], F.lit(None))

    def at(self, seat: Column) -> Column:
        """The vote of a seat, counted from 1."""
        return F.element_at(F.array(*self.votes), seat)

    @property
    def top(self) -> Column:
        """The largest number of equal votes."""
        return F.shiftright(self.code, 8)

    @property
    def mode(self) -> Column:
        """The most common vote, the earliest seat on a tie; null when nobody voted."""
        return self.at(F.lit(_SEATS + 1) - self.code.bitwiseAND(_SEATS))

    @property
    def distinct(self) -> Column:
        return _total([f.cast("int") for f in self.firsts])

    @property
    def tied(self) -> Column:
        """Whether the two largest vote groups are equal."""
        sizes = F.sort_array(F.array(*[F.when(f, n) for f, n in zip(self.firsts, self.counts)]), asc=False)
        return F.coalesce(F.get(sizes, F.lit(0)) == F.get(sizes, F.lit(1)), F.lit(False))


def tally(df: DataFrame, columns: Sequence[str], names: Sequence[str] | None = None,
          params: Mapping[str, Any] | None = None) -> tuple[DataFrame, Ballot, list[str]]:
    """Add the helper columns; returns the frame, the ballot and the helper names to drop."""
    votes = [F.col(f"`{c}`") for c in columns]
    if len(votes) > _SEATS:
        raise ValueError(f"{len(votes)} annotators; at most {_SEATS} can vote on one row")
    if len(votes) <= _UNROLLED:
        counts = [_total([same(v, u).cast("int") for u in votes]) for v in votes]
        firsts = [v.isNotNull() & ~reduce(or_, [same(v, u) for u in votes[:i]], F.lit(False))
                  for i, v in enumerate(votes)]
    else:
        seats = F.array(*votes)
        counts = [F.coalesce(F.size(F.filter(seats, _equals(v))), F.lit(0)) for v in votes]
        firsts = [v.isNotNull() & (F.array_position(seats, v) == i + 1) for i, v in enumerate(votes)]
    n = {f"{_PREFIX}n{i}": c for i, c in enumerate(counts)}
    f = {f"{_PREFIX}f{i}": c for i, c in enumerate(firsts)}
    staged = df.withColumns({**n, **f})
    # Count in the high bits, earliness of the seat in the low ones: one maximum gives both.
    ranked = _max([F.shiftleft(F.col(c), 8) + F.lit(_SEATS - i) for i, c in enumerate(n)])
    ballot = Ballot(
        names=tuple(names or columns), votes=tuple(votes), counts=tuple(F.col(c) for c in n),
        firsts=tuple(F.col(c) for c in f), code=F.col(f"{_PREFIX}code"), params=dict(params or {}))
    return staged.withColumn(f"{_PREFIX}code", ranked), ballot, [*n, *f, f"{_PREFIX}code"]


def level(score: Column) -> Column:
    return (F.when(score >= LEVEL_HIGH, "high").when(score >= LEVEL_MEDIUM, "medium")
            .otherwise("low"))


def entropy_bits(ballot: Ballot) -> Column:
    """Shannon entropy of the row's votes, base 2."""
    cast = F.greatest(_total([v.isNotNull().cast("int") for v in ballot.votes]), F.lit(1))
    terms = []
    for first, n in zip(ballot.firsts, ballot.counts):
        p = n / cast
        terms.append(F.when(first, -p * F.log2(p)).otherwise(F.lit(0.0)))
    return F.abs(_total(terms))


def pattern(ballot: Ballot) -> Column:
    """Sizes of the vote groups, largest first: ``3x0``, ``2x1``, ``1x1x1`` for three seats.

    A unanimous row is written with a closing 0, as in ``3x0``.
    """
    sizes = F.array(*[F.when(f, n) for f, n in zip(ballot.firsts, ballot.counts)])
    ordered = F.transform(F.sort_array(F.array_compact(sizes), asc=False),
                          lambda n: n.cast("string"))
    joined = F.array_join(ordered, "x")
    return F.when(F.size(ordered) == 1, F.concat(joined, F.lit("x0"))).otherwise(joined)


def vote_map(ballot: Ballot) -> Column:
    """Label to count, as a map in first-seen order."""
    entries = F.array(*[F.when(f, F.struct(v.alias("key"), n.alias("value")))
                        for f, v, n in zip(ballot.firsts, ballot.votes, ballot.counts)])
    return F.map_from_entries(F.array_compact(entries))


def vote_map_text(ballot: Ballot) -> Column:
    """``label:count`` pairs sorted by label, comparable across engines."""
    entries = F.array(*[F.when(f, F.struct(v.alias("key"), n.alias("value")))
                        for f, v, n in zip(ballot.firsts, ballot.votes, ballot.counts)])
    return F.array_join(
        F.transform(F.array_sort(F.array_compact(entries)),
                    lambda e: F.concat(e["key"].cast("string"), F.lit(":"), e["value"].cast("string"))),
        ",")


# --- resolution strategies -------------------------------------------------------------------

Strategy = Callable[[Ballot], Column]
STRATEGIES: dict[str, Strategy] = {}


def strategy(name: str) -> Callable[[Strategy], Strategy]:
    """Register a resolution strategy; it maps a ballot to the resolved label or null."""

    def keep(fn: Strategy) -> Strategy:
        STRATEGIES[name] = fn
        return fn

    return keep


@strategy("majority_vote")
def majority_vote(ballot: Ballot) -> Column:
    return ballot.mode


@strategy("weighted_vote")
def weighted_vote(ballot: Ballot) -> Column:
    weights = ballot.params.get("weights", DEFAULT_WEIGHTS)
    share = [float(weights.get(name, 1.0)) for name in ballot.names]
    support = [
        _total([F.when(same(v, u), F.lit(w)).otherwise(F.lit(0.0))
                for u, w in zip(ballot.votes, share)])
        for v in ballot.votes
    ]
    row = F.array(*support)
    return ballot.at(F.array_position(row, F.array_max(row)).cast("int"))


@strategy("unanimous_only")
def unanimous_only(ballot: Ballot) -> Column:
    return F.when(ballot.counts[0] == ballot.seats, ballot.votes[0])


@strategy("remove_outliers")
def remove_outliers(ballot: Ballot) -> Column:
    """Keep labels with a large enough share; resolved only when exactly one is left."""
    share = float(ballot.params.get("outlier_threshold", OUTLIER_SHARE))
    kept = [f & (n / F.lit(ballot.seats) >= F.lit(share))
            for f, n in zip(ballot.firsts, ballot.counts)]
    return F.when(_total([k.cast("int") for k in kept]) == 1, ballot.pick(kept))


@strategy("flag_for_review")
def flag_for_review(ballot: Ballot) -> Column:
    return F.lit(None).cast("int")
