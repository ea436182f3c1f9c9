"""Linear probability models with robust errors, correlations and diagnostics.

The data are read twice by one aggregate each: first for the moments behind X'X and X'y,
then, with the coefficients known, for the residual moments.  Only those sums reach the driver.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import combinations, combinations_with_replacement
from operator import add

import math

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from accordant.functions.tails import numeric
from accordant.operators.ranking import average_ranks, exact_quantiles

INTERCEPT = "Intercept"


@dataclass(frozen=True)
class Formula:
    """Right-hand side of a model: continuous columns, categories and their products.

    Categories are coded against their first level; ``interactions`` pairs a continuous
    column with a category.
    """

    continuous: tuple[str, ...] = ()
    categorical: tuple[str, ...] = ()
    interactions: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class Term:
    """One design column: a continuous column (or 1) within one level of a category (or all)."""

    name: str
    column: str | None = None
    category: str | None = None
    level: object = None

    def applies(self, cell: Mapping[str, object]) -> bool:
        return self.category is None or cell[self.category] == self.level

    def expression(self) -> Column:
        value = F.lit(1.0) if self.column is None else F.col(self.column)
        return value if self.category is None else F.when(
            F.col(self.category) == F.lit(self.level), value).otherwise(F.lit(0.0))


def _terms(formula: Formula, cells: Sequence[Mapping[str, object]]) -> list[Term]:
    levels = {c: sorted({cell[c] for cell in cells})[1:] for c in formula.categorical}
    out = [Term(INTERCEPT)]
    out += [Term(f"{c}[T.{v}]", None, c, v) for c in formula.categorical for v in levels[c]]
    out += [Term(x, x) for x in formula.continuous]
    out += [Term(f"{x}:{c}[T.{v}]", x, c, v) for x, c in formula.interactions for v in levels[c]]
    return out


def _products(columns: Sequence[str | None], weight: Column, tag: str) -> list[Column]:
    def value(c: str | None) -> Column:
        return F.lit(1.0) if c is None else F.col(c)

    return [F.sum(weight * value(columns[i]) * value(columns[j])).alias(f"{tag}{i}_{j}")
            for i, j in combinations_with_replacement(range(len(columns)), 2)]


def _gram(terms: Sequence[Term], columns: Sequence[str | None], cells: Sequence[Mapping[str, object]],
          tag: str) -> np.ndarray:
    """k x k sums of design products, put together from the moments of each category cell."""
    at = {c: i for i, c in enumerate(columns)}
    out = np.zeros((len(terms), len(terms)))
    for cell in cells:
        live = [i for i, t in enumerate(terms) if t.applies(cell)]
        for i in live:
            for j in live:
                lo, hi = sorted((at[terms[i].column], at[terms[j].column]))
                out[i, j] += cell[f"{tag}{lo}_{hi}"]
    return out


@dataclass(frozen=True)
class LinearFit:
    """A fitted linear model with HC1 covariance."""

    formula: Formula
    terms: list[Term]
    coef: np.ndarray
    cov: np.ndarray
    n: int
    sse: float
    sst: float
    frame: DataFrame
    fitted: Column

    @property
    def k(self) -> int:
        return len(self.terms)

    @property
    def r2(self) -> float:
        return 1.0 - self.sse / self.sst if self.sst > 0 else float("nan")

    def residuals(self, out: str = "residual") -> DataFrame:
        """The model rows with the residual, including the columns kept at fitting."""
        return self.frame.withColumn(out, F.col("y") - self.fitted)

    def coefficient_rows(self, confidence: float = 0.95) -> list[tuple]:
        dist = numeric()
        z = dist.normal_critical(confidence)
        rows = []
        for term, b, v in zip(self.terms, self.coef, np.diag(self.cov)):
            se = math.sqrt(max(float(v), 0.0))
            stat = float(b) / se if se > 0 else None
            rows.append((term.name, float(b), se, stat, dist.normal_two_sided(stat) if stat is not None else None,
                         float(b) - z * se, float(b) + z * se))
        return rows

    def comparison_row(self, name: str) -> tuple:
        n, k = self.n, self.k
        loglik = -n / 2.0 * (math.log(2 * math.pi) + math.log(self.sse / n) + 1.0)
        return (name, self.r2, 1.0 - (1.0 - self.r2) * (n - 1) / (n - k), -2 * loglik + 2 * k,
                -2 * loglik + k * math.log(n), n)


def fit_models(df: DataFrame, response: Column, formulas: Mapping[str, Formula],
               keep: Sequence[str] = (), max_cells: int = 100_000) -> dict[str, LinearFit]:
    """Fit several linear models by least squares with HC1 errors in two scans.

    Rows are reduced to moments of the continuous columns per combination of categories, so
    the work does not grow with the number of levels and no dummy column is ever built.  The
    category combinations come to the driver as one row each (refused beyond ``max_cells``).
    """
    continuous = list(dict.fromkeys(c for f in formulas.values() for c in f.continuous))
    categories = list(dict.fromkeys(c for f in formulas.values() for c in f.categorical))
    frame = df.select(*keep, response.cast("double").alias("y"), *[F.col(c).cast("double").alias(c) for c in continuous],
                      *categories).dropna(subset=["y", *continuous, *categories])
    y, columns = F.col("y"), [None, *continuous]
    cells = frame.groupBy(*categories).agg(
        F.count(F.lit(1)).alias("n"), *_products(columns, F.lit(1.0), "a"),
        *[F.sum(y if c is None else y * F.col(c)).alias(f"b{i}") for i, c in enumerate(columns)]).take(max_cells + 1)
    if len(cells) > max_cells:
        raise ValueError(f"more than {max_cells} combinations of {categories}")
    n = sum(cell["n"] for cell in cells)
    mean = sum(cell["b0"] for cell in cells) / n
    designs, second = {}, [F.sum((y - F.lit(mean)) * (y - F.lit(mean))).alias("sst")]
    for m, (name, formula) in enumerate(formulas.items()):
        terms = _terms(formula, cells)
        if n <= len(terms):
            raise ValueError(f"{n} rows for {len(terms)} coefficients in {name}")
        inverse = np.linalg.pinv(_gram(terms, columns, cells, "a"))
        rhs = np.array([sum(cell[f"b{columns.index(t.column)}"] for cell in cells if t.applies(cell)) for t in terms])
        coef = inverse @ rhs
        fitted = reduce(add, [F.lit(float(c)) * t.expression() for c, t in zip(coef, terms)])
        own = [None, *formula.continuous]
        designs[name] = (m, formula, terms, inverse, coef, fitted, own)
        e2 = F.col(f"__e{m}") * F.col(f"__e{m}")
        second += [F.sum(e2).alias(f"sse{m}"), *_products(own, e2, f"m{m}_")]
    with_errors = frame.withColumns({f"__e{d[0]}": y - d[5] for d in designs.values()})
    moments = with_errors.groupBy(*categories).agg(*second).collect()  # one row per cell, as above
    sst = sum(cell["sst"] for cell in moments)
    fits = {}
    for name, (m, formula, terms, inverse, coef, fitted, own) in designs.items():
        meat = _gram(terms, own, moments, f"m{m}_")
        fits[name] = LinearFit(formula, terms, coef, inverse @ meat @ inverse * (n / (n - len(terms))), n,
                               sum(cell[f"sse{m}"] for cell in moments), sst, frame, fitted)
    return fits


def ols_hc1(df: DataFrame, response: Column, formula: Formula, keep: Sequence[str] = ()) -> LinearFit:
    """One least-squares fit with the HC1 sandwich covariance."""
    return fit_models(df, response, {"model": formula}, keep)["model"]


def coefficient_table(fits: Mapping[str, LinearFit], confidence: float = 0.95) -> DataFrame:
    """Coefficients with robust errors, z, p and interval (normal reference) of every model."""
    spark = next(iter(fits.values())).frame.sparkSession
    rows = [(name, *row) for name, fit in fits.items() for row in fit.coefficient_rows(confidence)]
    return spark.createDataFrame(rows, "model string, term string, coef double, std_err double, z double, "
                                       "p_value double, ci_low double, ci_high double")


def comparison_table(fits: Mapping[str, LinearFit]) -> DataFrame:
    """R2, adjusted R2, AIC and BIC (Gaussian likelihood) of every model."""
    spark = next(iter(fits.values())).frame.sparkSession
    return spark.createDataFrame([fit.comparison_row(name) for name, fit in fits.items()],
                                 "model string, r2 double, r2_adj double, aic double, bic double, n bigint")


def breusch_pagan(fit: LinearFit) -> DataFrame:
    """LM and F tests from the regression of squared residuals on the same design."""
    squared = fit.residuals("__r").withColumn("__r2", F.col("__r") * F.col("__r")).drop("y")
    aux = ols_hc1(squared, F.col("__r2"), fit.formula)
    dist, p = numeric(), fit.k - 1
    lm = aux.n * aux.r2
    f = (aux.r2 / p) / ((1.0 - aux.r2) / (aux.n - fit.k))
    return fit.frame.sparkSession.createDataFrame(
        [(lm, dist.chi2_sf(lm, p), f, dist.f_sf(f, p, aux.n - fit.k))],
        "lm double, lm_p_value double, f double, f_p_value double")


def normal_equations(df: DataFrame, response: Column, terms: Mapping[str, Column]) -> DataFrame:
    """X'X and X'y of a few explicit design columns in long form; the response is ``y``."""
    names = [INTERCEPT, *terms, "y"]
    cols = [F.lit(1.0), *[c.cast("double") for c in terms.values()], response.cast("double")]
    design = df.select(*[c.alias(f"x{i}") for i, c in enumerate(cols)]).dropna()
    columns = [f"x{i}" for i in range(len(cols))]
    one = design.agg(*_products(columns, F.lit(1.0), "s"))
    rows = F.array(*[F.struct(F.lit(names[i]).alias("term_1"), F.lit(names[j]).alias("term_2"),
                              F.col(f"s{i}_{j}").alias("value"))
                     for i, j in combinations_with_replacement(range(len(cols)), 2)])
    return one.select(F.explode(rows).alias("e")).select("e.*")


def pearson(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every column pair, from one aggregate."""
    pairs = list(combinations(columns, 2))
    one = df.agg(*[F.corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("column_1"), F.lit(b).alias("column_2"),
                              F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)])
    return one.select(F.explode(rows).alias("e")).select("e.*")


def spearman(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rank correlation of every column pair over rows with all values, with average ranks.

    Values are ranked once per column as (value, rank) tables; rows are first folded to
    distinct value combinations, so a hot value carries weight instead of rows.
    """
    rows = df.dropna(subset=list(columns)).groupBy(*[F.col(c).cast("double").alias(c) for c in columns]).agg(
        F.count(F.lit(1)).alias("__w"))
    ranked = rows
    for c in columns:
        table = average_ranks(df.dropna(subset=list(columns)), c).select(F.col("value").alias(c), F.col("rank").alias(f"__r_{c}"))
        ranked = ranked.join(table, c)
    w = F.col("__w").cast("double")
    sums = [F.sum(w).alias("n")]
    for c in columns:
        r = F.col(f"__r_{c}")
        sums += [F.sum(w * r).alias(f"s_{c}"), F.sum(w * r * r).alias(f"q_{c}")]
    pairs = list(combinations(columns, 2))
    sums += [F.sum(w * F.col(f"__r_{a}") * F.col(f"__r_{b}")).alias(f"p{i}") for i, (a, b) in enumerate(pairs)]
    one = ranked.agg(*sums)
    n = F.col("n")

    def var(c: str) -> Column:
        return F.col(f"q_{c}") - F.col(f"s_{c}") * F.col(f"s_{c}") / n

    entries = F.array(*[
        F.struct(F.lit(a).alias("column_1"), F.lit(b).alias("column_2"),
                 F.try_divide(F.col(f"p{i}") - F.col(f"s_{a}") * F.col(f"s_{b}") / n,
                              F.sqrt(var(a) * var(b))).alias("rho"))
        for i, (a, b) in enumerate(pairs)])
    return one.select(F.explode(entries).alias("e")).select("e.*")


def vif(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Variance inflation factors: the diagonal of the inverse correlation matrix.

    A column that is a combination of the others gets a very large or infinite factor.
    """
    found = pearson(df, columns).collect()  # one row per column pair
    r = np.eye(len(columns))
    at = {c: i for i, c in enumerate(columns)}
    for row in found:
        i, j = at[row["column_1"]], at[row["column_2"]]
        r[i, j] = r[j, i] = row["r"]
    values = []
    for i in range(len(columns)):
        rest = [j for j in range(len(columns)) if j != i]
        r2 = float(r[i, rest] @ np.linalg.pinv(r[np.ix_(rest, rest)]) @ r[rest, i])
        values.append(1.0 / (1.0 - r2) if r2 < 1.0 else float("inf"))
    return df.sparkSession.createDataFrame(list(zip(columns, values)), "feature string, vif double")


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, deviation, extremes and exact quartiles of each column, one row per column."""
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])).alias("e")).select("e.*")
    base = long.groupBy("column").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"))
    q = exact_quantiles(long, "value", [0.25, 0.5, 0.75], ["column"])
    wide = q.groupBy("column").agg(*[
        F.max(F.when(F.col("fraction") == f, F.col("quantile"))).alias(n)
        for f, n in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75"))])
    return base.join(wide, "column")


def regression_base(df: DataFrame, confidences: Sequence[str], seats: int = 3) -> DataFrame:
    """One row per resolved text with its agreement type, correctness and confidence summary.

    ``df`` carries the consensus columns; rows without a majority, a truth or any of the
    confidences drop out.
    """
    from accordant.functions import confidence as K
    from accordant.operators.consensus import consensus_universe

    rows = consensus_universe(df).dropna(subset=list(confidences))
    unanimous = F.col("most_common_count") == seats
    return rows.withColumns({
        "consensus_type": F.when(unanimous, f"{seats}x0").otherwise(F.concat(
            F.col("most_common_count").cast("string"), F.lit("x"),
            (F.lit(seats) - F.col("most_common_count")).cast("string"))),
        "consensus_code": unanimous.cast("int"),
        "correct": (F.col("resolved_annotation") == F.col("ground_truth")).cast("int"),
        "mean_confidence": K.mean_confidence(confidences),
        "std_confidence": K.std_confidence(confidences),
    })
