"""Designed experiments: 2^k factorial effects, one-way ANOVA, variance tests.

Inputs are cell tables (one row per replicate), themselves the result of a grouped scan.
Every sum is a distributed aggregate; only tail areas run in Python, on result rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window, functions as F

from accordant.functions import tails
from accordant.functions.coding import products
from accordant.operators.joins import measured, null_safe_join
from accordant.sources.workspace import stored


def treatment_means(df: DataFrame, response: str, by: Sequence[str] = ("treatment",)) -> DataFrame:
    y = F.col(response)
    return df.groupBy(*by).agg(F.avg(y).alias("mean"), F.stddev_samp(y).alias("std"),
                               F.var_samp(y).alias("var"), F.count(y).alias("n"))


def factor_means(df: DataFrame, response: str, factors: Sequence[str]) -> DataFrame:
    """Main-effect and two-factor means: the data behind effect and interaction charts."""
    sets = [(f,) for f in factors] + list(combinations(factors, 2))
    picks = F.array(*[
        F.struct(F.lit("".join(s)).alias("effect"), F.col(s[0]).alias("level_1"),
                 (F.col(s[1]) if len(s) > 1 else F.lit(None).cast("int")).alias("level_2"))
        for s in sets])
    return (df.select(F.col(response).alias("y"), F.explode(picks).alias("s")).select("y", "s.*")
            .groupBy("effect", "level_1", "level_2").agg(F.avg("y").alias("mean"), F.count("y").alias("n")))


def factorial_effects(df: DataFrame, response: str, factors: Sequence[str], *,
                      replicates: int | None = None, confidence: float = 0.95,
                      inference: bool = True) -> DataFrame:
    """Effects of a replicated 2^k design with coded factors.

    One aggregate gives every contrast.  Rows: one per effect with q, the effect 2q, sum of
    squares and share of variation; with ``inference`` also t, p and the interval of q.
    """
    if replicates is not None:
        expected = (2 ** len(factors)) * replicates
        found = df.count()
        if found != expected:
            raise ValueError(f"expected {expected} observations, found {found}")
    y = F.col(response)
    terms = products(list(factors))
    sums = df.agg(F.count(y).alias("N"), F.sum(y).alias("sy"), F.sum(y * y).alias("syy"),
                  *[F.sum(c * y).alias(f"c_{n}") for n, c in terms.items()])
    n = F.col("N").cast("double")
    sst = F.col("syy") - F.col("sy") * F.col("sy") / n
    ss = {t: F.col(f"c_{t}") * F.col(f"c_{t}") / n for t in terms}
    sse = sst - sum(list(ss.values())[1:], list(ss.values())[0])
    df_err = F.col("N") - F.lit(2 ** len(factors))
    rows = F.array(*[F.struct(F.lit(t).alias("effect"), (F.col(f"c_{t}") / n).alias("q"), ss[t].alias("ss"))
                     for t in terms])
    out = (sums.select("N", sst.alias("sst"), sse.alias("sse"), df_err.alias("df_error"), F.explode(rows).alias("e"))
           .select("e.effect", "e.q", (F.lit(2.0) * F.col("e.q")).alias("effect_2q"), "e.ss",
                   (F.lit(100.0) * F.try_divide(F.col("e.ss"), F.col("sst"))).alias("pct_variation"),
                   "sst", "sse", "df_error", F.col("N").alias("n")))
    if not inference:
        return out
    s_q = F.sqrt(F.try_divide(F.try_divide(F.col("sse"), F.col("df_error")), F.col("n")))
    half = tails.t_critical(F.col("df_error"), confidence) * F.col("s_q")
    return (out.withColumn("s_q", s_q)
            .withColumn("t", F.try_divide(F.col("q"), F.col("s_q")))
            .withColumns({"p_value": tails.t_two_sided(F.col("t"), F.col("df_error")), "half": half})
            .withColumns({"ci_low": F.col("q") - F.col("half"), "ci_high": F.col("q") + F.col("half")})
            .withColumn("significant", F.col("ci_low") * F.col("ci_high") > 0).drop("half"))


def effect_contrast(effects: DataFrame, name: str, weights: Mapping[str, float],
                    confidence: float = 0.95, inference: bool = True) -> DataFrame:
    """A contrast of effects, u = sum(h q), whose coefficients add up to zero."""
    if abs(sum(weights.values())) > 1e-9:
        raise ValueError("contrast coefficients must sum to zero")
    h = F.lit(0.0)
    for effect, weight in weights.items():
        h = F.when(F.col("effect") == effect, F.lit(float(weight))).otherwise(h)
    one = effects.withColumn("h", h).agg(
        F.sum(F.col("h") * F.col("q")).alias("u"), F.sum(F.col("h") * F.col("h")).alias("hh"),
        F.max("sse").alias("sse"), F.max("df_error").alias("df_error"), F.max("n").alias("n"))
    s_u = F.sqrt(F.try_divide(F.col("sse"), F.col("df_error")) * F.col("hh") / F.col("n"))
    out = one.select(F.lit(name).alias("contrast"), "u", s_u.alias("s_u"), "df_error")
    if not inference:
        return out
    half = tails.t_critical(F.col("df_error"), confidence) * F.col("s_u")
    return (out.withColumn("half", half)
            .withColumns({"ci_low": F.col("u") - F.col("half"), "ci_high": F.col("u") + F.col("half")})
            .withColumn("excludes_zero", F.col("ci_low") * F.col("ci_high") > 0).drop("half"))


def _level_sums(df: DataFrame, response: str, factor: str) -> DataFrame:
    """One row per level, kept because the table and the levels are both derived from it."""
    y = F.col(response)
    return measured(df.filter(y.isNotNull()).groupBy(F.col(factor).alias("level")).agg(
        F.count(y).alias("r"), F.avg(y).alias("mean"), F.sum(y).alias("sy"), F.sum(y * y).alias("syy")))


def anova_table(df: DataFrame, response: str, factor: str, *, confidence: float = 0.95,
                inference: bool = True) -> DataFrame:
    """One-way ANOVA with unequal replicates, as one row of sums of squares and F."""
    return _anova(_level_sums(df, response, factor), confidence, inference)


def _anova(levels: DataFrame, confidence: float = 0.95, inference: bool = False) -> DataFrame:
    n, a = F.sum("r"), F.count(F.lit(1))
    one = levels.agg(n.alias("n"), a.alias("levels"), F.sum("sy").alias("sy"), F.sum("syy").alias("ssy"),
                     F.sum(F.col("sy") * F.col("sy") / F.col("r")).alias("between"))
    base = (one.withColumn("mu", F.col("sy") / F.col("n"))
            .withColumn("ss0", F.col("sy") * F.col("sy") / F.col("n"))
            .withColumns({"sst": F.col("ssy") - F.col("ss0"), "ssa": F.col("between") - F.col("ss0"),
                          "sse": F.col("ssy") - F.col("between"),
                          "df_a": F.col("levels") - 1, "df_e": F.col("n") - F.col("levels")})
            .withColumns({"msa": F.try_divide(F.col("ssa"), F.col("df_a")),
                          "mse": F.try_divide(F.col("sse"), F.col("df_e")),
                          "pct_factor": F.lit(100.0) * F.try_divide(F.col("ssa"), F.col("sst"))})
            .withColumn("f", F.when(F.col("mse") > 0, F.col("msa") / F.col("mse"))))
    out = base.select("n", "levels", "mu", "ssy", "ss0", "sst", "ssa", "sse", "df_a", "df_e", "msa", "mse",
                      "f", "pct_factor")
    if not inference:
        return out
    return out.withColumns({
        "f_critical": tails.f_critical(F.col("df_a"), F.col("df_e"), confidence),
        "p_value": tails.f_sf(F.col("f"), F.col("df_a"), F.col("df_e"))})


def anova_levels(df: DataFrame, response: str, factor: str, *, confidence: float = 0.95,
                 inference: bool = True) -> DataFrame:
    """Level means and effects; with ``inference`` also the intervals of both."""
    levels = _level_sums(df, response, factor)
    table = _anova(levels)
    joined = levels.select("level", "r", "mean").withColumns(
        {c: table.select(c).scalar() for c in ("mu", "mse", "df_e", "n")})
    out = joined.withColumn("effect", F.col("mean") - F.col("mu"))
    if not inference:
        return out.select("level", "r", "mean", "effect")
    t = tails.t_critical(F.col("df_e"), confidence)
    r, n = F.col("r"), F.col("n")
    return (out.withColumn("t", t)
            .withColumns({"he": F.col("t") * F.sqrt(F.col("mse") * (n - r) / (n * r)),
                          "hm": F.col("t") * F.sqrt(F.col("mse") / r)})
            .select("level", "r", "mean", "effect",
                    (F.col("effect") - F.col("he")).alias("effect_low"),
                    (F.col("effect") + F.col("he")).alias("effect_high"),
                    (F.col("mean") - F.col("hm")).alias("mean_low"),
                    (F.col("mean") + F.col("hm")).alias("mean_high")))


def level_differences(df: DataFrame, response: str, factor: str, *, confidence: float = 0.95,
                      inference: bool = True, tile: int = 256) -> DataFrame:
    """Differences of level means for every pair of levels.

    Levels are dealt into blocks of about ``tile`` by hash, and every two blocks meet in a tile of their own: a level
    goes to as many tiles as there are blocks, and a task makes the pairs of some tiles only.
    """
    sums = _level_sums(df, response, factor)
    blocks = max(1, -(-sums.count() // tile))
    block = F.pmod(F.xxhash64("level"), F.lit(blocks)).cast("int")
    others = F.sequence(F.lit(0), F.lit(blocks - 1))
    dealt = sums.filter(F.col("level").isNotNull()).select("level", "r", "mean", block.alias("own")).withColumn("other", F.explode(others))
    tiles = dealt.select(F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "level", "r", "mean")
    a = tiles.select("i", "j", F.struct("level", "r", "mean").alias("a"))
    b = tiles.select("i", "j", F.struct("level", "r", "mean").alias("b"))
    # Both levels of a pair in one block meet in the tile of that block with itself; other tiles pair across.
    met = a.join(b, ["i", "j"]).filter((F.col("a.level") < F.col("b.level")) & ((F.col("i") == F.col("j")) | (_block("a", blocks) != _block("b", blocks))))
    mse, dfe = (_anova(sums).select(c).scalar() for c in ("mse", "df_e"))
    pairs = met.select(
        F.col("a.level").alias("level_1"), F.col("b.level").alias("level_2"),
        (F.col("a.mean") - F.col("b.mean")).alias("difference"),
        (F.sqrt(mse) * F.sqrt(1.0 / F.col("a.r") + 1.0 / F.col("b.r"))).alias("std_error"), dfe.alias("df_e"))
    if not inference:
        return pairs
    half = tails.t_critical(F.col("df_e"), confidence) * F.col("std_error")
    return (pairs.withColumn("half", half)
            .withColumns({"ci_low": F.col("difference") - F.col("half"),
                          "ci_high": F.col("difference") + F.col("half")})
            .withColumn("differs", (F.col("ci_low") > 0) | (F.col("ci_high") < 0)).drop("half"))


def _block(side: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(f"{side}.level"), F.lit(blocks))


def residuals(df: DataFrame, response: str, group: str, out: str = "residual") -> DataFrame:
    """Response minus its group mean, by a join on the group table so no group is gathered."""
    means = measured(df.groupBy(group).agg(F.avg(response).alias("__mean")))
    return null_safe_join(df, means, [group]).withColumn(
        out, F.col(response) - F.col("__mean")).drop("__mean")


def durbin_watson(df: DataFrame, residual: str, order: str, range_rows: int = 100_000) -> DataFrame:
    """Sum of squared steps over sum of squares of residuals in order; the order may have any type.

    The table is dealt into ranges of the order, about ``range_rows`` rows each by sampled bounds,
    and stored so: steps inside a range come from a window over that range, steps across ranges
    from the ends of neighbouring ranges.  Rows of one order value go by their residual.
    """
    rows = df.select(F.col(order).alias("__o"), F.col(residual).alias("__e"))
    ranges = max(1, -(-rows.count() // range_rows))
    cut = stored(rows.repartitionByRange(ranges, "__o", "__e").withColumn("__b", F.spark_partition_id()), "ordered-residuals")
    within = Window.partitionBy("__b").orderBy("__o", "__e")
    step = F.col("__e") - F.lag("__e").over(within)
    parts = (cut.withColumn("__d", step).groupBy("__b").agg(
        F.sum(F.col("__d") * F.col("__d")).alias("dd"), F.sum(F.col("__e") * F.col("__e")).alias("ee"),
        F.min_by("__e", F.struct("__o", "__e")).alias("first"), F.max_by("__e", F.struct("__o", "__e")).alias("last")))
    ends = parts.withColumn("gap", F.col("first") - F.lag("last").over(Window.orderBy("__b")))
    return ends.agg(F.try_divide(
        F.coalesce(F.sum("dd"), F.lit(0.0)) + F.coalesce(F.sum(F.col("gap") * F.col("gap")), F.lit(0.0)),
        F.sum("ee")).alias("durbin_watson"))


def levene(df: DataFrame, response: str, group: str, *, inference: bool = True) -> DataFrame:
    """Levene's test around the group median: an ANOVA of absolute deviations."""
    centres = measured(df.groupBy(group).agg(F.median(response).alias("__median")))
    spread = null_safe_join(df, centres, [group]).withColumn(
        "__dev", F.abs(F.col(response) - F.col("__median")))
    table = anova_table(spread, "__dev", group, inference=False)
    out = table.select(F.col("f").alias("statistic"), F.col("df_a").alias("df_1"), F.col("df_e").alias("df_2"))
    return out.withColumn("p_value", tails.f_sf(F.col("statistic"), F.col("df_1"), F.col("df_2"))) \
        if inference else out


def bartlett(df: DataFrame, response: str, group: str, *, inference: bool = True) -> DataFrame:
    """Bartlett's test of equal variances from group counts and variances."""
    y = F.col(response)
    groups = df.groupBy(group).agg(F.count(y).cast("double").alias("n"), F.var_samp(y).alias("v"))
    one = groups.agg(
        F.count(F.lit(1)).cast("double").alias("k"), F.sum("n").alias("n"),
        F.sum((F.col("n") - 1) * F.col("v")).alias("pooled"),
        F.sum((F.col("n") - 1) * F.ln("v")).alias("logs"), F.sum(1.0 / (F.col("n") - 1)).alias("inv"))
    n, k = F.col("n"), F.col("k")
    top = (n - k) * F.ln(F.col("pooled") / (n - k)) - F.col("logs")
    scale = F.lit(1.0) + (F.col("inv") - F.lit(1.0) / (n - k)) / (F.lit(3.0) * (k - 1))
    out = one.select((top / scale).alias("statistic"), (k - 1).cast("bigint").alias("df"))
    return out.withColumn("p_value", tails.chi2_sf(F.col("statistic"), F.col("df"))) if inference else out


def partition_check(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per outer group, whether the covered rows of its cells add up to the total."""
    return (cells.groupBy(*by).agg(F.sum("n_covered").alias("covered"), F.max("n_total").alias("total"))
            .withColumn("is_partition", F.col("covered") == F.col("total")))


def effect_balance(df: DataFrame, response: str, factor: str) -> DataFrame:
    """Sum of r_j times effect_j, which is zero up to rounding."""
    levels = anova_levels(df, response, factor, inference=False)
    return levels.agg(F.sum(F.col("r") * F.col("effect")).alias("weighted_effects"))


def z_scores(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Standardise columns by mean and population deviation, from one aggregate."""
    stats = df.agg(*[a for c in columns for a in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))])

    def z(c: str) -> Column:
        return F.try_divide(F.col(c) - stats.select(f"m_{c}").scalar(), stats.select(f"s_{c}").scalar())

    return df.withColumns({f"z_{c}": z(c) for c in columns})
