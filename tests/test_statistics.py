"""Designs, intervals and regression against published tables and direct linear algebra."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from accordant.functions import tails
from accordant.operators import design as D, intervals as I, regression as R

# Published 2^3 replicates (logit F1) with their effects and sums of squares.
REPLICATES = {
    (-1, -1, -1): (0.550, 0.567, 0.579, 0.672, 0.580), (1, -1, -1): (-0.038, -0.099, 0.002, -0.088, -0.087),
    (-1, 1, -1): (2.896, 2.885, 2.885, 2.838, 2.850), (-1, -1, 1): (0.511, 0.431, 0.411, 0.565, 0.377),
    (1, 1, -1): (1.196, 1.220, 1.207, 1.229, 1.222), (1, -1, 1): (0.207, 0.216, 0.143, 0.143, 0.233),
    (-1, 1, 1): (2.807, 2.769, 2.802, 2.755, 2.810), (1, 1, 1): (1.491, 1.494, 1.513, 1.513, 1.489)}
EFFECTS = {"B": -0.483, "C": 0.900, "D": 0.040, "BC": -0.253, "BD": 0.094, "CD": 0.010, "BCD": -0.002}
SQUARES = {"C": 32.3928, "B": 9.3442, "BC": 2.5547, "BD": 0.3500, "D": 0.0651}
# Published one-way replicates (F1) and effects.
ONE_WAY = {"movie": (0.914, 0.913, 0.912, 0.914, 0.913), "news": (0.865, 0.867),
           "books": (0.737, 0.737, 0.738, 0.738, 0.737), "dblp": (0.620, 0.620, 0.619, 0.620)}
ALPHAS = {"movie": 0.134, "news": 0.087, "books": -0.042, "dblp": -0.159}


@pytest.fixture(scope="module")
def factorial(spark):
    rows = [(*k, y) for k, ys in REPLICATES.items() for y in ys]
    return spark.createDataFrame(rows, "B int, C int, D int, y double")


@pytest.fixture(scope="module")
def one_way(spark):
    return spark.createDataFrame([(k, y) for k, ys in ONE_WAY.items() for y in ys], "level string, y double")


def test_factorial_effects(factorial):
    out = {r["effect"]: r for r in D.factorial_effects(factorial, "y", ["B", "C", "D"], replicates=5).collect()}
    for name, q in EFFECTS.items():
        assert out[name]["q"] == pytest.approx(q, abs=1e-3)
    for name, ss in SQUARES.items():
        assert out[name]["ss"] == pytest.approx(ss, abs=3e-2)
    r = out["C"]
    assert r["sst"] == pytest.approx(44.7654, abs=5e-3) and r["sse"] == pytest.approx(0.0541, abs=5e-3)
    assert r["df_error"] == 32 and r["significant"] and not out["BCD"]["significant"]
    assert r["pct_variation"] == pytest.approx(72.36, abs=0.05)


def test_factorial_needs_all_rows(factorial):
    with pytest.raises(ValueError, match="expected 48"):
        D.factorial_effects(factorial, "y", ["B", "C", "D"], replicates=6)


def test_contrast(factorial):
    effects = D.factorial_effects(factorial, "y", ["B", "C", "D"], inference=False)
    r = D.effect_contrast(effects, "C-B", {"C": 1, "B": -1}).first()
    assert r["u"] == pytest.approx(1.383, abs=2e-3)
    assert (r["ci_low"], r["ci_high"]) == (pytest.approx(1.365, abs=3e-3), pytest.approx(1.402, abs=3e-3))
    with pytest.raises(ValueError):
        D.effect_contrast(effects, "bad", {"C": 1})


def test_one_way(one_way):
    t = D.anova_table(one_way, "y", "level").first()
    assert t["mu"] == pytest.approx(0.7790, abs=1e-3) and (t["df_a"], t["df_e"]) == (3, 12)
    assert t["f_critical"] == pytest.approx(3.490295, abs=1e-5) and t["p_value"] < 1e-12
    levels = {r["level"]: r for r in D.anova_levels(one_way, "y", "level").collect()}
    for name, alpha in ALPHAS.items():
        assert levels[name]["effect"] == pytest.approx(alpha, abs=1e-3)
        assert levels[name]["effect_low"] < levels[name]["effect"] < levels[name]["effect_high"]
    assert abs(D.effect_balance(one_way, "y", "level").first()[0]) < 1e-9
    assert D.level_differences(one_way, "y", "level").filter("differs").count() == 6


def test_adjusted_p_values(spark):
    # Published raw and adjusted p-values of four comparisons.
    df = spark.createDataFrame([("a", 0.444), ("b", 3.1e-5), ("c", 1.5e-11), ("d", 7.2e-13)], "t string, p double")
    out = {r["t"]: r for r in I.adjust(df, "p").collect()}
    want = {"a": (1.0, 0.444), "b": (1.2e-4, 4.1e-5), "c": (5.9e-11, 3.0e-11), "d": (2.9e-12, 2.9e-12)}
    for t, (bonferroni, bh) in want.items():
        assert out[t]["p_bonferroni"] == pytest.approx(bonferroni, rel=0.05)
        assert out[t]["p_bh"] == pytest.approx(bh, rel=0.05)
    assert [out[t]["significant_bh"] for t in "abcd"] == [False, True, True, True]


def test_tied_p_values(spark):
    df = spark.createDataFrame([(i, p) for i, p in enumerate([0.01, 0.02, 0.02, 0.9])], "t int, p double")
    assert sorted(round(r["p_bh"], 6) for r in I.adjust(df, "p").collect()) == [0.026667, 0.026667, 0.026667, 0.9]


def test_mean_interval(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 4.0), ("b", 5.0)], "g string, y double")
    out = {r["g"]: r for r in I.mean_interval(df, "y", ["g"]).collect()}
    half = tails.numeric().t_critical(0.95, 2) * np.std([1, 2, 4], ddof=1) / np.sqrt(3)
    assert out["a"]["ci_high"] == pytest.approx(7 / 3 + half)
    assert out["b"]["mean"] == 5.0 and out["b"]["ci_low"] is None


def test_verdicts(spark):
    rows = [("same", d) for d in (-1.0, 1.0, 0.5, -0.5)] + [("real", d) for d in (1.0, 1.1, 0.9)] + [("maj", d) for d in (-1.0, -1.1, -0.9)]
    pairs = spark.createDataFrame([(g, d, 0.0, d) for g, d in rows], "dataset string, value_a double, value_b double, diff double")
    got = {r["dataset"]: r["verdict"] for r in I.paired_difference(pairs).collect()}
    assert got == {"same": "equivalentes (IC contém 0)", "real": "Real melhor", "maj": "Majoritário melhor"}


@pytest.fixture(scope="module")
def regression(spark):
    rng = np.random.default_rng(5)
    n = 600
    pdf = pd.DataFrame({"id": range(n), "x": rng.random(n), "z": rng.random(n), "g": rng.choice(["p", "q", "r"], n),
                        "h": rng.choice(["u", "v"], n)})
    pdf["y"] = (rng.random(n) < 0.3 + 0.4 * pdf["x"] + 0.1 * (pdf["g"] == "q")).astype(float)
    return pdf, spark.createDataFrame(pdf).repartition(3)


def dense(pdf, formula):
    cols = {"Intercept": np.ones(len(pdf))}
    for c in formula.categorical:
        for v in sorted(pdf[c].unique())[1:]:
            cols[f"{c}[T.{v}]"] = (pdf[c] == v).to_numpy(float)
    for x in formula.continuous:
        cols[x] = pdf[x].to_numpy()
    for x, c in formula.interactions:
        for v in sorted(pdf[c].unique())[1:]:
            cols[f"{x}:{c}[T.{v}]"] = pdf[x].to_numpy() * (pdf[c] == v)
    return list(cols), np.column_stack(list(cols.values()))


FORMULAS = {
    "plain": R.Formula(("x", "z")), "mixed": R.Formula(("x",), ("g", "h")),
    "crossed": R.Formula(("x",), ("g",), (("x", "g"),)), "none": R.Formula((), ("g",))}


def test_least_squares(regression):
    pdf, df = regression
    fits = R.fit_models(df, F.col("y"), FORMULAS)
    y = pdf["y"].to_numpy()
    for name, formula in FORMULAS.items():
        names, x = dense(pdf, formula)
        beta = np.linalg.lstsq(x, y, rcond=None)[0]
        e = y - x @ beta
        inv = np.linalg.inv(x.T @ x)
        cov = inv @ (x.T * e**2) @ x @ inv * len(y) / (len(y) - x.shape[1])
        fit = fits[name]
        assert [t.name for t in fit.terms] == names
        assert fit.coef == pytest.approx(beta, abs=1e-9)
        assert np.sqrt(np.diag(fit.cov)) == pytest.approx(np.sqrt(np.diag(cov)), abs=1e-9)
        assert fit.r2 == pytest.approx(1 - (e @ e) / ((y - y.mean()) ** 2).sum())
    assert R.coefficient_table(fits).count() == sum(f.k for f in fits.values())
    assert R.comparison_table(fits).count() == 4


def test_diagnostics(regression):
    pdf, df = regression
    fit = R.ols_hc1(df, F.col("y"), FORMULAS["mixed"], keep=["id"])
    names, x = dense(pdf, FORMULAS["mixed"])
    e = pdf["y"].to_numpy() - x @ np.linalg.lstsq(x, pdf["y"].to_numpy(), rcond=None)[0]
    dw = ((np.diff(e)) ** 2).sum() / (e**2).sum()
    for buckets in (1, 13, 1024):
        assert D.durbin_watson(fit.residuals(), "residual", "id", buckets).first()[0] == pytest.approx(dw)
    u = e**2
    aux = u - x @ np.linalg.lstsq(x, u, rcond=None)[0]
    r2 = 1 - (aux @ aux) / ((u - u.mean()) ** 2).sum()
    bp = R.breusch_pagan(fit).first()
    assert bp["lm"] == pytest.approx(len(u) * r2) and 0 <= bp["lm_p_value"] <= 1


def test_vif(regression):
    pdf, df = regression
    wide = df.withColumn("w", F.col("x") + F.col("z") * 0.5)
    got = {r["feature"]: r["vif"] for r in R.vif(wide, ["x", "w"]).collect()}
    r2 = np.corrcoef(pdf["x"], pdf["x"] + pdf["z"] * 0.5)[0, 1] ** 2
    assert got["x"] == pytest.approx(1 / (1 - r2)) == pytest.approx(got["w"])


def test_levene_and_bartlett(spark):
    pdf = pd.DataFrame({"g": ["a"] * 4 + ["b"] * 5, "y": [1.0, 2.0, 3.0, 9.0, 4.0, 4.5, 5.0, 5.2, 4.1]})
    df = spark.createDataFrame(pdf)
    z = pdf.assign(z=(pdf["y"] - pdf.groupby("g")["y"].transform("median")).abs())
    g = z.groupby("g")["z"]
    between = (g.count() * (g.mean() - z["z"].mean()) ** 2).sum()
    within = ((z["z"] - g.transform("mean")) ** 2).sum()
    assert D.levene(df, "y", "g").first()["statistic"] == pytest.approx(between / (within / 7))
    b = D.bartlett(df, "y", "g").first()
    v, n = pdf.groupby("g")["y"].var(), pdf.groupby("g")["y"].count()
    pooled = ((n - 1) * v).sum() / 7
    want = (7 * np.log(pooled) - ((n - 1) * np.log(v)).sum()) / (1 + ((1 / (n - 1)).sum() - 1 / 7) / 3)
    assert b["statistic"] == pytest.approx(want) and b["df"] == 1
