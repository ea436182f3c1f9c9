"""Experiment statistics over cells derived from the annotation table."""

from __future__ import annotations

from pyspark.sql import functions as F

from accordant.functions import coding, confidence as K
from accordant.operators import calibration as L, consensus as C, design as D, intervals as I, quality as Q, regression as R
from workload.agreement import classes_sql, r9
from workload.base import CONFS, VOTES, annotations, register, with_votes
from workload.calibration import sql_bin
from workload.consensus import majority

# Two-sided 95 % points used by the SQL statements: Student t for 4, 32 and 80 degrees of
# freedom and the normal distribution.
T4, T32, T80, Z = 2.7764451051977987, 2.036933343460101, 1.990063421254446, 1.959963984540054

FACTORS = ["B", "C", "D"]
LEVELS = {"B": ("domain", "english", "other"), "C": ("pattern", "2x1", "3x0"),
          "D": ("size_class", "curto", "longo")}
CELL = ["domain", "replica", "pattern", "size_class"]

DESIGN = """
dd AS (SELECT *, case when ground_truth = 1 then 'english' else 'other' end AS domain, run_id AS replica,
              case top when 3 then '3x0' when 2 then '2x1' end AS pattern
       FROM c WHERE ground_truth IS NOT NULL),
med AS (SELECT domain, replica, median(text_len) AS m FROM dd GROUP BY 1, 2),
du AS (SELECT dd.*, case when text_len <= m then 'curto' else 'longo' end AS size_class
       FROM dd JOIN med USING (domain, replica) WHERE ground_truth <> -1 AND mode <> -1 AND top >= 2)"""
CELLS = """
conf AS (SELECT domain, replica, pattern, size_class, ground_truth AS gt, mode AS pred, count(*) AS n FROM du GROUP BY ALL)"""
CELL_TABLE = """
cells AS (SELECT domain, replica, pattern, size_class, sum(support)::BIGINT AS n_covered, sum(tp) / sum(support) AS accuracy,
                 avg(f1) AS f1_macro, avg(prec) AS precision_macro, avg(rec) AS recall_macro FROM cls GROUP BY ALL),
obs AS (SELECT *, ln(greatest(least(accuracy, 1 - 1e-6), 1e-6) / (1 - greatest(least(accuracy, 1 - 1e-6), 1e-6))) AS y,
               case domain when 'english' then -1 else 1 end AS B, case pattern when '2x1' then -1 else 1 end AS C,
               case size_class when 'curto' then -1 else 1 end AS D FROM cells)"""
CTES = (DESIGN, CELLS, classes_sql("conf", "domain, replica, pattern, size_class"), CELL_TABLE)


def design_universe(spark, sf_dir):
    rows = majority(spark, sf_dir).filter("ground_truth is not null").select(
        "doc_id", "text_len", F.col("run_id").alias("replica"), "ground_truth", "resolved_annotation",
        "most_common_count",
        F.when(F.col("ground_truth") == 1, "english").otherwise("other").alias("domain"),
        F.when(F.col("most_common_count") == 3, "3x0").when(F.col("most_common_count") == 2, "2x1").alias("pattern"))
    return C.consensus_universe(coding.length_class(rows, ["domain", "replica"]))


def cells(spark, sf_dir):
    return Q.cell_metrics(design_universe(spark, sf_dir), ["domain", "replica"], ["pattern", "size_class"])


def observations(spark, sf_dir):
    coded = coding.code_factors(cells(spark, sf_dir), LEVELS)
    return coded.withColumn("y", K.logit(F.col("accuracy")))


METRICS = ("accuracy", "f1_macro", "precision_macro", "recall_macro")
SQL_METRICS = ", ".join(f"round({m}, 9) AS {m}" for m in METRICS)


@register("design_cells_2x2x2", with_votes(f"""
SELECT domain, replica, pattern, size_class, n_covered, {SQL_METRICS},
       sum(n_covered) OVER (PARTITION BY domain, replica)::BIGINT AS n_total,
       round(n_covered / (sum(n_covered) OVER (PARTITION BY domain, replica))::DOUBLE, 9) AS coverage FROM cells""", *CTES))
def cells_222(spark, sf_dir):
    return r9(cells(spark, sf_dir), *METRICS, "coverage")


_C22 = ("conf AS (SELECT dataset, pattern, ground_truth AS gt, mode AS pred, count(*) AS n FROM du GROUP BY ALL)",
        classes_sql("conf", "dataset, pattern"))


@register("design_cells_2x2", with_votes("""
SELECT dataset, pattern, n_covered, round(accuracy, 9) AS accuracy, round(f1_macro, 9) AS f1_macro,
       round(precision_macro, 9) AS precision_macro, round(recall_macro, 9) AS recall_macro,
       sum(n_covered) OVER (PARTITION BY dataset)::BIGINT AS n_total,
       round(n_covered / (sum(n_covered) OVER (PARTITION BY dataset))::DOUBLE, 9) AS coverage
FROM (SELECT dataset, pattern, sum(support)::BIGINT AS n_covered, sum(tp) / sum(support) AS accuracy, avg(f1) AS f1_macro,
             avg(prec) AS precision_macro, avg(rec) AS recall_macro FROM cls GROUP BY ALL)""", DESIGN, *_C22))
def cells_22(spark, sf_dir):
    rows = C.consensus_universe(majority(spark, sf_dir))
    marked = rows.withColumn("pattern", F.when(F.col("most_common_count") == 3, "3x0").otherwise("2x1"))
    return r9(Q.cell_metrics(marked, ["dataset"], ["pattern"]), *METRICS, "coverage")


@register("partition_check", with_votes("""
SELECT domain, replica, count(*) AS covered, count(*) AS total, true AS is_partition FROM du GROUP BY 1, 2""", *CTES))
def partition_check(spark, sf_dir):
    return D.partition_check(cells(spark, sf_dir), ["domain", "replica"])


@register("factor_coding", with_votes("""
SELECT domain, replica, pattern, size_class, cast(B as int) AS B, cast(C as int) AS C, cast(D as int) AS D,
       cast(B * C as int) AS BC, cast(B * D as int) AS BD, cast(C * D as int) AS CD, cast(B * C * D as int) AS BCD,
       case when B = -1 and C = -1 and D = -1 then '(1)' else (case when B = 1 then 'b' else '' end) ||
         (case when C = 1 then 'c' else '' end) || (case when D = 1 then 'd' else '' end) end AS treatment,
       round(y, 9) AS y FROM obs""", *CTES))
def factor_coding(spark, sf_dir):
    return r9(observations(spark, sf_dir).select(*CELL, "B", "C", "D", "BC", "BD", "CD", "BCD", "treatment", "y"), "y")


_EFFECTS = """
q AS (SELECT effect, sum(x * y) / count(*) AS q, count(*) AS n, count(*) * (sum(x * y) / count(*)) ** 2 AS ss
      FROM (SELECT y, unnest(['B', 'C', 'D', 'BC', 'BD', 'CD', 'BCD']) AS effect,
                   unnest([B, C, D, B * C, B * D, C * D, B * C * D]) AS x FROM obs) GROUP BY effect),
tot AS (SELECT sum((y - m) ** 2) AS sst, count(*) AS n, count(*) - 8 AS df_error FROM obs, (SELECT avg(y) AS m FROM obs)),
err AS (SELECT sst, n, df_error, sst - (SELECT sum(ss) FROM q) AS sse,
               sqrt((sst - (SELECT sum(ss) FROM q)) / df_error / n) AS s_q FROM tot)"""

# Two-sided Student tail for even degrees of freedom as a finite sum.
T_EVEN = """(1 - (abs({t}) / sqrt({df} + {t} * {t})) * (SELECT sum(exp(lgamma(2 * k + 1) - 2 * lgamma(k + 1) - k * ln(4e0))
            * (1 + {t} * {t} / {df}) ** (-k)) FROM generate_series(0, ({df} // 2 - 1)::BIGINT) g(k)))"""


@register("factorial_effects", with_votes(f"""
SELECT effect, round(q, 6) AS q, round(2 * q, 6) AS effect_2q, round(ss, 6) AS ss, round(100 * ss / sst, 6) AS pct_variation,
       round(sst, 6) AS sst, round(sse, 6) AS sse, df_error, err.n AS n, round(s_q, 6) AS s_q, round(q / s_q, 6) AS t,
       round(q - {T32} * s_q, 6) AS ci_low, round(q + {T32} * s_q, 6) AS ci_high,
       (q - {T32} * s_q) * (q + {T32} * s_q) > 0 AS significant,
       round({T_EVEN.format(t='(q / s_q)', df='32')}, 6) AS p_value
FROM q, err""", *CTES, _EFFECTS))
def factorial(spark, sf_dir):
    out = D.factorial_effects(observations(spark, sf_dir), "y", FACTORS)
    cols = ("q", "effect_2q", "ss", "pct_variation", "sst", "sse", "s_q", "t", "ci_low", "ci_high", "p_value")
    return out.withColumns({c: F.round(c, 6) for c in cols})


@register("effect_contrast", with_votes(f"""
SELECT 'C-B' AS contrast, round(u, 6) AS u, round(s_u, 6) AS s_u, df_error, round(u - {T32} * s_u, 6) AS ci_low,
       round(u + {T32} * s_u, 6) AS ci_high, (u - {T32} * s_u) * (u + {T32} * s_u) > 0 AS excludes_zero
FROM (SELECT sum(case effect when 'C' then q when 'B' then -q end) AS u FROM q),
     (SELECT sqrt(sse / df_error * 2 / n) AS s_u, df_error FROM err)""", *CTES, _EFFECTS))
def contrast(spark, sf_dir):
    effects = D.factorial_effects(observations(spark, sf_dir), "y", FACTORS, inference=False)
    out = D.effect_contrast(effects, "C-B", {"C": 1.0, "B": -1.0})
    return out.withColumns({c: F.round(c, 6) for c in ("u", "s_u", "ci_low", "ci_high")})


@register("treatment_means", with_votes("""
SELECT domain, pattern, size_class, round(avg(accuracy), 9) AS mean, round(stddev_samp(accuracy), 9) AS std,
       round(var_samp(accuracy), 9) AS var, count(*) AS n FROM cells GROUP BY 1, 2, 3""", *CTES))
def treatment_means(spark, sf_dir):
    return r9(D.treatment_means(cells(spark, sf_dir), "accuracy", ["domain", "pattern", "size_class"]),
              "mean", "std", "var")


@register("factor_means", with_votes("""
SELECT effect, level_1, level_2, round(avg(y), 9) AS mean, count(*) AS n FROM (
  SELECT y, unnest(['B', 'C', 'D', 'BC', 'BD', 'CD']) AS effect, unnest([B, C, D, B, B, C])::INT AS level_1,
         unnest([NULL, NULL, NULL, C, D, D])::INT AS level_2 FROM obs) GROUP BY ALL""", *CTES))
def factor_means(spark, sf_dir):
    return r9(D.factor_means(observations(spark, sf_dir), "y", FACTORS), "mean")


# --- one-way layout: dataset with one accuracy per run ---------------------------------------

ONE_WAY = """
ow AS (SELECT dataset, run_id, avg((mode = ground_truth)::int) AS y, row_number() OVER (ORDER BY dataset, run_id) AS pos
       FROM c WHERE ground_truth IS NOT NULL AND mode <> -1 AND NOT tied GROUP BY 1, 2),
lv AS (SELECT dataset, count(*) AS r, avg(y) AS mean FROM ow GROUP BY 1),
an AS (SELECT n, levels, mu, ssy, n * mu * mu AS ss0, ssy - n * mu * mu AS sst, ssa, ssy - n * mu * mu - ssa AS sse,
              levels - 1 AS df_a, n - levels AS df_e
       FROM (SELECT count(*) AS n, avg(y) AS mu, sum(y * y) AS ssy FROM ow),
            (SELECT count(*) AS levels, sum(r * (mean - (SELECT avg(y) FROM ow)) ** 2) AS ssa FROM lv))"""


def one_way(spark, sf_dir):
    rows = majority(spark, sf_dir).filter("ground_truth is not null")
    out = Q.covered_metrics(rows, ["dataset", "run_id"])
    return out.filter("n_covered > 0").select("dataset", "run_id", F.col("accuracy").alias("y"))


@register("anova_one_way", with_votes("""
SELECT n, levels, round(mu, 9) AS mu, round(ssy, 8) AS ssy, round(ss0, 8) AS ss0, round(sst, 8) AS sst, round(ssa, 8) AS ssa,
       round(sse, 8) AS sse, df_a, df_e, round(ssa / df_a, 8) AS msa, round(sse / df_e, 8) AS mse,
       round(f, 6) AS f, round(100 * ssa / sst, 6) AS pct_factor,
       round(1 - (1 - x) ** (df_a / 2e0) * (SELECT sum(exp(lgamma(df_a / 2e0 + j) - lgamma(df_a / 2e0) - lgamma(j + 1)) * x ** j)
             FROM generate_series(0, (df_e // 2 - 1)::BIGINT) g(j)), 6) AS p_value
FROM (SELECT *, (ssa / df_a) / (sse / df_e) AS f, df_e / (df_e + df_a * ((ssa / df_a) / (sse / df_e))) AS x FROM an)""", ONE_WAY))
def anova(spark, sf_dir):
    out = D.anova_table(one_way(spark, sf_dir), "y", "dataset").drop("f_critical")
    eights = ("ssy", "ss0", "sst", "ssa", "sse", "msa", "mse")
    return out.withColumns({**{c: F.round(c, 8) for c in eights}, "mu": F.round("mu", 9),
                            **{c: F.round(c, 6) for c in ("f", "pct_factor", "p_value")}})


@register("anova_levels", with_votes(f"""
SELECT dataset AS level, r, round(mean, 8) AS mean, round(mean - mu, 8) AS effect,
       round(mean - mu - {T80} * sqrt(sse / df_e * (n - r) / (n * r)), 8) AS effect_low,
       round(mean - mu + {T80} * sqrt(sse / df_e * (n - r) / (n * r)), 8) AS effect_high,
       round(mean - {T80} * sqrt(sse / df_e / r), 8) AS mean_low, round(mean + {T80} * sqrt(sse / df_e / r), 8) AS mean_high
FROM lv, an""", ONE_WAY))
def anova_levels(spark, sf_dir):
    out = D.anova_levels(one_way(spark, sf_dir), "y", "dataset")
    return out.withColumns({c: F.round(c, 8) for c in (
        "mean", "effect", "effect_low", "effect_high", "mean_low", "mean_high")})


@register("anova_differences", with_votes(f"""
SELECT a.dataset AS level_1, b.dataset AS level_2, round(a.mean - b.mean, 8) AS difference,
       round(sqrt(sse / df_e) * sqrt(1e0 / a.r + 1e0 / b.r), 8) AS std_error, df_e,
       round(a.mean - b.mean - {T80} * sqrt(sse / df_e) * sqrt(1e0 / a.r + 1e0 / b.r), 8) AS ci_low,
       round(a.mean - b.mean + {T80} * sqrt(sse / df_e) * sqrt(1e0 / a.r + 1e0 / b.r), 8) AS ci_high,
       abs(a.mean - b.mean) > {T80} * sqrt(sse / df_e) * sqrt(1e0 / a.r + 1e0 / b.r) AS differs
FROM lv a JOIN lv b ON a.dataset < b.dataset, an""", ONE_WAY))
def anova_differences(spark, sf_dir):
    out = D.level_differences(one_way(spark, sf_dir), "y", "dataset")
    return out.withColumns({c: F.round(c, 8) for c in ("difference", "std_error", "ci_low", "ci_high")})


@register("effect_balance", with_votes("""
SELECT round(abs(sum(r * (mean - mu))), 9) AS weighted_effects FROM lv, an""", ONE_WAY))
def effect_balance(spark, sf_dir):
    out = D.effect_balance(one_way(spark, sf_dir), "y", "dataset")
    return out.withColumn("weighted_effects", F.round(F.abs("weighted_effects"), 9))


@register("levene_test", with_votes("""
SELECT round((b / (g - 1)) / (w / (n - g)), 6) AS statistic, g - 1 AS df_1, n - g AS df_2 FROM (
  SELECT count(*) AS n, count(DISTINCT dataset) AS g, sum((z - zm) ** 2) AS w,
         (SELECT sum(r * (zm - (SELECT avg(z) FROM dev)) ** 2) FROM (SELECT count(*) AS r, avg(z) AS zm FROM dev GROUP BY dataset)) AS b
  FROM (SELECT *, avg(z) OVER (PARTITION BY dataset) AS zm FROM dev))""", ONE_WAY,
    "dev AS (SELECT dataset, abs(y - median(y) OVER (PARTITION BY dataset)) AS z FROM ow)"))
def levene(spark, sf_dir):
    return D.levene(one_way(spark, sf_dir), "y", "dataset", inference=False).withColumn(
        "statistic", F.round("statistic", 6))


@register("bartlett_test", with_votes("""
SELECT round(((n - k) * ln(p / (n - k)) - l) / (1 + (i - 1 / (n - k)) / (3 * (k - 1))), 6) AS statistic, (k - 1)::BIGINT AS df
FROM (SELECT sum(r)::DOUBLE AS n, count(*)::DOUBLE AS k, sum((r - 1) * v) AS p, sum((r - 1) * ln(v)) AS l, sum(1e0 / (r - 1)) AS i
      FROM (SELECT model, count(*) AS r, var_samp(y) AS v FROM by_model GROUP BY 1))""",
    """by_model AS (SELECT annotator AS model, dataset, avg((label = ground_truth)::int) AS y FROM long
       WHERE ground_truth IS NOT NULL GROUP BY 1, 2)"""))
def bartlett(spark, sf_dir):
    hits = L.long_confidences(annotations(spark, sf_dir), VOTES, keep=["dataset"]).filter("ground_truth is not null")
    y = F.avg((F.col("label") == F.col("ground_truth")).cast("double")).alias("y")
    return D.bartlett(hits.groupBy("model", "dataset").agg(y), "y", "model", inference=False).withColumn(
        "statistic", F.round("statistic", 6))


@register("variance_tests_p")
def variance_p(spark, sf_dir):
    cells_ = one_way(spark, sf_dir)
    lev = D.levene(cells_, "y", "dataset").select(F.lit("levene").alias("test"), "statistic", "p_value")
    hits = L.long_confidences(annotations(spark, sf_dir), VOTES, keep=["dataset"]).filter("ground_truth is not null")
    y = F.avg((F.col("label") == F.col("ground_truth")).cast("double")).alias("y")
    bar = D.bartlett(hits.groupBy("model", "dataset").agg(y), "y", "model")
    return lev.unionByName(bar.select(F.lit("bartlett").alias("test"), "statistic", "p_value"))


@register("residuals", with_votes("""
SELECT dataset, run_id, round(y - avg(y) OVER (PARTITION BY dataset), 9) AS residual FROM ow""", ONE_WAY))
def residuals(spark, sf_dir):
    return r9(D.residuals(one_way(spark, sf_dir), "y", "dataset").select("dataset", "run_id", "residual"), "residual")


# --- two systems over the same folds ---------------------------------------------------------

PAIRS = """
pr AS (SELECT dataset, cast(substr(run_id, 10, 1) as int) - 1 AS fold, avg((ann_a = ground_truth)::int) AS a,
              avg((mode = ground_truth)::int) AS b FROM c WHERE ground_truth IS NOT NULL GROUP BY 1, 2),
pd AS (SELECT dataset, count(*) AS n, avg(a) AS mean_a, avg(b) AS mean_b, avg(a - b) AS mean_diff,
              stddev_samp(a - b) / sqrt(count(*)) AS se FROM pr GROUP BY 1)"""


def _fold_accuracy(rows, pred):
    hit = F.avg((F.col(pred) == F.col("ground_truth")).cast("double")).alias("f1_macro")
    fold = (F.substring("run_id", 10, 1).cast("int") - 1).alias("fold")
    return rows.groupBy("dataset", fold).agg(hit)


def fold_pairs(spark, sf_dir):
    from accordant.operators.align import pair_folds
    rows = majority(spark, sf_dir).filter("ground_truth is not null")
    return pair_folds(_fold_accuracy(rows, VOTES[0]), _fold_accuracy(rows, "resolved_annotation"))


@register("fold_pairing", with_votes("""
SELECT dataset, cast(fold as int) AS fold, round(a, 9) AS value_a, round(b, 9) AS value_b, round(a - b, 9) AS diff FROM pr""", PAIRS))
def fold_pairing(spark, sf_dir):
    return r9(fold_pairs(spark, sf_dir), "value_a", "value_b", "diff")


@register("mean_ci", with_votes(f"""
SELECT dataset, n, round(mean_a, 8) AS mean, round(sa, 8) AS std_error, round(mean_a - {T4} * sa, 8) AS ci_low,
       round(mean_a + {T4} * sa, 8) AS ci_high
FROM pd JOIN (SELECT dataset, stddev_samp(a) / sqrt(count(*)) AS sa FROM pr GROUP BY 1) USING (dataset)""", PAIRS))
def mean_ci(spark, sf_dir):
    out = I.mean_interval(fold_pairs(spark, sf_dir), "value_a", ["dataset"])
    return out.withColumns({c: F.round(c, 8) for c in ("mean", "std_error", "ci_low", "ci_high")})


@register("paired_diff", with_votes(f"""
SELECT dataset, round(mean_a, 8) AS mean_a, round(mean_b, 8) AS mean_b, n, round(mean_diff, 8) AS mean_diff,
       round(se, 8) AS std_error, round(lo, 8) AS ci_low, round(hi, 8) AS ci_high,
       case when lo <= 0 and hi >= 0 then 'equivalentes (IC contém 0)' when lo > 0 then 'Real melhor'
            when hi < 0 then 'Majoritário melhor' end AS verdict
FROM (SELECT *, mean_diff - {T4} * se AS lo, mean_diff + {T4} * se AS hi FROM pd)""", PAIRS))
def paired_diff(spark, sf_dir):
    out = I.paired_difference(fold_pairs(spark, sf_dir))
    return out.withColumns({c: F.round(c, 8) for c in ("mean_a", "mean_b", "mean_diff", "std_error", "ci_low", "ci_high")})


_P4 = T_EVEN.format(t="t", df="4")


@register("paired_t", with_votes(f"""
SELECT dataset, n, round(t, 6) AS t, round({_P4}, 8) AS p_value FROM (SELECT *, mean_diff / nullif(se, 0) AS t FROM pd)""", PAIRS))
def paired_t(spark, sf_dir):
    return I.paired_t(fold_pairs(spark, sf_dir)).withColumns({"t": F.round("t", 6), "p_value": F.round("p_value", 8)})


@register("bh_adjust", with_votes(f"""
SELECT dataset, round(p, 8) AS p_value, round(least(1, p * m), 8) AS p_bonferroni,
       round(least(1, min(p * m / rk) OVER (ORDER BY p DESC, dataset ROWS UNBOUNDED PRECEDING)), 8) AS p_bh,
       least(1, p * m) < 0.05 AS significant_bonferroni,
       least(1, min(p * m / rk) OVER (ORDER BY p DESC, dataset ROWS UNBOUNDED PRECEDING)) < 0.05 AS significant_bh
FROM (SELECT *, count(*) OVER () AS m, rank() OVER (ORDER BY p) + count(*) OVER (PARTITION BY p) - 1 AS rk FROM (
  SELECT dataset, round({_P4}, 10) AS p FROM (SELECT *, mean_diff / nullif(se, 0) AS t FROM pd)) WHERE p IS NOT NULL)""", PAIRS))
def bh_adjust(spark, sf_dir):
    tests = I.paired_t(fold_pairs(spark, sf_dir)).select("dataset", F.round("p_value", 10).alias("p_value"))
    out = I.adjust(tests, "p_value")
    return out.withColumns({c: F.round(c, 8) for c in ("p_value", "p_bonferroni", "p_bh")})


@register("fold_aggregation", with_votes("""
SELECT dataset, 'value_a' AS metric, round(avg(a), 9) AS mean, round(stddev_pop(a), 9) AS std, count(*) AS folds FROM pr GROUP BY 1
UNION ALL SELECT dataset, 'value_b', round(avg(b), 9), round(stddev_pop(b), 9), count(*) FROM pr GROUP BY 1""", PAIRS))
def fold_aggregation(spark, sf_dir):
    pairs = fold_pairs(spark, sf_dir).drop("diff")
    return r9(I.fold_summary(pairs, ["value_a", "value_b"], ["dataset"]), "mean", "std")


# --- regression ------------------------------------------------------------------------------

REG = """
rb AS (SELECT doc_id, dataset, case when top = 3 then '3x0' else '2x1' end AS consensus_type, cast((top = 3) as int) AS consensus_code,
              cast((mode = ground_truth) as int) AS correct, ann_a_conf AS ca, ann_b_conf AS cb, ann_c_conf AS cc,
              (ann_a_conf + ann_b_conf + ann_c_conf) / 3 AS mean_confidence,
              sqrt(((ann_a_conf - (ann_a_conf + ann_b_conf + ann_c_conf) / 3) ** 2 + (ann_b_conf - (ann_a_conf + ann_b_conf + ann_c_conf) / 3) ** 2
                    + (ann_c_conf - (ann_a_conf + ann_b_conf + ann_c_conf) / 3) ** 2) / 3) AS std_confidence
       FROM c WHERE ground_truth <> -1 AND mode <> -1 AND top >= 2)"""


def base(spark, sf_dir):
    return R.regression_base(majority(spark, sf_dir), CONFS)


@register("regression_base", with_votes("""
SELECT doc_id, dataset, consensus_type, consensus_code, correct, round(mean_confidence, 9) AS mean_confidence,
       round(std_confidence, 9) AS std_confidence FROM rb""", REG))
def regression_base(spark, sf_dir):
    return r9(base(spark, sf_dir).select("doc_id", "dataset", "consensus_type", "consensus_code", "correct",
                                         "mean_confidence", "std_confidence"), "mean_confidence", "std_confidence")


M1 = """
s AS (SELECT count(*) AS n, avg(mean_confidence) AS mx, avg(correct) AS my, regr_slope(correct, mean_confidence) AS b1,
             regr_intercept(correct, mean_confidence) AS b0, regr_sxx(correct, mean_confidence) AS sxx,
             regr_r2(correct, mean_confidence) AS r2 FROM rb),
e AS (SELECT doc_id, mean_confidence AS x, correct AS y, correct - b0 - b1 * mean_confidence AS e, n, mx, sxx FROM rb, s),
h AS (SELECT sqrt(any_value(n) / (any_value(n) - 2e0) * sum(e * e * ((x - mx) / sxx) ** 2)) AS se1,
             sqrt(any_value(n) / (any_value(n) - 2e0) * sum(e * e * (1e0 / n - mx * (x - mx) / sxx) ** 2)) AS se0,
             sum(e * e) AS sse FROM e)"""


@register("lpm_m1", with_votes(f"""
SELECT term, round(b, 8) AS coef, round(se, 8) AS std_err, round(b / se, 6) AS z, round(b - {Z} * se, 8) AS ci_low,
       round(b + {Z} * se, 8) AS ci_high
FROM (SELECT 'Intercept' AS term, b0 AS b, se0 AS se FROM s, h UNION ALL SELECT 'mean_confidence', b1, se1 FROM s, h)""", REG, M1))
def lpm_m1(spark, sf_dir):
    out = R.coefficient_table({"M1": m1(spark, sf_dir)}).drop("p_value", "model")
    return out.withColumns({**{c: F.round(c, 8) for c in ("coef", "std_err", "ci_low", "ci_high")}, "z": F.round("z", 6)})


def m1(spark, sf_dir):
    return R.ols_hc1(base(spark, sf_dir), F.col("correct"), FORMULAS["M1"], keep=["doc_id"])


FORMULAS = {
    "M1": R.Formula(("mean_confidence",)),
    "M2": R.Formula(tuple(CONFS)),
    "M3": R.Formula(("mean_confidence",), ("consensus_type",)),
    "M4": R.Formula(("mean_confidence",), ("consensus_type",), (("mean_confidence", "consensus_type"),)),
    "M5": R.Formula(("mean_confidence",), ("consensus_type", "dataset")),
    "M6": R.Formula((*CONFS, "std_confidence"), ("consensus_type", "dataset")),
}


@register("lpm_models")
def lpm_models(spark, sf_dir):
    return R.coefficient_table(R.fit_models(base(spark, sf_dir), F.col("correct"), FORMULAS))


# The slopes within each agreement type are the interaction model's coefficients.
@register("lpm_m4", with_votes("""
SELECT unnest(['Intercept', 'consensus_type[T.3x0]', 'mean_confidence', 'mean_confidence:consensus_type[T.3x0]']) AS term,
       round(unnest([i0, i1 - i0, s0, s1 - s0]), 8) AS coef
FROM (SELECT regr_intercept(correct, mean_confidence) AS i0, regr_slope(correct, mean_confidence) AS s0 FROM rb WHERE consensus_code = 0),
     (SELECT regr_intercept(correct, mean_confidence) AS i1, regr_slope(correct, mean_confidence) AS s1 FROM rb WHERE consensus_code = 1)""", REG))
def lpm_m4(spark, sf_dir):
    fit = R.ols_hc1(base(spark, sf_dir), F.col("correct"), FORMULAS["M4"])
    return R.coefficient_table({"M4": fit}).select("term", F.round("coef", 8).alias("coef"))


@register("lpm_comparison", with_votes("""
SELECT 'M1' AS model, round(r2, 8) AS r2, round(1 - (1 - r2) * (n - 1) / (n - 2e0), 8) AS r2_adj,
       round(n * (ln(2 * pi()) + ln(sse / n) + 1) + 4, 5) AS aic, round(n * (ln(2 * pi()) + ln(sse / n) + 1) + 2 * ln(n), 5) AS bic, n
FROM s, h""", REG, M1))
def lpm_comparison(spark, sf_dir):
    out = R.comparison_table({"M1": m1(spark, sf_dir)})
    return out.withColumns({"r2": F.round("r2", 8), "r2_adj": F.round("r2_adj", 8), "aic": F.round("aic", 5), "bic": F.round("bic", 5)})


_XS = {"Intercept": "1", "ca": "ca", "cb": "cb", "cc": "cc", "std_confidence": "std_confidence",
       "consensus_type[T.3x0]": "consensus_code", "y": "correct"}
_PAIRS = [(a, b) for i, a in enumerate(_XS) for b in list(_XS)[i:]]


@register("lpm_normal_equations", with_votes(
    " UNION ALL ".join(f"SELECT '{a}' AS term_1, '{b}' AS term_2, round(sum({_XS[a]}::DOUBLE * {_XS[b]}), 6) AS value FROM rb"
                       for a, b in _PAIRS), REG))
def normal_equations(spark, sf_dir):
    rows = base(spark, sf_dir).withColumnsRenamed(dict(zip(CONFS, ("ca", "cb", "cc"))))
    terms = {**{c: F.col(c) for c in ("ca", "cb", "cc", "std_confidence")},
             "consensus_type[T.3x0]": (F.col("consensus_type") == "3x0").cast("double")}
    out = R.normal_equations(rows, F.col("correct"), terms)
    return out.withColumn("value", F.round("value", 6))


@register("breusch_pagan", with_votes("""
SELECT round(n * r2, 6) AS lm, round(r2 / ((1 - r2) / (n - 2e0)), 6) AS f
FROM (SELECT count(*) AS n, regr_r2(e * e, x) AS r2 FROM e)""", REG, M1))
def breusch_pagan(spark, sf_dir):
    return R.breusch_pagan(m1(spark, sf_dir)).select(F.round("lm", 6).alias("lm"), F.round("f", 6).alias("f"))


@register("durbin_watson", with_votes("""
SELECT round(sum((e - p) ** 2) / (SELECT sum(e * e) FROM e), 8) AS durbin_watson
FROM (SELECT e, lag(e) OVER (ORDER BY doc_id) AS p FROM e)""", REG, M1))
def durbin_watson(spark, sf_dir):
    return D.durbin_watson(m1(spark, sf_dir).residuals(), "residual", "doc_id").withColumn(
        "durbin_watson", F.round("durbin_watson", 8))


@register("corr_matrix", with_votes("""
SELECT 'ca' AS column_1, 'cb' AS column_2, round(corr(ca, cb), 9) AS r FROM rb UNION ALL
SELECT 'ca', 'cc', round(corr(ca, cc), 9) FROM rb UNION ALL SELECT 'ca', 'mean_confidence', round(corr(ca, mean_confidence), 9) FROM rb UNION ALL
SELECT 'cb', 'cc', round(corr(cb, cc), 9) FROM rb UNION ALL SELECT 'cb', 'mean_confidence', round(corr(cb, mean_confidence), 9) FROM rb UNION ALL
SELECT 'cc', 'mean_confidence', round(corr(cc, mean_confidence), 9) FROM rb""", REG))
def corr_matrix(spark, sf_dir):
    rows = base(spark, sf_dir).withColumnsRenamed(dict(zip(CONFS, ("ca", "cb", "cc"))))
    return r9(R.pearson(rows, ["ca", "cb", "cc", "mean_confidence"]), "r")


@register("spearman", with_votes("""
SELECT 'mean_confidence' AS column_1, 'std_confidence' AS column_2, round(corr(ra, rb_), 8) AS rho FROM (
  SELECT rank() OVER (ORDER BY mean_confidence) + (count(*) OVER (PARTITION BY mean_confidence) - 1) / 2e0 AS ra,
         rank() OVER (ORDER BY std_confidence) + (count(*) OVER (PARTITION BY std_confidence) - 1) / 2e0 AS rb_
  FROM rb)""", REG))
def spearman(spark, sf_dir):
    cols = ["mean_confidence", "std_confidence"]
    return R.spearman(base(spark, sf_dir).select(*cols), cols).withColumn("rho", F.round("rho", 8))


@register("vif", with_votes("""
SELECT unnest(['ca', 'cb', 'cc']) AS feature, round(unnest([(1 - bc * bc) / det, (1 - ac * ac) / det, (1 - ab * ab) / det]), 8) AS vif
FROM (SELECT *, 1 + 2 * ab * ac * bc - ab * ab - ac * ac - bc * bc AS det FROM
      (SELECT corr(ca, cb) AS ab, corr(ca, cc) AS ac, corr(cb, cc) AS bc FROM rb))""", REG))
def vif(spark, sf_dir):
    rows = base(spark, sf_dir).withColumnsRenamed(dict(zip(CONFS, ("ca", "cb", "cc"))))
    return R.vif(rows, ["ca", "cb", "cc"]).withColumn("vif", F.round("vif", 8))


@register("descriptive_stats", with_votes(" UNION ALL ".join(f"""
SELECT '{c}' AS "column", count({c}) AS n, round(avg({c}), 9) AS mean, round(stddev_samp({c}), 9) AS std, round(min({c}), 9) AS min,
       round(max({c}), 9) AS max, round(quantile_cont({c}, 0.25), 9) AS p25, round(quantile_cont({c}, 0.5), 9) AS p50,
       round(quantile_cont({c}, 0.75), 9) AS p75 FROM rb""" for c in ("mean_confidence", "std_confidence")), REG))
def descriptive(spark, sf_dir):
    return r9(R.describe(base(spark, sf_dir), ["mean_confidence", "std_confidence"]),
              "mean", "std", "min", "max", "p25", "p50", "p75")


@register("z_scores", with_votes("""
SELECT doc_id, round((mean_confidence - avg(mean_confidence) OVER ()) / stddev_pop(mean_confidence) OVER (), 8) AS z_mean_confidence FROM rb""", REG))
def z_scores(spark, sf_dir):
    out = D.z_scores(base(spark, sf_dir), ["mean_confidence"])
    return out.select("doc_id", F.round("z_mean_confidence", 8).alias("z_mean_confidence"))


@register("hit_rate_by_bin", with_votes(f"""
SELECT {sql_bin('mean_confidence')} AS bin, round(avg(correct), 9) AS hit_rate, count(*) AS n FROM rb GROUP BY 1""", REG))
def hit_rate(spark, sf_dir):
    return r9(L.hit_rate_by_bin(base(spark, sf_dir), "mean_confidence", "correct"), "hit_rate")


@register("hit_rate_by_dataset_bin", with_votes(f"""
SELECT dataset, {sql_bin('mean_confidence')} AS bin, round(avg(correct), 9) AS hit_rate, count(*) AS n FROM rb GROUP BY 1, 2""", REG))
def hit_rate_dataset(spark, sf_dir):
    return r9(L.hit_rate_by_bin(base(spark, sf_dir), "mean_confidence", "correct", ["dataset"]), "hit_rate")


@register("consensus_type_counts", with_votes("""
SELECT dataset, consensus_type, count(*) AS n, round(avg(mean_confidence), 9) AS mean_confidence, round(avg(correct), 9) AS hit_rate
FROM rb GROUP BY 1, 2""", REG))
def type_counts(spark, sf_dir):
    return r9(base(spark, sf_dir).groupBy("dataset", "consensus_type").agg(
        F.count(F.lit(1)).alias("n"), F.avg("mean_confidence").alias("mean_confidence"),
        F.avg("correct").alias("hit_rate")), "mean_confidence", "hit_rate")


def _profile_sql(by: str) -> str:
    return f"""
SELECT {by}, count(*) AS n, round(avg(mean_confidence), 9) AS mean, round(min(mean_confidence), 9) AS min, round(max(mean_confidence), 9) AS max,
       round(avg(correct), 9) AS hit_rate, round(quantile_cont(mean_confidence, 0.25), 9) AS q1, round(quantile_cont(mean_confidence, 0.5), 9) AS median,
       round(quantile_cont(mean_confidence, 0.75), 9) AS q3 FROM rb GROUP BY 1"""


def profile(spark, sf_dir, by):
    return r9(L.confidence_profile(base(spark, sf_dir).select(by, "mean_confidence", "correct"), [by]), "mean", "min", "max", "hit_rate", "q1", "median", "q3")


@register("confidence_by_dataset", with_votes(_profile_sql("dataset"), REG))
def confidence_by_dataset(spark, sf_dir):
    return profile(spark, sf_dir, "dataset")


@register("confidence_by_type", with_votes(_profile_sql("consensus_type"), REG))
def confidence_by_type(spark, sf_dir):
    return profile(spark, sf_dir, "consensus_type")


# --- all models, by elimination in SQL ---------------------------------------------------------

_TYPE = [("consensus_type[T.3x0]", "consensus_code")]
_DATASET = [(f"dataset[T.{d}]", f"(dataset = '{d}')::INT") for d in sorted(f"src{i}" for i in range(20))[1:]]
_MEAN, _EACH = [("mean_confidence", "mean_confidence")], list(zip(CONFS, ("ca", "cb", "cc")))
DESIGNS = {
    "M1": _MEAN, "M2": _EACH, "M3": _TYPE + _MEAN, "M4": _TYPE + _MEAN + [("mean_confidence:consensus_type[T.3x0]", "mean_confidence * consensus_code")],
    "M5": _TYPE + _DATASET + _MEAN, "M6": _TYPE + _DATASET + _EACH + [("std_confidence", "std_confidence")],
}


def ols_sql(name: str, design) -> tuple[str, str]:
    """(common table expressions, rows) of a least-squares fit with HC1 errors; the normal equations are solved column by column."""
    t, terms = name.lower(), [("Intercept", "1"), *design]
    k = len(terms)
    dot = lambda a, b: f"list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1] * z[2]))"
    ctes = [f"{t}x AS MATERIALIZED (SELECT [{', '.join(f'({e})::DOUBLE' for _, e in terms)}] AS x, correct::DOUBLE AS y FROM rb)",
            f"{t}i AS (SELECT unnest(range(1, {k + 1})) AS i)",
            f"{t}g0 AS MATERIALIZED (SELECT i, list(v ORDER BY j) || list_transform(range(1, {k + 1}), lambda c: CASE WHEN c = i THEN 1e0 ELSE 0e0 END) AS r FROM "
            f"(SELECT p.i AS i, q.i AS j, sum(x[p.i] * x[q.i]) AS v FROM {t}x, {t}i p, {t}i q GROUP BY 1, 2) GROUP BY i)"]
    for p in range(1, k + 1):
        ctes.append(f"{t}g{p} AS MATERIALIZED (SELECT g.i, CASE WHEN g.i = {p} THEN list_transform(g.r, lambda e: e / b.pivot) ELSE "
                    f"list_transform(list_zip(g.r, b.r), lambda z: z[1] - g.r[{p}] * z[2] / b.pivot) END AS r "
                    f"FROM {t}g{p - 1} g, (SELECT r, r[{p}] AS pivot FROM {t}g{p - 1} WHERE i = {p}) b)")
    ctes += [f"{t}v AS MATERIALIZED (SELECT i, r[{k + 1}:{2 * k}] AS r FROM {t}g{k})",
             f"{t}b AS MATERIALIZED (SELECT v.i, sum({dot('v.r', 'x')} * y) AS coef FROM {t}v v, {t}x GROUP BY v.i)",
             f"{t}e AS MATERIALIZED (SELECT x, y - {dot('x', 'c')} AS e FROM {t}x, (SELECT list(coef ORDER BY i) AS c FROM {t}b))",
             f"{t}h AS (SELECT v.i, sqrt(count(*) / (count(*) - {k}e0) * sum(({dot('v.r', 'x')} * e) ** 2)) AS se FROM {t}v v, {t}e GROUP BY v.i)"]
    names = "[" + ", ".join(f"'{n}'" for n, _ in terms) + "]"
    return ",\n".join(ctes), f"SELECT '{name}' AS model, {names}[i] AS term, coef, se FROM {t}b JOIN {t}h USING (i)"


_MODELS = {name: ols_sql(name, design) for name, design in DESIGNS.items()}


@register("lpm_coefficients", with_votes(f"""
SELECT model, term, round(coef, 7) AS coef, round(se, 7) AS std_err, round(coef / se, 4) AS z, round(coef - {Z} * se, 7) AS ci_low, round(coef + {Z} * se, 7) AS ci_high
FROM ({" UNION ALL ".join(rows for _, rows in _MODELS.values())})""", REG, ",\n".join(ctes for ctes, _ in _MODELS.values())))
def lpm_coefficients(spark, sf_dir):
    """All six models with robust errors, from two scans."""
    out = R.coefficient_table(R.fit_models(base(spark, sf_dir), F.col("correct"), FORMULAS)).drop("p_value")
    return out.withColumns({**{c: F.round(c, 7) for c in ("coef", "std_err", "ci_low", "ci_high")}, "z": F.round("z", 4)})

