"""The registered queries: names, and rows equal to their SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry_module
from tools.check import TABLES, rows_of

SF = "/root/testdata/sf0.001"
QUICK = ["accuracy_by_level", "consensus_weighted", "fleiss_kappa", "cohen_kappa", "model_metrics", "ece", "brier_balanced",
         "cv_alignment", "perspectivism", "parse_responses", "tfidf_weights", "selection_removals", "error_recall", "lpm_m1"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_registry():
    queries, sql = entry_module.queries(), entry_module.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 120
    assert len(sql) / len(queries) > 0.9


def test_entry(spark):
    df = entry_module.entry(spark)
    assert set(df.columns) == {"consensus_level", "n", "hits", "accuracy"} and df.count() >= 1


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, con, name):
    df = entry_module.queries()[name](spark, SF)
    res = con.execute(entry_module.oracle_sql()[name])
    names = [c[0] for c in res.description]
    assert rows_of(df.columns, df.collect()) == rows_of(names, res.fetchall())
