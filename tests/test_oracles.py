"""Every query with an SQL twin gives the twin's rows on whole tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_points

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
#: Run by ``test_learning`` with two trees a model in place of 300.
BOOSTED = {"gbt_scores", "calibrated_scores", "walk_forward_metrics", "ablation_metrics", "feature_importance"}
LLM = set(getattr(entry_points.llm_queries, "QUERIES", {}))
NAMES = sorted(set(entry_points.oracle_sql()) - LLM)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def rows_of(frame):
    def text(x):
        if x is None or (isinstance(x, float) and math.isnan(x)) or str(x) in ("NaT", "<NA>"):
            return "null"
        if isinstance(x, float):
            return f"{x:.5f}".replace("-0.00000", "0.00000")
        if isinstance(x, bool):
            return str(x)
        if hasattr(x, "isoformat"):
            return str(x)[:19].replace(" 00:00:00", "")
        if str(type(x)).find("int") >= 0:
            return f"{float(x):.5f}"
        return str(x)

    frame = frame[sorted(frame.columns)]
    return sorted("|".join(map(text, r)) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", NAMES)
def test_twin(spark, duck, name):
    got = entry_points.queries()[name](spark, SF).toPandas()
    want = duck.execute(entry_points.oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(set(entry_points.queries()) - set(entry_points.oracle_sql()) - LLM - BOOSTED))
def test_runs(spark, name):
    entry_points.queries()[name](spark, SF).collect()
