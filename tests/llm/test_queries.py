import duckdb
import pytest

from rallygrid.llm.oracles import ORACLES
from rallygrid.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_twin(spark, name):
    con = duckdb.connect()
    for t in ("training_matches", "atp_odds", "documents", "eval_items"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = sorted(map(tuple, QUERIES[name](spark, SF).collect()))
    assert got == sorted(con.execute(ORACLES[name]).fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
