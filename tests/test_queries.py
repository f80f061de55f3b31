"""Every registered query with an oracle gives DuckDB's rows on the smallest tables."""

import math

import duckdb
import pytest

from utterloom.operators import reports as R
from utterloom.plans import queries as own

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    return str([plain(x) for x in v]) if isinstance(v, list | tuple) else str(v)


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(own.ORACLES))
def test_query(spark, oracle, name):
    got = own.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    cur = oracle.execute(own.ORACLES[name])
    at = {d[0]: i for i, d in enumerate(cur.description)}
    assert sorted(at) == cols
    want = sorted(tuple(plain(r[at[c]]) for c in cols) for r in cur.fetchall())
    assert sorted(tuple(plain(r[c]) for c in cols) for r in got.collect()) == want


def test_blind_keys_of_more_than_999_rows(spark, tmp_path):
    rows = [(k, 1, int(k % 10 > 0)) for k in range(1400)]
    spark.createDataFrame(rows, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW labels AS SELECT * FROM read_parquet('{tmp_path}/labels.parquet/*.parquet')")
    want = dict(con.execute(own.ORACLES["q_blind_keys"]).fetchall())
    got = own.QUERIES["q_blind_keys"](spark, str(tmp_path)).collect()
    assert len(got) == 1260 and {r["doc_id"]: r["blind"] for r in got} == want
    whole = R.blind_keys(spark.read.parquet(f"{tmp_path}/labels.parquet").filter("toxic = 1"), "doc_id", "3")
    assert len({r["blind"] for r in whole.collect()}) == 1260
