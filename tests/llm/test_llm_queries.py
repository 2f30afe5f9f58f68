"""The pN_ queries with SQL beside them, against DuckDB on the smallest tables."""

import glob
import os

import pytest

from textmill.llm import oracle, queries

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.mark.parametrize("name", sorted(oracle.ORACLES))
def test_sql_agrees(spark, name):
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    df = queries.QUERIES[name](spark, FOLDER)
    found = con.execute(oracle.ORACLES[name])
    at = [d[0] for d in found.description]
    assert sorted(at) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*at).collect())) == sorted(found.fetchall())


@pytest.mark.parametrize("name", ["p4_found", "p8_found", "p7_shares", "p3_report", "p5_report"])
def test_others_run(spark, name):
    df = queries.QUERIES[name](spark, FOLDER)
    df.collect()
    wanted = {"p4_found": ["conv_id", "turn", "defect"], "p8_found": ["doc_id"]}
    assert df.columns == wanted.get(name, df.columns)
