"""Each query with SQL beside it, against DuckDB on the smallest tables."""

import glob
import os

import pytest

FOLDER = "/root/testdata/sf0.001"
import __spark_entry__ as entry  # noqa: E402

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def tables():
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def tidy(rows):
    return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_sql_agrees(spark, tables, name):
    df = entry.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    found = tables.execute(entry.oracle_sql()[name])
    at = [d[0] for d in found.description]
    assert sorted(at) == columns
    want = [tuple(r[at.index(c)] for c in columns) for r in found.fetchall()]
    assert tidy(df.select(*(f"`{c}`" for c in columns)).collect()) == tidy(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["bpe_vocabulary", "pack_bestfit", "letter_questions", "fewshot_exact", "seeded_split", "row_group_scan", "file_split", "sampled_tokens"])
def test_others_run(spark, name):
    assert entry.queries()[name](spark, FOLDER).count() > 0


def test_row_group_scan_reads_every_group(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    pq.write_table(pa.table({"doc_id": list(range(50)), "text": ["x" * k for k in range(50)]}), tmp_path / "documents.parquet", row_group_size=10)
    rows = entry.queries()["row_group_scan"](spark, str(tmp_path)).collect()
    assert sorted(r.rg_idx for r in rows) == [0, 1, 2, 3, 4] and sum(r.n for r in rows) == 50 and sum(r.chars for r in rows) == 1225


def test_bpe_vocabulary_has_the_default_size(spark, tmp_path):
    import random

    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(1200)]
    spark.createDataFrame([(0, " ".join(words))], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    assert entry.queries()["bpe_vocabulary"](spark, str(tmp_path)).count() > 1000
