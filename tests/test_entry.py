"""The driver's contract."""

import duckdb
import pytest

import __spark_entry__ as contract

DATA = "/root/testdata/sf0.001"
FAST = ["c3_detokenize", "c8_encode_scribe", "j3_greedy_match", "p3_resample", "a1_micro_metrics", "ext_asof"]


def test_names():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("name", FAST)
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    import glob
    import os

    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    df = contract.queries()[name](spark, DATA)
    cur = con.execute(contract.oracle_sql()[name])
    columns = [c[0] for c in cur.description]
    norm = lambda v: round(v, 6) if isinstance(v, float) else v
    want = sorted([tuple(norm(dict(zip(columns, r))[c]) for c in sorted(columns)) for r in cur.fetchall()], key=repr)
    got = sorted([tuple(norm(r[c]) for c in sorted(df.columns)) for r in df.collect()], key=repr)
    assert sorted(columns) == sorted(df.columns) and got == want
