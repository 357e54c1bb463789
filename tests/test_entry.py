import importlib.util

import duckdb
import pytest

import __spark_entry__ as entry

QUICK = ["bm25_topk", "p4_found", "p4_ledger", "sync_pending", "idle_islands", "repeated_lines", "ols_fit"]


def test_contract(spark):
    q = entry.queries()
    assert set(entry.oracle_sql()) <= set(q)
    assert entry.entry(spark).count() > 0
    if importlib.util.find_spec("codexmill.llm") is None:
        assert not any(n.startswith(("p1_", "p2_", "p3_")) for n in q)


@pytest.mark.parametrize("name", QUICK)
def test_against_sql(spark, data, name):
    con = duckdb.connect()
    for t in ("documents", "eval_items", "listings", "runs", "books", "chunks", "events", "lineitem"):
        con.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    rel = con.sql(entry.oracle_sql()[name])
    df = entry.queries()[name](spark, data)
    cols = sorted(df.columns)
    assert sorted(rel.columns) == cols
    cut = lambda v: round(v, 5) if isinstance(v, float) else v
    want = sorted(repr([cut(dict(zip(rel.columns, r, strict=True))[c]) for c in cols]) for r in rel.fetchall())
    assert sorted(repr([cut(r[c]) for c in cols]) for r in df.collect()) == want
