import os

import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test data here")
CORE = [n for n in entry.queries() if entry.queries()[n].__module__.startswith("basinweave.plans")]


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", CORE)
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    df = entry.queries()[name](spark, SMALL)
    rows = df.collect()
    assert len(set(df.columns)) == len(df.columns)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return
    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.execute(f"create view {f[:-8]} as select * from '{SMALL}/{f}'")
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    norm = lambda v: f"{v:.6g}" if isinstance(v, float) else str(v)
    cols = sorted(names)
    want = sorted(tuple(norm(r[names.index(c)]) for c in cols) for r in cur.fetchall())
    assert sorted(tuple(norm(r[c]) for c in cols) for r in rows) == want


def test_the_library_does_not_import_the_llm_subpackage():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for folder, _, files in os.walk(os.path.join(root, "basinweave")):
        if os.path.basename(folder) == "llm":
            continue
        for f in files:
            if f.endswith(".py"):
                with open(os.path.join(folder, f)) as text:
                    assert "basinweave.llm" not in text.read(), f


def test_scans_are_pruned(spark):
    plan = entry.queries()["g_stats"](spark, SMALL)._jdf.queryExecution().toString()
    assert "attributes" not in plan.partition("== Physical Plan ==")[2]
