import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
LLM = {f"p{n}_" for n in (1, 2, 4, 5, 6, 7, 8, 9)}
CORE = sorted(q for q in entry.queries() if not any(q.startswith(p) for p in LLM))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", CORE)
def test_query_against_sql(spark, name):
    df = entry.queries()[name](spark, DATA)
    rows = df.collect()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    r = con.execute(sql)
    names = [d[0] for d in r.description]
    assert sorted(names) == sorted(df.columns)
    key = lambda row: [str(round(x, 5) if isinstance(x, float) else x) for x in row]
    assert sorted(key(x[c] for c in sorted(names)) for x in rows) == sorted(key(v for _, v in sorted(zip(names, x), key=lambda t: t[0])) for x in r.fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns == ["repo", "snapshot_no", "path", "change_kind"]
