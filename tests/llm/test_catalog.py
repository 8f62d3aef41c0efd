import pytest

from kinfold.llm.catalog import ORACLES, QUERIES
from tests.test_oracles import TABLES, rows


@pytest.mark.parametrize("name", sorted(ORACLES))
@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, name, size):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('/root/testdata/{size}/{t}.parquet')")
    want = c.execute(ORACLES[name])
    df = QUERIES[name](spark, f"/root/testdata/{size}")
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, want.fetchall())


def test_one_query_for_each_operator():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 11))
