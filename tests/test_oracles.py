"""Every query with SQL against DuckDB on the same tables, as the driver compares them."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        c.execute(f"create view {t} as select * from read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return c


def rows(names, data):
    at = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(str(tuple(int(r[i]) if isinstance(r[i], bool) else float(r[i]) if hasattr(r[i], "as_integer_ratio") and not isinstance(r[i], int) else r[i] for i in at)) for r in data)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, duck, sf, name):
    df = entry.queries()[name](spark, sf)
    want = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    got, expected = rows(df.columns, [tuple(r) for r in df.collect()]), rows(names, want.fetchall())
    assert len(got) == len(expected) and got == expected
    assert got or name in ("validator_report", "error_anatomy", "batches", "batch_masks")


PLAIN = ["transliterate", "edit_ratios", "training_triplets", "cross_fit_oof", "isotonic", "combiner", "bootstrap_delta"]


@pytest.mark.parametrize("name", PLAIN)
def test_other_queries_run(spark, sf, name):
    assert entry.queries()[name](spark, sf).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
