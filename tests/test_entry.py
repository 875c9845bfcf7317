"""The driver contract: every query runs on the smallest tables, and those with SQL agree with it."""

import duckdb
import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def base():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(q for q in entry.queries() if not q.startswith(("op", "pipeline"))))
def test_query(spark, base, name):
    got = entry.queries()[name](spark, DIR)
    rows = got.collect()
    if name not in entry.oracle_sql():
        return
    expected = base.execute(entry.oracle_sql()[name])
    names = [d[0] for d in expected.description]
    assert sorted(names) == sorted(got.columns)
    key = lambda row: tuple(str(row[n]) for n in sorted(names))
    assert sorted(key(r.asDict()) for r in rows) == sorted(key(dict(zip(names, r, strict=True))) for r in expected.fetchall())
