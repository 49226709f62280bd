"""Every registered query of the reference's operators against its SQL, on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from streamloom.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def value(x):
        if x is None or isinstance(x, (str, bool)):
            return str(x)
        return repr(round(float(x), 6) + 0.0)

    return sorted(tuple(value(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows(spark, sf_dir, db, name):
    df = registry.queries()[name](spark, sf_dir)
    found = db.sql(registry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(found.columns)
    assert plain([tuple(r) for r in df.collect()], df.columns) == plain(found.fetchall(), found.columns)
