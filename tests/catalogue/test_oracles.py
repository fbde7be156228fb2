"""Every catalogue query against its SQL text in DuckDB."""

import duckdb
import pytest

from tramline.plans import queries as catalogue
from tramline.plans.views import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _plain(value):
    return round(value, 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_oracle(spark, duck, name):
    found = catalogue.QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    got = sorted((tuple(_plain(r[c]) for c in columns) for r in found.collect()), key=repr)
    result = duck.execute(catalogue.ORACLES[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    assert got == sorted((tuple(_plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=repr)
    # a week of a thousand events may hold no repeat inside a cooldown, but nearly every query has rows here
    assert got or name in ("recent_users", "similarity_rank")
