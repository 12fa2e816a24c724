"""Every query of the catalogue against its SQL on the smallest tables."""

from collections import Counter

import duckdb
import pytest

from foliant.plans import catalogue
from tests.models import MODELS

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def flat(x):
    if isinstance(x, float):
        return repr(round(x, 6) + 0.0)
    return str(x)


@pytest.mark.parametrize("name", catalogue.queries())
def test_query(spark, sql, name):
    done = catalogue.queries()[name](spark, SF)
    columns = sorted(done.columns)
    got = sorted(tuple(map(flat, r)) for r in done.select(*[f"`{c}`" for c in columns]).collect())
    if name not in catalogue.oracle_sql():
        names, want = MODELS[name](SF)  # a query has SQL or a model
        assert sorted(names) == columns
        rows = [tuple(r) for r in done.select(*names).collect()]
        assert want(rows) if callable(want) else Counter(rows) == want
        return
    r = sql.execute(catalogue.oracle_sql()[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(flat(row[names.index(c)]) for c in columns) for row in r.fetchall())


def test_flagship(spark):
    assert catalogue.flagship(spark, SF).count() > 0
