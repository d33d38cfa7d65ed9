"""Each registered query against its SQL, value by value."""

import math

import duckdb
import pytest

from ledgerloom.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module", params=["/root/testdata/sf0.001"])
def both(request):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{request.param}/{t}.parquet')")
    return request.param, con


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(v[i] for i in order) for v in values), key=str)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_against_sql(spark, both, name):
    folder, con = both
    out = catalog.QUERIES[name](spark, folder)
    rel = con.execute(catalog.ORACLES[name])
    columns = [c[0] for c in rel.description]
    assert sorted(columns) == sorted(out.columns)
    want, got = rows(columns, rel.fetchall()), rows(out.columns, map(tuple, out.collect()))
    assert len(want) == len(got)
    for a, b in zip(want, got):
        for x, y in zip(a, b):
            assert x == y or isinstance(x, float) and math.isclose(x, y, rel_tol=1e-9), (a, b)
