"""Every registered query against its SQL twin on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from evidentia import plans

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        p = Path(DATA, f"{t}.parquet")
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 5)
    return v


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_twin(spark, duck, name):
    df = plans.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    out = duck.execute(plans.oracle_sql()[name])
    names = [x[0] for x in out.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(dict(zip(names, r, strict=True))[c]) for c in cols) for r in out.fetchall()), key=repr)
    assert got == want
    assert got


def test_every_query_has_a_twin():
    assert set(plans.queries()) == set(plans.oracle_sql())
