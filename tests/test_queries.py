"""Every query of the plans runs on the smallest tables and equals its SQL where it has one."""

from pathlib import Path

import duckdb
import pytest

from pricewren.plans import catalog, queries, records, staging, stores

QUERIES, SQL = queries.QUERIES | catalog.QUERIES | stores.QUERIES | records.QUERIES | staging.QUERIES, queries.SQL | catalog.SQL | stores.SQL | records.SQL | staging.SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(f"{r[i]:.9g}" if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows))


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the driver's tables")
def test_word_similarity_ranks_partial_matches(spark):
    got = QUERIES["word_similarity"](spark, SF).collect()
    assert len({(r["word"], r["name"]) for r in got}) == len(got)
    assert all(0.3 <= r["ws"] <= r["best"] <= 1 for r in got)
    assert any(r["ws"] < 1 for r in got)


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = df.collect()
    if name in SQL:
        want = duck.execute(SQL[name])
        names = [d[0] for d in want.description]
        assert sorted(names) == sorted(df.columns)
        assert plain(df.columns, got) == plain(names, want.fetchall())
    else:
        assert got
