"""Every registered query against its SQL on the small tables."""

import duckdb
import pytest

from kinstrand import queries

SLOW: set[str] = set()


@pytest.fixture(scope="module")
def engine(sf_dir):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_equals_sql(spark, sf_dir, engine, name):
    got = queries.QUERIES[name](spark, sf_dir)
    columns = sorted(got.columns)
    want = engine.sql(queries.ORACLE_SQL[name])
    assert columns == sorted(want.columns)
    a = sorted(map(str, (tuple(r[c] for c in columns) for r in got.collect())))
    b = sorted(map(str, want.select(*(f'"{c}"' for c in columns)).fetchall()))
    assert a == b and a


def test_clusters_of_a_long_path(spark):
    from kinstrand.plans.graph import connected_components

    edges = [(k, k + 1) for k in range(200)] + [(500, 500), (300, 301), (301, 300), (None, 4)]
    got = {r["vertex"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {k: 0 for k in range(201)} | {500: 500, 300: 300, 301: 300}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


@pytest.mark.parametrize("name", ["filter_with_reads", "links_with_reads"])
def test_reads_beyond_the_relation_of_chromosomes(spark, sf_dir, tmp_path, name):
    """Larger tables have reads at places beyond 1,300,000; keys are shifted so that all of them lie there."""
    shifts = {"orders": {"o_orderkey": 200_000}, "events": {"event_id": 140_000}, "lineitem": {"l_partkey": 28_000}, "region": {}}
    con = duckdb.connect()
    for t, by in shifts.items():
        moved = ", ".join(f"{k} + {n} AS {k}" for k, n in by.items())
        con.sql(f"COPY (SELECT *{f' REPLACE ({moved})' if by else ''} FROM '{sf_dir}/{t}.parquet') TO '{tmp_path}/{t}.parquet'")
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    got = queries.QUERIES[name](spark, str(tmp_path))
    want = con.sql(queries.ORACLE_SQL[name])
    a = sorted(map(str, (tuple(r[c] for c in want.columns) for r in got.collect())))
    assert a == sorted(map(str, want.fetchall())) and a
