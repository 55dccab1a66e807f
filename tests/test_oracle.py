"""Every registered query of the engine against its DuckDB SQL."""

import duckdb
import pytest

from tidemill.registry import oracle_sql, queries

DATA = "/root/testdata"
LATE = {"late_events", "zone_features", "partition_stats"}  # the smallest table has no late event


def rows(data):
    return sorted(tuple("%.9g" % v if isinstance(v, float) else str(v) for v in r) for r in data)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, name):
    d = f"{DATA}/sf0.01" if name in LATE else f"{DATA}/sf0.001"
    df = queries()[name](spark, d)
    columns = sorted(df.columns)
    con = duckdb.connect()
    for t in ("events", "nation"):
        con.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    found = con.execute(oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    want = [tuple(r[names.index(c)] for c in columns) for r in found.fetchall()]
    got = df.select(*columns).collect()
    assert rows(got) == rows(want)


def test_queries_without_sql_have_rows(spark):
    for name in set(queries()) - set(oracle_sql()):
        assert queries()[name](spark, f"{DATA}/sf0.001").count() > 0


def test_known_row_counts(spark):
    q = queries()["zone_features"]
    assert q(spark, f"{DATA}/sf0.001").count() == 10_528
    assert q(spark, f"{DATA}/sf0.01").count() == 106_082
