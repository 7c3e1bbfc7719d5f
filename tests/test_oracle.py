"""Every keyed query of the core against its DuckDB twin, on the smallest tables."""

import duckdb
import pytest

from lumenweft.queries import oracle_sql, queries

TABLES = "documents embeddings pages benchmark labels conversations".split()


def rounded(value):
    return round(value, 9) + 0.0 if isinstance(value, float) else value


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_rows(spark, sf, duck, name):
    df = queries()[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted((tuple(rounded(r[c]) for c in columns) for r in df.collect()), key=repr)
    relation = duck.sql(oracle_sql()[name])
    assert sorted(relation.columns) == columns
    places = [relation.columns.index(c) for c in columns]
    assert got == sorted((tuple(rounded(r[i]) for i in places) for r in relation.fetchall()), key=repr)


def test_every_key_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    import __spark_entry__

    assert [r.vec_id for r in __spark_entry__.entry(spark).collect()][0] == 0


def test_transcripts_are_bounded_in_characters(spark, tmp_path):
    texts = ["é" * 200, "é" * 201, "词 " * 90, "a" * 200, "a" * 201, " two\n\tblanks  ", "\U0001f600" * 200]
    rows = [(5 * k + 1, t) for k, t in enumerate(texts)] + [(5, "silent"), (10, "é" * 150)]
    spark.createDataFrame(rows, "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    got = queries()["voice_transcripts"](spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.sql(f"create view benchmark as select * from '{tmp_path}/benchmark.parquet/*.parquet'")
    assert {(r.item_id, r.transcript) for r in got} == set(con.sql(oracle_sql()["voice_transcripts"]).fetchall())
