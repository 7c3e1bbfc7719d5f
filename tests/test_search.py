import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenweft.functions import vectors as V
from lumenweft.operators import build, search
from lumenweft.plans import retrieval

STORE = [(1, [1.0, 0.0], "a"), (2, [0.8, 0.6], "b"), (3, [-1.0, 0.0], "c")]


@pytest.fixture(scope="module")
def store(spark):
    return spark.createDataFrame(STORE, "vec_id long, embedding array<float>, title string")


def test_top_k_order_and_clip(store):
    rows = search.vector_top_k(store, [1.0, 0.0], 2).collect()
    assert [r.vec_id for r in rows] == [1, 2] and rows[0].vector_similarity == 1.0
    assert search.vector_top_k(store, [1.0, 0.0], 9).count() == 3


def test_top_k_plan_is_one_scan_and_a_merge(spark, sf):
    from lumenweft.queries import queries

    plan = queries()["vector_topk"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Join" not in plan


def test_ties_by_id(spark):
    df = spark.createDataFrame([(k, [1.0, 0.0]) for k in (5, 3, 9)], "vec_id long, embedding array<float>")
    assert [r.vec_id for r in search.vector_top_k(df, [1.0, 0.0], 2).collect()] == [3, 5]


@pytest.mark.parametrize(("prompt", "k"), [("", 5), ("  ", 5), ("x" * 4001, 5), ("a", 0), ("a", True), (None, 5)])
def test_guards(prompt, k):
    with pytest.raises(ValueError):
        search.check_search(prompt, k)


def test_query_is_canonical():
    assert search.check_search("  a b\n c ", 1) == "a b c"


def test_batch_equals_single(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    got = search.vector_top_k_batch(e, e.where("vec_id in (3, 4)").select(F.col("vec_id").alias("query_id"), "embedding"), 4).collect()
    for q in (3, 4):
        vector = [float(x) for x in e.where(F.col("vec_id") == q).first().embedding]
        assert [r.id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == [r.vec_id for r in search.vector_top_k(e, vector, 4).collect()]


def test_batch_with_odd_queries_and_rows(spark):
    """Null, invalid, ragged and repeated queries, invalid rows of the store, and many parts on both sides."""
    rows = [(k, [float((k * 7) % 11 - 5), float((k * 3) % 7 - 3), 1.0]) for k in range(60)] + [(100, None), (101, [1.0]), (102, [float("nan"), 1.0, 1.0]), (103, [0.0, 0.0, 0.0])]
    store = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    asked = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, None), (3, [1.0, 0.0]), (4, [0.0, -1.0, 0.5]), (4, [0.0, -1.0, 0.5]), (5, [float("nan"), 0.0, 0.0]), (None, [1.0, 0.0, 0.0])], "query_id long, embedding array<float>")
    whole = sorted(search.vector_top_k_batch(store, asked, 3).collect())
    assert {r.query_id for r in whole} == {1, 4} and len(whole) == 6
    for q, v in ((1, [1.0, 0.0, 0.0]), (4, [0.0, -1.0, 0.5])):
        assert [r.id for r in whole if r.query_id == q] == [r.vec_id for r in search.vector_top_k(store.where("vec_id < 100"), v, 3).collect()]
    bytes_, search.QUERY_BYTES = search.QUERY_BYTES, 24
    try:
        assert sorted(search.vector_top_k_batch(store, asked, 3, store_parts=5).collect()) == whole
    finally:
        search.QUERY_BYTES = bytes_
    assert search.vector_top_k_batch(store.where("vec_id = 100"), asked).count() == 0


def test_batch_without_queries(store):
    assert search.vector_top_k_batch(store, store.where("false").select(F.col("vec_id").alias("query_id"), "embedding")).count() == 0


def test_lexical_empty_query_and_zero_scores(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "gamma"), (3, None)], "id long, title string")
    tokens = search.story_tokens(F.coalesce("title", F.lit("")))
    assert search.lexical_top_k(docs, "the and", 5, "id", tokens).count() == 0
    rows = search.lexical_top_k(docs, "alpha", 5, "id", tokens).collect()
    assert len(rows) == 3 and rows[0].id == 1 and rows[1].score == rows[2].score == 0


def test_search_stories_falls_back_to_terms(spark):
    docs = spark.createDataFrame([("a", "Storm", "a dark storm"), ("b", "Sun", "a bright day")], "record_id string, title string, summary string")
    assert retrieval.search_stories(docs, "storm", 1).first().record_id == "a"


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.floats(-5, 5, width=32), min_size=3, max_size=3), min_size=1, max_size=6))
def test_cosine_and_unit(spark, vectors):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(vectors)], "id long, v array<float>")
    for r in df.select("v", V.cosine(F.col("v"), F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0))).alias("c"), V.valid(F.col("v")).alias("ok"), V.unit(V.normalized(F.col("v"))).alias("u")).collect():
        assert -1.0000001 <= r.c <= 1.0000001
        if r.ok and sum(x * x for x in r.v) > 1e-20:
            assert r.u


def test_import_normalizes_and_rejects(spark):
    good = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 5.0])], "id long, v array<double>")
    assert [[round(x, 6) for x in r.v] for r in build.import_vectors(good, "id", "v").orderBy("id").collect()] == [[0.6, 0.8], [0.0, 1.0]]
    for bad in ([(1, [0.0, 0.0])], [(1, [1.0]), (2, [1.0, 2.0])], [(1, [1.0]), (1, [1.0])], [(1, [float("nan")])], [(1, None)]):
        with pytest.raises(ValueError):
            build.import_vectors(spark.createDataFrame(bad, "id long, v array<double>"), "id", "v")


def test_best_of_cuts_ties_by_id():
    import numpy as np

    rng = np.random.default_rng(4)
    for k in (1, 3, 7):
        ids, scores = rng.permuted(np.tile(np.arange(9), (20, 1)), axis=1), rng.integers(0, 3, (20, 9)).astype(float)
        got, _ = search.best_of(ids, scores, k)
        for row in range(20):
            assert got[row].tolist() == [i for _, i in sorted(zip(-scores[row], ids[row], strict=True))][:k]
