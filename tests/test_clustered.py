"""Search in cells: the rows of a search over everything, from a part of the store."""

import numpy as np
import pytest

from lumenweft.operators import search
from lumenweft.plans import clustered


def rows_around(rng, centres, n, noise, width=12):
    middles = rng.normal(size=(centres, width))
    out = middles[rng.integers(0, centres, n)] + noise * rng.normal(size=(n, width))
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def ids(df):
    return [(r.vec_id, round(r.vector_similarity, 9)) for r in df.collect()]


@pytest.fixture(scope="module")
def cells(spark, tmp_path_factory):
    vectors = rows_around(np.random.default_rng(3), 25, 3000, 0.08)
    vectors[7] = vectors[2900] = vectors[1500]  # ties
    store = spark.createDataFrame([(k, v.tolist(), f"t{k}") for k, v in enumerate(vectors)], "vec_id long, embedding array<double>, title string")
    path = str(tmp_path_factory.mktemp("cells"))
    version = clustered.build_cells(store, path, cells=25)
    return store, path, version, vectors


def test_as_over_everything(spark, cells):
    store, path, version, vectors = cells
    assert version["n"] == sum(c["n"] for c in version["cells"]) == 3000
    rng = np.random.default_rng(4)
    asked = [vectors[1500], vectors[10] + 0.02 * rng.normal(size=12), rng.normal(size=12), -vectors[5] * 7]
    for k, q in zip((5, 3, 40, 1), asked, strict=True):
        q = q.tolist()
        got = clustered.vector_top_k(spark, path, q, k)
        assert ids(got) == ids(search.vector_top_k(store, q, k))
        assert got.columns == [*store.columns, "vector_similarity"]


def test_little_is_read_where_rows_gather(spark, cells):
    _, path, _, vectors = cells
    shares = [clustered.share_read(spark, path, vectors[k].tolist(), 5) for k in (1, 40, 1500)]
    assert max(shares) < 0.3
    q = vectors[1].tolist()
    plan = clustered.vector_top_k(spark, path, q, 5)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "cell" in plan.split("PartitionFilters: [")[1][:60]


def test_more_than_there_are_and_bad_stores(spark, cells, tmp_path):
    store, path, _, vectors = cells
    assert clustered.vector_top_k(spark, path, vectors[0].tolist(), 5000).count() == 3000
    with pytest.raises(ValueError):
        clustered.vector_top_k(spark, path, [1.0], 5)
    with pytest.raises(ValueError):
        clustered.vector_top_k(spark, f"{tmp_path}/none", [1.0], 5)
    for bad in ([], [(1, [float("nan")])], [(1, [1.0]), (2, [1.0, 2.0])], [(1, None)]):
        with pytest.raises(ValueError):
            clustered.build_cells(spark.createDataFrame(bad, "vec_id long, embedding array<double>"), f"{tmp_path}/b")
    one = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    for _ in range(2):
        clustered.build_cells(one, f"{tmp_path}/one")
    assert [r.vec_id for r in clustered.vector_top_k(spark, f"{tmp_path}/one", [1.0, 1.0], 1).collect()] == [1]
    assert clustered.forget(spark, f"{tmp_path}/one") == 1
