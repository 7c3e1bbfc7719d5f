from pyspark.sql import functions as F

from lumenweft.operators import search
from lumenweft.streaming import prompts


def test_search_stream(spark, sf, tmp_path):
    store = spark.read.parquet(f"{sf}/embeddings.parquet")
    asked = store.where("vec_id < 3").select(F.col("vec_id").alias("query_id"), "embedding")
    asked.write.parquet(f"{tmp_path}/in")
    out = []
    stream = spark.readStream.schema(asked.schema).parquet(f"{tmp_path}/in")
    prompts.search_stream(stream, store, lambda df, n: out.extend(df.collect()), f"{tmp_path}/check", 2).awaitTermination(60)
    assert sorted(out) == sorted(search.vector_top_k_batch(store, asked, 2).collect())


def test_upsert_stream_stores_once(spark, tmp_path):
    for k, rows in enumerate([[("a", 1), ("b", 2), ("a", 3)], [("b", 9), ("c", 4)]]):
        spark.createDataFrame(rows, "hash string, n long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("hash string, n long").parquet(f"{tmp_path}/in")
        prompts.upsert_stream(stream, f"{tmp_path}/store", f"{tmp_path}/check").awaitTermination(60)
        assert spark.read.parquet(f"{tmp_path}/store").groupBy("hash").count().where("count > 1").count() == 0
    assert {r.hash for r in spark.read.parquet(f"{tmp_path}/store").collect()} == {"a", "b", "c"}
