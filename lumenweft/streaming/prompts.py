"""Prompts as a stream against a static store, and posts as a stream into a deduplicated store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lumenweft.operators import search


def search_stream(prompts: DataFrame, store: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, k: int = 5) -> StreamingQuery:
    """The k best rows of ``store`` for each vector of a stream (query_id, embedding), given to ``sink`` batch by batch.

    The store is scanned once a batch. With the checkpoint a batch is given again after a failure, under the same number.
    """

    def answer(batch: DataFrame, number: int) -> None:
        sink(search.vector_top_k_batch(store, batch, k), number)

    return prompts.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert_stream(records: DataFrame, store_path: str, checkpoint: str, key: str = "hash") -> StreamingQuery:
    """Appends the records of a stream whose ``key`` the store does not have yet, once each; null is a key.

    The keys seen are the stream's state, kept with the checkpoint and dealt over the tasks, so a batch reads nothing of the
    store, however large that is. The store is partitioned by batch, and a batch that runs again replaces its own part, so
    nothing is stored twice. A store belongs to one checkpoint; many keys want the RocksDB state store, which is on disk.
    """

    def add(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{store_path}/batch={number}")

    fresh = records.dropDuplicates([key])
    return fresh.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
