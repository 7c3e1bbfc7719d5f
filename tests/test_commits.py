"""Versions under contention: of two who write at once, neither is lost."""

import threading

import pytest
from pyspark.sql import functions as F

from lumenweft.plans import store, stories
from lumenweft.sources import commits


def together(n, work):
    """Runs ``work(k)`` in n threads that start at once; what each raised."""
    start, raised = threading.Barrier(n), []

    def run(k):
        start.wait()
        try:
            work(k)
        except Exception as why:
            raised.append(why)

    threads = [threading.Thread(target=run, args=(k,)) for k in range(n)]
    for t in threads:
        t.start()
    for t in threads:
        t.join(120)
    return raised


def test_one_version_one_writer(spark, tmp_path):
    won = []
    assert together(8, lambda k: won.append((k, commits.commit(spark, f"{tmp_path}/log", 1, {"by": k})))) == []
    (first,) = [k for k, made in won if made]
    assert commits.latest(spark, f"{tmp_path}/log") == (1, {"by": first})
    assert [p.name for p in (tmp_path / "log").iterdir() if not p.name.endswith(".crc")] == ["00000000000000000001.json"]


def test_no_update_is_lost(spark, tmp_path):
    add = lambda k: commits.transact(spark, f"{tmp_path}/log", lambda n, before: {"n": n, "all": [*(before or {"all": []})["all"], k]})
    assert together(6, add) == []
    number, last = commits.latest(spark, f"{tmp_path}/log")
    assert number == 6 and sorted(last["all"]) == list(range(6))
    assert [commits.read(spark, f"{tmp_path}/log", n)["n"] for n in commits.numbers(spark, f"{tmp_path}/log")] == [1, 2, 3, 4, 5, 6]


def test_a_change_that_fails_leaves_nothing(spark, tmp_path):
    def fail(number, before):
        raise KeyError("no")

    with pytest.raises(KeyError):
        commits.transact(spark, f"{tmp_path}/log", fail)
    assert commits.latest(spark, f"{tmp_path}/log") == (0, None)


def test_writers_who_never_win_say_so(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(commits, "TRIES", 2)
    monkeypatch.setattr(commits, "commit", lambda *_: False)
    with pytest.raises(commits.Contended):
        commits.transact(spark, f"{tmp_path}/log", lambda n, before: {})
    df = spark.createDataFrame([("a", [1.0, 0.0])], "record_id string, embedding array<float>")
    with pytest.raises(commits.Contended):
        store.write_store(df, f"{tmp_path}/s", "m", "f")
    assert [p.name for p in (tmp_path / "s").iterdir() if p.name.startswith("rows")] == []


def test_two_publishers_make_two_versions(spark, tmp_path):
    path = f"{tmp_path}/s"
    frames = [spark.createDataFrame([(f"{k}-{j}", [0.6, 0.8]) for j in range(k + 1)], "record_id string, embedding array<float>") for k in range(2)]
    assert together(2, lambda k: store.write_store(frames[k], path, "m", f"f{k}")) == []
    assert commits.numbers(spark, f"{path}/_log") == [1, 2]
    assert {commits.read(spark, f"{path}/_log", n)["fingerprint"] for n in (1, 2)} == {"f0", "f1"}
    rows, meta = store.load_store(spark, path)
    assert rows.count() == meta["n"] and meta["fingerprint"] in ("f0", "f1") and meta["bytes"] > 0 and meta["least"].endswith("-0")
    assert store.forget(spark, path) == 1 and store.load_store(spark, path)[1] == meta


def test_concurrent_updates_build_on_each_other(spark, tmp_path):
    path = f"{tmp_path}/s"

    def add(k):
        own = spark.createDataFrame([(f"r{k}", [0.6, 0.8])], "record_id string, embedding array<float>")
        store.update_store(spark, path, lambda before: own if before is None else before.union(own), "m", "f")

    assert together(4, add) == []
    rows, meta = store.load_store(spark, path)
    assert sorted(r.record_id for r in rows.collect()) == ["r0", "r1", "r2", "r3"] and meta["number"] == 4
    named = {commits.read(spark, f"{path}/_log", n)["rows"].rsplit("/", 1)[-1] for n in commits.numbers(spark, f"{path}/_log")}
    assert {p.name for p in (tmp_path / "s").iterdir() if p.name.startswith("rows")} == named  # what was made in vain is gone


def test_checkpoint_is_compacted(spark, tmp_path):
    path, columns = f"{tmp_path}/s", "hash string, ordinal long, feature_model string, cache_version int, keywords array<string>"
    for k in range(5):
        spark.createDataFrame([(f"h{j}", k, "m", 1, [str(k)]) for j in range(k + 1)], columns).coalesce(1).write.mode("append").parquet(f"{path}/checkpoint")
    assert stories.compact_checkpoint(spark, path) == 5
    table = spark.read.parquet(f"{path}/checkpoint")
    assert len(table.inputFiles()) == 1
    assert {(r.hash, r.ordinal) for r in table.collect()} == {(f"h{j}", 4) for j in range(5)}
    assert stories.compact_checkpoint(spark, f"{tmp_path}/none") == 0


def test_a_row_of_no_number_is_never_found(spark):
    from lumenweft.operators import search

    rows = spark.createDataFrame([(1, [float("nan"), 1.0]), (2, [0.6, 0.8]), (3, None), (4, [float("inf"), 0.0]), (5, [1.0, 0.0]), (6, [0.0, 0.0])], "vec_id long, embedding array<float>")
    assert [r.vec_id for r in search.vector_top_k(rows, [1.0, 0.0], 5).collect()] == [5, 2]
    assert rows.where(F.col("vec_id") == 1).count() == 1
