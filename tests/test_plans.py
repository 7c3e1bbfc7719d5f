"""Stores on disk and requests that a model answers."""

import json

import pytest
from pyspark.sql import functions as F

from lumenweft import fixed, session
from lumenweft.functions import text as T
from lumenweft.operators import build
from lumenweft.plans import assistant, audio, store, stories
from lumenweft.sources import settings

ROWS = [("a", [1.0, 0.0]), ("b", [0.6, 0.8])]


def test_store_round_trip(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "record_id string, embedding array<float>")
    store.write_store(df, f"{tmp_path}/s", "stub", "f")
    rows, meta = store.load_store(spark, f"{tmp_path}/s")
    assert rows.count() == 2 and meta["model"] == "stub" and meta["width"] == 2
    with pytest.raises(ValueError):
        store.write_store(df.union(df), f"{tmp_path}/s", "stub", "g")
    assert store.load_store(spark, f"{tmp_path}/s")[1] == meta  # what failed was not published
    again = store.write_store(df.limit(1), f"{tmp_path}/s", "stub", "g")
    assert rows.count() == 2 and store.load_store(spark, f"{tmp_path}/s")[0].count() == 1  # the old rows are still there
    assert store.forget(spark, f"{tmp_path}/s") == 1 and store.load_store(spark, f"{tmp_path}/s")[1] == again
    df.write.mode("overwrite").parquet(again["rows"])
    with pytest.raises(ValueError):
        store.load_store(spark, f"{tmp_path}/s")


def test_store_without_metadata_is_normalized(spark, tmp_path):
    spark.createDataFrame([("a", [3.0, 4.0])], "record_id string, embedding array<double>").write.parquet(f"{tmp_path}/old")
    rows, meta = store.load_store(spark, f"{tmp_path}/old")
    assert [round(x, 6) for x in rows.first().embedding] == [0.6, 0.8] and meta["version"] == 0


def test_intent(spark):
    good = lambda text: '```json\n{"intent": "x", "keywords": ["Sea", "Sky", "sun"], "query": "q"}\n```'

    def gone(text):
        raise assistant.Unavailable

    assert assistant.check_intent(spark, "hi", good)["keywords"] == ["sea", "sky", "sun"]
    assert assistant.check_intent(spark, "Dark sea", gone)["keywords"] == ["dark", "sea", "mood"]
    with pytest.raises(ValueError):
        assistant.check_intent(spark, " ", good)
    with pytest.raises(ValueError):
        assistant.check_intent(spark, "x", lambda text: "no json")


def test_recommendation(spark):
    c = spark.createDataFrame([(1, "r1", "One", ["a"], "http://a", None)], "position long, record_id string, title string, keywords array<string>, audio_url string, audio_zip_url string")
    answer = lambda **x: lambda prompt: json.dumps({"recommended_record_id": "r1", "pitch_script": "p", "emotional_match_reasons": ["r"]} | x)
    assert assistant.recommendation(c, "quiet", answer()).first().recommended_book_title == "One"
    for bad in (answer(recommended_record_id="r2"), answer(pitch_script=""), answer(emotional_match_reasons=[" "]), answer(emotional_match_reasons=None)):
        with pytest.raises(ValueError):
            assistant.recommendation(c, "quiet", bad).collect()

    def gone(prompt):
        raise assistant.Unavailable

    assert assistant.recommendation(c, "quiet", gone).first().audio_url == "http://a"


def test_features_and_payload(spark):
    full = {a: 0.5 for a in fixed.AXES}

    def generate(summary):
        if summary == "bad":
            return "{}"
        return json.dumps({"rich_descriptive_paragraph": " p ", "keywords": ["A", "b", "c", "d", "e"], "emotional_scores": full})

    df = spark.createDataFrame([(0, "x", None, "T", "good"), (1, None, None, " ", "bad"), (2, None, None, None, None)], "ordinal long, record_id string, cmu_id string, title string, summary string")
    rows = {r.ordinal: r for r in assistant.extract_features(df, generate).collect()}
    assert rows[0].error is None and rows[0].keywords[0] == "a" and rows[1].error.startswith("ValueError") and rows[2].error == "no summary"
    done = {r.ordinal: r for r in assistant.processed(assistant.extract_features(df.where("ordinal < 1"), generate)).collect()}
    assert done[0].record_id == "x" and done[0].search_payload == "Title: T | Atmosphere: a, b, c, d, e | Summary: p"


def test_canonical_column(spark):
    texts = ["é\u00a0\u2003x y", None, " a \x1c\t b\n", "", "e\u0301\u00a0 z ", "\x85"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(assistant.canonical(F.col("t"))).collect()]
    assert got == [None if t is None else T.canonical_query(t) for t in texts]


class Counting:
    """Models that note what they are asked for, in a file, as they run in other processes; some texts fail."""

    def __init__(self, path, failing=(), failing_vectors=()):
        self.path, self.failing, self.failing_vectors = str(path), failing, failing_vectors

    def generate(self, summary):
        with open(self.path, "a") as f:
            f.write(f"generate {summary}\n")
        if summary in self.failing:
            raise TimeoutError("no answer")
        return json.dumps({"rich_descriptive_paragraph": "p " + summary, "keywords": list("abcde"), "emotional_scores": {a: 0.5 for a in fixed.AXES}})

    def embed(self, texts):
        with open(self.path, "a") as f:
            f.write("".join(f"embed {t}\n" for t in texts))
        if any(w in t for t in texts for w in self.failing_vectors):
            raise TimeoutError("no vectors")
        # Answers come in any order, with their index.
        return [(k, [1.0, float(len(t)), float(k % 2)]) for k, t in reversed(list(enumerate(texts)))]

    def models(self, **other):
        return stories.Models(self.generate, self.embed, other.get("feature_model", "f"), other.get("embedding_model", "e"), 3)

    def asked(self, kind):
        try:
            lines = open(self.path).read().splitlines()
        except FileNotFoundError:
            return []
        return sorted(line.split(" ", 1)[1] for line in lines if line.startswith(kind))


def test_build_resumes_from_its_own_checkpoint(spark, tmp_path):
    source = spark.createDataFrame([(k, f"T{k}", f"s{k}") for k in range(6)], "ordinal long, title string, summary string")
    path = f"{tmp_path}/store"
    first = Counting(tmp_path / "1", failing=("s4",))
    with pytest.raises(ValueError, match="failed for 1 stories.*T4"):
        stories.build_store(source, path, first.models())
    assert first.asked("generate") == ["s0", "s1", "s2", "s3", "s4", "s4", "s5"] and first.asked("embed") == [] and store.published(spark, path) is None
    second = Counting(tmp_path / "2", failing_vectors=("s5",))
    with pytest.raises(ValueError, match="Embedding failed"):
        stories.build_store(source, path, second.models())
    assert second.asked("generate") == ["s4"]
    third = Counting(tmp_path / "3")
    assert stories.build_store(source, path, third.models()) == {"current": False, "reused": 0, "cached": 6, "pending": 0, "total": 6}
    assert third.asked("generate") == [] and len(third.asked("embed")) == 6  # each once
    rows, meta = store.load_store(spark, path)
    assert meta["n"] == 6 and {r.record_id.split("-")[1] for r in rows.collect()} == set("012345")
    for r in rows.collect():  # answers in another order went to their own texts
        assert r.embedding[1] / r.embedding[0] == pytest.approx(len(r.search_payload), rel=1e-4)
    fourth = Counting(tmp_path / "4")
    assert stories.build_store(source.orderBy(F.desc("ordinal")), path, fourth.models())["current"] and not fourth.asked("")
    changed = source.withColumn("summary", F.when(F.col("ordinal") == 2, "new").otherwise(F.col("summary")))
    assert stories.build_store(changed, path, fourth.models()) == {"current": False, "reused": 5, "cached": 0, "pending": 1, "total": 6}
    assert fourth.asked("generate") == ["new"] and len(fourth.asked("embed")) == 1
    other = Counting(tmp_path / "5")
    assert stories.build_store(changed, path, other.models(embedding_model="e2"))["cached"] == 6 and len(other.asked("embed")) == 6
    assert stories.build_store(changed, path, other.models(feature_model="f2"))["pending"] == 6
    with pytest.raises(ValueError):
        stories.build_store(source.withColumn("record_id", F.lit("x")), path, other.models())
    with pytest.raises(ValueError):
        stories.build_store(source.where("false"), f"{tmp_path}/none", other.models())


def test_invalid_checkpoint_entries_are_not_used(spark, tmp_path):
    source = spark.createDataFrame([(1, "T", "s")], "ordinal long, title string, summary string")
    key = source.select(T.content_hash(F.col("title"), F.col("summary"))).first()[0]
    bad = [(key, 1, " ", list("abcde"), {a: 0.5 for a in fixed.AXES}, None, 1, "f"), (key, 2, "p", list("abcd"), {a: 0.5 for a in fixed.AXES}, None, 1, "f"), (key, 3, "p", list("abcde"), {a: 0.5 for a in fixed.AXES}, None, 9, "f")]
    spark.createDataFrame(bad, f"hash string, ordinal long, {assistant.FEATURES}, cache_version int, feature_model string").write.parquet(f"{tmp_path}/s/checkpoint")
    models = Counting(tmp_path / "log")
    assert stories.build_store(source, f"{tmp_path}/s", models.models())["pending"] == 1 and models.asked("generate") == ["s"]


def test_answers_in_order():
    assert build.in_order([(2, "c"), (0, "a"), (1, "b")], 3) == ["a", "b", "c"] and build.in_order([[1.0], [2.0]], 2) == [[1.0], [2.0]]
    for bad in ([(0, "a"), (0, "b")], [(1, "a"), (2, "b")], [(0, "a")], [[1.0]]):
        with pytest.raises(ValueError):
            build.in_order(bad, 2)


def test_speech_and_recordings(spark):
    rows = spark.createDataFrame([("A", "sea"), ("B", " "), (None, "x"), ("C", "bad")], "title string, summary string")
    got = [(r.script, r.audio and bytes(r.audio), r.error) for r in audio.speak(rows, lambda s: b"" if "bad" in s else s.encode()).collect()]
    assert got[0] == ("A. sea", b"A. sea", None) and got[1][1] is None and got[2][1] == b"This story. x" and "no sound" in got[3][2]
    sounds = spark.createDataFrame([(bytearray(b" a \n b "),), (bytearray(b""),), (None,), (bytearray(b"x" * 20),), (bytearray(b" "),)], "audio binary")
    got = [(r.transcript, r.error) for r in audio.transcribe(sounds, lambda b: b.decode(), 10).collect()]
    assert got[0] == ("a b", None) and all(t is None and e.startswith("ValueError") for t, e in got[1:]) and "too large" in got[3][1]


def test_copies_of_remote_files(spark, tmp_path, monkeypatch):
    (tmp_path / "x.txt").write_text("hello")
    (tmp_path / "empty.txt").write_text("")
    monkeypatch.setattr(settings, "MOST_COPIES", 1)
    settings._copies.clear()
    assert settings.shared_copy(spark, f"{tmp_path}/x.txt") == f"{tmp_path}/x.txt"
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    hadoop.set("fs.viewfs.mounttable.far.link./in", f"file://{tmp_path}")
    far = settings.shared_copy(spark, "viewfs://far/in/x.txt")
    assert far != "viewfs://far/in/x.txt" and spark.read.text(far).first()[0] == "hello"
    (tmp_path / "x.txt").write_text("changed")
    assert settings.shared_copy(spark, "viewfs://far/in/x.txt") == far and spark.read.text(far).first()[0] == "hello" and len(settings._copies) == 1
    with pytest.raises(ValueError, match="empty"):
        settings.shared_copy(spark, "viewfs://far/in/empty.txt")


def test_batches_for_python_are_bounded(spark):
    size = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(size)
    session.ship(spark)
    assert spark.conf.get(size) == session.BATCH_BYTES
    spark.conf.set(size, "1m")
    session.ship(spark)
    assert spark.conf.get(size) == "1m"
    spark.conf.unset(size)
