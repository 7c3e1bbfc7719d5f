"""The stored index against a search over all rows, before and after it grows."""

import hashlib
import math
import random
import threading
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lumenweft.functions import text as T
from lumenweft.operators import search
from lumenweft.plans import inverted, retrieval

def tokens():
    return T.terms(F.col("text"))


def plain(rows, prompt, k):
    """Scores of all rows by their definition."""
    cut = lambda t: [w for w in "".join(c if c.isalnum() and c.isascii() else " " for c in (t or "").lower()).split() if len(w) >= 3]
    docs = {i: Counter(cut(t)) for i, t in rows}
    df = Counter(w for c in docs.values() for w in c)
    idf = lambda w: math.log((1 + len(docs)) / (1 + df[w])) + 1
    q = Counter(cut(prompt))
    length = lambda c: max(math.sqrt(math.fsum((n * idf(w)) ** 2 for w, n in c.items())), 1e-8)
    scores = {i: sum(q[w] * idf(w) ** 2 * c[w] for w in q) / (length(q) * length(c)) for i, c in docs.items()}
    tie = lambda i: hashlib.sha256(f"{prompt}\0{i}".encode()).hexdigest()
    return [(i, round(scores[i], 9)) for i in sorted(docs, key=lambda i: (round(scores[i], 12), tie(i), i), reverse=True)[:k]]


def found(spark, path, prompt, k):
    return [(r.id, round(r.score, 9)) for r in inverted.search_index(spark, path, prompt, k).orderBy(F.desc("score"), F.desc(F.sha2(F.concat(F.lit(f"{prompt}\0"), F.col("id").cast("string")), 256))).collect()]


def prose(n, seed=1, ids=0):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.8)) % 400:03d}" for _ in range(3000)]
    return [(ids + k, " ".join(rng.choice(words) for _ in range(rng.choice([3, 8, 30, 200])))) for k in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, text string")


PROMPTS = ["w001 w002 w017", "w001", "w250 w250 nowhere", "w003 w111 w222 w333 w005 w001"]


def test_same_as_a_search_over_all_rows(spark, tmp_path):
    rows = [*prose(400), (400, None), (401, "…"), (402, "w001 w002"), (403, "w002 w001")]
    version = inverted.build_index(frame(spark, rows), f"{tmp_path}/i", "id", tokens())
    assert version["n"] == 404 and version["buckets"] == inverted.LEAST_BUCKETS
    for prompt in PROMPTS:
        assert found(spark, f"{tmp_path}/i", prompt, 7) == plain(rows, prompt, 7)
    own = search.lexical_top_k(frame(spark, rows), PROMPTS[0], 7, "id", tokens()).collect()
    assert [r.id for r in own] == [i for i, _ in plain(rows, PROMPTS[0], 7)]


def test_parts_that_cannot_reach_the_best_are_not_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(inverted, "PART", 16)
    rows = prose(600, 3)
    version = inverted.build_index(frame(spark, rows), f"{tmp_path}/i", "id", tokens())
    assert version["parts"] > 30
    shares = []
    for prompt in PROMPTS:
        assert found(spark, f"{tmp_path}/i", prompt, 5) == plain(rows, prompt, 5)
        read, of_terms, every = inverted.share_read(spark, f"{tmp_path}/i", prompt, 5)
        assert read <= of_terms < every
        shares.append(read / of_terms)
    assert min(shares) < 0.5


def test_only_the_folders_of_the_terms_are_read(spark, tmp_path):
    inverted.build_index(frame(spark, prose(200)), f"{tmp_path}/i", "id", tokens())
    version = inverted.current(spark, f"{tmp_path}/i")
    own = inverted.Search(spark, version, "w001 w002")
    plan = own.blocks._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and "PushedFilters: [In(term" in plan
    heads = own.bounds if hasattr(own, "gain") else (own.prepare(), own.bounds)[1]
    assert "weights" not in heads()._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1].split(">")[0]


def test_an_added_document_changes_all_weights(spark, tmp_path):
    path, rows = f"{tmp_path}/i", prose(120, 5)
    inverted.extend_index(frame(spark, rows), path, "id", tokens())
    before = {r.term: (r.df, r.most) for r in inverted.vocabulary(spark, path).collect()}
    more = [(500, "w001 w001 fresh"), (501, "w002 " * 50)]
    version = inverted.extend_index(frame(spark, more), path, "id", tokens())
    after = {r.term: (r.df, r.most) for r in inverted.vocabulary(spark, path).collect()}
    assert after["w001"][0] == before["w001"][0] + 1 and after["fresh"][0] == 1 and "fresh" not in before
    assert any(after[t][0] == before[t][0] and after[t][1] != before[t][1] for t in before)  # lengths moved as well
    for prompt in [*PROMPTS, "fresh w001"]:
        assert found(spark, path, prompt, 6) == plain(rows + more, prompt, 6)
    assert version["n"] == 122 and len(version["segments"]) == 2
    assert inverted.forget(spark, path) == 1 and found(spark, path, PROMPTS[0], 6) == plain(rows + more, PROMPTS[0], 6)
    inverted.build_index(frame(spark, more), path, "id", tokens())
    assert inverted.forget(spark, path) == 1 and found(spark, path, "w001", 6) == plain(more, "w001", 6)
    assert len([p for p in (tmp_path / "i" / "segments").iterdir() if not p.name.startswith(".")]) == 1


def test_fewer_matches_than_asked_for(spark, tmp_path):
    rows = [(1, "alpha beta"), (2, "gamma"), (3, None), (4, "alpha")]
    inverted.build_index(frame(spark, rows), f"{tmp_path}/i", "id", tokens())
    for k in (1, 2, 3, 4, 9):
        assert found(spark, f"{tmp_path}/i", "alpha", k) == plain(rows, "alpha", k)
    assert found(spark, f"{tmp_path}/i", "the of", 3) == [] and len(found(spark, f"{tmp_path}/i", "delta", 2)) == 2


def test_what_fails_changes_nothing(spark, tmp_path):
    path = f"{tmp_path}/i"
    with pytest.raises(ValueError):
        inverted.current(spark, path)
    inverted.build_index(frame(spark, [(1, "alpha")]), path, "id", tokens())
    for bad in ([(1, "alpha beta")], [(None, "beta")], [(7, "beta"), (7, "gamma")]):
        with pytest.raises(ValueError):
            inverted.extend_index(frame(spark, bad), path, "id", tokens())
    assert found(spark, path, "alpha", 3) == [(1, 1.0)]
    inverted.build_index(frame(spark, []), path, "id", tokens())
    assert found(spark, path, "alpha", 3) == [] and inverted.vocabulary(spark, path).count() == 0


def test_extensions_at_once_lose_no_document(spark, tmp_path):
    path, raised = f"{tmp_path}/i", []

    def add(k):
        try:
            inverted.extend_index(frame(spark, [(k, f"alpha w{k:03d}")]), path, "id", tokens())
        except Exception as why:
            raised.append(why)

    threads = [threading.Thread(target=add, args=(k,)) for k in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join(300)
    assert not raised and inverted.current(spark, path)["n"] == 3
    assert {i for i, _ in found(spark, path, "alpha", 5)} == {0, 1, 2}


def test_stories_by_a_stored_index(spark, tmp_path):
    store = spark.createDataFrame([("a", "Storm", "a dark storm"), ("b", "Sun", "a bright day")], "record_id string, title string, summary string")
    retrieval.index_stories(store, f"{tmp_path}/i")
    got = retrieval.search_stories(store, " storm ", 1, index=f"{tmp_path}/i").first()
    assert got.record_id == "a" and got.vector_similarity == pytest.approx(retrieval.search_stories(store, "storm", 1).first().vector_similarity)
