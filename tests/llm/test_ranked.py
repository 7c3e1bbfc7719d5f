"""Ranked search against scores computed one by one."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from lumenweft.llm import ranked

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_force(docs, items, k=20):
    own = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    n_docs, total = sum(n > 0 for *_, n in own), sum(n for *_, n in own)
    df = Counter(t for _, c, _ in own for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c, n in own:
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * (75 + 25 * n * n_docs // total))) for t in terms(text) if c[t])
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r[c] for c in ("item_id", "rank", "doc_id", "score")) for r in df.collect()), key=repr)


def pairs(df, a, b):
    return [(r[a], r[b]) for r in df.collect()]


ITEMS = "item_id long, text string, rank int, doc_id long"


def test_odd_rows(spark, odd):
    items = spark.createDataFrame([(1, "the sea, the Stones!", 1, 1), (2, None, 1, 1), (3, "!?", 1, 1), (4, "one été 词", 1, 1), (4, "One one", 1, 1), (None, "rain rain x1s", 1, 1), (5, "nowhere", 0, 0)], ITEMS)
    assert found(ranked.op13(odd, items)) == brute_force(pairs(odd, "doc_id", "text"), pairs(items, "item_id", "text"))


def test_given_tables(spark, docs, sf):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    assert found(ranked.op13(docs, items)) == brute_force(pairs(docs, "doc_id", "text"), pairs(items, "item_id", "text"))


def test_windows_blocks_passes_and_ties(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(k * 7919 % 3000, " ".join(rng.choice("abcdefghij") for _ in range(rng.choice([3, 3, 3, 9])))) for k in range(3000)] + [(17, "a b c")] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    asked = [(k, " ".join(rng.choice("abcdefghijk") for _ in range(4))) for k in range(7)]
    items = spark.createDataFrame(asked, "item_id long, text string")
    monkeypatch.setattr(ranked, "ITEMS", 3)
    expected = brute_force(rows, asked)
    index = ranked.build_index(docs)
    assert index.count() == 3
    assert found(ranked.search(index, items)) == expected
    # Blocks of a few rows and windows of less.
    schema = ranked.to_arrow_schema(spark.createDataFrame([], ranked.INDEX.format(id="bigint")).schema)
    monkeypatch.setattr(ranked, "BLOCK", 300)
    monkeypatch.setattr(ranked, "WINDOW", 16)
    own = ranked.Items([t for _, t in asked])
    batch = ranked.pa.RecordBatch.from_arrays([ranked.pa.array([i for i, _ in rows]), ranked.pa.array([t for _, t in rows])], ["doc_id", "text"])
    blocks = list(ranked._blocks(schema)(iter([batch])))
    assert len(blocks) > 20

    class Shared:
        value = own

    n_docs, total = (sum(b.column(k)[0].as_py() for b in blocks) for k in (0, 1))
    df = np.zeros(len(own.vocabulary), np.int64)
    for b in ranked._frequencies(Shared)(b.select(["terms"]) for b in blocks):
        df[b.column(0).to_numpy()] += b.column(1).to_numpy()
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for n in df.tolist()])
    out = ranked.to_arrow_schema(spark.createDataFrame([], "item int, doc_id long, score long").schema)
    best = [r for b in ranked._scorer(Shared, weights, n_docs, total, 20, out)(b.select(["terms", "postings", "lengths", "ids"]) for b in blocks) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    assert sorted((i, d, s) for i, d, s in best) == sorted((i, d, s) for i, _, d, s in expected)


def test_index_grows(spark, docs, sf):
    """Blocks of later rows beside those of earlier ones are the index of all."""
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    early, late = docs.where("doc_id < 120"), docs.where("doc_id >= 120")
    assert found(ranked.search(ranked.build_index(early).union(ranked.build_index(late)), items)) == found(ranked.op13(docs, items))


def test_whole_numbers_of_any_size():
    lengths = np.array([1, 10**7], np.int64)
    assert ranked.length_factors(lengths, 10**11, 10**13).tolist() == [75 + 25 * n * 10**11 // 10**13 for n in (1, 10**7)]


@pytest.mark.parametrize("empty", ["docs", "items"])
def test_empty_tables(spark, odd, empty):
    items = spark.createDataFrame([(1, "the sea", 1, 1)], ITEMS)
    assert ranked.op13(odd.limit(0) if empty == "docs" else odd, items.limit(0) if empty == "items" else items).collect() == []
