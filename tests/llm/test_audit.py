"""Filter audit against every filter in every order, one after the other."""

from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from lumenweft.llm import audit

LABELS = "doc_id long, quality int, toxic int, text string, n int"


def brute_force(docs, labels):
    good, bad = {i for i, q, *_ in labels if q == 1 and i is not None}, {i for i, _, t, *_ in labels if t == 1 and i is not None}
    rows = []
    for r in docs:
        text = r.text or ""
        words = text.encode().split()
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text),
            "D": any(c in "#$%&*|" for c in text),
            "E": r.doc_id is not None and any(o.doc_id is not None and o.doc_id < r.doc_id and (o.text or "") == text for o in docs),
        }
        rows.append((r.lang or "", r.doc_id, fails))
    out = []
    for part in {p for p, *_ in rows}:
        own, shapley, report = [r for r in rows if r[0] == part], Counter(), []
        for order in permutations("ABCDE"):
            left = list(own)
            for step, x in enumerate(order, 1):
                gone = [r for r in left if r[2][x]]
                left = [r for r in left if not r[2][x]]
                shapley[x] += len(gone)
                alone = sum(r[2][x] and sum(r[2].values()) == 1 for r in own)
                report.append((part, "".join(order), step, len(left), len(gone), sum(r[2][x] for r in own) - len(gone), alone, sum(r[1] in good for r in gone), sum(r[1] in bad for r in gone), x))
        out += [(*r[:-1], shapley[r[-1]]) for r in report]
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.collect())


def test_against_every_order(spark, odd):
    labels = [(1, 1, 0, "x", 1), (2, 1, 1, None, 2), (2, 0, None, None, 2), (6, 1, 1, "", 3), (None, 1, 1, "", 3), (77, 1, 1, "", 3), (5, None, 1, "", 0)]
    some = odd.withColumn("lang", F.when(F.col("doc_id") > 5, F.lit("fr")).when(F.col("doc_id") == 1, F.lit("")).when(F.col("doc_id") == 3, F.lit(None)).otherwise(F.col("lang")))
    assert found(audit.op12(some, spark.createDataFrame(labels, LABELS))) == brute_force(some.collect(), labels)


def test_given_tables(spark, docs, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    assert found(audit.op12(docs, labels)) == brute_force(docs.collect(), [(r.doc_id, r.quality, r.toxic) for r in labels.collect()])


def test_copies_over_many_tasks(spark, monkeypatch):
    rows = [(k * 7919 % 1000, "copy of a text" if k % 3 else f"own {k}", "en" if k % 2 else "de") for k in range(1000)] + [(0, "copy of a text", "fr"), (None, "copy of a text", "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(7)
    first = min(i for i, t, _ in rows if t == "copy of a text" and i is not None)
    assert {r.doc_id for r in audit.repeats(docs).collect()} == {i for i, t, _ in rows if t == "copy of a text" and i not in (first, None)}
    monkeypatch.setattr(audit, "HELD", 500)
    own = list(audit._routed((i, lang, t, 5) for i, t, lang in rows))
    assert sum(len(row) == 5 and row[1] == b"copy of a text" for _, row in own) > 5
    counts = Counter()
    for d, p, m, n in audit._resolved(iter(own)):
        counts[d, p, bool(m & audit.REPEATED)] += n
    assert sum(counts.values()) == len(rows)
    assert {d for d, _, e in counts if e} == {i for i, t, _ in rows if t == "copy of a text" and i not in (first, None)}


def test_one_fingerprint_for_all(spark):
    """Texts that share a fingerprint stay apart."""
    rows = [(3, "en", "a", 1), (1, "en", "b", 1), (2, "en", "a", 1), (2, "de", "a", 1), (4, "en", "b", 1)]
    out = sorted((d, p, m & audit.REPEATED, n) for d, p, m, n in audit._resolved(audit._routed(iter(rows))))
    assert out == [(1, "en", 0, 1), (2, "de", 0, 1), (2, "en", 0, 1), (3, "en", 16, 1), (4, "en", 16, 1)]


@pytest.mark.parametrize("empty", ["docs", "labels"])
def test_empty_tables(spark, odd, empty):
    labels = spark.createDataFrame([], LABELS)
    out = found(audit.op12(odd.limit(0) if empty == "docs" else odd, labels))
    assert out == ([] if empty == "docs" else brute_force(odd.collect(), []))
