"""Lexicons as tables: the same moods as by the expression, whatever the size."""

import random

import pytest
from pyspark.sql import functions as F

from lumenweft import fixed
from lumenweft.operators import mood, phrases

AXIS = {a: k for k, a in enumerate(fixed.AXES)}


def rows_of(lexicon):
    return [(k, w, a, d) for k, (w, v) in enumerate(lexicon.items()) for a, d in v.items()]


def table(spark, lexicon):
    return spark.createDataFrame(rows_of(lexicon), "ordinal int, phrase string, axis string, delta double")


def one_by_one(lexicon, tokens):
    """Longest first, each looked for in what the others left."""
    total = [0.0] * 12
    hay = " ".join([*tokens, *(f"{a} {b}" for a, b in zip(tokens, tokens[1:], strict=False))])
    for t in tokens:
        for k, d in lexicon.get(t, {}).items() if " " not in t and "-" not in t else ():
            total[AXIS[k]] += d
    for p in sorted((p for p in lexicon if " " in p or "-" in p), key=len, reverse=True):
        if p.replace("-", " ") in hay:
            hay = hay.replace(p.replace("-", " "), " ")
            for k, d in lexicon[p].items():
                total[AXIS[k]] += d
    return [min(1.0, max(0.0, 0.5 + x)) for x in total]


def test_as_the_expression(spark):
    rng = random.Random(6)
    words = [w for p in fixed.LEXICON for w in p.replace("-", " ").split()] + ["the", "well-being", "of"]
    texts = [None, "", "…", *(" ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 5, 30]))) for _ in range(200))]
    df = spark.createDataFrame([(k, t, k) for k, t in enumerate(texts)], "k int, t string, _tokens int")
    out = phrases.parse_moods(df, "t", table(spark, fixed.LEXICON)).withColumn("own", mood.parse_mood(F.col("t")))
    rows = out.collect()
    assert out.columns == ["k", "t", "_tokens", "mood", "own"] and len(rows) == len(texts)
    assert all(r.mood == pytest.approx(r.own, abs=1e-12) for r in rows)


def test_what_is_left_of_a_phrase_can_make_another():
    rng = random.Random(8)
    made = lambda n: " ".join(rng.choice(["a", "ab", "b", "ba"]) for _ in range(n))
    for _ in range(400):
        lexicon = {made(rng.choice([1, 2, 2, 3, 4])).replace(" ", rng.choice([" ", "-"])): {rng.choice(fixed.AXES): rng.choice([0.01, -0.02])} for _ in range(rng.choice([1, 3, 9, 20]))}
        known = phrases.Lexicon([(w, [(AXIS[a], d) for a, d in v.items()]) for w, v in lexicon.items()])
        for n in (0, 1, 3, 12, 60):
            tokens = made(n).split()
            assert known.mood(tokens) == pytest.approx(one_by_one(lexicon, tokens), abs=1e-12), (lexicon, tokens)


def test_fifty_thousand_phrases(spark, docs_of_words):
    rng = random.Random(1)
    word = lambda: f"w{rng.randrange(3000)}".translate(str.maketrans("0123456789", "abcdefghij"))
    lexicon = {f"{word()} {word()}" if rng.random() < 0.9 else word(): {rng.choice(fixed.AXES): 0.001 * rng.randint(-9, 9)} for _ in range(50_000)}
    out = phrases.parse_moods(docs_of_words, "t", table(spark, lexicon))
    plans = [phrases.parse_moods(docs_of_words, "t", table(spark, dict(list(lexicon.items())[:n])))._jdf.queryExecution().analyzed().toString() for n in (10, 1000)]
    assert len(plans[0]) == pytest.approx(len(plans[1]), abs=20)
    rows = out.collect()
    for r in random.Random(2).sample(rows, 5):
        assert r.mood == pytest.approx(one_by_one(lexicon, r.t.split()), abs=1e-9)
    assert sum(m != 0.5 for r in rows for m in r.mood) > len(rows)


@pytest.fixture
def docs_of_words(spark):
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(3000)}".translate(str.maketrans("0123456789", "abcdefghij"))
    return spark.createDataFrame([(" ".join(word() for _ in range(200)),) for _ in range(60)], "t string")


def test_lexicons_are_checked(spark, monkeypatch):
    df = spark.createDataFrame([("sea air",)], "t string")
    make = lambda rows: spark.createDataFrame(rows, "phrase string, axis string, delta double")
    with pytest.raises(ValueError, match="axis"):
        phrases.parse_moods(df, "t", make([("sea", "size", 0.1)]))
    assert phrases.parse_moods(df, "t", make([(None, "hope", 0.1), ("sea", None, 0.1), ("sea air", "hope", None)])).first().mood == [0.5] * 12
    assert phrases.parse_moods(df, "t", make([("sea air", "hope", 0.75), ("sea", "hope", -0.5)])).first().mood[AXIS["hope"]] == 0.75
    monkeypatch.setattr(phrases, "MOST_ROWS", 1)
    with pytest.raises(ValueError, match="rows"):
        phrases.parse_moods(df, "t", make([("a", "hope", 0.1), ("b", "hope", 0.1)]))
