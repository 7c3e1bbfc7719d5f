"""The mood engine against a plain restatement of its rules."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lumenweft import fixed
from lumenweft.functions import text as T
from lumenweft.operators import mood


def parsed(spark, *texts):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, t string")
    return [r.m for r in df.orderBy("k").select(mood.parse_mood(F.col("t")).alias("m")).collect()]


def by_rule(text):
    tokens = re.findall(r"[a-z][a-z\-]+", (text or "").lower())
    hay = " ".join(tokens + [" ".join(p) for p in zip(tokens, tokens[1:], strict=False)])
    total = Counter()
    if "cozy game" in hay:
        total.update(fixed.LEXICON["cozy game"])
    for word, n in Counter(tokens).items():
        if " " not in word:
            for axis, d in fixed.LEXICON.get(word, {}).items():
                total[axis] += d * n
    return [max(0.0, min(1.0, 0.5 + total[a])) for a in fixed.AXES]


def test_parse(spark):
    texts = ["a rainy sunday", "cozy game", "my cozy games", "game is cozy", "cozy-game", "3am love love", "", None, "DARK dark Dark", "nothing known"]
    for got, text in zip(parsed(spark, *texts), texts, strict=True):
        assert got == pytest.approx(by_rule(text)), text


def test_phrase_counts_its_words_too(spark):
    warmth = parsed(spark, "cozy game")[0][fixed.AXES.index("warmth")]
    assert warmth == 1.0  # 0.5 + 0.7 + 0.6, clamped once


def test_fixed_tables():
    assert len(fixed.LEXICON) == 56 and len(fixed.SLOTS) == 7 and len(fixed.FESTIVALS) == 5 and len(fixed.PHRASES) == 12
    assert all(set(v) <= set(fixed.AXES) for v in fixed.LEXICON.values())


def pool(spark, items):
    return spark.createDataFrame([(i, t, [float(x) for x in m], th) for i, t, m, th in items], "id long, type string, mood array<double>, themes array<string>")


def items():
    out = []
    for k in range(30):
        out.append((k, fixed.TYPES[k % 5], [((k * (j + 3)) % 11) / 10 for j in range(12)], ["Love", "sea"] if k % 4 == 0 else []))
    return out


def cosine(a, b):
    n = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    return sum(x * y for x, y in zip(a, b, strict=True)) / n if n else 0.0


def test_weekend_by_rule(spark):
    everything = items()
    base = [0.5 + 0.04 * (k % 5) for k in range(12)]
    used, types_used, expected = set(), set(), []
    for slot, (name, types, target) in enumerate(fixed.SLOTS):
        goal = [max(0, min(1, b * 0.45 + target.get(a, 0.5) * 0.55)) for a, b in zip(fixed.AXES, base, strict=True)]
        for kind in [t for t in types if t not in types_used] + [t for t in types if t in types_used]:
            free = sorted((-cosine(goal, m), i) for i, t, m, _ in everything if t == kind and i not in used)
            if free:
                used.add(free[0][1])
                types_used.add(kind)
                expected.append((slot, name, kind, free[0][1]))
                break
    moods = spark.createDataFrame([(1, base)], "mood_id long, mood array<double>")
    got = mood.plan_weekend(pool(spark, everything), moods).orderBy("slot_no").collect()
    assert [(r.slot_no, r.slot, r.type, r.id) for r in got] == expected


def test_weekend_for_many_moods(spark, monkeypatch):
    """Parts of the items give what the broadcast gives, and the broadcast moves no item before it is cut."""
    moods = spark.createDataFrame([(k, [((k + j) % 7) / 7 for j in range(12)]) for k in range(9)], "mood_id long, mood array<double>")
    few = mood.plan_weekend(pool(spark, items()), moods)
    plan = mood.slot_candidates(pool(spark, items()), moods)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "WindowGroupLimit" in plan
    monkeypatch.setattr(mood, "MOST_MOODS", 3)
    assert sorted(mood.plan_weekend(pool(spark, items()), moods).collect()) == sorted(few.collect())


def test_weekend_leaves_out_empty_slots(spark):
    few = [(1, "movie", [0.5] * 12, []), (2, "game", [0.4] * 12, [])]
    moods = spark.createDataFrame([(1, [0.5] * 12)], "mood_id long, mood array<double>")
    got = mood.plan_weekend(pool(spark, few), moods).collect()
    assert sorted(r.slot_no for r in got) == [0, 2]


def test_filters(spark):
    p = pool(spark, items())
    target = mood.vector_literal({"warmth": 1.0})
    assert {r.type for r in mood.rank(p, target, 50, ["book"]).collect()} == {"book"}
    assert mood.rank(p, target, 50, []).count() == 30 and mood.rank(p, target, 50, None, [0, 1]).count() == 28
    assert mood.unlock_related(p, 999).count() == 0
    related = mood.unlock_related(p, 0).collect()
    assert "movie" not in {r.type for r in related} and all(r.rn <= 2 for r in related)


def test_festivals(spark):
    counts = Counter((r.festival, r.type) for r in mood.festival_lineup(pool(spark, items())).collect())
    assert set(counts.values()) == {1, 2} and len(counts) == 20


def test_explanation(spark):
    row = ("T", "C", 2001, "A pitch.", [0.9] + [0.5] * 10 + [0.1], ["one", "two"], "An arc.")
    df = spark.createDataFrame([row], "title string, creator string, year int, pitch string, mood array<double>, themes array<string>, emotional_arc string")
    text = df.select(mood.explanation(mood.vector_literal({"valence": 0.9, "humor": 0.1})).alias("x")).first().x
    assert text.startswith("**T** by C (2001). A pitch. It is leaning toward the warm side of the emotional spectrum and mostly plays it straight — which")
    assert text.endswith("It touches on one and two. An arc..")


def test_overlap_is_case_blind(spark):
    df = spark.createDataFrame([(["A", "b"], ["a"]), ([], ["a"]), (None, None)], "x array<string>, y array<string>")
    assert [round(r[0], 6) for r in df.select(mood.theme_overlap(F.col("x"), F.col("y"))).collect()] == [0.707107, 0.0, 0.0]


def test_emoji_and_escape(spark):
    df = spark.createDataFrame([("game", "<a & 'b'>")], "t string, x string")
    assert df.select(T.emoji(F.col("t")), T.emoji(F.lit("?")), T.escape_markup(F.col("x"))).first()[:] == ("🎮", "✨", "&lt;a &amp; &apos;b&apos;&gt;")
