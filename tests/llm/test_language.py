"""Language identification against a plain Kneser-Ney model, on held-out texts and on odd rows."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumenweft.llm import language
from lumenweft.llm.language import ORDER, Folding, Models

TEXTS = {
    "xx": ["The sea is calm today, and the stones are warm.", "Rain fell on 3 stones; the sea was grey", "A calm rain"],
    "yy": ["La mer est calme aujourd'hui et l'été commence", "Il pleut sur les pierres grises de la mer"],
}


def normal(text):
    out = ""
    for c in text:
        c = c.lower()[0] if c.isalpha() else " "
        if c != " " or (out or " ")[-1] != " ":
            out += c
    return out if not out or out[-1] == " " else out + " "


class Plain:
    """Interpolated Kneser-Ney by dictionaries, straight from its definition."""

    def __init__(self, texts, letters):
        self.letters, self.counts = letters, {k: Counter() for k in range(1, ORDER + 1)}
        for t in texts:
            padded = " " * (ORDER - 1) + normal(t)
            for i in range(ORDER - 1, len(padded)):
                self.counts[ORDER][padded[i - ORDER + 1 : i + 1]] += 1
        for k in range(ORDER - 1, 0, -1):
            for g in self.counts[k + 1]:
                self.counts[k][g[1:]] += 1
        self.context, self.discount = {}, {}
        for k, c in self.counts.items():
            once, twice = sum(n == 1 for n in c.values()), sum(n == 2 for n in c.values())
            self.discount[k] = min(max(once / (once + 2 * twice), 0.1), 0.95) if once else 0.5
            self.context[k] = defaultdict(lambda: [0, 0])
            for g, n in c.items():
                self.context[k][g[:-1]][0] += n
                self.context[k][g[:-1]][1] += 1

    def p(self, gram):
        k = len(gram)
        if k == 0:
            return 1 / self.letters
        lower = self.p(gram[1:])
        if gram[:-1] not in self.context[k]:
            return lower
        total, kinds = self.context[k][gram[:-1]]
        d = self.discount[k]
        return max(self.counts[k].get(gram, 0) - d, 0) / total + d * kinds / total * lower

    def score(self, text):
        padded = " " * (ORDER - 1) + normal(text)
        return sum(math.log(self.p(padded[i - ORDER + 1 : i + 1])) for i in range(ORDER - 1, len(padded))), len(padded) - ORDER + 1


def counted(texts):
    batch = pa.RecordBatch.from_arrays([pa.array([k for k, own in enumerate(texts.values()) for _ in own], pa.int32()), pa.array([t for own in texts.values() for t in own]), pa.array([[0] for own in texts.values() for _ in own])], ["language", "text", "pieces"])
    sums = Counter()
    for b in language._grams(iter([batch])):
        for v, g, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
            sums[v, g] += n
    keys = sorted(sums)
    return Models(list(texts), np.array([v for v, _ in keys]), [g for _, g in keys], np.array([sums[k] for k in keys], float))


def test_models_are_plain_kneser_ney():
    models = counted(TEXTS)
    letters = len({c for own in TEXTS.values() for t in own for c in normal(t)}) + 1
    plain = [Plain(own, letters) for own in TEXTS.values()]
    asked = [t for own in TEXTS.values() for t in own] + ["calm été", "zqx ж seas", "a", "The  sea\n\nthe (mer)!"]
    batch = pa.RecordBatch.from_arrays([pa.array(asked)], ["text"])
    ((_, _, entropy, n, found),) = language._choice(models, batch, Folding(), models.numbers())
    for k, t in enumerate(asked):
        own = [m.score(t) for m in plain]
        assert n[k] == own[0][1]
        assert found[k] == sum(c.isalpha() for c in t)
        assert np.allclose(entropy[k] * n[k], [-s for s, _ in own], rtol=1e-5, atol=1e-4)


def test_probabilities_add_up_to_one():
    plain = Plain(TEXTS["xx"], 1 + len({c for t in TEXTS["xx"] for c in normal(t)}))
    models = counted({"xx": TEXTS["xx"]})
    letters = [chr(c) for c in models.alphabet[0]] + ["ж"]
    for context in ("", "t", "the ", " sea", "zzzz"):
        assert sum(plain.p(context[-ORDER + 1 :] + c) for c in letters) == pytest.approx(1)


def test_slices_keep_characters_whole():
    data = np.frombuffer("aéбλ漢字🙂x".encode() * 3, np.uint8)
    cuts, owner = language.sliced(np.array([0, 0, len(data)]), data, 7)
    assert owner.tolist() == [0] + [1] * (len(cuts) - 2) and cuts[-1] == len(data) and cuts.tolist() == sorted(cuts.tolist())
    assert "".join(data[a:b].tobytes().decode() for a, b in zip(cuts[:-1], cuts[1:], strict=True)) == data.tobytes().decode()
    assert all(b - a <= 7 for a, b in zip(cuts[:-1], cuts[1:], strict=True))


def test_held_out_texts(spark, docs):
    out = language.op11(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in out if r.held_out]
    assert len(out) == docs.count() and len(held) > 20
    assert sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in out)


def test_foreign_texts_are_rejected(spark):
    rng = random.Random(3)
    own = {"xx": "sea rain stone calm warm grey today fell light window green water".split(), "yy": "mer pluie pierre calme chaud gris lumière fenêtre verte eau".split()}
    rows = [(k, " ".join(rng.choice(own[v]) for _ in range(60)), v) for k, v in enumerate(["xx", "yy"] * 200)]
    other = [(10_000 + k, " ".join(rng.choice(["zgłosz", "wkrótce", "przyjść", "chrząszcz", "źdźbło"]) for _ in range(60)), None) for k in range(10)]
    out = {r.doc_id: r for r in language.identify(spark.createDataFrame(rows + other, "doc_id long, text string, lang string"), F.col("lang").isNotNull()).collect()}
    assert all(out[k].rejected for k, *_ in other)
    assert sum(out[k].rejected for k, *_ in rows) <= 0.02 * len(rows)
    assert all(out[k].lang_pred == v for k, _, v in rows)


def test_odd_rows(spark, odd):
    out = language.op11(odd).collect()
    assert len(out) == odd.count()
    found = {(r.doc_id, r.lang_pred) for r in out}
    assert (3, "und") in found and (4, "und") in found and (5, "und") in found and (7, "en") in found and (6, "en") in found
    assert all(r.score == 0 and r.rejected for r in out if r.lang_pred == "und")
    assert sorted(r.held_out for r in out if r.doc_id is None) == [False, False]


def test_nothing_to_learn_from(spark, odd):
    assert language.op11(odd.limit(0)).collect() == []
    out = language.op11(odd.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in out} == {"und"} and {r.score for r in out} == {0.0}
    signs = spark.createDataFrame([(1, "1 2 3", "en"), (3, "abc", None)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in language.op11(signs).collect()} == {"und"}


def test_marks_and_other_scripts(spark):
    rows = [(k, t, v) for k, (v, t) in enumerate([("hi", "नमस्ते दुनिया यह समुद्र है"), ("ru", "море сегодня спокойное и тёплое"), ("zh", "今天 的 海 很 平静")] * 30)] + [(999, "हिन्दी समुद्र", None), (1000, "спокойное море", None), (1001, "海 平静", None), (1002, "́́", None)]
    out = {r.doc_id: r.lang_pred for r in language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.col("lang").isNotNull()).collect()}
    assert [out[k] for k in (999, 1000, 1001, 1002)] == ["hi", "ru", "zh", "und"]
