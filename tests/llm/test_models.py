"""Chat formatting, language model, substring removal, mixing, decontamination, pipeline."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from lumenweft.llm import chat, decontamination, lm, mixing, stages, substrings
from tests.llm.conftest import lower_words, words


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


TRICKY = st.lists(st.sampled_from(["\\", "###", "</turn>", " ", ":", "\n", "a", "### Assistant: ", "=", "é"]), max_size=8).map("".join)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(TRICKY, TRICKY), max_size=4))
def test_round_trip(turns):
    text, spans, rewrites = chat.locate(turns, chat.render)
    assert chat.parse(text) == turns and rewrites == []
    assert "".join(text[a:b] for a, b, _, _ in spans) == text
    assert [chat.unescape(text[c:d]) for _, _, c, d in spans] == [t for _, t in turns]


def test_rewriting_template_is_found():
    only_last = lambda turns: "".join("[gone]" if k < len(turns) - 1 else t for k, (_, t) in enumerate(turns))
    assert chat.locate([("u", "hello"), ("a", "there"), ("u", "x")], only_last)[2] == [1, 2]


def test_chats(spark, sf):
    df = spark.read.parquet(f"{sf}/conversations.parquet")
    turns = defaultdict(list)
    for r in df.collect():
        turns[r.conv_id].append((r.turn, r.role, r.text or ""))
    turns[-7] = [(0, "user", chat.TRICKY), (1, "assistant", chat.TRICKY)]
    got = chat.op4(df).collect()
    assert len(got) == len(turns)
    for r in got:
        own = sorted(turns[r.conv_id])
        learned = "".join(t for _, role, t in own if role == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(own), sha("".join(f"{a}\n{t}\n" for _, a, t in own)))
        assert (r.loss_chars, r.loss_sha256, r.rewrites) == (len(learned), sha(learned), 0) and r.formatted_chars > len(learned)


def test_chats_with_odd_rows(spark):
    rows = [(1, None, "user", "x"), (1, 1, None, None), (1, 1, "assistant", "y"), (1, 1, "assistant", "y"), (None, 1, "assistant", "z"), (2, 5, "assistant", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    got = {r.conv_id: r for r in chat.op4(df).collect()}
    assert (got[1].n_turns, got[1].loss_chars, got[None].loss_chars, got[2].loss_chars) == (4, 2, 1, 0)
    assert chat.format_chats(df.where("false")).count() == 0
    alone = chat.op4(df.where("conv_id is null").union(df.where("conv_id is null")).union(df.where("conv_id = 2"))).where("conv_id is null").collect()
    assert [r.n_turns for r in alone] == [1, 1]


def test_long_conversations(spark):
    """A conversation of 600 turns and one with a text of three million characters come back as they were."""
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", f"turn {k} \\ ### </turn> \n" * (k % 5)) for k in range(600)]
    rows += [(2, 0, "user", "ask"), (2, 1, "assistant", "### a \\ b </turn> " * 170_000)]
    got = {r.conv_id: r for r in chat.op4(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    for conv in (1, 2):
        own = [(role, t) for c, _, role, t in rows if c == conv]
        learned = "".join(t for role, t in own if role == "assistant")
        assert (got[conv].n_turns, got[conv].turns_sha256) == (len(own), sha("".join(f"{a}\n{t}\n" for a, t in own)))
        assert (got[conv].loss_chars, got[conv].loss_sha256, got[conv].rewrites) == (len(learned), sha(learned), 0)


def test_language_model(docs):
    rows = docs.select("doc_id", "text").collect()
    counts, trained = Counter(), 0
    for r in rows:
        if zlib.crc32(str(r.doc_id).encode()) % 7 != 2:
            counts.update(lower_words(r.text))
            trained += 1
    total, kinds = sum(counts.values()) + trained, len(counts) + 1
    size = math.log10(total + kinds + 1)
    for r in lm.op5(docs).collect():
        w = lower_words(next(x.text for x in rows if x.doc_id == r.doc_id))
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w) + 1, sum(counts[x] > 0 for x in w) + 1, total)
        assert r.base_score == pytest.approx(sum(math.log10(counts[x] + 1) - size for x in w) + math.log10(trained + 1) - size)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2) and r.score < 0


def test_backoff_probabilities_add_up():
    rng = random.Random(2)
    texts = [[rng.choice([0, 0, 0, 1, 1, 2, 3]) for _ in range(400)] for _ in range(3)]
    counts = Counter(w for t in texts for w in t)
    pairs = Counter(p for t in texts for p in zip(t, t[1:], strict=False))
    triples = Counter(p for t in texts for p in zip(t, t[1:], t[2:], strict=False))
    kept = sorted(a * 4 + b for (a, b), n in pairs.items() if n > 20)
    place = {c: k for k, c in enumerate(kept)}
    levels = [{c: pairs[c // 4, c % 4] for c in kept}, {place[a * 4 + b] * 4 + c: n for (a, b, c), n in triples.items() if n > 5 and a * 4 + b in place and b * 4 + c in place}]
    model = lm.Backoff(np.array([counts[w] for w in range(4)]), sum(counts.values()), 4, levels)
    outside = 1 - sum((counts[w] + 1) / (model.total + 5) for w in range(4))
    assert len(model.fail) > 5
    for state in range(len(model.fail)):
        mass = 10 ** model.down[state] * outside
        for w in range(4):
            at, weight = state, 0.0
            while at * 4 + w not in model.arcs:
                weight, at = weight + model.back[at], model.fail[at]
            mass += 10 ** (weight + model.arcs[at * 4 + w][0])
        assert mass == pytest.approx(1)


def test_language_model_odd_rows(odd):
    got = lm.op5(odd).collect()
    assert len(got) == 13 and {r.doc_id: r.n_tokens for r in got if r.doc_id in (3, 4, 7, 10)} == {3: 1, 4: 1, 7: 2, 10: 5}
    assert lm.op5(odd.where("false")).count() == 0
    assert lm.lm_scores(odd, F.lit(True)).where("n_known > 0 or train_tokens > 0").count() == 0


def removal(rows, length):
    seen, out = set(), {}
    for i, text in sorted(rows):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if b[p : p + length] in seen:
                gone[p : p + length] = b"\1" * length
            else:
                seen.add(b[p : p + length])
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[i] = (len(b), sum(gone), sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1])), hashlib.sha256(kept).hexdigest())
    return out


def test_substrings(docs):
    got = {r.doc_id: r[1:5] for r in substrings.op6(docs).collect()}
    assert got == removal([(r.doc_id, r.text) for r in docs.collect()], 100)


@pytest.mark.parametrize("length", [4, 9, 20, 100])
def test_substrings_of_few_letters(spark, length):
    rng = random.Random(length)
    rows = [(k, "".join(rng.choice(["a", "b", "é"] if k % 2 else ["ab", "ba"]) for _ in range(rng.randint(0, 60)))) for k in range(40)]
    rows += [(50, None), (51, ""), (52, "a" * 250), (53, "ab" * 150), (54, rows[3][1])]
    got = substrings.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), length).collect()
    expected = removal(rows, length)
    for r in got:
        assert (r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), r.kept_sha256) == expected[r.doc_id]
        assert hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256


def test_substrings_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(substrings, "LEAST_BUCKETS", 4)
    rng = random.Random(9)
    shared = "".join(rng.choice("abcdefgh ") for _ in range(400))
    rows = [(k, "".join(rng.choice("abcdefgh ") for _ in range(50)) + shared[k : 300 + k]) for k in range(30)]
    got = {r.doc_id: r[1:5] for r in substrings.op6(spark.createDataFrame(rows, "doc_id long, text string").repartition(12)).collect()}
    assert got == removal(rows, 100)


def test_substrings_odd_rows(odd):
    got = substrings.op6(odd).collect()
    assert len(got) == 13 and {r.doc_id: r.n_bytes for r in got if r.doc_id in (3, 4, 5)} == {3: 0, 4: 0, 5: 3}
    assert next(r for r in got if r.doc_id == 1).n_removed == 0 and sum(r.n_removed == r.n_bytes > 100 for r in got) == 2
    assert substrings.op6(odd.where("false")).count() == 0


@pytest.mark.parametrize("v", [1, 2, 3, 7, 15, 31, 40, 73])
def test_difference_covers(v):
    cover = substrings.difference_cover(v).tolist()
    assert {(a - b) % v for a in cover for b in cover} == set(range(v))


def water_fill(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    rest, out, left = share * sum(sizes.values()), {}, set(order)
    while left:
        total = sum(weight[s] for s in left)
        over = [s for s in left if rest * weight[s] / total > most * sizes[s]]
        for s in over or left:
            out[s] = most * sizes[s] if over else rest * weight[s] / total
        rest -= sum(out[s] for s in over)
        left = left - set(over) if over else set()
    return out


def test_mix(docs, odd):
    for df in (docs, odd):
        got = mixing.op9(df).collect()
        source = {(r.doc_id, r.source) for r in df.collect()}
        sizes = Counter()
        for r in df.collect():
            sizes[r.source] += len(words(r.text))
        goal = water_fill(dict(sizes))
        assert len(got) == df.count() and {(r.doc_id, r.source) for r in got} == source
        taken, largest = Counter(), Counter()
        for r in got:
            assert r.source_size == sizes[r.source] and r.target == pytest.approx(goal[r.source]) and r.taken <= 2 * r["size"]
            taken[r.source] += r.taken
            largest[r.source] = max(largest[r.source], r["size"])
        assert all(abs(taken[s] - goal[s]) <= largest[s] for s in goal)
        assert sorted(map(str, got)) == sorted(map(str, mixing.op9(df.repartition(5)).collect()))
    assert mixing.op9(odd.where("false")).count() == 0


def test_mix_of_many_sources(spark, monkeypatch):
    """Weights follow the sources over several ranges, and joins without a broadcast give the same."""
    rng = random.Random(9)
    rows = [(k, " ".join("w%d" % rng.randint(0, 50) for _ in range(rng.randint(0, 30))), f"s{rng.randint(0, 250):03d}" if k % 50 else None) for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    got = sorted(map(str, mixing.op9(df).collect()))
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len(words(text))
    goal = water_fill(dict(sizes))
    assert all(r.target == pytest.approx(goal[r.source], abs=1e-5) for r in mixing.op9(df).collect())
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(map(str, mixing.op9(df).collect())) == got
    whole = mixing.mix(df, whole=True).collect()
    assert sorted(str((r.row.doc_id, r.row.text, r.row.source)) for r in whole) == sorted(map(str, rows))
    taken = {r.doc_id: r["size"] * (r.epochs + r.extra) for r in whole}
    assert taken == {r.doc_id: r.taken for r in mixing.op9(df).collect()}


def test_mix_prefers_weighty_documents(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit("a b").alias("text"))
    got = mixing.mix(df, weight=F.when(F.col("size") >= 0, 1.0), share=0.5, most=0.5).agg(F.sum(F.col("extra").cast("int"))).first()[0]
    assert got == 2000
    heavy = mixing.mix(df.withColumn("text", F.when(F.col("doc_id") < 2000, "a b c").otherwise("a b")), weight=F.when(F.col("size") == 3, 9.0).otherwise(1.0), share=0.3, most=0.3)
    sums = {r.h: r.n for r in heavy.groupBy((F.col("size") == 3).alias("h")).agg(F.sum(F.col("extra").cast("int")).alias("n")).collect()}
    assert sums[True] > 3 * sums[False]


def test_decontamination(spark, docs, sf):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    plain = lambda t: " ".join(re.findall(r"\w+", (t or "").lower()))
    texts = {r.doc_id: plain(r.text) for r in docs.collect()}
    expected = {(i, b.item_id) for b in bench.collect() for i, t in texts.items() if plain(b.text) in t}
    assert expected and {(r.doc_id, r.item_id) for r in decontamination.op10(docs, bench).collect()} == expected


def test_paraphrases_and_odd_rows(spark, docs, odd, sf):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    item = bench.where("item_id = 1").first().text.split()
    changed = [w if k % 7 else "something" for k, w in enumerate(item)]
    filler = " ".join(next(r.text for r in docs.collect() if r.n_chars > 3000).split()[:150])
    rows = [(1, f"{filler} {' '.join(changed)} {filler}"), (2, filler), (3, " ".join(sorted(item))), (4, None)]
    df = docs.select("doc_id", "text").where("doc_id >= 20").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    found = {r.doc_id for r in decontamination.op10(df, bench).where("item_id = 1").collect()}
    assert 1 in found and not {2, 3, 4} & found
    assert decontamination.op10(odd, bench).count() == decontamination.op10(odd.where("false"), bench).count() == 0
    assert decontamination.op10(docs, bench.where("false")).count() == 0
    assert decontamination.op10(docs, bench.select("item_id", F.lit(None).cast("string").alias("text"))).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=12), st.lists(st.integers(0, 3), max_size=12))
def test_common_subsequence(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert decontamination.lcs(a, b) == table[-1][-1]


def test_pipeline(spark, docs, odd, sf):
    out = corpus_pipeline.run(spark, sf)
    kept = {r.doc_id: r for r in out.collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert 0.5 * len(texts) < len(kept) <= len(texts) and all(r.copies in (1, 2) for r in kept.values())
    assert len({r.text for r in kept.values()}) == len(kept) and not any(re.search('token = "[0-9a-f]{40}"', r.text) for r in kept.values())
    for _, stage in corpus_pipeline.STAGES[:-1]:
        for df in (odd, odd.where("false")):
            assert stage(spark, df, sf).columns == odd.columns
            stage(spark, df, sf).write.format("noop").mode("overwrite").save()
    last = stages.mix_sources(spark, odd, sf)
    assert len(set(last.columns)) == len(last.columns) and last.count() > 0
    once = stages.near_dedup(spark, odd, sf)
    assert once.where("doc_id in (1, 2)").count() == 1 and once.where("doc_id is null").count() == 2


def test_language_model_keeps_every_ngram_seen_twice(spark, docs):
    """Scores are those of the automaton over all n-grams seen twice or more, and what it learns grows with the corpus."""
    rows = [(r.doc_id, lower_words(r.text)) for r in docs.select("doc_id", "text").orderBy("doc_id").collect()]
    assert max(len(w) for _, w in rows) > 3 * lm.SEGMENT
    learned = [w for i, w in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    number = {w: k for k, w in enumerate(sorted({x for t in learned for x in t}))}
    texts, width = [[number[x] for x in t] for t in learned], len(number)
    counts, pairs, triples = (Counter(g for t in texts for g in zip(*(t[k:] for k in range(n)), strict=False)) for n in (1, 2, 3))
    kept = sorted(p for p, n in pairs.items() if n >= 2)
    place = {p: k for k, p in enumerate(kept)}
    levels = [{a * width + b: pairs[a, b] for a, b in kept}, {place[a, b] * width + c: n for (a, b, c), n in triples.items() if n >= 2}]
    assert len(levels[0]) > 1000 and len(levels[1]) > 100
    total = sum(counts.values()) + len(texts)
    model = lm.Backoff(np.array([counts[w,] for w in range(width)]), total, width + 1, levels)
    size = math.log10(total + width + 2)
    got = {r.doc_id: r.score for r in lm.op5(spark.createDataFrame([(i, b" ".join(w).decode()) for i, w in rows], "doc_id long, text string").repartition(3)).collect()}
    for i, w in rows:
        # The end of a text and unknown words have no arc.
        rest = math.log10(len(texts) + 1) - size - sum(x not in number for x in w) * size
        assert got[i] == pytest.approx(model.score([number.get(x, -1) for x in w] + [-1]) + rest)


def test_decontamination_is_fitted_on_all_documents(spark, sf, monkeypatch):
    seen, basis = [], decontamination.latent_basis

    def spy(df, *rest):
        seen.append((df.count(), df.distinct().count()))
        return basis(df, *rest)

    monkeypatch.setattr(decontamination, "latent_basis", spy)
    bench = spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").orderBy("item_id").limit(2)
    many = spark.range(30_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("word number "), "id", F.lit(" of many")).alias("text"))
    copies = bench.select(F.col("item_id") + 100_000, "text")
    got = decontamination.op10(many.union(copies), bench).collect()
    assert seen == [(30_002, 30_002)] and {(r.doc_id - 100_000, r.item_id) for r in got} == {(r.item_id, r.item_id) for r in bench.collect()}


def test_the_pipeline_decontaminates_by_all_documents(spark, sf, monkeypatch):
    seen, basis = [], decontamination.latent_basis

    def spy(df, *rest):
        seen.append(df.count())
        return basis(df, *rest)

    monkeypatch.setattr(decontamination, "latent_basis", spy)
    bench = spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("item_id").alias("doc_id"), "text").orderBy("doc_id").limit(2)
    many = spark.range(1000, 31_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("word number "), "id", F.lit(" of many")).alias("text"))
    assert dict(corpus_pipeline.STAGES)["decontamination"](spark, many.union(bench), sf).count() == 30_000
    assert seen == [30_002]


def test_sums_of_the_fit_are_those_of_all_passages():
    rng = np.random.default_rng(3)
    texts = ["", None, *(" ".join(f"w{k}" for k in rng.integers(0, 300, n)) for n in (1, 63, 64, 65, 900, 9000))]
    idf = rng.random(decontamination.SLOTS).astype(np.float32)
    expected = np.zeros((decontamination.SLOTS, decontamination.CORPUS_RANK + decontamination.EXTRA))
    for text in filter(None, texts):
        slots = (decontamination._hash_text(text) >> np.uint64(64 - decontamination.SLOT_BITS)).astype(np.int64)
        for at in range(0, len(slots), decontamination.PIECE):
            own = np.unique(slots[at : at + decontamination.PIECE])
            x = idf[own].astype(float) / np.linalg.norm(idf[own].astype(float))
            expected[own] += np.outer(x, x @ decontamination._omega()[own])
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
    got = np.zeros_like(expected)
    for out in decontamination._sketcher(idf)(iter([batch, batch.slice(0, 0)])):
        for slot, row in zip(*(c.to_pylist() for c in out.columns), strict=True):
            got[slot] = np.frombuffer(row, np.float32)
    assert np.allclose(got, expected, atol=1e-3)


def test_sums_of_the_fit_leave_a_task_in_small_batches():
    words = pa.array([" ".join(f"w{k}" for k in range(at, at + 1000)) for at in range(0, 400_000, 1000)], pa.string())
    batch = pa.RecordBatch.from_arrays([words], ["text"])
    sizes = [(out.num_rows, out.nbytes) for out in decontamination._sketcher(np.ones(decontamination.SLOTS, np.float32))(iter([batch]))]
    assert sum(n for n, _ in sizes) > 0.99 * decontamination.SLOTS and max(size for _, size in sizes) < 2e6


def test_decontamination_beside_repeated_words(spark, docs, sf):
    """Items that are there word by word are found, however often one of their words is repeated around them."""
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    common = Counter(x for r in docs.collect() for x in set(lower_words(r.text)))
    items = [(b.item_id, b.text, min((w for w in b.text.split() if w.isalpha()), key=lambda w: common[w.lower().encode()])) for b in bench.orderBy("item_id").collect()]
    rows = []
    for j, (item, text, _) in enumerate(items):
        other = next(w for _, _, w in items[j + 1 :] + items if w.lower() not in text.lower())
        rows += [(10**6 + 10 * j + k, f"{(other + ' ') * n}{text} {(other + ' ') * n}", item) for k, n in enumerate((27, 66))]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"))
    matches = decontamination.benchmark_matches(df, bench).where("contaminated and doc_id >= 1000000").collect()
    assert not {(i, item) for i, _, item in rows} - {(r.doc_id, r.item_id) for r in matches}


def test_near_dedup_of_repeated_ids(spark, sf):
    """A text goes if it is a near copy itself, not because its doc_id has another one."""
    rng = random.Random(8)
    prose = lambda: " ".join(f"w{rng.randint(0, 5000)}" for _ in range(60))
    a, b, c = prose(), prose(), prose()
    rows = [(1, a), (7, a + " tail"), (7, b), (7, b), (9, b + " end"), (5, c), (5, c + " more"), (6, None), (6, prose())]
    out = stages.near_dedup(spark, spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, lang string"), sf)
    got = sorted((r.doc_id, r.text) for r in out.collect() if r.doc_id != 5 and r.doc_id != 6)
    assert got == sorted([(1, a), (7, b)])
    assert out.where("doc_id = 5").count() == 1 and out.where("doc_id = 6").count() == 2


@pytest.mark.parametrize(("length", "letters"), [(100, 40), (33, 3), (9, 2)])
def test_suffixes_of_a_bucket_are_sorted(length, letters):
    """Order and groups of a bucket's windows against sorted strings; the runs share their anchor's bytes."""
    rng = random.Random(length)
    plan = substrings.Plan(length, 0)
    anchor = bytes(rng.randrange(97, 97 + letters) for _ in range(plan.anchor))
    sides = [bytes(rng.choice([0, *range(97, 97 + letters)]) for _ in range(2 * length)) for _ in range(4)]
    texts, sizes, anchored = [], [], []
    for _ in range(60):
        before, n = rng.randint(0, length - plan.anchor), 0
        n = rng.randint(1, before + 1)
        left, right = rng.choice(sides), rng.choice(sides)
        text = left[len(left) - before :] + anchor + right
        texts.append(text[: n + length - 1])
        sizes.append(n)
        anchored.append(before)
    data, spans = np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts])
    begin = np.cumsum(spans) - spans
    run, starts, order, differs = substrings.sorted_bucket(plan, data, begin, np.array(sizes), np.array(anchored))
    windows = [bytes(data[s : s + length]) for s in starts.tolist()]
    place = [anchored[r] - (s - begin[r]) for r, s in zip(run.tolist(), starts.tolist(), strict=True)]
    in_order = [(windows[k][: 8 * plan.head_words], place[k], windows[k]) for k in order.tolist()]
    assert in_order == sorted(in_order)
    assert differs.tolist() == [k == 0 or in_order[k] != in_order[k - 1] for k in range(len(in_order))] and not differs.all()


def test_sorted_strings():
    rng = random.Random(1)
    texts = [bytes(rng.choice(b"ab\0") for _ in range(24)) for _ in range(300)] + [b"a" * 24] * 3
    table = np.frombuffer(b"".join(texts), ">u8").reshape(-1, 3).astype(np.uint64)
    order, shared, differs = substrings.sort_strings(lambda j, which: table[which, j], len(texts), 3)
    got = [texts[k] for k in order.tolist()]
    assert got == sorted(texts)
    for k in range(1, len(got)):
        same = next((i for i in range(24) if got[k][i] != got[k - 1][i]), 24)
        assert shared[k] == same and differs[k] == (same < 24)


def test_decontamination_in_very_long_texts(spark, docs, sf):
    """Every item, planted once in a text of 300,000 words, is found, at its place."""
    bench = spark.read.parquet(f"{sf}/benchmark.parquet").where("item_id < 40")
    prose = " ".join(r.text or "" for r in docs.orderBy("doc_id").collect()).split()
    items = bench.orderBy("item_id").collect()
    text, at = [], {}
    for k, b in enumerate(items):
        text += (prose * 3)[k * 997 : k * 997 + 7500]
        at[b.item_id] = len(decontamination._hash_text(" ".join(text)))
        text += b.text.split()
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(10**6, " ".join(text)), (10**6 + 1, None)], "doc_id long, text string"))
    got = {r.item_id: r for r in decontamination.op10(df, bench).where("doc_id >= 1000000").collect()}
    assert set(at) <= set(got) and all(r.lcs >= 0.99 for i, r in got.items() if i in at)


def test_recall_of_the_cosine_gate(spark, docs, sf, monkeypatch):
    """Against subsequences in every passage: paraphrased items in long texts; and the benchmark in several passes."""
    rng = random.Random(6)
    bench = spark.read.parquet(f"{sf}/benchmark.parquet").where("item_id < 60")
    prose = [w for r in docs.orderBy("doc_id").collect() for w in (r.text or "").split()]
    some = lambda n: prose[(at := rng.randrange(len(prose) - n)) : at + n]
    rows = []
    for k, b in enumerate(bench.orderBy("item_id").collect()):
        changed = []
        for w in b.text.split():
            changed += some(1) if rng.random() < 0.12 else [w] if rng.random() > 0.04 else [w, *some(1)]
        rows.append((10**6 + k, " ".join([*some(rng.randint(0, 300)), *changed, *some(rng.randint(0, 300))])))
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    pieces = [(b.item_id, p.tolist()) for b in bench.collect() for p in decontamination.pieces_of(decontamination._hash_text(b.text))]
    sure = set()
    for r in df.collect():
        words = decontamination._hash_text(r.text or "").tolist()
        for at in range(0, max(1, len(words) - decontamination.STRIDE), decontamination.STRIDE):
            window = words[max(0, at - decontamination.STRIDE) : at + decontamination.PIECE + decontamination.STRIDE]
            there = set(window)
            for item, piece in pieces:
                need = decontamination.LCS_SURE * len(piece)
                if sum(w in there for w in piece) >= need and decontamination.lcs(piece, window) >= need:
                    sure.add((r.doc_id, item))
    got = {(r.doc_id, r.item_id) for r in decontamination.benchmark_matches(df, bench).where("contaminated").collect()}
    assert sum(i >= 10**6 for i, _ in sure) > 30 and len(sure & got) >= 0.97 * len(sure)
    monkeypatch.setattr(decontamination, "PIECES_AT_ONCE", 25)
    assert {(r.doc_id, r.item_id) for r in decontamination.benchmark_matches(df, bench).where("contaminated").collect()} == got


def test_latent_directions_are_cut(spark, docs, sf):
    items = [(r.item_id, decontamination._hash_text(r.text), set()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()] * 4
    bench = decontamination.Benchmark([(i, np.roll(w, k) + np.uint64(k << 48), a) for k, (i, w, a) in enumerate(items)])
    idf = np.ones(decontamination.SLOTS, np.float32)
    basis = decontamination.latent_basis(docs.select("text").coalesce(2), bench, idf)
    assert basis.shape[1] == decontamination.RANK < len(bench.words)
    assert np.abs(basis.T @ basis - np.eye(basis.shape[1])).max() < 1e-2


def test_stages_on_few_and_odd_columns(spark, sf):
    """Tables of doc_id and text only, with a map column, and contaminated rows without doc_id."""
    text = spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").first().text
    prose = " ".join(f"w{k}" for k in range(60))
    few = spark.createDataFrame([(1, prose), (1, prose), (2, prose + " x"), (None, text), (None, prose), (3, text), (3, prose[:120])], "doc_id long, text string")
    for df in (few, few.withColumn("key", F.create_map(F.lit("a"), F.col("text")))):
        kept = stages.near_dedup(spark, df, sf)
        assert kept.columns == df.columns and sorted((r.doc_id or 0, r.text) for r in kept.collect()) == sorted([(1, prose), (0, text), (0, prose), (3, text), (3, prose[:120])])
        clean = stages.decontaminate(spark, df, sf)
        assert clean.columns == df.columns and sorted((r.doc_id or 0, r.text) for r in clean.collect()) == sorted([(1, prose), (1, prose), (2, prose + " x"), (0, prose), (3, prose[:120])])
        for stage in (stages.quality_rules, stages.redact_secrets):
            assert stage(spark, df, sf).count() == 7


def test_pipeline_by_brute_force(spark, docs, sf):
    """What each stage keeps, restated over its own input: near copies by all pairs, passages word by word, sizes and targets."""
    plain = lambda t: " ".join(re.findall(r"\w+", (t or "").lower()))
    good = stages.quality_rules(spark, docs, sf)
    rows = {r.doc_id: r for r in docs.collect()}
    ids = {r.doc_id for r in good.collect()}
    assert all(len(words(rows[i].text)) >= 10 for i in ids)
    shingles = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i in ids for w in [lower_words(rows[i].text)]}
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    order = sorted(ids)
    for a in order:
        for b in order:
            both = len(shingles[a] & shingles[b]) if a < b else 0
            if both and 5 * both >= 4 * (len(shingles[a]) + len(shingles[b]) - both):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    once = stages.near_dedup(spark, good, sf)
    kept = {r.doc_id for r in once.collect()}
    assert kept == {find(i) for i in ids} and len(kept) < len(ids)
    items = [plain(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = {r.doc_id for r in stages.decontaminate(spark, once, sf).collect()}
    assert clean == {i for i in kept if not any(x in plain(rows[i].text) for x in items)}
    mixed = stages.mix_sources(spark, once.where(F.col("doc_id").isin(list(clean))), sf).collect()
    sizes = Counter()
    for i in clean:
        sizes[rows[i].source] += len(words(rows[i].text))
    goal, taken = water_fill(dict(sizes)), Counter()
    for r in mixed:
        assert r.size == len(words(rows[r.doc_id].text)) and 1 <= r.copies <= 2
        taken[r.source] += r.size * r.copies
    largest = {s: max(len(words(rows[i].text)) for i in clean if rows[i].source == s) for s in goal}
    assert all(abs(taken[s] - goal[s]) <= largest[s] for s in goal)
