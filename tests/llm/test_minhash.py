import itertools
from collections import Counter

import numpy as np
import pytest

from lumenweft.llm import components, minhash
from tests.llm.conftest import lower_words


def shingles(text, k):
    w = lower_words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def by_pairs(rows, k, num, den):
    """component of each doc_id, all pairs compared."""
    sets, parent = {}, {}
    for i, t in rows:
        sets.setdefault(i, []).append(shingles(t, k))
        parent[i] = i

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if any(x and y and den * len(x & y) >= num * len(x | y) for x in sets[a] for y in sets[b]):
            u, v = sorted((find(a), find(b)))
            parent[v] = u
    return {i: find(i) for i in parent}, {i: [len(s) for s in v] for i, v in sets.items()}


@pytest.mark.parametrize(("k", "num", "den"), [(3, 85, 100), (5, 4, 5)])
def test_against_all_pairs(docs, k, num, den):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    expected, sizes = by_pairs(rows, k, num, den)
    got = minhash.near_duplicates(docs, k, num, den).collect()
    assert {r.id: r.component_id for r in got} == expected and len(got) == len(rows)
    assert all(r.n_shingles in sizes[r.id] and r.kept == (r.id == r.component_id) for r in got)


def test_a_chain_of_near_copies_is_one_component(spark):
    base = [f"w{i}" for i in range(200)]
    rows = [(100, " ".join(base))]
    for k in range(1, 12):  # each copy changes one more word: neighbours are similar, the ends are not
        base[k * 15] = f"c{k}"
        rows.append((100 - k, " ".join(base)))
    got = minhash.op1(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == by_pairs(rows, 3, 85, 100)[0] == dict.fromkeys(range(89, 101), 89)


def test_odd_rows(odd):
    got = minhash.op1(odd).collect()
    assert len(got) == 13
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[1].component_id == by[2].component_id == by[9].component_id == 1 and by[7].component_id == by[8].component_id == 7
    assert [by[k].n_shingles for k in (3, 4, 5, 7)] == [0, 0, 0, 1] and all(by[k].kept for k in (3, 4, 5))
    assert all(r.kept and r.component_id is None for r in got if r.doc_id is None)
    assert minhash.op1(odd.where("false")).count() == 0


def test_block_comparison_counts_exactly():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 40, 30)).astype(np.uint64) for _ in range(25)]
    groups = rng.integers(0, 20, 25)
    expected = {(i, j) for i, j in itertools.combinations(range(25), 2) if groups[i] != groups[j] and 4 * len(np.union1d(sets[i], sets[j])) <= 5 * len(np.intersect1d(sets[i], sets[j]))}
    assert set(minhash.linked_pairs(sets, groups, np.zeros(25), 4, 5)) == expected


def test_lists_that_meet_by_chance_make_no_family(spark, monkeypatch):
    # Halves that stand in two texts each: every text shares posting lists with two others and is like none.
    half = lambda k: " ".join(f"h{k}w{i}" for i in range(150))
    rows = [(k, f"{half(k)} {half((k + 1) % 300)}") for k in range(300)] + [(1000, f"{half(7)} x {half(8)}")]
    sizes, store = {}, minhash.materialize

    def spy(df, name):
        out = store(df, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(minhash, "materialize", spy)
    got = minhash.op1(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {k: 7 if k == 1000 else k for k, _ in rows}
    assert sizes["prefix"] > 600 and sizes["apart"] == 0 and sizes["texts"] == 2


def test_signatures_in_many_blocks(docs, monkeypatch):
    monkeypatch.setattr(minhash, "SIGNATURE_LOAD", minhash.BLOCK_LOAD // 2)
    monkeypatch.setattr(minhash, "MATRIX_BYTES", 8)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert {r.doc_id: r.component_id for r in minhash.op1(docs).collect()} == by_pairs(rows, 3, 85, 100)[0]


@pytest.mark.parametrize("two", [False, True])
def test_agreeing_signatures_connect_all_that_agree(two):
    rng = np.random.default_rng(4)
    rows, groups, sides = rng.integers(0, 4, (60, 16)).astype(np.int8), rng.integers(0, 40, 60), rng.integers(0, 2, 60) if two else np.zeros(60, int)
    agree = {(i, j) for i, j in itertools.combinations(range(60), 2) if (rows[i] == rows[j]).sum() >= 8 and groups[i] != groups[j] and (not two or sides[i] != sides[j])}

    def classes(pairs):
        label = groups.copy()
        for _ in range(60):
            for i, j in pairs:
                label[(label == label[i]) | (label == label[j])] = min(label[i], label[j])
        return label.tolist()

    got = minhash.linking_signatures(rows, groups, sides, 8)
    assert {tuple(sorted(p)) for p in got} <= agree and classes(got) == classes(agree) and len(got) < 40 and len(agree) > 20


@pytest.mark.parametrize("seed", range(3))
def test_components_of_random_edges(spark, seed):
    rng = np.random.default_rng(seed)
    edges = [tuple(int(x) for x in e) for e in rng.integers(0, 60, (45, 2))]
    parent = {n: n for e in edges if e[0] != e[1] for n in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        if u != v:
            a, b = sorted((find(u), find(v)))
            parent[b] = a
    got = components.components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {r.node: r.component for r in got} == {n: find(n) for n in parent} and len(got) == len(parent)


def test_components(spark):
    edges = [(k, k + 1) for k in range(60)] + [(200, 100), (100, 150), (7, 7)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert Counter(got.values()) == {0: 61, 100: 3}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0
