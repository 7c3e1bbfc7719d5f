"""JSON arrays read by ranges: every cut gives the same elements, every error its name."""

import json
import random

import numpy as np
import pyarrow as pa
import pytest

from lumenweft.sources import arrays, files
from lumenweft.sources.arrays import ESCAPED, INSIDE, OUTSIDE


def states(data, state):
    """Sign by sign."""
    inside = []
    for c in data:
        was = state
        if state == ESCAPED:
            state = INSIDE
        elif state == INSIDE:
            state = ESCAPED if c == 0x5C else OUTSIDE if c == 0x22 else INSIDE
        elif c == 0x22:
            state = INSIDE
        inside.append(was != OUTSIDE or state != OUTSIDE)
    return inside, state


def test_automaton_from_every_state():
    rng = random.Random(1)
    for n in [0, 1, 2, 3, 5, 9, 40] * 60:
        # A backslash stands in strings only, or the text is no JSON anyway.
        data, now = bytearray(), rng.choice([OUTSIDE, INSIDE, ESCAPED])
        begin = now
        for _ in range(n):
            c = rng.choice(b'"a{}[],"' if now == OUTSIDE else b'"\\\\a"{}\\')
            data.append(c)
            now = states([c], now)[1]
        inside, end = arrays.strings(np.frombuffer(bytes(data), np.uint8), begin)
        assert (inside.tolist(), end) == states(data, begin), (bytes(data), begin)


def cut_up(text, at):
    """Elements by way of ranges cut behind some braces, as a file's ranges are."""
    raw = text.encode()
    pieces = raw.split(b"}")
    rows, start, begin = [], 0, 0
    for k, p in enumerate(pieces):
        if k in at:
            start = begin
        if k < len(pieces) - 1 or p:
            rows.append((p, "f", start))
        begin += len(p) + 1
    batches = [pa.RecordBatch.from_arrays([pa.array([r[j] for r in some], t) for j, t in enumerate((pa.binary(), pa.string(), pa.int64()))], ["value", "path", "start"]) for some in (rows[i : i + 3] for i in range(0, len(rows), 3))]
    begins, state, depth, seen = {}, OUTSIDE, 0, 0
    for m in (b.to_pylist()[0] for b in arrays._maps(iter(batches))):
        begins.setdefault((m["path"], m["start"]), (state, depth, len(raw) - seen, seen == 0))
        depth, state, seen = depth + m["deltas"][state], m["ends"][state], seen + m["size"]
    out, held = [], b""
    for r in (r for b in arrays._pieces(begins)(iter(batches)) for r in b.to_pylist()):
        assert r["error"] is None
        held = r["text"] if r["opens"] else held + r["text"]
        if r["closes"]:
            out.append(held.decode())
    return out


def test_any_cut_gives_the_same_elements():
    rng = random.Random(4)
    value = lambda d: rng.choice([1, "}", 'a"}{[\\', "é{", None, [], {}, {"k": "\\\\"}]) if d == 0 else {rng.choice(["a", "b}", 'c"']): value(d - 1), "n": [value(d - 1)]}
    for _ in range(60):
        rows = [value(rng.choice([0, 1, 2])) for _ in range(rng.choice([1, 2, 7]))]
        text = json.dumps(rows, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 2])) + rng.choice(["", "\n", "  "])
        n = text.count("}") + 1
        for at in (set(), set(range(n)), set(rng.sample(range(n), n // 2))):
            assert [json.loads(x) for x in cut_up(text, at)] == rows


def test_one_file_by_many_tasks(spark, tmp_path, monkeypatch):
    rows = [{"a": k, "text": f'{{"x\\ {k} }}] é ' * 8} for k in range(4000)]
    for name, indent in (("flat", None), ("pretty", 2)):
        (tmp_path / f"{name}.json").write_text("﻿" + json.dumps(rows, ensure_ascii=False, indent=indent))
        before = spark.conf.get("spark.sql.files.maxPartitionBytes")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
        try:
            found = arrays.elements(spark, f"{tmp_path}/{name}.json")
            assert found.select("start").distinct().count() > 5
            got = files.read_json_array(spark, f"{tmp_path}/{name}.json")
            assert got.dtypes == [("a", "bigint"), ("text", "string")]
            assert sorted(tuple(r) for r in got.collect()) == [(r["a"], r["text"]) for r in rows]
            first = [json.loads(r.value)["a"] for r in found.orderBy("start", "nth").collect()]
            assert first == list(range(4000))
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)


ERRORS = {
    "empty": ["", "\ufeff \n"],
    "not an array": ['{"a": 1}', "}"],
    "unclosed": ['[{"a": 1}', '[{"a": "x]}'],
    "trailing data": ['[{"a": 1}] x', '[{"a": 1}] }'],
    "trailing comma": ['[{"a": 1},]'],
    "missing value": ['[,{"a": 1}]'],
    "missing comma": ['[{"a": 1} {"a": 2}]', '["a" "b"]'],
    "malformed": ['[{"a" 1}]'],
}


@pytest.mark.parametrize("kind", sorted(ERRORS))
def test_errors_have_names(spark, tmp_path, kind):
    for k, text in enumerate(ERRORS[kind]):
        path = tmp_path / f"{k}.json"
        path.write_bytes(text.encode())
        with pytest.raises(arrays.ArrayError) as raised:
            files.read_json_array(spark, str(path), "a long")
        assert raised.value.kind == kind, text


def test_blanks_around_an_array_are_no_element(spark, tmp_path):
    for k, (text, rows) in enumerate({" \n[] \n ": [], ' [{"a": 1}] \n\t': [(1,)], '\n [{"a": 1}, {"a": 2}]\n': [(1,), (2,)]}.items()):
        (tmp_path / f"{k}.json").write_text(text)
        assert sorted(tuple(r) for r in files.read_json_array(spark, f"{tmp_path}/{k}.json", "a long").collect()) == rows, text


def test_arrays_without_rows_or_objects(spark, tmp_path):
    (tmp_path / "none.json").write_text(" [ \n ] ")
    assert files.read_json_array(spark, f"{tmp_path}/none.json", "a long").collect() == []
    (tmp_path / "scalars.json").write_text('[1, "a, b", null, [2, {"c": "}"}], true]')
    assert [json.loads(r.value) for r in arrays.elements(spark, f"{tmp_path}/scalars.json").orderBy("start", "nth").collect()] == [1, "a, b", None, [2, {"c": "}"}], True]
