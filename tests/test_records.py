"""Posts, files, rebuilds and recommendations on small invented rows."""

import json

import pytest
from pyspark.sql import functions as F

from lumenweft import fixed
from lumenweft.functions import text as T
from lumenweft.operators import build, listings, recommend
from lumenweft.plans import retrieval
from lumenweft.sources import files


def test_identity_tiers(spark):
    rows = [("http://a", "", "t", "x"), ("", "http://a", "t", "x"), ("", "", " t ", "x"), ("", "", "t", "x"), ("", "", "", "x")]
    df = spark.createDataFrame(rows, "postUrl string, link string, text string, author string")
    ids = [r[0] for r in df.select(listings.identity(df)).collect()]
    assert ids[0] == "postUrl:http://a" and ids[1] == "link:http://a" and ids[2] == ids[3] and ids[2].startswith("fallback:") and ids[4].startswith("row:")


def test_keep_first_and_last(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "n long, k string")
    assert sorted(r.n for r in listings.keep_first(df, F.col("k"), "n").collect()) == [1, 3]
    assert sorted(r.n for r in listings.keep_first(df, F.col("k"), "n", last=True).collect()) == [2, 3]


def test_dedup_comes_before_the_filter(spark):
    good = "Rent: ₹12,000 for a 2 BHK, shared washroom\nSociety: Hill View\ncall +91 9876543210, 9876543210"
    rows = [(1, "p", "1 July 2026", "u", "rejected", "f"), (2, "p", "2 July 2026", "u", good, "f"), (3, "q", "3 August 2026", "", good, "f"), (4, "q", "3 May 2026", "v", good, "f"), (5, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "n long, author string, timestamp string, postUrl string, text string, source_file string")
    (r,) = listings.filter_listings(df, "n").collect()
    assert (r.poster_name, r.bhk, r.private_bathroom, r.google_map_location, r.room_rent_including_maintenance_inr) == ("q", "2BHK", "Shared", "Hill View", 12000)
    assert r.contact_number == "+91 9876543210, 9876543210"


def test_merge_defaults_depend_on_the_match(spark):
    base = spark.createDataFrame([(1, "A · Follow", "l1", None, "1,000", "any"), (2, "B", "l1", "x", "2", ""), (3, "C", "l2", None, "3,500", None)], "ordinal long, poster string, link string, bath string, rent string, gender string")
    detail = spark.createDataFrame([(1, "l1", "old", "b", "n", "c"), (2, "l1", "", None, "n2", "c2")], "ordinal long, link string, place string, bathroom string, needs string, contact string")
    rows = {r.link: r for r in listings.merge_listings(base, detail).collect()}
    assert (rows["l1"].poster_name, rows["l1"].place, rows["l1"].bathroom, rows["l1"].needs, rows["l1"].rent) == ("A", "", "", "n2", "1000")
    assert (rows["l2"].place, rows["l2"].bathroom, rows["l2"].contact) == ("Not available", "Not stated", "N/A")
    assert listings.merge_listings(base, detail, keep_commas=True).where("link = 'l2'").first().rent == "3,500"


def test_texts(spark):
    df = spark.createDataFrame([("Story.</div>\n\n--- Metadata: tail\nmore",), ("x" * 10,), (None,)], "s string")
    assert [r[0] for r in df.select(T.preview(F.col("s"), 8)).collect()] == ["Story.", "xxxxxxxx…", ""]
    with pytest.raises(ValueError):
        T.preview(F.col("s"), 0)
    assert spark.range(1).select(T.squeeze(F.lit(" a\x1c b\x85c "))).first()[0] == "a b c"
    urls = ["https:///a.mp3", "https://h/a.zip", "https://h/a.MP3?q=1", "ftp://h/a.mp3", None]
    got = spark.createDataFrame([(u,) for u in urls], "u string").select(T.playable(F.col("u"))).collect()
    assert [r[0] for r in got] == [False, False, True, False, False]
    words = [("", "drama story mood"), ("Sea", "sea story mood"), ("Sea sky", "sea sky mood"), ("a Sea sea it's x", "sea it's mood")]
    got = spark.createDataFrame(words, "t string, e string").select(F.array_join(T.fallback_keywords(F.col("t")), " "), "e").collect()
    assert all(r[0] == r[1] for r in got)
    assert spark.createDataFrame([("A", "sum"), (" ", "sum"), ("A", None)], "t string, s string").select(T.speech(F.col("t"), F.col("s"))).collect()[1][0] == "This story. sum"


def test_features(spark):
    full = {a: 0.5 for a in fixed.AXES}
    rows = [("p", ["A ", "b", "c", "d", "e"], full), (" ", ["a"] * 5, full), ("p", ["a"] * 4, full), ("p", ["a"] * 4 + [" "], full), ("p", ["a"] * 5, full | {"hope": 1.1}), ("p", ["a"] * 5, full | {"x": 0.1}), ("p", ["a"] * 5, {"hope": 0.1}), (None, None, None)]
    df = spark.createDataFrame(rows, "p string, k array<string>, s map<string,double>")
    good, _, words, _ = build.clean_features(F.col("p"), F.col("k"), F.col("s"))
    got = df.select(good, words).collect()
    assert [r[0] for r in got] == [True] + [False] * 7 and got[0][1] == ["a", "b", "c", "d", "e"]


def test_incremental_keeps_the_last_of_a_hash(spark):
    source = spark.createDataFrame([(1, "h1"), (2, "h1"), (3, "h2"), (4, "h3")], "ordinal long, hash string")
    prior = spark.createDataFrame([("h1", 1, "a"), ("h1", 2, "b")], "hash string, ordinal long, payload string")
    saved = spark.createDataFrame([("h1", 1, "x"), ("h2", 1, "y")], "hash string, ordinal long, payload string")
    rows = {r.ordinal: (r.status, r.payload) for r in build.incremental(source, prior, saved).collect()}
    assert rows == {1: ("reused", "b"), 2: ("reused", "b"), 3: ("cached", "y"), 4: ("pending", None)}


def test_only_matching_stores_are_reused(spark):
    prior = spark.createDataFrame([("a", 1, [3.0, 4.0]), ("b", 2, [0.0, 0.0]), ("c", 3, [1.0]), (None, 4, [1.0, 0.0])], "hash string, ordinal long, payload array<float>")
    meta = {"version": 1, "model": "m", "width": 2}
    (row,) = build.reusable(prior, meta, 1, "m", 2).collect()
    assert row.hash == "a" and [round(x, 6) for x in row.payload] == [0.6, 0.8]
    assert build.reusable(prior, meta, 1, "other", 2).count() == build.reusable(prior, None, 1, "m", 2).count() == 0


def test_currency(spark):
    store = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8])], "id long, v array<float>")
    meta = spark.createDataFrame([("f", 2)], "fingerprint string, n long")
    assert build.store_is_current(store, meta, "f", "id", "v").first().current
    assert not build.store_is_current(store, meta, "g", "id", "v").first().current
    assert not build.store_is_current(store.union(store), meta, "f", "id", "v").first().current
    assert build.fingerprint(a=1, b="x") == build.fingerprint(b="x", a=1)


def test_recommendations(spark):
    c = spark.createDataFrame([(1, "r1", "One", ["Sea", " "], "", "http://z"), (2, "r2", "One", [], "http://a", "")], "position long, record_id string, title string, keywords array<string>, audio_url string, audio_zip_url string")
    row = recommend.fallback(c, "quiet").first()
    assert row.recommended_record_id == "r1" and row.audio_url == "http://z" and row.emotional_match_reasons == ["It matches your request for quiet.", "Its themes include sea."]
    answers = spark.createDataFrame([(1, "r2", " p ", ["a", " "]), (2, "r9", "p", ["a"]), (3, "r1", "p", [" "]), (4, "r1", "x" * 521, ["a"]), (5, "r1", None, None)], "request_id long, record_id string, pitch string, reasons array<string>")
    got = {r.request_id: r for r in recommend.resolve(c, answers).collect()}
    assert [got[k].valid for k in range(1, 6)] == [True, False, False, False, False] and got[1].audio_url == "http://a" and got[1].emotional_match_reasons == ["a"]
    for ids in ([], ["a"] * 2, list("abcdef"), [" "]):
        with pytest.raises(ValueError):
            recommend.check_candidates("p", ids)
    assert recommend.parse_object('```json\n{"a": {"b": 1}} and more```') == {"a": {"b": 1}}
    assert recommend.clean_intent({"keywords": ["A", "b ", "C"], "query": ""}, "text") == {"intent": "story search", "keywords": ["a", "b", "c"], "query": "text", "user_input": "text"}
    for bad in ({"keywords": ["a", "b", " "]}, {"keywords": ["a"]}, {}):
        with pytest.raises(ValueError):
            recommend.clean_intent(bad, "t")


def test_cleaned_intents_as_one_by_one(spark):
    def one(said, asked):
        try:
            found = recommend.clean_intent(recommend.parse_object(said or ""), asked or "")
            return tuple(found[k] for k in ("intent", "keywords", "query", "user_input"))
        except ValueError:
            return None

    good = '{"intent": " Find ", "keywords": ["A", "b ", "C\u00a0"], "query": " q "}'
    said = [
        good, f"```json\n{good}\n```", f"Here: {good} and {{more}}", f"{good}}}", "no object", None, "", "{", "use {this}: " + good,
        '{"keywords": ["a", "b", " "]}', '{"keywords": ["a", "b", 3]}', '{"keywords": ["a", "b", null]}', '{"keywords": "a b c"}', '{"keywords": ["a", "b"]}', "{}",
        '{"keywords": ["a", "b", "c", " "]}', '{"keywords": ["1", "2", "3", "4", "5", "6", "7", "8", "9"]}', '{"intent": 5, "keywords": ["x", "y", "z"], "query": "\\"}"}', '{"a": {"b": [1, {"c": "}"}]}, "keywords": ["É", "y", "z"]} {',
    ]
    df = spark.createDataFrame([(k, s, None if k % 5 == 4 else f" t{k}") for k, s in enumerate(said)], "k int, said string, asked string")
    out = recommend.cleaned_intents(df, "said", "asked")
    assert "Arrow" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r.k: r.result and tuple(r.result) for r in out.collect()}
    assert got == {r.k: one(r.said, r.asked) for r in df.collect()}


def test_json_arrays(spark, tmp_path):
    def read(text):
        (tmp_path / "x.json").write_bytes(text.encode())
        spark.catalog.clearCache()
        return files.read_json_array(spark, f"{tmp_path}/x.json", "a long").collect()

    assert [r.a for r in read('﻿[{"a": 1},\n {"a": 2}]')] == [1, 2]
    for bad in ("", "  \n", '{"a": 1}', '[{"a": 1},]', '[{"a": 1} {"a": 2}]', '[{"a": 1}', '[{"a": 1}] x'):
        with pytest.raises(Exception):  # noqa: B017  ours or the reader's
            read(bad)


def test_folder_to_sinks(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿author,postUrl\n"x, ""q""\nz",u1\ny,u2\n')
    (tmp_path / "b.JSON").write_text(json.dumps({"meta": 1, "posts": [{"author": "w", "postUrl": "u1", "n": 5}, {"author": None, "postUrl": "", "text": "é<"}]}))
    (tmp_path / "c.json").write_text("[1, ")
    (tmp_path / "d.txt").write_text("no")
    rows = retrieval.combine_exports(spark, str(tmp_path))
    assert rows.columns[:4] == ["author", "postUrl", "text", "source_file"] and rows.columns[4:] == ["n"]
    table = rows.orderBy("source_file", "postUrl")
    assert [(r.author, r.source_file) for r in table.collect()] == [('x, "q"\nz', "a.csv"), ("y", "a.csv"), ("", "b.JSON")]
    files.write_bytes(spark, f"{tmp_path}/out/x.csv", b"1")
    assert (tmp_path / "out" / "x.csv").read_bytes() == b"1"


def test_folder_names_what_it_leaves_out(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x\n1\n")
    (tmp_path / "b.json").write_text("[1, ")
    left_out = []
    assert files.read_folder(spark, str(tmp_path), lambda name, why: left_out.append(name)).count() == 1 and left_out == ["b.json"]
    with pytest.warns(UserWarning, match="b.json"):
        files.read_folder(spark, str(tmp_path))
    with pytest.raises(Exception):  # noqa: B017  transient and access failures are not the file's own
        files.list_files(spark, str(tmp_path / "nowhere"))


def test_folder_in_one_scan(spark, tmp_path, monkeypatch):
    for k in range(120):
        (tmp_path / f"f {k:03d}+é.json").write_text(json.dumps([{"a": k, f"k{k % 3}": {"x": [1, None]}}, {"a": None, "b": 1.5}], indent=k % 2 * 2 or None))
        (tmp_path / f"g{k:03d}.csv").write_text(f"a,,a,k{k % 2}\n{k},x,y\n\n\"1,\n2\",3,4,5,6\n")
    (tmp_path / "h.csv").write_text("")
    (tmp_path / "i.csv").write_text("only,header\n")
    for name, text in (("j.json", "[1, 2]"), ("k.json", '{"results": []}'), ("l.json", "{"), ("m.json", '{"b": true, "results": 3}')):
        (tmp_path / name).write_text(text)
    left_out = []
    rows = files.read_folder(spark, str(tmp_path), lambda name, why: left_out.append(name))
    assert left_out == ["h.csv", "j.json", "k.json", "l.json"]
    assert set(rows.columns) == {"a", "b", "k0", "k1", "k2", "_c1", "a2", "only", "header", "results", "source_file", "ordinal"}
    got = sorted((r.ordinal, r.source_file, r.a, r.b, r.k1, r._c1) for r in rows.collect())
    assert len(got) == 120 * 4 + 1 and len({o for o, *_ in got}) == len(got)
    assert got[2][1:] == ("f 001+é.json", "1", "", '{"x":[1,null]}', "") and got[3][1:] == ("f 001+é.json", "", "1.5", "", "")
    assert ("g001.csv", "1,\n2", "", "5", "3") in {r[1:] for r in got} and got[-1][1:] == ("m.json", "", "true", "", "")
    plan = files.folder_rows(spark, str(tmp_path))[0]._jdf.queryExecution().analyzed().toString()
    assert plan.count("Relation") == 1
    # Large files by ranges: the same rows in the same order.
    monkeypatch.setattr(files, "WHOLE_BYTES", 10)
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "f.json").write_text((tmp_path / "f 001+é.json").read_text())
    (tmp_path / "one" / "bad.json").write_text("[1, 2, 3, 4,]")
    left_out.clear()
    large = files.read_folder(spark, f"{tmp_path}/one", lambda name, why: left_out.append(f"{name} {why}"))
    assert [(r.a, r.b, r.k1) for r in large.orderBy("ordinal").collect()] == [("1", "", '{"x":[1,null]}'), ("", "1.5", "")]
    assert len(left_out) == 1 and left_out[0].startswith("bad.json trailing comma")


def test_blanks_of_all_kinds(spark):
    nbsp = "\u00a0"
    posts = [(1, "a", f"1 July{nbsp}2026", "u1", f"Rent{nbsp}: ₹9,000 2{nbsp}BHK Location:{nbsp}Hill{nbsp}", "f"), (2, "b", "1 July 2026", "", "Rent: 9,000 3 BHK", "f"), (3, "b", "1 July 2026", None, "Rent: 9,000 3 BHK", "f")]
    df = spark.createDataFrame(posts, "n long, author string, timestamp string, postUrl string, text string, source_file string")
    got = {r.post_link: r for r in listings.filter_listings(df.withColumn("Post URL", F.when(F.col("n") > 1, F.concat(F.lit("p"), F.col("n").cast("string")))), "n").collect()}
    assert set(got) == {"u1", "p2", "p3"} and got["u1"].google_map_location == "Hill" and got["u1"].bhk == "2BHK"
    assert listings.filter_listings(df, "n").count() == 2
    assert spark.range(1).select(T.stable_id(F.lit("\n\u00a0\x1c"), F.lit(None), F.lit(1), F.lit("t"), F.lit("s"))).first()[0].startswith("story-1-")
    good, *_ = build.clean_features(F.lit("\n\u2003"), F.array(*[F.lit("a")] * 5), F.create_map(*(x for a in fixed.AXES for x in (F.lit(a), F.lit(0.5)))))
    assert spark.range(1).select(good).first()[0] is False


def test_chosen_or_first(spark):
    c = spark.createDataFrame([(2, "b"), (1, "a"), (3, "c")], "position long, record_id string")
    assert [recommend.chosen_or_first(c, i).first().record_id for i in ("c", "z")] == ["c", "a"] and recommend.chosen_or_first(c.where("false"), "a").count() == 0
    answers = spark.createDataFrame([(1, "b"), (2, "z"), (3, None)], "request_id long, record_id string")
    assert {r.request_id: r.record_id for r in recommend.chosen_or_first_each(c, answers).collect()} == {1: "b", 2: "a", 3: "a"}


def test_embedding_answers_must_match(spark):
    df = spark.createDataFrame([("a",), ("b",)], "t string")
    assert all(abs(sum(x * x for x in r.embedding) - 1) < 1e-5 for r in build.embed(df, "t", build.stub_embedder()).collect())
    with pytest.raises(Exception, match="match"):
        build.embed(df.coalesce(1), "t", lambda texts: [[1.0]]).collect()
    kept = build.embed(df.coalesce(1), "t", lambda texts: [[1.0]], keep_errors=True).collect()
    assert all(r.embedding is None and "match" in r.embedding_error for r in kept)
    swapped = build.embed(df.coalesce(1), "t", lambda texts: [(1, [0.0, 2.0]), (0, [3.0, 0.0])]).collect()
    assert {r.t: r.embedding for r in swapped} == {"a": [1.0, 0.0], "b": [0.0, 1.0]}
