"""Every keyed query and its DuckDB twin, over the supplied tables.

A vector store, a catalog, posts and listings are derived from ``embeddings`` and ``documents`` in the same way here and
in SQL. All queries read whole tables; a limit stands only where the operator is a top-k.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenweft import fixed
from lumenweft.functions import text as T
from lumenweft.functions import vectors as V
from lumenweft.operators import build, listings, mood, phrases, recommend, search
from lumenweft.plans import assistant, audio, clustered, inverted, retrieval
from lumenweft.plans import store as stores
from lumenweft.plans import stories as story_plans
from lumenweft.session import hadoop_path, scratch
from lumenweft.sources import files, settings, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def six(c: Column) -> Column:
    return F.round(c, 6)


# --- derived tables -------------------------------------------------------------------------------------------------

_STOP = ", ".join(f"'{w}'" for w in fixed.STOPWORDS)
_AXES = ", ".join(f"'{a}'" for a in fixed.AXES)


def _terms(x: str) -> str:
    return f"list_filter(regexp_extract_all(lower({x}), '[a-z0-9]{{3,}}'), lambda t: not list_contains([{_STOP}], t))"


def _vector(values: dict[str, float], default: float = 0.5) -> str:
    return "[" + ", ".join(f"{values.get(a, default)!r}::double" for a in fixed.AXES) + "]"


_CATALOG = f"""catalog as (
  select e.vec_id as id, (['movie', 'book', 'podcast', 'game', 'music'])[e.label % 5 + 1] as type,
    list_transform(range(1, 13), lambda i: greatest(0.0::double, least(1.0::double, 0.5::double + e.embedding[i]::double))) as mood,
    coalesce(d.themes, []) as themes
  from embeddings e left join (
    select doc_id, list_filter(ts, lambda x, i: list_position(ts, x) = i)[1:3] as themes
    from (select doc_id, ({_terms("coalesce(text, '')")})[1:12] as ts from documents)) d on d.doc_id = e.vec_id)"""

_COSINE = "case when sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})) = 0 then 0.0 else list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b}))) end"


def cosine_sql(a: str, b: str) -> str:
    return _COSINE.format(a=a, b=b)


def catalog(spark: SparkSession, sf: str) -> DataFrame:
    """id, type, mood, themes: the first twelve coordinates of a vector as a mood, themes from the document of that id."""
    docs = table(spark, sf, "documents").select(F.col("doc_id"), F.slice(F.array_distinct(F.slice(T.terms(F.col("text")), 1, 12)), 1, 3).alias("themes"))
    e = table(spark, sf, "embeddings")
    kinds = F.array(*(F.lit(t) for t in fixed.TYPES))
    vector = F.transform(F.slice("embedding", 1, 12), lambda x: V.clamp(F.lit(0.5) + x.cast("double")))
    joined = e.join(docs, e.vec_id == docs.doc_id, "left")
    return joined.select(F.col("vec_id").alias("id"), F.get(kinds, F.col("label") % 5).alias("type"), vector.alias("mood"), F.coalesce("themes", F.array().cast("array<string>")).alias("themes"))


def stories(spark: SparkSession, sf: str) -> DataFrame:
    """documents with title (first line) and given ids, some missing or blank."""
    d = table(spark, sf, "documents")
    return d.withColumns({
        "title": F.substring_index("text", "\n", 1),
        "record_id": F.when(F.col("doc_id") % 3 == 0, F.lit("")).when(F.col("doc_id") % 3 == 1, F.concat(F.lit(" r"), F.col("doc_id").cast("string"))),
        "cmu_id": F.when(F.col("doc_id") % 6 == 0, F.concat(F.lit("c"), F.col("doc_id").cast("string"))).when(F.col("doc_id") % 6 == 2, F.lit(" \n\u00a0")),
    })


#: Blanks of all kinds, for trim().
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31) || chr(133) || chr(160) || chr(8195) || chr(12288)"

_STORIES = """stories as (select *, split_part(text, chr(10), 1) as title,
  case when doc_id % 3 = 0 then '' when doc_id % 3 = 1 then ' r' || doc_id end as record_id,
  case when doc_id % 6 = 0 then 'c' || doc_id when doc_id % 6 = 2 then ' ' || chr(10) || chr(160) end as cmu_id from documents)"""

TARGET = {"warmth": 0.8, "depth": 0.7, "energy": 0.3, "melancholy": 0.6}
_TARGET = _vector(TARGET)

# --- vectors --------------------------------------------------------------------------------------------------------


def _query_vector(spark: SparkSession, sf: str) -> list[float]:
    return [float(x) for x in table(spark, sf, "embeddings").where("vec_id = 0").select("embedding").first()[0]]


@query("""select vec_id, round(greatest(-1.0, least(1.0, list_dot_product(embedding::double[], (select embedding from embeddings where vec_id = 0)::double[]))), 6) as vector_similarity
from embeddings order by list_dot_product(embedding::double[], (select embedding from embeddings where vec_id = 0)::double[]) desc, vec_id limit 5""")
def vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    return search.vector_top_k(table(spark, sf, "embeddings"), _query_vector(spark, sf), 5).select("vec_id", six(F.col("vector_similarity")).alias("vector_similarity"))


@query(SQL["vector_topk"])
def vector_topk_cells(spark: SparkSession, sf: str) -> DataFrame:
    """The same from a store in cells around centroids."""
    path = scratch(spark, "cells")
    clustered.build_cells(table(spark, sf, "embeddings"), path)
    return clustered.vector_top_k(spark, path, _query_vector(spark, sf), 5).select("vec_id", six(F.col("vector_similarity")).alias("vector_similarity"))


@query("""select query_id, id, rank, round(score, 6) as score from (
  select q.vec_id as query_id, e.vec_id as id, list_dot_product(q.embedding::double[], e.embedding::double[]) as score,
    row_number() over (partition by q.vec_id order by list_dot_product(q.embedding::double[], e.embedding::double[]) desc, e.vec_id)::int as rank
  from embeddings q, embeddings e where q.vec_id % 50 = 0 and q.vec_id % 150 <> 50) where rank <= 5""")
def vector_topk_batch(spark: SparkSession, sf: str) -> DataFrame:
    store = table(spark, sf, "embeddings")
    asked = store.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    # Some queries are null, some of another width: these have no result.
    odd = F.when(F.col("query_id") % 100 == 50, F.slice("embedding", 1, 7))
    asked = asked.withColumn("embedding", F.when(F.col("query_id") % 150 == 50, odd).otherwise(F.col("embedding")))
    return search.vector_top_k_batch(store, asked, 5).select("query_id", "id", "rank", six(F.col("score")).alias("score"))


@query("select vec_id, len(embedding)::bigint as width, round(sqrt(list_dot_product(embedding::double[], embedding::double[])), 6) as norm, label from embeddings")
def store_scan(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return build.require_unique(e, "vec_id").select("vec_id", F.size("embedding").cast("long").alias("width"), six(V.norm(F.col("embedding"))).alias("norm"), "label")


@query("select vec_id, round(sqrt(list_dot_product(embedding::double[], embedding::double[])), 6) as norm, round(list_dot_product(embedding::double[], embedding::double[]), 6) as squared from embeddings")
def vector_norms(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("embedding")
    return table(spark, sf, "embeddings").select("vec_id", six(V.norm(v)).alias("norm"), six(V.dot(v, v)).alias("squared"))


@query("select vec_id, abs(list_dot_product(embedding::double[], embedding::double[]) * case when vec_id % 4 = 0 then 4.0 else 1.0 end - 1) <= 0.005 as unit from embeddings")
def unit_norm_check(spark: SparkSession, sf: str) -> DataFrame:
    scaled = F.when(F.col("vec_id") % 4 == 0, F.transform("embedding", lambda x: x * F.lit(2.0).cast("float"))).otherwise(F.col("embedding"))
    return table(spark, sf, "embeddings").select("vec_id", V.unit(scaled).alias("unit"))


_ODD = "case when vec_id % 7 = 0 then []::float[] when vec_id % 7 = 1 then [0.0::float, 0.0::float] when vec_id % 7 = 2 then ['nan'::float, 1.0::float] when vec_id % 7 = 3 then null else embedding end"


def _odd() -> Column:
    m = F.col("vec_id") % 7
    floats = lambda *x: F.array(*(F.lit(v).cast("float") for v in x)).cast("array<float>")
    return F.when(m == 0, F.array().cast("array<float>")).when(m == 1, floats(0.0, 0.0)).when(m == 2, floats(float("nan"), 1.0)).when(m == 3, F.lit(None).cast("array<float>")).otherwise(F.col("embedding"))


@query("select vec_id, vec_id % 7 > 3 as valid from embeddings")
def vector_validate(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", V.valid(_odd()).alias("valid"))


@query(f"""select count(*) as n_rows, count(*) filter (vec_id % 7 <= 3) as invalid, min(len(v))::bigint as least_width, max(len(v))::bigint as largest_width,
  (select count(*) from (select vec_id from embeddings group by vec_id having count(*) > 1)) as repeated_ids from (select *, {_ODD} as v from embeddings)""")
def dataset_inspect(spark: SparkSession, sf: str) -> DataFrame:
    return build.inspect(table(spark, sf, "embeddings").withColumn("v", _odd()), "vec_id", "v")


@query("select text as id, count(*) as n from documents group by text having count(*) > 1")
def duplicate_ids(spark: SparkSession, sf: str) -> DataFrame:
    return build.repeated_ids(table(spark, sf, "documents"), "text")


_SCALED = "list_transform(embedding, lambda x: x::double * (1 + vec_id % 3))"


@query(f"""select vec_id, i, round((v[i] / sqrt(list_dot_product(v, v)))::float::double, 5) as x
from (select vec_id, {_SCALED} as v, unnest(range(1, len(embedding) + 1)) as i from embeddings)""")
def vector_normalize(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").withColumn("v", F.transform("embedding", lambda x: x.cast("double") * (1 + F.col("vec_id") % 3)))
    return e.select("vec_id", F.posexplode(V.normalized(F.col("v"))).alias("i", "x")).select("vec_id", (F.col("i") + 1).cast("long").alias("i"), F.round(F.col("x").cast("double"), 5).alias("x"))


@query(f"""select vec_id, round(list_sum(list_transform(w, lambda x: abs(x))), 3) as weight, round(sqrt(list_dot_product(w, w)), 4) as norm
from (select vec_id, list_transform(v, lambda x: (x / sqrt(list_dot_product(v, v)))::float::double) as w from (select vec_id, {_SCALED} as v from embeddings))""")
def vector_import(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * (1 + F.col("vec_id") % 3)).alias("embedding"))
    done = build.import_vectors(e, "vec_id", "embedding")
    return done.select("vec_id", F.round(V.total(F.transform(V.doubles(F.col("embedding")), lambda x: F.abs(x))), 3).alias("weight"), F.round(V.norm(F.col("embedding")), 4).alias("norm"))


@query("""select vec_id, round(s, 6) as score, s < 0.4 as low from (select vec_id, list_dot_product(embedding::double[], (select embedding from embeddings where vec_id = 0)::double[]) as s from embeddings)""")
def low_match_flag(spark: SparkSession, sf: str) -> DataFrame:
    s = V.dot_literal(F.col("embedding"), _query_vector(spark, sf))
    return table(spark, sf, "embeddings").select("vec_id", six(s).alias("score"), (s < 0.4).alias("low"))


# --- texts ----------------------------------------------------------------------------------------------------------


@query(f"""with {_STORIES} select doc_id, coalesce(nullif(trim(coalesce(nullif(record_id, ''), nullif(cmu_id, '')), {_BLANKS}), ''),
  'story-' || doc_id || '-' || substr(sha256(title || chr(0) || coalesce(text, '')), 1, 12)) as id from stories""")
def stable_record_id(spark: SparkSession, sf: str) -> DataFrame:
    return stories(spark, sf).select("doc_id", T.stable_id(F.col("record_id"), F.col("cmu_id"), F.col("doc_id"), F.col("title"), F.col("text")).alias("id"))


@query(f"""with {_STORIES} select doc_id, sha256('{{"summary":' || to_json(text) || ',"title":' || to_json(title) || '}}') as hash from stories""")
def source_hash(spark: SparkSession, sf: str) -> DataFrame:
    return stories(spark, sf).select("doc_id", T.content_hash(F.col("title"), F.col("text")).alias("hash"))


@query(f"""with {_STORIES} select doc_id, 'Title: ' || case when trim(title) = '' then 'Untitled' else title end || ' | Atmosphere: ' || array_to_string(({_terms("text")})[1:5], ', ') || ' | Summary: ' || text as payload from stories""")
def search_payload(spark: SparkSession, sf: str) -> DataFrame:
    return stories(spark, sf).select("doc_id", T.search_payload(F.col("title"), F.slice(T.terms(F.col("text")), 1, 5), F.col("text")).alias("payload"))


_URL = "case page_id % 6 when 0 then url when 1 then url || '/a.MP3?x=1' when 2 then url || '/a.zip' when 3 then 'https:///a.mp3' when 4 then 'ftp://h/a.mp3' else url || '/b.wav' end"


@query(f"""select page_id, regexp_matches(u, '^(?i)https?://[^/?#]+') as http, regexp_matches(u, '^(?i)https?://[^/?#]+') and regexp_matches(lower(regexp_extract(u, '^(?i)https?://[^/?#]+([^?#]*)', 1)), '\\.(mp3|wav|m4a|ogg)$') as playable
from (select page_id, {_URL} as u from pages)""")
def playable_url(spark: SparkSession, sf: str) -> DataFrame:
    u = F.expr(_URL)
    return table(spark, sf, "pages").select("page_id", T.http_url(u).alias("http"), T.playable(u).alias("playable"))


@query("""select conv_id, turn, case len(w) when 0 then 'drama story mood' when 1 then w[1] || ' story mood' when 2 then array_to_string(w, ' ') || ' mood' else array_to_string(w, ' ') end as keywords
from (select conv_id, turn, list_filter(a, lambda x, i: list_position(a, x) = i)[1:8] as w
  from (select conv_id, turn, list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z][A-Za-z''-]{2,}'), lambda x: lower(x)) as a from conversations where role = 'user'))""")
def fallback_keywords(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", F.array_join(T.fallback_keywords(F.col("text")), " ").alias("keywords"))


@query("""select page_id, case when length(t) > 200 then rtrim(substr(t, 1, 200)) || '…' else t end as preview from (
  select page_id, trim(regexp_replace(regexp_replace(regexp_replace(html || chr(10) || '--- Metadata: x', '(?i)\\n\\s*(?:---\\s*)?metadata(?:\\s*---)?\\s*:?[\\s\\S]*$', ''), '(?i)</?div\\b[^>]*>', '', 'g'), '\\s+', ' ', 'g')) as t from pages)""")
def summary_preview(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", T.preview(F.concat("html", F.lit("\n--- Metadata: x")), 200).alias("preview"))


@query(f"select doc_id, i::bigint as i, t[i] as term from (select doc_id, t, unnest(range(1, len(t) + 1)) as i from (select doc_id, {_terms('text')} as t from documents))")
def tokenize(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.posexplode(T.terms(F.col("text"))).alias("i", "term")).select("doc_id", (F.col("i") + 1).cast("long").alias("i"), "term")


@query("""select d::date as day, (d + to_days(((5 - isodow(d) + 7) % 7)::int))::date as friday, (d + to_days((((5 - isodow(d) + 7) % 7) + 2)::int))::date as sunday
from (select date '2026-08-01' + to_days(i::int) as d from range(0, 60) t(i))""")
def weekend_window(spark: SparkSession, sf: str) -> DataFrame:
    days = spark.range(60).select(F.date_add(F.lit("2026-08-01").cast("date"), F.col("id").cast("int")).alias("day"))
    friday, sunday = T.weekend(F.col("day"))
    return days.select("day", friday.alias("friday"), sunday.alias("sunday"))


@query("""select doc_id, case when len(c) > 0 then array_to_string(list_sort(list_distinct(c)), ', ') else 'Not stated' end as contacts
from (select doc_id, regexp_extract_all(coalesce(text, ''), '(?:\\+91[- ]?)?[6-9][0-9]{9}') as c from documents)""")
def contact_extract(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.contacts(F.col("text")).alias("contacts"))


# --- lexical retrieval ----------------------------------------------------------------------------------------------

_TF = f"""tf as (select doc_id, term, count(*) as tf from (select doc_id, unnest(list_concat({_terms("title || ' ' || text")}, {_terms('title')})) as term from stories) group by all)"""


def _story_tokens() -> Column:
    return search.story_tokens(F.col("title"), F.col("text"))


@query(f"with {_STORIES}, {_TF} select doc_id as id, term, tf from tf")
def term_freq(spark: SparkSession, sf: str) -> DataFrame:
    return search.term_frequencies(stories(spark, sf), "doc_id", _story_tokens())


@query(f"with {_STORIES}, {_TF} select term, count(*) as df from tf group by term")
def doc_freq(spark: SparkSession, sf: str) -> DataFrame:
    return search.document_frequencies(stories(spark, sf), _story_tokens())


PROMPT = "the thing that was said and erthat other words oneat nowhereseen"


@query(f"""with {_STORIES}, {_TF}, df as (select term, count(*) as df from tf group by term), n as (select count(*)::double as n from stories),
q as (select term, count(*) as c from (select unnest({_terms("'" + PROMPT + "'")}) as term) group by term),
qw as (select q.term, c * (ln((1 + n) / (1 + coalesce(df, 0))) + 1) as w from q cross join n left join df using (term)),
w as (select doc_id, tf.term, tf * (ln((1 + n) / (1 + df)) + 1) as w from tf join df using (term) cross join n),
s as (select w.doc_id, sum(coalesce(qw.w, 0) * w.w) as dot, sum(w.w * w.w) as sq from w left join qw using (term) group by w.doc_id)
select d.doc_id as id, round(coalesce(dot / (greatest((select sqrt(sum(w * w)) from qw), 1e-8) * greatest(sqrt(sq), 1e-8)), 0), 6) as score from stories d left join s using (doc_id)
order by coalesce(dot / sqrt(sq), 0) desc, sha256('{PROMPT}' || chr(0) || d.doc_id) desc, d.doc_id desc limit 10""")
def lexical_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Over the stored index of all stories; the first search of a session over these tables builds it."""
    return inverted.search_index(spark, _story_index(spark, sf), PROMPT, 10).select("id", six(F.col("score")).alias("score"))


_INDEXES: dict[tuple[str, str], str] = {}


def _story_index(spark: SparkSession, sf: str) -> str:
    """The index of the stories of these tables, kept for the session as long as the files are the same."""
    fs, path = hadoop_path(spark, f"{sf}/documents.parquet")
    files_ = fs.listStatus(path)
    mark = build.fingerprint(application=spark.sparkContext.applicationId, files=sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in files_))
    key = (sf, mark)
    if key not in _INDEXES:
        folder = scratch(spark, "index")
        inverted.build_index(stories(spark, sf), folder, "doc_id", _story_tokens())
        _INDEXES[key] = folder
    return _INDEXES[key]


_WEIGHED = f"""with {_STORIES}, {_TF}, df as (select term, count(*) as df from tf group by term), n as (select count(*)::double as n from stories),
w as (select doc_id, tf.term, tf, tf * (ln((1 + n) / (1 + df)) + 1) as w from tf join df using (term) cross join n),
lengths as (select doc_id, greatest(sqrt(sum(w * w)), 1e-8) as length from w group by doc_id)"""


@query(f"""{_WEIGHED} select term, count(*)::bigint as df, round(max(tf / length), 6) as most from w join lengths using (doc_id) group by term""")
def lexical_index(spark: SparkSession, sf: str) -> DataFrame:
    """Builds the stored index of all stories anew; its terms, in how many documents each is, and the largest weight."""
    path = scratch(spark, "index")
    inverted.build_index(stories(spark, sf), path, "doc_id", _story_tokens())
    return inverted.vocabulary(spark, path).select("term", F.col("df").cast("long").alias("df"), six(F.col("most")).alias("most"))


LATER = "world search the harbour lantern page content"


@query(f"""with tf as (select page_id, term, count(*) as tf from (select page_id, unnest({_terms("url || ' ' || html")}) as term from pages) group by all), n as (select count(*)::double as n from pages),
df as (select term, count(*) as df from tf group by term), q as (select term, count(*) as c from (select unnest({_terms("'" + LATER + "'")}) as term) group by term),
qw as (select q.term, c * (ln((1 + n) / (1 + coalesce(df, 0))) + 1) as w from q cross join n left join df using (term)),
w as (select page_id, tf.term, tf * (ln((1 + n) / (1 + df)) + 1) as w from tf join df using (term) cross join n),
s as (select w.page_id, sum(coalesce(qw.w, 0) * w.w) / (greatest((select sqrt(sum(w * w)) from qw), 1e-8) * greatest(sqrt(sum(w.w * w.w)), 1e-8)) as score from w left join qw using (term) group by w.page_id)
select page_id as id, round(coalesce(score, 0), 6) as score from pages left join s using (page_id) order by round(coalesce(score, 0), 12) desc, sha256('{LATER}' || chr(0) || page_id) desc, page_id desc limit 10""")
def lexical_extended(spark: SparkSession, sf: str) -> DataFrame:
    """An index of two thirds of the pages, extended by the others, is that of all."""
    path, all_ = scratch(spark, "index"), table(spark, sf, "pages")
    tokens = T.terms(F.concat("url", F.lit(" "), "html"))
    inverted.build_index(all_.where("page_id % 3 > 0"), path, "page_id", tokens)
    inverted.extend_index(all_.where("page_id % 3 = 0"), path, "page_id", tokens)
    return inverted.search_index(spark, path, LATER, 10).select("id", six(F.col("score")).alias("score"))


# --- moods ----------------------------------------------------------------------------------------------------------

#: Mood words for the invented prose of the tables.
WORDS = {
    "the": {"warmth": 0.01, "energy": -0.005}, "and": {"nostalgia": 0.02}, "that": {"depth": 0.02, "tension": -0.01}, "for": {"hope": 0.03},
    "was": {"melancholy": 0.03, "valence": -0.01}, "with": {"romance": 0.02}, "de": {"mystery": 0.01}, "der": {"wonder": 0.02}, "que": {"humor": 0.02},
    "of the": {"depth": 0.1, "warmth": 0.05},
}
_WORDS = ", ".join(f"('{w}', '{a}', {d!r}::double)" for w, v in WORDS.items() for a, d in v.items())


@query(f"""with t as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z][a-z\\-]+') as ts from documents),
lex(word, axis, delta) as (values {_WORDS}),
hits as (select doc_id, axis, sum(delta) as d from (select doc_id, unnest(ts) as word from t) join lex using (word) group by all),
pairs as (select doc_id, axis, delta as d from t, lex where contains(word, ' ') and contains(array_to_string(ts || list_transform(range(1, len(ts)), lambda i: ts[i] || ' ' || ts[i + 1]), ' '), word)),
s as (select doc_id, axis, sum(d) as d from (select * from hits union all select * from pairs) group by all)
select doc_id, a.axis, round(greatest(0.0, least(1.0, 0.5 + coalesce(s.d, 0))), 6) as value from documents cross join (select unnest([{_AXES}]) as axis) a left join s using (doc_id, axis)""")
def mood_parse(spark: SparkSession, sf: str) -> DataFrame:
    axes = F.array(*(F.lit(a) for a in fixed.AXES))
    parsed = table(spark, sf, "documents").select("doc_id", F.posexplode(mood.parse_mood(F.col("text"), WORDS)).alias("i", "value"))
    return parsed.select("doc_id", F.get(axes, F.col("i")).alias("axis"), six(F.col("value")).alias("value"))


@query(SQL["mood_parse"])
def mood_parse_table(spark: SparkSession, sf: str) -> DataFrame:
    """The same by a lexicon that is a table."""
    rows = [(k, word, axis, delta) for k, (word, deltas) in enumerate(WORDS.items()) for axis, delta in deltas.items()]
    axes = F.array(*(F.lit(a) for a in fixed.AXES))
    parsed = phrases.parse_moods(table(spark, sf, "documents").select("doc_id", "text"), "text", spark.createDataFrame(rows, "ordinal int, phrase string, axis string, delta double"))
    return parsed.select("doc_id", F.posexplode("mood").alias("i", "value")).select("doc_id", F.get(axes, F.col("i")).alias("axis"), six(F.col("value")).alias("value"))


@query(f"with {_CATALOG} select id, type, round(list_sum(mood), 6) as mood_sum, array_to_string(themes, ',') as themes from catalog")
def catalog_scan(spark: SparkSession, sf: str) -> DataFrame:
    return catalog(spark, sf).select("id", "type", six(V.total(F.col("mood"))).alias("mood_sum"), F.array_join("themes", ",").alias("themes"))


@query(f"with {_CATALOG} select id, type, array_to_string(themes, ',') as themes from catalog where id = 7 limit 1")
def item_by_id(spark: SparkSession, sf: str) -> DataFrame:
    return catalog(spark, sf).where("id = 7").limit(1).select("id", "type", F.array_join("themes", ",").alias("themes"))


@query(f"with {_CATALOG} select id, round({cosine_sql('mood', _TARGET)}, 6) as score from catalog order by {cosine_sql('mood', _TARGET)} desc, id limit 10")
def rank_catalog(spark: SparkSession, sf: str) -> DataFrame:
    return mood.rank(catalog(spark, sf), mood.vector_literal(TARGET), 10).select("id", six(F.col("score")).alias("score"))


THEMES = ["The", "that", "erst", "onand"]
_OVERLAP = "case when len({a}) = 0 or len({b}) = 0 then 0.0 else len(list_intersect({a}, {b})) / sqrt(len({a}) * len({b})) end"
_LOW = "list_distinct(list_transform({x}, lambda t: lower(t)))"
_THEMES = _LOW.format(x="[" + ", ".join(f"'{t}'" for t in THEMES) + "]")


@query(f"""with {_CATALOG} select id, type, round(s, 6) as score from (select id, type, {cosine_sql('mood', _TARGET)} + 0.15 * {_OVERLAP.format(a=_THEMES, b=_LOW.format(x='themes'))} as s
from catalog where type in ('movie', 'book') and id not in (1, 2, 3)) order by s desc, id limit 10""")
def rank_filtered(spark: SparkSession, sf: str) -> DataFrame:
    themes = F.array(*(F.lit(t) for t in THEMES))
    return mood.rank(catalog(spark, sf), mood.vector_literal(TARGET), 10, ["movie", "book"], [1, 2, 3], themes).select("id", "type", six(F.col("score")).alias("score"))


@query(f"with {_CATALOG} select id, round({_OVERLAP.format(a=_THEMES, b=_LOW.format(x='themes'))}, 6) as overlap from catalog")
def theme_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return catalog(spark, sf).select("id", six(mood.theme_overlap(F.array(*(F.lit(t) for t in THEMES)), F.col("themes"))).alias("overlap"))


@query(f"""with {_CATALOG}, seed as (select * from catalog where id = 0), s as (
  select c.id, c.type, {cosine_sql('c.mood', 's.mood')} + 0.15 * {_OVERLAP.format(a=_LOW.format(x='s.themes'), b=_LOW.format(x='c.themes'))} as score, c.themes, s.themes as own
  from catalog c, seed s where c.type <> s.type)
select id, type, round(score, 3) as score, rn, len(list_intersect(list_distinct(themes), list_distinct(own)))::int as shared
from (select *, row_number() over (partition by type order by score desc, id)::int as rn from s) where rn <= 2""")
def unlock_related(spark: SparkSession, sf: str) -> DataFrame:
    return mood.unlock_related(catalog(spark, sf), 0).select("id", "type", F.round("score", 3).alias("score"), "rn", F.size("shared_themes").alias("shared"))


_FESTIVALS = ", ".join(f"('{n}', {_vector(mood.festival_target(b, TARGET))})" for n, _, b in fixed.FESTIVALS)


@query(f"""with {_CATALOG}, f(festival, target) as (values {_FESTIVALS}),
r as (select festival, type, id, {cosine_sql('f.target', 'mood')} as score, row_number() over (partition by festival, type order by {cosine_sql('f.target', 'mood')} desc, id)::int as rn from f, catalog)
select festival, type, rn, id, round(score, 3) as score from r where rn <= case type when 'movie' then 2 when 'book' then 1 when 'game' then 1 when 'podcast' then 1 else 0 end""")
def festival_lineup(spark: SparkSession, sf: str) -> DataFrame:
    return mood.festival_lineup(catalog(spark, sf), TARGET).select("festival", "type", "rn", "id", F.round("score", 3).alias("score"))


def _weekend_sql() -> str:
    options = ", ".join(f"({k}, {p}, '{t}', {_vector(target)})" for k, (_, types, target) in enumerate(fixed.SLOTS) for p, t in enumerate(types))
    tone = f"list_transform(range(1, 13), lambda i: greatest(0.0::double, least(1.0::double, ({_TARGET})[i] * 0.45::double + tone[i] * 0.55::double)))"
    steps = [f"with {_CATALOG}, w(slot, pos, type, tone) as (values {options}), o as (select slot, pos, w.type, id, {cosine_sql('target', 'mood')} as score from (select *, {tone} as target from w) w join catalog using (type))"]
    steps.append("s0 as (select []::bigint[] as ids, []::varchar[] as types)")
    for k in range(len(fixed.SLOTS)):
        steps.append(f"p{k} as (select o.* from o, s{k} where slot = {k} and not list_contains(ids, id) order by list_contains(types, type), pos, score desc, id limit 1)")
        steps.append(f"s{k + 1} as (select case when p.id is null then ids else list_append(ids, p.id) end as ids, case when p.id is null then types else list_append(types, p.type) end as types from s{k} left join p{k} p on true)")
    picks = " union all ".join(f"select {k} as slot_no, type, id, round(score, 3) as score from p{k}" for k in range(len(fixed.SLOTS)))
    return ", ".join(steps) + f" select slot_no::int as slot_no, type, id, score from ({picks})"


@query(_weekend_sql())
def weekend_plan(spark: SparkSession, sf: str) -> DataFrame:
    moods = spark.range(1).select(F.col("id").alias("mood_id"), mood.vector_literal(TARGET).alias("mood"))
    return mood.plan_weekend(catalog(spark, sf), moods).select("slot_no", "type", "id", F.round("score", 3).alias("score"))


@query(f"""with {_CATALOG}, a as (select id, ([{_AXES}])[i] as axis, i, mood[i] as value, (1 - abs(mood[i] - ({_TARGET})[i])) * (1 + abs(mood[i] - 0.5) * 2) as agreement from (select id, mood, unnest(range(1, 13)) as i from catalog))
select id, rn, axis, case when value >= 0.66 then 'high' when value <= 0.34 then 'low' else 'mid' end as class, round(agreement, 6) as agreement from (select *, row_number() over (partition by id order by agreement desc, i)::int as rn from a) where rn <= 3""")
def explain_axes(spark: SparkSession, sf: str) -> DataFrame:
    top = mood.agreements(catalog(spark, sf), mood.vector_literal(TARGET))
    return top.select("id", "rn", "axis", mood.axis_class(F.col("value")).alias("class"), six(F.col("agreement")).alias("agreement"))


@query(f"""with {_CATALOG}, a as (select id, i, ([{_AXES}])[i] as axis, round((mood[i] - 0.5) * 2, 2) as delta from (select id, mood, unnest(range(1, 13)) as i from catalog) where abs(mood[i] - 0.5) > 0.15)
select id, axis, delta, case when delta > 0 then '↑' else '↓' end as arrow, floor(abs(delta) * 80)::int as bar from (select *, row_number() over (partition by id order by abs(delta) desc, i) as rn from a) where rn <= 8""")
def mood_summary(spark: SparkSession, sf: str) -> DataFrame:
    return catalog(spark, sf).select("id", F.explode(mood.mood_pills(F.col("mood"))).alias("p")).select("id", "p.axis", "p.delta", "p.arrow", "p.bar")


# --- posts and listings ---------------------------------------------------------------------------------------------


@query("select doc_id from (select doc_id, row_number() over (partition by text order by doc_id) as rn from documents) where rn = 1")
def dedup_keep_first(spark: SparkSession, sf: str) -> DataFrame:
    return listings.keep_first(table(spark, sf, "documents"), F.col("text"), "doc_id").select("doc_id")


@query("select count(*) as n_rows, count(distinct text) as n_texts from documents")
def dedup_stats(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").agg(F.count("*").alias("n_rows"), F.count_distinct("text").alias("n_texts"))


_POSTS = """posts as (select doc_id, case when doc_id % 3 = 0 then '' else 'http://x/' || (doc_id % 700) end as postUrl,
  case when doc_id % 6 = 0 then ' http://x/' || (doc_id % 50) else '' end as link, text, lang as author, source as groupName, '' as timestamp from documents)"""


def posts(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("doc_id")
    return table(spark, sf, "documents").select(
        "doc_id", F.when(n % 3 == 0, "").otherwise(F.concat(F.lit("http://x/"), (n % 700).cast("string"))).alias("postUrl"),
        F.when(n % 6 == 0, F.concat(F.lit(" http://x/"), (n % 50).cast("string"))).otherwise("").alias("link"), "text", F.col("lang").alias("author"), F.col("source").alias("groupName"), F.lit("").alias("timestamp"),
    )


@query(f"""with {_POSTS}, k as (select doc_id, case when trim(postUrl) <> '' then 'postUrl:' || trim(postUrl) when trim(link) <> '' then 'link:' || trim(link)
  else 'fallback:' || sha1(concat_ws('|', regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '', '', author, groupName)) end as identity from posts)
select identity, min(doc_id) as doc_id from k group by identity""")
def identity_dedup(spark: SparkSession, sf: str) -> DataFrame:
    p = posts(spark, sf)
    with_id = p.withColumn("identity", listings.identity(p))
    return listings.keep_first(with_id, F.col("identity"), "doc_id").select("identity", "doc_id")


_LISTED = """listed as (select doc_id, lang as author, case when doc_id % 5 = 0 then '' when doc_id % 5 = 1 then 'http://y/' || (doc_id % 70) else 'http://x/' || (doc_id % 700) end as url,
  (doc_id % 28 + 1) || ' ' || (['June', 'July', 'august'])[doc_id % 3 + 1] || case when doc_id % 4 = 0 then chr(160) else ' ' end || '2026' as ts, source,
  case when doc_id % 4 = 1 then 'Rent' || chr(160) || ':' || chr(160) || '₹ ' else 'Rent: ₹ ' end || (5 + doc_id % 30) || ',' || lpad((n_chars % 1000)::varchar, 3, '0') || ' for ' || (1 + doc_id % 5) ||
  case when doc_id % 4 = 2 then chr(160) else ' ' end || 'BHK, ' || (['attached bathroom', 'a shared washroom', 'a kitchen'])[doc_id % 8 % 3 + 1] || chr(10) || 'Location: ' || source || ' road ' || chr(10) || '+91 9' || lpad(doc_id::varchar, 9, '0') || ' ' || text as body from documents)"""


def listed(spark: SparkSession, sf: str) -> DataFrame:
    n, s = F.col("doc_id"), lambda c: c.cast("string")
    months = F.array(F.lit("June"), F.lit("July"), F.lit("august"))
    body = F.concat(
        F.when(n % 4 == 1, "Rent\u00a0:\u00a0₹ ").otherwise("Rent: ₹ "), s(5 + n % 30), F.lit(","), F.lpad(s(F.col("n_chars") % 1000), 3, "0"), F.lit(" for "), s(1 + n % 5), F.when(n % 4 == 2, "\u00a0").otherwise(" "),
        F.lit("BHK, "), F.get(F.array(F.lit("attached bathroom"), F.lit("a shared washroom"), F.lit("a kitchen")), (n % 8 % 3).cast("int")), F.lit("\nLocation: "), F.col("source"),
        F.lit(" road \n+91 9"), F.lpad(s(n), 9, "0"), F.lit(" "), F.col("text"),
    )
    return table(spark, sf, "documents").select(
        "doc_id", F.col("lang").alias("author"), F.when(n % 5 > 1, F.concat(F.lit("http://x/"), s(n % 700))).otherwise("").alias("postUrl"), F.when(n % 5 == 1, F.concat(F.lit("http://y/"), s(n % 70))).alias("Post URL"),
        F.concat(s(n % 28 + 1), F.lit(" "), F.get(months, (n % 3).cast("int")), F.when(n % 4 == 0, "\u00a0").otherwise(" "), F.lit("2026")).alias("timestamp"), F.col("source").alias("source_file"), body.alias("text"),
    )


@query(f"""with {_LISTED}, u as (select * from (select *, row_number() over (partition by case when url <> '' then url else author || '|' || substr(body, 1, 200) end order by doc_id) as rn from listed) where rn = 1),
r as (select *, replace(regexp_extract(body, '(?i)Rent[\\s\\x{{a0}}]*:[\\s\\x{{a0}}]*[₹Rs. ]*([0-9][0-9,]*)', 1), ',', '') as amount from u)
select author as poster_name, trim(regexp_extract(body, '(?i)(?:Location|Society|Address)\\s*:\\s*([^\\n]+)', 1)) as google_map_location, case when regexp_matches(body, '(?i)attached bathroom|private bathroom') then 'Private/attached' when regexp_matches(body, '(?i)shared.*(?:washroom|bathroom)|(?:washroom|bathroom).*shared') then 'Shared' else 'Not stated' end as private_bathroom, ts as post_date, url as post_link,
  amount::bigint as room_rent_including_maintenance_inr, array_to_string(list_sort(list_distinct(regexp_extract_all(body, '(?:\\+91[- ]?)?[6-9][0-9]{{9}}'))), ', ') as contact_number, substr(body, 1, 1500) as additional_requirements,
  regexp_extract(body, '(?i)\\b([234])[\\s\\x{{a0}}]*BHK\\b', 1) || 'BHK' as bhk, source as source_file
from r where regexp_matches(body, '(?i)\\b[234][\\s\\x{{a0}}]*BHK\\b') and regexp_matches(ts, '(?i)\\b(?:July|August)[\\s\\x{{a0}}]+2026\\b') and amount <> '' and try_cast(amount as bigint) < 20000""")
def listing_filter(spark: SparkSession, sf: str) -> DataFrame:
    return listings.filter_listings(listed(spark, sf), "doc_id")


@query("""with base as (select * from (select doc_id, lang || ' · Follow' as poster, (doc_id % 600)::varchar as link, case when doc_id % 4 > 0 then 'Shared' end as bath, (doc_id % 40) || ',500' as rent, source as gender,
  row_number() over (partition by doc_id % 600 order by doc_id) as rn from documents) where rn = 1),
detail as (select * from (select (doc_id % 500)::varchar as link, '₹' || quality as place, case when toxic = 0 then 'yes' else '' end as bathroom, row_number() over (partition by doc_id % 500 order by doc_id desc) as rn from labels) where rn = 1)
select replace(poster, ' · Follow', '') as poster_name, case when d.link is null then 'Not available' else place end as place, case when d.link is null then coalesce(bath, 'Not stated') else bathroom end as bathroom,
  replace(rent, ',', '') as rent, gender, case when d.link is null then 'Not specified' else 'n' end as needs, case when d.link is null then 'N/A' else 'c' end as contact, b.link from base b left join detail d on d.link = b.link""")
def listing_merge(spark: SparkSession, sf: str) -> DataFrame:
    n, s = F.col("doc_id"), lambda c: c.cast("string")
    base = table(spark, sf, "documents").select(n.alias("ordinal"), F.concat("lang", F.lit(" · Follow")).alias("poster"), s(n % 600).alias("link"), F.when(n % 4 > 0, "Shared").alias("bath"), F.concat(s(n % 40), F.lit(",500")).alias("rent"), F.col("source").alias("gender"))
    detail = table(spark, sf, "labels").select(n.alias("ordinal"), s(n % 500).alias("link"), F.concat(F.lit("â‚¹"), s(F.col("quality"))).alias("place"), F.when(F.col("toxic") == 0, "yes").otherwise("").alias("bathroom"), F.lit("n").alias("needs"), F.lit("c").alias("contact"))
    return listings.merge_listings(base, detail)


# --- building a store -----------------------------------------------------------------------------------------------

_BUILD = """h as (select doc_id, doc_id as ordinal, md5(text) as hash from documents),
old as (select hash, max_by('p' || doc_id, doc_id) as payload from h where doc_id % 3 = 0 group by hash), saved as (select hash, max_by('s' || doc_id, doc_id) as payload from h where doc_id % 3 = 1 group by hash),
built as (select doc_id, coalesce(o.payload, s.payload) as payload, case when o.hash is not null then 'reused' when s.hash is not null then 'cached' else 'pending' end as status from h left join old o on o.hash = h.hash left join saved s on s.hash = h.hash)"""


def _built(spark: SparkSession, sf: str) -> DataFrame:
    source = table(spark, sf, "documents").select("doc_id", F.col("doc_id").alias("ordinal"), F.md5("text").alias("hash"))
    payload = lambda mark: F.concat(F.lit(mark), F.col("doc_id").cast("string")).alias("payload")
    prior = source.where("doc_id % 3 = 0").select("hash", "ordinal", payload("p"))
    saved = source.where("doc_id % 3 = 1").select("hash", "ordinal", payload("s"))
    return build.incremental(source, prior, saved)


@query(f"with {_BUILD} select doc_id, status, payload from built")
def incremental_build(spark: SparkSession, sf: str) -> DataFrame:
    return _built(spark, sf).select("doc_id", "status", "payload")


@query(f"with {_BUILD} select count(*) filter (status = 'reused') as reused, count(*) filter (status = 'cached') as cached, count(*) filter (status = 'pending') as pending, count(*) as total from built")
def incremental_build_stats(spark: SparkSession, sf: str) -> DataFrame:
    return build.build_stats(_built(spark, sf))


@query(f"""with f as (select doc_id, case when doc_id % 7 = 0 then ' ' || chr(10) || chr(160) when doc_id % 7 = 1 then chr(10) || 'x' else split_part(text, chr(10), 1) end as p, ({_terms('text')})[1:doc_id % 10] as k, (doc_id % 13) / 10.0 as x from documents)
select doc_id, trim(p, {_BLANKS}) <> '' and len(k) between 5 and 8 and x <= 1 as valid from f""")
def feature_validate(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("doc_id")
    scores = F.map_from_arrays(F.array(*(F.lit(a) for a in fixed.AXES)), F.array_repeat((n % 13) / 10.0, len(fixed.AXES)))
    paragraph = F.when(n % 7 == 0, " \n\u00a0").when(n % 7 == 1, "\nx").otherwise(F.substring_index("text", "\n", 1))
    good, *_ = build.clean_features(paragraph, F.slice(T.terms(F.col("text")), F.lit(1), (n % 10).cast("int")), scores)
    return table(spark, sf, "documents").select("doc_id", good.alias("valid"))


@query("select count(*) = count(distinct vec_id) and min(len(embedding)) = max(len(embedding)) and bool_and(abs(list_dot_product(embedding::double[], embedding::double[]) - 1) <= 0.005) as current from embeddings")
def store_is_current(spark: SparkSession, sf: str) -> DataFrame:
    store = table(spark, sf, "embeddings")
    mark = build.fingerprint(version=1, model="stub", width=64)
    meta = store.agg(F.lit(mark).alias("fingerprint"), F.count("*").alias("n"))
    return build.store_is_current(store, meta, mark, "vec_id", "embedding")


# --- recommendations ------------------------------------------------------------------------------------------------


@query(f"""with {_STORIES} select doc_id::varchar as record_id, title, substr(case when doc_id % 2 = 0 then coalesce(nullif(title, ''), text) else text end, 1, 900) as description,
  array_to_string(list_transform(({_terms('text')})[1:8], lambda k: substr(k, 1, 80)), ',') as keywords, round(n_chars / 7.0, 6) as vector_similarity from stories""")
def candidate_payload(spark: SparkSession, sf: str) -> DataFrame:
    s = stories(spark, sf)
    parts = recommend.candidate(F.col("doc_id"), F.col("title"), F.when(F.col("doc_id") % 2 == 0, F.col("title")), F.col("text"), T.terms(F.col("text")), F.lit(0), F.col("n_chars") / 7.0)
    return s.select(*parts).select("record_id", "title", "description", F.array_join("keywords", ",").alias("keywords"), "vector_similarity")


def _candidates(spark: SparkSession, sf: str) -> DataFrame:
    return _candidates_of(stories(spark, sf))


def _candidates_of(s: DataFrame) -> DataFrame:
    return s.select(
        F.col("doc_id").alias("position"), F.col("doc_id").cast("string").alias("record_id"), "title", F.slice(T.terms(F.col("text")), 1, 5).alias("keywords"),
        F.when(F.col("doc_id") % 2 == 0, "").otherwise(F.concat(F.lit("http://x/"), F.col("doc_id").cast("string"))).alias("audio_url"), F.concat(F.lit("http://z/"), F.col("doc_id").cast("string")).alias("audio_zip_url"),
    )


@query(f"""with {_STORIES} select doc_id::varchar as recommended_record_id, coalesce(nullif(trim(title), ''), 'this story') as recommended_book_title, 'http://z/0' as audio_url,
  'It matches your request for quiet.' || case when len({_terms('text')}) > 0 then '|Its themes include ' || array_to_string(({_terms('text')})[1:3], ', ') || '.' else '' end as reasons from stories where doc_id = 0""")
def recommend_fallback(spark: SparkSession, sf: str) -> DataFrame:
    # The first row is found on the raw table; its words are cut afterwards.
    first = stories(spark, sf).orderBy("doc_id").limit(1)
    out = recommend.fallback(_candidates_of(first), "quiet")
    return out.select("recommended_record_id", "recommended_book_title", "audio_url", F.array_join("emotional_match_reasons", "|").alias("reasons"))


@query(f"""with {_STORIES}, a as (select conv_id * 1000 + turn as request_id, (conv_id * 7 + turn)::varchar as record_id, case when turn % 2 = 0 then substr(text, 1, 600) else ' p ' end as pitch, conv_id % 3 > 0 as reasoned from conversations)
select request_id, a.record_id as recommended_record_id, coalesce(s.title, 'Untitled') as recommended_book_title,
  s.doc_id is not null and length(trim(pitch)) between 1 and 520 and reasoned as valid from a left join stories s on s.doc_id::varchar = a.record_id""")
def recommend_resolve(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    answers = c.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("request_id"), (F.col("conv_id") * 7 + F.col("turn")).cast("string").alias("record_id"),
        F.when(F.col("turn") % 2 == 0, F.substring("text", 1, 600)).otherwise(" p ").alias("pitch"), F.when(F.col("conv_id") % 3 > 0, F.array(F.lit(" r "), F.lit(" "))).otherwise(F.array(F.lit(" "))).alias("reasons"),
    )
    return recommend.resolve(_candidates(spark, sf), answers).select("request_id", "recommended_record_id", "recommended_book_title", "valid")


# --- files ----------------------------------------------------------------------------------------------------------


@query("select doc_id::varchar as doc_id, text, lang from documents")
def csv_scan(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "csv")
    table(spark, sf, "documents").select("doc_id", "text", "lang").write.options(header=True, escape='"', quoteAll=True).csv(path)
    return files.read_csv(spark, path).select("doc_id", "text", "lang")


@query("select page_id, url from pages")
def json_array_scan(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "array.json")
    sinks.write_json_array(table(spark, sf, "pages").select("page_id", "url").orderBy("page_id"), path)
    return files.read_json_array(spark, path, "page_id string, url string").select(F.col("page_id").cast("long").alias("page_id"), "url")


@query("select page_id, url from pages")
def json_file_scan(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "lines")
    files.write_json_lines(table(spark, sf, "pages").select("page_id", "url"), path)
    return files.read_records(spark, path, "page_id string, url string").select(F.col("page_id").cast("long").alias("page_id"), "url")


@query("select page_id, url from pages")
def json_envelope(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "envelope.json")
    sinks.write_enveloped(table(spark, sf, "pages").select("page_id", "url"), path, "results", '"total": 1')
    return files.read_enveloped(spark, path).select(F.col("page_id").cast("long").alias("page_id"), "url")


@query("""select source_file, count(*) as n, count(*) filter (url <> '') as with_url, count(*) filter (text <> '') as with_text from (
  select 'a.csv' as source_file, '' as url, text from benchmark union all select 'b.json', url, '' from pages) group by source_file""")
def dir_union(spark: SparkSession, sf: str) -> DataFrame:
    folder = scratch(spark, "folder")
    sinks.write_delimited_file(table(spark, sf, "benchmark"), folder + "/a.csv")
    sinks.write_json_array(table(spark, sf, "pages").select("page_id", "url"), folder + "/b.json")
    files.write_bytes(spark, folder + "/c.json", b"[1, ")
    rows = files.read_folder(spark, folder, lambda name, why: None)
    return rows.groupBy("source_file").agg(F.count("*").alias("n"), F.count_if(F.col("url") != "").alias("with_url"), F.count_if(F.col("text") != "").alias("with_text"))


@query("select item_id::varchar as item_id, text from benchmark")
def tsv_sink(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "tsv")
    files.write_delimited(table(spark, sf, "benchmark"), path, "\t")
    return files.read_csv(spark, path, "\t").select("item_id", "text")


@query("select page_id::varchar as page_id, url from pages")
def spreadsheet_sink(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "book.xml")
    sinks.write_spreadsheet_xml({"Pages": table(spark, sf, "pages").select("page_id", "url")}, path)
    found = sinks.read_sheet_rows(spark, path).where(F.get("cells", 0) != "page_id")
    return found.select(F.get("cells", 0).alias("page_id"), F.get("cells", 1).alias("url"))


@query("select page_id::varchar as page_id, url from pages")
def xlsx_sink(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "book.xlsx")
    sinks.write_xlsx({"Pages": table(spark, sf, "pages").select("page_id", "url")}, path)
    found = sinks.read_xlsx_rows(spark, path).where(F.get("cells", 0) != "page_id")
    return found.select(F.get("cells", 0).alias("page_id"), F.get("cells", 1).alias("url"))


@query(f"select i::int as position, c as name from (select unnest([{', '.join(repr(c) for c in [*fixed.FIRST_COLUMNS[:2], 'text', 'lang', 'n_chars'])}]) as c, unnest(range(0, 5)) as i)")
def column_order(spark: SparkSession, sf: str) -> DataFrame:
    names = listings.ordered_columns(["n_chars", "text", "lang", *reversed(fixed.FIRST_COLUMNS[:2])])
    return spark.range(1).select(F.posexplode(F.array(*(F.lit(c) for c in names))).alias("position", "name"))


# --- models: boundaries with deterministic stand-ins ------------------------------------------------------------------


def _digest_vector(text: str) -> str:
    """The unrounded coordinates of the stand-in for an embedding model."""
    return f"list_transform(range(0, 16), lambda i: ('0x' || substr(sha256({text}), 2 * i::int + 1, 2))::int / 127.5::double - 1)"


@query(f"""select item_id, round(v[1] / n, 5) as first, round(v[16] / n, 5) as last from (select item_id, v, sqrt(list_dot_product(v, v)) as n from (select item_id, {_digest_vector("text")} as v from benchmark))""")
def corpus_embedding(spark: SparkSession, sf: str) -> DataFrame:
    e = build.embed(table(spark, sf, "benchmark"), "text", build.stub_embedder())
    return e.select("item_id", F.round(F.get("embedding", 0).cast("double"), 5).alias("first"), F.round(F.get("embedding", 15).cast("double"), 5).alias("last"))


@query(f"""with e as (select item_id, {_digest_vector("text")} as v from benchmark), q as (select {_digest_vector("'a quiet sea'")} as v)
select item_id as record_id, round(list_dot_product(e.v, q.v) / sqrt(list_dot_product(e.v, e.v) * list_dot_product(q.v, q.v)), 5) as vector_similarity from e, q
order by list_dot_product(e.v, q.v) / sqrt(list_dot_product(e.v, e.v)) desc, item_id limit 5""")
def story_search(spark: SparkSession, sf: str) -> DataFrame:
    model = build.stub_embedder()
    store = build.embed(table(spark, sf, "benchmark").withColumnRenamed("item_id", "record_id"), "text", model)

    def one(text: str) -> list[float]:
        (v,) = model([text])
        length = sum(x * x for x in v) ** 0.5
        return [x / length for x in v]

    return retrieval.search_stories(store, "  a quiet\n sea ", 5, one).select("record_id", F.round("vector_similarity", 5).alias("vector_similarity"))


@query("""select conv_id as batch, count(*) as n, count(distinct turn) = count(*) and min(turn) = 0 and max(turn) = count(*) - 1 as contiguous,
  array_to_string(list(coalesce(role, '') order by turn, role), ',') as answers from conversations group by conv_id""")
def answer_order(spark: SparkSession, sf: str) -> DataFrame:
    answers = table(spark, sf, "conversations").select(F.col("conv_id").alias("batch"), F.col("turn").alias("index"), F.coalesce("role", F.lit("")).alias("answer"))
    return build.answer_order(answers).select("batch", "n", "contiguous", F.array_join("answers", ",").alias("answers"))


def _stub_features(summary: str) -> str:
    """A stand-in for the feature model: words of the summary as keywords, its length on every axis; sometimes none of use."""
    words = summary.lower().split()[:5]
    return json.dumps({"rich_descriptive_paragraph": " " + summary[:40], "keywords": words, "emotional_scores": {a: (len(summary) % 11) / 10 for a in fixed.AXES}})


_LETTERS = "regexp_extract_all(text, '[^\\s]+')"


@query(f"""select item_id, len({_LETTERS}) >= 5 as usable, case when len({_LETTERS}) >= 5 then trim(substr(text, 1, 40), {_BLANKS}) end as paragraph, case when len({_LETTERS}) >= 5 then array_to_string(list_transform(({_LETTERS})[1:5], lambda w: lower(w)), ',') end as keywords,
  case when len({_LETTERS}) >= 5 then round((length(text) % 11) / 10.0::double, 6) end as hope from (select item_id, case when item_id % 9 = 0 then 'too short' else text end as text from benchmark)""")
def feature_extraction(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "benchmark").select("item_id", F.when(F.col("item_id") % 9 == 0, "too short").otherwise(F.col("text")).alias("summary"))
    made = assistant.extract_features(items, _stub_features)
    return made.select("item_id", F.col("error").isNull().alias("usable"), F.col("rich_descriptive_paragraph").alias("paragraph"), F.array_join("keywords", ",").alias("keywords"), six(F.element_at("emotional_scores", "hope")).alias("hope"))


@query(f"""with {_STORIES}, f as (select doc_id, coalesce(nullif(trim(title, {_BLANKS}), ''), 'Untitled') as named, title, text, record_id, cmu_id, ({_terms('text')})[1:5] as k from stories)
select doc_id, coalesce(nullif(trim(coalesce(nullif(record_id, ''), nullif(cmu_id, '')), {_BLANKS}), ''), 'story-' || doc_id || '-' || substr(sha256(title || chr(0) || coalesce(text, '')), 1, 12)) as record_id,
  sha256('{{"summary":' || to_json(text) || ',"title":' || to_json(title) || '}}') as source_record_hash, 'Title: ' || named || ' | Atmosphere: ' || array_to_string(k, ', ') || ' | Summary: p' as search_payload from f""")
def feature_merge(spark: SparkSession, sf: str) -> DataFrame:
    s = stories(spark, sf).select("doc_id", F.col("doc_id").alias("ordinal"), "record_id", "cmu_id", "title", F.col("text").alias("summary"), F.slice(T.terms(F.col("text")), 1, 5).alias("keywords"), F.lit("p").alias("rich_descriptive_paragraph"))
    return assistant.processed(s).select("doc_id", "record_id", "source_record_hash", "search_payload")


@query("""select 'first' as build, 0::bigint as reused, 0::bigint as cached, count(*) as pending, count(*) as total, false as current from benchmark
union all select 'same', count(*), 0, 0, count(*), true from benchmark
union all select 'changed', count(*) filter (item_id % 3 > 0), 0, count(*) filter (item_id % 3 = 0), count(*), false from benchmark""")
def rebuild_counts(spark: SparkSession, sf: str) -> DataFrame:
    """A build, the same again, and one in which a third of the stories changed."""
    path = scratch(spark, "stories")
    models = story_plans.Models(_stub_features, build.stub_embedder(), "f1", "e1", 16)
    source = table(spark, sf, "benchmark").select(F.col("item_id").alias("ordinal"), F.concat(F.lit("T"), F.col("item_id").cast("string")).alias("title"), F.concat("text", F.lit(" one two three four five")).alias("summary"))
    changed = source.withColumn("summary", F.when(F.col("ordinal") % 3 == 0, F.concat("summary", F.lit(" more"))).otherwise(F.col("summary")))
    out = []
    for name, rows in (("first", source), ("same", source), ("changed", changed)):
        counts = story_plans.build_store(rows, path, models)
        out.append((name, counts["reused"], counts["cached"], counts["pending"], counts["total"], counts["current"]))
    return spark.createDataFrame(out, "build string, reused long, cached long, pending long, total long, current boolean")


@query("select count(*) as n, 64::bigint as width, true as normalized, min(vec_id) as least, max(vec_id) as largest from embeddings")
def store_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "store")
    stores.write_store(table(spark, sf, "embeddings"), path, "m", "f", "vec_id")
    rows, meta = stores.load_store(spark, path, "vec_id")
    return rows.agg(F.lit(meta["n"]).cast("long").alias("n"), F.lit(meta["width"]).cast("long").alias("width"), F.lit(meta["normalized"]).alias("normalized"), F.min("vec_id").alias("least"), F.max("vec_id").alias("largest"))


_PROMPTS = "case turn % 4 when 0 then text when 1 then ' ' || chr(10) when 2 then repeat(coalesce(text, ''), 40) else null end"


@query(f"""select conv_id, turn, q <> '' and length(q) <= 4000 and turn % 5 > 0 as accepted from (select conv_id, turn, trim(regexp_replace(nfc_normalize(coalesce({_PROMPTS}, '')), '[\\s\\x{{1c}}-\\x{{1f}}\\x{{85}}\\x{{a0}}]+', ' ', 'g')) as q from conversations)""")
def search_guards(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").withColumn("prompt", F.expr(_PROMPTS.replace("chr(10)", "'\\n'")))
    return c.select("conv_id", "turn", search.accepted(assistant.canonical(F.col("prompt")), F.col("turn") % 5).alias("accepted"))


@query("""select conv_id, len(ids) between 1 and 5 and len(list_distinct(ids)) = len(ids) and list_count(list_filter(ids, lambda i: trim(i) = '')) = 0 as accepted
from (select conv_id, list(case when conv_id % 7 = 0 and turn = 1 then ' ' when conv_id % 5 = 0 then 'same' else 'r' || turn end) as ids from conversations group by conv_id)""")
def rerank_guards(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("conv_id")
    ids = F.collect_list(F.when((n % 7 == 0) & (F.col("turn") == 1), " ").when(n % 5 == 0, "same").otherwise(F.concat(F.lit("r"), F.col("turn").cast("string"))))
    return table(spark, sf, "conversations").groupBy("conv_id").agg(ids.alias("ids")).select("conv_id", recommend.acceptable(F.lit("p"), F.col("ids")).alias("accepted"))


@query("select doc_id, trim(regexp_replace(nfc_normalize(coalesce(text, '')), '[\\s\\x{1c}-\\x{1f}\\x{85}\\x{a0}]+', ' ', 'g')) as query from documents")
def canonical_query(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.coalesce(assistant.canonical(F.col("text")), F.lit("")).alias("query"))


@query("""select conv_id, turn, sha256('search' || chr(0) || 'fp' || chr(0) || coalesce(text, '')) as key from conversations""")
def cache_keys(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", T.cache_key("search", "fp", T.blank(F.col("text"))).alias("key"))


@query(f"select doc_id, trim('q' || doc_id || ' ' || array_to_string(({_terms('text')})[1:4], ' ')) as prompt from documents")
def search_prompt(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select("doc_id", retrieval.intent_prompts(F.concat(F.lit("q"), F.col("doc_id").cast("string")), F.slice(T.terms(F.col("text")), 1, 4)).alias("prompt"))


@query("""select page_id, 'T' || page_id || '. ' || case when length(t) > 150 then rtrim(substr(t, 1, 150)) || '…' else t end as speech from (
  select page_id, trim(regexp_replace(regexp_replace(html, '(?i)</?div\\b[^>]*>', '', 'g'), '\\s+', ' ', 'g')) as t from pages) where t <> ''""")
def speech_script(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", T.speech(F.concat(F.lit("T"), F.col("page_id").cast("string")), F.col("html"), 150).alias("speech")).where("speech is not null")


@query("select page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;'), chr(39), '&apos;') as escaped from pages")
def markup_escape(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", T.escape_markup(F.col("html")).alias("escaped"))


_KINDS = " ".join(f"when '{k}' then '{v}'" for k, v in fixed.EMOJI.items())


@query(f"with {_CATALOG} select id, case case when id % 9 = 0 then 'play' else type end {_KINDS} else '{fixed.NO_EMOJI}' end as emoji from catalog")
def type_emoji(spark: SparkSession, sf: str) -> DataFrame:
    return catalog(spark, sf).select("id", T.emoji(F.when(F.col("id") % 9 == 0, "play").otherwise(F.col("type"))).alias("emoji"))


def _said(value: str, high_low: tuple[str, str]) -> str:
    high, low = (x.replace("'", "''") for x in high_low)
    return f"case when {value} >= 0.66 then '{high}' when {value} <= 0.34 then '{low}' end"


_EXPLAINED = "[" + ", ".join(_said(f"mood[{i + 1}]", fixed.PHRASES[a]) for i, a in enumerate(fixed.AXES)) + "]"
_JOINED = "case when len({x}) = 1 then {x}[1] else array_to_string({x}[1:len({x}) - 1], ', ') || ' and ' || {x}[len({x})] end"


@query(f"""with {_CATALOG}, top as (select id, list(i order by agreement desc, i)[1:3] as best from (
    select id, i, (1 - abs(mood[i] - ({_TARGET})[i])) * (1 + abs(mood[i] - 0.5) * 2) as agreement from (select id, mood, unnest(range(1, 13)) as i from catalog)) group by id),
s as (select c.id, themes, list_filter(list_transform(best, lambda i: ({_EXPLAINED})[i]), lambda p: p is not null) as said from catalog c join top using (id))
select id, '**T' || id || '** by C (2001). A pitch.' || case when len(said) > 0 then ' It is ' || {_JOINED.format(x='said')} || '{fixed.LINED_UP}' else '' end
  || case when len(themes) > 0 then ' It touches on ' || {_JOINED.format(x='themes')} || '.' else '' end || case when id % 2 = 0 then ' An arc.' else '' end as paragraph from s""")
def explain_text(spark: SparkSession, sf: str) -> DataFrame:
    pool = catalog(spark, sf).withColumns({"title": F.concat(F.lit("T"), F.col("id").cast("string")), "creator": F.lit("C"), "year": F.lit(2001), "pitch": F.lit("A pitch."), "emotional_arc": F.when(F.col("id") % 2 == 0, "An arc")})
    return pool.select("id", mood.explanation(mood.vector_literal(TARGET)).alias("paragraph"))


@query("""select conv_id, turn, case when turn % 3 < 2 then 'i' || conv_id end as intent, case when turn % 3 < 2 then 'a,b,c' end as keywords from conversations""")
def fenced_json(spark: SparkSession, sf: str) -> DataFrame:
    """Answers of a model: an object in a fence, one with text around it, and one without any object."""
    c = table(spark, sf, "conversations")
    value = F.concat(F.lit('{"intent": " i'), F.col("conv_id").cast("string"), F.lit('", "keywords": ["A", "b ", "C"], "query": ""}'))
    answer = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("```json\n"), value, F.lit("\n```"))).when(F.col("turn") % 3 == 1, F.concat(F.lit("Here: "), value, F.lit(" and {more}"))).otherwise("no object")
    read = recommend.cleaned_intents(c.withColumn("answer", answer), "answer", "text")
    return read.select("conv_id", "turn", F.col("result.intent").alias("intent"), F.array_join("result.keywords", ",").alias("keywords"))


@query(f"""with {_STORIES}, a as (select conv_id * 1000 + turn as request_id, (conv_id * 7 + turn)::varchar as record_id from conversations), f as (select min(doc_id) as first from stories)
select request_id, coalesce(s.doc_id, f.first)::varchar as record_id, coalesce(s.title, (select title from stories order by doc_id limit 1)) as title from a cross join f left join stories s on s.doc_id::varchar = a.record_id""")
def lookup_or_first(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    answers = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("request_id"), (F.col("conv_id") * 7 + F.col("turn")).cast("string").alias("record_id"))
    return recommend.chosen_or_first_each(_candidates(spark, sf).select("position", "record_id", "title"), answers).select("request_id", "record_id", "title")


@query("""select doc_id, replace(text, 'a', '₹') as text from documents""")
def mojibake_repair(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", listings.mojibake(F.replace("text", F.lit("a"), F.lit("â‚¹"))).alias("text"))


SETTINGS = """\ufeff# comment
A=1
 export=x y # note
B = 'q # kept'
A=2
1C=3
EMPTY=
D="
no sign
E_1=a=b
"""


@query("""select * from (values ('A', '1'), ('export', 'x y'), ('B', 'q # kept'), ('D', '"'), ('E_1', 'a=b')) as t(key, value)""")
def config_scan(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "settings.env")
    files.write_bytes(spark, path, SETTINGS.encode())
    return settings.read_settings(spark, path)


@query("select count(*) as n, min(item_id) as least, max(item_id) as largest from benchmark")
def artifact_copy(spark: SparkSession, sf: str) -> DataFrame:
    path = settings.shared_copy(spark, f"{sf}/benchmark.parquet")
    return spark.read.parquet(path).agg(F.count("*").alias("n"), F.min("item_id").alias("least"), F.max("item_id").alias("largest"))


def _stub_voice(script: str) -> bytes:
    return hashlib.sha256(script.encode()).hexdigest().encode()


@query("""select item_id, text <> '' as spoken, case when text <> '' then sha256('T. ' || case when length(text) > 3500 then rtrim(substr(text, 1, 3500)) || '…' else text end) end as audio
from (select item_id, case when item_id % 5 = 0 then '' else trim(regexp_replace(text, '\\s+', ' ', 'g')) end as text from benchmark)""")
def speech_audio(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "benchmark").select("item_id", F.lit("T").alias("title"), F.when(F.col("item_id") % 5 == 0, " ").otherwise(F.col("text")).alias("summary"))
    return audio.speak(items, _stub_voice).select("item_id", F.col("error").isNull().alias("spoken"), F.decode("audio", "utf-8").alias("audio"))


@query("""select item_id, case when item_id % 5 = 0 then null when length(text) > 200 then null else trim(regexp_replace(text, '\\s+', ' ', 'g')) end as transcript from benchmark""")
def voice_transcripts(spark: SparkSession, sf: str) -> DataFrame:
    # Four bytes a character, so that the most bytes of a recording stand for 200 characters of any script.
    sounds = table(spark, sf, "benchmark").select("item_id", F.when(F.col("item_id") % 5 > 0, F.encode("text", "utf-32")).otherwise(F.lit(b"")).alias("audio"))
    return audio.transcribe(sounds, lambda b: b.decode("utf-32-be"), 4 * 200).select("item_id", "transcript")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
