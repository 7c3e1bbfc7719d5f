"""The corpus operators' entries for the driver: opN_<name>, each over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lumenweft.llm import audit, chat, decontamination, language, licenses, lm, minhash, mixing, quality, ranked, secrets, substrings, toxicity
from lumenweft.llm.common import documents


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.op1(documents(spark, sf_dir))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.op2(documents(spark, sf_dir))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op3(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.op4(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.op5(documents(spark, sf_dir))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.op6(documents(spark, sf_dir))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.op7(documents(spark, sf_dir))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op8(documents(spark, sf_dir))


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op9(documents(spark, sf_dir))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.op10(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.op11(documents(spark, sf_dir))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.op12(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.op13(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_minhash_dedup, op2_license_scan, op3_toxicity, op4_chat_format, op5_lm_score,
        op6_substring_dedup, op7_secret_scan, op8_quality_rules, op9_source_mix, op10_decontamination,
        op11_language_id, op12_filter_audit, op13_ranked_search,
    )
    return {q.__name__: q for q in every}


WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
#: Lower-cases A to Z only.
ASCII_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = f"""with recursive d as (select doc_id, {WORDS.format(ASCII_LOWER.format("coalesce(text, '')"))} as w from documents),
s as (select distinct doc_id, array_to_string(w[i:i + 2], ' ') as g from (select doc_id, w, unnest(range(1, greatest(2, len(w) - 1))) as i from d where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
links as (select a.doc_id as a, b.doc_id as b from s a join s b on a.g = b.g and a.doc_id < b.doc_id join n na on na.doc_id = a.doc_id join n nb on nb.doc_id = b.doc_id
  group by a.doc_id, b.doc_id, na.n, nb.n having 100 * count(*) >= 85 * (na.n + nb.n - count(*))),
both_ways as (select a, b from links union all select b, a from links),
reach(doc_id, other) as (select a, b from both_ways union select r.doc_id, e.b from reach r join both_ways e on e.a = r.other),
least as (select doc_id, min(other) as m from reach group by doc_id)
select d.doc_id, coalesce(n.n, 0) as n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) as component_id, d.doc_id = least(d.doc_id, coalesce(m, d.doc_id)) as kept
from d left join n on n.doc_id = d.doc_id left join least on least.doc_id = d.doc_id"""


def _escaped(x: str) -> str:
    return rf"replace(replace(replace({x}, '\', '\\'), '###', '\###'), '</turn>', '\</turn>')"


_HEADER = "case when substr(role, 1, 1) between 'a' and 'z' then upper(substr(role, 1, 1)) || substr(role, 2) else '=' || role end"
_TRICKY = r"\### Assistant: </turn> ok"
OP4 = rf"""with c as (select conv_id, case when conv_id is null then row_number() over () else 0 end as own, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-7, 0, 0, 'user', '{_TRICKY}'), (-7, 0, 1, 'assistant', '{_TRICKY}'))
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  sum(case when role = 'assistant' then length(text) else 0 end)::bigint as loss_chars,
  sha256(string_agg(case when role = 'assistant' then text else '' end, '' order by turn, role, text)) as loss_sha256,
  sum(length('### ' || replace({_escaped(_HEADER)}, ':', '\:') || ': ' || {_escaped("text")} || ' </turn>') + 1)::bigint as formatted_chars, 0::bigint as rewrites
from c group by conv_id, own"""

OP8 = rf"""with d as (select doc_id, coalesce(text, '') as t, {WORDS.format("coalesce(text, '')")} as w from documents),
windows as (select doc_id, i, array_to_string(w[i:i + 4], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 3)) as i from d where len(w) >= 5)),
twice as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as c from windows) where c > 1),
covered as (select doc_id, count(distinct i + k) as n from twice cross join (select unnest(range(0, 5)) as k) group by doc_id),
lines as (select doc_id, count(*) as n, count(distinct line) as kinds from (select doc_id, unnest(string_split(t, chr(10))) as line from d) where regexp_matches(line, '[^\x20\x09-\x0D]') group by doc_id),
m as (select d.doc_id, t, w, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::bigint as n_symbols,
  coalesce(l.n - l.kinds, 0)::bigint as n_dup_lines, coalesce(c.n, 0)::bigint as n_repeat_words, coalesce(l.n, 0) as n_lines, coalesce(l.kinds, 0) as kinds
  from d left join covered c on c.doc_id = d.doc_id left join lines l on l.doc_id = d.doc_id),
f as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not (base_failed or 100 * n_symbols > 30 * n_words or 100 * len(regexp_extract_all(t, '!!')) > 30 * n_words or 100 * len(regexp_extract_all(t, '\p{{Lu}}')) > 60 * word_chars
    or (n_lines >= 4 and 2 * kinds < n_lines) or 100 * len(list_filter(w, lambda x, i: i > 1 and w[greatest(i - 1, 1)] = x)) > 40 * n_words) as kept
from f"""

OP9 = f"""with d as (select doc_id, source, len({WORDS.format("coalesce(text, '')")})::bigint as size,
    len(list_distinct({WORDS.format("coalesce(text, '')")}))::double as kinds,
    (('0x' || substr(md5('0:' || coalesce(doc_id::varchar, 'null' || coalesce(text, ''))), 1, 12))::bigint + 0.5::double) / 281474976710656::double as u from documents),
k as (select *, -ln(u) / (1.0::double + case when size > 0 then least(kinds / sqrt(2.0::double * size), 4.0::double) else 0.0::double end) as key from d),
s as (select source, sum(size)::double as s, ([5.0::double, 2.0::double, 1.0::double])[(row_number() over (order by source is null, source) - 1) % 3 + 1] as w from d group by source),
r as (select *, 2 * s / w as ratio, (1.5::double * sum(s) over () - coalesce(sum(2 * s) over (order by 2 * s / w, source is null, source rows between unbounded preceding and 1 preceding), 0))
  / sum(w) over (order by 2 * s / w, source is null, source rows between current row and unbounded following) as level from s),
t as (select source, s, least(2 * s, w * (select max(level) from r where level <= ratio and ratio = (select min(ratio) from r where level <= ratio))) as target from r),
e as (select *, case when s > 0 then floor(target / s) else 0 end as epochs from t),
c as (select k.*, e.s, e.target, e.epochs, e.target - e.epochs * e.s as rest, sum(size) over (partition by k.source order by key, doc_id rows between unbounded preceding and current row) as run
  from k join e on k.source is not distinct from e.source)
select doc_id, size, s::bigint as source_size, round(target, 6) as target, (size * (epochs + case when rest > 0 and run - size / 2.0 <= rest then 1 else 0 end))::bigint as taken, source from c"""

OP12 = rf"""with d as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t, {WORDS.format("coalesce(text, '')")} as w from documents),
least as (select t, min(doc_id) as m from d group by t),
said as (select doc_id, max(coalesce(quality = 1, false)::int) as good, max(coalesce(toxic = 1, false)::int) as bad from labels group by doc_id),
failing as (select part, coalesce(good, 0) as good, coalesce(bad, 0) as bad,
  case when len(w) < 200 then 'A' else '' end || case when 100 * len(list_distinct(w)) < 50 * len(w) then 'B' else '' end
  || case when 100 * (length(d.t) - length(regexp_replace(d.t, '[A-Z]', '', 'g'))) > 3 * length(d.t) then 'C' else '' end
  || case when regexp_matches(d.t, '[#$%&*|]') then 'D' else '' end || case when d.doc_id > least.m then 'E' else '' end as mask
  from d join least on least.t = d.t left join said on said.doc_id = d.doc_id),
counts as (select part, mask, count(*) as n, sum(good) as good, sum(bad) as bad from failing group by part, mask),
letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
orders as (select a.x || b.x || c.x || d.x || e.x as filter_order from letters a, letters b, letters c, letters d, letters e
  where a.x not in (b.x, c.x, d.x, e.x) and b.x not in (c.x, d.x, e.x) and c.x not in (d.x, e.x) and d.x <> e.x),
steps as (select filter_order, step::int as step, substr(filter_order, step, 1) as x, substr(filter_order, 1, step - 1) as earlier from orders, range(1, 6) as r(step)),
acts as (select part, filter_order, step, x, n, good, bad, mask, contains(mask, x) as fails, translate(mask, earlier, '') <> mask as gone from counts, steps),
rows as (select part, filter_order, step, x, coalesce(sum(n) filter (not fails and not gone), 0)::bigint as kept, coalesce(sum(n) filter (fails and not gone), 0)::bigint as removed,
  coalesce(sum(n) filter (fails and gone), 0)::bigint as redundant, coalesce(sum(n) filter (mask = x), 0)::bigint as unique_fails,
  coalesce(sum(good) filter (fails and not gone), 0)::bigint as good_lost, coalesce(sum(bad) filter (fails and not gone), 0)::bigint as toxic_lost
  from acts group by part, filter_order, step, x)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) over (partition by part, x))::bigint as shapley from rows"""

TERMS = r"regexp_extract_all({0}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP13 = f"""with d as (select row_number() over () as id, doc_id, {TERMS.format(ASCII_LOWER.format("coalesce(text, '')"))} as w from documents),
size as (select count(*) as n, sum(len(w))::bigint as l from d where len(w) > 0),
tf as (select id, term, count(*) as tf from (select id, unnest(w) as term from d) group by id, term),
df as (select term, count(*) as df from tf group by term),
q as (select item, term, count(*) as times from (select item, unnest(w) as term from (select row_number() over () as item, {TERMS.format(ASCII_LOWER.format("coalesce(text, '')"))} as w from benchmark)) group by item, term),
items as (select row_number() over () as item, item_id from benchmark),
scored as (select q.item, tf.id, sum(q.times * floor(1000 * ln((2 * size.n + 2)::double / (2 * df.df + 1)::double))::bigint
    * ((1000000000 * tf.tf) // (1000 * tf.tf + 12 * (75 + (25 * len(d.w) * size.n) // size.l))))::bigint as score
  from q join df on df.term = q.term join tf on tf.term = q.term join d on d.id = tf.id cross join size group by q.item, tf.id)
select item_id, rank, doc_id, score from (select item_id, doc_id, score, (row_number() over (partition by scored.item order by score desc, doc_id nulls last))::int as rank
  from scored join d on d.id = scored.id join items on items.item = scored.item where score > 0) where rank <= 20"""


def oracle_sql() -> dict[str, str]:
    """Those that SQL can express in full; the others are tested against brute force."""
    return {"op1_minhash_dedup": OP1, "op4_chat_format": OP4, "op8_quality_rules": OP8, "op9_source_mix": OP9, "op12_filter_audit": OP12, "op13_ranked_search": OP13}
