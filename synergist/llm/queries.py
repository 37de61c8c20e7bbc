"""Registered queries of the corpus operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import chat, collocations, decontaminate, divergence, exactdedup, langid, licenses, mixing, neardup, packing, quality, tokenfile, toxicity

Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op2_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.encode_documents(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_read(spark, sf_dir, "documents"), ["doc_id"])


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_read(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = mixing.sample(_read(spark, sf_dir, "documents"))
    return got.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.deduplicate(spark, f"{sf_dir}/documents.parquet")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")).drop("items")


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_read(spark, sf_dir, "documents"), shingle=3, num=85, den=100)


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.sql(f"select * from values (-7L, 0L, 'user', '{said}'), (-7L, 1L, 'assistant', '{said}') as t(conv_id, turn, role, text)")
    return chat.format_and_read(turns.unionByName(more))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_read(spark, sf_dir, "documents"), min_docs=30, top=50)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(_read(spark, sf_dir, "documents"), min_count=30, top=2000)


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), capacity=2048)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_quality, op2_tokens, op3_licenses, op4_language, op5_toxicity, op6_mixing, op7_exact_dedup, op8_decontaminate, op9_near_dedup, op10_chat, op11_divergence, op12_collocations, op13_packing, pipeline)}

_MIXING_SQL = r"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
    coalesce('s' || source, 'n') as s, md5(coalesce(doc_id::varchar, '')) as h
  from documents),
src as (
  select s, any_value(source) as source, sum(size)::bigint as source_size from d group by s),
w as (
  select *, list_extract([5.0::double, 2.0, 1.0], ((row_number() over (order by source is null, source) - 1) % 3 + 1)::int) as weight,
    sum(source_size) over ()::double as total
  from src),
o as (
  select *, source_size * 2.0::double as stop from w),
lv as (
  select *, (total * 1.5 - coalesce(sum(stop) over (order by stop / weight, source is null, source rows between unbounded preceding and 1 preceding), 0))
    / sum(weight) over (order by stop / weight, source is null, source rows between current row and unbounded following) as level
  from o),
t as (
  select *, least(stop, coalesce((select arg_min(x.level, x.stop / x.weight) from lv x where x.level * x.weight <= x.stop) * weight, stop)) as target
  from lv),
r as (
  select d.*, t.source_size, t.target, case when t.source_size > 0 then t.target / t.source_size else 0 end as rate,
    ('0x' || substr(md5('42:' || d.s), 1, 8))::bigint::double / 4294967296.0::double as u,
    row_number() over (partition by d.s order by d.size desc, d.h, d.doc_id) as k
  from d join t using (s))
select doc_id, size, source_size, round(target, 6) as target,
  ((floor(u + rate * k) - floor(u + rate * (k - 1)))::bigint * size)::bigint as taken
from r
"""

_DECONTAMINATE_SQL = r"""
with dw as (
  select doc_id, row_number() over () as r,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents),
bw as (
  select item_id::varchar as item,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark where item_id is not null),
bi as (
  select item, w, least(10, len(w)) as n from bw where len(w) > 0),
bp as (
  select item, w, n, unnest(range(1, len(w) - n + 2)) as i from bi),
bx as (
  select distinct item, n, array_to_string(list_slice(w, i, i + n - 1), ' ') as win from bp),
ns as (
  select distinct n from bx),
dp as (
  select r, w, n, unnest(range(1, len(w) - n + 2)) as i from dw, ns where len(w) >= n),
dx as (
  select r, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') as win from dp),
h as (
  select r, i, dx.n, item from dx join bx on dx.win = bx.win and dx.n = bx.n),
pos as (
  select r, unnest(range(i, i + n)) as p from h),
np as (
  select r, count(distinct p) as n_hit from pos group by r),
it as (
  select r, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as items from h group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from dw left join np using (r) left join it using (r)
"""

_CHAT_SQL = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e as (
  select *, regexp_replace(replace(text, '\', '\\'),
    '(<|\[)((?:\|(?:turn|end|image|audio|document|im_start|im_end|endoftext|system|user|assistant)\|>)|(?:/?s>)|(?:/?INST\])|(?:</?SYS>>))', '\1\\\2', 'g') as escaped
  from t)
select conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn)) as turns_sha256,
  sum(case when role = 'assistant' then length(text) else 0 end)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn) filter (where role = 'assistant'), '')) as loss_sha256,
  sum(length(role) + length(escaped) + length('<|turn|>') + length('<|end|>') + 2)::bigint as formatted_chars
from e group by conv_id
"""

_DIVERGENCE_SQL = r"""
with d as (
  select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as ts
  from documents),
grp as (
  select distinct lang, source from d),
occ as (
  select lang, source, r, unnest(ts) as term from d),
kept as (
  select lang, term from occ group by all having count(distinct r) >= 30),
c as (
  select lang, source, term, count(*)::hugeint as n from occ join kept using (lang, term) group by all),
v as (
  select lang, count(*)::hugeint as v from kept group by lang),
gn as (
  select lang, source, sum(n)::hugeint as total from c group by all),
ln as (
  select lang, sum(n)::hugeint as total from c group by lang),
p as (
  select g.lang, g.source, k.term, coalesce(c.n, 0) as n,
    1 + (1000000000::hugeint * (coalesce(c.n, 0) + 5)) // (coalesce(gn.total, 0) + 5 * v.v) as p
  from grp g join kept k on g.lang = k.lang join v on v.lang = g.lang
    left join gn on gn.lang = g.lang and gn.source = g.source
    left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
q as (
  select lang, term, 1 + (1000000000::hugeint * (sum(n)::hugeint + 5)) // (any_value(ln.total) + 5 * any_value(v.v)) as q
  from c join ln using (lang) join v using (lang) group by lang, term),
pv as (
  select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value
  from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pairs as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(pv.value, 0)::bigint as value
  from grp a join grp b on a.lang = b.lang and a.source <> b.source
    left join pv on pv.lang = a.lang and pv.source = a.source and pv.item = b.source),
terms as (
  select p.lang, p.source, 'term' as part, p.term as item, (p.p - q.q)::bigint as value
  from p join q on p.lang = q.lang and p.term = q.term where p.n > 0 and p.p > q.q),
ranked as (
  select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank
  from (select * from pairs union all select * from terms))
select lang, source, part, item, value, rank from ranked where part = 'pair' or rank <= 50
"""

_COLLOCATIONS_SQL = r"""
with d as (
  select coalesce(lang, 'und') as lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
  from documents),
w as (
  select lang, regexp_extract_all(piece, '[^\x20\x09]+') as ws from d),
g as (
  select lang, k, array_to_string(list_slice(ws, i, i + k - 1), ' ') as phrase
  from (select lang, ws, k, unnest(range(1, len(ws) - k + 2)) as i from w, (values (1), (2), (3), (4)) ks(k) where len(ws) >= k)),
f as (
  select lang, k, phrase, count(*)::hugeint as f from g group by all),
n as (
  select lang, sum(f)::bigint as n from f where k = 1 group by lang),
c as (
  select lang, k, phrase, f as a, string_split(phrase, ' ') as ws from f where k >= 2 and f >= 30),
cut as (
  select lang, k, phrase, a, j, array_to_string(ws[1:j], ' ') as x, array_to_string(ws[j + 1:], ' ') as y
  from (select *, unnest(range(1, k)) as j from c)),
s as (
  select cut.lang, cut.k, cut.phrase, cut.a, j, x.f as l, y.f as r, (2000000::hugeint * a) // (x.f + y.f) as score
  from cut join f x on x.lang = cut.lang and x.k = j and x.phrase = cut.x join f y on y.lang = cut.lang and y.k = cut.k - j and y.phrase = cut.y),
best as (
  select * from s qualify row_number() over (partition by lang, k, phrase order by score, j) = 1),
inside as (
  select lang, m as k, array_to_string(list_slice(ws, i, i + m - 1), ' ') as phrase, max(a) as a
  from (select *, unnest(range(1, k - m + 2)) as i from (select *, unnest(range(2, k)) as m from c)) group by all),
kept as (
  select best.* from best left join inside using (lang, k, phrase) where inside.a is null or 100 * inside.a < 80 * best.a),
ranked as (
  select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
select lang, rank::bigint as rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n, score::bigint as score
from ranked join n using (lang) where rank <= 2000
"""

ORACLE: dict[str, str] = {
    "op6_mixing": _MIXING_SQL,
    "op7_exact_dedup": """
select doc_id, max(doc_id) over g as keep_id, (count(*) over g)::bigint as group_size, doc_id = max(doc_id) over g as kept,
  sha256(coalesce(text, '')) as text_sha256
from documents window g as (partition by coalesce(text, ''))
""",
    "op8_decontaminate": _DECONTAMINATE_SQL,
    "op9_near_dedup": r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents),
p as (
  select doc_id, w, unnest(range(1, len(w) - 1)) as i from w where len(w) >= 3),
s as (
  select distinct doc_id, array_to_string(list_slice(w, i, i + 2), ' ') as g from p
  union all select doc_id, array_to_string(w, ' ') from w where len(w) in (1, 2)),
n as (
  select doc_id, count(*) as n from s group by doc_id),
pairs as (
  select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
e as (
  select x, y from pairs join n nx on nx.doc_id = x join n ny on ny.doc_id = y where 100 * c >= 85 * (nx.n + ny.n - c)),
both_ as (
  select x, y from e union all select y, x from e),
reach as (
  select x as src, y as dst from both_ union select r.src, b.y from reach r join both_ b on r.dst = b.x),
comp as (
  select src as doc_id, min(dst) as m from reach group by src)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, least(d.doc_id, coalesce(comp.m, d.doc_id)) as component_id,
  d.doc_id = least(d.doc_id, coalesce(comp.m, d.doc_id)) as kept
from documents d left join n using (doc_id) left join comp using (doc_id)
""",
    "op10_chat": _CHAT_SQL,
    "op11_divergence": _DIVERGENCE_SQL,
    "op12_collocations": _COLLOCATIONS_SQL,
}
