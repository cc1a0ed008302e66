"""The operators over their whole tables, and SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from worklake.llm import (
    alignment,
    collocations,
    decontaminate,
    exact_dedup,
    near_dedup,
    packing,
    pii,
    preferences,
    quality,
    records,
    substrings,
    tokens,
    urls,
    warc,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents"))


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.report(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.report(table(spark, sf_dir, "documents"), tokens.vocabulary("word_bpe_49k.json"))


def op5_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preferences.report(table(spark, sf_dir, "conversations"))


def op6_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.report(table(spark, sf_dir, "documents"), tokens.vocabulary("byte_bpe_50k.json"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.report(table(spark, sf_dir, "documents"), size=2)


def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.report(table(spark, sf_dir, "pages"))


def op10_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.report(table(spark, sf_dir, "pages"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.report(table(spark, sf_dir, "documents"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return alignment.report(docs, tokens.vocabulary("byte_bpe_50k.json"), tokens.vocabulary("piece_bpe_32k.model"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.report(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_rules, op2_personal_data, op3_substring_dedup, op4_packing, op5_preference_pairs,
        op6_token_records, op7_decontamination, op8_near_duplicates, op9_url_rules, op10_warc_round_trip,
        op11_exact_dedup, op12_token_alignment, op13_collocations,
    )
}

ORACLES = {
    "op1_quality_rules": r"""
with t as (select doc_id, lang, coalesce(text, '') as t from documents),
w as (
  select doc_id, lang, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as ws,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls
  from t
),
g as (select doc_id, i, list_slice(ws, i, i + 4) as k from w, unnest(generate_series(1, len(ws) - 4)) as u(i)),
c as (select doc_id, i, count(*) over (partition by doc_id, k) as n from g),
r as (
  select doc_id, count(distinct i + j) as n from c, unnest(generate_series(0, 4)) as v(j) where n > 1 group by doc_id
),
m as (
  select w.doc_id, lang, len(ws) as n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) as word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as n_symbols,
    len(ls) - len(list_distinct(ls)) as n_dup_lines, coalesce(r.n, 0) as n_repeat_words,
    length(regexp_replace(t, '[^!]', '', 'g')) as n_shouts,
    len(list_filter(ws, lambda x: lower(x) in (
      'the','of','and','to','in','a','is','that','for','it','on','was','with','be','as','by','are','this','at','from','or',
      'an','have','not','le','la','les','de','des','du','et','en','un','une','que','qui','est','dans','pour','par','sur',
      'pas','au','elle','il','ce','ne','se','der','die','das','und','zu','den','mit','von','ist','auf','für','im','nicht',
      'ein','eine','als','auch','es','er','sie','dem','el','los','las','del','y','una','por','con','para','no','su','al','lo',
      'como','más','esta','ser'))) as n_stop_words,
    len(ls) as n_lines,
    len(list_filter(ls, lambda x: regexp_matches(x, '\.\.\.[\x20\x09-\x0D]*$'))) as n_cut_lines,
    len(list_filter(ls, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]'))) as n_bullet_lines
  from w left join r on r.doc_id = w.doc_id
),
b as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_shouts, n_stop_words, n_lines, n_cut_lines,
  n_bullet_lines, base_failed,
  not base_failed and word_chars * 1000 between n_words * 1500 and n_words * 25000 and n_symbols * 1000 <= n_words * 100
  and n_shouts * 1000 <= n_words * 100
  and ((n_stop_words + 1) * 1000 >= n_words * 60 or coalesce(lang, '') not in ('en', 'fr', 'de', 'es'))
  and n_dup_lines * 1000 <= n_lines * 400 and n_cut_lines * 1000 <= n_lines * 300 and n_bullet_lines * 1000 <= n_lines * 900
  as kept
from b
""",
    "op3_substring_dedup": r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
g as (
  select doc_id, i, array_to_string(list_slice(ws, i, i + 19), ' ') as k
  from w, unnest(generate_series(1, len(ws) - 19)) as u(i)
),
f as (select *, row_number() over (partition by k order by doc_id, i) as n from g),
x as (select distinct doc_id, i + j as i from f, unnest(generate_series(0, 19)) as v(j) where n > 1),
p as (select doc_id, i, ws[i] as word from w, unnest(generate_series(1, len(ws))) as u(i)),
k as (
  select p.doc_id, count(x.i) as n_removed, string_agg(word, ' ' order by p.i) filter (x.i is null) as kept
  from p left join x on x.doc_id = p.doc_id and x.i = p.i group by p.doc_id
)
select w.doc_id, len(ws) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from w left join k on k.doc_id = w.doc_id
""",
    "op5_preference_pairs": r"""
with t as (
  select conv_id, case when conv_id is null then row_number() over () end as lone,
    {'turn': turn, 'role': coalesce(role, 'unknown'), 'text': coalesce(text, '')} as t
  from conversations
),
e as (select conv_id, max({'turn': t.turn, 'text': t.text}) as e from t where t.role = 'assistant' and conv_id is not null group by conv_id),
x as (
  select t.conv_id as pair_id, lone, t as c, case when t.role = 'assistant' and t.turn is not distinct from e.e.turn and t.text = e.e.text
    and o.e is not null then {'turn': t.turn, 'role': t.role, 'text': o.e.text} else t end as r
  from t left join e on e.conv_id = t.conv_id left join e as o on o.conv_id = t.conv_id + 1
),
p as (select pair_id, list_sort(list(c)) as c, list_sort(list(r)) as r from x group by pair_id, lone),
k as (
  select pair_id, c, r, coalesce(list_min(list_filter(generate_series(0, least(len(c), len(r)) - 1),
    lambda i: c[i + 1].role <> r[i + 1].role or c[i + 1].text <> r[i + 1].text)), least(len(c), len(r))) as k
  from p
),
s as (select pair_id, k, c[1:k] as p, c[k + 1:] as c, r[k + 1:] as r from k)
select pair_id, cast(k as bigint) as n_prompt_turns,
  array_to_string(list_transform(p, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)), '') as prompt,
  array_to_string(list_transform(c, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)), '') as chosen,
  array_to_string(list_transform(r, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)), '') as rejected,
  array_to_string(list_transform(c, lambda t: (length(t.role) + 5) || ':0,' || (length(t.text) + 8) || ':' ||
    case when t.role = 'assistant' then '1' else '0' end), ',') as chosen_mask,
  array_to_string(list_transform(r, lambda t: (length(t.role) + 5) || ':0,' || (length(t.text) + 8) || ':' ||
    case when t.role = 'assistant' then '1' else '0' end), ',') as rejected_mask,
  len(c) = 0 and len(r) = 0 as same
from s
""",
    "op7_decontamination": r"""
with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws
  from documents
),
b as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws
  from benchmark
),
k as (
  select distinct item_id, list_slice(ws, i, i + least(len(ws), 10) - 1) as k
  from b, unnest(generate_series(1, greatest(len(ws) - 9, 1))) as u(i) where len(ws) > 0
),
n as (select distinct len(k) as n from k),
g as (select doc_id, i, n, list_slice(ws, i, i + n - 1) as k from d, n, unnest(generate_series(1, len(ws) - n + 1)) as u(i)),
f as (select doc_id, i, n, item_id from g join k using (k)),
h as (select doc_id, count(distinct i + j) as n_hit from f, unnest(generate_series(0, n - 1)) as v(j) group by doc_id),
m as (
  select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as items
  from (select distinct doc_id, cast(item_id as varchar) as item_id from f) group by doc_id
),
tm as (select k, t, min(o) as o from (select k, unnest(k) as t, generate_subscripts(k, 1) as o from (select distinct k from k)) group by k, t),
sn as (select t, count(*) as n from (select unnest(ws) as t from d) where t in (select t from tm) group by t),
rk as (
  select k, tm.t, row_number() over (partition by k order by n, o, tm.t) as rn, count(n) over (partition by k) as present, words
  from (select *, count(*) over (partition by k) as words from tm) as tm left join sn on sn.t = tm.t
  where len(k) >= 10 qualify n is not null
),
an as (select k, t, words from rk where rn <= present - ceil(words * 0.8) + 1),
ps as (
  select doc_id, ws[i] as t, list_slice(ws, greatest(i - 9, 1), i + 9) as around
  from d, unnest(generate_series(1, len(ws))) as u(i) where ws[i] in (select t from an)
),
nr as (select distinct doc_id, k from ps join an using (t) where 10 * len(list_intersect(around, k)) >= 8 * words),
nn as (
  select doc_id, count(distinct item_id) as n_near from nr join k using (k)
  where (doc_id, item_id) not in (select (doc_id, item_id) from f) group by doc_id
)
select d.doc_id, len(ws) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated, coalesce(n_near, 0) as n_near
from d left join h on h.doc_id = d.doc_id left join m on m.doc_id = d.doc_id left join nn on nn.doc_id = d.doc_id
""",
    "op8_near_duplicates": r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') as ws
  from documents
),
s as (
  select distinct doc_id, array_to_string(list_slice(ws, i, i + 1), ' ') as k
  from w, unnest(generate_series(1, greatest(len(ws) - 1, 1))) as u(i) where len(ws) > 0
),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as common from s as a join s as b using (k) where a.doc_id <> b.doc_id group by 1, 2),
l as (
  select p.a, p.b from p join n as x on x.doc_id = p.a join n as y on y.doc_id = p.b
  where 100 * common >= 80 * (x.n + y.n - common)
),
r as (select doc_id as a, doc_id as b from w union select r.a, l.b from r join l on l.a = r.b),
c as (select a, min(b) as c from r group by a)
select w.doc_id, coalesce(n.n, 0) as n_shingles, c.c as component_id, w.doc_id = c.c as kept
from w join c on c.a = w.doc_id left join n on n.doc_id = w.doc_id
""",
    "op9_url_rules": r"""
with u as (
  select page_id, coalesce(url, '') as url,
    translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) as path
  from pages
),
v as (
  select *, case
    when (host = 'www.example.com' or host like '%.www.example.com') and path like '/en/%' then 'www.example.com/en/'
    when (host = 'example.com' or host like '%.example.com') and path like '/en/%' then 'example.com/en/'
    when (host = 'net' or host like '%.net') and path like '/es/%' then 'net/es/'
    when (host = 'net' or host like '%.net') and path like '/fr/%' then 'net/fr/'
    when (host = 'com' or host like '%.com') and path like '/%' then 'com/' end as rule
  from u
)
select page_id, host, path, rule, case
    when rule in ('example.com/en/', 'net/es/', 'net/fr/') then 'block'
    when rule is not null then 'allow'
    when regexp_matches(url, '(?i)://[^/?#]*\bcheap-pills\b') or regexp_matches(url, '(?i)://[^/?#]*\bspam-[a-z]+')
      or regexp_matches(url, '(?i)://[^/?#]*\b(?:online|best)-casino\b')
      or regexp_matches(url, '(?i)://(?:[^/?#]*[.-])?(?:xxx|porn)(?:[.-][^/?#]*)?(?:[/?#]|$)')
      or regexp_matches(url, '(?i)[?&](?:sessionid|phpsessid)=[0-9a-z]{16,}')
      or regexp_matches(url, '(?i)\.(?:exe|apk|dmg|iso)(?:[?#]|$)') then 'block'
    else 'allow' end as verdict
from v
""",
    "op10_warc_round_trip": r"""
with h as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as sha from pages),
b as (
  select *, array_to_string(list_transform(generate_series(1, 40), lambda i: substr(
    '0000000100100011010001010110011110001001101010111100110111101111', 4 * strpos('0123456789abcdef', substr(sha, i, 1)) - 3, 4)),
    '') as bits
  from h
),
d as (
  select page_id, html, array_to_string(list_transform(generate_series(0, 31), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + 16 * cast(substr(bits, 5 * i + 1, 1) as int) + 8 * cast(substr(bits, 5 * i + 2, 1) as int)
    + 4 * cast(substr(bits, 5 * i + 3, 1) as int) + 2 * cast(substr(bits, 5 * i + 4, 1) as int)
    + cast(substr(bits, 5 * i + 5, 1) as int), 1)), '') as payload_digest
  from b
),
m as (select *, max(page_id) over (partition by html) as best from d)
select page_id, cast(strlen(html) as bigint) as payload_bytes, payload_digest,
  case when page_id < best then 'revisit' else 'response' end as record_type, case when page_id < best then best end as refers_to
from m
""",
    "op11_exact_dedup": r"""
with t as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents)
select doc_id, min(doc_id) over w as keep_id, count(*) over w as group_size,
  row_number() over (partition by t order by doc_id nulls last) = 1 as kept, sha256(t) as text_sha256
from t window w as (partition by t)
""",
    "op13_collocations": r"""
with w as (
  select coalesce(lang, 'und') as lang, regexp_extract_all(unnest(regexp_split_to_array(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') as ws
  from documents where text is not null
),
n as (select lang, cast(sum(len(ws)) as bigint) as n from w group by lang),
f as (
  select lang, list_slice(ws, i, i + k - 1) as g, k, count(*) as f
  from w, unnest(generate_series(1, 4)) as s(k), unnest(generate_series(1, len(ws) - k + 1)) as u(i)
  group by all having count(*) >= 30
),
m as (
  select lang, list_slice(g, i, i + j - 1) as g, max(f) as f
  from f, unnest(generate_series(2, k - 1)) as s(j), unnest(generate_series(1, k - j + 1)) as u(i) group by all
),
c as (
  select f.lang, f.g, f.k, f.f as a from f left join m on m.lang = f.lang and m.g = f.g
  where f.k > 1 and (m.f is null or 100 * m.f < 80 * f.f)
),
x as (
  select c.lang, c.g, c.a, l.f as l, r.f as r, i, cast(cast(2000000 as hugeint) * c.a // (l.f + r.f) as bigint) as score
  from c, unnest(generate_series(1, c.k - 1)) as u(i)
  join f as l on l.lang = c.lang and l.g = list_slice(c.g, 1, i)
  join f as r on r.lang = c.lang and r.g = list_slice(c.g, i + 1, c.k)
),
y as (select * from x qualify row_number() over (partition by lang, g order by score, i) = 1),
z as (
  select *, array_to_string(g, ' ') as phrase,
    row_number() over (partition by lang order by score desc, a desc, array_to_string(g, ' ')) as rank
  from y
)
select z.lang, rank, phrase, a, l, r, n, score from z join n on n.lang = z.lang where rank <= 2000
""",
}
