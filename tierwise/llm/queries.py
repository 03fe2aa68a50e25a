"""Queries over the given tables, one for each operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .conversation_repair import conversation_repair
from .decontamination import decontamination
from .html_extraction import html_extraction
from .license_scan import license_scan
from .lm_scoring import lm_scoring
from .ngram_join import ngram_components
from .packing import packing
from .quality_rules import quality_rules
from .source_divergence import source_divergence
from .suffix_dedup import suffix_dedup
from .token_records import token_round_trip
from .url_filters import url_filters
from .warc import round_trip

#: The rules of the URL query.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filters(table(spark, sf_dir, "pages"), rules)


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring(table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction(table(spark, sf_dir, "pages"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair(table(spark, sf_dir, "conversations"))


def op13_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_join": op1_ngram_join,
    "op2_url_filters": op2_url_filters,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_license_scan": op4_license_scan,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_packing": op6_packing,
    "op7_html_extraction": op7_html_extraction,
    "op8_warc": op8_warc,
    "op9_decontamination": op9_decontamination,
    "op10_quality_rules": op10_quality_rules,
    "op11_source_divergence": op11_source_divergence,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_token_records": op13_token_records,
}

_HOST = r"translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = r"regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1)"

ORACLE_SQL: dict[str, str] = {
    "op1_ngram_join": r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, array_to_string(w[i:i + 4], ' ') as s from (select doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) as i from w where len(w) > 0)),
c as (select doc_id, count(*) as n from s group by doc_id),
p as (select x.doc_id as a, y.doc_id as b, count(*) as k from s x join s y on x.s = y.s and x.doc_id < y.doc_id group by 1, 2),
l as (select a, b from p join c u on u.doc_id = a join c v on v.doc_id = b where 100 * k >= 75 * (u.n + v.n - k)),
e as (select a, b from l union select b, a from l),
r as (select doc_id as x, doc_id as y from documents union select r.x, e.b from r join e on r.y = e.a)
select d.doc_id, coalesce(n, 0) as n_shingles, m as component_id
from documents d left join c on d.doc_id = c.doc_id join (select x, min(y) as m from r group by x) g on d.doc_id = g.x""",
    "op2_url_filters": f"""
with rules(rh, rp, said) as (values {", ".join(str(r) for r in URL_RULES)}),
p as (select page_id, url, {_HOST} as host, {_PATH} as path from pages),
fits as (
  select p.page_id, p.url, rh || rp as rule, said,
         row_number() over (partition by p.page_id, p.url order by length(rh || rp) desc, length(rh) desc) as k
  from p join rules on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp))
select p.page_id, host, path, rule, coalesce(said, 'allow') as verdict
from p left join fits on p.page_id = fits.page_id and p.url = fits.url and k = 1""",
    "op5_suffix_dedup": """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h, octet_length(encode(coalesce(text, ''))) as n from documents),
w as (select doc_id, i, substr(h, 2 * i + 1, 100) as s from (select doc_id, h, unnest(generate_series(0, n - 50)) as i from d where n >= 50)),
f as (select s, min(doc_id) as first from w group by s),
hit as (select w.doc_id, i from w join f using (s) where first < w.doc_id),
cut as (select doc_id, i, case when i <= lag(i) over (partition by doc_id order by i) + 50 then 0 else 1 end as fresh from hit),
grp as (select doc_id, i, sum(fresh) over (partition by doc_id order by i) as g from cut),
span as (select doc_id, min(i) as low, max(i) + 50 as high from grp group by doc_id, g),
gap as (select doc_id, coalesce(lag(high) over (partition by doc_id order by low), 0) as a, low as b from span union all select d.doc_id, coalesce(max(high), 0), max(n) from d left join span on d.doc_id = span.doc_id group by d.doc_id),
kept as (select gap.doc_id, string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' order by a) as k from gap join d on gap.doc_id = d.doc_id group by gap.doc_id),
tot as (select doc_id, sum(high - low) as removed, count(*) as spans from span group by doc_id)
select d.doc_id, n as n_bytes, cast(coalesce(removed, 0) as bigint) as n_removed, coalesce(spans, 0) as n_spans, sha256(unhex(k)) as kept_sha256
from d join kept on d.doc_id = kept.doc_id left join tot on d.doc_id = tot.doc_id""",
    "op8_warc": """
with p as (select page_id, octet_length(encode(coalesce(html, ''))) as n, sha256(coalesce(html, '')) as d from pages),
f as (select d, min(page_id) as first from p where n >= 100 group by d)
select page_id, n as payload_bytes, p.d as payload_digest,
       case when n >= 100 and page_id <> first then 'revisit' else 'response' end as record_type,
       case when n >= 100 and page_id <> first then first end as refers_to
from p left join f on p.d = f.d""",
    "op9_decontamination": r"""
with dw as (
  select doc_id, w, generate_subscripts(w, 1) as i from (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents)),
d as (select doc_id, w, len(w) as n from (select distinct doc_id, w from dw)),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
pat as (
  select distinct item_id, least(13, len(w)) as m, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') as s
  from (select item_id, w, unnest(generate_series(1, greatest(len(w) - 12, 1))) as i from b where len(w) > 0)),
win as (select doc_id, i, m, array_to_string(w[i:i + m - 1], ' ') as s from dw join (select distinct m from pat) ms on i + m - 1 <= len(w)),
occ as (select doc_id, i, m, item_id from win join pat using (m, s)),
hit as (select doc_id, count(distinct k) as n_hit from (select doc_id, unnest(generate_series(i, i + m - 1)) as k from occ) group by doc_id),
its as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, cast(item_id as varchar) as item from occ) group by doc_id)
select x.doc_id, coalesce(n, 0) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(items, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= coalesce(n, 0) as contaminated
from documents x left join d on x.doc_id = d.doc_id left join hit on x.doc_id = hit.doc_id left join its on x.doc_id = its.doc_id""",
    "op11_source_divergence": r"""
with d as (select doc_id, row_number() over () as row, coalesce(lang, '') as lang, coalesce(source, '') as source, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from documents),
k as (select lang, term from d group by 1, 2 having count(distinct row) >= 30),
c as (select lang, source, term, count(*) as c from d join k using (lang, term) group by 1, 2, 3),
g as (select distinct coalesce(lang, '') as lang, coalesce(source, '') as source from documents),
n as (select lang, source, coalesce(sum(c), 0) as n from g left join c using (lang, source) group by 1, 2),
v as (select lang, count(*) as v from k group by 1),
p as (
  select n.lang, n.source, k.term, coalesce(c, 0) as c, 1 + (cast(1000000000 as hugeint) * (coalesce(c, 0) + 5)) // (n + 5 * v) as p
  from n join v using (lang) join k using (lang) left join c on c.lang = n.lang and c.source = n.source and c.term = k.term),
q as (
  select lang, term, 1 + (cast(1000000000 as hugeint) * (sum(c) + 5)) // (any_value(all_n) + 5 * any_value(v)) as q
  from c join v using (lang) join (select lang, sum(n) as all_n from n group by 1) using (lang) group by 1, 2),
f as (select x.lang, x.source, y.source as item, sum(abs(x.p - y.p)) as value from p x join p y on x.lang = y.lang and x.term = y.term and x.source <> y.source group by 1, 2, 3),
a as (select x.lang, x.source, 'pair' as part, y.source as item, coalesce(f.value, 0) as value
      from g x join g y on x.lang = y.lang and x.source <> y.source left join f on f.lang = x.lang and f.source = x.source and f.item = y.source),
b as (select lang, source, 'term' as part, term as item, p - q as value from p join q using (lang, term) where c > 0 and p > q),
r as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from (select * from a union all select * from b))
select lang, source, part, item, cast(value as bigint) as value, cast(rank as integer) as rank from r where part = 'pair' or rank <= 50""",
    "op12_conversation_repair": r"""
with recursive
bits as (select i, i as c, 0 as k from range(256) as t(i) union all select i, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from bits where k < 8),
tab as (select list(c order by i) as tab from bits where k = 8),
named as (select *, coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as name from conversations),
crc as (select named.*, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(name, ''), lambda x: cast(ascii(x) as bigint))), lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295) % 20 as k from named, tab),
r as (
  select conv_id, turn, case when k = 4 then 'user' else coalesce(role, ' ') end as role,
         case when k = 1 then '' when k = 2 then translate(coalesce(text, ' '), '.!?', '') else coalesce(text, ' ') end as text
  from crc, range(1, 3) as t(copy) where k <> 0 and (copy = 1 or k = 3)),
n as (
  select *, row_number() over (partition by conv_id, role, text order by i) as seen, regexp_extract(text, '(?s)([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) as tail, case when left(role, 1) in ('s', 'u', 'a') then left(role, 1) else 'o' end as c
  from (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as i from r)),
f as (select *, case when tail = '' then 'blank' when seen > 1 then 'duplicate' when tail not in ('.', '!', '?') then 'truncated' else 'none' end as fault, lag(c) over (partition by conv_id order by i) as b from n),
s as (select conv_id, i, c, role, text, case fault when 'truncated' then 1 when 'none' then 0 end as m from f),
counts as (
  select conv_id, count(*) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate,
         count(*) filter (fault = 'truncated') as truncated, count(*) filter (b || c not in ('su', 'ua', 'au')) as illegal from f group by conv_id),
v as (
  select conv_id, n + 1 as i, [0, 4, 2, 0] as v from counts
  union all
  select conv_id, i, [least(e, 2 + u, 4 + a), least(s, 2 + u, 4 + a), least(u, 2 + a), least(a, 2 + u)] from (
    select s.conv_id, s.i,
           least(3 + v[1], coalesce(m + 2 + v[3], 99999999), coalesce(m + case c when 's' then v[2] when 'u' then v[3] end, 99999999)) as e,
           least(3 + v[2], coalesce(m + 2 + v[3], 99999999), coalesce(m + case c when 'u' then v[3] end, 99999999)) as s,
           least(3 + v[3], coalesce(m + 2 + v[4], 99999999), coalesce(m + case c when 'a' then v[4] end, 99999999)) as u,
           least(3 + v[4], coalesce(m + 2 + v[3], 99999999), coalesce(m + case c when 'u' then v[3] end, 99999999)) as a
    from v join s on v.conv_id is not distinct from s.conv_id and s.i = v.i - 1)),
step as (
  select here.conv_id, here.i, here.v as here, next.v as next, c, role, text, m
  from v as here left join v as next on here.conv_id is not distinct from next.conv_id and next.i = here.i + 1 left join s on here.conv_id is not distinct from s.conv_id and here.i = s.i),
w as (
  select conv_id, cast(1 as bigint) as i, 1 as q, '' as audit, cast([] as varchar[]) as lines from counts
  union all
  select conv_id, case when letter = 'I' then i else i + 1 end, case letter when 'D' then q when 'K' then kept else due end, audit || letter,
         case letter when 'D' then lines when 'K' then list_append(lines, role || ':' || text) else list_append(lines, case due when 3 then 'user:' else 'assistant:' end || case when letter = 'R' then text else '' end) end
  from (
    select *, case when 3 + next[q] = here[q] then 'D' when 2 + here[due] = here[q] then 'I' when m + next[kept] = here[q] then 'K' else 'R' end as letter
    from (
      select w.*, case when q = 3 then 4 else 3 end as due, case when c = 's' and q = 1 then 2 when c = 'u' and q <> 3 then 3 when c = 'a' and q = 3 then 4 end as kept, here, next, role, text, m
      from w join step on w.conv_id is not distinct from step.conv_id and w.i = step.i where step.next is not null or q in (2, 3)))),
done as (select w.conv_id, audit, lines from w join counts on w.conv_id is not distinct from counts.conv_id and w.i = n + 1 and w.q in (1, 4))
select a.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
       coalesce(cast(v.v[1] as bigint), 0) as cost, coalesce(audit, '') as audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) as repaired_sha256
from (select distinct conv_id from conversations) as a left join counts on a.conv_id is not distinct from counts.conv_id left join v on a.conv_id is not distinct from v.conv_id and v.i = 1
left join done on a.conv_id is not distinct from done.conv_id""",
}
