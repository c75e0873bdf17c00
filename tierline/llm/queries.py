"""The registered queries of the operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tierline.llm.common import table
from tierline.llm.decontamination import contaminated
from tierline.llm.html_text import extract
from tierline.llm.language import languages
from tierline.llm.mixing import mix
from tierline.llm.ngram_join import Rule, ngram_components
from tierline.llm.pii import personal_data
from tierline.llm.quality import quality
from tierline.llm.repair import repaired
from tierline.llm.resampling import Features, resample
from tierline.llm.sharding import shard
from tierline.llm.simhash import simhash_components
from tierline.llm.toxicity import toxicity
from tierline.llm.warc import archived

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@_query
def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))


@_query
def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents"), Rule(words=4, num=85, den=100))


@_query
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


@_query
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(table(spark, sf_dir, "pages"))


@_query
def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))


@_query
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_query
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(table(spark, sf_dir, "documents"))


@_query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_query
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@_query
def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


@_query
def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"), words=4, bits=4)


@_query
def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(table(spark, sf_dir, "conversations"))


@_query
def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), Features(1, 1, 10_000), percent=10, least_words=20, seed=2024
    )


SQL["op8_warc"] = """
select page_id, strlen(h) as payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + ((('0x' || substr(x, (i // 4) * 5 + 1, 5))::int >> (15 - 5 * (i % 4))::int) & 31)::int, 1) for i in range(0, 32)], '') as payload_digest,
       case when page_id < latest then 'revisit' else 'response' end as record_type,
       case when page_id < latest then latest end as refers_to
from (select page_id, h, sha1(h) as x, max(page_id) over (partition by h) as latest
      from (select page_id, coalesce(html, '') as h from pages) p) q
"""

#: CRC-32 of distinct strings, byte by byte, over the table of the polynomial 0xEDB88320.
_CRC_TABLE = """
select list_transform(range(256), lambda n: list_reduce(list_prepend(n::bigint, range(8)),
    lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as crcs
"""
_CRC = """
xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(strlen({0})),
    lambda i: ('0x' || substr(hex(encode({0})), 2 * i + 1, 2))::bigint)), lambda c, b: xor(c >> 8, crcs[1 + (xor(c, b) & 255)])), 4294967295)
"""

SQL["op13_resampling"] = f"""
with t as ({_CRC_TABLE}),
docs as (
    select row_number() over () as row_id, doc_id, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') as words from documents),
target as (
    select unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as w from benchmark),
source as (select row_id, unnest(words) as w from docs),
hashed as (
    select w, {_CRC.format("w")} % 10000 as bucket
    from (select w from source union select w from target) d, t),
s as (select bucket, count(*) as n from source join hashed using (w) group by bucket),
g as (select bucket, count(*) as n from target join hashed using (w) group by bucket),
gains as (
    select w, floor(1000 * ln(((coalesce(g.n, 0) + 1)::double * ((select count(*) from source) + 10000)::double)
        / ((coalesce(s.n, 0) + 1)::double * ((select count(*) from target) + 10000)::double)))::bigint as gain
    from hashed h left join s on h.bucket = s.bucket left join g on h.bucket = g.bucket),
weights as (select row_id, sum(gain)::bigint as weight from source join gains using (w) group by row_id),
scored as (
    select d.doc_id, len(words) as n_features, coalesce(weight, 0) as weight,
        coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint + 0.5::double)
            / 4294967296::double)))::bigint as score
    from docs d left join weights using (row_id)),
able as (
    select *, n_features >= 20 as is_able,
        row_number() over (partition by n_features >= 20 order by score desc, doc_id nulls last, n_features) as place,
        count(*) filter (n_features >= 20) over () * 10 // 100 as drawn
    from scored)
select doc_id, n_features, weight, score, case when is_able and place <= drawn then place end as rank from able
"""

#: Steps of the states 0 start, 1 system, 2 user, 3 assistant: with inserts before a row or none.
SQL["op12_repair"] = f"""
with recursive t as ({_CRC_TABLE}),
source as (
    select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
        coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as k from conversations),
kinds as (select k, {_CRC.format("k")} % 20 as kind from (select distinct k from source) d, t),
damaged as (
    select conv_id, turn, case when kind = 4 then 'user' else role end as role,
        case when kind = 1 then '' when kind = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
    from source join kinds using (k), range(case kind when 0 then 0 when 3 then 2 else 1 end) copies),
placed as (
    select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as i,
        regexp_replace(text, '[\x20\x09-\x0D]+$', '') as bare
    from damaged),
rows_ as (
    select *, substr(role, 1, 1) as c, lag(substr(role, 1, 1)) over (partition by conv_id order by i) as before,
        case when bare = '' then 'blank' when row_number() over (partition by conv_id, role, text order by i) > 1 then 'duplicate'
            when right(bare, 1) not in ('.', '!', '?') then 'truncated' else '' end as fault
    from placed),
inserts(p, q, given, price) as (values (0, 0, '', 0), (1, 1, '', 0), (2, 2, '', 0), (3, 3, '', 0),
    (0, 2, 'u', 5), (1, 2, 'u', 5), (2, 3, 'a', 5), (3, 2, 'u', 5), (0, 3, 'ua', 10), (1, 3, 'ua', 10)),
step(p, symbol, q) as (values (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
edits as (
    select conv_id, i, text, role, 'D' as letter, '' as symbol, 2 as price from rows_
    union all select conv_id, i, text, role, 'K', c, if(fault = 'truncated', 5, 0) from rows_
        where fault not in ('blank', 'duplicate') and c in ('s', 'u', 'a')
    union all select conv_id, i, text, case s when 'u' then 'user' else 'assistant' end, 'R', s, if(fault = 'truncated', 6, 1)
        from rows_, (values ('u'), ('a')) x(s) where fault not in ('blank', 'duplicate')),
roles(symbol, line) as (values ('', []::varchar[]), ('u', ['user:']), ('a', ['assistant:']), ('ua', ['user:', 'assistant:'])),
walk as (
    select distinct conv_id, 0::bigint as i, 0 as q, 0 as cost, '' as audit, []::varchar[] as lines from source
    union all
    select conv_id, i, q, best.cost, best.audit, best.lines from (
        select w.conv_id, e.i, coalesce(s.q, n.q) as q, min(struct_pack(cost := w.cost + n.price + e.price,
            audit := w.audit || repeat('I', length(n.given)) || e.letter,
            lines := w.lines || r.line || if(e.letter = 'D', []::varchar[], [e.role || ':' || e.text]))) as best
        from walk w join edits e on e.conv_id is not distinct from w.conv_id and e.i = w.i + 1
            join inserts n on n.p = w.q join roles r on r.symbol = n.given
            left join step s on s.p = n.q and s.symbol = e.symbol
        where e.letter = 'D' or s.q is not null
        group by 1, 2, 3)),
sums as (
    select conv_id, count(*) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps,
        count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate,
        count(*) filter (fault = 'truncated') as truncated,
        count(*) filter (i > 1 and before || c not in ('su', 'ua', 'au')) as illegal
    from rows_ group by conv_id),
ends(q, given, price) as (values (0, '', 0), (3, '', 0), (2, 'a', 5), (1, 'ua', 10)),
ended as (
    select w.conv_id, min(struct_pack(cost := w.cost + e.price, audit := w.audit || repeat('I', length(e.given)),
        lines := w.lines || r.line)) as best
    from walk w join ends e using (q) join roles r on r.symbol = e.given
        left join sums s on s.conv_id is not distinct from w.conv_id
    where w.i = coalesce(s.n, 0) group by 1)
select e.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate,
    coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, best.cost as cost, best.audit as audit,
    sha256(array_to_string(best.lines, chr(10))) as repaired_sha256
from ended e left join sums s on s.conv_id is not distinct from e.conv_id
"""
