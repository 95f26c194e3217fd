"""The registered query of each training-data operator, with production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from phrasemill.llm.op1_exact_dedup import exact_dedup
from phrasemill.llm.op2_toxicity import toxicity
from phrasemill.llm.op3_pii import pii_spans
from phrasemill.llm.op4_quality import quality
from phrasemill.llm.op5_token_counts import token_counts
from phrasemill.llm.op6_embedding_dedup import embedding_dedup
from phrasemill.llm.op7_best_fit_packing import best_fit_packing
from phrasemill.llm.op8_sentencepiece import sentencepiece_digests
from phrasemill.llm.op9_warc_fixity import audit, decayed, digests, manifest, misplaced, records
from phrasemill.llm.op10_ngram_join import ngram_join
from phrasemill.llm.op11_source_mix import source_mix
from phrasemill.llm.op12_conversation_repair import conversation_repair
from phrasemill.llm.op13_embedding_whitening import whitening
from phrasemill.llm.shared import ship, table, tokenizer_file


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_spans(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(table(spark, sf_dir, "embeddings"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_digests(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op9_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = records(table(spark, sf_dir, "pages"))
    first = manifest(written)
    return audit(first, digests(decayed(written), misplaced(first)))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"))


def op11_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix(table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair(table(spark, sf_dir, "conversations"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening(table(spark, sf_dir, "embeddings"))


OP1_SQL = r"""
with n as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as norm from documents)
select doc_id, min(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = min(doc_id) over w as kept, sha256(norm) as text_sha256
from n window w as (partition by norm)
"""


OP9_SQL = r"""
with p as (select page_id, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10)
    || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10)
    || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) as payload from pages),
r as (select page_id // 4096 as file_no, page_id % 4096 as record_no, page_id, payload, strlen(payload) as length, page_id % 101 * 7919 % 101 as fault from p),
o as (select *, cast(sum(length) over (partition by file_no order by record_no) - length as bigint) as start from r)
select file_no, record_no, page_id, start, length, case when fault = 7 then null when fault = 11 then start + 1 else start end as right_start, sha256(payload) as left_sha,
  case fault when 7 then null when 11 then sha256(payload) when 13 then sha256(left(payload, length(payload) - 3)) else sha256(left(payload, 20) || '#' || substr(payload, 22)) end as right_sha,
  case fault when 7 then 'missing_right' when 11 then 'moved' when 13 then 'resized' else 'damaged' end as found
from o where fault in (3, 5, 7, 11, 13)
"""


def _permuted(x: str, n: str, key: str) -> str:
    """The swap-or-not shuffle of op11 as a fold."""
    number = lambda k: f"('0x' || substr(md5({k}), 1, 13))::bigint"
    mirror = f"((({number(f"{key} || '|mirror|' || i")} - a) % {n} + {n}) % {n})"
    return f"list_reduce(range(1, 25), lambda a, i: case when {number(f"{key} || '|swap|' || i || '|' || greatest(a, {mirror})")} % 2 = 0 then a else {mirror} end, {x})"


#: Quotas by prefix sums in the order of size over weight, where the operator goes round by round.
OP11_SQL = rf"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')) as size from documents),
s0 as (select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) as no from d group by 1),
s1 as (select *, [5, 2, 1][(no - 1) % 3 + 1] as weight, 3 * source_size as most from s0),
s2 as (select *, sum(most) over o as most_to, sum(weight) over o as weight_to, sum(source_size) over () as words, sum(weight) over () as shares from s1 window o as (order by most * 10 // weight, no)),
s3 as (select *, most * (shares - weight_to + weight) < weight * (words - most_to + most) as above from s2),
s4 as (select *, coalesce(sum(most) filter (above) over (), 0) as c, coalesce(sum(weight) filter (above) over (), 0) as w from s3),
s5 as (select no, source, source_size, case when above then most::double else weight * ((words - c)::double / greatest(1, shares - w)::double) end as target, greatest(1, least(512, source_size // 128)) as block from s4),
s6 as (select *, (source_size + block - 1) // block as blocks from s5),
s7 as (select *, case when source_size > 0 then least(3 * blocks, floor(blocks * target / source_size + 0.5))::bigint else 0 end as slots from s6),
s as (select *, sum(slots) over (order by no)::bigint - slots as lo, sum(slots) over ()::bigint as n_all from s7),
k as (select no, blocks, {_permuted("lo + k", "n_all", "'0|place'")} // 4096 as shard from (select *, unnest(range(slots)) as k from s) x),
h as (select no, blocks, shard, count(*) as n from k group by all),
f as (select *, sum(n) over (partition by no order by shard)::bigint - n as first from h),
j as (select no, blocks, unnest(range(first, first + n)) as slot from f),
b as (select no, index, count(*) as times from (select no, {_permuted("slot % blocks", "blocks", "'0|' || no || '|' || slot // blocks")} as index from j) x group by all),
r as (select d.*, s.no, s.source_size, s.target, s.block, (sum(size) over (partition by s.no order by doc_id) - size)::bigint as start from d join s on s.source is not distinct from d.source),
p as (select *, unnest(range(start // block, (start + size - 1) // block + 1)) as index from r where size > 0),
t as (select doc_id, sum((least(start + size, (index + 1) * block) - greatest(start, index * block)) * times)::bigint as taken from p join b using (no, index) group by 1)
select doc_id, size::bigint as size, source_size, target, coalesce(taken, 0) as taken, source from r left join t using (doc_id)
"""


def _moves() -> str:
    """Rows of (role before, inserts, edit, role needed or null, role after): what may happen up to and with one row."""
    due, may, out = {"-": "u", "s": "u", "u": "a", "a": "u"}, {"-": "su", "s": "u", "u": "a", "a": "u"}, []
    for q in due:
        at = q
        for m in range(3):
            out += [(q, m, at, "D", None, at), (q, m, at, "R", None, due[at]), *((q, m, at, "K", x, x) for x in may[at])]
            at = due[at]
    return ", ".join("(" + ", ".join("null" if x is None else str(x) if isinstance(x, int) else f"'{x}'" for x in row) + ")" for row in out)


#: The damage (crc32 as a fold over bits), and a repair row by row: of every conversation and role so far the cheapest, least audit goes on.
OP12_SQL = rf"""
with recursive c as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as k from conversations),
e as (select *, xor(list_reduce(list_transform(string_split(k, ''), lambda x: ascii(x)::bigint), lambda h, b: list_reduce(range(8), lambda g, i: xor(g >> 1, 3988292384 * (g & 1)), xor(h, b)), 4294967295::bigint), 4294967295) % 20 as fault from c),
d as (select conv_id, turn, case fault when 4 then 'user' else role end as role, case fault when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(range(case fault when 0 then 0 when 3 then 2 else 1 end)) as copy from e),
o as (select *, row_number() over (partition by conv_id order by turn nulls first, role, sha256(text), copy) as i, row_number() over (partition by conv_id, role, text order by turn nulls first, copy) as seen from d),
r as (select conv_id, turn, role, text, i, case when left(role, 1) in ('s', 'u', 'a') then left(role, 1) else 'x' end as x,
  case when not regexp_matches(text, '[^ 	-
]') then 'b' when seen > 1 then 'd' when not regexp_matches(text, '[.!?][ 	-
]*$') then 't' else '-' end as f from o),
moves(q, m, mid, edit, need, nxt) as (values {_moves()}),
step(conv_id, i, q, cost, audit, parts) as (
  select distinct conv_id, 0::bigint, '-', 0::bigint, '', []::varchar[] from conversations
  union all
  select conv_id, i, q, cost, audit, parts from (
    select s.conv_id, r.i, v.nxt as q, s.cost + 3 * v.m + case v.edit when 'D' then 4 when 'R' then 3 else 0 end + case when v.edit <> 'D' and r.f = 't' then 3 else 0 end as cost, s.audit || repeat('I', v.m) || v.edit as audit,
      list_concat(list_concat(s.parts, case v.m when 0 then [] when 1 then [case when s.q = 'u' then 'assistant:' else 'user:' end] else case when s.q = 'u' then ['assistant:', 'user:'] else ['user:', 'assistant:'] end end),
        case v.edit when 'D' then [] when 'K' then [r.role || ':' || r.text] else [case v.nxt when 'a' then 'assistant:' else 'user:' end || r.text] end) as parts
    from step s join r on r.conv_id is not distinct from s.conv_id and r.i = s.i + 1 join moves v on v.q = s.q
    where (v.need is null or v.need = r.x) and (v.edit = 'D' or r.f not in ('b', 'd'))) y
  qualify row_number() over (partition by conv_id, i, q order by cost, audit) = 1),
n as (select conv_id, count(*) as n, count(*) filter (f = 'b') as blank, count(*) filter (f = 'd') as duplicate, count(*) filter (f = 't') as truncated, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps from r group by 1),
g as (select conv_id, count(*) as illegal from (select conv_id, lag(x) over (partition by conv_id order by i) || x as pair from r) y where pair not in ('su', 'ua', 'au') group by 1),
z as (select s.conv_id, cost + 3 * m as cost, audit || repeat('I', m) as audit, list_concat(parts, case m when 0 then [] when 1 then [case when q = 'u' then 'assistant:' else 'user:' end] else ['user:', 'assistant:'] end) as parts
  from step s left join n on n.conv_id is not distinct from s.conv_id join (values ('-', 0), ('a', 0), ('u', 1), ('s', 2)) t(q, m) using (q) where s.i = coalesce(n.n, 0)
  qualify row_number() over (partition by s.conv_id order by s.cost + 3 * m, s.audit || repeat('I', m)) = 1)
select z.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, z.cost, z.audit, sha256(array_to_string(z.parts, chr(10))) as repaired_sha256
from z left join n on n.conv_id is not distinct from z.conv_id left join g on g.conv_id is not distinct from z.conv_id
"""


def _shipping(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_exact_dedup, op2_toxicity, op3_pii, op4_quality, op5_token_counts, op6_embedding_dedup, op7_best_fit_packing, op8_sentencepiece, op9_warc_fixity, op10_ngram_join,
        op11_source_mix, op12_conversation_repair, op13_embedding_whitening,
    )
    return {q.__name__: _shipping(q) for q in own}


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": OP1_SQL, "op9_warc_fixity": OP9_SQL, "op11_source_mix": OP11_SQL, "op12_conversation_repair": OP12_SQL}
