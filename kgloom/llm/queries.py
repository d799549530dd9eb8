"""The queries opN_<name> over the driver's tables, with production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.llm import bpe, fingerprints, importance, infilling, line_dedup, minhash, packing, quality_rules, simhash, suffix_dedup, token_counts, toxicity, warc

Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's source is its host."""
    return line_dedup.drop_boilerplate(_read(spark, sf_dir, "documents").select("doc_id", "source", "text"), counts=("n_lines", "n_dropped")).drop("source")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_round_trip(_read(spark, sf_dir, "pages")).drop("url")


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.neighbour_fingerprints(_read(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.where(~toxicity.held_out()))
    return toxicity.toxicity_scores(docs, model).select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(_read(spark, sf_dir, "documents"))


def op9_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removed_spans(_read(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(_read(spark, sf_dir, "documents")).drop("rejected_by")  # which rule of several is the first follows the order


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.importance_ranks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.minhash_groups(_read(spark, sf_dir, "documents"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infilling.digests(_read(spark, sf_dir, "documents"))


OPERATORS = (op1_warc, op2_fingerprints, op3_toxicity, op4_byte_bpe, op5_line_dedup, op6_token_counts, op7_packing, op8_simhash, op9_suffix_array, op10_quality_rules, op11_importance, op12_minhash, op13_fill_in_middle)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in OPERATORS}


# Base 32 of the 160 bits of a SHA-1: 20 bits (5 hexadecimal digits) are 4 letters.
OP1_SQL = """
with p as (select page_id, coalesce(html, '') as payload from pages),
d as (select page_id, payload, strlen(payload) as payload_bytes, sha1(payload) as h, min(page_id) over (partition by payload) as least from p),
w as (select *, list_transform(range(8), lambda i: cast('0x' || substr(h, cast(5 * i + 1 as int), 5) as bigint)) as v from d)
select page_id, payload_bytes,
  list_aggregate(list_transform(v, lambda x: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast(x // 32768 + 1 as int), 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast(x // 1024 % 32 + 1 as int), 1)
    || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast(x // 32 % 32 + 1 as int), 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast(x % 32 + 1 as int), 1)), 'string_agg', '') as payload_digest,
  case when page_id = least then 'response' else 'revisit' end as record_type,
  case when page_id = least then null else least end as refers_to
from w
"""

OP5_SQL = r"""
with p as (select doc_id, source, text, string_split(text, chr(10)) as lines, count(*) over (partition by source) as pages from documents),
l as (select source, any_value(pages) as pages, line, count(*) as n from (select source, pages, unnest(list_distinct(lines)) as line from p) where regexp_matches(line, '[^\s]') group by source, line),
b as (select source, list(line) as often from l where n >= 3 and n > 0.03 * pages group by source)
select doc_id, coalesce(len(lines), 0) as n_lines, coalesce(len(list_filter(lines, lambda x: list_contains(often, x))), 0) as n_dropped,
  case when often is null then text else coalesce(array_to_string(list_filter(lines, lambda x: not list_contains(often, x)), chr(10)), '') end as text
from p left join b on p.source is not distinct from b.source
"""

OP10_SQL = r"""
with w as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
g as (select doc_id, text, words, len(words) as n_words,
    list_transform(range(greatest(len(words) - 2, 0)), lambda i: words[i + 1] || ' ' || words[i + 2] || ' ' || words[i + 3]) as wins,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from w),
u as (select doc_id, win, unnest(places) as place from (select doc_id, win, list(place) as places from
    (select doc_id, unnest(wins) as win, unnest(range(len(wins))) as place from g) group by all having count(*) > 1)),
r as (select doc_id, count(distinct place + k) as n_repeat_words from u, range(3) t(k) group by doc_id),
m as (select g.doc_id, g.n_words, len(array_to_string(words, '')) as word_chars, len(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols,
    len(lines) - len(list_distinct(lines)) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words, len(lines) as n_lines, words, lines
    from g left join r using (doc_id)),
v as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not (base_failed or 10 * n_symbols > n_words or word_chars < 2 * n_words or word_chars > 20 * n_words or 10 * n_dup_lines > 6 * n_lines
    or 10 * len(list_filter(words, lambda x: regexp_matches(x, '\p{L}'))) < 7 * n_words
    or 10 * len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]'))) > 9 * n_lines
    or 10 * len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) > 3 * n_lines) as kept
from v
"""

LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
# CRC-32 by its table of 256 remainders; the buckets of distinct words only.
OP11_SQL = (
    r"""
with tab as (select list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t),
d as (select doc_id, regexp_extract_all(LOW, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from documents),
q as (select regexp_extract_all(LOW, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from benchmark),
h as (select w, hex(w) as x from (select unnest(words) as w from d union select unnest(words) from q)),
b as (select w, xor(list_reduce(list_prepend(4294967295, list_transform(range(len(x) // 2), lambda i: cast('0x' || substr(x, cast(2 * i + 1 as int), 2) as bigint))),
    lambda c, y: xor(c >> 8, t[cast((xor(c, y) & 255) + 1 as int)])), 4294967295) % 10000 as bucket from h, tab),
f as (select doc_id, bucket from (select doc_id, unnest(words) as w from d) join b using (w)),
s as (select bucket, count(*) as s from f group by bucket),
t as (select bucket, count(*) as t from (select unnest(words) as w from q) join b using (w) group by bucket),
g as (select bucket, floor(1000 * ln((coalesce(t, 0) + 1)::double * (select sum(s) + 10000 from s)::double / ((coalesce(s, 0) + 1)::double * (select coalesce(sum(t), 0) + 10000 from t)::double))) as gain
  from (select unnest(range(10000)) as bucket) left join s using (bucket) left join t using (bucket)),
m as (select doc_id, count(*) as n, cast(floor(sum(gain) / count(*)) as bigint) as weight from f join g using (bucket) group by doc_id),
v as (select doc_id, coalesce(n, 0) as n_features, coalesce(weight, 0) as weight,
  coalesce(weight, 0) + cast(floor(-1000 * ln(-ln((cast('0x' || substr(sha256('2024:' || doc_id), 1, 8) as bigint) + 0.5::double) / 4294967296::double))) as bigint) as score from d left join m using (doc_id)),
r as (select doc_id, row_number() over (order by score desc, doc_id) as rank from v where n_features >= 20)
select v.doc_id, n_features, weight, score, case when rank <= 10 * (select count(*) from r) // 100 then rank end as rank from v left join r using (doc_id)
"""
).replace("LOW", LOW)

OP12_SQL = (
    r"""
with recursive w as (select doc_id, regexp_extract_all(LOW, '[^\x20\x09-\x0D]+') as words from documents),
s as (select doc_id, case when len(words) < 2 then words else list_distinct(list_transform(range(len(words) - 1), lambda i: words[i + 1] || ' ' || words[i + 2])) end as own from w),
e as (select doc_id, len(own) as n, unnest(own) as shingle from s),
p as (select a.doc_id as a, b.doc_id as b from e a join e b on a.shingle = b.shingle and a.doc_id < b.doc_id group by a.doc_id, a.n, b.doc_id, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))),
l as (select a, b from p union all select b, a from p),
r(id, c) as (select doc_id, doc_id from s union select r.id, l.b from r join l on r.c = l.a)
select id as doc_id, len(own) as n_shingles, min(c) as component_id, id = min(c) as kept from r join s on s.doc_id = r.id group by id, own
"""
).replace("LOW", LOW)

OP13_SQL = r"""
with u as (select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') as u, sha256('7:' || doc_id) as x from documents),
h as (select doc_id, t, u, len(u) as n, list_transform([1, 9, 17, 25], lambda i: cast('0x' || substr(x, i, 8) as bigint)) as h from u),
c as (select *, least(h[1] % (n + 1), h[2] % (n + 1)) as a, greatest(h[1] % (n + 1), h[2] % (n + 1)) as b from h),
p as (select *, array_to_string(list_slice(u, 1, a), '') as p, array_to_string(list_slice(u, a + 1, b), '') as m, array_to_string(list_slice(u, b + 1, n), '') as s,
  case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h[3] % 100 >= 100 then 'plain' when h[4] % 100 < 50 then 'spm' else 'psm' end as form from c)
select doc_id, n, form, case when form <> 'plain' then length(p) end as prefix_chars, case when form <> 'plain' then length(m) end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256, sha256(t) as restored_sha256
from p
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": OP1_SQL, "op5_line_dedup": OP5_SQL, "op10_quality_rules": OP10_SQL, "op11_importance": OP11_SQL, "op12_minhash": OP12_SQL, "op13_fill_in_middle": OP13_SQL}
