"""The queries of the training-data operators, with their production parameters, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, collocations, fim, jaccard, merkle, packing, pivots, quality, secrets, substring, suffix, toolcalls, warc


def op1_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), cosine=0.95)


def op2_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.edited_and_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.7)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), window=50)
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op6_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix.dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), size=200)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op7_toolcalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = toolcalls.turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    out = toolcalls.link(turns, toolcalls.REPLY)
    return out.select("conv_id", "turn", "kind", "call_id", "linked", "n_results", "level", "valid", F.size("problems").alias("n_problems"), F.length("canonical").alias("n_chars"), F.sha2("canonical", 256).alias("canonical_sha256"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), capacity=2048, end_id=0)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"), least=100, keep_archives=False)


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), similarity=0.8, ngram=5)


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fim.transform(spark.read.parquet(f"{sf_dir}/documents.parquet"), seed=42)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), secrets.RULES), secrets.RULES)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(spark.read.parquet(f"{sf_dir}/documents.parquet"), least=10, cover=50, top=2000)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pivots": op1_pivots,
    "op2_merkle": op2_merkle,
    "op3_quality": op3_quality,
    "op4_bpe": op4_bpe,
    "op5_substring": op5_substring,
    "op6_suffix": op6_suffix,
    "op7_toolcalls": op7_toolcalls,
    "op8_packing": op8_packing,
    "op9_warc": op9_warc,
    "op10_jaccard": op10_jaccard,
    "op11_fim": op11_fim,
    "op12_secrets": op12_secrets,
    "op13_collocations": op13_collocations,
}

ORACLE_SQL: dict[str, str] = {
    "op7_toolcalls": """
        with c as (select conv_id, turn, case role when 'user' then 'call' when 'assistant' then 'result' else role end as kind,
                          case role when 'user' then conv_id || '-' || turn when 'assistant' then conv_id || '-' || (turn - 1) end as call_id, text
                   from conversations),
        a as (select conv_id, call_id, count(*) as k, min(turn) as at_turn, arg_min(text, turn) as content from c where kind = 'result' group by 1, 2),
        u as (select distinct conv_id, turn from conversations where role = 'user'),
        i as (select conv_id, turn, turn - 2 * row_number() over (partition by conv_id, turn % 2 order by turn) as island from u),
        l as (select conv_id, turn, cast(row_number() over (partition by conv_id, island order by turn) - 1 as int) as level from i),
        j as (select c.conv_id as conv_id, c.turn as turn, kind, c.call_id as call_id, k,
                     case when kind = 'call' then '{"arguments":{"text":' || to_json(text) || ',"turn":' || turn || '},"id":"' || c.call_id || '","name":"reply","result":'
                          || case when k is null then 'null' else '{"content":' || to_json(content) || ',"turn":' || at_turn || '}' end || '}' end as canonical,
                     exists (select 1 from c x where x.kind = 'call' and x.conv_id = c.conv_id and x.call_id = c.call_id) as called, length(text) as n
              from c left join a on kind = 'call' and a.conv_id = c.conv_id and a.call_id = c.call_id)
        select j.conv_id as conv_id, j.turn as turn, kind, call_id, case kind when 'call' then k is not null when 'result' then called else false end as linked,
               case when kind = 'call' then coalesce(k, 0) end as n_results, case when kind = 'call' then level else 0 end as level, case when kind = 'call' then n > 0 end as valid,
               case when kind = 'call' then cast(n = 0 as int) end as n_problems, length(canonical) as n_chars, sha256(canonical) as canonical_sha256
        from j left join l on j.conv_id = l.conv_id and j.turn = l.turn
    """,
    "op9_warc": """
        with p as (select page_id, coalesce(html, '') as h from pages),
        d as (select page_id, cast(octet_length(encode(h)) as bigint) as payload_bytes, sha256(h) as payload_digest from p),
        f as (select payload_digest, min(page_id) as first_id from d where payload_bytes >= 100 group by 1)
        select page_id, payload_bytes, d.payload_digest as payload_digest,
               case when first_id < page_id then 'revisit' else 'response' end as record_type,
               case when first_id < page_id then first_id end as refers_to
        from d left join f on d.payload_digest = f.payload_digest and payload_bytes >= 100
    """,
    "op11_fim": r"""
        with t as (select doc_id, coalesce(text, '') as text, sha256('42:' || coalesce(cast(doc_id as varchar), '')) as h from documents),
        u as (select doc_id, text, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as units,
                     cast('0x' || h[1:8] as bigint) as h1, cast('0x' || h[9:16] as bigint) as h2, cast('0x' || h[17:24] as bigint) as h3, cast('0x' || h[25:32] as bigint) as h4 from t),
        c as (select *, cast(len(units) as bigint) as n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) as a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) as b,
                     case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 50 then 'plain' when h4 % 100 < 80 then 'spm' else 'psm' end as form from u),
        p as (select doc_id, n, form, text, array_to_string(units[1:a], '') as prefix, array_to_string(units[a + 1:b], '') as middle, array_to_string(units[b + 1:n], '') as suffix from c)
        select doc_id, n, form, case when form <> 'plain' then length(prefix) end as prefix_chars, case when form <> 'plain' then length(middle) end as middle_chars,
               sha256(case form when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle when 'spm' then '<S>' || suffix || '<P>' || prefix || '<M>' || middle else text end) as output_sha256,
               sha256(text) as restored_sha256 from p
    """,
    # a match begins behind all gaps and matches before it; the gaps are what regexp_split_to_array leaves
    "op12_secrets": r"""
        with t as (select doc_id, coalesce(text, '') as text from documents),
        k as (select unnest(['assign', 'access', 'hex']) as kind, unnest([0, 1, 2]) as listed),
        m as (select doc_id, text, kind, listed, case listed
                         when 0 then regexp_extract_all(text, '(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+')
                         when 1 then regexp_extract_all(text, 'AKIA[A-Z0-9]+') else regexp_extract_all(text, '[0-9a-f]{16,}') end as found, case listed
                         when 0 then regexp_split_to_array(text, '(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+')
                         when 1 then regexp_split_to_array(text, 'AKIA[A-Z0-9]+') else regexp_split_to_array(text, '[0-9a-f]{16,}') end as gaps
              from t, k),
        e as (select doc_id, kind, listed, found, gaps, unnest(range(1, len(found) + 1)) as i from m),
        s as (select doc_id, kind, listed, cast(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0) as bigint) as start, found[i] as hit from e),
        g as (select doc_id, kind, listed, start, start + length(hit) as stop,
                     case listed when 0 then length(regexp_extract(hit, '^[A-Za-z_]+["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)$', 1)) >= 12 when 1 then length(hit) >= 18 else true end as good from s),
        a as (select doc_id, count(*) filter (listed = 0) as n_assign, count(*) filter (listed = 1) as n_access, count(*) filter (listed = 2) as n_hex,
                     string_agg(kind || ':' || start || ':' || stop, ',' order by start, listed) as spans from g where good group by 1)
        select t.doc_id as doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
               sha256(coalesce(spans, '')) as base_sha256, coalesce(spans, '') as spans
        from t left join a on t.doc_id = a.doc_id
    """,
    "op13_collocations": r"""
        with p as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
        w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as ws from p),
        o as (select lang, unnest(ws) as w1, unnest(ws[2:]) as w2, unnest(ws[3:]) as w3 from w),
        f1 as (select lang, w1, count(*) as f from o group by all),
        f2 as (select lang, w1, w2, count(*) as f from o where w2 is not null group by all),
        f3 as (select lang, w1, w2, w3, count(*) as f from o where w3 is not null group by all having count(*) >= 10),
        n as (select lang, sum(f) as n from f1 group by 1),
        s as (select f2.lang as lang, f2.w1 as w1, f2.w2 as w2, null as w3, f2.f as a, 1 as k, x.f as l, y.f as r from f2, f1 x, f1 y where f2.f >= 10 and x.lang = f2.lang and y.lang = f2.lang and x.w1 = f2.w1 and y.w1 = f2.w2
              union all select f3.lang, f3.w1, f3.w2, f3.w3, f3.f, 1, x.f, y.f from f3, f1 x, f2 y where x.lang = f3.lang and y.lang = f3.lang and x.w1 = f3.w1 and y.w1 = f3.w2 and y.w2 = f3.w3
              union all select f3.lang, f3.w1, f3.w2, f3.w3, f3.f, 2, x.f, y.f from f3, f2 x, f1 y where x.lang = f3.lang and y.lang = f3.lang and x.w1 = f3.w1 and x.w2 = f3.w2 and y.w1 = f3.w3),
        c as (select *, cast((1000000::hugeint * a * a) // (l::hugeint * r) as bigint) as score from s),
        b as (select * from c qualify row_number() over (partition by lang, w1, w2, w3 order by score, k) = 1),
        g as (select lang, w1, w2, max(f) as f from (select lang, w1, w2, f from f3 union all select lang, w2, w3, f from f3) group by all),
        d as (select b.*, concat_ws(' ', b.w1, b.w2, b.w3) as phrase from b left join g on b.w3 is null and g.lang = b.lang and g.w1 = b.w1 and g.w2 = b.w2 where g.f is null or 100 * g.f < 50 * a),
        t as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from d qualify rank <= 2000)
        select t.lang as lang, cast(rank as bigint) as rank, phrase, cast(a as bigint) as a, cast(l as bigint) as l, cast(r as bigint) as r, cast(n.n as bigint) as n, score from t join n on t.lang = n.lang
    """,
}
