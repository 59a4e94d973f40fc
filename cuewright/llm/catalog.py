"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, licenses, lm, mixing, neighbours, pii, simhash, substrings, toxicity
from .common import read


def op3_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(read(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), slack=5).drop("row_id")


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "<|im_end|><|im_start|>assistant ok"
    own = spark.range(1).select(F.explode(F.array(F.struct(F.lit(-1).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role"), F.lit(said).alias("text")), F.struct(F.lit(-1).cast("long").alias("conv_id"), F.lit(1).cast("long").alias("turn"), F.lit("assistant").alias("role"), F.lit(said).alias("text")))).alias("x")).select("x.*")
    return chat.digest(read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own))


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(read(spark, sf_dir, "documents")).drop("kept", "spans")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.digest(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.labelled(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return neighbours.search(vectors, vectors.filter("vec_id % 50 = 0"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents")).drop("matches", "expressions")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


OP5_SQL = r"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  union all select -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
marked as (
  select *, role is distinct from lag(role) over w as opens, role is distinct from lead(role) over w as closes,
    regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') as escaped
  from rows window w as (partition by conv_id order by turn, role, text))
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(case when opens then length('<|im_start|>') + length(role) + 1 else length('<|im_part|>') end
    + length(escaped) + case when closes then length('<|im_end|>') + 1 else 0 end) as bigint) as formatted_chars
from marked group by conv_id
"""

OP4_SQL = r"""
with docs as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from (select doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents)),
items as (select cast(item_id as varchar) as item_id, regexp_extract_all(text, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from (select item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from benchmark)),
windows as (select item_id, least(10, len(w)) as n, array_to_string(w[s : s + least(10, len(w)) - 1], ' ') as phrase
  from (select item_id, w, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) as s from items where len(w) > 0)),
sizes as (select distinct n from windows),
spots as (select doc_id, s, n, array_to_string(w[s : s + n - 1], ' ') as phrase
  from (select doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) as s from docs, sizes where len(w) >= n)),
hits as (select distinct doc_id, s, spots.n, item_id from spots join windows using (n, phrase)),
numbered as (select row_number() over () as item_row, item_id, w from items where len(w) > 0),
terms as (select item_id, item_row, term, len(w) + 5 as reach, len(list_distinct(w)) as n_terms
  from (select item_id, item_row, w, unnest(list_distinct(w)) as term from numbered)),
postings as (select doc_id, pos, unnest(w[pos + 1 : pos + 1]) as term from (select doc_id, w, unnest(generate_series(0, len(w) - 1)) as pos from docs where len(w) > 0)),
listed as (select doc_id, item_id, item_row, pos, term, reach, n_terms from postings join terms using (term)),
whole as (select doc_id, item_row from listed group by all having count(distinct term) = any_value(n_terms)),
kept as (select * from listed semi join whole using (doc_id, item_row)),
within as (select a.doc_id, a.item_id, a.item_row, a.pos, a.n_terms, count(distinct b.term) as found
  from kept a join kept b on a.doc_id = b.doc_id and a.item_row = b.item_row and b.pos >= a.pos and b.pos < a.pos + a.reach group by all),
near as (select doc_id, count(distinct item_id) as n_near, string_agg(distinct item_id, ',' order by item_id) as near_ids from within where found = n_terms group by doc_id),
words as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(generate_series(s, s + n - 1)) as p from hits) group by doc_id),
told as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct item_id, ',' order by item_id) as ids from hits group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated,
  coalesce(n_near, 0) as n_near, sha256(coalesce(near_ids, '')) as near_sha256
from docs left join words using (doc_id) left join told using (doc_id) left join near using (doc_id)
""".replace("lower(coalesce(text, ''))", "coalesce(text, '')")


def oracle_sql() -> dict[str, str]:
    return {"op4_decontaminate": OP4_SQL, "op5_chat": OP5_SQL}
