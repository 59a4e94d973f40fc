"""Timed tables derived from the supplied Parquet; the SQL beside each is the same derivation for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as spans: file_id, pos, s, e (seconds), lang, speaker, conf. A value of 0 gives a span of no length."""
    start = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    return read(spark, sf_dir, "events").select(
        F.col("user_id").alias("file_id"), F.col("event_id").alias("pos"), start.alias("s"), (start + F.col("value") * 60).alias("e"),
        F.col("event_type").alias("lang"), F.concat(F.lit("S"), k % 4).alias("speaker"), (k / 100).alias("conf"),
    )


def cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as cues at 15 characters a second: file_id, idx, s, e, speaker, src."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    c = read(spark, sf_dir, "conversations").withColumn("n", F.length("text")).withColumn("until", F.sum("n").over(w))
    return c.select(F.col("conv_id").alias("file_id"), F.col("turn").alias("idx"), ((F.col("until") - F.col("n")) / 15.0).alias("s"), (F.col("until") / 15.0).alias("e"), F.col("role").alias("speaker"), F.col("text").alias("src"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents split on line feeds: file_id, pos, text, lang."""
    d = read(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("file_id"), "lang", F.posexplode(F.split("text", "\n")).alias("pos", "text"))


SPANS = """spans as (select user_id as file_id, event_id as pos, epoch(ts) as s, epoch(ts) + value * 60 as e, event_type as lang,
  'S' || (cast(regexp_extract(props, '([0-9]+)', 1) as int) % 4) as speaker, cast(regexp_extract(props, '([0-9]+)', 1) as int) / 100 as conf from events)"""
CUES = """cues as (select conv_id as file_id, turn as idx, (until - n) / 15.0 as s, until / 15.0 as e, role as speaker, text as src from (
  select *, length(text) as n, cast(sum(length(text)) over (partition by conv_id order by turn rows unbounded preceding) as double) as until from conversations))"""
LINES = """lines as (select doc_id as file_id, lang, i - 1 as pos, parts[i] as text from (
  select doc_id, lang, parts, unnest(generate_series(1, len(parts))) as i from (select doc_id, lang, string_split(text, chr(10)) as parts from documents)))"""
