"""Sinks: SRT texts, JSON results and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import timefmt as tf


def srt_texts(cues: DataFrame, key: str = "file_id") -> DataFrame:
    """cues: key, idx, s, e, text. One SRT text for each key, cues numbered from 1."""
    rows = cues.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("s", "idx", "e", "text"))).alias("x"))
    block = F.transform("x", lambda r, i: F.concat((i + 1).cast("string"), F.lit("\n"), tf.srt_time(r["s"]), F.lit(" --> "), tf.srt_time(r["e"]), F.lit("\n"), r["text"], F.lit("\n")))
    return rows.select(key, F.concat(F.array_join(block, "\n"), F.lit("\n")).alias("srt"))


def write_srt(cues: DataFrame, path: str, key: str = "file_id") -> None:
    """A folder for each key with its SRT text; the commit protocol keeps half-written files out."""
    srt_texts(cues, key).write.partitionBy(key).mode("overwrite").option("lineSep", "").text(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def prometheus_lines(metrics: DataFrame) -> DataFrame:
    """metrics: name, labels (map), value. One text line for each."""
    labels = F.array_join(F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit('="'), F.replace(e["value"], F.lit('"'), F.lit('\\"')), F.lit('"'))), ",")
    return metrics.select(F.concat("name", F.lit("{"), labels, F.lit("} "), F.col("value").cast("string")).alias("line"))
