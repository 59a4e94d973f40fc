"""Structured Streaming: carried state, windows with watermarks, and resumable sinks. Every stream has a batch twin in ``plans``
or below, which tests hold it against."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def events(spark: SparkSession, path: str, files_per_trigger: int = 10) -> DataFrame:
    """A stream over Parquet files of the events table, some files a round."""
    schema = spark.read.parquet(path).schema
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(df: DataFrame, size: str = "1 hour", late: str | None = "2 hours") -> DataFrame:
    """Events and their value by type and window; rows later than ``late`` behind the newest are dropped in a stream."""
    d = df.withWatermark("ts", late) if late and df.isStreaming else df
    return d.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("v")).select("w.start", "w.end", "event_type", "n", "v")


def sessions(df: DataFrame, gap: str | Column = "30 minutes", late: str | None = "2 hours") -> DataFrame:
    """A user's sessions: events less than the gap apart."""
    d = df.withWatermark("ts", late) if late and df.isStreaming else df
    return d.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("w.start", "w.end", "user_id", "n")


def carried(df: DataFrame, key: str = "user_id") -> DataFrame:
    """State across batches for each key: events seen, and the distinct types in the order of their coming."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        seen, types = state.get if state.exists else (0, "")
        known = types.split(",") if types else []
        for pdf in batches:
            seen += len(pdf)
            for t in pdf.sort_values(["ts", "event_id"])["event_type"]:
                if t not in known:
                    known.append(t)
        state.update((seen, ",".join(known)))
        yield pd.DataFrame({key: [k[0]], "seen": [seen], "types": [",".join(known)]})

    return df.groupBy(key).applyInPandasWithState(step, f"{key} long, seen long, types string", "seen long, types string", "update", "NoTimeout")


def run_once(df: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Everything there is, in rounds; a later run goes on where this one ended. The sink must bear a round twice."""
    q = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()
    q.awaitTermination()


def log_tail(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Lines of growing log folders, offsets in the checkpoint."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path).select(F.col("value").alias("line"))
