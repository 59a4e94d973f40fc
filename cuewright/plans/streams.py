"""Batch twins of the streaming queries, over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import events as ev
from ..tables import read


def _events(spark, sf):
    return read(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def i_tumbling(spark, sf):
    return ev.tumbling(_events(spark, sf)).select(F.unix_seconds("start").alias("start"), "event_type", "n", F.round("v", 4).alias("v"))


def i_sessions(spark, sf):
    return ev.sessions(_events(spark, sf)).select(F.unix_micros("start").alias("start_us"), "user_id", "n")


def i_carried(spark, sf):
    e = _events(spark, sf).groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.min(F.struct("ts", "event_id")).alias("first"))
    g = e.groupBy("user_id").agg(F.sum("n").alias("seen"), F.array_sort(F.collect_list(F.struct("first", "event_type"))).alias("x"))
    return g.select("user_id", "seen", F.array_join(F.transform("x", lambda r: r["event_type"]), ",").alias("types"))


QUERIES = {"i_tumbling": i_tumbling, "i_sessions": i_sessions, "i_carried": i_carried}
SQL = {
    "i_tumbling": "select cast(epoch(date_trunc('hour', ts)) as bigint) as start, event_type, count(*) as n, round(sum(value), 4) as v from events group by all",
    "i_sessions": "select epoch_us(min(ts)) as start_us, user_id, count(*) as n from (select *, sum(o) over (partition by user_id order by ts, event_id) as run from (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) <= interval 30 minute then 0 else 1 end as o from events)) group by user_id, run",
    "i_carried": "select user_id, cast(sum(n) as bigint) as seen, string_agg(event_type, ',' order by first, fid) as types from (select user_id, event_type, count(*) as n, min(ts) as first, arg_min(event_id, (ts, event_id)) as fid from events group by all) group by user_id",
}
