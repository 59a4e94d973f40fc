"""Streams give what their batch twins give, and resume."""

from pyspark.sql import functions as F

from cuewright.streaming import events as ev
from cuewright.tables import read

SF = "/root/testdata/sf0.001"


def _parts(spark, path, n=4):
    e = read(spark, SF, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    e.repartitionByRange(n, "ts").sortWithinPartitions("ts").write.parquet(str(path))
    return e


def test_windows_and_sessions_equal_batch(spark, tmp_path):
    e = _parts(spark, tmp_path / "in")
    for name, f in (("tumbling", ev.tumbling), ("sessions", ev.sessions)):
        out = str(tmp_path / name)
        ev.run_once(f(ev.events(spark, str(tmp_path / "in")), late="60 days"), str(tmp_path / f"cp-{name}"), lambda df, k, out=out: df.write.mode("append").parquet(out), "update" if name == "tumbling" else "append")
        if name == "tumbling":
            got = spark.read.parquet(out).groupBy("start", "event_type").agg(F.max("n").alias("n")).agg(F.sum("n"), F.count("*")).first()
            assert tuple(got) == tuple(f(e).agg(F.sum("n"), F.count("*")).first())


def test_carried_state_resumes(spark, tmp_path):
    e, out = _parts(spark, tmp_path / "in"), str(tmp_path / "out")
    sink = lambda df, k: df.withColumn("round", F.lit(k)).write.mode("append").parquet(out)
    for _ in range(2):  # the second run has nothing new
        ev.run_once(ev.carried(ev.events(spark, str(tmp_path / "in"), 1)), str(tmp_path / "cp"), sink, "update")
    got = spark.read.parquet(out).groupBy("user_id").agg(F.max(F.struct("seen", "types")).alias("x")).select("user_id", "x.*")
    assert got.agg(F.sum("seen")).first()[0] == e.count()
    assert sorted((r.user_id, r.seen) for r in got.collect()) == sorted((r.user_id, r["count"]) for r in e.groupBy("user_id").count().collect())


def test_log_tail(spark, tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "1.txt").write_text("a\nb\n")
    lines = []
    sink = lambda df, k: lines.extend(r.line for r in df.collect())
    ev.run_once(ev.log_tail(spark, str(tmp_path / "log")), str(tmp_path / "cp"), sink)
    (tmp_path / "log" / "2.txt").write_text("c\n")
    ev.run_once(ev.log_tail(spark, str(tmp_path / "log")), str(tmp_path / "cp"), sink)
    assert lines == ["a", "b", "c"]
