"""Cases in which queries once gave other results than their SQL."""

import duckdb

from cuewright.operators import tracks
from cuewright.plans import extras, sequences, timed


def test_tables_may_be_folders(spark, tmp_path):
    folder = tmp_path / "sf"
    spark.range(20).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.range(2).coalesce(1).write.parquet(f"{tmp_path}/one")
    next((tmp_path / "one").glob("part-*.parquet")).rename(folder / "benchmark.parquet")
    assert [r.name for r in extras.a1_find_files(spark, str(folder)).collect()] == ["benchmark", "documents"]


def test_votes_add_up_in_the_order_of_rows(spark):
    rows = [(1, 3, "b", 0.3), (1, 2, "b", 0.2), (1, 4, "a", 0.6), (1, 1, "b", 0.1)]
    votes = spark.createDataFrame(rows, "file_id long, pos long, lang string, weight double").coalesce(1)
    got = {r.file_id: (r.lang, r.score, r.margin) for r in timed.decide(votes, ["file_id"], ["pos"]).collect()}
    assert 0.1 + 0.2 + 0.3 > 0.6 == 0.3 + 0.2 + 0.1
    assert got == {1: ("b", 0.6, 0.0)}


def test_gaps_between_sentences_are_exact(spark, tmp_path):
    text = ". ".join("x" * n for n in (19, 40, 24, 48, 25, 4)) + "."
    text = text + " " * (171 - len(text))
    spark.createDataFrame([(1, 0, "user", text)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    con.execute("create view documents as select 0 as doc_id, '' as text, '' as lang")
    con.execute("create view events as select 0 as event_id, 0 as user_id, now() as ts, '' as event_type, 0.0 as value, '' as props")
    want = con.execute(f"select part, start_ms, length_ms from ({sequences.SQL['e17_sentences']}) order by part").fetchall()
    assert len(want) == 6 and [tuple(r) for r in sequences.e17_sentences(spark, str(tmp_path)).orderBy("part").select("part", "start_ms", "length_ms").collect()] == want


def test_tracks_are_read_once(spark):
    one = spark.range(1).selectExpr("id as file", "cast(0 as int) as idx", "'eng' as language", "cast(id as string) as title", "'subrip' as codec", "true as is_text", "false as forced", "true as is_default")
    targets, side = one.selectExpr("file", "explode(array('en', 'th')) as target"), one.selectExpr("file", "'ko' as code")
    source = tracks.plan_sources(one, targets, one.selectExpr("file", "'ja' as spoken"), side, ("ja",))[1]
    assert [tuple(r) for r in source.collect()] == [(0, "en", "text", 0)]
    assert source._jdf.queryExecution().optimizedPlan().toString().count("karaoke") == 1  # the filter of usable tracks
