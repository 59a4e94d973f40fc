"""Interval algebra: literal cases and properties against nested loops."""

import random

import pytest
from pyspark.sql import functions as F

from cuewright.operators import intervals as iv
from cuewright.plans import timed

SCHEMA = "file_id long, pos long, s double, e double, speaker string"


def rows(spark, pairs, file_id=1, who=""):
    return spark.createDataFrame([(file_id, i, float(a), float(b), who or f"S{i}") for i, (a, b) in enumerate(pairs)], SCHEMA)


def got(df):
    return sorted((r.s, r.e) for r in df.select("s", "e").collect())


def test_union_merges_touching_and_gap_is_strict(spark):
    assert got(iv.union(rows(spark, [(5, 8), (0, 3), (2, 4)]), ["file_id"])) == [(0, 4), (5, 8)]
    assert got(iv.union(rows(spark, [(0, 2), (2, 3)]), ["file_id"])) == [(0, 3)]
    assert got(iv.union(rows(spark, [(0, 2), (3, 5), (20, 22)]), ["file_id"], gap=5.0)) == [(0, 5), (20, 22)]
    assert got(iv.union(rows(spark, [(0, 2), (7, 8)]), ["file_id"], gap=5.0)) == [(0, 2), (7, 8)]


def test_intersection_and_difference(spark):
    a, b = rows(spark, [(0, 10)]), rows(spark, [(2, 4), (8, 12)])
    assert got(iv.intersect(a, b, ["file_id"], cell=3.0)) == [(2, 4), (8, 10)]
    assert got(iv.minus(a, b, ["file_id"], cell=3.0)) == [(0, 2), (4, 8)]
    assert got(iv.minus(a, b.limit(0), ["file_id"])) == [(0, 10)] and got(iv.intersect(a, b.limit(0), ["file_id"])) == []


def test_coverage_ratio(spark):
    c = iv.covered(rows(spark, [(0, 2), (5, 5)]), rows(spark, [(0, 1.4), (2.4, 3.4)]), ["file_id"], ["pos"])
    assert [round(r.x, 6) for r in c.orderBy("pos").select(iv.ratio(F.col("sec"), F.col("s"), F.col("e")).alias("x")).collect()] == [0.7, 0.0]


@pytest.mark.parametrize("seed", range(3))
def test_joins_equal_nested_loops_and_lengths_add_up(spark, seed):
    r = random.Random(seed)
    make = lambda n: [(x := round(r.uniform(0, 100), 2), x + round(r.choice([0, r.uniform(0, 3), r.uniform(0, 40)]), 2)) for _ in range(n)]
    a, b = make(40), make(40)
    da, db = rows(spark, a), rows(spark, b)
    pairs = {(x.l.pos, x.r.pos) for x in iv.interval_join(da, db, ["file_id"], 0.2, cell=7.0).collect()}
    assert pairs == {(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if min(x[1], y[1]) - max(x[0], y[0]) > 0.2}
    best = {x.l.pos: x.r.pos for x in iv.argmax_overlap(da, db, ["file_id"], ["pos"], cell=7.0).collect()}
    for i, x in enumerate(a):
        over = [(-(min(x[1], y[1]) - max(x[0], y[0])), y[0], j) for j, y in enumerate(b)]
        assert best.get(i) == (min(over)[2] if min(over)[0] < 0 else None)
    ua, ub = iv.union(da, ["file_id"]).withColumn("pos", F.lit(0)), iv.union(db, ["file_id"]).withColumn("pos", F.lit(0))
    assert got(iv.union(ua, ["file_id"])) == got(ua)
    size = lambda df: sum(e - s for s, e in got(df))
    assert abs(size(ua) - size(iv.intersect(ua, ub, ["file_id"], 7.0)) - size(iv.minus(ua, ub, ["file_id"], 0.0, 7.0))) < 1e-6


def test_nearest_takes_the_earlier_of_two(spark):
    marks, points = rows(spark, [(1, 1), (5, 5)]), rows(spark, [(3, 3), (4.5, 4.5), (20, 20)])
    assert [(r.at, r.dist) for r in iv.nearest(points, marks, ["file_id"], [], 3.0).orderBy("pos").collect()] == [(1.0, 2.0), (5.0, 0.5), (None, None)]


def test_switches(spark):
    s = timed.switches(rows(spark, [(10, 20), (50, 60)]), rows(spark, [(11, 21), (80, 90)]), 3.0, 5.0).first()
    assert (s.switches, s.detected, s.invented, s.late / s.detected) == (4, 2, 2, 1.0)


def test_words_take_a_clear_voice_or_none(spark):
    turns = spark.createDataFrame([(1, 0, 0.0, 2.0, "A"), (1, 1, 2.0, 4.0, "B"), (1, 2, 4.5, 6.0, "A")], SCHEMA)
    words = rows(spark, [(0.1, 0.9), (1.5, 2.5), (1.9, 3.9), (4.1, 4.3), (8, 9)])
    told = {r.pos: (r.label, r.verdict) for r in timed.label_words(words, turns, ["file_id"]).collect()}
    assert told == {0: ("A", "labelled"), 1: ("", "ambiguous"), 2: ("B", "labelled"), 3: ("B", "near"), 4: ("", "none")}


def test_votes_and_priors(spark):
    v = spark.createDataFrame([(1, "ja", 0.9), (1, "ja", 0.5), (1, "en", 0.3), (2, "en", 0.4), (2, None, 9.0)], "k int, lang string, weight double")
    assert sorted((r.k, r.lang, r.score, r.margin) for r in timed.decide(v, ["k"]).collect()) == [(1, "ja", 1.4, 1.1), (2, "en", 0.4, 0.4)]
    w = spark.createDataFrame([("S1", "ja", 9.0, True), ("S1", "en", 0.5, True), ("S2", "ja", 5.0, True), ("S2", "en", 5.0, True), ("S3", "en", 7.0, True), ("S3", "ja", 3.0, True), ("S4", "en", 50.0, False)], "speaker string, lang string, speech double, confident boolean")
    assert sorted(tuple(r) for r in timed.speaker_priors(w).collect()) == [("S1", "ja", 0.5), ("S3", "en", 0.25)]


def test_overlap_join_plans_as_an_equi_join(spark):
    plan = iv.interval_join(rows(spark, [(0, 1)]), rows(spark, [(0, 1)]), ["file_id"])._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_cells_and_deals_change_no_pair(spark):
    import random

    r = random.Random(5)
    rows = [(r.randrange(2), i, float(s), float(s + r.choice([0, 1, 5, 300]))) for i in range(120) for s in [r.randrange(400)]]
    df = spark.createDataFrame(rows, "k int, pos int, s double, e double")
    pairs = lambda **m: sorted((x.l.pos, x.r.pos) for x in iv.interval_join(df, df, ["k"], **m).select("l", "r").collect())
    cell = iv.cell_of(df)
    assert 1 <= cell <= 300 and pairs(cell=cell) == pairs(cell=7.0, deal=5) == pairs()
    assert iv.cell_of(df.limit(0)) == 1.0
