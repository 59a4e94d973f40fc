"""The bench of read cues tells those that nothing matches."""

from cuewright.plans import composites


def test_cues_without_a_match_are_counted(spark):
    cue = "file_id long, pos long, s double, e double, text string"
    ref = spark.createDataFrame([(1, 1, 0.0, 2.0, "one!"), (1, 2, 5.0, 6.0, "two"), (1, 3, 8.0, 9.0, "gone"), (2, 1, 0.0, 1.0, "never read"), (4, 1, 0.0, 1.0, None)], cue)
    hyp = spark.createDataFrame([(1, 1, 0.5, 1.5, "one"), (1, 2, 1.9, 5.2, "to"), (1, 3, 20.0, 21.0, "stray"), (1, 4, 6.0, 7.0, "stray"), (3, 1, 0.0, 1.0, "stray"), (4, 1, 0.0, 1.0, None)], cue)
    got = {r.file_id: (r.cues, r.exact, None if r.similarity is None else round(r.similarity, 3), r.unmatched, r.unread) for r in composites.ocr_scores(ref, hyp).collect()}
    assert got == {1: (2, 1, round((2 * 3 / 7 + 2 * 2 / 5) / 2, 3), 2, 1), 2: (0, 0, None, 0, 1), 3: (0, 0, None, 1, 0), 4: (1, 1, 1.0, 0, 0)}
