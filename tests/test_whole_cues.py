"""Cue queries over every cue and its whole text."""

import re

import pytest

from cuewright.plans import composites, extras
from cuewright.plans import sequences as se


@pytest.fixture()
def folder(spark, tmp_path):
    body = " ".join(f"word{i} goes on, and on;" for i in range(40))
    rows = [(1, t, "user", f"cue {t} {body} tail{t}") for t in range(3)] + [(2, 0, "user", "short")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    return str(tmp_path), {(f, t): x for f, t, _, x in rows}


def test_characters_of_every_cue(spark, folder):
    path, text = folder
    rows = se.e19_characters(spark, path).collect()
    assert sorted((r.file_id, r.idx, r.k) for r in rows) == sorted((f, i, k) for (f, i), t in text.items() for k in range(len(t)))
    timed = composites.e20_transfer_timing(spark, path).collect()
    assert {(f, i): sum((r.file_id, r.chunk) == (f, i) for r in timed) for f, i in text} == {k: len(t.split()) for k, t in text.items()}
    assert all(r.e > r.s for r in timed)
    assert {(r.file_id, r.pos // 1_000_000) for r in se.e18_repair(spark, path).collect()} == set(text)
    assert se.words(spark, path).count() == sum(len(t.split()) for t in text.values())


def test_whole_texts_are_typeset(spark, folder):
    path, text = folder
    srt = {int(r["file_id"]): r["srt"] for r in composites.k13_subtitles(spark, path).collect()}
    lines = [x for s in srt.values() for x in s.split("\n")]
    for (f, i), t in text.items():
        words = re.findall(r"\S+", " ".join(x for x in srt[f].split("\n") if "-->" not in x))
        assert set(t.split()) <= {w.removeprefix("tr:") for w in words}, (f, i)
    assert max(map(len, (x for x in lines if "-->" not in x))) <= 42
    assert {(r.file_id, r.idx): r.chars for r in extras.h22_fit_parts(spark, path).collect()}[(1, 0)] > 0.9 * len(text[(1, 0)])
    wrapped = {(r.file_id, r.idx): r.lines for r in se.h21_wrap(spark, path).collect()}
    assert wrapped == {k: "short" if t == "short" else "-" for k, t in text.items()}  # longer than two lines


def test_windows_of_context(spark):
    rows = [(1, i, "en" if i < 30 else "fr", f"line {i} " + "x" * 40, "" if i == 15 else f"t{i}") for i in range(34)]
    df = spark.createDataFrame(rows, "file_id long, idx long, lang string, src string, tgt string")
    got = {r.win: r for r in se.context_windows(df).collect()}
    assert [(got[k].lang, got[k].n) for k in sorted(got)] == [("en", 20), ("en", 10), ("fr", 4)]
    src = lambda xs: [x.split()[1] for x in xs]
    assert src(x.src for x in got[1].before) == [str(i) for i in (12, 13, 14, 16, 17, 18, 19)] and src(got[0].after) == ["20", "21", "22"]
    assert got[0].before == [] and src(got[1].after) == ["30", "31", "32"] and got[2].after == [] and all(len(x) > 40 for x in got[0].after)
