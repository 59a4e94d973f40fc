"""Subtitle readers and writers on literal files."""

import struct

from cuewright.functions import protocols as pr
from cuewright.plans import composites
from cuewright.sources import sinks
from cuewright.sources import pgs
from cuewright.sources import subtitles as su


def test_srt_round_trip_and_odd_blocks(spark, tmp_path):
    text = "﻿1\n00:00:01,500 --> 00:00:02.000\n<i>One</i>\nline\n\nno time here\n\n3\n00:00:03,5 --> 00:00:04,000\nTwo\n"
    (tmp_path / "a.srt").write_text(text, encoding="utf-8")
    cues = su.parse_srt(su.read_texts(spark, str(tmp_path / "a.srt")))
    assert [(r.s, r.e, r.text) for r in cues.orderBy("s").collect()] == [(1.5, 2.0, "One\nline"), (3.005, 4.0, "Two")]
    again = sinks.srt_texts(cues.withColumnRenamed("path", "file_id").withColumnRenamed("n", "idx")).first().srt
    assert again.startswith("1\n00:00:01,500 --> 00:00:02,000\nOne\nline\n\n2\n00:00:03,005")
    assert [r.text for r in su.track_cues(cues, "en").orderBy("idx").collect()] == ["One line", "Two"]


def test_ass_dialogue(spark):
    script = """[V4+ Styles]
Format: Name, Alignment
Style: Main,2
Style: Top,8
Style: Sign,2
[Events]
Format: Start, End, Style, Effect, Text
Dialogue: 0:00:02.00,0:00:05.00,Main,,{\\i1}The town zoo\\Nis busy
Dialogue: 0:00:05.02,0:00:08.00,Main,,The town zoo\\Nis busy
Dialogue: 0:00:03.00,0:00:04.00,Top,,a sign, hidden
Dialogue: 0:00:20.00,0:00:21.00,Top,,alone, kept
Dialogue: 0:00:03.00,0:00:04.00,Sign,,no
Dialogue: 0:00:03.00,0:00:04.00,Main,scroll,no"""
    out = su.parse_ass(spark.createDataFrame([("x", script)], "path string, text string"))
    assert [(r.s, r.e, r.text) for r in out.orderBy("s").collect()] == [(2.0, 8.0, "The town zoo\nis busy"), (20.0, 21.0, "alone, kept")]


def test_glossary_and_files(spark, tmp_path):
    g = su.parse_glossary(spark.createDataFrame([("g", "# c\nAnna\tAna\nBo=Beau\nAnna=Anne\n\nbroken")], "path string, text string"))
    assert sorted((r.term, r.rendering) for r in g.collect()) == [("Anna", "Anne"), ("Bo", "Beau")]
    (tmp_path / "d").mkdir()
    for n in ("a.mkv", "d/b.MP4", "c.txt"):
        (tmp_path / n).write_bytes(b"x")
    assert [r.path.rsplit("/", 1)[1] for r in su.find_files(spark, str(tmp_path)).collect()] == ["a.mkv", "b.MP4"]


def _segment(t, kind, body):
    return b"PG" + struct.pack(">IIBH", int(t * 90000), 0, kind, len(body)) + body


def test_pgs_stream(spark):
    pcs = lambda n: struct.pack(">HHBHBBBB", 1920, 1080, 16, 1, 0x80, 0, 0, n) + b"".join(struct.pack(">HBBHH", 7, 0, 0, 10, 10) for _ in range(n))
    palette = bytes([0, 0]) + bytes([1, 235, 128, 128, 255])
    run = bytes([1, 1, 0, 2]) + bytes([0, 0]) + bytes([0, 0x84, 1])
    obj = struct.pack(">HBB", 7, 0, 0xC0) + (len(run) + 4).to_bytes(3, "big") + struct.pack(">HH", 4, 2) + run
    data = _segment(1, 0x16, pcs(1)) + _segment(1, 0x14, palette) + _segment(1, 0x15, obj) + _segment(1, 0x80, b"") + _segment(3, 0x16, pcs(0)) + _segment(3, 0x80, b"")
    files = spark.createDataFrame([("x", bytearray(data))], "path string, content binary")
    rows = pgs.decode_pgs(files).collect()
    white, none = (255, 255, 255, 255), (0, 0, 0, 0)
    assert [(r.s, r.e, r.width, r.height, r.pixels) for r in rows] == [(1.0, 3.0, 4, 2, 6)]
    assert [tuple(rows[0].rgba[4 * k : 4 * k + 4]) for k in range(8)] == [white, white, none, none, *[white] * 4]
    assert [(r.s, r.e) for r in pgs.pgs_intervals(files).collect()] == [(1.0, 3.0)]


def test_pgs_crops_palettes_stacks_junk_and_cuts():
    refs = lambda *objs: b"".join(struct.pack(">HBBHH", o, 0, 0x80 if crop else 0, x, y) + b"\0" * (8 if crop else 0) for o, x, y, crop in objs)
    pcs = lambda pal, *objs: struct.pack(">HHBHBBBB", 1920, 1080, 16, 1, 0x80, 0, pal, len(objs)) + refs(*objs)
    obj = lambda o, w, h, code: struct.pack(">HBB", o, 0, 0x80) + (len(code) + 4).to_bytes(3, "big") + struct.pack(">HH", w, h) + code
    line = lambda w, c: bytes([0, 0x80 | w, c, 0, 0])
    more = struct.pack(">HBB", 2, 0, 0x40) + line(2, 1)
    first = [_segment(1, 0x16, pcs(3, (2, 30, 900, True), (1, 20, 50, False))), _segment(1, 0x14, bytes([3, 0, 1, 235, 128, 128, 255, 2, 16, 128, 128, 9])), _segment(1, 0x15, obj(1, 3, 1, line(3, 2))), _segment(1, 0x15, obj(2, 2, 2, line(1, 1))), _segment(1, 0x15, more), _segment(1, 0x80, b"")]
    second = [_segment(2, 0x16, pcs(9, (1, 0, 0, False))), _segment(2, 0x80, b""), _segment(4, 0x16, pcs(3)), _segment(4, 0x80, b"")]
    data = b"junk" + b"".join(first) + b"P?" + b"".join(second)
    a, b = pgs.shown(data)
    assert (a.start, a.end, b.start, b.end) == (1.0, 2.0, 2.0, 4.0)
    assert a.image.shape == (1 + 8 + 2, 12, 4) and (a.image[0, :3] == (0, 0, 0, 9)).all() and (a.image[0, 3:] == 0).all()
    assert (a.image[9, 10] == 255).all() and (a.image[9, 11] == 0).all() and (a.image[10, 10:] == 255).all()
    assert not b.image[:, :, 3].any()  # its palette was never told
    assert list(pgs.intervals(data)) == [(1.0, 4.0)]
    cut = pgs.trimmed(data, 1)
    assert len(list(pgs.shown(cut))) == 1 and len(cut) < len(data) and pgs.trimmed(data, 5) == data
    assert (pgs.bitmap(bytes([0, 0x41, 0x02, 7]), 300, 1)[0, 256:260] == (0, 0, 7, 0)).all()
    assert (pgs.bitmap(bytes([5, 0, 0xC1]), 4, 2) == [[5, 0, 0, 0], [0, 0, 0, 0]]).all() and list(pgs.shown(b"PG" + b"\0" * 20)) == []


def test_routes_and_stand_ins(spark):
    pairs = spark.createDataFrame([("ja", "th"), ("en", "th"), ("fr", "de"), ("en", "de")], "src string, tgt string")
    routes = spark.createDataFrame([("ja", "th", "a"), ("*", "th", "b"), ("fr", "*", "c"), ("*", "*", "d")], "src string, tgt string, preset string")
    assert sorted(r.preset for r in pr.routed(pairs, routes).collect()) == ["a", "b", "c", "d"]


def test_typeset_and_metrics(spark):
    cue = spark.createDataFrame([(1, 0, 0.0, 0.2, "a line that is long enough to need more time than it has"), (1, 1, 1.0, 2.0, "next")], "file_id long, idx long, s double, e double, text string")
    out = composites.typeset(cue).orderBy("idx").collect()
    assert "\n" in out[0].text and out[0].e <= out[1].s and out[1].s >= 1.0
    m = spark.createDataFrame([("up", {"host": 'a"b', "a": "1"}, 2.0)], "name string, labels map<string,string>, value double")
    assert sinks.prometheus_lines(m).first().line == 'up{a="1",host="a\\"b"} 2.0'


def test_lines_are_tried_again_and_flagged(spark):
    from cuewright.functions import protocols as pr

    def model():
        return lambda pdf: pdf.assign(tgt=["T:" + s if s == "easy" or s == "second" and a == 1 else "" for s, a in zip(pdf["src"], pdf["attempt"], strict=True)])

    rows = [(1, "easy", None, ["loop"]), (2, "second", "", []), (3, "never", " ", []), (4, "done", "told", [])]
    got = pr.line_by_line(spark.createDataFrame(rows, "n int, src string, tgt string, flags array<string>"), model).collect()
    assert sorted((r.n, r.tgt, r.flags) for r in got) == [(1, "T:easy", ["loop"]), (2, "T:second", []), (3, "never", ["untranslated"]), (4, "told", [])]
