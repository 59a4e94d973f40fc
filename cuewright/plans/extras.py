"""Readers on literal files, long-text splitting, and small signal operators."""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import timefmt as tf
from ..functions import typesetting as ty
from ..operators import sequence as sq
from ..sources import pgs, sinks
from ..sources import subtitles as su
from ..tables import CUES, SPANS, cues, read, spans
from . import sequences as se
from .timed import ms


def a4_read_srt(spark, sf):
    """Every conversation written as SRT and read back."""
    files = se.a17_srt(spark, sf).select(F.col("file_id").cast("string").alias("path"), F.regexp_replace("srt", "\n{3,}", "\n\n").alias("text"))
    return su.parse_srt(files).groupBy(F.col("path").alias("file_id")).agg(F.count("*").alias("blocks"), ms(F.sum(F.col("e") - F.col("s"))).alias("total_ms"))


def a5_read_ass(spark, sf):
    """Conversations as ASS scripts, read back: braces stripped, repeats merged."""
    t = lambda c: F.format_string("%d:%02d:%02d.%02d", F.floor(c / 3600), F.floor(c / 60) % 60, F.floor(c) % 60, F.floor(c * 100) % 100)
    c = cues(spark, sf).withColumn("line", F.concat(F.lit("Dialogue: "), t(F.col("s")), F.lit(","), t(F.col("e")), F.lit(",Main,,{\\i1}"), F.translate("src", "\n{}\\", " ")))
    g = c.groupBy("file_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "line"))), lambda x: x["line"]), "\n").alias("x"))
    files = g.select(F.col("file_id").cast("string").alias("path"), F.concat(F.lit("[V4+ Styles]\nFormat: Name, Alignment\nStyle: Main,2\n[Events]\nFormat: Start, End, Style, Effect, Text\n"), "x").alias("text"))
    return su.parse_ass(files).groupBy(F.col("path").alias("file_id")).agg(F.count("*").alias("lines"))


def a8_track_cues(spark, sf):
    files = se.a17_srt(spark, sf).select(F.col("file_id").cast("string").alias("path"), F.col("srt").alias("text"))
    return su.track_cues(su.parse_srt(files), "en").groupBy("path").agg(F.count("*").alias("cues"))


def h10_clean_reply(spark, sf):
    rows = spark.createDataFrame([("<think>x\ny</think> Transcript: \"hello\"",), ("「今日 は いい」",), ("plain",)], "text string")
    return rows.select("text", tx.clean_reply(F.col("text")).alias("clean"))


def h14_clean_ja_line(spark, sf):
    rows = spark.createDataFrame([("（男）だめだ",), ("（笑い声）",), ("{\\an8}＜上＞",), ("普通の行",)], "text string")
    return rows.select("text", tx.clean_ja_line(F.col("text")).alias("clean"))


def h22_fit_parts(spark, sf):
    c = cues(spark, sf).select("file_id", "idx", F.regexp_replace("src", r"\s+", " ").alias("t"))
    return c.select("file_id", "idx", ty.fit_parts("t", F.lit(42)).alias("parts")).select("file_id", "idx", F.size("parts").alias("n"), F.length(F.array_join("parts", "")).alias("chars"))


def a1_find_files(spark, sf):
    """The tables of a folder, by name; a table is a file or a folder of files."""
    inside = F.element_at(F.split("path", re.escape(f"/{sf.rstrip('/').rsplit('/', 1)[-1]}/")), -1)
    files = su.find_files(spark, f"{sf}/*.parquet", ("parquet",), recursive=False)
    return files.select(F.regexp_extract(inside, r"^([^/]+)\.parquet(?:/|$)", 1).alias("name")).distinct().orderBy("name")


def _hex(c, width: int):
    return F.lpad(F.hex(c.cast("long")), width, "0")


def streams(spark, sf):
    """Each conversation as a bitmap stream: every cue a picture of one object, 4 to 19 pixels wide and two high, taken down at its end.

    Between the sets stand bytes that belong to none."""
    c = cues(spark, sf)
    t = lambda x: F.round(F.col(x) * 1000) * 90
    w = 4 + F.col("idx") % 16
    segment = lambda at, kind, body: F.concat(F.lit("5047"), _hex(at, 8), F.lit("00000000" + kind), _hex(F.length(body) / 2, 4), body)
    composition = lambda k: F.concat(F.lit("07800438100001800000"), F.lit(f"{k:02x}"), F.lit("0007000000100010" if k else ""))
    row = F.concat(F.lit("00"), _hex(w + 128, 2), F.lit("010000"))
    picture = F.concat(F.lit("000700C0"), F.lit("00000E"), _hex(w, 4), F.lit("0002"), row, row)
    up = F.concat(segment(t("s"), "16", composition(1)), segment(t("s"), "14", F.lit("000001EB8080FF")), segment(t("s"), "15", picture), segment(t("s"), "80", F.lit("")))
    down = F.concat(segment(t("e"), "16", composition(0)), segment(t("e"), "80", F.lit("")))
    g = c.groupBy("file_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", F.concat(up, down, F.lit("00FF")).alias("x")))), lambda r: r["x"]), "").alias("x"))
    return g.select(F.col("file_id").cast("string").alias("path"), F.unhex("x").alias("content"))


def a9_decode_pgs(spark, sf):
    p = pgs.decode_pgs(streams(spark, sf))
    return p.select(F.col("path").alias("file_id"), ms("s").alias("start_ms"), ms("e").alias("end_ms"), "width", "height", "pixels", F.md5("rgba").alias("rgba"))


def a10_pgs_intervals(spark, sf):
    p = pgs.pgs_intervals(streams(spark, sf))
    return p.select(F.col("path").alias("file_id"), "n", ms("s").alias("start_ms"), ms("e").alias("end_ms"))


def a11_trim_pgs(spark, sf):
    """How many pictures are left of each stream cut behind two."""
    p = pgs.pgs_intervals(pgs.trim_pgs(streams(spark, sf), 2))
    return p.groupBy(F.col("path").alias("file_id")).agg(F.count("*").alias("pictures"))


def a19_metrics(spark, sf):
    """Speech by type as metrics lines."""
    s = spans(spark, sf).groupBy("lang").agg(ms(F.sum(F.col("e") - F.col("s"))).alias("v"))
    rows = s.select(F.lit("speech_ms").alias("name"), F.create_map(F.lit("lang"), "lang", F.lit("by"), F.lit('a "quote"')).alias("labels"), F.col("v").alias("value"))
    return sinks.prometheus_lines(rows)


def a22_json_results(spark, sf):
    """Counts by type as the JSON lines that the sink writes."""
    s = spans(spark, sf).groupBy("lang").agg(F.count("*").alias("spans"), F.countDistinct("file_id").alias("files"))
    return s.select(F.to_json(F.struct("lang", "spans", "files")).alias("line"))


def d22_condensed(spark, sf):
    """What a file's conversation amounts to: cues, turns of voices, voices, characters, and cues that repeat another."""
    c = cues(spark, sf).withColumn("turn", F.coalesce(F.col("speaker") != F.lag("speaker").over(Window.partitionBy("file_id").orderBy("idx")), F.lit(True)))
    return c.groupBy("file_id").agg(F.count("*").alias("cues"), F.count_if("turn").alias("turns"), F.countDistinct("speaker").alias("voices"), F.sum(F.length("src")).alias("chars"), (F.count("*") - F.countDistinct("src")).alias("copies"))


def f4_top_terms(spark, sf):
    """The eight most frequent terms of each language."""
    return se.select_terms(se.d14_candidates(spark, sf), most=8)


TITLES = ("สวัสดีครับ", "กำกำ", "ab", "e\u0301e\u0301e", "เก", "漢字かな", "")


def h23_slices(spark, sf):
    """Pieces of up to three characters that split no cluster."""
    return spark.createDataFrame([(t,) for t in TITLES], "text string").select("text", F.array_join(ty.cut_pieces("text", F.lit(3)), "|").alias("pieces"))


def h25_clock(spark, sf):
    return cues(spark, sf).select("file_id", "idx", tf.clock(F.col("s")).alias("hms"), tf.minutes(F.col("e")).alias("mmss"))


def f10_sample(spark, sf):
    """A seeded tenth of the spans: by hash of the key, so that reruns and partitions agree."""
    return spans(spark, sf).filter(F.pmod(F.xxhash64(F.lit(1), "pos"), F.lit(10)) == 0).select("file_id", "pos")


def m1_splice(spark, sf):
    """Spans of a file gathered until ten hours are full; the last is cut."""
    w = Window.partitionBy("file_id").orderBy("s", "pos").rowsBetween(Window.unboundedPreceding, -1)
    x = spans(spark, sf).withColumn("d", F.col("e") - F.col("s")).withColumn("have", F.coalesce(F.sum("d").over(w), F.lit(0.0)))
    return x.filter("have < 36000").select("file_id", "pos", ms(F.least("d", 36000 - F.col("have"))).alias("take_ms"))


def m2_forced(spark, sf):
    return spans(spark, sf).groupBy("file_id").agg(F.lit("en").alias("lang"), ms(F.sum(F.col("e") - F.col("s"))).alias("speech_ms"))


def m3_text_rows(spark, sf):
    """Runs of inked rows; gaps under 0.45 of the tallest run close."""
    ink = spans(spark, sf).filter("conf >= 0.5").select("file_id", F.floor(F.col("s") / 3600).alias("row")).distinct()
    runs = sq.islands(ink, ["file_id"], ["row"], lambda w: F.col("row") - F.lag("row").over(w) > 1).groupBy("file_id", "run").agg(F.min("row").alias("a"), (F.max("row") + 1).alias("z"))
    tall = runs.withColumn("tallest", F.max(F.col("z") - F.col("a")).over(Window.partitionBy("file_id")))
    out = sq.islands(tall.drop("run"), ["file_id"], ["a"], lambda w: F.col("a") - F.lag("z").over(w) >= 0.45 * F.col("tallest"))
    return out.groupBy("file_id", "run").agg(F.min("a").alias("a"), F.max("z").alias("z")).drop("run")


QUERIES = {k: f for k, f in globals().items() if k[:1] in "adfhm" and k[1:2].isdigit() and callable(f)}


def _sql(body: str) -> str:
    return "with " + ",\n".join([SPANS, CUES]) + "\n" + body


_RGBA = "unhex(repeat('FFFFFFFF', cast(2 * (4 + idx % 16) as int)))"
SQL = {
    "a1_find_files": "select name from (values ('benchmark'), ('conversations'), ('customer'), ('documents'), ('embeddings'), ('events'), ('labels'), ('lineitem'), ('nation'), ('orders'), ('pages'), ('part'), ('region'), ('supplier')) v(name)",
    "a5_read_ass": _sql("select cast(file_id as varchar) as file_id, count(*) as lines from (select *, lag(t) over w as before, lag(e) over w as was from (select *, trim(regexp_replace(translate(src, chr(10) || '{}' || chr(92), '    '), '[ \\t]+', ' ', 'g')) as t from cues) where t <> '' and floor(e * 100) > floor(s * 100) window w as (partition by file_id order by idx)) where before is distinct from t or floor(s * 100) / 100 > floor(was * 100) / 100 + 0.05 group by file_id"),
    "a8_track_cues": _sql("select cast(file_id as varchar) as path, count(*) as cues from cues where trim(regexp_replace(src, '[\\s]+', ' ', 'g')) <> '' and round_even(e * 1000, 0) > round_even(s * 1000, 0) group by file_id"),
    "a9_decode_pgs": _sql(f"select cast(file_id as varchar) as file_id, cast(round(s * 1000) as bigint) as start_ms, cast(round(e * 1000) as bigint) as end_ms, 4 + idx % 16 as width, 2 as height, 2 * (4 + idx % 16) as pixels, md5({_RGBA}) as rgba from cues where round(e * 1000) > round(s * 1000)"),
    "a10_pgs_intervals": _sql("select cast(file_id as varchar) as file_id, row_number() over (partition by file_id order by idx) - 1 as n, cast(round(s * 1000) as bigint) as start_ms, cast(round(e * 1000) as bigint) as end_ms from cues where round(e * 1000) > round(s * 1000)"),
    "a11_trim_pgs": _sql("select cast(file_id as varchar) as file_id, least(count(*), 2) as pictures from cues where round(e * 1000) > round(s * 1000) group by file_id"),
    "a19_metrics": _sql("select printf('speech_ms{by=\"a \\\"quote\\\"\",lang=\"%s\"} %d', lang, cast(round(sum(e - s) * 1000) as bigint)) as line from spans group by lang"),
    "a22_json_results": _sql("select cast(json_object('lang', lang, 'spans', count(*), 'files', count(distinct file_id)) as varchar) as line from spans group by lang"),
    "d22_condensed": _sql("select file_id, count(*) as cues, count(*) filter (t) as turns, count(distinct speaker) as voices, cast(sum(length(src)) as bigint) as chars, count(*) - count(distinct src) as copies from (select *, speaker is distinct from lag(speaker) over (partition by file_id order by idx) as t from cues) group by file_id"),
    "f4_top_terms": f"select lang, term, n from (select *, row_number() over (partition by lang order by n desc, term) as k from ({se.SQL['d16_select_terms'].replace('<= 60', '<= 1000000')})) where k <= 8",
    "h23_slices": "select * from (values ('สวัสดีครับ', 'สวั|สดี|ครั|บ'), ('กำกำ', 'กำก|ำ'), ('ab', 'ab'), ('e' || chr(769) || 'e' || chr(769) || 'e', 'e' || chr(769) || '|e' || chr(769) || 'e'), ('เก', 'เก'), ('漢字かな', '漢字か|な'), ('', '')) v(text, pieces)",
    "h25_clock": _sql("select file_id, idx, printf('%d:%02d:%02d', cast(floor(s) as bigint) // 3600, cast(floor(s) as bigint) // 60 % 60, cast(floor(s) as bigint) % 60) as hms, printf('%02d:%02d', cast(floor(e) as bigint) // 60, cast(floor(e) as bigint) % 60) as mmss from cues"),
    "a4_read_srt": _sql("select cast(file_id as varchar) as file_id, count(*) as blocks, cast(sum(cast(round_even(e * 1000, 0) as bigint) - cast(round_even(s * 1000, 0) as bigint)) as bigint) as total_ms from cues group by file_id"),
    "h10_clean_reply": "select * from (values ('<think>x' || chr(10) || 'y</think> Transcript: \"hello\"', 'hello'), ('「今日 は いい」', '今日はいい'), ('plain', 'plain')) v(text, clean)",
    "h14_clean_ja_line": "select * from (values ('（男）だめだ', 'だめだ'), ('（笑い声）', ''), ('{\\an8}＜上＞', '上'), ('普通の行', '普通の行')) v(text, clean)",
    "m1_splice": _sql("select file_id, pos, cast(round(least(d, 36000 - have) * 1000) as bigint) as take_ms from (select *, coalesce(sum(d) over (partition by file_id order by s, pos rows between unbounded preceding and 1 preceding), 0) as have from (select *, e - s as d from spans)) where have < 36000"),
    "m2_forced": _sql("select file_id, 'en' as lang, cast(round(sum(e - s) * 1000) as bigint) as speech_ms from spans group by file_id"),
    "m3_text_rows": _sql("select file_id, min(a) as a, max(z) as z from (select *, sum(o) over (partition by file_id order by a) as run from (select *, case when a - lag(z) over (partition by file_id order by a) < 0.45 * max(z - a) over (partition by file_id) then 0 else 1 end as o from (select file_id, min(r) as a, max(r) + 1 as z from (select *, sum(o) over (partition by file_id order by r) as run from (select *, case when r - lag(r) over (partition by file_id order by r) <= 1 then 0 else 1 end as o from (select distinct file_id, cast(floor(s / 3600) as bigint) as r from spans where conf >= 0.5))) group by file_id, run))) group by file_id, run"),
}
