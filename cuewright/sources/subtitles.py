"""Readers of subtitle texts: SRT and ASS scripts, glossaries, logs and PGS streams. Whole files are rows (path, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import timefmt as tf
from ..operators import intervals as iv
from ..operators import sequence as sq

# Endings of video files.
VIDEO = ("mkv", "mp4", "avi", "mov", "m4v", "webm", "ts", "wmv", "flv", "mpg", "mpeg")


def find_files(spark: SparkSession, path: str, endings: tuple[str, ...] = VIDEO, recursive: bool = True) -> DataFrame:
    """path, length, modificationTime of the files with an ending of the list; their content is not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    return files.select("path", "length", "modificationTime").filter(F.lower(F.element_at(F.split("path", r"\."), -1)).isin(*endings)).orderBy("path")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """path and text of whole files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


# Fixed value: the time line of a block.
_TIME = r"(\d+):(\d+):(\d+)[,.](\d+)\s*-->\s*(\d+):(\d+):(\d+)[,.](\d+)"


def parse_srt(files: DataFrame) -> DataFrame:
    """path, n, s, e, text: blocks parted by blank lines, the first line with an arrow being the time; tags go, and the
    fraction counts as thousandths whatever its digits. Blocks without a valid time give no row."""
    text = F.regexp_replace(F.regexp_replace("text", "^\ufeff", ""), r"\r\n|\r", "\n")
    blocks = files.select("path", F.posexplode(F.split(text, r"\n[ \t]*(?:\n[ \t]*)+")).alias("n", "block"))
    rows = F.filter(F.split("block", "\n"), lambda x: F.trim(x) != "")
    at = F.array_position(F.transform(rows, lambda x: x.contains("-->")), True)
    b = blocks.withColumn("rows", rows).withColumn("at", at.cast("int")).filter("at > 0").withColumn("time", F.get("rows", F.col("at") - 1)).filter(F.col("time").rlike(_TIME))
    g = lambda i: F.regexp_extract("time", _TIME, i).cast("long")
    sec = lambda i: g(i) * 3600 + g(i + 1) * 60 + g(i + 2) + g(i + 3) / 1000.0
    body = F.array_join(F.slice("rows", F.col("at") + 1, F.size("rows")), "\n")
    return b.select("path", "n", sec(1).alias("s"), sec(5).alias("e"), F.regexp_replace(body, "<[^>]+>", "").alias("text"))


def track_cues(srt: DataFrame, lang: str = "ja", sdh: bool = False) -> DataFrame:
    """Cleaned cues of a parsed track: path, idx, s, e, text; display lines join as the language writes."""
    body = tx.clean_sdh(F.col("text")) if sdh else tx.clean_captions(F.col("text"))
    join = "" if lang in ("ja", "zh", "yue", "th", "km", "lo", "my") else " "
    parts = F.filter(F.transform(F.split(body, "\n"), lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"\{[^}]*\}", ""), "[＜＞]", ""))), lambda x: x != "")
    c = srt.withColumn("text", F.trim(F.array_join(parts, join))).filter("text != '' and e > s")
    return c.withColumn("idx", F.row_number().over(Window.partitionBy("path").orderBy("n")) - 1).select("path", "idx", "s", "e", "text")


# Fixed value: styles that hold no dialogue, by name.
_SKIP_STYLE = r"(?i)romaji|roman|kanji|karaoke|\bkara\b|sign|title|logo|credit|staff|typeset|note|lyric"


def parse_ass(files: DataFrame) -> DataFrame:
    """path, s, e, text of the dialogue of ASS scripts: styles by name and effects out, positioned lines only where no plain
    line is on screen, override tags stripped, repeated fragments merged."""
    raw = files.select("path", F.posexplode(F.split("text", r"\r\n|\n|\r")).alias("n", "line")).withColumn("line", F.regexp_replace("line", "^[\ufeff\r ]+|[\r ]+$", "")).filter("line != '' and line not like ';%'")
    w = Window.partitionBy("path").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    section = F.when(F.col("line").rlike(r"^\[.*\]$"), F.lower(F.trim(F.regexp_replace("line", r"^\[|\]$", ""))))
    raw = raw.withColumn("section", F.last(section, True).over(w))
    key, rest = F.lower(F.trim(F.substring_index("line", ":", 1))), F.expr("substr(line, instr(line, ':') + 1)")
    raw = raw.withColumn("key", key).withColumn("rest", rest)
    form = F.last(F.when(F.col("key") == "format", F.transform(F.split("rest", ","), lambda x: F.lower(F.trim(x)))), True).over(Window.partitionBy("path", "section").orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    raw = raw.withColumn("form", form).filter("form is not null")
    record = raw.withColumn("m", F.map_from_arrays("form", F.transform(F.sequence(F.lit(0), F.size("form") - 1), lambda i: F.coalesce(F.get(F.split("rest", ",", -1), i), F.lit("")))))
    # The last field may hold commas: all from its place on.
    last = F.array_join(F.slice(F.split("rest", ",", -1), F.size("form"), F.size(F.split("rest", ",", -1))), ",")
    styles = record.filter("section like 'v4%styles' and key = 'style'").select("path", F.trim(F.col("m")["name"]).alias("style"), F.trim(F.col("m")["alignment"]).alias("alignment"), (F.col("section") == "v4 styles").alias("old"))
    ev = record.filter("section = 'events' and key = 'dialogue'").select("path", "n", tf.ass_seconds(F.col("m")["start"]).alias("s"), tf.ass_seconds(F.col("m")["end"]).alias("e"), F.regexp_replace(F.trim(F.coalesce(F.col("m")["style"], F.lit(""))), r"^\*+", "").alias("style"), F.trim(F.coalesce(F.col("m")["effect"], F.lit(""))).alias("effect"), last.alias("body"))
    ev = ev.filter((F.col("effect") == "") & ~F.col("style").rlike(_SKIP_STYLE) & (F.col("e") > F.col("s"))).join(styles, ["path", "style"], "left")
    high = F.when(F.coalesce("old", F.lit(False)), F.col("alignment").isin("5", "6", "7")).otherwise(F.col("alignment").isin("7", "8", "9"))
    top = F.col("body").rlike(r"\\an[4-9]\b|\\pos\(|\\move\(") | F.coalesce(high, F.lit(False)) | tx.decorated(F.col("body"))
    clean = F.replace(F.regexp_replace(F.regexp_replace("body", r"\{[^}]*\}", ""), r"\\[Nn]", "\n"), F.lit("\\h"), F.lit(" "))
    clean = F.trim(F.regexp_replace(F.array_join(F.transform(F.split(clean, "\n"), lambda x: F.trim(F.regexp_replace(x, "[ \t]+", " "))), "\n"), "\n{2,}", "\n"))
    ev = ev.select("path", F.col("n").alias("pos"), "s", "e", clean.alias("text"), top.alias("top")).filter("text != ''")
    hidden = iv.interval_join(ev.filter("top"), ev.filter("not top"), ["path"], cell=60.0).select("l.path", "l.pos").distinct()
    kept = ev.join(hidden, ["path", "pos"], "left_anti")
    runs = sq.islands(kept, ["path"], ["s", "e", "pos"], lambda w: (F.col("text") != F.lag("text").over(w)) | (F.col("s") > F.lag("e").over(w) + 0.05))
    return runs.groupBy("path", "run").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.first("text").alias("text")).drop("run")


def parse_glossary(files: DataFrame) -> DataFrame:
    """path, term, rendering: lines "term<tab>rendering" or "term=rendering"; # comments out, the last of a term wins."""
    l = files.select("path", F.posexplode(F.split("text", r"\r?\n")).alias("n", "line")).filter("trim(line) != '' and trim(line) not like '#%'")
    parts = F.when(F.col("line").contains("\t"), F.split("line", "\t", 2)).otherwise(F.split("line", "=", 2))
    l = l.withColumn("p", parts).filter("size(p) = 2").select("path", "n", F.trim(F.col("p")[0]).alias("term"), F.trim(F.col("p")[1]).alias("rendering")).filter("term != ''")
    return l.groupBy("path", "term").agg(F.max(F.struct("n", "rendering"))["rendering"].alias("rendering"))


def log_state(lines: DataFrame, name: Column, state: Column) -> DataFrame:
    """lines: n, line. The file that a line is about is the last one named; each file's last state."""
    w = Window.orderBy("n").rowsBetween(Window.unboundedPreceding, 0)  # one worker's log
    cur = lines.withColumn("file", F.last(name, True).over(w)).withColumn("state", state).filter("file is not null and state is not null")
    return cur.groupBy("file").agg(F.max(F.struct("n", "state"))["state"].alias("state"), F.count("*").alias("events"))


def ycbcr_to_rgb(y: Column, cb: Column, cr: Column) -> Column:
    """struct<r, g, b> in integers, BT.601 limited range."""
    c, d, e = 298 * (y - 16), cb - 128, cr - 128
    clip = lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.shiftright(x + 128, 8)))
    return F.struct(clip(c + 409 * e).alias("r"), clip(c - 100 * d - 208 * e).alias("g"), clip(c + 516 * d).alias("b"))
