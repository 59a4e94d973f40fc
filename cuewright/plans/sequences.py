"""Queries over ordered cues and lines: islands, fills, context windows, timing, sampling and set operators."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import protocols as pr
from ..functions import text as tx
from ..functions import timefmt as tf
from ..operators import sequence as sq
from ..tables import CUES, LINES, SPANS, cues, lines, read, spans
from .timed import ms

CUE = ["file_id"]


def _order(*by: str) -> Window:
    return sq.ordered(CUE, by or ("idx",))


def e6_identical_merge(spark, sf):
    """Consecutive spans of one type that start within half an hour of the run's end become one."""
    w = _order("s", "pos")
    same = (F.col("lang") != F.lag("lang").over(w)) | (F.col("s") > F.lag("e").over(w) + 1800)
    df = sq.islands(spans(spark, sf), CUE, ["s", "pos"], lambda _: same)
    return df.groupBy("file_id", "run").agg(F.first("lang").alias("lang"), ms(F.min("s")).alias("start_ms"), ms(F.max("e")).alias("end_ms"))


def e7_repeat_run(spark, sf):
    """At most two of a run of equal neighbours stay."""
    df = sq.islands(spans(spark, sf), CUE, ["s", "pos"], lambda w: F.col("speaker") != F.lag("speaker").over(w))
    kept = df.withColumn("k", F.row_number().over(Window.partitionBy("file_id", "run").orderBy("s", "pos"))).filter("k <= 2")
    return kept.select("file_id", "pos", (F.row_number().over(_order("s", "pos")) - 1).alias("idx"))


def smooth(df: DataFrame, strong: float = 0.6, least: int = 2, reach: int = 6, seconds: tuple[float, float] | None = None) -> DataFrame:
    """df: file_id, i, lang, confident, margin, speaker, and with ``seconds`` speech. A run stays if it has ``least`` rows or is strong
    throughout; with ``seconds`` if it has so much speech, or the second number where it is strong. Weak short runs of a minor language become the dominant one; then
    unsure rows take the nearest sure row of their voice within reach, else the nearest; ties go to the earlier. Dominance
    ties go to the language seen first."""
    w = sq.ordered(CUE, ["i"])
    sure = F.col("confident") & F.col("lang").isNotNull()
    by = df.filter(sure).groupBy("file_id", "lang").agg(F.count("*").alias("n"), F.min("i").alias("first"))
    dominant = by.groupBy("file_id").agg(F.min(F.struct(-F.col("n"), "first", "lang"))["lang"].alias("dominant"))
    df = sq.islands(df.withColumn("sure", sure).join(dominant, "file_id", "left"), CUE, ["i"], lambda w: ~(F.col("sure") & F.lag("sure").over(w) & F.col("lang").eqNullSafe(F.lag("lang").over(w))))
    run = Window.partitionBy("file_id", "run")
    sure_of = F.min("margin").over(run) >= strong
    keep = (F.count("*").over(run) >= least) | sure_of
    if seconds:
        have = F.sum("speech").over(run)
        keep = (have >= seconds[0]) | sure_of & (have >= seconds[1])
    df = df.withColumn("new", F.when(~F.col("sure"), None).when((F.col("lang") != F.col("dominant")) & ~keep, F.col("dominant")).otherwise(F.col("lang")))
    anchor = F.when(F.col("sure"), F.struct("i", "new"))

    def near(part: Window) -> tuple[Column, Column]:
        a, b = F.last(anchor, True).over(part.rowsBetween(Window.unboundedPreceding, 0)), F.first(anchor, True).over(part.rowsBetween(0, Window.unboundedFollowing))
        back, ahead = F.col("i") - a["i"], b["i"] - F.col("i")
        first = b.isNull() | (a.isNotNull() & (back <= ahead))
        return F.when(first, a["new"]).otherwise(b["new"]), F.when(first, back).otherwise(ahead)

    voice = Window.partitionBy("file_id", "speaker").orderBy("i")
    own, far = near(voice)
    any_, _ = near(w)
    df = df.withColumn("own", F.when((F.col("speaker") != "") & (far <= reach), own)).withColumn("any", any_)
    return df.select("file_id", "i", F.when(F.col("sure"), F.col("new")).otherwise(F.coalesce("own", "any")).alias("lang"))


def e11_smooth(spark, sf):
    df = spans(spark, sf).withColumn("i", F.row_number().over(_order("s", "pos"))).withColumn("confident", F.col("conf") >= 0.4).withColumn("margin", F.col("conf"))
    return smooth(df)


def e12_refine(spark, sf):
    """Where a file's evidence turns from views to clicks."""
    df = spans(spark, sf).withColumn("pa", F.when(F.col("lang") == "view", F.floor(F.col("conf") * 100)).otherwise(0.0)).withColumn("pb", F.when(F.col("lang") == "click", F.floor(F.col("conf") * 100)).otherwise(0.0))
    w = _order("s", "pos")
    n = df.withColumn("i", F.row_number().over(w)).withColumn("a", F.sum("pa").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("b", F.coalesce(F.sum("pb").over(w.rowsBetween(1, Window.unboundedFollowing)), F.lit(0.0)))
    start = df.groupBy("file_id").agg(F.lit(0).alias("i"), F.sum("pb").alias("score"))
    every = n.select("file_id", "i", (F.col("a") + F.col("b")).alias("score")).unionByName(start)
    return every.groupBy("file_id").agg(F.min(F.struct(-F.col("score"), "i")).alias("x")).select("file_id", F.col("x.i").alias("split"), (-F.col("x.col1")).cast("long").alias("score"))


def e13_fill(spark, sf):
    df = spans(spark, sf).withColumn("known", F.when(F.col("conf") >= 0.4, F.col("lang")))
    return df.select("file_id", "pos", sq.fill(F.col("known"), _order("s", "pos")).alias("lang"))


def context_windows(df: DataFrame, size: int = 20, before: int = 8, after: int = 3) -> DataFrame:
    """df: file_id, idx, lang, src, tgt. Windows of up to ``size`` cues, which end where the language changes: file_id, win, lang, n,
    before (source and translation of those of the ``before`` cues ahead that have one), after (the next ``after`` sources)."""
    w = _order("idx")
    runs = sq.islands(df, CUE, ["idx"], lambda w: ~F.col("lang").eqNullSafe(F.lag("lang").over(w)))
    part = F.floor((F.row_number().over(Window.partitionBy("file_id", "run").orderBy("idx")) - 1) / size)
    ahead = F.filter(F.collect_list(F.struct("src", "tgt")).over(w.rowsBetween(-before, -1)), lambda x: F.coalesce(x["tgt"], F.lit("")) != "")
    later = F.collect_list("src").over(w.rowsBetween(1, after))
    x = runs.withColumn("part", part).withColumn("before", ahead).withColumn("after", later)
    g = x.groupBy("file_id", "run", "part").agg(F.min("idx").alias("first"), F.first("lang").alias("lang"), F.count("*").alias("n"), F.min_by("before", "idx").alias("before"), F.max_by("after", "idx").alias("after"))
    return g.select("file_id", (F.row_number().over(_order("first")) - 1).alias("win"), "lang", "n", "before", "after")


def e14_context(spark, sf):
    """Windows of up to 20 cues of one role, with the eight lines before (those that have a translation) and the three after."""
    c = cues(spark, sf).select("file_id", "idx", F.when(F.col("idx") % 7 < 5, F.lit("a")).otherwise("b").alias("lang"), "src", F.when(F.col("idx") % 4 != 0, F.col("src")).alias("tgt"))
    x = context_windows(c, 4)
    return x.select("file_id", "win", "lang", "n", F.array_join(F.transform("before", lambda b: F.md5(b["tgt"])), "|").alias("before"), F.array_join(F.transform("after", F.md5), "|").alias("after"))


def e14_windows(spark, sf):
    """Translation windows of all cues with whole lines; the language is that of the function words."""
    c = cues(spark, sf).withColumn("lang", tx.text_language(F.col("src"))["lang"]).select("file_id", "idx", "lang", "src")
    return context_windows(pr.apply_model(c, pr.REGISTRY["translator"], "file_id long, idx long, lang string, src string, tgt string"))


def e15_extend(spark, sf):
    """Ends drawn out to a second or the reading speed, to 7 s at most and clear of the next start."""
    nxt = F.lead("s").over(_order("idx"))
    need = F.greatest(F.lit(1.0), F.length("src") / 21.0)
    e = F.when(F.col("e") - F.col("s") < need, F.least(F.coalesce(nxt, F.lit(1e12)) - 0.083, F.col("s") + need)).otherwise(F.col("e"))
    e = F.when(e - F.col("s") > 7, F.col("s") + 7).otherwise(e)
    return cues(spark, sf).select("file_id", "idx", ms(F.when(e <= F.col("s"), F.col("s") + 0.5).otherwise(e)).alias("end_ms"))


def characters(cue: DataFrame) -> DataFrame:
    """cue: file_id, idx, s, e, src. Every character of every cue with its time."""
    x = cue.withColumn("n", F.length("src")).select("file_id", "idx", "s", "e", "n", F.posexplode(F.split("src", "")).alias("k", "ch")).filter("ch != ''")
    return x.select("file_id", "idx", "k", "ch", ms(F.col("s") + (F.col("e") - F.col("s")) * F.col("k") / F.col("n")).alias("start_ms"))


def e19_characters(spark, sf):
    return characters(cues(spark, sf))


def e22_changes(spark, sf):
    w = _order("s", "pos")
    d = spans(spark, sf).withColumn("voice", F.col("speaker") != F.lag("speaker").over(w)).withColumn("tongue", F.col("lang") != F.lag("lang").over(w))
    return d.groupBy("file_id").agg(F.count_if("voice").alias("speaker_changes"), F.count_if("tongue").alias("language_changes"))


def _gather(df: DataFrame, b: Column, text: str = "src") -> DataFrame:
    rows = df.withColumn("bin", b.cast("long")).groupBy("file_id", "bin").agg(F.array_sort(F.collect_list(F.struct("idx", F.length(text).alias("n")))).alias("x"))
    return rows.select("file_id", "bin", F.array_join(F.transform("x", lambda r: r["n"].cast("string")), " ").alias("lengths"))


def e23_bins(spark, sf):
    return _gather(cues(spark, sf), F.floor((F.col("s") + F.col("e")) / 2 / 60))


def e24_minutes(spark, sf):
    return _gather(cues(spark, sf), F.floor(F.col("s") / 60))


def e25_stretches(spark, sf):
    """Stretches of unsure spans under 20 minutes apart."""
    df = sq.islands(spans(spark, sf).filter("conf < 0.3"), CUE, ["s", "pos"], lambda w: F.col("s") - F.lag("e").over(w) >= 1200)
    return df.groupBy("file_id", "run").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s", "pos"))), lambda x: x["pos"].cast("string")), " ").alias("members")).drop("run")


def words(spark: SparkSession, sf: str) -> DataFrame:
    """All words of each cue with linear times; lo and hi are the cue's bounds."""
    c = cues(spark, sf).select("file_id", "s", "e", "idx", "speaker", F.filter(F.split("src", r"\s+"), lambda x: x != "").alias("w"))
    x = c.select("file_id", "idx", "s", "e", "speaker", F.size("w").alias("n"), F.posexplode("w").alias("k", "text"))
    d = (F.col("e") - F.col("s")) / F.col("n")
    return x.select("file_id", (F.col("idx") * 1_000_000 + F.col("k")).alias("pos"), (F.col("s") + d * F.col("k")).alias("s"), (F.col("s") + d * (F.col("k") + 1)).alias("e"), "text", F.lit("en").alias("lang"), "speaker", F.col("s").alias("lo"), F.col("e").alias("hi"))


def e4_build_cues(spark, sf):
    return sq.fold(words(spark, sf), CUE, ["pos"], sq.words_to_cues, "file_id long, idx long, s double, e double, text string, lang string, speaker string")


def e5_timing(spark, sf):
    return sq.fold(cues(spark, sf).select("file_id", "idx", "s", "e"), CUE, ["idx"], sq.normal_timing, "file_id long, idx long, s double, e double")


def e16_push(spark, sf):
    return sq.fold(spans(spark, sf).select("file_id", "pos", "s", "e"), CUE, ["s", "pos"], sq.pushed_starts, "file_id long, pos long, s double, e double")


def e17_sentences(spark, sf):
    """Sentences of a cue share its time by their lengths."""
    c = cues(spark, sf).select("file_id", "idx", "s", "e", F.filter(F.transform(F.split("src", r"[.\n]"), lambda x: F.trim(x)), lambda x: x != "").alias("parts"))
    total = F.aggregate("parts", F.lit(0), lambda a, x: a + F.length(x))
    x = c.withColumn("total", total).select("*", F.posexplode("parts").alias("part", "text"))
    gaps = (F.lit(Decimal("0.083")) * (F.size("parts") - 1)).cast("double")  # exact, as a product of decimals is in SQL
    share = F.greatest(F.lit(0.3), (F.col("e") - F.col("s") - gaps) * F.length("text") / F.col("total"))
    w = Window.partitionBy("file_id", "idx").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("d", share)
    return x.select("file_id", "idx", "part", ms(F.col("s") + F.coalesce(F.sum(F.col("d") + 0.083).over(w), F.lit(0.0))).alias("start_ms"), ms("d").alias("length_ms"))


def e18_repair(spark, sf):
    """Words of each cue, every seventh of which has lost its length, put right within the cue."""
    bad = words(spark, sf).withColumn("e", F.when(F.col("pos") % 7 == 0, F.col("s")).otherwise(F.col("e")))
    return sq.fold(bad, [*CUE, "lo"], ["pos"], sq.spread_runs, "file_id long, pos long, s double, e double, text string, moved boolean")


def e26_chunks(spark, sf):
    return sq.fold(lines(spark, sf).select("file_id", "pos", "text"), CUE, ["pos"], lambda rows: sq.text_chunks(rows, 500), "file_id long, chunk long, lines long, chars long")


def d2_cues_per_role(spark, sf):
    return cues(spark, sf).groupBy("speaker").agg(F.count("*").alias("cues"), F.sum(F.length("src")).alias("chars"))


def d12_noise_floor(spark, sf):
    return spans(spark, sf).groupBy("file_id").agg(F.round(F.percentile("conf", F.lit(0.05)), 6).alias("p5"), F.round(F.percentile("conf", F.lit(0.8)), 6).alias("p80"))


def d13_repeat_share(spark, sf):
    n = lines(spark, sf).filter("text != ''").groupBy("lang", "text").count()
    return n.groupBy("lang").agg(F.round(F.max("count") / F.sum("count"), 6).alias("repeat"))


CAPITALS = "[A-ZÀ-Ý][a-zà-ÿ]{2,}"


KATAKANA = "[ァ-ヴー・]{3,}"  # fixed value: runs that may be names


def candidates(df: DataFrame, key: str = "lang") -> DataFrame:
    """df: key, text. Capitalised words and runs of katakana, and how often they stand under each key."""
    found = F.concat(F.regexp_extract_all("text", F.lit(CAPITALS), 0), F.regexp_extract_all("text", F.lit(KATAKANA), 0))
    return df.select(key, F.explode(found).alias("term")).groupBy(key, "term").agg(F.count("*").alias("n"))


def d14_candidates(spark, sf):
    ja = spark.createDataFrame([("ja", "ルパンはカリオストロ・シロへ行く。ルパン。アイ")], "lang string, text string")
    return candidates(read(spark, sf, "documents").select("lang", "text").unionByName(ja))


def d15_count_in(spark, sf):
    t = F.col("text")
    return read(spark, sf, "documents").select("doc_id", *[((F.length(t) - F.length(F.replace(t, F.lit(x), F.lit("")))) / len(x)).cast("long").alias(f"n_{x}") for x in ("the", "ou", "en")])


def select_terms(c: DataFrame, key: str = "lang", most: int = 60) -> DataFrame:
    """c: key, term, n. Terms seen twice at least that are no fragment of a longer one as frequent; the ``most`` most frequent of each key."""
    o = c.select(F.col(key).alias("_key"), F.col("term").alias("longer"), F.col("n").alias("m"))
    # A fragment's first three letters are some three letters of the longer term.
    grams = o.select("_key", "longer", "m", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("longer") - 2), lambda i: F.substr(F.col("longer"), i, F.lit(3))))).alias("g"))
    met = c.filter("n >= 2").withColumn("g", F.left("term", F.lit(3))).join(grams.withColumnRenamed("g", "_g"), (F.col("g") == F.col("_g")) & (F.col(key) == F.col("_key")))
    inside = met.filter((F.col("term") != F.col("longer")) & F.col("longer").contains(F.col("term")) & (F.col("n") <= F.col("m"))).select(key, "term").distinct()
    kept = c.filter("n >= 2").join(inside, [key, "term"], "left_anti")
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.col("n").desc(), "term"))
    return kept.withColumn("place", place).filter(F.col("place") <= most).drop("place")


def d16_select_terms(spark, sf):
    return select_terms(d14_candidates(spark, sf))


def d20_same_time(spark, sf):
    """Runs of words of one start, and jumps back."""
    w = _order("pos")
    df = sq.islands(words(spark, sf).withColumn("s", F.floor(F.col("s"))), CUE, ["pos"], lambda w: F.col("s") != F.lag("s").over(w))
    runs = df.groupBy("file_id", "run").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).filter("n > 1")
    del w
    return runs.groupBy("file_id").agg(F.count("*").alias("runs"), F.max("n").alias("longest"), F.sum("chars").alias("chars"))


def d25_share_metrics(spark, sf):
    """Shares over all characters of a language's documents."""
    d = read(spark, sf, "documents").groupBy("lang").agg(F.sum(F.length("text")).alias("all"), F.sum(F.length(F.regexp_replace("text", "[^0-9]", ""))).alias("digits"), F.sum(F.length(F.regexp_replace("text", "[^#$%&*|]", ""))).alias("marks"))
    return d.select("lang", F.round(F.col("digits") / F.col("all"), 8).alias("digit_share"), F.round(F.col("marks") / F.col("all"), 8).alias("mark_share"))


def f1_stable_sort(spark, sf):
    return spans(spark, sf).select("file_id", "pos", F.row_number().over(_order("s", "e", "pos")).alias("place"))


def f3_worst(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", F.abs(F.length("text") - 1000).alias("off"))
    return d.orderBy(F.col("off").desc(), "doc_id").limit(15)


def f5_sample(spark, sf):
    """Up to five evenly spaced spans of each file; places rounded half to even."""
    df = spans(spark, sf).withColumn("i", F.row_number().over(_order("s", "pos")) - 1).withColumn("n", F.count("*").over(Window.partitionBy("file_id")))
    at = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: F.bround(k * (F.col("n") - 1) / 4).cast("int")))
    return df.filter((F.col("n") <= 5) | F.array_contains(at, F.col("i"))).select("file_id", "i", "pos")


def f7_budget(spark, sf):
    """Every third line of a document while 300 characters last."""
    w = Window.partitionBy("file_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    l = lines(spark, sf).filter("pos % 3 = 0").withColumn("used", F.sum(F.length("text") + 1).over(w))
    return l.filter("used <= 300").select("file_id", "pos", "used")


def f8_last_shown_first(spark, sf):
    last = read(spark, sf, "orders").orderBy(F.col("o_orderkey").desc()).limit(20)
    return last.select("o_orderkey", F.row_number().over(Window.orderBy("o_orderkey")).alias("place"))  # 20 rows


def f9_fifo(spark, sf):
    return read(spark, sf, "orders").filter("o_orderstatus = 'O'").orderBy("o_orderkey").limit(1).select("o_orderkey")


def _hours(spark, sf, lang):
    return spans(spark, sf).filter(F.col("lang") == lang).select("file_id", F.floor(F.col("s") / 3600).alias("hour"))


def g1_intersect(spark, sf):
    return _hours(spark, sf, "view").intersect(_hours(spark, sf, "click"))


def g2_except(spark, sf):
    return _hours(spark, sf, "view").distinct().join(_hours(spark, sf, "click"), ["file_id", "hour"], "left_anti")


def g3_union_sorted(spark, sf):
    both = spans(spark, sf).filter("lang = 'view'").unionByName(spans(spark, sf).filter("lang = 'click'"))
    return both.select("file_id", "pos", F.row_number().over(_order("s", "pos")).alias("place"))


def g4_ordered_distinct(spark, sf):
    x = spans(spark, sf).groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("s", "pos", "lang"))).alias("x"))
    return x.select("file_id", F.array_join(F.array_distinct(F.transform("x", lambda r: r["lang"])), ",").alias("langs"))


def g5_pairs(spark, sf):
    w = _order("s", "pos")
    s = spans(spark, sf).select(F.lag("lang").over(w).alias("src"), F.col("lang").alias("tgt")).filter("src is not null")
    return s.filter("src < tgt").union(s.filter("src > tgt")).distinct()


def h24_srt_time(spark, sf):
    return cues(spark, sf).select("file_id", "idx", tf.srt_time(F.col("s")).alias("start"), tf.clock(F.col("e")).alias("end_clock"))


def a17_srt(spark, sf):
    """Every conversation as one SRT text."""
    c = cues(spark, sf).withColumn("n", F.row_number().over(_order("idx")))
    block = F.concat(F.col("n").cast("string"), F.lit("\n"), tf.srt_time(F.col("s")), F.lit(" --> "), tf.srt_time(F.col("e")), F.lit("\n"), F.col("src"), F.lit("\n"))
    g = c.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("n", block.alias("t")))).alias("x"))
    return g.select("file_id", F.concat(F.array_join(F.transform("x", lambda r: r["t"]), "\n"), F.lit("\n")).alias("srt"))


def h20_join_words(spark, sf):
    return cues(spark, sf).select("file_id", "idx", F.trim(F.regexp_replace(F.array_join(F.split("src", "[\n ]"), " "), r"\s+", " ")).alias("text"))


def h21_wrap(spark, sf):
    c = cues(spark, sf).select("file_id", "idx", F.col("src").alias("t"))
    return c.select("file_id", "idx", F.coalesce(F.array_join(tx.wrap_lines(F.col("t")), "|"), F.lit("-")).alias("lines"))


QUERIES = {k: f for k, f in globals().items() if k[:1] in "abcdefgh" and k[1:2].isdigit() and callable(f)}


def _sql(body: str, *ctes: str) -> str:
    return "with " + ",\n".join([SPANS, CUES, LINES, *ctes]) + "\n" + body


def _ts(x: str) -> str:
    m = f"cast(round_even(greatest({x}, 0) * 1000, 0) as bigint)"
    return f"printf('%02d:%02d:%02d,%03d', {m} // 3600000, {m} // 60000 % 60, {m} // 1000 % 60, {m} % 1000)"


_SMOOTH = """d as (select file_id, i, lang, conf, speaker, conf >= 0.4 as sure from (select *, row_number() over (partition by file_id order by s, pos) as i from spans)),
dom as (select file_id, lang as dominant from (select file_id, lang, row_number() over (partition by file_id order by count(*) desc, min(i)) as k from d where sure group by file_id, lang) where k = 1),
r as (select *, sum(o) over (partition by file_id order by i) as run from (select d.*, dominant, case when sure and lag(sure) over w and lang is not distinct from lag(lang) over w then 0 else 1 end as o from d left join dom using (file_id) window w as (partition by file_id order by i))),
k as (select *, case when not sure then null when lang <> dominant and not (count(*) over (partition by file_id, run) >= 2 or min(conf) over (partition by file_id, run) >= 0.6) then dominant else lang end as new from r)"""
_TERMS = "c as (select lang, term, count(*) as n from (select lang, unnest(list_concat(regexp_extract_all(text, '[A-ZÀ-Ý][a-zà-ÿ]{2,}'), regexp_extract_all(text, '[ァ-ヴー・]{3,}'))) as term from (select lang, text from documents union all select 'ja', 'ルパンはカリオストロ・シロへ行く。ルパン。アイ')) group by all)"
_WALK = """numbered as (select *, row_number() over (partition by file_id order by {order}) as i, lead(s) over (partition by file_id order by {order}) as nxt from {table}),
walk as (select file_id, {key}, i, {first} from numbered where i = 1 union all select n.file_id, n.{key}, n.i, {next} from walk w join numbered n on n.file_id = w.file_id and n.i = w.i + 1)"""
_E5 = "case when {e} > {s} then {e} else {s} + 0.5 end"


def _e5(before: str, r: str) -> str:
    s = f"greatest({before} + 0.05, {r}s - 0.12)"
    e = f"least(coalesce({r}nxt - 0.05, 1e300), {r}e + 0.25)"
    e = f"case when {e} - {s} < 0.9 then least(coalesce({r}nxt - 0.05, 1e300), {s} + 0.9) else {e} end"
    return f"{s} as s, case when {e} > {s} then {e} else {s} + 0.5 end as e"


SQL = {
    "e5_timing": "with recursive " + _sql("select file_id, idx, s, e from walk", _WALK.format(order="idx", table="cues", key="idx", first=_e5("0.0", ""), next=_e5("w.e", "n."))).removeprefix("with "),
    "e16_push": "with recursive " + _sql("select file_id, pos, s, e from walk", _WALK.format(order="s, pos", table="spans", key="pos", first="s, e", next="greatest(n.s, w.e + 0.083) as s, case when n.s >= w.e + 0.083 or n.e > w.e + 0.083 then n.e else w.e + 1.083 end as e")).removeprefix("with "),
    "e26_chunks": "with recursive " + _sql("select file_id, chunk, max(n) as lines, max(c) as chars from walk group by file_id, chunk", """walk as (select file_id, pos, 0::bigint as chunk, 1::bigint as n, length(text)::bigint + 1 as c from lines where pos = 0 union all
  select l.file_id, l.pos, w.chunk + (w.c >= 500)::int, case when w.c >= 500 then 0 else w.n end + 1, case when w.c >= 500 then 0 else w.c end + length(l.text) + 1 from walk w join lines l on l.file_id = w.file_id and l.pos = w.pos + 1)""").removeprefix("with "),
    "h21_wrap": _sql("""select c.file_id, c.idx, case when length(t) <= 42 then t else coalesce(best, '-') end as lines from (select *, trim(regexp_replace(src, '\\s+', ' ', 'g')) as t from cues) c left join (
  select file_id, idx, arg_min(a || '|' || b, (abs(length(a) - length(b)) - case when regexp_matches(a, '[,.;:!?—]$') then 6 else 0 end + case when lower(w[k]) in ('the', 'a', 'an', 'to', 'of', 'and', 'or', 'in', 'on', 'at', 'for', 'with') then 8 else 0 end) * 10000 + k) as best
  from (select *, array_to_string(w[:k], ' ') as a, array_to_string(w[k + 1:], ' ') as b from (select *, unnest(generate_series(1, len(w) - 1)) as k from (select *, string_split(trim(regexp_replace(src, '\\s+', ' ', 'g')), ' ') as w from cues) where len(w) <= 84)) where length(a) <= 42 and length(b) <= 42 group by file_id, idx) x using (file_id, idx)"""),
    "e6_identical_merge": _sql("select file_id, run, min(lang) as lang, cast(round(min(s) * 1000) as bigint) as start_ms, cast(round(max(e) * 1000) as bigint) as end_ms from (select *, sum(o) over (partition by file_id order by s, pos) as run from (select *, case when lang = lag(lang) over w and s <= lag(e) over w + 1800 then 0 else 1 end as o from spans window w as (partition by file_id order by s, pos))) group by file_id, run"),
    "e7_repeat_run": _sql("select file_id, pos, row_number() over (partition by file_id order by s, pos) - 1 as idx from (select *, row_number() over (partition by file_id, run order by s, pos) as k from (select *, sum(o) over (partition by file_id order by s, pos) as run from (select *, case when speaker = lag(speaker) over (partition by file_id order by s, pos) then 0 else 1 end as o from spans))) where k <= 2"),
    "e11_smooth": _sql("select u.file_id, u.i, coalesce(u.new, (select arg_min(a.new, abs(a.i - u.i) * 100000 + a.i) from k a where a.sure and a.file_id = u.file_id and a.speaker = u.speaker and abs(a.i - u.i) <= 6), (select arg_min(a.new, abs(a.i - u.i) * 100000 + a.i) from k a where a.sure and a.file_id = u.file_id)) as lang from k u", _SMOOTH),
    "e12_refine": _sql("select file_id, split, score from (select *, row_number() over (partition by file_id order by score desc, split) as k from (select file_id, i as split, cast(sum(pa) over (partition by file_id order by i) + coalesce(sum(pb) over (partition by file_id order by i rows between 1 following and unbounded following), 0) as bigint) as score from x union all select file_id, 0, cast(sum(pb) as bigint) from x group by file_id)) where k = 1",
        "x as (select file_id, row_number() over (partition by file_id order by s, pos) as i, case when lang = 'view' then floor(conf * 100) else 0 end as pa, case when lang = 'click' then floor(conf * 100) else 0 end as pb from spans)"),
    "e13_fill": _sql("select file_id, pos, coalesce(last_value(k ignore nulls) over (partition by file_id order by s, pos rows unbounded preceding), first_value(k ignore nulls) over (partition by file_id order by s, pos rows between current row and unbounded following)) as lang from (select *, case when conf >= 0.4 then lang end as k from spans)"),
    "e14_context": _sql("""select file_id, row_number() over (partition by file_id order by min(idx)) - 1 as win, min(lang) as lang, count(*) as n, arg_min(before, idx) as before, arg_max(after, idx) as after from (
      select *, (row_number() over (partition by file_id, run order by idx) - 1) // 4 as part from (select *, sum(o) over (partition by file_id order by idx) as run from m)) group by file_id, run, part""",
        """m as (select *, case when lang = lag(lang) over w then 0 else 1 end as o, coalesce(array_to_string(list_transform(list_filter(list(tgt) over (w rows between 8 preceding and 1 preceding), lambda x: x <> ''), lambda x: md5(x)), '|'), '') as before,
      coalesce(array_to_string(list_transform(list(src) over (w rows between 1 following and 3 following), lambda x: md5(x)), '|'), '') as after from (select *, case when idx % 7 < 5 then 'a' else 'b' end as lang, case when idx % 4 <> 0 then src end as tgt from cues) window w as (partition by file_id order by idx))"""),
    "e15_extend": _sql("select file_id, idx, cast(round((case when e2 <= s then s + 0.5 else e2 end) * 1000) as bigint) as end_ms from (select *, case when e1 - s > 7 then s + 7 else e1 end as e2 from (select *, case when e - s < need then least(coalesce(nxt, 1e12) - 0.083, s + need) else e end as e1 from (select *, lead(s) over (partition by file_id order by idx) as nxt, greatest(1.0, length(src) / 21.0) as need from cues)))"),
    "e19_characters": _sql("select file_id, idx, cast(k as int) as k, src[k + 1] as ch, cast(round((s + (e - s) * k / length(src)) * 1000) as bigint) as start_ms from (select *, unnest(generate_series(0, length(src) - 1)) as k from cues)"),
    "e22_changes": _sql("select file_id, count(*) filter (v) as speaker_changes, count(*) filter (t) as language_changes from (select file_id, speaker <> lag(speaker) over w as v, lang <> lag(lang) over w as t from spans window w as (partition by file_id order by s, pos)) group by file_id"),
    "e23_bins": _sql("select file_id, cast(floor((s + e) / 2 / 60) as bigint) as bin, string_agg(cast(length(src) as varchar), ' ' order by idx) as lengths from cues group by all"),
    "e24_minutes": _sql("select file_id, cast(floor(s / 60) as bigint) as bin, string_agg(cast(length(src) as varchar), ' ' order by idx) as lengths from cues group by all"),
    "e25_stretches": _sql("select file_id, count(*) as n, string_agg(cast(pos as varchar), ' ' order by s, pos) as members from (select *, sum(o) over (partition by file_id order by s, pos) as run from (select *, case when s - lag(e) over (partition by file_id order by s, pos) < 1200 then 0 else 1 end as o from spans where conf < 0.3)) group by file_id, run"),
    "e17_sentences": _sql("select file_id, idx, cast(part as int) as part, cast(round((s + coalesce(sum(d + 0.083) over (partition by file_id, idx order by part rows between unbounded preceding and 1 preceding), 0)) * 1000) as bigint) as start_ms, cast(round(d * 1000) as bigint) as length_ms from (select *, greatest(0.3, (e - s - 0.083 * (len(parts) - 1)) * length(parts[part + 1]) / list_sum(list_transform(parts, lambda x: length(x)))) as d from (select *, unnest(generate_series(0, len(parts) - 1)) as part from (select *, list_filter(list_transform(regexp_split_to_array(src, '[.\\n]'), lambda x: trim(x, ' ')), lambda x: x <> '') as parts from cues)))"),
    "d2_cues_per_role": _sql("select speaker, count(*) as cues, cast(sum(length(src)) as bigint) as chars from cues group by speaker"),
    "d12_noise_floor": _sql("select file_id, round(quantile_cont(conf, 0.05), 6) as p5, round(quantile_cont(conf, 0.8), 6) as p80 from spans group by file_id"),
    "d13_repeat_share": _sql("select lang, round(max(n) / sum(n), 6) as repeat from (select lang, text, count(*) as n from lines where text <> '' group by all) group by lang"),
    "d14_candidates": _sql("select * from c", _TERMS),
    "d15_count_in": "select doc_id, " + ", ".join(f"cast((length(text) - length(replace(text, '{x}', ''))) // {len(x)} as bigint) as n_{x}" for x in ("the", "ou", "en")) + " from documents",
    "d16_select_terms": _sql("select lang, term, n from c where n >= 2 and not exists (select 1 from c o where o.lang = c.lang and o.term <> c.term and contains(o.term, c.term) and c.n <= o.n) qualify row_number() over (partition by lang order by n desc, term) <= 60", _TERMS),
    "d20_same_time": _sql("select file_id, count(*) as runs, max(n) as longest, cast(sum(chars) as bigint) as chars from (select file_id, run, count(*) as n, sum(length(w)) as chars from (select *, sum(o) over (partition by file_id order by pos) as run from (select *, case when t = lag(t) over (partition by file_id order by pos) then 0 else 1 end as o from x)) group by file_id, run having count(*) > 1) group by file_id",
        "x as (select file_id, idx * 1000000 + k as pos, floor(s + (e - s) / len(ws) * k) as t, ws[k + 1] as w from (select *, unnest(generate_series(0, len(ws) - 1)) as k from (select *, list_filter(regexp_split_to_array(src, '\\s+'), lambda y: y <> '') as ws from cues)))"),
    "d25_share_metrics": "select lang, round(sum(length(regexp_replace(text, '[^0-9]', '', 'g'))) / sum(length(text)), 8) as digit_share, round(sum(length(regexp_replace(text, '[^#$%&*|]', '', 'g'))) / sum(length(text)), 8) as mark_share from documents group by lang",
    "f1_stable_sort": _sql("select file_id, pos, row_number() over (partition by file_id order by s, e, pos) as place from spans"),
    "f3_worst": "select doc_id, abs(length(text) - 1000) as off from documents order by off desc, doc_id limit 15",
    "f5_sample": _sql("select file_id, i, pos from (select *, row_number() over (partition by file_id order by s, pos) - 1 as i, count(*) over (partition by file_id) as n from spans) where n <= 5 or list_contains(list_transform([0, 1, 2, 3, 4], lambda k: cast(round_even(k * (n - 1) / 4, 0) as bigint)), i)"),
    "f7_budget": _sql("select * from (select file_id, cast(pos as int) as pos, cast(sum(length(text) + 1) over (partition by file_id order by pos rows unbounded preceding) as bigint) as used from lines where pos % 3 = 0) where used <= 300"),
    "f8_last_shown_first": "select o_orderkey, row_number() over (order by o_orderkey) as place from (select o_orderkey from orders order by o_orderkey desc limit 20)",
    "f9_fifo": "select o_orderkey from orders where o_orderstatus = 'O' order by o_orderkey limit 1",
    "g1_intersect": _sql("select file_id, cast(floor(s / 3600) as bigint) as hour from spans where lang = 'view' intersect select file_id, cast(floor(s / 3600) as bigint) from spans where lang = 'click'"),
    "g2_except": _sql("select file_id, cast(floor(s / 3600) as bigint) as hour from spans where lang = 'view' except select file_id, cast(floor(s / 3600) as bigint) from spans where lang = 'click'"),
    "g3_union_sorted": _sql("select file_id, pos, row_number() over (partition by file_id order by s, pos) as place from spans where lang in ('view', 'click')"),
    "g4_ordered_distinct": _sql("select file_id, string_agg(lang, ',' order by s, pos) as langs from (select *, row_number() over (partition by file_id, lang order by s, pos) as k from spans) where k = 1 group by file_id"),
    "g5_pairs": _sql("select distinct src, tgt from (select lag(lang) over (partition by file_id order by s, pos) as src, lang as tgt from spans) where src is not null and src <> tgt"),
    "h24_srt_time": _sql(f"select file_id, idx, {_ts('s')} as start, printf('%d:%02d:%02d', cast(floor(e) as bigint) // 3600, cast(floor(e) as bigint) // 60 % 60, cast(floor(e) as bigint) % 60) as end_clock from cues"),
    "a17_srt": _sql(f"select file_id, string_agg(n || chr(10) || {_ts('s')} || ' --> ' || {_ts('e')} || chr(10) || src || chr(10), chr(10) order by n) || chr(10) as srt from (select *, row_number() over (partition by file_id order by idx) as n from cues) group by file_id"),
    "h20_join_words": _sql("select file_id, idx, trim(regexp_replace(src, '\\s+', ' ', 'g')) as text from cues"),
}
