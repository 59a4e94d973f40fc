"""Queries over spans: interval algebra, overlap joins, and aggregates by language and speaker. view is the reference, click
the generated side; times are reported in whole milliseconds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import intervals as iv
from ..operators import sequence as sq
from ..tables import SPANS, spans

KEY = ["file_id"]


def ms(c: Column | str) -> Column:
    return F.round((F.col(c) if isinstance(c, str) else c) * 1000).cast("long")


def kind(spark: SparkSession, sf: str, lang: str) -> DataFrame:
    return spans(spark, sf).filter(F.col("lang") == lang)


def merged(spark: SparkSession, sf: str, lang: str) -> DataFrame:
    return iv.union(kind(spark, sf, lang), KEY).withColumn("pos", ms("s"))


def e1_union(spark, sf):
    return iv.union(spans(spark, sf), KEY).select("file_id", ms("s").alias("start_ms"), ms("e").alias("end_ms"))


def e2_gap_merge(spark, sf):
    return iv.union(spans(spark, sf), KEY, gap=600.0).select("file_id", ms("s").alias("start_ms"), ms("e").alias("end_ms"))


def e3_intersect(spark, sf):
    return iv.intersect(merged(spark, sf, "view"), merged(spark, sf, "click"), KEY).select("file_id", ms("s").alias("start_ms"), ms("e").alias("end_ms"))


def e3_overlap(spark, sf):
    met = iv.intersect(merged(spark, sf, "view"), merged(spark, sf, "click"), KEY)
    return met.groupBy("file_id").agg(ms(F.sum(F.col("e") - F.col("s"))).alias("overlap_ms"))


def e3_minus(spark, sf):
    return iv.minus(merged(spark, sf, "view"), merged(spark, sf, "click"), KEY).select("file_id", ms("s").alias("start_ms"), ms("e").alias("end_ms"))


def _matched(spark, sf, more_than=0.2):
    return iv.argmax_overlap(kind(spark, sf, "view"), kind(spark, sf, "click"), KEY, ["file_id", "pos"], more_than)


def c1_match_cues(spark, sf):
    return _matched(spark, sf).select("l.file_id", F.col("l.pos").alias("ref_pos"), F.col("r.pos").alias("hyp_pos"), ms("ov").alias("overlap_ms"))


def c2_align_reference(spark, sf):
    met = iv.argmax_overlap(kind(spark, sf, "click"), kind(spark, sf, "view"), KEY, ["file_id", "pos"]).select("l.pos", F.concat(F.lit("v"), "r.pos").alias("ref"))
    return kind(spark, sf, "click").join(met, "pos", "left").select("file_id", "pos", F.coalesce("ref", F.lit("")).alias("ref"))


def c3_pairing(spark, sf):
    ref = kind(spark, sf, "view")
    pairs = _matched(spark, sf, 0.0).select("l.pos", "ov")
    return ref.join(pairs, "pos", "left").groupBy("file_id").agg(F.count("ov").alias("paired"), F.count_if(F.col("ov").isNull()).alias("unmatched"))


def c4_stage_labels(spark, sf):
    """A cue takes the turn of greatest overlap if that is 0.3 s or 40 % of the cue, whichever is less."""
    need = F.least(F.lit(0.3), 0.4 * F.greatest(F.lit(0.1), F.col("l.e") - F.col("l.s")))
    best = iv.argmax_overlap(kind(spark, sf, "view"), kind(spark, sf, "click"), KEY, ["file_id", "pos"], at_least=need).select("l.pos", F.col("r.speaker").alias("label"))
    return kind(spark, sf, "view").join(best, "pos", "left").select("file_id", "pos", F.coalesce("label", F.lit("")).alias("label"))


def label_words(words: DataFrame, turns: DataFrame, keys, least: float = 0.6, reach: float = 0.35) -> DataFrame:
    """words with label: the speaker whose turns cover a word by ``least`` of its length and twice the runner-up; a word under
    no turn takes the nearest one within reach; else empty. verdict: labelled, ambiguous, near or none."""
    met = iv.interval_join(words, turns, keys)
    length = F.greatest(F.col("l.e") - F.col("l.s"), F.lit(0.02))
    share = met.groupBy(*[F.col(f"l.{k}").alias(k) for k in [*keys, "pos"]], F.col("r.speaker").alias("who")).agg(F.sum(F.col("ov") / length).alias("share"))
    ranked = share.groupBy(*keys, "pos").agg(F.sort_array(F.collect_list(F.struct(-F.col("share"), "who"))).alias("x"))
    first, second = -F.col("x")[0]["col1"], F.coalesce(-F.get("x", F.lit(1))["col1"], F.lit(0.0))
    won = (first >= least) & (first >= 2 * second)
    covered = ranked.select(*keys, "pos", F.when(won, F.col("x")[0]["who"]).otherwise("").alias("label"), F.when(won, "labelled").otherwise("ambiguous").alias("verdict"))
    bare = words.join(covered, [*keys, "pos"], "left_anti")
    close = iv.argmax_overlap(bare.withColumn("s", F.col("s") - reach).withColumn("e", F.col("e") + reach), turns, keys, [*keys, "pos"], more_than=-1e-9)
    close = close.select(*[f"l.{k}" for k in [*keys, "pos"]], F.col("r.speaker").alias("label"), F.lit("near").alias("verdict"))
    out = words.join(covered.unionByName(close), [*keys, "pos"], "left")
    return out.withColumn("label", F.coalesce("label", F.lit(""))).withColumn("verdict", F.coalesce("verdict", F.lit("none")))


def c5_label_words(spark, sf):
    return label_words(kind(spark, sf, "view"), kind(spark, sf, "click"), KEY).filter("verdict in ('labelled', 'ambiguous')").select("file_id", "pos", "label", "verdict")


def c7_evidence_for(spark, sf):
    met = iv.interval_join(kind(spark, sf, "view"), kind(spark, sf, "click"), KEY, 0.2)
    text = F.array_join(F.transform(F.array_sort(F.collect_list("r.pos")), lambda x: F.concat(F.lit("line "), x)), "\n")
    return met.groupBy(F.col("l.file_id").alias("file_id"), F.col("l.pos").alias("pos")).agg(F.left(text, F.lit(1200)).alias("evidence"))


def c8_cross_evidence(spark, sf):
    met = iv.interval_join(kind(spark, sf, "view"), spans(spark, sf).filter("lang != 'view'"), KEY, 0.25)
    text = F.array_join(F.transform(F.array_sort(F.collect_list("r.pos")), lambda x: x.cast("string")), " ")
    return met.groupBy(F.col("l.file_id").alias("file_id"), F.col("l.pos").alias("pos"), F.col("r.lang").alias("lang")).agg(F.left(text, F.lit(200)).alias("evidence"))


def c9_speech_ratio(spark, sf):
    c = iv.covered(kind(spark, sf, "view"), merged(spark, sf, "click"), KEY, ["file_id", "pos"])
    return c.select("file_id", "pos", F.round(iv.ratio(F.col("sec"), F.col("s"), F.col("e")), 4).alias("ratio"))


def c10_speech_in(spark, sf):
    return iv.covered(kind(spark, sf, "view"), spans(spark, sf).filter("lang != 'view'"), KEY, ["file_id", "pos"]).select("file_id", "pos", ms("sec").alias("speech_ms"))


def c11_cover_language(spark, sf):
    met = iv.interval_join(kind(spark, sf, "view"), spans(spark, sf).filter("lang != 'view'"), KEY)
    by = met.groupBy(F.col("l.file_id").alias("file_id"), F.col("l.pos").alias("pos"), F.col("r.lang").alias("lang")).agg(F.sum("ov").alias("sec"))
    best = by.groupBy("file_id", "pos").agg(F.min(F.struct(-ms("sec"), "lang"))["lang"].alias("lang"))
    return kind(spark, sf, "view").select("file_id", "pos").join(best, ["file_id", "pos"], "left").select("file_id", "pos", F.coalesce("lang", F.lit("view")).alias("lang"))


def c12_chunk_words(spark, sf):
    """Words by start; a word at a border of two chunks is in both."""
    words = kind(spark, sf, "click").withColumn("e", F.col("s"))
    wide = kind(spark, sf, "view").withColumn("s", F.col("s") - 0.01).withColumn("e", F.col("e") + 0.01)
    return iv.interval_join(wide, words, KEY, -1e-9).select("l.file_id", F.col("l.pos").alias("chunk"), F.col("r.pos").alias("word"))


def c13_retry_thin(spark, sf):
    """Words inside chunks (views) of under 0.001 words a second go; the other engine's (purchases) come in their place."""
    chunks, words, other = kind(spark, sf, "view"), kind(spark, sf, "click").withColumn("e", F.col("s")), kind(spark, sf, "purchase").withColumn("e", F.col("s"))
    inside = iv.interval_join(chunks, words, KEY, -1e-9)
    n = inside.groupBy(F.col("l.pos").alias("pos")).agg(F.count("*").alias("n"))
    thin = chunks.join(n, "pos", "left").filter((F.col("e") - F.col("s") >= 3) & (F.coalesce("n", F.lit(0)) < 0.001 * (F.col("e") - F.col("s")))).drop("n")
    gone = iv.interval_join(thin, words, KEY, -1e-9).select(F.col("r.pos").alias("pos")).distinct()
    new = iv.interval_join(thin, other, KEY, -1e-9).select(F.col("r.file_id").alias("file_id"), F.col("r.pos").alias("pos"), F.lit("retry").alias("engine")).distinct()
    return words.join(gone, "pos", "left_anti").select("file_id", "pos", F.lit("first").alias("engine")).unionByName(new)


def c14_positioned_anti(spark, sf):
    met = iv.interval_join(kind(spark, sf, "view"), spans(spark, sf).filter("lang != 'view'"), KEY).select(F.col("l.pos").alias("pos")).distinct()
    return kind(spark, sf, "view").join(met, "pos", "left_anti").select("file_id", "pos")


def _bins(df, size=3600.0):
    return df.withColumn("bin", F.floor((F.col("s") + F.col("e")) / 2 / size))


def c15_bins(spark, sf):
    r, h = (_bins(kind(spark, sf, x)).groupBy("file_id", "bin").agg(F.count("*").alias(n)) for x, n in (("view", "refs"), ("click", "hyps")))
    return r.join(h, ["file_id", "bin"]).select("file_id", "bin", "refs", "hyps")


def c16_full_outer(spark, sf):
    side = lambda x, n: kind(spark, sf, x).withColumn("minute", F.floor(F.col("s") / 3600)).groupBy("file_id", "minute").agg(F.array_join(F.transform(F.array_sort(F.collect_list("pos")), lambda p: p.cast("string")), " ").alias(n))
    j = side("view", "ref").join(side("click", "hyp"), ["file_id", "minute"], "full_outer")
    return j.select("file_id", "minute", F.coalesce("ref", F.lit("")).alias("ref"), F.coalesce("hyp", F.lit("")).alias("hyp"))


def edges(df: DataFrame) -> DataFrame:
    """file_id, side (0 start, 1 end), s = e = the edge."""
    return df.select("file_id", F.posexplode(F.array("s", "e")).alias("side", "s")).withColumn("e", F.col("s"))


def switches(ref: DataFrame, own: DataFrame, hit: float, false: float) -> DataFrame:
    """By file: reference edges, those with one of ours within ``hit`` on the same side and their latency, and our edges with no
    reference edge within ``false``."""
    r, o = edges(ref), edges(own)
    keys = ["file_id", "side"]
    found = iv.nearest(r, o, keys, [], hit).groupBy("file_id").agg(F.count("*").alias("switches"), F.count("dist").alias("detected"), F.sum("dist").alias("late"))
    wrong = iv.nearest(o, r, keys, [], false).groupBy("file_id").agg(F.count_if(F.col("dist").isNull()).alias("invented"))
    return found.join(wrong, "file_id", "full_outer")


def c19_switches(spark, sf):
    s = switches(merged(spark, sf, "view"), merged(spark, sf, "click"), 1800.0, 3600.0)
    return s.select("file_id", F.coalesce("switches", F.lit(0)).alias("switches"), F.coalesce("detected", F.lit(0)).alias("detected"), F.coalesce("invented", F.lit(0)).alias("invented"), F.coalesce(ms("late"), F.lit(0)).alias("late_ms"))


def c20_boundary(spark, sf):
    ends = lambda x: kind(spark, sf, x).withColumn("s", F.col("e"))
    near = iv.nearest(ends("click"), ends("view"), KEY, [], 1800.0)
    return near.groupBy("file_id").agg(F.count("*").alias("cues"), F.count("dist").alias("agree"))


def c22_zip(spark, sf):
    w = Window.partitionBy("file_id").orderBy("pos")
    a, b = (kind(spark, sf, x).withColumn("chunk", F.row_number().over(w)).select("file_id", "chunk", F.col("pos").alias(n)) for x, n in (("view", "first_pos"), ("click", "second_pos")))
    return a.join(b, ["file_id", "chunk"])


def c26_coverage(spark, sf):
    """Seconds of clicks outside every view, and clicks without and with any."""
    c = iv.covered(kind(spark, sf, "click"), merged(spark, sf, "view"), KEY, ["file_id", "pos"])
    return c.groupBy("file_id").agg(ms(F.sum(F.col("e") - F.col("s") - F.col("sec"))).alias("outside_ms"), F.count_if(F.col("sec") == 0).alias("without"), F.count_if(F.col("sec") > 0).alias("with_any"))


def d1_language_seconds(spark, sf):
    by = spans(spark, sf).groupBy("file_id", "lang").agg(ms(F.sum(F.col("e") - F.col("s"))).alias("speech_ms"))
    top = F.row_number().over(Window.partitionBy("file_id").orderBy(F.col("speech_ms").desc(), "lang")) == 1
    return by.withColumn("dominant", top)


def d3_speakers(spark, sf):
    return spans(spark, sf).groupBy("speaker").agg(ms(F.sum(F.col("e") - F.col("s"))).alias("speech_ms"), F.count("*").alias("turns"), F.countDistinct("file_id").alias("files"))


def d4_dominant_speaker(spark, sf):
    by = spans(spark, sf).filter("speaker != ''").groupBy("file_id", "speaker").agg(F.sum(F.greatest(F.lit(0.0), F.col("e") - F.col("s")) + 0.05).alias("w"))
    return by.groupBy("file_id").agg(F.min(F.struct(-ms("w"), "speaker"))["speaker"].alias("speaker"))


def speaker_priors(windows: DataFrame, least: float = 8.0) -> DataFrame:
    """speaker, lang, weight: 0.5 for one language in 90 % of a voice's confident speech, 0.25 from 65 % on; fewer seconds or
    more mixed speech give no row."""
    by = windows.filter("speaker != '' and confident and lang is not null").groupBy("speaker", "lang").agg(F.sum("speech").alias("sec"))
    top = by.groupBy("speaker").agg(F.sum("sec").alias("total"), F.min(F.struct(-F.col("sec"), "lang")).alias("x"))
    share = -F.col("x.col1") / F.col("total")
    return top.filter(F.col("total") >= least).select("speaker", "x.lang", F.when(share >= 0.9, 0.5).when(share >= 0.65, 0.25).alias("weight")).filter("weight is not null")


def d5_speaker_priors(spark, sf):
    w = spans(spark, sf).withColumn("confident", F.col("conf") >= 0.4).withColumn("speech", F.col("e") - F.col("s")).withColumn("speaker", F.concat("file_id", F.lit(":"), "speaker", F.lit(":"), F.col("pos") % 7))
    return speaker_priors(w)


def d6_purity(spark, sf):
    by = spans(spark, sf).groupBy("file_id", "speaker", "lang").agg(F.sum(F.col("e") - F.col("s")).alias("sec"))
    top = by.groupBy("file_id", "speaker").agg(F.max("sec").alias("most"), F.sum("sec").alias("all"))
    return top.groupBy("file_id").agg(F.round(F.try_divide(F.sum("most"), F.sum("all")), 4).alias("purity"))


def decide(votes: DataFrame, keys, by: Sequence[str] = ()) -> DataFrame:
    """votes: keys, lang, weight. keys, lang, score and margin to the runner-up, both rounded half-even to two places.

    Weights are added in the order of ``by``, then by size: sums of doubles that are to tie do not depend on how rows are split."""
    told = F.array_sort(F.collect_list(F.when(F.col("weight").isNotNull(), F.struct(*by, "weight"))))
    sums = votes.filter("lang is not null").groupBy(*keys, "lang").agg(told.alias("told"))
    sums = sums.withColumn("w", F.when(F.size("told") > 0, F.aggregate("told", F.lit(0.0), lambda a, x: a + x["weight"]))).drop("told")
    ranked = sums.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(-F.col("w"), "lang"))).alias("x"))
    first, second = -F.col("x")[0]["col1"], F.coalesce(-F.get("x", F.lit(1))["col1"], F.lit(0.0))
    return ranked.select(*keys, F.col("x")[0]["lang"].alias("lang"), F.bround(first, 2).alias("score"), F.bround(first - second, 2).alias("margin"))


def d7_decide(spark, sf):
    """Votes of the hour: each span votes for its language with its confidence; confident from 1.0 with a margin of 0.4."""
    v = spans(spark, sf).select("file_id", F.floor(F.col("s") / 36000).alias("hour"), "lang", "pos", F.col("conf").alias("weight"))
    d = decide(v, ["file_id", "hour"], ["pos"])
    return d.withColumn("confident", (F.col("score") >= 1.0) & (F.col("margin") >= 0.4))


def k4_agreement(spark, sf):
    """Reference spans with their best generated span: how often the voices agree, or the voice is unknown."""
    m = _matched(spark, sf)
    return m.groupBy(F.col("l.file_id").alias("file_id")).agg(F.count("*").alias("n"), F.count_if(F.col("l.speaker") == F.col("r.speaker")).alias("agree"), F.count_if(F.col("r.conf") < 0.1).alias("absent"), F.round(100 * F.count_if(F.col("l.speaker") == F.col("r.speaker")) / F.count("*"), 1).alias("rate"))


def d11_recall(spark, sf):
    """Recall and precision by duration, and the upper median of the overlaps."""
    r, h = merged(spark, sf, "view"), merged(spark, sf, "click")
    both = iv.intersect(r, h, KEY).withColumn("d", F.col("e") - F.col("s")).groupBy("file_id").agg(F.sum("d").alias("both"), F.element_at(F.array_sort(F.collect_list(ms("d"))), F.floor(F.count("*") / 2).cast("int") + 1).alias("median_ms"))
    total = lambda df, n: df.groupBy("file_id").agg(F.sum(F.col("e") - F.col("s")).alias(n))
    j = total(r, "ref").join(total(h, "hyp"), "file_id").join(both, "file_id")
    return j.select("file_id", F.round(F.try_divide(F.col("both"), F.col("ref")), 4).alias("recall"), F.round(F.try_divide(F.col("both"), F.col("hyp")), 4).alias("precision"), "median_ms")


def d19_density(spark, sf):
    c = iv.covered(kind(spark, sf, "view"), spans(spark, sf).filter("lang != 'view'"), KEY, ["file_id", "pos"])
    return c.select("file_id", "pos", F.round(F.length(F.col("pos").cast("string")) / F.greatest(F.col("sec"), F.lit(0.1)), 4).alias("density"))


def d24_confident(spark, sf):
    return spans(spark, sf).groupBy("file_id").agg(F.count_if(F.col("conf") >= 0.4).alias("confident"), F.count_if(F.col("conf") < 0.4).alias("uncertain"))


def b13_usable_turns(spark, sf):
    """Files with at least two voices and no more than max(2, a hundredth of their turns) clusters keep their turns."""
    t = spans(spark, sf).groupBy("file_id").agg(F.countDistinct("speaker").alias("voices"), F.count("*").alias("turns"))
    ok = t.filter((F.col("voices") >= 2) & (F.col("voices") <= F.greatest(F.lit(2.0), 0.25 * F.col("turns"))))
    return spans(spark, sf).join(ok.select("file_id"), "file_id", "left_semi").select("file_id", "pos", "speaker")


def b14_ambiguity_gate(spark, sf):
    """Labels of a file are blanked if more than half of the judged words are ambiguous."""
    w = label_words(kind(spark, sf, "view"), kind(spark, sf, "click"), KEY)
    g = w.groupBy("file_id").agg(F.count_if(F.col("verdict") == "ambiguous").alias("a"), F.count_if(F.col("verdict") == "labelled").alias("b"))
    return g.select("file_id", (F.coalesce(F.try_divide(F.col("a"), F.col("a") + F.col("b")), F.lit(0.0)) > 0.5).alias("blank"))


def b19_plausible(spark, sf):
    w = Window.partitionBy("file_id").orderBy("s", "pos")
    d = F.col("e") - F.col("s")
    ok = (d >= 0.02) & (d <= 3600) & F.coalesce(F.col("s") >= F.lag("s").over(w) - 0.001, F.lit(True))
    return spans(spark, sf).withColumn("ok", ok).select("file_id", "pos", "ok")


def b22_clip(spark, sf):
    a, b = 1704067200.0 + 86400, 1704067200.0 + 3 * 86400
    return spans(spark, sf).filter((F.col("e") > a) & (F.col("s") < b)).select("file_id", "pos", ms(F.greatest("s", F.lit(a)) - a).alias("start_ms"), ms(F.least("e", F.lit(b)) - a).alias("end_ms"))


def f2_top_misses(spark, sf):
    missed = iv.minus(merged(spark, sf, "view"), merged(spark, sf, "click"), KEY)
    return missed.select("file_id", ms("s").alias("start_ms"), ms(F.col("e") - F.col("s")).alias("size_ms")).filter("size_ms > 3000").orderBy(F.col("size_ms").desc(), "file_id", "start_ms").limit(20)


def f6_top_two(spark, sf):
    w = Window.partitionBy("file_id", "speaker").orderBy((F.col("e") - F.col("s")).desc(), "pos")
    return spans(spark, sf).withColumn("place", F.row_number().over(w)).filter("place <= 2").select("file_id", "speaker", "place", "pos")


def e9_chunks(spark, sf):
    df = iv.union(spans(spark, sf), ["file_id", "lang"]).withColumn("pos", ms("s"))
    return sq.fold(df, KEY, ["s", "e", "lang"], lambda rows: sq.speech_chunks(rows, longest=7200.0, silence=600.0, shortest=1800.0, gap=3600.0), "file_id long, chunk long, s double, e double, lang string")


def e8_windows(spark, sf):
    return sq.fold(spans(spark, sf), KEY, ["s", "pos"], sq.speech_windows, "file_id long, window long, s double, e double, speech double, spans long, speaker string")


def e21_cut_at_turns(spark, sf):
    met = iv.interval_join(kind(spark, sf, "view"), kind(spark, sf, "click"), KEY)
    cuts = met.groupBy(F.col("l.pos").alias("pos")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array("r.s", "r.e"))))).alias("edges"))
    return sq.fold(kind(spark, sf, "view").join(cuts, "pos", "left"), KEY, ["s", "pos"], sq.cut_at_turns, "file_id long, pos long, piece long, s double, e double")


def resume(chunks: DataFrame, done: DataFrame, keys, within: float = 0.01) -> DataFrame:
    """chunks less those that a finished one of the same key starts with, up to ``within`` seconds: what is still to be done."""
    near = iv.nearest(chunks.withColumn("e", F.col("s")), done, keys, [*keys, "pos"], within)
    return chunks.join(near.filter("dist is not null").select(*keys, "pos"), [*keys, "pos"], "left_anti")


def i3_resume(spark, sf):
    """Spans as chunks, of which two thirds are done; half of these are off by more than may be."""
    c = spans(spark, sf).select("file_id", "pos", "s")
    done = c.filter("pos % 3 != 0").select("file_id", (F.col("s") + F.when(F.col("pos") % 2 == 0, 0.005).otherwise(0.5)).alias("s")).withColumn("e", F.col("s"))
    return resume(c, done, ["file_id"]).select("file_id", "pos")


QUERIES = {k: f for k, f in globals().items() if k[:1] in "abcdefghijk" and k[1:2].isdigit() and callable(f)}

_M = lambda a, b: f"cast(round(({a}) * 1000) as bigint) as {b}"
_MERGED = """marked as (select *, coalesce(s > max(e) over (partition by file_id, lang order by s, e, pos rows between unbounded preceding and 1 preceding), true) as opens from spans),
numbered as (select *, sum(opens::int) over (partition by file_id, lang order by s, e, pos rows unbounded preceding) as run from marked),
merged as (select file_id, lang, min(s) as s, max(e) as e from numbered group by file_id, lang, run),
a as (select * from merged where lang = 'view'), b as (select * from merged where lang = 'click'),
common as (select a.file_id, greatest(a.s, b.s) as s, least(a.e, b.e) as e from a join b on a.file_id = b.file_id and least(a.e, b.e) > greatest(a.s, b.s))"""
_AB = "v as (select * from spans where lang = 'view'), c as (select * from spans where lang = 'click'), o as (select * from spans where lang <> 'view')"
_PAIRS = "pairs as (select v.file_id, v.pos as vp, c.pos as cp, least(v.e, c.e) - greatest(v.s, c.s) as ov, v.speaker as vs, c.speaker as cs, c.conf as cc, v.s as vst, v.e as ven, c.s as cst, c.e as cen from v join c using (file_id) where least(v.e, c.e) > greatest(v.s, c.s))"
_BEST = "best as (select * from (select *, row_number() over (partition by vp order by ov desc, cst, cp) as k from pairs where ov > {t}) where k = 1)"
_MINUS = """ends as (select a.file_id, a.s as a_s, a.e as a_e, greatest(a.s, b.s) as s, least(a.e, b.e) as e from a join b on a.file_id = b.file_id and least(a.e, b.e) > greatest(a.s, b.s)
  union all select file_id, s, e, e, e from a),
missed as (select * from (select file_id, coalesce(lag(e) over (partition by file_id, a_s, a_e order by s, e), a_s) as s, s as e from ends) where e - s > 0.01)"""


def _sql(body: str, *ctes: str) -> str:
    return "with " + ",\n".join([SPANS, *ctes]) + "\n" + body


_EDGE = """ra as (select file_id, 0 as side, s as t from a union all select file_id, 1, e from a), rb as (select file_id, 0 as side, s as t from b union all select file_id, 1, e from b)"""
_LABEL = """shares as (select file_id, vp, cs, sum(ov / greatest(ven - vst, 0.02)) as share from pairs group by all),
ranked as (select *, row_number() over (partition by vp order by share desc, cs) as k, lead(share) over (partition by vp order by share desc, cs) as next from shares),
labels as (select file_id, vp as pos, case when share >= 0.6 and share >= 2 * coalesce(next, 0) then cs else '' end as label, case when share >= 0.6 and share >= 2 * coalesce(next, 0) then 'labelled' else 'ambiguous' end as verdict from ranked where k = 1)"""
SQL = {
    "e1_union": _sql(f"select file_id, {_M('min(s)', 'start_ms')}, {_M('max(e)', 'end_ms')} from n group by file_id, run",
        "m as (select *, coalesce(s > max(e) over (partition by file_id order by s, e, pos rows between unbounded preceding and 1 preceding), true) as opens from spans)",
        "n as (select *, sum(opens::int) over (partition by file_id order by s, e, pos rows unbounded preceding) as run from m)"),
    "e2_gap_merge": _sql(f"select file_id, {_M('min(s)', 'start_ms')}, {_M('max(e)', 'end_ms')} from n group by file_id, run",
        "m as (select *, coalesce(s - max(e) over (partition by file_id order by s, e, pos rows between unbounded preceding and 1 preceding) >= 600, true) as opens from spans)",
        "n as (select *, sum(opens::int) over (partition by file_id order by s, e, pos rows unbounded preceding) as run from m)"),
    "e3_intersect": _sql(f"select file_id, {_M('s', 'start_ms')}, {_M('e', 'end_ms')} from common", _MERGED),
    "e3_overlap": _sql(f"select file_id, {_M('sum(e - s)', 'overlap_ms')} from common group by file_id", _MERGED),
    "e3_minus": _sql(f"select file_id, {_M('s', 'start_ms')}, {_M('e', 'end_ms')} from missed", _MERGED, _MINUS),
    "c1_match_cues": _sql(f"select file_id, vp as ref_pos, cp as hyp_pos, {_M('ov', 'overlap_ms')} from best", _AB, _PAIRS, _BEST.format(t=0.2)),
    "c2_align_reference": _sql("select c.file_id, c.pos, coalesce('v' || vp, '') as ref from c left join x on c.pos = x.cp", _AB, _PAIRS, "x as (select * from (select *, row_number() over (partition by cp order by ov desc, vst, vp) as k from pairs) where k = 1)"),
    "c3_pairing": _sql("select v.file_id, count(ov) as paired, count(*) - count(ov) as unmatched from v left join best on v.pos = best.vp group by v.file_id", _AB, _PAIRS, _BEST.format(t=0)),
    "c4_stage_labels": _sql("select v.file_id, v.pos, coalesce(cs, '') as label from v left join x on v.pos = x.vp", _AB, _PAIRS, "x as (select * from (select *, row_number() over (partition by vp order by ov desc, cst, cp) as k from pairs where ov >= least(0.3, 0.4 * greatest(0.1, ven - vst))) where k = 1)"),
    "c5_label_words": _sql("select * from labels", _AB, _PAIRS, _LABEL),
    "c7_evidence_for": _sql("select file_id, vp as pos, left(string_agg('line ' || cp, chr(10) order by cp), 1200) as evidence from pairs where ov > 0.2 group by file_id, vp", _AB, _PAIRS),
    "c8_cross_evidence": _sql("select v.file_id, v.pos, o.lang, left(string_agg(cast(o.pos as varchar), ' ' order by o.pos), 200) as evidence from v join o using (file_id) where least(v.e, o.e) - greatest(v.s, o.s) > 0.25 group by all", _AB),
    "c9_speech_ratio": _sql("select v.file_id, v.pos, round(case when v.e <= v.s then 0 else least(1, greatest(0, coalesce(sum(case when b.s is not null then least(v.e, b.e) - greatest(v.s, b.s) end), 0) / (v.e - v.s))) end, 4) as ratio from v left join b on v.file_id = b.file_id and least(v.e, b.e) > greatest(v.s, b.s) group by v.file_id, v.pos, v.s, v.e", _AB, _MERGED),
    "c10_speech_in": _sql(f"select v.file_id, v.pos, {_M('coalesce(sum(case when o.s is not null then least(v.e, o.e) - greatest(v.s, o.s) end), 0)', 'speech_ms')} from v left join o on v.file_id = o.file_id and least(v.e, o.e) > greatest(v.s, o.s) group by v.file_id, v.pos", _AB),
    "c11_cover_language": _sql("select v.file_id, v.pos, coalesce(x.lang, 'view') as lang from v left join (select * from (select *, row_number() over (partition by pos order by sec desc, lang) as k from t) where k = 1) x using (pos)", _AB,
        "t as (select v.pos, o.lang, cast(round(sum(least(v.e, o.e) - greatest(v.s, o.s)) * 1000) as bigint) as sec from v join o using (file_id) where least(v.e, o.e) > greatest(v.s, o.s) group by all)"),
    "c12_chunk_words": _sql("select v.file_id, v.pos as chunk, c.pos as word from v join c using (file_id) where c.s >= v.s - 0.01 and c.s <= v.e + 0.01", _AB),
    "c13_retry_thin": _sql("select file_id, pos, 'first' as engine from c where pos not in (select c.pos from thin join c using (file_id) where c.s between thin.s and thin.e) union all select distinct p.file_id, p.pos, 'retry' from thin join p using (file_id) where p.s between thin.s and thin.e", _AB, "p as (select * from spans where lang = 'purchase')",
        "thin as (select v.file_id, v.pos, v.s, v.e from v left join c on v.file_id = c.file_id and c.s between v.s and v.e where v.e - v.s >= 3 group by all having count(c.pos) < 0.001 * (v.e - v.s))"),
    "c14_positioned_anti": _sql("select file_id, pos from v where not exists (select 1 from o where o.file_id = v.file_id and o.s < v.e and o.e > v.s and least(v.e, o.e) > greatest(v.s, o.s))", _AB),
    "c15_bins": _sql("select * from (select file_id, cast(floor((s + e) / 2 / 3600) as bigint) as bin, count(*) as refs from v group by all) join (select file_id, cast(floor((s + e) / 2 / 3600) as bigint) as bin, count(*) as hyps from c group by all) using (file_id, bin)", _AB),
    "c16_full_outer": _sql("select file_id, minute, coalesce(ref, '') as ref, coalesce(hyp, '') as hyp from (select file_id, cast(floor(s / 3600) as bigint) as minute, string_agg(cast(pos as varchar), ' ' order by pos) as ref from v group by all) full join (select file_id, cast(floor(s / 3600) as bigint) as minute, string_agg(cast(pos as varchar), ' ' order by pos) as hyp from c group by all) using (file_id, minute)", _AB),
    "c19_switches": _sql(f"select file_id, coalesce(switches, 0) as switches, coalesce(detected, 0) as detected, coalesce(invented, 0) as invented, coalesce({_M('late', 'x').split(' as x')[0]}, 0) as late_ms from f full join w using (file_id)", _MERGED, _EDGE,
        "f as (select file_id, count(*) as switches, count(d) as detected, sum(d) as late from (select ra.file_id, (select min(abs(rb.t - ra.t)) from rb where rb.file_id = ra.file_id and rb.side = ra.side and abs(rb.t - ra.t) <= 1800) as d from ra) group by file_id)",
        "w as (select file_id, count(*) - count(d) as invented from (select rb.file_id, (select min(abs(rb.t - ra.t)) from ra where rb.file_id = ra.file_id and rb.side = ra.side and abs(rb.t - ra.t) <= 3600) as d from rb) group by file_id)"),
    "c20_boundary": _sql("select file_id, count(*) as cues, count(d) as agree from (select c.file_id, (select min(abs(c.e - v.e)) from v where v.file_id = c.file_id and abs(c.e - v.e) <= 1800) as d from c) group by file_id", _AB),
    "c22_zip": _sql("select * from (select file_id, row_number() over (partition by file_id order by pos) as chunk, pos as first_pos from v) join (select file_id, row_number() over (partition by file_id order by pos) as chunk, pos as second_pos from c) using (file_id, chunk)", _AB),
    "c26_coverage": _sql(f"select file_id, {_M('sum(e - s - sec)', 'outside_ms')}, count(*) filter (sec = 0) as without, count(*) filter (sec > 0) as with_any from x group by file_id", _MERGED, "x as (select c.file_id, c.pos, c.s, c.e, coalesce(sum(case when a.s is not null then least(c.e, a.e) - greatest(c.s, a.s) end), 0) as sec from spans c left join a on c.file_id = a.file_id and least(c.e, a.e) > greatest(c.s, a.s) where c.lang = 'click' group by all)"),
    "d1_language_seconds": _sql("select file_id, lang, speech_ms, row_number() over (partition by file_id order by speech_ms desc, lang) = 1 as dominant from t", f"t as (select file_id, lang, {_M('sum(e - s)', 'speech_ms')} from spans group by all)"),
    "d3_speakers": _sql(f"select speaker, {_M('sum(e - s)', 'speech_ms')}, count(*) as turns, count(distinct file_id) as files from spans group by speaker"),
    "d4_dominant_speaker": _sql("select file_id, speaker from (select *, row_number() over (partition by file_id order by w desc, speaker) as k from t) where k = 1", f"t as (select file_id, speaker, {_M('sum(greatest(0, e - s) + 0.05)', 'w')} from spans group by all)"),
    "d5_speaker_priors": _sql("select speaker, lang, case when share >= 0.9 then 0.5 else 0.25 end as weight from (select *, sec / total as share from (select *, sum(sec) over (partition by speaker) as total, row_number() over (partition by speaker order by sec desc, lang) as k from t) where k = 1) where total >= 8 and share >= 0.65",
        "t as (select file_id || ':' || speaker || ':' || (pos % 7) as speaker, lang, sum(e - s) as sec from spans where conf >= 0.4 group by all)"),
    "d6_purity": _sql("select file_id, round(sum(most) / sum(al), 4) as purity from (select file_id, speaker, max(sec) as most, sum(sec) as al from (select file_id, speaker, lang, sum(e - s) as sec from spans group by all) group by all) group by file_id"),
    "d7_decide": _sql("select file_id, hour, lang, score, margin, score >= 1.0 and margin >= 0.4 as confident from (select file_id, hour, lang, round_even(w, 2) as score, round_even(w - coalesce(next, 0), 2) as margin from (select *, row_number() over (partition by file_id, hour order by w desc, lang) as k, lead(w) over (partition by file_id, hour order by w desc, lang) as next from t) where k = 1)",
        "t as (select file_id, cast(floor(s / 36000) as bigint) as hour, lang, sum(conf) as w from spans group by all)"),
    "k4_agreement": _sql("select file_id, count(*) as n, count(*) filter (vs = cs) as agree, count(*) filter (cc < 0.1) as absent, round(100.0 * count(*) filter (vs = cs) / count(*), 1) as rate from best group by file_id", _AB, _PAIRS, _BEST.format(t=0.2)),
    "d11_recall": _sql("select file_id, round(\"both\" / ref, 4) as recall, round(\"both\" / hyp, 4) as precision, median_ms from (select file_id, sum(e - s) as \"both\", list_sort(list(cast(round((e - s) * 1000) as bigint)))[cast(floor(count(*) / 2) as int) + 1] as median_ms from common group by file_id) join (select file_id, sum(e - s) as ref from a group by file_id) using (file_id) join (select file_id, sum(e - s) as hyp from b group by file_id) using (file_id)", _MERGED),
    "d19_density": _sql("select v.file_id, v.pos, round(length(cast(v.pos as varchar)) / greatest(coalesce(sum(case when o.s is not null then least(v.e, o.e) - greatest(v.s, o.s) end), 0), 0.1), 4) as density from v left join o on v.file_id = o.file_id and least(v.e, o.e) > greatest(v.s, o.s) group by v.file_id, v.pos", _AB),
    "d24_confident": _sql("select file_id, count(*) filter (conf >= 0.4) as confident, count(*) filter (conf < 0.4) as uncertain from spans group by file_id"),
    "b13_usable_turns": _sql("select file_id, pos, speaker from spans where file_id in (select file_id from spans group by file_id having count(distinct speaker) >= 2 and count(distinct speaker) <= greatest(2, 0.25 * count(*)))"),
    "b14_ambiguity_gate": _sql("select f.file_id, coalesce(x.a / (x.a + x.b), 0) > 0.5 as blank from (select distinct file_id from v) f left join (select file_id, count(*) filter (verdict = 'ambiguous') as a, count(*) filter (verdict = 'labelled') as b from labels group by file_id) x using (file_id)", _AB, _PAIRS, _LABEL),
    "b19_plausible": _sql("select file_id, pos, e - s >= 0.02 and e - s <= 3600 and coalesce(s >= lag(s) over (partition by file_id order by s, pos) - 0.001, true) as ok from spans"),
    "b22_clip": _sql(f"select file_id, pos, {_M('greatest(s, 1704153600) - 1704153600', 'start_ms')}, {_M('least(e, 1704326400) - 1704153600', 'end_ms')} from spans where e > 1704153600 and s < 1704326400"),
    "f2_top_misses": _sql(f"select * from (select file_id, {_M('s', 'start_ms')}, {_M('e - s', 'size_ms')} from missed) where size_ms > 3000 order by size_ms desc, file_id, start_ms limit 20", _MERGED, _MINUS),
    "f6_top_two": _sql("select file_id, speaker, place, pos from (select *, row_number() over (partition by file_id, speaker order by e - s desc, pos) as place from spans) where place <= 2"),
    "i3_resume": "with " + SPANS + ", d as (select file_id, s + case when pos % 2 = 0 then 0.005 else 0.5 end as s from spans where pos % 3 <> 0) select file_id, pos from spans c where not exists (select 1 from d where d.file_id = c.file_id and abs(d.s - c.s) <= 0.01)",
    "e9_chunks": "with recursive " + SPANS + ",\n" + _MERGED + """,
entire as (select *, row_number() over (partition by file_id order by s, e, lang) as r from merged),
cut as (select file_id, lang, r, k, s + k * 7200.0 as a, case when e - s > 7200 then least(e, s + k * 7200.0 + 7200.0) else e end as z from (select *, unnest(generate_series(0, case when e - s > 7200 then cast(ceil((e - s) / 7200.0) as bigint) - 1 else 0 end)) as k from entire)),
n as (select *, row_number() over (partition by file_id order by r, k) as i from cut),
walk as (select file_id, i, a as cs, z as ce, lang, 0::bigint as chunk from n where i = 1
  union all select file_id, i, case when b then a else cs end, z, case when b then nl else lang end, chunk + b::int
    from (select w.file_id, n.i, w.cs, w.lang, w.chunk, n.a, n.z, n.lang as nl, n.lang <> w.lang or n.z - w.cs > 7200 or (n.a - w.ce >= 600 and (w.ce - w.cs >= 1800 or n.a - w.ce >= 3600)) as b from walk w join n on n.file_id = w.file_id and n.i = w.i + 1)),
closed as (select file_id, chunk, min(cs) as cs, arg_max(ce, i) as ce, any_value(lang) as lang from walk group by file_id, chunk)
select file_id, chunk, greatest(0, cs - 0.25, coalesce(lag(ce) over (partition by file_id order by chunk) + 0.25, 0)) as s, ce + 0.25 as e, lang from closed""",
    "e8_windows": "with recursive " + SPANS + """,
n as (select *, row_number() over (partition by file_id order by s, pos) as i, count(*) over (partition by file_id) as total from spans),
walk as (select file_id, i, s as opens, e as stop, e - s as speech, 1::bigint as spans, 0::bigint as win from n where i = 1
  union all select n.file_id, n.i, case when b then n.s else w.opens end, n.e, case when b then 0 else w.speech end + n.e - n.s, case when b then 0 else w.spans end + 1, w.win + b::int
    from (select w.*, w.speech >= 10 or m.e - w.opens > 30 as b from walk w join n m on m.file_id = w.file_id and m.i = w.i + 1) w join n on n.file_id = w.file_id and n.i = w.i + 1),
closed as (select file_id, win, arg_max(opens, i) as s, arg_max(stop, i) as e, arg_max(speech, i) as speech, max(spans) as spans from walk group by file_id, win),
tail as (select *, win > 0 and win = max(win) over (partition by file_id) and speech < 10 / 3.0 as joins from closed)
select file_id, t.win as "window", s, case when nt.joins then nt.e else t.e end as e, t.speech + case when nt.joins then nt.speech else 0 end as speech, t.spans + case when nt.joins then nt.spans else 0 end as spans, '' as speaker
from tail t left join (select file_id, win - 1 as win, joins, e, speech, spans from tail) nt using (file_id, win) where not t.joins""",
    "e21_cut_at_turns": "with " + SPANS + """,
v as (select * from spans where lang = 'view'), c as (select * from spans where lang = 'click'),
marked as (select v.file_id, v.pos, v.s, v.e, list_sort(list_distinct(list_concat(list(c.s) filter (c.s > v.s + 0.4 and c.s < v.e - 0.4), list(c.e) filter (c.e > v.s + 0.4 and c.e < v.e - 0.4)))) as edges
  from v left join c on c.file_id = v.file_id and least(c.e, v.e) > greatest(c.s, v.s) group by all),
cut as (select *, list_reduce(list_prepend([s], list_transform(coalesce(edges, []), lambda x: [x])), lambda a, b: case when b[1] - a[len(a)] >= 0.4 then list_concat(a, b) else a end) as marks from marked)
select file_id, pos, i - 1 as piece, marks[i] as s, coalesce(marks[i + 1], e) as e from (select *, unnest(generate_series(1, len(marks))) as i from cut)""",
}
