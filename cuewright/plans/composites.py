"""Report-level queries: language identification, benches and the ways from words to cues to subtitles. Model outputs are those
of the deterministic stand-ins."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import protocols as pr
from ..functions import scoring as sc
from ..functions import text as tx
from ..functions import typesetting as ty
from ..operators import intervals as iv
from ..operators import sequence as sq
from ..sources.sinks import srt_texts
from ..tables import SPANS, cues, read, spans
from . import sequences as se
from . import texts as te
from . import timed as ti


def k1_language(spark: SparkSession, sf: str) -> DataFrame:
    """Windows of spans, a detector's vote and the spans' own, the verdict, smoothing, fill, and seconds by language."""
    w = ti.e8_windows(spark, sf).withColumn("key", F.concat_ws(":", "file_id", "window"))
    told = pr.apply_model(w, pr.REGISTRY["detector"], "file_id long, window long, s double, e double, speech double, spans long, speaker string, key string, lang string, p double")
    own = spans(spark, sf).select("file_id", "s", "e", "pos", "lang")
    met = iv.interval_join(w.withColumn("pos", F.col("window")), own, ["file_id"])
    second = met.groupBy(F.col("l.file_id").alias("file_id"), F.col("l.window").alias("window"), F.col("r.lang").alias("lang")).agg(F.sum("ov").alias("o")).groupBy("file_id", "window").agg(F.min(F.struct(-F.col("o"), "lang"))["lang"].alias("lang"))
    votes = told.select("file_id", "window", "lang", F.col("p").alias("weight")).unionByName(second.withColumn("weight", F.lit(0.7)))
    d = ti.decide(votes, ["file_id", "window"])
    rows = w.join(d, ["file_id", "window"], "left").select("file_id", F.col("window").alias("i"), "lang", ((F.col("score") >= 0.7) & (F.col("margin") >= 0.2)).alias("confident"), "margin", F.lit("").alias("speaker"))
    smooth = se.smooth(rows.fillna({"confident": False}))
    j = w.join(smooth.withColumnRenamed("i", "window"), ["file_id", "window"])
    return j.groupBy("lang").agg(F.round(F.sum("speech"), 3).alias("seconds"), F.count("*").alias("windows"))


def k2_lidbench(spark, sf):
    """Recall, precision and switches by file, and the longest misses."""
    r, s = ti.d11_recall(spark, sf), ti.c19_switches(spark, sf)
    return s.join(r, "file_id", "left")


def k3_refscore(spark, sf):
    a = te.d9_score_binned(spark, sf).withColumnRenamed("chrf", "chrf_binned").withColumnRenamed("wer", "wer_binned")
    return a.join(te.d10_score_paired(spark, sf), "file_id").filter("pairs >= 20").orderBy(F.coalesce("chrf", F.lit(0.0)).desc(), "file_id")


def ocr_scores(ref: DataFrame, hyp: DataFrame) -> DataFrame:
    """ref, hyp: file_id, pos, s, e, text. By file: reference cues with a cue read over them (cues), how many of these say the same and
    how alike they are, and the cues of each side that overlap none of the other (unmatched, unread)."""
    ident = ["file_id", "pos"]
    best = lambda a, b: iv.argmax_overlap(a, b, ["file_id"], ident, 0.0, cell=60.0)
    m = best(ref, hyp).select("l.file_id", F.col("l.text").alias("a"), F.col("r.text").alias("b"))
    x = m.select("file_id", F.coalesce(tx.norm(F.coalesce("a", F.lit(""))) == tx.norm(F.coalesce("b", F.lit(""))), F.lit(False)).alias("exact"), sc.agreement("a", "b").alias("sim"))
    scored = x.groupBy("file_id").agg(F.count("*").alias("cues"), F.count_if("exact").alias("exact"), F.avg("sim").alias("similarity"))
    bare = [d.drop("text") for d in (ref, hyp)]

    def alone(a: DataFrame, b: DataFrame, name: str) -> DataFrame:
        met = iv.interval_join(a, b, ["file_id"], 0.0, cell=60.0).select("l.file_id", "l.pos").distinct()
        return a.join(met, ident, "left_anti").groupBy("file_id").agg(F.count("*").alias(name))

    out = scored.join(alone(*bare[::-1], "unmatched"), "file_id", "full_outer").join(alone(*bare, "unread"), "file_id", "full_outer")
    return out.fillna(0, ["cues", "exact", "unmatched", "unread"])


def k5_ocrbench(spark, sf):
    """Cues matched with their reference by overlap: all, exact, similarity, and those of either side that no other overlaps."""
    return ocr_scores(*te._timed_docs(spark, sf))


def k6_bench(spark, sf):
    return ti.c20_boundary(spark, sf).join(ti.c3_pairing(spark, sf), "file_id", "full_outer")


def k7_scan(spark, sf):
    return spans(spark, sf).groupBy("lang").agg(F.countDistinct("file_id").alias("files"), F.count("*").alias("spans"), ti.ms(F.sum(F.col("e") - F.col("s"))).alias("speech_ms"))


def k8_compare(spark, sf):
    """Two transcripts of a file: ordered texts of both sides and their similarity."""
    c = cues(spark, sf)
    side = lambda who, n: c.filter(F.col("speaker") == who).groupBy("file_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "src"))), lambda x: x["src"]), " ").alias(n))
    j = side("user", "a").join(side("assistant", "b"), "file_id").select("file_id", tx.norm(F.col("a")).alias("a"), tx.norm(F.col("b")).alias("b"))
    return j.select("file_id", sc.agreement("a", "b").alias("similarity"))


def k9_why(spark, sf):
    """Provenance counts of nested stage results."""
    n = spans(spark, sf).groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("pos", "lang", "speaker", "conf"))).alias("spans"))
    return n.select("file_id", F.size("spans").alias("n"), F.size(F.array_distinct(F.transform("spans", lambda x: x["speaker"]))).alias("voices"), F.size(F.filter("spans", lambda x: x["conf"] < 0.1)).alias("unsure"))


def k10_gate_report(spark, sf):
    """What the gate does to each file: cues kept, kept though quiet, and dropped, with the share that stays."""
    g = te.gated(spark, sf)
    n = lambda *v: F.count_if(F.col("verdict").isin(*v))
    x = g.groupBy("file_id").agg(F.count("*").alias("cues"), n("kept").alias("kept"), n("quiet").alias("quiet"), n("no_speech", "made_up", "repeat").alias("dropped"))
    return x.withColumn("percent", F.round(100 * (F.col("kept") + F.col("quiet")) / F.col("cues"), 4))


def two_engines(spark, sf) -> DataFrame:
    """Cues as chunks heard by two engines: file_id, chunk, start, end, primary and secondary (words), a and b (their texts).

    The second engine says some words otherwise and is a tenth of a second late; in some chunks one of them hears nothing."""
    c = cues(spark, sf)
    w = F.filter(F.split("src", r"\s+"), lambda x: x != "")
    d = (F.col("e") - F.col("s")) / F.greatest(F.size(w), F.lit(1))
    told = lambda late, change: F.transform(w, lambda x, k: F.struct(change(x).alias("text"), (F.col("s") + d * k + late).alias("s"), (F.col("s") + d * (k + 1) + late).alias("e")))
    none = F.array().cast("array<struct<text:string,s:double,e:double>>")
    other = lambda x: F.when(F.pmod(F.xxhash64(x), F.lit(5)) == 0, F.concat(F.lit("x"), x)).otherwise(x)
    c = c.withColumn("primary", F.when(F.col("idx") % 11 == 4, none).otherwise(told(0.0, lambda x: x))).withColumn("secondary", F.when(F.col("idx") % 11 == 7, none).otherwise(told(0.1, other)))
    text = lambda x: F.array_join(F.transform(x, lambda r: r["text"]), " ")
    return c.select("file_id", F.col("idx").alias("chunk"), F.col("s").alias("start"), F.col("e").alias("end"), "primary", "secondary", text("primary").alias("a"), text("secondary").alias("b"))


def transferred(df: DataFrame, lang: str = "en") -> DataFrame:
    """df: file_id, chunk, start, end, primary, secondary, merged. file_id, chunk, pos, text, s, e of the merged texts' words."""

    def step(rows: list[dict]):
        for r in rows:
            for k, w in enumerate(sq.transfer_timing(r["merged"] or "", r["primary"], r["secondary"], r["start"], r["end"], lang)):
                yield w | {"file_id": r["file_id"], "chunk": r["chunk"], "pos": k}

    return sq.fold(df, ["file_id", "chunk"], [], step, "file_id long, chunk long, pos long, text string, s double, e double")


def e20_transfer_timing(spark, sf):
    """The second engine's text, timed by the first engine's words where they agree and its own elsewhere."""
    return transferred(two_engines(spark, sf).withColumn("merged", F.col("b")))


def merge_chunks(df: DataFrame, model=None) -> DataFrame:
    """df: as two_engines gives. The verdict on each chunk with the merged text: the first engine's where they agree or it alone
    speaks, the second's where that alone does, else the reconciling model's reply, which is dropped if it is empty or three times
    as long as both."""
    n = lambda c: F.length(tx.norm(F.col(c)))
    judged = te.decide(df)
    open_ = judged.filter("verdict = 'reconcile'").withColumn("src", F.concat_ws(" ", "a", "b"))
    reply = pr.apply_model(open_.select("file_id", "chunk", "a", "b", "src"), model or pr.REGISTRY["reconciler"], "file_id long, chunk long, a string, b string, src string, tgt string")
    good = (n("tgt") > 0) & (n("tgt") <= 3 * F.greatest(n("a"), n("b")))
    reply = reply.select("file_id", "chunk", F.when(good, tx.clean_reply(F.col("tgt"))).alias("reply"))
    out = judged.join(reply, ["file_id", "chunk"], "left")
    merged = F.when(F.col("verdict") == "second", F.col("b")).otherwise(F.coalesce("reply", "a"))
    first = F.col("verdict") != "second"
    side = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    return out.select("file_id", "chunk", "start", "end", "verdict", merged.alias("merged"), side("primary", "secondary").alias("primary"), side("secondary", "primary").alias("secondary"))


def k11_merge(spark, sf):
    """Two engines' chunks merged and timed: the words of each file, and how its chunks were decided."""
    merged = merge_chunks(two_engines(spark, sf))
    words = transferred(merged).groupBy("file_id").agg(F.count("*").alias("words"), F.round(F.sum(F.col("e") - F.col("s")), 3).alias("seconds"))
    verdicts = merged.groupBy("file_id").agg(*[F.count_if(F.col("verdict") == v).alias(v) for v in ("agree", "first", "second", "reconcile")])
    return verdicts.join(words, "file_id", "left")


def k12_words_to_cues(spark, sf):
    """Words to labelled words to cues, gate and timing."""
    w = se.words(spark, sf)
    turns = cues(spark, sf).select("file_id", F.col("idx").alias("pos"), "s", "e", "speaker")
    labelled = ti.label_words(w.drop("speaker"), turns, ["file_id"]).withColumnRenamed("label", "speaker").drop("verdict")
    built = sq.fold(labelled.select("file_id", "pos", "s", "e", "text", "lang", "speaker"), ["file_id"], ["pos"], sq.words_to_cues, "file_id long, idx long, s double, e double, text string, lang string, speaker string")
    kept = te.gate(built.withColumnRenamed("text", "src").withColumn("speech", F.lit(0.6))).filter("new_idx is not null").drop("idx").withColumn("idx", F.col("new_idx").cast("long"))
    timed = sq.fold(kept.select("file_id", "idx", "s", "e", "src", "speaker"), ["file_id"], ["idx"], sq.normal_timing, "file_id long, idx long, s double, e double, src string, speaker string")
    return timed.groupBy("file_id").agg(F.count("*").alias("cues"), F.countDistinct("speaker").alias("voices"), F.round(F.sum(F.col("e") - F.col("s")), 3).alias("seconds"))


def split_long(cue: DataFrame, width: int = 42, gap: float = 0.083, least: float = 0.3) -> DataFrame:
    """cue: file_id, idx, s, e, text. Pieces of the whole text that share the cue's time by their lengths; idx counts them anew."""
    c = cue.filter("trim(text) != ''").withColumn("parts", ty.fit_parts(F.regexp_replace("text", r"\s+", " "), F.lit(width)))
    c = c.withColumn("all", F.aggregate("parts", F.lit(0), lambda a, x: a + F.length(x))).withColumn("share", F.col("e") - F.col("s") - (F.lit(Decimal(str(gap))) * (F.size("parts") - 1)).cast("double"))
    p = c.select("file_id", "idx", "s", "share", "all", F.posexplode("parts").alias("part", "text")).withColumn("d", F.greatest(F.lit(least), F.col("share") * F.length("text") / F.col("all")))
    ahead = F.coalesce(F.sum(F.col("d") + gap).over(Window.partitionBy("file_id", "idx").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    p = p.withColumn("s", F.col("s") + ahead).withColumn("e", F.col("s") + F.col("d"))
    return p.select("file_id", F.row_number().over(Window.partitionBy("file_id").orderBy("idx", "part")).cast("long").alias("idx"), "s", "e", "text")


def typeset(cue: DataFrame, width: int = 42, cps: float = 21.0, least: float = 1.0, most: float = 7.0, gap: float = 0.083) -> DataFrame:
    """cue: file_id, idx, s, e, text. Wrapped lines, ends drawn out to the reading speed, starts pushed apart."""
    c = cue.filter("trim(text) != ''").withColumn("text", F.coalesce(F.array_join(tx.wrap_lines(F.col("text"), width), "\n"), F.trim("text")))
    nxt = F.coalesce(F.lead("s").over(Window.partitionBy("file_id").orderBy("s", "idx")), F.lit(1e12))
    need = F.greatest(F.lit(least), F.length("text") / cps)
    e = F.when(F.col("e") - F.col("s") < need, F.least(nxt - gap, F.col("s") + need)).otherwise(F.col("e"))
    e = F.least(e, F.col("s") + most)
    c = c.withColumn("e", F.when(e <= F.col("s"), F.col("s") + 0.5).otherwise(e))
    return sq.fold(c.select("file_id", "idx", "s", "e", "text"), ["file_id"], ["s", "idx"], lambda rows: sq.pushed_starts(rows, gap, least), "file_id long, idx long, s double, e double, text string")


def k13_subtitles(spark, sf):
    """Cues translated by the stand-in, split into pieces that fit two lines, typeset and written as SRT texts."""
    c = cues(spark, sf).select("file_id", "idx", "s", "e", "src")
    t = pr.apply_model(c, pr.REGISTRY["translator"], "file_id long, idx long, s double, e double, src string, tgt string")
    return srt_texts(typeset(split_long(t.withColumn("text", F.coalesce(F.nullif("tgt", F.lit("")), F.col("src"))))))


def m8_line_by_line(spark, sf):
    """Cues whose batch translation failed are tried again; what stays untranslated is flagged."""
    c = cues(spark, sf).select("file_id", "idx", "src")
    t = pr.apply_model(c, pr.REGISTRY["translator"], "file_id long, idx long, src string, tgt string").withColumn("flags", F.array().cast("array<string>"))
    return pr.line_by_line(t, pr.REGISTRY["translator"]).groupBy(F.array_contains("flags", "untranslated").alias("untranslated")).agg(F.count("*").alias("cues"))


def k14_terminology(spark, sf):
    """Terms with their counts in each language's documents and a fixed rendering where there is one."""
    terms = se.d16_select_terms(spark, sf)
    fixed = spark.createDataFrame([("Den", "D."), ("The", "T.")], "term string, rendering string")
    return terms.join(F.broadcast(fixed), "term", "left")  # two rows


def j1_detector(spark, sf):
    w = spans(spark, sf).select("pos", F.col("pos").cast("string").alias("key"))
    return pr.apply_model(w, pr.REGISTRY["detector"], "pos long, key string, lang string, p double").groupBy("lang").agg(F.count("*").alias("n"))


def j7_routing(spark, sf):
    pairs = read(spark, sf, "documents").select(F.col("lang").alias("src"), F.lit("th").alias("tgt")).distinct()
    routes = spark.createDataFrame([("*", "th", "to-thai"), ("fr", "th", "french-thai"), ("*", "*", "any")], "src string, tgt string, preset string")
    return pr.routed(pairs, routes)


def c6_split_labels(spark, sf):
    """Pieces of spans cut at turns, with the voice that covers each most."""
    pieces = ti.e21_cut_at_turns(spark, sf).withColumn("pos", F.col("pos") * 100 + F.col("piece"))
    best = iv.argmax_overlap(pieces, ti.kind(spark, sf, "click"), ["file_id"], ["file_id", "pos"]).select("l.file_id", "l.pos", F.col("r.speaker").alias("who"))
    return pieces.join(best, ["file_id", "pos"], "left").groupBy("file_id").agg(F.count("*").alias("pieces"), F.count("who").alias("voiced"))


def covered_chunks(frames: DataFrame, spans_: DataFrame, **rules) -> DataFrame:
    """frames: file_id, frame (dense from 0), level; spans_: file_id, s, e, lang. file_id, chunk, s, e, lang: the chunks of each file."""
    import numpy as np

    told = F.array_sort(F.collect_list(F.struct("s", "e", F.coalesce("lang", F.lit("")).alias("lang")))).alias("spans")
    level = F.transform(F.array_sort(F.collect_list(F.struct("frame", "level"))), lambda x: x["level"]).alias("level")
    j = frames.groupBy("file_id").agg(level).join(spans_.groupBy("file_id").agg(told), "file_id", "left")

    def step(rows: list[dict]):
        for r in rows:
            frame = rules.get("frame", 0.1)
            for c in sq.cover_chunks(np.array(r["level"]), r["spans"] or [], len(r["level"]) * frame, **rules):
                yield c | {"file_id": r["file_id"]}

    return sq.fold(j, ["file_id"], [], step, "file_id long, chunk long, s double, e double, lang string")


def e10_cover_chunks(spark, sf):
    """Each file's first day in frames of a minute (loudness by the spans that are on), covered in chunks of up to two hours."""
    s = spans(spark, sf)
    s = s.withColumn("first", F.min("s").over(Window.partitionBy("file_id"))).withColumn("s", F.col("s") - F.col("first")).withColumn("e", F.col("e") - F.col("first")).filter("s < 86400")
    on = s.select("file_id", F.explode(F.sequence(F.floor(F.col("s") / 60), F.floor(F.col("e") / 60))).alias("frame"), "conf").groupBy("file_id", "frame").agg(F.max("conf").alias("level"))
    every = s.groupBy("file_id").agg(F.floor(F.max("e") / 60).alias("last")).select("file_id", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("frame"))
    frames = every.join(on, ["file_id", "frame"], "left").withColumn("level", F.coalesce("level", F.lit(0.0)) + 0.01)
    return covered_chunks(frames, s, frame=60.0, longest=7200.0, quiet_sec=1800.0, pad=15.0)


def e17_split_long(spark, sf):
    """Cues cut into parts that fit two lines, which share the time by their characters."""
    return split_long(cues(spark, sf).withColumnRenamed("src", "text")).select("file_id", "idx", ti.ms("s").alias("start_ms"), ti.ms("e").alias("end_ms"), "text")


def s_star_rollup(spark, sf):
    """Baseline of the engine, not of timed text: revenue by flag and status with subtotals."""
    return read(spark, sf, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 0).cast("long").alias("revenue"))


def s_star_join(spark, sf):
    o = read(spark, sf, "orders").join(read(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(read(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 rows
    return o.groupBy("n_name").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 0).cast("long").alias("total"))


QUERIES = {k: f for k, f in globals().items() if (k[:1] in "cejkm" and k[1:2].isdigit() or k[:2] == "s_") and callable(f)}


def _sql(body: str) -> str:
    return "with " + SPANS + "\n" + body


SQL = {
    "k10_gate_report": te._sql("select file_id, count(*) as cues, count(*) filter (verdict = 'kept') as kept, count(*) filter (verdict = 'quiet') as quiet, count(*) filter (verdict not in ('kept', 'quiet')) as dropped, round(100 * count(*) filter (verdict in ('kept', 'quiet')) / count(*), 4) as percent from gated group by file_id", te._GATED),
    "k14_terminology": f"select t.*, rendering from ({se.SQL['d16_select_terms']}) t left join (values ('Den', 'D.'), ('The', 'T.')) f(term, rendering) using (term)",
    "c6_split_labels": f"select p.file_id, count(*) as pieces, count(who) as voiced from ({ti.SQL['e21_cut_at_turns']}) p left join lateral (with {SPANS} select arg_max(speaker, (least(c.e, p.e) - greatest(c.s, p.s))) as who from spans c where c.lang = 'click' and c.file_id = p.file_id and least(c.e, p.e) > greatest(c.s, p.s)) w on true group by p.file_id",
    "k2_lidbench": f"select * from ({ti.SQL['c19_switches']}) left join ({ti.SQL['d11_recall']}) using (file_id)",
    "k6_bench": f"select * from ({ti.SQL['c20_boundary']}) full join ({ti.SQL['c3_pairing']}) using (file_id)",
    "k7_scan": _sql("select lang, count(distinct file_id) as files, count(*) as spans, cast(round(sum(e - s) * 1000) as bigint) as speech_ms from spans group by lang"),
    "k9_why": _sql("select file_id, cast(count(*) as int) as n, cast(count(distinct speaker) as int) as voices, cast(count(*) filter (conf < 0.1) as int) as unsure from spans group by file_id"),
    "j7_routing": "select distinct lang as src, 'th' as tgt, case when lang = 'fr' then 'french-thai' else 'to-thai' end as preset from documents",
    "s_star_rollup": "select l_returnflag, l_linestatus, count(*) as n, cast(round(sum(l_extendedprice * (1 - l_discount)), 0) as bigint) as revenue from lineitem group by rollup (l_returnflag, l_linestatus)",
    "s_star_join": "select n_name, count(*) as orders, cast(round(sum(o_totalprice), 0) as bigint) as total from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by n_name",
}
