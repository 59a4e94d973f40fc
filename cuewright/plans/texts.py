"""Queries over texts: scripts, languages, cleaning, gates, formats and scores. Scripts and forms that the supplied tables do not
hold come as a literal table; its SQL is the same list."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scoring as sc
from ..functions import text as tx
from ..functions import timefmt as tf
from ..operators import intervals as iv
from ..tables import CUES, LINES, SPANS, cues, lines, read, spans

LITERAL = [
    "今日はいい天気", "สวัสดี", "你好世界", "Привет, мир", "Γειά σου", "مرحبا", "नमस्ते", "안녕하세요", "hello world", "12:30 !!", "",
    "MAN: Hello there", "(door closes)", "♪ la la ♪", "[MUSIC]", "JOHN SMITH: (LAUGHING) You wanted it?", "- tight dash", "18:30 is late",
    "he/she went", "and/or maybe", "see http://a/b", "AC/DC plays", "pisec/pisateljica", "1/2 cup", "měl/a jsem", "um, well hmm yes", "\"quoted line\"", "[S3] tagged",
    "| hate it", "l'm here", "wait\\cdots now", "The text says hello", "ああああ", "はい", "何", "て", "Hmm", "hahahahahaha", "ok ok ok ok ok ok",
    "1. first\n2) second\n3 third\nnoise\n2. again", "ご視聴ありがとうございました", "tom's the best of all and to that with this", "der und das nicht mit dem von ist",
]


def literal(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(LITERAL)), "id long, text string")


_QUOTE = lambda t: "'" + t.replace("'", "''") + "'"
LITERAL_SQL = "lit(id, text) as (values " + ", ".join(f"({i}, {_QUOTE(t)})" for i, t in enumerate(LITERAL)) + ")"
BOTH_SQL = LITERAL_SQL + ", t as (select cast(id as bigint) as id, text from lit union all select doc_id + 1000, text from documents)"


def _texts(spark, sf):
    return literal(spark).unionByName(read(spark, sf, "documents").select((F.col("doc_id") + 1000).alias("id"), "text"))


def h1_script_of(spark, sf):
    return _texts(spark, sf).select("id", tx.script_of(F.col("text")).alias("script"))


def h2_text_language(spark, sf):
    t = _texts(spark, sf)
    return t.select("id", tx.text_language(F.col("text")).alias("x")).select("id", "x.lang", "x.hits")


def h3_script_vote(spark, sf):
    return _texts(spark, sf).select("id", tx.script_vote(F.col("text")).alias("x")).select("id", "x.lang", "x.weight")


def h4_language_of_text(spark, sf):
    t = _texts(spark, sf)
    return t.select("id", tx.language_of_text(F.col("text")).alias("lang"))


NAMES = ("English", " german ", "fr", "Klingon", "xx", "unknown", "", "Mandarin", "Chinese (Simplified)", "BURMESE", "et")


def h5_code_from_name(spark, sf):
    return spark.createDataFrame([(x,) for x in NAMES], "name string").select("name", tx.code_from_name(F.col("name")).alias("code"))


def h6_collapse_loops(spark, sf):
    return _texts(spark, sf).select("id", F.length(tx.collapse_loops(F.col("text"))).alias("n"))


def h7_norm(spark, sf):
    return _texts(spark, sf).select("id", F.md5(tx.norm(F.col("text"))).alias("norm"))


def decide(df: DataFrame, least: int = 4, alike: float = 0.92) -> DataFrame:
    """df: a, b, two transcripts of a chunk. Adds verdict: agree, first or second where the other says next to nothing, or reconcile."""
    p = df.withColumn("_a", tx.norm(F.col("a"))).withColumn("_b", tx.norm(F.col("b"))).withColumn("_same", sc.agreement("_a", "_b"))
    short = lambda c: F.length(c) < least
    v = F.when(short("_a") & short("_b"), "agree").when(short("_a"), "second").when(short("_b"), "first").when(F.col("_same") >= alike, "agree").otherwise("reconcile")
    return p.withColumn("verdict", v).drop("_a", "_b", "_same")


def h9_decide(spark, sf):
    """Two transcripts agree, one has nothing to say, or they must be reconciled."""
    return decide(_texts(spark, sf).select("id", F.col("text").alias("a"), F.regexp_replace(tx.norm(F.col("text")), "the", "a").alias("b"))).select("id", "verdict")


def h8_agreement(spark, sf):
    """Each text against itself less its first four characters."""
    p = _texts(spark, sf).select("id", F.col("text").alias("a"), F.expr("substring(text, 5)").alias("b"))
    return p.select("id", sc.agreement("a", "b").alias("similarity"))


def h11_clean_ocr(spark, sf):
    return literal(spark).select("id", tx.clean_ocr(F.col("text"), "en").alias("text"))


def h12_clean_sdh(spark, sf):
    return literal(spark).select("id", tx.clean_sdh(F.col("text")).alias("text"))


def h13_clean_captions(spark, sf):
    return literal(spark).select("id", tx.clean_captions(F.col("text")).alias("text"))


def h16_clean_line(spark, sf):
    return literal(spark).select("id", tx.clean_line(F.col("text")).alias("text"))


def h17_copy_through(spark, sf):
    return literal(spark).select("id", tx.copy_through(F.col("text"), "en").alias("text"))


def h18_parse_numbered(spark, sf):
    return literal(spark).select("id", F.explode(tx.parse_numbered(F.col("text"))).alias("n", "line"))


# Lines that show registers, by language.
SPOKEN = [
    ("th", "ผมรักคุณครับ"), ("th", "หนูไม่ไปค่ะ แม่"), ("fr", "Tu viens avec vous ?"), ("fr", "Je t'aime"), ("fr", "La tulipe"), ("de", "Hast du Ihnen geschrieben?"),
    ("de", "sie kommt"), ("de", "Du"), ("es", "Tú y usted"), ("it", "Lei lo sa, tu no"), ("it", "lei lo sa"), ("ko", "안녕하세요."), ("ko", "먹었다 / 갑니다"), ("ko", "가자!"),
    ("ja", "僕は学生です。"), ("ja", "行きます / 行くぞ"), ("ja", "わたしも"), ("he", "אתה בא"), ("he", "את באה"), ("he", "ואתה"), ("vi", "Anh yêu em"), ("vi", "Mẹ ơi, con đây"), ("vi", "ANH"),
    ("cs", "Ty a vy"), ("cs", "tvůj dům"), ("pl", "Czy pan wie?"), ("pl", "twoje"), ("ru", "Ты и ваш брат"), ("ru", "тыква"), ("uk", "Твоє і ваше"), ("el", "Εσείς;"), ("el", "σου"),
    ("hu", "Maga az?"), ("hu", "téged"), ("hr", "Tvoja i vaša"), ("en", "you"), ("ja", ""),
]


def h19_register(spark, sf):
    """What lines in all languages show, by class; of the documents each line."""
    own = spark.createDataFrame([(-1 - i, la, t) for i, (la, t) in enumerate(SPOKEN)], "file_id long, lang string, text string").withColumn("pos", F.lit(0))
    t = lines(spark, sf).select("file_id", "lang", "text", "pos").unionByName(own)
    return t.select("file_id", "pos", F.explode(tx.features(F.col("text"), F.col("lang"))).alias("class", "v")).select("file_id", "pos", "class", F.array_join(F.array_sort("v"), ",").alias("shown"))


def h26_parse_time(spark, sf):
    rows = spark.createDataFrame([(x,) for x in ("1:02:03.5", "10:00", "7", "0:00:01")], "t string")
    return rows.select("t", tf.parse_time(F.col("t")).alias("sec"))


def a6_ass_seconds(spark, sf):
    rows = spark.createDataFrame([(x,) for x in ("0:00:01.50", "1:02:03:04", "bad", " 0:10:00.00 ")], "t string")
    return rows.select("t", tf.ass_seconds(F.col("t")).alias("sec"))


def h28_slug(spark, sf):
    """Slugs of up to 80 characters, and file names of up to 150 bytes, of whole texts."""
    return _texts(spark, sf).select("id", F.left(tx.slug(F.col("text")), F.lit(80)).alias("slug"), tx.safe_stem(F.col("text")).alias("stem"))


def h29_cache_key(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.left(F.sha1(F.concat_ws("|", "doc_id", "lang", "source").cast("binary")), F.lit(10)).alias("key"))


def h30_wer(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", F.col("text").alias("a"), F.regexp_replace("text", "(?i)the", "a").alias("b"))
    return d.select("doc_id", sc.wer("a", "b").alias("wer"))


def h31_chrf(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", F.col("text").alias("a"), F.expr("substring(text, 10)").alias("b"))
    return d.select("doc_id", sc.chrf_counts("a", "b").alias("c")).select("doc_id", sc.chrf(F.col("c")).alias("chrf"))


def h32_words(spark, sf):
    w = F.filter(F.split(F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}_\s]", " "), r"\s+"), lambda x: x != "")
    return read(spark, sf, "documents").select("doc_id", F.size(w).alias("n"), F.md5(F.array_join(w, " ")).alias("words"))


def h33_content(spark, sf):
    t = F.regexp_replace(F.regexp_replace("html", "<[^>]+>", ""), r"\s+", "")
    return read(spark, sf, "pages").select("page_id", F.md5(F.regexp_replace(t, "[。、！？「」『』]", "")).alias("content"))


def h34_junk_lines(spark, sf):
    return lines(spark, sf).groupBy("file_id").agg(F.count_if(tx.junk_line(F.col("text"))).alias("junk"))


def h38_targets(spark, sf):
    rows = spark.createDataFrame([(x,) for x in ("en, TH;ja", "en,en", " ; ,", "fr")], "arg string")
    t = F.array_distinct(F.filter(F.transform(F.split("arg", "[,;]"), lambda x: F.lower(F.trim(x))), lambda x: x != ""))
    return rows.select("arg", F.array_join(t, ",").alias("targets"))


def h40_pull_line(spark, sf):
    rows = spark.createDataFrame([('{"status":"pulling","completed":5,"total":10}',), ('{"status":"success"}',), ("noise",)], "line string")
    j = F.from_json("line", "status string, completed long, total long")
    return rows.select("line", j["status"].alias("status"), j["completed"].alias("done"), j["total"].alias("total"), F.coalesce(j["status"] == "success", F.lit(False)).alias("final"))


def h36_rms(spark, sf):
    """Root mean square of a sampled signal (span confidences) by tenths."""
    x = spans(spark, sf).select((F.floor(F.col("pos") / 100)).alias("frame"), "conf")
    return x.groupBy("frame").agg(F.round(F.sqrt(F.avg(F.col("conf") * F.col("conf")) + 1e-12), 6).alias("rms"))


def h35_db_above_floor(spark, sf):
    x = spans(spark, sf).groupBy("file_id").agg(F.percentile("conf", F.lit(0.8)).alias("p80"), F.percentile("conf", F.lit(0.05)).alias("p5"))
    return x.select("file_id", F.round(20 * F.log10(F.greatest("p80", F.lit(1e-9)) / F.greatest("p5", F.lit(1e-9))), 4).alias("db"))


def h37_rgb(spark, sf):
    from ..sources.subtitles import ycbcr_to_rgb

    x = spark.range(0, 256, 5).select(F.col("id").alias("y"), ((F.col("id") * 7) % 256).alias("cb"), ((F.col("id") * 13) % 256).alias("cr"))
    return x.select("y", "cb", "cr", ycbcr_to_rgb(F.col("y"), F.col("cb"), F.col("cr")).alias("c")).select("y", "cb", "cr", "c.r", "c.g", "c.b")


def b3_wordlike(spark, sf):
    return literal(spark).select("id", tx.wordlike(F.col("text")).alias("wordlike"))


def b4_lexical(spark, sf):
    return literal(spark).select("id", tx.lexical(F.col("text")).alias("lexical"))


def b5_hedged(spark, sf):
    return literal(spark).select("id", tx.hedged(F.col("text")).alias("hedged"))


def b6_untranslated(spark, sf):
    return literal(spark).select("id", tx.untranslated(F.col("text"), "ja", "en").alias("ja_en"), tx.untranslated(F.col("text"), "en", "th").alias("en_th"))


def b7_foreign_script(spark, sf):
    return _texts(spark, sf).select("id", tx.foreign_letters(F.col("text"), "th").alias("th"), tx.foreign_letters(F.col("text"), "ru").alias("ru"), tx.foreign_letters(F.col("text"), "en").alias("en"))


def b8_decorated(spark, sf):
    rows = spark.createDataFrame([("{\\fs20}a{\\blur2}b{\\c&H00}c",), ("{\\i1}a{\\b1}b{\\i0}",), ("plain",)], "body string")
    return rows.select("body", tx.decorated(F.col("body")).alias("decorated"))


def b9_script_matches(spark, sf):
    return _texts(spark, sf).select("id", *[tx.script_matches(F.col("text"), x).alias(x) for x in ("ja", "zh", "en", "ru", "bg")])


def b10_confident(spark, sf):
    v = spans(spark, sf).select("pos", F.bround(F.col("conf") * 1.5, 2).alias("score"), F.bround("conf", 2).alias("margin"))
    return v.filter("score >= 1.0 and margin >= 0.4").select("pos")


def b17_minimum(spark, sf):
    return cues(spark, sf).groupBy("file_id").agg(F.count("*").alias("n"), F.max("e").alias("sec")).filter("n >= 5 and sec >= 6").select("file_id", "n")


def loudness(cue: DataFrame, frames: DataFrame, frame: float = 0.1) -> DataFrame:
    """cue with db: the 80th percentile of the frames under it above the file's noise floor (the 5th percentile); 0 without frames."""
    floor = frames.groupBy("file_id").agg(F.percentile("level", F.lit(0.05)).alias("floor"))
    first = F.floor(F.col("s") / frame)
    under = F.sequence(first, F.greatest(first, F.floor(F.greatest("e", F.col("s") + 0.3) / frame) - 1))
    met = cue.select("file_id", "idx", F.explode(under).alias("frame")).join(frames, ["file_id", "frame"]).groupBy("file_id", "idx").agg(F.percentile("level", F.lit(0.8)).alias("p80"))
    db = 20 * F.log10(F.greatest("p80", F.lit(1e-9)) / F.greatest("floor", F.lit(1e-9)))
    return cue.join(met.join(floor, "file_id").select("file_id", "idx", db.alias("db")), ["file_id", "idx"], "left").withColumn("db", F.coalesce("db", F.lit(0.0)))


def gate(cue: DataFrame) -> DataFrame:
    """cue: file_id, idx, s, e, src, speech (covered share) and maybe db (loudness). Adds text, verdict and new_idx (of those that stay).

    Loops collapse first; with little speech only word-like cues of human speed, short and loud enough, stay (quiet); with some,
    made-up phrases go; of cues that stay, the third and later of equal neighbours go (repeat)."""
    t = cue.withColumn("text", tx.collapse_loops(F.col("src")))
    d = F.greatest(F.col("e") - F.col("s"), F.lit(0.01))
    n = F.length(tx.norm(F.col("text")))
    fast = (n > 8) & (n / d > 20)
    loud = (F.col("db") >= 6) | F.col("db").isNull() if "db" in cue.columns else F.lit(True)
    speechlike = tx.wordlike(F.col("text")) & ~tx.made_up(F.col("text")) & ~fast & (d <= 8) & loud
    v = F.when((F.col("speech") < 0.15) & ~speechlike, "no_speech").when(F.col("speech") < 0.15, "quiet").when((F.col("speech") < 0.5) & tx.made_up(F.col("text")), "made_up").otherwise("kept")
    t = t.withColumn("verdict", v).withColumn("stays", F.col("verdict").isin("kept", "quiet"))
    w = Window.partitionBy("file_id", "stays").orderBy("idx")
    t = t.withColumn("run", F.sum(F.coalesce(F.col("text") != F.lag("text").over(w), F.lit(True)).cast("int")).over(w))
    t = t.withColumn("verdict", F.when(F.col("stays") & (F.row_number().over(Window.partitionBy("file_id", "stays", "run").orderBy("idx")) > 2), "repeat").otherwise(F.col("verdict")))
    stays = F.col("verdict").isin("kept", "quiet")
    place = F.row_number().over(Window.partitionBy("file_id", stays).orderBy("idx")) - 1
    return t.withColumn("new_idx", F.when(stays, place)).drop("stays", "run")


def heard(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Speech spans and loudness frames of a second for the conversations: most cues are heard in part, some not at all."""
    c = cues(spark, sf)
    d, k = F.col("e") - F.col("s"), (F.col("idx") * 37 + F.col("file_id") * 11) % 10
    speech = c.filter(k > 0).select("file_id", F.col("idx").alias("pos"), (F.col("s") + d * 0.05).alias("s"), (F.col("s") + d * (0.05 + k / 10 * 0.9)).alias("e"))
    frames = c.groupBy("file_id").agg(F.floor(F.max("e")).alias("last")).select("file_id", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("frame"))
    return speech, frames.withColumn("level", ((F.col("file_id") * 31 + F.col("frame") * 17) % 100 + 10) / 1000)


def gated(spark, sf) -> DataFrame:
    """The gate over all conversations: speech from the spans, loudness from the frames."""
    speech, frames = heard(spark, sf)
    c = iv.covered(cues(spark, sf), iv.union(speech, ["file_id"]), ["file_id"], ["file_id", "idx"], cell=60.0)
    c = c.withColumn("speech", F.round(iv.ratio(F.col("sec"), F.col("s"), F.col("e")), 3)).drop("sec")
    return gate(loudness(c, frames, 1.0))


def b1_filter_cues(spark, sf):
    return gated(spark, sf).select("file_id", "idx", "verdict", F.col("new_idx").cast("long").alias("new_idx"))


def d21_gate_totals(spark, sf):
    """How many cues each verdict has, and their share."""
    n = gated(spark, sf).groupBy("verdict").agg(F.count("*").alias("cues"))
    total = n.agg(F.sum("cues").alias("total"))
    return n.join(F.broadcast(total)).select("verdict", "cues", F.round(100 * F.col("cues") / F.col("total"), 4).alias("percent"))  # one row


def assess(lines: DataFrame, keys, expected: dict, limits=(0.7, 0.12, 0.002, 0.2, 0.02, 0.15)) -> DataFrame:
    """keys and n, script_match, symbol_share, replacement, repeat, prose, junk, reason: the first limit a track breaks."""
    t = F.col("text")
    # Fixed value: how a reader's remark about an image begins.
    prose = t.rlike(r"(?i)^\s*(?:the (?:text|image|subtitle|caption)|this (?:image|subtitle)|here is|here's|i can see|it (?:says|reads)|the words|there is no text|no text)")
    own = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for k, v in expected.items() for x in (k, ",".join(v))]), F.col(keys[0])), F.lit("latin"))
    l = lines.filter("trim(text) != ''").withColumn("fits", F.array_contains(F.split(own, ","), tx.script_of(t)))
    same = l.groupBy(*keys, F.xxhash64("text").alias("h")).agg(F.count("*").alias("same")).groupBy(*keys).agg(F.max("same").alias("same"))
    m = l.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(F.col("fits").cast("int")).alias("script_match"), (F.sum(tx.symbols(t)) / F.sum(F.length(t))).alias("symbol_share"), (F.sum(F.length(F.regexp_replace(t, "[^�]", ""))) / F.sum(F.length(t))).alias("replacement"), F.avg(prose.cast("int")).alias("prose"), F.avg(tx.junk_line(t).cast("int")).alias("junk"))
    m = m.join(same, list(keys)).withColumn("repeat", F.col("same") / F.col("n")).drop("same")
    reason = F.when(F.col("n") < 10, "few").when(F.col("script_match") < limits[0], "script").when(F.col("symbol_share") > limits[1], "symbols").when(F.col("replacement") > limits[2], "replacement").when(F.col("repeat") > limits[3], "repeat").when(F.col("prose") > limits[4], "prose").when(F.col("junk") > limits[5], "junk").otherwise("ok")
    return m.withColumn("reason", reason)


def b2_assess(spark, sf):
    a = assess(lines(spark, sf), ["lang", "file_id"], {k: (v,) for k, v in tx.SCRIPT_OF_LANG.items()} | {"ja": ("ja", "han"), "zh": ("han",)})
    return a.groupBy("reason").agg(F.count("*").alias("tracks"))


def register_agreement(pairs: DataFrame) -> DataFrame:
    """pairs: lang, ref, hyp. Of the lines whose reference shows a class: how many show a value in common, how many show none."""
    f = pairs.select("lang", tx.features(F.col("ref"), F.col("lang")).alias("r"), tx.features(F.col("hyp"), F.col("lang")).alias("h"))
    x = f.select("lang", "h", F.explode("r").alias("class", "v")).withColumn("own", F.try_element_at("h", F.col("class")))
    g = x.groupBy("lang", "class").agg(F.count("*").alias("n"), F.count_if(F.arrays_overlap("v", "own")).alias("agree"), F.count_if(F.col("own").isNull()).alias("absent"))
    return g.withColumn("rate", F.round(100 * F.col("agree") / F.col("n"), 1))


def d8_register_agreement(spark, sf):
    """Each line against the others of its language, and document lines against what is left without some words."""
    same = [(la, t, u) for i, (la, t) in enumerate(SPOKEN) for j, (lb, u) in enumerate(SPOKEN) if la == lb and i != j]
    own = spark.createDataFrame(same, "lang string, ref string, hyp string")
    docs = lines(spark, sf).select("lang", F.col("text").alias("ref"), F.regexp_replace("text", "(?i)(?:te|toi|usted)", "on").alias("hyp"))
    return register_agreement(docs.unionByName(own))


def _timed_docs(spark, sf):
    d = read(spark, sf, "documents").withColumn("file_id", F.col("doc_id") % 20).withColumn("s", F.col("doc_id") * 10.0)
    ref = d.select("file_id", F.col("doc_id").alias("pos"), "s", (F.col("s") + 8).alias("e"), "text")
    hyp = ref.withColumn("s", F.col("s") + 1).withColumn("e", F.col("e") + 1).withColumn("text", F.regexp_replace("text", "(?i)the", "a"))
    return ref, hyp


def d9_score_binned(spark, sf):
    """Mean sentence chrF++ and WER over common minutes, and coverage."""
    ref, hyp = _timed_docs(spark, sf)

    def bins(df, name):
        b = df.filter("trim(text) != ''").withColumn("bin", F.floor((F.col("s") + F.col("e")) / 2 / 60))
        return b.groupBy("file_id", "bin").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s", "pos", "text"))), lambda x: F.trim(F.replace(x["text"], F.lit("\n"), F.lit(" ")))), " ").alias(name))

    j = bins(ref, "r").join(bins(hyp, "h"), ["file_id", "bin"])
    x = j.select("file_id", sc.chrf_counts("r", "h").alias("c"), sc.wer("r", "h").alias("wer")).select("file_id", sc.chrf(F.col("c")).alias("chrf"), "wer")
    return x.groupBy("file_id").agg(F.avg("chrf").alias("chrf"), F.avg("wer").alias("wer"), F.count("*").alias("bins_both"))


def d10_score_paired(spark, sf):
    """Corpus chrF++ (counts summed first) and mean WER over cues matched by overlap."""
    ref, hyp = _timed_docs(spark, sf)
    m = iv.argmax_overlap(ref, hyp, ["file_id"], ["file_id", "pos"], 0.2, cell=60.0)
    x = m.select("l.file_id", sc.chrf_counts("l.text", "r.text").alias("c"), sc.wer("l.text", "r.text").alias("wer"))
    g = x.groupBy("file_id").agg(sc.sum_counts(F.col("c")).alias("c"), F.avg("wer").alias("wer"), F.count("*").alias("pairs"))
    return g.select("file_id", sc.chrf(F.col("c")).alias("chrf"), "wer", "pairs")


def g6_feature_overlap(spark, sf):
    """Whether the halves of a whole text have a word in common."""
    half = F.floor(F.length("text") / 2).cast("int")
    words = lambda x: F.array_distinct(F.split(F.lower(x), " "))
    return read(spark, sf, "documents").select("doc_id", F.arrays_overlap(words(F.left("text", half)), words(F.substr("text", half + 1))).alias("agree"))


def g7_function_words(spark, sf):
    w = F.array_distinct(F.split(F.lower("text"), r"[^a-z]+"))
    return read(spark, sf, "documents").select("doc_id", F.size(F.array_intersect(w, F.array(*map(F.lit, ("the", "of", "and", "to"))))).alias("hits"))


QUERIES = {k: f for k, f in globals().items() if k[:1] in "abcdefgh" and k[1:2].isdigit() and callable(f)}


def _sql(body: str, *ctes: str) -> str:
    return "with " + ",\n".join([SPANS, CUES, LINES, BOTH_SQL, *ctes]) + "\n" + body


_COUNT = lambda p: f"len(regexp_extract_all(text, '{p}'))"
_SCRIPTS = ", ".join(f"{_COUNT(p)} as {k}" for k, p in tx.SCRIPTS.items())
_MOST = f"greatest({', '.join(tx.SCRIPTS)})"
_SCRIPT = f"case when ja > 0 and ja + han >= latin then 'ja' when {_MOST} = 0 then 'none' " + " ".join(f"when {k} = {_MOST} then '{k}'" for k in tx.SCRIPTS) + " end"
_S = f"s as (select id, text, {_SCRIPT} as script from (select *, {_SCRIPTS} from t))"
_WORDLIKE = f"""case when regexp_matches(text, '[A-Za-zÀ-ɏ]') then len(list_filter(regexp_extract_all(text, '[A-Za-zÀ-ɏ]{{2,}}'), lambda x: lower(x) not in ({", ".join(map(repr, tx.FILLER_WORDS))}))) > 0
  when length(bare) = 1 then regexp_matches(bare, '[一-鿿]') when len(list_filter(range(1, length(bare) + 1), lambda i: i = 1 or bare[i] <> bare[i - 1])) < length(bare) * 0.5 then false
  else length(bare) >= 2 and length(regexp_replace(bare, '[{tx.FILLER_CHARS}]', '', 'g')) >= 1 end"""
_MADE_UP = "(" + " or ".join(f"regexp_matches(text, '{p}')" for p in tx.MADE_UP) + ")"
_BARE_TEXT = r"regexp_replace(text, '[^\p{L}\p{N}]+', '', 'g')"
_LINES_OF = r"regexp_split_to_array(text, '\r\n|\r|\n')"
_Q = lambda p: p.replace("'", "''")
_GATED = f"""heard as (select file_id, s + (e - s) * 0.05 as s, s + (e - s) * (0.05 + k / 10 * 0.9) as e from (select *, (idx * 37 + file_id * 11) % 10 as k from cues) where k > 0),
frames as (select file_id, frame, ((file_id * 31 + frame * 17) % 100 + 10) / 1000 as level from (select file_id, unnest(generate_series(0, cast(floor(max(e)) as bigint))) as frame from cues group by file_id)),
floors as (select file_id, quantile_cont(level, 0.05) as floor from frames group by file_id),
told as (select c.*, src as text, least(1, greatest(0, coalesce((select sum(least(h.e, c.e) - greatest(h.s, c.s)) from heard h where h.file_id = c.file_id and least(h.e, c.e) > greatest(h.s, c.s)), 0) / nullif(e - s, 0))) as share,
  coalesce((select 20 * log10(greatest(quantile_cont(level, 0.8), 1e-9) / any_value(floor)) from frames f join floors using (file_id) where f.file_id = c.file_id and f.frame between floor(c.s) and greatest(floor(c.s), floor(greatest(c.e, c.s + 0.3)) - 1)), 0) as db from cues c),
judged as (select *, case when share < 0.15 and not ({_WORDLIKE} and not {_MADE_UP} and not (length(bare) > 8 and length(bare) / d > 20) and d <= 8 and db >= 6) then 'no_speech' when share < 0.15 then 'quiet' when share < 0.5 and {_MADE_UP} then 'made_up' else 'kept' end as v
  from (select *, round(coalesce(share, 0), 3) as share, {_BARE_TEXT} as bare, greatest(e - s, 0.01) as d from told)),
runs as (select *, sum(o) over (partition by file_id, v in ('kept', 'quiet') order by idx) as run from (select *, case when text = lag(text) over (partition by file_id, v in ('kept', 'quiet') order by idx) then 0 else 1 end as o from judged)),
gated as (select file_id, idx, case when v in ('kept', 'quiet') and row_number() over (partition by file_id, v in ('kept', 'quiet'), run order by idx) > 2 then 'repeat' else v end as verdict from runs)"""
_FW = "fw(i, lang, word) as (values " + ", ".join(f"({i}, '{k}', {_QUOTE(w)})" for i, (k, ws) in enumerate(tx.FUNCTION_WORDS.items()) for w in ws) + ")"
_TL = """w as (select id, list_distinct(list_transform(regexp_extract_all(replace(text, '’', ''''), '[A-Za-zÀ-ɏ'']+'), lambda x: lower(x))) as words from {src}),
hits as (select w.id, fw.lang, fw.i, count(*) as n from w, unnest(w.words) as u(word) join fw on fw.word = u.word group by all),
top as (select id, lang, n, coalesce(lead(n) over (partition by id order by n desc, i), 0) as second, row_number() over (partition by id order by n desc, i) as k from hits),
tl as (select w.id, case when len(words) >= 3 and n >= 3 and n >= 1.5 * second then lang end as lang, case when len(words) >= 3 and n >= 3 and n >= 1.5 * second then cast(n as int) else 0 end as hits from w left join top on w.id = top.id and k = 1)"""
_OWN = {"th": r"\x{0e00}-\x{0e7f}", "ru": r"\x{0400}-\x{052f}", "en": ""}
_LAT = r"\x{0000}-\x{024f}\x{1e00}-\x{1eff}\x{0300}-\x{036f}\x{2c60}-\x{2c7f}\x{a720}-\x{a7ff}"


def _re2(pattern: str) -> str:
    """A register pattern without look-around and with word borders for all letters."""
    edge = r"[\p{L}\p{N}_]"
    p = pattern.replace("(?<![א-ת])", "(?:^|[^א-ת])").replace("(?![א-ת])", "(?:$|[^א-ת])")
    p = p.replace(r"\b(?:", f"(?:^|[^{edge[1:-1]}])(?:").replace(r")\b", f")(?:$|[^{edge[1:-1]}])").replace(r"|\bt'", f"|(?:^|[^{edge[1:-1]}])t'")
    import re as _re

    p = _re.sub(r"^\\b(.*)\\b$", lambda m: f"(?:^|[^{edge[1:-1]}]){m[1]}(?:$|[^{edge[1:-1]}])", p)
    return p.replace("'", "''")


_REG = "reg(lang, class, v, pattern) as (values " + ", ".join(f"('{la}', '{c}', '{v}', '{'' if case else '(?i)'}{_re2(p)}')" for la, c, v, p, case in tx.REGISTER) + ")"
_SPOKEN = "spoken(file_id, lang, pos, text) as (values " + ", ".join(f"({-1 - i}, '{la}', 0, '{_Q(t)}')" for i, (la, t) in enumerate(SPOKEN)) + ")"
_TARGET = lambda t: f"case when r.class = 'polite' then trim(string_split(replace({t}, chr(10), ' '), '/')[-1]) else trim(replace({t}, chr(10), ' ')) end"
_SYMBOL_SET = r"[\p{L}\p{N}\s.,:;!?''\"\-–—…()\[\]「」『』、。！？・“”‘’«»¿¡/&+♪\x{3000}\x{300}-\x{36f}\x{e31}-\x{e4e}\x{3099}-\x{309a}]"
_SYMBOLS = lambda t: f"length(regexp_replace({t}, '{_SYMBOL_SET}', '', 'g'))"
_PROSE = "^\\s*(?:the (?:text|image|subtitle|caption)|this (?:image|subtitle)|here is|here''s|i can see|it (?:says|reads)|the words|there is no text|no text)"
# chrF++ from counted grams: characters without spaces, and words with their outer punctuation apart.
_CHRF = """sides as (select doc_id, side, regexp_replace(x, '\\s', '', 'g') as chars, flatten(list_transform(list_filter(regexp_split_to_array(x, '\\s+'), lambda w: w <> ''), lambda w: case when length(w) > 1 and regexp_matches(w, '[^\\p{L}\\p{N}]$') then [w[: length(w) - 1], w[length(w)]] when length(w) > 1 and regexp_matches(w, '^[^\\p{L}\\p{N}]') then [w[1], w[2 :]] else [w] end)) as words
  from (select doc_id, 'r' as side, text as x from documents union all select doc_id, 'h', substring(text, 10) from documents)),
grams as (select doc_id, side, n, chars[i : i + n - 1] as g, count(*) as c from (select doc_id, side, chars, n, unnest(generate_series(1, length(chars) - n + 1)) as i from sides, range(1, 7) o(n)) group by all
  union all select doc_id, side, n + 6, array_to_string(words[i : i + n - 1], ' '), count(*) from (select doc_id, side, words, n, unnest(generate_series(1, len(words) - n + 1)) as i from sides, range(1, 3) o(n)) group by all),
orders as (select doc_id, n, sum(rc) as r, sum(hc) as h, sum(least(rc, hc)) as m from (select doc_id, n, g, coalesce(sum(c) filter (side = 'r'), 0) as rc, coalesce(sum(c) filter (side = 'h'), 0) as hc from grams group by all) group by all)"""
SQL = {
    "h31_chrf": f"with {_CHRF} select d.doc_id, 100 * coalesce(avg(case when m = 0 then 0 else 5 * (m / h) * (m / r) / (4 * (m / h) + m / r) end) filter (r > 0 and h > 0), 0) as chrf from documents d left join orders using (doc_id) group by d.doc_id",
    "b2_assess": _sql(f"""select case when n < 10 then 'few' when script_match < 0.7 then 'script' when symbols > 0.12 then 'symbols' when replacement > 0.002 then 'replacement' when repeat > 0.2 then 'repeat' when prose > 0.02 then 'prose' when junk > 0.15 then 'junk' else 'ok' end as reason, count(*) as tracks from (
  select lang, file_id, count(*) as n, avg((script in ('latin', 'none'))::int) as script_match, sum({_SYMBOLS('text')}) / sum(length(text)) as symbols, sum(length(text) - length(replace(text, '�', ''))) / sum(length(text)) as replacement, max(same) / count(*) as repeat,
    avg(regexp_matches(text, '(?i){_PROSE}')::int) as prose, avg((length(body) >= 2 and length(regexp_replace(body, '\\P{{Nd}}', '', 'g')) + {_SYMBOLS("regexp_replace(body, '" + chr(92) + "p{Nd}', '', 'g')")} >= 0.4 * length(body))::int) as junk
  from (select *, {_SCRIPT.replace("'none' ", "'none' ")} as script, regexp_replace(text, '\\s', '', 'g') as body, count(*) over (partition by lang, file_id, text) as same from (select *, {_SCRIPTS} from lines where trim(text) <> '')) group by lang, file_id) group by 1"""),
    "b1_filter_cues": _sql("select file_id, idx, verdict, case when verdict in ('kept', 'quiet') then row_number() over (partition by file_id, verdict in ('kept', 'quiet') order by idx) - 1 end as new_idx from gated", _GATED),
    "d21_gate_totals": _sql("select verdict, count(*) as cues, round(100 * count(*) / (select count(*) from gated), 4) as percent from gated group by verdict", _GATED),
    "b3_wordlike": _sql(f"select id, {_WORDLIKE} as wordlike from (select *, {_BARE_TEXT} as bare from lit)"),
    "b4_lexical": _sql(f"select id, case when script = 'latin' then len(list_filter(regexp_extract_all(text, '[A-Za-zÀ-ɏ]{{3,}}'), lambda x: lower(x) not in ('hmm', 'mmm', 'ahh', 'ooh', 'aah'))) >= 2 else length(regexp_replace({_BARE_TEXT}, '[{tx.MOANS}]', '', 'g')) >= 4 end as lexical from s where id < 1000 and id in (select id from lit)", _S),
    "b5_hedged": _sql(r"select id, not contains(text, '://') and len(list_filter(list_transform(list_filter(regexp_split_to_array(text, '\s+'), lambda y: len(string_split(y, '/')) = 2 and not regexp_matches(y, '[0-9]')), lambda y: list_transform(string_split(y, '/'), lambda z: trim(z, '.,!?;:\"''()[]{}«»「」…'))), lambda h: h[1] <> '' and h[2] <> '' and lower(h[1]) <> lower(h[2]) and lower(h[1] || '/' || h[2]) not in (" + ", ".join(map(repr, tx.SLASH_WORDS)) + r") and not (h[1] = upper(h[1]) and h[2] = upper(h[2]) and h[1] <> lower(h[1]) and h[2] <> lower(h[2])) and (length(h[1]) <= 2 or length(h[2]) <= 5 or lower(left(h[1], 3)) = lower(left(h[2], 3))))) > 0 as hedged from lit"),
    "b6_untranslated": _sql("select id, text = '' or script in ('ja', 'han') and script not in ('latin', 'none') as ja_en, text = '' as en_th from s where id in (select id from lit)", _S),
    "b8_decorated": "select body, len(list_filter(regexp_extract_all(body, '\\{[^}]*\\}'), lambda x: regexp_matches(x, '" + tx._TAGS.replace("\\", "\\") + "'))) >= 3 as decorated from (values ('{\\fs20}a{\\blur2}b{\\c&H00}c'), ('{\\i1}a{\\b1}b{\\i0}'), ('plain')) v(body)",
    "h4_language_of_text": _sql("select t.id, case when length(body) < 200 then null when script in ('ja', 'th', 'ko') then script when script = 'han' then 'zh' when script = 'greek' then 'el' when script = 'latin' and tl.hits >= 10 then tl.lang end as lang from (select id, text as body from b) t left join s using (id) left join tl using (id)", f"b as (select id, array_to_string(list_filter({_LINES_OF}, lambda x: trim(x) <> '' and not regexp_full_match(trim(x), '[0-9]+') and not contains(x, '-->')), ' ') as text from t)", _S.replace("from t)", "from b)"), _FW, _TL.format(src="b")),
    "h11_clean_ocr": _sql("select id, case text when '| hate it' then 'I hate it' when 'l''m here' then 'I''m here' when 'wait\\cdots now' then 'wait… now' else text end as text from lit"),
    "h12_clean_sdh": _sql(f"select id, array_to_string(list_filter(list_transform(list_transform({_LINES_OF}, lambda x: trim(x)), lambda x: case when regexp_matches(x, '{_Q(tx._BARE)}') or regexp_matches(x, '{_Q(tx._MUSIC)}') then '' else trim(regexp_replace(x, '{_Q(tx._SDH_LABEL).replace('(?=' + chr(92) + 'S)', '(' + chr(92) + 'S)')}', '\\1')) end), lambda x: x <> ''), chr(10)) as text from lit"),
    "h13_clean_captions": _sql(f"select id, array_to_string(list_filter(list_transform(list_transform(list_transform({_LINES_OF}, lambda x: trim(x)), lambda x: [x, trim(regexp_replace(regexp_replace(x, '{_Q(tx._CAP_LABEL)}', ''), '{_Q(tx._CAP_TAG)}', ' ', 'g'))]), lambda x: case when regexp_matches(x[1], '{_Q(tx._MUSIC)}') or regexp_matches(x[2], '{_Q(tx._BARE)}') then '' else x[2] end), lambda x: x <> ''), chr(10)) as text from lit"),
    "h16_clean_line": _sql(rf"select id, translate(trim(regexp_replace(case when length(s) >= 2 and regexp_matches(s, '(?s)^[\"“''‘].*[\"”''’]$') then trim(s[2 : length(s) - 1]) else s end, '\s+', ' ', 'g')), '。、', '.,') as text from (select id, regexp_replace(regexp_replace(trim(text), '^\s*\[S[0-9]+\]\s*', ''), '{_Q(tx._NOTE)}', '') as s from lit)"),
    "h17_copy_through": _sql(rf"select id, regexp_replace(trim(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '{tx._FILLERS}', '', 'g')), '\s+([,.!?])', '\1', 'g') as text from lit"),
    "h18_parse_numbered": _sql(rf"select id, n, arg_min(line, (line = '', i)) as line from (select id, i, cast(regexp_extract(x, '{tx._NUMBERED}', 1) as int) as n, regexp_extract(x, '{tx._NUMBERED}', 2) as line from (select id, unnest(list_transform({_LINES_OF}, lambda y: trim(y))) as x, unnest(range(len({_LINES_OF}))) as i from lit) where regexp_matches(x, '{tx._NUMBERED}')) group by id, n"),
    "h19_register": _sql("select file_id, pos, class, string_agg(distinct v, ',' order by v) as shown from (select l.file_id, cast(l.pos as int) as pos, r.class, r.v from (select file_id, lang, pos, text from lines union all select * from spoken) l join reg r on r.lang = l.lang where regexp_matches(case when r.class = 'polite' then trim(string_split(replace(text, chr(10), ' '), '/')[-1]) else trim(replace(text, chr(10), ' ')) end, r.pattern)) group by all", _REG, _SPOKEN),
    "h1_script_of": _sql("select id, script from s", _S),
    "h2_text_language": _sql("select * from tl", _FW, _TL.format(src="t")),
    "h3_script_vote": _sql("select s.id, case when script in ('ja', 'th', 'ko') then script when script = 'han' then 'zh' when script = 'greek' then 'el' when script = 'latin' then coalesce(tl.lang, 'en') end as lang, case when script in ('ja', 'th', 'ko', 'greek') then 0.7 when script = 'han' then 0.3 when script = 'latin' and tl.lang is not null then 0.5 when script = 'latin' then 0.15 else 0 end::double as weight from s left join tl using (id)", _S, _FW, _TL.format(src="t")),
    "h5_code_from_name": "select * from (values ('English', 'en'), (' german ', 'de'), ('fr', 'fr'), ('Klingon', null), ('xx', null), ('unknown', null), ('', null), ('Mandarin', 'zh'), ('Chinese (Simplified)', 'zh'), ('BURMESE', 'my'), ('et', 'et')) v(name, code)",
    "h7_norm": _sql(r"select id, md5(regexp_replace(text, '[^\p{L}\p{N}]+', '', 'g')) as norm from t"),
    "d8_register_agreement": _sql("""select lang, class, count(*) as n, count(*) filter (agree) as agree, count(*) filter (not any_) as absent, round(100 * count(*) filter (agree) / count(*), 1) as rate
  from (select lang, class, k, bool_or(in_ref and in_hyp) as agree, bool_or(in_hyp) as any_, bool_or(in_ref) as shown from (select p.k, p.lang, r.class, regexp_matches(__T(ref), r.pattern) as in_ref, regexp_matches(__T(hyp), r.pattern) as in_hyp from pairs p join reg r on r.lang = p.lang) group by all having shown) group by all""".replace("__T(ref)", _TARGET("ref")).replace("__T(hyp)", _TARGET("hyp")), _REG, _SPOKEN, "pairs as (select *, row_number() over () as k from (select lang, text as ref, regexp_replace(text, '(?i)(?:te|toi|usted)', 'on', 'g') as hyp from lines union all select a.lang, a.text, b.text from spoken a join spoken b on a.lang = b.lang and a.file_id <> b.file_id))"),
    "h26_parse_time": "select * from (values ('1:02:03.5', 3723.5::double), ('10:00', 600), ('7', 7), ('0:00:01', 1)) v(t, sec)",
    "a6_ass_seconds": "select * from (values ('0:00:01.50', 1.5::double), ('1:02:03:04', 3723.04), ('bad', null), (' 0:10:00.00 ', 600)) v(t, sec)",
    "h28_slug": _sql(r"select id, left(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}]+', '-', 'g'), '^-+|-+$', '', 'g'), 80) as slug, case when strlen(safe) <= 150 then safe else (select max(safe[: k]) from range(30, 151) r(k) where strlen(safe[: k]) <= 150) end as stem from (select id, text, regexp_replace(text, '[^\p{L}\p{N}_.-]', '_', 'g') as safe from t)"),
    "h29_cache_key": "select doc_id, left(sha1(concat_ws('|', doc_id, lang, source)), 10) as key from documents",
    "h32_words": r"select doc_id, cast(len(w) as int) as n, md5(array_to_string(w, ' ')) as words from (select doc_id, list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+'), lambda x: x <> '') as w from documents)",
    "h33_content": r"select page_id, md5(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '\s+', '', 'g'), '[。、！？「」『』]', '', 'g')) as content from pages",
    "h38_targets": "select * from (values ('en, TH;ja', 'en,th,ja'), ('en,en', 'en'), (' ; ,', ''), ('fr', 'fr')) v(arg, targets)",
    "h40_pull_line": "select * from (values ('{\"status\":\"pulling\",\"completed\":5,\"total\":10}', 'pulling', 5::bigint, 10::bigint, false), ('{\"status\":\"success\"}', 'success', null, null, true), ('noise', null, null, null, false)) v(line, status, done, total, final)",
    "h36_rms": _sql("select cast(floor(pos / 100) as bigint) as frame, round(sqrt(avg(conf * conf) + 1e-12), 6) as rms from spans group by all"),
    "h35_db_above_floor": _sql("select file_id, round(20 * log10(greatest(quantile_cont(conf, 0.8), 1e-9) / greatest(quantile_cont(conf, 0.05), 1e-9)), 4) as db from spans group by file_id"),
    "h37_rgb": "select y, cb, cr, greatest(0, least(255, (298 * (y - 16) + 409 * (cr - 128) + 128) >> 8)) as r, greatest(0, least(255, (298 * (y - 16) - 100 * (cb - 128) - 208 * (cr - 128) + 128) >> 8)) as g, greatest(0, least(255, (298 * (y - 16) + 516 * (cb - 128) + 128) >> 8)) as b from (select y, y * 7 % 256 as cb, y * 13 % 256 as cr from range(0, 256, 5) v(y))",
    "h34_junk_lines": _sql(r"""select file_id, count(*) filter (length(body) >= 2 and length(regexp_replace(body, '\P{Nd}', '', 'g')) + length(regexp_replace(regexp_replace(body, '\p{Nd}', '', 'g'), '[\p{L}\p{N}\s.,:;!?''"\-–—…()\[\]「」『』、。！？・“”‘’«»¿¡/&+♪\x{3000}\x{300}-\x{36f}\x{e31}-\x{e4e}\x{3099}-\x{309a}]', '', 'g')) >= 0.4 * length(body)) as junk from (select *, regexp_replace(text, '\s', '', 'g') as body from lines) group by file_id"""),
    "b7_foreign_script": _sql("select id, " + ", ".join(f"cast(length(regexp_replace(text, '[^\\p{{L}}]|[{_LAT}{r}]', '', 'g')) as int) as {k}" for k, r in _OWN.items()) + " from t"),
    "b9_script_matches": _sql("select id, script in ('ja', 'han') as ja, script = 'han' as zh, script in ('latin', 'none') as en, script = 'cyrillic' as ru, script in ('latin', 'none') as bg from s", _S),
    "b10_confident": _sql("select pos from spans where round_even(conf * 1.5, 2) >= 1.0 and round_even(conf, 2) >= 0.4"),
    "b17_minimum": _sql("select file_id, count(*) as n from cues group by file_id having count(*) >= 5 and max(e) >= 6"),
    "g6_feature_overlap": "select doc_id, list_has_any(string_split(lower(text[: length(text) // 2]), ' '), string_split(lower(text[length(text) // 2 + 1 :]), ' ')) as agree from documents",
    "g7_function_words": "select doc_id, cast(len(list_intersect(list_distinct(regexp_split_to_array(lower(text), '[^a-z]+')), ['the', 'of', 'and', 'to'])) as int) as hits from documents",
}
