"""Text functions on literal lines."""

import pytest
from pyspark.sql import functions as F

from cuewright.functions import scoring as sc
from cuewright.functions import text as tx
from cuewright.functions import timefmt as tf


@pytest.fixture()
def on(spark):
    def run(f, *texts):
        df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", f(F.col("text")).alias("x"))
        return [r.x for r in df.orderBy("i").collect()]

    return run


def test_scripts_and_languages(on):
    assert on(tx.script_of, "今日はいい天気", "สวัสดี", "你好世界", "Привет", "hi", "12:30", "") == ["ja", "th", "han", "cyrillic", "latin", "none", "none"]
    assert on(lambda c: tx.script_matches(c, "bg"), "Български", "Latin") == [False, True]
    assert [x.lang for x in on(tx.text_language, "the best of all and to that with", "hello world", "der und das nicht mit dem")] == ["en", None, "de"]
    two = {"da": ("og", "det", "er"), "no": ("og", "det", "er")}
    assert [x.lang for x in on(lambda c: tx.text_language(c, two), "og det er her nu")] == [None]  # equal lists tie, so neither wins
    assert [tuple(x) for x in on(tx.script_vote, "你好", "Привет", "blah")] == [("zh", 0.3), (None, 0.0), ("en", 0.15)]


def test_gates(on):
    assert on(tx.wordlike, "痛い", "はい", "ああ", "し", "何", "Hmm", "go on", "ああああうううう") == [True, True, False, False, True, False, True, False]
    assert on(tx.hedged, "měl/a tam", "he/she", "and/or", "AC/DC", "1/2 cup", "http://a/b", "pisec/pisateljica", "plain") == [True, True, False, False, False, False, True, False]
    assert on(lambda c: tx.foreign_letters(c, "th"), "สวัสดี OK", "สวัสดี мир", "我们") == [0, 3, 2]
    assert on(tx.collapse_loops, "hahahahahaha", "abcabcabcabc!", "normal") == ["haha", "abcabc!", "normal"]
    assert on(tx.junk_line, "4$4%0", "a real line", "x") == [True, False, False]
    assert on(lambda c: tx.untranslated(c, "ja", "en"), "今日は", "today", "") == [True, False, True]


def test_cleaning(on):
    assert on(tx.clean_sdh, "MAN: Hello", "(door closes)", "♪ la ♪", "[MUSIC]\nStay", "18:30 now", "（男）だめ") == ["Hello", "", "♪ la ♪", "Stay", "18:30 now", "だめ"]
    assert on(tx.clean_captions, "MAYA: (LAUGHING) You wanted it?", "Note: stay", "(he said)") == ["You wanted it?", "Note: stay", ""]
    assert on(lambda c: tx.clean_ocr(c, "en"), "-thanks", "| hate it", "l'm here", "什么cdots那", "iIn France") == ["- thanks", "I hate it", "I'm here", "什么…那", "In France"]
    assert on(tx.clean_line, '"quoted"', "[S3] hi", "text (TN: pun)", "。、") == ["quoted", "hi", "text", ".,"]
    assert on(lambda c: tx.copy_through(c, "en"), "um, well  , yes") == ["well, yes"]


def test_numbered_lines_and_wrapping(on):
    assert on(tx.parse_numbered, "1. one\n[2] two\n3: three\nnoise\n1) again\n4.")[0] == {1: "one", 2: "two", 3: "three", 4: ""}
    short, long_, none = on(lambda c: tx.wrap_lines(c, 20), "short", "a balanced line, and the rest", "unbreakablewordthatistoolong")
    assert short == ["short"] and long_ == ["a balanced line,", "and the rest"] and none is None


def test_times(on):
    assert on(lambda c: tf.srt_time(c.cast("double")), "0", "3661.0005", "-1", "0.0015") == ["00:00:00,000", "01:01:01,000", "00:00:00,000", "00:00:00,002"]
    assert on(tf.parse_time, "1:02:03.5", "7") == [3723.5, 7.0]
    assert on(tf.ass_seconds, "0:00:01.50", "bad") == [1.5, None]


def test_scores(spark):
    df = spark.createDataFrame([("a b c d", "a x c"), ("", ""), ("", "a"), ("same text", "same text")], "r string, h string")
    assert [round(x.w, 4) for x in df.select(sc.wer("r", "h").alias("w")).collect()] == [0.5, 0.0, 1.0, 0.0]
    scores = [x.c for x in df.select(sc.chrf_counts("r", "h").alias("n")).select(sc.chrf(F.col("n")).alias("c")).collect()]
    assert scores[3] == pytest.approx(100.0) and 0 < scores[0] < 60 and scores[1] == 0
    assert [x.a for x in df.select(sc.agreement("r", "h").alias("a")).collect()][1:] == [1.0, 0.0, 1.0]


def test_register(on):
    assert on(lambda c: tx.register(c, "fr", "tv"), "Tu viens avec vous ?", "rien") == [["tu", "vous"], []]
    assert on(lambda c: tx.register(c, "de", "tv"), "sie kommt", "Sie kommen, du auch") == [[], ["du", "sie"]]
