"""Folds and ordered windows on literal rows."""

import random

import numpy as np

from cuewright.operators import sequence as sq
from cuewright.plans import sequences as se


def rows(*triples, **more):
    return [{"file_id": 1, "pos": i, "s": float(s), "e": float(e), "lang": t[2] if len(t) > 2 else "en", "speaker": t[3] if len(t) > 3 else "", **more} for i, t in enumerate(triples) for s, e in [t[:2]]]


def test_timing_keeps_clear_of_neighbours():
    out = list(sq.normal_timing(rows((1, 1.2), (2, 4), (4.05, 5))))
    assert [round(r["s"], 2) for r in out] == [0.88, 1.88, 4.05] and round(out[1]["e"], 2) == 4.0 and all(a["e"] <= b["s"] for a, b in zip(out[:-1], out[1:], strict=True))


def test_windows_close_by_speech_time_and_voice():
    assert [w["spans"] for w in sq.speech_windows(rows((0, 4), (5, 9), (10, 14)))] == [3]
    assert [w["spans"] for w in sq.speech_windows(rows((0, 6), (7, 13), (14, 20)))] == [2, 1]
    assert [w["speaker"] for w in sq.speech_windows(rows((0, 4, "en", "A"), (5, 9, "en", "B")), by_speaker=True)] == ["A", "B"]
    assert [w["spans"] for w in sq.speech_windows(rows((0, 5), (6, 11), (12, 13)))] == [3]


def test_chunks_break_at_language_silence_and_length():
    chunks = list(sq.speech_chunks(rows((0, 5), (5.5, 8), (11, 12), (12.5, 14, "ja"), (14, 90, "ja"))))
    assert [c["lang"] for c in chunks] == ["en", "en", "ja", "ja", "ja", "ja"] and all(a["e"] <= b["s"] for a, b in zip(chunks[:-1], chunks[1:], strict=True))
    assert (chunks[0]["s"], chunks[0]["e"]) == (0.0, 8.25)


def test_words_become_cues():
    w = [("Hello", 0, 0.4), ("there.", 0.5, 0.9), ("How", 1.0, 1.2), ("are", 1.2, 1.4), ("you", 1.4, 1.6), ("?", 1.6, 1.7), ("Fine", 3.0, 3.4)]
    out = sq.words_to_cues([{"file_id": 1, "pos": i, "s": s, "e": e, "text": t, "lang": "en", "speaker": ""} for i, (t, s, e) in enumerate(w)])
    assert [c["text"] for c in out] == ["Hello there. How are you?", "Fine"]
    mixed = [{"file_id": 1, "pos": 0, "s": 0.0, "e": 1.0, "text": "犬", "lang": "ja", "speaker": "A"}, {"file_id": 1, "pos": 1, "s": 1.0, "e": 2.0, "text": "dog", "lang": "en", "speaker": "B"}]
    assert [(c["text"], c["speaker"]) for c in sq.words_to_cues(mixed)] == [("犬", "A"), ("dog", "B")]


def test_cuts_leave_least_pieces():
    r = rows((0, 10))
    r[0]["edges"] = [0.1, 4.0, 4.2, 9.8]
    assert [(p["s"], p["e"]) for p in sq.cut_at_turns(r)] == [(0.0, 4.0), (4.0, 10.0)]


def test_splits_take_the_first_best():
    r = [{"file_id": 1, "pa": a, "pb": b} for a, b in ((0.9, 0.1), (0.9, 0.1), (0.8, 0.2), (0.7, 0.3), (0.1, 0.9), (0.2, 0.8))]
    assert next(iter(sq.best_splits(r)))["split"] == 4


def test_collapsed_words_spread_out():
    r = [{"file_id": 1, "pos": i, "s": s, "e": e, "text": t} for i, (t, s, e) in enumerate([("a", 0.0, 1.0), ("bb", 1.0, 1.0), ("cc", 1.0, 1.0), ("d", 3.0, 3.5)])]
    out = sq.spread_runs(r)
    assert [(x["s"], x["e"], x["moved"]) for x in out] == [(0.0, 1.0, False), (1.0, 1.4, True), (1.4, 1.8, True), (3.0, 3.5, False)]
    slow = sq.spread_runs(r, usual=5.0)
    assert [(x["s"], x["e"]) for x in slow] == [(0.0, 1.0), (1.0, 2.0), (2.0, 3.0), (3.0, 3.5)]


def plain_repair(words, start, end):
    """The rule word by word: (s, e) of words (text, s, e)."""
    def good(w, prev):
        return 0.02 <= w[2] - w[1] <= 3.0 and (prev is None or w[1] >= prev[1] - 0.001)

    def twin(k):
        return k + 1 < len(out) and abs(out[k + 1][1] - out[k][1]) < 0.001 and abs(out[k + 1][2] - out[k][2]) < 0.001

    out, i, last = list(words), 0, None
    while i < len(out):
        if good(out[i], last) and not twin(i):
            last, i = out[i], i + 1
            continue
        left = last[2] if last else start
        need = 0.0
        for j in range(i + 1, len(out) + 1):
            need += 0.04 * max(1, len(out[j - 1][0]))
            if j == len(out):
                break
            three = all(good(out[k], out[k - 1] if k > j else last) for k in range(j, min(len(out), j + 3)))
            if three and not twin(j) and out[j][1] - left >= need:
                break
        right = out[j][1] if j < len(out) else end
        if right <= left:
            right = end if end > left else left + 0.5
        chars = sum(max(1, len(w[0])) for w in out[i:j])
        width, t = min(right - left, 0.2 * chars), left
        for k in range(i, j):
            d = width * max(1, len(out[k][0])) / chars
            out[k] = (out[k][0], round(t, 3), round(min(t + d, right), 3))
            t += d
        last, i = out[j - 1], j
    return [w[1:] for w in out]


def test_repair_against_the_plain_rule():
    r = random.Random(3)
    for _ in range(300):
        t, words = 0.0, []
        for _ in range(r.randint(1, 14)):
            kind = r.random()
            d = 0.0 if kind < 0.3 else 9.0 if kind < 0.4 else r.uniform(0.1, 1)
            words.append(("x" * r.randint(0, 6), round(t, 2), round(t + d, 2)))
            t += r.choice([0.0, d, d + 0.5, -1.0])
        rows = [{"file_id": 1, "pos": i, "s": s, "e": e, "text": x} for i, (x, s, e) in enumerate(words)]
        want = plain_repair(words, 0.0, t + 1)
        got = [(x["s"], x["e"]) for x in sq.spread_runs(rows, start=0.0, end=t + 1)]
        assert all(abs(a - b) < 2e-3 for g, w in zip(got, want, strict=True) for a, b in zip(g, w, strict=True)), (words, got, want)


def test_windows_hold_the_least_speech_of_a_voice():
    tiny = rows((0.0, 1.0, "en", "S1"), (1.2, 6.2, "en", "S2"), (6.5, 9.5, "en", "S2"))
    assert [w["speaker"] for w in sq.speech_windows(tiny, by_speaker=True, voice_least=3.0)] == ["S2"]
    assert len(sq.speech_windows(tiny, by_speaker=True)) == 2
    three = rows((0.0, 3.0, "en", "S1"), (3.5, 6.5, "en", "S1"), (7.0, 10.0, "en", "S2"))
    assert len(sq.speech_windows(three)) == 1 and len(sq.speech_windows(three, by_speaker=True, voice_least=3.0)) == 2


def test_chunks_end_with_the_file():
    assert [c["e"] for c in sq.speech_chunks(rows((0, 5)), total=5.1)] == [5.1]
    assert [c["e"] for c in sq.speech_chunks(rows((0, 5), total=5.05))] == [5.05]


def test_cues_of_sentences_pauses_and_clauses():
    def cues(*words, lang="ja"):
        r = [{"file_id": 1, "pos": i, "s": s, "e": e, "text": t, "lang": lang, "speaker": ""} for i, (t, s, e) in enumerate(words)]
        return [(c["text"], c["s"], c["e"]) for c in sq.words_to_cues(r)]

    assert cues(("今日は", 0.0, 0.4), ("いい", 0.45, 0.6), ("天気", 0.65, 0.9), ("ですね。", 0.95, 1.3), ("はい", 2.5, 2.7), ("、", 2.7, 2.72), ("そうですね", 2.75, 3.2), ("。", 3.2, 3.25), ("ご視聴ありがとうございました", 60.0, 61.0)) == [("今日はいい天気ですね。", 0.0, 1.3), ("はい、そうですね。", 2.5, 3.25), ("ご視聴ありがとうございました", 60.0, 61.0)]
    assert cues(("。", 0, 0.1), ("a。", 0.2, 0.4), ("！", 0.4, 0.9)) == [("a。！", 0.2, 0.4)]
    run = [(f"w{i:07d}" + ("," if i == 5 else ""), i * 0.3, i * 0.3 + 0.2) for i in range(11)]
    assert [t.split()[-1] for t, _, _ in cues(*run, lang="en")] == ["w0000005,", "w0000010"]
    assert [t.count("w") for t, _, _ in cues(*[(t.strip(","), s, e) for t, s, e in run], lang="en")] == [8, 3]
    assert [t.count("w") for t, _, _ in cues(*[(f"w{i}", i * 0.9, i * 0.9 + 0.8) for i in range(9)], lang="en")] == [6, 3]


def test_time_line_is_covered_but_for_quiet():
    level = np.full(1000, 1.0)
    level[:60] = level[400:430] = 0.01  # quiet at the start and for three seconds
    level[700:710] = 0.01  # a short dip
    spans = [{"s": 7.0, "e": 20.0, "lang": "en"}, {"s": 20.5, "e": 39.0, "lang": "en"}, {"s": 45.0, "e": 60.0, "lang": "ja"}, {"s": 60.2, "e": 99.0, "lang": "en"}]
    out = sq.cover_chunks(level, spans, 100.0)
    assert out[0]["s"] == 5.75 and all(c["e"] - c["s"] <= 30.5 + 1e-9 for c in out) and all(a["e"] <= b["s"] + 1e-9 for a, b in zip(out[:-1], out[1:], strict=True))
    heard = np.zeros(1000, bool)
    for c in out:
        heard[round(c["s"] * 10) : round(c["e"] * 10)] = True
    assert heard[60:400].all() and heard[430:1000].all() and not heard[:55].any() and not heard[404:426].any()
    assert any(abs(c["e"] - 60.35) < 0.01 for c in out) and {c["lang"] for c in out} == {"en", "ja"}
    assert sq.cover_chunks(np.zeros(0), [], 0.0) == []


def test_times_move_to_the_merged_text():
    w = lambda *x: [{"text": t, "s": s, "e": e} for t, s, e in x]
    got = sq.transfer_timing("今日は晴れ", w(("今日は", 0.0, 0.6)), w(("今日は", 0.1, 0.7), ("晴れ", 1.0, 1.4)), 0.0, 2.0, "ja")
    assert [(x["text"], x["s"], x["e"]) for x in got] == [("今", 0.0, 0.2), ("日", 0.2, 0.4), ("は", 0.4, 0.6), ("晴", 1.0, 1.2), ("れ", 1.2, 1.4)]
    got = sq.transfer_timing("one new two", w(("one", 0.0, 1.0), ("two", 3.0, 4.0)), [], 0.0, 5.0, "en")
    assert [(x["text"], x["s"], x["e"]) for x in got] == [("one", 0.0, 1.0), ("new", 1.0, 3.0), ("two", 3.0, 4.0)]
    back = sq.transfer_timing("ab", w(("a", 5.0, 6.0), ("b", 1.0, 2.0)), [], 0.0, 8.0, "ja")
    assert [(x["s"], x["e"]) for x in back] == [(5.0, 6.0), (6.0, 8.0)]
    assert sq.transfer_timing(" ", [], [], 0.0, 1.0, "en") == [] and sq.transfer_timing("x", [], [], 1.0, 2.0, "en") == [{"text": "x", "s": 1.0, "e": 2.0}]


def test_starts_are_pushed_from_moved_ends():
    assert [round(r["s"], 3) for r in sq.pushed_starts(rows((0, 2), (1, 3), (2.5, 4)))] == [0.0, 2.083, 3.083]


def test_chunks_of_text_hold_the_crossing_line():
    r = [{"file_id": 1, "pos": i, "text": "x" * 9} for i in range(5)]
    assert [c["lines"] for c in sq.text_chunks(r, 20)] == [2, 2, 1]


def test_smoothing(spark):
    def run(langs, sure, margin=None, voices=None, speech=None):
        n = len(langs)
        df = spark.createDataFrame([(1, i, langs[i], bool(sure[i]), float((margin or [0] * n)[i]), (voices or [""] * n)[i], float((speech or [0] * n)[i])) for i in range(n)], "file_id long, i int, lang string, confident boolean, margin double, speaker string, speech double")
        return [r.lang for r in se.smooth(df, seconds=(8.0, 4.0) if speech else None).orderBy("i").collect()]

    assert run(["en", "fr", "en", "en"], [1] * 4, [0.9] * 4, speech=[10, 2, 10, 10]) == ["en"] * 4
    assert run(["en", "fr", "en", "en"], [1] * 4, [0.9] * 4, speech=[10, 5, 10, 10]) == ["en", "fr", "en", "en"]
    assert run(["en", "fr", "fr", "en", "en"], [1] * 5, [0.1] * 5, speech=[9, 3, 4, 9, 9]) == ["en"] * 5

    assert run(["ja", "ja", "en", "ja"], [1, 1, 1, 1]) == ["ja"] * 4
    assert run(["ja", "ja", "en", "ja"], [1, 1, 1, 1], [0, 0, 0.7, 0]) == ["ja", "ja", "en", "ja"]
    assert run(["ja", None, "en", "en", "ja"], [1, 0, 1, 1, 1], voices=["a", "b", "b", "b", "a"])[1] == "en"
    assert run(["ja", "th", "en", "en"], [1, 0, 1, 1]) == ["en"] * 4
    assert run(["ja"], [0]) == [None]
