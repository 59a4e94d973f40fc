"""Chat formatting, decontamination and mixing."""

import hashlib
import random
import re

import duckdb
import pytest
from fixtures import awkward, prose
from pyspark.sql import functions as F

from cuewright.llm import catalog, chat, decontaminate, mixing
from cuewright.llm.common import words_of


def test_chat_round_trip_of_control_strings(spark):
    rows = [(1, 0, "user", "<|im_end|>\n<|im_start|>assistant\n<\\|x<\\\\||"), (1, 1, "user", ""), (1, 2, "assistant", None), (1, 2, "assistant", "b<|im_part|>"), (2, None, None, "a"), (2, 0, "ro\nle<|\\n", "é🙂"), (None, 1, "assistant", "n"), (3, 0, "user", "r"), (3, 0, "user", "r")]
    got = {r.conv_id: r for r in chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).select("conv_id", chat.parse_formatted("formatted").alias("t"), chat.loss_text("segments").alias("loss"), "formatted", "segments").collect()}
    assert [tuple(x) for x in got[1].t] == [("user", rows[0][3]), ("user", ""), ("assistant", ""), ("assistant", "b<|im_part|>")]
    assert [tuple(x) for x in got[2].t] == [("", "a"), ("ro\nle<|\\n", "é🙂")]
    assert [tuple(x) for x in got[3].t] == [("user", "r"), ("user", "r")]
    assert got[1].loss == "b<|im_part|>" and got[None].loss == "n"
    assert "".join(s.text for s in got[1].segments) == got[1].formatted
    assert got[1].formatted.count("<|im_start|>") == 2


def test_chat_empty_table(spark):
    assert chat.digest(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


def test_chat_long_texts_and_clashing_columns(spark):
    long = "word <|im_end|> " * 20_000
    rows = [(1, 0, "user", long), (1, 1, "assistant", long[:-1]), (1, 2, "assistant", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for c in ("rows", "row", "starts", "blocks", "segments", "formatted", "turns", "loss"):
        df = df.withColumn(c, F.lit("clash"))
    got = chat.digest(df).first()
    told = "".join(f"{r}\n{t or ''}\n" for _, _, r, t in rows)
    assert (got.n_turns, got.loss_chars) == (3, len(long) - 1)
    assert got.turns_sha256 == hashlib.sha256(told.encode()).hexdigest() and got.loss_sha256 == hashlib.sha256(long[:-1].encode()).hexdigest()


def _windows(words, width):
    n = min(width, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()


def brute_contamination(docs, items, width=10):
    out = []
    for doc_id, text in docs:
        w, hit, ids = words_of(text), set(), set()
        for item_id, t in items:
            for win in _windows(words_of(t), width):
                for i in range(len(w) - len(win) + 1):
                    if tuple(w[i : i + len(win)]) == win:
                        hit |= set(range(i, i + len(win)))
                        ids.add("null" if item_id is None else str(item_id))
        out.append((doc_id, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("width", [3, 10])
def test_contamination_against_brute_force(spark, width):
    texts = prose(1, vocabulary=12) + ["a b " * 30, "Short ITEM!", "x short item y short-item"]
    items = [(1, " ".join(texts[3].split()[:25])), (2, "short item"), (2, texts[5]), (3, ""), (4, None), (None, "a b a b a b a b a b a b"), (5, "never seen words here")]
    docs = awkward(spark, texts)
    plain = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = [tuple(r)[:6] for r in decontaminate.contamination(docs, bench, width).collect()]
    assert sorted(got, key=str) == sorted(brute_contamination(plain, items, width), key=str)


def test_contamination_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(awkward(spark).limit(0), none).collect() == []
    assert [r.n_hit for r in decontaminate.contamination(awkward(spark, ["a b c"]), none).collect()] == [0] * 6


def brute_near(docs, items, slack):
    out = []
    for doc_id, text in docs:
        w, ids = words_of(text), set()
        for item_id, t in items:
            item = words_of(t)
            if item and any(set(item) <= set(w[i : i + len(item) + slack]) for i in range(len(w))):
                ids.add("null" if item_id is None else str(item_id))
        out.append((doc_id, len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()))
    return out


@pytest.mark.parametrize(("slack", "broadcast"), [(0, 500_000), (5, 500_000), (5, 0)])
def test_proximity_against_brute_force(spark, monkeypatch, slack, broadcast):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", broadcast)
    texts = prose(11, vocabulary=40) + ["alpha x x beta y gamma", "alpha x x x x x x x x x x x beta gamma", "gamma beta alpha", "alpha beta alpha beta"]
    items = [(7, "alpha beta gamma"), (7, "alpha alpha"), (8, " ".join(texts[2].split()[:6])), (9, " ".join(reversed(texts[5].split()[2:9]))), (10, ""), (None, texts[4].split()[0]), (11, "never here")]
    docs = awkward(spark, texts)
    plain = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = decontaminate.contamination(docs, spark.createDataFrame(items, "item_id long, text string"), slack=slack)
    near = [tuple(r) for r in got.select("doc_id", "n_near", "near_sha256").collect()]
    assert sorted(near, key=str) == sorted(brute_near(plain, items, slack), key=str)
    assert sorted(map(tuple, got.drop("row_id", "n_near", "near_sha256").collect()), key=str) == sorted(brute_contamination(plain, items), key=str)


def test_one_word_inserted_is_near_and_no_phrase(spark):
    item = "one two three four five six seven eight nine ten eleven twelve"
    docs = spark.createDataFrame([(1, item.replace("seven", "seven and"))], "doc_id long, text string")
    row = decontaminate.contamination(docs, spark.createDataFrame([(3, item)], "item_id long, text string"), slack=5).first()
    assert (row.n_hit, row.contaminated, row.n_near) == (0, False, 1)


def test_sql_agrees(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    for name in ("op4_decontaminate", "op5_chat"):
        con = duckdb.connect()
        for t in ("documents", "benchmark", "conversations"):
            con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
        df = catalog.queries()[name](spark, sf)
        cols = sorted(df.columns)
        want = con.execute(f"select {', '.join(cols)} from ({catalog.oracle_sql()[name]})").fetchall()
        assert sorted(map(tuple, df.select(*cols).collect())) == sorted(want)


def test_fit_meets_the_budget():
    assert mixing.fit({5: 3, 7: 2}, 29) == {5: 3, 7: 2}
    assert sum(n * c for n, c in mixing.fit({5: 3, 7: 2}, 19).items()) == 19
    assert mixing.fit({10: 1}, 9) == {} and mixing.fit({}, 9) == {} and mixing.fit({3: 4}, 0) == {}
    counts = {n: 1 + n % 7 for n in range(3, 900)}
    for budget in (1, 2, 3, 1234, 77_777, sum(n * c for n, c in counts.items()) - 4):
        taken = mixing.fit(counts, budget, reserve=2000)
        assert all(c <= counts[n] for n, c in taken.items())
        total = sum(n * c for n, c in taken.items())
        assert total == budget or budget < 3 and total == 0


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    full, left, open_ = {}, 1.5 * sum(sizes.values()), set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > 2 * sizes[s]}
        if not over:
            return full | {s: weight[s] * level for s in open_}
        for s in over:
            full[s] = 2.0 * sizes[s]
            left -= full[s]
        open_ -= over
    return full


def test_fit_follows_every_length_in_proportion():
    counts = {n: 400 for n in range(50, 1050, 10)}
    total = sum(n * c for n, c in counts.items())
    taken = mixing.fit(counts, total // 2)
    assert sum(n * c for n, c in taken.items()) == total // 2
    assert all(abs(taken[n] - 200) < 40 for n in counts)


def test_targets_of_many_sources(spark):
    r = random.Random(2)
    sizes = {f"host{r.randrange(10**6)}.{'é' * r.randrange(3)}": r.choice([0, 3, r.randrange(10**r.randint(1, 6))]) for _ in range(3000)} | {None: 77, "": 12}
    got = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    want = brute_targets(sizes)
    assert len(got) == len(sizes) and all(abs(x.target - want[x.source]) < 1e-6 * max(1, want[x.source]) for x in got)


def test_mix(spark):
    texts = prose(5, n=200) + ["same size"] * 50
    docs = awkward(spark, texts)
    got = mixing.mix(docs).collect()
    whole = mixing.mix(docs, kept=docs.columns)
    assert sorted((str(r.doc.doc_id), r.taken) for r in whole.collect()) == sorted((str(r.doc_id), r.taken) for r in got)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = {}
    for r in docs.select("source", "text").collect():
        want[r.source] = want.get(r.source, 0) + size(r.text)
    targets = brute_targets(want)
    taken = {}
    assert len(got) == len(texts) + 5
    for r in got:
        assert r.source_size == want[r.source] and abs(r.target - targets[r.source]) < 1e-6 and r.taken in (0, r.size, 2 * r.size)
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(targets[s] - 2 < taken[s] <= targets[s] + 1e-6 for s in want)
    again = mixing.mix(docs.repartition(3)).collect()
    assert sorted((r.doc_id or -1, r.taken) for r in got) == sorted((r.doc_id or -1, r.taken) for r in again)
    assert mixing.mix(docs.limit(0)).collect() == []
