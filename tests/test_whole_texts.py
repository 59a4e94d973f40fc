"""Text queries over all rows and whole texts, against plain versions on a few long documents."""

import random
from difflib import SequenceMatcher

import pytest

from cuewright.functions import scoring as sc
from cuewright.plans import composites, texts

WORDS = ["the", "other", "Then", "lorem", "ipsum", "dolor", "te", "vous", "sit", "amet", "nulla", "quis"]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.fixture()
def folder(spark, tmp_path):
    r = random.Random(5)
    rows = [(i, "quis " * 150 + " ".join(r.choices(WORDS, k=250)) + " end", "fr", "web", 0) for i in (7, 290, 300, 4021)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    talk = [(i, t, who, "quis" * 150 + " ".join(r.choices(WORDS, k=60))) for i in (1, 2) for t, who in enumerate(("user", "assistant"))]
    spark.createDataFrame(talk, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    return str(tmp_path), {x[0]: x[1] for x in rows}, talk


def ratio(a, b):
    return SequenceMatcher(None, a, b, autojunk=False).ratio()


def test_fast_scores_equal_plain_ones():
    r = random.Random(3)
    for n in (0, 1, 40, 300, 900):
        a = "".join(r.choices("abcde é", k=n))
        b = "".join(c if r.random() > 0.05 else r.choice("abx") * r.randint(0, 3) for c in a)
        for x, y in ((a, b), (b, a), (a, a[::-1])):
            assert sc.matched(x, y) == sum(m.size for m in SequenceMatcher(None, x, y, autojunk=False).get_matching_blocks())
            assert sc.edit_distance(x[:200].split(), y[:200].split()) == distance(x[:200].split(), y[:200].split())
            assert sc.edit_distance(list(x[:90]), list(y[:90])) == distance(x[:90], y[:90])


def test_agreement_of_all_rows_and_whole_texts(spark, folder):
    path, docs, talk = folder
    got = {r.id - 1000: r.similarity for r in texts.h8_agreement(spark, path).filter("id >= 1000").collect()}
    assert got == {i: pytest.approx(ratio(t, t[4:])) for i, t in docs.items()}
    norm = lambda t: "".join(c for c in t if c.isalnum())
    verdicts = {r.id - 1000: r.verdict for r in texts.h9_decide(spark, path).filter("id >= 1000").collect()}
    want = {i: "agree" if ratio(norm(t), norm(t.replace("the", "a"))) >= 0.92 else "reconcile" for i, t in docs.items()}
    assert verdicts == want
    merged = composites.k11_merge(spark, path).collect()
    assert sum(r.agree + r.first + r.second + r.reconcile for r in merged) == len(talk)
    k8 = {r.file_id: r.similarity for r in composites.k8_compare(spark, path).collect()}
    assert k8 == {i: pytest.approx(ratio(*[norm(x[3]) for x in talk if x[0] == i])) for i in (1, 2)}


def test_scores_of_whole_texts(spark, folder):
    path, docs, _ = folder
    hyp = {i: t.replace("the", "a").replace("The", "a") for i, t in docs.items()}
    rate = {i: distance(sc._words(t), sc._words(hyp[i])) / len(sc._words(t)) for i, t in docs.items()}
    assert all(rate.values()) and {r.doc_id: r.wer for r in texts.h30_wer(spark, path).collect()} == {i: pytest.approx(x) for i, x in rate.items()}
    assert {r.doc_id for r in texts.h31_chrf(spark, path).filter("chrf > 0 and chrf < 100").collect()} == set(docs)
    by_file = {i % 20: i for i in docs if sum(j % 20 == i % 20 for j in docs) == 1}
    for query in (texts.d9_score_binned, texts.d10_score_paired):
        got = {r.file_id: r.wer for r in query(spark, path).collect()}
        assert {f: got[f] for f in by_file} == {f: pytest.approx(rate[i]) for f, i in by_file.items()}
    five = {r.file_id: r.similarity for r in composites.k5_ocrbench(spark, path).collect()}
    assert {f: five[f] for f in by_file} == {f: pytest.approx(ratio(docs[i], hyp[i])) for f, i in by_file.items()}


def test_registers_and_halves_of_whole_texts(spark, folder):
    path, docs, _ = folder
    pairs = spark.createDataFrame([("fr", "Tu viens", "tu vas"), ("fr", "toi", "vous"), ("fr", "te", "rien"), ("ko", "갑니다", "가자"), ("ko", "가요", "가자"), ("xx", "tu", "tu")], "lang string, ref string, hyp string")
    got = {(r.lang, r["class"]): (r.n, r.agree, r.absent, r.rate) for r in texts.register_agreement(pairs).collect()}
    assert got == {("fr", "tv"): (3, 1, 1, 33.3), ("ko", "polite"): (2, 1, 0, 50.0)}  # the first ends as polite and plain lines do
    want = {i: bool(set(t[: len(t) // 2].lower().split(" ")) & set(t[len(t) // 2 :].lower().split(" "))) for i, t in docs.items()}
    assert {r.doc_id: r.agree for r in texts.g6_feature_overlap(spark, path).collect()} == want
