"""SimHash, licences and personal data against brute force."""

import hashlib
import math
import random
import re
import sys

import numpy as np
import xxhash
from fixtures import awkward, prose
from pyspark.sql import functions as F

from cuewright.llm import common, licenses, pii, simhash
from cuewright.llm.components import components

sys.set_int_max_str_digits(0)  # the brute-force reader takes numbers of any length
TOKEN, WORD = r"[^\x20\x09-\x0D]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def brute_fingerprint(text, shingle):
    w = re.findall(TOKEN, lower(text))
    grams = [" ".join(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps, distance):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(fps)):
        groups.setdefault(find(i), []).append(ids[i])
    return [min((x for x in groups[find(i)] if x is not None), default=None) for i in range(len(fps))]


def test_simhash(spark):
    texts = prose(2, n=40)
    texts += [t + " tail" for t in texts[:10]] + [t.upper() for t in texts[10:15]] + ["one", "one two", "ONE TWO three", "  İx", "w " * 5000]
    docs = awkward(spark, texts)
    for shingle, distance in ((3, 2), (5, 4)):
        got = simhash.labelled(docs, shingle, distance).collect()
        rows = docs.select("doc_id", "text").collect()
        fps = [brute_fingerprint(r.text, shingle) for r in rows]
        want = list(zip([r.doc_id for r in rows], fps, brute_components([r.doc_id for r in rows], fps, distance), strict=True))
        assert sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got), key=str) == sorted(want, key=str)
    assert simhash.labelled(docs.limit(0)).collect() == []


def test_links_lose_nothing_in_large_groups(spark, monkeypatch):
    r = np.random.default_rng(0)
    centre = r.integers(0, 1 << 63, 1)[0]
    fps = {int(centre)}
    for _ in range(400):
        x = int(centre)
        for b in r.integers(0, 63, 2):
            x ^= 1 << int(b)
        fps.add(x)
    fps |= set(map(int, r.integers(0, 1 << 63, 300)))
    fps = sorted(fps)
    want = brute_components(fps, fps, 2)
    table = spark.createDataFrame([(f, [f]) for f in fps], "node long, bits array<long>")
    for heavy in (simhash.HEAVY, 40):
        monkeypatch.setattr(simhash, "HEAVY", heavy)
        got = [(x.u, x.v) for x in simhash.links(table, simhash.plan_probes(table, 2), 2).collect()]
        root = {f: f for f in fps}
        for _ in range(len(fps)):
            new = dict(root)
            for u, v in got:
                new[u] = new[v] = min(new[u], new[v])
            if new == root:
                break
            root = new
        assert [root[f] for f in fps] == want and all((u ^ v).bit_count() <= 2 for u, v in got)


def test_one_of_each_keeps_one_row_of_each_group(spark, monkeypatch):
    r = random.Random(3)
    base = prose(12, n=30, words=400, vocabulary=3000)
    base = [t for t in base if len(t.split()) > 150]
    texts, group = [], []
    for g, t in enumerate(base):
        for k in range(4):
            w = t.split()
            if k > 1:
                w[r.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
            group.append(g)
    docs = awkward(spark, texts)
    for heavy in (simhash.HEAVY, 20):
        monkeypatch.setattr(simhash, "HEAVY", heavy)
        got = simhash.one_of_each(docs).collect()
        kept = [x.doc_id for x in got]
        assert sorted(group[i] for i in kept if i is not None and i < 9000) == list(range(len(base)))
        assert sorted(str(i) for i in kept if i is None or i > 9000) == ["9001", "9003", "None"] and got[0].x == "clash"
    assert simhash.one_of_each(docs.limit(0)).collect() == []


def near_copy(words, k, r, whole):
    """words with k of them changed, apart from each other, or, if whole, one passage put in."""
    w = list(words)
    if whole:
        at = r.randrange(len(w))
        return w[:at] + [f"in{r.random()}" for _ in range(k)] + w[at:]
    for i in r.sample(range(0, len(w), 6), k):
        w[i] = f"new{r.random()}"
    return w


def true_jaccard(a, b):
    x, y = ({" ".join(t[i : i + 5]) for i in range(len(t) - 4)} for t in (a, b))
    return len(x & y) / len(x | y)


def test_pairs_about_the_bound(spark, monkeypatch):
    """Pairs of similarity 0.8 and more are found, others are left alone, whether words change or a passage is put in."""
    r = random.Random(8)
    texts, pairs = [], []
    for n in range(240):
        base = [f"w{r.randrange(5000)}" for _ in range(240)]
        other = near_copy(base, r.randint(1, 7) if n % 2 else r.randint(10, 80), r, n % 2 == 0)
        pairs.append((len(texts), len(texts) + 1, true_jaccard(base, other)))
        texts += [" ".join(base), " ".join(other)]
    docs = awkward(spark, texts)
    kept = {x.doc_id for x in simhash.one_of_each(docs).collect()}
    found = {a: b not in kept for a, b, _ in pairs}
    true = [found[a] for a, _, j in pairs if j >= 0.8]
    at_bound = [found[a] for a, _, j in pairs if 0.8 <= j < 0.85]
    assert all(a in kept for a, _, _ in pairs) and not any(found[a] for a, _, j in pairs if j < 0.8)
    assert min(j for *_, j in pairs) < 0.76 and len(at_bound) > 20 and sum(at_bound) >= 0.9 * len(at_bound) and sum(true) >= 0.95 * len(true)
    monkeypatch.setattr(simhash, "HEAVY", 8)
    monkeypatch.setattr(common, "SPLIT", 1)
    again = {x.doc_id for x in simhash.one_of_each(docs).collect()}
    assert len(again ^ kept) <= 4


def test_no_link_at_the_bound_is_lost(spark, monkeypatch):
    """Each pair of similarity 0.8 and more counts, however far apart the fingerprints lie and however few of them meet."""
    r = random.Random(12)
    texts = [" ".join(f"s{k}" for k in range(50)) + " z" * n for n in (5, 300)]  # one set of shingles, two fingerprints
    texts += ["z " * 300, " ".join(f"v{k}" for k in range(5)), "v0 v1", "v0 v1 v2"]
    for n in range(40):
        base = [f"w{r.randrange(5000)}" for _ in range(r.randint(40, 240))] + ["the same last words stand in all of these texts"]
        texts += [" ".join(base)] + [" ".join(near_copy(base, r.randint(1, 5), r, k)) for k in (False, True)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    words = [t.split() for t in texts]
    sets = [{" ".join(t[i : i + 5]) for i in range(max(1, len(t) - 4))} for t in words]
    want = brute_components(range(len(texts)), [0] * len(texts), -1)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if len(a & b) >= 0.8 * len(a | b) and want[i] != want[j]:
                low, high = sorted((want[i], want[j]))
                want = [low if x == high else x for x in want]
    for heavy, aim in ((simhash.HEAVY, 0.97), (simhash.HEAVY, 0.01), (8, 0.01)):
        monkeypatch.setattr(simhash, "HEAVY", heavy)
        assert sorted(x.doc_id for x in simhash.one_of_each(docs, aim=aim).collect()) == sorted(set(want))


def test_texts_of_one_passage_are_not_offered_as_pairs(spark):
    """What most texts share puts each of them beside few others; the true links among them are found all the same."""
    r = random.Random(5)
    passage = [f"p{k}" for k in range(510)]
    texts = [" ".join([f"w{r.random()}" for _ in range(90)] + passage) for _ in range(100)]
    texts += [" ".join(near_copy(texts[n].split(), 5, r, n % 2)) for n in range(20)]
    docs = simhash.materialize(simhash.set_fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 5, 8), "fingerprints")
    fps = simhash._nodes(docs, ("bits", "digest", "size", "parity", "wide"))
    met = simhash.met_prefixes(docs, fps, 5, 0.8)
    who = {x.node: x.best.doc_id for x in fps.collect()}
    pairs = [tuple(sorted((who[x.u], who[x.v]))) for x in simhash.unmet_pairs(met, fps.withColumn("root", F.col("node")), 0.8).collect()]
    true = {(n, 100 + n) for n in range(20)}
    assert all(true_jaccard(texts[a].split(), texts[b].split()) >= 0.8 for a, b in true)
    assert true <= set(pairs) and len(set(pairs)) < len(texts)


def test_rows_without_partner_are_told():
    """No pair that may meet for the first time under a key loses a row, however few steps are taken."""
    r = np.random.default_rng(4)
    for steps in (3, 20, 256):
        key, size = r.integers(0, 12, 400), r.integers(1, 60, 400)
        place = r.integers(0, 1 + size // 5)
        order = np.lexsort((place, size, key))
        key, place, size = key[order], place[order], size[order]
        kept, want = simhash._has_partner(key, place, size, 0.8, steps), np.zeros(400, bool)
        for i in range(400):
            for j in range(i):
                if key[i] == key[j] and size[j] >= 0.8 * size[i] and 9 * min(size[i] - place[i], size[j] - place[j]) >= 4 * (size[i] + size[j]):
                    want[[i, j]] = True
        assert not (want & ~kept).any() and not want.all()
        if steps == 256:
            assert (kept == want).all()


def test_chances_meet_the_aim():
    share = simhash.share_of_bits(0.8)
    assert abs(share - 0.1515) < 1e-3
    for n in (1000, 10**6, 10**8):
        cost, ts = simhash.allocate_chances([16] * 32, [0.0] * 32, n, share, 0.95)
        miss = 1.0
        for t in ts:
            miss *= 1 - sum(math.comb(16, k) * share**k * (1 - share) ** (16 - k) for k in range(t + 1))
        assert miss <= 0.05 and cost < float("inf")
    assert simhash.allocate_chances([32] * 2, [0.0] * 2, 10, share, 0.95)[0] == float("inf")


def test_components_of_paths_and_hubs(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 150)] + [(7, 7), (200, 199), (199, 200), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {i: 100 for i in range(101, 150)} | {200: 199}


def test_allocation_is_a_pigeonhole():
    corr = np.abs(np.random.default_rng(1).normal(size=(64, 64)))
    for m in (2, 3, 4):
        masks = simhash.group_bits(corr, m)
        assert sum(masks) == (1 << 64) - 1
        assert sum(simhash.allocate(masks, [10.0] * m, 1000, 2)[1]) == 2 - m + 1


def brute_base(text, phrases):
    w = re.findall(WORD, lower(text))
    return len(w), sorted((i, label) for p, label in phrases.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split())


def test_licences(spark):
    texts = ["MIT License mit-license", "the GNU  General\nPublic, License; cc-by-nc 4.0", "nothing", "apache licenses", "x SPDX-License-Identifier: (MIT OR GPL-2.0-only WITH Classpath-exception-2.0) AND BSD-3-Clause */", "spdx-license-identifier: AND", "cc by " * 3000, "éMIT license mit License", "SPDX-License-Identifier: hello world", "SPDX-License-Identifier: GPL-3.0-only", "mit license " + "filler words " * 100_000 + " MIT license ISC license"]
    docs = awkward(spark, texts + prose(3, n=5))
    got = licenses.scan(docs).collect()
    for r, d in zip(sorted(got, key=lambda r: str(r.doc_id)), sorted(docs.select("doc_id", "text").collect(), key=lambda r: str(r.doc_id)), strict=True):
        n, places = brute_base(d.text, licenses.BASE)
        assert (r.n_words, r.n_base, r.base_labels) == (n, len(places), ",".join(sorted({x for _, x in places})))
        assert (r.first_word, r.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) or not r.base_labels
        assert 0 <= r.score <= 1
    by = {r.doc_id: r for r in got}
    assert by[4].expression_postfix == "mit gpl-2.0-only classpath-exception-2.0 with or bsd-3-clause and" and by[4].permissive is True
    assert by[7].permissive is None and by[7].expression_postfix == ""
    assert (by[8].labels, by[8].score) == ("spdx-invalid", 0.3) and (by[9].labels, by[9].permissive) == ("gpl-3.0-only", False)
    assert by[10].n_base == 2 and by[10].last_word == 200_002 and by[10].labels == "isc,mit"
    assert by[4].labels == "bsd-3-clause,gpl-2.0-only,mit" and by[4].expressions[0].permissive
    assert by[5].labels == "spdx-invalid" and "cc-by-nc" in by[1].labels
    assert licenses.scan(docs.limit(0)).collect() == []


def test_expressions():
    p = licenses.parse_expression
    assert p("hello world") == [] and p("MIT WITH MIT") == ["mit"] and p("Classpath-exception-2.0") == []
    assert p("LicenseRef-own.1 OR DocumentRef-a:LicenseRef-b") == ["licenseref-own.1", "documentref-a:licenseref-b", "or"]
    assert p("GPL-2.0+ WITH GCC-exception-2.0 AND hello") == ["gpl-2.0+", "gcc-exception-2.0", "with"]
    assert p("House-Licence OR MIT") == [] and p("House-Licence OR MIT", known={"house-licence", "mit"}) == ["house-licence", "mit", "or"]
    assert p("MIT OR Apache-2.0 AND ISC") == ["mit", "apache-2.0", "isc", "and", "or"]
    assert p("(MIT OR GPL-3.0) AND ISC trailing words") == ["mit", "gpl-3.0", "or", "isc", "and"]
    assert p("GPL-2.0 WITH LLVM-exception AND") == ["gpl-2.0", "llvm-exception", "with"] and p("(MIT") == [] and p("OR MIT") == [] and p("") == []
    assert licenses.evaluate(p("GPL-3.0 OR MIT")) and not licenses.evaluate(p("GPL-3.0 AND MIT")) and not licenses.evaluate([])
    assert licenses.licences_of(p("GPL-2.0 WITH LLVM-exception OR (MIT AND ISC)")) == ["gpl-2.0", "mit", "isc"]


def brute_pii(text):
    text, out = text or "", []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m[0] if c.isdigit()]
            if kind == "ip" and max(map(int, m[0].split("."))) > 255 or kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))) % 10 == 0):
                continue
            out.append((kind, m.start(), m.end()))
    return out


PERSONAL = ["write a.b@c.d.e or x@y z@@q.r, a@b@c.com.", "ip 1.2.3.4.5.6.7.8 300.1.1.1 0001.2.3.255", "card 4111 1111 1111 1111 and 4111-1111-1111-1112 12", "+1 (212) 555-0199, +44 20 7946 0958 +1", "é😀 me@x.org é 10.0.0.1", "9" * 5000 + "." + "a" * 5000 + "@", "+" * 50 + "1 2", "x " + "0" * 5000 + ".1.2.3 y", "a@b.c" * 40, ".1.2.3.4 4111111111111111 5500 0000 0000 0004"]


def test_personal_data(spark):
    docs = awkward(spark, PERSONAL + prose(4, n=5))
    got = pii.digest(docs).collect()
    want = []
    for r in docs.select("doc_id", "text").collect():
        spans = brute_pii(r.text)
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        want.append((r.doc_id, *[sum(k == s[0] for s in spans) for k in pii.KINDS], hashlib.sha256(text.encode()).hexdigest()))
    assert sorted((tuple(r)[:6] for r in got), key=str) == sorted(want, key=str)
    assert pii.digest(docs.limit(0)).collect() == []


def test_disclosing_terms_go_and_clean_texts_stay(spark):
    texts = [f"word{i} other{i} kontaktzeile user{i}@mail.org end{i} kontaktless" for i in range(6)] + ["kontaktless and word other stay kontaktless"] * 5
    docs = awkward(spark, texts)
    found = {r.doc.doc_id: r for r in pii.find(docs).collect()}
    assert {texts[0][t.start : t.end] for t in found[0].terms} == {"kontaktzeile"}
    clean = {r.doc_id: r for r in pii.sanitise(docs).collect()}
    assert "<EMAIL>" in clean[0].text and "kontaktzeile" not in clean[0].text and clean[0].x == "clash" and clean[6].text == texts[6] and clean[9001].text is None
    counts = {r.term: r.n for r in pii.word_counts(docs, most=3).groupBy("term").sum("n").toDF("term", "n").collect()}
    assert counts["kontaktless"] == 16 and counts[""] == sum(len(re.findall(WORD, lower(r.text))) for r in docs.select("text").collect())
