"""Terms that give a single entity away, or stand far from it."""

import math
import re
from collections import Counter

from fixtures import awkward, prose

from cuewright.llm import pii


def test_a_name_beside_one_repeated_address_goes_everywhere_in_its_document(spark):
    filler = " ".join(f"plain{k}" for k in range(120))
    texts = [f"lead{i} Zyxwald me@mail.org tail{i} {filler}" + " zyxwald again" * (i == 0) for i in range(4)]
    texts += [f"start{i} you{i}@mail.org stop{i} {filler}" for i in range(4)] + [f"{filler} nothing here"] * 6
    found = {r.doc.doc_id: r for r in pii.find(awkward(spark, texts)).collect()}
    for i in range(4):
        assert [texts[i][t.start : t.end] for t in found[i].terms] == ["Zyxwald", "zyxwald"][: 1 + (i == 0)]
        assert len(found[i].spans) == 1
    assert all(found[i].terms is None for i in range(4, 14))


def test_disclosure_of_one_entity_and_not_of_its_kind(spark):
    filler = " ".join(f"plain{k}" for k in range(60))
    texts = ["Orlovsk me@mail.org"] * 40 + ["me@mail.org " + filler + " orlovsk"] * 10 + [f"u{i}@mail.org " + filler + " orlovsk" for i in range(3)]
    texts += [f"{a} v{i}{a}@mail.org" for i in range(150) for a in ("contact", "write", "mail")] + [filler] * 20
    docs = awkward(spark, texts)
    found = {r.doc.doc_id: r for r in pii.find(docs).collect()}
    score = {(r.term, r.entity is None): r.disclosure for r in pii.disclosures(pii.find_base(docs), docs).collect()}
    assert score["orlovsk", True] < 0.9 <= score["orlovsk", False]
    assert [texts[40][t.start : t.end] for t in found[40].terms] == ["orlovsk"]  # far from the address it gives away
    assert all("orlovsk" not in [texts[i][t.start : t.end] for t in found[i].terms or []] for i in (50, 51, 52))


def brute_disclosures(texts, reach=4, support=3):
    """disclosure by (term, kind, entity); entity None: the kind."""
    near, whole, count, total = Counter(), Counter(), Counter(), 0
    for text in texts:
        text = text or ""
        spans = pii.base_spans(text)
        words = [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)]
        count.update(w for *_, w in words)
        total += len(words)
        for kind, a, b in spans:
            around = [w for w in words if w[1] <= a][-reach:] + [w for w in words if w[0] >= b][:reach]
            for x, y, w in around:
                if all(y <= s or x >= e for _, s, e in spans):
                    for entity in (None, text[a:b]):
                        near[w, kind, entity] += 1
                        whole[kind, entity] += 1
    out = {}
    for (w, kind, entity), n in near.items():
        if n >= support:
            prior = min(whole[kind, entity] / total, 0.5)
            out[w, kind, entity] = (math.log(min(n / count[w], 1.0)) - math.log(prior)) / -math.log(prior)
    return out


def test_disclosures_against_brute_force(spark):
    gap = " . " * 400
    texts = prose(41, n=30, words=40, vocabulary=60)
    texts = [f"{t} {gap}a{i % 3}@mail.org{gap} {t} +1 212 555 01{i % 2}9 x" for i, t in enumerate(texts)] + prose(42, n=30, words=40, vocabulary=60)
    docs = awkward(spark, texts)
    got = {(r.term, r.kind, r.entity): r.disclosure for r in pii.disclosures(pii.find_base(docs), docs).collect()}
    want = {(w, k, None if e is None else pii._entity(e)): d for (w, k, e), d in brute_disclosures([r.text for r in docs.select("text").collect()]).items()}
    assert set(got) == set(want) and len(got) > 50 and all(abs(got[k] - d) < 1e-9 for k, d in want.items())
