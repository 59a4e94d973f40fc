"""Repeated byte strings against brute force."""

import hashlib
import random

import numpy as np
import pytest
from fixtures import awkward, prose

from cuewright.llm import common
from cuewright.llm import substrings as S


def brute(texts, length):
    places = {}
    for i, t in enumerate(texts):
        for p in range(len(t) - length + 1):
            places.setdefault(t[p : p + length], []).append((i, p))
    hit = [bytearray(len(t)) for t in texts]
    for where in places.values():
        if len(where) > 1:
            for i, p in where:
                hit[i][p : p + length] = b"\1" * length
    out = []
    for t, h in zip(texts, hit, strict=True):
        kept = bytes(b for b, x in zip(t, h, strict=True) if not x)
        spans = sum(x and not (k and h[k - 1]) for k, x in enumerate(h))
        out.append((len(t), len(t) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus():
    r = random.Random(4)
    texts = prose(7, n=30, words=120, vocabulary=4000)
    passage, line = " ".join(prose(8, n=1, words=400, vocabulary=900)[0].split()[:60]), "x" * 150
    for i in range(0, 30, 3):
        w = texts[i]
        at = r.randint(0, len(w))
        texts[i] = w[:at] + passage + w[at:]
        texts.append(texts[i][: len(texts[i]) // 2] + "é" + texts[i][len(texts[i]) // 2 :])
        texts.append(texts[i])
        texts[i + 1] += line + " " + str(i)
    return [*texts, passage[:199], passage[:200], "ab" * 400, "z" * 1000, "z" * 201, "z" * 200, "é" * 150, passage * 3]


@pytest.mark.parametrize("piece", [1 << 19, 1000])
def test_against_brute_force(spark, piece):
    docs = awkward(spark, corpus())
    rows = docs.select("doc_id", "text").collect()
    want = sorted(zip([str(r.doc_id) for r in rows], brute([(r.text or "").encode() for r in rows], S.LENGTH), strict=True))
    got = S.remove_repeats(docs, piece, 20 * piece).collect()
    assert sorted((str(r.doc_id), (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in got) == want
    heavy = S.remove_repeats(docs, heavy_from=3).collect()
    assert sorted((str(r.doc_id), (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in heavy) == want
    assert S.remove_repeats(docs.limit(0)).collect() == []


def test_refine_counts_places_not_pieces():
    r = random.Random(1)
    text = bytes(r.randrange(256) for _ in range(900))
    pieces = [text[0:360], text[100:460], text[500:860]]
    told = lambda pieces, text, first, twice: S.refine(pieces, np.array(text), np.array(first), np.array(twice), S._Hash()).tolist()
    assert told(pieces, [0, 0, 0], [0, 100, 500], [False] * 3) == []
    assert told(pieces, [0, 1, 0], [0, 100, 500], [False] * 3) == [*range(100, 161), *range(360, 421)]
    assert told([pieces[0], pieces[1]], [0, 0], [0, 100], [True, False]) == [*range(100, 161), *range(360, 421)]
    assert told([text[:150]], [0], [0], [True]) == []


def test_equal_windows_share_an_anchor():
    r, h = random.Random(2), S._Hash()
    shared = bytes(r.randrange(97, 101) for _ in range(S.LENGTH))
    for _ in range(30):
        texts = [bytes(r.randrange(97, 101) for _ in range(r.randint(0, 90))) + shared + bytes(r.randrange(97, 101) for _ in range(r.randint(0, 90))) for _ in range(2)]
        a = S.anchors(texts, h)
        inside = [{int(p) - texts[i].index(shared) for p, t in zip(a["pos"], a["text"], strict=True) if t == i} & set(range(S.SIDE + 1)) for i in range(2)]
        assert inside[0] & inside[1]


@pytest.mark.parametrize("turns", [1, 4, 50])
def test_refinement_against_brute_force(monkeypatch, turns):
    monkeypatch.setattr(S, "_TURNS", turns)
    r, hasher = random.Random(turns), S._Hash()
    for _ in range(30):
        blocks = [bytes(r.randrange(97, 99) for _ in range(r.choice([40, 80, 110, 200, 7]))) for _ in range(4)] + [b"z" * 90]
        pieces = [b"".join(r.choice(blocks) for _ in range(r.randint(0, 7))) for _ in range(8)]
        places = {}
        for p, piece in enumerate(pieces):
            for i in range(len(piece) - S.LENGTH + 1):
                places.setdefault(piece[i : i + S.LENGTH], []).append(sum(map(len, pieces[:p])) + i)
        want = sorted(x for at in places.values() if len(at) > 1 for x in at)
        got = S.refine(pieces, np.arange(8), np.zeros(8, np.int64), np.zeros(8, bool), hasher)
        assert got.tolist() == want


def test_buckets_of_one_hash_are_told_apart_by_their_bytes(monkeypatch):
    r = random.Random(9)
    shared = bytes(r.randrange(256) for _ in range(300))
    pieces = [bytes(r.randrange(256) for _ in range(300)), shared, bytes(r.randrange(256) for _ in range(300)), shared[20:]]
    class One(S._Hash):
        def of(self, sums, start, end):
            return super().of(sums, start, end) % np.uint64(2)
    got = S.refine(pieces, np.arange(4), np.zeros(4, np.int64), np.zeros(4, bool), One())
    assert got.tolist() == [*range(320, 401), *range(900, 981)]


def test_hot_buckets_are_broadcast(spark, monkeypatch):
    docs = awkward(spark, corpus())
    want = sorted((str(r.doc_id), r.kept_sha256) for r in S.remove_repeats(docs).collect())
    monkeypatch.setattr(common, "SPLIT", 4)
    assert sorted((str(r.doc_id), r.kept_sha256) for r in S.remove_repeats(docs).collect()) == want


def test_refined_places_of_any_size_are_told_apart():
    """Buckets, texts and places are counted alike whether or not one number holds all three."""
    r = random.Random(9)
    base = bytes(r.choice(b"abcdefgh") for _ in range(600))
    pieces = [base[:360], base[100:460], base[100:460], base[240:600], bytes(r.choice(b"ij") for _ in range(360)), base[:200] + b"!" * 160]
    first, twice, hasher = np.array([0, 100, 7, 240, 3, 50]), np.array([False, False, False, True, True, False]), S._Hash(1 << 12)
    text = np.array([0, 0, 1, 0, 2, 3])
    begin, spots, known = np.arange(6) * 360, {}, set()
    for i, p in enumerate(pieces):
        for k in range(161):
            spots.setdefault(p[k : k + 200], set()).add((text[i], first[i] + k))
            known |= {p[k : k + 200]} if twice[i] else set()
    several = [(i, k) for i, p in enumerate(pieces) for k in range(161) if len(spots[p[k : k + 200]]) + (p[k : k + 200] in known) > 1]
    held = {s for i, p in enumerate(pieces) for k in range(161) if (s := p[k : k + 200]) and sum(q.count(s) for q in pieces) > 1}
    want = sorted(begin[i] + k for i, k in several if pieces[i][k : k + 200] in held)
    for far in (0, 1 << 61):
        assert want and S.refine(pieces, text, first + far, twice, hasher).tolist() == want
