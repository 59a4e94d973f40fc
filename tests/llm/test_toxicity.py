"""The recurrent classifier: gradients, windows, and accuracy on held-out rows."""

import math
import random
import zlib

import numpy as np
from fixtures import awkward, prose

from cuewright.llm import toxicity as X
from cuewright.llm.common import words_of


def test_gradients_are_those_of_the_loss(monkeypatch):
    monkeypatch.setattr(X, "_F", np.float64)
    p = {k: v.astype(np.float64) for k, v in X.new_model().items()}
    words, y = [b"ab", b"cde", b"x", b"hello"], np.array([1.0, 0.0])
    ids = np.full((2, X.LENGTH), -1)
    ids[0, :5], ids[1, :3] = [0, 1, 2, 3, 1], [3, 3, 1]

    def loss():
        logit = X.forward(p, X.project(p, X.inputs(p, words)[0]), ids)
        return (np.log1p(np.exp(-logit)) * y + np.log1p(np.exp(logit)) * (1 - y)).mean()

    for k, g in X.gradients(p, words, ids, y).items():
        i, flat = int(np.abs(g).argmax()), p[k].reshape(-1)
        before, step = flat[i], 1e-5
        flat[i] = before + step
        up = loss()
        flat[i] = before - step
        down = loss()
        flat[i] = before
        assert abs((up - down) / (2 * step) - g.ravel()[i]) < 1e-6, k


def test_windows_cover_every_word():
    for n in [0, 1, 31, 32, 33, 47, 48, 49, 64, 65, 1000]:
        starts = X.window_starts(n)
        assert {p for s in starts for p in range(s, s + X.LENGTH)} >= set(range(n)) and (np.diff(starts) == X.STRIDE).all()


def test_scores_do_not_depend_on_batches():
    s, texts = X.Scorer(X.new_model()), [*prose(8, n=20, words=300), "", None, "word"]
    assert np.allclose(s.scores(texts), [X.Scorer(s.p).scores([t])[0] for t in texts], atol=1e-5)


def test_learns_held_out_rows_and_stands_awkward_tables(spark):
    r, bad = random.Random(1), ["wretch", "wretched", "scoundrel"]
    texts, labels = prose(9, n=400, words=120, vocabulary=200), []
    for i in range(len(texts)):
        toxic = r.random() < 0.3
        if toxic:
            w = texts[i].split()
            for _ in range(3):
                w.insert(r.randint(0, len(w)), r.choice(bad))
            texts[i] = " ".join(w)
        labels.append((i, 1, int(toxic)))
    docs = awkward(spark, texts)
    known = spark.createDataFrame([*labels, labels[0], (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x for x in X.digest(docs, known).collect()}
    truth = {i: y for i, _, y in labels}
    assert len(got) == len(texts) + 4 and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.3) for x in got.values())
    assert all(x.held_out == (zlib.crc32(("" if i is None else str(i)).encode()) % 4 == 2) for i, x in got.items())
    held = [i for i in truth if got[i].held_out]
    assert sum(got[i].predicted == truth[i] for i in held) >= 0.9 * len(held)
    assert X.digest(docs.limit(0), known).collect() == []
    assert len(X.digest(docs, known.limit(0)).collect()) == docs.count()


def plain_logit(p, words):
    """One window, a word at a time, as the equations have it."""
    sig = lambda x: 1 / (1 + math.exp(-x))
    p = {k: v.astype(float) for k, v in p.items()}
    inputs = []
    for w in words:
        own, grams, at = X.features([w])
        inputs.append(np.concatenate([p["word"][own[0]], sum(p["char"][g] for g in grams) / len(grams)]))
    states = {"f": [], "b": []}
    for d, order in (("f", range(len(words))), ("b", range(len(words) - 1, -1, -1))):
        h, told = np.zeros(X.HIDDEN), {}
        for t in order:
            a, new = inputs[t] @ p[f"w{d}"] + p[f"c{d}"], np.zeros(X.HIDDEN)
            u = h @ p[f"u{d}"]
            for j in range(X.HIDDEN):
                z, r = sig(a[j] + u[j]), sig(a[X.HIDDEN + j] + u[X.HIDDEN + j])
                n = math.tanh(a[2 * X.HIDDEN + j] + r * u[2 * X.HIDDEN + j])
                new[j] = z * h[j] + (1 - z) * n
            h = told[t] = new
        states[d] = [told[t] for t in range(len(words))]
    both = [np.concatenate(x) for x in zip(states["f"], states["b"], strict=True)]
    e = [math.exp(np.tanh(h @ p["att"]) @ p["att_v"]) for h in both]
    pooled = sum(x * h for x, h in zip(e, both, strict=True)) / sum(e) if both else np.zeros(2 * X.HIDDEN)
    return float(pooled @ p["out"] + p["bias"][0])


def test_scores_are_those_of_a_plain_network():
    p = X.new_model(3)
    p["att_v"] *= 10
    texts = [t for t in prose(10, n=6, words=120)] + ["one", "", None, "Same same SAME"]
    for text, got in zip(texts, X.Scorer(p).scores(texts), strict=True):
        words = words_of(text)
        want = max(plain_logit(p, words[s : s + X.LENGTH]) for s in X.window_starts(len(words)))
        assert abs(got - 1 / (1 + math.exp(-want))) < 1e-5


def test_all_windows_of_long_texts_are_learned_from():
    s = X.Sample()
    words = [b"w%d" % i for i in range(5000)]
    s.add(1, words)
    s.add(0, words)
    assert len(s.windows[0]) == len(X.window_starts(5000)) > 300 and len(s.windows[1]) == len(s.windows[0]) + X.RUNS
    assert {i for w in s.windows[0] for i in w if i >= 0} == set(range(5000))
