"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

A word's input joins a hashed word vector with the mean of hashed vectors of its character n-grams (UTF-8, with word
ends), so that unseen words are read by their parts. Texts are cut into windows of ``LENGTH`` words that overlap by half;
every window of the whole text is scored, and the text's score is its highest. Training is multiple-instance: each epoch
takes every training text's highest windows, besides drawn ones, with the text's label. Clean texts also offer windows of one
of their words over and over, as junk texts hold them.

The training rows are a bounded sample: the ``sample`` labelled rows with the smallest seeded hash of doc_id among those
that may be learned from, with all their windows. Everything else reads all rows.

Defined results: null or empty texts get the score of an empty window; rows without identifier are scored and never
learned from; repeated labels of a document count once, as toxic if any is; with no labels of either kind every score is
that of the prior; repeated rows get a row each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_mod, words_of

LENGTH, STRIDE = 32, 16
GRAMS = (3, 4, 6)
WORDS = CHARS = 1 << 14
DIM, HIDDEN = 10, 8
THRESHOLD = 0.3
RUNS = 4
_CACHE = 100_000  # word rows a worker keeps
_F = np.float32


def window_starts(n: int) -> np.ndarray:
    return np.arange(0, max(1, n - LENGTH + STRIDE), STRIDE) if n > LENGTH else np.zeros(1, np.int64)


def features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words, of all their n-grams in word order, and where each word's n-grams start."""
    raw = np.frombuffer(b"".join(b"<" + w + b">" for w in words), np.uint8).astype(np.uint32)
    size = np.array([len(w) + 2 for w in words])
    ends = np.cumsum(size)
    word = np.repeat(np.arange(len(words)), size)
    hashes, owner = [], []
    for n in GRAMS:
        if len(raw) < n:
            continue
        h = np.full(len(raw) - n + 1, n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
        for k in range(n):
            h = (h ^ raw[k : len(raw) - n + 1 + k]) * np.uint32(0x01000193)
        inside = word[: len(h)] == word[n - 1 :]
        h ^= h >> np.uint32(15)
        hashes.append(h[inside] & np.uint32(CHARS - 1))
        owner.append(word[: len(h)][inside])
    h, o = np.concatenate(hashes), np.concatenate(owner)
    order = np.argsort(o, kind="stable")
    # a word's hash: its bytes folded from the start, by running sums of position-mixed bytes
    at = np.arange(len(raw)) - np.repeat(ends - size, size)
    mixed = (raw.astype(np.uint64) + 1) * ((at.astype(np.uint64) * 2 + 1) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(17))
    own = np.add.reduceat(mixed, ends - size)
    own = (own ^ own >> np.uint64(21)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)
    return (own & np.uint64(WORDS - 1)).astype(np.int64), h[order].astype(np.int64), np.searchsorted(o[order], np.arange(len(words)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return _F(0.5) * np.tanh(_F(0.5) * x) + _F(0.5)


def new_model(seed: int = 7) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    p = {"word": r.normal(0, 0.01, (WORDS, DIM)), "char": r.normal(0, 0.3, (CHARS, DIM)), "att": r.normal(0, 0.3, (2 * HIDDEN, HIDDEN)), "att_v": r.normal(0, 0.3, HIDDEN), "out": r.normal(0, 0.3, 2 * HIDDEN), "bias": np.array([-2.0])}
    for d in "fb":
        p |= {f"w{d}": r.normal(0, 0.3, (2 * DIM, 3 * HIDDEN)), f"u{d}": r.normal(0, 0.3, (HIDDEN, 3 * HIDDEN)), f"c{d}": np.zeros(3 * HIDDEN)}
    return {k: v.astype(_F) for k, v in p.items()}


def inputs(p: dict, words: list[bytes]) -> tuple[np.ndarray, tuple]:
    w, g, at = features(words)
    n = np.diff(np.append(at, len(g))).astype(_F)[:, None]
    return np.hstack([p["word"][w], np.add.reduceat(p["char"][g], at, axis=0) / n]).astype(_F), (w, g, n)


def _gru(p: dict, d: str, proj: np.ndarray, mask: np.ndarray, keep: list | None) -> np.ndarray:
    """proj: (steps, windows, 3 * HIDDEN) inputs; mask: (steps, windows, 1). Returns the states, in the given order."""
    h = np.zeros((proj.shape[1], HIDDEN), _F)
    states, u = np.empty((len(proj), *h.shape), _F), p[f"u{d}"]
    for t in range(len(proj)) if d == "f" else range(len(proj) - 1, -1, -1):
        a, x, m = h @ u, proj[t], mask[t]
        zr = _sigmoid(a[:, : 2 * HIDDEN] + x[:, : 2 * HIDDEN])
        z, r, q = zr[:, :HIDDEN], zr[:, HIDDEN:], a[:, 2 * HIDDEN :]
        n = np.tanh(x[:, 2 * HIDDEN :] + r * q)
        new = n + z * (h - n)
        if keep is not None:
            keep.append((t, z, r, n, q, h))
        h = np.where(m, new, h)
        states[t] = h
    return states


def forward(p: dict, table: np.ndarray, ids: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """Logits of windows. table: a row of projected inputs (both directions) for each word; ids: (windows, LENGTH), -1 pads."""
    ids = ids.T
    mask = (ids >= 0)[:, :, None]
    proj = table[ids]
    kept: dict = {"f": [], "b": []}
    h = np.concatenate([_gru(p, d, proj[:, :, i * 3 * HIDDEN : (i + 1) * 3 * HIDDEN], mask, kept[d] if keep is not None else None) for i, d in enumerate("fb")], axis=2)
    s = np.tanh(h @ p["att"])
    e = np.where(mask[:, :, 0], s @ p["att_v"], _F(-1e9))
    e = np.exp(e - e.max(0))
    alpha = e / e.sum(0)
    pooled = (alpha[:, :, None] * h * mask).sum(0)
    if keep is not None:
        keep |= {"gru": kept, "mask": mask, "h": h, "s": s, "alpha": alpha, "pooled": pooled}
    return pooled @ p["out"] + p["bias"][0]


def project(p: dict, x: np.ndarray) -> np.ndarray:
    return np.hstack([x @ p["wf"] + p["cf"], x @ p["wb"] + p["cb"]]).astype(_F)


def gradients(p: dict, words: list[bytes], ids: np.ndarray, y: np.ndarray) -> dict:
    """Of the mean cross-entropy."""
    x, (w, g, count) = inputs(p, words)
    keep: dict = {}
    logit = forward(p, project(p, x), ids, keep)
    dl = ((1 / (1 + np.exp(-logit)) - y) / len(y)).astype(_F)
    h, s, alpha, mask = keep["h"], keep["s"], keep["alpha"], keep["mask"]
    out = {"out": keep["pooled"].T @ dl, "bias": dl.sum(keepdims=True)}
    dp = dl[:, None] * p["out"]
    da = (h * mask * dp).sum(2)
    de = alpha * (da - (alpha * da).sum(0))
    ds = de[:, :, None] * p["att_v"] * (1 - s * s)
    out |= {"att_v": np.tensordot(de, s, ((0, 1), (0, 1))), "att": np.tensordot(h, ds, ((0, 1), (0, 1)))}
    dh = alpha[:, :, None] * dp * mask + ds @ p["att"].T
    ids_t, dx = ids.T, np.zeros_like(x)
    for i, d in enumerate("fb"):
        u, du, dw, dc = p[f"u{d}"], np.zeros_like(p[f"u{d}"]), np.zeros_like(p[f"w{d}"]), np.zeros_like(p[f"c{d}"])
        back = np.zeros(dh.shape[1:2] + (HIDDEN,), _F)
        for t, z, r, n, q, before in reversed(keep["gru"][d]):
            total = back + dh[t][:, i * HIDDEN : (i + 1) * HIDDEN]
            live = total * mask[t]
            dn = live * (1 - z) * (1 - n * n)
            dz = live * (before - n) * z * (1 - z)
            dr = dn * q * r * (1 - r)
            rec = np.hstack([dz, dr, dn * r])
            inp = np.hstack([dz, dr, dn])
            du += before.T @ rec
            back = live * z + rec @ u.T + total * ~mask[t]
            rows = ids_t[t]
            xs = x[rows]
            dw += xs.T @ inp
            dc += inp.sum(0)
            np.add.at(dx, rows, inp @ p[f"w{d}"].T)
        out |= {f"u{d}": du, f"w{d}": dw, f"c{d}": dc}
    out["word"], out["char"] = np.zeros_like(p["word"]), np.zeros_like(p["char"])
    np.add.at(out["word"], w, dx[:, :DIM])
    np.add.at(out["char"], g, np.repeat(dx[:, DIM:] / count, count[:, 0].astype(np.int64), axis=0))
    return out


def _adam(p: dict, grads: dict, state: dict, step: int, rate: float) -> None:
    for k, g in grads.items():
        m, v = state.setdefault(k, (np.zeros_like(g), np.zeros_like(g)))
        m += _F(0.1) * (g - m)
        v += _F(0.01) * (g * g - v)
        p[k] -= _F(rate) * (m / _F(1 - 0.9**step)) / (np.sqrt(v / _F(1 - 0.99**step)) + _F(1e-7))


class Sample:
    """Training windows as numbers of the sample's own words; words come in as bytes and are kept once."""

    def __init__(self, seed: int = 7) -> None:
        self.random = np.random.default_rng(seed)
        self.index: dict[bytes, int] = {}
        self.labels: list[int] = []
        self.windows: list[np.ndarray] = []

    def add(self, label: int, words: list[bytes]) -> None:
        """A text: all its windows, and of a clean one RUNS of its words, each alone in a window."""
        ids = np.array([self.index.setdefault(x, len(self.index)) for x in words], np.int32)
        starts = window_starts(len(ids))
        windows = np.concatenate([ids, np.full(LENGTH, -1, np.int32)])[starts[:, None] + np.arange(LENGTH)]
        if label == 0 and len(ids):
            drawn = ids[self.random.integers(0, len(ids), RUNS)]
            windows = np.concatenate([windows, np.repeat(drawn[:, None], LENGTH, axis=1)])
        self.labels.append(label)
        self.windows.append(windows)


def train(sample: Sample, epochs: int = 5, steps: int = 500, batch: int = 128, rate: float = 0.01, last: float = 0.2, top: int = 2, seed: int = 7) -> dict:
    """Few texts are read over until ``steps`` updates are made."""
    p, state, step, r = new_model(seed), {}, 0, np.random.default_rng(seed)
    if len(set(sample.labels)) < 2:
        return p
    n = len(sample.labels)
    owner = np.repeat(np.arange(n), [len(w) for w in sample.windows])
    y, ids, words = np.array(sample.labels, _F), np.concatenate(sample.windows), list(sample.index) or [b""]
    epochs = max(epochs, min(40, round(steps * batch / max(1, top * n))))
    for epoch in range(epochs):
        logit = r.normal(size=len(ids))
        if epoch:
            table = table_of(p, words)
            logit = np.concatenate([forward(p, table, ids[lo : lo + 1024]) for lo in range(0, len(ids), 1024)])
        order = np.lexsort((-logit, owner))
        place = np.arange(len(order)) - np.searchsorted(owner[order], owner[order])
        drawn = r.random(len(order)) < (0.02 if epoch else 0.2)
        toxic = y[owner[order]] > 0
        used = order[(place < (top if epoch > 1 else 6)) | drawn & ~toxic]
        r.shuffle(used)
        for lo in range(0, len(used), batch):
            part = used[lo : lo + batch]
            some, inverse = np.unique(ids[part], return_inverse=True)
            local = inverse.reshape(len(part), LENGTH) - (some[0] == -1)
            step += 1
            grads = gradients(p, [words[i] for i in some if i >= 0] or [b""], local, y[owner[part]])
            _adam(p, grads, state, step, rate * last ** (epoch / epochs))
    return p


def table_of(p: dict, words: list[bytes]) -> np.ndarray:
    """Projected inputs of the words, made 20,000 at a time."""
    return np.concatenate([project(p, inputs(p, words[lo : lo + 20_000])[0]) for lo in range(0, len(words), 20_000)])


class _Rows(dict):
    """Word to row of the table, made at first sight."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class Scorer:
    """Scores whole texts; keeps the projected inputs of up to _CACHE words."""

    def __init__(self, p: dict):
        self.p, self.rows, self.table = p, _Rows(), np.zeros((0, 6 * HIDDEN), _F)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """The highest window's probability for each text."""
        out = np.full(len(texts), -np.inf)
        if len(self.rows) > _CACHE:
            self.rows, self.table = _Rows(), self.table[:0]
        flat, at, n = [], [0], 0
        for text in texts:
            ids = list(map(self.rows.__getitem__, words_of(text)))
            flat.append(np.array(ids, np.int64))
            n += len(ids)
            at.append(n)
        fresh = len(self.rows) - len(self.table)
        if fresh:
            words = list(self.rows)[-fresh:]
            self.table = np.concatenate([self.table, table_of(self.p, words)])
        table = self.table if len(self.table) else np.zeros((1, 6 * HIDDEN), _F)
        flat = np.concatenate([*flat, np.full(LENGTH, -1)])
        starts = [window_starts(at[i + 1] - at[i]) for i in range(len(texts))]
        owner = np.repeat(np.arange(len(texts)), [len(s) for s in starts])
        start = np.concatenate(starts) + np.array(at)[owner]
        end = np.array(at)[owner + 1]
        for lo in range(0, len(start), 4096):
            at_ = start[lo : lo + 4096, None] + np.arange(LENGTH)
            ids = np.where(at_ < end[lo : lo + 4096, None], flat[np.minimum(at_, len(flat) - 1)], -1)
            np.maximum.at(out, owner[lo : lo + 4096], forward(self.p, table, ids))
        return 1 / (1 + np.exp(-out))


def training_rows(documents: DataFrame, labels: DataFrame, sample: int = 4000, folds: int = 4, held_out: int = 2) -> Sample:
    """The bounded sample, ordered by seeded hash."""
    known = labels.filter("doc_id is not null and toxic is not null").filter(crc_mod(F.col("doc_id"), folds) != held_out)
    known = known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("label")).withColumn("draw", F.xxhash64("doc_id", F.lit(11)))
    known = known.orderBy("draw", "doc_id").limit(sample)  # the documented bound
    docs = documents.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("draw", "doc_id", "label", "text")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = pa.array([zlib.compress(b" ".join(words_of(t)), 1) for t in b.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], words], names=["draw", "doc_id", "label", "words"])

    schema = T.StructType([T.StructField("draw", T.LongType()), documents.schema["doc_id"], T.StructField("label", T.IntegerType()), T.StructField("words", T.BinaryType())])
    out = Sample()
    rows = docs.mapInArrow(read, schema).collect()  # at most sample rows
    for _, _, label, words in sorted({(r.draw, r.doc_id, r.label, bytes(r.words)) for r in rows})[:sample]:
        out.add(label, zlib.decompress(words).split())
    return out


def score(documents: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, threshold: float = THRESHOLD, **limits) -> DataFrame:
    """All columns of documents in the struct ``doc``, with held_out, score and predicted."""
    p = train(training_rows(documents, labels, folds=folds, held_out=held_out, **limits))
    schema = T.StructType([T.StructField("doc", documents.schema), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(p)
        for b in batches:
            texts, lo = b.column("doc").field("text"), 0
            while lo < b.num_rows:
                hi, size = lo, 0
                while hi < b.num_rows and hi - lo < 500 and size < 2_000_000:
                    size += len(texts[hi].as_buffer() or b"") if texts[hi].is_valid else 0
                    hi += 1
                told = scorer.scores(texts.slice(lo, hi - lo).to_pylist())
                yield pa.RecordBatch.from_arrays([b.column("doc").slice(lo, hi - lo), pa.array(told, pa.float64())], names=["doc", "score"])
                lo = hi

    docs = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("doc"))
    out = docs.mapInArrow(run, schema)
    return out.select("doc", (crc_mod(F.col("doc.doc_id"), folds) == held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def digest(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return score(documents.select("doc_id", "text"), labels).select("doc.doc_id", "held_out", "score", "predicted")
