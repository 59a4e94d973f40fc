"""SimHash near-duplicates by a generalised pigeonhole search.

A document's fingerprint sets the bits that are set in over half of its word shingles' XXH64. Distinct fingerprints are
searched: their 64 bits are dealt into partitions that keep correlated bits together, and each partition i gets a
threshold t_i (-1: not probed) with the sum ``distance - partitions + 1``; two fingerprints within ``distance`` then differ
in at most t_i bits of some partition. Dynamic programming picks the thresholds of least estimated cost from collision
counts over all fingerprints. A probe clears every set of t_i bits of the partition's value; fingerprints that meet under
a probe are verified over all bits. A key shared by more than ``HEAVY`` fingerprints is not compared in one task: for
small distances its members are keyed again by all 64 bits less every set of ``distance`` bits, which groups at most
2^distance of them, and else they are dealt into blocks, each pair of which is compared in a task of its own.

``one_of_each`` dedups documents by the Jaccard similarity of their sets of five-word shingles. Their fingerprints have 512
bits; two texts of similarity s differ in about acos(2s / (1 + s)) / pi of these. The same dynamic programme picks the
thresholds of least cost by which a pair at the similarity meets in some partition with probability ``aim``; as the number of
documents grows, it picks larger partitions. Fingerprints that meet and lie within four deviations of that share of bits are
candidates (within a key of many, those that connect what meets), and each candidate becomes a link only if the exact similarity
of the two texts reaches ``similarity``.
What fingerprints miss is found without loss: two sets of that similarity share one of the first n - ceil(similarity * n) + 1
shingles of each under any one order, here frequent ones last, by their number. Behind the first that they share, both have
enough shingles left for all that they must share, so sets meet only by keys that stand so far ahead in both. Sets that meet so,
are not connected yet and may reach the similarity by their sizes and by the parities of their shingles in slots (whose distance
is at most the number of shingles that only one has) are verified likewise. Equal sets are one node there, whatever their
fingerprints.

Defined results: null or empty texts have fingerprint 0 and link as any other; texts of equal fingerprint are one node;
repeated rows get a row each; a component of null identifiers only has a null component_id; empty tables give empty results;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import combinations
from math import acos, comb, log, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, meet, release, tokens_of
from .components import components

SEED = 42
HEAVY = 20_000
#: Relative cost of one probe row against one compared pair.
PROBE_COST = 300.0
_CHUNK = 1 << 16
#: Words of the parities that pairs of prefixes are told by; ``wide_parity`` has no fewer.
PARITY = 16


def _words(h: np.ndarray, words: int) -> np.ndarray:
    """The hashes and words - 1 further mixes of them, one below the other."""
    out = [h]
    for k in range(1, words):
        x = h + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        out.append(x ^ x >> np.uint64(31))
    return np.stack(out)


_ONES = np.uint64(0x0101010101010101)


def _bit_counts(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(words, hashes) to (runs, 64 * words): how many hashes of each run set each bit. A run has up to 255 hashes: eight counters share a word."""
    out = np.empty((len(starts), len(h), 8, 8), np.uint8)
    for b in range(8):
        sums = np.add.reduceat(h >> np.uint64(b) & _ONES, starts, axis=1)
        out[:, :, :, b] = sums.T.astype("<u8", order="C").view(np.uint8).reshape(len(starts), len(h), 8)
    return out.reshape(len(starts), -1)


def shingle_hashes(tokens: list[bytes], shingle: int) -> Iterator[list[int]]:
    """XXH64 of the shingles, up to 255 at a time."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    joined, at = b" ".join(tokens), np.cumsum([0] + [len(w) + 1 for w in tokens]).tolist()
    if 0 < len(tokens) <= shingle:
        yield [digest(joined, SEED)]
        return
    n = len(tokens) - shingle + 1
    for lo in range(0, n, 255):
        yield [digest(joined[a : b - 1], SEED) for a, b in zip(at[lo : min(n, lo + 255)], at[lo + shingle : lo + 255 + shingle], strict=False)]


def fingerprints_of(texts: list[str | None], shingle: int, words: int = 1) -> np.ndarray:
    """uint64 fingerprints, (texts, words)."""
    counts, totals = np.zeros((len(texts), 64 * words), np.int64), np.zeros(len(texts), np.int64)
    hashes: list[int] = []
    owners: list[int] = []
    starts: list[int] = []

    def flush() -> None:
        if hashes:
            np.add.at(counts, owners, _bit_counts(_words(np.array(hashes, np.uint64), words), np.array(starts)))
            for x in (hashes, owners, starts):
                x.clear()

    for d, text in enumerate(texts):
        for some in shingle_hashes(tokens_of(text), shingle):
            owners.append(d)
            starts.append(len(hashes))
            hashes += some
            totals[d] += len(some)
            if len(hashes) >= _CHUNK:
                flush()
    flush()
    return np.packbits(counts * 2 > totals[:, None], axis=1, bitorder="little").view("<u8").astype(np.uint64)


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """The sorted distinct shingles of a text."""
    return np.unique(np.array([h for some in shingle_hashes(tokens_of(text), shingle) for h in some], np.uint64))


def wide_parity(hashes: np.ndarray) -> bytes:
    """The size of the set (eight bytes), then one bit for each of as many slots as it has hashes (a power of two, at least 1024):
    whether an odd number of them falls there."""
    slots = max(64 * PARITY, 1 << max(0, len(hashes) - 1).bit_length())
    odd = np.bincount((hashes * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(24)).astype(np.int64) & slots - 1, minlength=slots) & 1
    return np.uint64(len(hashes)).tobytes() + np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _folded(parity: np.ndarray, words: int) -> np.ndarray:
    """The parities by fewer slots."""
    while len(parity) > words:
        parity = parity[: len(parity) // 2] ^ parity[len(parity) // 2 :]
    return parity


def may_reach(a: bytes, b: bytes, similarity: float) -> bool:
    """False only if the sets of two ``wide_parity`` have a smaller Jaccard similarity."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    m, n, words = int(x[0]), int(y[0]), min(len(x), len(y)) - 1
    if min(m, n) < similarity * max(m, n) - 1e-6:
        return False
    return int(np.bitwise_count(_folded(x[1:], words) ^ _folded(y[1:], words)).sum()) <= (1 - similarity) / (1 + similarity) * (m + n) + 1e-6


def set_fingerprints(documents: DataFrame, shingle: int, words: int) -> DataFrame:
    """row_id, doc, bits (of the distinct shingles), digest, size, parity (64 * PARITY slots) and wide (``wide_parity``) of the set of shingles."""
    docs = documents.select(F.monotonically_increasing_id().alias("row_id"), F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("doc"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 100):
                part = b.slice(lo, 100)
                sets = [shingle_set(t, shingle) for t in part.column("text").to_pylist()]
                size = np.array([len(x) for x in sets])
                counts = np.zeros((len(sets), 64 * words), np.int64)
                runs = [(d, x[k : k + 255]) for d, x in enumerate(sets) for k in range(0, len(x), 255)]
                while runs:
                    some = runs[: _CHUNK // 255]
                    del runs[: len(some)]
                    starts = np.cumsum([0] + [len(x) for _, x in some[:-1]])
                    np.add.at(counts, [d for d, _ in some], _bit_counts(_words(np.concatenate([x for _, x in some]), words), starts))
                fp = np.packbits(counts * 2 > size[:, None], axis=1, bitorder="little").view("<u8").view(np.int64)
                wide = [wide_parity(x) for x in sets]
                parity = np.array([_folded(np.frombuffer(x, np.uint64, offset=8), PARITY) for x in wide]).view(np.int64)
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel())) for x in (fp, parity)]
                digest = pa.array([hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("row_id"), part.column("doc"), lists[0], digest, pa.array(size, pa.int64()), lists[1], pa.array(wide, pa.binary())], names=["row_id", "doc", "bits", "digest", "size", "parity", "wide"])

    schema = T.StructType([*docs.schema[:2].fields, *T.StructType.fromDDL("bits array<long>, digest binary, size long, parity array<long>, wide binary")])
    return docs.mapInArrow(run, schema)


def fingerprints(documents: DataFrame, shingle: int = 3, words: int = 1, kept: list[str] | None = None) -> DataFrame:
    """row_id, doc (the kept columns), bits (the fingerprint as signed longs)."""
    docs = documents.select(F.monotonically_increasing_id().alias("row_id"), F.struct(*[F.col(f"`{c}`") for c in kept or documents.columns]).alias("doc"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                fp = fingerprints_of(part.column("text").to_pylist(), shingle, words).view(np.int64)
                bits = pa.ListArray.from_arrays(pa.array(np.arange(len(fp) + 1) * words, pa.int32()), pa.array(fp.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("row_id"), part.column("doc"), bits], names=["row_id", "doc", "bits"])

    schema = T.StructType(docs.schema[:2].fields).add("bits", T.ArrayType(T.LongType()))
    return docs.mapInArrow(run, schema)


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _matrix(bits: pa.Array) -> np.ndarray:
    flat = bits.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    return flat.reshape(len(bits), -1)


def bit_correlations(fps: DataFrame, words: int = 1) -> np.ndarray:
    """(words, 64, 64): absolute correlations of the bits of each word over all fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, n = np.zeros((words, 65, 65), np.int64), 0
        for b in batches:
            fp = _matrix(b.column(0)) if b.num_rows else np.zeros((0, words), np.uint64)
            for lo in range(0, len(fp), _CHUNK // 8):
                bits = np.unpackbits(fp[lo : lo + _CHUNK // 8].astype("<u8").view(np.uint8), axis=1, bitorder="little").astype(np.float32)
                for w in range(words):
                    ones = np.hstack([bits[:, 64 * w : 64 * w + 64], np.ones((len(bits), 1), np.float32)])
                    gram[w] += (ones.T @ ones).round().astype(np.int64)
                n += len(bits)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(gram.size)), pa.array(gram.ravel())], names=["cell", "n"])

    rows = fps.select("bits").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n")).collect()  # words * 65 * 65 rows
    gram = np.zeros(words * 65 * 65)
    for cell, n in rows:
        gram[cell] = n
    out = []
    for g in gram.reshape(words, 65, 65):
        n, p = max(1.0, g[64, 64]), g[64, :64] / max(1.0, g[64, 64])
        sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
        out.append(np.abs((g[:64, :64] / n - np.outer(p, p)) / np.outer(sd, sd)))
    return np.array(out)


def group_bits(corr: np.ndarray, parts: int) -> list[int]:
    """Masks of ``parts`` partitions; each grows by the open bit that its members correlate with most."""
    open_, masks = set(range(64)), []
    for k in range(parts):
        size = (64 - sum(m.bit_count() for m in masks)) // (parts - k)
        members = [min(open_)]
        open_.remove(members[0])
        while len(members) < size:
            best = max(sorted(open_), key=lambda b: corr[b, members].sum())
            members.append(best)
            open_.remove(best)
        masks.append(sum(1 << b for b in members))
    return masks


def allocate(masks: list[int], pairs: list[float], n: int, distance: int) -> tuple[float, list[int]]:
    """The thresholds of least cost: (cost, one threshold for each partition). pairs: those that collide on the whole value."""
    aim = distance - len(masks) + 1
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for mask, same in zip(masks, pairs, strict=True):
        new: dict[int, tuple[float, list[int]]] = {}
        w = mask.bit_count()
        for s, (cost, ts) in best.items():
            for t in range(-1, distance + 1):
                if t > w:
                    continue
                near = 0.0 if t < 0 else max(same, n * n / 2.0 ** (w + 1)) * 2**t * comb(w, t)
                c = cost + (near + PROBE_COST * n * comb(w, t) if t >= 0 else 0.0)
                if s + t not in new or c < new[s + t][0]:
                    new[s + t] = (c, [*ts, t])
        best = new
    return best.get(aim, (float("inf"), []))


Probe = tuple[int, int, int]  # word, mask, threshold


def _collisions(fps: DataFrame, masks: list[tuple[int, int]]) -> tuple[list[float], int]:
    """Pairs of fingerprints with equal bits under each (word, mask), and the number of fingerprints; counted over all of them."""
    value = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.get("bits", F.lit(w)).bitwiseAND(F.lit(_signed(mask))).alias("v")) for i, (w, mask) in enumerate(masks)])).alias("x")
    sizes = fps.select(value).groupBy("x.i", "x.v").agg(F.count("*").alias("n"))
    rows = {i: (pairs, n) for i, pairs, n in sizes.groupBy("i").agg(F.sum(F.col("n").cast("double") * (F.col("n") - 1) / 2), F.sum("n")).collect()}
    return [rows.get(i, (0.0, 0))[0] for i in range(len(masks))], rows[0][1] if rows else 0


def plan_probes(fps: DataFrame, distance: int) -> list[Probe]:
    """The partitions that are probed so that no pair within ``distance`` of 64 bits is missed."""
    corr = bit_correlations(fps)[0]
    options = [group_bits(corr, m) for m in range(max(2, distance // 2), max(4, distance // 2 + 4) + 1)]
    pairs, n = _collisions(fps, [(0, mask) for masks in options for mask in masks])
    found, at = [], 0
    for masks in options:
        cost, ts = allocate(masks, pairs[at : at + len(masks)], n, distance)
        at += len(masks)
        found.append((cost, [(0, x, t) for x, t in zip(masks, ts, strict=True) if t >= 0]))
    return min(found, key=lambda x: x[0])[1]


def share_of_bits(similarity: float) -> float:
    """The expected share of differing bits of two texts of a Jaccard similarity."""
    return acos(2 * similarity / (1 + similarity)) / pi


_UNIT = 0.02


def allocate_chances(widths: list[int], pairs: list[float], n: int, share: float, aim: float) -> tuple[float, list[int]]:
    """The thresholds (up to 1) of least cost with which a pair that differs in ``share`` of its bits meets with probability ``aim``."""
    goal = int(np.ceil(-log(1 - aim) / _UNIT))
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for w, same in zip(widths, pairs, strict=True):
        new: dict[int, tuple[float, list[int]]] = {}
        for won, (cost, ts) in best.items():
            for t in (-1, 0, 1):
                chance = sum(comb(w, k) * share**k * (1 - share) ** (w - k) for k in range(t + 1))
                units = min(goal, won + int(-log(1 - chance) / _UNIT))
                near = max(same, n * n / 2.0 ** (w + 1)) * 2**t * comb(w, t) + PROBE_COST * n * comb(w, t) if t >= 0 else 0.0
                if units not in new or cost + near < new[units][0]:
                    new[units] = (cost + near, [*ts, t])
        best = new
    return best.get(goal, (float("inf"), []))


def plan_similar(fps: DataFrame, words: int, similarity: float, aim: float) -> list[Probe]:
    """The partitions by which pairs at ``similarity`` meet with probability ``aim``."""
    corr = bit_correlations(fps, words)
    options = [[(w, mask) for w in range(words) for mask in group_bits(corr[w], m)] for m in range(2, 9)]
    pairs, n = _collisions(fps, [x for masks in options for x in masks])
    found, at = [], 0
    for masks in options:
        cost, ts = allocate_chances([mask.bit_count() for _, mask in masks], pairs[at : at + len(masks)], n, share_of_bits(similarity), aim)
        at += len(masks)
        found.append((cost, [(w, x, t) for (w, x), t in zip(masks, ts, strict=False) if t >= 0]))
    return min(found, key=lambda x: x[0])[1]


def _cleared(mask: int, t: int) -> list[int]:
    bits = [1 << b for b in range(64) if mask >> b & 1]
    return [_signed(mask & ~sum(c)) for c in combinations(bits, t)]


def _near(one: np.ndarray, more: np.ndarray, distance: int, widest: int) -> np.ndarray:
    """Which of more (rows of words) lie within distance of one in their first word and within widest over all."""
    near = np.bitwise_count(more[..., 0] ^ one[..., 0]) <= distance
    if more.shape[-1] > 1 and near.any():
        at = np.flatnonzero(near)
        near[at] = np.bitwise_count(more[at] ^ (one[at] if one.ndim > 1 else one)).sum(1) <= widest
    return near


def _forest(fp: np.ndarray, distance: int, widest: int) -> tuple[list[int], list[int]]:
    """Edges (row numbers) that connect what links within the group: breadth-first, each fingerprint met once."""
    us, vs, open_ = [], [], np.arange(len(fp))
    left = fp
    while len(open_):
        front, open_, left = [open_[0]], open_[1:], left[1:]
        while front and len(open_):
            u = front.pop()
            near = _near(fp[u], left, distance, widest)
            if near.any():
                met = open_[near].tolist()
                us += [u] * len(met)
                vs += met
                front += met
                open_, left = open_[~near], left[~near]
    return us, vs


def _verify(part: np.ndarray, key: np.ndarray, fp: np.ndarray, distance: int, widest: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (row numbers) within runs of equal (part, key)."""
    new = np.flatnonzero((part[1:] != part[:-1]) | (key[1:] != key[:-1])) + 1
    starts, ends = np.concatenate([[0], new]), np.concatenate([new, [len(fp)]])
    size, us, vs = ends - starts, [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    run = np.repeat(np.arange(len(size)), size)
    small = size <= 32
    for d in range(1, 32):
        if not (small & (size > d)).any():
            break
        i = np.flatnonzero((run[d:] == run[:-d]) & small[run[:-d]])
        i = i[_near(fp[i], fp[i + d], distance, widest)]
        us.append(i)
        vs.append(i + d)
    for k in np.flatnonzero(~small):
        u, v = _forest(fp[starts[k] : ends[k]], distance, widest)
        us.append(np.array(u, np.int64) + starts[k])
        vs.append(np.array(v, np.int64) + starts[k])
    return np.concatenate(us), np.concatenate(vs)


def links(fps: DataFrame, probes: list[Probe], distance: int, widest: int = 0) -> DataFrame:
    """u, v: edges between nodes (node, bits) that connect all that meet under a probe and lie within ``distance`` bits of the
    first word and, if they have more than one, within ``widest`` over all."""
    clear = [(w, m) for w, mask, t in probes for m in _cleared(mask, t)]
    keys = F.explode(F.array(*[F.struct(F.lit(k).alias("part"), F.get("bits", F.lit(w)).bitwiseAND(F.lit(m)).alias("key")) for k, (w, m) in enumerate(clear)])).alias("x")
    keyed = fps.select("node", "bits", keys).select("x.part", "x.key", "node", "bits")
    heavy = materialize(keyed.groupBy("part", "key").agg(F.count("*").alias("n")).filter(F.col("n") > HEAVY), "heavy-keys")
    if heavy.count():
        light = keyed.join(heavy, ["part", "key"], "left_anti")
        if not widest and comb(64, distance) <= 5000:
            again = keyed.join(heavy, ["part", "key"], "left_semi").select("node", "bits").distinct()
            masks = F.array(*map(F.lit, _cleared((1 << 64) - 1, distance)))
            again = again.select("node", "bits", F.posexplode(F.transform(masks, lambda m: F.get("bits", F.lit(0)).bitwiseAND(m))).alias("part", "key"))
        else:
            blocks = F.ceil(2 * F.col("n") / HEAVY).cast("long")
            own = keyed.join(heavy, ["part", "key"]).withColumn("b", F.pmod(F.xxhash64("node"), blocks))
            own = own.select("part", "key", "node", "bits", "b", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("o"))
            again = own.select("node", "bits", "part", F.xxhash64("part", "key", F.least("b", "o"), F.greatest("b", "o")).alias("key"))
        keyed = light.unionByName(again.select((-1 - F.col("part")).alias("part"), "key", "node", "bits"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for b in batches:
            kept = pa.Table.from_batches([b]) if kept is None else pa.concat_tables([kept, pa.Table.from_batches([b])])
            part, key = (kept.column(c).to_numpy() for c in ("part", "key"))
            new = np.flatnonzero((part[1:] != part[:-1]) | (key[1:] != key[:-1]))
            if len(new):
                yield edges(kept.slice(0, int(new[-1]) + 1))
                kept = kept.slice(int(new[-1]) + 1)
        if kept is not None and kept.num_rows:
            yield edges(kept)

    def edges(t: pa.Table) -> pa.RecordBatch:
        node, fp = t.column("node").to_numpy(), _matrix(t.column("bits").combine_chunks())
        u, v = _verify(t.column("part").to_numpy(), t.column("key").to_numpy(), fp, distance, widest)
        return pa.RecordBatch.from_arrays([pa.array(node[x]) for x in (u, v)], names=["u", "v"])

    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keyed.repartition(n, "part", "key").sortWithinPartitions("part", "key").mapInArrow(run, "u long, v long")


#: Up to so many row numbers (16 bytes each) are broadcast to filter the documents; more are joined by shuffle.
BROADCAST_ROWS = 1_000_000


def _nodes(docs: DataFrame, by: tuple[str, ...] = ("bits",)) -> DataFrame:
    """The stored distinct fingerprints (or what else tells nodes apart): node, bits, least (doc_id), n (rows), best (the row that stands for them)."""
    best = F.min(F.struct(F.col("doc.doc_id").isNull().alias("null"), F.col("doc.doc_id").alias("doc_id"), "row_id"))
    fps = docs.groupBy(*by).agg(F.min("doc.doc_id").alias("least"), F.count("*").alias("n"), best.alias("best"))
    return materialize(fps.withColumn("node", F.monotonically_increasing_id()), "distinct-fingerprints")


def _rooted(fps: DataFrame, edges: DataFrame) -> DataFrame:
    """fps with root, the smallest node of their component."""
    return fps.join(components(edges), "node", "left").withColumn("root", F.coalesce("root", "node"))


def labelled(documents: DataFrame, shingle: int = 3, distance: int = 2) -> DataFrame:
    """row_id, doc_id, fp, component_id (the smallest doc_id reachable over links) of every row."""
    docs = materialize(fingerprints(documents, shingle, kept=["doc_id"]), "fingerprints")
    fps = _nodes(docs)
    linked = materialize(_rooted(fps, links(fps, plan_probes(fps, distance), distance)), "rooted")
    ids = linked.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    named = materialize(meet(linked.select("bits", "root", F.col("n").alias("rows")), ids, ["root"]).select("bits", "component_id", F.col("rows").alias("n")), "components")
    return meet(docs, named, ["bits"]).select("row_id", "doc.doc_id", F.get("bits", F.lit(0)).alias("fp"), "component_id")


def _shingle_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """node, hashes (of the text's distinct shingles, sorted, eight bytes each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 200):
                part = b.slice(lo, 200)
                told = [shingle_set(t, shingle).tobytes() for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(told, pa.binary())], names=["node", "hashes"])

    return texts.mapInArrow(run, "node long, hashes binary")


def jaccard(a: bytes, b: bytes) -> float:
    """Of two sorted sets of eight-byte hashes; 1 for two empty ones."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) or len(y) else 1.0


def _tested(edges: DataFrame, values: DataFrame, test) -> DataFrame:
    """The edges (u, v) of whose ends' values (node, value) the test holds."""

    def end(c: str) -> DataFrame:
        degrees = edges.groupBy(F.col(c).alias("node")).agg(F.count("*").alias("n"))
        return values.join(degrees, "node").select(F.col("node").alias(c), F.col("value").alias(f"h{c}"), "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = [test(x, y) for x, y in zip(b.column("hu").to_pylist(), b.column("hv").to_pylist(), strict=True)]
            yield b.select(["u", "v"]).filter(pa.array(held, pa.bool_()))

    met = meet(meet(edges, end("u"), ["u"], F.length("hu")), end("v"), ["v"], F.length("hv"))
    return met.select("u", "v", "hu", "hv").mapInArrow(run, "u long, v long")


def similar(docs: DataFrame, fps: DataFrame, edges: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Stored: the edges whose texts have at least that Jaccard similarity of shingles. docs: row_id, doc; fps: node, best, wide."""
    edges = materialize(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "candidate-links")
    wide = fps.select("node", F.col("wide").alias("value"))
    possible = materialize(_tested(edges, wide, lambda x, y: may_reach(x, y, similarity)), "possible-links")
    nodes = possible.select(F.col("u").alias("node")).union(possible.select("v")).distinct()
    ends = materialize(nodes.join(fps.select("node", "best.row_id"), "node"), "link-ends")
    texts = docs.select("row_id", "doc.text").join(F.broadcast(ends) if ends.count() <= BROADCAST_ROWS else ends, "row_id")
    sets = materialize(_shingle_sets(texts.select("node", "text"), shingle), "shingle-sets")
    out = materialize(_tested(possible, sets.select("node", F.col("hashes").alias("value")), lambda x, y: jaccard(x, y) >= similarity), "links")
    release(edges, possible, ends, sets)
    return out


_FLUSH = 2_000_000  # prefix rows sorted and packed at a time


def _packed(x: np.ndarray) -> bytes:
    """Non-negative numbers, compressed byte plane by byte plane."""
    return zlib.compress(x.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def _unpacked(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(blob), np.uint8).reshape(8, -1).T).view("<u8").ravel()


def prefix_length(size: int, similarity: float) -> int:
    """Of two sets of the similarity, each has one of the other's among its first so many under any one order."""
    return size - max(1, int(np.ceil(similarity * size - 1e-9))) + 1 if size else 0


def frequent_shingles(docs: DataFrame, shingle: int, most: int = 200_000) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingles that stand in many texts of some, and in how many. They only shape the order of prefixes, which loses nothing under any order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                sets = [shingle_set(t, shingle) for t in b.column("text").slice(lo, 1000).to_pylist()]
                key, n = np.unique(np.concatenate(sets), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], names=["key", "n"])

    some = docs.filter(F.pmod(F.xxhash64("row_id"), F.lit(16)) == 0).select("doc.text").mapInArrow(run, "key long, n long")
    counts = some.groupBy("key").agg(F.sum("n").alias("n")).filter("n >= 3").orderBy(F.desc("n"), "key").limit(most)
    told = counts.toArrow()
    key, n = told.column("key").to_numpy().view(np.uint64), told.column("n").to_numpy()
    order = np.argsort(key)
    return key[order], n[order]


def overlap(a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """How many shingles sets of these sizes share at least, if they have the similarity."""
    return np.ceil(similarity / (1 + similarity) * (a + b) - 1e-6)


def _has_partner(key: np.ndarray, place: np.ndarray, size: np.ndarray, similarity: float, steps: int = 256) -> np.ndarray:
    """False only for rows that cannot meet another of their key for the first time there (``_may_link``); rows go by key and size."""
    out, at, end = np.zeros(len(key), bool), np.arange(len(key)), np.searchsorted(key, key, side="right")
    for d in range(1, steps):
        at = at[at + d < len(key)]
        at = at[(key[at] == key[at + d]) & (size[at] >= similarity * size[at + d] - 1e-6)]
        if not len(at):
            return out
        fits = np.minimum(size[at] - place[at], size[at + d] - place[at + d]) >= overlap(size[at], size[at + d], similarity)
        out[at[fits]] = out[at[fits] + d] = True
        if d % 8 == 0:
            left = np.append(0, np.cumsum(~out))
            at = at[~out[at] | (left[end[at]] > left[np.minimum(at + d + 1, end[at])])]
    return out | np.isin(key, key[at])  # keys that are not compared to their end stay whole


def shared_prefixes(docs: DataFrame, shingle: int, similarity: float, parts: int) -> DataFrame:
    """key, row_id, place (from 0, under the order of the prefixes) of the prefix shingles (48 bits of each) by which rows may meet others first."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(frequent_shingles(docs, shingle))

    def pack(keys: list[np.ndarray], ids: list[int], sizes: list[int]) -> pa.RecordBatch:
        base, n = min(ids), [len(x) for x in keys]
        row = np.repeat(np.array(ids) - base, n)
        stand = np.concatenate([np.arange(k) for k in n]) | np.repeat(np.array(sizes) << 32, n)
        key = np.concatenate(keys) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(16)
        order = np.argsort(key)
        key, row, stand = key[order], row[order], stand[order]
        bounds = np.searchsorted(key, [((k << 48) + parts - 1) // parts for k in range(parts)] + [1 << 48])
        told = [(k, base, _packed(np.diff(key[a:z], prepend=np.uint64(0))), _packed(row[a:z]), _packed(stand[a:z])) for k, (a, z) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if z > a]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*told, strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["part", "base", "keys", "rows", "stands"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (often, counts), keys, ids, sizes, size = shared.value, [], [], [], 0
        for b in batches:
            for row, text in zip(b.column("row_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                x = shingle_set(text, shingle)
                if not len(x):
                    continue
                if len(often):
                    at = np.minimum(np.searchsorted(often, x), len(often) - 1)
                    last = often[at] == x
                    x = np.concatenate([x[~last], x[last][np.argsort(counts[at[last]], kind="stable")]])
                keys.append(x[: prefix_length(len(x), similarity)])
                ids.append(row)
                sizes.append(len(x))
                size += len(keys[-1])
                if size >= _FLUSH:
                    yield pack(keys, ids, sizes)
                    keys, ids, sizes, size = [], [], [], 0
        if keys:
            yield pack(keys, ids, sizes)

    def meeting(keys: list[np.ndarray], rows: list[np.ndarray], stands: list[np.ndarray]) -> pa.RecordBatch:
        key, row, stand = np.concatenate(keys), np.concatenate(rows), np.concatenate(stands)
        order = np.argsort(key)
        same = np.diff(key[order]) == 0
        order = order[np.append(same, False) | np.append(False, same)]
        order = order[np.lexsort((stand[order], key[order]))]  # by key, size, place
        key, row, stand = key[order].astype(np.int64), row[order], stand[order].astype(np.int64)
        place = stand & (1 << 32) - 1
        kept = _has_partner(key, place, stand >> 32, similarity)
        return pa.RecordBatch.from_arrays([pa.array(key[kept]), pa.array(row[kept]), pa.array(place[kept])], names=["key", "row_id", "place"])

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, keys, rows, stands = None, [], [], []
        for b in batches:
            for k in range(b.num_rows):
                part = b.column("part")[k].as_py()
                if part != now and keys:
                    yield meeting(keys, rows, stands)
                    keys, rows, stands = [], [], []
                now = part
                keys.append(np.cumsum(_unpacked(b.column("keys")[k].as_py()), dtype=np.uint64))
                rows.append(_unpacked(b.column("rows")[k].as_py()).astype(np.int64) + b.column("base")[k].as_py())
                stands.append(_unpacked(b.column("stands")[k].as_py()))
        if keys:
            yield meeting(keys, rows, stands)

    packed = docs.select("row_id", "doc.text").mapInArrow(run, "part int, base long, keys binary, rows binary, stands binary")
    return packed.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(met, "key long, row_id long, place long")


def _may_link(key: np.ndarray, root: np.ndarray, place: np.ndarray, size: np.ndarray, parity: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row numbers) of equal key and other root whose sizes and parities do not exclude the similarity; rows go by key and size.

    Two sets of the similarity share their first common shingle at places behind which both have enough shingles left for all
    that they must share; so pairs whose key stands later in either are left to that shingle, if they have one."""
    us, vs, at, d = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], np.arange(len(key)), 0
    bound = (1 - similarity) / (1 + similarity)
    while len(at):
        d += 1
        at = at[at + d < len(key)]
        at = at[(key[at] == key[at + d]) & (size[at] >= similarity * size[at + d] - 1e-6)]
        u = at[root[at] != root[at + d]]
        u = u[np.minimum(size[u] - place[u], size[u + d] - place[u + d]) >= overlap(size[u], size[u + d], similarity)]
        apart = np.bitwise_count(parity[u] ^ parity[u + d]).sum(1, dtype=np.int64)
        u = u[apart <= bound * (size[u] + size[u + d]) + 1e-6]
        us.append(u)
        vs.append(u + d)
    return np.concatenate(us), np.concatenate(vs)


def _may_connect(key: np.ndarray, root: np.ndarray, place: np.ndarray, size: np.ndarray, parity: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs as of ``_may_link`` that connect what they connect within each key: at most one for each row."""
    starts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
    bound, us, vs = (1 - similarity) / (1 + similarity), [], []
    for a, z in zip(starts[:-1], starts[1:], strict=True):
        open_ = np.arange(a, z)
        while len(open_):
            front, open_ = [open_[0]], open_[1:]
            while front and len(open_):
                u = front.pop()
                own = root[open_] == root[u]
                apart = np.bitwise_count(parity[open_] ^ parity[u]).sum(1, dtype=np.int64)
                near = (apart <= bound * (size[open_] + size[u]) + 1e-6) & (np.minimum(size[open_], size[u]) >= similarity * np.maximum(size[open_], size[u]) - 1e-6) & ~own
                near &= np.minimum(size[open_] - place[open_], size[u] - place[u]) >= overlap(size[open_], size[u], similarity)
                us.append(np.full(near.sum(), u))
                vs.append(open_[near])
                front += open_[near | own].tolist()
                open_ = open_[~(near | own)]
    return tuple(np.concatenate([np.zeros(0, np.int64), *x]) for x in (us, vs))


def met_prefixes(docs: DataFrame, fps: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Stored: key, node, place of the prefix shingles by which nodes may meet others first."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.agg(F.sum("size")).first()[0] or 0
    parts = max(n, int(rows * (1 - similarity)) // _FLUSH + 1)
    names = materialize(fps.select("best.row_id", "node"), "named-rows")
    named = F.broadcast(names) if names.count() <= BROADCAST_ROWS else names
    if named is not names:  # copies would meet each other everywhere; more nodes are told from them after it
        docs = docs.join(named.select("row_id"), "row_id", "left_semi")
    out = materialize(shared_prefixes(docs, shingle, similarity, parts).join(named, "row_id").select("key", "node", "place"), "met-prefixes")
    release(names)
    return out


def unmet_pairs(met: DataFrame, rooted: DataFrame, similarity: float, least: bool = False) -> DataFrame:
    """Stored: u, v, the pairs of nodes of different roots that may have the similarity; none that has it is left out.

    least: only so many that those of a key are connected."""
    n = int(met.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    few = rooted.count()
    roots = rooted.select("node", "root")
    met = met.join(F.broadcast(roots) if few <= BROADCAST_ROWS else roots, "node")
    keys = met.groupBy("key").agg(F.count("*").alias("n"), (F.min("root") != F.max("root")).alias("apart")).filter("apart").select("key", "n")
    keys = materialize(keys, "open-keys")
    keyed = meet(met, keys.withColumn("rows", F.col("n")), ["key"])
    # Keys of many are dealt into blocks, each pair of which is compared in a task of its own.
    blocks = F.when(F.col("rows") > HEAVY, F.ceil(2 * F.col("rows") / HEAVY)).otherwise(1).cast("long")
    keyed = keyed.withColumn("blocks", blocks).withColumn("b", F.pmod(F.xxhash64("node"), F.col("blocks")))
    keyed = keyed.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    key = F.when(F.col("blocks") == 1, F.col("key")).otherwise(F.xxhash64("key", F.least("b", "o"), F.greatest("b", "o")))
    held = rooted.select("node", "size", "parity")
    held = F.broadcast(held) if few <= BROADCAST_ROWS // 8 else held
    keyed = keyed.select(key.alias("key"), "node", "root", "place").join(held, "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for b in batches:
            kept = pa.Table.from_batches([b]) if kept is None else pa.concat_tables([kept, pa.Table.from_batches([b])])
            at = kept.column("key").to_numpy()
            new = np.flatnonzero(at[1:] != at[:-1])
            if len(new):
                yield pairs(kept.slice(0, int(new[-1]) + 1))
                kept = kept.slice(int(new[-1]) + 1)
        if kept is not None and kept.num_rows:
            yield pairs(kept)

    def pairs(t: pa.Table) -> pa.RecordBatch:
        node = t.column("node").to_numpy()
        u, v = (_may_connect if least else _may_link)(*(t.column(c).to_numpy() for c in ("key", "root", "place", "size")), _matrix(t.column("parity").combine_chunks()), similarity)
        both = np.unique(np.stack([np.minimum(node[u], node[v]), np.maximum(node[u], node[v])]), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in both], names=["u", "v"])

    dealt = keyed.select("key", "node", "root", "place", "size", "parity").repartition(n, "key").sortWithinPartitions("key", "size")
    out = materialize(dealt.mapInArrow(run, "u long, v long"), "unmet-pairs")
    release(keys)
    return out


def one_of_each(documents: DataFrame, shingle: int = 5, similarity: float = 0.8, aim: float = 0.97, words: int = 8) -> DataFrame:
    """The documents less all but one row of each group of near-duplicates: the row of the smallest doc_id stays."""
    docs = materialize(set_fingerprints(documents, shingle, words), "fingerprints", packed=True)
    fps = _nodes(docs, ("bits", "digest", "size", "parity", "wide"))
    share, bits = share_of_bits(similarity), 64 * words
    most = [int(n * share + 4 * sqrt(n * share * (1 - share))) for n in (64, bits)]
    edges = links(fps, plan_similar(fps, words, similarity, aim), *most)
    found = similar(docs, fps, edges, shingle, similarity)
    met = met_prefixes(docs, fps, shingle, similarity)
    spent = [fps, met, found]
    # First what connects the texts of a key, so that large groups are one before all pairs of what is still apart are taken.
    for least in (True, False):
        connected = materialize(_rooted(fps.select("node", "size", "parity"), found), "rooted")
        pairs = unmet_pairs(met, connected, similarity, least)
        more = similar(docs, fps, pairs, shingle, similarity)
        found = found.unionByName(more)
        spent += [connected, pairs, more]
    rooted = _rooted(fps.select("node", "best"), found)
    best = rooted.groupBy("root").agg(F.min("best").alias("best")).select("best.row_id")
    gone = materialize(docs.select("row_id").join(best, "row_id", "left_anti"), "dropped-rows")
    release(*spent)
    small = gone.count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(gone) if small else gone, "row_id", "left_anti").select("doc.*")
