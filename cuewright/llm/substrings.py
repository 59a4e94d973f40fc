"""Removal of repeated byte strings by sampled suffixes and bucket-pointer refinement.

Every byte inside a string of ``LENGTH`` bytes that also starts elsewhere is removed. Suffixes are sampled: a position is
an anchor if the hash of its ``GRAM`` bytes is the least of some LENGTH-byte window, so that equal windows have anchors at
equal offsets. Anchors are put in buckets by that q-gram. Buckets of one anchor are done. Within a bucket, anchors whose
whole surroundings (all windows they can stand in) have one 128-bit BLAKE2 digest are repeats; where surroundings differ, one
text piece for each distinct surrounding is brought together and all its suffixes are refined: initial buckets of FIRST bytes
are taken in turn and each is split by the bucket identifiers of its suffixes' offsets, the deepest that all its suffixes have;
the new identifiers stand at once for the buckets still to come, and so on until LENGTH bytes are told apart. Suffixes
alone in their bucket drop out. The buckets that are left are verified byte by byte to be sets of equal strings.

A bucket of very many anchors is no key of a shuffle: its anchors stay where they are and the bucket is broadcast.
Pieces of one q-gram beyond HEAVY are not refined in one task: each of their windows becomes a row and equal windows meet
by a grouping, which gives the same result.

Texts are known by the first 16 bytes of their SHA-256, so equal texts are looked at once. The pieces of one q-gram's
distinct surroundings (at most 360 bytes each) are refined in one task.

Defined results: null and empty texts have no bytes; texts under LENGTH bytes lose none; repeated rows are copies and lose
all if they are long enough; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, meet

LENGTH, GRAM = 200, 80
SIDE = LENGTH - GRAM
FIRST = 50
_PIECE = 1 << 16
_EDGE = 2 * LENGTH
_BASE = 0x9E3779B97F4A7C15
#: Up to so many text keys (16 bytes each) are broadcast to filter the documents; more are joined by shuffle.
BROADCAST_KEYS = 500_000
HEAVY = 20_000
_TURNS = 2  # parts of a pass over all buckets; each part reads what the parts before it found
_CHUNK = 200_000  # bytes of pieces refined at a time, whole buckets


class _Hash:
    """Hashes of substrings by prefix sums modulo 2^64, for pieces of up to ``piece`` bytes and their edges."""

    def __init__(self, piece: int = _PIECE, base: int = _BASE):
        self.piece, size = piece, piece + 3 * _EDGE
        with np.errstate(over="ignore"):
            self.up, self.down = (np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size, b, np.uint64)])) for b in (base, pow(base, -1, 1 << 64)))

    def sums(self, raw: np.ndarray) -> np.ndarray:
        out = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self.up[: len(raw)], out=out[1:])
        return out

    def of(self, sums: np.ndarray, start: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
        h = (sums[end] - sums[start]) * (self.down[: len(sums)][start])
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        return h


def _sliding(x: np.ndarray, n: int, best) -> np.ndarray:
    """best over x[i : i + n]; shorter by n - 1."""
    k = 1
    while 2 * k <= n:
        x = best(x[:-k], x[k:])
        k *= 2
    return best(x[: len(x) - (n - k)], x[n - k :]) if n > k else x


def anchors(texts: list[bytes], hasher: _Hash) -> dict[str, np.ndarray]:
    """text (number), pos, left and right (reach of the surroundings), gram (hash of the q-gram), w1 and w2 (digest of the surroundings) of the anchors."""
    pieces, out, piece = [], [], hasher.piece
    for i, t in enumerate(texts):
        if len(t) >= LENGTH:
            pieces += [(i, lo, max(0, lo - _EDGE), min(len(t), lo + piece + _EDGE)) for lo in range(0, len(t), piece)]
    k = 0
    while k < len(pieces):
        some, size = [], 0
        while k < len(pieces) and (not some or size + pieces[k][3] - pieces[k][2] <= piece):
            some.append(pieces[k])
            size += pieces[k][3] - pieces[k][2]
            k += 1
        raw = np.frombuffer(b"".join(texts[i][a:b] for i, _, a, b in some), np.uint8)
        length = np.array([b - a for _, _, a, b in some])
        begin = np.cumsum(length) - length
        sums = hasher.sums(raw)
        gram = hasher.of(sums, slice(0, len(raw) - GRAM + 1), slice(GRAM, len(raw) + 1))
        least = _sliding(gram, SIDE + 1, np.minimum)
        owner = np.repeat(np.arange(len(some)), length)
        least[owner[: len(least)] != owner[LENGTH - 1 :]] = 0
        held = _sliding(np.concatenate([np.zeros(SIDE, np.uint64), least, np.zeros(SIDE, np.uint64)]), SIDE + 1, np.maximum)
        at = np.flatnonzero((held[: len(gram)] == gram) & (gram > 0))
        who = owner[at]
        shift = np.array([a for _, _, a, _ in some]) - begin
        pos = at + shift[who]
        core = np.array([lo for _, lo, _, _ in some])[who]
        keep = (pos >= core) & (pos < core + piece)
        at, who, pos = at[keep], who[keep], pos[keep]
        text = np.array([i for i, *_ in some])[who]
        total = np.array([len(t) for t in texts])[text]
        left, right = np.minimum(SIDE, pos), np.minimum(SIDE, total - pos - GRAM)
        flat = raw.tobytes()
        cells = zip((at - left).tolist(), (at + GRAM + right).tolist(), left.tolist(), right.tolist(), strict=True)
        digests = b"".join([hashlib.blake2b(flat[a:b], digest_size=16, salt=bytes((x, y))).digest() for a, b, x, y in cells])
        whole = np.frombuffer(digests, np.uint64).reshape(-1, 2)
        out.append((text, pos, left, right, gram[at], whole[:, 0], whole[:, 1]))
    names = ("text", "pos", "left", "right", "gram", "w1", "w2")
    return {n: np.concatenate([np.zeros(0, np.int64 if j < 4 else np.uint64), *[x[j] for x in out]]) for j, n in enumerate(names)}


def survey(documents: DataFrame, piece: int = _PIECE) -> DataFrame:
    """Stored rows of two kinds: texts (text_id, doc_id, key, n_bytes, sha256) and their anchors (text_id, place, gram, w1, w2).

    place packs an anchor's position and how far its surroundings reach to the left and right."""
    schema = T.StructType([T.StructField("doc_id", documents.schema["doc_id"].dataType), *T.StructType.fromDDL("text_id long, key binary, n_bytes long, sha256 string, place long, gram long, w1 long, w2 long")])
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        hasher, seen = _Hash(piece), TaskContext.get().partitionId() << 36
        for b in batches:
            for lo in range(0, b.num_rows, 250):
                part = b.slice(lo, 250)
                texts = [(t or "").encode("utf-8", "replace") for t in part.column("text").to_pylist()]
                digests = [hashlib.sha256(t) for t in texts]
                key, size = pa.array([d.digest()[:16] for d in digests], pa.binary()), pa.array([len(t) for t in texts], pa.int64())
                none = pa.nulls(len(texts), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.arange(seen, seen + len(texts))), key, size, pa.array([d.hexdigest() for d in digests]), none, none, none, none], names=names)
                a = anchors(texts, hasher)
                n, place = len(a["text"]), a["pos"] << 18 | a["left"] << 9 | a["right"]
                yield pa.RecordBatch.from_arrays([pa.nulls(n, part.column("doc_id").type), pa.array(a["text"] + seen), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.string()), pa.array(place), *[pa.array(a[c].view(np.int64)) for c in ("gram", "w1", "w2")]], names=names)
                seen += len(texts)

    return materialize(documents.select("doc_id", "text").mapInArrow(run, schema), "anchors")


def refine(pieces: list[bytes], text: np.ndarray, first: np.ndarray, twice: np.ndarray, hasher: _Hash) -> np.ndarray:
    """Bucket-pointer refinement of all suffixes of the pieces: starts (in the joined pieces) of LENGTH-byte strings that stand elsewhere.

    text, first: where a piece stands (its text's number and its offset there); the same place in two pieces is one place.
    twice: pieces that are known to stand at two places at least; what only they hold is not told."""
    size = np.array([len(p) for p in pieces])
    begin = np.cumsum(size) - size
    raw = np.frombuffer(b"".join(pieces), np.uint8)
    owner = np.repeat(np.arange(len(pieces)), size)
    n = len(owner)
    room = ((begin + size).astype(np.int32)[owner] - np.arange(n, dtype=np.int32)) // FIRST  # whole steps of FIRST bytes from here to the piece's end
    at = np.flatnonzero(room >= 1)
    value = hasher.of(hasher.sums(raw), at, at + FIRST)
    at, ids = _equal(_refined(at, value, room), raw)
    if not len(at):
        return at
    who = owner[at]
    place, groups = (first - begin)[who] + at, int(ids.max()) + 1
    texts, reach = int(text.max()) + 1, int(place.max()) + 1
    if groups * texts * reach < 1 << 63:  # one number tells bucket, text and place
        spot = np.sort((ids.astype(np.int64) * texts + text[who]) * reach + place)
        of = spot[np.append(True, spot[1:] != spot[:-1])] // (texts * reach)
    else:
        order = np.lexsort((place, text[who], ids))
        i, t, p = ids[order], text[who][order], place[order]
        of = i[np.append(True, (i[1:] != i[:-1]) | (p[1:] != p[:-1]) | (t[1:] != t[:-1]))]
    places = np.bincount(of, minlength=groups) + np.bincount(ids[twice[who]], minlength=groups)
    return np.sort(at[places[ids] >= 2])


def _refined(at: np.ndarray, value: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, bucket) of the suffixes that share their LENGTH bytes with others; at, value: the initial buckets.

    pointers[l] holds, of each position, its bucket by (l + 1) * FIRST bytes, -1 where that is not known; lone holds by how
    many steps of FIRST bytes the position was found to be alone."""
    levels, n = LENGTH // FIRST, len(room)
    pointers, lone = np.full((levels, n), -1, np.int32), np.full(n, 100, np.int8)
    open_, number = _split(at, value)
    lone[at[number < 0]] = 1
    pointers[0][at] = number
    level = np.zeros(n, np.int8)
    level[open_] = 1
    fresh, done = int(number.max(initial=-1)) + 1, []
    bucket = pointers[0].copy()
    while len(open_):
        edges = np.flatnonzero(np.diff(bucket[open_])) + 1
        cuts = np.unique(edges[np.arange(1, _TURNS) * len(edges) // _TURNS]) if len(edges) else []
        going = []
        for some in np.split(open_, cuts):
            depth = level[some]
            fits = room[some] > depth  # the others' strings end with their piece
            some, depth = some[fits], depth[fits]
            later = some + FIRST * depth.astype(np.int64)
            beside = lone[later] + depth
            own = np.append(0, np.cumsum(np.diff(bucket[some]) != 0))[: len(some)]
            gone = np.flatnonzero(beside <= levels)  # what follows stands nowhere else
            parted = np.zeros(len(some) + 1, np.int8)  # by how many steps the others of a bucket differ from those gone
            if len(gone):
                lone[some[gone]] = beside[gone]
                np.maximum.at(parted, own[gone], beside[gone])
                here = np.flatnonzero(beside > levels)
                some, depth, own, later = some[here], depth[here], own[here], later[here]
            if not len(some):
                continue
            step, pointer = np.ones(len(some), np.int8), pointers[0][later]
            for l in range(2, levels + 1 - int(depth.min())):
                reads = pointers[l - 1][later]
                lacks = (reads < 0) | (depth > levels - l)
                if not lacks.all():
                    deeper = np.bincount(own, lacks)[own] == 0
                    step[deeper], pointer[deeper] = l, reads[deeper]
            kept, number = _split(np.arange(len(some)), own.astype(np.uint64) << np.uint64(32) | pointer.astype(np.uint64))
            depth += step
            lone[some[number < 0]] = np.maximum(depth, parted[own])[number < 0]
            some, depth, number = some[kept], depth[kept], number[kept] + fresh
            fresh = int(number.max(initial=fresh)) + 1
            level[some], bucket[some] = depth, number
            for d in range(2, levels + 1):
                here = depth == d
                if here.any():
                    pointers[d - 1][some[here]] = number[here]
            done.append(some[depth == levels])
            going.append(some[depth < levels])
        open_ = np.concatenate([np.zeros(0, np.int64), *going])
    done = np.concatenate([np.zeros(0, np.int64), *done])  # in the order of their buckets, as all positions above
    return done, np.append(0, np.cumsum(np.diff(bucket[done]) != 0))[: len(done)]


def _equal(found: tuple[np.ndarray, np.ndarray], raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets verified: positions whose bytes are not those of their bucket's first get buckets by their bytes."""
    at, ids = found
    if not len(at):
        return at, ids
    head = at[np.searchsorted(ids, ids)]
    apart = np.full(len(raw) + 1, len(raw) + 1)
    apart[at] = head - at
    follows = apart[at - 1] == apart[at]  # the strings one byte before are of one bucket too: only the last byte is new
    follows &= at > 0
    same = raw[at + LENGTH - 1] == raw[head + LENGTH - 1]
    padded = np.append(raw, np.zeros(8, np.uint8))
    words = np.ndarray(len(raw), np.uint64, padded, strides=(1,))  # the eight bytes from each position on
    opens = np.flatnonzero(~follows & (at != head))
    a, b, agrees = at[opens], head[opens], same[opens]
    for k in range(0, LENGTH, 8):
        agrees &= words[a + k] == words[b + k]
    same[opens] = agrees
    if not same.all():
        seen: dict[bytes, int] = {}
        ids = np.array([seen.setdefault(raw[p : p + LENGTH].tobytes(), len(seen)) for p in at.tolist()])
    return at, ids


def _split(at: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The positions whose value is not alone, by value, and for all positions a dense number of their value, -1 for those alone."""
    # Most that are alone are told by a count of slots, before anything is sorted.
    slot = (value * np.uint64(_BASE) >> np.uint64(40)).astype(np.int32) & (1 << min(22, 1 + len(value).bit_length())) - 1
    some = np.flatnonzero(np.bincount(slot)[slot] > 1) if len(value) else slot
    order = np.argsort(value[some])
    v = value[some[order]]
    new = np.ones(len(v), bool)
    new[1:] = v[1:] != v[:-1]
    number = np.cumsum(new) - 1
    alone = new & np.append(new, True)[1:]
    out = np.full(len(value), -1)
    kept = some[order[~alone]]
    out[kept] = number[~alone]
    return at[kept], out


def _runs(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of intervals as maximal runs; touching ones join."""
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > reach[:-1]
    return start[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(start) - 1)] if len(start) else reach


def _texts(documents: DataFrame, keys: DataFrame) -> DataFrame:
    """key, text of the wanted texts, one row for each."""
    keyed = documents.select(F.unhex(F.left(F.sha2(F.coalesce("text", F.lit("")), 256), F.lit(32))).alias("key"), "text")
    few = keys.count() <= BROADCAST_KEYS
    wanted = keyed.join(F.broadcast(keys) if few else keys, "key", "left_semi")
    return wanted.groupBy("key").agg(F.any_value("text").alias("text"))


def repeated_runs(documents: DataFrame, surveyed: DataFrame, chunk: int = _CHUNK, heavy_from: int = HEAVY) -> DataFrame:
    """key, start, end: intervals of bytes to remove, which may overlap; equal texts have the same."""
    found = surveyed.filter("place is not null").select("text_id", "place", "gram", "w1", "w2")
    keys = surveyed.filter("place is null").select("text_id", "key")
    buckets = found.groupBy("gram").agg(F.count("*").alias("n"), (F.min(F.struct("w1", "w2")) != F.max(F.struct("w1", "w2"))).alias("mixed")).filter("n > 1")
    met = materialize(meet(found, materialize(buckets, "buckets"), ["gram"]), "met")
    same = materialize(met.groupBy("gram", "w1", "w2", "mixed").agg(F.count("*").alias("n"), F.min(F.struct("text_id", "place")).alias("one")), "surroundings")
    pos = F.shiftright("place", 18)
    start = (pos - F.shiftright("place", 9).bitwiseAND(511)).alias("start")
    end = (pos + GRAM + F.col("place").bitwiseAND(511)).alias("end")
    copied = meet(met, same.filter("n > 1").select("gram", "w1", "w2", "n"), ["gram", "w1", "w2"])
    whole = copied.select("text_id", start, end)
    mixed = same.filter("mixed")
    heavy = materialize(mixed.groupBy("gram").agg(F.count("*").alias("pieces")).filter(F.col("pieces") > heavy_from).select("gram", F.lit(True).alias("heavy")), "heavy-grams")
    mixed = mixed.join(heavy, "gram", "left").select("gram", "n", F.col("heavy").isNotNull().alias("heavy"), "one.*")
    ones = mixed.join(keys, "text_id").select("key", F.struct("gram", "heavy", start, end, (F.col("n") > 1).alias("twice")).alias("x"))
    ones = materialize(ones.groupBy("key").agg(F.collect_list("x").alias("at")), "pieces")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                raw = (b.column("text")[k].as_py() or "").encode("utf-8", "replace")
                at = b.column("at")[k].values
                s, e = (at.field(c).to_numpy() for c in ("start", "end"))
                yield pa.RecordBatch.from_arrays([at.field("gram"), at.field("heavy"), pa.array([b.column("key")[k].as_py()] * len(s), pa.binary()), at.field("start"), at.field("twice"), pa.array([raw[i:j] for i, j in zip(s.tolist(), e.tolist(), strict=True)], pa.binary())], names=["gram", "heavy", "key", "start", "twice", "piece"])

    texts = _texts(documents, ones.select("key")).join(ones, "key")
    pieces = texts.mapInArrow(cut, "gram long, heavy boolean, key binary, start long, twice boolean, piece binary")

    def told(key: list[bytes], start: np.ndarray, twice: np.ndarray, piece: list[bytes], hasher: _Hash) -> pa.RecordBatch:
        number: dict[bytes, int] = {}
        text = np.array([number.setdefault(k, len(number)) for k in key])
        hit = refine(piece, text, start, twice, hasher)
        size = np.array([len(p) for p in piece])
        begin = np.cumsum(size) - size
        owner = np.searchsorted(begin, hit, side="right") - 1
        hit, owner = hit[~twice[owner]], owner[~twice[owner]]
        a, z = _runs(hit + owner * LENGTH, hit + owner * LENGTH + LENGTH)  # kept apart from piece to piece
        who = np.searchsorted(begin + np.arange(len(size)) * LENGTH, a, side="right") - 1
        shift = start[who] - begin[who] - who * LENGTH
        return pa.RecordBatch.from_arrays([pa.array([key[i] for i in who], pa.binary()), pa.array(a + shift), pa.array(z + shift)], names=["key", "start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for b in batches:
            t = pa.Table.from_batches([b]) if kept is None else pa.concat_tables([kept, pa.Table.from_batches([b])])
            kept = t
            if t.column("piece").nbytes < chunk:
                continue
            gram = t.column("gram").to_numpy()
            last = int(np.searchsorted(np.cumsum(gram[1:] != gram[:-1]), (gram[1:] != gram[:-1]).sum())) + 1 if (gram != gram[0]).any() else 0
            if last:
                yield from parts(t.slice(0, last))
                kept = t.slice(last)
        if kept is not None:
            yield from parts(kept)

    def parts(t: pa.Table) -> Iterator[pa.RecordBatch]:
        gram = t.column("gram").to_numpy()
        bounds = np.concatenate([[0], np.flatnonzero(gram[1:] != gram[:-1]) + 1, [len(gram)]])
        size = np.concatenate([[0], np.cumsum([len(p) for p in t.column("piece").to_pylist()])])
        lo, hasher = 0, _Hash(chunk)
        while lo < len(gram):
            hi = bounds[min(len(bounds) - 1, max(np.searchsorted(bounds, lo, side="right"), np.searchsorted(size[bounds], size[lo] + chunk, side="right") - 1))]
            s = t.slice(lo, hi - lo)
            if size[hi] - size[lo] > hasher.piece:
                hasher = _Hash(int(size[hi] - size[lo]))
            yield told(s.column("key").to_pylist(), s.column("start").to_numpy(), s.column("twice").to_numpy(), s.column("piece").to_pylist(), hasher)
            lo = hi

    n = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = materialize(pieces, "cut") if heavy.count() else pieces.filter("not heavy")
    fine = pieces.filter("not heavy").repartition(n, "gram").sortWithinPartitions("gram").mapInArrow(run, "key binary, start long, end long")
    if heavy.count():

        def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            one, two = _Hash(), _Hash(base=0xC2B2AE3D27D4EB4F)
            for b in batches:
                for lo in range(0, b.num_rows, 100):
                    part = b.slice(lo, 100)
                    raw = part.column("piece").to_pylist()
                    size = np.array([len(p) for p in raw])
                    begin = np.cumsum(size) - size
                    owner = np.repeat(np.arange(len(raw)), np.maximum(0, size - LENGTH + 1))
                    at = np.concatenate([np.arange(x, x + max(0, n - LENGTH + 1)) for x, n in zip(begin.tolist(), size.tolist(), strict=True)])
                    joined = np.frombuffer(b"".join(raw), np.uint8)
                    h = [pa.array(x.of(x.sums(joined), at, at + LENGTH).view(np.int64)) for x in (one, two)]
                    who = pa.array(owner)
                    yield pa.RecordBatch.from_arrays([*h, part.column("key").take(who), pa.array(at - begin[owner] + part.column("start").to_numpy()[owner]), part.column("twice").take(who)], names=["h1", "h2", "key", "start", "twice"])

        spots = pieces.filter("heavy").mapInArrow(windows, "h1 long, h2 long, key binary, start long, twice boolean")
        place = F.struct("key", "start")
        met = spots.groupBy("h1", "h2").agg(F.min(place).alias("a"), F.max(place).alias("z"), F.max("twice").alias("t")).filter("t or a != z").select("h1", "h2")
        fine = fine.unionByName(spots.filter("not twice").join(met, ["h1", "h2"]).select("key", "start", (F.col("start") + LENGTH).alias("end")))
    # Equal texts: the least text_id speaks for all.
    speaks = keys.groupBy("key").agg(F.min("text_id").alias("text_id"))
    return whole.filter(F.col("end") - F.col("start") >= LENGTH).join(speaks, "text_id").select("key", "start", "end").unionByName(fine)


def remove_repeats(documents: DataFrame, piece: int = _PIECE, chunk: int = _CHUNK, heavy_from: int = HEAVY) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes; null where none are removed), spans (start, end)."""
    surveyed = survey(documents, piece)
    cover = repeated_runs(documents, surveyed, chunk, heavy_from).groupBy("key").agg(F.collect_list(F.struct("start", "end")).alias("at"))
    cover = materialize(cover, "cover")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k in range(b.num_rows):
                at = b.column("at")[k].values
                s, e = _runs(at.field("start").to_numpy(), at.field("end").to_numpy())
                raw = (b.column("text")[k].as_py() or "").encode("utf-8", "replace")
                kept = b"".join(raw[i:j] for i, j in zip([0, *e.tolist()], [*s.tolist(), len(raw)], strict=True))
                rows.append((int((e - s).sum()), hashlib.sha256(kept).hexdigest(), kept, [{"start": int(i), "end": int(j)} for i, j in zip(s, e, strict=True)]))
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(cols[0], pa.int64()), pa.array(cols[1]), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], names=["key", "n_removed", "kept_sha256", "kept", "spans"])

    cut = _texts(documents, cover.select("key")).join(cover, "key").mapInArrow(run, "key binary, n_removed long, kept_sha256 string, kept binary, spans array<struct<start:long,end:long>>")
    rows = surveyed.filter("place is null").select("doc_id", "key", "n_bytes", "sha256")
    out = rows.join(cut, "key", "left")
    return out.select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.when(F.col("spans").isNull(), 0).otherwise(F.size("spans")).cast("long").alias("n_spans"),
        F.coalesce("kept_sha256", "sha256").alias("kept_sha256"), "kept", "spans",
    )
