"""Approximate nearest neighbours by cosine: inverted lists and an adaptive dimension scan.

Unit vectors are turned by a seeded random rotation and put in the list of their nearest centre. A query scans the lists
of its ``probes`` nearest centres in column blocks of ``BLOCK`` dimensions: after d of D dimensions the partial squared
distance, scaled by D/d, estimates the whole one, and a candidate is abandoned if the hypothesis that it lies within the
query's k-th best distance so far is rejected, that is, if the estimate exceeds that distance times (1 + EPS / sqrt(d))^2.
Candidates that survive all blocks get their exact cosine on the original vectors, in double precision.

Centres are fitted on a bounded sample, the ``sample`` vectors with the smallest seeded hash of vec_id, and so is the
number of probes: the least that finds ``aim`` of the sample's true neighbours. All vectors are put in the lists. Queries
meet the lists they probe, and no others, by co-grouping: long lists are dealt into parts and many queries of one list into
blocks, so that no task holds more than _PART vectors and _ASKED queries. A first round scans each query's nearest list,
whose k-th best distance bounds the second round over its other lists; each task returns its k best, which are merged.

Defined results: vectors that are null, zero, of another length than most of the sample, or hold null or non-finite
components take no part, nor do rows without vec_id; a repeated query counts once, with its smallest vector; repeated
candidates are candidates of their own; ties go to smaller vec_id; empty tables give empty results; other columns are
ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

BLOCK, EPS = 16, 2.1
_ROWS = 2048
_PART, _ASKED = 50_000, 20_000  # vectors of a list, and queries that probe it, that one task holds


def _usable(v: Column) -> Column:
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0)


def _unit(x: np.ndarray) -> np.ndarray:
    x = _scaled(x)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _scaled(x: np.ndarray) -> np.ndarray:
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def cosines(rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    """In double precision; each row is summed in the same order, so that equal vectors tie. Rows are first scaled by powers
    of two, which changes no digit but keeps squares of very large and very small components in range."""
    rows, q = _scaled(rows), _scaled(q[None])[0]
    return (rows * q).sum(1) / np.sqrt((rows * rows).sum(1)) / np.sqrt((q * q).sum())


class Lists:
    """The rotation, the centres and how many lists to probe."""

    def __init__(self, sample: np.ndarray, k: int, aim: float, seed: int = 17):
        r = np.random.default_rng(seed)
        self.dim = sample.shape[1]
        self.rotation = np.linalg.qr(r.normal(size=(self.dim, self.dim)))[0]
        x = _unit(sample) @ self.rotation
        n = int(max(1, min(256, len(x) // 40)))
        self.centres = x[r.choice(len(x), n, replace=False)]
        for _ in range(10):
            near = np.argmax(x @ self.centres.T, axis=1)
            sums = np.zeros_like(self.centres)
            np.add.at(sums, near, x)
            alive = np.abs(sums).sum(1) > 0
            self.centres[alive] = _unit(sums[alive])
        near, tried = np.argmax(x @ self.centres.T, axis=1), x[:200]
        sims = tried @ x.T
        sims[np.arange(len(tried)), np.arange(len(tried))] = -2
        best = np.argsort(-sims, axis=1, kind="stable")[:, : min(k, len(x) - 1)]
        order = np.argsort(-(tried @ self.centres.T), axis=1, kind="stable")
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(n)[None].repeat(len(tried), 0), 1)
        at = np.sort(np.take_along_axis(place, near[best], 1).ravel())
        self.probes = int(at[int(np.ceil(aim * len(at))) - 1]) + 1 if len(at) else n

    def rotate(self, x: np.ndarray) -> np.ndarray:
        return (_unit(x) @ self.rotation).astype(np.float32)

    def nearest(self, turned: np.ndarray, n: int) -> np.ndarray:
        return np.argsort(-(turned @ self.centres.T), axis=1, kind="stable")[:, :n]

    def probed(self, turned: np.ndarray, probes: int, least: np.ndarray) -> list[list[int]]:
        """The ``probes`` nearest lists of each query, and as many more as hold ``least`` vectors together, or all."""
        near = self.nearest(turned, len(self.centres))
        enough = (np.cumsum(self.sizes[near], axis=1) < least[:, None]).sum(1) + 1
        return [x[: max(probes, n)].tolist() for x, n in zip(near, enough, strict=True)]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)


def _distance(cosine: float) -> float:
    return max(0.0, 2 - 2 * cosine) + 1e-6


class Best:
    """The k best of each query so far."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, turned: np.ndarray, k: int, limit: np.ndarray | None = None):
        self.ids, self.vectors, self.turned, self.k = ids, vectors, turned, k
        self.found: list[list[tuple[float, int]]] = [[] for _ in ids]
        # the k-th best squared distance of unit vectors, or what bounds it from before
        self.limit = np.full(len(ids), np.inf, np.float32) if limit is None else limit.astype(np.float32)
        self.dims = 0  # dimensions read, against len * dim for a full scan

    def scan(self, asking: np.ndarray, ids: np.ndarray, vectors: np.ndarray, turned: np.ndarray) -> None:
        """Candidates of one list, ``asking``: the queries that probe it."""
        dim = turned.shape[1]
        cols = [np.ascontiguousarray(turned[:, lo : lo + BLOCK].T) for lo in range(0, dim, BLOCK)]
        norms = [(c * c).sum(0) for c in cols]
        q = self.turned[asking]
        first = q[:, :BLOCK]
        part = (first * first).sum(1)[:, None] + norms[0] - 2 * (first @ cols[0])
        self.dims += part.size * min(BLOCK, dim)
        for row, i in enumerate(asking):
            d, alive = min(BLOCK, dim), None
            dist = part[row]
            for j in range(1, len(cols) + 1):
                held = dist * np.float32(dim / d) <= self.limit[i] * np.float32((1 + (EPS / d**0.5 if d < dim else 0)) ** 2) + np.float32(1e-5)
                alive = np.flatnonzero(held) if alive is None else alive[held]
                if j == len(cols) or not len(alive):
                    break
                own = q[row, j * BLOCK : (j + 1) * BLOCK]
                dist = dist[held] + norms[j][alive] + (own * own).sum() - 2 * (own @ cols[j][:, alive])
                self.dims += len(alive) * len(own)
                d += len(own)
            alive = alive[ids[alive] != self.ids[i]]
            if not len(alive):
                continue
            score = cosines(vectors[alive], self.vectors[i])
            order = np.lexsort((ids[alive], -score))[: self.k]
            best = sorted([*self.found[i], *((-score[o], int(ids[alive[o]])) for o in order)])[: self.k]
            self.found[i] = best
            if len(best) == self.k:
                self.limit[i] = min(self.limit[i], _distance(-best[-1][0]))


def build(vectors: DataFrame, k: int = 5, sample: int = 20_000, aim: float = 0.97) -> tuple[Lists, DataFrame] | None:
    """The fitted lists, and the stored index: list, vec_id, embedding."""
    usable = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).filter(F.col("vec_id").isNotNull() & _usable(F.col("embedding")))
    drawn = usable.orderBy(F.xxhash64("vec_id", F.lit(23)), "vec_id").limit(sample)  # the documented bound
    rows = [r.embedding for r in drawn.select("embedding").collect()]
    if not rows:
        return None
    dim = Counter(map(len, rows)).most_common(1)[0][0]
    lists = Lists(np.array([r for r in rows if len(r) == dim]), k, aim)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                near = lists.nearest(lists.rotate(_matrix(b.column("embedding"), dim)), 1)[:, 0]
                yield pa.RecordBatch.from_arrays([pa.array(near, pa.int32()), b.column("vec_id"), b.column("embedding")], names=["list", "vec_id", "embedding"])

    put = usable.filter(F.size("embedding") == dim).mapInArrow(assign, "list int, vec_id long, embedding array<double>")
    put = materialize(put, "lists")
    sizes = {r.list: r["count"] for r in put.groupBy("list").count().collect()}  # one row for each list
    lists.sizes = np.array([sizes.get(i, 0) for i in range(len(lists.centres))])
    return lists, put


def _times(counts: np.ndarray, most: int) -> Column:
    """By ``list``: in how many parts to deal so many rows."""
    return F.element_at(F.array(*[F.lit(int(max(1, -(-n // most)))) for n in counts]), F.col("list") + 1)


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, probes: int | None = None, **fit) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query, which is never its own neighbour."""
    built = build(vectors, k, **fit)
    if built is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    lists, index = built
    dim, probes = lists.dim, probes or lists.probes
    asked = queries.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).filter(F.col("vec_id").isNotNull() & _usable(F.col("embedding")) & (F.size("embedding") == dim))
    asked = asked.groupBy("vec_id").agg(F.min("embedding").alias("embedding"), F.count("*").alias("own"))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, _ROWS):
                part = b.slice(lo, _ROWS)
                near = lists.probed(lists.rotate(_matrix(part.column("embedding"), dim)), probes, k + part.column("own").to_numpy())  # its own rows are no candidates
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("embedding"), pa.array(near, pa.list_(pa.int32()))], names=["query_id", "embedding", "lists"])

    asked = materialize(asked.mapInArrow(choose, "query_id long, embedding array<double>, lists array<int>"), "queries")
    probing = asked.select("query_id", "embedding", F.posexplode("lists").alias("place", "list"))
    asking = {r.list: r["count"] for r in probing.groupBy("list").count().collect()}  # one row for each list
    blocks = _times(np.array([asking.get(i, 0) for i in range(len(lists.sizes))]), _ASKED)
    parts = _times(lists.sizes, _PART)
    key = ["list", "part", "block"]
    # Both sides' keys are ints: a long would be dealt elsewhere.
    dealt = index.withColumn("part", F.pmod(F.xxhash64("vec_id"), parts).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))

    def scan(asked: pa.Table, rows: pa.Table) -> pa.Table:
        n = asked.num_rows if rows.num_rows else 0
        own = _matrix(asked.column("embedding").combine_chunks(), dim)[:n]
        best = Best(asked.column("query_id").to_numpy()[:n], own, lists.rotate(own) if n else own, k, asked.column("bound").to_numpy()[:n])
        ids = rows.column("vec_id").to_numpy()
        for lo in range(0, len(ids) if n else 0, _ROWS):
            x = _matrix(rows.column("embedding").slice(lo, _ROWS).combine_chunks(), dim)
            best.scan(np.arange(n), ids[lo : lo + _ROWS], x, lists.rotate(x))
        told = [(int(q), i, -s) for q, found in zip(best.ids, best.found, strict=True) for s, i in found]
        cols = list(zip(*told, strict=True)) or [(), (), ()]
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.float64())})

    def met(probing: DataFrame) -> DataFrame:
        spread = probing.select("list", "query_id", "embedding", "bound", F.pmod(F.xxhash64("query_id"), blocks).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
        if [spread.schema[c].dataType for c in key] != [dealt.schema[c].dataType for c in key]:
            raise TypeError("keys of the two sides differ")
        return spread.groupBy(*key).cogroup(dealt.groupBy(*key)).applyInArrow(scan, "query_id long, vec_id long, score double")

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    first = materialize(met(probing.filter("place = 0").withColumn("bound", F.lit(float("inf")))).withColumn("rank", rank).filter(F.col("rank") <= k), "nearest-lists")
    bound = first.filter(F.col("rank") == k).select("query_id", (F.greatest(F.lit(0.0), 2 - 2 * F.col("score")) + 1e-6).alias("bound"))
    more = met(probing.filter("place > 0").join(bound, "query_id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf")))))
    return first.drop("rank").unionByName(more).withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
