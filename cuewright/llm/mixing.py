"""Mixing sources to target weights by subset-sum budget fitting.

A document's size is its number of words. Sources in code point order (null last) weigh 5, 2, 1, repeating; together they
may take ``share`` times all words, but none over ``most`` times its own, the excess being reshared by weight. A source
takes all its documents as often as its target holds its size, and fits the rest of the budget with a subset of them:
documents are counted by exact length, every length gives its proportional number of documents, rounded down, the longest
lengths give more until ``reserve`` words are left, and these, at every size, are fitted by bounded-knapsack dynamic programming
over the documents still open, of which the short lengths keep some.
Which documents of a length are taken is decided by a seeded hash.

Sources are numbered by a range sort and their common level is found by repeated sums, so that there may be any number.

Defined results: null and empty texts have size 0 and are never short of their (zero) words; sources of size 0 have target
0; repeated rows count and are taken one by one; equal hashes fall back on doc_id; empty tables give empty results; other
columns are ignored. Reruns agree.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import TOKEN, materialize

WEIGHTS = (5, 2, 1)
_SHARDS, _SHARD = 256, 100_000  # at least so many shards, and more to hold about so many documents each


def fit(counts: dict[int, int], budget: int, reserve: int = 20_000) -> dict[int, int]:
    """How many documents of each length to take, so that their words come as near below budget as the method finds."""
    counts = {n: c for n, c in counts.items() if n > 0 and c > 0}
    total = sum(n * c for n, c in counts.items())
    if budget >= total:
        return counts
    if budget <= 0:
        return {}
    taken = {n: c * budget // total for n, c in counts.items()}
    left = budget - sum(n * c for n, c in taken.items())
    lengths = sorted(counts, reverse=True)
    for n in lengths:
        k = min(counts[n] - taken[n], max(0, left - reserve + n - 1) // n, left // n)
        taken[n] += k
        left -= k * n
    # Sums reachable with the open documents, by binary splitting; came[s] is the item that first reached s.
    reached, came, items, mask = 1, {}, [], (1 << left + 1) - 1
    for n in lengths:
        open_, k = counts[n] - taken[n], 1
        while open_ > 0 and n <= left and not reached >> left & 1:
            k = min(k, open_)
            if n * k <= left:
                new = (reached << n * k) & mask & ~reached
                reached |= new
                items.append((n, k))
                while new:
                    low = new & -new
                    came[low.bit_length() - 1] = len(items) - 1
                    new ^= low
            open_ -= k
            k *= 2
    s = reached.bit_length() - 1
    while s > 0:
        n, k = items[came[s]]
        taken[n] += k
        s -= n * k
    return {n: c for n, c in taken.items() if c}


def numbered(sources: DataFrame) -> DataFrame:
    """sources with their number (from 0) in code point order, null last; stored."""
    key = [F.col("source").isNull(), F.col("source").cast("binary")]
    parts = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(sources.repartitionByRange(parts, *key).sortWithinPartitions(*key).withColumn("at", F.monotonically_increasing_id()), "sources")
    part = F.shiftright("at", 33)  # what the identifier is made of: the partition, and the row in it
    before, offsets = 0, {0: 0}
    for r in dealt.groupBy(part.alias("part")).count().orderBy("part").collect():  # one row for each partition
        offsets[r.part] = before
        before += r["count"]
    offset = F.element_at(F.create_map(*[F.lit(x).cast("long") for kv in offsets.items() for x in kv]), part)
    return dealt.withColumn("number", offset + F.col("at").bitwiseAND((1 << 33) - 1)).drop("at")


def targets(sources: DataFrame, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """sources: source, source_size. Adds target: min(most * source_size, weight * level), where level spends the budget."""
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("number") % len(WEIGHTS) + 1).cast("int"))
    w = numbered(sources).withColumn("weight", weight.cast("double")).withColumn("cap", most * F.col("source_size"))
    budget = share * (w.agg(F.sum("source_size")).first()[0] or 0)
    level = -1.0
    while True:  # the level only rises, until no further source is full
        full = F.col("cap") <= F.col("weight") * level
        spent, open_ = w.agg(F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("weight")))).first()
        new = (budget - (spent or 0.0)) / open_ if open_ else float("inf")
        if new <= level or not open_:
            level = max(new, level)
            break
        level = new
    return w.select("source", "source_size", F.least("cap", F.col("weight") * level).alias("target"))


def mix(documents: DataFrame, seed: int = 42, share: float = 1.5, most: float = 2.0, reserve: int = 20_000, kept: list[str] | None = None) -> DataFrame:
    """doc_id (or, if columns are to be kept, doc with them), size, source_size, target, taken (words taken, repeats counted), times, source."""
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(TOKEN)).cast("long")
    carried = F.struct(*[F.col(f"`{c}`") for c in kept or ["doc_id"]]).alias("doc")
    docs = documents.select(F.monotonically_increasing_id().alias("row_id"), carried, "doc_id", "source", size.alias("size"))
    stored = materialize(docs.withColumn("draw", F.xxhash64(F.lit(seed), "doc_id")), "sizes", packed=True)
    docs = stored.drop("doc").withColumn("shard", F.pmod("draw", F.lit(max(_SHARDS, stored.count() // _SHARD))).cast("int"))
    shards = materialize(docs.groupBy("source", "size", "shard").agg(F.count("*").alias("n")), "lengths")
    lengths = shards.groupBy("source", "size").agg(F.sum("n").alias("n"))
    sized = materialize(targets(lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), share, most), "targets")
    plan = sized.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    plan = plan.withColumn("budget", F.floor(F.col("target") - F.col("whole") * F.col("source_size")).cast("long"))

    def chosen(pdf: pd.DataFrame) -> pd.DataFrame:
        k = fit(dict(zip(pdf["size"].tolist(), pdf["n"].tolist(), strict=True)), int(pdf["budget"].iloc[0]), reserve)
        return pdf[["source", "size"]].assign(extra=[k.get(n, 0) for n in pdf["size"].tolist()])

    known = lengths.join(F.broadcast(plan.select("source", "budget")) if sized.count() < 100_000 else plan.select("source", "budget"), lengths["source"].eqNullSafe(plan["source"])).select(lengths["source"], "size", "n", "budget")
    extra = materialize(known.groupBy("source").applyInPandas(chosen, "source string, size long, extra long"), "extra")
    # A document's rank in its length: the documents of earlier shards, then its place in its shard.
    by_shard = Window.partitionBy("source", "size").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    s, e, p = shards.withColumn("before", F.coalesce(F.sum("n").over(by_shard), F.lit(0))).alias("s"), extra.alias("e"), plan.alias("p")
    quota = s.join(e, F.col("s.source").eqNullSafe(F.col("e.source")) & (F.col("s.size") == F.col("e.size")))
    quota = quota.select("s.source", "s.size", "s.shard", (F.col("extra") - F.col("before")).alias("quota")).alias("q")
    place = F.row_number().over(Window.partitionBy("source", "size", "shard").orderBy("draw", "doc_id", "row_id"))
    d = docs.withColumn("place", place).alias("d")
    out = d.join(quota, F.col("d.source").eqNullSafe(F.col("q.source")) & (F.col("d.size") == F.col("q.size")) & (F.col("d.shard") == F.col("q.shard")))
    few = F.broadcast(p) if sized.count() < 100_000 else p
    out = out.join(few, F.col("d.source").eqNullSafe(F.col("p.source")))
    times = F.col("whole") + F.when(F.col("place") <= F.col("quota"), 1).otherwise(0)
    out = out.select("row_id", "doc_id", F.col("d.size").alias("size"), "source_size", "target", (F.col("d.size") * times).alias("taken"), times.alias("times"), F.col("d.source").alias("source"))
    return stored.select("row_id", "doc").join(out.drop("doc_id"), "row_id").drop("row_id") if kept else out.drop("row_id")
