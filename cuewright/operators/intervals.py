"""Interval algebra and overlap joins over rows with s and e.

Overlap is open (least(e) - greatest(s) > t), merging is closed (s <= earlier e), gap merging is strict (s - earlier e < gap).
Joins deal both sides into time cells and meet on (keys, cell), so that they plan as equi joins; a pair is kept in the
first cell both sides share. Pick a cell near the common length (``cell_of``): an interval makes a row for each cell that it
touches. Where one key and cell hold very many rows, ``deal`` spreads the left side over so many tasks and copies the right one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELL = 7200.0


def overlap(a: str = "l", b: str = "r") -> Column:
    return F.least(F.col(f"{a}.e"), F.col(f"{b}.e")) - F.greatest(F.col(f"{a}.s"), F.col(f"{b}.s"))


def _cells(df: DataFrame, cell: float, reach: float = 0.0) -> DataFrame:
    first, last = F.floor((F.col("s") - reach) / cell), F.floor((F.col("e") + reach) / cell)
    return df.withColumn("_first", first).withColumn("_cell", F.explode(F.sequence(first, F.greatest(first, last))))


def cell_of(*sides: DataFrame, share: float = 0.9, least: float = 1.0) -> float:
    """A cell for intervals of these tables: the length that ``share`` of them do not exceed (one pass over each)."""
    found = [df.agg(F.percentile_approx(F.col("e") - F.col("s"), share)).first()[0] for df in sides]
    return max([least, *(x for x in found if x)])


def interval_join(left: DataFrame, right: DataFrame, keys: Sequence[str], more_than: float = 0.0, cell: float = CELL, deal: int = 1) -> DataFrame:
    """Structs l and r of all pairs with equal keys that overlap by more than ``more_than`` seconds, and ov."""
    places = {"l": F.pmod(F.xxhash64("s", "e", *keys), F.lit(deal)), "r": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(deal - 1).cast("long")))}
    pack = lambda df, name: _cells(df, cell).withColumn("_deal", places[name] if deal > 1 else F.lit(0)).select(F.struct(*df.columns).alias(name), F.struct("_first", "_cell", "_deal", *keys).alias(f"_{name}"))
    a, b = pack(left, "l"), pack(right, "r")
    on = (F.col("_l._cell") == F.col("_r._cell")) & (F.col("_l._cell") == F.greatest("_l._first", "_r._first"))
    on = on & (F.col("_l._deal") == F.col("_r._deal")) if deal > 1 else on
    for k in keys:
        on = on & (F.col(f"_l.{k}") == F.col(f"_r.{k}"))
    return a.join(b, on).select("l", "r", overlap().alias("ov")).filter(F.col("ov") > more_than)


def argmax_overlap(left: DataFrame, right: DataFrame, keys: Sequence[str], ident: Sequence[str], more_than: float = 0.0, cell: float = CELL, at_least: Column | None = None) -> DataFrame:
    """For each left row (told by ident) the right row with most overlap; ties go to the earliest start, then pos."""
    met = interval_join(left, right, keys, more_than, cell)
    if at_least is not None:
        met = met.filter(F.col("ov") >= at_least)
    best = met.groupBy(*[F.col(f"l.{k}").alias(k) for k in ident]).agg(F.min(F.struct(-F.col("ov"), "r.s", "r.pos", "l", "r")).alias("x"))
    return best.select("x.l", "x.r", (-F.col("x.col1")).alias("ov"))


def union(df: DataFrame, keys: Sequence[str], gap: float | None = None, extra: Sequence[Column] = ()) -> DataFrame:
    """Maximal runs: keys, s, e and extra aggregates. gap None: overlapping or touching join; else starts within the gap."""
    order = Window.partitionBy(*keys).orderBy("s", "e", "pos")
    before = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.col("s") > before if gap is None else F.col("s") - before >= gap
    marked = df.withColumn("_run", F.coalesce(opens, F.lit(True)).cast("int"))
    marked = marked.withColumn("_run", F.sum("_run").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "_run").agg(F.min("s").alias("s"), F.max("e").alias("e"), *extra).drop("_run")


def intersect(a: DataFrame, b: DataFrame, keys: Sequence[str], cell: float = CELL) -> DataFrame:
    """keys, s, e of all common stretches of positive length; both sides merged."""
    met = interval_join(a, b, keys, 0.0, cell)
    return met.select(*[f"l.{k}" for k in keys], F.greatest("l.s", "r.s").alias("s"), F.least("l.e", "r.e").alias("e"))


def minus(a: DataFrame, b: DataFrame, keys: Sequence[str], least: float = 0.01, cell: float = CELL) -> DataFrame:
    """keys, s, e of what is left of merged a outside merged b, pieces of over ``least`` seconds."""
    cuts = a.select(*keys, F.col("s").alias("a_s"), F.col("e").alias("a_e"))
    inside = interval_join(a, b, keys, 0.0, cell).select(*[f"l.{k}" for k in keys], F.col("l.s").alias("a_s"), F.col("l.e").alias("a_e"), F.greatest("l.s", "r.s").alias("s"), F.least("l.e", "r.e").alias("e"))
    ends = inside.unionByName(cuts.withColumn("s", F.col("a_e")).withColumn("e", F.col("a_e")))
    w = Window.partitionBy(*keys, "a_s", "a_e").orderBy("s", "e")
    left = ends.select(*keys, F.coalesce(F.lag("e").over(w), F.col("a_s")).alias("s"), F.col("s").alias("e"))
    return left.filter(F.col("e") - F.col("s") > least)


def covered(left: DataFrame, right: DataFrame, keys: Sequence[str], ident: Sequence[str], cell: float = CELL) -> DataFrame:
    """left with sec: the sum of its overlaps with right (union right first to count each second once)."""
    met = interval_join(left, right, keys, 0.0, cell)
    sums = met.groupBy(*[F.col(f"l.{k}").alias(k) for k in ident]).agg(F.sum("ov").alias("sec"))
    return left.join(sums, list(ident), "left").withColumn("sec", F.coalesce("sec", F.lit(0.0)))


def ratio(sec: Column, s: Column, e: Column) -> Column:
    """Covered share of [s, e], in [0, 1]; 0 for an empty interval."""
    return F.when(e <= s, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.try_divide(sec, e - s))))


def nearest(left: DataFrame, right: DataFrame, keys: Sequence[str], ident: Sequence[str], within: float) -> DataFrame:
    """left rows (with s = e = their time) and the nearest right time up to ``within`` seconds away: dist and at, null beyond.

    As-of in both directions over one sorted union; ties go to the earlier time."""
    points = left.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("s").alias("_t"), F.lit(1).alias("_own"), F.struct(*left.columns).alias("l"))
    marks = right.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("s").alias("_t"), F.lit(0).alias("_own"), F.lit(None).cast(points.schema["l"].dataType).alias("l"))
    w = Window.partitionBy(*[f"_{k}" for k in keys]).orderBy("_t", "_own")
    at = F.when(F.col("_own") == 0, F.col("_t"))
    both = points.unionByName(marks).withColumn("before", F.last(at, True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    both = both.withColumn("after", F.first(at, True).over(w.rowsBetween(0, Window.unboundedFollowing))).filter("_own = 1")
    back, ahead = F.col("_t") - F.col("before"), F.col("after") - F.col("_t")
    take = F.when(F.col("after").isNull() | (back <= ahead), F.col("before")).otherwise(F.col("after"))
    out = both.withColumn("at", take).withColumn("dist", F.abs(F.col("_t") - F.col("at")))
    near = F.col("dist") <= within
    return out.select("l.*", F.when(near, F.col("at")).alias("at"), F.when(near, F.col("dist")).alias("dist"))
