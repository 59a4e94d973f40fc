"""Benchmark decontamination over a distributed positional inverted index; DataFrame functions only.

``build_index`` tokenises every document once and stores the postings (row, term, position) of all terms that any test
item uses, besides one entry with the document's word count. A test window of ``width`` words occurs where every one of
its terms has a posting at the same offset-adjusted position. The search starts from the posting list of each window's
two rarest terms: where they stand at their distance is an alignment (row, item, diagonal), with which the other terms' lists
are intersected. Proximity matches start likewise from an item's two rarest terms, wherever these stand near each other: an item
is near where all its distinct terms stand, in any order, within its length plus ``slack`` words.

The lists of anchor terms are read by a broadcast of the anchors while these are few, else by a join that deals each term's
postings by row, so that a very common term is no single key.

Defined results: null or empty texts have no words and no hits; items without words are ignored; repeated document rows
are judged one by one; items of equal identifier are told apart inside and count once in the digest; null item
identifiers count as the text ``null``; empty tables give empty results or no hits; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, lower_ascii, materialize

_WORD_COUNT = "\x01"  # no WORD match holds it
#: A counted table of up to so many rows (some 50 bytes each at most) is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 500_000


def word_array(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(WORD), 0)


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def test_terms(items: DataFrame) -> DataFrame:
    """item_row, item_id, q (position from 0), term, n (the item's words)."""
    rows = items.select(F.monotonically_increasing_id().alias("item_row"), F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), word_array(F.col("text")).alias("w"))
    return rows.select("item_row", "item_id", F.size("w").alias("n"), F.posexplode("w").alias("q", "term"))


def build_index(documents: DataFrame, terms: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """The stored postings: row_id, doc_id, term_id (-1: pos is the word count), pos."""
    vocabulary = terms.select("term_id", "term").unionByName(documents.sparkSession.sql(f"select -1L term_id, '\\u0001' term"))
    docs = documents.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", word_array(F.col("text")).alias("w"))
    listed = docs.select("row_id", "doc_id", F.size("w").alias("n"), F.posexplode(F.concat("w", F.array(F.lit(_WORD_COUNT)))).alias("pos", "term"))
    return materialize(listed.join(_small(vocabulary, terms.count()), "term").select("row_id", "doc_id", "term_id", "pos"), "postings")


def _with_term_ids(listed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The test terms by identifier, and the listed positions with it; both stored."""
    terms = materialize(listed.select("term").distinct().select(F.monotonically_increasing_id().alias("term_id"), "term"), "terms")
    return terms, materialize(listed.join(terms, "term"), "test-postings")


def rare_first(index: DataFrame, test: DataFrame) -> DataFrame:
    """test with df: the postings of each term in the corpus."""
    df = index.filter("term_id >= 0").groupBy("term_id").agg(F.count("*").alias("df"))
    return test.join(df, "term_id", "left").withColumn("df", F.coalesce("df", F.lit(0)))


_DEALT = 32


def at_terms(index: DataFrame, anchors: DataFrame) -> DataFrame:
    """The postings of the anchors' terms, with the anchors' columns."""
    anchors = materialize(anchors, "anchors")
    posting = index.filter("term_id >= 0").select("row_id", "term_id", "pos")
    if anchors.count() <= BROADCAST_ROWS:
        return posting.join(F.broadcast(anchors), "term_id")
    dealt = anchors.withColumn("deal", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(_DEALT - 1).cast("long"))))
    return posting.withColumn("deal", F.pmod("row_id", F.lit(_DEALT))).join(dealt, ["term_id", "deal"]).drop("deal")


def phrase_matches(index: DataFrame, test: DataFrame, width: int = 10) -> DataFrame:
    """Exact matches: row_id, item_row, item_id, pos: each document word inside an occurrence of a window of the item."""
    ranked = materialize(rare_first(index, test), "ranked")
    ahead = Window.partitionBy("item_row").orderBy("q").rowsBetween(0, width - 1)
    rarest = F.slice(F.array_sort(F.collect_list(F.struct("df", "q", "term_id")).over(ahead)), 1, 2)  # of width terms
    starts = ranked.withColumn("rarest", rarest).filter((F.col("q") == 0) | (F.col("q") + width <= F.col("n")))

    first = F.get("rarest", F.lit(0))
    second = F.coalesce(F.get("rarest", F.lit(1)), first)
    pairs = starts.filter(first["df"] > 0).select("item_row", first["q"].alias("q0"), first["term_id"].alias("t0"), second["term_id"].alias("t1"), (second["q"] - first["q"]).alias("apart")).distinct()
    pairs = pairs.withColumn("pair", F.xxhash64("t0", "t1", "apart"))  # a pair's items and places follow after its postings have met
    pairs = materialize(pairs, "anchor-pairs")

    one = at_terms(index, pairs.select("pair", F.col("t0").alias("term_id")).distinct()).select("row_id", "pair", "pos")
    two = at_terms(index, pairs.select("pair", "apart", F.col("t1").alias("term_id")).distinct()).select("row_id", "pair", (F.col("pos") - F.col("apart")).alias("pos"))
    met = one.join(two, ["row_id", "pair", "pos"], "left_semi")
    aligned = met.join(_small(pairs.select("pair", "item_row", "q0"), pairs.count()), "pair").select("row_id", "item_row", (F.col("pos") - F.col("q0")).alias("diag")).distinct()
    aligned = materialize(aligned, "alignments")
    wanted = aligned.join(ranked.select("item_row", "item_id", "n", "q", "term_id"), "item_row").withColumn("pos", F.col("diag") + F.col("q"))
    rows = materialize(aligned.select("row_id").distinct(), "candidate-rows")
    held = index.select("row_id", "term_id", "pos").join(_small(rows, rows.count()), "row_id", "left_semi")
    met = wanted.join(held, ["row_id", "pos", "term_id"])
    line = Window.partitionBy("row_id", "item_row", "diag")
    runs = met.withColumn("run", F.col("q") - F.row_number().over(line.orderBy("q")))
    runs = runs.withColumn("length", F.count("*").over(Window.partitionBy("row_id", "item_row", "diag", "run")))
    return runs.filter(F.col("length") >= F.least(F.lit(width), F.col("n"))).select("row_id", "item_row", "item_id", "pos")


def proximity_matches(index: DataFrame, test: DataFrame, slack: int = 5) -> DataFrame:
    """row_id, item_row, item_id, pos: from pos, all distinct terms of the item stand within its length plus ``slack`` words, in any order."""
    terms = rare_first(index, test).groupBy("item_row", "item_id", "term_id").agg(F.first("n").alias("n"), F.first("df").alias("df"))
    whole = terms.groupBy("item_row", "item_id").agg(F.count("*").alias("distinct"), F.min("df").alias("least"), F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("df", "term_id"))).alias("by_df"))
    whole = materialize(whole.filter("least > 0").select("item_row", "item_id", "distinct", (F.col("n") + slack).alias("reach"), F.col("by_df")[0]["term_id"].alias("t0"), F.coalesce(F.get("by_df", F.lit(1)), F.col("by_df")[0])["term_id"].alias("t1")), "near-items")
    cell = F.floor(F.col("pos") / F.col("reach"))
    one = at_terms(index, whole.select("item_row", "reach", F.col("t0").alias("term_id"))).select("row_id", "item_row", F.explode(F.sequence(cell - 1, cell + 1)).alias("cell")).distinct()
    two = at_terms(index, whole.select("item_row", "reach", F.col("t1").alias("term_id"))).select("row_id", "item_row", cell.alias("cell"))
    near = one.join(two, ["row_id", "item_row", "cell"], "left_semi")
    cells = materialize(near.select("row_id", "item_row", F.explode(F.sequence(F.col("cell") - 2, F.col("cell") + 2)).alias("cell")).distinct(), "near-cells")
    rows = materialize(cells.select("row_id").distinct(), "near-rows")
    held = index.filter("term_id >= 0").join(_small(rows, rows.count()), "row_id", "left_semi")
    wanted = terms.join(whole.select("item_row", "distinct", "reach"), "item_row").select("item_row", "item_id", "term_id", "distinct", "reach")
    listed = at_terms(held, wanted).withColumn("cell", cell).join(cells, ["row_id", "item_row", "cell"], "left_semi")
    most = whole.agg(F.max("reach")).first()[0] or 1
    ahead = Window.partitionBy("row_id", "item_row").orderBy("pos").rangeBetween(0, most - 1)  # a position has one posting
    inside = F.array_distinct(F.transform(F.filter(F.col("ahead"), lambda x: x["pos"] < F.col("pos") + F.col("reach")), lambda x: x["term_id"]))
    listed = listed.withColumn("ahead", F.collect_list(F.struct("pos", "term_id")).over(ahead))
    return listed.withColumn("found", F.size(inside)).filter("found = distinct").select("row_id", "item_row", "item_id", "pos")


def contamination(documents: DataFrame, items: DataFrame, width: int = 10, slack: int | None = None) -> DataFrame:
    """One row for each document row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, row_id; with ``slack`` also
    n_near and near_sha256, of the items that are near somewhere in the document."""
    terms, test = _with_term_ids(test_terms(items))
    index = build_index(documents, terms)
    hits = phrase_matches(index, test, width)
    by_item = hits.groupBy("row_id", "item_id").agg(F.collect_set("pos").alias("pos"))
    told = by_item.groupBy("row_id").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("pos")))).cast("long").alias("n_hit"), F.sort_array(F.collect_set("item_id")).alias("items")
    )
    words = index.filter("term_id = -1").select("row_id", "doc_id", F.col("pos").cast("long").alias("n_words"))
    none, more = F.array().cast("array<string>"), []
    if slack is not None:
        near = proximity_matches(index, test, slack).groupBy("row_id").agg(F.sort_array(F.collect_set("item_id")).alias("near"))
        words = words.join(near, "row_id", "left")
        more = [F.when(F.col("near").isNull(), 0).otherwise(F.size("near")).cast("long").alias("n_near"), F.sha2(F.array_join(F.coalesce("near", none), ","), 256).alias("near_sha256")]
    return words.join(told, "row_id", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.when(F.col("items").isNull(), 0).otherwise(F.size("items")).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.coalesce("items", none), ","), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        "row_id",
        *more,
    )


def clean(documents: DataFrame, items: DataFrame, width: int = 10) -> DataFrame:
    """The documents, all columns unchanged, less those that hold a window of an item."""
    key = F.sha2(F.coalesce(documents["text"], F.lit("")), 256)
    bad = materialize(contamination(documents.select(key.alias("doc_id"), "text"), items, width).filter("contaminated").select(F.col("doc_id").alias("contaminated_key")).distinct(), "contaminated")
    return documents.join(_small(bad, bad.count()), key == bad["contaminated_key"], "left_anti")
