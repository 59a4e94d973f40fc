"""Personal data: base patterns, and terms around them that give protected entities away.

The base finds e-mail addresses, IP addresses, card and phone numbers. For the words within ``reach`` words of such an
entity, the corpus tells how strongly each reveals it: with P(k) the share of all words that stand near an entity of kind
k, and P(k|t) that share among the occurrences of term t, the disclosure is PMI(t, k) / IC(k) =
(log P(k|t) - log P(k)) / -log P(k), 1 where the term never stands elsewhere. The same is told of each single entity, with the
words that stand near it in place of those near its kind, so that a name beside one repeated address counts. Terms that stood
near at least ``support`` times and disclose ``generalise`` or more are replaced by their kind, wherever they stand in a document
that holds an entity of the kind, or that entity; from ``remove`` on they go. All counts are over all documents.

Defined results: null or empty texts have no spans; each kind's spans are leftmost and do not overlap, spans of different
kinds may; repeated rows are judged one by one and each occurrence counts for support; empty tables give empty
results; other columns pass through ``sanitise`` and are ignored elsewhere.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, words_of

KINDS = ("email", "ip", "card", "phone")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match ends with its last run of digits, so none can start within a run: the look-behind only saves time.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost addresses, sought from each @ backwards, which stays linear on long runs of letters."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text[start - 1]):
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        done = m.end() if m else at + 1
        if m:
            out.append((start, done))
        at = text.find("@", done)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start; code points, end exclusive."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if first := _DIGIT.search(text):
        at = max(0, first.start() - 1)  # a + may stand before
        out += [("ip", m.start(), m.end()) for m in _IP.finditer(text, first.start()) if all(len(d := x.lstrip("0")) <= 3 and int(d or "0") <= 255 for x in m[0].split("."))]
        cards = ((m, re.sub("[ -]", "", m[0])) for m in _CARD.finditer(text, first.start()))
        out += [("card", m.start(), m.end()) for m, d in cards if 13 <= len(d) <= 19 and _luhn(d)]
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text, at) if 9 <= len(_DIGIT.findall(m[0])) <= 15]
    return out


def neighbours(text: str, spans: list[tuple[str, int, int]], reach: int) -> list[dict]:
    """The ``reach`` words before and after each entity, however far, less those that are part of an entity."""
    words = [(m.start(), m.end(), m[0]) for m in _WORD.finditer(_lower(text))]
    starts, ends, out = [a for a, _, _ in words], [b for _, b, _ in words], []
    inside = np.zeros(len(text) + 1, bool)
    for _, start, end in spans:
        inside[start:end] = True
    for kind, start, end in spans:
        entity = _entity(text[start:end])
        before, after = bisect_right(ends, start), bisect_left(starts, end)
        for a, b, word in words[max(0, before - reach) : before] + words[after : after + reach]:
            if not inside[a:b].any():
                out.append({"term": word.encode("utf-8", "replace").decode("utf-8", "replace"), "kind": kind, "entity": entity, "start": a, "end": b})
    return out


def _entity(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


def _lower(text: str) -> str:
    return text.lower() if text.isascii() else re.sub("[A-Z]", lambda m: m[0].lower(), text)


def find_base(documents: DataFrame, reach: int = 4, kept: list[str] | None = None) -> DataFrame:
    """row_id, doc (the kept columns of the document; all by default), spans (kind, start, end), near (the words around them)
    and held (the text where there are spans); stored."""
    spans = T.ArrayType(T.StructType.fromDDL("kind string, start int, end int"))
    docs = documents.select(F.monotonically_increasing_id().alias("row_id"), F.struct(*[F.col(f"`{c}`") for c in kept or documents.columns]).alias("doc"), "text")
    schema = T.StructType(docs.schema[:2].fields).add("spans", spans).add("near", T.ArrayType(T.StructType.fromDDL("term string, kind string, entity long, start int, end int"))).add("held", T.StringType())
    span_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    near_type = pa.list_(pa.struct([("term", pa.string()), ("kind", pa.string()), ("entity", pa.int64()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                found, near, held = [], [], []
                for text in part.column("text").to_pylist():
                    x = base_spans(text or "")
                    found.append([{"kind": k, "start": s, "end": e} for k, s, e in x])
                    near.append(neighbours(text, x, reach) if x else [])
                    held.append(text if x else None)
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(found, span_type), pa.array(near, near_type), pa.array(held, pa.string())], names=["row_id", "doc", "spans", "near", "held"])

    return materialize(docs.mapInArrow(run, schema), "personal", packed=True)


def word_counts(documents: DataFrame, most: int = 200_000) -> DataFrame:
    """term, n over all documents, pre-aggregated in runs of up to ``most`` terms; the term '' has the number of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for b in batches:
            for text in b.column(0).to_pylist():
                words = words_of(text)
                counts.update(words)
                counts[b""] += len(words)
                if len(counts) > most:
                    yield told(counts)
                    counts = Counter()
        if counts:
            yield told(counts)

    def told(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([w.decode("utf-8", "replace") for w in counts]), pa.array(list(counts.values()), pa.int64())], names=["term", "n"])

    return documents.select("text").mapInArrow(run, "term string, n long")


def disclosures(found: DataFrame, documents: DataFrame, support: int = 3) -> DataFrame:
    """term, kind, entity (null: any of the kind), disclosure of every term that stood near at least ``support`` times."""
    near = found.select(F.explode("near").alias("x")).select("x.*")
    by_entity = materialize(near.groupBy("term", "kind", "entity").agg(F.count("*").alias("near")), "near-entities")
    by_kind = by_entity.groupBy("term", "kind").agg(F.sum("near").alias("near")).filter(F.col("near") >= support)
    kinds = by_entity.groupBy("kind").agg(F.sum("near").alias("all_near"))
    known = by_kind.join(F.broadcast(kinds), "kind").withColumn("entity", F.lit(None).cast("long"))  # one row for each of four kinds
    entities = by_entity.groupBy("kind", "entity").agg(F.sum("near").alias("all_near"))
    known = known.unionByName(by_entity.filter(F.col("near") >= support).join(entities, ["kind", "entity"]))
    known = materialize(known.select("term", "kind", "entity", "near", "all_near"), "near-terms")
    wanted = known.select("term").union(documents.sparkSession.createDataFrame([("",)], "term string")).distinct()
    counts = materialize(word_counts(documents).join(wanted, "term", "left_semi").groupBy("term").agg(F.sum("n").alias("n")), "term-counts")
    total = (counts.filter("term = ''").first() or (None, 0))[1]
    prior = F.least(F.col("all_near") / F.lit(float(max(1, total))), F.lit(0.5))
    p = F.least(F.col("near") / F.col("n"), F.lit(1.0))
    scored = known.join(counts.filter("term != ''"), "term")
    return scored.select("term", "kind", "entity", ((F.log(p) - F.log(prior)) / -F.log(prior)).alias("disclosure"))


#: Up to so many disclosing terms (some 50 bytes each) are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 500_000


def _held_words(found: DataFrame) -> DataFrame:
    """row_id, term, places (start, end), kinds, entities: the distinct words of rows with spans, outside of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for b in batches:
            for row, spans, text in zip(*(b.column(c).to_pylist() for c in ("row_id", "spans", "held")), strict=True):
                inside = np.zeros(len(text) + 1, bool)
                for x in spans:
                    inside[x["start"] : x["end"]] = True
                words: dict[str, list] = {}
                for m in _WORD.finditer(_lower(text)):
                    if not inside[m.start() : m.end()].any():
                        words.setdefault(m[0].encode("utf-8", "replace").decode("utf-8", "replace"), []).append({"start": m.start(), "end": m.end()})
                kinds, entities = sorted({x["kind"] for x in spans}), sorted({_entity(text[x["start"] : x["end"]]) for x in spans})
                n = len(words)
                yield pa.RecordBatch.from_arrays([pa.array([row] * n, pa.int64()), pa.array(list(words), pa.string()), pa.array(list(words.values()), place), pa.array([kinds] * n, pa.list_(pa.string())), pa.array([entities] * n, pa.list_(pa.int64()))], names=["row_id", "term", "places", "kinds", "entities"])

    return found.filter("held is not null").select("row_id", "spans", "held").mapInArrow(run, "row_id long, term string, places array<struct<start: int, end: int>>, kinds array<string>, entities array<long>")


def find(documents: DataFrame, reach: int = 4, support: int = 3, generalise: float = 0.9, remove: float = 0.98, kept: list[str] | None = None) -> DataFrame:
    """find_base with ``terms``: array of (kind, start, end, action) for the words that disclose an entity of their document."""
    found = find_base(documents, reach, kept)
    strong = disclosures(found, documents, support).filter(F.col("disclosure") >= generalise)
    strong = materialize(strong.withColumn("action", F.when(F.col("disclosure") >= remove, "remove").otherwise("generalise")).drop("disclosure"), "disclosing")
    small = F.broadcast(strong) if strong.count() <= BROADCAST_ROWS else strong
    hit = _held_words(found).join(small, "term").filter(F.array_contains("kinds", F.col("kind")) & (F.col("entity").isNull() | F.array_contains("entities", F.col("entity"))))
    hit = hit.groupBy("row_id", "term").agg(F.first("places").alias("places"), F.min(F.struct(F.col("action") != "remove", "kind", "action")).alias("x"))  # removal goes before a kind
    hit = hit.select("row_id", "x", F.explode("places").alias("at"))
    hit = hit.groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct("at.start", "at.end", F.col("x.kind").alias("kind"), F.col("x.action").alias("action")))).alias("terms"))
    return found.drop("near", "held").join(hit, "row_id", "left")


def digest(documents: DataFrame) -> DataFrame:
    """The contract's columns."""
    found = find(documents, kept=["doc_id"])
    told = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = told(F.col("spans"))
    terms = F.coalesce(F.array_join(F.transform("terms", lambda x: F.concat_ws(":", F.lit("term"), x["start"].cast("string"), x["end"].cast("string"))), ","), F.lit(""))
    kinds = F.transform("spans", lambda x: x["kind"])
    count = [(F.size(kinds) - F.size(F.array_remove(kinds, F.lit(k)))).cast("long").alias(f"n_{k}") for k in KINDS]
    parts = F.filter(F.array(base, terms), lambda x: x != "")
    return found.select("doc.doc_id", *count, F.sha2(base, 256).alias("base_sha256"), F.array_join(parts, ",").alias("spans"))


def _clean(text: str | None, spans: list[dict], terms: list[dict] | None) -> str | None:
    cuts = [(s["start"], s["end"], f"<{s['kind'].upper()}>") for s in spans] + [(t["start"], t["end"], "" if t["action"] == "remove" else f"<{t['kind']}-term>") for t in terms or []]
    out, at = [], 0
    for start, end, by in sorted(cuts, key=lambda c: (c[0], -c[1])):
        if start >= at:
            out += [text[at:start], by]
        at = max(at, end)
    return "".join(out) + text[at:] if cuts else text


def sanitise(documents: DataFrame, **limits) -> DataFrame:
    """The documents, their columns unchanged but for text: entities become <KIND>, disclosing terms their kind or nothing."""
    found = find(documents, **limits).select("doc", "spans", "terms")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc = b.column("doc")
            cells = zip(doc.field("text").to_pylist(), b.column("spans").to_pylist(), b.column("terms").to_pylist(), strict=True)
            text = pa.array([_clean(*x) for x in cells], pa.string())
            names = [f.name for f in doc.type]
            yield pa.RecordBatch.from_arrays([text if c == "text" else doc.field(i) for i, c in enumerate(names)], names=names)

    return found.mapInArrow(run, documents.schema)
