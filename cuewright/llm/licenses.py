"""Licence scans: Aho-Corasick over notice phrases and identifier tags, a shunting-yard parser for licence expressions.

One automaton runs over each text's words, lower-cased and joined by single spaces, so that phrases match whatever
punctuation parts their words. Where it meets the words of an identifier tag, the raw line behind the tag is parsed:
identifiers of a list joined by WITH, AND, OR (binding in this order) and parentheses, up to the first token that does not fit.
Each expression is evaluated against the licences that ask for no more than attribution.

Defined results: null or empty texts have no words and no labels; phrases may overlap and all their places count; a tag
with no valid expression behind it gives the label ``spdx-invalid``; repeated rows get a row each; empty tables give empty
results; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import words_of

# The base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
# Further notice phrases and their labels.
NOTICES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "isc license": "isc",
    "bsd license": "bsd",
    "boost software license": "bsl",
    "creative commons attribution": "cc-by",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc0 1 0": "cc0",
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "all rights reserved": "all-rights-reserved",
}
# Words of the identifier tag, and licences that ask for no more than attribution.
TAG = "spdx license identifier"
PERMISSIVE = ("mit", "apache-2.0", "bsd-2-clause", "bsd-3-clause", "isc", "zlib", "bsl-1.0", "unlicense", "cc0-1.0", "cc-by-4.0", "cc-by-3.0")
# Public identifiers of common licences and exceptions, lower-cased; callers may pass their own.
IDENTIFIERS = frozenset("""
0bsd afl-3.0 agpl-1.0 agpl-3.0 agpl-3.0-only agpl-3.0-or-later apache-1.0 apache-1.1 apache-2.0 apsl-2.0 artistic-1.0 artistic-2.0
blueoak-1.0.0 bsd-1-clause bsd-2-clause bsd-2-clause-patent bsd-3-clause bsd-3-clause-clear bsd-4-clause bsl-1.0 busl-1.1
cc-by-1.0 cc-by-2.0 cc-by-2.5 cc-by-3.0 cc-by-4.0 cc-by-nc-3.0 cc-by-nc-4.0 cc-by-nc-nd-4.0 cc-by-nc-sa-3.0 cc-by-nc-sa-4.0
cc-by-nd-3.0 cc-by-nd-4.0 cc-by-sa-3.0 cc-by-sa-4.0 cc0-1.0 cddl-1.0 cddl-1.1 cecill-2.1 cpl-1.0 ecl-2.0 efl-2.0 epl-1.0 epl-2.0
eupl-1.1 eupl-1.2 gfdl-1.2-only gfdl-1.3 gfdl-1.3-only gfdl-1.3-or-later gpl-1.0 gpl-1.0-only gpl-1.0-or-later gpl-2.0 gpl-2.0-only
gpl-2.0-or-later gpl-3.0 gpl-3.0-only gpl-3.0-or-later hpnd icu ijg ipl-1.0 isc lgpl-2.0 lgpl-2.0-only lgpl-2.0-or-later lgpl-2.1
lgpl-2.1-only lgpl-2.1-or-later lgpl-3.0 lgpl-3.0-only lgpl-3.0-or-later libpng lppl-1.3c mit mit-0 mpl-1.0 mpl-1.1 mpl-2.0 ms-pl
ms-rl mulanpsl-2.0 ncsa odbl-1.0 ofl-1.1 openssl osl-3.0 php-3.01 postgresql psf-2.0 python-2.0 qpl-1.0 ruby sleepycat sspl-1.0
unicode-3.0 unicode-dfs-2016 unlicense upl-1.0 vim w3c wtfpl x11 zlib zpl-2.1
""".split())
EXCEPTIONS = frozenset("""
autoconf-exception-2.0 autoconf-exception-3.0 bison-exception-2.2 bootloader-exception classpath-exception-2.0 ecos-exception-2.0
font-exception-2.0 gcc-exception-2.0 gcc-exception-3.1 lgpl-3.0-linking-exception linux-syscall-note llvm-exception
ocaml-lgpl-linking-exception openssl-exception qt-gpl-exception-1.0 u-boot-exception-2.0 universal-foss-exception-1.0 wxwindows-exception-3.1
""".split())
_OWN = re.compile(r"(?:documentref-[a-z0-9.-]+:)?licenseref-[a-z0-9.-]+")
_BINDS = {"or": 1, "and": 2, "with": 3}
_TAGGED = re.compile(r"spdx-license-identifier[ \t]*:[ \t]*([^\r\n]*)", re.I)
_TOKEN = re.compile(r"[ \t]*([()]|[A-Za-z0-9.+:-]+)")


def parse_expression(text: str, known=IDENTIFIERS, exceptions=EXCEPTIONS) -> list[str]:
    """The longest leading licence expression of text in postfix order; [] if there is none.

    Operands are ``known`` identifiers, also with a + behind, or licence references; after WITH, ``exceptions``."""
    out: list[str] = []
    ops: list[str] = []
    best: list[str] = []
    at, operand, depth = 0, True, 0
    while m := _TOKEN.match(text, at):
        token = m[1].lower()
        if token == "(" and operand and not (ops and ops[-1] == "with"):
            ops.append(token)
            depth += 1
        elif token == ")" and not operand and depth:
            while ops[-1] != "(":
                out.append(ops.pop())
            ops.pop()
            depth -= 1
        elif token in _BINDS and not operand and (token != "with" or out[-1] not in _BINDS and out[-1] not in exceptions):
            while ops and ops[-1] != "(" and _BINDS[ops[-1]] >= _BINDS[token]:
                out.append(ops.pop())
            ops.append(token)
            operand = True
        elif operand and (token in exceptions if ops and ops[-1] == "with" else token.removesuffix("+") in known or _OWN.fullmatch(token)):
            out.append(token)
            operand = False
        else:
            break
        if not operand and not depth:
            best = out + ops[::-1]
        at = m.end()
    return best


def evaluate(postfix: list[str], allowed=PERMISSIVE) -> bool:
    """Whether the licences allow use: either side of OR, both of AND; an exception (WITH) leaves its licence as it is."""
    stack: list[bool] = []
    for token in postfix:
        if token in _BINDS:
            b, a = stack.pop(), stack.pop()
            stack.append(a or b if token == "or" else a and b if token == "and" else a)
        else:
            stack.append(token in allowed)
    return bool(stack and stack[-1])


def licences_of(postfix: list[str]) -> list[str]:
    """The licence identifiers of an expression, exceptions left out."""
    stack: list[list[str]] = []
    for token in postfix:
        if token in _BINDS:
            b, a = stack.pop(), stack.pop()
            stack.append(a if token == "with" else a + b)
        else:
            stack.append([token])
    return stack[-1] if stack else []


def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for phrase in [*BASE, *NOTICES, TAG]:
        a.add_word(f" {phrase} ", phrase)
    a.make_automaton()
    return a


def scan_text(text: str | None, found_by) -> dict:
    """n_words, places [(phrase, first word)], expressions (postfix lists) of one text."""
    words = words_of(text)
    joined = b" ".join([b"", *words, b""]).decode("latin-1")  # a character for each byte
    places, at, n = [], 0, 0
    hits = sorted((end - len(phrase) - 1, phrase) for end, phrase in found_by.iter(joined)) if words else []
    for start, phrase in hits:
        n += joined.count(" ", at, start)
        at = start
        places.append((phrase, n))
    tagged = any(phrase == TAG for phrase, _ in places)
    return {"n_words": len(words), "places": places, "expressions": [parse_expression(m[1]) for m in _TAGGED.finditer(text)] if tagged else []}


def scan(documents: DataFrame) -> DataFrame:
    """doc_id, n_words, matches (label, phrase, word, base), expressions (postfix, permissive), n_base, first_word, last_word, base_labels, labels, score,
    expression_postfix (valid expressions, joined by a semicolon), permissive (whether all of them allow use; null without any).

    score: 1 with a valid expression, 0.9 with a base phrase, 0.7 with another notice, 0.3 with a broken tag, else 0."""
    doc_id = T.StructField("doc_id", documents.schema["doc_id"].dataType)
    match = T.StructType.fromDDL("label string, phrase string, word long, base boolean")
    schema = T.StructType([doc_id, *T.StructType.fromDDL("n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expression_postfix string, permissive boolean")])
    schema = schema.add("matches", T.ArrayType(match)).add("expressions", T.ArrayType(T.StructType.fromDDL("postfix string, permissive boolean")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton()
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                rows = []
                for text in part.column("text").to_pylist():
                    x = scan_text(text, a)
                    base = [(p, w) for p, w in x["places"] if p in BASE]
                    notices = [(p, w) for p, w in x["places"] if p in NOTICES]
                    valid = [e for e in x["expressions"] if e]
                    tagged = any(p == TAG for p, _ in x["places"])
                    own = {NOTICES[p] for p, _ in notices} | {y for e in valid for y in licences_of(e)} | ({"spdx-invalid"} if tagged and len(valid) < max(1, len(x["expressions"])) else set())
                    at = [w for _, w in base]
                    labels = {BASE[p] for p, _ in base}
                    score = 1.0 if valid else 0.9 if base else 0.7 if notices else 0.3 if tagged else 0.0
                    matches = [{"label": (BASE | NOTICES).get(p, "spdx"), "phrase": p, "word": w, "base": p in BASE} for p, w in x["places"]]
                    rows.append({"n_words": x["n_words"], "n_base": len(base), "first_word": min(at, default=None), "last_word": max(at, default=None), "base_labels": ",".join(sorted(labels)), "labels": ",".join(sorted(labels | own)), "score": score, "expression_postfix": ";".join(" ".join(e) for e in valid), "permissive": all(map(evaluate, valid)) if valid else None, "matches": matches, "expressions": [{"postfix": " ".join(e), "permissive": evaluate(e)} for e in valid]})
                out = pa.array(rows, target)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *out.flatten()], names=["doc_id", *[f.name for f in target]])

    target = pa.struct(
        [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("expression_postfix", pa.string()), ("permissive", pa.bool_())]
        + [("matches", pa.list_(pa.struct([("label", pa.string()), ("phrase", pa.string()), ("word", pa.int64()), ("base", pa.bool_())]))), ("expressions", pa.list_(pa.struct([("postfix", pa.string()), ("permissive", pa.bool_())])))]
    )
    return documents.select("doc_id", "text").mapInArrow(run, schema)
