"""Small document tables with the awkward rows that every operator must stand."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def awkward(spark, texts=()):
    """documents with nulls, empty and long texts, repeated rows, and columns whose names clash with those the operators make."""
    from pyspark.sql import functions as F

    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)]
    rows += [(9001, None, None, None, None), (9002, "", "en", "s1", 0), (None, "null id text", "en", None, 1), (9003, "same row", "en", "s0", 8), (9003, "same row", "en", "s0", 8)]
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("row_id", "size", "fp", "u", "v", "n", "term", "spans", "x", "target", "pos", "root", "least"):
        df = df.withColumn(c, F.lit("clash"))
    return df


def prose(seed, n=60, words=80, vocabulary=300):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdeé") for _ in range(r.randint(2, 7))) for _ in range(vocabulary)]
    return [" ".join(r.choice(vocab) for _ in range(r.randint(0, words))) for _ in range(n)]
