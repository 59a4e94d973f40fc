"""A corpus pipeline of five training-data operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet and reads again as the next
stage's documents. Every stage works on all rows it is given and its decisions take effect:

1. toxicity: documents that the recurrent network, learned from the labels, rejects (score of 0.3 or more) go;
2. near_duplicates: one document of each group of near-duplicates stays: SimHash candidates whose five-word shingles have a
   Jaccard similarity of 0.8 or more;
3. decontamination: documents that hold ten consecutive words of a benchmark item go;
4. personal_data: personal data becomes its kind, and terms that disclose it are generalised or removed;
5. mixture: documents of each source are taken whole, twice or not at all to meet the source's target.

All but the last return the columns of documents; the last adds size, source_size, target, taken and times, and drops
documents that it does not take. Null texts are empty; an empty table passes through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuewright.llm import decontaminate, mixing, pii, simhash, toxicity
from cuewright.llm.common import materialize, read

#: None: trained models, fingerprints and knapsacks have no SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.score(docs, read(spark, sf_dir, "labels")).filter("predicted = 0").select("doc.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.sanitise(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(docs, kept=docs.columns).filter(F.col("times") > 0)
    return mixed.select("doc.*", "size", "source_size", "target", "taken", "times")


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminated),
    ("personal_data", personal_data),
    ("mixture", mixture),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}", packed=True)
    return STAGES[-1][1](spark, docs, sf_dir)
