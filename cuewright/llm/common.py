"""Helpers that the training-data operators share."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of the contracts, as Java regular expressions.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
TOKEN = r"[^\x20\x09-\x0D]+"
#: bytes.translate table: A-Z lower-cased, every byte that WORD excludes made a space.
WORD_TABLE = bytes(
    b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """The WORD matches of a text, lower-cased, as UTF-8."""
    return (text or "").encode("utf-8", "replace").translate(WORD_TABLE).split()


def tokens_of(text: str | None) -> list[bytes]:
    """The TOKEN matches of a text with A-Z lower-cased; bytes.split() and bytes.lower() are ASCII only, as wanted."""
    return (text or "").encode("utf-8", "replace").lower().split()


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where the cluster names none."""
    return spark.conf.get("spark.checkpoint.dir", None) or "/tmp/checkpoints"


def materialize(df: DataFrame, name: str, packed: bool = False) -> DataFrame:
    """Writes df to the shared folder and reads it back, which cuts the lineage and survives lost executors.

    packed: compressed harder, which pays for whole texts."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cuewright/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd" if packed else "snappy").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cuewright_path = path
    return out


def release(*frames: DataFrame) -> None:
    """Deletes the files of materialized frames that nothing will read again."""
    for df in frames:
        spark, path = df.sparkSession, df._cuewright_path
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: A key of more rows than SPLIT is joined by broadcast: there are at most rows / SPLIT of them, and their size is summed first.
SPLIT, BROADCAST_BYTES = 20_000, 64 << 20


def meet(rows: DataFrame, counted: DataFrame, on: list[str], size: Column | int = 64) -> DataFrame:
    """rows joined with counted (unique in ``on``; n: how many rows have the key), less n; hot keys are no keys of the shuffle.

    size: about how many bytes a row of counted has."""
    hot = counted.filter(F.col("n") > SPLIT).drop("n")
    total = hot.agg(F.sum(F.lit(size) if isinstance(size, int) else size)).first()[0]
    if not total or total > BROADCAST_BYTES:
        return rows.join(counted.drop("n"), on)
    cold = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(counted.filter(F.col("n") <= SPLIT).drop("n"), on)
    return cold.unionByName(rows.join(F.broadcast(hot), on))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the identifier written as text, modulo n; null identifiers count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def to_batches(columns: dict[str, list], schema: pa.Schema):
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)
