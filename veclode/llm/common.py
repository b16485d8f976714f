"""What the training-data operators share: row keys, checkpoints, Arrow helpers."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every contract: space and U+0009 to U+000D.
WS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """A-Z only, unlike lower()."""
    return F.translate(c, UPPER, LOWER)


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text (null: empty) alone, so that no other column's name can clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def with_key(df: DataFrame) -> DataFrame:
    """Adds k1, k2: 128 bits that name a row by doc_id and text. They are never null, and rows that repeat
    both share them, so a table with one row a key joins back without multiplying rows."""
    return df.withColumns({"k1": F.xxhash64("doc_id", "text"), "k2": F.xxhash64(F.lit(1), "text", "doc_id")})


def spare(docs: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of docs has, whatever its case."""
    own = {c.lower() for c in docs.columns}
    return [next(x for x in (f"_{name}{'_' * i}" for i in range(len(own) + 1)) if x.lower() not in own) for name in names]


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder: the cluster's spark.checkpoint.dir. Where that is unset, a temporary folder serves a local
    master, on which every task sees it; any other master is refused."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {sc.master} share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="veclode-"))
    return sc.getCheckpointDir()


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder in whatever store it lies."""
    path_ = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    path_.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path_, True)


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared checkpoint folder: later steps read it from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def labelled(labels: DataFrame, column: str) -> DataFrame:
    """doc_id and y in {0, 1}: one row a document. A null label or id is no label; of several, the largest holds."""
    y = F.col(column).cast("int")
    return (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), y.alias("y"))
        .where("doc_id is not null and y in (0, 1)")
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
    )


def learn_sample(labels: DataFrame, column: str, modulus: int, held: int, bound: int) -> DataFrame:
    """At most `bound` rows (doc_id, y) outside the held-out fold, in the order of a hash of doc_id."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus
    return labelled(labels, column).where(fold != held).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)


def held_out(modulus: int, held: int) -> Column:
    """Whether a document lies in the held-out fold; a null id is in none."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == held, F.lit(False))


def batches(arrow: Iterator[pa.RecordBatch], mb: float = 4) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about `mb` MB, so that what a function makes of a slice stays bounded."""
    for b in arrow:
        step = max(1, int(b.num_rows * mb * 1e6 / max(1, b.nbytes)))
        for i in range(0, b.num_rows, step):
            yield b.slice(i, step)


def list_array(flat: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))
