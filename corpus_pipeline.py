"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again by the next.

Texts that quality ranking rejects go; lines found in ten documents or more go (a document that loses all its
lines stays, empty); of each near-duplicate group the smallest doc_id stays; sources are mixed to their target
weights, so a document may come twice, be cut at the budget's last word, or go; and each document is encoded
into sampled segmentations.

Defined cases: all stages but the last keep the columns of documents, whatever their names, and read doc_id and text alone
(mixing source too). A null or empty text is an empty one: quality ranking scores it like any other, line dedup leaves it,
near dedup links it to nothing, so that it stays, and mixing, which serves words, leaves it out. A null doc_id is kept; near
dedup prefers a row that has one. Of rows that repeat doc_id and text near dedup keeps one; of a group, ties aside, the
smallest doc_id. Each served row is encoded by itself. An empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veclode.llm import line_dedup, mixing, pieces, quality, simhash
from veclode.llm.common import remove, shared_dir, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.good(docs, table(spark, sf_dir, "labels"))


def _lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.without_frequent_lines(docs)


def _near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.near_dedup(docs)


def _mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def _pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode_samples(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality ranking", _quality),
    ("line dedup", _lines),
    ("near dedup", _near),
    ("source mixing", _mix),
    ("piece encoding", _pieces),
]

#: The stages train, hash and sample in ways that SQL cannot express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What the stages write lies in the shared checkpoint folder, each until the next is
    written; the last one's stays for the reader of the result."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for n, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{n}")
        docs = spark.read.parquet(f"{folder}/{n}")
        if n:
            remove(spark, f"{folder}/{n - 1}")
    return docs
