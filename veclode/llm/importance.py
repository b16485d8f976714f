"""Resampling towards a target distribution by importance weights of hashed n-grams.

A text's features are its runs of one to three words, hashed into BUCKETS by CRC-32. Counts of the buckets over all raw and
all target texts give each bucket a gain (the log ratio of its smoothed frequencies), an array of fixed size; a text's
weight is the sum of its features' gains. A Gumbel number hashed from doc_id is added, so that the highest scores are a
sample without replacement. The score of the last drawn row is found by radix selection: a job counts the values of one
16-bit digit of the composite key (score, doc_id, row) among the rows that share the digits before it, at most 65,536
numbers, and moves to the digit in which the row lies, until the bin is wanted whole. Only rows up to that key are
range-sorted and ranked; the others are never sorted, and no window or task sees all rows.

CRCs of runs are put together from those of words: checksums are linear, so a word behind another shifts the first one's
register by its bytes, which is a table look-up.

Defined cases: a null text has no features; a null doc_id draws the number of an empty one and comes last among ties;
rows that repeat a doc_id are rows of their own, and among equal keys an arbitrary but fixed one comes first; an empty
table gives an empty result, and without target texts every bucket counts once; texts of any length are read whole, in
batches; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import numbered
from .common import batches, cut

BUCKETS, LONGEST = 10_000, 3
#: A register's shift by up to so many bytes is looked up at once; bits of a digit.
_NEAR, _DIGIT = 64, 16
_LAST = (1 << 63) - 1


def _tables() -> np.ndarray:
    """[n, i, b]: what byte i with value b of a CRC register becomes n zero bytes later."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, step >> 1 ^ np.uint32(0xEDB88320), step >> 1)
    out = np.empty((_NEAR + 1, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32)[None] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(_NEAR):
        out[n + 1] = out[n] >> 8 ^ step[out[n] & 255]
    return out


_SHIFT = _tables()


def shifted(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """CRCs of texts as they count in a longer text that goes on for n bytes."""
    crc, n = crc.copy(), n.copy()
    far = np.flatnonzero(n > _NEAR)
    while len(far):
        crc[far] = _moved(crc[far], np.full(len(far), _NEAR))
        n[far] -= _NEAR
        far = far[n[far] > _NEAR]
    return _moved(crc, n)


def _moved(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    return _SHIFT[n, 0, crc & 255] ^ _SHIFT[n, 1, crc >> 8 & 255] ^ _SHIFT[n, 2, crc >> 16 & 255] ^ _SHIFT[n, 3, crc >> 24]


def features(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Of texts: how many words each has and, for runs of 1, 2, ... words, the texts and the buckets of their features."""
    raw = column.cast(pa.large_binary())
    ends = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends[1:] - ends[0]
    upper = (data >= 65) & (data <= 90)
    word = upper | (data >= 48) & (data <= 57) | (data >= 97) & (data <= 122) | (data >= 128)
    first = word.copy()
    first[1:] &= ~word[:-1]
    begins = np.append(0, ends)[:-1]
    begins = begins[begins < len(data)]
    first[begins] = word[begins]
    at = np.flatnonzero(first)
    count = np.append(0, np.cumsum(word))
    body = data + (upper * np.uint8(32))
    units = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(np.append(count[at], count[-1]).astype(np.int64)), pa.py_buffer(body[word])]).dictionary_encode()
    names, of = units.dictionary.to_pylist(), units.indices.to_numpy()
    alone = np.fromiter(map(zlib.crc32, names), np.uint32, len(names))
    size = np.fromiter(map(len, names), np.int64, len(names))
    behind = (shifted(np.full(len(names), zlib.crc32(b" "), np.uint32), size) ^ alone)[of]  # of a space and the word
    size, words = size[of] + 1, np.diff(at.searchsorted(ends), prepend=0)
    text = np.repeat(np.arange(len(words)), words)
    crc, whose, buckets = alone[of], [text], [(alone % BUCKETS)[of].astype(np.int64)]
    for n in range(1, LONGEST):
        crc = shifted(crc[:-1], size[n:]) ^ behind[n:] if len(crc) else crc
        own = text[: len(crc)] == text[n:]
        whose.append(text[: len(crc)][own])
        buckets.append((crc[own] % np.uint32(BUCKETS)).astype(np.int64))
    return words, whose, buckets


def counts(docs: DataFrame) -> np.ndarray:
    """How many features of all texts (text) fall into each bucket."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for b in batches(it, 2):
            for own in features(b.column("text"))[2]:
                total += np.bincount(own, minlength=BUCKETS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    out = np.zeros(BUCKETS, np.int64)
    found = docs.select(F.coalesce(F.col("text"), F.lit("")).alias("text")).mapInArrow(run, "bucket long, n long")
    for r in found.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # BUCKETS rows at most
        out[r["bucket"]] = r["n"]
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the ratio of a bucket's frequency among target features to that among raw ones, both with one more
    feature in each bucket."""
    s, t, out = int(raw.sum()), int(target.sum()), np.zeros(len(raw), np.int64)
    for b, (x, y) in enumerate(zip(raw.tolist(), target.tolist(), strict=True)):
        out[b] = math.floor(1000 * math.log((y + 1.0) * (s + len(raw)) / ((x + 1.0) * (t + len(raw)))))
    return out


def gumbel(doc_id: int | None, seed: int) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, seed: int = 42) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of every document (doc_id, text)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, 2):
            words, whose, buckets = features(b.column("text"))
            weight = np.zeros(len(words), np.int64)
            for text, own in zip(whose, buckets, strict=True):
                sums = np.append(0, np.cumsum(gain[own]))
                ends = text.searchsorted(np.arange(len(words) + 1))
                weight += sums[ends[1:]] - sums[ends[:-1]]
            n = sum(np.maximum(words - k, 0) for k in range(LONGEST))
            score = weight + np.fromiter((gumbel(i, seed) for i in b.column("doc_id").to_pylist()), np.int64, len(words))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *map(pa.array, (words, n, weight, score))], names=["doc_id", "n_words", "n_features", "weight", "score"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return own.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long, score long")


def kth_key(rows: DataFrame, parts: list[str], k: int) -> list[int] | None:
    """The parts (columns of long without nulls) of the k-th smallest row's key, or a later key with no row between; None
    where k is 0. rows are read once for the range and once for each digit of a part."""
    if k < 1:
        return None
    key: list[int] = []
    same, whole = F.lit(True), (1 << 64) - 1
    for part in parts:
        low, high = rows.where(same).agg(F.min(part), F.max(part)).first()
        bits = (low ^ high).bit_length() if (low ^ high) >= 0 else 64
        value = (low + (1 << 63)) >> bits << bits  # biased: digits of the part as an unsigned number
        biased = F.col(part).bitwiseXOR(F.lit(-1 << 63))
        while bits:
            step = min(_DIGIT, bits)
            bits -= step
            digit = F.shiftrightunsigned(biased, bits).bitwiseAND(F.lit((1 << step) - 1))
            within = same & F.col(part).between(value - (1 << 63), value + (1 << bits + step) - 1 - (1 << 63))
            for d, n in sorted((r["d"], r["n"]) for r in rows.where(within).groupBy(digit.alias("d")).agg(F.count("*").alias("n")).collect()):  # 65,536 at most
                if k <= n:
                    break
                k -= n
            value |= d << bits
            if k == n:  # the bin is wanted whole
                return [*key, (value | (1 << bits) - 1) - (1 << 63), *[_LAST] * (len(parts) - len(key) - 1)]
        key.append(value - (1 << 63))
        same = same & (F.col(part) == key[-1])
        assert value <= whole
    return key


def upto(parts: list[str], key: list[int]) -> Column:
    """Whether a row's key is at most this one."""
    out = F.lit(True)
    for part, x in reversed(list(zip(parts, key, strict=True))):
        out = (F.col(part) < x) | (F.col(part) == x) & out
    return out


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least: int = 20, seed: int = 42) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document; rank (from 1) of those that are drawn: percent of the
    documents with at least `least` words, by score."""
    rows = scored(docs, gains(counts(docs), counts(target)), seed).withColumn("_row", F.monotonically_increasing_id())
    rows = cut(rows.withColumns({"_s": -F.col("score"), "_d": F.coalesce("doc_id", F.lit(_LAST))}))
    parts, able = ["_s", "_d", "_row"], F.col("n_words") >= least
    key = kth_key(rows.where(able), parts, rows.where(able).count() * percent // 100)
    columns = ["doc_id", "n_features", "weight", "score"]
    if key is None:
        return rows.select(*columns, F.lit(None).cast("long").alias("rank"))
    drawn = able & upto(parts, key)
    ranked = numbered(rows.where(drawn).select(*columns, *parts), parts, "_n").withColumn("rank", (F.col("_n") + 1).cast("long"))
    return ranked.select(*columns, "rank").unionByName(rows.where(~drawn).select(*columns, F.lit(None).cast("long").alias("rank")))
