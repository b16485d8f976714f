"""Substring dedup with difference-cover anchors.

Windows of L words that occur twice are found without hashing every position. D is a difference cover modulo a
period V: for any two positions i, j some shift below V takes both into D. So of two equal windows the same
L - V + 1 words at that shift start at a cover position in both, and only these anchors, |D| / V of the
positions, are hashed and shuffled. Anchors that occur once end there. From the others a match extends to the
windows around them: these windows alone get a 96-bit hash and are shuffled in turn, and a window whose hash
occurs twice is a repeat.

Hashes travel packed, an array a task and bucket rather than a row each. Before that, every input partition
sends only the first of its equal hashes to the hash's bucket, marked as repeated, and the rest, whose answer
is then known, to any bucket: a passage that a third of all documents share is one row a partition. The
number of buckets follows the size of the corpus, so a bucket's arrays keep their size. What comes back is packed by
home (a few documents) with an index by document, so that a document takes its own positions before it reaches Python.

Rows that repeat a doc_id and a text are hashed once, whatever their number: all their windows occur elsewhere, so nothing
needs to come back to them.

Defined cases: null or empty texts have no words; fewer words than a window hold none; rows that repeat a
doc_id and a text repeat each other's windows; a null doc_id is a document; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches, cut, list_array, texts, with_key

#: A perfect difference set: every residue modulo PERIOD is a difference of two members (fixed values).
PERIOD, COVER = 21, (3, 6, 7, 12, 14)
#: Characters a bucket of hashes stands for, and hashes a task gathers before it packs them.
BUCKET_CHARS, FLUSH = 24_000_000, 500_000
#: Documents of a home.
HOME = 16
_B1, _B2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)  # odd: they have inverses modulo 2^64
_PACK = "bucket int, h binary, g binary, doc binary, pos binary, flag binary, keys binary"


def word_hashes(words: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(w) for w in words), np.uint64, len(words))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, base, np.uint64))])


def windows(x: np.ndarray, size: int, base: np.uint64, at: np.ndarray) -> np.ndarray:
    """A polynomial hash modulo 2^64 of the words at..at+size, mixed."""
    inverse = np.uint64(pow(int(base), -1, 1 << 64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * _powers(inverse, len(x))[: len(x)])])
    h = (sums[at + size] - sums[at]) * _powers(base, len(x))[at]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


class _Packer:
    """Gathers (hash, second hash, document, position) and packs them by bucket."""

    def __init__(self, buckets: int) -> None:
        self.buckets = buckets
        self.clear()

    def clear(self) -> None:
        self.rows, self.keys, self.n = [], [], 0

    def add(self, key: tuple[int, int], h: np.ndarray, g: np.ndarray, pos: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.rows.append((h, g, np.full(len(h), len(self.keys), np.uint32), pos.astype(np.uint32)))
        self.keys.append(key)
        self.n += len(h)
        if self.n > FLUSH:
            yield from self.packed()

    def packed(self) -> Iterator[pa.RecordBatch]:
        if not self.n:
            return
        h, g, doc, pos = (np.concatenate(c) for c in zip(*self.rows, strict=True))
        order = np.lexsort((g, h))
        new = np.ones(len(order), bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (g[order][1:] != g[order][:-1])
        size = np.diff(np.append(np.flatnonzero(new), len(order)))
        flag = np.full(len(order), 2, np.uint8)  # 0: alone here, 1: first of several, 2: known to repeat
        flag[order[new]] = size > 1
        bucket = np.where(flag == 2, doc, h % np.uint64(self.buckets)) % np.uint64(self.buckets)
        keys = np.array(self.keys, np.int64)
        for b in np.unique(bucket):
            own = np.flatnonzero(bucket == b)
            used, local = np.unique(doc[own], return_inverse=True)
            cols = (h[own], g[own], local.astype(np.uint32), pos[own], flag[own], keys[used])
            yield pa.RecordBatch.from_arrays([pa.array([int(b)], pa.int32()), *(pa.array([c.tobytes()], pa.binary()) for c in cols)], names=[f.split()[0] for f in _PACK.split(", ")])
        self.clear()


def _anchors(size: int, buckets: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, short = _Packer(buckets), size - PERIOD + 1
        for b in it:
            for k1, k2, text in zip(b.column("k1").to_pylist(), b.column("k2").to_pylist(), b.column("text"), strict=True):
                words = text.as_py().encode().split()
                if len(words) < size:
                    continue
                at = np.arange(len(words) - short + 1)
                at = at[np.isin(at % PERIOD, COVER)]
                h = windows(word_hashes(words), short, _B1, at)
                yield from pack.add((k1, k2), h, np.zeros(len(h), np.uint32), at)
        yield from pack.packed()

    return run


def _extended(size: int, buckets: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = _Packer(buckets)
        for b in it:
            for k1, k2, text, found in zip(b.column("k1").to_pylist(), b.column("k2").to_pylist(), b.column("text"), b.column("found"), strict=True):
                p = _positions(found)
                if not len(p):
                    continue
                words = text.as_py().encode().split()
                edge = np.zeros(len(words) + 2, np.int32)
                np.add.at(edge, np.maximum(p - PERIOD + 1, 0), 1)
                np.add.at(edge, p + 1, -1)
                at = np.flatnonzero(np.cumsum(edge)[: len(words) - size + 1] > 0)
                x = word_hashes(words)
                yield from pack.add((k1, k2), windows(x, size, _B1, at), (windows(x ^ (x >> np.uint64(17)), size, _B2, at) >> np.uint64(32)).astype(np.uint32), at)
        yield from pack.packed()

    return run


def _positions(found: pa.Scalar) -> np.ndarray:
    return np.frombuffer(b"".join(found.as_py() or []), "<u4").astype(np.int64)


_FOUND = "struct<ks: array<bigint>, at: array<int>, pos: binary>"


def _own() -> Column:
    """Of the packed positions of a home those of the row's document: array<binary>."""

    def part(f: Column) -> Column:
        i = F.array_position(f["ks"], F.col("k1")).cast("int")
        start = F.get(f["at"], i - 1)
        return F.when(i > 0, F.substring(f["pos"], start + 1, F.get(f["at"], i) - start))

    return F.filter(F.transform("found", part), lambda x: x.isNotNull())


def _repeats(homes: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k1, pos = _twice(it)
        home = k1 % homes
        order = np.lexsort((k1, home))
        k1, home, pos = k1[order], home[order], pos[order].astype("<u4")
        doc = np.flatnonzero(np.diff(k1, prepend=k1[:1] - 1) != 0)  # where the records of a document begin
        own, first = np.unique(home, return_index=True)
        ends, of = np.append(first, len(pos)), np.searchsorted(doc, np.append(first, len(pos)))
        for i in range(0, len(own), 10_000):
            j = min(i + 10_000, len(own))
            ks, at = doc[of[i] : of[j]], np.zeros(of[j] - of[i] + j - i, np.int32)
            n = np.diff(of[i : j + 1])
            rank = np.repeat(np.arange(j - i), n)
            at[np.arange(len(ks)) + rank] = (ks - first[i:j][rank]) * 4
            at[np.cumsum(n + 1) - 1] = np.diff(ends[i : j + 1]) * 4
            raw = pa.array([pos[a:b].tobytes() for a, b in zip(ends[i:j], ends[i + 1 : j + 1], strict=True)], pa.binary())
            found = pa.StructArray.from_arrays([list_array(k1[ks], n, pa.int64()), list_array(at, n + 1, pa.int32()), raw], names=["ks", "at", "pos"])
            yield pa.RecordBatch.from_arrays([pa.array(own[i:j]), found], names=["home", "found"])

    return run


def _twice(it: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    """Of a bucket's hashes those that occur twice: the document (k1) and position of each."""
    rows, keys, n = [], [], 0
    for b in it:
        for h, g, doc, pos, flag, ks in zip(*(b.column(c) for c in ("h", "g", "doc", "pos", "flag", "keys")), strict=True):
            part = [np.frombuffer(x.as_py(), t) for x, t in ((h, np.uint64), (g, np.uint32), (doc, np.uint32), (pos, np.uint32), (flag, np.uint8))]
            own = np.frombuffer(ks.as_py(), np.int64).reshape(-1, 2)
            part[2] = part[2] + np.uint32(n)
            rows.append(part)
            keys.append(own)
            n += len(own)
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.uint32)
    h, g, doc, pos, flag = (np.concatenate(c) for c in zip(*rows, strict=True))
    del rows
    known = flag == 2
    open_ = np.flatnonzero(~known)
    order = open_[np.lexsort((g[open_], h[open_]))]
    if len(order):
        new = np.ones(len(order), bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (g[order][1:] != g[order][:-1])
        starts = np.flatnonzero(new)
        size = np.diff(np.append(starts, len(order)))
        twice = (size > 1) | (np.maximum.reduceat(flag[order], starts) == 1)
        known[order] = np.repeat(twice, size)
    hit = np.flatnonzero(known)
    return np.concatenate(keys)[doc[hit], 0], pos[hit]


def _by_home(packed: DataFrame, buckets: int, homes: int) -> DataFrame:
    found = packed.repartition(buckets, "bucket").mapInArrow(_repeats(homes), f"home long, found {_FOUND}")
    return found.groupBy("home").agg(F.collect_list("found").alias("found"))


def repeated_windows(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, k1, k2, text of every row, found: the packed starts of its windows whose words also start elsewhere, and whole: all
    of its windows do (found is null then), since the row repeats another. A home is some HOME documents by their key, so that what comes back from the buckets is a row
    a home, not one a document. Both steps join the same exchange of the texts, which Spark runs once."""
    assert size >= PERIOD, "a window must be as long as the period of the cover"
    all_ = rows = with_key(texts(docs))
    again = cut(rows.groupBy("k1", "k2").count().where("count > 1").select("k1", "k2"))
    repeat = not again.isEmpty()
    if repeat:
        once = rows.join(again, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"])
        rows = rows.join(again, ["k1", "k2"], "left_anti").unionByName(once)
    chars, n = rows.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    buckets, homes = max(8, -(-(chars or 0) // BUCKET_CHARS)), max(64, n // HOME)
    rows = rows.withColumn("home", F.pmod("k1", F.lit(homes)))
    anchors = _by_home(rows.select("k1", "k2", "text").mapInArrow(_anchors(size, buckets), _PACK), buckets, homes)
    near = rows.join(anchors, "home", "left").select("doc_id", "k1", "k2", "text", _own().alias("found"))  # the same columns as below: one exchange
    ends = _by_home(near.mapInArrow(_extended(size, buckets), _PACK), buckets, homes)
    out = rows.join(ends, "home", "left").select("doc_id", "k1", "k2", "text", _own().alias("found"), F.lit(False).alias("whole"))
    if not repeat:
        return out
    copies = all_.join(again, ["k1", "k2"], "left_semi").select("doc_id", "k1", "k2", "text", F.lit(None).cast("array<binary>").alias("found"), F.lit(True).alias("whole"))
    return out.join(again, ["k1", "k2"], "left_anti").select(copies.columns).unionByName(copies)


def _kept(size: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            n_words, n_removed, texts_ = [], [], []
            for text, found, whole in zip(b.column("text"), b.column("found"), b.column("whole"), strict=True):
                words = text.as_py().encode().split()
                p = np.arange(len(words) - size + 1) if whole.as_py() else _positions(found)
                if len(p):
                    edge = np.zeros(len(words) + 1, np.int32)
                    np.add.at(edge, p, 1)
                    np.add.at(edge, p + size, -1)
                    keep = np.cumsum(edge)[:-1] == 0
                    kept = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
                else:
                    kept = words
                n_words.append(len(words))
                n_removed.append(len(words) - len(kept))
                texts_.append(b" ".join(kept).decode())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(texts_, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"])

    return run


def substring_dedup(docs: DataFrame, size: int = 35) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text (the words that stay, joined by one space) of every row."""
    return repeated_windows(docs, size).mapInArrow(_kept(size), "doc_id long, n_words long, n_removed long, kept_text string")


def digest(docs: DataFrame) -> DataFrame:
    return substring_dedup(docs, 35).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
