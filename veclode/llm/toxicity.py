"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are the n-grams of 4 to 7 characters (code points) of the text (A-Z lower-cased, runs of white space as one
space, one at either end), hashed to 2^20; a feature is present or absent. From the labelled texts come r, the log
ratio of a feature's shares among toxic and other texts, and the FEATURES that tell the two apart most
significantly, whichever they speak for. A text is the vector of r where a selected feature is present, and a
logistic regression on these gives the score, shifted so that the best cut on the training texts gets `at`.

The fit uses at most SAMPLE labelled texts (in the order of a hash of doc_id), whose ids are broadcast; what
reaches the driver is one row a selected feature and FEATURES bits a sampled text. A labelled id is one text: of rows
that repeat an id the least text is learnt from. Scoring is one pass over whole texts. Defined cases: a null or
empty text has no feature present; without labels of both kinds every score is 0; repeated rows repeat their
score; null labels and ids teach nothing; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, cut, held_out, learn_sample, sigmoid, texts

BITS, ORDERS, RIDGE = 20, (4, 5, 6, 7), 1e-4
SAMPLE, FEATURES, LEAST, Z = 20_000, 8192, 3, 4.0


def ngrams(text: str) -> Iterator[np.ndarray]:
    """The hashed n-grams of each order, in their order in the text."""
    words = b" ".join(text.encode().lower().split()).decode()
    b = np.frombuffer(f" {words} ".encode("utf-32-le"), np.uint32)
    h = b
    for n in range(1, max(ORDERS) + 1):
        if n > 1:
            if len(b) < n:
                return
            h = h[:-1] * np.uint32(0x01000193) + b[n - 1 :]
        if n in ORDERS:
            x = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D + 2 * n)
            yield x >> np.uint32(32 - BITS)


def _present(text: str) -> np.ndarray:
    return np.unique(np.concatenate([np.zeros(0, np.uint32), *ngrams(text)]))


def _counts(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = np.zeros((2, 1 << BITS), np.int32)
    for b in it:
        for y, t in zip(b.column("y").to_pylist(), b.column("text"), strict=True):
            n[y, _present(t.as_py())] += 1
    f = np.flatnonzero(n.any(0))
    for i in range(0, len(f), 100_000):
        own = f[i : i + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(n[1, own]), pa.array(n[0, own])], names=["f", "pos", "neg"])


class Toxic:
    """The selected features, their ratios and weights, and the cut."""

    def __init__(self, features: np.ndarray, ratio: np.ndarray) -> None:
        self.ratio, self.w, self.cut, self.trained = ratio, np.zeros(len(ratio)), 0.0, False
        self.slot = np.zeros(1 << BITS, np.int16)
        self.slot[features] = np.arange(1, len(features) + 1)

    def hits(self, text: str) -> np.ndarray:
        """The selected features that are present, by number."""
        found = [s[s > 0] for h in ngrams(text) for s in (self.slot[h],)]
        return np.unique(np.concatenate([np.zeros(0, np.int16), *found])).astype(np.int64) - 1

    def learn(self, y: np.ndarray, bits: np.ndarray, steps: int = 400, ridge: float = RIDGE) -> None:
        """Logistic regression on r where present, by Nesterov's gradient; bits: a row of packed presences a text."""
        present = [np.flatnonzero(np.unpackbits(row)[: len(self.w)]) for row in bits]
        rows, cols = np.repeat(np.arange(len(y)), list(map(len, present))), np.concatenate([np.zeros(0, np.int64), *present])
        x = self.ratio[cols]
        norm = np.sqrt(np.bincount(rows, x * x, len(y)).max(initial=1))
        w = old = np.zeros(len(self.w) + 1)  # the last is the intercept
        rate = 4.0 / (norm**2 / 16 + 1)
        for k in range(steps):
            v = w + k / (k + 3) * (w - old)
            old, w = w, v - rate * gradient(v, rows, cols, x, y, ridge)
        self.w, self.trained = w[:-1], True
        s = np.bincount(rows, x * w[cols], len(y))
        order = np.argsort(-s, kind="stable")
        hit = np.cumsum(y[order])
        f1 = 2 * hit / (np.arange(1, len(y) + 1) + y.sum())
        ends = np.append(np.diff(s[order]) != 0, True)
        top = np.flatnonzero(ends & (f1 >= f1[ends].max() - 1e-12))[0]
        low = s[order[top + 1]] if top + 1 < len(y) else s[order[top]] - 1
        self.cut = s[order[top]] * 0.4 + low * 0.6

    def score(self, text: str, at: float) -> float:
        if not self.trained:
            return 0.0
        f = self.hits(text)
        return float(sigmoid(np.log(at / (1 - at)) + (self.ratio[f] * self.w[f]).sum() - self.cut))


def gradient(v: np.ndarray, rows: np.ndarray, cols: np.ndarray, x: np.ndarray, y: np.ndarray, ridge: float) -> np.ndarray:
    """Of the mean logistic loss and ridge / 2 * |v|^2 (without the intercept) at v, over entries x at (rows, cols)."""
    e = sigmoid(np.bincount(rows, x * v[cols], len(y)) + v[-1]) - y
    return np.append(np.bincount(cols, x * e[rows], len(v) - 1), e.sum()) / len(y) + ridge * np.append(v[:-1], 0)


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 3, held: int = 1) -> Toxic:
    sample = F.broadcast(learn_sample(labels, "toxic", modulus, held, SAMPLE))
    rows = texts(docs).join(sample, "doc_id").groupBy("doc_id").agg(F.min("y").alias("y"), F.min("text").alias("text"))
    rows = cut(rows.repartition(16, F.xxhash64("doc_id")))
    n = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    if len(n) < 2:
        return Toxic(np.zeros(0, np.int64), np.zeros(0))
    counts = rows.select("y", "text").mapInArrow(_counts, "f int, pos int, neg int").groupBy("f").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    share = (F.col("pos") + F.col("neg")) / (n[0] + n[1])
    z = (F.col("pos") / n[1] - F.col("neg") / n[0]) / F.sqrt(share * (1 - share) * (1 / n[0] + 1 / n[1]) + 1e-12)
    leaning = F.when(F.col("z") > 0, F.col("pos")).otherwise(F.col("neg"))
    chosen = counts.withColumn("z", z).where((F.abs("z") >= Z) & (leaning >= LEAST)).orderBy(F.desc(F.abs("z")), "f").limit(FEATURES).collect()
    ratio = np.array([np.log((r["pos"] + 1) / (n[1] + 2) * (n[0] + 2) / (r["neg"] + 1)) for r in chosen])
    model = Toxic(np.array([r["f"] for r in chosen], np.int64), ratio)

    def presences(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out = []
            for t in b.column("text"):
                on = np.zeros(FEATURES, bool)
                on[model.hits(t.as_py())] = True
                out.append(np.packbits(on).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("y"), pa.array(out, pa.binary())], names=["y", "bits"])

    seen = rows.select("y", "text").mapInArrow(presences, "y int, bits binary").toArrow()
    order = sorted(range(seen.num_rows), key=list(zip(seen["y"].to_pylist(), seen["bits"].to_pylist(), strict=True)).__getitem__)
    bits = np.frombuffer(b"".join(seen["bits"].to_pylist()), np.uint8).reshape(seen.num_rows, -1)[order]
    model.learn(seen["y"].to_numpy()[order].astype(float), bits)
    return model


def scored(docs: DataFrame, model: Toxic, at: float) -> DataFrame:
    """doc_id and score of every row."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            scores = [model.score(t.as_py(), at) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return texts(docs).mapInArrow(run, "doc_id long, score double")


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = scored(docs, fit(docs, labels, 3, 1), 0.7)
    return out.select("doc_id", held_out(3, 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
