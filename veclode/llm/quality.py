"""Quality classifier: Bradley-Terry pairwise ranking.

A text has a score s = w . x over statistics of its characters, words and lines. Of a pair of a good and a bad
text the good one is to win, with probability sigmoid(w . (x_good - x_bad)); w is fitted by logistic loss on
these feature differences. The cut is a quantile of the training scores. A score of the result is the distance
to the cut, mapped so that the cut gets `at`.

The fit uses at most SAMPLE labelled texts (in the order of a hash of doc_id), whose ids are broadcast, and PAIRS
pairs of them; of rows that repeat an id the least statistics are learnt from; scoring is one pass over all texts. Defined cases: a null or empty text has the statistics of an
empty one; without labels of both kinds every score is 0.5; repeated rows repeat their score; null labels and
ids teach nothing; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches, held_out, learn_sample, sigmoid, spare, texts

SAMPLE, PAIRS, RIDGE = 20_000, 60_000, 1.0
_CLASSES = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t", b"\n", b".,;:'\"-()?", b"!#$%&*+/<=>@[]^_`{|}~\\", bytes(range(128, 256)))
_OF = np.zeros((256, len(_CLASSES)))
for _i, _c in enumerate(_CLASSES):
    _OF[list(_c), _i] = 1


def statistics(text: str) -> list[float]:
    raw = text.encode()
    share = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _OF / max(1, len(raw))
    words, lines = raw.split(), raw.split(b"\n")
    n = max(1, len(words))
    seen = Counter(words)
    again = sum(map(bytes.__eq__, words, words[1:]))
    pairs = len(set(zip(words, words[1:], strict=False)))
    return [
        *share, np.log1p(len(words)), len(seen) / n, np.log1p(len(seen)) / np.log1p(n), again / n, pairs / max(1, n - 1), max(seen.values(), default=0) / n,
        len(raw) / n / 10, max(map(len, seen), default=0) / 50, 1 - len(set(lines)) / len(lines), np.sqrt(share[6]), np.sqrt(again / n), np.sqrt(share[0]),
    ]


def _measured(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches(it):
        x = pa.array([statistics(t.as_py()) for t in b.column("text")], pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), x], names=["doc_id", "y", "x"])


class Ranking:
    """Weights, the standardisation of the statistics, and the cut."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 7) -> None:
        good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
        self.trained = bool(len(good) and len(bad))
        if not self.trained:
            return
        self.mean, self.std = x.mean(0), x.std(0) + 1e-3
        z = self._z(x)
        rng = np.random.default_rng(seed)
        d = z[rng.choice(good, PAIRS)] - z[rng.choice(bad, PAIRS)]
        w = np.zeros(d.shape[1])
        for _ in range(12):  # Newton's method on the ridge-regularised logistic loss
            p = sigmoid(d @ w)
            w -= np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d + RIDGE * np.eye(len(w)), RIDGE * w - d.T @ (1 - p))
        self.w = w
        s = z @ w
        marks = np.quantile(s, np.linspace(0, 1, 2001))
        right = (s[good][:, None] >= marks).mean(0) if len(good) * 2001 < 5e7 else np.array([(s[good] >= m).mean() for m in marks])
        wrong = np.array([(s[bad] < m).mean() for m in marks])
        top = np.flatnonzero(right + wrong >= (right + wrong).max() - 1e-12)
        high = marks[top[-1]]
        low = s[s < marks[top[0]]].max(initial=marks[top[0]] - 1)
        self.cut = (low + high) / 2

    def _z(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.std, -6, 6)

    def scores(self, x: np.ndarray, at: float) -> np.ndarray:
        if not self.trained:
            return np.full(len(x), 0.5)
        return sigmoid(np.log(at / (1 - at)) + self._z(x) @ self.w - self.cut)


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 5, held: int = 0) -> Ranking:
    sample = F.broadcast(learn_sample(labels, "quality", modulus, held, SAMPLE))
    measured = texts(docs).join(sample, "doc_id").select("doc_id", "y", "text").mapInArrow(_measured, "doc_id long, y int, x array<double>")
    rows = measured.groupBy("doc_id").agg(F.min("y").alias("y"), F.min("x").alias("x")).select("y", "x").toArrow()  # one row a sampled id
    if not rows.num_rows:
        return Ranking(np.zeros((0, 1)), np.zeros(0))
    x = rows.column("x").combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1)
    y = rows.column("y").to_numpy()
    order = np.lexsort((y, *x.T))  # the order of the rows must not matter
    return Ranking(x[order], y[order])


def scored(docs: DataFrame, model: Ranking, at: float, name: str = "score") -> DataFrame:
    """docs with a column of that name."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            x = np.array([statistics(t.as_py() or "") for t in b.column("text")])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.scores(x, at))], names=[*b.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = scored(texts(docs), fit(docs, labels, 5, 0), 0.3)
    return out.select("doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier accepts."""
    (name,) = spare(docs, "q_score")
    return scored(docs, fit(docs, labels, 5, 0), 0.3, name).where(F.col(name) >= 0.3).select(*docs.columns)
