"""Codecs: vector, product and scalar quantization, and PCA.

Each has train, encode and decode over DataFrames (id, vec). Codebooks are small numpy arrays held by the codec
and sent to tasks; codes are columns.

Defined cases: a vector that is null, has another width than the codec's (in training: than most sampled ones) or
holds a null or non-finite element is not learnt from and gets no code; repeated ids are rows of their own.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions.arrow import from_matrix, usable
from .clustering import CHUNK, KMeans, MultiKMeans, assign, nearest


#: Columns of a block of a covariance (a multiple of CHUNK), and bytes of blocks that a task adds up.
BLOCK, BLOCK_BYTES = 512, 64_000_000


class BaseCodec(ABC):
    """Something that learns from vectors how to code them."""

    is_trained = False

    @abstractmethod
    def train(self, df: DataFrame) -> None: ...

    @abstractmethod
    def encode(self, df: DataFrame) -> DataFrame: ...

    @abstractmethod
    def decode(self, codes: DataFrame) -> DataFrame: ...


class VQCodec(BaseCodec):
    """A vector's code is its nearest centroid."""

    def __init__(self, n_clusters: int, codebook: np.ndarray | None = None, **options) -> None:
        self.kmeans = KMeans(n_clusters, **options)
        if codebook is not None:
            self.kmeans.centroids, self.is_trained = codebook[None], True

    @property
    def codebook(self) -> np.ndarray:
        return self.kmeans.centroids[0]

    def train(self, df: DataFrame) -> None:
        self.kmeans.fit(df)
        self.is_trained = True

    def encode(self, df: DataFrame) -> DataFrame:
        """id, code"""
        return assign(df, self.codebook, self.kmeans.distance).select("id", F.col("cell").alias("code"))

    def decode(self, codes: DataFrame) -> DataFrame:
        """id, vec"""
        book = codes.sparkSession.createDataFrame([(i, v.tolist()) for i, v in enumerate(self.codebook)], "code int, vec array<double>")
        return codes.join(F.broadcast(book), "code").select("id", "vec")


class PQCodec(BaseCodec):
    """The vector is cut into sub-vectors, each coded by its nearest (by `distance`) of up to 256 centroids: m bytes.
    packed: of up to 16 centroids, two codes a byte (sub-vector 2i in the high half)."""

    def __init__(self, n_subvectors: int = 8, n_clusters: int = 256, distance: str = "euclidean", max_iter: int = 25, codebook: np.ndarray | None = None, packed: bool = False, **options) -> None:
        if n_clusters > (16 if packed else 256):
            raise ValueError("a code is one byte (packed: half a byte): at most 256 (16) clusters")
        self.m, self.distance, self.packed = n_subvectors, M.canonical(distance), packed
        self.kmeans = MultiKMeans(n_subvectors, n_clusters, distance=distance, max_iter=max_iter, **options)
        if codebook is not None:
            self.kmeans.centroids, self.is_trained = codebook, True

    @property
    def codebook(self) -> np.ndarray:
        """[m, k, width]"""
        return self.kmeans.centroids

    def train(self, df: DataFrame, centroids: np.ndarray | None = None) -> None:
        """centroids: where to start from, [m, k, width]."""
        self.kmeans.fit(df, centroids)
        self.is_trained = True

    @property
    def width(self) -> int:
        """Elements of a vector."""
        return self.m * self.codebook.shape[2]

    def codes(self, x: np.ndarray) -> np.ndarray:
        """[n, m]: the code of each sub-vector."""
        book, x = self.codebook, x.reshape(len(x), self.m, -1)
        return np.stack([nearest(self.distance, x[:, s], book[s])[1] for s in range(self.m)], axis=1).astype(np.uint8)

    def pack(self, codes: np.ndarray) -> pa.Array:
        """Codes as binary."""
        if self.packed:
            codes = np.concatenate([codes, np.zeros((len(codes), self.m % 2), np.uint8)], axis=1)
            codes = codes[:, ::2] << 4 | codes[:, 1::2]
        n, size = codes.shape
        return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * size).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(codes))])

    def unpack(self, column) -> np.ndarray:
        """[n, m] of binary codes."""
        size = -(-self.m // 2) if self.packed else self.m
        codes = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), size)
        return np.stack([codes >> 4, codes & 15], axis=2).reshape(len(codes), -1)[:, : self.m] if self.packed else codes

    def decoded(self, codes: np.ndarray) -> np.ndarray:
        return self.codebook[np.arange(self.m)[None], codes].reshape(len(codes), -1)

    def adc(self, q: np.ndarray) -> np.ndarray:
        """[n, m, k]: what each sub-code adds to a query's score. For cosine it is the plain product."""
        q = q.reshape(len(q), self.m, 1, -1)
        if self.distance == "euclidean":
            return -((q - self.codebook[None]) ** 2).sum(-1)
        if self.distance == "manhattan":
            return -np.abs(q - self.codebook[None]).sum(-1)
        return (q * self.codebook[None]).sum(-1)

    def encode(self, df: DataFrame) -> DataFrame:
        """id, code (binary of m bytes; packed: of half as many)"""

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in it:
                x, at = usable(b.column("vec"), self.width)
                yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(at)), self.pack(self.codes(x))], names=["id", "code"])

        return df.select(F.col("id").cast("long").alias("id"), M.doubles("vec").alias("vec")).mapInArrow(run, "id long, code binary")

    def decode(self, codes: DataFrame) -> DataFrame:
        """id, vec"""

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in it:
                yield pa.RecordBatch.from_arrays([b.column("id"), from_matrix(self.decoded(self.unpack(b.column("code"))))], names=["id", "vec"])

        return codes.select("id", "code").mapInArrow(run, "id long, vec array<double>")

    def precompute_adc(self, queries: DataFrame) -> DataFrame:
        """q_id, sub, code, value: the lookup table of each query, in long form."""

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in it:
                x, at = usable(b.column("v"), self.width)
                t = self.adc(x)
                n, m, k = t.shape
                q = np.repeat(at, m * k)
                yield pa.RecordBatch.from_arrays(
                    [b.column("q_id").take(pa.array(q)), pa.array(np.tile(np.repeat(np.arange(m), k), n), pa.int32()), pa.array(np.tile(np.arange(k), n * m), pa.int32()), pa.array(t.ravel())], names=["q_id", "sub", "code", "value"]
                )

        return queries.select("q_id", M.doubles("q_vec").alias("v")).mapInArrow(run, "q_id long, sub int, code int, value double")


    def raw(self, column) -> np.ndarray:
        """[n, bytes] of binary codes, without a copy if they lie in one piece."""
        size = -(-self.m // 2) if self.packed else self.m
        at = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset)
        return np.frombuffer(column.buffers()[2] or b"", np.uint8)[at[0] : at[-1]].reshape(len(column), size)

    def scan(self, table: np.ndarray, raw: np.ndarray) -> np.ndarray:
        """[queries, n]: scores of codes as bytes (raw) by the queries' tables (adc). Of half-byte codes, a byte is looked
        up once for its two: their tables are added up to one of whole bytes first."""
        if self.packed:
            k, pairs = table.shape[2], np.zeros((len(table), raw.shape[1], 16, 16))
            pairs[:, :, :k] += table[:, ::2, :, None]
            pairs[:, : self.m // 2, :, :k] += table[:, 1::2, None, :]
            table = pairs.reshape(len(table), raw.shape[1], 256)
        out, one = np.zeros((len(table), len(raw))), np.empty((len(table), len(raw)))
        for i in range(table.shape[1]):
            out += np.take(table[:, i], raw[:, i], axis=1, out=one, mode="clip")
        return out


def long_codes(codes: DataFrame) -> DataFrame:
    """id, sub, code of binary codes: one row a byte."""
    m = F.octet_length("code")
    at = F.explode(F.sequence(F.lit(0), m - 1)).alias("sub")
    value = F.conv(F.hex(F.expr("substring(code, sub + 1, 1)")), 16, 10).cast("int")
    return codes.select("id", "code", at).select("id", "sub", value.alias("code"))


def whole(v: str) -> Column:
    """Whether a vector has no null and no non-finite element."""
    x = M.doubles(v)
    return x.isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))


class SQCodec(BaseCodec):
    """Each dimension is scaled into a range learnt from the data and rounded to 4 or 8 bits; 16 bits are half
    precision, 32 the value itself. Expressions only."""

    def __init__(self, bits: int = 8, alpha: float = 1.0, mode: str = "minmax") -> None:
        if bits not in (4, 8, 16, 32) or mode not in ("minmax", "meanstd"):
            raise ValueError("bits: 4, 8, 16 or 32; mode: minmax or meanstd")
        self.bits, self.alpha, self.mode = bits, alpha, mode
        self.low: list[float] = []
        self.range: list[float] = []

    def train(self, df: DataFrame) -> None:
        per = df.where(whole("vec")).select(F.posexplode(M.doubles("vec")).alias("pos", "x")).groupBy("pos")
        if self.mode == "minmax":
            t = per.agg(F.min("x").alias("low"), F.max("x").alias("high"))
        else:
            mean, dev = F.avg("x"), F.stddev_samp("x") * self.alpha
            t = per.agg((mean - dev).alias("low"), (mean + dev).alias("high"))
        rows = t.orderBy("pos").collect()  # one row a dimension
        self.low, self.range = [r["low"] for r in rows], [r["high"] - r["low"] + 1e-8 for r in rows]
        self.is_trained = True

    def _columns(self) -> tuple[Column, Column]:
        return F.array(*map(F.lit, self.low)), F.array(*map(F.lit, self.range))

    def encode(self, df: DataFrame) -> DataFrame:
        """id, code: array<int> (4 bits: dimension i with i + d / 2 in one number), or array<double>."""
        v = M.doubles("vec")
        if self.bits >= 16:
            return df.select("id", (M.half(v) if self.bits == 16 else v).alias("code"))
        low, wide = self._columns()
        bins, df = 1 << self.bits, df.where(whole("vec") & (F.size("vec") == len(self.low)))
        unit = F.zip_with(F.zip_with(v, low, lambda x, a: x - a), wide, lambda x, r: x / r)
        code = F.transform(unit, lambda x: F.least(F.greatest(F.rint(x * bins), F.lit(0.0)), F.lit(bins - 1.0)).cast("int"))
        if self.bits == 4:
            h = len(self.low) // 2
            code = F.zip_with(F.slice(code, 1, h), F.slice(code, h + 1, h), lambda a, b: a * 16 + b)
        return df.select("id", code.alias("code"))

    def decode(self, codes: DataFrame) -> DataFrame:
        """id, vec"""
        code = F.col("code")
        if self.bits >= 16:
            return codes.select("id", code.alias("vec"))
        if self.bits == 4:
            code = F.concat(F.transform(code, lambda c: F.shiftright(c, 4)), F.transform(code, lambda c: c.bitwiseAND(F.lit(15))))
        low, wide = self._columns()
        unit = F.transform(code, lambda c: c.cast("double") / (1 << self.bits))
        return codes.select("id", F.zip_with(F.zip_with(unit, wide, lambda x, r: x * r), low, lambda x, a: x + a).alias("vec"))


def covariance(df: DataFrame, width: int) -> tuple[int, np.ndarray, np.ndarray]:
    """n, the mean and the covariance (over n - 1) of vec. Tasks add up X'X around a pilot mean, so that a large offset does
    not cancel, in blocks of BLOCK by BLOCK numbers, those above the diagonal alone. A task holds BLOCK_BYTES of blocks: where
    there are more, the vectors are read in turns, each for blocks of its own. Blocks travel in rows of CHUNK numbers, which a
    hash aggregate sums; the driver gets the matrix, once."""
    some = df.where(whole("vec") & (F.size("vec") == width)).select(M.doubles("vec").alias("v")).limit(1).toArrow()
    pilot = np.array(some["v"].to_pylist()[:1] or [[0.0] * width])[0]
    starts = range(0, width + 1, BLOCK)  # the last column is of ones
    pairs = [(i, j) for i in starts for j in starts if i <= j]

    def adding(own: list[tuple[int, int]]):
        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = {at: np.zeros((min(BLOCK, width + 1 - at[0]), -(-min(BLOCK, width + 1 - at[1]) // CHUNK) * CHUNK)) for at in own}
            for b in it:
                v = usable(b.column("v"), width)[0]
                x = np.concatenate([v - pilot, np.ones((len(v), 1))], axis=1)
                for (i, j), t in total.items():
                    y = x[:, j : j + BLOCK]
                    t[:, : y.shape[1]] += x[:, i : i + BLOCK].T @ y
            for (i, j), t in total.items():
                chunks = t.shape[1] // CHUNK
                row, chunk = np.repeat(i + np.arange(len(t)), chunks), np.tile(j // CHUNK + np.arange(chunks), len(t))
                yield pa.RecordBatch.from_arrays([pa.array(row, pa.int32()), pa.array(chunk, pa.int32()), from_matrix(t.reshape(-1, CHUNK))], names=["row", "chunk", "x"])

        return run

    v, parts = df.select(M.doubles("vec").alias("v")), None
    turn = max(1, BLOCK_BYTES // (8 * BLOCK * BLOCK))
    for at in range(0, len(pairs), turn):
        one = v.mapInArrow(adding(pairs[at : at + turn]), "row int, chunk int, x array<double>")
        parts = one if parts is None else parts.unionByName(one)
    t = parts.groupBy("row", "chunk").agg(*(F.sum(F.get("x", F.lit(i))).alias(f"x{i}") for i in range(CHUNK))).toPandas()
    every = np.zeros((width + 1, width // CHUNK + 1, CHUNK))
    every[t["row"], t["chunk"]] = t[[f"x{i}" for i in range(CHUNK)]].to_numpy()
    every = np.triu(every.reshape(width + 1, -1)[:, : width + 1])
    n, mean = int(round(every[-1, -1])), every[:-1, -1] / max(1.0, every[-1, -1])
    upper = (every[:-1, :-1] - n * np.outer(mean, mean)) / max(1, n - 1)
    return n, mean + pilot, np.triu(upper) + np.triu(upper, 1).T


class PCA(BaseCodec):
    """y = W (x - mean): the directions of largest variance. Each has its element of largest magnitude positive."""

    def __init__(self, n_components: int) -> None:
        self.n_components = n_components
        self.mean = self.components = self.variances = np.zeros(0)

    def train(self, df: DataFrame) -> None:
        width = df.where(whole("vec")).groupBy(F.size("vec").alias("w")).count().orderBy(F.desc("count"), F.desc("w")).first()["w"]  # one row a width
        _, self.mean, cov = covariance(df, width)
        values, vectors = np.linalg.eigh(cov)
        order = np.argsort(-values, kind="stable")[: self.n_components]
        w = vectors[:, order].T
        self.components = w * np.sign(w[np.arange(len(w)), np.abs(w).argmax(1)])[:, None]
        self.variances, self.is_trained = values[order], True

    def _mapped(self, df: DataFrame, f, width: int) -> DataFrame:
        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in it:
                x, at = usable(b.column("vec"), width)
                yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(at)), from_matrix(f(x))], names=["id", "vec"])

        return df.select(F.col("id").cast("long").alias("id"), M.doubles("vec").alias("vec")).mapInArrow(run, "id long, vec array<double>")

    def encode(self, df: DataFrame) -> DataFrame:
        return self._mapped(df, lambda x: (x - self.mean) @ self.components.T, len(self.mean))

    def decode(self, codes: DataFrame) -> DataFrame:
        return self._mapped(codes, lambda y: y @ self.components + self.mean, len(self.components))
