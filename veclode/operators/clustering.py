"""k-means: one problem, many problems at once, and mini-batches.

Data stay distributed; an iteration is one job. Tasks assign their vectors to the broadcast centroids by a
matrix product, tile by tile, and return a partial sum, count and score per cell; these are added up by a hash aggregate and
only k rows reach the driver, which holds the new centroids. No lineage grows over the iterations.

Defined cases: a vector that is null, has another width than the centroids (when they are sampled: than most sampled
vectors) or holds a null or non-finite element takes no part and has no row in a result; repeated ids are rows of
their own; ties go to the smaller cell.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions.arrow import best_rows, from_matrix, usable
from ..sources import scratch
from .search import knn_join

#: Bytes of centroids that are sent to every task; larger sets are joined with the vectors instead.
CENTROID_BYTES = 256_000_000
#: Bytes of similarities that a task holds at once (about what a core's cache holds); what counts as a tie; sums that
#: travel in one row.
TILE_BYTES, TIE, CHUNK = 2_000_000, 1e-12, 32
#: Seeds after which the running minimum of farthest_first is written out, so that lineage stays short.
SEEDS_A_CUT = 16
#: Rows of which core_seeds takes seeds in one task, and at last in the driver (or twice the seeds, if that is more).
CORE = 16_384


def _prepared(df: DataFrame) -> DataFrame:
    return df.select(F.col("id").cast("long").alias("id"), M.doubles("vec").alias("vec"))


def tiles(metric: str, n: int, c: np.ndarray) -> range:
    """Starts of slices of n vectors whose similarities to c (and, for manhattan, whose differences) fit in TILE_BYTES."""
    each = 8 * max(1, len(c)) * (c.shape[1] if M.canonical(metric) == "manhattan" else 1)
    return range(0, n, max(1, TILE_BYTES // max(1, each)))


def nearest(metric: str, x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Score and index of the most similar centroid; ties (up to TIE) to the lower index."""
    cell, parts = np.zeros(len(x), np.int64), tiles(metric, len(x), c)
    flat = M.canonical(metric) == "euclidean"
    half = (c * c).sum(1) / 2
    for i in parts:
        own = x[i : i + parts.step]
        # of the squared distance, what differs between centroids
        s = own @ c.T - half if flat else M.matrix(metric, own, c)
        cell[i : i + parts.step] = (s >= s.max(axis=1, keepdims=True) - (TIE / 2 if flat else TIE)).argmax(axis=1)
    return M.direct(metric, x, c[cell]), cell


def nearest_k(metric: str, x: np.ndarray, c: np.ndarray, k: int) -> np.ndarray:
    """[n, k]: the k most similar centroids of each vector, best first; ties (to 12 digits) to the lower index."""
    k = min(k, len(c))
    out, parts = np.zeros((len(x), k), np.int64), tiles(metric, len(x), c)
    for i in parts:
        s = np.round(M.matrix(metric, x[i : i + parts.step], c), 12)
        cols = np.sort(best_rows(s, np.arange(len(c)), k)[1].reshape(-1, k), axis=1)
        order = np.argsort(-np.take_along_axis(s, cols, 1), axis=1, kind="stable")
        out[i : i + parts.step] = np.take_along_axis(cols, order, 1)
    return out


def assign(df: DataFrame, centroids: np.ndarray, metric: str = "euclidean") -> DataFrame:
    """id, cell, score: the nearest centroid of each vector (id, vec); of centroids beyond CENTROID_BYTES by nearest_joined."""
    if centroids.nbytes > CENTROID_BYTES:
        found = nearest_joined(df, centroid_table(df.sparkSession, centroids), 1, metric)
        return found.select(F.col("q_id").alias("id"), "cell", "score")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            x, at = usable(b.column("vec"), centroids.shape[1])
            score, cell = nearest(metric, x, centroids)
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(at)), pa.array(cell, pa.int32()), pa.array(score)], names=["id", "cell", "score"])

    return _prepared(df).mapInArrow(run, "id long, cell int, score double")


def centroid_table(spark, centroids: np.ndarray) -> DataFrame:
    """cell, vec of centroids [k, d], sent to Spark by slices."""
    step, out = max(1, 32_000_000 // (8 * max(1, centroids.shape[1]))), None
    for i in range(0, len(centroids), step):
        own = centroids[i : i + step]
        one = spark.createDataFrame(pa.table({"cell": pa.array(np.arange(i, i + len(own)), pa.int32()), "vec": from_matrix(own)}))
        out = one if out is None else out.unionByName(one)
    return out


def nearest_joined(df: DataFrame, centroids: DataFrame, k: int, metric: str = "euclidean") -> DataFrame:
    """q_id, rank, cell, score of the k most similar centroids (cell, vec) of each vector (id, vec), where centroids are a table
    of any size: no task sees them all. Vectors and centroids meet in the cells of pivots of centroids, as in
    search.knn_join; ties (to 12 digits) go to the lower cell, and rows that repeat an id have lists of their own."""
    rows = scratch.cut(_prepared(df).withColumn("row", F.monotonically_increasing_id()))
    base = centroids.select(F.col("cell").cast("long").alias("id"), M.doubles("vec").alias("v"))
    found = knn_join(base, rows.select(F.col("row").alias("q_id"), F.col("vec").alias("v")), k, metric, digits=12)
    found = found.select(F.col("q_id").alias("row"), "rank", F.col("id").cast("int").alias("cell"), "score")
    return rows.select("row", F.col("id").alias("q_id")).join(found, "row").select("q_id", "rank", "cell", "score")


def grouped_means(df: DataFrame, by: str, width: int, cells: int | None = None) -> DataFrame:
    """by, mean (array<double>) and n of the vectors of each group; with `cells`, one row for each of 0..cells-1, zero
    where a group is empty. Expressions only: partial sums by group and position, then one row a group. Vectors that
    are null or of another width, or hold null or non-finite elements, do not count."""
    x = M.doubles("vec")
    good = x.isNotNull() & (F.size(x) == width) & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    sums = df.where(good).select(by, F.posexplode(x).alias("pos", "x")).groupBy(by, "pos").agg(F.count("*").alias("n"), F.sum("x").alias("s"))
    mean = F.transform(F.array_sort(F.collect_list(F.struct("pos", (F.col("s") / F.col("n")).alias("m")))), lambda e: e["m"])
    out = sums.groupBy(by).agg(F.max("n").alias("n"), mean.alias("mean"))
    if cells is not None:
        every = df.sparkSession.range(cells).select(F.col("id").cast("int").alias(by))
        out = every.join(out, by, "left")
    return out.select(by, F.coalesce("mean", F.array_repeat(F.lit(0.0), width)).alias("mean"), F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def _partials(df: DataFrame, centroids: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums [l, k, d], counts [l, k] and total similarities [l] of the assignment to centroids [l, k, d]."""
    l, k, d = centroids.shape  # noqa: E741
    chunks = -(-d // CHUNK)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, count, score = np.zeros((l * k, chunks * CHUNK)), np.zeros(l * k), np.zeros(l * k)
        for b in it:
            x = usable(b.column("vec"), l * d)[0].reshape(-1, l, d)
            for p in range(l):
                s, cell = nearest(metric, x[:, p], centroids[p])
                cell = cell + p * k
                np.add.at(sums[:, :d], cell, x[:, p])
                count += np.bincount(cell, minlength=l * k)
                score += np.bincount(cell, s, l * k)
        on = np.flatnonzero(count)
        for c in range(chunks):
            own = np.full(len(on), c)
            yield pa.RecordBatch.from_arrays([pa.array(on), pa.array(own, pa.int32()), pa.array(count[on]), pa.array(score[on]), from_matrix(sums[on, c * CHUNK : (c + 1) * CHUNK])], names=["cell", "chunk", "n", "score", "sums"])

    parts = _prepared(df).mapInArrow(run, "cell long, chunk int, n double, score double, sums array<double>")
    added = [F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(CHUNK)]
    t = parts.groupBy("cell", "chunk").agg(F.sum("n").alias("n"), F.sum("score").alias("score"), *added).toPandas()
    sums, count, score = np.zeros((l * k, chunks, CHUNK)), np.zeros(l * k), np.zeros(l * k)
    at = t["cell"].to_numpy()
    sums[at, t["chunk"].to_numpy()], count[at], score[at] = t[[f"s{i}" for i in range(CHUNK)]].to_numpy(), t["n"], t["score"]
    return sums.reshape(l * k, -1)[:, :d].reshape(l, k, d), count.reshape(l, k), score.reshape(l, k).sum(1)


def sampled(df: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """k rows (id, vec) without null or non-finite elements, in the order of md5("seed/id"): the same for every run and
    partitioning."""
    x = F.col("vec")
    whole = x.isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    key = F.md5(F.concat(F.lit(f"{seed}/"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"))
    return _prepared(df).where(whole).orderBy(key, "id", F.xxhash64("vec")).limit(k)


def sample_rows(df: DataFrame, k: int, seed: int = 0) -> np.ndarray:
    """The vectors of k sampled rows, of the width that most of the first k have."""
    rows = sampled(df, k, seed).toArrow()
    found = usable(rows.column("vec"))[0]
    if len(found) < rows.num_rows:
        found = usable(sampled(df.where(F.size("vec") == found.shape[1]), k, seed).toArrow().column("vec"))[0]
    if len(found) < k:
        raise ValueError(f"{k} clusters need as many vectors; there are {len(found)}")
    return found


def farthest_first(df: DataFrame, k: int, metric: str = "euclidean", first: np.ndarray | None = None, seed: int = 0) -> np.ndarray:
    """k seeds: the first given or sampled, each next one the vector least similar to its nearest seed.

    Each vector keeps its similarity to the nearest seed so far, so a further seed costs one product a vector: its own."""
    seeds = sample_rows(df, 1, seed) if first is None else np.atleast_2d(first)

    def compared(state: DataFrame, new: np.ndarray) -> DataFrame:
        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in it:
                x, at = usable(b.column("vec"), new.shape[1])
                best = np.maximum(b.column("best").to_numpy(zero_copy_only=False)[at], nearest(metric, x, new)[0])
                yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(at)), from_matrix(x), pa.array(best)], names=["id", "vec", "best"])

        return state.mapInArrow(run, "id long, vec array<double>, best double")

    state, new, held = _prepared(df).withColumn("best", F.lit(float("-inf"))), seeds, None
    while len(seeds) < k:
        state = compared(state, new)
        state = scratch.cut(state) if len(seeds) % SEEDS_A_CUT == 0 else state.persist()
        far = state.agg(F.min(F.struct(F.round("best", 12).alias("score"), "id", "vec")).alias("far")).first()["far"]
        if held is not None:
            held.unpersist()
        held, new = state, np.array([far["vec"]])
        seeds = np.concatenate([seeds, new])
    if held is not None:
        held.unpersist()
    return seeds


class MultiKMeans:
    """l independent problems over the same items: `vec` is the concatenation of an item's l vectors of equal width.
    One error over all problems decides when to stop; of n_redo runs the one with the lowest mean inertia stays."""

    def __init__(self, n_problems: int, n_clusters: int, n_redo: int = 1, max_iter: int = 100, tol: float = 1e-4, distance: str = "euclidean", init_mode: str = "random", seed: int = 0, keep_between_redos: bool = False) -> None:
        self.l, self.k, self.n_redo, self.max_iter, self.tol = n_problems, n_clusters, n_redo, max_iter, tol
        self.distance, self.init_mode, self.seed, self.keep = M.canonical(distance), init_mode, seed, keep_between_redos
        self.centroids: np.ndarray | None = None
        self.inertia = self.error = float("inf")
        self.n_iter = 0

    def _init(self, df: DataFrame, redo: int) -> np.ndarray:
        if self.init_mode == "kmeans++":
            x = M.doubles("vec")
            d = len(sample_rows(df, 1)[0]) // self.l
            parts = [farthest_first(df.select("id", F.slice(x, p * d + 1, d).alias("vec")), self.k, self.distance, seed=self.seed + redo) for p in range(self.l)]
            return np.stack(parts)
        rows = sample_rows(df, self.k, self.seed + redo)
        return rows.reshape(self.k, self.l, -1).transpose(1, 0, 2).copy()

    def fit(self, df: DataFrame, centroids: np.ndarray | None = None) -> DataFrame:
        """Labels of the last assignment: id and cell (one problem) or cells (array, one for each problem). As specified,
        the labels and the inertia belong to the centroids before their last update."""
        best = None
        df = _prepared(df).cache()
        now = centroids
        for redo in range(self.n_redo):
            if now is None or (redo and not self.keep):
                now = self._init(df, redo)
            for n in range(1, self.max_iter + 1):
                sums, count, score = _partials(df, now, self.distance)
                new = np.where(count[..., None] > 0, sums / np.maximum(count, 1)[..., None], 0.0)
                error, before, now = float(((new - now) ** 2).sum()), now, new
                inertia = float(-score.sum() / max(1.0, count.sum()))
                if error <= self.tol:
                    break
            if best is None or inertia < best[0]:
                best = (inertia, error, before, now, n)
        self.inertia, self.error, before, self.centroids, self.n_iter = best
        out = self._labels(df, before)
        df.unpersist()
        return out

    def _labels(self, df: DataFrame, centroids: np.ndarray) -> DataFrame:
        metric, l = self.distance, self.l  # noqa: E741

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in it:
                x, at = usable(b.column("vec"), l * centroids.shape[2])
                x = x.reshape(len(at), l, -1)
                cells = np.stack([nearest(metric, x[:, p], centroids[p])[1] for p in range(l)], axis=1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(at)), from_matrix(cells)], names=["id", "cells"])

        return _prepared(df).mapInArrow(run, "id long, cells array<int>")

    def predict(self, df: DataFrame) -> DataFrame:
        return self._labels(df, self.centroids)

    def topk(self, df: DataFrame, k: int) -> DataFrame:
        """q_id, problem, rank, cell, score: the k nearest centroids of each vector (id, vec) in every problem."""
        return nearest_cells(df, self.centroids, k, self.distance)


def _greedy(metric: str, x: np.ndarray, ids: np.ndarray, k: int, first: np.ndarray | None = None) -> np.ndarray:
    """Positions of k rows, each the farthest (of the least largest similarity) from those before it, ties to the smaller id;
    the first is the farthest from `first`, or else the one of the smallest id."""
    order = np.argsort(ids, kind="stable")
    own = x[order]
    near = np.full(len(own), -np.inf) if first is None else np.round(M.matrix(metric, own, first), 12).max(1)
    out = []
    for _ in range(min(k, len(own))):
        at = int(near.argmin())
        out.append(at)
        near = np.maximum(near, np.round(M.matrix(metric, own, own[at : at + 1]), 12)[:, 0])
        near[at] = np.inf
    return order[np.array(out, np.int64)]


def core_seeds(df: DataFrame, k: int, distance: str = "euclidean") -> np.ndarray:
    """[k, d] seeds far from each other, in two jobs however many they are: each task takes k rows farthest-first from its
    own vectors (id, vec), in batches whose picks compete again, and the same is done over the union of the tasks' picks in a
    tree of groups of at most CORE rows. Every vector lies within a few times the best possible radius of a seed (a core
    set of core sets), where `farthest_first` gives twice the radius in k jobs. Fewer vectors than k give fewer seeds."""
    metric = M.canonical(distance)
    width = df.select(F.size("vec").alias("w")).where("w >= 0").groupBy("w").count().orderBy(F.desc("count"), F.desc("w")).first()
    if width is None:
        return np.zeros((0, 0))

    def picked(ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        at = _greedy(metric, x, ids, k)
        return pa.RecordBatch.from_arrays([pa.array(ids[at]), from_matrix(x[at])], names=["id", "vec"])

    def own(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x = np.zeros(0, np.int64), np.zeros((0, width["w"]))
        for b in it:
            more, at = usable(b.column("vec"), width["w"])
            ids, x = np.append(ids, b.column("id").to_numpy()[at]), np.concatenate([x, more])
            if len(ids) > 4 * k:
                at = _greedy(metric, x, ids, k)
                ids, x = ids[at], x[at]
        if len(ids):
            yield picked(ids, x)

    def merged(t: pa.Table) -> pa.Table:
        x, at = usable(t["vec"], width["w"])
        return pa.Table.from_batches([picked(t["id"].to_numpy()[at], x)])

    rows = df.select(F.col("id").cast("long").alias("id"), M.doubles("vec").alias("vec")).mapInArrow(own, "id long, vec array<double>")
    rows = scratch.cut(rows.withColumn("_g", F.monotonically_increasing_id()))
    n = rows.count()
    while n > max(CORE, 2 * k):
        groups = -(-n // max(CORE, 2 * k))
        rows = rows.withColumn("_g", F.pmod(F.xxhash64("_g"), F.lit(groups))).groupBy("_g").applyInArrow(merged, "id long, vec array<double>")
        rows = scratch.cut(rows.withColumn("_g", F.monotonically_increasing_id()))
        n = rows.count()
    t = rows.select("id", "vec").toArrow()  # at most CORE rows or 2 k
    x, at = usable(t["vec"], width["w"])
    return x[_greedy(metric, x, t["id"].to_numpy()[at], k)]


class KMeans(MultiKMeans):
    """Lloyd's algorithm for one problem. An empty cluster's centroid becomes the zero vector."""

    def __init__(self, n_clusters: int, **options) -> None:
        super().__init__(1, n_clusters, **options)

    def fit(self, df: DataFrame, centroids: np.ndarray | None = None) -> DataFrame:
        out = super().fit(df, None if centroids is None else centroids[None])
        return out.select("id", F.get("cells", F.lit(0)).alias("cell"))

    def predict(self, df: DataFrame) -> DataFrame:
        return assign(df, self.centroids[0], self.distance).select("id", "cell")

    def topk(self, df: DataFrame, k: int) -> DataFrame:
        """q_id, rank, cell, score: the k nearest centroids of each vector (id, vec)."""
        return nearest_cells(df, self.centroids, k, self.distance).drop("problem")


def nearest_cells(df: DataFrame, centroids: np.ndarray, k: int, metric: str = "euclidean") -> DataFrame:
    """q_id, rank, cell, score of the k centroids [n, d] nearest to each vector (id, vec); of several problems, centroids
    [l, n, d] and vectors of l * d elements, with a column `problem`."""
    several = centroids.ndim == 3
    if not several and centroids.nbytes > CENTROID_BYTES:
        return nearest_joined(df, centroid_table(df.sparkSession, centroids), k, metric)
    book = centroids if several else centroids[None]
    k = min(k, book.shape[1])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            x, at = usable(b.column("vec"), len(book) * book.shape[2])
            x = x.reshape(len(at), len(book), -1)
            for p, c in enumerate(book):
                rows, cols = np.repeat(np.arange(len(at)), k), nearest_k(metric, x[:, p], c, k).ravel()
                arrays = [b.column("id").take(pa.array(at[rows])), pa.array(np.full(len(rows), p), pa.int32()), pa.array(np.tile(np.arange(1, k + 1), len(at)), pa.int32()), pa.array(cols, pa.int32()), pa.array(M.direct(metric, x[rows, p], c[cols]))]
                yield pa.RecordBatch.from_arrays(arrays, names=["q_id", "problem", "rank", "cell", "score"])

    out = _prepared(df).mapInArrow(run, "q_id long, problem int, rank int, cell int, score double")
    return out if several else out.drop("problem")


class MinibatchKMeans:
    """k-means that learns from batches. Counts start at 1; a cluster's centroid moves to the batch mean by 1 / count.
    A cluster without a point in the batch stays where it is (strict_reference: it shrinks toward the origin)."""

    def __init__(self, n_clusters: int, distance: str = "euclidean", seed: int = 0, strict_reference: bool = False) -> None:
        self.k, self.distance, self.seed, self.strict = n_clusters, M.canonical(distance), seed, strict_reference
        self.centroids: np.ndarray | None = None
        self.counts = np.ones(n_clusters)
        self.inertia = self.error = float("inf")

    def fit_minibatch(self, df: DataFrame, centroids: np.ndarray | None = None) -> DataFrame:
        """Learns from the batch (id, vec) and returns its labels, id and cell, under the centroids before it."""
        if self.centroids is None:
            self.centroids = sample_rows(df, self.k, self.seed) if centroids is None else centroids.copy()
        before = self.centroids
        sums, count, score = (a[0] for a in _partials(df, before[None], self.distance))
        mean = sums / np.maximum(count, 1)[:, None]
        w = (1 / self.counts)[:, None]
        moved = before * (1 - w) + mean * w
        self.centroids = moved if self.strict else np.where(count[:, None] > 0, moved, before)
        self.counts = self.counts + count
        self.inertia, self.error = float(-score / max(1.0, count.sum())), float(((self.centroids - before) ** 2).sum())
        return assign(df, before, self.distance).select("id", "cell")

    def predict(self, df: DataFrame) -> DataFrame:
        return assign(df, self.centroids, self.distance).select("id", "cell")

    def topk(self, df: DataFrame, k: int) -> DataFrame:
        return nearest_cells(df, self.centroids, k, self.distance)
