"""Hard-negative mining by a Voronoi-partitioned distributed kNN join.

Inner products become distances: a vector x gets one more coordinate, sqrt(M^2 - |x|^2), with M the largest norm, and an
anchor q gets a zero, so that |q' - x'|^2 = |q|^2 + M^2 - 2 q.x. Pivots, a bounded sample of the vectors, cut the space
into Voronoi cells; each vector keeps its cell and its distance to the cell's pivot. A search is a list of windows of
scores for each anchor, and the k best vectors of each window are wanted:

1. Each anchor meets the cell that it lies in. The k-th best found there raises the lower end of its window.
2. Cells are chained by nearness and cut into groups of about BLOCK anchors. By the triangle inequality, a vector at
   distance d of a pivot at distance D from an anchor lies within [|D - d|, D + d] of it. So each group of anchors has, for
   each cell, a range of d outside which no vector can fall into a window of any of its anchors: a vector is sent to
   the groups whose range holds it, and to no other.
3. A group's vectors come in shards of about SHARD rows, dealt by a hash, whatever cell or label is hot; a shard meets the
   group's anchors in a product that is exact in whole numbers, and each window's k best go on to be merged.

Positives are one search (the window is everything, the label the anchor's own), negatives another (a window for each
positive, other labels). Bounds are widened by the rounding of doubles; they drop no hit, they only spare work.

Defined cases: rows with a null label or vec_id, a null vector, or a null or non-finite component take no part, nor does a
vector whose squared norm in whole numbers is 2^62 or more (in doubles), since its scores might not fit a long; vectors of another width
than the anchor's never meet it (empty vectors meet each other, with score 0); ties go to the smaller vec_id; a row
is never positive or negative of an anchor of its own vec_id; of rows that repeat an anchor's vec_id each has
results of its own; an empty table, or one without anchors, gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import batches, cut

#: Pivots at most (else the square root of the number of rows), anchors of a group, vectors of a shard, anchors of a tile.
PIVOTS, BLOCK, SHARD, STEP = 1024, 2048, 8192, 128
_MOST = 1 << 62
_HITS = "anchor long, window int, vec_id long, score long"
_SCHEMA = pa.schema([("anchor", pa.int64()), ("window", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])


def quantised(vectors: DataFrame, scale: float = 256.0) -> DataFrame:
    """vec_id, label, v (array<int>) and norm (the squared one) of the vectors that take part."""
    x = F.col("embedding")
    good = x.isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    v = F.transform(x, lambda e: F.floor(F.lit(scale) * e.cast("double")))
    rows = vectors.where(good & F.col("vec_id").isNotNull() & F.col("label").isNotNull())
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), v.alias("v"))
    small = F.forall("v", lambda e: e.between(-(1 << 31) + 1, (1 << 31) - 1))
    rows = rows.where(small).withColumn("norm", F.aggregate("v", F.lit(0.0), lambda a, e: a + e.cast("double") * e))
    return rows.where(F.col("norm") < F.lit(float(_MOST))).select("vec_id", "label", F.col("v").cast("array<int>").alias("v"), "norm")


def _matrix(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


class Cells:
    """The pivots, by width, in the space with one more coordinate. Cells are numbered through all widths."""

    def __init__(self, pivots: dict[int, np.ndarray], top: float) -> None:
        self.top = top
        self.pivots = {w: self._lifted(p) for w, p in pivots.items()}
        sizes = [len(p) for p in self.pivots.values()]
        self.first = dict(zip(self.pivots, np.cumsum([0, *sizes]).tolist(), strict=False))
        self.n = sum(sizes)

    def _lifted(self, x: np.ndarray, anchors: bool = False) -> np.ndarray:
        more = np.zeros(len(x)) if anchors else np.sqrt(np.maximum(self.top - (x * x).sum(1), 0))
        return np.column_stack([x, more])

    def distances(self, x: np.ndarray, anchors: bool = False) -> np.ndarray:
        """To the pivots of their width."""
        p, x = self.pivots[x.shape[1]], self._lifted(x, anchors)
        return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (p * p).sum(1) - 2 * (x @ p.T), 0))

    def nearest(self, x: np.ndarray, anchors: bool = False) -> tuple[np.ndarray, np.ndarray]:
        d = self.distances(x, anchors)
        cell = d.argmin(1)
        return self.first[x.shape[1]] + cell, d[np.arange(len(x)), cell]


def voronoi(rows: DataFrame, pivots: int = PIVOTS) -> Cells:
    """Pivots from a sample by hash, as many as the square root of the rows but `pivots` at most; a width that the sample
    lacks has the origin."""
    found = rows.groupBy(F.size("v").alias("w")).agg(F.count("*").alias("n"), F.max("norm").alias("top")).collect()  # a row a width
    n, top = sum(r["n"] for r in found), max((r["top"] for r in found), default=0)
    some = rows.select("v").orderBy(F.xxhash64("v", "vec_id")).limit(max(1, min(pivots, int(n**0.5)))).collect()
    own: dict[int, list] = {r["w"]: [] for r in found}
    for r in some:
        own[len(r["v"])].append(r["v"])
    return Cells({w: np.array(p or [[0] * w], np.float64).reshape(max(1, len(p)), w) for w, p in own.items()}, float(top))


def _by_width(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The positions of a batch's vectors of each width, and the vectors."""
    size = b.column("v").value_lengths().to_numpy(zero_copy_only=False)
    for w in np.unique(size):
        at = np.flatnonzero(size == w)
        yield at, _matrix(b.column("v").take(pa.array(at))).reshape(len(at), w)


def placed(rows: DataFrame, cells: Cells, anchors: bool = False) -> DataFrame:
    """rows (with v) and the cell each lies in, as a vector or as an anchor, and dist to the cell's pivot."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, 2):
            cell, dist = np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows)
            for at, x in _by_width(b):
                cell[at], dist[at] = cells.nearest(x, anchors)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(dist)], names=[*b.schema.names, "cell", "dist"])

    return rows.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in [*rows.dtypes, ("cell", "int"), ("dist", "double")]))


def _exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, as int64."""
    if not q.shape[1]:
        return np.zeros((len(q), len(x)), np.int64)
    bound = np.sqrt((q * q).sum(1).max(initial=0) * (x * x).sum(1).max(initial=0)) * 1.0001
    if bound < 1 << 52:
        kind = np.float32 if bound < 1 << 23 else np.float64
        return (q.astype(kind) @ x.T.astype(kind)).astype(np.int64)
    return q.astype(np.int64) @ x.T.astype(np.int64)


def _tile(k: int, same: bool):
    """The k best of a shard for each window of a group's anchors, of the same or of other labels."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            q, x = _matrix(left["v"]), _matrix(right["v"])
            own, ids, labels, kinds = left["vec_id"].to_numpy(), right["vec_id"].to_numpy(), left["label"].to_numpy(), right["label"].to_numpy()
            low, high = _windows(left["low"], _MOST), _windows(left["high"], -_MOST)
            for a in range(0, len(q), STEP):
                b = slice(a, a + STEP)
                s = _exact(q[b], x)
                fits = (labels[b, None] == kinds) == same
                fits &= (own[b, None] != ids) & (s >= low[b].min(1)[:, None]) & (s <= high[b].max(1)[:, None])
                row, col = np.nonzero(fits)
                score = s[row, col]
                order = np.lexsort((ids[col], -score, row))
                row, col, score = row[order], col[order], score[order]
                for w in range(low.shape[1]):
                    at = np.flatnonzero((score >= low[a + row, w]) & (score <= high[a + row, w]))
                    place = np.arange(len(at)) - np.searchsorted(row[at], row[at])
                    at = at[place < k]
                    out.append((a + row[at], np.full(len(at), w), ids[col[at]], score[at]))
        row, window, vec, score = (np.concatenate(x) for x in zip(*out, strict=True)) if out else [np.zeros(0, np.int64)] * 4
        anchor = left["anchor"].to_numpy()[row] if len(row) else row
        return pa.table([pa.array(anchor, pa.int64()), pa.array(window, pa.int32()), pa.array(vec, pa.int64()), pa.array(score, pa.int64())], schema=_SCHEMA)

    return run


def _windows(column, empty: int) -> np.ndarray:
    """Ends of windows, a row an anchor; those that an anchor lacks get the end of an empty one."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = column.value_lengths().to_numpy(zero_copy_only=False)
    out = np.full((len(column), max(1, size.max(initial=1))), empty, np.int64)
    inside = np.arange(out.shape[1]) < size[:, None]
    out[inside] = column.flatten().to_numpy()
    return out


def _met(left: DataFrame, right: DataFrame, sizes: DataFrame, k: int, same: bool) -> DataFrame:
    """Anchors (g, anchor, ...) meet the vectors (g, ...) of their group and width in shards; sizes: g, shards. The k best of
    each window, with rank."""
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1))
    left = left.join(sizes, "g").withColumn("shard", every).withColumn("w", F.size("v"))
    left = left.select("g", "shard", "w", "anchor", "vec_id", "label", "v", "low", "high").groupBy("g", "shard", "w")
    right = right.join(sizes, "g").withColumn("shard", F.pmod(F.xxhash64("vec_id", "v"), F.col("shards"))).withColumn("w", F.size("v"))
    right = right.select("g", "shard", "w", "vec_id", "label", "v").groupBy("g", "shard", "w")
    hits = left.cogroup(right).applyInArrow(_tile(k, same), _HITS)
    order = W.partitionBy("anchor", "window").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _groups(homes: list, cells: Cells, block: int) -> tuple[dict[int, int], dict[int, int]]:
    """For the cells that hold anchors (home, n): their first group and how many groups they are split into. Cells are
    chained, each to the nearest that is left, and a group takes neighbours up to about `block` anchors; a cell of
    more is split. A driver loop over the pivots, of bounded number."""
    first, split, g = {}, {}, 0
    for width, pivots in cells.pivots.items():
        own = {r["home"] - cells.first[width]: r["n"] for r in homes if 0 <= r["home"] - cells.first[width] < len(pivots)}
        room, at, left = 0, next(iter(own), None), dict(own)
        while left:
            n = left.pop(at)
            home = at + cells.first[width]
            if n > block:
                first[home], split[home], room = g, -(-n // block), 0
                g += split[home]
            else:
                if room < n:
                    g, room = g + 1, block
                first[home], split[home], room = g - 1, 1, room - n
            if left:
                rest = np.array(list(left))
                at = int(rest[((pivots[rest] - pivots[at]) ** 2).sum(1).argmin()])
    return first, split


def search(base: DataFrame, anchors: DataFrame, cells: Cells, k: int, same: bool, block: int = BLOCK) -> DataFrame:
    """anchor, window, vec_id, score, rank: the k best vectors of each window of each anchor, of its own label (same) or of
    others. base: as `placed`. anchors: anchor, vec_id, label, v, norm, home, low and high (arrays of windows)."""
    spark, by_home = base.sparkSession, anchors.withColumn("g", F.col("home").cast("long"))
    n_cell = base.groupBy(F.col("cell").cast("long").alias("g")).agg(F.ceil(F.count("*") / SHARD).alias("shards"))
    near = _met(by_home, base.withColumn("g", F.col("cell").cast("long")), n_cell, k, same)
    least = near.where(F.col("rank") == k).groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("window", "score"))).alias("_least"))  # one entry a window
    raised = F.transform("low", lambda x, i: F.greatest(x, F.coalesce(F.try_element_at("_least", i.cast("int")), x)))
    anchors = anchors.join(least, "anchor", "left").withColumn("low", F.when(F.col("_least").isNull(), F.col("low")).otherwise(raised)).drop("_least")
    homes = anchors.groupBy("home").agg(F.count("*").alias("n")).collect()  # a row a pivot at most
    first, split = _groups(homes, cells, block)
    deal = spark.createDataFrame([(h, first[h], split[h]) for h in first], "home int, _first long, _split long")
    anchors = cut(anchors.join(F.broadcast(deal), "home").withColumn("g", F.col("_first") + F.pmod(F.xxhash64("anchor"), F.col("_split"))).drop("_first", "_split"))
    bounds = cut(_bounds(anchors, cells))
    fits = F.col("dist").between(F.col("nearest"), F.col("farthest"))
    narrow = base.select("cell", "dist").join(bounds, "cell").where(fits)
    sizes = narrow.groupBy("g").agg(F.ceil(F.count("*") / SHARD).alias("shards"))
    sent = base.select("vec_id", "label", "v", "cell", "dist").join(bounds, "cell").where(fits)
    return _met(anchors, sent, cut(sizes), k, same)


def _bounds(anchors: DataFrame, cells: Cells) -> DataFrame:
    """g, cell, nearest, farthest: the distances to a cell's pivot that a vector may have to serve an anchor of the group.
    Groups times pivots in rows, put together before the shuffle."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, 0.5):
            low, high = _windows(b.column("low"), _MOST), _windows(b.column("high"), -_MOST)
            norm, group = b.column("norm").to_numpy(), b.column("g").to_numpy()
            for at, x in _by_width(b):
                d = cells.distances(x, True)
                base, slack = norm[at] + cells.top, 1e-9 * (norm[at] + cells.top) + 1
                most = np.sqrt(np.maximum(base - 2.0 * low[at].min(1) + slack, 0))[:, None]
                least = np.sqrt(np.maximum(base - 2.0 * high[at].max(1) - slack, 0))[:, None]
                edge = 1e-6 * (1 + np.sqrt(base))[:, None]
                near, far = np.maximum(np.maximum(d - most, least - d), 0) - edge, d + most + edge
                for g in np.unique(group[at]):
                    own = group[at] == g
                    cell = cells.first[x.shape[1]] + np.arange(d.shape[1])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), g), pa.int64()), pa.array(cell, pa.int32()), pa.array(near[own].min(0)), pa.array(far[own].max(0))], names=["g", "cell", "nearest", "farthest"])

    own = anchors.select("g", "v", "norm", "low", "high").mapInArrow(run, "g long, cell int, nearest double, farthest double")
    return own.groupBy("g", "cell").agg(F.min("nearest").alias("nearest"), F.max("farthest").alias("farthest"))


def _share(percent: int, up: bool) -> Column:
    """percent of a score of 0 or more, rounded up or down, without leaving 64 bits."""
    rest = F.expr("score % 100") * percent
    return F.expr("score div 100") * percent + (F.ceil(rest / 100) if up else F.floor(rest / 100))


def mine(vectors: DataFrame, anchors: Column, n_positives: int = 5, k: int = 3, low: int = 50, high: int = 95, scale: float = 256.0, pivots: int = PIVOTS, block: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. vectors: vec_id, label, embedding; anchors: a
    condition on them. Positives: the n_positives best other rows of the anchor's label. Negatives: for each, the k best
    rows of other labels that score at least low and at most high percent of it."""
    rows = cut(quantised(vectors, scale))
    cells = voronoi(rows, pivots)
    base = cut(placed(rows, cells).withColumn("anchor", F.monotonically_increasing_id()))
    asked = placed(base.where(anchors).select("anchor", "vec_id", "label", "v", "norm"), cells, True).withColumnRenamed("cell", "home").drop("dist")
    every = asked.withColumns({"low": F.array(F.lit(-_MOST)), "high": F.array(F.lit(_MOST))})
    found = cut(search(base, every, cells, n_positives, True, block).select("anchor", F.col("rank").alias("n"), "vec_id", "score"))
    wide = found.where("score >= 0").withColumns({"low": _share(low, True), "high": _share(high, False)}).where("low <= high")
    listed = wide.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("n", "low", "high", "vec_id", "score"))).alias("p"))  # n_positives at most
    windows = cut(asked.join(listed, "anchor").withColumns({"low": F.col("p.low"), "high": F.col("p.high")}))
    hits = search(base, windows.drop("p"), cells, k, False, block)
    named = windows.select("anchor", F.col("vec_id").alias("anchor_id"), F.posexplode("p").alias("window", "p"))
    out = hits.join(named, ["anchor", "window"])
    return out.select("anchor_id", F.col("p.vec_id").alias("positive_id"), "rank", F.col("vec_id").alias("negative_id"), F.col("p.score").alias("positive_score"), F.col("score").alias("negative_score"))


def digest(embeddings: DataFrame, every: int = 50) -> DataFrame:
    """Anchors are the rows whose vec_id is divisible by `every`; where it is divisible by 7, the label moves on by one."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(embeddings.select("vec_id", label.alias("label"), "embedding"), F.col("vec_id") % every == 0)
