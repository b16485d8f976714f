"""IVF-PQ: cells by a coarse quantizer, product-quantized codes in the cells, search in the nearest cells.

Adding vectors assigns and encodes them in one pass and stores the codes once, in the shared folder, as a table bucketed by
unit: a cell, or a run of PIECE slots of a large one. The next free slot of each cell (one number a cell) stays beside it,
and so does the inverse map (id, cell, slot), a table bucketed by id. A search shuffles the queries to the buckets of the
units that they ask for; the codes stay where they were written. They meet in a cogroup, inside which a code is never
decoded: each query has a table of what every sub-code adds to its score, and the codes' bytes look it up (half-byte codes
two at once). Only each query's best of a unit go on to be merged.

With `bounded`, a search looks first into the probed cell that is nearest to each query. Each cell knows how far its decoded
codes reach from its centroid, so the triangle inequality bounds the scores in a cell; those that cannot come up to the
k-th best found so far are not scanned. The rows are the same as without.

Removes are addresses: an id is looked up in the inverse map when it is removed, and the slots found are dead from then on.
So order holds: an id that is added again gets a new slot and lives. Dead slots travel to their unit with the queries,
and `compact` writes the living rows anew. Slots are never given twice.

Defined cases: a vector that is null, has another width than the codebooks or holds a null or non-finite element is
not added, and as a query finds nothing; repeated ids are entries of their own; ties go to the smaller id; removing an
unknown or null id changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions.arrow import from_matrix, to_matrix, usable
from ..sources import persist, scratch, store
from .clustering import KMeans, nearest, nearest_cells
from .codecs import PQCodec, VQCodec
from .search import SLACK, best_rows, knn, listed_product, padded, top_1, top_k

#: Slots of a unit, queries times codes of a look-up, queries that a unit meets at once and hits that it gives at once, rows of
#: a bucket (about), and units that a search names to the scan, so that it leaves out other buckets.
PIECE, LOOKED, ASKING, GIVEN, BUCKET, NAMED = 65_536, 1 << 21, 16_384, 300_000, 1 << 20, 1000


def smart_probes(probes: DataFrame, n_probe: int, temperature: float = 30.0) -> DataFrame:
    """The probes (q_id, rank, cell, score) that each query needs: of the softmax p of -sqrt|score| / temperature over its
    n_probe cells, ceil(entropy / log2(n_probe) * n_probe) of them, at least 1 and at most n_probe."""
    if n_probe < 2:
        return probes
    x = F.lit(0.0) - F.sqrt(F.abs("score")) / temperature
    lists = probes.withColumn("x", x).groupBy("q_id").agg(F.array_sort(F.collect_list(F.struct("rank", "cell", "score", "x"))).alias("p"))
    top = F.array_max(F.transform("p", lambda e: e["x"]))
    w = F.transform("p", lambda e: F.exp(e["x"] - top))
    share = F.transform(w, lambda e: e / M.total(w))
    entropy = F.lit(0.0) - M.total(F.transform(share, lambda e: F.when(e > 0, e * F.log2(e)).otherwise(0.0)))
    need = F.least(F.greatest(F.ceil(F.round(entropy / np.log2(n_probe) * n_probe, 9)), F.lit(1)), F.lit(n_probe)).cast("int")
    return lists.select("q_id", need.alias("n"), F.inline("p")).where(F.col("rank") <= F.col("n")).select("q_id", "rank", "cell", "score")


class Part(NamedTuple):
    """What one add stored: codes (id, cell, slot, unit, code, ...), ids (id, cell, slot), in so many buckets, each cell's
    first slot and the one after its last, the folder, where it is the index's own, and how far decoded codes are from the
    cell's centroid at most (None: not known)."""

    codes: DataFrame
    ids: DataFrame
    buckets: int
    low: np.ndarray
    high: np.ndarray
    path: str | None = None
    reach: np.ndarray | None = None


def unit(cell: Column, slot: Column) -> Column:
    """The bucketing key of a cell's run of PIECE slots."""
    return F.shiftleft(cell.cast("long"), 32) + F.floor(slot / PIECE).cast("long")


class IVFPQIndex:
    """distance: euclidean, inner, cosine or manhattan; the coarse step is always Euclidean. With residual, codes are of the
    vector less its cell's centroid and scores are negative squared distances. packed: half-byte codes."""

    def __init__(self, n_subvectors: int = 8, n_cells: int = 128, distance: str = "euclidean", residual: bool = False, n_pq_clusters: int = 256, vq_iter: int = 15, pq_iter: int = 25, seed: int = 0, packed: bool = False) -> None:
        self.distance, self.residual, self.n_cells = M.canonical(distance), residual, n_cells
        self.vq = VQCodec(n_cells, max_iter=vq_iter, seed=seed)
        self.pq = PQCodec(n_subvectors, n_pq_clusters, "euclidean" if residual else self.distance, pq_iter, packed=packed, seed=seed)
        self.n_probe, self.use_smart_probing, self.temperature, self.bounded = 1, True, 30.0, False
        self._parts: list[Part] = []
        self._gone: list[DataFrame] = []  # unit, slot
        self._sizes = np.zeros(n_cells, np.int64)

    def __getstate__(self) -> dict:
        """What tasks need: all but the tables."""
        return self.__dict__ | {"_parts": [], "_gone": []}

    @property
    def is_trained(self) -> bool:
        return self.vq.is_trained and self.pq.is_trained

    @property
    def score_metric(self) -> str:
        """What hits are scored by: cosine vectors are normalised before, so theirs is the inner product."""
        return "euclidean" if self.residual else "inner" if self.distance == "cosine" else self.distance

    def set_codebooks(self, centroids: np.ndarray, codebook: np.ndarray) -> None:
        """Known codebooks instead of training: [n_cells, d] and [m, k, d / m]."""
        self.vq.kmeans.centroids, self.vq.is_trained = centroids[None], True
        self.pq.kmeans.centroids, self.pq.is_trained = codebook, True

    def _plain(self, df: DataFrame, id_: str = "id", vec: str = "vec") -> DataFrame:
        return df.select(F.col(id_).cast("long").alias("id"), M.doubles(vec).alias("vec"))

    def _ready(self, x: np.ndarray) -> np.ndarray:
        return M.unit_rows(x, M.NORM_EPS) if self.distance == "cosine" else x

    def _mapped(self, df: DataFrame, f, width: int | None = None) -> DataFrame:
        """(id, vec) with f of the ready vectors."""

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in it:
                x, at = usable(b.column("vec"), width)
                yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(at)), from_matrix(f(self._ready(x)))], names=["id", "vec"])

        return df.mapInArrow(run, "id long, vec array<double>")

    def train(self, df: DataFrame, force_retrain: bool = False) -> None:
        if self.is_trained and not force_retrain:
            return
        df = self._plain(df)
        ready = self._mapped(df, lambda x: x) if self.distance == "cosine" else df
        self.vq.train(ready)
        self.pq.train(self.residuals(df) if self.residual else ready)

    def residuals(self, df: DataFrame) -> DataFrame:
        """(id, vec) less the centroid of its cell."""
        book = self.vq.codebook
        return self._mapped(self._plain(df), lambda x: x - book[nearest("euclidean", x, book)[1]], book.shape[1])

    # what a row holds besides its id: the cell and the codes

    def _fields(self) -> list[str]:
        return ["code"]

    def _coded(self, x: np.ndarray, cell: np.ndarray) -> list[pa.Array]:
        return [self.pq.pack(self.pq.codes(x - self.vq.codebook[cell] if self.residual else x))]

    def _near(self, cell: np.ndarray, codes: list) -> np.ndarray:
        """What the first codes stand for."""
        x = self.pq.decoded(self.pq.unpack(codes[0]))
        return x + self.vq.codebook[cell] if self.residual else x

    def _encoded(self, df: DataFrame) -> DataFrame:
        book, fields = self.vq.codebook, self._fields()

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in it:
                x, at = usable(b.column("vec"), book.shape[1])
                x = self._ready(x)
                cell = nearest("euclidean", x, book)[1]
                codes = self._coded(x, cell)
                far = self._apart(self._near(cell, codes), book[cell])
                yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(at)), pa.array(cell, pa.int32()), *codes, pa.array(far)], names=["id", "cell", *fields, "far"])

        return self._plain(df).mapInArrow(run, "id long, cell int, " + ", ".join(f"{f} binary" for f in fields) + ", far double")

    def _apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Distances of rows, in which cells reach: of the Manhattan metric its own, else Euclidean."""
        return np.abs(a - b).sum(-1) if self.distance == "manhattan" else np.sqrt(((a - b) ** 2).sum(-1))

    def encode(self, df: DataFrame) -> DataFrame:
        """id, cell, code of each vector (id, vec), in one pass."""
        return self._encoded(df).select("id", "cell", "code")

    def decode(self, codes: DataFrame) -> DataFrame:
        """id, vec of codes (id, cell, code)."""

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in it:
                yield pa.RecordBatch.from_arrays([b.column("id"), from_matrix(self._near(b.column("cell").to_numpy(), [b.column("code")]))], names=["id", "vec"])

        return codes.select("id", "cell", "code").mapInArrow(run, "id long, vec array<double>")

    # the stored rows

    @property
    def rows(self) -> DataFrame:
        """id, cell, slot, code of what was added and not removed."""
        return self._stored().drop("unit")

    def _stored(self) -> DataFrame:
        return self._living([p.codes for p in self._parts], ["unit", "slot"])

    def _living(self, parts: list[DataFrame], on: list[str]) -> DataFrame:
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out.join(self._dead(), on, "left_anti") if self._gone else out

    def _dead(self) -> DataFrame:
        """unit, slot, cell of what was removed."""
        out = self._gone[0]
        for more in self._gone[1:]:
            out = out.unionByName(more)
        return out.withColumn("cell", F.shiftright("unit", 32).cast("int"))

    @property
    def codes(self) -> DataFrame:
        return self.rows.select("id", "cell", "code")

    @codes.setter
    def codes(self, rows: DataFrame) -> None:
        """Rows that were encoded before (id, cell, code and, if they have them, slot), instead of what was added."""
        own = rows.withColumn("cell", F.col("cell").cast("int"))
        if "slot" not in rows.columns:
            own = store.numbered(own, ["cell", "id"], "n")
            sizes = self._counted(own, F.count("*"))
            first = self._per_cell(own.sparkSession, first=np.cumsum(sizes) - sizes)
            own = own.join(first, "cell").withColumn("slot", F.col("n") - F.col("first"))
        own = own.withColumn("unit", unit(F.col("cell"), F.col("slot"))).select(*self._columns())
        self._sizes = self._counted(own, F.max("slot") + 1)
        self._parts, self._gone = [Part(own, own.select("id", "cell", "slot"), 0, np.zeros(self.n_cells, np.int64), self._sizes)], []

    def _columns(self) -> list[str]:
        return ["id", "cell", "slot", "unit", *self._fields()]

    def _counted(self, rows: DataFrame, what: Column) -> np.ndarray:
        sizes = np.zeros(self.n_cells, np.int64)
        for r in rows.groupBy("cell").agg(what.alias("n")).collect():  # one row a cell
            sizes[r["cell"]] = r["n"]
        return sizes

    def _per_cell(self, spark, **values: np.ndarray) -> DataFrame:
        """cell and a column of numbers for each name: one row a cell."""
        return spark.createDataFrame(list(enumerate(zip(*(v.tolist() for v in values.values()), strict=True))), f"cell int, v struct<{', '.join(f'{n}: long' for n in values)}>").select("cell", "v.*")

    def _put(self, rows: DataFrame, n: int, low: np.ndarray, high: np.ndarray, path: str | None = None, reach: np.ndarray | None = None) -> Part:
        """Writes rows, n of them: codes bucketed by unit and the inverse map bucketed by id, with a bucket for about BUCKET
        rows."""
        spark = rows.sparkSession
        own, buckets = None if path else scratch.folder(spark), 8
        path = path or own
        while buckets * BUCKET < n:
            buckets *= 2
        rows = rows.withColumn("unit", unit(F.col("cell"), F.col("slot"))).select(*self._columns())
        codes = persist.write_bucketed(rows, f"{path}/codes", persist.Bucketed("unit", ["unit", "slot"], buckets))
        ids = persist.write_bucketed(codes.select("id", "cell", "slot"), f"{path}/ids", persist.Bucketed("id", ["id"], buckets))
        return Part(codes, ids, buckets, low, high, own, reach)

    def add(self, df: DataFrame) -> DataFrame:
        """Appends vectors (id, vec) and returns their codes and addresses: id, cell, slot, code. Slots of a cell go on from
        its last, in the order of id."""
        placed = store.numbered(self._encoded(df), ["cell", "id"], "n")
        sizes, reach = np.zeros(self.n_cells, np.int64), np.zeros(self.n_cells)
        for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect():  # one row a cell
            sizes[r["cell"]], reach[r["cell"]] = r["n"], r["far"]
        first = self._per_cell(df.sparkSession, shift=self._sizes - (np.cumsum(sizes) - sizes))
        placed = placed.join(first, "cell").withColumn("slot", F.col("n") + F.col("shift"))
        part = self._put(placed, int(sizes.sum()), self._sizes, self._sizes + sizes, reach=reach)
        self._sizes = self._sizes + sizes
        self._parts.append(part)
        return part.codes.drop("unit")

    def remove(self, ids: DataFrame) -> None:
        """Removes the rows that these ids (id) have now."""
        found = self.addresses(ids).select(unit(F.col("cell"), F.col("slot")).alias("unit"), "slot")
        self._gone.append(scratch.cut(found))

    def addresses(self, ids: DataFrame) -> DataFrame:
        """id, cell, slot of every row that these ids (id) have: a look-up in the inverse map, which is not moved."""
        ids = ids.select(F.col("id").cast("long").alias("id")).distinct()
        return self._lookup(lambda part: part.join(ids, "id", "left_semi"))

    def locate(self, *ids: int) -> DataFrame:
        """As addresses, for a few given ids: of the inverse map, their buckets alone are read."""
        return self._lookup(lambda part: part.where(F.col("id").isin(*ids)))

    def _lookup(self, f) -> DataFrame:
        return self._living([f(p.ids).withColumn("unit", unit(F.col("cell"), F.col("slot"))) for p in self._parts], ["unit", "slot"]).select("id", "cell", "slot")

    def compact(self, purge: bool = False) -> None:
        """Writes the living rows anew, in one part at their old addresses, and forgets what was removed. purge: deletes what
        adds had stored; results that were not computed before cannot be any more."""
        n, old = sum(int((p.high - p.low).sum()) for p in self._parts), self._parts
        self._parts, self._gone = [self._put(self.rows, n, np.zeros(self.n_cells, np.int64), self._sizes, reach=self._reach())], []
        for path in [p.path for p in old if p.path] if purge else []:
            scratch.remove(self._parts[0].codes.sparkSession, path)

    def _reach(self) -> np.ndarray | None:
        """How far decoded codes are from their cell's centroid at most, over all parts."""
        parts = [p.reach for p in self._parts]
        return None if any(r is None for r in parts) else np.max([np.zeros(self.n_cells), *parts], axis=0)

    def cell_starts(self, spark) -> DataFrame:
        """cell, start, capacity: an address is the cell's start and the slot."""
        return store.cell_starts(self._per_cell(spark, capacity=self._sizes))

    # search

    def probe(self, queries: DataFrame) -> DataFrame:
        """q_id, rank, cell, score of the cells that each query (q_id, q_vec) will search."""
        q = self._plain(queries, "q_id", "q_vec")
        probes = nearest_cells(self._mapped(q, lambda x: x) if self.distance == "cosine" else q, self.vq.codebook, self.n_probe)
        return smart_probes(probes, min(self.n_probe, self.n_cells), self.temperature) if self.use_smart_probing else probes

    def search(self, queries: DataFrame, k: int = 1, pad: bool = False, return_address: bool = False) -> DataFrame:
        """q_id, rank, id, score and, if asked for, cell and slot."""
        found = self.search_cells(queries, self.probe(queries), k, return_address)
        return padded(found, queries, k) if pad else found

    def search_cells(self, queries: DataFrame, probes: DataFrame, k: int = 1, return_address: bool = False) -> DataFrame:
        """As search, in the cells that probes (q_id, cell) lists."""
        found = self._first(queries, probes, k)
        return found.select("q_id", "rank", "id", "score", *(["cell", "slot"] if return_address else []))

    def _first(self, queries: DataFrame, probes: DataFrame, k: int, *more: str) -> DataFrame:
        reach = self._reach() if self.bounded else None
        if reach is None:
            return self._scanned(queries, probes, k, *more)
        seen, rest = self._bounded(queries, probes, k, reach, more)
        both = seen.drop("rank").unionByName(self._scanned(queries, rest, k, *more).drop("rank"))
        return top_k(both, k, ["q_id"], "_s")

    def _bounded(self, queries: DataFrame, probes: DataFrame, k: int, reach: np.ndarray, more: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
        """What each query's nearest probed cell has, and the other probes that may better it. The table of scores has a row
        a probe; centroids go to the tasks, as in `probe`."""
        book, kind = self.vq.codebook, self.score_metric
        full = np.any([p.high > p.low for p in self._parts], axis=0) if self._parts else np.zeros(self.n_cells, bool)

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in it:
                x, at = usable(b.column("v"), book.shape[1])
                x, cell = self._ready(x), b.column("cell").to_numpy()[at]
                near, r = M.direct(kind, x, book[cell]), reach[cell]
                if kind == "inner":
                    most = near + np.sqrt((x * x).sum(1)) * r
                else:
                    gap = np.maximum(self._apart(x, book[cell]) - r, 0)
                    most = -gap if kind == "manhattan" else -gap * gap
                wide = 1e-8 * (1 + np.abs(near) + (x * x).sum(1) + r * r)  # more than rounding moves a score
                keep = full[cell]
                yield pa.RecordBatch.from_arrays([b.column("q_id").take(pa.array(at[keep])), pa.array(cell[keep], pa.int32()), pa.array(near[keep]), pa.array((most + wide)[keep])], names=["q_id", "cell", "near", "most"])

        q = self._plain(queries, "q_id", "q_vec").select(F.col("id").alias("q_id"), F.col("vec").alias("v"))
        asked = probes.select("q_id", F.col("cell").cast("int").alias("cell")).distinct().join(q, "q_id")
        scores = asked.mapInArrow(run, "q_id long, cell int, near double, most double")
        scores = scratch.cut(scores.groupBy("q_id", "cell").agg(F.max("near").alias("near"), F.max("most").alias("most")))
        first = scratch.cut(top_1(scores.select("q_id", "cell", "near"), ["q_id"], "near", "cell"))
        seen = scratch.cut(self._scanned(queries, first, k, *more))
        least = seen.where(F.col("rank") == k).select("q_id", F.col("_s").alias("least"))
        rest = scores.join(first, ["q_id", "cell"], "left_anti").join(least, "q_id", "left")
        return seen, rest.where(F.col("least").isNull() | (F.col("most") >= F.col("least"))).select("q_id", "cell")

    def _scanned(self, queries: DataFrame, probes: DataFrame, k: int, *more: str) -> DataFrame:
        q = self._plain(queries, "q_id", "q_vec").select(F.col("id").alias("q_id"), F.col("vec").alias("v"))
        probes = scratch.cut(probes.select("q_id", F.col("cell").cast("int").alias("cell")).distinct())
        most = probes.groupBy("cell").count().agg(F.max("count")).first()[0] or 0
        turns = max(1, -(-most // max(1, min(ASKING, GIVEN // (k + SLACK)))))  # a unit meets, and gives, a bounded number at once
        probed = [r["cell"] for r in probes.select("cell").distinct().limit(NAMED + 1).collect()]
        schema = ", ".join(["q_id long, id long, cell int, slot long, score double", *(f"{f} binary" for f in more)])
        found = []
        for part in self._parts:
            some = part.high > part.low
            span = self._per_cell(q.sparkSession, low=np.where(some, part.low // PIECE, 0), high=np.where(some, (part.high - 1) // PIECE, -1)).where("low <= high")
            asked = probes.join(span, "cell").select("q_id", "cell", F.explode(F.sequence("low", "high")).alias("piece"))
            asked = asked.select("q_id", (F.shiftleft(F.col("cell").cast("long"), 32) + F.col("piece")).alias("unit")).join(q, "q_id")
            right = part.codes.where(F.col("cell").isin(probed)) if len(probed) <= NAMED else part.codes
            if len(probed) <= NAMED and sum(int(part.high[c] > part.low[c]) * (int(part.high[c] - 1) // PIECE + 1) for c in probed) <= NAMED:
                right = right.where(F.col("unit").isin([c << 32 | i for c in probed if some[c] for i in range(int(part.low[c]) // PIECE, (int(part.high[c]) - 1) // PIECE + 1)]))
            right = right.select("unit", "id", "slot", *self._fields()).groupBy("unit")
            for turn in range(turns):
                left = asked.where(F.pmod(F.xxhash64("q_id"), F.lit(turns)) == turn).select("unit", "q_id", "v", F.lit(None).cast("long").alias("dead"))
                if self._gone:
                    dead = self._dead().join(probes.select("cell").distinct(), "cell", "left_semi")
                    left = left.unionByName(dead.select("unit", F.lit(None).cast("long").alias("q_id"), F.lit(None).cast("array<double>").alias("v"), F.col("slot").alias("dead")))
                found.append(left.groupBy("unit").cogroup(right).applyInArrow(self._scan(k, more), schema))
        if not found:
            return q.sparkSession.createDataFrame([], f"{schema}, _s double, rank int")
        every = found[0]
        for one in found[1:]:
            every = every.unionByName(one)
        return top_k(every.withColumn("_s", F.round("score", 9)), k, ["q_id"], "_s")

    def _scan(self, k: int, more: tuple[str, ...]):
        fields, width = self._fields(), self.vq.codebook.shape[1]
        schema = pa.schema([("q_id", pa.int64()), ("id", pa.int64()), ("cell", pa.int32()), ("slot", pa.int64()), ("score", pa.float64()), *((f, pa.binary()) for f in more)])

        def run(key, left, right):
            dead = left["dead"].drop_null().to_numpy()
            asking = left.filter(left["q_id"].is_valid())
            q, own = usable(asking["v"], width) if asking.num_rows and right.num_rows else (np.zeros((0, 0)), np.zeros(0, np.int64))
            if len(own) and len(dead):
                right = right.filter(pa.array(~np.isin(right["slot"].to_numpy(), dead)))
            if not len(own) or not right.num_rows:
                return schema.empty_table()
            right, cell = right.combine_chunks(), key[0].as_py() >> 32
            ids, packed, out = right["id"].to_numpy(), self.pq.raw(right[fields[0]].combine_chunks()), []
            q = self._ready(q) - (self.vq.codebook[cell] if self.residual else 0)
            step = max(1, LOOKED // max(len(ids), self.pq.m * self.pq.codebook.shape[1]))
            for i in range(0, len(q), step):
                s = self.pq.scan(self.pq.adc(q[i : i + step]), packed)
                rows, cols = best_rows(np.round(s, 12), ids, k + SLACK)
                out.append((i + rows, cols, s[rows, cols]))
            rows, cols, score = (np.concatenate(x) for x in zip(*out, strict=True))
            hit = right.take(pa.array(cols))
            return pa.table([pa.array(asking["q_id"].to_numpy()[own[rows]]), hit["id"], pa.array(np.full(len(rows), cell), pa.int32()), hit["slot"], pa.array(score), *(hit[f] for f in more)], schema=schema)

        return run

    def _similarity(self, queries: DataFrame, pairs: DataFrame, on: list[str]) -> DataFrame:
        """Pairs meet the codes, which are decoded where they are scored: neither carries a vector through the shuffle."""
        q = self._mapped(self._plain(queries, "q_id", "q_vec"), lambda x: x).select(F.col("id").alias("q_id"), F.col("vec").alias("q_vec"))
        met = pairs.select("q_id", *on).join(self.rows.select("id", "cell", "slot", "code"), on)
        near = lambda b: self._near(b.column("cell").to_numpy(), [b.column("code")])
        return listed_product(met, q, near, "code" if "cell" in on else "cell code", ", ".join(f"{c} {'int' if c == 'cell' else 'long'}" for c in on), self.score_metric)

    def similarity_at_id(self, queries: DataFrame, pairs: DataFrame) -> DataFrame:
        """q_id, id, score of given pairs (q_id, id); unknown ids are absent."""
        return self._similarity(queries, pairs, ["id"]).select("q_id", "id", "score")

    def similarity_at_address(self, queries: DataFrame, pairs: DataFrame) -> DataFrame:
        """q_id, cell, slot, score of given pairs (q_id, cell, slot); addresses without an entry are absent."""
        return self._similarity(queries, pairs.withColumn("cell", F.col("cell").cast("int")), ["cell", "slot"])

    # on disk

    def _settings(self) -> dict:
        own = {"n_subvectors": self.pq.m, "n_cells": self.n_cells, "distance": self.distance, "residual": self.residual, "n_pq_clusters": int(self.pq.codebook.shape[1]), "packed": self.pq.packed}
        return {"kind": type(self).__name__, "new": own, "n_probe": self.n_probe, "use_smart_probing": self.use_smart_probing, "temperature": self.temperature, "bounded": self.bounded}

    def _arrays(self) -> dict[str, np.ndarray]:
        return {"centroids": self.vq.codebook, "codebook": self.pq.codebook, "sizes": self._sizes} | ({} if self._reach() is None else {"reach": self._reach()})

    def _restore(self, arrays: dict[str, np.ndarray]) -> None:
        self.set_codebooks(arrays["centroids"], arrays["codebook"])

    def save(self, path: str, spark) -> None:
        """A new version of the index at path: the living rows, the inverse map and the codebooks. The index goes on with it.
        Readers of the version before are not disturbed (of older ones see `persist`)."""
        n, new = sum(int((p.high - p.low).sum()) for p in self._parts), []

        def write(folder: str) -> dict[str, tuple[DataFrame, persist.Bucketed]]:
            part = self._put(self.rows, n, np.zeros(self.n_cells, np.int64), self._sizes, folder, self._reach())
            new.append(part)
            return {"codes": (part.codes, persist.Bucketed("unit", ["unit", "slot"], part.buckets)), "ids": (part.ids, persist.Bucketed("id", ["id"], part.buckets))}

        persist.save(path, spark, self._settings(), self._arrays(), write)
        self._parts, self._gone = new, []

    @classmethod
    def load(cls, path: str, spark) -> IVFPQIndex:
        """The newest version of an index of this class, or of a subclass, as which it answers."""
        settings, arrays, tables = persist.load(path, spark)
        kinds = {c.__name__: c for c in (IVFPQIndex, IVFPQRIndex)}
        kind = kinds.get(settings.get("kind"))
        if kind is None or not issubclass(kind, cls):
            raise TypeError(f"{path} holds a {settings.get('kind')}, not a {cls.__name__}")
        index = kind(**settings["new"])
        index._restore(arrays)
        index.n_probe, index.use_smart_probing, index.temperature = settings["n_probe"], settings["use_smart_probing"], settings["temperature"]
        index.bounded = settings.get("bounded", False)
        index._sizes = arrays["sizes"].astype(np.int64)
        index._parts = [Part(tables["codes"].select(*index._columns()), tables["ids"], 0, np.zeros(index.n_cells, np.int64), index._sizes, reach=arrays.get("reach"))]
        return index


class IVFPQRIndex(IVFPQIndex):
    """IVF-PQ whose first k x factor hits are scored again by a second code of what the first leaves over."""

    def __init__(self, n_subvectors: int = 8, n_rerank: int = 8, n_cells: int = 128, rerank_factor: int = 2, n_pq_clusters: int = 256, **options) -> None:
        super().__init__(n_subvectors, n_cells, n_pq_clusters=n_pq_clusters, **options)
        self.factor = rerank_factor
        self.fine = PQCodec(n_rerank, n_pq_clusters, max_iter=25)

    def _settings(self) -> dict:
        own = super()._settings()
        return own | {"new": own["new"] | {"n_rerank": self.fine.m, "rerank_factor": self.factor}}

    def _arrays(self) -> dict[str, np.ndarray]:
        return super()._arrays() | {"fine": self.fine.codebook}

    def _restore(self, arrays: dict[str, np.ndarray]) -> None:
        super()._restore(arrays)
        self.fine = PQCodec(self.fine.m, arrays["fine"].shape[1], codebook=arrays["fine"])

    def train(self, df: DataFrame, force_retrain: bool = False) -> None:
        super().train(df, force_retrain)
        if force_retrain or not self.fine.is_trained:
            self.fine.train(self.left_over(df))

    def left_over(self, df: DataFrame) -> DataFrame:
        """(id, vec) less what its first code stands for."""
        book, first = self.vq.codebook, super()._coded

        def less(x: np.ndarray) -> np.ndarray:
            cell = nearest("euclidean", x, book)[1]
            return x - self._near(cell, first(x, cell))

        return self._mapped(self._plain(df), less, book.shape[1])

    def _fields(self) -> list[str]:
        return ["code", "fine"]

    def _coded(self, x: np.ndarray, cell: np.ndarray) -> list[pa.Array]:
        first = super()._coded(x, cell)
        return [*first, self.fine.pack(self.fine.codes(x - self._near(cell, first)))]

    def search_cells(self, queries: DataFrame, probes: DataFrame, k: int = 1, return_address: bool = False) -> DataFrame:
        metric = "inner" if self.distance == "cosine" else self.distance
        first = self._first(queries, probes, k * self.factor, *self._fields())
        q = self._plain(queries, "q_id", "q_vec").select(F.col("id").alias("q_id"), F.col("vec").alias("v"))

        def again(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in it:
                near = self._near(b.column("cell").to_numpy(), [b.column("code")]) + self.fine.decoded(self.fine.unpack(b.column("fine")))
                score = M.direct(metric, self._ready(to_matrix(b.column("v"))), near) if b.num_rows else np.zeros(0)
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("q_id", "id", "cell", "slot")), pa.array(score)], names=["q_id", "id", "cell", "slot", "score"])

        pairs = first.join(q, "q_id").select("q_id", "id", "cell", "slot", "code", "fine", "v")
        found = pairs.mapInArrow(again, "q_id long, id long, cell int, slot long, score double")
        found = top_k(found.withColumn("_s", F.round("score", 9)), k, ["q_id"], "_s")
        return found.select("q_id", "rank", "id", "score", *(["cell", "slot"] if return_address else []))


class FlatIndex:
    """Exact search over a store (address, id, vec); addresses are dense, in the order of addition and of id."""

    def __init__(self, distance: str = "euclidean") -> None:
        self.distance, self.data = M.canonical(distance), None

    def add(self, df: DataFrame, return_address: bool = False) -> DataFrame | None:
        """Appends vectors (id, vec); their id and address, if asked for."""
        own = df.select(F.col("id").cast("long").alias("id"), M.doubles("vec").alias("vec"))
        old = own.limit(0).select(F.col("id").alias("address"), "id", "vec") if self.data is None else self.data
        self.data = store.flat_add(old, own)
        return self.data.join(own.select("id").distinct(), "id", "left_semi").select("id", "address") if return_address else None

    def remove(self, ids: DataFrame) -> None:
        self.data = self.data.join(ids.select("id").distinct(), "id", "left_anti")

    def search(self, queries: DataFrame, k: int = 1, pad: bool = False, return_address: bool = False) -> DataFrame:
        """q_id, rank, id, score and, if asked for, address. Rows that repeat an id have addresses of their own."""
        if return_address:  # a row is found by its address, which names it; ties go to the smaller address then
            by_address = knn(self.data.select(F.col("address").alias("id"), "vec"), queries, k, self.distance).withColumnRenamed("id", "address")
            found = by_address.join(self.data.select("address", "id"), "address").select("q_id", "rank", "id", "score", "address")
        else:
            found = knn(self.data, queries, k, self.distance)
        return padded(found, queries, k) if pad else found


__all__ = ["FlatIndex", "IVFPQIndex", "IVFPQRIndex", "KMeans", "smart_probes"]
