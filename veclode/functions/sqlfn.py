"""Vector functions for SQL: vec_l2, vec_dot, vec_cosine, vec_l1, vec_normalize, pq_encode, pq_decode, the table function
knn_partial, whose lists `knn` merges, and the table functions vec_knn, of many queries and any metric, and vec_pairs, of all pairs.

vec_knn(TABLE(SELECT is_query, id, vec, ... FROM rows) PARTITION BY ... ORDER BY (is_query DESC), k, metric) gives q_id, id, score:
for each query of a piece (the rows of one PARTITION BY key) the k most similar base vectors of the piece. Rows come in Arrow
batches; such functions have no `analyze` in this version of Spark, so columns and arguments are checked when the first
batch comes, and base vectors before queries are an error. `knn_statement` writes the SQL around it: what is put into
pieces, and the lists of all pieces ranked.

Defined cases of vec_knn: a row whose is_query or id is null and a vector that is null or holds a null or non-finite
element take no part; a query meets the base vectors of its own width; repeated ids are rows of their own, as queries they
share a list once knn_statement has ranked it; ties go to the smaller id; other columns are not read; an
empty table gives no rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import metrics as M
from .arrow import best_rows, usable, widths

_PAIR = "CREATE OR REPLACE TEMPORARY FUNCTION {name}(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN {body}"
_SUM = "aggregate(zip_with(a, b, (x, y) -> {0}), 0.0D, (s, x) -> s + x)"
# The norm is an element of an array, so that it is computed once a vector and not once an element.
_UNIT = "get(transform(array(sqrt(aggregate({0}, 0.0D, (s, y) -> s + y * y)) + {1}), n -> transform({0}, x -> x / n)), 0)"


def register(spark: SparkSession) -> None:
    """Makes the functions of expressions known to this session; similarities, larger is better."""
    pairs = {
        "vec_l2": "0.0D - " + _SUM.format("(x - y) * (x - y)"),
        "vec_dot": _SUM.format("x * y"),
        "vec_l1": "0.0D - " + _SUM.format("abs(x - y)"),
        "vec_cosine": _SUM.replace("zip_with(a, b", f"zip_with({_UNIT.format('a', '1e-8D')}, {_UNIT.format('b', '1e-8D')}").format("x * y"),
    }
    for name, body in pairs.items():
        spark.sql(_PAIR.format(name=name, body=body))
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION vec_normalize(a ARRAY<DOUBLE>) RETURNS ARRAY<DOUBLE> RETURN {_UNIT.format('a', '1e-9D')}")


def register_pq(spark: SparkSession, codec) -> None:
    """pq_encode(vec) -> binary and pq_decode(code) -> array<double> with a trained product quantizer."""

    @F.pandas_udf("binary")
    def encode(v: pd.Series) -> pd.Series:
        return pd.Series(codec.pack(codec.codes(np.array(v.tolist(), float))).to_pylist())

    @F.pandas_udf("array<double>")
    def decode(c: pd.Series) -> pd.Series:
        return pd.Series(list(codec.decoded(codec.unpack(pa.array(c, pa.binary())))))

    spark.udf.register("pq_encode", encode)
    spark.udf.register("pq_decode", decode)


@F.arrow_udtf(returnType="id bigint, score double")
class _KnnPartial:
    """knn_partial(TABLE(vectors), query as JSON, k): the k nearest of each partition of the table, by Arrow batches."""

    def __init__(self) -> None:
        self.ids, self.scores, self.k = np.zeros(0, np.int64), np.zeros(0), 0

    def eval(self, batch: pa.RecordBatch, query: pa.Array, k: pa.Array) -> Iterator[pa.Table]:
        q = np.array([json.loads(query[0].as_py())], float)
        self.k = k[0].as_py()
        x, at = usable(batch.column("vec"), q.shape[1])
        self.ids = np.concatenate([self.ids, batch.column("id").to_numpy(zero_copy_only=False)[at]])
        self.scores = np.concatenate([self.scores, M.direct("euclidean", np.broadcast_to(q, x.shape), x)])
        best = np.lexsort((self.ids, -self.scores))[: self.k]
        self.ids, self.scores = self.ids[best], self.scores[best]
        yield from ()

    def terminate(self) -> Iterator[pa.Table]:
        yield pa.table({"id": pa.array(self.ids, pa.int64()), "score": self.scores})


def register_knn(spark: SparkSession) -> None:
    spark.udtf.register("knn_partial", _KnnPartial)


def knn(spark: SparkSession, view: str, query: list[float], k: int) -> DataFrame:
    """id, score of the k nearest of a view (id, vec) to a query: the partial lists, k rows a partition, merged."""
    register_knn(spark)
    return spark.sql(f"SELECT * FROM knn_partial(TABLE({view}), '{json.dumps(list(map(float, query)))}', {int(k)}) ORDER BY score DESC, id LIMIT {int(k)}")


#: Of knn_statement: base vectors and queries of a piece, on average. Of vec_knn: bytes of queries that a piece may hold.
SHARD, TILE, QUERY_BYTES = 8192, 4096, 256_000_000
#: Of vec_pairs: pairs that leave a task at once, pairs that are sorted at once, bytes of base vectors that wait for more.
PAIRS, SORTED, BASE_BYTES = 250_000, 8_000_000, 32_000_000
#: What a batch's selection keeps beyond k, for scores that the fast product rounds differently.
SLACK = 8


@F.arrow_udtf(returnType="q_id bigint, id bigint, score double")
class _VecKnn:
    """vec_knn; see the module. A piece's queries are kept, its base vectors stream through."""

    def __init__(self) -> None:
        #: For each width the queries' ids and vectors, as they came and joined; the best so far: query's row, id, score.
        self.coming: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.queries: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.best: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.bytes, self.met = 0, False

    def eval(self, rows: pa.RecordBatch, k: pa.Array, metric: pa.Array) -> Iterator[pa.Table]:
        n, name = k[0].as_py(), metric[0].as_py()
        if not {"is_query", "id", "vec"} <= set(rows.schema.names) or rows.schema.field("is_query").type != pa.bool_():
            raise ValueError("vec_knn: the table has no columns is_query (boolean), id and vec")
        if n is None or n < 1 or name is None:
            raise ValueError("vec_knn: k is 1 or more, and neither it nor the metric is null")
        M.canonical(name)
        rows = rows.filter(pc.and_(rows.column("is_query").is_valid(), rows.column("id").is_valid()))
        asks = rows.column("is_query")
        if self.met and pc.any(asks).as_py():
            raise ValueError("vec_knn: queries come first; say ORDER BY is_query DESC")
        for query in (True, False):
            part = rows.filter(asks if query else pc.invert(asks))
            self.met |= not query and part.num_rows > 0
            for w in widths(part.column("vec")):
                x, at = usable(part.column("vec"), w)
                ids = part.column("id").cast(pa.int64()).to_numpy()[at]
                if query and len(x):
                    self.bytes += x.nbytes
                    if self.bytes > QUERY_BYTES:
                        raise ValueError(f"vec_knn: the queries of a piece exceed {QUERY_BYTES} bytes; deal them into more pieces")
                    self.coming.setdefault(w, []).append((ids, x))
                elif len(x):
                    self._meet(w, ids, x, n, name)
        yield from ()

    def _meet(self, w: int, ids: np.ndarray, x: np.ndarray, k: int, metric: str) -> None:
        if w in self.coming:  # queries come first, so this is done once a width
            own = self.coming.pop(w)
            self.queries[w] = np.concatenate([i for i, _ in own]), np.concatenate([v for _, v in own])
        if w not in self.queries:
            return
        q = self.queries[w][1]
        step = max(1, 4_000_000 // (len(ids) * (w if M.canonical(metric) == "manhattan" else 1) or 1))
        found = [self.best[w]] if w in self.best else []
        for i in range(0, len(q), step):
            r, c = best_rows(np.round(M.matrix(metric, q[i : i + step], x), 12), ids, k + SLACK)
            found.append((i + r, ids[c], M.direct(metric, q[i + r], x[c])))
        row, id_, score = (np.concatenate(c) for c in zip(*found, strict=True))
        order = np.lexsort((id_, -np.round(score, 9), row))
        place = np.arange(len(row)) - np.searchsorted(row[order], row[order])
        order = order[place < k]
        self.best[w] = row[order], id_[order], score[order]

    def terminate(self) -> Iterator[pa.Table]:
        for w, (row, id_, score) in self.best.items():
            yield pa.table({"q_id": pa.array(self.queries[w][0][row], pa.int64()), "id": pa.array(id_, pa.int64()), "score": pa.array(score, pa.float64())})


def register_vec_knn(spark: SparkSession) -> None:
    spark.udtf.register("vec_knn", _VecKnn)


@F.arrow_udtf(returnType="q_id bigint, id bigint, score double")
class _VecPairs:
    """vec_pairs(TABLE(is_query, id, vec, ...) PARTITION BY ... ORDER BY (is_query DESC), metric): every query of a piece with
    every base vector of it. Defined cases as of vec_knn.

    Pairs leave in the order of their scores, so many at once: what is equal once it is rounded is stored side by side, and
    a table of all pairs, which nothing else makes smaller, takes about half the disk."""

    def __init__(self) -> None:
        #: For each width the ids and vectors of the queries, as they came, and of the base vectors that wait.
        self.coming: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.waiting: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.bytes, self.met, self.metric = 0, False, ""

    def eval(self, rows: pa.RecordBatch, metric: pa.Array) -> Iterator[pa.Table]:
        self.metric = M.canonical(metric[0].as_py())
        rows = rows.filter(pc.and_(rows.column("is_query").is_valid(), rows.column("id").is_valid()))
        asks = rows.column("is_query")
        if self.met and pc.any(asks).as_py():
            raise ValueError("vec_pairs: queries come first; say ORDER BY is_query DESC")
        for query in (True, False):
            part = rows.filter(asks if query else pc.invert(asks))
            self.met |= not query and part.num_rows > 0
            for w in widths(part.column("vec")):
                x, at = usable(part.column("vec"), w)
                ids = part.column("id").cast(pa.int64()).to_numpy()[at]
                if query:
                    self.bytes += x.nbytes
                    if self.bytes > QUERY_BYTES:
                        raise ValueError(f"vec_pairs: the queries of a piece exceed {QUERY_BYTES} bytes; deal them into more pieces")
                    self.coming.setdefault(w, []).append((ids, x))
                elif w in self.coming and len(ids):
                    self.waiting.setdefault(w, []).append((ids, x))
                    if sum(i.nbytes + v.nbytes for i, v in self.waiting[w]) >= BASE_BYTES:
                        yield from self._meet(w)

    def terminate(self) -> Iterator[pa.Table]:
        for w in list(self.waiting):
            yield from self._meet(w)

    def _meet(self, w: int) -> Iterator[pa.Table]:
        (qid, q), (ids, x) = (tuple(np.concatenate(c) for c in zip(*own, strict=True)) for own in (self.coming[w], self.waiting.pop(w)))
        self.coming[w] = [(qid, q)]
        step = max(1, SORTED // len(ids))
        for i in range(0, len(q), step):
            s = M.each_pair(self.metric, q[i : i + step], x).ravel()
            order = np.argsort(s)
            for j in range(0, len(s), PAIRS):
                row, at = np.divmod(order[j : j + PAIRS], len(ids))
                yield pa.table({"q_id": qid[i + row], "id": ids[at], "score": s[order[j : j + PAIRS]]})


def register_vec_pairs(spark: SparkSession) -> None:
    spark.udtf.register("vec_pairs", _VecPairs)


def pairs_statement(base: str, queries: str, metric: str = "euclidean", shard: int = SHARD, tile: int = TILE) -> str:
    """SQL for q_id, id, score of every vector of a relation (id, vec) with each query of another (id, vec), in pieces as those
    of knn_statement."""
    M.canonical(metric)
    return f"WITH {_pieces(base, queries, shard, tile)} SELECT q_id, id, score FROM vec_pairs(TABLE(SELECT piece, is_query, id, vec FROM rows) PARTITION BY piece ORDER BY (is_query DESC), '{metric}')"


def _pieces(base: str, queries: str, shard: int, tile: int) -> str:
    """CTEs up to rows (piece, is_query, id, vec)."""
    return f"""n AS (SELECT (SELECT cast(count(*) DIV {int(shard)} + 1 AS int) FROM {base}) AS shards, (SELECT cast(count(*) DIV {int(tile)} + 1 AS int) FROM {queries}) AS blocks),
b AS (SELECT id, vec, xxhash64(monotonically_increasing_id()) AS h FROM {base}),
q AS (SELECT id, vec, xxhash64(monotonically_increasing_id()) AS h FROM {queries}),
rows AS (
  SELECT pmod(h, (SELECT shards FROM n)) * (SELECT blocks FROM n) + block AS piece, false AS is_query, id, vec
  FROM b LATERAL VIEW explode(sequence(0, (SELECT blocks FROM n) - 1)) AS block
  UNION ALL
  SELECT shard * (SELECT blocks FROM n) + pmod(h, (SELECT blocks FROM n)) AS piece, true AS is_query, id, vec
  FROM q LATERAL VIEW explode(sequence(0, (SELECT shards FROM n) - 1)) AS shard)"""


def knn_statement(base: str, queries: str, k: int, metric: str = "euclidean", shard: int = SHARD, tile: int = TILE) -> str:
    """SQL for q_id, rank, id, score: the k most similar vectors of a relation (id, vec) for each query of another (id, vec).

    The relations are dealt into about count / shard shards and count / tile blocks by their rows, not their ids, so that
    repeated ids do not gather; a piece is a shard with a block. A base vector is copied once a block, a query once a shard;
    for very many queries search.knn_join copies less."""
    M.canonical(metric)
    return f"""
WITH {_pieces(base, queries, shard, tile)},
lists AS (SELECT q_id, id, score FROM vec_knn(TABLE(SELECT piece, is_query, id, vec FROM rows) PARTITION BY piece ORDER BY (is_query DESC), {int(k)}, '{metric}')),
ranked AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY round(score, 9) DESC, id) AS rank FROM lists)
SELECT q_id, rank, id, score FROM ranked WHERE rank <= {int(k)}"""
