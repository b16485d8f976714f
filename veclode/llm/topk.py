"""Exact top-k search: tiled matrix products, partial selection per tile, tree merging of top lists.

Vectors are quantised to integers by built-in functions. Query blocks and candidate shards, both of bounded
size, form a grid; a task multiplies one block by one shard, in steps of a few rows, and keeps each query's k
best of the shard. The lists are merged in a tree of fixed fan-in, so no task ever sees more than
fan-in x k rows of a query. Products are exact: float32 while every partial sum fits in 2^24, float64 up to
2^53, Python integers beyond.

Defined cases: vectors that are null, or hold null or non-finite components, take no part, nor does one
whose width differs from the query's (an empty vector meets empty ones alone); ties go to the smaller vec_id; a
vec_id never finds itself; rows that repeat a vec_id are candidates and queries of their own, each query row with a
list of its own, so the list of a row that repeats vec_id and vector is repeated; a score beyond 64 bits is ranked by
its exact value and shown as the nearest 64-bit number; an empty table, or one without queries, gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

QUERY_BLOCK, SHARD, FAN_IN, STEP = 2048, 8192, 16, 128
_OUT = pa.schema([("query_id", pa.int64()), ("q1", pa.int64()), ("q2", pa.int64()), ("shard", pa.int32()), ("vec_id", pa.int64()), ("score", pa.decimal128(38, 0))])
_TOP = (1 << 63) - 1


def quantised(vectors: DataFrame, scale: float = 64.0) -> DataFrame:
    """vec_id, v (array<bigint>) of the vectors that take part."""
    x = F.col("embedding")
    good = x.isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    v = F.transform(x, lambda e: F.floor(F.lit(scale) * e.cast("double")))
    return vectors.where(good & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def _matrix(t: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray]:
    t = t.combine_chunks()
    ids, v = t.column("vec_id").to_numpy(), t.column("v").combine_chunks()
    return ids, v.flatten().to_numpy().reshape(len(ids), width)


def best(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k highest scores of each row, ties to the smaller id. ids ascend; own: each row's id."""
    n = len(ids)
    key = scores * n + np.arange(n - 1, -1, -1)  # unique in a row: the score, then the smaller id
    left, right = np.searchsorted(ids, own), np.searchsorted(ids, own, "right")
    low = np.iinfo(np.int64).min
    for r in np.flatnonzero(left < right):
        key[r, left[r] : right[r]] = low
    k = min(k, n)
    cols = np.argpartition(key, n - k, axis=1)[:, n - k :]
    rows = np.repeat(np.arange(len(key)), k)
    cols = cols.ravel()
    real = key[rows, cols] != low
    return rows[real], cols[real]


def _tile(k: int):
    def run(key, left, right):
        out = []
        if left.num_rows and right.num_rows:
            width = key[0].as_py()
            (qid, q), (cid, c) = _matrix(left, width), _matrix(right, width)
            q1, q2 = left["q1"].to_numpy(), left["q2"].to_numpy()
            order = np.argsort(cid, kind="stable")
            cid, c = cid[order], c[order]
            bound = float(np.abs(q.astype(float)).max(initial=0)) * float(np.abs(c.astype(float)).max(initial=0)) * width
            kind = np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else object
            ct = c.T.astype(kind)
            for i in range(0, len(q), STEP):
                s = q[i : i + STEP].astype(kind) @ ct if width else np.zeros((len(q[i : i + STEP]), len(cid)), np.int64)
                if kind is object or bound * len(cid) >= 2**62:
                    picks = [sorted((-int(x), int(d), j) for j, (x, d) in enumerate(zip(row, cid, strict=True)) if d != o)[:k] for row, o in zip(s, qid[i : i + STEP], strict=True)]
                    rows, cols = np.array([r for r, p in enumerate(picks) for _ in p], int), np.array([j for p in picks for _, _, j in p], int)
                else:
                    s = s.astype(np.int64)
                    rows, cols = best(s, cid, qid[i : i + STEP], k)
                out.append((qid[i + rows], q1[i + rows], q2[i + rows], cid[cols], s[rows, cols]))
        query, q1, q2, ids, score = (np.concatenate(x) for x in zip(*out, strict=True)) if out else [np.zeros(0, np.int64)] * 5
        score = pa.array([int(x) for x in score], pa.decimal128(38, 0)) if score.dtype == object else pa.array(score.astype(np.int64)).cast(pa.decimal128(38, 0))
        return pa.table([query, q1, q2, np.full(len(ids), key[-1].as_py(), np.int32), ids, score], schema=_OUT)

    return run


def exact_topk(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score, one list for each row of queries. Both tables: vec_id, v (integers)."""
    vectors = vectors.withColumn("d", F.size("v"))
    queries = queries.groupBy("vec_id", F.xxhash64("v").alias("q1"), F.xxhash64(F.lit(1), "v").alias("q2")).agg(F.min("v").alias("v"), F.count("*").alias("copies")).withColumn("d", F.size("v"))
    n, m = vectors.count(), queries.count()
    shards, blocks = max(1, -(-n // SHARD)), max(1, -(-m // QUERY_BLOCK))
    spread = lambda size, *cols: F.pmod(F.xxhash64(*cols), F.lit(size)).cast("int")
    every = lambda size: F.explode(F.sequence(F.lit(0), F.lit(size - 1)))
    row = ["query_id", "q1", "q2"]
    left = queries.drop("copies").withColumn("block", spread(blocks, "vec_id", "q1")).withColumn("shard", every(shards)).groupBy("d", "block", "shard")
    right = vectors.withColumn("shard", spread(shards, "vec_id", "v")).withColumn("block", every(blocks)).groupBy("d", "block", "shard")
    lists = left.cogroup(right).applyInArrow(_tile(k), "query_id long, q1 long, q2 long, shard int, vec_id long, score decimal(38,0)")
    packed = F.struct((-F.col("score")).alias("s"), F.col("vec_id").alias("id"))
    merged = F.slice(F.array_sort(F.flatten(F.collect_list("top"))), 1, k).alias("top")
    lists = lists.groupBy(*row, "shard").agg(F.slice(F.array_sort(F.collect_list(packed)), 1, k).alias("top"))
    while shards > 1:
        shards = -(-shards // FAN_IN)
        lists = lists.withColumn("shard", F.floor(F.col("shard") / FAN_IN).cast("int")).groupBy(*row, "shard").agg(merged)
    again = queries.where("copies > 1").select(F.col("vec_id").alias("query_id"), "q1", "q2", "copies")
    lists = lists.join(again, row, "left").select("query_id", "top", F.explode(F.sequence(F.lit(1).cast("long"), F.coalesce("copies", F.lit(1).cast("long")))))
    score = F.greatest(F.least(-F.col("x.s"), F.lit(_TOP).cast("decimal(38,0)")), F.lit(-_TOP).cast("decimal(38,0)")).cast("long")
    return lists.select("query_id", F.posexplode("top").alias("pos", "x")).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), score.alias("score"))


def search(embeddings: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """The k best others for each vector whose vec_id is divisible by `every`."""
    vectors = cut(quantised(embeddings))
    return exact_topk(vectors, vectors.where(F.col("vec_id") % every == 0), k)
