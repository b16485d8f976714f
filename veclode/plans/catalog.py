"""The queries of the engine's own operators over `embeddings` and `lineitem`, and the same in SQL.

Names start with the operator's id in the survey. Searches ask for every vector whose id is divisible by 50, against
all vectors. Centroids are the first 16 vectors, and codebooks the first vectors or, where a search is to find the true
neighbours, a grid of 256 values between the least and the largest of each dimension, so that SQL can say the same;
scores are rounded, since engines add up in different orders.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions import sqlfn
from ..operators import clustering, codecs, ivf, search
from ..sources import persist, scratch, store
from ..streaming import incremental

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: Vectors that an index is trained on, at most, in the order of a hash of the id.
TRAIN = 20_000

# Parts that the SQL queries share.
_L = "l as materialized (select vec_id, (i - 1)::integer pos, embedding[i]::double x from embeddings, range(1, 65) r(i))"
_PAIRS = _L + ", p as (select a.vec_id q_id, b.vec_id id, {score} score from l a join l b using (pos) where a.vec_id % 50 = 0 group by all)"
_RANKED = "r as (select *, (row_number() over (partition by q_id order by round({s}, 9) desc, id))::integer rank from {t})"
_CD = _L + ", cd as materialized (select a.vec_id, b.vec_id::integer cell, sum((a.x - b.x) * (a.x - b.x)) dd from l a join l b using (pos) where b.vec_id < 16 group by all)"
_CELLS = _CD + ", cells as materialized (select vec_id, cell, dd from (select *, row_number() over (partition by vec_id order by round(dd, 12), cell) rn from cd) where rn = 1)"


def _pq(width: int = 8, k: int = 16) -> str:
    """Sub-vectors of so many elements, coded by those of the first k vectors."""
    return (
        f"sv as (select vec_id, (pos // {width})::integer sub, pos, x from l), cb as (select vec_id::integer code, sub, pos, x c from sv where vec_id < {k})"
        ", ds as (select sv.vec_id, sv.sub, cb.code, sum((x - c) * (x - c)) dd from sv join cb on sv.sub = cb.sub and sv.pos = cb.pos group by all)"
        ", codes as materialized (select vec_id, sub, code from (select *, row_number() over (partition by vec_id, sub order by round(dd, 12), code) rn from ds) where rn = 1)"
    )


def _grid(table: str) -> str:
    """What the grid's codes of (vec_id, pos, x) stand for."""
    return (
        f"mm as (select pos, min(x) lo, max(x) hi from {table} group by pos)"
        f", dec as materialized (select vec_id, pos, lo + (least(floor((x - lo) / (hi - lo) * 256), 255) + 0.5) / 256 * (hi - lo) x from {table} join mm using (pos))"
    )


_PQ = _pq()
#: The seeds, by themselves: a join of two large tables otherwise.
_S16 = "s16 as materialized (select vec_id, pos, x from l where vec_id < 16)"
_RES = (
    _S16 + ", rv as materialized (select l.vec_id, l.pos, l.x - s.x x from l join cells using (vec_id) join s16 s on s.vec_id = cells.cell and s.pos = l.pos), "
    + _grid("rv").replace("dec as", "rd as")
    + ", dec as (select rd.vec_id, rd.pos, rd.x + s.x x from rd join cells using (vec_id) join s16 s on s.vec_id = cells.cell and s.pos = rd.pos)"
)
#: Cells that a search probes, of 16.
N_PROBE = 14
_PROBES = f", probes as (select * from (select vec_id q_id, cell, dd, row_number() over (partition by vec_id order by round(dd, 12), cell) rank from cd where vec_id % 50 = 0) where rank <= {N_PROBE})"
_ADC = ", q as (select vec_id q_id, sub, code, dd from ds where vec_id % 50 = 0)"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")


def queries_of(base: DataFrame) -> DataFrame:
    return base.where("id % 50 = 0").select(F.col("id").alias("q_id"), F.col("vec").alias("q_vec"))


def seeds(base: DataFrame, n: int = 16) -> np.ndarray:
    return np.array([r["vec"] for r in base.where(F.col("id") < n).orderBy("id").collect()])


def seed_rows(base: DataFrame) -> DataFrame:
    return base.where("id < 16").select(F.col("id").cast("int").alias("cell"), F.col("vec").alias("c"))


def pq16(base: DataFrame) -> codecs.PQCodec:
    return codecs.PQCodec(8, 16, codebook=seeds(base).reshape(16, 8, 8).transpose(1, 0, 2).copy())


def cells16(base: DataFrame) -> DataFrame:
    return clustering.assign(base, seeds(base))


def index16(base: DataFrame) -> ivf.IVFPQIndex:
    index = ivf.IVFPQIndex(8, 16, n_pq_clusters=16)
    index.set_codebooks(seeds(base), seeds(base).reshape(16, 8, 8).transpose(1, 0, 2).copy())
    index.n_probe, index.use_smart_probing = N_PROBE, False
    index.add(base)
    return index


def grid_book(df: DataFrame) -> np.ndarray:
    """[64, 256, 1]: 256 values between the least and the largest of each dimension."""
    rows = df.select(F.posexplode("vec").alias("pos", "x")).groupBy("pos").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy("pos").collect()  # one row a dimension
    return np.array([[[r["lo"] + (code + 0.5) / 256 * (r["hi"] - r["lo"])] for code in range(256)] for r in rows])


def grid_index(base: DataFrame, residual: bool = False, n_probe: int = N_PROBE, smart: bool = False, add: bool = True) -> ivf.IVFPQIndex:
    """An index fit to the extremes of all vectors."""
    index = ivf.IVFPQIndex(64, 16, residual=residual)
    index.set_codebooks(seeds(base), np.zeros((64, 256, 1)))
    index.set_codebooks(seeds(base), grid_book(index.residuals(base) if residual else base))
    index.n_probe, index.use_smart_probing = n_probe, smart
    if add:
        index.add(base)
    return index


def hits(df: DataFrame) -> DataFrame:
    return df.select("q_id", "rank", "id", r6("score").alias("score"))


def positions(df: DataFrame, v: str = "vec", value: str = "x") -> DataFrame:
    return df.select("id", F.posexplode(v).alias("pos", value)).withColumn(value, r6(value))


def flat_store(base: DataFrame) -> DataFrame:
    return base.withColumn("address", F.col("id"))


# Exact search, metrics, top-k

_SCORES = {
    "l2": "0.0 - sum((a.x - b.x) * (a.x - b.x))",
    "inner": "sum(a.x * b.x)",
    "cosine": "sum(a.x * b.x) / (sqrt(sum(a.x * a.x)) + 1e-8) / (sqrt(sum(b.x * b.x)) + 1e-8)",
    "l1": "0.0 - sum(abs(a.x - b.x))",
}


def _flat(metric: str, k: int, name: str, physical: str = "gemm") -> None:
    sql = f"with {_PAIRS.format(score=_SCORES[metric])}, {_RANKED.format(s='score', t='p')} select q_id, rank, id, round(score, 6) + 0.0 score from r where rank <= {k}"

    @query(name, sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        base = embeddings(spark, sf_dir)
        f = search.knn if physical == "gemm" else search.knn_expr
        return hits(f(base, queries_of(base), k, metric))


for _m in _SCORES:
    _flat(_m, 10, f"i1_flat_{_m}")
    _flat(_m, 10, f"j1_theta_join_{_m}", "expr")
for _k, _n in ((1, "t2_top1"), (32, "t3_top32"), (1000, "t4_top1000"), (128, "j5_nearest_k")):
    _flat("l2", _k, _n)


@query("t1_topk_any", f"with {_PAIRS.format(score=_SCORES['inner'])}, {_RANKED.format(s='score', t='p')} select q_id, rank, id, round(score, 6) + 0.0 score from r where rank <= 50")
def _topk(spark, sf_dir):
    base = embeddings(spark, sf_dir)
    pairs = search.best_pairs(base, queries_of(base), 50, "inner")
    return hits(search.top_k(pairs.withColumn("score", F.round("score", 9)), 50, ["q_id"]))


@query("t3_top1_aggregate", f"with {_PAIRS.format(score=_SCORES['l2'])}, {_RANKED.format(s='score', t='p')} select q_id, id, round(score, 6) + 0.0 score from r where rank = 1")
def _top1(spark, sf_dir):
    base = embeddings(spark, sf_dir)
    pairs = search.best_pairs(base, queries_of(base), 1).withColumn("score", F.round("score", 9))
    return search.top_1(pairs, ["q_id"]).select("q_id", "id", r6("score").alias("score"))


@query("t1_filtered_knn", f"with {_PAIRS.format(score=_SCORES['l2'])}, f as (select p.* from p join embeddings e on e.vec_id = p.id where label = 3), {_RANKED.format(s='score', t='f')} select q_id, rank, id, round(score, 6) + 0.0 score from r where rank <= 5")
def _filtered(spark, sf_dir):
    raw = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return hits(search.knn(store.vectors(raw.where("label = 3"), "vec_id", "embedding"), queries_of(embeddings(spark, sf_dir)), 5))


@query("t1_label_vote", f"with {_PAIRS.format(score=_SCORES['l2'])}, {_RANKED.format(s='score', t='p')}, c as (select q_id, label, count(*) n from r join embeddings e on e.vec_id = r.id where rank <= 10 group by all) select q_id, label from (select *, row_number() over (partition by q_id order by n desc, label) k from c) where k = 1")
def _vote(spark, sf_dir):
    base, raw = embeddings(spark, sf_dir), spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search.label_vote(search.knn(base, queries_of(base), 10), raw.select(F.col("vec_id").alias("id"), "label"))


@query("t4_padding", f"with {_PAIRS.format(score=_SCORES['l2'])}, f as (select p.* from p join embeddings e on e.vec_id = p.id where label = 3), {_RANKED.format(s='score', t='f')}, s as (select q.vec_id q_id, i::integer rank from embeddings q, range(1, 301) t(i) where q.vec_id % 50 = 0) select s.q_id, s.rank, coalesce(r.id, -1) id, coalesce(round(r.score, 6) + 0.0, '-inf'::double) score from s left join r on s.q_id = r.q_id and s.rank = r.rank")
def _padding(spark, sf_dir):
    base, some = embeddings(spark, sf_dir), spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("label = 3")
    found = search.knn(store.vectors(some, "vec_id", "embedding"), queries_of(base), 300)
    return hits(search.padded(found, queries_of(base), 300))


@query("t15_sample", "select vec_id id from embeddings order by md5('7/' || vec_id), vec_id limit 25")
def _sample(spark, sf_dir):
    return clustering.sampled(embeddings(spark, sf_dir), 25, 7).select("id")


@query("t14_sorted_addresses", "select vec_id address from embeddings where vec_id % 7 = 0 order by 1")
def _sorted(spark, sf_dir):
    return embeddings(spark, sf_dir).where("id % 7 = 0").select(F.col("id").alias("address")).orderBy("address")


# Projections and filters


@query("p1_normalize", f"with {_L}, n as (select vec_id, sqrt(sum(x * x)) n from l group by all) select vec_id id, pos, round(x / (n + 1e-9), 6) + 0.0 x from l join n using (vec_id)")
def _normalize(spark, sf_dir):
    return positions(embeddings(spark, sf_dir).select("id", M.normalize(F.col("vec")).alias("vec")))


@query("p2_subvectors", f"with {_L} select vec_id id, (pos // 8)::integer sub, round(sum(x), 6) + 0.0 total from l group by all")
def _subvectors(spark, sf_dir):
    subs = embeddings(spark, sf_dir).select("id", "vec", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("sub"))
    return subs.select("id", "sub", r6(M.total(M.subvector(F.col("vec"), F.col("sub"), 8))).alias("total"))


@query("p3_residual", f"with {_CELLS}, {_S16} select l.vec_id id, l.pos, round(l.x - s.x, 6) + 0.0 x from l join cells using (vec_id) join s16 s on s.vec_id = cells.cell and s.pos = l.pos")
def _residual(spark, sf_dir):
    base = embeddings(spark, sf_dir)
    near = base.join(cells16(base), "id").join(F.broadcast(seed_rows(base)), "cell")
    return positions(near.select("id", M.residual(F.col("vec"), F.col("c")).alias("vec")))


def _half_sql(top: str) -> str:
    unit = "pow(2.0, greatest(floor(log2(abs(y))), -14) - 10)"
    return f"with {_L}, t as (select vec_id, {top} top from l group by vec_id), y as (select vec_id, pos, top, x / top y from l join t using (vec_id)) select vec_id id, pos, round(case when y = 0 then 0.0 else round_even(y / {unit}, 0) * {unit} * top end, 6) + 0.0 x from y"


@query("p4_half_precision", _half_sql("greatest(max(abs(x)), 1e-30)"))
def _half(spark, sf_dir):
    return positions(embeddings(spark, sf_dir).select("id", M.half(F.col("vec"), scale=True).alias("vec")))


@query("p5_valid_addresses", "select vec_id - 50 address from embeddings where vec_id - 50 >= 0 and vec_id - 50 < 300")
def _valid(spark, sf_dir):
    return embeddings(spark, sf_dir).select((F.col("id") - 50).alias("address")).where("address >= 0 and address < 300")


@query("p6_skip_empty", "select vec_id id from embeddings where vec_id % 3 <> 0")
def _skip(spark, sf_dir):
    base = embeddings(spark, sf_dir)
    return store.remove(base, base.where("id % 3 = 0").select("id")).select("id")


@query("p7_cell_mask", f"with {_CELLS} select vec_id id from cells where cell = 5")
def _mask(spark, sf_dir):
    return cells16(embeddings(spark, sf_dir)).where("cell = 5").select("id")


@query("p8_schema_check", "select count(*) n from embeddings")
def _schema(spark, sf_dir):
    return store.check_schema(embeddings(spark, sf_dir), id="bigint", vec="array<double>").agg(F.count("*").alias("n"))


# Joins


@query("j2_batched_product", f"with {_L}, s as (select vec_id, (pos // 8)::integer problem, pos, x from l) select a.problem, a.vec_id i, b.vec_id j, round(sum(a.x * b.x), 6) + 0.0 \"value\" from s a join s b on a.pos = b.pos where b.vec_id < 16 group by all")
def _batched(spark, sf_dir):
    base = embeddings(spark, sf_dir)
    subs = base.select("id", "vec", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("problem"))
    subs = subs.select("id", "problem", M.subvector(F.col("vec"), F.col("problem"), 8).alias("x"))
    a, b = subs.withColumnRenamed("id", "i"), subs.where("id < 16").selectExpr("id as j", "problem", "x as y")
    out = search.batched_product(a, F.broadcast(b))
    return out.select("problem", "i", "j", r6("value").alias("value"))


@query("j3_nearest_centroid", f"with {_CELLS} select vec_id id, cell, round(0.0 - dd, 6) + 0.0 score from cells")
def _nearest(spark, sf_dir):
    return cells16(embeddings(spark, sf_dir)).select("id", "cell", r6("score").alias("score"))


@query("j4_nearest_by_distance", f"with {_CELLS} select vec_id id, cell, round(dd, 6) + 0.0 distance from cells")
def _min_product(spark, sf_dir):
    base = embeddings(spark, sf_dir)
    pairs = base.crossJoin(F.broadcast(seed_rows(base))).withColumn("distance", F.round(M.squared_l2(F.col("vec"), F.col("c")), 12))
    return search.top_1(pairs, ["id"], "distance", "cell", largest=False).select("id", "cell", r6("distance").alias("distance"))


for _e, _x in (("nmadd", "0.0 - sum(a.x * b.x)"), ("squared_l2", "sum((a.x - b.x) * (a.x - b.x))"), ("l1", "sum(abs(a.x - b.x))")):

    @query(f"j4_element_{_e}", f"with {_L} select a.vec_id i, b.vec_id j, round({_x}, 6) + 0.0 \"value\" from l a join l b using (pos) where b.vec_id < 16 group by all")
    def _element(spark, sf_dir, e=_e):
        base = embeddings(spark, sf_dir).withColumn("problem", F.lit(0))
        a, b = base.selectExpr("id as i", "vec as x", "problem"), base.where("id < 16").selectExpr("id as j", "vec as y", "problem")
        return search.batched_product(a, F.broadcast(b), e).select("i", "j", r6("value").alias("value"))


@query("j6_masked_product", f"with {_L} select a.vec_id q_id, b.vec_id id, round(sum(a.x * b.x), 6) + 0.0 score from l a join l b using (pos) where a.vec_id % 50 = 0 and (a.vec_id + b.vec_id) % 10 = 0 group by all")
def _masked(spark, sf_dir):
    base = embeddings(spark, sf_dir)
    queries = queries_of(base).withColumn("m", F.pmod(F.lit(0) - F.col("q_id"), F.lit(10)))
    return search.masked_product(queries, base.withColumn("m", F.pmod("id", F.lit(10))), "m").select("q_id", "id", r6("score").alias("score"))


@query("j6_block_masked", f"with {_L}, bl as (select distinct (vec_id // 10) bi, (vec_id // 10 * 7) % 50 bj from embeddings) select a.vec_id i, b.vec_id j, round(sum(a.x * b.x), 6) + 0.0 score from bl join l a on a.vec_id // 10 = bi join l b on b.vec_id // 10 = bj and a.pos = b.pos group by all")
def _block_masked(spark, sf_dir):
    base = embeddings(spark, sf_dir)
    block = F.floor(F.col("id") / 10).cast("long")
    blocks = base.select(block.alias("bi"), (block * 7 % 50).alias("bj"))
    out = search.block_masked_product(base.select(F.col("id").alias("i"), F.col("vec").alias("x")), base.select(F.col("id").alias("j"), F.col("vec").alias("y")), blocks, 10)
    return out.select("i", "j", r6("score").alias("score"))


@query("j7_candidate_join", f"with {_CELLS}{_PROBES} select probes.q_id, cells.vec_id id, probes.cell from probes join cells using (cell)")
def _candidates(spark, sf_dir):
    base = embeddings(spark, sf_dir)
    index = index16(base)
    return index.probe(queries_of(base)).select("q_id", "cell").join(index.codes.select("id", "cell"), "cell").select("q_id", "id", "cell")


@query("j8_pq_decode", f"with {_L}, {_PQ} select vec_id id, pos, round(c, 6) + 0.0 x from codes join cb using (sub, code)")
def _pq_decode(spark, sf_dir):
    base = embeddings(spark, sf_dir)
    pq = pq16(base)
    return positions(pq.decode(pq.encode(base)))


@query("j9_vq_decode", f"with {_CELLS}, {_S16} select cells.vec_id id, s.pos, round(s.x, 6) + 0.0 x from cells join s16 s on s.vec_id = cells.cell")
def _vq_decode(spark, sf_dir):
    base = embeddings(spark, sf_dir)
    vq = codecs.VQCodec(16, seeds(base))
    return positions(vq.decode(vq.encode(base)))


@query("j10_address_of", "with s as (select vec_id id, vec_id address from embeddings where vec_id % 3 <> 0), i as (select vec_id * 2 id from embeddings) select i.id, coalesce(address, -1) address from i left join s using (id)")
def _address_of(spark, sf_dir):
    base = embeddings(spark, sf_dir)
    return store.address_of(flat_store(base).where("id % 3 <> 0"), base.select((F.col("id") * 2).alias("id")))


@query("j11_id_of", "with s as (select vec_id id, vec_id address from embeddings where vec_id % 3 <> 0), a as (select vec_id * 2 address from embeddings) select a.address, coalesce(id, -1) id from a left join s using (address)")
def _id_of(spark, sf_dir):
    base = embeddings(spark, sf_dir)
    return store.id_of(flat_store(base).where("id % 3 <> 0"), base.select((F.col("id") * 2).alias("address")))


_STARTS = _CELLS + ", sz as (select cell, count(*) capacity from cells group by cell), st as (select *, coalesce(sum(capacity) over (order by cell rows between unbounded preceding and 1 preceding), 0)::bigint start from sz)"


@query("j13_cell_of_address", f"with {_STARTS}, a as (select vec_id * 3 - 30 address from embeddings) select address, coalesce(cell, -1) cell from a left join st on address >= start and address < start + capacity")
def _cell_of(spark, sf_dir):
    base = embeddings(spark, sf_dir)
    starts = store.cell_starts(store.cell_sizes(cells16(base)).withColumnRenamed("size", "capacity"))
    return store.cell_of_address(base.select((F.col("id") * 3 - 30).alias("address")), F.broadcast(starts))


@query("j15_similarity_at_id", f"with {_L}, {_PQ}{_ADC}, pr as (select a.vec_id q_id, b.vec_id id from embeddings a, embeddings b where a.vec_id % 50 = 0 and (a.vec_id // 50 * 7 + b.vec_id) % 50 = 0) select q.q_id, codes.vec_id id, round(0.0 - sum(dd), 6) + 0.0 score from pr join q using (q_id) join codes on codes.vec_id = pr.id and codes.sub = q.sub and codes.code = q.code group by q.q_id, codes.vec_id")
def _similarity_at(spark, sf_dir):
    base = embeddings(spark, sf_dir)
    asked = queries_of(base).select("q_id", F.pmod(F.lit(0) - F.floor(F.col("q_id") / 50) * 7, F.lit(50)).alias("m"))
    pairs = base.select("id", (F.col("id") % 50).alias("m")).repartition("id").join(F.broadcast(asked), "m").select("q_id", "id")
    return index16(base).similarity_at_id(queries_of(base), pairs).select("q_id", "id", r6("score").alias("score"))


# Aggregations and windows


@query("a1_grouped_means", f"with {_CELLS} select cell, pos, round(avg(x), 6) + 0.0 x from l join cells using (vec_id) group by all union all select 16, i::integer, 0.0 from range(0, 64) r(i)")
def _means(spark, sf_dir):
    base = embeddings(spark, sf_dir)
    means = clustering.grouped_means(base.join(cells16(base), "id"), "cell", 64, cells=17)
    return means.select("cell", F.posexplode("mean").alias("pos", "x")).withColumn("x", r6("x"))


@query("a3_inertia", f"with {_CELLS} select round(avg(dd), 6) inertia from cells")
def _inertia(spark, sf_dir):
    return cells16(embeddings(spark, sf_dir)).agg(r6(F.avg(F.lit(0.0) - F.col("score"))).alias("inertia"))


@query("a4_error", f"with {_CELLS}, m as (select cell, pos, avg(x) x from l join cells using (vec_id) group by all) select round(sum((m.x - s.x) * (m.x - s.x)), 6) error from m join l s on s.vec_id = m.cell and s.pos = m.pos")
def _error(spark, sf_dir):
    base = embeddings(spark, sf_dir)
    means = clustering.grouped_means(base.join(cells16(base), "id"), "cell", 64, cells=16)
    return means.join(seed_rows(base), "cell").agg(r6(F.sum(M.squared_l2(F.col("mean"), F.col("c")))).alias("error"))


@query("a5_cell_counts", f"with {_CELLS} select cell, count(*) size from cells group by cell")
def _counts(spark, sf_dir):
    return store.cell_sizes(cells16(embeddings(spark, sf_dir)))


@query("a6_distinct_addresses", "select distinct vec_id % 40 - 5 address from embeddings where vec_id % 40 - 5 between 0 and 29")
def _distinct(spark, sf_dir):
    return embeddings(spark, sf_dir).select((F.col("id") % 40 - 5).alias("address")).where("address >= 0 and address < 30").dropDuplicates(["address"])


@query("a7_min_max", f"with {_L} select pos, round(min(x), 6) + 0.0 low, round(max(x) - min(x) + 1e-8, 6) + 0.0 wide from l group by pos")
def _minmax(spark, sf_dir):
    sq = codecs.SQCodec()
    sq.train(embeddings(spark, sf_dir))
    return _ranges(spark, sq)


def _ranges(spark: SparkSession, sq: codecs.SQCodec) -> DataFrame:
    rows = spark.createDataFrame([(i, a, r) for i, (a, r) in enumerate(zip(sq.low, sq.range, strict=True))], "pos int, low double, wide double")
    return rows.select("pos", r6("low").alias("low"), r6("wide").alias("wide"))


@query("a8_mean_std", f"with {_L} select pos, round(avg(x) - 2 * stddev_samp(x), 6) + 0.0 low, round(4 * stddev_samp(x) + 1e-8, 6) + 0.0 wide from l group by pos")
def _meanstd(spark, sf_dir):
    sq = codecs.SQCodec(alpha=2.0, mode="meanstd")
    sq.train(embeddings(spark, sf_dir))
    return _ranges(spark, sq)


@query("a9_covariance", f"with {_L} select a.pos i, b.pos j, round(covar_samp(a.x, b.x), 6) + 0.0 cov from l a join l b using (vec_id) group by all")
def _covariance(spark, sf_dir):
    _, _, cov = codecs.covariance(embeddings(spark, sf_dir), 64)
    rows = spark.createDataFrame([(i, j, float(cov[i, j])) for i in range(64) for j in range(64)], "i int, j int, cov double")
    return rows.select("i", "j", r6("cov").alias("cov"))


@query("a11_candidate_totals", f"with {_CELLS}{_PROBES}, sz as (select cell, count(*) size from cells group by cell) select q_id, sum(size)::bigint candidates from probes join sz using (cell) group by q_id")
def _candidate_totals(spark, sf_dir):
    base = embeddings(spark, sf_dir)
    index = index16(base)
    return index.probe(queries_of(base)).join(store.cell_sizes(index.codes), "cell").groupBy("q_id").agg(F.sum("size").alias("candidates"))


@query("a12_smart_probes", f"with {_CD}, pr as (select * from (select vec_id q_id, cell, dd, row_number() over (partition by vec_id order by round(dd, 12), cell) rank from cd where vec_id % 50 = 0) where rank <= 8), w as (select *, exp(0.0 - sqrt(dd) / 0.1) w from pr), s as (select *, w / sum(w) over (partition by q_id) p from w) select q_id, least(greatest(ceil(round(0.0 - sum(case when p > 0 then p * log2(p) else 0 end) / 3 * 8, 9)), 1), 8)::bigint n_probe from s group by q_id")
def _smart(spark, sf_dir):
    base = embeddings(spark, sf_dir)
    probes = clustering.nearest_cells(base.where("id % 50 = 0"), seeds(base), 8)
    return ivf.smart_probes(probes, 8, 0.1).groupBy("q_id").agg(F.count("*").alias("n_probe"))


@query("a14_adc_scores", f"with {_L}, {_grid('l')}, sc as (select q.vec_id q_id, dec.vec_id id, 0.0 - sum((q.x - dec.x) * (q.x - dec.x)) score from l q join dec using (pos) where q.vec_id % 50 = 0 group by all), {_RANKED.format(s='score', t='sc')} select q_id, rank, id, round(score, 6) + 0.0 score from r where rank <= 10")
def _adc(spark, sf_dir):
    base = embeddings(spark, sf_dir)
    return hits(grid_index(base, n_probe=16).search(queries_of(base), 10))


@query("a15_max_id", "select max(vec_id) max_id from embeddings")
def _max_id(spark, sf_dir):
    return embeddings(spark, sf_dir).agg(F.max("id").alias("max_id"))


@query("w1_index_of_appearance", f"with {_CELLS} select vec_id id, cell, row_number() over (partition by cell order by vec_id) - 1 ioa from cells")
def _ioa(spark, sf_dir):
    return store.index_of_appearance(cells16(embeddings(spark, sf_dir)), "id").select("id", "cell", "ioa")


def cell_store(base: DataFrame) -> DataFrame:
    """Even ids in cells (id div 2) % 4 at slots by id, every third of them deleted again."""
    rows = base.where("id % 2 = 0").withColumn("cell", F.expr("cast(id div 2 % 4 as int)"))
    slots = store.index_of_appearance(rows, "id").withColumnRenamed("ioa", "slot").select("cell", "slot", "id", "vec")
    return store.remove(slots, slots.where("id % 3 = 0").select("id"))


_SLOTS = "with a as (select vec_id id, ((vec_id // 2) % 4)::integer cell from embeddings where vec_id % 2 = 0), s as (select *, row_number() over (partition by cell order by id) - 1 slot from a), k as (select * from s where id % 3 <> 0), n as (select vec_id id, ((vec_id // 2) % 4)::integer cell from embeddings where vec_id % 2 = 1), i as (select *, row_number() over (partition by cell order by id) - 1 ioa from n), c as (select cell, slot from (select unnest([0, 1, 2, 3])::integer cell) x, (select unnest(range(0, 10000)) slot) y), f as (select cell, slot, row_number() over (partition by cell order by slot) - 1 ioa from c anti join k using (cell, slot))"


@query("w2_write_slots", _SLOTS + " select i.id, i.cell, f.slot from i join f using (cell, ioa)")
def _slots(spark, sf_dir):
    base = embeddings(spark, sf_dir)
    new = base.where("id % 2 = 1").withColumn("cell", F.expr("cast(id div 2 % 4 as int)"))
    return store.write_slots(cell_store(base), new).select("id", "cell", "slot")


@query("w3_auto_ids", "select vec_id src, row_number() over (order by vec_id) - 1 + (select max(vec_id) from embeddings) + 1 id from embeddings where vec_id % 5 = 0")
def _auto(spark, sf_dir):
    base = embeddings(spark, sf_dir)
    return store.with_auto_ids(base.where("id % 5 = 0").select(F.col("id").alias("src")), base, ["src"])


@query("w4_cell_starts", f"with {_STARTS} select cell, capacity, start from st")
def _starts(spark, sf_dir):
    return store.cell_starts(store.cell_sizes(cells16(embeddings(spark, sf_dir))).withColumnRenamed("size", "capacity")).select("cell", "capacity", "start")


@query("w5_query_ranking", f"with {_CELLS} select vec_id id, cell, (row_number() over (partition by cell order by round(dd, 9), vec_id))::integer rank from cells")
def _cell_ranks(spark, sf_dir):
    ranked = cells16(embeddings(spark, sf_dir)).select("id", "cell", (F.lit(0.0) - F.round("score", 9)).alias("s"))
    return store.numbered_within(ranked, "cell", ["s", "id"], "n").select("id", "cell", (F.col("n") + 1).cast("int").alias("rank"))


# Sources, sinks, set operations


@query("s1_scan", f"with {_L} select vec_id id, count(*)::integer width, round(sum(x), 6) + 0.0 total from l group by vec_id")
def _scan(spark, sf_dir):
    return embeddings(spark, sf_dir).select("id", F.size("vec").alias("width"), r6(M.total(F.col("vec"))).alias("total"))


@query("s2_save_load_index", f"with {_CELLS}, {_PQ} select vec_id id, cell, sub, code from codes join cells using (vec_id)")
def _save_load(spark, sf_dir):
    path = scratch.folder(spark)
    index16(embeddings(spark, sf_dir)).save(path, spark)
    codes = ivf.IVFPQIndex.load(path, spark).codes
    return codecs.long_codes(codes).join(codes.select("id", "cell"), "id").select("id", "cell", "sub", "code")


@query("s5_side_table", f"with {_L} select vec_id id, round(sum(x), 6) + 0.0 total from l where vec_id % 9 = 0 group by vec_id")
def _side(spark, sf_dir):
    base, path = embeddings(spark, sf_dir), scratch.folder(spark)
    base.write.parquet(path)
    some = persist.load_side_table(path, spark, base.where("id % 9 = 0").select("id"))
    return some.select("id", r6(M.total(F.col("vec"))).alias("total"))


@query("s6_get_by_address", f"with {_L}, s as (select vec_id address, sum(x) total from l where vec_id % 3 <> 0 group by vec_id), a as (select vec_id * 2 address from embeddings) select address, round(coalesce(total, 0), 6) + 0.0 total from a left join s using (address)")
def _get_address(spark, sf_dir):
    base = embeddings(spark, sf_dir)
    got = store.get_by_address(flat_store(base).where("id % 3 <> 0"), base.select((F.col("id") * 2).alias("address")), 64)
    return got.select("address", r6(M.total(F.col("vec"))).alias("total"))


@query("s7_set_by_address", f"with {_L} select vec_id address, round(sum(x) * case when vec_id % 10 = 0 then 2 else 1 end, 6) + 0.0 total from l group by vec_id")
def _set_address(spark, sf_dir):
    base = flat_store(embeddings(spark, sf_dir))
    changes = base.where("id % 10 = 0").select("address", F.transform("vec", lambda x: x * 2).alias("vec"))
    outside = changes.withColumn("address", F.col("address") + 1_000_000)
    return store.update(base, changes.unionByName(outside)).select("address", r6(M.total(F.col("vec"))).alias("total"))


@query("s8_get_by_id", f"with {_L}, s as (select vec_id id, sum(x) total from l group by vec_id), a as (select vec_id * 2 id from embeddings) select id, round(coalesce(total, 0), 6) + 0.0 total from a left join s using (id)")
def _get_id(spark, sf_dir):
    base = embeddings(spark, sf_dir)
    return store.get_by_id(base, base.select((F.col("id") * 2).alias("id")), 64).select("id", r6(M.total(F.col("vec"))).alias("total"))


@query("s9_group_member", f"with {_L} select vec_id id, round(sum(x), 6) + 0.0 total from l where pos >= 16 and pos < 48 group by vec_id")
def _member(spark, sf_dir):
    group = embeddings(spark, sf_dir).select("id", F.slice("vec", 1, 16).alias("vec_0"), F.slice("vec", 17, 32).alias("vec_1"), F.slice("vec", 49, 16).alias("vec_2"))
    return store.member(group, 1).select("id", r6(M.total(F.col("vec"))).alias("total"))


@query("s10_statistics", "select count(*) n_items, max(vec_id) max_id, (count(*) * 512)::bigint bytes from embeddings")
def _statistics(spark, sf_dir):
    return store.statistics(embeddings(spark, sf_dir))


@query("u1_flat_add", "select vec_id id, vec_id address from embeddings where vec_id < 100 union all select vec_id, vec_id from embeddings where vec_id >= 100")
def _flat_add(spark, sf_dir):
    base = flat_store(embeddings(spark, sf_dir))
    return store.flat_add(base.where("id < 100"), base.where("id >= 100").drop("address")).select("id", "address")


@query("u1_cell_add", _SLOTS + " select id, cell, slot from k union all select i.id, i.cell, f.slot from i join f using (cell, ioa)")
def _cell_add(spark, sf_dir):
    base = embeddings(spark, sf_dir)
    new = base.where("id % 2 = 1").withColumn("cell", F.expr("cast(id div 2 % 4 as int)"))
    return store.cell_add(cell_store(base), new).select("id", "cell", "slot")


@query("u2_remove", "select vec_id id from embeddings where vec_id % 4 <> 0")
def _remove(spark, sf_dir):
    base = embeddings(spark, sf_dir)
    gone = base.where("id % 4 = 0").select("id").unionByName(spark.range(10_000_000, 10_000_005))
    return store.remove(base, gone).select("id")


@query("u2_remove_compact", "with l as (select vec_id id, vec_id address from embeddings where vec_id % 4 <> 0), n as (select count(*) n from l), h as (select vec_id hole, row_number() over (order by vec_id) k from embeddings, n where vec_id % 4 = 0 and vec_id < n), m as (select id, row_number() over (order by address) k from l, n where address >= n) select id, address from l, n where address < n union all select id, hole from m join h using (k)")
def _compact(spark, sf_dir):
    base = flat_store(embeddings(spark, sf_dir))
    return store.flat_remove(base, base.where("id % 4 = 0").select("id")).select("id", "address")


@query("u2_remove_addresses", "select vec_id id from embeddings where vec_id % 6 <> 0 or vec_id >= 300")
def _remove_addresses(spark, sf_dir):
    base = flat_store(embeddings(spark, sf_dir))
    gone = base.where("id % 6 = 0").select("address")
    return store.remove_addresses(base, gone.unionByName(gone), 300).select("id")


@query("u3_truncate", "select vec_id id from embeddings where false")
def _truncate(spark, sf_dir):
    return store.truncate(embeddings(spark, sf_dir)).select("id")


@query("u4_concat_codes", f"with {_L}, {_PQ} select vec_id id, sub, code from codes union all select vec_id, sub + 8, code from codes")
def _concat(spark, sf_dir):
    base = embeddings(spark, sf_dir)
    codes = pq16(base).encode(base)
    return codecs.long_codes(codes.select("id", F.concat("code", "code").alias("code")))


@query("u5_capacity", "select vec_id n, case when vec_id <= 64 then 64 else (64 * pow(2, ceil(round(log2(vec_id / 64), 9))))::bigint end doubled, (ceil(vec_id / 100) * 100)::bigint stepped from embeddings where vec_id > 0")
def _capacity(spark, sf_dir):
    n = F.col("id")
    return embeddings(spark, sf_dir).where("id > 0").select(n.alias("n"), store.capacity(n, 64).alias("doubled"), store.capacity(n, 100, "step").alias("stepped"))


# Clustering


def _lloyd_ctes(steps: int) -> str:
    """CTEs of Lloyd steps from cen0 over l: lab{n}, cen{n}."""
    out = []
    for n in range(steps):
        out.append(f"d{n} as (select vec_id, cell, sum((x - c) * (x - c)) dd from l join cen{n} using (pos) group by all)")
        out.append(f"lab{n} as (select vec_id, cell, dd from (select *, row_number() over (partition by vec_id order by round(dd, 12), cell) rn from d{n}) where rn = 1)")
        out.append(f"m{n} as (select cell, pos, avg(x) c from l join lab{n} using (vec_id) group by all)")
        out.append(f"cen{n + 1} as (select a.cell, a.pos, coalesce(m.c, 0.0) c from cen0 a left join m{n} m on a.cell = m.cell and a.pos = m.pos)")
    return ", ".join(out)


def _lloyd_sql(steps: int) -> str:
    return f"with {_L}, cen0 as (select vec_id::integer cell, pos, x c from l where vec_id < 16), {_lloyd_ctes(steps)}"


@query("c2_kmeans_labels", f"{_lloyd_sql(3)} select vec_id id, cell from lab2")
def _kmeans_labels(spark, sf_dir):
    base = embeddings(spark, sf_dir)
    return clustering.KMeans(16, max_iter=3, tol=0.0).fit(base, seeds(base))


@query("c1_kmeans_centroids", f"{_lloyd_sql(3)} select cell, pos, round(c, 6) + 0.0 x from cen3")
def _kmeans_centroids(spark, sf_dir):
    base = embeddings(spark, sf_dir)
    km = clustering.KMeans(16, max_iter=3, tol=0.0)
    km.fit(base, seeds(base))
    rows = spark.createDataFrame([(c, p, float(x)) for c, v in enumerate(km.centroids[0]) for p, x in enumerate(v)], "cell int, pos int, x double")
    return rows.select("cell", "pos", r6("x").alias("x"))


@query("c2_kmeans_inertia", f"{_lloyd_sql(3)} select round(avg(dd), 6) + 0.0 inertia, (select round(sum((a.c - b.c) * (a.c - b.c)), 6) + 0.0 from cen3 a join cen2 b using (cell, pos)) error from lab2")
def _kmeans_inertia(spark, sf_dir):
    base = embeddings(spark, sf_dir)
    km = clustering.KMeans(16, max_iter=3, tol=0.0)
    km.fit(base, seeds(base))
    return spark.createDataFrame([(km.inertia, km.error)], "inertia double, error double").select(r6("inertia").alias("inertia"), r6("error").alias("error"))


@query("c3_predict", f"{_lloyd_sql(4)} select vec_id id, cell from lab3")
def _predict(spark, sf_dir):
    base = embeddings(spark, sf_dir)
    km = clustering.KMeans(16, max_iter=3, tol=0.0)
    km.fit(base, seeds(base))
    return km.predict(base)


@query("c4_farthest_first", "with recursive " + _L + ", g as (select a.vec_id a, b.vec_id b, sum((a.x - b.x) * (a.x - b.x)) d from l a join l b using (pos) group by all), f as (select 0 n, [0::bigint] s union all select n + 1, list_append(s, (select a from g where list_contains(f.s, b) group by a order by round(min(d), 12) desc, a limit 1)) from f where n < 3) select n, s[n + 1] id from f")
def _farthest(spark, sf_dir):
    base = embeddings(spark, sf_dir)
    found = clustering.farthest_first(base, 4, first=seeds(base, 1))
    picked = spark.createDataFrame([(n, v.tolist()) for n, v in enumerate(found)], "n int, vec array<double>")
    return base.join(F.broadcast(picked), "vec").select("n", "id")


@query("c4_core_seeds")
def _core(spark, sf_dir):
    """64 seeds, and how many vectors are nearest to each. What a core set picks depends on how the vectors are dealt."""
    base = embeddings(spark, sf_dir)
    return clustering.assign(base, clustering.core_seeds(base, 64)).groupBy("cell").agg(F.count("*").alias("size"))


@query("w5_line_ranking", "select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, (row_number() over (partition by l_returnflag order by l_extendedprice desc, l_orderkey, l_linenumber, l_partkey, l_suppkey)) - 1 n from lineitem")
def _line_ranks(spark, sf_dir):
    """Three groups hold all rows of the largest table."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", (F.lit(0.0) - F.col("l_extendedprice").cast("double")).alias("price"))
    return store.numbered_within(t, "l_returnflag", ["price", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], "n").drop("price")


@query("c5_similarity_matrix", f"with {_L} select a.vec_id id, b.vec_id::integer cell, round({_SCORES['cosine']}, 6) + 0.0 score from l a join l b using (pos) where b.vec_id < 16 group by all")
def _matrix(spark, sf_dir):
    base = embeddings(spark, sf_dir)
    pairs = search.scored_pairs(base.crossJoin(F.broadcast(seed_rows(base))), "cosine", "vec", "c")
    return pairs.select("id", "cell", r6("score").alias("score"))


@query("c6_cosine_labels", f"with {_L}, s as (select a.vec_id, b.vec_id::integer cell, {_SCORES['cosine']} score from l a join l b using (pos) where b.vec_id < 16 group by all) select vec_id id, cell from (select *, row_number() over (partition by vec_id order by round(score, 12) desc, cell) rn from s) where rn = 1")
def _cosine_labels(spark, sf_dir):
    base = embeddings(spark, sf_dir)
    return clustering.assign(base, seeds(base), "cosine").select("id", "cell")


def _multi_sql(steps: int) -> str:
    """CTEs of Lloyd steps in 8 problems of 8 elements, from the first 16 vectors: lab{n}, cen{n}."""
    out = ["sv as (select vec_id, (pos // 8)::integer sub, pos, x from l)", "cen0 as (select vec_id::integer cell, sub, pos, x c from sv where vec_id < 16)"]
    for n in range(steps):
        out.append(f"d{n} as (select vec_id, sub, cell, sum((x - c) * (x - c)) dd from sv join cen{n} using (sub, pos) group by all)")
        out.append(f"lab{n} as (select vec_id, sub, cell from (select *, row_number() over (partition by vec_id, sub order by round(dd, 12), cell) rn from d{n}) where rn = 1)")
        out.append(f"m{n} as (select sub, cell, pos, avg(x) c from sv join lab{n} using (vec_id, sub) group by all)")
        out.append(f"cen{n + 1} as (select a.sub, a.cell, a.pos, coalesce(m.c, 0.0) c from cen0 a left join m{n} m on a.sub = m.sub and a.cell = m.cell and a.pos = m.pos)")
    return f"with {_L}, {', '.join(out)}"


@query("c7_multi_kmeans", f"{_multi_sql(3)} select sub, cell code, pos - sub * 8 pos, round(c, 6) + 0.0 x from cen3")
def _multi(spark, sf_dir):
    base = embeddings(spark, sf_dir)
    km = clustering.MultiKMeans(8, 16, max_iter=3, tol=0.0)
    km.fit(base, seeds(base).reshape(16, 8, 8).transpose(1, 0, 2).copy())
    rows = [(s, c, p, float(x)) for s, book in enumerate(km.centroids) for c, v in enumerate(book) for p, x in enumerate(v)]
    return spark.createDataFrame(rows, "sub int, code int, pos int, x double").select("sub", "code", "pos", r6("x").alias("x"))


def _batches_sql(cells: int) -> str:
    """Two mini-batches, even ids and then odd ones: cen2 (cell, pos, c) and n2 (cell, n)."""
    label = "select vec_id, cell from (select *, row_number() over (partition by vec_id order by round(dd, 12), cell) rn from {0}) where rn = 1"
    return (
        f"with {_L}, cen0 as (select vec_id::integer cell, pos, x c from l where vec_id < {cells})"
        ", d0 as (select vec_id, cell, sum((x - c) * (x - c)) dd from l join cen0 using (pos) where vec_id % 2 = 0 group by all), lab0 as (" + label.format("d0") + ")"
        ", m0 as (select cell, pos, avg(x) c from l join lab0 using (vec_id) group by all), cen1 as (select a.cell, a.pos, coalesce(m.c, a.c) c from cen0 a left join m0 m using (cell, pos))"
        ", n1 as (select a.cell, 1 + count(lab0.vec_id) n from (select distinct cell from cen0) a left join lab0 using (cell) group by a.cell)"
        ", d1 as (select vec_id, cell, sum((x - c) * (x - c)) dd from l join cen1 using (pos) where vec_id % 2 = 1 group by all), lab1 as (" + label.format("d1") + ")"
        ", m1 as (select cell, pos, avg(x) c from l join lab1 using (vec_id) group by all)"
        ", cen2 as (select a.cell, a.pos, coalesce(a.c * (1 - 1 / n1.n) + m.c / n1.n, a.c) c from cen1 a join n1 using (cell) left join m1 m on m.cell = a.cell and m.pos = a.pos)"
        ", n2 as (select n1.cell, n1.n + count(lab1.vec_id) n from n1 left join lab1 using (cell) group by n1.cell, n1.n)"
    )


def _two_batches(base: DataFrame) -> clustering.MinibatchKMeans:
    km = clustering.MinibatchKMeans(16)
    km.fit_minibatch(base.where("id % 2 = 0"), seeds(base))
    km.fit_minibatch(base.where("id % 2 = 1"))
    return km


@query("a10_running_counts", f"{_batches_sql(16)} select cell, n from n2")
def _running(spark, sf_dir):
    km = _two_batches(embeddings(spark, sf_dir))
    return spark.createDataFrame([(c, int(n)) for c, n in enumerate(km.counts)], "cell int, n long")


@query("c8_minibatch", f"{_batches_sql(16)} select cell, pos, round(c, 6) + 0.0 x, n from cen2 join n2 using (cell)")
def _minibatch(spark, sf_dir):
    km = _two_batches(embeddings(spark, sf_dir))
    rows = [(c, p, float(x), int(km.counts[c])) for c, v in enumerate(km.centroids) for p, x in enumerate(v)]
    return spark.createDataFrame(rows, "cell int, pos int, x double, n long").select("cell", "pos", r6("x").alias("x"), "n")


@query("c9_kmeans_redos", f"{_lloyd_sql(4)} select vec_id id, cell from lab3")
def _redos(spark, sf_dir):
    base = embeddings(spark, sf_dir)
    return clustering.KMeans(16, n_redo=2, max_iter=2, tol=0.0, keep_between_redos=True).fit(base, seeds(base))


@query("t9_nearest_cells", f"with {_CD}{_PROBES} select q_id, rank::integer rank, cell, round(0.0 - dd, 6) + 0.0 score from probes")
def _nearest_cells(spark, sf_dir):
    base = embeddings(spark, sf_dir)
    return clustering.nearest_cells(base.where("id % 50 = 0"), seeds(base), N_PROBE).select("q_id", "rank", "cell", r6("score").alias("score"))


# Codecs


@query("e1_vq_encode", f"with {_CELLS} select vec_id id, cell code from cells")
def _vq(spark, sf_dir):
    base = embeddings(spark, sf_dir)
    return codecs.VQCodec(16, seeds(base)).encode(base)


@query("e2_pq_train", f"{_multi_sql(3)}, d3 as (select vec_id, sub, cell, sum((x - c) * (x - c)) dd from sv join cen3 using (sub, pos) group by all) select vec_id id, sub, cell code from (select *, row_number() over (partition by vec_id, sub order by round(dd, 12), cell) rn from d3) where rn = 1")
def _pq_train(spark, sf_dir):
    base = embeddings(spark, sf_dir)
    pq = codecs.PQCodec(8, 16, max_iter=3, tol=0.0)
    pq.train(base, seeds(base).reshape(16, 8, 8).transpose(1, 0, 2).copy())
    return codecs.long_codes(pq.encode(base))


@query("e3_pq_encode", f"with {_L}, {_PQ} select vec_id id, sub, code from codes")
def _pq_encode(spark, sf_dir):
    base = embeddings(spark, sf_dir)
    return codecs.long_codes(pq16(base).encode(base))


@query("e5_adc_table", f"with {_L}, {_PQ} select vec_id q_id, sub, code, round(0.0 - dd, 6) + 0.0 \"value\" from ds where vec_id % 50 = 0")
def _adc_table(spark, sf_dir):
    base = embeddings(spark, sf_dir)
    return pq16(base).precompute_adc(queries_of(base)).select("q_id", "sub", "code", r6("value").alias("value"))


_SQ = _L + ", mm as (select pos, min(x) lo, max(x) - min(x) + 1e-8 wide from l group by pos), c as (select vec_id, pos, lo, wide, least(greatest(round_even((x - lo) / wide * {n}, 0), 0), {n} - 1)::integer code from l join mm using (pos))"


def _trained(base: DataFrame, **options) -> codecs.SQCodec:
    sq = codecs.SQCodec(**options)
    sq.train(base)
    return sq


@query("e7_sq8_encode", f"with {_SQ.format(n=256)} select vec_id id, pos, code from c")
def _sq8(spark, sf_dir):
    base = embeddings(spark, sf_dir)
    return _trained(base).encode(base).select("id", F.posexplode("code").alias("pos", "code"))


@query("e8_sq8_decode", f"with {_SQ.format(n=256)} select vec_id id, pos, round(code / 256 * wide + lo, 6) + 0.0 x from c")
def _sq8_decode(spark, sf_dir):
    base = embeddings(spark, sf_dir)
    sq = _trained(base)
    return positions(sq.decode(sq.encode(base)))


@query("e9_sq4_encode", f"with {_SQ.format(n=16)} select a.vec_id id, a.pos, a.code * 16 + b.code code from c a join c b on a.vec_id = b.vec_id and b.pos = a.pos + 32")
def _sq4(spark, sf_dir):
    base = embeddings(spark, sf_dir)
    return _trained(base, bits=4).encode(base).select("id", F.posexplode("code").alias("pos", "code"))


@query("e9_sq4_decode", f"with {_SQ.format(n=16)} select vec_id id, pos, round(code / 16 * wide + lo, 6) + 0.0 x from c")
def _sq4_decode(spark, sf_dir):
    base = embeddings(spark, sf_dir)
    sq = _trained(base, bits=4)
    return positions(sq.decode(sq.encode(base)))


@query("e10_sq16", _half_sql("1.0"))
def _sq16(spark, sf_dir):
    base = embeddings(spark, sf_dir)
    sq = _trained(base, bits=16)
    return positions(sq.decode(sq.encode(base)))


@query("e10_sq32", f"with {_L} select vec_id id, pos, round(x, 6) + 0.0 x from l")
def _sq32(spark, sf_dir):
    base = embeddings(spark, sf_dir)
    sq = _trained(base, bits=32)
    return positions(sq.decode(sq.encode(base)))


@query("e11_pca_project")
def _pca(spark, sf_dir):
    base = embeddings(spark, sf_dir)
    pca = codecs.PCA(8)
    pca.train(base)
    return positions(pca.encode(base))


@query("e11_pca_round_trip", f"with {_L} select vec_id id, pos, round(x, 6) + 0.0 x from l")
def _pca_back(spark, sf_dir):
    base = embeddings(spark, sf_dir)
    pca = codecs.PCA(64)
    pca.train(base)
    return positions(pca.decode(pca.encode(base)))


@query("e11_pca_covariance", f"with {_L}, v as (select pos, var_samp(x) v from l group by pos) select round(sum(v), 6) + 0.0 trace, 0.0::double off_diagonal from v")
def _pca_covariance(spark, sf_dir):
    """All components together have the variance of the vectors, and no two of them vary together."""
    base = embeddings(spark, sf_dir)
    pca = codecs.PCA(64)
    pca.train(base)
    _, _, cov = codecs.covariance(pca.encode(base), 64)
    off = float(np.abs(cov - np.diag(np.diag(cov))).max())
    return spark.createDataFrame([(round(float(np.trace(cov)), 6) + 0.0, round(off, 6) + 0.0)], "trace double, off_diagonal double")


# Indexes


@query("e14_residual_decode", f"with {_CELLS}, {_RES} select vec_id id, pos, round(x, 6) + 0.0 x from dec")
def _residual_decode(spark, sf_dir):
    index = grid_index(embeddings(spark, sf_dir), residual=True)
    return positions(index.decode(index.codes))


@query("i3_train")
def _train(spark, sf_dir):
    base = embeddings(spark, sf_dir)
    index = ivf.IVFPQRIndex(16, 64, 16, 20, vq_iter=8, pq_iter=8)
    index.fine.kmeans.max_iter = 8
    index.train(clustering.sampled(base, TRAIN, 11))
    index.add(base)
    index.n_probe, index.use_smart_probing = N_PROBE, False
    return hits(index.search(queries_of(base), 10))


@query("i4_add", f"with {_CELLS}, {_PQ} select vec_id id, cell, sub, code from codes join cells using (vec_id)")
def _add(spark, sf_dir):
    base = embeddings(spark, sf_dir)
    index = index16(base.where("id < 100"))
    index.add(base.where("id >= 100"))
    return codecs.long_codes(index.codes).join(index.codes.select("id", "cell"), "id").select("id", "cell", "sub", "code")


_IVF = ", sc as (select probes.q_id, dec.vec_id id, 0.0 - sum((l.x - dec.x) * (l.x - dec.x)) score from probes join cells using (cell) join dec using (vec_id) join l on l.vec_id = probes.q_id and l.pos = dec.pos{where} group by all)"
_HITS = f", {_RANKED.format(s='score', t='sc')} select q_id, rank, id, round(score, 6) + 0.0 score from r where rank <= 10"


@query("i5_ivfpq_search", f"with {_CELLS}, {_grid('l')}{_PROBES}{_IVF.format(where='')}{_HITS}")
def _ivfpq(spark, sf_dir):
    base = embeddings(spark, sf_dir)
    return hits(grid_index(base).search(queries_of(base), 10))


@query("t4_bounded_search", f"with {_CELLS}, {_grid('l')}{_PROBES.replace(f'<= {N_PROBE}', '<= 16')}{_IVF.format(where='')}{_HITS}")
def _bounded(spark, sf_dir):
    base = embeddings(spark, sf_dir)
    index = grid_index(base, n_probe=16)
    index.bounded = True
    return hits(index.search(queries_of(base), 10))


@query("i6_search_cells", f"with {_CELLS}, {_grid('l')}, probes as (select vec_id q_id, (vec_id // 50 % 16)::integer cell from embeddings where vec_id % 50 = 0 union all select vec_id, ((vec_id // 50 + 3) % 16)::integer from embeddings where vec_id % 50 = 0){_IVF.format(where='')}{_HITS}")
def _search_cells(spark, sf_dir):
    base = embeddings(spark, sf_dir)
    q, n = queries_of(base), F.floor(F.col("q_id") / 50)
    probes = q.select("q_id", F.explode(F.array((n % 16).cast("int"), ((n + 3) % 16).cast("int"))).alias("cell"))
    return hits(grid_index(base).search_cells(q, probes, 10))


_SMART = (
    ", pr as (select * from (select vec_id q_id, cell, dd, row_number() over (partition by vec_id order by round(dd, 12), cell) rank from cd where vec_id % 50 = 0) where rank <= 16)"
    ", sm as (select *, exp(0.0 - sqrt(dd) / 0.1) / sum(exp(0.0 - sqrt(dd) / 0.1)) over (partition by q_id) p from pr)"
    ", np as (select q_id, least(greatest(ceil(round(0.0 - sum(case when p > 0 then p * log2(p) else 0 end) / 4 * 16, 9)), 1), 16) n from sm group by q_id)"
    ", probes as (select pr.q_id, cell, dd, rank from pr join np using (q_id) where rank <= n)"
)


@query("i7_smart_search", f"with {_CELLS}, {_grid('l')}{_SMART}{_IVF.format(where='')}{_HITS}")
def _smart_search(spark, sf_dir):
    base = embeddings(spark, sf_dir)
    index = grid_index(base, n_probe=16, smart=True)
    index.temperature = 0.1
    return hits(index.search(queries_of(base), 10))


@query("i8_residual_search", f"with {_CELLS}, {_RES}{_PROBES}{_IVF.format(where='')}{_HITS}")
def _residual_search(spark, sf_dir):
    base = embeddings(spark, sf_dir)
    return hits(grid_index(base, residual=True).search(queries_of(base), 10))


@query("i9_remove", f"with {_CELLS}, {_grid('l')}{_PROBES}{_IVF.format(where=' where dec.vec_id % 2 = 1')}{_HITS}")
def _index_remove(spark, sf_dir):
    base = embeddings(spark, sf_dir)
    index = grid_index(base)
    index.remove(base.where("id % 2 = 0").select("id"))
    return hits(index.search(queries_of(base), 10))


_AGAIN = " where dec.vec_id % 3 <> 0 or dec.vec_id % 6 = 0 and dec.vec_id % 12 <> 0"


@query("i9_remove_add", f"with {_CELLS}, {_grid('l')}{_PROBES}{_IVF.format(where=_AGAIN)}{_HITS}")
def _index_log(spark, sf_dir):
    """Every third id is removed, every sixth added again, every twelfth removed once more; saved and loaded in between."""
    base, path = embeddings(spark, sf_dir), scratch.folder(spark)
    index = grid_index(base)
    index.remove(base.where("id % 3 = 0").select("id"))
    index.save(path, spark)
    index = ivf.IVFPQIndex.load(path, spark)
    index.add(base.where("id % 6 = 0"))
    index.remove(base.where("id % 12 = 0").select("id"))
    return hits(index.search(queries_of(base), 10))


@query("j12_inverse_map", f"with {_CELLS}, s as (select vec_id id, cell, row_number() over (partition by cell order by vec_id) - 1 slot from cells) select id, cell, slot from s where id % 50 = 0 and id % 100 <> 0")
def _inverse_map(spark, sf_dir):
    base = embeddings(spark, sf_dir)
    index = index16(base)
    index.remove(base.where("id % 100 = 0").select("id"))
    return index.addresses(base.where("id % 50 = 0").select("id"))


@query("t12_packed_search", f"with {_CELLS}, {_PQ}, dec as (select codes.vec_id, pos, c x from codes join cb using (sub, code)){_PROBES}{_IVF.format(where='')}{_HITS}")
def _packed(spark, sf_dir):
    base = embeddings(spark, sf_dir)
    index = ivf.IVFPQIndex(8, 16, n_pq_clusters=16, packed=True)
    index.set_codebooks(seeds(base), seeds(base).reshape(16, 8, 8).transpose(1, 0, 2).copy())
    index.n_probe, index.use_smart_probing = N_PROBE, False
    index.add(base)
    return hits(index.search(queries_of(base), 10))


_LEFT = ", lv as materialized (select l.vec_id, l.pos, cb.c c1, l.x - cb.c x from codes join cb using (sub, code) join l on l.vec_id = codes.vec_id and l.pos = cb.pos), "
_FIRST = (
    ", s1 as (select probes.q_id, lv.vec_id id, 0.0 - sum((l.x - c1) * (l.x - c1)) score from probes join cells using (cell) join lv using (vec_id) join l on l.vec_id = probes.q_id and l.pos = lv.pos group by all)"
    ", f as (select * from (select *, row_number() over (partition by q_id order by round(score, 9) desc, id) rank from s1) where rank <= 100)"
    ", sc as (select f.q_id, f.id, 0.0 - sum((l.x - c1 - dec.x) * (l.x - c1 - dec.x)) score from f join lv on lv.vec_id = f.id join dec on dec.vec_id = f.id and dec.pos = lv.pos join l on l.vec_id = f.q_id and l.pos = lv.pos group by all)"
)


@query("i10_rerank_search", f"with {_CELLS}, {_pq(2, 256)}{_LEFT}{_grid('lv')}{_PROBES}{_FIRST}{_HITS}")
def _rerank(spark, sf_dir):
    base = embeddings(spark, sf_dir)
    book = seeds(base, 256)
    index = ivf.IVFPQRIndex(32, 64, 16, 10)
    index.set_codebooks(seeds(base), book.reshape(len(book), 32, 2).transpose(1, 0, 2).copy())
    index.fine = codecs.PQCodec(64, 256, codebook=grid_book(index.left_over(base)))
    index.n_probe, index.use_smart_probing = N_PROBE, False
    index.add(base)
    return hits(index.search(queries_of(base), 10))


@query("t13_distributed_cells", f"with {_CELLS}, {_grid('l')}{_PROBES}{_IVF.format(where='')}{_HITS}")
def _distributed(spark, sf_dir):
    base, path = embeddings(spark, sf_dir), scratch.folder(spark)
    index = grid_index(base)
    index.save(path, spark)
    return hits(ivf.IVFPQIndex.load(path, spark).search(queries_of(base), 10))


# SQL functions, bits, streaming, volume


@query("f1_sql_functions", f"with {_PAIRS.format(score=_SCORES['l2'])} select q_id, id, round(score, 6) + 0.0 score from p")
def _sql(spark, sf_dir):
    """Every pair scored in SQL alone, by the table function vec_pairs; vec_l2 says the same of one pair."""
    sqlfn.register_vec_pairs(spark)
    base = embeddings(spark, sf_dir)
    base.createOrReplaceTempView("veclode_pair_base")
    base.where("id % 50 = 0").createOrReplaceTempView("veclode_pair_queries")
    return spark.sql(sqlfn.pairs_statement("veclode_pair_base", "veclode_pair_queries", "euclidean")).selectExpr("q_id", "id", "rint(score * 1e6D) / 1e6D + 0.0D as score")


@query("f3_knn_table_function", f"with {_PAIRS.format(score=_SCORES['cosine'])}, {_RANKED.format(s='score', t='p')} select q_id, rank, id, round(score, 6) + 0.0 score from r where rank <= 10")
def _knn_table(spark, sf_dir):
    """Search by the table function vec_knn, in SQL alone."""
    sqlfn.register_vec_knn(spark)
    base = embeddings(spark, sf_dir)
    base.createOrReplaceTempView("veclode_knn_base")
    base.where("id % 50 = 0").createOrReplaceTempView("veclode_knn_queries")
    return hits(spark.sql(sqlfn.knn_statement("veclode_knn_base", "veclode_knn_queries", 10, "cosine")))


@query("f2_nibbles", f"with {_L}, {_PQ} select a.vec_id id, (a.sub // 2)::integer pos, a.code high, b.code low from codes a join codes b on a.vec_id = b.vec_id and b.sub = a.sub + 1 where a.sub % 2 = 0")
def _nibbles(spark, sf_dir):
    base = embeddings(spark, sf_dir)
    pq = codecs.PQCodec(8, 16, codebook=seeds(base).reshape(16, 8, 8).transpose(1, 0, 2).copy(), packed=True)
    bytes_ = codecs.long_codes(pq.encode(base))
    return bytes_.select("id", F.col("sub").alias("pos"), F.shiftright("code", 4).alias("high"), F.col("code").bitwiseAND(F.lit(15)).alias("low"))


def _stream(spark: SparkSession, base: DataFrame, files: int = 3) -> DataFrame:
    """The rows as a stream of `files` files, one a batch, in the order of id % files."""
    path = scratch.folder(spark)
    for i in range(files):
        base.where(F.col("id") % files == i).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(base.schema).option("maxFilesPerTrigger", 1).parquet(path)


@query("st1_stream_kmeans", f"{_batches_sql(4)} select cell, pos, round(c, 6) + 0.0 x, n from cen2 join n2 using (cell)")
def _stream_kmeans(spark, sf_dir):
    base, path = embeddings(spark, sf_dir), scratch.folder(spark)
    incremental.minibatch_kmeans(_stream(spark, base, 2), f"{path}/state", f"{path}/checkpoint", 4, init=seeds(base, 4)).awaitTermination()
    state = incremental.read_state(spark, f"{path}/state")
    return state.select("cell", F.posexplode("centroid").alias("pos", "x"), F.col("n").cast("long").alias("n")).withColumn("x", r6("x"))


@query("st2_stream_index", f"with {_CELLS}, {_PQ} select vec_id id, cell, sub, code from codes join cells using (vec_id) where vec_id % 5 <> 0")
def _stream_index(spark, sf_dir):
    base, path = embeddings(spark, sf_dir), scratch.folder(spark)
    index = index16(base)
    incremental.index_adds(_stream(spark, base), index, path, f"{path}/c1").awaitTermination()
    incremental.index_removes(_stream(spark, base.where("id % 5 = 0").select("id"), 1), path, f"{path}/c2").awaitTermination()
    codes = incremental.live_codes(spark, path)
    return codecs.long_codes(codes).join(codes.select("id", "cell"), "id").select("id", "cell", "sub", "code")


@query("st2_stream_changes", f"with {_CELLS}, {_PQ} select vec_id id, cell, sub, code from codes join cells using (vec_id) where vec_id % 4 <> 0 or vec_id % 8 = 0")
def _stream_changes(spark, sf_dir):
    """Every vector is added at its id; ids divisible by 4 are removed later, and those divisible by 8 added again."""
    base, path = embeddings(spark, sf_dir), scratch.folder(spark)
    own = base.select("id", "vec", F.lit(False).alias("removed"), F.col("id").alias("seq"))
    later = lambda some, removed, at: base.where(f"id % {some} = 0").select("id", "vec", F.lit(removed).alias("removed"), (F.col("id") + at).alias("seq"))
    changes = own.unionByName(later(4, True, 10**6)).unionByName(later(8, False, 2 * 10**6))
    incremental.index_changes(_stream(spark, changes), index16(base), path, f"{path}/c").awaitTermination()
    codes = incremental.live_codes(spark, path)
    return codecs.long_codes(codes).join(codes.select("id", "cell"), "id").select("id", "cell", "sub", "code")


def line_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    key = F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return t.select("*", key.alias("id"), F.array(F.col("l_quantity") / 50, F.col("l_extendedprice") / 100_000, "l_discount", "l_tax").alias("vec"))


_VOLUME = (
    "v as (select row_number() over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) id, [l_quantity / 50, l_extendedprice / 100000, l_discount, l_tax] v from lineitem)"
    ", l as (select id vec_id, i - 1 pos, v[i] x from v, range(1, 5) r(i)), o as (select id, (row_number() over (order by id) - 1)::integer cell from v order by id limit 16)"
    ", cen0 as (select cell, pos, x c from l join o on o.id = l.vec_id)"
)


@query("c2_kmeans_volume", f"with {_VOLUME}, {_lloyd_ctes(3)} select cell, count(*) size from lab2 group by cell")
def _volume(spark, sf_dir):
    df = line_vectors(spark, sf_dir)
    first = np.array([r["vec"] for r in df.orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").limit(16).collect()])
    labels = clustering.KMeans(16, max_iter=3, tol=0.0).fit(df, first)
    return labels.groupBy("cell").agg(F.count("*").alias("size"))


@query("a9_covariance_volume", "with v as (select l_quantity / 50 a, l_extendedprice / 100000 b from lineitem) select round(var_samp(a), 6) aa, round(covar_samp(a, b), 6) ab from v")
def _cov_volume(spark, sf_dir):
    _, _, cov = codecs.covariance(line_vectors(spark, sf_dir), 4)
    return spark.createDataFrame([(round(float(cov[0, 0]), 6), round(float(cov[0, 1]), 6))], "aa double, ab double")


@query("j5_all_neighbours", f"with {_PAIRS.format(score=_SCORES['l2']).replace(' where a.vec_id % 50 = 0', '')}, {_RANKED.format(s='score', t='p')} select q_id, rank, id, round(score, 6) + 0.0 score from r where rank <= 10")
def _all_neighbours(spark, sf_dir):
    base = embeddings(spark, sf_dir).withColumnRenamed("vec", "v")
    return hits(search.knn_join(base, base.withColumnRenamed("id", "q_id"), 10))


@query("c6_joined_labels", "with l as materialized (select vec_id, (i - 1)::integer pos, embedding[i]::double x from embeddings, range(1, 65) r(i)), s as (select a.vec_id, b.vec_id cell, sum((a.x - b.x) * (a.x - b.x)) dd from l a join l b using (pos) where b.vec_id % 10 = 0 group by all) select vec_id id, cell::integer cell from (select *, row_number() over (partition by vec_id order by round(dd, 12), cell) rn from s) where rn = 1")
def _joined_labels(spark, sf_dir):
    """Centroids that grow with the table, every tenth vector: a table joined with the vectors."""
    base = embeddings(spark, sf_dir)
    centroids = base.where("id % 10 = 0").select(F.col("id").alias("cell"), "vec")
    return clustering.nearest_joined(base, centroids, 1).select(F.col("q_id").alias("id"), "cell")
