"""Operators against numpy, and the properties of stores and indexes."""

import os
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veclode.functions import metrics as M
from veclode.functions import sqlfn
from veclode.operators import clustering, codecs, ivf, search
from veclode.plans import catalog
from veclode.sources import persist, store
from veclode.streaming import incremental

METRICS = ["euclidean", "inner", "cosine", "manhattan"]


def frame(spark, x, start=0):
    return spark.createDataFrame([(i + start, [float(e) for e in v]) for i, v in enumerate(x)], "id long, vec array<double>").repartition(3)


def as_queries(df):
    return df.select(F.col("id").alias("q_id"), F.col("vec").alias("q_vec"))


@pytest.fixture(scope="module")
def x():
    return np.random.default_rng(0).normal(size=(300, 8))


@pytest.fixture(scope="module")
def df(spark, x):
    out = frame(spark, x).cache()
    out.count()
    return out


def found(out):
    return [(r["q_id"], r["rank"], r["id"]) for r in out.orderBy("q_id", "rank").collect()]


@pytest.mark.parametrize("metric", METRICS)
def test_knn_paths_agree_with_numpy(df, x, metric, monkeypatch):
    q = as_queries(df.where("id < 12"))
    s = np.stack([M.direct(metric, np.repeat(x[i : i + 1], len(x), 0), x) for i in range(12)])
    want = [(i, n + 1, int(j)) for i in range(12) for n, j in enumerate(np.lexsort((np.arange(len(x)), -np.round(s[i], 9)))[:7])]
    assert found(search.knn(df, q, 7, metric)) == want
    assert found(search.knn_expr(df, q, 7, metric)) == want
    monkeypatch.setattr(search, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(search, "TILE", 50)
    assert found(search.knn(df, q, 7, metric)) == want


@pytest.mark.parametrize("metric", METRICS)
def test_all_vectors_against_all_with_a_hot_cell(spark, metric, monkeypatch):
    """Clusters far apart, and one vector that a third of the rows repeat: rows reach few cells, tasks see bounded parts."""
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(25, 1, 4)) * 50 + rng.normal(size=(25, 16, 4)), np.zeros((1, 1, 4)) + np.full((1, 200, 4), 3.0)], axis=None).reshape(-1, 4)
    monkeypatch.setattr(search, "TILE", 64)
    monkeypatch.setattr(search, "SHARD", 32)
    monkeypatch.setattr(search, "FAN", 2)
    seen, sent = [], search.sent
    monkeypatch.setattr(search, "sent", lambda rows, space, reach: seen.append(sent(rows, space, reach)) or seen[-1])
    base = frame(spark, x).withColumnRenamed("vec", "v")
    out = search.knn_join(base, base.withColumnRenamed("id", "q_id"), 3, metric)
    s = np.stack([M.direct(metric, np.repeat(x[i : i + 1], len(x), 0), x) for i in range(len(x))])
    assert found(out) == [(i, n + 1, int(j)) for i in range(len(x)) for n, j in enumerate(np.lexsort((np.arange(len(x)), -np.round(s[i], 9)))[:3])]
    cells = int(len(x) ** 0.5)
    moved = seen[0].agg(F.sum(F.size("cells"))).first()[0]
    if metric in ("euclidean", "manhattan"):
        assert moved < 0.2 * cells * len(x)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_vectors_without_clusters_are_not_sent_to_every_cell(spark):
    """Bounds spare nothing here: a copy of the base for each of 44 cells would be 45 MB."""
    x = np.random.default_rng(6).normal(size=(2000, 64))
    base = frame(spark, x).withColumnRenamed("vec", "v").cache()
    base.count()
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    before = written()
    out = found(search.knn_join(base, base.withColumnRenamed("id", "q_id"), 3))
    assert written() - before < 7e6
    s = M.matrix("euclidean", x, x)
    assert out == [(i, n + 1, int(j)) for i in range(len(x)) for n, j in enumerate(np.lexsort((np.arange(len(x)), -np.round(s[i], 9)))[:3])]


@pytest.mark.parametrize("metric", METRICS)
def test_cells_and_a_grid_in_one_join(spark, metric, monkeypatch):
    """Tight clusters go by their cells, what lies everywhere by a grid of many blocks and shards; copies are in both."""
    rng = np.random.default_rng(7)
    x = np.concatenate([np.repeat(rng.normal(size=(12, 6)) * 200, 20, 0) + rng.normal(size=(240, 6)) * 0.01, rng.normal(size=(240, 6)) * 100, np.full((30, 6), 5.0)])
    for name, value in (("TILE", 16), ("SHARD", 32), ("FAN", 2), ("SIDE_BYTES", 70 * 48), ("STEP", (16, 24))):
        monkeypatch.setattr(search, name, value)
    base = frame(spark, x).withColumnRenamed("vec", "v")
    out = search.knn_join(base, base.withColumnRenamed("id", "q_id"), 4, metric)
    s = np.stack([M.direct(metric, np.repeat(x[i : i + 1], len(x), 0), x) for i in range(len(x))])
    assert found(out) == [(i, n + 1, int(j)) for i in range(len(x)) for n, j in enumerate(np.lexsort((np.arange(len(x)), -np.round(s[i], 9)))[:4])]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    if metric in ("euclidean", "manhattan"):
        assert "Union" in plan


@pytest.mark.parametrize("metric", METRICS)
def test_single_precision_decides_nothing(metric):
    rng = np.random.default_rng(8)
    sets = [
        rng.normal(size=(5000, 8)), np.repeat(rng.normal(size=(40, 8)), 125, 0), rng.normal(size=(1, 8)) + 1e-7 * rng.normal(size=(5000, 8)), 1e6 + rng.normal(size=(5000, 8)),
        1e-30 * rng.normal(size=(5000, 8)), 1e150 * rng.normal(size=(5000, 8)), rng.integers(0, 3, size=(5000, 4)).astype(float), np.zeros((3000, 3)), rng.normal(size=(4, 3)), np.zeros((50, 0)),
        np.concatenate([rng.normal(size=(2500, 8)), 1e9 * rng.normal(size=(2500, 8))]),
    ]
    for x in sets:
        ids, q = rng.permutation(len(x)), x[:: max(1, len(x) // 40)]
        got = [[] for _ in q]
        for rows, near, score in search.nearest(metric, 5, 9, q, ids, x):
            for r, i, s in zip(rows, near, search._rounded(score, 9), strict=True):
                got[r].append((-s, int(i)))
        s = np.stack([search._rounded(M.direct(metric, np.repeat(v[None], len(x), 0), x), 9) for v in q])
        assert [[i for _, i in sorted(g)[:5]] for g in got] == [[int(ids[j]) for j in np.lexsort((ids, -row))[:5]] for row in s]
        assert max(len(g) for g in got) <= 5 + search.SLACK


def test_the_join_of_neighbours_at_the_edges(spark):
    rows = [(1, [0.0, 1.0]), (1, [0.0, 1.0]), (2, None), (3, [float("nan"), 0.0]), (4, [1.0]), (5, [2.0, 2.0]), (None, [0.0, 0.0])]
    base = spark.createDataFrame(rows, "id long, v array<double>")
    asked = base.withColumnRenamed("id", "q_id").where("q_id is null or q_id in (2, 4, 5)")
    out = search.knn_join(base, asked, 9)
    assert sorted((r["q_id"], r["rank"], r["id"]) for r in out.collect()) == [(4, 1, 4), (5, 1, 5), (5, 2, 1), (5, 3, 1)]
    for a, b in ((base.limit(0), asked), (base, asked.limit(0))):
        assert search.knn_join(a, b, 3).count() == 0


def test_ties_go_to_the_smaller_id_and_padding(spark):
    base = frame(spark, [[0, 0], [1, 0], [0, 1], [-1, 0], [0, -1]] * 4)
    q = as_queries(frame(spark, [[0.0, 0.0]]))
    assert found(search.knn(base, q, 6)) == [(0, n + 1, i) for n, i in enumerate([0, 5, 10, 15, 1, 2])]
    out = search.padded(search.knn(base.where("id = 3"), q, 3), q, 3).orderBy("rank").collect()
    assert [(r["id"], r["score"]) for r in out] == [(3, -1.0), (-1, float("-inf")), (-1, float("-inf"))]
    assert search.knn(base.limit(0), q, 3).count() == 0 and search.knn(base, q.limit(0), 3).count() == 0


@pytest.mark.parametrize("metric", METRICS)
def test_expressions_equal_numpy(spark, df, x, metric):
    pairs = search.scored_pairs(df.crossJoin(as_queries(df.where("id < 3"))), metric).collect()
    assert all(r["score"] == pytest.approx(M.direct(metric, x[r["q_id"]][None], x[r["id"]][None])[0], abs=1e-9) for r in pairs)


def test_half_precision(spark):
    x = np.array([[1.0, 1 / 3, -2.7182818, 65504.0, 6.1e-5, 0.0, 1000.123, -0.1]])
    (r,) = frame(spark, x).select(M.half(F.col("vec")).alias("v")).collect()
    assert r["v"] == x.astype(np.float16).astype(float)[0].tolist()


def lloyd(x, c, steps):
    for _ in range(steps):
        label = np.argmin(((x[:, None] - c) ** 2).sum(-1), 1)
        c, before = np.stack([x[label == k].mean(0) if (label == k).any() else np.zeros(x.shape[1]) for k in range(len(c))]), c
    return c, label, ((x - before[label]) ** 2).sum(1).mean(), ((c - before) ** 2).sum()


def test_kmeans_is_lloyd_with_zero_for_empty_clusters(df, x):
    seeds = np.concatenate([x[:5], [[1e6] * 8]])
    km = clustering.KMeans(6, max_iter=3, tol=0.0)
    labels = {r["id"]: r["cell"] for r in km.fit(df, seeds).collect()}
    c, label, inertia, error = lloyd(x, seeds, 3)
    assert np.allclose(km.centroids[0], c) and km.inertia == pytest.approx(inertia) and km.error == pytest.approx(error)
    assert [labels[i] for i in range(len(x))] == label.tolist()
    assert {r["id"]: r["cell"] for r in km.predict(df).collect()}[0] == np.argmin(((x[0] - c) ** 2).sum(1))
    assert [r["cell"] for r in km.topk(df.where("id = 0"), 6).orderBy("rank").collect()] == np.argsort(((x[0] - c) ** 2).sum(1)).tolist()


@pytest.mark.parametrize("metric", METRICS)
def test_kmeans_of_every_metric_converges(df, metric):
    km = clustering.KMeans(4, n_redo=2, max_iter=30, distance=metric, init_mode="kmeans++")
    assert km.fit(df).select("cell").distinct().count() > 1
    again = clustering.KMeans(4, n_redo=2, max_iter=30, distance=metric, init_mode="kmeans++")
    again.fit(df)
    assert np.allclose(km.centroids, again.centroids)


def test_multi_kmeans_uses_every_item(df, x):
    km = clustering.MultiKMeans(2, 3, max_iter=2, tol=0.0)
    seeds = x[:3].reshape(3, 2, 4).transpose(1, 0, 2)
    cells = {r["id"]: r["cells"] for r in km.fit(df, seeds).collect()}
    for p in range(2):
        c, label, _, _ = lloyd(x[:, p * 4 : p * 4 + 4], seeds[p], 2)
        assert np.allclose(km.centroids[p], c) and [cells[i][p] for i in range(len(x))] == label.tolist()


def test_minibatch_reports_error_and_keeps_idle_centroids(df, x):
    seeds = np.concatenate([x[:3], [[1e6] * 8]])
    km, strict = clustering.MinibatchKMeans(4), clustering.MinibatchKMeans(4, strict_reference=True)
    km.fit_minibatch(df, seeds)
    strict.fit_minibatch(df, seeds)
    assert km.error > 0 and (km.centroids[3] == 1e6).all() and (strict.centroids[3] == 0).all()
    first = km.centroids.copy()
    km.fit_minibatch(df)
    label = np.argmin(((x[:, None] - first) ** 2).sum(-1), 1)
    n = 1 + np.bincount(np.argmin(((x[:, None] - seeds) ** 2).sum(-1), 1), minlength=4)
    want = np.stack([first[k] + (x[label == k].mean(0) - first[k]) / n[k] if (label == k).any() else first[k] for k in range(4)])
    assert np.allclose(km.centroids, want)


def test_product_quantizer(df, x):
    book = x[:16].reshape(16, 4, 2).transpose(1, 0, 2).copy()
    pq = codecs.PQCodec(4, 16, codebook=book)
    codes = {r["id"]: np.frombuffer(r["code"], np.uint8) for r in pq.encode(df).collect()}
    want = np.stack([np.argmin(((x.reshape(-1, 4, 1, 2)[:, s] - book[s]) ** 2).sum(-1), 1) for s in range(4)], 1)
    assert all((codes[i] == want[i]).all() for i in codes)
    back = {r["id"]: r["vec"] for r in pq.decode(pq.encode(df)).collect()}
    assert np.allclose(back[7], np.concatenate([book[s, want[7, s]] for s in range(4)]))
    trained = codecs.PQCodec(4, 32, max_iter=8)
    trained.train(df)
    errors = [((np.array(r["vec"]) - x[r["id"]]) ** 2).sum() for r in trained.decode(trained.encode(df)).collect()]
    assert np.mean(errors) < 0.4 * x.var(0).sum()


@pytest.mark.parametrize(("bits", "most"), [(4, 1 / 16), (8, 1 / 256), (16, 1e-3), (32, 0)])
@pytest.mark.parametrize("mode", ["minmax", "meanstd"])
def test_scalar_quantizer_error_is_bounded(df, x, bits, most, mode):
    sq = codecs.SQCodec(bits, alpha=6.0, mode=mode)
    sq.train(df)
    for r in sq.decode(sq.encode(df)).collect():
        bound = np.array(sq.range) * most if bits < 16 else np.abs(x[r["id"]]) * most
        assert (np.abs(np.array(r["vec"]) - x[r["id"]]) <= bound + 1e-12).all()


def test_pca(df, x):
    shifted = df.withColumn("vec", F.transform("vec", lambda e: e + 1e6))
    n, mean, cov = codecs.covariance(shifted, 8)
    assert n == 300 and np.allclose(mean, x.mean(0) + 1e6) and np.allclose(cov, np.cov(x.T), atol=1e-8)
    pca = codecs.PCA(3)
    pca.train(df)
    y = np.array([r["vec"] for r in pca.encode(df).orderBy("id").collect()])
    assert np.allclose(np.cov(y.T), np.diag(pca.variances)) and np.allclose(sorted(np.linalg.eigvalsh(np.cov(x.T)))[-3:][::-1], pca.variances)


def flat(df):
    return df.withColumn("address", F.col("id"))


def test_flat_store_round_trip(spark, df, x):
    half = flat(df).where("id < 150")
    full = store.flat_add(half, df.where("id >= 150"))
    assert sorted(r["address"] for r in full.collect()) == list(range(300))
    ids = df.where("id % 2 = 0").select("id")
    left = store.flat_remove(full, ids.unionByName(spark.range(10**6, 10**6 + 3)))
    assert sorted(r["address"] for r in left.collect()) == list(range(150))
    looked = {r["id"]: r["address"] for r in store.address_of(left, df.select("id")).collect()}
    assert all((looked[i] == -1) == (i % 2 == 0) for i in range(300))
    back = store.get_by_address(left, left.select("address"), 8).join(left.select("address", "id"), "address").collect()
    assert all(np.allclose(r["vec"], x[r["id"]]) for r in back)
    again = store.flat_add(left, df.where("id % 2 = 0"))
    assert again.count() == 300 and again.select("address").distinct().count() == 300


def test_sparse_ids_and_auto_ids(spark, df):
    big = df.withColumn("id", F.col("id") + F.lit(2**62))
    new = store.with_auto_ids(df.where("id < 5").withColumnRenamed("id", "src"), big, ["src"])
    assert sorted(r["id"] for r in new.collect()) == [2**62 + 300 + i for i in range(5)]
    assert [r["id"] for r in store.with_auto_ids(df.where("id < 2").withColumnRenamed("id", "src"), df.limit(0), ["src"]).orderBy("id").collect()] == [0, 1]
    assert store.remove(big, big.where("id % 2 = 0").select("id")).count() == 150


def test_cell_store_fills_holes_first(spark, df):
    rows = df.where("id < 90").withColumn("cell", (F.col("id") % 3).cast("int"))
    slots = store.index_of_appearance(rows, "id").withColumnRenamed("ioa", "slot").select("cell", "slot", "id", "vec")
    holes = store.remove(slots, slots.where("id % 2 = 0").select("id"))
    new = df.where("id >= 200 and id < 260").withColumn("cell", (F.col("id") % 3).cast("int"))
    out = store.cell_add(holes, new)
    for cell in range(3):
        own = sorted(r["slot"] for r in out.where(F.col("cell") == cell).collect())
        assert own == list(range(len(own)))
    assert out.count() == 45 + 60
    assert store.truncate(out).count() == 0


@pytest.mark.parametrize("name", ["u1_cell_add", "w2_write_slots"])
def test_cells_of_any_id_equal_sql(spark, tmp_path, name):
    """Ids beyond 2^53, which doubles round, negative, repeated and null ones."""
    con = duckdb.connect()
    ids = [None, None, 0, 0, 1, 1, 2, 3, 3, 3, 6, 7, -1, -2, -3, -4, -8, *range(2**53 - 5, 2**53 + 30), *range(2**63 - 20, 2**63)]
    con.execute("create table embeddings as select unnest(?::bigint[]) vec_id, [0.5, 1]::float[] embedding", [ids])
    con.execute(f"copy embeddings to '{tmp_path}/embeddings.parquet'")
    got = catalog.QUERIES[name](spark, str(tmp_path)).select("id", "cell", "slot").collect()
    assert sorted(map(tuple, got)) == sorted(con.sql(catalog.ORACLE_SQL[name]).fetchall())


def test_unknown_ids_and_updates(spark, df, x):
    got = {r["id"]: r["vec"] for r in store.get_by_id(df, spark.range(298, 303), 8).collect()}
    assert np.allclose(got[299], x[299]) and got[301] == [0.0] * 8
    changed = store.update(df, df.where("id = 3").select("id", F.array_repeat(F.lit(7.0), 8).alias("vec")), "id")
    assert {r["id"]: r["vec"] for r in changed.collect()}[3] == [7.0] * 8 and changed.count() == 300
    with pytest.raises(TypeError):
        store.check_schema(df, id="int")


@pytest.mark.parametrize("residual", [False, True])
@pytest.mark.parametrize("metric", ["euclidean", "inner", "cosine"])
def test_full_probe_equals_brute_force_over_decoded(spark, df, residual, metric):
    index = ivf.IVFPQIndex(4, 6, metric, residual, 16, vq_iter=4, pq_iter=4)
    index.train(df)
    index.add(df.where("id < 200"))
    index.add(df.where("id >= 200"))
    index.n_probe, index.use_smart_probing = 6, False
    q = as_queries(df.where("id < 15"))
    if metric == "cosine":
        q = q.withColumn("q_vec", M.normalize(F.col("q_vec")))
    want = search.knn(index.decode(index.codes), q, 5, "euclidean" if residual else "inner" if metric == "cosine" else metric)
    assert found(index.search(as_queries(df.where("id < 15")), 5)) == found(want)


def test_recall_grows_with_probes_and_reranking(df):
    q = as_queries(df.where("id < 40"))
    truth = {(r["q_id"], r["id"]) for r in search.knn(df, q, 5).collect()}

    def recall(index):
        return len(truth & {(r["q_id"], r["id"]) for r in index.search(q, 5).collect()}) / len(truth)

    index = ivf.IVFPQRIndex(4, 4, 8, 4, 16)
    index.train(df)
    index.add(df)
    index.use_smart_probing = False
    values = []
    for n in (1, 3, 8):
        index.n_probe = n
        values.append(recall(index))
    plain = ivf.IVFPQIndex(4, 8, n_pq_clusters=16)
    plain.set_codebooks(index.vq.codebook, index.pq.codebook)
    plain.add(df)
    plain.n_probe, plain.use_smart_probing = 8, False
    assert values == sorted(values) and values[-1] > recall(plain) and values[-1] > 0.8


def test_smart_probing_prunes_and_clamps(spark):
    def probes(scores):
        return spark.createDataFrame([(0, i + 1, i, float(s)) for i, s in enumerate(scores)], "q_id long, rank int, cell int, score double")

    assert ivf.smart_probes(probes([-4.0] * 8), 8).count() == 8
    assert ivf.smart_probes(probes([-100.0] + [-90000.0] * 7), 8, 1.0).count() == 1
    assert ivf.smart_probes(probes([-1.0]), 1).count() == 1


def test_removed_items_are_not_found_and_do_not_hide_others(df):
    index = ivf.IVFPQIndex(4, 4, n_pq_clusters=16, vq_iter=3, pq_iter=3)
    index.train(df)
    index.add(df)
    index.remove(df.where("id < 250").select("id"))
    index.n_probe, index.use_smart_probing = 4, False
    hits = index.search(as_queries(df.where("id < 5")), 50).collect()
    assert len(hits) == 250 and all(r["id"] >= 250 for r in hits)


def test_index_survives_saving(spark, df, tmp_path):
    index = ivf.IVFPQIndex(4, 4, residual=True, n_pq_clusters=16, vq_iter=3, pq_iter=3)
    index.train(df)
    index.add(df)
    index.n_probe = 3
    index.save(str(tmp_path / "i"), spark)
    q = as_queries(df.where("id < 5"))
    assert found(ivf.IVFPQIndex.load(str(tmp_path / "i"), spark).search(q, 5)) == found(index.search(q, 5))
    (version,) = (tmp_path / "i").glob("v-*")
    spark.range(3).write.mode("overwrite").parquet(str(version / "codes"))
    with pytest.raises(ValueError):
        persist.load(str(tmp_path / "i"), spark)


def test_streams(spark, df, x, tmp_path):
    for i in range(3):
        df.where(F.col("id") % 3 == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    incremental.minibatch_kmeans(stream, str(tmp_path / "s"), str(tmp_path / "c"), 4, init=x[:4]).awaitTermination()
    state = incremental.read_state(spark, str(tmp_path / "s"))
    assert state.agg(F.sum("n")).first()[0] == 304 and state.first()["batch"] == 2
    assert incremental.read_state(spark, str(tmp_path / "s"), before=1).first()["batch"] == 0
    index = ivf.IVFPQIndex(4, 4, n_pq_clusters=16)
    index.set_codebooks(x[:4], x[:16].reshape(16, 4, 2).transpose(1, 0, 2).copy())
    incremental.index_adds(stream, index, str(tmp_path / "x"), str(tmp_path / "c1")).awaitTermination()
    incremental.index_adds(stream, index, str(tmp_path / "x"), str(tmp_path / "c2")).awaitTermination()  # a replay overwrites
    assert incremental.live_codes(spark, str(tmp_path / "x")).count() == 300


def test_sql_functions(spark, df, x):
    sqlfn.register(spark)
    pq = codecs.PQCodec(4, 16, codebook=x[:16].reshape(16, 4, 2).transpose(1, 0, 2).copy())
    sqlfn.register_pq(spark, pq)
    df.createOrReplaceTempView("v")
    r = spark.sql("select vec_dot(vec, vec) d, vec_l2(vec, vec) e, vec_l1(vec, vec) m, vec_cosine(vec, vec) c, vec_normalize(vec) n, pq_decode(pq_encode(vec)) p from v where id = 3").first()
    assert r["d"] == pytest.approx(x[3] @ x[3]) and r["e"] == 0 and r["m"] == 0 and r["c"] == pytest.approx(1, abs=1e-6)
    assert np.allclose(r["n"], x[3] / np.linalg.norm(x[3])) and np.allclose(r["p"], pq.decoded(pq.codes(x[3:4]))[0])
    near = sqlfn.knn(spark, "v", x[3].tolist(), 4).collect()
    assert [r["id"] for r in near] == np.argsort(((x - x[3]) ** 2).sum(1))[:4].tolist()


@pytest.mark.parametrize("metric", ["euclidean", "cosine", "inner", "manhattan"])
def test_vec_knn_over_many_pieces(spark, df, x, metric):
    sqlfn.register_vec_knn(spark)
    df.withColumn("score", F.lit("no score")).createOrReplaceTempView("kb")
    df.where("id % 3 = 0").createOrReplaceTempView("kq")
    want = {(r["q_id"], r["rank"], r["id"], round(r["score"], 6)) for r in search.knn(df, df.where("id % 3 = 0").select(F.col("id").alias("q_id"), F.col("vec").alias("q_vec")), 7, metric).collect()}
    for shard, tile in ((8192, 4096), (40, 9)):
        got = spark.sql(sqlfn.knn_statement("kb", "kq", 7, metric, shard, tile)).collect()
        assert len(got) == len(want) == 700 and {(r["q_id"], r["rank"], r["id"], round(r["score"], 6)) for r in got} == want


def test_vec_knn_defined_cases(spark):
    sqlfn.register_vec_knn(spark)
    nan = float("nan")
    rows = [(1, [0.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [None, 1.0]), (None, [0.0, 0.0]), (6, []), (7, [1.0]), (8, [0.0, 1.0])]
    spark.createDataFrame(rows, "id long, vec array<float>").createOrReplaceTempView("kb")
    spark.createDataFrame([(1, [0.0, 0.0]), (1, [0.0, 0.0]), (9, [2.0]), (10, None), (None, [0.0, 0.0])], "id int, vec array<float>").createOrReplaceTempView("kq")
    for shard, tile in ((8192, 4096), (2, 1)):
        got = spark.sql(sqlfn.knn_statement("kb", "kq", 4, "euclidean", shard, tile)).collect()
        assert sorted((r["q_id"], r["rank"], r["id"], r["score"]) for r in got) == [(1, 1, 1, 0.0), (1, 2, 1, 0.0), (1, 3, 2, -1.0), (1, 4, 2, -1.0), (9, 1, 7, -1.0)]
    spark.sql("select * from kb where id > 100").createOrReplaceTempView("none")
    assert spark.sql(sqlfn.knn_statement("none", "kq", 4)).count() == 0 and spark.sql(sqlfn.knn_statement("kb", "none", 4)).count() == 0
    with pytest.raises(Exception, match="k is 1 or more"):
        spark.sql("select * from vec_knn(TABLE(select true is_query, id, vec from kb), 0, 'l2')").collect()
    with pytest.raises(Exception, match="is_query"):
        spark.sql("select * from vec_knn(TABLE(select id, vec from kb), 2, 'l2')").collect()
    with pytest.raises(ValueError, match="no such metric"):
        sqlfn.knn_statement("kb", "kq", 2, "none")


@pytest.mark.parametrize("conf", [{}, {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "1m", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}, {"spark.sql.adaptive.enabled": "false"}])
def test_numbers_are_dense_over_many_partitions(spark, conf):
    old = {k: spark.conf.get(k, None) for k in (*conf, "spark.sql.shuffle.partitions")}
    try:
        for k, v in (conf | {"spark.sql.shuffle.partitions": "64"}).items():
            spark.conf.set(k, v)
        n = 200_000
        rows = spark.range(n).select(((F.col("id") * 7919) % n).alias("src"), F.array_repeat(F.col("id").cast("double"), 16).alias("vec"))
        out = store.with_auto_ids(rows, None, ["src"])
        r = out.agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.sum((F.col("id") != F.col("src")).cast("int")).alias("wrong")).first()
        assert (r["n"], r["ids"], r["wrong"]) == (n, n, 0)
        full = store.flat_add(rows.limit(0).selectExpr("src as address", "src as id", "vec"), rows.withColumnRenamed("src", "id"))
        left = store.flat_remove(full, spark.range(0, n, 3))
        r = left.agg(F.count("*").alias("n"), F.countDistinct("address").alias("a"), F.min("address").alias("low"), F.max("address").alias("high"), F.sum((F.col("id") % 3 == 0).cast("int")).alias("bad")).first()
        m = n - len(range(0, n, 3))
        assert (r["n"], r["a"], r["low"], r["high"], r["bad"]) == (m, m, 0, m - 1, 0)
        tied = store.numbered(rows.withColumn("one", F.lit(1)), ["one"], "n")
        assert tied.agg(F.countDistinct("n")).first()[0] == n
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_numbers_within_a_group_that_holds_nearly_all_rows(spark, monkeypatch):
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        n = 40_000
        rows = spark.range(n).select(((F.col("id") * 7919) % n).alias("pos"), F.when(F.col("id") % 400 == 0, F.col("id") % 1200).when(F.col("id") % 401 == 0, None).otherwise(7).cast("int").alias("cell"))
        plain = store.W.partitionBy("cell").orderBy("pos")
        out = store.index_of_appearance(rows.repartition(5))
        wrong = out.withColumn("want", F.row_number().over(plain) - 1).where("ioa <> want").count()
        assert wrong == 0 and out.count() == n
        windows = re.findall(r"Window \[row_number.*", out._jdf.queryExecution().executedPlan().toString())
        assert windows and all("_p#" in w for w in windows)
        assert store.index_of_appearance(rows.limit(0)).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_core_seeds_cover_like_serial_ones(spark, monkeypatch):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(6000, 4)) * np.array([8, 1, 1, 0.1])
    df = frame(spark, v).unionByName(spark.createDataFrame([(9001, None), (9002, [1.0]), (9003, [float("nan")] * 4)], "id long, vec array<double>")).repartition(6)

    def radius(seeds):
        return np.sqrt(((v[:, None] - seeds[None]) ** 2).sum(-1).min(1).max())

    serial = v[clustering._greedy("euclidean", v, np.arange(len(v)), 256)]
    seeds = clustering.core_seeds(df, 256)
    monkeypatch.setattr(clustering, "CORE", 600)
    tree = clustering.core_seeds(df, 256)
    assert seeds.shape == tree.shape == (256, 4) and len(np.unique(seeds, axis=0)) == 256
    assert radius(seeds) <= 2 * radius(serial) and radius(tree) <= 2 * radius(serial)
    assert clustering.core_seeds(df.limit(0), 5).shape == (0, 0) and clustering.core_seeds(frame(spark, v[:3]), 5).shape == (3, 4)


def test_group_store(spark, df, x):
    group = df.select("id", F.slice("vec", 1, 3).alias("vec_0"), F.slice("vec", 4, 5).alias("vec_1"))
    full = store.flat_add(group.where("id < 100").withColumn("address", F.col("id")).select("address", "id", "vec_0", "vec_1"), group.where("id >= 100"))
    assert sorted((r["address"], r["id"]) for r in full.collect()) == [(i, i) for i in range(300)]
    changed = store.update(full, df.where("id in (3, 5)").select("id", F.array_repeat(F.lit(9.0), 5).alias("vec_1")), "id")
    got = {r["id"]: r for r in store.get_by_id(changed, spark.range(2, 7).unionByName(spark.range(900, 901)), {"vec_0": 3, "vec_1": 5}).collect()}
    assert got[3]["vec_1"] == [9.0] * 5 and np.allclose(got[3]["vec_0"], x[3][:3]) and np.allclose(got[4]["vec_1"], x[4][3:])
    assert got[900]["vec_0"] == [0.0] * 3 and got[900]["vec_1"] == [0.0] * 5
    left = store.flat_remove(full, df.where("id % 2 = 0").select("id"))
    assert sorted(r["address"] for r in left.collect()) == list(range(150)) and left.columns == full.columns
    back = store.get_by_address(left, left.select("address"), {"vec_0": 3, "vec_1": 5}).join(left.select("address", "id"), "address").collect()
    assert all(np.allclose(r["vec_0"] + r["vec_1"], x[r["id"]]) for r in back)


def test_cell_of_address(spark):
    starts = spark.createDataFrame([(4, 0, 3), (7, 3, 0), (2, 3, 5), (9, 10, 2)], "cell int, start long, capacity long")
    out = {r["address"]: r["cell"] for r in store.cell_of_address(spark.range(-2, 15).withColumnRenamed("id", "address"), starts).collect()}
    assert out == {a: 4 if 0 <= a < 3 else 2 if 3 <= a < 8 else 9 if 10 <= a < 12 else -1 for a in range(-2, 15)}
    assert {r["cell"] for r in store.cell_of_address(spark.range(3).withColumnRenamed("id", "address"), starts.limit(0)).collect()} == {-1}


def awkward(spark, x):
    """Vectors that cannot be compared among those that can."""
    rows = [(i, [float(e) for e in v]) for i, v in enumerate(x)]
    n = len(rows)
    bad = [None, [], [1.0] * (x.shape[1] - 1), [None] * x.shape[1], [float("nan")] * x.shape[1], [float("inf")] + [0.0] * (x.shape[1] - 1)]
    return spark.createDataFrame(rows + [(n + i, v) for i, v in enumerate(bad)] + [(None, rows[0][1])], "id long, vec array<double>").repartition(3), n


def test_vectors_that_cannot_be_compared_take_no_part(spark, x):
    df, n = awkward(spark, x[:60])
    good = df.where(f"id < {n}")
    q = as_queries(df.where(f"id < 4 or id >= {n}"))
    want = found(search.knn(good, as_queries(good.where("id < 4")), 5))
    assert [f for f in found(search.knn(df.where("id is not null"), q, 5)) if f[0] < 4] == want
    short = found(search.knn(df.where("id is not null"), q, 5))
    assert [f for f in short if f[0] >= 4] == [(n + 1, 1, n + 1), (n + 2, 1, n + 2)]  # the empty and the shorter one meet themselves
    assert clustering.assign(df, x[:5]).count() == n + 1
    km, plain = clustering.KMeans(4, max_iter=3, tol=0.0), clustering.KMeans(4, max_iter=3, tol=0.0)
    km.fit(df.where("id is not null"), x[:4])
    plain.fit(good, x[:4])
    assert np.allclose(km.centroids, plain.centroids) and clustering.KMeans(4, max_iter=2, init_mode="kmeans++").fit(df).count() == n + 1
    means = clustering.grouped_means(df.withColumn("g", F.lit(1)), "g", x.shape[1]).first()
    assert means["n"] == n + 1 and np.allclose(means["mean"], np.concatenate([x[:60], x[:1]]).mean(0))
    for codec in (codecs.PQCodec(4, 8, max_iter=2), codecs.SQCodec(8), codecs.PCA(3), codecs.VQCodec(4, max_iter=2)):
        codec.train(df)
        assert codec.decode(codec.encode(df)).count() == n + 1
    index = ivf.IVFPQRIndex(4, 4, 3, 2, 8, vq_iter=2, pq_iter=2)
    index.train(df)
    index.add(df)
    index.n_probe, index.use_smart_probing = 3, False
    assert index.codes.count() == n + 1 and {r["q_id"] for r in index.search(q, 2).collect()} == {0, 1, 2, 3}
    empty = df.limit(0)
    index.add(empty)
    assert index.search(as_queries(empty), 3).count() == 0 and search.knn(empty, q, 3).count() == 0 and clustering.assign(empty, x[:3]).count() == 0


def test_repeated_ids_in_an_index(spark, x):
    df = frame(spark, x[:40]).unionByName(frame(spark, x[40:50]))  # ids 0 to 9 twice
    index = ivf.IVFPQIndex(4, 3, residual=True, n_pq_clusters=16, vq_iter=2, pq_iter=2)
    index.train(df)
    assert index.add(df).count() == 50 and index.decode(index.codes).count() == 50
    rows = index.rows.select("cell", "slot").collect()
    assert len(set(rows)) == 50 and sorted(r["slot"] for r in rows if r["cell"] == 0) == list(range(sum(r["cell"] == 0 for r in rows)))


def test_addresses(spark, df, x):
    index = ivf.IVFPQIndex(4, 5, n_pq_clusters=16, vq_iter=3, pq_iter=3)
    index.train(df)
    index.add(df.where("id < 100"))
    added = index.add(df.where("id >= 100"))
    assert added.count() == 200 and index.rows.select("cell", "slot").distinct().count() == 300
    index.n_probe, index.use_smart_probing = 5, False
    q = as_queries(df.where("id < 6"))
    hits = index.search(q, 4, return_address=True)
    plain = {(r["q_id"], r["rank"]): (r["id"], round(r["score"], 9)) for r in index.search(q, 4).collect()}
    assert {(r["q_id"], r["rank"]): (r["id"], round(r["score"], 9)) for r in hits.collect()} == plain
    by_address = {(r["q_id"], r["cell"], r["slot"]): r["score"] for r in index.similarity_at_address(q, hits.select("q_id", "cell", "slot")).collect()}
    by_id = {(r["q_id"], r["id"]): r["score"] for r in index.similarity_at_id(q, hits.select("q_id", "id")).collect()}
    for r in hits.collect():
        assert by_address[r["q_id"], r["cell"], r["slot"]] == pytest.approx(r["score"]) == by_id[r["q_id"], r["id"]]
    starts = {r["cell"]: r["start"] for r in index.cell_starts(spark).collect()}
    assert len({starts[r["cell"]] + r["slot"] for r in index.rows.collect()}) == 300
    flat_ = ivf.FlatIndex()
    flat_.add(df.where("id >= 200"))
    assert sorted((r["id"], r["address"]) for r in flat_.add(df.where("id < 200"), return_address=True).collect()) == [(i, i + 100) for i in range(200)]
    out = flat_.search(q, 3, return_address=True).collect()
    assert all(r["address"] == (r["id"] + 100) % 300 for r in out) and [(r["q_id"], r["id"]) for r in out if r["rank"] == 1] == [(i, i) for i in range(6)]


def test_search_reads_the_probed_cells_alone(spark, df):
    index = ivf.IVFPQIndex(4, 8, n_pq_clusters=16, vq_iter=3, pq_iter=3)
    index.train(df)
    index.add(df)
    q = as_queries(df.where("id < 1"))
    (cell,) = [r["cell"] for r in index.probe(q).collect()]
    found = index.search(q, 3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(rf"cell#\d+ (= {cell}|IN \({cell}\))", plan) and "SelectedBucketsCount: 1 out of 8" in plan, plan


def side(plan: str) -> list[str]:
    """The lines of a plan that feed the codes into the cogroup: from the scan of codes up to the cogroup."""
    lines = plan.splitlines()
    (at,) = [i for i, line in enumerate(lines) if "FileScan" in line and "code#" in line]
    depth, out = len(lines[at]), []
    for line in reversed(lines[: at + 1]):
        indent = len(line) - len(line.lstrip(" :+-"))
        if indent < depth or line is lines[at]:
            out.append(line)
            depth = indent
        if "FlatMapCoGroups" in line:
            return out
    raise AssertionError(plan)


def test_search_moves_no_codes_and_decodes_none(spark, df, monkeypatch):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        index = ivf.IVFPQIndex(4, 8, n_pq_clusters=16, vq_iter=3, pq_iter=3)
        index.train(df)
        index.add(df)
        index.n_probe, index.use_smart_probing = 8, False
        index.remove(df.where("id = 5").select("id"))
        monkeypatch.setattr(codecs.PQCodec, "decoded", None)
        found = index.search(as_queries(df.where("id < 6")), 3)
        own = side(found._jdf.queryExecution().executedPlan().toString())
        assert not any("Exchange" in line for line in own), own
        assert found.where("rank = 1").count() == 6
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize(("metric", "residual"), [("euclidean", False), ("euclidean", True), ("inner", False), ("cosine", False), ("manhattan", False)])
def test_a_large_cell_is_many_units(df, x, monkeypatch, metric, residual):
    """Units of 16 slots, few queries at once, look-ups of few codes: the same hits."""
    def hits():
        index = ivf.IVFPQIndex(4, 2, metric, residual, n_pq_clusters=16)
        index.set_codebooks(x[:2], x[:16].reshape(16, 4, 2).transpose(1, 0, 2).copy())
        index.add(df.where("id < 170"))
        index.add(df.where("id >= 170"))
        index.remove(df.where("id % 7 = 3").select("id"))
        index.n_probe, index.use_smart_probing = 2, False
        return found(index.search(as_queries(df.where("id < 20")), 6))

    want = hits()
    monkeypatch.setattr(ivf, "PIECE", 16)
    monkeypatch.setattr(ivf, "ASKING", 6)
    monkeypatch.setattr(ivf, "LOOKED", 70)
    monkeypatch.setattr(ivf, "NAMED", 1)
    assert hits() == want


def plain_index(x, cells=4, m=4):
    index = ivf.IVFPQIndex(m, cells, n_pq_clusters=16)
    index.set_codebooks(x[:cells], x[:16].reshape(16, m, 8 // m).transpose(1, 0, 2).copy())
    index.n_probe, index.use_smart_probing = cells, False
    return index


def test_an_id_that_is_removed_and_added_again_lives(spark, df, x, tmp_path):
    index = plain_index(x)
    index.add(df.where("id < 60"))
    index.remove(df.where("id < 10").select("id").unionByName(spark.range(900, 903)).unionByName(spark.range(1).select(F.lit(None).cast("long").alias("id"))))
    assert index.rows.count() == 50
    again = df.where("id < 10").select("id", F.transform("vec", lambda e: e + 1).alias("vec"))
    index.add(again)
    path = str(tmp_path / "i")
    index.save(path, spark)
    index.save(path, spark)
    loaded = ivf.IVFPQIndex.load(path, spark)
    want = index.encode(again.unionByName(df.where("id between 10 and 59"))).collect()
    folders = [p.path for p in index._parts]
    index.add(df.limit(0))
    index.compact(purge=True)
    assert len(index._parts) == 1 and not any(os.path.exists(f.removeprefix("file:")) for f in folders if f)
    for own in (index, loaded):
        assert sorted(map(tuple, own.codes.collect())) == sorted(map(tuple, want))
        (hit,) = own.search(as_queries(again.where("id = 3")), 1).collect()
        near = own.similarity_at_id(as_queries(again.where("id = 3")), spark.createDataFrame([(3, 3)], "q_id long, id long")).first()["score"]
        assert hit["score"] >= near - 1e-12
        own.remove(spark.range(3, 4))
        own.remove(spark.range(3, 4))
        own.add(df.where("id = 3"))
        own.remove(spark.range(4, 5))
        assert own.rows.count() == 59 and own.rows.select("cell", "slot").distinct().count() == 59


def test_addresses_go_on_after_loading(spark, df, x, tmp_path):
    index = plain_index(x)
    index.add(df.where("id < 40"))
    index.remove(df.where("id >= 30").select("id"))
    index.save(str(tmp_path / "i"), spark)
    old = {(r["cell"], r["slot"]): r["id"] for r in index.rows.collect()}
    loaded = ivf.IVFPQIndex.load(str(tmp_path / "i"), spark)
    loaded.add(df.where("id between 100 and 119"))
    rows = {(r["cell"], r["slot"]): r["id"] for r in loaded.rows.collect()}
    assert len(rows) == 50 and old.items() <= rows.items()


def test_the_inverse_map_reads_the_asked_buckets(spark, df, x, tmp_path):
    index = plain_index(x)
    index.add(df)
    index.add(df.where("id < 5"))
    index.remove(spark.range(2, 4))
    index.add(df.where("id = 3"))
    where = {}
    for r in index.rows.collect():
        where.setdefault(r["id"], set()).add((r["cell"], r["slot"]))
    for found in (index.locate(1, 2, 3, 250, 999), index.addresses(spark.createDataFrame([(1,), (2,), (3,), (250,), (999,), (250,)], "id long"))):
        out = {}
        for r in found.collect():
            out.setdefault(r["id"], set()).add((r["cell"], r["slot"]))
        assert out == {i: where[i] for i in (1, 3, 250)} and len(out[1]) == 2 and len(out[3]) == 1
    index.save(str(tmp_path / "i"), spark)
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # or the plan does not say how many
    try:
        for own in (index, ivf.IVFPQIndex.load(str(tmp_path / "i"), spark)):
            assert "SelectedBucketsCount: 1 out of 8" in own.locate(250)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")


def test_the_reranked_index_survives_saving(spark, df, tmp_path):
    index = ivf.IVFPQRIndex(4, 8, 4, 5, 16, vq_iter=3, pq_iter=3)
    index.train(df)
    index.add(df)
    index.n_probe, index.use_smart_probing = 3, False
    index.save(str(tmp_path / "i"), spark)
    q = as_queries(df.where("id < 9"))
    for kind in (ivf.IVFPQRIndex, ivf.IVFPQIndex):
        loaded = kind.load(str(tmp_path / "i"), spark)
        assert type(loaded) is ivf.IVFPQRIndex and loaded.factor == 5 and found(loaded.search(q, 5)) == found(index.search(q, 5))
    plain = ivf.IVFPQIndex(4, 4, n_pq_clusters=16, vq_iter=2, pq_iter=2)
    plain.train(df)
    plain.add(df)
    plain.save(str(tmp_path / "p"), spark)
    with pytest.raises(TypeError):
        ivf.IVFPQRIndex.load(str(tmp_path / "p"), spark)


def test_a_save_that_is_killed_leaves_the_older_version(spark, df, x, tmp_path, monkeypatch):
    path, index = str(tmp_path / "i"), plain_index(x)
    index.add(df.where("id < 100"))
    index.save(path, spark)
    loaded = ivf.IVFPQIndex.load(path, spark)
    loaded.add(df.where("id >= 100"))
    real, seen = persist.write_bucketed, []

    def killed(rows, folder, layout):
        seen.append(folder)
        if len(seen) == 2:
            raise RuntimeError("killed")
        return real(rows, folder, layout)

    monkeypatch.setattr(persist, "write_bucketed", killed)
    with pytest.raises(RuntimeError):
        loaded.save(path, spark)
    monkeypatch.setattr(persist, "write_bucketed", real)
    assert ivf.IVFPQIndex.load(path, spark).rows.count() == 100 and loaded.rows.count() == 300
    for n in range(3):
        loaded.save(path, spark)  # over what it was read from
    assert persist.versions(path, spark) == [2, 3] and ivf.IVFPQIndex.load(path, spark).rows.count() == 300
    with pytest.raises(FileNotFoundError):
        persist.load(str(tmp_path / "none"), spark)


@pytest.mark.parametrize("metric", METRICS)
def test_product_quantizer_codes_by_its_metric(df, x, metric):
    pq = codecs.PQCodec(2, 8, metric, max_iter=4)
    pq.train(df)
    codes = pq.codes(x)
    for s in range(2):
        want = np.argmax(np.round(M.matrix(metric, x.reshape(-1, 2, 4)[:, s], pq.codebook[s]), 12), axis=1)
        assert (codes[:, s] == want).all()


@pytest.mark.parametrize("m", [4, 8])
def test_half_byte_codes(spark, df, x, m):
    pq = codecs.PQCodec(m, 16, max_iter=3, packed=True)
    pq.train(df)
    column = pq.pack(pq.codes(x))
    assert len(column[0].as_py()) == m // 2 and (pq.unpack(column) == pq.codes(x)).all()
    table = pq.adc(x[:5])
    want = sum(table[:, s][:, pq.codes(x)[:, s]] for s in range(m))
    assert np.allclose(pq.scan(table, pq.raw(column)), want) and np.allclose(pq.scan(table, pq.raw(column.slice(7, 9))), want[:, 7:16])
    index = ivf.IVFPQIndex(m, 4, n_pq_clusters=16, packed=True)
    index.set_codebooks(x[:4], pq.codebook)
    index.add(df)
    index.n_probe, index.use_smart_probing = 4, False
    top = {r["q_id"]: round(r["score"], 6) for r in index.search(as_queries(df.where("id < 5")), 1).collect()}
    assert top == {i: round(want[i].max(), 6) + 0.0 for i in range(5)}


def test_top_cells_of_many_problems(df, x):
    km = clustering.MultiKMeans(2, 5)
    km.centroids = x[:5].reshape(5, 2, 4).transpose(1, 0, 2).copy()
    out = km.topk(df.where("id < 7"), 3).collect()
    for p in range(2):
        d = ((x[:7, None, p * 4 : p * 4 + 4] - km.centroids[p]) ** 2).sum(-1)
        for i in range(7):
            assert [r["cell"] for r in sorted((r for r in out if r["q_id"] == i and r["problem"] == p), key=lambda r: r["rank"])] == np.argsort(d[i], kind="stable")[:3].tolist()


def test_farthest_first_equals_rescoring_all_seeds(df, x, monkeypatch):
    monkeypatch.setattr(clustering, "SEEDS_A_CUT", 3)
    want = [0]
    while len(want) < 9:
        d = np.round(np.min([((x - x[i]) ** 2).sum(1) for i in want], axis=0), 12)
        want.append(int(np.lexsort((np.arange(len(x)), -d))[0]))
    assert np.allclose(clustering.farthest_first(df, 9, first=x[0]), x[want])


@pytest.mark.parametrize("mode", ["a", "b", "both", "none"])
def test_half_precision_products(x, mode):
    q, b = x[:5] * 1000, x * 1e-3
    half = lambda v, on: (v / (np.abs(v).max() if on else 1)).astype(np.float16).astype(float) * (np.abs(v).max() if on else 1)
    assert np.allclose(M.half_matrix("inner", q, b, mode), half(q, mode in ("a", "both")) @ half(b, mode in ("b", "both")).T)


def test_block_masks(spark, df, x):
    a, b = df.select(F.col("id").alias("i"), F.col("vec").alias("x")), df.select(F.col("id").alias("j"), F.col("vec").alias("y"))
    blocks = spark.createDataFrame([(0, 1), (2, 2), (2, 2), (99, 0)], "bi int, bj int")
    out = {(r["i"], r["j"]): r["score"] for r in search.block_masked_product(a, b, blocks, 8).collect()}
    assert set(out) == {(i, j) for i in range(8) for j in range(8, 16)} | {(i, j) for i in range(16, 24) for j in range(16, 24)}
    assert all(s == pytest.approx(x[i] @ x[j]) for (i, j), s in out.items())


@pytest.mark.parametrize("metric,residual", [("euclidean", False), ("euclidean", True), ("inner", False), ("cosine", False), ("manhattan", False)])
def test_bounds_spare_cells_and_lose_no_hit(spark, metric, residual, tmp_path):
    rng = np.random.default_rng(3)
    middle = rng.normal(size=(16, 8)) * 20
    x = (middle[:, None] + rng.normal(size=(16, 30, 8))).reshape(-1, 8)
    df = frame(spark, x)
    index = ivf.IVFPQIndex(8, 16, metric, residual)
    low, high = (x.min(0), x.max(0)) if not residual else (np.full(8, -6.0), np.full(8, 6.0))
    if metric == "cosine":
        low, high = np.full(8, -1.0), np.full(8, 1.0)
    index.set_codebooks(M.unit_rows(middle, 1e-9) if metric == "cosine" else middle, (low + (np.arange(256)[:, None] + 0.5) / 256 * (high - low)).T[:, :, None])
    index.n_probe, index.use_smart_probing = 16, False
    index.add(df.where("id % 3 > 0"))
    index.add(df.where("id % 3 = 0"))
    index.remove(df.where("id % 7 = 0").select("id"))
    q = as_queries(df.where("id % 20 = 0"))
    plain = found(index.search(q, 5))
    index.bounded = True
    assert found(index.search(q, 5)) == plain
    _, rest = index._bounded(q, index.probe(q), 5, index._reach())
    n = rest.count()
    assert n < (0.6 if metric in ("inner", "cosine") else 0.1) * 24 * 15  # of the probes beyond the nearest cell; products are bounded less tightly
    index.save(str(tmp_path / "i"), spark)
    again = ivf.IVFPQIndex.load(str(tmp_path / "i"), spark)
    assert again.bounded and np.array_equal(again._reach(), index._reach()) and found(again.search(q, 5)) == plain
    again.codes = again.rows  # codes from elsewhere have no reach: nothing is spared
    assert again._reach() is None and found(again.search(q, 5)) == plain


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_centroids_beyond_what_tasks_are_sent(spark, df, x, metric, monkeypatch):
    book = np.random.default_rng(9).normal(size=(40, 8))
    twice = df.unionByName(df.where("id < 5"))  # rows that repeat an id have lists of their own
    want = sorted(map(tuple, clustering.assign(twice, book, metric).select("id", "cell").collect()))
    cells = sorted((r["q_id"], r["rank"], r["cell"]) for r in clustering.nearest_cells(df, book, 3, metric).collect())
    monkeypatch.setattr(clustering, "CENTROID_BYTES", 0)
    assert sorted(map(tuple, clustering.assign(twice, book, metric).select("id", "cell").collect())) == want
    assert sorted((r["q_id"], r["rank"], r["cell"]) for r in clustering.nearest_cells(df, book, 3, metric).collect()) == cells


@pytest.mark.parametrize("width", [1, 63, 64, 100])
def test_covariance_in_blocks(spark, width, monkeypatch):
    monkeypatch.setattr(codecs, "BLOCK", 32)
    monkeypatch.setattr(codecs, "BLOCK_BYTES", 3 * 8 * 32 * 32)  # three blocks a turn
    x = np.random.default_rng(width).normal(size=(50, width)) + 1e6
    df = frame(spark, x).unionByName(spark.createDataFrame([(99, None), (98, [1.0] * (width + 1))], "id long, vec array<double>"))
    n, mean, cov = codecs.covariance(df, width)
    assert n == 50 and np.allclose(mean, x.mean(0)) and np.allclose(cov, np.cov(x.T).reshape(width, width), atol=1e-8)
    n, _, cov = codecs.covariance(df.limit(0), width)
    assert n == 0 and not cov.any()


@pytest.mark.parametrize("metric", METRICS)
def test_pairs_are_scored_in_bounded_blocks(spark, df, x, metric, monkeypatch):
    """Theta joins form no row a pair: tasks hold so many scores at once, by broadcast queries or in a grid, and keep the best."""
    s = np.stack([M.direct(metric, np.repeat(x[i : i + 1], len(x), 0), x) for i in range(12)])
    assert np.allclose(M.each_pair(metric, x[:12], x), s, atol=1e-12)
    want = [(i, n + 1, int(j)) for i in range(12) for n, j in enumerate(np.lexsort((np.arange(len(x)), -np.round(s[i], 9)))[:7])]
    most = max(len(part[0]) for part in search.selected(metric, 7, x, np.arange(len(x)), x))
    monkeypatch.setattr(search, "PAIRS", 1000)
    parts = [len(part[0]) for part in search.selected(metric, 7, x, np.arange(len(x)), x)]
    assert most == 300 * 15 and max(parts) <= 3 * 15 and sum(parts) == most
    monkeypatch.setattr(search, "CHUNK_BYTES", 2000)
    monkeypatch.setattr(search, "TASK_PAIRS", 500)
    monkeypatch.setattr(search, "GRID", (5, 40))
    q = as_queries(df.where("id < 12"))
    for most in (search.BROADCAST_BYTES, 0):
        monkeypatch.setattr(search, "BROADCAST_BYTES", most)
        out = search.knn_expr(df, q, 7, metric)
        assert found(out) == want
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan
        every = {(r["q_id"], r["id"]): r["score"] for r in search.all_pairs(df, q, metric).collect()}
        assert len(every) == 12 * 300 and all(v == pytest.approx(s[k], abs=1e-9) for k, v in every.items())
    near = search.knn_expr(df, q, 300, metric, where=F.col("id") % 2 == F.col("q_id") % 2)
    assert near.count() == 12 * 150


def test_a_norm_is_computed_once_a_vector(spark):
    wide = frame(spark, np.ones((2, 3000)))
    plan = wide.select(M.normalize(F.col("vec")).alias("v"))
    assert plan.first()["v"][0] == pytest.approx(1 / (np.sqrt(3000) + M.NORM_EPS))
    assert spark.createDataFrame([(None,), ([],)], "vec array<double>").select(M.normalize(F.col("vec")).alias("v")).collect() == [(None,), ([],)]
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    at = text.index("transform(array(")  # the norm is below the outer array, not below the transform of the elements
    assert "SQRT" in text[at:] and "SQRT" not in text[text.index(", lambdafunction(", at) :].split("AS v")[0]


@pytest.mark.parametrize("sent", [True, False])
def test_masks_and_listed_pairs_carry_no_vectors(spark, df, x, sent, monkeypatch):
    if not sent:
        monkeypatch.setattr(search, "BROADCAST_BYTES", 0)
        monkeypatch.setattr(search, "GRID", (7, 50))
    q = as_queries(df.where("id < 30"))
    out = search.masked_product(q.withColumn("m", F.col("q_id") % 7), df.withColumn("m", F.col("id") % 7), "m")
    got = {(r["q_id"], r["id"]): r["score"] for r in out.collect()}
    assert got.keys() == {(i, j) for i in range(30) for j in range(300) if i % 7 == j % 7} and all(v == pytest.approx(x[i] @ x[j]) for (i, j), v in got.items())
    if sent:
        assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
    index = ivf.IVFPQIndex(4, 4, n_pq_clusters=8)
    index.set_codebooks(x[:4], x[:8].reshape(8, 4, 2).transpose(1, 0, 2).copy())
    index.add(df)
    pairs = spark.createDataFrame([(1, 5), (1, 5), (2, 299), (2, 1000), (77, 3), (None, 4), (3, 5)], "q_id long, id long")
    again = q.unionByName(q.where("q_id = 3"))  # a query that is there twice counts twice
    got = sorted((r["q_id"], r["id"], round(r["score"], 9)) for r in index.similarity_at_id(again, pairs).collect())
    near = index.pq.decoded(index.pq.codes(x))
    want = [(1, 5), (1, 5), (2, 299), (3, 5), (3, 5)]
    assert got == [(i, j, round(-float(((x[i] - near[j]) ** 2).sum()), 9)) for i, j in want]
    carried = re.findall(r"Exchange hashpartitioning.*", index.similarity_at_id(q, pairs)._jdf.queryExecution().executedPlan().toString())
    assert len(index.similarity_at_id(q, pairs).columns) == 3 and all("vec" not in c for c in carried)


@pytest.mark.parametrize("metric", METRICS)
def test_vec_pairs(spark, df, x, metric):
    sqlfn.register_vec_pairs(spark)
    df.createOrReplaceTempView("pb")
    spark.sql("select id, vec from pb where id < 20 union all values (500, null), (501, array(1.0d)), (null, array(0d, 0d, 0d, 0d, 0d, 0d, 0d, 0d))").createOrReplaceTempView("pq")
    for shard, tile in ((8192, 4096), (40, 9)):
        got = [((r["q_id"], r["id"]), r["score"]) for r in spark.sql(sqlfn.pairs_statement("pb", "pq", metric, shard, tile)).collect()]
        assert len(got) == len(dict(got)) == 20 * 300
        assert all(v == pytest.approx(M.direct(metric, x[i][None], x[j][None])[0], abs=1e-9) for (i, j), v in got)


def test_vec_pairs_are_stored_side_by_side(spark, df, x, tmp_path, monkeypatch):
    """Pairs leave in the order of their scores, in bounded tables, however the base comes; so Parquet takes fewer bytes."""
    own = sqlfn._VecPairs.func()
    rows = lambda ask, at: pa.RecordBatch.from_pydict({"is_query": pa.array([ask] * len(at)), "id": pa.array(at, pa.int64()), "vec": pa.array(x[at].tolist(), pa.list_(pa.float64()))})
    monkeypatch.setattr(sqlfn, "PAIRS", 1000)
    monkeypatch.setattr(sqlfn, "SORTED", 3000)
    monkeypatch.setattr(sqlfn, "BASE_BYTES", 150 * 72)
    name = pa.array(["euclidean"])
    batches = [rows(True, range(7)), rows(True, range(7, 12)), *(rows(False, range(i, i + 50)) for i in range(0, 300, 50))]
    out = [t for b in batches for t in own.eval(b, name)]
    assert sum(map(len, out)) == 12 * 300 and not list(own.terminate())
    got = [np.concatenate([t["score"].to_numpy() for t in out[i : i + 2]]) for i in (0, 2)]  # a flush of 150 base vectors: 12 * 150 pairs
    assert max(map(len, out)) == 1000 and len(out) == 4 and all((np.diff(s) >= 0).all() for s in got)
    pairs = {(q, i): s for t in out for q, i, s in zip(*(t[c].to_pylist() for c in ("q_id", "id", "score")), strict=True)}
    assert len(pairs) == 12 * 300 and all(v == pytest.approx(M.direct("euclidean", x[q][None], x[i][None])[0]) for (q, i), v in pairs.items())
    monkeypatch.undo()  # the function's constants travel with it
    sqlfn.register_vec_pairs(spark)
    many = df.crossJoin(spark.range(10).withColumnRenamed("id", "n")).select((F.col("id") * 10 + F.col("n")).alias("id"), F.transform("vec", lambda e: e * (F.col("n") + 1)).alias("vec"))
    many.createOrReplaceTempView("sb")
    many.where("id % 10 < 4").createOrReplaceTempView("sq")
    spark.sql(sqlfn.pairs_statement("sb", "sq")).selectExpr("q_id", "id", "rint(score * 100D) / 100D as score").write.parquet(f"{tmp_path}/p")
    files = [os.path.join(tmp_path, "p", f) for f in os.listdir(tmp_path / "p") if f.endswith(".parquet")]
    assert spark.read.parquet(f"{tmp_path}/p").count() == 1200 * 3000
    assert sum(map(os.path.getsize, files)) < 4.5 * 1200 * 3000  # 5.3 each where pairs leave by query


def test_a_unit_gives_a_bounded_number_of_hits_at_once(df, monkeypatch):
    """Re-ranking asks for many hits a query: then fewer queries meet a unit at once, and the hits are the same."""
    index = ivf.IVFPQRIndex(4, 8, 2, 20, n_pq_clusters=16, vq_iter=3, pq_iter=3)
    index.train(df)
    index.add(df)
    index.n_probe, index.use_smart_probing = 2, False
    want, gave, scan = found(index.search(as_queries(df), 2)), [], ivf.IVFPQIndex._scan
    monkeypatch.setattr(ivf, "GIVEN", 48 * 100)
    monkeypatch.setattr(ivf.IVFPQIndex, "_scan", lambda self, k, more: gave.append(k) or scan(self, k, more))
    assert found(index.search(as_queries(df), 2)) == want
    assert gave == [40] * 3  # 300 queries, a hundred at once
