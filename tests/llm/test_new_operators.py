"""Packing, importance resampling and hard negatives against brute force."""

import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from test_operators import LOW, docs, empty, frame, got, rows  # noqa: F401

from veclode.llm import importance, negatives, packing

TERMS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.fixture(scope="module")
def model():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.model_path())


ODD = [
    "a<|endoftext|>b <|ENDOFTEXT|> x<|startoftext|>, y", "é ́ ≠ (≠) J̌x İ. É, ÀÉÖ.ß ×, a×,b x—,y", "I'LL don't IT'S. 'll '' a'.s ’s it’s",
    "İstanbul ΣΑΣ Σ x\ty\x0bz\x1c\x85   q", "a.b! _c_d 12ab.34 ...", "\U0001f642\U0001f642!日本語, é" * 50, "", " \n\t", "a" * 500, "Ab" * 40 + "!" * 90,
]


def test_encoder_gives_the_ids_of_the_tokenizer(model, monkeypatch):
    texts = ODD + [t or "" for _, t, _ in rows()]
    want = [model.encode(t, add_special_tokens=False).ids + [2] for t in texts]
    for kept in (packing.KEPT, 5):
        monkeypatch.setattr(packing, "KEPT", kept)
        encoder, out = packing.Encoder(packing.model_path(), 2), []
        for i in range(0, len(texts), 7):
            ids, n = encoder(pa.array(texts[i : i + 7]))
            out += [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]
        assert out == want


def test_packing(spark, docs, empty, model):  # noqa: F811
    out = packing.digest(docs).collect()
    assert len({r["sequence_id"] for r in out}) == len(out) and all(r["offset"] == 0 and r["length"].bit_count() == 1 and r["length"] <= 4096 for r in out)
    want = []
    for i, t, _ in rows():
        ids = np.array(model.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        sizes, at = [4096] * (len(ids) // 4096) + [1 << b for b in range(11, -1, -1) if len(ids) % 4096 >> b & 1], 0
        for n in sizes:
            want.append((i, at, n, zlib.crc32(ids[at : at + n].tobytes()), len(ids)))
            at += n
    assert sorted([tuple(r[c] for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")) for r in out], key=repr) == sorted(want, key=repr)
    assert packing.digest(empty).collect() == []


def test_buckets_are_folders_of_one_length(spark, docs, tmp_path):  # noqa: F811
    path = str(tmp_path / "packed")
    packing.write(packing.sequences(docs, most=64), path)
    every = packing.read(spark, path)
    for n in (1, 64):
        own = packing.read(spark, path, n)
        assert own.count() == every.where(f"length = {n}").count() > 0
        assert all(len(r["ids"]) == n for r in own.select("ids").collect())
        assert "PartitionFilters: [isnotnull(length" in own._jdf.queryExecution().toString()
    assert every.agg({"length": "max"}).first()[0] == 64
    with pytest.raises(ValueError):
        packing.sequences(docs, most=100)


def grams(text):
    w = TERMS.findall((text or "").translate(LOW))
    return w, [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def resampled(data, target, percent, least):
    """Brute force: (doc_id, n_features, weight, score, rank), ranks by key alone."""
    bucket = lambda g: zlib.crc32(g.encode()) % 10_000
    raw, aim = np.zeros(10_000, int), np.zeros(10_000, int)
    for texts, n in ((data, raw), (target, aim)):
        for t in texts:
            np.add.at(n, [bucket(g) for g in grams(t[1])[1]], 1)
    out, able = [], []
    for i, t, *_ in data:
        w, own = grams(t)
        weight = sum(math.floor(1000 * math.log((aim[b] + 1.0) * (raw.sum() + 10_000) / ((raw[b] + 1.0) * (aim.sum() + 10_000)))) for b in map(bucket, own))
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(own), weight, score, None])
        if len(w) >= least:
            able.append(out[-1])
    able.sort(key=lambda r: (-r[3], r[0] is None, r[0]))
    for n, r in enumerate(able[: len(able) * percent // 100]):
        r[4] = n + 1
    return sorted(map(tuple, out), key=repr)


@pytest.mark.parametrize(("percent", "least"), [(5, 20), (50, 0), (100, 3), (0, 0)])
def test_importance_resampling(spark, docs, empty, percent, least):  # noqa: F811
    target = [(1, "alpha beta gamma"), (2, None), (3, "p1 p2 p3 Épsilon 日本"), (4, "")]
    aim = spark.createDataFrame(target, "item_id long, text string")
    columns = ("doc_id", "n_features", "weight", "score", "rank")
    assert got(importance.resample(docs, aim, percent, least), *columns) == resampled(rows(), target, percent, least)
    assert importance.resample(empty, aim, percent, least).collect() == []
    if percent == 5:
        no_target = importance.resample(docs, aim.limit(0))
        assert got(no_target, *columns) == resampled(rows(), [], 5, 20)


def test_crc_of_long_words():
    texts = ["éa x1 " + "z" * 300 + " q " + "w" * 65 + " " + "v" * 64, "", "one", "Ünï \U0001f642 b"]
    words, whose, buckets = importance.features(pa.array(texts))
    for i, t in enumerate(texts):
        w = TERMS.findall(t.translate(LOW))
        assert words[i] == len(w)
        for n in range(3):
            assert buckets[n][whose[n] == i].tolist() == [zlib.crc32(" ".join(w[j : j + n + 1]).encode()) % 10_000 for j in range(len(w) - n)]


def test_kth_key_by_radix(spark):
    rng = np.random.default_rng(5)
    ends = [-(1 << 63), (1 << 63) - 1, 0, -1, 1, 1 << 40]
    data = [(int(rng.choice(ends)), int(rng.choice(ends)), i) for i in range(300)] + [(int(rng.integers(-9, 9)), int(rng.integers(0, 1 << 50)), 300 + i) for i in range(300)]
    df, keys = spark.createDataFrame(data, "a long, b long, c long").cache(), sorted(data)
    for k in (0, 1, 2, 37, 299, 300, 301, 599, 600):
        key = importance.kth_key(df, ["a", "b", "c"], k)
        found = [] if key is None else sorted(map(tuple, df.where(importance.upto(["a", "b", "c"], key)).collect()))
        assert found == keys[:k]


def mined(data, every=50):
    """Brute force over (row, vec_id, embedding, label)."""
    live = [(n, i, [math.floor(256 * x) for x in v], lab) for n, (i, v, lab) in enumerate(data) if i is not None and v is not None and lab is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for _, a, q, lab in live:
        if a % every:
            continue
        s = [(-sum(x * y for x, y in zip(q, v, strict=True)), i, own == lab) for _, i, v, own in live if i != a and len(v) == len(q)]
        for p, i, _ in sorted(x for x in s if x[2])[:5]:
            fits = sorted(x for x in s if not x[2] and 50 * -p <= 100 * -x[0] <= 95 * -p)[:3]
            out += [(a, i, r + 1, n, -p, -x) for r, (x, n, _) in enumerate(fits)]
    return sorted(out)


def vectors(kind, noise=0.2):
    rng = np.random.default_rng(11)
    if kind == "clustered":
        centre = rng.normal(size=(6, 8))
        data = [(i, (centre[i % 6] + noise * rng.normal(size=8)).tolist(), int(rng.integers(0, 3))) for i in range(600)]
    elif kind == "hot":  # copies of one vector, and nearly all of one label
        data = [(i, [0.5, 0.25, -1.0] if i % 3 else rng.normal(size=3).tolist(), 0 if i % 5 else 1) for i in range(400)]
    elif kind == "large":
        data = [(i, [float(x) for x in rng.integers(-(1 << 21), 1 << 21, 4)], int(i % 2)) for i in range(200)]
    else:
        data = [(i, [float(x) for x in rng.integers(-2, 3, 2)], int(rng.integers(0, 2))) for i in range(300)]
        data += [(None, [1.0, 1.0], 0), (1000, None, 0), (1050, [1.0, None], 0), (1100, [float("nan"), 1.0], 1), (1150, [1.0, float("inf")], 1), (1200, [1.0, 1.0], None)]
        data += [(1250, [], 0), (1251, [], 0), (1252, [], 1), (1300, [1.0], 0), (1301, [2.0], 0), (1302, [1.5], 1), (100, [1.0, 2.0], 0), (100, [1.0, 2.0], 0), (7, [2.0, 2.0], 1)]
    return data


@pytest.mark.parametrize("kind", ["clustered", "hot", "large", "odd"])
def test_hard_negatives(spark, monkeypatch, kind):
    monkeypatch.setattr(negatives, "SHARD", 50)
    data = vectors(kind)
    df = spark.createDataFrame([(*r, "c", 1, 2.0) for r in data], "vec_id long, embedding array<double>, label int, v string, norm int, dist double").repartition(3)
    from pyspark.sql import functions as F

    out = negatives.mine(df, F.col("vec_id") % 50 == 0, pivots=9, block=3)
    assert got(out, "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score") == sorted(mined(data), key=repr)
    assert negatives.mine(df.limit(0), F.col("vec_id") % 50 == 0).collect() == []
    assert negatives.mine(df, F.lit(False)).collect() == []


def test_bounds_spare_vectors_that_cannot_serve(spark, monkeypatch):
    """On clustered vectors, a group of anchors is sent a part of the vectors, and the hits are the same."""
    from pyspark.sql import functions as F

    data = vectors("clustered", 0.02)
    rows_ = negatives.quantised(spark.createDataFrame(data, "vec_id long, embedding array<double>, label int"))
    cells = negatives.voronoi(rows_)
    base = negatives.placed(rows_, cells).withColumn("anchor", F.monotonically_increasing_id()).cache()
    asked = negatives.placed(base.where("vec_id % 50 = 0").drop("cell", "dist"), cells, True).withColumnRenamed("cell", "home")
    sent, real = [], negatives._met
    monkeypatch.setattr(negatives, "_met", lambda left, right, *rest: (sent.append((right.count(), left.select("g").distinct().count())), real(left, right, *rest))[1])
    out = negatives.search(base, asked.withColumns({"low": F.array(F.lit(-(1 << 62))), "high": F.array(F.lit(1 << 62))}), cells, 3, True, 2)
    assert out.count() == 36
    vectors_sent, groups = sent[1]
    assert groups > 1 and vectors_sent < 0.65 * groups * len(data)


def test_long_units_are_summed_and_walked_like_short_ones(monkeypatch):
    """The lattice and the samples of a long run without spaces do not depend on which way it goes."""
    from veclode.llm import pieces

    v = pieces.Vocabulary()
    text = "".join(np.random.default_rng(2).choice(list("abcdefghijklmnopqrstuvwxyzeeetao日é"), 9000))
    out = []
    for long, few, steps in ((4096, 4, 4096), (100, 4, 64), (1 << 30, 0, 0)):
        monkeypatch.setattr(pieces, "_LONG", long)
        monkeypatch.setattr(pieces, "_FEW", few)
        monkeypatch.setattr(pieces, "_STEPS", max(1, steps))
        lattice, found = pieces.sample(v, [3, 4], [text, "short one"], 2)
        out.append((lattice.p[: lattice.edges].copy(), [[(path[1].tolist(), log_p) for path, log_p, _ in leaves] for leaves, _ in found]))
    for p, leaves in out[1:]:
        assert np.allclose(p, out[0][0], rtol=1e-9, atol=0)
        assert [[x[0] for x in row] for row in leaves] == [[x[0] for x in row] for row in out[0][1]]
        assert np.allclose([x[1] for row in leaves for x in row], [x[1] for row in out[0][1] for x in row])


def test_line_dedup_streams_its_sorted_runs(spark, docs):  # noqa: F811
    """The plan: range exchange, sort, window, with nothing between them; marks are the first occurrences."""
    from veclode.llm import line_dedup

    runs = line_dedup.stream(line_dedup.occurrences(docs))
    plan = [line.strip(" +-:") for line in runs._jdf.queryExecution().executedPlan().toString().splitlines()]
    nodes = [line.split("(")[0].split(" ")[0] for line in plan if line and not line.startswith(("Adaptive", "*", "Project"))]
    assert nodes[:3] == ["Window", "Sort", "Exchange"] and "rangepartitioning" in next(line for line in plan if line.startswith("Exchange")), plan
    first = {}
    for r in runs.collect():
        first.setdefault((r["h1"], r["h2"], r["row"]), []).append((r["pos"], r["first"]))
    assert all([mark for _, mark in sorted(x)] == [True] + [False] * (len(x) - 1) for x in first.values())


def test_line_dedup_of_a_row_repeated_very_often(spark):
    from veclode.llm import line_dedup

    one = spark.range(3000).selectExpr("7L as doc_id", "'Again\nand again \nx' as text")
    more = spark.range(9).selectExpr("id + 100 as doc_id", "concat('rare', chr(10), 'Rare', chr(10), 'own', id) as text")
    out = line_dedup.digest(one.unionByName(more)).groupBy("doc_id", "n_lines", "n_dropped").count().collect()
    assert sorted(map(tuple, out)) == [(7, 3, 3, 3000)] + [(100 + i, 3, 0, 1) for i in range(9)]
