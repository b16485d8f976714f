"""The training-data operators against brute force, on a table with every awkward case: nulls in any column, empty and
very long texts, ties, repeated rows, no rows, and columns whose names clash with the operators' own."""

import hashlib
import math
import pickle
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from veclode.llm import exact, line_dedup, mixing, pieces, quality, secrets, simhash, substring, topk, toxicity

WS = " \t\n\x0b\x0c\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, pos int, k1 string, node long, fp string, score double, y int, size string, shard int, content string"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(x) -> str:
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def rows():
    """(doc_id, text, source)"""
    rng = np.random.default_rng(3)
    vocab = ["alpha", "Beta", "gamma", "delta", "Épsilon", "zeta", "eta", "θ", "iota", "KAPPA", "日本", "mu,", "nu.", "🙂x"]
    out = []
    for i in range(60):
        lines = [" ".join(rng.choice(vocab, rng.integers(1, 30))) for _ in range(rng.integers(1, 6))]
        if i % 4 == 0:
            lines.insert(int(rng.integers(0, len(lines) + 1)), "  Common LINE here\t")
        if i % 3 == 0:
            lines.append("")
        out.append((100 + i, "\n".join(lines), f"s{i % 5}"))
    passage = " ".join(f"p{j}" for j in range(50))
    out += [(i, f"before{i} it {passage} after{i}", "s1") for i in range(20)]
    out += [(200 + i, "Same Text\nof all", "hot") for i in range(40)] + [(250, "sAME text\nof ALL", "hot"), (251, "same text\nof all ", "hot")]
    out += [(300, None, "s2"), (301, "", None), (302, " \t\n\r ", "s3"), (303, "one", None), (None, "no id here", "s1"), (None, None, None)]
    out += [(304, "again and again", "s4")] * 3 + [(304, "again, another text", "s4")]
    out += [(305, "long " * 30_000 + "token = abcdef123 end", "s0"), (306, "x" * 200_000, "s0")]
    out += [(400 + i, passage + f" tail{i} " + " ".join(f"q{j}" for j in range(120)), "s2") for i in range(3)]
    return out


def frame(spark, data):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "a", 1, "b", 2, "c", 0.5, 1, "d", 3, "e") for i, t, s in data], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def docs(spark):
    df = frame(spark, rows()).cache()
    df.count()
    return df


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


def got(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def test_line_dedup(docs, empty):
    keep, lines = [], Counter()
    for i, t, _ in rows():
        lines.update({k for x in (t or "").split("\n") if (k := x.strip(WS).translate(LOW))})
    for i, t, _ in rows():
        own = (t or "").split("\n")
        kept = [x for x in own if lines[x.strip(WS).translate(LOW)] < 10]
        keep.append((i, len(own), len(own) - len(kept), sha("\n".join(kept))))
    assert got(line_dedup.digest(docs), "doc_id", "n_lines", "n_dropped", "kept_sha256") == sorted(keep, key=repr)
    assert line_dedup.digest(empty).collect() == []


def test_line_dedup_keeps_first(spark):
    df = frame(spark, [(2, "a\nx\nA", "s"), (1, "a \nb", "s"), (3, "y\na", "s")])
    out = {r["doc_id"]: (r["kept_text"], [tuple(x) for x in r["keep"]]) for r in line_dedup.line_dedup(df, min_docs=2, keep="first").collect()}
    assert out == {1: ("a \nb", [(0, 2)]), 2: ("x", [(1, 1)]), 3: ("y", [(0, 1)])}


@pytest.mark.parametrize("keep", ["max", "min"])
def test_exact_dedup(docs, empty, keep):
    groups = defaultdict(list)
    for i, t, _ in rows():
        groups[(t or "").translate(LOW)].append(i)
    pick = max if keep == "max" else min
    want = []
    for i, t, _ in rows():
        own = groups[(t or "").translate(LOW)]
        best = pick((x for x in own if x is not None), default=None)
        want.append((i, best, len(own), i == best, sha((t or "").translate(LOW))))
    assert got(exact.exact_dedup(docs, keep), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == sorted(want, key=repr)
    assert exact.exact_dedup(empty).collect() == []


def test_trie_splits_edges_and_spills(monkeypatch):
    trie, merge = exact.Trie(), exact._merger(True)
    words = [b"", b"a", b"abc", b"abd", b"ab", b"abc", b"b" * 1000, b"b" * 999 + b"c"]
    for n, w in enumerate(words):
        trie.insert(w, (n, 1, ""), merge)
    assert dict(trie.items()) == {w: (max(n for n, x in enumerate(words) if x == w), words.count(w), "") for w in words}


def test_substring_dedup(docs, empty):
    size, starts, want = 35, Counter(), []
    all_words = [(i, WORD.findall(t or "")) for i, t, _ in rows()]
    for _, w in all_words:
        starts.update(tuple(w[a : a + size]) for a in range(len(w) - size + 1))
    for i, w in all_words:
        gone = np.zeros(len(w), bool)
        for a in range(len(w) - size + 1):
            if starts[tuple(w[a : a + size])] > 1:
                gone[a : a + size] = True
        want.append((i, len(w), int(gone.sum()), sha(" ".join(x for x, g in zip(w, gone) if not g))))
    assert got(substring.digest(docs), "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(want, key=repr)
    assert sum(w[2] for w in want) > 1000
    assert substring.digest(empty).collect() == []


def test_substring_dedup_of_repeated_rows(spark, monkeypatch):
    """Rows that repeat id and text: all their windows go, those that others share go there too, and they are hashed once."""
    from pyspark.sql import functions as F

    sent, by_home = [], substring._by_home
    monkeypatch.setattr(substring, "_by_home", lambda packed, *a: (sent.append(packed.agg(F.sum(F.length("pos") / 4)).first()[0] or 0), by_home(packed, *a))[1])
    words = [f"w{i}" for i in range(200)]
    own = [f"v{i}" for i in range(60)]
    data = [(1, " ".join(words), "s")] * 150 + [(None, " ".join(own[:34]), "s")] * 3 + [(None, " ".join(own[:40] + words[:40]), "s")] * 2
    data += [(2, " ".join(own[5:50] + words[100:150]), "s"), (1, " ".join(words[:34]), "s"), (3, None, "s"), (3, None, "s")]
    sizes, starts, want = 35, Counter(), []
    for _, t, _ in data:
        w = (t or "").split()
        starts.update(tuple(w[a : a + sizes]) for a in range(len(w) - sizes + 1))
    for i, t, _ in data:
        w = (t or "").split()
        gone = {p for a in range(len(w) - sizes + 1) if starts[tuple(w[a : a + sizes])] > 1 for p in range(a, a + sizes)}
        want.append((i, len(w), len(gone), sha(" ".join(x for p, x in enumerate(w) if p not in gone))))
    assert got(substring.digest(frame(spark, data)), "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(want, key=repr)
    assert sent and max(sent) < 400


def test_cover_meets_every_difference():
    assert {(a - b) % substring.PERIOD for a in substring.COVER for b in substring.COVER} == set(range(substring.PERIOD))


def test_mixing(docs, empty):
    sizes = [(i, s, len(WORD.findall(t or ""))) for i, t, s in rows()]
    total = Counter()
    for _, s, n in sizes:
        total[s] += n
    names = sorted((s for s in total if s is not None), key=lambda s: s.encode()) + ([None] if None in total else [])
    weight = {s: (5, 2, 1)[j % 3] for j, s in enumerate(names)}
    target, left, open_ = {}, 1.5 * sum(total.values()), set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level >= 2 * total[s]}
        if not full:
            target |= {s: weight[s] * level for s in open_}
            break
        target |= {s: 2.0 * total[s] for s in full}
        left -= sum(target[s] for s in full)
        open_ -= full
    out = [r.asDict() for r in mixing.mixed(docs).collect()]
    by_id = defaultdict(set)
    for i, s, _ in sizes:
        by_id[i].add(s)
    assert sorted((r["doc_id"] or -1, r["size"]) for r in out) == sorted((i or -1, n) for i, _, n in sizes)
    taken = Counter()
    for r in out:
        assert 0 <= r["taken"] <= 2 * r["size"]
        (s,) = [s for s in by_id[r["doc_id"]] if total[s] == r["source_size"]]
        assert r["target"] == pytest.approx(target[s])
        taken[s] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in names)
    assert sorted(map(str, out)) == sorted(str(r.asDict()) for r in mixing.mixed(docs.repartition(3)).collect())
    assert mixing.mixed(empty).collect() == [] and mixing.mix(empty).collect() == []


def test_mix_repeats_and_cuts_texts(spark, docs):
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    own, texts = Counter(), Counter()
    for r in out.collect():
        assert r["n_chars"] == len(r["text"])
        own[r["source"]] += len(WORD.findall(r["text"]))
        texts[r["doc_id"], r["source"]] += len(WORD.findall(r["text"]))
    size = Counter()
    for _, t, s in rows():
        size[s] += len(WORD.findall(t or ""))
    of = {}
    for r in mixing.mixed(docs).collect():
        of.setdefault((r["source_size"]), set()).add(r["target"])
    for s, n in own.items():
        assert any(n == math.floor(t) for t in of[size[s]])
    want = Counter()
    for r in mixing.mixed(docs).collect():
        want[r["doc_id"]] += r["taken"]
    mine = Counter()
    for (i, _), n in texts.items():
        mine[i] += n
    assert mine == +want
    plan = mixing.schedule(docs).collect()
    assert plan and all(0 < r["words"] <= r["size"] for r in plan)
    assert [(r["finish"], r["source"] or "", r["start"]) for r in plan] == sorted((r["finish"], r["source"] or "", r["start"]) for r in plan)


def test_schedule_is_cut_where_the_budget_ends(spark, docs):
    """The running total of the packets in their global order, by hand."""
    rows_ = mixing.cut(mixing.sized(docs))
    queues = mixing.Queues(rows_, (5, 2, 1), 1.5, 2.0)
    placed = mixing.cut(queues.placed(rows_))
    packets = sorted((p["finish"], p["src"], p["start"], p["words"]) for r in placed.select(queues.packets().alias("p")).collect() for p in r["p"])
    for budget in (queues.budget, 1000, 1):
        queues.budget, left, want = budget, budget, None
        for f, s, b, n in packets:
            if left > 0:
                want = (f, s, b, min(n, left))
            left -= n
        assert mixing.cut_of(placed, queues) == (want if left <= 0 else None)


def test_mix_gives_repeated_rows_their_own_share(spark):
    data = [(1, "a b c d e f", "x")] * 3 + [(2, "g h i j k l m n o p", "y")]
    df = frame(spark, data)
    taken = Counter()
    for r in mixing.mixed(df).collect():
        taken[r["doc_id"]] += r["taken"]
    words = Counter()
    for r in mixing.mix(df).collect():
        words[r["doc_id"]] += len(r["text"].split())
    assert words == taken and sum(words.values()) == 42


def test_prefix_sums_over_several_levels(spark, monkeypatch):
    monkeypatch.setattr(mixing, "DIGITS", 1)
    rng = np.random.default_rng(1)
    data = [(s, f"{b:03x}", int(rng.integers(0, 9))) for s in "ab" for b in rng.choice(4096, 300, replace=False)]
    out = mixing.prefix_sums(spark.createDataFrame(data, "src string, bucket string, words long"), 3).collect()
    assert len(out) == 600 and all(r["base"] == sum(n for s, b, n in data if s == r["src"] and b < r["bucket"]) for r in out)


def brute_spans(t):
    out = []
    for m in re.finditer(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", t, re.I | re.A):
        if len(m[2]) >= 6 and m[1].isascii():
            out.append((m.start(), 0, m.end(), "assign"))
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


TRICKY = [
    'pass 🙂 Password = "hunter22" x API_KEY:abc token=abcdefg', "secret=token=abcdef", "secret: token: abcdefg", "AKIA" + "A1B2" * 5 + " AKIAAKIASHORT AKIA" + "Z" * 16,
    "deadbeef" * 3 + "g" + "0123456789abcdef" * 2, "token = \n nothing", "日本 token='日本' apikey = a.b-c_d/e+f=g", "passwd:" * 50 + "123456", "TOKEN" + " " * 40 + ":" + " " * 30 + "A" * 7, "ſecret=abcdef toKen=abcdef",
]


def test_secret_scan(spark, docs, empty):
    data = [(1000 + i, t, "s") for i, t in enumerate(TRICKY)] + rows()
    out = secrets.digest(frame(spark, data)).collect()
    want = Counter((i, sha(brute_spans(t or "")), brute_spans(t or "").count("assign"), brute_spans(t or "").count("access"), brute_spans(t or "").count("hex")) for i, t, _ in data)
    assert Counter((r["doc_id"], r["base_sha256"], r["n_assign"], r["n_access"], r["n_hex"]) for r in out) == want
    spans = {r["doc_id"]: r["spans"] for r in out}
    assert all(set(brute_spans(t).split(",")) - {""} <= set(spans[1000 + i].split(",")) for i, t in enumerate(TRICKY))
    assert secrets.digest(empty).collect() == []


def test_secret_parts_are_linked(spark):
    weak_id, weak_secret, end = "ABCD1234EFGH5678", "aB3dE5fG7hI9jK1lM3nO5pQ7rS9tU1vW3xY5", "https://api.example.com:8443"
    data = [(1, f"id {weak_id} key {weak_secret} at {end}", "s"), (2, f"id {weak_id} alone at {end}", "s"), (3, f"{weak_secret} alone", "s"), (4, f"{weak_id}\n\n{weak_secret}", "s"), (5, weak_id + " " * 300 + weak_secret, "s"), (6, f"AKIA{'B2' * 8} {weak_secret}", "s")]
    out = {r["doc_id"]: [x.split(":")[0] for x in r["spans"].split(",") if x] for r in secrets.digest(frame(spark, data)).collect()}
    assert out == {1: ["weak_id", "weak_secret", "endpoint"], 2: [], 3: [], 4: [], 5: [], 6: ["access", "weak_secret"]}


def brute_parts(t, reach):
    """All spans, the weak parts by comparing every pair."""
    find = lambda pattern: [(m.start(1), m.end(1)) for m in re.finditer(pattern, t, re.A)]
    base = [tuple(x.split(":")) for x in brute_spans(t).split(",") if x]
    base = [(int(a), int(b), k) for k, a, b in base]
    free = lambda spans: [s for s in spans if not any(s[0] < b and a < s[1] for a, b, _ in base)]
    ids, secrets_ = free(find(secrets.WEAK_ID)), free(find(secrets.WEAK_SECRET))
    ends, borders = find(secrets.ENDPOINT), find(secrets.BORDER)
    all_ids = ids + [(a, b) for a, b, k in base if k == "access"]
    all_secrets = secrets_ + [(a, b) for a, b, k in base if k != "access"]

    def near(x, others):
        low, high = (lambda y: min(x[1], y[1])), (lambda y: max(x[0], y[0]))
        return any(high(y) - low(y) <= reach and not any(low(y) <= a and b <= high(y) for a, b in borders) for y in others)

    out = [(a, secrets.KINDS.index(k), b, k) for a, b, k in base]
    out += [(a, 3, b, "weak_id") for a, b in ids if near((a, b), all_secrets)] + [(a, 4, b, "weak_secret") for a, b in secrets_ if near((a, b), all_ids)]
    out += [(a, 5, b, "endpoint") for a, b in ends if near((a, b), all_ids) and near((a, b), all_secrets)]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


def test_secret_parts_equal_all_pairs(spark):
    rng = np.random.default_rng(9)
    bits = [
        "ABCD1234EFGH5678", "ZZZZ9999YYYY8888XX", "AKIA" + "Q7" * 9, "aB3dE5fG7hI9jK1lM3nO5pQ7rS9tU1vW3xY5", "ABCD1234EFGH5678/aB3dE5fG7hI9jK1lM3nO5pQ7rS9tU1v/ZZZZ9999YYYY8888", "deadbeef" * 4,
        "https://api.example.com:8443/x", "http://h.io", "token = abcdefghij", "secret: ABCD1234EFGH5678", "password='aB3dE5fG7hI9jK1lM3nO5pQ7rS9tU1vW3xY5'",
    ]
    gaps = [" ", " and ", "\n", "\n\n", "\n \t\n", "\n\n\n", " 日本 ", " x" * 40, " y" * 130, ",", "\n-\n"]
    data = [(i, "".join(str(rng.choice(bits)) + str(rng.choice(gaps)) for _ in range(int(rng.integers(1, 60)))), "s") for i in range(150)]
    out = {r["doc_id"]: r["spans"] for r in secrets.digest(frame(spark, data)).collect()}
    want = {i: brute_parts(t, 256) for i, t, _ in data}
    assert out == want and sum(w.count("weak") for w in want.values()) > 300


def test_running_results(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(2)
    data = [(rng.integers(-50, 50, n).tolist(),) for n in (0, 1, 31, 32, 33, 64, 1000, 5000)]
    sums, most = secrets.running(F.col("v"), lambda a, b: a + b), secrets.running(F.col("v"), F.greatest)
    for r in spark.createDataFrame(data, "v array<bigint>").select("v", sums.alias("s"), most.alias("m")).collect():
        assert r["s"] == np.cumsum(np.array(r["v"], int)).tolist() and r["m"] == np.maximum.accumulate(np.array(r["v"], int)).tolist()


def fingerprint(t):
    w = (t or "").encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs, empty):
    fp = [(i, fingerprint(t)) for i, t, _ in rows()]
    parent = {f: f for _, f in fp}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in parent:
        for b in list(parent):
            if (a ^ b).bit_count() <= 2:
                parent[find(a)] = find(b)
    low = {}
    for i, f in fp:
        if i is not None:
            low[find(f)] = min(i, low.get(find(f), i))
    want = sorted(((i, f"{f:016x}", low.get(find(f))) for i, f in fp), key=repr)
    assert got(simhash.digest(docs), "doc_id", "fingerprint", "component_id") == want
    assert simhash.digest(empty).collect() == []


@pytest.mark.parametrize("radius", [0, 2, 5])
def test_bk_tree_and_blocks_lose_no_link(spark, radius, monkeypatch):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    flips = [np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 7), replace=False))) for _ in range(1500)]
    values = np.unique(np.array([base[rng.integers(0, 40)] ^ f for f in flips], np.uint64))
    pairs = {(min(a, b), max(a, b)) for x, y in simhash.BKTree(values).search(values, radius) for a, b in zip(x.tolist(), y.tolist()) if a != b}
    near = np.bitwise_count(values[:, None] ^ values) <= radius
    assert pairs == {(a, b) for a, b in zip(*np.nonzero(near)) if a < b}
    monkeypatch.setattr(simhash, "SHARD", 64)
    nodes = spark.createDataFrame([(int(v), int(v)) for v in values.view(np.int64)], "node long, fp long")
    from veclode.llm.components import components

    root = {r["node"]: r["root"] for r in components(simhash.links(nodes, ["fp"], radius)).collect()}
    ids = values.view(np.int64)
    label = np.arange(len(ids))
    while True:
        new = np.array([label[near[i]].min() for i in range(len(ids))])
        if (new == label).all():
            break
        label = new
    groups = {frozenset(ids[label == x].tolist()) for x in set(label)}
    mine = defaultdict(set)
    for v in ids.tolist():
        mine[root.get(v, v)].add(v)
    assert {frozenset(g) for g in mine.values()} == groups


def test_components_of_a_long_path(spark):
    from veclode.llm.components import components

    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(900, 901), (5, 5)], "u long, v long")
    assert {(r["node"], r["root"]) for r in components(edges).collect()} == {(i, 0) for i in range(1, 301)} | {(901, 900)}


def test_near_dedup(spark, docs, empty):
    rng = np.random.default_rng(1)
    text = [f"w{rng.integers(0, 5000)}" for _ in range(300)]
    near, far = text.copy(), text.copy()
    near[100:103] = ["other", "three", "words"]
    far[::6] = ["changed"] * len(far[::6])
    data = [(5, " ".join(text), "s"), (3, " ".join(near), "s"), (9, " ".join(far), "s"), (7, " ".join(text), "s"), (8, "something else", "s"), (None, "no id", "s"), (10, None, "s"), (11, "", "s")]
    out = simhash.near_dedup(frame(spark, data))
    assert sorted((r["doc_id"] for r in out.collect()), key=repr) == sorted([3, 8, 9, 10, None], key=repr)
    assert out.columns == docs.columns
    assert simhash.near_dedup(empty).collect() == []


def test_near_dedup_of_repeated_and_null_ids(spark):
    a, other = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(60))
    data = [(1, a, "s"), (2, a, "s"), (2, other, "s"), (None, a, "s"), (1, a, "s"), (None, "x y", "s"), (None, "x y", "s")]
    out = [(r["doc_id"], r["text"]) for r in simhash.near_dedup(frame(spark, data)).collect()]
    assert Counter(out) == Counter([(1, a), (2, other), (None, "x y")])


def test_similar_sets_share_a_band():
    rng = np.random.default_rng(6)
    for share in (0.8, 0.9, 0.95, 1.0):
        for n in (40, 3000):
            for _ in range(20):
                both = rng.integers(0, 1 << 63, round(n * share), dtype=np.uint64)
                a, b = (np.unique(np.concatenate([both, rng.integers(0, 1 << 63, (n - len(both)) // 2, dtype=np.uint64)])) for _ in range(2))
                x, y = simhash.bands(simhash.low(a)), simhash.bands(simhash.low(b))
                assert (x == y).any() if share < 1 else (x == y).all()


def test_wide_fingerprints():
    """Bit by bit against plain sums, and the radius against sets of similarity 0.8 and unrelated ones."""
    m, rng = (1 << 64) - 1, np.random.default_rng(7)

    def mixed(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & m
        x = (x ^ x >> 27) * 0x94D049BB133111EB & m
        return x ^ x >> 31

    def whole(h):
        words = [[mixed((x + w * 0x9E3779B97F4A7C15) & m) for x in h.tolist()] for w in range(simhash.WORDS)]
        return b"".join(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in word) > len(h)).to_bytes(8, "little") for word in words)

    for n in (0, 1, 4, 99):
        h = rng.integers(0, 1 << 64, n, dtype=np.uint64)
        assert simhash.wide(h) == whole(h)
    assert simhash.wide(np.tile(h, 500)) == whole(h)
    assert simhash.radius_of(0.8) == 74 and simhash.radius_of(1) == 0
    for both, a, b in ((4, 1, 0), (12, 1, 2), (40, 5, 5), (400, 100, 0)):
        for _ in range(200):
            h = rng.integers(0, 1 << 64, both + a + b, dtype=np.uint64)
            x, y, far = (np.frombuffer(simhash.wide(s), np.uint64) for s in (h[: both + a], np.delete(h, np.s_[both : both + a]), rng.integers(0, 1 << 64, both, dtype=np.uint64)))
            assert np.bitwise_count(x ^ y).sum() <= 74 < np.bitwise_count(x ^ far).sum()


@pytest.mark.parametrize("most", [16, 1000])
def test_trees_of_wide_fingerprints_lose_no_link(spark, most):
    """The components of a shard's links, in one piece and in tiles, against all pairs: groups of copies, chains, equal ones."""
    from veclode.llm.components import components

    rng, radius, prints = np.random.default_rng(9), 20, []
    for _ in range(12):
        x = rng.integers(0, 2, 256, dtype=np.uint8)
        for _ in range(rng.integers(1, 40)):
            prints.append(np.packbits(x).tobytes())
            x = x ^ (rng.random(256) < rng.choice([0, 0.02, 0.07]))
    prints = [prints[i] for i in rng.permutation(len(prints))]
    all_ = np.frombuffer(b"".join(prints), np.uint64).reshape(len(prints), -1)
    label, near = np.arange(len(prints)), np.bitwise_count(all_[:, None] ^ all_).sum(-1) <= radius
    while (label != (new := np.array([label[x].min() for x in near]))).any():
        label = new
    assert 12 < len(set(label.tolist())) < len(prints) / 2
    assert simhash.spread(len(prints), simhash.by_tree(prints, radius)).tolist() == label.tolist()
    keys = spark.createDataFrame([(k, i) for k in (1, 2) for i in range(len(prints))], "key long, node long")
    loads = spark.createDataFrame(list(enumerate(map(bytearray, prints))), "node long, load binary")
    root = {r["node"]: r["root"] for r in components(simhash.grouped_links(keys, loads, simhash.by_tree, radius, most)).collect()}
    assert [root.get(i, i) for i in range(len(prints))] == label.tolist()


@pytest.mark.parametrize("most", [16, 40, 1000])
@pytest.mark.parametrize("loose", [0.6 - 1e-6, None])
def test_leaders_of_large_groups_lose_no_link(spark, most, loose):
    """The components of sets' links against all pairs: many copies of one, chains that drift away from it, strangers, empty sets."""
    from veclode.llm.components import components

    rng, own = np.random.default_rng(10), []
    for copies, drift in ((150, False), (60, True), (40, False), (25, True)):
        x = rng.integers(0, 1 << 62, 60, dtype=np.uint64)
        for _ in range(copies):
            y = x.copy()
            y[rng.choice(60, rng.integers(1, 5), replace=False)] = rng.integers(0, 1 << 62, 1, dtype=np.uint64)
            own.append(np.unique(y))
            x = y if drift else x
    own += [np.unique(rng.integers(0, 1 << 62, 60, dtype=np.uint64)) for _ in range(30)] + [own[0][:0]] * 3
    own = [own[i] for i in rng.permutation(len(own))]
    same = lambda a, b: len(a) > 0 and len(b) > 0 and 5 * len(np.intersect1d(a, b)) >= 4 * len(np.union1d(a, b))
    near = np.array([[i == j or same(a, b) for j, b in enumerate(own)] for i, a in enumerate(own)])
    label = np.arange(len(own))
    while (label != (new := np.array([label[x].min() for x in near]))).any():
        label = new
    keys = spark.createDataFrame([(k, i) for k in (1, 2) for i in range(len(own)) if k == 1 or i % 7 == 0], "key long, node long")
    loads = spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in enumerate(own)], "node long, load binary")
    root = {r["node"]: r["root"] for r in components(simhash.grouped_links(keys, loads, simhash.by_set, 0.8, most, loose)).collect()}
    assert [root.get(i, i) for i in range(len(own))] == label.tolist()


def test_a_large_group_of_copies_is_sent_once(spark, monkeypatch):
    """Its nodes meet their leader; neither they nor far strangers go into pairs of tiles, which would be 40 copies of each."""
    sent, linked = [], simhash._linked
    monkeypatch.setattr(simhash, "_linked", lambda rows, *a: (sent.append(rows.count()), linked(rows, *a))[1])
    rng = np.random.default_rng(11)
    x, far = np.arange(100, dtype=np.uint64), np.arange(1000, 1100, dtype=np.uint64)
    own = [np.append(x, np.uint64(5000 + i)) for i in range(400)] + [np.append(far, np.uint64(9000 + i)) for i in range(8)]
    keys = spark.createDataFrame([(1, int(i)) for i in rng.permutation(len(own))], "key long, node long")
    loads = spark.createDataFrame([(i, bytearray(v.tobytes())) for i, v in enumerate(own)], "node long, load binary")
    from veclode.llm.components import components

    root = {r["node"]: r["root"] for r in components(simhash.grouped_links(keys, loads, simhash.by_set, 0.8, 10, 0.6 - 1e-6)).collect()}
    assert [root.get(i, i) for i in range(len(own))] == [0] * 400 + [400] * 8
    assert sum(sent) <= 16


def test_near_dedup_finds_its_pairs_in_the_trees(spark, monkeypatch):
    """A near copy goes because a tree's search returns it: with a radius that returns nothing, only equal sets go."""
    words = [f"w{i}" for i in range(200)]
    data = [(1, " ".join(words), "s"), (2, " ".join(words[:-3]), "s"), (3, " ".join(words).upper(), "s")]
    assert {r["doc_id"] for r in simhash.near_dedup(frame(spark, data)).collect()} == {1}
    monkeypatch.setattr(simhash, "radius_of", lambda similarity: -1)
    assert {r["doc_id"] for r in simhash.near_dedup(frame(spark, data)).collect()} == {1, 2}


def test_exact_topk(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD", 16)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 4)
    rng = np.random.default_rng(2)
    data = [(i, [float(x) for x in rng.choice([-1.0, -0.5, 0.013, 0.25, 1.0], 6)]) for i in range(120)]
    data += [(20, None), (140, [None] * 6), (160, [float("nan")] * 6), (180, [float("inf")] + [0.0] * 5), (None, [0.0] * 6), (7, data[0][1]), (200, []), (220, [1.0] * 3), (221, [1.0] * 3)]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in data], "vec_id long, embedding array<float>, label int, shard int")
    good = [(i, np.floor(64 * np.array(v, np.float32).astype(float)).astype(int)) for i, v in data if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q, v in good:
        if q % 20 == 0:
            s = sorted((-int(v @ w), i) for i, w in good if i != q and len(w) == len(v))[:20]
            want += [(q, n + 1, i, -x) for n, (x, i) in enumerate(s)]
    assert got(topk.search(df), "query_id", "rank", "vec_id", "score") == sorted(want, key=repr)
    assert topk.search(df.limit(0)).collect() == []


def test_exact_topk_of_large_numbers(spark):
    big = 1 << 40
    df = spark.createDataFrame([(0, [big, 3]), (1, [big, 1]), (2, [big, 2]), (3, [-big, 5])], "vec_id long, v array<long>")
    out = topk.exact_topk(df, df.where("vec_id = 0"), 3).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in out] == [(2, 2**63 - 1), (1, 2**63 - 1), (3, 1 - 2**63)]
    small = spark.createDataFrame([(i, [1 << 28, i]) for i in range(4)], "vec_id long, v array<long>")
    assert [(r["vec_id"], r["score"]) for r in topk.exact_topk(small, small.where("vec_id = 1"), 2).orderBy("rank").collect()] == [(3, (1 << 56) + 3), (2, (1 << 56) + 2)]


def test_exact_topk_of_repeated_rows(spark):
    data = [(0, [1, 0]), (0, [0, 1]), (0, [0, 1]), (1, [5, 1]), (2, [3, 3]), (3, [1, 9]), (20, []), (40, [])]
    df = spark.createDataFrame(data, "vec_id long, v array<long>").repartition(3)
    got = defaultdict(list)
    for r in topk.exact_topk(df, df.where("vec_id % 20 = 0"), 2).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(got[0]) == sorted([(1, 1, 5), (2, 2, 3)] + [(1, 3, 9), (2, 2, 3)] * 2)
    assert got[20] == [(1, 40, 0)] and got[40] == [(1, 20, 0)]


def labelled(spark, n=600):
    rng = np.random.default_rng(4)
    vocab = [f"word{i}" for i in range(400)]
    docs, labels = [], []
    for i in range(n):
        w = list(rng.choice(vocab, rng.integers(20, 200)))
        bad, toxic = i % 5 == 1, i % 4 == 1
        if toxic:
            for _ in range(rng.integers(1, 5)):
                w.insert(int(rng.integers(0, len(w))), str(rng.choice(["blockhead", "numbskull", "dimwit"])))
        if bad:
            w = w[:3] * 30 if i % 2 else [x.upper() + "###" for x in w]
        docs.append((i, " ".join(w), "s"))
        labels.append((i, 0 if bad else 1, int(toxic)))
    docs += [(None, "no id", "s"), (9001, None, "s"), (9002, "", "s"), (9003, "long " * 50_000, "s"), (3, docs[3][1], "s")]
    labels += [(None, 1, 1), (5, None, None), (7000, 1, 0), (3, 1, 0)]
    return docs, labels, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize(("digest", "column", "modulus", "held", "at"), [(quality.digest, 1, 5, 0, 0.3), (toxicity.digest, 2, 3, 1, 0.7)])
def test_classifiers(spark, empty, digest, column, modulus, held, at):
    docs, labels, table = labelled(spark)
    out = digest(frame(spark, docs), table).collect()
    assert len(out) == len(docs)
    truth = {x[0]: x[column] for x in labels if x[column] is not None}
    right = total = 0
    for r in out:
        i = r["doc_id"]
        fold = i is not None and zlib.crc32(str(i).encode()) % modulus == held
        assert r["held_out"] is fold and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= at)
        if fold and i in truth:
            total += 1
            right += r["predicted"] == truth[i]
    assert total > 50 and right / total > 0.95
    again = digest(frame(spark, docs).repartition(7), table).collect()
    assert sorted((str(r["doc_id"]), round(r["score"], 6)) for r in out) == sorted((str(r["doc_id"]), round(r["score"], 6)) for r in again)
    assert digest(empty, table).collect() == []
    assert len(digest(frame(spark, docs), table.limit(0)).collect()) == len(docs)


def test_toxicity_features_are_the_log_count_ratios(spark, monkeypatch):
    """Counts, significance and ratios of every n-gram of characters, from sets of strings."""
    monkeypatch.setattr(toxicity, "FEATURES", 300)
    docs, labels, table = labelled(spark)
    docs = [(i, (t or "") + " 日本語です" * (i is not None and i % 9 == 0), s) for i, t, s in docs]

    def number(gram):
        h = ord(gram[0])
        for c in gram[1:]:
            h = (h * 0x01000193 + ord(c)) & 0xFFFFFFFF
        h = (h ^ h >> 15) * (0x2C1B3C6D + 2 * len(gram)) & 0xFFFFFFFF
        return h >> 12

    truth, text, n = {}, {}, Counter()
    for i, _, y in labels:
        if i is not None and y is not None and zlib.crc32(str(i).encode()) % 3 != 1:
            truth[i] = max(y, truth.get(i, 0))
    for i, t, _ in docs:
        if i in truth:
            text[i] = min(t, text.get(i, t))
    count = {0: Counter(), 1: Counter()}
    for i, t in text.items():
        own = " " + " ".join(x for x in re.split(r"[\x20\x09-\x0D]+", t.translate(LOW)) if x) + " "
        n[truth[i]] += 1
        count[truth[i]].update({number(own[a : a + k]) for k in (4, 5, 6, 7) for a in range(len(own) - k + 1)})
    ranked = []
    for f in count[0].keys() | count[1].keys():
        pos, neg = count[1][f], count[0][f]
        share = (pos + neg) / (n[0] + n[1])
        z = (pos / n[1] - neg / n[0]) / math.sqrt(share * (1 - share) * (1 / n[0] + 1 / n[1]) + 1e-12)
        if abs(z) >= toxicity.Z and (pos if z > 0 else neg) >= 3:
            ranked.append((-round(abs(z), 9), f, math.log((pos + 1) / (n[1] + 2) * (n[0] + 2) / (neg + 1))))
    ranked.sort()
    model = toxicity.fit(frame(spark, docs), table)
    assert len(model.ratio) == min(300, len(ranked)) > 60
    edge = ranked[len(model.ratio) - 1][0]
    want = {f: r for z, f, r in ranked if z < edge}
    mine = {int(f): float(model.ratio[model.slot[f] - 1]) for f in np.flatnonzero(model.slot)}
    assert len(want) > 40 and all(mine[f] == pytest.approx(r) for f, r in want.items())


def test_toxicity_weights_have_no_gradient():
    rng = np.random.default_rng(3)
    y, bits = (rng.random(300) < 0.3).astype(float), rng.random((300, 40)) < 0.3
    bits[:, :5] |= (y[:, None] > 0) & (rng.random((300, 5)) < 0.6)
    model = toxicity.Toxic(np.arange(40), rng.normal(size=40))
    model.learn(y, np.packbits(bits, axis=1), steps=20_000, ridge=1e-2)

    def loss(w):
        s = (bits * model.ratio) @ w[:-1] + w[-1]
        return np.mean(np.log1p(np.exp(-s * (2 * y - 1)))) + 0.005 * (w[:-1] ** 2).sum()

    best = min((loss(np.append(model.w, b)), b) for b in np.linspace(-20, 20, 40_001))[1]
    at = np.append(model.w, best)
    for i in range(40):
        step = np.zeros(41)
        step[i] = 1e-4
        assert abs(loss(at + step) - loss(at - step)) / 2e-4 < 2e-3
    rows_, cols = np.nonzero(bits)
    numeric = [(loss(at + h) - loss(at - h)) / 2e-5 for h in np.eye(41) * 1e-5]
    assert np.allclose(toxicity.gradient(at, rows_, cols, model.ratio[cols], y, 1e-2), numeric, atol=1e-6)


def test_quality_weights_have_no_gradient():
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(400, 6)), (rng.random(400) < 0.5).astype(int)
    x[:, 0] += 1.5 * y
    model = quality.Ranking(x, y, seed=7)
    again, z = np.random.default_rng(7), np.clip((x - x.mean(0)) / (x.std(0) + 1e-3), -6, 6)
    d = z[again.choice(np.flatnonzero(y == 1), quality.PAIRS)] - z[again.choice(np.flatnonzero(y == 0), quality.PAIRS)]
    loss = lambda w: np.log1p(np.exp(-(d @ w))).sum() + quality.RIDGE / 2 * (w @ w)
    for h in np.eye(6) * 1e-4:
        assert abs(loss(model.w + h) - loss(model.w - h)) / 2e-4 < 1e-2
    wins = lambda cut: (z[y == 1] @ model.w >= cut).mean() + (z[y == 0] @ model.w < cut).mean()
    assert wins(model.cut) >= max(map(wins, np.quantile(z @ model.w, np.linspace(0, 1, 2001)))) - 1e-9


def test_quality_filter_keeps_columns(spark):
    docs, _, table = labelled(spark)
    out = quality.good(frame(spark, docs), table)
    assert out.columns == frame(spark, docs).columns and 400 < out.count() < 560


def test_pieces_round_trip(docs, empty):
    out = pieces.digest(docs).collect()
    assert all(r["decoded"] for r in out)
    by = defaultdict(list)
    for r in out:
        by[(r["doc_id"], r["sample"])].append(r["ids_sha256"])
    assert {i for i, _ in by} == {i for i, _, _ in rows()}
    assert all(by[(i, 1)] != by[(i, 2)] for i, t, _ in rows() if t and t.strip())
    assert [r["n_pieces"] for r in out if r["doc_id"] == 301] == [0]
    again = pieces.digest(docs.repartition(2)).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    assert pieces.digest(empty).collect() == []


def test_pieces_sample_without_replacement():
    """Frequencies of the best and the second leaf, against the enumerated segmentations of a short text."""
    v, text, n = pieces.Vocabulary(), "the cat", 6000
    lattice = pieces.Lattice(v, [" the", " cat"])

    def paths(state):
        if not lattice.count[state]:
            return [((), 0.0)]
        own = range(lattice.off[state], lattice.off[state] + lattice.count[state])
        return [((int(lattice.code[e]), *p), lattice.logp[e] + x) for e in own for p, x in paths(lattice.to[e])]

    p = {a + b: math.exp(x + y) for a, x in paths(lattice.start[0]) for b, y in paths(lattice.start[1])}
    assert sum(p.values()) == pytest.approx(1)
    first, both = Counter(), Counter()
    found, leaves = pieces.sample(v, [xxhash.xxh64_intdigest(str(j).encode()) for j in range(n)], [text] * n, 3)
    for own, kappa in leaves:
        ids = [tuple(found.ids(path[1]).tolist()) for path, _, _ in own]
        assert len(set(ids)) == 3 and own[0][2] >= own[1][2] >= own[2][2] >= kappa
        assert all(x == pytest.approx(math.log(p[i])) for i, (_, x, _) in zip(ids, own))
        first[ids[0]] += 1
        both[ids[0], ids[1]] += 1
    for a, q in sorted(p.items(), key=lambda x: -x[1])[:4]:
        assert first[a] / n == pytest.approx(q, abs=4 * math.sqrt(q / n))
    for (a, b), c in both.most_common(4):
        q = p[a] * p[b] / (1 - p[a])
        assert c / n == pytest.approx(q, abs=4 * math.sqrt(q / n))


@pytest.mark.parametrize("text", ["the", "the cats"])
def test_inclusion_scores_are_unbiased(text):
    """Each segmentation, counted by one over its inclusion probability where it is sampled, averages to one; weighted by
    its probability, the sum of the samples averages to one too."""
    v, n = pieces.Vocabulary(), 20_000
    lattice, found = pieces.sample(v, [xxhash.xxh64_intdigest(f"i{j}".encode()) for j in range(n)], [text] * n, 2)
    weight, total, square = defaultdict(float), 0.0, defaultdict(float)
    for own, kappa in found:
        for path, log_p, _ in own[:2]:
            ids = tuple(lattice.ids(path[1]).tolist())
            w = math.exp(-pieces.inclusion(log_p, kappa))
            weight[ids] += w / n
            square[ids] += w * w / n
            total += math.exp(log_p) * w / n
    assert total == pytest.approx(1, abs=0.02)
    common = [i for i in weight if square[i] < 60]
    assert len(common) >= 2
    for i in common:
        assert weight[i] == pytest.approx(1, abs=5 * math.sqrt(square[i] / n))


def test_pieces_of_a_single_character():
    v = pieces.Vocabulary()
    lattice, ((leaves, kappa),) = pieces.sample(v, [1], ["\n"], 5)
    assert 1 <= len(leaves) <= 5 and all(v.decode(lattice.ids(p[1]).tolist()) == "\n" for p, _, _ in leaves)
    assert kappa == -math.inf or len(leaves) == 5


def edited(words, how, share, rng):
    """A near copy that differs in one block of a share of the words."""
    n = max(1, round(share * len(words)))
    block, at = [f"new{x}" for x in rng.integers(0, 10**9, n)], int(rng.integers(0, len(words) - n))
    return words + block if how == "append" else words[:at] + block + words[at + (n if how == "replace" else 0) :]


def test_near_dedup_finds_what_differs_in_one_block(spark):
    """Recall and precision against the exact similarity, on blocks appended, inserted and replaced."""
    rng, data, copies, kept = np.random.default_rng(8), [], 0, set()
    for size in (30, 100, 300, 1000):
        for how, shares in (("append", (0.10, 0.15, 0.22, 0.30)), ("insert", (0.05, 0.10, 0.15, 0.30)), ("replace", (0.03, 0.07, 0.10, 0.20))):
            for share in np.repeat(shares, 15):
                a = [f"w{x}" for x in rng.zipf(1.3, size) % 20_000]
                b = edited(a, how, share, rng)
                x, y = ({tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in (a, b))
                same = 5 * len(x & y) >= 4 * len(x | y)
                copies += same
                kept |= {len(data)} | ({len(data) + 1} if not same else set())
                data += [(len(data), " ".join(a), "s"), (len(data) + 1, " ".join(b), "s")]
    assert copies > 300
    out = {r["doc_id"] for r in simhash.near_dedup(frame(spark, data)).collect()}
    print("copies", copies, "missed", len(out - kept), "wrongly dropped", len(kept - out))
    assert out == kept


@pytest.mark.parametrize("text", ["see https://www.example.com/international/internationalization.html now", " " * 12 + "return x", "0123456789abcdef" * 30, "日本語の文章には空白がない" * 12, "a" + " " * 70 + "b\n\n  c", "x" * 40_000])
def test_pieces_lattice_is_the_whole_text(text):
    """log p against the sum over all segmentations, and the model's own segmentation, which must have a probability."""
    import sentencepiece

    v, sp = pieces.Vocabulary(), sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    weight = {}
    for i in range(sp.get_piece_size()):
        if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i)):
            weight[sp.id_to_piece(i).replace("▁", " ")] = 1 / (pieces.SHIFT - sp.get_score(i))
    full, longest = " " + text, max(map(len, weight))
    edge = lambda a, b: weight.get(full[a:b], v.rare if b == a + 1 else 0)
    z = [0.0] * (len(full) + 1)
    for a in range(len(full) - 1, -1, -1):
        own = [(math.log(w) + z[b]) for b in range(a + 1, min(len(full), a + longest) + 1) if (w := edge(a, b))]
        z[a] = max(own) + math.log(sum(math.exp(x - max(own)) for x in own))
    lattice, ((leaves, _),) = pieces.sample(v, [5], [text], 2)
    for (_, path), log_p, _ in leaves:
        ids = lattice.ids(path).tolist()
        assert v.decode(ids) == text
        want = sum(math.log(v.rare if c < 0 else weight[v.raw[c].decode()]) for c in lattice.code[path].tolist()) - z[0]
        assert log_p == pytest.approx(want, rel=1e-6, abs=1e-6)
    at = {}
    for state, unit in zip(lattice.start.tolist(), dict.fromkeys(v.units.findall(full)), strict=True):
        at[unit] = state
    steps, place = {}, 0
    for unit in v.units.findall(full):
        steps |= {place + k: at[unit] + k for k in range(len(unit))}
        place += len(unit)
    done = b""
    for i in sp.encode(text):
        if not sp.is_byte(i):
            state = steps[len(done.decode())]
            own = range(lattice.off[state], lattice.off[state] + lattice.count[state])
            assert any(lattice.code[e] == i and lattice.p[e] > 0 for e in own), sp.id_to_piece(i)
        done += v.raw[i]
    assert done.decode() == full


def test_pieces_build_a_unit_once_and_the_same_in_any_batch(monkeypatch):
    """What a lattice holds of a unit depends on the unit alone, to the last bit; batches that share a lattice build a unit
    once, get the same samples as alone, and beyond KEPT edges build the other units anew."""
    v, rng = pieces.Vocabulary(), np.random.default_rng(4)
    text = [" ".join("".join(rng.choice(list("aeinrst"), rng.integers(1, 50))) for _ in range(40)) + "\n é 🙂" for _ in range(30)]
    units = list(dict.fromkeys(u for t in text for u in v.units.findall(" " + t)))
    lattice = pieces.Lattice(v, units)
    for unit, start in zip(units, lattice.start.tolist(), strict=True):
        alone = pieces.Lattice(v, [unit])
        for state in range(len(unit) + 1):
            a, b, n = lattice.off[start + state], alone.off[state], lattice.count[start + state]
            assert n == alone.count[state]
            assert all((getattr(lattice, x)[a : a + n] == getattr(alone, x)[b : b + n]).all() for x in ("p", "logp", "cum", "code"))
    sent = pieces.sample(pickle.loads(pickle.dumps(v)), list(range(len(text))), text, 2)[0]  # as a broadcast sends it
    assert len(sent.start) == len(units)
    looked, find = [], pieces.Vocabulary.find
    monkeypatch.setattr(pieces.Vocabulary, "find", lambda self, h: looked.append(len(h)) or find(self, h))

    def samples(docs, **shared):
        own, found = pieces.sample(v, [7] * len(docs), docs, 2, **shared)
        return [([(own.ids(path[1]).tolist(), log_p, g) for path, log_p, g in leaves], kappa) for leaves, kappa in found]

    want = [samples([t])[0] for t in text]
    assert samples(text[:1] * 3)[0] == want[0]
    for most in (pieces.KEPT, 5000):
        monkeypatch.setattr(pieces, "KEPT", most)
        shared = pieces.Lattice(v)
        for again in range(2):
            looked.clear()
            assert [samples([t], lattice=shared)[0] for t in text] == want
            assert (sum(looked) == 0) == (again and most > 5000)
        assert shared.size[1] <= most
    assert 0 < shared.size[1] and len(shared.p) < 50_000
