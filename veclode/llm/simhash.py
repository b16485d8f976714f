"""SimHash near-dedup with BK-trees.

Fingerprints come from one pass over each text. Equal fingerprints are one node from there on, however many
documents have them. To find all pairs within a radius without comparing all, a fingerprint is cut into more
blocks than the radius: two fingerprints that differ in r bits agree exactly on all but r blocks, so each is
sent once for every choice of blocks that may agree, to the shard of those bits. A shard builds a BK-tree
(children keyed by Hamming distance to their parent) and every member searches it along the edges within the
radius. The number of blocks follows the number of fingerprints, so shards keep a bounded size at any scale; a
shard beyond it is dealt into tiles, and the tree of each tile is sent to the tasks of the tiles that search
it. It goes through the shuffle rather than through the driver, which never holds fingerprints or links. A task
returns a spanning forest of the links it found, so its output is as long as its input, not its square; the
forests' connected components are the result.

The pipeline's stage, near_dedup, owes similarity 0.8 of five-word shingles. At that similarity two fingerprints of 64
bits differ in ten bits on average and in over twenty now and then, as unrelated ones do in thirty-two: too few bits to
tell them apart. Its fingerprints are SimHashes of the set of shingles in 256 bits, where they differ in 39 and 128 bits,
and radius 74 lies far from both. Choices of blocks that agree do not exist at such a radius, so MinHash bands of the
shingles deal the fingerprints into shards; the BK-tree of a shard finds the pairs, and exact shingle sets decide.

Defined cases: a text without words has fingerprint zero and links like any other; null text is empty; rows
that repeat belong to one node; null ids are the smallest only where a component has no other; an empty table
gives an empty result. near_dedup names a row by its id and text: of rows that repeat both, one stays at most, and of
rows that repeat an id alone each has a fate of its own.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches, cut, list_array, spare, texts, with_key
from .components import components

SEED, CHUNK, BINS = 42, 65_536, 512
#: Nodes of a shard's tree, on average; a shard of over twice as many is dealt into tiles.
SHARD = 1024
#: Leaders that a key of very many nodes gets, one after another, before what is left is compared in pairs of tiles.
TURNS = 4
#: Candidates agree in one of BANDS bands of ROWS minima: a pair of similarity 0.8 does not with probability 7e-5.
BANDS, ROWS = 24, 5
#: Words of 64 bits of a set's fingerprint, and the deviations above the mean up to which differing bits make a candidate.
#: At similarity 0.8 that is a radius of 74: it is passed with probability 7e-9 in large sets, 3e-5 at most (4 shingles of 5).
WORDS, DEVIATIONS = 4, 6
EMPTY = np.iinfo(np.uint64).max
#: The order in which a minimum looks for a full bin: its own first, then the others at random.
_PROBE = np.random.default_rng(SEED).permuted(np.tile(np.arange(BINS, dtype=np.int64), (BANDS * ROWS, 1)), axis=1)
_PROBE = np.array([[i, *row[row != i]] for i, row in enumerate(_PROBE)])
#: Fingerprints that may agree on the chosen blocks by chance, on average, before more blocks are used: a part of a shard.
CHANCE = 256
_BITS = (np.arange(256)[:, None] >> np.arange(8)) & 1  # of a byte, lowest first
_COLS = np.arange(8) * 256
_STEPS = np.arange(WORDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def shingled(n: int) -> Callable[[list[bytes]], list[bytes]]:
    """The n-word shingles, repeats included; of fewer words the whole sequence."""

    def features(words: list[bytes]) -> list[bytes]:
        if n == 1 or not words:
            return words
        joined = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        k = max(1, len(words) - n + 1)
        last = ends[n - 1 :] if len(words) >= n else ends[-1:]
        return [joined[a:b] for a, b in zip(starts[:k].tolist(), last.tolist(), strict=True)]

    return features


def hashes(features: list[bytes], seed: int = SEED) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(f, seed) for f in features), "<u8", len(features))


def votes(h: np.ndarray) -> int:
    """The fingerprint: a bit is set if it is in over half the hashes."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(h), CHUNK):
        bins = np.bincount((h[i : i + CHUNK].view(np.uint8).reshape(-1, 8) + _COLS).ravel(), minlength=2048).reshape(8, 256)
        counts += (bins @ _BITS).ravel()
    bits = counts * 2 > len(h)
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little", signed=True)


def wide(h: np.ndarray) -> bytes:
    """The fingerprint of a set of hashes in WORDS words, from as many hashes made of each (splitmix64)."""
    counts = np.zeros((8 * WORDS, 8))
    for i in range(0, len(h), CHUNK // WORDS):
        z = h[i : i + CHUNK // WORDS, None] + _STEPS
        z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
        at = z.view(np.uint8).reshape(len(z), -1) + np.arange(8 * WORDS) * 256
        counts += np.bincount(at.ravel(), minlength=2048 * WORDS).reshape(-1, 256).astype(float) @ _BITS.astype(float)
    return np.packbits(counts * 2 > len(h), bitorder="little").tobytes()


def radius_of(similarity: float) -> int:
    """The bits in which wide fingerprints of sets of the similarity may differ: such sets are at the angle p pi at most."""
    n, p = 64 * WORDS, math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.ceil(n * p + DEVIATIONS * math.sqrt(n * p * (1 - p)))


def fingerprints(docs: DataFrame, views: dict[str, Callable]) -> DataFrame:
    """doc_id and a bigint fingerprint for each view (name: features of the words)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            out = [[] for _ in views]
            for t in b.column("text"):
                words = t.as_py().encode().lower().split()
                for o, features in zip(out, views.values(), strict=True):
                    o.append(votes(hashes(features(words))))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(o, pa.int64()) for o in out)], names=["doc_id", *views])

    return texts(docs).mapInArrow(run, "doc_id long, " + ", ".join(f"{v} long" for v in views))


class BKTree:
    """A static BK-tree over distinct uint64, or rows of several, built and searched in batches. Up to LEAF nodes stay
    a list."""

    LEAF = 24

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        d = np.bitwise_count(a ^ b)
        return d.sum(-1, dtype=np.int16) if self.values.ndim > 1 else d

    def __init__(self, values: np.ndarray) -> None:
        self.values = values
        self.nodes: list = []
        todo = [(np.arange(len(values)), None)] if len(values) else []
        while todo:
            members, put = todo.pop()
            if len(members) <= self.LEAF:
                self.nodes.append((members, None))
            else:
                head, rest = members[0], members[1:]
                d = self.apart(values[rest], values[head])
                order = np.argsort(d, kind="stable")
                keys, first = np.unique(d[order], return_index=True)
                edges: dict[int, int] = {}
                self.nodes.append((members[:1], edges))
                todo += [(part, (edges, int(key))) for key, part in zip(keys, np.split(rest[order], first[1:]), strict=True)]
            if put:
                put[0][put[1]] = len(self.nodes) - 1

    def search(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query positions, tree positions) of the pairs within the radius, in pieces."""
        todo = [(0, np.arange(len(queries)))] if self.nodes else []
        while todo:
            at, q = todo.pop()
            members, edges = self.nodes[at]
            d = self.apart(queries[q, None], self.values[members])
            hit, which = np.nonzero(d <= radius)
            if len(hit):
                yield q[hit], members[which]
            if edges is not None:
                d = d[:, 0].astype(np.int16)
                for key, child in edges.items():
                    near = q[np.abs(d - key) <= radius]
                    if len(near):
                        todo.append((child, near))


def forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest position linked to each of n positions."""
    label = np.arange(n)
    for a, b in pairs:
        while True:
            low = np.minimum(label[a], label[b])
            if (label[a] == low).all() and (label[b] == low).all():
                break
            for x in (a, b):
                np.minimum.at(label, label[x], low)
            while (label != (up := label[label])).any():
                label = up
    return label


def _tile(radius: int, accept: Callable | None, columns: list[str]):
    def run(key, t):
        _, a, b = (x.as_py() for x in key[-3:])
        t = t.combine_chunks()
        node, fp, tile = (t.column(c).to_numpy() for c in ("node", "fp", "tile"))
        fp = fp.view(np.uint64)
        check = [t.column(c) for c in columns]
        check = [np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(len(node), -1) if pa.types.is_binary(c.type) else c.to_numpy().view(np.uint64) for c in check]
        left, right = np.flatnonzero(tile == a), np.flatnonzero(tile == b)
        tree = BKTree(fp[left])

        def pairs():
            for x, y in tree.search(fp[right], radius):
                x, y = right[x], left[y]
                ok = x != y
                x, y = x[ok], y[ok]
                if accept:
                    ok = accept(*(c[x] for c in check), *(c[y] for c in check))
                    x, y = x[ok], y[ok]
                if len(x):
                    yield x, y

        label = forest(len(node), pairs())
        own = np.flatnonzero(label != np.arange(len(node)))
        return pa.table({"u": node[own], "v": node[label[own]]}, schema=pa.schema([("u", pa.int64()), ("v", pa.int64())]))

    return run


def _blocks(n: int, radius: int) -> list[int]:
    """Masks of the bits that may have to agree: every choice of m - radius of m blocks, for the least m at which
    n fingerprints rarely agree on so many bits by chance."""
    m = radius + 1
    while n > CHANCE * 2 ** (64 * (m - radius) / m) and m < 3 * radius + 2:
        m += 1
    borders = [round(64 * i / m) for i in range(m + 1)]
    parts = [sum(1 << j for j in range(x, y)) for x, y in zip(borders, borders[1:], strict=False)]
    return [sum(c) for c in combinations(parts, m - radius)]


def links(nodes: DataFrame, fps: list[str], radius: int, accept: Callable | None = None, columns: list[str] | None = None) -> DataFrame:
    """A spanning forest (u, v) of the links between nodes: within the radius in any of the columns fps and, if there
    is an `accept`, accepted by it from the values of `columns` at either end. nodes: node, fps, columns; distinct."""
    keep = columns or []
    n = nodes.count()
    routes = []
    for f in fps:
        for i, mask in enumerate(_blocks(n, radius)):
            mask = mask - (1 << 64) if mask >> 63 else mask
            routes.append(F.struct(F.col(f).alias("fp"), F.xxhash64(F.lit(f"{f}/{i}"), F.col(f).bitwiseAND(F.lit(mask))).alias("agree")))
    rows = nodes.select("node", *keep, F.inline(F.array(*routes)))
    rows = rows.withColumn("shard", F.pmod("agree", F.lit(max(1, len(routes) * n // SHARD))))
    sizes = rows.groupBy("shard").count().where(F.col("count") > 2 * SHARD)
    rows = rows.join(sizes, "shard", "left").withColumn("tiles", F.ceil(F.coalesce("count", F.lit(1)) / SHARD).cast("int"))
    rows = rows.withColumn("tile", F.pmod(F.xxhash64("node", F.lit(3)), F.col("tiles")).cast("int"))
    ends = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda x: F.struct(F.least("tile", x).alias("a"), F.greatest("tile", x).alias("b")))
    rows = rows.select("shard", "node", "fp", *keep, "tile", F.inline(ends))
    return rows.groupBy("shard", "a", "b").applyInArrow(_tile(radius, accept, keep), "u long, v long")


def _nodes(prints: DataFrame, fps: list[str]) -> tuple[DataFrame, DataFrame]:
    """prints with the node of each row, and the nodes: what its rows share, and their smallest doc_id."""
    node = F.col(fps[0]) if len(fps) == 1 else F.xxhash64(*fps)
    prints = cut(prints.withColumn("node", node))
    shared = [F.min(c).alias(c) for c in prints.columns if c not in ("doc_id", "node")]
    return prints, cut(prints.groupBy("node").agg(F.min("doc_id").alias("first"), *shared))


def _named(prints: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """doc_id, node and component_id, the smallest doc_id that the edges reach."""
    roots = components(edges)
    named = nodes.select("node", "first").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = named.join(named.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("node", "component_id")
    return prints.join(named, "node")


def digest(docs: DataFrame) -> DataFrame:
    """3-word fingerprints, linked at up to 2 differing bits."""
    prints, nodes = _nodes(fingerprints(docs, {"fp": shingled(3)}), ["fp"])
    out = _named(prints, nodes, links(nodes.select("node", "fp"), ["fp"], 2))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def low(h: np.ndarray) -> np.ndarray:
    """The smallest hash in each of BINS bins (less the bin's number), EMPTY where there is none."""
    out = np.full(BINS, EMPTY, np.uint64)
    np.minimum.at(out, (h % np.uint64(BINS)).astype(np.int64), h // np.uint64(BINS))
    return out


def bands(lows: np.ndarray) -> np.ndarray:
    """BANDS keys of ROWS minima each. An empty bin takes the first full one in an order of its own, so each minimum
    agrees with the probability of the similarity however few hashes there are."""
    full = lows != EMPTY
    if not full.any():
        return np.zeros(0, np.int64)
    pick = _PROBE[np.arange(len(_PROBE)), full[_PROBE].argmax(1)]
    least = (lows[pick] * np.uint64(BINS) + pick.astype(np.uint64)).reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(x.tobytes(), i) for i, x in enumerate(least)], np.uint64).view(np.int64)


def shingle_set(text: str) -> np.ndarray:
    """The sorted hashes of the five-word shingles."""
    return np.unique(hashes(shingled(5)(text.encode().lower().split())))


def set_prints(docs: DataFrame) -> DataFrame:
    """doc_id, k1, k2 (they name a row), node (the set of five-word shingles, hashed), its wide fingerprint and its bands."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            nodes, prints, keys = [], [], []
            for t in b.column("text"):
                h = shingle_set(t.as_py())
                nodes.append(xxhash.xxh64_intdigest(h.tobytes(), SEED))
                prints.append(wide(h))
                keys.append(bands(low(h)))
            sizes = np.array([len(k) for k in keys], np.int64)
            flat = np.concatenate([np.zeros(0, np.int64), *keys])
            arrays = [b.column("doc_id"), b.column("k1"), b.column("k2"), pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(prints, pa.binary()), list_array(flat, sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "k1", "k2", "node", "fp", "bands"])

    return with_key(texts(docs)).mapInArrow(run, "doc_id long, k1 long, k2 long, node long, fp binary, bands array<long>")


def sets(rows: DataFrame) -> DataFrame:
    """node and load, the shingle set, of rows node, text."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array([shingle_set(t.as_py()).tobytes() for t in b.column("text")], pa.binary())], names=["node", "load"])

    return rows.select("node", "text").mapInArrow(run, "node long, load binary")


def spread(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> np.ndarray:
    """The smallest position linked to each of n, by links that are found when looked for: near(i, others) says which
    of the others i is linked to. Positions already reached are not looked at again, so a group of copies takes one
    look and the components are still those of all pairs."""
    label, rest = np.arange(n), np.arange(n)
    while len(rest):
        first, rest = rest[0], rest[1:]
        todo = [first]
        while todo and len(rest):
            hit = near(todo.pop(), rest)
            label[rest[hit]] = first
            todo += rest[hit].tolist()
            rest = rest[~hit]
    return label


def by_tree(loads: list[bytes], radius: int) -> Callable[[int, np.ndarray], np.ndarray]:
    """Links within the radius, found in a BK-tree of wide fingerprints. Others only ever get fewer; once they are less
    than half of the tree's, they get a tree of their own."""
    all_ = np.frombuffer(b"".join(loads), np.uint64).reshape(len(loads), -1)
    held, tree = np.zeros(0, np.int64), BKTree(all_[:0])

    def near(i: int, others: np.ndarray) -> np.ndarray:
        nonlocal held, tree
        if not len(held) or 2 * len(others) < len(held):
            held, tree = others, BKTree(all_[others])
        hit = np.zeros(len(all_), bool)
        for _, at in tree.search(all_[i : i + 1], radius):
            hit[held[at]] = True
        return hit[others]

    return near


def by_set(loads: list[bytes], least: float) -> Callable[[int, np.ndarray], np.ndarray]:
    own = [np.frombuffer(x, np.uint64) for x in loads]
    size = np.array([len(x) for x in own])

    def near(i: int, others: np.ndarray) -> np.ndarray:
        out = np.zeros(len(others), bool)
        a, n = own[i], size[others]
        may = np.flatnonzero((np.minimum(n, len(a)) >= least * np.maximum(n, len(a)) - 1e-9) & (n > 0))
        for k in range(0, len(may), 256):
            part = may[k : k + 256]
            flat = np.concatenate([own[j] for j in others[part]])
            at = np.minimum(np.searchsorted(a, flat), len(a) - 1)
            both = np.add.reduceat((a[at] == flat).astype(np.int64), np.cumsum(n[part]) - n[part])
            out[part] = both >= least * (len(a) + n[part] - both) - 1e-9
        return out

    return near


_UV = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def tiled(rows: DataFrame, most: int) -> DataFrame:
    """rows (key, node) as shard, key, node, a, b: keys share shards of `most` rows on average; a larger one is dealt into tiles,
    and each pair of tiles (a, b) is a task."""
    rows = rows.withColumn("shard", F.pmod("key", F.lit(max(1, rows.count() // most))))
    sizes = rows.groupBy("shard").count().where(F.col("count") > 2 * most)
    rows = rows.join(sizes, "shard", "left").withColumn("tiles", F.ceil(F.coalesce("count", F.lit(1)) / most).cast("int"))
    rows = rows.withColumn("tile", _dealt("tiles", 3))
    ends = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda x: F.struct(F.least("tile", x).alias("a"), F.greatest("tile", x).alias("b")))
    return rows.select("shard", "key", "node", F.inline(ends))


def _dealt(n: str, seed: int) -> Column:
    return F.pmod(F.xxhash64("node", F.lit(seed)), F.col(n)).cast("int")


def _linked(rows: DataFrame, links_of: Callable, bound: float) -> DataFrame:
    """A spanning forest (u, v) of the links in each task (shard, a, b) between nodes that share a key."""

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        key, node = (t.column(c).to_numpy() for c in ("key", "node"))
        order = np.lexsort((node, key))
        load, u, v = t.column("load").to_pylist(), [], []
        for part in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
            label = spread(len(part), links_of([load[i] for i in part], bound))
            own = np.flatnonzero(label != np.arange(len(part)))
            u.append(node[part[own]])
            v.append(node[part[label[own]]])
        return pa.table({"u": np.concatenate(u), "v": np.concatenate(v)}, schema=_UV)

    return rows.select("shard", "a", "b", "key", "node", "load").groupBy("shard", "a", "b").applyInArrow(run, "u long, v long")


def led_links(rows: DataFrame, loads: DataFrame, links_of: Callable, bound: float, loose: float | None, most: int) -> DataFrame:
    """As grouped_links, for keys of very many nodes, which a group of near copies has: rows key, node, count (of the key).

    A leader of each key meets every node of it, tile by tile, so a load is sent once. What is linked to it needs no comparing
    with one another. Of the rest only the shell, what is within the loose bound of the leader, may be linked to those: by the
    triangle inequality, a loose bound of twice the distance of the bound loses no link (None: all of the rest is shell). The rest
    of a key gets its own leader next, up to TURNS of them; what is left then is compared in pairs of tiles."""
    tiles = F.ceil(F.col("count") / most).cast("int")
    held = cut(rows.withColumn("tiles", tiles).join(loads, "node").select("key", "node", "load", "tiles", _dealt("tiles", 3).alias("tile")))

    def met(t: pa.Table) -> pa.Table:
        t = t.combine_chunks().sort_by([("leads", "descending")])
        load, own = t.column("load").to_pylist(), np.arange(1, t.num_rows)
        node = t.column("node").to_numpy()
        on = links_of(load, bound)(0, own) | (node[1:] == node[0])
        shell = np.ones(len(own), bool) if loose is None else links_of(load, loose)(0, own)
        at = np.flatnonzero(on | shell)
        return pa.table({"key": t.column("key").to_numpy()[1:][at], "node": node[1:][at], "lead": np.full(len(at), node[0]), "on": on[at]})

    rest, edges, tasks = held, None, None
    for turn in range(TURNS):
        first = F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), "node")).alias("first")
        lead = rest.groupBy("key").agg(first).select("key", F.col("first.node").alias("node"))
        lead = rest.join(lead, ["key", "node"], "left_semi").withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        both = rest.withColumn("leads", F.lit(False)).unionByName(lead.withColumn("leads", F.lit(True)))
        hits = cut(both.groupBy("key", "tile").applyInArrow(met, "key long, node long, lead long, on boolean"))
        links = hits.where("on").select(F.col("node").alias("u"), F.col("lead").alias("v")).where("u <> v")
        sizes = hits.groupBy("key").agg(F.ceil(F.count_if("on") / most).cast("int").alias("as"), F.ceil(F.count_if(~F.col("on")) / most).cast("int").alias("bs")).where("bs > 0")
        sides = held.join(hits, ["key", "node"]).join(sizes, "key").withColumn("shard", F.xxhash64("key", F.lit(turn)))
        one = sides.where("on").withColumns({"a": _dealt("as", 5), "b": F.explode(F.sequence(F.lit(0), F.col("bs") - 1))})
        other = sides.where("not on").withColumns({"b": _dealt("bs", 5), "a": F.explode(F.sequence(F.lit(0), F.col("as") - 1))})
        pairs = one.unionByName(other).select("shard", "key", "node", "a", "b", "load")
        edges, tasks = (links, pairs) if turn == 0 else (edges.unionByName(links), tasks.unionByName(pairs))
        rest = rest.join(hits.where("on"), ["key", "node"], "left_anti")
        if rest.groupBy("key").count().where(F.col("count") > 2 * most).isEmpty():
            break
    rest = cut(rest.select("key", "node"))
    tasks = tasks.unionByName(tiled(rest, most).withColumn("shard", F.xxhash64("shard", F.lit(TURNS))).join(held.select("key", "node", "load"), ["key", "node"]).select(tasks.columns))
    return edges.unionByName(_linked(tasks, links_of, bound))


def grouped_links(rows: DataFrame, loads: DataFrame, links_of: Callable, bound: float, most: int, loose: float | None = None, loads_of: Callable | None = None) -> DataFrame:
    """A spanning forest (u, v), and some links more, of the links between nodes that share a key. rows: key, node, distinct; loads:
    node, load, what links_of makes links from, within the bound; loads_of(nodes) instead makes them for those alone. Keys of
    more than 2 * most nodes go by leaders, the others share tasks."""
    rows_of = loads_of or (lambda nodes: loads)
    large = cut(rows.groupBy("key").count().where(F.col("count") > 2 * most))
    few = rows if large.isEmpty() else rows.join(large, "key", "left_anti")
    out = _linked(tiled(few, most).join(rows_of(few.select("node")), "node"), links_of, bound)
    if few is rows:
        return out
    many = rows.join(large, "key")
    return out.unionByName(led_links(many, rows_of(many.select("node")), links_of, bound, loose, most))


def near_links(docs: DataFrame, prints: DataFrame, similarity: float) -> DataFrame:
    """A spanning forest (u, v) of the nodes whose sets of five-word shingles have the similarity (Jaccard), exactly.

    Fingerprints share a shard where they share a band; a band's BK-tree finds those within the radius, which are joined into
    groups, and within a group the sets themselves decide."""
    nodes = cut(prints.groupBy("node").agg(F.min("fp").alias("load"), F.min("bands").alias("bands"), F.min(F.struct("k1", "k2")).alias("row")))
    keys = nodes.select("node", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b").select("key")
    rows = cut(keys.join(shared, "key", "left_semi"))
    roots = components(grouped_links(rows, nodes.select("node", "load"), by_tree, radius_of(similarity), SHARD))
    roots = cut(roots.select("root", "node").unionByName(roots.select("root", F.col("root").alias("node"))).distinct())
    named = nodes.join(roots.select("node"), "node", "left_semi").select("node", "row.k1", "row.k2")

    def sets_of(wanted: DataFrame) -> DataFrame:
        own = named.join(wanted.distinct(), "node", "left_semi")
        return sets(with_key(texts(docs)).join(own, ["k1", "k2"]).select("node", "text").dropDuplicates(["node"]))

    loose = max(0.0, 2 * similarity - 1 - 1e-6)
    return grouped_links(roots.withColumnRenamed("root", "key"), None, by_set, similarity, SHARD // 4, loose, sets_of)


def near_dedup(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """The documents with one of each near-duplicate group (five-word shingles, similarity 0.8): the smallest doc_id, a
    row without an id only where the group has no other."""
    prints = cut(set_prints(docs))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")
    nodes = prints.groupBy("node").agg(F.min(order).alias("first"))
    named = nodes.join(components(near_links(docs, prints, similarity)), "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = named.join(named.groupBy("root").agg(F.min("first").alias("stays")), "root").select("node", "stays")
    other = (F.col("k1") != F.col("stays.k1")) | (F.col("k2") != F.col("stays.k2"))
    k1, k2 = spare(docs, "k1", "k2")
    gone = prints.select("node", "k1", "k2").join(named, "node").where(other).select(F.col("k1").alias(k1), F.col("k2").alias(k2)).distinct()
    doc_id, text = F.col("doc_id").cast("long"), F.coalesce("text", F.lit(""))
    keyed = docs.withColumns({k1: F.xxhash64(doc_id, text), k2: F.xxhash64(F.lit(1), text, doc_id)})
    out = keyed.join(gone, [k1, k2], "left_anti")
    again = cut(prints.groupBy(F.col("k1").alias(k1), F.col("k2").alias(k2)).count().where("count > 1").drop("count"))
    if not again.isEmpty():
        once = out.join(again, [k1, k2], "left_semi").dropDuplicates([k1, k2])
        out = out.join(again, [k1, k2], "left_anti").unionByName(once)
    return out.select(*docs.columns)
