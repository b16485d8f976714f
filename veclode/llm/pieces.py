"""SentencePiece encoding and decoding with Gumbel top-k sampling without replacement.

The lattice of a text is the product of the lattices of its units: a unit is a run of spaces with the
characters up to the next space or newline, or a newline. No piece crosses from one into the next (the vocabulary
is asked; if one did, a text would be one unit), so no segmentation is lost. A vocabulary piece is an edge; a character that no piece
holds is one edge, its byte pieces. The model is a BPE model without probabilities, so a piece weighs
1 / (rank + SHIFT), by its merge rank (Zipf's law). Backward sums turn the weights into the exact
probability of each edge given where it starts. A task builds the lattice of a unit once and keeps the first KEPT edges;
beyond them, a batch of texts builds those of its other distinct units and drops them again. What a unit's lattice
holds depends on the unit alone, to the last bit. The sums carry exponents of their own, so a unit may be of any length.

A segmentation gets a Gumbel-perturbed log probability. The root's is drawn first; the best leaf below it is a
plain sample, and each set of alternatives that a step of it passes by gets the maximum of its own Gumbels,
truncated at the parent's. These sets are the frontier of an A* search: the best is opened, its leaf sampled,
its own alternatives added, until k leaves are out. So leaves come in the order of their perturbed log
probability, k distinct segmentations without replacement. The bound of the next leaf is the threshold kappa:
a segmentation's inclusion score is log(1 - exp(-exp(log p - kappa))).

All random numbers are hashes of (seed, row key, leaf, unit, step): a row gives the same in any task, batch or
rerun. Texts are sampled in batches of bounded size, all steps over the units of a batch at once.

Defined cases: a null or empty text has one segmentation, without pieces; fewer than k segmentations give fewer
rows, with inclusion 1 (log 0); repeated rows repeat their samples; a null doc_id is a row key of its own; an
empty table gives an empty result. Decoding gives back every text exactly.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, list_array, texts

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Zipf's shift; edges of a state, one for each length of a piece in code points; slots of the table of pieces.
SHIFT, WIDE, _SLOTS = 3.0, 17, 1 << 20
_DROP, _MUL = 44, np.uint64(0x9E3779B97F4A7C15)
#: Where no piece can cross, and a piece that does.
_UNITS, _WHOLE, _CROSSES = re.compile(r" *[^ \n]+| +|\n"), re.compile(r"[\s\S]+"), re.compile(r"[^ ] |.\n|\n.", re.S)
#: From so many characters before a unit's end on, backward sums have exponents of their own.
_SCALED = 32
#: Edges whose lattices a task keeps from batch to batch (40 bytes each); characters of units built at once.
KEPT, _SLICE = 1 << 18, 1 << 16
#: From so many characters before a unit's end on, states are summed one by one, and so few units are walked one by one, so
#: many steps at once: array operations for single characters would cost more.
_LONG, _FEW, _STEPS = 4096, 4, 4096
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class Vocabulary:
    """The pieces (with spaces as such) and, with weight 0, their beginnings in a hash table, the byte pieces, and each id's
    bytes."""

    def __init__(self, path: str = MODEL) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n, self.units = sp.get_piece_size(), _UNITS
        self.byte, self.raw = np.zeros(256, np.int32), []
        self.key, self.id, self.w = np.zeros(_SLOTS, np.uint64), np.zeros(_SLOTS, np.int32), np.zeros(_SLOTS)
        known = []
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                self.raw.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i):
                self.raw.append(b"")
            else:
                text = piece.replace("\u2581", " ")
                self.raw.append(text.encode())
                if _CROSSES.search(text):
                    self.units = _WHOLE
                if len(text) <= WIDE:
                    self._put(text, i, 1 / (SHIFT - sp.get_score(i)))
                    known.append(text)
        for text in {x[:e] for x in known for e in range(1, len(x))} - set(known):
            self._put(text, 0, 0.0)
        self.rare = 1 / (n + SHIFT)
        self.size = np.array([len(x) for x in self.raw], np.int64)
        self.first, self.flat = np.cumsum(self.size) - self.size, np.frombuffer(b"".join(self.raw), np.uint8)
        self.bytes = pa.array(self.raw, pa.large_binary())

    def _put(self, text: str, i: int, w: float) -> None:
        h = 0
        for c in text:
            h = (h * int(_MUL) + ord(c) + 1) & (1 << 64) - 1
        slot = (h * int(_M1) & (1 << 64) - 1) >> _DROP
        while self.key[slot]:
            slot = (slot + 1) % _SLOTS
        self.key[slot], self.id[slot], self.w[slot] = h, i, w

    def find(self, h: np.ndarray) -> np.ndarray:
        """The slot of each hash, -1 where there is none."""
        slot = ((h * _M1) >> np.uint64(_DROP)).astype(np.int64)
        found = self.key[slot]
        out = np.where(found == h, slot, -1)
        more = np.flatnonzero((found != h) & (found != 0))
        while len(more):
            slot[more] = (slot[more] + 1) % _SLOTS
            found = self.key[slot[more]]
            out[more] = np.where(found == h[more], slot[more], -1)
            more = more[(found != h[more]) & (found != 0)]
        return out

    def decode(self, ids) -> str:
        """The text: the first space, which encoding puts in front, goes."""
        ids = np.asarray(ids, np.int64)
        size = self.size[ids]
        ends = np.cumsum(size)
        at = np.repeat(self.first[ids] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)
        return self.flat[at].tobytes().decode()[1:]


def uniform(key: np.ndarray, step: int | np.ndarray) -> np.ndarray:
    """In (0, 1), by key (uint64) and step."""
    z = key + np.asarray(step + 1).astype(np.uint64) * _MUL
    z = (z ^ (z >> np.uint64(30))) * _M1
    z = (z ^ (z >> np.uint64(27))) * _M2
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / (1 << 53) + 2.0**-54


class Lattice:
    """The lattices of distinct units. A unit of n characters has n + 1 states in a row, and an edge of length e leads
    from state s to s + e. The edges of a state follow each other, the longest first, from off[s] (-1: none): p, log p, the
    cumulative p (the last: 2), the states they leave from and lead to, the first edge there (-1: none), and code, a
    piece's id, or -1 - c for the character c in bytes."""

    def __init__(self, v: Vocabulary, units: Iterable[str] = ()) -> None:
        self.v, self.states, self.edges = v, 0, 0
        self.kept, self.size = {}, (0, 0)  # the first states of the units that stay, and how many states and edges those have
        self.off, self.count = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.p, self.logp, self.cum = np.zeros(0), np.zeros(0), np.zeros(0)
        self.code, self.to, self.of, self.then = (np.zeros(0, np.int32) for _ in range(4))
        self.starts(pa.array(units, pa.large_string()))

    def starts(self, units: pa.LargeStringArray) -> np.ndarray:
        """The first state of each of these distinct units, also as `start`. Those that are not kept are built, in the place of what an
        earlier call built and did not keep; they are kept if there is room."""
        self.states, self.edges = self.size
        if len(self.p) > 4 * KEPT:
            self._room(*self.size, True)
        names = units.to_numpy(zero_copy_only=False).tolist()
        out = np.fromiter(map(self.kept.get, names, repeat(-1)), np.int64, len(names))
        new = np.flatnonzero(out < 0)
        size = np.fromiter((len(names[i]) for i in new.tolist()), np.int64, len(new))
        out[new] = self.states + np.cumsum(size + 1) - size - 1
        cuts = np.flatnonzero(np.diff(np.cumsum(size) // _SLICE, prepend=0)).tolist()
        for a, b in zip([0, *cuts], [*cuts, len(new)], strict=True):
            if a < b:
                self._build("".join([names[i] for i in new[a:b].tolist()]), size[a:b])
        if self.edges <= KEPT:
            self.size = self.states, self.edges
            self.kept.update(zip([names[i] for i in new.tolist()], out[new].tolist(), strict=True))
        self.start = out
        return out

    def _room(self, states: int, edges: int, exact: bool = False) -> None:
        for names, now, n in ((("off", "count"), self.states, states), (("p", "logp", "cum", "code", "to", "of", "then"), self.edges, edges)):
            for name in names:
                old = getattr(self, name)
                if exact or len(old) < n:
                    new = np.empty(n if exact else n + n // 4, old.dtype)
                    new[:now] = old[:now]
                    setattr(self, name, new)

    def _build(self, units: str, size: np.ndarray) -> None:
        """Adds the lattices of units, given one after another and by their sizes."""
        v, text = self.v, np.frombuffer(units.encode("utf-32-le"), np.uint32).astype(np.uint64)
        start = np.cumsum(size + 1) - size - 1
        n = len(text) + len(size)
        at = np.arange(len(text)) + np.repeat(np.arange(len(size)), size)  # the characters' states
        left = np.zeros(n, np.int16 if size.max(initial=0) < 1 << 15 else np.int64)
        left[at] = np.repeat(start + size, size) - at
        chars = np.zeros(n + WIDE, np.uint64)
        chars[at] = text + np.uint64(1)
        h, own, found, count = np.zeros(len(at), np.uint64), at, [], np.zeros(n, np.int64)
        for e in range(1, WIDE + 1):
            h = h * _MUL + chars[own + (e - 1)]
            slot = v.find(h)
            w = np.where(slot >= 0, v.w[slot], 0)
            hit = np.flatnonzero(w)
            state = own[hit]
            found.append((e, state, w[hit], v.id[slot[hit]]))
            count[state] += 1
            if e == 1:
                miss = own[w == 0]
                found.append((1, miss, np.full(len(miss), v.rare), -chars[miss].astype(np.int64)))
                count[miss] += 1
            more = np.flatnonzero((slot >= 0) & (left[own] > e))  # pieces that begin like this are left
            own, h = own[more], h[more]
        order = np.argsort(left, kind="stable")  # states by what is left of their unit
        first = np.cumsum(count[order]) - count[order]
        m = int(count.sum())
        level = np.zeros(n, np.int64)
        level[order] = first
        cursor = level.copy()
        weight, lead, piece = np.zeros(m), np.zeros(m, np.int64), np.zeros(m, np.int32)
        for e, state, w, code in reversed(found):
            place = cursor[state]
            cursor[state] += 1
            weight[place], piece[place], lead[place] = w, code, state + e
        total, power = np.ones(n), np.zeros(n, np.int32)
        ends = np.searchsorted(left[order], np.arange(1, min(_LONG, int(left.max(initial=0))) + 2))
        for d, (i, j) in enumerate(zip(ends, ends[1:], strict=False), 1):
            if i == j:
                continue
            states, a, b = order[i:j], first[i], first[j] if j < n else m
            w = weight[a:b] * total[lead[a:b]]
            if d > _SCALED:
                w = np.ldexp(w, power[lead[a:b]] - np.repeat(power[states + 1], count[states]))
            sums = np.add.reduceat(w, first[i:j] - a)
            weight[a:b] = w / np.repeat(sums, count[states])
            if d < _SCALED:
                total[states] = sums
            else:
                total[states], more = np.frexp(sums)
                power[states] = power[states + 1] + more
        for i in np.flatnonzero(size > _LONG).tolist():
            self._backward(int(start[i]), int(size[i]) - _LONG, count, level, weight, lead, total, power)
        off = np.cumsum(count) - count
        own = np.repeat(level - off, count) + np.arange(m)  # from the order of levels to that of states
        p, lead = weight[own], lead[own]
        cum, more, r = p.copy(), np.flatnonzero(count > 1), 1
        while len(more):
            edge = off[more] + r
            cum[edge] += cum[edge - 1]
            r += 1
            more = more[count[more] > r]
        some = count > 0
        cum[(off + count - 1)[some]] = 2.0
        s, a = self.states, self.edges
        off = np.where(some, off + a, -1)
        self._room(s + n, a + m)
        self.off[s : s + n], self.count[s : s + n] = off, count
        b = slice(a, a + m)
        self.p[b], self.logp[b], self.cum[b], self.code[b] = p, np.log(p), cum, piece[own]
        self.to[b], self.of[b], self.then[b] = lead + s, np.repeat(np.arange(s, s + n), count), off[lead]
        self.states, self.edges = s + n, a + m

    @staticmethod
    def _backward(start: int, n: int, count: np.ndarray, level: np.ndarray, weight: np.ndarray, lead: np.ndarray, total: np.ndarray, power: np.ndarray) -> None:
        """The weights of the edges of a unit's first n states, which begin at `start`, become their probabilities."""
        near = slice(start + n, start + n + WIDE)
        sums = np.ldexp(total[near], power[near] - power[start + n]).tolist()  # of the states that follow, up to a power of 2
        for end in range(start + n, start, -_STEPS):
            states = np.arange(end - 1, max(start, end - _STEPS) - 1, -1)
            size = count[states]
            at = np.repeat(level[states] - np.cumsum(size) + size, size) + np.arange(size.sum())
            w, step, out, a = weight[at].tolist(), (lead[at] - np.repeat(states, size) - 1).tolist(), [], 0
            for c in size.tolist():
                own = [x * sums[e] for x, e in zip(w[a : a + c], step[a : a + c], strict=True)]
                a, whole = a + c, sum(own)
                out += [x / whole for x in own]
                sums.insert(0, whole)
                sums.pop()
                if whole < 2.0**-300:
                    sums = [x * 2.0**300 for x in sums]
            weight[at] = out

    def src(self, edge: np.ndarray) -> np.ndarray:
        """The states that edges leave from."""
        return self.of[edge]

    def walk(self, cur: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A sampled path from each state to its unit's end: the number of steps of each, and the edges in order."""
        edge, size, steps, step = self.off[cur], np.zeros(len(cur), np.int64), [], 0
        unit = np.flatnonzero(edge >= 0)
        edge, keys = edge[unit], keys[unit]
        while len(unit) > _FEW or len(unit) and step < _STEPS:
            u = uniform(keys, step)
            on = np.flatnonzero(u >= self.cum[edge])
            u, at = u[on], edge[on]
            while len(on):
                at += 1
                edge[on] = at
                more = np.flatnonzero(u >= self.cum[at])
                on, u, at = on[more], u[more], at[more]
            steps.append((unit, edge))
            size[unit] += 1
            then = self.then[edge]
            more = np.flatnonzero(then >= 0)
            unit, keys, edge, step = unit[more], keys[more], then[more].astype(np.int64), step + 1
        rest = [self._walk(int(e), k, step) for e, k in zip(edge, keys, strict=True)]
        size[unit] += np.array([len(x) for x in rest], np.int64)
        first = np.cumsum(size) - size
        out = np.zeros(int(size.sum()), np.int64)
        for i, x in zip(unit.tolist(), rest, strict=True):
            out[first[i] + step : first[i] + size[i]] = x
        for step, (unit, edge) in enumerate(steps):
            out[first[unit] + step] = edge
        return size, out

    def _walk(self, edge: int, key: np.uint64, step: int) -> np.ndarray:
        """The rest of a sampled path, from a state's first edge and a step on."""
        cum, then, out = memoryview(self.cum), memoryview(self.then), []
        while edge >= 0:
            now = []
            for u in uniform(key, np.arange(step, step + _STEPS)).tolist():
                while u >= cum[edge]:
                    edge += 1
                now.append(edge)
                edge = then[edge]
                if edge < 0:
                    break
            out.append(np.array(now, np.int64))
            step += _STEPS
        return np.concatenate(out)

    def ids(self, edge: np.ndarray) -> np.ndarray:
        """The piece ids along a path; a character in bytes is its byte pieces."""
        return self.spelt(edge)[0]

    def spelt(self, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
        """The piece ids along paths, and how many each edge has (none: one each)."""
        code = self.code[edge]
        rare = np.flatnonzero(code < 0)
        if not len(rare):
            return code, None
        c = -1 - code[rare]
        long = 1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF)  # bytes in UTF-8
        most, size, at = int(long.max()), None, rare
        if most > 1:
            size = np.ones(len(code), np.int64)
            size[rare] = long
            at = (np.cumsum(size) - size)[rare]
            code = np.repeat(code, size)
        for n in range(most):  # the n-th byte of each
            own = long > n
            part = c[own] >> 6 * (long[own] - 1 - n)
            code[at[own] + n] = self.v.byte[part & 0x3F | 0x80 if n else part | np.array([0, 0, 0xC0, 0xE0, 0xF0])[long]]
        return code, size


#: What -log of an exponential draw can be at most, given the resolution of uniform(); steps of a path looked at first.
_MOST, _HEAD = 37.5, 64


class _Row:
    """The search over one text: its leaves so far and the frontier of alternatives."""

    def __init__(self, key: int, units: np.ndarray) -> None:
        self.key, self.units, self.leaves, self.frontier = key, units, [], []

    def open(self, lattice: Lattice, u: float) -> tuple | None:
        """The best set of alternatives: the path before it (how many steps lie before the end of each unit, and the edges),
        its unit and the edge taken there by u, what is barred, its bound and step."""
        if not self.frontier:
            return None
        g, leaf, t, barred = self.frontier.pop(0)
        ends, edge = self.leaves[leaf][0]
        unit = int(ends.searchsorted(t, side="right"))
        barred = (*barred, int(edge[t]))
        state = lattice.of[barred[-1]]
        a = int(lattice.off[state])
        p = lattice.p[a : a + int(lattice.count[state])].tolist()
        for e in barred:
            p[e - a] = 0.0
        u, e, at = u * sum(p), -1, 0.0
        for i, x in enumerate(p):
            at += x
            if x:
                e = a + i
                if u < at:
                    break
        return (ends[:unit], edge[:t]), unit, e, barred, g, t


def _grow(rows: list[_Row], lattice: Lattice, new: list[tuple], k: int) -> None:
    """Each row's new leaf (path, its perturbed log p, start, barred); from its step `start` on, where the edges `barred` are
    out too, its alternatives join the frontier. Their bounds fall with the probability of the path before them: once no
    later one can be among the k + 1 best, whatever it draws, the rest is left out; so are, unless they draw enough,
    those after the first steps."""
    edge, keys = np.concatenate([path[1] for path, *_ in new]), np.array([r.key for r in rows], np.uint64)
    logp, before, leaf = lattice.logp[edge], np.zeros(len(edge)), len(rows[0].leaves)
    last = np.cumsum([len(path[1]) for path, *_ in new])
    start = last - [len(path[1]) - t for path, _, t, _ in new]
    first, perturbed = start - [t for *_, t, _ in new], np.array([g for _, g, *_ in new])
    for r, (path, g, *_), a, b in zip(rows, new, first.tolist(), last.tolist(), strict=True):
        own = logp[a:b]
        total = own.cumsum()
        np.subtract(total, own, out=before[a:b])
        r.leaves.append((path, float(total[-1]) if a < b else 0.0, g))

    def draws(at: np.ndarray, row: np.ndarray) -> np.ndarray:
        return uniform(keys[row] + (at - first[row]).astype(np.uint64) * _M1, 1_000_003 + leaf)

    def bounds(at: np.ndarray, row: np.ndarray, u: np.ndarray, begins: bool) -> np.ndarray:
        rest, alone = -np.expm1(logp[at]), lattice.count[lattice.src(edge[at])]
        if begins:
            for i, (*_, barred) in zip(np.flatnonzero(at == start[row]).tolist(), [x for x, a, b in zip(new, start, last, strict=True) if a < b], strict=True):
                if barred:
                    rest[i] = max(0.0, rest[i] - lattice.p[list(barred)].sum())
                    alone[i] -= len(barred)
        rest[alone <= 1] = 0
        with np.errstate(divide="ignore"):
            phi = before[at] + np.log(rest)
            return phi - np.log(np.exp(phi - perturbed[row]) - np.log(u))

    def join(found: dict) -> None:
        for row, more in found.items():
            r = rows[row]
            r.frontier = sorted(r.frontier + more, key=lambda x: -x[0])[: k + 1]

    size = np.minimum(last - start, _HEAD)
    row = np.repeat(np.arange(len(rows)), size)
    step = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    at = start[row] + step
    table = np.full((len(rows), max(_HEAD, k + 1)), -np.inf)
    table[row, step] = bounds(at, row, draws(at, row), True)
    best = np.argpartition(-table, k, axis=1)[:, : k + 1]
    values = np.take_along_axis(table, best, 1).tolist()
    join({i: [(x, leaf, t + j, barred if j == 0 else ()) for x, j in zip(own, steps, strict=True) if x > -math.inf] for i, (own, steps, (_, _, t, barred)) in enumerate(zip(values, best.tolist(), new, strict=True))})
    least = np.array([r.frontier[k][0] if len(r.frontier) > k else -math.inf for r in rows])
    head = start + size
    stop = [a + int((-before[a:b]).searchsorted(_MOST - x, side="right")) if a < b else a for a, b, x in zip(head.tolist(), last.tolist(), least.tolist(), strict=True)]
    size = np.array(stop) - head
    row = np.repeat(np.arange(len(rows)), size)
    at = head[row] + np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    u = draws(at, row)
    with np.errstate(over="ignore"):
        near = np.flatnonzero(1 - u <= 1.000001 * np.exp(before[at] - least[row]) + 1e-15)  # -log u < exp(phi - least), and phi <= before
    at, row, found = at[near], row[near], {}
    for x, i, t in zip(bounds(at, row, u[near], False).tolist(), row.tolist(), (at - first[row]).tolist(), strict=True):
        if x > least[i]:
            found.setdefault(i, []).append((x, leaf, t, ()))
    join(found)


def _seeds(rows: list[_Row], leaf: int, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The key of each unit of the rows from their `first` on, in a leaf."""
    n = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes - first, sizes)
    keys = np.repeat(np.array([r.key for r in rows], np.uint64), sizes)
    return (keys ^ (n.astype(np.uint64) * _M2)) + np.uint64(leaf * 0xD6E8FEB86659FD93 & (1 << 64) - 1)


def _cut(v: Vocabulary, raw: list[bytes], lattice: Lattice) -> tuple[np.ndarray, np.ndarray]:
    """The first states of the texts' units, one text after another, and how many units each text has."""
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    data = b"".join(raw)
    begins = (np.cumsum(size) - size)[size > 0]
    own = np.frombuffer(data, np.uint8)
    new = np.zeros(len(own), bool)
    if v.units == _UNITS:  # equal, not the same: the vocabulary has been through a broadcast
        space, line = own == 32, own == 10
        new = line.copy()
        new[1:] |= line[:-1] | (space[1:] & ~space[:-1])
    new[begins] = True
    at = np.flatnonzero(new)
    units = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(np.append(at, len(data)).astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()
    starts = lattice.starts(units.dictionary.cast(pa.large_string()))
    return starts[units.indices.to_numpy()], np.diff(at.searchsorted(np.append(0, np.cumsum(size))))


def sample(v: Vocabulary, keys: list[int], docs: list[str], k: int, lattice: Lattice | None = None) -> tuple[Lattice, list[tuple[list, float]]]:
    """The lattice of the texts (the given one, with their new units) and, for each, its leaves (path, log p, perturbed log
    p), best first, and kappa."""
    lattice = Lattice(v) if lattice is None else lattice
    if not docs:
        return lattice, []
    starts, sizes = _cut(v, [(" " + text).encode() if text else b"" for text in docs], lattice)
    rows = [_Row(key, units) for key, units in zip(keys, np.split(starts, np.cumsum(sizes)[:-1]), strict=True)]
    paths = _split(lattice.walk(starts, _seeds(rows, 0, np.zeros(len(rows), np.int64), sizes)), sizes)
    every = np.array(keys, np.uint64)
    _grow(rows, lattice, [(path, -math.log(-math.log(u)), 0, ()) for path, u in zip(paths, uniform(every, 999_983).tolist(), strict=True)], k)
    for leaf in range(1, k):
        opened = [(r, x) for r, u in zip(rows, uniform(every, 2_000_003 + leaf).tolist(), strict=True) if (x := r.open(lattice, u))]
        if not opened:
            break
        own = [r for r, _ in opened]
        first = np.array([unit for _, (_, unit, *_) in opened])
        sizes = np.array([len(r.units) for r in own]) - first
        starts = np.concatenate([x for r, (_, unit, e, *_) in opened for x in (lattice.to[e : e + 1], r.units[unit + 1 :])])
        tails = _split(lattice.walk(starts, _seeds(own, leaf, first, sizes)), sizes)
        _grow(own, lattice, [((np.concatenate([n0, n1 + (t + 1)]), np.concatenate([e0, [e], e1])), g, t, barred) for (_, ((n0, e0), _, e, barred, g, t)), (n1, e1) in zip(opened, tails, strict=True)], k)
    return lattice, [(r.leaves, r.frontier[0][0] if r.frontier and len(r.leaves) == k else -math.inf) for r in rows]


def _split(walked: tuple, sizes: np.ndarray) -> list[tuple]:
    """The paths of a walk over many texts' units, by text: how many steps lie before the end of each unit, and the edges."""
    size, edge = walked
    ends = np.append(0, np.cumsum(size))
    units = np.append(0, np.cumsum(sizes))
    cuts = ends[units].tolist()
    return [(ends[i + 1 : j + 1] - a, edge[a:b]) for i, j, a, b in zip(units.tolist(), units[1:].tolist(), cuts, cuts[1:], strict=False)]


def encode_samples(docs: DataFrame, k: int = 2, seed: int = 1, path: str = MODEL) -> DataFrame:
    """doc_id, sample (from 1), ids, log_p, perturbed, log_inclusion and decoded (whether the ids give the text) of
    k sampled segmentations of each text."""
    broadcast = docs.sparkSession.sparkContext.broadcast(Vocabulary(path))  # as large as the vocabulary file

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = broadcast.value
        lattice = Lattice(v)
        for b in batches(it, 0.2):
            ids, body = b.column("doc_id").to_pylist(), b.column("text").to_pylist()
            keys = [xxhash.xxh64_intdigest(f"{seed}/{i}".encode()) for i in ids]
            _, found = sample(v, keys, body, k, lattice)
            flat, sizes, same = spell(lattice, [[path[1] for path, *_ in leaves] for leaves, _ in found], body)
            out = [(i, n + 1, log_p, g, inclusion(log_p, kappa)) for i, (leaves, kappa) in zip(ids, found, strict=True) for n, (_, log_p, g) in enumerate(leaves)]
            i, n, log_p, g, inc = zip(*out, strict=True) if out else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(i, pa.int64()), pa.array(n, pa.int32()), list_array(flat, sizes, pa.int32()), pa.array(log_p, pa.float64()), pa.array(g, pa.float64()), pa.array(inc, pa.float64()), pa.array(same, pa.bool_())],
                names=["doc_id", "sample", "ids", "log_p", "perturbed", "log_inclusion", "decoded"],
            )

    return texts(docs).mapInArrow(run, "doc_id long, sample int, ids array<int>, log_p double, perturbed double, log_inclusion double, decoded boolean")


def spell(lattice: Lattice, paths: list[list[np.ndarray]], body: list[str]) -> tuple[np.ndarray, np.ndarray, list[bool]]:
    """The piece ids of the texts' paths one after another, how many each path has, and whether they decode to its text."""
    every = list(chain.from_iterable(paths))
    flat, size = lattice.spelt(np.concatenate([np.zeros(0, np.int64), *every]))
    ends = np.cumsum([0, *map(len, every)])
    if size is not None:
        ends = np.append(0, np.cumsum(size))[ends]
    spelt = lattice.v.bytes.take(pa.array(flat))
    at = np.frombuffer(spelt.buffers()[1], np.int64)[ends].tolist() if len(flat) else [0] * len(ends)
    data, same, n = spelt.buffers()[2], [], 0
    for text, own in zip(body, paths, strict=True):
        want = (" " + text).encode() if text else b""
        for _ in own:
            same.append((data[at[n] : at[n + 1]].to_pybytes() if at[n] < at[n + 1] else b"") == want)
            n += 1
    return flat, np.diff(ends), same


def inclusion(log_p: float, kappa: float) -> float:
    """log(1 - exp(-exp(log_p - kappa)))"""
    x = log_p - kappa
    return 0.0 if x > 40 else x if x < -30 else math.log(-math.expm1(-math.exp(x)))


def digest(docs: DataFrame) -> DataFrame:
    out = encode_samples(docs)
    listed = F.array_join(F.col("ids"), " ")
    return out.select("doc_id", "sample", F.size("ids").cast("long").alias("n_pieces"), "log_p", "perturbed", "log_inclusion", "decoded", F.sha2(listed, 256).alias("ids_sha256"))
