"""Exact dedup: Patricia-trie owners.

Texts are dealt to owners by length and content hash. An owner inserts the full byte strings into a compressed
radix trie whose terminal nodes hold the surviving id and the number of rows. Before anything is shuffled,
each input partition runs its own tries, so a text with a million copies leaves a partition as one row.
Owners read their rows sorted by (length, hash prefix): a subtree is complete, and is spilled to the output,
as soon as the stream leaves its prefix, so an owner holds one subtree at a time. The classes then join the
narrow (doc_id, hash) rows; that join has one row a class on one side and may be split at hot keys.

Defined cases: null text counts as empty; a null doc_id is below every id; rows that repeat a doc_id and a
text all say the same (both kept if that id is the one that stays); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, texts

#: Bytes that the tries of an input partition may hold before they are spilled.
LOCAL_BYTES = 32_000_000


class Trie:
    """A radix trie over byte strings. A node is [edges by first byte, value]; an edge is [label, node]."""

    def __init__(self) -> None:
        self.root: list = [{}, None]
        self.bytes = 0

    def insert(self, key: bytes, value: tuple, merge) -> None:
        node, at = self.root, 0
        while at < len(key):
            edge = node[0].get(key[at])
            if edge is None:
                leaf = [{}, value]
                node[0][key[at]] = [key[at:], leaf]
                self.bytes += len(key) - at + 300
                return
            label = edge[0]
            if key.startswith(label, at):
                node, at = edge[1], at + len(label)
                continue
            n = _common(label, key[at : at + len(label)])
            middle = [{label[n]: [label[n:], edge[1]]}, None]
            node[0][key[at]] = [label[:n], middle]
            self.bytes += 300
            node, at = middle, at + n
        node[1] = value if node[1] is None else merge(node[1], value)

    def items(self) -> Iterator[tuple[bytes, tuple]]:
        stack = [(b"", self.root)]
        while stack:
            head, node = stack.pop()
            if node[1] is not None:
                yield head, node[1]
            stack += [(head + label, child) for label, child in node[0].values()]


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by bisection on slices."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
    return low


def _merger(keep_max: bool):
    def merge(a: tuple, b: tuple) -> tuple:
        ids = [x[0] for x in (a, b) if x[0] is not None]
        return ((max if keep_max else min)(ids) if ids else None, a[1] + b[1], a[2])

    return merge


_ROW = {"len": pa.int64(), "sha": pa.string(), "content": pa.binary(), "id": pa.int64(), "n": pa.int64()}


def _emit(rows: list[tuple], fields: dict) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, fields.values(), strict=True)], names=list(fields))


def _local(keep_max: bool):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merge, trie = _merger(keep_max), Trie()
        for b in it:
            for sha, content, i in zip(b.column("sha").to_pylist(), b.column("content"), b.column("id").to_pylist(), strict=True):
                trie.insert(content.as_py(), (i, 1, sha), merge)
                if trie.bytes > LOCAL_BYTES:
                    yield from _spilled(trie)
                    trie = Trie()
        yield from _spilled(trie)

    return run


def _spilled(trie: Trie) -> Iterator[pa.RecordBatch]:
    rows, size = [], 0
    for content, (i, n, sha) in trie.items():
        rows.append((len(content), sha, content, i, n))
        if (size := size + len(content)) > 4_000_000:
            yield _emit(rows, _ROW)
            rows, size = [], 0
    if rows:
        yield _emit(rows, _ROW)


def _owner(keep_max: bool):
    fields = {k: _ROW[k] for k in ("len", "sha", "id", "n")}

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merge, trie, at, out = _merger(keep_max), Trie(), None, []
        for b in it:
            for length, sha, content, i, n in zip(*(b.column(k) for k in _ROW), strict=True):
                here = (length.as_py(), sha.as_py()[:4])
                if here != at:
                    out += [(at[0], v[2], v[0], v[1]) for _, v in trie.items()]
                    trie, at = Trie(), here
                    if len(out) > 10_000:
                        yield _emit(out, fields)
                        out = []
                trie.insert(content.as_py(), (i.as_py(), n.as_py(), sha.as_py()), merge)
        out += [(at[0], v[2], v[0], v[1]) for _, v in trie.items()]
        yield _emit(out, fields)

    return run


def exact_classes(docs: DataFrame, keep: str = "max") -> tuple[DataFrame, DataFrame]:
    """(every row's doc_id, len, sha; every class's len, sha, keep_id, group_size), of the normalised texts."""
    rows = texts(docs).select("doc_id", ascii_lower(F.col("text")).alias("norm"))
    rows = rows.select("doc_id", "norm", F.octet_length("norm").cast("long").alias("len"), F.sha2("norm", 256).alias("sha"))
    local = rows.select("sha", F.col("norm").cast("binary").alias("content"), F.col("doc_id").alias("id"))
    local = local.mapInArrow(_local(keep == "max"), "len long, sha string, content binary, id long, n long")
    owned = local.repartition("len", F.substring("sha", 1, 4)).sortWithinPartitions("len", "sha")
    classes = owned.mapInArrow(_owner(keep == "max"), "len long, sha string, id long, n long")
    return rows.drop("norm"), classes.select("len", "sha", F.col("id").alias("keep_id"), F.col("n").alias("group_size"))


def exact_dedup(docs: DataFrame, keep: str = "max") -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row; keep: the largest ("max") or smallest id stays."""
    rows, classes = exact_classes(docs, keep)
    return rows.join(classes, ["len", "sha"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256")
    )
