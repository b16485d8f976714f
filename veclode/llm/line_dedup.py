"""Line dedup: range-partitioned line hashes, sorted by document and position, leave keep bitmaps.

A line's key is the line without white space at its ends, A-Z lower-cased. Each occurrence is a row of two
64-bit hashes, a document key and a position: the text itself is never sorted or grouped. These narrow rows are
made once and kept. They are range-partitioned by (hash, document, row), so that the run of one very common line, or of one
row that is repeated very often, spans as many partitions as it fills, and sorted by position within that. A pass over
each sorted partition compares an occurrence with the first one of its run, and marks the first occurrences of a key in a
document; this stream is kept too. The marked rows are counted, in each partition before they are shuffled, to find the
frequent keys. These are joined with the stream, broadcast only below a checked size, and a document's positions
become its run-compressed keep bitmap; texts are split again only where a bitmap is applied.

Defined cases: a null or empty text is one empty line, an empty key never drops, a row that repeats another
counts as a document of its own, a null doc_id is kept as null, and an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WS, ascii_lower, cut, partitions, spare, texts, with_key

#: Frequent keys up to this many (16 bytes each) are broadcast; more of them are joined by a shuffle.
BROADCAST_KEYS = 250_000


def occurrences(docs: DataFrame, min_len: int = 1) -> DataFrame:
    """doc_id, k1, k2 (they name a row, and those that repeat it), row (a number of its own), pos, h1, h2 (a key's hashes) of
    every line with a key, computed once."""
    key = ascii_lower(F.btrim(F.col("line"), F.lit(WS)))
    lines = with_key(texts(docs)).withColumn("row", F.monotonically_increasing_id()).select("doc_id", "k1", "k2", "row", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    lines = lines.select("doc_id", "k1", "k2", "row", "pos", key.alias("key")).where(F.length("key") >= min_len)
    return cut(lines.select("doc_id", "k1", "k2", "row", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(2), "key").alias("h2")))


def stream(lines: DataFrame) -> DataFrame:
    """The occurrences in range partitions, sorted by key, document and position, each with `first`: whether it is the first
    of its key in its document. The window's runs lie inside the range partitions, so they are read off the sorted rows."""
    run = ["h1", "h2", "doc_id", "row"]
    ranged = lines.repartitionByRange(partitions(lines.sparkSession), *run).sortWithinPartitions(*run, "pos")
    return ranged.withColumn("first", F.col("pos") == F.first("pos").over(W.partitionBy(*run).orderBy("pos")))


def frequent_keys(runs: DataFrame, min_docs: int = 10) -> DataFrame:
    """h1, h2, n_docs and the first occurrence (by doc_id, key, position) of each key in min_docs documents or more."""
    first = F.min(F.struct("doc_id", "k1", "k2", "pos")).alias("first")
    return runs.where("first").groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), first).where(F.col("n_docs") >= min_docs)


def keep_bitmaps(docs: DataFrame, min_docs: int = 10, min_len: int = 1, keep: str = "none") -> DataFrame:
    """k1, k2 and `dropped`, the sorted positions that a document loses; documents that lose none are absent.

    keep: of a frequent key stay "none" of its lines, or the "first" one in the corpus."""
    lines = cut(stream(occurrences(docs, min_len)))
    frequent = cut(frequent_keys(lines, min_docs).drop("n_docs", *([] if keep == "first" else ["first"])))
    if frequent.count() <= BROADCAST_KEYS:
        frequent = F.broadcast(frequent)
    hits = lines.drop("first").join(frequent, ["h1", "h2"])
    if keep == "first":
        hits = hits.where(~F.struct("k1", "k2", "pos").eqNullSafe(F.struct("first.k1", "first.k2", "first.pos")))
    return hits.groupBy("k1", "k2").agg(F.sort_array(F.collect_set("pos")).alias("dropped"))


def kept_runs(dropped: Column, n: Column) -> Column:
    """The keep bitmap, compressed: array<struct<start, length>> of the runs of lines that stay."""
    edges = F.concat(F.array(F.lit(-1)), dropped, F.array(n.cast("int")))
    gaps = F.transform(F.slice(edges, 1, F.size(edges) - 1), lambda d, i: F.struct((d + 1).alias("start"), (F.get(edges, i + 1) - d - 1).alias("length")))
    return F.filter(gaps, lambda r: r["length"] > 0)


def line_dedup(docs: DataFrame, min_docs: int = 10, min_len: int = 1, keep: str = "none") -> DataFrame:
    """doc_id, n_lines, n_dropped, keep (the compressed bitmap) and kept_text of every row of docs, and its k1, k2."""
    rows = with_key(texts(docs))
    lines = F.split("text", "\n", -1)
    out = rows.join(keep_bitmaps(docs, min_docs, min_len, keep), ["k1", "k2"], "left")
    n_dropped = F.coalesce(F.size("dropped"), F.lit(0))
    out = out.select(
        "k1", "k2", "doc_id", F.size(lines).cast("long").alias("n_lines"), F.when(F.col("dropped").isNull(), 0).otherwise(n_dropped).cast("long").alias("n_dropped"),
        kept_runs(F.coalesce("dropped", F.array().cast("array<int>")), F.size(lines)).alias("keep"), "dropped", "text",
    )
    kept = F.array_join(F.flatten(F.transform("keep", lambda r: F.slice(lines, r["start"] + 1, r["length"]))), "\n")
    return out.withColumn("kept_text", F.when(F.col("dropped").isNull(), F.col("text")).otherwise(kept)).drop("dropped", "text")


def digest(docs: DataFrame) -> DataFrame:
    out = line_dedup(docs, min_docs=10, min_len=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def without_frequent_lines(docs: DataFrame, min_docs: int = 10, min_len: int = 1) -> DataFrame:
    """docs with the kept lines as text (n_chars, if there is such a column, follows); a null text stays null."""
    row = {"k1": F.xxhash64(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")))}
    row["k2"] = F.xxhash64(F.lit(1), F.coalesce("text", F.lit("")), F.col("doc_id").cast("long"))
    k1, k2, dropped = spare(docs, "k1", "k2", "dropped")
    keyed = docs.withColumns({k1: row["k1"], k2: row["k2"]})
    hits = keep_bitmaps(docs, min_docs, min_len).select(F.col("k1").alias(k1), F.col("k2").alias(k2), F.col("dropped").alias(dropped))
    lines, none = F.split("text", "\n", -1), F.col(dropped).isNull()
    kept = F.array_join(F.flatten(F.transform(kept_runs(F.col(dropped), F.size(lines)), lambda r: F.slice(lines, r["start"] + 1, r["length"]))), "\n")
    out = keyed.join(hits, [k1, k2], "left").withColumn("text", F.when(none, F.col("text")).otherwise(kept))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(none, F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
