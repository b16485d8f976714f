"""Mixing sources to target weights: weighted fair queueing with built-in functions only.

Each source is a queue of its documents in the order of md5(doc_id) (without an id, of the text's hash); a second
pass over the queue follows the first. A document's virtual finish time is the source's words up to its end divided
by the source's target. The packets of all queues are range-sorted globally by virtual finish time, and running
totals of the sorted partitions find the packet at which the total budget is used up: what comes later in that order
is not taken. A document that lies across its source's target is two packets, up to that word and from it on, so
serving in that order gives each source its share at every moment and its target, rounded down, at the end.

Running sums never put a source into one task. Words are summed by (source, leading hex digits of the md5), so many
that a bucket holds a bounded number of rows; bucket sums get prefix sums within their parents, and parents within
theirs, each window of at most 4096 rows; rows are added up within their bucket alone. Of the sorted schedule one row
a partition reaches the driver, and the place of the cut.

Defined cases: a null or empty text has size 0 and is never taken; null is a source of its own, last; a
source of size 0 has target 0; an empty table gives an empty result; repeated rows are documents of their own, each
served as its place in the queue says.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, cut

#: Rows that a bucket of the prefix sums has on average, at most.
BUCKET_ROWS = 256
#: Hex digits that a level of the prefix sums adds: a window has at most 16 ** DIGITS rows.
DIGITS = 3


def sized(docs: DataFrame, *keep: Column) -> DataFrame:
    """doc_id, source, size in words, the place `o` in the queue and what else is to be kept; th tells rows apart that
    repeat an id."""
    th = F.xxhash64("text")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("size"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.hex(th)).cast("binary")).alias("o"), th.alias("th"), *keep,
    ).withColumn("src", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("t")))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """src, source_size, target: the budget, shared by weight; a target stops at `most` times its source, the
    rest being shared again. In the order of cap / weight the sources that stop are a prefix, so one pass over
    the (small) table of sources finds the level. sizes: src, words."""
    total = sizes.groupBy("src").agg(F.sum("words").alias("source_size"))
    order = F.row_number().over(W.orderBy("src")) - 1
    weigh = F.element_at(F.array(*map(F.lit, weights)), (order % len(weights) + 1).cast("int")).cast("double")
    t = total.withColumn("w", weigh).withColumn("cap", F.lit(most) * F.col("source_size")).withColumn("r", F.col("cap") / F.col("w"))
    ahead = W.orderBy("r", "src").rowsBetween(W.unboundedPreceding, -1)
    onward = W.orderBy("r", "src").rowsBetween(W.currentRow, W.unboundedFollowing)
    everything = W.orderBy("r", "src").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    left = F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(ahead), F.lit(0.0))
    t = t.withColumn("level", left / F.sum("w").over(onward))
    level = F.max(F.when(F.col("r") > F.col("level"), F.col("level"))).over(everything)
    return t.select("src", "source_size", F.coalesce(F.least("cap", F.col("w") * level), "cap").alias("target"))


def prefix_sums(sums: DataFrame, digits: int) -> DataFrame:
    """sums (src, bucket, words; a bucket is so many hex digits) with `base`, the words of the source's buckets before."""
    if digits <= DIGITS:
        ahead = F.sum("words").over(W.partitionBy("src").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
        return sums.withColumn("base", F.coalesce(ahead, F.lit(0)))
    sums = sums.withColumn("parent", F.substring("bucket", 1, digits - DIGITS))
    parents = sums.groupBy("src", F.col("parent").alias("bucket")).agg(F.sum("words").alias("words"))
    parents = prefix_sums(parents, digits - DIGITS).select("src", F.col("bucket").alias("parent"), F.col("base").alias("above"))
    ahead = F.sum("words").over(W.partitionBy("src", "parent").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
    return sums.withColumn("base", F.coalesce(ahead, F.lit(0))).join(parents, ["src", "parent"]).withColumn("base", F.col("base") + F.col("above")).drop("parent", "above")


class Queues:
    """The prefix sums of all queues and the targets of their sources."""

    def __init__(self, rows: DataFrame, weights: tuple[int, ...], share: float, most: float) -> None:
        """rows: sized documents, computed once already."""
        self.digits = max(1, math.ceil(math.log(max(2, rows.count() / BUCKET_ROWS), 16)))
        self.passes = math.ceil(most)
        sums = cut(self._bucketed(rows).groupBy("src", "bucket").agg(F.sum("size").alias("words")))
        own = cut(targets(sums, weights, share, most))  # one row a source
        self.budget = own.agg(F.sum(F.floor("target"))).first()[0] or 0
        self.prefix = cut(prefix_sums(sums, self.digits).join(own, "src").drop("words"))

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.substring("o", 1, self.digits))

    def placed(self, rows: DataFrame) -> DataFrame:
        """The sized rows with source_size, target and `before`, the words ahead of them in their queue."""
        inside = W.partitionBy("src", "bucket").orderBy("o", "doc_id", "th").rowsBetween(W.unboundedPreceding, -1)
        rows = self._bucketed(rows).withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        return rows.join(self.prefix, ["src", "bucket"]).withColumn("before", F.col("base") + F.col("within")).drop("base", "within", "bucket")

    def packets(self) -> Column:
        """The packets of a placed row, in the order of virtual time: array<struct<finish, src, start, pass, words>>."""
        out = []
        for p in range(self.passes):
            start = F.col("before") + F.lit(p) * F.col("source_size")
            first = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.floor("target") - start))
            for begin, words in ((start, first), (start + first, F.col("size") - first)):
                finish = F.try_divide(begin + words, F.col("target"))
                out.append(F.struct(finish.alias("finish"), F.col("src").alias("src"), begin.alias("start"), F.lit(p).alias("pass"), words.alias("words")))
        return F.filter(F.array(*out), lambda x: (x["words"] > 0) & x["finish"].isNotNull())


def cut_of(placed: DataFrame, queues: Queues) -> tuple[float, str, int, int] | None:
    """Where the schedule, sorted globally by virtual finish time, uses the budget up: finish, src and start of the last
    packet that is served, and how many of its words; None if everything is served."""
    order = ["finish", "src", "start"]
    packets = placed.select(F.inline(queues.packets()))
    # a partition's number is stored with its rows: no plan relies on two evaluations of it
    ranged = cut(packets.select(*order, "words").repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()))
    ahead = 0
    for r in ranged.groupBy("part").agg(F.sum("words").alias("words"), F.min("finish").alias("low")).orderBy("low", "part").collect():  # one row a partition
        if ahead + r["words"] >= queues.budget:
            break
        ahead += r["words"]
    else:
        return None
    running = F.sum("words").over(W.partitionBy("part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    own = ranged.where(F.col("part") == r["part"]).withColumn("left", F.lit(queues.budget - ahead) - F.coalesce(running, F.lit(0)))
    last = own.where("left > 0").agg(F.max(F.struct(*order, F.least("words", "left").alias("words"))).alias("x")).select("x.*").first()
    return None if last["finish"] is None else tuple(last)


def served(queues: Queues, last: tuple | None) -> Column:
    """The packets of a placed row that the schedule serves."""
    if last is None:
        return queues.packets()
    place = F.struct(F.lit(last[0]).alias("finish"), F.lit(last[1]).alias("src"), F.lit(last[2]).cast("long").alias("start"))
    own = lambda x: F.struct(x["finish"].alias("finish"), x["src"].alias("src"), x["start"].alias("start"))
    kept = lambda x: F.when(own(x) < place, x["words"]).when(own(x) == place, F.least(x["words"], F.lit(last[3]).cast("long"))).otherwise(F.lit(0).cast("long"))
    return F.filter(F.transform(queues.packets(), lambda x: x.withField("words", kept(x))), lambda x: x["words"] > 0)


def _scheduled(docs: DataFrame, weights: tuple[int, ...], share: float, most: float) -> tuple[Queues, DataFrame, Column]:
    rows = cut(sized(docs))
    queues = Queues(rows, weights, share, most)
    placed = cut(queues.placed(rows))
    return queues, placed, served(queues, cut_of(placed, queues))


def schedule(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """The mix in serving order: doc_id, source, th, size and each packet's finish (virtual), start, pass and words."""
    _, placed, packets = _scheduled(docs, weights, share, most)
    rows = placed.select("doc_id", "source", "th", "size", F.inline(packets)).drop("src")
    return rows.repartitionByRange("finish", "source", "start").sortWithinPartitions("finish", "source", "start")


def mixed(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """doc_id, size, source_size, target, taken (the words of its packets that are served) of every row."""
    _, placed, packets = _scheduled(docs, weights, share, most)
    taken = F.aggregate(packets, F.lit(0).cast("long"), lambda a, x: a + x["words"])
    return placed.select("doc_id", "size", "source_size", F.col("target").cast("double").alias("target"), taken.alias("taken"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """The mixed documents in serving order: the columns of docs, each row as often as passes serve it; where the
    budget cuts a document, the words before the cut stay (n_chars, if there is such a column, follows). Of rows that
    repeat, each has its own place in the queue."""
    queues, _, packets = _scheduled(docs, weights, share, most)
    out = queues.placed(sized(docs, F.struct(*(F.col(c) for c in docs.columns)).alias("_row"))).where("size > 0")
    out = out.select("_row", "size", "src", F.inline(_passes(packets, queues.passes)))
    text = F.col("_row")["text"]
    rest = F.element_at(F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])", (F.col("words") + 1).cast("int")), -1)
    out = out.withColumn("_rest", F.when(F.col("words") < F.col("size"), rest))
    text = F.when(F.col("words") < F.col("size"), F.expr("substring(_row.text, 1, length(_row.text) - length(_rest))")).otherwise(text)
    out = out.repartitionByRange("finish", "src", "start").sortWithinPartitions("finish", "src", "start").select("_row", text.alias("_text"))
    columns = [F.col("_text").alias(c) if c == "text" else F.length("_text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col("_row")[c].alias(c) for c in docs.columns]
    return out.select(*columns)


def _passes(packets: Column, passes: int) -> Column:
    """What each pass serves of a row: array<struct<words, finish, start>>, without passes that serve nothing."""

    def of(p: int) -> Column:
        own = F.filter(packets, lambda x: x["pass"] == p)
        words = F.aggregate(own, F.lit(0).cast("long"), lambda a, x: a + x["words"])
        return F.struct(words.alias("words"), F.array_max(F.transform(own, lambda x: x["finish"])).alias("finish"), F.array_min(F.transform(own, lambda x: x["start"])).alias("start"))

    return F.filter(F.array(*map(of, range(passes))), lambda x: x["words"] > 0)
