"""Vector stores as immutable DataFrames: what a store with slots, ids and cells does, said relationally.

A flat store has rows (address, id, vec); a cell store (cell, slot, id, vec), slots counted within the cell. Each
operation returns a new DataFrame. Ids are the contract; addresses exist for parity and are dense or reused slots.
Auto ids continue from the largest id, deletes work and never hide other rows, unknown ids are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import metrics as M
from . import scratch


def vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Any table of vectors as (id, vec)."""
    return df.select(F.col(id_col).cast("long").alias("id"), M.doubles(vec_col).alias("vec"))


def check_schema(df: DataFrame, **types: str) -> DataFrame:
    """df, if its columns have these types (as in simpleString)."""
    own = dict(df.dtypes)
    wrong = {c: own.get(c) for c, t in types.items() if own.get(c) != t}
    if wrong:
        raise TypeError(f"columns differ from {types}: {wrong}")
    return df


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with dense numbers from 0 in the given order. Rows are range-partitioned and sorted, and kept with the number of
    their partition, so that counting and numbering see the same partitions; a partition is numbered on its own, and no
    task sees all rows. Rows equal in `order` follow a hash of the row, so that many of them share no partition."""
    tie = F.xxhash64(*df.columns)
    ranged = df.withColumn("_t", tie).repartitionByRange(*order, "_t").sortWithinPartitions(*order, "_t")
    ranged = scratch.cut(ranged.withColumn("_p", F.spark_partition_id()))
    ahead = W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    sizes = ranged.groupBy("_p").agg(F.count("*").alias("_c")).select("_p", F.coalesce(F.sum("_c").over(ahead), F.lit(0)).alias("_a"))
    ranged = ranged.withColumn("_r", F.row_number().over(W.partitionBy("_p").orderBy(*order, "_t")))
    return ranged.join(F.broadcast(sizes), "_p").withColumn(name, F.col("_a") + F.col("_r") - 1).drop("_p", "_r", "_a", "_t")


def numbered_within(df: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """df with dense numbers from 0 within each group, in the given order; rows equal in `order` follow a hash of the row. As
    `numbered`: rows are range-partitioned by group and order, so that a group of any size spans as many partitions as it
    fills; a partition numbers its own part of a group, and what the group has in the partitions before it comes from
    counts, one row a group and partition. The window over those is as long as a group has partitions."""
    tie = F.xxhash64(*df.columns)
    ranged = df.withColumn("_t", tie).repartitionByRange(group, *order, "_t").sortWithinPartitions(group, *order, "_t")
    ranged = scratch.cut(ranged.withColumn("_p", F.spark_partition_id()))
    ahead = W.partitionBy(group).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    sizes = ranged.groupBy("_p", group).agg(F.count("*").alias("_c")).withColumn("_a", F.coalesce(F.sum("_c").over(ahead), F.lit(0)))
    # only a group that begins in an earlier partition needs an offset: at most one a partition
    later = sizes.where("_a > 0").select("_p", F.struct(F.col(group).alias("g"), "_a").alias("_s"))
    later = later.groupBy("_p").agg(F.first("_s").alias("_s"))
    ranged = ranged.withColumn("_r", F.row_number().over(W.partitionBy("_p", group).orderBy(*order, "_t")))
    shift = F.when(F.col("_s.g").eqNullSafe(F.col(group)), F.col("_s._a")).otherwise(F.lit(0).cast("long"))
    return ranged.join(F.broadcast(later), "_p", "left").withColumn(name, shift + F.col("_r") - 1).drop("_p", "_r", "_s", "_t")


def with_auto_ids(new: DataFrame, store: DataFrame | None, order: list[str]) -> DataFrame:
    """new with dense ids from the store's largest id + 1 (0 for an empty store)."""
    top = -1 if store is None else store.agg(F.max("id")).first()[0]
    start = 0 if top is None else top + 1
    return numbered(new, order, "_i").withColumn("id", F.col("_i") + F.lit(start)).drop("_i")


def flat_add(store: DataFrame, new: DataFrame) -> DataFrame:
    """(address, id, vec) with the rows of new (id, vec) at the next addresses, in the order of id. So too for a group
    store (address, id, vec_0, vec_1, ...)."""
    end = store.agg(F.coalesce(F.max("address") + 1, F.lit(0))).first()[0]
    placed = numbered(new, ["id"], "_n").withColumn("address", F.col("_n") + F.lit(end)).drop("_n")
    return store.unionByName(placed.select(*store.columns))


def flat_remove(store: DataFrame, ids: DataFrame) -> DataFrame:
    """The store without these ids, kept dense: rows from the tail move into the holes, in order."""
    left = store.join(ids.select("id").distinct(), "id", "left_anti")
    n = left.count()
    holes = store.join(ids.select("id").distinct(), "id", "left_semi").where(F.col("address") < n).select(F.col("address").alias("hole"))
    movers = left.where(F.col("address") >= n)
    moved = numbered(movers, ["address"], "_k").join(numbered(holes, ["hole"], "_k"), "_k").withColumn("address", F.col("hole"))
    return left.where(F.col("address") < n).unionByName(moved.select(*left.columns)).select(*store.columns)


def remove(store: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose id is not listed; addresses stay (holes)."""
    return store.join(ids.select("id").distinct(), "id", "left_anti")


def remove_addresses(store: DataFrame, addresses: DataFrame, capacity: int) -> DataFrame:
    """The rows at other addresses; duplicates and addresses outside the capacity are ignored."""
    valid = addresses.where((F.col("address") >= 0) & (F.col("address") < capacity)).dropDuplicates(["address"])
    return store.join(valid.select("address"), "address", "left_anti")


def truncate(store: DataFrame) -> DataFrame:
    return store.limit(0)


def _filled(df: DataFrame, widths: dict[str, int]) -> DataFrame:
    return df.withColumns({c: F.coalesce(M.doubles(c), F.array_repeat(F.lit(0.0), n)) for c, n in widths.items()})


def get_by_address(store: DataFrame, addresses: DataFrame, width: int | dict[str, int]) -> DataFrame:
    """address, vec; the zero vector where there is no row. Of a group store: its members, width by column."""
    widths = width if isinstance(width, dict) else {"vec": width}
    return _filled(addresses.join(store.select("address", *widths), "address", "left"), widths)


def get_by_id(store: DataFrame, ids: DataFrame, width: int | dict[str, int]) -> DataFrame:
    """id, vec; the zero vector for an unknown id. Of a group store: its members, width by column."""
    widths = width if isinstance(width, dict) else {"vec": width}
    return _filled(ids.join(store.select("id", *widths), "id", "left"), widths)


def update(store: DataFrame, changes: DataFrame, key: str = "address") -> DataFrame:
    """The store with vectors replaced where changes (key, vec, or some members of a group) has the key; unknown keys are
    ignored, and of several changes of a key the one whose vectors are largest holds."""
    own = [c for c in changes.columns if c != key]
    new = changes.groupBy(key).agg(F.max(F.struct(*own)).alias("_new"))
    return store.join(new, key, "left").withColumns({c: F.coalesce(F.col("_new")[c], F.col(c)) for c in own}).select(*store.columns)


def address_of(store: DataFrame, ids: DataFrame) -> DataFrame:
    """id, address: the first match, -1 for an unknown id."""
    first = store.groupBy("id").agg(F.min("address").alias("address"))
    return ids.join(first, "id", "left").withColumn("address", F.coalesce("address", F.lit(-1).cast("long")))


def id_of(store: DataFrame, addresses: DataFrame) -> DataFrame:
    """address, id; -1 where there is no row."""
    return addresses.join(store.select("address", "id"), "address", "left").withColumn("id", F.coalesce("id", F.lit(-1).cast("long")))


def member(group: DataFrame, i: int) -> DataFrame:
    """One member of a group store (id, vec_0, vec_1, ...), as a read-only store (id, vec)."""
    return group.select("id", F.col(f"vec_{i}").alias("vec"))


def statistics(store: DataFrame, vec: str = "vec") -> DataFrame:
    """n_items, max_id and bytes (8 an element)."""
    size = F.sum(F.size(vec) * 8)
    return store.agg(F.count("*").alias("n_items"), F.coalesce(F.max("id"), F.lit(-1).cast("long")).alias("max_id"), F.coalesce(size, F.lit(0)).cast("long").alias("bytes"))


def capacity(n: Column, step: int, mode: str = "double", initial: int = 0) -> Column:
    """The capacity that a store of n items has grown to: by steps, or doubling from max(initial, step)."""
    start = max(initial, step) if mode == "double" else initial
    if mode == "step":
        return F.greatest(F.lit(start), F.lit(start) + F.ceil((n - start) / step) * step).cast("long")
    return F.when(n <= start, F.lit(start)).otherwise(F.lit(start) * F.pow(F.lit(2.0), F.ceil(F.round(F.log2(n / start), 9)))).cast("long")


# Cells


def index_of_appearance(df: DataFrame, order: str = "pos", cell: str = "cell") -> DataFrame:
    """df with ioa: how often its cell came before, in the order given. A cell may hold any share of the rows."""
    return numbered_within(df, cell, [order], "ioa")


def cell_sizes(df: DataFrame, cells: int | None = None) -> DataFrame:
    """cell, size; with `cells`, the empty ones too."""
    sizes = df.groupBy("cell").agg(F.count("*").alias("size"))
    if cells is None:
        return sizes
    every = df.sparkSession.range(cells).select(F.col("id").cast("int").alias("cell"))
    return every.join(sizes, "cell", "left").select("cell", F.coalesce("size", F.lit(0).cast("long")).alias("size"))


def cell_starts(sizes: DataFrame, size: str = "capacity") -> DataFrame:
    """sizes (cell, capacity) with start, the capacities of all cells before. One row a cell."""
    ahead = W.orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    return sizes.withColumn("start", F.coalesce(F.sum(size).over(ahead), F.lit(0)).cast("long"))


def cell_of_address(addresses: DataFrame, starts: DataFrame) -> DataFrame:
    """address, cell: the cell whose slots hold it, -1 outside. starts: cell, start, capacity (one row a cell); they reach
    every task as one sorted array, and an address finds its cell by bisection."""
    at = starts.where("capacity > 0").agg(F.array_sort(F.collect_list(F.struct("start", (F.col("start") + F.col("capacity")).alias("end"), "cell"))).alias("_at"))
    low, high = F.lit(0), F.size("_at")
    bounds = F.struct(low.alias("low"), high.alias("high"))

    def halve(b: Column, _: Column) -> Column:
        mid = F.floor((b["low"] + b["high"]) / 2).cast("int")
        right = F.get("_at", mid)["start"] <= F.col("address")
        return F.when(b["low"] < b["high"], F.struct(F.when(right, mid + 1).otherwise(b["low"]).alias("low"), F.when(right, b["high"]).otherwise(mid).alias("high"))).otherwise(b)

    # as many steps as a number of cells has bits
    found = addresses.crossJoin(F.broadcast(at)).withColumn("_i", F.aggregate(F.sequence(F.lit(1), F.lit(32)), bounds, halve)["low"] - 1)
    own = F.get("_at", F.col("_i"))
    return found.withColumn("_own", own).select(*addresses.columns, F.when((F.col("_own.start") <= F.col("address")) & (F.col("address") < F.col("_own.end")), F.col("_own.cell")).otherwise(F.lit(-1)).alias("cell"))


def write_slots(store: DataFrame, new: DataFrame, order: str = "id") -> DataFrame:
    """new (cell, ...) with the slot that each row takes: the free slots of its cell from the lowest, then new ones.

    The gap before each taken slot is a run of free ones: taken slots are numbered within their cell, each meets the one
    before it by an equi-join on the cell and the number, and the n-th newcomer of a cell takes its n-th free slot."""
    taken = numbered_within(store.select("cell", F.col("slot").alias("s")), "cell", ["s"], "n")
    before = taken.select("cell", (F.col("n") + 1).alias("n"), F.col("s").alias("last"))
    runs = taken.join(before, ["cell", "n"], "left").select("cell", "s", (F.coalesce("last", F.lit(-1)) + 1).alias("from"))
    holes = runs.where(F.col("from") < F.col("s")).select("cell", F.explode(F.sequence("from", F.col("s") - 1)).alias("slot"))
    holes = numbered_within(holes, "cell", ["slot"], "ioa")
    ends = store.groupBy("cell").agg(F.max("slot").alias("top"), F.count("*").alias("n"))
    out = index_of_appearance(new, order).join(holes, ["cell", "ioa"], "left").join(ends, "cell", "left")
    beyond = F.coalesce("top", F.lit(-1)) + 1 + F.col("ioa") - (F.coalesce("top", F.lit(-1)) + 1 - F.coalesce("n", F.lit(0)))
    return out.withColumn("slot", F.coalesce("slot", beyond).cast("long")).drop("top", "n", "ioa")


def cell_add(store: DataFrame, new: DataFrame) -> DataFrame:
    """(cell, slot, id, vec) with new (cell, id, vec) written to free slots first."""
    return store.unionByName(write_slots(store, new).select(*store.columns))
