"""Models and indexes on disk, in versions.

A save writes its tables and arrays into a new folder and, last of all, a manifest with the next number. A reader takes the
newest manifest that is whole, so it never sees half a save; a save that is killed leaves the older version as it was, and
an index may be saved over the version that it is read from. Folders of versions before the last KEEP go. Two saves at
once cannot both take a number: the later one fails. Arrays are Parquet tables of blocks of rows."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch

#: Versions that stay, and numbers of an array's block.
KEEP, BLOCK = 2, 1 << 16


class Bucketed(NamedTuple):
    """How a table lies on disk: bucketed by a column, sorted inside a bucket, in so many buckets."""

    by: str
    sort: list[str]
    n: int


def write_bucketed(df: DataFrame, path: str, layout: Bucketed) -> DataFrame:
    """The rows as a table of one file a bucket: joins and groups by the bucket's column do not move them."""
    name = f"veclode_{uuid.uuid4().hex}"
    own = df.repartition(layout.n, layout.by).sortWithinPartitions(*layout.sort)
    own.write.format("parquet").option("path", path).bucketBy(layout.n, layout.by).sortBy(*layout.sort).saveAsTable(name)
    return df.sparkSession.table(name)


def open_bucketed(spark: SparkSession, path: str, columns: list[list[str]], layout: Bucketed) -> DataFrame:
    """What write_bucketed wrote, of columns (name, type)."""
    name, own = f"veclode_{uuid.uuid4().hex}", ", ".join(f"`{c}` {t}" for c, t in columns)
    place = path.replace("'", "\\'")
    spark.sql(f"CREATE TABLE {name} ({own}) USING parquet CLUSTERED BY ({layout.by}) SORTED BY ({', '.join(layout.sort)}) INTO {layout.n} BUCKETS LOCATION '{place}'")
    return spark.table(name)


def versions(path: str, spark: SparkSession) -> list[int]:
    """The numbers of the whole manifests, oldest first."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/manifests")
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    names = [f.getPath().getName() for f in fs.listStatus(folder)]
    return sorted(int(n) for n in names if n.isdigit() and fs.exists(done(f"{path}/manifests/{n}/_SUCCESS")))


def _manifest(path: str, spark: SparkSession, version: int) -> dict:
    return json.loads(spark.read.text(f"{path}/manifests/{version}", wholetext=True).first()[0])


def save(path: str, spark: SparkSession, settings: dict, arrays: dict[str, np.ndarray], tables: Callable[[str], dict[str, tuple[DataFrame, Bucketed]]]) -> int:
    """Writes a version and returns its number. tables: given a folder, writes each table into a folder of its name there
    (by write_bucketed)."""
    old = versions(path, spark)
    folder, version = f"v-{uuid.uuid4().hex}", old[-1] + 1 if old else 0
    for name, a in arrays.items():
        flat = np.ascontiguousarray(a, np.float64).ravel()
        starts = np.append(np.arange(0, len(flat), BLOCK), len(flat))
        blocks = pa.table({"block": pa.array(np.arange(len(starts) - 1)), "data": pa.LargeListArray.from_arrays(pa.array(starts), pa.array(flat)).cast(pa.list_(pa.float64()))})
        spark.createDataFrame(blocks).coalesce(1).write.parquet(f"{path}/{folder}/arrays/{name}")
    written = tables(f"{path}/{folder}")
    text = json.dumps({
        "folder": folder, "settings": settings, "arrays": {n: list(a.shape) for n, a in arrays.items()},
        "tables": {n: {"columns": df.dtypes, "layout": layout} for n, (df, layout) in written.items()},
    })
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{path}/manifests/{version}")
    for number in [v for v in old if v <= version - KEEP]:
        scratch.remove(spark, f"{path}/{_manifest(path, spark, number)['folder']}")
        scratch.remove(spark, f"{path}/manifests/{number}")
    return version


def load(path: str, spark: SparkSession, version: int | None = None) -> tuple[dict, dict[str, np.ndarray], dict[str, DataFrame]]:
    """Settings, arrays and tables of a version, the newest if none is given; a table whose columns differ from the manifest's
    is refused."""
    known = versions(path, spark)
    if not known or version is not None and version not in known:
        raise FileNotFoundError(f"{path} holds no version {'' if version is None else version}")
    m = _manifest(path, spark, known[-1] if version is None else version)
    folder, arrays, tables = f"{path}/{m['folder']}", {}, {}
    for name, shape in m["arrays"].items():
        blocks = spark.read.parquet(f"{folder}/arrays/{name}").orderBy("block").toArrow()["data"].combine_chunks()  # a model's numbers
        arrays[name] = blocks.flatten().to_numpy(zero_copy_only=False).reshape(shape)
    for name, own in m["tables"].items():
        found = spark.read.parquet(f"{folder}/{name}").dtypes
        if sorted(map(list, found)) != sorted(map(list, own["columns"])):
            raise ValueError(f"{folder}/{name} has columns {found}, the manifest {own['columns']}")
        tables[name] = open_bucketed(spark, f"{folder}/{name}", own["columns"], Bucketed(*own["layout"]))
    return m["settings"], arrays, tables


def load_side_table(path: str, spark: SparkSession, ids: DataFrame) -> DataFrame:
    """The rows of a side table (id, ...) for some ids: raw vectors kept for re-ranking, read late."""
    return spark.read.parquet(path).join(ids.select(F.col("id")).distinct(), "id", "left_semi")
