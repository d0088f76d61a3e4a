"""Helpers that several operators share: scratch tables, whole-word rules and
connected components by star contraction."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.scratch import folder

#: Words of the contracts: maximal runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
_ARROW = {"long": pa.int64(), "double": pa.float64(), "string": pa.string()}
LOWER_FROM, LOWER_TO = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def scratch_dir(spark: SparkSession) -> str:
    """A new folder in the shared place that ``spark.checkpoint.dir`` names."""
    return folder(spark)


def cut(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back.

    This ends the lineage: what follows reads files that every executor reaches
    and that outlive the executor that wrote them."""
    path = path or scratch_dir(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder that nothing reads any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with underscores after it if ``df`` has such a column already."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def small(df: DataFrame, rows: int, bound: int) -> DataFrame:
    """``df`` to be broadcast if its known number of rows is within ``bound``; beyond
    it Spark shuffles both sides."""
    return F.broadcast(df) if rows <= bound else df


def cut_by(df: DataFrame, key: str) -> DataFrame:
    """``df`` written to the scratch folder in buckets of ``key``, one file each, so
    that grouping by ``key`` reads it without another shuffle."""
    spark, name = df.sparkSession, f"beamline_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer = df.repartition(n, key).write.format("parquet").option("compression", "zstd").bucketBy(n, key).sortBy(key)
    writer.option("path", scratch_dir(spark)).saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # forgets the name; the files stay
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a batch that Python holds as objects at once.
ROWS = 1000
_HELD: dict = {}


def held(name, make: Callable):
    """What ``make()`` gives, kept by this worker for its next tasks until something of
    another name is asked for; so a worker holds one operator's caches at most."""
    if name not in _HELD:
        _HELD.clear()
        release()
        _HELD[name] = make()
    return _HELD[name]


def release() -> None:
    """Give memory that is free in this worker back to the system, where the C library
    can: large arrays that come and go else stay with the worker."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            yield b.slice(at, ROWS)


def add_columns(df: DataFrame, inputs: tuple[str, ...], added: str, start: Callable[[], Callable]) -> DataFrame:
    """``df`` with columns ``added`` (DDL) that Python computes, batch by batch.

    ``start()`` is called once a task and returns a function of the lists of
    ``inputs`` that returns a list for each added column. The other columns pass as
    they are, nulls and types included."""
    fields = StructType.fromDDL(added).fields
    types = [_ARROW[f.dataType.typeName()] for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = start()
        for b in slices(batches):
            new = compute(*[b.column(i).to_pylist() for i in inputs])
            arrays = [pa.array(c, t) for c, t in zip(new, types)]
            yield pa.RecordBatch.from_arrays(b.columns + arrays, b.schema.names + [f.name for f in fields])

    return df.mapInArrow(run, StructType(df.schema.fields + fields))


def keep_rows(df: DataFrame, column: str, start: Callable[[], Callable]) -> DataFrame:
    """Rows of ``df`` for which a Python function of one column's batch says true."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = start()
        for b in slices(batches):
            yield b.filter(pa.array(keep(b.column(column).to_pylist()), pa.bool_()))

    return df.mapInArrow(run, df.schema)


def numbered(df: DataFrame, *order) -> DataFrame:
    """``df`` with ``place``, its position from 0 in the given order.

    The sorted rows are written, so that a row's partition and its position there
    are fixed; only the number of rows of each partition is summed."""
    ordered = cut(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    counts = ordered.groupBy(part.alias("_part")).count()
    before = counts.select("_part", F.coalesce(F.sum("count").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return ordered.withColumn("_part", part).join(before, "_part").withColumn("place", F.col("_before") + F.expr("_at & 8589934591")).drop("_at", "_part", "_before")


def forest(n: int, left: np.ndarray, right: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """Smallest index of each index's component under the links left-right."""
    label = np.arange(n) if label is None else label
    while left.size:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, label[left], low)
        np.minimum.at(new, label[right], low)
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    while not np.array_equal(label, label[label]):
        label = label[label]
    return label


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a long, b long)`` as ``(node, root)``.

    Alternating large-star and small-star steps; ``root`` is the smallest node
    of the component, which has a row of its own. Each half step is one
    aggregation (combined before the shuffle) and one join against one row a
    key, so a hub's edges can be split over tasks. Nothing is collected but a
    pair of checksums per round."""
    spark = edges.sparkSession
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        sums = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if sums[0] == 0 or sums == before:
            break
        before = sums
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut(large.where("u <> v").distinct())
        low = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u")
        edges = cut(
            small.select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
            .union(low.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct()
        )
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
