"""Shared plumbing of the training-data operators: tables, staging folder, ranking."""

from __future__ import annotations

import atexit
import ctypes.util
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.shipping import ship

_written: list[tuple[SparkSession, str]] = []

_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: A piece of work that a Python worker holds at once, in bytes of text.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where none is named, a temporary one in local mode and an error on a cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = found.get() if found.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        root = f"file://{tempfile.mkdtemp(prefix='quernstone-')}"
        spark.sparkContext.setCheckpointDir(root)
    return root


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder; it is removed when the driver's Python ends."""
    if not _written:
        atexit.register(_clean)
    path = f"{shared_root(spark).rstrip('/')}/quernstone-{uuid.uuid4().hex}-{label}"
    _written.append((spark, path))
    return path


def _clean() -> None:
    while _written:
        spark, path = _written.pop()
        drop_path(spark, path)


def drop_path(spark: SparkSession, path: str) -> None:
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session has ended; the folder's owner clears what is left
        return


def file_system(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a folder that Spark names, and the path in it: s3a and s3n are s3; what pyarrow has no name for goes to Hadoop's library."""
    scheme, colon, rest = uri.partition("://")
    if not colon or scheme in ("file", "hdfs", "viewfs", "gs", "gcs", "abfs", "abfss", "s3"):
        return pyarrow.fs.FileSystem.from_uri(uri if colon else f"file://{uri.removeprefix('file:')}")
    if scheme in ("s3a", "s3n"):
        return pyarrow.fs.FileSystem.from_uri(f"s3://{rest}")
    host, slash, path = rest.partition("/")
    return pyarrow.fs.HadoopFileSystem(f"{scheme}://{host}"), slash + path


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    held = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, min(int(held), 1000) if int(held) > 0 else 1000)  # rows may be long
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_BATCH, held)
    return spark.read.schema(df.schema).parquet(path)


class Tables:
    """Tables written to the shared folder by name; they can be dropped when what is made of them is written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.held = spark, {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        out = staged(df, name)
        self.held[name] = _written[-1][1]
        return out

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.held.pop(name)
            drop_path(self.spark, path)
            _written.remove((self.spark, path))


def trimmed(fn: Callable) -> Callable:
    """A function for mapInArrow that gives memory back when its task ends: workers stay and wait for the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        pa.default_memory_pool().release_unused()
        libc = ctypes.util.find_library("c")
        trim = getattr(ctypes.CDLL(libc), "malloc_trim", None) if libc else None
        if trim is not None:
            trim(0)

    return run


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose text column stays near the limit; a longer row is a part of its own."""
    text = batch.column(column)
    sizes = [0 if x is None else x for x in pc.binary_length(text).to_pylist()]
    start = held = 0
    for i, n in enumerate(sizes):
        if held and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield batch.slice(start)


def map_text(df: DataFrame, schema: str, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], column: str = "text") -> DataFrame:
    """mapInArrow over bounded slices of the batches."""

    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column):
                out = fn(part)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(trimmed(run), schema)


def with_rank(df: DataFrame, order: list[Column], name: str, label: str) -> DataFrame:
    """Add the row's place (from 0) in the whole order, without ever sorting in one task.

    Rows are range-partitioned and sorted; the place is the place within the partition plus the
    rows of the partitions before it, of which there are as many as shuffle partitions.
    """
    placed = staged(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_mid", F.monotonically_increasing_id()), label)
    part, within = F.shiftright("_mid", 33), F.col("_mid").bitwiseAND((1 << 33) - 1)
    counts = sorted((r["p"], r["n"]) for r in placed.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    before, starts = 0, []
    for p, n in counts:
        starts.append((p, before))
        before += n
    if not starts:
        return placed.withColumn(name, F.col("_mid")).drop("_mid")
    offsets = df.sparkSession.createDataFrame(starts, "_part long, _before long")
    return placed.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + within).drop("_mid", "_part", "_before")


#: Bits of the filter that `maybe_in` sends to the executors: 1 MB, whatever the tables' size.
FILTER_BITS = 1 << 23


def maybe_in(df: DataFrame, column: str, wanted: DataFrame, key: str) -> DataFrame:
    """The rows of df whose column may be among wanted's keys: all that are, and few others as long as the
    keys are few against FILTER_BITS. It spares a shuffle rows that the join after it would drop; a
    full filter lets all rows through, and the join still decides. Integers of any width are compared as long ones;
    keys of two other types, which a join would have to cast, are not filtered."""
    spark = df.sparkSession
    ship(spark)
    whole = {"tinyint", "smallint", "int", "bigint"}
    kinds = dict(df.dtypes)[column], dict(wanted.dtypes)[key]
    if kinds[0] != kinds[1] and not whole.issuperset(kinds):
        return df
    plain = lambda c: F.col(c).cast("long") if whole.issuperset(kinds) else F.col(c)
    place = F.pmod(F.xxhash64(plain(key)), F.lit(FILTER_BITS))
    words = wanted.select(place.alias("p")).groupBy((F.col("p") / 64).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 AS int))")).alias("bits"))
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    for w, b in words.collect():  # at most FILTER_BITS / 64 rows
        bits[w] = b
    shared = spark.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def held(p: pd.Series) -> pd.Series:
        at = p.to_numpy()
        return pd.Series((shared.value[at >> 6] >> (at & 63)) & 1 == 1)

    return df.filter(held(F.pmod(F.xxhash64(plain(column)), F.lit(FILTER_BITS))))
