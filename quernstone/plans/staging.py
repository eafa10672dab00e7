"""Folders and lineage: where intermediate tables are written, and how an iteration's plan is cut."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir or of the context; where none is set, a temporary one in local mode and an error on a cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = found.get() if found.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        made = tempfile.mkdtemp(prefix="quernstone-")
        atexit.register(shutil.rmtree, made, True)
        root = f"file://{made}"
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(root)
    return root


def new_path(spark: SparkSession, label: str) -> str:
    return f"{folder(spark).rstrip('/')}/quernstone-{uuid.uuid4().hex}-{label}"


def cut(df: DataFrame) -> DataFrame:
    """The same rows with no plan behind them, kept in the checkpoint folder."""
    folder(df.sparkSession)
    return df.checkpoint()


def kept(df: DataFrame) -> DataFrame:
    """As `cut`, by a table in that folder: the last stage runs once (a checkpoint counts first, then runs it again), and the planner knows the size."""
    path = new_path(df.sparkSession, "kept")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
