"""Reading the engine's input tables and the wire view of the event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of an input, as the planner estimates them, up to which `spread` deals its rows anew.
SMALL = 512 << 20


def spread(df: DataFrame) -> DataFrame:
    """The same rows over all cores if the input is small: a small file may be one row group, which one task reads whole.

    Larger inputs have row groups for all cores and stay as they lie, so that no large table is shuffled for this.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, df.columns[0]) if size <= SMALL else df


#: The events table read as an agent's wire log: a session per user, one call id for every seven k.
WIRE_SQL = """
wire AS (
  SELECT user_id AS session_id, event_id AS idx, epoch_us(ts) / 1000000.0::DOUBLE AS ts,
    CASE WHEN event_type = 'signup' THEN 'TurnBegin' WHEN event_type = 'view' AND value < 10 THEN 'TurnEnd'
         WHEN event_type = 'view' THEN 'StepBegin' WHEN event_type = 'click' THEN 'ToolCall'
         WHEN event_type = 'purchase' THEN 'ToolResult' WHEN value < 3 THEN 'StepInterrupted' ELSE 'StatusUpdate' END AS type,
    'c' || CAST(k % 7 AS VARCHAR) AS call_id, 'tool' || CAST(k % 5 AS VARCHAR) AS tool, k % 4 = 0 AS is_error,
    k AS tokens_in, k // 10 AS tokens_out
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))
"""


def wire(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session_id, idx, ts (seconds), type, call_id, tool, is_error, tokens_in, tokens_out."""
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    kind, value = F.col("event_type"), F.col("value")
    named = (
        F.when(kind == "signup", "TurnBegin")
        .when((kind == "view") & (value < 10), "TurnEnd")
        .when(kind == "view", "StepBegin")
        .when(kind == "click", "ToolCall")
        .when(kind == "purchase", "ToolResult")
        .when(value < 3, "StepInterrupted")
        .otherwise("StatusUpdate")
    )
    return e.select(
        F.col("user_id").alias("session_id"),
        F.col("event_id").alias("idx"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"),
        named.alias("type"),
        F.concat(F.lit("c"), (F.col("k") % 7).cast("string")).alias("call_id"),
        F.concat(F.lit("tool"), (F.col("k") % 5).cast("string")).alias("tool"),
        (F.col("k") % 4 == 0).alias("is_error"),
        F.col("k").alias("tokens_in"),
        F.floor(F.col("k") / 10).alias("tokens_out"),
    )
