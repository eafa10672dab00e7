"""JSON-lines logs: lenient reading with a quarantine, appending, and index tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.staging import new_path
from .tables import table

SCHEMA = "role string, content string, token_count long, id long"


def parsed(lines: DataFrame, schema: str = SCHEMA) -> DataFrame:
    """value with its fields; faulty lines have `_bad` set, blank ones go."""
    row = F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return lines.filter(F.trim("value") != "").withColumn("row", row)


def read_log(spark: SparkSession, path: str, schema: str = SCHEMA) -> tuple[DataFrame, DataFrame]:
    """(rows, quarantine) of a JSONL file or folder; the header line of type metadata is no row."""
    rows = parsed(spark.read.text(path), schema)
    good = rows.filter("row._bad IS NULL AND coalesce(get_json_object(value, '$.type'), '') <> 'metadata'")
    return good.select("row.*").drop("_bad"), rows.filter("row._bad IS NOT NULL").select("value")


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def save_index(index, path: str) -> None:
    """The tables of a retrieval index; postings sorted by term, so that a lookup reads few row groups."""
    index.postings.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")
    index.lengths.write.mode("overwrite").parquet(f"{path}/lengths")


def load_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/lengths")


def q_lenient_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event properties read as log lines, one in ten broken: good and faulty ones by type."""
    lines = table(spark, sf_dir, "events").select("event_type", F.when(F.col("event_id") % 10 == 0, F.substring("props", 1, 5)).otherwise(F.col("props")).alias("value"))
    rows = parsed(lines, "k long")
    return rows.groupBy("event_type").agg(F.count_if(F.col("row._bad").isNull()).alias("good"), F.count_if(F.col("row._bad").isNotNull()).alias("faulty"), F.sum(F.when(F.col("row._bad").isNull(), F.col("row.k"))).alias("k"))


QUERIES = {"a03_lenient_json": q_lenient_json}
ORACLES = {"a03_lenient_json": "SELECT event_type, count(*) FILTER (event_id % 10 <> 0) AS good, count(*) FILTER (event_id % 10 = 0) AS faulty, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) FILTER (event_id % 10 <> 0) AS BIGINT) AS k FROM events GROUP BY event_type"}


def append_wire(rows: DataFrame, path: str, version: int = 1) -> None:
    """Append records to a wire log; a new log gets its header line first."""
    spark = rows.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        spark.createDataFrame([("metadata", version)], "type string, protocol_version int").coalesce(1).write.json(path)
    rows.write.mode("append").json(path)


def read_wire(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The records of a wire log; the header is none."""
    return spark.read.schema(f"{schema}, protocol_version int").json(path).filter("protocol_version IS NULL").drop("protocol_version")


class History:
    """Turns of conversations kept as a table; the index is made from them when it is asked, so that no evicted turn is in it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _exists(self) -> bool:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(target)

    def add(self, turns: DataFrame) -> None:
        """turn_id, role, text; only users' and assistants' turns with text are kept."""
        live = turns.filter(F.col("role").isin("user", "assistant") & (F.trim(F.coalesce("text", F.lit(""))) != ""))
        live.select("turn_id", "role", "text").write.mode("append").parquet(self.path)

    def load(self) -> DataFrame:
        return self.spark.read.parquet(self.path) if self._exists() else self.spark.createDataFrame([], "turn_id long, role string, text string")

    def clear(self) -> None:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)

    def search(self, queries: DataFrame, k: int = 3) -> DataFrame:
        """qid, rank, doc_id (the turn), score."""
        from ..operators.retrieval import Index, query_terms

        return Index(self.load().select(F.col("turn_id").alias("doc_id"), "text"), dense=True).best(query_terms(queries), k)


def q_log_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations appended to a context log in two parts and read again, with usage rows between."""
    path = new_path(spark, "context")
    c = table(spark, sf_dir, "conversations").select("role", F.col("text").alias("content"), F.lit(None).cast("long").alias("token_count"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"))
    append_log(c.filter("id % 2 = 0"), path)
    append_log(c.filter("id % 2 = 1"), path)
    append_log(c.filter("id % 10 = 0").select(F.lit("_usage").alias("role"), F.lit(None).cast("string").alias("content"), F.length("content").cast("long").alias("token_count"), "id"), path)
    rows, _ = read_log(spark, path)
    return rows.select("id", "role", "token_count", F.md5(F.col("content").cast("binary")).alias("digest"))


def q_wire_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events appended to a wire log twice, its header skipped."""
    path = new_path(spark, "wire")
    e = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("type"))
    append_wire(e.filter("event_id % 2 = 0"), path)
    append_wire(e.filter("event_id % 2 = 1"), path)
    return read_wire(spark, path, "event_id long, type string")


QUERIES |= {"a04_context_round_trip": q_log_round_trip, "a06_wire_round_trip": q_wire_round_trip}
_GRAMS = r"""docs AS (SELECT doc_id, lower(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS t FROM documents WHERE text IS NOT NULL), tok AS (SELECT doc_id, unnest(CASE WHEN length(t) >= 3 THEN list_transform(range(1, length(t) - 1), lambda i: c[i] || c[i+1] || c[i+2]) WHEN length(t) > 0 THEN [t] ELSE [] END) AS term FROM (SELECT *, string_split(t, '') AS c FROM docs)),
lens AS (SELECT doc_id, CASE WHEN length(t) >= 3 THEN length(t) - 2 WHEN length(t) > 0 THEN 1 ELSE 0 END AS dl FROM docs), q AS (SELECT DISTINCT unnest(list_transform(range(1, length(t) - 1), lambda i: substring(t, i, 3))) AS term FROM (SELECT lower(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS t FROM benchmark))"""
ORACLES |= {
    "a04_context_round_trip": "WITH c AS (SELECT conv_id * 1000 + turn AS id, role, text FROM conversations) SELECT id, role, NULL::BIGINT AS token_count, md5(text) AS digest FROM c UNION ALL SELECT id, '_usage', length(text), NULL FROM c WHERE id % 10 = 0",
    "a06_wire_round_trip": "SELECT event_id, event_type AS type FROM events",
    "a01_a02_saved_index": f"WITH {_GRAMS}, p AS (SELECT term, doc_id, count(*) AS tf FROM tok SEMI JOIN q USING (term) GROUP BY ALL) SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf, CAST(sum(dl) AS BIGINT) AS length FROM p JOIN lens USING (doc_id) GROUP BY term",
}
