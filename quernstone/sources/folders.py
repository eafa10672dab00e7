"""Stores of sessions in folders as a data source, and logs and histories kept as versions.

The store holds a folder for each project, in it one for each session, in it JSON-lines logs. The source plans a partition for each slice of a project's sessions and
lists nothing below projects that a filter excludes; hidden folders and those of `PRUNED` names are passed by wherever they are.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from ..plans.shipping import ship
from ..plans.staging import new_path
from .snapshots import Snapshots
from .tables import table

# Folders that are passed by.
PRUNED = frozenset({"node_modules", "__pycache__", "venv", "build", "dist", "target"})
SCHEMA = "project string, session string, file string, line int, role string, content string"
#: Sessions of a partition.
SLICE = 256


def file_system(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system and the path in it; what pyarrow has no name for goes to Hadoop's library."""
    scheme, colon, rest = uri.partition("://")
    if not colon or scheme in ("file", "hdfs", "viewfs", "gs", "abfs", "abfss", "s3"):
        return pyarrow.fs.FileSystem.from_uri(uri if colon else f"file://{uri.removeprefix('file:')}")
    if scheme in ("s3a", "s3n"):
        return pyarrow.fs.FileSystem.from_uri(f"s3://{rest}")
    host, slash, path = rest.partition("/")
    return pyarrow.fs.HadoopFileSystem(f"{scheme}://{host}"), slash + path


def kept(name: str) -> bool:
    return not name.startswith((".", "_")) and name not in PRUNED


def inside(fs: pyarrow.fs.FileSystem, path: str, kind: pyarrow.fs.FileType) -> list[str]:
    """Names of the folders or files in a folder that aren't passed by, sorted."""
    found = fs.get_file_info(pyarrow.fs.FileSelector(path, allow_not_found=True))
    return sorted(f.base_name for f in found if f.type == kind and kept(f.base_name))


class Sessions(InputPartition):
    def __init__(self, project: str, sessions: list[str]):
        self.project, self.sessions = project, sessions


class StoreReader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.projects, self.sessions = path, None, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes equality and lists of values of project and session; the rest is Spark's."""
        for f in filters:
            column = f.attribute[0] if isinstance(f, EqualTo | In) and len(f.attribute) == 1 else None
            if column not in ("project", "session"):
                yield f
                continue
            values = set(f.value) if isinstance(f, In) else {f.value}
            held = getattr(self, f"{column}s")
            setattr(self, f"{column}s", values if held is None else held & values)

    def partitions(self) -> list[InputPartition]:
        fs, root = file_system(self.path)
        out = []
        for project in inside(fs, root, pyarrow.fs.FileType.Directory):
            if self.projects is None or project in self.projects:
                names = [s for s in inside(fs, f"{root}/{project}", pyarrow.fs.FileType.Directory) if self.sessions is None or s in self.sessions]
                out += [Sessions(project, names[i : i + SLICE]) for i in range(0, len(names), SLICE)]
        return out or [Sessions("", [])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        fs, root = file_system(self.path)
        for session in partition.sessions:
            base = f"{root}/{partition.project}/{session}"
            for name in inside(fs, base, pyarrow.fs.FileType.File):
                if not name.endswith((".jsonl", ".json", ".txt")):
                    continue
                with fs.open_input_stream(f"{base}/{name}") as f:
                    lines = f.read().decode("utf-8", "replace").split("\n")
                for number, line in enumerate(lines, 1):
                    try:
                        row = json.loads(line) if line.strip() else None
                    except ValueError:  # a line that a writer left half way
                        continue
                    if isinstance(row, dict):
                        role, content = row.get("role"), row.get("content")
                        yield partition.project, session, name, number, role if isinstance(role, str) else None, content if isinstance(content, str) or content is None else json.dumps(content)


class SessionStore(DataSource):
    """spark.read.format("session_store").load(path)."""

    @classmethod
    def name(cls) -> str:
        return "session_store"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return StoreReader(self.options["path"])


def read_store(spark: SparkSession, path: str) -> DataFrame:
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SessionStore)
    return spark.read.format("session_store").load(path)


def write_store(rows: DataFrame, path: str, name: str = "log.jsonl") -> int:
    """Write rows (project, session, turn, value) as a store: the tasks write each session's lines by turn to its file, and nothing passes through the driver.

    A file is written under a hidden name and then takes its own, so that a task that runs again leaves the same. Returns the number of files."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(path)
        now, out, made, draft = None, None, 0, ""

        def close() -> None:
            out.close()
            fs.move(draft, f"{root}/{now[0]}/{now[1]}/{name}")

        for batch in batches:
            for project, session, value in zip(*(batch.column(c).to_pylist() for c in ("project", "session", "value"))):
                if (project, session) != now:
                    if out is not None:
                        close()
                    now, made = (project, session), made + 1
                    fs.create_dir(f"{root}/{project}/{session}", recursive=True)
                    draft = f"{root}/{project}/{session}/.{uuid.uuid4().hex}"
                    out = fs.open_output_stream(draft)
                out.write(value.encode("utf-8", "replace") + b"\n")
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([made], pa.int64())], ["files"])

    dealt = rows.repartition("project", "session").sortWithinPartitions("project", "session", "turn").select("project", "session", "value")
    return dealt.mapInArrow(run, "files long").agg(F.sum("files")).first()[0] or 0


class Log:
    """Rows in the order in which they were appended; an append is there as a whole or not at all."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.snapshots, self.schema = spark, Snapshots(spark, path), schema

    def append(self, rows: DataFrame, *order: str) -> None:
        path = self.snapshots.new_name("rows")
        rows.repartitionByRange(*order).sortWithinPartitions(*order).write.json(path)
        self.snapshots.change(lambda m: m | {"parts": [*m.get("parts", []), path]})

    def clear(self) -> None:
        """An empty version; readers of an older one keep it until it is swept."""
        self.snapshots.change(lambda m: m | {"parts": []})

    def read(self, version: int | None = None) -> DataFrame:
        """The rows with _part, the number of their append."""
        out = self.spark.createDataFrame([], f"{self.schema}, _part int")
        for k, path in enumerate(self.snapshots.read(version).get("parts", [])):
            out = out.unionByName(self.spark.read.schema(self.schema).json(path).withColumn("_part", F.lit(k)))
        return out


def q_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations appended to a linear log by role, each append in order; what is read has the place of its append."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    log = Log(spark, new_path(spark, "linear"), "conv_id long, turn long, role string, text string")
    for role in ("user", "assistant", "system"):
        log.append(c.filter(F.col("role") == role), "conv_id", "turn")
    return log.read().select("_part", "conv_id", "turn", F.md5(F.col("text").cast("binary")).alias("digest")).withColumnRenamed("_part", "part")


def q_history_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A history saved, cleared and saved again while a writer dies between its data and its commit: what each version loads."""
    c = table(spark, sf_dir, "conversations").filter("role <> 'system'").select("conv_id", "turn", "role", "text")
    log = Log(spark, new_path(spark, "history"), "conv_id long, turn long, role string, text string")
    log.append(c.filter("role = 'user'"), "conv_id", "turn")
    c.write.json(log.snapshots.new_name("rows"))  # a writer that dies here
    log.append(c.filter("role = 'assistant'"), "conv_id", "turn")
    log.clear()
    log.append(c, "conv_id", "turn")
    out = None
    for version in range(1, log.snapshots.version() + 1):
        one = log.read(version).groupBy("role").agg(F.count(F.lit(1)).alias("turns"), F.sum(F.length("text")).alias("characters")).select(F.lit(version).alias("version"), "role", "turns", "characters")
        out = one if out is None else out.unionByName(one)
    return out


def q_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written as a store of folders, some of them to be passed by, and read again from it: sessions of two projects."""
    path = new_path(spark, "store")
    c = table(spark, sf_dir, "conversations")
    number = F.col("conv_id") % 7
    project = F.when(number == 6, "node_modules").otherwise(F.concat(F.lit("p"), number.cast("string")))
    line = F.to_json(F.struct(F.col("role").alias("role"), F.col("text").alias("content")))
    write_store(c.select(project.alias("project"), F.col("conv_id").cast("string").alias("session"), "turn", line.alias("value")), path)
    found = read_store(spark, path).filter(F.col("project").isin("p1", "p3", "node_modules"))
    return found.groupBy("project", "session").agg(F.count(F.lit(1)).alias("messages"), F.count_if(F.col("role") == "user").alias("turns"), F.sum(F.length("content")).alias("characters"))


QUERIES = {"a07_linear_log": q_linear, "a08_history_versions": q_history_versions, "a15_session_store": q_store}
ORACLES = {
    "a07_linear_log": "SELECT CASE role WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 ELSE 2 END AS part, conv_id, turn, md5(text) AS digest FROM conversations",
    "a08_history_versions": "WITH c AS (SELECT role, count(*) AS turns, CAST(sum(length(text)) AS BIGINT) AS characters FROM conversations WHERE role <> 'system' GROUP BY 1) SELECT v.version, c.* FROM c JOIN (VALUES (1, 'user'), (2, 'user'), (2, 'assistant'), (4, 'user'), (4, 'assistant')) v(version, role) ON v.role = c.role",
    "a15_session_store": "SELECT 'p' || conv_id % 7 AS project, CAST(conv_id AS VARCHAR) AS session, count(*) AS messages, count(*) FILTER (role = 'user') AS turns, CAST(sum(length(text)) AS BIGINT) AS characters FROM conversations WHERE conv_id % 7 IN (1, 3) GROUP BY 1, 2",
}
