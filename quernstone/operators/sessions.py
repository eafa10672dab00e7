"""Conversations and sessions: turns, compaction, grouping, pages; and a dependency graph by levels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.text import token_estimate
from ..plans.staging import cut
from ..sources.tables import table


def in_conversation() -> WindowSpec:
    return Window.partitionBy("conv_id").orderBy("turn")


def so_far() -> WindowSpec:
    return in_conversation().rowsBetween(Window.unboundedPreceding, 0)


def q_user_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages numbered by the user message that they follow."""
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", F.sum((F.col("role") == "user").cast("long")).over(so_far()).alias("user_turn"))


def q_merge_adjacent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of messages of one role as one message."""
    c = table(spark, sf_dir, "conversations")
    new = F.coalesce((F.col("role") != F.lag("role").over(in_conversation())).cast("int"), F.lit(1))
    c = c.withColumn("new", new).withColumn("part", F.sum("new").over(so_far()))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n")
    return c.groupBy("conv_id", "part", "role").agg(F.min("turn").alias("first_turn"), F.count(F.lit(1)).alias("messages"), F.md5(joined.cast("binary")).alias("digest")).drop("part")


def q_preserve(spark: SparkSession, sf_dir: str, n: int = 2) -> DataFrame:
    """What compaction keeps: the last n user or assistant messages and the first of all; nothing is compacted with fewer than n."""
    c = table(spark, sf_dir, "conversations")
    talk = F.col("role").isin("user", "assistant")
    back = F.sum(talk.cast("long")).over(Window.partitionBy("conv_id").orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum(talk.cast("long")).over(Window.partitionBy("conv_id"))
    kept = (F.col("back") <= n - 1) | ((F.col("back") == n) & talk) | (F.col("total") < n) | (F.col("turn") == F.min("turn").over(Window.partitionBy("conv_id")))
    return c.withColumn("back", back).withColumn("total", total).select("conv_id", "turn", kept.alias("kept"))


def q_auto_compact(spark: SparkSession, sf_dir: str, most: int = 600, ratio: float = 0.85, reserved: int = 100) -> DataFrame:
    """Whether a conversation's tokens reach the ratio of the limit, or with the reserve the limit."""
    sums = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sum(token_estimate(F.col("text"))).alias("tokens"))
    return sums.withColumn("compact", (F.col("tokens") >= F.lit(most * ratio)) | (F.col("tokens") + reserved >= most))


def q_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns, messages and the topic: the first user message, cut."""
    user = F.col("role") == "user"
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count_if(user).alias("turns"), F.count(F.lit(1)).alias("messages"), F.substring(F.min_by(F.when(user, F.col("text")), F.when(user, F.col("turn"))), 1, 40).alias("topic"))


def q_project_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by source in order of first appearance; the unnamed as one group."""
    d = table(spark, sf_dir, "documents").select(F.coalesce("source", F.lit("Unknown")).alias("project"), "doc_id", "n_chars")
    return d.groupBy("project").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("sessions"), F.sum("n_chars").alias("bytes"))


def q_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose text or source holds a word, newest first, a page of 100."""
    d = table(spark, sf_dir, "documents")
    return d.filter(F.lower("text").contains("shthe") | F.col("source").contains("src7")).orderBy(F.desc("doc_id")).limit(100).select("doc_id", "source")


def q_ring(spark: SparkSession, sf_dir: str, most: int = 50) -> DataFrame:
    """Each user's newest events, a bounded number."""
    order = Window.partitionBy("user_id").orderBy(F.desc("event_id"))
    return table(spark, sf_dir, "events").withColumn("r", F.row_number().over(order)).filter(F.col("r") <= most).select("user_id", "event_id")


def q_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of names that differ only in case, the one of the first root."""
    d = table(spark, sf_dir, "documents").select(F.lower(F.substring("text", 1, 4)).alias("name"), "doc_id")
    order = Window.partitionBy("name").orderBy("doc_id")
    return d.withColumn("r", F.row_number().over(order)).filter("r = 1").select("name", "doc_id")


def q_todo_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lists joined by key: statuses of the newer, order of the older, new ones last."""
    d = table(spark, sf_dir, "labels")
    old, new = d.filter("doc_id % 3 <> 0").select("doc_id", F.col("quality").alias("old")), d.filter("doc_id % 2 = 0").select("doc_id", F.col("toxic").alias("new"))
    return old.join(new, "doc_id", "full").select("doc_id", F.coalesce("new", "old").alias("status"), F.col("old").isNull().alias("appended"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph of orders' nations: node depends on the nodes of half and a third its number."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node"))
    return n.filter("node > 0").select("node", F.explode(F.array_distinct(F.array(F.floor(F.col("node") / 2).cast("int"), F.floor(F.col("node") / 3).cast("int")))).alias("dep"))


def q_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topological levels: a node runs after all that it depends on. One join a level; what is left over is on a cycle."""
    e = edges(spark, sf_dir)
    nodes = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node"))
    level, done = 0, nodes.join(e.select("node").distinct(), "node", "left_anti").withColumn("level", F.lit(0))
    while True:
        level += 1
        open_ = e.join(done.select("node"), "node", "left_anti")
        blocked = open_.join(done.select(F.col("node").alias("dep")), "dep", "left_anti").select("node").distinct()
        ready = open_.select("node").distinct().join(blocked, "node", "left_anti").withColumn("level", F.lit(level))
        if ready.isEmpty():
            return done
        done = cut(done.unionByName(ready))


def q_failure_spread(spark: SparkSession, sf_dir: str, failed: int = 3) -> DataFrame:
    """Nodes that can't run because one that they depend on, directly or not, has failed."""
    e = edges(spark, sf_dir)
    hit = spark.createDataFrame([(failed,)], "node int")
    found, count = hit, 1
    while True:
        found = cut(found.unionByName(e.join(found.select(F.col("node").alias("dep")), "dep").select("node")).distinct())
        now = found.count()
        if now == count:
            return found.filter(F.col("node") != failed)
        count = now


_EST = r"CAST(CASE WHEN coalesce(length(text), 0) = 0 THEN 0 WHEN length(regexp_replace(text, '[^\x00-\x7F]', '', 'g')) / length(text) > 0.95 THEN greatest(1, length(text) // 4) ELSE floor(length(text) / 3.5) END AS BIGINT)"
_EDGES = "e AS (SELECT DISTINCT n_nationkey AS node, d AS dep FROM nation, unnest([n_nationkey // 2, n_nationkey // 3]) AS t(d) WHERE n_nationkey > 0)"
QUERIES = {
    "w12_user_turns": q_user_turns, "w13_merge_adjacent": q_merge_adjacent, "w14_preserve_last": q_preserve, "b19_auto_compact": q_auto_compact, "g17_overview": q_overview, "g10_project_groups": q_project_groups,
    "t08_session_page": q_page, "t12_bounded_ring": q_ring, "j18_first_wins": q_first_wins, "j16_todo_upsert": q_todo_upsert, "d03_topological_levels": q_levels, "d05_failure_spread": q_failure_spread,
}
ORACLES = {
    "w12_user_turns": "SELECT conv_id, turn, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS user_turn FROM conversations",
    "w13_merge_adjacent": "WITH n AS (SELECT *, CASE WHEN role = lag(role) OVER (PARTITION BY conv_id ORDER BY turn) THEN 0 ELSE 1 END AS c FROM conversations), p AS (SELECT *, sum(c) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS part FROM n) SELECT conv_id, role, min(turn) AS first_turn, count(*) AS messages, md5(string_agg(text, chr(10) ORDER BY turn)) AS digest FROM p GROUP BY conv_id, part, role",
    "w14_preserve_last": "WITH t AS (SELECT *, role IN ('user', 'assistant') AS talk FROM conversations), b AS (SELECT *, sum(talk::INT) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS back, sum(talk::INT) OVER (PARTITION BY conv_id) AS total, min(turn) OVER (PARTITION BY conv_id) AS first FROM t) SELECT conv_id, turn, back <= 1 OR (back = 2 AND talk) OR total < 2 OR turn = first AS kept FROM b",
    "b19_auto_compact": f"WITH s AS (SELECT conv_id, CAST(sum({_EST}) AS BIGINT) AS tokens FROM conversations GROUP BY 1) SELECT *, tokens >= 510 OR tokens + 100 >= 600 AS compact FROM s",
    "g17_overview": "SELECT conv_id, count(*) FILTER (role = 'user') AS turns, count(*) AS messages, left(min_by(text, turn) FILTER (role = 'user'), 40) AS topic FROM conversations GROUP BY 1",
    "g10_project_groups": "SELECT coalesce(source, 'Unknown') AS project, min(doc_id) AS first_id, count(*) AS sessions, CAST(sum(n_chars) AS BIGINT) AS bytes FROM documents GROUP BY 1",
    "t08_session_page": "SELECT doc_id, source FROM documents WHERE contains(lower(text), 'shthe') OR contains(source, 'src7') ORDER BY doc_id DESC LIMIT 100",
    "t12_bounded_ring": "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 50",
    "j18_first_wins": "SELECT lower(left(text, 4)) AS name, min(doc_id) AS doc_id FROM documents GROUP BY 1",
    "j16_todo_upsert": "SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, coalesce(toxic, quality) AS status, quality IS NULL AS appended FROM (SELECT doc_id, quality FROM labels WHERE doc_id % 3 <> 0) o FULL JOIN (SELECT doc_id, toxic FROM labels WHERE doc_id % 2 = 0) n ON o.doc_id = n.doc_id",
    "d03_topological_levels": f"WITH RECURSIVE {_EDGES}, l AS (SELECT 0 AS node, 0 AS level UNION SELECT e.node, l.level + 1 FROM e JOIN l ON e.dep = l.node) SELECT node, max(level) AS level FROM l GROUP BY node",
    "d05_failure_spread": f"WITH RECURSIVE {_EDGES}, f AS (SELECT 3 AS node UNION SELECT e.node FROM e JOIN f ON e.dep = f.node) SELECT node FROM f WHERE node <> 3",
}
