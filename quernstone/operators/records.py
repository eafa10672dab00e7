"""Smaller record operators: path sets, diff statistics, choices, deletions, nearness in time, archiving, ticks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import WIRE_SQL, table, wire


def q_file_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracked paths without deleted ones, and untracked ones."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    return d.filter("doc_id % 3 = 0").exceptAll(d.filter("doc_id % 6 = 0")).union(d.filter("doc_id % 7 = 0")).distinct()


def q_numstat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines "added<tab>deleted<tab>path", "-" being 0: totals and files by status."""
    d = table(spark, sf_dir, "documents").select(F.concat_ws("\t", F.when(F.col("n_chars") % 11 == 0, "-").otherwise((F.col("n_chars") % 5).cast("string")), (F.col("doc_id") % 3).cast("string"), "source").alias("line"))
    parts = F.split("line", "\t")
    n = lambda i: F.coalesce(F.get(parts, F.lit(i)).try_cast("long"), F.lit(0))
    rows = d.select(n(0).alias("added"), n(1).alias("deleted"))
    status = F.when((F.col("deleted") == 0) & (F.col("added") > 0), "added").when((F.col("added") == 0) & (F.col("deleted") > 0), "deleted").otherwise("modified")
    return rows.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("files"), F.sum("added").alias("added"), F.sum("deleted").alias("deleted"))


def q_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last <choice> of a text."""
    text = F.concat(F.lit("<choice>"), "source", F.lit("</choice> or <choice> "), "lang", F.lit(" </choice>"))
    return table(spark, sf_dir, "documents").select("doc_id", F.trim(F.element_at(F.regexp_extract_all(text, F.lit("<choice>([^<]*)</choice>")), -1)).alias("choice"))


def q_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words with up to two letters left out, and themselves."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("term")).distinct()
    left = lambda t: F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.length(t))))
    one = words.select("term", F.explode(F.array_distinct(F.concat(F.array("term"), left(F.col("term"))))).alias("v"))
    two = F.when(F.length("v") > 0, F.concat(F.array("v"), left(F.col("v")))).otherwise(F.array("v"))
    return one.select("term", F.explode(two).alias("variant")).distinct()


def q_near_in_time(spark: SparkSession, sf_dir: str, hours: float = 48.0, most: int = 5) -> DataFrame:
    """Of each user the events nearest to the first purchase, within hours."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    anchor = e.filter("event_type = 'purchase'").groupBy("user_id").agg(F.min_by("t", "event_id").alias("a"))
    near = e.join(anchor, "user_id").withColumn("d", F.abs(F.col("t") - F.col("a"))).filter(F.col("d") <= hours * 3600)
    order = Window.partitionBy("user_id").orderBy("d", "event_id")
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most).select("user_id", "rank", "event_id", F.round("d", 3).alias("seconds"))


def q_compact_half(spark: SparkSession, sf_dir: str, most: int = 60) -> DataFrame:
    """Steps of users with more than `most`: the older half is compacted."""
    w = Window.partitionBy("user_id")
    e = table(spark, sf_dir, "events").withColumn("n", F.count(F.lit(1)).over(w)).withColumn("r", F.row_number().over(w.orderBy("event_id")))
    return e.select("user_id", "event_id", ((F.col("n") > most) & (F.col("r") <= F.floor(F.col("n") / 2))).alias("compacted"))


def q_archive(spark: SparkSession, sf_dir: str, days: int = 15) -> DataFrame:
    """Users whose last event is whole days ago, counted from the newest of all."""
    last = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max(F.unix_micros(F.col("ts").cast("timestamp"))).alias("last"))
    newest = last.agg(F.max("last").alias("now"))  # one row
    return last.crossJoin(F.broadcast(newest)).select("user_id", (F.floor((F.col("now") - F.col("last")) / 86_400_000_000) >= days).alias("archive"))


def q_large_items(spark: SparkSession, sf_dir: str, share: float = 5.0, most: int = 10) -> DataFrame:
    """Documents of more than a share of their source, the ten largest."""
    d = table(spark, sf_dir, "documents")
    total = d.groupBy("source").agg(F.sum("n_chars").alias("all"))
    big = d.join(F.broadcast(total), "source").filter(100 * F.col("n_chars") > share * F.col("all"))  # a row a source
    return big.orderBy(F.desc("n_chars"), "doc_id").limit(most).select("doc_id", "source", "n_chars")


def q_preserve_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many turns compaction keeps as they are: one, and one more each if the last message of user or assistant tells of an error, holds thoughts, or names over two files."""
    said = table(spark, sf_dir, "conversations").filter(F.col("role").isin("user", "assistant"))
    m = said.groupBy("conv_id").agg(F.max_by("text", "turn").alias("text"), F.max("turn").alias("turn"))
    dirty = F.concat("text", F.when(F.col("conv_id") % 3 == 0, " It FAILED").otherwise(""), F.when(F.col("conv_id") % 4 == 0, " a.py b.md file:c").otherwise(" a.py b.md"))
    low, think = F.lower(dirty), F.col("conv_id") % 5 == 0
    refs = F.regexp_count(low, F.lit(r"file:|\.py|\.md"))
    depth = 1 + low.rlike("error|exception|failed").cast("int") + think.cast("int") + (refs > 2).cast("int")
    return m.select("conv_id", F.greatest(F.lit(1), F.least(F.lit(10), depth)).alias("depth"))


def q_result_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of a session in the order of their first calls; those of unknown calls last, repeats marked."""
    e = wire(spark, sf_dir)
    call = e.filter("type = 'ToolCall'").groupBy("session_id", "call_id").agg(F.min("idx").alias("call_at"))
    r = e.filter("type = 'ToolResult'").join(call, ["session_id", "call_id"], "left")
    order = Window.partitionBy("session_id").orderBy(F.col("call_at").asc_nulls_last(), "idx")
    again = F.row_number().over(Window.partitionBy("session_id", "call_id").orderBy("idx")) > 1
    return r.select("session_id", "idx", F.row_number().over(order).alias("position"), again.alias("repeated"))


def q_ticks(spark: SparkSession, sf_dir: str, ticks: int = 12) -> DataFrame:
    """Events of each session by twelfths of its time."""
    e = wire(spark, sf_dir)
    w = Window.partitionBy("session_id")
    lo, hi = F.min("ts").over(w), F.max("ts").over(w)
    bucket = F.when(hi > lo, F.least(F.lit(ticks - 1), F.floor((F.col("ts") - lo) / (hi - lo) * ticks))).otherwise(0).cast("long")
    return e.select("session_id", bucket.alias("tick")).groupBy("session_id", "tick").agg(F.count(F.lit(1)).alias("events"))


def q_groups_other_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages by newest document, what has none being Other and last."""
    d = table(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 9 == 0, "Other").otherwise(F.col("lang")).alias("dir"), "doc_id")
    g = d.groupBy("dir").agg(F.max("doc_id").alias("newest"), F.count(F.lit(1)).alias("n"))
    return g.withColumn("position", F.row_number().over(Window.orderBy(F.col("dir") == "Other", F.desc("newest"))))  # a row a language


QUERIES = {
    "s05_file_set": q_file_set, "g16_numstat": q_numstat, "c27_last_choice": q_choice, "c12_deletes": q_deletes, "j20_near_in_time": q_near_in_time, "t13_compact_half": q_compact_half, "b20_auto_archive": q_archive,
    "t10_large_items": q_large_items, "c31_preserve_depth": q_preserve_depth, "j22_result_order": q_result_order, "w20_ticks": q_ticks, "g26_groups_other_last": q_groups_other_last,
}
ORACLES = {
    "s05_file_set": "SELECT doc_id FROM documents WHERE doc_id % 3 = 0 AND doc_id % 6 <> 0 UNION SELECT doc_id FROM documents WHERE doc_id % 7 = 0",
    "g16_numstat": "WITH r AS (SELECT CASE WHEN n_chars % 11 = 0 THEN 0 ELSE n_chars % 5 END AS a, doc_id % 3 AS d FROM documents) SELECT CASE WHEN d = 0 AND a > 0 THEN 'added' WHEN a = 0 AND d > 0 THEN 'deleted' ELSE 'modified' END AS status, count(*) AS files, CAST(sum(a) AS BIGINT) AS added, CAST(sum(d) AS BIGINT) AS deleted FROM r GROUP BY 1",
    "c27_last_choice": "SELECT doc_id, trim(regexp_extract_all('<choice>' || source || '</choice> or <choice> ' || lang || ' </choice>', '<choice>([^<]*)</choice>', 1)[-1]) AS choice FROM documents",
    "c12_deletes": "WITH w AS (SELECT DISTINCT term FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM benchmark)), o AS (SELECT term, unnest(list_concat([term], list_transform(range(1, length(term) + 1), lambda i: left(term, i - 1) || substring(term, i + 1)))) AS v FROM w) SELECT DISTINCT term, unnest(list_concat([v], list_transform(range(1, length(v) + 1), lambda i: left(v, i - 1) || substring(v, i + 1)))) AS variant FROM o",
    "j20_near_in_time": "WITH e AS (SELECT *, epoch_us(ts) / 1000000.0::DOUBLE AS t FROM events), a AS (SELECT user_id, min_by(t, event_id) AS a FROM e WHERE event_type = 'purchase' GROUP BY 1), n AS (SELECT user_id, event_id, abs(t - a) AS d FROM e JOIN a USING (user_id) WHERE abs(t - a) <= 172800), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY d, event_id) AS rank FROM n) SELECT user_id, rank, event_id, round(d, 3) AS seconds FROM r WHERE rank <= 5",
    "t13_compact_half": "SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id) > 60 AND row_number() OVER (PARTITION BY user_id ORDER BY event_id) <= count(*) OVER (PARTITION BY user_id) // 2 AS compacted FROM events",
    "b20_auto_archive": "WITH l AS (SELECT user_id, max(epoch_us(ts)) AS last FROM events GROUP BY 1) SELECT user_id, ((SELECT max(last) FROM l) - last) // 86400000000 >= 15 AS archive FROM l",
    "t10_large_items": "WITH t AS (SELECT source, sum(n_chars) AS total FROM documents GROUP BY 1) SELECT doc_id, d.source, n_chars FROM documents d JOIN t ON d.source = t.source WHERE 100 * n_chars > 5 * total ORDER BY n_chars DESC, doc_id LIMIT 10",
    "c31_preserve_depth": r"WITH m AS (SELECT conv_id, arg_max(text, turn) AS text FROM conversations WHERE role IN ('user', 'assistant') GROUP BY 1), d AS (SELECT conv_id, lower(text || CASE WHEN conv_id % 3 = 0 THEN ' It FAILED' ELSE '' END || CASE WHEN conv_id % 4 = 0 THEN ' a.py b.md file:c' ELSE ' a.py b.md' END) AS t FROM m) SELECT conv_id, 1 + regexp_matches(t, 'error|exception|failed')::INT + (conv_id % 5 = 0)::INT + (len(regexp_extract_all(t, 'file:|\.py|\.md')) > 2)::INT AS depth FROM d",
    "j22_result_order": f"WITH {WIRE_SQL}, c AS (SELECT session_id, call_id, min(idx) AS call_at FROM wire WHERE type = 'ToolCall' GROUP BY ALL) SELECT session_id, idx, row_number() OVER (PARTITION BY session_id ORDER BY call_at NULLS LAST, idx) AS position, row_number() OVER (PARTITION BY session_id, call_id ORDER BY idx) > 1 AS repeated FROM wire LEFT JOIN c USING (session_id, call_id) WHERE type = 'ToolResult'",
    "w20_ticks": f"WITH {WIRE_SQL}, b AS (SELECT session_id, ts, min(ts) OVER (PARTITION BY session_id) AS lo, max(ts) OVER (PARTITION BY session_id) AS hi FROM wire) SELECT session_id, CAST(CASE WHEN hi > lo THEN least(11, floor((ts - lo) / (hi - lo) * 12)) ELSE 0 END AS BIGINT) AS tick, count(*) AS events FROM b GROUP BY ALL",
    "g26_groups_other_last": "WITH g AS (SELECT CASE WHEN doc_id % 9 = 0 THEN 'Other' ELSE lang END AS dir, max(doc_id) AS newest, count(*) AS n FROM documents GROUP BY 1) SELECT *, row_number() OVER (ORDER BY dir = 'Other', newest DESC) AS position FROM g",
}
