"""Stores of sessions, tasks, hooks and files: joins with defaults, predicates, filters, listings, exports.

Documents serve as sessions and files, events as tasks. Small rule lists (hooks, file kinds) are expressions, not joins.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import table
from .corpus import files, glob_pattern

# Names of sensitive files, of samples that aren't, and endings by kind of file.
SENSITIVE = (".env", ".env.*", "id_rsa", "id_ed25519", "id_ecdsa", ".aws/credentials", ".gcp/credentials", "credentials")
EXEMPT = (".env.example", ".env.sample", ".env.template")
KINDS = {"py": (".py",), "js": (".js", ".jsx", ".mjs", ".cjs"), "md": (".md", ".markdown"), "yaml": (".yaml", ".yml"), "html": (".html", ".htm", ".xhtml"), "docker": ("Dockerfile",), "make": ("Makefile", ".mk")}
#: Hooks: name pattern (empty: all), command.
HOOKS = (("", "log"), ("tool[02]", "audit"), ("^tool4$", "audit"), ("tool(", "broken"), ("agent", "log"), ("tool3", "check"))
TERMINAL = ("done", "failed", "killed", "lost")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def sensitive(path: Column) -> Column:
    """Files that are likely to hold secrets: by name, or by the end of the path."""
    name, found = base_name(path), F.lit(False)
    for pattern in SENSITIVE:
        if "/" in pattern:
            found = found | path.endswith(pattern) | path.contains("/" + pattern)
        else:
            found = found | name.rlike(glob_pattern(pattern))
    return ~name.isin(*EXEMPT) & found


def of_kind(path: Column, kind: str) -> Column:
    """Files of a kind by ending or whole name; of an unknown kind there are none."""
    found = F.lit(False)
    for end in KINDS.get(kind, ()):
        found = found | (path.endswith(end) if end.startswith(".") else base_name(path) == end)
    return found


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session, title, dir (null now and then), archived (null is no), bytes."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("session"), F.substring(F.regexp_replace("text", r"\s+", " "), 1, 40).alias("title"), F.when(F.col("doc_id") % 10 != 0, F.concat(F.lit("/Work/"), "source")).alias("dir"),
        F.when(F.col("doc_id") % 3 == 0, F.col("doc_id") % 2 == 0).alias("archived"), F.col("n_chars").alias("bytes"),
    )


def named(s: DataFrame, needle: str, trimmed: bool = True) -> Column:
    """Whether id, title or directory holds the words, without regard to case; nothing asked holds everywhere."""
    low = F.lower(F.lit(needle.strip() if trimmed else needle))
    fields = [F.col("session").cast("string"), F.col("title"), F.coalesce("dir", F.lit(""))]
    found = F.lit(not needle.strip() if trimmed else not needle)
    for f in fields:
        found = found | F.contains(F.lower(f), low)
    return found


def q_search_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that aren't archived with the words in title or directory."""
    s = sessions(spark, sf_dir)
    held = F.contains(F.lower("title"), F.lit("the")) | F.contains(F.lower(F.coalesce("dir", F.lit(""))), F.lit("the"))
    return s.filter(~F.coalesce("archived", F.lit(False)) & held).select("session", "title")


def q_explore(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sessions(spark, sf_dir)
    return s.select("session", named(s, "  SRC1 ").alias("explored"), named(s, "SRC1 ", trimmed=False).alias("picked"), named(s, "").alias("unasked"))


def q_session_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of a directory's sessions by time (newest first), size and name."""
    w = lambda *by: F.row_number().over(Window.partitionBy("dir").orderBy(*by, "session"))
    return sessions(spark, sf_dir).select("session", w(F.desc("session")).alias("by_time"), w(F.desc("bytes")).alias("by_size"), w(F.lower("title")).alias("by_name"))


def q_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions(spark, sf_dir).agg(F.count_distinct(F.coalesce("dir", F.lit("Unknown"))).alias("projects"), F.sum("bytes").alias("bytes"))


def q_titles(spark: SparkSession, sf_dir: str, width: int = 30) -> DataFrame:
    """A conversation's title: its first user message that isn't blank, cut; else Untitled."""
    said = (F.col("role") == "user") & (F.trim("text") != "")
    plain = F.trim(F.regexp_replace("text", r"\s+", " "))
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.min_by(F.when(said & (F.col("turn") > 0), plain), F.when(said & (F.col("turn") > 0), F.col("turn"))).alias("t"))
    return c.select("conv_id", F.coalesce(F.substring("t", 1, width), F.lit("Untitled")).alias("title"))


def q_user_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Message content as parts: nothing is none, a string one text part; texts joined by blanks, and without."""
    c = table(spark, sf_dir, "conversations")
    raw = F.when(F.col("turn") % 3 == 0, F.lit(None)).when(F.col("turn") % 3 == 1, F.to_json(F.array(F.struct(F.lit("text").alias("type"), F.substring("text", 1, 20).alias("text"))))).otherwise(
        F.to_json(F.array(F.struct(F.lit("text").alias("type"), F.substring("text", 1, 9).alias("text")), F.struct(F.lit("think").alias("type"), F.lit("x").alias("text")), F.struct(F.lit("text").alias("type"), F.substring("text", 11, 9).alias("text")))))
    plain = c.withColumn("content", F.when(F.col("turn") % 5 == 4, F.col("text")).otherwise(raw))
    parts = F.when(F.col("content").isNull(), F.array()).when(F.col("content").startswith("[{"), F.from_json("content", "array<struct<type string, text string>>")).otherwise(F.array(F.struct(F.lit("text").alias("type"), F.col("content").alias("text"))))
    texts = plain.select("conv_id", "turn", F.transform(F.filter(parts, lambda p: p["type"] == "text"), lambda p: p["text"]).alias("t"))
    return texts.select("conv_id", "turn", F.size("t").alias("parts"), F.array_join("t", " ").alias("spaced"), F.array_join("t", "").alias("joined"))


def q_cascade(spark: SparkSession, sf_dir: str, marker: str = "que") -> DataFrame:
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count_if(F.contains("text", F.lit(marker))).alias("depth"))


def q_context_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with the words by conversation; internal ones are hidden and counted."""
    internal = F.col("role") == "system"
    found = F.contains(F.lower("text"), F.lit("et "))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count_if(~internal & found).alias("found"), F.count_if(internal).alias("hidden"))


def q_step_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes with the words as they are written."""
    return table(spark, sf_dir, "conversations").filter(F.contains("text", F.lit("Et"))).select("conv_id", "turn")


def q_mentions(spark: SparkSession, sf_dir: str, offset: int = 3) -> DataFrame:
    """Options with the words, each placed behind the offset in order of name."""
    f = files(spark, sf_dir).filter(F.contains(F.lower("path"), F.lit("src1/")))
    return f.select("path", (F.row_number().over(Window.orderBy("path")) + offset - 1).alias("place"))  # few rows pass


def hooked(name: Column) -> Column:
    """The commands of the hooks that match a name, each once, in order of the hooks; a faulty pattern matches nothing."""
    out = F.array().cast("array<string>")
    for pattern, command in HOOKS:
        try:
            re.compile(pattern)
        except re.error:
            continue
        out = F.concat(out, F.when(F.lit(not pattern) | name.rlike(pattern or "^"), F.array(F.lit(command))).otherwise(F.array().cast("array<string>")))
    return F.array_join(F.array_distinct(out), ",")


def q_hooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    tools = table(spark, sf_dir, "events").select(F.concat(F.lit("tool"), (F.col("event_id") % 7).cast("string")).alias("tool"))
    return tools.groupBy("tool").agg(F.count(F.lit(1)).alias("calls")).select("tool", "calls", hooked(F.col("tool")).alias("commands"))


def tasks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Specs of tasks, and what runtime, control and consumer know of some of them."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "value", F.get_json_object("props", "$.k").cast("long").alias("k"))
    spec = e.select("id", F.col("id").cast("double").alias("created_at"), F.when(F.col("k") % 4 == 0, "agent").otherwise("command").alias("kind"))
    status = F.element_at(F.array(*map(F.lit, ("running", "done", "failed", "running", "starting"))), (F.col("k") % 5 + 1).cast("int"))
    runtime = e.filter("id % 3 <> 0").select("id", status.alias("status"), F.when(F.col("k") % 2 == 0, F.col("id") + F.col("k")).cast("double").alias("heartbeat_at"), F.when(F.col("k") % 3 == 0, F.col("id") + 1).cast("double").alias("started_at"), (F.col("id") + 0.5).alias("updated_at"))
    control = e.filter("id % 7 = 0").select("id", F.col("id").cast("double").alias("kill_requested_at"))
    return spec, runtime, control, e.filter("id % 5 = 0").select("id", F.col("k").alias("seen"))


def task_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Specs with the other sides; what a side lacks has its default."""
    spec, runtime, control, consumer = tasks(spark, sf_dir)
    view = spec.join(runtime, "id", "left").join(control, "id", "left").join(consumer, "id", "left")
    return view.withColumn("status", F.coalesce("status", F.lit("created"))).withColumn("seen", F.coalesce("seen", F.lit(0)))


def q_task_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return task_view(spark, sf_dir).select("id", "kind", "status", "seen", F.col("kill_requested_at").isNotNull().alias("kill_asked"))


def q_open_tasks(spark: SparkSession, sf_dir: str, most: int = 20) -> DataFrame:
    """Tasks that haven't ended, newest first, a bounded number."""
    return task_view(spark, sf_dir).filter(~F.col("status").isin(*TERMINAL)).orderBy(F.desc("id")).limit(most).select("id", "status")


def q_liveness(spark: SparkSession, sf_dir: str, stale: float = 500.0) -> DataFrame:
    """Status after recovery: agents are lost; other open tasks without progress for long are killed if that was asked, else lost."""
    view = task_view(spark, sf_dir)
    now = view.agg(F.max("created_at").alias("now"))  # one row
    last = F.coalesce("heartbeat_at", "started_at", "updated_at", "created_at")
    dead = F.when(F.col("kind") == "agent", "lost").when(F.col("now") - last <= stale, F.col("status")).when(F.col("kill_requested_at").isNotNull(), "killed").otherwise("lost")
    return view.crossJoin(F.broadcast(now)).select("id", F.when(F.col("status").isin(*TERMINAL), F.col("status")).otherwise(dead).alias("status"))


def q_publish(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notifications to be added: the first of each key that isn't known yet."""
    e = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") * 37 % 4001).alias("dedupe_key"))
    known = e.filter("event_id < 2000").select("dedupe_key")
    return e.filter("event_id >= 2000").join(known, "dedupe_key", "left_anti").groupBy("dedupe_key").agg(F.min("event_id").alias("event_id"))


def q_auto_recall(spark: SparkSession, sf_dir: str, least: float = 5.0) -> DataFrame:
    """Of each question's three best turns the best compacted one, if the question has ten characters and it scores enough."""
    from .retrieval import q_history, queries_of

    hits = q_history(spark, sf_dir).join(queries_of(spark, sf_dir).filter(F.length("text") >= 10).select("qid"), "qid", "left_semi")
    good = hits.filter((F.col("turn_id") % 2 == 0) & (F.col("score") >= least))
    return good.groupBy("qid").agg(F.min_by(F.struct("turn_id", "score"), "rank").alias("b")).select("qid", "b.turn_id", "b.score")


def q_session_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session files in two layouts, id/context.jsonl and id.jsonl: the older one counts only where the newer is missing, bad ids go."""
    d = table(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 11 == 0, "not-an-id").otherwise(F.col("doc_id").cast("string")).alias("id"), "doc_id")
    paths = d.filter("doc_id % 2 = 0").select(F.concat("id", F.lit("/context.jsonl")).alias("path")).union(d.filter("doc_id % 3 = 0").select(F.concat("id", F.lit(".jsonl")).alias("path")))
    found = paths.select("path", F.regexp_extract("path", r"^([0-9]+)(?:/context)?\.jsonl$", 1).alias("id"), F.contains("path", F.lit("/")).alias("new")).filter("id <> ''")
    new = found.filter("new")
    return new.unionByName(found.filter("NOT new").join(new.select("id"), "id", "left_anti")).select(F.col("id").cast("long").alias("id"), "path")


def q_store_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of a store, newest first; those that can't be read are skipped and counted."""
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 9 == 0, F.substring("props", 1, 4)).otherwise(F.col("props")).alias("raw"))
    read = e.withColumn("k", F.get_json_object("raw", "$.k").cast("long")).withColumn("skipped", F.count_if(F.col("k").isNull()).over(Window.partitionBy(F.col("event_id") % 50)))
    order = Window.partitionBy(F.col("event_id") % 50).orderBy(F.desc("event_id"))
    return read.filter("k IS NOT NULL").select("event_id", "k", "skipped", F.row_number().over(order).alias("position"))


def q_pruned_listing(spark: SparkSession, sf_dir: str, most: int = 5_000_000) -> DataFrame:
    """Files outside of version-control and build folders, up to a size."""
    f = files(spark, sf_dir)
    path = F.concat(F.when(F.col("doc_id") % 4 == 0, ".git/").when(F.col("doc_id") % 4 == 1, "node_modules/").otherwise(""), "path")
    f = f.withColumn("path", path)
    skip = r"(^|/)(\.git|\.hg|\.svn|node_modules|__pycache__|build|dist)/"
    return f.filter(~F.col("path").rlike(skip) & (F.octet_length("text") <= most)).select("path", F.octet_length("text").cast("long").alias("bytes"))


def q_text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files read as text: those with a zero byte are binary and skipped, faulty bytes become the replacement character."""
    raw = F.when(F.col("doc_id") % 5 == 0, F.concat(F.encode("text", "UTF-8"), F.unhex(F.lit("00")))).when(F.col("doc_id") % 5 == 1, F.concat(F.encode("text", "UTF-8"), F.unhex(F.lit("FF")))).otherwise(F.encode("text", "UTF-8"))
    f = files(spark, sf_dir).select("doc_id", raw.alias("raw"))
    text = F.make_valid_utf8(F.col("raw").cast("string"))
    return f.filter(~F.contains("raw", F.unhex(F.lit("00")))).select("doc_id", F.length(text).alias("n"), F.md5(text.cast("binary")).alias("digest"))


def q_git_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracked files without deleted ones, untracked ones, and the folders that they imply."""
    f = files(spark, sf_dir)
    kept = f.filter("(doc_id % 2 = 0 AND doc_id % 6 <> 0) OR doc_id % 7 = 0").select("path")
    parts = F.split("path", "/")
    folders = kept.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("path")).distinct()
    return kept.select("path", F.lit("file").alias("type")).unionByName(folders.select("path", F.lit("directory").alias("type")))


def q_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of each source folder: folders first, then by name."""
    f = files(spark, sf_dir).select(F.split("path", "/").alias("p"), "doc_id")
    entries = f.select(F.get("p", F.lit(0)).alias("dir"), F.get("p", F.lit(1)).alias("name"), F.lit("directory").alias("type")).union(f.filter("doc_id % 5 = 0").select(F.get("p", F.lit(0)), F.get("p", F.lit(2)), F.lit("file"))).distinct()
    return entries.select("dir", "name", "type", F.row_number().over(Window.partitionBy("dir").orderBy("type", "name")).alias("position"))


def q_tail(spark: SparkSession, sf_dir: str, most: int = 200, count: int = 2) -> DataFrame:
    """The last bytes of a text (faulty ones replaced), of these the last lines."""
    raw = F.encode("text", "UTF-8")
    size = F.octet_length("text")
    part = F.make_valid_utf8(F.substring(raw, F.greatest(size - most, F.lit(0)) + 1, F.lit(most)).cast("string"))
    rows = F.split(part, "\n")
    n = F.least(F.lit(count), F.size(rows))
    return files(spark, sf_dir).select("doc_id", F.length(F.array_join(F.slice(rows, F.size(rows) - n + 1, n), "\n")).alias("n"), F.md5(F.element_at(rows, -1).cast("binary")).alias("last"))


def q_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation as Markdown: frontmatter, a section for each turn."""
    c = table(spark, sf_dir, "conversations")
    section = F.concat(F.lit("## "), F.initcap("role"), F.lit("\n\n"), "text", F.lit("\n"))
    g = c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("messages"), F.array_sort(F.collect_list(F.struct("turn", section.alias("s")))).alias("s"))
    text = F.concat(F.lit("---\nsession: "), F.col("conv_id").cast("string"), F.lit("\nmessages: "), F.col("messages").cast("string"), F.lit("\n---\n\n"), F.array_join(F.transform("s", lambda x: x["s"]), "\n"))
    return g.select("conv_id", "messages", F.md5(text.cast("binary")).alias("digest"))


def q_sensitive(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, (".env", ".env.local", ".env.example", "id_rsa", "id_rsa.pub", "credentials", "x.env", "credentials.txt", "Xenv", ".aws/credentials", ".aws/credentials2")))
    d = table(spark, sf_dir, "documents").select(F.concat_ws("/", "source", F.element_at(names, (F.col("doc_id") % 11 + 1).cast("int"))).alias("path"), "doc_id")
    return d.select("doc_id", "path", sensitive(F.col("path")).alias("sensitive"))


def q_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = F.array(*map(F.lit, ("a.py", "a.pyc", "b.yml", "Dockerfile", "Dockerfile.x", "c.markdown", "d.mjs")))
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", "source", F.element_at(ends, (F.col("doc_id") % 7 + 1).cast("int"))).alias("path"))
    return d.select("doc_id", *[of_kind(F.col("path"), k).alias(f"is_{k}") for k in ("py", "js", "md", "yaml", "docker", "cobol")])


def q_multiline(spark: SparkSession, sf_dir: str, pattern: str = r"\. [A-Z][^\n]{0,40}\n[^\n]{0,20}") -> DataFrame:
    """Lines that a pattern over line breaks touches, from a match's start to its end, each once."""
    docs = files(spark, sf_dir).filter(F.col("text").rlike(pattern))
    hits = F.regexp_extract_all("text", F.lit(f"(?s)({pattern})"), F.lit(1))
    gaps = F.split("text", pattern)  # what stands before, between and behind the matches
    breaks = lambda s: F.length(s) - F.length(F.replace(s, F.lit("\n"), F.lit("")))
    rows = docs.select("doc_id", hits.alias("hits"), gaps.alias("gaps")).withColumn("hit", F.transform("hits", breaks)).withColumn("gap", F.transform("gaps", breaks))
    # lines before match i: breaks in the gaps up to it and in the matches before it
    start = lambda i: F.aggregate(F.slice("gap", 1, i + 1), F.lit(0), lambda a, x: a + x) + F.aggregate(F.slice("hit", 1, i), F.lit(0), lambda a, x: a + x) + 1
    spans = F.transform(F.sequence(F.lit(0), F.size("hit") - 1), lambda i: F.sequence(start(i), start(i) + F.get("hit", i)))
    return rows.select("doc_id", F.explode(F.array_distinct(F.flatten(spans))).alias("line_no"))


_S = r"""s AS (SELECT doc_id AS session, left(regexp_replace(text, '\s+', ' ', 'g'), 40) AS title, CASE WHEN doc_id % 10 <> 0 THEN '/Work/' || source END AS dir, CASE WHEN doc_id % 3 = 0 THEN doc_id % 2 = 0 END AS archived, n_chars AS bytes FROM documents)"""
_F = "f AS (SELECT doc_id, source || '/' || lang || '/' || doc_id || '.txt' AS path, text FROM documents)"
_T = """e AS (SELECT event_id AS id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events), v AS (SELECT id, k, CASE WHEN k % 4 = 0 THEN 'agent' ELSE 'command' END AS kind, CASE WHEN id % 3 <> 0 THEN ['running', 'done', 'failed', 'running', 'starting'][k % 5 + 1] ELSE 'created' END AS status,
CASE WHEN id % 3 <> 0 AND k % 2 = 0 THEN id + k WHEN id % 3 <> 0 AND k % 3 = 0 THEN id + 1 WHEN id % 3 <> 0 THEN id + 0.5 ELSE id END AS last, id % 7 = 0 AS kill_asked, CASE WHEN id % 5 = 0 THEN k ELSE 0 END AS seen FROM e)"""
QUERIES = {
    "b12_session_search": q_search_sessions, "b13_b25_session_filters": q_explore, "t09_session_order": q_session_order, "g11_projects": q_projects, "c34_titles": q_titles, "c32_c33_user_text": q_user_text, "g21_cascade_depth": q_cascade,
    "b26_context_search": q_context_search, "b22_step_notes": q_step_notes, "b27_mentions": q_mentions, "b11_hooks": q_hooks, "j13_task_view": q_task_view, "b23_open_tasks": q_open_tasks, "z06_liveness": q_liveness, "j17_dedupe_keys": q_publish,
    "b21_auto_recall": q_auto_recall, "a15_session_scan": q_session_scan, "a16_store_scan": q_store_scan, "a10_pruned_listing": q_pruned_listing, "a11_text_files": q_text_files, "a12_git_listing": q_git_listing, "a14_folder": q_folder, "a18_tail": q_tail,
    "a22_export": q_export, "b07_sensitive": q_sensitive, "b06_kinds": q_kinds, "b04_multiline": q_multiline,
}
ORACLES = {
    "b12_session_search": f"WITH {_S} SELECT session, title FROM s WHERE NOT coalesce(archived, false) AND (contains(lower(title), 'the') OR contains(lower(coalesce(dir, '')), 'the'))",
    "b13_b25_session_filters": f"WITH {_S} SELECT session, contains(CAST(session AS VARCHAR), 'src1') OR contains(lower(title), 'src1') OR contains(lower(coalesce(dir, '')), 'src1') AS explored, contains(lower(title), 'src1 ') OR contains(lower(coalesce(dir, '')), 'src1 ') AS picked, true AS unasked FROM s",
    "t09_session_order": f"WITH {_S} SELECT session, row_number() OVER (PARTITION BY dir ORDER BY session DESC) AS by_time, row_number() OVER (PARTITION BY dir ORDER BY bytes DESC, session) AS by_size, row_number() OVER (PARTITION BY dir ORDER BY lower(title), session) AS by_name FROM s",
    "g11_projects": f"WITH {_S} SELECT count(DISTINCT coalesce(dir, 'Unknown')) AS projects, CAST(sum(bytes) AS BIGINT) AS bytes FROM s",
    "c34_titles": r"WITH u AS (SELECT conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM conversations WHERE role = 'user' AND trim(text) <> '' AND turn > 0), m AS (SELECT conv_id, arg_min(t, turn) AS t FROM u GROUP BY 1) SELECT conv_id, coalesce(left(t, 30), 'Untitled') AS title FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN m USING (conv_id)",
    "c32_c33_user_text": "WITH p AS (SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN [text] WHEN turn % 3 = 0 THEN [] WHEN turn % 3 = 1 THEN [left(text, 20)] ELSE [left(text, 9), substring(text, 11, 9)] END AS t FROM conversations) SELECT conv_id, turn, len(t) AS parts, coalesce(array_to_string(t, ' '), '') AS spaced, coalesce(array_to_string(t, ''), '') AS joined FROM p",
    "g21_cascade_depth": "SELECT conv_id, count(*) FILTER (contains(text, 'que')) AS depth FROM conversations GROUP BY 1",
    "b26_context_search": "SELECT conv_id, count(*) FILTER (role <> 'system' AND contains(lower(text), 'et ')) AS found, count(*) FILTER (role = 'system') AS hidden FROM conversations GROUP BY 1",
    "b22_step_notes": "SELECT conv_id, turn FROM conversations WHERE contains(text, 'Et')",
    "b27_mentions": f"WITH {_F} SELECT path, row_number() OVER (ORDER BY path) + 2 AS place FROM f WHERE contains(lower(path), 'src1/')",
    "b11_hooks": "SELECT 'tool' || (event_id % 7) AS tool, count(*) AS calls, CASE event_id % 7 WHEN 0 THEN 'log,audit' WHEN 2 THEN 'log,audit' WHEN 4 THEN 'log,audit' WHEN 3 THEN 'log,check' ELSE 'log' END AS commands FROM events GROUP BY event_id % 7",
    "j13_task_view": f"WITH {_T} SELECT id, kind, status, seen, kill_asked FROM v",
    "b23_open_tasks": f"WITH {_T} SELECT id, status FROM v WHERE status NOT IN ('done', 'failed', 'killed', 'lost') ORDER BY id DESC LIMIT 20",
    "z06_liveness": f"WITH {_T} SELECT id, CASE WHEN status IN ('done', 'failed') THEN status WHEN kind = 'agent' THEN 'lost' WHEN (SELECT max(id) FROM v) - last <= 500 THEN status WHEN kill_asked THEN 'killed' ELSE 'lost' END AS status FROM v",
    "j17_dedupe_keys": "WITH e AS (SELECT event_id, event_id * 37 % 4001 AS dedupe_key FROM events) SELECT dedupe_key, min(event_id) AS event_id FROM e WHERE event_id >= 2000 AND dedupe_key NOT IN (SELECT dedupe_key FROM e WHERE event_id < 2000) GROUP BY 1",
    "a15_session_scan": "WITH n AS (SELECT doc_id AS id FROM documents WHERE doc_id % 11 <> 0) SELECT id, CASE WHEN id % 2 = 0 THEN id || '/context.jsonl' ELSE id || '.jsonl' END AS path FROM n WHERE id % 2 = 0 OR id % 3 = 0",
    "a16_store_scan": "WITH e AS (SELECT event_id, event_id % 50 AS g, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_id % 9 = 0 AS bad FROM events), c AS (SELECT *, count(*) FILTER (bad) OVER (PARTITION BY g) AS skipped FROM e) SELECT event_id, k, skipped, row_number() OVER (PARTITION BY g ORDER BY event_id DESC) AS position FROM c WHERE NOT bad",
    "a10_pruned_listing": f"WITH {_F} SELECT path, strlen(text) AS bytes FROM f WHERE doc_id % 4 > 1 AND strlen(text) <= 5000000",
    "a11_text_files": "WITH t AS (SELECT doc_id, CASE WHEN doc_id % 5 = 1 THEN text || chr(65533) ELSE text END AS text FROM documents WHERE doc_id % 5 <> 0) SELECT doc_id, length(text) AS n, md5(text) AS digest FROM t",
    "a12_git_listing": f"WITH {_F}, k AS (SELECT path FROM f WHERE (doc_id % 2 = 0 AND doc_id % 6 <> 0) OR doc_id % 7 = 0) SELECT path, 'file' AS type FROM k UNION ALL SELECT DISTINCT string_split(path, '/')[1], 'directory' FROM k UNION ALL SELECT DISTINCT string_split(path, '/')[1] || '/' || string_split(path, '/')[2], 'directory' FROM k",
    "a14_folder": "WITH e AS (SELECT DISTINCT source AS dir, lang AS name, 'directory' AS type FROM documents UNION SELECT source, doc_id || '.txt', 'file' FROM documents WHERE doc_id % 5 = 0) SELECT *, row_number() OVER (PARTITION BY dir ORDER BY type, name) AS position FROM e",
    "a22_export": r"""SELECT conv_id, count(*) AS messages, md5('---' || chr(10) || 'session: ' || conv_id || chr(10) || 'messages: ' || count(*) || chr(10) || '---' || chr(10) || chr(10) || string_agg('## ' || upper(left(role, 1)) || substring(role, 2) || chr(10) || chr(10) || text || chr(10), chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id""",
    "b07_sensitive": "SELECT doc_id, source || '/' || ['.env', '.env.local', '.env.example', 'id_rsa', 'id_rsa.pub', 'credentials', 'x.env', 'credentials.txt', 'Xenv', '.aws/credentials', '.aws/credentials2'][doc_id % 11 + 1] AS path, doc_id % 11 IN (0, 1, 3, 5, 9, 10) AS sensitive FROM documents",
    "b06_kinds": "SELECT doc_id, doc_id % 7 = 0 AS is_py, doc_id % 7 = 6 AS is_js, doc_id % 7 = 5 AS is_md, doc_id % 7 = 2 AS is_yaml, doc_id % 7 = 3 AS is_docker, false AS is_cobol FROM documents",
}
