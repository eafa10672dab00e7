"""Scanning a corpus of texts by line: search modes, context, paging, budgets, path rules.

Documents serve as files: path is source/lang/doc_id.txt.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import table

PATTERN = "heed|ereux"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"), "text")


def lines(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("_at", "line")).select("doc_id", (F.col("_at") + 1).alias("line_no"), "line")


def q_grep_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(files(spark, sf_dir).filter(F.col("text").rlike(PATTERN))).filter(F.col("line").rlike(PATTERN)).select("doc_id", "line_no", F.length("line").alias("n"))


def q_grep_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).filter(F.col("text").rlike(PATTERN)).select("path")


def q_grep_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("path", F.regexp_count("text", F.lit(PATTERN)).cast("long").alias("matches")).filter("matches > 0")


def q_grep_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q_grep_count(spark, sf_dir).agg(F.coalesce(F.sum("matches"), F.lit(0)).alias("matches"), F.count(F.lit(1)).alias("files"))


def q_grep_context(spark: SparkSession, sf_dir: str, before: int = 1, after: int = 2) -> DataFrame:
    """Ranges of lines around matches, merged where they touch."""
    docs = files(spark, sf_dir).filter(F.col("text").rlike(PATTERN))
    hit = lines(docs).filter(F.col("line").rlike(PATTERN)).join(docs.select("doc_id", F.size(F.split("text", "\n")).alias("n")), "doc_id")
    span = hit.select("doc_id", F.greatest(F.lit(1), F.col("line_no") - before).alias("a"), F.least(F.col("n"), F.col("line_no") + after).alias("b"), "line_no")
    w = Window.partitionBy("doc_id").orderBy("line_no")
    new = F.coalesce((F.col("a") > F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1)) + 1).cast("int"), F.lit(1))
    part = F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return span.withColumn("new", new).withColumn("part", part).groupBy("doc_id", "part").agg(F.min("a").alias("start_line"), F.max("b").alias("end_line"), F.count(F.lit(1)).alias("matches")).drop("part")


def q_find_string(spark: SparkSession, sf_dir: str, needle: str = "ErEr") -> DataFrame:
    """Overlapping hits of a literal without regard to case; 1-based columns."""
    low = needle.lower()
    found = lines(files(spark, sf_dir).filter(F.lower("text").contains(low))).withColumn("low", F.lower("line")).filter(F.col("low").contains(low))
    ahead = F.expr(f"regexp_replace(low, '(?={low})', '\\u0001')")  # a mark before every place where it starts
    parts = F.split(ahead, "\u0001")
    starts = F.transform(F.sequence(F.lit(1), F.size("parts") - 1), lambda i: F.aggregate(F.slice("parts", 1, i), F.lit(0), lambda s, x: s + F.length(x)) + 1)
    return found.withColumn("parts", parts).select("doc_id", "line_no", F.explode(starts).alias("col"))


def q_paged_read(spark: SparkSession, sf_dir: str, offset: int = 2, limit: int = 3, width: int = 200) -> DataFrame:
    """Lines from an offset on (1-based), so many at most, each cut to a width."""
    return lines(files(spark, sf_dir)).filter((F.col("line_no") >= offset) & (F.col("line_no") < offset + limit)).select("doc_id", "line_no", F.substring("line", 1, width).alias("line"))


def q_tail_read(spark: SparkSession, sf_dir: str, count: int = 2) -> DataFrame:
    parts = F.split("text", "\n")
    return files(spark, sf_dir).select("doc_id", F.array_join(F.slice(parts, -F.least(F.lit(count), F.size(parts)), F.least(F.lit(count), F.size(parts))), "\n").alias("tail"))


def q_byte_budget(spark: SparkSession, sf_dir: str, budget: int = 1500) -> DataFrame:
    """Lines of each document while the bytes before stay under the budget: the one that crosses it is kept."""
    w = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.octet_length("line") + 1).over(w), F.lit(0))
    return lines(files(spark, sf_dir)).withColumn("before", before).filter(F.col("before") < budget).groupBy("doc_id").agg(F.max("line_no").alias("kept"), F.max("before").alias("bytes_before"))


def q_size_prefix(spark: SparkSession, sf_dir: str, cap: int = 20_000) -> DataFrame:
    """Documents of each source in order of id while their sizes together stay within a cap."""
    w = Window.partitionBy("source").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "documents").select("source", "doc_id", F.sum("n_chars").over(w).alias("total")).filter(F.col("total") <= cap)


def glob_pattern(glob: str) -> str:
    """A regular expression for a path glob: * and ? within a part, ** over parts."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            out, i = out + {"*": "[^/]*", "?": "[^/]"}.get(glob[i], re.escape(glob[i])), i + 1
    return f"^{out}$"


def q_glob(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).filter(F.col("path").rlike(glob_pattern("src1*/**/*5.txt"))).select("path")


#: Ignore rules in order: pattern, whether it takes paths back in.
RULES = [("src3/**", False), ("**/fr/*", False), ("src3/en/*", True), ("**/*7.txt", False)]


def ignored(path: Column) -> Column:
    """The last rule that matches decides."""
    out = F.lit(False)
    for glob, back in RULES:
        out = F.when(path.rlike(glob_pattern(glob)), F.lit(not back)).otherwise(out)
    return out


def q_ignore_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("path", ignored(F.col("path")).alias("ignored"))


def q_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directories that the paths imply, with their files."""
    parts = F.split("path", "/")
    dirs = files(spark, sf_dir).select(F.explode(F.array(F.get(parts, F.lit(0)), F.concat_ws("/", F.get(parts, F.lit(0)), F.get(parts, F.lit(1))))).alias("dir"))
    return dirs.groupBy("dir").agg(F.count(F.lit(1)).alias("files"))


def q_newest(spark: SparkSession, sf_dir: str, offset: int = 5, limit: int = 20) -> DataFrame:
    """A page of documents, largest id (newest) first."""
    return files(spark, sf_dir).orderBy(F.desc("doc_id")).offset(offset).limit(limit).select("doc_id", "path")


def q_byte_range(spark: SparkSession, sf_dir: str, start: int = 10, size: int = 16) -> DataFrame:
    raw = F.col("text").cast("binary")
    return files(spark, sf_dir).select("doc_id", F.hex(F.substring(raw, start + 1, size)).alias("part"), (F.octet_length("text") <= start + size).alias("eof"))


def q_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of one length class as layers of one path: a conflict is more than one content; else the first holder applies."""
    layers = table(spark, sf_dir, "documents").select((F.col("n_chars") % 400).alias("path"), "doc_id", F.sha2("text", 256).alias("digest"))
    return layers.groupBy("path").agg(F.count_distinct("digest").alias("contents"), F.min("doc_id").alias("first_holder")).select("path", "contents", (F.col("contents") > 1).alias("conflict"), "first_holder")


_FILES = "files AS (SELECT doc_id, source || '/' || lang || '/' || doc_id || '.txt' AS path, text FROM documents)"
_LINES = f"{_FILES}, lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM files)"
QUERIES = {
    "b01_grep_content": q_grep_content, "b02_grep_files": q_grep_files, "b03_grep_count": q_grep_count, "g15_grep_total": q_grep_total, "b05_grep_context": q_grep_context, "b10_find_string": q_find_string,
    "t06_paged_read": q_paged_read, "t07_tail_read": q_tail_read, "t05_byte_budget": q_byte_budget, "t16_size_prefix": q_size_prefix, "b09_glob": q_glob, "b08_ignore_rules": q_ignore_rules, "a13_listing": q_listing,
    "t04_offset_limit": q_newest, "a17_byte_range": q_byte_range, "j15_overlay_merge": q_overlay,
}
ORACLES = {
    "b01_grep_content": f"WITH {_LINES} SELECT doc_id, line_no, length(line) AS n FROM lines WHERE regexp_matches(line, '{PATTERN}')",
    "b02_grep_files": f"WITH {_FILES} SELECT path FROM files WHERE regexp_matches(text, '{PATTERN}')",
    "b03_grep_count": f"WITH {_FILES}, c AS (SELECT path, len(regexp_extract_all(text, '{PATTERN}')) AS matches FROM files) SELECT * FROM c WHERE matches > 0",
    "g15_grep_total": f"WITH {_FILES}, c AS (SELECT path, len(regexp_extract_all(text, '{PATTERN}')) AS matches FROM files) SELECT CAST(coalesce(sum(matches), 0) AS BIGINT) AS matches, count(*) AS files FROM c WHERE matches > 0",
    "b05_grep_context": f"""WITH {_LINES}, c AS (SELECT doc_id, max(line_no) AS n FROM lines GROUP BY 1), h AS (SELECT doc_id, line_no, greatest(1, line_no - 1) AS a, least(n, line_no + 2) AS b FROM lines JOIN c USING (doc_id) WHERE regexp_matches(line, '{PATTERN}')),
r AS (SELECT *, max(b) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM h), p AS (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS part FROM r)
SELECT doc_id, min(a) AS start_line, max(b) AS end_line, count(*) AS matches FROM p GROUP BY doc_id, part""",
    "b10_find_string": f"WITH {_LINES}, l AS (SELECT doc_id, line_no, lower(line) AS low FROM lines WHERE contains(lower(line), 'erer')) SELECT doc_id, line_no, unnest(list_filter(range(1, length(low) - 2), lambda i: substring(low, i, 4) = 'erer')) AS col FROM l",
    "t06_paged_read": f"WITH {_LINES} SELECT doc_id, line_no, left(line, 200) AS line FROM lines WHERE line_no >= 2 AND line_no < 5",
    "t07_tail_read": f"WITH {_FILES} SELECT doc_id, array_to_string(list_slice(string_split(text, chr(10)), -2, -1), chr(10)) AS tail FROM files",
    "t05_byte_budget": f"WITH {_LINES}, b AS (SELECT doc_id, line_no, CAST(coalesce(sum(strlen(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM lines) SELECT doc_id, max(line_no) AS kept, max(before) AS bytes_before FROM b WHERE before < 1500 GROUP BY doc_id",
    "t16_size_prefix": "WITH t AS (SELECT source, doc_id, CAST(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM documents) SELECT * FROM t WHERE total <= 20000",
    "b09_glob": f"WITH {_FILES} SELECT path FROM files WHERE regexp_matches(path, '^src1[^/]*/(.*/)?[^/]*5\\.txt$')",
    "b08_ignore_rules": f"WITH {_FILES} SELECT path, CASE WHEN regexp_matches(path, '^(.*/)?[^/]*7\\.txt$') THEN true WHEN regexp_matches(path, '^src3/en/[^/]*$') THEN false WHEN regexp_matches(path, '^(.*/)?fr/[^/]*$') THEN true WHEN regexp_matches(path, '^src3/.*$') THEN true ELSE false END AS ignored FROM files",
    "a13_listing": "WITH d AS (SELECT source AS dir FROM documents UNION ALL SELECT source || '/' || lang FROM documents) SELECT dir, count(*) AS files FROM d GROUP BY dir",
    "t04_offset_limit": f"WITH {_FILES} SELECT doc_id, path FROM files ORDER BY doc_id DESC LIMIT 20 OFFSET 5",
    "a17_byte_range": "SELECT doc_id, substring(hex(encode(text)), 21, 32) AS part, strlen(text) <= 26 AS eof FROM documents",
    "j15_overlay_merge": "SELECT n_chars % 400 AS path, count(DISTINCT sha256(text)) AS contents, count(DISTINCT sha256(text)) > 1 AS conflict, min(doc_id) AS first_holder FROM documents GROUP BY 1",
}
