"""Text scalars in built-in functions: token estimates, cleaning, shortening, durations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table

# Ranges of CJK characters, and of characters without width or with effects on direction.
CJK = r"[\x{2E80}-\x{2FDF}\x{3000}-\x{303F}\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}\x{F900}-\x{FAFF}\x{20000}-\x{2FA1F}]"
NO_WIDTH = r"[\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{FEFF}]"


def token_estimate(text: Column) -> Column:
    """Characters over 4 for ASCII, over 3 where CJK is frequent, over 3.5 otherwise; 0 for nothing."""
    n = F.length(text)
    ascii_ = F.length(F.regexp_replace(text, r"[^\x00-\x7F]", ""))
    cjk = F.regexp_count(text, F.lit(CJK))
    return (
        F.when(F.coalesce(n, F.lit(0)) == 0, 0)
        .when(ascii_ / n > F.lit(0.95), F.greatest(F.lit(1), F.floor(n / 4)))
        .when(cjk / n > F.lit(0.15), F.floor(n / 3))
        .otherwise(F.floor(n / F.lit(3.5)))
        .cast("long")
    )


def cleaned(text: Column) -> Column:
    """Without characters of no width and control characters but line breaks and tabs, trimmed."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, NO_WIDTH, ""), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}]", ""), r"^\s+|\s+\z", "")


def short_runs(text: Column, most: int = 100) -> Column:
    """Runs of one character cut to `most`."""
    return F.regexp_replace(text, rf"(.)\1{{{most - 1}}}\1+", F.repeat(F.lit("$1"), most))


def shorten(text: Column, width: int, mark: str = "...") -> Column:
    """White space joined; beyond the width cut at a word, the mark included."""
    plain = F.trim(F.regexp_replace(text, r"\s+", " "))
    cut = F.substring(plain, 1, width - len(mark) + 1)
    at_word = F.regexp_replace(cut, r"\s*\S*\z", "")
    kept = F.when(F.length(at_word) > 0, at_word).otherwise(F.substring(plain, 1, width - len(mark)))
    return F.when(F.length(plain) <= width, plain).otherwise(F.concat(kept, F.lit(mark)))


def duration_text(seconds: Column) -> Column:
    s = F.floor(seconds)
    h, m, rest = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    return F.when(h > 0, F.format_string("%dh %dm", h, m)).when(m > 0, F.format_string("%dm %ds", m, rest)).otherwise(F.format_string("%ds", rest))


def q_token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", token_estimate(F.col("text")).alias("tokens"))


def q_conversation_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens by role with their share of all."""
    sums = table(spark, sf_dir, "conversations").groupBy("role").agg(F.sum(token_estimate(F.col("text"))).alias("tokens"), F.count(F.lit(1)).alias("turns"))
    total = sums.agg(F.sum("tokens").alias("all"))
    return sums.crossJoin(F.broadcast(total)).select("role", "turns", "tokens", F.round(100 * F.col("tokens") / F.col("all"), 4).alias("share"))


def q_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    dirty = F.concat(F.lit(" ​\x07"), "text", F.lit("﻿ \n"))
    return table(spark, sf_dir, "benchmark").select("item_id", F.md5(cleaned(dirty).cast("binary")).alias("clean"))


def q_shorten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", shorten(F.col("text"), 60).alias("title"))


def q_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", duration_text(F.col("value") * 100).alias("duration"))


def q_first_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first line with a whole word of a list, 1-based."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    return lines.filter(F.col("line").rlike(r"(?iU)\b(the|und|que)\b")).groupBy("doc_id").agg((F.min("at") + 1).alias("line_no"))


QUERIES = {"c13_token_estimate": q_token_estimate, "g09_tokens_by_role": q_conversation_tokens, "c14_clean_text": q_clean, "c24_shorten": q_shorten, "c25_duration_text": q_durations, "c23_first_line_with": q_first_error}
_EST = r"CAST(CASE WHEN coalesce(length(text), 0) = 0 THEN 0 WHEN length(regexp_replace(text, '[^\x00-\x7F]', '', 'g')) / length(text) > 0.95 THEN greatest(1, length(text) // 4) ELSE floor(length(text) / 3.5) END AS BIGINT)"
ORACLES = {
    "c13_token_estimate": f"SELECT doc_id, {_EST} AS tokens FROM documents",
    "g09_tokens_by_role": f"WITH s AS (SELECT role, CAST(sum({_EST}) AS BIGINT) AS tokens, count(*) AS turns FROM conversations GROUP BY role) SELECT role, turns, tokens, round(100 * tokens / sum(tokens) OVER (), 4) AS share FROM s",
    "c14_clean_text": r"WITH d AS (SELECT item_id, ' ' || chr(8203) || chr(7) || text || chr(65279) || ' ' || chr(10) AS t FROM benchmark) SELECT item_id, md5(regexp_replace(regexp_replace(regexp_replace(t, '[\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{FEFF}]', '', 'g'), '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}]', '', 'g'), '^\s+|\s+$', '', 'g')) AS clean FROM d",
    "c24_shorten": r"""WITH p AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents), c AS (SELECT doc_id, t, regexp_replace(left(t, 58), '\s*\S*$', '') AS w FROM p)
SELECT doc_id, CASE WHEN length(t) <= 60 THEN t WHEN length(w) > 0 THEN w || '...' ELSE left(t, 57) || '...' END AS title FROM c""",
    "c25_duration_text": "WITH s AS (SELECT event_id, CAST(floor(value * 100) AS BIGINT) AS s FROM events) SELECT event_id, CASE WHEN s >= 3600 THEN (s // 3600) || 'h ' || (s % 3600 // 60) || 'm' WHEN s >= 60 THEN (s // 60) || 'm ' || (s % 60) || 's' ELSE s || 's' END AS duration FROM s",
    "c23_first_line_with": r"WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n FROM documents) SELECT doc_id, CAST(min(n) AS INTEGER) AS line_no FROM l WHERE regexp_matches(line, '(?i)(^|[^\p{L}\p{N}_])(the|und|que)([^\p{L}\p{N}_]|$)') GROUP BY doc_id",
}
