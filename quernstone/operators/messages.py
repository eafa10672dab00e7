"""Messages made from events: aggregation by step, cumulative parts, compaction as a rewrite, recall blocks, ordered sets."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..plans.shipping import ship
from ..sources.tables import table
from .events import so_far
from .trace import TRACE_SQL, of, trace

FLUSH = ("StepBegin", "StepInterrupted")
MESSAGE = "session_id long, last_idx long, text string, calls string"


def ordered(place: Column, value: Column) -> Column:
    """An aggregate: values in the order of their places, without those whose place is null."""
    rows = F.collect_list(F.when(place.isNotNull(), F.struct(place.alias("place"), value.alias("value"))))
    return F.transform(F.array_sort(rows), lambda x: x["value"])


def messages(events: DataFrame) -> DataFrame:
    """session_id, last_idx, text, calls: what each stretch up to a step's begin or interruption says, and the calls that got a result, in order of first call.

    A call without a result since its last repetition is dropped; stretches without text and calls say nothing.
    """
    flush = F.col("type").isin(*FLUSH)
    e = events.withColumn("step", F.sum(flush.cast("long")).over(so_far())).filter(~flush)
    is_ = lambda kind: F.col("type") == kind
    calls = of(e, "ToolCall", "ToolResult").groupBy("session_id", "step", "call_id").agg(F.min(F.when(is_("ToolCall"), F.col("idx"))).alias("first"), F.max(F.when(is_("ToolCall"), F.col("idx"))).alias("again"), F.max(F.when(is_("ToolResult"), F.col("idx"))).alias("result"))
    calls = calls.filter("first IS NOT NULL").groupBy("session_id", "step").agg(F.array_join(ordered(F.when(F.col("result") > F.col("again"), F.col("first")), F.col("call_id")), ",").alias("calls"), F.max(F.greatest("again", F.coalesce("result", F.lit(-1)))).alias("call_idx"))
    text = of(e, "TextPart").groupBy("session_id", "step").agg(F.array_join(ordered(F.col("idx"), F.col("text")), "").alias("text"), F.max("idx").alias("text_idx"))
    both = text.join(calls, ["session_id", "step"], "full")
    return both.select("session_id", F.greatest(F.coalesce("text_idx", F.lit(-1)), F.coalesce("call_idx", F.lit(-1))).alias("last_idx"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("calls", F.lit("")).alias("calls"))


def message_stream(events: DataFrame) -> DataFrame:
    """The same over a stream: a session's open stretch is its state; a row of type End flushes it."""
    ship(events.sparkSession)
    state_schema = "last_idx long, text string, ids array<string>, answered array<boolean>"

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, text, ids, answered = state.get if state.exists else (-1, "", [], [])
        ids, answered, out = list(ids), list(answered), []
        rows = sorted((r for pdf in batches for r in pdf[["idx", "type", "call_id", "text"]].itertuples(index=False, name=None)), key=lambda r: r[0])
        for idx, kind, call, part in rows:
            if kind in FLUSH or kind == "End":
                if text or ids:
                    out.append((key[0], last, text, ",".join(c for c, a in zip(ids, answered) if a)))
                last, text, ids, answered = -1, "", [], []
            elif kind == "TextPart":
                text, last = text + part, idx
            elif kind == "ToolCall":
                last = idx
                if call in ids:
                    answered[ids.index(call)] = False
                else:
                    ids.append(call)
                    answered.append(False)
            elif kind == "ToolResult" and call in ids:
                answered[ids.index(call)], last = True, idx
        state.update((last, text, ids, answered))
        yield pd.DataFrame(out, columns=["session_id", "last_idx", "text", "calls"])

    return events.groupBy("session_id").applyInPandasWithState(step, MESSAGE, state_schema, "append", GroupStateTimeout.NoTimeout)


def broadcast_stream(events: DataFrame, raw: str, merged: str, checkpoint: str):
    """One source, two readers: each micro-batch as it is, and with adjacent parts of a batch merged, which a recorder writes too."""
    from ..streaming.folds import merge_batch

    def both(batch: DataFrame, _id: int) -> None:
        batch.write.mode("append").parquet(raw)
        merge_batch(batch).write.mode("append").parquet(merged)

    return events.writeStream.foreachBatch(both).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def q_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(trace(spark, sf_dir))


def q_cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text or thinking part with what it makes of its message so far: text starts anew with a step, thinking with text, a call or a step."""
    e = trace(spark, sf_dir)
    count = lambda *kinds: F.sum(F.col("type").isin(*kinds).cast("long")).over(so_far())
    e = e.withColumn("part", F.when(F.col("type") == "TextPart", count("StepBegin")).otherwise(count("StepBegin", "TextPart", "ToolCall")))
    w = Window.partitionBy("session_id", "type", "part").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    return of(e, "TextPart", "ThinkPart").select("session_id", "idx", "type", F.col("text").alias("delta"), F.array_join(F.collect_list("text").over(w), "").alias("cumulative"))


def q_rewritten(spark: SparkSession, sf_dir: str, keep: int = 2) -> DataFrame:
    """A conversation's log after compaction: one row that stands for all but the last messages, then those."""
    c = table(spark, sf_dir, "conversations")
    back = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    c = c.withColumn("old", back > keep)
    summary = c.filter("old").groupBy("conv_id").agg(F.lit(-1).cast("long").alias("turn"), F.concat(F.lit("archived "), F.count(F.lit(1)).cast("string")).alias("what"))
    return summary.unionByName(c.filter("NOT old").select("conv_id", "turn", F.col("role").alias("what")))


def q_unique_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The different words of a passage in the order in which they come first."""
    words = F.array_distinct(F.filter(F.split(F.lower("text"), r"(?U)\s+"), lambda w: w != ""))
    return table(spark, sf_dir, "benchmark").select("item_id", F.size(words).cast("long").alias("n"), F.md5(F.array_join(words, " ").cast("binary")).alias("digest"))


def q_unique_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of calls of one session with the same tool and text the first."""
    e = of(trace(spark, sf_dir), "ToolCall")
    return e.groupBy("session_id", "tool", "text").agg(F.min("idx").alias("idx"))


def q_recall(spark: SparkSession, sf_dir: str, k: int = 5) -> DataFrame:
    """The blocks that a recall of k turns (1 to 10) shows: who said it, whether it is archived, how well it fits, the text as a quotation."""
    from .retrieval import Index, history_turns, queries_of, query_terms

    turns = history_turns(table(spark, sf_dir, "conversations"))
    found = Index(turns.select(F.col("turn_id").alias("doc_id"), "text"), dense=True).best(query_terms(queries_of(spark, sf_dir)), max(1, min(10, k)))
    rows = found.join(turns.withColumnRenamed("turn_id", "doc_id"), "doc_id")
    archived = F.when(F.col("doc_id") % 2 == 0, " [compacted]").otherwise("")
    block = F.concat(F.lit("> **"), "role", F.lit("**"), archived, F.lit(" (relevance: "), F.format_string("%.2f", "score"), F.lit(")\n> "), F.replace("text", F.lit("\n"), F.lit("\n> ")))
    g = rows.groupBy("qid").agg(F.count(F.lit(1)).alias("n"), ordered(F.col("rank"), block).alias("blocks"))
    return g.select("qid", "n", F.concat(F.lit("Retrieved "), F.col("n").cast("string"), F.lit(" past turn(s):\n\n"), F.array_join("blocks", "\n\n")).alias("shown"))


_COUNT = "sum(CASE WHEN type IN ({}) THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY idx ROWS UNBOUNDED PRECEDING)"
QUERIES = {"z02_messages": q_messages, "z10_cumulative_parts": q_cumulative, "z08_rewritten_log": q_rewritten, "s06_unique_words": q_unique_words, "s07_unique_edits": q_unique_edits, "q25_recall_blocks": q_recall}
ORACLES = {
    "z02_messages": f"""WITH {TRACE_SQL}, s AS (SELECT *, {_COUNT.format("'StepBegin', 'StepInterrupted'")} AS step FROM trace), e AS (SELECT * FROM s WHERE type NOT IN ('StepBegin', 'StepInterrupted')),
c AS (SELECT session_id, step, call_id, min(idx) FILTER (type = 'ToolCall') AS first, max(idx) FILTER (type = 'ToolCall') AS again, max(idx) FILTER (type = 'ToolResult') AS result FROM e WHERE type IN ('ToolCall', 'ToolResult') GROUP BY ALL HAVING first IS NOT NULL),
k AS (SELECT session_id, step, string_agg(call_id, ',' ORDER BY first) FILTER (result > again) AS calls, max(greatest(again, coalesce(result, -1))) AS i FROM c GROUP BY ALL), t AS (SELECT session_id, step, string_agg(text, '' ORDER BY idx) AS text, max(idx) AS i FROM e WHERE type = 'TextPart' GROUP BY ALL)
SELECT session_id, greatest(coalesce(t.i, -1), coalesce(k.i, -1)) AS last_idx, coalesce(text, '') AS text, coalesce(calls, '') AS calls FROM t FULL JOIN k USING (session_id, step)""",
    "z10_cumulative_parts": f"""WITH {TRACE_SQL}, p AS (SELECT *, CASE WHEN type = 'TextPart' THEN {_COUNT.format("'StepBegin'")} ELSE {_COUNT.format("'StepBegin', 'TextPart', 'ToolCall'")} END AS part FROM trace)
SELECT session_id, idx, type, text AS delta, array_to_string(list(text) OVER (PARTITION BY session_id, type, part ORDER BY idx ROWS UNBOUNDED PRECEDING), '') AS cumulative FROM p WHERE type IN ('TextPart', 'ThinkPart')""",
    "z08_rewritten_log": "WITH c AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) > 2 AS old FROM conversations) SELECT conv_id, -1 AS turn, 'archived ' || count(*) AS what FROM c WHERE old GROUP BY conv_id UNION ALL SELECT conv_id, turn, role FROM c WHERE NOT old",
    "s06_unique_words": r"WITH w AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS w FROM benchmark), u AS (SELECT item_id, list_filter(w, lambda x, i: list_position(w, x) = i) AS w FROM w) SELECT item_id, len(w) AS n, md5(array_to_string(w, ' ')) AS digest FROM u",
    "s07_unique_edits": f"WITH {TRACE_SQL} SELECT session_id, tool, text, min(idx) AS idx FROM trace WHERE type = 'ToolCall' GROUP BY ALL",
}
