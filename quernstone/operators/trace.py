"""Traces of an agent's events: approvals, integrity by pair kind, spans, nesting, thinking, subagents, sorting.

Rows are (session_id, idx, ts, type, ...). Rules that look back in a session are windows over it; the one
that needs a list of open calls is a fold over sessions that come sorted, with the open calls as its state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.shipping import ship
from ..sources.tables import table
from .events import so_far

# The kinds of events that a control event is not, and the pairs that must balance.
PARTS = ("TextPart", "ThinkPart", "ToolCallPart")
SPANS = (("TurnBegin", "TurnEnd"), ("CompactionBegin", "CompactionEnd"))
PAIRS = (("ToolCall", "ToolResult"), ("ApprovalRequest", "ApprovalResponse"))

#: The events table read as a trace with parts, approvals, compactions and subagents.
TRACE_SQL = """
trace AS (SELECT user_id AS session_id, event_id AS idx, epoch_us(ts) / 1000000.0::DOUBLE AS ts, CASE WHEN event_type = 'signup' THEN 'TurnBegin' WHEN event_type = 'click' AND k % 3 = 0 THEN 'ApprovalRequest' WHEN event_type = 'click' THEN 'ToolCall'
  WHEN event_type = 'purchase' AND k % 3 = 0 THEN 'ApprovalResponse' WHEN event_type = 'purchase' THEN 'ToolResult' WHEN event_type = 'view' AND value < 10 THEN 'TurnEnd' WHEN event_type = 'view' THEN ['StepBegin', 'TextPart', 'ThinkPart', 'ToolCallPart'][k % 4 + 1]
  WHEN value < 3 THEN 'StepInterrupted' WHEN k % 5 = 0 THEN 'SubagentEvent' WHEN k % 5 = 1 THEN 'CompactionBegin' WHEN k % 5 = 2 THEN 'CompactionEnd' ELSE 'StatusUpdate' END AS type,
  'c' || (k % 7) AS call_id, 'tool' || (k % 5) AS tool, 'agent' || (k % 6) AS agent, ['coder', 'explore', 'plan'][k % 3 + 1] AS agent_type, 't' || k AS text, k % 4 = 0 AS is_error
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))"""


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session_id, idx, ts (seconds), type, call_id, tool, agent, agent_type, text, is_error."""
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    kind, value, k = F.col("event_type"), F.col("value"), F.col("k")
    pick = lambda names, by: F.element_at(F.array(*map(F.lit, names)), (by + 1).cast("int"))
    named = (
        F.when(kind == "signup", "TurnBegin")
        .when((kind == "click") & (k % 3 == 0), "ApprovalRequest")
        .when(kind == "click", "ToolCall")
        .when((kind == "purchase") & (k % 3 == 0), "ApprovalResponse")
        .when(kind == "purchase", "ToolResult")
        .when((kind == "view") & (value < 10), "TurnEnd")
        .when(kind == "view", pick(("StepBegin", *PARTS), k % 4))
        .when(value < 3, "StepInterrupted")
        .when(k % 5 == 0, "SubagentEvent")
        .when(k % 5 == 1, "CompactionBegin")
        .when(k % 5 == 2, "CompactionEnd")
        .otherwise("StatusUpdate")
    )
    name = lambda head, by: F.concat(F.lit(head), by.cast("string"))
    return e.select(
        F.col("user_id").alias("session_id"), F.col("event_id").alias("idx"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"), named.alias("type"),
        name("c", k % 7).alias("call_id"), name("tool", k % 5).alias("tool"), name("agent", k % 6).alias("agent"), pick(("coder", "explore", "plan"), k % 3).alias("agent_type"), name("t", k).alias("text"), (k % 4 == 0).alias("is_error"),
    )


def of(events: DataFrame, *kinds: str) -> DataFrame:
    return events.filter(F.col("type").isin(*kinds))


def counted(flag: Column) -> Column:
    return F.sum(flag.cast("long")).over(so_far())


def approvals(events: DataFrame) -> DataFrame:
    """Requests with the response that closes them; a newer request of the id takes an open one's place, the last open one is pending to the session's end."""
    end = F.max("ts").over(Window.partitionBy("session_id"))
    rows = of(events.withColumn("_end", end), "ApprovalRequest", "ApprovalResponse")
    w = Window.partitionBy("session_id", "call_id").orderBy("idx")
    after = F.lead("type").over(w)
    rows = rows.withColumn("_after", after).withColumn("_ts", F.lead("ts").over(w)).filter((F.col("type") == "ApprovalRequest") & (F.col("_after").isNull() | (F.col("_after") == "ApprovalResponse")))
    waited = F.coalesce("_ts", "_end") - F.col("ts")
    return rows.select("session_id", "idx", "call_id", F.col("_after").isNull().alias("pending"), F.round(waited, 3).alias("waited"))


def q_approvals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return approvals(trace(spark, sf_dir))


def q_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pending requests, oldest first."""
    order = Window.partitionBy("session_id").orderBy("idx")
    return approvals(trace(spark, sf_dir)).filter("pending").select("session_id", F.row_number().over(order).alias("position"), "idx", "call_id")


def integrity(events: DataFrame) -> DataFrame:
    """session_id, kind, opened_alone, closed_alone: spans by a counter that never falls below zero, pairs by ids without the other side."""
    out = None
    for begin, end in SPANS:
        sign = F.when(F.col("type") == begin, 1).otherwise(-1)
        rows = of(events, begin, end).withColumn("level", F.sum(sign).over(so_far()))
        rows = rows.groupBy("session_id").agg(F.least(F.lit(0), F.min("level")).alias("low"), F.max_by("level", "idx").alias("last"))
        part = rows.select("session_id", F.lit(begin).alias("kind"), (F.col("last") - F.col("low")).alias("opened_alone"), (-F.col("low")).alias("closed_alone"))
        out = part if out is None else out.unionByName(part)
    for begin, end in PAIRS:
        has = lambda kind: F.max((F.col("type") == kind).cast("int"))
        ids = of(events, begin, end).groupBy("session_id", "call_id").agg(has(begin).alias("a"), has(end).alias("b"))
        part = ids.groupBy("session_id").agg(F.sum(F.col("a") * (1 - F.col("b"))).alias("opened_alone"), F.sum(F.col("b") * (1 - F.col("a"))).alias("closed_alone"))
        out = out.unionByName(part.select("session_id", F.lit(begin).alias("kind"), "opened_alone", "closed_alone"))
    return out.select("session_id", "kind", F.col("opened_alone").cast("long").alias("opened_alone"), F.col("closed_alone").cast("long").alias("closed_alone"))


def q_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity(trace(spark, sf_dir))


def q_linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of a call in the event log and in the conversation, by id; the last place of each counts."""
    e = trace(spark, sf_dir)
    side = lambda kind, name: of(e, kind).groupBy("session_id", "call_id").agg(F.max("idx").alias(name))
    return side("ToolCall", "event_idx").join(side("ToolResult", "message_idx"), ["session_id", "call_id"])


def q_subagents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subagents' events under their parent call, within a step."""
    e = of(trace(spark, sf_dir).withColumn("step", counted(F.col("type") == "StepBegin")), "SubagentEvent")
    order = F.array_sort(F.collect_list(F.struct("idx", "agent")))
    return e.groupBy("session_id", "step", F.col("call_id").alias("parent_id")).agg(F.count(F.lit(1)).alias("events"), F.array_join(F.transform(order, lambda x: x["agent"]), ",").alias("agents"))


def q_spans(spark: SparkSession, sf_dir: str, least: float = 0.001) -> DataFrame:
    """Text and thinking: from the first part to the next control event; spans up to `least` seconds go, the first part names them."""
    e = trace(spark, sf_dir)
    spoken = F.col("type").isin("TextPart", "ThinkPart")
    e = e.withColumn("part", F.col("type").isin(*PARTS)).withColumn("run", counted(~F.col("type").isin(*PARTS)))
    spans = e.groupBy("session_id", "run").agg(F.min(F.when(spoken, F.col("idx"))).alias("first_idx"), F.min_by(F.when(spoken, F.col("type")), F.when(spoken, F.col("idx"))).alias("label"), F.min_by(F.when(spoken, F.col("ts")), F.when(spoken, F.col("idx"))).alias("start"))
    close = e.filter(~F.col("part")).select("session_id", (F.col("run") - 1).alias("run"), F.col("ts").alias("stop"))
    length = F.col("stop") - F.col("start")
    return spans.filter("first_idx IS NOT NULL").join(close, ["session_id", "run"]).filter(length > least).select("session_id", "first_idx", "label", F.round(length, 3).alias("seconds"))


def folded(events: DataFrame, fold: Callable[[list, tuple], tuple | None], columns: list[str], schema: str, names: list[str]) -> DataFrame:
    """Rows of fold(state, row) over each session in order of idx; the state starts as an empty list. Sessions pass through one by one, none is held."""
    ship(events.sparkSession)
    kinds = [pa.int64() if k.endswith("long") else pa.string() for k in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, []
        for batch in batches:
            out = []
            for row in zip(*(batch.column(c).to_pylist() for c in columns)):
                if row[0] != now:
                    now, state = row[0], []
                got = fold(state, row)
                if got is not None:
                    out.append(got)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return events.select(*columns).repartition("session_id").sortWithinPartitions("session_id", "idx").mapInArrow(run, schema)


def q_open_call(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The call that a part belongs to: the one opened last of those without a result yet, null if there is none."""

    def fold(state: list, row: tuple) -> tuple | None:
        session, idx, kind, call = row
        if kind == "ToolCall":
            state.append((idx, call))
        elif kind == "ToolResult":
            state[:] = [x for x in state if x[1] != call]
        elif kind == "ToolCallPart":
            return (session, idx, state[-1][0] if state else None, state[-1][1] if state else None)
        return None

    e = of(trace(spark, sf_dir), "ToolCall", "ToolResult", "ToolCallPart")
    return folded(e, fold, ["session_id", "idx", "type", "call_id"], "session_id long, idx long, call_idx long, call_id string", ["session_id", "idx", "call_idx", "call_id"])


def q_thinking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was thought before each call: since the call or the turn's begin before it, joined by blanks."""
    e = of(trace(spark, sf_dir), "ThinkPart", "ToolCall", "TurnBegin")
    edge = F.col("type") != "ThinkPart"
    e = e.withColumn("part", counted(edge) - edge.cast("long"))
    thoughts = F.array_sort(F.collect_list(F.when(~edge, F.struct("idx", "text"))))
    closing = F.max(F.when(F.col("type") == "ToolCall", F.col("idx")))
    rows = e.groupBy("session_id", "part").agg(closing.alias("idx"), F.array_join(F.transform(thoughts, lambda x: x["text"]), " ").alias("thinking"))
    return rows.filter("idx IS NOT NULL").select("session_id", "idx", "thinking")


def q_revert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of a session before its first checkpoint (an end of compaction); sessions without one can't be reverted."""
    e = trace(spark, sf_dir)
    mark = F.min(F.when(F.col("type") == "CompactionEnd", F.col("idx"))).over(Window.partitionBy("session_id"))
    return e.withColumn("mark", mark).filter(F.col("idx") < F.col("mark")).select("session_id", "idx", "type")


def q_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of turns (depth 0), steps (1) and calls (2) in a session's timeline: by depth, then start."""
    depth = F.when(F.col("type") == "TurnBegin", 0).when(F.col("type") == "StepBegin", 1).otherwise(2)
    e = of(trace(spark, sf_dir), "TurnBegin", "StepBegin", "ToolCall").withColumn("depth", depth)
    return e.select("session_id", "idx", "depth", F.row_number().over(Window.partitionBy("session_id").orderBy("depth", "ts", "idx")).alias("position"))


def q_agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = of(trace(spark, sf_dir), "SubagentEvent")
    return e.groupBy("agent_type").agg(F.count_distinct("agent").alias("agents"), F.array_join(F.array_sort(F.collect_set("agent")), ",").alias("names"))


def q_hook_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hooks by event over two sources."""
    e = trace(spark, sf_dir)
    one, two = of(e, "ToolCall").select(F.col("tool").alias("event")), of(e, "SubagentEvent").select(F.col("agent").alias("event"))
    return one.unionByName(two).unionByName(of(e, "ToolResult").select(F.col("tool").alias("event"))).groupBy("event").agg(F.count(F.lit(1)).alias("hooks"))


def q_tool_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tools by failure rate and by number of results."""
    r = of(trace(spark, sf_dir), "ToolResult").groupBy("tool").agg(F.count(F.lit(1)).alias("results"), F.count_if("is_error").alias("failed"))
    rate = F.col("failed") / F.col("results")
    place = lambda *by: F.row_number().over(Window.orderBy(*by, "tool"))  # noqa: E731  a row a tool
    return r.select("tool", "results", "failed", place(rate.desc()).alias("by_rate"), place(F.desc("results")).alias("by_count"))


def q_usage_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results by tool with a row of all."""
    r = of(trace(spark, sf_dir), "ToolResult")
    return r.rollup("tool").agg(F.count(F.lit(1)).alias("results"), F.count_if("is_error").alias("failed")).select(F.coalesce("tool", F.lit("(all)")).alias("tool"), "results", "failed")


def q_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per path the tools that touched it, in order."""
    e = of(trace(spark, sf_dir), "ToolCall")
    order = F.array_sort(F.collect_list(F.struct("idx", "tool")))
    return e.groupBy(F.concat(F.lit("/"), "text").alias("path")).agg(F.array_join(F.transform(order, lambda x: x["tool"]), " ").alias("tools"))


_PART = "('TextPart', 'ThinkPart', 'ToolCallPart')"
_APPROVALS = f"""{TRACE_SQL}, ends AS (SELECT session_id, max(ts) AS last FROM trace GROUP BY 1), ap AS (SELECT *, lead(type) OVER w AS after, lead(ts) OVER w AS then_ FROM trace WHERE type IN ('ApprovalRequest', 'ApprovalResponse') WINDOW w AS (PARTITION BY session_id, call_id ORDER BY idx)),
approvals AS (SELECT session_id, idx, call_id, after IS NULL AS pending, round(coalesce(then_, last) - ts, 3) AS waited FROM ap JOIN ends USING (session_id) WHERE type = 'ApprovalRequest' AND (after IS NULL OR after = 'ApprovalResponse'))"""
_SPAN = """SELECT session_id, '{0}' AS kind, CAST(arg_max(level, idx) - least(0, min(level)) AS BIGINT) AS opened_alone, CAST(-least(0, min(level)) AS BIGINT) AS closed_alone FROM (SELECT *, sum(CASE WHEN type = '{0}' THEN 1 ELSE -1 END) OVER (PARTITION BY session_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS level FROM trace WHERE type IN ('{0}', '{1}')) GROUP BY 1"""
_ALONE = """SELECT session_id, '{0}' AS kind, count(*) FILTER (a AND NOT b) AS opened_alone, count(*) FILTER (b AND NOT a) AS closed_alone FROM (SELECT session_id, call_id, bool_or(type = '{0}') AS a, bool_or(type = '{1}') AS b FROM trace WHERE type IN ('{0}', '{1}') GROUP BY ALL) GROUP BY 1"""
_STEP = "sum(CASE WHEN type = 'StepBegin' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY idx ROWS UNBOUNDED PRECEDING)"
QUERIES = {
    "j09_approvals": q_approvals, "t17_pending_approvals": q_pending, "j10_integrity_pairs": q_integrity, "j12_log_to_context": q_linked, "j14_subagent_groups": q_subagents, "w09_part_spans": q_spans, "w10_open_call": q_open_call, "w11_thinking": q_thinking,
    "w16_revert": q_revert, "t15_timeline_order": q_timeline, "g12_agents_by_type": q_agents, "g18_hook_counts": q_hook_counts, "t11_tool_order": q_tool_order, "g08_usage_total": q_usage_total, "g22_changes": q_changes,
}
ORACLES = {
    "j09_approvals": f"WITH {_APPROVALS} SELECT * FROM approvals",
    "t17_pending_approvals": f"WITH {_APPROVALS} SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY idx) AS position, idx, call_id FROM approvals WHERE pending",
    "j10_integrity_pairs": f"WITH {TRACE_SQL} " + " UNION ALL ".join([_SPAN.format(*x) for x in SPANS] + [_ALONE.format(*x) for x in PAIRS]),
    "j12_log_to_context": f"WITH {TRACE_SQL} SELECT session_id, call_id, max(idx) FILTER (type = 'ToolCall') AS event_idx, max(idx) FILTER (type = 'ToolResult') AS message_idx FROM trace GROUP BY ALL HAVING event_idx IS NOT NULL AND message_idx IS NOT NULL",
    "j14_subagent_groups": f"WITH {TRACE_SQL}, s AS (SELECT *, CAST({_STEP} AS BIGINT) AS step FROM trace) SELECT session_id, step, call_id AS parent_id, count(*) AS events, string_agg(agent, ',' ORDER BY idx) AS agents FROM s WHERE type = 'SubagentEvent' GROUP BY ALL",
    "w09_part_spans": f"""WITH {TRACE_SQL}, n AS (SELECT *, (SELECT min(idx) FROM trace c WHERE c.session_id = t.session_id AND c.idx > t.idx AND c.type NOT IN {_PART}) AS close FROM trace t WHERE type IN ('TextPart', 'ThinkPart')),
g AS (SELECT session_id, close, min(idx) AS first_idx, arg_min(type, idx) AS label, arg_min(ts, idx) AS start FROM n WHERE close IS NOT NULL GROUP BY ALL) SELECT g.session_id, first_idx, label, round(t.ts - start, 3) AS seconds FROM g JOIN trace t ON t.session_id = g.session_id AND t.idx = g.close WHERE t.ts - start > 0.001""",
    "w10_open_call": f"""WITH {TRACE_SQL}, c AS (SELECT session_id, idx, call_id, (SELECT min(idx) FROM trace r WHERE r.session_id = t.session_id AND r.type = 'ToolResult' AND r.call_id = t.call_id AND r.idx > t.idx) AS close FROM trace t WHERE type = 'ToolCall'),
p AS (SELECT session_id, idx FROM trace WHERE type = 'ToolCallPart') SELECT p.session_id, p.idx, max(c.idx) AS call_idx, arg_max(c.call_id, c.idx) AS call_id FROM p LEFT JOIN c ON c.session_id = p.session_id AND c.idx < p.idx AND (c.close IS NULL OR c.close > p.idx) GROUP BY ALL""",
    "w11_thinking": f"""WITH {TRACE_SQL}, c AS (SELECT session_id, idx, coalesce(lag(idx) OVER (PARTITION BY session_id ORDER BY idx), -1) AS before, type FROM trace WHERE type IN ('ToolCall', 'TurnBegin'))
SELECT c.session_id, c.idx, coalesce(string_agg(t.text, ' ' ORDER BY t.idx), '') AS thinking FROM c LEFT JOIN trace t ON t.session_id = c.session_id AND t.type = 'ThinkPart' AND t.idx > c.before AND t.idx < c.idx WHERE c.type = 'ToolCall' GROUP BY ALL""",
    "w16_revert": f"WITH {TRACE_SQL}, m AS (SELECT session_id, min(idx) AS mark FROM trace WHERE type = 'CompactionEnd' GROUP BY 1) SELECT session_id, idx, type FROM trace JOIN m USING (session_id) WHERE idx < mark",
    "t15_timeline_order": f"WITH {TRACE_SQL}, d AS (SELECT *, CASE type WHEN 'TurnBegin' THEN 0 WHEN 'StepBegin' THEN 1 ELSE 2 END AS depth FROM trace WHERE type IN ('TurnBegin', 'StepBegin', 'ToolCall')) SELECT session_id, idx, depth, row_number() OVER (PARTITION BY session_id ORDER BY depth, ts, idx) AS position FROM d",
    "g12_agents_by_type": f"WITH {TRACE_SQL} SELECT agent_type, count(DISTINCT agent) AS agents, string_agg(DISTINCT agent, ',' ORDER BY agent) AS names FROM trace WHERE type = 'SubagentEvent' GROUP BY 1",
    "g18_hook_counts": f"WITH {TRACE_SQL} SELECT CASE WHEN type = 'SubagentEvent' THEN agent ELSE tool END AS event, count(*) AS hooks FROM trace WHERE type IN ('ToolCall', 'ToolResult', 'SubagentEvent') GROUP BY 1",
    "t11_tool_order": f"WITH {TRACE_SQL}, r AS (SELECT tool, count(*) AS results, count(*) FILTER (is_error) AS failed FROM trace WHERE type = 'ToolResult' GROUP BY 1) SELECT *, row_number() OVER (ORDER BY failed / results DESC, tool) AS by_rate, row_number() OVER (ORDER BY results DESC, tool) AS by_count FROM r",
    "g08_usage_total": f"WITH {TRACE_SQL} SELECT coalesce(tool, '(all)') AS tool, count(*) AS results, count(*) FILTER (is_error) AS failed FROM trace WHERE type = 'ToolResult' GROUP BY ROLLUP (tool)",
    "g22_changes": f"WITH {TRACE_SQL} SELECT '/' || text AS path, string_agg(tool, ' ' ORDER BY idx) AS tools FROM trace WHERE type = 'ToolCall' GROUP BY 1",
}
