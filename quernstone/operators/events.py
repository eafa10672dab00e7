"""Event-log analytics: pairing, turns, running totals, outliers, gaps, integrity.

Rows are (session_id, idx, ts, type, ...) in order of idx within a session. Every order-sensitive rule is a
window over one session, so sessions are independent and nothing is sorted as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from ..sources.tables import WIRE_SQL, wire


def in_session() -> WindowSpec:
    return Window.partitionBy("session_id").orderBy("idx")


def so_far() -> WindowSpec:
    return in_session().rowsBetween(Window.unboundedPreceding, 0)


def pairs(events: DataFrame) -> DataFrame:
    """Calls with their results: a result closes the nearest earlier call of its id if that is still open."""
    both = events.filter(F.col("type").isin("ToolCall", "ToolResult"))
    last = Window.partitionBy("session_id", "call_id").orderBy("idx")
    before = F.lag("type").over(last) == "ToolCall"
    return (
        both.withColumn("_open", before)
        .withColumn("call_ts", F.lag("ts").over(last))
        .withColumn("call_idx", F.lag("idx").over(last))
        .withColumn("call_tool", F.lag("tool").over(last))
        .filter((F.col("type") == "ToolResult") & F.col("_open"))
        .select("session_id", "call_id", "call_idx", F.col("idx").alias("result_idx"), F.col("call_tool").alias("tool"), "is_error", F.greatest(F.lit(0.0), F.col("ts") - F.col("call_ts")).alias("duration"))
    )


def q_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(wire(spark, sf_dir)).withColumn("duration", F.round("duration", 3))


def q_tool_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per tool: calls, results, failures, rate and durations."""
    e = wire(spark, sf_dir)
    calls = e.filter("type = 'ToolCall'").groupBy("tool").agg(F.count(F.lit(1)).alias("calls"))
    done = pairs(e).groupBy("tool").agg(
        F.count_if(~F.col("is_error")).alias("succeeded"), F.count_if("is_error").alias("failed"),
        F.round(F.avg("duration"), 3).alias("avg_s"), F.round(F.min("duration"), 3).alias("min_s"), F.round(F.max("duration"), 3).alias("max_s"),
    )
    total = F.col("succeeded") + F.col("failed")
    return calls.join(done, "tool", "left").withColumn("failure_rate", F.round(F.when(total > 0, 100 * F.col("failed") / total).otherwise(0.0), 4))


def q_last_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each call with the last result of its id, whatever their order; calls without one stay."""
    e = wire(spark, sf_dir)
    last = e.filter("type = 'ToolResult'").groupBy("session_id", "call_id").agg(F.max_by(F.struct("idx", "is_error"), "idx").alias("r"))
    return e.filter("type = 'ToolCall'").join(last, ["session_id", "call_id"], "left").select("session_id", "idx", "call_id", F.col("r.idx").alias("result_idx"), F.coalesce("r.is_error", F.lit(False)).alias("failed"))


def q_first_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First call and first result of each id; the duration may be negative and is null when unmatched."""
    e = wire(spark, sf_dir).filter(F.col("type").isin("ToolCall", "ToolResult"))
    first = lambda kind: F.min_by(F.when(F.col("type") == kind, F.col("ts")), F.when(F.col("type") == kind, F.col("idx")))
    return e.groupBy("session_id", "call_id").agg(first("ToolCall").alias("a"), first("ToolResult").alias("b")).select("session_id", "call_id", F.round(F.col("b") - F.col("a"), 3).alias("duration"))


def turns(events: DataFrame) -> DataFrame:
    return events.withColumn("turn", F.sum((F.col("type") == "TurnBegin").cast("long")).over(so_far()))


def q_turn_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turn and step number of every event; steps start anew with a turn."""
    t = turns(wire(spark, sf_dir))
    step = F.sum((F.col("type") == "StepBegin").cast("long")).over(Window.partitionBy("session_id", "turn").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0))
    return t.select("session_id", "idx", "turn", step.alias("step"))


def turn_metrics(events: DataFrame) -> DataFrame:
    """Turns that end, by TurnEnd or with the session; a new TurnBegin discards an open turn."""
    t = turns(events).filter("turn > 0")
    end = F.min(F.when(F.col("type") == "TurnEnd", F.col("idx"))).over(Window.partitionBy("session_id", "turn"))
    last = F.max("turn").over(Window.partitionBy("session_id"))
    t = t.withColumn("_end", end).withColumn("_last", last)
    t = t.filter((F.col("_end").isNotNull() & (F.col("idx") <= F.col("_end"))) | (F.col("_end").isNull() & (F.col("turn") == F.col("_last"))))
    return t.groupBy("session_id", "turn").agg(
        F.count_if(F.col("type") == "StepBegin").alias("steps"), F.count_if(F.col("type") == "ToolCall").alias("tool_calls"),
        F.sum(F.when(F.col("type") == "StatusUpdate", F.col("tokens_in")).otherwise(0)).alias("input_tokens"),
        F.sum(F.when(F.col("type") == "StatusUpdate", F.col("tokens_out")).otherwise(0)).alias("output_tokens"),
        F.greatest(F.lit(0.0), F.max_by("ts", "idx") - F.min_by("ts", "idx")).alias("duration"),
    )


def q_turn_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_metrics(wire(spark, sf_dir)).withColumn("duration", F.round("duration", 3))


def q_turn_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns whose steps or tokens exceed the session's mean by more than two deviations."""
    m = turn_metrics(wire(spark, sf_dir)).withColumn("tokens", F.col("input_tokens") + F.col("output_tokens"))
    w = Window.partitionBy("session_id")

    def above(c: str) -> Column:
        sigma = F.stddev_pop(c).over(w)
        return (sigma > 1e-9) & (F.col(c) > F.avg(c).over(w) + 2 * sigma + 1e-9)

    return m.select("session_id", "turn", above("steps").alias("steps_high"), above("tokens").alias("tokens_high"))


def q_running_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = lambda c: F.sum(F.when(F.col("type") == "StatusUpdate", F.col(c)).otherwise(0)).over(so_far())
    return wire(spark, sf_dir).select("session_id", "idx", used("tokens_in").alias("total_in"), used("tokens_out").alias("total_out"))


def q_call_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens used between a call and its result, summed by tool: the running total as of each, no range join."""
    e = wire(spark, sf_dir)
    running = F.sum(F.when(F.col("type") == "StatusUpdate", F.col("tokens_in") + F.col("tokens_out")).otherwise(0)).over(so_far())
    totals = e.select("session_id", "idx", running.alias("total"))
    p = pairs(e).join(totals.withColumnsRenamed({"idx": "call_idx", "total": "t0"}), ["session_id", "call_idx"]).join(totals.withColumnsRenamed({"idx": "result_idx", "total": "t1"}), ["session_id", "result_idx"])
    return p.groupBy("tool").agg(F.sum(F.greatest(F.lit(0), F.col("t1") - F.col("t0"))).alias("tokens"), F.count(F.lit(1)).alias("pairs"))


def q_cost_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by tool with a row of all; what parallel calls span counts for each of them."""
    by_tool = q_call_cost(spark, sf_dir)
    return by_tool.rollup("tool").agg(F.sum("tokens").alias("tokens"), F.sum("pairs").alias("pairs")).select(F.coalesce("tool", F.lit("(all)")).alias("tool"), "tokens", "pairs")


def q_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Begin and end balance with a counter that never falls below zero, calls and results without the other, score."""
    e = wire(spark, sf_dir)
    sign = F.when(F.col("type") == "TurnBegin", 1).when(F.col("type") == "TurnEnd", -1).otherwise(0)
    level = F.sum(sign).over(so_far())
    t = e.withColumn("level", level)
    low = t.groupBy("session_id").agg(F.least(F.lit(0), F.min("level")).alias("low"), F.max_by("level", "idx").alias("last"), F.count_if(F.col("type").isin("TurnBegin", "TurnEnd")).alias("marks"))
    low = low.select("session_id", (-F.col("low")).alias("orphan_ends"), (F.col("last") - F.col("low")).alias("unclosed"), "marks")
    ids = e.filter(F.col("type").isin("ToolCall", "ToolResult")).groupBy("session_id", "call_id").agg(F.count_if(F.col("type") == "ToolCall").alias("c"), F.count_if(F.col("type") == "ToolResult").alias("r"))
    ids = ids.groupBy("session_id").agg(F.count_if(F.col("r") == 0).alias("calls_alone"), F.count_if(F.col("c") == 0).alias("results_alone"), F.sum(F.col("c") + F.col("r")).alias("ids"))
    out = low.join(ids, "session_id", "left").na.fill(0)
    orphans = F.col("orphan_ends") + F.col("unclosed") + F.col("calls_alone") + F.col("results_alone")
    score = F.floor((1 - orphans / F.greatest(F.col("marks") + F.col("ids"), F.lit(1))) * 100 + 0.5).cast("long")
    return out.select("session_id", "orphan_ends", "unclosed", "calls_alone", "results_alone", score.alias("score"))


def q_gaps(spark: SparkSession, sf_dir: str, seconds: float = 5000.0) -> DataFrame:
    """Pauses between one finished call's end and the next call's start, in order of start."""
    e = wire(spark, sf_dir)
    p = pairs(e).join(e.select("session_id", F.col("idx").alias("call_idx"), F.col("ts").alias("start")), ["session_id", "call_idx"])
    w = Window.partitionBy("session_id").orderBy("start", "call_idx")
    gap = F.col("start") - F.lag(F.col("start") + F.col("duration")).over(w)
    return p.withColumn("gap", F.round(gap, 3)).filter(F.col("gap") > seconds).select("session_id", "call_idx", "gap")


def q_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time since the event before, where it is over a second."""
    delta = F.round(F.col("ts") - F.lag("ts").over(in_session()), 3)
    return wire(spark, sf_dir).select("session_id", "idx", delta.alias("delta")).filter("delta > 1")


def q_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.count(F.lit(1)).over(Window.partitionBy("session_id"))
    return wire(spark, sf_dir).select("session_id", "idx", F.round(F.when(n > 1, (F.row_number().over(in_session()) - 1) / (n - 1)).otherwise(0.5), 8).alias("x"))


def q_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of calls of the same tool one after another."""
    calls = wire(spark, sf_dir).filter("type = 'ToolCall'")
    change = F.coalesce((F.col("tool") != F.lag("tool").over(in_session())).cast("int"), F.lit(1))
    runs = calls.withColumn("c", change).withColumn("run", F.sum("c").over(so_far()))
    return runs.groupBy("session_id", "run", "tool").agg(F.count(F.lit(1)).alias("length"), F.min("idx").alias("first_idx"))


def q_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls repeated within a step, and those whose key an earlier step has seen."""
    t = wire(spark, sf_dir).withColumn("step", F.sum((F.col("type") == "StepBegin").cast("long")).over(so_far())).filter("type = 'ToolCall'")
    within = F.row_number().over(Window.partitionBy("session_id", "step", "call_id", "tool").orderBy("idx")) > 1
    across = F.min("step").over(Window.partitionBy("session_id", "call_id", "tool")) < F.col("step")
    return t.select("session_id", "idx", within.alias("in_step"), across.alias("seen_before"))


def q_session_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("type")
    failed = ((kind == "ToolResult") & F.col("is_error")) | (kind == "StepInterrupted")
    return wire(spark, sf_dir).groupBy("session_id").agg(
        F.count(F.lit(1)).alias("events"), F.count_if(kind == "TurnBegin").alias("turns"), F.count_if(kind == "StepBegin").alias("steps"), F.count_if(kind == "ToolCall").alias("tool_calls"),
        F.count_if(failed).alias("errors"), F.round(F.max_by("ts", "idx") - F.min_by("ts", "idx"), 3).alias("duration"),
        F.sum(F.when(kind == "StatusUpdate", F.col("tokens_in") + F.col("tokens_out")).otherwise(0)).alias("tokens"),
    )


def q_daily(spark: SparkSession, sf_dir: str, days: int = 30) -> DataFrame:
    """Events, sessions and errors of the last days that have any."""
    e = wire(spark, sf_dir).withColumn("day", F.date_format(F.timestamp_seconds(F.floor("ts")), "yyyy-MM-dd"))
    failed = ((F.col("type") == "ToolResult") & F.col("is_error")) | (F.col("type") == "StepInterrupted")
    return e.groupBy("day").agg(F.count(F.lit(1)).alias("events"), F.count_distinct("session_id").alias("sessions"), F.count_if(failed).alias("errors")).orderBy(F.desc("day")).limit(days)


def q_tool_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wire(spark, sf_dir).filter("type = 'ToolCall'").groupBy("tool").agg(F.count(F.lit(1)).alias("calls")).orderBy(F.desc("calls"), "tool").limit(20)


def q_event_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed events whose tool or type holds a search text."""
    failed = ((F.col("type") == "ToolResult") & F.col("is_error")) | (F.col("type") == "StepInterrupted")
    return wire(spark, sf_dir).filter(failed & F.lower(F.concat_ws(" ", "type", "tool")).contains("tool3")).select("session_id", "idx", "type", "tool")


def q_event_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wire(spark, sf_dir).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def q_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last time by order of lines, not by value."""
    return wire(spark, sf_dir).groupBy("session_id").agg(F.round(F.min_by("ts", "idx"), 3).alias("first_ts"), F.round(F.max_by("ts", "idx"), 3).alias("last_ts"))


def q_summary_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("type")
    text = F.when(kind == "ToolCall", F.concat(F.lit("call "), "tool", F.lit(" "), "call_id")).when(kind == "ToolResult", F.concat(F.when(F.col("is_error"), "error ").otherwise("ok "), "call_id")).when(kind == "StatusUpdate", F.concat(F.lit("tokens "), F.col("tokens_in").cast("string"))).otherwise(kind)
    return wire(spark, sf_dir).select("session_id", "idx", F.substring(text, 1, 100).alias("summary"))


def q_truncate_turn(spark: SparkSession, sf_dir: str, turn: int = 2) -> DataFrame:
    """Each session's log up to the end of a turn (0-based)."""
    t = turns(wire(spark, sf_dir))
    end = F.min(F.when((F.col("turn") == turn + 1) & (F.col("type") == "TurnEnd"), F.col("idx"))).over(Window.partitionBy("session_id"))
    return t.withColumn("_end", end).filter((F.col("turn") <= turn + 1) & (F.col("_end").isNull() | (F.col("idx") <= F.col("_end")))).select("session_id", "idx", "type")


def q_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events since a session's last StatusUpdate and what it reported."""
    e = wire(spark, sf_dir)
    last = e.filter("type = 'StatusUpdate'").groupBy("session_id").agg(F.max("idx").alias("at"), F.max_by("tokens_in", "idx").alias("reported"))
    return e.join(last, "session_id", "left").groupBy("session_id").agg(F.count_if(F.col("at").isNull() | (F.col("idx") > F.col("at"))).alias("pending"), F.coalesce(F.max("reported"), F.lit(0)).alias("reported"))


def q_merge_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Call to result ranges of idx, merged where they touch."""
    p = pairs(wire(spark, sf_dir)).select("session_id", F.col("call_idx").alias("a"), F.col("result_idx").alias("b"))
    w = Window.partitionBy("session_id").orderBy("a", "b")
    reach = F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1))
    p = p.withColumn("new", F.coalesce((F.col("a") > reach + 1).cast("int"), F.lit(1)))
    p = p.withColumn("part", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return p.groupBy("session_id", "part").agg(F.min("a").alias("start_idx"), F.max("b").alias("end_idx"), F.count(F.lit(1)).alias("merged")).drop("part")


QUERIES = {
    "j07_call_result_pairs": q_pairs, "j08_last_result": q_last_result, "j21_first_pair": q_first_pair, "j11_call_token_cost": q_call_cost, "g08_cost_total": q_cost_total, "g05_tool_stats": q_tool_stats, "g06_turn_metrics": q_turn_metrics,
    "w04_turn_outliers": q_turn_outliers, "w01_turn_step_numbers": q_turn_numbers, "w03_running_tokens": q_running_tokens, "w05_gaps": q_gaps, "w06_integrity": q_integrity, "w07_merged_intervals": q_merge_intervals,
    "w08_time_deltas": q_deltas, "w15_truncate_at_turn": q_truncate_turn, "w17_pending_since_usage": q_pending, "w19_event_ordinal": q_ordinal, "w21_call_runs": q_runs, "w22_duplicate_calls": q_duplicates,
    "g13_session_summary": q_session_summary, "g14_daily_usage": q_daily, "g14_tool_usage": q_tool_usage, "g20_event_types": q_event_types, "g27_session_bounds": q_bounds, "b14_event_filter": q_event_filter, "b24_event_summary": q_summary_text,
}

_PAIRS = """
p0 AS (SELECT *, lag(type) OVER w AS pt, lag(ts) OVER w AS call_ts, lag(idx) OVER w AS call_idx, lag(tool) OVER w AS call_tool FROM wire WHERE type IN ('ToolCall', 'ToolResult') WINDOW w AS (PARTITION BY session_id, call_id ORDER BY idx)),
pairs AS (SELECT session_id, call_id, call_idx, idx AS result_idx, call_tool AS tool, is_error, greatest(0.0, ts - call_ts) AS duration FROM p0 WHERE type = 'ToolResult' AND pt = 'ToolCall')"""
_TURNS = "turns AS (SELECT *, CAST(sum(CASE WHEN type = 'TurnBegin' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS BIGINT) AS turn FROM wire)"
_METRICS = f"""{_TURNS}, tm0 AS (SELECT *, min(CASE WHEN type = 'TurnEnd' THEN idx END) OVER (PARTITION BY session_id, turn) AS e, max(turn) OVER (PARTITION BY session_id) AS l FROM turns WHERE turn > 0),
metrics AS (SELECT session_id, turn, count(*) FILTER (type = 'StepBegin') AS steps, count(*) FILTER (type = 'ToolCall') AS tool_calls, CAST(sum(CASE WHEN type = 'StatusUpdate' THEN tokens_in ELSE 0 END) AS BIGINT) AS input_tokens,
  CAST(sum(CASE WHEN type = 'StatusUpdate' THEN tokens_out ELSE 0 END) AS BIGINT) AS output_tokens, greatest(0.0, max_by(ts, idx) - min_by(ts, idx)) AS duration
  FROM tm0 WHERE (e IS NOT NULL AND idx <= e) OR (e IS NULL AND turn = l) GROUP BY ALL)"""
_FAILED = "((type = 'ToolResult' AND is_error) OR type = 'StepInterrupted')"
_W = f"WITH {WIRE_SQL}"
_RUN = "OVER (PARTITION BY session_id ORDER BY idx ROWS UNBOUNDED PRECEDING)"
ORACLES = {
    "j07_call_result_pairs": f"{_W}, {_PAIRS} SELECT * REPLACE (round(duration, 3) AS duration) FROM pairs",
    "j08_last_result": f"{_W}, l AS (SELECT session_id, call_id, max(idx) AS result_idx, max_by(is_error, idx) AS f FROM wire WHERE type = 'ToolResult' GROUP BY ALL) SELECT session_id, idx, call_id, result_idx, coalesce(f, false) AS failed FROM wire LEFT JOIN l USING (session_id, call_id) WHERE type = 'ToolCall'",
    "j21_first_pair": f"{_W} SELECT session_id, call_id, round(min_by(ts, idx) FILTER (type = 'ToolResult') - min_by(ts, idx) FILTER (type = 'ToolCall'), 3) AS duration FROM wire WHERE type IN ('ToolCall', 'ToolResult') GROUP BY ALL",
    "j11_call_token_cost": f"{_W}, {_PAIRS}, t AS (SELECT session_id, idx, sum(CASE WHEN type = 'StatusUpdate' THEN tokens_in + tokens_out ELSE 0 END) {_RUN} AS total FROM wire) SELECT tool, CAST(sum(greatest(0, b.total - a.total)) AS BIGINT) AS tokens, count(*) AS pairs FROM pairs JOIN t a ON a.session_id = pairs.session_id AND a.idx = call_idx JOIN t b ON b.session_id = pairs.session_id AND b.idx = result_idx GROUP BY tool",
    "g08_cost_total": f"{_W}, {_PAIRS}, t AS (SELECT session_id, idx, sum(CASE WHEN type = 'StatusUpdate' THEN tokens_in + tokens_out ELSE 0 END) {_RUN} AS total FROM wire) SELECT coalesce(tool, '(all)') AS tool, CAST(sum(greatest(0, b.total - a.total)) AS BIGINT) AS tokens, count(*) AS pairs FROM pairs JOIN t a ON a.session_id = pairs.session_id AND a.idx = call_idx JOIN t b ON b.session_id = pairs.session_id AND b.idx = result_idx GROUP BY ROLLUP (tool)",
    "g05_tool_stats": f"{_W}, {_PAIRS}, c AS (SELECT tool, count(*) AS calls FROM wire WHERE type = 'ToolCall' GROUP BY tool), d AS (SELECT tool, count(*) FILTER (NOT is_error) AS succeeded, count(*) FILTER (is_error) AS failed, round(avg(duration), 3) AS avg_s, round(min(duration), 3) AS min_s, round(max(duration), 3) AS max_s FROM pairs GROUP BY tool) SELECT c.tool, calls, succeeded, failed, avg_s, min_s, max_s, round(CASE WHEN succeeded + failed > 0 THEN 100 * failed / (succeeded + failed) ELSE 0 END, 4) AS failure_rate FROM c LEFT JOIN d USING (tool)",
    "g06_turn_metrics": f"{_W}, {_METRICS} SELECT * REPLACE (round(duration, 3) AS duration) FROM metrics",
    "w04_turn_outliers": f"{_W}, {_METRICS}, m AS (SELECT *, input_tokens + output_tokens AS tokens FROM metrics) SELECT session_id, turn, stddev_pop(steps) OVER w > 1e-9 AND steps > avg(steps) OVER w + 2 * stddev_pop(steps) OVER w + 1e-9 AS steps_high, stddev_pop(tokens) OVER w > 1e-9 AND tokens > avg(tokens) OVER w + 2 * stddev_pop(tokens) OVER w + 1e-9 AS tokens_high FROM m WINDOW w AS (PARTITION BY session_id)",
    "w01_turn_step_numbers": f"{_W}, {_TURNS} SELECT session_id, idx, turn, CAST(sum(CASE WHEN type = 'StepBegin' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id, turn ORDER BY idx ROWS UNBOUNDED PRECEDING) AS BIGINT) AS step FROM turns",
    "w03_running_tokens": f"{_W} SELECT session_id, idx, CAST(sum(CASE WHEN type = 'StatusUpdate' THEN tokens_in ELSE 0 END) {_RUN} AS BIGINT) AS total_in, CAST(sum(CASE WHEN type = 'StatusUpdate' THEN tokens_out ELSE 0 END) {_RUN} AS BIGINT) AS total_out FROM wire",
    "w05_gaps": f"{_W}, {_PAIRS}, s AS (SELECT pairs.*, wire.ts AS start FROM pairs JOIN wire ON wire.session_id = pairs.session_id AND wire.idx = call_idx), g AS (SELECT session_id, call_idx, round(start - lag(start + duration) OVER (PARTITION BY session_id ORDER BY start, call_idx), 3) AS gap FROM s) SELECT * FROM g WHERE gap > 5000",
    "w06_integrity": f"""{_W}, l AS (SELECT *, sum(CASE WHEN type = 'TurnBegin' THEN 1 WHEN type = 'TurnEnd' THEN -1 ELSE 0 END) {_RUN} AS level FROM wire),
b AS (SELECT session_id, CAST(-least(0, min(level)) AS BIGINT) AS orphan_ends, CAST(max_by(level, idx) - least(0, min(level)) AS BIGINT) AS unclosed, count(*) FILTER (type IN ('TurnBegin', 'TurnEnd')) AS marks FROM l GROUP BY session_id),
i AS (SELECT session_id, call_id, count(*) FILTER (type = 'ToolCall') AS c, count(*) FILTER (type = 'ToolResult') AS r FROM wire WHERE type IN ('ToolCall', 'ToolResult') GROUP BY ALL),
j AS (SELECT session_id, count(*) FILTER (r = 0) AS ca, count(*) FILTER (c = 0) AS ra, CAST(sum(c + r) AS BIGINT) AS ids FROM i GROUP BY session_id)
SELECT b.session_id, orphan_ends, unclosed, coalesce(ca, 0) AS calls_alone, coalesce(ra, 0) AS results_alone, CAST(floor((1 - (orphan_ends + unclosed + coalesce(ca, 0) + coalesce(ra, 0)) / greatest(marks + coalesce(ids, 0), 1)) * 100 + 0.5) AS BIGINT) AS score FROM b LEFT JOIN j USING (session_id)""",
    "w07_merged_intervals": f"""{_W}, {_PAIRS}, r AS (SELECT session_id, call_idx AS a, result_idx AS b, max(result_idx) OVER (PARTITION BY session_id ORDER BY call_idx, result_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM pairs),
n AS (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS part FROM r) SELECT session_id, min(a) AS start_idx, max(b) AS end_idx, count(*) AS merged FROM n GROUP BY session_id, part""",
    "w08_time_deltas": f"{_W}, d AS (SELECT session_id, idx, round(ts - lag(ts) OVER (PARTITION BY session_id ORDER BY idx), 3) AS delta FROM wire) SELECT * FROM d WHERE delta > 1",
    "w15_truncate_at_turn": f"{_W}, {_TURNS}, t AS (SELECT *, min(CASE WHEN turn = 3 AND type = 'TurnEnd' THEN idx END) OVER (PARTITION BY session_id) AS e FROM turns) SELECT session_id, idx, type FROM t WHERE turn <= 3 AND (e IS NULL OR idx <= e)",
    "w17_pending_since_usage": f"{_W}, l AS (SELECT session_id, max(idx) AS last_at, max_by(tokens_in, idx) AS reported FROM wire WHERE type = 'StatusUpdate' GROUP BY session_id) SELECT wire.session_id, count(*) FILTER (last_at IS NULL OR idx > last_at) AS pending, coalesce(max(reported), 0) AS reported FROM wire LEFT JOIN l USING (session_id) GROUP BY 1",
    "w19_event_ordinal": f"{_W} SELECT session_id, idx, round(CASE WHEN count(*) OVER (PARTITION BY session_id) > 1 THEN (row_number() OVER (PARTITION BY session_id ORDER BY idx) - 1) / (count(*) OVER (PARTITION BY session_id) - 1) ELSE 0.5 END, 8) AS x FROM wire",
    "w21_call_runs": f"{_W}, c AS (SELECT *, CASE WHEN tool = lag(tool) OVER (PARTITION BY session_id ORDER BY idx) THEN 0 ELSE 1 END AS c FROM wire WHERE type = 'ToolCall'), r AS (SELECT *, CAST(sum(c) {_RUN} AS BIGINT) AS run FROM c) SELECT session_id, run, tool, count(*) AS length, min(idx) AS first_idx FROM r GROUP BY ALL",
    "w22_duplicate_calls": f"{_W}, s AS (SELECT *, sum(CASE WHEN type = 'StepBegin' THEN 1 ELSE 0 END) {_RUN} AS step FROM wire) SELECT session_id, idx, row_number() OVER (PARTITION BY session_id, step, call_id, tool ORDER BY idx) > 1 AS in_step, min(step) OVER (PARTITION BY session_id, call_id, tool) < step AS seen_before FROM s WHERE type = 'ToolCall'",
    "g13_session_summary": f"{_W} SELECT session_id, count(*) AS events, count(*) FILTER (type = 'TurnBegin') AS turns, count(*) FILTER (type = 'StepBegin') AS steps, count(*) FILTER (type = 'ToolCall') AS tool_calls, count(*) FILTER ({_FAILED}) AS errors, round(max_by(ts, idx) - min_by(ts, idx), 3) AS duration, CAST(sum(CASE WHEN type = 'StatusUpdate' THEN tokens_in + tokens_out ELSE 0 END) AS BIGINT) AS tokens FROM wire GROUP BY session_id",
    "g14_daily_usage": f"{_W} SELECT strftime(make_timestamp(CAST(floor(ts) AS BIGINT) * 1000000), '%Y-%m-%d') AS day, count(*) AS events, count(DISTINCT session_id) AS sessions, count(*) FILTER ({_FAILED}) AS errors FROM wire GROUP BY day ORDER BY day DESC LIMIT 30",
    "g14_tool_usage": f"{_W} SELECT tool, count(*) AS calls FROM wire WHERE type = 'ToolCall' GROUP BY tool ORDER BY calls DESC, tool LIMIT 20",
    "g20_event_types": f"{_W} SELECT type, count(*) AS n FROM wire GROUP BY type",
    "g27_session_bounds": f"{_W} SELECT session_id, round(min_by(ts, idx), 3) AS first_ts, round(max_by(ts, idx), 3) AS last_ts FROM wire GROUP BY session_id",
    "b14_event_filter": f"{_W} SELECT session_id, idx, type, tool FROM wire WHERE {_FAILED} AND contains(lower(type || ' ' || tool), 'tool3')",
    "b24_event_summary": f"{_W} SELECT session_id, idx, left(CASE type WHEN 'ToolCall' THEN 'call ' || tool || ' ' || call_id WHEN 'ToolResult' THEN CASE WHEN is_error THEN 'error ' ELSE 'ok ' END || call_id WHEN 'StatusUpdate' THEN 'tokens ' || tokens_in ELSE type END, 100) AS summary FROM wire",
}
