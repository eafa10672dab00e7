"""Stateful folds over event streams: merging adjacent parts, a notification queue, incremental indexing.

The batch form and the streaming form of the merge share one function, so their results are equal.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..plans.shipping import ship
from ..sources.tables import wire

MERGED = "session_id long, first_idx long, type string, parts long, tokens long"


def fold(rows: Iterable[tuple], open_: tuple | None) -> tuple[list[tuple], tuple | None]:
    """Runs of StatusUpdate rows become one; any other row closes a run. rows: (session_id, idx, type, tokens) in order."""
    out = []
    for session, idx, kind, tokens in rows:
        if kind == "StatusUpdate":
            open_ = (session, open_[1], kind, open_[3] + 1, open_[4] + tokens) if open_ else (session, idx, kind, 1, tokens)
            continue
        if open_:
            out.append(open_)
            open_ = None
        out.append((session, idx, kind, 1, tokens))
    return out, open_


def _rows(pdf: pd.DataFrame) -> list[tuple]:
    return list(pdf.sort_values("idx")[["session_id", "idx", "type", "tokens_in"]].itertuples(index=False, name=None))


_NAMES = ["session_id", "first_idx", "type", "parts", "tokens"]


def merge_batch(events: DataFrame) -> DataFrame:
    """The fold as islands: built-in windows only."""
    from pyspark.sql import Window

    w = Window.partitionBy("session_id").orderBy("idx")
    part = F.col("type") == "StatusUpdate"
    new = F.when(part & (F.lag("type").over(w) == "StatusUpdate"), 0).otherwise(1)
    rows = events.withColumn("new", new).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("session_id", "run", "type").agg(F.min("idx").alias("first_idx"), F.count(F.lit(1)).alias("parts"), F.sum("tokens_in").alias("tokens")).select(*_NAMES)


def merge_stream(events: DataFrame) -> DataFrame:
    """The same over a stream; an open run waits in the session's state until an event closes it. A row of type End flushes."""
    ship(events.sparkSession)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        open_ = tuple(state.get) if state.exists else None
        rows = [r for pdf in batches for r in _rows(pdf)]
        out, open_ = fold(sorted(rows, key=lambda r: r[1]), open_)
        if open_:
            state.update(open_)
        elif state.exists:
            state.remove()
        yield pd.DataFrame([r for r in out if r[2] != "End"], columns=_NAMES)

    return events.groupBy("session_id").applyInPandasWithState(step, MERGED, MERGED, "append", GroupStateTimeout.NoTimeout)


def claim(queue: DataFrame, now: float, stale: float = 60.0, limit: int = 8) -> DataFrame:
    """A queue (id, created_at, status, claimed_at) with the oldest pending ones claimed; stale claims are pending again first."""
    from pyspark.sql import Window

    ready = F.when((F.col("status") == "claimed") & (F.col("claimed_at") < now - stale), "pending").otherwise(F.col("status"))
    q = queue.withColumn("status", ready)
    first = q.filter("status = 'pending'").orderBy("created_at", "id").limit(limit).select("id", F.lit(True).alias("_now"))
    q = q.join(F.broadcast(first), "id", "left")  # at most `limit` rows
    return q.select("id", "created_at", F.when(F.col("_now"), "claimed").otherwise(F.col("status")).alias("status"), F.when(F.col("_now"), F.lit(now)).otherwise(F.col("claimed_at")).alias("claimed_at"))


def index_stream(docs: DataFrame, path: str, checkpoint: str):
    """Append each micro-batch's postings to an index; statistics are left to readers."""
    from ..operators.retrieval import doc_lengths, postings

    def add(batch: DataFrame, _id: int) -> None:
        postings(batch).write.mode("append").parquet(f"{path}/postings")
        doc_lengths(batch).write.mode("append").parquet(f"{path}/lengths")

    return docs.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def q_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_batch(wire(spark, sf_dir))


def q_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Click events as notifications: some done, some claimed long ago."""
    e = wire(spark, sf_dir).filter("type = 'ToolCall'")
    status = F.when(F.col("tokens_in") % 3 == 0, "acked").when(F.col("tokens_in") % 3 == 1, "claimed").otherwise("pending")
    queue = e.select(F.col("idx").alias("id"), F.col("idx").cast("double").alias("created_at"), status.alias("status"), F.when(status == "claimed", F.col("idx").cast("double")).alias("claimed_at"))
    return claim(queue, 5000.0, 1000.0).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("claimed_at") == 5000.0).alias("claimed_now"))


from ..sources.tables import WIRE_SQL  # noqa: E402

QUERIES = {"z01_merge_adjacent": q_merge, "z05_notification_claim": q_claim}
ORACLES = {
    "z01_merge_adjacent": f"WITH {WIRE_SQL}, n AS (SELECT *, CASE WHEN type = 'StatusUpdate' AND lag(type) OVER (PARTITION BY session_id ORDER BY idx) = 'StatusUpdate' THEN 0 ELSE 1 END AS c FROM wire), r AS (SELECT *, sum(c) OVER (PARTITION BY session_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS run FROM n) SELECT session_id, min(idx) AS first_idx, type, count(*) AS parts, CAST(sum(tokens_in) AS BIGINT) AS tokens FROM r GROUP BY session_id, run, type",
    "z05_notification_claim": f"""WITH {WIRE_SQL}, q AS (SELECT idx, CASE WHEN k % 3 = 0 THEN 'acked' WHEN k % 3 = 1 AND idx >= 4000 THEN 'claimed' ELSE 'pending' END AS status FROM (SELECT idx, tokens_in AS k FROM wire WHERE type = 'ToolCall')),
f AS (SELECT idx FROM q WHERE status = 'pending' ORDER BY idx LIMIT 8), s AS (SELECT CASE WHEN f.idx IS NOT NULL THEN 'claimed' ELSE status END AS status, f.idx IS NOT NULL OR (status = 'claimed' AND q.idx = 5000) AS now_ FROM q LEFT JOIN f ON q.idx = f.idx)
SELECT status, count(*) AS n, count(*) FILTER (now_) AS claimed_now FROM s GROUP BY status""",
}
