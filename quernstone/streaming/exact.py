"""Streams whose results survive replay: one stream to several sinks, a notification queue with stale claims, near-duplicate candidates with removals.

Sinks take a micro-batch at once: the rows of batch k go to new folders, and one commit of a manifest (sources/snapshots.py) that names them all makes
them visible. A batch that comes again after a failure finds itself named, or finds no trace of its first try in what readers see.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.neardup import BLOCKS, NEAR, SIM_SQL, simhash
from ..plans.shipping import ship
from ..plans.staging import new_path
from ..sources.snapshots import Snapshots
from ..sources.tables import table, wire
from .folds import merge_batch


class Recorder:
    """Named sinks below a folder, each fed with a function of the micro-batches, all of them exactly once."""

    def __init__(self, spark: SparkSession, path: str, sinks: dict[str, Callable[[DataFrame], DataFrame]]):
        self.spark, self.snapshots, self.sinks = spark, Snapshots(spark, path), sinks

    def add(self, batch: DataFrame, number: int) -> None:
        if str(number) in self.snapshots.read().get("batches", {}):
            return
        paths = {}
        for name, fn in self.sinks.items():
            paths[name] = self.snapshots.new_name(f"{name}-{number}")
            fn(batch).write.parquet(paths[name])
        self.snapshots.change(lambda m: m | {"batches": {str(number): paths} | m.get("batches", {})})

    def read(self, name: str, schema: str) -> DataFrame:
        """What the sink holds, with the number of the batch of each row."""
        out = self.spark.createDataFrame([], f"{schema}, batch long")
        for number, paths in sorted(self.snapshots.read().get("batches", {}).items(), key=lambda x: int(x[0])):
            out = out.unionByName(self.spark.read.schema(schema).parquet(paths[name]).withColumn("batch", F.lit(int(number)).cast("long")))
        return out

    def start(self, stream: DataFrame, checkpoint: str):
        return stream.writeStream.foreachBatch(self.add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# a queue of notifications for each sink

CLAIMS = "sink string, id long, claimed_at double, worker string"


def claim_stream(events: DataFrame, stale: float, limit: int = 8) -> DataFrame:
    """Claims (sink, id, claimed_at, worker) of a stream of events (sink, ts, seq, kind, id, worker).

    kind: put adds a notification, claim gives its worker the oldest pending ones, at most `limit`, ack takes away one that the worker holds. A claim that
    is older than `stale` seconds when the next event comes is pending again. Events are taken in order of (ts, seq) once the watermark has
    passed them: the stream's watermark says how late they may come; a timer wakes a sink whose watermark moved on without events. A row of kind end far ahead closes a bounded stream.
    """
    ship(events.sparkSession)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, held = (list(map(tuple, state.get[0])), {r[0]: list(r[1:]) for r in state.get[1]}) if state.exists else ([], {})
        for pdf in batches:
            waiting += [(t.timestamp() if hasattr(t, "timestamp") else float(t), int(s), k, int(i), w) for t, s, k, i, w in pdf[["ts", "seq", "kind", "id", "worker"]].itertuples(index=False, name=None)]
        mark = state.getCurrentWatermarkMs() / 1000
        ready = sorted((e for e in waiting if e[0] < mark), key=lambda e: e[:2])
        waiting = [e for e in waiting if e[0] >= mark]
        out, held = queued(ready, held, stale, limit)
        state.update((waiting, [(i, *x) for i, x in held.items()]))
        if waiting:
            state.setTimeoutTimestamp(int(max(min(e[0] for e in waiting), mark) * 1000) + 1)
        yield pd.DataFrame([(key[0], *r) for r in out], columns=["sink", "id", "claimed_at", "worker"])

    kind = "waiting array<struct<ts: double, seq: long, kind: string, id: long, worker: string>>, held array<struct<id: long, put: double, claimed: double, worker: string>>"
    return events.groupBy("sink").applyInPandasWithState(step, CLAIMS, kind, "append", GroupStateTimeout.EventTimeTimeout)


def queued(events: list[tuple], held: dict[int, list], stale: float, limit: int) -> tuple[list[tuple], dict[int, list]]:
    """The claims that events (ts, seq, kind, id, worker) in order make, and what is held after them: {id: [put at, claimed at or None, worker]}."""
    out = []
    for ts, _, kind, id_, worker in events:
        for x in held.values():
            if x[1] is not None and ts - x[1] > stale:
                x[1], x[2] = None, None
        if kind == "put":
            held.setdefault(id_, [ts, None, None])
        elif kind == "ack" and id_ in held and held[id_][2] == worker:
            del held[id_]
        elif kind == "claim":
            for i in sorted((i for i, x in held.items() if x[1] is None), key=lambda i: (held[i][0], i))[:limit]:
                held[i][1:] = [ts, worker]
                out.append((i, ts, worker))
    return out, held


# near-duplicate candidates with removals

CANDIDATES = "a long, b long, delta long"
#: Parts that the keys of each choice of blocks are dealt into. A part is one group, with one state for all of its keys.
PARTS = 64


def _masks() -> list[int]:
    masks = []
    for blocks in itertools.combinations(BLOCKS, len(BLOCKS) - NEAR):
        bits = sum(((1 << width) - 1) << at for at, width in blocks)
        masks.append(bits - (1 << 64) if bits >> 63 else bits)
    return masks


def changed_pairs(h: np.ndarray, was: np.ndarray, now: np.ndarray, masks: list[int], band: int) -> pd.DataFrame:
    """(a, b, delta) of near fingerprints that share the key of this band and of none before. h: different and ascending; was, now: whether each was and is there."""
    key = h & masks[band]
    some = np.isin(key, key[was != now]) & (was | now)
    order = np.flatnonzero(some)[np.argsort(key[some], kind="stable")]
    h, key, was, now = h[order], key[order], was[order], now[order]
    out, i, ahead = [np.empty((0, 3), np.int64)], np.arange(len(h)), 0
    while len(i):  # each with the one `ahead` places on, as long as there is one of its key
        ahead += 1
        i = i[i + ahead < len(h)]
        i = i[key[i + ahead] == key[i]]
        j = i + ahead
        delta, differ = (now[i] & now[j]).astype(np.int64) - (was[i] & was[j]), h[i] ^ h[j]
        told = (delta != 0) & (np.bitwise_count(differ.view(np.uint64)) <= NEAR)
        for mask in masks[:band]:
            told &= (differ & mask) != 0
        out.append(np.column_stack([h[i], h[j], delta])[told])
    return pd.DataFrame(np.concatenate(out), columns=["a", "b", "delta"])


def candidate_stream(changes: DataFrame) -> DataFrame:
    """Changes (a, b, delta) to the pairs of different fingerprints within NEAR bits, of a stream of changes (simhash, delta: 1 added, -1 removed).

    A fingerprint is keyed by each choice of its blocks, and keys are dealt into PARTS groups a choice, so that a batch wakes no group for each key. The state of a group
    counts the fingerprints of its keys as two packed columns; copies are one. A pair is told when both are there and untold when one goes, by the first of the keys that
    they share, so once. The pairs that there are now are those whose deltas sum to 1.
    """
    ship(changes.sparkSession)
    masks = _masks()
    parts = F.array(*[F.pmod(F.xxhash64(F.col("simhash").bitwiseAND(F.lit(m).cast("long"))), F.lit(PARTS)) for m in masks])
    rows = changes.select("simhash", F.col("delta").cast("long").alias("delta"), F.posexplode(parts).alias("band", "part"))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, counts = (np.frombuffer(x, np.int64) for x in state.get) if state.exists else (np.empty(0, np.int64), np.empty(0, np.int64))
        got = [pdf[["simhash", "delta"]].to_numpy(np.int64) for pdf in batches]
        h, at = np.unique(np.concatenate([held, *[x[:, 0] for x in got]]), return_inverse=True)
        n, was = np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        np.add.at(n, at, np.concatenate([counts, *[x[:, 1] for x in got]]))
        was[np.searchsorted(h, held)] = counts > 0
        state.update((h[n != 0].tobytes(), n[n != 0].tobytes()))  # below 0: a removal that came before its addition
        yield changed_pairs(h, was, n > 0, masks, int(key[0]))

    return rows.groupBy("band", "part").applyInPandasWithState(step, CANDIDATES, "held binary, counts binary", "append", GroupStateTimeout.NoTimeout)


def _finished(query) -> None:
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


def q_broadcast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wire log as a stream to two sinks, raw events by type and merged parts by type; the first batch is tried twice, the second time after its sinks were written but not committed."""
    source, root = new_path(spark, "wire"), new_path(spark, "recorded")
    schema = "session_id long, idx long, type string, tokens_in long"
    events = wire(spark, sf_dir).select("session_id", "idx", "type", "tokens_in")
    for k in range(2):
        events.filter(F.pmod(F.xxhash64("session_id"), F.lit(2)) == k).write.mode("append").parquet(source)
    failed = []

    def merged(batch: DataFrame) -> DataFrame:
        if not failed:
            failed.append(1)
            raise RuntimeError("the sink is away")
        return merge_batch(batch)

    recorder = Recorder(spark, root, {"raw": lambda b: b, "merged": merged})
    stream, checkpoint = spark.readStream.schema(schema).parquet(source), new_path(spark, "checkpoint")
    query = recorder.start(stream, checkpoint)
    try:
        query.awaitTermination()
    except Exception:  # the first try's failure, as planned
        pass
    _finished(recorder.start(stream, checkpoint))
    raw, both = recorder.read("raw", schema), recorder.read("merged", "session_id long, first_idx long, type string, parts long, tokens long")
    a = raw.groupBy("type").agg(F.count(F.lit(1)).alias("events"), F.sum("tokens_in").alias("tokens"))
    b = both.groupBy("type").agg(F.count(F.lit(1)).alias("runs"), F.sum("parts").alias("parts"))
    return a.join(b, "type").select("type", "events", "tokens", "runs", "parts")


def q_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of near fingerprints of the documents that are no toxic ones: all are added, and the toxic ones are removed, some of them in the batch before they come."""
    docs = simhash(table(spark, sf_dir, "documents"))
    toxic = table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id", F.lit(True).alias("toxic")).distinct()
    change = lambda delta, part: F.struct(F.lit(delta).alias("delta"), F.pmod(part, F.lit(3)).cast("int").alias("part"))
    added, gone = change(1, F.xxhash64("doc_id")), change(-1, F.col("doc_id"))
    changes = docs.join(toxic, "doc_id", "left").select("simhash", F.explode(F.when(F.col("toxic"), F.array(added, gone)).otherwise(F.array(added))).alias("c")).select("simhash", "c.*")
    source, root = new_path(spark, "changes"), new_path(spark, "candidates")
    changes.repartition(3, "part").write.parquet(source)
    stream = spark.readStream.schema("simhash long, delta int").option("maxFilesPerTrigger", 1).parquet(source)
    recorder = Recorder(spark, root, {"pairs": lambda b: b})
    _finished(recorder.start(candidate_stream(stream), new_path(spark, "checkpoint")))
    pairs = recorder.read("pairs", CANDIDATES)
    return pairs.groupBy("a", "b").agg(F.sum("delta").alias("n")).filter("n > 0").select("a", "b", F.bit_count(F.col("a").bitwiseXOR(F.col("b"))).cast("int").alias("bits"))


def queue_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a queue's: clicks put notifications, views claim, purchases ack the one put 40 events before; sinks are users modulo 50."""
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "click", "put").when(F.col("event_type") == "view", "claim").when(F.col("event_type") == "purchase", "ack")
    rows = e.select(F.concat(F.lit("s"), (F.col("user_id") % 50).cast("string")).alias("sink"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").cast("long").alias("seq"), kind.alias("kind"), F.floor(F.col("value")).cast("long").alias("id"), F.concat(F.lit("w"), (F.col("event_id") % 3).cast("string")).alias("worker"))
    return rows.filter("kind IS NOT NULL")


QUEUE = "sink string, ts timestamp, seq long, kind string, id long, worker string"


def q_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of the queue over a stream whose files come out of order within the watermark."""
    source, root = new_path(spark, "queue"), new_path(spark, "claims")
    rows = queue_events(spark, sf_dir)
    last = rows.agg(F.max("ts")).first()[0]
    rows.repartition(4).write.parquet(source)
    if last is not None:  # a row far ahead for each sink moves the watermark past all
        rows.select("sink").distinct().select("sink", (F.lit(last) + F.expr("INTERVAL 4000 DAYS")).alias("ts"), F.lit(-1).cast("long").alias("seq"), F.lit("end").alias("kind"), F.lit(-1).cast("long").alias("id"), F.lit("").alias("worker")).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(QUEUE).parquet(source).withWatermark("ts", "2000 days")
    recorder = Recorder(spark, root, {"claims": lambda b: b})
    _finished(recorder.start(claim_stream(stream, 3600.0 * 24), new_path(spark, "checkpoint")))
    return recorder.read("claims", CLAIMS).groupBy("sink").agg(F.count(F.lit(1)).alias("claims"), F.count_distinct("id").alias("ids"), F.round(F.sum("claimed_at"), 3).alias("when"))


from ..sources.tables import WIRE_SQL  # noqa: E402

QUERIES = {"z03_broadcast": q_broadcast, "q10_candidate_changes": q_candidates, "z05_stale_claims": q_queue}
ORACLES = {
    "q10_candidate_changes": f"WITH {SIM_SQL}, c AS (SELECT DISTINCT simhash FROM sim ANTI JOIN (SELECT doc_id FROM labels WHERE toxic = 1) USING (doc_id)) SELECT a.simhash AS a, b.simhash AS b, CAST(bit_count(xor(a.simhash, b.simhash)) AS INTEGER) AS bits FROM c a JOIN c b ON a.simhash < b.simhash AND bit_count(xor(a.simhash, b.simhash)) <= 3",
    "z03_broadcast": f"""WITH {WIRE_SQL}, n AS (SELECT *, CASE WHEN type = 'StatusUpdate' AND lag(type) OVER (PARTITION BY session_id ORDER BY idx) = 'StatusUpdate' THEN 0 ELSE 1 END AS c FROM wire)
SELECT type, count(*) AS events, CAST(sum(tokens_in) AS BIGINT) AS tokens, CAST(sum(c) AS BIGINT) AS runs, count(*) AS parts FROM n GROUP BY type""",
}
