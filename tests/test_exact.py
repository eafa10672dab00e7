"""Streams against simulations: claims out of order, candidates with removals in any order, sinks that fail."""

from __future__ import annotations

import datetime as dt
import os
import random

from quernstone.operators.neardup import NEAR
from quernstone.streaming import exact

START = dt.datetime(2024, 1, 1)


def in_files(spark, rows, schema, path, size):
    """Each slice of rows a file, read in this order."""
    for k in range(0, len(rows), size):
        before = set(path.glob("*.parquet"))
        spark.createDataFrame(rows[k : k + size], schema).coalesce(1).write.mode("append").parquet(str(path))
        for f in set(path.glob("*.parquet")) - before:
            os.utime(f, (1_700_000_000 + k, 1_700_000_000 + k))


def run(spark, stream, path, schema):
    recorder = exact.Recorder(spark, str(path / "out"), {"rows": lambda b: b})
    recorder.start(stream, str(path / "c")).awaitTermination(200)
    return recorder.read("rows", schema)


def test_claims_out_of_order(spark, tmp_path):
    rng, rows = random.Random(3), []
    for i in range(160):
        at = START + dt.timedelta(seconds=10 * i)
        kind = rng.choice(["put", "put", "claim", "ack"])
        rows.append((rng.choice(["mail", "chat"]), at, i, kind, rng.randrange(40), rng.choice(["w1", "w2"])))
    want = set()
    for sink in ("mail", "chat"):
        own = [(r[1].timestamp(), *r[2:]) for r in rows if r[0] == sink]
        want |= {(sink, *c) for c in exact.queued(own, {}, 60.0, 3)[0]}
    assert len({(s, i) for s, i, *_ in want}) < len(want)  # some were claimed again
    late = [x for k in range(0, 160, 16) for x in rng.sample(rows[k : k + 16], 16)]  # at most 160 s late
    late += [(s, START + dt.timedelta(days=9), -1, "end", -1, "") for s in ("mail", "chat")]
    in_files(spark, late, exact.QUEUE, tmp_path / "in", 9)
    stream = spark.readStream.schema(exact.QUEUE).option("maxFilesPerTrigger", 4).parquet(str(tmp_path / "in")).withWatermark("ts", "400 seconds")
    got = run(spark, exact.claim_stream(stream, 60.0, 3), tmp_path, exact.CLAIMS)
    assert sorted(tuple(r)[:4] for r in got.collect()) == sorted(want)


def test_queue_rules():
    events = [(0.0, 0, "put", 1, ""), (1.0, 1, "put", 2, ""), (2.0, 2, "claim", 0, "a"), (3.0, 3, "ack", 1, "b"), (4.0, 4, "ack", 1, "a"), (5.0, 5, "claim", 0, "b"), (63.0, 6, "claim", 0, "b"), (64.0, 7, "ack", 2, "a"), (65.0, 8, "put", 2, "")]
    claims, held = exact.queued(events, {}, 60.0, 8)
    assert claims == [(1, 2.0, "a"), (2, 2.0, "a"), (2, 63.0, "b")] and held == {2: [1.0, 63.0, "b"]}


def test_candidates_with_removals(spark, tmp_path):
    rng = random.Random(4)
    prints = [rng.getrandbits(64) for _ in range(6)]
    prints += [p ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5))) for p in prints for _ in range(4)]
    prints = [p - (1 << 64) if p >> 63 else p for p in prints]
    changes, count = [], dict.fromkeys(prints, 0)
    for _ in range(150):
        p = rng.choice(prints)
        delta = -1 if count[p] and rng.random() < 0.45 else 1
        count[p] += delta
        changes.append((p, delta))
    live = sorted(p for p, c in count.items() if c)
    want = {(a, b) for i, a in enumerate(live) for b in live[i + 1 :] if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= NEAR}
    rng.shuffle(changes)  # removals may come first
    in_files(spark, changes, "simhash long, delta long", tmp_path / "in", 50)
    stream = spark.readStream.schema("simhash long, delta long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = run(spark, exact.candidate_stream(stream), tmp_path, exact.CANDIDATES).groupBy("a", "b").sum("delta").collect()
    assert {(r["a"], r["b"]) for r in got if r[2] == 1} == want and want and all(r[2] in (0, 1) for r in got)


def test_candidates_wake_few_groups(spark, tmp_path):
    rng = random.Random(5)
    rows = [(rng.getrandbits(63), 1) for _ in range(2000)]
    in_files(spark, rows, "simhash long, delta long", tmp_path / "in", 2000)
    stream = spark.readStream.schema("simhash long, delta long").parquet(str(tmp_path / "in"))
    query = exact.Recorder(spark, str(tmp_path / "out"), {"rows": lambda b: b}).start(exact.candidate_stream(stream), str(tmp_path / "c"))
    query.awaitTermination(200)
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress) <= 20 * exact.PARTS  # there was a group for each of 40,000 keys


def test_recorder_replays(spark, tmp_path):
    fail = [True]

    def second(batch):
        if fail:
            fail.clear()
            raise RuntimeError("away")
        return batch.groupBy().count()

    recorder = exact.Recorder(spark, str(tmp_path / "r"), {"raw": lambda b: b, "counts": second})
    batch = spark.range(5)
    try:
        recorder.add(batch, 0)
    except RuntimeError:
        assert recorder.read("raw", "id long").count() == 0
    recorder.add(batch, 0)
    recorder.add(batch, 0)  # again after its commit
    recorder.add(spark.range(3), 1)
    assert recorder.read("raw", "id long").count() == 8 and sorted(tuple(r) for r in recorder.read("counts", "count long").collect()) == [(3, 1), (5, 0)]
