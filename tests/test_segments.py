"""The stored index against one built anew; versions and conflicts of manifests; streams of appends."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernstone.operators import retrieval, scoring, segments
from quernstone.sources.snapshots import Conflict, Snapshots

DOCS = "doc_id long, text string"


def texts(rng: random.Random, ids) -> list[tuple]:
    words = "rain sun storm cloud heavy light day night wind snow ice fog dew hail 中文测试 文档".split()
    return [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 40)))) for i in ids]


def asked(spark):
    return spark.createDataFrame([(1, "heavy rain"), (2, "snow and fog"), (3, "中文测试"), (4, "zzzz"), (5, "light wind at night, heavy storm by day")], "qid long, text string")


def rows(df) -> set:
    return {tuple(r) for r in df.collect()}


def same_as_rebuilt(spark, index, live: dict[int, str]):
    q = retrieval.query_terms(asked(spark)).withColumn("one", F.lit(1))
    fresh = retrieval.Index(spark.createDataFrame(list(live.items()), DOCS))
    assert rows(index.best(q, 5)) == rows(fresh.best(q, 5))
    assert rows(index.best(q, 3, weight="one", share=0.5)) == rows(fresh.best(q, 3, weight="one", share=0.5))
    assert rows(index.terms()) == rows(fresh.terms())
    blocks, _ = fresh.blocks(q, "qtf")
    assert {r for r in rows(index.matched(q)) if r[1]} == {r for r in rows(scoring.matched(fresh.docs, blocks)) if r[1]}


def test_changes_equal_a_rebuild(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "RANGE", 16)
    monkeypatch.setattr(segments, "FAN", 3)
    rng, index, live = random.Random(5), segments.StoredIndex(spark, str(tmp_path / "i")), {}
    assert index.best(retrieval.query_terms(asked(spark))).count() == 0
    for step in range(9):
        if step in (2, 4, 5, 7):
            gone = rng.sample(sorted(live), len(live) // 4) + [10_000]
            index.delete(spark.createDataFrame([(i,) for i in gone], "doc_id int"))
            live = {i: t for i, t in live.items() if i not in gone}
        else:
            new = texts(rng, [i for i in rng.sample(range(200), 40) if i not in live])
            index.append(spark.createDataFrame([*new, (None, "rain"), (900, None)], DOCS))
            live |= dict(new)
        if step in (3, 6):
            index.merge(every=step == 6)
        if step in (2, 4, 6, 8):
            same_as_rebuilt(spark, index, live)
    assert index.manifest["next"] > len(index.manifest["segments"])
    index.delete(spark.createDataFrame([(i,) for i in live], "doc_id long"))
    assert index.merge(every=True) and index.facts() == (0, 0, 0) and index.best(retrieval.query_terms(asked(spark))).count() == 0


def test_versions(spark, tmp_path):
    index = segments.StoredIndex(spark, str(tmp_path / "i"))
    index.append(spark.createDataFrame([(1, "heavy rain")], DOCS), "a")
    old = segments.StoredIndex(spark, str(tmp_path / "i"))
    index.append(spark.createDataFrame([(1, "heavy rain")], DOCS), "a")  # the same batch again
    index.append(spark.createDataFrame([(2, "heavy rain today")], DOCS), "b")
    assert old.facts() == (1, 2, 8) and index.facts() == (2, 3, 22)
    assert {r["doc_id"] for r in old.best(retrieval.query_terms(asked(spark))).collect()} == {1}
    assert segments.StoredIndex(spark, str(tmp_path / "i"), version=1).facts()[0] == 1


def test_stream_of_appends(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "FAN", 2)
    rng, live = random.Random(6), {}
    for k in range(4):
        new = texts(rng, range(30 * k, 30 * k + 30))
        live |= dict(new)
        spark.createDataFrame(new, DOCS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(DOCS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    segments.index_stream(stream, str(tmp_path / "i"), str(tmp_path / "c")).awaitTermination(300)
    index = segments.StoredIndex(spark, str(tmp_path / "i"))
    assert len(index.manifest["segments"]) < 4 and index.manifest["batches"] == [f"stream-{k}" for k in range(4)]
    same_as_rebuilt(spark, index, live)


def test_search_reads_its_terms_only(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "GROUP_BYTES", 1 << 14)
    rng = np.random.default_rng(1)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    many = [(i, "".join(rng.choice(letters, 600)) + (" xyzzy" if i % 100 == 0 else "")) for i in range(1500)]
    index = segments.StoredIndex(spark, str(tmp_path / "i"))
    index.append(spark.createDataFrame(many, DOCS))
    a = index.asked(retrieval.query_terms(spark.createDataFrame([(1, "xyzzy")], "qid long, text string")))
    found = index._ranges(a)
    assert "PushedFilters: [Or(" in found._jdf.queryExecution().toString()
    found.collect()
    scan, stack = None, [found._jdf.queryExecution().executedPlan()]
    total = index._blocks(None).count()
    read = []
    while stack:  # what the scan gave to the filter behind it
        node = stack.pop()
        if node.nodeName().startswith("Scan parquet"):
            read.append(node.metrics().apply("numOutputRows").value())
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            stack.append(node.executedPlan())
        elif node.getClass().getSimpleName().endswith("QueryStageExec"):
            stack.append(node.plan())
        kids = node.children()
        stack += [kids.apply(i) for i in range(kids.size())]
    assert scan is None and 0 < sum(read) < total / 4


def test_bounds_leave_out_blocks():
    rng = np.random.default_rng(2)
    n, terms = 400, 60
    tf = (rng.random((n, terms)) < np.linspace(0.01, 0.9, terms)) * rng.integers(1, 6, (n, terms))
    lengths = tf.sum(axis=1) + 1
    idf = {t: float(np.log1p((n - (tf[:, t] > 0).sum() + 0.5) / ((tf[:, t] > 0).sum() + 0.5))) for t in range(terms)}
    place, code = np.nonzero(tf)[0], np.nonzero(tf)[1]
    row = segments._block_rows(0, np.arange(n) * 10, lengths.astype(np.int64), code, place, tf[place, code])
    import pyarrow as pa

    part = segments.Range([row.append_column("segment", pa.array(np.zeros(row.num_rows, np.int64))).append_column("dead", pa.array([[3, 7]] + [None] * (row.num_rows - 1), pa.list_(pa.int32())))])
    asked_ = segments.Asked({1: {t: 1.0 for t in range(0, terms, 2)}, 2: {t: 2.0 for t in range(terms)}}, idf, {1: 3, 2: 5}, float(lengths.mean()))
    for need in (asked_.need, None):
        asked_.need = need
        best = segments.Best(asked_, 0, 2, 5)
        best.add(part)
        full = np.stack([asked_.part(tf[:, t], lengths, t) for t in range(terms)], axis=1)
        for k, own in enumerate((range(0, terms, 2), range(terms))):
            score = full[:, own].sum(axis=1) * (k + 1)
            score[[3, 7]] = 0
            if need is not None:
                score[(tf[:, own] > 0).sum(axis=1) < need[k]] = 0
            want = np.lexsort((np.arange(n), -np.round(score, 6)))[:5]
            assert best.name[:, k].tolist() == (want * 10).tolist() and np.allclose(best.score[:, k], score[want])
        assert best.looked <= terms


def test_snapshots(spark, tmp_path):
    s = Snapshots(spark, str(tmp_path / "s"))
    assert s.version() == 0 and s.read() == {}
    assert s.change(lambda m: m | {"a": [1]}) == 1 and s.read() == {"a": [1]}
    with pytest.raises(Conflict):
        s.write(1, {"a": [2]})
    assert s.read() == {"a": [1]} and not [p for p in (tmp_path / "s/manifests").iterdir() if p.name.startswith(".draft")]
    raced = []

    def update(m: dict) -> dict:
        if not raced:  # another writer commits first
            raced.append(1)
            s.write(2, m | {"b": 1})
        return m | {"c": 1}

    assert s.change(update) == 3 and s.read() == {"a": [1], "b": 1, "c": 1} and s.read(1) == {"a": [1]}
    for label in ("kept", "lost"):
        (tmp_path / f"s/data/{label}").mkdir(parents=True)
    s.change(lambda m: {"path": f"{s.path}/data/kept"})
    s.sweep()
    assert [p.name for p in (tmp_path / "s/data").iterdir()] == ["kept"] and s.version() == 4 and s.read() == {"path": f"{s.path}/data/kept"}


def test_blocks_are_not_joined(spark, tmp_path, monkeypatch):
    """With dead in the index, blocks of terms are read without a join, and a deletion joined or sent to the tasks takes off the same."""
    rng, found = random.Random(8), []
    for sent in (segments.SENT, 0):
        monkeypatch.setattr(segments, "SENT", sent)
        rng, index = random.Random(8), segments.StoredIndex(spark, str(tmp_path / f"i{sent}"))
        live = dict(texts(rng, range(150)))
        index.append(spark.createDataFrame(list(live.items()), DOCS))
        for gone in ([3, 5, 8, 140], [5, 9, 77]):
            index.delete(spark.createDataFrame([(i,) for i in gone], "doc_id long"))
            live = {i: t for i, t in live.items() if i not in gone}
        assert "Join" not in index._blocks("code <> -1")._jdf.queryExecution().optimizedPlan().toString()
        same_as_rebuilt(spark, index, live)
        version = index.snapshots.version()
        index.delete(spark.createDataFrame([(5,)], "doc_id long"))  # none is left of it
        assert index.snapshots.version() == version
        found.append((rows(index.terms()), index.facts()))
    assert found[0] == found[1]


def test_only_asked_blocks_are_dealt(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "STRETCHES", 1)  # a stretch holds what lies between its ends
    index = segments.StoredIndex(spark, str(tmp_path / "i"))
    index.append(spark.createDataFrame(texts(random.Random(9), range(100)), DOCS))
    some = index.asked(retrieval.query_terms(spark.createDataFrame([(1, "storm wind")], "qid long, text string")))
    assert {r["code"] for r in index._ranges(some).collect()} == {-1, *some.codes.tolist()}
