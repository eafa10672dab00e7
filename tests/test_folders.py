"""The session store read from real folders, recall blocks."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from quernstone.operators import messages, retrieval
from quernstone.sources import folders


def test_store_is_pruned(spark, tmp_path):
    for project in ("a", "b", ".git", "node_modules"):
        for session in ("s1", "s2", "__pycache__"):
            d = tmp_path / project / session
            d.mkdir(parents=True)
            (d / "context.jsonl").write_text(json.dumps({"role": "user", "content": f"{project}{session}"}) + "\n\n{broken\n" + json.dumps({"role": "tool", "content": [1]}) + "\n[1]\n")
            (d / "picture.png").write_bytes(b"\xff")
    found = folders.read_store(spark, str(tmp_path))
    assert {tuple(r) for r in found.collect()} == {(p, s, "context.jsonl", n, r, c) for p in "ab" for s in ("s1", "s2") for n, r, c in ((1, "user", f"{p}{s}"), (4, "tool", "[1]"))}
    one = found.filter("project = 'b' AND session IN ('s2', 'x') AND role = 'user'")
    assert [r["content"] for r in one.collect()] == ["bs2"]
    reader = folders.StoreReader(str(tmp_path))
    left = list(reader.pushFilters([folders.EqualTo(("project",), "b"), folders.EqualTo(("role",), "user")]))
    assert [f.attribute for f in left] == [("role",)] and [(p.project, p.sessions) for p in reader.partitions()] == [("b", ["s1", "s2"])]
    assert folders.read_store(spark, str(tmp_path / "none")).count() == 0


def test_store_is_written_by_tasks(spark, tmp_path):
    lines = [(f"p{k % 3}", f"s{k}", t, json.dumps({"role": "user", "content": f"{k}\u00e9 {t}"})) for k in range(40) for t in (2, 0, 1)]
    rows = spark.createDataFrame(lines, "project string, session string, turn long, value string").repartition(7)
    for _ in range(2):  # the second run of a task leaves the same
        assert folders.write_store(rows, str(tmp_path / "s")) == 40
    assert sorted(p.name for p in (tmp_path / "s").rglob("*") if p.is_file()) == ["log.jsonl"] * 40
    assert (tmp_path / "s" / "p1" / "s4" / "log.jsonl").read_text().splitlines() == [json.dumps({"role": "user", "content": f"4\u00e9 {t}"}) for t in range(3)]
    assert {(r["project"], r["session"], r["line"], r["content"]) for r in folders.read_store(spark, str(tmp_path / "s")).collect()} == {(f"p{k % 3}", f"s{k}", t + 1, f"{k}\u00e9 {t}") for k in range(40) for t in range(3)}
    assert folders.write_store(rows.limit(0), str(tmp_path / "e")) == 0


def test_recall_blocks(spark, sf):
    turns = {r["turn_id"]: r for r in retrieval.history_turns(spark.read.parquet(f"{sf}/conversations.parquet")).collect()}
    docs = spark.createDataFrame([(i, r["text"]) for i, r in turns.items()], "doc_id long, text string")
    best = retrieval.Index(docs, dense=True).best(retrieval.query_terms(retrieval.queries_of(spark, sf)), 5).orderBy("qid", "rank").collect()
    want: dict[int, list[str]] = {}
    for r in best:
        mark = " [compacted]" if r["doc_id"] % 2 == 0 else ""
        quoted = turns[r["doc_id"]]["text"].replace("\n", "\n> ")
        want.setdefault(r["qid"], []).append(f"> **{turns[r['doc_id']]['role']}**{mark} (relevance: {r['score']:.2f})\n> {quoted}")
    got = messages.q_recall(spark, sf).collect()
    assert {r["qid"]: r["shown"] for r in got} == {q: f"Retrieved {len(b)} past turn(s):\n\n" + "\n\n".join(b) for q, b in want.items()} and got
    assert messages.q_recall(spark, sf, 0).agg(F.max("n")).first()[0] == 1
