"""Scalars, folds and anchors that SQL does not reach."""

from __future__ import annotations

import difflib
import hashlib
import itertools
import math

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quernstone.functions import similarity as sim
from quernstone.functions import repairs, structured, words
from quernstone.operators import neardup, rerank, retrieval
from quernstone.sources import logs, pages
from quernstone.streaming import folds


def test_osa():
    assert [sim.osa_distance(*p) for p in (("ca", "abc"), ("ab", "ba"), ("", "xy"), ("same", "same"))] == [3, 1, 2, 0]
    assert sim.osa_distance("abcdef", "uvwxyz", 2) == 3


def test_damerau_as_in_sql(spark):
    terms = ["".join(w) for n in range(1, 5) for w in itertools.product("abc", repeat=n)]
    pairs = [*itertools.product(terms, terms)][::37] + [("antian", "ainan"), ("ca", "abc")]
    con = duckdb.connect()
    assert [sim.damerau_distance(*p) for p in pairs] == [con.execute("SELECT damerau_levenshtein(?, ?)", p).fetchone()[0] for p in pairs]
    one = lambda x, name: spark.createDataFrame([(x,)], f"{name} string")
    found = sim.fuzzy_pairs(one("antian", "a"), one("ainan", "b")).collect()
    assert [tuple(r) for r in found] == [("antian", "ainan", 2)]  # a swap with a letter lost between


def test_line_edit_of_a_short_line(spark, tmp_path):
    spark.createDataFrame([(2, "Thing.\nmore"), (6, "Thing\nmore")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r["item_id"]: (r["how"], r["digest"]) for r in words.q_line_edits(spark, str(tmp_path)).collect()}
    assert got == dict.fromkeys((2, 6), ("alike", hashlib.md5(b"NEW\nmore").hexdigest()))


def test_mapped_holds_few_rows(spark):
    class Rows:
        """Takes a function of batches instead of running it."""

        sparkSession = spark

        def mapInArrow(self, run, schema):
            return run

        def mapInPandas(self, run, schema):
            return lambda batches: run(b.to_pandas() for b in batches)

    asked = []
    run = repairs.mapped(Rows(), lambda r: asked.append(r["id"]) or (r["id"], r["text"]), "id long, text string")
    batch = pa.RecordBatch.from_pydict({"id": list(range(1000)), "text": [None, "é"] * 500})
    out = run(iter([batch]))
    first = next(out)
    assert len(asked) < 1000  # before, results of a whole batch were held at once
    assert pa.Table.from_batches([first, *out]).to_pydict() == batch.to_pydict()


def test_diffs_of_odd_texts(spark, tmp_path):
    texts = [
        "first" + "\nx" * 300, "first" + "\nx\ny" * 150, "first\na" + "\nx" * 300 + "\nb\nfirst", "first" + "\nx" * 300 + "\nfirst",  # nearly all lines are frequent
        None, "", "\n", "a", "a\n\n", "a\r\nb", "a\x0bb\x85c\nd", "--a\nb", "++a\nb", "NEW", "NEW\nNEW\nx", "a\nNEW\nNEW", "first\n" + "x\n" * 12_000,
    ]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = repairs.q_diff(spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == con.sql(repairs.ORACLES["c28_c30_diffs"] + " ORDER BY doc_id").fetchall()


def test_changes():
    texts = [list(w) for n in range(6) for w in itertools.product("ab", repeat=n)]
    for a, b in itertools.product(texts, texts):
        steps = structured.Changes(a, b).get_opcodes()
        assert [s for tag, i, j, k, m in steps for s in (a[i:j] if tag == "equal" else b[k:m])] == b and all(a[i:j] == b[k:m] for tag, i, j, k, m in steps if tag == "equal")
        assert [i for _, i, _, _, _ in steps] + [len(a)] == [0] + [j for _, _, j, _, _ in steps]
    old = [str(i) for i in range(40)]
    new = ["0", "new", *old[1:10], "ten", *old[11:20], *old[25:39], "last", "39"]
    for a, b in ((old, new), (new, old), (old, old[:-1]), (old[:1], old[:2])):
        for n in (0, 1, 3):
            assert structured.unified("\n".join(a), "\n".join(b), n).split("\n") == list(difflib.unified_diff(a, b, "a", "b", lineterm="", n=n))
    assert structured.unified("a", "a") == "" and structured.unified(None, "a") == "--- a\n+++ b\n@@ -0,0 +1 @@\n+a"
    assert structured.unified("\n".join("x" * 5), "\n".join("y" * 6), most=5) == "5 lines against 6"
    assert repairs.hash_diff("a\x0bb\nc", "a\x0bb\nd").split("\n")[-1] == f"+2#{structured.line_hashes(chr(97) + chr(11) + 'b' + chr(10) + 'd')[1]}:d"


def test_jaro():
    assert round(sim.jaro("MARTHA", "MARHTA"), 4) == 0.9444
    assert round(sim.jaro_winkler("MARTHA", "MARHTA"), 4) == 0.9611
    assert sim.jaro("", "a") == 0.0


def test_soundex():
    assert [sim.soundex(w) for w in ("Ashcraft", "Robert", "1x", "")] == ["A226", "R163", "1200", ""]


def test_deletes_find_both_ways(spark):
    a = spark.createDataFrame([("hello",), ("hell",)], "a string")
    b = spark.createDataFrame([("hello",), ("hell",), ("world",)], "b string")
    found = {(r["a"], r["b"]) for r in sim.fuzzy_pairs(a, b).collect()}
    assert found == {("hello", "hello"), ("hello", "hell"), ("hell", "hello"), ("hell", "hell")}


def test_long_words(spark, tmp_path):
    spark.createDataFrame([(1, "chapters chapterss chapter knowledge understandings in")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    wide = {}
    for r in sim.q_fuzzy(spark, str(tmp_path)).orderBy("term", "rank").collect():
        wide.setdefault(r["term"], []).append((r["expansion"], r["distance"]))
    assert wide["chapterss"] == [("chapterss", 0), ("chapters", 1), ("chapter", 2)]
    assert wide["knowledge"] == [("knowledge", 0)] and wide["understandings"] == [("understandings", 0)]
    assert wide["chapters"] == [("chapters", 0), ("chapter", 1)]
    fixed = {r["word"]: r["correction"] for r in sim.q_speller(spark, str(tmp_path)).collect()}
    assert fixed["knowledgee"] == "knowledge" and fixed["understandingss"] == "understandings" and fixed["inn"] == "in"


def test_idf_anchor(spark):
    got = spark.range(1).select(retrieval.idf(F.lit(1), F.lit(1)).alias("x")).first()["x"]
    assert math.isclose(got, math.log(1 + 0.5 / 1.5))


def test_sparse_ids_and_min_match(spark):
    docs = spark.createDataFrame([(5, "abcde"), (10, "abcde")], "doc_id long, text string")
    index = retrieval.Index(docs)
    assert index.stats.first()["n"] == 11
    q = retrieval.query_terms(spark.createDataFrame([(1, "abcf")], "qid long, text string"))
    assert retrieval.enough(index.scored(index.matching(q)), q, 0.6).count() == 0 < index.scored(index.matching(q)).count()


def test_empty_and_null_texts(spark):
    docs = spark.createDataFrame([(1, ""), (2, None), (3, "ab")], "doc_id long, text string")
    index = retrieval.Index(docs)
    assert {(r["term"], r["tf"]) for r in index.postings.collect()} == {("ab", 1)}


def test_set_similarities(spark):
    row = spark.createDataFrame([("", "a", "night")], "e string, a string, n string").select(
        neardup.dice(F.col("e"), F.col("e")), neardup.dice(F.col("a"), F.col("a")), neardup.dice(F.col("n"), F.lit("nacht")), neardup.overlap(F.col("a"), F.col("a")), neardup.hamming(F.col("a"), F.col("n"))
    ).first()
    assert tuple(row) == (1.0, 0.0, 0.25, 1.0, None)


def test_minhash_estimates(spark):
    texts = ["abcdefghijklmnopqrstuvwxyz" * 3, "abcdefghijklmnopqrstuvwxyz" * 3 + "0123456789"]
    a, b = (np.array(r["signature"]) for r in neardup.minhash(spark.createDataFrame(enumerate(texts), "doc_id long, text string"), 128).orderBy("doc_id").collect())
    assert abs(np.mean(a == b) - 26 / 36) < 0.15


def test_learning_to_rank():
    x, y = [np.array([[3.0], [2.0], [1.0], [0.0]])] * 2, [np.array([3.0, 2.0, 1.0, 0.0])] * 2
    assert rerank.ndcg([3, 2, 1, 0]) == 1.0
    assert rerank.rank_svm(x, y)[0] > 0 and rerank.rank_boost(x, y) and rerank.coordinate_ascent(x, y)[0] > 0


def test_greedy_takes_the_first_of_equals():
    assert rerank.greedy([1.0, 2.0, 2.0], lambda i, taken: [1.0, 2.0, 2.0][i]) == [1, 2, 0]


def test_markdown():
    html = "<head><title>t</title></head><nav>x</nav><h2>Head &amp; more</h2><p>one <b>two</b></p><ul><li>a</li></ul><script>bad()</script>"
    assert pages.to_markdown(html) == "## Head & more\n\none **two**\n\n- a"
    assert pages.to_markdown(None) is None and pages.to_markdown("") == ""


def test_log_quarantine(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"type":"metadata"}\n{"role":"user","content":"a"}\n\n{broken\n')
    good, bad = logs.read_log(spark, str(tmp_path / "log.jsonl"))
    assert [r["role"] for r in good.collect()] == ["user"] and bad.count() == 1


def test_stream_equals_batch(spark, tmp_path):
    rows = [(s, i, "StatusUpdate" if (i * 7 + s) % 3 else "ToolCall", i) for s in (1, 2) for i in range(30)]
    schema = "session_id long, idx long, type string, tokens_in long"
    batch = spark.createDataFrame(rows, schema)
    want = {tuple(r) for r in folds.merge_batch(batch).collect()}
    for k in range(3):
        part = [r for r in rows if r[1] // 10 == k] + ([(s, 99, "End", 0) for s in (1, 2)] if k == 2 else [])
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    q = folds.merge_stream(stream).writeStream.format("memory").queryName("merged").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {tuple(r) for r in spark.table("merged").collect()}
    assert sum(r[3] for r in got) == sum(r[3] for r in want) and {r[4] for r in got if r[2] != "StatusUpdate"} == {r[4] for r in want if r[2] != "StatusUpdate"}


def test_incremental_index(spark, tmp_path):
    spark.createDataFrame([(1, "abcd"), (2, "bcde")], "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    folds.index_stream(spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "docs")), str(tmp_path / "index"), str(tmp_path / "c")).awaitTermination(120)
    posts, lengths = logs.load_index(spark, str(tmp_path / "index"))
    assert posts.count() == 4 and lengths.count() == 2


def test_line_hash_chain():
    import xxhash

    got = structured.line_hashes("a b\r\n--\n")
    assert len(got) == 3 and all(len(h) == 2 and set(h) <= set(structured.NIBBLES) for h in got)
    first = xxhash.xxh32(b"ab", 0).intdigest() & 255
    assert got[0] == structured.NIBBLES[first >> 4] + structured.NIBBLES[first & 15]
    assert structured.line_hashes("x\ny")[1] != structured.line_hashes("z\ny")[1] or structured.line_hashes("x")[0] == structured.line_hashes("z")[0]


def test_anchored_edits():
    text = "one\ntwo\nthree"
    h = structured.line_hashes(text)
    edit = {"line": 2, "end": 2, "hash": h[1], "lines": ["2a", "2b"]}
    assert structured.apply_edits(text, [edit, edit]) == "one\n2a\n2b\nthree"
    for bad in ([{**edit, "hash": "??"}], [edit, {**edit, "line": 1, "end": 2, "hash": h[0]}]):
        try:
            structured.apply_edits(text, bad)
        except ValueError:
            continue
        raise AssertionError(bad)


def test_repair_and_diff():
    fields = {"path": None, "max_results": (1, 10), "pattern": None}
    assert structured.repaired({"pth": 1, "file": "x", "max_result": 99, "patern": "a"}, fields, {"file": "path"}) == {"pth": 1, "path": "x", "max_results": 10, "pattern": "a"}
    assert structured.unified("a\nb", "a\nc").splitlines()[-2:] == ["-b", "+c"] and structured.canonical("{no") == "{no"
