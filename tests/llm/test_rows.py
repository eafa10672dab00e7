"""Rows of the queries against plain Python on whole tables, and every operator on odd tables."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quernstone.llm import ann, bpe, jaccard_join, kneser_ney, langid, mixing, pii, suffix_dedup, token_store, winnowing
from quernstone.llm.common import maybe_in, shared_path

from .test_operators import ODD, brute_components, brute_pii, brute_removal

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(sf):
    return pq.read_table(f"{sf}/documents.parquet").to_pylist()


def sha(x):
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


# --- rows


def plain_marks(text):
    """Winnowing by the book: of each window of hashes the least, the rightmost of equal ones."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    h = [int(x) >> 16 for x in winnowing.rolling_hashes(codes)]
    w = min(winnowing.W, len(h))
    at = sorted({max(i for i in range(s, s + w) if h[i] == min(h[s : s + w])) for s in range(len(h) - w + 1)}) if h else []
    return {h[i] for i in at}, at


def test_winnowing_rows(spark, sf):
    rows = sorted(documents(sf), key=lambda r: -r["doc_id"])[:60]
    got = {r["doc_id"]: r for r in winnowing.fingerprints(spark.createDataFrame([(r["doc_id"], r["text"]) for r in rows], "doc_id long, text string")).collect()}
    for k, r in enumerate(rows):
        text, after = r["text"], rows[(k + 1) % len(rows)]["text"]
        n = len(text) // 3
        other = text[: len(text) - n] + after[:n]
        own, at = plain_marks(text)
        alike = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
        g = got[r["doc_id"]]
        assert (g["n_chars"], g["edited_sha256"]) == (len(text), sha(other))
        assert g["near_edited"] == pytest.approx(alike(own, plain_marks(other)[0])) and g["near_next"] == pytest.approx(alike(own, plain_marks(after)[0]))
        assert [p for _, p in winnowing.read(g["fingerprint"])] == at


def plain_targets(sizes):
    """Shares by weight; what passes three times a source is shared again."""
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in full)
        open_ = sum(w for s, w in weight.items() if s not in full)
        share = {s: 3.0 * sizes[s] if s in full else left * weight[s] / open_ for s in sizes}
        over = {s for s in sizes if s not in full and share[s] > 3 * sizes[s]}
        if not over:
            return share
        full |= over


def test_mixing_rows(spark, sf):
    rows = documents(sf)
    size = {r["doc_id"]: len([w for w in r["text"].replace("\x0b", " ").replace("\x0c", " ").split() if w]) for r in rows if r["text"].isascii()}
    got = mixing.op7_source_mixing(spark, sf).collect()
    again = {r["doc_id"]: r["taken"] for r in mixing.op7_source_mixing(spark, sf).collect()}
    source = {r["doc_id"]: r["source"] for r in rows}
    by = defaultdict(list)
    for r in got:
        by[source[r["doc_id"]]].append(r)
        assert size.get(r["doc_id"], r["size"]) == r["size"] and again[r["doc_id"]] == r["taken"]
    sums = {s: sum(r["size"] for r in g) for s, g in by.items()}
    want = plain_targets(sums)
    assert len(got) == len(rows) and abs(sum(want.values()) - sum(sums.values())) < 1e-3
    for s, g in by.items():
        ratio = want[s] / sums[s]
        for r in g:
            assert r["source_size"] == sums[s] and r["target"] == pytest.approx(want[s])
            assert r["taken"] in (int(ratio) * r["size"], (int(ratio) + 1) * r["size"]) and r["taken"] <= 3 * r["size"]
        assert abs(sum(r["taken"] for r in g) - want[s]) <= max(r["size"] for r in g)


def test_language_rows(spark, sf):
    model = langid.fitted(spark.read.parquet(f"{sf}/documents.parquet"))
    got = {r["doc_id"]: r for r in langid.op9_language_id(spark, sf).collect()}
    for r in documents(sf):
        lang, score, rejected = model.predict(r["text"])
        g = got[r["doc_id"]]
        assert (g["held_out"], g["lang_pred"], g["rejected"]) == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0, lang, rejected) and g["score"] == pytest.approx(score)


def test_pii_rows(spark, sf):
    got = {r["doc_id"]: r for r in pii.op1_pii(spark, sf).collect()}
    for r in documents(sf):
        base = brute_pii(r["text"])
        g = got[r["doc_id"]]
        assert g["base_sha256"] == sha(pii.spell(base)) and set(pii.spell(base).split(",")) - {""} <= set(g["spans"].split(","))


def test_token_rows(spark, sf):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_store.default_path())
    got, start = {r["doc_id"]: r for r in token_store.op6_token_planes(spark, sf).collect()}, 0
    for r in sorted(documents(sf), key=lambda r: r["doc_id"])[:80]:
        ids = [*t.encode(r["text"], add_special_tokens=False).ids, 0]
        g = got[r["doc_id"]]
        assert (g["start"], g["n_tokens"], g["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_pipeline_rows(spark, sf):
    """Each stage's rows from the rows before it."""
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("doc_id < 120")
    before = [tuple(r) for r in docs.collect()]
    model = langid.fitted(docs)
    stage = corpus_pipeline.identified(spark, docs, sf)
    said = [(r, model.predict(r[1])) for r in before]
    kept = [(r[0], r[1], p[0], r[3], r[4]) for r, p in said if not p[2]]
    assert Counter(map(tuple, stage.collect())) == Counter(kept)

    docs = spark.createDataFrame(kept, SCHEMA)
    parts = brute_components([(r[0], r[1]) for r in kept])
    first = {c for _, c in parts.values()}
    kept = [r for r in kept if r[0] in first]
    assert Counter(map(tuple, corpus_pipeline.deduplicated(spark, docs, sf).collect())) == Counter(kept)

    docs = spark.createDataFrame(kept, SCHEMA)
    kept = [(r[0], text := pii.redacted(r[1]), r[2], r[3], len(text)) for r in kept]
    assert Counter(map(tuple, corpus_pipeline.redacted(spark, docs, sf).collect())) == Counter(kept)

    docs = spark.createDataFrame(kept, SCHEMA)
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(docs).collect()}
    kept = [r for r in kept for _ in range(copies[r[0]])]
    assert Counter(map(tuple, corpus_pipeline.mixed(spark, docs, sf).collect())) == Counter(kept)

    t = Tokenizer.from_file(bpe.default_path())
    want = Counter()
    for r in kept:
        ids = t.encode(r[1], add_special_tokens=False).ids
        want[r[0], len(ids), sha(np.array(ids, "<u4").tobytes()), sha(t.decode(ids, skip_special_tokens=False))] += 1
    assert Counter(map(tuple, corpus_pipeline.encoded(spark, spark.createDataFrame(kept, SCHEMA), sf).collect())) == want


# --- odd tables


WORDS = " ".join(f"word{i}" for i in range(120))
LONG = "long text of many words " * 40_000
MORE = [(20, WORDS, "en", "s"), (21, WORDS + " end", "en", None), (22, WORDS + " end", None, "s"), (None, WORDS + " stop", "de", "s"), (30, LONG, "en", "t"), (31, LONG, "en", "t")]
ROWS = [(d, t, "en" if k % 2 else None, "s" if k % 3 else None) for k, (d, t) in enumerate(ODD)] + MORE
CLASH = ["n_email", "spans", "size", "taken", "copies", "source_size", "target", "node", "n", "blob", "t", "h", "score", "rejected", "held_out", "_key", "_node", "rank", "list", "block", "log_p", "perplexity", "keep", "component", "blob", "run"]


def table_of(spark, kind, rows=ROWS):
    df = spark.createDataFrame(rows, f"doc_id {kind}, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    for c in CLASH:
        df = df.withColumn(c, F.lit("clash"))
    return df


OPERATORS = {
    "pii": lambda df: pii.find_pii(df),
    "winnowing": lambda df: winnowing.fingerprints(df),
    "suffix": lambda df: suffix_dedup.remove_repeats(df),
    "quality": lambda df: kneser_ney.judge(df, df.filter("doc_id < 7").select("doc_id")),
    "tokens": lambda df: token_store.read_tokens(df.sparkSession, token_store.write_tokens(df, shared_path(df.sparkSession, "odd")), dict(df.dtypes)["doc_id"]),
    "mixing": lambda df: mixing.mix(df).select("doc_id", "size", "source_size", "target", "taken"),
    "bpe": lambda df: bpe.encode_decode(df),
    "language": lambda df: langid.identify(df).select("doc_id", "held_out", "lang_pred", "score"),
    "jaccard": lambda df: jaccard_join.join_components(df),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_tables(spark, name):
    """A row for each row whatever its id, an empty result for an empty table, no name that clashes, int ids as good as long ones."""
    run = OPERATORS[name]
    long_, int_ = (sorted(map(str, run(table_of(spark, kind)).collect())) for kind in ("long", "int"))
    assert len(long_) == len(ROWS) and long_ == int_
    assert run(table_of(spark, "long", [])).count() == 0


def test_odd_ids_and_links(spark):
    """Links and repeats over null and repeated ids."""
    got = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in jaccard_join.join_components(table_of(spark, "int")).collect()}
    assert got[20, 116] == got[21, 117] == got[22, 117] == got[None, 117] == 20
    removed = {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in suffix_dedup.remove_repeats(table_of(spark, "long", [r for r in ROWS if r[0] in (20, 21, 22, 30, 31)])).collect()}
    want = brute_removal([(r[0], r[1]) for r in ROWS if r[0] in (20, 21, 22)])
    assert removed[21] == removed[22] == want[21][1:3] and removed[30] == (len(LONG), 1) == removed[31]


def test_quality_with_int_ids(spark):
    """Labels of another width than the documents' ids still name the trusted texts."""
    rows = [(i, f"the cat sat on the mat {i}" if i < 30 else "zxq vvk jjw qqx " * 4, "en", "s") for i in range(40)]
    got = {r["doc_id"]: r["keep"] for r in kneser_ney.judge(table_of(spark, "int", rows), spark.createDataFrame([(i,) for i in range(20)], "doc_id long")).collect()}
    assert all(got[i] for i in range(20)) and not any(got[i] for i in range(30, 40))


def test_filter_takes_integers_of_any_width(spark):
    few, many = spark.createDataFrame([(3,), (5,)], "k int"), spark.range(10)
    assert {r["id"] for r in maybe_in(many, "id", few, "k").collect()} >= {3, 5}
    assert maybe_in(many.select(F.col("id").cast("string").alias("id")), "id", few, "k").count() == 10


def test_pipeline_on_odd_tables(spark):
    empty = table_of(spark, "long", []).select(*SCHEMA.replace(",", "").split()[::2])
    docs = table_of(spark, "long").select(*SCHEMA.replace(",", "").split()[::2])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0
        assert stage(spark, docs, "").count() > 0
    left = [(r["doc_id"], r["text"]) for r in corpus_pipeline.deduplicated(spark, docs, "").collect()]
    assert Counter(t for _, t in left)[LONG] == 1 and sum((t or "").startswith("word0") for _, t in left) == 1 and (1, None) in left and (2, "") in left


def test_ties_keep_the_smaller_id(spark):
    rows = [(i, [1.0, 0.0]) for i in range(50)] + [(100, [0.0, 1.0])]
    got = [(r["rank"], r["vec_id"]) for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).filter("query_id = 20").orderBy("rank").collect()]
    assert got == [(k + 1, i) for k, i in enumerate([i for i in range(21) if i != 20][:20])]
