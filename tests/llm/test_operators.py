"""The training-data operators against brute force, exact round trips and held-out accuracy."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quernstone.llm import ann, bpe, jaccard_join, kneser_ney, langid, mixing, pii, suffix_dedup, token_store, winnowing
from quernstone.llm.common import shared_path

DOCS = "doc_id long, text string"
ODD = [(1, None), (2, ""), (3, "  \n"), (3, "  \n"), (4, "x"), (5, "same words again and again here"), (6, "same words again and again here"), (None, "no id"), (7, "long " * 3000)]


def clash():
    """A column whose name clashes with one of an operator's own."""
    from pyspark.sql import functions as F

    return F.lit("clash")


def collected(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


# --- PII


def brute_pii(text):
    rules = (
        (0, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        (1, r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) < 256 for x in m[0].split("."))),
        (2, r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(re.sub("[^0-9]", "", m[0])) <= 19 and pii.luhn(re.sub("[^0-9]", "", m[0]))),
        (3, r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15),
    )
    return sorted(((m.start(), m.end(), k) for k, p, ok in rules for m in re.finditer(p, text) if ok(m)), key=lambda s: (s[0], s[2]))


def test_base_spans():
    rng = random.Random(1)
    for _ in range(20_000):
        text = "".join(rng.choice("a1.@-+ 4()é25") for _ in range(rng.randrange(60)))
        assert pii.base_spans(text) == brute_pii(text), text


@pytest.mark.parametrize(
    ("text", "kind", "span"),
    [
        ("mail john (at) example (dot) com now", "email", "john (at) example (dot) com"),
        ("write jane dot doe at example dot org please", "email", "jane dot doe at example dot org"),
        ("jоhn@exаmple.com x", "email", "jоhn@exаmple.com"),
        ("call plus four nine one five five double three two one zero eight six ok", "phone", "plus four nine one five five double three two one zero eight six"),
        ("ip 10[.]0[.]0[.]1 z", "ip", "10[.]0[.]0[.]1"),
        ("4​111 1111 1111 1111", "card", "4​111 1111 1111 1111"),
    ],
)
def test_disguises(text, kind, span):
    assert [(pii.KINDS[k], text[a:b]) for a, b, k in pii.all_spans(text)[1]] == [(kind, span)]


@pytest.mark.parametrize(
    ("text", "kind", "span"),
    [
        ("from one nine two dot one six eight dot one dot one on", "ip", "one nine two dot one six eight dot one dot one"),
        ("from one zero [dot] oh.0 dot double two on", "ip", "one zero [dot] oh.0 dot double two"),
        ("from 192 dot 168 dot 1 dot 1 on", "ip", "192 dot 168 dot 1 dot 1"),
        ("mail john (at) example dot com now", "email", "john (at) example dot com"),
        ("mail john@example dot com now", "email", "john@example dot com"),
        ("mail john at example [dot] com now", "email", "john at example [dot] com"),
        ("mail jane dot doe at example.com now", "email", "jane dot doe at example.com"),
        *((f"from {ip.translate(to)} on", "ip", ip.translate(to)) for ip in ("192.168.1.1",) for to in ({48 + i: zero + i for i in range(10)} for zero in (0x9E6, 0xE50, 0x1946, 0x1E950))),
    ],
)
def test_more_disguises(text, kind, span):
    assert [(pii.KINDS[k], text[a:b]) for a, b, k in pii.all_spans(text)[1]] == [(kind, span)]


def test_prose_is_no_disguise():
    for text in ("read more at example.com today", "one. two. three. four.", "one dot two dot three", "a dot 1 dot b", "1 dot 2 dot 3 dot 999"):
        assert pii.all_spans(text) == ([], []), text


def test_pii_takes_linear_time():
    import time

    began = time.perf_counter()
    for text in (" " * 1_000_000 + "(", "a dot b" + " " * 1_000_000 + "x dot", "7" * 1_000_000 + " dot (at)", "one two three four " * 50_000):
        pii.all_spans(text)
    assert time.perf_counter() - began < 20
    assert [text[a:b] for text in ["x  jane   (at)   host   [dot]   com y"] for a, b, _ in pii.all_spans(text)[1]] == ["jane   (at)   host   [dot]   com"]


def test_clean_text_stays():
    for text in ("look at the dot", "four one one 1 2 3", "meet at noon (at) home", ""):
        assert pii.all_spans(text) == ([], []) and pii.redacted(text) == text


def test_pii_query_rows(spark):
    got = pii.find_pii(spark.createDataFrame(ODD, DOCS)).collect()
    assert len(got) == len(ODD) and {r["base_sha256"] for r in got} == {hashlib.sha256(b"").hexdigest()}


def test_redact_keeps_columns(spark):
    df = spark.createDataFrame([(1, "a@b.cd", "x"), (2, None, None)], "doc_id long, text string, n_email string")
    assert [tuple(r) for r in pii.redact(df).orderBy("doc_id").collect()] == [(1, "<email>", "x"), (2, None, None)]


# --- winnowing


def test_winnow_positions():
    rng = np.random.default_rng(1)
    for _ in range(100):
        h = rng.integers(0, 6, int(rng.integers(1, 200))).astype(np.uint64) << np.uint64(16)
        w = int(rng.integers(1, 60))
        n = min(w, len(h))
        want = {i + max(j for j in range(n) if h[i + j] == h[i : i + n].min()) for i in range(len(h) - n + 1)}
        assert winnowing.winnow(h, w).tolist() == sorted(want)


def test_shared_runs_share_marks():
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    run = word(winnowing.K + winnowing.W - 1)
    a, b = (winnowing.fingerprint(word(300) + run + word(200)) for _ in range(2))
    assert set(a[0].tolist()) & set(b[0].tolist())
    assert len(winnowing.read(winnowing.spell(a))) == len(a[0])


def test_fingerprint_order(spark):
    rows = [(i, f"text number {i} " * (i % 7)) for i in range(40)]
    got = collected(winnowing.fingerprints(spark.createDataFrame(rows, DOCS)))
    for i, text in rows:
        after = rows[i - 1][1]  # the document before in ascending order; the last follows the first
        assert got[i]["edited_sha256"] == hashlib.sha256(winnowing.edited(text, after).encode()).hexdigest()
    assert winnowing.fingerprints(spark.createDataFrame(ODD, DOCS)).count() == len(ODD)
    assert winnowing.fingerprints(spark.createDataFrame([], DOCS)).count() == 0


# --- suffix dedup


def brute_removal(rows, n=400):
    raw = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(b[i : i + n] for _, b in raw for i in range(len(b) - n + 1))
    out = {}
    for d, b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - n + 1):
            if seen[b[i : i + n]] > 1:
                gone[i : i + n] = b"\1" * n
        spans = sum(1 for i in range(len(b)) if gone[i] and (not i or not gone[i - 1]))
        out[d] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("hot", [512, 4])
def test_suffix_dedup(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    passages = [word(rng.choice((380, 399, 400, 401, 700))) for _ in range(6)]
    texts = ["".join(word(rng.randrange(200)) + (rng.choice(passages)[rng.randrange(20) :] if rng.random() < 0.7 else "") for _ in range(rng.randrange(4))) for _ in range(60)]
    texts += ["a" * 900, "", None, texts[3], texts[3] + "x", "Z" * 450, "Z" * 450] + [word(30) + passages[2] + word(30) for _ in range(20)]
    rows = list(enumerate(texts))
    got = {d: tuple(r)[1:] for d, r in collected(suffix_dedup.remove_repeats(spark.createDataFrame(rows, DOCS))).items()}
    assert got == brute_removal(rows)


# --- Kneser-Ney


def brute_perplexity(texts, order=kneser_ney.ORDER):
    plain = lambda t: "\x01" * (order - 1) + re.sub("[0-9]", "0", " ".join(t.lower().split()))
    a = {order: Counter(plain(t)[i - order + 1 : i + 1] for t in texts for i in range(order - 1, len(plain(t))))}
    for n in range(order - 1, 0, -1):
        before = {}
        for g in a[n + 1]:
            before.setdefault(g[1:], set()).add(g[0])
        a[n] = {g: len(v) for g, v in before.items()}
    cut = {n: kneser_ney.discounts(*(sum(v == k for v in a[n].values()) for k in (1, 2, 3, 4))) for n in a}

    def p(n, g):
        if not n:
            return 1 / (len(a[1]) + 1)
        followers = [c for h, c in a[n].items() if h[:-1] == g[:-1]]
        if not followers:
            return p(n - 1, g[1:])
        less = lambda c: cut[n][min(c, 3) - 1]
        c = a[n].get(g, 0)
        return (max(c - less(c), 0) if c else 0) / sum(followers) + sum(map(less, followers)) / sum(followers) * p(n - 1, g[1:])

    def of(t):
        x = plain(t)
        return math.exp(-sum(math.log(p(order, x[i - order + 1 : i + 1])) for i in range(order - 1, len(x))) / (len(x) - order + 1))

    return of


@pytest.mark.parametrize("parts", [1, 3])
def test_kneser_ney(spark, monkeypatch, parts):
    monkeypatch.setattr(kneser_ney, "GATHERED", 4 if parts > 1 else 1 << 19)
    texts = ["the cat sat on the mat", "the cat ate", "a mat and a hat 12"]
    more = ["the zebra sat!", None, "  "]
    df = spark.createDataFrame([(i, "en", t) for i, t in enumerate(texts + more)], "doc_id long, lang string, text string").repartition(parts)
    got = collected(kneser_ney.judge(df, spark.createDataFrame([(0,), (1,), (2,)], "doc_id long")))
    want = brute_perplexity(texts)
    for i, t in enumerate(texts + more[:1]):
        assert math.isclose(got[i]["perplexity"], want(t), rel_tol=1e-4)
    assert got[4]["perplexity"] is None and not got[5]["keep"] and got[0]["keep"]


def test_kneser_ney_parts_do_not_follow_splits(spark, sf, monkeypatch, tmp_path):
    monkeypatch.setattr(kneser_ney, "PART_BYTES", 40_000)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs.coalesce(1).write.option("parquet.block.size", 20_000).option("parquet.page.size", 2_000).parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d")).select("doc_id", "lang", "text")
    model = kneser_ney.train(docs.filter("doc_id % 2 = 0"))
    want = {r["doc_id"]: r["log_p"] for r in kneser_ney.scored(spark.createDataFrame(docs.collect(), docs.schema), model).collect()}
    held = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1g")
        found = kneser_ney.scored(docs, model)
        for size in ("30k", "100k", "1g"):  # other splits than when parts were named
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1k")
            got = found.select("*")
            assert {r["doc_id"]: r["log_p"] for r in got.collect()} == want
        monkeypatch.setattr(kneser_ney, "_looked_up", lambda model, named, shards: named.select("_part", "blob").filter("_part % 3 = 0"))
        with pytest.raises(Exception, match="was not named"):
            kneser_ney.scored(docs, model).collect()
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


# --- nearest neighbours


def test_ann_recall(spark):
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(30, 16))
    x = (centers[rng.integers(0, 30, 1500)] + 0.3 * rng.normal(size=(1500, 16))).astype(np.float32)
    x[100:140] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1500, None), (1501, [0.0] * 16), (1502, [float("nan")] * 16), (1503, [1.0])]
    got = {}
    for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    y, hits = x.astype(np.float64), 0
    for q in range(0, 1500, 20):
        s = y @ y[q]
        s[q] = -np.inf
        want = np.lexsort((np.arange(1500), -s))[:20]
        found = sorted(got[q])
        assert [f[0] for f in found] == list(range(1, 21)) and all(math.isclose(f[2], y[q] @ y[f[1]], rel_tol=1e-9) for f in found)
        hits += len({f[1] for f in found} & set(want.tolist()))
    assert hits / (75 * 20) >= 0.9 and set(got) == set(range(0, 1500, 20))


@pytest.mark.parametrize("clusters", [60, 12_000])
def test_ann_looks_far_enough(clusters):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(clusters, 64))[rng.integers(0, clusters, 12_000)] + 1.2 * rng.normal(size=(12_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = ann.Index(1.0, ann.balanced_centroids(np.concatenate([x, np.zeros((len(x), 1))], axis=1), len(x) // ann.LIST))
    index.calibrate(x[::3], 20)
    homes, hits = index.homes(x), 0
    for q, lists in zip(x[:100], index.looks(x[:100])):
        seen = set(lists.tolist())
        hits += sum(not seen.isdisjoint(homes[i].tolist()) for i in np.argsort(-(x @ q), kind="stable")[:20])
    assert hits >= 0.95 * 100 * 20


def test_graph_search():
    c = np.random.default_rng(4).normal(size=(3000, 8)).astype(np.float32)
    graph = ann.Graph(c)
    q = np.random.default_rng(5).normal(size=(50, 8)).astype(np.float32)
    true = ((c[None] - q[:, None]) ** 2).sum(axis=2)
    ids, d = graph.search(q, ann.HOME_BEAM)
    assert sum(true.argmin(axis=1) == ids[:, 0]) >= 48
    assert np.allclose(d, np.take_along_axis(true, ids, axis=1), atol=1e-3) and (np.diff(d, axis=1) >= 0).all()
    few = ann.Graph(c[:30])
    ids, _ = few.search(q, 100)  # a beam as wide as the graph finds all
    assert (np.sort(ids, axis=1) == np.arange(30)).all() and (ids == np.argsort(true[:, :30], axis=1, kind="stable")).mean() > 0.99
    one = ann.Graph(c[:1]).search(q, 5)
    assert one[0].shape == (50, 1)


def brute_nearest(rows, every=20, top=20):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and any(v)]
    sizes = Counter(len(v) for _, v in good)
    width = min(sizes, key=lambda n: (-sizes[n], n)) if sizes else 0
    good = [(i, v) for i, v in good if len(v) == width]
    out = {}
    for q in {i for i, _ in good if i % every == 0}:
        best = {}
        for i, v in good:
            if i != q:
                best[i] = max(best.get(i, -np.inf), *(float((v * w).sum()) for j, w in good if j == q))
        out[q] = sorted((-s, i) for i, s in best.items())[:top]
    return {q: v for q, v in out.items() if v}


def test_ann_odd_vectors(spark):
    """Odd lengths, nulls, zero and infinite vectors, repeated and null ids, ties; everything lies in a few lists."""
    rng = np.random.default_rng(12)
    rows = [(i, [float(x) for x in rng.normal(size=8).astype(np.float32)]) for i in range(300)]
    rows += [(1000 + 20 * i, [1.0, 2.0, 3.0]) for i in range(5)] + [(2000, None), (2001, [0.0] * 8), (2002, [None] * 8), (2003, [float("inf")] * 8), (None, [1.0] * 8)]
    rows += [(40, [float(x) for x in rng.normal(size=8).astype(np.float32)]) for _ in range(60)] + [(41, rows[41][1]) for _ in range(60)] + [(301, rows[41][1]), (302, rows[41][1])]
    got = {}
    for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = brute_nearest(rows)
    assert set(got) == set(want)
    for q, found in got.items():
        assert [r for r, _, _ in sorted(found)] == list(range(1, len(found) + 1)) and len(found) == len(want[q])
        assert [i for _, i, _ in sorted(found)] == [i for _, i in want[q]]
        assert np.allclose([s for _, _, s in sorted(found)], [-s for s, _ in want[q]])
    few = spark.createDataFrame(rows[:7], "vec_id int, embedding array<double>")
    assert ann.search(few).count() == 6


def test_ann_empty(spark):
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


# --- token files


def test_planes_round_trip():
    for planes in (4, 32):
        for n in (1, 7, 1001):
            x = np.random.default_rng(n).integers(0, 70_000, n).astype("<u4")
            assert (token_store.from_planes(token_store.to_planes(x, planes), n, planes) == x).all()


def test_encoder_is_the_library():
    from tokenizers import Tokenizer

    t, e = Tokenizer.from_file(token_store.default_path()), token_store.Encoder(token_store.default_path())
    rng = random.Random(3)
    cases = ["", None, " ", "a  b", "\x02x", "x \n y", "a <|endoftext|> b", "don't stop, it's. ok.", "   lead", "trail ", "é,ç. x\ty\x1cz w", "日本 語", "1,2 ,3. a,b"]
    cases += ["".join(rng.choice("ab 's,.\n\x02é1") for _ in range(rng.randrange(40))) for _ in range(1500)]
    ids, n = e.encode(pa.array(cases))
    at = 0
    for c, m in zip(cases, n):
        assert t.encode(c or "", add_special_tokens=False).ids == ids[at : at + m].tolist(), c
        at += m


def test_token_files(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_store.default_path())
    rows = [(i, "word " * i + "end.") for i in range(60)] + [(100, None), (101, "")]
    files = token_store.write_tokens(spark.createDataFrame(rows, DOCS), shared_path(spark, "test"))
    got, start = collected(token_store.read_tokens(spark, files)), 0
    for d, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        assert tuple(got[d]) == (d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert token_store.write_tokens(spark.createDataFrame([], DOCS), shared_path(spark, "none")) == []


# --- mixing


def test_mixing(spark):
    rng = random.Random(7)
    rows = [(i, f"s{i % 5}" if i % 6 else None, "w " * rng.randrange(0, 60)) for i in range(900)]
    rows += [(2000, "tiny", "one"), (2001, "tiny", None)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.mix(df).toPandas()
    assert len(got) == len(rows) and (got["taken"] <= 3 * got["size"]).all()
    by = got.groupby("source", dropna=False).agg(size=("size", "sum"), own=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    assert (by["size"] == by["own"]).all() and math.isclose(by["target"].sum(), by["size"].sum(), rel_tol=1e-9)
    assert (abs(by["taken"] - by["target"]) <= 60).all() and (by["target"] <= 3 * by["size"] + 1e-6).all()
    again = mixing.mix(df).toPandas()
    key = ["doc_id", "taken"]
    assert got[key].sort_values(key).reset_index(drop=True).equals(again[key].sort_values(key).reset_index(drop=True))
    assert mixing.mix(df.limit(0)).count() == 0


def test_water_level(spark):
    sized = spark.createDataFrame([("a", 1000), ("b", 10), ("c", 10)], "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(sized).collect()}
    assert got["b"] == 30 and got["c"] == 30 and math.isclose(got["a"], 960)


# --- BPE


def test_bpe_is_the_library(monkeypatch):
    from tokenizers import Tokenizer

    t, m = Tokenizer.from_file(bpe.default_path()), bpe.load(bpe.default_path())

    def same(text):
        ids = t.encode(text, add_special_tokens=False).ids
        assert bpe.encode(m, text) == ids, text[:80]
        assert bpe.decoded(m, ids) == t.decode(ids, skip_special_tokens=False)

    for text in ("Hello it's the WORLD's 'smart' don't 123 ²½ ª µ", "", " ", "a<|endoftext|>b <|startoftext|> x<|x", "ΑΣΣ ΟΔΟΣ İ é ÇA", "a\x1cb\x85c d", "日本語 한국어", "🙂🙂 ok!!!", "x" * 5000, "ab" * 4000 + "'s", "é" * 3000):
        same(text)
    monkeypatch.setattr(bpe, "FEED", 500)
    rng = random.Random(2)
    for _ in range(60):
        same("".join(rng.choice("abcdefghijklmnop'") for _ in range(rng.choice((100, 1500, 4000)))))
        same("".join(rng.choice("abst 'é1.<|endoftext|>ΣÉ́ \n") for _ in range(rng.choice((20, 900)))))
    assert bpe.encode(m, None) == []


def test_bpe_query_rows(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_path())
    texts = [*ODD, (8, "wörd " * 70_000), (9, "x" * 300_000), (10, "!" * 300_000), (11, "é" * 5000 + " end")]
    got = bpe.encode_decode(spark.createDataFrame(texts, DOCS).withColumn("n_tokens", clash())).collect()
    want = []
    for d, text in texts:
        ids = t.encode(text or "", add_special_tokens=False).ids
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert Counter(map(tuple, got)) == Counter(want)
    assert bpe.encode_decode(spark.createDataFrame([], DOCS)).count() == 0


def test_byte_decoder():
    m = bpe.load(bpe.default_path())
    state = bpe.ByteDecoder(m)
    assert "".join(map(state.feed, bpe.encode(m, "Größe 🙂 ok"))) + state.close() == "größe 🙂 ok "


# --- language


def test_language(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = langid.identify(docs).filter("held_out").select("lang", "lang_pred", "score").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) / len(got) > 0.95 and all(0 <= r["score"] <= 1 for r in got)


def test_language_odd_rows(spark):
    df = spark.createDataFrame([(d, t, "en") for d, t in ODD] + [(9, "123 !?", None)], "doc_id long, text string, lang string")
    got = langid.identify(df).collect()
    assert len(got) == len(ODD) + 1
    assert all(r["lang_pred"] == "und" and r["rejected"] for r in got if not langid.has_letter(r["text"]))
    assert {r["lang_pred"] for r in langid.identify(df.withColumn("lang", df["lang"].substr(9, 1)), langid.train([])).collect()} == {"und"}


def test_unknown_language_is_rejected():
    import pyarrow.parquet as pq

    t = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["doc_id", "text", "lang"]).to_pylist()
    rows = [r for r in t if r["text"] and r["lang"]]
    fresh = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    for left_out in ("de", "es"):
        pieces = []
        for r in rows:
            if r["lang"] != left_out and zlib.crc32(str(r["doc_id"]).encode()) % 5:
                found, aside = langid.stretches(r["text"])
                pieces += [(r["lang"], aside, x) for x in found]
        model = langid.train(pieces)
        said = [(r["lang"], model.predict(r["text"])) for r in fresh]
        unknown = [p[2] for lang, p in said if lang == left_out]
        known = [p[2] for lang, p in said if lang != left_out]
        assert sum(unknown) >= 0.9 * len(unknown) and sum(known) <= 0.02 * len(known)
        rng = random.Random(3)
        junk = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz    ") for _ in range(n)) for n in (60, 300, 5000) for _ in range(20)]
        assert sum(model.predict(x)[2] for x in junk) >= 58


def test_language_sample_is_bounded(spark):
    long_ = "wort und text " * 60_000  # of a long text PIECES stretches go to the driver
    df = spark.createDataFrame([(i, long_, "de") for i in range(8)] + [(20 + i, "short text", "en") for i in range(8)], "doc_id long, text string, lang string")
    got = langid.training_sample(df.unionByName(df))
    assert max(len(ids) for _, _, ids in got) <= max(langid.STRETCHES) and len(got) <= 16 * langid.PIECES
    assert langid.identify(df.limit(0)).count() == 0


def test_many_languages_and_a_hot_row(spark):
    words = lambda k: " ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}{x}" for x in ("umo", "eri", "ast", "olu", "ink") * 4)
    few = spark.createDataFrame([(k, words(k), f"l{k}") for k in range(1001)], "doc_id long, text string, lang string")
    hot = spark.range(200_000).selectExpr("cast(7 as bigint) as doc_id", f"'{words(7)}' as text", "'l7' as lang")
    trained = few.filter(~langid.is_held_out(few.doc_id)).count()
    model = langid.fitted(few)
    assert len(model.langs) == trained and model.weights is not None and model.predict(words(900))[0] in model.langs
    samples = [[(lang, ids.tolist()) for lang, _, ids in langid.training_sample(few.unionByName(hot).repartition(n), 40)] for n in (3, 5)]
    assert samples[0] == samples[1] and len({lang for lang, _ in samples[0]}) == trained


# --- Jaccard join


def shingles(text):
    w = re.findall(r"[^ \t-\r]+", "".join(c.lower() if c.isascii() else c for c in (text or "")))
    if len(w) < 5:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def brute_components(rows):
    sets, root = [(d, shingles(t)) for d, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        least[find(i)] = min(least.get(find(i), 1 << 60), d)
    return {d: (len(s), least[find(i)]) for i, (d, s) in enumerate(sets)}


@pytest.mark.parametrize("piece", [2048, 7])
def test_jaccard_join(spark, monkeypatch, piece):
    monkeypatch.setattr(jaccard_join, "SLICE", piece)  # 7: the long runs are cut
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)]

    def edit(ws, k):
        ws = list(ws)
        for _ in range(k):
            i = rng.randrange(len(ws))
            ws[i : i + (rng.random() < 0.8)] = [rng.choice(words)]
        return ws

    rows = []
    for _ in range(60):
        base = [rng.choice(words) for _ in range(rng.choice((1, 3, 5, 6, 8, 10, 15, 30, 60, 150, 400)))]
        rows += [" ".join(edit(base, k)) for k in (0, *(rng.choice((0, 1, 2, 4, 8)) for _ in range(rng.randrange(5))))]
    hot = [rng.choice(words) for _ in range(120)]
    rows += [" ".join(edit(hot, rng.choice((0, 1, 2, 4, 6)))) for _ in range(80)] + ["", None, "  \n", "A b C", "a B c"]
    rows = list(enumerate(rows))
    got = {d: tuple(r)[1:] for d, r in collected(jaccard_join.join_components(spark.createDataFrame(rows, DOCS))).items()}
    assert got == brute_components(rows)


def test_jaccard_join_empty(spark):
    assert jaccard_join.join_components(spark.createDataFrame([], DOCS)).count() == 0


def test_thin_sets_and_bounds():
    for k in range(25):
        differ, m, spare, over = jaccard_join.universe(k)
        assert m == differ + 1 + spare + over and jaccard_join.band(k)[1] < 1.25 * jaccard_join.band(k)[0] + 1
    s = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 300).astype(np.uint64))
    t = np.sort(np.concatenate([s[40:], s[:5] + np.uint64(1)]))
    bits = min(len(jaccard_join.parities(s)), len(jaccard_join.parities(t)))
    apart = np.bitwise_count(jaccard_join.folded(jaccard_join.parities(s), bits) ^ jaccard_join.folded(jaccard_join.parities(t), bits)).sum()
    assert apart <= len(set(s.tolist()) ^ set(t.tolist()))
