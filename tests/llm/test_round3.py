"""Whitening, periodic runs and recompression against brute force, and their defined results for odd tables."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from quernstone.llm import periodic_runs, recompression, whitening

ODD = [(1, None), (2, ""), (3, "word"), (3, "word"), (None, "a b c"), (4, "x y z " * 40), (5, "\x1c \x85 é " * 30)]


def odd_docs(spark, rows=ODD):
    return spark.createDataFrame([(i, t, "en", None, 7) for i, t in rows], "doc_id int, text string, node string, source string, runs int")


# whitening


def plain_whitening(vectors: list[tuple[int, list[float]]]):
    x = np.array([[int(np.floor(1024 * np.float64(c))) + 100000 for c in v] for _, v in vectors], dtype=object)
    n, sums = len(x), x.sum(axis=0)
    centred = (x * n - sums).astype(np.float64) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:8]
    return n, ((x * n - sums) ** 2).sum(axis=1), centred @ axes[:, order] / np.sqrt(values[order]), values[order] / values.sum()


def test_whitening_query(spark, sf):
    vectors = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    n, deviation, white, explained = plain_whitening(vectors)
    got = {(r["vec_id"], r["component"]): r for r in whitening.op11_embedding_whitening(spark, sf).collect()}
    assert len(got) == 8 * n
    for k in range(8):
        own = np.array([got[v, k + 1]["whitened"] for v, _ in vectors])
        sign = np.sign(own @ white[:, k])
        assert np.allclose(sign * own, white[:, k], rtol=1e-9, atol=1e-9)
    for row, (v, _) in enumerate(vectors):
        r = got[v, 3]
        assert r["n"] == n and r["deviation"] == deviation[row] == int(r["deviation_digits"])
        assert abs(r["explained"] / explained[2] - 1) < 1e-9 and r["identity_error"] < 1e-9


def test_whitening_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [3.0, 1.0]), (4, [0.5, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, None), (8, []), (9, [1.0]), (10, [-2.0, 1e9]), (11, [1e300, 0.0])]
    table = spark.createDataFrame([(i, v, "s") for i, v in rows], "vec_id int, embedding array<double>, n string")
    got = whitening.whiten(table).collect()
    kept = [(i, v) for i, v in rows if i in (1, None, 10) and v]
    n, deviation, white, _ = plain_whitening(kept)
    assert n == 4 and sorted(str(r["vec_id"]) for r in got) == sorted(2 * [str(i) for i, _ in kept])
    assert {r["deviation_digits"] for r in got} == {str(d) for d in deviation}
    assert all(r["deviation"] == (int(r["deviation_digits"]) if int(r["deviation_digits"]) < 1 << 63 else None) for r in got)
    assert whitening.whiten(table.filter("vec_id > 11")).count() == 0
    alike = whitening.whiten(spark.createDataFrame([(i, [2.0, 2.0]) for i in range(5)], "vec_id long, embedding array<float>")).collect()
    assert len(alike) == 10 and all(r["whitened"] is None and r["explained"] is None and r["deviation"] == 0 for r in alike)
    line = whitening.whiten(spark.createDataFrame([(i, [i / 8, i / 4]) for i in range(5)], "vec_id long, embedding array<float>")).collect()
    assert all((r["whitened"] is None) == (r["component"] == 2) and r["identity_error"] < 1e-9 for r in line)


@pytest.mark.parametrize("n, far", [(3, 5), (1000, 1 << 40), (1 << 24, 1 << 45)])
def test_deviations_are_exact(n, far):
    rng = random.Random(n)
    x = np.array([[rng.randrange(-far, far) for _ in range(7)] for _ in range(20)])
    sums = [rng.randrange(-far, far) * n + rng.randrange(n) for _ in range(7)]
    assert whitening.deviations(x, sums, n) == [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums)) for row in x]


# periodic runs


def plain_runs(words: list) -> list[tuple[int, int, int]]:
    found: dict[tuple[int, int], int] = {}
    for q in range(1, len(words) // 3 + 1):
        x = 0
        while x + q < len(words):
            start = x
            while x + q < len(words) and words[x] == words[x + q]:
                x += 1
            if x + q - start >= max(24, 3 * q):
                found.setdefault((start, x + q - start), q)
            x += 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def made_words(rng: random.Random) -> list[bytes]:
    kinds, words = rng.choice([1, 2, 2, 3, 5, 50]), []
    for _ in range(rng.randint(0, 12)):
        part = [b"%d" % rng.randrange(kinds) for _ in range(rng.randint(1, 12))]
        words += part * rng.choice([1, 1, rng.randint(2, 8)])
    return words


def test_main_lorentz():
    rng = random.Random(12)
    assert periodic_runs.GRAM == 16
    for _ in range(1500):
        words = made_words(rng)
        assert [tuple(r) for r in periodic_runs.runs_of(words).tolist()] == plain_runs(words)


def plain_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = plain_runs(words)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None,) * 3)
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, digest("".join(f"{s},{m},{q}\n" for s, m, q in runs)), digest(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_periodic_runs_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {tuple(r) for r in periodic_runs.op12_periodic_runs(spark, sf).collect()}
    assert got == {plain_row(*r) for r in docs} and sum(r[1] > 0 for r in got) > 3


def test_periodic_runs_odd_table(spark, tmp_path):
    odd_docs(spark, [*ODD, *((i, "one two\tthree\x0bfour  " * (i % 23)) for i in range(100, 160))]).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in periodic_runs.op12_periodic_runs(spark, str(tmp_path)).collect()), key=str)
    want = [plain_row(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{tmp_path}/documents.parquet").collect()]
    assert got == sorted(want, key=str)
    assert periodic_runs.find_runs(odd_docs(spark, [])).count() == 0


def test_long_text_with_runs():
    words = [b"%d" % (i % 7001) for i in range(70_000)] + [b"x"] * 30
    assert periodic_runs.runs_of(words).tolist() == [[0, 70_000, 7001], [70_000, 30, 1]]


# recompression


def plain_removals(texts: list[str | None]) -> list[tuple[int, int, str]]:
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen: dict[tuple, int] = {}
    for w in words:
        for i in range(len(w) - 34):
            seen[tuple(w[i : i + 35])] = seen.get(tuple(w[i : i + 35]), 0) + 1
    out = []
    for w in words:
        gone = {i + k for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for k in range(35)}
        out.append((len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    return out


def made_texts(rng: random.Random, n: int) -> list[str | None]:
    """Copies, near copies, shared passages, words in runs and periods."""
    word = lambda: f"w{rng.randrange(rng.choice([2, 30, 3000]))}"
    passages = [[word() for _ in range(rng.randint(20, 90))] for _ in range(8)]
    texts: list[str | None] = [None, "", "one"]
    while len(texts) < n:
        kind, w = rng.randrange(6), [word() for _ in range(rng.randint(0, 200))]
        if kind == 0 and texts[-1]:
            w = texts[-1].split()
            if w and rng.random() < 0.7:
                w[rng.randrange(len(w))] = word()
        elif kind == 1:
            w += [word()] * rng.randint(30, 90) + w[:50]
        elif kind == 2:
            w += (w[: rng.randint(1, 9)] or ["x"]) * rng.randint(5, 15)
        elif kind > 3:
            at = rng.randint(0, len(w))
            w[at:at] = rng.choice(passages)
        texts.append(rng.choice([" ", "  ", "\t"]).join(w))
    return texts


def test_equal_windows_have_equal_anchors():
    rng = random.Random(3)
    words = np.array([rng.randrange(9) for _ in range(3000)] + [1] * 80 + [5, 6, 7] * 40, np.uint64)
    words = recompression.mix(np.concatenate([words, words[::-1], words[500:2500]]) + np.uint64(1))
    sizes = np.array([1000, len(words) - 1000])
    name, place, _, lo, hi = recompression.anchored(words, sizes)
    seen: dict[bytes, tuple] = {}
    starts = 0
    for k in range(len(name)):
        for i in range(lo[k], hi[k] + 1):
            assert i <= place[k] < i + 35
            assert seen.setdefault(words[i : i + 35].tobytes(), (name[k], place[k] - i)) == (name[k], place[k] - i)
            starts += 1
    assert starts == (sizes - 34).sum()


@pytest.mark.parametrize("seed, rounds", [(1, 5), (2, 1), (3, 12)])
def test_recompression(spark, monkeypatch, seed, rounds):
    monkeypatch.setattr(recompression, "ROUNDS", rounds)
    texts = made_texts(random.Random(seed), 150)
    rows = [(7 if i % 10 == 0 else None if i % 10 == 1 else i, t) for i, t in enumerate(texts)]
    got = recompression.remove_repeats(odd_docs(spark, rows).repartition(3))
    want = [(i, *x) for (i, _), x in zip(rows, plain_removals(texts))]
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want, key=str) and sum(w[2] > 0 for w in want) > 20


def test_recompression_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = [(r[0], *x) for r, x in zip(docs, plain_removals([r[1] for r in docs]))]
    assert sorted(tuple(r) for r in recompression.op13_recompression_dedup(spark, sf).collect()) == sorted(want)
    assert recompression.remove_repeats(odd_docs(spark, [])).count() == 0
    got = recompression.remove_repeats(odd_docs(spark)).collect()
    assert sorted((r["n_words"], r["n_removed"]) for r in got) == [(0, 0), (0, 0), (1, 0), (1, 0), (3, 0), (90, 90), (120, 120)]
