"""Runs of words that repeat with a period, found by masking and Main-Lorentz.

A run is a stretch of words with smallest period q, of at least `LEAST` words and `TIMES` periods, that no neighbouring word
extends. Such a run and its copy q words on overlap in at least `GRAM` words (LEAST - q of them for short periods, (TIMES - 1) q for long
ones; the least of the greater of both), so each of its words lies in a run of GRAM words that the
document holds again. All words outside such repeated GRAM-grams are masked: in most documents that is all of them. What
survives is cut into segments, to which Main-Lorentz is applied: in blocks of doubling size, for every centre and every period up
to a third of the block, the matches to both sides of a place left and right of the centre are extended as far as they go. Extensions are read from tables
of the names of all stretches of 1, 2, 4 ... words, so that they are exact, and the pairs of a level are extended together.

Defined results: null text has no words and no runs. A text is one row whatever its length; memory grows with its surviving words
times the logarithm of their number. Repeated rows each give a row. `words` are what lies between bytes 0x20 and 0x09 to 0x0D.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.shipping import ship
from .common import slices, table, trimmed

LEAST, TIMES = 24, 3
#: The least overlap of a run with itself one period on.
GRAM = min(max(LEAST - q, (TIMES - 1) * q) for q in range(1, LEAST + 1))
#: Pairs of places that are extended at once.
CHUNK = 1 << 18
_MIX = np.uint64(0x9E3779B97F4A7C15)
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def surviving(words: list[bytes]) -> list[tuple[int, int]]:
    """Stretches [a, b) of words in repeated GRAM-grams, long enough for a run. A hash that is equal by chance only masks less."""
    if len(words) < LEAST:
        return []
    grams, size = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64) * _MIX, 1
    with np.errstate(over="ignore"):
        factor = _MIX
        while size < GRAM:  # of two parts, which overlap in the last step
            step = min(size, GRAM - size)
            grams = grams[:-step] * factor + grams[step:]
            grams ^= grams >> np.uint64(29)
            factor, size = factor * _MIX + np.uint64(2), size + step
    order = np.argsort(grams)
    same = grams[order[1:]] == grams[order[:-1]]
    if not same.any():
        return []
    twice = np.zeros(len(grams) + 1, np.int64)
    twice[order[1:][same]] = 1
    twice[order[:-1][same]] = 1
    edge = np.zeros(len(words) + 1, np.int64)
    edge[: len(grams)] += twice[:-1]
    edge[GRAM : GRAM + len(grams)] -= twice[:-1]
    inside = np.cumsum(edge) > 0
    ends = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    return [(a, b) for a, b in zip(ends[::2].tolist(), ends[1::2].tolist()) if b - a >= LEAST]


class Names:
    """Equal stretches of 2^k symbols have equal names, for every k; extends matches by them."""

    def __init__(self, symbols: np.ndarray):
        self.n, self.tables = len(symbols), [symbols.astype(np.int32)]
        while 2 << (len(self.tables) - 1) <= self.n:
            last, by = self.tables[-1].astype(np.int64), 1 << (len(self.tables) - 1)
            _, names = np.unique(last[:-by] * (self.n + 1) + last[by:], return_inverse=True)
            self.tables.append(names.astype(np.int32))

    def same(self, i: np.ndarray, j: np.ndarray, k: int) -> np.ndarray:
        """Whether 2^k symbols from i and from j > i are there and equal."""
        own = self.tables[k]
        ok = (i >= 0) & (j < len(own))
        return ok & (own[np.where(ok, i, 0)] == own[np.where(ok, j, 0)])

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest match from i and from j > i."""
        far = np.zeros(len(i), np.int64)
        for k in range(len(self.tables) - 1, -1, -1):
            far += self.same(i + far, j + far, k).astype(np.int64) << k
        return far

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest match that ends before i and before j > i."""
        far = np.zeros(len(i), np.int64)
        for k in range(len(self.tables) - 1, -1, -1):
            far += self.same(i - far - (1 << k), j - far - (1 << k), k).astype(np.int64) << k
        return far


def main_lorentz(symbols: np.ndarray) -> np.ndarray:
    """(start, length, period) of all runs, by start. symbols: small integers from 0."""
    n, found = len(symbols), []
    if n < LEAST:
        return np.empty((0, 3), np.int64)
    names = Names(symbols)
    half = 1
    while 2 * half < LEAST:
        half *= 2
    while half < n:
        # a run of at most 2 * half words that crosses the centre; its period is a third at most
        centres, most = np.arange(half, n, 2 * half), min(2 * half, n) // TIMES
        step = max(1, CHUNK // len(centres))
        for first in range(1, most + 1, step):
            periods = np.arange(first, min(first + step, most + 1))
            c, q = np.repeat(centres, len(periods)), np.tile(periods, len(centres))
            for i in (c - q, c):  # the place one period before its equal: left and right of the centre
                j, at = i + q, np.flatnonzero((i >= 0) & (i + q <= n))
                # of 2 q equal pairs around the place at least q lie on one side
                k = np.zeros(len(at), np.int64)
                for size in range(1, len(names.tables)):
                    k[q[at] >= 1 << size] = size
                near = np.zeros(len(at), bool)
                for size in np.unique(k).tolist():
                    own = np.flatnonzero(k == size)
                    a, b, w = i[at[own]], j[at[own]], 1 << size
                    near[own] = names.same(a, b, size) | names.same(a - w, b - w, size)
                at = at[near]
                if len(at):
                    a, b = i[at], j[at]
                    back, on = names.backward(a, b), names.forward(a, b)
                    length = back + on + q[at]
                    good = length >= np.maximum(LEAST, TIMES * q[at])
                    found.append(np.stack([a - back, length, q[at]], axis=1)[good])
        half *= 2
    runs = np.concatenate(found) if found else np.empty((0, 3), np.int64)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    # a multiple of a run's period gives the same stretch
    new = np.ones(len(runs), bool)
    new[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    return runs[new]


def runs_of(words: list[bytes]) -> np.ndarray:
    """(start, length, period) of all runs of words, by start, then period."""
    segments = surviving(words)
    if not segments:
        return np.empty((0, 3), np.int64)
    ids: dict[bytes, int] = {}
    symbols, place = [], []
    for k, (a, b) in enumerate(segments):  # one after the other, with a symbol of its own between
        symbols += [ids.setdefault(w, len(ids)) for w in words[a:b]] + [-1 - k]
        place.append(a)
    flat = np.array(symbols)
    flat[flat < 0] = len(ids) + np.arange(len(segments))
    runs = main_lorentz(flat)
    if not len(runs):
        return runs
    base = np.cumsum([0] + [b - a + 1 for a, b in segments[:-1]])
    own = np.searchsorted(base, runs[:, 0], "right") - 1
    runs[:, 0] += np.array(place)[own] - base[own]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def collapsed(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words without what any run holds after its first period."""
    if not len(runs):
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return [words[k] for k in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]


def find_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) and collapsed, the text without repeats, its words joined by one space."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sizes, texts, counts, every = [], [], [0], []
                for text in part.column("text"):
                    words = text.as_py().encode("utf-8", "surrogatepass").split() if text.is_valid else []  # bytes split at 0x20 and 0x09 to 0x0D
                    runs = runs_of(words)
                    sizes.append(len(words))
                    texts.append(b" ".join(collapsed(words, runs)))
                    counts.append(counts[-1] + len(runs))
                    every.append(runs)
                flat = np.concatenate(every) if every else np.empty((0, 3), np.int64)
                cells = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, i])) for i in range(3)], fields=list(_RUNS.value_type))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(counts, pa.int32()), cells), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    kind = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(trimmed(run), kind)


def planted(docs: DataFrame) -> DataFrame:
    """doc_id, text, where a tenth of the documents, by their id's checksum, end in a stretch of words that repeats. A null id changes nothing."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.size("_words").cast("long")
    start = F.col("_g") % n
    period = 1 + F.floor((n - F.col("_a")) / (3 + F.col("_g") % 8))
    again = F.transform(F.sequence(F.col("_a"), n - 1), lambda i: F.get("_words", (F.col("_a") + (i - F.col("_a")) % F.col("_p")).cast("int")))
    edited = F.array_join(F.concat(F.slice("_words", F.lit(1), F.col("_a").cast("int")), again), " ")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("_h", h)
    rows = rows.withColumn("_words", F.when(F.col("_h") % 10 == 0, words)).withColumn("_g", F.floor(F.col("_h") / 10))
    rows = rows.withColumn("_a", F.when(n > 0, start)).withColumn("_p", period)
    return rows.select("doc_id", F.when(F.col("_a").isNotNull(), edited).otherwise(F.col("text")).alias("text"))


def strongest(runs: Column) -> Column:
    """The run with the greatest length over period; of equals the first."""
    return F.aggregate(F.slice(runs, 2, F.greatest(F.size(runs), F.lit(1))), F.get(runs, 0), lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_runs(planted(table(spark, sf_dir, "documents"))).withColumn("_best", strongest(F.col("runs")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        F.col("_best.start").alias("start"), F.col("_best.length").alias("length"), F.col("_best.period").alias("period"),
        F.floor(1000 * F.col("_best.length") / F.col("_best.period")).alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
