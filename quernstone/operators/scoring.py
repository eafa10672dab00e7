"""BM25 of documents against a set of queries where the documents lie: one pass over the texts, no exchange of hits.

The relational form joins query terms with postings, which makes a row for each (query, term, document) and
shuffles them all. Here the queries, a bounded table, go to the executors as matrices of terms by queries. A task
counts the terms of some documents at a time, weighs them, multiplies, and keeps each query's best; only these leave
the task. Statistics of the queries' terms come from a pass of the same kind. Terms of up to three characters are numbers: code
points plus one, 21 bits each. Texts are normalised here as `retrieval.normal` does, in vectors, as this takes a tenth of the time.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.shipping import ship

#: Rows (query, term) up to which the queries are sent; cells of one block's matrix; documents and characters weighed at once.
HELD, CELLS, DOCS, CHARACTERS = 400_000, 1 << 22, 64, 4 << 20
#: Counts of terms that a task gathers before it adds them up, different terms that it keeps then, and scores in a batch that leaves it.
GATHERED, KEPT, ROWS = 1 << 21, 1 << 20, 1 << 16


# First and last code points of the CJK ranges that choose the size of n-grams.
CJK = ((0x1100, 0x11FF), (0x3040, 0x30FF), (0x31C0, 0x31EF), (0x3200, 0x32FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xA960, 0xA97F), (0xAC00, 0xD7FF), (0xF900, 0xFAFF), (0x20000, 0x2EE5F), (0x2F800, 0x2FA1F), (0x30000, 0x323AF))
_BLANKS = " \t\n\x0b\f\r"


def normalised(text: str) -> str:
    low = text.lower()
    return (low if unicodedata.is_normalized("NFKC", low) else unicodedata.normalize("NFKC", low)).strip(_BLANKS)


def gram_size(codes: np.ndarray) -> int:
    """2 where CJK characters are more than three tenths (rounded down) of the text, else 3."""
    if not len(codes) or codes.max() < CJK[0][0]:
        return 3
    many = sum(int(np.count_nonzero((codes >= a) & (codes <= b))) for a, b in CJK)
    return 2 if many > len(codes) * 3 // 10 else 3


def packed(term: str) -> int:
    out = 0
    for c in term:
        out = out << 21 | ord(c) + 1
    return out


def tokens(text: str) -> np.ndarray:
    """The packed n-grams of a text, in order; a shorter text is one token, an empty one has none."""
    codes = np.frombuffer(normalised(text).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    if not len(codes):
        return codes
    width = min(gram_size(codes), len(codes))
    codes += 1
    out = codes[: len(codes) - width + 1].copy()
    for j in range(1, width):
        out <<= 21
        out |= codes[j : len(codes) - width + 1 + j]
    return out


class Block:
    """Some queries with the matrix of their terms' weights. groups: (query, its token, terms that stand for it)."""

    def __init__(self, qids: list[int], weights: list[tuple[int, int, float]], idf: dict[int, float], groups: list[tuple[int, list[int]]] | None, need: list[int] | None):
        self.qids, self.weights, self.groups = np.array(qids, np.int64), weights, groups
        self.need = None if need is None else np.array(need)
        self.codes = np.unique(np.array([t for _, t, _ in weights], np.int64))
        self.idf = np.array([idf[int(t)] for t in self.codes])

    def matrices(self) -> None:
        """Made on the executor, once a process."""
        if hasattr(self, "w"):
            return
        at = np.searchsorted(self.codes, [t for _, t, _ in self.weights])
        self.w = np.zeros((len(self.codes), len(self.qids)))
        self.w[at, [q for q, _, _ in self.weights]] = [x for _, _, x in self.weights]
        if self.groups is not None:
            self.flat = np.searchsorted(self.codes, np.concatenate([g for _, g in self.groups]))
            self.starts = np.cumsum([0] + [len(g) for _, g in self.groups])[:-1]
            self.of = np.zeros((len(self.qids), len(self.groups)), np.float32)
            self.of[[q for q, _ in self.groups], np.arange(len(self.groups))] = 1

    def scores(self, which: np.ndarray, code: np.ndarray, lengths: np.ndarray, average: float, k1: float, b: float) -> tuple[np.ndarray, np.ndarray]:
        """(queries x documents) scores and numbers of query tokens that a document holds; code[i] is a token of document which[i]."""
        self.matrices()
        docs, terms = len(lengths), len(self.codes)
        at = np.minimum(np.searchsorted(self.codes, code), terms - 1)
        hit = self.codes[at] == code
        tf = np.bincount(which[hit] * terms + at[hit], minlength=docs * terms).reshape(docs, terms)
        i, j = np.nonzero(tf)
        part, count = np.zeros((docs, terms)), tf[i, j]
        part[i, j] = self.idf[j] * count * (k1 + 1) / (count + k1 * (1 - b + b * lengths[i] / average))
        if self.groups is None:
            have = (self.w > 0).T.astype(np.float32) @ (tf > 0).T.astype(np.float32)
        else:  # a bit for each document
            bits = np.zeros(terms, np.uint64)
            np.bitwise_or.at(bits, j, np.uint64(1) << i.astype(np.uint64))
            held = np.bitwise_or.reduceat(bits[self.flat], self.starts)
            have = self.of @ ((held[:, None] >> np.arange(docs, dtype=np.uint64)) & np.uint64(1)).astype(np.float32)
        return (part @ self.w).T, have


def blocks(weights: dict[int, dict[int, float]], idf: dict[int, float], groups: dict[int, list[list[int]]] | None, need: dict[int, int] | None) -> list[Block]:
    """The queries in blocks whose matrices have at most CELLS cells (or one query)."""
    out: list[Block] = []
    part: list[int] = []
    terms: set[int] = set()

    def close() -> None:
        rows = [(k, t, w) for k, q in enumerate(part) for t, w in weights[q].items()]
        grouped = None if groups is None else [(k, g) for k, q in enumerate(part) for g in groups[q] if g]
        out.append(Block(part, rows, idf, grouped, None if need is None else [need[q] for q in part]))

    for q in sorted(weights):
        if part and len(terms | weights[q].keys()) * (len(part) + 1) > CELLS:
            close()
            part, terms = [], set()
        part.append(q)
        terms |= weights[q].keys()
    if part:
        close()
    return out


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, lengths, token's document, token) of some documents."""
    ids, texts = batch.column("doc_id").to_numpy(zero_copy_only=False), batch.column("text")
    long_ = [x or 0 for x in pc.binary_length(texts).to_pylist()]
    start = 0
    while start < len(ids):
        stop, held = start, 0
        while stop < len(ids) and stop - start < DOCS and (stop == start or held + long_[stop] <= CHARACTERS):
            held += long_[stop]
            stop += 1
        found = [tokens(t) for t in texts.slice(start, stop - start).to_pylist()]
        count = np.array([len(x) for x in found])
        yield ids[start:stop], count, np.repeat(np.arange(stop - start), count), np.concatenate(found)
        start = stop


def statistics(docs: DataFrame, terms: list[str]) -> tuple[dict[str, tuple[int, int]], int, int, int]:
    """({term: (df, cf)} of the terms that stand in docs (doc_id, text), number of documents, largest doc_id, number of tokens), by one pass."""
    ship(docs.sparkSession)
    names = {packed(t): t for t in terms if len(t) <= 3}
    shared = docs.sparkSession.sparkContext.broadcast(np.array(sorted(names), np.int64))  # at most HELD terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = shared.value
        df, cf, n, last, total = np.zeros(len(codes), np.int64), np.zeros(len(codes), np.int64), 0, -1, 0
        for batch in batches:
            for ids, lengths, which, code in _chunks(batch):
                n, last, total = n + len(ids), max(last, int(ids.max())), total + int(lengths.sum())
                if not len(codes):
                    continue
                at = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
                hit = codes[at] == code
                cf += np.bincount(at[hit], minlength=len(codes))
                df += np.bincount(np.unique(which[hit] * len(codes) + at[hit]) % len(codes), minlength=len(codes))
        some = np.flatnonzero(cf)
        out = [np.append(codes[some], -1), np.append(df[some], n), np.append(cf[some], total), np.append(np.full(len(some), -1), last)]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["code", "df", "cf", "last"])

    made = docs.mapInArrow(run, "code long, df long, cf long, last long").groupBy("code").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"), F.max("last").alias("last"))
    found = {r["code"]: r for r in made.collect()}  # at most a row a term
    all_ = found.pop(-1, None)
    return {names[c]: (r["df"], r["cf"]) for c, r in found.items()}, *((all_["df"], all_["last"], all_["cf"]) if all_ else (0, -1, 0))


def _tallies(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, lengths, different terms, their codes, their frequencies) of some documents, codes and frequencies document by document."""
    for ids, lengths, _, code in _chunks(batch):
        found = [np.unique(x, return_counts=True) for x in np.split(code, np.cumsum(lengths)[:-1])]
        yield ids, lengths, np.array([len(x) for x, _ in found]), np.concatenate([x for x, _ in found]), np.concatenate([n for _, n in found])


def counts(docs: DataFrame) -> DataFrame:
    """(code, df, cf, last) of all packed terms of docs (doc_id, text); behind code -1 the numbers of documents and tokens and the largest doc_id. One pass.

    A task adds up its documents' terms and passes on what it has whenever that is more than KEPT terms, so that Spark groups a few rows a term."""
    ship(docs.sparkSession)
    names = ["code", "df", "cf", "last"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.empty(0, np.int64)
        held, parts, size, n, last, total = (none, none, none), [], 0, 0, -1, 0

        def added() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            code, at = np.unique(np.concatenate([held[0], *[x for x, _ in parts]]), return_inverse=True)
            df, cf = np.zeros(len(code), np.int64), np.zeros(len(code), np.int64)
            np.add.at(df, at, np.concatenate([held[1], *[np.ones(len(x), np.int64) for x, _ in parts]]))
            np.add.at(cf, at, np.concatenate([held[2], *[y for _, y in parts]]))
            return code, df, cf

        for batch in batches:
            for ids, lengths, _, code, tf in _tallies(batch):
                n, last, total, size = n + len(ids), max(last, int(ids.max())), total + int(lengths.sum()), size + len(code)
                parts.append((code, tf))
                if size > GATHERED:
                    held, parts, size = added(), [], 0
                    if len(held[0]) > KEPT:
                        yield pa.RecordBatch.from_arrays([*map(pa.array, held), pa.array(np.full(len(held[0]), -1))], names)
                        held = (none, none, none)
        out = [np.append(x, y) for x, y in zip(added(), (-1, n, total))]
        yield pa.RecordBatch.from_arrays([*map(pa.array, out), pa.array(np.append(np.full(len(out[0]) - 1, -1), last))], names)

    return docs.mapInArrow(run, "code long, df long, cf long, last long").groupBy("code").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"), F.max("last").alias("last"))


def spelt(code: Column) -> Column:
    """The term of a packed code."""

    def letter(shift: int) -> Column:
        x = F.shiftright(code, shift).bitwiseAND(F.lit((1 << 21) - 1))
        return F.when(x > 0, F.decode(F.unhex(F.lpad(F.hex(x - 1), 8, "0")), "UTF-32")).otherwise("")

    return F.concat(letter(42), letter(21), letter(0))


def profiles(docs: DataFrame) -> DataFrame:
    """(doc_id, dl, terms, max_tf) of docs (doc_id, text): length, different terms and the largest frequency, where the documents lie."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, lengths, terms, _, tf in _tallies(batch):
                most = np.array([x.max(initial=0) for x in np.split(tf, np.cumsum(terms)[:-1])], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lengths, pa.int64()), pa.array(terms, pa.int64()), pa.array(most)], ["doc_id", "dl", "terms", "max_tf"])

    return docs.mapInArrow(run, "doc_id long, dl long, terms long, max_tf long")


def every(docs: DataFrame, queries: list[Block], average: float, k1: float, b: float) -> DataFrame:
    """(qid, doc_id, score) of all documents with a term of the query, where the documents lie. docs: (doc_id, text)."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(queries)  # at most HELD rows
    names = ["qid", "doc_id", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for ids, lengths, which, code in _chunks(batch):
                for block in shared.value:
                    score = block.scores(which, code, lengths, average, k1, b)[0]
                    i, j = np.nonzero(score > 0)
                    held.append((block.qids[i], ids[j], score[i, j]))
                    size += len(i)
                    if size > ROWS:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held)], names)
                        held, size = [], 0
        if size:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held)], names)

    return docs.mapInArrow(run, "qid long, doc_id long, score double")


def best(docs: DataFrame, queries: list[Block], average: float, k: int, k1: float, b: float) -> DataFrame:
    """(qid, doc_id, score): of each task the k best of each query, by rounded score, then doc_id. docs: (doc_id, text)."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(queries)  # at most HELD rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [(np.full((len(x.qids), k), -np.inf), np.zeros((len(x.qids), k), np.int64)) for x in shared.value]
        for batch in batches:
            for ids, lengths, which, code in _chunks(batch):
                for at, block in enumerate(shared.value):
                    score, have = block.scores(which, code, lengths, average, k1, b)
                    score[(score <= 0) | (have < (1 if block.need is None else block.need[:, None]))] = -np.inf
                    every = np.concatenate([found[at][0], score], axis=1)
                    name = np.concatenate([found[at][1], np.broadcast_to(ids, score.shape)], axis=1)
                    order = np.lexsort((name, -np.round(every, 6)), axis=1)[:, :k]
                    found[at] = np.take_along_axis(every, order, axis=1), np.take_along_axis(name, order, axis=1)
        for block, (score, name) in zip(shared.value, found):
            i, j = np.nonzero(np.isfinite(score))
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(block.qids[i]), pa.array(name[i, j]), pa.array(score[i, j])], ["qid", "doc_id", "score"])

    return docs.mapInArrow(run, "qid long, doc_id long, score double")


def matched(docs: DataFrame, queries: list[Block]) -> DataFrame:
    """(qid, docs): in how many documents any term of the query stands."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(queries)  # at most HELD rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros(len(x.qids), np.int64) for x in shared.value]
        for batch in batches:
            for _, lengths, which, code in _chunks(batch):
                for at, block in enumerate(shared.value):
                    sums[at] += (block.scores(which, code, lengths, 1.0, 1.2, 0.75)[1] > 0).sum(axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x.qids for x in shared.value])), pa.array(np.concatenate(sums))], ["qid", "docs"])

    return docs.mapInArrow(run, "qid long, docs long").groupBy("qid").agg(F.sum("docs").alias("docs"))
