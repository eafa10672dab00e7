"""A stored inverted index: immutable segments of posting blocks, deletions, merges, and searches that read the blocks of their terms.

Documents lie in ranges of at most `RANGE`. A block holds the postings of a term in a range: places of documents in it, term frequencies,
and what bounds any of their scores, the greatest frequency and the least document length. Blocks are rows of a Parquet table, sorted by term within
a range, in small row groups: a search filters by stretches of term codes, which the reader checks against the statistics of groups and
pages, so that it reads little but its terms' blocks. A segment is what one append wrote, in one pass over the texts without a shuffle.

A search deals the blocks by range. Within one, terms are taken by falling bound; from time to time documents are left out that
cannot come among a query's best whatever the terms left would add (nor reach the number of terms that it asks for). When none is left, neither are the blocks looked at.

Deleting writes the places of the dead and what they take from the terms' counts, so that statistics are those of a rebuilt
index. Merging rewrites segments of a tier once there are `FAN` of them, without the texts and without the dead. Every change is a new version of a
manifest (sources/snapshots.py): a search keeps the one it began with. All documents are numbered by ids of their own: N is their number (dense) or the greatest id + 1, as `Index` has it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.shipping import ship
from ..plans.staging import new_path
from ..sources.snapshots import Snapshots
from ..sources.tables import spread, table
from . import retrieval, scoring

#: Documents and tokens of a range; bytes of a row group; stretches of codes in a filter; segments of a tier that are merged; queries scored at once.
#: (A filter of 64 stretches or more makes a method that the JVM does not compile: four times as slow as one of 32.)
RANGE, TOKENS, GROUP_BYTES, STRETCHES, FAN, TOGETHER = 2048, 4 << 20, 1 << 18, 32, 8, 256
#: Times that a search looks for documents to leave out.
LOOKS = 8
#: Places of the dead that one deletion sends to the tasks; more are joined.
SENT = 1 << 20
BLOCKS = "range long, code long, df int, cf long, max_tf int, min_dl int, places array<int>, tfs array<int>, ids array<long>"
_SCHEMA = pa.schema([("range", pa.int64()), ("code", pa.int64()), ("df", pa.int32()), ("cf", pa.int64()), ("max_tf", pa.int32()), ("min_dl", pa.int32()), ("places", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int32())), ("ids", pa.list_(pa.int64()))])
_DOCS = -1


def _block_rows(range_: int, ids: np.ndarray, lengths: np.ndarray, code: np.ndarray, place: np.ndarray, tf: np.ndarray) -> pa.RecordBatch:
    """The rows of a range: a block for each term, by code, behind the row of its documents (code -1: ids, and lengths as tfs). Places ascend within a code."""
    order = np.argsort(code, kind="stable")
    code, place, tf = code[order], place[order], tf[order]
    first = np.flatnonzero(np.diff(code, prepend=_DOCS)) if len(code) else np.empty(0, np.int64)
    n, size = len(first), np.diff(first, append=len(code))
    most = np.maximum.reduceat(tf, first) if n else np.empty(0)
    least = np.minimum.reduceat(lengths[place], first) if n else np.empty(0)
    sums = np.add.reduceat(tf, first) if n else np.empty(0)
    lists = lambda own, values, kind: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], own, own[-1] + (first + size if n else np.empty(0))]).astype(np.int32)), pa.array(values, kind))
    none, all_ = np.array([0]), np.array([len(ids)])
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(n + 1, range_)), pa.array(np.append([_DOCS], code[first])), pa.array(np.append([len(ids)], size), pa.int32()), pa.array(np.append([lengths.sum()], sums).astype(np.int64)),
            pa.array(np.append([0], most).astype(np.int32)), pa.array(np.append([0], least).astype(np.int32)),
            lists(none, place, pa.int32()), lists(all_, np.concatenate([lengths, tf]), pa.int32()),
            pa.ListArray.from_arrays(pa.array(np.append([0], np.full(n + 1, len(ids))).astype(np.int32)), pa.array(ids, pa.int64())),
        ],
        schema=_SCHEMA,
    )


def _indexed(docs: DataFrame) -> DataFrame:
    """The block rows of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        ids, lengths, codes, tfs, held = [], [], [], [], 0

        def out() -> pa.RecordBatch:
            count = [len(c) for c in codes]
            return _block_rows(part << 32 | made, np.array(ids, np.int64), np.array(lengths, np.int64), np.concatenate(codes), np.repeat(np.arange(len(ids)), count), np.concatenate(tfs))

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                code = scoring.tokens(text.as_py())
                if ids and (len(ids) == RANGE or held + len(code) > TOKENS):
                    yield out()
                    made, held = made + 1, 0
                    ids, lengths, codes, tfs = [], [], [], []
                own, count = np.unique(code, return_counts=True)
                ids.append(doc_id)
                lengths.append(len(code))
                codes.append(own)
                tfs.append(count)
                held += len(code)
        if ids:
            yield out()

    return docs.mapInArrow(run, BLOCKS)


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Where each list begins in the values of all, and these."""
    at = lists.offsets.to_numpy()
    return at - at[0], lists.values.to_numpy()[at[0] : at[-1]]


def _stretches(*keys: np.ndarray) -> list[tuple[int, int]]:
    """First and end of each stretch of rows with equal keys."""
    cuts = np.flatnonzero(np.any([np.diff(k) != 0 for k in keys], axis=0)) + 1
    return list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys[0])]))


def near(column: Column, codes: np.ndarray) -> Column:
    """Whether a code lies in one of at most STRETCHES stretches around the sorted codes, cut at their widest gaps: what scans can check by statistics."""
    if not len(codes):
        return F.lit(False)
    gaps = np.sort(np.argsort(-np.diff(codes), kind="stable")[: STRETCHES - 1])
    firsts, lasts = codes[np.append([0], gaps + 1)], codes[np.append(gaps, len(codes) - 1)]
    any_ = None
    for a, b in zip(firsts.tolist(), lasts.tolist()):
        one = (column == a) if a == b else column.between(a, b)
        any_ = one if any_ is None else any_ | one
    return any_


class Asked:
    """Queries as they are sent to tasks, at most scoring.HELD rows of (query, term). need: different terms that a document must hold."""

    def __init__(self, weights: dict[int, dict[int, float]], idf: dict[int, float], need: dict[int, int] | None, average: float):
        self.qids, self.average = np.array(sorted(weights), np.int64), average
        at = {q: k for k, q in enumerate(self.qids.tolist())}
        rows = sorted((t, at[q], w) for q, own in weights.items() for t, w in own.items())
        self.codes = np.array(sorted({t for t, _, _ in rows}), np.int64)
        self.query, self.weight = np.array([q for _, q, _ in rows], np.int64), np.array([w for _, _, w in rows])
        self.edges = np.searchsorted(np.array([t for t, _, _ in rows], np.int64), self.codes)
        self.edges = np.append(self.edges, len(rows))
        self.idf = np.array([idf[t] for t in self.codes.tolist()])
        self.need = None if need is None else np.array([need[q] for q in self.qids.tolist()])

    def part(self, tf: np.ndarray, length: np.ndarray, term: int | np.ndarray) -> np.ndarray:
        k1, b = retrieval.K1, retrieval.B
        return self.idf[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / self.average))


class Range:
    """What a task knows of a range: its documents and the blocks of asked terms."""

    def __init__(self, rows: list[pa.RecordBatch]):
        whole = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
        code = whole.column("code").to_numpy()
        at = int(np.flatnonzero(code == _DOCS)[0])
        self.ids, self.lengths = (whole.column(c)[at].values.to_numpy(zero_copy_only=False) for c in ("ids", "tfs"))
        self.alive = np.ones(len(self.ids), bool)
        if whole.column("dead")[at].is_valid:
            self.alive[whole.column("dead")[at].values.to_numpy()] = False
        self.code, self.max_tf, self.min_dl = code, whole.column("max_tf").to_numpy(), whole.column("min_dl").to_numpy()
        self.places, self.tfs = whole.column("places"), whole.column("tfs")
        self.flat_places, self.flat_tfs = (x.values.to_numpy(zero_copy_only=False) for x in (self.places, self.tfs))
        self.place_at, self.tf_at = (x.offsets.to_numpy() for x in (self.places, self.tfs))

    def block(self, row: int) -> tuple[np.ndarray, np.ndarray]:
        return self.flat_places[self.place_at[row] : self.place_at[row + 1]], self.flat_tfs[self.tf_at[row] : self.tf_at[row + 1]]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[Range]:
    """The ranges of sorted rows."""
    held, now = [], None
    for batch in batches:
        key = np.stack([batch.column("segment").to_numpy(), batch.column("range").to_numpy()])
        cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            own = tuple(key[:, a].tolist())
            if own != now and held:
                yield Range(held)
                held = []
            now = own
            held.append(batch.slice(a, b - a))
    if held:
        yield Range(held)


class Best:
    """The best documents of some queries (first to last of asked) over ranges."""

    def __init__(self, asked: Asked, first: int, last: int, k: int):
        self.asked, self.first, self.n, self.k = asked, first, last - first, k
        self.score, self.name = np.full((k, self.n), -np.inf), np.zeros((k, self.n), np.int64)
        self.skipped = self.looked = 0

    def add(self, part: Range) -> None:
        a = self.asked
        at = np.searchsorted(a.codes, part.code)
        rows = np.flatnonzero((at < len(a.codes)) & (a.codes[np.minimum(at, len(a.codes) - 1)] == part.code))
        terms = at[rows]
        own = []  # row, term, queries and weights of these queries
        for row, term in zip(rows.tolist(), terms.tolist()):
            q, w = a.query[a.edges[term] : a.edges[term + 1]], a.weight[a.edges[term] : a.edges[term + 1]]
            mine = (q >= self.first) & (q < self.first + self.n)
            if mine.any():
                own.append((row, term, q[mine] - self.first, w[mine]))
        if not own:
            return
        bound = a.part(part.max_tf[[x[0] for x in own]], part.min_dl[[x[0] for x in own]], np.array([x[1] for x in own]))
        order = np.argsort(-bound * np.array([x[3].max() for x in own]), kind="stable")
        rest, left = np.zeros(self.n), np.zeros(self.n, np.int64)
        for k in order.tolist():
            rest[own[k][2]] += own[k][3] * bound[k]
            left[own[k][2]] += 1
        docs = np.flatnonzero(part.alive)
        where = np.full(len(part.ids), -1)
        where[docs] = np.arange(len(docs))
        score, have = np.zeros((len(docs), self.n)), np.zeros((len(docs), self.n), np.int32)
        look = max(1, len(order) // LOOKS)
        for step, k in enumerate(order.tolist()):
            row, term, q, w = own[k]
            place, tf = part.block(row)
            to = where[place]
            keep = to >= 0
            if keep.any():
                to = to[keep]
                cell = np.ix_(to, q)
                score[cell] += np.outer(a.part(tf[keep], part.lengths[place[keep]], term), w)
                have[cell] += 1
            self.looked += 1
            rest[q] -= w * bound[k]
            left[q] -= 1
            if step % look == look - 1 and step + 1 < len(order):
                held = np.concatenate([self.score, score])
                least = np.partition(held, len(held) - self.k, axis=0)[len(held) - self.k] if len(held) >= self.k else np.full(self.n, -np.inf)
                if a.need is not None:  # a score counts only with enough terms
                    least = np.minimum(least, self.score.min(axis=0))
                may = score + rest + 2e-6 >= least
                if a.need is not None:
                    may &= have + left >= a.need[self.first : self.first + self.n]
                may &= (score > 0) | (rest > 1e-12)
                alive = may.any(axis=1)
                if not alive.any():
                    self.skipped += len(order) - step - 1
                    return
                if alive.mean() < 0.7:
                    docs, score, have = docs[alive], score[alive], have[alive]
                    where[:] = -1
                    where[docs] = np.arange(len(docs))
        bad = score <= 0
        if a.need is not None:
            bad |= have < a.need[self.first : self.first + self.n]
        score[bad] = -np.inf
        every = np.concatenate([self.score, score])
        name = np.concatenate([self.name, np.broadcast_to(part.ids[docs][:, None], score.shape)])
        order_ = np.lexsort((name, -np.round(every, 6)), axis=0)[: self.k]
        self.score, self.name = np.take_along_axis(every, order_, axis=0), np.take_along_axis(name, order_, axis=0)


class StoredIndex:
    """An index in a folder. dense: N is the number of documents. version: None for the newest, which is kept."""

    def __init__(self, spark: SparkSession, path: str, dense: bool = False, version: int | None = None):
        self.spark, self.snapshots, self.dense = spark, Snapshots(spark, path), dense
        self.open(version)

    def open(self, version: int | None = None) -> StoredIndex:
        self.manifest = {"segments": [], "dead": [], "next": 0} | self.snapshots.read(version)
        return self

    # changes

    def append(self, docs: DataFrame, batch: str | None = None) -> None:
        """Index docs (doc_id, text) as a segment; rows without id or text are none. batch: a name whose second append changes nothing."""
        ship(self.spark)
        path = self.snapshots.new_name("segment")
        if batch is not None and batch in self.open().manifest.get("batches", []):
            return
        docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text IS NOT NULL AND doc_id IS NOT NULL")
        _indexed(spread(docs)).write.option("parquet.block.size", GROUP_BYTES).option("parquet.page.size", 1 << 14).parquet(f"{path}/blocks")
        facts = self._facts(path)

        def added(m: dict) -> dict:
            m = {"segments": [], "dead": [], "next": 0} | m
            if batch is not None and batch in m.get("batches", []):
                return m
            batches = {"batches": [*m.get("batches", []), batch][-1000:]} if batch is not None else {}
            return m | {"segments": [*m["segments"], facts | {"number": m["next"]}], "next": m["next"] + 1} | batches

        self.snapshots.change(added)
        self.open()

    def _facts(self, path: str) -> dict:
        """Write the terms of a segment and give its size."""
        blocks = self.spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
        terms = blocks.filter(f"code <> {_DOCS}").groupBy("code").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))
        terms.repartitionByRange("code").sortWithinPartitions("code").write.option("parquet.block.size", GROUP_BYTES).parquet(f"{path}/terms")
        row = blocks.filter(f"code = {_DOCS}").agg(F.sum("df").alias("docs"), F.sum("cf").alias("tokens"), F.max(F.array_max("ids")).alias("last")).first()
        return {"path": path, "docs": row["docs"] or 0, "tokens": row["tokens"] or 0, "last": -1 if row["last"] is None else row["last"]}

    def delete(self, ids: DataFrame) -> None:
        """Take the documents with these ids (doc_id) out of all segments there are; later appends of an id live."""
        ship(self.spark)
        self.open()
        if not self.manifest["segments"]:
            return
        path, numbers = self.snapshots.new_name("dead"), {s["number"] for s in self.manifest["segments"]}
        rows = self._blocks(f"code = {_DOCS}")
        docs = rows.select("segment", "range", "dead", F.posexplode(F.arrays_zip("ids", "tfs")).alias("place", "x")).filter(~F.array_contains(F.coalesce("dead", F.array().cast("array<int>")), F.col("place")))
        found = docs.join(ids.select(F.col("doc_id").cast("long").alias("id")).distinct(), F.col("x.ids") == F.col("id"), "left_semi")
        found.select("segment", "range", "place", F.col("x.tfs").alias("dl"), F.col("x.ids").alias("doc_id")).write.parquet(f"{path}/places")
        places = self.spark.read.parquet(f"{path}/places")
        sums = places.groupBy("segment").agg(F.count(F.lit(1)).alias("docs"), F.sum("dl").alias("tokens")).collect()  # a row a segment
        if not sums:
            self.open()
            return
        hit = places.groupBy("segment", "range").agg(F.collect_list("place").alias("gone"))  # at most RANGE places
        blocks = self._blocks(f"code <> {_DOCS}").filter(F.col("segment").isin([r["segment"] for r in sums])).select("segment", "range", "code", "places", "tfs")
        sent = None
        if sum(r["docs"] for r in sums) <= SENT:  # blocks stay where they lie
            sent = self.spark.sparkContext.broadcast({(r["segment"], r["range"]): np.array(r["gone"]) for r in hit.collect()})
        else:
            blocks = blocks.join(hit, ["segment", "range"])

        def lost(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                segment, range_, code = (batch.column(c).to_numpy() for c in ("segment", "range", "code"))
                (at, place), (_, tf) = _flat(batch.column("places")), _flat(batch.column("tfs"))
                out = np.zeros(len(place), bool)
                for a, b in _stretches(segment, range_):
                    gone = batch.column("gone")[a].values.to_numpy() if sent is None else sent.value.get((int(segment[a]), int(range_[a])))
                    if gone is not None:
                        out[at[a] : at[b]] = np.isin(place[at[a] : at[b]], gone)
                df, cf = (np.add.reduceat(x, at[:-1]) for x in (out.astype(np.int64), np.where(out, tf, 0).astype(np.int64)))
                own = df > 0
                yield pa.RecordBatch.from_arrays([pa.array(x[own]) for x in (segment, code, df, cf)], ["segment", "code", "df", "cf"])

        less = blocks.mapInArrow(lost, "segment long, code long, df long, cf long").groupBy("segment", "code").agg((-F.sum("df")).alias("df"), (-F.sum("cf")).alias("cf"))
        less.repartitionByRange("code").sortWithinPartitions("code").write.parquet(f"{path}/terms")
        entry = {"path": path, "of": {str(r["segment"]): [r["docs"], r["tokens"]] for r in sums}}

        def dead(m: dict) -> dict:
            if not numbers <= {s["number"] for s in m["segments"]}:
                raise RuntimeError("segments were merged meanwhile; delete again")
            return m | {"dead": [*m["dead"], entry]}

        self.snapshots.change(dead)
        self.open()

    def merge(self, every: bool = False) -> int:
        """Rewrite the segments of each tier (powers of FAN documents) that has FAN of them, or all; returns how many were rewritten."""
        ship(self.spark)
        self.open()
        tiers: dict[int, list[dict]] = {}
        for s in self.manifest["segments"]:
            tiers.setdefault(0 if every else int(math.log(max(s["docs"], 1), FAN)), []).append(s)
        old = [s for group in tiers.values() if every or len(group) >= FAN for s in group]
        if not old or (len(old) == 1 and not self.manifest["dead"]):
            return 0
        numbers, path = [s["number"] for s in old], self.snapshots.new_name("segment")
        rows = self._blocks(None).filter(F.col("segment").isin(numbers))
        sizes = rows.filter(f"code = {_DOCS}").select("segment", "range", (F.size("ids") - F.coalesce(F.size("dead"), F.lit(0))).alias("live")).orderBy("segment", "range")
        places, into, held = [], -1, RANGE
        for r in sizes.toLocalIterator():  # a row for RANGE documents
            if held + r["live"] > RANGE:
                into, held = into + 1, 0
            places.append((r["segment"], r["range"], into, len(places), held))
            held += r["live"]
        to = self.spark.createDataFrame(places, "segment long, range long, into long, nth long, shift long")
        names = ["into", "nth", "shift", "code", "places", "tfs", "ids", "dead"]

        def joined(rows_: list[pa.RecordBatch], into_: int) -> pa.RecordBatch:
            whole = pa.Table.from_batches(rows_).combine_chunks().to_batches()[0]
            ids, lengths, code, place, tf = [], [], [], [], []
            nth, shift, codes = (whole.column(c).to_numpy() for c in ("nth", "shift", "code"))
            (at, places_), (tf_at, tfs) = _flat(whole.column("places")), _flat(whole.column("tfs"))
            for a, b in _stretches(nth):  # a range: the row of its documents, then its blocks
                own_ids, dead = whole.column("ids")[a].values.to_numpy(), whole.column("dead")[a]
                live = np.ones(len(own_ids), bool)
                if dead.is_valid:
                    live[dead.values.to_numpy()] = False
                new = np.where(live, shift[a] + np.cumsum(live) - 1, -1)[places_[at[a + 1] : at[b]]]
                own = new >= 0
                ids.append(own_ids[live])
                lengths.append(tfs[tf_at[a] : tf_at[a + 1]][live])
                code.append(np.repeat(codes[a + 1 : b], np.diff(at[a + 1 : b + 1]))[own])
                place.append(new[own])
                tf.append(tfs[tf_at[a + 1] : tf_at[b]][own])
            flat = lambda x: np.concatenate(x) if x else np.empty(0, np.int64)
            return _block_rows(into_, flat(ids), flat(lengths).astype(np.int64), flat(code), flat(place), flat(tf))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held_, now = [], None
            for batch in batches:
                key = batch.column("into").to_numpy()
                cuts = np.flatnonzero(np.diff(key)) + 1
                for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)]):
                    if int(key[a]) != now and held_:
                        yield joined(held_, now)
                        held_ = []
                    now = int(key[a])
                    held_.append(batch.slice(a, b - a))
            if held_:
                yield joined(held_, now)

        dealt = rows.join(F.broadcast(to), ["segment", "range"]).select(*names).repartition("into").sortWithinPartitions("into", "nth", "code")
        dealt.mapInArrow(run, BLOCKS).write.option("parquet.block.size", GROUP_BYTES).option("parquet.page.size", 1 << 14).parquet(f"{path}/blocks")
        facts, seen = self._facts(path), [d["path"] for d in self.manifest["dead"]]

        def merged(m: dict) -> dict:
            if [d["path"] for d in m["dead"]] != seen or not set(numbers) <= {s["number"] for s in m["segments"]}:
                raise RuntimeError("the index was changed meanwhile; merge again")
            left = [s for s in m["segments"] if s["number"] not in numbers]
            # what concerns only segments that are gone is gone with them
            dead = [d for d in m["dead"] if any(str(s["number"]) in d["of"] for s in left)]
            return m | {"segments": [*left, facts | {"number": m["next"]}], "next": m["next"] + 1, "dead": dead}

        self.snapshots.change(merged)
        self.open()
        return len(old)

    # reads

    def _blocks(self, condition: str | Column | None) -> DataFrame:
        """Block rows with segment and, at the row of a range's documents, the places of the dead."""
        if not self.manifest["segments"]:
            return self.spark.createDataFrame([], f"{BLOCKS}, segment long, dead array<int>")

        def read(more: str | None) -> DataFrame:
            every = None
            for s in self.manifest["segments"]:
                rows = self.spark.read.schema(BLOCKS).parquet(f"{s['path']}/blocks")
                for c in (condition, more):
                    rows = rows if c is None else rows.filter(c)
                rows = rows.withColumn("segment", F.lit(s["number"]).cast("long"))
                every = rows if every is None else every.unionByName(rows)
            return every

        none = F.lit(None).cast("array<int>")
        if not self.manifest["dead"] or (isinstance(condition, str) and condition == f"code <> {_DOCS}"):
            return read(None).withColumn("dead", none)
        # only the rows of documents are joined: blocks are many, and none has dead of its own
        places = self.spark.read.parquet(*(f"{d['path']}/places" for d in self.manifest["dead"]))
        dead = places.groupBy("segment", "range").agg(F.collect_list("place").alias("dead"))
        docs = read(f"code = {_DOCS}").join(dead, ["segment", "range"], "left")
        return docs.unionByName(read(f"code <> {_DOCS}").withColumn("dead", none))

    def facts(self) -> tuple[int, int, int]:
        """Documents, N, tokens."""
        m = self.manifest
        gone = [d["of"].get(str(s["number"]), (0, 0)) for d in m["dead"] for s in m["segments"]]
        docs, tokens = (sum(s[x] for s in m["segments"]) - sum(g[i] for g in gone) for i, x in enumerate(("docs", "tokens")))
        if self.dense:
            return docs, docs, tokens
        last = max((s["last"] for s in m["segments"]), default=-1)
        if m["dead"]:  # the greatest id may be dead
            rows = self._blocks(f"code = {_DOCS}").select("dead", F.posexplode("ids").alias("place", "id"))
            last = rows.filter(~F.array_contains(F.coalesce("dead", F.array().cast("array<int>")), F.col("place"))).agg(F.max("id")).first()[0]
            last = -1 if last is None else last
        return docs, last + 1, tokens

    def term_rows(self, names: list[str] | None = None) -> DataFrame:
        """(code, df, cf) of terms, of those named only; counts of the dead are taken off."""
        m, any_ = self.manifest, None
        codes = None if names is None else np.array(sorted(scoring.packed(t) for t in names if len(t) <= 3), np.int64)
        numbers = [s["number"] for s in m["segments"]]
        for s in [*m["segments"], *m["dead"]]:
            rows = self.spark.read.schema("code long, df long, cf long" + (", segment long" if "of" in s else "")).parquet(f"{s['path']}/terms")
            rows = rows.filter(F.col("segment").isin(numbers)).drop("segment") if "of" in s else rows
            rows = rows if codes is None else rows.filter(near(F.col("code"), codes))
            any_ = rows if any_ is None else any_.unionByName(rows)
        if any_ is None:
            return self.spark.createDataFrame([], "code long, df long, cf long")
        return any_.groupBy("code").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")).filter("df > 0")

    def known(self, names: list[str]) -> tuple[dict[str, tuple[int, int]], int, float]:
        """As Index.known: ({term: (df, cf)} of those of the terms that are in the index, N, average length)."""
        docs, n, tokens = self.facts()
        of = {scoring.packed(t): t for t in names if len(t) <= 3}
        found = {of[r["code"]]: (r["df"], r["cf"]) for r in self.term_rows(names).collect() if r["code"] in of} if of else {}  # at most HELD, and what lies between them
        return retrieval.without_stops(found, n), n, tokens / max(docs, 1)

    def asked(self, q: DataFrame, weight: str = "qtf", share: float | None = None) -> Asked | None:
        """The queries (qid, term, weight), None without any known term."""
        rows = q.select("qid", "term", F.col(weight).cast("double").alias("w")).limit(scoring.HELD + 1).collect()
        if len(rows) > scoring.HELD:
            raise ValueError(f"at most {scoring.HELD} rows of queries and terms at once")
        known, n, average = self.known(sorted({r["term"] for r in rows}))
        weights, size = {}, {}
        for r in rows:
            size[r["qid"]] = size.get(r["qid"], 0) + 1
            if r["term"] in known:
                weights.setdefault(r["qid"], {})[scoring.packed(r["term"])] = r["w"]
        if not weights:
            return None
        idf = {scoring.packed(t): math.log1p((n - df + 0.5) / (df + 0.5)) for t, (df, _) in known.items()}
        return Asked(weights, idf, None if share is None else {k: max(1, math.ceil(x * share)) for k, x in size.items()}, average)

    def _ranges(self, asked: Asked) -> DataFrame:
        """The blocks of the asked terms, dealt and sorted by range."""
        codes = np.append([_DOCS], asked.codes)
        wanted = self.spark.createDataFrame(pd.DataFrame({"code": codes}))  # at most HELD
        rows = self._blocks(near(F.col("code"), codes)).join(F.broadcast(wanted), "code", "left_semi")
        cols = ["segment", "range", "code", "max_tf", "min_dl", "places", "tfs", "ids", "dead"]
        return rows.select(*cols).repartition("segment", "range").sortWithinPartitions("segment", "range", "code")

    def best(self, q: DataFrame, k: int = retrieval.TOP, weight: str = "qtf", share: float | None = None) -> DataFrame:
        """qid, rank, doc_id, score, as Index.best has them."""
        asked = self.asked(q, weight, share)
        if asked is None:
            return self.spark.createDataFrame([], "qid long, rank int, doc_id long, score double")
        ship(self.spark)
        shared = self.spark.sparkContext.broadcast(asked)  # at most HELD rows

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            a = shared.value
            found = [Best(a, i, min(i + TOGETHER, len(a.qids)), k) for i in range(0, len(a.qids), TOGETHER)]
            for part in _groups(batches):
                for own in found:
                    own.add(part)
            for own in found:
                i, j = np.nonzero(np.isfinite(own.score))
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(a.qids[own.first + j]), pa.array(own.name[i, j]), pa.array(own.score[i, j])], ["qid", "doc_id", "score"])

        return retrieval.top(self._ranges(asked).mapInArrow(run, "qid long, doc_id long, score double"), k)

    def matched(self, q: DataFrame) -> DataFrame:
        """(qid, docs): in how many documents any known term of the query stands; queries without any are absent."""
        asked = self.asked(q)
        if asked is None:
            return self.spark.createDataFrame([], "qid long, docs long")
        ship(self.spark)
        shared = self.spark.sparkContext.broadcast(asked)  # at most HELD rows

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            a = shared.value
            sums = np.zeros(len(a.qids), np.int64)
            for part in _groups(batches):
                held = np.zeros((len(a.qids), len(part.ids)), bool)
                at = np.searchsorted(a.codes, part.code)
                for row in np.flatnonzero((at < len(a.codes)) & (a.codes[np.minimum(at, len(a.codes) - 1)] == part.code)).tolist():
                    held[np.ix_(a.query[a.edges[at[row]] : a.edges[at[row] + 1]], part.block(row)[0])] = True
                sums += (held & part.alive).sum(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(a.qids), pa.array(sums)], ["qid", "docs"])

        return self._ranges(asked).mapInArrow(run, "qid long, docs long").groupBy("qid").agg(F.sum("docs").alias("docs"))

    def terms(self) -> DataFrame:
        """term, df, cf of all terms that are no stop n-grams."""
        n = self.facts()[1]

        def spelled(code: pd.Series) -> pd.Series:
            return code.map(lambda c: "".join(chr((c >> s & 0x1FFFFF) - 1) for s in (42, 21, 0) if c >> s & 0x1FFFFF))

        rows = self.term_rows().select(F.pandas_udf(spelled, "string")("code").alias("term"), "df", "cf")
        return retrieval.kept_terms(rows, self.spark.createDataFrame([(n,)], "n long"))


#: Indexes of this application, by table and what its files were then.
_built: dict[tuple, str] = {}


def stored(spark: SparkSession, sf_dir: str) -> StoredIndex:
    """The index of documents: built and stored by the first query that asks for it, opened by the others as long as the table's files are the same."""
    path = f"{sf_dir}/documents.parquet"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    status = [fs.getFileStatus(target)]
    files = fs.listStatus(target) if status[0].isDirectory() else status
    key = (spark.sparkContext.applicationId, path, tuple((s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in files))
    if key not in _built:
        index = StoredIndex(spark, new_path(spark, "index"))
        index.append(table(spark, sf_dir, "documents"))
        _built[key] = index.snapshots.path
    return StoredIndex(spark, _built[key])


def search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 over documents that hold at least half of a query's terms; each term counts once."""
    q = retrieval.query_terms(retrieval.queries_of(spark, sf_dir)).withColumn("one", F.lit(1))
    return stored(spark, sf_dir).best(q, weight="one", share=0.5)


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir).best(retrieval.query_terms(retrieval.queries_of(spark, sf_dir)))


def query_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """avg_idf, max_idf, scope, scq and hardness of each query over its different terms in the index."""
    index, q = stored(spark, sf_dir), retrieval.query_terms(retrieval.queries_of(spark, sf_dir))
    names = [r["term"] for r in q.select("term").distinct().limit(scoring.HELD + 1).collect()]
    known, n, _ = index.known(names[: scoring.HELD])
    terms = spark.createDataFrame([(t, *x) for t, x in known.items()], "term string, df long, cf long")
    return retrieval.performance(q, terms, index.matched(q), n)


def saved_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the query terms df, cf and the joint length of their documents, read from a stored index alone."""
    index, q = stored(spark, sf_dir), retrieval.query_terms(retrieval.queries_of(spark, sf_dir))
    wanted = q.select("term").distinct().limit(scoring.HELD).withColumn("code", F.pandas_udf(lambda s: s.map(scoring.packed), "long")("term"))
    codes = np.array(sorted(r["code"] for r in wanted.select("code").collect()), np.int64)
    rows = index._blocks(near(F.col("code"), codes)).join(F.broadcast(wanted), "code").select("segment", "range", "term", "df", "cf", "places")
    lengths = index._blocks(f"code = {_DOCS}").select("segment", "range", F.col("tfs").alias("dls"))
    long_ = F.aggregate("places", F.lit(0).cast("long"), lambda a, p: a + F.get("dls", p))
    return rows.join(lengths, ["segment", "range"]).groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"), F.sum(long_).alias("length"))


def index_stream(docs: DataFrame, path: str, checkpoint: str, name: str = "stream"):
    """Append each micro-batch of a stream of documents as a segment and merge; a batch that comes again changes nothing."""
    spark = docs.sparkSession

    def add(batch: DataFrame, number: int) -> None:
        index = StoredIndex(spark, path)
        index.append(batch, f"{name}-{number}")
        index.merge()

    return docs.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 over an index that grew in three appends, one of them twice, with deletions of toxic documents between, and was merged."""
    index, docs = StoredIndex(spark, new_path(spark, "index")), table(spark, sf_dir, "documents")
    toxic = table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id")
    part = F.pmod(F.xxhash64("doc_id"), F.lit(3))
    for k in range(3):
        own = docs.filter(part == k)
        index.append(own if k < 2 else own.join(toxic, "doc_id", "left_anti"), f"part-{k}")
        if k:
            index.delete(toxic)
    index.append(docs.filter(part == 0), "part-0")
    index.merge(every=True)
    return index.best(retrieval.query_terms(retrieval.queries_of(spark, sf_dir)))


QUERIES = {"a01_a02_saved_index": saved_terms, "q05_bm25_topk": bm25_topk, "q06_search_min_match": search, "q20_query_performance": query_performance, "z07_incremental_index": incremental}
ORACLES = {"z07_incremental_index": retrieval.SQL_BM25.replace("FROM documents WHERE", "FROM documents ANTI JOIN (SELECT doc_id FROM labels WHERE toxic = 1) USING (doc_id) WHERE")}
