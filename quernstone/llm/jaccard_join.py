"""Exact Jaccard join of five-word shingle sets by partition of the universe and the pigeonhole principle.

Sets of sizes a and b with Jaccard index 0.8 or more differ in at most (a + b) / 9 shingles. A size band
k reaches from L to U < 1.25 L + 1, so that of two such sets the smaller lies in the larger one's band
or the band below; both are looked at in the larger one's universe k, whose bound is H = 2 U // 9. There
the shingles are dealt by hash into M segments. Segments that are empty in both sets say nothing, so M is
H + 1 + Z + S: as long as one of the sets has at most Z empty segments, at least S + 1 segments that are
not empty are the same in both, and the sets meet in their signatures. So each set may leave out its S
most frequent signatures, by one order for all (prefix filtering): those made of a passage that many
documents share fall away, and a set that shares at most S signatures has no partner. S is a part of
H, for which a set pays with a signature each; Z lies four deviations above the mean of the
smallest sets. Sets with still more empty segments ("thin" ones) also emit the one-deletion
neighbourhood of each segment: two thin sets meet in a segment that differs by one shingle at most,
as 2 (M - z) > H. Thin sets with too few segments in use
for that share one signature.

A set is known by its hash, so equal sets are one node from the start. Nodes that share a signature
are a run. Short runs are tested pair by pair. Long runs, as of thousands of near copies, are first tested
against one leader each, then each node against its nearest; then only pairs of
nodes in different components are left, and of these only those whose sketches of parities allow it. Every test compares the whole sets.

Defined results: null text and text without words have no shingles and are linked with nothing; their
component is their own doc_id. Rows of equal sets are linked whatever their ids. Shingles are compared by
64-bit hash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.shipping import ship
from .common import Tables, map_text, maybe_in, slices, staged, table, trimmed
from .components import connected_components
from .words import BASE as _C1
from .words import STIR as _C2
from .words import TURN as _C3
from .words import hashed_words, mix

WORDS, NUMERATOR, DENOMINATOR = 5, 80, 100
#: Runs up to this length are tested pair by pair at once.
SHORT = 6
#: Nodes of a run that are compared in one piece of work: longer runs are cut into slices of about so many, each pair of slices a piece.
SLICE = 2048
#: A node's first runs, by which a pair's run is chosen; nearest nodes that are tested before all.
FIRSTS, NEAREST = 8, 1
#: Nodes up to which a table of two numbers for each is broadcast, and bytes of sketches up to which theirs is; beyond, they are shuffled.
HELD, HELD_BYTES = 100_000, 16 << 20
#: Rows of three numbers (pairs, runs) up to which they are broadcast to the larger table that they are joined with.
FEW = 1 << 19
#: Parts of the signatures for each shuffle partition: one part is held in arrays.
FINER = 1
_NO_FLAGS = ~np.uint64(3)
_TURN = np.random.default_rng(11).integers(0, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def word_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit hash of every word of UTF-8 text, A-Z as a-z."""
    return hashed_words(raw.lower())[0]


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted hashes of a text's distinct shingles; a shorter text is one shingle."""
    w = word_hashes(text.encode("utf-8", "surrogatepass")) if text else np.empty(0, np.uint64)
    if not len(w):
        return w
    n = len(w) - words + 1
    if n < 1:
        return mix(np.array([np.sum(w * _TURN[: len(w)]) + np.uint64(len(w))]))
    h = w[:n] * _TURN[0]
    for j in range(1, words):
        h += w[j : j + n] * _TURN[j]
    return np.unique(mix(h))


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets are similar enough."""
    if not len(a) or not len(b) or min(len(a), len(b)) * DENOMINATOR < NUMERATOR * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort()
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return DENOMINATOR * common >= NUMERATOR * (len(a) + len(b) - common)


@cache
def band(k: int) -> tuple[int, int]:
    """Sizes of band k, from 0: first and last."""
    first = 1 if not k else band(k - 1)[1] + 1
    return first, first * DENOMINATOR // NUMERATOR


def band_of(n: int) -> int:
    k = 0
    while band(k)[1] < n:
        k += 1
    return k


#: S as a part of H: more signatures for every set, fewer candidates.
SPARE = 0.15


@cache
def universe(k: int) -> tuple[int, int, int, int]:
    """H, M, Z and S of universe k. Z is the least that sets of the smallest size pass only four deviations above the mean."""
    first, last = band(k)
    differ = 2 * last * (DENOMINATOR - NUMERATOR) // (DENOMINATOR + NUMERATOR)
    n, over, spare = first * NUMERATOR / DENOMINATOR, math.ceil(SPARE * differ), 0
    while True:
        m = differ + 1 + spare + over
        each = n / m
        mean = m * math.exp(-each)
        if m == 1 or spare >= mean + 4 * math.sqrt(max(0.0, mean * (1 - (1 + each) * math.exp(-each)))):
            return differ, m, spare, over
        spare += 1


def signatures(s: np.ndarray) -> np.ndarray:
    """64-bit signatures of a set in its own universe and the next; bit 0 is the universe's parity, bit 1 says one-deletion."""
    out = []
    k = band_of(len(s))
    stirred = mix(s + _C1)
    for u in (k, k + 1):
        if len(s) * DENOMINATOR < NUMERATOR * band(u)[0]:
            continue
        differ, m, spare, _ = universe(u)
        seg = (((s >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)).astype(np.int64)
        content = np.zeros(m, np.uint64)
        np.add.at(content, seg, stirred)
        used = np.flatnonzero(np.bincount(seg, minlength=m))
        base = mix(np.array([u], np.uint64) * _C2 + np.arange(m, dtype=np.uint64) * _C3 + _C1)
        flags = np.uint64(u & 1)
        out.append((mix(content[used] ^ base[used]) & _NO_FLAGS) | flags)
        if m - len(used) > spare:
            flags |= np.uint64(2)
            out.append((mix(content ^ base) & _NO_FLAGS) | flags)  # empty ones too: a deletion may leave nothing
            out.append((mix((content[seg] - stirred) ^ base[seg]) & _NO_FLAGS) | flags)
            if 2 * len(used) <= differ:
                out.append((mix(np.array([u], np.uint64) * _C1 + np.uint64(7)) & _NO_FLAGS) | flags)
    return np.unique(np.concatenate(out))


def parities(s: np.ndarray) -> np.ndarray:
    """Of each of 2^k >= n (at least 64) classes, whether the set has an odd number of it: two sets' sketches differ in no more bits than the sets in shingles."""
    bits = max(64, 1 << int(len(s) - 1).bit_length())
    odd = np.bincount((s >> np.uint64(7)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")


def folded(sketch: np.ndarray, words: int) -> np.ndarray:
    while len(sketch) > words:
        sketch = sketch[: len(sketch) // 2] ^ sketch[len(sketch) // 2 :]
    return sketch


def set_hash(s: np.ndarray) -> int:
    return int(mix(np.array([np.sum(mix(s + _C2)) + np.uint64(len(s))])).view(np.int64)[0])


def _packed(part: np.ndarray, parts: int, fields: list[np.ndarray]) -> list[tuple[int, bytes]]:
    """(part, blob) of rows given as arrays of one length; `_unpacked` reads the blobs."""
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(parts + 1))
    fields = [f[order] for f in fields]
    return [(int(r), b"".join(f[cuts[r] : cuts[r + 1]].tobytes() for f in fields)) for r in np.flatnonzero(np.diff(cuts))]


def _unpacked(blobs: list[pa.Buffer], kinds: list[str]) -> list[np.ndarray]:
    width, out = sum(np.dtype(k).itemsize for k in kinds), [[] for _ in kinds]
    for raw in blobs:
        n, at = raw.size // width, 0
        for k, into in zip(kinds, out):
            into.append(np.frombuffer(raw, k, n, at))
            at += n * np.dtype(k).itemsize
    return [np.concatenate(x) if x else np.empty(0, k) for x, k in zip(out, kinds)]


_ROWS = "doc_id long, n long, node long, r int, blob binary"
_NAMES = ["doc_id", "n", "node", "r", "blob"]


def _blob_rows(packed: list[tuple[int, bytes]]) -> pa.RecordBatch:
    k = len(packed)
    return pa.RecordBatch.from_arrays([*(pa.nulls(k, pa.int64()) for _ in range(3)), pa.array([r for r, _ in packed], pa.int32()), pa.array([b for _, b in packed], pa.binary())], _NAMES)


def _spread(key: np.ndarray, parts: int) -> np.ndarray:
    return (((key >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


def _first_pass(docs: DataFrame, parts: int) -> DataFrame:
    """Rows doc_id, n, node of all documents, and for each part r a blob: nodes with their bands and numbers of signatures, then 32 bits of each signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                sizes, nodes, known, sigs = [], [], {}, []
                for text in part.column("text").to_pylist():
                    s = shingle_set(text)
                    sizes.append(len(s))
                    nodes.append(set_hash(s) if len(s) else None)
                    if len(s) and nodes[-1] not in known:
                        known[nodes[-1]] = band_of(len(s))
                        sigs.append(signatures(s))
                n = part.num_rows
                home = np.array([0 if x is None else x for x in nodes], np.int64).view(np.uint64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(_spread(mix(home + np.arange(n, dtype=np.uint64)), parts), pa.int32()), pa.nulls(n, pa.binary())], _NAMES)
                if not sigs:
                    continue
                own = np.repeat(np.arange(len(sigs)), [len(x) for x in sigs])
                every = np.concatenate(sigs)
                to = _spread(every, parts)
                order = np.argsort(to, kind="stable")
                every, own, to = every[order], own[order], to[order]
                cuts = np.searchsorted(to, np.arange(parts + 1))
                ids, bands = np.fromiter(known, np.int64, len(known)), np.fromiter(known.values(), np.uint8, len(known))
                blobs = []
                for r in np.flatnonzero(np.diff(cuts)):
                    a, b = cuts[r], cuts[r + 1]
                    mine, counts = np.unique(own[a:b], return_counts=True)
                    blobs.append((int(r), np.int64(len(mine)).tobytes() + ids[mine].tobytes() + counts.astype("<u4").tobytes() + bands[mine].tobytes() + every[a:b].astype("<u4").tobytes()))
                yield _blob_rows(blobs)

    return docs.mapInArrow(trimmed(run), _ROWS)


def _shared(rows: DataFrame, parts: int) -> DataFrame:
    """Documents' rows as they came, and by part of the node: (node, band, run, size) of every signature that several nodes share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sigs, owners, bands, r = [], [], [], 0
        for batch in batches:
            blob = batch.column("blob")
            plain = batch.filter(blob.is_null())
            if plain.num_rows:
                yield plain
            for raw in (x.as_buffer() for x in blob.filter(blob.is_valid())):
                r = batch.column("r")[0].as_py()
                n = int(np.frombuffer(raw, "<i8", 1)[0])
                ids, counts, band_ = np.frombuffer(raw, "<i8", n, 8), np.frombuffer(raw, "<u4", n, 8 + 8 * n), np.frombuffer(raw, np.uint8, n, 8 + 12 * n)
                sigs.append(np.frombuffer(raw, "<u4", offset=8 + 13 * n))
                owners.append(np.repeat(ids, counts))
                bands.append(np.repeat(band_, counts))
        if not sigs:
            return
        for quarter in range(4):  # of the signatures, to hold less at once
            picked = [x >> np.uint32(30) == quarter for x in sigs]
            sig, node, band_ = (np.concatenate([x[k] for x, k in zip(y, picked)]) for y in (sigs, owners, bands))
            order = np.argsort(sig, kind="stable")
            sig, node, band_ = sig[order], node[order], band_[order]
            same = sig[1:] == sig[:-1]
            shared = np.concatenate([same, [False]]) | np.concatenate([[False], same])
            order = np.flatnonzero(shared[: len(sig)])
            order = order[np.lexsort((node[order], sig[order]))]
            sig, node, band_ = sig[order], node[order], band_[order]
            keep = np.ones(len(sig), bool)
            keep[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])  # a node from two slices
            sig, node, band_ = sig[keep], node[keep], band_[keep]
            if not len(sig):
                continue
            first = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
            length = np.diff(np.concatenate([first, [len(sig)]]))
            size = np.repeat(length, length)
            several = size > 1
            sig, node, band_, size = sig[several], node[several], band_[several], size[several]
            run_id = (np.uint64(r) << np.uint64(32)) | sig.astype(np.uint64)
            yield _blob_rows(_packed(_spread(mix(node.view(np.uint64)), parts), parts, [node.astype("<i8"), run_id.astype("<u8"), size.astype("<u4"), band_]))

    return rows.repartitionById(parts, F.col("r")).mapInArrow(trimmed(run), _ROWS)


def _prefixes(rows: DataFrame, parts: int) -> DataFrame:
    """(run, node) of the shared signatures that are left when each node has dropped its S most frequent ones in a universe."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs = [x.as_buffer() for batch in batches for x in batch.column("blob")]
        node, run_id, size, band_ = _unpacked(blobs, ["<i8", "<u8", "<u4", "u1"])
        if not len(node):
            return
        flags = (run_id & np.uint64(3)).astype(np.int64)
        order = np.lexsort((run_id, size, flags, node))
        node, run_id, band_, flags = node[order], run_id[order], band_[order].astype(np.int64), flags[order]
        first = np.flatnonzero(np.concatenate([[True], (node[1:] != node[:-1]) | (flags[1:] != flags[:-1])]))
        count = np.diff(np.concatenate([first, [len(node)]]))
        over = np.array([universe(k)[3] for k in range(int(band_.max()) + 2)])
        u = band_ + ((band_ & 1) != (flags & 1))
        left = np.repeat(first + count, count) - np.arange(len(node)) - 1  # more frequent ones of the same node and universe
        keep = (left >= over[u]) | (flags >= 2)
        node, run_id = node[keep], run_id[keep]
        for at in range(0, len(node), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(run_id[at : at + 100_000].view(np.int64)), pa.array(node[at : at + 100_000])], ["run", "node"])

    return rows.select("r", "blob").repartitionById(parts, F.col("r")).select("blob").mapInArrow(trimmed(run), "run long, node long")


def _distinct_runs(rows: DataFrame) -> DataFrame:
    """(run, node, size): of runs with the same nodes one, of those with one node none.

    Runs count as the same if size, least and greatest node, and two independent hashes of the members (64 and 44 bits) agree.
    """
    members = [F.bit_xor(F.xxhash64("node")).alias("x"), F.sum(F.shiftright(F.xxhash64("node", F.lit(10)), 20)).alias("s"), F.min("node").alias("lo"), F.max("node").alias("hi")]
    sums = rows.groupBy("run").agg(F.count(F.lit(1)).alias("size"), *members).filter("size > 1")
    one = staged(sums.groupBy("x", "s", "lo", "hi", "size").agg(F.min("run").alias("run")).select("run", "size"), "distinct")  # written, so that the join's hot runs can be split
    return rows.join(F.broadcast(one) if one.count() <= FEW else one, "run")


def _sets(docs: DataFrame, wanted: DataFrame, many: DataFrame | None) -> DataFrame:
    """node, n, tokens, sketch for the nodes wanted (node, doc_id); many: ids, null among them, that don't name one row.

    Rows of such ids are known by the hash of their set, as a join by id would pair each with all nodes of the id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                for node, text in zip(part.column("node").to_pylist(), part.column("text").to_pylist()):
                    s = shingle_set(text)
                    if node is None and len(s) or node is not None and set_hash(s) == node:
                        rows.append({"node": set_hash(s), "n": len(s), "tokens": s.tobytes(), "sketch": parities(s).tobytes()})
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    schema = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("tokens", pa.binary()), ("sketch", pa.binary())])
    kind = "node long, n long, tokens binary, sketch binary"
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    one = wanted if many is None else staged(wanted.join(many, "doc_id", "left_anti").filter("doc_id IS NOT NULL"), "wanted")
    found = maybe_in(docs, "doc_id", one, "doc_id").join(F.broadcast(one) if one.count() <= HELD else one, "doc_id").select("node", "text").mapInArrow(trimmed(run), kind)
    if many is None:
        return found
    rows = docs.join(many.withColumnRenamed("doc_id", "id"), F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
    more = rows.select(F.lit(None).cast("long").alias("node"), "text").mapInArrow(trimmed(run), kind)
    rest = wanted.join(one.select("node"), "node", "left_anti").select("node")
    more = more.join(F.broadcast(rest) if rest.count() <= HELD else rest, "node", "left_semi")
    return found.unionByName(more.dropDuplicates(["node"]))


def _allowed(n_a: pd.Series, s_a: pd.Series, n_b: pd.Series, s_b: pd.Series) -> pd.Series:
    """Whether two sketches differ little enough."""
    out = []
    for a, x, b, y in zip(n_a, s_a, n_b, s_b):
        words = min(len(x), len(y)) // 8
        apart = int(np.bitwise_count(folded(np.frombuffer(x, "<u8"), words) ^ folded(np.frombuffer(y, "<u8"), words)).sum())
        out.append(apart * (DENOMINATOR + NUMERATOR) <= (a + b) * (DENOMINATOR - NUMERATOR))
    return pd.Series(out, dtype=bool)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that are linked. The set of b travels once for a pair, a's once for each part of its pairs."""
    spark = pairs.sparkSession
    few = pairs.count() <= FEW
    heads = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("c")).select("a", F.ceil(F.col("c") / 256).alias("parts"))
    keyed = pairs.join(heads, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"))
    parts_ = heads.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    keyed, parts_ = (F.broadcast(x) if few else x for x in (keyed, parts_))  # no more rows than pairs; the sets stay where they lie
    right = sets.select(F.col("node").alias("b"), "tokens").join(keyed, "b").select("a", "part", "b", "tokens")
    left = sets.select(F.col("node").alias("a"), "tokens").join(parts_, "a").select("a", "part", F.lit(None).cast("long").alias("b"), "tokens")
    both = left.unionByName(right)
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, own = None, None
        for batch in batches:
            for part in slices(batch, "tokens"):
                found = []
                for a, p, b, tokens in zip(*(part.column(c).to_pylist() for c in ("a", "part", "b", "tokens"))):
                    if b is None:
                        head, own = (a, p), np.frombuffer(tokens, np.uint64)
                    elif head == (a, p) and linked(own, np.frombuffer(tokens, np.uint64)):
                        found.append((a, b))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found]), pa.array([x[1] for x in found])], ["a", "b"])

    return both.repartition(n, "a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first()).mapInArrow(trimmed(run), "a long, b long")


def _slots(runs: DataFrame) -> DataFrame:
    """(run, component, base, own, pool, total): how the nodes of a run are dealt to slices 0 to total - 1.

    A component of over `SLICE` nodes has slices of its own, `own` of them from `base`; the others share the first `pool` slices, a component in one of them.
    """
    parts = staged(runs.groupBy("run", "component").agg(F.count(F.lit(1)).alias("c")), "parts")
    large = parts.filter(F.col("c") > SLICE).withColumn("own", F.ceil(F.col("c") / SLICE))
    before = F.sum("own").over(Window.partitionBy("run").orderBy("component").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("own")
    totals = parts.groupBy("run").agg(F.ceil(F.sum(F.when(F.col("c") <= SLICE, F.col("c")).otherwise(0)) / SLICE).alias("pool"), F.sum(F.when(F.col("c") > SLICE, F.ceil(F.col("c") / SLICE)).otherwise(0)).alias("more"))
    totals = staged(totals.select("run", "pool", (F.col("pool") + F.col("more")).alias("total")), "totals")
    found = parts.drop("c").join(totals, "run").join(large.select("run", "component", before.alias("base"), "own"), ["run", "component"], "left")
    return found.withColumn("base", F.col("base") + F.col("pool"))


def _pairs_apart(runs: DataFrame, sets: DataFrame, nearest: int) -> DataFrame:
    """Of runs (run, node, component, size: at least its nodes): (run, a, b) pairs of different components whose sizes and sketches allow a link.

    nearest > 0: only each node's nearest by sketch; 0: all, each in the first run that both nodes name
    among their `FIRSTS` first ones, so that a pair isn't given by every run it is in. A long run is dealt by pairs of its slices, so
    that no task has to take it whole; two slices of one component are no pair, so that a large component costs its nodes times the slices of others.
    """
    known = sets.select("node", "n", "sketch")
    if nearest:  # first runs don't choose a pair's run
        known = known.withColumn("firsts", F.lit(None).cast("array<long>"))
    else:
        firsts = runs.groupBy("node").agg(F.slice(F.array_sort(F.collect_set("run")), 1, FIRSTS).alias("firsts"))
        known = staged(known.join(firsts, "node"), "known")
    held = known.agg(F.sum(F.octet_length("sketch") + 100)).first()[0] or 0
    big = runs.filter(F.col("size") > SLICE)
    slots = staged(_slots(big), "slots")
    pooled = F.col("own").isNull()
    side = F.when(pooled, F.pmod(F.xxhash64("component", F.lit(12)), F.col("pool"))).otherwise(F.col("base") + F.pmod(F.xxhash64("node", F.lit(12)), F.col("own")))
    every = F.sequence(F.lit(0).cast("long"), F.col("total") - 1)
    others = F.when(pooled, every).otherwise(F.filter(every, lambda k: (k < F.col("base")) | (k >= F.col("base") + F.col("own"))))
    dealt = big.join(slots, ["run", "component"]).withColumn("side", side).withColumn("_k", F.explode(others))
    dealt = dealt.select("run", "node", "component", "side", F.least("side", "_k").alias("lo"), F.greatest("side", "_k").alias("hi"))
    zero = F.lit(0).cast("long")
    rows = runs.filter(F.col("size") <= SLICE).select("run", "node", "component", zero.alias("side"), zero.alias("lo"), zero.alias("hi")).unionByName(dealt)
    rows = rows.join(F.broadcast(known) if held <= HELD_BYTES else known, "node").select("run", "node", "component", "n", "sketch", "firsts", "side", "lo", "hi")
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def pairs(piece: tuple[int, int, int], rows: list[tuple]) -> Iterator[np.ndarray]:
        run_id, lo, hi = piece
        node, comp, size, side = (np.array([r[i] for r in rows], np.int64) for i in (0, 1, 2, 5))
        raw = [np.frombuffer(r[3], "<u8") for r in rows]
        words = min(map(len, raw))
        sketch = np.stack([folded(x, words) for x in raw])
        low, high = np.flatnonzero(side == lo), np.flatnonzero(side == hi)
        for ours, theirs in [(low, high), (high, low)] if nearest and lo != hi else [(low, high)]:
            step = max(1, (1 << 19) // (max(1, len(theirs)) * words))
            for at in range(0, len(ours) if len(theirs) else 0, step):
                part = ours[at : at + step]
                apart = np.bitwise_count(sketch[part, None, :] ^ sketch[None, theirs, :]).sum(axis=2, dtype=np.int64)
                both = size[part, None] + size[None, theirs]
                ok = (comp[part, None] != comp[None, theirs]) & (apart * (DENOMINATOR + NUMERATOR) <= both * (DENOMINATOR - NUMERATOR))
                ok &= np.minimum(size[part, None], size[None, theirs]) * DENOMINATOR >= np.maximum(size[part, None], size[None, theirs]) * NUMERATOR
                if nearest:
                    apart[~ok] = 1 << 40
                    k = min(nearest, len(theirs))
                    j = np.argpartition(apart, k - 1, axis=1)[:, :k].reshape(-1)
                    i = np.repeat(np.arange(len(part)), k)
                    keep = ok[i, j]
                    i, j = i[keep], j[keep]
                    if len(i):
                        yield np.stack([node[part[i]], node[theirs[j]], apart[i, j]])
                    continue
                if lo == hi:
                    ok &= theirs[None, :] > part[:, None]
                i, j = (x[y] for x, y in zip((part, theirs), np.nonzero(ok)))
                first = [not any(r < run_id for r in set(rows[a][4]) & set(rows[b][4])) for a, b in zip(i.tolist(), j.tolist())]
                i, j = i[first], j[first]
                if len(i):
                    yield np.stack([node[i], node[j], np.zeros(len(i), np.int64)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def out() -> Iterator[pa.RecordBatch]:
            for got in pairs(now, held) if len(held) > 1 else ():
                for at in range(0, got.shape[1], 50_000):
                    i, j, far = (x[at : at + 50_000] for x in got)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), now[0])), pa.array(i), pa.array(j), pa.array(far)], ["run", "i", "j", "far"])

        for batch in batches:
            for run_id, lo, hi, *row in zip(*(batch.column(c).to_pylist() for c in ("run", "lo", "hi", "node", "component", "n", "sketch", "firsts", "side"))):
                if (run_id, lo, hi) != now:
                    yield from out()
                    now, held = (run_id, lo, hi), []
                held.append(tuple(row))
        yield from out()

    found = rows.repartition(n, "run", "lo", "hi").sortWithinPartitions("run", "lo", "hi").mapInArrow(trimmed(run), "run long, i long, j long, far long")
    if nearest:  # of a node's nearest in its pieces the nearest
        found = found.groupBy("run", "i").agg(F.min(F.struct("far", "j")).alias("x")).select("run", "i", F.col("x.j").alias("j"))
    return found.select("run", F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"))


def _open_runs(runs: DataFrame, components: DataFrame, tables: Tables) -> DataFrame:
    """The runs (run, node, component, size) that still lie in more than one component."""
    rows = runs.join(components, "node", "left").select("run", "node", F.coalesce("component", "node").alias("component"), "size")
    rows = tables.write(rows, "placed")
    open_ = staged(rows.groupBy("run").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("run"), "open")
    left = staged(rows.join(open_, "run", "left_semi"), "left")
    tables.drop("placed")
    return left


def unnamed(nodes: DataFrame) -> DataFrame | None:
    """The doc_ids that don't name one row: repeated ones and null; None if there are none."""
    many = staged(nodes.groupBy("doc_id").count().filter("count > 1 OR doc_id IS NULL").select("doc_id"), "many")
    return None if many.isEmpty() else many


def with_node(docs: DataFrame, name: str) -> DataFrame:
    """docs with the node of each row, null without shingles."""

    def add(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(t) for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array([set_hash(s) if len(s) else None for s in sets], pa.int64())], [*batch.schema.names, name])

    return map_text(docs, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + f", `{name}` long", add)


def linked_nodes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, node) of every document, and (node, component) of the nodes that are linked with others."""
    spark = docs.sparkSession
    ship(spark)
    parts = FINER * max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    tables = Tables(spark)
    first = tables.write(_shared(_first_pass(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), parts), parts), "shared")
    nodes = staged(first.filter("blob IS NULL").select("doc_id", "n", "node"), "nodes")
    prefixes = tables.write(_prefixes(first.filter("blob IS NOT NULL"), parts), "prefixes")
    tables.drop("shared")
    runs = tables.write(_distinct_runs(prefixes), "runs")
    tables.drop("prefixes")
    wanted = nodes.join(runs.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    sets = staged(_sets(docs, staged(wanted, "wanted"), unnamed(nodes)), "sets")
    short = runs.filter(F.col("size") <= SHORT)
    pairs = short.select("run", F.col("node").alias("a")).join(short.select("run", F.col("node").alias("b")), "run").filter("a < b").select("a", "b")
    long = staged(runs.filter(F.col("size") > SHORT).select("run", "node", F.col("size").cast("int").alias("size")), "long")
    lead = long.groupBy("run").agg(F.min("node").alias("a"))
    pairs = pairs.unionByName(long.drop("size").join(lead, "run").filter("node <> a").select("a", F.col("node").alias("b"))).distinct()
    for side in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("node").alias(side), F.col("n").alias(f"n_{side}"), F.col("sketch").alias(f"s_{side}")), side)
    pairs = pairs.filter(F.least("n_a", "n_b") * DENOMINATOR >= F.greatest("n_a", "n_b") * NUMERATOR).filter(F.pandas_udf(_allowed, "boolean")("n_a", "s_a", "n_b", "s_b")).select("a", "b")
    pairs = staged(pairs, "pairs")
    tables.drop("runs")
    edges = staged(_verified(pairs, sets), "links")
    components = staged(connected_components(edges), "components")
    for nearest in (NEAREST, 0):
        left = _open_runs(long, components, tables)
        found = staged(_pairs_apart(left, sets, nearest), "apart")
        linked_ = staged(_verified(staged(found.select("a", "b").distinct(), "pairs"), sets), "links")
        if not linked_.isEmpty():  # the old components are stars, so that their number of edges is small
            stars = components.filter("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
            components = staged(connected_components(stars.unionByName(linked_)), "components")
        long = long.join(found.select("run").distinct(), "run", "left_semi")  # no other run has a pair to test
    return nodes, components


def join_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    nodes, components = linked_nodes(docs)
    classes = nodes.filter("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("least"))
    placed = classes.join(components, "node", "left").select("node", "least", F.coalesce("component", "node").alias("component"))
    lowest = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    placed = staged(placed.join(lowest, "component").select("node", "component_id"), "placed")
    return nodes.join(placed, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_components(table(spark, sf_dir, "documents"))
