"""Exact repeated-substring removal by difference-cover blockwise suffix sorting.

Wanted is every start whose `LENGTH` bytes occur at another start of any document. Suffixes are dealt to
buckets by content: among the hashes of all `GRAM`-byte strings within a start's `LENGTH` bytes the least,
at its rightmost place, is the start's anchor, so equal strings fall in one bucket, at one distance
from the anchor. The starts of one anchor stand together; their joint bytes are a snippet. Equal
snippets are found by hash and aggregated first: of snippets that occur twice every start is repeated,
which settles copies of any number. Only buckets with several different snippets are sorted.

They are sorted a block of buckets at a time. In a block, the positions whose distance from the
anchor lies in a difference cover modulo `PERIOD` are ranked by their first 80 bytes, and by doubling
(position + 80 lies in the cover again) by 160 and 320. A suffix is then ordered by its first eight bytes;
longer ties are resolved by the ranks of the cover positions next behind its start and last before start +
`PERIOD`, which reach to the last eight bytes. Memory is that of a block. A bucket of over `HOT` snippets
is dealt further by slices of starts and the bytes that all starts of a slice have in common.

Defined results: null text is empty. Matches lie within one document each; strings are judged on the
input. Copies of a text are different documents, so that of 400 bytes and more nothing is left of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.shipping import ship
from .common import maybe_in, slices, staged, table, trimmed
from .winnowing import rolling_hashes

LENGTH, GRAM, PERIOD, STEP = 400, 32, 80, 9
#: Distances from the anchor, modulo PERIOD, of the cover's positions: any difference is one of two of them.
COVER = np.array(sorted({*range(STEP), *range(0, PERIOD, STEP)}))
HOT, SLICE, BLOCK_BYTES = 512, 64, 3 << 20
_SPAN, _LOW = 60_000, np.uint64(0xFFFF)
_LETTER = np.random.default_rng(3).integers(0, 1 << 63, 256, dtype=np.uint64)
_BASE, _BACK = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_IN_COVER = np.isin(np.arange(PERIOD), COVER)
#: For each distance modulo PERIOD: bytes on to the next cover position, and from start + PERIOD back to the last.
_ON = np.array([next(d for d in range(PERIOD) if _IN_COVER[(r + d) % PERIOD]) for r in range(PERIOD)])
_OFF = np.array([next(d for d in range(PERIOD) if _IN_COVER[(r - d) % PERIOD]) for r in range(PERIOD)])
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    got = _powers.get(base)
    if got is None or len(got) < n:
        got = np.full(max(n, 1 << 16), base, np.uint64)
        got[0] = 1
        np.multiply.accumulate(got, out=got)
        _powers[base] = got
    return got[:n]


def text_key(raw: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little", signed=True)


def anchored(data: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of a text's bytes, for each anchor: its hash, the hash of its snippet, first and last start, place."""
    hashes = rolling_hashes(data.astype(np.uint64), GRAM)
    width = LENGTH - GRAM + 1
    found = []
    for at in range(0, len(hashes) - width + 1, _SPAN - width + 1):
        part = hashes[at : at + _SPAN]
        key, size = (part & ~_LOW) | (_LOW - np.arange(len(part), dtype=np.uint64)), 1
        while 2 * size <= width:
            key = np.minimum(key[:-size], key[size:])
            size *= 2
        if size < width:
            key = np.minimum(key[: len(key) - (width - size)], key[width - size :])
        found.append((_LOW - (key & _LOW)).astype(np.int64) + at)
    anchor = np.concatenate(found)
    lo = np.flatnonzero(np.diff(anchor, prepend=-1))
    hi = np.concatenate([lo[1:], [len(anchor)]]) - 1
    at = anchor[lo]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_LETTER[data] * powers(_BASE, len(data)))])
    snippet = (sums[hi + LENGTH] - sums[lo]) * powers(_BACK, len(data))[lo]
    snippet = (snippet ^ (hi - lo).astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
    return hashes[at], snippet ^ (snippet >> np.uint64(31)), lo, hi, at


def _first_pass(docs: DataFrame) -> DataFrame:
    """A row per document (doc_id, t, n_bytes, sha256) and one per anchor of each different text (h, s, t, lo, hi, p, c)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                keys, sizes, shas, copies, texts = [], [], [], {}, []
                for text in part.column("text").to_pylist():
                    raw = (text or "").encode("utf-8", "surrogatepass")
                    t = text_key(raw)
                    keys.append(t)
                    sizes.append(len(raw))
                    shas.append(hashlib.sha256(raw).hexdigest())
                    if len(raw) >= LENGTH:
                        if t not in copies:
                            texts.append((t, raw))
                        copies[t] = copies.get(t, 0) + 1
                n, nothing = part.num_rows, [pa.nulls(part.num_rows, x) for x in (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(keys), pa.array(sizes, pa.int64()), pa.array(shas), *nothing], names)
                if not texts:
                    continue
                rows = [(t, *anchored(np.frombuffer(raw, np.uint8))) for t, raw in texts]
                count = [len(r[1]) for r in rows]
                h, s, lo, hi, p = (np.concatenate([r[i] for r in rows]) for i in range(1, 6))
                t = np.repeat(np.array([r[0] for r in rows]), count)
                c = np.repeat(np.array([copies[r[0]] for r in rows], np.int32), count)
                n = len(h)
                yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.array(t), pa.nulls(n, pa.int64()), pa.nulls(n, pa.string()), pa.array(h.view(np.int64)), pa.array(s.view(np.int64)), *(pa.array(x.astype(np.int32)) for x in (lo, hi, p, c))], names)

    names = ["doc_id", "t", "n_bytes", "sha256", "h", "s", "lo", "hi", "p", "c"]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(trimmed(run), "doc_id long, t long, n_bytes long, sha256 string, h long, s long, lo int, hi int, p int, c int")


def _doubled(rank: np.ndarray, place: np.ndarray, at: np.ndarray, by: int) -> np.ndarray:
    """Ranks of twice the depth: rank[k] of the position at[k], -1 where there is none; place maps positions to k."""
    on = place[np.minimum(at + by, len(place) - 1)]
    ok = (rank >= 0) & (at + by < len(place)) & (on >= 0)
    ok[ok] = rank[on[ok]] >= 0
    out = np.full(len(rank), -1, np.int64)
    if ok.any():
        pair = rank[ok] * (int(rank.max()) + 1) + rank[on[ok]]
        out[ok] = np.unique(pair, return_inverse=True)[1]
    return out


def repeated_starts(snippets: list[bytes], bucket: np.ndarray, lead: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sort the suffixes of a block of snippets. bucket: of each snippet, lead: its anchor's distance from its first byte.

    Returns for every start (snippet, start within it, whether its LENGTH bytes stand in another snippet of the bucket).
    """
    size = np.array([len(s) for s in snippets])
    base = np.cumsum(size) - size
    data = np.frombuffer(b"".join(snippets) + bytes(8), np.uint8)
    n = len(data) - 8
    owner = np.repeat(np.arange(len(snippets)), size)
    within = np.arange(n) - base[owner]
    left = size[owner] - within
    words = np.lib.stride_tricks.sliding_window_view(data, 8)
    residue = (within - lead[owner]) % PERIOD

    at = np.flatnonzero(_IN_COVER[residue] & (left >= PERIOD))
    place = np.full(n, -1, np.int64)
    place[at] = np.arange(len(at))
    rank = np.zeros(len(at), np.int64)
    for k in range(0, PERIOD, 8):
        word = np.ascontiguousarray(words[at + k]).view(">u8").reshape(-1).astype(np.uint64)
        order = np.lexsort((word, rank))
        step = np.ones(len(at), np.int64)
        step[1:] = (rank[order][1:] != rank[order][:-1]) | (word[order][1:] != word[order][:-1])
        rank[order] = np.cumsum(step) - 1
    for depth in (PERIOD, 2 * PERIOD):
        short = left[at] < 2 * depth
        got = _doubled(rank, place, at, depth)
        got[short] = -1
        rank = got

    start = np.flatnonzero(left >= LENGTH)
    first = rank[place[start + _ON[residue[start]]]]
    last = rank[place[start + PERIOD - _OFF[residue[start]]]]
    tie = first * (int(rank.max(initial=0)) + 1) + last
    head, tail = (np.ascontiguousarray(words[start + k]).view(">u8").reshape(-1).astype(np.uint64) for k in (0, LENGTH - 8))
    who = owner[start]
    group = bucket[who].astype(np.int64) * (1 << 20) + (lead[who] - within[start] + (1 << 19))
    order = np.lexsort((tail, tie, head, group))
    same = np.ones(len(order), bool)
    for key in (group, head, tie, tail):
        key = key[order]
        same[1:] &= key[1:] == key[:-1]
    same[:1] = False
    twice = np.zeros(len(start), bool)
    twice[order] = same | np.concatenate([same[1:], [False]])[: len(same)]
    return who, within[start], twice


def _snippets(docs: DataFrame, reps: DataFrame, homes: DataFrame) -> DataFrame:
    """(h, core, s, c, t, lo, lead, bytes) of the snippets to be sorted."""
    wanted = staged(reps.groupBy("t").agg(F.collect_list(F.struct("h", "s", "c", "lo", "hi", "p", "many")).alias("marks")).join(homes, "t"), "wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                for t, text, marks in zip(*(part.column(x).to_pylist() for x in ("t", "text", "marks"))):
                    raw = (text or "").encode("utf-8", "surrogatepass")
                    if text_key(raw) != t:
                        continue
                    for m in marks:
                        lo, hi, p = m["lo"], m["hi"], m["p"]
                        if not m["many"]:
                            rows.append((m["h"], 0, m["s"], m["c"], t, lo, p - lo, raw[lo : hi + LENGTH]))
                            continue
                        for k in range((p - hi) // SLICE, (p - lo) // SLICE + 1):  # starts p - o with o in the slice
                            a, b = max(lo, p - (k + 1) * SLICE + 1), min(hi, p - k * SLICE)
                            core = raw[p - k * SLICE : p - (k + 1) * SLICE + 1 + LENGTH]
                            rows.append((m["h"], text_key(core + bytes([k % 256])), m["s"], m["c"], t, a, p - a, raw[a : b + LENGTH]))
                if rows:
                    cols = list(zip(*rows))
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    names = ["h", "core", "s", "c", "t", "lo", "lead", "bytes"]
    kinds = [pa.int64()] * 8
    kinds[6], kinds[7] = pa.int32(), pa.binary()
    found = maybe_in(docs.select(_key("doc_id"), "text"), "_key", wanted, "_key").join(wanted, "_key").select("t", "text", "marks")
    return found.mapInArrow(trimmed(run), "h long, core long, s long, c long, t long, lo long, lead int, bytes binary")


def _key(name: str):
    return F.coalesce(F.col(name).cast("long"), F.lit(-(1 << 63))).alias("_key")


def _sorted_blocks(rows: DataFrame) -> DataFrame:
    """(t, lo, hi): the starts found repeated, of snippets that occur once."""
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def block(held: list[tuple]) -> pa.RecordBatch | None:
        bucket = np.cumsum([0] + [a[:2] != b[:2] for a, b in zip(held[1:], held)])
        _, start, twice = repeated_starts([r[6] for r in held], bucket, np.array([r[5] for r in held]))
        sizes = np.array([len(r[6]) - LENGTH + 1 for r in held])
        edge = np.cumsum(sizes) - sizes
        out = []
        single = np.repeat(np.array([r[7] == 1 for r in held]), sizes)
        hit = np.flatnonzero(twice & single)
        if not len(hit):
            return None
        who = np.searchsorted(edge, hit, "right") - 1
        cut = np.flatnonzero(np.concatenate([[True], (np.diff(hit) != 1) | (np.diff(who) != 0)]))
        for a, b in zip(cut, np.concatenate([cut[1:], [len(hit)]])):
            r = held[who[a]]
            out.append((r[3], r[4] + int(start[hit[a]]), r[4] + int(start[hit[b - 1]])))
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(3)], ["t", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, seen = [], 0, None
        for batch in batches:
            for part in slices(batch, "bytes"):
                for h, core, s, t, lo, lead, raw, c in zip(*(part.column(x).to_pylist() for x in ("h", "core", "s", "t", "lo", "lead", "bytes", "c"))):
                    if held and (h, core) != held[-1][:2] and size > BLOCK_BYTES:
                        got = block(held)
                        if got is not None:
                            yield got
                        held, size = [], 0
                    mark = (h, core, s, lead)
                    if mark == seen:  # the same snippet from a repeated row
                        continue
                    seen = mark
                    held.append((h, core, s, t, lo, lead, raw, c))
                    size += len(raw)
        if held:
            got = block(held)
            if got is not None:
                yield got

    return rows.repartition(n, "h", "core").sortWithinPartitions("h", "core", "s", "lead").mapInArrow(trimmed(run), "t long, lo long, hi long")


def union_of(starts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Removed byte ranges [a, b) of ranges of repeated starts."""
    out: list[list[int]] = []
    for lo, hi in sorted(starts):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi + LENGTH)
        else:
            out.append([lo, hi + LENGTH])
    return [(a, b) for a, b in out]


def _removals(docs: DataFrame, starts: DataFrame, homes: DataFrame) -> DataFrame:
    """(t, n_removed, n_spans, kept) for each different text from which something goes."""
    wanted = staged(starts.groupBy("t").agg(F.collect_set(F.struct("lo", "hi")).alias("starts")).join(homes, "t"), "removed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                for t, text, starts_ in zip(*(part.column(x).to_pylist() for x in ("t", "text", "starts"))):
                    raw = (text or "").encode("utf-8", "surrogatepass")
                    if text_key(raw) != t:
                        continue
                    spans, digest, done = union_of([(x["lo"], x["hi"]) for x in starts_]), hashlib.sha256(), 0
                    for a, b in spans:
                        digest.update(raw[done:a])
                        done = b
                    digest.update(raw[done:])
                    rows.append({"t": t, "n_removed": sum(b - a for a, b in spans), "n_spans": len(spans), "kept": digest.hexdigest()})
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    schema = pa.schema([("t", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.string())])
    found = maybe_in(docs.select(_key("doc_id"), "text"), "_key", wanted, "_key").join(wanted, "_key").select("t", "text", "starts")
    return found.mapInArrow(trimmed(run), "t long, n_removed long, n_spans long, kept string").dropDuplicates(["t"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    ship(docs.sparkSession)
    first = staged(_first_pass(docs), "first")
    files = first.filter("h IS NULL").select("doc_id", "t", "n_bytes", "sha256")
    anchors = first.filter("h IS NOT NULL")
    homes = files.groupBy("t").agg(F.min(_key("doc_id")).alias("_key"))
    kinds = staged(anchors.groupBy("h", "s").agg(F.sum("c").alias("c"), F.min(F.struct("t", "lo", "hi", "p")).alias("rep")), "snippets")
    starts = anchors.select("h", "s", "t", "lo", "hi").join(kinds.filter("c > 1").select("h", "s"), ["h", "s"], "left_semi").select("t", F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"))
    mixed = kinds.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    reps = kinds.join(mixed, "h").select("h", "s", "c", "rep.*", (F.col("n") > HOT).alias("many"))
    starts = starts.unionByName(_sorted_blocks(_snippets(docs, reps, homes)))
    removed = staged(_removals(docs, starts, homes), "removals")
    joined = files.join(removed, "t", "left")
    return joined.select("doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"), F.coalesce("kept", "sha256").alias("kept_sha256"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
