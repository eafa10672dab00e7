"""Document fingerprints by winnowing.

Every run of `K` code points has a rolling hash; of every `W` hashes in a row the least is kept, the
rightmost of equal ones, with its position. So any `K` + `W` - 1 code points that two texts share bring
at least one common fingerprint, at known places in both, and none arises from less than `K`.

Defined results: a null text is an empty one, with an empty fingerprint. A text shorter than `K` has
the hash of all of it, at 0; one with fewer than `W` hashes has their least. The likeness of two
fingerprints is the Jaccard index of their hashes, 1 if both are empty. Rows of one doc_id stand in
order of text; a null doc_id is the least.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.shipping import ship
from .common import slices, table, trimmed

K, W = 16, 49
_BASE, _STIR = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)
#: Hashes looked at together: a position within them fits the low 16 bits of a key.
_SPAN = 60_000
_LOW = np.uint64(0xFFFF)


def rolling_hashes(codes: np.ndarray, k: int = K) -> np.ndarray:
    """A 64-bit hash of every run of k codes: polynomials of powers of two codes, put together."""
    at, width, power = codes * _STIR + _STIR, 1, _BASE
    whole, done = None, 0
    left = k
    with np.errstate(over="ignore"):
        while True:
            if left & 1:
                if whole is None:
                    whole = at
                else:
                    n = len(at) - done
                    whole = whole[:n] * np.uint64(power) + at[done : done + n]
                done += width
            left >>= 1
            if not left:
                break
            at = at[:-width] * np.uint64(power) + at[width:]
            power, width = power * power % (1 << 64), 2 * width
        whole = whole[: len(codes) - k + 1]
        whole = (whole ^ (whole >> np.uint64(29))) * _STIR
        return whole ^ (whole >> np.uint64(32))


def winnow(hashes: np.ndarray, w: int = W) -> np.ndarray:
    """Positions of the least of every w hashes in a row (by their upper 48 bits), the rightmost of equal ones."""
    w = min(w, len(hashes))
    if not w:
        return np.empty(0, np.int64)
    found = []
    for at in range(0, len(hashes) - w + 1, _SPAN - w + 1):
        part = hashes[at : at + _SPAN]
        key = (part & ~_LOW) | (_LOW - np.arange(len(part), dtype=np.uint64))
        size = 1
        while 2 * size <= w:
            key = np.minimum(key[:-size], key[size:])
            size *= 2
        if size < w:
            key = np.minimum(key[: len(key) - (w - size)], key[w - size :])
        found.append((_LOW - (key & _LOW)).astype(np.int64) + at)
    every = np.concatenate(found)
    return every[np.flatnonzero(np.diff(every, prepend=-1))]


def fingerprint(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (48 bits) and positions."""
    if not text:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    hashes = rolling_hashes(codes, min(K, len(codes)))
    at = winnow(hashes)
    return hashes[at] >> np.uint64(16), at


def spell(marks: tuple[np.ndarray, np.ndarray]) -> str:
    """Base64 of the hashes, six bytes each, a full stop, base64 of the positions, four bytes each."""
    hashes, at = marks
    raw = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
    return f"{base64.b64encode(raw).decode()}.{base64.b64encode(at.astype('<u4').tobytes()).decode()}"


def read(fingerprint_: str) -> list[tuple[int, int]]:
    """(hash, position) pairs of a spelled fingerprint."""
    raw, at = (base64.b64decode(x) for x in fingerprint_.split("."))
    return [(int.from_bytes(raw[6 * i : 6 * i + 6], "little"), int(p)) for i, p in enumerate(np.frombuffer(at, "<u4"))]


def likeness(a: set[int], b: set[int]) -> float:
    both = len(a & b)
    return both / (len(a) + len(b) - both) if a or b else 1.0


def place_of(key: Column, bounds: list[int]) -> Column:
    """How many of the descending bounds the key lies below, by halving."""
    if not bounds:
        return F.lit(0)

    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(key < bounds[mid], search(mid + 1, hi)).otherwise(search(lo, mid))

    return search(0, len(bounds))


def in_turn(docs: DataFrame) -> DataFrame:
    """doc_id, text, _edge in partitions, each sorted by descending doc_id and closed by an edge row: the document that comes next after it.

    The order is cut at quantiles of doc_id into as many ranges as there are shuffle partitions, so
    no task sees more than its range; only one document a range is sent twice.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    least = -(1 << 63)
    key = F.coalesce(F.col("doc_id"), F.lit(least))
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 20_000)).first()[0] or []
    bounds = sorted(set(cuts), reverse=True)
    place = place_of(key, bounds)
    firsts = sorted((r["p"], r["k"]) for r in docs.groupBy(place.alias("p")).agg(F.max(key).alias("k")).collect())  # a row a range
    goes = {k: firsts[i - 1][0] for i, (_, k) in enumerate(firsts)}  # to the range before; the first of all to the last
    if not goes:
        return docs.withColumn("_edge", F.lit(False))
    ids = [k for k in goes if k != least]
    edge = docs.filter(F.col("doc_id").isin(ids) | (F.col("doc_id").isNull() if least in goes else F.lit(False)))
    edge = edge.groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    target = F.element_at(F.create_map(*[F.lit(x) for k, p in goes.items() for x in (k, p)]), key)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.lit(False).alias("_edge"), place.alias("_p"))
    rows = rows.unionByName(edge.select("doc_id", "text", F.lit(True).alias("_edge"), target.alias("_p")))
    rows = rows.repartitionById(len(bounds) + 1, F.col("_p").cast("int"))
    return rows.sortWithinPartitions("_edge", F.col("doc_id").desc_nulls_last(), "text").drop("_p")


def edited(text: str, after: str) -> str:
    n = len(text) // 3
    return text[: len(text) - n] + after[:n]


def fingerprints(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, its edited text's, and the likeness to that and to the next document's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                for doc_id, text, edge in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), part.column("_edge").to_pylist()):
                    marks = fingerprint(text)
                    now = (doc_id, text, marks, set(marks[0].tolist()), edge)
                    if before is not None:
                        rows.append(row(before, now))
                    before = now
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    def row(it: tuple, after: tuple) -> dict:
        doc_id, text, marks, hashes, _ = it
        other = edited(text, after[1])
        theirs = fingerprint(other)
        return {
            "doc_id": doc_id, "n_chars": len(text), "edited_sha256": hashlib.sha256(other.encode("utf-8", "surrogatepass")).hexdigest(), "fingerprint": spell(marks), "edited_fingerprint": spell(theirs),
            "near_edited": likeness(hashes, set(theirs[0].tolist())), "near_next": likeness(hashes, after[3]),
        }

    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
    ship(docs.sparkSession)
    return in_turn(docs).mapInArrow(trimmed(run), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op2_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
