"""Removal of word windows that occur twice anywhere, by recompression.

A text is a sequence of symbols, at first its words. A round names runs of one symbol (the first round) and pairs: the names, dealt by hash into
left and right ones, let every left one that a right one follows become one symbol with it. Names are hashes of what they stand for, so that every task
gives equal strings the same name; whether a pair is made depends on its two symbols alone. So of a window of `WINDOW` words
all symbols of a round are settled by its own words, but for one at an end: the first if it is a right one, the last if it is a
left one, and the first and last run. Equal windows have the same interior symbols, wherever they stand. `ROUNDS` rounds
leave a window some seven interior symbols of about four words. The one with the least hash, the leftmost of equal ones, is the window's anchor (of a window
whose symbols are used up earlier one of the round before). The windows of an anchor stand together; their joint words are a snippet.

In Spark, a first round gathers the anchors by name. A name that occurs once shows nothing. If all snippets of a name are equal,
every window of them is repeated, which settles copies of any number. Names with different snippets are gathered again with half of the words that a window has besides
the anchor, once those before and once those behind it: every window holds one of the halves. Where a half is shared, the windows with that half are
hashed, anchor and place included, and gathered in a last round. Each round passes on what is left of one row for each different snippet; its rows are counted before
they are shuffled, and joined with small written tables, whose hot keys Spark splits.

Defined results: null text has no words. A window lies within one document. Windows are judged on the input. Windows within one text count. Copies of a text are
different documents, so that of 35 words and more nothing is left of them. Windows are equal if two hashes of 64 bits are, of the anchor and of the words. Memory grows with the longest text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.shipping import ship
from .common import Tables, maybe_in, slices, table, trimmed
from .words import BASE, hashed_words, mix, powers

WINDOW, ROUNDS = 35, 5
_RUN, _TIMES, _LEFT, _RIGHT, _SIDE, _LEAST = (np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F))
_BACK = np.uint64(pow(int(BASE), -1, 1 << 64))
#: Fields of a place, in bits: the first window's word, then the anchor's length, its distance from that word, and the number of further windows.
_FIELD = 6


def _least(symbols: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The place in each [a, b] with the least hash, of equal ones the leftmost."""
    key, size, out = mix(symbols ^ _LEAST), b - a + 1, np.empty(len(a), np.int64)
    best, width = np.arange(len(symbols)), 1
    while True:
        own = np.flatnonzero((size >= width) & (size < 2 * width))
        if len(own):
            i, j = best[a[own]], best[b[own] - width + 1]
            out[own] = np.where(key[i] <= key[j], i, j)
        if 2 * width > size.max(initial=0):
            return out
        i, j = best[:-width], best[width:]
        best, width = np.where(key[i] <= key[j], i, j), 2 * width


def anchored(words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of texts end to end, the anchors of their windows: name, place in words, length in words, first and last window's word."""
    n = len(words)
    windows = np.flatnonzero(np.arange(n) + WINDOW <= np.repeat(np.cumsum(sizes), sizes))
    a, b, rest = windows, windows + WINDOW - 1, np.arange(len(windows))  # interior symbols of the windows not settled
    name, place, length = np.empty(len(windows), np.uint64), np.empty(len(windows), np.int64), np.empty(len(windows), np.int64)
    symbols, at = words, np.arange(n + 1)

    def settle(done: np.ndarray) -> None:
        if done.any():
            x = _least(symbols, a[done], b[done])
            name[rest[done]], place[rest[done]], length[rest[done]] = symbols[x], at[x], at[x + 1] - at[x]

    def shrunk(first: np.ndarray, new_a: np.ndarray, new_b: np.ndarray, renamed: np.ndarray) -> None:
        nonlocal a, b, rest, symbols, at
        left = new_a <= new_b
        settle(~left)
        a, b, rest = new_a[left], new_b[left], rest[left]
        symbols, at = renamed, np.append(at[first], at[-1])

    for round_ in range(ROUNDS):
        if not len(rest):
            break
        if not round_:
            new = np.concatenate([[True], symbols[1:] != symbols[:-1]])
            number, first = np.cumsum(new) - 1, np.flatnonzero(new)
            times = np.diff(first, append=len(symbols))
            renamed, several = symbols[first], np.flatnonzero(times > 1)
            renamed[several] = mix(renamed[several] * _RUN + times[several].astype(np.uint64) * _TIMES)
            shrunk(first, number[a] + 1, number[b] - 1, renamed)
        lefts = mix(symbols + np.array([round_ + 1], np.uint64) * _SIDE) >> np.uint64(63) == 0
        pair = np.append(lefts[:-1] & ~lefts[1:], False)
        new = np.concatenate([[True], ~pair[:-1]])
        number, first = np.cumsum(new) - 1, np.flatnonzero(new)
        renamed, several = symbols[first], np.flatnonzero(pair[first])
        renamed[several] = mix(renamed[several] * _LEFT + symbols[first[several] + 1] * _RIGHT + _SIDE)
        shrunk(first, number[a] + ~lefts[a], number[b] - lefts[b], renamed)
    settle(np.ones(len(rest), bool))
    cut = np.ones(len(windows), bool)
    cut[1:] = (place[1:] != place[:-1]) | (name[1:] != name[:-1]) | (windows[1:] != windows[:-1] + 1)
    lo = np.flatnonzero(cut)
    hi = np.append(lo[1:], len(windows))[: len(lo)] - 1
    return name[lo], place[lo], length[lo], windows[lo], windows[hi]


class Stretches:
    """Hashes of stretches of words, equal for equal stretches."""

    def __init__(self, words: np.ndarray):
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * powers(len(words)))])
        self.back = powers(len(words) + 1, _BACK)

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((self.sums[b] - self.sums[a]) * self.back[a] + (b - a).astype(np.uint64))


def _half(length: np.ndarray) -> np.ndarray:
    """Words that every window has on one side of an anchor at least."""
    return (WINDOW - length + 1) // 2


class Texts:
    """Some texts' anchors: own number of the text, name, snippet, hashes of the halves, place; places count words within the text."""

    def __init__(self, raws: list[bytes]):
        joined = b" ".join(raws)
        self.words, starts = hashed_words(joined)
        edges = np.cumsum([0] + [len(r) + 1 for r in raws])
        self.base = np.searchsorted(starts, edges)
        self.sizes = np.diff(self.base)
        self.hashes = Stretches(self.words)
        self.name, p, length, self.lo, self.hi = anchored(self.words, self.sizes)
        self.text = np.searchsorted(self.base, self.lo, "right") - 1
        self.snippet = self.hashes.of(self.lo, self.hi + WINDOW) ^ mix((self.hi - self.lo).astype(np.uint64))
        half, end = _half(length), p + length
        left, right = p - half >= self.lo, end + half <= self.hi + WINDOW
        zero = np.zeros(1, np.uint64)
        low = np.where(left, self.hashes.of(np.where(left, p - half, p), p) | np.uint64(1), zero) & np.uint64(0xFFFFFFFF)
        high = np.where(right, self.hashes.of(end, np.where(right, end + half, end)) | np.uint64(1), zero) & np.uint64(0xFFFFFFFF)
        self.halves = (high << np.uint64(32)) | low  # 0: no window has that half
        self.place = ((((self.lo - self.base[self.text]) << _FIELD | length) << _FIELD | (p - self.lo)) << _FIELD) | (self.hi - self.lo)

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The first anchor of each name and snippet in a text, how often the text has it, and for each anchor whether it has it again."""
        key = mix(self.name + mix(self.snippet + mix(self.text.astype(np.uint64))))
        _, first, which, count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        order = np.argsort(first)
        return first[order], count[order], count[which] > 1


def _unpacked(place: int) -> tuple[int, int, int, int]:
    """The first window's word, the anchor's length, its distance and the number of further windows."""
    mask = (1 << _FIELD) - 1
    return place >> 3 * _FIELD, place >> 2 * _FIELD & mask, place >> _FIELD & mask, place & mask


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and t, which names the text."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.unhex(F.md5(text.cast("binary"))).alias("t"))


def _raw(column: pa.Array) -> list[bytes]:
    return [x.as_buffer().to_pybytes() for x in column]


def _first_pass(docs: DataFrame) -> DataFrame:
    """A row per document (doc_id, t, n_words, sha256) and one per different anchor of each text (t, h, s, halves, place, c)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                keys, raws, sizes, shas, numbers, copies = part.column("t").to_pylist(), _raw(part.column("text")), [], [], {}, []
                for k, raw in enumerate(raws):
                    words = raw.split()
                    sizes.append(len(words))
                    shas.append(hashlib.sha256(b" ".join(words)).hexdigest())
                    if len(words) >= WINDOW:
                        own = numbers.setdefault(keys[k], len(numbers))
                        if own == len(copies):
                            copies.append([k, 0])
                        copies[own][1] += 1
                n = part.num_rows
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("t"), pa.array(sizes, pa.int64()), pa.array(shas), *(pa.nulls(n, pa.int64()) for _ in range(5))], names)
                if not copies:
                    continue
                texts = Texts([raws[k] for k, _ in copies])
                first, count, _ = texts.distinct()
                own = texts.text[first]
                count = count * np.array([c for _, c in copies])[own]
                key = pa.array([keys[k] for k, _ in copies], pa.binary()).take(pa.array(own))
                n = len(first)
                yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), key, pa.nulls(n, pa.int64()), pa.nulls(n, pa.string()), *(pa.array(x[first].view(np.int64)) for x in (texts.name, texts.snippet, texts.halves, texts.place)), pa.array(count)], names)

    names = ["doc_id", "t", "n_words", "sha256", "h", "s", "halves", "place", "c"]
    return docs.mapInArrow(trimmed(run), "doc_id long, t binary, n_words long, sha256 string, h long, s long, halves long, place long, c long")


def _windows(texts: DataFrame) -> DataFrame:
    """(h, w, t, at, once) of the windows that texts (t, text, marks) are asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                raws, keys, rows = _raw(part.column("text")), part.column("t"), []
                words, starts = hashed_words(b" ".join(raws))
                base = np.searchsorted(starts, np.cumsum([0] + [len(r) + 1 for r in raws]))
                for own, marks in enumerate(part.column("marks").to_pylist()):
                    for m in marks:
                        lo, length, p, more = _unpacked(m["place"])
                        half = (WINDOW - length + 1) // 2
                        # windows that hold the left half start so far before the anchor, those with the right half behind them
                        a, b = (0, min(more, p - half)) if m["side"] == 0 else (max(0, p - half + 1), more)
                        if a <= b:
                            rows.append((own, m["h"], lo, a, b, p, m["c"] == 1))
                if not rows:
                    continue
                own, h, lo, a, b, p, once = (np.array(x) for x in zip(*rows))
                count = b - a + 1
                row = np.repeat(np.arange(len(rows)), count)
                step = a[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                at = lo[row] + step
                start = base[own[row]] + at
                w = mix(Stretches(words).of(start, start + WINDOW) + (p[row] - step).astype(np.uint64) * _SIDE)
                yield pa.RecordBatch.from_arrays([pa.array(h[row].astype(np.int64)), pa.array(w.view(np.int64)), keys.take(pa.array(own[row])), pa.array(at.astype(np.int64)), pa.array(once[row])], ["h", "w", "t", "at", "once"])

    return texts.mapInArrow(trimmed(run), "h long, w long, t binary, at long, once boolean")


def _removals(texts: DataFrame) -> DataFrame:
    """(t, n_removed, kept) of texts (t, text, starts): starts are ranges of repeated windows; those that repeat within the text are found again here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                raws = _raw(part.column("text"))
                texts_ = Texts(raws)
                again = texts_.distinct()[2]
                edge = np.zeros(len(texts_.words) + 1, np.int64)
                np.add.at(edge, texts_.lo[again], 1)
                np.add.at(edge, texts_.hi[again] + WINDOW, -1)
                for own, starts in enumerate(part.column("starts").to_pylist()):
                    spans = np.array([(x["lo"], x["hi"] + WINDOW) for x in starts]) + texts_.base[own]
                    np.add.at(edge, spans[:, 0], 1)
                    np.add.at(edge, spans[:, 1], -1)
                kept, removed, shas = np.cumsum(edge[:-1]) == 0, [], []
                for own, raw in enumerate(raws):
                    words, left = raw.split(), np.flatnonzero(kept[texts_.base[own] : texts_.base[own + 1]])
                    removed.append(len(words) - len(left))
                    shas.append(hashlib.sha256(b" ".join([words[k] for k in left.tolist()])).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column("t"), pa.array(removed, pa.int64()), pa.array(shas)], ["t", "n_removed", "kept"])

    return texts.mapInArrow(trimmed(run), "t binary, n_removed long, kept string")


def _fetched(docs: DataFrame, wanted: DataFrame, column: str) -> DataFrame:
    """(t, text, column) of the texts wanted (t, home, column), one document each but for rows that repeat id and text."""
    some = maybe_in(docs.withColumn("home", _home()), "t", wanted, "t")
    return some.join(wanted, ["t", "home"]).select("t", "text", column)


def _home() -> Column:
    return F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    spark = docs.sparkSession
    ship(spark)
    docs, tables = _keyed(docs), Tables(spark)
    first = tables.write(_first_pass(docs), "first")
    files = first.filter("h IS NULL").select("doc_id", "t", "n_words", "sha256")
    homes = files.groupBy("t").agg(F.min(_home()).alias("home"))
    anchors = first.filter("h IS NOT NULL").select("t", "h", "s", "halves", "place", "c")
    # names that occur twice, and whether they stand in different snippets
    names = tables.write(anchors.groupBy("h").agg(F.sum("c").alias("n"), F.min("s").alias("least"), F.max("s").alias("most")).filter("n > 1").select("h", (F.col("least") != F.col("most")).alias("mixed")), "names")
    shared = tables.write(maybe_in(anchors, "h", names, "h").join(names, "h"), "shared")
    lo = F.shiftright("place", 3 * _FIELD)
    span = [lo.alias("lo"), (lo + F.col("place").bitwiseAND((1 << _FIELD) - 1)).alias("hi")]
    starts = shared.filter("NOT mixed").select("t", *span)
    # one row for each different snippet of a name that has several
    kinds = tables.write(shared.filter("mixed").groupBy("h", "s").agg(F.sum("c").alias("c"), F.min(F.struct("t", "place")).alias("rep"), F.min("halves").alias("halves")), "kinds")
    several = tables.write(kinds.filter("c > 1").select("h", "s"), "several")
    starts = starts.unionByName(shared.filter("mixed").select("h", "s", "t", "place").join(several, ["h", "s"], "left_semi").select("t", *span))
    # halves that several snippets share
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("halves").bitwiseAND(0xFFFFFFFF).alias("half")), F.struct(F.lit(1).alias("side"), F.shiftrightunsigned("halves", 32).alias("half"))))
    halves = kinds.select("h", "c", "rep", sides.alias("x")).select("h", "c", "rep.t", "rep.place", "x.side", "x.half").filter("half <> 0")
    common = tables.write(halves.groupBy("h", "side", "half").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h", "side", "half"), "common")
    asked = halves.join(common, ["h", "side", "half"], "left_semi").groupBy("t").agg(F.collect_list(F.struct("h", "c", "place", "side")).alias("marks"))
    wanted = tables.write(asked.join(homes, "t"), "wanted")
    windows = tables.write(_windows(_fetched(docs, wanted, "marks")), "windows")
    tables.drop("kinds", "common", "wanted")
    twice = tables.write(windows.groupBy("h", "w").agg(F.min(F.struct("t", "at")).alias("x"), F.max(F.struct("t", "at")).alias("y")).filter("x <> y").select("h", "w"), "twice")
    again = windows.filter("once").join(twice, ["h", "w"], "left_semi").select("t", F.col("at").alias("lo"), F.col("at").alias("hi"))
    starts = starts.unionByName(again)
    found = tables.write(starts.groupBy("t").agg(F.collect_set(F.struct("lo", "hi")).alias("starts")).join(homes, "t"), "found")
    tables.drop("names", "shared", "several", "windows", "twice")
    removed = tables.write(_removals(_fetched(docs, found, "starts")).dropDuplicates(["t"]), "removed")
    tables.drop("found")
    joined = files.join(removed, "t", "left")
    return joined.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("kept", "sha256").alias("kept_sha256"))


def op13_recompression_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
