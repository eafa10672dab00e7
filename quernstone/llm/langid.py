"""Language identification: averaged hashed subword embeddings, a linear softmax, calibrated rejection.

A text is lower-cased; every maximal run of letters is a word with a mark before and behind it. All
runs of `GRAMS` characters within marked words are subwords, hashed to `BUCKETS` rows of an
embedding table; a text's vector is the mean of its subwords' rows, and a linear softmax over it gives
the languages. Table and softmax are learned by stochastic gradient descent in numpy, from a stated and
bounded sample: at most `SAMPLE_ROWS` labelled rows (one of each language, where there are more languages), drawn by hash and evenly from the
languages, a repeated row once, of each row `PIECES` stretches drawn from its whole text; executors cut them, so
that the driver gets at most `PIECES` stretches of 2,000 subwords for a row and no whole text.

Stretches of a tenth of the rows are set aside. A temperature fitted on them calibrates the score. Rejection is calibrated on
them too, as a softmax is sure of many a text in no language that it knows: of each text the share of
subwords is taken that the training stretches of its predicted language hold, and in each band of `BANDS` by number of subwords
the set-aside stretches give that share's mean and deviation. A text is rejected whose share lies more than
`DEVIATIONS` deviations (of `SPREAD` at least) below its band's mean, or whose score is below `LEAST`.

Defined results
---------------
* Null text and text without a letter: `und`, score 0, rejected.
* No labelled rows to learn from: every text is `und`. A table without rows gives none.
* A null doc_id counts as not held out. Further columns are kept; clashing ones are replaced.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_text, table

BUCKETS, WIDTH, GRAMS = 1 << 15, 16, (3, 4)
SAMPLE_ROWS, PIECES, EPOCHS, RATE = 1600, 8, 6, 2.0
#: Rows of a language that are looked at for each that is drawn, and more of them, lest a language comes away empty.
OVER, MORE = 4, 32
#: Lengths of the stretches; the last number of subwords of each band but the longest one's; rejection.
STRETCHES, BANDS, DEVIATIONS, SPREAD, LEAST = (12, 60, 300, 2000), (20, 100, 600), 6.0, 0.025, 0.4
OWN = ["held_out", "lang_pred", "score", "rejected"]
#: Odd multipliers of the subword hash.
_MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)
_NOT_LETTERS = re.compile(r"[\W\d_]+")
_MARK = np.uint32(32)


def subwords(text: str) -> np.ndarray:
    """Bucket of every subword of the text, in order of place, shorter grams first."""
    marked = f" {_NOT_LETTERS.sub(' ', text.lower()).strip()} "
    if len(marked) < 3:
        return np.empty(0, np.int32)
    codes = np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), np.uint32)
    found = []
    for n in GRAMS:
        m = len(codes) - n + 1
        if m < 1:
            continue
        h = np.full(m, n, np.uint32)
        for j in range(n):
            h += codes[j : j + m] * _MIX[j]
            h ^= h >> np.uint32(15)
        inner = np.ones(m, bool)  # a mark stands only at a subword's ends
        for j in range(1, n - 1):
            inner &= codes[j : j + m] != _MARK
        found.append(((h * np.uint32(0x2545F491)) >> np.uint32(17)).astype(np.int32)[inner])
    return np.concatenate(found) if found else np.empty(0, np.int32)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def band_of(n: int) -> int:
    return sum(n > x for x in BANDS)


@dataclass
class Model:
    """langs, table and weights (None: the table is multiplied already), bias, temperature, bits of the buckets that a language's training holds, least share of such in each band."""

    langs: list[str]
    table: np.ndarray
    weights: np.ndarray | None
    bias: np.ndarray
    heat: float
    seen: np.ndarray
    least: list[float]

    def probabilities(self, ids: np.ndarray) -> np.ndarray:
        z = self.bias
        if len(ids):
            x = self.table[ids].mean(axis=0)
            z = (x if self.weights is None else x @ self.weights) + z
        z = z / self.heat
        e = np.exp(z - z.max())
        return e / e.sum()

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if not self.langs or not has_letter(text):
            return "und", 0.0, True
        ids = subwords(text)
        p = self.probabilities(ids)
        k = int(p.argmax())
        return self.langs[k], float(p[k]), bool(p[k] < LEAST or not len(ids) or familiar(self.seen[k], ids).mean() < self.least[band_of(len(ids))])


def familiar(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return bits[ids >> 3] >> (7 - (ids & 7)).astype(np.uint8) & 1


def stretches(text: str) -> tuple[list[np.ndarray], bool]:
    """PIECES stretches of subwords drawn from the whole text, and whether they are set aside; both follow from the text."""
    ids, rng = subwords(text), np.random.default_rng(zlib.crc32(text.encode("utf-8", "surrogatepass")))
    cuts, at = [], 0
    while at < len(ids):  # short and long ones, so that short texts are known as well
        n = int(rng.choice(STRETCHES))
        cuts.append(ids[at : at + n])
        at += n
    return [cuts[i] for i in rng.permutation(len(cuts))[:PIECES]], bool(rng.random() < 0.1)


def train(pieces: list[tuple[str, bool, np.ndarray]], seed: int = 9) -> Model:
    """Learn from (language, set aside, subwords); what is set aside fits temperature and rejection."""
    names = sorted({lang for lang, _, _ in pieces})
    rng = np.random.default_rng(seed)
    if not names:
        return Model([], np.zeros((BUCKETS, 0), np.float32), None, np.zeros(0), 1.0, np.zeros((0, BUCKETS // 8), np.uint8), [0.0] * (len(BANDS) + 1))
    label = {x: k for k, x in enumerate(names)}
    data = []
    for lang, aside, ids in pieces:
        rows, counts = np.unique(ids, return_counts=True)
        data.append((rows, (counts / len(ids)).astype(np.float32), label[lang], aside, band_of(len(ids))))
    table_ = rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
    weights, bias = rng.normal(0, 0.1, (WIDTH, len(names))).astype(np.float32), np.zeros(len(names), np.float32)
    fit = [x for x in data if not x[3]] or data
    steps, done = EPOCHS * len(fit), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(fit)):
            rows, share, k, *_ = fit[i]
            rate = RATE * (1 - done / steps)
            done += 1
            x = share @ table_[rows]
            z = x @ weights + bias
            g = np.exp(z - z.max())
            g /= g.sum()
            g[k] -= 1
            back = weights @ g
            weights -= rate * np.outer(x, g)
            bias -= 0.1 * rate * g
            table_[rows] -= rate * share[:, None] * back
    kept = [x for x in data if x[3]] or fit
    z = np.array([share @ table_[rows] for rows, share, *_ in kept]) @ weights + bias
    k, bands = np.array([x[2] for x in kept]), np.array([x[4] for x in kept])

    def loss(heat: float) -> float:
        s = z / heat
        s = s - s.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(k)), k]))

    heat = min(np.geomspace(0.25, 8, 41), key=loss)
    seen = np.zeros((len(names), BUCKETS // 8), np.uint8)
    for rows, _, k_, *_ in fit:
        np.bitwise_or.at(seen[k_], rows >> 3, np.uint8(128) >> (rows & 7).astype(np.uint8))
    known = np.array([share @ familiar(seen[top], rows) for (rows, share, *_), top in zip(kept, z.argmax(axis=1))])
    least = [0.0] * (len(BANDS) + 1)
    for band in range(len(least)):
        at = known[bands == band]
        if len(at) >= 20:  # too few say nothing of a band
            least[band] = float(at.mean() - DEVIATIONS * max(SPREAD, at.std()))
    small = len(names) <= WIDTH
    return Model(names, table_ @ weights if small else table_, None if small else weights, bias, float(heat), seen, least)


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_sample(docs: DataFrame, rows: int = SAMPLE_ROWS) -> list[tuple[str, bool, np.ndarray]]:
    """(language, set aside, subwords) of the stretches of at most about `rows` labelled rows that aren't held out, as many of each language, chosen by hash."""
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~is_held_out(F.col("doc_id")))
    name = F.col("doc_id").cast("string")  # the same draw whatever the width of the ids
    mark = F.xxhash64(name, F.col("text"))
    counts = labelled.groupBy("lang").agg(F.approx_count_distinct(mark).alias("count")).collect()  # a row a language
    if not counts:
        return []
    each = max(1, rows // len(counts))
    share = labelled.sparkSession.createDataFrame([(r["lang"], min(1.0, (OVER * each + MORE) / r["count"])) for r in counts], "lang string, share double")
    place = F.xxhash64(name, F.lit(5)).bitwiseAND((1 << 30) - 1) / float(1 << 30)
    marked = labelled.select("lang", "text", mark.alias("mark"), place.alias("place")).join(F.broadcast(share), "lang").filter(F.col("place") <= F.col("share"))  # a row a language
    once = marked.groupBy("lang", "mark").agg(F.min("place").alias("place"))  # a repeated row is one
    turn = F.row_number().over(Window.partitionBy("lang").orderBy("place", "mark"))
    chosen = [(r["lang"], r["mark"]) for r in once.withColumn("turn", turn).filter(F.col("turn") <= each).collect()]  # at most each of a language
    if not chosen:
        return []
    picked = F.broadcast(labelled.sparkSession.createDataFrame(chosen, "lang string, mark long"))
    drawn = marked.join(picked, ["lang", "mark"], "left_semi").select("mark", "lang", "text").dropDuplicates(["mark", "lang"])

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for m, lang, text in zip(*(batch.column(c).to_pylist() for c in ("mark", "lang", "text"))):
            found, aside = stretches(text)
            out += [(m, lang, aside, ids.astype("<i4").tobytes()) for ids in found]
        cols = list(zip(*out)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.string(), pa.bool_(), pa.binary()))], ["mark", "lang", "aside", "ids"])

    got = map_text(drawn, "mark long, lang string, aside boolean, ids binary", cut).collect()  # PIECES of each chosen row
    got = sorted(got, key=lambda r: (r["mark"], r["lang"], bytes(r["ids"])))
    return [(r["lang"], r["aside"], np.frombuffer(r["ids"], "<i4")) for r in got]


def fitted(docs: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    return train(training_sample(docs, rows))


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Every row of docs with held_out, lang_pred, score (0 to 1, calibrated) and rejected."""
    docs = docs.drop(*OWN)
    model = model or fitted(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x WIDTH floats, and BUCKETS bits and WIDTH floats a language

    def label(batch: pa.RecordBatch) -> pa.RecordBatch:
        said = [shared.value.predict(t) for t in batch.column("text").to_pylist()]
        out = [pa.array([x[i] for x in said], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
        return pa.RecordBatch.from_arrays([*batch.columns, *out], [*batch.schema.names, "lang_pred", "score", "rejected"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    found = map_text(docs, f"{schema}, lang_pred string, score double, rejected boolean", label)
    return found.withColumn("held_out", is_held_out(F.col("doc_id")))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs.select("doc_id", "text"), fitted(docs)).select("doc_id", "held_out", "lang_pred", "score", "rejected")
