"""Quality by perplexity under an interpolated modified Kneser-Ney model of character n-grams.

The model is trained on all trusted text (documents labelled quality 1). Characters are lower-cased,
white space is one space and digits are 0; n-grams of up to `ORDER` characters are counted everywhere. Counts and
the statistics that the model needs (continuation counts, numbers of followers, counts of counts
for the three discounts of each order) are aggregated and joined by n-gram and context, in shards; the
result is a table of probabilities of seen n-grams and weights of seen contexts. A document's perplexity is
that of all its characters. Documents above the `QUANTILE` of their language's trusted documents,
stretched by `SLACK`, are not kept.

The table is never held as a whole. A part of the documents (so many rows of a file by their place in it, whatever tasks read them and
however files are split) names its different n-grams and contexts, far fewer than its characters; these are dealt to shards by hash and looked up in the
model's shards, and what is found goes back to the shared folder, in a fixed number of files sorted by part. A second scan scores each
document in its part with the part's own small table, which it must find there. So memory follows the part, not the model, and no text is shuffled.

Defined results: null text and text without characters have no score and are not kept. A null
language is a language of its own. A language without trusted documents takes the threshold of all.
Without any trusted text nothing can be judged, and every document with text is kept.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.parquet
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.shipping import ship
from .common import file_system, maybe_in, shared_path, slices, staged, table, trimmed

ORDER, QUANTILE, SLACK = 5, 0.99, 1.05
#: Trusted ids up to which they are broadcast (8 bytes each; beyond, documents and ids are shuffled); n-grams that a part gathers before it names them.
IDS, GATHERED = 1_000_000, 1 << 19
#: Bytes of text that are named or scored at once: a character takes some ten numbers of eight bytes.
PIECE = 1 << 20
#: Bytes of text of a part, about; bytes of a row group of the files of parts, which a task reads whole.
PART_BYTES, GROUP_BYTES = 32 << 20, 1 << 20
_SPACE, _DIGIT = re.compile(r"\s+"), re.compile(r"[0-9]")
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Places of the direct table.
DIRECT = 1 << 21
_FLOOR = math.log(1 / 4096)


def characters(text: str | None) -> np.ndarray:
    """Codes of the normalised text behind ORDER - 1 marks of the start (code 1)."""
    plain = _DIGIT.sub("0", _SPACE.sub(" ", (text or "").lower()).strip())
    return np.frombuffer(("\x01" * (ORDER - 1) + plain).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


def hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of every run of n codes; the run of no code hashes to 0."""
    m = len(codes) - n + 1
    h = np.full(max(m, 0), n, np.uint64)
    for j in range(n):
        h = (h ^ codes[j : j + m]) * _MIX
        h ^= h >> np.uint64(29)
    return h if n else np.zeros(len(codes) + 1, np.uint64)


def _counted(docs: DataFrame) -> DataFrame:
    """(n, g, ctx, low, c): the n-grams of the documents; low is the n-gram without its first character; c counts the longest.

    Only the longest n-grams are counted and shuffled, as ORDER characters; the shorter ones are their ends.
    """

    def longest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts = [c for t in part.column("text").to_pylist() if len(c := characters(t)) >= ORDER]
                if not texts:
                    continue
                codes, real = _joined(texts)
                _, at, count = np.unique(hashes(codes, ORDER)[real], return_index=True, return_counts=True)
                at = np.flatnonzero(real)[at]
                runs = np.lib.stride_tricks.sliding_window_view(codes.astype("<u4"), ORDER)[at]
                raw = np.ascontiguousarray(runs).tobytes().decode("utf-32-le", "surrogatepass")
                grams_ = [raw[i : i + ORDER].encode("utf-8", "surrogatepass") for i in range(0, len(raw), ORDER)]
                yield pa.RecordBatch.from_arrays([pa.array(grams_, pa.binary()), pa.array(count)], ["w", "c"])

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [w.decode("utf-8", "surrogatepass") for w in batch.column("w").to_pylist()]
            if not words:
                continue
            codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
            at = np.arange(0, len(codes), ORDER)
            for n in range(ORDER, 0, -1):
                g, ctx, low = (hashes(codes, m).view(np.int64)[at + ORDER - n + d] for m, d in ((n, 0), (n - 1, 0), (n - 1, 1)))
                count = batch.column("c")
                if n < ORDER:
                    g, own = np.unique(g, return_index=True)
                    ctx, low, count = ctx[own], low[own], pa.array(np.ones(len(own), np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), n, np.int32)), pa.array(g), pa.array(ctx), pa.array(low), count], ["n", "g", "ctx", "low", "c"])

    counted = docs.select("text").mapInArrow(trimmed(longest), "w binary, c long").groupBy("w").agg(F.sum("c").alias("c"))
    counted = counted.mapInArrow(trimmed(ends), "n int, g long, ctx long, low long, c long")
    return counted.groupBy("n", "g").agg(F.first("ctx").alias("ctx"), F.first("low").alias("low"), F.sum("c").alias("c"))


def discounts(ones: int, twos: int, threes: int, fours: int) -> tuple[float, float, float]:
    """The three discounts of an order by its counts of counts."""
    if not ones or not twos:
        return 0.5, 0.75, 0.9
    y = ones / (ones + 2 * twos)
    each = (1 - 2 * y * twos / ones, 2 - 3 * y * threes / twos, 3 - 4 * y * fours / threes if threes else 2.0)
    return tuple(min(max(d, 0.05), k + 0.95) for k, d in enumerate(each))


def train(trusted: DataFrame) -> DataFrame:
    """(n, g, p, b): interpolated probability of each seen n-gram, and the weight that the next order's context g leaves for lower orders."""
    counts = staged(_counted(trusted), "counts")
    below = counts.groupBy((F.col("n") - 1).alias("n"), F.col("low").alias("g")).agg(F.count(F.lit(1)).alias("k"))  # characters before it
    adjusted = counts.join(below, ["n", "g"], "left").select("n", "g", "ctx", "low", F.when(F.col("n") == ORDER, F.col("c")).otherwise(F.coalesce("k", F.lit(1))).alias("a"))
    adjusted = staged(adjusted, "adjusted")
    seen = {(r["n"], r["a"]): r["m"] for r in adjusted.filter("a <= 4").groupBy("n", "a").agg(F.count(F.lit(1)).alias("m")).collect()}  # at most 4 rows an order
    cut = {n: discounts(*(seen.get((n, k), 0) for k in range(1, 5))) for n in range(1, ORDER + 1)}

    def of(k: int):
        return F.element_at(F.create_map(*[F.lit(x) for n, d in cut.items() for x in (n, d[k])]), F.col("n"))

    contexts = adjusted.groupBy("n", "ctx").agg(F.sum("a").alias("total"), F.count_if(F.col("a") == 1).alias("n1"), F.count_if(F.col("a") == 2).alias("n2"), F.count_if(F.col("a") > 2).alias("n3"))
    contexts = contexts.select("n", "ctx", "total", ((of(0) * F.col("n1") + of(1) * F.col("n2") + of(2) * F.col("n3")) / F.col("total")).alias("gamma"))
    contexts = staged(contexts, "contexts")
    less = F.when(F.col("a") == 1, of(0)).when(F.col("a") == 2, of(1)).otherwise(of(2))
    own = staged(adjusted.join(contexts, ["n", "ctx"]).select("n", "g", "low", (F.greatest(F.col("a") - less, F.lit(0.0)) / F.col("total")).alias("u"), "gamma"), "own")
    kinds = own.filter("n = 1").count()
    level = own.filter("n = 1").select("n", "g", (F.col("u") + F.col("gamma") / F.lit(float(kinds + 1))).alias("p"))
    levels = [level]
    for n in range(2, ORDER + 1):
        lower = level.select(F.col("g").alias("low"), F.col("p").alias("q"))
        level = staged(own.filter(F.col("n") == n).join(lower, "low").select("n", "g", (F.col("u") + F.col("gamma") * F.col("q")).alias("p")), f"order{n}")
        levels.append(level)
    every = levels[0]
    for level in levels[1:]:
        every = every.unionByName(level)
    weights = contexts.select((F.col("n") - 1).alias("n"), F.col("ctx").alias("g"), F.col("gamma").alias("b"))
    return staged(every.join(weights, ["n", "g"], "full"), "model")


def shard(g: np.ndarray, n: int) -> np.ndarray:
    """The shard of n-grams, as `model_shard` has it."""
    return (g.view(np.int64) >> 17) % n


def model_shard(n: int):
    return F.pmod(F.shiftright("g", 17), F.lit(n)).cast("int")


class Table:
    """A part's rows of the model as sorted arrays; scores texts. Hashes tell n-grams of all orders apart. places: room for DIRECT keys and values, used anew."""

    def __init__(self, g: np.ndarray, p: np.ndarray, b: np.ndarray, unknown: float, places: tuple[np.ndarray, np.ndarray]):
        order = np.argsort(g)
        self.g, self.unknown, self.key, self.value = g[order], unknown, *places
        self.p, self.b = (np.log(x[order].astype(np.float64)).astype(np.float32).astype(np.float64) for x in (p, b))  # as the direct table has them
        self.key[:] = 0
        self.key[0] = 1  # no hash that belongs to place 0
        fits = ~np.isnan(self.p)
        self.key[self.g[fits] & (DIRECT - 1)] = self.g[fits]
        self.value[self.g[fits] & (DIRECT - 1)] = self.p[fits]

    def look(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.g):
            return np.full(len(keys), np.nan), np.full(len(keys), np.nan)
        at = np.minimum(np.searchsorted(self.g, keys), len(self.g) - 1)
        hit = self.g[at] == keys
        return np.where(hit, self.p[at], np.nan), np.where(hit, self.b[at], np.nan)

    def log_probability(self, codes: np.ndarray) -> np.ndarray:
        """Natural log of the probability of each character; codes may hold several texts end to end, each behind its marks."""
        own = hashes(codes, ORDER).view(np.int64)
        at = own & (DIRECT - 1)
        logs = self.value[at].astype(np.float64)
        rest = np.flatnonzero(self.key[at] != own)
        if len(rest):
            logs[rest] = self._backed_off(codes, own[rest], rest)
        return logs

    def _backed_off(self, codes: np.ndarray, own: np.ndarray, where: np.ndarray) -> np.ndarray:
        known, first, which = np.unique(own, return_index=True, return_inverse=True)
        first = where[first]
        out, rest, left = np.full(len(known), np.nan), np.zeros(len(known)), np.arange(len(known))
        for n in range(ORDER, 0, -1):
            at = first[left] + ORDER - n
            p, _ = self.look(hashes(codes, n).view(np.int64)[at])
            hit = ~np.isnan(p)
            out[left[hit]] = p[hit] + rest[left[hit]]
            left, at = left[~hit], at[~hit]
            if not len(left):
                break
            _, b = self.look(hashes(codes, n - 1).view(np.int64)[at])
            rest[left] += np.where(np.isnan(b), 0.0, b)
        out[left] = self.unknown + rest[left]
        return out[which]


def unknown_character(model: DataFrame) -> float:
    kinds = model.filter("n = 1 AND p IS NOT NULL").count()
    return math.log(1.0 / (kinds + 1)) if kinds else _FLOOR


def parted(docs: DataFrame) -> DataFrame:
    """docs with _part, named by file and place of the row in it: some PART_BYTES of text. Rows that come from no file are written first."""

    def placed(df: DataFrame) -> DataFrame:
        at = df.metadataColumn("_metadata")
        return df.withColumns({"_file": at["file_path"], "_row": at["row_index"]})

    try:
        found = placed(docs)
        if not found.filter("_file IS NULL OR _row IS NULL").limit(1).isEmpty():
            raise ValueError
    except (AnalysisException, ValueError):  # rows of several sources, or of none
        found = placed(staged(docs, "docs"))
    mean = docs.agg(F.avg(F.coalesce(F.octet_length("text"), F.lit(0)))).first()[0] or 0
    rows = max(1, int(PART_BYTES / max(mean, 64)))
    return found.withColumn("_part", F.xxhash64("_file", F.floor(F.col("_row") / rows))).drop("_file", "_row")


def _joined(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of texts end to end, and for each run of ORDER codes whether it ends in a character and not in a later text's marks."""
    codes = np.concatenate(texts)
    real = np.ones(len(codes) - ORDER + 1, bool)
    for end in np.cumsum([len(c) for c in texts])[:-1]:
        real[end - ORDER + 1 : end] = False
    return codes, real


def _named(docs: DataFrame, shards: int) -> DataFrame:
    """(r, _part, blob): for each part and shard the hashes of the n-grams and contexts that its texts hold."""

    def every(windows: np.ndarray) -> np.ndarray:
        """The n-grams and contexts within runs of ORDER codes, one run a row."""
        flat, at = np.ascontiguousarray(windows).reshape(-1).astype(np.uint64), np.arange(len(windows)) * ORDER
        own = [hashes(flat, n)[at + ORDER - n] for n in range(1, ORDER + 1)] + [hashes(flat, n - 1)[at + ORDER - n] for n in range(1, ORDER + 1)]
        return np.unique(np.concatenate(own))

    def out(part: int | None, windows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if not windows:  # a part without characters is known too
            if part is not None:
                yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([part]), pa.array([b""], pa.binary())], ["r", "_part", "blob"])
            return
        keys = every(np.concatenate(windows))
        to = shard(keys, shards)
        order = np.argsort(to, kind="stable")
        cuts = np.searchsorted(to[order], np.arange(shards + 1))
        some = np.flatnonzero(np.diff(cuts))
        blobs = [keys[order[cuts[r] : cuts[r + 1]]].tobytes() for r in some]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(np.full(len(some), part)), pa.array(blobs, pa.binary())], ["r", "_part", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seen, windows, held = None, np.zeros(DIRECT, np.uint64), [], 0
        for batch in batches:
            for piece in slices(batch, "text", PIECE):
                for part, own in _by_part(piece):
                    if part != now or held > GATHERED:
                        yield from out(now, windows)
                        now, windows, held = part, [], 0
                        seen[:] = 0
                        seen[0] = 1  # no hash that belongs to place 0
                    texts = [c for t in own.column("text").to_pylist() if len(c := characters(t)) >= ORDER]
                    if not texts:
                        continue
                    codes, real = _joined(texts)
                    h = hashes(codes, ORDER)
                    place = h & np.uint64(DIRECT - 1)
                    new = np.flatnonzero(real & (seen[place] != h))
                    _, first = np.unique(h[new], return_index=True)
                    at = new[first]
                    seen[place[at]] = h[at]
                    windows.append(np.lib.stride_tricks.sliding_window_view(codes.astype("<u4"), ORDER)[at])
                    held += len(at)
        yield from out(now, windows)

    return docs.select("_part", "text").mapInArrow(trimmed(run), "r int, _part long, blob binary")


def _by_part(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    parts = batch.column("_part").to_numpy()
    cuts = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(parts)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield int(parts[a]), batch.slice(a, b - a)


def _looked_up(model: DataFrame, named: DataFrame, shards: int) -> DataFrame:
    """(_part, blob): what the model's shards know of the n-grams that the parts name: hashes, probabilities, weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, known = [], None
        for batch in batches:
            own = batch.filter(pc.is_null(batch.column("blob")))
            if own.num_rows:  # the model's rows come before the parts'
                rows.append([own.column(c).to_numpy(zero_copy_only=False) for c in ("g", "p", "b")])
            asked = batch.filter(pc.is_valid(batch.column("blob")))
            if not asked.num_rows:
                continue
            if known is None:
                g, p, b = (np.concatenate(x) for x in zip(*rows)) if rows else (np.empty(0, np.int64), np.empty(0), np.empty(0))
                order = np.argsort(g)
                known = [x[order] for x in (g, p.astype("<f4"), b.astype("<f4"))]
            out = []
            for blob in asked.column("blob"):
                keys = np.frombuffer(blob.as_buffer(), "<i8")
                at = np.empty(0, np.int64)
                if len(known[0]):
                    at = np.minimum(np.searchsorted(known[0], keys), len(known[0]) - 1)
                    at = at[known[0][at] == keys]
                out.append(b"".join(x[at].tobytes() for x in known))
            yield pa.RecordBatch.from_arrays([asked.column("_part"), pa.array(out, pa.binary())], ["_part", "blob"])

    own = model.select(model_shard(shards).alias("r"), F.lit(None).cast("long").alias("_part"), F.lit(None).cast("binary").alias("blob"), "g", "p", "b")
    asked = named.select("r", "_part", "blob", *(F.lit(None).cast(k).alias(c) for c, k in (("g", "long"), ("p", "double"), ("b", "double"))))
    dealt = own.unionByName(asked).repartitionById(shards, F.col("r")).sortWithinPartitions(F.col("_part").asc_nulls_first())
    return dealt.mapInArrow(trimmed(run), "_part long, blob binary")


def scored(docs: DataFrame, model: DataFrame) -> DataFrame:
    """docs without text, with n_characters and log_p (natural log of the probability of all its characters)."""
    spark = docs.sparkSession
    shards = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    docs, unknown = parted(docs), unknown_character(model)
    path = shared_path(spark, "parts")
    found = _looked_up(model, _named(docs, shards), shards).withColumn("_file", F.pmod("_part", F.lit(shards)).cast("int"))
    found.repartition(shards, "_file").sortWithinPartitions("_file", "_part").write.partitionBy("_file").option("parquet.block.size", GROUP_BYTES).parquet(path)

    def table_of(part: int, places: tuple[np.ndarray, np.ndarray]) -> Table:
        fs, base = file_system(path)
        found = fs.get_file_info(pyarrow.fs.FileSelector(f"{base}/_file={part % shards}", allow_not_found=True))
        blobs = [bytes(x.as_buffer()) for f in found if f.path.endswith(".parquet") for x in _blobs(fs, f.path, part)]
        if not blobs:
            raise RuntimeError(f"part {part} was not named; the documents have changed between two scans")
        cols = [[], [], []]
        for blob in blobs:
            n = len(blob) // 16
            for into, kind, at in zip(cols, ("<i8", "<f4", "<f4"), (0, 8 * n, 12 * n)):
                into.append(np.frombuffer(blob, kind, n, at))
        return Table(*(np.concatenate(c) for c in cols), unknown, places)

    names = [f.name for f in docs.schema.fields if f.name not in ("text", "_part")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, table_, places = None, None, (np.zeros(DIRECT, np.int64), np.zeros(DIRECT, np.float32))
        for batch in batches:
            for piece in slices(batch, "text", PIECE):
                for part, own in _by_part(piece):
                    if part != now:
                        now, table_ = part, table_of(part, places)
                    codes = [characters(t) for t in own.column("text").to_pylist()]
                    every = np.concatenate(codes)
                    logs = table_.log_probability(every) if len(every) >= ORDER else np.empty(0)
                    ends = np.cumsum([len(c) for c in codes])
                    size = np.array([max(0, len(c) - ORDER + 1) for c in codes])
                    stop = np.maximum(ends - ORDER + 1, 0)
                    total = np.array([logs[b - n : b].sum() if n else 0.0 for b, n in zip(stop.tolist(), size.tolist())])  # alike, whatever texts stand before
                    yield pa.RecordBatch.from_arrays([*(own.column(c) for c in names), pa.array(size, pa.int64()), pa.array(total)], [*names, "n_characters", "log_p"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in names)
    return docs.mapInArrow(trimmed(run), f"{kept}, n_characters long, log_p double")


def _blobs(fs: pyarrow.fs.FileSystem, path: str, part: int) -> Iterator[pa.Scalar]:
    """The blobs of a part, from the row groups that may hold it."""
    with fs.open_input_file(path) as f:
        file = pyarrow.parquet.ParquetFile(f)
        for k in range(file.metadata.num_row_groups):
            held = file.metadata.row_group(k).column(file.schema_arrow.get_field_index("_part")).statistics
            if held is None or not held.has_min_max or held.min <= part <= held.max:
                rows = file.read_row_group(k, use_threads=False)
                yield from rows["blob"].filter(pc.equal(rows["_part"], part))


def judge(docs: DataFrame, trusted_ids: DataFrame) -> DataFrame:
    """doc_id, lang, n_characters, perplexity, threshold, keep. trusted_ids: doc_id of the trusted documents."""
    ship(docs.sparkSession)
    trusted_ids = staged(trusted_ids.select("doc_id").distinct(), "trusted")
    docs = docs.select("doc_id", "lang", "text")
    if trusted_ids.count() <= IDS:
        trusted = docs.join(F.broadcast(trusted_ids), "doc_id", "left_semi")
    else:
        trusted = maybe_in(docs, "doc_id", trusted_ids, "doc_id").join(trusted_ids, "doc_id", "left_semi")
    judged = scored(docs, train(trusted))
    perplexity = F.when(F.col("n_characters") > 0, F.exp(-F.col("log_p") / F.col("n_characters")))
    judged = staged(judged.select("doc_id", "lang", "n_characters", perplexity.alias("perplexity")), "scores")
    base = judged.filter("perplexity IS NOT NULL").join(trusted_ids, "doc_id", "left_semi")
    edge = (F.percentile_approx("perplexity", QUANTILE, 10_000) * SLACK).alias("threshold")
    by_lang = base.groupBy("lang").agg(edge).select(F.col("lang").alias("_lang"), "threshold")
    overall = base.agg(edge).first()[0]
    out = judged.join(by_lang, F.col("lang").eqNullSafe(F.col("_lang")), "left").drop("_lang")
    out = out.withColumn("threshold", F.coalesce("threshold", F.lit(overall).cast("double")))
    return out.withColumn("keep", F.coalesce(F.col("perplexity").isNotNull() & (F.col("threshold").isNull() | (F.col("perplexity") <= F.col("threshold"))), F.lit(False)))


def op4_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return judge(table(spark, sf_dir, "documents"), trusted)
