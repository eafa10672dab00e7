"""Near-duplicate signatures and set similarities."""

from __future__ import annotations

import hashlib
import itertools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import spread, table

BITS, NEAR = 64, 3
#: Blocks of a fingerprint's bits, first bit and width. What differs in NEAR bits at most agrees in three of the six.
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))


def tokens(text: Column) -> Column:
    """Different words between Unicode white space, lower-cased."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda t: t != ""))


def word_hash(word: Column) -> Column:
    """The first eight bytes of the MD5 digest, little-endian, as a signed long."""
    hex_ = F.md5(word.cast("binary"))
    turned = F.concat(*[F.substring(hex_, 2 * i + 1, 2) for i in range(7, -1, -1)])
    return F.conv(turned, 16, -10).cast("long")


def simhash(docs: DataFrame) -> DataFrame:
    """doc_id, simhash: a bit is set where more of the document's words have it than not. Votes are sums, combined before the shuffle."""
    words = spread(docs.select("doc_id", "text")).select("doc_id", F.explode(tokens(F.col("text"))).alias("w")).select("doc_id", word_hash(F.col("w")).alias("h"))
    votes = [F.sum(F.when(F.col("h").bitwiseAND(F.lit(1 << i if i < 63 else -(1 << 63))) != 0, 1).otherwise(-1)).alias(f"v{i}") for i in range(BITS)]
    sums = words.groupBy("doc_id").agg(*votes)
    out = F.lit(0).cast("long")
    for i in range(BITS):
        out = out.bitwiseOR(F.when(F.col(f"v{i}") > 0, F.lit(1 << i if i < 63 else -(1 << 63))).otherwise(0).cast("long"))
    return sums.select("doc_id", out.alias("simhash"))


def q_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash(table(spark, sf_dir, "documents"))


def q_simhash_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of different fingerprints within NEAR bits, with the documents of each: copies are classes, not pairs.

    A fingerprint is dealt once for each choice of three of its six blocks, by their 31 to 33 bits: a key that long is shared by few
    fingerprints that aren't alike, at any number of documents.
    """
    classes = simhash(table(spark, sf_dir, "documents")).groupBy("simhash").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("docs"))
    def masked(blocks: tuple[tuple[int, int], ...]) -> int:
        bits = sum(((1 << width) - 1) << at for at, width in blocks)
        return bits - (1 << 64) if bits >> 63 else bits

    keys = [F.col("simhash").bitwiseAND(F.lit(masked(blocks)).cast("long")) for blocks in itertools.combinations(BLOCKS, len(BLOCKS) - NEAR)]
    bands = classes.select("simhash", "rep", "docs", F.posexplode(F.array(*keys)).alias("band", "key"))
    a, b = bands.alias("a"), bands.alias("b")
    close = F.bit_count(F.col("a.simhash").bitwiseXOR(F.col("b.simhash")))
    found = a.join(b, ["band", "key"]).filter(F.col("a.rep") < F.col("b.rep")).select(F.col("a.rep").alias("rep_a"), F.col("b.rep").alias("rep_b"), F.col("a.docs").alias("docs_a"), F.col("b.docs").alias("docs_b"), close.cast("int").alias("bits"))
    return found.filter(F.col("bits") <= NEAR).distinct()


def q_i_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of the sorted different words without stop words, and the class of documents that share it."""
    stop = F.array(*[F.lit(w) for w in ("the", "of", "and", "de", "la", "le")])
    print_ = F.array_join(F.array_sort(F.array_except(tokens(F.col("text")), stop)), " ")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.md5(print_.cast("binary")).alias("fingerprint"))
    return docs.groupBy("fingerprint").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("docs"))


#: Multipliers and offsets of the slots' hashes modulo the prime.
PRIME = (1 << 31) - 1


def slot(i: int) -> tuple[int, int]:
    mix = lambda x: int.from_bytes(hashlib.md5(x.encode()).digest()[:4], "little") % (PRIME - 1)
    return 1 + mix(f"a{i}"), mix(f"b{i}")


def minhash(docs: DataFrame, slots: int = 64, k: int = 3) -> DataFrame:
    """doc_id, signature: the least hash of the lower-cased character shingles in each slot; documents without shingles have zeros.

    One strong hash a shingle (32 bits of MD5); the slots are linear functions of it modulo a prime.
    """
    t = F.lower(F.col("text"))
    ahead = F.when(F.length(t) >= k, F.regexp_extract_all(t, F.lit("(?s)(?=(%s))." % ("." * k)), F.lit(1))).when(F.length(t) > 0, F.array(t)).otherwise(F.array().cast("array<string>"))
    shingles = spread(docs.select("doc_id", "text")).select("doc_id", F.explode_outer(F.array_distinct(ahead)).alias("s")).select("doc_id", F.conv(F.substring(F.md5(F.col("s").cast("binary")), 1, 8), 16, 10).cast("long").alias("h"))
    least = [F.coalesce(F.min((F.col("h") % PRIME * slot(i)[0] + slot(i)[1]) % PRIME), F.lit(0)).alias(f"m{i}") for i in range(slots)]
    return shingles.groupBy("doc_id").agg(*least).select("doc_id", F.array(*[F.col(f"m{i}") for i in range(slots)]).alias("signature"))


def q_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash(table(spark, sf_dir, "documents")).select("doc_id", F.size("signature").alias("slots"), F.array_join(F.col("signature").cast("array<string>"), ",").alias("signature"))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def bigrams(text: Column, n: int = 2) -> Column:
    chars = F.split(text, "")
    several = F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, F.lit(n)))
    return F.array_distinct(F.when(F.length(text) >= n, several).otherwise(F.array().cast("array<string>")))


def dice(a: Column, b: Column) -> Column:
    """Of bigram sets; 1 for two empty texts, 0 for single characters."""
    x, y = bigrams(a), bigrams(b)
    total = F.size(x) + F.size(y)
    return F.when((F.length(a) == 0) & (F.length(b) == 0), 1.0).when(total > 0, 2 * F.size(F.array_intersect(x, y)) / total).otherwise(0.0)


def overlap(a: Column, b: Column) -> Column:
    """n-gram overlap; a short text is its own gram, an empty one overlaps with nothing."""
    gram = lambda t: F.when(F.length(t) >= 2, bigrams(t)).when(F.length(t) > 0, F.array(t)).otherwise(F.array().cast("array<string>"))
    x, y = gram(a), gram(b)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def hamming(a: Column, b: Column) -> Column:
    """Places that differ; null for texts of unequal length."""
    same = F.zip_with(F.split(a, ""), F.split(b, ""), lambda p, q: (p != q).cast("int"))
    return F.when(F.length(a) == F.length(b), F.aggregate(same, F.lit(0), lambda s, x: s + x))


def q_similarities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set similarities of every passage with the next one."""
    b = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("t"))
    pairs = b.alias("a").join(b.select((F.col("item_id") - 1).alias("item_id"), F.col("t").alias("u")).alias("b"), "item_id")
    words = lambda c: F.array_distinct(F.split(F.lower(F.col(c)), " "))
    return pairs.select("item_id", F.round(jaccard(words("t"), words("u")), 6).alias("jaccard"), F.round(dice(F.col("t"), F.col("u")), 6).alias("dice"), F.round(overlap(F.col("t"), F.col("u")), 6).alias("overlap"), hamming(F.col("t"), F.col("u")).alias("hamming"))


def q_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of term-frequency vectors of neighbouring passages; 0 where one is empty."""
    words = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.split(F.lower("text"), r"\s+")).alias("w")).groupBy("item_id", "w").agg(F.count(F.lit(1)).cast("double").alias("c"))
    norms = words.groupBy("item_id").agg(F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("norm"))
    b = words.select((F.col("item_id") - 1).alias("item_id"), "w", F.col("c").alias("d"))
    dots = words.join(b, ["item_id", "w"]).groupBy("item_id").agg(F.sum(F.col("c") * F.col("d")).alias("dot"))
    after = norms.select((F.col("item_id") - 1).alias("item_id"), F.col("norm").alias("norm2"))
    return norms.join(after, "item_id").join(dots, "item_id", "left").select("item_id", F.round(F.coalesce(F.col("dot") / (F.col("norm") * F.col("norm2")), F.lit(0.0)), 6).alias("cosine"))


_SETS = "s AS (SELECT item_id, text AS t FROM benchmark), p AS (SELECT a.item_id, a.t, b.t AS u FROM s a JOIN s b ON b.item_id = a.item_id + 1)"
_BI = "list_distinct(list_transform(range(1, length({0})), lambda i: substring({0}, i, 2)))"
_WORDS = r"list_distinct(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> ''))"

SIM_SQL = f"""w AS (SELECT doc_id, unnest({_WORDS}) AS w FROM documents), h AS (SELECT doc_id, ('0x' || array_to_string(list_transform([15, 13, 11, 9, 7, 5, 3, 1], lambda i: substring(md5(w), i, 2)), ''))::UBIGINT AS h FROM w),
v AS (SELECT doc_id, i, sum(CASE WHEN (h >> i) & 1 = 1 THEN 1 ELSE -1 END) AS votes FROM h, range(0, 64) t(i) GROUP BY ALL),
sim AS (SELECT doc_id, CAST(CASE WHEN s >= 9223372036854775808::HUGEINT THEN s - 18446744073709551616::HUGEINT ELSE s END AS BIGINT) AS simhash FROM (SELECT doc_id, sum(CASE WHEN votes > 0 THEN 1::HUGEINT << i::INT ELSE 0 END) AS s FROM v GROUP BY 1))"""
_SLOTS = ", ".join("min((h % {0} * {1} + {2}) % {0})".format(PRIME, *slot(i)) for i in range(64))
QUERIES = {"q09_simhash": q_simhash, "j05_simhash_near_classes": q_simhash_classes, "q11_i_match": q_i_match, "q08_minhash": q_minhash, "c05_c07_similarities": q_similarities, "c08_cosine": q_cosine}
ORACLES = {
    "q09_simhash": f"WITH {SIM_SQL} SELECT * FROM sim",
    "j05_simhash_near_classes": f"WITH {SIM_SQL}, c AS (SELECT simhash, min(doc_id) AS rep, count(*) AS docs FROM sim GROUP BY 1) SELECT a.rep AS rep_a, b.rep AS rep_b, a.docs AS docs_a, b.docs AS docs_b, CAST(bit_count(xor(a.simhash, b.simhash)) AS INTEGER) AS bits FROM c a JOIN c b ON a.rep < b.rep AND bit_count(xor(a.simhash, b.simhash)) <= 3",
    "q08_minhash": f"""WITH t AS (SELECT doc_id, lower(text) AS t FROM documents WHERE length(text) > 0), s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN length(t) >= 3 THEN list_transform(range(1, length(t) - 1), lambda i: c[i] || c[i+1] || c[i+2]) ELSE [t] END) AS s FROM (SELECT *, string_split(t, '') AS c FROM t)),
h AS (SELECT doc_id, ('0x' || left(md5(s), 8))::BIGINT AS h FROM s), m AS (SELECT doc_id, [{_SLOTS}] AS m FROM h GROUP BY 1) SELECT doc_id, 64 AS slots, coalesce(array_to_string(m, ','), array_to_string(list_transform(range(0, 64), lambda i: 0), ',')) AS signature FROM documents LEFT JOIN m USING (doc_id)""",
    "q11_i_match": f"""WITH f AS (SELECT doc_id, md5(array_to_string(list_sort(list_filter({_WORDS}, lambda w: w NOT IN ('the', 'of', 'and', 'de', 'la', 'le'))), ' ')) AS fingerprint FROM documents)
SELECT fingerprint, min(doc_id) AS rep, count(*) AS docs FROM f GROUP BY fingerprint""",
    "c05_c07_similarities": f"""WITH {_SETS}, w AS (SELECT *, list_distinct(string_split(lower(t), ' ')) AS a, list_distinct(string_split(lower(u), ' ')) AS b, {_BI.format("t")} AS x, {_BI.format("u")} AS y FROM p)
SELECT item_id, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS jaccard, round(2 * len(list_intersect(x, y)) / (len(x) + len(y)), 6) AS dice, round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 6) AS overlap,
CAST(CASE WHEN length(t) = length(u) THEN len(list_filter(range(1, length(t) + 1), lambda i: t[i] <> u[i])) END AS INTEGER) AS hamming FROM w""",
    "c08_cosine": r"""WITH w AS (SELECT item_id, w, CAST(count(*) AS DOUBLE) AS c FROM (SELECT item_id, unnest(regexp_split_to_array(lower(text), '\s+')) AS w FROM benchmark) GROUP BY ALL), n AS (SELECT item_id, sqrt(sum(c * c)) AS norm FROM w GROUP BY 1),
d AS (SELECT a.item_id, sum(a.c * b.c) AS dot FROM w a JOIN w b ON b.item_id = a.item_id + 1 AND a.w = b.w GROUP BY 1) SELECT a.item_id, round(coalesce(dot / (a.norm * b.norm), 0), 6) AS cosine FROM n a JOIN n b ON b.item_id = a.item_id + 1 LEFT JOIN d ON d.item_id = a.item_id""",
}
