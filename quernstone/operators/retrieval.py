"""Full-text retrieval: character n-grams, inverted index, BM25, fuzzy expansion, query performance, feedback.

The index is four tables: postings (term, doc_id, tf), term statistics (term, df, cf), document lengths and one
row of corpus statistics. Queries are a table (qid, text) as well, so that any number of them is
one job. N is the largest doc_id plus one, whatever ids are missing, and lengths count pruned terms too.

Statistics never group by document: a text gives its n-grams once for cf and its different ones once for df, and both are
combined by term before the shuffle. Scoring goes through `scoring` as long as the queries have at most
`scoring.HELD` rows, and through joins beyond.
"""

from __future__ import annotations

import math
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..plans.staging import cut
from ..sources.tables import spread, table
from . import scoring

K1, B, STOP, TOP = 1.2, 0.75, 0.5, 10
GRAM, CJK_GRAM = 3, 2
#: Expansions of a query token at most; letters of it that an expansion must share at its start.
EXPANSIONS, PREFIX = 50, 1

# The ranges of CJK characters that choose the size of n-grams.
CJK = r"[\x{1100}-\x{11FF}\x{3040}-\x{30FF}\x{31C0}-\x{31EF}\x{3200}-\x{32FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{A960}-\x{A97F}\x{AC00}-\x{D7FF}\x{F900}-\x{FAFF}\x{20000}-\x{2EE5F}\x{2F800}-\x{2FA1F}\x{30000}-\x{323AF}]"
#: A character that compatibility composition may change; ASCII and most Latin letters stay.
_UNSTABLE = r"[^\x00-\x7F¡-§©«-®°±¶·»¿-ıĴ-ľŁ-ňŊ-žƀ-ǃǍ-ǰǴ-ɏ]"


def composed(text: Column) -> Column:
    """NFKC; only texts that it may change are sent to Python."""

    def compose(part: pd.Series) -> pd.Series:
        return part.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")

    return F.coalesce(F.pandas_udf(compose, StringType())(F.when(text.rlike(_UNSTABLE), text)), text)


def normal(text: Column) -> Column:
    return F.regexp_replace(composed(F.lower(text)), r"^\s+|\s+$", "")


def gram_size(text: Column) -> Column:
    """2 where CJK characters are more than three tenths (rounded down) of the text, else 3."""
    many = F.regexp_count(text, F.lit(CJK)) > F.floor(F.length(text) * 3 / 10)
    return F.when(text.rlike(CJK), F.when(many, CJK_GRAM).otherwise(GRAM)).otherwise(GRAM)


def grams(text: Column, n: int | Column | None = None) -> Column:
    """Overlapping character n-grams in order; a shorter text is one gram, an empty one has none. n: None chooses by text."""
    if n is None or isinstance(n, Column):
        n = gram_size(text) if n is None else n
        return F.when(n == CJK_GRAM, grams(text, CJK_GRAM)).otherwise(grams(text, GRAM))
    ahead = F.regexp_extract_all(text, F.lit("(?s)(?=(%s))." % ("." * n)), F.lit(1))  # a match at every place, one character long
    return F.when(F.length(text) >= n, ahead).when(F.length(text) > 0, F.array(text)).otherwise(F.array().cast("array<string>"))


def prepared(docs: DataFrame) -> DataFrame:
    """doc_id, t (normalised text), n (size of its n-grams)."""
    return docs.select("doc_id", normal(F.col("text")).alias("t")).withColumn("n", gram_size(F.col("t")))


def postings(docs: DataFrame) -> DataFrame:
    """term, doc_id, tf: counts are combined before the shuffle."""
    tokens = prepared(docs).select("doc_id", F.explode(grams(F.col("t"), F.col("n"))).alias("term"))
    return tokens.groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("tf"))


def term_counts(docs: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """term, df, cf, of all terms or of those wanted, without grouping by document: tasks add up their terms before the shuffle."""
    found = scoring.counts(docs.filter("text IS NOT NULL")).filter("code >= 0").select(scoring.spelt(F.col("code")).alias("term"), "df", "cf")
    return found if wanted is None else found.join(wanted, "term", "left_semi")


def doc_lengths(docs: DataFrame) -> DataFrame:
    length, n = F.length("t"), F.col("n")
    return prepared(docs).select("doc_id", F.when(length >= n, length - n + 1).when(length > 0, 1).otherwise(0).cast("long").alias("dl"))


def corpus_stats(lengths: DataFrame, dense: bool = False) -> DataFrame:
    return lengths.agg((F.count("doc_id") if dense else F.max("doc_id") + 1).alias("n"), F.avg("dl").alias("avgdl"), F.sum("dl").alias("total"))


def term_stats(posts: DataFrame) -> DataFrame:
    return posts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def kept_terms(terms: DataFrame, stats: DataFrame, threshold: float = STOP) -> DataFrame:
    """Terms that aren't stop n-grams: not in more than threshold of N documents (0: no bound), not of punctuation alone."""
    joined = terms.crossJoin(F.broadcast(stats.select("n")))  # one row
    few = F.lit(True) if threshold <= 0 else F.col("df") <= F.col("n") * F.lit(threshold)
    return joined.filter(few & ~F.col("term").rlike(r"\A\p{P}+\z")).drop("n")


def without_stops(found: dict[str, tuple[int, int]], n: int) -> dict[str, tuple[int, int]]:
    """As kept_terms: {term: (df, cf)} without stop n-grams."""
    return {t: x for t, x in found.items() if (STOP <= 0 or x[0] <= n * STOP) and not all(unicodedata.category(c)[0] == "P" for c in t)}


def idf(n: Column, df: Column) -> Column:
    return F.log1p((n - df + F.lit(0.5)) / (df + F.lit(0.5)))


def queries_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The passages of the benchmark, each a query."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")


def query_terms(queries: DataFrame) -> DataFrame:
    """qid, term, qtf."""
    q = queries.select("qid", normal(F.col("text")).alias("t"))
    return q.select("qid", F.explode(grams(F.col("t"))).alias("term")).groupBy("qid", "term").agg(F.count(F.lit(1)).alias("qtf"))


class Index:
    """The tables of an index over docs (doc_id, text)."""

    def __init__(self, docs: DataFrame, dense: bool = False):
        """dense: N is the number of documents, for ids that are no count."""
        docs = spread(docs.select("doc_id", "text").filter("text IS NOT NULL AND doc_id IS NOT NULL"))
        self.docs, self.lengths, self.dense = docs, doc_lengths(docs), dense
        self.stats, self.postings = corpus_stats(self.lengths, dense), postings(docs)
        self._counted = None

    def terms(self, wanted: DataFrame | None = None) -> DataFrame:
        """term, df, cf of the terms in the index (of those wanted, if given): stop n-grams are not."""
        if wanted is None:
            kept = self.counted().filter("code >= 0").select(scoring.spelt(F.col("code")).alias("term"), "df", "cf")
            return kept_terms(kept, self.totals())
        names = [r["term"] for r in wanted.select("term").limit(scoring.HELD + 1).collect()]
        if len(names) <= scoring.HELD:
            rows = [(t, *x) for t, x in self.known(names)[0].items()]
            return wanted.sparkSession.createDataFrame(rows, "term string, df long, cf long")
        return kept_terms(term_counts(self.docs, wanted), self.stats)

    def counted(self) -> DataFrame:
        """Codes, df and cf of all terms, from one pass over the texts that is done once."""
        if self._counted is None:
            self._counted = cut(scoring.counts(self.docs))
        return self._counted

    def totals(self) -> DataFrame:
        """As `stats`, from what was counted with the terms."""
        all_ = self.counted().filter("code = -1")
        return all_.select((F.col("df") if self.dense else F.col("last") + 1).alias("n"), (F.col("cf") / F.col("df")).alias("avgdl"), F.col("cf").alias("total"))

    def known(self, names: list[str]) -> tuple[dict[str, tuple[int, int]], int, float]:
        """({term: (df, cf)} of those of the terms that are in the index, N, average length)."""
        found, docs, last, total = scoring.statistics(self.docs, names)
        n = docs if self.dense else last + 1
        return without_stops(found, n), n, total / max(docs, 1)

    def matching(self, q: DataFrame) -> DataFrame:
        """q (qid, term, ...) with doc_id, tf, df, cf: the few query terms reach the tokens before they are counted."""
        wanted = q.select("term").distinct()
        tokens = prepared(self.docs).select("doc_id", F.explode(grams(F.col("t"), F.col("n"))).alias("term")).join(wanted, "term", "left_semi")
        posts = tokens.groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("tf"))
        kept = kept_terms(term_stats(posts), self.stats)
        return q.join(self.weighed(posts.join(kept, "term")), "term")

    def blocks(self, q: DataFrame, weight: str, share: float | None = None, expanded: DataFrame | None = None) -> tuple[list[scoring.Block], float] | None:
        """The queries as matrices, and the average length; None if they are too many to send. expanded: (term, expansion)."""
        asked = q.select("qid", "term", F.col(weight).cast("double").alias("w")).limit(scoring.HELD + 1).collect()
        stands = {}
        if expanded is not None:
            rows = expanded.join(q.select("term").distinct(), "term", "left_semi").limit(scoring.HELD + 1).collect()
            for r in rows:
                stands.setdefault(r["term"], []).append(r["expansion"])
            asked = asked if len(rows) <= scoring.HELD else [None] * (scoring.HELD + 1)
        if len(asked) > scoring.HELD or sum(len(stands.get(r["term"], ())) for r in asked) > 32 * scoring.HELD:
            return None
        names = {r["term"] for r in asked} if expanded is None else {e for r in asked for e in stands.get(r["term"], ())}
        known, n, average = self.known(sorted(names))
        weigh = {t: math.log1p((n - df + 0.5) / (df + 0.5)) for t, (df, _) in known.items()}
        code = {t: scoring.packed(t) for t in known}
        weights, groups, size = {}, {}, {}
        for r in asked:
            q_, t = r["qid"], r["term"]
            size[q_] = size.get(q_, 0) + 1
            own = [t] if expanded is None else stands.get(t, [])
            own = [x for x in own if x in known]
            groups.setdefault(q_, []).append([code[x] for x in own])
            for x in own:
                weights.setdefault(q_, {})[code[x]] = r["w"] if expanded is None else 1.0
        need = None if share is None else {q_: max(1, math.ceil(k * share)) for q_, k in size.items()}
        idf_ = {code[t]: x for t, x in weigh.items()}
        return scoring.blocks(weights, idf_, None if expanded is None else groups, need), average

    def best(self, q: DataFrame, k: int = TOP, weight: str = "qtf", share: float | None = None, expanded: DataFrame | None = None) -> DataFrame:
        """qid, rank, doc_id, score of each query's best documents; share: of its different terms that a document must hold."""
        ready = self.blocks(q, weight, share, expanded)
        if ready is not None:
            if not ready[0]:
                return q.sparkSession.createDataFrame([], "qid long, rank int, doc_id long, score double")
            return top(scoring.best(self.docs, *ready, k, K1, B), k)
        if expanded is None:
            scores = self.scored(self.matching(q), weight)
            return top(scores if share is None else enough(scores, q, share), k)
        stands = q.select("qid", F.col("term").alias("token")).join(expanded.select(F.col("term").alias("token"), F.col("expansion").alias("term")), "token")
        hits = self.matching(stands)
        have = hits.groupBy("qid", "doc_id").agg(F.count_distinct("token").alias("have"))
        scores = hits.dropDuplicates(["qid", "term", "doc_id"]).groupBy("qid", "doc_id").agg(F.sum("part").alias("score")).join(have, ["qid", "doc_id"])
        return top(scores if share is None else enough(scores, q, share), k)

    def repeated(self) -> bool:
        """Whether several rows share a doc_id: these are one document to what groups by it."""
        return not self.docs.groupBy("doc_id").count().filter("count > 1").isEmpty()

    def all_scores(self, q: DataFrame) -> DataFrame:
        """qid, doc_id, score of every document with a term of the query: where the documents lie, if the queries can be sent there."""
        ready = None if self.repeated() else self.blocks(q, "qtf")
        if ready is None:
            return self.scored(self.matching(q)).select("qid", "doc_id", "score")
        return scoring.every(self.docs, *ready, K1, B)

    def weighed(self, posts: DataFrame) -> DataFrame:
        """Postings with what one query occurrence of the term adds to the document's score: computed once for all queries."""
        rows = posts.join(self.lengths, "doc_id").crossJoin(F.broadcast(self.stats))
        tf = F.col("tf").cast("double")
        part = idf(F.col("n"), F.col("df")) * tf * F.lit(K1 + 1) / (tf + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("dl") / F.col("avgdl")))
        return rows.select("term", "doc_id", "tf", "df", "cf", part.alias("part"))

    def scored(self, hits: DataFrame, weight: str = "qtf") -> DataFrame:
        """qid, doc_id, score, have (different terms) over hits (qid, doc_id, part, weight), in one pass."""
        return hits.groupBy("qid", "doc_id").agg(F.sum(F.col(weight) * F.col("part")).alias("score"), F.count(F.lit(1)).alias("have"))


def top(scores: DataFrame, k: int = TOP) -> DataFrame:
    order = Window.partitionBy("qid").orderBy(F.round("score", 6).desc(), "doc_id")
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("qid", "rank", "doc_id", F.round("score", 6).alias("score"))


def min_match(q: DataFrame, share: float = 0.5) -> DataFrame:
    """qid, need: how many of its different terms a document must hold."""
    return q.groupBy("qid").agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) * F.lit(share))).alias("need"))


def enough(scores: DataFrame, q: DataFrame, share: float = 0.5) -> DataFrame:
    """Scored documents that hold enough different query terms."""
    return scores.join(F.broadcast(min_match(q, share)), "qid").filter("have >= need")  # a row a query


def search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 over documents that hold at least half of a query's terms; each term counts once."""
    q = query_terms(queries_of(spark, sf_dir)).withColumn("one", F.lit(1))
    return Index(table(spark, sf_dir, "documents")).best(q, weight="one", share=0.5)


def variants(term: Column) -> Column:
    """A short term and what is left of it without one letter after the first, behind the first letter."""
    left = F.transform(F.sequence(F.lit(2), F.length(term)), lambda i: F.concat(F.substring(term, F.lit(1), i - 1), F.substring(term, i + 1, F.length(term))))
    return F.array_distinct(F.when(F.length(term) > 1, F.concat(F.array(term), left)).otherwise(F.array(term)))


def expansions(tokens: DataFrame, terms: DataFrame, most: int = EXPANSIONS) -> DataFrame:
    """(term, expansion): terms of the index that stand for each token, itself among them if it is there.

    ASCII tokens of three letters and more take terms within one edit or swap of neighbours (n-grams have three letters at most) and the
    same first letter: nearest first, then most frequent, then by name, at most `most`. Others stand for themselves.
    """
    fuzzy = F.col("term").rlike(r"\A[\x00-\x7F]{3,}\z")
    known = terms.select(F.col("term").alias("expansion"), "df")
    plain = tokens.filter(~fuzzy).join(known, F.col("term") == F.col("expansion")).select("term", "expansion")
    a = tokens.filter(fuzzy).select("term", F.explode(variants(F.col("term"))).alias("v"))
    b = known.select("expansion", "df", F.explode(variants(F.col("expansion"))).alias("v"))
    met = a.join(b, "v").filter(F.substring("term", 1, PREFIX) == F.substring("expansion", 1, PREFIX)).select("term", "expansion", "df").distinct()
    t = lambda i: F.substring("term", i, 1)
    swapped = F.concat(t(1), t(3), t(2), F.expr("substring(term, 4)"))
    distance = F.when(F.col("term") == F.col("expansion"), 0).when((F.levenshtein("term", "expansion") <= 1) | (F.col("expansion") == swapped), 1)
    order = Window.partitionBy("term").orderBy("distance", F.desc("df"), "expansion")
    near = met.withColumn("distance", distance).filter("distance IS NOT NULL").withColumn("r", F.row_number().over(order)).filter(F.col("r") <= most)
    return plain.unionByName(near.select("term", "expansion"))


def search_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same search with fuzzy tokens: any expansion of a token counts as the token, and each different expansion scores once."""
    index = Index(table(spark, sf_dir, "documents"))
    q = query_terms(queries_of(spark, sf_dir)).withColumn("one", F.lit(1))
    return index.best(q, weight="one", share=0.5, expanded=expansions(q.select("term").distinct(), index.terms()))


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Index(table(spark, sf_dir, "documents")).best(query_terms(queries_of(spark, sf_dir)))


def q_all_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with a score, for each query."""
    index = Index(table(spark, sf_dir, "documents"))
    scores = index.all_scores(query_terms(queries_of(spark, sf_dir)))
    return scores.select("qid", "doc_id", F.round("score", 6).alias("score"))


def q_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n-grams of passages, every second one behind CJK text, with full-width letters and a ligature: size, number and digest."""
    text = F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("　中文测试文档"), F.substring("text", 1, 11))).otherwise(F.concat(F.lit(" Ｆｕｌｌ ﬁ "), "text"))
    rows = table(spark, sf_dir, "benchmark").select("item_id", normal(text).alias("t")).withColumn("n", gram_size(F.col("t")))
    found = rows.withColumn("g", grams(F.col("t"), F.col("n")))
    return found.select("item_id", "n", F.size("g").cast("long").alias("tokens"), F.md5(F.array_join("g", "|").cast("binary")).alias("digest"))


def q_cjk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a character is CJK, for every code point up to the end of the last range; half pairs are no characters."""
    points = spark.range(0, 0x323B0).filter("id < 55296 OR id > 57343").select(F.col("id").alias("code_point"))
    char = F.decode(F.unhex(F.lpad(F.hex("code_point"), 8, "0")), "UTF-32")
    return points.select("code_point", char.rlike(CJK).alias("is_cjk"))


def q_term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Index(table(spark, sf_dir, "documents")).terms()


def q_pruned(spark: SparkSession, sf_dir: str, most: int = 50) -> DataFrame:
    """The index without terms that stand in more than `most` documents."""
    return Index(table(spark, sf_dir, "documents")).terms().filter(F.col("df") <= most)


def q_corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = Index(table(spark, sf_dir, "documents")).stats
    return stats.select("n", F.round("avgdl", 6).alias("avgdl"), "total")


def q_doc_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each document its length, different terms and largest tf."""
    index = Index(table(spark, sf_dir, "documents"))
    if not index.repeated():
        return scoring.profiles(index.docs)
    found = index.postings.groupBy("doc_id").agg(F.count(F.lit(1)).alias("terms"), F.max("tf").alias("max_tf"))
    return index.lengths.join(found, "doc_id", "left").select("doc_id", "dl", F.coalesce("terms", F.lit(0)).alias("terms"), F.coalesce("max_tf", F.lit(0)).alias("max_tf"))


def q_collection_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = Index(table(spark, sf_dir, "documents"))
    kept = index.terms()
    return kept.crossJoin(F.broadcast(index.totals())).select("term", F.round(F.col("cf") / F.col("total"), 10).alias("p"))


def q_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document frequency and presence of each query term; absent or pruned ones have none."""
    index = Index(table(spark, sf_dir, "documents"))
    q = query_terms(queries_of(spark, sf_dir))
    terms = index.terms(q.select("term").distinct()).select("term", "df")
    return q.join(terms, "term", "left").select("qid", "term", F.coalesce("df", F.lit(0)).alias("df"), F.col("df").isNotNull().alias("has_term"))


def performance(q: DataFrame, terms: DataFrame, matched: DataFrame, n: int) -> DataFrame:
    """avg_idf, max_idf, scope, scq and hardness of queries (qid, term). terms: (term, df, cf); matched: (qid, docs)."""
    i = idf(F.lit(n), F.col("df"))
    base = q.join(terms, "term").groupBy("qid").agg(F.avg(i).alias("avg_idf"), F.max(i).alias("max_idf"), F.avg(i * F.log1p("cf")).alias("scq"))
    scope = matched.select("qid", (F.col("docs") / F.lit(n)).alias("scope"))
    out = q.select("qid").distinct().join(base, "qid", "left").join(scope, "qid", "left")
    cols = [F.round(F.coalesce(c, F.lit(0.0)), 6).alias(c) for c in ("avg_idf", "max_idf", "scope", "scq")]
    return out.select("qid", *cols, (F.coalesce("avg_idf", F.lit(0.0)) < 2.0).alias("is_hard"))


def q_clarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = Index(table(spark, sf_dir, "documents"))
    q = query_terms(queries_of(spark, sf_dir))
    known = index.terms(q.select("term").distinct()).select("term", "cf")
    total = q.groupBy("qid").agg(F.sum("qtf").alias("len"))
    rows = q.join(total, "qid").join(known, "term", "left").crossJoin(F.broadcast(index.stats))
    p, c = F.col("qtf") / F.col("len"), F.coalesce(F.col("cf") / F.col("total"), F.lit(1e-12))
    return rows.groupBy("qid").agg(F.round(F.sum(p * F.log(p / c)), 6).alias("clarity"))


def _feedback(index: Index, spark: SparkSession, sf_dir: str, docs: int = 3) -> tuple[DataFrame, DataFrame]:
    """Query terms and the term frequencies of each query's first documents (qid, term, tf, n_rel)."""
    q = query_terms(queries_of(spark, sf_dir))
    best = index.best(q, docs).select("qid", "doc_id")
    few = index.docs.join(best.select("doc_id").distinct(), "doc_id", "left_semi")
    kept = index.terms().select("term")
    posts = postings(few).join(kept, "term", "left_semi")
    n_rel = best.groupBy("qid").agg(F.count(F.lit(1)).alias("n_rel"))
    return q, best.join(posts, "doc_id").join(n_rel, "qid")


def q_rm3(spark: SparkSession, sf_dir: str, alpha: float = 0.5, terms: int = 10) -> DataFrame:
    """Weights alpha * query + (1 - alpha) * feedback model of the ten likeliest feedback terms."""
    index = Index(table(spark, sf_dir, "documents"))
    q, rel = _feedback(index, spark, sf_dir)
    sums = rel.groupBy("qid", "term").agg(F.sum("tf").alias("tf"))
    total = sums.groupBy("qid").agg(F.sum("tf").alias("all"))
    order = Window.partitionBy("qid").orderBy(F.desc("tf"), "term")
    model = sums.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= terms).join(total, "qid").select("qid", "term", (F.col("tf") / F.col("all") * F.lit(1 - alpha)).alias("w"))
    length = q.groupBy("qid").agg(F.sum("qtf").alias("len"))
    own = q.join(length, "qid").select("qid", "term", (F.col("qtf") / F.col("len") * F.lit(alpha)).alias("w"))
    return own.unionByName(model).groupBy("qid", "term").agg(F.round(F.sum("w"), 8).alias("weight"))


def q_rocchio(spark: SparkSession, sf_dir: str, alpha: float = 1.0, beta: float = 0.75, terms: int = 10) -> DataFrame:
    index = Index(table(spark, sf_dir, "documents"))
    q, rel = _feedback(index, spark, sf_dir)
    sums = rel.groupBy("qid", "term").agg((F.sum("tf") * F.lit(beta) / F.first("n_rel")).alias("w"))
    order = Window.partitionBy("qid").orderBy(F.round("w", 8).desc(), "term")
    model = sums.withColumn("r", F.row_number().over(order)).filter((F.col("r") <= terms) & (F.col("w") > 0)).select("qid", "term", "w")
    own = q.select("qid", "term", (F.col("qtf") * F.lit(alpha)).alias("w"))
    return own.unionByName(model).groupBy("qid", "term").agg(F.round(F.sum("w"), 8).alias("weight"))


def dcg(gains: DataFrame, k: int = TOP) -> DataFrame:
    """qid, ndcg of (qid, rank, gain) rows."""
    gain = (F.pow(F.lit(2.0), F.col("gain")) - 1) / F.log2(F.col("rank") + 1)
    got = gains.filter(F.col("rank") <= k).groupBy("qid").agg(F.sum(gain).alias("dcg"))
    order = Window.partitionBy("qid").orderBy(F.desc("gain"))
    ideal = gains.select("qid", "gain").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).groupBy("qid").agg(F.sum(gain).alias("ideal"))
    return got.join(ideal, "qid").select("qid", F.round(F.when(F.col("ideal") > 0, F.col("dcg") / F.col("ideal")).otherwise(0.0), 6).alias("ndcg"))


def q_ndcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NDCG of the search results, with label quality as the gain."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    hits = bm25_topk(spark, sf_dir).join(labels, "doc_id", "left").select("qid", "rank", F.coalesce("quality", F.lit(0)).cast("double").alias("gain"))
    return dcg(hits)


def q_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation recall: user and assistant turns that aren't blank are indexed; each benchmark query finds its three best turns."""
    turns = history_turns(table(spark, sf_dir, "conversations"))
    index = Index(turns.select(F.col("turn_id").alias("doc_id"), "text"), dense=True)
    found = index.best(query_terms(queries_of(spark, sf_dir)), 3)
    return found.join(turns.select(F.col("turn_id").alias("doc_id"), "role"), "doc_id").select("qid", "rank", F.col("doc_id").alias("turn_id"), "role", "score")


def history_turns(conversations: DataFrame, most: int = 500) -> DataFrame:
    """turn_id, role, text of each conversation's newest turns that count; eviction comes before ranking. A conversation has fewer than a million turns."""
    live = conversations.filter(F.col("role").isin("user", "assistant") & (F.trim(F.coalesce("text", F.lit(""))) != ""))
    newest = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return live.withColumn("_n", newest).filter(F.col("_n") <= most).select((F.col("conv_id") * 1_000_000 + F.col("turn")).alias("turn_id"), "role", "text")


_TOK = r"""
docs AS (SELECT doc_id, lower(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS t FROM documents WHERE text IS NOT NULL),
tok AS (SELECT doc_id, unnest(CASE WHEN length(t) >= 3 THEN list_transform(range(1, length(t) - 1), lambda i: c[i] || c[i+1] || c[i+2]) WHEN length(t) > 0 THEN [t] ELSE [] END) AS term FROM (SELECT *, string_split(t, '') AS c FROM docs)),
post AS (SELECT term, doc_id, count(*) AS tf FROM tok GROUP BY ALL),
lens AS (SELECT doc_id, CAST(CASE WHEN length(t) >= 3 THEN length(t) - 2 WHEN length(t) > 0 THEN 1 ELSE 0 END AS BIGINT) AS dl FROM docs),
stats AS (SELECT max(doc_id) + 1 AS n, avg(dl) AS avgdl, CAST(sum(dl) AS BIGINT) AS total FROM lens),
terms AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM post GROUP BY term),
kept AS (SELECT terms.* FROM terms, stats WHERE df <= n * 0.5::DOUBLE AND NOT regexp_full_match(term, '\p{P}+')),
qs AS (SELECT item_id AS qid, lower(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS t FROM benchmark),
qt AS (SELECT qid, term, count(*) AS qtf FROM (SELECT qid, unnest(CASE WHEN length(t) >= 3 THEN list_transform(range(1, length(t) - 1), lambda i: substring(t, i, 3)) WHEN length(t) > 0 THEN [t] ELSE [] END) AS term FROM qs) GROUP BY ALL),
hits AS (SELECT qid, term, qtf, doc_id, tf, df, cf FROM qt JOIN kept USING (term) JOIN post USING (term))"""
_PART = "ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))"


def _top_sql(name: str, rows: str, weight: str, k: int = TOP) -> str:
    return f"""{name}_s AS (SELECT qid, doc_id, round(sum({weight} * {_PART}), 6) AS score FROM {rows} JOIN lens USING (doc_id), stats GROUP BY ALL),
{name} AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM {name}_s QUALIFY rank <= {k})"""


_REL = f"""{_top_sql("best", "hits", "qtf", 3)},
nrel AS (SELECT qid, count(*) AS n_rel FROM best GROUP BY qid),
rel AS (SELECT best.qid, post.term, tf, n_rel FROM best JOIN post USING (doc_id) JOIN kept USING (term) JOIN nrel ON best.qid = nrel.qid)"""

QUERIES = {
    "q03_term_stats": q_term_stats,
    "g02_corpus_stats": q_corpus_stats,
    "g01_doc_profile": q_doc_profile,
    "g03_collection_lm": q_collection_lm,
    "q04_term_lookup": q_lookup,
    "q06_search_fuzzy": search_fuzzy,
    "t02_all_scores": q_all_scores,
    "q01_ngram_tokens": q_tokens,
    "q02_cjk": q_cjk,
    "b17_prune_df": q_pruned,
    "q21_clarity": q_clarity,
    "q14_rm3": q_rm3,
    "q15_rocchio": q_rocchio,
    "q19_ndcg": q_ndcg,
    "q24_history_search": q_history,
}
SQL_BM25 = f"WITH {_TOK}, {_top_sql('b', 'hits', 'qtf')} SELECT * FROM b"
ORACLES = {
    "q03_term_stats": f"WITH {_TOK} SELECT term, df, cf FROM kept",
    "g02_corpus_stats": f"WITH {_TOK} SELECT n, round(avgdl, 6) AS avgdl, total FROM stats",
    "g01_doc_profile": f"WITH {_TOK} SELECT doc_id, dl, coalesce(terms, 0) AS terms, coalesce(max_tf, 0) AS max_tf FROM lens LEFT JOIN (SELECT doc_id, count(*) AS terms, max(tf) AS max_tf FROM post GROUP BY doc_id) USING (doc_id)",
    "g03_collection_lm": f"WITH {_TOK} SELECT term, round(cf / total, 10) AS p FROM kept, stats",
    "q04_term_lookup": f"WITH {_TOK} SELECT qid, term, coalesce(df, 0) AS df, df IS NOT NULL AS has_term FROM qt LEFT JOIN kept USING (term)",
    "q05_bm25_topk": SQL_BM25,
    "q06_search_min_match": f"""WITH {_TOK}, need AS (SELECT qid, greatest(1, ceil(count(*) * 0.5)) AS need FROM qt GROUP BY qid),
have AS (SELECT qid, doc_id, count(DISTINCT term) AS have FROM hits GROUP BY qid, doc_id), cand AS (SELECT qid, doc_id FROM have JOIN need USING (qid) WHERE have >= need),
ch AS (SELECT hits.* FROM hits SEMI JOIN cand USING (qid, doc_id)), {_top_sql("b", "ch", "1")} SELECT * FROM b""",
    "q06_search_fuzzy": f"""WITH {_TOK}, need AS (SELECT qid, greatest(1, ceil(count(*) * 0.5)) AS need FROM qt GROUP BY qid), x AS (SELECT DISTINCT term, regexp_full_match(term, '[\\x00-\\x7F]{{3,}}') AS fuzzy FROM qt),
p AS (SELECT x.term, fuzzy, kept.term AS expansion, df, substring(x.term, 2, 1) AS a, substring(x.term, 3, 1) AS b, substring(kept.term, 2, 1) AS c, substring(kept.term, 3, 1) AS d FROM x JOIN kept ON left(x.term, 1) = left(kept.term, 1)),
e AS (SELECT term, expansion, df, term <> expansion AS d FROM p WHERE term = expansion OR (fuzzy AND ((length(expansion) = 3 AND (a = c OR b = d OR (a = d AND b = c))) OR (length(expansion) = 2 AND (c = a OR c = b))))),
few AS (SELECT term AS token, expansion FROM e QUALIFY row_number() OVER (PARTITION BY term ORDER BY d, df DESC, expansion) <= 50), td AS (SELECT DISTINCT token, doc_id FROM few JOIN post ON expansion = post.term),
cand AS (SELECT qid, doc_id FROM qt JOIN td ON qt.term = token JOIN need USING (qid) GROUP BY qid, doc_id, need HAVING count(*) >= need), once AS (SELECT DISTINCT qid, expansion AS term FROM qt JOIN few ON qt.term = token),
ch AS (SELECT once.qid, post.doc_id, tf, df FROM once JOIN kept USING (term) JOIN post USING (term) SEMI JOIN cand ON once.qid = cand.qid AND post.doc_id = cand.doc_id), {_top_sql("b", "ch", "1")} SELECT * FROM b""",
    "t02_all_scores": f"WITH {_TOK} SELECT qid, doc_id, round(sum(qtf * {_PART}), 6) AS score FROM hits JOIN lens USING (doc_id), stats GROUP BY ALL",
    "q01_ngram_tokens": r"""WITH s AS (SELECT item_id, CASE WHEN item_id % 2 = 0 THEN regexp_replace('中文测试文档' || lower(left(text, 11)), '\s+$', '') ELSE regexp_replace('full fi ' || lower(text), '\s+$', '') END AS t FROM benchmark),
n AS (SELECT item_id, t, CASE WHEN length(regexp_replace(t, '[^中文测试文档]', '', 'g')) > length(t) * 3 // 10 THEN 2 ELSE 3 END AS n FROM s), g AS (SELECT item_id, n, list_transform(range(1, length(t) - n + 2), lambda i: substring(t, i, n)) AS g FROM n)
SELECT item_id, n, len(g) AS tokens, md5(array_to_string(g, '|')) AS digest FROM g""",
    "q02_cjk": "SELECT i AS code_point, i BETWEEN 4352 AND 4607 OR i BETWEEN 12352 AND 12543 OR i BETWEEN 12736 AND 12783 OR i BETWEEN 12800 AND 13055 OR i BETWEEN 13312 AND 19903 OR i BETWEEN 19968 AND 40959 OR i BETWEEN 43360 AND 43391 OR i BETWEEN 44032 AND 55295 OR i BETWEEN 63744 AND 64255 OR i BETWEEN 131072 AND 192095 OR i BETWEEN 194560 AND 195103 OR i BETWEEN 196608 AND 205743 AS is_cjk FROM range(0, 205744) t(i) WHERE i NOT BETWEEN 55296 AND 57343",
    "b17_prune_df": f"WITH {_TOK} SELECT term, df, cf FROM kept WHERE df <= 50",
    "q20_query_performance": f"""WITH {_TOK}, t AS (SELECT DISTINCT qid, term, df, cf FROM hits), i AS (SELECT qid, ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) AS idf, cf FROM t, stats),
base AS (SELECT qid, avg(idf) AS avg_idf, max(idf) AS max_idf, avg(idf * ln(1 + cf)) AS scq FROM i GROUP BY qid),
sc AS (SELECT qid, count(DISTINCT doc_id) / any_value(n) AS scope FROM hits, stats GROUP BY qid)
SELECT qid, round(coalesce(avg_idf, 0), 6) AS avg_idf, round(coalesce(max_idf, 0), 6) AS max_idf, round(coalesce(scope, 0), 6) AS scope, round(coalesce(scq, 0), 6) AS scq, coalesce(avg_idf, 0) < 2.0 AS is_hard
FROM (SELECT DISTINCT qid FROM qt) LEFT JOIN base USING (qid) LEFT JOIN sc USING (qid)""",
    "q21_clarity": f"""WITH {_TOK}, l AS (SELECT qid, sum(qtf) AS len FROM qt GROUP BY qid)
SELECT qid, round(sum(qtf / len * ln((qtf / len) / coalesce(cf / total, 1e-12))), 6) AS clarity FROM qt JOIN l USING (qid) LEFT JOIN kept USING (term), stats GROUP BY qid""",
    "q14_rm3": f"""WITH {_TOK}, {_REL}, s AS (SELECT qid, term, sum(tf) AS tf FROM rel GROUP BY ALL), a AS (SELECT qid, sum(tf) AS total FROM s GROUP BY qid),
m AS (SELECT qid, term, tf / total * 0.5::DOUBLE AS w FROM (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY qid ORDER BY tf DESC, term) <= 10) JOIN a USING (qid)),
o AS (SELECT qid, term, qtf / sum(qtf) OVER (PARTITION BY qid) * 0.5::DOUBLE AS w FROM qt)
SELECT qid, term, round(sum(w), 8) AS weight FROM (SELECT * FROM m UNION ALL SELECT * FROM o) GROUP BY ALL""",
    "q15_rocchio": f"""WITH {_TOK}, {_REL}, s AS (SELECT qid, term, sum(tf) * 0.75::DOUBLE / any_value(n_rel) AS w FROM rel GROUP BY ALL),
m AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(w, 8) DESC, term) <= 10)
SELECT qid, term, round(sum(w), 8) AS weight FROM (SELECT * FROM m UNION ALL SELECT qid, term, CAST(qtf AS DOUBLE) FROM qt) GROUP BY ALL""",
    "q19_ndcg": f"""WITH {_TOK}, {_top_sql("b", "hits", "qtf")}, g AS (SELECT qid, rank, CAST(coalesce(quality, 0) AS DOUBLE) AS gain FROM b LEFT JOIN labels USING (doc_id)),
i AS (SELECT qid, gain, row_number() OVER (PARTITION BY qid ORDER BY gain DESC) AS rank FROM g),
d AS (SELECT qid, sum((2 ** gain - 1) / log2(rank + 1)) AS dcg FROM g GROUP BY qid), e AS (SELECT qid, sum((2 ** gain - 1) / log2(rank + 1)) AS ideal FROM i GROUP BY qid)
SELECT qid, round(CASE WHEN ideal > 0 THEN dcg / ideal ELSE 0 END, 6) AS ndcg FROM d JOIN e USING (qid)""",
    "q24_history_search": f"""WITH live AS (SELECT conv_id * 1000000 + turn AS turn_id, role, text FROM conversations WHERE role IN ('user', 'assistant') AND trim(coalesce(text, '')) <> '' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 500),
{_TOK.replace("doc_id, lower", "turn_id AS doc_id, lower").replace("FROM documents", "FROM live").replace("max(doc_id) + 1 AS n", "count(*) AS n")}, {_top_sql("b", "hits", "qtf", 3)} SELECT qid, rank, turn_id, role, score FROM b JOIN live ON turn_id = doc_id""",
}
