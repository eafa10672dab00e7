"""String distances and phonetic codes that Spark has no function for, as vectorised UDFs over different values."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.shipping import ship
from ..plans.staging import cut
from ..sources.tables import table


def osa_distance(a: str, b: str, most: int | None = None) -> int:
    """Optimal string alignment: edits and swaps of neighbours, no part edited twice. Above `most`, most + 1."""
    if most is not None and abs(len(a) - len(b)) > most:
        return most + 1
    rows = [list(range(len(b) + 1))]
    for i in range(1, len(a) + 1):
        row = [i]
        for j in range(1, len(b) + 1):
            cost = min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                cost = min(cost, rows[-2][j - 2] + 1)
            row.append(cost)
        rows.append(row)
        if most is not None and min(row) > most:
            return most + 1
    return rows[-1][-1] if most is None else min(rows[-1][-1], most + 1)


def damerau_distance(a: str, b: str, most: int | None = None) -> int:
    """Edits and swaps of neighbours, with edits between swapped letters as well, as DuckDB's damerau_levenshtein. Above `most`, most + 1."""
    if most is not None and abs(len(a) - len(b)) > most:
        return most + 1
    far = len(a) + len(b)
    rows, seen = [[far] * (len(b) + 2), [far, *range(len(b) + 1)]], {}
    for i, x in enumerate(a, 1):
        row, match = [far, i], 0
        for j, y in enumerate(b, 1):
            k, m = seen.get(y, 0), match  # where the swapped letters would stand
            cost = min(rows[i][j] + (x != y), row[j] + 1, rows[i][j + 1] + 1, rows[k][m] + (i - k - 1) + 1 + (j - m - 1))
            if x == y:
                match = j
            row.append(cost)
        rows.append(row)
        seen[x] = i
    return rows[-1][-1] if most is None else min(rows[-1][-1], most + 1)


def jaro(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken, left = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                left.append(c)
                break
    if not left:
        return 0.0
    right = [b[j] for j, t in enumerate(taken) if t]
    m, swapped = len(left), sum(x != y for x, y in zip(left, right)) / 2
    return (m / len(a) + m / len(b) + (m - swapped) / m) / 3


def jaro_winkler(a: str, b: str, weight: float = 0.1, most: int = 4) -> float:
    """Jaro with a bonus for a common prefix, at any similarity."""
    same = 0
    while same < min(most, len(a), len(b)) and a[same] == b[same]:
        same += 1
    base = jaro(a, b)
    return base + same * weight * (1 - base)


# The letter classes of the code.
_CLASSES = {c: str(k) for k, letters in enumerate(("BFPV", "CGJKQSXZ", "DT", "L", "MN", "R"), 1) for c in letters}


def soundex(word: str) -> str:
    """Four characters; any letter without a class, H and W included, parts equal classes."""
    word = word.upper()
    if not word:
        return ""
    code, before = word[0], _CLASSES.get(word[0])
    for c in word[1:]:
        kind = _CLASSES.get(c)
        if kind and kind != before:
            code += kind
        before = kind
    return (code + "000")[:4]


def deletes(term: str, most: int) -> set[str]:
    """The term with up to `most` characters left out, itself included."""
    found = level = {term}
    for _ in range(most):
        level = {t[:i] + t[i + 1 :] for t in level for i in range(len(t))}
        found = found | level
    return found


def auto_edits(term: str) -> int:
    return 0 if len(term) <= 2 else 1 if len(term) <= 5 else 2


def _pairwise(fn, kind: str):
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else fn(x, y) for x, y in zip(a, b)])

    return F.pandas_udf(run, kind)


def _single(fn, kind: str):
    def run(a: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else fn(x) for x in a])

    return F.pandas_udf(run, kind)


def register(spark: SparkSession) -> None:
    """Make the functions callable from SQL."""
    ship(spark)
    for name, made in {"osa_distance": _pairwise(osa_distance, "int"), "jaro": _pairwise(jaro, "double"), "jaro_winkler_any": _pairwise(jaro_winkler, "double"), "soundex_strict": _single(soundex, "string")}.items():
        spark.udf.register(name, made)


def dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Different ASCII words of the passages with their frequencies."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("term"))
    return words.groupBy("term").agg(F.count(F.lit(1)).alias("freq"))


def fuzzy_pairs(left: DataFrame, right: DataFrame, most: int = 2) -> DataFrame:
    """(a, b, distance) of terms within their automatic number of edits: both emit their deletions, equal ones meet, the distance decides.

    The distance is that of the SQL, which edits between swapped letters too: a swap with letters between costs one and those letters, and each side reaches
    what both share by as many deletions at most, so that no pair is missed.
    """
    made = F.pandas_udf(lambda s: pd.Series([sorted(deletes(t, min(auto_edits(t), most))) for t in s]), "array<string>")
    wide = F.pandas_udf(lambda s: pd.Series([sorted(deletes(t, most)) for t in s]), "array<string>")
    a = left.select("a", F.explode(made(F.col("a"))).alias("v"))
    b = right.select("b", F.explode(wide(F.col("b"))).alias("v"))
    met = a.join(b, "v").select("a", "b").distinct()
    allowed = F.when(F.length("a") <= 2, 0).when(F.length("a") <= 5, 1).otherwise(2)
    return met.withColumn("distance", _pairwise(lambda x, y: damerau_distance(x, y, most), "int")("a", "b")).filter(F.col("distance") <= allowed)


def q_fuzzy(spark: SparkSession, sf_dir: str, most: int = 50) -> DataFrame:
    """Expansions of dictionary words to themselves and to words of up to 8 letters, with the same first letter, nearest first, then most frequent, then by name."""
    from pyspark.sql import Window

    ship(spark)
    terms = dictionary(spark, sf_dir)
    short = terms.filter("length(term) <= 8")
    found = fuzzy_pairs(terms.select(F.col("term").alias("a")), short.select(F.col("term").alias("b")))
    found = found.unionByName(terms.filter("length(term) > 8").select(F.col("term").alias("a"), F.col("term").alias("b"), F.lit(0).alias("distance")))
    found = found.filter(F.substring("a", 1, 1) == F.substring("b", 1, 1)).join(terms.select(F.col("term").alias("b"), "freq"), "b")
    order = Window.partitionBy("a").orderBy("distance", F.desc("freq"), "b")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most).select(F.col("a").alias("term"), "rank", F.col("b").alias("expansion"), "distance")


def q_speller(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words with their last letter doubled, corrected to the most frequent dictionary word within two edits; ties to the first by name."""
    ship(spark)
    terms = dictionary(spark, sf_dir)
    wrong = terms.select(F.concat("term", F.substring("term", -1, 1)).alias("a")).join(terms.select(F.col("term").alias("a")), "a", "left_anti")
    found = fuzzy_pairs(wrong, terms.select(F.col("term").alias("b"))).join(terms.select(F.col("term").alias("b"), "freq"), "b")
    return found.groupBy("a").agg(F.min_by("b", F.struct((-F.col("freq")).alias("f"), "b")).alias("correction")).select(F.col("a").alias("word"), "correction")


def q_phonetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return dictionary(spark, sf_dir).select("term", _single(soundex, "string")("term").alias("soundex"))


def followers(terms: DataFrame, most: int) -> DataFrame:
    """Each of the different terms with `after`, the up to `most` terms that follow it in the whole order.

    Terms are range-partitioned; a partition gets the first terms beyond its end, which are all that the
    driver sees: at most `most` a partition."""
    from pyspark.sql import Window

    placed = cut(terms.select("term").repartitionByRange("term").withColumn("part", F.spark_partition_id()))
    order = Window.partitionBy("part").orderBy("term")
    heads = sorted(placed.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= most).select("part", "term").collect())
    parts = sorted({h["part"] for h in heads})
    starts = {p: i for i, h in reversed(list(enumerate(heads))) for p in [h["part"]]}
    beyond = [(p, h["term"], False) for p, q in zip(parts, parts[1:]) for h in heads[starts[q] : starts[q] + most]]
    both = placed.select("part", "term", F.lit(True).alias("own")).unionByName(terms.sparkSession.createDataFrame(beyond, "part int, term string, own boolean"))
    after = F.filter(F.array(*[F.lead("term", k).over(order) for k in range(1, most + 1)]), lambda t: t.isNotNull())
    return both.withColumn("after", after).filter("own").select("term", "after")


def q_jaro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jaro and Jaro-Winkler of words with the five that follow in order, within a first letter."""
    ship(spark)
    pairs = followers(dictionary(spark, sf_dir), 5).select("term", F.explode("after").alias("other")).filter(F.substring("term", 1, 1) == F.substring("other", 1, 1))
    return pairs.select("term", "other", F.round(_pairwise(jaro, "double")("term", "other"), 6).alias("jaro"), F.round(_pairwise(jaro_winkler, "double")("term", "other"), 6).alias("jaro_winkler"))


_DICT = "d AS (SELECT term, count(*) AS freq FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM benchmark) GROUP BY term)"
QUERIES = {"q07_fuzzy_expansion": q_fuzzy, "q23_speller": q_speller, "c09_soundex": q_phonetic, "c03_c04_jaro": q_jaro}
#: A word's code: letters as digits of their classes, equal neighbours as one, the first letter in place of its digit.
_CODE = "translate(upper(term), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '01230120022455012623010202')"
_RUNS = _CODE
for _d in "123456":
    _RUNS = f"regexp_replace({_RUNS}, '{_d}+', '{_d}', 'g')"
_ALLOWED = "CASE WHEN length(a) <= 2 THEN 0 WHEN length(a) <= 5 THEN 1 ELSE 2 END"
ORACLES = {
    "c09_soundex": f"WITH {_DICT} SELECT term, left(upper(left(term, 1)) || replace(substring({_RUNS}, 2), '0', '') || '000', 4) AS soundex FROM d",
    "q07_fuzzy_expansion": f"""WITH {_DICT}, p AS (SELECT x.term AS a, y.term AS b, y.freq, CASE WHEN x.term = y.term THEN 0 ELSE damerau_levenshtein(x.term, y.term) END AS distance FROM d x JOIN d y ON left(x.term, 1) = left(y.term, 1) AND abs(length(x.term) - length(y.term)) <= 2 WHERE x.term = y.term OR (length(x.term) <= 10 AND length(y.term) <= 8)),
r AS (SELECT a, b, distance, row_number() OVER (PARTITION BY a ORDER BY distance, freq DESC, b) AS rank FROM p WHERE distance <= {_ALLOWED}) SELECT a AS term, rank, b AS expansion, distance FROM r WHERE rank <= 50""",
    "q23_speller": f"""WITH {_DICT}, w AS (SELECT term || right(term, 1) AS a FROM d WHERE term || right(term, 1) NOT IN (SELECT term FROM d)), p AS (SELECT a, term AS b, freq FROM w JOIN d ON abs(length(a) - length(term)) <= 2 AND damerau_levenshtein(a, term) <= {_ALLOWED})
SELECT a AS word, arg_min(b, (-freq, b)) AS correction FROM p GROUP BY a""",
}
