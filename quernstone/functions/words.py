"""Phonetic and stem codes of words, and edits of lines: rule tables read by one small engine each."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType

from ..plans.shipping import ship
from ..sources.tables import table
from .similarity import dictionary, followers, osa_distance

# The phonetic rules in order, as (letters with what stands around them, sound). The first that fits at a place is taken and
# its letters are passed over. What "end" allows beside letters comes from the code's own habit of taking the end of a word for any letter.
_SOUNDS = (
    (r"\A([AEIOU])", None), (r"[AEIOU]", ""), (r"(?<=M)B\Z", ""), (r"B", "B"), (r"(?<!S)CH", "X"), (r"CIA", "X"), (r"C(?:[IEY]|\Z)", "S"), (r"C", "K"), (r"DG(?:[IEY]|\Z)", "J"), (r"D", "T"), (r"F", "F"),
    (r"(?<=[^AEIOU])GH", "K"), (r"GH", ""), (r"GN\Z", ""), (r"GN", "N"), (r"GEL", "K"), (r"GIO", "J"), (r"G(?:[IEY]|\Z)", "J"), (r"G", "K"), (r"\AH|H\Z|(?<=[AEIOU])H|H(?=[AEIOU])", "H"), (r"H", ""), (r"J", "J"), (r"(?<=C)K", ""), (r"K", "K"),
    (r"L", "L"), (r"M", "M"), (r"N", "N"), (r"PH", "F"), (r"P", "P"), (r"Q", "K"), (r"R", "R"), (r"SH|SI(?:[OA]|\Z)", "X"), (r"S", "S"), (r"TI(?:[OA]|\Z)", "X"), (r"TH", "0"), (r"T(?=CH)", ""), (r"T", "T"), (r"V", "F"), (r"W(?=[AEIOU]|\Z)", "W"),
    (r"W", ""), (r"X", "KS"), (r"Y(?=[AEIOU]|\Z)", "Y"), (r"Y", ""), (r"Z", "S"),
)
_SOUND_AT = re.compile("|".join(f"(?P<r{k}>{pattern.replace('([AEIOU])', '[AEIOU]')})" for k, (pattern, _) in enumerate(_SOUNDS)))


def metaphone(word: str) -> str:
    """The sounds of a word's letters; the same sound twice in a row is one."""
    word, out = word.upper(), []
    for m in _SOUND_AT.finditer(word):
        sound = _SOUNDS[int(m.lastgroup[1:])][1]
        out.append(m[0] if sound is None else sound)
    return re.sub(r"(.)\1+", r"\1", "".join(out))


# Suffixes and what takes their place, in order; of each list the first that fits is the only one tried.
_PLURALS = (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", ""))
_SECOND = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
)
_THIRD = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
_FOURTH = tuple((s, "") for s in ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"))
_CLOSED = re.compile(r"[^aeiou][aeiou][^aeiouwxy]\Z")


def shape(word: str) -> str:
    """v for each vowel, c for each other letter; y is a vowel behind a letter that isn't one of aeiou."""
    return re.sub(r"[^v]", "c", re.sub(r"(?<=[^aeiou])y|[aeiou]", "v", word.replace("v", "b")))


def measure(stem: str) -> int:
    """How often a vowel follows a consonant."""
    return shape(stem).count("cv")


def replaced(word: str, rules: tuple[tuple[str, str], ...], least: int) -> str:
    """The word with its first fitting suffix replaced, if the rest measures at least `least`."""
    for suffix, put in rules:
        if word.endswith(suffix):
            stem = word[: len(word) - len(suffix)]
            return stem + put if least < 0 or measure(stem) >= least else word
    return word


def porter(word: str) -> str:
    """Stem of an English word, with the measure above."""
    word = word.lower()
    if len(word) <= 2:
        return word
    word = replaced(word, _PLURALS, -1)
    if word.endswith("eed"):
        word = replaced(word, (("eed", "ee"),), 1)
    else:
        cut = next((word[: -len(s)] for s in ("ed", "ing") if word.endswith(s)), None)
        if cut is not None and "v" in shape(cut):
            if cut.endswith(("at", "bl", "iz")) or (not re.search(r"([^aeioulsz])\1\Z", cut) and measure(cut) == 1 and _CLOSED.search(cut)):
                cut += "e"
            elif re.search(r"([^aeioulsz])\1\Z", cut):
                cut = cut[:-1]
            word = cut
    if word.endswith("y") and "v" in shape(word[:-1]):
        word = word[:-1] + "i"
    word = replaced(replaced(replaced(word, _SECOND, 1), _THIRD, 1), _FOURTH, 2)
    if word.endswith("e"):
        m = measure(word[:-1])
        if m > 1 or (m == 1 and not _CLOSED.search(word[:-1])):
            word = word[:-1]
    return word[:-1] if word.endswith("ll") and measure(word) > 1 else word


def likeness(a: str, b: str) -> float:
    """100 times twice the longest common subsequence over both lengths; 100 for two empty texts."""
    if not a and not b:
        return 100.0
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return 200.0 * row[-1] / (len(a) + len(b))


def edited(text: str, old: str, new: str, least: float = 75.0) -> tuple[str, str]:
    """The text with one place of old replaced by new, and how it was found: exact, stripped, alike or none.

    Line ends are one kind. Without an exact place the first line that holds old without blanks at its ends is taken; then the
    run of as many lines as old has that is most alike, the first of equals, if its likeness is at least `least`.
    """
    text, old, new = (x.replace("\r\n", "\n").replace("\r", "\n") for x in (text, old, new))
    if not old or old == new:
        return text, "none"
    if old in text:
        return text.replace(old, new, 1), "exact"
    rows, core = text.split("\n"), old.strip()
    for k, line in enumerate(rows):
        if core and core in line:
            return "\n".join([*rows[:k], line.replace(core, new, 1), *rows[k + 1 :]]), "stripped"
    wanted = old.removesuffix("\n").split("\n")
    n = len(wanted)
    best = max(((likeness("\n".join(wanted), "\n".join(rows[k : k + n])), -k) for k in range(len(rows) - n + 1)), default=(0.0, 0))
    if best[0] < least:
        return text, "none"
    k = -best[1]
    return "\n".join([*rows[:k], *new.split("\n"), *rows[k + n :]]), "alike"


def single(fn, kind=StringType()):
    def run(a: pd.Series) -> pd.Series:
        return a.map(fn, na_action="ignore")

    return F.pandas_udf(run, kind)


def q_metaphone(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return dictionary(spark, sf_dir).select("term", single(metaphone)("term").alias("metaphone"))


def q_porter(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return dictionary(spark, sf_dir).select("term", single(porter)("term").alias("stem"))


def q_osa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of each word to the one after it in order, within a first letter, and to itself with its first letters swapped."""
    ship(spark)

    def pairs(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if y is None else osa_distance(x, y) for x, y in zip(a, b)], dtype="Int32")

    distance = F.pandas_udf(pairs, IntegerType())
    after = F.get("after", F.lit(0))
    words = followers(dictionary(spark, sf_dir), 1).select("term", F.when(F.substring(after, 1, 1) == F.substring("term", 1, 1), after).alias("other"))
    swapped = F.concat(F.substring("term", 2, 1), F.substring("term", 1, 1), F.expr("substring(term, 3)"))
    return words.select("term", distance("term", "other").alias("next"), distance(F.col("term"), swapped).alias("swapped"))


def q_line_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits of passages: of their first line as it is, with blanks around it, with a letter lost, and of what isn't there."""
    ship(spark)
    first = F.regexp_extract("text", r"\A([^\n]*)", 1)
    # the sixth letter is lost, or the first other one without which the line stands nowhere in the text: "Thing" is a place of "Thing."
    without = F.transform(F.concat(F.array(F.lit(6)), F.sequence(F.lit(1), F.greatest(F.length(first), F.lit(1)))), lambda k: F.concat(F.substring(first, F.lit(1), k - 1), F.substring(first, k + 1, F.length(first))))
    lost = F.coalesce(F.get(F.filter(without, lambda w: ~F.contains(F.col("text"), F.trim(w))), F.lit(0)), F.get(without, F.lit(0)))
    old = F.when(F.col("item_id") % 4 == 0, first).when(F.col("item_id") % 4 == 1, F.concat(F.lit("  "), first, F.lit(" "))).when(F.col("item_id") % 4 == 2, lost).otherwise(F.lit("0123456789"))

    def run(parts):
        for pdf in parts:
            done = [edited(t, o, "NEW") for t, o in zip(pdf["text"], pdf["old"])]
            yield pd.DataFrame({"item_id": pdf["item_id"], "how": [h for _, h in done], "text": [t for t, _ in done]})

    rows = table(spark, sf_dir, "benchmark").select("item_id", "text", old.alias("old")).mapInPandas(run, "item_id long, how string, text string")
    return rows.select("item_id", "how", F.md5(F.col("text").cast("binary")).alias("digest"))


QUERIES = {"c10_metaphone": q_metaphone, "c11_porter_stem": q_porter, "c02_osa_distance": q_osa, "q26_line_edits": q_line_edits}
ORACLES = {
    "q26_line_edits": r"""WITH b AS (SELECT item_id, text, regexp_extract(text, '^([^\n]*)', 1) AS f FROM benchmark) SELECT item_id, CASE item_id % 4 WHEN 0 THEN 'exact' WHEN 1 THEN 'stripped' WHEN 2 THEN 'alike' ELSE 'none' END AS how, md5(CASE WHEN item_id % 4 = 3 THEN text ELSE 'NEW' || substring(text, length(f) + 1) END) AS digest FROM b""",
}
