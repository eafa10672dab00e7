"""Greedy re-ranking of a query's few results, and learning to rank.

Each query's results are at most `retrieval.TOP` rows, so a query is one small group for a vectorised function.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.shipping import ship
from ..sources.tables import table
from . import retrieval

SHARE = 0.5


def greedy(relevance: list[float], gain) -> list[int]:
    """Places in the order taken: each time the first of the largest gain(place, taken)."""
    left, taken = list(range(len(relevance))), []
    while left:
        best = max(left, key=lambda i: (gain(i, taken), -i))
        taken.append(best)
        left.remove(best)
    return taken


def jaccard(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a or b else 0.0


def mmr_group(pdf: pd.DataFrame) -> pd.DataFrame:
    """Relevance against the largest likeness to what is taken already."""
    pdf = pdf.sort_values("rank").reset_index(drop=True)
    terms, rel = [set(x) for x in pdf["terms"]], pdf["score"].tolist()
    order = greedy(rel, lambda i, taken: SHARE * rel[i] - (1 - SHARE) * max((jaccard(terms[i], terms[j]) for j in taken), default=0.0))
    out = pdf.iloc[order].reset_index(drop=True)
    return pd.DataFrame({"qid": out["qid"], "new_rank": np.arange(1, len(out) + 1), "doc_id": out["doc_id"], "score": out["score"]})


def xquad_group(pdf: pd.DataFrame) -> pd.DataFrame:
    """Relevance and the share of a document's aspects that are new."""
    pdf = pdf.sort_values("rank").reset_index(drop=True)
    aspects, rel = [set(x) for x in pdf["terms"]], pdf["score"].tolist()

    def gain(i: int, taken: list[int]) -> float:
        covered = set().union(*(aspects[j] for j in taken)) if taken else set()
        return (1 - SHARE) * rel[i] + SHARE * len(aspects[i] - covered) / max(len(aspects[i]), 1)

    out = pdf.iloc[greedy(rel, gain)].reset_index(drop=True)
    return pd.DataFrame({"qid": out["qid"], "new_rank": np.arange(1, len(out) + 1), "doc_id": out["doc_id"], "score": out["score"]})


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search results with the document's different words."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.array_distinct(F.split(F.lower("text"), r"\s+")).alias("terms"))
    return retrieval.bm25_topk(spark, sf_dir).join(docs, "doc_id")


def q_mmr(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return _results(spark, sf_dir).groupBy("qid").applyInPandas(mmr_group, "qid long, new_rank long, doc_id long, score double")


def q_xquad(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return _results(spark, sf_dir).groupBy("qid").applyInPandas(xquad_group, "qid long, new_rank long, doc_id long, score double")


def ndcg(gains: list[float], k: int = 10) -> float:
    value = lambda g: sum((2**x - 1) / np.log2(i + 2) for i, x in enumerate(g[:k]))
    ideal = value(sorted(gains, reverse=True))
    return value(gains) / ideal if ideal else 0.0


def coordinate_ascent(x: list[np.ndarray], y: list[np.ndarray], rounds: int = 50, rate: float = 0.05) -> np.ndarray:
    """Linear weights: one coordinate a round is moved up or down if the mean NDCG of the grades in score order grows."""
    w = np.full(x[0].shape[1], 1.0 / x[0].shape[1])
    mean = lambda v: float(np.mean([ndcg(g[np.argsort(-(m @ v), kind="stable")].tolist()) for m, g in zip(x, y)]))
    best = mean(w)
    for i in range(rounds):
        for step in (rate, -rate):
            trial = w.copy()
            trial[i % len(w)] += step
            got = mean(trial)
            if got > best:
                w, best = trial, got
    return w


def rank_svm(x: list[np.ndarray], y: list[np.ndarray], rate: float = 0.01, steps: int = 1000, seed: int = 42) -> np.ndarray:
    """Pairwise hinge loss by stochastic gradient."""
    pairs = [m[i] - m[j] for m, g in zip(x, y) for i in range(len(g)) for j in range(len(g)) if g[i] > g[j]]
    w, rng = np.zeros(x[0].shape[1]), np.random.default_rng(seed)
    for _ in range(steps if pairs else 0):
        d = pairs[rng.integers(len(pairs))]
        if w @ d < 1:
            w += rate * d
    return w


def rank_boost(x: list[np.ndarray], y: list[np.ndarray], rounds: int = 100) -> list[tuple[int, float, int, float]]:
    """Stumps (feature, threshold, direction, weight) on misordered pairs; a perfect stump is kept and ends the search."""
    pairs = [(m[i], m[j]) for m, g in zip(x, y) for i in range(len(g)) for j in range(len(g)) if g[i] > g[j]]
    if not pairs:
        return []
    hi, lo = (np.array([p[k] for p in pairs]) for k in (0, 1))
    d, out = np.full(len(pairs), 1 / len(pairs)), []
    for _ in range(rounds):
        best = None
        for f in range(hi.shape[1]):
            values = np.unique(np.concatenate([hi[:, f], lo[:, f]]))
            for t in (values[1:] + values[:-1]) / 2:
                r = float(d @ ((hi[:, f] > t).astype(int) - (lo[:, f] > t).astype(int)))
                if best is None or abs(r) > abs(best[0]):
                    best = (r, f, float(t))
        if best is None or abs(best[0]) < 1e-9:
            break
        r = min(max(best[0], -0.999999), 0.999999)
        weight = 0.5 * np.log((1 + r) / (1 - r))
        out.append((best[1], best[2], 1 if weight > 0 else -1, abs(weight)))
        d *= np.exp(-weight * ((hi[:, best[1]] > best[2]).astype(int) - (lo[:, best[1]] > best[2]).astype(int)))
        d /= d.sum()
        if abs(best[0]) > 1 - 1e-9:
            break
    return out


def boosted(stumps: list[tuple[int, float, int, float]], x: np.ndarray) -> np.ndarray:
    """Scores of rows by stumps: each adds or takes its weight where its feature is above its threshold."""
    return sum((sign * w * (x[:, f] > t) for f, t, sign, w in stumps), np.zeros(len(x)))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qid, doc_id, f0 (score), f1 (length), f2 (1 / rank), grade (label quality) of the search results."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("grade"))
    found = retrieval.bm25_topk(spark, sf_dir).join(docs, "doc_id").join(labels, "doc_id", "left")
    return found.select("qid", "doc_id", (F.col("score") / 20).alias("f0"), (F.log1p("n_chars") / 10).alias("f1"), (1 / F.col("rank")).alias("f2"), F.coalesce("grade", F.lit(0.0)).alias("grade"))


def training(feats: DataFrame, rows: int = 5000) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Features and grades of the even queries, a query an entry; a bounded set of at most `rows` results, of queries in the order of their hash."""
    sample = feats.filter("qid % 2 = 0").orderBy(F.xxhash64("qid"), "qid", "doc_id").limit(rows).toPandas()
    groups = [g for _, g in sample.groupby("qid")]
    return [g[["f0", "f1", "f2"]].to_numpy() for g in groups], [g["grade"].to_numpy() for g in groups]


def ranked(feats: DataFrame, score: Column) -> DataFrame:
    order = Window.partitionBy("qid").orderBy(F.round("s", 9).desc(), "doc_id")
    return feats.withColumn("s", score).select("qid", "doc_id", F.row_number().over(order).alias("new_rank"))


def linear(w: np.ndarray) -> Column:
    return sum((F.col(f"f{i}") * F.lit(float(w[i])) for i in range(3)), F.lit(0.0))


def q_learned_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search results in the order of a linear model found by coordinate ascent; scoring is a plain expression."""
    feats = features(spark, sf_dir)
    x, y = training(feats)
    return ranked(feats, linear(coordinate_ascent(x, y) if x else np.ones(3) / 3))


def q_rank_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    feats = features(spark, sf_dir)
    x, y = training(feats)
    return ranked(feats, linear(rank_svm(x, y) if x else np.zeros(3)))


def q_rank_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    feats = features(spark, sf_dir)
    stumps = rank_boost(*training(feats))
    return ranked(feats, sum((F.when(F.col(f"f{f}") > t, sign * w).otherwise(0.0) for f, t, sign, w in stumps), F.lit(0.0)))


QUERIES = {"q12_mmr": q_mmr, "q13_xquad": q_xquad, "q16_learned_rank": q_learned_rank, "q17_rank_svm": q_rank_svm, "q18_rank_boost": q_rank_boost}
ORACLES: dict[str, str] = {}
