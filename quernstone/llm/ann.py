"""Nearest neighbours by inner product over balanced posting lists.

Vectors are lifted to unit length (one more coordinate, from a bound on the norms), so that the largest
inner product is the least angle. A bounded sample (`SAMPLE` vectors, chosen by hash) is split by
recursive balanced 2-means into clusters of nearly equal size; their means are the centroids, one for
about `LIST` vectors of the table and at most `CENTROIDS`. Executors hold the centroids, of bounded size, with a neighbour
graph, and search it best-first, a batch of vectors at once. Every vector goes to the posting list of its nearest centroid and is
replicated to others that are nearly as near (boundary vectors). A query looks into the lists whose
distance is within a ratio of the nearest one's; the beam widens until that ratio is passed. The ratio is the least with which
queries of the sample find the share `GOAL` of their nearest in the sample, so it follows the data: where all distances are much alike, a
query looks into most lists. A query that finds fewer than asked for looks into all lists. Lists are dealt
in blocks of bounded size, so a list that holds a third of all vectors is many blocks. Blocks are scored
exactly in double precision, and each query's best are merged.

Vectors that are null, zero, or hold a null or a component that is not finite, and vectors of another
length than the most frequent one (of equally frequent ones the least), take no part. Rows that repeat a vec_id are found as one, with the best of their
scores; as queries they are one as well, each candidate counting by its best score. A query does not
find rows of its own id. Ties go to the smaller vec_id. Queries are all rows whose id is divisible by `EVERY`; a
null id takes no part. Tables without usable vectors give no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.shipping import ship
from .common import staged, table, trimmed

SAMPLE, CENTROIDS, LIST = 32_768, 4096, 256
#: Distance ratio up to which a vector is replicated, with the most copies of a vector.
COPY_RATIO, COPIES = 1.03, 2
#: Share of their nearest that the sample's queries must find, and how many queries set the ratio.
GOAL, TRIALS = 0.95, 256
#: Links of a centroid to near and to far ones; beams of vectors to post and of queries; nodes that a step opens.
DEGREE, FAR, HOME_BEAM, LOOK_BEAM, STEP = 24, 4, 16, 32, 4
BLOCK, FIRST = 2048, 6
EVERY, TOP = 20, 20


def balanced_centroids(x: np.ndarray, k: int, seed: int = 5) -> np.ndarray:
    """k means of equal parts: the largest part is cut in half along its 2-means axis until there are k."""
    rng = np.random.default_rng(seed)
    heap = [(-len(x), 0, np.arange(len(x)))]
    n = 1
    while len(heap) < k and -heap[0][0] > 1:
        _, _, rows = heapq.heappop(heap)
        part = x[rows]
        a, b = part[rng.choice(len(part), 2, replace=False)]
        for _ in range(4):
            side = part @ (a - b)
            order = np.argsort(side, kind="stable")
            half = len(part) // 2
            a, b = part[order[half:]].mean(axis=0), part[order[:half]].mean(axis=0)
        for rows_ in (rows[order[:half]], rows[order[half:]]):
            heapq.heappush(heap, (-len(rows_), n, rows_))
            n += 1
    return np.array([x[rows].mean(axis=0) for _, _, rows in heap])


class Graph:
    """Centroids with links to their nearest, to some far ones and to the next, so that all can be reached; best-first search."""

    def __init__(self, centroids: np.ndarray, seed: int = 6):
        self.c = np.ascontiguousarray(centroids, np.float32)
        self.square = np.einsum("ij,ij->i", self.c, self.c)
        k, rng = len(self.c), np.random.default_rng(seed)
        near = min(DEGREE, k - 1)
        links = []
        for at in range(0, k, 512):
            d = self.square[None, :] - 2 * self.c[at : at + 512] @ self.c.T
            d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
            links.append(np.argpartition(d, max(0, near - 1), axis=1)[:, :near] if near else np.empty((len(d), 0), int))
        own = np.arange(k)[:, None]
        links = np.concatenate([np.concatenate(links), (own + 1) % k, rng.integers(0, k, (k, FAR))], axis=1)
        links.sort(axis=1)
        again = np.concatenate([np.zeros((k, 1), bool), links[:, 1:] == links[:, :-1]], axis=1)
        self.links = np.where(again, own, links)  # a centroid is known where its own links are followed
        self.entries = rng.choice(k, min(k, 8), replace=False)

    def distances(self, q: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Squared distances of each vector of q to its own row of centroids."""
        return np.maximum(self.square[at] - 2 * np.einsum("bld,bd->bl", self.c[at], q) + np.einsum("bd,bd->b", q, q)[:, None], 0)

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """For each vector of q the `beam` nearest centroids found and their squared distances, nearest first; all, if there are no more."""
        n, k = len(q), len(self.c)
        beam = min(beam, k)
        rows = np.arange(n)[:, None]
        ids = np.tile(self.entries, (n, 1))
        d = self.distances(q, ids)
        seen = np.zeros((n, k), bool)
        seen[rows, ids] = True
        opened = np.zeros(ids.shape, bool)
        live = np.arange(n)
        out_ids, out_d = np.zeros((n, beam), np.int64), np.full((n, beam), np.inf, np.float32)
        while True:
            order = np.argsort(d, axis=1, kind="stable")[:, :beam]
            ids, d, opened = (np.take_along_axis(x, order, axis=1) for x in (ids, d, opened))
            done = (opened | np.isinf(d)).all(axis=1)
            if done.any():
                out_ids[live[done], : ids.shape[1]], out_d[live[done], : ids.shape[1]] = ids[done], d[done]
                live, ids, d, opened, seen, q = (x[~done] for x in (live, ids, d, opened, seen, q))
            if not len(live):
                return out_ids, out_d
            rows = np.arange(len(live))[:, None]
            nearest = np.argsort(opened | np.isinf(d), axis=1, kind="stable")[:, :STEP]  # the nearest that aren't opened
            opened[rows, nearest] = True
            found = self.links[ids[rows, nearest]].reshape(len(live), -1)
            found.sort(axis=1)
            new = ~seen[rows, found]
            new[:, 1:] &= found[:, 1:] != found[:, :-1]
            seen[rows, found] = True
            ids = np.concatenate([ids, found], axis=1)
            d = np.concatenate([d, np.where(new, self.distances(q, found), np.inf)], axis=1)
            opened = np.concatenate([opened, ~new], axis=1)


class Index:
    """The part that every executor holds: bound of the norms, graph, ratio up to which a query looks."""

    def __init__(self, norm: float, centroids: np.ndarray):
        self.norm, self.graph, self.ratio = norm, Graph(centroids), 1.0

    def lift(self, x: np.ndarray, query: bool) -> np.ndarray:
        if query:
            y = x / np.linalg.norm(x, axis=1, keepdims=True)
            return np.concatenate([y, np.zeros((len(y), 1))], axis=1).astype(np.float32)
        y = x / self.norm
        rest = np.sqrt(np.maximum(0, 1 - np.einsum("ij,ij->i", y, y)))
        return np.concatenate([y, rest[:, None]], axis=1).astype(np.float32)

    def homes(self, x: np.ndarray) -> list[np.ndarray]:
        """Posting lists of each vector."""
        out = []
        for at in range(0, len(x), 512):
            ids, d = self.graph.search(self.lift(x[at : at + 512], False), HOME_BEAM)
            count = np.clip((d <= d[:, :1] * COPY_RATIO**2).sum(axis=1), 1, COPIES)
            out += [row[:c] for row, c in zip(ids, count)]
        return out

    def looks(self, x: np.ndarray) -> list[np.ndarray]:
        """Posting lists that each query looks into, nearest first: two at least."""
        out: list[np.ndarray] = []
        for at in range(0, len(x), 128):
            q = self.lift(x[at : at + 128], True)
            part: list[np.ndarray | None] = [None] * len(q)
            left, beam = np.arange(len(q)), LOOK_BEAM
            while len(left):
                ids, d = self.graph.search(q[left], beam)
                within = d <= np.maximum(d[:, :1], 1e-12) * self.ratio**2
                count = np.maximum(within.sum(axis=1), min(2, ids.shape[1]))
                full = within.all(axis=1) & (beam < len(self.graph.c))  # the ratio may not be passed yet
                for i, row, c in zip(left[~full], ids[~full], count[~full]):
                    part[i] = row[:c]
                left, beam = left[full], 4 * beam
            out += part
        return out

    def calibrate(self, x: np.ndarray, top: int, seed: int = 8) -> None:
        """Set the ratio with which TRIALS vectors of the sample x look into lists of the share GOAL of their nearest in it."""
        if len(x) < 2:
            return
        who = np.random.default_rng(seed).choice(len(x), min(TRIALS, len(x)), replace=False)
        score = x[who] @ x.T
        score[np.arange(len(who)), who] = -np.inf
        top = min(top, len(x) - 1)
        near = np.argpartition(score, len(x) - top, axis=1)[:, len(x) - top :]
        q = self.lift(x[who], True)
        d = np.maximum(self.graph.square[None, :] - 2 * q @ self.graph.c.T + 1, 1e-12)
        homes = self.homes(x[near.reshape(-1)])
        own = np.repeat(np.arange(len(who)), top)
        best = np.array([d[i, h].min() for i, h in zip(own, homes)])
        self.ratio = float(np.sqrt(np.quantile(best / d.min(axis=1)[own], GOAL))) * (1 + 1e-6)


def usable(df: DataFrame) -> DataFrame:
    """vec_id, v (double array) of the vectors that take part."""
    v = F.col("embedding").cast("array<double>")
    fine = F.col("vec_id").isNotNull() & v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    return df.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter(fine)


def fitted(vectors: DataFrame, top: int = TOP) -> Index | None:
    """Centroids and ratio from the sample; the number of lists grows with the table up to CENTROIDS."""
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    sizes = vectors.groupBy(F.size("v").alias("width")).agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("norm"))
    known = sizes.orderBy(F.desc("n"), "width").first()
    if known is None:
        return None
    share = min(1.0, SAMPLE / known["n"])
    drawn = vectors.filter((F.size("v") == known["width"]) & (F.xxhash64("vec_id", F.lit(3)).bitwiseAND((1 << 30) - 1) < int(share * (1 << 30)) + 1)).limit(2 * SAMPLE).select("vec_id", "v").toPandas()
    if not len(drawn):  # one id holds nearly all rows, and wasn't drawn
        drawn = vectors.filter(F.size("v") == known["width"]).limit(SAMPLE).select("vec_id", "v").toPandas()
    x = np.stack(drawn.sort_values("vec_id")["v"].to_numpy()).astype(np.float64)
    y = x / known["norm"]
    y = np.concatenate([y, np.sqrt(np.maximum(0, 1 - (y * y).sum(axis=1)))[:, None]], axis=1)
    index = Index(known["norm"], balanced_centroids(y, int(min(CENTROIDS, max(1, known["n"] // LIST), len(y)))))
    index.calibrate(x, top)
    return index


def _rows(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    v = batch.column("v")
    batch = batch.filter(pc.equal(pc.list_value_length(v), width))
    return batch.column("vec_id").to_numpy(), batch.column("v").flatten().to_numpy().reshape(-1, width)


def _placed(df: DataFrame, shared, width: int, looking: bool, kind: str) -> DataFrame:
    """A row for each list of each vector: list, nth (0 for the nearest), salt (counts a task's rows), vec_id, v."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = 0
        for batch in batches:
            ids, x = _rows(batch, width)
            for at in range(0, len(ids), 2000):
                part = x[at : at + 2000]
                lists = shared.value.looks(part) if looking else shared.value.homes(part)
                count = [len(h) for h in lists]
                row = np.repeat(np.arange(len(part)), count)
                raw = [r.tobytes() for r in part.astype(kind)]
                nth = np.concatenate([np.arange(c, dtype=np.int32) for c in count])
                salt, done = np.arange(done, done + len(row), dtype=np.int64), done + len(row)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(lists).astype(np.int32)), pa.array(nth), pa.array(salt), pa.array(ids[at : at + 2000][row]), pa.array([raw[i] for i in row], pa.binary())], ["list", "nth", "salt", "vec_id", "v"])

    return df.mapInArrow(trimmed(run), "list int, nth int, salt long, vec_id long, v binary")


def _scored(blocks: DataFrame, asked: DataFrame, kind: str, top: int) -> DataFrame:
    """(query_id, vec_id, score) of asked (list, block, vec_id, v, least) against blocks: at most the best of a block, of these none below least."""
    n = max(1, int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cols = ["list", "block", "query", "vec_id", "v", "least"]
    both = blocks.select("list", "block", F.lit(False).alias("query"), "vec_id", "v", F.lit(None).cast("double").alias("least")).unionByName(asked.withColumn("query", F.lit(True)).select(*cols))

    def best(q_ids: list, q: list, least: list, ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        who, vec, score = [], [], []
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))  # rows of one id count once
        several, name, of = len(first) < len(ids), ids[first], np.cumsum(np.concatenate([[True], ids[1:] != ids[:-1]])) - 1
        x32, reach = x.astype(np.float32), float(np.linalg.norm(x, axis=1).max())
        for at in range(0, len(q), 256):
            own, edge = np.array(q_ids[at : at + 256]), np.array(least[at : at + 256])
            y = np.stack(q[at : at + 256])
            s = y.astype(np.float32) @ x32.T  # to choose; scores are taken in double precision
            slack = 1e-4 * np.maximum(1, np.linalg.norm(y, axis=1) * reach)
            if len(name) > 4 * top and np.isinf(edge).any():  # what is not among a query's best of the block is not among its best
                each = np.maximum.reduceat(s, first, axis=1) if several else s.copy()
                each[own[:, None] == name[None, :]] = -np.inf
                edge = np.maximum(edge, np.partition(each, len(name) - top, axis=1)[:, len(name) - top])
            i, j = np.nonzero(s >= (edge - slack).astype(np.float32)[:, None])
            other = own[i] != ids[j]
            i, j = i[other], j[other]
            exact = (x[j] * y[i]).sum(axis=1)
            if several and len(i):  # of an id's rows the best; (i, of[j]) come in order
                cut = np.flatnonzero(np.concatenate([[True], (i[1:] != i[:-1]) | (of[j][1:] != of[j][:-1])]))
                exact = np.maximum.reduceat(exact, cut)
                i, j = i[cut], j[cut]
            who.append(own[i])
            vec.append(ids[j])
            score.append(exact)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), k) for c, k in zip((who, vec, score), (pa.int64(), pa.int64(), pa.float64()))], ["query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, x, q_ids, q, least, matrix = None, [], [], [], [], [], None

        for batch in batches:
            for list_, block, query, vec_id, v, edge in zip(*(batch.column(c).to_pylist() for c in cols)):
                if (list_, block) != now:
                    if q and ids:
                        yield best(q_ids, q, least, np.array(ids), np.stack(x) if matrix is None else matrix)
                    now, ids, x, q_ids, q, least, matrix = (list_, block), [], [], [], [], [], None
                row = np.frombuffer(v, kind).astype(np.float64)
                if not query:
                    ids.append(vec_id)
                    x.append(row)
                    continue
                q_ids.append(vec_id)
                q.append(row)
                least.append(-np.inf if edge is None else edge)
                if len(q) == 2048 and ids:
                    matrix = np.stack(x) if matrix is None else matrix
                    yield best(q_ids, q, least, np.array(ids), matrix)
                    q_ids, q, least = [], [], []
        if q and ids:
            yield best(q_ids, q, least, np.array(ids), np.stack(x) if matrix is None else matrix)

    return both.repartition(n, "list", "block").sortWithinPartitions("list", "block", "query").mapInArrow(trimmed(run), "query_id long, vec_id long, score double")


def _best(found: DataFrame, top: int) -> DataFrame:
    """query_id, best: the first `top` of its (-score, vec_id), without repeats from replicas."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def search(df: DataFrame, every: int = EVERY, top: int = TOP) -> DataFrame:
    """query_id, rank, vec_id, score of each query's nearest found.

    The nearest `FIRST` lists give each query a score that its best must reach; of the other lists
    only candidates that reach it are passed on. Queries that still lack some are scored against every list.
    """
    spark = df.sparkSession
    ship(spark)
    kind = "<f4" if df.schema["embedding"].dataType.elementType.simpleString() == "float" else "<f8"
    vectors = usable(df)
    index = fitted(vectors, top)
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shared = spark.sparkContext.broadcast(index)
    width = index.graph.c.shape[1] - 1
    posted = staged(_placed(vectors, shared, width, False, kind), "postings")
    sizes = staged(posted.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")), "sizes")  # a row a list
    blocks = posted.join(sizes, "list").withColumn("block", F.pmod(F.xxhash64("vec_id", "salt"), F.col("blocks")).cast("int")).drop("salt")
    asked = _placed(vectors.filter(F.col("vec_id") % every == 0), shared, width, True, kind).drop("salt")
    asked = staged(asked.join(sizes, "list").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks"), "asked")
    near = staged(_best(_scored(blocks, asked.filter(F.col("nth") < FIRST).withColumn("least", F.lit(None).cast("double")), kind, top), top), "near")
    least = near.filter(F.col("rank") == top).select(F.col("query_id").alias("vec_id"), F.col("score").alias("least"))
    more = _scored(blocks, asked.filter(F.col("nth") >= FIRST).join(least, "vec_id", "left"), kind, top)
    found = staged(_best(near.select("query_id", "vec_id", "score").unionByName(more), top).select("query_id", "rank", "vec_id", "score"), "found")
    full = found.filter(F.col("rank") == top).select(F.col("query_id").alias("vec_id"))
    short = asked.filter("nth = 0").dropDuplicates(["vec_id", "v"]).join(full, "vec_id", "left_anti").select("vec_id", "v")
    if short.isEmpty():
        return found
    lists = F.sequence(F.lit(0), F.lit(len(index.graph.c) - 1))
    again = short.withColumn("least", F.lit(None).cast("double")).withColumn("list", F.explode(lists)).join(sizes, "list")
    again = again.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    rest = _best(_scored(blocks, again, kind, top), top).select("query_id", "rank", "vec_id", "score")
    return found.join(full.withColumnRenamed("vec_id", "query_id"), "query_id", "left_semi").unionByName(rest)


def op5_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))
