"""Mixing sources to target weights by pivotal dependent rounding (DataFrame functions only).

Every document of a source starts with the same expected number of copies, its source's target
over its source's size. The whole part is taken outright. The fractional parts are rounded
together: two documents exchange words until one of them is taken whole or not at all, in a random
direction that keeps each one's expectation, and the other carries the rest on. A block of
`BLOCK` documents leaves one such carrier, the carriers of `BLOCK` blocks leave one again, and so on
up a reduction tree. The `BLOCK` longest documents of a source go first, each against all shorter
ones together, so that what a source takes differs from its target by less than one of the others.

Defined results
---------------
* Null text, and text of white space only, has size 0 and is taken 0 times beyond the whole part.
* A null source is a source of its own, the last in order.
* Rows that repeat both doc_id and source are rounded as one item of their joint size.
* An empty table gives an empty result; further columns of the input are kept, and clashing ones
  (size, source_size, target, copies, taken) are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged, table, with_rank

#: Documents or carriers that one fold rounds.
BLOCK = 32
#: Weights of the sources in code-point order, repeating; the most copies of a source.
WEIGHTS, MOST = (1, 2, 3), 3
OWN = ["size", "source_size", "target", "copies", "taken"]


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, _sk (its place), source_size, target: shares of all sizes by weight, filled up to `most` times the source.

    The level at which shares stop is found by resharing the excess until no source is above; each
    round is one small aggregate over the sources.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = with_rank(sums, [F.col("source").asc_nulls_last()], "_place", "sources")
    ranked = staged(ranked.withColumn("_weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("_place") % len(weights)).cast("int") + 1).cast("double")), "weights")
    cap = F.col("source_size") * float(most)
    total = ranked.agg(F.sum("source_size").cast("double"), F.sum("_weight")).first()
    if not total[0]:
        return ranked.select("source", F.col("_place").alias("_sk"), "source_size", F.lit(0.0).alias("target"))
    level, full = total[0] / total[1], -1
    while True:
        above = cap <= F.col("_weight") * F.lit(level)
        held, n, open_weight = ranked.agg(F.sum(F.when(above, cap).otherwise(0.0)), F.count_if(above), F.sum(F.when(above, 0.0).otherwise(F.col("_weight")))).first()
        if n == full or not open_weight:
            break
        level, full = (total[0] - held) / open_weight, n
    return ranked.select("source", F.col("_place").alias("_sk"), "source_size", F.least(cap, F.col("_weight") * F.lit(level)).alias("target"))


def _uniform(*keys: Column) -> Column:
    return F.xxhash64(*keys).bitwiseAND((1 << 53) - 1) / float(1 << 53)


def _fold(items: Column, seed: int) -> Column:
    """Pivotal rounding of an array of (rn, z, m): size z, mass 0 < m < z. Returns the last carrier and what is settled."""
    nothing = F.struct(F.lit(None).cast("long").alias("rn"), F.lit(0.0).alias("z"), F.lit(0.0).alias("m"))
    empty = F.array().cast("array<struct<rn:bigint,up:boolean>>")
    said = lambda rn, up: F.struct(rn.alias("rn"), F.lit(up).alias("up"))
    item = lambda rn, z, m: F.struct(rn.alias("rn"), z.alias("z"), m.alias("m"))

    def step(acc: Column, x: Column) -> Column:
        a = acc["carry"]
        both = a["m"] + x["m"]
        up, down = F.least(a["z"] - a["m"], x["m"]), F.least(a["m"], x["z"] - x["m"])
        first = _uniform(a["rn"], x["rn"], F.lit(seed)) * (up + down) < down  # then a gains, x gives
        hi, lo = F.when(first, a).otherwise(x), F.when(first, x).otherwise(a)
        filled = both >= hi["z"]
        settled = F.when(filled, said(hi["rn"], True)).otherwise(said(lo["rn"], False))
        carry = F.when(filled, item(lo["rn"], lo["z"], both - hi["z"])).otherwise(item(hi["rn"], hi["z"], both))
        return F.when(a["rn"].isNull(), F.struct(x.alias("carry"), acc["done"].alias("done"))).otherwise(F.struct(carry.alias("carry"), F.concat(acc["done"], F.array(settled)).alias("done")))

    return F.aggregate(items, F.struct(nothing.alias("carry"), empty.alias("done")), step)


def pivotal_round(items: DataFrame, seed: int) -> DataFrame:
    """(group, rn, z, m) to (rn, up): rn numbers the items from 0, groups standing together in that order."""
    level = staged(items.withColumn("_block", F.col("rn")), "level")
    last = level.agg(F.max("_block")).first()[0]
    settled = []
    while last is not None:
        level = level.withColumn("_block", F.floor(F.col("_block") / BLOCK))
        packed = level.groupBy("group", "_block").agg(F.array_sort(F.collect_list(F.struct("rn", "z", "m"))).alias("items"))
        folded = staged(packed.select("group", "_block", _fold(F.col("items"), seed).alias("f")), "folded")
        settled.append(folded.select(F.explode("f.done").alias("d")).select("d.rn", "d.up"))
        level = folded.select("group", "f.carry.rn", "f.carry.z", "f.carry.m", "_block")
        if last < BLOCK:
            break
        last //= BLOCK
    settled.append(level.select("rn", (_uniform(F.col("rn"), F.lit(seed + 1)) * F.col("z") < F.col("m")).alias("up")))
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    return out


def _settle_longest(items: Column, size: Column, mass: Column, seed: int) -> Column:
    """Round the longest documents of a source, each against the pool of all after it.

    A pool's documents share one fraction. A document is taken whole with that probability, and the
    pool's fraction moves so that the source's mass stays; where the pool can't make up for it, the
    document keeps its fraction for the tree. Returns (z, m of the pool, done of (rn, share)).
    """
    empty = F.array().cast("array<struct<rn:bigint,share:double>>")

    def step(acc: Column, x: Column) -> Column:
        share = acc["m"] / acc["z"]
        able = (acc["m"] >= x["z"]) & (acc["m"] <= acc["z"] - x["z"])
        got = F.when(~able, share).when(_uniform(x["rn"], F.lit(seed)) < share, 1.0).otherwise(0.0)
        return F.struct((acc["z"] - x["z"]).alias("z"), F.greatest(acc["m"] - got * x["z"], F.lit(0.0)).alias("m"), F.concat(acc["done"], F.array(F.struct(x["rn"].alias("rn"), got.alias("share")))).alias("done"))

    return F.aggregate(items, F.struct(size.alias("z"), mass.alias("m"), empty.alias("done")), step)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = 20) -> DataFrame:
    """Every row of docs with size, source_size, target, copies and taken = copies * size."""
    docs = docs.drop(*OWN)
    sized = staged(docs.select("doc_id", "source", words(F.col("text")).alias("size")), "sized")
    targets = source_targets(sized, weights, most)
    items = sized.groupBy("doc_id", "source").agg(F.sum("size").alias("z"))
    items = items.alias("i").join(targets.alias("t"), F.col("i.source").eqNullSafe(F.col("t.source"))).select("i.doc_id", "i.source", "_sk", F.col("z").cast("double").alias("z"), "source_size", "target", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("_ratio"))
    order = [F.col("_sk"), F.col("z").desc(), F.xxhash64("doc_id", F.lit(seed)), F.col("doc_id")]
    items = staged(with_rank(items, order, "rn", "ranked"), "items")
    open_items = items.filter((F.col("z") > 0) & (F.col("_ratio") > F.floor("_ratio"))).withColumn("m", (F.col("_ratio") - F.floor("_ratio")) * F.col("z"))
    heads = open_items.groupBy("_sk").agg(F.min("rn").alias("_first"), F.sum("z").alias("_z"), F.sum("m").alias("_m"))
    longest = open_items.join(heads, "_sk").filter(F.col("rn") < F.col("_first") + BLOCK)
    longest = longest.groupBy("_sk").agg(F.first("_first").alias("_first"), F.first("_z").alias("_z"), F.first("_m").alias("_m"), F.array_sort(F.collect_list(F.struct("rn", "z"))).alias("_items"))
    pools = staged(longest.select("_sk", "_first", _settle_longest(F.col("_items"), F.col("_z"), F.col("_m"), seed + 2).alias("f")), "pools")
    first = pools.select("_sk", F.explode("f.done").alias("d")).select("_sk", "d.rn", "d.share")
    rest = open_items.join(pools, "_sk").filter(F.col("rn") >= F.col("_first") + BLOCK).select("_sk", "rn", "z", F.least(F.lit(1.0), F.col("f.m") / F.col("f.z")).alias("share"))
    shares = staged(rest.unionByName(open_items.join(first, ["_sk", "rn"]).select("_sk", "rn", "z", "share")), "shares")
    halves = shares.filter((F.col("share") > 0) & (F.col("share") < 1)).select(F.col("_sk").alias("group"), "rn", "z", (F.col("share") * F.col("z")).alias("m"))
    rounded = pivotal_round(halves, seed).unionByName(shares.filter((F.col("share") <= 0) | (F.col("share") >= 1)).select("rn", (F.col("share") >= 1).alias("up")))
    copies = items.join(rounded, "rn", "left").select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), "source_size", "target", (F.floor("_ratio") + F.coalesce(F.col("up").cast("long"), F.lit(0))).alias("copies"))
    joined = docs.join(copies, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_source"))).drop("_id", "_source")
    return joined.withColumn("size", words(F.col("text"))).withColumn("taken", F.col("copies") * F.col("size"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of docs."""
    names = [c for c in docs.columns]
    return mix(docs, **options).filter("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*names)


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken")
