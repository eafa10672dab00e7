"""Connected components by alternating large and small stars, each pass a join and an aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_path, shared_path


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) long edges to (node, component): the least node that is reachable. Nodes without an edge are absent."""
    spark, made = edges.sparkSession, []

    def written(df: DataFrame) -> DataFrame:
        made.append(shared_path(spark, "star"))
        df.write.parquet(made[-1])
        return spark.read.schema("a long, b long").parquet(made[-1])

    edges = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = written(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        edges = written(small)
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if mark == tuple(now):
            break
        mark = tuple(now)
        for path in made[:-1]:
            drop_path(spark, path)
        del made[:-1]
    roots = edges.select("b").distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots.select(F.col("b").alias("node"), F.col("b").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))
