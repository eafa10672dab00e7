"""A corpus pipeline over `documents`: language ID, near-duplicates, PII, source mixing, BPE.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; `run` applies them in turn, and each result is
written to the folder the cluster shares and read again. All but the last keep the columns of documents.

Defined results: a table without rows gives none at every stage. Language ID drops null texts, texts without letters and those in
no language that it learned; a null or repeated doc_id is kept. The Jaccard join keeps every row without words. PII leaves a null text
null. Mixing takes a null source for a source of its own, and rows that repeat doc_id and source as one item. BPE gives a null or empty text no ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm import bpe, jaccard_join, langid, mixing, pii
from quernstone.llm.common import staged, table


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; the prediction takes the place of lang."""
    found = langid.identify(docs).filter(~F.col("rejected"))
    return found.withColumn("lang", F.col("lang_pred")).select(*docs.columns)


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the least doc_id (a null is the greatest), then the least node; of rows that
    repeat it, one. Rows without shingles are linked with nothing and all stay."""
    nodes, components = jaccard_join.linked_nodes(docs)
    placed = nodes.filter("node IS NOT NULL").join(components, "node", "left").select("doc_id", "node", F.coalesce("component", "node").alias("component"))
    first = placed.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("first"))
    kept = staged(first.select("first.doc_id", "first.node"), "kept")
    if jaccard_join.unnamed(nodes) is None:
        ids = kept.select("doc_id").unionByName(nodes.filter("node IS NULL").select("doc_id"))
        return docs.join(ids, docs["doc_id"].cast("long") == ids["doc_id"], "left_semi")
    rows = jaccard_join.with_node(docs, "_node")
    same = F.col("d.doc_id").cast("long").eqNullSafe(F.col("k.doc_id")) & (F.col("d._node") == F.col("k.node"))
    only = rows.alias("d").join(kept.alias("k"), same, "left_semi").dropDuplicates(["_node"])
    return only.unionByName(rows.filter("_node IS NULL")).drop("_node")


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data masked; n_chars follows the text."""
    names = docs.columns
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*names) if "n_chars" in names else out


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the text decoded from them; a row for each copy."""
    return staged(bpe.encode_decode(docs), "encoded")


STAGES = [("language ID", identified), ("n-gram Jaccard join", deduplicated), ("PII", redacted), ("mixing", mixed), ("BPE", encoded)]

#: The stages are not expressible in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
