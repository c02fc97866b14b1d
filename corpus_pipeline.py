"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but the last return the
columns of documents. No stage can be said in SQL (compression lengths, sketches, suffix order,
keyed hashes, tokenizers), so `ORACLE_SQL` is None and tests hold the stages against brute force.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import near_dedup, packing, pii, suffix_dedup, toxicity
from quire.llm.common import read_table, shared_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
ORACLE_SQL = None


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below the rejection threshold (nulls and empty texts are kept)."""
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where(F.col("score") < toxicity.REJECT).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class of near copies (a null id last), one text of each class."""
    classes = near_dedup.near_classes(docs)
    first = classes.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("_id"), F.col("node").alias("_node"))).alias("m")).select("m._id", "m._node")
    kept = docs.withColumn("_own", F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    return kept.join(first, (kept["_own"] == first["_node"]) & kept["doc_id"].eqNullSafe(first["_id"])).select(*(kept[c] for c in COLUMNS)).dropDuplicates(["doc_id", "text"])


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the byte strings of documents before them; those left without text go."""
    cut = suffix_dedup.remove_repeats(docs, with_text=True).where("n_bytes = 0 OR n_removed < n_bytes")
    cut = cut.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text"), F.col("text_md5").alias("_md5")).distinct()
    named = docs.withColumn("_own", F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    joined = named.join(cut, named["doc_id"].eqNullSafe(cut["_id"]) & (named["_own"] == cut["_md5"]))
    return _counted(joined.drop("text").withColumnRenamed("_text", "text"))


def replace_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates for personal data."""
    return _counted(pii.replace_entities(docs, spark.conf.get(pii.KEY_SETTING, pii.KEY)))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces in sequences of at most 2048 tokens."""
    return packing.pack(packing.cut_pieces(docs)).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_copies), ("suffix_dedup", cut_repeats), ("pii", replace_private), ("packing", pack_sequences)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written to the shared folder and read from there."""
    docs = read_table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
