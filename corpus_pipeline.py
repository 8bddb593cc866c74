"""A training-data pipeline over ``documents``: five stages, each one corpus operator.

Every stage takes (spark, docs, sf_dir), docs being all rows its predecessor kept, and returns a
frame that is written as Parquet and read again as the next one's docs. All stages but the last
return the columns of ``documents``; the last returns packed pieces.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.llm import contamination, jaccard, packing, pii, toxicity
from chronolith.llm.frames import durable, shared_folder, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below 0.5; it learns from the stage's own labelled rows."""
    scored = toxicity.with_scores(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")), "__toxicity")
    return scored.where("__toxicity < 0.5").drop("__toxicity")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts whose five-word shingle sets are 0.8 similar, that of the smallest doc_id.

    Rows are told apart by doc_id and text, and one of several equal rows stays; rows without words all stay."""
    n = docs.count()
    keyed = docs.withColumn("__key", F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    groups = jaccard.similarity_groups(keyed.select(F.col("__key").alias("doc_id"), "text"), width=5, percent=80)
    rows = durable(groups.where("n_shingles > 0").select(F.col("doc_id").alias("__key"), "component_id"), rows=n)
    several = rows.groupBy("component_id").agg(F.count("*").alias("k")).where("k > 1").select("component_id")
    members = rows.join(several, "component_id").groupBy("component_id", "__key").agg(F.count("*").alias("copies"))
    named = durable(members.join(keyed.select("__key", "doc_id").distinct(), "__key"), rows=n)
    first = named.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "__key"))["__key"].alias("first"))
    told = durable(named.join(first, "component_id").select("__key", "copies", (F.col("__key") == F.col("first")).alias("stays")), rows=n)
    once = keyed.join(told.where("not stays or copies > 1").select("__key").hint("shuffle_hash"), "__key", "left_anti")
    repeated = keyed.join(told.where("stays and copies > 1").select("__key").hint("shuffle_hash"), "__key", "left_semi").dropDuplicates(["__key"])
    return once.unionByName(repeated).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return contamination.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def pseudonymize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for personal data."""
    return pii.pseudonymized_documents(docs, pii.session_key(spark))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", reject_toxic), ("ngram_jaccard", drop_near_duplicates), ("decontamination", decontaminate), ("pii", pseudonymize), ("packing", pack)]
#: A classifier, connected components and a tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each stage's table lies in the shared checkpoint folder until the next one is
    written, the last one until the caller deletes it."""
    home = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = f"{home}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            _delete(spark, before)
        before = path
    return docs


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
