"""A keyword index that is kept: postings in segments, deletions as tombstones, compaction on demand.

A segment holds the postings of one batch of chunks, clustered by term, and the chunks' lengths; a deletion
notes that a uri's rows of all segments so far are gone. Reading is one pass over the segments with an
anti-join on the tombstones, so a search reads postings instead of texts, and adding a batch costs
only that batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.functions.text import tokens
from chronolith.operators.frames import small
from chronolith.operators.search import postings

KEY = ("uri", "chunk_index")


def add(chunks: DataFrame, folder: str, segment: int) -> None:
    """Write one batch as segment; writing a segment again replaces it, so a retried batch leaves one copy."""
    posted = postings(chunks, key=KEY).repartitionByRange("term").sortWithinPartitions("term")
    posted.write.mode("overwrite").parquet(f"{folder}/postings/segment={segment}")
    lengths = chunks.select(*KEY, F.size(tokens(F.col("text"))).cast("double").alias("dl"))
    lengths.write.mode("overwrite").parquet(f"{folder}/chunks/segment={segment}")


def remove(uris: DataFrame, folder: str, segment: int) -> None:
    """Delete uris from all segments up to and including ``segment``; later segments may bring them back."""
    uris.select("uri").distinct().write.mode("overwrite").parquet(f"{folder}/removed/segment={segment}")


def read(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(postings, statistics) as ``search.keyword_topk`` takes them. A chunk that several segments hold counts once, as
    the latest one has it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/removed")
    gone = None
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        gone = spark.read.parquet(f"{folder}/removed").groupBy("uri").agg(F.max("segment").alias("until"))
    chunks = _live(spark.read.parquet(f"{folder}/chunks"), gone)
    latest = chunks.groupBy(*KEY).agg(F.max("segment").alias("segment"), F.max_by("dl", "segment").alias("dl"))
    posted = _live(spark.read.parquet(f"{folder}/postings"), gone).join(latest.select(*KEY, "segment"), [*KEY, "segment"], "left_semi")
    stats = latest.agg(F.count_if(F.col("dl") > 0).alias("n_docs"), F.avg(F.when(F.col("dl") > 0, F.col("dl"))).alias("avg_dl"))
    return posted.select("term", *KEY, "dl", "tf"), stats


def _live(rows: DataFrame, gone: DataFrame | None) -> DataFrame:
    if gone is None:
        return rows
    return rows.join(small(gone), "uri", "left").where("until is null or segment > until").drop("until")


def compact(spark: SparkSession, folder: str, into: str) -> None:
    """Write what is live as one segment of a new folder."""
    posted, _ = read(spark, folder)
    posted.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{into}/postings/segment=0")
    posted.select(*KEY, "dl").distinct().write.mode("overwrite").parquet(f"{into}/chunks/segment=0")
