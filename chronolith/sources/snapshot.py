"""Snapshots: a folder of Parquet tables and a manifest that is written last, so that readers see all or nothing."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save(tables: dict[str, DataFrame], folder: str, version: int) -> dict[str, int]:
    """Write every table under ``version`` and then the manifest with row counts; returns the counts."""
    counts = {}
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/v{version}/{name}")
        counts[name] = df.sparkSession.read.parquet(f"{folder}/v{version}/{name}").count()
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(version, json.dumps(counts))], "version long, counts string").coalesce(1).write.mode("append").json(f"{folder}/manifest")
    return counts


def latest(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of the newest version that its manifest completes."""
    row = spark.read.schema("version long, counts string").json(f"{folder}/manifest").orderBy(F.desc("version")).first()
    return {name: spark.read.parquet(f"{folder}/v{row['version']}/{name}") for name in json.loads(row["counts"])}


def verify(tables: dict[str, DataFrame], counts: dict[str, int]) -> list[str]:
    """Tables whose row count differs from the manifest's."""
    return [name for name, n in counts.items() if tables[name].count() != n]
