"""Stored results, shared by all sessions: keyed by what was asked and by the versions of the tables that were read.

A key is the digest of a query's name, its parameters and the version of every table; a write makes another version, so
an old result is never found again, and results of the same question at other versions go when a new one is
stored. A result is written beside its place and moved there whole: readers see all of it or nothing, and of two
writers the first one's stays. Number and age of results are bounded.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Results:
    """Where results are kept, how many at most, and for how many seconds (None: for ever)."""

    folder: str
    most: int = 64
    seconds: int | None = None


def _digest(*parts) -> str:
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()[:32]


def _files(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def entries(spark: SparkSession, results: Results) -> list[tuple[int, str, str]]:
    """(stored at, question, key) of every result, oldest first; there are ``most`` and some being written."""
    fs, path = _files(spark, results.folder)
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory()]
    found = [n.split("-") for n in names if not n.startswith("_") and n.count("-") == 2]
    return sorted((int(at), question, key) for at, question, key in found)


def _drop(spark: SparkSession, results: Results, entry: tuple[int, str, str]) -> None:
    fs, path = _files(spark, f"{results.folder}/{entry[0]}-{entry[1]}-{entry[2]}")
    fs.delete(path, True)


def expire(spark: SparkSession, results: Results, now: int, room: int = 0) -> None:
    """Drop results that are too old, and the oldest ones beyond the number that leaves ``room`` for more."""
    there = entries(spark, results)
    old = [e for e in there if results.seconds is not None and now - e[0] > results.seconds]
    fresh = [e for e in there if e not in old]
    for entry in old + fresh[: max(0, len(fresh) + room - results.most)]:
        _drop(spark, results, entry)


def cached(spark: SparkSession, results: Results, name: str, parameters: dict, versions: dict[str, object], compute: Callable[[], DataFrame], now: int) -> DataFrame:
    """The stored result of this question at these table versions; where there is none, ``compute()``'s, stored.

    ``versions`` names every table that is read. A result older than ``seconds`` is computed again.
    """
    question, key = _digest(name, parameters), _digest(name, parameters, versions)
    expire(spark, results, now)
    for at, _, own in entries(spark, results):
        if own == key:
            return spark.read.parquet(f"{results.folder}/{at}-{question}-{key}")
    fresh = f"{results.folder}/_{uuid.uuid4().hex}"
    compute().write.parquet(fresh)
    for entry in entries(spark, results):
        if entry[1] == question and entry[2] != key:
            _drop(spark, results, entry)
    expire(spark, results, now, 1)
    fs, path = _files(spark, fresh)
    place = f"{results.folder}/{now}-{question}-{key}"
    if fs.exists(_files(spark, place)[1]) or not fs.rename(path, _files(spark, place)[1]):
        fs.delete(path, True)  # another writer was first
    return spark.read.parquet(place)


def ledger_version(spark: SparkSession, folder: str) -> int:
    """The version of an ingested store: its last whole batch, -1 before the first."""
    fs, path = _files(spark, f"{folder}/ledger")
    if not fs.exists(path):
        return -1
    return spark.read.parquet(f"{folder}/ledger").agg(F.max("batch")).first()[0]
