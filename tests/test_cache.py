"""Stored results: found again, made invalid by writes, bounded in number and age."""

from pyspark.sql import functions as F

from chronolith.operators import cache
from chronolith.streaming import ingest


def test_results_are_found_again(spark, tables, tmp_path):
    calls, results = [], cache.Results(str(tmp_path / "r"), most=3, seconds=100)

    def asked(version=1, now=10, k=3):
        def compute():
            calls.append((version, k))
            return spark.read.parquet(f"{tables}/documents.parquet").groupBy("lang").agg((F.count("*") * k).alias("n"))

        return cache.cached(spark, results, "languages", {"k": k}, {"documents": version}, compute, now)

    first = sorted(map(tuple, asked().collect()))
    again = asked(now=50)
    assert sorted(map(tuple, again.collect())) == first and calls == [(1, 3)]
    assert all("documents" not in f for f in again.inputFiles()) and again.inputFiles()
    assert "documents.parquet" not in again._jdf.queryExecution().toString()
    asked(version=2, now=60)  # a write
    assert calls == [(1, 3), (2, 3)] and len(cache.entries(spark, results)) == 1
    asked(version=2, now=161)  # too old
    assert calls[-1] == (2, 3) and len(calls) == 3
    for k in (4, 5, 6):
        asked(version=2, now=162 + k, k=k)
    assert len(cache.entries(spark, results)) == 3 and len(calls) == 6
    asked(version=2, now=170, k=6)
    asked(version=2, now=170, k=3)  # was pushed out
    assert len(calls) == 7


def test_the_first_writer_stays(spark, tmp_path):
    results = cache.Results(str(tmp_path / "r"))

    def slow():
        cache.cached(spark, results, "q", {}, {"t": 1}, lambda: spark.range(3).toDF("id"), 5)  # meanwhile another session
        return spark.range(7).toDF("id")

    assert cache.cached(spark, results, "q", {}, {"t": 1}, slow, 5).count() == 3
    assert [p.name for p in (tmp_path / "r").iterdir() if p.name.startswith("_")] == []


def test_store_versions(spark, tmp_path):
    folder = str(tmp_path / "s")
    assert cache.ledger_version(spark, folder) == -1
    write = ingest.write_batch(folder)
    for number in (0, 1):
        write(spark.createDataFrame([(number, f"name {number}", "person", ["x"], "chat", 1)], ingest.REQUEST_SCHEMA), number)
        assert cache.ledger_version(spark, folder) == number
