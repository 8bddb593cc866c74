"""Commits of several tables: all or nothing, export and import, overtaken commits."""

import pytest
from pyspark.sql import functions as F

from chronolith.sources import store_versions as sv


def store(spark, n=6):
    return {
        "entities": spark.createDataFrame([(f"e{i}", f"name {i}", ["a", None]) for i in range(n)], "id string, name string, tags array<string>"),
        "observations": spark.createDataFrame([(i, f"e{i % n}", f"text {i}") for i in range(20)], "id long, entity_id string, content string"),
        "relations": spark.createDataFrame([(i, f"e{i}", f"e{i + 1}") for i in range(n - 1)], "id long, from_entity string, to_entity string"),
    }


def digests(spark, folder):
    return {name: (held["rows"], held["digest"]) for name, held in sv.manifest(spark, folder)["tables"].items()}


def test_commit_export_import(spark, tmp_path):
    home, copy, other = (str(tmp_path / x) for x in ("home", "copy", "other"))
    assert sv.version(spark, home) == 0 and sv.commit(spark, home, store(spark)).count() == 0
    new = {"observations": spark.createDataFrame([(3, "e0", "rewritten"), (99, "e1", "new")], "id long, entity_id string, content string")}
    assert sv.commit(spark, home, new).count() == 0 and sv.version(spark, home) == 2
    rows = {r["id"]: r["content"] for r in sv.read(spark, home)["observations"].collect()}
    assert len(rows) == 21 and rows[3] == "rewritten" and sv.read(spark, home, 1)["observations"].count() == 20
    sv.export(spark, home, copy)
    assert sv.restore(spark, copy, other).count() == 0
    assert digests(spark, other) == digests(spark, home)
    sv.export(spark, other, str(tmp_path / "again"))
    assert digests(spark, str(tmp_path / "again")) == digests(spark, home)
    spark.createDataFrame([("e9", "x", None)], "id string, name string, tags array<string>").write.mode("append").parquet(f"{copy}/versions/export/entities")
    before = digests(spark, other)
    assert [r["problem"] for r in sv.restore(spark, copy, other).collect()] == ["not what was exported"] and digests(spark, other) == before


def test_a_problem_leaves_the_store_untouched(spark, tmp_path):
    home = str(tmp_path / "home")
    sv.commit(spark, home, store(spark))
    before, files = digests(spark, home), sorted(p.name for p in (tmp_path / "home" / "versions").iterdir())
    cases = {
        "to_entity is not there": {"relations": spark.createDataFrame([(50, "e0", "nobody")], "id long, from_entity string, to_entity string")},
        "repeated key": {"entities": spark.createDataFrame([("x", "a", None), ("x", "b", None)], "id string, name string, tags array<string>")},
        "no key": {"entities": spark.createDataFrame([(None, "a", None)], "id string, name string, tags array<string>")},
        "entity_id is not there": {"entities": store(spark, 9)["entities"], "observations": spark.createDataFrame([(1, "e99", "y")], "id long, entity_id string, content string")},
    }
    for problem, incoming in cases.items():
        assert [r["problem"] for r in sv.commit(spark, home, incoming).collect()] == [problem]
    assert digests(spark, home) == before and sv.version(spark, home) == 1
    assert sorted(p.name for p in (tmp_path / "home" / "versions").iterdir()) == files


def test_an_overtaken_commit_raises(spark, tmp_path, monkeypatch):
    home = str(tmp_path / "home")
    sv.commit(spark, home, store(spark))
    monkeypatch.setattr(sv, "version", lambda *_: 0)  # as a writer sees it that began before
    with pytest.raises(RuntimeError):
        sv.commit(spark, home, store(spark, 4), replace=True)
    monkeypatch.undo()
    assert sv.read(spark, home)["entities"].agg(F.count("*")).first()[0] == 6
