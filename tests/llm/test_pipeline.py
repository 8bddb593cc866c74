"""The pipeline's stages, each on its own input, and the registration of the queries."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from chronolith.llm import contamination, jaccard, pii, toxicity

TOXIC = ["trash", "idiot", "stupid", "worthless"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    words = [f"word{i % 97}x{i % 31}" for i in range(4000)]
    rows, labels = [], []
    for i in range(160):
        text = " ".join(words[i * 20 : i * 20 + 60])
        bad = i % 8 == 3
        rows.append((i, (text + " " + " ".join(TOXIC)) if bad else text, "en", "s", len(text)))
        labels.append((i, 1, int(bad)))
    item = " ".join(f"item{k}" for k in range(20))
    rows += [(500, rows[0][1], "en", "s", 1), (501, rows[0][1] + " tail", "en", "s", 1), (502, "start " + item + " end", "en", "s", 1), (503, "write to ann@example.org now", "en", "s", 29), (504, None, "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    seen = []
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        if number < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns and dict(out.dtypes) == dict(docs.dtypes)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen.append({r["doc_id"] for r in docs.select("doc_id").collect()})
    toxic = {i for i in range(160) if i % 8 == 3}
    assert seen[0] == set(range(160)) - toxic | {500, 501, 502, 503, 504}
    assert seen[1] == seen[0] - {500, 501}
    assert seen[2] == seen[1] - {502}
    assert seen[3] == seen[4] == seen[2]
    text = spark.read.parquet(str(tmp_path / "pii")).where("doc_id = 503").first()
    assert "ann@example.org" not in text["text"] and text["n_chars"] == len(text["text"])
    assert docs.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0


def test_run_equals_stages(spark, folder):
    assert corpus_pipeline.run(spark, folder).select("doc_id").distinct().count() == 160 - 20 + 2  # without toxic rows; 503 and 504 beside the rest


def test_registered():
    names = list(__spark_entry__.queries())
    assert [n for n in names if n.startswith("op")] == sorted((n for n in names if n.startswith("op")), key=lambda n: int(n[2:].split("_")[0])) and "pipeline" in names
    assert {int(n[2:].split("_")[0]) for n in names if n.startswith("op")} == set(range(1, 14))
    assert all(callable(f) for f in (toxicity.with_scores, jaccard.similarity_groups, contamination.clean_documents, pii.pseudonymized_documents))


def test_stages_on_empty_tables_and_clashing_columns(spark, folder, tmp_path):
    """No rows, columns named like the operators' own, and a long text."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    odd = docs.withColumns({"score": F.lit("mine"), "key": F.lit(1), "component_id": F.lit(2), "copies": F.lit(3), "spans": F.lit("x"), "hash": F.lit(4), "item": F.lit(5), "length": F.lit(6)})
    long = " ".join(f"long{i}" for i in range(300_000)) + " write to bob@example.org"
    more = spark.createDataFrame([(900, long, "en", "s", len(long)), (901, long, "en", "s", len(long))], "doc_id long, text string, lang string, source string, n_chars long")
    odd = odd.unionByName(more, allowMissingColumns=True)
    for name, frame, least in (("none", odd.where("false"), 0), ("some", odd, 100)):
        rows = frame
        for number, (stage_name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, rows, folder)
            if number < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == odd.columns
            path = str(tmp_path / f"{name}-{stage_name}")
            out.write.parquet(path)
            rows = spark.read.parquet(path)
        assert rows.count() >= least
    kept = spark.read.parquet(str(tmp_path / "some-pii"))
    assert kept.where("doc_id in (900, 901)").count() == 1 and kept.where("doc_id < 10 and score = 'mine'").count() > 5
    text = kept.where("doc_id = 900").first()["text"]
    assert "bob@example.org" not in text and text.startswith(long[:1000]) and len(text.split()) == 300_003


def test_run_deletes_its_stage_tables(spark, folder):
    import glob

    home = spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")
    before = set(glob.glob(f"{home}/pipeline-*/*"))
    out = corpus_pipeline.run(spark, folder)
    new = set(glob.glob(f"{home}/pipeline-*/*")) - before
    assert [p.rsplit("/", 1)[1] for p in new] == ["packing"] and out.count() > 100
