"""The inverted file against exact search: recall, pruning, growth, odd vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolith.operators import search, vector_index

KEY = ("id",)


@pytest.fixture(scope="module")
def vectors(spark, tables):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 24))
    rows = [(i, (centres[i % 40] + rng.normal(size=24) * 0.6).astype(np.float32).tolist()) for i in range(5000)]
    rows += [(9000, [0.0] * 24), (9001, [1.0, 2.0]), (9002, None), (9003, rows[7][1]), (9004, [])]
    return spark.createDataFrame(rows, "id long, vector array<float>").repartition(6).cache()


@pytest.fixture(scope="module")
def asked(vectors):
    return vectors.where("id % 100 = 0").select(F.col("id").alias("query_id"), "vector")


@pytest.fixture(scope="module")
def index(vectors, tmp_path_factory):
    return vector_index.build(vectors, str(tmp_path_factory.mktemp("ivf")), KEY)


def rows(df):
    return sorted((r["query_id"], r["rank"], r["id"], r["score"]) for r in df.collect())


def test_recall_and_exactness(spark, vectors, asked, index):
    exact = search.vector_topk(vectors, asked.where("query_id < 9000"), 10, KEY)
    found = vector_index.index_topk(index, asked.where("query_id < 9000"), 10)
    recall = vector_index.recall_against(found, exact, KEY).agg(F.avg("recall"), F.min("recall")).first()
    assert recall[0] >= 0.9
    whole = vector_index.index_topk(index, asked.where("query_id < 9000"), 10, probes=len(index.centres), rerank=30)
    assert rows(whole) == rows(exact)
    assert 1 < index.probes < len(index.centres) / 2
    few = vector_index.index_topk(index, asked.where("query_id < 9000"), 10, probes=1)
    assert vector_index.recall_against(few, exact, KEY).agg(F.avg("recall")).first()[0] <= recall[0]


def test_every_indexed_row_is_in_one_cell(spark, vectors, index):
    kept = vector_index.load(spark, index.folder)
    assert kept.key == KEY and kept.probes == index.probes and np.allclose(kept.centres, index.centres)
    stored = kept.rows(spark)
    assert stored.count() == 5002 and stored.select("id").distinct().count() == 5002  # all but other lengths and nulls
    assert stored.select("cell").distinct().count() > 40


def test_only_probed_cells_are_read(spark, asked, index):
    one = asked.where("query_id = 100")
    found = vector_index.index_topk(index, one, 5, probes=3)
    plan = found._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan or "PartitionFilters: [cell" in plan
    cells = [int(c) for c in np.flatnonzero(vector_index.probed(index, vector_index._unit(one.toArrow().column("vector").combine_chunks(), 24)[1], 3)[0])]
    read = {f.split("cell=")[1].split("/")[0] for f in index.rows(spark).where(F.col("cell").isin(cells)).inputFiles() if "cell=" in f}
    assert len(cells) == 3 and found.count() == 5
    used = index.rows(spark).where(F.col("cell").isin(cells)).select(F.input_file_name()).distinct().count()
    assert used < len(read) or len(read) == 3


def test_rows_can_be_added(spark, vectors, asked, tmp_path):
    index = vector_index.build(vectors.where("id < 4000"), str(tmp_path / "grow"), KEY, cells=30)
    vector_index.add(index, vectors.where("id >= 4000"))
    exact = search.vector_topk(vectors, asked.where("query_id < 9000"), 10, KEY)
    assert rows(vector_index.index_topk(index, asked.where("query_id < 9000"), 10, probes=30, rerank=30)) == rows(exact)


def test_adaptive(spark, vectors, asked, index, monkeypatch):
    assert rows(vector_index.adaptive_topk(vectors.where("id < 900"), index, asked, 3, key=KEY)) == rows(search.vector_topk(vectors.where("id < 900"), asked, 3, KEY))
    odd = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, [0.5] * 24)], "query_id long, vector array<float>")
    got = rows(vector_index.adaptive_topk(vectors, index, odd, 3, key=KEY))
    assert [r for r in got if r[0] == 1] == rows(search.vector_topk(vectors, odd.where("query_id = 1"), 3, KEY)) and len([r for r in got if r[0] == 3]) == 3
    monkeypatch.setattr(vector_index, "LEAST_ROWS", 1)
    # cells that hold fewer than k rows: the exact search fills in
    many = vector_index.adaptive_topk(vectors, index, asked.where("query_id = 300"), 400, probes=1, rerank=1, key=KEY)
    assert rows(many) == rows(search.vector_topk(vectors, asked.where("query_id = 300"), 400, KEY))


def test_blocks_of_queries(spark, asked, index, monkeypatch):
    whole = rows(vector_index.index_topk(index, asked, 4))
    monkeypatch.setattr(vector_index, "HELD_QUERIES", 20)
    assert rows(vector_index.index_topk(index, asked, 4)) == whole


def test_recall_on_the_tables(spark, tables):
    from chronolith.plans import queries

    found, exact = queries.QUERIES["vector_index_topk"](spark, tables), queries.QUERIES["vector_topk"](spark, tables)
    assert vector_index.recall_against(found, exact, ("vec_id",)).agg(F.avg("recall")).first()[0] >= 0.9
