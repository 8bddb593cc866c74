"""An inverted file over vectors: k-means cells as table partitions, residual codes, exact re-ranking.

``build`` fits cell centres on a bounded sample, puts every vector into its nearest cell, and writes the
rows clustered by cell, so that a search for the queries' nearest cells reads only those partitions' files.
A row's code is its residual from the centre in one byte for each dimension; codes pick ``rerank`` candidates a
query, and only these meet the queries' vectors exactly. How many cells a search probes is measured, not guessed:
``calibrated`` asks exactly for a bounded sample of stored vectors and takes the fewest cells that hold the wanted share of
their answers. A search that probes every cell and re-ranks enough is the exact one.

Small stores need no index: ``adaptive_topk`` scans exactly below ``LEAST_ROWS`` vectors, and asks exactly for
queries that their probed cells cannot fill. Null vectors, and those of another length than the index has, are not indexed.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from chronolith.functions.scores import cosine
from chronolith.operators.frames import small, top_k
from chronolith.operators.search import HELD_QUERIES, SLACK, _Floors, vector_topk

#: Vectors below which an exact scan answers.
LEAST_ROWS = 4096
#: Vectors a cell that the centres are fitted on, and cells at most: the bound of the sample.
SAMPLE_PER_CELL, MOST_CELLS = 256, 4096
#: A code's byte for the largest residual of the sample; larger ones are cut off, which only the candidates' order feels.
_LEVELS = 127


@dataclass(frozen=True)
class Index:
    """A written index: its folder, the key columns, the centres (one row a cell), the residuals' scale, and how many cells are probed."""

    folder: str
    key: tuple[str, ...]
    centres: np.ndarray
    scale: float
    probes: int = 1

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/rows")


def _unit(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors have this length, and those as unit vectors."""
    lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    same = lengths == size
    flat = np.asarray(column.filter(pa.array(same)).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, size)
    norm = np.sqrt((flat * flat).sum(axis=1))
    return same, np.divide(flat, norm[:, None], out=np.zeros_like(flat), where=norm[:, None] > 0)


def _distances(unit: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances to the centres, but for a term that is the same for all centres."""
    return (centres * centres).sum(axis=1)[None, :] - 2 * (unit @ centres.T)


def fit(vectors: DataFrame, cells: int, vector: str = "vector", seed: int = 0) -> np.ndarray:
    """Centres of ``cells`` cells, by k-means over at most ``cells * SAMPLE_PER_CELL`` unit vectors in hash order.

    The index has the length that most vectors have.
    """
    size = vectors.where(F.size(vector) > 0).groupBy(F.size(vector).alias("size")).count().orderBy(F.desc("count"), "size").first()["size"]
    plain = vectors.where(F.size(vector) == size).select(F.transform(vector, lambda x: x.cast("double")).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    unit = plain.withColumn("norm", norm).where("norm > 0").select(F.transform("v", lambda x: x / F.col("norm")).alias("v"))
    sample = unit.orderBy(F.xxhash64("v")).limit(cells * SAMPLE_PER_CELL).select(array_to_vector("v").alias("features"))
    model = KMeans(k=cells, seed=seed, maxIter=10).fit(sample)
    return np.array(model.clusterCenters(), np.float64)


def build(vectors: DataFrame, folder: str, key: tuple[str, ...] = ("uri", "chunk_index"), vector: str = "vector", cells: int | None = None, seed: int = 0, recall: float = 0.95) -> Index:
    """Write the index of all vectors. Without ``cells`` there are as many as the square root of the rows, at most ``MOST_CELLS``.

    ``recall`` is the share of the ten nearest that the probed cells are to hold.
    """
    rows = vectors.where(F.col(vector).isNotNull())
    if cells is None:
        cells = max(1, min(MOST_CELLS, math.isqrt(rows.count())))
    centres = fit(rows, cells, vector, seed)
    residual = rows.where(F.size(vector) == centres.shape[1]).limit(SAMPLE_PER_CELL).select(F.col(vector).alias("v")).toArrow().column("v").combine_chunks()
    unit = _unit(residual, centres.shape[1])[1]
    own = centres[np.argmin(_distances(unit, centres), axis=1)] if len(unit) else unit
    index = Index(folder, key, centres, float(np.abs(unit - own).max(initial=1e-9)))
    add(index, vectors, vector, "overwrite")
    index = replace(index, probes=calibrated(index, vectors, recall, vector=vector))
    about = {"key": key, "scale": index.scale, "probes": index.probes, "centres": centres.tolist()}
    spark = vectors.sparkSession
    spark.createDataFrame([(json.dumps(about),)], "about string").coalesce(1).write.mode("overwrite").text(f"{folder}/about")
    return index


def load(spark: SparkSession, folder: str) -> Index:
    about = json.loads(spark.read.text(f"{folder}/about").first()[0])
    return Index(folder, tuple(about["key"]), np.array(about["centres"]), about["scale"], about["probes"])


#: Stored vectors that are asked for to find how many cells to probe.
CALIBRATED_ON = 64


def calibrated(index: Index, vectors: DataFrame, recall: float, k: int = 10, vector: str = "vector") -> int:
    """The fewest cells that, for the first ``CALIBRATED_ON`` vectors in hash order, hold this share of the k nearest of each."""
    length = F.size(vector) == index.centres.shape[1]
    sample = vectors.where(length).orderBy(F.xxhash64(*index.key)).limit(CALIBRATED_ON).select(F.col(vector).alias("vector")).toArrow().column("vector").combine_chunks()
    unit = _unit(sample, index.centres.shape[1])[1]
    spark = vectors.sparkSession
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(unit)], "query_id int, vector array<double>")
    exact = vector_topk(vectors.where(length).select(*index.key, F.col(vector).alias("vector")), asked, k, index.key)
    cells = index.rows(spark).select("cell", *index.key).join(small(exact.select("query_id", *index.key)), list(index.key)).select("query_id", "cell").collect()
    place = np.argsort(np.argsort(_distances(unit, index.centres), axis=1, kind="stable"), axis=1)
    needed = np.sort([place[r["query_id"], r["cell"]] for r in cells])
    return int(needed[max(0, math.ceil(recall * len(needed)) - 1)]) + 1 if len(needed) else 1


def add(index: Index, vectors: DataFrame, vector: str = "vector", mode: str = "append") -> None:
    """Write rows into their cells. A crowded cell takes several files, few rows of many cells share a task."""
    coded = _coded(index, vectors.select(*index.key, F.col(vector).alias("vector")))
    coded.repartitionByRange("cell", F.xxhash64(*index.key)).write.mode(mode).partitionBy("cell").parquet(f"{index.folder}/rows")


def _coded(index: Index, rows: DataFrame) -> DataFrame:
    schema = StructType([*rows.schema.fields, StructField("cell", IntegerType())]).add("code", "binary").add("off", "double")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same, unit = _unit(batch.column("vector"), index.centres.shape[1])
            kept = batch.filter(pa.array(same))
            cell = np.argmin(_distances(unit, index.centres), axis=1)
            code = np.clip(np.round((unit - index.centres[cell]) * (_LEVELS / index.scale)), -_LEVELS, _LEVELS).astype(np.int8)
            off = np.sqrt(((unit - index.centres[cell] - code * (index.scale / _LEVELS)) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(cell.astype(np.int32)), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(off)], schema=arrow)

    return rows.mapInArrow(run, schema)


def probed(index: Index, queries: np.ndarray, probes: int) -> np.ndarray:
    """(queries, cells): which cells each unit vector looks into."""
    distance = _distances(queries, index.centres)
    most = min(probes, distance.shape[1])
    out = np.zeros(distance.shape, bool)
    np.put_along_axis(out, np.argsort(distance, axis=1, kind="stable")[:, :most], True, axis=1)
    return out


def index_topk(index: Index, queries: DataFrame, k: int, probes: int | None = None, rerank: int = 4, vector: str = "vector") -> DataFrame:
    """(query_id, rank, *key, score): of the rows in each query's nearest ``probes`` cells (as calibrated where not given), the k best by exact cosine
    similarity among the ``rerank * k`` best by code and all others that their codes, known to be ``off`` by so much, cannot rule out.

    A stated query set, in blocks of at most ``HELD_QUERIES``; each block reads the partitions it probes and no others.
    """
    asked = queries.where(F.col(vector).isNotNull()).select("query_id", F.col(vector).alias("q"))
    blocks, scored = -(-max(asked.count(), 1) // HELD_QUERIES), None
    for block in range(blocks):
        held = (asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)).toArrow()
        part = _block_topk(index, asked, held, k, k * rerank, index.probes if probes is None else probes)
        scored = part if scored is None else scored.unionByName(part)
    return top_k(scored, [F.desc("score"), *(F.col(c) for c in index.key)], k, ["query_id"])


def _block_topk(index: Index, asked: DataFrame, held: pa.Table, k: int, most: int, probes: int) -> DataFrame:
    column = held.column("q").combine_chunks()
    same, unit = _unit(column, index.centres.shape[1])
    ids = held.column("query_id").combine_chunks().filter(pa.array(same))
    looks = probed(index, unit, probes)
    rows = index.rows(asked.sparkSession).where(F.col("cell").isin(np.flatnonzero(looks.any(axis=0)).tolist()))
    key = index.key
    schema = StructType([asked.schema["query_id"], *(rows.schema[c] for c in key), StructField("cell", IntegerType()), StructField("near", DoubleType()), StructField("off", DoubleType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_code, sure = _Floors(len(ids), most), _Floors(len(ids), k)
        for batch in batches:
            cell = batch.column("cell").to_numpy()
            code = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.int8).reshape(batch.num_rows, -1).astype(np.float64)
            off = batch.column("off").to_numpy()
            about = index.centres[cell] + code * (index.scale / _LEVELS)
            for lo in range(0, len(ids), 128):
                allowed = looks[lo : lo + 128, cell].T
                score = np.where(allowed, about @ unit[lo : lo + 128].T, -np.inf)
                sure.cut(score - off[:, None], allowed, 0.0, lo)
                floor = sure.held[:, lo : lo + 128].min(axis=0)
                open_ = allowed & (score + off[:, None] >= floor - SLACK)
                open_[by_code.cut(score, allowed, 0.0, lo)] = True
                row, query = np.nonzero(open_)
                taken = pa.array(row)
                near = (about[row] * unit[query + lo]).sum(axis=1)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(query + lo)), *(batch.column(c).take(taken) for c in key), batch.column("cell").take(taken), pa.array(near), batch.column("off").take(taken)], schema=arrow)

    found = rows.select(*key, "cell", "code", "off").mapInArrow(run, schema)
    by, least = Window.partitionBy("query_id"), F.col("near") - F.col("off")
    ranked = found.withColumns({"nth": F.row_number().over(by.orderBy(F.desc("near"), *key)), "sure": F.row_number().over(by.orderBy(least.desc()))})
    floor = F.coalesce(F.max(F.when(F.col("sure") == k, least)).over(by), F.lit(float("-inf")))
    best = ranked.withColumn("floor", floor).where((F.col("nth") <= most) | (F.col("near") + F.col("off") >= F.col("floor") - SLACK)).select("query_id", "cell", *key)
    met = rows.select(*key, "cell", "vector").join(small(best), ["cell", *key]).join(small(asked), "query_id")
    return met.select("query_id", *key, F.round(cosine(F.col("vector"), F.col("q")), 6).alias("score"))


def adaptive_topk(vectors: DataFrame, index: Index | None, queries: DataFrame, k: int, probes: int | None = None, rerank: int = 4, key: tuple[str, ...] = ("uri", "chunk_index"), vector: str = "vector") -> DataFrame:
    """``index_topk`` where there is an index of enough rows; the exact scan else, and for queries that it leaves short."""
    if index is None or vectors.where(F.col(vector).isNotNull()).limit(LEAST_ROWS).count() < LEAST_ROWS:
        return vector_topk(vectors, queries, k, key, vector)
    found = index_topk(index, queries, k, probes, rerank, vector)
    full = found.where(F.col("rank") == k).select("query_id")
    short = queries.where(F.col(vector).isNotNull()).join(small(full), "query_id", "left_anti")
    if not short.head(1):
        return found
    exact = vector_topk(vectors, short, k, key, vector)
    return found.join(small(full), "query_id", "left_semi").unionByName(exact.select(*found.columns))


def recall_against(found: DataFrame, exact: DataFrame, key: tuple[str, ...] = ("uri", "chunk_index")) -> DataFrame:
    """(query_id, recall): the share of the exact answers that were found."""
    hit = exact.select("query_id", *key).join(found.select("query_id", *key, F.lit(1).alias("hit")), ["query_id", *key], "left")
    return hit.groupBy("query_id").agg(F.round(F.avg(F.coalesce("hit", F.lit(0))), 6).alias("recall"))
