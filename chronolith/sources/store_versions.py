"""A store of several tables that changes as a whole: staged, checked, then swapped in by one manifest.

A commit writes the next version of every table beside the current one, checks keys and references between the staged tables in
load order, and only then publishes a manifest that names the version; any problem takes the staged files away and leaves
the store as it was. Readers follow the newest manifest. A manifest holds each table's Merkle digest, so an
export can be checked before it is imported, and a restored store proves equal to what was saved.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.operators.merge_plan import table_digest


@dataclass(frozen=True)
class Table:
    """A table's key, and which of its columns refer to which table's key."""

    name: str
    key: str = "id"
    references: tuple[tuple[str, str], ...] = ()


#: Load order: what is referred to comes first.
TABLES = (
    Table("entities"),
    Table("observations", "id", (("entity_id", "entities"),)),
    Table("relations", "id", (("from_entity", "entities"), ("to_entity", "entities"))),
)


def _fs(spark: SparkSession, place: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def version(spark: SparkSession, folder: str) -> int:
    """The newest published version; 0 before the first."""
    fs, path = _fs(spark, f"{folder}/manifests")
    return max((int(s.getPath().getName()) for s in fs.listStatus(path) if s.getPath().getName().isdigit()), default=0) if fs.exists(path) else 0


def manifest(spark: SparkSession, folder: str, number: int | None = None) -> dict:
    """{"version", "tables": {name: {"rows", "digest"}}} of a version, the newest where none is named."""
    number = version(spark, folder) if number is None else number
    return json.loads(spark.read.text(f"{folder}/manifests/{number}").first()[0]) if number else {"version": 0, "tables": {}}


def read(spark: SparkSession, folder: str, number: int | None = None) -> dict[str, DataFrame]:
    about = manifest(spark, folder, number)
    return {name: spark.read.parquet(f"{folder}/versions/{held['at']}/{name}") for name, held in about["tables"].items()}


def problems(tables: dict[str, DataFrame], order: tuple[Table, ...] = TABLES) -> DataFrame:
    """(problem, table, id): missing or repeated keys, and references to rows that are not there."""
    parts = []
    for t in order:
        if t.name not in tables:
            continue
        rows = tables[t.name]
        counts = rows.groupBy(t.key).agg(F.count("*").alias("n"))
        parts.append(counts.where(F.col(t.key).isNull()).select(F.lit("no key").alias("problem"), F.lit(t.name).alias("table"), F.col(t.key).cast("string").alias("id")))
        parts.append(counts.where(F.col(t.key).isNotNull() & (F.col("n") > 1)).select(F.lit("repeated key"), F.lit(t.name), F.col(t.key).cast("string")))
        for column, other in t.references:
            held = next(x.key for x in order if x.name == other)
            known = tables[other].select(F.col(held).alias(column)).distinct()
            loose = rows.select(F.col(t.key).cast("string").alias("id"), column).join(known, column, "left_anti")
            parts.append(loose.select(F.lit(f"{column} is not there"), F.lit(t.name), "id"))
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def commit(spark: SparkSession, folder: str, incoming: dict[str, DataFrame], replace: bool = False, order: tuple[Table, ...] = TABLES) -> DataFrame:
    """Publish the store with the incoming rows, which take the place of rows with their keys (or, with ``replace``, of all
    rows); returns ``problems``, empty where the commit went through. A commit that another one overtakes raises."""
    base, stage = version(spark, folder), uuid.uuid4().hex
    current = {} if replace or not base else read(spark, folder, base)
    place, tables = f"{folder}/versions/{stage}", {}
    fs, staged = _fs(spark, place)
    try:
        for t in order:
            new, old = incoming.get(t.name), current.get(t.name)
            if new is None and old is None:
                continue
            rows = old if new is None else new if old is None else old.join(new.select(t.key).distinct(), t.key, "left_anti").unionByName(new, allowMissingColumns=True)
            rows.write.parquet(f"{place}/{t.name}")
            tables[t.name] = spark.read.parquet(f"{place}/{t.name}")
        found = problems(tables, order)
        wrong = found.limit(1000).collect()  # enough to tell what is wrong; nothing is published then
        if wrong:
            out = spark.createDataFrame([tuple(r) for r in wrong], "problem string, table string, id string")
            fs.delete(staged, True)
            return out
        said = {name: {"at": stage} | table_digest(df).select("rows", "digest").first().asDict() for name, df in tables.items()}
        _publish(spark, folder, base + 1, {"version": base + 1, "tables": said})
    except BaseException:
        fs.delete(staged, True)
        raise
    return spark.createDataFrame([], "problem string, table string, id string")


def _publish(spark: SparkSession, folder: str, number: int, about: dict) -> None:
    draft, place = f"{folder}/manifests/_{uuid.uuid4().hex}", f"{folder}/manifests/{number}"
    spark.createDataFrame([(json.dumps(about),)], "about string").coalesce(1).write.text(draft)
    fs, path = _fs(spark, draft)
    if fs.exists(_fs(spark, place)[1]) or not fs.rename(path, _fs(spark, place)[1]):
        fs.delete(path, True)
        raise RuntimeError(f"version {number} was published meanwhile")


def export(spark: SparkSession, folder: str, to: str) -> dict:
    """Write the newest version's tables to another folder, with a manifest; returns that."""
    for name, df in read(spark, folder).items():
        df.write.parquet(f"{to}/versions/export/{name}")
    about = manifest(spark, folder)
    about["tables"] = {name: held | {"at": "export"} for name, held in about["tables"].items()}
    _publish(spark, to, 1, about | {"version": 1})
    return about


def restore(spark: SparkSession, exported: str, folder: str, replace: bool = True) -> DataFrame:
    """Import an export, in place of the store's rows or (without ``replace``) into them; returns ``problems``.

    Tables that are not what the export's manifest says are a problem, and nothing is imported.
    """
    about, tables = manifest(spark, exported), read(spark, exported)
    changed = [name for name, df in tables.items() if table_digest(df).first()["digest"] != about["tables"][name]["digest"]]
    if changed:
        return spark.createDataFrame([("not what was exported", name, None) for name in changed], "problem string, table string, id string")
    return commit(spark, folder, tables, replace)
