"""The driver's tables seen as the engine's: each projection once in Spark and once in SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = 904_608_000
TALK_NOW = 1_700_100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


ENTITIES = """
  select 'c' || c_custkey as id, c_name as name, case when c_custkey % 41 = 0 then 'martian' else 'person' end as entity_type, 700000000 + c_custkey * 60 as created_at,
    700000000 + c_custkey * 60 + (c_custkey * 7919) % 100000 as updated_at, case when c_custkey % 37 = 0 then 'partition:stub' else 'crm' end as source from customer
  union all select 's' || s_suppkey, s_name, 'organization', 600000000 + s_suppkey * 60, 800000000 + (s_suppkey * 31) % 1000, 'erp' from supplier
  union all select 'n' || n_nationkey, n_name, 'place', 500000000 + n_nationkey, 500000000 + n_nationkey, 'atlas' from nation
  union all select 'r' || r_regionkey, r_name, 'place', 500000000 + r_regionkey, 500000000 + r_regionkey, 'atlas' from region"""

OBSERVATIONS = """
  select o_orderkey as id, 'c' || o_custkey as entity_id, o_orderpriority || ' order ' || o_orderstatus as content, {epoch} as observed_at,
    case when o_orderkey % 5 = 0 then {epoch} + 86400 * (o_orderkey % 30) end as valid_from,
    case when o_orderkey % 4 = 0 then {epoch} + 86400 * (30 + o_orderkey % 900) end as valid_until,
    (o_orderkey % 101) / 100e0 as confidence, case when o_orderkey % 6 = 0 then 'correction' else 'orders' end as source,
    o_orderkey % 11 = 0 as tombstoned, o_orderkey % 13 as access_count,
    case o_orderkey % 3 when 0 then 'episodic' when 1 then 'semantic' else 'procedural' end as memory_tier,
    case when o_orderkey % 7 = 0 then null else (o_orderkey % 10) / 10e0 end as importance from orders"""

RELATIONS = """
  select 'c' || c_custkey || '>' as id, 'c' || c_custkey as from_entity, 'n' || c_nationkey as to_entity, 'located_in' as relation_type, (c_custkey % 10) / 10e0 as weight,
    cast(case when c_custkey % 9 = 0 then 800000000 end as bigint) as valid_until from customer
  union all select 's' || s_suppkey || '>', 's' || s_suppkey, 'n' || s_nationkey, 'located_in', 0.5e0, cast(null as bigint) from supplier where s_suppkey % 3 > 0
  union all select 'n' || n_nationkey || '>', 'n' || n_nationkey, 'r' || n_regionkey, 'part_of', 1e0, cast(null as bigint) from nation
  union all select 'c' || c_custkey || '=', 'c' || c_custkey, 'c' || (c_custkey + 1), 'knows_about', (c_custkey % 7) / 7e0, cast(null as bigint) from customer where c_custkey % 2 = 0"""

TALK = """
  select conv_id * 1000 + turn as id, '#' || conv_id as entity_id, text as content, 1700000000 + conv_id * 100 + turn as observed_at, cast(null as bigint) as valid_from,
    case when turn % 4 = 3 then 1700000000 + conv_id * 150 end as valid_until, (50 + turn * 6) / 100e0 as confidence, role as source, conv_id % 17 = 0 as tombstoned,
    turn as access_count, case when turn % 2 = 0 then 'episodic' else 'semantic' end as memory_tier, case when turn % 3 = 0 then null else turn / 10e0 end as importance from conversations"""

ROOMS = """select distinct '#' || conv_id as id, 'Room ' || (conv_id % 50) as name, case when conv_id % 3 = 0 then 'event' else 'project' end as entity_type from conversations"""


def view(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    """A projection over the tables it reads, passed as frames and not as session-wide views."""
    return spark.sql(_bound(sql, tables), **{t: table(spark, sf_dir, t) for t in tables})


def _bound(sql: str, tables: tuple[str, ...]) -> str:
    sql = sql.replace("{epoch}", "unix_timestamp(o_orderdate)")
    for t in tables:
        sql = sql.replace(f"from {t}", f"from {{{t}}}")
    return sql


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, ENTITIES, "customer", "supplier", "nation", "region")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, OBSERVATIONS, "orders")


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, RELATIONS, "customer", "supplier", "nation")


def talk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, TALK, "conversations")


def rooms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, ROOMS, "conversations")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks, with a vector for those that have one."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return docs.join(vectors, "doc_id", "left").select(F.concat(F.lit("doc://"), F.col("doc_id")).alias("uri"), F.lit(0).alias("chunk_index"), "doc_id", "text", "source", "lang", "vector")


#: The same tables for the oracle, as common table expressions.
ORACLE = {
    "entities": ENTITIES,
    "observations": OBSERVATIONS.replace("{epoch}", "cast(epoch(o_orderdate) as bigint)"),
    "relations": RELATIONS,
    "talk": TALK,
    "rooms": ROOMS,
    "chunks": "select 'doc://' || d.doc_id as uri, 0 as chunk_index, d.doc_id, d.text, d.source, d.lang, v.embedding as vector from documents d left join embeddings v on v.vec_id = d.doc_id",
}


def with_tables(*names: str) -> str:
    return "with " + ", ".join(f"{n} as ({ORACLE[n]})" for n in names)
