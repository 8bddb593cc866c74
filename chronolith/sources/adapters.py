"""Readers that turn notes, chats and evaluation files into rows; all parsing is in DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.functions.text import path_allowed, stripped

CHAT_SCHEMA = "channel string, user string, ts long, text string"


def notes(spark: SparkSession, path: str) -> DataFrame:
    """Markdown notes, one row per file: (uri, text)."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("uri"), F.col("value").alias("text"))


def parse_notes(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, observations, relations): an event named by the first H1, else by the file; an observation for the text
    before the first H2 (section null) and for each H2 section that has text; and ``Attendees:`` lines as
    has_participant edges. H1 and attendee lines belong to no section; a file without any of the two is skipped."""
    text = F.regexp_replace(F.col("text"), r"\r\n?", "\n")
    heading = stripped(F.regexp_extract(text, r"(?m)^[ \t]*# +(\S.*)$", 1))
    stem = F.regexp_extract(F.col("uri"), r"([^/]+?)(?:\.[^./]*)?$", 1)
    body = F.regexp_replace(text, r"(?mi)^[ \t]*(?:# .*|attendees:.*)$\n?", "")
    people = F.transform(F.regexp_extract_all(text, F.lit(r"(?mi)^[ \t]*attendees:(.*)$"), F.lit(1)), lambda line: F.split(line, ","))
    people = F.filter(F.transform(F.flatten(people), lambda who: F.regexp_replace(stripped(who), "^@+", "")), lambda who: who != "")
    parts = F.transform(F.split(body, r"(?m)^[ \t]*## "), _section)
    read = files.select("uri", F.when(heading != "", heading).otherwise(stem).alias("title"), people.alias("people"), F.filter(parts, lambda p: p["content"] != "").alias("parts"))
    read = read.where((F.size("people") > 0) | (F.size("parts") > 0))
    entities = read.select(F.col("title").alias("name"), F.lit("event").alias("entity_type"), F.col("uri").alias("source"))
    found = read.select("title", "uri", F.explode("parts").alias("part"))
    observations = found.select(F.col("title").alias("entity"), "part.place", "part.section", "part.content", F.col("uri").alias("source"))
    relations = read.select(F.col("title").alias("from_entity"), F.lit("has_participant").alias("relation_type"), F.explode("people").alias("to_entity"))
    return entities, observations, relations


def _section(part: Column, place: Column) -> Column:
    """The part behind a heading, whose first line it begins with; before the first heading there is none."""
    titled = F.struct(place.alias("place"), stripped(F.substring_index(part, "\n", 1)).alias("section"), stripped(F.regexp_replace(part, r"^[^\n]*\n?", "")).alias("content"))
    intro = F.struct(place.alias("place"), F.lit(None).cast("string").alias("section"), stripped(part).alias("content"))
    return F.when(place == 0, intro).otherwise(titled)


def chat(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Chat lines from JSON files with a fixed schema; strict reading fails on a broken line."""
    return spark.read.schema(CHAT_SCHEMA).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def parse_chat(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(observations, relations): a message is an observation of ``#channel`` valid from its time, its author an edge."""
    entity = F.concat(F.lit("#"), F.col("channel").cast("string"))
    fine = lines.where("channel is not null and text is not null and trim(text) <> ''")
    observations = fine.select(entity.alias("entity"), F.col("text").alias("content"), F.col("ts").alias("valid_from"), F.col("user").alias("author"))
    relations = fine.where("user is not null").select(entity.alias("from_entity"), F.lit("has_participant").alias("relation_type"), F.col("user").alias("to_entity")).distinct()
    return observations, relations


def files(spark: SparkSession, path: str, extensions: list[str], ignored_dirs: list[str] = (".git", "node_modules", "target"), max_bytes: int = 10 << 20) -> DataFrame:
    """(uri, content) of the files of a scan; content is null where bytes are not UTF-8. Size and name filter before bytes are read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    wanted = found.where(path_allowed(F.col("path"), extensions, list(ignored_dirs), max_bytes, F.col("length")))
    return wanted.select(F.col("path").alias("uri"), F.try_validate_utf8(F.col("content").cast("string")).alias("content"))


def dataset(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(corpus, queries, judgments) of an evaluation folder of JSON lines; relevance must lie within 0..3."""
    corpus = spark.read.schema("uri string, text string, entity_hint string").json(f"{folder}/corpus.jsonl")
    queries = spark.read.schema("id string, text string, mode_override string").json(f"{folder}/queries.jsonl")
    judged = spark.read.schema("query_id string, uri string, relevance int").json(f"{folder}/judgments.jsonl")
    return corpus, queries, judged.withColumn("relevance", checked(F.col("relevance").between(0, 3), F.col("relevance"), "relevance must be within 0..3"))


def checked(condition: Column, value: Column, message: str) -> Column:
    return F.when(condition, value).otherwise(F.raise_error(F.lit(message)).cast("int"))


QUERY_SCHEMA = "id string, text string, category string, relevant array<struct<key:string,relevance:int>>, exclude array<string>, expect_abstention boolean, judgments_complete boolean, judgment_source string, group_id string, capacity_waiver struct<reason:string>"


def query_set(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(queries, judgments) from text lines ``value``; blank lines and comments are skipped, repeated ids fail."""
    line = stripped(F.col("value"))
    real = F.when((line != "") & ~F.startswith(line, F.lit("#")), line)  # not a filter, which the parser could run before
    rows = lines.select(F.from_json(real, QUERY_SCHEMA, {"mode": "FAILFAST"}).alias("q")).where("q is not null").select("q.*")
    ids = rows.groupBy("id").agg(F.count("*").alias("n"))
    once = rows.join(ids, "id").withColumn("n", checked(F.col("n") == 1, F.col("n").cast("int"), "repeated query id")).where("n = 1").drop("n")
    judgments = once.select(F.col("id").alias("query_id"), F.explode("relevant").alias("r")).select("query_id", "r.key", F.coalesce("r.relevance", F.lit(1)).alias("relevance"))
    queries = once.select(F.col("id").alias("query_id"), "text", "category", F.coalesce("expect_abstention", F.lit(False)).alias("expect_abstention"), F.col("capacity_waiver").isNotNull().alias("waived"), "judgment_source", "group_id")
    return queries, judgments
