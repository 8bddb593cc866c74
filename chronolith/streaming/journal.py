"""An append journal in shards and its replay, exactly once.

Each shard is a folder of JSON lines whose ``seq`` grows. A replay takes what lies beyond a shard's checkpoint, and each
``seq`` once however often and in whichever batch it was written. Applied rows and the checkpoints they lead to become
visible together, by the batch's last file; a batch that stopped before that is written anew. Checkpoints of several
writers are merged by their maximum, so an old one never takes a shard back. A line that is no whole entry, as a stopped
writer leaves it, is set apart and never applied.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ENTRY = "seq long, name string, entity_type string, observations array<string>, source string, at long"
_CHECKPOINT = "shard int, seq long"


def read_lines(spark: SparkSession, folder: str) -> DataFrame:
    """(shard, value) of every line below ``folder/shard=N``."""
    return spark.read.schema("value string, shard int").option("wholetext", False).text(folder).select("shard", "value")


def entries(lines: DataFrame, schema: str = ENTRY) -> DataFrame:
    """(shard, entry, torn): an entry is whole where its line is one JSON object with a ``seq``."""
    found = F.from_json("value", schema + ", _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
    out = lines.where(F.trim("value") != "").select("shard", "value", found.alias("entry"))
    torn = F.col("entry").isNull() | F.col("entry._corrupt").isNotNull() | F.col("entry.seq").isNull()
    return out.select("shard", F.when(~torn, F.col("entry").dropFields("_corrupt")).alias("entry"), F.when(torn, F.col("value")).alias("torn"))


def merged_checkpoints(*frames: DataFrame) -> DataFrame:
    """(shard, seq): the furthest of each shard."""
    out = frames[0].select("shard", "seq")
    for df in frames[1:]:
        out = out.unionByName(df.select("shard", "seq"))
    return out.where("seq is not null").groupBy("shard").agg(F.max("seq").alias("seq"))


def _beyond(journal: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Rows beyond their shard's checkpoint. Checkpoints are as many as shards, which are folders, so their side is small by
    what it is; AQE would see that only when all rows had been dealt by shard, a task for each."""
    done = merged_checkpoints(checkpoints).withColumnRenamed("seq", "done")
    return journal.where("seq is not null").join(F.broadcast(done), "shard", "left").where("done is null or seq > done").drop("done")


def replayable(journal: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Rows of (shard, seq, ...) beyond their shard's checkpoint, one for each seq: of several the least by all columns."""
    beyond = _beyond(journal, checkpoints)
    rest = [c for c in beyond.columns if c not in ("shard", "seq")]
    return beyond.groupBy("shard", "seq").agg(F.min(F.struct(*rest)).alias("row")).select("shard", "seq", *[F.col(f"row.`{c}`").alias(c) for c in rest]) if rest else beyond.distinct()


def gaps(journal: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """(shard, first, last) of numbers that are missing between a shard's checkpoint and its last entry.

    Numbers are bits of blocks of 64, put together before the shuffle: exchanges are coalesced by their compressed size, and
    single numbers compress so well that a task would sort tens of millions. A shard's blocks are cut into ranges of 2^16
    numbers, each sorted by itself; ranges are then compared by their ends only, so a hot shard is many tasks.
    """
    numbers = _beyond(journal.select("shard", "seq"), checkpoints)
    bits = numbers.groupBy("shard", F.shiftright("seq", 6).alias("block")).agg(F.expr("bit_or(shiftleft(1L, cast(seq & 63 as int)))").alias("bits"))
    held = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit("bits", i) == 1)
    blocks = bits.select("shard", "block", F.shiftright("block", 10).alias("part"), F.transform(held, lambda i: F.col("block") * 64 + i).alias("seqs"))
    spans = blocks.select("shard", "block", "part", "seqs", F.get("seqs", F.lit(0)).alias("seq"), F.element_at("seqs", -1).alias("top"))
    before = F.lag("top").over(Window.partitionBy("shard", "part").orderBy("block"))
    within = spans.select("shard", "seqs", F.concat(F.array(before), F.slice("seqs", 1, F.size("seqs") - 1)).alias("befores"))
    pairs = F.zip_with("befores", "seqs", lambda a, b: F.struct(b.alias("seq"), a.alias("before")))
    inner = within.select("shard", F.inline(F.filter(pairs, lambda x: x["seq"] > x["before"] + 1)))
    ends = spans.groupBy("shard", "part").agg(F.min("seq").alias("seq"), F.max("top").alias("top"))
    done = merged_checkpoints(checkpoints).withColumnRenamed("seq", "done")
    above = Window.partitionBy("shard").orderBy("part")
    outer = ends.withColumn("before", F.lag("top").over(above)).join(done, "shard", "left").select("shard", "seq", F.coalesce("before", "done").alias("before"))
    steps = inner.unionByName(outer)
    return steps.where("seq > before + 1").select("shard", (F.col("before") + 1).alias("first"), (F.col("seq") - 1).alias("last"))


def _exists(spark: SparkSession, place: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def checkpoints(spark: SparkSession, store: str) -> DataFrame:
    """(shard, seq) that finished batches reached."""
    if not _exists(spark, f"{store}/marks"):
        return spark.createDataFrame([], _CHECKPOINT)
    return merged_checkpoints(spark.read.schema(_CHECKPOINT + ", batch int").parquet(f"{store}/marks"))


def _next_batch(spark: SparkSession, store: str) -> int:
    """One more than the last finished batch: what a stopped batch left has that number and is overwritten."""
    if not _exists(spark, f"{store}/marks"):
        return 0
    last = spark.read.schema(_CHECKPOINT + ", batch int").parquet(f"{store}/marks").agg(F.max("batch")).first()[0]
    return 0 if last is None else last + 1


def replay(spark: SparkSession, folder: str, store: str, schema: str = ENTRY) -> int:
    """Apply what the journal holds beyond the store's checkpoints as one batch; returns the batch's number.

    The journal is read once into the batch's table and marks are taken from that table, so lines that a writer adds
    meanwhile wait for the next replay. One replay runs at a time for a store; any number of writers append.
    """
    number = _next_batch(spark, store)
    read = entries(read_lines(spark, folder), schema)
    whole = read.where("entry is not null").select("shard", "entry.*")
    replayable(whole, checkpoints(spark, store)).write.mode("overwrite").parquet(f"{store}/applied/batch={number}")
    new = spark.read.parquet(f"{store}/applied/batch={number}")
    # the marks are last: readers see batches that have them; one file, of at most a row for each shard
    new.groupBy("shard").agg(F.max("seq").alias("seq")).coalesce(1).write.mode("overwrite").parquet(f"{store}/marks/batch={number}")
    return number


def applied(spark: SparkSession, store: str) -> DataFrame:
    """Rows of finished batches: an unfinished one is at most the next number."""
    return spark.read.option("basePath", f"{store}/applied").parquet(f"{store}/applied").where(F.col("batch") < _next_batch(spark, store)).drop("batch")


def torn(spark: SparkSession, folder: str, schema: str = ENTRY) -> DataFrame:
    """(shard, torn): lines that are no whole entries."""
    return entries(read_lines(spark, folder), schema).where("torn is not null").select("shard", "torn")


def truncate(spark: SparkSession, folder: str, store: str, to: str, schema: str = ENTRY) -> None:
    """Write what is not applied yet as a journal of its own, which then takes the old one's place.

    The old one stays as it is, so a stop in between loses nothing, and replaying both applies each entry once.
    """
    rest = replayable(entries(read_lines(spark, folder), schema).where("entry is not null").select("shard", "entry.*"), checkpoints(spark, store))
    columns = [c for c in rest.columns if c != "shard"]
    rest.select("shard", F.to_json(F.struct(*columns)).alias("value")).write.partitionBy("shard").text(to)
