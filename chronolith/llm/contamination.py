"""Benchmark decontamination: size-partitioned MinHash containment search, in DataFrame functions only.

Short test items are looked for inside long documents. A text is the set of its distinct shingles
of ``width`` lower-cased words; an item is contained when the document holds at least ``share``
percent of its shingles. MinHash signatures of equal length would drown a short item in a long
document, so the sketches follow the items' sizes:

* items are partitioned by size (powers of two); in a partition whose largest size is m, each
  item's sketch is its ``m - ceil(share m) + 1`` smallest hash values. A document that lacks at most
  ``n - ceil(share n)`` of an item's n shingles cannot lack them all, so no contained item is missed;
* a document's sketch is those of its hash values that some partition's sketches may hold, as told by
  a bitmap of 64 bits for each sketch value (up to ``BITMAP_BITS``). It depends on the items and not
  on the document's size, and neither a single short item nor a large partition widens it for the others
  (``sketch_report`` tells the share). What the bitmap lets through by chance is dropped by the join.

Sketches meet in one equi-join (broadcast only below ``BROADCAST_ROWS`` rows). Only candidate pairs are then
verified, by intersecting the item's shingles with the document's exactly. Only split, transform, explode,
joins and aggregates of the engine run; there is no Python on the executors.

Defined results: null or empty texts contain nothing; an item of fewer words than a shingle is one
shingle, its whole word sequence, and is contained only in documents of just these words; items
without id or words are ignored; repeated rows of one document are reported once; of items repeated
under one id, every distinct text counts as the id's.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolith.llm.frames import durable

WIDTH = 5
SHARE = 80
#: Rows up to which a side is broadcast (two longs each: 8 MB); larger ones are joined by shuffle.
BROADCAST_ROWS = 500_000
#: Bits of the bitmap of sketch values, at most: 128 KB in every task's plan.
BITMAP_BITS = 1 << 20
_SPACE = " \t\n\u000b\f\r"


def _words(text: Column) -> Column:
    return F.split(F.lower(F.btrim(text, F.lit(_SPACE))), "[ \\t\\n\\x0B\\f\\r]+")


def shingle_hashes(text: Column, width: int) -> Column:
    """Distinct non-negative 63-bit hashes of a text's shingles; an empty array without words."""
    words = _words(F.coalesce(text, F.lit("")))

    def of(words: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.size(words) - width), lambda i: F.shiftrightunsigned(F.xxhash64(*[F.get(words, i + k) for k in range(width)]), 1))
        few = F.array(F.shiftrightunsigned(F.xxhash64(F.array_join(words, " "), F.lit(width)), 1))
        return F.when(F.size(words) >= width, F.array_distinct(runs)).when(F.get(words, F.lit(0)) == "", F.array().cast("array<bigint>")).otherwise(few)

    return F.get(F.transform(F.array(words), of), F.lit(0))  # a lambda's variable: the split runs once


def _bounded(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _item_sketches(benchmark: DataFrame, width: int, share: int) -> tuple[DataFrame, DataFrame]:
    """Distinct items with their shingles and size partition, and the sketches (item, part, hash)."""
    items = (
        benchmark.select(F.col("item_id").cast("long").alias("item_id"), shingle_hashes(F.col("text").cast("string"), width).alias("wanted"))
        .where("item_id is not null and size(wanted) > 0")
        .dropDuplicates()
        .withColumn("item", F.monotonically_increasing_id())
    )
    items = durable(items.withColumn("item_shingles", F.size("wanted").cast("long")).withColumn("part", F.floor(F.log2(F.size("wanted") + 0.5)).cast("int")))
    largest = (F.pow(F.lit(2), F.col("part") + 1) - 1).cast("long")
    keep = (largest - F.ceil(largest * share / 100) + 1).cast("int")
    return items, items.select("item", "part", F.explode(F.slice(F.array_sort("wanted"), F.lit(1), keep)).alias("hash"))


def _bitmap(sketch: DataFrame, rows: int) -> list[int]:
    """The sketch values' lowest bits as a bitmap of longs; at most ``BITMAP_BITS`` bits reach the driver."""
    bits = min(BITMAP_BITS, max(1 << 12, 1 << (64 * rows).bit_length()))
    bit = F.expr("shiftleft(1L, cast(hash & 63 as int))")
    word = F.shiftright(F.col("hash").bitwiseAND(F.lit(bits - 1)), 6)
    out = [0] * (bits >> 6)
    for r in sketch.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits")).collect():
        out[r["word"]] = r["bits"]
    return out


def _sketched(hashes: Column, bitmap: list[int]) -> Column:
    """Those hash values whose bit is set."""
    words = F.split(F.lit(",".join(map(str, bitmap))), ",").cast("array<bigint>")  # folded to one literal by the optimizer

    def kept(h: Column) -> Column:
        word = F.get(words, F.shiftright(h.bitwiseAND(F.lit((len(bitmap) << 6) - 1)), 6).cast("int"))
        return F.getbit(word, h.bitwiseAND(F.lit(63)).cast("int")) == 1

    return F.filter(hashes, kept)


def contained_items(documents: DataFrame, benchmark: DataFrame, width: int = WIDTH, share: int = SHARE) -> DataFrame:
    """(doc_id, item_id, item_shingles, shared, containment): every pair at or above ``share`` percent."""
    items, sketch = _item_sketches(benchmark, width, share)
    rows = sketch.count()
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("key", F.xxhash64("doc_id", "text"))
    held = texts.select("key", F.explode(_sketched(shingle_hashes(F.col("text"), width), _bitmap(sketch, rows))).alias("hash"))
    candidates = durable(held.join(_bounded(sketch.select("item", "hash"), rows), "hash").select("key", "item").distinct(), of=documents)

    pairs = candidates.count()
    suspects = texts.join(_bounded(candidates.select("key").distinct(), pairs), "key", "left_semi").dropDuplicates(["key"])
    suspects = suspects.select("key", "doc_id", shingle_hashes(F.col("text"), width).alias("hashes"))
    total = items.agg(F.sum("item_shingles")).first()[0] or 0
    met = suspects.join(_bounded(candidates, pairs), "key").join(_bounded(items.drop("part"), total), "item")
    return (
        met.withColumn("shared", F.size(F.array_intersect("wanted", "hashes")).cast("long"))
        .where(F.col("shared") * 100 >= F.col("item_shingles") * share)
        .groupBy("doc_id", "item_id", "item_shingles")
        .agg(F.max("shared").alias("shared"))
        .select("doc_id", "item_id", "item_shingles", "shared", F.round(F.col("shared") / F.col("item_shingles"), 6).alias("containment"))
    )


def sketch_report(documents: DataFrame, benchmark: DataFrame, width: int = WIDTH, share: int = SHARE) -> DataFrame:
    """(part, items, sketch_values, held, shingles): for each size partition its items, its sketch values and how many
    shingles of documents are among them; ``shingles`` are all of the documents' and ``sketched`` those that the bitmap lets through."""
    _, sketch = _item_sketches(benchmark, width, share)
    rows = sketch.count()
    hashes = documents.select(shingle_hashes(F.col("text").cast("string"), width).alias("hashes"))
    kept = durable(hashes.select(F.size("hashes").alias("n"), _sketched(F.col("hashes"), _bitmap(sketch, rows)).alias("kept")))
    all_of = kept.agg(F.sum("n").alias("shingles"), F.sum(F.size("kept")).alias("sketched"))
    met = kept.select(F.explode("kept").alias("hash")).join(_bounded(sketch.select("part", "hash").distinct(), rows), "hash").groupBy("part").agg(F.count("*").alias("held"))
    by_part = sketch.groupBy("part").agg(F.count_distinct("item").alias("items"), F.count("*").alias("sketch_values")).join(met, "part", "left").withColumn("held", F.coalesce("held", F.lit(0)))
    one = all_of.first()
    return by_part.withColumns({"shingles": F.lit(one["shingles"]), "sketched": F.lit(one["sketched"])})


def clean_documents(documents: DataFrame, benchmark: DataFrame, width: int = WIDTH, share: int = SHARE) -> DataFrame:
    """The documents that contain no item, with all their columns. Rows are told apart by doc_id and text, so
    a clean text stays whatever shares its doc_id, and a contaminated one goes even without doc_id."""
    keyed = documents.withColumn("__key", F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    dirty = contained_items(keyed.select(F.col("__key").alias("doc_id"), "text"), benchmark, width, share).select(F.col("doc_id").alias("__key")).distinct()
    return keyed.join(dirty.hint("shuffle_hash"), "__key", "left_anti").select(*documents.columns)


def oracle_sql(width: int = WIDTH, share: int = SHARE) -> str:
    def shingles(table: str, ident: str) -> str:
        return f"""select distinct {ident}, case when len(ws) >= {width} then array_to_string(ws[i:i+{width - 1}], ' ') else 'whole ' || array_to_string(ws, ' ') end as g
        from (select {ident}, ws, unnest(generate_series(1, greatest(1, len(ws) - {width - 1}))) as i from
        (select {ident}, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[ \\t\\n\\v\\f\\r]+'), lambda w: w <> '') as ws from {table}) where len(ws) > 0)"""

    return f"""with d as ({shingles("documents", "doc_id")}), b as ({shingles("benchmark", "item_id")}),
    n as (select item_id, count(*) as item_shingles from b group by item_id),
    c as (select d.doc_id, b.item_id, count(*) as shared from d join b on d.g = b.g group by d.doc_id, b.item_id)
    select c.doc_id, c.item_id, n.item_shingles, c.shared, round(c.shared / n.item_shingles::double, 6) as containment
    from c join n on c.item_id = n.item_id where c.shared * 100 >= n.item_shingles * {share}"""


def sketch_size(largest: int, share: int = SHARE) -> int:
    """Sketch values that a partition of sets up to ``largest`` shingles keeps."""
    return largest - math.ceil(share * largest / 100) + 1
