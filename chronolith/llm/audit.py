"""Audit of how filters overlap: what each removes, repeats or takes alone, under every order of them.

Five filters fail documents: few words, few different words, many capitals, marks of markup, and a
text that a smaller doc_id has already. The first four are a document's own, one bit each of a mask.
The fifth comes from a sort: rows are range-partitioned by (text fingerprint, doc_id) and sorted by
(fingerprint, text, doc_id) in each partition, where equal texts lie together and each row is compared
with its predecessor. Texts aren't keys of the partitioning, since Spark draws its bounds from sampled keys on the
driver; rows of one fingerprint may therefore go on in the next partition, and that is what boundaries
are handled for: a partition reports the runs of its last fingerprint with the smallest doc_id of
each, and the rows that begin a run of its first fingerprint wait until these reports, joined by whole text, tell
whether the run began earlier. A text that a third of all rows share thus fills a third of the partitions.

Masks are merged into counters for each part: at most 128 for any number of rows. All orders, steps and
Shapley sums are worked out from the counters.

Defined results: a null text is empty, and so are a null and an empty lang one part; rows without doc_id
repeat nothing and are repeated by nothing; rows of one doc_id don't repeat each other; of several labels
for a doc_id any 1 counts; without rows there are no parts. Other columns don't matter.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolith.llm.frames import arrow_schema, durable, small_batches

FILTERS = "ABCDE"
REPEATED = 1 << FILTERS.index("E")


def own_mask(text: Column) -> Column:
    """The bits of the filters that look at the document alone."""
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    size = F.length(text)
    capitals = size - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))

    def bits(w: Column) -> Column:
        fails = (F.size(w) < 200, 100 * F.size(F.array_distinct(w)) < 50 * F.size(w), 100 * capitals > 3 * size, text.rlike("[#$%&*|]"))
        return functools.reduce(Column.__add__, [F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)])

    return F.transform(F.array(words), bits)[0]


_RUNS = "kind int, part string, doc_id long, mask int, run long, finger long, text string"
#: Kinds of a pass's rows: a document; the beginning of a run of the partition's first fingerprint; a run of its last one.
_DOCUMENT, _FIRST, _LAST = 0, 1, 2


def _sorted_pass(frame: DataFrame) -> DataFrame:
    """Each row with the bit of a repeated text as far as its partition tells, and the partition's boundary runs.

    A row that begins a run of the partition's first fingerprint has the run's number: its bit depends on others.
    """
    target = arrow_schema(frame, _RUNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33
        first = last = last_text = least = None
        open_runs: list[tuple] = []  # the runs of the fingerprint that came last
        for batch in batches:
            if not batch.num_rows:
                continue
            finger, text = batch.column("finger").to_numpy(), batch.column("text")
            doc, has_doc = batch.column("doc_id").fill_null(0).to_numpy(), batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
            first = int(finger[0]) if first is None else first
            fresh = np.ones(len(finger), bool)
            fresh[0] = last is None or last != finger[0] or last_text != text[0].as_py()
            near = np.flatnonzero(finger[1:] == finger[:-1])
            if len(near):
                fresh[near + 1] = ~pc.equal(text.take(pa.array(near)), text.take(pa.array(near + 1))).to_numpy(zero_copy_only=False)
            began, heads = np.cumsum(fresh) - 1, np.flatnonzero(fresh)
            # nulls come last in a run, so its first row has the smallest doc_id, if any
            smallest = [None if not has_doc[i] else int(doc[i]) for i in heads.tolist()]
            known = np.array([-1 if s is None else s for s in smallest] + [-1 if least is None else least], np.int64)
            valid = np.array([s is not None for s in smallest] + [least is not None], bool)
            repeats = has_doc & valid[began] & (doc > known[began])
            waits = np.where((finger == first) & has_doc & valid[began] & (doc == known[began]), number + began + 1, 0)
            mask = batch.column("mask").to_numpy() + np.where(repeats, REPEATED, 0)
            none, n = pa.nulls(len(finger), pa.string()), len(finger)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, _DOCUMENT, np.int32)), batch.column("part"), batch.column("doc_id"), pa.array(mask.astype(np.int32)), pa.array(waits, mask=waits == 0), pa.nulls(n, pa.int64()), none], schema=target
            )
            starts = [(_FIRST, None, s, None, number + k + 1, first, text[i].as_py()) for k, (i, s) in enumerate(zip(heads.tolist(), smallest, strict=True)) if finger[i] == first and s is not None]
            if began[0] < 0 and first == finger[0] and least is not None:  # the run of the last batch goes on
                starts.append((_FIRST, None, least, None, number, first, last_text))
            if starts:
                yield _rows(target, starts)
            number += len(heads) + 1
            if last != finger[-1]:
                open_runs = []
            open_runs += [(_LAST, None, s, None, None, int(finger[i]), text[i].as_py()) for i, s in zip(heads.tolist(), smallest, strict=True) if finger[i] == finger[-1] and s is not None]
            last, last_text = int(finger[-1]), text[-1].as_py()
            least = smallest[-1] if smallest else least
        if open_runs:
            yield _rows(target, open_runs)

    return frame.mapInArrow(run, _RUNS)


def _rows(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=f.type) for i, f in enumerate(schema)], schema=schema)


def failure_masks(documents: DataFrame) -> DataFrame:
    """(part, doc_id, mask) of every row: a bit for each filter that it fails."""
    small_batches(documents.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = documents.select(F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    keyed = rows.select("*", F.xxhash64("text").alias("finger"), F.monotonically_increasing_id().alias("tie"))
    ranged = keyed.repartitionByRange("finger", F.col("doc_id").asc_nulls_last(), "tie").sortWithinPartitions("finger", "text", F.col("doc_id").asc_nulls_last())
    passed = durable(_sorted_pass(ranged.select("part", "doc_id", "text", "finger", own_mask(F.col("text")).alias("mask"))), of=documents)
    ends = passed.where(F.col("kind") == _LAST).groupBy("finger", "text").agg(F.min("doc_id").alias("least"))
    starts = passed.where(F.col("kind") == _FIRST).select("run", "finger", "text", "doc_id")
    earlier = starts.join(ends, ["finger", "text"]).where("least < doc_id").select("run", F.lit(REPEATED).alias("bit")).distinct()
    found = passed.where(F.col("kind") == _DOCUMENT)
    waiting = found.where("run is not null").join(earlier, "run", "left").select("part", "doc_id", (F.col("mask") + F.coalesce("bit", F.lit(0))).alias("mask"))
    return found.where("run is null").select("part", "doc_id", "mask").unionByName(waiting)


def _counters(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, counts): for each combination of failures, how many documents, good ones and toxic ones."""
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    told = known.agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    one, nothing = masks.where("doc_id is not null").join(told, "doc_id", "left"), F.lit(None).cast("int")
    marked = one.select("part", "mask", "good", "toxic").unionByName(masks.where("doc_id is null").select("part", "mask", nothing.alias("good"), nothing.alias("toxic")))
    sums = marked.groupBy("part", "mask").agg(F.count("*").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))
    return sums.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("counts"))  # 32 at most


def filter_interactions(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)."""
    counters = _counters(failure_masks(documents), labels)
    orders = F.split(F.lit(" ".join(map("".join, permutations(FILTERS)))), " ")
    each = counters.select("part", "counts", F.explode(orders).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))

    def bits_of(letters: Column) -> Column:
        return functools.reduce(Column.__add__, [F.when(F.contains(letters, F.lit(f)), 1 << i).otherwise(0) for i, f in enumerate(FILTERS)])

    own, earlier = F.substring("filter_order", F.col("step"), F.lit(1)), F.substring("filter_order", F.lit(1), F.col("step") - 1)
    each = each.select("*", bits_of(own).alias("bit"), bits_of(earlier).alias("before"))

    def total(weight, when) -> Column:
        return F.aggregate("counts", F.lit(0).cast("long"), lambda done, c: done + F.when(when(c["mask"]), weight(c)).otherwise(0).cast("long"))

    bit, before = F.col("bit"), F.col("before")

    def fails(m):
        return m.bitwiseAND(bit) != 0

    def early(m):
        return m.bitwiseAND(before) != 0

    rounds = len(list(permutations(FILTERS)))
    return each.select(
        "part",
        "filter_order",
        "step",
        total(lambda c: c["n"], lambda m: m.bitwiseAND(before.bitwiseOR(bit)) == 0).alias("kept"),
        total(lambda c: c["n"], lambda m: fails(m) & ~early(m)).alias("removed"),
        total(lambda c: c["n"], lambda m: fails(m) & early(m)).alias("redundant"),
        total(lambda c: c["n"], lambda m: m == bit).alias("unique_fails"),
        total(lambda c: c["good"], lambda m: fails(m) & ~early(m)).alias("good_lost"),
        total(lambda c: c["toxic"], lambda m: fails(m) & ~early(m)).alias("toxic_lost"),
        # of the orders, the filter comes first among a mask's k failures in one of k
        total(lambda c: c["n"] * F.floor(F.lit(rounds) / F.bit_count(c["mask"])), fails).alias("shapley"),
    )


def oracle_sql() -> str:
    words = "list_filter(regexp_split_to_array(t, '[ \\t\\n\\v\\f\\r]+'), lambda w: w <> '')"
    fails = ("len(ws) < 200", "100 * len(list_distinct(ws)) < 50 * len(ws)", "100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t)", "regexp_matches(t, '[#$%&*|]')", "coalesce(doc_id > min(doc_id) over (partition by t), false)")
    named = ", ".join(f"({f}) as f{i}" for i, f in enumerate(fails))
    orders = ", ".join(f"('{''.join(o)}')" for o in permutations(FILTERS))
    mask = " + ".join(f"f{i}::int * {1 << i}" for i in range(len(fails)))
    return f"""with d as (select coalesce(lang, '') as part, doc_id, coalesce(text, '') as t from documents),
    w as (select *, {words} as ws from d), f as (select part, doc_id, {named} from w),
    l as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by doc_id),
    m as (select part, {mask} as mask, count(*) as n, coalesce(sum(good), 0) as good, coalesce(sum(toxic), 0) as toxic from f left join l using (doc_id) group by all),
    o as (select filter_order, step, 1 << (position(filter_order[step] in '{FILTERS}') - 1) as bit, list_sum(list_transform(range(1, step), lambda k: 1 << (position(filter_order[k] in '{FILTERS}') - 1))) as b
      from (values {orders}) t(filter_order), range(1, 6) s(step)),
    r as (select part, filter_order, step::int as step, bit, coalesce(sum(n) filter (mask & (coalesce(b, 0) | bit)::bigint = 0), 0) as kept, coalesce(sum(n) filter (mask & bit <> 0 and mask & coalesce(b, 0)::bigint = 0), 0) as removed,
      coalesce(sum(n) filter (mask & bit <> 0 and mask & coalesce(b, 0)::bigint <> 0), 0) as redundant, coalesce(sum(n) filter (mask = bit), 0) as unique_fails,
      coalesce(sum(good) filter (mask & bit <> 0 and mask & coalesce(b, 0)::bigint = 0), 0) as good_lost, coalesce(sum(toxic) filter (mask & bit <> 0 and mask & coalesce(b, 0)::bigint = 0), 0) as toxic_lost
      from m, o group by all)
    select part, filter_order, step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant, unique_fails::bigint as unique_fails, good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost,
      (sum(removed) over (partition by part, bit))::bigint as shapley from r"""
