"""Journal shards: replay from any prefix, repeated numbers, torn lines, stopped batches, gaps, truncation."""

import json

import pytest
from pyspark.sql import functions as F

from chronolith.streaming import journal


def line(seq, name="Ann", **more):
    return json.dumps({"seq": seq, "name": name, "entity_type": "person", "observations": [f"o{seq}"], "source": "s", "at": seq} | more)


def append(folder, shard, lines, part, end="\n"):
    place = folder / f"shard={shard}"
    place.mkdir(parents=True, exist_ok=True)
    (place / f"{part}.jsonl").write_text("\n".join(lines) + end)


def rows(df):
    return sorted((r["shard"], r["seq"], r["name"]) for r in df.collect())


def test_replay_from_any_prefix(spark, tmp_path):
    wanted = None
    for cut in ((9,), (4, 9), (1, 2, 9)):
        folder, store, at = tmp_path / f"j{len(cut)}", str(tmp_path / f"s{len(cut)}"), 0
        for part, upto in enumerate(cut):
            append(folder, 0, [line(i) for i in range(at, upto)], part)
            append(folder, 1, [line(10 * i, "Bob") for i in range(at, upto)], part)
            at = upto
            assert journal.replay(spark, str(folder), store) == part
        now = rows(journal.applied(spark, store))
        assert wanted is None or now == wanted
        wanted = now
        # once more: nothing is new, and an empty batch takes no shard back
        journal.replay(spark, str(folder), store)
        assert rows(journal.applied(spark, store)) == wanted
        assert {(r["shard"], r["seq"]) for r in journal.checkpoints(spark, store).collect()} == {(0, 8), (1, 80)}
    assert len(wanted) == 18


def test_repeats_and_torn_lines(spark, tmp_path):
    folder, store = tmp_path / "j", str(tmp_path / "s")
    append(folder, 3, [line(1), line(2, "Bob"), line(2, "Abe"), "", '{"name": "no number"}', "[1]", line(3)[:-9]], "a", "")
    journal.replay(spark, str(folder), store)
    assert rows(journal.applied(spark, store)) == [(3, 1, "Ann"), (3, 2, "Abe")]
    assert journal.torn(spark, str(folder)).count() == 3
    # the writer comes back: the torn entry whole, an applied one again in a later batch
    append(folder, 3, [line(3), line(1, "Zoe")], "b")
    journal.replay(spark, str(folder), store)
    assert rows(journal.applied(spark, store)) == [(3, 1, "Ann"), (3, 2, "Abe"), (3, 3, "Ann")]


def test_a_stopped_batch_is_written_anew(spark, tmp_path):
    folder, store = tmp_path / "j", str(tmp_path / "s")
    append(folder, 0, [line(1)], "a")
    journal.replay(spark, str(folder), store)
    spark.createDataFrame([(0, 7, "half")], "shard int, seq long, name string").write.parquet(f"{store}/applied/batch=1")
    assert rows(journal.applied(spark, store)) == [(0, 1, "Ann")]
    append(folder, 0, [line(2)], "b")
    assert journal.replay(spark, str(folder), store) == 1
    assert rows(journal.applied(spark, store)) == [(0, 1, "Ann"), (0, 2, "Ann")]


def test_truncate(spark, tmp_path):
    folder, store, rest = tmp_path / "j", str(tmp_path / "s"), str(tmp_path / "rest")
    append(folder, 0, [line(1), line(2)], "a")
    append(folder, 5, [line(4)], "a")
    journal.replay(spark, str(folder), store)
    append(folder, 0, [line(3, "Abe")], "b")
    journal.truncate(spark, str(folder), store, rest)
    assert rows(journal.entries(journal.read_lines(spark, rest)).select("shard", "entry.*")) == [(0, 3, "Abe")]
    for place in (rest, str(folder), rest):
        journal.replay(spark, place, store)
    assert rows(journal.applied(spark, store)) == [(0, 1, "Ann"), (0, 2, "Ann"), (0, 3, "Abe"), (5, 4, "Ann")]


@pytest.mark.parametrize("width", [3, 1 << 16])
def test_gaps(spark, width):
    held = [(0, n * width // 3) for n in (1, 2, 3, 6, 7, 12)] + [(1, 5), (1, None), (2, 9), (2, 9)]
    df = spark.createDataFrame(held, "shard int, seq long")
    marks = spark.createDataFrame([(0, 0), (0, 1), (1, 3), (1, None)], "shard int, seq long")
    wanted = set()
    for shard in (0, 1, 2):
        done = max((s for x, s in ((0, 1), (1, 3)) if x == shard), default=None)
        seqs = sorted({s for x, s in held if x == shard and s is not None and (done is None or s > done)})
        for a, b in zip([done, *seqs] if done is not None else seqs, seqs if done is not None else seqs[1:]):
            if b > a + 1:
                wanted.add((shard, a + 1, b - 1))
    assert {tuple(r) for r in journal.gaps(df, marks).collect()} == wanted


def test_without_rows(spark):
    none = spark.createDataFrame([], "shard int, seq long, name string")
    marks = spark.createDataFrame([], "shard int, seq long")
    assert journal.replayable(none, marks).count() == 0 and journal.gaps(none, marks).count() == 0
    assert journal.merged_checkpoints(marks, marks).count() == 0
    clash = spark.createDataFrame([(0, 1, 2)], "shard int, seq long, row int").withColumn("value", F.lit("x"))
    assert journal.replayable(clash, marks).columns == ["shard", "seq", "row", "value"]


def test_gaps_shuffle_blocks_and_not_numbers(spark):
    """A long run of numbers is a row for every 64; gaps in blocks, between them and between ranges are as counted."""
    import random

    rng = random.Random(4)
    numbers = {s: sorted(rng.sample(range(-500, 140_000), 600) + list(range(1000, 1300)) + [65_535, 65_536]) for s in (0, 1)}
    held = spark.createDataFrame([(s, n) for s in numbers for n in numbers[s] * 2], "shard int, seq long")
    marks = spark.createDataFrame([(1, 40)], "shard int, seq long")
    want = set()
    for s, seqs in numbers.items():
        seqs = [40] + [n for n in seqs if n > 40] if s else seqs
        want |= {(s, a + 1, b - 1) for a, b in zip(seqs, seqs[1:]) if b > a + 1}
    assert {tuple(r) for r in journal.gaps(held, marks).collect()} == want
    dense = spark.range(64_000).select(F.lit(0).alias("shard"), F.col("id").alias("seq"))
    plan = journal.gaps(dense, marks)._jdf.queryExecution().optimizedPlan().toString()
    assert "bit_or" in plan and "lag(seq" not in plan
