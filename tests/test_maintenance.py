"""Ticks of maintenance against full runs, after random edits."""

import random

from chronolith.operators import lifecycle, maintenance

OBS = "id long, entity_id string, content string, observed_at long, valid_until long, confidence double, source string, tombstoned boolean, access_count long"
REL = "id long, from_entity string, to_entity string, valid_until long"


def test_ticks_equal_full_runs(spark, tmp_path):
    rng = random.Random(6)
    words = "red green blue fox hare owl moon sun tree hill".split()
    entities = [f"e{i}" for i in range(30)]
    observations = {i: (i, rng.choice(entities[:20]), " ".join(rng.choices(words, k=rng.randint(1, 6))), 1000 * rng.randrange(90), None, rng.random(), rng.choice(["chat", "correction"]), rng.random() < 0.1, rng.randrange(5)) for i in range(300)}
    relations = {i: (i, rng.choice(entities), rng.choice(entities), rng.choice([None, 50_000, 200_000])) for i in range(12)}
    log, version, folder = [(e, 1) for e in entities], 1, str(tmp_path)
    reports = []
    for number in range(3):
        frames = (spark.createDataFrame([(e,) for e in entities], "id string"), spark.createDataFrame(list(observations.values()), OBS), spark.createDataFrame(list(relations.values()), REL))
        changes = spark.createDataFrame(log, "entity_id string, version long")
        reports.append(maintenance.tick(folder, number, changes, *frames))
        if number == 1:  # the same tick again
            assert maintenance.tick(folder, number, changes, *frames) == reports[-1]

        def rows(df):
            return sorted(map(tuple, df.collect()))

        assert rows(maintenance.stored_duplicates(spark, folder)) == rows(lifecycle.duplicates(frames[1], 0.95))
        for now in (40_000, 100_000, 300_000):
            assert rows(maintenance.stored_retention(spark, folder, now, 0.3)) == rows(lifecycle.retention(frames[1], now, 0.3))
            assert rows(maintenance.stored_orphans(spark, folder, now)) == rows(lifecycle.orphans(*frames, now).select("id"))
        version += 1
        for _ in range(4):
            i = rng.randrange(300)
            if i not in observations:
                continue
            old = observations[i]
            if rng.random() < 0.3:
                del observations[i]
            else:
                observations[i] = (i, rng.choice(entities[:22]), rng.choice([old[2], "owl moon"]), 99_000, None, 0.9, old[6], rng.random() < 0.3, 1)
                log.append((observations[i][1], version))
            log.append((old[1], version))
        gone = relations.pop(next(iter(relations)))
        log += [(gone[1], version), (gone[2], version)]
    assert reports[0]["scanned"] == reports[0]["total"] and all(0 < r["scanned"] < r["total"] for r in reports[1:])
    assert [r["upto"] for r in reports] == [1, 2, 3]
    idle = maintenance.tick(folder, 3, spark.createDataFrame([r for r in log if r[1] < 4], "entity_id string, version long"), *frames)
    assert idle["scanned"] == idle["entities"] == 0 and idle["upto"] == 3
