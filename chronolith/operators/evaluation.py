"""Retrieval quality: metrics, ceilings, abstention, calibration, clustered intervals, gates.

Rankings are (query_id, rank, key, score), judgments (query_id, key, relevance). Everything is
grouped by query, so any number of queries is one plan.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolith.operators.frames import running_sums, small


def first_hits(ranked: DataFrame) -> DataFrame:
    """Each key once per query, at its best rank; ranks close up."""
    once = ranked.groupBy("query_id", "key").agg(F.min("rank").alias("rank"))
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "key")))


def score_queries(ranked: DataFrame, judgments: DataFrame, k: int) -> DataFrame:
    """(query_id, recall, capacity_recall, mrr, ndcg) of every judged query.

    recall counts every judgment, capacity_recall distinct relevant keys against min(k, their number);
    ndcg has gains 2**relevance - 1 and its ideal from all judgments.
    """
    positive = judgments.where("relevance > 0")
    hits = first_hits(ranked).where(F.col("rank") <= k)
    gain = F.pow(F.lit(2.0), "relevance") - 1
    met = positive.join(hits, ["query_id", "key"], "left")
    per_key = met.groupBy("query_id", "key").agg(F.max("relevance").alias("relevance"), F.min("rank").alias("rank"), F.count("*").alias("times"))
    found = per_key.groupBy("query_id").agg(
        F.sum("times").alias("judged"),
        F.sum(F.when(F.col("rank").isNotNull(), F.col("times")).otherwise(0)).alias("hit"),
        F.count("*").alias("keys"),
        F.count("rank").alias("hit_keys"),
        F.min("rank").alias("first"),
        F.coalesce(F.sum(F.when(F.col("rank").isNotNull(), gain / F.log2(F.col("rank") + 1.0))), F.lit(0.0)).alias("dcg"),
    )
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("relevance"), "key"))
    ideal = positive.groupBy("query_id", "key").agg(F.max("relevance").alias("relevance")).withColumn("at", order).where(F.col("at") <= k).groupBy("query_id").agg(F.sum(gain / F.log2(F.col("at") + 1.0)).alias("ideal"))
    asked = judgments.select("query_id").distinct()  # queries without a relevant judgment score 0
    return asked.join(found, "query_id", "left").join(ideal, "query_id", "left").select(
        "query_id",
        F.round(F.coalesce(F.col("hit") / F.col("judged"), F.lit(0.0)), 6).alias("recall"),
        F.round(F.coalesce(F.col("hit_keys") / F.least(F.col("keys"), F.lit(k)), F.lit(0.0)), 6).alias("capacity_recall"),
        F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), 6).alias("mrr"),
        F.round(F.coalesce(F.try_divide("dcg", "ideal"), F.lit(0.0)), 6).alias("ndcg"),
    )


def quality(scored: DataFrame, queries: DataFrame) -> DataFrame:
    """(category, source, n, recall, mrr, ndcg) means in one pass over grouping sets: by category, by judgment
    source, and over all; queries that expect no answer are left out, waived ones do not count for recall."""
    rows = scored.join(queries.where("not expect_abstention"), "query_id")
    view = rows.select("category", F.col("judgment_source").alias("source"), F.when(~F.col("waived"), F.col("recall")).alias("recall"), "mrr", "ndcg")
    grouped = view.groupingSets([["category"], ["source"], []], "category", "source").agg(
        F.count("*").alias("n"), F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("mrr"), 6).alias("mrr"), F.round(F.avg("ndcg"), 6).alias("ndcg"), F.grouping_id().alias("level")
    )
    return grouped


def latency(times: DataFrame, by: list[str], value: str = "ms") -> DataFrame:
    """Mean, nearest-rank percentiles and maximum; windows run over distinct values with counts, not over rows."""
    counts = times.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("times"))
    sizes = counts.groupBy(*by).agg(F.sum("times").alias("size"))
    sized = counts.join(small(sizes), by) if by else counts.crossJoin(sizes)  # one row
    run = running_sums(sized, value, ["times"], by).withColumn("upto", F.col("times_before") + F.col("times"))

    def nearest(q: float) -> Column:
        return F.min(F.when(F.col("upto") >= F.greatest(F.ceil(F.lit(q) * F.col("size")), F.lit(1)), F.col(value)))

    mean = F.sum(F.col(value) * F.col("times")) / F.sum("times")
    return run.groupBy(*by).agg(F.sum("times").alias("n"), F.round(mean, 6).alias("mean"), nearest(0.5).alias("p50"), nearest(0.95).alias("p95"), nearest(0.99).alias("p99"), F.max(value).alias("max"))


def recall_ceiling(judgments: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(category, n_queries, mean_ceiling, min_ceiling, capped): the best recall that k results admit; category null is all."""
    size = judgments.where("relevance > 0").groupBy("query_id").agg(F.count("*").alias("n"))
    rows = size.join(queries.where("not expect_abstention and not waived"), "query_id").withColumn("ceiling", F.least("n", F.lit(k)) / F.col("n"))
    return rows.groupingSets([["category"], []], "category").agg(F.count("*").alias("n_queries"), F.round(F.avg("ceiling"), 6).alias("mean_ceiling"), F.round(F.min("ceiling"), 6).alias("min_ceiling"), F.count_if(F.col("n") > k).alias("capped"))


def abstention(results: DataFrame) -> DataFrame:
    """One row over queries that expect nothing: (query_id, group_id, returned, top_score)."""
    return results.agg(
        F.count("*").alias("n_queries"),
        F.count_distinct(F.coalesce("group_id", F.col("query_id").cast("string"))).alias("n_groups"),
        F.round(F.avg((F.col("returned") == 0).cast("double")), 6).alias("abstained"),
        F.round(F.avg("returned"), 6).alias("mean_false_results"),
        F.round(F.greatest(F.coalesce(F.max("top_score"), F.lit(0.0)), F.lit(0.0)), 6).alias("max_false_score"),
    )


def risk_coverage(negatives: DataFrame, positives: DataFrame, points: int = 12) -> DataFrame:
    """(threshold, abstained, answer_retained) at every (n / 12)-th distinct score.

    Counts come from one ordering of all scores with running sums, not from a join of thresholds
    with queries. Scores are taken to nine digits, which merges equal ones.
    """
    scores = negatives.select(F.round("top_score", 9).alias("t"), F.lit(1).alias("neg"), F.lit(0).alias("pos")).unionByName(positives.select(F.round("top_relevant_score", 9).alias("t"), F.lit(0).alias("neg"), F.lit(1).alias("pos")))
    zero = negatives.limit(1).select(F.lit(0.0).alias("t"), F.lit(0).alias("neg"), F.lit(0).alias("pos"))
    steps = scores.where("t is not null").unionByName(zero).groupBy("t").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))
    summed = running_sums(steps.withColumn("one", F.lit(1)), "t", ["neg", "pos", "one"])
    size = steps.agg(F.count("*").alias("size"))
    run = summed.select("t", (F.col("neg") + F.col("neg_before")).alias("neg"), (F.col("pos") + F.col("pos_before")).alias("pos"), (F.col("one_before") + 1).alias("place")).crossJoin(size)
    total = negatives.agg(F.count("*").alias("negatives")).crossJoin(positives.agg(F.count("*").alias("positives"), F.count("top_relevant_score").alias("found")))
    every = run.where((F.col("place") - 1) % F.greatest(F.floor(F.col("size") / points), F.lit(1)) == 0).crossJoin(total)
    retained = F.coalesce(F.try_divide(F.col("found") - F.col("pos"), F.col("positives")), F.lit(0.0))
    return every.select(F.col("t").alias("threshold"), F.round(F.col("neg") / F.col("negatives"), 6).alias("abstained"), F.round(retained, 6).alias("answer_retained"))


def auc(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, auc) over (label boolean, score): rank sums with mean ranks for ties, so 0.5 for each tie."""
    by = by or []
    counts = scored.groupBy(*by, "score").agg(F.count_if("label").alias("pos"), F.count_if(~F.col("label")).alias("neg"))
    won = running_sums(counts, "score", ["neg"], by).withColumn("won", F.col("pos") * (F.col("neg_before") + F.col("neg") / 2))
    return won.groupBy(*by).agg(F.round(F.try_divide(F.sum("won"), F.sum("pos") * F.sum("neg")), 6).alias("auc"))


def clustered_mean(rows: DataFrame) -> DataFrame:
    """One row (rows, clusters, mean) over (group, value): the mean of group means; non-finite values are ignored."""
    fine = rows.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf")))
    groups = fine.groupBy("group").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    return groups.agg(F.sum("n").alias("rows"), F.count("*").alias("clusters"), F.round(F.avg("mean"), 6).alias("mean"))


def bootstrap_interval(means: list[float], draws: int = 2000) -> tuple[float, float]:
    """2.5 and 97.5 % bounds of the mean of resampled groups, by a fixed linear congruential sequence (modulo 2**64).

    Fixed values: the sequence's first state, multiplier and shift.
    """
    if not means:
        return 0.0, 0.0
    state, n, sums = 0x2545F4914F6CDD1D, len(means), []
    for _ in range(draws):
        total = 0.0
        for _ in range(n):
            state = (state * 6364136223846793005 + 1) % (1 << 64)
            total += means[(state >> 33) % n]
        sums.append(total / n)
    sums.sort()
    return sums[int(draws * 0.025)], sums[min(int(draws * 0.975), draws - 1)]


def query_set_digest(queries: list[tuple]) -> str:
    """Digest of a query set, whatever its order; every part is framed by its length."""
    rows = sorted("".join(f"{len(str(x))}:{x}" for x in q) for q in queries)
    return hashlib.sha256("\n".join(rows).encode()).hexdigest()


def compare_baseline(current: DataFrame, baseline: DataFrame, metric: str, most_loss: float) -> DataFrame:
    """(category, before, after, verdict): pass, fail, or indeterminate where a side lacks the category."""
    both = baseline.select("category", F.col(metric).alias("before")).join(current.select("category", F.col(metric).alias("after")), "category", "full_outer")
    verdict = F.when(F.col("before").isNull() | F.col("after").isNull(), "indeterminate").when(F.col("after") < F.col("before") - most_loss, "fail").otherwise("pass")
    return both.select("category", "before", "after", verdict.alias("verdict"))


def evaluate_gates(report: dict[str, float | None], gates: dict[str, tuple[str, float]]) -> dict[str, str]:
    """Verdict of each gate (metric: (min or max, bound)); a report that cannot answer is indeterminate."""
    out = {}
    for metric, (kind, bound) in gates.items():
        value = report.get(metric)
        if value is None or not math.isfinite(value):
            out[metric] = "indeterminate"
        else:
            out[metric] = "pass" if (value >= bound if kind == "min" else value <= bound) else "fail"
    return out


def project_alias(ranked: DataFrame, aliases: DataFrame) -> DataFrame:
    """Rankings with keys mapped to the granularity that was judged (alias, key); others stay."""
    return ranked.join(aliases.select(F.col("alias").alias("key"), F.col("key").alias("judged")), "key", "left").withColumn("key", F.coalesce("judged", "key")).drop("judged")


def unknown_keys(judgments: DataFrame, corpus: DataFrame) -> DataFrame:
    """Judged keys that the corpus lacks."""
    return judgments.select("key").distinct().join(corpus.select("key"), "key", "left_anti")


def missing_categories(baseline: DataFrame, current: DataFrame) -> DataFrame:
    return baseline.select("category").distinct().exceptAll(current.select("category").distinct())
