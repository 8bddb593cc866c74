"""Regression gates: a current report against a baseline, as rows (gate, verdict, detail).

Reports are small frames by category (category null: overall) with recall, mrr, ndcg, n and
judgments_complete; ceilings come from ``evaluation.recall_ceiling``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Limits:
    """Largest drops and smallest ceilings that a run may have."""

    category_drop: float = 0.01
    aggregate_drop: float = 0.01
    recall_ceiling: float = 1.0
    query_ceiling: float = 1.0
    capped_queries: int = 0
    abstention_drop: float = 0.05


def _row(gate: Column, verdict: Column, detail: Column) -> list[Column]:
    return [gate.alias("gate"), verdict.alias("verdict"), detail.cast("string").alias("detail")]


def category_gates(current: DataFrame, baseline: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """One row per baseline category: a drop over judgments that are not complete decides nothing."""
    old = baseline.where("category is not null and n > 0").select("category", F.col("ndcg").alias("before"), F.col("judgments_complete").alias("whole"))
    new = current.where("category is not null").select("category", F.col("ndcg").alias("after"), "judgments_complete")
    both = old.join(new, "category")
    moved = F.round(F.col("before") - F.col("after"), 9) > limits.category_drop
    verdict = F.when(~moved, "pass").when(F.col("whole") & F.col("judgments_complete"), "fail").otherwise("indeterminate")
    return both.select(*_row(F.concat(F.lit("category:"), "category"), verdict, F.round(F.col("before") - F.col("after"), 6)))


def aggregate_gate(current: DataFrame, baseline: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Overall recall, mrr and ndcg, each against its baseline: one row for each metric."""

    def long(df: DataFrame, name: str) -> DataFrame:
        return df.where("category is null").select(F.explode(F.create_map(*[x for m in ("recall", "mrr", "ndcg") for x in (F.lit(m), F.col(m))])).alias("metric", name))

    both = long(baseline, "before").join(long(current, "after"), "metric", "left")
    drop = F.round(F.col("before") - F.col("after"), 9)
    verdict = F.when(drop.isNull(), "indeterminate").when(drop > limits.aggregate_drop, "fail").otherwise("pass")
    return both.select(*_row(F.concat(F.lit("aggregate:"), "metric"), verdict, F.round(drop, 6)))


def coverage_gate(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """Categories that the baseline has and the current report lacks."""
    lost = baseline.where("category is not null and n > 0").select("category").join(current.select("category"), "category", "left_anti")
    one = lost.agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("category")), ",").alias("names"))  # categories are few
    return one.select(*_row(F.lit("category_coverage"), F.when(F.col("n") == 0, "pass").otherwise("fail"), F.col("names")))


def ceiling_gates(ceiling: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Mean ceiling, worst query and capped queries of the whole set."""
    total = ceiling.where("category is null")

    def gate(name: str, value: str, bad: Column) -> DataFrame:
        return total.select(*_row(F.lit(name), F.when(F.col(value).isNull(), "indeterminate").when(bad, "fail").otherwise("pass"), F.col(value)))

    return (
        gate("recall_ceiling", "mean_ceiling", F.col("mean_ceiling") < limits.recall_ceiling)
        .unionByName(gate("query_ceiling", "min_ceiling", F.col("min_ceiling") < limits.query_ceiling))
        .unionByName(gate("capped_queries", "capped", F.col("capped") > limits.capped_queries))
    )


def abstention_gate(current: DataFrame, baseline: DataFrame, limits: Limits = Limits()) -> DataFrame:
    both = baseline.select(F.col("abstained").alias("before")).crossJoin(current.select(F.col("abstained").alias("after")))  # one row each
    drop = F.round(F.col("before") - F.col("after"), 9)
    return both.select(*_row(F.lit("abstention"), F.when(drop.isNull(), "indeterminate").when(drop > limits.abstention_drop, "fail").otherwise("pass"), F.round(drop, 6)))


def unresolved_gate(judgments: DataFrame, corpus: DataFrame) -> DataFrame:
    """Judged keys that no row of the corpus has make a run undecidable from a regression: fail."""
    lost = judgments.select("key").distinct().join(corpus.select("key").distinct(), "key", "left_anti").agg(F.count("*").alias("n"))
    return lost.select(*_row(F.lit("judgments_resolve"), F.when(F.col("n") == 0, "pass").otherwise("fail"), F.col("n")))


def abstention_sanity_gate(current: DataFrame) -> DataFrame:
    """A share of abstentions outside 0 to 1 over some queries is impossible; current is one row (n_queries, abstained)."""
    fine = (F.col("n_queries") == 0) | F.coalesce(F.col("abstained").between(0.0, 1.0), F.lit(False))
    return current.select(*_row(F.lit("abstention_wellformed"), F.when(fine, "pass").otherwise("fail"), F.col("abstained")))


def judgment_source_gates(current: DataFrame, baseline: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """One row per judgment source (source, ndcg, n) of the baseline: a slice that vanished or regressed fails."""
    old = baseline.where("source is not null and n > 0").select("source", F.col("ndcg").alias("before"))
    both = old.join(current.where("source is not null and n > 0").select("source", F.col("ndcg").alias("after")), "source", "left")
    drop = F.round(F.col("before") - F.col("after"), 9)
    verdict = F.when(F.col("after").isNull() | (drop > limits.category_drop), "fail").otherwise("pass")
    return both.select(*_row(F.concat(F.lit("judgment_source:"), "source"), verdict, F.round(drop, 6)))


def wellformed_gate(current: DataFrame, baseline: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """No metric of either report, and no limit, is missing or not a finite number; no limit is negative."""

    def odd(df: DataFrame, side: str) -> DataFrame:
        long = df.select(F.coalesce("category", F.lit("overall")).alias("c"), F.explode(F.create_map(*[x for m in ("recall", "mrr", "ndcg") for x in (F.lit(m), F.col(m))])).alias("metric", "value"))
        broken = F.col("value").isNull() | F.isnan("value") | (F.abs("value") == float("inf"))
        return long.where(broken).select(F.concat_ws(" ", F.lit(side), "c", "metric").alias("problem"))

    settings = {"category_drop": limits.category_drop, "aggregate_drop": limits.aggregate_drop, "recall_ceiling": limits.recall_ceiling, "query_ceiling": limits.query_ceiling, "abstention_drop": limits.abstention_drop}
    bad = [f"limit {n}" for n, v in settings.items() if not math.isfinite(v) or v < 0]
    found = odd(current, "current").unionByName(odd(baseline, "baseline")).unionByName(current.sparkSession.createDataFrame([(b,) for b in bad], "problem string"))
    one = found.agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("problem")), ",").alias("names"))  # a few metrics of a few categories
    return one.select(*_row(F.lit("report_wellformed"), F.when(F.col("n") == 0, "pass").otherwise("fail"), F.col("names")))


def comparability_gate(current: dict[str, str] | None, baseline: dict[str, str] | None, spark) -> DataFrame:
    """Whether both runs describe one experiment: every entry of their contracts is equal."""
    if not current or not baseline:
        verdict, detail = "indeterminate", "a report has no contract"
    else:
        odd = sorted(k for k in {*current, *baseline} if current.get(k) != baseline.get(k))
        verdict, detail = ("fail", ",".join(odd)) if odd else ("pass", "")
    return spark.createDataFrame([("comparable_experiment", verdict, detail)], "gate string, verdict string, detail string")


def overall(gates: DataFrame) -> DataFrame:
    """One row (verdict, failed, undecided): pass only when every gate passes."""
    sums = gates.agg(F.count_if(F.col("verdict") == "fail").alias("failed"), F.count_if(F.col("verdict") == "indeterminate").alias("undecided"))
    return sums.select(F.when(F.col("failed") > 0, "fail").when(F.col("undecided") > 0, "indeterminate").otherwise("pass").alias("verdict"), "failed", "undecided")
