"""Merging two snapshots: identity candidates, evidence, three-way values, plans and their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolith.functions.text import framed_digest, normalized_label
from chronolith.operators.frames import small, top_k

# Signals by priority.
SIGNALS = ("lineage", "verified_identifier", "exact_label", "alias")


def three_way(base: Column, source: Column, target: Column) -> Column:
    """(value, origin): base, source, target, identical, or conflict with a null value."""
    s, t, both = source.eqNullSafe(base), target.eqNullSafe(base), source.eqNullSafe(target)
    origin = F.when(s & t, "base").when(~s & t, "source").when(s & ~t, "target").when(both, "identical").otherwise("conflict")
    value = F.when(t, source).when(s, target).when(both, source)
    return F.struct(value.alias("value"), origin.alias("origin"))


def merge_fields(base: DataFrame, source: DataFrame, target: DataFrame) -> DataFrame:
    """(id, field, value, origin) over long tables (id, field, value); a missing field is a value of its own."""

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select("id", "field", F.col("value").alias(name))

    every = side(base, "b").join(side(source, "s"), ["id", "field"], "full_outer").join(side(target, "t"), ["id", "field"], "full_outer")
    merged = every.withColumn("m", three_way(F.col("b"), F.col("s"), F.col("t")))
    return merged.select("id", "field", F.col("m.value").alias("value"), F.col("m.origin").alias("origin"))


def identity_candidates(target: DataFrame, source: DataFrame, cap: int = 128) -> DataFrame:
    """(source_id, rank, target_id, signals, priority, total, truncated).

    Both sides are (id, label, kind, aliases, lineage, identifiers as structs of namespace, value, verified).
    Records with the same label, kind, aliases and verified identifiers are one class on either side. Classes meet by equality joins,
    one per signal; a source takes the first candidates of the classes that its own class meets, and their number, so the work grows
    with pairs of classes and not of records. Candidates rank by best signal, then id.
    """
    if not 1 <= cap <= 128:
        raise ValueError("cap must be within 1..128")

    def lineage(df: DataFrame, name: str) -> DataFrame:
        return df.where("lineage is not null").select(F.col("id").alias(name), F.struct(F.lit(0).alias("signal"), F.lit("").alias("space"), F.col("lineage").alias("value")).alias("k"))

    def verified(df: DataFrame, name: str) -> DataFrame:
        one = df.select(F.col("id").alias(name), F.explode("identifiers").alias("i")).where("i.verified")
        return one.select(name, F.struct(F.lit(1).alias("signal"), F.col("i.namespace").alias("space"), F.col("i.value").alias("value")).alias("k"))

    def label(df: DataFrame, name: str, signal: int) -> DataFrame:
        return df.select(F.col("id").alias(name), F.struct(F.lit(signal).alias("signal"), F.coalesce("kind", F.lit("\0")).alias("space"), normalized_label(F.col("label")).alias("value")).alias("k"))

    def alias(df: DataFrame, name: str) -> DataFrame:
        one = df.select(F.col("id").alias(name), "kind", F.explode("aliases").alias("a"))
        return one.select(name, F.struct(F.lit(3).alias("signal"), F.coalesce("kind", F.lit("\0")).alias("space"), normalized_label(F.col("a")).alias("value")).alias("k"))

    have = lineage(target, "target_id").unionByName(verified(target, "target_id")).unionByName(label(target, "target_id", 2)).unionByName(label(target, "target_id", 3)).unionByName(alias(target, "target_id"))
    want = lineage(source, "source_id").unionByName(verified(source, "source_id")).unionByName(label(source, "source_id", 2)).unionByName(alias(source, "source_id"))
    of_source, source_keys = _classes(want.where("k.signal > 0"), "source_id", "wants")
    of_target, target_keys = _classes(have.where("k.signal > 0"), "target_id", "has")
    pairs = source_keys.join(target_keys, "k").groupBy("wants", "has").agg(F.array_sort(F.collect_set("k.signal")).alias("codes"))
    totals = pairs.join(of_target.groupBy("has").agg(F.count("*").alias("n")), "has").groupBy("wants").agg(F.sum("n").alias("total"))
    least = top_k(of_target, [F.col("target_id")], cap, ["has"], "nth").select("has", "target_id")
    first = top_k(pairs.join(least, "has"), [F.col("codes")[0], F.col("target_id")], cap, ["wants"], "nth").select("wants", "target_id", "codes")
    # lineage is a candidate's own: it comes before what its class has, and adds to the total where the class has nothing
    kin = want.where("k.signal = 0").join(have.where("k.signal = 0"), "k").select("source_id", "target_id").distinct()
    placed = kin.join(of_source, "source_id").join(of_target, "target_id").join(pairs, ["wants", "has"], "left")
    kin = placed.select("source_id", "target_id", F.array_insert(F.coalesce("codes", F.array().cast("array<int>")), 1, F.lit(0)).alias("codes"), F.col("codes").isNull().cast("long").alias("more"))
    others = of_source.join(first, "wants").join(kin.select("source_id", "target_id"), ["source_id", "target_id"], "left_anti")
    near = others.select("source_id", "target_id", "codes").unionByName(kin.select("source_id", "target_id", "codes"))
    ranked = top_k(near.withColumn("priority", F.col("codes")[0]), [F.col("priority"), F.col("target_id")], cap, ["source_id"])
    more = kin.groupBy("source_id").agg(F.sum("more").alias("more"))
    counted = of_source.join(totals, "wants", "left").join(more, "source_id", "left").select("source_id", (F.coalesce("total", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("total"))
    names = F.array(*[F.lit(s) for s in SIGNALS])
    rows = ranked.join(counted, "source_id")
    return rows.select("source_id", "rank", "target_id", F.array_join(F.transform("codes", lambda c: F.get(names, c)), ",").alias("signals"), "priority", "total", (F.col("total") > cap).alias("truncated"))


def _classes(keys: DataFrame, name: str, cls: str) -> tuple[DataFrame, DataFrame]:
    """(id, class) of each id of (id, k), where equal sets of keys are one class, and (class, k)."""
    sets = keys.groupBy(name).agg(F.array_sort(F.collect_set("k")).alias("keys"))
    named = sets.withColumn(cls, F.sha2(F.to_json("keys"), 256))
    return named.select(name, cls), named.groupBy(cls).agg(F.any_value("keys").alias("keys")).select(cls, F.explode("keys").alias("k"))


def pair_evidence(pairs: DataFrame, identifiers: DataFrame) -> DataFrame:
    """(left_id, right_id, supports, contradicts): verified identifiers of one namespace that agree or differ.

    A namespace contradicts when both sides have verified values there and none agrees.
    """
    good = identifiers.where("verified").select("id", "namespace", "value")
    left = pairs.join(good.withColumnRenamed("id", "left_id"), "left_id").withColumnRenamed("value", "lv")
    both = left.join(good.withColumnRenamed("id", "right_id"), ["right_id", "namespace"])
    by_space = both.groupBy("left_id", "right_id", "namespace").agg(F.bool_or(F.col("lv") == F.col("value")).alias("agrees"))
    sums = by_space.groupBy("left_id", "right_id").agg(F.count_if("agrees").alias("supports"), F.count_if(~F.col("agrees")).alias("contradicts"))
    return pairs.join(sums, ["left_id", "right_id"], "left").na.fill(0, ["supports", "contradicts"])


def kind_compatible(pairs: DataFrame, policy: DataFrame) -> DataFrame:
    """Pairs (left_kind, right_kind, ...) whose kinds are equal, unknown on a side, or listed together in the policy."""
    listed = policy.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).distinct().withColumn("listed", F.lit(True))
    keyed = pairs.withColumns({"x": F.least("left_kind", "right_kind"), "y": F.greatest("left_kind", "right_kind")})
    joined = keyed.join(small(listed), ["x", "y"], "left")
    fine = F.col("left_kind").isNull() | F.col("right_kind").isNull() | (F.col("left_kind") == F.col("right_kind")) | F.coalesce("listed", F.lit(False))
    return joined.withColumn("compatible", fine).drop("x", "y", "listed")


def snapshot_problems(entities: DataFrame, observations: DataFrame, relations: DataFrame) -> DataFrame:
    """(problem, id): repeated ids and references to entities that the snapshot lacks."""
    known = entities.select(F.col("id").alias("ref")).distinct()
    twice = entities.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("repeated entity").alias("problem"), F.col("id").cast("string").alias("id"))
    loose = observations.select(F.col("entity_id").alias("ref"), "id").join(known, "ref", "left_anti").select(F.lit("observation without entity").alias("problem"), F.col("id").cast("string").alias("id"))
    ends = relations.select(F.explode(F.array("from_entity", "to_entity")).alias("ref"), "id").join(known, "ref", "left_anti").select(F.lit("relation without end").alias("problem"), F.col("id").cast("string").alias("id")).distinct()
    return twice.unionByName(loose).unionByName(ends)


def plan_merge(target: DataFrame, source: DataFrame, same: DataFrame) -> DataFrame:
    """(source_id, action, target_id) for every source entity: merge into a reviewed equal, keep one that
    the target already has, or add. ``same`` are reviewed pairs (source_id, target_id); of several the
    smallest target counts."""
    reviewed = same.groupBy("source_id").agg(F.min("target_id").alias("target_id"))
    there = target.select("id", F.lit(True).alias("there"))
    rows = source.select("id").join(reviewed.withColumnRenamed("source_id", "id"), "id", "left").join(there, "id", "left")
    action = F.when(F.col("target_id").isNotNull(), "merge").when(F.col("there"), "keep").otherwise("add")
    return rows.select(F.col("id").alias("source_id"), action.alias("action"), F.coalesce("target_id", "id").alias("target_id"))


def plan_relations(plan: DataFrame, target: DataFrame, source: DataFrame) -> DataFrame:
    """(from_entity, relation_type, to_entity) to add: source relations under the plan's ids that the target lacks, once each."""
    ids = plan.select("source_id", "target_id")
    moved = source.join(ids, source["from_entity"] == ids["source_id"]).select(F.col("target_id").alias("f"), "relation_type", "to_entity")
    moved = moved.join(ids, moved["to_entity"] == ids["source_id"]).select(F.col("f").alias("from_entity"), "relation_type", F.col("target_id").alias("to_entity"))
    return moved.distinct().join(target.select("from_entity", "relation_type", "to_entity"), ["from_entity", "relation_type", "to_entity"], "left_anti")


def plan_accounting(plan: DataFrame) -> DataFrame:
    return plan.groupBy("action").agg(F.count("*").alias("n"))


def plan_digest(plan: DataFrame) -> DataFrame:
    """One row (rows, digest): an order-free digest, each task reducing its own rows to a sum."""
    value = F.conv(F.substring(F.sha2(F.concat_ws("\0", *plan.columns), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return plan.agg(F.count("*").alias("rows"), F.sha2(F.sum(value).cast("string"), 256).alias("digest"))


def verify_plan(plan: DataFrame, target: DataFrame, source: DataFrame) -> DataFrame:
    """(problem, id): what keeps a plan from being carried out on these snapshots, which may be newer than the plan."""
    mine = source.select(F.col("id").alias("source_id")).distinct()
    there = target.select(F.col("id").alias("target_id")).distinct()
    rows = plan.groupBy("source_id").agg(F.count("*").alias("n"))

    def found(df: DataFrame, problem: str, column: str) -> DataFrame:
        return df.select(F.lit(problem).alias("problem"), F.col(column).cast("string").alias("id"))

    parts = [
        found(rows.where("n > 1"), "planned twice", "source_id"),
        found(mine.join(rows, "source_id", "left_anti"), "not planned", "source_id"),
        found(rows.join(mine, "source_id", "left_anti"), "no longer in the source", "source_id"),
        found(plan.where("action in ('merge', 'keep')").join(there, "target_id", "left_anti"), "target is gone", "source_id"),
        found(plan.where("action = 'add'").join(there, "target_id", "left_semi"), "id is taken", "source_id"),
        found(plan.where("action not in ('merge', 'keep', 'add') or action is null or target_id is null"), "no such action", "source_id"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def identity_packets(pairs: DataFrame, identifiers: DataFrame, lineages: DataFrame, generation: int) -> DataFrame:
    """(left_id, right_id, supports, contradicts, claimed, same_lineage, trusted): all evidence on reviewed pairs.

    Identifiers are (id, namespace, value, verified, generation), lineages (id, lineage). ``claimed`` counts namespaces
    with an equal value that one side has not verified; a pair is trusted when some namespace agrees by
    verifications of this generation on both sides.
    """
    left = pairs.join(identifiers.select(F.col("id").alias("left_id"), "namespace", F.col("value").alias("lv"), F.col("verified").alias("lok"), F.col("generation").alias("lg")), "left_id")
    both = left.join(identifiers.select(F.col("id").alias("right_id"), "namespace", F.col("value").alias("rv"), F.col("verified").alias("rok"), F.col("generation").alias("rg")), ["right_id", "namespace"])
    equal, sure = F.col("lv") == F.col("rv"), F.col("lok") & F.col("rok")
    current = (F.col("lg") == generation) & (F.col("rg") == generation)
    by_space = both.groupBy("left_id", "right_id", "namespace").agg(
        F.bool_or(equal & sure).alias("agrees"), F.bool_or(sure).alias("known"), F.bool_or(equal & ~sure).alias("claims"), F.bool_or(equal & sure & current).alias("fresh")
    )
    sums = by_space.groupBy("left_id", "right_id").agg(
        F.count_if("agrees").alias("supports"), F.count_if(F.col("known") & ~F.col("agrees")).alias("contradicts"), F.count_if("claims").alias("claimed"), F.bool_or("fresh").alias("trusted")
    )
    one = lineages.where("lineage is not null").select("id", "lineage").distinct()
    same = pairs.join(one.withColumnRenamed("id", "left_id"), "left_id").join(one.withColumnRenamed("id", "right_id"), ["right_id", "lineage"]).select("left_id", "right_id", F.lit(True).alias("same_lineage")).distinct()
    rows = pairs.select("left_id", "right_id").distinct().join(sums, ["left_id", "right_id"], "left").join(same, ["left_id", "right_id"], "left")
    return rows.na.fill(0, ["supports", "contradicts", "claimed"]).na.fill(False, ["trusted", "same_lineage"]).select("left_id", "right_id", "supports", "contradicts", "claimed", "same_lineage", "trusted")


def discovery_digest(candidates: DataFrame) -> DataFrame:
    """Candidates with a digest of the pair and the signals it was found by: what a review receipt is bound to."""
    return candidates.withColumn("digest", framed_digest(F.col("source_id").cast("string"), F.col("target_id").cast("string"), F.col("signals")))


def reviewed(candidates: DataFrame, receipts: DataFrame) -> DataFrame:
    """(source_id, target_id, state): same, different or distinct by the last receipt (source_id, target_id, decision,
    digest, seq) that is bound to the pair as it is found now; stale where only older findings were reviewed; else open."""
    now = discovery_digest(candidates).select("source_id", "target_id", F.col("digest").alias("now"))
    met = now.join(receipts.where(F.col("decision").isin("same", "different", "distinct")), ["source_id", "target_id"], "left")
    fits = F.col("digest") == F.col("now")
    last = met.groupBy("source_id", "target_id").agg(F.max_by(F.when(fits, F.col("decision")), F.when(fits, F.col("seq"))).alias("decision"), F.count("seq").alias("n"))
    return last.select("source_id", "target_id", F.coalesce("decision", F.when(F.col("n") > 0, "stale").otherwise("open")).alias("state"))
