"""Resolver namespaces and the postings derived from them: RPC call sites and Kafka topic sites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seine.functions.scalars import quoted_list, valid_topic
from seine.vocab import KAFKA_ABSTENTIONS


def resolver_conflicts(records: DataFrame, key: list[str], candidate: str) -> DataFrame:
    """Keys with two or more distinct candidates, and the candidates."""
    return records.groupBy(*key).agg(F.array_sort(F.collect_set(candidate)).alias("candidates")).where(F.size("candidates") >= 2)


def resolve_exactly_one(calls: DataFrame, index: DataFrame, key: list[str], target: str) -> DataFrame:
    """Calls against an index: none skips, one resolves, several abstain."""
    held = index.groupBy(*key).agg(F.count_distinct(target).alias("n"), F.min(target).alias("one"))
    joined = calls.join(held, key)
    return joined.withColumn("class", F.when(F.col("n") == 1, "resolved").otherwise("abstained")).withColumn(target, F.when(F.col("n") == 1, F.col("one"))).drop("one")


_STATES = ("ambiguous", "unsupported", "unavailable")


def project_calls(calls: DataFrame, records: DataFrame) -> DataFrame:
    """RPC call sites to postings.

    ``calls``: call_id, selector, receiver (resolved, dynamic, other), namespaces (imported), bound (exactly bound namespaces).
    ``records``: namespace, method, operation, state (resolved, conflict, ambiguous, unsupported, unavailable).
    Records of an exact binding are preferred over those of mere imports. A call without candidates has no posting.
    """
    none = F.array().cast("array<string>")
    bound, imported = F.coalesce("bound", none), F.coalesce("namespaces", none)
    spread = calls.select("call_id", "selector", "receiver", F.explode(F.transform(F.array_distinct(F.concat(bound, imported)), lambda n: F.struct(n.alias("namespace"), F.array_contains(bound, n).alias("exact")))).alias("x")).select("call_id", "selector", "receiver", "x.*")
    found = spread.join(records, (spread["namespace"] == records["namespace"]) & (spread["selector"] == records["method"])).select("call_id", "receiver", "exact", "operation", "state")
    # one row per call: counts of the preferred subset, without gathering its records
    def over(flag: Column, c: Column) -> Column:
        return F.count_if(flag & c)

    exact, all_ = F.col("exact"), F.lit(True)
    aggregates = [F.bool_or("exact").alias("has_exact"), F.first("receiver").alias("receiver")]
    for name, flag in (("e", exact), ("a", all_)):
        aggregates += [over(flag, F.col("state") == s).alias(f"{name}_{s}") for s in ("resolved", "conflict", *_STATES)]
        aggregates += [F.count_distinct(F.when(flag & (F.col("state") == "resolved"), F.col("operation"))).alias(f"{name}_operations"), F.min(F.when(flag & (F.col("state") == "resolved"), F.col("operation"))).alias(f"{name}_operation")]
    per_call = found.groupBy("call_id").agg(*aggregates)

    def pick(what: str) -> Column:
        return F.when(F.col("has_exact"), F.col(f"e_{what}")).otherwise(F.col(f"a_{what}"))

    reason = F.when(F.col("receiver") == "dynamic", "dynamic_receiver").when(F.col("receiver") != "resolved", "unsupported_receiver").when(pick("conflict") > 0, "resolver_conflict")
    for s in _STATES:
        reason = reason.when(pick(s) > 0, f"resolver_{s}")
    reason = reason.when((pick("resolved") != 1) & (pick("operations") > 1), "ambiguous_method_candidates").when(pick("resolved") != 1, "ambiguous_receiver_provenance").when(~F.col("has_exact"), "name_match_only")
    out = per_call.select("call_id", reason.alias("reason"), pick("operation").alias("operation"))
    kind = F.when(F.col("reason").isNull(), "resolved").when(F.col("reason") == "name_match_only", "name_match").otherwise("unresolved")
    return out.select("call_id", kind.alias("class"), "reason", F.when(F.col("reason").isNull(), F.col("operation")).alias("operation"))


def kafka_postings(sites: DataFrame) -> DataFrame:
    """Topic sites (site_id, plane, topic, reason) to literal or unresolved postings; an invalid literal abstains."""
    literal = F.col("topic").isNotNull()
    ok = literal & valid_topic(F.col("topic"))
    reason = F.when(ok, None).when(literal, "invalid-topic-literal").otherwise(F.when(F.col("reason").isin(*KAFKA_ABSTENTIONS), F.col("reason")).otherwise("non-literal-expr"))
    return sites.select("site_id", "plane", F.when(ok, "literal").otherwise("unresolved").alias("class"), F.when(ok, F.col("topic")).alias("topic"), reason.alias("reason"))


def topic_evidence(sites: DataFrame) -> DataFrame:
    """Per plane and topic: strongest tier, sorted distinct libraries and shapes as JSON lists, number of sites."""
    rank = F.when(F.col("tier") == "exact", 4).when(F.col("tier") == "derived", 3).when(F.col("tier") == "heuristic", 2).otherwise(1)
    strongest = F.element_at(F.array(*[F.lit(t) for t in ("unresolved", "heuristic", "derived", "exact")]), F.max(rank))
    return sites.groupBy("plane", "topic").agg(strongest.alias("tier"), quoted_list(F.collect_set("library")).alias("libraries"), quoted_list(F.collect_set("shape")).alias("shapes"), F.count("*").alias("sites"))


def topic_census(assertions: DataFrame, planes: list[str], classes: list[str]) -> DataFrame:
    """Supporting sites per plane and abstention class, every class present."""
    from seine.operators.coverage import densified_counts

    return densified_counts(assertions, {"plane": planes, "class": classes}, F.sum(F.size("supporting")))


def collapse_anchors(anchors: DataFrame) -> DataFrame:
    """Symbol anchors, each once: differing declarations drop the symbol, differing lineages drop the lineage."""
    held = anchors.distinct().groupBy("symbol").agg(F.count_distinct("declaration").alias("declarations"), F.min("declaration").alias("declaration"), F.count_distinct("lineage").alias("lineages"), F.min("lineage").alias("lineage"))
    return held.where("declarations = 1").select("symbol", "declaration", F.when(F.col("lineages") == 1, F.col("lineage")).alias("lineage"))
