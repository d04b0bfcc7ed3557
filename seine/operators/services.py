"""The service catalog: which paths belong to which service, and what follows from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seine.functions.scalars import ancestors, valid_path
from seine.vocab import DISPOSITIONS, MEMBERSHIP_ROLES, SERVICE_STATUSES

FAN_OUT_MOST = 20


def catalog_violations(services: DataFrame, memberships: DataFrame) -> DataFrame:
    """(rule, item) for every rule that the catalog breaks."""
    def say(rule: str, rows: DataFrame, item: Column) -> DataFrame:
        return rows.select(F.lit(rule).alias("rule"), item.cast("string").alias("item"))

    key, path = F.col("service_key"), F.col("path")
    known = services.select("service_key", "disposition").distinct()
    triple = F.concat_ws("|", "service_key", "path", "role")
    roles = memberships.groupBy("service_key").agg(F.collect_set("role").alias("roles"))
    per_path = memberships.groupBy("path").agg(F.countDistinct("service_key").alias("n"))
    claims = memberships.select("service_key", "path").distinct()
    nested = claims.select("service_key", "path", F.explode(ancestors(path)).alias("above")).where("above <> path").join(claims.select("service_key", F.col("path").alias("above")), ["service_key", "above"], "left_semi")
    parts = [
        say("duplicate_service", services.groupBy("service_key").agg(F.count("*").alias("n")).where("n > 1"), key),
        say("unknown_disposition", services.where(~F.col("disposition").isin(*DISPOSITIONS)), key),
        say("unknown_service", memberships.join(known, "service_key", "left_anti").select("service_key").distinct(), key),
        say("unknown_role", memberships.where(~F.col("role").isin(*MEMBERSHIP_ROLES)), triple),
        say("bad_path", memberships.where(~valid_path(path)).select("path").distinct(), path),
        say("duplicate_membership", memberships.groupBy("service_key", "path", "role").agg(F.count("*").alias("n")).where("n > 1"), triple),
        say("accepted_without_primary", known.where("disposition = 'accepted'").join(roles, "service_key", "left").where(~F.coalesce(F.array_contains("roles", "primary"), F.lit(False))), key),
        say("typed_without_supporting", roles.where(F.array_contains("roles", "typed") & ~F.array_contains("roles", "supporting")), key),
        say("nested_path", nested, F.concat_ws("|", "service_key", "path")),
        say("fan_out", per_path.where(F.col("n") > FAN_OUT_MOST), path),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def placements(files: DataFrame, memberships: DataFrame, unowned: DataFrame | None = None) -> DataFrame:
    """(repo, path, service_key, roles, placement): every file with each service that claims it or an ancestor of it.

    Files are exploded to their ancestors and met by an equi-join; ``unowned`` counts on the exact path only. Files that
    nothing claims come out as ``unclaimed``.
    """
    paths = files.select("repo", "path").where("path IS NOT NULL").distinct()
    above = paths.select("repo", "path", F.explode(ancestors(F.col("path"))).alias("prefix"))
    claims = memberships.select("repo", F.col("path").alias("prefix"), "service_key", "role").distinct()
    claimed = above.join(claims, ["repo", "prefix"]).groupBy("repo", "path", "service_key").agg(F.array_sort(F.collect_set("role")).alias("roles"))
    out = claimed.select("repo", "path", "service_key", "roles", F.lit("accepted").alias("placement"))
    rest = paths.join(claimed.select("repo", "path").distinct(), ["repo", "path"], "left_anti")
    none = [F.lit(None).cast("string").alias("service_key"), F.array().cast("array<string>").alias("roles")]
    if unowned is None:
        return out.unionByName(rest.select("repo", "path", *none, F.lit("unclaimed").alias("placement")))
    free = rest.join(unowned.select("repo", "path", F.lit(True).alias("_free")).distinct(), ["repo", "path"], "left")
    return out.unionByName(free.select("repo", "path", *none, F.when(F.col("_free"), "unowned").otherwise("unclaimed").alias("placement")))


def census(files: DataFrame, memberships: DataFrame, unowned: DataFrame) -> DataFrame:
    """(problem, path): files both owned and unowned, files neither, claims and unowned entries that no file uses."""
    placed = placements(files, memberships)
    owned = placed.where("placement = 'accepted'").select("repo", "path").distinct()
    paths = files.select("repo", "path").where("path IS NOT NULL").distinct()
    free = unowned.select("repo", "path").distinct()
    used = paths.select("repo", F.explode(ancestors(F.col("path"))).alias("path")).distinct()

    def say(problem: str, rows: DataFrame) -> DataFrame:
        return rows.select(F.lit(problem).alias("problem"), "repo", "path")

    return (
        say("both", owned.join(free, ["repo", "path"], "left_semi"))
        .unionByName(say("neither", paths.join(owned, ["repo", "path"], "left_anti").join(free, ["repo", "path"], "left_anti")))
        .unionByName(say("unused_claim", memberships.select("repo", "path").distinct().join(used, ["repo", "path"], "left_anti")))
        .unionByName(say("unused_unowned", free.join(paths, ["repo", "path"], "left_anti")))
    )


def role_counts(memberships: DataFrame) -> DataFrame:
    """Per service: claims by role and distinct paths."""
    return memberships.groupBy("service_key").agg(*[F.count_if(F.col("role") == r).alias(r) for r in MEMBERSHIP_ROLES], F.countDistinct("path").alias("paths"))


def status_summary(states: DataFrame, group: list[str]) -> DataFrame:
    """Services by status, live ones and tombstones."""
    return states.groupBy(*group).agg(*[F.count_if(F.col("status") == s).alias(s) for s in SERVICE_STATUSES], F.count_if(F.col("status") != "removed").alias("live"), F.count("*").alias("total"))


def successors(services: DataFrame) -> DataFrame:
    """Rejected services with each successor and its disposition (null if it is not in the catalog)."""
    rejected = services.where("disposition = 'rejected'").select("service_key", F.explode("successors").alias("successor"))
    return rejected.join(services.select(F.col("service_key").alias("successor"), F.col("disposition").alias("successor_disposition")), "successor", "left")


def participation(edges: DataFrame, placed: DataFrame) -> DataFrame:
    """Per edge and service the roles it has: source, target or both. Accepted claims only."""
    owners = placed.where("placement = 'accepted'").select("repo", "path", "service_key")
    ends = edges.select("edge_id", "repo", F.inline(F.array(F.struct(F.lit("source").alias("end"), F.col("source_path").alias("path")), F.struct(F.lit("target").alias("end"), F.col("target_path").alias("path")))))
    return ends.join(owners, ["repo", "path"]).groupBy("edge_id", "service_key").agg(F.array_sort(F.collect_set("end")).alias("participation"))


def relationship_view(references: DataFrame, view: str) -> DataFrame:
    """all, dependencies (source of an rpc edge), callers (target of one) or topics."""
    part = F.col("participation")
    want = {"all": F.lit(True), "dependencies": F.array_contains(part, "source") & (F.col("kind") == "rpc"), "callers": F.array_contains(part, "target") & (F.col("kind") == "rpc"), "topics": F.col("kind") == "kafka"}
    return references.where(want[view])


def counterparts(parts: DataFrame) -> DataFrame:
    """Per edge and service the other services on the opposite side."""
    side = parts.select("edge_id", "service_key", F.explode("participation").alias("end"))
    other = side.select("edge_id", F.col("service_key").alias("other"), F.col("end").alias("other_end"))
    pairs = side.join(other, "edge_id").where("end <> other_end AND service_key <> other")
    return pairs.groupBy("edge_id", "service_key").agg(F.array_sort(F.collect_set("other")).alias("counterparts"))


def dependency_graph(parts: DataFrame) -> DataFrame:
    """(source_service, target_service, edges)."""
    source = parts.where(F.array_contains("participation", "source")).select("edge_id", F.col("service_key").alias("source_service"))
    target = parts.where(F.array_contains("participation", "target")).select("edge_id", F.col("service_key").alias("target_service"))
    return source.join(target, "edge_id").groupBy("source_service", "target_service").agg(F.count("*").alias("edges"))
