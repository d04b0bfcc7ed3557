"""Coverage certificates: what was analysed, for every visible repository and domain, and in which state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seine.operators.analytics import set_digest
from seine.operators.evidence import latest_attempt, latest_published

SCOPE = ["repo", "domain"]


def coverage_state(indexed_scip: Column | None = None) -> Column:
    """First matching state of a certificate row (columns as in :func:`certificate`)."""
    published, attempt = F.col("run_id").isNotNull(), F.col("attempt_status")
    stale = ~F.coalesce(F.col("fresh"), F.lit(False))
    unsupported = F.col("domain").startswith("scip-") & ~(indexed_scip if indexed_scip is not None else F.lit(True))
    replaced = (attempt == "aborted") & (F.col("attempt_started") > F.col("started_at")) & (F.col("attempt_run") != F.col("run_id"))
    return (
        F.when(~published & (attempt == "staged"), "processing")
        .when(~published & (attempt == "aborted"), "failed")
        .when(~published, "unsupported")
        .when(stale, "stale")
        .when(unsupported, "unsupported")
        .when(F.col("failures") > 0, "failed")
        .when(replaced, "covered_with_failed_replacement")
        .otherwise("covered")
    )


def certificate(repos: DataFrame, domains: list[str], runs: DataFrame, failures: DataFrame | None = None) -> DataFrame:
    """One row per visible repository and domain. ``repos`` (repo, indexed_commit) are the visible ones only.

    The grid is the repositories times a short fixed list of domains, written as an explode; both run lookups are equi-joins.
    """
    grid = repos.select("repo", "indexed_commit", F.explode(F.array(*[F.lit(d) for d in domains])).alias("domain"))
    done = latest_published(runs, SCOPE).select(*SCOPE, "run_id", F.col("commit").alias("run_commit"), "started_at", "published_at")
    tried = latest_attempt(runs, SCOPE).select(*SCOPE, F.col("run_id").alias("attempt_run"), F.col("status").alias("attempt_status"), F.col("started_at").alias("attempt_started"))
    rows = grid.join(done, SCOPE, "left").join(tried, SCOPE, "left").withColumn("fresh", F.col("run_commit") == F.col("indexed_commit"))
    rows = rows.withColumn("failures", F.lit(0)) if failures is None else rows.join(failures.select(*SCOPE, "failures"), SCOPE, "left").withColumn("failures", F.coalesce("failures", F.lit(0)))
    return rows.withColumn("state", coverage_state())


def fingerprint(rows: DataFrame) -> DataFrame:
    """Digest of a certificate: equal for equal content, whatever the order of its rows."""
    line = F.concat_ws("|", "repo", "domain", F.coalesce("run_id", F.lit("-")), "state")
    return set_digest(rows, line, "cells", "digest", "coverage\0")


def state_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("domain", "state").agg(F.count("*").alias("repositories"))


def rows_state(rows: DataFrame, group: list[str], present: Column, gap: Column) -> DataFrame:
    """nonempty, gap or empty, per group: an empty answer over incomplete coverage is a gap, not an absence."""
    return rows.groupBy(*group).agg(F.when(F.count_if(present) > 0, "nonempty").when(F.bool_or(F.coalesce(gap, F.lit(False))), "gap").otherwise("empty").alias("rows_state"))


def densified_counts(rows: DataFrame, keys: dict[str, list[str]], count: Column) -> DataFrame:
    """Counts for every combination of the closed key lists, zero where there are none."""
    grid = rows.sparkSession.range(1).select()
    for name, values in keys.items():
        grid = grid.select("*", F.explode(F.array(*[F.lit(v) for v in values])).alias(name))
    held = rows.groupBy(*keys).agg(count.alias("n"))
    return grid.join(held, list(keys), "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def same_scopes(before: DataFrame, after: DataFrame) -> DataFrame:
    """True if both hold the same rows, as often."""
    differing = before.exceptAll(after).unionByName(after.exceptAll(before))
    return differing.agg((F.count("*") == 0).alias("equal"))
