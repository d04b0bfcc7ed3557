"""Work queues as tables: each operation maps a job table to its next state. Rows an operation does not concern stay as they are.

Columns: id, kind, target, status, attempts, created_at, not_before, heartbeat_at, lease_token, force.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def enqueue(jobs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows to add: wanted (kind, target, force) without a pending job, once each, force if any asked for it."""
    asked = wanted.groupBy("kind", "target").agg(F.bool_or("force").alias("force"))
    return asked.join(jobs.where("status = 'pending'").select("kind", "target").distinct(), ["kind", "target"], "left_anti")


def merge_force(jobs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Pending jobs whose force flag a request raises."""
    asked = wanted.groupBy("kind", "target").agg(F.bool_or("force").alias("_force"))
    hit = (F.col("status") == "pending") & F.coalesce("_force", F.lit(False))
    return jobs.join(asked, ["kind", "target"], "left").withColumn("force", F.coalesce("force", F.lit(False)) | hit).drop("_force")


def claimable(jobs: DataFrame, kind: str, now: Column) -> DataFrame:
    """The oldest ready pending job of a kind."""
    ready = (F.col("status") == "pending") & (F.col("kind") == kind) & (F.col("not_before").isNull() | (F.col("not_before") <= now))
    return jobs.where(ready).orderBy("created_at", "id").limit(1)


def claim(jobs: DataFrame, chosen: DataFrame, token: str, now: Column) -> DataFrame:
    """Move the chosen rows from pending to claimed under a lease; others, and rows no longer pending, are unchanged."""
    mark = chosen.select(F.col("id").alias("_id"))
    hit = F.col("_id").isNotNull() & (F.col("status") == "pending")
    joined = jobs.join(mark, F.col("id") == F.col("_id"), "left")
    # every new value is computed from the old row
    return joined.withColumns({"status": F.when(hit, "claimed").otherwise(F.col("status")), "lease_token": F.when(hit, F.lit(token)).otherwise(F.col("lease_token")), "heartbeat_at": F.when(hit, now).otherwise(F.col("heartbeat_at")), "attempts": F.when(hit, F.col("attempts") + 1).otherwise(F.col("attempts"))}).drop("_id")


def reap(jobs: DataFrame, cutoff: Column, attempts_most: int) -> DataFrame:
    """Jobs whose holder fell silent: back to pending, or failed once their attempts are used up."""
    stale = F.col("status").isin("claimed", "running") & (F.col("heartbeat_at") < cutoff)
    after = F.when(F.col("attempts") >= attempts_most, "failed").otherwise("pending")
    return jobs.withColumns({"status": F.when(stale, after).otherwise(F.col("status")), "lease_token": F.when(stale, F.lit(None).cast("string")).otherwise(F.col("lease_token"))})


def transition(jobs: DataFrame, updates: DataFrame) -> DataFrame:
    """Apply (id, lease_token, status) updates whose lease still holds the row; late writers change nothing."""
    u = updates.select(F.col("id").alias("_id"), F.col("lease_token").alias("_token"), F.col("status").alias("_status"))
    hit = F.col("_token").isNotNull() & F.col("lease_token").eqNullSafe(F.col("_token")) & F.col("status").isin("claimed", "running")
    ended = F.col("_status").isin("done", "failed", "canceled", "pending")
    return jobs.join(u, F.col("id") == F.col("_id"), "left").withColumns({"status": F.when(hit, F.col("_status")).otherwise(F.col("status")), "lease_token": F.when(hit & ended, F.lit(None).cast("string")).otherwise(F.col("lease_token"))}).drop("_id", "_token", "_status")


def fair_claims(chunks: DataFrame, schedules: DataFrame, tokens_per_repo: int, limit: int) -> DataFrame:
    """Chunks to claim next: schedules served longest ago first, at most ``tokens_per_repo`` running or claimed per repository.

    ``chunks``: schedule_id, repo, priority, offset, attempt, status. ``schedules``: schedule_id, last_claimed.
    """
    busy = chunks.where("status IN ('claimed', 'running')").groupBy("repo").agg(F.count("*").alias("busy"))
    waiting = chunks.where("status = 'pending'").join(schedules, "schedule_id").join(busy, "repo", "left").withColumn("busy", F.coalesce("busy", F.lit(0)))
    order = [F.asc_nulls_first("last_claimed"), F.asc("schedule_id"), F.desc("priority"), F.asc("offset"), F.asc("attempt")]
    placed = waiting.withColumn("_n", F.row_number().over(Window.partitionBy("repo").orderBy(*order)))
    # the plain bound on the rank lets each task drop what can never be served before the shuffle
    return placed.where(F.col("_n") <= tokens_per_repo).where(F.col("_n") + F.col("busy") <= tokens_per_repo).orderBy(*order).limit(limit).drop("_n", "busy")


def chunked(schedules: DataFrame, total: str, size: int) -> DataFrame:
    """Chunks [offset, offset + length) of each schedule's range."""
    spread = schedules.where(F.col(total) > 0).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col(total).cast("long") - 1, F.lit(size).cast("long"))).alias("offset"))
    return spread.withColumn("length", F.least(F.lit(size).cast("long"), F.col(total) - F.col("offset")))


def retried(chunks: DataFrame, attempts_most: int) -> DataFrame:
    """Failed chunks: a successor attempt with priority 1, or final failure; both as rows, the old ones marked."""
    failed = chunks.where("status = 'failing'")
    again = failed.where(F.col("attempt") < attempts_most)
    old = chunks.withColumn("status", F.when((F.col("status") == "failing") & (F.col("attempt") < attempts_most), "superseded").when(F.col("status") == "failing", "failed").otherwise(F.col("status")))
    return old.unionByName(again.withColumns({"attempt": F.col("attempt") + 1, "priority": F.lit(1), "status": F.lit("pending")}))


def drop_superseded(work: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """Work of the current generation only; the rest is canceled, never published."""
    c = current.select(F.col(key).alias("_k"), F.col("generation").alias("_g"))
    return work.join(c, F.col(key) == F.col("_k"), "left").withColumn("status", F.when(~F.col("generation").eqNullSafe(F.col("_g")), "canceled").otherwise(F.col("status"))).drop("_k", "_g")


def expected_pairs(adapters: list[str], leaves: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(leaf, adapter) pairs without an outcome yet."""
    grid = leaves.select("leaf", F.explode(F.array(*[F.lit(a) for a in adapters])).alias("adapter"))
    return grid.join(outcomes.select("leaf", "adapter").distinct(), ["leaf", "adapter"], "left_anti")


def sweepable(runs: DataFrame, pins: DataFrame, cutoff: Column, limit: int) -> DataFrame:
    """Superseded or aborted runs before the cutoff that nothing pins, oldest first, at most ``limit`` at a time."""
    dead = runs.where(F.col("status").isin("superseded", "aborted") & (F.col("started_at") <= cutoff))
    return dead.join(pins.select("run_id").distinct(), "run_id", "left_anti").orderBy("started_at", "run_id").limit(limit)


def prune(events: DataFrame, ts: str, cutoff: Column) -> DataFrame:
    """What time retention keeps (rows without a time are kept)."""
    return events.where(F.col(ts).isNull() | (F.col(ts) > cutoff))


def capacity_state(free_bytes: int, soft: int, hard: int, resume: int, blocked: bool) -> str:
    """Admission by free space: ``blocked`` below the hard mark and until the resume mark, ``soft`` below the soft one, else ``open``."""
    if not hard <= soft <= resume:
        raise ValueError("marks must rise from hard over soft to resume")
    if free_bytes < hard or (blocked and free_bytes < resume):
        return "blocked"
    return "soft" if free_bytes < soft else "open"
