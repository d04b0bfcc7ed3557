"""Change tracking: comparisons with closed classes, consumer deltas, the longitudinal ledger, lifecycle counters, review queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seine.functions.scalars import is_subset
from seine.vocab import COMPARISON_SAMPLES


def compare_callers(old: DataFrame, new: DataFrame, key: str, unresolved: Column, sample: str, samples: int = COMPARISON_SAMPLES) -> DataFrame:
    """Two caller sets by key: class, counts and the first samples of each side.

    The samples are ranked apart from the counts, so the ranking keeps no more than ``samples`` rows of a key and side before
    the shuffle, however hot the key.
    """
    rows = old.withColumn("_new", F.lit(False)).unionByName(new.withColumn("_new", F.lit(True)))
    is_new = F.col("_new")
    counts = rows.groupBy(key).agg(F.count_if(~is_new).alias("old_count"), F.count_if(is_new).alias("new_count"), F.bool_or(F.coalesce(unresolved, F.lit(False))).alias("_open"))
    ranked = rows.select(key, "_new", sample, F.row_number().over(Window.partitionBy(key, "_new").orderBy(sample)).alias("_n")).where(F.col("_n") <= samples)

    def first(side: Column) -> Column:
        return F.array_sort(F.collect_list(F.when(side, F.col(sample))))

    shown = ranked.groupBy(F.col(key).alias("_key")).agg(first(~is_new).alias("old_samples"), first(is_new).alias("new_samples"))
    kind = F.when(F.col("_open"), "unresolved").when((F.col("old_count") > 0) & (F.col("new_count") > 0), "both_evidence").when(F.col("old_count") > 0, "old_only_evidence").otherwise("new_only_evidence")
    return counts.join(shown, F.col(key).eqNullSafe(F.col("_key"))).withColumn("class", kind).drop("_open", "_key")


def caller_identities(rows: DataFrame, level: str) -> DataFrame:
    """Adds ``key`` and ``unresolved``, the identity under which a caller row is compared.

    ``rows``: repo, commit, path, start_line, end_line, predicate, unit_state, units (array of id, metadata). At level ``occurrence``
    the key is the place. At level ``unit`` it is the unit, for resolved rows with exactly one candidate; any other row, and a row
    whose candidate differs from the first one seen of that unit, is kept apart under its own unresolved place.
    """
    if level not in ("occurrence", "unit"):
        raise ValueError("level is occurrence or unit")
    place = F.concat(F.col("repo"), F.lit("@"), F.col("commit"), F.lit(":"), F.col("path"), F.lit(":"), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"))
    resolved = F.col("predicate") == "CALLS_OPERATION"
    placed = rows.withColumn("_place", place)
    if level == "occurrence":
        return placed.withColumn("key", F.concat(F.lit("occurrence|"), "_place")).withColumn("unresolved", ~resolved).drop("_place")
    one = resolved & (F.col("unit_state") == "resolved") & (F.size("units") == 1)
    # repository and unit are parted by a character that neither holds
    marked = placed.withColumn("_unit", F.when(one, F.concat(F.lit("unit|"), "repo", F.lit("\0"), F.col("units")[0]["id"]))).withColumn("_meta", F.when(one, F.col("units")[0]["metadata"]))
    first = marked.where("_unit IS NOT NULL").groupBy(F.col("_unit").alias("_u")).agg(F.min_by("_meta", "_place").alias("_first"))
    known = marked.join(first, F.col("_unit") == F.col("_u"), "left")
    held = F.coalesce(F.col("_unit").isNotNull() & F.col("_meta").eqNullSafe(F.col("_first")), F.lit(False))
    return known.withColumn("key", F.when(held, F.col("_unit")).otherwise(F.concat(F.lit("unresolved|"), "_place"))).withColumn("unresolved", ~held).drop("_place", "_unit", "_meta", "_u", "_first")


def compare_by_digest(before: DataFrame, after: DataFrame, digest: str) -> DataFrame:
    """(digest, change) over two generations: added, removed, unchanged."""
    b, a = before.select(F.col(digest).alias("bd")).distinct(), after.select(F.col(digest).alias("ad")).distinct()
    joined = b.join(a, F.col("bd") == F.col("ad"), "full_outer")
    return joined.select(F.coalesce("bd", "ad").alias(digest), F.when(F.col("bd").isNull(), "added").when(F.col("ad").isNull(), "removed").otherwise("unchanged").alias("change"))


# order of the causes for which two snapshots may not be compared
CAUSES = {
    "authorization": "authorization_changed", "schema": "schema_or_identity_changed", "pack": "pack_or_rule_changed", "enumeration": "enumeration_changed",
    "build": "build_configuration_changed", "external": "external_metadata_changed",
}


def noncomparability(before: str, after: str, failed: Column, stale: Column) -> Column:
    """Causes in alphabetical order, from two structs of digests (keys of ``CAUSES``) and ``universe`` lists. Empty means comparable."""
    b, a = F.col(before), F.col(after)
    causes = [F.when(~b[k].eqNullSafe(a[k]), F.lit(v)) for k, v in CAUSES.items()]
    grown, shrunk = is_subset(b["universe"], a["universe"]), is_subset(a["universe"], b["universe"])
    causes.append(F.when(grown & shrunk, None).when(grown, "scope_expanded").when(shrunk, "scope_narrowed").otherwise("unknown_cause"))
    causes += [F.when(failed, F.lit("analysis_failed")), F.when(stale, F.lit("input_stale"))]
    return F.array_sort(F.array_compact(F.array(*causes)))


def consumer_delta(before: DataFrame, after: DataFrame, key: str, comparable: Column | bool = True) -> DataFrame:
    """added and removed keys; nothing at all if the snapshots may not be compared."""
    gate = F.lit(comparable) if isinstance(comparable, bool) else comparable
    b, a = before.select(key).distinct(), after.select(key).distinct()
    return a.join(b, key, "left_anti").select(key, F.lit("added").alias("change")).unionByName(b.join(a, key, "left_anti").select(key, F.lit("removed").alias("change"))).where(gate)


#: Snapshots that are ordered together; sequences are whole numbers.
SNAPSHOT_BLOCK = 4_096


def ledger(observations: DataFrame, relationship: str, sequence: str, snapshots: DataFrame) -> DataFrame:
    """Per relationship: first and last seen, observations, active, last removed, times it came back.

    ``snapshots`` (sequence, comparable): only a comparable snapshot without the relationship removes it.
    """
    seen = observations.select(relationship, sequence).distinct()
    per_snapshot = snapshots.select(sequence, "comparable").distinct()
    order = Window.partitionBy(relationship).orderBy(sequence)
    following = seen.withColumn("next", F.lead(sequence).over(order))
    # the first comparable snapshot after each, in blocks of snapshots: within the block, else the first of a later block
    block = F.floor(F.col(sequence) / SNAPSHOT_BLOCK).alias("_block")
    marked = per_snapshot.groupBy(sequence).agg(F.bool_or("comparable").alias("ok")).select(sequence, block, F.when(F.col("ok"), F.col(sequence)).alias("_ok"))
    firsts = marked.groupBy("_block").agg(F.min("_ok").alias("_first"))
    later = Window.orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)  # over one row per block
    beyond = firsts.select("_block", F.min("_first").over(later).alias("_beyond"))
    upcoming = Window.partitionBy("_block").orderBy(F.desc(sequence)).rowsBetween(Window.unboundedPreceding, -1)
    nexts = marked.select(sequence, "_block", F.min("_ok").over(upcoming).alias("_within")).join(beyond, "_block").select(sequence, F.coalesce("_within", "_beyond").alias("removal"))
    spans = following.join(nexts, sequence, "left")
    removed = F.col("removal").isNotNull() & (F.col("next").isNull() | (F.col("removal") < F.col("next")))
    out = spans.groupBy(relationship).agg(
        F.min(sequence).alias("first_seen"), F.max(sequence).alias("last_seen"), F.count("*").alias("observation_count"),
        F.max(F.when(removed, F.col("removal"))).alias("last_removed"), F.count_if(removed & F.col("next").isNotNull()).alias("reintroduced"),
    )
    active = F.col("last_removed").isNull() | (F.col("last_removed") <= F.col("last_seen"))
    return out.select(relationship, "first_seen", "last_seen", "observation_count", "last_removed", "reintroduced", active.alias("active"))


def incarnations(history: DataFrame, key: list[str], sequence: str, removed: str) -> DataFrame:
    """Adds ``control_revision`` (transitions so far) and ``incarnation`` (one more each time a removed key is present again)."""
    order = Window.partitionBy(*key).orderBy(sequence)
    back = F.coalesce(F.lag(removed).over(order), F.lit(False)) & ~F.col(removed)
    return history.withColumn("control_revision", F.row_number().over(order)).withColumn("_back", back.cast("int")).withColumn("incarnation", 1 + F.sum("_back").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_back")


def service_status(disposition: Column, active: Column, desired: Column) -> Column:
    """Status of a lifecycle row from its disposition and whether the active generation is the desired one."""
    accepted = F.when(active.isNull(), "unavailable").when(active.eqNullSafe(desired), "current").otherwise("stale")
    return F.when(disposition == "rejected", "removed").when(disposition == "conflict", "conflict").when(disposition == "proposal", "unavailable").otherwise(accepted)


def plan_transition(catalog: DataFrame, prior: DataFrame, key: list[str]) -> DataFrame:
    """Catalog against prior rows: created, kept, or implicitly removed, and the change in tombstones."""
    c = catalog.select(*key, F.col("disposition").alias("want")).distinct()
    p = prior.select(*key, F.col("removed").alias("was_removed"))
    rows = c.join(p, key, "full_outer")
    now_removed = F.col("want").isNull() | (F.col("want") == "rejected")
    action = F.when(F.col("want").isNull() & F.col("was_removed"), "unchanged").when(F.col("want").isNull(), "implicit_removal").when(F.col("was_removed").isNull(), "create").when(F.col("was_removed") & ~now_removed, "reintroduce").otherwise("update")
    delta = now_removed.cast("int") - F.coalesce("was_removed", F.lit(False)).cast("int")
    return rows.select(*key, action.alias("action"), now_removed.alias("removed"), delta.alias("tombstone_delta"))


def review_queue(sources: dict[str, DataFrame], identity: list[str]) -> DataFrame:
    """Items of several queues, each once per queue and identity."""
    out = None
    for queue, rows in sources.items():
        tagged = rows.select(F.lit(queue).alias("queue"), *identity)
        out = tagged if out is None else out.unionByName(tagged)
    return out.distinct()


def checklist(suggestions: DataFrame, history: DataFrame, key: str) -> DataFrame:
    """Suggestions with their latest disposition; dispositions without a suggestion are stale. Current ones first."""
    latest = history.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("sequence")))).where("_n = 1").drop("_n")
    rows = suggestions.select(key, F.lit(True).alias("_now")).distinct().join(latest.select(key, "disposition"), key, "full_outer")
    return rows.select(key, F.when(F.col("_now"), "current").otherwise("stale").alias("state"), F.coalesce("disposition", F.lit("open")).alias("disposition"))


def broken_chains(history: DataFrame, key: str) -> DataFrame:
    """Keys whose dispositions are not numbered 1..n or do not supersede their predecessor."""
    order = Window.partitionBy(key).orderBy("sequence")
    wrong = (F.row_number().over(order) != F.col("sequence")) | ~F.lag("id").over(order).eqNullSafe(F.col("supersedes"))
    return history.select(key, wrong.alias("wrong")).where("wrong").select(key).distinct()
