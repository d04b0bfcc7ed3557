"""Comparison, ledger and lifecycle queries. Findings of g34 are the consumers, waves of sites the snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from seine.operators import change as C
from seine.registry import Registry
from seine.runtime import table

R = Registry()


def _year(spark, sf_dir, year):
    o = table(spark, sf_dir, "orders")
    return o.where(F.year("o_orderdate") == year).select("o_custkey", "o_orderkey", "o_orderpriority")


@R.query(
    "caller_comparison",
    sql="""WITH o AS (SELECT o_custkey, o_orderkey, o_orderpriority, year(o_orderdate) AS y FROM orders WHERE year(o_orderdate) IN (1996, 1997))
    SELECT o_custkey, count_if(y = 1996)::BIGINT AS old_count, count_if(y = 1997)::BIGINT AS new_count,
      CASE WHEN bool_or(o_orderpriority = '4-NOT SPECIFIED') THEN 'unresolved' WHEN count_if(y = 1996) > 0 AND count_if(y = 1997) > 0 THEN 'both_evidence' WHEN count_if(y = 1996) > 0 THEN 'old_only_evidence' ELSE 'new_only_evidence' END AS class,
      coalesce(array_to_string(list_sort(list(o_orderkey) FILTER (y = 1996))[1:4], ','), '') AS old_samples
    FROM o GROUP BY o_custkey""",
)
def caller_comparison(spark, sf_dir):
    rows = C.compare_callers(_year(spark, sf_dir, 1996), _year(spark, sf_dir, 1997), "o_custkey", F.col("o_orderpriority") == "4-NOT SPECIFIED", "o_orderkey")
    return rows.select("o_custkey", "old_count", "new_count", "class", F.array_join(F.transform("old_samples", lambda x: x.cast("string")), ",").alias("old_samples"))


@R.query(
    "relationship_diff",
    sql="""WITH b AS (SELECT DISTINCT sha256(predicate || '|' || object) AS d FROM g34 WHERE observed_at < '2025-09-01'::TIMESTAMPTZ AND object IS NOT NULL), a AS (SELECT DISTINCT sha256(predicate || '|' || object) AS d FROM g34 WHERE observed_at >= '2025-09-01'::TIMESTAMPTZ AND object IS NOT NULL)
    SELECT coalesce(b.d, a.d) AS digest, CASE WHEN b.d IS NULL THEN 'added' WHEN a.d IS NULL THEN 'removed' ELSE 'unchanged' END AS change FROM b FULL JOIN a ON b.d = a.d""",
)
def relationship_diff(spark, sf_dir):
    g = table(spark, sf_dir, "g34").where("object IS NOT NULL").select("observed_at", F.sha2(F.concat("predicate", F.lit("|"), "object"), 256).alias("digest"))
    cut = F.lit("2025-09-01 00:00:00").cast("timestamp")
    return C.compare_by_digest(g.where(F.col("observed_at") < cut), g.where(F.col("observed_at") >= cut), "digest")


_DELTA_SQL = """WITH b AS (SELECT DISTINCT object FROM g34 WHERE gate = 3 AND split = 'train' AND object IS NOT NULL), a AS (SELECT DISTINCT object FROM g34 WHERE gate = 3 AND split = 'dev' AND object IS NOT NULL)
    (SELECT object, 'added' AS change FROM a WHERE object NOT IN (SELECT object FROM b)) UNION ALL (SELECT object, 'removed' FROM b WHERE object NOT IN (SELECT object FROM a))"""


def _gate3(spark, sf_dir, split):
    return table(spark, sf_dir, "g34").where((F.col("gate") == 3) & (F.col("split") == split) & F.col("object").isNotNull())


@R.query("consumer_delta", sql=_DELTA_SQL)
def consumer_delta(spark, sf_dir):
    return C.consumer_delta(_gate3(spark, sf_dir, "train"), _gate3(spark, sf_dir, "dev"), "object")


@R.query("consumer_delta_not_comparable", sql=f"SELECT * FROM ({_DELTA_SQL}) WHERE false")
def consumer_delta_not_comparable(spark, sf_dir):
    return C.consumer_delta(_gate3(spark, sf_dir, "train"), _gate3(spark, sf_dir, "dev"), "object", comparable=False)


@R.query(
    "consumer_ledger",
    sql="""WITH obs AS (SELECT DISTINCT object AS rel, year(observed_at AT TIME ZONE 'UTC') * 12 + month(observed_at AT TIME ZONE 'UTC') AS seq FROM g34 WHERE object IS NOT NULL AND observed_at IS NOT NULL),
    snaps AS (SELECT DISTINCT seq, seq % 5 <> 0 AS comparable FROM obs), nx AS (SELECT rel, seq, lead(seq) OVER (PARTITION BY rel ORDER BY seq) AS nxt FROM obs),
    rem AS (SELECT nx.*, (SELECT min(s.seq) FROM snaps s WHERE s.comparable AND s.seq > nx.seq) AS removal FROM nx),
    f AS (SELECT *, removal IS NOT NULL AND (nxt IS NULL OR removal < nxt) AS removed FROM rem)
    SELECT rel AS object, min(seq)::INTEGER AS first_seen, max(seq)::INTEGER AS last_seen, count(*) AS observation_count, max(removal) FILTER (removed)::INTEGER AS last_removed, count_if(removed AND nxt IS NOT NULL)::BIGINT AS reintroduced,
      (max(removal) FILTER (removed) IS NULL OR max(removal) FILTER (removed) <= max(seq)) AS active FROM f GROUP BY rel""",
)
def consumer_ledger(spark, sf_dir):
    g = table(spark, sf_dir, "g34").where("object IS NOT NULL AND observed_at IS NOT NULL")
    seen = g.select("object", (F.year("observed_at") * 12 + F.month("observed_at")).alias("seq"))
    return C.ledger(seen, "object", "seq", seen.select("seq", (F.col("seq") % 5 != 0).alias("comparable")))


@R.query(
    "incarnations",
    sql="""WITH h AS (SELECT DISTINCT site_id, registered_at AS ts, false AS removed FROM sites UNION SELECT DISTINCT site_id, deleted_at, true FROM sites WHERE deleted_at IS NOT NULL),
    m AS (SELECT *, row_number() OVER w AS control_revision, coalesce(lag(removed) OVER w, false) AND NOT removed AS back FROM h WINDOW w AS (PARTITION BY site_id ORDER BY ts))
    SELECT site_id, max(control_revision)::INTEGER AS revisions, (1 + count_if(back))::BIGINT AS incarnation FROM m GROUP BY site_id""",
)
def incarnations(spark, sf_dir):
    s = table(spark, sf_dir, "sites")
    history = s.select("site_id", F.col("registered_at").alias("at"), F.lit(False).alias("removed")).unionByName(s.where("deleted_at IS NOT NULL").select("site_id", F.col("deleted_at").alias("at"), F.lit(True).alias("removed"))).distinct()
    rows = C.incarnations(history, ["site_id"], "at", "removed")
    return rows.groupBy("site_id").agg(F.max("control_revision").alias("revisions"), F.max("incarnation").alias("incarnation"))


_STATES_SQL = "SELECT system, count(*) AS n FROM sites GROUP BY system"


@R.query(
    "service_state_summary",
    sql="""WITH st AS (SELECT repo, CASE WHEN status = 'aborted' THEN 'removed' WHEN status = 'superseded' THEN 'conflict' WHEN status = 'staged' THEN 'unavailable' WHEN published_at IS NULL THEN 'unavailable' WHEN unit_digest IS NOT DISTINCT FROM "commit" THEN 'current' ELSE 'stale' END AS status FROM runs)
    SELECT repo, count_if(status = 'current')::BIGINT AS current, count_if(status = 'stale')::BIGINT AS stale, count_if(status = 'unavailable')::BIGINT AS unavailable, count_if(status = 'conflict')::BIGINT AS conflict, count_if(status = 'removed')::BIGINT AS removed,
      count_if(status <> 'removed')::BIGINT AS live, count(*) AS total FROM st GROUP BY repo""",
)
def service_state_summary(spark, sf_dir):
    from seine.operators.services import status_summary

    disposition = F.when(F.col("status") == "aborted", "rejected").when(F.col("status") == "superseded", "conflict").when(F.col("status") == "staged", "proposal").otherwise("accepted")
    active = F.when(F.col("published_at").isNotNull(), F.coalesce("unit_digest", F.lit("none")))
    states = table(spark, sf_dir, "runs").select("repo", C.service_status(disposition, active, F.col("commit")).alias("status"))
    return status_summary(states, ["repo"])


@R.query(
    "service_transition_plan",
    sql="""WITH c AS (SELECT DISTINCT site_id, CASE WHEN wave % 7 = 0 THEN 'rejected' ELSE 'accepted' END AS want FROM sites WHERE wave >= 12), one AS (SELECT site_id, min(want) AS want FROM c GROUP BY site_id),
    p AS (SELECT site_id, bool_and(deleted_at IS NOT NULL) AS was FROM sites WHERE wave < 14 GROUP BY site_id)
    SELECT coalesce(one.site_id, p.site_id) AS site_id, CASE WHEN want IS NULL AND was THEN 'unchanged' WHEN want IS NULL THEN 'implicit_removal' WHEN was IS NULL THEN 'create' WHEN was AND want <> 'rejected' THEN 'reintroduce' ELSE 'update' END AS action,
      (want IS NULL OR want = 'rejected') AS removed, ((want IS NULL OR want = 'rejected')::INTEGER - coalesce(was, false)::INTEGER) AS tombstone_delta FROM one FULL JOIN p ON one.site_id = p.site_id""",
)
def service_transition_plan(spark, sf_dir):
    s = table(spark, sf_dir, "sites")
    catalog = s.where("wave >= 12").groupBy("site_id").agg(F.min(F.when(F.col("wave") % 7 == 0, "rejected").otherwise("accepted")).alias("disposition"))
    prior = s.where("wave < 14").groupBy("site_id").agg(F.bool_and(F.col("deleted_at").isNotNull()).alias("removed"))
    return C.plan_transition(catalog, prior, ["site_id"])


@R.query(
    "review_queue",
    sql="""SELECT DISTINCT 'new_consumers' AS queue, system, object FROM g34 WHERE split = 'dev' UNION SELECT DISTINCT 'coverage_regression', system, object FROM g34 WHERE tier = 'derived' AND detail IS NULL
    UNION SELECT DISTINCT 'unresolved_attribution', system, object FROM g34 WHERE path IS NULL""",
)
def review_queue(spark, sf_dir):
    g = table(spark, sf_dir, "g34")
    return C.review_queue({"new_consumers": g.where("split = 'dev'"), "coverage_regression": g.where("tier = 'derived' AND detail IS NULL"), "unresolved_attribution": g.where("path IS NULL")}, ["system", "object"])


_HISTORY_SQL = "h AS (SELECT trim(site_id) AS site_id, row_id AS id, verdict AS disposition, row_number() OVER (PARTITION BY trim(site_id) ORDER BY row_id) AS sequence FROM g3h2 WHERE trim(coalesce(site_id, '')) <> '' AND verdict IS NOT NULL)"


def _labels(spark, sf_dir):
    from pyspark.sql import Window

    g = table(spark, sf_dir, "g3h2").where("trim(coalesce(site_id, '')) <> '' AND verdict IS NOT NULL").select(F.trim("site_id").alias("site_id"), F.col("row_id").alias("id"), F.col("verdict").alias("disposition"))
    order = Window.partitionBy("site_id").orderBy("id")
    return g.withColumn("sequence", F.row_number().over(order)).withColumn("supersedes", F.lag("id").over(order))


@R.query(
    "workbench_checklist",
    sql=f"""WITH {_HISTORY_SQL}, latest AS (SELECT site_id, disposition FROM h QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY sequence DESC) = 1), s AS (SELECT DISTINCT site_id FROM g34 WHERE site_id IS NOT NULL)
    SELECT coalesce(s.site_id, l.site_id) AS site_id, CASE WHEN s.site_id IS NOT NULL THEN 'current' ELSE 'stale' END AS state, coalesce(l.disposition, 'open') AS disposition FROM s FULL JOIN latest l ON s.site_id = l.site_id""",
)
def workbench_checklist(spark, sf_dir):
    return C.checklist(table(spark, sf_dir, "g34").where("site_id IS NOT NULL"), _labels(spark, sf_dir), "site_id")


@R.query("disposition_chain_check", sql="SELECT o_custkey::VARCHAR AS site_id FROM orders GROUP BY o_custkey HAVING count(*) > 1")
def disposition_chain_check(spark, sf_dir):
    """Every customer with two or more orders breaks the chain, as no order names its predecessor."""
    from pyspark.sql import Window

    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("site_id"), F.col("o_orderkey").alias("id"), F.lit(None).cast("long").alias("supersedes"))
    return C.broken_chains(o.withColumn("sequence", F.row_number().over(Window.partitionBy("site_id").orderBy("id"))), "site_id")


@R.query(
    "noncomparability_causes",
    sql="""WITH r AS (SELECT repo, min(status) AS s1, max(status) AS s2, list_sort(list_distinct(list(domain) FILTER (started_at < '2025-10-01'::TIMESTAMPTZ))) AS u1, list_sort(list_distinct(list(domain) FILTER (started_at >= '2025-10-01'::TIMESTAMPTZ))) AS u2 FROM runs GROUP BY repo)
    SELECT repo, array_to_string(list_sort(list_filter([CASE WHEN s1 <> s2 THEN 'pack_or_rule_changed' END,
      CASE WHEN len(list_filter(coalesce(u1, []), lambda x: NOT list_contains(coalesce(u2, []), x))) = 0 THEN CASE WHEN len(list_filter(coalesce(u2, []), lambda x: NOT list_contains(coalesce(u1, []), x))) = 0 THEN NULL ELSE 'scope_expanded' END
           WHEN len(list_filter(coalesce(u2, []), lambda x: NOT list_contains(coalesce(u1, []), x))) = 0 THEN 'scope_narrowed' ELSE 'unknown_cause' END], lambda x: x IS NOT NULL)), ',') AS causes FROM r""",
)
def noncomparability_causes(spark, sf_dir):
    cut = F.lit("2025-10-01 00:00:00").cast("timestamp")
    r = table(spark, sf_dir, "runs").groupBy("repo").agg(F.min("status").alias("s1"), F.max("status").alias("s2"), F.collect_set(F.when(F.col("started_at") < cut, F.col("domain"))).alias("u1"), F.collect_set(F.when(F.col("started_at") >= cut, F.col("domain"))).alias("u2"))

    def side(s: str, u: str):
        return F.struct(F.lit("a").alias("authorization"), F.lit("s").alias("schema"), F.col(s).alias("pack"), F.lit("e").alias("enumeration"), F.lit("b").alias("build"), F.lit("x").alias("external"), F.col(u).alias("universe"))

    rows = r.select("repo", side("s1", "u1").alias("before"), side("s2", "u2").alias("after"))
    return rows.select("repo", F.array_join(C.noncomparability("before", "after", F.lit(False), F.lit(False)), ",").alias("causes"))
