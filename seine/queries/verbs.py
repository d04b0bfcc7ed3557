"""Queries through the public verbs: ``results`` are the assertions of their runs, ``events`` the usage and audit logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seine.plans.api import Snapshot
from seine.queries.search import files, published_index
from seine.registry import Registry
from seine.runtime import table

R = Registry()


def snapshot(spark: SparkSession, sf_dir: str, identity: str | None = None) -> Snapshot:
    results, runs, repos, events, g34 = (table(spark, sf_dir, n) for n in ("results", "runs", "repos", "events", "g34"))
    deliveries = results.where("run_id IS NOT NULL AND domain IS NOT NULL").select("result_id", "run_id", "repo", "domain", "outcome", "serial_ordinal").distinct()
    operation = F.concat(F.lit("/svc/m"), F.pmod(F.col("serial_ordinal"), F.lit(20)).cast("string"))
    assertions = deliveries.select(
        F.col("result_id").alias("assertion_id"), "run_id", "repo", "domain", F.when(F.col("outcome") == "succeeded", "CALLS_OPERATION").otherwise("UNRESOLVED_CALLER").alias("predicate"),
        F.concat(F.lit("s"), F.pmod(F.col("result_id"), F.lit(7)).cast("string")).alias("subject"), operation.alias("object"), F.col("repo").alias("lineage"),
        F.when(F.col("outcome") == "succeeded", "exact").otherwise("unresolved").alias("tier"), F.array(F.col("serial_ordinal").cast("string")).alias("supporting"),
    )
    occurrences = deliveries.select("run_id", F.col("serial_ordinal").cast("string").alias("atom_id"), F.concat(F.lit("p/"), F.pmod(F.col("serial_ordinal"), F.lit(5)).cast("string")).alias("path"), F.lit(1).alias("start_line"), F.lit(2).alias("end_line")).distinct()
    places = g34.where("path IS NOT NULL AND line IS NOT NULL AND object IS NOT NULL").select(
        F.lit("r").alias("repo"), F.lit("c").alias("commit"), "path", F.col("line").alias("start_line"), F.lit(0).alias("start_col"), F.col("line").alias("end_line"), F.lit(9).alias("end_col"), F.col("object").alias("symbol"),
        F.when(F.col("split") == "train", 1).otherwise(8).alias("roles"), F.lit(None).cast("string").alias("override_documentation"),
    )
    return Snapshot(
        {
            "repos": repos, "runs": runs, "assertions": assertions, "occurrences": occurrences, "files": files(spark, sf_dir), "permissions": repos.where("is_public").select(F.col("name").alias("repo"), F.lit("host:ann").alias("identity")),
            "usage": events.select("ts", "event_type", F.col("user_id").alias("duration_ms")), "audit": events.select("event_id", F.col("ts").alias("created_at"), "event_type"), "pins": results.where("facts > 100").select("run_id"),
            "symbol_occurrences": places, "symbol_relationships": spark.createDataFrame([], "symbol string, related string, is_definition boolean, is_reference boolean"),
            "jobs": runs.select("repo", F.col("run_id").alias("job_id"), "status", F.col("started_at").alias("created_at")),
        },
        identity, index=published_index(spark, sf_dir),
    )


_ASSERTIONS_SQL = """
assertions AS (SELECT DISTINCT result_id AS assertion_id, run_id, repo, domain, CASE WHEN outcome = 'succeeded' THEN 'CALLS_OPERATION' ELSE 'UNRESOLVED_CALLER' END AS predicate, 's' || result_id % 7 AS subject,
  '/svc/m' || serial_ordinal % 20 AS object, serial_ordinal % 5 AS place FROM results WHERE run_id IS NOT NULL AND domain IS NOT NULL AND run_id IN (SELECT run_id FROM runs WHERE status = 'published')),
seen AS (SELECT * FROM assertions WHERE repo IN (SELECT name FROM repos WHERE is_public) AND run_id IN (SELECT run_id FROM runs WHERE repo IN (SELECT name FROM repos WHERE is_public)))
"""


@R.query("verb_search", sql="""SELECT doc_id, (len(regexp_extract_all(coalesce(text, ''), '(?i)beacon')) + regexp_matches(coalesce(path, ''), '(?i)beacon')::INT)::BIGINT AS score FROM documents
    WHERE repo IN (SELECT name FROM repos WHERE is_public) AND (regexp_matches(coalesce(text, ''), '(?i)beacon') OR regexp_matches(coalesce(path, ''), '(?i)beacon')) ORDER BY score DESC, repo, path, lang, doc_id LIMIT 500""")  # fmt: skip
def verb_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search of one identity, through the index."""
    return snapshot(spark, sf_dir, "host:ann").search("beacon", 500).select("doc_id", "score")


@R.query("verb_evidence_page", sql=f"WITH {_ASSERTIONS_SQL} SELECT predicate, subject, object, assertion_id, true AS has_more FROM assertions WHERE predicate = 'UNRESOLVED_CALLER' ORDER BY predicate, subject, object, assertion_id, run_id LIMIT 20")
def verb_evidence_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot(spark, sf_dir).evidence_page(20, predicate="UNRESOLVED_CALLER").select("predicate", "subject", "object", "assertion_id", "has_more")


@R.query("verb_operation_consumers", sql=f"WITH {_ASSERTIONS_SQL} SELECT DISTINCT assertion_id, domain, 'p/' || place AS path FROM seen WHERE domain IN ('grpc-consumer', 'grpc-caller', 'thrift-consumer', 'thrift-caller') AND object = '/svc/m3'")
def verb_operation_consumers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consumers of one operation, of what the identity may see."""
    return snapshot(spark, sf_dir, "host:ann").find_operation_consumers("/svc/m3").select("assertion_id", "domain", "path")


@R.query(
    "verb_compare_callers",
    sql=f"""WITH {_ASSERTIONS_SQL}, c AS (SELECT a.*, r.commit FROM assertions a JOIN runs r USING (run_id) WHERE a.domain IN ('grpc-consumer', 'grpc-caller', 'thrift-consumer', 'thrift-caller')),
    k AS (SELECT 'occurrence|' || repo || '@' || commit || ':p/' || place || ':1-2' AS key, count_if(object = '/svc/m1') AS old_count, count_if(object = '/svc/m6') AS new_count, bool_or(predicate <> 'CALLS_OPERATION') AS open
          FROM c WHERE object IN ('/svc/m1', '/svc/m6') GROUP BY ALL)
    SELECT key, old_count, new_count, CASE WHEN open THEN 'unresolved' WHEN old_count > 0 AND new_count > 0 THEN 'both_evidence' WHEN old_count > 0 THEN 'old_only_evidence' ELSE 'new_only_evidence' END AS class FROM k""",
)
def verb_compare_callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot(spark, sf_dir).compare_callers("/svc/m1", "/svc/m6").select("key", "old_count", "new_count", "class")


@R.query(
    "verb_references",
    sql="""WITH p AS (SELECT path, line FROM g34 WHERE path IS NOT NULL AND line IS NOT NULL AND object = (SELECT min(object) FROM g34 WHERE path IS NOT NULL AND line IS NOT NULL AND split = 'train'))
    SELECT DISTINCT path, line AS start_line, false AS truncated FROM p""",
)
def verb_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References to the symbol at the first place of the first object that is defined there."""
    s = snapshot(spark, sf_dir)
    places = s.table("symbol_occurrences")
    symbol = places.where("roles = 1").agg(F.min("symbol").alias("symbol"))
    at = places.join(F.broadcast(symbol), "symbol", "left_semi").orderBy("path", "start_line").first()
    from seine.operators.codenav import find_references

    only = places.join(F.broadcast(symbol), "symbol", "left_semi").select("symbol").distinct()
    found = s.find_references("r", "c", at["path"], at["start_line"], 3)
    # a place may hold several symbols; those of the asked one are compared
    return found.join(find_references(only, places, s.tables["symbol_relationships"]).select("path", "start_line"), ["path", "start_line"], "left_semi").select("path", "start_line", "truncated")


@R.query("verb_usage_daily", sql="WITH d AS (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-03-31', INTERVAL 1 DAY))::DATE AS day) SELECT strftime(d.day, '%Y-%m-%d') AS day, count(e.event_id) AS n FROM d LEFT JOIN events e ON e.ts::DATE = d.day GROUP BY d.day")
def verb_usage_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot(spark, sf_dir).usage("2024-01-01", "2024-03-31", name="event_type")["daily"]


@R.query("verb_audit_page", sql="SELECT event_id, event_type, true AS has_more FROM events ORDER BY ts DESC, event_id LIMIT 25")
def verb_audit_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot(spark, sf_dir).audit(25).select("event_id", "event_type", "has_more")


@R.query(
    "verb_retention_status",
    sql="""WITH r AS (SELECT *, status IN ('superseded', 'aborted') AND started_at <= TIMESTAMPTZ '2025-09-01 00:00:00+00' - INTERVAL 30 DAY AS dead, run_id IN (SELECT run_id FROM results WHERE facts > 100 AND run_id IS NOT NULL) AS pinned FROM runs)
    SELECT status, count(*) AS runs, count_if(coalesce(dead, false)) AS expired, count_if(coalesce(dead, false) AND pinned) AS pinned FROM r GROUP BY status""",
)
def verb_retention_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot(spark, sf_dir).retention_status("2025-09-01 00:00:00", 30).drop("oldest")


@R.query(
    "verb_lifecycle_status",
    sql="""WITH t AS (SELECT repo, run_id, status, row_number() OVER (PARTITION BY repo ORDER BY started_at DESC, run_id) AS n FROM runs WHERE started_at IS NOT NULL),
    p AS (SELECT repo, run_id, started_at, row_number() OVER (PARTITION BY repo ORDER BY published_at DESC, run_id) AS n FROM runs WHERE status = 'published' AND published_at IS NOT NULL),
    f AS (SELECT r.repo, count(*) AS n FROM runs r LEFT JOIN p ON p.repo = r.repo AND p.n = 1 WHERE r.status = 'aborted' AND (p.started_at IS NULL OR r.started_at > p.started_at) GROUP BY r.repo)
    SELECT x.name AS repo, t.run_id AS attempt_run, t.status AS attempt_status, p.run_id AS published_run, coalesce(f.n, 0)::BIGINT AS failed_since
    FROM repos x LEFT JOIN t ON t.repo = x.name AND t.n = 1 LEFT JOIN p ON p.repo = x.name AND p.n = 1 LEFT JOIN f ON f.repo = x.name""",
)
def verb_lifecycle_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot(spark, sf_dir).lifecycle_status()


@R.query("verb_repo_status", sql="""WITH j AS (SELECT repo, run_id, status, row_number() OVER (PARTITION BY repo ORDER BY started_at DESC NULLS LAST, run_id) AS n FROM runs)
    SELECT name, j.run_id AS last_job, j.status AS job_status FROM repos LEFT JOIN j ON j.repo = name AND j.n = 1""")  # fmt: skip
def verb_repo_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot(spark, sf_dir).repo_status().select("name", "last_job", "job_status")
