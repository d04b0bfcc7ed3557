"""Evidence, coverage, paging and dashboard queries.

``runs`` are extraction runs, ``g34`` the assertions, orders and lineitems stand for assertions with their supporting atoms (parts).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from seine.operators import analytics as A
from seine.operators import coverage as C
from seine.operators import evidence as E
from seine.operators import paging as P
from seine.registry import Registry, summed_digest_sql
from seine.runtime import table
from seine.vocab import DOMAINS

R = Registry()


def _assertions(spark, sf_dir):
    g = table(spark, sf_dir, "g34")
    return g.select(F.col("row_id").alias("assertion_id"), "predicate", "subject", "object", F.col("system").alias("lineage"), "tier", "path", "line", "split")


_RUN_COLUMNS = "run_id, repo, domain, status"


@R.query(
    "latest_run_per_scope",
    sql="""SELECT run_id, repo, domain, unit_digest, published_at FROM (SELECT *, row_number() OVER (PARTITION BY repo, domain, unit_digest ORDER BY published_at DESC, run_id) AS n
           FROM runs WHERE status = 'published' AND published_at IS NOT NULL) WHERE n = 1""",
)
def latest_run_per_scope(spark, sf_dir):
    return E.latest_published(table(spark, sf_dir, "runs"), ["repo", "domain", "unit_digest"]).select("run_id", "repo", "domain", "unit_digest", "published_at")


@R.query(
    "latest_attempt_per_scope",
    sql=f"""SELECT {_RUN_COLUMNS} FROM (SELECT *, row_number() OVER (PARTITION BY repo, domain ORDER BY started_at DESC, run_id) AS n FROM runs WHERE started_at IS NOT NULL) WHERE n = 1""",
)
def latest_attempt_per_scope(spark, sf_dir):
    return E.latest_attempt(table(spark, sf_dir, "runs"), ["repo", "domain"]).select("run_id", "repo", "domain", "status")


_CERTIFICATE_SQL = f"""
grid AS (SELECT name AS repo, indexed_commit, unnest({list(DOMAINS)!r}) AS domain FROM repos WHERE is_public),
done AS (SELECT repo, domain, run_id, "commit" AS run_commit, started_at FROM (SELECT *, row_number() OVER (PARTITION BY repo, domain ORDER BY published_at DESC, run_id) AS n
         FROM runs WHERE status = 'published' AND published_at IS NOT NULL) WHERE n = 1),
tried AS (SELECT repo, domain, run_id AS attempt_run, status AS attempt_status, started_at AS attempt_started FROM (SELECT *, row_number() OVER (PARTITION BY repo, domain ORDER BY started_at DESC, run_id) AS n
          FROM runs WHERE started_at IS NOT NULL) WHERE n = 1),
failing AS (SELECT repo, domain, count_if(outcome = 'failed') AS failures FROM results GROUP BY ALL),
cells AS (SELECT g.repo, g.domain, d.run_id, CASE
    WHEN d.run_id IS NULL AND t.attempt_status = 'staged' THEN 'processing' WHEN d.run_id IS NULL AND t.attempt_status = 'aborted' THEN 'failed' WHEN d.run_id IS NULL THEN 'unsupported'
    WHEN NOT coalesce(d.run_commit = g.indexed_commit, false) THEN 'stale' WHEN coalesce(f.failures, 0) > 0 THEN 'failed'
    WHEN t.attempt_status = 'aborted' AND t.attempt_started > d.started_at AND t.attempt_run <> d.run_id THEN 'covered_with_failed_replacement' ELSE 'covered' END AS state
  FROM grid g LEFT JOIN done d ON g.repo = d.repo AND g.domain = d.domain LEFT JOIN tried t ON g.repo = t.repo AND g.domain = t.domain LEFT JOIN failing f ON g.repo = f.repo AND g.domain = f.domain)
"""


def _certificate(spark, sf_dir):
    visible = table(spark, sf_dir, "repos").where("is_public").select(F.col("name").alias("repo"), "indexed_commit")
    failures = table(spark, sf_dir, "results").groupBy("repo", "domain").agg(F.count_if(F.col("outcome") == "failed").alias("failures"))
    return C.certificate(visible, list(DOMAINS), table(spark, sf_dir, "runs"), failures)


@R.query("coverage_certificate", sql=f"WITH {_CERTIFICATE_SQL} SELECT repo, domain, run_id, state FROM cells")
def coverage_certificate(spark, sf_dir):
    return _certificate(spark, sf_dir).select("repo", "domain", "run_id", "state")


@R.query("coverage_state_counts", sql=f"WITH {_CERTIFICATE_SQL} SELECT domain, state, count(*) AS repositories FROM cells GROUP BY ALL")
def coverage_state_counts(spark, sf_dir):
    return C.state_counts(_certificate(spark, sf_dir))


@R.query(
    "coverage_fingerprint",
    sql=f"""WITH {_CERTIFICATE_SQL}, lines AS (SELECT repo || '|' || domain || '|' || coalesce(run_id, '-') || '|' || state AS line FROM cells)
    SELECT count(*) AS cells, {summed_digest_sql("line", "'coverage' || chr(0)")} AS digest FROM lines""",
)
def coverage_fingerprint(spark, sf_dir):
    return C.fingerprint(_certificate(spark, sf_dir))


@R.query(
    "coverage_rows_state",
    sql=f"""WITH {_CERTIFICATE_SQL} SELECT repo, CASE WHEN count_if(state LIKE 'covered%') > 0 THEN 'nonempty' WHEN bool_or(state IN ('failed', 'processing', 'stale')) THEN 'gap' ELSE 'empty' END AS rows_state FROM cells GROUP BY repo""",
)
def coverage_rows_state(spark, sf_dir):
    return C.rows_state(_certificate(spark, sf_dir), ["repo"], F.col("state").startswith("covered"), F.col("state").isin("failed", "processing", "stale"))


@R.query(
    "coverage_run_stats",
    sql="""SELECT domain, count(*) AS runs, sum(coverage.corpus_file_count)::BIGINT AS files, sum(coverage.read_bytes)::BIGINT AS bytes, sum(coverage.assertion_count)::BIGINT AS assertions,
           sum(coverage.unresolved_count)::BIGINT AS unresolved, count(DISTINCT repo) AS repositories FROM runs GROUP BY domain""",
)
def coverage_run_stats(spark, sf_dir):
    c = [("corpus_file_count", "files"), ("read_bytes", "bytes"), ("assertion_count", "assertions"), ("unresolved_count", "unresolved")]
    return table(spark, sf_dir, "runs").groupBy("domain").agg(F.count("*").alias("runs"), *[F.sum(f"coverage.{a}").alias(b) for a, b in c], F.countDistinct("repo").alias("repositories"))


_A_SQL = "a AS (SELECT row_id AS assertion_id, predicate, subject, object, system AS lineage, tier, path, line, split FROM g34)"


@R.query(
    "assertion_keyset_page",
    sql=f"""WITH {_A_SQL} SELECT predicate, subject, object, assertion_id FROM a
    WHERE (predicate, subject, object, assertion_id) > ('K8S_SERVICE_DNS', 'deploy', '', 0) AND predicate IS NOT NULL AND subject IS NOT NULL AND object IS NOT NULL
    ORDER BY predicate, subject, object, assertion_id LIMIT 51""",
)
def assertion_keyset_page(spark, sf_dir):
    rows = _assertions(spark, sf_dir).dropna(subset=["predicate", "subject", "object"])
    return E.list_assertions(rows, limit=50, cursor=["K8S_SERVICE_DNS", "deploy", "", 0]).select("predicate", "subject", "object", "assertion_id")


@R.query(
    "assertion_prefix_list",
    sql=f"""WITH {_A_SQL} SELECT assertion_id, subject, object FROM a WHERE predicate = 'REFERENCES_PROTO_FIELD' AND starts_with(object, 'harborlight.') AND lineage = 'harborlight'
    ORDER BY predicate, subject, object, assertion_id LIMIT 101""",
)
def assertion_prefix_list(spark, sf_dir):
    return E.list_assertions(_assertions(spark, sf_dir), predicate="REFERENCES_PROTO_FIELD", object_prefix="harborlight.", lineage="harborlight", limit=100).select("assertion_id", "subject", "object")


@R.query(
    "reverse_assertions",
    sql=f"""WITH {_A_SQL}, hot AS (SELECT object FROM a WHERE predicate = 'CALLER_REACHABLE_FROM_BINARY' AND object IS NOT NULL GROUP BY object ORDER BY count(*) DESC, object LIMIT 1)
    SELECT lineage, subject, assertion_id FROM a WHERE predicate = 'CALLER_REACHABLE_FROM_BINARY' AND object = (SELECT object FROM hot) ORDER BY lineage, subject, assertion_id LIMIT 51""",
)
def reverse_assertions(spark, sf_dir):
    rows = _assertions(spark, sf_dir)
    calls = rows.where("predicate = 'CALLER_REACHABLE_FROM_BINARY' AND object IS NOT NULL")
    hot = calls.groupBy("object").count().orderBy(F.desc("count"), "object").limit(1).select("object")
    return E.reverse_assertions(rows, "CALLER_REACHABLE_FROM_BINARY", hot).select("lineage", "subject", "assertion_id")


@R.query(
    "published_semi_join",
    sql="""SELECT repo, count(*) AS n, sum(facts)::BIGINT AS facts FROM results WHERE run_id IN (SELECT run_id FROM runs WHERE status = 'published') GROUP BY repo""",
)
def published_semi_join(spark, sf_dir):
    return E.visible(table(spark, sf_dir, "results"), table(spark, sf_dir, "runs")).groupBy("repo").agg(F.count("*").alias("n"), F.sum("facts").alias("facts"))


def _supported(spark, sf_dir):
    """Orders as assertions whose supporting atoms are the parts of their lines."""
    lines = table(spark, sf_dir, "lineitem")
    supports = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_set(F.col("l_partkey").cast("string"))).alias("supporting"))
    assertions = table(spark, sf_dir, "orders").join(supports, "o_orderkey").select(
        F.col("o_orderkey").cast("string").alias("assertion_id"), F.col("o_orderkey").cast("string").alias("run_id"), "supporting", F.array().cast("array<string>").alias("contradicting"),
        F.when(F.col("o_orderstatus") == "F", "CALLS_OPERATION").otherwise("DECLARES_FIELD").alias("predicate"), F.lit("derived").alias("tier"), F.lit("x").alias("lineage"), F.lit("grpc-consumer").alias("domain"), "o_orderdate",
    )
    occurrences = lines.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("occurrence_id"), F.col("l_orderkey").cast("string").alias("run_id"), F.col("l_partkey").cast("string").alias("atom_id"),
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("path"), F.col("l_linenumber").alias("start_line"),
    )
    atoms = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("atom_id"), F.col("p_brand").alias("rule_id"))
    return assertions, occurrences, atoms


_SUPPORT_SQL = """
l AS (SELECT l_orderkey::VARCHAR AS run_id, l_partkey::VARCHAR AS atom_id, l_orderkey || '-' || l_linenumber AS occurrence_id, 's' || l_suppkey AS path, l_linenumber AS start_line FROM lineitem),
o AS (SELECT o_orderkey::VARCHAR AS run_id, o_orderstatus, o_orderdate FROM orders)
"""


@R.query("proof_evidence_join", sql=f"WITH {_SUPPORT_SQL} SELECT l.run_id, l.atom_id, l.occurrence_id, l.path, p.p_brand AS rule_id FROM l JOIN o ON l.run_id = o.run_id JOIN part p ON p.p_partkey::VARCHAR = l.atom_id")
def proof_evidence_join(spark, sf_dir):
    assertions, occurrences, atoms = _supported(spark, sf_dir)
    return E.proof_evidence(assertions, atoms, occurrences).select("run_id", "atom_id", "occurrence_id", "path", "rule_id")


@R.query(
    "impact_projection",
    sql=f"""WITH {_SUPPORT_SQL} SELECT CASE WHEN o_orderstatus = 'F' THEN 'matching' ELSE 'resolved' END AS kind, o_orderdate >= '1998-01-01'::TIMESTAMP AS fresh, count(DISTINCT (l.run_id, l.atom_id, l.occurrence_id)) AS n, count(DISTINCT l.atom_id) AS atoms
    FROM l JOIN o ON l.run_id = o.run_id GROUP BY ALL""",
)
def impact_projection(spark, sf_dir):
    assertions, occurrences, _ = _supported(spark, sf_dir)
    fresh = assertions.select("run_id", (F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp")).alias("fresh"))
    rows = E.impact_rows(assertions, occurrences, fresh)
    kind = E.assertion_kind(F.col("predicate"), F.col("tier"), F.col("domain"), F.col("lineage"))
    return rows.groupBy(kind.alias("kind"), "fresh").agg(F.count("*").alias("n"), F.countDistinct("atom_id").alias("atoms"))


@R.query(
    "resolve_evidence",
    sql=f"""WITH {_SUPPORT_SQL} SELECT occurrence_id, run_id, path, start_line FROM l JOIN o USING (run_id) WHERE atom_id = '17' ORDER BY path, start_line, occurrence_id LIMIT 100""",
)
def resolve_evidence(spark, sf_dir):
    assertions, occurrences, atoms = _supported(spark, sf_dir)
    runs = assertions.select("run_id", F.lit("published").alias("status"))
    return E.resolve_atom(occurrences.withColumn("repo", F.lit("r")), atoms, runs, "17").select("occurrence_id", "run_id", "path", "start_line")


@R.query(
    "impact_partition",
    sql="""SELECT system, CASE WHEN tier = 'unresolved' OR starts_with(predicate, 'UNRESOLVED_') THEN 'abstention' ELSE 'resolved' END AS kind, tier, count(*) AS n FROM g34 GROUP BY ALL""",
)
def impact_partition(spark, sf_dir):
    kind = E.assertion_kind(F.col("predicate"), F.col("tier"), F.lit("grpc-caller"), F.col("lineage"))
    return _assertions(spark, sf_dir).groupBy(F.col("lineage").alias("system"), kind.alias("kind"), "tier").agg(F.count("*").alias("n"))


@R.query(
    "exact_locator_join",
    sql="""SELECT g.row_id::VARCHAR AS assertion_id, min(s.site_id) AS atom_id FROM g34 g JOIN sites s ON s.site_id = g.site_id AND s.path = g.path AND s.line = g.line AND s.system = g.system GROUP BY g.row_id""",
)
def exact_locator_join(spark, sf_dir):
    g = table(spark, sf_dir, "g34")
    assertions = g.select(
        F.col("row_id").cast("string").alias("assertion_id"), F.lit("run").alias("run_id"), F.col("system").alias("repo"),
        F.concat("path", F.lit(":"), F.col("line").cast("string"), F.lit("-"), F.col("line").cast("string")).alias("subject"), F.array("site_id").alias("supporting"),
    )
    s = table(spark, sf_dir, "sites")
    occurrences = s.select(
        F.concat_ws("@", "site_id", "wave").alias("occurrence_id"), F.lit("run").alias("run_id"), F.col("system").alias("repo"), F.col("site_id").alias("atom_id"), "path", F.col("line").alias("start_line"), F.col("line").alias("end_line"),
    )
    return E.exact_locator(assertions, occurrences).select("assertion_id", "atom_id")


@R.query(
    "assertion_merge",
    sql="""WITH g AS (SELECT object, list_sort(list_distinct(list(path) FILTER (split = 'train' AND trim(path) <> ''))) AS s, list_sort(list_distinct(list(path) FILTER (split = 'dev' AND trim(path) <> ''))) AS c FROM g34 WHERE object IS NOT NULL GROUP BY object)
    SELECT object, len(coalesce(s, []))::INTEGER AS supports, len(coalesce(c, []))::INTEGER AS contradicts, coalesce(array_to_string(s, '|'), '') AS supporting, list_has_any(coalesce(s, []), coalesce(c, [])) AS overlapping FROM g""",
)
def assertion_merge(spark, sf_dir):
    g = table(spark, sf_dir, "g34").where("object IS NOT NULL")
    side = lambda s: F.when((F.col("split") == s) & F.col("path").isNotNull(), F.array("path")).otherwise(F.array().cast("array<string>"))
    merged = E.merge_assertions(g.select("object", side("train").alias("s"), side("dev").alias("c")), "object", "s", "c")
    return merged.select("object", F.size("supporting").alias("supports"), F.size("contradicting").alias("contradicts"), F.array_join("supporting", "|").alias("supporting"), "overlapping")


@R.query(
    "batch_conflicts",
    sql="""SELECT site_id, count(DISTINCT (path, line, method, registered_at)) AS versions FROM sites GROUP BY site_id HAVING count(DISTINCT (path, line, method, registered_at)) > 1""",
)
def batch_conflicts(spark, sf_dir):
    return E.normalize_batch(table(spark, sf_dir, "sites"), ["site_id"], ["path", "line", "method", "registered_at"])[1]


@R.query(
    "batch_normalized",
    sql="""WITH v AS (SELECT DISTINCT site_id, path, line, method, registered_at FROM sites), one AS (SELECT site_id FROM v GROUP BY site_id HAVING count(*) = 1)
    SELECT count(*) AS rows, count(DISTINCT path) AS paths FROM v WHERE site_id IN (SELECT site_id FROM one)""",
)
def batch_normalized(spark, sf_dir):
    clean, _ = E.normalize_batch(table(spark, sf_dir, "sites"), ["site_id"], ["path", "line", "method", "registered_at"])
    return clean.agg(F.count("*").alias("rows"), F.countDistinct("path").alias("paths"))


@R.query("max_group_multiplicity", sql="SELECT max(n) AS most FROM (SELECT count(*) AS n FROM g34 GROUP BY path)")
def max_group_multiplicity(spark, sf_dir):
    return E.most_repeated(table(spark, sf_dir, "g34"), "path")


@R.query(
    "census_densified",
    sql="""SELECT p.plane, c.class, coalesce(n, 0)::BIGINT AS n FROM (SELECT unnest(['grpc-caller', 'kafka-producer', 'kafka-consumer', 'absent-plane']) AS plane) p CROSS JOIN (SELECT unnest(['failed', 'canceled', 'domain_budget', 'never']) AS class) c
    LEFT JOIN (SELECT domain, reason, sum(unresolved) AS n FROM results GROUP BY ALL) r ON r.domain = p.plane AND r.reason = c.class""",
)
def census_densified(spark, sf_dir):
    rows = table(spark, sf_dir, "results").select(F.col("domain").alias("plane"), F.col("reason").alias("class"), "unresolved")
    return C.densified_counts(rows, {"plane": ["grpc-caller", "kafka-producer", "kafka-consumer", "absent-plane"], "class": ["failed", "canceled", "domain_budget", "never"]}, F.sum("unresolved"))


@R.query(
    "visibility_equality",
    sql="SELECT NOT EXISTS ((SELECT repo, domain FROM runs EXCEPT ALL SELECT repo, domain FROM results) UNION ALL (SELECT repo, domain FROM results EXCEPT ALL SELECT repo, domain FROM runs)) AS equal",
)
def visibility_equality(spark, sf_dir):
    return C.same_scopes(table(spark, sf_dir, "runs").select("repo", "domain"), table(spark, sf_dir, "results").select("repo", "domain"))


# paging


@R.query("overflow_probe", sql="SELECT least(count(*), 500)::BIGINT AS shown, count(*) > 500 AS truncated FROM g34 WHERE tier = 'exact'")
def overflow_probe(spark, sf_dir):
    return P.overflow(table(spark, sf_dir, "g34").where("tier = 'exact'"), 500)


@R.query("keyset_page_with_more", sql="SELECT site_id, registered_at, (SELECT count(*) > 40 FROM sites WHERE site_id > 'g3:') AS has_more FROM (SELECT * FROM sites WHERE site_id > 'g3:' ORDER BY site_id, registered_at LIMIT 40)")
def keyset_page_with_more(spark, sf_dir):
    rows = table(spark, sf_dir, "sites").select("site_id", "registered_at")
    return P.page_with_more(rows.where("site_id > 'g3:'"), ["site_id", "registered_at"], 40)


@R.query("audit_page", sql="SELECT event_id, event_type, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 25 OFFSET 50")
def audit_page(spark, sf_dir):
    return P.offset_page(table(spark, sf_dir, "events"), [F.desc("ts"), F.desc("event_id")], 50, 25).select("event_id", "event_type", "user_id")


@R.query("top_locations", sql="WITH d AS (SELECT DISTINCT path, line FROM g34 WHERE path IS NOT NULL AND line IS NOT NULL) SELECT path, line, (SELECT count(*) > 100 FROM d) AS truncated FROM d ORDER BY path, line LIMIT 100")
def top_locations(spark, sf_dir):
    return P.smallest(table(spark, sf_dir, "g34").where("path IS NOT NULL AND line IS NOT NULL"), ["path", "line"], 100)


@R.query("caller_groups_in_page", sql="SELECT system, count(*) AS rows FROM (SELECT system FROM g34 WHERE path IS NOT NULL ORDER BY system, path, line, row_id LIMIT 100) GROUP BY system")
def caller_groups_in_page(spark, sf_dir):
    page = table(spark, sf_dir, "g34").where("path IS NOT NULL").orderBy("system", "path", F.asc_nulls_last("line"), "row_id").limit(100)
    return P.group_page(page, "system")


# dashboards: events are usage events


@R.query("usage_summary", sql="SELECT count(*) AS total, (sum(value::BIGINT) // count(*))::BIGINT AS avg_duration FROM (SELECT floor(value) AS value FROM events)")
def usage_summary(spark, sf_dir):
    return A.usage_summary(table(spark, sf_dir, "events").select(F.floor("value").alias("d")), "d")


@R.query(
    "usage_daily_densified",
    sql="""WITH days AS (SELECT strftime(unnest(generate_series(DATE '2023-12-25', DATE '2024-02-05', INTERVAL 1 DAY)), '%Y-%m-%d') AS day)
    SELECT d.day, coalesce(n, 0)::BIGINT AS n FROM days d LEFT JOIN (SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1) e ON d.day = e.day""",
)
def usage_daily_densified(spark, sf_dir):
    return A.daily_counts(table(spark, sf_dir, "events").where("event_type = 'error'"), "ts", "2023-12-25", "2024-02-05")


@R.query("usage_daily_windows", sql="SELECT date_trunc('day', ts)::TIMESTAMP AS day_start, count(*) AS n FROM events GROUP BY 1")
def usage_daily_windows(spark, sf_dir):
    return A.daily_windows(table(spark, sf_dir, "events"), "ts")


@R.query("usage_top_repos", sql="SELECT repo AS name, count(*) AS n FROM results WHERE repo IS NOT NULL GROUP BY repo ORDER BY n DESC, repo LIMIT 10")
def usage_top_repos(spark, sf_dir):
    return A.top_names(table(spark, sf_dir, "results").where("repo IS NOT NULL"), "repo", 10)


@R.query(
    "retention_summary",
    sql="""SELECT count(*) AS n, CASE WHEN bool_or(b IS NULL OR b < 0) THEN NULL ELSE sum(b)::BIGINT END AS bytes, (SELECT count(*) > 200 FROM runs WHERE coverage.read_bytes IS NOT NULL) AS truncated
    FROM (SELECT coverage.read_bytes AS b FROM runs WHERE coverage.read_bytes IS NOT NULL ORDER BY run_id LIMIT 200)""",
)
def retention_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "runs").select("run_id", F.col("coverage.read_bytes").alias("bytes_read")).where("bytes_read IS NOT NULL")
    return A.bounded_sum(rows, ["run_id"], "bytes_read", 200)


@R.query("status_counts", sql="SELECT count(*) AS total, count_if(status = 'staged')::BIGINT AS staged, count_if(status = 'published')::BIGINT AS published, count_if(published_at IS NULL)::BIGINT AS undated FROM runs")
def status_counts(spark, sf_dir):
    return A.counts_by(table(spark, sf_dir, "runs"), staged=F.col("status") == "staged", published=F.col("status") == "published", undated=F.col("published_at").isNull())


@R.query(
    "publication_sums",
    sql="""SELECT count(*) AS rows, coalesce(sum(facts), 0)::BIGINT AS facts_sum, coalesce(sum(candidate_files), 0)::BIGINT AS candidate_files_sum, count(facts) AS facts_known, count(candidate_files) AS candidate_files_known FROM results WHERE repo <> 'forge.example/harborlight/monorepo'""",
)
def publication_sums(spark, sf_dir):
    return A.sums_of_others(table(spark, sf_dir, "results"), "repo", "forge.example/harborlight/monorepo", "facts", "candidate_files")


@R.query(
    "corpus_digest",
    sql=f"""WITH m AS (SELECT doc_id || ' ' || sha256(text) AS line, strlen(text) AS size FROM documents WHERE text IS NOT NULL)
    SELECT count(*) AS files, sum(size)::BIGINT AS bytes, {summed_digest_sql("line")} AS digest FROM m""",
)
def corpus_digest(spark, sf_dir):
    return A.ordered_digest(table(spark, sf_dir, "documents").where("text IS NOT NULL"), "doc_id", "text")


@R.query(
    "fair_schedule",
    sql="""SELECT repo, domain, status, row_number() OVER (ORDER BY status = 'aborted', started_at NULLS FIRST, run_id)::INTEGER AS place FROM runs ORDER BY place LIMIT 100""",
)
def fair_schedule(spark, sf_dir):
    from pyspark.sql import Window

    head = table(spark, sf_dir, "runs").orderBy(F.col("status") == "aborted", F.asc_nulls_first("started_at"), "run_id").limit(100)
    order = Window.orderBy(F.col("status") == "aborted", F.asc_nulls_first("started_at"), "run_id")  # over the bounded head only
    return head.select("repo", "domain", "status", F.row_number().over(order).alias("place"))
