"""Scalar functions, file views and queue queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from seine.functions import scalars as S
from seine.registry import Registry
from seine.runtime import table
from seine.sources import files as V
from seine.sources.rest import excluded
from seine.streaming import queue as Q

R = Registry()


def _sites(spark, sf_dir):
    return table(spark, sf_dir, "sites")


@R.query("identity_hash", sql="SELECT site_id, wave, 'ea_' || sha256(strlen(system) || ':' || system || ';' || strlen(path) || ':' || path || ';') AS identity FROM sites")
def identity_hash(spark, sf_dir):
    return _sites(spark, sf_dir).select("site_id", "wave", S.identity("ea_", F.col("system"), F.col("path")).alias("identity"))


@R.query("domain_digest", sql="SELECT repo, count(*) AS n, count(DISTINCT sha256('scope' || chr(0) || run_id)) AS digests, min(sha256('scope' || chr(0) || run_id)) AS least FROM runs GROUP BY repo")
def domain_digest(spark, sf_dir):
    d = S.domain_digest("scope", F.col("run_id"))
    return table(spark, sf_dir, "runs").groupBy("repo").agg(F.count("*").alias("n"), F.countDistinct(d).alias("digests"), F.min(d).alias("least"))


@R.query("hash_buckets", sql="SELECT ('0x' || substr(sha256(run_id), 1, 2))::INTEGER AS bucket, count(*) AS n FROM runs GROUP BY 1")
def hash_buckets(spark, sf_dir):
    return table(spark, sf_dir, "runs").groupBy(S.hash_bucket(F.col("run_id")).alias("bucket")).agg(F.count("*").alias("n"))


@R.query("hash_bit_prefix", sql="SELECT substr(lpad(bin(('0x' || substr(sha256(run_id), 1, 8))::UBIGINT), 32, '0'), 1, 5) AS prefix, count(*) AS n FROM runs GROUP BY 1")
def hash_bit_prefix(spark, sf_dir):
    return table(spark, sf_dir, "runs").groupBy(S.bit_prefix(F.col("run_id"), 5).alias("prefix")).agg(F.count("*").alias("n"))


@R.query("glob_match", sql=r"SELECT name FROM repos WHERE regexp_matches(name, '^forge\.example/[^/]*/[a-m][^/]*-(svc|lib)$')")
def glob_match(spark, sf_dir):
    n = F.col("name")
    return table(spark, sf_dir, "repos").where(S.glob_match(n, "forge.example/*/[a-m]*-svc") | S.glob_match(n, "forge.example/*/[a-m]*-lib")).select("name")


@R.query(
    "code_roles",
    sql=r"""WITH p AS (SELECT path, string_split(path, '/') AS s, regexp_extract(path, '[^/]+$') AS f FROM sites WHERE path IS NOT NULL)
    SELECT CASE WHEN list_contains(s, 'vendor') THEN 'vendor' WHEN list_has_any(s, ['mock', 'mocks', 'mocksgen', 'fake', 'fakes']) OR regexp_matches(f, '^(mock|fake)_|_(mock|fake)(_test)?\.go$') THEN 'mock'
      WHEN ends_with(path, '_test.go') OR list_has_any(s, ['tests', 'testing', 'testdata']) THEN 'test' ELSE 'production' END AS code_role,
      CASE WHEN list_contains(s, 'vendor') THEN 'vendor' WHEN ends_with(path, '_test.go') OR list_has_any(s, ['test', 'tests', 'testdata']) THEN 'test' ELSE 'production' END AS source_role, count(*) AS n FROM p GROUP BY ALL""",
)
def code_roles(spark, sf_dir):
    s = _sites(spark, sf_dir).where("path IS NOT NULL")
    return s.groupBy(S.code_role(F.col("path"), F.lit("")).alias("code_role"), S.source_role(F.col("path")).alias("source_role")).agg(F.count("*").alias("n"))


@R.query(
    "path_segments",
    sql=r"""SELECT path, len(string_split(path, '/'))::INTEGER AS depth, (path <> '' AND NOT list_has_any(string_split(path, '/'), ['', '.', '..']) AND NOT contains(path, chr(92))) AS valid, list_has_any(string_split(path, '/'), ['gen', 'integration']) AS special FROM (SELECT DISTINCT path FROM g34 WHERE path IS NOT NULL)""",
)
def path_segments(spark, sf_dir):
    p = F.col("path")
    return table(spark, sf_dir, "g34").where("path IS NOT NULL").select("path").distinct().select("path", F.size(S.segments(p)).alias("depth"), S.valid_path(p).alias("valid"), S.has_segment(p, "gen", "integration").alias("special"))


@R.query("path_ancestors", sql="WITH p AS (SELECT DISTINCT path FROM sites WHERE path IS NOT NULL), a AS (SELECT array_to_string(string_split(path, '/')[1:n], '/') AS ancestor FROM p, LATERAL (SELECT unnest(generate_series(1, len(string_split(path, '/')))) AS n)) SELECT ancestor, count(*) AS files FROM a GROUP BY ancestor HAVING count(*) > 1")
def path_ancestors(spark, sf_dir):
    p = _sites(spark, sf_dir).where("path IS NOT NULL").select("path").distinct()
    return p.select(F.explode(S.ancestors(F.col("path"))).alias("ancestor")).groupBy("ancestor").agg(F.count("*").alias("files")).where("files > 1")


@R.query("subject_parser", sql=r"SELECT site_id, regexp_extract(subject, '^(.+):([0-9]+)-([0-9]+)$', 1) AS path, regexp_extract(subject, '^(.+):([0-9]+)-([0-9]+)$', 3)::INTEGER AS end_line FROM (SELECT site_id, path || ':' || line || '-' || (line + 4) AS subject FROM sites) WHERE subject IS NOT NULL")
def subject_parser(spark, sf_dir):
    s = _sites(spark, sf_dir).select("site_id", S.parse_subject(F.concat("path", F.lit(":"), F.col("line").cast("string"), F.lit("-"), (F.col("line") + 4).cast("string"))).alias("p")).where("p.path IS NOT NULL")
    return s.select("site_id", "p.path", "p.end_line")


@R.query(
    "repo_names",
    sql="""SELECT name, name AS from_https, 'local/' || name AS from_path, name AS from_scp, 'https://' || name || '.git' AS clean FROM repos""",
)
def repo_names(spark, sf_dir):
    n = F.col("name")
    https = F.concat(F.lit("https://user:secret@"), n, F.lit(".git?x=1#f"))
    scp = F.concat(F.lit("git@"), F.substring_index(n, "/", 1), F.lit(":"), F.expr("substring(name, length(substring_index(name, '/', 1)) + 2)"), F.lit(".git"))
    return table(spark, sf_dir, "repos").select("name", S.repo_name(https).alias("from_https"), S.repo_name(F.concat(F.lit("/"), n, F.lit(".git"))).alias("from_path"), S.repo_name(scp).alias("from_scp"), S.sanitize_url(https).alias("clean"))


@R.query("identity_and_topics", sql="SELECT user_id, lower('Forge:' || event_type) AS login, regexp_full_match(event_type, '[A-Za-z0-9._-]{1,249}') AS valid, count(*) AS n FROM events GROUP BY ALL")
def identity_and_topics(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id", S.host_identity(F.lit(" Forge"), F.col("event_type")).alias("login"), S.valid_topic(F.col("event_type")).alias("valid")).agg(F.count("*").alias("n"))


@R.query("camel_case", sql=r"SELECT DISTINCT regexp_extract(object, '[a-z_]+$') AS name, array_to_string(list_transform(string_split(regexp_extract(object, '[a-z_]+$'), '_'), lambda x: upper(x[1]) || x[2:]), '') AS go_name FROM g34 WHERE predicate = 'REFERENCES_PROTO_FIELD' AND regexp_matches(object, ':[a-z]+(_[a-z]+)*$')")
def camel_case(spark, sf_dir):
    g = table(spark, sf_dir, "g34").where((F.col("predicate") == "REFERENCES_PROTO_FIELD") & F.col("object").rlike(r":[a-z]+(_[a-z]+)*$"))
    name = F.regexp_extract("object", r"[a-z_]+$", 0)
    return g.select(name.alias("name"), S.camel_case(name).alias("go_name")).distinct()


@R.query("lexical_candidates", sql="SELECT DISTINCT object, object || '.Status' AS innermost, 'Status' AS outermost, (len(string_split(object, '.')) + 1)::INTEGER AS tried FROM g34 WHERE predicate = 'SERVICE_REACHABLE_FROM_BINARY' AND object IS NOT NULL")
def lexical_candidates(spark, sf_dir):
    g = table(spark, sf_dir, "g34").where("predicate = 'SERVICE_REACHABLE_FROM_BINARY' AND object IS NOT NULL").select("object").distinct()
    c = S.lexical_candidates(F.col("object"), F.lit("Status"))
    return g.select("object", c[0].alias("innermost"), F.element_at(c, -1).alias("outermost"), F.size(c).alias("tried"))


@R.query("text_slices", sql="SELECT doc_id, substr(text, 1, 80) AS head, length(text) > 80 AS truncated, strlen(text)::INTEGER AS bytes FROM documents WHERE text IS NOT NULL")
def text_slices(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return d.select("doc_id", S.truncated(F.col("text"), 80).alias("t"), F.octet_length("text").alias("bytes")).select("doc_id", F.col("t.text").alias("head"), "t.truncated", "bytes")


@R.query("line_index", sql="WITH l AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: strlen(x)::BIGINT + 1) AS n FROM documents WHERE text IS NOT NULL) SELECT doc_id, len(n)::INTEGER AS lines, (list_sum(n) - n[-1])::BIGINT AS last_start FROM l")
def line_index(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    starts = S.line_starts(F.col("text"))
    return d.select("doc_id", S.let(starts, lambda s: F.struct(F.size(s).alias("lines"), F.element_at(s, -1).cast("long").alias("last_start"))).alias("x")).select("doc_id", "x.*")


@R.query("access_classes", sql="SELECT event_type, CASE WHEN (user_id & 4) <> 0 THEN 'write' WHEN (user_id & 8) <> 0 THEN 'read' WHEN (user_id & 32) <> 0 THEN 'test' WHEN (user_id & 16) <> 0 THEN 'generated' ELSE 'unknown' END AS access, count(*) AS n FROM events GROUP BY ALL")
def access_classes(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type", S.access_class(F.col("user_id").cast("int")).alias("access")).agg(F.count("*").alias("n"))


@R.query("field_number_bounds", sql="SELECT p_size, (p_size * 1000 BETWEEN 1 AND 536870911 AND p_size * 1000 NOT BETWEEN 19000 AND 19999) AS proto, (p_size * 1000 BETWEEN -32768 AND 32767) AS thrift, count(*) AS n FROM part GROUP BY ALL")
def field_number_bounds(spark, sf_dir):
    n = F.col("p_size") * 1000
    return table(spark, sf_dir, "part").groupBy("p_size", S.admits_field_number(n, F.lit("grpc")).alias("proto"), S.admits_field_number(n, F.lit("thrift")).alias("thrift")).agg(F.count("*").alias("n"))


@R.query("json_detail", sql="""SELECT event_type, sum((props->>'$.k')::BIGINT)::BIGINT AS k FROM events GROUP BY event_type""")
def json_detail(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", S.tagged_detail(F.concat(F.lit('{"schema":"event-v1",'), F.expr("substring(props, 2)")), "event-v1", "k bigint").alias("d"))
    return e.groupBy("event_type").agg(F.sum("d.k").alias("k"))


@R.query("clamped_options", sql="SELECT l_linenumber, CASE WHEN l_linenumber - 2 <= 0 THEN 3 ELSE least(l_linenumber - 2, 4) END AS shown, count(*) AS n FROM lineitem GROUP BY ALL")
def clamped_options(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_linenumber", S.clamp(F.col("l_linenumber") - 2, 3, 4).alias("shown")).agg(F.count("*").alias("n"))


@R.query("set_operations", sql="""WITH g AS (SELECT system, list(DISTINCT predicate) FILTER (split = 'train') AS a, list(DISTINCT predicate) FILTER (split = 'dev') AS b FROM g34 GROUP BY system)
    SELECT system, len(list_filter(coalesce(a, []), lambda x: NOT list_contains(coalesce(b, []), x))) = 0 AS subset, list_has_any(coalesce(a, []), coalesce(b, [])) AS overlap, '[' || coalesce(array_to_string(list_transform(list_sort(b), lambda x: '"' || x || '"'), ','), '') || ']' AS quoted FROM g""")
def set_operations(spark, sf_dir):
    g = table(spark, sf_dir, "g34").groupBy("system").agg(F.collect_set(F.when(F.col("split") == "train", F.col("predicate"))).alias("a"), F.collect_set(F.when(F.col("split") == "dev", F.col("predicate"))).alias("b"))
    return g.select("system", S.is_subset(F.col("a"), F.col("b")).alias("subset"), F.arrays_overlap("a", "b").alias("overlap"), S.quoted_list(F.col("b")).alias("quoted"))


# file views: documents are files


def _files(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("path IS NOT NULL").select("repo", F.lit("c").alias("commit"), "path", F.lit("file").alias("kind"), F.sha2("text", 256).alias("object_id"), F.col("text").alias("content"))


@R.query("folder_listing", sql="SELECT DISTINCT split_part(path[6:], '/', 1) AS name, CASE WHEN contains(path[6:], '/') THEN 'dir' ELSE 'file' END AS kind FROM documents WHERE path LIKE 'docs/%'")
def folder_listing(spark, sf_dir):
    return V.folder(_files(spark, sf_dir), "docs")


@R.query("tree_listing", sql="SELECT DISTINCT path FROM documents WHERE path IS NOT NULL")
def tree_listing(spark, sf_dir):
    return V.tree(_files(spark, sf_dir))


@R.query("source_blob_census", sql="SELECT sha256(text) AS object_id, count(*) AS placements, count(DISTINCT repo) AS repositories FROM documents WHERE path IS NOT NULL AND text IS NOT NULL GROUP BY 1")
def source_blob_census(spark, sf_dir):
    return V.census(_files(spark, sf_dir).where("object_id IS NOT NULL"), "object_id").select("object_id", "placements", "repositories")


@R.query("repo_exclusion", sql=r"SELECT name FROM repos WHERE NOT coalesce(is_archived, false) AND NOT coalesce(is_fork, false) AND NOT regexp_matches(name, '^forge\.example/oakum/[^/]*$')")
def repo_exclusion(spark, sf_dir):
    return excluded(table(spark, sf_dir, "repos"), globs=["forge.example/oakum/*"]).select("name")


@R.query("repo_status", sql="""WITH j AS (SELECT repo, run_id, status FROM runs WHERE started_at IS NOT NULL QUALIFY row_number() OVER (PARTITION BY repo ORDER BY started_at DESC, run_id DESC) = 1),
    c AS (SELECT repo, count(DISTINCT domain) AS connections FROM runs WHERE status = 'published' GROUP BY repo)
    SELECT r.name, j.run_id AS last_job, j.status, coalesce(c.connections, 0)::BIGINT AS connections, coalesce(c.connections, 0) = 0 AS orphaned FROM repos r LEFT JOIN j ON j.repo = r.name LEFT JOIN c ON c.repo = r.name""")
def repo_status(spark, sf_dir):
    runs = table(spark, sf_dir, "runs")
    last = runs.where("started_at IS NOT NULL").groupBy(F.col("repo").alias("name")).agg(F.max_by(F.struct("run_id", "status"), F.struct("started_at", "run_id")).alias("j"))
    held = runs.where("status = 'published'").groupBy(F.col("repo").alias("name")).agg(F.countDistinct("domain").alias("connections"))
    joined = table(spark, sf_dir, "repos").select("name").join(last, "name", "left").join(held, "name", "left")
    n = F.coalesce("connections", F.lit(0)).cast("long")
    return joined.select("name", F.col("j.run_id").alias("last_job"), "j.status", n.alias("connections"), (n == 0).alias("orphaned"))


# queues: orders are jobs, customers their targets

_JOBS_SQL = """jobs AS (SELECT o_orderkey AS id, o_orderpriority AS kind, o_custkey AS target, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'done' ELSE 'running' END AS status, (o_orderkey % 5)::INTEGER AS attempts, o_orderdate AS created_at FROM orders)"""


def _jobs(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "F", "done").otherwise("running")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("kind"), F.col("o_custkey").alias("target"), status.alias("status"), (F.col("o_orderkey") % 5).cast("int").alias("attempts"), F.col("o_orderdate").alias("created_at"), F.lit(None).cast("timestamp").alias("not_before"), F.col("o_orderdate").alias("heartbeat_at"), F.concat(F.lit("t"), F.col("o_orderkey").cast("string")).alias("lease_token"), F.lit(False).alias("force"))


@R.query("job_enqueue", sql=f"WITH {_JOBS_SQL} SELECT DISTINCT '1-URGENT' AS kind, c_custkey AS target, c_acctbal < 0 AS force FROM customer WHERE c_custkey NOT IN (SELECT target FROM jobs WHERE kind = '1-URGENT' AND status = 'pending')")
def job_enqueue(spark, sf_dir):
    wanted = table(spark, sf_dir, "customer").select(F.lit("1-URGENT").alias("kind"), F.col("c_custkey").alias("target"), (F.col("c_acctbal") < 0).alias("force"))
    return Q.enqueue(_jobs(spark, sf_dir), wanted)


@R.query("job_claim_order", sql=f"WITH {_JOBS_SQL} SELECT id, target FROM jobs WHERE status = 'pending' AND kind = '2-HIGH' ORDER BY created_at, id LIMIT 1")
def job_claim_order(spark, sf_dir):
    return Q.claimable(_jobs(spark, sf_dir), "2-HIGH", F.lit("2030-01-01").cast("timestamp")).select("id", "target")


@R.query("reap_stale", sql=f"WITH {_JOBS_SQL} SELECT CASE WHEN status = 'running' AND created_at < '1997-06-01'::TIMESTAMP THEN CASE WHEN attempts >= 3 THEN 'failed' ELSE 'pending' END ELSE status END AS status, count(*) AS n FROM jobs GROUP BY 1")
def reap_stale(spark, sf_dir):
    return Q.reap(_jobs(spark, sf_dir), F.lit("1997-06-01").cast("timestamp"), 3).groupBy("status").agg(F.count("*").alias("n"))


@R.query("lease_fenced_transition", sql=f"WITH {_JOBS_SQL} SELECT CASE WHEN status = 'running' AND kind = '1-URGENT' THEN 'done' ELSE status END AS status, count(*) AS n FROM jobs GROUP BY 1")
def lease_fenced_transition(spark, sf_dir):
    jobs = _jobs(spark, sf_dir)
    token = F.when(F.col("kind") == "1-URGENT", F.col("lease_token")).otherwise("lost")
    return Q.transition(jobs, jobs.select("id", token.alias("lease_token"), F.lit("done").alias("status"))).groupBy("status").agg(F.count("*").alias("n"))


@R.query("chunk_expansion", sql="""WITH s AS (SELECT run_id, coverage.candidate_file_count AS total FROM runs WHERE coverage.candidate_file_count > 0)
    SELECT run_id, o AS "offset", least(1000, total - o)::BIGINT AS length FROM s, LATERAL (SELECT unnest(generate_series(0, total - 1, 1000)) AS o)""")
def chunk_expansion(spark, sf_dir):
    s = table(spark, sf_dir, "runs").select("run_id", F.col("coverage.candidate_file_count").alias("total"))
    return Q.chunked(s, "total", 1000).select("run_id", "offset", "length")


@R.query("fair_chunk_claim", sql="""WITH c AS (SELECT repo AS schedule_id, repo, run_id, status, started_at FROM runs), busy AS (SELECT repo, count(*) AS busy FROM c WHERE status = 'staged' GROUP BY repo),
    last AS (SELECT repo AS schedule_id, max(started_at) AS last_claimed FROM runs WHERE status = 'published' GROUP BY repo),
    w AS (SELECT c.*, l.last_claimed, coalesce(b.busy, 0) AS busy, row_number() OVER (PARTITION BY c.repo ORDER BY l.last_claimed NULLS FIRST, c.schedule_id, c.started_at) AS n FROM c JOIN last l USING (schedule_id) LEFT JOIN busy b ON b.repo = c.repo WHERE c.status = 'superseded')
    SELECT run_id, repo FROM w WHERE n + busy <= 2 ORDER BY last_claimed NULLS FIRST, schedule_id, started_at LIMIT 60""")
def fair_chunk_claim(spark, sf_dir):
    runs = table(spark, sf_dir, "runs")
    status = F.when(F.col("status") == "staged", "running").when(F.col("status") == "superseded", "pending").otherwise("done")
    chunks = runs.select(F.col("repo").alias("schedule_id"), "repo", "run_id", F.lit(0).alias("priority"), F.col("started_at").alias("offset"), F.lit(0).alias("attempt"), status.alias("status"))
    schedules = runs.where("status = 'published'").groupBy(F.col("repo").alias("schedule_id")).agg(F.max("started_at").alias("last_claimed"))
    return Q.fair_claims(chunks, schedules, 2, 60).select("run_id", "repo")


@R.query("retention_sweep", sql="SELECT run_id FROM runs WHERE status IN ('superseded', 'aborted') AND started_at <= '2026-01-01'::TIMESTAMPTZ AND run_id NOT IN (SELECT run_id FROM results WHERE outcome = 'failed' AND run_id IS NOT NULL) ORDER BY started_at, run_id LIMIT 500")
def retention_sweep(spark, sf_dir):
    pins = table(spark, sf_dir, "results").where("outcome = 'failed' AND run_id IS NOT NULL")
    return Q.sweepable(table(spark, sf_dir, "runs"), pins, F.lit("2026-01-01 00:00:00").cast("timestamp"), 500).select("run_id")


@R.query("time_retention", sql="SELECT event_type, count(*) AS kept FROM events WHERE ts > '2024-01-15'::TIMESTAMP GROUP BY 1")
def time_retention(spark, sf_dir):
    return Q.prune(table(spark, sf_dir, "events"), "ts", F.lit("2024-01-15").cast("timestamp")).groupBy("event_type").agg(F.count("*").alias("kept"))


@R.query("late_writers_canceled", sql="""WITH cur AS (SELECT repo, max("commit") AS generation FROM runs WHERE status = 'published' GROUP BY repo)
    SELECT CASE WHEN r."commit" IS NOT DISTINCT FROM cur.generation THEN r.status ELSE 'canceled' END AS status, count(*) AS n FROM runs r LEFT JOIN cur ON cur.repo = r.repo GROUP BY 1""")
def late_writers_canceled(spark, sf_dir):
    runs = table(spark, sf_dir, "runs").select("repo", "status", F.col("commit").alias("generation"))
    current = runs.where("status = 'published'").groupBy("repo").agg(F.max("generation").alias("generation"))
    return Q.drop_superseded(runs, current, "repo").groupBy("status").agg(F.count("*").alias("n"))


@R.query("expected_pairs", sql="SELECT r.name AS leaf, d.d AS adapter FROM repos r CROSS JOIN (SELECT unnest(['grpc-caller', 'thrift-caller', 'kafka-producer']) AS d) d WHERE NOT EXISTS (SELECT 1 FROM runs x WHERE x.repo = r.name AND x.domain = d.d)")
def expected_pairs(spark, sf_dir):
    outcomes = table(spark, sf_dir, "runs").select(F.col("repo").alias("leaf"), F.col("domain").alias("adapter"))
    return Q.expected_pairs(["grpc-caller", "thrift-caller", "kafka-producer"], table(spark, sf_dir, "repos").select(F.col("name").alias("leaf")), outcomes)


@R.query(
    "text_units",
    sql=r"""SELECT doc_id, (length(text) + length(regexp_replace(text, '[\x{0000}-\x{FFFF}]', '', 'g')))::INTEGER AS utf16_units, strlen(substr(split_part(text, chr(10), 1), 1, 7))::INTEGER AS byte_of_point_7 FROM documents WHERE text IS NOT NULL""",
)
def text_units(spark, sf_dir):
    """Lengths in UTF-16 units, and the byte at which the eighth code point of the first line begins."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    line = F.substring_index("text", "\n", 1)
    return d.select("doc_id", S.utf16_units(F.col("text")).alias("utf16_units"), S.byte_of_column(line, F.lit(7), F.lit("utf-32")).cast("int").alias("byte_of_point_7"))


@R.query(
    "content_bodies",
    sql=r"""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'utf-8' ELSE 'base64' END AS encoding, md5(CASE WHEN doc_id % 2 = 0 THEN text ELSE base64(encode(text) || '\xFF'::BLOB) END) AS body FROM documents WHERE text IS NOT NULL""",
)
def content_bodies(spark, sf_dir):
    """Contents as they are served: text as it is, in base64 what a byte makes invalid (here one more byte for every other document)."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    raw = F.when(F.col("doc_id") % 2 == 0, F.encode("text", "UTF-8")).otherwise(F.concat(F.encode("text", "UTF-8"), F.unhex(F.lit("FF"))))
    body = d.select("doc_id", S.content_body(raw).alias("c"))
    # long base64 is wrapped at 76 characters by the engine; lines are joined before it is compared
    return body.select("doc_id", "c.encoding", F.md5(F.when(F.col("c.encoding") == "base64", F.regexp_replace("c.body", "[\r\n]", "")).otherwise(F.col("c.body"))).alias("body"))
