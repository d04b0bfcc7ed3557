"""Caller, catalog, binding and composition queries. Findings are the caller records; systems their repositories."""

from __future__ import annotations

from pyspark.sql import functions as F

from seine.operators import callers as C
from seine.operators import coverage
from seine.registry import Registry, summed_digest_sql
from seine.runtime import table

R = Registry()

_ROLE_SQL = "CASE WHEN list_contains(string_split(path, '/'), 'vendor') THEN 'vendor' WHEN ends_with(path, '_test.go') OR list_has_any(string_split(path, '/'), ['test', 'tests', 'testdata']) THEN 'test' ELSE 'production' END"


def _callers(spark, sf_dir):
    from seine.functions.scalars import source_role

    g = table(spark, sf_dir, "g34")
    unit = F.struct(F.regexp_extract("path", r"^[^/]+/[^/]+", 0).alias("unit"), F.col("source").alias("owner"))
    return g.select(
        F.col("row_id").alias("caller_id"), "predicate", "path", F.col("line").alias("start_line"), "tier", F.col("system").alias("repo"), F.when(F.col("path").isNotNull(), source_role(F.col("path"))).alias("code_role"),
        (F.col("split") == "train").alias("fresh"), F.when(F.col("tier") == "exact", "resolved").otherwise("matching").alias("resolution"), F.array(unit).alias("units"), F.col("object").alias("operation"), "split",
    )


@R.query(
    "caller_map_filter",
    sql=f"""SELECT row_id AS caller_id, path, line AS start_line FROM g34 WHERE (path = 'internal' OR starts_with(path, 'internal/') ) AND {_ROLE_SQL} = 'production' AND tier = 'exact' AND split = 'train' AND source = 'nightly' ORDER BY system, path, line NULLS FIRST, row_id LIMIT 50""",
)
def caller_map_filter(spark, sf_dir):
    rows = C.filter_callers(_callers(spark, sf_dir), "internal", ["production"], ["exact"], True, "resolved", owner="nightly")
    return rows.orderBy(*C.caller_order()).limit(50).select("caller_id", "path", "start_line")


@R.query("caller_record_counts", sql="SELECT system AS repo, split, count_if(tier <> 'derived')::BIGINT AS resolved, count_if(tier = 'derived')::BIGINT AS abstained, count(*) AS records FROM g34 GROUP BY ALL")
def caller_record_counts(spark, sf_dir):
    rows = _callers(spark, sf_dir).withColumn("predicate", F.when(F.col("tier") == "derived", F.concat(F.lit("UNRESOLVED_"), F.col("predicate"))).otherwise(F.col("predicate")))
    return C.record_counts(rows, ["repo", "split"])


@R.query(
    "caller_contract_problems",
    sql="""SELECT row_id AS caller_id, unnest(list_filter([CASE WHEN object IS NULL THEN 'resolved_without_target' END, CASE WHEN path IS NULL OR line IS NULL THEN 'bad_span' END], lambda x: x IS NOT NULL)) AS problem FROM g34""",
)
def caller_contract_problems(spark, sf_dir):
    span = F.concat("path", F.lit(":"), F.col("start_line").cast("string"), F.lit("-"), (F.col("start_line") + 1).cast("string"))
    rows = _callers(spark, sf_dir).withColumn("subject", F.coalesce(span, F.lit("nowhere"))).withColumn("code_role", F.coalesce("code_role", F.lit("production")))
    return C.contract_problems(rows)


@R.query(
    "caller_leaf_outcomes",
    sql=f"""WITH f AS (SELECT DISTINCT path, {_ROLE_SQL} AS role, CASE WHEN ends_with(path, '.go') THEN 'supported' ELSE 'unsupported' END AS lane FROM sites WHERE path IS NOT NULL), n AS (SELECT path, count(*) AS facts FROM g34 WHERE path IS NOT NULL GROUP BY path),
    o AS (SELECT f.*, coalesce(n.facts, 0) AS n, CASE WHEN role = 'test' THEN 'excluded_test' WHEN lane <> 'supported' THEN 'abstained_' || lane WHEN coalesce(n.facts, 0) > 0 THEN 'facts' ELSE 'no_direct_caller' END AS outcome FROM f LEFT JOIN n ON f.path = n.path)
    SELECT outcome, count(*) AS files, sum(CASE WHEN outcome = 'facts' THEN n ELSE 0 END)::BIGINT AS facts FROM o GROUP BY outcome""",
)
def caller_leaf_outcomes(spark, sf_dir):
    from seine.functions.scalars import source_role

    files = table(spark, sf_dir, "sites").where("path IS NOT NULL").select("path", source_role(F.col("path")).alias("role"), F.when(F.col("path").endswith(".go"), "supported").otherwise("unsupported").alias("lane")).distinct()
    found = C.leaf_outcomes(files, table(spark, sf_dir, "g34").where("path IS NOT NULL").select("path"))
    return found.groupBy("outcome").agg(F.count("*").alias("files"), F.sum("facts").alias("facts"))


@R.query(
    "candidate_policies",
    sql=f"""WITH f AS (SELECT DISTINCT path FROM sites WHERE path IS NOT NULL), p AS (SELECT path, unnest(list_filter([CASE WHEN ends_with(path, '.go') THEN 'grpc-caller' END, CASE WHEN ends_with(path, '.go') AND NOT list_contains(string_split(path, '/'), 'vendor') THEN 'kafka-producer' END, CASE WHEN ends_with(path, '.yaml') THEN 'manifest' END], lambda x: x IS NOT NULL)) AS plane FROM f)
    SELECT plane, count(*) AS planned, count_if(starts_with(path, 'src/'))::BIGINT AS required, count_if(NOT starts_with(path, 'src/'))::BIGINT AS supporting FROM p GROUP BY plane""",
)
def candidate_policies(spark, sf_dir):
    from seine.functions.scalars import has_segment

    path = F.col("path")
    files = table(spark, sf_dir, "sites").where("path IS NOT NULL").select("path").distinct()
    planes = C.candidate_planes(files, {"grpc-caller": path.endswith(".go"), "kafka-producer": path.endswith(".go") & ~has_segment(path, "vendor"), "manifest": path.endswith(".yaml")})
    return C.plane_totals(planes, path.startswith("src/"))


@R.query("domain_protocols", sql="SELECT domain, CASE WHEN domain LIKE 'grpc%' OR domain LIKE '%proto-%' OR domain LIKE 'proto%' THEN 'grpc' WHEN domain LIKE '%thrift%' THEN 'thrift' END AS protocol, count(*) AS runs FROM runs GROUP BY ALL")
def domain_protocols(spark, sf_dir):
    return table(spark, sf_dir, "runs").groupBy("domain", C.protocol_of(F.col("domain")).alias("protocol")).agg(F.count("*").alias("runs"))


_FACTS_SQL = """f AS (SELECT system AS repo, subject, object, CASE split WHEN 'train' THEN 'grpc-caller' ELSE 'grpc-consumer' END AS domain, CASE WHEN gate = 4 THEN 'UNRESOLVED_CALLER' WHEN tier = 'exact' THEN 'CALLS_OPERATION' ELSE 'REGISTERS_GRPC_SERVICE' END AS predicate, CASE WHEN source = 'nightly' THEN 'L' ELSE '' END AS lineage FROM g34 WHERE object IS NOT NULL AND subject IS NOT NULL),
op AS (SELECT min(object) AS o FROM g34 WHERE predicate = 'CALLER_REACHABLE_FROM_BINARY')"""


@R.query(
    "catalog_relationships",
    sql=f"""WITH {_FACTS_SQL} SELECT repo, domain, subject,
      CASE WHEN domain = 'grpc-consumer' AND predicate = 'REGISTERS_GRPC_SERVICE' THEN 'implementation' WHEN predicate = 'CALLS_OPERATION' THEN 'caller' ELSE 'unresolved_candidate' END AS kind,
      CASE WHEN domain = 'grpc-consumer' AND predicate = 'REGISTERS_GRPC_SERVICE' THEN CASE WHEN lineage = 'L' THEN 'resolved_implementation' ELSE 'matching_registration_evidence' END WHEN predicate = 'CALLS_OPERATION' AND domain = 'grpc-caller' THEN 'resolved_caller' WHEN predicate = 'CALLS_OPERATION' THEN 'unresolved_name_match' ELSE 'extractor_abstention' END AS classification
    FROM f, op WHERE object = op.o AND ((domain = 'grpc-caller' AND predicate = 'CALLS_OPERATION' AND lineage = 'L') OR (domain = 'grpc-consumer' AND predicate = 'CALLS_OPERATION') OR predicate = 'UNRESOLVED_CALLER' OR (domain = 'grpc-consumer' AND predicate = 'REGISTERS_GRPC_SERVICE'))""",
)
def catalog_relationships(spark, sf_dir):
    g = table(spark, sf_dir, "g34")
    picked = g.where("predicate = 'CALLER_REACHABLE_FROM_BINARY'").agg(F.min("object")).first()[0] or ""
    facts = g.where("object IS NOT NULL AND subject IS NOT NULL").select(
        F.col("system").alias("repo"), "subject", "object", F.when(F.col("split") == "train", "grpc-caller").otherwise("grpc-consumer").alias("domain"),
        F.when(F.col("gate") == 4, "UNRESOLVED_CALLER").when(F.col("tier") == "exact", "CALLS_OPERATION").otherwise("REGISTERS_GRPC_SERVICE").alias("predicate"), F.when(F.col("source") == "nightly", "L").otherwise("").alias("lineage"),
    )
    return C.operation_relationships(picked, picked, "L", facts).select("repo", "domain", "subject", "kind", "classification")


@R.query(
    "catalog_page",
    sql="""WITH o AS (SELECT DISTINCT 'grpc' AS protocol, system AS repo, split_part(object[2:], '/', 1) AS service, object AS operation FROM g34 WHERE predicate = 'CALLER_REACHABLE_FROM_BINARY' AND object LIKE '/%/%'), b AS (SELECT * FROM o ORDER BY protocol, repo, service, operation LIMIT 5001)
    SELECT protocol, repo, service, operation, CASE WHEN (SELECT count(*) FROM b) > 5000 THEN 'scan_budget' WHEN (SELECT count(*) FROM b) > 50 THEN 'page_limit' END AS truncation FROM b ORDER BY protocol, repo, service, operation LIMIT 50""",
)
def catalog_page(spark, sf_dir):
    g = table(spark, sf_dir, "g34").where("predicate = 'CALLER_REACHABLE_FROM_BINARY' AND object LIKE '/%/%'")
    rows = g.select(F.lit("grpc").alias("protocol"), F.col("system").alias("repo"), F.expr("substring_index(substring(object, 2), '/', 1)").alias("service"), F.col("object").alias("operation")).distinct()
    return C.catalog_page(rows, 50, 5_000)


@R.query(
    "field_reference_join",
    sql="""WITH w AS (SELECT DISTINCT object AS field_id FROM g34 WHERE predicate = 'REFERENCES_PROTO_FIELD' AND split = 'dev' AND object IS NOT NULL), s AS (SELECT site_id, min(path) AS path FROM sites WHERE path IS NOT NULL GROUP BY site_id)
    SELECT g.object AS field_id, count(*) AS refs, count_if(s.path IS NOT NULL)::BIGINT AS complete FROM g34 g JOIN w ON g.object = w.field_id LEFT JOIN s ON s.site_id = g.site_id WHERE g.split = 'train' AND g.site_id IS NOT NULL GROUP BY g.object""",
)
def field_reference_join(spark, sf_dir):
    g = table(spark, sf_dir, "g34")
    wanted = g.where("predicate = 'REFERENCES_PROTO_FIELD' AND split = 'dev' AND object IS NOT NULL").select(F.col("object").alias("field_id")).distinct()
    assertions = g.where("split = 'train' AND site_id IS NOT NULL").select(F.col("row_id").alias("assertion_id"), "object", F.array("site_id").alias("supporting"))
    known = table(spark, sf_dir, "sites").where("path IS NOT NULL").groupBy(F.col("site_id").alias("atom_id")).agg(F.min("path").alias("path"), F.min("line").alias("line"))
    return C.field_references(wanted, assertions, known).groupBy("field_id").agg(F.count("*").alias("refs"), F.count_if("complete").alias("complete"))


@R.query(
    "generated_binding",
    sql="""WITH o AS (SELECT method AS symbol, path, line FROM sites WHERE method IS NOT NULL AND path IS NOT NULL AND line IS NOT NULL), a AS (SELECT DISTINCT method AS symbol, system AS g, method AS m FROM sites WHERE method IS NOT NULL),
    one AS (SELECT symbol, min(g) AS g, min(m) AS m FROM a GROUP BY symbol HAVING count(DISTINCT (g, m)) = 1), d AS (SELECT system AS g, split_part(object, '/', 3) AS m, object FROM g34 WHERE object LIKE '/%/%'),
    dd AS (SELECT g, m, min(object) AS object FROM d GROUP BY ALL HAVING count(DISTINCT object) = 1), b AS (SELECT one.symbol, dd.object FROM one JOIN dd ON one.g = dd.g AND one.m = dd.m)
    SELECT CASE WHEN b.object IS NULL THEN 'unresolved' ELSE 'exact' END AS tier, count(*) AS uses FROM o LEFT JOIN b ON o.symbol = b.symbol GROUP BY 1""",
)
def generated_binding(spark, sf_dir):
    s = table(spark, sf_dir, "sites").where("method IS NOT NULL")
    uses = s.where("path IS NOT NULL AND line IS NOT NULL").select(F.col("method").alias("symbol"), "path", "line")
    anchors = s.select(F.col("method").alias("symbol"), F.col("system").alias("generated_path"), F.col("method").alias("member")).distinct()
    origin = s.select(F.col("system").alias("generated_path"), F.col("system").alias("declaration_path")).distinct()
    declared = table(spark, sf_dir, "g34").where("object LIKE '/%/%'").select(F.col("system").alias("declaration_path"), F.split("object", "/")[2].alias("member"), "object")
    return C.bind_generated(uses, anchors, origin, declared).groupBy("tier").agg(F.count("*").alias("uses"))


@R.query(
    "unit_attribution",
    sql="""WITH u AS (SELECT DISTINCT regexp_extract(path, '^[^/]+/[^/]+') AS p, system AS unit FROM sites WHERE wave < 3 AND regexp_matches(path, '^[^/]+/[^/]+') UNION SELECT DISTINCT split_part(path, '/', 1), 'top' FROM sites WHERE wave < 3 AND path LIKE 'src/%'),
    s AS (SELECT DISTINCT path FROM sites WHERE path IS NOT NULL), h AS (SELECT s.path, u.unit, length(u.p) AS len FROM s JOIN u ON s.path = u.p OR starts_with(s.path, u.p || '/')), b AS (SELECT path, max(len) AS len FROM h GROUP BY path),
    f AS (SELECT h.path, count(DISTINCT unit) AS n FROM h JOIN b ON h.path = b.path AND h.len = b.len GROUP BY h.path)
    SELECT CASE WHEN f.n IS NULL THEN 'unattributed' WHEN f.n = 1 THEN 'resolved' ELSE 'ambiguous' END AS attribution, count(*) AS n FROM s LEFT JOIN f ON s.path = f.path GROUP BY 1""",
)
def unit_attribution(spark, sf_dir):
    s = table(spark, sf_dir, "sites").where("path IS NOT NULL")
    early = s.where("wave < 3")
    units = early.select(F.regexp_extract("path", r"^[^/]+/[^/]+", 0).alias("path"), F.col("system").alias("unit")).where("path <> ''").unionByName(early.where("path LIKE 'src/%'").select(F.substring_index("path", "/", 1).alias("path"), F.lit("top").alias("unit"))).distinct()
    sites = s.select(F.col("path").alias("site_id"), "path").distinct()
    return C.attribute_units(sites, units).groupBy("attribution").agg(F.count("*").alias("n"))


@R.query("first_source_wins", sql="SELECT object, min_by(path, (row_id, path)) AS path FROM g34 WHERE object IS NOT NULL AND path IS NOT NULL GROUP BY object")
def first_source_wins(spark, sf_dir):
    return C.first_source_wins(table(spark, sf_dir, "g34").where("object IS NOT NULL AND path IS NOT NULL"), "object", "path", "row_id")


@R.query("version_fence", sql="""SELECT r.run_id, r.repo FROM runs r JOIN repos p ON r.repo = p.name AND r."commit" = p.indexed_commit""")
def version_fence(spark, sf_dir):
    bound = table(spark, sf_dir, "repos").select(F.col("name").alias("repo"), F.col("indexed_commit").alias("commit"))
    return C.version_fence(table(spark, sf_dir, "runs"), bound).select("run_id", "repo")


@R.query(
    "checklist_suggestions",
    sql="""SELECT DISTINCT CASE WHEN tier = 'exact' THEN CASE WHEN source = 'nightly' THEN 'update_caller' ELSE 'notify_owner' END ELSE 'confirm_match' END AS kind, subject FROM g34 WHERE subject IS NOT NULL
    UNION SELECT DISTINCT CASE WHEN status = 'aborted' THEN 'close_gap_failed' ELSE 'close_gap_processing' END, repo || '/' || domain FROM runs WHERE status IN ('aborted', 'staged')""",
)
def checklist_suggestions(spark, sf_dir):
    g = table(spark, sf_dir, "g34").where("subject IS NOT NULL")
    impact = g.select(F.when(F.col("tier") == "exact", "resolved").otherwise("matching").alias("class"), F.coalesce(F.col("source") == "nightly", F.lit(False)).alias("owned"), "subject")
    state = F.when(F.col("status") == "aborted", "failed").when(F.col("status") == "staged", "processing").otherwise("covered")
    return C.suggestions(impact, table(spark, sf_dir, "runs").select("repo", "domain", state.alias("state")))


@R.query(
    "workbench_impact",
    sql="""SELECT 'callers' AS plane, system AS repo, path FROM g34 WHERE gate = 3 AND path IS NOT NULL UNION ALL SELECT 'fields', system, path FROM g34 WHERE gate = 4 AND path IS NOT NULL UNION ALL SELECT 'sites', system, path FROM sites WHERE deleted_at IS NOT NULL AND path IS NOT NULL""",
)
def workbench_impact(spark, sf_dir):
    g, s = table(spark, sf_dir, "g34").where("path IS NOT NULL"), table(spark, sf_dir, "sites").where("deleted_at IS NOT NULL AND path IS NOT NULL")
    named = lambda d: d.select(F.col("system").alias("repo"), "path")
    return C.workbench({"callers": named(g.where("gate = 3")), "fields": named(g.where("gate = 4")), "sites": named(s)}, ["repo", "path"])


@R.query("observation_histogram", sql="SELECT CASE WHEN outcome = 'succeeded' THEN 'observed' ELSE 'unsupported' END AS state, CASE WHEN outcome <> 'succeeded' THEN reason END AS reason, count(*) AS files FROM results GROUP BY ALL")
def observation_histogram(spark, sf_dir):
    r = table(spark, sf_dir, "results")
    ok = F.col("outcome") == "succeeded"
    return C.unsupported_histogram(r.select(F.when(ok, "observed").otherwise("unsupported").alias("state"), F.when(~ok, F.col("reason")).alias("reason")))


@R.query("root_coverage", sql="SELECT repo, count_if(outcome = 'succeeded' AND facts > 0)::BIGINT AS complete, count_if(outcome = 'succeeded' AND coalesce(facts, 0) = 0)::BIGINT AS empty, count_if(outcome = 'failed')::BIGINT AS failed, count(*) AS total FROM results GROUP BY repo")
def root_coverage(spark, sf_dir):
    ok, some = F.col("outcome") == "succeeded", F.coalesce(F.col("facts"), F.lit(0)) > 0
    return table(spark, sf_dir, "results").groupBy("repo").agg(F.count_if(ok & some).alias("complete"), F.count_if(ok & ~some).alias("empty"), F.count_if(F.col("outcome") == "failed").alias("failed"), F.count("*").alias("total"))


@R.query("permitted_repos", sql="SELECT DISTINCT c_nationkey AS identity, c_mktsegment AS repo FROM customer WHERE c_acctbal > 0")
def permitted_repos(spark, sf_dir):
    return table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_nationkey").alias("identity"), F.col("c_mktsegment").alias("repo")).distinct()


@R.query("dossier_seal", sql=f"WITH l AS (SELECT sha256(run_id) || ' ' || run_id AS line FROM runs) SELECT count(*) AS items, {summed_digest_sql('line')} AS manifest FROM l")
def dossier_seal(spark, sf_dir):
    return C.seal(table(spark, sf_dir, "runs").select("run_id", F.sha2("run_id", 256).alias("digest")), "run_id", "digest")


@R.query("dossier_verify", sql="SELECT count(*) AS items, count(*) AS items_now, true AS intact FROM runs")
def dossier_verify(spark, sf_dir):
    """A sealed dossier still holds what its seal says."""
    items = table(spark, sf_dir, "runs").select("run_id", F.sha2("run_id", 256).alias("digest"))
    return C.verify_seal(C.seal(items, "run_id", "digest"), items, "run_id", "digest")


@R.query("evidence_by_domain_union", sql="SELECT domain, repo, run_id FROM runs WHERE domain IN ('grpc-caller', 'thrift-caller') AND status = 'published'")
def evidence_by_domain_union(spark, sf_dir):
    """Evidence of two protocols side by side, kept apart by domain."""
    runs = table(spark, sf_dir, "runs").where("status = 'published'").select("domain", "repo", "run_id")
    return runs.where("domain = 'grpc-caller'").unionByName(runs.where("domain = 'thrift-caller'"))


@R.query("repo_scope_intersection", sql="SELECT name AS repo FROM repos WHERE is_public INTERSECT SELECT DISTINCT repo FROM runs WHERE status = 'published'")
def repo_scope_intersection(spark, sf_dir):
    public = table(spark, sf_dir, "repos").where("is_public").select(F.col("name").alias("repo"))
    return public.intersect(table(spark, sf_dir, "runs").where("status = 'published'").select("repo"))


@R.query("complement_proof", sql="SELECT DISTINCT repo FROM documents WHERE repo NOT IN (SELECT name FROM repos)")
def complement_proof(spark, sf_dir):
    """Files of unknown repositories; empty if every file belongs to a known one."""
    known = table(spark, sf_dir, "repos").select(F.col("name").alias("repo"))
    return table(spark, sf_dir, "documents").where("repo IS NOT NULL").select("repo").distinct().join(known, "repo", "left_anti")


@R.query("prefix_overlap", sql="WITH p AS (SELECT DISTINCT path FROM documents WHERE path IS NOT NULL UNION SELECT DISTINCT regexp_extract(path, '^[^/]+/[^/]+') FROM documents WHERE regexp_matches(path, '^[^/]+/[^/]+/')) SELECT DISTINCT b.path FROM p a JOIN p b ON starts_with(b.path, a.path || '/')")
def prefix_overlap(spark, sf_dir):
    """Paths nested under another path of the same list."""
    from seine.functions.scalars import ancestors

    d = table(spark, sf_dir, "documents").where("path IS NOT NULL")
    p = d.select("path").unionByName(d.where(F.col("path").rlike("^[^/]+/[^/]+/")).select(F.regexp_extract("path", r"^[^/]+/[^/]+", 0).alias("path"))).distinct()
    above = p.select("path", F.explode(ancestors(F.col("path"))).alias("above")).where("above <> path")
    return above.join(p.select(F.col("path").alias("above")), "above", "left_semi").select("path").distinct()


@R.query("rows_state_by_system", sql="SELECT system, CASE WHEN count_if(tier = 'exact' AND split = 'holdout') > 0 THEN 'nonempty' WHEN bool_or(coalesce(path IS NULL, false)) THEN 'gap' ELSE 'empty' END AS rows_state FROM g34 GROUP BY system")
def rows_state_by_system(spark, sf_dir):
    g = table(spark, sf_dir, "g34")
    return coverage.rows_state(g, ["system"], (F.col("tier") == "exact") & (F.col("split") == "holdout"), F.col("path").isNull())
