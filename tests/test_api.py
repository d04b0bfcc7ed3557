from datetime import datetime

import pytest
from pyspark.sql import functions as F

from seine.operators import callers as C
from seine.plans.api import InvalidRequest, Snapshot

T = datetime(2025, 1, 1)


@pytest.fixture(scope="module")
def snapshot(spark):
    repos = spark.createDataFrame([("r1", "c1", False, False, True), ("r2", "c2", True, False, False)], "name string, indexed_commit string, is_fork boolean, is_archived boolean, is_public boolean")
    runs = spark.createDataFrame(
        [("u1", "r1", "c1", "grpc-caller", "published", T, T), ("u2", "r2", "old", "grpc-consumer", "published", T, T), ("u3", "r1", "c1", "grpc-consumer", "staged", T, None), ("u4", "r1", "c1", "kafka-producer", "published", T, T), ("u5", "r1", "c1", "proto-contract", "published", T, T), ("u6", "r1", "c1", "scip-proto-field", "published", T, T)],
        "run_id string, repo string, commit string, domain string, status string, started_at timestamp, published_at timestamp",
    )
    a = [
        ("a1", "u1", "r1", "grpc-caller", "CALLS_OPERATION", "x.go:1-2", "/S/m", "L", "exact", ["t1"]), ("a2", "u2", "r2", "grpc-consumer", "CALLS_OPERATION", "y.go:3-3", "/S/m", "", "derived", ["t2"]),
        ("a3", "u3", "r1", "grpc-consumer", "CALLS_OPERATION", "hidden", "/S/m", "", "derived", ["t3"]), ("a4", "u1", "r1", "grpc-caller", "UNRESOLVED_CALLER", "z.go:9-9", "/S/m", None, "unresolved", []),
        ("a5", "u4", "r1", "kafka-producer", "PRODUCES", "p.go:1-1", "orders", "", "derived", ["t1"]), ("a6", "u5", "r1", "proto-contract", "DECLARES_OPERATION", "S", "/S/m", "L", "exact", ["t1"]),
        ("a7", "u4", "r1", "kafka-producer", "UNRESOLVED_TOPIC", "p.go:2-2", "call-expr", "", "unresolved", ["t1", "t2"]), ("a8", "u6", "r1", "scip-proto-field", "REFERENCES_PROTO_FIELD", "x.go:1-1", "M#3", "L", "exact", ["t1"]),
    ]
    assertions = spark.createDataFrame(a, "assertion_id string, run_id string, repo string, domain string, predicate string, subject string, object string, lineage string, tier string, supporting array<string>")
    occurrences = spark.createDataFrame([("u1", "t1", "x.go", 1, 2, "r1"), ("u2", "t2", "y.go", 3, 3, "r2"), ("u6", "t1", "x.go", 1, 1, "r1")], "run_id string, atom_id string, path string, start_line int, end_line int, repo string")
    permissions = spark.createDataFrame([("r1", "Host:Ann"), ("r2", "host:bob")], "repo string, identity string")
    files = spark.createDataFrame([("r1", "x.go", "go", "call m"), ("r2", "y.go", "go", "call m m")], "repo string, path string, language string, content string")
    return lambda identity=None: Snapshot({"repos": repos, "runs": runs, "assertions": assertions, "occurrences": occurrences, "permissions": permissions, "files": files}, identity)


def test_permission_comes_first(snapshot):
    assert {r["repo"] for r in snapshot().search("call").collect()} == {"r1", "r2"}
    assert {r["repo"] for r in snapshot("host:ann").search("call").collect()} == {"r1"}
    assert snapshot("host:nobody").search("call").count() == 0
    assert {r["assertion_id"] for r in snapshot("host:ann").find_operation_consumers("/S/m").collect()} == {"a1", "a4"}


def test_impact_report(snapshot):
    report = snapshot().impact_report("/S/m")
    ids = {k: {r["assertion_id"] for r in v.collect()} for k, v in report.items() if k != "coverage"}
    assert ids == {"resolved": {"a1"}, "matching": {"a2"}, "abstentions": {"a4"}}
    states = {(r["repo"], r["domain"]): r["state"] for r in report["coverage"].collect()}
    assert states[("r1", "grpc-caller")] == "covered" and states[("r2", "grpc-consumer")] == "stale" and states[("r1", "grpc-consumer")] == "processing" and states[("r2", "grpc-caller")] == "unsupported"
    for bad in ("S/m", "/S", "/S/m/", "/S/m/x"):
        with pytest.raises(InvalidRequest):
            snapshot().find_operation_consumers(bad)
    with pytest.raises(InvalidRequest):
        snapshot().coverage(["no-such"])


def test_topics_fields_and_catalog(snapshot):
    s = snapshot()
    assert [r["assertion_id"] for r in s.find_topic_usage("orders").collect()] == ["a5"]
    census = {(r["domain"], r["class"]): r["n"] for r in s.topic_census(["call-expr", "selector-expr"]).collect()}
    assert census == {("kafka-producer", "call-expr"): 2, ("kafka-producer", "selector-expr"): 0, ("kafka-consumer", "call-expr"): 0, ("kafka-consumer", "selector-expr"): 0}
    assert [r["path"] for r in s.find_field_references("L", "M", 3).collect()] == ["x.go"]
    assert [tuple(r) for r in s.atlas().select("protocol", "repo", "operation", "truncation").collect()] == [("grpc", "r1", "/S/m", None)]
    rows = {(r["kind"], r["classification"], r["reason"]) for r in s.operation("/S/m", "L").collect()}
    assert rows == {("caller", "resolved_caller", None), ("caller", "unresolved_name_match", "DECLARATION_LINEAGE_UNPROVEN"), ("unresolved_candidate", "extractor_abstention", "OPERATION_DECLARATION_UNRESOLVED")}
    assert [r["caller_id"] for r in s.callers("/S/m", path_prefix="x.go").collect()] == ["a1"]
    assert {r["class"] for r in s.compare_callers("/S/m", "/S/other").collect()} == {"old_only_evidence"}


def test_compatibility_of_texts(spark, snapshot):
    old = spark.createDataFrame([("a.proto", 'package p; message M { string a = 1; int32 b = 2; } message Gone { bool x = 1; }')], "path string, content string")
    new = spark.createDataFrame([("a.proto", 'package p; message M { string a = 1; int64 b = 2; string c = 3; }')], "path string, content string")
    rows = [(r["message"], r["number"], r["rule"]) for r in snapshot().check_compatibility(old, new).collect()]
    assert rows == [("p.Gone", 1, "MESSAGE_REMOVED"), ("p.M", 2, "FIELD_TYPE_CHANGED")]


def test_bindings_abstain_unless_single(spark):
    o = spark.createDataFrame([("s1", "u.go", 1), ("s2", "u.go", 2), ("s3", "u.go", 3)], "symbol string, path string, line int")
    a = spark.createDataFrame([("s1", "g.go", "F"), ("s2", "g.go", "F"), ("s2", "g.go", "G"), ("s3", "h.go", "F")], "symbol string, generated_path string, member string")
    g = spark.createDataFrame([("g.go", "x.proto"), ("h.go", "x.proto"), ("h.go", "y.proto")], "generated_path string, declaration_path string")
    d = spark.createDataFrame([("x.proto", "F", "M#1")], "declaration_path string, member string, object string")
    bound = C.bind_generated(o, a, g, d)
    assert {(r["symbol"], r["object"], r["tier"]) for r in bound.collect()} == {("s1", "M#1", "exact"), ("s2", None, "unresolved"), ("s3", None, "unresolved")}
    assert C.reference_facts(bound, "REFERENCES_PROTO_FIELD").first()["subject"] == "u.go:1-1"


def test_units_leaves_and_records(spark):
    sites = spark.createDataFrame([("1", "a/b/c.go"), ("2", "a/x.go"), ("3", "z.go")], "site_id string, path string")
    units = spark.createDataFrame([("a", "ua"), ("a/b", "ub"), ("a/b", "uc")], "path string, unit string")
    assert {(r["site_id"], tuple(r["units"]), r["attribution"]) for r in C.attribute_units(sites, units).collect()} == {("1", ("ub", "uc"), "ambiguous"), ("2", ("ua",), "resolved"), ("3", (), "unattributed")}
    f = spark.createDataFrame([("t", "test", "supported"), ("o", "production", "oversized"), ("n", "production", "supported"), ("f", "production", "supported")], "path string, role string, lane string")
    facts = spark.createDataFrame([("f",), ("f",), ("t",)], "path string")
    assert {(r["path"], r["outcome"], r["facts"]) for r in C.leaf_outcomes(f, facts).collect()} == {("t", "excluded_test", 0), ("o", "abstained_oversized", 0), ("n", "no_direct_caller", 0), ("f", "facts", 2)}
    records = spark.createDataFrame([("1", "CALLS_OPERATION", None, "exact", "production", "p:1-2"), ("2", "UNRESOLVED_CALLER", None, "unresolved", "odd", "p:3-3"), ("3", "CALLS_OPERATION", "/S/m", "exact", "test", "p:1-4")], "caller_id string, predicate string, operation string, tier string, code_role string, subject string")
    assert {tuple(r) for r in C.contract_problems(records).collect()} == {("1", "resolved_without_target"), ("2", "unknown_role"), ("2", "bad_span")}
    callers = spark.createDataFrame([("1", "a/b", [("u", "o")])], "caller_id string, path string, units array<struct<unit string, owner string>>")
    assert C.filter_callers(callers, "a", unit="u", owner="o").count() == 1 and C.filter_callers(callers, "a", unit="u", owner="x").count() == 0
    assert [r["v"] for r in C.first_source_wins(spark.createDataFrame([("k", "b", 2), ("k", "a", 1)], "k string, v string, s int"), "k", "v", "s").collect()] == ["a"]
    references = spark.createDataFrame([(2, "p", "e"), (1, "q", "e")], "position int, projection_digest string, evidence_digest string")
    p = spark.createDataFrame([("p", "x")], "projection_digest string, kind string")
    e = spark.createDataFrame([("e", "path")], "evidence_digest string, path string")
    assert [(r["position"], r["kind"], r["path"]) for r in C.hydrate(references, p, e).collect()] == [(1, None, "path"), (2, "x", "path")]
    page = C.catalog_page(spark.createDataFrame([("g", "r", "s", f"o{i}") for i in range(9)], "protocol string, repo string, service string, operation string"), 3, 5)
    assert page.count() == 3 and page.first()["truncation"] == "scan_budget"


@pytest.fixture(scope="module")
def wide(spark, snapshot):
    """A snapshot with every table the verbs know."""
    s = snapshot()
    memberships = spark.createDataFrame([("r1", "x.go", "svc", "primary"), ("r2", "y.go", "other", "primary")], "repo string, path string, service_key string, role string")
    edges = spark.createDataFrame([("e1", "r1", "x.go", "x.go", "rpc", "c1", 1, 2), ("e2", "r2", "y.go", "y.go", "kafka", "c2", 1, 1)], "edge_id string, repo string, source_path string, target_path string, kind string, commit string, start_line int, end_line int")
    tree = spark.createDataFrame([("r1", "c1", "x.go", b"one\ntwo\nthree"), ("r1", "c1", "d/z.go", b"\xff")], "repo string, commit string, path string, content binary")
    places = spark.createDataFrame([("r1", "c1", "x.go", 1, 0, 1, 3, "S", 1, None), ("r1", "c1", "d/z.go", 5, 2, 5, 5, "S", 8, "own words"), ("r2", "c2", "y.go", 1, 0, 1, 3, "S", 8, None)], "repo string, commit string, path string, start_line int, start_col int, end_line int, end_col int, symbol string, roles int, override_documentation string")
    hunk = "array<struct<old_start int, new_start int>>"
    extra = {
        "memberships": memberships, "edges": edges, "tree": tree, "symbol_occurrences": places, "symbols": spark.createDataFrame([("S", "words")], "symbol string, documentation string"),
        "symbol_relationships": spark.createDataFrame([], "symbol string, related string, is_definition boolean, is_reference boolean"), "units": spark.createDataFrame([("x.go", "u"), ("y.go", "u")], "path string, unit string"),
        "service_states": spark.createDataFrame([("svc", "current"), ("other", "stale")], "service_key string, status string"),
        "log": spark.createDataFrame([("r1", 0, "c1", ["c0"], "second", [("x.go", 1, None)]), ("r1", 1, "c0", [], "first", [])], "repo string, position int, commit string, parents array<string>, subject string, changes array<struct<path string, added int, removed int>>"),
        "diffs": spark.createDataFrame([("r1", "c1", None, "x.go", [(1, 1)]), ("r1", "c1", "a", "b", [])], f"repo string, commit string, old_path string, path string, hunks {hunk}"),
        "reports": spark.createDataFrame([("one", "r1", "row"), ("two", "r1", "row"), ("two", "r2", "hidden")], "report_id string, repo string, body string"),
        "usage": spark.createDataFrame([(T, 10, "search"), (T, 20, "search")], "ts timestamp, duration_ms int, name string"), "audit": spark.createDataFrame([(1, T), (2, T)], "event_id int, created_at timestamp"),
        "pins": spark.createDataFrame([("u9",)], "run_id string"), "observations": spark.createDataFrame([("r1", "observed"), ("r1", "pending")], "repo string, state string"),
        "consumer_observations": spark.createDataFrame([("k", 1), ("k", 3)], "consumer string, sequence int"), "consumer_snapshots": spark.createDataFrame([(1, True), (2, True), (3, True)], "sequence int, comparable boolean"),
        "dispositions": spark.createDataFrame([("update_caller:x.go:1-2", 1, "done"), ("gone:x", 1, "done")], "suggestion string, sequence int, disposition string"),
        "jobs": spark.createDataFrame([("r1", "j1", "done", T)], "repo string, job_id string, status string, created_at timestamp"),
    }
    return lambda identity=None: Snapshot({**s.tables, **extra}, identity)


def test_navigation_and_history(wide):
    s = wide()
    assert [tuple(r)[:2] for r in s.find_definitions("r1", "c1", "d/z.go", 5, 3).collect()] == [("x.go", 1)]
    assert {r["path"] for r in s.find_references("r1", "c1", "x.go", 1, 0).collect()} == {"x.go", "d/z.go"}
    assert s.find_references("r1", "c1", "x.go", 1, 3).count() == 0
    assert s.hover("r1", "c1", "x.go", 1, 0).collect() == [("S", "own words")]
    assert [r["subject"] for r in s.commits("r1", 0, 1).collect()] == ["second"]
    assert s.commit("r1", "c1").select("files", "added", "removed").collect() == [(1, 1, 0)]
    assert s.diff("r1", "c1").count() == 2 and [r["path"] for r in s.diff("r1", "c1", "a").collect()] == ["b"]
    assert [r["path"] for r in s.tree("r1", "c1").collect()] == ["d/z.go", "x.go"]
    assert s.repo_status().select("name", "job_status").collect() == [("r1", "done"), ("r2", None)]
    assert wide("host:bob").find_references("r1", "c1", "x.go", 1, 0).count() == 0


def test_reports(spark, wide):
    s = wide()
    assert {r["assertion_id"] for r in s.field_impact_report("L", "M", 3)["resolved"].collect()} == {"a8"}
    old = spark.createDataFrame([("a.proto", "message M { string a = 3; }")], "path string, content string")
    new = spark.createDataFrame([("a.proto", "message M { int32 a = 3; }")], "path string, content string")
    report = s.change_impact_report(old, new, "L")
    assert [r["rule"] for r in report["violations"].collect()] == ["FIELD_TYPE_CHANGED"] and {r["assertion_id"] for r in report["resolved"].collect()} == {"a8"}
    thrift = [spark.createDataFrame([("a.thrift", t)], "path string, content string") for t in ("struct M { 1: i32 a }", "struct M { 1: i64 a, string b }")]
    assert [r["rule"] for r in s.check_compatibility(*thrift, "thrift").collect()] == ["UNREADABLE", "FIELD_TYPE_CHANGED"]
    with pytest.raises(InvalidRequest):
        s.check_compatibility(old, new, "xml")
    assert s.stored_report("two").count() == 2 and wide("host:ann").stored_report("two").count() == 0 and wide("host:ann").stored_report("one").count() == 1
    page = s.evidence_page(2).collect()
    assert len(page) == 2 and page[0]["has_more"] and s.evidence_page(50, predicate="PRODUCES").count() == 1


def test_citations_services_and_relationships(wide):
    s = wide()
    assert [r["cited"] for r in s.caller_citation("a1").collect()] == ["one\ntwo"]
    assert [r["cited"] for r in s.relationship_citation("e1").collect()] == ["one\ntwo"]
    assert s.service("svc").select("status", "n_dependencies", "n_callers", "n_topics").collect() == [("current", 1, 1, 0)]
    assert [r["edge_id"] for r in s.relationship_snapshot("svc").collect()] == ["e1"]
    other = wide()
    other.tables["edges"] = other.tables["edges"].where("edge_id <> 'e1'")
    assert [r["change"] for r in s.compare_relationships(other, "svc").collect()] == ["removed"]
    by_unit = {r["key"]: r["class"] for r in s.compare_callers("/S/m", "/S/m", "unit").collect()}
    assert set(by_unit.values()) == {"both_evidence"} and all(k.startswith("unit|") for k in by_unit)


def test_operation_and_work(wide):
    s = wide()
    usage = s.usage("2025-01-01", "2025-01-02")
    assert usage["summary"].collect() == [(2, 15)] and usage["daily"].collect() == [("2025-01-01", 2), ("2025-01-02", 0)] and usage["top"].collect() == [("search", 2)]
    assert [r["event_id"] for r in s.audit(1).collect()] == [1]
    assert s.retention_status("2026-01-01", 30).where("expired > 0").count() == 0
    assert {r["repo"]: r["failed_since"] for r in s.lifecycle_status().collect()} == {"r1": 0, "r2": 0}
    assert s.observation_progress().collect() == [("r1", 1, 0, 1, 2)]
    assert s.consumer_ledger().select("first_seen", "last_seen", "reintroduced", "active").collect() == [(1, 3, 1, True)]
    bench = {(r["assertion_id"], r["owned"]) for r in s.workbench("/S/m", "svc").collect()}
    assert bench == {("a1", True), ("a2", False), ("a4", False)}
    listed = {(r["suggestion"], r["state"], r["disposition"]) for r in s.checklist("/S/m", "svc").collect()}
    assert ("update_caller:x.go:1-2", "current", "done") in listed and ("gone:x", "stale", "done") in listed and ("confirm_match:y.go:3-3", "current", "open") in listed
    consumers = s.published_assertions().select("subject").withColumnRenamed("subject", "consumer")
    queues = {(r["queue"], r["item"]) for r in s.review(consumers.limit(0), consumers.where("consumer = 'x.go:1-2'")).collect()}
    assert {("new_consumers", "x.go:1-2"), ("unresolved_attribution", "z.go:9-9"), ("coverage_regression", "r2/grpc-consumer")} <= queues
