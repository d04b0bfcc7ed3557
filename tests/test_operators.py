"""Fixtures for what SQL cannot express: scanners, sources, queues, streams, generations, pages."""

import subprocess
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from seine.functions import scalars as S
from seine.operators import change, codenav, contracts, gosource, paging, postings, services
from seine.sources import files, git, rest, scip
from seine.streaming import queue, streams

PROTO = """syntax = "proto3";
package a.b; // c
message M {
  string x = 1; /* y */
  repeated int64 ys = 2;
  map<string, N> z = 3;
  oneof pick { bool p = 4; N q = 5; }
  message N { optional bytes raw = 0x10; reserved 3; enum E { A = 0; } }
  weird;
}
service Svc {
  option deprecated = true;
  rpc Get(M) returns (stream a.b.M.N) { option x = 1; }
  rpc Put (M) returns (M);
}
"""


def test_proto_facts():
    facts = list(contracts.proto_facts(PROTO))
    fields = {(f[2], f[3], f[5], f[6], f[7]) for f in facts if f[0] == "DECLARES_FIELD"}
    assert fields == {
        ("a.b.M#1", "x", "string", "", 4), ("a.b.M#2", "ys", "int64", "repeated", 5), ("a.b.M#3", "z", "map<string,N>", "repeated", 6),
        ("a.b.M#4", "p", "bool", "", 7), ("a.b.M#5", "q", "N", "", 7), ("a.b.M.N#16", "raw", "bytes", "optional", 8),
    }
    assert {(f[2], f[5], f[6]) for f in facts if f[0] == "DECLARES_OPERATION"} == {("/a.b.Svc/Get", "M->a.b.M.N", "stream"), ("/a.b.Svc/Put", "M->M", "")}
    assert [f[1] for f in facts if f[0] == "GAP"] == ["a.b.M"]


def test_thrift_facts():
    text = "namespace go x.y\n// struct No {}\nstruct P { 1: required string a, 2: optional list<i64> b }\ntypedef i64 Id\nservice Q {\n  void ping(),\n  P get(1: Id id) throws (1: E e)\n}\n"
    facts = list(contracts.thrift_facts(text))
    assert {(f[0], f[2]) for f in facts} >= {("DECLARES_MESSAGE", "x.y.P"), ("DECLARES_FIELD", "x.y.P#2"), ("DECLARES_ALIAS", "i64"), ("DECLARES_SERVICE", "x.y.Q"), ("DECLARES_OPERATION", "/x.y.Q/get"), ("DECLARES_OPERATION", "/x.y.Q/ping"), ("DECLARES_FIELD", "x.y.Q_get_args#1")}


def test_facts_are_read_once_per_content(spark):
    rows = [(1, PROTO), (2, PROTO), (3, None), (4, ""), (5, "message {")]
    facts = contracts.extract_facts(spark.createDataFrame(rows, "id int, text string"), "id", "text", "proto")
    per = {r["key"]: r["count"] for r in facts.groupBy("key").count().collect()}
    assert per[1] == per[2] > 5 and 3 not in per and 4 not in per


GO = """package p
import (
  "github.com/IBM/sarama"
  kf "github.com/segmentio/kafka-go"
)
const topicA = "orders"
func (s *Server) Send() {
  m := &sarama.ProducerMessage{Topic: topicA, Value: v("x, y")}
  // sarama.ProducerMessage{Topic: "no"}
  w := kf.Writer{Topic: "bad topic"}
  r := kf.NewReader(kf.ReaderConfig{GroupTopics: []string{"g1", cfg.Topic}})
  g.Consume(ctx, []string{"c1"}, h)
  c.ConsumePartition(pick(), 0, 1)
  w.WriteMessages(ctx, kf.Message{Topic: other})
}
"""


def test_kafka_sites():
    got = [(p, t, r, lib, shape, tier) for p, t, r, lib, shape, tier, _ in gosource.kafka_sites(GO)]
    assert ("producer", "orders", None, "sarama", "ProducerMessage", "derived") in got
    assert ("producer", None, "invalid-topic-literal", "segmentio", "Writer", "unresolved") in got
    assert ("producer", None, "unresolved-ident", "segmentio", "Message", "unresolved") in got
    assert ("consumer", "g1", None, "segmentio", "ReaderConfig", "derived") in got
    assert ("consumer", None, "selector-expr", "segmentio", "ReaderConfig", "unresolved") in got
    assert ("consumer", "c1", None, "sarama", "Consume", "heuristic") in got
    assert ("consumer", None, "call-expr", "sarama", "ConsumePartition", "unresolved") in got
    assert len(got) == 7
    both = GO.replace('"github.com/IBM/sarama"', '"github.com/IBM/sarama"\n  s2 "github.com/Shopify/sarama"')
    assert {r for _, _, r, lib, *_ in gosource.kafka_sites(both) if lib == "sarama"} == {"ambiguous-library-import"}


def test_call_sites_and_stub_join(spark):
    stub = 'func (c *fooClient) Get(ctx int) { c.cc.Invoke(ctx, "/a.Foo/Get", in) }\nfunc (c *barClient) Get(ctx int) { c.cc.Invoke(ctx, "/a.Bar/Get", in) }\nfunc (c *fooClient) Put(ctx int) { c.cc.Invoke(ctx, "/a.Foo/Put", in) }\n'
    user = "func main() { x.Get(1)\n y.z.Put(2)\n q.Nope()\n RegisterFooServer(s, i) }\n"
    sites = gosource.scan_calls(spark.createDataFrame([(1, stub), (2, user)], "id int, text string"), "id", "text")
    facts = {(r["method"], r["predicate"], r["operation"]) for r in gosource.consumer_facts(sites).where("key = 2").collect()}
    assert facts == {("Get", "UNRESOLVED_CALL", None), ("Put", "CALLS_OPERATION", "/a.Foo/Put")}
    assert sites.where("key = 2 AND kind = 'registration'").select("method").collect() == [("Foo",)]
    typed = spark.createDataFrame([(2, 1)], "key int, line int")
    assert gosource.uncovered(sites.where("kind = 'call' AND key = 2"), typed).count() == 2


@pytest.fixture
def repo(tmp_path):
    def run(*args):
        subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=T", "-c", "user.email=t@example.org", *args], check=True, capture_output=True)

    run("init", "-q", "-b", "main")
    (tmp_path / "d").mkdir()
    (tmp_path / "d/a.txt").write_text("one\ntwo\n")
    (tmp_path / "bin").write_bytes(b"\xff\x00")
    (tmp_path / "d/link").symlink_to("../bin")
    (tmp_path / "gone").symlink_to("nowhere")
    run("add", "-A")
    run("commit", "-qm", "first")
    (tmp_path / "d/a.txt").write_text("one\nTWO\nthree\n")
    run("commit", "-qam", "second")
    return tmp_path


def test_git_sources(spark, repo):
    git.register(spark)
    tree = spark.read.format("git_tree").option("repos", f"r={repo}@HEAD,old={repo}@HEAD~1").load()
    assert tree.count() == 8
    head = tree.where("repo = 'r'")
    assert sorted(r["path"] for r in head.collect()) == ["bin", "d/a.txt", "d/link", "gone"]
    commit = head.first()["commit"]
    assert files.source(head, "r", commit, "bin").first()["encoding"] == "base64"
    assert files.source(head, "r", commit, "d/a.txt").first()["body"] == "one\nTWO\nthree\n"
    assert [tuple(r) for r in files.folder(head, "").collect()] == [("d", "dir"), ("bin", "file"), ("gone", "file")]
    assert {(r["path"], r["state"]) for r in files.symlinks(head).collect()} == {("d/link", "resolved"), ("gone", "missing")}
    log = spark.read.format("git_log").option("repos", f"r={repo}@HEAD").load()
    page = files.commit_page(log, 0, 1).first()
    assert page["subject"] == "second" and page["has_more"] and page["first_parent"] == log.where("position = 1").first()["commit"]
    totals = {r["commit"]: (r["files"], r["added"], r["removed"]) for r in files.change_totals(log).collect()}
    assert totals[commit] == (1, 2, 1)
    blame = spark.read.format("git_blame").option("repos", f"r={repo}@HEAD").option("path", "d/a.txt").load().orderBy("line").collect()
    assert [(b["line"], b["subject"], b["content"]) for b in blame] == [(1, "first", "one"), (2, "second", "TWO"), (3, "second", "three")]


def _field(n, value):
    def var(x):
        out = b""
        while True:
            out += bytes([x & 0x7F | (0x80 if x > 0x7F else 0)])
            x >>= 7
            if not x:
                return out

    return var(n << 3) + var(value) if isinstance(value, int) else var(n << 3 | 2) + var(len(value)) + value


def test_scip(spark, tmp_path):
    occurrence = _field(1, bytes([3, 1, 9])) + _field(2, b"sym a") + _field(3, 1)
    wide = _field(1, bytes([4, 0, 5, 2])) + _field(2, b"sym b") + _field(3, 8) + _field(4, b"own")
    symbol = _field(1, b"sym b") + _field(3, b"doc b") + _field(4, _field(1, b"sym a") + _field(2, 1))
    document = _field(1, b"p.go") + _field(2, occurrence) + _field(2, wide) + _field(3, symbol) + _field(4, b"Go")
    (tmp_path / "index.scip").write_bytes(_field(2, document))
    (tmp_path / "bad.scip").write_bytes(b"\x12\xff")
    rows = scip.read(spark, str(tmp_path))
    assert rows.where("error IS NOT NULL").count() == 1
    good = rows.where("error IS NULL")
    occurrences = scip.occurrences(good)
    assert {(r["symbol"], r["start_line"], r["end_line"], r["end_col"], r["roles"]) for r in occurrences.collect()} == {("sym a", 3, 3, 9, 1), ("sym b", 4, 5, 2, 8)}
    at = codenav.at_position(occurrences, "p.go", 4, 3)
    assert at.collect() == [("sym b",)]
    found = codenav.find_references(at, occurrences, scip.relationships(good))
    assert found.count() == 2
    assert codenav.hover(at, scip.symbol_information(good), occurrences).first()["documentation"] == "own"
    edge = scip.relationships(good)
    assert codenav.definitions(at, occurrences, edge).count() == 0


def test_paged_listing(spark):
    answers = {
        "https://h.example/r": ([{"n": "a"}], {"Link": '<https://h.example/r?page=2>; rel="next", <https://h.example/r?page=9>; rel="last"'}),
        "https://h.example/r?page=2": ([{"n": "b"}], {}),
    }
    df = rest.listing(spark, "https://h.example/r", answers.__getitem__, "name string", lambda x: (x["n"],))
    assert [r["name"] for r in df.collect()] == ["a", "b"]
    with pytest.raises(ValueError):
        rest.next_link("https://h.example/r", '<https://evil.example/r>; rel="next"')
    loop = {"https://h.example/r": ([], {"link": '</r>; rel="next"'})}
    with pytest.raises(ValueError):
        list(rest.pages("https://h.example/r", loop.__getitem__))


def test_generations(spark, tmp_path):
    from seine.io import Generations, append, bundle

    g = Generations(spark, str(tmp_path / "t"))
    assert g.current() is None
    with pytest.raises(FileNotFoundError):
        g.read()
    first = g.stage(spark.range(5).toDF("x"), sort_by=["x"])
    assert g.current() is None
    assert g.publish(first) is None and g.read().count() == 5 and g.verify()
    second = g.stage(spark.range(7).toDF("x"))
    with pytest.raises(RuntimeError):
        g.publish(second, expected="other")
    assert g.publish(second, expected=first) == first and g.read().count() == 7 and g.read(first).count() == 5
    assert g.archive(str(tmp_path / "copy")) == second and Generations(spark, str(tmp_path / "copy")).verify(second)
    assert g.sweep(set()) == [first] and g.read().count() == 7
    append(spark.createDataFrame([(datetime(2025, 1, 2),)], "at timestamp"), str(tmp_path / "e"), "at")
    assert spark.read.parquet(str(tmp_path / "e")).first()["day"].isoformat() == "2025-01-02"
    rows = spark.range(2).select(F.lit(1).alias("a"))
    assert bundle(rows, "proof").count() == 1


def test_cursors(spark):
    c = paging.Cursor(b"secret")
    token = c.encode("q", "g", ["a", 1])
    assert c.decode(token, "q", "g") == ["a", 1]
    for args in ((token, "other", "g"), (token, "q", "other"), (token[:-4] + "AAAA", "q", "g"), ("%", "q", "g")):
        with pytest.raises(ValueError):
            c.decode(*args)
    rows = spark.range(25).select((F.col("id") % 3).alias("a"), "id")
    seen, cursor = [], None
    while True:
        page = paging.page_with_more(rows, ["a", "id"], 7, cursor).orderBy("a", "id").collect()
        seen += [(r["a"], r["id"]) for r in page]
        if not page or not page[-1]["has_more"]:
            break
        cursor = [page[-1]["a"], page[-1]["id"]]
    assert seen == sorted((i % 3, i) for i in range(25))


def test_comparison_never_removes_when_not_comparable(spark):
    seen = spark.createDataFrame([("r", 1), ("r", 2), ("s", 1), ("s", 5)], "rel string, seq int")
    snaps = spark.createDataFrame([(1, True), (2, True), (3, False), (4, False), (5, False)], "seq int, comparable boolean")
    rows = {r["rel"]: r for r in change.ledger(seen, "rel", "seq", snaps).collect()}
    assert rows["r"]["active"] and rows["r"]["last_removed"] is None
    assert rows["s"]["last_removed"] == 2 and rows["s"]["reintroduced"] == 1 and rows["s"]["active"]
    closed = spark.createDataFrame([(i, True) for i in range(1, 6)], "seq int, comparable boolean")
    assert not {r["rel"]: r for r in change.ledger(seen, "rel", "seq", closed).collect()}["r"]["active"]


def test_queue_state(spark):
    now = datetime(2025, 1, 1)
    rows = [(1, "k", "a", "pending", 0, now, None, None, None, False), (2, "k", "b", "running", 3, now, None, now, "t2", False), (3, "k", "c", "claimed", 1, now, None, now, "t3", False)]
    jobs = spark.createDataFrame(rows, "id int, kind string, target string, status string, attempts int, created_at timestamp, not_before timestamp, heartbeat_at timestamp, lease_token string, force boolean")
    wanted = spark.createDataFrame([("k", "a", True), ("k", "z", False), ("k", "z", True)], "kind string, target string, force boolean")
    assert [tuple(r) for r in queue.enqueue(jobs, wanted).collect()] == [("k", "z", True)]
    assert queue.merge_force(jobs, wanted).where("id = 1").first()["force"]
    chosen = queue.claimable(jobs, "k", F.lit(now))
    claimed = {r["id"]: r for r in queue.claim(jobs, chosen, "T", F.lit(now)).collect()}
    assert (claimed[1]["status"], claimed[1]["lease_token"], claimed[1]["attempts"]) == ("claimed", "T", 1) and claimed[2]["status"] == "running"
    reaped = {r["id"]: r["status"] for r in queue.reap(jobs, F.lit(now + timedelta(hours=1)), 3).collect()}
    assert reaped == {1: "pending", 2: "failed", 3: "pending"}
    updates = spark.createDataFrame([(2, "t2", "done"), (3, "stolen", "done")], "id int, lease_token string, status string")
    assert {r["id"]: r["status"] for r in queue.transition(jobs, updates).collect()} == {1: "pending", 2: "done", 3: "claimed"}
    chunks = spark.createDataFrame([(1, 0, 0, "failing"), (2, 0, 3, "failing"), (3, 0, 0, "done")], "id int, priority int, attempt int, status string")
    assert sorted((r["id"], r["attempt"], r["status"]) for r in queue.retried(chunks, 3).collect()) == [(1, 0, "superseded"), (1, 1, "pending"), (2, 3, "failed"), (3, 0, "done")]
    assert [queue.capacity_state(f, 20, 10, 30, b) for f, b in ((5, False), (15, False), (25, False), (25, True), (35, True))] == ["blocked", "soft", "open", "blocked", "open"]


def _drive(spark, df, name, mode):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name).collect()


def test_silent_jobs_are_forgotten(spark, tmp_path):
    src = str(tmp_path / "timed")
    schema = "job_id bigint, seq int, to_status string, at timestamp"
    day = lambda n: datetime(2025, 1, 1) + timedelta(days=n)
    spark.createDataFrame([(1, 1, "claimed", day(0)), (2, 1, "claimed", day(0))], schema).coalesce(1).write.parquet(src)
    query = streams.job_states(spark.readStream.schema(schema).parquet(src), "at").writeStream.outputMode("update").format("memory").queryName("timed")
    q = query.start()
    q.processAllAvailable()
    for n, row in enumerate([(2, 2, "running", day(60)), (3, 1, "claimed", day(61))]):
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(src)
        q.processAllAvailable()
    spark.createDataFrame([(1, 3, "running", day(61))], schema).coalesce(1).write.mode("append").parquet(src)
    q.processAllAvailable()
    q.stop()
    # job 1 was silent too long: it begins anew, and may not run unclaimed
    assert [tuple(r) for r in spark.table("timed").where("job_id = 1").collect()] == [(1, "claimed", 1, 0), (1, "pending", 0, 1)]


def test_ledger_over_blocks_of_snapshots(spark, monkeypatch):
    import random

    rng = random.Random(2)
    snaps = [(i, rng.random() < 0.5) for i in range(40)]
    seen = [(r, i) for r in "abcde" for i in range(40) if rng.random() < 0.2]
    frames = spark.createDataFrame(seen, "rel string, seq int"), spark.createDataFrame(snaps, "seq int, comparable boolean")
    whole = sorted(map(tuple, change.ledger(frames[0], "rel", "seq", frames[1]).collect()))
    monkeypatch.setattr(change, "SNAPSHOT_BLOCK", 3)
    assert sorted(map(tuple, change.ledger(frames[0], "rel", "seq", frames[1]).collect())) == whole
    first = next((s for s, ok in snaps if ok and s > min(i for r, i in seen if r == "a")), None)
    assert first is not None


def test_streams(spark, tmp_path):
    t = datetime(2025, 1, 1)
    src = str(tmp_path / "polls")
    spark.createDataFrame([("a", "1", t), ("a", "1", t + timedelta(1)), ("a", "2", t + timedelta(2)), ("b", "9", t)], "repo string, fingerprint string, polled_at timestamp").coalesce(1).write.parquet(src)
    polls = spark.readStream.schema("repo string, fingerprint string, polled_at timestamp").parquet(src)
    assert sorted((r["repo"], r["fingerprint"]) for r in _drive(spark, streams.revision_changes(polls), "polls", "append")) == [("a", "1"), ("a", "2"), ("b", "9")]
    src = str(tmp_path / "jobs")
    spark.createDataFrame([(1, 1, "claimed"), (1, 2, "running"), (1, 3, "done"), (2, 1, "done"), (2, 2, "claimed")], "job_id bigint, seq int, to_status string").write.parquet(src)
    jobs = spark.readStream.schema("job_id bigint, seq int, to_status string").parquet(src)
    assert sorted(tuple(r) for r in _drive(spark, streams.job_states(jobs), "jobs", "update")) == [(1, "done", 1, 0), (2, "claimed", 1, 1)]
    src = str(tmp_path / "hooks")
    spark.createDataFrame([("d1", "r", "main", t), ("d1", "r", "main", t), ("d2", "r", "main", t)], "delivery_id string, repo string, ref string, received_at timestamp").write.parquet(src)
    hooks = spark.readStream.schema("delivery_id string, repo string, ref string, received_at timestamp").parquet(src)
    assert len(_drive(spark, streams.push_triggers(hooks), "hooks", "append")) == 2
    src = str(tmp_path / "usage")
    spark.createDataFrame([(t, "x"), (t + timedelta(hours=5), "x"), (t + timedelta(days=9), "x")], "ts timestamp, kind string").write.parquet(src)
    usage = spark.readStream.schema("ts timestamp, kind string").parquet(src)
    assert sorted(r["n"] for r in _drive(spark, streams.usage_by_day(usage, "ts", "kind"), "usage", "complete")) == [1, 2]


def test_catalog_rules(spark):
    s = spark.createDataFrame([("a", "accepted"), ("a", "accepted"), ("b", "odd"), ("c", "accepted")], "service_key string, disposition string")
    m = spark.createDataFrame([("a", "x", "primary"), ("a", "x/y", "typed"), ("z", "../q", "weird"), ("c", "w", "shared"), ("c", "w", "shared")], "service_key string, path string, role string")
    rules = {(r["rule"], r["item"]) for r in services.catalog_violations(s, m).collect()}
    assert rules == {
        ("duplicate_service", "a"), ("unknown_disposition", "b"), ("unknown_service", "z"), ("unknown_role", "z|../q|weird"), ("bad_path", "../q"), ("duplicate_membership", "c|w|shared"),
        ("accepted_without_primary", "c"), ("typed_without_supporting", "a"), ("nested_path", "a|x/y"),
    }


def test_expansion_stops_at_cycles_and_depth(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "d")], "parent string, child string")
    rows = {(r["node"], r["depth"], r["stop"]) for r in codenav.expand(edges, spark.createDataFrame([("a",)], "node string"), 3).collect()}
    assert rows == {("a", 0, None), ("b", 1, None), ("a", 2, "cycle"), ("c", 2, None), ("d", 3, "depth")}


def test_call_projection_classes(spark):
    calls = [(1, "m", "resolved", ["n"], ["n"]), (2, "m", "resolved", ["n"], None), (3, "m", "dynamic", ["n"], ["n"]), (4, "nope", "resolved", ["n"], None), (5, "k", "resolved", ["n", "o"], None), (6, "c", "resolved", ["n"], None), (7, "u", "other", ["n"], None), (8, "w", "resolved", ["n"], ["n"])]
    records = [("n", "m", "/S/m", "resolved"), ("n", "k", "/S/k", "resolved"), ("o", "k", "/T/k", "resolved"), ("n", "c", "/S/c", "conflict"), ("n", "u", "/S/u", "resolved"), ("n", "w", "/S/w", "unavailable"), ("n", "w", "/S/w2", "ambiguous")]
    got = postings.project_calls(spark.createDataFrame(calls, "call_id int, selector string, receiver string, namespaces array<string>, bound array<string>"), spark.createDataFrame(records, "namespace string, method string, operation string, state string"))
    assert {(r["call_id"], r["class"], r["reason"], r["operation"]) for r in got.collect()} == {
        (1, "resolved", None, "/S/m"), (2, "name_match", "name_match_only", None), (3, "unresolved", "dynamic_receiver", None), (5, "unresolved", "ambiguous_method_candidates", None),
        (6, "unresolved", "resolver_conflict", None), (7, "unresolved", "unsupported_receiver", None), (8, "unresolved", "resolver_ambiguous", None),
    }


def test_scalars(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("v")).first()["v"]
    assert get(S.camel_case(F.lit("_id_of_thing2_éa"))) == "IdOfThing2éa"
    assert get(S.lexical_candidates(F.lit("a.b"), F.lit("C"))) == ["a.b.C", "a.C", "C"] and get(S.lexical_candidates(F.lit(""), F.lit(".x.Y"))) == ["x.Y"]
    assert get(S.repo_name(F.lit("git@h.example:o/n.git"))) == "h.example/o/n" and get(S.repo_name(F.lit("nonsense"))) is None
    assert get(S.ancestors(F.lit("a/b/c"))) == ["a", "a/b", "a/b/c"]
    assert get(S.byte_of_column(F.lit("aé😀b"), F.lit(4), F.lit("utf-16"))) == 7 and get(S.byte_of_column(F.lit("aé😀b"), F.lit(3), F.lit("utf-32"))) == 7
    assert get(S.utf16_units(F.lit("a😀"))) == 3
    starts = S.line_starts(F.lit("é\nb\n"))
    assert get(starts) == [0, 3, 5] and get(S.line_of_byte(starts, F.lit(3))) == 2
    assert get(S.canonical_set(F.array(F.lit("b"), F.lit(" "), F.lit("a"), F.lit("b")))) == ["a", "b"]
    assert S.glob_regex("a*[x-z]?.go") == "^a[^/]*[x-z][^/]\\.go$"
    assert get(S.code_role(F.lit("a/b.go"), F.lit("// Code generated by x. DO NOT EDIT.\n"))) == "generated"
    assert get(S.code_role(F.lit("a/b.go"), F.lit("x\n# Autogenerated by Thrift Compiler (1)\n"))) == "generated" and get(S.code_role(F.lit("a/b.go"), F.lit("/* Code generated by MockGen. */"))) == "mock"
    assert get(S.code_role(F.lit("a/mocks/b.go"), F.lit(""))) == "mock" and get(S.code_role(F.lit("vendor/mock_x.go"), F.lit(""))) == "vendor"
    with pytest.raises(Exception, match="unexpected detail schema"):
        get(S.tagged_detail(F.lit('{"schema":"x"}'), "y", "k int"))
    assert 5 <= S.jittered(10, 0.0) <= S.jittered(10, 0.5) == 10


def test_table_functions_in_sql(spark):
    from seine.functions import udtf

    udtf.register(spark)
    spark.createDataFrame([(1, PROTO), (2, None)], "id int, content string").createOrReplaceTempView("udtf_files")
    rows = spark.sql("SELECT f.id, x.object FROM udtf_files f, LATERAL proto_facts(f.content) x WHERE x.predicate = 'DECLARES_OPERATION'").collect()
    assert sorted(tuple(r) for r in rows) == [(1, "/a.b.Svc/Get"), (1, "/a.b.Svc/Put")]
    spark.createDataFrame([(GO,)], "content string").createOrReplaceTempView("udtf_go")
    assert spark.sql("SELECT topic FROM udtf_go, LATERAL kafka_sites(content) WHERE topic = 'orders'").count() == 1


def test_caller_identities(spark):
    rows = [
        (1, "r:1", "c", "a.go", 1, 2, "CALLS_OPERATION", "resolved", [("u", "m")]), (2, "r:1", "c", "b.go", 1, 2, "CALLS_OPERATION", "resolved", [("u", "m")]), (3, "r:1", "c", "c.go", 1, 2, "CALLS_OPERATION", "resolved", [("u", "other")]),
        (4, "r:1", "c", "d.go", 1, 2, "CALLS_OPERATION", "resolved", [("u", "m"), ("v", "m")]), (5, "r:1", "c", "e.go", 1, 2, "UNRESOLVED_CALLER", "resolved", [("u", "m")]), (6, "r", "c", "a.go", 1, 2, "CALLS_OPERATION", "resolved", [("1u", "m")]),
    ]
    df = spark.createDataFrame(rows, "n int, repo string, commit string, path string, start_line int, end_line int, predicate string, unit_state string, units array<struct<id string, metadata string>>")
    units = {r["n"]: (r["key"], r["unresolved"]) for r in change.caller_identities(df, "unit").collect()}
    assert units[1] == units[2] == ("unit|r:1\0u", False) and units[6][0] == "unit|r\x001u"
    assert [units[n][1] for n in (3, 4, 5)] == [True] * 3 and units[3][0] == "unresolved|r:1@c:c.go:1-2"
    places = {r["n"]: r["unresolved"] for r in change.caller_identities(df, "occurrence").collect()}
    assert places == {1: False, 2: False, 3: False, 4: False, 5: True, 6: False}
