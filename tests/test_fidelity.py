"""Edge cases of scanners, names, sources and digests."""

import subprocess
import time

import pytest
from pyspark.sql import functions as F

from seine.functions import scalars as S
from seine.operators import analytics, callers, codenav, contracts, evidence, gosource
from seine.sources import git


def get(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def fields(facts):
    return {(f[2], f[3], f[5]) for f in facts if f[0] == "DECLARES_FIELD"}


def test_thrift_defaults_strings_and_containers():
    text = """namespace go x
    include "other.thrift" // } not here
    const map<string,i32> C = {"a": 1, 'b}': 2}
    struct S {
      1: map<string, list<i32>> m = {"}": [1, 2]} (go.tag = "json:\\"x\\""),
      2: string u = "http://x/{y}" ; # 9: i32 no
      /* 8: i32 no */ 3: required other.T t
      -4: set<binary> s = [],
    }
    union U { 1: i32 a; 2: string b }
    exception E { 1: string message }
    enum K { A = 1, B }
    typedef list<S> Many
    service Q extends other.Base {
      oneway void ping(1: i32 a = 3),
      S get(1: string id, 2: K kind) throws (1: E e, 2: other.F f) (deprecated = "yes");
      void done()
    }
    struct Last { 1: i32 z }"""
    facts = list(contracts.thrift_facts(text))
    assert not [f for f in facts if f[0] == "GAP"]
    assert fields(facts) == {
        ("x.S#1", "m", "map<string,list<i32>>"), ("x.S#2", "u", "string"), ("x.S#3", "t", "other.T"), ("x.S#-4", "s", "set<binary>"), ("x.U#1", "a", "i32"), ("x.U#2", "b", "string"), ("x.E#1", "message", "string"),
        ("x.Q_ping_args#1", "a", "i32"), ("x.Q_get_args#1", "id", "string"), ("x.Q_get_args#2", "kind", "K"), ("x.Q_get_result#0", "success", "S"), ("x.Q_get_result#1", "e", "E"), ("x.Q_get_result#2", "f", "other.F"), ("x.Last#1", "z", "i32"),
    }
    assert {f[2] for f in facts if f[0] == "DECLARES_OPERATION"} == {"/x.Q/ping", "/x.Q/get", "/x.Q/done"}


def test_thrift_gaps_are_visible():
    facts = list(contracts.thrift_facts("struct A { string a, 2: i32 b }\nstruct B { 1: }\nstruct C { 1: i32 c }\nwhat is this\nstruct D { 1: i32 d }"))
    assert {(f[1], f[5]) for f in facts if f[0] == "GAP"} == {("A", "unnumbered_field"), ("", "unreadable_struct"), ("", "unreadable_statement")}
    assert {f[2] for f in facts if f[0] == "DECLARES_FIELD"} == {"A#2", "C#1", "D#1"}


def test_proto_groups_and_extensions():
    text = """package p; message M { repeated group Result = 1 { required string url = 2; optional group Deep = 3 { optional int32 x = 4; } }
      oneof o { group Alt = 5 { optional bool y = 6; } } optional string after = 7; extend Other { optional int32 e = 100; } optional option_kind option = 8; }
      extend Foreign { optional int32 f = 101; } message N { optional int32 n = 1; }"""
    facts = list(contracts.proto_facts(text))
    assert fields(facts) == {("p.M#1", "result", "Result"), ("p.M.Result#2", "url", "string"), ("p.M.Result#3", "deep", "Deep"), ("p.M.Result.Deep#4", "x", "int32"), ("p.M#5", "alt", "Alt"), ("p.M.Alt#6", "y", "bool"), ("p.M#7", "after", "string"), ("p.M#8", "option", "option_kind"), ("p.N#1", "n", "int32")}
    assert {(f[1], f[3], f[5]) for f in facts if f[0] == "GAP"} == {("p.M", "Other", "extension"), ("p", "Foreign", "extension")}


def test_scanners_are_linear():
    thrift = "\n".join(f"struct S{i} {{ 1: string a, 2: i32 b }}" for i in range(20_000))
    go = "package p\n" + "\n".join(f"func F{i}() {{ a.b.Call{i}() }}" for i in range(20_000))
    began = time.perf_counter()
    assert sum(f[0] == "DECLARES_FIELD" for f in contracts.thrift_facts(thrift)) == 40_000
    sites = list(gosource.call_sites(go))
    assert time.perf_counter() - began < 10
    assert sites[-1] == ("call", "a.b", "Call19999", "F19999", 20_001)


@pytest.mark.parametrize("path, ok", [("a/b.go", True), ("a" * 4096, True), ("a" * 4097, False), ("é" * 2049, False), ("-a", False), ("a/-b", True), ("a\x7fb", False), ("a//b", False), ("/a", False), ("a/../b", False), ("a\\b", False), ("", False)])
def test_valid_path(spark, path, ok):
    assert get(spark, S.valid_path(F.lit(path))) is ok


@pytest.mark.parametrize(
    "url, clean",
    [
        ("https://u:p@h.example/o/n.git?x=1#y", "https://h.example/o/n.git"), ("HTTP://h.example:8080/o", "http://h.example:8080/o"), ("https:///o/n", None), ("ssh://git@h.example/o/n", "ssh://git@h.example/o/n"), ("ssh://git:secret@h.example/o/n", None),
        ("git+ssh://h.example/o", "git+ssh://h.example/o"), ("ftp://u@h.example/o", None), ("file:///srv/o.git", "file:///srv/o.git"), ("git@h.example:o/n.git", "git@h.example:o/n.git"), ("/srv/o.git", "/srv/o.git"),
    ],
)
def test_sanitize_url(spark, url, clean):
    assert get(spark, S.sanitize_url(F.lit(url))) == clean


@pytest.mark.parametrize(
    "url, name",
    [
        ("https://u@h.example/o/n.git", "h.example/o/n"), ("ssh://git@h.example:22/o/n.git", "h.example:22/o/n"), ("git@h.example:o/n.git", "h.example/o/n"), ("file:///srv/o.git", "local/srv/o"), ("/srv//o.git", "local/srv/o"), ("~/work/o.git", "local/work/o"), ("~/.git", None),
        ("https://h.example/o/../n", None), ("https://h.example/-o/n", None), ("https://h.example/", None), ("nonsense", None), ("https://h.example/a.git/b", None),
    ],
)
def test_repo_name(spark, url, name):
    assert get(spark, S.repo_name(F.lit(url))) == name


def test_headers_count_in_bytes(spark):
    header = "// Code generated by x. DO NOT EDIT.\n"
    role = lambda text: get(spark, S.code_role(F.lit("a.go"), F.lit(text)))
    assert role("é" * 2_000 + "\n" + header) == "generated" and role("é" * 2_048 + "\n" + header) == "production"


def test_merged_references_once(spark):
    rows = spark.createDataFrame([("k", ["b", "a"], ["c"]), ("k", ["a"], None), ("n", None, None)], "id string, s array<string>, c array<string>")
    got = {r["id"]: (r["supporting"], r["contradicting"], r["overlapping"]) for r in evidence.merge_assertions(rows, "id", "s", "c").collect()}
    assert got == {"k": (["a", "b"], ["c"], False), "n": ([], [], False)}


def test_digests_do_not_depend_on_order(spark):
    rows = [(i, f"v{i % 7}") for i in range(500)]
    frames = [spark.createDataFrame(r, "k int, v string").repartition(n) for r, n in ((rows, 1), (rows[::-1], 7))]
    assert len({analytics.ordered_digest(f, "k", "v").first()["digest"] for f in frames}) == 1
    assert len({analytics.set_digest(f, F.col("v"), "n", "d").first()["d"] for f in frames}) == 1
    swapped = spark.createDataFrame([(0, "v1"), (1, "v0"), *rows[2:]], "k int, v string")
    assert analytics.ordered_digest(swapped, "k", "v").first()["digest"] != analytics.ordered_digest(frames[0], "k", "v").first()["digest"]
    assert analytics.set_digest(swapped, F.col("v"), "n", "d").first()["d"] == analytics.set_digest(frames[0], F.col("v"), "n", "d").first()["d"]
    assert analytics.set_digest(frames[0].limit(0), F.col("v"), "n", "d").first()["n"] == 0
    sealed = callers.seal(frames[0].withColumn("k", F.col("k").cast("string")), "k", "v")
    assert callers.verify_seal(sealed, frames[1].withColumn("k", F.col("k").cast("string")), "k", "v").first()["intact"]
    assert not callers.verify_seal(sealed, swapped.withColumn("k", F.col("k").cast("string")), "k", "v").first()["intact"]


def test_shapes_show_their_bounds(spark):
    edges = spark.createDataFrame([("r", f"c{i}") for i in range(5)] + [("c0", "r"), ("c1", "d"), ("d", "e")], "parent string, child string")
    root = spark.createDataFrame([("r",)], "node string")
    whole = {(r["node"], r["stop"]) for r in codenav.shape(edges, root).collect()}
    assert whole == {("r", None), ("r", "cycle"), *((f"c{i}", None) for i in range(5)), ("d", None), ("e", None)}
    few = [(r["node"], r["stop"]) for r in codenav.shape(edges, root, per_message=3).collect()]
    assert (None, "fields") in few and len([n for n, s in few if n and n.startswith("c")]) == 3
    cut = [(r["node"], r["stop"]) for r in codenav.shape(edges, root, nodes=4).collect()]
    assert len(cut) == 5 and cut.count((None, "nodes")) == 1
    assert ("d", "depth") in {(r["node"], r["stop"]) for r in codenav.shape(edges, root, depth=2).collect()}


@pytest.fixture
def repo(tmp_path):
    def run(*args):
        subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=T", "-c", "user.email=t@example.org", *args], check=True, capture_output=True)

    run("init", "-q", "-b", "main")
    (tmp_path / "a b.txt").write_text("".join(f"line {i}\n" for i in range(40)))
    (tmp_path / "old.txt").write_text("x\n" * 30)
    (tmp_path / "bin").write_bytes(b"\xff\x00")
    (tmp_path / "big.txt").write_text("y" * (3 << 20))
    run("add", "-A")
    run("commit", "-qm", "first")
    (tmp_path / "a b.txt").write_text("".join(f"line {i}\n" for i in range(1, 39)) + "end")
    (tmp_path / "bin").write_bytes(b"\xff\x00\x01")
    run("mv", "old.txt", "new.txt")
    (tmp_path / "more.txt").write_text("m\n")
    run("add", "-A")
    run("commit", "-qm", "second")
    return tmp_path


def test_git_diff_and_large_contents(spark, repo):
    git.register(spark)
    rows = {r["path"]: r for r in spark.read.format("git_diff").option("repos", f"r={repo}@HEAD").load().collect()}
    assert set(rows) == {"a b.txt", "bin", "new.txt", "more.txt"}
    assert rows["bin"]["binary"] and rows["new.txt"]["old_path"] == "old.txt" and rows["more.txt"]["old_path"] is None
    first, last = rows["a b.txt"]["hunks"]
    assert (first["old_start"], first["new_start"], first["lines"][0]) == (1, 1, "-line 0")
    assert last["lines"][-2:] == ["+end", "\\ No newline at end of file"]
    root = spark.read.format("git_diff").option("repos", f"r={repo}@HEAD~1").load()
    assert root.count() == 4 and root.where("base IS NOT NULL").count() == 0
    tree = spark.read.format("git_tree").option("repos", f"r={repo}@HEAD").load()
    assert tree.rdd.getNumPartitions() == git.SPLITS
    assert {r["path"]: len(r["content"]) for r in tree.collect()}["big.txt"] == 3 << 20
    small = spark.read.format("git_tree").option("repos", f"r={repo}@HEAD").option("maxBytes", "10").load()
    assert {r["path"]: (r["size"], r["content"]) for r in small.collect()}["big.txt"] == (3 << 20, None)
