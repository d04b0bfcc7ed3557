import pytest

from seine.plans.query_language import All, Any, Const, Flag, InvalidQuery, Lang, Not, Repo, Text, parse, tokenize


@pytest.mark.parametrize(
    "raw, tokens",
    [("a b", ["a", "b"]), (r"a\ b c", [r"a\ b", "c"]), ('"a b" c', ['"a b"', "c"]), (r'"a \" b" c', [r'"a \" b"', "c"]), ("", []), ("  \t\n ", []), (r"a\	b", [r"a\	b"])],
)
def test_tokens(raw, tokens):
    assert tokenize(raw) == tokens


@pytest.mark.parametrize(
    "raw, tree",
    [
        ("foo", Text("foo")),
        ("foo bar", All((Text("foo"), Text("bar")))),
        ('"foo bar"', Text("foo bar")),
        ("f[ou]+nc", Text("f[ou]+nc", "any", True)),
        ("-foo", Not(Text("foo"))),
        ("--foo", Text("foo")),
        ("a or b c", Any((Text("a"), All((Text("b"), Text("c")))))),
        ("(a or b) c", All((Any((Text("a"), Text("b"))), Text("c")))),
        ("-(a b)", Not(All((Text("a"), Text("b"))))),
        ("file:x -f:y", All((Text("x", "file"), Not(Text("y", "file"))))),
        ("lang:Go r:z", All((Lang("go"), Repo("z")))),
        ("(archived:yes or -fork:no)", Any((Flag("archived", True), Not(Flag("fork", False))))),
        ("a (b (c))", All((Text("a"), Text("b"), Text("c")))),
        ('"context:x"', Text("context:x")),
        ("case:yes", Const(True)),
    ],
)
def test_trees(raw, tree):
    assert parse(raw).tree == tree


@pytest.mark.parametrize("raw", ["rev:a rev:b x", "-rev:a x", "(rev:a x)", "context:a", "-context:a x", "rev:../x y", "a )", "(a", "file:", "f[", "case:maybe x", "archived:perhaps", "-"])
def test_refused(raw):
    with pytest.raises(InvalidQuery):
        parse(raw)


def test_scopes_case_and_terms():
    p = parse("context:a context:b rev:release-1 case:yes Foo -bar")
    assert (p.contexts, p.revision, p.case) == (("a", "b"), "release-1", "yes")
    assert p.texts == (Text("Foo"),)


def test_search_on_small_files(spark):
    from seine.plans import search as S

    rows = [(1, "r1", "a/X.go", "Go", "func Foo() {}\nfoo foo"), (2, "r2", "b/foo.go", "go", None), (3, None, None, None, "FOO"), (4, "r1", "v/x_test.go", "go", "nothing")]
    files = spark.createDataFrame(rows, "doc_id int, repo string, path string, language string, content string")
    ids = lambda q, **k: [r["doc_id"] for r in S.search(files, q, tie="doc_id", **k).collect()]
    assert ids("foo") == [1, 3, 2]
    assert ids("Foo") == [1]
    assert ids("case:no Foo lang:go") == [1, 2]
    assert ids("-foo") == [4]
    assert ids("file:_test or file:X") == [1, 4]
    assert ids("repo:r2") == [2]
    with pytest.raises(InvalidQuery):
        S.search(files, "fork:yes x")
    with pytest.raises(InvalidQuery):
        S.search(files, "context:none x", repos=spark.createDataFrame([], "name string"), contexts={})
    repos = spark.createDataFrame([("r1", True, False, True)], "name string, is_fork boolean, is_archived boolean, is_public boolean")
    assert ids("-fork:yes foo", repos=repos) == [3, 2]


def test_chunks_and_ranges(spark):
    from seine.plans import search as S

    files = spark.createDataFrame([("r", "p", "go", "one\nab foo fOo\nthree\nfoo")], "repo string, path string, language string, content string")
    row = S.chunks(S.search(files, "foo"), parse("foo"), context_lines=1).first()
    assert [(c["start_line"], c["content"]) for c in row["chunks"]] == [(1, "one\nab foo fOo\nthree"), (3, "three\nfoo")]
    assert [(r["start_line"], r["start_col"], r["end_col"]) for r in row["chunks"][0]["ranges"]] == [(2, 4, 7), (2, 8, 11)]


def test_stream_keeps_one_budget(spark):
    from seine.plans import search as S

    files = spark.createDataFrame([(f"r{i}", f"p{i}", "go", "foo") for i in range(25)], "repo string, path string, language string, content string")
    found, _ = S.matching(files, "foo")
    batches = list(S.stream(found, 12, 5))
    assert sum(map(len, batches)) == 12 and max(map(len, batches)) <= 5
    assert sum(map(len, S.stream(found, 100, 10))) == 25


def test_index_changes_nothing_but_the_work(spark, tmp_path):
    from seine.plans import index as X
    from seine.plans import search as S

    words = ["alpha", "Beta", "gamma", "del", "İxaıſK", "ab"]
    rows = [(i, f"r{i % 3}", f"d/{words[i % 6]}.go", "go", None if i % 11 == 0 else " ".join(words[(i * k) % 6] for k in range(1, 5))) for i in range(120)]
    files = spark.createDataFrame(rows, "doc_id int, repo string, path string, language string, content string")
    store = X.publish(files, "doc_id", str(tmp_path / "index"))
    for raw in ("alpha", "Beta", "alpha -gamma", "(alpha or beta) del", "ab", "file:gamma alpha", "İx", "ixa", "ixaisk", "al.ha gamma", '"alpha beta"', "nothing"):
        plain = [r["doc_id"] for r in S.search(files, raw, 100, "doc_id").collect()]
        assert [r["doc_id"] for r in X.indexed_search(files, store.read(), "doc_id", raw, 100).collect()] == plain, raw
    assert X.candidates(store.read(), "alpha").count() < 120 and X.candidates(store.read(), "a or b") is None
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    plan = X.candidates(store.read(), "alpha")._jdf.queryExecution().executedPlan().toString()
    assert "In(gram, [alp,lph,pha])" in plan
    # few candidates reach the scan of the files as a filter; many are met by a join
    files.write.parquet(str(tmp_path / "files"))
    stored = spark.read.parquet(str(tmp_path / "files"))
    pushed = X.narrowed(stored, store.read(), "doc_id", "alpha")
    assert "PushedFilters: [In(doc_id" in pushed._jdf.queryExecution().executedPlan().toString() and pushed.count() < 120
    joined = X.narrowed(stored, store.read(), "doc_id", "alpha", pushed_most=3)
    assert "In(doc_id" not in joined._jdf.queryExecution().executedPlan().toString() and joined.count() == pushed.count()
    assert X.narrowed(stored, store.read(), "doc_id", "nowhere").count() == 0
