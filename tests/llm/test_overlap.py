import random

from pyspark.sql import functions as F

from seine.llm.overlap import cross_split_classes, cross_split_pairs, spelling

SCHEMA = "row_id bigint, split string, system string, predicate string, path string, object string, line int, cid string, side int, a string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 7, "clash") for r in rows], SCHEMA)


def pairs(spark, rows, **options):
    df = cross_split_pairs(frame(spark, rows), "row_id", "split", ["system", "predicate"], "path", "object", "line", **options)
    out = [tuple(r) for r in df.collect()]
    assert len(out) == len(set(out))
    return set(out)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def brute(spark, rows):
    df = frame(spark, rows).select("row_id", "split", "system", "predicate", "line", spelling(F.col("path")).alias("p"), spelling(F.col("object")).alias("o"))
    flat = [r for r in df.collect() if None not in r]
    digits = lambda t: [c for c in t if c.isdigit()]
    return {
        (t["row_id"], e["row_id"])
        for t in flat
        for e in flat
        if t["split"] == "train" and e["split"] in ("dev", "holdout") and (t["system"], t["predicate"]) == (e["system"], e["predicate"]) and abs(t["line"] - e["line"]) <= 3
        and digits(t["p"]) == digits(e["p"]) and digits(t["o"]) == digits(e["o"]) and distance(t["p"], e["p"]) <= 2 and distance(t["o"], e["o"]) <= 2
    }


def test_spellings(spark):
    forms = ["a/b_c/x.go", "/a/b_c/x.go", "A/B_C/X.GO", "a\\b_c\\x.go", "a%2Fb%5Fc%2Fx%2Ego", "./a/./b_c//x.go", "a/tmp/../b_c/x.go", " a/b_c/x.go\t", "/workspace/some-kit/a/b_c/x.go", "a / b_c/x.go", "a/q/r/../../b_c/x.go"]
    df = spark.createDataFrame([(f,) for f in forms], "t string")
    assert {r[0] for r in df.select(spelling(F.col("t"))).collect()} == {"a/b_c/x.go"}
    odd = spark.createDataFrame([("100%",), ("a+b",), ("..",), ("",), (None,)], "t string")
    assert [r[0] for r in odd.select(spelling(F.col("t"))).collect()] == ["100%", "a+b", "..", "", None]


def test_words_lines_digits_and_sides(spark):
    p, o = "src/gonboltir/vomkehi_kolgon/dispatch.go", "/tidegate.hosbanhi.v3.HosbanhiPassengerService/GetVoucher"
    rows = [
        (1, "train", "s", "P", p, o, 100), (2, "dev", "s", "P", p, o, 103), (3, "holdout", "s", "P", p, o, 104), (4, "dev", "s", "P", p.replace("kolgon", "kolgn").replace("src", "sxrc"), o.replace("Get", "Gat"), 98),
        (5, "dev", "s", "P", p.replace("vomkehi", "voe"), o, 100), (6, "dev", "s", "P", p, o.replace("v3", "v2"), 100), (7, "dev", "t", "P", p, o, 100), (8, "dev", "s", None, p, o, 100), (9, "dev", "s", "P", None, o, 100),
        (10, "train", "s", "P", p, o, 100), (11, "other", "s", "P", p, o, 100), (12, None, "s", "P", p, o, 100), (13, "dev", "s", "P", p, o, None), (14, "holdout", "s", "P", p.upper(), o.lower()[1:], 97),
    ]
    assert pairs(spark, rows) == {(t, e) for t in (1, 10) for e in (2, 4, 14)}


def test_short_empty_and_long_texts(spark):
    long = "x" * 2_000
    rows = [(1, "train", "s", "P", "ab", "c", 1), (2, "dev", "s", "P", "a", "", 1), (3, "dev", "s", "P", "abcde", "c", 1), (4, "train", "s", "P", "", "", 5), (5, "dev", "s", "P", "/", " ", 5), (6, "train", "s", "P", long, "k", 9), (7, "dev", "s", "P", long + "yy", "k", 9), (8, "dev", "s", "P", long + "yyz", "k", 9)]
    assert pairs(spark, rows) == {(1, 2), (4, 5), (6, 7)} == brute(spark, rows) == pairs(spark, rows, terms=4)


def test_random_typos_against_brute_force(spark):
    rng = random.Random(11)
    words = ["gon", "bolti", "vom", "kehi", "dis", "patch", "ser", "ver", "a", "zz"]

    def text():
        return "/".join("".join(rng.choices(words, k=rng.randint(1, 2))) for _ in range(rng.randint(1, 4)))

    def typo(t):
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(len(t) + 1)
            t = rng.choice([t[:i] + t[i + 1 :], t[:i] + rng.choice("abcxyz") + t[i:], t[:i] + rng.choice("abcxyz") + t[i + 1 :]])
        return t

    base = [(text(), text()) for _ in range(12)]
    rows = [(i, rng.choice(["train", "dev", "holdout"]), rng.choice("st"), "P", typo(p), typo(o), rng.randint(1, 12)) for i in range(500) for p, o in [rng.choice(base)]]
    expected = brute(spark, rows)
    assert pairs(spark, rows) == expected and len(expected) > 100
    assert pairs(spark, rows, terms=64) == expected


def test_few_letters_against_brute_force(spark):
    """Texts without a floor: they meet by deletions, or by their block where they are long and repeat themselves."""
    rng = random.Random(3)
    texts = ["", "a", "ab", "abc", "abcd", "bcd", "abxd", "zz", "zzzz", "ab/c", *("a" * k for k in (9, 11, 13, 14, 15, 16, 17, 18, 19, 20, 21)), *("ab" * k for k in (7, 8, 9, 10))]
    rows = [(i, rng.choice(["train", "dev"]), "s", "P", rng.choice(texts), rng.choice(["", "k", "kk", "kkkkkkkk"]), rng.randint(1, 4)) for i in range(260)]
    expected = brute(spark, rows)
    assert pairs(spark, rows) == expected and len(expected) > 300


def test_copies_of_one_finding_are_one_class(spark):
    p, o = "src/gonboltir/dispatch.go", "tidegate.hosbanhi.Service/GetVoucher"
    rows = [(i, "train" if i % 2 else "dev", "s", "P", p, o, 5) for i in range(400)]
    matched, members = cross_split_classes(frame(spark, rows), "row_id", "split", ["system", "predicate"], "path", "object", "line")
    assert matched.count() == 1 and members.count() == 400
    assert len(pairs(spark, rows)) == 200 * 200


def test_empty_table(spark):
    assert pairs(spark, []) == set()
