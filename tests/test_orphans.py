import random
from datetime import datetime, timedelta

from seine.operators.orphans import Child, Parent, carried_balances, orphan_counts, orphan_references

T0 = datetime(2025, 1, 1)
PARENT = "site_id string, registered_at timestamp, deleted_at timestamp, extra string"
CHILD = "row_id bigint, site_id string, at timestamp, key string, reason string"


def at(n):
    return None if n is None else T0 + timedelta(hours=n)


def registry(p):
    return [Parent("p", p, "site_id", "registered_at", "deleted_at")]


def run(spark, parents, children, **options):
    p = spark.createDataFrame([(k, at(s), at(e), "x") for k, s, e in parents], PARENT)
    c = spark.createDataFrame([(i, k, at(t), "clash", "clash") for i, k, t in children], CHILD)
    rows = orphan_references(registry(p), [Child("c", c, "row_id", "site_id", "at", "p")], **options)
    return {r["row_id"]: r["reason"] for r in rows.collect()}


def brute(parents, children):
    strip = lambda k: (k or "").strip(" \t\r\n")
    out = set()
    for i, k, t in children:
        mine = [(s, e) for p, s, e in parents if strip(p) == strip(k) and strip(k)]
        if not strip(k):
            continue
        valid = bool(mine) if t is None else any(s is not None and s <= t and (e is None or t < e) for s, e in mine)
        if not valid:
            out.add(i)
    return out


def test_bounds_and_reasons(spark):
    parents = [("a", 10, 20), ("a", 10, 20), ("b", 5, None), ("c", 1, 2), ("c", 30, None)]
    children = [(1, "a", 10), (2, "a", 19), (3, " a\t", 20), (4, "a", 9), (5, "b", 4), (6, "b\n", 5), (7, "zz", 1), (8, "c", 15), (9, "c", 31)]
    assert run(spark, parents, children) == {3: "deleted", 4: "not_yet", 5: "not_yet", 7: "missing", 8: "deleted"}


def test_nulls_and_blanks(spark):
    parents = [("a", None, None), (None, 1, None), ("  ", 1, None), ("b", 5, 5)]
    children = [(1, None, 1), (2, " \t\r\n", 1), (3, "a", None), (4, "a", 3), (5, "q", None), (6, "b", 5), (7, "b", None)]
    assert run(spark, parents, children) == {4: "not_yet", 5: "missing", 6: "not_yet"}


def test_case_and_inner_blanks_matter(spark):
    assert run(spark, [("Ab", 1, None)], [(1, "ab", 2), (2, "A b", 2), (3, "Ab", 2)]) == {1: "missing", 2: "missing"}


def test_random_against_brute_force(spark):
    rng = random.Random(5)
    keys = ["k0"] * 10 + [f"k{i}" for i in range(12)]
    parents = []
    for _ in range(150):
        s = rng.choice([None, *range(0, 3000, 7)])
        parents.append((rng.choice(keys), s, rng.choice([None, (s or 0) + rng.randint(-3, 900)])))
    children = [(i, rng.choice([*keys, " k1 ", "none", None]), rng.choice([None, *range(0, 3200, 7)])) for i in range(900)]
    for slots in (1, 7, 60):
        assert set(run(spark, parents, children, slots=slots)) == brute(parents, children)


def test_one_busy_key_at_one_moment_is_cut(spark):
    parents = [("hot", 5, None)] * 200 + [("hot", 1, 3)] * 200
    children = [(i, "hot", 4 if i % 3 else 6) for i in range(3000)]
    p = spark.createDataFrame([(k, at(s), at(e), "x") for k, s, e in parents], PARENT)
    c = spark.createDataFrame([(i, k, at(t), "", "") for i, k, t in children], CHILD)
    found = orphan_references(registry(p), [Child("c", c, "row_id", "site_id", "at", "p")], slots=8)
    assert {r["row_id"] for r in found.collect()} == {i for i in range(3000) if i % 3}


def test_several_parent_tables(spark):
    p = spark.createDataFrame([("a", at(0), None, "")], PARENT)
    q = spark.createDataFrame([("b", at(0), None, "")], PARENT)
    c = spark.createDataFrame([(1, "a", at(1), "", ""), (2, "b", at(1), "", "")], CHILD)
    tables = [Parent("p", p, "site_id", "registered_at", "deleted_at"), Parent("q", q, "site_id", "registered_at", "deleted_at")]
    kids = [Child("to_p", c, "row_id", "site_id", "at", "p"), Child("to_q", c, "row_id", "site_id", "at", "q"), Child("to_none", c, "row_id", "site_id", "at", "r")]
    found = {(r["ref_table"], r["parent_table"], r["row_id"], r["reason"]) for r in orphan_references(tables, kids).collect()}
    assert found == {("to_p", "p", 2, "missing"), ("to_q", "q", 1, "missing"), ("to_none", "r", 1, "missing"), ("to_none", "r", 2, "missing")}


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a", 1)]) == {1: "missing"}
    assert run(spark, [("a", 1, None)], []) == {}


def test_counts_by_period(spark):
    c = spark.createDataFrame([(1, "a", at(1), "", ""), (2, "b", at(2), "", ""), (3, "b", None, "", ""), (4, "a", at(24 * 40), "", "")], CHILD)
    p = spark.createDataFrame([("a", at(0), at(5), "")], PARENT)
    kids = [Child("c", c, "row_id", "site_id", "at", "p")]
    rows = orphan_counts(orphan_references(registry(p), kids), kids).collect()
    assert {(r["period"], r["n_references"], r["n_orphans"], r["missing"], r["deleted"]) for r in rows} == {("2025-01", 2, 1, 1, 0), ("2025-02", 1, 1, 0, 1), (None, 1, 1, 1, 0)}


def test_balances_carried_into_slots():
    a, b = (0, "a"), (0, "b")
    # slot 2 is missing (empty); key a runs over slots 0, 1 and 3, key b over 3 and 4
    ends = [(0, *b[:1], "0", *a, 2, 3), (1, *a, *a, -1, 0), (3, *a, *b, 5, 5), (4, *b, *b, 1, 1)]
    assert carried_balances(ends) == {1: (2, 3), 3: (1, 3), 4: (5, 5)}
    assert carried_balances([(0, *a, *a, 1, 1), (1, *b, *b, 1, 1)]) == {}
