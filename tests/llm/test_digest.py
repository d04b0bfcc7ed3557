import numpy as np
import pytest
from pyspark.sql import functions as F

from seine.llm import digest as D

SCHEMA = "id bigint, grp string, day string, v bigint, extra string, metric string"


def values_of(spark, rows):
    df = spark.createDataFrame([(*r, "x", "clash") for r in rows], SCHEMA)
    return D.measurements(df, "id", "grp", F.col("day"), {"v": F.col("v")})


def one(values, delta=D.DELTA):
    values = np.asarray(values, float)
    n = len(values)
    return D.cluster(np.zeros(n, np.int64), values, np.ones(n, np.int64), np.ones(n, bool), delta)[1:]


def rank_error(values, p, x):
    v = np.asarray(values)
    return max(0.0, (v < x).mean() - p, p - (v <= x).mean())


@pytest.mark.parametrize("kind", ["even", "heavy", "ties", "tail", "one", "two"])
def test_single_and_merged_error(kind):
    rng = np.random.default_rng(3)
    values = {
        "even": rng.integers(0, 10**6, 50_000), "heavy": np.exp(rng.normal(8, 3, 50_000)).astype(int), "ties": rng.choice([0, 0, 0, 5, 7, 1000], 50_000),
        "tail": np.r_[np.zeros(45_000, int), rng.integers(1, 10**9, 5_000)], "one": np.full(1000, 4), "two": np.array([1, 9]),
    }[kind]
    m, w, t = one(values)
    assert w.sum() == len(values) and len(m) <= 4 * D.DELTA
    parts = [one(x) for x in np.array_split(rng.permutation(values), 20) if len(x)]
    mm, mw, mt = D.cluster(np.zeros(sum(len(p[0]) for p in parts), np.int64), *(np.concatenate(c) for c in zip(*parts)))[1:]
    for means, weights, tied in ((m, w, t), (mm, mw, mt)):
        xs = D.quantiles_of(means, weights, tied, values.min(), values.max(), np.asarray(D.QUANTILES))
        for p, x in zip(D.QUANTILES, xs):
            assert rank_error(values, p, x) <= max(D.BOUND, 1 / len(values))


def test_certificate_counts_exactly(spark):
    rng = np.random.default_rng(4)
    rows = [(i, "ab"[i % 2], f"d{i % 5}", int(v)) for i, v in enumerate(rng.integers(0, 300, 4_000))]
    found = D.by_period_and_joined(values_of(spark, rows), ["v"]).collect()
    assert len(found) == 2 * (5 + 1) and sum(r["whole"] for r in found) == 2
    for r in found:
        v = np.array([x for _, g, d, x in rows if g == r["grp"] and (r["period"] is None or d == r["period"])])
        assert r["n"] == r["counted"] == len(v) and r["within_bound"]
        for f in r["found"]:
            assert f["below"] == (v < f["value"]).sum() and f["upto"] == (v <= f["value"]).sum()
            assert abs(f["rank_error"] - rank_error(v, f["p"], f["value"])) < 1e-12


def test_digests_of_days_join_to_the_whole(spark):
    rows = [(i, "g", f"d{i % 50}", i * i % 7919) for i in range(20_000)]
    values = values_of(spark, rows)
    daily = D.merge_digests(D.digests(values, ["v"]), by_period=True)
    assert daily.count() == 50
    whole = D.merge_digests(daily.withColumn("part", F.pmod(F.xxhash64("period"), F.lit(1000)).cast("int"))).collect()
    assert len(whole) == 1 and whole[0]["n"] == 20_000 and sum(whole[0]["weights"]) == 20_000
    assert whole[0]["least"] == 0 and len(whole[0]["means"]) <= 4 * D.DELTA


def test_answers_outside_the_bound_are_mended(spark):
    rng = np.random.default_rng(8)
    rows = [(i, "ab"[i % 2], f"d{i % 3}", int(v)) for i, v in enumerate(np.exp(rng.normal(8, 2, 12_000)))]
    values = values_of(spark, rows)
    coarse = D.certify(values, *(D.percentiles(D.merge_digests(D.digests(values, ["v"], 12), 12, by_period=b)) for b in (True, False)), ["v"])
    assert coarse.where("NOT within_bound").count() == 8
    found = D.by_period_and_joined(values, ["v"], delta=12).collect()
    assert len(found) == 8 and all(r["within_bound"] for r in found)
    for r in found:
        v = np.array([x for _, g, d, x in rows if g == r["grp"] and (r["whole"] or d == r["period"])])
        assert r["n"] == len(v) and all(rank_error(v, f["p"], f["value"]) <= D.BOUND for f in r["found"])


def test_dirty_values(spark):
    rows = [(1, "a", "d", 5), (1, "a", "d", 5), (2, "a", "d", -1), (3, "a", "d", None), (4, "a", "d", 10**12), (5, None, None, 7), (6, "b", "d", None), (7, "a", None, 5)]
    found = D.by_period_and_joined(values_of(spark, rows), ["v"]).collect()
    got = {(r["grp"], r["period"], r["whole"], r["n"]) for r in found}
    assert got == {("a", "d", False, 1), ("a", None, False, 1), ("a", None, True, 2), (None, None, False, 1), (None, None, True, 1)}
    df = spark.createDataFrame([(*r, "x", "m") for r in rows], SCHEMA)
    counts = {(r["group"], r["n_valid"], r["n_null"], r["n_impossible"]) for r in D.value_counts(df, "id", "grp", {"v": F.col("v")}).collect()}
    assert counts == {("a", 2, 1, 2), (None, 1, 0, 0), ("b", 0, 1, 0)}


def test_empty(spark):
    assert D.by_period_and_joined(values_of(spark, []), ["v"]).count() == 0
