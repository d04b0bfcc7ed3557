import random

from pyspark.sql import functions as F

from seine.llm.sampling import bucket_of, extend_lists, list_length, rank_of, sample_by_wave, stable_sample

SCHEMA = "system string, site_id string, wave int, stratum string, rank int"


def frame(spark, rows):
    return spark.createDataFrame([(s, k, w, "clash", 1) for s, k, w in rows], SCHEMA)


def chosen(df, **options):
    return {(r["stratum"], r["key"]) for r in stable_sample(df, "system", "site_id", "wave", **options).collect()}


def test_ranks_are_a_permutation_and_buckets_even(spark):
    ranks = [r[0] for r in spark.range(4096).select(rank_of(F.col("id"))).collect()]
    assert sorted(ranks) == list(range(4096))
    n = spark.range(40_000).select(bucket_of(F.lit("s"), F.col("id").cast("string"), 4).alias("b")).groupBy("b").count().collect()
    assert len(n) == 16 and all(2_200 < r["count"] < 2_800 for r in n)


def test_same_for_any_layout_and_repetition(spark):
    rows = [(f"s{i % 3}", f"k{i}", i % 9) for i in range(3_000)]
    base = chosen(frame(spark, rows), share=0.1)
    random.Random(1).shuffle(rows)
    assert base == chosen(frame(spark, rows + rows[:500]).repartition(7), share=0.1)
    assert 220 < len(base) < 380


def test_later_waves_only_add(spark):
    rows = [(f"s{i % 4}", f"k{i}", i % 10) for i in range(2_000)]
    before = set()
    for wave in range(10):
        now = chosen(frame(spark, [r for r in rows if r[2] <= wave]), share=0.2)
        assert before <= now
        before = now
    assert before <= chosen(frame(spark, rows), share=0.5)


def test_extended_lists_never_shrink(spark):
    small = frame(spark, [("a", f"k{i}", 1) for i in range(40)])
    grown = frame(spark, [("a", f"k{i}", 1) for i in range(4_000)] + [("b", "x", 1)])
    first = extend_lists(small, "system", "site_id", "wave", least=10, share=0.01)
    second = extend_lists(grown, "system", "site_id", "wave", least=10, share=0.01, lists=first)
    lengths = {r["stratum"]: r["length"] for r in second.collect()}
    assert lengths["a"] == first.first()["length"]
    old, new = chosen(small, share=0.01, lists=first), chosen(grown, share=0.01, lists=second)
    assert len(old) >= 10 and old <= new and ("b", "x") in new


def test_nulls_ties_and_empty(spark):
    df = frame(spark, [(None, "a", 1), ("s", None, 1), ("s", "a", None), ("s", "a", 5), ("s", "a", 3), ("s", "b", None), ("s", "", 2), ("s", "z" * 10_000, 1)])
    rows = {(r["stratum"], r["key"][:3]): r["first_wave"] for r in stable_sample(df, "system", "site_id", "wave", share=1.0).collect()}
    assert rows == {(None, "a"): 1, ("s", "a"): 3, ("s", "b"): None, ("s", ""): 2, ("s", "zzz"): 1}
    assert chosen(frame(spark, [])) == set()
    counts = sample_by_wave(df, "system", "site_id", "wave", share=1.0).collect()
    assert sum(r["n_keys"] for r in counts) == sum(r["n_chosen"] for r in counts) == 5


def test_list_length():
    assert list_length(1.0) == 4096 and list_length(1e-9) == 1
