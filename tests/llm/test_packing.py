import random

import pytest
from pyspark.sql import functions as F

from seine.llm import packing as P

pytestmark = pytest.mark.skipif(not __import__("os").path.exists(P.TOKENIZER), reason="no tokenizer here")


def lengths(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "id bigint, n_tokens bigint")


def kinds(spark, *capacities):
    return spark.createDataFrame([(f"k{c}", c) for c in capacities], "container_kind string, capacity_tokens int")


def check(values, rows, capacity):
    """Every token once, in order; no container over capacity; only long items split."""
    held, per = {}, {}
    for r in rows:
        held.setdefault(r["id"], []).append((r["token_from"], r["n_tokens"]))
        if r["container_id"] is not None:
            per[r["container_id"]] = per.get(r["container_id"], 0) + r["n_tokens"]
    for i, n in enumerate(values):
        at = 0
        for begin, size in sorted(held[i]):
            assert begin == at
            at += size
        assert at == n and (n > capacity or len(held[i]) == 1)
    assert all(0 < x <= capacity for x in per.values())
    return len(per)


@pytest.mark.parametrize("seed", range(6))
def test_fill_finds_the_fullest_first_container(seed):
    rng = random.Random(seed)
    values = [rng.randint(1, 60) for _ in range(12)]
    bins = P.fill(values, 60)
    sums = {}
    for v, b in zip(values, bins):
        sums[b] = sums.get(b, 0) + v
    assert all(x <= 60 for x in sums.values()) and sorted(sums) == list(range(len(sums)))
    most, rest = max(values), list(values)
    rest.remove(most)
    reachable = {0}
    for v in rest:
        reachable |= {r + v for r in reachable if r + v + most <= 60}
    assert sums[0] == most + max(reachable)


@pytest.mark.parametrize("shards", [1, 4])
def test_assignment(spark, shards):
    rng = random.Random(2)
    values = [min(40_000, int(rng.lognormvariate(5, 1.2)) + 1) for _ in range(2_000)] + [0, 512, 513, 1024, 5_000]
    total = sum(values)
    df = P.pack(lengths(spark, values), kinds(spark, 512, 8192), "container_kind", "capacity_tokens", bins_per_shard=-(-total // (512 * shards)))
    for c in (512, 8192):
        n = check(values, df.where(F.col("capacity_tokens") == c).collect(), c)
        assert n <= -(-total // c) * 1.01 + shards


def test_equal_lengths_and_no_combination(spark):
    values = [300] * 50
    assert check(values, P.pack(lengths(spark, values), kinds(spark, 512), "container_kind", "capacity_tokens").collect(), 512) == 50


def test_texts_nulls_repeats_and_long(spark):
    texts = [None, "", "hello world", "hello world", "<|endoftext|> é漢😀", "word " * 9_000, "x" * 30_000, " \n\t " * 50]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id bigint, text string, n_tokens string")
    counts = P.token_counts(df, "doc_id", "text")
    n = [r["n_tokens"] for r in counts.orderBy("id").collect()]
    assert n[:4] == [0, 0, 2, 2] and n[5] == 9_001 and all(n[4:])
    rows = P.pack(counts, kinds(spark, 64), "container_kind", "capacity_tokens").collect()
    check(n, rows, 64)
    assert {r["id"] for r in rows if r["container_id"] is None} == {0, 1}


def test_repeated_ids_are_separate_items(spark):
    df = spark.createDataFrame([(1, 10), (1, 10)], "id bigint, n_tokens bigint")
    assert P.pack(df, kinds(spark, 16), "container_kind", "capacity_tokens").count() == 2


def test_empty(spark):
    assert P.pack(lengths(spark, []), kinds(spark, 8), "container_kind", "capacity_tokens").count() == 0
    assert P.pack(lengths(spark, [3]), kinds(spark), "container_kind", "capacity_tokens").count() == 0


def test_shards_are_bounded_by_items_too(spark):
    held = spark.range(3_000).select("id", F.lit(1).cast("long").alias("n_tokens"))
    kinds = spark.createDataFrame([("k", 2_000)], "kind string, size int")
    out = P.pack(held, kinds, "kind", "size", items_per_shard=500)
    assert out.select(F.substring_index("container_id", ":", 1)).distinct().count() == 6
    assert tuple(P.invariants(out, held).collect()[0])[2:6] == (3_000, 0, 0, 0)


def test_invariants_see_faults(spark):
    held = lengths(spark, [3, 9])
    rows = [("k", 5, "0", 0, 0, 0, 2), ("k", 5, "1", 0, 1, 2, 1), ("k", 5, "2", 1, 0, 0, 6), ("k", 5, "3", 1, 1, 5, 4)]
    packed = spark.createDataFrame(rows, "container_kind string, capacity_tokens int, container_id string, id bigint, piece int, token_from bigint, n_tokens bigint")
    r = P.invariants(packed, held).collect()[0]
    assert (r["n_items"], r["n_over"], r["n_split_needlessly"], r["n_incomplete"]) == (2, 1, 1, 1)
