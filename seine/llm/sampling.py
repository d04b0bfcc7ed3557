"""A sample that stays the same across runs and layouts and only grows as data grows.

Every key is assigned for ever to one of many fine buckets by hash, within its stratum. A fixed permutation orders the buckets,
and the sample is every key in the first buckets of that order. The list of buckets is append-only: its length is a constant
share of all buckets, or per stratum a stored length that :func:`extend_lists` only ever raises. Which keys are chosen thus
depends on the key and the list alone: neither other rows, nor their order, partitioning or repetition can move it, and what was
chosen in an earlier wave stays chosen when later waves arrive.

The list is applied to rows before anything is shuffled, so only the sample itself is grouped.

Defined behaviour: rows delivered twice and keys registered again count once, at their earliest wave (null if no row of the key
has one); null keys are in no sample; a null stratum is a stratum of its own; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seine.runtime import broadcast_if_small

BUCKET_BITS = 12
SHARE = 0.05
#: Fixed odd factor and offset of the permutation of buckets; changing them changes every sample.
FACTOR, OFFSET = 2_654_435_761, 1_013_904_223


def bucket_of(stratum: Column, key: Column, bits: int = BUCKET_BITS) -> Column:
    """Permanent bucket of a key: leading bits of an MD5 over stratum and key."""
    digest = F.md5(F.concat(F.coalesce(stratum, F.lit("")), F.lit("|"), key))
    return F.shiftright(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), 32 - bits).cast("int")


def rank_of(bucket: Column, bits: int = BUCKET_BITS) -> Column:
    """Place of a bucket in the fixed order (an odd factor permutes the residues of a power of two)."""
    return F.pmod(bucket.cast("long") * FACTOR + OFFSET, F.lit(1 << bits)).cast("int")


def list_length(share: float, bits: int = BUCKET_BITS) -> int:
    """Buckets that make up a share, at least one."""
    if not 0 < share <= 1:
        raise ValueError("share must be in (0, 1]")
    return max(1, round(share * (1 << bits)))


def _ranked(df: DataFrame, stratum: str, key: str, wave: str, bits: int) -> DataFrame:
    named = df.select(F.col(stratum).cast("string").alias("stratum"), F.col(key).cast("string").alias("key"), F.col(wave).cast("int").alias("wave")).where("key IS NOT NULL")
    return named.withColumn("rank", rank_of(bucket_of(F.col("stratum"), F.col("key"), bits), bits))


def stable_sample(df: DataFrame, stratum: str, key: str, wave: str, share: float = SHARE, bits: int = BUCKET_BITS, lists: DataFrame | None = None) -> DataFrame:
    """(stratum, key, first_wave, bucket_rank) of every chosen key.

    ``lists`` (stratum, length) holds stored list lengths; a stratum that it lacks has the list of ``share``.
    """
    ranked, least = _ranked(df, stratum, key, wave, bits), list_length(share, bits)
    if lists is None:
        held = ranked.where(F.col("rank") < least)
    else:
        stored = broadcast_if_small(lists.select(F.col("stratum").alias("s1"), "length"))
        held = ranked.join(stored, F.col("stratum").eqNullSafe(F.col("s1")), "left").where(F.col("rank") < F.greatest(F.lit(least), F.coalesce("length", F.lit(0))))
    return held.groupBy("stratum", "key", F.col("rank").alias("bucket_rank")).agg(F.min("wave").alias("first_wave")).select("stratum", "key", "first_wave", "bucket_rank")


def extend_lists(df: DataFrame, stratum: str, key: str, wave: str, least: int, share: float = SHARE, bits: int = BUCKET_BITS, lists: DataFrame | None = None) -> DataFrame:
    """(stratum, length): each stratum's list, lengthened until it holds ``least`` keys of ``df``, never shortened.

    Distinct keys are counted per bucket before the windows, which see at most ``2 ** bits`` rows of a stratum.
    """
    cells = _ranked(df, stratum, key, wave, bits).groupBy("stratum", "rank", "key").agg(F.lit(1).alias("one")).groupBy("stratum", "rank").agg(F.count("*").alias("n"))
    running = Window.partitionBy("stratum").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = cells.select("stratum", "rank", F.sum("n").over(running).alias("upto"), F.sum("n").over(Window.partitionBy("stratum")).alias("all"))
    needed = counted.where(F.col("upto") >= F.least(F.col("all"), F.lit(least))).groupBy("stratum").agg((F.min("rank") + 1).alias("length"))
    floor = needed.select("stratum", F.greatest("length", F.lit(list_length(share, bits))).alias("length"))
    both = floor if lists is None else floor.unionByName(lists.select(F.col("stratum").cast("string").alias("stratum"), F.col("length").cast("int").alias("length")))
    return both.groupBy("stratum").agg(F.max("length").alias("length"))


def sample_by_wave(df: DataFrame, stratum: str, key: str, wave: str, share: float = SHARE, bits: int = BUCKET_BITS) -> DataFrame:
    """(stratum, wave, n_keys, n_chosen): keys first registered in each wave, and how many of them are chosen."""
    keys = _ranked(df, stratum, key, wave, bits).groupBy("stratum", "key", "rank").agg(F.min("wave").alias("wave"))
    return keys.groupBy("stratum", "wave").agg(F.count("*").alias("n_keys"), F.count_if(F.col("rank") < list_length(share, bits)).alias("n_chosen"))
