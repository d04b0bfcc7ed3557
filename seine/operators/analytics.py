"""Usage dashboard, audit log, retention and status aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seine.functions.scalars import day_key


def usage_summary(events: DataFrame, duration: str) -> DataFrame:
    """Total and mean duration (integer division; 0 without events)."""
    return events.agg(F.count("*").alias("total"), F.coalesce(F.expr(f"sum({duration}) div count({duration})"), F.lit(0)).cast("long").alias("avg_duration"))


def daily_counts(events: DataFrame, ts: str, first_day: str, last_day: str) -> DataFrame:
    """Events per UTC day, every day of the range present."""
    days = events.sparkSession.range(1).select(F.explode(F.sequence(F.lit(first_day).cast("date"), F.lit(last_day).cast("date"))).alias("d")).select(F.col("d").cast("string").alias("day"))
    counted = events.groupBy(day_key(F.col(ts)).alias("day")).agg(F.count("*").alias("n"))
    return days.join(counted, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


def daily_windows(events: DataFrame, ts: str) -> DataFrame:
    """Counts per day as an event-time window; the form that also runs on a stream (an extension)."""
    return events.groupBy(F.window(ts, "1 day")).agg(F.count("*").alias("n")).select(F.col("window.start").alias("day_start"), "n")


def top_names(events: DataFrame, name: str, k: int) -> DataFrame:
    """Most frequent names, ties by name."""
    return events.groupBy(F.col(name).alias("name")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc("name")).limit(k)


def bounded_sum(rows: DataFrame, order: list[str], size: str, limit: int) -> DataFrame:
    """Count and byte sum of the first ``limit`` rows; the sum is null if any size is unknown or negative."""
    place = Window.orderBy(*order)  # over the bounded head only
    head = rows.orderBy(*order).limit(limit + 1).select(size, F.row_number().over(place).alias("_n"))
    shown = F.col("_n") <= limit
    bad = F.coalesce(F.bool_or(shown & (F.col(size).isNull() | (F.col(size) < 0))), F.lit(False))
    return head.agg(
        F.count_if(shown).alias("n"), F.when(~bad, F.coalesce(F.sum(F.when(shown, F.col(size))), F.lit(0))).alias("bytes"), F.coalesce(F.bool_or(~shown), F.lit(False)).alias("truncated")
    )


def counts_by(rows: DataFrame, **conditions: Column) -> DataFrame:
    """One row with a conditional count per name."""
    return rows.agg(F.count("*").alias("total"), *[F.count_if(c).alias(n) for n, c in conditions.items()])


def sums_of_others(rows: DataFrame, key: str, current: str, *columns: str) -> DataFrame:
    """Sums and non-null counts over all rows but those of the current key."""
    others = rows.where(F.col(key) != current)
    return others.agg(F.count("*").alias("rows"), *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(f"{c}_sum") for c in columns], *[F.count(c).alias(f"{c}_known") for c in columns])


def _summed(line: Column, n: Column, prefix: str = "") -> Column:
    """Digest of a multiset of lines: the 32-bit parts of their SHA-256 values are summed, so rows combine in any order and place."""
    parts = [F.coalesce(F.sum(F.conv(F.substring(F.sha2(line, 256), 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)")), F.lit(0)).cast("string") for i in range(8)]
    return F.sha2(F.concat(F.lit(prefix), F.concat_ws(":", n.cast("string"), *parts)), 256)


def ordered_digest(rows: DataFrame, order: str, value: str) -> DataFrame:
    """Count, bytes and a digest of which value stands at which place of ``order``."""
    marked = rows.select(F.concat_ws(" ", F.col(order).cast("string"), F.sha2(value, 256)).alias("line"), F.octet_length(value).alias("size"))
    return marked.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), _summed(F.col("line"), F.count("*")).alias("digest"))


def set_digest(rows: DataFrame, line: Column, count: str, digest: str, prefix: str = "") -> DataFrame:
    """Count and digest of a set of lines, equal for equal sets in any order."""
    return rows.select(line.alias("line")).agg(F.count("*").alias(count), _summed(F.col("line"), F.count("*"), prefix).alias(digest))
