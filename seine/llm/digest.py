"""Percentiles of very large columns by merging centroid digests, certified by a counting pass.

Every partition sorts its values and clusters them under a size function of the quantile (the arcsine scale: small clusters at
the tails, larger ones in the middle), so a digest has a number of centroids bounded by ``delta`` whatever it summarises. Digests are
merged by sorting their centroids together and clustering again, in two levels so that no task gathers the digests of all
partitions. Percentiles are interpolated between centroids. A second pass over the values counts exactly how many lie below and
at each answer; the rank error it proves stands beside the answer and is held against the stated bound.

Digests are plain rows (group, metric, n, least, most, means, weights, tied): those of single days, files or partitions can be stored
and merged later with :func:`merge_digests`.

Defined behaviour: null, negative and impossibly large values are left out (counted by :func:`value_counts`); a null group is a
group; rows equal in id, group and values are one measurement, an id delivered with different values counts once for each; a
group without valid values gives no rows; ties and all-equal columns are exact; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seine.runtime import broadcast_if_small, checkpoint, ship

#: Centroids of a digest, and the largest rank error that an answer may have (or one row's rank, in groups of fewer rows).
DELTA = 800
BOUND = 0.001
#: Milliseconds from which a duration counts as impossible (30 days).
LIMIT_MS = 30 * 86_400_000
QUANTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 0.999)
_FAN = 32
_BUFFER = 1_000_000
_SCHEMA = "metric string, grp string, period string, part int, n bigint, least double, most double, means array<double>, weights array<bigint>, tied array<boolean>"


def _unit(q: np.ndarray, delta: int) -> np.ndarray:
    return delta / np.pi * (np.arcsin(np.clip(2 * q - 1, -1, 1)) + np.pi / 2)


def _runs(change: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, change])


def cluster(groups: np.ndarray, means: np.ndarray, weights: np.ndarray, tied: np.ndarray, delta: int = DELTA) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Merge the centroids of many groups at once: in a group, neighbours whose middle quantiles fall in one unit become one.

    ``tied`` marks centroids that stand for one repeated value. Equal ones are joined first, and one that spans half a unit or
    more is never mixed with its neighbours, so heavy ties stay exact; a group has at most ``2 * delta`` of those.
    Gives groups, means, weights and ties, ordered by group and mean.
    """
    order = np.lexsort((tied, means, groups))
    groups, means, weights, tied = groups[order], means[order], weights[order], tied[order]
    starts = _runs((np.diff(groups) != 0) | (np.diff(means) != 0) | ~(tied[1:] & tied[:-1]))
    weights, means, tied, groups = np.add.reduceat(weights, starts), means[starts], tied[starts], groups[starts]

    other = np.diff(groups) != 0
    first = _runs(other)
    sizes = np.diff(np.r_[first, len(groups)])
    totals = np.repeat(np.add.reduceat(weights, first), sizes)
    ends = np.cumsum(weights)
    ends = ends - np.repeat(ends[first] - weights[first], sizes)
    unit = np.floor(_unit((ends - weights / 2) / totals, delta))
    heavy = tied & (_unit(ends / totals, delta) - _unit((ends - weights) / totals, delta) >= 0.5)
    starts = _runs(other | (np.diff(unit) != 0) | heavy[1:] | heavy[:-1])
    sums = np.add.reduceat(weights, starts)
    # sums of deviations from the cluster's first value keep large values exact
    base = means[starts]
    sizes = np.diff(np.r_[starts, len(means)])
    spread = np.add.reduceat((means - np.repeat(base, sizes)) * weights, starts)
    return groups[starts], base + spread / sums, sums, tied[starts] & (sizes == 1)


def quantiles_of(means: np.ndarray, weights: np.ndarray, tied: np.ndarray, least: float, most: float, ps: np.ndarray) -> np.ndarray:
    """Values at ranks ``ps``: flat over a repeated value, else linear between the middles of neighbouring centroids."""
    ends = np.cumsum(weights).astype(float)
    begins = ends - weights
    middle = begins + weights / 2
    xs, ys = np.empty(2 * len(ends) + 2), np.empty(2 * len(ends) + 2)
    xs[0], ys[0], xs[-1], ys[-1] = 0.0, least, ends[-1], most
    xs[1:-1:2], xs[2:-1:2] = np.where(tied, begins, middle), np.where(tied, ends, middle)
    ys[1:-1:2] = ys[2:-1:2] = means
    return np.interp(ps * ends[-1], xs, ys)


_ARROW = pa.schema(
    [("metric", pa.string()), ("grp", pa.string()), ("period", pa.string()), ("part", pa.int32()), ("n", pa.int64()), ("least", pa.float64()), ("most", pa.float64()), ("means", pa.list_(pa.float64())), ("weights", pa.list_(pa.int64())), ("tied", pa.list_(pa.bool_()))]
)


class _Builder:
    """Digests of many groups, side by side; what has been added is clustered whenever it fills the buffer."""

    def __init__(self, delta: int) -> None:
        self.delta, self.keys, self.parts, self.held = delta, {}, [], 0
        self.least: list[float] = []
        self.most: list[float] = []

    def code(self, key: tuple) -> int:
        k = self.keys.setdefault(key, len(self.keys))
        if k == len(self.least):
            self.least.append(np.inf)
            self.most.append(-np.inf)
        return k

    def ends(self, codes: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> None:
        order = np.argsort(codes, kind="stable")
        starts = _runs(np.diff(codes[order]) != 0)
        for k, lo, hi in zip(codes[order][starts].tolist(), np.minimum.reduceat(lows[order], starts).tolist(), np.maximum.reduceat(highs[order], starts).tolist()):
            self.least[k], self.most[k] = min(self.least[k], lo), max(self.most[k], hi)

    def add(self, groups: np.ndarray, means: np.ndarray, weights: np.ndarray, tied: np.ndarray) -> None:
        self.parts.append((groups, means, weights, tied))
        self.held += len(groups)
        if self.held >= _BUFFER:
            self.parts = [self._joined()]
            # a digest that is full already cannot shrink again: let the buffer grow with what is kept
            self.held = max(0, len(self.parts[0][0]) - _BUFFER // 2)

    def _joined(self) -> tuple[np.ndarray, ...]:
        return cluster(*(np.concatenate(x) for x in zip(*self.parts)), self.delta)

    def batches(self) -> Iterator[pa.RecordBatch]:
        if not self.parts:
            return
        groups, means, weights, tied = self._joined()
        starts = _runs(np.diff(groups) != 0)
        names, which = list(self.keys), groups[starts].tolist()
        ends = np.r_[starts, len(groups)].astype(np.int32)
        columns = [pa.array([names[k][i] for k in which], _ARROW[i].type) for i in range(4)]
        columns += [pa.array(np.add.reduceat(weights, starts), pa.int64()), pa.array([self.least[k] for k in which]), pa.array([self.most[k] for k in which])]
        columns += [pa.ListArray.from_arrays(pa.array(ends), pa.array(x, t)) for x, t in ((means, pa.float64()), (weights, pa.int64()), (tied, pa.bool_()))]
        whole = pa.RecordBatch.from_arrays(columns, schema=_ARROW)
        for i in range(0, whole.num_rows, 4_096):
            yield whole.slice(i, 4_096)


def _build(batches: Iterator[pa.RecordBatch], metrics: list[str], delta: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    context = TaskContext.get()
    part, builder = context.partitionId() if context else 0, _Builder(delta)
    for batch in batches:
        grp, period = (batch.column(i).dictionary_encode() for i in (0, 1))
        g_names, p_names = grp.dictionary.to_pylist(), period.dictionary.to_pylist()
        g = grp.indices.fill_null(len(g_names)).to_numpy(zero_copy_only=False).astype(np.int64)
        p = period.indices.fill_null(len(p_names)).to_numpy(zero_copy_only=False).astype(np.int64)
        g_names, p_names = [*g_names, None], [*p_names, None]
        pairs, place = np.unique(g * len(p_names) + p, return_inverse=True)
        for i, metric in enumerate(metrics):
            values = batch.column(2 + i).to_numpy(zero_copy_only=False).astype(float)
            kept = ~np.isnan(values)
            if not kept.any():
                continue
            codes = np.array([builder.code((metric, g_names[k // len(p_names)], p_names[k % len(p_names)], part)) for k in pairs.tolist()], np.int64)[place[kept]]
            values = values[kept]
            builder.ends(codes, values, values)
            builder.add(codes, values, np.ones(len(values), np.int64), np.ones(len(values), bool))
    # groups without a valid value were only named
    yield from builder.batches()


def _merge(batches: Iterator[pa.RecordBatch], delta: int) -> Iterator[pa.RecordBatch]:
    """Merge the rows of a partition that have equal (metric, grp, period, part)."""
    builder = _Builder(delta)
    for batch in batches:
        codes = np.array([builder.code(k) for k in zip(*(batch.column(i).to_pylist() for i in range(4)))], np.int64)
        if not len(codes):
            continue
        builder.ends(codes, batch.column(5).to_numpy(zero_copy_only=False), batch.column(6).to_numpy(zero_copy_only=False))
        lists = [batch.column(i) for i in (7, 8, 9)]
        means, weights, tied = (x.flatten().to_numpy(zero_copy_only=False) for x in lists)
        builder.add(np.repeat(codes, np.diff(lists[0].offsets.to_numpy())), means, weights.astype(np.int64), tied.astype(bool))
    yield from builder.batches()


def merge_digests(digests: DataFrame, delta: int = DELTA, by_period: bool = False, most_parts: int | None = None) -> DataFrame:
    """Merge digests of the same metric and group (and period): first within ``part`` modulo a fan, then over all.

    Where it is known that a group has no more than ``most_parts`` digests, and these are few, the first level is left out.
    """
    ship(digests.sparkSession)
    keys = ["metric", "grp", "period", "part"]
    out = digests if by_period else digests.withColumn("period", F.lit(None).cast("string"))
    levels = [F.pmod("part", F.lit(_FAN)).cast("int"), F.lit(0)]
    for part in levels[1:] if most_parts is not None and most_parts <= _FAN else levels:
        out = out.withColumn("part", part).repartition(*keys).mapInArrow(lambda it: _merge(it, delta), _SCHEMA)
    return out


def valid(value: Column, limit: int = LIMIT_MS) -> Column:
    return F.when((value >= 0) & (value < limit), value)


def measurements(df: DataFrame, id_column: str, group: str, period: Column, metrics: dict[str, Column], limit: int = LIMIT_MS) -> DataFrame:
    """(grp, period, one valid column per metric), each delivered measurement once. Written once: it is read for digests and for proofs."""
    wanted = df.select(F.col(id_column).alias("id"), F.col(group).cast("string").alias("grp"), period.cast("string").alias("period"), *[valid(c, limit).alias(m) for m, c in metrics.items()])
    return checkpoint(wanted.distinct().drop("id"))


def digests(values: DataFrame, metrics: list[str], delta: int = DELTA) -> DataFrame:
    """Partial digests, one per partition, period, group and metric."""
    ship(values.sparkSession)
    return values.select("grp", "period", *metrics).mapInArrow(lambda it: _build(it, metrics, delta), _SCHEMA)


def percentiles(merged: DataFrame, quantiles: tuple[float, ...] = QUANTILES) -> DataFrame:
    """(metric, grp, period, xs) beside each digest: its answers, one for each of ``quantiles``."""

    ship(merged.sparkSession)
    ps = np.asarray(quantiles)

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            yield f.assign(xs=[quantiles_of(np.asarray(r.means), np.asarray(r.weights), np.asarray(r.tied), r.least, r.most, ps) for r in f.itertuples()])

    return merged.drop("part").mapInPandas(answer, _SCHEMA.replace("part int, ", "") + ", xs array<double>")


def _wide(answers: DataFrame, names: list[str], metrics: list[str], prefix: str) -> DataFrame:
    """One row per group with the answers of every metric; broadcast only within measured bounds."""
    wide = answers.groupBy(*[F.col(c).alias(f"{prefix}_{c}") for c in names]).agg(*[F.first(F.when(F.col("metric") == m, F.col("xs")), ignorenulls=True).alias(f"{prefix}_{m}") for m in metrics])
    return broadcast_if_small(wide)


def certify(values: DataFrame, daily: DataFrame, joined: DataFrame, metrics: list[str], bound: float = BOUND, quantiles: tuple[float, ...] = QUANTILES) -> DataFrame:
    """The counting pass: how many values lie below and at each answer, exactly, for the periods and for all of them in one go.

    Gives the answers' rows with ``counted`` values, ``found`` (p, value, below, upto, rank_error per quantile), the largest
    ``rank_error`` and whether it is ``within_bound`` (``bound``, or one row's rank in smaller groups).
    """
    # one row per group with the answers of every metric; its size is measured before it is broadcast
    by_day, by_group = _wide(daily, ["grp", "period"], metrics, "d"), _wide(joined, ["grp"], metrics, "g")
    held = values.join(by_day, F.col("grp").eqNullSafe(F.col("d_grp")) & F.col("period").eqNullSafe(F.col("d_period")), "left").join(by_group, F.col("grp").eqNullSafe(F.col("g_grp")), "left")
    each = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v"), F.col(f"d_{m}").alias("ds"), F.col(f"g_{m}").alias("gs")) for m in metrics]
    long = held.select("grp", "period", F.inline(F.array(*each))).where("v IS NOT NULL")

    def passed(xs: str, op) -> Column:
        """How many answers lie below a value (or at or below it)."""
        return F.coalesce(sum((op(F.col(xs)[i]).cast("int") for i in range(1, len(quantiles))), op(F.col(xs)[0]).cast("int")), F.lit(0))

    # these are steps along the values: a group has few distinct ones, and only their counts are shuffled
    steps = [passed(xs, op).alias(f"{name}_{xs}") for xs in ("ds", "gs") for name, op in (("over", lambda x: F.col("v") > x), ("from", lambda x: F.col("v") >= x))]
    counted = long.groupBy("metric", "grp", "period", *steps).count()

    def proved(answers: DataFrame, names: list[str], xs: str) -> DataFrame:
        per_group = counted.groupBy(F.col("metric").alias("m"), *[F.col(c).alias(f"c_{c}") for c in names]).agg(
            F.sum("count").alias("counted"),
            *[F.sum(F.when(F.col(f"from_{xs}") <= i, F.col("count")).otherwise(0)).alias(f"below{i}") for i in range(len(quantiles))],
            *[F.sum(F.when(F.col(f"over_{xs}") <= i, F.col("count")).otherwise(0)).alias(f"upto{i}") for i in range(len(quantiles))],
        )
        on = F.col("metric") == F.col("m")
        for c in names:
            on = on & F.col(c).eqNullSafe(F.col(f"c_{c}"))

        def proof(i: int, p: float) -> Column:
            below, upto, n = F.col(f"below{i}"), F.col(f"upto{i}"), F.col("counted")
            error = F.greatest(F.lit(0.0), below / n - p, p - upto / n)
            return F.struct(F.lit(float(p)).alias("p"), F.col("xs")[i].alias("value"), below.alias("below"), upto.alias("upto"), error.alias("rank_error"))

        found = F.array(*[proof(i, p) for i, p in enumerate(quantiles)]).alias("found")
        return answers.join(per_group, on).select("metric", "grp", "period", "n", "counted", found, "least", "most", "means", "weights", "tied")

    rows = proved(daily, ["grp", "period"], "ds").withColumn("whole", F.lit(False)).unionByName(proved(joined, ["grp"], "gs").withColumn("whole", F.lit(True)))
    worst = F.array_max(F.transform("found", lambda f: f["rank_error"]))
    return rows.withColumn("rank_error", worst).withColumn("within_bound", worst <= F.greatest(F.lit(bound), 1 / F.col("n")))


def _answered(values: DataFrame, metrics: list[str], delta: int, bound: float) -> DataFrame:
    parts = values.rdd.getNumPartitions()
    daily = checkpoint(percentiles(merge_digests(digests(values, metrics, delta), delta, by_period=True, most_parts=parts)))
    spread = daily.drop("xs").withColumn("part", F.pmod(F.xxhash64("period"), F.lit(1 << 16)).cast("int"))
    joined = checkpoint(percentiles(merge_digests(spread.select(*[c.split()[0] for c in _SCHEMA.split(", ")]), delta)))
    return checkpoint(certify(values, daily, joined, metrics, bound))


def by_period_and_joined(values: DataFrame, metrics: list[str], delta: int = DELTA, bound: float = BOUND) -> DataFrame:
    """Certified answers and digests for every period, and for all periods (``whole``, null period) joined from the periods' digests.

    Groups with an answer that the count proves to be outside the bound are done again with digests four times as fine, until none
    is left; digests as fine as their values are exact.
    """
    out = _answered(values, metrics, delta, bound)
    good = out.where("within_bound")
    while (bad := out.where("NOT within_bound").select("metric", "grp").distinct()).limit(1).count():
        delta *= 4
        names = bad.groupBy(F.col("grp").alias("b")).agg(F.collect_set("metric").alias("again"))
        some = values.join(names, F.col("grp").eqNullSafe(F.col("b"))).select("grp", "period", *[F.when(F.array_contains("again", m), F.col(m)).alias(m) for m in metrics])
        finer = _answered(checkpoint(some), metrics, delta, bound)
        at = ["metric", "grp", "period", "whole"]
        wanted = out.where("NOT within_bound").select(*[F.col(c).alias(f"w_{c}") for c in at])
        match = F.lit(True)
        for c in at:
            match = match & F.col(c).eqNullSafe(F.col(f"w_{c}"))
        out = checkpoint(finer.join(wanted, match, "left_semi"))
        good = good.unionByName(out.where("within_bound"))
    return good


def value_counts(df: DataFrame, id_column: str, group: str, metrics: dict[str, Column], limit: int = LIMIT_MS) -> DataFrame:
    """What was left out: (metric, group, n_valid, n_null, n_impossible) over distinct measurements."""
    rows = df.select(F.col(id_column).alias("id"), F.col(group).alias("group"), *[c.alias(m) for m, c in metrics.items()]).distinct()
    long = rows.select("group", F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in metrics])))
    ok = (F.col("v") >= 0) & (F.col("v") < limit)
    return long.groupBy("metric", "group").agg(F.count_if(ok).alias("n_valid"), F.count_if(F.col("v").isNull()).alias("n_null"), F.count_if(~ok).alias("n_impossible"))
