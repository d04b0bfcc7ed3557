"""References to records that do not exist, or do not exist at the time of the reference.

Parent and child keys go into one long table, tagged, and are grouped by parent table and key: groups without the parent flag are
the keys that exist nowhere, and every reference to them is an orphan (partial aggregation combines hot keys before the shuffle).

Only references whose key has parents undergo the test of time: a key is valid at time ``t`` while more of its parent rows have
begun than ended. Starts, ends and references are sorted over the whole cluster by (key, time), so that a busy key, and a busy
moment of it, is cut wherever the sizes demand; each piece is a slot. A slot reports its first and last key and the balance of the
last; from these few rows the balance carried into each slot is known, and running sums over the sorted slots, in Arrow batches,
decide every reference without another shuffle.

Defined behaviour
    * A parent row is valid from ``start`` on and before ``end``; a null ``end`` is open; a null ``start`` or an ``end`` not
      after ``start`` is never valid, though its key still exists. Repeated parent rows change nothing.
    * A reference with a null time is a case only if no parent row carries its key.
    * Keys are compared after removing blanks, tabs and line ends at both ends. Null and blank keys are no case.
    * Reasons: ``missing`` (no parent row at all), ``not_yet`` (no parent has begun), ``deleted`` (some had begun).
    * Repeated references are separate rows. Empty tables give no rows; further columns of the inputs are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seine.runtime import checkpoint, ship

#: Characters removed at both ends of a key.
KEY_BLANKS = " \t\r\n"
# What a row of the sweep is: a start, an end, or a reference (two numbers per child: known key, missing key).
_START, _END, _CHILD = 0, 1, 2
_ENDS = pa.schema([("slot", pa.int32()), ("parent", pa.int32()), ("key", pa.string()), ("last_parent", pa.int32()), ("last_key", pa.string()), ("valid", pa.int64()), ("ever", pa.int64())])


@dataclass(frozen=True)
class Parent:
    """A table that is referred to: its name, its frame, and its key, start and end columns."""

    name: str
    frame: DataFrame
    key: str
    start: str
    end: str


@dataclass(frozen=True)
class Child:
    """A referring table: its name in the report, its frame, its id, key and time columns, and the table it refers to."""

    name: str
    frame: DataFrame
    row_id: str
    key: str
    time: str
    parent: str


def clean_key(column: Column) -> Column:
    trimmed = F.btrim(column, F.lit(KEY_BLANKS))
    return F.when(trimmed != "", trimmed)


def _micros(column: Column) -> Column:
    return F.unix_micros(column.cast("timestamp"))


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames).where(F.col("key").isNotNull())


def _references(children: list[Child], names: list[str]) -> DataFrame:
    """References in long form; tables are numbers: of the parent in ``names``, of the child in ``children``."""
    return _union(
        [
            c.frame.select(F.lit(names.index(c.parent)).alias("parent"), clean_key(F.col(c.key)).alias("key"), F.lit(i).alias("child"), F.col(c.row_id).cast("long").alias("row_id"), _micros(F.col(c.time)).alias("at"))
            for i, c in enumerate(children)
        ]
    )


def _spans(parents: list[Parent], names: list[str]) -> DataFrame:
    return _union([p.frame.select(F.lit(names.index(p.name)).alias("parent"), clean_key(F.col(p.key)).alias("key"), _micros(F.col(p.start)).alias("s"), _micros(F.col(p.end)).alias("e")) for p in parents])


def grouped_keys(parents: list[Parent], children: list[Child], names: list[str]) -> DataFrame:
    """(parent, key, has_parent): every key of either side in long form, grouped by parent table and key, with the parent flag."""
    tagged = _spans(parents, names).select("parent", "key", F.lit(True).alias("is_parent")).unionByName(_references(children, names).select("parent", "key", F.lit(False).alias("is_parent")))
    return tagged.groupBy("parent", "key").agg(F.max("is_parent").alias("has_parent"))


def _boundaries(batch: pa.RecordBatch, last: tuple | None) -> tuple[np.ndarray, bool]:
    """First rows of the runs of equal (parent, key) in a sorted batch, and whether the first run goes on from ``last``."""
    parent, key = batch.column("parent").to_numpy(), batch.column("key")
    n = batch.num_rows
    changed = (np.diff(parent) != 0) | pc.not_equal(key.slice(1), key.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    return np.flatnonzero(np.r_[True, changed]), last == (int(parent[0]), key[0].as_py())


def _sweep(batches: Iterator[pa.RecordBatch], carried: dict[int, tuple[int, int]]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Each batch of a slot with the running numbers of valid and of begun parent rows, and the first rows of its keys.

    ``carried`` are the numbers that earlier slots hold for the first key of each slot.
    """
    last, state = None, (0, 0)
    for batch in batches:
        if not batch.num_rows:
            continue
        if last is None:
            state = carried.get(batch.column("slot")[0].as_py(), (0, 0))
        what = batch.column("what").to_numpy()
        begun = (what == _START).astype(np.int64)
        runs, goes_on = _boundaries(batch, last)
        sizes = np.diff(np.r_[runs, len(what)])
        sums = []
        for i, step in enumerate((begun - (what == _END), begun)):
            total = np.cumsum(step)
            base = total[runs] - step[runs]
            if goes_on or last is None:
                base[0] -= state[i]
            sums.append(total - np.repeat(base, sizes))
        yield batch, sums[0], sums[1], runs
        last = (int(batch.column("parent")[-1].as_py()), batch.column("key")[-1].as_py())
        state = (sums[0][-1], sums[1][-1])


def _ends_of_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per slot: its first and last key and the balance of the last one inside the slot."""
    first = row = None
    for batch, valid, ever, _ in _sweep(batches, {}):
        keys = [(batch.column("parent")[i].as_py(), batch.column("key")[i].as_py()) for i in (0, -1)]
        first = first or (batch.column("slot")[0].as_py(), *keys[0])
        row = (*keys[1], int(valid[-1]), int(ever[-1]))
    if first:
        yield pa.RecordBatch.from_pydict({n: [v] for n, v in zip(_ENDS.names, (*first, *row))}, schema=_ENDS)


def carried_balances(ends: list[tuple]) -> dict[int, tuple[int, int]]:
    """Slot -> what the slots before it hold for its first key, from the one row per slot of :func:`_ends_of_slots`."""
    out: dict[int, tuple[int, int]] = {}
    open_key, valid, ever = None, 0, 0
    for slot, *names, n_valid, n_ever in sorted(ends):
        first, last = tuple(names[:2]), tuple(names[2:])
        if first == open_key:
            out[slot] = (valid, ever)
        if first != last or first != open_key:
            valid = ever = 0
        open_key, valid, ever = last, valid + n_valid, ever + n_ever
    return out


def _orphans_in(batches: Iterator[pa.RecordBatch], carried: dict[int, tuple[int, int]], reasons: pa.Array) -> Iterator[pa.RecordBatch]:
    for batch, valid, ever, _ in _sweep(batches, carried):
        what = batch.column("what").to_numpy()
        missing = (what >= _CHILD) & ((what - _CHILD) % 2 == 1)
        case = missing | ((what >= _CHILD) & (valid <= 0))
        code = np.where(missing, 0, np.where(ever > 0, 2, 1))[case]
        kept = batch.filter(pa.array(case))
        child = pa.array((what[case] - _CHILD) // 2, pa.int32())
        yield pa.RecordBatch.from_arrays([kept.column("parent"), child, kept.column("row_id"), kept.column("key"), kept.column("at"), reasons.take(pa.array(code))], names=["parent", "child", "row_id", "key", "at", "reason"])


def orphan_references(parents: list[Parent], children: list[Child], slots: int | None = None) -> DataFrame:
    """Rows of ``children`` without a valid parent: parent_table, ref_table, row_id, key, at (microseconds, null if unknown), reason.

    ``slots`` is the number of pieces the sweep is cut into; the session's shuffle partitions if not given.
    """
    spark = children[0].frame.sparkSession
    ship(spark)
    names = list(dict.fromkeys([*(p.name for p in parents), *(c.parent for c in children)]))
    kids = _references(children, names).join(grouped_keys(parents, children, names), ["parent", "key"])
    kids = kids.where(~F.col("has_parent") | F.col("at").isNotNull())
    kids = kids.select("parent", "key", "at", (F.lit(_CHILD) + 2 * F.col("child") + F.when(F.col("has_parent"), 0).otherwise(1)).cast("int").alias("what"), "row_id")

    spans = _spans(parents, names).where(F.col("s").isNotNull() & (F.col("e").isNull() | (F.col("e") > F.col("s"))))
    both = F.array(F.struct(F.col("s").alias("at"), F.lit(_START).alias("what")), F.struct(F.col("e").alias("at"), F.lit(_END).alias("what")))
    # equal starts and ends may be many: a random number lets the cut fall between them, which changes no sum
    spread = (F.rand(1) * F.lit(1 << 40)).cast("long").alias("row_id")
    marks = spans.select("parent", "key", F.inline(both)).where(F.col("at").isNotNull()).select("parent", "key", "at", "what", spread)

    # a parent is valid from its start on and before its end: marks come before references of the same time
    order = ["parent", "key", "at", "what", "row_id"]
    pieces = slots or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the cut is taken from a sample of the data; it is written once so that all that follows sees the same slots
    cut = checkpoint(marks.unionByName(kids).repartitionByRange(pieces, *order).sortWithinPartitions(*order).withColumn("slot", F.spark_partition_id()))
    ends = cut.mapInArrow(_ends_of_slots, "slot int, parent int, key string, last_parent int, last_key string, valid bigint, ever bigint")
    carried = carried_balances([tuple(r) for r in ends.collect()])  # one row per slot
    reasons = pa.array(["missing", "not_yet", "deleted"])
    found = cut.mapInArrow(lambda it: _orphans_in(it, carried, reasons), "parent int, child int, row_id bigint, key string, at bigint, reason string")

    def named(values: list[str], code: str) -> Column:
        return F.array(*[F.lit(v) for v in values])[F.col(code)]

    return found.select(named(names, "parent").alias("parent_table"), named([c.name for c in children], "child").alias("ref_table"), "row_id", "key", "at", "reason")


def orphan_counts(orphans: DataFrame, children: list[Child]) -> DataFrame:
    """References and orphans per table and month of the reference (null where the time is unknown)."""
    month = F.date_format(F.timestamp_micros(F.col("at")), "yyyy-MM")
    names = F.array(*[F.lit(c.name) for c in children])
    seen = _references(children, [c.parent for c in children]).select(names[F.col("child")].alias("ref_table"), month.alias("period"), F.lit(1).alias("refs"), F.lit(0).alias("bad"), F.lit("").alias("reason"))
    bad = orphans.select("ref_table", month.alias("period"), F.lit(0).alias("refs"), F.lit(1).alias("bad"), "reason")

    def count(reason: str) -> Column:
        return F.sum(F.when(F.col("reason") == reason, 1).otherwise(0)).cast("long").alias(reason)

    return (
        seen.unionByName(bad)
        .groupBy("ref_table", "period")
        .agg(F.sum("refs").cast("long").alias("n_references"), F.sum("bad").cast("long").alias("n_orphans"), count("missing"), count("not_yet"), count("deleted"))
    )
