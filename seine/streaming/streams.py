"""Structured Streaming forms: change detection, de-duplicated triggers, daily usage windows, the job state machine."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from seine.runtime import ship


#: Event time after which the state of a silent key is dropped (30 days), and how late a row may come.
KEEP_MS = 30 * 86_400_000
LATE = "1 day"


def _forget_at(state: GroupState, last: pd.Timestamp, keep_ms: int) -> None:
    """The state goes when the watermark passes the last row's time and ``keep_ms``."""
    state.setTimeoutTimestamp(max(int(last.timestamp() * 1000) + keep_ms, state.getCurrentWatermarkMs() + 1))


def revision_changes(polls: DataFrame, keep_ms: int = KEEP_MS) -> DataFrame:
    """Polls (repo, fingerprint, polled_at) whose fingerprint differs from the last one seen of their repository.

    The first sight of a repository is a change, also after ``keep_ms`` of event time without a poll. State is one fingerprint per repository.
    """
    columns = ["repo", "fingerprint", "polled_at"]

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values("polled_at", kind="stable")
        before = rows["fingerprint"].shift(1)
        first = not state.exists
        before.iloc[0] = None if first else state.get[0]
        state.update((rows["fingerprint"].iloc[-1],))
        _forget_at(state, rows["polled_at"].iloc[-1], keep_ms)
        # two nulls are no change
        same = (rows["fingerprint"] == before) | (rows["fingerprint"].isna() & before.isna())
        same.iloc[0] &= not first
        yield rows.loc[~same, columns]

    ship(polls.sparkSession)
    timed = polls.withWatermark("polled_at", LATE)
    return timed.groupBy("repo").applyInPandasWithState(step, "repo string, fingerprint string, polled_at timestamp", "fingerprint string", "append", GroupStateTimeout.EventTimeTimeout)


def push_triggers(deliveries: DataFrame, delay: str = "1 day") -> DataFrame:
    """Webhook deliveries (delivery_id, repo, ref, received_at), each acted on once within the delay."""
    return deliveries.withWatermark("received_at", delay).dropDuplicatesWithinWatermark(["delivery_id"]).select("repo", "ref", "received_at")


def usage_by_day(events: DataFrame, ts: str, kind: str, late: str = "2 days") -> DataFrame:
    """Daily counts by kind with a watermark (an extension of the dashboard)."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, "1 day").alias("w"), F.col(kind)).agg(F.count("*").alias("n")).select(F.col("w.start").alias("day_start"), kind, "n")


# allowed moves of a job
MOVES = {"pending": {"claimed", "canceled"}, "claimed": {"running", "pending", "canceled"}, "running": {"done", "failed", "canceled", "pending"}}


def fold_jobs(events: pd.DataFrame, status: str, attempts: int) -> tuple[str, int, int]:
    """(status, attempts, refused) after a job's events in order; a move that is not allowed is refused."""
    refused = 0
    for e in events.itertuples():
        if e.to_status in MOVES.get(status, ()):
            attempts += e.to_status == "claimed"
            status = e.to_status
        else:
            refused += 1
    return status, attempts, refused


def job_states(events: DataFrame, at: str | None = None, keep_ms: int = KEEP_MS) -> DataFrame:
    """Running state of each job from its events (job_id, seq, to_status).

    Where the events have a time column ``at``, a job without an event for ``keep_ms`` of event time loses its state, whether it is
    finished or lost; without one there is no clock to forget by.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values("seq", kind="stable")
        status, attempts, refused = state.get if state.exists else ("pending", 0, 0)
        status, attempts, more = fold_jobs(rows, status, attempts)
        state.update((status, attempts, refused + more))
        if at:
            _forget_at(state, rows[at].max(), keep_ms)
        yield pd.DataFrame([(key[0], status, attempts, refused + more)], columns=["job_id", "status", "attempts", "refused"])

    ship(events.sparkSession)
    schema = "job_id bigint, status string, attempts int, refused int"
    timed = events.withWatermark(at, LATE) if at else events
    return timed.groupBy("job_id").applyInPandasWithState(step, schema, "status string, attempts int, refused int", "update", GroupStateTimeout.EventTimeTimeout if at else GroupStateTimeout.NoTimeout)


def to_generation(stream: DataFrame, root: str, checkpoint: str):
    """Write a stream to a folder of files; re-delivered batches replace themselves."""
    return stream.writeStream.format("parquet").option("path", root).option("checkpointLocation", checkpoint).outputMode("append")
