"""Checkpoints and measured broadcasts."""

import gc
import time
from pathlib import Path

from pyspark.sql import functions as F

from seine import runtime


def test_checkpoints_go_with_their_frames(spark):
    folder = Path(runtime.ensure_checkpoint_dir(spark).removeprefix("file:"))
    kept = runtime.checkpoint(spark.range(10))
    gone = runtime.checkpoint(spark.range(20))
    derived = kept.where("id > 3")
    before = sum(1 for p in folder.rglob("rdd-*"))
    del kept, gone
    for _ in range(60):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)
        if sum(1 for p in folder.rglob("rdd-*")) < before:
            break
    assert sum(1 for p in folder.rglob("rdd-*")) < before
    assert derived.count() == 6


def test_broadcasts_are_measured_in_rows_and_bytes(spark):
    def hinted(df, **bounds):
        return "ResolvedHint" in runtime.broadcast_if_small(df, **bounds)._jdf.queryExecution().analyzed().toString()

    short, long = spark.range(10), spark.range(10).select(F.repeat(F.lit("x"), 1000).alias("t"))
    assert hinted(short) and hinted(long)
    assert not hinted(short, max_rows=9) and not hinted(long, max_bytes=5_000) and hinted(long, max_bytes=20_000)
    assert hinted(short.limit(0))
