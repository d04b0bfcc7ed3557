"""Session-level helpers: table loading, checkpoints in the shared folder, size-checked broadcast."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes up to which a side may be broadcast after it has been measured.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one Parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder; set a local one only for local sessions that name none."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="seine-checkpoint-")
    sc.setCheckpointDir(named)
    return named


def checkpoint(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage.

    Its files go when no frame refers to them any more, unless the session's settings say otherwise.
    """
    ensure_checkpoint_dir(df.sparkSession)
    df.sparkSession.sparkContext._jsc.sc().conf().setIfMissing("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    return df.checkpoint(eager=True)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per context, so that Python stages import it wherever they run."""
    sc = spark.sparkContext
    if getattr(sc, "_seine_shipped", False):
        return
    here = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="seine-package-")) / "seine.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(here.rglob("*.py")):
            z.write(f, str(f.relative_to(here.parent)))
    sc.addPyFile(str(archive))
    sc._seine_shipped = True


def measured_size(df: DataFrame, max_rows: int) -> tuple[int, int]:
    """(rows, bytes as written in JSON) of the first ``max_rows + 1`` rows of ``df``."""
    probe = df.limit(max_rows + 1).select(F.octet_length(F.to_json(F.struct(*df.columns))).cast("long").alias("b"))
    rows, size = probe.agg(F.count("*"), F.coalesce(F.sum("b"), F.lit(0))).first()
    return rows, size


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only when a bounded probe proves ``df`` to be within ``max_rows`` rows and ``max_bytes`` bytes.

    The probe reads no more than ``max_rows + 1`` rows; beyond the bounds the plain frame is returned and the join
    is planned as a shuffle (with adaptive skew handling).
    """
    rows, size = measured_size(df, max_rows)
    return F.broadcast(df) if rows <= max_rows and size <= max_bytes else df
