"""Immutable generations: a table is written beside its predecessors and becomes current by one pointer rename.

Readers resolve the pointer once and then read one directory; a query never sees half a publication. One writer is assumed.
Pointers and manifests are small JSON files written through the Hadoop file system of the path, so shared stores work.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Generations:
    """Generations of one table under ``root``."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _write(self, name: str, body: dict) -> None:
        """Write beside, then rename over: a reader finds the old file or the new one."""
        target, beside = self._path(f"{self.root}/{name}"), self._path(f"{self.root}/.{name}-{uuid.uuid4().hex}")
        out = self._fs.create(beside, True)
        out.write(bytearray(json.dumps(body, sort_keys=True).encode()))
        out.close()
        sc = self.spark.sparkContext
        over = getattr(sc._jvm.org.apache.hadoop.fs, "Options$Rename")
        options = sc._gateway.new_array(over, 1)
        options[0] = over.OVERWRITE
        context = sc._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), sc._jsc.hadoopConfiguration())
        context.rename(self._fs.makeQualified(beside), self._fs.makeQualified(target), options)

    def _read(self, name: str) -> dict | None:
        path = self._path(f"{self.root}/{name}")
        if not self._fs.exists(path):
            return None
        source = self._fs.open(path)
        body = bytes(source.readAllBytes())
        source.close()
        return json.loads(body)

    def current(self) -> str | None:
        found = self._read("CURRENT")
        return found["generation"] if found else None

    def stage(self, df: DataFrame, partition_by: list[str] | None = None, sort_by: list[str] | None = None) -> str:
        """Write a generation that nobody reads yet; sorted files make pruning by statistics work."""
        name = uuid.uuid4().hex
        out = df if not sort_by else df.sortWithinPartitions(*sort_by)
        writer = out.write.mode("errorifexists")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{self.root}/{name}")
        self._write(f"{name}.json", self.manifest(name))
        return name

    def manifest(self, name: str) -> dict:
        df = self.spark.read.parquet(f"{self.root}/{name}")
        row = df.agg(F.count("*").alias("rows"), F.sum(F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)")).alias("digest")).first()
        return {"rows": row["rows"], "digest": str(row["digest"] or 0), "schema": df.schema.json()}

    def publish(self, name: str, expected: str | None = None) -> str | None:
        """Make a staged generation current; returns what it supersedes. ``expected`` fences a late writer."""
        before = self.current()
        if expected is not None and before != expected:
            raise RuntimeError("another generation was published meanwhile")
        if self._read(f"{name}.json") is None:
            raise FileNotFoundError(f"generation {name} was not staged")
        self._write("CURRENT", {"generation": name, "superseded": before})
        return before

    def read(self, name: str | None = None) -> DataFrame:
        name = name or self.current()
        if name is None:
            raise FileNotFoundError(f"nothing is published under {self.root}")
        return self.spark.read.parquet(f"{self.root}/{name}")

    def verify(self, name: str | None = None) -> bool:
        """The files still hold what the manifest recorded."""
        name = name or self.current()
        return name is not None and self.manifest(name) == self._read(f"{name}.json")

    def archive(self, target: str, name: str | None = None) -> str:
        """Copy a verified generation with its manifest into another root."""
        name = name or self.current()
        if not self.verify(name):
            raise ValueError(f"generation {name} does not match its manifest")
        other = Generations(self.spark, target)
        self.read(name).write.mode("errorifexists").parquet(f"{other.root}/{name}")
        other._write(f"{name}.json", self._read(f"{name}.json"))
        if not other.verify(name):
            raise ValueError("the copy does not match")
        return name

    def sweep(self, keep: set[str]) -> list[str]:
        """Delete generations that are neither current nor kept."""
        held = {*keep, self.current()}
        gone = []
        for s in self._fs.listStatus(self._path(self.root)):
            name = s.getPath().getName()
            if s.isDirectory() and name not in held and not name.startswith((".", "_")):
                self._fs.delete(s.getPath(), True)
                self._fs.delete(self._path(f"{self.root}/{name}.json"), False)
                gone.append(name)
        return sorted(gone)


def append(df: DataFrame, path: str, day: str | None = None) -> None:
    """Append events, partitioned by day if a timestamp column is named."""
    if day is None:
        df.write.mode("append").parquet(path)
    else:
        df.withColumn("day", F.date_format(day, "yyyy-MM-dd")).write.mode("append").partitionBy("day").parquet(path)


def bundle(rows: DataFrame, kind: str) -> DataFrame:
    """Content-addressed immutable answers: (bundle_id, kind, body), one per row."""
    body = F.to_json(F.struct(*sorted(rows.columns)))
    return rows.select(F.concat(F.lit("pb_"), F.sha2(F.concat(F.lit(kind), F.lit("\0"), body), 256)).alias("bundle_id"), F.lit(kind).alias("kind"), body.alias("body")).dropDuplicates(["bundle_id"])
