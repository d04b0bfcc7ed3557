"""A trigram index that cuts the files a search has to read.

The index is a table (gram, key): every distinct trigram of a file's lower-cased path and content. Written sorted by gram, its
row-group statistics let a query read only the grams it needs. A query's candidates are the files that hold all trigrams of its
required plain terms; they are a superset of the matches, so the search itself stays exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seine.io import Generations
from seine.plans.query_language import All, Parsed, Text, parse
from seine.plans.search import search
from seine.runtime import ship

GRAM = 3
#: Candidates up to which their keys are written into the plan.
PUSHED_MOST = 1_000


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, key) of every distinct trigram of each text."""
    for batch in batches:
        grams: list[str] = []
        sizes = []
        for text in batch.column(1).to_pylist():
            own = {text[i : i + GRAM] for i in range(len(text) - GRAM + 1)}
            grams += own
            sizes.append(len(own))
        keys = batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), sizes)))
        yield pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), keys], names=["gram", "key"])


def build(files: DataFrame, key: str) -> DataFrame:
    """(gram, key) of every file; null contents and paths count as empty."""
    ship(files.sparkSession)
    # the three letters that a case-insensitive pattern takes for an ASCII letter though their lower case is none
    raw = F.concat(F.coalesce("path", F.lit("")), F.lit("\n"), F.coalesce("content", F.lit("")))
    texts = files.select(F.col(key).alias("key"), F.lower(F.translate(raw, "İıſ", "iis")).alias("text"))
    return texts.mapInArrow(_grams, f"gram string, key {texts.schema['key'].dataType.simpleString()}")


def publish(files: DataFrame, key: str, root: str) -> Generations:
    """Write the index as a generation sorted by gram and make it current."""
    store = Generations(files.sparkSession, root)
    index = build(files, key).repartitionByRange("gram")
    store.publish(store.stage(index, sort_by=["gram", "key"]))
    return store


def required(parsed: Parsed) -> set[str]:
    """Trigrams that every match must hold: those of plain terms that stand alone or side by side, none of alternatives."""
    parts = parsed.tree.parts if isinstance(parsed.tree, All) else (parsed.tree,)
    out: set[str] = set()
    for p in parts:
        if isinstance(p, Text) and not p.regex:
            t = p.pattern.lower()
            # only text whose case folds letter by letter is sure to be found as it was indexed
            if t.isascii():
                out |= {t[i : i + GRAM] for i in range(len(t) - GRAM + 1)}
    return out


def candidates(index: DataFrame, raw: str) -> DataFrame | None:
    """Keys of the files that can match, or null if the query requires no trigram."""
    grams = sorted(required(parse(raw)))
    if not grams:
        return None
    held = index.where(F.col("gram").isin(*grams))
    return held.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") == len(grams)).select("key")


def narrowed(files: DataFrame, index: DataFrame, key: str, raw: str, pushed_most: int = PUSHED_MOST) -> DataFrame:
    """The files that can match. Few candidates are written into the plan, so that the scan itself skips what it can by its
    statistics; beyond ``pushed_most`` the same files are met by a semi join."""
    found = candidates(index, raw)
    if found is None:
        return files
    some = [r[0] for r in found.limit(pushed_most + 1).collect()]
    if len(some) <= pushed_most:
        return files.where(F.col(key).isin(*some)) if some else files.where(F.lit(False))
    return files.join(found.withColumnRenamed("key", key), key, "left_semi")


def indexed_search(files: DataFrame, index: DataFrame, key: str, raw: str, max_matches: int | None = None, **scope) -> DataFrame:
    """As :func:`seine.plans.search.search`, over the candidates only; ties by key."""
    return search(narrowed(files, index, key, raw), raw, max_matches, key, **scope)
