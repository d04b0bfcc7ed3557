"""SCIP code indexes: the protobuf file decoded to tables of documents, occurrences, symbols and relationships.

A minimal reader of the wire format for the published message numbers, run once per file in Arrow batches over ``binaryFile``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seine.runtime import ship

MAX_BYTES = 512 << 20
SCHEMA = """index_path string, path string, language string,
occurrences array<struct<symbol string, start_line int, start_col int, end_line int, end_col int, roles int, override_documentation string>>,
symbols array<struct<symbol string, documentation string, relationships array<struct<related string, is_reference boolean, is_implementation boolean, is_type_definition boolean, is_definition boolean>>>>, error string"""


class Malformed(ValueError):
    """The bytes are not a well-formed message."""


def _varint(buf: memoryview, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        if at >= len(buf) or shift > 63:
            raise Malformed("bad varint")
        b = buf[at]
        value |= (b & 0x7F) << shift
        at += 1
        if b < 0x80:
            return value, at
        shift += 7


def fields(buf: memoryview) -> Iterator[tuple[int, int | memoryview]]:
    """(number, value) of each field: an int for varints and fixed widths, the bytes for the rest."""
    at = 0
    while at < len(buf):
        key, at = _varint(buf, at)
        number, kind = key >> 3, key & 7
        if kind == 0:
            value, at = _varint(buf, at)
        elif kind == 2:
            size, at = _varint(buf, at)
            if at + size > len(buf):
                raise Malformed("truncated field")
            value, at = buf[at : at + size], at + size
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = int.from_bytes(buf[at : at + size], "little"), at + size
        else:
            raise Malformed(f"wire type {kind}")
        yield number, value


def _text(value: memoryview) -> str:
    return bytes(value).decode("utf-8", "replace")


def _numbers(value: int | memoryview) -> list[int]:
    if isinstance(value, int):
        return [value]
    out, at = [], 0
    while at < len(value):
        n, at = _varint(value, at)
        out.append(n)
    return out


def _occurrence(buf: memoryview) -> tuple:
    span, symbol, roles, own = [], None, 0, []
    for n, v in fields(buf):
        if n == 1:
            span += _numbers(v)
        elif n == 2:
            symbol = _text(v)
        elif n == 3:
            roles = v
        elif n == 4:
            own.append(_text(v))
    if len(span) == 3:
        span = [span[0], span[1], span[0], span[2]]
    if len(span) != 4:
        raise Malformed("range of neither three nor four numbers")
    return symbol, *span, roles, "\n".join(own) if own else None


def _symbol(buf: memoryview) -> tuple:
    name, text, related = None, [], []
    for n, v in fields(buf):
        if n == 1:
            name = _text(v)
        elif n == 3:
            text.append(_text(v))
        elif n == 4:
            flags = dict.fromkeys(range(2, 6), False)
            target = None
            for m, w in fields(v):
                if m == 1:
                    target = _text(w)
                elif m in flags:
                    flags[m] = bool(w)
            related.append((target, *flags.values()))
    return name, "\n".join(text) if text else None, related


def documents(raw: bytes) -> Iterator[tuple]:
    """(path, language, occurrences, symbols) of each document."""
    for n, v in fields(memoryview(raw)):
        if n != 2:
            continue
        path, language, occurrences, symbols = None, None, [], []
        for m, w in fields(v):
            if m == 1:
                path = _text(w)
            elif m == 2:
                occurrences.append(_occurrence(w))
            elif m == 3:
                symbols.append(_symbol(w))
            elif m == 4:
                language = _text(w)
        yield path, language, occurrences, symbols


def read(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Decoded documents of every index under ``path``; a file that is too large or malformed gives one row with ``error``."""
    ship(spark)
    names = ["index_path", "path", "language", "occurrences", "symbols", "error"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            rows = []
            for name, size, raw in zip(frame["path"], frame["length"], frame["content"]):
                try:
                    if size > max_bytes:
                        raise Malformed(f"larger than {max_bytes} bytes")
                    rows += [(name, *d, None) for d in documents(raw)]
                except Malformed as e:
                    rows.append((name, None, None, [], [], str(e)))
            yield pd.DataFrame(rows, columns=names)

    return spark.read.format("binaryFile").load(path).select("path", "length", "content").mapInPandas(run, SCHEMA.replace("\n", " "))


def occurrences(indexed: DataFrame) -> DataFrame:
    return indexed.select("index_path", "path", F.inline("occurrences"))


def relationships(indexed: DataFrame) -> DataFrame:
    spread = indexed.select(F.inline("symbols")).select("symbol", F.inline("relationships"))
    return spread.distinct()


def symbol_information(indexed: DataFrame) -> DataFrame:
    return indexed.select(F.inline("symbols")).groupBy("symbol").agg(F.min("documentation").alias("documentation"))
