"""Pages over a total order: keyset, offset, signed cursors, overflow probes, top-k."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def after(keys: list[str], cursor: list) -> Column:
    """Rows strictly after the cursor in the lexicographic order of ``keys``.

    Written as a chain of alternatives, whose comparisons reach the Parquet scan; a struct comparison would not.
    """
    if len(keys) != len(cursor):
        raise ValueError("a cursor has one value per key")
    options = []
    for i, k in enumerate(keys):
        same = [F.col(p) == F.lit(c) for p, c in zip(keys[:i], cursor)]
        options.append(reduce(lambda a, b: a & b, [*same, F.col(k) > F.lit(cursor[i])]))
    return (F.col(keys[0]) >= F.lit(cursor[0])) & reduce(lambda a, b: a | b, options)


def keyset_page(df: DataFrame, keys: list[str], limit: int, cursor: list | None = None) -> DataFrame:
    """The next ``limit + 1`` rows: the last one only tells that there are more."""
    rows = df if cursor is None else df.where(after(keys, cursor))
    return rows.orderBy(*keys).limit(limit + 1)


def page_with_more(df: DataFrame, keys: list[str], limit: int, cursor: list | None = None) -> DataFrame:
    """A keyset page without its probe row, ``has_more`` beside every row."""
    probe = keyset_page(df, keys, limit, cursor)
    order = Window.orderBy(*keys)  # over the bounded page only
    return probe.select("*", F.row_number().over(order).alias("_n"), (F.count("*").over(Window.partitionBy()) > limit).alias("has_more")).where(F.col("_n") <= limit).drop("_n")


def offset_page(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def overflow(df: DataFrame, limit: int) -> DataFrame:
    """One row: how many rows a display of ``limit`` shows, and whether it is cut short. Reads at most ``limit + 1`` rows."""
    return df.limit(limit + 1).agg(F.least(F.count("*"), F.lit(limit)).alias("shown"), (F.count("*") > limit).alias("truncated"))


def smallest(df: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k smallest distinct rows, with ``truncated`` if there are more."""
    top = df.select(*keys).distinct().orderBy(*keys).limit(k + 1)
    order = Window.orderBy(*keys)  # over the bounded page only
    return top.select("*", F.row_number().over(order).alias("_n"), (F.count("*").over(Window.partitionBy()) > k).alias("truncated")).where(F.col("_n") <= k).drop("_n")


def group_page(page: DataFrame, group: str) -> DataFrame:
    """Counts of each group within one page."""
    return page.groupBy(group).agg(F.count("*").alias("rows"))


class Cursor:
    """Signed page tokens bound to the query and the generation they were issued for."""

    def __init__(self, secret: bytes) -> None:
        self._secret = secret

    def encode(self, query_digest: str, generation: str, position: list | int) -> str:
        body = json.dumps([query_digest, generation, position], separators=(",", ":")).encode()
        sign = hmac.new(self._secret, body, hashlib.sha256).digest()
        return base64.urlsafe_b64encode(sign + body).decode()

    def decode(self, token: str, query_digest: str, generation: str) -> list | int:
        try:
            raw = base64.urlsafe_b64decode(token.encode())
        except ValueError:
            raise ValueError("malformed cursor") from None
        sign, body = raw[:32], raw[32:]
        if not hmac.compare_digest(sign, hmac.new(self._secret, body, hashlib.sha256).digest()):
            raise ValueError("cursor was not issued here")
        q, g, position = json.loads(body)
        if q != query_digest:
            raise ValueError("cursor belongs to another query")
        if g != generation:
            raise ValueError("cursor belongs to another generation")
        return position
