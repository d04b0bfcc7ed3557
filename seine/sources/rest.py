"""Paged REST listings (Link headers) as rows. The caller brings the transport, so nothing here opens a connection by itself."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from urllib.parse import urljoin, urlsplit

from pyspark.sql import DataFrame, SparkSession

_LINK = re.compile(r'<([^>]*)>\s*((?:;[^,<]*)*)')

Fetch = Callable[[str], tuple[list, dict]]


def next_link(url: str, header: str | None) -> str | None:
    """Target of rel="next", resolved; a link to another origin is refused."""
    for target, attributes in _LINK.findall(header or ""):
        if re.search(r';\s*rel="?(?:[^";]*\s)?next(?:\s[^";]*)?"?', attributes):
            there = urljoin(url, target)
            if urlsplit(there)[:2] != urlsplit(url)[:2]:
                raise ValueError(f"page link leaves {urlsplit(url).netloc}")
            return there
    return None


def pages(url: str, fetch: Fetch, most: int = 10_000) -> Iterator[list]:
    """Item lists of the listing that starts at ``url``; ``fetch`` gives the items and the response headers."""
    seen: set[str] = set()
    while url:
        if url in seen or len(seen) >= most:
            raise ValueError("the listing does not end")
        seen.add(url)
        items, headers = fetch(url)
        yield items
        url = next_link(url, {k.lower(): v for k, v in headers.items()}.get("link"))


def listing(spark: SparkSession, url: str, fetch: Fetch, schema: str, row: Callable[[dict], tuple]) -> DataFrame:
    """A repository listing as a small driver-side table."""
    return spark.createDataFrame([row(x) for page in pages(url, fetch) for x in page], schema)


def excluded(repos: DataFrame, archived: bool = True, forks: bool = True, globs: list[str] | None = None) -> DataFrame:
    """Drop archived repositories, forks and names that match a glob."""
    from pyspark.sql import functions as F

    from seine.functions.scalars import glob_match

    out = repos
    if archived:
        out = out.where(~F.coalesce("is_archived", F.lit(False)))
    if forks:
        out = out.where(~F.coalesce("is_fork", F.lit(False)))
    for g in globs or []:
        out = out.where(~glob_match(F.col("name"), g))
    return out
