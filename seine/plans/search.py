"""Text search over indexed files: a parsed query becomes one plan.

The file table has ``repo``, ``path``, ``language``, ``content`` and, for revision-bound searches, ``branch`` and ``commit``. Visibility,
revisions, contexts and placements are joined before ranking, so hidden rows influence neither counts nor order.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seine.functions.scalars import ancestors, clamp_int, glob_match, under_prefix
from seine.plans.query_language import All, Any, Const, Flag, InvalidQuery, Lang, Not, Parsed, Repo, Symbol, Text, parse
from seine.vocab import CONTEXT_LINES_MOST, SEARCH_FILES_DEFAULT, SEARCH_FILES_MOST

_FLAGS = {"archived": "is_archived", "fork": "is_fork", "public": "is_public"}


def _sensitive(pattern: str, case: str) -> bool:
    return case == "yes" or (case == "auto" and pattern != pattern.lower())


def _regex(text: Text, case: str) -> str:
    body = text.pattern if text.regex else re.sub(r"([.*+?^$|()\[\]{}\\])", r"\\\1", text.pattern)
    return body if _sensitive(text.pattern, case) else f"(?iu){body}"


def _matches(column: Column, text: Text, case: str) -> Column:
    if not text.regex and _sensitive(text.pattern, case):
        return column.contains(text.pattern)
    return column.rlike(_regex(text, case))


def predicate(node, case: str = "auto") -> Column:
    """The tree as a boolean column; metadata flags stay where they stand, so negation and alternatives hold."""
    if isinstance(node, Const):
        return F.lit(node.value)
    if isinstance(node, Not):
        return ~predicate(node.part, case)
    if isinstance(node, (All, Any)):
        out = predicate(node.parts[0], case)
        for p in node.parts[1:]:
            out = out & predicate(p, case) if isinstance(node, All) else out | predicate(p, case)
        return out
    if isinstance(node, Text):
        content, path = F.coalesce("content", F.lit("")), F.coalesce("path", F.lit(""))
        if node.where == "content":
            return _matches(content, node, case)
        if node.where == "file":
            return _matches(path, node, case)
        return _matches(content, node, case) | _matches(path, node, case)
    if isinstance(node, Repo):
        return F.coalesce(F.col("repo").rlike(f"(?iu){node.pattern}" if not _sensitive(node.pattern, case) else node.pattern), F.lit(False))
    if isinstance(node, Lang):
        return F.coalesce(F.lower("language") == node.name, F.lit(False))
    if isinstance(node, Flag):
        return F.coalesce(F.col(_FLAGS[node.name]), F.lit(False)) == node.value
    if isinstance(node, Symbol):
        return F.coalesce(F.exists("symbols", lambda s: s.rlike(node.pattern)), F.lit(False))
    raise InvalidQuery(f"no plan for {node!r}")


def _has(node, kind: type) -> bool:
    if isinstance(node, (All, Any)):
        return any(_has(p, kind) for p in node.parts)
    return _has(node.part, kind) if isinstance(node, Not) else isinstance(node, kind)


def context_repos(repos: DataFrame, contexts: Mapping[str, list[str]], names: tuple[str, ...]) -> DataFrame:
    """Repositories in any of the named contexts (lists of globs)."""
    unknown = [n for n in names if n not in contexts]
    if unknown:
        raise InvalidQuery(f"unknown search context {unknown[0]!r}")
    hit = F.lit(False)
    for n in names:
        for g in contexts[n]:
            hit = hit | glob_match(F.col("name"), g)
    return repos.where(hit).select(F.col("name").alias("repo")).distinct()


def indexed_revisions(repos: DataFrame) -> DataFrame:
    """(repo, selector, branch, commit, valid): a selector must be unique and HEAD must be the indexed commit."""
    rows = repos.select(F.col("name").alias("repo"), "indexed_commit", F.inline("indexed_revisions"))
    count = rows.groupBy("repo", "selector").agg(F.count("*").alias("times"))
    ok = (F.col("times") == 1) & ((F.col("selector") != "HEAD") | F.col("commit").eqNullSafe(F.col("indexed_commit")))
    return rows.join(count, ["repo", "selector"]).select("repo", "selector", "branch", "commit", ok.alias("valid"))


def in_revision(files: DataFrame, repos: DataFrame, selector: str) -> DataFrame:
    """Files of the commit that the selector names in their repository."""
    bound = indexed_revisions(repos).where((F.col("selector") == selector) & F.col("valid")).select("repo", "branch", "commit")
    return files.join(bound, ["repo", "branch", "commit"], "left_semi")


def placed(files: DataFrame, memberships: DataFrame, service_key: str) -> DataFrame:
    """Files at or below a path of the service."""
    claims = memberships.where(F.col("service_key") == service_key).select("repo", F.col("path").alias("prefix")).distinct()
    wanted = files.select("repo", "path", F.explode(ancestors(F.col("path"))).alias("prefix")).join(claims, ["repo", "prefix"], "left_semi").select("repo", "path").distinct()
    return files.join(wanted, ["repo", "path"], "left_semi")


def in_unit(files: DataFrame, primary: list[str], supporting: list[str]) -> DataFrame:
    """Files of a focused analysis unit, with their ``unit_class``."""

    def any_of(prefixes: list[str]) -> Column:
        hit = F.lit(False)
        for p in prefixes:
            hit = hit | under_prefix(F.col("path"), p)
        return hit

    return files.withColumn("unit_class", F.when(any_of(primary), "primary").when(any_of(supporting), "supporting").otherwise("outside")).where("unit_class <> 'outside'")


def _score(parsed: Parsed) -> Column:
    """Matches in the content over all positive terms, and one for each term found in the path."""
    total = F.lit(0)
    for t in parsed.texts:
        p = F.lit(_regex(t, parsed.case))
        if t.where in ("any", "content"):
            total = total + F.regexp_count(F.coalesce("content", F.lit("")), p)
        if t.where in ("any", "file"):
            total = total + F.when(_matches(F.coalesce("path", F.lit("")), t, parsed.case), 1).otherwise(0)
    return total.cast("long")


def matching(
    files: DataFrame, raw: str, repos: DataFrame | None = None, contexts: Mapping[str, list[str]] | None = None, visible: DataFrame | None = None,
    memberships: DataFrame | None = None, service_key: str | None = None,
) -> tuple[DataFrame, Parsed]:
    """Every matching file with its score; permission, revision, context and placement come first."""
    parsed = parse(raw)
    out = files
    if visible is not None:
        out = out.join(visible.select("repo").distinct(), "repo", "left_semi")
    if parsed.revision:
        if repos is None:
            raise InvalidQuery("rev: needs the repository table")
        out = in_revision(out, repos, parsed.revision)
    if parsed.contexts:
        if repos is None:
            raise InvalidQuery("context: needs the repository table")
        out = out.join(context_repos(repos, contexts or {}, parsed.contexts), "repo", "left_semi")
    if service_key is not None:
        out = placed(out, memberships, service_key)
    if _has(parsed.tree, Flag):
        if repos is None:
            raise InvalidQuery("repository flags need the repository table")
        out = out.join(repos.select(F.col("name").alias("repo"), *_FLAGS.values()), "repo", "left")
    if _has(parsed.tree, Symbol) and "symbols" not in out.columns:
        raise InvalidQuery("sym: needs a symbols column")
    return out.where(predicate(parsed.tree, parsed.case)).withColumn("score", _score(parsed)), parsed


def rank_order() -> list[Column]:
    return [F.desc("score"), F.asc_nulls_first("repo"), F.asc_nulls_first("path"), F.asc_nulls_first("language")]


def search(files: DataFrame, raw: str, max_matches: int | None = None, tie: str | None = None, **scope) -> DataFrame:
    """The best files: score falling, then repository, path, language (and ``tie``)."""
    found, _ = matching(files, raw, **scope)
    k = clamp_int(max_matches, SEARCH_FILES_DEFAULT, SEARCH_FILES_MOST)
    return found.orderBy(*rank_order(), *([F.asc(tie)] if tie else [])).limit(k)


def search_stats(files: DataFrame, raw: str, **scope) -> DataFrame:
    """file_count and match_count over all matches, whatever the display limit."""
    found, _ = matching(files, raw, **scope)
    return found.agg(F.count("*").alias("file_count"), F.coalesce(F.sum("score"), F.lit(0)).cast("long").alias("match_count"))


def _ranges(line: Column, number: Column, pattern: str) -> Column:
    """1-based columns of each match in a line."""
    found = F.regexp_extract_all(line, F.lit(pattern), F.lit(0))
    between = F.split(line, pattern, -1)
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<start_line:int,start_col:int,end_line:int,end_col:int>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        begin = s["at"] + F.char_length(x["gap"])
        end = begin + F.char_length(x["hit"])
        one = F.struct(number.alias("start_line"), begin.alias("start_col"), number.alias("end_line"), end.alias("end_col"))
        return F.struct(end.alias("at"), F.concat(s["out"], F.array(one)).alias("out"))

    pairs = F.zip_with(F.slice(between, F.lit(1), F.size(found)), found, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
    return F.aggregate(pairs, start, step, lambda s: s["out"])


def chunks(found: DataFrame, parsed: Parsed, context_lines: int = 0) -> DataFrame:
    """Adds ``chunks``: for each matching line its context, first line and match ranges. A file that matches by name alone has none."""
    around = min(max(context_lines, 0), CONTEXT_LINES_MOST)
    terms = [_regex(t, parsed.case) for t in parsed.texts if t.where in ("any", "content")]
    if not terms:
        return found.withColumn("chunks", F.array())
    flags = "(?iu)" if all(t.startswith("(?iu)") for t in terms) else ""
    pattern = flags + "|".join(f"(?:{t.removeprefix('(?iu)')})" if flags else f"(?:{t})" for t in terms)
    lines = F.split(F.coalesce("content", F.lit("")), "\n")
    hits = F.filter(F.transform(lines, lambda l, i: F.struct((i + 1).alias("n"), l.alias("line"))), lambda x: x["line"].rlike(pattern))

    def one(x: Column) -> Column:
        first = F.greatest(F.lit(1), x["n"] - around)
        body = F.array_join(F.slice(lines, first, x["n"] + around - first + 1), "\n")
        return F.struct(body.alias("content"), first.alias("start_line"), _ranges(x["line"], x["n"], pattern).alias("ranges"))

    return found.withColumn("chunks", F.transform(hits, one))


def receipt(found: DataFrame, version: str = "path") -> DataFrame:
    """Digest over the ordered citations, the number of files and the distinct repositories of a displayed result.

    Citations are gathered, so ``found`` must be what :func:`search` returned (at most its display limit).
    """
    cite = F.concat_ws("\t", F.coalesce("repo", F.lit("")), F.coalesce("path", F.lit("")), F.coalesce(F.col(version).cast("string"), F.lit("")))
    return found.agg(F.count("*").alias("files"), F.sha2(F.array_join(F.array_sort(F.collect_list(cite)), "\n"), 256).alias("digest"), F.countDistinct("repo").alias("repositories"))


def usage_event(found: DataFrame, cap: int = 50) -> DataFrame:
    """The repositories a search touched, sorted, at most ``cap``."""
    per_repo = found.groupBy("repo").agg(F.count("*").alias("n"))
    return per_repo.agg(F.slice(F.array_sort(F.collect_set("repo")), 1, cap).alias("repos"), F.coalesce(F.sum("n"), F.lit(0)).alias("file_count"))


def stream(found: DataFrame, max_matches: int, batch: int = 100) -> Iterator[list]:
    """Results partition by partition under one display budget, without gathering them first."""
    left, held = max_matches, []
    for row in found.toLocalIterator(prefetchPartitions=False):
        held.append(row)
        left -= 1
        if len(held) >= min(batch, max(left, 1)) or left == 0:
            yield held
            held = []
        if left == 0:
            return
    if held:
        yield held
