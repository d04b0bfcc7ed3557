"""Views over a table of repository files (repo, commit, path, mode, kind, object_id, content) and of commits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seine.functions.scalars import content_body


def source(files: DataFrame, repo: str, commit: str, path: str) -> DataFrame:
    """One file's content, UTF-8 or base64; the filter reaches the scan."""
    return files.where((F.col("repo") == repo) & (F.col("commit") == commit) & (F.col("path") == path)).select("path", content_body(F.col("content").cast("binary")).alias("c")).select("path", "c.*")


def folder(files: DataFrame, parent: str) -> DataFrame:
    """Direct children of a folder: (name, kind), folders first."""
    prefix = parent.rstrip("/") + "/" if parent else ""
    rest = F.substring(F.col("path"), len(prefix) + 1, 1 << 30) if prefix else F.col("path")
    below = files.where(F.col("path").startswith(prefix)).select(rest.alias("rest")).where("rest <> ''")
    is_dir = F.col("rest").contains("/")
    return below.select(F.substring_index("rest", "/", 1).alias("name"), F.when(is_dir, "dir").otherwise("file").alias("kind")).distinct().orderBy("kind", "name")


def tree(files: DataFrame) -> DataFrame:
    return files.select("path").distinct().orderBy("path")


def symlinks(files: DataFrame) -> DataFrame:
    """(path, target, state): same-commit targets of symbolic links; links to links, outside or missing targets are named as such."""
    links = files.where("kind = 'symlink'").select("repo", "commit", "path", F.col("content").cast("string").alias("link"))
    base = F.split(F.col("path"), "/")
    start = F.slice(base, F.lit(1), F.size(base) - 1)

    def step(acc: Column, part: Column) -> Column:
        up = F.when(F.size(acc) > 0, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(F.array(F.lit("..")))
        return F.when(part.isin("", "."), acc).when(part == "..", up).otherwise(F.concat(acc, F.array(part)))

    target = F.array_join(F.aggregate(F.split("link", "/"), start, step), "/")
    known = files.select("repo", "commit", F.col("path").alias("target"), F.col("kind").alias("target_kind"))
    rows = links.select("repo", "commit", "path", "link", F.when(F.col("link").startswith("/"), None).otherwise(target).alias("target")).join(known, ["repo", "commit", "target"], "left")
    state = F.when(F.col("target").isNull() | F.col("target").startswith(".."), "outside").when(F.col("target_kind").isNull(), "missing").when(F.col("target_kind") == "symlink", "chained").otherwise("resolved")
    return rows.select("repo", "commit", "path", "target", state.alias("state"))


def census(files: DataFrame, blob: str) -> DataFrame:
    """Per distinct content its placements in canonical order, how many, and in how many repositories."""
    placed = files.groupBy(blob).agg(F.count("*").alias("placements"), F.countDistinct("repo").alias("repositories"), F.min(F.struct("repo", "path")).alias("first"))
    return placed.select(blob, "placements", "repositories", F.col("first.repo").alias("first_repo"), F.col("first.path").alias("first_path"))


def commit_page(commits: DataFrame, offset: int, limit: int) -> DataFrame:
    """Commits of a page, newest first, with their first parent and whether more follow."""
    page = commits.orderBy("position").offset(offset).limit(limit + 1)
    order = Window.orderBy("position")  # over the bounded page only
    rows = page.select("*", F.row_number().over(order).alias("_n"), (F.count("*").over(Window.partitionBy()) > limit).alias("has_more"), F.get("parents", F.lit(0)).alias("first_parent"))
    return rows.where(F.col("_n") <= limit).drop("_n")


def change_totals(commits: DataFrame) -> DataFrame:
    """Per commit: changed files, lines added and removed (binary files count no lines)."""
    none = F.lit(0).cast("long")
    sum_of = lambda f: F.aggregate(F.transform("changes", f), none, lambda a, x: a + F.coalesce(x, none))
    return commits.select("repo", "commit", F.size("changes").alias("files"), sum_of(lambda c: c["added"].cast("long")).alias("added"), sum_of(lambda c: c["removed"].cast("long")).alias("removed"))
