"""Git repositories as batch sources: trees, blobs, commits, changed files, blame and diffs.

A partition is a repository and revision; a tree is read in ``splits`` partitions, each with a share of its paths.

    spark.dataSource.register(GitTree); spark.read.format("git_tree").option("repos", "name=/path.git@HEAD,...").load()

The ``git`` program reads local mirrors; nothing is fetched. Paths that are not UTF-8 are repaired.
"""

from __future__ import annotations

import re
import subprocess
from collections.abc import Iterator
from dataclasses import dataclass, replace
from zlib import crc32

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from seine.runtime import ship

#: Partitions of one tree.
SPLITS = 8
KINDS = {"100644": "file", "100755": "file", "120000": "symlink", "160000": "submodule", "040000": "tree"}


@dataclass(frozen=True)
class Revision(InputPartition):
    repo: str
    directory: str
    revision: str
    part: int = 0
    parts: int = 1


def _git(directory: str, *args: str) -> bytes:
    return subprocess.run(["git", "-C", directory, *args], check=True, capture_output=True).stdout


class _Blobs:
    """Contents by object id, from one ``cat-file`` process that is asked and read in turn."""

    def __init__(self, directory: str) -> None:
        self.process = subprocess.Popen(["git", "-C", directory, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE)

    def __enter__(self) -> _Blobs:
        return self

    def __exit__(self, *_: object) -> None:
        self.process.stdin.close()
        self.process.stdout.close()
        self.process.wait()

    def read(self, oid: bytes) -> bytes | None:
        self.process.stdin.write(oid + b"\n")
        self.process.stdin.flush()
        head = self.process.stdout.readline().split()
        if len(head) != 3:
            return None
        body = self.process.stdout.read(int(head[2]))
        self.process.stdout.read(1)
        return body


def _text(raw: bytes) -> str:
    return raw.decode("utf-8", "replace")


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options

    def partitions(self) -> list[InputPartition]:
        out = []
        for item in filter(None, (self.options.get("repos") or "").split(",")):
            name, _, rest = item.partition("=")
            directory, _, revision = rest.rpartition("@")
            out.append(Revision(name, directory, revision))
        if not out:
            raise ValueError("option repos is needed: name=directory@revision,...")
        return out


class _TreeReader(_Reader):
    def partitions(self) -> list[InputPartition]:
        splits = int(self.options.get("splits", SPLITS))
        return [replace(p, part=i, parts=splits) for p in super().partitions() for i in range(splits)]

    def read(self, partition: Revision) -> Iterator[tuple]:
        commit = _text(_git(partition.directory, "rev-parse", f"{partition.revision}^{{commit}}")).strip()
        limit = int(self.options["maxbytes"]) if "maxbytes" in self.options else None
        wanted = self.options.get("content", "true").lower() == "true"
        with _Blobs(partition.directory) as blobs:
            for entry in _git(partition.directory, "ls-tree", "-r", "-z", "-l", commit).split(b"\0"):
                head, _, path = entry.partition(b"\t")
                if not entry or crc32(path) % partition.parts != partition.part:
                    continue
                mode, kind, oid, size = head.split()
                length = None if size == b"-" else int(size)
                body = blobs.read(oid) if wanted and kind == b"blob" and (limit is None or length <= limit) else None
                yield partition.repo, commit, _text(path), mode.decode(), KINDS.get(mode.decode(), "other"), oid.decode(), length, body


class GitTree(DataSource):
    """Every entry of a tree: repo, commit, path, mode, kind, object_id, size, content.

    Contents of any size are read; ``maxBytes`` leaves larger ones null, with their size beside, if a caller asks for it.
    """

    @classmethod
    def name(cls) -> str:
        return "git_tree"

    def schema(self) -> str:
        return "repo string, commit string, path string, mode string, kind string, object_id string, size bigint, content binary"

    def reader(self, schema) -> DataSourceReader:
        return _TreeReader(self.options)


class _LogReader(_Reader):
    def read(self, partition: Revision) -> Iterator[tuple]:
        form = "%x1e%H%x1f%P%x1f%an%x1f%ae%x1f%at%x1f%ct%x1f%s%x1f%b%x1f"
        raw = _git(partition.directory, "log", "--numstat", "-M", f"--format={form}", partition.revision)
        for i, record in enumerate(raw.split(b"\x1e")[1:]):
            commit, parents, author, email, authored, committed, subject, body, stats = record.split(b"\x1f", 8)
            changes = []
            for line in filter(None, _text(stats).strip("\n").split("\n")):
                added, removed, path = line.split("\t", 2)
                changes.append((path, None if added == "-" else int(added), None if removed == "-" else int(removed)))
            yield partition.repo, i, _text(commit), _text(parents).split(), _text(author), _text(email), int(authored), int(committed), _text(subject), _text(body).strip(), changes


class GitLog(DataSource):
    """Commits, newest first, with their parents and changed files."""

    @classmethod
    def name(cls) -> str:
        return "git_log"

    def schema(self) -> str:
        return "repo string, position int, commit string, parents array<string>, author string, email string, authored_at bigint, committed_at bigint, subject string, body string, changes array<struct<path string, added int, removed int>>"

    def reader(self, schema) -> DataSourceReader:
        return _LogReader(self.options)


class _BlameReader(_Reader):
    def read(self, partition: Revision) -> Iterator[tuple]:
        path = self.options["path"]
        commit, line, meta = "", 0, {}
        known: dict[str, dict[str, str]] = {}
        for row in _text(_git(partition.directory, "blame", "--porcelain", partition.revision, "--", path)).split("\n"):
            if row.startswith("\t"):
                info = known.setdefault(commit, {})
                info.update(meta)
                yield partition.repo, path, line, commit, info.get("author"), int(info.get("author-time", 0)), info.get("summary"), row[1:]
            elif row:
                first, _, rest = row.partition(" ")
                if len(first) == 40 and all(c in "0123456789abcdef" for c in first):
                    commit, line, meta = first, int(rest.split()[1]), {}
                else:
                    meta[first] = rest


class GitBlame(DataSource):
    """Per-line provenance of one path."""

    @classmethod
    def name(cls) -> str:
        return "git_blame"

    def schema(self) -> str:
        return "repo string, path string, line int, commit string, author string, authored_at bigint, subject string, content string"

    def reader(self, schema) -> DataSourceReader:
        return _BlameReader(self.options)


_HUNK = re.compile(rb"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@ ?(.*)")


def _side(line: bytes) -> str | None:
    """Path of a ``---`` or ``+++`` line; null for the side that does not exist."""
    name = line[4:].rstrip(b"\t")
    return None if name == b"/dev/null" else _text(name[2:])


def parse_diff(raw: bytes) -> Iterator[tuple]:
    """(old path, new path, binary, hunks) of every file of a unified diff; a hunk is (old start, old lines, new start, new lines, header, lines)."""
    lines, i = raw.split(b"\n"), 0
    while i < len(lines):
        if not lines[i].startswith(b"diff --git "):
            i += 1
            continue
        halves = lines[i][len(b"diff --git ") :]
        # without renames both halves are equal but for their first letter
        middle = len(halves) // 2
        old, new = _text(halves[2:middle]), _text(halves[middle + 3 :])
        binary, hunks = False, []
        i += 1
        while i < len(lines) and not lines[i].startswith(b"diff --git "):
            line = lines[i]
            i += 1
            found = _HUNK.match(line)
            if found:
                sizes = [1 if found[k] is None else int(found[k]) for k in (2, 4)]
                left, body = list(sizes), []
                while i < len(lines) and (left[0] > 0 or left[1] > 0 or lines[i].startswith(b"\\")):
                    mark = lines[i][:1]
                    left[0] -= mark in (b" ", b"-", b"")
                    left[1] -= mark in (b" ", b"+", b"")
                    body.append(_text(lines[i]))
                    i += 1
                hunks.append((int(found[1]), sizes[0], int(found[3]), sizes[1], _text(found[5]), body))
            elif line.startswith(b"--- "):
                old = _side(line)
            elif line.startswith(b"+++ "):
                new = _side(line)
            elif line.startswith(b"rename from "):
                old = _text(line[12:])
            elif line.startswith(b"rename to "):
                new = _text(line[10:])
            elif line.startswith(b"new file mode"):
                old = None
            elif line.startswith(b"deleted file mode"):
                new = None
            elif line.startswith(b"Binary files"):
                binary = True
        yield old, new, binary, hunks


class _DiffReader(_Reader):
    def read(self, partition: Revision) -> Iterator[tuple]:
        commit = _text(_git(partition.directory, "rev-parse", f"{partition.revision}^{{commit}}")).strip()
        parents = _text(_git(partition.directory, "rev-list", "--parents", "-n", "1", commit)).split()[1:]
        base = self.options.get("base") or (parents[0] if parents else None)
        sides = [base, commit] if base else ["--root", "--no-commit-id", commit]
        context = f"--unified={int(self.options.get('context', 3))}"
        raw = _git(partition.directory, "-c", "core.quotepath=off", "diff-tree", "-r", "-p", "-M", "--no-color", "--no-ext-diff", context, *sides)
        for old, new, binary, hunks in parse_diff(raw):
            yield partition.repo, commit, base, old, new, binary, hunks


class GitDiff(DataSource):
    """Changed files of a commit with their hunks, against ``base`` or the first parent."""

    @classmethod
    def name(cls) -> str:
        return "git_diff"

    def schema(self) -> str:
        hunk = "struct<old_start int, old_lines int, new_start int, new_lines int, header string, lines array<string>>"
        return f"repo string, commit string, base string, old_path string, path string, binary boolean, hunks array<{hunk}>"

    def reader(self, schema) -> DataSourceReader:
        return _DiffReader(self.options)


def register(spark) -> None:
    ship(spark)
    for source in (GitTree, GitLog, GitBlame, GitDiff):
        spark.dataSource.register(source)
