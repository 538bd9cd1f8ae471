"""Repositories as rows: a walk that never follows a link and never leaves the root.

One task walks one repository, because budgets are greedy: whether a file fits
depends on the files before it. Repositories are dealt over the cluster, and a
repository's rows leave its task in batches of bounded size. Paths must be
readable where the task runs.
"""

from __future__ import annotations

import os
import stat
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..limits import DEFAULT, ScanLimits
from ..schemas import FILES_RAW
from .archives import ArchiveExpander

#: Columns of a walk: FILES_RAW and what the walk noted. Kinds that start with # are no files:
#: #reason (note says why coverage is incomplete), #escape (a path that resolved outside) and #counts (size holds a total, note its name).
WALK_SCHEMA = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in FILES_RAW) + ", note string"
_COLUMNS = [c.split(" ")[0] for c in WALK_SCHEMA.split(", ")]
BATCH_BYTES = 16 << 20


def lexical_normalise(path: str) -> str:
    out: list[str] = []
    for part in path.split("/"):
        if part == "..":
            if out:
                out.pop()
        elif part not in ("", "."):
            out.append(part)
    return "/" + "/".join(out)


class Walker:
    def __init__(self, repo_id: str, root: str, limits: ScanLimits = DEFAULT) -> None:
        self.repo_id, self.limits = repo_id, limits
        self.root = os.path.realpath(root)
        self.entries = self.directories = self.files = self.symlinks = self.specials = self.bytes = self.seq = 0
        self.archives = ArchiveExpander(limits)

    def row(self, path: str | None, kind: str, **values: object) -> dict[str, object]:
        self.seq += 1
        return dict.fromkeys(_COLUMNS) | {"repo_id": self.repo_id, "seq": self.seq, "path": path, "kind": kind, "size": 0, "readonly": False, "origin": "worktree"} | values

    def reason(self, text: str) -> dict[str, object]:
        return self.row(None, "#reason", note=text)

    def relative(self, path: str) -> str:
        return os.path.relpath(path, self.root).replace("\\", "/")

    def walk(self) -> Iterator[dict[str, object]]:
        if not os.path.isdir(self.root):
            yield self.reason("scan root is not a directory")
        else:
            yield from self._tree()
        yield from map(self.reason, self.archives.reasons)
        totals = {"entries": self.entries, "files": self.files, "directories": self.directories, "symlinks": self.symlinks, "special_files": self.specials, "content_bytes": self.bytes}
        for name, n in totals.items():
            yield self.row(None, "#counts", size=n, note=name)

    def _tree(self) -> Iterator[dict[str, object]]:
        pending, self.directories = deque([(self.root, 0)]), 1
        while pending:
            folder, depth = pending.popleft()
            try:
                with os.scandir(folder) as listing:
                    found = []
                    for entry in listing:  # no more than can still be counted
                        found.append(entry)
                        if len(found) > self.limits.max_entries - self.entries:
                            break
            except OSError as error:
                yield self.reason(f"cannot read directory {self.relative(folder)}: {error.strerror}")
                continue
            for entry in sorted(found, key=lambda e: os.fsencode(e.name)):
                if self.entries >= self.limits.max_entries:
                    yield self.reason(f"maximum entry count {self.limits.max_entries} reached")
                    return
                self.entries += 1
                if entry.is_symlink():
                    yield from self._link(entry.path)
                elif entry.is_dir(follow_symlinks=False):
                    self.directories += 1
                    if depth == self.limits.max_depth:
                        yield self.reason(f"maximum directory depth {self.limits.max_depth} reached at {self.relative(entry.path)}")
                    else:
                        pending.append((entry.path, depth + 1))
                elif entry.is_file(follow_symlinks=False):
                    yield from self._file(entry.path)
                else:
                    self.specials += 1
                    yield self.reason(f"special file was not read: {self.relative(entry.path)}")
                    yield self.row(self.relative(entry.path), "special")

    def _link(self, path: str) -> Iterator[dict[str, object]]:
        self.symlinks += 1
        try:
            target = os.readlink(path)
        except OSError as error:
            yield self.reason(f"cannot read symlink {self.relative(path)}: {error.strerror}")
            return
        at = lexical_normalise(target if target.startswith("/") else f"{os.path.dirname(path)}/{target}")
        inside = at == self.root or at.startswith(self.root.rstrip("/") + "/")
        note = "escapes" if not inside else "absolute" if target.startswith("/") else None
        yield self.row(self.relative(path), "symlink", symlink_target=target.replace("\\", "/") or ".", note=note)

    def _file(self, path: str) -> Iterator[dict[str, object]]:
        self.files += 1
        relative = self.relative(path)
        try:
            meta = os.lstat(path)
        except OSError as error:
            yield self.reason(f"cannot inspect {relative}: {error.strerror}")
            return
        if not stat.S_ISREG(meta.st_mode):
            yield self.reason(f"file type changed while scanning {relative}")
            return
        known = {"size": meta.st_size, "readonly": not meta.st_mode & 0o222, "mode": meta.st_mode}
        if meta.st_size > self.limits.max_file_bytes:
            yield self.reason(f"file exceeds {self.limits.max_file_bytes} byte limit: {relative}")
            yield self.row(relative, "file", **known)
            return
        if self.bytes + meta.st_size > self.limits.max_total_bytes:
            yield self.reason(f"total content byte limit {self.limits.max_total_bytes} reached before {relative}")
            yield self.row(relative, "file", **known)
            return
        real = os.path.realpath(path)
        if not real.startswith(self.root.rstrip("/") + "/"):
            yield self.reason(f"path escaped scan root while opening {relative}")
            yield self.row(relative, "#escape")
            return
        try:
            with open(os.open(real, os.O_RDONLY | os.O_NOFOLLOW | os.O_NONBLOCK), "rb") as file:
                if not stat.S_ISREG(os.fstat(file.fileno()).st_mode):
                    yield self.reason(f"{relative} changed to a non-file while scanning")
                    return
                content = file.read(self.limits.max_file_bytes + 1)
        except OSError as error:
            yield self.reason(f"cannot open {relative}: {error.strerror}")
            yield self.row(relative, "file", **known)
            return
        if len(content) > self.limits.max_file_bytes or self.bytes + len(content) > self.limits.max_total_bytes:
            yield self.reason(f"file growth exceeded a content byte limit while scanning {relative}")
            yield self.row(relative, "file", **known)
            return
        self.bytes += len(content)
        yield self.row(relative, "file", content=content, **known)
        for member, data in self.archives.expand(relative, content):
            self.entries, self.files, self.bytes = self.entries + 1, self.files + 1, self.bytes + len(data)
            yield self.row(member, "file", size=len(data), content=data, origin="archive")


def walk_repositories(spark: SparkSession, paths: dict[str, str], limits: ScanLimits = DEFAULT) -> DataFrame:
    """Rows of all repositories, {repo_id: path}; see WALK_SCHEMA."""
    repos = spark.createDataFrame(sorted(paths.items()), "repo_id string, root string").repartition(max(1, len(paths)), "repo_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for repo_id, root in zip(batch["repo_id"], batch["root"], strict=True):
                rows, size = [], 0
                for row in Walker(repo_id, root, limits).walk():
                    rows.append(row)
                    size += len(row["content"] or b"") + 200
                    if size >= BATCH_BYTES:
                        yield _frame(rows)
                        rows, size = [], 0
                if rows:
                    yield _frame(rows)

    return repos.mapInPandas(run, WALK_SCHEMA)


def _frame(rows: list[dict[str, object]]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=_COLUMNS).astype({"mode": "Int32"})


def expand_archives(containers: DataFrame, limits: ScanLimits = DEFAULT) -> DataFrame:
    """Members of archives in a table of (repo_id, path, content), for callers that have no folder: repo_id, path, content, reason. Budgets are per repository."""

    def run(table: pd.DataFrame) -> pd.DataFrame:
        expander = ArchiveExpander(limits)
        out = []
        for repo, path, content in table.sort_values("path")[["repo_id", "path", "content"]].itertuples(index=False):
            out += [(repo, p, c, None) for p, c in expander.expand(path, content)]
        out += [(table["repo_id"].iloc[0], None, None, r) for r in expander.reasons]
        return pd.DataFrame(out, columns=["repo_id", "path", "content", "reason"])

    return containers.select("repo_id", "path", "content").groupBy("repo_id").applyInPandas(run, "repo_id string, path string, content binary, reason string")
