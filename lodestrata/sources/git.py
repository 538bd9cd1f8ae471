"""Commits of a local repository, read object by object without running git.

Only a plain .git folder is opened: no links, worktrees, alternates or
includes. Loose objects and version 2 packs are read; every object is bounded.
"""

from __future__ import annotations

import hashlib
import os
import re
import stat
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..limits import DEFAULT, ScanLimits

# Limits on administrative files, object kinds of packs, redirecting settings.
MAX_ADMIN_ENTRIES, MAX_ADMIN_BYTES, MAX_CONFIG_BYTES, MAX_INFLATED = 200_000, 4 << 30, 1 << 20, 64 << 20
PACK_KINDS = {1: "commit", 2: "tree", 3: "blob", 4: "tag"}
OFFSET_DELTA, NAME_DELTA = 6, 7
REDIRECTS = ("include", "worktree", "alternates", "gitdir")
_HEX = re.compile(r"[0-9a-f]{40}(?:[0-9a-f]{24})?")
_RANGE = re.compile(r"([0-9a-fA-F]{7,64})\.\.HEAD")
MAX_DELTA_DEPTH = 4096


class GitError(ValueError):
    pass


@dataclass(frozen=True)
class TreeEntry:
    id: str
    executable: bool
    symlink: bool


def parse_range(text: str) -> str:
    """The base of <commit>..HEAD."""
    if not (m := _RANGE.fullmatch(text)):
        raise GitError("diff requires a hexadecimal commit ID followed by ..HEAD")
    return m[1].lower()


def inflate(data: bytes, limit: int = MAX_INFLATED) -> bytes:
    try:
        out = zlib.decompressobj().decompress(data, limit + 1)
    except zlib.error as error:
        raise GitError(f"damaged object: {error}") from None
    if len(out) > limit:
        raise GitError(f"object exceeds {limit} bytes")
    return out


def apply_delta(base: bytes, delta: bytes) -> bytes:
    at = 0

    def size() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = delta[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if not byte & 128:
                return out

    try:
        if size() != len(base):
            raise GitError("delta doesn't fit its base")
        target, out = size(), bytearray()
        if target > MAX_INFLATED:
            raise GitError(f"object exceeds {MAX_INFLATED} bytes")
        while at < len(delta):
            op = delta[at]
            at += 1
            if op & 128:  # copy from the base
                values = []
                for bits, count in ((0, 4), (4, 3)):
                    value = 0
                    for i in range(count):
                        if op >> (bits + i) & 1:
                            value |= delta[at] << 8 * i
                            at += 1
                    values.append(value)
                start, length = values[0], values[1] or 0x10000
                out += base[start : start + length]
            elif op:
                out += delta[at : at + op]
                at += op
            else:
                raise GitError("reserved delta instruction")
    except IndexError:
        raise GitError("delta ends early") from None
    if len(out) != target:
        raise GitError("delta gives another size")
    return bytes(out)


class Pack:
    def __init__(self, path: str) -> None:
        self.path = path
        with open(f"{path}.idx", "rb") as f:
            self.index = f.read()
        if self.index[:8] != b"\xfftOc\0\0\0\2":
            raise GitError("unsupported pack index")
        self.fanout = struct.unpack(">256I", self.index[8:1032])
        self.count = self.fanout[255]
        self.width = 32 if len(self.index) >= 1032 + self.count * 40 + 64 and self._names_fit(32) else 20

    def _names_fit(self, width: int) -> bool:
        with open(f"{self.path}.pack", "rb") as f:
            f.seek(-width, os.SEEK_END)
            return f.read() == self.index[-2 * width : -width]

    @cached_property
    def data(self) -> bytes:
        with open(f"{self.path}.pack", "rb") as f:
            return f.read()

    def _name(self, i: int) -> bytes:
        return self.index[1032 + i * self.width : 1032 + (i + 1) * self.width]

    def names(self, prefix: str) -> Iterator[tuple[str, int]]:
        first = int(prefix[:2], 16)
        for i in range(self.fanout[first - 1] if first else 0, self.fanout[first]):
            if (name := self._name(i).hex()).startswith(prefix):
                yield name, i

    def offset(self, i: int) -> int:
        table = 1032 + self.count * (self.width + 4)
        (value,) = struct.unpack_from(">I", self.index, table + 4 * i)
        if value >> 31:
            (value,) = struct.unpack_from(">Q", self.index, table + 4 * self.count + 8 * (value & 0x7FFFFFFF))
        return value


class Repository:
    def __init__(self, root: str, limits: ScanLimits = DEFAULT) -> None:
        self.limits = limits
        root = os.path.realpath(root)
        self.git = os.path.join(root, ".git")
        try:
            meta = os.lstat(self.git)
        except OSError as error:
            raise GitError(f"repository must contain a local .git directory: {error.strerror}") from None
        if not stat.S_ISDIR(meta.st_mode):
            raise GitError("Git worktrees and .git symlinks are not supported")
        self._validate()
        packs = os.path.join(self.git, "objects/pack")
        self.packs = [Pack(os.path.join(packs, n[:-4])) for n in sorted(os.listdir(packs)) if n.endswith(".idx")] if os.path.isdir(packs) else []

    def _validate(self) -> None:
        pending, entries, size = [self.git], 0, 0
        while pending:
            with os.scandir(pending.pop()) as found:
                for entry in found:
                    entries += 1
                    if entries > MAX_ADMIN_ENTRIES:
                        raise GitError(f"Git metadata entry limit of {MAX_ADMIN_ENTRIES} reached")
                    if entry.is_symlink():
                        raise GitError("Git administrative directory contains a symlink")
                    if entry.is_dir(follow_symlinks=False):
                        pending.append(entry.path)
                    elif entry.is_file(follow_symlinks=False):
                        size += entry.stat(follow_symlinks=False).st_size
                        if size > MAX_ADMIN_BYTES:
                            raise GitError(f"Git metadata byte limit of {MAX_ADMIN_BYTES} reached")
                    else:
                        raise GitError("Git administrative directory contains a special file")
        if any(os.path.exists(os.path.join(self.git, p)) for p in ("commondir", "objects/info/alternates", "objects/info/http-alternates")):
            raise GitError("Git worktrees and alternate object stores are not supported")
        config = self._read("config", MAX_CONFIG_BYTES + 1)
        if config is not None:
            if len(config) > MAX_CONFIG_BYTES:
                raise GitError("Git config exceeds the 1 MiB limit")
            if any(word in config.decode("utf-8", "replace").lower() for word in REDIRECTS):
                raise GitError("Git config contains path redirection or include directives")

    def _read(self, name: str, limit: int = MAX_INFLATED) -> bytes | None:
        try:
            with open(os.path.join(self.git, name), "rb") as f:
                return f.read(limit)
        except (FileNotFoundError, NotADirectoryError):
            return None

    # Objects

    def object(self, id: str) -> tuple[str, bytes]:
        """(kind, contents), checked against the id."""
        raw = self._read(f"objects/{id[:2]}/{id[2:]}")
        if raw is not None:
            whole = inflate(raw)
            head, _, body = whole.partition(b"\0")
            kind = head.split(b" ")[0].decode("ascii", "replace")
            if head != b"%s %d" % (kind.encode(), len(body)):
                raise GitError(f"damaged object {id}")
        else:
            kind, body = self._packed(id)
        digest = hashlib.sha1 if len(id) == 40 else hashlib.sha256
        if digest(f"{kind} {len(body)}\0".encode() + body).hexdigest() != id:
            raise GitError(f"object {id} has other contents than its name says")
        return kind, body

    def _packed(self, id: str) -> tuple[str, bytes]:
        for pack in self.packs:
            for _, i in pack.names(id):
                return self._at(pack, pack.offset(i))
        raise GitError(f"object {id} not found")

    def _at(self, pack: Pack, offset: int) -> tuple[str, bytes]:
        """An object of a pack, its deltas applied from the innermost base outwards."""
        deltas: list[bytes] = []
        while len(deltas) < MAX_DELTA_DEPTH:
            at = offset
            byte = pack.data[at]
            kind, at = byte >> 4 & 7, at + 1
            while byte & 128:
                byte = pack.data[at]
                at += 1
            if kind in PACK_KINDS:
                body = inflate(pack.data[at : at + MAX_INFLATED])
                for delta in reversed(deltas):
                    body = apply_delta(body, delta)
                return PACK_KINDS[kind], body
            if kind == OFFSET_DELTA:
                byte = pack.data[at]
                back, at = byte & 127, at + 1
                while byte & 128:
                    byte = pack.data[at]
                    back, at = (back + 1) << 7 | byte & 127, at + 1
                deltas.append(inflate(pack.data[at : at + MAX_INFLATED]))
                offset -= back
            elif kind == NAME_DELTA:
                base = pack.data[at : at + pack.width].hex()
                deltas.append(inflate(pack.data[at + pack.width : at + pack.width + MAX_INFLATED]))
                found = next(pack.names(base), None)
                if found is None:
                    kind, body = self.object(base)
                    for delta in reversed(deltas):
                        body = apply_delta(body, delta)
                    return kind, body
                offset = pack.offset(found[1])
            else:
                raise GitError("unknown object kind in a pack")
        raise GitError("delta chain is too long")

    # Names and commits

    def head(self) -> str:
        name = "HEAD"
        for _ in range(8):
            raw = self._read(name, 4096)
            text = raw.decode("utf-8", "replace").strip() if raw is not None else self._packed_ref(name)
            if text is None:
                raise GitError("cannot resolve repository HEAD")
            if not text.startswith("ref: "):
                break
            name = text.removeprefix("ref: ")
            if ".." in name or name.startswith("/"):
                raise GitError("cannot resolve repository HEAD")
        if not _HEX.fullmatch(text):
            raise GitError("cannot resolve repository HEAD")
        return text

    def _packed_ref(self, name: str) -> str | None:
        for line in (self._read("packed-refs") or b"").decode("utf-8", "replace").splitlines():
            if line.endswith(f" {name}"):
                return line.split(" ")[0]
        return None

    def resolve(self, prefix: str) -> str:
        folder = os.path.join(self.git, "objects", prefix[:2])
        found = {prefix[:2] + n for n in os.listdir(folder) if (prefix[:2] + n).startswith(prefix)} if os.path.isdir(folder) else set()
        found |= {name for pack in self.packs for name, _ in pack.names(prefix)}
        if len(found) != 1:
            raise GitError(f"cannot resolve commit {prefix}")
        return found.pop()

    def commit(self, id: str) -> tuple[str, list[str]]:
        """(tree, parents); a tag is followed to its commit."""
        for _ in range(8):
            kind, body = self.object(id)
            fields = [line.split(" ", 1) for line in body.split(b"\n\n", 1)[0].decode("utf-8", "replace").split("\n") if " " in line]
            if kind == "commit":
                return next(v for k, v in fields if k == "tree"), [v for k, v in fields if k == "parent"]
            if kind != "tag":
                raise GitError(f"object {id} is not a commit")
            id = next(v for k, v in fields if k == "object")
        raise GitError(f"object {id} is not a commit")


class TreeReader:
    """Flattens trees; all trees of a run share one budget of entries."""

    def __init__(self, repo: Repository, max_entries: int) -> None:
        self.repo, self.max_entries, self.entries = repo, max_entries, 0

    def read(self, tree: str) -> dict[str, TreeEntry]:
        out: dict[str, TreeEntry] = {}
        self._into(tree, "", 0, out)
        return out

    def _into(self, tree: str, prefix: str, depth: int, out: dict[str, TreeEntry]) -> None:
        if depth > self.repo.limits.git_tree_depth:
            raise GitError(f"Git tree depth limit of {self.repo.limits.git_tree_depth} reached")
        kind, body = self.repo.object(tree)
        if kind != "tree":
            raise GitError(f"Git entry is not a tree at {prefix or '.'}")
        width, at = len(tree) // 2, 0
        while at < len(body):
            self.entries += 1
            if self.entries > self.max_entries:
                raise GitError(f"Git tree-entry limit of {self.max_entries} reached")
            end = body.find(b"\0", at)
            mode, _, raw = body[at : max(end, at)].partition(b" ")
            id, at = body[end + 1 : end + 1 + width].hex(), end + 1 + width
            if end < 0 or len(id) != 2 * width:
                raise GitError("malformed Git tree")
            try:
                name = raw.decode()
            except UnicodeDecodeError:
                raise GitError("Git tree contains a non-UTF-8 path") from None
            if name in ("", ".", "..") or "/" in name or any(ord(c) < 32 or 127 <= ord(c) < 160 for c in name):
                raise GitError("Git tree contains an invalid path component")
            path = prefix + name
            if mode == b"40000":
                self._into(id, path + "/", depth + 1, out)
            elif mode in (b"100644", b"100664", b"100755", b"120000"):
                out[path] = TreeEntry(id, mode == b"100755", mode == b"120000")
            elif mode != b"160000":
                raise GitError(f"Git tree contains unsupported mode at {path}")


#: side is new, old, or reason (note says why) or count (size holds the changed blobs).
CHANGES = "repo_id string, commit_no long, commit string, seq long, path string, side string, content binary, size long, note string"


class ChangeReader:
    """Rows of CHANGES for the files that a commit changed."""

    def __init__(self, repo_id: str, repo: Repository) -> None:
        self.repo_id, self.repo = repo_id, repo

    def row(self, number: int, commit: str, seq: int, path: str | None, side: str, content: bytes | None = None, size: int = 0, note: str | None = None) -> tuple:
        return self.repo_id, number, commit, seq, path, side, content, size, note

    def compare(self, number: int, commit: str, new_tree: str, old_tree: str | None, trees: TreeReader) -> Iterator[tuple]:
        limits = self.repo.limits
        old = trees.read(old_tree) if old_tree else {}
        new = trees.read(new_tree)
        changed = [(p, e) for p, e in sorted(new.items(), key=lambda x: x[0].encode()) if old.get(p) != e]
        spent = 0
        for seq, (path, entry) in enumerate(changed):
            if seq >= limits.git_changed_blobs:
                yield self.row(number, commit, seq, None, "reason", note=f"changed blob limit of {limits.git_changed_blobs} reached")
                break
            for side, name, id in (("new", "changed", entry.id), ("old", "prior", old[path].id if path in old else None)):
                if id is None:
                    continue
                try:
                    kind, body = self.repo.object(id)
                except GitError as error:
                    yield self.row(number, commit, seq, None, "reason", note=f"cannot read {name} blob {path}: {error}")
                    break
                if kind != "blob":
                    yield self.row(number, commit, seq, None, "reason", note=f"{name} Git entry is not a blob: {path}")
                    break
                if len(body) > limits.git_object_bytes or spent + len(body) > limits.git_changed_bytes:
                    yield self.row(number, commit, seq, None, "reason", note=f"{name} Git blob byte limit reached at {path}")
                    break
                spent += len(body)
                yield self.row(number, commit, seq, path, side, body, len(body))
        yield self.row(number, commit, len(changed), None, "count", size=min(len(changed), limits.git_changed_blobs + 1))

    def diff(self, base: str) -> Iterator[tuple]:
        head = self.repo.head()
        trees = TreeReader(self.repo, self.repo.limits.git_tree_entries)
        yield from self.compare(0, head, self.repo.commit(head)[0], self.repo.commit(self.repo.resolve(base))[0], trees)

    def history(self) -> Iterator[tuple]:
        """Depth first from HEAD over all parents; each commit is compared with its first parent."""
        limits = self.repo.limits
        trees = TreeReader(self.repo, limits.git_history_entries)
        pending, seen = [self.repo.head()], set()
        while pending:
            id = pending.pop()
            if id in seen:
                continue
            if len(seen) >= limits.git_commits:
                yield self.row(len(seen), id, 0, None, "reason", note=f"Git history commit limit of {limits.git_commits} reached")
                return
            seen.add(id)
            tree, parents = self.repo.commit(id)
            if len(parents) > limits.git_parents:
                yield self.row(len(seen), id, 0, None, "reason", note=f"commit parent limit of {limits.git_parents} reached at {id}")
            pending += parents[: limits.git_parents]
            yield from self.compare(len(seen), id, tree, self.repo.commit(parents[0])[0] if parents else None, trees)
            if parents and trees.entries >= trees.max_entries:
                yield self.row(len(seen), id, 0, None, "reason", note=f"Git history tree-entry limit of {trees.max_entries} reached")
                return


def changed_blobs(spark: SparkSession, paths: dict[str, str], base: str | None, limits: ScanLimits = DEFAULT) -> DataFrame:
    """Rows of CHANGES of all repositories: between base and HEAD, or over their history. An error leaves one reason and no other row of its repository."""
    repos = spark.createDataFrame(sorted(paths.items()), "repo_id string, root string").repartition(max(1, len(paths)), "repo_id")
    columns = [c.split(" ")[0] for c in CHANGES.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for repo_id, root in zip(batch["repo_id"], batch["root"], strict=True):
                try:
                    reader = ChangeReader(repo_id, Repository(root, limits))
                    rows = list(reader.diff(base) if base else reader.history())
                except (GitError, OSError, StopIteration) as error:
                    what = "diff analysis failed" if base else "Git history analysis failed"
                    rows = [(repo_id, 0, "", 0, None, "reason", None, 0, f"{what}: {error}")]
                for lo in range(0, len(rows), 64):
                    yield pd.DataFrame(rows[lo : lo + 64], columns=columns)

    return repos.mapInPandas(run, CHANGES)
