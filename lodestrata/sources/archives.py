"""Archive members as virtual files, bounded by greedy budgets."""

from __future__ import annotations

import io
import stat
import tarfile
import time
import zipfile
import zlib
from collections.abc import Callable
from dataclasses import dataclass, field

from ..limits import DEFAULT, ScanLimits

# Caps that hold whatever a profile says.
HARD_MEMBER_BYTES, HARD_BYTES, HARD_MEMBERS = 32 << 20, 512 << 20, 50_000


def archive_kind(content: bytes) -> str | None:
    """Told by the first bytes alone, never by the name."""
    if content[:4] in (b"PK\x03\x04", b"PK\x05\x06"):
        return "zip"
    if content[:2] == b"\x1f\x8b":
        return "gzip"
    return "tar" if len(content) >= 512 and content[257:262] == b"ustar" else None


def safe_member_path(raw: bytes, max_bytes: int = DEFAULT.archive_path_bytes) -> str:
    """The path with forward slashes; ValueError for one that is empty, too long, no UTF-8, absolute, or climbs or names a stream."""
    if not 0 < len(raw) <= max_bytes:
        raise ValueError("archive member has an invalid path length")
    try:
        given = raw.decode()
    except UnicodeDecodeError:
        raise ValueError("archive member path is not valid UTF-8") from None
    path = given.replace("\\", "/")
    control = any(ord(c) < 32 or 127 <= ord(c) < 160 for c in path)
    if path.startswith("/") or control or any(part == ".." or ":" in part for part in path.split("/")):
        raise ValueError(f"archive traversal path rejected: {given}")
    return path


@dataclass
class ArchiveExpander:
    """Expands archives of one repository; its budgets are shared by all of them."""

    limits: ScanLimits = DEFAULT
    clock: Callable[[], float] = time.monotonic
    members: int = 0
    expanded: int = 0
    reasons: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.deadline = self.clock() + self.limits.archive_seconds
        self.member_limit = min(self.limits.archive_members, HARD_MEMBERS)
        self.byte_limit = min(self.limits.archive_bytes, HARD_BYTES)
        self.member_bytes = min(self.limits.archive_member_bytes, HARD_MEMBER_BYTES)

    def expand(self, path: str, content: bytes, depth: int = 0) -> list[tuple[str, bytes]]:
        """(path, content) of all members below; a member's own members come before it."""
        kind = archive_kind(content)
        if kind is None:
            return []
        if depth >= self.limits.archive_depth:
            self.reasons.append(f"archive recursion limit reached at {path}")
            return []
        out: list[tuple[str, bytes]] = []
        {"zip": self._zip, "gzip": self._gzip, "tar": self._tar}[kind](path, content, depth, out)
        return out

    def _late(self, path: str) -> bool:
        if self.clock() < self.deadline:
            return False
        if not any(r.startswith("archive time limit reached") for r in self.reasons):
            self.reasons.append(f"archive time limit reached at {path}")
        return True

    def _over_ratio(self, size: int, packed: int) -> bool:
        return size > packed * self.limits.archive_ratio

    def _reserve(self, size: int, path: str) -> bool:
        """Greedy: a member that doesn't fit is skipped, later smaller ones may still fit."""
        if self._late(path):
            return False
        if self.expanded + size > self.byte_limit:
            self.reasons.append(f"archive expanded byte limit reached before {path}")
            return False
        self.expanded += size
        return True

    def _emit(self, path: str, content: bytes, depth: int, out: list[tuple[str, bytes]]) -> None:
        if self.members >= self.member_limit:
            self.reasons.append(f"archive member limit reached at {path}")
            return
        out.extend(self.expand(path, content, depth + 1))
        out.append((path, content))
        self.members += 1

    def _zip(self, path: str, content: bytes, depth: int, out: list[tuple[str, bytes]]) -> None:
        try:
            archive = zipfile.ZipFile(io.BytesIO(content))
        except (zipfile.BadZipFile, ValueError, NotImplementedError) as error:
            self.reasons.append(f"cannot parse ZIP archive {path}: {error}")
            return
        entries = archive.infolist()
        room = max(0, self.member_limit - self.members)
        if len(entries) > room:
            self.reasons.append(f"archive member limit of {self.limits.archive_members} reached at {path}")
        for entry in entries[:room]:
            if self._late(path):
                break
            try:
                member = safe_member_path(entry.orig_filename.encode("utf-8" if entry.flag_bits & 0x800 else "cp437"), self.limits.archive_path_bytes)
            except ValueError as error:
                self.reasons.append(f"{error} in {path}")
                continue
            child = f"{path}!/{member}"
            if entry.is_dir():
                continue
            if stat.S_ISLNK(entry.external_attr >> 16):
                self.reasons.append(f"ZIP symlink member skipped: {child}")
            elif self._over_ratio(entry.file_size, entry.compress_size):
                self.reasons.append(f"ZIP compression ratio limit reached: {child}")
            elif entry.file_size > self.member_bytes:
                self.reasons.append(f"archive member exceeds byte limit: {child}")
            elif self._reserve(entry.file_size, child):
                try:
                    with archive.open(entry) as stream:
                        data = stream.read(entry.file_size + 1)
                except (zipfile.BadZipFile, zlib.error, EOFError, RuntimeError, NotImplementedError, OSError) as error:
                    self.reasons.append(f"cannot decompress {child}: {error}")
                    continue
                if len(data) != entry.file_size:
                    self.reasons.append(f"ZIP member size mismatch: {child}")
                elif not self._late(child):
                    self._emit(child, data, depth, out)

    def _tar(self, path: str, content: bytes, depth: int, out: list[tuple[str, bytes]]) -> None:
        try:
            archive = tarfile.open(fileobj=io.BytesIO(content), mode="r:", encoding="utf-8", errors="surrogateescape")
        except (tarfile.TarError, ValueError) as error:
            self.reasons.append(f"cannot read TAR archive {path}: {error}")
            return
        index = 0
        while not self._late(path):
            if self.members >= self.member_limit:
                self.reasons.append(f"archive member limit of {self.limits.archive_members} reached at {path}")
                break
            try:
                entry = archive.next()
            except (tarfile.TarError, ValueError, OSError) as error:
                self.reasons.append(f"cannot read TAR member {index} in {path}: {error}")
                break
            if entry is None:
                break
            index += 1
            try:
                member = safe_member_path(entry.name.encode("utf-8", "surrogateescape"), self.limits.archive_path_bytes)
            except ValueError as error:
                self.reasons.append(f"{error} in {path}")
                continue
            child = f"{path}!/{member}"
            if entry.isdir():
                continue
            if entry.issym() or entry.islnk():
                self.reasons.append(f"TAR link member skipped: {child}")
            elif not entry.isreg():
                self.reasons.append(f"unsupported TAR member skipped: {child}")
            elif entry.size > self.member_bytes:
                self.reasons.append(f"archive member exceeds byte limit: {child}")
            elif self._reserve(entry.size, child):
                try:
                    data = archive.extractfile(entry).read(entry.size + 1)
                except (tarfile.TarError, OSError) as error:
                    self.reasons.append(f"cannot read {child}: {error}")
                    continue
                if len(data) != entry.size:
                    self.reasons.append(f"TAR member size mismatch: {child}")
                elif not self._late(child):
                    self._emit(child, data, depth, out)

    def _gzip(self, path: str, content: bytes, depth: int, out: list[tuple[str, bytes]]) -> None:
        if self._late(path):
            return
        name = path.rsplit("/", 1)[-1]
        child = f"{path}!/{name.removesuffix('.gz') if name.endswith('.gz') and name != '.gz' else 'content'}"
        most = min(self.member_bytes, max(0, self.limits.archive_bytes - self.expanded))
        inflater = zlib.decompressobj(31)
        try:
            data = inflater.decompress(content, most + 1)
            if not inflater.eof and len(data) <= most:
                raise zlib.error("incomplete or truncated stream")
        except zlib.error as error:
            self.reasons.append(f"cannot decompress gzip archive {path}: {error}")
            return
        if len(data) > most:
            self.reasons.append(f"gzip member exceeds byte limit: {child}")
        elif self._over_ratio(len(data), len(content)):
            self.reasons.append(f"gzip compression ratio limit reached: {child}")
        elif not self._late(child) and self._reserve(len(data), child):
            self._emit(child, data, depth, out)
