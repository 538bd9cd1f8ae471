"""Scan limits by profile. Reaching any of them makes a scan incomplete, never silently smaller."""

from __future__ import annotations

from dataclasses import dataclass, replace

MIB = 1 << 20
GIB = 1 << 30


@dataclass(frozen=True)
class ScanLimits:
    # The limits of the default profile.
    max_depth: int = 64
    max_entries: int = 200_000
    max_file_bytes: int = 64 * MIB
    max_total_bytes: int = 2 * GIB
    max_findings: int = 20_000
    archive_depth: int = 3
    archive_members: int = 20_000
    archive_bytes: int = 256 * MIB
    archive_member_bytes: int = 16 * MIB
    archive_seconds: float = 30
    archive_ratio: int = 1000
    archive_path_bytes: int = 4096
    modules: int = 20_000
    module_bytes: int = 64 * MIB
    parse_bytes: int = 4 * MIB
    parse_nesting: int = 256
    embedded_scripts: int = 256
    markdown_fences: int = 4096
    markdown_spans: int = 32_768
    module_facts: int = 50_000
    config_bytes: int = 4 * MIB
    language_bytes: int = 16 * MIB
    graph_edges: int = 50_000
    roots: int = 50_000
    roots_per_file: int = 10_000
    command_nesting: int = 8
    route_length: int = 64
    flow_nesting: int = 512
    export_hops: int = 32
    route_steps: int = 16
    flow_work_per_byte: int = 512
    flow_module_work: tuple[int, int] = (100_000, 32_000_000)
    flow_total_work: int = 100_000_000
    git_object_bytes: int = 16 * MIB
    git_changed_blobs: int = 20_000
    git_changed_bytes: int = 256 * MIB
    git_tree_entries: int = 250_000
    git_commits: int = 100
    git_history_entries: int = 1_000_000
    git_tree_depth: int = 64
    git_parents: int = 64
    git_history_findings: int = 2_000


DEFAULT = ScanLimits()
QUICK = replace(
    DEFAULT, max_depth=32, max_entries=20_000, max_file_bytes=16 * MIB, max_total_bytes=512 * MIB, archive_depth=1, archive_members=5_000, archive_bytes=64 * MIB,
    archive_seconds=5, git_commits=10, git_history_entries=100_000,
)
DEEP = replace(DEFAULT, archive_depth=6, archive_members=50_000, archive_bytes=512 * MIB, archive_member_bytes=32 * MIB, archive_seconds=60)
PROFILES = {"quick": QUICK, "default": DEFAULT, "deep": DEEP}
