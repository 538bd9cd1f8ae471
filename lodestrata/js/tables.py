"""The JavaScript reader and the data-flow interpreter as Spark operators."""

from __future__ import annotations

import pickle
import sys
import threading
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import exact_extension
from ..limits import DEFAULT, ScanLimits
from ..operators.files import JS_EXTENSIONS, executable_markers
from ..schemas import FINDING
from .analyse import ASSET_EXTENSIONS, analyse_file
from .extract import DOCUMENT_KINDS
from .facts import ModuleFacts
from .flow import analyse_flows

STACK_BYTES, RECURSION = 512 << 20, 200_000
MODULE = (
    "struct<id: string, flow_enabled: boolean, source_bytes: bigint, imports: array<struct<specifier: string, line: bigint>>, "
    "calls: array<struct<name: string, line: bigint, evidence: string, capability: string, function: string>>, flow: binary>"
)
ANALYSED = f"repo_id string, seq long, path string, language string, disguised boolean, reasons array<string>, embedded array<struct<id: string, line: bigint>>, modules array<{MODULE}>"
FLOW_FOUND = "repo_id string, position long, reason string, " + FINDING.lower()
_FINDING_NAMES = [x.split(" ")[0].lower() for x in FINDING.split(", ")]
#: Files of a batch; texts can be large.
BATCH_FILES = 256


def with_deep_stack(work: Callable[[], object]) -> object:
    """Runs work where deep trees fit: long sums of strings make trees as deep as they are long."""
    out: list[object] = []

    def run() -> None:
        sys.setrecursionlimit(RECURSION)
        try:
            out.append(work())
        except BaseException as error:  # carried over to the caller's thread
            out.append(error)

    before = threading.stack_size(STACK_BYTES)
    thread = threading.Thread(target=run)
    thread.start()
    threading.stack_size(before)
    thread.join()
    if isinstance(out[0], BaseException):
        raise out[0]
    return out[0]


def _row(repo: str, seq: int, path: str, text: str | None, limits: ScanLimits) -> tuple:
    a = analyse_file(path, text, limits)
    modules = [
        {
            "id": m.id, "flow_enabled": m.flow_enabled, "source_bytes": m.source_bytes,
            "imports": [{"specifier": s, "line": n} for s, n in m.imports],
            "calls": [dict(zip(("name", "line", "evidence", "capability", "function"), c, strict=True)) for c in m.calls],
            "flow": pickle.dumps(m.flow, 5),
        }
        for m in a.modules
    ]
    return repo, seq, path, a.language, a.disguised, a.reasons, [{"id": i, "line": n} for i, n in a.embedded], modules


def analyse_sources(texts: DataFrame, limits: ScanLimits = DEFAULT) -> DataFrame:
    """One row per file of texts(repo_id, seq, path, text) that may hold JavaScript; see ANALYSED. What can't is filtered out in the JVM."""
    suffix = exact_extension(F.col("path"))
    text = F.col("text")
    likely = suffix.isin(JS_EXTENSIONS) | (text.isNotNull() & (suffix.isin(*DOCUMENT_KINDS, *ASSET_EXTENSIONS) | (executable_markers(text) >= 2)))
    columns = [c.split(" ")[0] for c in ANALYSED.split(", ")[:5]] + ["reasons", "embedded", "modules"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo in range(0, len(batch), BATCH_FILES):
                part = batch.iloc[lo : lo + BATCH_FILES]
                rows = with_deep_stack(lambda part=part: [_row(*r, limits) for r in part[["repo_id", "seq", "path", "text"]].itertuples(index=False)])
                yield pd.DataFrame(rows, columns=columns)

    return texts.filter(F.coalesce(likely, F.lit(False))).select("repo_id", "seq", "path", "text").mapInPandas(run, ANALYSED)


def flow_findings(modules: DataFrame, reachable: DataFrame, limits: ScanLimits = DEFAULT) -> DataFrame:
    """Findings of each repository in order of emission, and reasons; see FLOW_FOUND.

    The interpreter's state crosses modules, so a repository is one group; its
    modules are bounded by the scan limits. modules: repo_id, seq, id, path,
    flow_enabled, source_bytes, flow. reachable: repo_id, id, route.
    """

    def run(key: tuple, own: pd.DataFrame, reached: pd.DataFrame) -> pd.DataFrame:
        def work() -> tuple:
            facts = [
                ModuleFacts(r.id, r.path, bool(r.flow_enabled), int(r.source_bytes), flow=pickle.loads(r.flow))
                for r in own.sort_values("seq").itertuples(index=False)
            ]
            return analyse_flows(facts, {r.id: list(r.route) for r in reached.itertuples(index=False)}, limits)

        found, reasons = with_deep_stack(work) if len(own) else ([], [])
        rows = [(key[0], i, None, *(getattr(f, n) for n in _FINDING_NAMES)) for i, f in enumerate(found)]
        rows += [(key[0], len(found) + i, r, *[None] * len(_FINDING_NAMES)) for i, r in enumerate(reasons)]
        return pd.DataFrame(rows, columns=["repo_id", "position", "reason", *_FINDING_NAMES]).astype({"score": "Int32", "line": "Int64", "position": "int64"})

    left = modules.select("repo_id", "seq", "id", "path", "flow_enabled", "source_bytes", "flow").groupBy("repo_id")
    return left.cogroup(reachable.select("repo_id", "id", "route").groupBy("repo_id")).applyInPandas(run, FLOW_FOUND)
