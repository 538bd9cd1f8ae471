"""Reports written by tasks: a data source whose writer makes a file for each repository.

Rows come as (repo_id, section, place, body): section 0 is the head of a report,
later ones its arrays, body a piece of JSON. A task streams the rows of its
repositories, in order, into staged files, so a report is never held whole; the
driver moves them to their names when all tasks are done, writes a manifest and
drops what an earlier manifest named. A task or job that fails leaves staged
files alone, which are removed, and nothing that a reader sees.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any
from urllib.parse import quote

from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..operators.findings import FINDING_FIELDS
from ..operators.ranges import places
from .render import NAME, SARIF_LEVELS, SARIF_SCHEMA, SCHEMA_VERSION, VERSION, sarif_result

FORMAT = "lodestrata_report"
COLUMNS = "repo_id string, section int, place long, body string"
#: The arrays of a JSON report by section; SARIF has the findings only.
SECTIONS = {1: "files", 2: "findings", 3: "unresolved_edges", 4: "incomplete_reasons"}
SUFFIXES = {"json": ".json", "sarif": ".sarif"}
MANIFEST = "_reports.json"


def open_folder(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and the folder of a path or address, as pyarrow knows them: file, hdfs, s3, gs, abfs."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
    return fs.LocalFileSystem(), path


@dataclass
class Staged(WriterCommitMessage):
    files: list[tuple[str, str]]  # (staged path, name of the report)


class _JsonReport:
    def __init__(self, out, head: dict[str, Any]) -> None:
        self.out, self.section, self.tail = out, 0, {}
        top = {"schema_version": SCHEMA_VERSION, "scanner": NAME, "scanner_version": VERSION, **{k: v for k, v in head.items() if k != "rules"}, "network_access": "disabled"}
        self.out.write(json.dumps(top, ensure_ascii=False)[:-1].encode())

    def add(self, section: int, body: Any) -> None:
        self._to(section)
        self.out.write((b",\n" if self.some else b"\n") + json.dumps(body, ensure_ascii=False).encode())
        self.some = True

    def _to(self, section: int) -> None:
        while self.section < section:
            self.out.write(b"]" if self.section else b"")
            self.section += 1
            self.out.write(f', "{SECTIONS[self.section]}": ['.encode())
            self.some = False

    def close(self) -> None:
        self._to(len(SECTIONS))
        self.out.write(b"]}\n")


class _SarifReport:
    def __init__(self, out, head: dict[str, Any]) -> None:
        self.out, self.some = out, False
        self.head = head
        self.index = {r["id"]: i for i, r in enumerate(head["rules"])}
        rules = [{"id": r["id"], "name": r["id"], "shortDescription": {"text": r["title"]}, "defaultConfiguration": {"level": SARIF_LEVELS[r["severity"]]}} for r in head["rules"]]
        start = {"$schema": SARIF_SCHEMA, "version": "2.1.0", "runs": [{"tool": {"driver": {"name": NAME, "version": VERSION, "rules": rules}}, "results": []}]}
        self.out.write(json.dumps(start, ensure_ascii=False).encode().removesuffix(b"]}]}"))

    def add(self, section: int, body: Any) -> None:
        if section == 2:
            full = {"file": None, "line": None, "evidence": [], **body}
            self.out.write((b",\n" if self.some else b"\n") + json.dumps(sarif_result(full, self.index[body["id"]]), ensure_ascii=False).encode())
            self.some = True

    def close(self) -> None:
        properties = {"scanStatus": self.head["status"], "networkAccess": "disabled", "scanProfile": self.head["profile"]}
        self.out.write(b'], "properties": ' + json.dumps(properties).encode() + b"}]}\n")


KINDS = {"json": _JsonReport, "sarif": _SarifReport}


class ReportWriter(DataSourceWriter):
    def __init__(self, path: str, kind: str, overwrite: bool) -> None:
        self.path, self.kind, self.overwrite = path.rstrip("/"), kind, overwrite
        self.staging = f"_staged-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Staged:
        files, folder = open_folder(self.path)
        mine = f"{folder}/{self.staging}/{uuid.uuid4().hex}"  # a new one for each attempt
        made: list[tuple[str, str]] = []
        repo = report = out = None
        for row in iterator:
            if report is None or row["repo_id"] != repo:
                if report is not None:
                    report.close()
                    out.close()
                repo = row["repo_id"]
                if row["section"] != 0:
                    raise ValueError(f"rows of {repo!r} without a head")
                if not made:
                    files.create_dir(mine, recursive=True)
                made.append((f"{mine}/{len(made)}", quote(str(repo), safe="") + SUFFIXES[self.kind]))
                out = files.open_output_stream(made[-1][0], compression=None)
                report = KINDS[self.kind](out, json.loads(row["body"]))
            else:
                report.add(row["section"], json.loads(row["body"]))
        if report is not None:
            report.close()
            out.close()
        return Staged(made)

    def commit(self, messages: list[Staged | None]) -> None:
        files, folder = open_folder(self.path)
        manifest, names = f"{folder}/{MANIFEST}", []
        before: list[str] = []
        if files.get_file_info(manifest).type == fs.FileType.File:
            with files.open_input_stream(manifest) as f:
                before = json.loads(f.read())["reports"]
        for message in messages:
            for staged, name in message.files if message else ():
                files.move(staged, f"{folder}/{name}")
                names.append(name)
        kept = [] if self.overwrite else before
        files.create_dir(folder, recursive=True)
        with files.open_output_stream(manifest, compression=None) as f:
            f.write(json.dumps({"kind": self.kind, "reports": sorted({*kept, *names})}).encode())
        for name in {*before} - {*names} - {*kept}:
            files.delete_file(f"{folder}/{name}")
        self._clear()

    def abort(self, messages: list[Staged | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        files, folder = open_folder(self.path)
        if files.get_file_info(f"{folder}/{self.staging}").type == fs.FileType.Directory:
            files.delete_dir(f"{folder}/{self.staging}")


class ReportSource(DataSource):
    """df.write.format("lodestrata_report").option("kind", "sarif").mode("overwrite").save(folder)"""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return COLUMNS

    def writer(self, schema, overwrite: bool) -> ReportWriter:
        kind = self.options.get("kind", "json")
        if kind not in KINDS:
            raise ValueError(f"unknown kind of report: {kind}")
        return ReportWriter(self.options["path"], kind, overwrite)


def report_lines(summary: DataFrame, findings: DataFrame, others: dict[int, tuple[DataFrame, Column]] | None = None, profile: str = "default") -> DataFrame:
    """Rows of the sink: a head from each row of summary(repo_id, status, risk, summary), its findings (repo_id, severity_rank, the finding's fields, emit_seq) in report order, and other sections as (rows, body)."""
    firsts = findings.groupBy("repo_id", "id").agg(F.min_by(F.struct("title", "severity"), F.struct(-F.col("severity_rank"), F.col("file"), F.col("emit_seq"))).alias("f"))
    rules = firsts.groupBy("repo_id").agg(F.array_sort(F.collect_list(F.struct("id", "f.title", "f.severity"))).alias("rules"))  # as many as there are rules
    no_rules = F.expr("cast(array() as array<struct<id: string, title: string, severity: string>>)")
    head = F.to_json(F.struct(F.col("repo_id").alias("target"), F.lit(profile).alias("profile"), "status", "risk", "summary", F.coalesce("rules", no_rules).alias("rules")))
    out = summary.join(rules, "repo_id", "left").select("repo_id", F.lit(0).alias("section"), F.lit(0).cast("long").alias("place"), head.alias("body"))
    ordered = places(findings, ["repo_id"], [F.col("severity_rank").desc(), F.col("file").asc_nulls_first(), "id", "emit_seq"], "place")
    out = out.unionByName(ordered.select("repo_id", F.lit(2).alias("section"), "place", F.to_json(F.struct(*FINDING_FIELDS), {"ignoreNullFields": "false"}).alias("body")))
    for section, (rows, body) in (others or {}).items():
        out = out.unionByName(rows.select("repo_id", F.lit(section).alias("section"), F.xxhash64(body).alias("place"), body.alias("body")))
    return out


def write_reports(lines: DataFrame, path: str, kind: str) -> None:
    """Writes a report of each repository into the folder; a task streams whole repositories, one after another."""
    lines.sparkSession.dataSource.register(ReportSource)
    dealt = lines.repartition("repo_id").sortWithinPartitions("repo_id", "section", "place")
    dealt.select("repo_id", "section", "place", "body").write.format(FORMAT).option("kind", kind).mode("overwrite").save(path)
