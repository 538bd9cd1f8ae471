"""The registered queries: an operator each over whole given tables."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..api import register_functions
from ..functions.content import byte_entropy, gzip_bytes, line_count, longest_match, max_line_length
from ..functions.signals import ipv4_tokens, raw_signals, wallet_tokens
from ..operators import files as FILE
from ..operators import graph as G
from ..js.extract import extract_scripts
from ..js.tables import analyse_sources
from ..operators.findings import cap_per_repo, first_per_key, risk, severity_at_least, severity_rank
from ..operators.findings import new_findings as unseen
from ..sources.walk import expand_archives
from . import corpora as C
from . import given_tables
from .scan import summaries

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = dict(given_tables.QUERIES)


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.table(spark, sf_dir, "documents").select("doc_id", "text", F.encode("text", "UTF-8").alias("content"))


@query
def byte_entropies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", F.round(byte_entropy("content"), 6).alias("entropy"))


@query
def line_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", line_count(F.col("content")).alias("line_count"), max_line_length(F.col("content")).alias("max_line_length"))


@query
def longest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return _documents(spark, sf_dir).select(
        "doc_id", longest_match(text, "[0-9A-Fa-f]+").cast("long").alias("hex_run"), longest_match(text, "[A-Za-z0-9+/=]+").cast("long").alias("base64_run"), longest_match(text, "[ \t]+").cast("long").alias("blank_run")
    )


@query
def content_sha256(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", F.sha2("content", 256).alias("sha256"))


@query
def duplicate_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = content_sha256(spark, sf_dir).groupBy("sha256").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc"))
    return groups.filter("copies > 1")


@query
def address_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", ipv4_tokens(F.col("text")).alias("ipv4"), wallet_tokens(F.col("text")).alias("wallets"))


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = C.spread(_documents(spark, sf_dir)).withColumn("longest", max_line_length(F.col("content"))).withColumn("entropy", byte_entropy("content"))
    signals = raw_signals(F.col("text"), F.col("longest"), F.octet_length("content"), F.col("entropy"))
    return measured.select("doc_id", "longest", signals.alias("signals"))


@query
def raw_signal_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    # An outer explode: an inner one adds a filter on the signals, which is pushed down and finds them all a second time.
    found = _signals(spark, sf_dir).select("doc_id", F.posexplode_outer("signals").alias("position", "signal")).filter("signal is not null")
    return found.withColumn("position", F.col("position").cast("long"))


@query
def raw_signal_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.regexp_replace("signal", "[: ]*[0-9][0-9.]*.*$", "")
    return raw_signal_rows(spark, sf_dir).groupBy(name.alias("signal")).agg(F.count("*").alias("n"))


def _document_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings over documents by simple text rules, with more variety than prose gives the real ones."""
    docs = C.table(spark, sf_dir, "documents")
    rules = [("LONG-TEXT", "medium", 40, F.length("text") > 5000), ("SYMBOLS", "high", 75, F.col("text").contains("###")), ("SHORT-TEXT", "low", 10, F.length("text") < 400), ("PIPES", "critical", 97, F.col("text").contains(" | "))]
    found = F.array_compact(F.array(*[F.when(hit, F.struct(F.lit(i).alias("id"), F.lit(s).alias("severity"), F.lit(n).alias("score"))) for i, s, n, hit in rules]))
    return docs.select(F.col("source").alias("repo_id"), F.col("doc_id"), F.concat("lang", F.lit("/"), F.col("doc_id") % 50).alias("file"), F.posexplode(found).alias("position", "f")).select(
        "repo_id", "file", "f.*", (F.col("doc_id") * 10 + F.col("position")).alias("emit_seq")
    )


@query
def risk_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk(_document_findings(spark, sf_dir))


@query
def severity_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return severity_at_least(_document_findings(spark, sf_dir), "high").groupBy("repo_id", "severity").agg(F.count("*").alias("n"))


@query
def summary_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary of every source as a repository; one that holds a very long text counts as incomplete."""
    files = C.document_files(spark, sf_dir)
    totals = files.groupBy("repo_id").agg(F.count("*").alias("entries"), F.count_if(F.col("kind") == "file").alias("files"), F.sum("size").alias("content_bytes"))
    counts = totals.unpivot("repo_id", ["entries", "files", "content_bytes"], "note", "size")
    coverage = files.filter("size > 40000").select("repo_id", F.lit("long text").alias("reason")).distinct()
    found = summaries(counts, _document_findings(spark, sf_dir), coverage)
    return found.select("repo_id", "status", "risk.severity", F.col("risk.score").cast("long").alias("score"), *[F.col(f"summary.{c}").alias(c) for c in ("entries", "files", "symlinks", "content_bytes", "findings")])


@query
def finding_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cap_per_repo(_document_findings(spark, sf_dir), 7)[0].select("repo_id", "id", "emit_seq")


@query
def first_finding_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_per_key(_document_findings(spark, sf_dir), ["repo_id", "id", "file"], ["emit_seq"]).select("repo_id", "id", "file", "emit_seq")


@query
def finding_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = [severity_rank(F.col("severity")).desc(), F.col("file").asc_nulls_first(), F.col("id"), F.col("emit_seq")]
    return G.numbered(_document_findings(spark, sf_dir), ordered, "place").select("repo_id", "place", "severity", "file", "id", "emit_seq")


@query
def union_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of three producers as one list, in order of producer."""
    found = _document_findings(spark, sf_dir)
    parts = [found.filter(F.col("severity") == s).select("repo_id", "id", "emit_seq") for s in ("critical", "high", "medium")]
    return G.union_in_order(parts).groupBy("part", "repo_id", "id").agg(F.count("*").alias("n"), F.min("emit_seq").alias("first_seq"))


@query
def new_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of all documents that the labelled ones don't have, by source, file and rule."""
    current = _document_findings(spark, sf_dir).withColumn("path", F.col("file")).withColumn("line", F.lit(None).cast("long")).withColumn("evidence", F.array("severity"))
    known = C.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("known")).distinct()
    previous = current.join(known, (F.col("emit_seq") / 10).cast("long") == F.col("known"), "left_semi")
    return unseen(current, previous.select("repo_id", "path", "id", "line", "evidence").distinct()).select("repo_id", "file", "id", "emit_seq")


@query
def tree_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as tree entries against a base that lacks some and has others changed."""
    head = C.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("path"), F.col("o_orderstatus").alias("blob"), F.col("o_totalprice").alias("mode"))
    base = head.filter("path % 11 != 0").withColumn("blob", F.when(F.col("path") % 7 == 0, F.lit("changed")).otherwise(F.col("blob")))
    return G.tree_changes(head, base, ["path"], ["blob", "mode"]).select("path", "blob")


@query
def script_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inline scripts of pages: number and body."""

    @F.pandas_udf("array<string>")
    def bodies(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [b.source for b in extract_scripts(t or "", False)[0] if not b.external])

    return C.table(spark, sf_dir, "pages").select("page_id", F.posexplode(bodies("html")).alias("number", "body")).withColumn("number", F.col("number").cast("long"))


@query
def combined_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remote executions and exfiltrations that share a trigger; documents stand in for findings."""
    docs = C.table(spark, sf_dir, "documents")
    kind = F.when(F.col("doc_id") % 3 == 0, "JS-REMOTE-CODE-EXECUTION").when(F.col("doc_id") % 3 == 1, "JS-SECRET-EXFILTRATION").otherwise("JS-PERSISTENCE-WRITE")
    trigger = F.when(F.col("doc_id") % 5 == 0, "trigger: unresolved").otherwise(F.concat(F.lit("trigger: npm "), F.col("lang")))
    found = docs.select(F.col("source").alias("repo_id"), F.col("doc_id").alias("emit_seq"), kind.alias("id"), F.array(trigger).alias("evidence"), F.concat("lang", F.lit(".js")).alias("file"), F.col("doc_id").alias("line"))
    return G.combined_chains(found).select("repo_id", "file", "line", F.element_at("evidence", 1).alias("execution"), F.element_at("evidence", 2).alias("exfiltration"))


@query
def concealment_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: every document classified as a file, its findings, and the risk of its source."""
    found = FILE.classify(C.document_files(spark, sf_dir)).select("repo_id", "seq", "size", F.size("raw_signals").alias("signals"), "found")
    top = F.array_max(F.transform("found", lambda f: f["score"]))
    return found.groupBy("repo_id").agg(
        F.count("*").alias("files"), F.sum("size").alias("content_bytes"), F.sum("signals").cast("long").alias("signals"), F.sum(F.size("found")).cast("long").alias("findings"), F.coalesce(F.max(top), F.lit(0)).cast("long").alias("score")
    )


@query
def page_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scripts of pages read as JavaScript: modules and calls of each page."""
    pages = C.table(spark, sf_dir, "pages")
    texts = pages.select(F.lit("pages").alias("repo_id"), F.col("page_id").alias("seq"), F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.col("html").alias("text"))
    found = analyse_sources(texts)
    calls = F.aggregate("modules", F.lit(0), lambda n, m: n + F.size(m["calls"]))
    return found.select(F.col("seq").alias("page_id"), F.size("modules").cast("long").alias("modules"), calls.cast("long").alias("calls"), F.size("reasons").cast("long").alias("unread"))


@query
def archive_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page gzipped and expanded again: member names and contents' hashes."""
    pages = C.table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("repo_id"), F.concat(F.col("page_id").cast("string"), F.lit(".html.gz")).alias("path"), F.encode("html", "UTF-8").alias("plain"))
    packed = pages.select("repo_id", "path", gzip_bytes("plain").alias("content"))
    members = expand_archives(packed)
    return members.select("repo_id", "path", F.sha2("content", 256).alias("sha256"), "reason")


@query
def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The functions for SQL, over all documents."""
    register_functions(spark)
    C.table(spark, sf_dir, "documents").createOrReplaceTempView("lodestrata_documents")
    return spark.sql("SELECT doc_id, round(byte_entropy(encode(text, 'UTF-8')), 6) AS entropy, cast(longest_run(text, '[0-9A-Fa-f]+') AS bigint) AS hex_run, cast(line_count(text) AS bigint) AS lines FROM lodestrata_documents")
