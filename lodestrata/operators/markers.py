"""Rules that are told by markers, from one table of hits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .automaton import Marker
from .files import EXECUTABLE_MARKERS
from .languages import INDICATORS
from .signatures import SIGNATURES

#: Markers of executable text that a file of another kind needs.
EXECUTABLE_LEAST = 2


def rule_markers() -> tuple[list[Marker], list[tuple[str, str, int, str]]]:
    """(distinct markers, rows (rule, group, how many of the group's markers are needed, marker)): a rule holds where each of its groups has enough.

    Names of markers are their texts, with how they are read before those that tell cases apart.
    """
    markers: dict[str, Marker] = {}
    rows = []

    def need(rule: str, group: str, least: int, text: str, folded: bool, tail: str | None = None) -> None:
        name = text if folded and not tail else f"{text}{tail or ''}" if folded else f"exact {text}"
        markers[name] = Marker(name, text, folded, tail)
        rows.append((rule, group, least, name))

    for text in EXECUTABLE_MARKERS:
        need("executable text", "any", EXECUTABLE_LEAST, text, False)
    for _, rule, _, _, patterns in SIGNATURES:
        for i, pattern in enumerate(patterns):
            literal, space, tail = pattern.partition(r"\s+")
            need(rule, str(i), 1, literal, True, space + tail if space else None)
    for language, (sources, sinks) in INDICATORS.items():
        for group, needles in (("source", sources), ("sink", sinks)):
            for text in needles:
                need(f"{language} remote execution", group, 1, text, True)
    return list(markers.values()), rows


def marker_rules(hits: DataFrame, keys: list[str], rules: list[tuple[str, str, int, str]] | None = None) -> DataFrame:
    """keys, rule, markers, first_line: the rules that hold for each key of marker hits, the number of their markers that it has and the line of the first. rules are rows as of rule_markers."""
    spark = hits.sparkSession
    table = spark.createDataFrame(rules or rule_markers()[1], "rule string, part string, least int, marker string")  # fixed: some hundred rows
    sizes = table.groupBy("rule").agg(F.count_distinct("part").cast("int").alias("parts"))
    met = hits.join(F.broadcast(table), "marker").groupBy(*keys, "rule", "part", "least").agg(F.count("*").alias("n"), F.min("first_line").alias("first_line")).filter("n >= least")
    held = met.groupBy(*keys, "rule").agg(F.count("*").cast("int").alias("held"), F.sum("n").alias("markers"), F.min("first_line").alias("first_line"))
    return held.join(F.broadcast(sizes), "rule").filter("held = parts").select(*keys, "rule", "markers", "first_line")
