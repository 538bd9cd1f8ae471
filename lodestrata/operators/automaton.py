"""All markers of all rules in one pass over a text.

A marker automaton is a trie of needles with failure links, compiled to one
table of next states: its cost for a byte doesn't depend on how many needles
there are. Output links list the needles that end in a state. Many places are
read at once: texts are cut into lanes, each of which begins a longest needle
earlier than its first own byte, so that every needle is seen whole in the lane
that its end falls into.

The table reads letters as lower case. Needles that tell cases apart, and those
with a further condition on what follows, are looked at once more where they
were found.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Own bytes of a lane, and bytes that are read together.
LANE_BYTES, PIECE_BYTES = 1024, 8 << 20


class Marker(NamedTuple):
    """A literal; folded: A-Z and a-z are the same; tail: a pattern that has to match right behind it."""

    name: str
    text: str
    folded: bool = True
    tail: str | None = None


class Hits(NamedTuple):
    """One entry for each text and marker that it has: number of the text, of the marker, first byte offset and line (from 1), number of occurrences, overlapping ones included."""

    text: np.ndarray
    marker: np.ndarray
    offset: np.ndarray
    line: np.ndarray
    count: np.ndarray


class MarkerAutomaton:
    def __init__(self, markers: Sequence[Marker]) -> None:
        self.markers = list(markers)
        self.needles = [m.text.encode() for m in self.markers]
        if not all(self.needles):
            raise ValueError("a marker has at least one byte")
        self.longest = max(map(len, self.needles), default=1)
        children: list[dict[int, int]] = [{}]
        ends: list[list[int]] = [[]]
        for number, needle in enumerate(self.needles):
            state = 0
            for byte in needle.lower():
                if byte not in children[state]:
                    children[state][byte] = len(children)
                    children.append({})
                    ends.append([])
                state = children[state][byte]
            ends[state].append(number)
        table = np.zeros((len(children), 256), np.int32)
        failure, queue = [0] * len(children), list(children[0].values())
        for byte, state in children[0].items():
            table[0, byte] = state
        for state in queue:  # level by level: what a state fails to is complete
            table[state] = table[failure[state]]
            ends[state] += ends[failure[state]]
            for byte, child in children[state].items():
                failure[child] = int(table[failure[state], byte])
                table[state, byte] = child
                queue.append(child)
        table[:, 65:91] = table[:, 97:123]
        self.table = (table * 256).reshape(-1)  # states are kept as places in the table
        self.first_out = np.cumsum([0, *map(len, ends)])
        self.out = np.array([n for e in ends for n in e], np.int64)
        self.has_out = np.diff(self.first_out) > 0

    def _ends(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, place of the last byte, state) wherever a needle ends; texts lie in data from starts on."""
        lanes = np.maximum(1, -(-sizes // LANE_BYTES))
        text = np.repeat(np.arange(len(sizes)), lanes)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        own = nth * LANE_BYTES
        begin = np.maximum(0, own - self.longest + 1)
        length = np.minimum(own + LANE_BYTES, sizes[text]) - begin
        order = np.argsort(-length, kind="stable")
        text, own, begin, length = text[order], own[order], begin[order], length[order]
        at, skip = starts[text] + begin, own - begin
        active = np.searchsorted(-length, -np.arange(int(length.max(initial=0))), side="left")  # lanes longer than each step
        state = np.zeros(len(text), np.int32)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for step, n in enumerate(active.tolist()):
            state = self.table[state[:n] + data[at[:n] + step]]
            lane = np.flatnonzero(self.has_out[state >> 8] & (skip[:n] <= step))
            if len(lane):
                found.append((text[lane], at[lane] + step, state[lane] >> 8))
        if not found:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def hits(self, texts: list[bytes]) -> Hits:
        sizes = np.array([len(t) for t in texts], np.int64)
        starts = np.cumsum(sizes) - sizes
        joined = b"".join(texts)
        data = np.frombuffer(joined, np.uint8)
        text, last, state = self._ends(data, starts, sizes)
        n = self.first_out[state + 1] - self.first_out[state]
        row = np.repeat(np.arange(len(state)), n)
        marker = self.out[np.repeat(self.first_out[state], n) + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)]
        text, first = text[row], last[row] + 1 - np.array([len(x) for x in self.needles], np.int64)[marker]
        keep = np.ones(len(marker), bool)
        for number, (spec, needle) in enumerate(zip(self.markers, self.needles, strict=True)):
            at = np.flatnonzero(marker == number) if not spec.folded or spec.tail else ()
            if len(at) and not spec.folded:
                keep[at] = (data[first[at][:, None] + np.arange(len(needle))] == np.frombuffer(needle, np.uint8)).all(axis=1)
            if len(at) and spec.tail:
                match = re.compile(spec.tail.encode(), re.IGNORECASE if spec.folded else 0).match
                ends = (starts + sizes)[text[at]]
                keep[at] &= [match(joined, a, b) is not None for a, b in zip((first[at] + len(needle)).tolist(), ends.tolist(), strict=True)]
        text, marker, first = text[keep], marker[keep], first[keep]
        order = np.lexsort((first, marker, text))
        text, marker, first = text[order], marker[order], first[order]
        new = np.flatnonzero((np.diff(text, prepend=-1) != 0) | (np.diff(marker, prepend=-1) != 0))
        breaks = np.flatnonzero(data == 10)
        line = np.searchsorted(breaks, first[new]) - np.searchsorted(breaks, starts[text[new]]) + 1
        return Hits(text[new], marker[new], first[new] - starts[text[new]], line, np.diff(np.append(new, len(text))))


@functools.lru_cache(maxsize=4)
def _compiled(markers: tuple[Marker, ...]) -> MarkerAutomaton:
    return MarkerAutomaton(markers)


def _hit_batches(markers: tuple[Marker, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _compiled(markers)
        names = np.array([m.name for m in markers], object)
        for batch in batches:
            content = batch.column("_content")
            lo = 0
            while lo < len(content):
                texts, held = [], 0
                while lo + len(texts) < len(content) and (not texts or held < PIECE_BYTES):
                    texts.append(content[lo + len(texts)].as_py() or b"")
                    held += len(texts[-1])
                hits = automaton.hits(texts)
                rows = pa.array(hits.text + lo)
                columns = [batch.column(i).take(rows) for i in range(batch.num_columns - 1)]
                columns += [pa.array(names[hits.marker], pa.string()), pa.array(hits.offset), pa.array(hits.line), pa.array(hits.count)]
                yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "marker", "first_offset", "first_line", "n"])
                lo += len(texts)

    return run


def marker_hits(rows: DataFrame, content: str, markers: Sequence[Marker]) -> DataFrame:
    """For each row and marker that its content (binary, or text as UTF-8) has: the row's other columns, marker, first_offset in bytes from 0, first_line from 1, n.

    Null content has no marker. Occurrences are counted where they begin, so
    they may overlap. Markers of one name are told apart by nothing but their
    rows. Every byte is read once, whatever the number of markers.
    """
    others = [c for c in rows.columns if c != content]
    added = {"marker": "string", "first_offset": "long", "first_line": "long", "n": "long"}
    if clash := set(others) & set(added):
        raise ValueError(f"columns of the result: {sorted(clash)}")
    plain = rows.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(others)], F.col(f"`{content}`").cast("binary").alias("_content"))
    schema = plain.drop("_content").schema
    for name, kind in added.items():
        schema = schema.add(name, kind)
    return plain.mapInArrow(_hit_batches(tuple(markers)), schema).toDF(*others, *added)
