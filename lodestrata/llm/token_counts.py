"""Token counts with a linear longest-match automaton.

Greedy word-piece matching takes the longest vocabulary entry at each point.
The automaton is the vocabulary's trie with, for each node, the number of
pieces that greedy matching pops when the next byte has no edge, and the node
where it goes on (the failure link). Each byte is looked at once and no piece
is built; a word's length in pieces is the sum of what was popped.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_pair import Store, byte_letters
from .common import as_bytes

MISSING = -1


class LongestMatch:
    """Counts greedy pieces over a vocabulary of byte strings that holds every single byte that occurs; a byte that no entry starts with counts as one piece."""

    def __init__(self, vocabulary: list[bytes]) -> None:
        self.edges: dict[int, int] = {}  # node * 256 + byte -> node; node 0 is the root
        words, n = {0: False}, 1
        for entry in vocabulary:
            node = 0
            for byte in entry:
                if (to := self.edges.get(node * 256 + byte)) is None:
                    to = self.edges[node * 256 + byte] = n
                    words[n] = False
                    n += 1
                node = to
            words[node] = True
        children: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for key, to in self.edges.items():
            children[key // 256].append((key % 256, to))
        self.fail, self.popped = [0] * n, [0] * n
        self.fail[0] = MISSING
        level = [0]
        while level:
            deeper = []
            for node in level:
                for byte, child in children[node]:
                    deeper.append(child)
                    if words[child]:
                        self.popped[child] = 1
                        continue
                    at, count = self.fail[node], 0
                    while at != MISSING and at * 256 + byte not in self.edges:
                        count, at = count + self.popped[at], self.fail[at]
                    if at == MISSING:
                        self.fail[child] = MISSING
                    else:
                        self.fail[child] = self.edges[at * 256 + byte]
                        self.popped[child] = self.popped[node] + count
            level = deeper

    def count(self, word: bytes) -> int:
        edges, fail, popped = self.edges, self.fail, self.popped
        node = total = 0
        for byte in word:
            while (to := edges.get(node * 256 + byte)) is None:
                if node == 0 or fail[node] == MISSING:  # no entry matches here
                    total, to = total + 1, 0
                    break
                total, node = total + popped[node], fail[node]
            node = to
        while node:
            total, node = total + popped[node], fail[node]
        return total


@functools.cache
def matcher(path: str) -> LongestMatch:
    """The automaton of a byte-level tokenizer file; one for each worker process."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"] for t in spec.get("added_tokens", [])}
    byte_of = {c: b for b, c in enumerate(byte_letters())}
    return LongestMatch([bytes(byte_of[c] for c in entry) for entry in spec["model"]["vocab"] if entry not in special])


@functools.cache
def _counts(path: str) -> Store:
    automaton = matcher(path)
    return Store(lambda word: automaton.count(b" " + word))


def _count_batches(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _counts(path)
        for batch in batches:
            words = [t.as_py().split() for t in batch.column("text")]
            totals = [sum(map(counts.__getitem__, w)) for w in words]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(map(len, words), pa.int64()), pa.array(totals, pa.int64())], ["doc_id", "n_words", "n_tokens"])

    return run


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_tokens.

    Words are separated by spaces and the controls 9 to 13; each is matched
    greedily with one space before it, as byte-level vocabularies spell words
    inside a text. Null and empty texts have no words and no tokens. Repeated
    rows and ids give repeated rows; other columns are not read. No rows give
    no rows. Time is linear in a text's length.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), as_bytes(F.col(text_col)).alias("text"))
    return texts.mapInArrow(_count_batches(path), f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_words long, n_tokens long")
