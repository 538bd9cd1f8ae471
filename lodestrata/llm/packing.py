"""Packing of token streams into fixed windows by order-preserving dynamic programming.

Documents stay in order and are cut into consecutive windows of at most
`length` tokens. Cuts are allowed at document ends (free), sentence ends and,
where neither is near, inside a sentence (dearer). The least total of padding
and cut penalties satisfies

    cost[j] = penalty[j] + min over i with pos[j] - pos[i] <= length of
              cost[i] + length - (pos[j] - pos[i])

in which the minimum runs over a sliding range of cost[i] + pos[i], so a
monotone queue gives each transition in constant time. The stream of a
partition is planned a horizon at a time; what is near the horizon's end is
planned again with what follows. A partition's last window is cut into powers
of two, which need no padding.
"""

from __future__ import annotations

import functools
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .byte_pair import BytePairEncoder, encoder, packed, split_words
from .common import as_bytes
from .many_words import ManyStore, ManyWords

LENGTH, END_ID = 4096, 2
SENTENCE_PENALTY, INNER_PENALTY = 4, 12
#: Cuts inside a sentence are offered every so many tokens.
INNER_STEP = 64
HORIZON_WINDOWS, REPLANNED_WINDOWS = 128, 4
#: Words in a generation of a worker's store; their ids are small.
KEPT_WORDS = 500_000
#: Texts are encoded together until they have this many bytes, so that their new words are merged together.
CHUNK_BYTES = 1 << 20


def choose_cuts(positions: np.ndarray, penalties: np.ndarray, length: int) -> list[int]:
    """Cut positions, the last included, of least cost; positions ascend, are at most `length` apart, and start after an implied 0.

    The last window isn't padded: more will follow, or it is cut into powers of two. (Were it padded, all others could have its padding for nothing.)
    """
    pos, pen = [0, *positions.tolist()], [0, *penalties.tolist()]
    n = len(pos)
    cost, back = [0] * n, [0] * n
    queue: deque[int] = deque([0])  # indices with ascending cost + pos
    for j in range(1, n):
        at = pos[j]
        while at - pos[queue[0]] > length:
            queue.popleft()
        i = queue[0]
        back[j] = i
        value = cost[i] + pos[i] + length + pen[j]
        cost[j] = value - at
        if j == n - 1:
            back[j] = min(queue, key=lambda i: (cost[i], -i))
            break
        while queue and cost[queue[-1]] + pos[queue[-1]] >= value:
            queue.pop()
        queue.append(j)
    cuts, j = [], n - 1
    while j:
        cuts.append(pos[j])
        j = back[j]
    return cuts[::-1]


#: Kinds of places in a stream, the better ones later, and the penalties of a cut there.
NO_CUT, INNER, SENTENCE_END, DOC_END = range(4)
PENALTIES = np.array([0, INNER_PENALTY, SENTENCE_PENALTY, 0])


def cut_options(ids: np.ndarray, doc_ends: np.ndarray, ends_sentence: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, penalties) of allowed cuts of a stream; its end is one. ends_sentence is a table over ids."""
    kind = np.zeros(len(ids) + 1, np.uint8)
    step = min(INNER_STEP, length)
    kind[step::step] = INNER
    kind[1:][ends_sentence[ids]] = SENTENCE_END
    kind[doc_ends] = DOC_END
    positions = np.flatnonzero(kind)
    return positions, PENALTIES[kind[positions]]


def powers_of_two(n: int) -> list[int]:
    """Descending powers of two that add up to n."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


class Packer:
    """Takes documents in order and gives pieces: (doc_id, start, length, crc32, doc_tokens, sequence, offset)."""

    def __init__(self, length: int, ends_sentence: np.ndarray, first_sequence: int) -> None:
        self.length, self.ends_sentence, self.sequence = length, ends_sentence, first_sequence
        self.waiting: deque[tuple[object, np.ndarray, int]] = deque()  # (doc_id, ids, tokens of it already placed)
        self.tokens = 0

    def add(self, doc_id: object, ids: np.ndarray) -> Iterator[tuple]:
        self.waiting.append((doc_id, ids, 0))
        self.tokens += len(ids)
        if self.tokens >= HORIZON_WINDOWS * self.length:
            yield from self.plan(last=False)

    def finish(self) -> Iterator[tuple]:
        if self.tokens:
            yield from self.plan(last=True)

    def plan(self, last: bool) -> Iterator[tuple]:
        parts = [ids[placed:] for _, ids, placed in self.waiting]
        stream = np.concatenate(parts)
        ends = np.cumsum([len(p) for p in parts])
        positions, penalties = cut_options(stream, ends, self.ends_sentence, self.length)
        cuts = choose_cuts(positions, penalties, self.length)
        if not last:
            cuts = [c for c in cuts if c <= len(stream) - REPLANNED_WINDOWS * self.length]
        lengths = np.diff([0, *cuts]).tolist()
        if last and lengths[-1] < self.length:
            lengths[-1:] = powers_of_two(lengths[-1])
        for n in lengths:
            offset = 0
            while offset < n:
                doc_id, ids, placed = self.waiting[0]
                take = min(n - offset, len(ids) - placed)
                yield doc_id, placed, take, zlib.crc32(ids[placed : placed + take]), len(ids), self.sequence, offset
                offset += take
                if placed + take == len(ids):
                    self.waiting.popleft()
                else:
                    self.waiting[0] = (doc_id, ids, placed + take)
            self.sequence += 1
            self.tokens -= n


@functools.cache
def _packed_words(path: str, kept_words: int) -> tuple[BytePairEncoder, ManyStore]:
    """One for each worker process, so that tasks share what is known."""
    tokenizer = encoder(path, True, kept_words * 3 // 5)
    return tokenizer, ManyStore(ManyWords(tokenizer), kept_words)


def _chunks(batch: pa.RecordBatch) -> Iterator[list[tuple[object, bytes]]]:
    """The (doc_id, text) of a batch in order, CHUNK_BYTES together or one longer text."""
    chunk, held = [], 0
    for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
        chunk.append((doc_id, text.as_py()))
        held += len(chunk[-1][1])
        if held >= CHUNK_BYTES:
            yield chunk
            chunk, held = [], 0
    if chunk:
        yield chunk


def _pack_batches(path: str, length: int, end_id: int, kept_words: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, words = _packed_words(path, kept_words)
        end = packed([end_id])
        ends_sentence = np.zeros(max(*tokenizer.strings, end_id) + 1, bool)
        ends_sentence[[tokenizer.vocabulary[s] for c in ".!?" if (s := c + tokenizer.word_end) in tokenizer.vocabulary]] = True
        packer = Packer(length, ends_sentence, TaskContext.get().partitionId() << 32)

        def made(pieces: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(column), f.type) for column, f in zip(zip(*pieces, strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            pieces = []
            for chunk in _chunks(batch):
                encoded = [list(map(words.__getitem__, split_words(text))) for _, text in chunk]
                words.fill()
                for (doc_id, _), ids in zip(chunk, encoded, strict=True):
                    pieces += packer.add(doc_id, np.frombuffer(b"".join(ids) + end, "<u4"))
            if pieces:
                yield made(pieces)
        if pieces := list(packer.finish()):
            yield made(pieces)

    return run


def pack_documents(docs: DataFrame, path: str, length: int = LENGTH, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", kept_words: int = KEPT_WORDS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its tokens and then end_id, so null and empty texts are one
    token. Documents stay in the order of their partition; sequences don't
    cross partitions, and nothing is shuffled. sequence_id is unique, not
    gapless. Ids may be of any type of scalar. Repeated rows are packed each;
    null ids stay null; other columns are not read. No rows give no rows. A document of any length is cut over as
    many sequences as it needs. kept_words bounds a worker's store of known words:
    about 350 bytes each, twice; a smaller one costs time, never changes ids.
    """
    id_type = docs.schema[id_col].dataType
    texts = docs.select(F.col(id_col).alias("doc_id"), as_bytes(F.col(text_col)).alias("text"))
    numbers = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    schema = pa.schema([("doc_id", to_arrow_type(id_type)), *((n, pa.int64()) for n in numbers)])
    return texts.mapInArrow(_pack_batches(path, length, end_id, kept_words, schema), f"doc_id {id_type.simpleString()}, " + ", ".join(f"{n} long" for n in numbers))
