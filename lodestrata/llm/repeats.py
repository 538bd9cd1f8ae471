"""Removal of windows that also start in an earlier document, in a bounded number of exchanges.

A strategy (bytes with suffix arrays, or words with recompression) names every
window of a document by something that depends on the window's contents alone,
so that equal windows have equal names wherever they stand; neighbouring
windows mostly share their name and form a run.

1. Documents are packed into blocks, written once, in buckets: later steps read
   a block where it lies, and only what is said about it moves. A strategy may
   ask for rounds first: each block sends the keys of what it wants named, each
   once, and gets a number for those that more than one document has.
2. Each block sends the hashes of its names, each once, with how many runs it
   has; parts of them say which names more than one document has, and which of
   those are hot: held by very many runs. (A third of all rows with the same
   text send one hash a block.)
3. Each block sends the text of the runs whose name came back: each text once,
   with all rows that have it. In a part, the strategy decides window by window
   what an earlier document has: names only bring texts together, contents
   decide. The rows with a text's smallest id are its first owner, the others
   its later ones, for whom the text itself is an earlier match, too.
4. Runs of hot names, a phrase that very many texts hold, aren't judged under
   that name: each block's distinct ones are a smaller block, which goes through
   the steps again with the strategy's finer names, so that what surrounds the
   phrase sends it to different places. The finest name is a whole window's; a
   block sends such a window once.
5. Verdicts return to their blocks, which apply them.

Names and texts are sent in proportion to the input; no pair of documents is
ever listed. A block sends a row to each part it has something for. Blocks and
parts both grow with the input, up to 64 and 128 MB, so that the number of rows
grows with its square only where it is small: a row, some 60 bytes, stands for
500 bytes of input at 30 GB, for 1 KB at 1 TB and for 80 bytes at 100 TB.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator
from typing import NamedTuple, Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, durable, durable_by, shuffle_width
from .rolling import distinct, mix

#: (least, most) bytes of text in a block and in a part, and the share of the input that they are in between.
BLOCK_BYTES, BLOCK_SHARE = (4 << 20, 64 << 20), 1 << 16
PART_BYTES, PART_SHARE = (4 << 20, 128 << 20), 1 << 14
#: Texts of a part that are judged at once.
JUDGED_BYTES = 2 << 20
#: Buckets that blocks are dealt over: one for each block, up to so many.
MAX_BUCKETS = 1 << 16
#: Runs from which on a name is hot.
HOT_RUNS = 1 << 14
#: Rows without an id are later than all others and never earlier than one another.
NO_ID = np.iinfo(np.int64).max


class Runs(NamedTuple):
    """Windows first to last (unit numbers inside document doc) share name."""

    doc: np.ndarray
    first: np.ndarray
    last: np.ndarray
    name: np.ndarray


class Units(Protocol):
    """The documents of a block, cut into units."""

    counts: np.ndarray

    def runs(self) -> Runs: ...

    def text(self, doc: int, first: int, last: int) -> bytes:
        """Contents of windows first to last."""

    def kept(self, doc: int, mask: np.ndarray) -> bytes:
        """Contents of the units whose mask is false."""


class NamedUnits(Units, Protocol):
    """Units of a strategy with rounds: keys() and name() take turns."""

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """(keys of 48 bits to be named in this round, the document of each)."""

    def name(self, known: np.ndarray, numbers: np.ndarray) -> None:
        """Takes the numbers of the sorted distinct keys; 0 if only one document has it."""


class Strategy(Protocol):
    window: int
    rounds: int

    def units(self, texts: list[bytes]) -> Units: ...

    def earlier(self, texts: list[bytes], first: np.ndarray, later: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For distinct texts in ascending order of first: their numbers of windows, and for all windows, one text's after another, whether each starts in a text with an owner smaller than its text's first one, and than its later one (NO_ID: none)."""

    def finer(self) -> Strategy | None:
        """The same windows with names that fewer of them share; None where a name is a whole window's."""


def _shut(*parts: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def _open(blob: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(blob)


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each stretch, one after another."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))


class Texts(NamedTuple):
    """Distinct texts, and the rows that have each, one text's after another: id, and where it stands, in which document of the row's block, from which unit on. sub is a hash that tells names apart inside a part."""

    ids: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    rows: np.ndarray  # of each text
    sub: np.ndarray
    ends: np.ndarray
    joined: bytes

    def shut(self) -> bytes:
        head = struct.pack("<qq", len(self.ids), len(self.rows))
        return _shut(head, *(x.astype("<i8").tobytes() for x in self[:4]), self.sub.astype("<u2").tobytes(), self.ends.astype("<i8").tobytes(), self.joined)

    def texts(self) -> list[bytes]:
        starts = np.concatenate([[0], self.ends])[:-1]
        return [self.joined[a:b] for a, b in zip(starts.tolist(), self.ends.tolist(), strict=True)]

    def some(self, at: np.ndarray) -> Texts:
        member = _spread((np.cumsum(self.rows) - self.rows)[at], self.rows[at])
        starts = np.concatenate([[0], self.ends])[:-1]
        parts = [self.joined[a:b] for a, b in zip(starts[at].astype(int).tolist(), self.ends[at].tolist(), strict=True)]
        return Texts(self.ids[member], self.doc[member], self.first[member], self.rows[at], self.sub[at], np.cumsum([len(t) for t in parts], dtype=np.int64), b"".join(parts))


def _open_texts(blob: bytes) -> Texts:
    data = _open(blob)
    rows, texts = struct.unpack_from("<qq", data)
    at, columns = 16, []
    for kind, n in (("<i8", rows), ("<i8", rows), ("<i8", rows), ("<i8", texts), ("<u2", texts), ("<i8", texts)):
        columns.append(np.frombuffer(data, kind, n, at))
        at += columns[-1].nbytes
    return Texts(*columns, data[at:])


class Copies(NamedTuple):
    """Texts that take part, in place of all rows: each distinct text once for the rows with its smallest id, and once more for all others, under the smallest of their ids."""

    ids: np.ndarray
    text: np.ndarray  # number of the text
    rows: np.ndarray  # how many rows each stands for
    member: np.ndarray  # numbers of these rows, one copy's after another


def _copies(ids: np.ndarray, text: np.ndarray) -> Copies:
    order = np.lexsort((ids, text))
    own, of = ids[order], text[order]
    new = np.concatenate([[True], of[1:] != of[:-1]]) if len(of) else np.zeros(0, bool)
    least = own[np.flatnonzero(new)][np.cumsum(new) - 1]
    later = own > least
    start = np.flatnonzero(new | (later & ~np.concatenate([[False], later[:-1]])))
    return Copies(own[start], of[start], np.diff(np.append(start, len(order))), order)


def _block_batches(block_bytes: int):
    def block(number: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, parts[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            for part in parts:
                out.write_batch(part)
        return pa.RecordBatch.from_pydict({"block": pa.array([number], pa.int64()), "docs": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held, size = [], 0
        for batch in batches:
            start = 0
            for i, n in enumerate(pc.binary_length(batch.column("body")).to_pylist(), 1):
                size += n
                if size >= block_bytes:
                    yield block(number, [*held, batch.slice(start, i - start)])
                    number, held, size, start = number + 1, [], 0, i
            if start < batch.num_rows:
                held.append(batch.slice(start))
        if held:
            yield block(number, held)

    return run


def _load(blob: bytes) -> tuple[pa.Table, np.ndarray, list[bytes]]:
    table = pa.ipc.open_stream(blob).read_all()
    ids = table.column("id").fill_null(NO_ID).to_numpy()
    return table, ids, table.column("body").to_pylist()


class Loaded(NamedTuple):
    """The texts of a block of documents or, nested, of runs, and the rows that each stands for."""

    ids: np.ndarray
    texts: list[bytes]
    rows: np.ndarray
    row_ids: np.ndarray
    doc: np.ndarray
    first: np.ndarray


def _load_block(blob: bytes, nested: bool) -> Loaded:
    if not nested:
        _, ids, texts = _load(blob)
        n = len(ids)
        return Loaded(ids, texts, np.ones(n, np.int64), ids, np.arange(n), np.zeros(n, np.int64))
    held = _open_texts(blob)
    copies, texts = _copies(held.ids, np.repeat(np.arange(len(held.rows)), held.rows)), held.texts()
    return Loaded(copies.ids, [texts[i] for i in copies.text.tolist()], copies.rows, *(x[copies.member] for x in held[:3]))


def _parts(names: np.ndarray, n: int, salt: int) -> np.ndarray:
    return (mix(names + np.uint64(salt)) >> np.uint64(20)).astype(np.int64) % n


def _by_part(parts: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(part, row numbers in ascending order) of every part that occurs."""
    if not len(parts):
        return
    order = np.argsort(parts, kind="stable")
    in_order = parts[order]
    starts = np.flatnonzero(np.concatenate([[True], in_order[1:] != in_order[:-1]]))
    yield from zip(in_order[starts].tolist(), np.split(order, starts[1:]), strict=True)


OWN = 0x80


def _marked(names: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct names, place of each name among them, a byte for each: logarithm of how often it occurs, and OWN if different owners have it)."""
    distinct, place, often = np.unique(names, return_inverse=True, return_counts=True)
    least, most = np.full(len(distinct), NO_ID), np.full(len(distinct), np.iinfo(np.int64).min)
    np.minimum.at(least, place, owners)
    np.maximum.at(most, place, owners)
    return distinct, place, np.log2(often).astype(np.uint8) | np.where(least != most, OWN, 0).astype(np.uint8)


def _block_names(units: Units, ids: np.ndarray) -> tuple[Runs, np.ndarray, np.ndarray, np.ndarray]:
    """Runs, and _marked of their names."""
    runs = units.runs()
    return runs, *_marked(runs.name, ids[runs.doc])


def _named_units(strategy: Strategy, texts: list[bytes], replies: pa.Table | None, n_parts: int, rounds: int) -> Units:
    """Units that have taken the numbers of so many rounds. (A block may have nothing to name in one.)"""
    units = strategy.units(texts)
    answers = {} if replies is None else {(r, p): x for r, p, x in zip(*(replies.column(c).to_pylist() for c in ("round", "part", "numbers")), strict=True)}
    for r in range(rounds):
        keys, _ = units.keys()
        known = distinct(keys)
        numbers = np.zeros(len(known), np.uint64)
        for p, at in _by_part(_parts(known, n_parts, 1)):
            numbers[at] = _open_numbers(answers[r, p], len(at), p, n_parts)
        units.name(known, numbers)
    return units


def _send_keys(strategy: Strategy, n_parts: int, rounds: int):
    """Rows (part, block, names) of the round after so many."""

    def run(blocks: pa.Table, replies: pa.Table | None) -> pa.Table:
        rows: list[tuple[int, int, bytes]] = []
        for block, blob in zip(blocks.column("block").to_pylist(), blocks.column("docs"), strict=True):
            _, ids, texts = _load(blob.as_py())
            keys, docs = _named_units(strategy, texts, replies, n_parts, rounds).keys()
            known, _, marks = _marked(keys, ids[docs])
            rows += [(p, block, _six(known[at]) + marks[at].tobytes()) for p, at in _by_part(_parts(known, n_parts, 1))]
        return _name_rows(rows)

    return run


def _name_rows(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    part, own, blobs = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.table({"part": pa.array(part, pa.int64()), "block": pa.array(own, pa.int64()), "names": pa.array(blobs, pa.binary())})


def _number_keys(number: int):
    """Rows (round, part, block, numbers): for each block's keys whether more than one document has it, and the steps from one such key's place in the part's dictionary to the next."""

    def run(table: pa.Table) -> pa.Table:
        counts, place, shared = _gathered(table)[:3]
        rank = np.cumsum(np.bincount(place, shared) > 0) if len(place) else place
        replies = []
        for at, own in zip(np.split(place, np.cumsum(counts)[:-1]), np.split(shared, np.cumsum(counts)[:-1]), strict=True):
            replies.append(_shut(np.packbits(own).tobytes(), np.diff(rank[at[own]], prepend=0).astype("<u4").tobytes()))
        n = table.num_rows
        return pa.table({"round": pa.array([number] * n, pa.int64()), "part": table.column("part"), "block": table.column("block"), "numbers": pa.array(replies, pa.binary())})

    return run


def _open_numbers(blob: bytes, n: int, part: int, n_parts: int) -> np.ndarray:
    data = _open(blob)
    size = -(-n // 8)
    numbers = np.zeros(n, np.uint64)
    numbers[np.unpackbits(np.frombuffer(data, np.uint8, size), count=n) > 0] = np.cumsum(np.frombuffer(data, "<u4", offset=size), dtype=np.uint64) * np.uint64(n_parts) + np.uint64(part)
    return numbers


def _send_names(strategy: Strategy, nested: bool, n_parts: int):
    """Rows (part, block, names) of a block."""

    def run(blocks: pa.Table, replies: pa.Table | None) -> pa.Table:
        rows: list[tuple[int, int, bytes]] = []
        for block, blob in zip(blocks.column("block").to_pylist(), blocks.column("docs"), strict=True):
            held = _load_block(blob.as_py(), nested)
            _, names, _, marks = _block_names(_named_units(strategy, held.texts, replies, n_parts, strategy.rounds), held.ids)
            rows += [(p, block, _six(names[at]) + marks[at].tobytes()) for p, at in _by_part(_parts(names, n_parts, 1))]
        return _name_rows(rows)

    return run


def _six(names: np.ndarray) -> bytes:
    """48 bits of each name; a chance meeting only sends a run that finds no equal."""
    return names.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _gathered(table: pa.Table) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
    """(number of names of each block, place of each name among the part's distinct ones, whether more than one document has it, how often it occurs in the block)."""
    blobs = table.column("names").to_pylist()
    counts = [len(x) // 7 for x in blobs]
    wide = np.zeros((sum(counts), 8), np.uint8)
    wide[:, :6] = np.frombuffer(b"".join(x[: 6 * n] for x, n in zip(blobs, counts, strict=True)), np.uint8).reshape(-1, 6)
    marks = np.frombuffer(b"".join(x[6 * n :] for x, n in zip(blobs, counts, strict=True)), np.uint8)
    _, place, often = np.unique(wide.view("<u8").ravel(), return_inverse=True, return_counts=True)
    own = np.bincount(place, marks >= OWN, minlength=len(often)) > 0
    return counts, place, (own | (often > 1))[place], np.exp2((marks & (OWN - 1)).astype(float))


def _shared_names(hot_runs: int):
    """Two rows of bits for each block's names: those that more than one document has, and the hot ones."""

    def run(table: pa.Table) -> pa.Table:
        counts, place, shared, runs = _gathered(table)
        hot = np.bincount(place, runs)[place] >= hot_runs
        cuts = np.cumsum(counts)[:-1]
        flags = [np.packbits(x).tobytes() + np.packbits(y).tobytes() for x, y in zip(np.split(shared, cuts), np.split(hot, cuts), strict=True)]
        return pa.table({"part": table.column("part"), "block": table.column("block"), "flags": pa.array(flags, pa.binary())})

    return run


#: What a row of a part holds.
RUNS, HOT = range(2)


def _send_runs(strategy: Strategy, nested: bool, n_parts: int, has_finer: bool):
    """Rows (part, block, kind, held): runs for a part, or a block's runs of hot names."""

    def run(block: pa.Table, said: pa.Table) -> pa.Table:
        rows: list[tuple[int, int, int, bytes]] = []
        replies = said.filter(pc.is_valid(said["round"])) if strategy.rounds else None
        flags = said.filter(pc.is_null(said["round"])) if strategy.rounds else said
        for number, blob in zip(block.column("block").to_pylist(), block.column("docs"), strict=True):
            own = _load_block(blob.as_py(), nested)
            units = _named_units(strategy, own.texts, replies, n_parts, strategy.rounds)
            runs, names, place, _ = _block_names(units, own.ids)
            shared, hot = np.zeros(len(names), bool), np.zeros(len(names), bool)
            by_part = dict(zip(flags.column("part").to_pylist(), flags.column("flags").to_pylist(), strict=True))
            for p, at in _by_part(_parts(names, n_parts, 1)):
                bits = np.frombuffer(by_part[p], np.uint8)
                shared[at] = np.unpackbits(bits[: len(bits) // 2], count=len(at)) > 0
                hot[at] = np.unpackbits(bits[len(bits) // 2 :], count=len(at)) > 0
            chosen = np.flatnonzero(shared[place])
            local, first, last = runs.doc[chosen], runs.first[chosen], runs.last[chosen]
            found: dict[bytes, int] = {}
            text = np.array([found.setdefault(units.text(*x), len(found)) for x in zip(local.tolist(), first.tolist(), last.tolist(), strict=True)], np.int64)
            name, apart = np.zeros(len(found), np.uint64), np.zeros(len(found), bool)
            name[text], apart[text] = runs.name[chosen], hot[place[chosen]] & has_finer
            by_text = np.argsort(text, kind="stable")
            n_rows = own.rows[local[by_text]]
            row = _spread((np.cumsum(own.rows) - own.rows)[local[by_text]], n_rows)
            rows_of = np.bincount(text[by_text], n_rows, len(found)).astype(np.int64)
            sub = (mix(name + np.uint64(3)) >> np.uint64(40)).astype(np.uint16)
            texts = list(found)
            held = Texts(own.row_ids[row], own.doc[row], own.first[row] + np.repeat(first[by_text], n_rows), rows_of, sub, np.cumsum([len(t) for t in texts], dtype=np.int64), b"".join(texts))
            sent = np.flatnonzero(~apart)
            rows += [(p, number, RUNS, held.some(sent[at]).shut()) for p, at in _by_part(_parts(name[sent], n_parts, 2))]
            if apart.any():
                rows.append((number % n_parts, number, HOT, held.some(np.flatnonzero(apart)).shut()))
        part, own, kind, held = zip(*rows, strict=True) if rows else ((), (), (), ())
        return pa.table({"part": pa.array(part, pa.int64()), "block": pa.array(own, pa.int64()), "kind": pa.array(kind, pa.int32()), "held": pa.array(held, pa.binary())})

    return run


def _shut_verdicts(*columns: np.ndarray) -> bytes:
    """Columns are documents, first and last windows."""
    return _shut(*(x.astype("<i8").tobytes() for x in columns))


def _open_verdicts(blob: bytes) -> np.ndarray:
    return np.frombuffer(_open(blob), "<i8").reshape(3, -1)


def _spans(mask: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first, last) of each stretch of windows in mask, which holds counts windows of each text."""
    at = np.flatnonzero(mask)
    text = np.repeat(np.arange(len(counts)), counts)[at]
    window = at - (np.cumsum(counts) - counts)[text]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (text[1:] != text[:-1])
    start = np.flatnonzero(new)
    return text[start], window[start], window[np.append(start[1:], len(at)) - 1] if len(at) else window


def _judge(strategy: Strategy, ids: np.ndarray, text: np.ndarray, texts: list[bytes]) -> Iterator[np.ndarray]:
    """Columns of (row, first, last): windows that a text with a smaller id has. ids and text (a number in texts, which may repeat) are the rows'."""
    number: dict[bytes, int] = {}
    same = np.array([number.setdefault(t, len(number)) for t in texts], np.int64)
    distinct_texts = list(number)
    order = np.lexsort((ids, same[text]))
    own, of = ids[order], same[text][order]
    start = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.zeros(0, np.int64)
    end = np.append(start[1:], len(of))
    n_first = np.add.reduceat((own == own[start][of]).astype(np.int64), start) if len(of) else start
    more = start + n_first < end
    later = np.where(more, own[np.minimum(start + n_first, len(own) - 1)], NO_ID) if len(of) else start
    by_id = np.argsort(own[start], kind="stable")
    counts, *gone = strategy.earlier([distinct_texts[k] for k in by_id.tolist()], own[start][by_id], later[by_id])
    owners = (start, n_first), (start + n_first, end - start - n_first)
    for mask, (begin, size) in zip(gone, owners, strict=True):
        text_of, lo, hi = _spans(mask, counts)
        n = size[by_id[text_of]]
        yield np.stack([order[_spread(begin[by_id[text_of]], n)], np.repeat(lo, n), np.repeat(hi, n)])


def _judge_part(strategy: Strategy, judged_bytes: int):
    """Rows (block, hot, held): verdicts, or the runs of hot names as they came."""

    def run(table: pa.Table) -> pa.Table:
        rows, sent, blocks = [], [], []
        for block, kind, held in zip(table.column("block").to_pylist(), table.column("kind").to_pylist(), table.column("held").to_pylist(), strict=True):
            if kind == RUNS:
                sent.append(_open_texts(held))
                blocks.append(block)
            else:
                rows.append((block, kind == HOT, held))
        # Texts are taken up a share at a time; those of a name are in one share.
        n = sum(len(x.joined) for x in sent) // judged_bytes + 1
        made: list[np.ndarray] = []
        for k in range(n if sent else 0):
            picks = [x.some(np.flatnonzero(x.sub % n == k)) for x in sent]
            if not any(len(x.rows) for x in picks):
                continue
            ids, doc, first = (np.concatenate([getattr(x, c) for x in picks]) for c in ("ids", "doc", "first"))
            source = np.repeat(np.arange(len(sent)), [len(x.ids) for x in picks])
            text = np.repeat(np.arange(sum(len(x.rows) for x in picks)), np.concatenate([x.rows for x in picks]))
            i, lo, hi = np.concatenate(list(_judge(strategy, ids, text, [t for x in picks for t in x.texts()])), axis=1)
            if len(i):
                made.append(np.stack([source[i], doc[i], first[i] + lo, first[i] + hi]))
        if made:
            source, *columns = np.concatenate(made, axis=1)
            rows += [(blocks[k], False, _shut_verdicts(*(c[at] for c in columns))) for k, at in _by_part(source)]
        block, hot, held = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.table({"block": pa.array(block, pa.int64()), "hot": pa.array(hot, pa.bool_()), "held": pa.array(held, pa.binary())})

    return run


def _apply(strategy: Strategy, carry: pa.DataType, with_text: bool):
    def run(block: pa.Table, verdicts: pa.Table) -> pa.Table:
        tables = []
        for blob in block.column("docs"):
            table, _, texts = _load(blob.as_py())
            units = strategy.units(texts)
            counts = units.counts
            offset = np.cumsum(counts) - counts
            edge = np.zeros(int(counts.sum()) + 1, np.int64)
            for v in verdicts.column("held").to_pylist():
                doc, first, last = _open_verdicts(v)
                np.add.at(edge, offset[doc] + first, 1)
                np.add.at(edge, offset[doc] + last + strategy.window, -1)
            mask = np.cumsum(edge[:-1]) > 0
            n_removed, n_spans, shas, kept_texts = [], [], [], []
            for d, (lo, n) in enumerate(zip(offset.tolist(), counts.tolist(), strict=True)):
                own = mask[lo : lo + n]
                kept = units.kept(d, own)
                n_removed.append(int(own.sum()))
                n_spans.append(int((own[1:] & ~own[:-1]).sum() + own[:1].sum()))
                shas.append(hashlib.sha256(kept).hexdigest())
                kept_texts.append(kept.decode("utf-8", "ignore") if with_text else None)
            tables.append(pa.table({
                "carry": table.column("carry").cast(carry), "n_units": pa.array(counts.tolist(), pa.int64()), "n_removed": pa.array(n_removed, pa.int64()),
                "n_spans": pa.array(n_spans, pa.int64()), "kept_sha256": pa.array(shas, pa.string()), "kept_text": pa.array(kept_texts, pa.string()),
            }))
        return pa.concat_tables(tables)

    return run


def _between(limits: tuple[int, int], wanted: int) -> int:
    return min(limits[1], max(limits[0], wanted))


NAMES = "part long, block long, names binary"
REPLIES = "round long, part long, block long, numbers binary"


def _told(blocks: DataFrame, replies: DataFrame | None, send: Callable[[pa.Table, pa.Table | None], pa.Table]) -> DataFrame:
    """What send makes of each block and the replies to it."""
    if replies is None:
        return blocks.groupBy("block").applyInArrow(lambda table: send(table, None), NAMES)
    return blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(lambda table, own: send(table, own), NAMES)


def _rounds(blocks: DataFrame, strategy: Strategy, n: int) -> DataFrame | None:
    """The numbers of all rounds."""
    replies = None
    for r in range(strategy.rounds):
        made = durable(_told(blocks, replies, _send_keys(strategy, n, r)).groupBy("part").applyInArrow(_number_keys(r), REPLIES), "repeat-numbers")
        replies = made if replies is None else replies.unionByName(made)
    return replies


def _verdicts(blocks: DataFrame, strategy: Strategy, nested: bool, size: int, part_bytes: int, judged_bytes: int, hot_runs: int) -> DataFrame:
    """(block, held): the verdicts on all windows of blocks(block, docs), which hold size bytes."""
    n = max(shuffle_width(blocks.sparkSession), size // part_bytes + 1)
    finer = strategy.finer()
    replies = _rounds(blocks, strategy, n)
    said = _told(blocks, replies, _send_names(strategy, nested, n)).groupBy("part").applyInArrow(_shared_names(hot_runs), "part long, block long, flags binary")
    if replies is not None:
        said = replies.select("block", "part", "round", "numbers", F.lit(None).cast("binary").alias("flags")).unionByName(
            said.select("block", "part", F.lit(None).cast("long").alias("round"), F.lit(None).cast("binary").alias("numbers"), "flags")
        )
    runs = blocks.groupBy("block").cogroup(said.groupBy("block")).applyInArrow(_send_runs(strategy, nested, n, finer is not None), "part long, block long, kind int, held binary")
    judged = durable(runs.groupBy("part").applyInArrow(_judge_part(strategy, judged_bytes), "block long, hot boolean, held binary"), "repeat-verdicts")
    found = judged.filter("not hot").select("block", "held")
    if finer is None:
        return found
    hot = judged.filter("hot").select("block", F.col("held").alias("docs"))
    left = hot.agg(F.sum(F.length("docs"))).first()[0]
    # Texts shrink to a third or so when shut.
    return found if left is None else found.unionByName(_verdicts(hot, finer, True, 3 * left, part_bytes, judged_bytes, hot_runs))


def remove_repeats(
    docs: DataFrame, strategy: Strategy, id_col: str, text_col: str, carry: list[str], *, with_text: bool,
    block_bytes: int | None = None, part_bytes: int | None = None, judged_bytes: int = JUDGED_BYTES, hot_runs: int = HOT_RUNS,
) -> DataFrame:
    """One row per row of docs: carry (a struct of these columns), n_units, n_removed, n_spans, kept_sha256, kept_text (null unless asked for).

    Ids are read as long: a column that can't be cast so is an error of Spark's.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("carry"), F.col(f"`{id_col}`").cast("long").alias("id"), as_bytes(F.col(f"`{text_col}`")).alias("body"))
    carried = packed.schema["carry"].dataType
    size = packed.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    block_bytes = block_bytes or _between(BLOCK_BYTES, size // BLOCK_SHARE)
    part_bytes = part_bytes or _between(PART_BYTES, size // PART_SHARE)
    made = packed.mapInArrow(_block_batches(block_bytes), "block long, docs binary")
    buckets = min(MAX_BUCKETS, max(shuffle_width(docs.sparkSession), size // block_bytes + 1))
    blocks = durable_by(made, "repeat-blocks", "block", buckets)
    verdicts = _verdicts(blocks, strategy, False, size, part_bytes, judged_bytes, hot_runs)
    schema = f"carry {carried.simpleString()}, n_units long, n_removed long, n_spans long, kept_sha256 string, kept_text string"
    return blocks.groupBy("block").cogroup(verdicts.groupBy("block")).applyInArrow(_apply(strategy, to_arrow_type(carried), with_text), schema)
