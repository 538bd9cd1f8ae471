"""Removal of repeated word windows, found by recompression.

Recompression shortens all documents by the same rules: runs of one symbol
become a symbol, then the alphabet is dealt into left and right symbols and
each left symbol followed by a right one becomes a symbol. A rule looks at the
symbols next to it only, so equal substrings get equal symbols inside; each
symbol here knows how far it looked (its extent).

A Spark round names the runs and pairs of a level: every block sends those it
has, each once, and a dictionary numbers the ones that more than one document
has (see repeats.py). One that a single document has gets no number and is
dead: it joins no further symbol, and a window that holds its extent can't be
in another document. Words are named by hashes.

A window of 13 words is named by the contents of the extent of its least symbol
on the highest level that has a symbol whose extent lies inside the window;
that depends on the window's words alone. Symbols of two levels look at 4 and 8
words on average, those of a third at 14, more than a window has, so rounds end
there. What documents share is then brought together by these names and
verified window by window: symbols reveal; words decide.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repeats import Runs, remove_repeats
from .rolling import PIECE, SliceHash, long_slice, mix

WINDOW_WORDS = 13
LEVELS = 2
#: Words that are compressed at once: some 30 arrays of so many numbers are held. Windows across pieces belong to the later one.
PIECE_WORDS = PIECE // 16
_RUN, _PAIR = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)


#: Bits of a key that is sent for a run or pair, and of a number within its level.
KEY_BITS, LEVEL_SHIFT = 48, np.uint64(44)


class Symbols:
    """The symbols of one level: name (0 if dead), extent [low, high) in words, and document."""

    def __init__(self, name: np.ndarray, low: np.ndarray, high: np.ndarray, doc: np.ndarray, first: np.ndarray, end: np.ndarray) -> None:
        self.name, self.low, self.high, self.doc = name, low, high, doc
        self.first, self.end = first, end  # of each document, in words

    def _neighbours(self) -> tuple[np.ndarray, np.ndarray]:
        """Low of the symbol before and high of the one after; beyond a document's edge one word further than any window reaches."""
        edge = self.doc[1:] != self.doc[:-1]
        before, after = np.empty_like(self.low), np.empty_like(self.high)
        before[1:], after[:-1] = self.low[:-1], self.high[1:]
        at_start, at_end = np.concatenate([[True], edge]), np.concatenate([edge, [True]])
        before[at_start] = self.first[self.doc[at_start]] - 1
        after[at_end] = self.end[self.doc[at_end]] + 1
        return before, after

    def compressed(self, level: int) -> tuple[Symbols, np.ndarray, np.ndarray]:
        """(symbols of the next level, places of those that are a run or a pair, their keys); the latter wait for their names."""
        same = (self.name[1:] == self.name[:-1]) & (self.doc[1:] == self.doc[:-1]) & (self.name[1:] > 0)
        start = np.flatnonzero(np.concatenate([[True], ~same]))
        last = np.append(start[1:], len(self.name)) - 1
        length = (last - start + 1).astype(np.uint64)
        before, after = self._neighbours()
        runs = Symbols(self.name[start], before[start], after[last], self.doc[start], self.first, self.end)
        whole = mix(runs.name + length * _RUN)
        alive = runs.name > 0
        left = (mix(whole + np.uint64(level) * _PAIR) & np.uint64(1)).astype(bool)
        joined = np.zeros(len(left), bool)  # this symbol and the next become one
        joined[:-1] = left[:-1] & ~left[1:] & alive[:-1] & alive[1:] & (runs.doc[1:] == runs.doc[:-1])
        keep = ~np.concatenate([[False], joined[:-1]])
        before, after = runs._neighbours()
        key = np.where(joined, mix(whole * _PAIR + np.append(whole[1:], np.uint64(0))), whole) >> np.uint64(64 - KEY_BITS)
        new = (joined | (length > 1) & alive)[keep]
        made = Symbols(runs.name[keep], np.where(left, runs.low, before)[keep], np.where(left, after, runs.high)[keep], runs.doc[keep], self.first, self.end)
        return made, np.flatnonzero(new), key[keep][new]


def word_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word by its bytes, whatever piece it stands in."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = int(np.searchsorted(ends, starts[i] + PIECE, side="right"))
        if j == i:  # one word longer than a piece
            out[i] = long_slice(values[starts[i] : ends[i]])
            i += 1
            continue
        base = starts[i]
        out[i:j] = SliceHash(values[base : ends[j - 1]]).raw(starts[i:j] - base, ends[i:j] - base)
        i = j
    return mix(out + (ends - starts).astype(np.uint64) * _RUN)


def window_names(words: np.ndarray, ladder: list[Symbols], doc: np.ndarray, end: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window starts, least symbol's place made unique over levels, name) of the windows inside documents that hold no dead symbol; words holds at most PIECE_WORDS hashes."""
    n = len(words)
    place = np.arange(n, dtype=np.int64)
    contents = SliceHash(words)
    todo = np.flatnonzero(place + window <= end[doc]) if n else place
    inside = []
    for level in ladder:
        # How many symbols begin before the window, and how many end inside it or before; counted, as there is a place for each word.
        a = np.cumsum(np.bincount(level.low + 1, minlength=n + 1))[todo]
        b = np.cumsum(np.bincount(level.high, minlength=n + 1))[todo + window]
        dead = np.concatenate([[0], np.cumsum(level.name == 0)])
        alive = (a >= b) | (dead[np.maximum(a, b)] == dead[a])
        todo = todo[alive]
        inside = [(x[alive], y[alive]) for x, y in [*inside, (a, b - 1)]]
    starts, symbols, names = [], [], []
    left = np.ones(len(todo), bool)
    for k in range(len(ladder) - 1, -1, -1):
        level, (a, b) = ladder[k], inside[k]
        has = np.flatnonzero(left & (a <= b))
        left[has] = False
        s, a, b = todo[has], a[has], b[has]
        if not len(s):
            continue
        low, high = np.maximum(level.low, 0), np.minimum(level.high, n)
        name = mix(contents.raw(low, high) + np.uint64(k) * _PAIR)
        table = [name & ~np.uint64(PIECE - 1) | np.arange(len(name), dtype=np.uint64)]  # least of 2^i symbols from each on
        while 1 << len(table) <= int((b - a).max()) + 1:
            half, prior = 1 << (len(table) - 1), table[-1]
            table.append(np.minimum(prior, np.append(prior[half:], np.full(min(half, len(prior)), ~np.uint64(0)))))
        deep = np.log2(b - a + 1).astype(np.int64)
        least = np.empty(len(s), np.uint64)
        for i, row in enumerate(table):
            at = np.flatnonzero(deep == i)
            least[at] = np.minimum(row[a[at]], row[b[at] - (1 << i) + 1])
        symbol = (least & np.uint64(PIECE - 1)).astype(np.int64)
        starts.append(s)
        symbols.append(symbol + k * PIECE)
        names.append(name[symbol])
    if not starts:
        return place[:0], place[:0], words[:0]
    starts, symbols, names = map(np.concatenate, (starts, symbols, names))
    order = np.argsort(starts, kind="stable")
    return starts[order], symbols[order], names[order]


class WordUnits:
    def __init__(self, texts: list[bytes], window: int) -> None:
        self.window = window
        self.texts = [b" ".join(t.split()) for t in texts]
        joined = b" ".join(t for t in self.texts if t)
        self.counts = np.array([t.count(b" ") + 1 if t else 0 for t in self.texts], np.int64)
        self.values = np.frombuffer(joined, np.uint8)
        gaps = np.flatnonzero(self.values == 32)
        self.starts = np.concatenate([[0], gaps + 1]) if len(joined) else gaps
        self.ends = np.append(gaps, len(joined)) if len(joined) else gaps
        self.first = np.cumsum(self.counts) - self.counts
        self.joined = joined

    def text(self, doc: int, first: int, last: int) -> bytes:
        at = self.first[doc]
        return self.joined[self.starts[at + first] : self.ends[at + last + self.window - 1]]

    def kept(self, doc: int, mask: np.ndarray) -> bytes:
        if not mask.any():
            return self.texts[doc]
        return b" ".join([w for w, gone in zip(self.texts[doc].split(b" "), mask.tolist(), strict=True) if not gone])


class Piece:
    """At most PIECE_WORDS words of a block, on all levels so far. Windows that two pieces share belong to the later one."""

    def __init__(self, words: np.ndarray, owner: np.ndarray, lo: int, first: np.ndarray, counts: np.ndarray) -> None:
        self.lo, self.words, self.owner = lo, words, owner
        self.doc = (owner - owner[0]).astype(np.int32)
        docs = slice(owner[0], owner[-1] + 1)
        begin = np.maximum(first[docs] - lo, 0).astype(np.int32)
        # A document that goes on past the piece looks like one that ends there: its last windows come with the next piece.
        self.end = np.minimum(first[docs] + counts[docs] - lo, len(words)).astype(np.int32)
        place = np.arange(len(words), dtype=np.int32)
        self.ladder = [Symbols((words >> np.uint64(20)) + np.uint64(1), place, place + np.int32(1), self.doc, begin, self.end)]

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """(keys of the next level's runs and pairs, their documents)."""
        self.waiting = self.ladder[-1].compressed(len(self.ladder))
        made, new, key = self.waiting
        return key, self.owner[0] + made.doc[new].astype(np.int64)

    def name(self, known: np.ndarray, numbers: np.ndarray) -> None:
        """Takes the numbers (0: dead) of the sorted distinct keys."""
        made, new, key = self.waiting
        found = numbers[np.searchsorted(known, key)] if len(key) else numbers[:0]
        made.name[new] = np.where(found > 0, np.uint64(len(self.ladder)) << LEVEL_SHIFT | found, 0)
        self.ladder.append(made)
        del self.waiting


class RecompressionUnits(WordUnits):
    def __init__(self, texts: list[bytes], window: int) -> None:
        super().__init__(texts, window)
        words = word_hashes(self.values, self.starts, self.ends)
        owner = np.repeat(np.arange(len(self.counts)), self.counts)
        self.pieces, lo, total = [], 0, len(words)
        while lo < total:
            hi = min(total, lo + PIECE_WORDS)
            self.pieces.append(Piece(words[lo:hi], owner[lo:hi], lo, self.first, self.counts))
            if hi == total:
                break
            lo = hi - window + 1

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        found = [p.keys() for p in self.pieces]
        return tuple(map(np.concatenate, zip(*found, strict=True))) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))

    def name(self, known: np.ndarray, numbers: np.ndarray) -> None:
        for p in self.pieces:
            p.name(known, numbers)

    def runs(self) -> Runs:
        found = []
        for p in self.pieces:
            s, symbol, name = window_names(p.words, p.ladder, p.doc, p.end, self.window)
            if len(s):
                new = np.concatenate([[True], (symbol[1:] != symbol[:-1]) | (s[1:] != s[:-1] + 1) | (p.doc[s[1:]] != p.doc[s[:-1]])])
                start, last = s[new], s[np.concatenate([new[1:], [True]])]
                own = p.owner[start]
                found.append(Runs(own, p.lo + start - self.first[own], p.lo + last - self.first[own], name[new]))
        return Runs(*map(np.concatenate, zip(*found, strict=True))) if found else Runs(*(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64)))


class RecompressionStrategy:
    def __init__(self, window: int = WINDOW_WORDS, rounds: int = LEVELS) -> None:
        self.window, self.rounds = window, rounds

    def units(self, texts: list[bytes]) -> RecompressionUnits:
        return RecompressionUnits(texts, self.window)

    def n_windows(self, text: bytes) -> int:
        return text.count(b" ") + 2 - self.window

    def earlier(self, texts: list[bytes], first: np.ndarray, later: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows by their words; texts come in ascending order of their first owners, so the owner that a window was met with first is its smallest one."""
        joined = b" ".join(texts)
        gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
        starts, ends = np.concatenate([[0], gaps + 1]), np.append(gaps, len(joined))
        counts = np.array([self.n_windows(t) for t in texts])
        before = np.cumsum(counts) - counts
        # A text's windows end at its last word: the words of the texts before it are their windows and window - 1 more each.
        at = np.arange(int(counts.sum())) + np.repeat(np.arange(len(texts)) * (self.window - 1), counts)
        met: dict[bytes, int] = {}
        owners = np.repeat(first, counts)
        least = np.array([met.setdefault(joined[a:b], own) for a, b, own in zip(starts[at].tolist(), ends[at + self.window - 1].tolist(), owners.tolist(), strict=True)], np.int64)
        return counts, least < owners, least < np.repeat(later, counts)

    def finer(self) -> WindowStrategy | None:
        return WindowStrategy(self.window)


class WindowUnits(WordUnits):
    def runs(self) -> Runs:
        """Each window is a run of its own, named by its words."""
        words = word_hashes(self.values, self.starts, self.ends)
        counts = np.maximum(self.counts - self.window + 1, 0)
        doc = np.repeat(np.arange(len(counts)), counts)
        first = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
        at = self.first[doc] + first
        name = np.zeros(len(at), np.uint64)
        for i in range(self.window):
            name = mix(name * _PAIR + words[at + i])
        return Runs(doc, first, first, name)


class WindowStrategy(RecompressionStrategy):
    """Whole windows as names, for what recompression names alike very often."""

    def __init__(self, window: int) -> None:
        super().__init__(window, 0)

    def units(self, texts: list[bytes]) -> WindowUnits:
        return WindowUnits(texts, self.window)

    def finer(self) -> None:
        return None


def remove_repeated_words(docs: DataFrame, window: int = WINDOW_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_sha256 (of the kept words, joined by one space).

    Words are separated by spaces and the controls 9 to 13; null counts as
    empty. Every word covered by a window whose words also start in a row with
    a smaller doc_id goes; windows are judged on the input. Rows that repeat a
    doc_id don't shorten one another; rows with a null id are later than all
    others. Other columns are not read. No rows give no rows.
    """
    found = remove_repeats(docs, RecompressionStrategy(window), id_col, text_col, [id_col], with_text=False)
    return found.select(F.col(f"carry.`{id_col}`").alias("doc_id"), F.col("n_units").alias("n_words"), "n_removed", "kept_sha256")
