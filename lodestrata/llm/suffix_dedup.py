"""Removal of repeated byte strings with longest-previous-factor arrays.

All windows of 50 bytes are brought to parts by their least 20-byte hash (see
repeats.py), so windows with equal bytes meet. There the suffixes of the texts
are sorted up to 50 bytes deep by prefix doubling, and the common prefix of each
suffix with the one before it is read off the ranks. In that order, the previous
and the next place with a smaller owner (a document with a smaller id) are the
best earlier matches of a suffix; the least common prefix on the way to either
is how long that match is, and the longer one is its longest previous factor.
Where that reaches 50 bytes, the window is a later copy. The first copy has a
shorter one, and stays.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repeats import Runs, remove_repeats
from .rolling import PIECE, SliceHash, sliding_minimum

MIN_BYTES = 50
GRAM_BYTES = 20
_PLACE = np.uint64(PIECE - 1)


class SuffixOrder:
    """Suffixes of text at the given places, each of which has depth bytes, in order of these bytes."""

    def __init__(self, text: np.ndarray, depth: int, at: np.ndarray) -> None:
        n = len(text)
        padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
        self.depth, known = depth, min(depth, 8)
        key = np.zeros(n, np.uint64)
        for b in range(8):
            key = key << np.uint64(8) | padded[b : b + n]
        self.heads = key  # the 8 bytes from each place on
        self.ranks: list[tuple[int, np.ndarray]] = []  # (bytes looked at, dense rank of each place)
        if known < depth:
            self.ranks.append((8, _dense(key)))
        while 2 * known < depth:
            rank = self.ranks[-1][1]
            key = rank.astype(np.uint64) << np.uint64(32)
            key[: n - known] |= rank[known:]
            known *= 2
            self.ranks.append((known, _dense(key)))
        if self.ranks:
            rank = self.ranks[-1][1]
            whole = rank[at].astype(np.uint64) << np.uint64(32) | rank[at + depth - known]
        else:
            whole = key[at] >> np.uint64(64 - 8 * depth)
        del key
        self.order = np.argsort(whole, kind="stable")
        self.places, whole = at[self.order], whole[self.order]
        self.same = np.concatenate([np.zeros(min(1, len(at)), bool), whole[1:] == whole[:-1]])  # as the suffix before it, depth bytes long

    def common(self) -> np.ndarray:
        """Length of the common prefix of each suffix with the one before it, up to depth; 0 for the first."""
        length = np.where(self.same, self.depth, 0)
        todo = np.flatnonzero(~self.same)[1:]
        a, b = self.places[todo - 1], self.places[todo]
        end = len(self.heads) - 1
        for size, rank in reversed(self.ranks):
            step = np.where(rank[np.minimum(a, end)] == rank[np.minimum(b, end)], size, 0)
            a, b = a + step, b + step
        differ = self.heads[np.minimum(a, end)] ^ self.heads[np.minimum(b, end)]
        same_bytes = np.zeros(len(todo), np.int64)
        for k in range(8):
            same_bytes += differ < np.uint64(1 << (64 - 8 * (k + 1)))
        length[todo] = np.minimum(b - self.places[todo] + same_bytes, self.depth)
        return length


def _dense(key: np.ndarray) -> np.ndarray:
    order = np.argsort(key)
    in_order = key[order]
    rank = np.zeros(len(key), np.uint32)
    rank[order[1:]] = np.cumsum(in_order[1:] != in_order[:-1], dtype=np.uint32)
    return rank


def previous_smaller(values: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place the nearest one before it with a smaller value, or -1, and the least of common on the way there (0 without one); by pointer jumping. common belongs to a place and the one before it."""
    before, least = np.arange(-1, len(values) - 1), common.copy()
    todo = np.flatnonzero((before >= 0) & (values[before] >= values))
    while len(todo):
        over = before[todo]
        least[todo] = np.minimum(least[todo], least[over])
        before[todo] = to = before[over]
        todo = todo[(to >= 0) & (values[to] >= values[todo])]
    return before, np.where(before >= 0, least, 0)


def next_smaller(values: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As previous_smaller, for the nearest one after it, or the number of places."""
    turned = np.concatenate([common[:1] * 0, common[:0:-1]])
    after, least = previous_smaller(values[::-1], turned)
    return (len(values) - 1 - after)[::-1], least[::-1]


def longest_previous_factors(text: np.ndarray, owners: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """For the suffix at each place, the length of its longest prefix, up to depth, that a suffix of a smaller owner has."""
    suffixes = SuffixOrder(text, depth, at)
    common, value = suffixes.common(), owners[suffixes.order]
    # Common prefixes shrink with distance in suffix order, so the two neighbours hold the longest one.
    found = np.empty(len(at), np.int64)
    found[suffixes.order] = np.maximum(previous_smaller(value, common)[1], next_smaller(value, common)[1])
    return found


class ByteUnits:
    def __init__(self, texts: list[bytes], window: int, gram: int) -> None:
        self.texts, self.window, self.gram = texts, window, gram
        self.counts = np.array([len(t) for t in texts], np.int64)

    def runs(self) -> Runs:
        """Windows that share the place of their least gram (the leftmost of equals)."""
        found: list[Runs] = []
        piece: list[tuple[int, int, bytes]] = []  # (document, first byte, bytes)
        size = 0
        for doc, text in enumerate(self.texts):
            for lo in range(0, len(text) - self.window + 1, PIECE - self.window):
                part = text[lo : lo + PIECE - 1] if len(text) >= PIECE else text
                if size + len(part) >= PIECE:
                    found.append(self._piece_runs(piece))
                    piece, size = [], 0
                piece.append((doc, lo, part))
                size += len(part)
                if len(text) < PIECE:
                    break
        if piece:
            found.append(self._piece_runs(piece))
        return Runs(*map(np.concatenate, zip(*found, strict=True))) if found else Runs(*(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64)))

    def _piece_runs(self, piece: list[tuple[int, int, bytes]]) -> Runs:
        values = np.frombuffer(b"".join(p for *_, p in piece), np.uint8)
        lengths = np.array([len(p) for *_, p in piece], np.int64)
        starts = np.cumsum(lengths) - lengths
        hashes = SliceHash(values).every(self.gram)
        least = sliding_minimum(hashes & ~_PLACE | np.arange(len(hashes), dtype=np.uint64), self.window - self.gram + 1)
        inside = np.ones(len(least), bool)
        for end in (starts + lengths)[:-1].tolist():
            inside[max(0, end - self.window + 1) : end] = False
        # The last window of a piece of a long text is the first of the next one: it is left to that.
        s = np.flatnonzero(inside)
        gram = (least[s] & _PLACE).astype(np.int64)
        new = np.concatenate([[True], (gram[1:] != gram[:-1]) | (s[1:] != s[:-1] + 1)])
        first, last = s[new], s[np.concatenate([new[1:], [True]])]
        owner = np.searchsorted(starts, first, side="right") - 1
        docs, lows = np.array([d for d, *_ in piece]), np.array([lo for _, lo, _ in piece])
        shift = lows[owner] - starts[owner]
        return Runs(docs[owner], first + shift, last + shift, hashes[gram[new]])

    def text(self, doc: int, first: int, last: int) -> bytes:
        return self.texts[doc][first : last + self.window]

    def kept(self, doc: int, mask: np.ndarray) -> bytes:
        text = self.texts[doc]
        return np.frombuffer(text, np.uint8)[~mask].tobytes() if mask.any() else text


class SuffixArrayStrategy:
    rounds = 0

    def __init__(self, window: int = MIN_BYTES, gram: int = GRAM_BYTES) -> None:
        self.window, self.gram = window, min(gram, window)

    def units(self, texts: list[bytes]) -> ByteUnits:
        return ByteUnits(texts, self.window, self.gram)

    def earlier(self, texts: list[bytes], first: np.ndarray, later: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A suffix stands once for all owners of its text, under the first of them. For a later one, that place is an earlier match itself, and as long as it can be."""
        joined = np.frombuffer(b"".join(texts), np.uint8)
        lengths = np.array([len(t) for t in texts], np.int64)
        starts = np.cumsum(lengths) - lengths
        counts = lengths - self.window + 1
        before = np.cumsum(counts) - counts
        at = np.arange(int(counts.sum())) + np.repeat(starts - before, counts)
        owners = np.cumsum(np.concatenate([[0], np.diff(first) != 0]))  # ranks, so that rows with equal ids are one owner
        found = longest_previous_factors(joined, np.repeat(owners, counts), at, self.window)
        for_later = np.where(np.repeat(first < later, counts), self.window, found)
        return counts, found >= self.window, for_later >= self.window

    def finer(self) -> SuffixArrayStrategy | None:
        """Grams twice as long, then whole windows."""
        return SuffixArrayStrategy(self.window, 2 * self.gram) if self.gram < self.window else None


def remove_repeated_bytes(docs: DataFrame, min_bytes: int = MIN_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Texts are UTF-8 bytes, null counts as empty. Every byte covered by a string
    of min_bytes bytes that also starts in a row with a smaller doc_id goes;
    strings are judged on the input. Rows that repeat a doc_id don't shorten
    one another; rows with a null id are later than all others. Texts of any
    length are read in pieces. Other columns are not read. No rows give no rows.
    """
    found = remove_repeats(docs, SuffixArrayStrategy(min_bytes), id_col, text_col, [id_col], with_text=False)
    return found.select(F.col(f"carry.`{id_col}`").alias("doc_id"), F.col("n_units").alias("n_bytes"), "n_removed", "n_spans", "kept_sha256")


def without_repeated_bytes(docs: DataFrame, min_bytes: int = MIN_BYTES, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """docs with the remaining text, and its length in code points if length_col is there; a character that lost a byte goes whole. A null text stays null."""
    found = remove_repeats(docs, SuffixArrayStrategy(min_bytes), id_col, text_col, docs.columns, with_text=True)
    text = F.when(F.col(f"carry.`{text_col}`").isNull(), None).otherwise(F.col("kept_text"))
    values = {text_col: text, length_col: F.char_length(text).cast("long")}
    return found.select(*[values.get(c, F.col(f"carry.`{c}`")).alias(c) for c in docs.columns])
