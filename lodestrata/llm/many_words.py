"""Byte-pair encoding of many words at once, in arrays.

A word that is a run of letters, of marks, or of marks after letters is a column
of symbols. In each round every column merges its pair of the least rank, the
first of equals, so a word goes through the same merges as alone: symbols stay
in their rows, linked to the ones before and after, and the keys of the pairs
are looked up in a table by arrays. Other words are encoded one by one.
"""

from __future__ import annotations

import string

import numpy as np

from .byte_pair import CACHED_WORD_BYTES, BytePairEncoder, Store

#: Says of a pair that it doesn't merge; greater than any merge's rank and result, and room for a row below it.
NO_PAIR = 1 << 56
ROW_BITS = 6
#: Symbols of a word before any merge: bytes, bytes that end a piece, and none.
FINAL, NOTHING = 256, 512
#: Columns that are merged together have up to this many rows more than symbols.
WIDTH_STEP = 4
#: Columns merged together; their arrays should fit a core's cache.
COLUMNS = 4096
LETTER, MARK = 1, 2


class PairTable:
    """Maps arrays of pairs of ids, as numbers, to what they make; open addressing with linear probing."""

    def __init__(self, merges: dict[int, int]) -> None:
        bits = (4 * len(merges) + 1).bit_length()
        self.shift, self.last_slot = np.uint64(64 - bits), (1 << bits) - 1
        self.pairs = np.full(1 << bits, -1, np.int64)
        self.made = np.full(1 << bits, NO_PAIR, np.int64)
        pairs, made = np.fromiter(merges.keys(), np.int64, len(merges)), np.fromiter(merges.values(), np.int64, len(merges))
        slots = self.first_slots(pairs)
        while len(pairs):
            free = self.pairs[slots] < 0
            self.pairs[slots[free]] = pairs[free]  # of pairs that meet in a slot, one stays
            placed = self.pairs[slots] == pairs
            self.made[slots[placed]] = made[placed]
            pairs, made, slots = pairs[~placed], made[~placed], slots[~placed] + 1 & self.last_slot

    def first_slots(self, pairs: np.ndarray) -> np.ndarray:
        return (pairs.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).view(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """rank << 20 | id for each pair, or NO_PAIR; a side below 0 has no pair."""
        pairs = left << 20 | right
        slots = self.first_slots(pairs)
        held = self.pairs[slots]
        found = self.made[slots]
        other = np.flatnonzero(held != pairs)
        found[other] = NO_PAIR
        other = other[held[other] >= 0]
        while len(other):
            slots[other] = at = slots[other] + 1 & self.last_slot
            held = self.pairs[at]
            hit = held == pairs[other]
            found[other[hit]] = self.made[at[hit]]
            other = other[~hit & (held >= 0)]
        return found


class ManyWords:
    """Encodes lists of words as encoder.encode_word does each."""

    def __init__(self, encoder: BytePairEncoder) -> None:
        self.encoder = encoder
        # The pieces of a word can share a column if no merge has a piece's end on its left, else all words are encoded one by one.
        self.arrays = not any(encoder.strings[pair >> 20].endswith(encoder.word_end) for pair in encoder.merges)
        self.table = PairTable(encoder.merges)
        self.ids = np.array([*encoder.plain, *encoder.final, -1], np.int64)
        self.first_pairs = self.table.find(np.repeat(self.ids, len(self.ids)), np.tile(self.ids, len(self.ids)))
        self.kinds = np.zeros(256, np.uint8)
        self.kinds[list(string.ascii_lowercase.encode())] = LETTER
        marks = [c for c in string.punctuation if c != "<" and [p for p, _ in encoder.split_letters(encoder.normalised(f"a{c}'{c}"))] == ["a", f"{c}'{c}"]]
        self.kinds[list("".join(marks).encode())] = MARK
        self.two_byte_letters = np.zeros(1 << 11, bool)
        self.two_byte_letters[[ord(c) for c in encoder.alphabet]] = True

    def encode(self, words: list[bytes]) -> list[bytes]:
        """Packed ids of each word."""
        made: list[bytes | None] = [None] * len(words)
        if self.arrays and words:
            self.encode_plain(words, made)
        return [self.encoder.encode_word(w) if m is None else m for w, m in zip(words, made, strict=True)]

    def encode_plain(self, words: list[bytes], made: list[bytes | None]) -> None:
        """Fills in what is made of words of letters and marks, up to CACHED_WORD_BYTES long."""
        data = np.frombuffer(b" ".join([*words, b" " * CACHED_WORD_BYTES]), np.uint8)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1  # of the spaces after words
        kinds = self.kinds[data]
        leads = np.flatnonzero((data >= 0xC2) & (data < 0xE0))
        nexts = data[leads + 1]
        letters = leads[(nexts >> 6 == 2) & self.two_byte_letters[(data[leads].astype(np.int64) & 0x1F) << 6 | nexts & 0x3F]]
        kinds[letters] = kinds[letters + 1] = LETTER
        # A letter after a mark counts as neither.
        odd = kinds == 0
        odd[1:] |= (kinds[1:] == LETTER) & (kinds[:-1] == MARK)
        odd_before = np.concatenate([[0], np.cumsum(odd)])
        fit = (odd_before[ends] == odd_before[ends - lengths]) & (lengths <= CACHED_WORD_BYTES) & (lengths > 0)
        symbols = data.astype(np.int64)
        symbols[:-1][kinds[1:] != kinds[:-1]] += FINAL  # what follows is of another kind: marks or the space
        widths = -(-lengths // WIDTH_STEP) * WIDTH_STEP
        order = np.flatnonzero(fit)
        order = order[np.argsort(widths[order], kind="stable")]
        for group in np.split(order, np.flatnonzero(np.diff(widths[order])) + 1):
            for lo in range(0, len(group), COLUMNS):
                some = group[lo : lo + COLUMNS]
                rows = np.arange(widths[some[0]])[:, None]
                columns = symbols[rows + (ends - lengths)[some]]
                columns[rows >= lengths[some]] = NOTHING
                ids = self.merge(columns)
                there = ids.T >= 0
                lasts = (np.cumsum(there.sum(axis=1)) * 4).tolist()
                packed = ids.T[there].astype("<u4").tobytes()
                for i, first, last in zip(some.tolist(), [0, *lasts[:-1]], lasts, strict=True):
                    made[i] = packed[first:last]

    def merge(self, symbols: np.ndarray) -> np.ndarray:
        """Ids of columns of symbols, -1 where a symbol was merged away or none is."""
        height, width = symbols.shape
        # The last row stays empty: the neighbour of a column's first and last symbols.
        ids = np.full((height + 1, width), -1, np.int64)
        ids[:-1] = self.ids[symbols]
        keys = np.full((height + 1, width), NO_PAIR << ROW_BITS, np.int64)
        rows = np.arange(height + 1)[:, None]
        keys[: height - 1] = self.first_pairs[symbols[:-1] * len(self.ids) + symbols[1:]] << ROW_BITS | rows[: height - 1]
        before, after = np.broadcast_to(rows - 1, ids.shape).copy(), np.broadcast_to(rows + 1, ids.shape).copy()
        before[0] = height
        after[height - 1 :] = height
        flat_ids, flat_keys, flat_before, flat_after = ids.reshape(-1), keys.reshape(-1), before.reshape(-1), after.reshape(-1)
        find = self.table.find
        columns = np.arange(width)
        least = keys.min(axis=0)
        while True:
            going = least < NO_PAIR << ROW_BITS
            columns, least = columns[going], least[going]
            if not len(columns):
                return ids[:-1]
            row, made = least & (1 << ROW_BITS) - 1, least >> ROW_BITS & 0xFFFFF
            left = row * width + columns
            right = flat_after[left] * width + columns
            next_row = flat_after[right]
            following = next_row * width + columns
            last_row = flat_before[left]
            preceding = last_row * width + columns
            flat_ids[left] = made
            flat_ids[right] = -1
            flat_after[left] = next_row
            flat_before[following] = row
            flat_keys[right] = NO_PAIR << ROW_BITS
            flat_keys[left] = find(made, flat_ids[following]) << ROW_BITS | row
            flat_keys[preceding] = find(flat_ids[preceding], made) << ROW_BITS | last_row
            least = np.take(keys, columns, axis=1).min(axis=0)


class ManyStore(Store):
    """A store of words that are made many at a time: one that isn't known gives a bytearray, which fill fills."""

    def __init__(self, words: ManyWords, size: int) -> None:
        super().__init__(words.encoder.encode_word, size)
        self.words = words
        self.empty: dict[bytes, bytearray] = {}

    def __missing__(self, key: bytes) -> bytes | bytearray:
        if len(key) > CACHED_WORD_BYTES:
            return self.make(key)
        made = self.last.get(key)
        if made is None:
            made = self.empty.get(key)  # in a chunk with more words than two generations
        if made is None:
            self.empty[key] = made = bytearray()
        if len(self) >= self.size:
            self.last = dict(self)
            self.clear()
        self[key] = made
        return made

    def fill(self) -> None:
        """Fills all that was given empty, and keeps bytes in its stead."""
        for (key, held), made in zip(self.empty.items(), self.words.encode(list(self.empty)), strict=True):
            held += made
            if self.get(key) is held:
                self[key] = made
            elif self.last.get(key) is held:
                self.last[key] = made
        self.empty = {}
