"""Byte-pair encoding of words with a queue of merge ranks over a linked list of symbols."""

from __future__ import annotations

import functools
import heapq
import json
import struct
from collections.abc import Callable

import regex
from tokenizers import Tokenizer

#: Entries of a generation of a store; there are at most two.
CACHE_WORDS = 300_000
CACHED_WORD_BYTES = 64
NO_MERGE = 1 << 62
#: Code points of the Latin, Greek and Cyrillic alphabets, none of which composes with another letter.
ALPHABETS = [*range(0xC0, 0x250), *range(0x370, 0x530)]
#: Marks that are a piece of their own after letters.
SENTENCE_MARKS = (b".", b",", b";", b":", b"!", b"?")


def byte_letters() -> list[str]:
    """The printable stand-in for each byte that byte-level vocabularies use: printable Latin-1 letters stand for themselves, the others follow from code point 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class BytePairEncoder:
    """A tokenizer file of the kind NFC, white space to space, lower case; split by a pattern; byte letters; BPE with a word-end mark.

    A text is encoded word by word between ASCII white space, which no pattern,
    composition or merge crosses, so the ids of a word don't depend on others.
    What is a letter, and what its lower case and composition are, differs
    between releases of Unicode: words beyond ASCII are normalised and split by
    the library's own tables, so that ids are the library's for every character.
    """

    def __init__(self, path: str, short_scan: bool = False, kept_pieces: int = CACHE_WORDS) -> None:
        """short_scan: pieces of up to CACHED_WORD_BYTES bytes are merged without a queue. kept_pieces: size of a generation of the store of pieces."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocabulary: dict[str, int] = model["vocab"]
        self.word_end: str = model.get("end_of_word_suffix") or ""
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        library = Tokenizer.from_file(path)
        self.normalised, self.split_letters = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.byte_of = {ord(c): b for b, c in enumerate(byte_letters())}
        # Lower-case letters that the library leaves as they are and together; words of them alone are one piece.
        self.alphabet = [c for c in map(chr, ALPHABETS) if self.normalised(f"a{c}{c}b") == f"a{c}{c}b" and len(self.split_letters(f"a{c}{c}b")) == 1]
        self.plain_word = regex.compile("[a-z" + "".join(map(regex.escape, self.alphabet)) + "]+")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = regex.compile("(" + "|".join(sorted(map(regex.escape, self.special), key=len, reverse=True)) + ")")
        self.strings = {i: s for s, i in [*self.vocabulary.items(), *self.special.items()]}
        self.plain = [self.vocabulary[c] for c in byte_letters()]
        self.final = [self.vocabulary[c + self.word_end] for c in byte_letters()]
        # A pair of ids as one number; its rank (from 1) and what it makes as another, which sorts by rank.
        self.merges: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"], 1):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[self.vocabulary[a] << 20 | self.vocabulary[b]] = rank << 20 | self.vocabulary[a + b]
        # Different words share pieces: those before a comma, at a sentence's start and so on.
        self.pieces = Store(lambda piece: packed(self.merge_short(piece) if short_scan and len(piece) <= CACHED_WORD_BYTES else self.merge(piece)), kept_pieces)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one non-empty piece, given in UTF-8."""
        plain, merges = self.plain, self.merges
        ids = [plain[b] for b in piece]
        n = len(ids)
        ids[-1] = self.final[piece[-1]]
        get, shift = merges.get, n.bit_length()
        # An entry is a number: the merge's rank, what it makes, and the place of its left symbol.
        queue = [found << shift | i for i in range(n - 1) if (found := get(ids[i] << 20 | ids[i + 1]))]
        if not queue:
            return ids
        heapq.heapify(queue)
        push, pop, place = heapq.heappush, heapq.heappop, (1 << shift) - 1
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        while queue:
            entry = pop(queue)
            i = entry & place
            left, j = ids[i], after[i]
            # Stale: a side was merged away, or the pair is another one by now.
            if left < 0 or j >= n or get(left << 20 | ids[j]) != entry >> shift:
                continue
            ids[i] = made = entry >> shift & 0xFFFFF
            ids[j] = -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if found := get(made << 20 | ids[k]):
                    push(queue, found << shift | i)
            if (h := before[i]) >= 0 and (found := get(ids[h] << 20 | made)):
                push(queue, found << shift | h)
        return [x for x in ids if x >= 0]

    def merge_short(self, piece: bytes) -> list[int]:
        """As merge, by looking for the best pair again and again: quicker for pieces of a word's size, quadratic beyond."""
        plain, get = self.plain, self.merges.get
        ids = [plain[b] for b in piece]
        ids[-1] = self.final[piece[-1]]
        pairs = [get(a << 20 | b, NO_MERGE) for a, b in zip(ids, ids[1:], strict=False)]
        while pairs and (found := min(pairs)) != NO_MERGE:
            i = pairs.index(found)
            ids[i] = made = found & 0xFFFFF
            del ids[i + 1], pairs[i]
            if i:
                pairs[i - 1] = get(ids[i - 1] << 20 | made, NO_MERGE)
            if i < len(pairs):
                pairs[i] = get(made << 20 | ids[i + 1], NO_MERGE)
        return ids

    def encode_word(self, word: bytes) -> bytes:
        """Packed ids of UTF-8 text without ASCII white space, special tokens in it included."""
        pieces = self.pieces
        if word.isalpha() and word.islower():  # ASCII letters are one piece, whatever the pattern says of contractions
            return pieces[word]
        if word[-1:] in SENTENCE_MARKS and word[:-1].isalpha() and word.islower():
            return pieces[word[:-1]] + pieces[word[-1:]]
        text = word.decode("utf-8", "replace")
        if self.plain_word.fullmatch(text):
            return pieces[word]
        if word[-1:] in SENTENCE_MARKS and self.plain_word.fullmatch(text[:-1]):
            return pieces[word[:-1]] + pieces[word[-1:]]
        if "<|" not in text:
            return b"".join([pieces[p] for p in self.cut(text)])
        out = []
        for part in self.special_pattern.split(text):
            if part in self.special:
                out.append(packed([self.special[part]]))
            else:
                out += [pieces[p] for p in self.cut(part)]
        return b"".join(out)

    def cut(self, text: str) -> list[bytes]:
        """The pieces of normalised text, in UTF-8."""
        if text.isascii():
            return [p.encode() for p in self.pattern.findall(text.lower())]
        # The library gives pieces in byte letters.
        return [p.translate(self.byte_of).encode("latin-1") for p, _ in self.split_letters(self.normalised(text))]

    def decode(self, ids: list[int]) -> str:
        """The vocabulary strings of ids; such a file has no decoder, so they are joined by spaces."""
        return " ".join(self.strings[i] for i in ids)


class Store(dict):
    """Maps keys to what make gives for them, in bounded memory: when full, it starts again and takes over what is asked for from its last generation. Long keys are not kept."""

    def __init__(self, make: Callable, size: int = CACHE_WORDS) -> None:
        super().__init__()
        self.make, self.last, self.size = make, {}, size

    def __missing__(self, key):
        made = self.last.get(key)
        if made is None:
            made = self.make(key)
        if len(key) <= CACHED_WORD_BYTES:
            if len(self) >= self.size:
                self.last = dict(self)
                self.clear()
            self[key] = made
        return made


def word_store(encoder: BytePairEncoder, make: Callable, size: int = CACHE_WORDS) -> Store:
    """UTF-8 words to what make gives for their packed ids."""
    return Store(lambda word: make(encoder.encode_word(word)), size)


def split_words(text: bytes) -> list[bytes]:
    """The words of UTF-8 text between ASCII white space; in lower case as far as ASCII goes, as encoding does that anyway, unless a special token may be there."""
    return text.split() if b"<|" in text else text.lower().split()


def packed(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return struct.pack(f"<{len(ids)}I", *ids)


def unpacked(ids: bytes) -> tuple[int, ...]:
    return struct.unpack(f"<{len(ids) // 4}I", ids)


@functools.cache
def encoder(path: str, short_scan: bool = False, kept_pieces: int = CACHE_WORDS) -> BytePairEncoder:
    """The encoder of a file; one for each worker process."""
    return BytePairEncoder(path, short_scan, kept_pieces)
