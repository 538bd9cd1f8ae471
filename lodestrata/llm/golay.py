"""The perfect binary Golay code of length 23, as tables.

Every 23-bit word is within 3 bits of exactly one of the 4,096 codewords. A
word's keys are the 12-bit indices of all codewords within 4 bits of it: one
key, or six for a word that lies 3 bits from its codeword. Two words that
differ in at most 2 bits have a word between them at most 1 bit from both; its
codeword is within 4 bits of both, so they share a key.
"""

from __future__ import annotations

import functools

import numpy as np

LENGTH, DATA_BITS, CHECK_BITS = 23, 12, 11
#: Fixed value: the generator polynomial x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011


def _remainder(word: int) -> int:
    for bit in range(LENGTH - 1, CHECK_BITS - 1, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - CHECK_BITS)
    return word


@functools.cache
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(column syndromes by byte: 3 x 256, index offsets by syndrome: 2048 x 6, number of keys by syndrome: 2048).

    The code is systematic: the index of a codeword is its upper 12 bits.
    """
    unit = [_remainder(1 << b) for b in range(LENGTH)]
    syndromes = np.zeros((3, 256), np.int64)
    for part in range(3):
        for byte in range(256):
            for b in range(8):
                if byte >> b & 1 and part * 8 + b < LENGTH:
                    syndromes[part, byte] ^= unit[part * 8 + b]
    # Error patterns of up to 4 bits by syndrome: the leader of up to 3 bits, and those of 4 bits.
    near: list[list[int]] = [[] for _ in range(1 << CHECK_BITS)]

    def grow(error: int, syndrome: int, weight: int, start: int) -> None:
        near[syndrome].append(error)
        if weight < 4:
            for b in range(start, LENGTH):
                grow(error | 1 << b, syndrome ^ unit[b], weight + 1, b + 1)

    grow(0, 0, 0, 0)
    offsets = np.zeros((1 << CHECK_BITS, 6), np.int64)
    counts = np.zeros(1 << CHECK_BITS, np.int64)
    for syndrome, errors in enumerate(near):
        errors.sort(key=lambda e: (e.bit_count(), e))
        counts[syndrome] = len(errors)
        offsets[syndrome, : len(errors)] = [e >> CHECK_BITS for e in errors]
    return syndromes, offsets, counts


def keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, 12-bit keys): all keys of each 23-bit word."""
    syndromes, offsets, counts = tables()
    words = words.astype(np.int64)
    s = syndromes[0][words & 255] ^ syndromes[1][words >> 8 & 255] ^ syndromes[2][words >> 16 & 255]
    n = counts[s]
    rows = np.repeat(np.arange(len(words)), n)
    nth = np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)
    return rows, (words[rows] >> CHECK_BITS) ^ offsets[s[rows], nth]
