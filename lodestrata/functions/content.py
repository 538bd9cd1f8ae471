"""Byte and text features as columns."""

from __future__ import annotations

import gzip

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType

#: Bytes that are counted at once.
COUNTED_BYTES = 1 << 16


def byte_view(text: Column) -> Column:
    """Text with one character per UTF-8 byte, so that character positions are byte positions."""
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


def _byte_counts(value: np.ndarray) -> np.ndarray:
    """How often each byte occurs; by pieces, as counting widens what it counts to eight times its size."""
    counts = np.zeros(256, np.int64)
    for at in range(0, len(value), COUNTED_BYTES):
        counts += np.bincount(value[at : at + COUNTED_BYTES], minlength=256)
    return counts


@F.arrow_udf(DoubleType())
def byte_entropy(content: pa.Array) -> pa.Array:
    """Shannon entropy in bits per byte; 0 for empty, null for null. Contents are read where they lie in their batch, never copied."""

    def entropy(value: pa.Scalar) -> float | None:
        if not value.is_valid:
            return None
        held = value.as_buffer()
        if not held.size:
            return 0.0
        share = _byte_counts(np.frombuffer(held, np.uint8)) / held.size
        share = share[share > 0]
        return float(-(share * np.log2(share)).sum()) + 0.0

    # What earlier batches left in the pool goes back, so that a worker holds a batch, however many it reads.
    pa.default_memory_pool().release_unused()
    return pa.array(map(entropy, content), pa.float64())


@F.pandas_udf(BinaryType())
def gzip_bytes(content: pd.Series) -> pd.Series:
    """Contents as one gzip member each; null for null."""
    return content.map(lambda v: gzip.compress(v, mtime=0) if isinstance(v, bytes | bytearray) else None)


def line_lengths(content: Column) -> Column:
    return F.transform(F.split(F.decode(content, "ISO-8859-1"), "\n"), F.length)


def line_count(content: Column) -> Column:
    """Lines by \\n; a final \\n starts no line."""
    lengths = line_lengths(content)
    return (F.size(lengths) - F.when(F.element_at(lengths, -1) == 0, 1).otherwise(0)).cast("long")


def max_line_length(content: Column) -> Column:
    return F.coalesce(F.array_max(line_lengths(content)), F.lit(0)).cast("long")


def longest_match(text: Column, pattern: str) -> Column:
    """Characters of the longest match, 0 without any."""
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.length)), F.lit(0))


def occurrences(text: Column, needle: str) -> Column:
    """Occurrences that don't overlap."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(needle), F.lit("")))) / len(needle)).cast("long")


def contains_any(text: Column, needles: list[str]) -> Column:
    found = F.lit(False)
    for needle in needles:
        found = found | text.contains(needle)
    return found


def first_line(text: Column, needle: Column | str) -> Column:
    """1-based line of the first occurrence of a needle without line breaks; null without one."""
    needle = F.lit(needle) if isinstance(needle, str) else needle
    at = F.position(needle, text)
    before = F.substr(text, F.lit(1), at)
    return F.when(at > 0, F.length(before) - F.length(F.translate(before, "\n", "")) + 1).cast("long")

