"""Types of files by their first bytes: all signatures in one walk.

A signature is bytes at an offset, with a mask for those that may differ. All
of them of an offset are compiled to one table: its states are the sets of signatures
that still fit, so a file's type takes as many steps as the longest signature
has bytes, however many there are, and a batch of files takes each step together.
Of several that fit, the one with the most fixed bytes wins, then the first.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Signature(NamedTuple):
    kind: str
    offset: int
    pattern: str  # hexadecimal; ?? for a byte that may be any


# Kinds and their bytes, from the formats' published descriptions.
SIGNATURES = [
    Signature("image/jpeg", 0, "FFD8FF"), Signature("image/png", 0, "89504E470D0A1A0A"), Signature("image/gif", 0, "47494638"), Signature("image/webp", 0, "52494646????????57454250"),
    Signature("image/bmp", 0, "424D"), Signature("image/tiff", 0, "49492A00"), Signature("image/tiff", 0, "4D4D002A"), Signature("image/vnd.microsoft.icon", 0, "00000100"), Signature("image/vnd.adobe.photoshop", 0, "38425053"),
    Signature("image/jxl", 0, "FF0A"), Signature("image/heif", 4, "6674797068656963"), Signature("image/avif", 4, "6674797061766966"), Signature("image/jp2", 0, "0000000C6A5020200D0A870A"),
    Signature("video/mp4", 4, "6674797069736F6D"), Signature("video/mp4", 4, "667479706D703432"), Signature("video/quicktime", 4, "6674797071742020"), Signature("video/webm", 0, "1A45DFA3"), Signature("video/x-msvideo", 0, "52494646????????41564920"), Signature("video/mpeg", 0, "000001BA"), Signature("video/x-flv", 0, "464C5601"),
    Signature("audio/mpeg", 0, "494433"), Signature("audio/mpeg", 0, "FFFB"), Signature("audio/ogg", 0, "4F676753"), Signature("audio/x-flac", 0, "664C6143"), Signature("audio/x-wav", 0, "52494646????????57415645"), Signature("audio/midi", 0, "4D546864"), Signature("audio/amr", 0, "2321414D520A"), Signature("audio/m4a", 4, "667479704D344120"),
    Signature("application/pdf", 0, "25504446"), Signature("application/rtf", 0, "7B5C727466"), Signature("application/epub+zip", 0, "504B0304????????????????????????????????????????????????????6D696D65747970656170706C69636174696F6E2F657075622B7A6970"),
    Signature("application/zip", 0, "504B0304"), Signature("application/zip", 0, "504B0506"), Signature("application/zip", 0, "504B0708"), Signature("application/gzip", 0, "1F8B08"), Signature("application/x-bzip2", 0, "425A68"), Signature("application/x-7z-compressed", 0, "377ABCAF271C"),
    Signature("application/x-xz", 0, "FD377A585A00"), Signature("application/zstd", 0, "28B52FFD"), Signature("application/x-lz4", 0, "04224D18"), Signature("application/vnd.rar", 0, "526172211A07"), Signature("application/x-tar", 257, "7573746172"), Signature("application/vnd.ms-cab-compressed", 0, "4D534346"), Signature("application/x-unix-archive", 0, "213C617263683E"), Signature("application/x-cpio", 0, "303730373031"),
    Signature("application/x-rpm", 0, "EDABEEDB"), Signature("application/vnd.debian.binary-package", 0, "213C617263683E0A64656269616E2D62696E617279"), Signature("application/x-compress", 0, "1F9D"), Signature("application/x-lzip", 0, "4C5A4950"), Signature("application/vnd.sqlite3", 0, "53514C69746520666F726D6174203300"),
    Signature("application/x-executable", 0, "7F454C46"), Signature("application/vnd.microsoft.portable-executable", 0, "4D5A"), Signature("application/wasm", 0, "0061736D"), Signature("application/x-mach-binary", 0, "CFFAEDFE"), Signature("application/x-mach-binary", 0, "CEFAEDFE"), Signature("application/x-mach-binary", 0, "FEEDFACF"), Signature("application/x-mach-binary", 0, "FEEDFACE"),
    Signature("application/java-vm", 0, "CAFEBABE"), Signature("application/x-ole-storage", 0, "D0CF11E0A1B11AE1"), Signature("application/vnd.apache.parquet", 0, "50415231"), Signature("application/dicom", 128, "4449434D"), Signature("application/x-shockwave-flash", 0, "465753"), Signature("application/x-shockwave-flash", 0, "435753"), Signature("application/x-nes-rom", 0, "4E45531A"), Signature("application/x-google-chrome-extension", 0, "43723234"),
    Signature("application/font-woff", 0, "774F464600010000"), Signature("application/font-woff", 0, "774F463200010000"), Signature("application/font-sfnt", 0, "0001000000"), Signature("application/font-sfnt", 0, "4F54544F00"), Signature("application/vnd.ms-fontobject", 34, "4C50"),
    Signature("text/x-shellscript", 0, "2321"), Signature("text/html", 0, "3C21444F43545950452068746D6C"), Signature("text/html", 0, "3C21646F63747970652068746D6C"), Signature("text/html", 0, "3C68746D6C"), Signature("text/xml", 0, "3C3F786D6C"), Signature("application/postscript", 0, "25215053"),
]


def _cells(signature: Signature) -> list[int]:
    """The bytes from the signature's offset on, -1 for any."""
    return [-1 if p == "??" else int(p, 16) for p in (signature.pattern[i : i + 2] for i in range(0, len(signature.pattern), 2))]


def weight(signature: Signature) -> int:
    return sum(c >= 0 for c in _cells(signature))


def n_bytes(signatures: tuple[Signature, ...]) -> int:
    """First bytes of a file that tell its type."""
    return max(s.offset + len(_cells(s)) for s in signatures)


@functools.lru_cache(maxsize=64)
def compiled(signatures: tuple[Signature, ...], offset: int) -> tuple[np.ndarray, np.ndarray]:
    """(next state for each state and byte, the best signature that is read whole in each state, or -1) of the signatures at one offset. State 0 is where nothing fits any more, state 1 the start."""
    cells = {i: _cells(s) for i, s in enumerate(signatures) if s.offset == offset}
    known: dict[tuple[frozenset[int], int], int] = {(frozenset(cells), 0): 1}
    rows, best, todo = [np.zeros(256, np.int32)], [-1, -1], list(known)
    for alive, depth in todo:
        here = {i: cells[i][depth] for i in alive if len(cells[i]) > depth}
        free = frozenset(i for i, c in here.items() if c < 0)
        row = np.zeros(256, np.int32)
        for byte in range(256):
            left = free | {i for i, c in here.items() if c == byte}
            if not left:
                continue
            if (left, depth + 1) not in known:
                known[left, depth + 1] = len(known) + 1
                todo.append((left, depth + 1))
                best.append(min((i for i in left if len(cells[i]) == depth + 1), key=lambda i: (-weight(signatures[i]), i), default=-1))
            row[byte] = known[left, depth + 1]
        rows.append(row)
    return np.stack(rows), np.array(best, np.int64)


def kinds(heads: list[bytes], signatures: tuple[Signature, ...]) -> np.ndarray:
    """The number of the signature of each file's first bytes, or -1."""
    longest = n_bytes(signatures)
    sizes = np.array([min(len(h), longest) for h in heads], np.int64)
    block = np.zeros((len(heads), longest), np.uint8)
    for i, head in enumerate(heads):
        block[i, : sizes[i]] = np.frombuffer(head[:longest], np.uint8)
    # Weights come with the number, so that the larger value is the better signature.
    value = np.array([weight(s) * len(signatures) - i for i, s in enumerate(signatures)] + [-1 << 40], np.int64)
    found = np.full(len(heads), -1, np.int64)
    for offset in sorted({s.offset for s in signatures}):
        table, best = compiled(signatures, offset)
        state = np.ones(len(heads), np.int32)
        for step in range(offset, longest):
            alive = np.flatnonzero((state > 0) & (sizes > step))
            if not len(alive):
                break
            state[alive] = table[state[alive], block[alive, step]]
            won = best[state[alive]]
            found[alive] = np.where(value[won] > value[found[alive]], won, found[alive])
    return found


def with_kind(rows: DataFrame, content: str, name: str = "kind", signatures: tuple[Signature, ...] = tuple(SIGNATURES)) -> DataFrame:
    """rows, without the content, with the kind that its first bytes tell, null if none does. Only the first bytes move to Python."""
    longest = n_bytes(signatures)
    others = [c for c in rows.columns if c != content]
    plain = rows.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(others)], F.substring(F.col(f"`{content}`").cast("binary"), 1, longest).alias("_head"))
    names = np.array([s.kind for s in signatures], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = kinds([h or b"" for h in batch.column("_head").to_pylist()], signatures)
            told = pa.array([names[i] if i >= 0 else None for i in found.tolist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], told], [*batch.schema.names[:-1], "_kind"])

    return plain.mapInArrow(run, plain.drop("_head").schema.add("_kind", "string")).toDF(*others, name)
