"""SimHash near-dedup with Golay-code fuzzy hashing.

Fingerprints link when they differ in at most 2 of 64 bits. The bits are dealt
into three segments. Two errors leave at least one segment untouched, and each
other segment has at most 2, so with the segment that is untouched as exact
part, a Golay key of another segment (see golay.py) is shared. A distinct
fingerprint therefore gets three exact parts with one or six Golay keys each.
Rows that share a key meet in one partition, are verified bit by bit, and
leave as a spanning forest of that partition's links, never as all pairs.
Connected components then come from alternating large-star and small-star
rounds over written tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import golay
from .common import as_bytes, durable, shuffle_width

SHINGLE_WORDS = 3
MAX_BITS = 2
#: (lowest bit, number of bits) of the three segments, and the segment that gives the Golay key when each is the exact part.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
PARTNER = (1, 2, 0)
SMALL_BUCKET = 64
PAIRWISE_BUCKET = 2048
#: Fingerprints for each partition of the search (each has some 16 keys), and nodes that a forest holds before it is sent.
PARTITION_PRINTS = 1 << 17
FOREST_NODES = 1 << 18


def fingerprint(text: bytes, shingle_words: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash of the word shingles of UTF-8 text, repeats included; 0 without words."""
    words = text.lower().split()  # bytes: only A-Z change, and only space and 9-13 separate
    if not words:
        return 0
    joined = b" ".join(words)
    hash_of = xxhash.xxh64_intdigest
    if len(words) <= shingle_words:
        hashes = [hash_of(joined, 42)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words]).tolist()
        starts = [0, *ends]
        hashes = [hash_of(joined[a : b - 1], 42) for a, b in zip(starts, ends[shingle_words - 1 :], strict=False)]
    total = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 1 << 14):  # the bits of one piece at a time
        part = np.array(hashes[lo : lo + (1 << 14)], "<u8")
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint_batches(shingle_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t.as_py(), shingle_words) for t in batch.column("text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints, pa.int64())], ["doc_id", "fp"])

    return run


def bucket_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, keys) of uint64 fingerprints."""
    parts = [(prints >> np.uint64(lo) & np.uint64((1 << n) - 1)).astype(np.int64) for lo, n in SEGMENTS]
    rows, found = [], []
    for j, exact in enumerate(parts):
        r, k = golay.keys(parts[PARTNER[j]])
        rows.append(r)
        found.append((np.int64(j) << 34) | exact[r] << 12 | k)
    return np.concatenate(rows), np.concatenate(found)


def _key_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = batch.column("fp").to_numpy(zero_copy_only=False)
        rows, found = bucket_keys(prints.view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(prints[rows])], ["bucket", "fp"])


class Forest:
    """Union-find over the fingerprints that have a link so far; links holds those that joined two trees."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}
        self.links: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        up = self.up
        top = x
        while (parent := up.setdefault(top, top)) != top:
            top = parent
        while up[x] != top:
            up[x], x = top, up[x]
        return top

    def join(self, left: np.ndarray, right: np.ndarray) -> None:
        for a, b in zip(left.tolist(), right.tolist(), strict=True):
            x, y = self.root(a), self.root(b)
            if x != y:
                self.up[max(x, y)] = min(x, y)
                self.links.append((a, b))


def _near(a: np.ndarray, b: np.ndarray, max_bits: int) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= max_bits


def _link_large(prints: np.ndarray, forest: Forest, max_bits: int) -> None:
    """Links within one bucket of distinct sorted int64 fingerprints, in blocks; beyond PAIRWISE_BUCKET by looking up every neighbour within max_bits."""
    bits = prints.view(np.uint64)
    if len(prints) <= PAIRWISE_BUCKET:
        for i in range(len(bits) - 1):
            near = np.flatnonzero(_near(bits[i], bits[i + 1 :], max_bits))
            forest.join(np.broadcast_to(prints[i], near.shape), prints[near + i + 1])
        return
    ones = [np.uint64(1 << b) for b in range(64)]
    flips = [a | b for i, a in enumerate(ones) for b in (ones[i:] if max_bits > 1 else [a])]
    for lo in range(0, len(bits), 1 << 16):
        part = bits[lo : lo + (1 << 16)]
        for flip in flips:
            other = (part ^ flip).view(np.int64)
            at = np.minimum(np.searchsorted(prints, other), len(prints) - 1)
            hit = np.flatnonzero((prints[at] == other) & (other > part.view(np.int64)))
            forest.join(part.view(np.int64)[hit], other[hit])


def link_sorted(bucket: np.ndarray, prints: np.ndarray, forest: Forest, max_bits: int) -> None:
    """Adds to forest all links within the buckets of rows sorted by (bucket, fingerprint)."""
    start = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    sizes = np.diff(np.append(start, len(bucket)))
    bits = prints.view(np.uint64)
    small = np.repeat(sizes <= SMALL_BUCKET, sizes)
    for step in range(1, min(SMALL_BUCKET, int(sizes.max(initial=1)))):
        near = (bucket[step:] == bucket[:-step]) & small[step:] & _near(bits[step:], bits[:-step], max_bits)
        if not near.any() and not (bucket[step:] == bucket[:-step]).any():
            break
        at = np.flatnonzero(near)
        forest.join(prints[at], prints[at + step])
    for s, n in zip(start[sizes > SMALL_BUCKET], sizes[sizes > SMALL_BUCKET], strict=True):
        _link_large(np.unique(prints[s : s + n]), forest, max_bits)


def _link_batches(max_bits: int):
    """Links that span what the partition's buckets link; a forest that has grown to FOREST_NODES is sent and begun anew."""

    def sent(forest: Forest) -> pa.RecordBatch:
        u, v = zip(*forest.links, strict=True) if forest.links else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, held = Forest(), []
        for batch in batches:
            bucket, prints = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "fp"))
            if not len(bucket):
                continue
            cut = int(np.searchsorted(bucket, bucket[-1]))  # the last bucket may go on in the next batch
            held.append((bucket[:cut], prints[:cut]))
            if cut:
                link_sorted(*(np.concatenate(x) for x in zip(*held, strict=True)), forest, max_bits)
                held = []
            held.append((bucket[cut:], prints[cut:]))
            if len(forest.up) >= FOREST_NODES:
                yield sent(forest)
                forest = Forest()
        if held:
            link_sorted(*(np.concatenate(x) for x in zip(*held, strict=True)), forest, max_bits)
        yield sent(forest)

    return run


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, root) for every node of edges(u, v), root being the least node of its component; alternating large and small stars.

    The least neighbours are written, so that the joins have plain shuffles, which Spark may split where one node has very many links.
    """
    stars = durable(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct(), label)
    before = None
    while True:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = durable(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), label)
        large = durable(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct(), label)
        least = durable(large.groupBy("u").agg(F.min("v").alias("m")), label)
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        stars = durable(small.filter("u != v").distinct(), label)
        seen = stars.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.count_distinct("u")).first()
        # A forest of stars: every node has one root, and no root has one itself.
        if seen == before:
            return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = seen


def print_links(distinct: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Links (u, v) between fingerprints of distinct(fp), a written table, that differ in at most max_bits bits; they span the components of all such links."""
    if max_bits > MAX_BITS:
        raise ValueError("three segments find at most 2 differing bits")
    n = max(shuffle_width(distinct.sparkSession), distinct.count() // PARTITION_PRINTS + 1)
    keyed = distinct.select("fp").mapInArrow(_key_batches, "bucket long, fp long")
    return keyed.repartition(n, "bucket").sortWithinPartitions("bucket", "fp").mapInArrow(_link_batches(max_bits), "u long, v long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable, itself included).

    Ids are read as long: a column that can't be cast so is an error of Spark's.
    Null and empty texts have fingerprint zero and link like any other. Rows
    with a null id take part in links; component_id is null only where no row
    that is reachable has an id. Repeated rows give repeated rows. Other columns
    are not read. No rows give no rows.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), as_bytes(F.col(text_col)).alias("text"))
    prints = durable(texts.mapInArrow(fingerprint_batches(shingle_words), "doc_id long, fp long"), "fingerprints")
    distinct = durable(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprint-groups")
    found = components(print_links(distinct, max_bits))
    rooted = durable(distinct.join(found, distinct["fp"] == found["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "fingerprint-roots")
    classes = durable(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "fingerprint-classes")
    by_print = durable(rooted.join(classes, "root").select("fp", "component_id"), "fingerprint-components")
    return prints.join(by_print, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose id is the smallest of their component, all columns kept; rows with a null id stay only where no reachable row has an id.

    Rows that repeat such an id all stay. Other columns of docs may have any name.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    keep = simhash_components(docs, id_col, text_col).filter(F.col("component_id").eqNullSafe(F.col("doc_id"))).select(F.col("doc_id").alias("kept_id")).distinct()
    return docs.select(row).join(keep, F.col(f"row.`{id_col}`").eqNullSafe(F.col("kept_id")), "left_semi").select("row.*")
