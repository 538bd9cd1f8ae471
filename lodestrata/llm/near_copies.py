"""Near copies: texts whose sets of 5-word shingles have a Jaccard similarity of at least 0.8.

Fingerprints of the shingles that differ in at most 2 bits (simhash.py) give
the first candidates. A similarity of 0.8 often changes more bits than any key
of a fingerprint tolerates, so the rest come from prefix filtering, which
misses no pair: if all shingles stand in one global order, two sets of that similarity share an element among
the first n - ceil(0.8 n) + 1 of their n elements. Any order gives the same
links; this one goes by a sketch of counts (2^22 slots, whose logarithms go to
all tasks, 4 MB), frequent shingles last, so that common passages seldom bring
texts together.

A pair is compared in three steps. Each row has a sketch: how many of its
distinct shingles fall into each of some slots. What two sketches have in
common is at least what the sets have in common, so most pairs end there, and
no text moves for them. Then hashes of shingles reject, and words accept.

A pair is looked at under the first element that both have: what stands before
it in either set isn't shared, so the rest of the smaller side bounds what is.
Rows that share an element are first compared with the one of them that has the
least before it, which joins large groups by few comparisons: of texts that are
a common passage and something of their own, two that are alike are both alike
to the one with the least of its own. Then the pairs that are still in different
components and whose bound leaves room are compared, so the components are those
of all links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, durable, shuffle_width
from .recompression import word_hashes
from .rolling import distinct, mix
from .simhash import components, fingerprint, print_links

SHINGLE_WORDS = 5
#: Similarity of at least 4 / 5.
SHARE, OF = 4, 5
SLOTS = 1 << 22
SLOT_PARTS = 32
CHUNK_BYTES = 1 << 20
BUCKET_BYTES = 4 << 20
SMALL_GROUP = 64
#: Slots of a sketch: at least so many, and a power of two of at least a quarter of the set's size.
LEAST_SKETCH = 256
_STEP = np.uint64(0x9E3779B97F4A7C15)
ENTRY = np.dtype([("key", "<i8"), ("row", "<i8"), ("size", "<i4"), ("place", "<i4")])


def shingles(text: bytes) -> set[bytes]:
    """The word shingles of UTF-8 text; all of a text that is shorter is one."""
    words = text.lower().split()
    return {b" ".join(words[i : i + SHINGLE_WORDS]) for i in range(max(1, len(words) - SHINGLE_WORDS + 1))}


def alike(a: set[bytes], b: set[bytes]) -> bool:
    if OF * min(len(a), len(b)) < SHARE * max(len(a), len(b)):
        return False
    both = len(a & b)
    return OF * both >= SHARE * (len(a) + len(b) - both)


def shingle_hashes(texts: list[bytes]) -> list[np.ndarray]:
    """Hashes of each text's shingles, repeats included."""
    split = [t.lower().split() for t in texts]
    joined = b" ".join(w for words in split for w in words)
    if not joined:
        return [np.zeros(1, np.uint64) for _ in texts]
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    words = word_hashes(np.frombuffer(joined, np.uint8), np.concatenate([[0], gaps + 1]), np.append(gaps, len(joined)))
    every = words[: max(0, len(words) - SHINGLE_WORDS + 1)]
    for i in range(1, SHINGLE_WORDS):
        every = mix(every * _STEP + words[i : i + len(every)])
    found, at = [], 0
    for n in map(len, split):
        if n >= SHINGLE_WORDS:
            found.append(every[at : at + n - SHINGLE_WORDS + 1])
        else:
            short = np.full(1, n, np.uint64)
            for w in words[at : at + n]:
                short = mix(short * _STEP + w)
            found.append(short)
        at += n
    return found


def _chunks(batch: pa.RecordBatch, *columns: str) -> Iterator[tuple[int, list[tuple[bytes, ...]]]]:
    """(first row number, values of the columns) of pieces of a batch."""
    held, size, start = [], 0, 0
    for i, values in enumerate(zip(*(batch.column(c) for c in columns), strict=True)):
        held.append(tuple(v.as_py() for v in values))
        size += sum(map(len, held[-1]))
        if size >= CHUNK_BYTES:
            yield start, held
            held, size, start = [], 0, i + 1
    if held:
        yield start, held


def _shut(counts: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(counts.astype("<i4").tobytes())


def _open(blob: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), "<i4").astype(np.int64)


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(SLOTS, np.int32)
    for batch in batches:
        for _, rows in _chunks(batch, "text"):
            slots, often = np.unique(np.concatenate(shingle_hashes([t for (t,) in rows])) & np.uint64(SLOTS - 1), return_counts=True)
            counts[slots.astype(np.int64)] += often.astype(np.int32)
    yield pa.RecordBatch.from_arrays([pa.array(range(SLOT_PARTS), pa.int64()), pa.array([_shut(x) for x in np.split(counts, SLOT_PARTS)], pa.binary())], ["part", "counts"])


def _summed_counts(table: pa.Table) -> pa.Table:
    total = sum(_open(x.as_py()) for x in table.column("counts"))
    levels = np.floor(np.log2(1 + total)).astype(np.uint8)
    return pa.table({"part": table.column("part")[:1], "total": pa.array([int(total.sum())], pa.int64()), "levels": pa.array([zstandard.ZstdCompressor(level=1).compress(levels.tobytes())], pa.binary())})


def slot_levels(texts: DataFrame) -> tuple[np.ndarray, int]:
    """(level of each slot of shingles: the logarithm of its count, number of shingles)."""
    parts = texts.select("text").mapInArrow(_count_batches, "part long, counts binary").groupBy("part").applyInArrow(_summed_counts, "part long, total long, levels binary").collect()
    if not parts:
        return np.zeros(SLOTS, np.uint8), 0
    levels = [np.frombuffer(zstandard.ZstdDecompressor().decompress(r.levels), np.uint8) for r in sorted(parts, key=lambda r: r.part)]
    return np.concatenate(levels), sum(r.total for r in parts)


def prefix(hashes: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, int]:
    """(first elements of a set in the global order, one of which any set of the wanted similarity has among its own; size of the set)."""
    order = levels[(hashes & np.uint64(SLOTS - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(58) | hashes >> np.uint64(6)
    order = distinct(order)
    n = len(order)
    return order[: n - -(-SHARE * n // OF) + 1].view(np.int64), n


def _prefix_batches(levels: np.ndarray, n_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("row").to_numpy()
            made = []
            for start, texts in _chunks(batch, "text"):
                for row, hashes in zip(rows[start : start + len(texts)].tolist(), shingle_hashes([t for (t,) in texts]), strict=True):
                    keys, size = prefix(hashes, levels)
                    part = np.empty(len(keys), ENTRY)
                    part["key"], part["row"], part["size"], part["place"] = keys, row, size, np.arange(len(keys))
                    made.append(part)
            if not made:
                continue
            entries = np.concatenate(made)
            bucket = (mix(entries["key"].view(np.uint64)) >> np.uint64(20)).astype(np.int64) % n_buckets
            order = np.argsort(bucket, kind="stable")
            entries, bucket = entries[order], bucket[order]
            cuts = np.flatnonzero(np.diff(bucket)) + 1
            yield pa.RecordBatch.from_arrays([pa.array(bucket[np.concatenate([[0], cuts])]), pa.array([x.tobytes() for x in np.split(entries, cuts)], pa.binary())], ["bucket", "entries"])

    return run


def _may_be_alike(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether entries with the same key, the first that both sets have, leave room for the similarity."""
    nx, ny = x["size"].astype(np.int64), y["size"].astype(np.int64)
    most = np.minimum(nx - x["place"], ny - y["place"])
    return (SHARE + OF) * most >= SHARE * (nx + ny)


def _groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place and size of each stretch of equal sorted keys."""
    start = np.flatnonzero(np.concatenate([np.ones(min(1, len(key)), bool), key[1:] != key[:-1]]))
    return start, np.diff(np.append(start, len(key)))


def _distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a, b = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.concatenate([np.ones(min(1, len(a)), bool), (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    return a[new], b[new]


def _star_pairs(table: pa.Table) -> pa.Table:
    """Pairs with the row of each key that has the least before it, and the entries of keys that have further pairs."""
    entries = np.frombuffer(b"".join(table.column("entries").to_pylist()), ENTRY)
    entries = entries[np.argsort(entries["key"], kind="stable")]
    _, sizes = _groups(entries["key"])
    entries = entries[np.repeat(sizes > 1, sizes)]
    entries = entries[np.lexsort((entries["row"], entries["size"], entries["place"], entries["key"]))]
    start, sizes = _groups(entries["key"])
    centre = entries[np.repeat(start, sizes)]
    fit = (centre["row"] != entries["row"]) & _may_be_alike(centre, entries)
    a, b = _distinct(centre["row"][fit], entries["row"][fit])
    more = entries[np.repeat(sizes > 2, sizes)]
    n = len(a)
    return pa.table({
        "bucket": pa.array(np.full(n + 1, table.column("bucket")[0].as_py())), "a": pa.concat_arrays([pa.array(a, pa.int64()), pa.nulls(1, pa.int64())]), "b": pa.concat_arrays([pa.array(b, pa.int64()), pa.nulls(1, pa.int64())]),
        "entries": pa.concat_arrays([pa.nulls(n, pa.binary()), pa.array([more.tobytes()], pa.binary())]),
    })


def _entry_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for bucket, blob in zip(batch.column("bucket").to_pylist(), batch.column("entries"), strict=True):
            entries = np.frombuffer(blob.as_py(), ENTRY)
            for lo in range(0, len(entries), 1 << 16):
                part = entries[lo : lo + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), bucket)), *(pa.array(np.ascontiguousarray(part[c])) for c in ENTRY.names)], ["bucket", *ENTRY.names])


def _other_pairs(table: pa.Table) -> pa.Table:
    """All pairs of each key that are in different components and may be alike."""
    entries = np.empty(table.num_rows, ENTRY)
    for c in ENTRY.names:
        entries[c] = table.column(c).to_numpy()
    root = table.column("root").to_numpy()
    order = np.lexsort((entries["size"], entries["key"]))
    entries, root = entries[order], root[order]
    start, sizes = _groups(entries["key"])
    mixed = np.repeat(np.minimum.reduceat(root, start) != np.maximum.reduceat(root, start), sizes) if len(start) else np.zeros(0, bool)
    entries, root = entries[mixed], root[mixed]
    start, sizes = _groups(entries["key"])
    small = np.repeat(sizes <= SMALL_GROUP, sizes)
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for step in range(1, min(SMALL_GROUP, int(sizes.max(initial=1)))):
        x, y = entries[:-step], entries[step:]
        fit = np.flatnonzero(small[step:] & (x["key"] == y["key"]) & (root[:-step] != root[step:]))
        fit = fit[_may_be_alike(x[fit], y[fit])]
        a.append(x["row"][fit])
        b.append(y["row"][fit])
    for s, n in zip(start[sizes > SMALL_GROUP].tolist(), sizes[sizes > SMALL_GROUP].tolist(), strict=True):
        size = entries["size"][s : s + n].astype(np.int64)
        rest = size - entries["place"][s : s + n]
        # A partner is at least as large, and not larger than what the rest of this one allows.
        ends = s + np.searchsorted(size, (SHARE + OF) * rest // SHARE - size, side="right")
        for i in np.flatnonzero(ends > np.arange(s, s + n) + 1).tolist():
            y = entries[s + i + 1 : ends[i]]
            fit = np.flatnonzero(root[s + i] != root[s + i + 1 : ends[i]])
            fit = fit[_may_be_alike(entries[s + i : s + i + 1], y[fit])]
            a.append(np.full(len(fit), entries["row"][s + i]))
            b.append(y["row"][fit])
    x, y = _distinct(np.concatenate(a), np.concatenate(b))
    return pa.table({"a": pa.array(x, pa.int64()), "b": pa.array(y, pa.int64())})


def _compare_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def sets(texts: list[bytes]) -> list[np.ndarray]:
        return [distinct(x) for x in shingle_hashes(texts)]

    for batch in batches:
        fit = []
        for lo, rows in _chunks(batch, "left", "right"):
            left, right = ([r[i] for r in rows] for i in (0, 1))
            for i, (x, y) in enumerate(zip(sets(left), sets(right), strict=True)):
                if OF * min(len(x), len(y)) < SHARE * max(len(x), len(y)):
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                if OF * both >= SHARE * (len(x) + len(y) - both) and alike(shingles(left[i]), shingles(right[i])):
                    fit.append(lo + i)
        chosen = batch.take(pa.array(fit, pa.int64()))
        yield pa.RecordBatch.from_arrays([chosen.column("a"), chosen.column("b")], ["u", "v"])


def sketch(hashes: np.ndarray) -> bytes:
    """Of distinct hashes, how many fall into each slot; 255 stands for any number from there on."""
    slots = max(LEAST_SKETCH, 1 << (max(1, len(hashes) // 4) - 1).bit_length())
    return np.bincount((hashes >> np.uint64(40)).astype(np.int64) & (slots - 1), minlength=slots).clip(max=255).astype(np.uint8).tobytes()


def most_shared(a: bytes, b: bytes) -> float:
    """At least what the sets of two sketches share; infinite if a slot is full."""
    x, y = (np.frombuffer(s, np.uint8).astype(np.int64) for s in (a, b))
    if max(x.max(), y.max()) == 255:
        return float("inf")
    slots = min(len(x), len(y))
    return int(np.minimum(x.reshape(-1, slots).sum(axis=0), y.reshape(-1, slots).sum(axis=0)).sum())


def _sketch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, fp, size, sketch) of each row."""
    for batch in batches:
        prints, sizes, sketches = [], [], []
        for _, rows in _chunks(batch, "text"):
            texts = [t for (t,) in rows]
            prints += [fingerprint(t, SHINGLE_WORDS) for t in texts]
            for hashes in map(distinct, shingle_hashes(texts)):
                sizes.append(len(hashes))
                sketches.append(sketch(hashes))
        columns = [batch.column("row"), pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["row", "fp", "size", "sketch"])


def _likely_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        nx, ny = (batch.column(c).to_numpy() for c in ("left_size", "right_size"))
        shared = np.array([most_shared(x.as_py(), y.as_py()) for x, y in zip(batch.column("left_sketch"), batch.column("right_sketch"), strict=True)], float)
        fit = np.flatnonzero((SHARE + OF) * shared >= SHARE * (nx + ny))
        chosen = batch.take(pa.array(fit))
        yield pa.RecordBatch.from_arrays([chosen.column("a"), chosen.column("b")], ["a", "b"])


def _links(pairs: DataFrame, texts: DataFrame, sketches: DataFrame, label: str) -> DataFrame:
    """(u, v) of pairs(a, b) whose texts are alike."""

    def side(df: DataFrame, key: str, prefix: str) -> DataFrame:
        return df.select(F.col("row").alias(key), *[F.col(c).alias(f"{prefix}_{c}") for c in df.columns if c != "row"])

    known = sketches.select("row", "size", "sketch")
    both = pairs.join(side(known, "a", "left"), "a").join(side(known, "b", "right"), "b")
    likely = durable(both.select("a", "b", "left_size", "right_size", "left_sketch", "right_sketch").mapInArrow(_likely_batches, "a long, b long"), label + "-likely")
    needed = likely.select(F.explode(F.array("a", "b")).alias("row")).distinct()
    own = texts.join(needed, "row", "left_semi")
    met = likely.join(own.select(F.col("row").alias("a"), F.col("text").alias("left")), "a").join(own.select(F.col("row").alias("b"), F.col("text").alias("right")), "b")
    return durable(met.select("a", "b", "left", "right").mapInArrow(_compare_batches, "u long, v long"), label)


def print_pairs(prints: DataFrame) -> DataFrame:
    """Pairs (a, b) of rows of prints(row, fp) whose fingerprints are linked: every row with the least of its fingerprint, and those with one another."""
    least = durable(prints.groupBy("fp").agg(F.min("row").alias("least")), "near-print-groups")
    same = prints.join(least, "fp").filter("row != least").select(F.col("least").alias("a"), F.col("row").alias("b"))
    linked = print_links(least)
    other = linked.join(least.select(F.col("fp").alias("u"), F.col("least").alias("x")), "u").join(least.select(F.col("fp").alias("v"), F.col("least").alias("y")), "v")
    return same.unionByName(other.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))


def near_links(texts: DataFrame) -> DataFrame:
    """Links (u, v) between rows of texts(row, text), a written table with distinct rows, that join the same rows as all links do."""
    levels, total = slot_levels(texts)
    n = max(shuffle_width(texts.sparkSession), total * ENTRY.itemsize // (OF * BUCKET_BYTES) + 1)
    sent = texts.mapInArrow(_prefix_batches(levels, n), "bucket long, entries binary")
    met = durable(sent.groupBy("bucket").applyInArrow(_star_pairs, "bucket long, a long, b long, entries binary"), "near-candidates")
    sketches = durable(texts.mapInArrow(_sketch_batches, "row long, fp long, size long, sketch binary"), "near-sketches")
    first = durable(print_pairs(sketches.select("row", "fp")).unionByName(met.filter("a is not null").select("a", "b")).distinct(), "near-first-pairs")
    links = _links(first, texts, sketches, "near-first-links")
    joined = components(links, "near-first-components")
    entries = met.filter("length(entries) > 0").select("bucket", "entries").mapInArrow(_entry_batches, "bucket long, key long, row long, size int, place int")
    rooted = entries.join(joined, entries["row"] == joined["node"], "left").select("bucket", "key", "row", "size", "place", F.coalesce("root", "row").alias("root"))
    others = rooted.groupBy("bucket").applyInArrow(_other_pairs, "a long, b long").distinct().join(first, ["a", "b"], "left_anti")
    return links.unionByName(_links(durable(others, "near-others"), texts, sketches, "near-other-links"))


def keep_one_of_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of near copies, the one with the smallest id, all columns kept.

    Components are over links between any two rows whose 5-word shingles have
    a Jaccard similarity of at least 0.8, ASCII case aside; null and empty
    texts are alike. Null ids are later than all others; of rows that repeat
    an id one stays.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own")  # so that no column of docs meets the number
    rows = durable(docs.select(F.monotonically_increasing_id().alias("row"), row), "near-rows")
    found = components(near_links(rows.select("row", as_bytes(F.col(f"own.`{text_col}`")).alias("text"))), "near-components")
    name = F.col(f"own.`{id_col}`")
    place = F.struct(name.isNull().alias("last"), name.alias("id"), "row")
    members = durable(rows.join(found, rows["row"] == found["node"]).select("root", place.alias("place")), "near-members")
    first = members.groupBy("root").agg(F.min("place").alias("first"))
    gone = members.join(first, "root").filter("place.row != first.row").select("place.row")
    return rows.join(gone, "row", "left_anti").select("own.*")
