"""Near-duplicate vectors by spherical-cap filters.

A filter is a direction, and a vector is in those whose spherical caps hold it.
Directions are structured: the coordinates, randomly rotated, are cut into
blocks, each block has a small random codebook, and every combination of one
codeword a block is a direction. So there are very many directions, yet those
nearest to a vector are listed block by block, keeping the best sums. A cap is
as wide as it has to be for a vector to be in CAP_LIST directions of a code: a
fixed threshold leaves vectors far from all codewords without any (measured: a
quarter of all pairs lost). Several codes with rotations of their own are used,
as many as random pairs at the least cosine need for all but one in 100,000 of
them to share a filter; see Caps. Vectors that are not alike hardly ever do.

1. Vectors of a label that share their best direction are dealt together, over
   a few salts, and gathered greedily to balls: up to BALL_ROWS vectors so near
   to the first that any two of them are linked. Most balls are one vector; a
   large group of near copies becomes a few.
2. A ball sends its members' filters, each once; balls that share one are a
   candidate pair.
3. Pairs meet the balls' heads (mean direction, radius): triangles on the sphere
   say that all pairs of vectors between them are linked, or none, or that it
   has to be looked at; two single vectors are compared right there.
4. Balls of the last kind meet member by member, in one matrix product.

Links are only counted, never listed; components are those of the balls.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, shuffle_width
from .simhash import components

MIN_COSINE = 0.93
#: Directions of each code that a vector is in, and the other vectors that all its filters hold, on average, for vectors in all directions.
CAP_LIST, STRANGERS = 8, 5
#: Share of random pairs at the least cosine that may have no common filter.
MISSED = 1e-5
#: Largest codebook of a block; beyond it the coordinates are cut into one more block.
MAX_CODEWORDS = 1024
BALL_ROWS, SALTS = 1024, 8
#: Filters for each partition of the join.
PARTITION_KEYS = 1 << 21
#: Angles (radians) nearer than this to a bound are looked at instead of trusted.
SLACK = 1e-6


class CapCode:
    """Directions for vectors of `dims` coordinates, `size` codewords for each of `blocks` blocks. Seeded, so that every task has the same ones."""

    def __init__(self, dims: int, size: int, blocks: int, seed: int) -> None:
        rng = np.random.default_rng([dims, seed])
        self.size, self.rotation = size, np.linalg.qr(rng.normal(size=(dims, dims)))[0]
        self.cuts = np.array_split(np.arange(dims), blocks)
        self.books = []
        for cut in self.cuts:
            book = rng.normal(size=(size, len(cut)))
            self.books.append((book / np.linalg.norm(book, axis=1, keepdims=True)).astype(np.float32))

    def nearest(self, unit: np.ndarray, k: int) -> np.ndarray:
        """(rows, at most k): the numbers of the directions with the largest inner products. The best k sums take only the best k codewords of each block."""
        turned = (unit @ self.rotation).astype(np.float32)
        total, code = np.zeros((len(unit), 1), np.float32), np.zeros((len(unit), 1), np.int64)
        for cut, book in zip(self.cuts, self.books, strict=True):
            products = turned[:, cut] @ book.T
            word = np.argpartition(-products, min(k, self.size) - 1, axis=1)[:, :k]
            total = (total[:, :, None] + np.take_along_axis(products, word, axis=1)[:, None, :]).reshape(len(unit), -1)
            code = (code[:, :, None] * self.size + word[:, None, :]).reshape(len(unit), -1)
            if total.shape[1] > k:
                best = np.argpartition(-total, k - 1, axis=1)[:, :k]
                total, code = np.take_along_axis(total, best, axis=1), np.take_along_axis(code, best, axis=1)
        return code


class Caps:
    """Codes that fit a table of n vectors and a least cosine.

    The number of directions grows with n, so that a vector meets as few
    strangers in a large table. It is halved where two vectors at the least
    cosine would share a filter of a code less often than not. The number of
    codes follows from how often random pairs do; nothing depends on the data
    but n and dims.
    """

    def __init__(self, dims: int, n: int, min_cosine: float) -> None:
        rng = np.random.default_rng(dims)
        x, z = (_unit(rng.normal(size=(1024, dims))) for _ in range(2))
        z = _unit(z - (z * x).sum(axis=1, keepdims=True) * x + 1e-12) if dims > 1 else x
        y = min_cosine * x + math.sqrt(1 - min_cosine**2) * z
        wanted = 8 * CAP_LIST**2 * n / STRANGERS
        while True:
            blocks = 1
            while blocks < max(1, dims // 2) and (blocks < 2 or wanted ** (1 / blocks) > MAX_CODEWORDS):
                blocks += 1
            size = max(2, math.ceil(wanted ** (1 / blocks)))
            code = CapCode(dims, min(size, MAX_CODEWORDS), blocks, 0)
            shared = float((code.nearest(x, CAP_LIST)[:, :, None] == code.nearest(y, CAP_LIST)[:, None, :]).any(axis=(1, 2)).mean())
            if shared >= 0.5 or wanted <= CAP_LIST:
                break
            wanted /= 2
        needed = 1 if shared > 1 - MISSED else math.ceil(math.log(MISSED) / math.log(1 - shared))
        self.codes = [code, *(CapCode(dims, code.size, blocks, seed) for seed in range(1, needed))]

    def best(self, unit: np.ndarray) -> np.ndarray:
        """The number of the direction of the first code nearest to each unit vector."""
        return self.codes[0].nearest(unit, 1)[:, 0]

    def filters(self, unit: np.ndarray) -> np.ndarray:
        """(rows, filters of each): hashes of all filters of each unit vector."""
        found = []
        for i, code in enumerate(self.codes):
            near = np.concatenate([code.nearest(unit[lo : lo + 256], CAP_LIST) for lo in range(0, len(unit), 256)])
            found.append(_mixed(near.astype(np.uint64) + np.uint64(i << 56)))
        return np.concatenate(found, axis=1)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijective hash of 64-bit numbers."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(maxsize=16)
def caps_for(dims: int, n: int, min_cosine: float) -> Caps:
    return Caps(dims, n, min_cosine)


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # squares of huge or tiny components stay finite
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _units(blobs, dims: int, width: str) -> np.ndarray:
    """Unit vectors, in double precision, of raw components."""
    return _unit(np.frombuffer(b"".join(blobs), width).reshape(-1, dims).astype(np.float64))


def _home_batches(n: int, min_cosine: float, width: str):
    """Each vector with its best direction. Components stay as wide as they came."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("vector")
            flat, ends = vectors.flatten().to_numpy(zero_copy_only=False), np.asarray(vectors.offsets) - vectors.offsets[0].as_py()
            sizes = np.diff(ends)
            home, blobs = np.zeros(len(sizes), np.int64), [flat[a:b].astype(width).tobytes() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            for dims in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == dims)
                home[at] = caps_for(dims, n, min_cosine).best(_units((blobs[i] for i in at.tolist()), dims, width))
            columns = [batch.column("vec_id"), batch.column("label"), pa.array(sizes, pa.int32()), pa.array(home), pa.array(blobs, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "dims", "home", "vector"])

    return run


class _Balls:
    """Open balls of one label and home, and finished ones."""

    def __init__(self, near: float, width: str) -> None:
        self.near, self.width = near, width
        self.next = TaskContext.get().partitionId() << 36  # the number of the next ball
        self.key, self.leaders, self.open, self.done = None, None, [], []

    def add(self, key: tuple, vec_id: int | None, blob: bytes) -> None:
        if key != self.key:
            self.flush()
            self.key, self.leaders = key, np.zeros((4, key[2]))
        vector = _units([blob], key[2], self.width)[0]
        found = self.leaders[: len(self.open)] @ vector
        at = int(found.argmax()) if len(found) else -1
        if at < 0 or found[at] < self.near:
            if len(self.open) == len(self.leaders):
                self.leaders = np.concatenate([self.leaders, np.zeros_like(self.leaders)])
            self.leaders[len(self.open)] = vector
            self.open.append([(vec_id, blob)])
            return
        ball = self.open[at]
        ball.append((vec_id, blob))
        if len(ball) == BALL_ROWS:  # finished; the last open ball takes its place
            self._close(ball)
            self.open[at], self.leaders[at] = self.open[-1], self.leaders[len(self.open) - 1]
            self.open.pop()

    def _close(self, ball: list) -> None:
        label, _, dims = self.key
        ids, blobs = zip(*ball, strict=True)
        head, radius = None, 0.0
        if len(ids) > 1:
            members = _units(blobs, dims, self.width)
            mean = _unit(members.sum(axis=0, keepdims=True))[0]
            head, radius = mean.tobytes(), float(np.arccos(np.clip(members @ mean, -1, 1)).max())
        known = [i for i in ids if i is not None]
        self.done.append((self.next, label, dims, len(ids), min(known) if known else None, radius, head, list(ids), b"".join(blobs)))
        self.next += 1

    def flush(self) -> None:
        for ball in self.open:
            self._close(ball)
        self.open = []

    def batches(self) -> Iterator[pa.RecordBatch]:
        rows, self.done = self.done, []
        for lo in range(0, len(rows), 1024):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[lo : lo + 1024], strict=True), BALLS.types, strict=True)], schema=BALLS)


BALLS = pa.schema(
    [("ball", pa.int64()), ("label", pa.string()), ("dims", pa.int32()), ("n", pa.int64()), ("least", pa.int64()), ("radius", pa.float64()), ("head", pa.binary()), ("ids", pa.list_(pa.int64())), ("members", pa.binary())]
)


def _ball_batches(min_cosine: float, width: str):
    near = math.cos(max(0.0, math.acos(min_cosine) / 2 - SLACK))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        balls = _Balls(near, width)
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("label", "home", "dims", "vec_id", "vector")]
            for label, home, dims, vec_id, blob in zip(*columns, strict=True):
                balls.add((label, home, dims), vec_id, blob)
            yield from balls.batches()
        balls.flush()
        yield from balls.batches()

    return run


def _filter_batches(n: int, min_cosine: float, width: str, parts: int):
    """The filters of balls, each once, in one row for each part of the join: 32 bits of the filter's hash, and the ball."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            balls, dims = (batch.column(c).to_numpy() for c in ("ball", "dims"))
            labels = np.array([xxhash.xxh64_intdigest(x.as_py()) for x in batch.column("label")], np.uint64)
            found = []
            for size in np.unique(dims).tolist():
                at = np.flatnonzero(dims == size)
                of = np.repeat(at, [len(batch.column("ids")[i]) for i in at.tolist()])
                keys = caps_for(size, n, min_cosine).filters(_units((batch.column("members")[i].as_py() for i in at.tolist()), size, width))
                keys = _mixed(keys ^ labels[of][:, None] + np.uint64(size))
                found.append(np.stack([np.repeat(of, keys.shape[1]).astype(np.uint64), keys.reshape(-1)], axis=1))
            if not found:
                continue
            pairs = np.unique(np.concatenate(found), axis=0)
            part = (pairs[:, 1] >> np.uint64(32)) % np.uint64(parts)
            order = np.argsort(part, kind="stable")
            numbers, starts = np.unique(part[order], return_index=True)
            rows = np.split(order, starts[1:])
            keys = pa.array([pairs[r, 1].astype("<u4").tobytes() for r in rows], pa.binary())
            owners = pa.array([balls[pairs[r, 0].astype(np.int64)].astype("<i8").tobytes() for r in rows], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(numbers.astype(np.int32)), keys, owners], ["part", "keys", "balls"])

    return run


def _pairs_of(keys: np.ndarray, balls: np.ndarray) -> Iterator[np.ndarray]:
    """Distinct pairs of balls that share a key, some at a time."""
    order = np.lexsort((balls, keys))
    keys, balls = keys[order], balls[order]
    held, step = [], 1
    alive = np.arange(len(keys))
    while len(alive):
        alive = alive[alive + step < len(keys)]
        alive = alive[keys[alive] == keys[alive + step]]
        held.append(np.stack([balls[alive], balls[alive + step]], axis=1))
        step += 1
        if sum(map(len, held)) > 1 << 20:
            held = [np.unique(np.concatenate(held), axis=0)]
            if len(held[0]) > 1 << 19:
                yield held.pop()
    if held:
        yield np.unique(np.concatenate(held), axis=0)


def _join_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of balls with a common filter; a partition holds whole parts."""
    keys, balls = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for batch in batches:
        for part, key, ball in zip(*(batch.column(c).to_pylist() for c in ("part", "keys", "balls")), strict=True):
            short = np.frombuffer(key, "<u4")
            keys.append(np.uint64(part) << np.uint64(32) | short.astype(np.uint64))
            balls.append(np.frombuffer(ball, "<i8"))
    for pairs in _pairs_of(np.concatenate(keys), np.concatenate(balls)):
        pairs = pairs[pairs[:, 0] != pairs[:, 1]]
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def _verdict_batches(min_cosine: float, width: str):
    """1 where all vectors of one ball are linked with all of the other, 2 where the members have to be looked at; pairs without a link go."""
    bound = math.acos(min_cosine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            verdict = np.zeros(batch.num_rows, np.int8)
            dims = batch.column("dims").to_numpy()
            radius = batch.column("radius_a").to_numpy() + batch.column("radius_b").to_numpy()
            single = [batch.column(f"n_{x}").to_numpy() == 1 for x in "ab"]
            for size in np.unique(dims).tolist():
                at = np.flatnonzero(dims == size)
                ends = []
                for x, alone in zip("ab", single, strict=True):
                    heads = np.zeros((len(at), size))
                    for some, kind in ((alone[at], width), (~alone[at], "<f8")):
                        heads[some] = _units((batch.column(f"head_{x}")[i].as_py() for i in at[some].tolist()), size, kind)
                    ends.append(heads)
                cosine = np.einsum("ij,ij->i", *ends)
                angle = np.arccos(np.clip(cosine, -1, 1))
                apart = np.where(angle - radius[at] > bound + SLACK, 0, np.where(angle + radius[at] < bound - SLACK, 1, 2))
                verdict[at] = np.where((single[0] & single[1])[at], cosine >= min_cosine, apart)
            out = pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("a", "b", "n_a", "n_b")), pa.array(verdict)], ["a", "b", "n_a", "n_b", "verdict"])
            yield out.filter(pa.array(verdict > 0))

    return run


def _member_batches(min_cosine: float, width: str):
    """For each member with links in the other ball: (ball, place, other ball, number of links)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, dims, ma, mb in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "dims", "members_a", "members_b")), strict=True):
                linked = _units([ma], dims, width) @ _units([mb], dims, width).T >= min_cosine
                for ball, other, counts in ((a, b, linked.sum(axis=1)), (b, a, linked.sum(axis=0))):
                    at = np.flatnonzero(counts)
                    columns = [pa.array(np.full(len(at), ball)), pa.array(at.astype(np.int32)), pa.array(np.full(len(at), other)), pa.array(counts[at].astype(np.int64))]
                    yield pa.RecordBatch.from_arrays(columns, ["ball", "place", "other", "links"])

    return run


def _usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", min_cosine: float = MIN_COSINE) -> DataFrame:
    """One row per row of vectors: vec_id, n_links, component_id, kept.

    Vectors are linked when their labels are equal and their cosine, in double
    precision, is min_cosine or more. A vector that is null, empty or zero, or
    has a null or non-finite component, and one without a label, is linked with
    nothing, and so are vectors of different lengths. n_links counts the other
    rows linked directly; a row that repeats another is a vector of its own.
    component_id is the smallest id reachable, itself included, null ids left
    out; kept says that it is the row's own id (or that both are null). Ids are
    read as long, components as double. Other columns are not read. No rows
    give no rows.

    No pair below min_cosine is linked. A linked pair is missed only when no
    vectors of their balls share a filter: one in 100,000 at exactly min_cosine,
    one in millions a little above it (Caps; measured in the tests).
    """
    if not 0 < min_cosine < 1:
        raise ValueError("min_cosine lies between 0 and 1")
    spark = vectors.sparkSession
    wide = "float" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "double"
    width = "<f4" if wide == "float" else "<f8"
    columns = [F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{label_col}`").cast("string").alias("label"), F.col(f"`{vector_col}`").cast(f"array<{wide}>").alias("vector")]
    rows = vectors.select(*columns)
    usable = F.col("label").isNotNull() & _usable(F.col("vector"))
    alone = rows.filter(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    used = rows.filter(usable)
    n = max(1024, 1 << (max(1, used.count()) - 1).bit_length())  # caps fit a power of two, so that a few rows more don't change them

    homes = used.mapInArrow(_home_batches(n, min_cosine, width), "vec_id long, label string, dims int, home long, vector binary")
    dealt = homes.repartition("label", "home", "dims", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS))).sortWithinPartitions("label", "home", "dims")
    schema = "ball long, label string, dims int, n long, least long, radius double, head binary, ids array<long>, members binary"
    balls = durable(dealt.mapInArrow(_ball_batches(min_cosine, width), schema), "cap-balls")

    parts = max(shuffle_width(spark), n * 8 * CAP_LIST // PARTITION_KEYS + 1)
    filters = balls.select("ball", "label", "dims", "ids", "members").mapInArrow(_filter_batches(n, min_cosine, width, parts), "part int, keys binary, balls binary")
    pairs = durable(filters.repartition(parts, "part").mapInArrow(_join_batches, "a long, b long").distinct(), "cap-pairs")

    heads = balls.select(F.col("ball").alias("a"), "dims", F.col("n").alias("n_a"), F.col("radius").alias("radius_a"), F.coalesce("head", "members").alias("head_a"))
    others = balls.select(F.col("ball").alias("b"), F.col("n").alias("n_b"), F.col("radius").alias("radius_b"), F.coalesce("head", "members").alias("head_b"))
    judged = durable(pairs.join(heads, "a").join(others, "b").mapInArrow(_verdict_batches(min_cosine, width), "a long, b long, n_a long, n_b long, verdict byte"), "cap-verdicts")
    inside = balls.select(F.col("ball").alias("a"), "dims", F.col("members").alias("members_a"))
    looked = judged.filter("verdict = 2").select("a", "b").join(inside, "a").join(balls.select(F.col("ball").alias("b"), F.col("members").alias("members_b")), "b")
    members = durable(looked.mapInArrow(_member_batches(min_cosine, width), "ball long, place int, other long, links long"), "cap-members")

    whole = judged.filter("verdict = 1")
    edges = whole.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(members.select(F.col("ball").alias("u"), F.col("other").alias("v")))
    whole = whole.select(F.col("a").alias("ball"), F.col("n_b").alias("links")).unionByName(whole.select(F.col("b").alias("ball"), F.col("n_a").alias("links"))).groupBy("ball").agg(F.sum("links").alias("whole"))
    roots = components(edges, "cap-components").withColumnRenamed("node", "ball")
    rooted = durable(balls.select("ball", "least").join(roots, "ball", "left").select("ball", F.coalesce("root", "ball").alias("root"), "least"), "cap-roots")
    least = durable(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "cap-names")
    named = rooted.join(least, "root").select("ball", "component_id")

    places = balls.join(whole, "ball", "left").join(named, "ball").select("ball", "n", "whole", "component_id", F.posexplode("ids").alias("place", "vec_id"))
    by_member = members.groupBy("ball", "place").agg(F.sum("links").alias("links"))
    n_links = F.col("n") - 1 + F.coalesce("whole", F.lit(0)) + F.coalesce("links", F.lit(0))
    linked = places.join(by_member, ["ball", "place"], "left").select("vec_id", n_links.cast("long").alias("n_links"), "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
    return linked.unionByName(alone)


ORACLE_SQL = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS r, vec_id, label, CAST(embedding AS DOUBLE[]) AS e,
    label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS usable
  FROM embeddings),
u AS (SELECT * FROM v WHERE usable),
links AS (SELECT a.r AS a, b.r AS b FROM u a JOIN u b ON a.label = b.label AND a.r <> b.r AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT r AS a, r AS b FROM v UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least AS (SELECT reach.a AS r, min(v.vec_id) AS component_id FROM reach JOIN v ON v.r = reach.b GROUP BY 1),
degree AS (SELECT a AS r, count(*) AS n FROM links GROUP BY 1)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept FROM v JOIN least USING (r) LEFT JOIN degree USING (r)
"""
