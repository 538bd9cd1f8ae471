"""Exact dedup by deterministic block naming.

Every normalised text is cut into fixed-size blocks. The distinct blocks are
sorted (by their first bytes, then by a hash) and a block's name is its place;
from then on a document is a string of integers, and each round sorts the
distinct adjacent pairs and names them by their places, halving that string,
until one integer is left. Two documents have the same (block count, integer)
exactly when their normalised texts are equal. Names depend on the set of
blocks only, not on how the data is dealt.

To name a block, its contents cross the network once, as a distinct
(pre-aggregated, so a block that half of the rows hold costs one row a task).
The names come back to the documents by a 128-bit hash of the block, and only
after that hash was seen to be injective on the very blocks it stands for;
else the next seed is tried. So equal names always mean equal contents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, squeezed

BLOCK_BYTES = 4096
#: Bytes of a block that sorting looks at before its hash.
HEAD_BYTES = 16
MAX_SEEDS = 16


def _block_keys(seed: int):
    return lambda b: F.struct(F.xxhash64(F.lit(2 * seed), b).alias("h1"), F.xxhash64(F.lit(2 * seed + 1), b).alias("h2"))


def _named(distinct: DataFrame, label: str, *order: str) -> DataFrame:
    """Rows of distinct with their place in the given order as name, from 0; written, so that a name never changes."""
    placed = durable(distinct.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()), label)
    # A place is a partition's number and a row's number in it; a partition's first name follows from the sizes of those before it.
    part, offset, offsets = F.shiftright("place", 33), 0, []
    for p, n in sorted(tuple(r) for r in placed.groupBy(part.alias("part")).count().collect()):  # a row for each partition
        offsets.append((p, offset - (p << 33)))
        offset += n
    first = F.broadcast(placed.sparkSession.createDataFrame(offsets, "part long, shift long"))
    return placed.join(first, part == F.col("part")).select(*distinct.columns, (F.col("place") + F.col("shift")).alias("name"))


def identities(keyed: DataFrame, blocks: DataFrame, seed: int) -> DataFrame | None:
    """(rid, n_blocks, name) of every row of keyed(rid, keys), or None if the seed's hash isn't injective on blocks(key, block)."""
    heads = durable(blocks.distinct().select(F.expr(f"substring(block, 1, {HEAD_BYTES})").alias("head"), "key.h1", "key.h2"), "block-heads")
    if not heads.groupBy("h1", "h2").count().filter("count > 1").isEmpty():
        return None
    named = _named(heads, "block-names", "head", "h1", "h2").select("h1", "h2", "name")
    longest = keyed.agg(F.max(F.size("keys"))).first()[0] or 0
    cells = keyed.select("rid", F.size("keys").alias("n_blocks"), F.posexplode("keys").alias("pos", "key")).select(
        "rid", "n_blocks", F.col("n_blocks").alias("left"), "pos", "key.h1", "key.h2"
    )
    current = cells.join(named, ["h1", "h2"]).select("rid", "n_blocks", "left", "pos", "name")
    done = []
    while longest > 1:
        current = durable(current, "block-round")
        done.append(current.filter("left = 1"))
        paired = (
            current.filter("left > 1")
            .groupBy("rid", "n_blocks", F.expr("cast(ceil(left / 2) as int)").alias("left"), F.expr("pos div 2").cast("int").alias("pos"))
            .agg(F.max(F.expr("if(pos % 2 = 0, name, null)")).alias("a"), F.coalesce(F.max(F.expr("if(pos % 2 = 1, name, null)")), F.lit(-1)).alias("b"))
        )
        current = paired.join(_named(paired.select("a", "b").distinct(), "pair-names", "a", "b"), ["a", "b"]).select("rid", "n_blocks", "left", "pos", "name")
        longest = -(-longest // 2)
    out = current.select("rid", "n_blocks", "name")
    for part in done:
        out = out.unionByName(part.select("rid", "n_blocks", "name"))
    return out


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after deleting spaces and the controls 9 to
    13. Of equal texts the row with the most code points in its original text
    stays, then that with the smallest doc_id (null last); of rows that repeat
    both, exactly one stays. Null and empty texts are one group. Other columns
    are not read, so their names can't clash. No rows give no rows.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return _grouped(rows, block_bytes).select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("rid") == F.col("best.rid")).alias("kept"), "text_sha256")


def _grouped(texts: DataFrame, block_bytes: int) -> DataFrame:
    """(rid, doc_id, text_sha256, group_size, best) of texts(rid, doc_id, text); best is the row that stays."""
    bare = F.col("bare")
    cut = texts.select("rid", "doc_id", F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"), squeezed(F.col("text")).cast("binary").alias("bare"))
    pieces = F.expr(f"transform(sequence(0, cast(greatest(octet_length(bare) - 1, 0) div {block_bytes} as int)), i -> substring(bare, i * {block_bytes} + 1, {block_bytes}))")
    for seed in range(MAX_SEEDS):
        key = _block_keys(seed)
        keyed = durable(cut.select("rid", "doc_id", "n_chars", F.sha2(bare, 256).alias("text_sha256"), F.transform(pieces, key).alias("keys")), "block-keys")
        blocks = cut.select(F.explode(pieces).alias("block")).select(key(F.col("block")).alias("key"), "block")
        names = identities(keyed.select("rid", "keys"), blocks, seed)
        if names is not None:
            break
    else:
        raise RuntimeError("no hash seed is injective on the blocks")
    rows = keyed.drop("keys").join(names, "rid")
    best = F.min(F.struct(-F.col("n_chars"), F.col("doc_id").isNull().alias("unnamed"), "doc_id", "rid")).alias("best")
    # Written, so that the join below has two plain shuffles, which Spark may split where one group holds many rows.
    groups = durable(rows.groupBy("n_blocks", "name").agg(F.count("*").alias("group_size"), best), "block-groups")
    return rows.join(groups, ["n_blocks", "name"])


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without the rows that exact_dedup drops, all columns kept: exactly one row of each group stays, whatever its id."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")  # so that no column of docs meets the number
    numbered = durable(docs.select(F.monotonically_increasing_id().alias("rid"), row), "numbered-rows")
    texts = numbered.select("rid", F.col(f"row.`{id_col}`").alias("doc_id"), F.col(f"row.`{text_col}`").alias("text"))
    gone = _grouped(texts, block_bytes).filter("rid != best.rid").select("rid")
    return numbered.join(gone, "rid", "left_anti").select("row.*")
