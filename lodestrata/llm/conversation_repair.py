"""Repair of damaged conversations by signature.

What the cheapest repair of a conversation is depends only on its rows' role
initials and faults, not on its texts. A row is one letter of the signature:
its role initial (s, u, a, or x for any other), upper case when it is
truncated, or d when it has to go. Conversations have few distinct signatures,
so each is solved once, by recursion over (row, role before) with a memo, and
the audit (the letters of the edits in order) is joined back and replayed.

1. Rows are sorted by conversation and turn; a stream over them gives
   signatures and counts.
2. Distinct signatures are solved. The join back deals signatures that very
   many conversations have over several keys.
3. Each audit is sorted to the front of its conversation's rows, and a second
   stream replays it.

A conversation passes one task, as its digest is one hash, but it is never held
there: what stays in memory is a letter and a 16-byte hash for each row.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable
from .heavy import dealt, heavy_hashes

#: Costs of edits: a row kept, given another role, deleted, and a row inserted; what a truncated row adds that isn't deleted.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: The role that has to follow each: before the first row, after system, user and assistant.
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}
ROLES = {"u": "user", "a": "assistant"}
#: Rows from one stop of the recursion to the next, which bounds its depth.
STRIDE = 200
#: Turns in a batch that a stream sends.
BATCH = 4096


def damage(conversations: DataFrame) -> DataFrame:
    """The damage of the contract: conv_id, turn, role, text after it. A row is dropped, emptied, stripped of [.!?], repeated, given role user or left alone by crc32 of "conv_id:turn" modulo 20; null counts as one space in the key, as role and as text."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    rows = conversations.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"), (F.crc32(key.cast("binary")) % 20).alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.filter("kind <> 0").select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(times).alias("time")).drop("time")


def solve(signature: str) -> tuple[int, str]:
    """(cost, audit) of the cheapest edits that make the roles s?(ua)+ or nothing; of equally cheap audits the least."""
    n = len(signature)

    def steps(i: int, before: str) -> Iterator[tuple[str, int, str]]:
        """(row after, cost, role after) of each edit of row i, D before K before R."""
        letter = signature[i]
        yield "D", DELETE, before
        if letter == "d":
            return
        role, more = letter.lower(), TRUNCATED if letter.isupper() else 0
        if role == NEXT[before] or (role == "s" and before == ""):
            yield "K", KEEP + more, role
        yield "R", REROLE + more, NEXT[before]

    @functools.cache
    def least(i: int, before: str) -> int:
        """The least cost of rows i on, after a row of role `before`. Three rows in a row are never inserted: the third gives the role of the first."""
        found, inserted, role = [], 0, before
        for _ in range(3):
            if i == n:
                if role in ("", "a"):
                    found.append(inserted)
            else:
                found.extend(inserted + cost + least(i + 1, after) for _, cost, after in steps(i, role))
            inserted, role = inserted + INSERT, NEXT[role]
        return min(found)

    for i in range(n, -1, -STRIDE):
        for before in NEXT:
            least(i, before)
    cost, audit, i, before = least(0, ""), [], 0, ""
    left = cost
    while i < n or before not in ("", "a"):
        moves = [(letter, c, i + 1, after) for letter, c, after in (steps(i, before) if i < n else ())]
        moves.append(("I", INSERT, i, NEXT[before]))
        letter, c, i, before = min(m for m in moves if m[1] + least(m[2], m[3]) == left)
        left -= c
        audit.append(letter)
    return cost, "".join(audit)


def _solve_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        solved = [solve(s) for s in batch.column("signature").to_pylist()]
        columns = [*batch.columns, pa.array([c for c, _ in solved], pa.int64()), pa.array([a for _, a in solved], pa.string())]
        yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "cost", "audit"])


class _Reading:
    """One conversation while its rows pass."""

    def __init__(self, key: bytes, conv_id: int | None) -> None:
        self.key, self.conv_id = key, conv_id
        self.signature, self.seen = bytearray(), set()
        self.turns, self.first, self.last, self.turn = 0, None, None, None
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.before: str | None = None

    def add(self, turn: int | None, role: str, text: str, end: str) -> None:
        """end is the last visible character of text; empty if there is none."""
        if turn is not None and turn != self.turn:
            self.first, self.last, self.turn, self.turns = turn if self.first is None else self.first, turn, turn, self.turns + 1
        if self.before is not None and self.before + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = role[:1]
        name = hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()
        letter = role[:1] if role[:1] in ("s", "u", "a") else "x"
        if not end:
            self.blank, letter = self.blank + 1, "d"
        elif name in self.seen:
            self.duplicate, letter = self.duplicate + 1, "d"
        elif end not in ".!?":
            self.truncated, letter = self.truncated + 1, letter.upper()
        self.seen.add(name)
        self.signature += letter.encode()

    def row(self) -> tuple:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return self.key, self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.signature.decode()


_READ = pa.schema(
    [("key", pa.binary()), ("conv_id", pa.int64())] + [(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal")] + [("signature", pa.string())],
)


def _sent(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def _read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Signatures and counts of conversations whose rows follow one another."""
    now, done = None, []
    for batch in batches:
        for key, conv_id, turn, role, text, end in zip(*(batch.column(c).to_pylist() for c in ("key", "conv_id", "turn", "role", "text", "end")), strict=True):
            if now is None or key != now.key:
                if now is not None:
                    done.append(now.row())
                now = _Reading(key, conv_id)
            if role is not None:  # else the row only says that there is such a conversation
                now.add(turn, role, text, end)
        if len(done) >= BATCH:
            yield _sent(done, _READ)
            done = []
    if now is not None:
        done.append(now.row())
    if done:
        yield _sent(done, _READ)


_TURNS = pa.schema([("key", pa.binary()), ("conv_id", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])


def _replay_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repaired rows of conversations, each behind its audit: place 0 stands for the conversation itself."""
    key, audit, at, place, before = None, "", 0, 0, ""
    out: list[tuple] = []
    for batch in batches:
        for row_key, conv_id, role, text, edits in zip(*(batch.column(c).to_pylist() for c in ("key", "conv_id", "role", "text", "audit")), strict=True):
            if row_key != key:
                key, audit, at, place, before = row_key, edits, 0, 0, ""
                out.append((key, conv_id, 0, None, None, None))
            else:
                edit, at = audit[at], at + 1
                if edit != "D":
                    kept = role if edit == "K" else ROLES[NEXT[before]]
                    place, before = place + 1, kept[:1]
                    out.append((key, conv_id, place, edit, kept, text))
            while at < len(audit) and audit[at] == "I":  # rows that are inserted before the next one
                place, before, at = place + 1, NEXT[before], at + 1
                out.append((key, conv_id, place, "I", ROLES[before], ""))
        if len(out) >= BATCH:
            yield _sent(out, _TURNS)
            out = []
    if out:
        yield _sent(out, _TURNS)


_DIGESTS = pa.schema([("key", pa.binary()), ("repaired_sha256", pa.string())])


def _digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the repaired `role:text` lines of each conversation."""
    key, digest, done = None, None, []
    for batch in batches:
        for row_key, place, role, text in zip(*(batch.column(c).to_pylist() for c in ("key", "place", "role", "text")), strict=True):
            if place == 0:
                if digest is not None:
                    done.append((key, digest.hexdigest()))
                key, digest = row_key, hashlib.sha256()
            else:
                digest.update(f"{chr(10) if place > 1 else ''}{role}:{text}".encode())
        if len(done) >= BATCH:
            yield _sent(done, _DIGESTS)
            done = []
    if digest is not None:
        done.append((key, digest.hexdigest()))
    if done:
        yield _sent(done, _DIGESTS)


def _key() -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).cast("binary")


def _rows(turns: DataFrame) -> DataFrame:
    visible = F.rtrim(F.regexp_replace("text", r"[\x09-\x0D]", " "))
    return turns.select(_key().alias("key"), "conv_id", "turn", "role", "text", F.when(F.col("role").isNotNull(), F.right(visible, F.lit(1))).alias("end"))


def audits(conversations: DataFrame, turns: DataFrame) -> DataFrame:
    """One row for each conv_id of conversations, about its rows in turns: key, conv_id, gaps, blank, duplicate, truncated, illegal, signature, cost, audit.

    turns has conv_id (read as long), turn, role and text, the last two never
    null. Its rows are taken by turn (null first), equal turns by role, then
    text, and last of all in any order, as such rows are equal.
    """
    nothing = F.lit(None).cast("string")
    named = conversations.select(F.col("conv_id").cast("long")).distinct().select("conv_id", F.lit(None).cast("long").alias("turn"), nothing.alias("role"), nothing.alias("text"))
    rows = _rows(turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(named))
    schema = "key binary, conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, signature string"
    read = durable(rows.repartition("key").sortWithinPartitions("key", F.asc_nulls_first("turn"), F.asc_nulls_first("role"), "text").mapInArrow(_read_batches, schema), "conversation-signatures")
    solved = durable(read.select("signature").distinct().mapInArrow(_solve_batches, "signature string, cost long, audit string"), "conversation-audits")
    hot = heavy_hashes(read, "signature")
    left, right = dealt(read, solved, ["signature"], hot, F.xxhash64("key"))
    return left.join(right, ["signature", "deal"]).drop("deal")


def repaired_turns(turns: DataFrame, audited: DataFrame) -> DataFrame:
    """The rows of turns after the edits of their conversation's audit: key, conv_id, place (from 1), edit (K, R or I), role, text; place 0 stands for the conversation."""
    rows = _rows(turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")).select("key", "conv_id", "turn", "role", "text", F.lit(None).cast("string").alias("audit"))
    heads = audited.select("key", "conv_id", F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), "audit")
    both = rows.unionByName(heads).repartition("key").sortWithinPartitions("key", F.asc_nulls_last("audit"), F.asc_nulls_first("turn"), "role", "text")
    return both.mapInArrow(_replay_batches, "key binary, conv_id long, place long, edit string, role string, text string")


def repair_conversations(conversations: DataFrame) -> DataFrame:
    """One row per conv_id of conversations after damage(): conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256, and signature.

    Null roles and texts are one space; rows with a null conv_id form one
    conversation, and null turns come first and count for no gap. Rows of equal
    turn are taken by role, then text; repeated rows are duplicates. A
    conversation without rows after damage has zeros, an empty audit and the
    hash of nothing. Other columns are not read. No rows give no rows.
    """
    turns = damage(conversations)
    audited = durable(audits(conversations, turns), "conversation-repairs")
    digests = repaired_turns(turns, audited).mapInArrow(_digest_batches, "key binary, repaired_sha256 string")
    return audited.join(digests, "key").select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256", "signature")
