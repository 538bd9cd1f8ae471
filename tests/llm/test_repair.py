"""Conversation repair against brute force."""

import hashlib
import heapq
import itertools
import re
import zlib

import pytest

from lodestrata.llm.conversation_repair import NEXT, ROLES, repair_conversations, solve

SCHEMA = "conv_id long, turn long, role string, text string"


def cheapest(signature):
    """The least (cost, audit) by searching all edits in order of cost, then audit."""
    heap, seen = [(0, "", 0, "")], set()
    while heap:
        cost, audit, i, before = heapq.heappop(heap)
        if (i, before) in seen:
            continue
        seen.add((i, before))
        if i == len(signature) and before in ("", "a"):
            return cost, audit
        heapq.heappush(heap, (cost + 3, audit + "I", i, NEXT[before]))
        if i < len(signature):
            letter = signature[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, before))
            if letter != "d":
                more, role = 3 if letter.isupper() else 0, letter.lower()
                if role == NEXT[before] or (role == "s" and before == ""):
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, role))
                heapq.heappush(heap, (cost + 3 + more, audit + "R", i + 1, NEXT[before]))


def damaged(row):
    conv, turn, role, text = row
    space = lambda x: " " if x is None else x
    kind = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
    role, text = space(role), space(text)
    text = {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
    return [] if kind == 0 else [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)


def expected(rows):
    found = {}
    for row in rows:
        found.setdefault(row[0], []).extend(damaged(row))
    out = {}
    for conv, lines in found.items():
        lines.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        seen, signature, counts = set(), "", {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in lines:
            visible, letter = re.sub(r"[\x20\x09-\x0D]", "", text), role[:1] if role[:1] in ("s", "u", "a") else "x"
            if not visible:
                counts["blank"], letter = counts["blank"] + 1, "d"
            elif (role, text) in seen:
                counts["duplicate"], letter = counts["duplicate"] + 1, "d"
            elif visible[-1] not in ".!?":
                counts["truncated"], letter = counts["truncated"] + 1, letter.upper()
            seen.add((role, text))
            signature += letter
        turns = [t for t, _, _ in lines if t is not None]
        cost, audit = cheapest(signature)
        repaired, before, rest = [], "", iter(lines)
        for edit in audit:
            role, text = ("", "") if edit == "I" else next(rest)[1:]
            if edit != "D":
                role = role if edit == "K" else ROLES[NEXT[before]]
                before = role[:1]
                repaired.append(f"{role}:{text}")
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            *counts.values(),
            sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(lines)),
            cost,
            audit,
            hashlib.sha256("\n".join(repaired).encode()).hexdigest(),
        )
    return out


def got(df):
    rows = repair_conversations(df).collect()
    found = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in rows}
    assert len(found) == len(rows)
    return found


@pytest.mark.parametrize("length", range(5))
def test_every_short_signature(length):
    for letters in itertools.product("suaxSUAd", repeat=length):
        assert solve("".join(letters)) == cheapest("".join(letters))


def test_long_signature():
    cost, audit = solve("ua" * 30000 + "d")
    assert (cost, audit) == (4, "K" * 60000 + "D")


def test_table_of_all_cases(spark):
    texts = ["Fine.", "cut off", "", " \t\n", "Why?! ", "Fine.", "é", None, "end. "]
    roles = ["user", "assistant", "system", "tool", None, "", "User"]
    rows = [(c if c else None, None if (c * t) % 13 == 5 else t // 2 * 3, roles[(c * 3 + t * t) % 7], texts[(c + t * 5) % 9]) for c in range(120) for t in range(c % 9)]
    rows += rows[::7]  # repeated rows
    df = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA + ", kind int, key string, audit string")  # names that the operator uses itself
    assert got(df.repartition(5)) == expected(rows)


def test_long_and_hot_conversation(spark):
    rows = [(1, t, ("user", "assistant")[t % 2], f"text {t % 700}.") for t in range(6000)] + [(c, 0, "user", "same.") for c in range(2, 300)]
    assert got(spark.createDataFrame(rows, SCHEMA).repartition(7)) == expected(rows)


def test_no_rows(spark):
    assert got(spark.createDataFrame([], SCHEMA)) == {}


def test_all_dropped(spark):
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert got(spark.createDataFrame([(conv, 0, "user", "Hi.")], SCHEMA)) == {conv: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
