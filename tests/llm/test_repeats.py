from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from lodestrata.llm.recompression import PIECE_WORDS, RecompressionStrategy, remove_repeated_words
from lodestrata.llm import repeats as R
from lodestrata.llm.repeats import remove_repeats
from lodestrata.llm.rolling import PIECE
from lodestrata.llm.suffix_dedup import SuffixArrayStrategy, longest_previous_factors, next_smaller, previous_smaller, remove_repeated_bytes, without_repeated_bytes

SCHEMA = "doc_id long, text string, carry string, block string, n_chars long"
WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(rows, width, tokens):
    """{row number: (n, removed, spans, kept)} by looking at every window."""
    cut = [tokens(t or "") for _, t in rows]
    key = [float("inf") if d is None else d for d, _ in rows]
    first = {}
    for k, x in sorted(zip(key, cut, strict=True), key=lambda p: p[0]):
        for s in range(len(x) - width + 1):
            first.setdefault(tuple(x[s : s + width]), k)
    out = []
    for k, x in zip(key, cut, strict=True):
        gone = set()
        for s in range(len(x) - width + 1):
            if first[tuple(x[s : s + width])] < k:
                gone.update(range(s, s + width))
        spans = sum(p - 1 not in gone for p in gone)
        out.append((len(x), len(gone), spans, [c for p, c in enumerate(x) if p not in gone]))
    return out


def corpus():
    rng = random.Random(11)
    alphabet = ["a ", "b ", "cc\t", "the ", "x\n", "é ", "😀 ", "word  "]
    base = ["".join(rng.choice(alphabet[: rng.randrange(1, 9)]) for _ in range(rng.randrange(0, 150))) for _ in range(10)]
    rows = [(i, t) for i, t in enumerate([None, "", " ", "a", "z" * 120, "z" * 60, "same " * 40, "same " * 14])]
    for i in range(70):
        x, y = rng.choice(base), rng.choice(base)
        rows.append((rng.randrange(100, 150), x[rng.randrange(0, len(x) + 1) :] + y[: rng.randrange(0, len(y) + 1)]))
    return [*rows, (None, base[0]), (None, base[1]), rows[-1], rows[-1]]


@pytest.mark.parametrize(("small", "hot"), [(False, None), (True, 1 << 20), (True, 4)])
def test_bytes_match_brute_force(spark, small, hot):
    rows = corpus()
    docs = spark.createDataFrame([(d, t, "c", "b", 1) for d, t in rows], SCHEMA)
    if small:  # many blocks and buckets
        found = remove_repeats(docs, SuffixArrayStrategy(), "doc_id", "text", ["doc_id"], with_text=False, block_bytes=200, part_bytes=2000, judged_bytes=500, hot_runs=hot)
        got = [(r.carry.doc_id, r.n_units, r.n_removed, r.n_spans, r.kept_sha256) for r in found.collect()]
    else:
        got = [tuple(r) for r in remove_repeated_bytes(docs).collect()]
    expected = [(d, n, gone, spans, hashlib.sha256(bytes(kept)).hexdigest()) for (d, _), (n, gone, spans, kept) in zip(rows, brute(rows, 50, str.encode), strict=True)]
    assert sorted(got, key=repr) == sorted(expected, key=repr)


@pytest.mark.parametrize("hot", [None, 4])
def test_words_match_brute_force(spark, hot):
    rows = corpus()
    docs = spark.createDataFrame([(d, t, "c", "b", 1) for d, t in rows], SCHEMA)
    if hot:
        found = remove_repeats(docs, RecompressionStrategy(), "doc_id", "text", ["doc_id"], with_text=False, block_bytes=200, part_bytes=2000, judged_bytes=500, hot_runs=hot)
        got = [(r.carry.doc_id, r.n_units, r.n_removed, r.kept_sha256) for r in found.collect()]
    else:
        got = [tuple(r) for r in remove_repeated_words(docs).collect()]
    expected = [(d, n, gone, hashlib.sha256(" ".join(kept).encode()).hexdigest()) for (d, _), (n, gone, _, kept) in zip(rows, brute(rows, 13, WORD.findall), strict=True)]
    assert sorted(got, key=repr) == sorted(expected, key=repr)


def phrase_blocks(words, n_blocks, per_block):
    """Blocks as _block_batches makes them, of texts that share one phrase and nothing else."""
    rng = random.Random(5)

    def around():
        return " ".join(f"{rng.getrandbits(40):x}" for _ in range(20))

    blocks, texts = [], []
    for b in range(n_blocks):
        ids = [b * per_block + i for i in range(per_block)]
        own = [f"{around()} {words} {around()}".encode() for _ in ids]
        texts += own
        none = np.zeros(per_block, np.int64)
        blocks.append(R.Texts(np.array(ids), np.arange(per_block), none, none + 1, none, np.cumsum([len(t) for t in own]), b"".join(own)).shut())
    return blocks, texts


def exchanged(strategy, blocks, n_parts, hot_runs):
    """(runs of each name that are judged under it, blocks of hot runs) of one level, without Spark."""
    sent = []
    for number, blob in enumerate(blocks):
        sent.append(R._send_names(strategy, True, n_parts)(pa.table({"block": [number], "docs": pa.array([blob], pa.binary())}), None))
    names = pa.concat_tables(sent)
    flags = pa.concat_tables([R._shared_names(hot_runs)(names.filter(pc.equal(names["part"], p))) for p in range(n_parts)])
    judged, hot = Counter(), []
    for number, blob in enumerate(blocks):
        made = R._send_runs(strategy, True, n_parts, strategy.finer() is not None)(pa.table({"block": [number], "docs": pa.array([blob], pa.binary())}), flags.filter(pc.equal(flags["block"], number)))
        for kind, held in zip(made["kind"].to_pylist(), made["held"].to_pylist(), strict=True):
            if kind == R.HOT:
                hot.append(held)
            elif kind == R.RUNS:
                for t in R._open_texts(held).texts():
                    runs = strategy.units([t]).runs()
                    judged.update(set(runs.name.tolist()))
    return judged, hot


@pytest.mark.parametrize(("strategy", "phrase"), [(SuffixArrayStrategy(), "all of these documents hold one phrase, just this one"), (RecompressionStrategy(rounds=0), "one two three four five six seven eight nine ten eleven")])
def test_a_phrase_of_all_documents_is_judged_in_small_groups(strategy, phrase):
    blocks, texts = phrase_blocks(phrase, 40, 50)
    whole, _ = exchanged(strategy, blocks, 4, 1 << 30)
    assert max(whole.values()) >= len(texts) * 0.3  # under one name without the split
    groups = 0
    while strategy and blocks:
        judged, blocks = exchanged(strategy, blocks, 4, 64)
        groups = max([groups, *judged.values()])
        strategy = strategy.finer()
    assert groups <= 128 and not blocks  # a power of two above the limit, or one run a block


@pytest.mark.parametrize("blind", [False, True])
def test_the_arrays_decide_alone(spark, blind):
    """Copies of whole texts, inside a block and across blocks, are removed by the arrays or not at all."""

    class Told(SuffixArrayStrategy):
        def earlier(self, texts, first, later):
            counts, *gone = SuffixArrayStrategy.earlier(self, texts, first, later)
            return counts, *(g & (not blind) for g in gone)

        def finer(self):
            return None

    rng = random.Random(8)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(300))
    rows = [(i, passage if i % 3 else passage[40:200] + str(i)) for i in range(60)]
    docs = spark.createDataFrame([(d, t, "c", "b", 1) for d, t in rows], SCHEMA)
    found = remove_repeats(docs.coalesce(2), Told(), "doc_id", "text", ["doc_id"], with_text=False, block_bytes=2000)
    got = {r.carry.doc_id: r.n_removed for r in found.collect()}
    assert got == {d: 0 if blind else gone for (d, _), (_, gone, *_) in zip(rows, brute(rows, 50, str.encode), strict=True)}


def test_text_form_keeps_columns_and_characters(spark):
    passage = "é" * 40
    rows = [(1, passage, "c", None, 40), (2, "x" + passage, None, "b", 41), (3, None, "c", "b", None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = without_repeated_bytes(docs)
    assert got.columns == docs.columns
    assert {tuple(r) for r in got.collect()} == {rows[0], (2, "x", None, "b", 1), rows[2]}


def test_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert remove_repeated_bytes(docs).count() == 0
    assert remove_repeated_words(docs).count() == 0


@pytest.mark.parametrize("strategy", [SuffixArrayStrategy(), RecompressionStrategy()])
def test_pieces_of_long_texts_name_windows_alike(strategy):
    rng = np.random.default_rng(4)
    unit = 6
    size = max(PIECE, PIECE_WORDS * unit) + 70_000
    long = b" ".join(rng.choice([b"alpha", b"betas", b"gamma", b"delta"], size // unit).tolist())
    short = long[PIECE - 3000 * unit : PIECE + 3000 * unit]
    units = strategy.units([long, short])
    runs = units.runs()
    covered = np.bincount(runs.doc, weights=runs.last - runs.first + 1)
    assert covered.tolist() == [n - strategy.window + 1 for n in units.counts.tolist()]
    names = {}
    for d, a, b, name in zip(*(x.tolist() for x in runs), strict=True):
        if d == 1 or abs(a * (1 if len(units.counts) and units.counts[0] == len(long) else unit) - PIECE) < 25_000:
            for s in range(a, b + 1):
                assert names.setdefault(units.text(d, s, s), name) == name


def test_smaller_neighbours_and_factors():
    rng = np.random.default_rng(2)
    for n in (1, 2, 7, 60):
        v, common = rng.integers(0, 5, n), rng.integers(0, 9, n)
        before = [max((j for j in range(i) if v[j] < v[i]), default=-1) for i in range(n)]
        after = [min((j for j in range(i + 1, n) if v[j] < v[i]), default=n) for i in range(n)]
        got, least = previous_smaller(v, common)
        assert got.tolist() == before and least.tolist() == [common[j + 1 : i + 1].min() if j >= 0 else 0 for i, j in enumerate(before)]
        got, least = next_smaller(v, common)
        assert got.tolist() == after and least.tolist() == [common[i + 1 : j + 1].min() if j < n else 0 for i, j in enumerate(after)]
    text = rng.integers(97, 99, 300).astype(np.uint8)
    text[200:260] = text[20:80]
    owners = np.sort(rng.integers(0, 9, 300))

    def shared(i, j, depth):
        return next((k for k in range(depth) if text[i + k] != text[j + k]), depth)

    for depth in (3, 8, 12, 16, 20, 33, 50):
        at = np.arange(300 - depth + 1)
        found = longest_previous_factors(text, owners[at], at, depth)
        assert found.tolist() == [max((shared(i, j, depth) for j in at if owners[j] < owners[i]), default=0) for i in at]
