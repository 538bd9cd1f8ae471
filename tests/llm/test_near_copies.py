from __future__ import annotations

import random

import pytest

from corpus_pipeline import near_copies

SCHEMA = "doc_id long, text string, w string"


def shingle_set(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def plain_kept(rows):
    """Ids that stay, by comparing all pairs; ids are distinct."""
    sets = [shingle_set(t) for _, t, _ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = 0
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
                links += 1
    least = {}
    for i, (d, _, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted(least.values()), links


@pytest.mark.parametrize("seed", [1, 2])
def test_planted_near_copies_match_brute_force(spark, seed):
    rng = random.Random(seed)
    pool = [f"word{i}" for i in range(3000)]
    passage = [rng.choice(pool) for _ in range(60)]
    plain = [[rng.choice(pool) for _ in range(rng.randrange(50, 400))] for _ in range(60)]
    made = [list(x) for x in plain]
    for words in plain[:40]:  # from near to just below the limit
        for _ in range(4):
            copy = list(words)
            for _ in range(rng.randrange(1, max(2, len(words) // 35))):
                copy[rng.randrange(len(copy))] = rng.choice(["Edited", "é", rng.choice(pool)])
            made.append(copy[: len(copy) - rng.randrange(4)])
    chain = list(plain[50])
    for i in range(30):  # each is near to the one before only
        chain[i * 7 % len(chain)] = f"link{i}"
        made.append(list(chain))
    made += [passage + [rng.choice(pool) for _ in range(rng.randrange(3, 60))] for _ in range(90)]  # one passage, alike or not
    made += [[w.upper() for w in plain[3]], ["a"], ["A"], ["a", "b"], [], []]
    rng.shuffle(made)
    rows = [(i, " ".join(x), "w") for i, x in enumerate(made)]
    expected, links = plain_kept(rows)
    kept = near_copies(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert kept.columns == ["doc_id", "text", "w"]
    assert sorted(r.doc_id for r in kept.collect()) == expected
    assert links > 100 and len(expected) < len(rows) - 50


def test_pairs_beyond_two_bits_go(spark):
    from lodestrata.llm.simhash import fingerprint

    rng = random.Random(4)
    pool = [f"word{i}" for i in range(3000)]
    rows = []
    for i in range(40):
        words = [rng.choice(pool) for _ in range(120)]
        other = [*words[:60], "edit", *words[61:]]
        rows += [(2 * i, " ".join(words), "w"), (2 * i + 1, " ".join(other), "w")]
    far = sum((fingerprint(a[1].encode()) ^ fingerprint(b[1].encode())).bit_count() > 2 for a, b in zip(rows[::2], rows[1::2], strict=True))
    assert far > 10
    assert sorted(r.doc_id for r in near_copies(spark, spark.createDataFrame(rows, SCHEMA), "").collect()) == list(range(0, 80, 2))


def test_near_copies_edges(spark):
    text = " ".join(f"w{i}" for i in range(80))
    assert near_copies(spark, spark.createDataFrame([], SCHEMA), "").count() == 0
    rows = [(None, text, None), (5, text + " more", "w"), (5, text, "w"), (3, None, "w"), (9, "", "w"), (None, "alone", "k")]
    kept = near_copies(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert sorted((r.doc_id or 0, r.w) for r in kept) == [(0, "k"), (3, "w"), (5, "w")]


def test_sketches_never_tell_too_little():
    import numpy as np

    from lodestrata.llm.near_copies import most_shared, sketch

    rng = np.random.default_rng(3)
    for n, m, both in ((1, 1, 1), (300, 280, 250), (5000, 1200, 900), (40, 90_000, 30), (3, 3, 0)):
        shared = rng.integers(0, 1 << 63, both).astype(np.uint64)
        a, b = (np.unique(np.concatenate([shared, rng.integers(0, 1 << 63, size - both).astype(np.uint64)])) for size in (n, m))
        assert most_shared(sketch(a), sketch(b)) >= len(np.intersect1d(a, b))
    full = np.arange(1000, dtype=np.uint64)  # all in one slot
    assert most_shared(sketch(full), sketch(full)) == float("inf")
