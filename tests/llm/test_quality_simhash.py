from __future__ import annotations

import random
import re
from collections import Counter

import xxhash

from lodestrata.llm.quality_rules import FAILED, RULES, fit_accuracies, keep_quality, posterior, quality_rules, text_statistics
from lodestrata.llm.simhash import keep_one_of_each, simhash_components

WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, w string, kept string"


def plain_stats(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {p for i, x in enumerate(windows) if often[x] > 1 for p in range(i, i + 3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def texts(seed=5, n=150):
    rng = random.Random(seed)
    pool = ["a", "b", "the", "é", "😀x", "###", "end.", "word", "Σ"]
    gaps = [" ", "  ", "\n", "\t", "\x0b", "\x0c", "\r\n", "\n\n", "\x1f", "\xa0"]
    made = ["".join(rng.choice(pool[: rng.randrange(1, 10)]) + rng.choice(gaps) for _ in range(rng.randrange(0, 90))) for _ in range(n)]
    return [None, "", " ", "\n", "x", "a a a a", *made, "long " * 30000, made[-1], made[-1]]


def test_base_statistics_match_brute_force(spark):
    rows = [(i, t, "w", "k") for i, t in enumerate(texts())]
    got = {r.doc_id: r for r in quality_rules(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == len(rows)
    for i, t, *_ in rows:
        expected = plain_stats(t)
        assert tuple(got[i][1:6]) == expected, t
        assert got[i].base_failed == (expected[0] < 50 or 100 * expected[4] > 50 * expected[0])
        assert not (got[i].base_failed and got[i].kept)


def test_quality_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert quality_rules(empty).count() == 0
    assert keep_quality(empty).columns == ["doc_id", "text", "w", "kept"]
    prose = " ".join(f"Word{i} follows other{i * 7}." for i in range(100)) + "\nEnd here."
    rows = [(None, prose, None, "k"), (1, prose, "w", None), (1, prose, "w", None), (2, "### " * 200, "w", "k"), (3, None, "w", "k")]
    kept = keep_quality(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id or 0, r.w or "") for r in kept) == [(0, ""), (1, "w"), (1, "w")]


def test_em_learns_how_each_rule_votes():
    rng = random.Random(1)
    counts = Counter()
    hits = [0.9, 0.5, 0.6, 0.4]  # how often each of four rules knows junk; two classes need at least three such rules
    for _ in range(20000):
        clean = rng.random() < 0.9
        votes = [1 if clean or rng.random() >= h else -1 for h in hits]
        votes += [-1 if rng.random() < 0.03 else 1] + [0] * (len(RULES) - 5)  # noise, and rules that abstain
        counts[sum((v + 1) * 3**i for i, v in enumerate(votes))] += 1
    counts[FAILED] = 50_000  # texts that fail the base rules teach nothing
    share, (junk, good) = fit_accuracies(counts)
    assert abs(share - 0.9) < 0.01
    assert all(abs(junk[i][0] - h) < 0.05 and good[i][0] < 0.01 for i, h in enumerate(hits))
    assert abs(good[4][0] - 0.03) < 0.01 and abs(junk[4][0] - 0.03) < 0.03

    def chance(*votes):
        return posterior(sum((v + 1) * 3**i for i, v in enumerate([*votes, *[0] * (len(RULES) - 5)])), share, (junk, good))

    assert chance(-1, 1, 1, 1, 1) < 0.05 and chance(1, 1, 1, 1, -1) > 0.95 and chance(1, 1, 1, 1, 1) > 0.99
    assert fit_accuracies({})[0] == 0.9


def test_verdicts_agree_with_labels(spark):
    """Labels were not used in fitting."""
    folder = "/root/testdata/sf0.01"
    found = quality_rules(spark.read.parquet(f"{folder}/documents.parquet")).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").filter("not base_failed").collect()
    right = sum(r.kept == (r.quality == 1) for r in found)
    assert len(found) > 200 and right >= 0.98 * len(found)


def plain_fingerprint(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    prints = [plain_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return Counter((d, f"{prints[i]:016x}", least.get(find(i))) for i, (d, _) in enumerate(rows))


def test_components_match_brute_force(spark):
    rng = random.Random(3)
    base = [" ".join(rng.choice("alpha beta gamma delta eps zeta eta theta".split()) for _ in range(60)) for _ in range(15)]
    rows = [(i, t) for i, t in enumerate([None, "", "Ab", "aB", *base])]
    for i in range(250):
        words = rng.choice(base).split()
        words[rng.randrange(60)] = rng.choice(["x", "Y", "é"])
        rows.append((100 + i, " ".join(words)))
    rows += [(None, base[0]), (7, base[3]), (7, base[3])]
    docs = spark.createDataFrame([(d, t, "w", "k") for d, t in rows], SCHEMA)
    got = Counter(tuple(r) for r in simhash_components(docs).collect())
    assert got == plain_components(rows)
    kept = keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {c for _, _, c in plain_components(rows)}
    assert simhash_components(docs.limit(0)).count() == 0


def test_large_buckets_and_long_chains(spark):
    import numpy as np

    from lodestrata.llm.simhash import Forest, components, link_sorted

    rng = np.random.default_rng(0)
    for n in (90, 4000):
        prints = np.unique(rng.integers(0, 1 << 13, n)).astype(np.int64)
        forest = Forest()
        link_sorted(np.zeros(len(prints), np.int64), prints, forest, 2)
        links = [(a, b) for i, a in enumerate(prints.tolist()) for b in prints[i + 1 :].tolist() if (a ^ b).bit_count() <= 2]
        plain = Forest()
        plain.join(np.array([a for a, _ in links]), np.array([b for _, b in links]))
        assert all(forest.root(x) == plain.root(x) for x in prints.tolist())
    chain = spark.createDataFrame([(i, i + 1) for i in range(-40, 60)] + [(200, 201)], "u long, v long")
    assert {tuple(r) for r in components(chain).collect()} == {(i, -40) for i in range(-40, 61)} | {(200, 200), (201, 200)}


def test_statistics_leave_other_columns_alone(spark):
    names = ["w", "k", "lines", "pairs", "_t", "row", "n_words"]
    docs = spark.createDataFrame([("a b a b a b", *"1234567")], ["text", *names])
    row = text_statistics(docs).first()
    assert [row[c] for c in names[:-1]] == list("123456") and row.n_words == 6 and row.n_repeat_words == 6


def test_many_words_are_judged_by_their_windows(spark, monkeypatch):
    import lodestrata.llm.quality_rules as Q

    texts = [("a b c d " * 9,), ("a b c d e f",), ("x a b c y a b c z",), ("a a a a",)]
    docs = spark.createDataFrame(texts, "text string")
    plain = [r.n_repeat_words for r in text_statistics(docs).collect()]
    monkeypatch.setattr(Q, "_LOW", 1)
    assert [r.n_repeat_words for r in text_statistics(docs).collect()] == plain == [36, 0, 6, 4]
