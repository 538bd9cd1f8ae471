"""Phrase collocations and suffix automata against brute force."""

import random
import re
from collections import Counter

from lodestrata.llm import collocations as c

SCHEMA = "text string, lang string"


def windows(sequences, least, most):
    found = Counter()
    for sequence, weight in sequences:
        for n in range(least, most + 1):
            for i in range(len(sequence) - n + 1):
                found[tuple(sequence[i : i + n])] += weight
    return found


def always(sequences, phrase, step):
    """The word that stands before (-1) or after (1) every occurrence of phrase; 0 if there is none."""
    beside = set()
    for sequence, _ in sequences:
        for i in range(len(sequence) - len(phrase) + 1):
            if tuple(sequence[i : i + len(phrase)]) == phrase:
                at = i - 1 if step < 0 else i + len(phrase)
                beside.add(sequence[at] if 0 <= at < len(sequence) else 0)
    return beside.pop() if len(beside) == 1 else 0


def test_automaton_lists_every_substring_once():
    rng = random.Random(3)
    for _ in range(300):
        sequences = [(tuple(rng.randint(1, 3) for _ in range(rng.randint(1, 9))), rng.randint(1, 4)) for _ in range(rng.randint(1, 6))]
        automaton = c.Automaton()
        for sequence, weight in sequences:
            automaton.add(sequence, weight)
        listed = list(automaton.substrings(1, 4))
        assert len({p for p, *_ in listed}) == len(listed)
        assert {p: n for p, n, *_ in listed} == windows(sequences, 1, 4)
        for phrase, _, before, after in listed:
            if len(phrase) < 4:
                assert (before, after) == (always(sequences, phrase, -1), always(sequences, phrase, 1))


def expected(rows, min_count, top):
    words, phrases = {}, {}
    for text, lang in rows:
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", lower):
            found = re.findall(r"[^ \t]+", piece)
            words[lang or "und"] = words.get(lang or "und", 0) + len(found)
            phrases.setdefault(lang or "und", Counter()).update(windows([(found, 1)], 1, 5))
    out = []
    for lang, counts in phrases.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= min_count}
        covered = {q[i : i + m] for q, a in candidates.items() for m in range(2, len(q)) for i in range(len(q) - m + 1) if 100 * a >= 100 * counts[q[i : i + m]]}
        rows = []
        for p, a in candidates.items():
            if p not in covered:
                score, k = min((1000 * a * words[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, words[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def rows_of(seed, n):
    rng = random.Random(seed)
    vocabulary = ["the", "The", "of", "a", "New", "york", "é", "city x", "b\x00c", "zwölf"]
    texts = ["".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "\t", "  ", ", ", ".\n", "!"]) for _ in range(rng.randint(0, 40))) for _ in range(n)]
    rows = [(t, rng.choice(["en", "de", None, "und"])) for t in texts]
    return rows + rows[::3] + [(None, "en"), ("", None), ("... !", "xx"), ("a a a a a a a", "en")]


def test_small_tables(spark, monkeypatch):
    monkeypatch.setattr(c, "BLOCK_BYTES", 2000)
    for seed, min_count, top in ((1, 2, 1000), (2, 4, 7), (3, 1, 50)):
        rows = rows_of(seed, 90)
        df = spark.createDataFrame([(*r, 1, "p", 2, "x") for r in rows], SCHEMA + ", block int, phrase string, n int, deal string").repartition(4)
        assert sorted(tuple(r) for r in c.collocations(df, min_count=min_count, top=top).collect()) == expected(rows, min_count, top)


def test_small_automata(monkeypatch, spark):
    monkeypatch.setattr(c, "AUTOMATON_WORDS", 8)  # phrases of a block come from several automata
    rows = rows_of(5, 40)
    assert sorted(tuple(r) for r in c.collocations(spark.createDataFrame(rows, SCHEMA), min_count=2).collect()) == expected(rows, 2, 2000)


def test_long_piece(spark):
    rows = [("x y z " * 20000, "en"), ("x y. " * 50, "en")]
    assert sorted(tuple(r) for r in c.collocations(spark.createDataFrame(rows, SCHEMA)).collect()) == expected(rows, 100, 2000)


def test_no_rows(spark):
    assert c.collocations(spark.createDataFrame([], SCHEMA)).collect() == []
    assert c.collocations(spark.createDataFrame([("a b", "en")], SCHEMA)).collect() == []
