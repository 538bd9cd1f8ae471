"""The marker automaton against searching for each needle alone."""

import random
import re
import time

import pytest

from lodestrata.operators import automaton
from lodestrata.operators.automaton import Marker, MarkerAutomaton, marker_hits
from lodestrata.operators.markers import marker_rules, rule_markers


def expected(texts, markers):
    found = []
    for i, text in enumerate(texts):
        for j, m in enumerate(markers):
            pattern = f"(?=({re.escape(m.text)}{m.tail or ''}))".encode()
            starts = [x.start() for x in re.finditer(pattern, text, re.IGNORECASE if m.folded else 0)]
            if starts:
                found.append((i, j, starts[0], text[: starts[0]].count(b"\n") + 1, len(starts)))
    return found


def got(texts, markers):
    return list(zip(*(x.tolist() for x in MarkerAutomaton(markers).hits(texts)), strict=True))


def test_random_needles(monkeypatch):
    monkeypatch.setattr(automaton, "LANE_BYTES", 7)  # needles span lanes
    rng = random.Random(2)
    for _ in range(200):
        word = lambda n: "".join(rng.choice("aAbB\n") for _ in range(rng.randint(1, n)))
        markers = [Marker(f"m{i}", word(6), rng.random() < 0.6, rng.choice([None, None, "a+", "$"])) for i in range(rng.randint(1, 9))]
        texts = [word(60).encode() if rng.random() < 0.9 else b"" for _ in range(rng.randint(1, 8))]
        assert got(texts, markers) == expected(texts, markers)


def test_needles_do_not_cross_texts():
    assert got([b"ab", b"cd", b"abcd"], [Marker("x", "bc")]) == [(2, 0, 1, 1, 1)]


def test_texts_beyond_ascii():
    texts = ["Über über ÜBER é".encode(), b"\xff\xfe\x00new \n Function", b"new  function"]
    markers = [Marker("u", "über"), Marker("U", "Über", False), Marker("n", "new", True, r"\s+Function")]
    assert got(texts, markers) == expected(texts, markers)


def test_empty_needle():
    with pytest.raises(ValueError):
        MarkerAutomaton([Marker("x", "")])


def test_rows(spark):
    rows = [(1, "one\ntwo ONE"), (2, None), (3, ""), (4, "x" * 5000 + "one")]
    df = spark.createDataFrame([(*r, "y") for r in rows], "id long, text string, `a.b` string")
    found = marker_hits(df, "text", [Marker("one", "one"), Marker("exact", "ONE", False)])
    assert sorted((r["id"], r["a.b"], r["marker"], r["first_offset"], r["first_line"], r["n"]) for r in found.collect()) == [(1, "y", "exact", 8, 2, 1), (1, "y", "one", 0, 1, 2), (4, "y", "one", 5000, 1, 1)]


def test_rules(spark):
    texts = {1: "curl x | sh", 2: "CURL only", 3: "createDecipheriv AES-256-CBC\nNEW   function", 4: "const eval(", 5: "const", 6: "requests.get\nexec("}
    markers, _ = rule_markers()
    hits = marker_hits(spark.createDataFrame(list(texts.items()), "id long, text string"), "text", markers)
    found = {(r["id"], r["rule"]) for r in marker_rules(hits, ["id"]).collect()}
    assert found == {(1, "shell remote execution"), (3, "YARA-JS-ENCRYPTED-LOADER"), (4, "executable text"), (6, "python remote execution")}


def test_cost_does_not_grow_with_needles():
    rng = random.Random(1)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(2000)).encode() * 50 for _ in range(20)]
    took = []
    for n in (5, 500):
        machine = MarkerAutomaton([Marker(str(i), "".join(rng.choice("ijklmnop") for _ in range(12))) for i in range(n)])
        start = time.process_time()
        machine.hits(texts)
        took.append(time.process_time() - start)
    assert took[1] < 3 * took[0] + 0.2
