"""JSON pointers and type signatures against plain implementations."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import json_pointer as J
from lodestrata.operators import type_signatures as T


def plain(value, pointer):
    for token in J.tokens(pointer):
        if isinstance(value, list) and token.isdigit() and (token == "0" or token[0] != "0") and int(token) < len(value):
            value = value[int(token)]
        elif isinstance(value, dict) and token in value:
            value = value[token]
        else:
            return None
    return value


VALUES = [{"a": {"b": [1, {"c": "x"}]}, "": 5, "a/b": {"~x": [True, None]}, "0": "zero", "it's \"q\"": 1.5, "é k": []}, [1, [2, 3]], 7, "s", {"a": [], "01": 2}]
POINTERS = ["", "/a", "/a/b", "/a/b/1/c", "/a/b/0", "/a/b/2", "/", "/a~1b/~0x/0", "/0", "/1/1", "/it's \"q\"", "/é k", "/01", "/a/x/y"]


def test_pointers(spark):
    df = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(VALUES)], "id int, text string").withColumn("v", J.parsed(F.col("text")))
    got = df.select("id", *[F.to_json(J.at_pointer(F.col("v"), p)).alias(f"p{i}") for i, p in enumerate(POINTERS)]).collect()
    for row in got:
        for i, p in enumerate(POINTERS):
            want = plain(VALUES[row.id], p)
            assert (row[f"p{i}"] is None and want is None) or json.loads(row[f"p{i}"]) == want, (VALUES[row.id], p, row[f"p{i}"])


@pytest.mark.parametrize("pointer", ["a", "/~", "/a~2"])
def test_bad_pointers(pointer):
    with pytest.raises(ValueError):
        J.tokens(pointer)


def test_reasons_and_kinds(spark):
    texts = [None, "", "{", '{"a": 1,}', "[]", '{"a": 1}', '"x"', "1e3", "2", "true", "null", "// c\n1"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    got = {r.id: (r.reason, r.kind) for r in df.select("id", J.parse_reason(F.col("text"), F.lit("f")).alias("reason"), J.kind(J.parsed(F.col("text"))).alias("kind")).collect()}
    broken = ("cannot parse f", None)
    assert [got[i] for i in range(len(texts))] == [("no configuration: f", None), broken, broken, broken, (None, "array"), (None, "object"), (None, "string"), (None, "number"), (None, "number"), (None, "boolean"), (None, "null"), broken]


def slow(head, signatures):
    fits = []
    for i, s in enumerate(signatures):
        cells = [-1] * s.offset + T._cells(s)
        if len(head) >= len(cells) and all(c in (-1, b) for c, b in zip(cells, head, strict=False)):
            fits.append((-T.weight(s), i))
    return min(fits)[1] if fits else -1


def test_every_signature_and_noise():
    rng = random.Random(3)
    own = tuple(T.SIGNATURES)
    heads = [b"", b"\x00", b"PK\x03\x04" + b"x" * 60]
    for s in own:
        whole = bytes(c if c >= 0 else rng.randrange(256) for c in [-1] * s.offset + T._cells(s))
        heads += [whole, whole + b"tail", whole[:-1], bytes([whole[0] ^ 1]) + whole[1:]]
    assert T.kinds(heads, own).tolist() == [slow(h, own) for h in heads]


def test_random_signatures():
    rng = random.Random(5)
    for _ in range(100):
        own = tuple(T.Signature(str(i), rng.randrange(3), "".join(rng.choice(["00", "01", "02", "??"]) for _ in range(rng.randint(1, 4))) + rng.choice(["00", "01"])) for i in range(rng.randint(1, 6)))
        heads = [bytes(rng.randrange(3) for _ in range(rng.randint(0, 8))) for _ in range(60)]
        assert T.kinds(heads, own).tolist() == [slow(h, own) for h in heads]
