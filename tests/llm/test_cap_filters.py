"""Near-duplicate vectors against brute force."""

import math

import numpy as np
import pytest

from lodestrata.llm import cap_filters
from lodestrata.llm.cap_filters import Caps, _unit, near_vectors


def expected(rows, least=0.93):
    usable = [label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v, label in rows]
    linked = [[] for _ in rows]
    for i, (_, v, label) in enumerate(rows):
        for j, (_, w, other) in enumerate(rows):
            if i != j and usable[i] and usable[j] and label == other and len(v) == len(w):
                a, b = _unit(np.array([v], float))[0], _unit(np.array([w], float))[0]
                if a @ b >= least:
                    linked[i].append(j)
    out = []
    for i, (vec_id, *_) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in linked[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        root = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((vec_id, len(linked[i]), root, vec_id == root))
    return sorted(out, key=repr)


def got(df, **more):
    return sorted((tuple(r) for r in near_vectors(df, **more).collect()), key=repr)


def near(rng, center, noise):
    return (np.array(center) + noise * rng.normal(size=len(center))).astype(np.float32).tolist()


def table(seed, dims, n):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.normal(size=dims).astype(np.float32).tolist(), int(rng.integers(3))) for i in range(n)]
    for i in range(n // 2):  # groups of near copies, some of them just about linked
        _, center, label = rows[int(rng.integers(n // 4))]
        rows.append((1000 + i, near(rng, center, float(rng.choice([0.0, 0.05, 0.2, 0.27, 0.35]))), label))
    return rows


@pytest.mark.parametrize("dims", [64, 16])
def test_tables(spark, dims):
    rows = table(dims, dims, 300)
    zero, nan = [0.0] * dims, [float("nan")] + [1.0] * (dims - 1)
    ones = [1.0] * dims
    rows += [(5000, None, 1), (5001, zero, 1), (5002, nan, 1), (5003, [None, *ones[1:]], 1), (5004, [], 1), (5005, [float("inf"), *ones[1:]], 1)]
    rows += [(6000, ones, None), (6001, ones, None), (6002, ones, 2), (6003, [2.0] * dims, 2), (6004, [-1.0] * dims, 2), (6005, [1.0] * (dims - 1), 2), (6006, [1e30] * dims, 2), (6007, [1e-30] * dims, 2)]
    rows += [(None, ones, 2), (6002, ones, 2), (None, ones, 0)]  # a null id among others, a repeated row, a null id alone
    df = spark.createDataFrame([(*r, 1, 2, "x", "y") for r in rows], "vec_id long, embedding array<float>, label int, ball int, n int, members string, dims string")
    assert got(df.repartition(6)) == expected(rows)


def test_doubles_and_names(spark):
    rows = table(9, 32, 100)
    df = spark.createDataFrame([(r[0], [float(x) for x in r[1]], f"l{r[2]}") for r in rows], "`a.b` long, `c.d` array<double>, `e.f` string")
    assert got(df, id_col="a.b", vector_col="c.d", label_col="e.f", min_cosine=0.9) == expected(rows, 0.9)


def test_large_groups(spark, monkeypatch):
    monkeypatch.setattr(cap_filters, "BALL_ROWS", 16)
    rng = np.random.default_rng(1)
    center, other = rng.normal(size=64), rng.normal(size=64)
    rows = [(i, near(rng, center, 0.08), 1) for i in range(250)] + [(i, near(rng, other, 0.2), 1) for i in range(250, 400)] + [(i, [1.0] * 64, 1) for i in range(400, 600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert got(df.repartition(4)) == expected(rows)


def test_few_dimensions(spark):
    rows = table(4, 2, 60) + [(9000 + i, [float(i - 3)], 1) for i in range(7)]
    assert got(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")) == expected(rows)


def test_no_rows(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert got(spark.createDataFrame([], schema)) == []
    assert got(spark.createDataFrame([(1, None, 1)], schema)) == [(1, 0, 1, True)]


@pytest.mark.parametrize("dims, n", [(64, 1 << 16), (64, 1 << 24), (256, 1 << 12)])
def test_filters_are_shared(dims, n):
    """Of random pairs at exactly the least cosine, all but a few in 100,000 share a filter; strangers hardly ever do."""
    rng = np.random.default_rng(2)
    caps = Caps(dims, n, 0.93)
    x, z = (_unit(rng.normal(size=(4000, dims))) for _ in range(2))
    z = _unit(z - (z * x).sum(axis=1, keepdims=True) * x)
    a, b, c = caps.filters(x), caps.filters(0.93 * x + math.sqrt(1 - 0.93**2) * z), caps.filters(_unit(rng.normal(size=(4000, dims))))
    shared = [len(np.intersect1d(p, q)) for p, q in zip(a, b, strict=True)]
    assert sum(s == 0 for s in shared) <= 2
    assert sum(len(np.intersect1d(p, q)) > 0 for p, q in zip(a, c, strict=True)) <= 40
