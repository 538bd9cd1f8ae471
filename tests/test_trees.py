"""Walk orders and tree digests against plain walks."""

import random

from pyspark.sql import functions as F

from lodestrata.operators import trees

LEAVES = "repo_id string, path string"


def forest(seed, n):
    rng = random.Random(seed)
    return sorted({"/".join(rng.choice(["a", "b", "B", "é", "a b", "a.b", "zz"]) for _ in range(rng.randint(1, 5))) for _ in range(n)})


def walk(paths):
    """(breadth-first, before, after) places by walking folders."""
    children = {(): set()}
    for path in paths:
        names = tuple(path.split("/"))
        for i in range(len(names)):
            children.setdefault(names[:i], set()).add(names[: i + 1])
            children.setdefault(names[: i + 1], set())
    listed = {k: sorted(v, key=lambda x: x[-1].encode()) for k, v in children.items()}
    breadth, queue = [], [()]
    for node in queue:
        breadth += listed[node]
        queue += listed[node]
    before, after = [], []

    def visit(node):
        for child in listed[node]:
            before.append(child)
            visit(child)
            after.append(child)

    visit(())
    places = [{n: i for i, n in enumerate(order, 1)} for order in (breadth, before, after)]
    return {n: tuple(p[n] for p in places) for n in before}


def test_walk_order(spark):
    repos = {f"r{i}": forest(i, n) for i, n in enumerate((0, 1, 40, 300))}
    df = spark.createDataFrame([(r, p) for r, ps in repos.items() for p in ps] * 2, LEAVES).select("repo_id", trees.segments(F.col("path")).alias("names"))
    got = {}
    for r in trees.walk_order(df).collect():
        got.setdefault(r.repo_id, {})[tuple(r.names)] = (r.walked, r.before, r.after)
    assert got == {r: walk(ps) for r, ps in repos.items() if ps}


def test_bounded_walk(spark):
    df = spark.createDataFrame([("r", p) for p in ("a/b/c/d", "a/b/e", "f", "g/h", "i")], LEAVES).select("repo_id", trees.segments(F.col("path")).alias("names"))
    walked = trees.walk_order(df).cache()
    kept, reasons = trees.within_walk(walked, 100, 1)
    assert sorted("/".join(r.names) for r in kept.collect()) == ["a", "a/b", "f", "g", "g/h", "i"]
    assert [r.reason for r in reasons.collect()] == ["maximum directory depth 1 reached at a/b"]
    kept, reasons = trees.within_walk(walked, 5, 64)
    assert sorted("/".join(r.names) for r in kept.collect()) == ["a", "a/b", "f", "g", "i"]
    assert [r.reason for r in reasons.collect()] == ["maximum entry count 5 reached"]


def test_descent_finds_what_a_flat_comparison_finds(spark):
    rng = random.Random(4)
    head = {p: str(rng.randint(0, 9)) for p in forest(9, 400)}
    base = {p: d if rng.random() < 0.97 else d + "x" for p, d in head.items() if rng.random() < 0.98} | {"a/new": "1", "q/only/base": "2"}

    def tree(entries):
        rows = [("r", p, d) for p, d in entries.items()]
        return trees.stored_by_depth(trees.digests(spark.createDataFrame(rows, LEAVES + ", digest string").select("repo_id", trees.segments(F.col("path")).alias("names"), "digest")), "tree")

    changes, compared = trees.tree_changes_by_descent(tree(head), tree(base))
    got = {"/".join(r.names): r.change for r in changes.collect()}
    assert got == {p: "added" if p not in base else "removed" if p not in head else "changed" for p in head.keys() | base.keys() if head.get(p) != base.get(p)}


def test_equal_and_empty_trees(spark):
    rows = spark.createDataFrame([("r", p, "1") for p in forest(3, 200)], LEAVES + ", digest string").select("repo_id", trees.segments(F.col("path")).alias("names"), "digest")
    changes, compared = trees.tree_changes_by_descent(trees.digests(rows), trees.digests(rows.repartition(3)))
    assert changes.collect() == [] and compared == [1]  # the roots alone
    assert trees.walk_order(rows.limit(0)).collect() == []
    changes, _ = trees.tree_changes_by_descent(trees.digests(rows), trees.digests(rows.limit(0)))
    assert {r.change for r in changes.collect()} == {"added"} and changes.count() == rows.count()


def test_what_is_compared_grows_with_the_change(spark):
    entries = [("r", f"d{i % 40}/e{i % 400}/f{i}", "1") for i in range(4000)]
    changed = [(r, p, "2" if p.endswith("/f77") else d) for r, p, d in entries]
    build = lambda rows: trees.digests(spark.createDataFrame(rows, LEAVES + ", digest string").select("repo_id", trees.segments(F.col("path")).alias("names"), "digest"))
    changes, compared = trees.tree_changes_by_descent(build(changed), build(entries))
    assert [("/".join(r.names), r.change) for r in changes.collect()] == [("d37/e77/f77", "changed")]
    assert compared[:4] == [1, 40, 10, 10]
