"""Path trees as rows: every folder's place in a walk, its subtree's size and digest, and what differs between two trees.

A node is a prefix of a path: (repo_id, names), names being the array of its
segments. Arrays compare name by name, bytewise, which is the order in which a
sorted depth-first walk meets the nodes; with the depth in front it is that of
a breadth-first walk, as folders are queued in the order they are met. So a
place is a place in an order, and no repository has to be walked by one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..limits import DEFAULT
from ..storage import durable, work_dir
from .ranges import places

#: Digests are sums over a subtree's leaves of this many numbers of 60 bits, parts of each leaf's SHA-256.
LANES = 4


def segments(path: Column) -> Column:
    """The names of a path; empty ones don't count."""
    return F.filter(F.split(path, "/"), lambda x: x != "")


def nodes(leaves: DataFrame) -> DataFrame:
    """All nodes above and including the leaves of leaves(repo_id, names), once each: repo_id, names, depth (1 below the root), leaves, children.

    leaves counts the distinct leaf paths in the node's subtree, itself
    included. A leaf may be a folder of others as well. Each leaf sends its
    prefixes, which are summed before they move, so a folder may have any
    number of entries.
    """
    distinct = leaves.select("repo_id", "names").filter(F.size("names") > 0).distinct()
    prefix = distinct.select("repo_id", "names", F.explode(F.sequence(F.lit(1), F.size("names"))).alias("depth"))
    return prefix.groupBy("repo_id", F.slice("names", F.lit(1), F.col("depth")).alias("names"), "depth").agg(F.count("*").alias("leaves"))


def subtree_sizes(found: DataFrame) -> DataFrame:
    """nodes with size: how many nodes their subtree has, itself included."""
    inside = found.select("repo_id", F.explode(F.sequence(F.lit(1), F.size("names"))).alias("depth"), "names")
    sizes = inside.groupBy("repo_id", F.slice("names", F.lit(1), F.col("depth")).alias("names")).agg(F.count("*").alias("size"))
    return found.join(sizes, ["repo_id", "names"])


def walk_order(leaves: DataFrame) -> DataFrame:
    """nodes with size and three places in their repository, from 1: walked breadth-first, before its children, and after its children.

    The place after all children follows from the place before them: those in
    front stay in front, the subtree comes too, and the folders above move back.
    """
    found = durable(subtree_sizes(durable(nodes(leaves), "tree-nodes")), "tree-sizes")
    before = places(found, ["repo_id"], ["names"], "before")
    walked = places(before, ["repo_id"], ["depth", "names"], "walked")
    return walked.withColumn("after", F.col("before") + F.col("size") - F.col("depth"))


def within_walk(walked: DataFrame, max_entries: int = DEFAULT.max_entries, max_depth: int = DEFAULT.max_depth) -> tuple[DataFrame, DataFrame]:
    """(entries that a bounded walk meets, reasons): folders at max_depth are met but not opened; the walk ends with entry max_entries.

    Entries below a closed folder don't count, so the others move up.
    """
    deep = walked.filter((F.col("depth") == max_depth + 1) & (F.col("size") > 1))
    reached = walked.filter(F.col("depth") <= max_depth + 1)  # a breadth-first walk meets deeper ones last
    kept = reached.filter(F.col("walked") <= max_entries)
    path = F.array_join("names", "/")
    text = F.concat(F.lit(f"maximum directory depth {max_depth} reached at "), path)
    reasons = deep.filter(F.col("walked") <= max_entries).select("repo_id", text.alias("reason"))
    over = reached.groupBy("repo_id").agg(F.max("walked").alias("n")).filter(F.col("n") > max_entries).select("repo_id", F.lit(f"maximum entry count {max_entries} reached").alias("reason"))
    return kept, reasons.unionByName(over)


def digests(leaves: DataFrame) -> DataFrame:
    """The tree of leaves(repo_id, names, digest): repo_id, depth (0 for the root), names, leaves, own, tree.

    own is the digest of a leaf at the node itself, else null; tree stands for
    all leaves of the subtree with their paths. It is the number and the sums of
    four 60-bit parts of each leaf's SHA-256, which are added before they move:
    a folder with a third of all rows sends a row a task. Leaves are distinct.
    """
    hashed = F.sha2(F.concat_ws("/", F.lit("leaf"), F.array_join("names", "/"), F.col("digest")), 256)
    lanes = [F.conv(F.substring("h", 15 * i + 1, 15), 16, 10).cast("decimal(20, 0)").alias(f"lane{i}") for i in range(LANES)]
    keyed = leaves.select("repo_id", "names", "digest", hashed.alias("h")).select("repo_id", "names", "digest", *lanes)
    at = keyed.select("*", F.explode(F.sequence(F.lit(0), F.size("names"))).alias("depth"))
    own = F.max(F.when(F.col("depth") == F.size("names"), F.col("digest"))).alias("own")
    summed = at.groupBy("repo_id", "depth", F.slice("names", F.lit(1), F.col("depth")).alias("node")).agg(F.count("*").alias("leaves"), own, *[F.sum(f"lane{i}").alias(f"lane{i}") for i in range(LANES)])
    tree = F.sha2(F.concat_ws(":", F.col("leaves"), *[F.col(f"lane{i}") for i in range(LANES)]), 256)
    return summed.select("repo_id", "depth", F.col("node").alias("names"), "leaves", "own", tree.alias("tree"))


def stored_by_depth(tree: DataFrame, label: str) -> DataFrame:
    """A tree of digests as a table with a folder for each depth, so that a level is read alone."""
    import uuid

    path = f"{work_dir(tree.sparkSession)}/{label}-{uuid.uuid4().hex}"
    tree.repartition("depth", F.pmod(F.xxhash64("names"), F.lit(64))).write.partitionBy("depth").parquet(path)
    return tree.sparkSession.read.schema(tree.schema).parquet(path).select(*tree.columns)


def tree_changes_by_descent(head: DataFrame, base: DataFrame) -> tuple[DataFrame, list[int]]:
    """(changes, nodes compared on each level) between two trees of digests: repo_id, names, change (added, removed, changed).

    From the roots down, only the entries of folders whose digests differ are
    looked at, so what is joined grows with the change, not with the tree.
    """
    keys = ["repo_id", "names"]
    compared, changes, depth, frontier = [], None, 0, None

    def level(tree: DataFrame, side: str) -> DataFrame:
        rows = tree.filter(F.col("depth") == depth)
        if frontier is not None:
            rows = rows.withColumn("parent", F.slice("names", 1, depth - 1) if depth > 1 else F.expr("slice(names, 1, 0)"))
            rows = rows.join(frontier.withColumnRenamed("names", "parent"), ["repo_id", "parent"], "left_semi")
        return rows.select(*keys, F.col("own").alias(f"{side}_own"), F.col("tree").alias(f"{side}_tree"))

    while True:
        both = durable(level(head, "head").join(level(base, "base"), keys, "full"), "tree-level")
        differ = both.filter(~F.col("head_tree").eqNullSafe(F.col("base_tree")))
        own = differ.filter(~F.col("head_own").eqNullSafe(F.col("base_own")))
        change = F.when(F.col("base_own").isNull(), "added").when(F.col("head_own").isNull(), "removed").otherwise("changed")
        found = own.select(*keys, change.alias("change"))
        changes = found if changes is None else changes.unionByName(found)
        compared.append(both.count())
        frontier = differ.select(*keys)
        depth += 1
        if compared[-1] == 0 or frontier.isEmpty():
            return changes, compared
