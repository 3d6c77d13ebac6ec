"""Connected components of a table of links, as a distributed union-find."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.storage import checkpoint, let_go, written

#: Members of a group that its centre meets in one task.
BLOCK = 1024
#: Links that one task can finish, 16 bytes each; while there are more, rounds make them fewer.
LAST = 100_000


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id that is reachable from each id in links (a, b).

    Each round hooks every node below its smallest neighbour, jumps pointers
    until every node points at a root, and replaces the links by links between
    roots. Counts of links shrink each round, and no node's links meet in one task:
    the minimum is summed before the shuffle, and joins have a plain table on each side.
    The last links, at most LAST, are finished in one task.
    """
    links = checkpoint(links.where("a <> b").select("a", "b").distinct())
    pointer = None
    while True:
        if links.count() <= LAST:
            pointer = _moved(pointer, checkpoint(_finished(links)))
            return pointer.select("id", F.col("root").alias("component"))
        both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = checkpoint(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("id"), F.least("a", "least").alias("root")))
        while True:  # pointer jumping
            up = hook.select(F.col("id").alias("root"), F.col("root").alias("above"))
            jumped = checkpoint(hook.join(up, "root", "left").select("id", F.coalesce("above", "root").alias("to"), "root"))
            hook = jumped.select("id", F.col("to").alias("root"))
            if jumped.where("root <> to").isEmpty():
                break
        step = hook.select(F.col("id").alias("node"), F.col("root").alias("to"))
        pointer = _moved(pointer, hook)
        a, b = step.select(F.col("node").alias("a"), F.col("to").alias("ra")), step.select(F.col("node").alias("b"), F.col("to").alias("rb"))
        links = checkpoint(links.join(a, "a").join(b, "b").where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct())


def _moved(pointer: DataFrame | None, hook: DataFrame) -> DataFrame:
    """Pointers (id, root) after their roots have got roots (id, root) of their own."""
    if pointer is None:
        return hook
    step = hook.select(F.col("id").alias("node"), F.col("root").alias("to"))
    return checkpoint(pointer.join(step, pointer["root"] == step["node"], "left").select("id", F.coalesce("to", "root").alias("root")))


def _finished(links: DataFrame) -> DataFrame:
    """(id, root) of the nodes of a bounded number of links."""
    kind = links.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if held:
            a, b = (np.concatenate(side) for side in zip(*held, strict=True))
            nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
            root = nodes[forest(len(nodes), at[: len(a)], at[len(a) :])]
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(root)], ["id", "root"])

    return links.select("a", "b").coalesce(1).mapInArrow(run, f"id {kind}, root {kind}")


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node reachable from each of n nodes over the links a-b, for a bounded block."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            return root
        root = new[root]


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Components (id, component) when links (a, b) join labels (id, component); only the links between components are followed."""
    side = lambda c: labels.select(F.col("id").alias(c), F.col("component").alias(f"{c}_component"))
    between = links.join(side("a"), "a", "left").join(side("b"), "b", "left").select(F.coalesce("a_component", "a").alias("a"), F.coalesce("b_component", "b").alias("b"))
    step = components(between)
    to = step.select(F.col("id").alias("component"), F.col("component").alias("to"))
    moved = labels.join(to, "component", "left").select("id", F.coalesce("to", "component").alias("component"))
    return written(moved.unionByName(step.join(labels, "id", "left_anti")))


def link_groups(links: DataFrame, pairs: DataFrame, members: DataFrame, verify: Callable[[DataFrame], DataFrame], rest_pairs: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Components (id, component) over known links (a, b), candidate pairs (a, b), and groups (part, id) in which any two may be linked.

    verify gives the linked ones (a, b) of pairs (a, b, block). A group is first checked against
    its smallest member, so a large group of copies stays linear. Where several components are
    left in it, some member of the largest one, chosen by a hash, then meets the members of all others, which joins
    large components that few links hold together. Such centres meet their
    members in blocks of at most BLOCK a group, so no task has all of them. rest_pairs makes
    the candidate pairs (a, b) of members (id, component) of groups that still hold several components.
    """
    members = written(members.distinct())
    block = F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / BLOCK)).cast("int")
    centre = checkpoint(members.groupBy("part").agg(F.min("id").alias("a"), F.count("*").alias("n")))
    stars = members.join(centre, "part").where("a <> id").select("a", F.col("id").alias("b"), block.alias("block"))
    pairs = pairs.select("a", "b", F.lit(0).alias("block")).unionByName(stars).groupBy("a", "b").agg(F.min("block").alias("block"))
    joined = components(written(links.unionByName(verify(written(pairs)))))
    let_go(members.sparkSession)
    if members.isEmpty():
        return joined

    def mixed(members: DataFrame, labels: DataFrame) -> DataFrame:
        """(part, id, component, n) of the groups of n members that hold several components."""
        own = members.select("part", "id").join(labels, "id", "left").select("part", "id", F.coalesce("component", "id").alias("component"))
        several = own.groupBy("part").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n")).where("low <> high")
        return written(own.join(several.drop("low", "high"), "part"))

    left = mixed(members, joined)
    if left.isEmpty():
        return joined
    most = left.groupBy("part", "component").agg(F.count("*").alias("times"), F.min(F.struct(F.xxhash64("id"), "id")).alias("any"))
    most = most.groupBy("part").agg(F.max(F.struct("times", "component", "any.id")).alias("most"))
    stars = left.join(most, "part").where("component <> most.component").select(F.col("most.id").alias("a"), F.col("id").alias("b"), block.alias("block"))
    joined = merged(joined, verify(written(stars.groupBy("a", "b").agg(F.min("block").alias("block")))))
    let_go(members.sparkSession)
    rest = written(mixed(left, joined).select("id", "component").distinct())
    if rest.isEmpty():
        return joined
    pairs = written(rest_pairs(rest).withColumn("block", F.lit(0)))
    let_go(members.sparkSession)
    return merged(joined, verify(pairs))


def with_sides(pairs: DataFrame, known: DataFrame, columns: list[str]) -> DataFrame:
    """pairs (a, b, block) with the columns of both sides from known (id, ...) as a_.. and b_..; a's go once to each of its blocks."""
    side = lambda c: known.select(F.col("id").alias(c), *[F.col(x).alias(f"{c}_{x}") for x in columns])
    blocks = pairs.select("a", "block").distinct().join(side("a"), "a")
    return pairs.join(side("b"), "b").join(blocks, ["a", "block"])
