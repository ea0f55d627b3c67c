"""Connected components of a graph of long-valued nodes.

Every round first contracts inside tasks: a task takes a bounded number of edges, joins them, and passes
on one edge per node, to the least node it can reach. As soon as all edges fit one such task the round is
the last. Larger graphs alternate this with star contraction (minima over neighbours), in which a hub's
edges are reduced before they are dealt out, and dealt to several tasks where they meet its minimum.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import looked_up, remove, stored, stored_at

#: Edges that a task contracts: 16 bytes each, and about eight times that while it works.
TASK_EDGES = 1_000_000


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """``edges`` (u, v) with the ``m`` of their u. A hub's edges are dealt to several tasks, each with its one row."""
    return looked_up(edges, stored(least, "least-neighbours"), ["u"])


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return _with_least(both.where("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = _with_least(down, least).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u <> v")


def local_components(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges, and the least node that each can reach."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        # lower the labels of both ends and of their present roots, then follow the labels to their end
        for x in (a, b, label[a], label[b]):
            np.minimum.at(new, x, low)
        while not np.array_equal(jumped := new[new], new):
            new = jumped
        if np.array_equal(new, label):
            return nodes, nodes[label]
        label = new


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(np.asarray(b.column(0)), np.asarray(b.column(1))) for b in batches]  # at most TASK_EDGES or so
    if held:
        node, least = local_components(*(np.concatenate(x) for x in zip(*held, strict=True)))
        keep = node != least
        yield pa.RecordBatch.from_arrays([pa.array(node[keep]), pa.array(least[keep])], names=["u", "v"])


def components(edges: DataFrame, task_edges: int = TASK_EDGES, rounds: int = 60) -> DataFrame:
    """``node, component`` of every node that has an edge; a component is named by its least node.

    ``edges``: two long columns. Loops and repeated edges do no harm, rows with a null are passed over,
    and no edges give no rows. What a round leaves is written to the shared folder.
    """
    spark = edges.sparkSession
    u, v = edges.columns
    edges = stored(edges.select(F.col(u).cast("long").alias("u"), F.col(v).cast("long").alias("v")).where("u is not null and v is not null and u <> v"), "edges")
    for _ in range(rounds):
        tasks = max(1, -(-edges.count() // task_edges))
        old, edges = edges, stored(edges.repartition(tasks).mapInArrow(_contract, "u long, v long"), "edges")
        if where := stored_at(old):
            remove(spark, where)
        if tasks == 1:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())
        starred = stored(_small_star(stored(_large_star(edges).distinct(), "edges")).distinct(), "edges")
        # stars that a further round would not change: every node once, and no centre is a leaf
        settled = starred.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").isEmpty() and starred.join(starred.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty()
        if settled and starred.count() == edges.count() and starred.exceptAll(edges).isEmpty():
            return starred.select(F.col("u").alias("node"), F.col("v").alias("component")).union(starred.select("v", "v").distinct())
        edges = starred
    raise RuntimeError(f"components did not settle in {rounds} rounds")
