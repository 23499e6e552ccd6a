"""Connected components of a distributed edge list.

Every task first contracts its own edges to a spanning forest. If what is left is few edges, which is counted, one task ends
the job; else alternating large-star and small-star rounds go on until it is, or nothing changes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.llm.common import new_path, remove_path, session, spread_join, written

#: Edges that one task holds at most.
EDGES = 1 << 20


def contracted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of some edges and the smallest node that each is connected with, without the smallest ones themselves."""
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inverse[: len(a)], inverse[len(a) :]
    label = np.arange(len(nodes))
    while True:
        before, low = label.copy(), np.minimum(label[x], label[y])
        np.minimum.at(label, before[x], low)
        np.minimum.at(label, before[y], low)
        while (label[label] != label).any():
            label = label[label]
        if (label == before).all():
            break
    own = label != np.arange(len(nodes))
    return nodes[own], nodes[label[own]]


def _forest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A spanning forest of a task's edges, piece by piece."""
    held, size = [], 0

    def contract() -> tuple[np.ndarray, np.ndarray]:
        return contracted(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]))

    for pdf in frames:
        held.append((pdf["a"].to_numpy(dtype=np.int64), pdf["b"].to_numpy(dtype=np.int64)))
        size += len(pdf)
        if size >= EDGES:
            held = [contract()]
            size = len(held[0][0])
            if size >= EDGES // 2:
                yield pd.DataFrame({"a": held[0][0], "b": held[0][1]})
                held, size = [], 0
    if held:
        a, b = contract()
        yield pd.DataFrame({"a": a, "b": b})


def _whole(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """All edges in one piece: for counted edges only."""
    every = [(pdf["a"].to_numpy(dtype=np.int64), pdf["b"].to_numpy(dtype=np.int64)) for pdf in frames]
    if every:
        node, root = contracted(np.concatenate([x for x, _ in every]), np.concatenate([x for _, x in every]))
        yield pd.DataFrame({"node": node, "root": root})


def _large_star(e: DataFrame) -> DataFrame:
    s = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    m = written(s.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("__n")).select("a", F.least("a", "m").alias("m"), "__n"), "centres")
    return spread_join(s.where("b > a"), m, ["a"], F.col("b")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    o = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    m = written(o.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("__n")), "centres")
    rest = spread_join(o, m, ["a"], F.col("b")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return rest.union(m.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame, most: int = EDGES) -> DataFrame:
    """edges: a, b (bigint). Returns node, root: each node that has an edge, the smallest node of its component apart.

    Every round is written to the shared folder, so that a lost executor costs one round at most. A star's centre is
    pre-aggregated, and the edges of a very large star are spread over several tasks (spread_join). Edges from a node to
    itself are left out; an empty table gives an empty result; a repeated edge counts once. The root itself gets no row.
    """
    spark = session(edges)
    path = new_path(spark, "edges")
    e = written(edges.where("a <> b").select("a", "b").mapInPandas(_forest, "a bigint, b bigint"), "edges", path)
    known = None
    while True:
        state = e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state[0] <= most:
            return written(e.coalesce(1).mapInPandas(_whole, "node bigint, root bigint"), "roots")
        if state == known:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        known = state
        to = new_path(spark, "edges")
        e = written(_small_star(_large_star(e)), "edges", to)
        remove_path(spark, path)
        path = to
