"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetspark.storage import discard, written

# Its functions travel to the executors with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Edges that a task contracts at once.
CONTRACTED = 2_000_000


def components(edges: DataFrame, a: str = "a", b: str = "b", contract: bool = False) -> DataFrame:
    """(node, root) for each node of ``edges``; root is the least node that its edges lead to.

    Alternates large and small stars: every node hands its greater neighbours, then its lesser ones, to the least of them,
    so paths shrink by half and a round moves as many rows as there are edges. Each round is written to the shared folder.
    The least neighbour of a node of very many edges is found by partial aggregation; where it is joined back, adaptive
    execution splits the edges of such a node between tasks, as the other side is one row a node and the rows are shuffled
    again anyway. Loops and repeated edges are harmless; a null end drops the edge; no edges give no rows. Tables of past
    rounds are deleted. contract, for ends that are 64-bit numbers: partitions first contract their own edges to stars, in
    tasks and before anything is shuffled, which saves most of the rounds.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    if contract:
        e = _contracted(e)
    e = written(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    size = _digest(e)
    while size[0]:
        e, whole = (_contracted(e) if contract else e), e
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.where("u <> v").distinct(), "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
        e = written(small.where("u <> v").distinct(), "edges")
        discard(whole, large)
        now = _digest(e)
        if now == size:
            break
        size = now
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _contracted(e: DataFrame) -> DataFrame:
    """Edges that connect what ``e`` does: each partition's own components as stars to their least nodes."""

    def stars(held) -> pa.RecordBatch:
        found = contracted(*(np.concatenate([x[k] for x in held]) for k in (0, 1)))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for b in batches:
            held.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
            rows += b.num_rows
            if rows >= CONTRACTED:
                yield stars(held)
                held, rows = [], 0
        if rows:
            yield stars(held)

    return e.select(F.col("u").cast("long"), F.col("v").cast("long")).mapInArrow(run, "u long, v long")


def contracted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) for the nodes of the edges (a, b) that aren't roots."""
    nodes, at = np.unique(np.stack([a, b]), return_inverse=True)
    u, v = at.reshape(2, -1)
    label = np.arange(len(nodes))
    while True:
        new = label.copy()
        np.minimum.at(new, u, label[v])
        np.minimum.at(new, v, label[u])
        np.minimum.at(new, label, new)  # a root takes what its nodes have found
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
    other = label != np.arange(len(nodes))
    return nodes[other], nodes[label[other]]


def _digest(e: DataFrame) -> tuple:
    """The number of edges and a sum over them, alike only if the edges are."""
    r = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(r)
