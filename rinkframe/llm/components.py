"""Connected components of a link table: union-find inside partitions, then star contraction across them."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, checkpointed

#: Edges that one task of a round reads, on average.
EDGES_A_TASK = 1 << 18


def union_find(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) for all nodes that aren't their own root; the root is the smallest node of its set."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(nodes)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for x, y in zip(at[: len(a)].tolist(), at[len(a) :].tolist(), strict=True):
        x, y = find(x), find(y)
        parent[max(x, y)] = min(x, y)
    root = np.array([find(x) for x in range(len(nodes))], np.int64)
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[moved], nodes[root[moved]]


def _local(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of stars of each batch; batches are bounded, and so is the memory."""
    for batch in batches:
        a, b = union_find(*(batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1)))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def connected_components(links: DataFrame) -> DataFrame:
    """links (a, b: long, not null) to (node, root): the smallest node that each linked node reaches.

    Stars: every node points to the smallest neighbour it knows (large and small star in turn) until
    nothing moves, in a number of rounds that grows with the logarithm of a component's size.
    Minima are pre-aggregated and a hub's neighbours are joined, never gathered in one place.
    links are counted first and so are read twice: give them from a checkpoint. Rounds have a task for every
    EDGES_A_TASK edges (one for each core at least), as most rounds have few edges and no use for all shuffle partitions.
    """
    spark = links.sparkSession
    cores, partitions = spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))

    def dealt(df: DataFrame, edges: int) -> DataFrame:
        tasks = max(cores, -(-edges // EDGES_A_TASK))
        return df.coalesce(tasks) if tasks < partitions else df

    links = links.where("a <> b").select("a", "b")
    n, state = links.count(), None
    edges = checkpointed(arrow_map(dealt(links, n), _local, "a long, b long"))
    while True:
        both = edges.union(edges.select("b", "a"))
        least = dealt(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), n)
        edges = dealt(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), n)
        # small star: neighbours that are smaller point to the smallest of them
        down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = dealt(down.groupBy("a").agg(F.min("b").alias("m")), n)
        hop = down.join(least, "a")
        edges = checkpointed(dealt(hop.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).distinct(), n))
        row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == row:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        n, state = row[0], row
