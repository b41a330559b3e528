"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkmend.operators.shared import written


def connected_components(links: DataFrame, src: str = "src", dst: str = "dst", most_rounds: int = 50, in_one_task: int = 0) -> DataFrame:
    """node, component (the smallest node reachable), for every node that occurs in a link between two nodes.

    Links with a null end and loops are passed over; repeated links count once. Each round is two joins on a node and its least neighbour, written
    to the shared folder, so lineage stays short and a lost executor costs one round. Rounds grow with the
    logarithm of the longest chain. A hub's links are split by adaptive skew joins, as both sides are plain shuffles.
    With in_one_task, up to so many distinct links are joined up by one task instead, which gives the same rows without rounds.
    """
    edges = links.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u <> v")
    edges = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    if in_one_task and edges.limit(in_one_task + 1).count() <= in_one_task:
        kind = edges.schema["u"].dataType.simpleString()
        return written(edges.coalesce(1).mapInArrow(joined_up, f"node {kind}, component {kind}"), "components")
    seen = None
    for _ in range(most_rounds):
        edges = written(small_star(written(large_star(edges), "large_star")), "small_star")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle; raise most_rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())


def large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of a node go to the least of it and its neighbours."""
    both = edges.union(edges.select("v", "u"))
    least = written(both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m")), "least")
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours go to the least of them; every edge has u > v."""
    least = written(edges.groupBy("u").agg(F.min("v").alias("m")), "least")
    down = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return down.union(least.select("u", F.col("m").alias("v"))).distinct()


def joined_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, component of all links of a task."""
    root: dict = {}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    kind = None
    for batch in batches:
        kind = batch.column(0).type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = find(root.setdefault(a, a)), find(root.setdefault(b, b))
            root[max(a, b)] = min(a, b)
    if root:
        nodes = list(root)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array([find(n) for n in nodes], kind)], names=["node", "component"])
