"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is two shuffles over the edges that are left, and the number of steps grows with the logarithm
of the longest path. It ends when every edge points to its component's smallest node, which one aggregation tells. Only edges of a bounded
number, checked before, reach the driver, which joins them at once: steps cost the same many small tasks for few edges as for many.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .shared import SharedTable

COLLECT_EDGES = 200_000  # edges up to which the driver joins them (some 8 MB)


def _with_min(pairs: DataFrame) -> DataFrame:
    """pairs (u, v): adds m, the smallest of u and its v. The minima are written, so that the join reads two plain tables and
    adaptive execution can split a node that very many edges have."""
    least = SharedTable(pairs.groupBy("u").agg(F.min("v").alias("m")), "least").read()
    return pairs.join(least, "u").select("u", "v", F.least("u", "m").alias("m"))


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_min(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    linked = _with_min(down)
    return linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(linked.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def _is_star(edges: DataFrame) -> bool:
    """Whether every node has either one parent or children only: then each v is its component's smallest node."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR (up = 1 AND down = 1)").isEmpty()


def _collected(edges: SharedTable) -> DataFrame:
    """Of few edges: every node's label is lowered to the smallest that an edge or its label's label has, until none is lowered."""
    table = edges.read().toArrow()
    ends = pa.chunked_array([*table.column("u").chunks, *table.column("v").chunks], table.schema.field("u").type)
    names = pc.unique(ends)
    names = names.take(pc.array_sort_indices(names))
    code = pc.index_in(ends, value_set=names).to_numpy()
    u, v = code[: table.num_rows], code[table.num_rows :]
    label = np.arange(len(names))
    while (label[u] != label[v]).any():
        least = np.minimum(label[u], label[v])
        np.minimum.at(label, label[u], least)
        np.minimum.at(label, label[v], least)
        while (label != label[label]).any():
            label = label[label]
    kind = edges.schema["u"].dataType
    found = pa.table({"node": names, "component": names.take(pa.array(label))})
    edges.drop()
    return SharedTable(edges.spark.createDataFrame(found, f"node {kind.simpleString()}, component {kind.simpleString()}"), "components").read()


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v of one type with an order): (node, component) for every node with an edge; component is the smallest node reachable."""
    now = SharedTable(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    if now.read().count() <= COLLECT_EDGES:
        return _collected(now)
    while not _is_star(now.read()):
        for step in (_large, _small):
            after = SharedTable(step(now.read()), "edges")
            now.drop()
            now = after
    stars = now.read()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
