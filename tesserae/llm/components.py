"""Connected components by alternating large-star and small-star steps on an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import written

#: Nodes whose edges a task contracts at once.
AT_ONCE = 200_000


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (u, v) to a star of each component of a task's edges, a bounded number of nodes at a time."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def stars() -> pa.RecordBatch:
        found = [(x, top(x)) for x in list(up)]
        found = [(x, y) for x, y in found if x != y]
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["u", "v"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = top(a), top(b)
            if a != b:
                up[max(a, b)] = min(a, b)
        if len(up) > AT_ONCE:
            yield stars()
            up.clear()
    yield stars()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, label`` for every node of an edge that joins two different nodes; the label is the least node reachable.

    Edges are contracted inside tasks first. Nothing is collected: each half-step is an aggregation
    and a join, written before the next, so no plan grows with the steps; a hub's neighbours are
    never gathered, since only their minimum is taken. Stops when the edge table no longer changes.
    No edges give no rows.
    """
    both = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v")
    now, before = written(both.mapInArrow(_contracted, "u long, v long").distinct(), "edges"), None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("label")).union(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
        before = mark
        arcs = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = arcs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = written(arcs.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        now = written(small.filter("u <> v").distinct(), "edges")
