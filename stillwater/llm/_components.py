"""Connected components of an edge table, without a driver-side graph.

Alternating large-star and small-star steps; between them each task replaces the edges it holds
by a forest with the smallest node of each tree as its root, which shortens chains at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stillwater.llm._scratch import discard, materialize


#: edges that a task turns into a forest at first, and nodes that it holds at most (then it tells of these and begins anew)
TASK_EDGES, TASK_NODES = 200_000, 2_000_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    up: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (p := up.setdefault(top, top)) != top:
            top = p
        while up[x] != top:
            up[x], x = top, up[x]
        return top

    def trees() -> Iterator[pa.RecordBatch]:
        nodes = [x for x in up if root(x) != x]
        for i in range(0, len(nodes), 1 << 16):
            part = nodes[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([up[x] for x in part], pa.int64())], names=["a", "b"])
        up.clear()

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = root(a), root(b)
            if x != y:
                up[max(x, y)] = min(x, y)
        if len(up) > TASK_NODES:
            yield from trees()
    yield from trees()


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of ``edges`` (a, b); root is the smallest node of its component."""
    e = materialize(edges.select("a", "b").where("a != b"), "edges")
    tasks = -(-e.count() // TASK_EDGES)
    e = materialize(e.coalesce(max(1, tasks)).mapInArrow(_forest, "a long, b long"), "edges")
    while tasks > 1:
        both = e.union(e.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        large = materialize(large.mapInArrow(_forest, "a long, b long"), "edges")
        parent = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(parent, "a")
        small = small.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b"))).distinct()
        new = materialize(small.mapInArrow(_forest, "a long, b long"), "edges")
        discard(large)
        discard(e)
        e = new
        # a star forest (as is the forest of a single task): no root of an edge is a child, and no child has two edges
        roots, children = e.select(F.col("b").alias("a")).distinct(), e.groupBy("a").count()
        if not children.join(roots, "a", "left_semi").take(1) and not children.where("count > 1").take(1):
            break
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
