"""Connected components of an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import derived, drop, materialize

EDGES_PER_TASK = 1_000_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) edges of one task to (b, a) with a the smallest node that its edges reach: one edge for each other node."""
    to: dict[int, int] = {}

    def end(x: int) -> int:
        while (y := to.get(x, x)) != x:
            to[x] = to.get(y, y)
            x = y
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = end(a), end(b)
            to[max(a, b)] = min(a, b)
            to.setdefault(min(a, b), min(a, b))
    nodes = np.fromiter(to, np.int64, len(to))
    roots = np.fromiter((end(x) for x in to), np.int64, len(to))
    for k in range(0, len(nodes), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(roots[k : k + 100_000]), pa.array(nodes[k : k + 100_000])], ["a", "b"])


def components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """(node, root) for the end points of ``edges(a, b)``; root is the smallest node that can be reached.

    Tasks of at most about ``EDGES_PER_TASK`` edges first shrink their edges to stars. If there is more than one task,
    their stars are joined in rounds: a node takes the smallest label among its neighbours' and follows that label once
    more, so long chains shrink by doubling. State is written to the shared folder after each round.
    """
    tasks = -(-edges.count() // EDGES_PER_TASK)
    stars = materialize(edges.select("a", "b").coalesce(max(1, tasks)).mapInArrow(_forest, "a long, b long"), "stars")
    if tasks <= 1:
        return derived(stars.select(F.col("b").alias("node"), F.col("a").alias("root")), stars)
    both = materialize(stars.select("a", "b").union(stars.select("b", "a")).distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("root")), "labels")
    drop(stars)
    for _ in range(limit):
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("seen"))
        moved = labels.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "seen").alias("root"))
        jump = labels.select(F.col("node").alias("root"), F.col("root").alias("further"))
        after = moved.join(jump, "root", "left").select("node", "old", F.least("root", F.coalesce("further", "root")).alias("root"))
        after = materialize(after, "labels")
        changed = after.filter("old <> root").limit(1).count()
        drop(labels)
        labels = after
        if not changed:
            drop(both)
            return derived(labels.select("node", "root"), labels)
    raise RuntimeError("the components did not settle")
