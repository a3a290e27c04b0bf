"""Connected components of a graph of long node ids, by contraction."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlab.llm.common import stored

FEW = 1 << 17               # links that one task joins at once; more are contracted over all tasks first


def smallest_reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, label of at most FEW links (a, b)."""
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := above.setdefault(x, x)) != x:
            above[x] = x = above[y]
        return x

    for batch in batches:
        for a, b in zip(*(c.to_pylist() for c in batch.columns)):
            x, y = top(a), top(b)
            above[max(x, y)] = min(x, y)
    yield pa.RecordBatch.from_arrays([pa.array(list(above), pa.int64()), pa.array([top(x) for x in above], pa.int64())], names=["node", "label"])


def components(edges: DataFrame) -> DataFrame:
    """node, label: for every node of the edges (a, b), the smallest node that it reaches.

    In a round every node takes the smallest of itself and its neighbours, and the links are redrawn between
    what their ends took; links within one node go and equal ones are merged, so each round has far fewer
    than the one before. The smallest node of a component keeps itself and is what remains. Minima are combined
    before they are shuffled, and each join has one side with a single row per key, so a hub's rows can be
    split. Once no more than ``FEW`` links are left, one task joins them: a round of jobs over next to nothing costs
    the driver as much as one over all. Each round is written to the shared folder.
    """
    ordered = lambda a, b: (F.least(a, b).cast("long").alias("a"), F.greatest(a, b).cast("long").alias("b"))
    graph, names = stored(edges.select(*ordered("a", "b")).filter("a <> b").distinct()), None
    while True:
        last = graph.count() <= FEW
        if last:
            took = stored(graph.coalesce(1).mapInArrow(smallest_reached, "node long, label long"))
        else:
            both = graph.union(graph.select("b", "a"))
            took = stored(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label")))
        if names is None:
            names = took
        else:
            onward = took.select(F.col("node").alias("label"), F.col("label").alias("next"))
            names = stored(names.join(onward, "label", "left").select("node", F.coalesce("next", "label").alias("label")))
        if last:
            return names
        first = took.select(F.col("node").alias("a"), F.col("label").alias("x"))
        second = took.select(F.col("node").alias("b"), F.col("label").alias("y"))
        graph = stored(graph.join(first, "a").join(second, "b").select(*ordered("x", "y")).filter("a <> b").distinct())
