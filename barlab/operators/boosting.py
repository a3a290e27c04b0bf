"""Squared-error boosting with an exact, distributed split search.

Level by level, one pass over the rows counts every (node, feature, value) cell; running sums over a
feature's values give the gain of every cut, and an ordered struct picks the best cut of a node. No rows
are sampled and no values binned, so the fit is the same at any number of rows and partitions.

Training rows of equal codes are moved by the same steps through the whole fit, so they become one row before it begins: their
number, weight, and weighted sum and squares of what the target differs from its mean. What the steps have added since follows
from these sums. Rows lie packed in blocks, so a pass hands them to NumPy without a conversion. A task adds up its rows' cells in NumPy and sends each once. A window holds one feature of one node: at most one
row per encoded value (``CEILING`` + 1), whatever the size of the data. Only one row per feature of an open node reaches
the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from barlab.operators.model import FIT, Ensemble, Tree, land
from barlab.session import cut_lineage

PLACES = 9      # decimals of a gain in units of the root's variance: cuts closer than this are ties


SPAN = 1 << 12  # values of a feature that a task counts in a table; a wider one is sorted batch by batch
SUMS = ("n", "w", "s", "q")


# One statement a level: built from columns, a level would cost the driver more time than its job takes.
BEST_CUTS = """
WITH cells AS (
  SELECT node, feature, value, sum(n) AS n, sum(w) AS w, sum(s) AS s, sum(q) AS q FROM {cells} GROUP BY node, feature, value),
sided AS (
  SELECT node, feature, value, lead(value) OVER o AS next,
    sum(n) OVER below AS ln, sum(w) OVER below AS lw, sum(s) OVER below AS ls, sum(q) OVER below AS lq,
    sum(n) OVER every AS tn, sum(w) OVER every AS tw, sum(s) OVER every AS ts, sum(q) OVER every AS tq
  FROM cells
  WINDOW o AS (PARTITION BY node, feature ORDER BY value),
    below AS (PARTITION BY node, feature ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    every AS (PARTITION BY node, feature ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
gains AS (
  SELECT *, CASE WHEN next IS NOT NULL AND ln >= {least} AND tn - ln >= {least} THEN round(
    (try_divide(ls * ls, lw) + try_divide((ts - ls) * (ts - ls), tw - lw) - try_divide(ts * ts, tw)) / {scale}, {places}) END AS gain
  FROM sided)
SELECT node, feature, b.*, -b.minus AS low FROM (
  SELECT node, feature, max(struct(gain, -value AS minus, (value + next) / 2 AS threshold, ln, lw, ls, lq, tn, tw, ts, tq)) AS b
  FROM gains GROUP BY node, feature)"""


def node_of(x: Sequence[np.ndarray], cuts: dict[int, tuple[int, float]]) -> np.ndarray:
    """The node that each row has come to, by its place in the full binary tree."""
    at = np.zeros(len(x[0]), np.int64)
    for i in sorted(cuts):
        feature, threshold = cuts[i]
        here = np.flatnonzero(at == i)
        at[here] = 2 * i + 1 + (x[feature][here] > threshold)
    return at


@dataclass(frozen=True)
class Training:
    """Training rows of distinct codes in blocks.

    A block holds ``size`` rows: ``x``, their codes, one feature after the other; ``sums``, their n, w, s and q at the start of the
    fit; ``f``, what the trees have added to each since.
    """

    blocks: DataFrame
    ranges: tuple[tuple[int, int], ...]     # of each feature: the smallest code and how many there are up to the largest

    def count(self) -> int:
        return int(self.blocks.agg(F.sum("size")).first()[0] or 0)


BLOCK = "size int, x binary, sums binary, f binary"


def block(x: np.ndarray, sums: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
    packed = [pa.array([a.tobytes()], pa.binary()) for a in (x, sums, f)]
    return pa.RecordBatch.from_arrays([pa.array([len(f)], pa.int32()), *packed], names=["size", "x", "sums", "f"])


def blocks_of(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for x, sums, f in zip(*(c for c in batch.columns[1:])):
            f = np.frombuffer(f.as_buffer(), np.float64)
            yield (np.frombuffer(x.as_buffer(), np.int32).reshape(width, -1), np.frombuffer(sums.as_buffer(), np.float64).reshape(len(SUMS), -1), f)


def pack(rows: DataFrame, width: int) -> DataFrame:
    """Blocks of rows of ``width`` codes and n, w, s and q."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.stack([batch.column(i).to_numpy() for i in range(width)])
                sums = np.stack([batch.column(width + i).to_numpy().astype(np.float64) for i in range(len(SUMS))])
                yield block(x.astype(np.int32), sums, np.zeros(batch.num_rows))

    return rows.mapInArrow(run, BLOCK)


def cells(rows: Training, cuts: dict[int, tuple[int, float]], waiting: Sequence[int]) -> DataFrame:
    """node, feature, value, n, w, s, q: what a task's rows add to each value of each waiting node; a value may come from several tasks."""
    ranges, nodes = rows.ranges, np.array(waiting)
    slots = np.full(2 * max(waiting) + 3, -1)
    slots[nodes] = np.arange(len(nodes))

    def told(i: int, slot: np.ndarray, value: np.ndarray, sums: Sequence[np.ndarray]) -> pa.RecordBatch:
        there = np.flatnonzero(sums[0])
        return pa.RecordBatch.from_arrays(
            [pa.array(nodes[slot[there]].astype(np.int32)), pa.array(np.full(len(there), i, np.int32)), pa.array((value[there] + ranges[i][0]).astype(np.int32)),
             pa.array(np.rint(sums[0][there]).astype(np.int64)), *[pa.array(x[there]) for x in sums[1:]]], names=["node", "feature", "value", *SUMS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = {i: np.zeros((4, len(nodes) * span)) for i, (_, span) in enumerate(ranges) if span <= SPAN}
        for x, (n, w, s, q), f in blocks_of(batches, len(ranges)):
            slot = slots[node_of(x, cuts)]
            left = s - w * f
            sums = (n, w, left, q - f * (s + left))
            if (slot < 0).any():
                held = np.flatnonzero(slot >= 0)
                slot, x, sums = slot[held], x[:, held], [c[held] for c in sums]
            for i, (low, span) in enumerate(ranges):
                key = slot * span + (x[i] - low)
                if i in tables:
                    for total, each in zip(tables[i], sums):
                        total += np.bincount(key, each, len(total))
                elif len(key):
                    values, place = np.unique(key, return_inverse=True)
                    yield told(i, values // span, values % span, [np.bincount(place, each) for each in sums])
        for i, table in tables.items():
            span = ranges[i][1]
            yield told(i, np.repeat(np.arange(len(nodes)), span), np.tile(np.arange(span), len(nodes)), table)

    return rows.blocks.mapInArrow(run, "node int, feature int, value int, n long, w double, s double, q double")


def best_cuts(rows: Training, cuts: dict[int, tuple[int, float]], waiting: Sequence[int], min_leaf_rows: int, scale: float) -> list:
    """The best cut of each waiting node.

    Gain is the weighted variance that a cut removes; equal gains go to the earlier feature, then to the smaller value.
    ``gain`` is NULL where no cut leaves ``min_leaf_rows`` on both sides. The threshold lies halfway to the next value.
    """
    found = cells(rows, cuts, waiting)
    if all(span <= SPAN for _, span in rows.ranges):        # few cells: dealt once
        found = found.repartition(len(waiting), "node")
    query = BEST_CUTS.format(least=int(min_leaf_rows), scale=f"{scale!r}D", places=PLACES, cells="{cells}")
    best: dict = {}
    for row in found.sparkSession.sql(query, cells=found).collect():     # one row per feature of an open node
        rank = (row["gain"] is not None, row["gain"] or 0.0, -row["feature"])
        if row["node"] not in best or rank > best[row["node"]][0]:
            best[row["node"]] = (rank, row)
    return [row for _, row in best.values()]


class Growing:
    """A tree while it grows: nodes by their place in the full binary tree (children of i: 2i + 1 and 2i + 2)."""

    def __init__(self, totals: tuple[int, float, float, float]):
        self.totals, self.cuts = {0: totals}, {}

    def split(self, row) -> None:
        i = row["node"]
        left = tuple(row[f"l{c}"] for c in "nwsq")
        self.cuts[i] = (row["feature"], float(row["threshold"]))
        self.totals[2 * i + 1] = left
        self.totals[2 * i + 2] = tuple(row[f"t{c}"] - x for c, x in zip("nwsq", left))

    def tree(self) -> Tree:
        order = sorted(self.totals)
        place = {i: k for k, i in enumerate(order)}
        cut = lambda i: self.cuts.get(i, (-1, 0.0))
        child = lambda i, side: place[2 * i + side] if i in self.cuts else -1
        means = [s / w if w else 0.0 for _, w, s, _ in (self.totals[i] for i in order)]
        return Tree(
            tuple(cut(i)[0] for i in order), tuple(cut(i)[1] for i in order), tuple(child(i, 1) for i in order), tuple(child(i, 2) for i in order),
            tuple(means), tuple(int(self.totals[i][0]) for i in order), tuple(float(self.totals[i][1]) for i in order),
            tuple(max(self.totals[i][3] / self.totals[i][1] - m * m, 0.0) if self.totals[i][1] else 0.0 for i, m in zip(order, means)))


def grow(rows: Training, depth: int, min_leaf_rows: int, scale: float) -> Tree:
    """One tree over rows of at least one node; the root's totals come with its first cut."""
    growing, waiting = None, [0]
    for _ in range(depth):
        if not waiting:
            break
        found = best_cuts(rows, growing.cuts if growing else {}, waiting, min_leaf_rows, scale)
        growing = growing or Growing(tuple(found[0][f"t{c}"] for c in "nwsq"))
        waiting = []
        for row in found:
            if row["gain"] is not None and row["gain"] > 0:
                growing.split(row)
                waiting += [i for i in (2 * row["node"] + 1, 2 * row["node"] + 2) if growing.totals[i][0] >= 2 * min_leaf_rows]
    return growing.tree()


def spread(rows: Training) -> float:
    """The weighted squares of the target around its mean."""
    width = len(rows.ranges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([sum(float(sums[3].sum()) for _, sums, _ in blocks_of(batches, width))], pa.float64())], names=["q"])

    return float(rows.blocks.mapInArrow(run, "q double").agg(F.sum("q")).first()[0]) or 1.0


def moved(rows: Training, tree: Tree, learning_rate: float) -> DataFrame:
    """The blocks with the tree's step added to f."""
    steps, width = learning_rate * np.array(tree.value, np.float64), len(rows.ranges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, sums, f in blocks_of(batches, width):
            yield block(x, sums, f + steps[land(tree, x)])

    return rows.blocks.mapInArrow(run, BLOCK)


def fit_boosted(
    train: DataFrame,
    names: Sequence[str],
    target: str = "target",
    weight: str = "weight",
    trees: int = FIT["trees"],
    depth: int = FIT["depth"],
    min_leaf_rows: int = FIT["min_leaf_rows"],
    learning_rate: float = FIT["learning_rate"],
    cut_every: int = 8,
) -> Ensemble:
    """One exact tree per round on the residual, from the weighted mean of the target.

    Each round keeps what its tree has added in Spark's storage, until the next round has it; every ``cut_every`` rounds it is
    written to the checkpoint folder. Rows without weight, target or an input take no part. ``train`` is read twice.
    """
    complete = F.lit(True)
    for n in (*names, target, weight):
        complete = complete & F.col(n).isNotNull()
    w, y = F.col(weight).cast("double"), F.col(target).cast("double")
    codes = [f"c{i}" for i in range(len(names))]
    whole = train.where(complete).select(*[F.col(n).cast("int").alias(c) for c, n in zip(codes, names)], w.alias("w"), y.alias("y"))
    total = whole.agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("y")).alias("s"), *[f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in codes]).first()
    if not total["w"]:
        raise ValueError("no complete training row")
    bias = float(total["s"] / total["w"])
    ranges = tuple((total[f"min_{c}"], total[f"max_{c}"] - total[f"min_{c}"] + 1) for c in codes)
    r = F.col("y") - F.lit(bias)
    rows = whole.groupBy(*codes).agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"), F.sum(F.col("w") * r).alias("s"), F.sum(F.col("w") * r * r).alias("q"))
    current = Training(cut_lineage(pack(rows, len(codes))).persist(StorageLevel.MEMORY_AND_DISK), ranges)
    held, fitted, scale = [current.blocks], [], None
    try:
        for k in range(1, trees + 1):
            scale = scale or spread(current)
            tree = grow(current, depth, min_leaf_rows, scale)
            fitted.append(tree)
            while len(held) > 1:                            # what the round before kept has been read for the last time
                held.pop(0).unpersist()
            if k < trees:
                blocks = moved(current, tree, learning_rate)
                if k % cut_every == 0:
                    blocks = cut_lineage(blocks)
                current = Training(blocks.persist(StorageLevel.MEMORY_AND_DISK), ranges)
                held.append(current.blocks)
    finally:
        while held:
            held.pop().unpersist()
    return Ensemble(bias, learning_rate, tuple(names), tuple(fitted))
