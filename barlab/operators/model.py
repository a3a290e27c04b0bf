"""Integer encoding, tree ensembles as column expressions, node audit and replay."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barlab.functions.scalars import ratio

# Fixed values of the encoding and of the fit.
SCALE, SHIFT, NUDGE, CEILING = 100, 10_000, 1e-6, 999_999
FIT = {"trees": 64, "depth": 3, "min_leaf_rows": 300, "learning_rate": 0.05}
QUANTILES = (0.97, 0.98, 0.99, 0.995, 0.998, 0.999, 0.9995)


@dataclass(frozen=True)
class Tree:
    """Parallel node lists; a leaf has left = right = -1. ``x <= threshold`` goes left.

    ``rows``, ``weight`` and ``impurity`` are what a fit stored at each node, empty where nothing is stored.
    """

    feature: tuple[int, ...]
    threshold: tuple[float, ...]
    left: tuple[int, ...]
    right: tuple[int, ...]
    value: tuple[float, ...]
    rows: tuple[int, ...] = ()
    weight: tuple[float, ...] = ()
    impurity: tuple[float, ...] = ()

    def leaves(self) -> list[int]:
        return [i for i, child in enumerate(self.left) if child < 0]

    def path(self, node: int) -> list[int]:
        """The node and its ancestors, root last."""
        parent = {c: i for i in range(len(self.left)) for c in (self.left[i], self.right[i]) if c >= 0}
        out = [node]
        while out[-1] in parent:
            out.append(parent[out[-1]])
        return out


@dataclass(frozen=True)
class Ensemble:
    bias: float
    learning_rate: float
    feature_names: tuple[str, ...]
    trees: tuple[Tree, ...]
    cuts: dict[float, float] = field(default_factory=dict)


def encode_column(x: Column, multiplier: int = 1) -> Column:
    clipped = F.least(F.greatest(SCALE * x + SHIFT + NUDGE, F.lit(0.0)), F.lit(float(CEILING)))
    return F.floor(multiplier * clipped).cast("int")


def encode(rows: DataFrame, names: Sequence[str], valid: str = "formula_input_valid",
           multiplier: int = 1) -> DataFrame:
    """Features as integers from 0 to 999999 on valid rows, NULL elsewhere.

    The guard matters: a NaN compares above every number and would become the ceiling.
    """
    ok = F.col(valid)
    return rows.withColumns({
        n: F.when(ok & ~F.isnan(n), encode_column(F.col(n).cast("double"), multiplier)) for n in names})


def bind(ensemble: Ensemble, declared: Sequence[str]) -> Ensemble:
    """Refuse a model whose inputs are not the declared ones in the declared order."""
    if list(ensemble.feature_names) != list(declared):
        raise ValueError("model features differ from the declared list")
    return ensemble


def walk_text(tree: Tree, inputs: Sequence[str], leaf, node: int = 0) -> str:
    """Nested condition, as SQL, that yields ``leaf(node)`` for the leaf a row falls into; ``inputs`` are SQL too."""
    if tree.left[node] < 0:
        value = leaf(node)
        return f"{value!r}D" if isinstance(value, float) else str(value)
    return (f"CASE WHEN {inputs[tree.feature[node]]} <= {float(tree.threshold[node])!r}D "
            f"THEN {walk_text(tree, inputs, leaf, tree.left[node])} ELSE {walk_text(tree, inputs, leaf, tree.right[node])} END")


def walk(tree: Tree, names: Sequence[str], leaf) -> Column:
    """``walk_text`` over columns."""
    return F.expr(walk_text(tree, [f"`{n}`" for n in names], leaf))


def score_column(ensemble: Ensemble) -> Column:
    """Score as one expression, for short ensembles."""
    total = F.lit(float(ensemble.bias))
    for tree in ensemble.trees:
        total = total + walk(tree, ensemble.feature_names,
                             lambda i, t=tree: float(ensemble.learning_rate * t.value[i]))
    return total


def score(encoded: DataFrame, ensemble: Ensemble, valid: str = "formula_input_valid") -> DataFrame:
    """Every row kept; the score is NULL where the input is invalid.

    Each tree is a field of its own and the fields are added in order afterwards, so
    generated code splits into one method per tree.
    """
    steps = [walk(tree, ensemble.feature_names, lambda i, t=tree: float(ensemble.learning_rate * t.value[i]))
             .alias(f"t{k}") for k, tree in enumerate(ensemble.trees)]
    total = F.lit(float(ensemble.bias))
    for k in range(len(steps)):
        total = total + F.col(f"_trees.t{k}")
    return (encoded.withColumn("_trees", F.struct(*steps))
            .withColumn("score", F.when(F.col(valid), total)).drop("_trees"))


def score_replay(a: DataFrame, b: DataFrame, cut: float, tolerance: float = 2e-11) -> DataFrame:
    """Agreement of two score tables on the same keys, in values and in flags."""
    keys = ["date", "code"]
    joined = a.select(*keys, F.col("score").alias("_a")).join(
        b.select(*keys, F.col("score").alias("_b")), keys, "full_outer")
    x, y = F.col("_a"), F.col("_b")
    flag_a, flag_b = (F.coalesce(c > cut, F.lit(False)) for c in (x, y))
    return joined.agg(
        F.count(F.lit(1)).alias("rows"), F.count(x).alias("scored"),
        F.count_if(x.isNull() != y.isNull()).alias("missing_mismatch"),
        F.count_if(F.abs(x - y) > tolerance).alias("value_mismatch"),
        F.count_if(flag_a != flag_b).alias("flag_mismatch"), F.count_if(flag_a).alias("selected"))


NODE_COLUMNS = "tree_id int, node_id int, feature int, threshold double, left int, right int, value double, node_rows long, weight double, impurity double"


def tree_table(spark: SparkSession, ensemble: Ensemble) -> DataFrame:
    """Long node table; what no fit has stored is NULL."""
    stored = lambda values, i: values[i] if values else None
    rows = [(t, i, tree.feature[i], float(tree.threshold[i]), tree.left[i], tree.right[i], float(tree.value[i]),
             stored(tree.rows, i), stored(tree.weight, i), stored(tree.impurity, i))
            for t, tree in enumerate(ensemble.trees) for i in range(len(tree.left))]
    return spark.createDataFrame(rows, NODE_COLUMNS)


def trees_from_table(nodes: DataFrame, bias: float, learning_rate: float, names: Sequence[str]) -> Ensemble:
    """Rebuild an ensemble from its node table; the table is bounded by the model."""
    trees: dict[int, dict[int, tuple]] = {}
    for r in nodes.collect():
        trees.setdefault(r["tree_id"], {})[r["node_id"]] = tuple(r[c] for c in (
            "feature", "threshold", "left", "right", "value", "node_rows", "weight", "impurity"))
    built = []
    for t in sorted(trees):
        lists = [tuple(col) for col in zip(*(trees[t][i] for i in sorted(trees[t])))]
        built.append(Tree(*lists[:5], *(() if None in x else x for x in lists[5:])))
    return Ensemble(bias, learning_rate, tuple(names), tuple(built))


def land(tree: Tree, x: Sequence[np.ndarray], node: int = 0):
    """The leaf of every row of a batch; ``x`` has one array of codes per feature, a missing code is NaN and goes right."""
    if tree.left[node] < 0:
        return node
    return np.where(x[tree.feature[node]] <= tree.threshold[node], land(tree, x, tree.left[node]), land(tree, x, tree.right[node]))


def codes_of(batch: pa.RecordBatch, first: int, n: int) -> list[np.ndarray]:
    return [batch.column(i).to_numpy(zero_copy_only=False).astype(np.float64) for i in range(first, first + n)]


def descend(encoded: DataFrame, nodes: DataFrame, bias: float, learning_rate: float, names: Sequence[str], depth: int,
            valid: str = "formula_input_valid", keys: Sequence[str] = ("date", "code")) -> DataFrame:
    """Scores by walking a node table, ``depth`` levels at most, each from a row's node to the next.

    Independent of the column expressions of ``score``: the tasks look up each node in the table, which is bounded by
    the model, and no row is copied or moved. A row that has not reached a leaf after ``depth`` levels, or meets a
    node that is missing, has no score.
    """
    table: dict[int, dict[int, tuple]] = {}
    for r in nodes.select("tree_id", "node_id", "feature", "threshold", "left", "right", "value").collect():
        table.setdefault(r["tree_id"], {})[r["node_id"]] = tuple(r)[2:]
    n, wide = len(names), encoded.select(*keys, F.coalesce(F.col(valid), F.lit(False)), *[F.col(c).cast("double") for c in names])

    def value_at(tree, x, missing, node, levels):
        if node not in tree:
            return np.nan
        feature, threshold, left, right, value = tree[node]
        if left < 0:
            return np.nan if value is None else value
        if levels == 0:
            return np.nan
        onward = x[feature] <= threshold if 0 <= feature < n and threshold is not None else missing
        return np.where(onward, value_at(tree, x, missing, left, levels - 1), value_at(tree, x, missing, right, levels - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, total = codes_of(batch, len(keys) + 1, n), np.zeros(batch.num_rows)
            for t in sorted(table):
                total = total + value_at(table[t], x, np.zeros(batch.num_rows, bool), 0, depth)
            ok = batch.column(len(keys)).to_numpy(zero_copy_only=False).astype(bool) & ~np.isnan(total) & bool(table)
            score = pa.array(bias + learning_rate * total, pa.float64(), mask=~ok)
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(keys)], score], names=[*keys, "score"])

    return wide.mapInArrow(run, wide.select(*keys).schema.add("score", "double"))


def spread(groups: DataFrame, keys: Sequence[str], *extra: Column) -> DataFrame:
    """Joined centred moments: keys, w, mean, variance from groups (keys, w, m, v) with their own mean and variance.

    Deviations are taken from the mean of all, so no squares of large numbers are subtracted.
    """
    means = groups.groupBy(*keys).agg(F.sum("w").alias("_w"), ratio(F.sum(F.col("w") * F.col("m")), F.sum("w")).alias("mean"), *extra)
    apart = F.col("m") - F.col("mean")
    joined = groups.join(means.select(*keys, "mean"), list(keys))
    squares = joined.groupBy(*keys).agg(ratio(F.sum(F.col("w") * (F.col("v") + apart * apart)), F.sum("w")).alias("variance"))
    return means.withColumnRenamed("_w", "w").join(squares, list(keys))


def equal_weight_groups(rows: DataFrame, keys: Sequence[str], weight: str, value: str) -> DataFrame:
    """keys, n, w, m, v: rows of equal weight have mergeable centred moments that Spark combines itself."""
    return rows.groupBy(*keys, F.col(weight).alias("_each")).agg(
        F.count(value).alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v")).where("n > 0").select(
        *keys, "n", (F.col("_each") * F.col("n")).alias("w"), "m", "v")


DAYS = 1 << 15      # days of one bitmap of Spark


def leaf_groups(ensemble: Ensemble):
    """tree_id, leaf, bucket, n, w, m, v, days: the rows of a task at every leaf, as weighted centred moments and a bitmap of days.

    Deviations are taken from the mean of the task's first rows. The moments stand in a leaf's first row only.
    """
    trees, nodes = len(ensemble.trees), max(len(t.left) for t in ensemble.trees)
    steps = [ensemble.learning_rate * np.array(t.value, np.float64) for t in ensemble.trees]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, centre, seen = np.zeros((5, trees, nodes)), [None] * trees, {}
        for batch in batches:
            batch = batch.filter(batch.column(2).is_valid())
            if not batch.num_rows:
                continue
            day, weighed = batch.column(0), batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            dated = day.is_valid().to_numpy(zero_copy_only=False)
            day = day.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            w = np.where(weighed, batch.column(1).fill_null(0.0).to_numpy(zero_copy_only=False), 0.0)
            r, x = batch.column(2).to_numpy(zero_copy_only=False), codes_of(batch, 3, len(ensemble.feature_names))
            parts = [(b, np.flatnonzero(dated & (day // DAYS == b))) for b in np.unique(day[dated] // DAYS).tolist()]
            for t, tree in enumerate(ensemble.trees):
                at = np.broadcast_to(land(tree, x), r.shape)
                if centre[t] is None:
                    centre[t] = float(r.mean())
                d = r - centre[t]
                for k, each in enumerate((None, weighed, w, w * d, w * d * d)):
                    sums[k, t] += np.bincount(at, each, nodes)
                for b, rows in parts:
                    if b not in seen:
                        seen[b] = np.zeros((trees, nodes, DAYS), bool)
                    seen[b][t][at[rows], day[rows] % DAYS] = True
                r = r - steps[t][at]
        out = []
        for t, leaf in zip(*np.nonzero(sums[0])):
            n, nw, w, s, q = sums[:, t, leaf].tolist()
            mean = s / w if w else None
            out.append((t, leaf, None, int(n), w if nw else None, None if mean is None else centre[t] + mean,
                        None if mean is None else max(q / w - mean * mean, 0.0), None))
            out += [(t, leaf, b, 0, None, None, None, np.packbits(x[t, leaf], bitorder="little").tobytes()) for b, x in seen.items() if x[t, leaf].any()]
        types = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.binary())
        names = ["tree_id", "leaf", "bucket", "n", "w", "m", "v", "days"]
        yield pa.RecordBatch.from_arrays([pa.array([row[i] for row in out], kind) for i, kind in enumerate(types)], names=names)
    return run


def node_stats(rows: DataFrame, ensemble: Ensemble, target: str = "target", weight: str = "weight",
               day: str = "date") -> DataFrame:
    """Rows, weight, residual mean and variance, and distinct days at every node of every tree.

    The residual is updated tree by tree. Each task reduces its rows, once, to one row per leaf, so what moves is
    bounded by the model and the number of tasks. Inner nodes join the groups of their leaves. ``day`` is a date.
    """
    met = rows.select(F.unix_date(F.col(day).cast("date")).alias("day"), F.col(weight).cast("double").alias("w"),
                      (F.col(target) - F.lit(float(ensemble.bias))).cast("double").alias("r"),
                      *[F.col(n).cast("double").alias(f"x{i}") for i, n in enumerate(ensemble.feature_names)])
    leaves = met.mapInArrow(leaf_groups(ensemble), "tree_id int, leaf int, bucket long, n long, w double, m double, v double, days binary")
    paths = rows.sparkSession.createDataFrame(
        [(t, leaf, node, len(tree.path(node)) - 1, node == leaf)
         for t, tree in enumerate(ensemble.trees) for leaf in tree.leaves() for node in tree.path(leaf)],
        "tree_id int, leaf int, node_id int, level int, is_leaf boolean")
    # The path table has (depth + 1) rows per leaf of the model.
    keys = ["tree_id", "node_id", "level", "is_leaf"]
    out = (leaves.join(F.broadcast(paths), ["tree_id", "leaf"]).groupBy(*keys, "bucket")
           .agg(F.sum("n").alias("n"), F.collect_list(F.when(F.col("w").isNotNull(), F.struct("w", "m", "v"))).alias("g"),      # one per task and leaf
                F.when(F.col("bucket").isNotNull(), F.bitmap_count(F.bitmap_or_agg(F.coalesce("days", F.lit(b""))))).alias("days"))
           .groupBy(*keys).agg(F.sum("n").alias("node_rows"), F.flatten(F.collect_list("g")).alias("g"), F.coalesce(F.sum("days"), F.lit(0)).alias("days")))
    total = lambda one: F.when(F.size("g") > 0, F.aggregate("g", F.lit(0.0), lambda a, x: a + F.coalesce(one(x), F.lit(0.0))))
    out = out.withColumn("weight", total(lambda x: x["w"])).withColumn("residual_mean", ratio(total(lambda x: x["w"] * x["m"]), F.col("weight")))
    apart = lambda x: x["m"] - F.col("residual_mean")
    return out.select(*keys, "node_rows", "weight", "days", "residual_mean",
                      ratio(total(lambda x: x["w"] * (x["v"] + apart(x) * apart(x))), F.col("weight")).alias("residual_variance"))


def node_audit(stored: DataFrame, observed: DataFrame, tolerance: float = 2e-10) -> DataFrame:
    """Stored against observed rows, weight, value and impurity of every node, one row per node.

    ``stored`` is a node table, ``observed`` the result of ``node_stats`` on the training rows. A node that one
    side lacks shows as a difference.
    """
    a = stored.select("tree_id", "node_id", F.col("node_rows").alias("stored_rows"), F.col("weight").alias("stored_weight"),
                      F.col("value").alias("stored_value"), F.col("impurity").alias("stored_impurity"))
    joined = a.join(observed, ["tree_id", "node_id"], "full_outer")
    near = lambda x, y: F.coalesce(F.abs(F.col(x) - F.col(y)) <= F.lit(tolerance) * F.greatest(F.lit(1.0), F.abs(F.col(x))), F.lit(False))
    return joined.select(
        "tree_id", "node_id", F.coalesce(F.col("stored_rows") == F.col("node_rows"), F.lit(False)).alias("rows_agree"),
        near("stored_weight", "weight").alias("weight_agrees"), near("stored_value", "residual_mean").alias("value_agrees"),
        near("stored_impurity", "residual_variance").alias("impurity_agrees"), "days")


def weighted_moments(rows: DataFrame, value: str, weight: str, by: Sequence[str]) -> DataFrame:
    """n, weight, mean and variance per group, from centred moments of the rows of equal weight."""
    out = spread(equal_weight_groups(rows, by, weight, value), by, F.sum("n").alias("n"))
    return out.select(*by, "n", F.col("w").alias("weight"), F.col("mean").alias("weighted_mean"),
                      F.col("variance").alias("weighted_variance"))
