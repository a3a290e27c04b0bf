"""Encoding, scoring, node statistics and fitting."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barlab.operators import boosting, model, selection
from barlab.plans.models import sample_ensemble
from barlab.plans.views import FEATURES


def walk_row(tree, x):
    i = 0
    while tree.left[i] >= 0:
        i = tree.left[i] if x[tree.feature[i]] <= tree.threshold[i] else tree.right[i]
    return i


@pytest.fixture(scope="module")
def inputs(spark):
    g = np.random.default_rng(7)
    pdf = pd.DataFrame(g.integers(9900, 10101, (2000, len(FEATURES))), columns=list(FEATURES)).astype("int32")
    pdf.insert(0, "date", [dt.date(2024, 1, 1) + dt.timedelta(days=int(d)) for d in g.integers(0, 20, 2000)])
    pdf.insert(1, "code", range(2000))
    pdf["formula_input_valid"] = g.random(2000) < 0.9
    pdf["target"] = (pdf.F1 > 10010) * 1.0 - 0.3 + g.normal(0, 0.1, 2000)
    pdf["weight"] = 1 / pdf.groupby("date").code.transform("size")
    return pdf, spark.createDataFrame(pdf)


def test_encoding_bounds_and_missing(spark):
    df = spark.createDataFrame(
        [(0.0, True), (-1000.0, True), (1e9, True), (0.0049, True), (float("nan"), True), (1.0, False)], "x double, formula_input_valid boolean")
    assert [r["x"] for r in model.encode(df, ["x"]).collect()] == [10000, 0, 999999, 10000, None, None]
    assert model.encode(df.limit(1), ["x"], multiplier=10).first()["x"] == 100000


@pytest.mark.parametrize("n", [1, 8, 64])
def test_scores_equal_a_node_walk(inputs, n):
    pdf, df = inputs
    e = sample_ensemble(n)
    got = model.score(df, e).select("code", "score").toPandas().set_index("code").score.sort_index()
    for code, row in pdf.iterrows():
        x = row[list(FEATURES)].to_numpy()
        want = e.bias + sum(e.learning_rate * t.value[walk_row(t, x)] for t in e.trees)
        if row.formula_input_valid:
            assert abs(got[code] - want) < 2e-11
        else:
            assert pd.isna(got[code])


def test_node_stats_match_brute_force(inputs):
    pdf, df = inputs
    e = sample_ensemble(3)
    got = model.node_stats(df, e).toPandas().set_index(["tree_id", "node_id"])
    score = np.full(len(pdf), e.bias)
    seen = 0
    for t, tree in enumerate(e.trees):
        leaves = np.array([walk_row(tree, x) for x in pdf[list(FEATURES)].to_numpy()])
        residual = pdf.target.to_numpy() - score
        for node in range(15):
            mask = np.array([node in tree.path(leaf) for leaf in leaves])
            if not mask.any():
                continue
            seen += 1
            row, w = got.loc[(t, node)], pdf.weight.to_numpy()[mask]
            mean = np.average(residual[mask], weights=w)
            assert row.node_rows == mask.sum() and row.days == pdf.date[mask].nunique()
            assert row.weight == pytest.approx(w.sum()) and row.residual_mean == pytest.approx(mean, abs=2e-10)
            assert row.residual_variance == pytest.approx(np.average((residual[mask] - mean) ** 2, weights=w), abs=2e-10)
        score += e.learning_rate * np.array([tree.value[leaf] for leaf in leaves])
    assert seen == len(got)


def plain_tree(x, w, r, depth, least, scale):
    """Exhaustive search: (feature, threshold) by place in the full tree and the rows of every node."""
    held, cuts = {0: np.arange(len(r))}, {}
    score = lambda i: (w[i] @ r[i]) ** 2 / w[i].sum()
    for place in range(2 ** depth - 1):
        if place not in held:
            continue
        rows, best = held[place], None
        for f in range(x.shape[1]):
            values = np.unique(x[rows, f])
            for low, high in zip(values, values[1:]):
                left, right = rows[x[rows, f] <= low], rows[x[rows, f] > low]
                if len(left) >= least and len(right) >= least:
                    gain = round((score(left) + score(right) - score(rows)) / scale, 9)
                    if best is None or gain > best[0]:
                        best = (gain, f, (low + high) / 2, left, right)
        if best and best[0] > 0:
            cuts[place], held[2 * place + 1], held[2 * place + 2] = best[1:3], best[3], best[4]
    return cuts, held


@pytest.mark.parametrize(("parts", "least", "depth"), [(1, 300, 3), (7, 40, 2), (3, 900, 3)])
def test_fit_equals_a_plain_search(inputs, parts, least, depth):
    pdf, df = inputs
    few = [*FEATURES[:3]]
    coarse = pdf.assign(**{n: pdf[n] // 4 for n in few})
    fitted = boosting.fit_boosted(df.sparkSession.createDataFrame(coarse).repartition(parts), few, trees=4, depth=depth, min_leaf_rows=least,
                                  learning_rate=0.3, cut_every=2)
    x, w, y = coarse[few].to_numpy(), pdf.weight.to_numpy(), pdf.target.to_numpy()
    assert fitted.bias == pytest.approx(np.average(y, weights=w))
    r = y - fitted.bias
    scale = w @ (r * r)
    for tree in fitted.trees:
        cuts, held = plain_tree(x, w, r, depth, least, scale)
        order = sorted(held)
        assert [(f, t) for f, t in zip(tree.feature, tree.threshold)] == [cuts.get(i, (-1, 0.0)) for i in order]
        assert list(tree.rows) == [len(held[i]) for i in order]
        for k, i in enumerate(order):
            mean = np.average(r[held[i]], weights=w[held[i]])
            assert tree.value[k] == pytest.approx(mean, abs=1e-9) and tree.weight[k] == pytest.approx(w[held[i]].sum())
            assert tree.impurity[k] == pytest.approx(np.average((r[held[i]] - mean) ** 2, weights=w[held[i]]), abs=1e-9)
        for k, i in enumerate(order):
            if i not in cuts:
                r[held[i]] -= 0.3 * tree.value[k]


def test_equal_cuts_go_to_the_earlier_feature_and_incomplete_rows_take_no_part(spark):
    rows = [(i, i, float(i > 5), 1.0) for i in range(12)] + [(None, 3, 9.0, 1.0), (3, 3, None, 1.0), (3, 3, 9.0, None)]
    df = spark.createDataFrame(rows, "a int, b int, target double, weight double")
    tree = boosting.fit_boosted(df, ["b", "a"], trees=1, depth=1, min_leaf_rows=1).trees[0]
    assert tree == model.Tree((0, -1, -1), (5.5, 0.0, 0.0), (1, -1, -1), (2, -1, -1), (0.0, -0.5, 0.5), (12, 6, 6), (12.0, 6.0, 6.0), (0.25, 0.0, 0.0))
    same = boosting.fit_boosted(df, ["a"], trees=2, depth=3, min_leaf_rows=7).trees
    assert [t.left for t in same] == [(-1,), (-1,)]
    with pytest.raises(ValueError):
        boosting.fit_boosted(df.limit(0), ["a"])


def test_what_a_fit_stored_agrees_with_its_rows_and_a_change_is_seen(inputs):
    pdf, df = inputs
    fitted = boosting.fit_boosted(df, FEATURES, trees=3)
    observed = model.node_stats(df, fitted)
    flags = ["rows_agree", "weight_agrees", "value_agrees", "impurity_agrees"]
    nodes = model.tree_table(df.sparkSession, fitted)
    found = model.node_audit(nodes, observed).toPandas()
    assert found[flags].all().all() and len(found) == sum(len(t.left) for t in fitted.trees)
    broken = nodes.withColumn("value", F.expr("value + if(tree_id = 1 and node_id = 2, 1e-6, 0)")).where("tree_id < 2 or node_id <> 1")
    found = model.node_audit(broken, observed).toPandas().set_index(["tree_id", "node_id"])
    assert not found.value_agrees[(1, 2)] and found.rows_agree[(1, 2)] and not found.rows_agree[(2, 1)]


def test_variances_do_not_depend_on_the_size_of_the_target(inputs):
    pdf, df = inputs
    far = df.withColumn("target", F.col("target") + 1e6).withColumn("half", F.lit("h"))
    e = sample_ensemble(2)
    a, b = (model.node_stats(rows, e).toPandas().set_index(["tree_id", "node_id"]).residual_variance.sort_index() for rows in (df, far))
    assert np.allclose(a, b, rtol=1e-6)
    got = model.weighted_moments(far, "target", "weight", ["half"]).first()
    mean = np.average(pdf.target, weights=pdf.weight)
    assert got["weighted_variance"] == pytest.approx(np.average((pdf.target - mean) ** 2, weights=pdf.weight), rel=1e-6)


def test_replay_walks_the_table_and_catches_one_changed_cut(inputs):
    pdf, df = inputs
    e = sample_ensemble(5)
    nodes = model.tree_table(df.sparkSession, e)
    scored = model.score(df, e)
    walk_of = lambda table, depth=3: model.descend(df, table, e.bias, e.learning_rate, FEATURES, depth)
    same = model.score_replay(scored, walk_of(nodes), 0.15).first()
    assert (same["missing_mismatch"], same["value_mismatch"], same["scored"]) == (0, 0, int(pdf.formula_input_valid.sum()))
    cut = nodes.withColumn("threshold", F.expr("threshold + if(tree_id = 2 and node_id = 1, 25, 0)"))
    assert model.score_replay(scored, walk_of(cut), 0.15).first()["value_mismatch"] > 0
    assert walk_of(nodes, 2).where("score is not null").count() == 0
    assert model.score_replay(scored, walk_of(nodes.where("not (tree_id = 0 and node_id = 9)")), 0.15).first()["missing_mismatch"] > 0


def test_model_must_name_the_declared_features():
    e = sample_ensemble(1)
    with pytest.raises(ValueError):
        model.bind(e, FEATURES[::-1])
    assert model.bind(e, FEATURES) is e


def test_a_tree_reads_the_feature_at_its_declared_place(spark):
    names = tuple(f"V{i}" for i in range(7))
    rows = [(dt.date(2022, 5, 9), f"{c}", True, *[float(c == i) for i in range(7)]) for c in range(8)]
    schema = "date date, code string, formula_input_valid boolean, " + ", ".join(f"{n} double" for n in names)
    coded = model.encode(spark.createDataFrame(rows, schema), names)
    for place in (0, 3, 6):
        tree = model.Tree((place, -1, -1), (10050.0, 0.0, 0.0), (1, -1, -1), (2, -1, -1), (0.0, 2.0, 8.0))
        scored = model.score(coded, model.Ensemble(1.0, 0.5, names, (tree,)))
        assert {r["code"]: r["score"] for r in scored.collect()} == {str(c): 5.0 if c == place else 2.0 for c in range(8)}
        assert [r["code"] for r in selection.select_fixed(scored, 4.0).collect() if r["selected"]] == [str(place)]


def test_trees_survive_their_table(spark):
    e = sample_ensemble(4)
    assert model.trees_from_table(model.tree_table(spark, e), e.bias, e.learning_rate, FEATURES) == e


def test_node_statistics_copy_no_row_per_tree(inputs):
    plan = model.node_stats(inputs[1], sample_ensemble(3))._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "MapInArrow" in plan


def test_rows_of_equal_keys_each_keep_their_score(inputs):
    pdf, df = inputs
    e = sample_ensemble(2)
    rows = df.where("formula_input_valid").limit(5).withColumn("code", F.lit(1)).withColumn("date", F.lit("2024-01-01").cast("date"))
    assert model.descend(rows, model.tree_table(df.sparkSession, e), e.bias, e.learning_rate, FEATURES, 3).where("score is not null").count() == 5


def test_equal_training_rows_are_held_once(inputs, monkeypatch):
    pdf, df = inputs
    held, grow = [], boosting.grow
    monkeypatch.setattr(boosting, "grow", lambda rows, *a: held.append(rows.count()) or grow(rows, *a))
    few = df.where("code < 40").select(*FEATURES, "target", "weight")
    once = boosting.fit_boosted(few, FEATURES, trees=1, min_leaf_rows=5)
    many = boosting.fit_boosted(few.unionByName(few).unionByName(few), FEATURES, trees=1, min_leaf_rows=15)
    assert held == [40, 40] and once.trees[0].feature == many.trees[0].feature and [3 * n for n in once.trees[0].rows] == list(many.trees[0].rows)


def test_training_rows_of_equal_codes_are_held_once_whatever_their_targets(inputs, monkeypatch):
    pdf, df = inputs
    held, grow = [], boosting.grow
    monkeypatch.setattr(boosting, "grow", lambda rows, *a: held.append(rows.count()) or grow(rows, *a))
    few = df.where("code < 40").select(*FEATURES, "target", "weight")
    boosting.fit_boosted(few.unionByName(few.withColumn("target", F.col("target") + 0.5)), FEATURES, trees=1, min_leaf_rows=5)
    assert held == [40]


@pytest.mark.parametrize("span", [0, 1 << 20])
def test_a_table_and_a_sort_count_the_same_cells(inputs, monkeypatch, span):
    """Targets far from zero, and codes that are too far apart for a table where ``span`` is 0."""
    pdf, df = inputs
    plain = boosting.fit_boosted(df, FEATURES, trees=2)
    monkeypatch.setattr(boosting, "SPAN", span)
    far = boosting.fit_boosted(df.withColumn("target", F.col("target") + 1e6), FEATURES, trees=2)
    for a, b in zip(plain.trees, far.trees):
        assert (a.feature, a.threshold, a.rows) == (b.feature, b.threshold, b.rows)
        assert a.value == pytest.approx(b.value, abs=1e-8) and a.impurity == pytest.approx(b.impurity, abs=1e-8)
