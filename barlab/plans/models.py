"""Queries over encoded features and tree ensembles."""

from __future__ import annotations

import dataclasses

from pyspark.sql import functions as F

from barlab.operators import boosting, labels, model
from barlab.operators.grouping import exact_quantiles
from barlab.plans.output import tidied
from barlab.plans.views import FEATURES, features
from barlab.session import cut_lineage, written_once


def sample_ensemble(trees: int = model.FIT["trees"]) -> model.Ensemble:
    """Complete depth-3 trees by rule, with cuts around the middle of the encoded range."""
    built = []
    for t in range(trees):
        inner = [i < 7 for i in range(15)]
        built.append(model.Tree(
            feature=tuple((t * 3 + i * 5) % len(FEATURES) if inner[i] else -1 for i in range(15)),
            threshold=tuple(10000.5 + (t * 37 + i * 53) % 121 - 60 if inner[i] else 0.0 for i in range(15)),
            left=tuple(2 * i + 1 if inner[i] else -1 for i in range(15)),
            right=tuple(2 * i + 2 if inner[i] else -1 for i in range(15)),
            value=tuple(((t * 11 + i * 17) % 23 - 11) / 20 for i in range(15))))
    return model.Ensemble(0.125, model.FIT["learning_rate"], FEATURES, tuple(built))


ENSEMBLE = sample_ensemble()
CUT = 0.1513
TRAIN_START, TRAIN_END = "1996-01-01", "2000-01-01"


def encoded(spark, sf):
    return model.encode(features(spark, sf), FEATURES)


def training_rows(spark, sf):
    rows = encoded(spark, sf)
    inputs = rows.select("date", "code", "half", "formula_input_valid", *FEATURES)
    outcome = rows.select("date", "code", "next_date", "known15", "opportunity15")
    return labels.training_set(inputs, outcome, TRAIN_START, TRAIN_END)


def encode_features(spark, sf):
    return encoded(spark, sf).select("date", "code", "formula_input_valid", *FEATURES)


def encode_features_tenfold(spark, sf):
    rows = model.encode(features(spark, sf), FEATURES, multiplier=10)
    return rows.where("formula_input_valid").select("date", "code", *FEATURES)


def score_trees(spark, sf):
    bound = model.bind(ENSEMBLE, FEATURES)
    return tidied(model.score(encoded(spark, sf), bound).select("date", "code", "half", "score"))


def changed_ensemble() -> model.Ensemble:
    """The sample ensemble with the root cut of its fourth tree moved."""
    trees = list(ENSEMBLE.trees)
    moved = (trees[3].threshold[0] + 40.0, *trees[3].threshold[1:])
    trees[3] = dataclasses.replace(trees[3], threshold=moved)
    return dataclasses.replace(ENSEMBLE, trees=tuple(trees))


def score_replay(spark, sf):
    """Scores of column expressions against the walk of a node table, of the same model and of one with a changed cut."""
    rows = cut_lineage(encoded(spark, sf).select("date", "code", "formula_input_valid", *FEATURES))     # read by both sides, twice
    scored = model.score(rows, ENSEMBLE)
    out = None
    for name, other in (("same", ENSEMBLE), ("changed", changed_ensemble())):
        walked = model.descend(rows, model.tree_table(spark, other), other.bias, other.learning_rate, FEATURES, model.FIT["depth"])
        one = model.score_replay(scored, walked, CUT).withColumn("table", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def quantile_cuts(spark, sf):
    scored = model.score(training_rows(spark, sf), ENSEMBLE)
    return tidied(exact_quantiles(scored, "score", model.QUANTILES, "half"))


def node_stats(spark, sf):
    return tidied(model.node_stats(training_rows(spark, sf), ENSEMBLE), 8)


def weighted_moments(spark, sf):
    return tidied(model.weighted_moments(training_rows(spark, sf), "target", "weight", ["half"]))


def fit_boosted(spark, sf):
    """The fit with the parameters of the library (64 trees of depth 3, leaves of 300 rows), each node against its training rows."""
    rows = written_once(training_rows(spark, sf).select("date", "target", "weight", *FEATURES), "training")     # read by the fit, twice, and by the audit
    fitted = boosting.fit_boosted(rows, FEATURES)
    nodes = model.tree_table(spark, fitted)
    audit = model.node_audit(nodes, model.node_stats(rows, fitted)).drop("days")
    return tidied(nodes.join(audit, ["tree_id", "node_id"], "full_outer"), 7)


QUERIES = {f.__name__: f for f in (
    encode_features, encode_features_tenfold, score_trees, score_replay, quantile_cuts, node_stats,
    weighted_moments, fit_boosted)}
