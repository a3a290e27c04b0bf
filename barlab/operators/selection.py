"""Selection lists: score cuts, concentration, and detection of repeated lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlab.functions.scalars import flag, half_of, ratio
from barlab.operators.labels import Fold, in_folds

# Fixed value: the training quantile that sets the cut.
CUT_QUANTILE = 0.995


def select_by_fold(
    scores: DataFrame,
    folds: Sequence[Fold],
    cuts: DataFrame,
    minimum: float | None = None,
) -> DataFrame:
    """One row per candidate with its fold and flag: strictly above the fold's cut. A candidate outside all folds stays, not selected.

    ``cuts`` has one row per fold (fold, threshold); its size is the number of folds
    given. Missing scores are never selected. ``minimum`` raises every cut.
    """
    cut = F.col("threshold")
    if minimum is not None:
        cut = F.when(cut.isNotNull(), F.greatest(cut, F.lit(float(minimum))))       # without a cut of its own nothing is selected
    names = [f.id for f in folds]
    bounded = cuts.where(F.col("fold").isin(*names)).groupBy("fold").agg(F.max("threshold").alias("threshold"))
    placed = in_folds(scores, folds, "evaluation", keep=True).join(F.broadcast(bounded), "fold", "left")
    return placed.withColumn("selected", flag(F.col("score") > cut)).drop("threshold")


def select_fixed(scores: DataFrame, cut: float) -> DataFrame:
    return scores.withColumn("selected", flag(F.col("score") > cut))


def list_concentration(selection: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Days, rows, median and largest day, and the largest day's share of a list."""
    sizes = selection.where("selected").groupBy(*keys, "date").agg(F.count(F.lit(1)).alias("size"))
    out = sizes.groupBy(*keys).agg(
        F.sum("size").alias("selected"), F.count(F.lit(1)).alias("days"),
        F.median("size").alias("median_daily"), F.max("size").alias("max_daily"))
    return out.withColumn("largest_day_fraction", ratio(F.col("max_daily"), F.col("selected")))


def half_counts(selection: DataFrame) -> DataFrame:
    """Rows and distinct days per half-year."""
    return selection.where("selected").groupBy(half_of(F.col("date")).alias("half")).agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("date").alias("days"))


def list_fingerprints(lists: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Size and order-free digest per list; partial sums make it one light shuffle."""
    digest = F.xxhash64(*columns).cast("decimal(38,0)")
    return lists.groupBy("list_id").agg(
        F.count(F.lit(1)).alias("size"), F.sum(digest).alias("digest"),
        F.sum(F.xxhash64(F.lit(1), *columns).cast("decimal(38,0)")).alias("digest2"))


def duplicate_lists(lists: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each list with the first list of identical content: ``(list_id, size, alias_of)``.

    Equal fingerprints only nominate; every nominated list is then compared row by
    row with the first of its group, never with the other copies.
    """
    prints = list_fingerprints(lists, columns)
    same = ["size", "digest", "digest2"]
    firsts = prints.groupBy(*same).agg(F.min("list_id").alias("first_id"))
    nominated = prints.join(firsts, same).select("list_id", "size", "first_id")
    copies = nominated.where("list_id <> first_id")
    names = [f"_content_{c}" for c in columns]
    content = lists.groupBy("list_id", *[F.col(c).alias(n) for c, n in zip(columns, names)]).agg(
        F.count(F.lit(1)).alias("_copies"))
    claimed = copies.join(content, "list_id")
    original = content.withColumnsRenamed({"list_id": "first_id", "_copies": "_first_copies"})
    on = (claimed["first_id"] == original["first_id"]) & (claimed["_copies"] == original["_first_copies"])
    for n in names:
        on = on & claimed[n].eqNullSafe(original[n])
    matched = claimed.join(original, on, "left_semi")
    confirmed = matched.groupBy("list_id").agg(F.sum("_copies").alias("_matched"))
    out = nominated.join(confirmed, "list_id", "left")
    alias = F.when((F.col("list_id") != F.col("first_id")) & flag(F.col("_matched") == F.col("size")),
                   F.col("first_id"))
    return out.select("list_id", "size", alias.alias("alias_of"))


def reuse_summaries(aliases: DataFrame, stored: DataFrame) -> DataFrame:
    """Stored summary rows re-issued under the id of the list that repeats them."""
    found = aliases.where("alias_of is not null").select("list_id", F.col("alias_of").alias("source"))
    return (found.join(stored.withColumnRenamed("list_id", "source"), "source")
            .select("list_id", "source", *[c for c in stored.columns if c != "list_id"]))


def summary_lookup(summaries: DataFrame, **keys) -> DataFrame:
    """The summary rows of one exact key."""
    out = summaries
    for name, value in keys.items():
        out = out.where(F.col(name) == value)
    return out
