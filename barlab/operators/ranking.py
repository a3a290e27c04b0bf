"""Within-day rank statistics.

Rows collapse to one cell per (day, score) before anything is ordered, so ties cost
nothing. A day is ordered in bands, whatever its size.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlab.functions.scalars import ratio
from barlab.operators.grouping import BANDS, running_counts

SALTS = 1024        # pieces of a tied score


def average_ranks(rows: DataFrame, score: str = "score", bands: int = BANDS, salts: int = SALTS) -> DataFrame:
    """Rank of each row's score within its day, from 1; ties share their average rank, a NULL score has none.

    A score may hold a large part of a day, so the rank does not travel back over (date, score) alone: rows are
    dealt to salted cells by a hash of their columns, the salted cells (never more than rows) fetch the rank of
    their score, and rows join their salted cell.
    """
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(salts)).cast("int"))
    salted = dealt.where(F.col(score).isNotNull()).groupBy("date", score, "_salt").agg(F.count(F.lit(1)).alias("_part"))
    cells = salted.groupBy("date", score).agg(F.sum("_part").alias("_n"))
    ranked = running_counts(cells, "date", score, ["_n"], bands)
    place = ranked.select(
        "date", score, (F.col("_n_below") + 1).alias("rank"),
        (F.col("_n_below") + (F.col("_n") + 1) / 2).alias("average_rank"))
    spread = salted.join(place, ["date", score]).select("date", score, "_salt", "rank", "average_rank")
    return dealt.join(spread, ["date", score, "_salt"], "left").drop("_salt")


def pair_statistics(
    rows: DataFrame,
    contrasts: Mapping[str, Sequence[tuple[Column, Column]]],
    score: str = "score",
    bands: int = BANDS,
) -> DataFrame:
    """Ordered-pair counts per day for several contrasts, in one pass over the rows.

    A contrast is a list of (higher class, lower class) conditions. For each,
    ``_pairs`` counts pairs of one higher and one lower row and ``_numerator2`` is
    twice the number of pairs in which the higher row also scores higher, ties
    counting one. ``_auc`` is NULL on days without a pair.
    """
    classes = [(f"{name}_{i}_{side}", condition)
               for name, parts in contrasts.items() for i, part in enumerate(parts)
               for side, condition in zip(("h", "l"), part)]
    cells = rows.groupBy("date", score).agg(
        F.count(F.lit(1)).alias("_rows"), *[F.count_if(c).alias(n) for n, c in classes])
    lows = [n for n, _ in classes if n.endswith("_l")]
    ranked = running_counts(cells, "date", score, lows, bands)
    sums = [F.sum("_rows").alias("rows")]
    for name, parts in contrasts.items():
        for i in range(len(parts)):
            h, l = F.col(f"{name}_{i}_h"), F.col(f"{name}_{i}_l")
            sums.append(F.sum(h).alias(f"{name}_{i}_nh"))
            sums.append(F.sum(l).alias(f"{name}_{i}_nl"))
            sums.append(F.sum(h * (2 * F.col(f"{name}_{i}_l_below") + l)).alias(f"{name}_{i}_num"))
    days = ranked.groupBy("date").agg(*sums)
    total = lambda terms: sum(terms[1:], terms[0])
    out = ["date", "rows"]
    for name, parts in contrasts.items():
        each = range(len(parts))
        pairs = total([F.col(f"{name}_{i}_nh") * F.col(f"{name}_{i}_nl") for i in each])
        wins = total([F.col(f"{name}_{i}_num") for i in each])
        out += [pairs.alias(f"{name}_pairs"), wins.alias(f"{name}_numerator2"),
                ratio(wins, 2 * pairs).alias(f"{name}_auc")]
    return days.select(*out)


def daily_auc(rows: DataFrame, labels: Sequence[str], score: str = "score", bands: int = BANDS) -> DataFrame:
    """Within-day AUC for 0/1 labels."""
    contrasts = {n: [(F.col(n) == 1, F.col(n) == 0)] for n in labels}
    return pair_statistics(rows, contrasts, score, bands)


def ordinal_auc(rows: DataFrame, utility: str = "utility", score: str = "score", bands: int = BANDS,
                levels: Sequence[int] = (-3, 0, 1)) -> DataFrame:
    """Within-day AUC over ordered categories; only their order enters, not their size."""
    u = F.col(utility)
    parts = [(u == hi, u == lo) for j, hi in enumerate(levels) for lo in levels[:j]]
    return pair_statistics(rows, {utility: parts}, score, bands)
