"""Data contracts as tables of ``(check, passed, violations)``."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlab.functions.scalars import finite, flag
from barlab.operators.grouping import frame_difference


class ContractError(ValueError):
    """A required data contract does not hold."""


def as_checks(counts: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row of violation counts to one row per check."""
    records = F.array(*[F.struct(F.lit(n).alias("check"), F.coalesce(F.col(n), F.lit(0)).cast("long")
                                 .alias("violations")) for n in names])
    return counts.select(F.inline(records)).select(
        "check", (F.col("violations") == 0).alias("passed"), "violations")


def duplicate_keys(rows: DataFrame, keys: Sequence[str] = ("date", "code")) -> DataFrame:
    return rows.groupBy(*keys).count().where("count > 1")


def row_checks(rows: DataFrame, conditions: Mapping[str, Column]) -> DataFrame:
    """All row-level checks in one aggregation; a condition is what every row must satisfy."""
    counts = rows.agg(*[F.count_if(~flag(c)).alias(n) for n, c in conditions.items()])
    return as_checks(counts, list(conditions))


def key_check(rows: DataFrame, keys: Sequence[str] = ("date", "code"), name: str = "unique_key") -> DataFrame:
    return as_checks(duplicate_keys(rows, keys).agg(F.count(F.lit(1)).alias(name)), [name])


def count_check(rows: DataFrame, expected: Mapping[str, tuple[Column, int]]) -> DataFrame:
    """Declared counts: violation is the distance from the declared number."""
    counts = rows.agg(*[F.abs(F.count_if(c) - n).alias(name) for name, (c, n) in expected.items()])
    return as_checks(counts, list(expected))


def in_domain(column: str, allowed: Sequence, when: Column | None = None) -> Column:
    inside = F.col(column).isin(*allowed)
    return inside if when is None else ~flag(when) | inside


def finite_when(column: str, when: Column) -> Column:
    return ~flag(when) | finite(F.col(column).cast("double"))


def within_dates(first: str, end: str, column: str = "date") -> Column:
    """``first`` inclusive, ``end`` exclusive."""
    return (F.col(column) >= F.lit(first).cast("date")) & (F.col(column) < F.lit(end).cast("date"))


def require(checks: DataFrame) -> None:
    """Raise when any check failed, with all of them: there is one row per check."""
    failed = checks.where("not passed").collect()
    if failed:
        raise ContractError("; ".join(f"{r['check']}: {r['violations']}" for r in failed))


def one_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join whose keys must be unique on both sides; repeated keys raise.

    The check reads only the key columns and counts them with partial aggregation.
    """
    require(key_check(left, keys, "left_key").unionByName(key_check(right, keys, "right_key")))
    return left.join(right, list(keys), how)


def only_once(rows: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """The rows, whose ``column`` raises when it is read where the keys stand more than once.

    Lazy, for the result of a join on the same keys: it finds them together already.
    """
    copies = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    kind = rows.schema[column].dataType
    return rows.withColumn(column, F.when(copies > 1, F.raise_error(F.lit(f"repeated key {tuple(keys)}")).cast(kind)).otherwise(F.col(column)))


def equality_check(a: DataFrame, b: DataFrame, name: str = "frames_equal") -> DataFrame:
    """Exact equality as multisets of rows."""
    diff = frame_difference(a, b).agg(F.sum(F.abs("surplus")).alias(name))
    return as_checks(diff, [name])


def tolerance_check(a: DataFrame, b: DataFrame, keys: Sequence[str], values: Sequence[str],
                    tolerance: float, name: str = "frames_close") -> DataFrame:
    """Same keys, and every value equal within the tolerance or missing on both sides."""
    keys = list(keys)
    left = a.select(*keys, F.lit(1).alias("_l"), *[F.col(v).alias(f"a_{v}") for v in values])
    right = b.select(*keys, F.lit(1).alias("_r"), *[F.col(v).alias(f"b_{v}") for v in values])
    joined = left.join(right, keys, "full_outer")
    same = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    for v in values:
        x, y = F.col(f"a_{v}"), F.col(f"b_{v}")
        same = same & ((x.isNull() & y.isNull()) | flag(F.abs(x - y) <= tolerance))
    return as_checks(joined.agg(F.count_if(~same).alias(name)), [name])


def case_collisions(columns: Sequence[str]) -> list[str]:
    """Column names that differ only by case."""
    folded = [c.casefold() for c in columns]
    return sorted(c for c in columns if folded.count(c.casefold()) > 1)
