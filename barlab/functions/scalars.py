"""Scalar column helpers shared by all operators. All of them stay JVM-side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def finite(c: Column) -> Column:
    """True only for a value that is neither NULL, NaN nor infinite; never NULL itself."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def finite_or_null(c: Column) -> Column:
    return F.when(finite(c), c)


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing is NULL inside the engine: NaN sorts above every number in Spark."""
    floating = (T.DoubleType, T.FloatType)
    return df.select(*[
        F.when(~F.isnan(f.name), F.col(f.name)).alias(f.name)
        if isinstance(f.dataType, floating) else F.col(f.name)
        for f in df.schema.fields
    ])


def ratio(n: Column, d: Column) -> Column:
    """Division that yields NULL for a zero denominator (ANSI division raises)."""
    return F.try_divide(n.cast("double"), d.cast("double"))


def flag(c: Column) -> Column:
    """Three-valued flag to a plain boolean; unknown counts as false."""
    return F.coalesce(c, F.lit(False))


def tidy(c: Column, places: int = 9) -> Column:
    """Rounded output value without a negative zero.

    Means of short decimals often end exactly halfway between two roundings, where the
    last bit of a sum decides. The nudge, far below the last place, moves such values
    off the tie so that every summation order rounds alike.
    """
    return F.round(c + F.lit(float(f"4e-{places + 4}")), places) + F.lit(0.0)


def half_of(date: Column) -> Column:
    return F.concat(F.year(date).cast("string"), F.when(F.month(date) <= 6, "H1").otherwise("H2"))


def quarter_of(date: Column) -> Column:
    return F.concat(F.year(date).cast("string"), F.lit("Q"), F.quarter(date).cast("string"))


def year_of(date: Column) -> Column:
    return F.year(date).cast("string")


def week_of(date: Column) -> Column:
    """Monday of the ISO week."""
    return F.date_trunc("week", date).cast("date")


PERIOD_KINDS = {"half": half_of, "quarter": quarter_of, "year": year_of}


def in_period(date: Column, name: str) -> Column:
    """Predicate for one named period: ``2024``, ``2024H1`` or ``2024Q3``."""
    if "H" in name:
        return half_of(date) == name
    if "Q" in name:
        return quarter_of(date) == name
    return F.year(date) == int(name)


def explode_periods(daily: DataFrame, kinds: tuple[str, ...] = ("half", "year")) -> DataFrame:
    """One copy of each day per period it belongs to, so all periods group in one pass."""
    names = [PERIOD_KINDS[k](F.col("date")) for k in kinds]
    return daily.withColumn("period", F.explode(F.array(*names)))


def on_cent_grid(price: Column, tolerance: float = 1e-4) -> Column:
    return F.abs(price - F.round(price, 2)) <= tolerance


def row_max(*cols: Column) -> Column:
    """Largest non-NULL of several columns; inputs must already be free of NaN."""
    return F.greatest(*cols)


def valid_iso_date(text: Column) -> Column:
    """True for text that is exactly a calendar date in ISO form."""
    parsed = F.try_to_date(text, "yyyy-MM-dd")
    return flag(F.date_format(parsed, "yyyy-MM-dd") == text)
