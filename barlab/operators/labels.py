"""Entry prices, first-event labels and training targets."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlab.functions.scalars import finite, flag, ratio
from barlab.operators.bars import Clocks
from barlab.operators.contracts import only_once
from barlab.operators.grouping import small_by_day, with_day_stats

# Fixed values of the label definition.
LOT_VALUE = 20_000.0      # money per position at the decision price
LOT_SIZE = 100            # shares per lot
VOLUME_SHARE = 0.10       # share of the entry bars' volume that may be bought
RUN_LENGTH = 3            # consecutive closes that make an opportunity
ADVERSE_MOVE = 0.03
SPACE_MOVE = 0.01
MIN_SLIPPAGE = 0.005      # half a cent


def strictly_before(first: Column, other: Column) -> Column:
    """``first`` happened (offset >= 0) and ``other`` never did or did so strictly later."""
    return (first >= 0) & ((other < 0) | (first < other))


def entry_prices(bars: DataFrame, clocks: Clocks, bps: float, volume_unit: int = 1) -> DataFrame:
    """Lots fixed at the decision price, bought at the average price of the entry bars.

    ``volume_unit`` is the number of shares per unit of bar volume. Cost adds the
    stress in basis points, but never less than half a cent.
    """
    decided = F.max(F.when(F.col("slot") == clocks.decision, F.col("close")))
    inside = F.col("slot").isin(*clocks.entry_slots)
    money = F.sum(F.when(inside, F.col("amount")))
    volume = F.sum(F.when(inside, F.col("volume")))
    day = bars.groupBy("code", "date").agg(
        decided.alias("decision_price"), money.alias("_money"), volume.alias("entry_volume"),
        F.count_if(inside).alias("entry_bars"))
    out = day.where(F.col("decision_price").isNotNull()).withColumns({
        "decision_shares": (F.floor(ratio(F.lit(LOT_VALUE), F.col("decision_price") * LOT_SIZE))
                            * LOT_SIZE).cast("long"),
        "entry_price": ratio(F.col("_money"), F.col("entry_volume") * volume_unit),
        "capacity": F.floor(F.col("entry_volume") * volume_unit * VOLUME_SHARE).cast("long"),
    })
    slip = F.greatest(F.col("entry_price") * (bps / 10_000), F.lit(MIN_SLIPPAGE))
    return out.withColumns({
        "entry_cost": F.col("entry_price") + slip,
        "fits_capacity": flag(F.col("decision_shares") <= F.col("capacity")),
    }).drop("_money")


def market_calendar(bars: DataFrame) -> DataFrame:
    """Every trading date with the next one: one row per date, so one window is enough."""
    days = bars.select("date").distinct()
    return days.withColumn("next_date", F.lead("date").over(Window.orderBy("date")))


def watch_window(bars: DataFrame, entries: DataFrame, clocks: Clocks) -> DataFrame:
    """Bars of the next trading morning joined to the entries they are judged against."""
    calendar = small_by_day(market_calendar(bars))
    return watched_bars(bars, entries.join(calendar, "date").where("next_date is not null"), clocks)


def watched_bars(bars: DataFrame, due: DataFrame, clocks: Clocks, how: str = "inner") -> DataFrame:
    """The bars of the watch window of each entry's ``next_date``; ``how="left"`` keeps entries without a bar."""
    watched = (bars.where(F.col("slot").between(clocks.watch_first, clocks.watch_last))
               .select("code", F.col("date").alias("next_date"), "slot", "high", "low", "close", "volume")
               .withColumn("offset", F.col("slot") - clocks.watch_first))
    return due.join(watched, ["code", "next_date"], how)


def first_run(window: Window, good: Column, offset: Column, length: int) -> Column:
    """Offset at which ``length`` consecutive rows have all satisfied ``good``."""
    frame = window.rowsBetween(-(length - 1), 0)
    full = F.count(F.lit(1)).over(frame) == length
    hits = F.sum(F.when(good, 1).otherwise(0)).over(frame)
    return F.when(full & (hits == length), offset)


def order_labels(watched: DataFrame, expected_bars: int) -> DataFrame:
    """First positive run, first one-percent run, first adverse quote and window marks per entry.

    -1 means never. A key is known only when the whole window was seen.
    """
    w = Window.partitionBy("code", "date").orderBy("offset")
    active = F.col("volume") > 0
    positive = active & (F.col("close") > F.col("entry_cost"))
    space = active & (F.col("close") > F.col("entry_cost") * (1 + SPACE_MOVE))
    adverse = F.col("low") <= F.col("entry_price") * (1 - ADVERSE_MOVE)
    marked = watched.select(
        "date", "code", "next_date", "offset", "low", "close", "entry_price", "entry_cost",
        first_run(w, positive, F.col("offset"), RUN_LENGTH).alias("_pos"),
        first_run(w, space, F.col("offset"), RUN_LENGTH).alias("_space"),
        F.when(adverse, F.col("offset")).alias("_bad"),
        F.when(positive, 1).otherwise(0).alias("_any"))
    never = lambda c: F.coalesce(F.min(c), F.lit(-1)).cast("int")
    out = marked.groupBy("date", "code", "next_date").agg(
        F.count(F.lit(1)).alias("seen_bars"),
        never("_pos").alias("first_positive_end"), never("_space").alias("first_space_end"),
        never("_bad").alias("first_bad3"), F.max("_any").alias("any_opportunity"),
        F.max_by("close", "offset").alias("_last"), F.min("low").alias("_low"),
        F.first("entry_price").alias("entry_price"), F.first("entry_cost").alias("entry_cost"))
    known = F.col("seen_bars") == expected_bars
    event = lambda c: F.when(known, F.when(c, 1).otherwise(0))
    return out.select(
        "date", "code", "next_date", "seen_bars", known.alias("known"),
        *[F.when(known, F.col(c)).alias(c)
          for c in ("first_positive_end", "first_space_end", "first_bad3", "any_opportunity")],
        event(F.col("first_positive_end") >= 0).alias("opportunity"),
        event(F.col("first_space_end") >= 0).alias("one_percent"),
        event(strictly_before(F.col("first_positive_end"), F.col("first_bad3"))).alias("positive_before_bad3"),
        event(strictly_before(F.col("first_space_end"), F.col("first_bad3"))).alias("space_before_bad3"),
        F.when(known, ratio(F.col("_last"), F.col("entry_cost")) - 1).alias("mark_return"),
        F.when(known, ratio(F.col("_low"), F.col("entry_price")) - 1).alias("adverse_return"))


def primary_target(labels: DataFrame, bps: int = 15) -> DataFrame:
    """Training event: the positive run ends strictly before the first adverse quote. A known row without both offsets
    is refused when it is read."""
    end, bad = F.col(f"first_positive_end{bps}"), F.col(f"first_bad3{bps}")
    known = F.col(f"known{bps}")
    return labels.withColumn(
        f"opportunity{bps}",
        F.when(known & (end.isNull() | bad.isNull()), F.raise_error(F.lit("a known row lacks an offset")).cast("double"))
        .when(known, strictly_before(end, bad).cast("double")))


def mature_labels(
    labels: DataFrame,
    start: str | None,
    end: str,
    known: str = "known15",
    split: str | None = None,
    required: str | None = None,
) -> DataFrame:
    """Known labels whose observation closed strictly before ``end``.

    ``split`` also removes rows before it whose observation had not closed by then;
    ``required`` names a column that must be finite.
    """
    keep = F.col(known) & (F.col("next_date") < F.lit(end).cast("date"))
    if start is not None:
        keep = keep & (F.col("date") >= F.lit(start).cast("date"))
    if split is not None:
        at = F.lit(split).cast("date")
        keep = keep & ((F.col("date") >= at) | (F.col("next_date") < at))
    if required is not None:
        keep = keep & finite(F.col(required).cast("double"))
    return labels.where(keep)


ALLOWED_UTILITIES = ((0, 1), (-3, 0, 1), (-1, 0, 1))


def utility_violations(labels: DataFrame, value: str, known: str, allowed: Sequence[int]) -> DataFrame:
    """Rows that break the declared label domain: known outside it, or unknown but filled."""
    if tuple(allowed) not in ALLOWED_UTILITIES:
        raise ValueError("the utility set must be one of the declared ones")
    v = F.col(value)
    bad_known = flag(F.col(known)) & ~flag(v.isin(*[float(a) for a in allowed]))
    return labels.where(bad_known | (~flag(F.col(known)) & v.isNotNull()))


def relative_target(labels: DataFrame, value: str = "opportunity15", variant: str = "relative") -> DataFrame:
    """Label, or label minus the mean of that day's known labels (before any input filter)."""
    if variant == "absolute":
        return labels.select("date", "code", F.col(value).cast("double").alias("target"))
    if variant != "relative":
        raise ValueError(f"unknown target variant {variant!r}")
    centred = with_day_stats(labels, F.avg(value).alias("_mean"))
    return centred.select("date", "code", (F.col(value) - F.col("_mean")).alias("target"))


def training_set(
    features: DataFrame,
    labels: DataFrame,
    start: str | None,
    end: str,
    variant: str = "relative",
    value: str = "opportunity15",
    known: str = "known15",
    allowed: Sequence[int] = (0, 1),
    **purge,
) -> DataFrame:
    """Valid inputs with mature targets and day-equal weights.

    Centring uses all mature known labels; the weight counts the rows that remain. A known
    label outside the declared utility set ``allowed``, and a key that stands twice on either side, is refused
    when it is read.
    """
    if tuple(allowed) not in ALLOWED_UTILITIES:
        raise ValueError("the utility set must be one of the declared ones")
    mature = mature_labels(labels, start, end, known, **purge)
    declared = flag(F.col(value).isin(*[float(a) for a in allowed]))
    mature = mature.withColumn(value, F.when(declared, F.col(value)).otherwise(
        F.raise_error(F.lit(f"a known {value} is outside {tuple(allowed)}")).cast("double")))
    targets = relative_target(mature, value, variant)
    rows = only_once(features.where("formula_input_valid").join(targets, ["date", "code"]), ("date", "code"), "target")
    return with_day_stats(rows, F.count(F.lit(1)).alias("_day_rows")).withColumn(
        "weight", 1.0 / F.col("_day_rows")).drop("_day_rows")


@dataclass(frozen=True)
class Fold:
    """One walk-forward step: twelve months of training, then a half-year to score."""

    id: str
    training_start: str
    split: str
    training_end: str
    evaluation_start: str
    evaluation_end: str


def half_year_folds(first_year: int, last_year: int) -> list[Fold]:
    """Half-year folds; each trains on the twelve months before its own half."""
    def start(n: int) -> str:
        return f"{n // 2}-{'01' if n % 2 == 0 else '07'}-01"

    return [Fold(f"{n // 2}h{n % 2 + 1}", start(n - 2), start(n - 1), start(n), start(n), start(n + 1))
            for n in range(first_year * 2, last_year * 2 + 2)]


def in_folds(rows: DataFrame, folds: Sequence[Fold], role: str, keep: bool = False) -> DataFrame:
    """One copy of a row per fold it trains (``role='training'``) or the one that scores it.

    ``keep`` keeps a row that no fold takes, once, with fold NULL.
    """
    date = F.col("date")
    day = lambda s: F.lit(s).cast("date")
    if role == "training":
        hit = lambda f: (date >= day(f.training_start)) & (F.col("next_date") < day(f.training_end))
    elif role == "evaluation":
        hit = lambda f: (date >= day(f.evaluation_start)) & (date < day(f.evaluation_end))
    else:
        raise ValueError(role)
    ids = F.array_compact(F.array(*[F.when(hit(f), F.lit(f.id)) for f in folds]))
    return rows.withColumn("fold", F.explode_outer(ids) if keep else F.explode(ids))


def affine_relation(a: DataFrame, b: DataFrame, tolerance: float = 2e-12) -> DataFrame:
    """Whether target b equals target a, or a non-zero affine map of it, on the same keys.

    The map is fixed by the rows of smallest and largest a (ties broken by key).
    """
    keys = ["date", "code"]
    joined = a.select(*keys, F.col("target").alias("a")).join(
        b.select(*keys, F.col("target").alias("b")), keys, "full_outer")
    order = F.struct("a", *keys)
    ends = joined.agg(F.min("a").alias("a_lo"), F.max("a").alias("a_hi"),
                      F.min_by("b", order).alias("b_lo"), F.max_by("b", order).alias("b_hi")).first()
    # Two points fix the map, so only these four numbers reach the driver.
    slope = None
    if None not in tuple(ends) and ends["a_hi"] != ends["a_lo"]:
        slope = (ends["b_hi"] - ends["b_lo"]) / (ends["a_hi"] - ends["a_lo"])
    a, b, rate = F.col("a"), F.col("b"), F.lit(slope).cast("double")
    fitted = rate * a + (F.lit(ends["b_lo"]).cast("double") - rate * F.lit(ends["a_lo"]).cast("double"))
    out = joined.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(a.isNull() | b.isNull()).alias("unmatched"),
        F.max(F.abs(a - b)).alias("max_difference"), F.max(F.abs(b - fitted)).alias("max_affine_gap"))
    same = F.col("unmatched") == 0
    return out.select(
        "n", "unmatched", same.alias("same_keys"),
        (same & flag(F.col("max_difference") <= tolerance)).alias("equal"),
        (same & flag(rate != 0) & flag(F.col("max_affine_gap") <= tolerance)).alias("affine"),
        rate.alias("slope"))
