"""Window operators over ordered rows of a key; time is an integer, so that frame edges are exact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallgrass.staging import ordered_blocks


def trailing_mean(value: Column, key: str, at: str, width: int) -> Column:
    """Mean over (t - width, t]; rows at one instant share the value."""
    return F.avg(value).over(Window.partitionBy(key).orderBy(at).rangeBetween(-width + 1, 0))


def row_mean(value: Column, key: str, order: list[str], rows: int, least: int = 1) -> Column:
    """Mean of the last ``rows`` rows; null until ``least`` values are there."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(-(rows - 1), 0)
    return F.when(F.count(value).over(w) >= least, F.avg(value).over(w))


def centred_band(df: DataFrame, value: str, key: str, order: list[str], rows: int, low: float = -1.0, high: float = 1.0) -> DataFrame:
    """``mean``, ``lower`` and ``upper`` of a centred window: mean and 1.96 deviations, held within [low, high].

    An even window has its extra row before the middle.
    """
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(-(rows // 2), (rows - 1) // 2)
    mean, sd = F.avg(value).over(w), F.coalesce(F.stddev_samp(value).over(w), F.lit(0.0))
    hold = lambda c: F.greatest(F.lit(low), F.least(F.lit(high), c))
    return df.withColumns({"mean": hold(mean), "lower": hold(mean - 1.96 * sd), "upper": hold(mean + 1.96 * sd)})


def filled(value: str, key: str, order: list[str]) -> Column:
    """Nulls filled from the next value of the key, and after the last one from the one before."""
    ahead = Window.partitionBy(key).orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    behind = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return F.coalesce(F.first(value, ignorenulls=True).over(ahead), F.last(value, ignorenulls=True).over(behind))


def run_number(value: Column, key: str, order: list[str]) -> Column:
    """Number of the run of equal values a row belongs to, from 1; null is a value of its own."""
    w = Window.partitionBy(key).orderBy(*order)
    before = F.lag(F.struct(value.alias("v"))).over(w)
    new = before.isNull() | ~before["v"].eqNullSafe(value)
    return F.sum(new.cast("bigint")).over(w.rowsBetween(Window.unboundedPreceding, 0))


def early_half(key: str, at: str) -> Column:
    """True before the midpoint of the key's span."""
    w = Window.partitionBy(key)
    return F.col(at) * 2 < F.min(at).over(w) + F.max(at).over(w)


def centred_on_group(value: Column, weight: Column, group: str) -> Column:
    """Value less its group's weighted mean."""
    w = Window.partitionBy(group)
    return value - F.sum(value * weight).over(w) / F.sum(weight).over(w)


def category_rank(column: Column, ranks: dict[str, int]) -> Column:
    """The place of a category in an order of one's own; categories without one come last."""
    table = F.create_map(*[F.lit(x) for pair in ranks.items() for x in pair])
    return F.coalesce(F.try_element_at(table, column), F.lit(max(ranks.values(), default=0) + 1))


def at_position(df: DataFrame, order: list[str], place: int):
    """The row at a place (from 0) of the total order ``order``, or None beyond the end.

    Blocks are counted, and only the one that holds the place gives a row; nothing is sorted in one task.
    """
    placed = ordered_blocks(df.select(*order), order)
    before = 0
    for r in sorted(placed.groupBy("_block").count().collect()):  # one row per block
        if place < before + r["count"]:
            return placed.where((F.col("_block") == r["_block"]) & (F.col("_pos") == place - before)).first()
        before += r["count"]
    return None
