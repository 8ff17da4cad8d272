"""Totals and averages over trailing periods per entity and day, days without activity included."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PERIODS = (7, 30)


def is_blank(column: str | Column) -> Column:
    """True for null and for text of nothing but blanks of any kind."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.length(F.regexp_replace(c, r"[\s\p{Z}]+", "")) == 0, F.lit(True))


def daily_totals(readings: DataFrame, width: int = 4) -> DataFrame:
    """Sparse daily totals: filter_value, day (integer days since 1970), readings, c0..c{width-1}.

    A reading counts if ``filter_value`` isn't blank, ``createtime`` isn't null and the first value of ``x0`` is
    neither null nor NaN. A repeated row (same account, time and values) counts once. In other components null
    and NaN add nothing. Copies collapse before the shuffle, so neither a busy account nor a group of copies is
    collected anywhere.
    """
    first = F.try_element_at("x0", F.lit(1))
    valid = readings.where(~is_blank("filter_value") & F.col("createtime").isNotNull() & first.isNotNull() & ~F.isnan(first))
    once = valid.groupBy("filter_value", "createtime", "x0").agg(F.lit(1).alias("_one"))
    day = F.datediff(F.col("createtime").cast("date"), F.lit("1970-01-01").cast("date"))
    parts = [F.coalesce(F.nanvl(F.try_element_at("x0", F.lit(i + 1)), F.lit(0.0)), F.lit(0.0)).alias(f"c{i}") for i in range(width)]
    flat = once.select("filter_value", day.alias("day"), *parts)
    return flat.groupBy("filter_value", "day").agg(F.count("*").alias("readings"), *[F.sum(f"c{i}").alias(f"c{i}") for i in range(width)])


def with_inactive_days(daily: DataFrame) -> DataFrame:
    """``daily`` with a row of zeros for each day between an account's first and last reading that has none.

    Each day brings the empty days up to the next one, so no calendar is joined.
    """
    zeros = [c for c in daily.columns if c not in ("filter_value", "day")]
    ahead = F.lead("day").over(Window.partitionBy("filter_value").orderBy("day"))
    spread = daily.withColumn("_end", F.coalesce(ahead - 1, F.col("day"))).withColumn("_day", F.explode(F.sequence("day", "_end")))
    own = F.col("_day") == F.col("day")
    return spread.select(
        "filter_value", F.col("_day").alias("day"), *[F.when(own, F.col(c)).otherwise(F.lit(0).cast(daily.schema[c].dataType)).alias(c) for c in zeros]
    )


def trailing_totals(readings: DataFrame, periods: tuple[int, ...] = PERIODS, width: int = 4) -> DataFrame:
    """For every account and day from its first to its last reading: totals and averages over trailing periods.

    Columns: filter_value, day (date), readings, and for each period P ``readings_P``, ``sum_P_i`` and ``avg_P_i``
    for each component i. A period of P days ends with the day itself; the average divides by P, whether or not
    the days had readings and also where the account is younger than P days. Frames are ranges over integer day
    numbers. An empty table gives no rows.
    """
    dense = with_inactive_days(daily_totals(readings, width))
    out = dense
    columns = {}
    for p in periods:
        frame = Window.partitionBy("filter_value").orderBy("day").rangeBetween(-(p - 1), 0)
        columns[f"readings_{p}"] = F.sum("readings").over(frame)
        for i in range(width):
            columns[f"sum_{p}_{i}"] = F.sum(f"c{i}").over(frame)
            columns[f"avg_{p}_{i}"] = F.sum(f"c{i}").over(frame) / F.lit(float(p))
    out = out.withColumns(columns)
    return out.select("filter_value", F.date_add(F.lit("1970-01-01").cast("date"), F.col("day")).alias("day"), "readings", *columns)


def quiet_days(readings: DataFrame, short: int = 7, long: int = 30) -> DataFrame:
    """Days with no reading in the ``short`` days that end with them but one in the ``long`` days: (filter_value, day)."""
    totals = trailing_totals(readings, (short, long), width=0)
    quiet = totals.where((F.col(f"readings_{short}") == 0) & (F.col(f"readings_{long}") > 0))
    return quiet.select("filter_value", F.date_format("day", "yyyy-MM-dd").alias("day"))
