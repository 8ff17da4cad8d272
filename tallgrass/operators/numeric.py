"""Special functions as column expressions, and exact running sums without a task that holds everything."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallgrass.staging import ordered_blocks

# The rational series of the complementary error function, relative error below 1.2e-7.
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def erfc(x: Column) -> Column:
    """Complementary error function."""
    z = F.abs(x)
    t = 1 / (1 + 0.5 * z)
    inner = F.lit(ERFC[-1])
    for c in ERFC[-2::-1]:
        inner = c + t * inner
    tail = t * F.exp(-z * z + inner)
    return F.when(x >= 0, tail).otherwise(2 - tail)


def normal_cdf(x: Column) -> Column:
    return 0.5 * erfc(-x / math.sqrt(2))


def normal_pdf(x: Column) -> Column:
    return F.exp(-x * x / 2) / math.sqrt(2 * math.pi)


def log_interval(low: Column, high: Column) -> Column:
    """Logarithm of the normal probability between two bounds; both are mirrored where they lie above zero, so that a
    far tail loses no digits."""
    a = F.when(low > 0, -high).otherwise(low)
    b = F.when(low > 0, -low).otherwise(high)
    return F.log(F.greatest(normal_cdf(b) - normal_cdf(a), F.lit(1e-300)))


def log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function for x > 0, by Stirling's series eight steps up: 1e-13 or better."""
    y = x + 8
    steps = x
    for i in range(1, 8):
        steps = steps * (x + i)
    series = 1 / (12 * y) - 1 / (360 * F.pow(y, 3)) + 1 / (1260 * F.pow(y, 5)) - 1 / (1680 * F.pow(y, 7))
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series - F.log(steps)


def chi2_tail(x: Column, df: Column, most: int = 30) -> Column:
    """Chance of a chi-square above ``x`` with a whole number ``df`` (1 to ``most``) of degrees of freedom; null beyond."""
    h = x / 2
    even, odd = F.exp(-h), erfc(F.sqrt(h))
    term_even, term_odd = F.exp(-h), F.exp(-h) * F.sqrt(h) / math.gamma(1.5)
    out = F.when(df == 1, odd).when(df == 2, even)
    for k in range(3, most + 1):
        if k % 2:
            odd = odd + term_odd
            out = out.when(df == k, odd)
            term_odd = term_odd * h / (k / 2)
        else:
            term_even = term_even * h / (k // 2 - 1)
            even = even + term_even
            out = out.when(df == k, even)
    return out


def running_sums(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], sums: dict[str, Column], blocks: int | None = None) -> DataFrame:
    """``df`` with the sums of all rows of its key before each row, in a total order: exact, spread over blocks."""
    return _running(df, keys, order, sums, blocks, F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))


def running_least(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], values: dict[str, Column], blocks: int | None = None) -> DataFrame:
    """The same with the least value of all rows before each row; null for the first."""
    return _running(df, keys, order, values, blocks, F.min, F.least)


def _running(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], values: dict[str, Column], blocks: int | None, fold, join) -> DataFrame:
    """Prefix values by a function that folds rows, and one that joins what a block's own rows and earlier blocks give.

    What meets in one task is one row per block of a key, and one block's rows of a key. Rows that are equal in
    ``order`` are taken in the order they lie.
    """
    placed = ordered_blocks(df.withColumns({f"_s_{n}": c for n, c in values.items()}), [*keys, *order], blocks)
    parts = placed.groupBy(*keys, "_block").agg(*[fold(f"_s_{n}").alias(f"_b_{n}") for n in values])
    ahead = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_block").alias("_p"), *[fold(f"_b_{n}").over(ahead).alias(f"_b_{n}") for n in values])
    on = F.col("_block") == F.col("_p")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    inside = Window.partitionBy(*keys, "_block").orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1)
    found = placed.join(parts, on)
    return found.select(*df.columns, *[join(F.col(f"_b_{n}"), fold(f"_s_{n}").over(inside)).alias(n) for n in values])
