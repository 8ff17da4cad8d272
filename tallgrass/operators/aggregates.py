"""Grouped statistics that merge: every one is a sum of sums, so partial aggregation and later re-aggregation agree."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallgrass.operators.numeric import running_sums


def moment_cells(rows: DataFrame, keys: Sequence[str], stance: Column) -> DataFrame:
    """Per key the sufficient statistics of a stance in -1, 0, 1: n, s_sum, s2_sum."""
    return rows.withColumn("_s", stance).groupBy(*keys).agg(F.count("_s").alias("n"), F.sum("_s").alias("s_sum"), F.sum(F.col("_s") * F.col("_s")).alias("s2_sum"))


def merged_cells(cells: DataFrame, keys: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """Cells that stand in several parts added up."""
    return cells.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])


def label_counts(cells: DataFrame) -> DataFrame:
    """``cells`` with n_favor, n_against and n_neutral recovered from the moments."""
    s, s2, n = F.col("s_sum"), F.col("s2_sum"), F.col("n")
    return cells.withColumns({"n_favor": (s2 + s) / 2, "n_against": (s2 - s) / 2, "n_neutral": n - s2})


def dense_index(cells: DataFrame, name: str, index: str) -> DataFrame:
    """``cells`` with a dense number from 0 for each value of ``name`` in sorted order.

    The numbers come from the distinct values, counted over ordered blocks of them.
    """
    values = running_sums(cells.select(name).distinct(), [], [name], {index: F.lit(1)}).withColumn(index, F.col(index).cast("int"))
    return cells.join(values, name)


def deflated(n: Column, rho: float) -> Column:
    """Effective number of ``n`` answers that correlate by ``rho``."""
    return n / (1 + (n - 1) * rho)


def coarse_lattice(cells: DataFrame, keys: Sequence[str], fine: int, coarse: int) -> DataFrame:
    """Counts on the lattice of resolution ``fine`` moved to the nearest points of resolution ``coarse``.

    Columns q0.. count points (i, j, k) with i + j + k = resolution, in the order of i, then j.
    """
    points = lambda r: [(i, j, r - i - j) for i in range(r + 1) for j in range(r + 1 - i)]
    target = points(coarse)
    to = []
    for p in points(fine):
        scaled = [v * coarse / fine for v in p]
        to.append(min(range(len(target)), key=lambda t: (sum((a - b) ** 2 for a, b in zip(scaled, target[t])), t)))
    sums = []
    for t in range(len(target)):
        own = [F.coalesce(F.col(f"q{i}"), F.lit(0.0)) for i, x in enumerate(to) if x == t]
        total = F.lit(0.0)
        for c in own:
            total = total + c
        sums.append(F.sum(total).alias(f"q{t}"))
    return cells.groupBy(*keys).agg(*sums)


def weighted_mean(value: Column, weight: Column) -> Column:
    return F.sum(value * weight) / F.sum(weight)


def pooled_variance(rows: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """One row: within-group variance pooled over groups (sum of squares over degrees of freedom)."""
    per = rows.groupBy(*group).agg(F.var_samp(value).alias("v"), F.count(value).alias("n")).where("n > 1")
    return per.agg((F.sum(F.col("v") * (F.col("n") - 1)) / F.sum(F.col("n") - 1)).alias("pooled"), F.sum("n").alias("values"))


def shares(rows: DataFrame, keys: Sequence[str], within: Sequence[str]) -> DataFrame:
    """Counts per ``keys`` and their percentage of all rows of ``within``."""
    counts = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    return counts.withColumn("percent", 100 * F.col("n") / F.sum("n").over(Window.partitionBy(*within)))


def top_value(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Per key the most frequent value (ties: the least) and its count; nulls are no values."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    best = counts.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(value).alias("v"))).alias("_b"))
    return best.select(*keys, F.col("_b.v").alias(value), (-F.col("_b.m")).alias("n"))


def equal_mass_bins(rows: DataFrame, score: str, weight: str, bins: int, order: Sequence[str]) -> DataFrame:
    """``rows`` with ``bin`` (from 0): cuts of the running weight by ascending score into bins of equal weight.

    The running weight is taken over rows pre-aggregated by score, in ordered blocks.
    """
    sums = rows.groupBy(score).agg(F.sum(weight).alias("_w"))
    placed = running_sums(sums, [], [score], {"_before": F.col("_w")})
    whole = rows.agg(F.sum(weight)).first()[0] or 1.0
    cut = placed.select(F.col(score).alias("_score"), F.least(F.floor(F.col("_before") / F.lit(float(whole)) * bins), F.lit(bins - 1)).alias("bin"))
    return rows.join(cut, F.col(score) == F.col("_score")).drop("_score")


def breakdown(rows: DataFrame, by: Sequence[str], metrics: Sequence[Column]) -> DataFrame:
    """Metrics over all rows and per value of each label, in one pass: (label, value, metrics...); label null: overall."""
    sets = [(F.lit(None).cast("string"), F.lit(None).cast("string"))] + [(F.lit(b), F.col(b).cast("string")) for b in by]
    stacked = rows.withColumn("_b", F.explode(F.array(*[F.struct(a.alias("label"), v.alias("value")) for a, v in sets])))
    return stacked.groupBy(F.col("_b.label").alias("label"), F.col("_b.value").alias("value")).agg(*metrics)


def duplicated(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that stand more than once, with how often."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def lattice_bands(cells: DataFrame, resolution: int, bands: Sequence[tuple[float, float]]) -> DataFrame:
    """(band, share): share of the lattice counts q0.. by the greatest probability of the point they lie on."""
    points = [(i, j, resolution - i - j) for i in range(resolution + 1) for j in range(resolution + 1 - i)]
    sums = cells.agg(*[F.sum(f"q{i}").alias(f"q{i}") for i in range(len(points))])
    whole = sum((F.col(f"q{i}") for i in range(1, len(points))), F.col("q0"))
    rows = []
    for b, (lo, hi) in enumerate(bands):
        own = [F.col(f"q{i}") for i, p in enumerate(points) if lo <= max(p) / resolution < hi]
        rows.append(F.struct(F.lit(f"b{b}").alias("band"), (sum(own[1:], own[0]) / whole if own else F.lit(0.0)).alias("share")))
    return sums.select(F.explode(F.array(*rows)).alias("_r")).select("_r.*")


def survival(totals: DataFrame, value: str, limits: Sequence[float]) -> DataFrame:
    """(least, kept, total, share): how many rows, and how much of the whole, reach each limit; in one pass."""
    v = F.col(value)
    sums = totals.agg(F.sum(v).alias("_all"), *[f(F.when(v >= t, v)).alias(f"_{n}{i}") for i, t in enumerate(limits) for n, f in (("n", F.count), ("s", F.sum))])
    rows = F.array(*[F.struct(F.lit(t).alias("least"), F.col(f"_n{i}").alias("kept"), F.col(f"_s{i}").alias("total"), (F.col(f"_s{i}") / F.col("_all")).alias("share")) for i, t in enumerate(limits)])
    return sums.select(F.explode(rows).alias("_r")).select("_r.*")


def bincount(rows: DataFrame, index: str, weight: str, size: int) -> DataFrame:
    """(index, weight) for every whole number below ``size``, 0 where there is nothing."""
    every = rows.sparkSession.range(size).select(F.col("id").alias(index))
    sums = rows.groupBy(index).agg(F.sum(weight).alias(weight))
    return every.join(sums, index, "left").select(index, F.coalesce(weight, F.lit(0.0)).alias(weight))


def outer_sums(rows: DataFrame, keys: Sequence[str], vector: str, weight: str, size: int) -> DataFrame:
    """(keys, i, k, value): weighted sums of the outer product of a vector with itself, one row per entry."""
    at = lambda i: F.get(F.col(vector), F.lit(i))
    sums = rows.groupBy(*keys).agg(*[F.sum(F.col(weight) * at(i) * at(k)).alias(f"_{i}_{k}") for i in range(size) for k in range(i, size)])
    entries = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(k).alias("k"), F.col(f"_{min(i, k)}_{max(i, k)}").alias("value")) for i in range(size) for k in range(size)])
    return sums.select(*keys, F.explode(entries).alias("_e")).select(*keys, "_e.*")
