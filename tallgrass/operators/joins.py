"""Joins beyond equality, each with an equality part so that no side is compared with all of the other."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def spans_containing(points: DataFrame, spans: DataFrame, key: str, at: str, start: str, end: str) -> DataFrame:
    """Points joined to every span of the same key that holds them, both ends included."""
    right = spans.withColumnRenamed(key, "_span_key")
    return points.join(right, (F.col(key) == F.col("_span_key")) & F.col(at).between(F.col(start), F.col(end))).drop("_span_key")


def lag_pairs(rows: DataFrame, keys: Sequence[str], at: str, max_lag: int, keep: Sequence[str] = ()) -> DataFrame:
    """All pairs of rows of one key with 0 < later - earlier <= ``max_lag`` (integers).

    Time is cut in buckets of ``max_lag``; a row meets its own bucket and the one before, so that a busy key is spread
    over its buckets instead of being joined with itself as a whole. Columns: keys, ``at``, ``lag``, and each of
    ``keep`` twice, with ``_a`` (earlier) and ``_b`` (later).
    """
    bucket = F.floor(F.col(at) / max_lag)
    early = rows.select(*keys, F.col(at).alias("_ta"), *[F.col(c).alias(f"{c}_a") for c in keep], bucket.alias("_bucket"))
    late = rows.select(*keys, F.col(at).alias("_tb"), *[F.col(c).alias(f"{c}_b") for c in keep], F.explode(F.array(bucket, bucket - 1)).alias("_bucket"))
    lag = F.col("_tb") - F.col("_ta")
    return early.join(late, [*keys, "_bucket"]).where((lag > 0) & (lag <= max_lag)).select(*keys, F.col("_ta").alias(at), lag.alias("lag"), *[f"{c}_{s}" for c in keep for s in "ab"])


def first_at_or_after(rows: DataFrame, key: str, at: str, ahead: int, take: Sequence[str]) -> DataFrame:
    """Each row with the same key's first row at or after ``at + ahead`` (integers); rows without one are left out.

    Looked up by one window instead of a join. Columns of the found row are called ``next_*``; of several rows at one
    instant the least counts.
    """
    frame = Window.partitionBy(key).orderBy(at).rangeBetween(ahead, Window.unboundedFollowing)
    found = F.min(F.struct(at, *take)).over(frame)
    hit = rows.withColumn("_found", found).where("_found is not null")
    return hit.select(*rows.columns, *[F.col("_found")[c].alias(f"next_{c}") for c in (at, *take)])


def within_radius(points: DataFrame, ident: str, x: str, y: str, radius: float) -> DataFrame:
    """Ordered pairs of different points no farther apart than ``radius``: (a, b, distance).

    Points fall into square cells as wide as the radius and meet the nine cells around them.
    """
    cell = lambda c: F.floor(F.col(c) / radius)
    own = points.select(F.col(ident).alias("a"), F.col(x).alias("_xa"), F.col(y).alias("_ya"), cell(x).alias("_i"), cell(y).alias("_j"))
    near = F.array(*[F.struct((cell(x) + i).alias("_i"), (cell(y) + j).alias("_j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    others = points.select(F.col(ident).alias("b"), F.col(x).alias("_xb"), F.col(y).alias("_yb"), F.explode(near).alias("_c")).select("b", "_xb", "_yb", "_c._i", "_c._j")
    distance = F.sqrt(F.pow(F.col("_xa") - F.col("_xb"), 2) + F.pow(F.col("_ya") - F.col("_yb"), 2))
    return own.join(others, ["_i", "_j"]).where("a <> b").withColumn("distance", distance).where(F.col("distance") <= radius).select("a", "b", "distance")


def squared_distance(a: Column, b: Column) -> Column:
    """Squared Euclidean distance of two arrays of one length."""
    return F.aggregate(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)


def nearest_centre(points: DataFrame, vector: str, centres: Sequence[tuple[int, Sequence[float]]], cut_off: float | None = None) -> DataFrame:
    """``points`` with ``centre`` and ``distance`` of the nearest centre; -1 beyond ``cut_off``. Ties go to the least id.

    The centres are a short list held by the driver and become constants of the plan.
    """
    table = F.array(*[F.struct(squared_distance(F.col(vector), F.array(*[F.lit(float(v)) for v in c])).alias("d"), F.lit(int(i)).alias("i")) for i, c in centres])
    best = F.array_min(table)
    found = points.withColumn("_best", best).withColumn("distance", F.sqrt("_best.d"))
    centre = F.col("_best.i") if cut_off is None else F.when(F.col("distance") > cut_off, -1).otherwise(F.col("_best.i"))
    return found.withColumn("centre", centre).drop("_best")


def daily_spine(rows: DataFrame, keys: Sequence[str], day: str, counts: Sequence[str]) -> DataFrame:
    """One row per key and day (integer) from the first to the last day of that key, missing counts as 0."""
    span = rows.groupBy(*keys).agg(F.min(day).alias("_lo"), F.max(day).alias("_hi"))
    days = span.select(*keys, F.explode(F.sequence("_lo", "_hi")).alias(day))
    return days.join(rows, [*keys, day], "left").na.fill(0, list(counts))


def recode(column: str | Column, mapping: dict, default: Column | None = None) -> Column:
    """Values replaced by a short dictionary; others become ``default``, or stay if there is none."""
    c = F.col(column) if isinstance(column, str) else column
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return F.coalesce(F.try_element_at(table, c), c if default is None else default)


def with_flag(rows: DataFrame, marked: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """``rows`` with a boolean that tells whether their key is among ``marked``."""
    found = marked.select(*keys).distinct().withColumn(name, F.lit(True))
    return rows.join(found, list(keys), "left").withColumn(name, F.coalesce(name, F.lit(False)))


def shared_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys on both sides, the leakage check of two sets."""
    return left.select(key).distinct().intersect(right.select(key).distinct())


def union_all_columns(*frames: DataFrame) -> DataFrame:
    """Union by name; missing columns are null, and types that differ are widened to the wider number or to text."""
    rank = ["boolean", "tinyint", "smallint", "int", "bigint", "float", "double", "string"]
    kinds: dict[str, str] = {}
    for f in frames:
        for name, kind in f.dtypes:
            old = kinds.get(name)
            kinds[name] = kind if old in (None, kind) else max((old, kind), key=rank.index) if old in rank and kind in rank else "string"
    cast = [f.select(*[F.col(n).cast(kinds[n]) if k != kinds[n] else F.col(n) for n, k in f.dtypes]) for f in frames]
    out = cast[0]
    for f in cast[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def reuse_earlier(now: DataFrame, before: DataFrame, key: Sequence[str], same: Sequence[str], take: str) -> DataFrame:
    """``now`` with ``take`` from an earlier run wherever key and all of ``same`` are equal, nulls included; null elsewhere."""
    old = before.select(*[F.col(c).alias(f"_old_{c}") for c in (*key, *same)], F.col(take))
    on = [F.col(c) == F.col(f"_old_{c}") for c in key] + [F.col(c).eqNullSafe(F.col(f"_old_{c}")) for c in same]
    condition = on[0]
    for c in on[1:]:
        condition = condition & c
    return now.join(old, condition, "left").drop(*[f"_old_{c}" for c in (*key, *same)])


def explode_together(rows: DataFrame, lists: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Lists of one row exploded in lock-step; rows whose lists differ in length raise; an empty or null list gives one
    row of nulls."""
    sizes = [F.coalesce(F.size(c), F.lit(0)) for c in lists]
    same = F.lit(True)
    for s in sizes[1:]:
        same = same & (s == sizes[0])
    checked = rows.select(*keep, F.when(same, F.arrays_zip(*lists)).otherwise(F.raise_error(F.lit("lists of one row differ in length"))).alias("_z"))
    return checked.select(*keep, F.explode_outer("_z").alias("_e")).select(*keep, *[F.col("_e")[c].alias(c) for c in lists])
