"""Samples that come out the same on every run: order is by hash, quotas are closed forms over few counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tallgrass.operators.numeric import running_sums


MOST_CELLS = 100_000  # cells whose quotas are settled on the driver


def unit_hash(key: Column, seed: int | str) -> Column:
    """A number in [0, 1) from SHA-256 of ``seed:key``, the same in any engine."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") / F.lit(float(16**13))


def hash_order(key: Column, seed: int | str) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)


def sample_rows(rows: DataFrame, key: str, n: int, seed: int | str) -> DataFrame:
    """Exactly ``n`` rows (or all), the first by hash: a top-n, never a full sort."""
    return rows.orderBy(hash_order(F.col(key), seed), key).limit(n)


def quotas(counts: dict, total: int, floor: int = 0) -> dict:
    """How many to take of each cell so that cells come out as even as they can, none above what it has.

    A water level: every cell gets the level or all it has; what is left over goes to the first cells in order.
    """
    total = min(total, sum(counts.values()))
    given = {k: min(n, floor) for k, n in counts.items()}
    level, left = floor, total - sum(given.values())
    while left > 0:
        open_ = sorted(k for k, n in counts.items() if n > level)
        if not open_:
            break
        step = min(left // len(open_), min(counts[k] for k in open_) - level)
        if step <= 0:
            for k in open_[:left]:
                given[k] += 1
            break
        for k in open_:
            given[k] += step
        level, left = level + step, left - step * len(open_)
    return given


def stratified(rows: DataFrame, cells: Sequence[str], key: str, spread: str, total: int, seed: int | str) -> DataFrame:
    """An even sample over the cells: no account gives a second row to a cell before each has given its first.

    Rows with a null cell aren't sampled. Cell counts (few) decide the quotas on the driver; each group is cut to the
    largest quota before it is moved.
    """
    rows = rows.withColumn("_h", hash_order(F.col(key), seed))
    turn = Window.partitionBy(*cells, spread).orderBy("_h", key)
    rank = Window.partitionBy(*cells).orderBy("_turn", "_h", key)
    named = F.lit(True)
    for c in cells:
        named = named & F.col(c).isNotNull()
    found = rows.where(named).groupBy(*cells).count().limit(MOST_CELLS + 1).collect()
    if len(found) > MOST_CELLS:
        raise ValueError(f"more than {MOST_CELLS} cells to sample evenly from")
    counts = {tuple(r[c] for c in cells): r["count"] for r in found}
    given = {k: n for k, n in quotas(counts, total).items() if n}
    if not given:
        return rows.drop("_h").limit(0)
    quota = rows.sparkSession.createDataFrame([(*k, n) for k, n in given.items()], StructType([*rows.select(*cells).schema.fields, StructField("_quota", LongType())]))
    most = max(given.values())
    # a row in an account's turn t has rank t at least: both bounds let Spark cut groups before it shuffles them
    ranked = rows.withColumn("_turn", F.row_number().over(turn)).where(F.col("_turn") <= most).withColumn("_rank", F.row_number().over(rank)).where(F.col("_rank") <= most)
    return ranked.join(F.broadcast(quota), list(cells)).where("_rank <= _quota").drop("_h", "_turn", "_rank", "_quota")


def capped_targets(rows: DataFrame, post: Sequence[str], target: str, cap: int, seed: int | str) -> DataFrame:
    """At most ``cap`` targets per post by hash, with n_post, n_sampled and the inclusion weight n_post / n_sampled."""
    w = Window.partitionBy(*post)
    drawn = rows.withColumn("_r", F.row_number().over(w.orderBy(hash_order(F.col(target), seed), target))).withColumn("n_post", F.count("*").over(w))
    kept = drawn.where(F.col("_r") <= cap).withColumn("n_sampled", F.least("n_post", F.lit(cap)))
    return kept.drop("_r").withColumn("weight", F.col("n_post") / F.col("n_sampled"))


def effective_size(weight: Column) -> Column:
    """Kish's effective sample size."""
    return F.pow(F.sum(weight), 2) / F.sum(weight * weight)


def top_fraction(rows: DataFrame, group: Sequence[str], order: Sequence[Column], p: float) -> DataFrame:
    """The first max(1, floor(n p)) rows of each group."""
    w = Window.partitionBy(*group)
    ranked = rows.withColumn("_r", F.row_number().over(w.orderBy(*order))).withColumn("_n", F.count("*").over(w))
    return ranked.where(F.col("_r") <= F.greatest(F.lit(1), F.floor(F.col("_n") * p))).drop("_r", "_n")


def every_nth(rows: DataFrame, order: Sequence[str | Column], n: int) -> DataFrame:
    """Every ``n``-th row of a total order; places come from running counts over blocks."""
    return running_sums(rows, [], order, {"_i": F.lit(1)}).where((F.col("_i") + 1) % n == 0).drop("_i")
