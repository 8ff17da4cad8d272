"""Scores of forecasts and labels by problem, by dimension and by run; tests of change; splits by position."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallgrass.operators.numeric import chi2_tail, log_gamma, running_sums
from tallgrass.operators.sampling import hash_order

EPS = 1e-12


def sub_problems(cells: DataFrame) -> DataFrame:
    """The two binary questions of an ordinal forecast, one row each: problem, p, k (successes) and n.

    ``cells`` has p_neg, p_neu, p_pos and n_against, n_neutral, n_favor. Neutrality: is it neutral; polarity: is it
    in favour, given that it isn't neutral.
    """
    engaged = F.greatest(1 - F.col("p_neu"), F.lit(EPS))
    whole = F.col("n_against") + F.col("n_neutral") + F.col("n_favor")
    two = F.array(
        F.struct(F.lit("neutrality").alias("problem"), F.col("p_neu").alias("p"), F.col("n_neutral").alias("k"), whole.alias("n")),
        F.struct(F.lit("polarity").alias("problem"), ((F.col("p_pos") + EPS) / engaged).alias("p"), F.col("n_favor").alias("k"), (F.col("n_against") + F.col("n_favor")).alias("n")),
    )
    return cells.withColumn("_p", F.explode(two)).select(*[c for c in cells.columns if c not in ("problem", "p", "k", "n")], "_p.*")


def brier_counts(p: Column, k: Column, n: Column) -> Column:
    """Brier score of counts, as an aggregate: mean over all outcomes."""
    return F.sum(k * F.pow(1 - p, 2) + (n - k) * F.pow(p, 2)) / F.sum(n)


def best_profiles(scores: DataFrame, group: str, profile: str, labels: Sequence[str]) -> DataFrame:
    """Per group the best profile (by f1, ties to the first by name) of each label, macro-averaged.

    ``scores`` has label, precision, recall and f1 per group and profile; a group without one of the labels is left out.
    """
    wanted = scores.where(F.col("label").isin(*labels))
    best = wanted.groupBy(group, "label").agg(F.min_by(F.struct(profile, "precision", "recall", "f1"), F.struct((-F.col("f1")).alias("f"), F.col(profile).alias("p"))).alias("_b"))
    out = best.groupBy(group).agg(*[F.avg(f"_b.{m}").alias(m) for m in ("precision", "recall", "f1")], F.count("*").alias("_n"))
    return out.where(F.col("_n") == len(labels)).drop("_n")


def fisher_exact(tables: DataFrame, a: str, b: str, c: str, d: str, reach: float = 40.0) -> DataFrame:
    """``tables`` (2 x 2 counts, named by its other columns) with ``p``: two-sided, the chance of all tables with equal
    margins that are no likelier than the one seen.

    Tables further than ``reach`` deviations from the mean weigh below the least double and are not summed, so the work
    grows with the root of the counts.
    """
    names = [x for x in tables.columns if x not in (a, b, c, d)]
    A, B, C, D = (F.col(x).cast("double") for x in (a, b, c, d))
    row, col, n = A + B, A + C, A + B + C + D
    mean = row * col / n
    sd = F.sqrt(row * (n - row) * col * (n - col) / (n * n * F.greatest(n - 1, F.lit(1.0))))
    low, high = F.greatest(F.lit(0.0), row + col - n), F.least(row, col)
    start = F.least(F.greatest(low, F.floor(mean - reach * sd - 1)), A)
    end = F.greatest(F.least(high, F.ceil(mean + reach * sd + 1)), A)
    rows = tables.where(n > 0).select(*tables.columns, row.alias("_r"), col.alias("_c"), n.alias("_n"), F.explode(F.sequence(start.cast("bigint"), end.cast("bigint"))).alias("_x"))
    fact = lambda v: log_gamma(v + 1.0)
    r, k, m, x = F.col("_r"), F.col("_c"), F.col("_n"), F.col("_x").cast("double")
    log_p = fact(r) + fact(k) + fact(m - r) + fact(m - k) - fact(m) - fact(x) - fact(r - x) - fact(k - x) - fact(m - r - k + x)
    chances = rows.withColumn("_l", log_p)
    own = F.max(F.when(F.col("_x") == F.col(a), F.col("_l"))).over(Window.partitionBy(*names))
    # equal tables may differ in the last digits
    return chances.withColumn("_own", own).groupBy(*names, a, b, c, d).agg(F.least(F.sum(F.when(F.col("_l") <= F.col("_own") + 1e-7, F.exp("_l")).otherwise(0.0)), F.lit(1.0)).alias("p"))


def shift_significance(counts: DataFrame, item: str, label: str, early: str, late: str, least: int = 10) -> DataFrame:
    """(item, p): has the distribution of labels changed from early to late?

    Exact for two labels, chi-square for more; an item with fewer than ``least`` in either period or a single label has 1.
    """
    used = counts.where(F.col(early) + F.col(late) > 0)
    per = used.groupBy(item).agg(F.sum(early).alias("_e"), F.sum(late).alias("_l"), F.count("*").alias("_k"), F.min_by(F.struct(early, late), label).alias("_a"), F.max_by(F.struct(early, late), label).alias("_b"))
    cells = used.join(per, item)
    n = F.col("_e") + F.col("_l")
    both = F.col(early) + F.col(late)
    part = lambda o, size: F.pow(F.col(o) - both * size / n, 2) / (both * size / n)
    chi = cells.where("_k > 2 and _e > 0 and _l > 0").groupBy(item).agg(F.sum(part(early, F.col("_e")) + part(late, F.col("_l"))).alias("_x"))
    two = per.where("_k = 2").select(item, F.col(f"_a.{early}").alias("a"), F.col(f"_b.{early}").alias("b"), F.col(f"_a.{late}").alias("c"), F.col(f"_b.{late}").alias("d"))
    exact = fisher_exact(two, "a", "b", "c", "d").select(item, F.col("p").alias("_p"))
    j = per.join(chi, item, "left").join(exact, item, "left")
    enough = (F.col("_e") >= least) & (F.col("_l") >= least) & (F.col("_k") > 1)
    return j.select(item, F.when(enough, F.coalesce("_p", chi2_tail(F.col("_x"), F.col("_k") - 1))).otherwise(1.0).alias("p"))


def gain(d2: Column, p2: Column, m2: Column, c: Column, c_dm: Column, c_pm: Column) -> dict[str, Column]:
    """Correlations of a forecast and of the reversed last move with the motion, and what both explain together, from six
    mean moments; a correlation over nothing is 0."""
    ratio = lambda x, a, b: F.when((a > 0) & (b > 0), x / F.sqrt(a * b)).otherwise(0.0)
    rho, rho_dm, rho_pm = ratio(c, d2, p2), ratio(c_dm, d2, m2), ratio(c_pm, p2, m2)
    rest = 1 - rho_pm * rho_pm
    both = F.when(rest > 1e-6, (rho * rho + rho_dm * rho_dm - 2 * rho * rho_dm * rho_pm) / rest).otherwise(F.greatest(rho * rho, rho_dm * rho_dm))
    combined = F.greatest(F.lit(0.0), F.least(F.lit(1.0), both))
    return {"rho": rho, "momentum_rho": rho_dm, "model_vs_momentum_rho": rho_pm, "combined_ceiling": combined, "ceiling_gain": combined - rho_dm * rho_dm}


def moments(x0: Column, x1: Column, xm1: Column, guess: Column) -> dict[str, Column]:
    """The six mean moments of motion, forecast and reversed last move, as aggregates."""
    d, p, m = x1 - x0, guess - x0, xm1 - x0
    return {"d2": F.avg(d * d), "p2": F.avg(p * p), "m2": F.avg(m * m), "c": F.avg(d * p), "c_dm": F.avg(d * m), "c_pm": F.avg(p * m)}


def dimension_gains(per_dim: DataFrame, floor: float = 1e-6) -> DataFrame:
    """One row: the gain within each moving dimension, averaged; dimensions that never move don't count, and what is
    forecast there is reported as ``spurious``. ``per_dim`` has one row of moments per dimension."""
    top = per_dim.withColumn("_moving", F.col("d2") > floor * F.max("d2").over(Window.partitionBy()))  # a row per dimension
    g = gain(*[F.col(x) for x in ("d2", "p2", "m2", "c", "c_dm", "c_pm")])
    scored = top.withColumns({f"_{k}": v for k, v in g.items()})
    on = F.col("_moving")
    avg = lambda c: F.avg(F.when(on, c))
    return scored.agg(
        avg(F.col("_rho")).alias("rho"), avg(F.pow("_momentum_rho", 2)).alias("momentum_ceiling"), avg(F.col("_ceiling_gain")).alias("ceiling_gain"),
        F.count_if(on).alias("moving"), (F.sum(F.when(~on, F.col("p2")).otherwise(0.0)) / F.sum(F.when(on, F.col("d2")))).alias("spurious"),
    )


def run_gaps(runs: DataFrame, by: str, train: str, val: str) -> DataFrame:
    """Per kind of split: runs, mean and deviation of both losses, and the gap between the means."""
    return runs.where(F.col(train).isNotNull() & F.col(val).isNotNull()).groupBy(by).agg(
        F.count("*").alias("runs"), F.avg(train).alias("train"), F.avg(val).alias("val"), (F.avg(val) - F.avg(train)).alias("gap"), F.stddev_samp(train).alias("train_sd"), F.stddev_samp(val).alias("val_sd")
    )


def position_splits(rows: DataFrame, key: str, account: str, order: Sequence[str], train: float, seed: int | str) -> DataFrame:
    """``rows`` with random_split, account_split and time_split, each 'train' for the first share and 'val' after it.

    Rows and accounts are put in the order of a hash, times in their own; places come from running counts over blocks.
    """
    n = rows.count()
    random = running_sums(rows.select(key, hash_order(F.col(key), seed).alias("_h")), [], ["_h", key], {"_i": F.lit(1)}).select(key, F.when(F.col("_i") < int(n * train), "train").otherwise("val").alias("random_split"))
    accounts = rows.select(account).distinct()
    m = accounts.count()
    drawn = running_sums(accounts.withColumn("_h", hash_order(F.col(account), seed)), [], ["_h", account], {"_i": F.lit(1)}).select(account, F.when(F.col("_i") < int(m * train), "train").otherwise("val").alias("account_split"))
    timed = running_sums(rows.select(key, *order), [], [*order, key], {"_i": F.lit(1)}).select(key, F.when(F.col("_i") < int(n * train), "train").otherwise("val").alias("time_split"))
    return rows.join(random, key).join(drawn, account).join(timed, key)


def bin_cutoffs(bins: int, width: float, holdout: float, offset: float = 0.0) -> tuple[int, int]:
    """(first bin held out, one past the last bin of the window): bins go by their centres, so one that straddles a limit
    falls where most of it lies."""
    last = bins - 1
    start = last - (offset + holdout) / width
    end = last - offset / width
    return min(bins, max(0, math.ceil(start - 1e-9))), min(bins, math.floor(end + 1e-9) + 1)


def sampled_pairs(pairs: DataFrame, history: DataFrame, key: str, at: str, start: str, least: int, most: int, seed: int | str) -> DataFrame:
    """At most ``most`` pairs, by hash, whose key has ``least`` states or more up to and with the pair's start."""
    seen = history.select(F.col(key).alias("_k"), F.col(at).alias("_t"), F.row_number().over(Window.partitionBy(key).orderBy(at)).alias("history"))
    rows = pairs.join(seen, (F.col(key) == F.col("_k")) & (F.col(start) == F.col("_t"))).where(F.col("history") >= least).drop("_k", "_t")
    return rows.orderBy(hash_order(F.concat_ws("/", key, start), seed), key, start).limit(most)


def readability(components: DataFrame, dim: str, item: str, value: str, volumes: DataFrame, volume: str, top: int, weighted: bool) -> DataFrame:
    """One row: how readable the strongest ``top`` items of each dimension are.

    prevalence is their mean volume percentile, distinctness the share of the pooled items that dimensions don't share,
    and score the geometric mean of both. ``volumes`` has one row per item.
    """
    n = volumes.count()
    placed = running_sums(volumes.select(item, volume), [], [volume, item], {"_i": F.lit(1)}).select(item, F.col(volume).alias("_v"), (F.col("_i") / F.lit(max(n - 1, 1))).alias("_pct"))
    rows = components.join(placed, item).withColumn("_s", F.abs(value) * (F.sqrt("_v") if weighted else F.lit(1.0)))
    kept = rows.withColumn("_r", F.row_number().over(Window.partitionBy(dim).orderBy(F.desc("_s"), item))).where(F.col("_r") <= min(top, n))
    t = kept.agg(F.avg("_pct").alias("prevalence"), F.countDistinct(item).alias("_u"), F.countDistinct(dim).alias("_k"))
    spread = F.when(F.col("_k") > 1, (F.col("_u") - min(top, n)) / (min(top, n) * F.col("_k") - min(top, n))).otherwise(1.0)
    return t.select("prevalence", spread.alias("distinctness"), F.sqrt(F.greatest(F.col("prevalence"), F.lit(0.0)) * F.greatest(spread, F.lit(0.0))).alias("score"))


def displacement(pairs: DataFrame, x0: str, x1: str, xm1: str, dims: int) -> DataFrame:
    """One row: spread of the levels, root mean square of the steps, their ratio, and the momentum of arrays of ``dims``
    coordinates; ``xm1`` is the state before."""
    at = lambda c, i: F.get(F.col(c), F.lit(i))
    dot = lambda f: sum((f(i) for i in range(1, dims)), f(0))
    d2 = dot(lambda i: F.pow(at(x1, i) - at(x0, i), 2))
    m2 = dot(lambda i: F.pow(at(x0, i) - at(xm1, i), 2))
    dm = dot(lambda i: (at(x1, i) - at(x0, i)) * (at(x0, i) - at(xm1, i)))
    level = dot(lambda i: F.stddev_pop(at(x0, i))) / dims
    t = pairs.agg(level.alias("level_sd"), F.sqrt(F.avg(d2)).alias("step_rms"), (F.sum(dm) / F.sqrt(F.sum(F.when(dm.isNotNull(), d2)) * F.sum(m2))).alias("momentum_rho"), F.count("*").alias("pairs"))
    return t.withColumn("step_over_level", F.col("step_rms") / (F.col("level_sd") * math.sqrt(dims)))


def lag_buckets(pairs: DataFrame, by: Sequence[str], lag: Column, square: Column, noise: Column, weight: Column, edges: Sequence[int]) -> DataFrame:
    """(by, bucket, pairs, raw, noise, excess): weighted mean squares per bucket of lags and what noise doesn't explain."""
    bucket = F.lit(None).cast("int")
    for i, (lo, hi) in enumerate(zip(edges, edges[1:])):
        bucket = F.when((lag >= lo) & (lag < hi), i).otherwise(bucket)
    rows = pairs.select(*by, bucket.alias("bucket"), square.alias("_q"), noise.alias("_z"), weight.alias("_w")).where("bucket is not null")
    mean = lambda c: F.sum(F.col(c) * F.col("_w")) / F.sum("_w")
    return rows.groupBy(*by, "bucket").agg(F.count("*").alias("pairs"), mean("_q").alias("raw"), mean("_z").alias("noise"), (mean("_q") - mean("_z")).alias("excess"))


def saturation(excess: Sequence[float], tail: float = 0.34) -> dict:
    """Does excess variance (over its null, by growing lag) level off? span, drift_sd, tail_share and saturates."""
    span = excess[-1] - excess[0]
    n = max(2, round(len(excess) * tail))
    share = (excess[-1] - excess[-n]) / span if span > 0 else math.nan
    return {"span": float(span), "drift_sd": math.sqrt(max(span, 0.0) / 2), "tail_share": float(share), "saturates": bool(span > 0 and share < 0.1)}


def partition_polarization(beliefs: DataFrame, ident: str, vector: str, dims: int) -> DataFrame:
    """(side, polarization) for every way to part ``dims`` beliefs in two: ``side`` is a bit mask of the second part, whose
    mean is the belief that users are ordered by; the least and the rest are then as far apart as any cut makes them.

    Users are ordered in blocks, and running sums give every cut; no partition's users meet in one task.
    """
    sides = [m for m in range(1, 2**dims) if not m & 1] if dims > 1 else []
    mean = lambda m: sum((F.get(F.col(vector), F.lit(i)).cast("double") for i in range(dims) if m >> i & 1), F.lit(0.0)) / bin(m).count("1")
    rows = beliefs.select(ident, F.explode(F.array(*[F.struct(F.lit(m).alias("side"), mean(m).alias("y")) for m in sides])).alias("_s")).select(ident, "_s.*").where("y is not null")
    summed = running_sums(rows, ["side"], ["y", ident], {"_i": F.lit(1), "_sum": F.col("y")})
    whole = rows.groupBy("side").agg(F.count("*").alias("_n"), F.sum("y").alias("_all"))
    j = summed.join(whole, "side").where("_i > 0")
    cut = F.col("_i") * (F.col("_all") - F.col("_sum")) - (F.col("_n") - F.col("_i")) * F.col("_sum")
    return j.groupBy("side").agg((F.max(cut) / (4 * F.pow(F.max("_n"), 2))).alias("polarization"))
