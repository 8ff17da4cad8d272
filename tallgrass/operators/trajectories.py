"""From daily states to labelled pairs: pairs of states, splits without leakage, and what a forecast is worth."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallgrass.operators.sampling import unit_hash


def step_pairs(states: DataFrame, key: str, at: str, state: str, max_gap: int) -> DataFrame:
    """Each state with the next one, at most ``max_gap`` later, and the one before: t0, x0, t1, x1, xm1, has_prev."""
    w = Window.partitionBy(key).orderBy(at)
    rows = states.select(key, F.col(at).alias("t0"), F.col(state).alias("x0"), F.lead(at).over(w).alias("t1"), F.lead(state).over(w).alias("x1"), F.lag(state).over(w).alias("xm1"))
    return rows.where((F.col("t1") - F.col("t0")) <= max_gap).withColumn("has_prev", F.col("xm1").isNotNull())


def median_spacing(states: DataFrame, key: str, at: str) -> float | None:
    """Median gap between neighbouring states of one key, over all keys."""
    gap = F.col(at) - F.lag(at).over(Window.partitionBy(key).orderBy(at))
    return states.select(gap.alias("g")).agg(F.median("g")).first()[0]


def horizon_pairs(states: DataFrame, key: str, at: str, state: str, horizon: int, least_tolerance: int) -> DataFrame:
    """States paired about ``horizon`` ahead: t0, x0, t1, x1, xm1.

    The number of rows to go ahead is the horizon over the median spacing, rounded half to even, one at least; a pair
    counts if its real gap is within a quarter of the horizon, or ``least_tolerance`` if that is more.
    """
    spacing = median_spacing(states, key, at)
    if not spacing:
        return states.select(key, F.col(at).alias("t0"), F.col(state).alias("x0"), F.col(at).alias("t1"), F.col(state).alias("x1"), F.col(state).alias("xm1")).limit(0)
    rows = max(1, round(horizon / spacing))
    w = Window.partitionBy(key).orderBy(at)
    pairs = states.select(key, F.col(at).alias("t0"), F.col(state).alias("x0"), F.lead(at, rows).over(w).alias("t1"), F.lead(state, rows).over(w).alias("x1"), F.lag(state, rows).over(w).alias("xm1"))
    slack = max(horizon * 0.25, least_tolerance)
    return pairs.where((F.col("t1") - F.col("t0")).between(horizon - slack, horizon + slack))


def trajectory_split(key: Column, seed: int | str, train: float = 0.7, valid: float = 0.1) -> Column:
    """train, val or test by hash of the account alone, so that filtering never moves an account."""
    u = unit_hash(key, seed)
    return F.when(u < train, "train").when(u < train + valid, "val").otherwise("test")


def labelled(pairs: DataFrame, key: str, target_time: str, holdout: int, offset: int, seed: int | str) -> DataFrame:
    """``pairs`` with traj_split and time_split, the last ``holdout`` before the end being out; targets past the end drop.

    The end is the latest target less ``offset``; it is one scalar that joins as a one-row table.
    """
    last = pairs.agg(F.max(target_time).alias("_last"))
    rows = pairs.join(F.broadcast(last)).withColumn("_end", F.col("_last") - offset).where(F.col(target_time) <= F.col("_end"))
    rows = rows.withColumn("time_split", F.when(F.col(target_time) > F.col("_end") - holdout, "out").otherwise("in"))
    return rows.withColumn("traj_split", trajectory_split(F.col(key), seed)).drop("_last", "_end")


def leaks(rows: DataFrame, key: str, at: str) -> DataFrame:
    """One row of counts that must be 0: accounts in two splits, and held-out targets not after all training targets."""
    mixed = rows.groupBy(key).agg(F.countDistinct("traj_split").alias("n")).agg(F.count_if(F.col("n") > 1).alias("mixed_accounts"))
    ends = rows.agg(
        F.max(F.when((F.col("time_split") == "in") & (F.col("traj_split") == "train"), F.col(at))).alias("a"), F.min(F.when(F.col("time_split") == "out", F.col(at))).alias("b")
    )
    return mixed.join(F.broadcast(ends.select(F.coalesce((F.col("b") <= F.col("a")).cast("int"), F.lit(0)).alias("early_holdout"))))


def skill_metrics(by: Sequence[str], x0: Column, x1: Column, predicted: Column) -> tuple[list[Column], list[str]]:
    """Aggregates of six moments per group, from which ``skill_table`` derives all ratios."""
    move, guess = x1 - x0, predicted - x0
    error, base = F.pow(x1 - predicted, 2), F.pow(move, 2)
    sums = [
        F.count("*").alias("pairs"), F.avg(error).alias("model_loss"), F.avg(base).alias("baseline_loss"), F.avg(guess * guess).alias("_pp"),
        F.avg(guess * move).alias("_pd"), F.avg((error < base).cast("double")).alias("frac_better"),
    ]
    return sums, list(by)


def skill_table(pairs: DataFrame, by: Sequence[str], x0: Column, x1: Column, predicted: Column) -> DataFrame:
    """Per group: losses of the model and of no movement, skill, displacement ratio R, correlation rho, and the identity's
    two sides (skill = 2 rho R - R^2)."""
    sums, keys = skill_metrics(by, x0, x1, predicted)
    t = pairs.groupBy(*keys).agg(*sums)
    floor = F.greatest(F.col("baseline_loss"), F.lit(1e-12))
    ratio = F.sqrt(F.col("_pp") / floor)
    rho = F.col("_pd") / F.greatest(F.sqrt(F.col("_pp") * F.col("baseline_loss")), F.lit(1e-12))
    return t.withColumns({"skill": 1 - F.col("model_loss") / floor, "ratio": ratio, "rho": rho}).withColumn("identity", 2 * F.col("rho") * F.col("ratio") - F.pow("ratio", 2)).drop("_pp", "_pd")


def block_holdout(bins: DataFrame, key: str, at: str, share: float, least: int, gap: int, seed: int | str) -> DataFrame:
    """``bins`` with ``block``: forecast (the last share of the account's span), interior (a block of the same length
    placed by hash before it), gap (within ``gap`` bins of either) or train. Accounts too short keep train."""
    w = Window.partitionBy(key)
    lo, hi = F.min(at).over(w), F.max(at).over(w)
    size = F.greatest(F.floor((hi - lo + 1) * share), F.lit(least))
    room = hi - lo + 1 - 2 * size - 3 * gap
    start = lo + gap + F.floor(unit_hash(F.col(key), seed) * F.greatest(room, F.lit(1)))
    t = F.col(at)
    block = F.when(room < 1, "train").when(t > hi - size, "forecast").when((t >= start) & (t < start + size), "interior")
    near = ((t > hi - size - gap) & (t <= hi - size)) | ((t >= start - gap) & (t < start + size + gap))
    return bins.withColumn("block", block.when(near, "gap").otherwise("train"))


def movement(rows: DataFrame, key: str, at: str, state: str, least: int = 2) -> DataFrame:
    """Per key the way from its first to its last state: first, last, moved, n."""
    g = rows.groupBy(key).agg(F.min_by(state, at).alias("first"), F.max_by(state, at).alias("last"), F.count("*").alias("n"))
    return g.where(F.col("n") >= least).withColumn("moved", F.col("last") - F.col("first"))


def between_bins(rows: DataFrame, key: str, at: str, state: str, step: int) -> DataFrame:
    """States interpolated linearly on a grid of ``step`` between neighbouring rows of a key: key, t, x."""
    w = Window.partitionBy(key).orderBy(at)
    ahead = rows.withColumn("_t1", F.lead(at).over(w)).withColumn("_x1", F.lead(state).over(w))
    last = F.coalesce(F.col("_t1") - 1, F.col(at))
    grid = ahead.withColumn("_hi", last).withColumn("t", F.explode(F.sequence(F.col(at), F.col("_hi"), F.lit(step))))
    x = F.col(state) + (F.col("_x1") - F.col(state)) * (F.col("t") - F.col(at)) / (F.col("_t1") - F.col(at))
    return grid.select(key, "t", F.coalesce(x, F.col(state)).alias("x"))


def training_rows() -> Column:
    """Pairs that a model may be fitted on: of training accounts, inside the time window."""
    return (F.col("traj_split") == "train") & (F.col("time_split") == "in")


def permuted(rows: DataFrame, keys: Sequence[str], at: str, values: Sequence[str], drawn: Column) -> DataFrame:
    """``rows`` with ``values`` moved together within each key, in the order of the hash ``drawn``; the times stay."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(at))
    other = F.row_number().over(Window.partitionBy(*keys).orderBy("_h", at))
    left = rows.withColumn("_k", place).drop(*values)
    right = rows.withColumn("_h", drawn).withColumn("_k", other).select(*keys, "_k", *values)
    return left.join(right, [*keys, "_k"]).drop("_k").select(*rows.columns)


def timeline(rows: DataFrame, by: Sequence[str], cluster: str, x: str, y: str, weight: str, replicates: int) -> DataFrame:
    """Per period the weighted mean of x and its correlation with y, each with its 95 % range over drawn clusters."""
    from tallgrass.operators.resampling import interval, replicate_sums

    w, a, b = F.col(weight), F.col(x), F.col(y)
    parts = {"_w": w, "_x": w * a, "_y": w * b, "_xx": w * a * a, "_yy": w * b * b, "_xy": w * a * b}
    sums = rows.groupBy(*by, cluster).agg(*[F.sum(c).alias(n) for n, c in parts.items()])
    rep = replicate_sums(sums, cluster, list(parts), by, replicates)
    m = lambda n: F.col(n) / F.col("_w")
    r = (m("_xy") - m("_x") * m("_y")) / F.sqrt((m("_xx") - m("_x") * m("_x")) * (m("_yy") - m("_y") * m("_y")))
    named = lambda t, n: t.withColumnsRenamed({"value": n, "low": f"{n}_low", "high": f"{n}_high"})
    return named(interval(rep, m("_x"), by), "mean").join(named(interval(rep, r, by), "r"), list(by))


def drift_halves(cells: DataFrame, account: str, target: str, at: str, n: str, s: str, s2: str, middle: int, least: int, replicates: int, per_half: int, accounts: int, seed: int) -> DataFrame:
    """One row: do an account's targets drift together? Targets are halved at random, and the accounts' mean drifts over
    both halves are correlated: r, its range over the halvings, their number, and Spearman-Brown's reliability.

    A drift is the move of a pair's mean from before ``middle`` to after it, less that of all accounts on the target,
    weighted by its precision. Pairs need ``least`` posts on both sides, accounts ``per_half`` targets in each half.
    """
    from tallgrass.operators.resampling import digest_unit

    early = F.col(at) < middle
    part = lambda c, on, name: F.sum(F.when(on, F.col(c))).alias(name)
    h = cells.groupBy(account, target).agg(*[part(c, on, f"_{name}{i}") for name, c in (("n", n), ("s", s), ("q", s2)) for i, on in ((0, early), (1, ~early))])
    h = h.where((F.col("_n0") >= least) & (F.col("_n1") >= least))
    within = (F.col("_q0") - F.col("_s0") * F.col("_s0") / F.col("_n0") + F.col("_q1") - F.col("_s1") * F.col("_s1") / F.col("_n1")) / (F.col("_n0") + F.col("_n1") - 2)
    d = h.select(account, target, (F.col("_n0") + F.col("_n1")).alias("_n"), (F.col("_s1") / F.col("_n1") - F.col("_s0") / F.col("_n0")).alias("_d"), (within * (1 / F.col("_n0") + 1 / F.col("_n1"))).alias("_v")).where("_v > 0")
    own = d.groupBy(target).agg((F.sum(F.col("_d") * F.col("_n")) / F.sum("_n")).alias("_m"))
    c = d.join(own, target).select(account, target, (F.col("_d") - F.col("_m")).alias("_d"), (1 / F.col("_v")).alias("_w"))
    r = c.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    half = digest_unit(F.lit(seed), F.col(target), F.col("rep")) < 0.5
    mean = lambda on: F.sum(F.when(on, F.col("_d") * F.col("_w"))) / F.sum(F.when(on, F.col("_w")))
    g = r.groupBy("rep", account).agg(mean(half).alias("x"), mean(~half).alias("y"), F.count_if(half).alias("c0"), F.count_if(~half).alias("c1"))
    z = g.where((F.col("c0") >= per_half) & (F.col("c1") >= per_half)).groupBy("rep").agg(F.corr("x", "y").alias("r"), F.count("*").alias("_a")).where(F.col("_a") >= accounts)
    t = z.agg(F.avg("r").alias("r"), F.percentile("r", F.array(F.lit(0.025), F.lit(0.975))).alias("_q"), F.count("*").alias("replicates"))
    return t.select("r", F.col("_q")[0].alias("low"), F.col("_q")[1].alias("high"), "replicates", (2 * F.col("r") / (1 + F.col("r"))).alias("reliability"))


def load_trends(cells: DataFrame, account: str, target: str, at: str, n: str, days: int, origin: int, least: int, words: Sequence[str], leave: Sequence[str]) -> DataFrame:
    """Counts per account, target and bin of ``days`` days (``us``), of targets that hold one of ``words`` and are not in
    ``leave``, for accounts with ``least`` posts; repeated rows count once."""
    from tallgrass.functions.text import contains_any
    from tallgrass.functions.time import bin_start, micros

    once = cells.where(f"trim({account}) <> '' and {target} is not null").where(contains_any(F.col(target), words) & ~F.col(target).isin(*leave)).select(account, target, at, n).distinct()
    bins = once.groupBy(account, target, bin_start(micros(at), days, origin).alias("us")).agg(F.sum(n).alias(n))
    kept = bins.groupBy(account).agg(F.sum(n).alias("_all")).where(F.col("_all") >= least)
    return bins.join(kept.select(account), account, "left_semi")


def filled_pivot(rows: DataFrame, keys: Sequence[str], at: str, name: str, names: Sequence[str], value: str) -> DataFrame:
    """One column ``_0``, ``_1``, ... per name: gaps take the key's next value, else its last, else the column's mean."""
    wide = rows.where(F.col(name).isin(*names)).groupBy(*keys, at).agg(*[F.sum(F.when(F.col(name) == x, F.col(value))).alias(f"_{i}") for i, x in enumerate(names)])
    w = Window.partitionBy(*keys).orderBy(at)
    ahead, behind = w.rowsBetween(1, Window.unboundedFollowing), w.rowsBetween(Window.unboundedPreceding, -1)
    filled = wide.select(*keys, at, *[F.coalesce(c, F.first(c, ignorenulls=True).over(ahead), F.last(c, ignorenulls=True).over(behind)).alias(c) for c in (f"_{i}" for i in range(len(names)))])
    means = filled.agg(*[F.avg(f"_{i}").alias(f"m{i}") for i in range(len(names))])
    return filled.join(F.broadcast(means)).select(*keys, at, *[F.coalesce(f"_{i}", f"m{i}").alias(f"_{i}") for i in range(len(names))])  # one row of means
