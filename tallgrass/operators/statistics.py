"""Tests and descriptions of drift, groups and polarization as plain aggregations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallgrass.operators.numeric import running_least, running_sums
from tallgrass.staging import settle

MOST_GROUPS = 2000


def average_ranks(rows: DataFrame, value: str, within: Sequence[str] = ()) -> DataFrame:
    """``rows`` with ``rank``: ties share the mean of their places.

    Ranks come from counts per distinct value, summed over ordered blocks of them, so nothing is ordered in one task.
    """
    counts = rows.groupBy(*within, value).agg(F.count("*").alias("_n"))
    ranks = running_sums(counts, within, [value], {"_before": F.col("_n")})
    ranks = ranks.select(*within, value, (F.col("_before") + (F.col("_n") + 1) / 2).alias("rank"))
    return rows.join(ranks, [*within, value])


def share_below(rows: DataFrame, value: str) -> DataFrame:
    """(value, below) per distinct value: the share of the other rows that are less."""
    n = rows.count()
    counts = rows.groupBy(value).agg(F.count("*").alias("_n"))
    return running_sums(counts, [], [value], {"_before": F.col("_n")}).select(value, (F.col("_before") / F.lit(max(n - 1, 1))).alias("below"))


def mann_whitney(rows: DataFrame, value: str, group: str, first: object) -> DataFrame:
    """One row: U of ``first`` against the rest, sizes, and z without tie correction."""
    ranked = average_ranks(rows.where(F.col(value).isNotNull()), value)
    a = F.col(group) == F.lit(first)
    t = ranked.agg(F.sum(F.when(a, F.col("rank"))).alias("r"), F.count_if(a).alias("n1"), F.count_if(~a).alias("n2"))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    u = F.col("r") - n1 * (n1 + 1) / 2
    return t.select(u.alias("u"), "n1", "n2", ((u - n1 * n2 / 2) / F.sqrt(n1 * n2 * (n1 + n2 + 1) / 12)).alias("z"))


def wilcoxon(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row: signed-rank sums of a - b over non-zero differences, and z by the normal approximation."""
    d = rows.select((F.col(a) - F.col(b)).alias("d")).where("d <> 0").withColumn("m", F.abs("d"))
    ranked = average_ranks(d, "m")
    t = ranked.agg(F.sum(F.when(F.col("d") > 0, F.col("rank")).otherwise(0.0)).alias("w_plus"), F.sum(F.when(F.col("d") < 0, F.col("rank")).otherwise(0.0)).alias("w_minus"), F.count("*").alias("n"))
    n = F.col("n").cast("double")
    return t.withColumn("z", (F.col("w_plus") - n * (n + 1) / 4) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24))


def benjamini_hochberg(tests: DataFrame, p: str, monotone: bool = False) -> DataFrame:
    """``tests`` with ``adjusted`` = p m / rank, at most 1; with ``monotone`` the step-up minimum as well."""
    m = tests.count()
    ranked = running_sums(tests, [], [p], {"_before": F.lit(1)})
    adjusted = ranked.withColumn("adjusted", F.least(F.lit(1.0), F.col(p) * m / (F.col("_before") + 1)))
    if not monotone:
        return adjusted.drop("_before")
    above = running_least(adjusted, [], [F.desc("_before")], {"_least": F.col("adjusted")})
    return above.withColumn("adjusted", F.least("adjusted", "_least")).drop("_before", "_least")


def chi_square(rows: DataFrame, item: Sequence[str], category: str, period: str, least: int = 10) -> DataFrame:
    """Per item: chi-square of category against period and degrees of freedom; 0 below ``least`` rows."""
    cells = rows.groupBy(*item, category, period).agg(F.count("*").alias("o"))
    part = lambda *c: F.sum("o").over(Window.partitionBy(*item, *c))
    t = cells.withColumns({"r": part(category), "c": part(period), "n": part()})
    # empty cells add their expectation: the sum of (o - e)^2 / e is n (sum of o^2 / (r c) - 1)
    per = t.groupBy(*item).agg((F.max("n") * (F.sum(F.col("o") * F.col("o") / (F.col("r") * F.col("c"))) - 1)).alias("chi2"), F.countDistinct(category).alias("a"), F.countDistinct(period).alias("b"), F.max("n").alias("n"))
    return per.select(*item, F.when(F.col("n") >= least, F.col("chi2")).otherwise(0.0).alias("chi2"), ((F.col("a") - 1) * (F.col("b") - 1)).alias("df"), "n")


def box_statistics(rows: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """Quartiles and whiskers at 1.5 interquartile ranges, whiskers being values that occur."""
    q = rows.groupBy(*group).agg(F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("_q")).select(*group, F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("median"), F.col("_q")[2].alias("q3"))
    inside = F.col(value).between(F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")), F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")))
    return rows.join(q, list(group)).groupBy(*group).agg(
        F.first("q1").alias("q1"), F.first("median").alias("median"), F.first("q3").alias("q3"), F.min(F.when(inside, F.col(value))).alias("low"), F.max(F.when(inside, F.col(value))).alias("high"), F.count_if(~inside).alias("outliers")
    )


def eta_squared(rows: DataFrame, group: str, value: str, least: int = 5) -> DataFrame:
    """One row: between-group share of the variance and F, over groups of ``least`` rows or more."""
    per = rows.groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v")).where(F.col("n") >= least)
    whole = per.agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("g"))
    t = per.join(F.broadcast(whole)).agg(F.sum(F.col("n") * F.pow(F.col("m") - F.col("g"), 2)).alias("b"), F.sum(F.col("n") * F.col("v")).alias("w"), F.sum("n").alias("n"), F.count("*").alias("k"))
    return t.select((F.col("b") / (F.col("b") + F.col("w"))).alias("eta2"), ((F.col("b") / (F.col("k") - 1)) / (F.col("w") / (F.col("n") - F.col("k")))).alias("f"), "n", "k")


def cohens_d_pairs(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Per unordered pair of groups: difference of means over the pooled deviation. More than ``MOST_GROUPS`` groups are an
    error, as every two of them give a row."""
    per = settle(rows.groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v")))
    if per.count() > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} groups to compare with each other")
    side = lambda s: per.select(F.lit(1).alias("_one"), *[F.col(c).alias(f"{c}_{s}") for c in (group, "n", "m", "v")])
    # a table of one row per group, at most MOST_GROUPS, with itself
    j = side("a").join(F.broadcast(side("b")), "_one").where(F.col(f"{group}_a") < F.col(f"{group}_b"))
    pooled = F.sqrt(((F.col("n_a") - 1) * F.col("v_a") + (F.col("n_b") - 1) * F.col("v_b")) / (F.col("n_a") + F.col("n_b") - 2))
    return j.select(f"{group}_a", f"{group}_b", ((F.col("m_a") - F.col("m_b")) / pooled).alias("d"))


def variance_fractions(long: DataFrame, key: str, dim: str, value: str) -> DataFrame:
    """Per key: dominant dimension, entropy and participation ratio of the variance over dimensions.

    A key without any variance, as one of a single reading, has no fractions: they are NaN (0 / 0), and so is what follows.
    """
    v = long.groupBy(key, dim).agg(F.var_pop(value).alias("v")).withColumn("_all", F.sum("v").over(Window.partitionBy(key)))
    f = v.withColumn("f", F.when(F.col("_all") == 0, F.col("v") * float("nan")).otherwise(F.col("v") / F.col("_all")))
    return f.groupBy(key).agg(
        F.max_by(dim, F.struct("f", -F.col(dim))).alias("dominant"), F.sum(F.when(F.col("f") > 0, -F.col("f") * F.log("f")).otherwise(0.0)).alias("entropy"), (1 / F.sum(F.col("f") * F.col("f"))).alias("participation")
    )


def polarization_symmetric(value: str) -> Column:
    """Mean absolute deviation over two, as an aggregate that needs the mean in ``_mean``."""
    return F.avg(F.abs(F.col(value) - F.col("_mean"))) / 2


def polarization(rows: DataFrame, by: Sequence[str], value: str, bins: int, low: float, high: float, alpha: float = 1.6) -> DataFrame:
    """Per group: symmetric polarization, and Esteban-Ray's over a histogram of ``bins`` (sum of p_i^(1+alpha) p_j |i - j|)."""
    mean = rows.withColumn("_mean", F.avg(value).over(Window.partitionBy(*by)))
    sym = mean.groupBy(*by).agg(polarization_symmetric(value).alias("symmetric"))
    width = (high - low) / bins
    b = F.least(F.greatest(F.floor((F.col(value) - low) / width), F.lit(0)), F.lit(bins - 1))
    h = rows.groupBy(*by, b.alias("b")).agg(F.count("*").alias("n"))
    h = h.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(*by)))
    other = h.select(*by, F.col("b").alias("b2"), F.col("p").alias("p2"))
    er = h.join(other, list(by)).groupBy(*by).agg(F.sum(F.pow("p", 1 + alpha) * F.col("p2") * F.abs(F.col("b") - F.col("b2")) * width).alias("esteban_ray"))
    return sym.join(er, list(by))


def kernel_regression(rows: DataFrame, by: str, at: str, value: str, bandwidth: float, reach: int) -> DataFrame:
    """Local linear regression with a Gaussian kernel at every integer time of a key's span: (by, t, fit), within [-1, 1].

    The kernel ends at ``reach``; grid points and rows meet by bucket, and each point needs five sums.
    """
    span = rows.groupBy(by).agg(F.min(at).alias("_lo"), F.max(at).alias("_hi"))
    grid = span.select(by, F.explode(F.sequence("_lo", "_hi")).alias("t"))
    bucket = lambda c: F.floor(F.col(c) / reach)
    near = rows.select(by, F.col(at).alias("_s"), F.col(value).alias("_y"), F.explode(F.array(*[bucket(at) + i for i in (-1, 0, 1)])).alias("_b"))
    j = grid.withColumn("_b", bucket("t")).join(near, [by, "_b"]).withColumn("_d", F.col("_s") - F.col("t")).where(F.abs("_d") <= reach)
    k = F.exp(-F.pow(F.col("_d") / bandwidth, 2) / 2)
    s = j.groupBy(by, "t").agg(F.sum(k).alias("s0"), F.sum(k * F.col("_d")).alias("s1"), F.sum(k * F.col("_d") * F.col("_d")).alias("s2"), F.sum(k * F.col("_y")).alias("y0"), F.sum(k * F.col("_d") * F.col("_y")).alias("y1"))
    det = F.col("s0") * F.col("s2") - F.col("s1") * F.col("s1")
    fit = F.when(det > 1e-9, (F.col("s2") * F.col("y0") - F.col("s1") * F.col("y1")) / det).otherwise(F.col("y0") / F.col("s0"))
    return s.select(by, "t", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), fit)).alias("fit"))


def transitions(rows: DataFrame, key: str, order: Sequence[str], state: str) -> DataFrame:
    """Counts and shares of a state following another within a key: before, after, n, p."""
    w = Window.partitionBy(key).orderBy(*order)
    pairs = rows.select(F.col(state).alias("before"), F.lead(state).over(w).alias("after")).where("after is not null")
    n = pairs.groupBy("before", "after").agg(F.count("*").alias("n"))
    return n.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("before")))


def window_drift(rows: DataFrame, at: str, value: str, windows: int) -> DataFrame:
    """Rows cut into ``windows`` stretches of equal time; each against the first: mean, Cohen's d, ratio of variances."""
    ends = rows.agg(F.min(at).alias("_lo"), F.max(at).alias("_hi"))
    w = F.least(F.floor((F.col(at) - F.col("_lo")) * windows / (F.col("_hi") - F.col("_lo") + 1)), F.lit(windows - 1))
    per = rows.join(F.broadcast(ends)).groupBy(w.alias("window")).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("v"))
    base = per.where("window = 0").select(F.col("n").alias("n0"), F.col("mean").alias("m0"), F.col("v").alias("v0"))
    pooled = F.sqrt(((F.col("n") - 1) * F.col("v") + (F.col("n0") - 1) * F.col("v0")) / (F.col("n") + F.col("n0") - 2))
    return per.join(F.broadcast(base)).select("window", "n", "mean", ((F.col("mean") - F.col("m0")) / pooled).alias("d"), (F.col("v") / F.col("v0")).alias("variance_ratio"))


def spread_trend(rows: DataFrame, at: str, value: str) -> DataFrame:
    """One row: slope and r2 of the spread across keys on time."""
    per = rows.groupBy(at).agg(F.stddev_samp(value).alias("sd")).where("sd is not null")
    return per.agg(F.regr_slope("sd", at).alias("slope"), F.regr_r2("sd", at).alias("r2"), F.count("*").alias("times"))


def weighted_pearson(x: Column, y: Column, w: Column) -> Column:
    """Weighted correlation from six sums."""
    s = F.sum(w)
    mx, my = F.sum(w * x) / s, F.sum(w * y) / s
    cov = F.sum(w * x * y) / s - mx * my
    return cov / F.sqrt((F.sum(w * x * x) / s - mx * mx) * (F.sum(w * y * y) / s - my * my))


def density_grid(points: DataFrame, x: str, y: str, lo: float, hi: float, size: int, bandwidth: float) -> DataFrame:
    """Gaussian kernel density of points on a size x size grid: (i, j, density).

    Each point adds to the grid points within four bandwidths only; the grid is small and fixed.
    """
    step = (hi - lo) / (size - 1)
    reach = int(4 * bandwidth / step) + 1
    cell = lambda c: F.round((F.col(c) - lo) / step).cast("int")
    around = lambda c: F.explode(F.sequence(F.greatest(c - reach, F.lit(0)), F.least(c + reach, F.lit(size - 1))))
    p = points.select(F.col(x).alias("_x"), F.col(y).alias("_y")).where((cell("_x") + reach >= 0) & (cell("_x") - reach < size) & (cell("_y") + reach >= 0) & (cell("_y") - reach < size))
    spread = p.withColumn("i", around(cell("_x"))).withColumn("j", around(cell("_y")))
    d2 = F.pow(F.col("_x") - (F.lit(lo) + F.col("i") * step), 2) + F.pow(F.col("_y") - (F.lit(lo) + F.col("j") * step), 2)
    k = F.exp(-d2 / (2 * bandwidth * bandwidth))
    return spread.where(d2 <= 16 * bandwidth * bandwidth).groupBy("i", "j").agg(F.sum(k).alias("density"))


def grid_maxima(grid: DataFrame, distance: int = 2, most: int = 10) -> DataFrame:
    """Grid points whose density is above all others within ``distance`` cells, the highest ``most``."""
    near = F.explode(F.array(*[F.struct((F.col("i") + a).alias("i"), (F.col("j") + b).alias("j")) for a in range(-distance, distance + 1) for b in range(-distance, distance + 1) if a or b]))
    around = grid.select(near.alias("_c"), F.col("density").alias("_d")).groupBy(F.col("_c.i").alias("i"), F.col("_c.j").alias("j")).agg(F.max("_d").alias("_m"))
    top = grid.join(around, ["i", "j"], "left").where("_m is null or density > _m")
    return top.orderBy(F.desc("density"), "i", "j").limit(most).select("i", "j", "density")
