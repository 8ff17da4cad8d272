"""Panels of accounts: ranking of targets, holes and standards, flows, losses and timelines."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallgrass.operators.clusters import unit_vectors
from tallgrass.operators.joins import dot
from tallgrass.operators.sampling import hash_order
from tallgrass.operators.numeric import normal_cdf
from tallgrass.staging import settle


def top_loadings(loadings: DataFrame, target: str, vector: str, volume: str, k: int) -> DataFrame:
    """Per dimension the ``k`` targets with the largest |loading| times the root of their volume: dim, target, strength."""
    long = loadings.select(target, F.posexplode(vector).alias("dim", "l"), volume).withColumn("strength", F.abs("l") * F.sqrt(F.col(volume).cast("double")))
    ranked = long.withColumn("_r", F.row_number().over(Window.partitionBy("dim").orderBy(F.desc("strength"), target)))
    return ranked.where(F.col("_r") <= k).select("dim", target, "strength")


def similar(rows: DataFrame, ident: str, vector: str, query: Sequence[float], least: float, page: int, size: int) -> DataFrame:
    """One page of the rows whose cosine with the query exceeds ``least``, best first."""
    q = np.asarray(query, float)
    v = F.col(vector).cast("array<double>")
    cosine = dot(v, F.array(*[F.lit(float(x)) for x in q / max(np.linalg.norm(q), 1e-12)])) / F.greatest(F.sqrt(dot(v, v)), F.lit(1e-12))
    hits = rows.select(ident, cosine.alias("score")).where(F.col("score") > least)
    return hits.orderBy(F.desc("score"), ident).limit((page + 1) * size).offset(page * size)


def similar_pages(rows: DataFrame, queries: DataFrame, ident: str, vector: str, least: float, page: int, size: int, block: int = 2000) -> DataFrame:
    """(query, ident, score): per query one page of the rows whose cosine with it exceeds ``least``, best first, ties by
    ident. Rows without a direction (null, NaN, zero) are left out.

    Exact: all rows meet all queries in blocks as matrices; a block hands on no more hits of a query than pages so far hold.
    """
    units, asked = settle(unit_vectors(rows, ident, vector)), settle(unit_vectors(queries, ident, vector))
    n, m, last = max(1, -(-units.count() // block)), max(1, -(-asked.count() // block)), (page + 1) * size
    part = lambda k: F.pmod(F.xxhash64(ident), F.lit(k)).cast("int")
    left = units.withColumn("g", part(n)).withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    right = asked.withColumn("h", part(m)).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    kind = units.schema[ident].dataType.simpleString()

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({"query": b[ident].iloc[:0], ident: a[ident].iloc[:0], "score": np.zeros(0)})]
        if len(a) and len(b):
            a = a.sort_values(ident)
            v, names = np.array(a["v"].tolist()), a[ident].to_numpy()
            for q, x in zip(b[ident], b["v"]):
                score = np.einsum("ij,j->i", v, np.asarray(x, float))  # not BLAS: equal rows score equally wherever they lie
                hit = np.flatnonzero(score > least)
                best = hit[np.argsort(-score[hit], kind="stable")[:last]]
                found.append(pd.DataFrame({"query": q, ident: names[best], "score": score[best]}))
        return pd.concat(found, ignore_index=True)

    hits = left.groupBy("g", "h").cogroup(right.groupBy("g", "h")).applyInPandas(meet, f"query {kind}, {ident} {kind}, score double")
    ranked = hits.withColumn("_r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), ident)))
    return ranked.where((F.col("_r") > page * size) & (F.col("_r") <= last)).drop("_r")


def class_keywords(texts: DataFrame, group: str, text: str, k: int, pattern: str = r"\p{L}{3,}") -> DataFrame:
    """Per class the ``k`` words of highest class-based TF-IDF: share in the class times log(1 + mean class size / uses)."""
    words = texts.select(group, F.explode(F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))).alias("word"))
    tf = words.groupBy(group, "word").agg(F.count("*").alias("n"))
    per = Window.partitionBy(group)
    uses = tf.groupBy("word").agg(F.sum("n").alias("uses"))
    size = tf.groupBy(group).agg(F.sum("n").alias("s")).agg(F.avg("s").alias("mean_size"))
    score = F.col("n") / F.col("size") * F.log(1 + F.col("mean_size") / F.col("uses"))
    scored = tf.withColumn("size", F.sum("n").over(per)).join(uses, "word").join(F.broadcast(size)).withColumn("score", score)
    return scored.withColumn("_r", F.row_number().over(per.orderBy(F.desc("score"), "word"))).where(F.col("_r") <= k).select(group, "word", "score")


def exemplars(rows: DataFrame, group: str, key: str, n: int, seed: int | str) -> DataFrame:
    """``n`` rows of each group by hash."""
    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(hash_order(F.col(key), seed), key)))
    return ranked.where(F.col("_r") <= n).drop("_r")


def stance_summary(rows: DataFrame, target: str, stance: str) -> DataFrame:
    """Per target in one pass: n, mean, sd, mean of absolutes, and the counts of each side."""
    s = F.col(stance)
    return rows.groupBy(target).agg(F.count(s).alias("n"), F.avg(s).alias("mean"), F.stddev_samp(s).alias("sd"), F.avg(F.abs(s)).alias("strength"), F.count_if(s > 0).alias("favor"), F.count_if(s < 0).alias("against"), F.count_if(s == 0).alias("neutral"))


def filter_counts(rows: DataFrame, filters: Sequence[tuple[str, Column]], extra: Sequence[str], least: int) -> DataFrame:
    """(filter_type, filter_value, *extra, n) of every filter with ``least`` rows or more, in one pass."""
    table = F.array(*[F.struct(F.lit(n).alias("filter_type"), c.cast("string").alias("filter_value")) for n, c in filters])
    long = rows.select(*extra, F.explode(table).alias("_f")).select(*extra, "_f.filter_type", "_f.filter_value").where("filter_value is not null")
    return long.groupBy("filter_type", "filter_value", *extra).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def step_variance(states: DataFrame, key: str, at: str, vector: str) -> DataFrame:
    """(dim, variance of the first difference within accounts)."""
    w = Window.partitionBy(key).orderBy(at)
    steps = states.select(F.zip_with(vector, F.lag(vector).over(w), lambda a, b: a - b).alias("_d"))
    d = steps.select(F.posexplode("_d").alias("dim", "d"))
    return d.where("d is not null and not isnan(d)").groupBy("dim").agg(F.var_samp("d").alias("variance"))


def standardised(rows: DataFrame, value: str, training: Column) -> DataFrame:
    """``value`` less the training rows' mean over their deviation (population); 0 where they don't vary."""
    m = rows.agg(F.avg(F.when(training, F.col(value))).alias("_m"), F.stddev_pop(F.when(training, F.col(value))).alias("_s"))
    return rows.join(F.broadcast(m)).withColumn(value, F.when(F.col("_s") > 0, (F.col(value) - F.col("_m")) / F.col("_s")).otherwise(0.0)).drop("_m", "_s")


def certain_accounts(states: DataFrame, key: str, sd: str, most: float) -> DataFrame:
    """Accounts whose median posterior deviation is at most ``most``."""
    return states.groupBy(key).agg(F.median(sd).alias("median_sd")).where(F.col("median_sd") <= most)


def balanced_panel(states: DataFrame, key: str, at: str, cuts: int = 21, least_accounts: int = 2, least_bins: int = 2) -> DataFrame:
    """One row, the window [start, end] with the most accounts times bins, an account being in if its span holds the window.

    Candidates are quantiles of the spans' starts and ends; spans are counted per candidate pair without pairing rows.
    """
    spans = settle(states.groupBy(key).agg(F.min(at).alias("lo"), F.max(at).alias("hi")))
    p = F.array(*[F.lit(i / (cuts - 1)) for i in range(cuts)])
    q = spans.agg(F.percentile("lo", p).alias("a"), F.percentile("hi", p).alias("b")).first()
    if q["a"] is None:
        return spans.select(F.col("lo").alias("start"), F.col("hi").alias("end"), F.lit(0).alias("accounts"), F.lit(0.0).alias("size")).limit(0)
    starts, ends = sorted({float(math.ceil(x)) for x in q["a"]}), sorted({float(math.floor(x)) for x in q["b"]})
    # each span falls into one cell of the two short lists; the cells are few
    first = F.size(F.filter(F.array(*[F.lit(s) for s in starts]), lambda s: s < F.col("lo")))
    last = F.size(F.filter(F.array(*[F.lit(e) for e in ends]), lambda e: e <= F.col("hi")))
    cells = [(r["i"], r["j"], r["count"]) for r in spans.groupBy(first.alias("i"), last.alias("j")).count().collect()]
    best = None
    for i, s in enumerate(starts):
        for j, e in enumerate(ends):
            bins = e - s + 1
            accounts = sum(n for a, b, n in cells if a <= i and b > j)
            if bins >= least_bins and accounts >= least_accounts and (best is None or accounts * bins > best[3]):
                best = (s, e, accounts, accounts * bins)
    return states.sparkSession.createDataFrame([best] if best else [], "start double, end double, accounts int, size double")


def flow_field(states: DataFrame, key: str, at: str, x: str, y: str, size: int, bandwidth: float, tail: float = 0.01, margin: float = 0.1) -> DataFrame:
    """Mean displacement to the account's next state around each grid point: i, j, x, y, dx, dy, weight; drawn towards 0
    where there is little weight. Displacements stay within accounts and are clipped per axis at their exact ``tail`` and
    1 - ``tail`` quantiles. The grid spans all moves' starts with ``margin`` of their range on each side.

    A move adds to the grid points within three bandwidths only; the grid is small.
    """
    w = Window.partitionBy(key).orderBy(at)
    moves = settle(states.select(F.col(x).alias("_x"), F.col(y).alias("_y"), (F.lead(x).over(w) - F.col(x)).alias("_dx"), (F.lead(y).over(w) - F.col(y)).alias("_dy")).where("_dx is not null and _dy is not null"))
    ends = F.array(F.lit(tail), F.lit(1 - tail))
    m = moves.agg(F.min("_x").alias("x0"), F.max("_x").alias("x1"), F.min("_y").alias("y0"), F.max("_y").alias("y1"), F.percentile("_dx", ends).alias("dx"), F.percentile("_dy", ends).alias("dy")).first()
    if m["x0"] is None:
        return moves.select(F.lit(0).alias("i"), F.lit(0).alias("j"), *[F.lit(0.0).alias(c) for c in ("x", "y", "dx", "dy", "weight")]).limit(0)
    held = lambda c, q: F.greatest(F.lit(q[0]), F.least(F.lit(q[1]), F.col(c)))

    def axis(low: float, high: float) -> tuple[float, float, int]:
        pad = margin * (high - low) or bandwidth
        step = (high - low + 2 * pad) / (size - 1)
        return low - pad, step, int(3 * bandwidth / step) + 1

    (x0, x_step, x_reach), (y0, y_step, y_reach) = axis(m["x0"], m["x1"]), axis(m["y0"], m["y1"])

    def around(c: str, low: float, step: float, reach: int) -> Column:
        cell = F.round((F.col(c) - low) / step).cast("int")
        return F.explode(F.sequence(F.greatest(cell - reach, F.lit(0)), F.least(cell + reach, F.lit(size - 1))))

    near = moves.withColumn("i", around("_x", x0, x_step, x_reach)).withColumn("j", around("_y", y0, y_step, y_reach))
    near = near.withColumn("x", x0 + F.col("i") * x_step).withColumn("y", y0 + F.col("j") * y_step)
    d2 = F.pow(F.col("_x") - F.col("x"), 2) + F.pow(F.col("_y") - F.col("y"), 2)
    k = F.exp(-d2 / (2 * bandwidth * bandwidth))
    drawn = lambda c: F.sum(k * held(f"_{c}", m[c])) / (F.sum(k) + 1)
    return near.where(d2 <= 9 * bandwidth * bandwidth).groupBy("i", "j", "x", "y").agg(drawn("dx").alias("dx"), drawn("dy").alias("dy"), F.sum(k).alias("weight"))


def per_dimension(pairs: DataFrame, x0: str, x1: str, guess: str) -> DataFrame:
    """Per dimension of array states: model loss, no-movement loss, skill, and whether the dimension moves at all."""
    z = pairs.select(F.posexplode(F.arrays_zip(F.col(x0).alias("a"), F.col(x1).alias("b"), F.col(guess).alias("g"))).alias("dim", "s"))
    t = z.groupBy("dim").agg(F.avg(F.pow(F.col("s")["2"] - F.col("s")["1"], 2)).alias("model_loss"), F.avg(F.pow(F.col("s")["1"] - F.col("s")["0"], 2)).alias("baseline_loss"))
    return t.withColumn("frozen", F.col("baseline_loss") < 1e-12).withColumn("skill", F.when(~F.col("frozen"), 1 - F.col("model_loss") / F.col("baseline_loss")))


def loss_ratios(losses: DataFrame, by: Sequence[str], model: str, baseline: str) -> DataFrame:
    """Six summaries of a model's loss against a baseline's: median and quartiles of the ratio, mean ratio, ratio of
    means, ratio of medians, difference of means."""
    ratio = F.col(model) / F.greatest(F.col(baseline), F.lit(1e-12))
    g = losses.groupBy(*by).agg(F.percentile(ratio, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("_q"), F.avg(ratio).alias("mean_ratio"), (F.avg(model) / F.greatest(F.avg(baseline), F.lit(1e-12))).alias("ratio_of_means"), (F.median(model) / F.greatest(F.median(baseline), F.lit(1e-12))).alias("ratio_of_medians"), (F.avg(model) - F.avg(baseline)).alias("difference"))
    return g.select(*by, F.col("_q")[1].alias("median_ratio"), F.col("_q")[0].alias("q1"), F.col("_q")[2].alias("q3"), "mean_ratio", "ratio_of_means", "ratio_of_medians", "difference")


def error_table(pairs: DataFrame, by: Sequence[str], error: Column) -> DataFrame:
    """Mean, median, root mean square and 90th percentile of an error."""
    return pairs.groupBy(*by).agg(F.avg(error).alias("mean"), F.median(error).alias("median"), F.sqrt(F.avg(error * error)).alias("rmse"), F.percentile(error, F.lit(0.9)).alias("p90"))


def fold_summary(folds: DataFrame, setting: Sequence[str], fold: str, metrics: Sequence[str]) -> DataFrame:
    """Mean and deviation of metrics over folds; a setting seen twice in a fold raises."""
    twice = folds.groupBy(*setting, fold).count().where("count > 1")
    if not twice.isEmpty():
        raise ValueError("several results for one setting and fold")
    return folds.groupBy(*setting).agg(F.count("*").alias("folds"), *[f(m).alias(f"{m}_{n}") for m in metrics for n, f in (("mean", F.avg), ("sd", F.stddev_samp))])


def split_half(rows: DataFrame, key: str, unit: str, at: str, value: str, seed: int | str) -> DataFrame:
    """One row: correlation of the mean movement per time of two random halves of the units, and Spearman-Brown's value."""
    w = Window.partitionBy(key, unit).orderBy(at)
    moves = rows.select(unit, at, (F.col(value) - F.lag(value).over(w)).alias("d")).where("d is not null")
    half = F.substring(hash_order(F.col(unit), seed), 1, 1) < "8"
    per = moves.groupBy(at).agg(F.avg(F.when(half, F.col("d"))).alias("a"), F.avg(F.when(~half, F.col("d"))).alias("b")).where("a is not null and b is not null")
    return per.agg(F.corr("a", "b").alias("r"), F.count("*").alias("times")).withColumn("reliability", 2 * F.col("r") / (1 + F.col("r")))


def power_law(curve: DataFrame, lag: str, value: str) -> DataFrame:
    """One row: exponent and scale of value = scale * lag^exponent, by least squares on logarithms."""
    pos = curve.where((F.col(lag) > 0) & (F.col(value) > 0))
    x, y = F.log(F.col(lag).cast("double")), F.log(value)
    return pos.agg(F.regr_slope(y, x).alias("exponent"), F.exp(F.regr_intercept(y, x)).alias("scale"), F.regr_r2(y, x).alias("r2"))


def gaussian_mixture_grid(users: DataFrame, by: Sequence[str], mean: str, var: str, low: float, high: float, size: int) -> DataFrame:
    """Sum of users' Gaussians on a grid per group: by, i, density; a user without variance is a mass at its grid point."""
    step = (high - low) / (size - 1)
    grid = F.explode(F.sequence(F.lit(0), F.lit(size - 1)))
    rows = users.select(*by, mean, var, grid.alias("i"))
    at = low + F.col("i") * step
    bell = F.exp(-F.pow(at - F.col(mean), 2) / (2 * F.col(var))) / F.sqrt(2 * math.pi * F.col(var))
    mass = F.when(F.round((F.col(mean) - low) / step) == F.col("i"), 1 / step).otherwise(0.0)
    return rows.groupBy(*by, "i").agg(F.sum(F.when(F.col(var) > 0, bell).otherwise(mass)).alias("density"))


def largest_move(states: DataFrame, key: str, period: str, value: str) -> DataFrame:
    """Per key the range over periods and the periods of its least and greatest value."""
    return states.groupBy(key).agg((F.max(value) - F.min(value)).alias("range"), F.min_by(period, F.struct(value, period)).alias("low_at"), F.max_by(period, F.struct(value, period)).alias("high_at"))


def monthly_snapshots(states: DataFrame, key: str, day: str, value: str) -> DataFrame:
    """(key, month, value): the last state at or before each month's first day, from the month after the first state on."""
    w = Window.partitionBy(key).orderBy(day)
    spans = states.select(key, F.col(day).alias("_a"), F.lead(day).over(w).alias("_b"), value)
    last = F.max("_a").over(Window.partitionBy(key))
    start = F.when(F.dayofmonth("_a") == 1, F.col("_a")).otherwise(F.trunc(F.add_months("_a", 1), "month"))
    spans = spans.withColumn("_s", start).withColumn("_e", F.coalesce(F.date_sub("_b", 1), last))
    return spans.where("_s <= _e").select(key, F.explode(F.expr("sequence(_s, _e, interval 1 month)")).alias("month"), value)


def asymmetric_polarization(shares: Sequence[float], beliefs: Sequence[float]) -> float:
    """Largest weighted distance between the means of two sides over all cuts of the ordered beliefs."""
    best, total = 0.0, sum(shares)
    order = sorted(range(len(beliefs)), key=lambda i: beliefs[i])
    p = [shares[i] / total for i in order] if total else []
    x = [beliefs[i] for i in order]
    for cut in range(1, len(p)):
        a, b = sum(p[:cut]), sum(p[cut:])
        if a > 0 and b > 0:
            gap = sum(q * v for q, v in zip(p[cut:], x[cut:])) / b - sum(q * v for q, v in zip(p[:cut], x[:cut])) / a
            best = max(best, 4 * a * b * gap)
    return best


def hidden_chain(rows: DataFrame, key: str, order: Sequence[str], symbol: str, symbols: int, states: int = 2, passes: int = 20, seed: int = 1, tolerance: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, transition, emission) of a hidden Markov chain over integer symbols by Baum-Welch.

    Accounts' sequences are grouped once; each pass adds up expected counts where they lie and returns one small table.
    Ends when a pass raises the log-likelihood by no more than ``tolerance`` of it; with one, ``passes`` without an end
    raise.
    """
    seqs = settle(rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, symbol))).alias("_l")).select(F.transform("_l", lambda r: r[symbol]).alias("s")))
    rng = np.random.default_rng(seed)
    start, move, emit = np.full(states, 1 / states), np.eye(states) * 0.8 + 0.2 / states, rng.dirichlet(np.ones(symbols) * 5, states)
    move /= move.sum(1, keepdims=True)

    def alike(found):
        """Tables of sequences of about one length, of at most about a million places each."""
        found = sorted(found, key=len)
        while found:
            n = max(1, 1_000_000 // len(found[-1]))
            part, found = found[-n:], found[:-n]
            table = np.full((len(part), len(part[-1])), -1)
            for row, s in zip(table, part):
                row[: len(s)] = s
            yield table

    before = -math.inf
    for _ in range(passes):
        pi, a, b = start, move, emit

        def run(batches, pi=pi, a=a, b=b):
            total = np.zeros(states + states * states + states * symbols + 1)
            for batch in batches:
                for s in alike([np.asarray(s, int) for s in batch["s"]]):
                    # the sequences of one table, short ones filled with -1, go through time together
                    size, n = s.shape
                    f, scale, g, e = np.zeros((n, size, states)), np.ones((n, size)), np.ones((n, size, states)), b.T[np.maximum(s.T, 0)]
                    on = (s >= 0).T
                    for t in range(n):
                        f[t] = (pi if t == 0 else f[t - 1] @ a) * e[t]
                        z = f[t].sum(1)
                        scale[t] = np.where(on[t], z, 1.0)
                        f[t] /= z[:, None]
                    moves = np.zeros((states, states))
                    for t in range(n - 2, -1, -1):
                        later = np.where(on[t + 1][:, None], e[t + 1] * g[t + 1] / scale[t + 1][:, None], 0.0)
                        g[t] = np.where(on[t + 1][:, None], later @ a.T, 1.0)
                        moves += a * (f[t].T @ later)
                    post = f * g * on[:, :, None]
                    seen = np.stack([post[s.T == k].sum(0) for k in range(symbols)], axis=1)
                    total += np.concatenate([post[0].sum(0), moves.ravel(), seen.ravel(), [np.log(scale).sum()]])
            yield pd.DataFrame({"slot": range(len(total)), "v": total})

        v = seqs.mapInPandas(run, "slot int, v double").groupBy("slot").agg(F.sum("v").alias("v")).toPandas().sort_values("slot")["v"].to_numpy()
        v, now = v[:-1] + 1e-6, v[-1]
        start = v[:states] / v[:states].sum()
        move = v[states : states + states * states].reshape(states, states)
        emit = v[states + states * states :].reshape(states, symbols)
        move, emit = move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True)
        if tolerance and now - before <= tolerance * abs(now):
            return start, move, emit
        before = now
    if tolerance:
        raise RuntimeError(f"the chain does not settle within {passes} passes")
    return start, move, emit


def factor_model(cells: DataFrame, account: str, target: str, value: str, count: str, dims: int = 2, passes: int = 8, ridge: float = 1.0, tolerance: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(accounts, targets): static coordinates and loadings with intercept, by alternating weighted least squares.

    Each half-step sums a small block per account or per target where the cells meet the other side's vectors, and
    solves the blocks group by group; nothing but those vectors is exchanged. Ends when a pass lowers the penalised
    squares by no more than ``tolerance`` of them; with one, ``passes`` without an end raise.
    """
    kind = {f.name: f.dataType.simpleString() for f in cells.schema}
    start = F.array(*[(F.xxhash64(F.lit(i), account) / F.lit(float(2**63))).cast("double") for i in range(dims)])
    cells = settle(cells.select(account, target, F.col(value).cast("double").alias("_y"), F.col(count).cast("double").alias("_w")).where("_y is not null and _w > 0"))
    accounts = settle(cells.select(account).distinct().withColumn("z", start))

    def half(side: str, other: DataFrame, other_key: str, name: str, constant: bool) -> DataFrame:
        size = dims + int(constant)
        x = F.concat("_o", F.array(F.lit(1.0))) if constant else F.slice("_o", 1, dims)
        rest = F.lit(0.0) if constant else F.element_at("_o", dims + 1)
        j = cells.join(other.select(other_key, F.col("z").alias("_o")), other_key).select(side, "_w", x.alias("_x"), (F.col("_y") - rest).alias("_r"))
        xx = [F.sum(F.col("_w") * F.col("_x")[a] * F.col("_x")[b]) for a in range(size) for b in range(size)]
        xy = [F.sum(F.col("_w") * F.col("_x")[a] * F.col("_r")) for a in range(size)]
        sums = j.groupBy(side).agg(F.array(*xx).alias("xx"), F.array(*xy).alias("xy"), F.sum(F.col("_w") * F.col("_r") * F.col("_r")).alias("rr"))

        def solve(batches):
            for b in batches:
                z, squares, penalty = [], [], []
                for p, q, r in zip(b["xx"], b["xy"], b["rr"]):
                    p, q = np.array(p, float).reshape(size, size), np.array(q, float)
                    v = np.linalg.solve(p + ridge * np.eye(size), q)
                    z.append(v.tolist())
                    squares.append(float(r - 2 * v @ q + v @ p @ v))
                    penalty.append(float(ridge * v @ v))
                yield pd.DataFrame({name: b[name], "z": z, "_squares": squares, "_penalty": penalty})

        return settle(sums.mapInPandas(solve, f"{name} {kind[name]}, z array<double>, _squares double, _penalty double"))

    targets, before = None, math.inf
    for _ in range(passes):
        targets = half(target, accounts, account, target, True)
        accounts = half(account, targets, target, account, False)
        if tolerance:
            now = accounts.select((F.col("_squares") + F.col("_penalty")).alias("v")).unionAll(targets.select(F.col("_penalty").alias("v"))).agg(F.sum("v")).first()[0]
            if now is None or before - now <= tolerance * now:
                break
            before = now
    else:
        if tolerance:
            raise RuntimeError(f"the factors do not settle within {passes} passes")
    return accounts.select(account, "z"), targets.select(target, "z")


def imputed(cells: DataFrame, account: str, target: str, value: str, count: str, dims: int | None = None, passes: int = 8, tolerance: float = 0.0) -> DataFrame:
    """Every pair of an account and a target that both occur, with its value or, where there is none, the low-rank guess:
    account, target, value, known. The rank is, if not given, the whole cube root of the number of targets.

    The pairs are those of the accounts with the targets' list; the list is joined by target blocks, not broadcast.
    """
    if dims is None:
        dims = max(1, int(cells.where(F.col(value).isNotNull() & (F.col(count) > 0)).select(F.countDistinct(target)).first()[0] ** (1 / 3)))
    accounts, targets = factor_model(cells, account, target, value, count, dims, passes, tolerance=tolerance)
    blocks = 16
    left = accounts.select(account, F.col("z").alias("_z"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_b"))
    right = targets.select(target, F.col("z").alias("_l"), F.pmod(F.xxhash64(target), F.lit(blocks)).cast("int").alias("_b"))
    guess = dot(F.col("_z"), F.slice("_l", 1, dims)) + F.element_at("_l", dims + 1)
    pairs = left.join(right, "_b").select(account, target, guess.alias("_g"))
    own = cells.select(account, target, F.col(value).cast("double").alias("_y"))
    return pairs.join(own, [account, target], "left").select(account, target, F.coalesce("_y", "_g").alias("value"), F.col("_y").isNotNull().alias("known"))


def probit_fit(cells: DataFrame, level: str, against: str, neutral: str, favor: str, thresholds: Sequence[float], noise: float = 1.0) -> DataFrame:
    """(threshold, loglik): fit of an ordered probit with cuts at -threshold and threshold, all of a short grid in one pass.

    A cell's counts of against, neutral and favor have the chances that a normal around ``level`` falls below, between
    and above the cuts.
    """
    x = F.col(level)
    scores = []
    for c in map(float, thresholds):
        low, high = normal_cdf((-c - x) / noise), normal_cdf((c - x) / noise)
        chances = ((against, low), (neutral, high - low), (favor, 1 - high))
        scores.append(F.struct(F.lit(c).alias("threshold"), F.sum(sum((F.col(k).cast("double") * F.log(F.greatest(p, F.lit(1e-12))) for k, p in chances), F.lit(0.0))).alias("loglik")))
    fits = cells.where(x.isNotNull()).agg(F.array(*scores).alias("_f"))
    return fits.select(F.explode("_f").alias("_f")).select("_f.threshold", F.coalesce("_f.loglik", F.lit(0.0)).alias("loglik"))


def blake_unit(key: Column, seed: int | str) -> Column:
    """A number in [0, 1) from BLAKE2b of ``seed:key``, in Arrow batches (the SHA-256 form stays in the JVM)."""
    import hashlib

    @F.pandas_udf("double")
    def unit(v: pd.Series) -> pd.Series:
        return v.map(lambda k: None if k is None else int.from_bytes(hashlib.blake2b(f"{seed}:{k}".encode(), digest_size=8).digest(), "big") / 2**64)

    return unit(key.cast("string"))


def token_cut(c: Column, budget: int) -> Column:
    """Text cut after ``budget`` tokens between blanks; shorter text as it is."""
    return F.when(F.regexp_count(c, F.lit(r"\S+")) > budget, F.regexp_extract(c, rf"(?s)^(\s*(?:\S+\s+){{{budget - 1}}}\S+)", 1)).otherwise(c)


def clean_reply(reply: Column, asked: Column) -> Column:
    """A model's answer to a short request without preamble, quotes and leading article; null if it grew too much or
    talks about itself."""
    c = F.regexp_replace(reply, r"(?is)^\s*(?:sure|here is|here's|translation|answer)[^:\n]*:\s*", "")
    c = F.btrim(F.regexp_extract(c, r"^([^\n]*)", 1), F.lit(" \"'“”‘’.`*"))
    c = F.regexp_replace(c, r"(?i)^(?:the|a|an)\s+", "")
    bad = c.rlike(r"(?i)\b(?:i cannot|i can't|as an ai|language model|sorry)\b") | (F.length(c) > 3 * F.length(asked) + 40) | (c == "")
    return F.when(~bad, c)
