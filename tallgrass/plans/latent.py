"""Latent trajectories, observation models and panel tests on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallgrass.operators import latent, stationarity
from tallgrass.operators.joins import lag_pairs
from tallgrass.plans.register import catalogue
from tallgrass.plans.scores import CELLS, _cells, erfc_sql
from tallgrass.plans.tables import DAILY, daily, read

QUERIES, SQL, query = catalogue()
R = F.round
PRIOR = (["wiener", "ou"], [60.0, 60.0], [0.002, 0.2])


def _observations(spark, d):
    c = _cells(spark, d).groupBy(F.col("a").alias("account"), F.floor(F.col("t") / 15).alias("t"), F.col("j").alias("target")).agg((F.sum("s") / F.sum("n")).alias("y"), (F.sum("n") / 0.5).alias("p"))
    return c.select("account", "t", "target", "y", F.least("p", F.lit(200.0)).alias("p"))


def _fit(spark, d):
    states, loadings = latent.fitted(_observations(spark, d), 2, *PRIOR, passes=200, tolerance=0.02)
    return latent.whitened(states, loadings, 2)


@query()
def latent_trajectories(spark, d):
    return _fit(spark, d)[0].select("account", "t", "z", "causal")


@query()
def latent_forecasts(spark, d):
    states, loadings = latent.fitted(_observations(spark, d), 2, *PRIOR, passes=200, tolerance=0.02)
    return latent.predicted(_observations(spark, d), states, loadings, 2, 0.4, 0.7).select("account", "t", "target", *[R(c, 6).alias(c) for c in ("p_neg", "p_neu", "p_pos")])


@query(f"with {CELLS}, m as (select a, sum(s) / sum(n) as m, 1 / sqrt(sum(n)) + 0.5 as sd from cl group by 1) select a, round(0.5 * {erfc_sql('(-((-0.4 - m) / sd) / 1.4142135623730951)')}, 6) as p_neg, round(0.5 * {erfc_sql('(-((0.4 - m) / sd) / 1.4142135623730951)')} - 0.5 * {erfc_sql('(-((-0.4 - m) / sd) / 1.4142135623730951)')}, 6) as p_neu, round(1 - 0.5 * {erfc_sql('(-((0.4 - m) / sd) / 1.4142135623730951)')}, 6) as p_pos from m")
def probit_chances(spark, d):
    m = _cells(spark, d).groupBy("a").agg((F.sum("s") / F.sum("n")).alias("m"), (1 / F.sqrt(F.sum("n")) + 0.5).alias("sd"))
    return latent.with_chances(m, "m", "sd", 0.4).select("a", *[R(c, 6).alias(c) for c in ("p_neg", "p_neu", "p_pos")])


_LAT = [(i, j, 6 - i - j) for i in range(7) for j in range(7 - i)]
_TOP = [0 if i >= j and i >= k else 1 if j >= k else 2 for i, j, k in _LAT]
_CHANNEL = ((0.8, 0.15, 0.05), (0.1, 0.8, 0.1), (0.05, 0.15, 0.8))
_SUM = {
    "hard": [" + ".join(f"coalesce(q{n}, 0)" for n, t in enumerate(_TOP) if t == k) for k in range(3)],
    "soft": [" + ".join(f"coalesce(q{n}, 0) * {p[k] / 6!r}" for n, p in enumerate(_LAT)) for k in range(3)],
    "channel": [" + ".join(f"coalesce(q{n}, 0) * {_CHANNEL[t][k]}" for n, t in enumerate(_TOP)) for k in range(3)],
}


@query(" union all ".join(f"select '{how}' as how, target, round(sum({a}), 4) as n_against, round(sum({b}), 4) as n_neutral, round(sum({c}), 4) as n_favor from cells where target is not null group by 2" for how, (a, b, c) in _SUM.items()))
def observation_models(spark, d):
    cells, out = read(spark, d, "cells").where("target is not null"), None
    for how in _SUM:
        t = latent.observed_counts(cells, 6, how, _CHANNEL).groupBy("target").agg(*[R(F.sum(c), 4).alias(c) for c in ("n_against", "n_neutral", "n_favor")]).withColumn("how", F.lit(how))
        out = t if out is None else out.unionByName(t)
    return out


def _mixture_sql() -> str:
    whole = [f"(pa * {p[0] / 6!r} + pn * {p[1] / 6!r} + pf * {p[2] / 6!r})" for p in _LAT]
    part = lambda k, c: " + ".join(f"coalesce(q{n}, 0) * {c} * {p[k] / 6!r} / {w}" for n, (p, w) in enumerate(zip(_LAT, whole)) if p[k])
    fit = " + ".join(f"coalesce(q{n}, 0) * ln({w})" for n, w in enumerate(whole))
    return f"with {CELLS}, pr as (select j, (sum(s2 - s) / 2 + 1) / (sum(n) + 3) as pa, (sum(n - s2) + 1) / (sum(n) + 3) as pn, (sum(s2 + s) / 2 + 1) / (sum(n) + 3) as pf from cl group by 1) select target, round(sum({part(0, 'pa')}), 4) as n_against, round(sum({part(1, 'pn')}), 4) as n_neutral, round(sum({part(2, 'pf')}), 4) as n_favor, round(sum({fit}), 3) as loglik from cells join pr on target = j group by 1"


@query(_mixture_sql())
def mixture_observation(spark, d):
    s, s2, n = F.sum("s"), F.sum("s2"), F.sum("n")
    prior = _cells(spark, d).groupBy("j").agg((((s2 - s) / 2 + 1) / (n + 3)).alias("pa"), ((n - s2 + 1) / (n + 3)).alias("pn"), (((s2 + s) / 2 + 1) / (n + 3)).alias("pf"))
    c = read(spark, d, "cells").join(prior, F.col("target") == F.col("j"))
    t = latent.mixture_counts(c, 6, ["pa", "pn", "pf"])
    return t.groupBy("target").agg(*[R(F.sum(c), 4).alias(c) for c in ("n_against", "n_neutral", "n_favor")], R(F.sum("loglik"), 3).alias("loglik"))


@query()
def panel_verdict(spark, d):
    weeks = daily(spark, d).groupBy("user_id", F.floor(F.col("day") / 2).alias("t")).agg(F.avg("x").alias("x"))
    times = [r["t"] for r in weeks.select("t").distinct().orderBy("t").collect()]  # a row per time
    series = stationarity.balanced(weeks, "user_id", "t", "x", times)
    tests = stationarity.panel_statistics(series, "user_id", len(times))
    p = {r["test"]: r["p"] for r in tests.collect()}
    return tests.withColumn("verdict", F.lit(stationarity.verdict(p) if p else None))


@query(f"with {DAILY}, c as (select b.day - a.day as lag, avg(pow(b.x - a.x, 2)) as y, count(*)::double as w from daily a join daily b on a.user_id = b.user_id and b.day - a.day between 1 and 10 group by 1), s as (select sum(w * 4 * lag * lag) as a, sum(w * 2 * pow(lag, 3)) as b, sum(w * pow(lag, 4)) as c, sum(w * 2 * lag * y) as p, sum(w * lag * lag * y) as q, sum(w * y * y) as yy from c), f as (select 0 as k, (p * c - q * b) / (a * c - b * b) as d, (q * a - p * b) / (a * c - b * b) as v from s union all select 1, p / a, 0 from s union all select 2, 0, q / c from s union all select 3, 0, 0), l as (select d, v, yy - 2 * (d * p + v * q) + d * d * a + 2 * d * v * b + v * v * c as loss, k from f, s where d >= 0 and v >= 0) select round(d, 4) as diffusion, round(sqrt(v), 4) as drift from l order by loss, k limit 1")
def msd_components(spark, d):
    pairs = lag_pairs(daily(spark, d), ["user_id"], "day", 10, ["x"]).groupBy("lag").agg(F.avg(F.pow(F.col("x_b") - F.col("x_a"), 2)).alias("y"), F.count("*").alias("w"))
    diffusion, drift = stationarity.drift_and_diffusion([(r["lag"], r["y"], r["w"]) for r in pairs.orderBy("lag").collect()])  # a row per lag
    return spark.createDataFrame([(diffusion, drift)], "diffusion double, drift double").select(R("diffusion", 4).alias("diffusion"), R("drift", 4).alias("drift"))
