"""Scores, resampling, tests of change, splits by position and profiles of cells on the test tables."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallgrass.functions.time import micros
from tallgrass.operators import agreement, aggregates, numeric, resampling, scores, trajectories
from tallgrass.operators.joins import lag_pairs
from tallgrass.operators.sampling import hash_order
from tallgrass.plans.analysis import LABELLED, _answers, _labelled, ANSWERS
from tallgrass.plans.register import catalogue
from tallgrass.plans.tables import DAILY, daily, read

QUERIES, SQL, query = catalogue()
R = F.round


def poisson_sql(u: str, most: int = 8) -> str:
    total, out = 0.0, ""
    for k in range(most):
        total += math.exp(-1) / math.factorial(k)
        out += f" when {u} < {total!r} then {k}"
    return f"case{out} else {most} end"


def unit_sql(*parts: str) -> str:
    return "cast('0x' || substr(md5(" + " || ':' || ".join(f"cast({p} as varchar)" for p in parts) + "), 1, 8) as bigint) / 4294967296.0"


def weight_sql(cluster: str, seed: int = 1) -> str:
    return f"case when rep = 0 then 1 else {poisson_sql(unit_sql(str(seed), cluster, 'rep'))} end"


def erfc_sql(x: str) -> str:
    t = f"(1 / (1 + 0.5 * abs({x})))"
    inner = repr(numeric.ERFC[-1])
    for c in numeric.ERFC[-2::-1]:
        inner = f"({c!r} + {t} * {inner})"
    return f"(case when {x} >= 0 then {t} * exp(-({x}) * ({x}) + {inner}) else 2 - {t} * exp(-({x}) * ({x}) + {inner}) end)"


# cells whose account and target have a name, on their grid of two days from the first bin
CELLS = "cl as (select SeedName as a, target as j, (epoch_us(bin) - (select min(epoch_us(bin)) from cells)) // 172800000000 as t, sum(s_sum) as s, sum(s2_sum) as s2, sum(n)::double as n from cells where trim(coalesce(SeedName, '')) <> '' and target is not null and n > 0 group by 1, 2, 3)"


def _cells(spark, d):
    c = read(spark, d, "cells").withColumn("us", micros("bin"))
    first = c.agg(F.min("us")).first()[0]
    c = c.where("trim(SeedName) <> '' and target is not null and n > 0")
    t = F.floor((F.col("us") - F.lit(first)) / 172_800_000_000)
    return c.groupBy(F.col("SeedName").alias("a"), F.col("target").alias("j"), t.alias("t")).agg(F.sum("s_sum").alias("s"), F.sum("s2_sum").alias("s2"), F.sum("n").cast("double").alias("n"))


# resampling


@query(f"with per as (select user_id, sum(value) as s, count(value) as n from events group by 1), r as (select *, unnest(range(201)) as rep from per), w as (select *, {weight_sql('user_id')} as w from r), m as (select rep, sum(w * s) / sum(w * n) as m from w group by 1) select round(max(m) filter (where rep = 0), 6) as mean, round(quantile_cont(m, 0.025) filter (where rep > 0), 6) as low, round(quantile_cont(m, 0.975) filter (where rep > 0), 6) as high from m")
def bootstrap_interval(spark, d):
    t = resampling.mean_interval(read(spark, d, "events"), "user_id", "value")
    return t.select(R("value", 6).alias("mean"), R("low", 6).alias("low"), R("high", 6).alias("high"))


@query(f"with {LABELLED}, q as (select user_id, traj_split, pow(x1 - (x0 + 0.3 * (50 - x0)), 2) - pow(x1 - x0, 2) as v from lab), per as (select traj_split, user_id, sum(v) as s, count(v) as n from q group by 1, 2), r as (select *, unnest(range(201)) as rep from per), wt as (select *, {weight_sql('user_id')} as w from r), m as (select traj_split, rep, sum(w * s) / nullif(sum(w * n), 0) as m from wt group by 1, 2) select traj_split, round(max(m) filter (where rep = 0), 5) as difference, round(quantile_cont(m, 0.025) filter (where rep > 0), 5) as low, round(quantile_cont(m, 0.975) filter (where rep > 0), 5) as high from m group by 1")
def bootstrap_difference(spark, d):
    x0, x1 = F.col("x0"), F.col("x1")
    p = _labelled(spark, d).withColumn("v", F.pow(x1 - (x0 + 0.3 * (50 - x0)), 2) - F.pow(x1 - x0, 2))
    t = resampling.mean_interval(p, "user_id", "v", ["traj_split"])
    return t.select("traj_split", R("value", 5).alias("difference"), R("low", 5).alias("low"), R("high", 5).alias("high"))


_SIDES = "[{'side': 0, 'bin': cast(floor(pa * 10) as bigint), 'p': pa}, {'side': 1, 'bin': cast(floor(pb * 10) as bigint), 'p': pb}]"


@query(f"with e as (select user_id, least(value, 100) / 101.0 as pa, 0.2 + least(value, 100) / 303.0 as pb, case when event_type = 'view' then 1.0 else 0.0 end as o from events), l as (select user_id, o, unnest({_SIDES}) as s from e), u as (select s.side as side, s.bin as bin, user_id, count(*) as n, sum(s.p) as p, sum(o) as o from l group by 1, 2, 3), r as (select *, unnest(range(101)) as rep from u), w as (select *, {weight_sql('user_id')} as w from r), b as (select side, bin, rep, sum(w * n) as n, sum(w * p) as p, sum(w * o) as o from w where w > 0 group by 1, 2, 3), z as (select side, rep, sum(n) as nn, sum(o) / sum(n) as base from b group by 1, 2), q as (select side, rep, sum(n / nn * pow((p - o) / n, 2)) as reliability, sum(n / nn * pow(o / n - base, 2)) as resolution from b join z using (side, rep) group by 1, 2), f as (select rep, unnest([{{'part': 'reliability', 'd': sum(case when side = 0 then reliability else -reliability end)}}, {{'part': 'resolution', 'd': sum(case when side = 0 then resolution else -resolution end)}}]) as f from q group by 1) select f.part as part, round(max(f.d) filter (where rep = 0), 8) as value, round(quantile_cont(f.d, 0.025) filter (where rep > 0), 8) as low, round(quantile_cont(f.d, 0.975) filter (where rep > 0), 8) as high from f group by 1")
def resolution_difference(spark, d):
    v = F.least("value", F.lit(100.0))
    e = read(spark, d, "events").select("user_id", (v / 101.0).alias("pa"), (0.2 + v / 303.0).alias("pb"), (F.col("event_type") == "view").cast("double").alias("o"))
    e = e.withColumns({"ba": F.floor(F.col("pa") * 10), "bb": F.floor(F.col("pb") * 10)})
    t = resampling.resolution_interval(e, "user_id", ["ba", "bb"], ["pa", "pb"], "o")
    return t.select("part", *[R(c, 8).alias(c) for c in ("value", "low", "high")])


@query(f"with {DAILY}, s as (select user_id, day // 14 as period, x, n, exp(-1.0 / n) as w from daily), per as (select period, user_id, sum(w) as w0, sum(w * x) as wx, sum(w * n) as wn, sum(w * x * x) as wxx, sum(w * n * n) as wnn, sum(w * x * n) as wxn from s group by 1, 2), r as (select *, unnest(range(101)) as rep from per), g as (select *, {weight_sql('user_id')} as g from r), m as (select period, rep, sum(g * w0) as w0, sum(g * wx) as wx, sum(g * wn) as wn, sum(g * wxx) as wxx, sum(g * wnn) as wnn, sum(g * wxn) as wxn from g where g > 0 group by 1, 2), t as (select period, rep, wx / w0 as mean, (wxn / w0 - wx / w0 * wn / w0) / sqrt((wxx / w0 - pow(wx / w0, 2)) * (wnn / w0 - pow(wn / w0, 2))) as r from m) select period, round(max(mean) filter (where rep = 0), 5) as mean, round(quantile_cont(mean, 0.025) filter (where rep > 0), 5) as mean_low, round(quantile_cont(mean, 0.975) filter (where rep > 0), 5) as mean_high, round(max(r) filter (where rep = 0), 5) as r, round(quantile_cont(r, 0.025) filter (where rep > 0), 5) as r_low, round(quantile_cont(r, 0.975) filter (where rep > 0), 5) as r_high from t group by 1")
def opinion_timeline(spark, d):
    s = daily(spark, d).withColumn("period", F.floor(F.col("day") / 14)).withColumn("w", F.exp(-1.0 / F.col("n")))
    t = trajectories.timeline(s, ["period"], "user_id", "x", "n", "w", 100)
    return t.select("period", *[R(c, 5).alias(c) for c in ("mean", "mean_low", "mean_high", "r", "r_low", "r_high")])


@query("with t as (select filter_value, unnest(x0) as v, generate_subscripts(x0, 1) as i from (select filter_value, createtime, x0 from target_df where trim(coalesce(filter_value, '')) <> '' and x0 is not null and not list_contains(list_transform(x0, lambda v: v is null or isnan(v)), true) group by 1, 2, 3)), v as (select filter_value, i, var_pop(v) as v from t group by 1, 2), f as (select *, v / sum(v) over (partition by filter_value) as f from v), e as (select filter_value, split_part(filter_value, '-', 2) as platform, sum(case when f > 0 then -f * ln(f) else 0 end) as h from f group by 1, 2), per as (select platform, filter_value, sum(h) as s, count(h) as n from e group by 1, 2), r as (select *, unnest(range(201)) as rep from per), w as (select *, " + weight_sql("filter_value") + " as w from r), m as (select platform, rep, sum(w * s) / nullif(sum(w * n), 0) as m from w where w > 0 group by 1, 2) select platform, round(max(m) filter (where rep = 0), 6) as entropy, round(quantile_cont(m, 0.025) filter (where rep > 0), 6) as low, round(quantile_cont(m, 0.975) filter (where rep > 0), 6) as high from m group by 1")
def group_entropy(spark, d):
    from tallgrass.operators.statistics import variance_fractions

    ok = F.col("x0").isNotNull() & ~F.exists("x0", lambda v: v.isNull() | F.isnan(v))
    t = read(spark, d, "target_df").where("trim(filter_value) <> ''").where(ok).select("filter_value", "createtime", "x0").distinct().select("filter_value", F.posexplode("x0").alias("i", "v"))
    e = variance_fractions(t, "filter_value", "i", "v").withColumn("platform", F.split_part("filter_value", F.lit("-"), F.lit(2)))
    out = resampling.mean_interval(e, "filter_value", "entropy", ["platform"])
    return out.select("platform", R("value", 6).alias("entropy"), R("low", 6).alias("low"), R("high", 6).alias("high"))


# labels and probabilities

_PRIOR = "pr as (select j, (sum(s2 - s) / 2 + 1) / (sum(n) + 3) as p_neg, (sum(n - s2) + 1) / (sum(n) + 3) as p_neu, (sum(s2 + s) / 2 + 1) / (sum(n) + 3) as p_pos from cl group by 1)"


@query(f"with {CELLS}, {_PRIOR}, q as (select p_neu, p_pos, (s2 - s) / 2 as k_neg, n - s2 as k_neu, (s2 + s) / 2 as k_pos from cl join pr using (j)), u as (select 'neutrality' as problem, p_neu as p, k_neu as k, k_neg + k_neu + k_pos as n from q union all select 'polarity', (p_pos + 1e-12) / greatest(1 - p_neu, 1e-12), k_pos, k_neg + k_pos from q) select problem, round(sum(k * pow(1 - p, 2) + (n - k) * p * p) / sum(n), 7) as brier, round(sum(n), 3) as n from u group by 1")
def binary_problems(spark, d):
    c = aggregates.label_counts(_cells(spark, d).withColumnsRenamed({"s": "s_sum", "s2": "s2_sum"}))
    n = F.sum("n") + 3
    prior = c.groupBy("j").agg(((F.sum("n_against") + 1) / n).alias("p_neg"), ((F.sum("n_neutral") + 1) / n).alias("p_neu"), ((F.sum("n_favor") + 1) / n).alias("p_pos"))
    t = scores.sub_problems(c.drop("n").join(prior, "j"))
    return t.groupBy("problem").agg(R(scores.brier_counts(F.col("p"), F.col("k"), F.col("n")), 7).alias("brier"), R(F.sum("n"), 3).alias("n"))


@query(f"with {ANSWERS}, m as (select lower(trim(platform)) as platform, post_id, target, max(model_stance) as model from coded_pairs where model_stance is not null group by 1, 2, 3), j as (select a.coder, a.label, m.model from ans a join m using (platform, post_id, target)) select coder, count(*) as pairs, round(avg(-ln(case when label = model then 0.8 else 0.1 end)), 6) as log_score from j group by 1")
def coded_probabilities(spark, d):
    model = read(spark, d, "coded_pairs").where("model_stance is not null").groupBy(F.lower(F.trim("platform")).alias("platform"), "post_id", "target").agg(F.max("model_stance").alias("model"))
    probs = model.select("platform", "post_id", "target", F.array(*[F.when(F.col("model") == x, 0.8).otherwise(0.1) for x in ("AGAINST", "NEUTRAL", "FAVOR")]).alias("p"))
    outcome = F.when(F.col("label") == "AGAINST", 0).when(F.col("label") == "NEUTRAL", 1).otherwise(2)
    j = _answers(spark, d).join(probs, ["platform", "post_id", "target"])
    return j.groupBy("coder").agg(F.count("*").alias("pairs"), R(F.avg(agreement.log_score(F.col("p"), outcome)), 6).alias("log_score"))


@query("with r as (select lower(trim(platform)) as platform, lower(trim(coder)) as coder, upper(trim(coded_stance)) as g, model_stance as p from coded_pairs where upper(trim(coded_stance)) in ('FAVOR', 'AGAINST', 'NEUTRAL') and trim(coalesce(platform, '')) <> '' and trim(coalesce(coder, '')) <> ''), l as (select unnest(['FAVOR', 'AGAINST']) as label), t as (select platform, coder, label, count(*) filter (where g = label and p = label)::double as hit, count(*) filter (where p = label) as called, count(*) filter (where g = label) as support from r, l group by 1, 2, 3), s as (select platform, coder, label, case when called > 0 then hit / called else 0 end as precision, case when support > 0 then hit / support else 0 end as recall from t), f as (select *, case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0 end as f1 from s), b as (select *, row_number() over (partition by platform, label order by f1 desc, coder) as r from f) select platform, round(avg(precision), 6) as precision, round(avg(recall), 6) as recall, round(avg(f1), 6) as f1 from b where r = 1 group by 1")
def best_profile(spark, d):
    rows = read(spark, d, "coded_pairs").select(F.lower(F.trim("platform")).alias("platform"), F.lower(F.trim("coder")).alias("coder"), F.upper(F.trim("coded_stance")).alias("g"), F.col("model_stance").alias("p"))
    rows = rows.where("platform <> '' and coder <> '' and g in ('FAVOR', 'AGAINST', 'NEUTRAL')")
    table = agreement.profile_scores(rows, ["platform", "coder"], "g", "p", ["FAVOR", "AGAINST"])
    t = scores.best_profiles(table, "platform", "coder", ["FAVOR", "AGAINST"])
    return t.select("platform", *[R(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("with r as (select upper(trim(coded_stance)) as g, model_stance as p, coalesce(pair_weight, 1) as w from coded_pairs where upper(trim(coded_stance)) in ('FAVOR', 'AGAINST', 'NEUTRAL') and model_stance is not null) select round(sum(case when g = p then w else 0 end) / sum(w), 6) as accuracy, round(pow(sum(w), 2) / sum(w * w), 4) as effective_n, count(*) as n from r")
def weighted_agreement(spark, d):
    from tallgrass.operators.sampling import effective_size

    r = read(spark, d, "coded_pairs").select(F.upper(F.trim("coded_stance")).alias("g"), F.col("model_stance").alias("p"), F.coalesce("pair_weight", F.lit(1.0)).alias("w")).where("g in ('FAVOR', 'AGAINST', 'NEUTRAL') and p is not null")
    hit = aggregates.weighted_mean((F.col("g") == F.col("p")).cast("double"), F.col("w"))
    return r.agg(R(hit, 6).alias("accuracy"), R(effective_size(F.col("w")), 4).alias("effective_n"), F.count("*").alias("n"))


@query("with r as (select lower(trim(platform)) as platform, cast(year as varchar) as year, main_type, party, upper(trim(coded_stance)) = model_stance as hit from coded_pairs where upper(trim(coded_stance)) in ('FAVOR', 'AGAINST', 'NEUTRAL') and model_stance is not null), u as (select unnest([{'l': null::varchar, 'v': null::varchar}, {'l': 'platform', 'v': platform}, {'l': 'year', 'v': year}, {'l': 'main_type', 'v': main_type}, {'l': 'party', 'v': party}]) as b, hit from r) select b.l as label, b.v as value, count(*) as n, round(avg(case when hit then 1.0 else 0.0 end), 6) as accuracy from u group by 1, 2")
def breakdown_scores(spark, d):
    r = read(spark, d, "coded_pairs").select(F.lower(F.trim("platform")).alias("platform"), F.col("year").cast("string").alias("year"), "main_type", "party", F.upper(F.trim("coded_stance")).alias("g"), F.col("model_stance").alias("p")).where("g in ('FAVOR', 'AGAINST', 'NEUTRAL') and p is not null")
    return aggregates.breakdown(r, ["platform", "year", "main_type", "party"], [F.count("*").alias("n"), R(F.avg((F.col("g") == F.col("p")).cast("double")), 6).alias("accuracy")])


# tests of change

_HALVES = CELLS + ", mid as (select (max(t) + 1) // 2 as m from cl), hl as (select j, t < m as early, sum(s2 - s) / 2 as ag, sum(n - s2) as ne, sum(s2 + s) / 2 as fa from cl, mid where a < 'D' group by 1, 2)"
_FISHER = "x as (select *, a + b as r, a + c as k, a + b + c + d as m from t2), e as (select *, unnest(generate_series(cast(greatest(0, r + k - m) as bigint), cast(least(r, k) as bigint))) as i from x), l as (select *, lgamma(r + 1) + lgamma(k + 1) + lgamma(m - r + 1) + lgamma(m - k + 1) - lgamma(m + 1) - lgamma(i + 1) - lgamma(r - i + 1) - lgamma(k - i + 1) - lgamma(m - r - k + i + 1) as lp from e), o as (select *, max(lp) filter (where i = a) over (partition by j) as own from l), fx as (select j, least(1.0, sum(case when lp <= own + 1e-7 then exp(lp) else 0 end)) as p from o group by 1)"


def _halves(spark, d):
    c = _cells(spark, d)
    m = (c.agg(F.max("t")).first()[0] + 1) // 2
    c = c.where("a < 'D'").withColumn("early", F.col("t") < m)
    s, s2, n = F.col("s"), F.col("s2"), F.col("n")
    labels = F.explode(F.array(*[F.struct(F.lit(name).alias("label"), k.alias("k")) for name, k in (("against", (s2 - s) / 2), ("neutral", n - s2), ("favor", (s2 + s) / 2))]))
    long = c.withColumn("_l", labels)
    return long.groupBy("j", F.col("_l.label").alias("label")).agg(F.sum(F.when(F.col("early"), F.col("_l.k")).otherwise(0)).cast("bigint").alias("early"), F.sum(F.when(~F.col("early"), F.col("_l.k")).otherwise(0)).cast("bigint").alias("late"))


@query(f"with {_HALVES}, t2 as (select j, sum(case when early then fa else 0 end) as a, sum(case when early then ag else 0 end) as b, sum(case when early then 0 else fa end) as c, sum(case when early then 0 else ag end) as d from hl group by 1), {_FISHER} select t2.j as j, round(p, 7) as p from t2 join fx using (j) where a + b + c + d > 0")
def fisher_exact(spark, d):
    t = _halves(spark, d).groupBy("j").agg(*[F.sum(F.when(F.col("label") == label, F.col(half)).otherwise(0)).alias(name) for name, half, label in (("a", "early", "favor"), ("b", "early", "against"), ("c", "late", "favor"), ("d", "late", "against"))])
    return scores.fisher_exact(t, "a", "b", "c", "d").select("j", R("p", 7).alias("p"))


@query(f"with {_HALVES}, lg as (select j, unnest([{{'l': 'against', 'k': ag}}, {{'l': 'neutral', 'k': ne}}, {{'l': 'favor', 'k': fa}}]) as z, early from hl), w as (select j, z.l as l, sum(case when early then z.k else 0 end) as e, sum(case when early then 0 else z.k end) as q from lg group by 1, 2), u as (select * from w where e + q > 0), g as (select j, sum(e) as ee, sum(q) as qq, count(*) as k from u group by 1), c3 as (select j, sum(pow(e - (e + q) * ee / (ee + qq), 2) / ((e + q) * ee / (ee + qq)) + pow(q - (e + q) * qq / (ee + qq), 2) / ((e + q) * qq / (ee + qq))) as x from u join g using (j) where k = 3 and ee > 0 and qq > 0 group by 1), t2 as (select j, arg_min(e, l) as a, arg_max(e, l) as b, arg_min(q, l) as c, arg_max(q, l) as d from u join g using (j) where k = 2 group by 1), {_FISHER} select g.j as j, round(case when ee >= 10 and qq >= 10 and k > 1 then coalesce(fx.p, exp(-c3.x / 2)) else 1 end, 7) as p from g left join c3 using (j) left join fx on fx.j = g.j")
def shift_significance(spark, d):
    return scores.shift_significance(_halves(spark, d), "j", "label", "early", "late").select("j", R("p", 7).alias("p"))


@query(f"with {_HALVES}, t2 as (select j, sum(case when early then fa else 0 end) as a, sum(case when early then ag else 0 end) as b, sum(case when early then 0 else fa end) as c, sum(case when early then 0 else ag end) as d from hl group by 1), {_FISHER} select t2.j as j, round(c / (c + d) - a / (a + b), 6) as moved from t2 join fx using (j) where p <= 0.2 and a + b > 0 and c + d > 0 order by abs(round(c / (c + d) - a / (a + b), 6)) desc, t2.j limit 5")
def significant_movers(spark, d):
    t = _halves(spark, d).groupBy("j").agg(*[F.sum(F.when(F.col("label") == label, F.col(half)).otherwise(0)).alias(name) for name, half, label in (("a", "early", "favor"), ("b", "early", "against"), ("c", "late", "favor"), ("d", "late", "against"))])
    p = scores.fisher_exact(t, "a", "b", "c", "d").where("p <= 0.2 and a + b > 0 and c + d > 0")
    return p.select("j", R(F.col("c") / (F.col("c") + F.col("d")) - F.col("a") / (F.col("a") + F.col("b")), 6).alias("moved")).orderBy(F.desc(F.abs("moved")), "j").limit(5)


@query(f"select event_id, round({erfc_sql('(-(value - 50) / 20 / 1.4142135623730951)')} * 0.5, 6) as cdf, round(exp(-pow((value - 50) / 20, 2) / 2) / sqrt(2 * pi()), 6) as pdf from events")
def normal_functions(spark, d):
    z = (F.col("value") - 50) / 20
    return read(spark, d, "events").select("event_id", R(numeric.normal_cdf(z), 6).alias("cdf"), R(numeric.normal_pdf(z), 6).alias("pdf"))


# forecasts

_MOM = "avg(d * d) as d2, avg(p * p) as p2, avg(m * m) as m2, avg(d * p) as c, avg(d * m) as c_dm, avg(p * m) as c_pm"
_RHO = "c / sqrt(d2 * p2) as rho, c_dm / sqrt(d2 * m2) as rho_dm, c_pm / sqrt(p2 * m2) as rho_pm"
_BOTH = "least(1, greatest(0, case when 1 - rho_pm * rho_pm > 1e-6 then (rho * rho + rho_dm * rho_dm - 2 * rho * rho_dm * rho_pm) / (1 - rho_pm * rho_pm) else greatest(rho * rho, rho_dm * rho_dm) end))"


@query(f"with {LABELLED}, q as (select traj_split, x1 - x0 as d, 0.3 * (50 - x0) as p, xm1 - x0 as m from lab where xm1 is not null), g as (select traj_split, {_MOM} from q group by 1), r as (select traj_split, {_RHO} from g) select traj_split, round(rho, 6) as rho, round(rho_dm, 6) as momentum_rho, round(rho_pm, 6) as model_vs_momentum_rho, round({_BOTH}, 6) as combined_ceiling, round({_BOTH} - rho_dm * rho_dm, 6) as ceiling_gain from r")
def momentum_gain(spark, d):
    x0 = F.col("x0")
    m = _labelled(spark, d).where("has_prev").groupBy("traj_split").agg(*[v.alias(k) for k, v in scores.moments(x0, F.col("x1"), F.col("xm1"), x0 + 0.3 * (50 - x0)).items()])
    g = scores.gain(*[F.col(c) for c in ("d2", "p2", "m2", "c", "c_dm", "c_pm")])
    return m.select("traj_split", *[R(v, 6).alias(k) for k, v in g.items()])


_TRI = "tri as (select filter_value, createtime, any_value(x0) as x0 from target_df where trim(coalesce(filter_value, '')) <> '' and len(x0) = 4 and not list_contains(list_transform(x0, lambda v: v is null or isnan(v)), true) group by 1, 2 having count(distinct x0) = 1), w as (select filter_value, createtime, x0, lead(x0) over u as x1, lag(x0) over u as xm1 from tri window u as (partition by filter_value order by createtime))"


def _triples(spark, d):
    ok = (F.size("x0") == 4) & ~F.exists("x0", lambda v: v.isNull() | F.isnan(v))
    t = read(spark, d, "target_df").where("trim(filter_value) <> ''").where(ok).groupBy("filter_value", "createtime").agg(F.min("x0").alias("x0"), F.max("x0").alias("_o")).where("x0 = _o").drop("_o")
    w = Window.partitionBy("filter_value").orderBy("createtime")
    return t.withColumns({"x1": F.lead("x0").over(w), "xm1": F.lag("x0").over(w)})


@query(f"with {_TRI}, l as (select unnest(x0) as x0, unnest(x1) as x1, unnest(xm1) as xm1, generate_subscripts(x0, 1) as i from w where x1 is not null and xm1 is not null), q as (select i, case when i = 4 then 0 else x1 - x0 end as d, -0.2 * x0 as p, xm1 - x0 as m from l), g as (select i, {_MOM} from q group by 1), r as (select *, {_RHO.replace('c / sqrt(d2 * p2)', 'case when d2 > 0 then c / sqrt(d2 * p2) else 0 end').replace('c_dm / sqrt(d2 * m2)', 'case when d2 > 0 then c_dm / sqrt(d2 * m2) else 0 end')}, d2 > 1e-6 * max(d2) over () as moving from g), f as (select *, {_BOTH} as joint from r) select round(avg(rho) filter (where moving), 6) as rho, round(avg(rho_dm * rho_dm) filter (where moving), 6) as momentum_ceiling, round(avg(joint - rho_dm * rho_dm) filter (where moving), 6) as ceiling_gain, count(*) filter (where moving) as moving, round(sum(case when moving then 0 else p2 end) / sum(d2) filter (where moving), 6) as spurious from f")
def dimension_gains(spark, d):
    t = _triples(spark, d).where("x1 is not null and xm1 is not null")
    long = t.select(F.posexplode(F.arrays_zip("x0", "x1", "xm1")).alias("i", "_z")).select("i", "_z.*")
    x0 = F.col("x0")
    x1 = F.when(F.col("i") == 3, x0).otherwise(F.col("x1"))  # a dimension that never moves
    per = long.groupBy("i").agg(*[v.alias(k) for k, v in scores.moments(x0, x1, F.col("xm1"), 0.8 * x0).items()])
    return scores.dimension_gains(per).select(*[R(c, 6).alias(c) for c in ("rho", "momentum_ceiling", "ceiling_gain")], "moving", R("spurious", 6).alias("spurious"))


@query(f"with {_TRI}, f as (select x0, x1, xm1 from w where x1 is not null), l as (select unnest(x0) as v, generate_subscripts(x0, 1) as i from f), s as (select avg(sd) as sd from (select stddev_pop(v) as sd from l group by i)), q as (select list_sum(list_transform(list_zip(x1, x0), lambda z: pow(z[1] - z[2], 2))) as d2, list_sum(list_transform(list_zip(x0, xm1), lambda z: pow(z[1] - z[2], 2))) as m2, list_sum(list_transform(list_zip(x0, x1, xm1), lambda z: (z[2] - z[1]) * (z[1] - z[3]))) as dm, xm1 from f) select round(max(sd), 6) as level_sd, round(sqrt(avg(d2)), 6) as step_rms, round(sum(dm) filter (where xm1 is not null) / sqrt(sum(d2) filter (where xm1 is not null) * sum(m2) filter (where xm1 is not null)), 6) as momentum_rho, count(*) as pairs, round(sqrt(avg(d2)) / (max(sd) * 2), 6) as step_over_level from q, s")
def displacement_profile(spark, d):
    t = scores.displacement(_triples(spark, d).where("x1 is not null"), "x0", "x1", "xm1", 4)
    return t.select(*[R(c, 6).alias(c) for c in ("level_sd", "step_rms", "momentum_rho")], "pairs", R("step_over_level", 6).alias("step_over_level"))


@query(f"with {LABELLED}, f as (select traj_split, t1 // 5 as fold, avg(pow(x1 - x0, 2)) as train, avg(pow(x1 - 50, 2)) as val from lab group by 1, 2) select traj_split, count(*) as runs, round(avg(train), 5) as train, round(avg(val), 5) as val, round(avg(val) - avg(train), 5) as gap, round(stddev_samp(train), 5) as train_sd, round(stddev_samp(val), 5) as val_sd from f group by 1")
def run_comparison(spark, d):
    x0, x1 = F.col("x0"), F.col("x1")
    f = _labelled(spark, d).groupBy("traj_split", F.floor(F.col("t1") / 5).alias("fold")).agg(F.avg(F.pow(x1 - x0, 2)).alias("train"), F.avg(F.pow(x1 - 50, 2)).alias("val"))
    return scores.run_gaps(f, "traj_split", "train", "val").select("traj_split", "runs", *[R(c, 5).alias(c) for c in ("train", "val", "gap", "train_sd", "val_sd")])


@query(f"with {LABELLED}, q as (select user_id, time_split, pow(x1 - (x0 + 0.3 * (50 - x0)), 2) as a, greatest(pow(x1 - x0, 2), 1e-12) as b from lab), p as (select time_split, quantile_cont(a / b, 0.25) as lo, quantile_cont(a / b, 0.75) as hi, avg(least(a / b, 10)) as mean from q group by 1), per as (select time_split, user_id, sum(least(a / b, 10)) as s, count(*) as n from q group by 1, 2), r as (select *, unnest(range(101)) as rep from per), wt as (select *, {weight_sql('user_id')} as w from r), m as (select time_split, rep, sum(w * s) / sum(w * n) as m from wt where w > 0 group by 1, 2), i as (select time_split, quantile_cont(m, 0.025) filter (where rep > 0) as mean_low, quantile_cont(m, 0.975) filter (where rep > 0) as mean_high from m group by 1) select time_split, round(lo, 5) as q1, round(hi, 5) as q3, round(mean, 5) as mean, round(mean_low, 5) as mean_low, round(mean_high, 5) as mean_high from p join i using (time_split)")
def ratio_intervals(spark, d):
    x0, x1 = F.col("x0"), F.col("x1")
    p = _labelled(spark, d).withColumn("q", F.pow(x1 - (x0 + 0.3 * (50 - x0)), 2) / F.greatest(F.pow(x1 - x0, 2), F.lit(1e-12))).withColumn("c", F.least("q", F.lit(10.0)))
    quartiles = p.groupBy("time_split").agg(F.percentile("q", F.array(F.lit(0.25), F.lit(0.75))).alias("_q"))
    t = quartiles.join(resampling.mean_interval(p, "user_id", "c", ["time_split"], 100), "time_split")
    return t.select("time_split", R(F.col("_q")[0], 5).alias("q1"), R(F.col("_q")[1], 5).alias("q3"), R("value", 5).alias("mean"), R("low", 5).alias("mean_low"), R("high", 5).alias("mean_high"))


# splits


@query("with n as (select count(*) as n, count(distinct user_id) as m from events), r as (select event_id, user_id, row_number() over (order by sha256('3:' || cast(event_id as varchar)), event_id) as i, row_number() over (order by ts, event_id) as k from events), u as (select user_id, row_number() over (order by sha256('3:' || cast(user_id as varchar)), user_id) as i from (select distinct user_id from events)) select event_id, case when r.i <= floor(n * 0.8) then 'train' else 'val' end as random_split, case when u.i <= floor(m * 0.8) then 'train' else 'val' end as account_split, case when k <= floor(n * 0.8) then 'train' else 'val' end as time_split from r join u using (user_id), n")
def position_splits(spark, d):
    return scores.position_splits(read(spark, d, "events").select("event_id", "user_id", "ts"), "event_id", "user_id", ["ts"], 0.8, 3).select("event_id", "random_split", "account_split", "time_split")


@query(f"with {LABELLED} select traj_split || '_' || time_split as scenario, count(*) as pairs, count(*) filter (where traj_split = 'train' and time_split = 'in') as training from lab group by 1")
def scenario_cells(spark, d):
    rows = _labelled(spark, d).withColumn("scenario", F.concat_ws("_", "traj_split", "time_split"))
    return rows.groupBy("scenario").agg(F.count("*").alias("pairs"), F.count_if(trajectories.training_rows()).alias("training"))


@query(f"with {CELLS}, b as (select max(t) + 1 as T from cl), h as (select unnest([91, 182, 365]) as hold), c as (select hold, T, greatest(0, cast(ceil((T - 1) - (hold + 30) / 2.0) as bigint)) as cut, cast(floor((T - 1) - 30 / 2.0) as bigint) + 1 as stop from b, h) select hold, cut, stop, (select count(*) from cl where t < cut) as cells_in from c")
def holdout_bins(spark, d):
    c = _cells(spark, d)
    bins = c.agg(F.max("t")).first()[0] + 1
    limits = [(h, *scores.bin_cutoffs(bins, 2.0, h, 30.0)) for h in (91, 182, 365)]
    inside = c.agg(*[F.count_if(F.col("t") < cut).alias(f"h{h}") for h, cut, _ in limits])
    table = F.explode(F.array(*[F.struct(F.lit(h).alias("hold"), F.lit(cut).cast("bigint").alias("cut"), F.lit(stop).cast("bigint").alias("stop"), F.col(f"h{h}").alias("cells_in")) for h, cut, stop in limits]))
    return inside.select(table.alias("_t")).select("_t.*")


@query(f"with {LABELLED}, h as (select user_id, day, row_number() over (partition by user_id order by day) as history from daily), j as (select l.user_id, l.t0, history, sha256('5:' || l.user_id || '/' || l.t0) as hash from lab l join h on l.user_id = h.user_id and l.t0 = h.day where history >= 5) select user_id, t0, history from (select *, row_number() over (order by hash, user_id, t0) as r from j) where r <= 500")
def horizon_sample(spark, d):
    return scores.sampled_pairs(_labelled(spark, d).select("user_id", "t0", "t1"), daily(spark, d), "user_id", "day", "t0", 5, 500, 5).select("user_id", "t0", F.col("history").cast("bigint").alias("history"))


# profiles of cells

_LAT = [(i, j, 6 - i - j) for i in range(7) for j in range(7 - i)]
_CONF = [(1.0, 1.01), (0.8, 1.0), (0.6, 0.8), (0.4, 0.6), (0.0, 0.4)]


@query("with s as (select " + ", ".join(f"sum(q{i}) as q{i}" for i in range(28)) + " from cells), u as (select unnest([" + ", ".join(f"{{'c': {max(p) / 6!r}, 'q': q{i}}}" for i, p in enumerate(_LAT)) + "]) as u from s) select case when u.c >= 1 then 'b0' when u.c >= 0.8 then 'b1' when u.c >= 0.6 then 'b2' when u.c >= 0.4 then 'b3' else 'b4' end as band, round(sum(u.q) / (select sum(u.q) from u), 8) as share from u group by 1")
def confidence_bands(spark, d):
    t = aggregates.lattice_bands(read(spark, d, "cells"), 6, _CONF)
    return t.select("band", R("share", 8).alias("share"))


@query(f"with {CELLS}, v as (select j, sum(n) as v from cl group by 1), h as (select unnest([100, 400, 1000]) as least) select least, count(j) as targets, round(sum(v), 3) as posts, round(sum(v) / (select sum(v) from v), 6) as share from h left join v on v >= least group by 1")
def volume_survival(spark, d):
    v = _cells(spark, d).groupBy("j").agg(F.sum("n").alias("v"))
    return aggregates.survival(v, "v", [100, 400, 1000]).select(F.col("least").cast("int").alias("least"), F.col("kept").alias("targets"), R("total", 3).alias("posts"), R("share", 6).alias("share"))


@query(f"with {CELLS}, c as (select cast(t % 50 as bigint) as b, sum(n) as n from cl group by 1), g as (select cast(unnest(range(60)) as bigint) as b) select g.b as b, round(coalesce(n, 0), 3) as n from g left join c using (b)")
def bincount_dense(spark, d):
    c = _cells(spark, d).withColumn("b", (F.col("t") % 50).cast("bigint"))
    return aggregates.bincount(c, "b", "n", 60).select("b", R("n", 3).alias("n"))


@query("with e as (select vec_id, label, embedding::double[] as v from embeddings), l as (select label, vec_id % 7 as t, 1.0 / (1 + vec_id % 3) as w, [v[1], v[2], v[3]] as v from e), g as (select i, k from range(3) a(i), range(3) b(k)) select label, cast(t as bigint) as t, cast(i as int) as i, cast(k as int) as k, round(sum(w * v[i + 1] * v[k + 1]), 6) as value from l, g group by 1, 2, 3, 4")
def scattered_blocks(spark, d):
    v = F.col("embedding").cast("array<double>")
    e = read(spark, d, "embeddings").select("label", (F.col("vec_id") % 7).alias("t"), (1.0 / (1 + F.col("vec_id") % 3)).alias("w"), F.slice(v, 1, 3).alias("v"))
    return aggregates.outer_sums(e, ["label", "t"], "v", "w", 3).withColumn("value", R("value", 6))


@query("with v as (select vec_id, label + 1 as v from embeddings), p as (select vec_id, v, (row_number() over (order by v, vec_id) - 1) / (select count(*) - 1.0 from v) as pct from v), l as (select vec_id, unnest(embedding)::double as l, generate_subscripts(embedding, 1) - 1 as d from embeddings), r as (select d, vec_id, pct, row_number() over (partition by d order by abs(l) * sqrt(v) desc, vec_id) as r from l join p using (vec_id)), k as (select * from r where r <= 5), t as (select avg(pct) as prevalence, (count(distinct vec_id) - 5) / (5.0 * count(distinct d) - 5) as distinctness from k) select round(prevalence, 6) as prevalence, round(distinctness, 6) as distinctness, round(sqrt(prevalence * distinctness), 6) as score from t")
def axis_readability(spark, d):
    e = read(spark, d, "embeddings")
    long = e.select("vec_id", F.posexplode(F.col("embedding").cast("array<double>")).alias("d", "l"))
    t = scores.readability(long, "d", "vec_id", "l", e.select("vec_id", (F.col("label") + 1).alias("v")), "v", 5, True)
    return t.select(*[R(c, 6).alias(c) for c in ("prevalence", "distinctness", "score")])


_VG = CELLS + """, ok as (select a, j, sum(s2 - s * s / n) / sum(n - 1) as v from cl where n >= 3 group by 1, 2 having count(*) >= 3 and sum(n - 1) > 0),
c as (select a, j, t, n, s / n as y, v from cl join ok using (a, j) where n >= 3),
sh as (select x.a, x.j, x.t, y.n, y.y, y.v from (select *, row_number() over (partition by a, j order by t) as k from c) x join (select *, row_number() over (partition by a, j order by sha256('9:' || a || '/' || j || '/' || t), t) as k from c) y using (a, j, k)),
both_ as (select 'real' as tag, * from c union all select 'null', * from sh),
pr as (select p.tag, q.t - p.t as lag, pow(q.y - p.y, 2) as sq, p.v * (1 / p.n + 1 / q.n) as z, 1 / (1 / p.n + 1 / q.n) as w from both_ p join both_ q on p.tag = q.tag and p.a = q.a and p.j = q.j and q.t - p.t between 1 and 79),
bk as (select tag, case when lag < 2 then 0 when lag < 4 then 1 when lag < 8 then 2 when lag < 16 then 3 when lag < 32 then 4 when lag < 48 then 5 when lag < 64 then 6 else 7 end as bucket, count(*) as pairs, sum(sq * w) / sum(w) as raw, sum(z * w) / sum(w) as noise from pr group by 1, 2)"""
EDGES = [1, 2, 4, 8, 16, 32, 48, 64, 80]


def _variogram(spark, d):
    c = _cells(spark, d).where("n >= 3")
    pair = c.groupBy("a", "j").agg((F.sum(F.col("s2") - F.col("s") * F.col("s") / F.col("n")) / F.sum(F.col("n") - 1)).alias("v"), F.count("*").alias("_b"), F.sum(F.col("n") - 1).alias("_df")).where("_b >= 3 and _df > 0")
    c = c.join(pair.drop("_b", "_df"), ["a", "j"]).select("a", "j", "t", "n", (F.col("s") / F.col("n")).alias("y"), "v")
    moved = trajectories.permuted(c, ["a", "j"], "t", ["n", "y", "v"], hash_order(F.concat_ws("/", "a", "j", "t"), 9))
    both = c.withColumn("tag", F.lit("real")).unionByName(moved.withColumn("tag", F.lit("null")))
    p = lag_pairs(both, ["tag", "a", "j"], "t", 79, ["n", "y", "v"])
    inv = 1 / F.col("n_a") + 1 / F.col("n_b")
    return scores.lag_buckets(p, ["tag"], F.col("lag"), F.pow(F.col("y_b") - F.col("y_a"), 2), F.col("v_a") * inv, 1 / inv, EDGES)


@query(f"with {_VG} select tag, bucket, pairs, round(raw, 6) as raw, round(noise, 6) as noise, round(raw - noise, 6) as excess from bk")
def variogram(spark, d):
    return _variogram(spark, d).select("tag", "bucket", "pairs", *[R(c, 6).alias(c) for c in ("raw", "noise", "excess")])


@query(f"with {_VG}, e as (select r.bucket, (r.raw - r.noise) - (n.raw - n.noise) as e from bk r join bk n using (bucket) where r.tag = 'real' and n.tag = 'null'), f as (select arg_min(e, bucket) as first, arg_max(e, bucket) as last, count(*) as k, array_agg(e order by bucket) as es from e) select round(last - first, 6) as span, round(sqrt(greatest(last - first, 0) / 2), 6) as drift_sd, case when last - first > 0 then round((last - es[k - greatest(2, cast(round_even(k * 0.34, 0) as bigint)) + 1]) / (last - first), 6) end as tail_share, last - first > 0 and coalesce((last - es[k - greatest(2, cast(round_even(k * 0.34, 0) as bigint)) + 1]) / (last - first) < 0.1, false) as saturates from f")
def drift_saturation(spark, d):
    rows = {(r["tag"], r["bucket"]): r["excess"] for r in _variogram(spark, d).collect()}  # at most two rows per bucket
    buckets = sorted(b for tag, b in rows if tag == "real" and ("null", b) in rows)
    v = scores.saturation([rows["real", b] - rows["null", b] for b in buckets])
    share = None if math.isnan(v["tail_share"]) else v["tail_share"]
    return spark.createDataFrame([(v["span"], v["drift_sd"], share, v["saturates"])], "span double, drift_sd double, tail_share double, saturates boolean").select(R("span", 6).alias("span"), R("drift_sd", 6).alias("drift_sd"), R("tail_share", 6).alias("tail_share"), "saturates")


_PART = "b as (select vec_id, [embedding[1], embedding[2], embedding[3], embedding[4]]::double[] as v from embeddings), m as (select unnest([2, 4, 6, 8, 10, 12, 14]) as side), y as (select side, vec_id, ((case when side & 2 > 0 then v[2] else 0 end) + (case when side & 4 > 0 then v[3] else 0 end) + (case when side & 8 > 0 then v[4] else 0 end)) / bit_count(side) as y from b, m), c as (select side, y, row_number() over w - 1 as i, sum(y) over w - y as s, sum(y) over (partition by side) as total, count(*) over (partition by side) as n from y window w as (partition by side order by y, vec_id rows unbounded preceding))"


@query(f"with {_PART} select side, round(max(i * (total - s) - (n - i) * s) / (4 * max(n) * max(n)), 7) as polarization from c where i > 0 group by 1")
def asymmetric_polarization(spark, d):
    e = read(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return scores.partition_polarization(e, "vec_id", "v", 4).withColumn("polarization", R("polarization", 7))


@query(f"with {CELLS}, h as (select a, j, sum(n) filter (where t < 430) as n0, sum(n) filter (where t >= 430) as n1, sum(s) filter (where t < 430) as s0, sum(s) filter (where t >= 430) as s1, sum(s2) filter (where t < 430) as q0, sum(s2) filter (where t >= 430) as q1 from cl group by 1, 2), d as (select a, j, n0 + n1 as n, s1 / n1 - s0 / n0 as d, ((q0 - s0 * s0 / n0) + (q1 - s1 * s1 / n1)) / (n0 + n1 - 2) * (1 / n0 + 1 / n1) as v from h where n0 >= 5 and n1 >= 5), k as (select * from d where v > 0), c as (select a, j, d - sum(d * n) over (partition by j) / sum(n) over (partition by j) as d, 1 / v as w from k), r as (select *, unnest(range(1, 21)) as rep from c), f as (select rep, a, {unit_sql('4', 'j', 'rep')} < 0.5 as half, d, w from r), g as (select rep, a, sum(d * w) filter (where half) / sum(w) filter (where half) as x, sum(d * w) filter (where not half) / sum(w) filter (where not half) as y, count(*) filter (where half) as c0, count(*) filter (where not half) as c1 from f group by 1, 2), z as (select rep, corr(x, y) as r, count(*) as accounts from g where c0 >= 2 and c1 >= 2 group by 1 having count(*) >= 8) select round(avg(r), 5) as r, round(quantile_cont(r, 0.025), 5) as low, round(quantile_cont(r, 0.975), 5) as high, count(*) as replicates, round(2 * avg(r) / (1 + avg(r)), 5) as reliability from z")
def shared_drift(spark, d):
    t = trajectories.drift_halves(_cells(spark, d), "a", "j", "t", "n", "s", "s2", 430, 5, 20, 2, 8, 4)
    return t.select(R("r", 5).alias("r"), R("low", 5).alias("low"), R("high", 5).alias("high"), "replicates", R("reliability", 5).alias("reliability"))


@query("with u as (select distinct SeedName as a, target as j, bin, n from cells where trim(coalesce(SeedName, '')) <> '' and target is not null and (contains(target, 'e') or contains(target, 'n')) and target not in ('bike lanes')), g as (select a, j, time_bucket(interval 4 days, bin, timestamp '2021-01-01') as b, sum(n) as n from u group by 1, 2, 3), k as (select a from g group by 1 having sum(n) >= 100) select a, j, epoch_us(b) as us, n::bigint as n from g where a in (select a from k)")
def trend_loader(spark, d):
    t = trajectories.load_trends(read(spark, d, "cells"), "SeedName", "target", "bin", "n", 4, 18628, 100, ["e", "n"], ["bike lanes"])
    return t.select(F.col("SeedName").alias("a"), F.col("target").alias("j"), "us", "n")


@query(f"with {CELLS}, top as (select j from cl group by 1 order by sum(n) desc, j limit 4), w as (select a, t, " + ", ".join(f"sum(s / n) filter (where j = (select j from top order by j limit 1 offset {i})) as x{i}" for i in range(4)) + " from cl where j in (select j from top) group by 1, 2), f as (select a, t, " + ", ".join(f"coalesce(x{i}, first_value(x{i} ignore nulls) over (partition by a order by t rows between 1 following and unbounded following), last_value(x{i} ignore nulls) over (partition by a order by t rows between unbounded preceding and 1 preceding)) as x{i}" for i in range(4)) + " from w) select a, t, " + ", ".join(f"round(coalesce(x{i}, avg(x{i}) over ()), 6) as x{i}" for i in range(4)) + " from f")
def filled_pivot(spark, d):
    c = _cells(spark, d)
    top = sorted(r["j"] for r in c.groupBy("j").agg(F.sum("n").alias("v")).orderBy(F.desc("v"), "j").limit(4).collect())  # four names
    t = trajectories.filled_pivot(c.withColumn("y", F.col("s") / F.col("n")), ["a"], "t", "j", top, "y")
    return t.select("a", "t", *[R(F.col(f"_{i}"), 6).alias(f"x{i}") for i in range(4)])
