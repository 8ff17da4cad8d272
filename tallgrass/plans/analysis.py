"""Pairs, splits, forecast worth, agreement, tests and drift on the test tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallgrass.operators import agreement, aggregates, statistics, trajectories
from tallgrass.operators.sampling import unit_hash
from tallgrass.plans.register import catalogue
from tallgrass.plans.tables import DAILY, EVENTS, daily, events, read

QUERIES, SQL, query = catalogue()
R = F.round

UNIT = "cast('0x' || substr(sha256('{seed}:' || cast({key} as varchar)), 1, 13) as bigint) / 4503599627370496.0"
SPLIT = "case when {u} < 0.7 then 'train' when {u} < 0.8 then 'val' else 'test' end"
USER_SPLIT = SPLIT.replace("{u}", UNIT.format(seed=42, key="user_id"))
STEPS = DAILY + """,
w as (select user_id, day as t0, x as x0, lead(day) over u as t1, lead(x) over u as x1, lag(x) over u as xm1 from daily window u as (partition by user_id order by day)),
steps as (select * from w where t1 - t0 <= 3)"""
LABELLED = STEPS + f""",
lab as (select *, case when t1 > (select max(t1) from steps) - 10 then 'out' else 'in' end as time_split, {USER_SPLIT} as traj_split from steps)"""


def _steps(spark, d):
    return trajectories.step_pairs(daily(spark, d), "user_id", "day", "x", 3)


def _labelled(spark, d):
    return trajectories.labelled(_steps(spark, d), "user_id", "t1", 10, 0, 42)


@query(f"with {STEPS} select user_id, t0, round(x0, 6) as x0, t1, round(x1, 6) as x1, round(xm1, 6) as xm1, xm1 is not null as has_prev from steps")
def pairs_step(spark, d):
    p = _steps(spark, d)
    return p.select("user_id", "t0", R("x0", 6).alias("x0"), "t1", R("x1", 6).alias("x1"), R("xm1", 6).alias("xm1"), "has_prev")


@query(f"with {DAILY}, g as (select day - lag(day) over (partition by user_id order by day) as g from daily), k as (select cast(greatest(1, round_even(7 / median(g), 0)) as bigint) as n from g), r as (select *, row_number() over (partition by user_id order by day) as r from daily), p as (select a.user_id, a.day as t0, a.x as x0, b.day as t1, b.x as x1 from r a, k join r b on true where a.user_id = b.user_id and b.r = a.r + k.n) select user_id, t0, t1, round(x1 - x0, 6) as moved from p where t1 - t0 between 4 and 10")
def pairs_horizon(spark, d):
    p = trajectories.horizon_pairs(daily(spark, d), "user_id", "day", "x", 7, 3)
    return p.select("user_id", "t0", "t1", R(F.col("x1") - F.col("x0"), 6).alias("moved"))


@query("select c_custkey, " + UNIT.format(seed=42, key="c_custkey") + " as u, " + SPLIT.replace("{u}", UNIT.format(seed=42, key="c_custkey")) + " as split from customer")
def split_assign(spark, d):
    k = F.col("c_custkey")
    return read(spark, d, "customer").select("c_custkey", unit_hash(k, 42).alias("u"), trajectories.trajectory_split(k, 42).alias("split"))


@query(f"with {LABELLED} select user_id, t0, t1, time_split, traj_split from lab")
def split_label(spark, d):
    return _labelled(spark, d).select("user_id", "t0", "t1", "time_split", "traj_split")


@query(f"with {LABELLED} select traj_split, time_split, count(*) as pairs, count(distinct user_id) as accounts, round(avg(pow(x1 - x0, 2)), 6) as no_movement_loss from lab group by 1, 2")
def split_summary(spark, d):
    return _labelled(spark, d).groupBy("traj_split", "time_split").agg(F.count("*").alias("pairs"), F.countDistinct("user_id").alias("accounts"), R(F.avg(F.pow(F.col("x1") - F.col("x0"), 2)), 6).alias("no_movement_loss"))


@query(f"with {LABELLED} select (select count(*) from (select user_id from lab group by 1 having count(distinct traj_split) > 1)) as mixed_accounts, cast(coalesce((select min(t1) filter (where time_split = 'out') <= max(t1) filter (where time_split = 'in' and traj_split = 'train') from lab), false) as integer) as early_holdout")
def leakage_check(spark, d):
    return trajectories.leaks(_labelled(spark, d), "user_id", "t1")


GUESS = "x0 + 0.3 * (50 - x0)"


@query(f"with {LABELLED}, q as (select *, {GUESS} as g from lab), m as (select traj_split, time_split, count(*) as pairs, avg(pow(x1 - g, 2)) as model_loss, avg(pow(x1 - x0, 2)) as baseline_loss, avg(pow(g - x0, 2)) as pp, avg((g - x0) * (x1 - x0)) as pd, avg(case when pow(x1 - g, 2) < pow(x1 - x0, 2) then 1.0 else 0.0 end) as fb from q group by 1, 2) select traj_split, time_split, pairs, round(model_loss, 6) as model_loss, round(baseline_loss, 6) as baseline_loss, round(fb, 6) as frac_better, round(1 - model_loss / baseline_loss, 6) as skill, round(sqrt(pp / baseline_loss), 6) as ratio, round(pd / sqrt(pp * baseline_loss), 6) as rho from m")
def skill_metrics(spark, d):
    x0 = F.col("x0")
    t = trajectories.skill_table(_labelled(spark, d), ["traj_split", "time_split"], x0, F.col("x1"), x0 + 0.3 * (50 - x0))
    return t.select("traj_split", "time_split", "pairs", *[R(c, 6).alias(c) for c in ("model_loss", "baseline_loss", "frac_better", "skill", "ratio", "rho")])


@query(f"with {LABELLED}, q as (select *, {GUESS} as g from lab), m as (select avg(pow(x1 - g, 2)) as ml, avg(pow(x1 - x0, 2)) as bl from q) select round(1 - ml / bl, 6) as skill, round(1 - ml / bl, 6) as identity from m")
def skill_identity(spark, d):
    x0 = F.col("x0")
    t = trajectories.skill_table(_labelled(spark, d).withColumn("all", F.lit(1)), ["all"], x0, F.col("x1"), x0 + 0.3 * (50 - x0))
    return t.select(R("skill", 6).alias("skill"), R("identity", 6).alias("identity"))


@query(f"with {LABELLED} select round(avg(case when (x1 - x0) * (x0 - xm1) < 0 then 1.0 else 0.0 end), 6) as reversal, round(sum((x1 - x0) * -(x0 - xm1)) / sqrt(sum(pow(x1 - x0, 2)) filter (where xm1 is not null) * sum(pow(x0 - xm1, 2))), 6) as momentum_rho from lab where xm1 is not null")
def momentum_baseline(spark, d):
    move, back = F.col("x1") - F.col("x0"), F.col("xm1") - F.col("x0")
    p = _labelled(spark, d).where("has_prev")
    return p.agg(R(F.avg((move * -back < 0).cast("double")), 6).alias("reversal"), R(F.sum(move * back) / F.sqrt(F.sum(move * move) * F.sum(back * back)), 6).alias("momentum_rho"))


@query(f"with {DAILY}, b as (select user_id, day, min(day) over u as lo, max(day) over u as hi from daily window u as (partition by user_id)), s as (select *, greatest(floor((hi - lo + 1) * 0.15), 2) as size from b), r as (select *, hi - lo + 1 - 2 * size - 3 as room from s), k as (select *, lo + 1 + floor({UNIT.format(seed=5, key='user_id')} * greatest(room, 1)) as start from r) select user_id, day, case when room < 1 then 'train' when day > hi - size then 'forecast' when day >= start and day < start + size then 'interior' when (day > hi - size - 1 and day <= hi - size) or (day >= start - 1 and day < start + size + 1) then 'gap' else 'train' end as block from k")
def block_holdout(spark, d):
    return trajectories.block_holdout(daily(spark, d), "user_id", "day", 0.15, 2, 1, 5).select("user_id", "day", "block")


@query(f"with {DAILY}, m as (select user_id, arg_min(x, day) as first, arg_max(x, day) as last, count(*) as n from daily group by 1 having count(*) >= 2) select user_id, round(last - first, 6) as moved, n from m order by abs(last - first) desc, user_id limit 20")
def movers(spark, d):
    m = trajectories.movement(daily(spark, d), "user_id", "day", "x")
    return m.orderBy(F.desc(F.abs("moved")), "user_id").limit(20).select("user_id", R("moved", 6).alias("moved"), "n")


@query(f"with {DAILY}, a as (select *, lead(day) over u as t1, lead(x) over u as x1 from daily window u as (partition by user_id order by day)), g as (select *, unnest(generate_series(day, coalesce(t1 - 1, day))) as t from a) select user_id, t, round(coalesce(x + (x1 - x) * (t - day) / (t1 - day), x), 6) as x from g")
def interpolated_states(spark, d):
    return trajectories.between_bins(daily(spark, d), "user_id", "day", "x", 1).select("user_id", "t", R("x", 6).alias("x"))


@query(f"with {DAILY}, t as (select user_id, regr_slope(x, day) as slope, count(*) as n, arg_max(x, day) as last from daily group by 1) select user_id, round(slope, 6) as slope, round(0.5 * (last + slope * 0.9 * (1 - pow(0.9, 7)) / 0.1 + last), 6) as theta from t where n >= 5")
def theta_trend(spark, d):
    t = daily(spark, d).groupBy("user_id").agg(F.regr_slope("x", "day").alias("slope"), F.count("*").alias("n"), F.max_by("x", "day").alias("last"))
    damp = 0.9 * (1 - F.pow(F.lit(0.9), 7)) / 0.1
    return t.where("n >= 5").select("user_id", R("slope", 6).alias("slope"), R(0.5 * (F.col("last") + F.col("slope") * damp + F.col("last")), 6).alias("theta"))


@query(f"with {DAILY}, q as (select quantile_cont(x, 0.2) as lo, quantile_cont(x, 0.8) as hi from daily) select case when x < lo then 'low' when x > hi then 'high' else 'middle' end as stratum, count(*) as n, round(avg(x), 6) as mean from daily, q group by 1")
def quantile_strata(spark, d):
    s = daily(spark, d)
    q = s.agg(F.percentile("x", F.array(F.lit(0.2), F.lit(0.8))).alias("q"))
    stratum = F.when(F.col("x") < F.col("q")[0], "low").when(F.col("x") > F.col("q")[1], "high").otherwise("middle")
    return s.join(F.broadcast(q)).groupBy(stratum.alias("stratum")).agg(F.count("*").alias("n"), R(F.avg("x"), 6).alias("mean"))


@query(f"with {EVENTS}, h as (select user_id, event_type, us * 2 < min(us) over (partition by user_id) + max(us) over (partition by user_id) as early from ev), c as (select user_id, event_type, 100.0 * count(*) filter (where early) / sum(count(*) filter (where early)) over (partition by user_id) as a, 100.0 * count(*) filter (where not early) / sum(count(*) filter (where not early)) over (partition by user_id) as b from h group by 1, 2) select user_id, event_type, round(b - a, 6) as shift from c where a is not null and b is not null")
def stance_shift(spark, d):
    from tallgrass.operators.windows import early_half

    e = events(spark, d).withColumn("early", early_half("user_id", "us"))
    c = e.groupBy("user_id", "event_type").agg(F.count_if("early").alias("a"), F.count_if(~F.col("early")).alias("b"))
    w = Window.partitionBy("user_id")
    share = lambda n: F.when(F.sum(n).over(w) > 0, 100 * F.col(n) / F.sum(n).over(w))
    return c.select("user_id", "event_type", R(share("b") - share("a"), 6).alias("shift")).where("shift is not null")


# two raters of one item: the coder's own answer and the model's
RATED = "rated as (select upper(trim(coded_stance)) as gold, model_stance as pred from coded_pairs where trim(coalesce(coded_stance, '')) <> '')"
LABELS = ("AGAINST", "FAVOR", "NEUTRAL")
GRID = "grid as (select g.l as gold, p.l as pred from (values ('AGAINST'), ('FAVOR'), ('NEUTRAL')) g(l), (values ('AGAINST'), ('FAVOR'), ('NEUTRAL')) p(l)), m as (select g.gold, g.pred, cast(count(r.gold) as double) as n from grid g left join rated r on r.gold = g.gold and r.pred = g.pred group by 1, 2)"


def _matrix(spark, d):
    rows = read(spark, d, "coded_pairs").select(F.upper(F.trim("coded_stance")).alias("g"), F.col("model_stance").alias("p"))
    return agreement.confusion(rows, "g", "p", LABELS)


@query(f"with {RATED}, {GRID} select gold, pred, n from m")
def confusion_counts(spark, d):
    return _matrix(spark, d)


@query(f"with {RATED}, {GRID} select gold, pred, round((n + 1) / sum(n + 1) over (partition by gold), 6) as p from m")
def confusion_channel(spark, d):
    return agreement.channel(_matrix(spark, d)).select("gold", "pred", R("p", 6).alias("p"))


@query(f"with {RATED}, {GRID}, t as (select l.gold as label, (select sum(n) from m where m.gold = l.gold) as support, (select sum(n) from m where m.pred = l.gold) as called, (select sum(n) from m where m.pred = l.gold and m.gold = l.gold) as hit from (select distinct gold from m) l) select label, round(hit / called, 6) as precision, round(hit / support, 6) as recall, round(2 * hit / (called + support), 6) as f1, support from t")
def precision_recall(spark, d):
    return agreement.class_scores(_matrix(spark, d)).select("label", *[R(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


@query(f"with {RATED}, {GRID}, r as (select gold as l, sum(n) as r from m group by 1), c as (select pred as l, sum(n) as c from m group by 1), h as (select gold as l, n as h from m where gold = pred), s as (select sum(n) as n from m) select round(sum(h) / max(s.n), 6) as accuracy, round((sum(h) / max(s.n) - sum(r * c) / max(s.n * s.n)) / (1 - sum(r * c) / max(s.n * s.n)), 6) as kappa, round(avg(2 * h / (r + c)), 6) as macro_f1, round(sum(2 * h / (r + c) * r) / max(s.n), 6) as weighted_f1 from r join c using (l) join h using (l), s")
def kappa_cohen(spark, d):
    return agreement.overall_scores(_matrix(spark, d)).select(*[R(c, 6).alias(c) for c in ("accuracy", "kappa", "macro_f1", "weighted_f1")])


ANSWERS = "raw as (select lower(trim(platform)) as platform, post_id, target, lower(trim(coder)) as coder, upper(trim(coded_stance)) as s, coded_at from coded_pairs where trim(coalesce(coded_stance, '')) <> ''), ans as (select platform, post_id, target, coder, arg_max(s, (coded_at, s)) as label from raw group by 1, 2, 3, 4)"


def _answers(spark, d):
    rows = read(spark, d, "coded_pairs").select(F.lower(F.trim("platform")).alias("platform"), "post_id", "target", F.lower(F.trim("coder")).alias("coder"), F.upper(F.trim("coded_stance")).alias("s"), "coded_at")
    return rows.where("s <> ''").groupBy("platform", "post_id", "target", "coder").agg(F.max_by("s", F.struct("coded_at", "s")).alias("label"))


ITEM = ["platform", "post_id", "target"]


@query(f"with {ANSWERS}, c as (select platform, post_id, target, label, count(*) as n from ans group by all), f as (select *, sum(n) over (partition by platform, post_id, target) as k from c), i as (select k, platform, post_id, target, case when k > 1 then (sum(n * n) - k) / (k * (k - 1.0)) end as p from f group by 1, 2, 3, 4), g as (select k, sum(m * m) / pow(sum(m), 2) as pe from (select k, label, sum(n) as m from f group by 1, 2) group by 1) select cast(i.k as bigint) as raters, count(*) as items, round(case when max(pe) < 1 and i.k > 1 then (avg(p) - max(pe)) / (1 - max(pe)) end, 6) as kappa from i join g using (k) group by i.k")
def kappa_fleiss(spark, d):
    return agreement.fleiss_kappas(_answers(spark, d), ITEM, "label").withColumn("kappa", R("kappa", 6))


@query(f"with {ANSWERS}, c as (select platform, post_id, target, label, count(*) as n from ans group by all), t as (select *, max(n) over (partition by platform, post_id, target) as top from c) select platform, post_id, target, min(label) as label, max(n) as votes from t where n = top group by 1, 2, 3 having count(*) = 1")
def majority_label(spark, d):
    return agreement.majority(_answers(spark, d), ITEM, "label")


@query(f"with {ANSWERS} select a.coder as rater_a, b.coder as rater_b, count(*) as items, round(avg(case when a.label = b.label then 1.0 else 0.0 end), 6) as agree from ans a join ans b using (platform, post_id, target) where a.coder < b.coder group by 1, 2")
def coder_agreement(spark, d):
    return agreement.pairwise_agreement(_answers(spark, d), ITEM, "coder", "label").withColumn("agree", R("agree", 6))


@query("select lower(trim(platform)) as platform, count(*) filter (where r and s) as both, count(*) filter (where r and not s) as relevance_only, count(*) filter (where s and not r) as stance_only, count(*) filter (where not r and not s) as blank from (select *, trim(coalesce(coded_relevant, '')) <> '' as r, trim(coalesce(coded_stance, '')) <> '' as s from coded_pairs) group by 1")
def coding_coverage(spark, d):
    filled = lambda c: F.length(F.trim(F.coalesce(c, F.lit("")))) > 0
    r, s = filled(F.col("coded_relevant")), filled(F.col("coded_stance"))
    return read(spark, d, "coded_pairs").groupBy(F.lower(F.trim("platform")).alias("platform")).agg(F.count_if(r & s).alias("both"), F.count_if(r & ~s).alias("relevance_only"), F.count_if(s & ~r).alias("stance_only"), F.count_if(~r & ~s).alias("blank"))


PROBS = "pr as (select event_id, [0.2 + 0.006 * (100 - least(value, 100)) * 0.9, 0.1, 0.0] as raw, case event_type when 'error' then 0 when 'view' then 1 else 2 end as y from events), p as (select event_id, y, raw[1] as a, 0.1 as b, 1 - raw[1] - 0.1 as c from pr)"


def _probs(spark, d):
    a = 0.2 + 0.006 * (100 - F.least("value", F.lit(100.0))) * 0.9
    return read(spark, d, "events").select("event_id", F.array(a, F.lit(0.1), 1 - a - 0.1).alias("p"), F.when(F.col("event_type") == "error", 0).when(F.col("event_type") == "view", 1).otherwise(2).alias("y"))


@query(f"with {PROBS} select y, round(avg((pow(a - (y <= 0)::int, 2) + pow(a + b - (y <= 1)::int, 2)) / 2), 6) as rps, round(avg(-ln(greatest(case y when 0 then a when 1 then b else c end, 1e-12))), 6) as log_score from p group by 1")
def probability_scores(spark, d):
    p = _probs(spark, d)
    return p.groupBy("y").agg(R(F.avg(agreement.ranked_probability_score(F.col("p"), F.col("y"))), 6).alias("rps"), R(F.avg(agreement.log_score(F.col("p"), F.col("y"))), 6).alias("log_score"))


@query(f"with {PROBS}, g as (select unnest([0.5, 1.0, 2.0]::double[]) as temperature), q as (select temperature, y, pow(greatest(a, 1e-12), 1 / temperature) as a, pow(b, 1 / temperature) as b, pow(greatest(c, 1e-12), 1 / temperature) as c from p, g) select temperature, round(avg(-ln(greatest(case y when 0 then a when 1 then b else c end / (a + b + c), 1e-12))), 6) as nll from q group by 1")
def temperature_fit(spark, d):
    return agreement.fit_temperature(_probs(spark, d), "p", "y", [0.5, 1.0, 2.0]).withColumn("nll", R("nll", 6))


@query("with s as (select value / 1000 as f, case when event_type = 'purchase' then 1.0 else 0.0 end as o, 1.0 as w from events), c as (select f, sum(w) as w from s group by 1), b as (select f, least(floor(coalesce(sum(w) over (order by f rows between unbounded preceding and 1 preceding), 0) / sum(w) over () * 50), 49) as bin from c), j as (select s.f, s.o, bin from s join b using (f)), t as (select avg(o) as base, avg(pow(f - o, 2)) as brier from j), g as (select bin, count(*) as n, avg(f) as f, avg(o) as o from j group by 1) select round(max(brier), 6) as brier, round(sum(n * pow(f - o, 2)) / sum(n), 6) as reliability, round(sum(n * pow(o - base, 2)) / sum(n), 6) as resolution, round(max(base * (1 - base)), 6) as uncertainty from g, t")
def brier_murphy(spark, d):
    s = read(spark, d, "events").select((F.col("value") / 1000).alias("f"), (F.col("event_type") == "purchase").cast("double").alias("o"), F.lit(1.0).alias("w"))
    m = agreement.murphy(aggregates.equal_mass_bins(s, "f", "w", 50, ["f"]), "f", "o")
    return m.select(*[R(c, 6).alias(c) for c in m.columns])


@query("with v as (select value, event_type = 'error' as a from events where event_type in ('error', 'view')), c as (select value, count(*) as n from v group by 1), r as (select value, coalesce(sum(n) over (order by value rows between unbounded preceding and 1 preceding), 0) + (n + 1) / 2.0 as rank from c), t as (select sum(rank) filter (where a) as r, count(*) filter (where a) as n1, count(*) filter (where not a) as n2 from v join r using (value)) select round(r - n1 * (n1 + 1) / 2.0, 3) as u, n1, n2, round((r - n1 * (n1 + 1) / 2.0 - n1 * n2 / 2.0) / sqrt(n1 * n2 * (n1 + n2 + 1) / 12.0), 6) as z from t")
def rank_test_mwu(spark, d):
    e = read(spark, d, "events").where(F.col("event_type").isin("error", "view"))
    return statistics.mann_whitney(e, "value", "event_type", "error").select(R("u", 3).alias("u"), "n1", "n2", R("z", 6).alias("z"))


@query(f"with {STEPS}, d as (select pow(x1 - x0, 2) - pow(x1 - ({GUESS}), 2) as d from steps), e as (select d, abs(d) as m from d where d <> 0), c as (select m, count(*) as n from e group by 1), r as (select m, coalesce(sum(n) over (order by m rows between unbounded preceding and 1 preceding), 0) + (n + 1) / 2.0 as rank from c), t as (select coalesce(sum(rank) filter (where d > 0), 0) as wp, coalesce(sum(rank) filter (where d < 0), 0) as wm, count(*) as n from e join r using (m)) select round(wp, 3) as w_plus, round(wm, 3) as w_minus, n, round((wp - n * (n + 1) / 4.0) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0), 6) as z from t")
def wilcoxon(spark, d):
    x0 = F.col("x0")
    p = _steps(spark, d).select(F.pow(F.col("x1") - x0, 2).alias("a"), F.pow(F.col("x1") - (x0 + 0.3 * (50 - x0)), 2).alias("b"))
    return statistics.wilcoxon(p, "a", "b").select(R("w_plus", 3).alias("w_plus"), R("w_minus", 3).alias("w_minus"), "n", R("z", 6).alias("z"))


@query("with p as (select n_nationkey, (n_nationkey * 7 % 25 + 1) / 100.0 as p from nation), r as (select *, count(*) over () as m, row_number() over (order by p) as r from p), a as (select *, least(1, p * m / r) as raw from r) select n_nationkey, round(raw, 6) as adjusted, round(min(raw) over (order by p rows between current row and unbounded following), 6) as step_up from a")
def bh_adjust(spark, d):
    p = read(spark, d, "nation").select("n_nationkey", F.expr("(n_nationkey * 7 % 25 + 1) / 100.0D").alias("p"))
    a = statistics.benjamini_hochberg(p, "p")
    b = statistics.benjamini_hochberg(p, "p", monotone=True).select("n_nationkey", R("adjusted", 6).alias("step_up"))
    return a.select("n_nationkey", R("adjusted", 6).alias("adjusted")).join(b, "n_nationkey")


@query("with c as (select user_id, event_type, day(ts) <= 15 as early, count(*) as o from events group by all), t as (select *, sum(o) over (partition by user_id, event_type) as r, sum(o) over (partition by user_id, early) as c, sum(o) over (partition by user_id) as n from c) select user_id, case when max(n) >= 10 then round(max(n) * (sum(o * o / (r * c)) - 1), 6) else 0 end as chi2, (count(distinct event_type) - 1) * (count(distinct early) - 1) as df, cast(max(n) as bigint) as n from t group by 1")
def chi_square(spark, d):
    e = read(spark, d, "events").withColumn("early", F.dayofmonth("ts") <= 15)
    return statistics.chi_square(e, ["user_id"], "event_type", "early").withColumn("chi2", R("chi2", 6))


@query("with q as (select event_type, quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.5) as median, quantile_cont(value, 0.75) as q3 from events group by 1), j as (select e.event_type, e.value, q1, median, q3, value between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1) as inside from events e join q using (event_type)) select event_type, round(max(q1), 6) as q1, round(max(median), 6) as median, round(max(q3), 6) as q3, min(value) filter (where inside) as low, max(value) filter (where inside) as high, count(*) filter (where not inside) as outliers from j group by 1")
def box_statistics(spark, d):
    b = statistics.box_statistics(read(spark, d, "events"), ["event_type"], "value")
    return b.select("event_type", *[R(c, 6).alias(c) for c in ("q1", "median", "q3")], "low", "high", "outliers")


@query("with p as (select o_orderpriority as g, count(*) as n, avg(o_totalprice) as m, var_pop(o_totalprice) as v from orders group by 1), w as (select sum(n * m) / sum(n) as g0 from p), t as (select sum(n * pow(m - g0, 2)) as b, sum(n * v) as w, sum(n) as n, count(*) as k from p, w) select round(b / (b + w), 9) as eta2, round((b / (k - 1)) / (w / (n - k)), 6) as f from t")
def eta_squared(spark, d):
    return statistics.eta_squared(read(spark, d, "orders"), "o_orderpriority", "o_totalprice").select(R("eta2", 9).alias("eta2"), R("f", 6).alias("f"))


@query("with p as (select event_type as g, count(*) as n, avg(value) as m, var_samp(value) as v from events group by 1) select a.g as event_type_a, b.g as event_type_b, round((a.m - b.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2)), 6) as d from p a join p b on a.g < b.g")
def cohens_d_pairs(spark, d):
    return statistics.cohens_d_pairs(read(spark, d, "events"), "event_type", "value").withColumn("d", R("d", 6))


@query("with l as (select label, unnest(embedding) as v, generate_subscripts(embedding, 1) - 1 as dim from embeddings), v as (select label, dim, var_pop(v) as v from l group by 1, 2), f as (select *, v / sum(v) over (partition by label) as f from v) select label, cast(arg_max(dim, (f, -dim)) as bigint) as dominant, round(sum(case when f > 0 then -f * ln(f) else 0 end), 6) as entropy, round(1 / sum(f * f), 6) as participation from f group by 1")
def entropy_fraction(spark, d):
    long = read(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("dim", "v")).withColumn("v", F.col("v").cast("double"))
    t = statistics.variance_fractions(long, "label", "dim", "v")
    return t.select("label", F.col("dominant").cast("bigint").alias("dominant"), R("entropy", 6).alias("entropy"), R("participation", 6).alias("participation"))


@query("with s as (select event_type as g, greatest(-1, least(1, (value - 50) / 50)) as x from events), m as (select *, avg(x) over (partition by g) as mean from s), y as (select g, avg(abs(x - mean)) / 2 as sy from m group by 1), h as (select g, least(greatest(floor((x + 1) / 0.2), 0), 9) as b, count(*) as n from s group by 1, 2), p as (select *, n / sum(n) over (partition by g) as p from h), e as (select a.g, sum(pow(a.p, 2.6) * b.p * abs(a.b - b.b) * 0.2) as er from p a join p b using (g) group by 1) select g, round(sy, 6) as sym, round(er, 6) as esteban_ray from y join e using (g)")
def polarization(spark, d):
    s = read(spark, d, "events").select(F.col("event_type").alias("g"), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.col("value") - 50) / 50)).alias("x"))
    return statistics.polarization(s, ["g"], "x", 10, -1.0, 1.0).select("g", R("symmetric", 6).alias("sym"), R("esteban_ray", 6).alias("esteban_ray"))


@query("with p as (select event_type as before, lead(event_type) over (partition by user_id order by ts, event_id) as after from events), c as (select before, after, count(*) as n from p where after is not null group by 1, 2) select before, after, n, round(n / sum(n) over (partition by before), 6) as p from c")
def transition_matrix(spark, d):
    return statistics.transitions(read(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type").withColumn("p", R("p", 6))


@query(f"with {DAILY}, s as (select user_id, day, greatest(-1, least(1, (x - 50) / 50)) as y from daily where user_id < 20), g as (select user_id, unnest(generate_series(min(day), max(day))) as t from s group by 1), j as (select g.user_id, g.t, s.day - g.t as d, s.y from g join s on s.user_id = g.user_id and abs(s.day - g.t) <= 8), k as (select user_id, t, sum(exp(-pow(d / 2.0, 2) / 2)) as s0, sum(exp(-pow(d / 2.0, 2) / 2) * d) as s1, sum(exp(-pow(d / 2.0, 2) / 2) * d * d) as s2, sum(exp(-pow(d / 2.0, 2) / 2) * y) as y0, sum(exp(-pow(d / 2.0, 2) / 2) * d * y) as y1 from j group by 1, 2) select user_id, t, round(greatest(-1, least(1, case when s0 * s2 - s1 * s1 > 1e-9 then (s2 * y0 - s1 * y1) / (s0 * s2 - s1 * s1) else y0 / s0 end)), 5) as fit from k".replace(" where user_id < 20", ""))
def kernel_regression(spark, d):
    s = daily(spark, d).select("user_id", "day", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.col("x") - 50) / 50)).alias("y"))
    return statistics.kernel_regression(s, "user_id", "day", "y", 2.0, 8).select("user_id", "t", R("fit", 5).alias("fit"))


@query(f"with {DAILY}, e as (select min(day) as lo, max(day) as hi from daily), w as (select least(floor((day - lo) * 4 / (hi - lo + 1)), 3) as wi, x from daily, e), p as (select wi, count(*) as n, avg(x) as m, var_samp(x) as v from w group by 1), b as (select * from p where wi = 0) select cast(p.wi as bigint) as stretch, p.n, round(p.m, 6) as mean, round((p.m - b.m) / sqrt(((p.n - 1) * p.v + (b.n - 1) * b.v) / (p.n + b.n - 2)), 6) as d, round(p.v / b.v, 6) as variance_ratio from p, b")
def window_drift(spark, d):
    t = statistics.window_drift(daily(spark, d), "day", "x", 4)
    return t.select(F.col("window").cast("bigint").alias("stretch"), "n", R("mean", 6).alias("mean"), R("d", 6).alias("d"), R("variance_ratio", 6).alias("variance_ratio"))


@query(f"with {DAILY}, s as (select day, stddev_samp(x) as sd from daily group by 1) select round(regr_slope(sd, day), 6) as slope, round(regr_r2(sd, day), 6) as r2, count(*) as times from s where sd is not null")
def ensemble_spread(spark, d):
    return statistics.spread_trend(daily(spark, d), "day", "x").select(R("slope", 6).alias("slope"), R("r2", 6).alias("r2"), "times")


@query("with m as (select l_returnflag as g, l_quantity as x, l_extendedprice as y, 1 + l_discount as w from lineitem), s as (select g, sum(w) as s, sum(w*x)/sum(w) as mx, sum(w*y)/sum(w) as my, sum(w*x*y)/sum(w) as xy, sum(w*x*x)/sum(w) as xx, sum(w*y*y)/sum(w) as yy from m group by 1) select g, round((xy - mx * my) / sqrt((xx - mx * mx) * (yy - my * my)), 6) as r from s")
def weighted_pearson(spark, d):
    l = read(spark, d, "lineitem")
    return l.groupBy(F.col("l_returnflag").alias("g")).agg(R(statistics.weighted_pearson(F.col("l_quantity").cast("double"), F.col("l_extendedprice"), 1 + F.col("l_discount")), 6).alias("r"))


@query("with p as (select embedding[1]::double as x, embedding[2]::double as y from embeddings), g as (select i, j, -0.5 + i * 0.05 as gx, -0.5 + j * 0.05 as gy from range(21) a(i), range(21) b(j)) select cast(i as bigint) as i, cast(j as bigint) as j, round(sum(exp(-(pow(x - gx, 2) + pow(y - gy, 2)) / 0.005)), 5) as density from p, g where pow(x - gx, 2) + pow(y - gy, 2) <= 0.04 group by 1, 2")
def density_grid(spark, d):
    p = read(spark, d, "embeddings").select(F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    g = statistics.density_grid(p, "x", "y", -0.5, 0.5, 21, 0.05)
    return g.select(F.col("i").cast("bigint").alias("i"), F.col("j").cast("bigint").alias("j"), R("density", 5).alias("density"))


@query("with p as (select embedding[1]::double as x, embedding[2]::double as y from embeddings), g as (select i, j, -0.5 + i * 0.05 as gx, -0.5 + j * 0.05 as gy from range(21) a(i), range(21) b(j)), k as (select i, j, sum(exp(-(pow(x - gx, 2) + pow(y - gy, 2)) / 0.005)) as density from p, g where pow(x - gx, 2) + pow(y - gy, 2) <= 0.04 group by 1, 2) select cast(i as int) as i, cast(j as int) as j, round(density, 5) as density from k where not exists (select 1 from k o where o.density >= k.density and abs(o.i - k.i) <= 2 and abs(o.j - k.j) <= 2 and (o.i, o.j) <> (k.i, k.j)) order by k.density desc, i, j limit 10")
def density_peaks(spark, d):
    p = read(spark, d, "embeddings").select(F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return statistics.grid_maxima(statistics.density_grid(p, "x", "y", -0.5, 0.5, 21, 0.05)).withColumn("density", R("density", 5))
