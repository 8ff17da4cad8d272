"""Panel operators on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallgrass.functions.time import micros
from tallgrass.operators import panel
from tallgrass.plans.analysis import LABELLED, _labelled
from tallgrass.plans.register import catalogue
from tallgrass.plans.scores import erfc_sql
from tallgrass.plans.tables import DAILY, EVENTS, daily, events, read

QUERIES, SQL, query = catalogue()
R = F.round
STANCE = "case when value > 60 then 1 when value < 30 then -1 else 0 end"


def _stance():
    return F.when(F.col("value") > 60, 1).when(F.col("value") < 30, -1).otherwise(0)


@query("with l as (select vec_id, label, unnest(embedding)::double as l, generate_subscripts(embedding, 1) - 1 as dim from embeddings), s as (select dim, vec_id, abs(l) * sqrt(label + 1) as strength from l), r as (select *, row_number() over (partition by dim order by strength desc, vec_id) as r from s) select cast(dim as bigint) as dim, vec_id, round(strength, 6) as strength from r where r <= 3")
def top_loadings(spark, d):
    e = read(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), (F.col("label") + 1).alias("volume"))
    return panel.top_loadings(e, "vec_id", "v", "volume", 3).select(F.col("dim").cast("bigint").alias("dim"), "vec_id", R("strength", 6).alias("strength"))


@query("with u as (select vec_id, embedding::double[] as v from embeddings), q as (select vec_id as query, v as q from u where vec_id % 100 = 0), s as (select query, vec_id, list_dot_product(v, q) / sqrt(list_dot_product(v, v) * list_dot_product(q, q)) as score from u, q), r as (select *, row_number() over (partition by query order by score desc, vec_id) as r from s where score > 0.2) select query, vec_id, round(score, 6) as score from r where r between 6 and 10")
def semantic_pages(spark, d):
    e = read(spark, d, "embeddings")
    return panel.similar_pages(e, e.where("vec_id % 100 = 0"), "vec_id", "embedding", 0.2, 1, 5).withColumn("score", R("score", 6))


@query(r"with w as (select lang, unnest(regexp_extract_all(lower(text), '\p{L}{3,}')) as word from documents where lang is not null), tf as (select lang, word, count(*) as n from w group by 1, 2), u as (select word, sum(n) as uses from tf group by 1), z as (select lang, sum(n) as size from tf group by 1), m as (select avg(size) as mean_size from z), s as (select tf.lang, tf.word, n / size * ln(1 + mean_size / uses) as score from tf join u using (word) join z using (lang), m), r as (select *, row_number() over (partition by lang order by score desc, word) as r from s) select lang, word, round(score, 8) as score from r where r <= 8")
def class_keywords(spark, d):
    return panel.class_keywords(read(spark, d, "documents").where("lang is not null"), "lang", "text", 8).withColumn("score", R("score", 8))


@query("with r as (select doc_id, lang, row_number() over (partition by lang order by sha256('4:' || cast(doc_id as varchar)), doc_id) as r from documents where lang is not null) select lang, doc_id from r where r <= 3")
def exemplar_documents(spark, d):
    return panel.exemplars(read(spark, d, "documents").where("lang is not null").select("lang", "doc_id"), "lang", "doc_id", 3, 4)


@query(f"with s as (select event_type, {STANCE} as s from events) select event_type, count(*) as n, round(avg(s), 6) as mean, round(stddev_samp(s), 6) as sd, round(avg(abs(s)), 6) as strength, count(*) filter (where s > 0) as favor, count(*) filter (where s < 0) as against, count(*) filter (where s = 0) as neutral from s group by 1")
def target_statistics(spark, d):
    t = panel.stance_summary(read(spark, d, "events").withColumn("s", _stance()), "event_type", "s")
    return t.select("event_type", "n", R("mean", 6).alias("mean"), R("sd", 6).alias("sd"), R("strength", 6).alias("strength"), "favor", "against", "neutral")


@query("with f as (select platform, unnest([{'t': 'party', 'v': seed.Party}, {'t': 'province', 'v': seed.Province}, {'t': 'type', 'v': seed.MainType}]) as f from doc_targets) select f.t as filter_type, f.v as filter_value, platform, count(*) as n from f where f.v is not null group by 1, 2, 3 having count(*) >= 5")
def trend_filters(spark, d):
    return panel.filter_counts(read(spark, d, "doc_targets"), [("party", F.col("seed.Party")), ("province", F.col("seed.Province")), ("type", F.col("seed.MainType"))], ["platform"], 5)


@query("with o as (select filter_value, createtime, min(x0) as x0 from target_df where filter_value is not null and trim(filter_value) <> '' and x0 is not null group by 1, 2), t as (select filter_value, createtime, unnest(x0) as v, generate_subscripts(x0, 1) - 1 as dim from o), l as (select dim, v - lag(v) over (partition by filter_value, dim order by createtime) as d from t) select cast(dim as bigint) as dim, round(var_samp(d), 6) as variance from l where d is not null and not isnan(d) group by 1")
def step_variance(spark, d):
    # of several readings at one time the least counts
    once = read(spark, d, "target_df").where("trim(filter_value) <> '' and x0 is not null").groupBy("filter_value", "createtime").agg(F.min("x0").alias("x0"))
    return panel.step_variance(once, "filter_value", "createtime", "x0").select(F.col("dim").cast("bigint").alias("dim"), R("variance", 6).alias("variance"))


@query(f"with {DAILY}, m as (select avg(x) filter (where day < 19740) as m, stddev_pop(x) filter (where day < 19740) as s from daily) select user_id, day, round((x - m) / s, 6) as x from daily, m")
def standardised(spark, d):
    return panel.standardised(daily(spark, d), "x", F.col("day") < 19740).select("user_id", "day", R("x", 6).alias("x"))


@query(f"with {DAILY} select user_id, median(1 / sqrt(n)) as median_sd from daily group by 1 having median(1 / sqrt(n)) <= 0.75")
def certain_accounts(spark, d):
    return panel.certain_accounts(daily(spark, d).withColumn("sd", 1 / F.sqrt("n")), "user_id", "sd", 0.75)


@query(f"with {DAILY}, s as (select user_id, min(day) as lo, max(day) as hi from daily group by 1), q as (select unnest(range(21)) / 20.0 as q), st as (select distinct ceil(v) as a from (select unnest(quantile_cont(lo, [" + ", ".join(repr(i / 20) for i in range(21)) + "])) as v from s)), en as (select distinct floor(v) as b from (select unnest(quantile_cont(hi, [" + ", ".join(repr(i / 20) for i in range(21)) + "])) as v from s)), c as (select a, b, b - a + 1 as bins, (select count(*) from s where lo <= a and hi >= b) as n from st, en) select a::double as start, b::double as end, n::int as accounts, (n * bins)::double as size from c where bins >= 2 and n >= 2 order by n * bins desc, a, b limit 1")
def balanced_panel(spark, d):
    return panel.balanced_panel(daily(spark, d), "user_id", "day")


@query(f"with {DAILY}, s as (select user_id, day, x, n * 10.0 as y from daily), mv as (select x, y, lead(x) over w - x as dx, lead(y) over w - y as dy from s window w as (partition by user_id order by day)), m as (select * from mv where dx is not null and dy is not null), e as (select min(x) - 0.1 * (max(x) - min(x)) as lx, 1.2 * (max(x) - min(x)) / 49 as sx, min(y) - 0.1 * (max(y) - min(y)) as ly, 1.2 * (max(y) - min(y)) / 49 as sy, quantile_cont(dx, 0.01) as ax, quantile_cont(dx, 0.99) as bx, quantile_cont(dy, 0.01) as ay, quantile_cont(dy, 0.99) as by_ from m), k as (select i, j, greatest(ax, least(bx, dx)) as dx, greatest(ay, least(by_, dy)) as dy, pow(x - (lx + i * sx), 2) + pow(y - (ly + j * sy), 2) as d2 from m, e, range(50) a(i), range(50) b(j) where abs(x - (lx + i * sx)) <= 15.0001 and abs(y - (ly + j * sy)) <= 15.0001) select cast(i as int) as i, cast(j as int) as j, round(sum(exp(-d2 / 50) * dx) / (sum(exp(-d2 / 50)) + 1), 5) as dx, round(sum(exp(-d2 / 50) * dy) / (sum(exp(-d2 / 50)) + 1), 5) as dy, round(sum(exp(-d2 / 50)), 5) as weight from k where d2 <= 225 group by 1, 2")
def flow_field(spark, d):
    s = daily(spark, d).withColumn("y", F.col("n").cast("double") * 10)
    f = panel.flow_field(s, "user_id", "day", "x", "y", 50, 5.0)
    return f.select("i", "j", R("dx", 5).alias("dx"), R("dy", 5).alias("dy"), R("weight", 5).alias("weight"))


@query(f"with {LABELLED}, q as (select time_split, pow(x1 - (x0 + 0.3 * (50 - x0)), 2) as a, greatest(pow(x1 - x0, 2), 1e-12) as b from lab) select time_split, round(quantile_cont(a / b, 0.5), 5) as median_ratio, round(avg(a) / avg(b), 6) as ratio_of_means, round(median(a) / median(b), 6) as ratio_of_medians, round(avg(a) - avg(b), 5) as difference from q group by 1")
def loss_ratios(spark, d):
    x0 = F.col("x0")
    p = _labelled(spark, d).select("time_split", F.pow(F.col("x1") - (x0 + 0.3 * (50 - x0)), 2).alias("a"), F.greatest(F.pow(F.col("x1") - x0, 2), F.lit(1e-12)).alias("b"))
    t = panel.loss_ratios(p, ["time_split"], "a", "b")
    return t.select("time_split", R("median_ratio", 5).alias("median_ratio"), R("ratio_of_means", 6).alias("ratio_of_means"), R("ratio_of_medians", 6).alias("ratio_of_medians"), R("difference", 5).alias("difference"))


@query(f"with {LABELLED} select traj_split, round(avg(abs(x1 - x0)), 6) as mean, round(median(abs(x1 - x0)), 6) as median, round(sqrt(avg(pow(x1 - x0, 2))), 6) as rmse, round(quantile_cont(abs(x1 - x0), 0.9), 6) as p90 from lab group by 1")
def error_table(spark, d):
    t = panel.error_table(_labelled(spark, d), ["traj_split"], F.abs(F.col("x1") - F.col("x0")))
    return t.select("traj_split", *[R(c, 6).alias(c) for c in ("mean", "median", "rmse", "p90")])


@query(f"with {LABELLED}, f as (select traj_split, t1 // 5 as fold, avg(pow(x1 - x0, 2)) as loss from lab group by 1, 2) select traj_split, count(*) as folds, round(avg(loss), 6) as loss_mean, round(stddev_samp(loss), 6) as loss_sd from f group by 1")
def fold_summary(spark, d):
    f = _labelled(spark, d).groupBy("traj_split", F.floor(F.col("t1") / 5).alias("fold")).agg(F.avg(F.pow(F.col("x1") - F.col("x0"), 2)).alias("loss"))
    t = panel.fold_summary(f, ["traj_split"], "fold", ["loss"])
    return t.select("traj_split", "folds", R("loss_mean", 6).alias("loss_mean"), R("loss_sd", 6).alias("loss_sd"))


@query(f"with {DAILY}, m as (select user_id, day, x - lag(x) over (partition by user_id order by day) as d from daily), h as (select day, avg(d) filter (where substr(sha256('6:' || cast(user_id as varchar)), 1, 1) < '8') as a, avg(d) filter (where substr(sha256('6:' || cast(user_id as varchar)), 1, 1) >= '8') as b from m where d is not null group by 1) select round(corr(a, b), 6) as r, count(*) as times, round(2 * corr(a, b) / (1 + corr(a, b)), 6) as reliability from h where a is not null and b is not null")
def split_half(spark, d):
    s = panel.split_half(daily(spark, d).withColumn("k", F.lit(1)), "k", "user_id", "day", "x", 6)
    return s.select(R("r", 6).alias("r"), "times", R("reliability", 6).alias("reliability"))


@query(f"with {DAILY}, c as (select b.day - a.day as lag, avg(pow(b.x - a.x, 2)) as v from daily a join daily b on a.user_id = b.user_id and b.day - a.day between 1 and 10 group by 1) select round(regr_slope(ln(v), ln(lag)), 6) as exponent, round(exp(regr_intercept(ln(v), ln(lag))), 4) as scale from c")
def msd_power_law(spark, d):
    from tallgrass.operators.joins import lag_pairs

    c = lag_pairs(daily(spark, d), ["user_id"], "day", 10, ["x"]).groupBy("lag").agg(F.avg(F.pow(F.col("x_b") - F.col("x_a"), 2)).alias("v"))
    return panel.power_law(c, "lag", "v").select(R("exponent", 6).alias("exponent"), R("scale", 4).alias("scale"))


@query(f"with {EVENTS}, u as (select event_type, user_id, avg(value) as m, coalesce(var_samp(value), 0) as v from ev group by 1, 2), g as (select i from range(25) t(i)) select event_type, cast(i as bigint) as i, round(sum(case when v > 0 then exp(-pow(i * 100 / 24.0 - m, 2) / (2 * v)) / sqrt(2 * pi() * v) when round(m / (100 / 24.0)) = i then 24 / 100.0 else 0 end), 6) as density from u, g group by 1, 2")
def opinion_density(spark, d):
    u = read(spark, d, "events").groupBy("event_type", "user_id").agg(F.avg("value").alias("m"), F.coalesce(F.var_samp("value"), F.lit(0.0)).alias("v"))
    g = panel.gaussian_mixture_grid(u, ["event_type"], "m", "v", 0.0, 100.0, 25)
    return g.select("event_type", F.col("i").cast("bigint").alias("i"), R("density", 6).alias("density"))


@query(f"with {DAILY}, w as (select user_id, day // 7 as week, avg(x) as x from daily group by 1, 2) select user_id, round(max(x) - min(x), 6) as range, arg_min(week, (x, week)) as low_at, arg_max(week, (x, week)) as high_at from w group by 1")
def largest_move(spark, d):
    w = daily(spark, d).groupBy("user_id", F.floor(F.col("day") / 7).alias("week")).agg(F.avg("x").alias("x"))
    return panel.largest_move(w, "user_id", "week", "x").withColumn("range", R("range", 6))


@query("with s as (select o_custkey, cast(o_orderdate as date) as day, arg_max(o_totalprice, o_orderkey) as price from orders group by 1, 2), b as (select o_custkey, min(day) as lo, max(day) as hi from s group by 1), m as (select o_custkey, cast(unnest(generate_series(date_trunc('month', lo), hi, interval 1 month)) as date) as month, lo from b) select m.o_custkey, cast(m.month as varchar) as month, (select arg_max(price, day) from s where s.o_custkey = m.o_custkey and s.day <= m.month) as price from m where m.month >= m.lo")
def monthly_snapshots(spark, d):
    s = read(spark, d, "orders").groupBy("o_custkey", F.col("o_orderdate").cast("date").alias("day")).agg(F.max_by("o_totalprice", "o_orderkey").alias("price"))
    return panel.monthly_snapshots(s, "o_custkey", "day", "price").select("o_custkey", F.col("month").cast("string").alias("month"), "price")


@query()
def hidden_chain(spark, d):
    e = read(spark, d, "events").withColumn("s", (_stance() + 1).cast("int"))
    start, move, emit = panel.hidden_chain(e, "user_id", ["ts", "event_id"], "s", 3, passes=1000, tolerance=1e-7)
    rows = [(i, j, float(move[i, j])) for i in range(2) for j in range(2)]
    return spark.createDataFrame(rows, "before int, after int, p double")


@query()
def factor_model(spark, d):
    c = read(spark, d, "cells").where("trim(SeedName) <> '' and target is not null").groupBy("SeedName", "target").agg(F.sum("n").alias("n"), (F.sum("s_sum") / F.sum("n")).alias("y"))
    return panel.factor_model(c, "SeedName", "target", "y", "n", passes=1000, tolerance=1e-4)[1]


@query()
def blake_split(spark, d):
    return read(spark, d, "customer").select("c_custkey", panel.blake_unit(F.col("c_custkey"), 42).alias("u"))


@query(r"with a as (select doc_id, text, regexp_replace('Sure, here is it: \"' || text || '\"', '^\s*(?i:sure|here is|here''s|translation|answer)[^:\n]*:\s*', '') as c from documents), b as (select *, regexp_replace(trim(regexp_extract(c, '^([^\n]*)', 1), ' \"''“”‘’.`*'), '^(?i:the|a|an)\s+', '') as r from a) select doc_id, case when len(regexp_extract_all(text, '\S+')) > 30 then regexp_extract(text, '^(\s*(?:\S+\s+){29}\S+)', 1) else text end as cut, case when not (regexp_matches(r, '(?i)\b(?:i cannot|i can''t|as an ai|language model|sorry)\b') or length(r) > 3 * length(text) + 40 or r = '') then r end as reply from b")
def budget_cut(spark, d):
    t = F.col("text")
    return read(spark, d, "documents").select("doc_id", panel.token_cut(t, 30).alias("cut"), panel.clean_reply(F.concat(F.lit("Sure, here is it: \""), t, F.lit("\"")), t).alias("reply"))


@query()
def imputed_cells(spark, d):
    c = read(spark, d, "cells").where("trim(SeedName) <> '' and target is not null").groupBy("SeedName", "target").agg(F.sum("n").alias("n"), (F.sum("s_sum") / F.sum("n")).alias("y"))
    return panel.imputed(c, "SeedName", "target", "y", "n", passes=1000, tolerance=1e-4)


def _probit_sql() -> str:
    z = lambda c, sign: f"({sign}{c} - level) / 1.4142135623730951"
    cdf = lambda c, sign: f"0.5 * {erfc_sql('(-' + z(c, sign) + ')')}"
    one = lambda c: f"select {c} as threshold, round(sum(ag * ln(greatest({cdf(c, '-')}, 1e-12)) + ne * ln(greatest({cdf(c, '')} - {cdf(c, '-')}, 1e-12)) + fa * ln(greatest(1 - {cdf(c, '')}, 1e-12))), 3) as loglik from c"
    return "with c as (select s_sum / n as level, (s2_sum - s_sum) / 2 as ag, n - s2_sum as ne, (s2_sum + s_sum) / 2 as fa from cells where n > 0 and s_sum is not null) " + " union all ".join(one(c) for c in ("0.25::double", "0.5::double", "1.0::double"))


@query(_probit_sql())
def probit_thresholds(spark, d):
    from tallgrass.operators.aggregates import label_counts

    c = read(spark, d, "cells").where("n > 0").select("s_sum", "s2_sum", F.col("n").cast("double").alias("n"))
    rows = label_counts(c).withColumn("level", F.col("s_sum") / F.col("n"))
    return panel.probit_fit(rows, "level", "n_against", "n_neutral", "n_favor", [0.25, 0.5, 1.0]).withColumn("loglik", R("loglik", 3))


@query()
def chosen_eps(spark, d):
    from tallgrass.operators.clusters import EPS_GRID, eps_by_labels

    return eps_by_labels(read(spark, d, "embeddings"), "vec_id", "embedding", "label", EPS_GRID)
