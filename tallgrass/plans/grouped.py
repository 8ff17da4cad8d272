"""Aggregations, windows, ranking and sampling on the test tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallgrass.functions import time
from tallgrass.operators import aggregates, sampling, statistics, trajectories, windows
from tallgrass.plans.register import catalogue
from tallgrass.plans.tables import DAILY, EVENTS, daily, events, read

QUERIES, SQL, query = catalogue()
R = F.round


@query("select l_returnflag, l_linestatus, cast(sum(l_quantity) as bigint) as sum_qty, round(sum(l_extendedprice), 2) as sum_base, round(sum(l_extendedprice * (1 - l_discount)), 4) as sum_disc, round(avg(l_quantity), 6) as avg_qty, round(stddev_samp(l_quantity), 6) as sd_qty, round(median(l_quantity), 4) as med_qty, count(distinct l_suppkey) as suppliers, count(*) as lines from lineitem where l_shipdate <= timestamp '1998-09-01' group by 1, 2")
def group_multi_metric(spark, d):
    l = read(spark, d, "lineitem").where("l_shipdate <= timestamp_ntz'1998-09-01'")
    return l.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").cast("bigint").alias("sum_qty"), R(F.sum("l_extendedprice"), 2).alias("sum_base"),
        R(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4).alias("sum_disc"), R(F.avg("l_quantity"), 6).alias("avg_qty"),
        R(F.stddev_samp("l_quantity"), 6).alias("sd_qty"), R(F.median("l_quantity"), 4).alias("med_qty"), F.countDistinct("l_suppkey").alias("suppliers"), F.count("*").alias("lines"),
    )


@query("select event_type, round(quantile_cont(value, 0.1), 6) as p10, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.9), 6) as p90 from events group by 1")
def quantiles(spark, d):
    q = F.percentile("value", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    return read(spark, d, "events").groupBy("event_type").agg(q.alias("q")).select("event_type", *[R(F.col("q")[i], 6).alias(n) for i, n in enumerate(("p10", "p50", "p90"))])


@query("select user_id, arg_min(event_id, (ts, event_id)) as first_id, arg_max(event_id, (ts, event_id)) as last_id, count(distinct event_type) as types from events group by 1")
def first_last(spark, d):
    at = F.struct("ts", "event_id")
    return read(spark, d, "events").groupBy("user_id").agg(F.min_by("event_id", at).alias("first_id"), F.max_by("event_id", at).alias("last_id"), F.countDistinct("event_type").alias("types"))


@query("select user_id, list(event_type order by ts, event_id) as path from events where event_type in ('signup', 'purchase', 'error') group by 1")
def ordered_list(spark, d):
    e = read(spark, d, "events").where(F.col("event_type").isin("signup", "purchase", "error"))
    return e.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("_l")).select("user_id", F.transform("_l", lambda x: x["event_type"]).alias("path"))


@query("with c as (select source, lang, count(*) as n from (select lower(trim(source)) as source, lang from documents where lang is not null) group by 1, 2) select source, lang, n from (select *, row_number() over (partition by source order by n desc, lang) as r from c) where r = 1")
def top_value_per_group(spark, d):
    docs = read(spark, d, "documents").select(F.lower(F.trim("source")).alias("source"), "lang")
    return aggregates.top_value(docs, ["source"], "lang")


@query("select user_id, round(avg(case when event_type = 'error' then 1.0 else 0.0 end), 6) as error_share, count(*) filter (where value > 50) as high, cast(sum(case when event_type = 'purchase' then 1 else 0 end) as bigint) as purchases from events group by 1 having count(*) >= 20")
def conditional_counts(spark, d):
    g = read(spark, d, "events").groupBy("user_id").agg(
        F.count("*").alias("_n"), R(F.avg((F.col("event_type") == "error").cast("double")), 6).alias("error_share"), F.count_if(F.col("value") > 50).alias("high"), F.count_if(F.col("event_type") == "purchase").alias("purchases")
    )
    return g.where("_n >= 20").drop("_n")


@query("select case when grouping(c_mktsegment) = 0 then 'segment' when grouping(o_orderpriority) = 0 then 'priority' end as label, coalesce(c_mktsegment, o_orderpriority) as value, count(*) as orders, round(avg(o_totalprice), 4) as mean from orders join customer on o_custkey = c_custkey group by grouping sets ((), (c_mktsegment), (o_orderpriority))")
def grouping_sets_breakdown(spark, d):
    o = read(spark, d, "orders").join(read(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("segment")), "o_custkey").withColumnRenamed("o_orderpriority", "priority")
    return aggregates.breakdown(o, ["segment", "priority"], [F.count("*").alias("orders"), R(F.avg("o_totalprice"), 4).alias("mean")])


@query("select user_id, count(*) filter (where event_type = 'view') as view, count(*) filter (where event_type = 'click') as click, count(*) filter (where event_type = 'purchase') as purchase from events group by 1")
def pivot_counts(spark, d):
    return read(spark, d, "events").groupBy("user_id").pivot("event_type", ["view", "click", "purchase"]).agg(F.count("event_id")).na.fill(0)


STANCE = "case when value > 60 then 1 when value < 30 then -1 else 0 end"


def _stance():
    return F.when(F.col("value") > 60, 1).when(F.col("value") < 30, -1).otherwise(0)


@query(f"with {EVENTS} select user_id, event_type, us - us % 172800000000 as bin, count(*) as n, cast(sum({STANCE}) as bigint) as s_sum, cast(sum(({STANCE}) * ({STANCE})) as bigint) as s2_sum from ev group by 1, 2, 3")
def moments_cells(spark, d):
    e = events(spark, d).withColumn("bin", time.bin_start(F.col("us"), 2))
    return aggregates.moment_cells(e, ["user_id", "event_type", "bin"], _stance())


@query(f"with {EVENTS} select event_type, day // 8 as bin, cast(sum({STANCE} = 1) as bigint) as n_favor, cast(sum({STANCE} = -1) as bigint) as n_against, cast(sum({STANCE} = 0) as bigint) as n_neutral from ev group by 1, 2")
def moments_to_counts(spark, d):
    e = events(spark, d)
    fine = aggregates.moment_cells(e, ["event_type", "day"], _stance())
    coarse = aggregates.merged_cells(fine.withColumn("bin", F.floor(F.col("day") / 8)), ["event_type", "bin"], ["n", "s_sum", "s2_sum"])
    return aggregates.label_counts(coarse).select("event_type", "bin", *[F.col(c).cast("bigint").alias(c) for c in ("n_favor", "n_against", "n_neutral")])


@query("with m as (select SeedName, target, bin, sum(n) as n, sum(s_sum) as s from cells where SeedName is not null and trim(SeedName) <> '' and target is not null group by 1, 2, 3), b as (select SeedName, target, epoch_us(bin) // (86400000000 * 8) as bin, sum(n) as n, sum(s) as s from m group by 1, 2, 3), v as (select target from b group by 1 having sum(n) >= 1000) select dense_rank() over (order by target) - 1 as target_no, count(*) as cells, cast(sum(n) as bigint) as posts, round(sum(n / (1 + (n - 1) * 0.1)), 4) as effective from b semi join v using (target) group by target")
def cells_rebin(spark, d):
    c = read(spark, d, "cells").where("trim(SeedName) <> '' and target is not null").withColumn("us", time.micros("bin"))
    coarse = aggregates.merged_cells(c.withColumn("bin8", F.floor(F.col("us") / (86_400_000_000 * 8))), ["SeedName", "target", "bin8"], ["n", "s_sum"])
    big = coarse.groupBy("target").agg(F.sum("n").alias("_v")).where("_v >= 1000").select("target")
    kept = aggregates.dense_index(coarse.join(big, "target", "left_semi"), "target", "target_no")
    eff = aggregates.deflated(F.col("n").cast("double"), 0.1)
    return kept.groupBy(F.col("target_no").cast("bigint").alias("target_no")).agg(F.count("*").alias("cells"), F.sum("n").alias("posts"), R(F.sum(eff), 4).alias("effective"))


def _lattice_sql(fine: int, coarse: int) -> str:
    points = lambda r: [(i, j, r - i - j) for i in range(r + 1) for j in range(r + 1 - i)]
    far = lambda p, t: sum((coarse * a - fine * b) ** 2 for a, b in zip(p, t))
    near = [min(range(len(points(coarse))), key=lambda t: (far(p, points(coarse)[t]), t)) for p in points(fine)]
    sums = ["sum(" + " + ".join(f"coalesce(q{i}, 0)" for i, t in enumerate(near) if t == k) + f") as q{k}" for k in range(len(points(coarse)))]
    return f"select target, {', '.join(sums)} from cells group by 1"


@query(_lattice_sql(6, 2))
def lattice_coarse(spark, d):
    return aggregates.coarse_lattice(read(spark, d, "cells"), ["target"], 6, 2)


@query(f"with {EVENTS} select user_id, us - us % 172800000000 as bin, count(*) as n, round(avg(value), 6) as mean from ev group by 1, 2")
def tumbling_2d(spark, d):
    return events(spark, d).groupBy("user_id", time.bin_start(F.col("us"), 2).alias("bin")).agg(F.count("*").alias("n"), R(F.avg("value"), 6).alias("mean"))


@query("select event_type, cast(date_trunc('week', ts) as varchar)[1:10] as week, count(*) as n from events group by 1, 2")
def tumbling_1w(spark, d):
    return events(spark, d).groupBy("event_type", time.day_text(time.week_start(F.col("us"))).alias("week")).agg(F.count("*").alias("n"))


@query("with v as (select event_type, var_samp(value) as v, count(value) as n from events group by event_type, user_id having count(value) > 1) select round(sum(v * (n - 1)) / sum(n - 1), 6) as pooled, cast(sum(n) as bigint) as values from v")
def pooled_variance(spark, d):
    return aggregates.pooled_variance(read(spark, d, "events"), ["event_type", "user_id"], "value").select(R("pooled", 6).alias("pooled"), "values")


@query("select s, lang, n, round(100.0 * n / sum(n) over (partition by s), 6) as percent from (select lower(trim(source)) as s, lang, count(*) as n from documents group by 1, 2)")
def share_of_total(spark, d):
    docs = read(spark, d, "documents").select(F.lower(F.trim("source")).alias("s"), "lang")
    return aggregates.shares(docs, ["s", "lang"], ["s"]).withColumn("percent", R("percent", 6))


@query("select c_nationkey, round(sum(c_acctbal * o.n) / sum(o.n), 6) as weighted from customer join (select o_custkey, count(*) as n from orders group by 1) o on o_custkey = c_custkey group by 1")
def weighted_average(spark, d):
    o = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    j = read(spark, d, "customer").join(o, "c_custkey")
    return j.groupBy("c_nationkey").agg(R(aggregates.weighted_mean(F.col("c_acctbal"), F.col("n")), 6).alias("weighted"))


@query("select id, platform, count(*) as n from doc_targets group by 1, 2 having count(*) > 1")
def duplicate_keys(spark, d):
    return aggregates.duplicated(read(spark, d, "doc_targets"), ["id", "platform"])


@query(f"with {EVENTS} select event_id, round(avg(value) over (partition by user_id order by us range between 604799999999 preceding and current row), 6) as mean from ev")
def rolling_mean_7d(spark, d):
    m = windows.trailing_mean(F.col("value"), "user_id", "us", 7 * 86_400_000_000)
    return events(spark, d).select("event_id", R(m, 6).alias("mean"))


@query(f"with {DAILY} select user_id, day, round(avg(x) over w5, 6) as loose, case when count(x) over w5 >= 5 then round(avg(x) over w5, 6) end as full_mean from daily window w5 as (partition by user_id order by day rows between 4 preceding and current row)")
def rolling_rows(spark, d):
    m = lambda least: R(windows.row_mean(F.col("x"), "user_id", ["day"], 5, least), 6)
    return daily(spark, d).select("user_id", "day", m(1).alias("loose"), m(5).alias("full_mean"))


@query(f"with {DAILY}, s as (select user_id, day, greatest(-1, least(1, (x - 50) / 50)) as y from daily), b as (select *, avg(y) over w as m, coalesce(stddev_samp(y) over w, 0) as sd from s window w as (partition by user_id order by day rows between 3 preceding and 3 following)) select user_id, day, round(greatest(-1, least(1, m)), 6) as mean, round(greatest(-1, least(1, m - 1.96 * sd)), 6) as lower, round(greatest(-1, least(1, m + 1.96 * sd)), 6) as upper from b")
def rolling_center_band(spark, d):
    s = daily(spark, d).select("user_id", "day", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.col("x") - 50) / 50)).alias("y"))
    b = windows.centred_band(s, "y", "user_id", ["day"], 7)
    return b.select("user_id", "day", *[R(c, 6).alias(c) for c in ("mean", "lower", "upper")])


@query("with n as (select event_id, user_id, ts, case when event_id % 3 = 0 then value end as v from events) select event_id, coalesce(first_value(v ignore nulls) over (partition by user_id order by ts, event_id rows between current row and unbounded following), last_value(v ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row)) as v from n")
def fill_back_forward(spark, d):
    n = read(spark, d, "events").withColumn("v", F.expr("case when event_id % 3 = 0 then value end"))
    return n.select("event_id", windows.filled("v", "user_id", ["ts", "event_id"]).alias("v"))


@query("with c as (select user_id, event_id, ts, event_type, case when lag(event_type) over (partition by user_id order by ts, event_id) is distinct from event_type then 1 else 0 end as new from events), t as (select *, sum(new) over (partition by user_id order by ts, event_id rows unbounded preceding) as run from c) select user_id, cast(run as bigint) as run, min(event_type) as event_type, count(*) as n, string_agg(cast(event_id as varchar), ' ' order by ts, event_id) as ids from t group by 1, 2")
def speaker_turns(spark, d):
    e = read(spark, d, "events").withColumn("run", windows.run_number(F.col("event_type"), "user_id", ["ts", "event_id"]))
    ids = F.array_sort(F.collect_list(F.struct("ts", "event_id")))
    return e.groupBy("user_id", "run").agg(F.min("event_type").alias("event_type"), F.count("*").alias("n"), F.array_join(F.transform(ids, lambda x: x["event_id"].cast("string")), " ").alias("ids"))


@query(f"with {EVENTS} select user_id, count(*) filter (where us * 2 < lo + hi) as early, count(*) filter (where us * 2 >= lo + hi) as late from (select *, min(us) over (partition by user_id) as lo, max(us) over (partition by user_id) as hi from ev) group by 1")
def early_late_halves(spark, d):
    e = events(spark, d).withColumn("early", windows.early_half("user_id", "us"))
    return e.groupBy("user_id").agg(F.count_if("early").alias("early"), F.count_if(~F.col("early")).alias("late"))


@query("with v as (select user_id, sum(value) as volume from events group by 1), r as (select *, row_number() over (order by volume desc, user_id) as r, percent_rank() over (order by volume) as p from v) select user_id, round(p, 6) as p from r where r % 5 = 0")
def systematic_sample(spark, d):
    v = read(spark, d, "events").groupBy("user_id").agg(F.sum("value").alias("volume"))
    placed = sampling.every_nth(v, [F.desc("volume"), "user_id"], 5)
    below = statistics.share_below(v, "volume")
    return placed.join(below, "volume").select("user_id", R("below", 6).alias("p"))


@query(f"with {DAILY} select user_id, day, round(x - sum(x * n) over (partition by day) / sum(n) over (partition by day), 6) as shift from daily")
def group_mean_removed(spark, d):
    return daily(spark, d).select("user_id", "day", R(windows.centred_on_group(F.col("x"), F.col("n"), "day"), 6).alias("shift"))


@query(f"with {DAILY} select a.user_id, a.day, round(b.x, 6) as x from (select user_id, day, row_number() over (partition by user_id order by day) as k from daily) a join (select user_id, x, row_number() over (partition by user_id order by sha256('11:' || user_id || '/' || day), day) as k from daily) b using (user_id, k)")
def permuted_within_account(spark, d):
    s = daily(spark, d).select("user_id", "day", "x")
    return trajectories.permuted(s, ["user_id"], "day", ["x"], sampling.hash_order(F.concat_ws("/", "user_id", "day"), 11)).select("user_id", "day", R("x", 6).alias("x"))


@query("select event_type, user_id, value from (select *, row_number() over (partition by event_type order by value desc, event_id) as r, count(*) over (partition by event_type) as n from events) where r <= greatest(1, floor(n * 0.01))")
def top_fraction(spark, d):
    return sampling.top_fraction(read(spark, d, "events"), ["event_type"], [F.desc("value"), F.col("event_id")], 0.01).select("event_type", "user_id", "value")


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 100")
def top_n(spark, d):
    return read(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100).select("o_orderkey", "o_totalprice")


@query("select doc_id, source from documents order by sha256('9:' || cast(doc_id as varchar)), doc_id limit 50")
def sample_by_hash(spark, d):
    return sampling.sample_rows(read(spark, d, "documents").select("doc_id", "source"), "doc_id", 50, 9)


@query()
def stratified_quota(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "lang", F.lower(F.trim("source")).alias("source"), "seed_name").where("lang is not null")
    return sampling.stratified(docs, ["lang", "source"], "doc_id", "seed_name", 200, 5)


@query("with p as (select distinct id, platform, unnest(Targets) as t from doc_targets), r as (select *, row_number() over (partition by id, platform order by sha256('3:' || t), t) as r, count(*) over (partition by id, platform) as n_post from p where t is not null) select id, platform, t, n_post, least(n_post, 2) as n_sampled, round(n_post / least(n_post, 2), 6) as weight from r where r <= 2")
def target_cap_weight(spark, d):
    p = read(spark, d, "doc_targets").select("id", "platform", F.explode("Targets").alias("t")).where("t is not null").distinct()
    return sampling.capped_targets(p, ["id", "platform"], "t", 2, 3).select("id", "platform", "t", "n_post", "n_sampled", R("weight", 6).alias("weight"))


@query("select lower(trim(platform)) as platform, round(pow(sum(pair_weight), 2) / sum(pair_weight * pair_weight), 4) as n_eff, count(*) as n from coded_pairs group by 1")
def kish_effective_size(spark, d):
    w = F.col("pair_weight")
    return read(spark, d, "coded_pairs").groupBy(F.lower(F.trim("platform")).alias("platform")).agg(R(sampling.effective_size(w), 4).alias("n_eff"), F.count("*").alias("n"))


@query("select (row_number() over (order by doc_id) - 1) % 4 as shard, doc_id from documents")
def round_robin_shards(spark, d):
    from tallgrass.operators.hot_keys import number_rows

    docs = read(spark, d, "documents").select("doc_id", F.lit("all").alias("k"))
    return number_rows(docs, ["k"], ["doc_id"]).select((F.col("_number") % 4).alias("shard"), "doc_id")
