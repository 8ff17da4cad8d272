"""Scans, projections, joins and set operations on the test tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallgrass.operators import joins
from tallgrass.plans.register import catalogue
from tallgrass.plans.tables import DAILY, EVENTS, daily, events, read

QUERIES, SQL, query = catalogue()
MOST_CENTRES = 200  # centres become constants of the plan


@query("select l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) as net from lineitem where l_shipdate >= timestamp '1996-01-01' and l_discount between 0.05 and 0.07 and l_quantity < 24")
def scan_project_filter(spark, d):
    l = read(spark, d, "lineitem").where("l_shipdate >= timestamp_ntz'1996-01-01' and l_discount between 0.05 and 0.07 and l_quantity < 24")
    return l.select("l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).alias("net"))


@query("select c_custkey, case when c_acctbal < 0 then 'debt' when c_acctbal < 5000 then 'small' else 'large' end as class, coalesce(nullif(trim(c_mktsegment), ''), 'none') as segment from customer")
def conditional_columns(spark, d):
    size = F.when(F.col("c_acctbal") < 0, "debt").when(F.col("c_acctbal") < 5000, "small").otherwise("large")
    return read(spark, d, "customer").select("c_custkey", size.alias("class"), F.coalesce(F.nullif(F.trim("c_mktsegment"), F.lit("")), F.lit("none")).alias("segment"))


@query("select platform, count(*) as posts from doc_targets where seed.MainType in ('politician', 'influencer') or (seed.MainType = 'foreign' and seed.SubType not in ('media', 'state')) group by 1")
def actor_filter(spark, d):
    from tallgrass.functions.posts import tracked_actor

    return read(spark, d, "doc_targets").where(tracked_actor()).groupBy("platform").agg(F.count("*").alias("posts"))


@query("select 'documents' as origin, source, cast(n_chars as double) as size, lang, null as target from documents union all select 'items', null, cast(length(text) as double), null, target from eval_items")
def union_diagonal(spark, d):
    a = read(spark, d, "documents").select(F.lit("documents").alias("origin"), "source", F.col("n_chars").alias("size"), "lang")
    b = read(spark, d, "eval_items").select(F.lit("items").alias("origin"), F.length("text").cast("double").alias("size"), "target")
    return joins.union_all_columns(a, b)


@query("select user_id, event_type, event_id, value from (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as r from events) where r = 1")
def dedupe_latest(spark, d):
    w = Window.partitionBy("user_id", "event_type").orderBy(F.desc("ts"), F.desc("event_id"))
    return read(spark, d, "events").withColumn("_r", F.row_number().over(w)).where("_r = 1").select("user_id", "event_type", "event_id", "value")


@query("select o_orderpriority, count(*) as lines, cast(sum(l_quantity) as bigint) as quantity from orders join lineitem on o_orderkey = l_orderkey group by 1")
def join_inner(spark, d):
    j = read(spark, d, "orders").join(read(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return j.groupBy("o_orderpriority").agg(F.count("*").alias("lines"), F.sum("l_quantity").cast("bigint").alias("quantity"))


@query("select p_brand, s_nationkey, count(*) as lines from lineitem join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey where p_size > 25 group by 1, 2")
def join_star(spark, d):
    l = read(spark, d, "lineitem").select("l_partkey", "l_suppkey")
    p = read(spark, d, "part").where("p_size > 25").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    s = read(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    return l.join(p, "l_partkey").join(s, "l_suppkey").groupBy("p_brand", "s_nationkey").agg(F.count("*").alias("lines"))


@query("select c_custkey, count(o_orderkey) as orders, round(coalesce(sum(o_totalprice), 0), 2) as total from customer left join orders on c_custkey = o_custkey group by 1")
def join_left(spark, d):
    o = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("_n"), F.sum("o_totalprice").alias("_t"))
    j = read(spark, d, "customer").select("c_custkey").join(o, "c_custkey", "left")
    return j.select("c_custkey", F.coalesce("_n", F.lit(0)).alias("orders"), F.round(F.coalesce("_t", F.lit(0.0)), 2).alias("total"))


@query("select c_custkey, c_name from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 200000)")
def join_semi(spark, d):
    big = read(spark, d, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return read(spark, d, "customer").select("c_custkey", "c_name").join(big, "c_custkey", "left_semi")


@query("select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P')")
def join_anti(spark, d):
    return read(spark, d, "customer").select("c_custkey").join(read(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query(f"with {EVENTS}, a as (select user_id, count(*) as early from ev where day < 19737 group by 1), b as (select user_id, count(*) as late from ev where day >= 19737 group by 1) select coalesce(a.user_id, b.user_id) as user_id, coalesce(early, 0) as early, coalesce(late, 0) as late from a full join b on a.user_id = b.user_id")
def join_full(spark, d):
    e = events(spark, d)
    side = lambda c, name: e.where(c).groupBy("user_id").agg(F.count("*").alias(name))
    return side("day < 19737", "early").join(side("day >= 19737", "late"), "user_id", "full").na.fill(0, ["early", "late"])


@query("select id, platform, count(*) as readings from (select c.post_id as id, lower(trim(c.platform)) as platform from coded_pairs c) x where exists (select 1 from doc_targets t where t.id = x.id and t.platform = x.platform) group by 1, 2")
def join_composite_key(spark, d):
    c = read(spark, d, "coded_pairs").select(F.col("post_id").alias("id"), F.lower(F.trim("platform")).alias("platform"))
    posts = read(spark, d, "doc_targets").select("id", "platform")
    return c.groupBy("id", "platform").agg(F.count("*").alias("readings")).join(posts, ["id", "platform"], "left_semi")


@query(f"with {EVENTS} select a.event_id, b.event_id as parent_id, b.event_type as parent_type from ev a left join ev b on b.event_id = a.event_id - 1 and b.user_id = a.user_id")
def self_join_parent(spark, d):
    e = read(spark, d, "events").select("event_id", "user_id", "event_type")
    parent = e.select((F.col("event_id") + 1).alias("event_id"), "user_id", F.col("event_id").alias("parent_id"), F.col("event_type").alias("parent_type"))
    return e.select("event_id", "user_id").join(parent, ["event_id", "user_id"], "left").select("event_id", "parent_id", "parent_type")


@query(f"with {EVENTS}, spans as (select user_id, min(us) as lo, min(us) + 5 * 86400000000 as hi from ev where event_type = 'purchase' group by 1) select e.user_id, count(*) as inside, min(e.event_id) as first_id from ev e join spans s on e.user_id = s.user_id and e.us between s.lo and s.hi group by 1")
def range_join_span(spark, d):
    e = events(spark, d)
    spans = e.where("event_type = 'purchase'").groupBy("user_id").agg(F.min("us").alias("lo"), (F.min("us") + 5 * 86_400_000_000).alias("hi"))
    j = joins.spans_containing(e.select("user_id", "us", "event_id"), spans, "user_id", "us", "lo", "hi")
    return j.groupBy("user_id").agg(F.count("*").alias("inside"), F.min("event_id").alias("first_id"))


@query(f"with {DAILY} select b.day - a.day as lag, count(*) as pairs, round(avg((b.x - a.x) * (b.x - a.x)), 6) as msd from daily a join daily b on a.user_id = b.user_id and b.day - a.day between 1 and 10 group by 1")
def lag_self_join(spark, d):
    pairs = joins.lag_pairs(daily(spark, d), ["user_id"], "day", 10, ["x"])
    return pairs.groupBy("lag").agg(F.count("*").alias("pairs"), F.round(F.avg(F.pow(F.col("x_b") - F.col("x_a"), 2)), 6).alias("msd"))


@query(f"with {DAILY} select a.user_id, a.day, (select min(b.day) from daily b where b.user_id = a.user_id and b.day >= a.day + 7) as next_day, round((select arg_min(b.x, b.day) from daily b where b.user_id = a.user_id and b.day >= a.day + 7), 6) as next_x from daily a where exists (select 1 from daily b where b.user_id = a.user_id and b.day >= a.day + 7)")
def asof_forward(spark, d):
    hit = joins.first_at_or_after(daily(spark, d), "user_id", "day", 7, ["x"])
    return hit.select("user_id", "day", "next_day", F.round("next_x", 6).alias("next_x"))


@query("with p as (select vec_id, cast(embedding[1] as double) as x, cast(embedding[2] as double) as y from embeddings) select a.vec_id as a, count(*) as neighbours from p a join p b on a.vec_id <> b.vec_id and sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 0.05 group by 1")
def radius_neighbours(spark, d):
    p = read(spark, d, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return joins.within_radius(p, "vec_id", "x", "y", 0.05).groupBy("a").agg(F.count("*").alias("neighbours"))


def _nearest(e, built):
    """vec_id, centre and distance of the nearest label mean, of the labels that ``built`` keeps."""
    means = e.where(built).select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", "i").agg(F.avg("v").alias("m"))
    table = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("c")).select("label", "c.m").limit(MOST_CENTRES + 1).collect()
    if len(table) > MOST_CENTRES:
        raise ValueError(f"more than {MOST_CENTRES} labels")
    found = joins.nearest_centre(e.withColumn("v", F.col("embedding").cast("array<double>")), "v", [(r["label"], r["m"]) for r in table])
    return found.select("vec_id", F.col("centre").alias("centre"), F.round("distance", 4).alias("distance"))


@query("with u as (select label, i, avg(v) as m from (select label, unnest(embedding) as v, generate_subscripts(embedding, 1) as i from embeddings) where label is not null group by 1, 2), c as (select label, list(m order by i) as centre from u group by 1), d as (select e.vec_id, c.label as centre, list_sum(list_transform(list_zip(e.embedding, c.centre), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) as sq from embeddings e cross join c) select vec_id, arg_min(centre, sq) as centre, round(sqrt(min(sq)), 4) as distance from d group by 1")
def nearest_centroid_all(spark, d):
    return _nearest(read(spark, d, "embeddings"), F.col("label").isNotNull())


@query("with g as (select distinct n_name, n_regionkey from nation) select a.n_name as a, b.n_name as b from g a join g b on a.n_regionkey = b.n_regionkey and a.n_name < b.n_name")
def unordered_pairs(spark, d):
    n = read(spark, d, "nation").select("n_name", "n_regionkey").distinct()
    return n.select(F.col("n_name").alias("a"), "n_regionkey").join(n.select(F.col("n_name").alias("b"), "n_regionkey"), "n_regionkey").where("a < b").select("a", "b")


@query(f"with {DAILY}, s as (select user_id, min(day) as lo, max(day) as hi from daily group by 1), days as (select user_id, unnest(generate_series(lo, hi)) as day from s) select d.user_id, d.day, coalesce(n, 0) as n from days d left join daily x on d.user_id = x.user_id and d.day = x.day")
def calendar_spine(spark, d):
    return joins.daily_spine(daily(spark, d).select("user_id", "day", "n"), ["user_id"], "day", ["n"])


@query("select event_id, case event_type when 'purchase' then 1 when 'error' then -1 else 0 end as stance from events")
def recode_map(spark, d):
    return read(spark, d, "events").select("event_id", joins.recode("event_type", {"purchase": 1, "error": -1}, F.lit(0)).alias("stance"))


@query("select c_custkey, exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P') as pending from customer")
def presence_flag(spark, d):
    pending = read(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return joins.with_flag(read(spark, d, "customer").select("c_custkey"), pending, ["c_custkey"], "pending")


@query("select user_id as id from events where event_type = 'signup' intersect select user_id from events where event_type = 'error'")
def set_intersection(spark, d):
    e = read(spark, d, "events").select(F.col("user_id").alias("id"), "event_type")
    return joins.shared_keys(e.where("event_type = 'signup'"), e.where("event_type = 'error'"), "id")


@query(f"with {EVENTS} select distinct user_id as id from ev where event_type = 'signup' and day < 19730 and user_id not in (select user_id from ev where event_type = 'error' and day < 19730)")
def set_difference(spark, d):
    e = events(spark, d).where("day < 19730").select(F.col("user_id").alias("id"), "event_type")
    return e.where("event_type = 'signup'").select("id").distinct().join(e.where("event_type = 'error'").select("id"), "id", "left_anti")


@query("select distinct platform, seed.MainType as main_type, seed.SubType as sub_type from doc_targets")
def distinct_rows(spark, d):
    return read(spark, d, "doc_targets").select("platform", F.col("seed.MainType").alias("main_type"), F.col("seed.SubType").alias("sub_type")).distinct()


@query("with a as (select distinct id, platform, Document, ParentDocument, finetune_kwargs.model_path as m from doc_targets), b as (select id, platform, Document, ParentDocument, finetune_kwargs.model_path as m, min(length(Document)) as size from doc_targets group by all) select a.id, a.platform, count(*) as n, count(b.size) as reused from a left join b on a.id = b.id and a.platform = b.platform and a.Document is not distinct from b.Document and a.ParentDocument is not distinct from b.ParentDocument and a.m is not distinct from b.m group by 1, 2")
def reuse_earlier(spark, d):
    t = read(spark, d, "doc_targets").select("id", "platform", "Document", "ParentDocument", F.col("finetune_kwargs.model_path").alias("m"))
    before = t.groupBy(*t.columns).agg(F.min(F.length("Document")).alias("size"))
    same = joins.reuse_earlier(t.distinct(), before, ["id", "platform"], ["Document", "ParentDocument", "m"], "size")
    return same.groupBy("id", "platform").agg(F.count("*").alias("n"), F.count("size").alias("reused"))


@query("select id, platform, t as target, pos from (select id, platform, unnest(Targets) as t, generate_subscripts(Targets, 1) as pos from (select distinct id, platform, Targets from doc_targets))")
def explode_lists(spark, d):
    t = read(spark, d, "doc_targets").select("id", "platform", "Targets").distinct()
    both = joins.explode_together(t.withColumn("pos", F.transform("Targets", lambda _, i: i + 1)), ["Targets", "pos"], ["id", "platform"])
    return both.where("pos is not null").select("id", "platform", F.col("Targets").alias("target"), F.col("pos").cast("bigint").alias("pos"))


@query("select event_id, json_extract_string(props, '$.' || k) as v, k from (select event_id, props, unnest(json_keys(props)) as k from events)")
def json_props(spark, d):
    e = read(spark, d, "events").select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("k", "v"))
    return e.select("event_id", "v", "k")


@query("select platform, list(x order by x) as targets from (select distinct platform, unnest(Targets) as x from doc_targets) where x is not null group by 1")
def list_regroup(spark, d):
    t = read(spark, d, "doc_targets").select("platform", F.explode("Targets").alias("t")).where("t is not null")
    return t.groupBy("platform").agg(F.array_sort(F.collect_set("t")).alias("targets"))
