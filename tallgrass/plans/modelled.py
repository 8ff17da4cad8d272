"""Models, reductions, clusters, sources and streams on the test tables."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from tallgrass.functions.time import micros
from tallgrass.operators import clusters, models, reduction
from tallgrass.plans.register import catalogue
from tallgrass.plans.tables import DAILY, EVENTS, daily, events, read
from tallgrass.sources import files, search_index
from tallgrass.staging import ensure_checkpoint_dir, settle
from tallgrass.streaming import streams

QUERIES, SQL, query = catalogue()
R = F.round


# the filter and the smoother of a random walk, one step of the recursion per state
def _filter_sql(scale: float, name: str = "f") -> str:
    ahead, r = f"({name}.p + {scale} * s.dt)", "400.0 / greatest(s.n, 1)"
    first = "100.0 / (100.0 + 400.0 / greatest(n, 1))"
    return f"{name}(user_id, i, day, m, p, am, ap) as (select user_id, i, day, {first} * x, (1 - {first}) * 100.0, 0.0::double, 100.0::double from seq where i = 1 union all select s.user_id, s.i, s.day, {name}.m + {ahead} / ({ahead} + {r}) * (s.x - {name}.m), (1 - {ahead} / ({ahead} + {r})) * {ahead}, {name}.m, {ahead} from {name} join seq s on s.user_id = {name}.user_id and s.i = {name}.i + 1)"


_SEQ = DAILY + ", seq as (select user_id, day, x::double as x, n, row_number() over (partition by user_id order by day) as i, day - lag(day) over (partition by user_id order by day) as dt from daily)"


@query(f"with recursive {_SEQ}, {_filter_sql(5.0)}, b(user_id, i, l, v) as (select user_id, i, m, p from f where i = (select max(i) from f g where g.user_id = f.user_id) union all select f.user_id, f.i, f.m + f.p / n.ap * (b.l - n.am), f.p + pow(f.p / n.ap, 2) * (b.v - n.ap) from b join f on f.user_id = b.user_id and f.i = b.i - 1 join f n on n.user_id = b.user_id and n.i = b.i) select f.user_id, f.day, round(f.m, 6) as causal, round(b.l, 6) as level, round(sqrt(greatest(b.v, 0)), 6) as sd from f join b using (user_id, i)")
def kalman_state(spark, d):
    t = models.latent_states(daily(spark, d), "user_id", "day", "x", "n", scale=5.0, noise=400.0)
    return t.select("user_id", "day", *[R(c, 6).alias(c) for c in ("causal", "level", "sd")])


@query(f"with recursive {_SEQ}, {_filter_sql(0.5, 'f1')}, {_filter_sql(5.0, 'f2')}, {_filter_sql(50.0, 'f3')}, e as (select 0.5::double as scale, * from f1 union all select 5.0, * from f2 union all select 50.0, * from f3) select scale, round(avg(pow(s.x - e.m, 2)), 4) as loss from e join seq s on s.user_id = e.user_id and s.i = e.i + 1 group by 1")
def prior_sweep(spark, d):
    return models.fit_prior_scale(daily(spark, d), "user_id", "day", "x", "n", [0.5, 5.0, 50.0], noise=400.0).withColumn("loss", R("loss", 4))


@query(f"with recursive {_SEQ}, g as (select a, b, p, row_number() over (order by a, b, p) as k from (values (0.2::double), (0.5), (0.8)) t(a), (values (0.05::double), (0.2)) u(b), (values (0.8::double), (0.9), (0.98)) w(p)), h(user_id, i, k, a, b, p, l, t, sse) as (select user_id, i, k, a, b, p, x, 0.0::double, 0.0::double from seq, g where i = 1 union all select h.user_id, s.i, k, a, b, p, l + p * t + a * (s.x - (l + p * t)), p * t + a * b * (s.x - (l + p * t)), sse + pow(s.x - (l + p * t), 2) from h join seq s on s.user_id = h.user_id and s.i = h.i + 1), z as (select user_id, max(i) as n, max(x) - min(x) as spread, arg_max(x, i) as last from seq group by 1 having max(i) >= 5), y as (select h.user_id, arg_min(l + t * (p + pow(p, 2) + pow(p, 3) + pow(p, 4) + pow(p, 5) + pow(p, 6) + pow(p, 7)), (sse, k)) as f from h join z on z.user_id = h.user_id and h.i = z.n group by 1) select user_id, round(case when abs(f - last) <= 10 * greatest(spread, 1e-12) then f else last end, 5) as forecast, round(last, 5) as last from y join z using (user_id)")
def damped_forecasts(spark, d):
    return models.forecasts(daily(spark, d), "user_id", "day", "x", 7).select("user_id", R("forecast", 5).alias("forecast"), R("last", 5).alias("last"))


@query()
def unit_root_tests(spark, d):
    return models.panel_tests(daily(spark, d), "user_id", "day", "x")


def _vectors(spark, d):
    return read(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


@query()
def pca_coords(spark, d):
    v = _vectors(spark, d)
    return v.select("vec_id", reduction.project(F.col("v"), reduction.principal(v, "v", 64, 3)).alias("coords"))


@query()
def pca_explained(spark, d):
    m = reduction.principal(_vectors(spark, d), "v", 64, 8)
    return spark.createDataFrame([(i, float(e)) for i, e in enumerate(m["explained"])], "dim int, explained double")


@query()
def slow_features(spark, d):
    s = read(spark, d, "target_df").where("trim(filter_value) <> '' and x0 is not null").withColumn("us", micros("createtime"))
    s = reduction.filled_with_means(s.select("filter_value", "us", "x0"), "x0", 4)
    m = reduction.slow_features(s, "filter_value", "us", "x0", 4, 2)
    return s.select("filter_value", "us", reduction.project(F.col("x0"), m).alias("slow"))


@query()
def lagged_correlations(spark, d):
    s = read(spark, d, "target_df").where("trim(filter_value) <> '' and x0 is not null").withColumn("us", micros("createtime"))
    s = reduction.filled_with_means(s.select("filter_value", "us", "x0"), "x0", 4)
    # a component is kept where its correlation over the lag is 0.6 or more
    rows = [(lag, i, float(v), bool(v >= 0.6)) for lag in (1, 5, 10, 50, 100, 500) for i, v in enumerate(reduction.lagged_correlations(s, "filter_value", "us", "x0", 4, lag))]
    return spark.createDataFrame(rows, "lag int, place int, correlation double, kept boolean")


@query("with recursive u as (select vec_id, embedding::double[] as v from embeddings), l as (select a.vec_id as a, b.vec_id as b from u a, u b where a.vec_id <> b.vec_id and list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)) >= 0.7), r(a, b) as (select vec_id, vec_id from u union select r.a, l.b from r join l on r.b = l.a) select a as vec_id, min(b) as cluster from r group by 1")
def density_groups(spark, d):
    return clusters.density_clusters(read(spark, d, "embeddings"), "vec_id", "embedding", 0.3)


@query()
def speaker_groups(spark, d):
    t = read(spark, d, "tiktok").select("video_id", F.col("seed.Handle").alias("account"), F.explode("speaker_embeddings").alias("e")).select(F.concat_ws("-", "video_id", "e.speaker_index").alias("speaker"), "video_id", "account", "e.embedding").dropDuplicates(["speaker"])
    authors = read(spark, d, "speaker_author").where("is_author").select(F.concat_ws("-", "video_id", "speaker_index").alias("speaker")).distinct()
    others = read(spark, d, "speaker_author").select(F.concat_ws("-", "video_id", "speaker_index").alias("speaker")).distinct()
    t = t.join(others.withColumn("listed", F.lit(True)), "speaker", "left").join(authors.withColumn("_author", F.lit(True)), "speaker", "left")
    t = settle(t.select("speaker", "video_id", "account", "embedding", F.coalesce("listed", F.lit(False)).alias("listed"), F.when(F.col("_author"), F.col("account")).alias("person")))
    found = settle(clusters.cluster_levels(t, "speaker", "embedding", clusters.EPS_GRID, "listed"))
    eps = clusters.best_eps(clusters.label_scores(found.where("listed"), "known_clusters", "person", clusters.EPS_GRID))
    found = found.withColumn("_c", F.col("clusters")[clusters.EPS_GRID.index(eps)])
    found = found.join(found.groupBy("_c").agg(F.min("speaker").alias("cluster")), "_c")
    return clusters.author_clusters(found, "account", "video_id", "cluster")


_NEAR = r"w as (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from documents where text is not null), sh as (select doc_id, case when len(w) < 5 then [array_to_string(w, ' ')] else list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) end as s from w where len(w) > 0), k as (select s, min(doc_id) as rep, len(s) as n from sh group by 1), x as (select rep, n, unnest(s) as g from k), c as (select a.rep as a, b.rep as b, any_value(a.n) as na, any_value(b.n) as nb, count(*) as c from x a join x b using (g) where a.rep <> b.rep group by 1, 2), l as (select a, b from c where c >= 0.8 * (na + nb - c)), r(a, b) as (select rep, rep from k union select r.a, l.b from r join l on r.b = l.a), m as (select a as rep, min(b) as class_id from r group by 1), z as (select a as rep, count(*) as links from l group by 1)"


@query(f"with recursive {_NEAR} select doc_id, class_id, coalesce(links, 0) as links from sh join k using (s) join m using (rep) left join z using (rep)")
def near_dup_texts(spark, d):
    return clusters.near_duplicates(read(spark, d, "documents"), "doc_id", "text")


@query("with e as (select distinct least(user_id, user_id % 40) as a, greatest(user_id, user_id % 40) as b from events where user_id <> user_id % 40) select distinct b as node, a as component from e union select distinct a, a from e")
def graph_components(spark, d):
    e = read(spark, d, "events").select(F.col("user_id").alias("a"), (F.col("user_id") % 40).alias("b")).where("a <> b")
    return clusters.components(e)


def _folder(spark, name):
    ensure_checkpoint_dir(spark)
    return os.path.join(spark.sparkContext.getCheckpointDir(), f"{name}-{uuid.uuid4().hex}")


def _stream(spark, d):
    return streams.read_files(spark, d, read(spark, d, "events").schema, "events.parquet")


@query(f"with {EVENTS} select event_type, us - us % 172800000000 as bin, count(*) as n, round(sum(value), 4) as total from ev group by 1, 2")
def stream_tumbling(spark, d):
    s = _stream(spark, d).withColumn("at", F.col("ts").cast("timestamp"))
    t = streams.tumbling(s, "at", ["event_type"], "2 days", "60 days", "value")
    out = streams.run_to_end(t, "t" + uuid.uuid4().hex, _folder(spark, "stream"), "complete")
    return out.select("event_type", F.unix_micros("start").alias("bin"), "n", R("total", 4).alias("total"))


def _to_table(spark, stream, name):
    out = _folder(spark, name)
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", _folder(spark, name + "-log")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@query("select distinct user_id, event_type from events")
def stream_dedupe(spark, d):
    s = _stream(spark, d).withColumn("at", F.col("ts").cast("timestamp"))
    return _to_table(spark, streams.once(s, "at", ["user_id", "event_type"], "60 days"), "once").select("user_id", "event_type")


@query("with c as (select user_id, event_id, event_type, case when lag(event_type) over (partition by user_id order by event_id) is distinct from event_type then 1 else 0 end as new from events) select user_id, event_id, event_type, cast(sum(new) over (partition by user_id order by event_id rows unbounded preceding) as bigint) as run from c")
def stream_runs(spark, d):
    return _to_table(spark, streams.runs(_stream(spark, d).select("user_id", "event_id", "event_type"), "user_id", "event_id", "event_type"), "runs")


@query(f"with {EVENTS} select event_type, day, count(*) as n from ev group by 1, 2")
def stream_merge(spark, d):
    out = _folder(spark, "merged")
    s = _stream(spark, d).select("event_type", F.floor(micros("ts") / 86_400_000_000).alias("day"), F.lit(1).cast("bigint").alias("n"))
    q = s.writeStream.foreachBatch(streams.merge_into(out, ["event_type", "day"], ["n"], ["event_type"])).option("checkpointLocation", _folder(spark, "merge-log")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(out).select("event_type", "day", "n")


@query(f"with recursive {EVENTS}, seq as (select user_id, us, value, row_number() over (partition by user_id order by us) as i, (us - lag(us) over (partition by user_id order by us)) / 86400000000.0 as dt from ev), f(user_id, i, us, m, p) as (select user_id, i, us, 1e6::double / (1e6 + 400.0) * value, (1 - 1e6::double / (1e6 + 400.0)) * 1e6 from seq where i = 1 union all select s.user_id, s.i, s.us, f.m + (f.p + 5.0 * s.dt) / (f.p + 5.0 * s.dt + 400.0) * (s.value - f.m), (1 - (f.p + 5.0 * s.dt) / (f.p + 5.0 * s.dt + 400.0)) * (f.p + 5.0 * s.dt) from f join seq s on s.user_id = f.user_id and s.i = f.i + 1) select user_id, us, round(m, 5) as mean, round(p, 5) as var from f")
def stream_level(spark, d):
    s = _stream(spark, d).select("user_id", micros("ts").alias("us"), "value")
    t = _to_table(spark, streams.filtered_level(s, "user_id", "us", "value", 5.0, 400.0), "level")
    return t.select("user_id", "us", R("mean", 5).alias("mean"), R("var", 5).alias("var"))


@query(f"with {EVENTS} select user_id, us, round(avg(value) over (partition by user_id order by us range between 604799999999 preceding and current row), 6) as mean from ev where us <= 1705000000000000")
def stream_trailing_mean(spark, d):
    s = streams.until(_stream(spark, d).select("user_id", micros("ts").alias("us"), "value"), "us", 1_705_000_000_000_000)
    t = _to_table(spark, streams.trailing_mean(s, "user_id", "us", "value", 7), "trailing")
    return t.select("user_id", "us", R("mean", 6).alias("mean"))


@query("select event_type, count(*) as n from events group by 1")
def publish_and_scan(spark, d):
    out = _folder(spark, "published")
    files.publish(read(spark, d, "events"), out, ["event_type"])
    return files.scan(spark, out, columns=["event_type", "value"]).groupBy("event_type").agg(F.count("*").alias("n"))


@query("select n_regionkey, count(*) as n, min(n_name) as first_name from nation group by 1")
def csv_round_trip(spark, d):
    out = _folder(spark, "csv") + ".csv"
    files.write_by_extension(read(spark, d, "nation"), out)
    return files.read_csv(spark, out, "n_nationkey int, n_name string, n_regionkey int").groupBy("n_regionkey").agg(F.count("*").alias("n"), F.min("n_name").alias("first_name"))


@query("select event_type, count(*) as n from events group by 1")
def incremental_rebuild(spark, d):
    out, manifest = _folder(spark, "parts"), _folder(spark, "manifest")
    e = read(spark, d, "events").select("event_type", "event_id")
    build = lambda rows: rows.groupBy("event_type").agg(F.count("*").alias("n"))
    files.rebuild(spark, e, ["event_type"], build, out, manifest)
    again = files.rebuild(spark, e, ["event_type"], build, out, manifest)
    if again:
        raise RuntimeError("unchanged parts were rebuilt")
    return spark.read.parquet(out).select("event_type", "n")


@query("select * from (select x as id, x % 7 as kind from range(100000) t(x))")
def search_index_source(spark, d):
    def client(low, high, limit):
        return [(i, i % 7) for i in range(low, min(high, low + limit))]

    spark.dataSource.register(search_index.source("tallgrass_index", "id bigint, kind bigint", client))
    return spark.read.format("tallgrass_index").option("low", "0").option("high", "100000").option("step", "25000").option("limit", "4000").load()


@query("select distinct event_type from events where event_type = 'error' and event_id % 10 = 0")
def stale_part_check(spark, d):
    e = read(spark, d, "events").select("event_type", "event_id", "value")
    return files.stale_parts(files.part_digests(e, ["event_type"]), files.part_digests(e.where("event_id % 10 <> 0 or event_type <> 'error'"), ["event_type"]), ["event_type"])
