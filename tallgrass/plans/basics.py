"""Small text, date and order functions, and the file layer, on the test tables."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from tallgrass.functions import text, time
from tallgrass.operators import documents
from tallgrass.plans.modelled import _folder
from tallgrass.plans.register import catalogue
from tallgrass.plans.tables import EVENTS, events, read
from tallgrass.sources import files

QUERIES, SQL, query = catalogue()

WORDS = ("bike lanes", "nuclear (reactors)", "budget", "+1", "hôpital")


@query("select doc_id, " + " or ".join(f"contains(text, '{w}')" for w in WORDS) + " as hit, starts_with(text, 'The ') or ends_with(text, '.') as edges from documents where text is not null")
def text_contains_any(spark, d):
    t = F.col("text")
    return read(spark, d, "documents").where("text is not null").select("doc_id", text.contains_any(t, WORDS).alias("hit"), (t.startswith("The ") | t.endswith(".")).alias("edges"))


@query(f"with {EVENTS} select event_id, cast(year(ts) as int) as y, cast(isoyear(ts) as int) as iso, cast(week(ts) as int) as week, isoyear(ts) || '_' || week(ts) as label, cast(ts as date)::varchar as day, cast(trunc((us - 1704100000000000) / 3600000000.0) as bigint) as hours, cast(trunc((us - 1704500000000000) / 86400000000.0) as bigint) as days, round((us - 1577836800000000) / (86400000000 * 365.25), 9) as years from ev")
def date_parts(spark, d):
    date = F.col("ts").cast("date")
    return events(spark, d).select(
        "event_id", F.year(date).alias("y"), time.iso_year(date).cast("int").alias("iso"), F.weekofyear(date).alias("week"), time.week_label(date).alias("label"), date.cast("string").alias("day"),
        time.whole_hours(F.col("us") - 1_704_100_000_000_000).alias("hours"), time.whole_days(F.col("us") - 1_704_500_000_000_000).alias("days"), F.round(time.fractional_years(F.col("us")), 9).alias("years"),
    )


@query("select o_orderkey, isoyear(o_orderdate) || '_' || week(o_orderdate) as label, epoch_us(timezone('America/Toronto', o_orderdate)) as utc_us, epoch_us(o_orderdate) // 1000000 as s from orders")
def date_zones(spark, d):
    o = read(spark, d, "orders")
    wall = time.micros("o_orderdate")
    seconds = F.floor(wall / 1_000_000).cast("bigint")
    local = F.to_utc_timestamp(F.timestamp_seconds(seconds) + F.make_dt_interval(secs=(wall % 1_000_000) / 1_000_000), "America/Toronto")
    return o.select("o_orderkey", time.week_label(F.col("o_orderdate").cast("date")).alias("label"), F.unix_micros(local).alias("utc_us"), seconds.alias("s"))


@query("select id, platform, strptime(strftime(timezone('UTC', createtime), '%Y-%m-%dT%H:%M:%S'), '%Y-%m-%dT%H:%M:%S')::varchar as back from doc_targets where createtime is not null")
def date_parse(spark, d):
    written = F.date_format("createtime", "yyyy-MM-dd'T'HH:mm:ssXXX")
    plain = F.to_timestamp(written, "yyyy-MM-dd'T'HH:mm:ssXXX").cast("timestamp_ntz")
    return read(spark, d, "doc_targets").where("createtime is not null").select("id", "platform", F.date_format(plain, "yyyy-MM-dd HH:mm:ss").alias("back"))


RANKS = {"error": 0, "click": 1, "view": 2}


@query("select user_id, event_type, row_number() over (partition by user_id order by case event_type when 'error' then 0 when 'click' then 1 when 'view' then 2 else 3 end, event_type) as place from (select distinct user_id, event_type from events)")
def sort_by_category(spark, d):
    from tallgrass.operators.windows import category_rank

    kinds = read(spark, d, "events").select("user_id", "event_type").distinct()
    order = Window.partitionBy("user_id").orderBy(category_rank(F.col("event_type"), RANKS), "event_type")
    return kinds.withColumn("place", F.row_number().over(order).cast("bigint"))


@query("with r as (select *, row_number() over (order by ts, event_id) - 1 as i, count(*) over () as n from events) select cast(floor(n * 0.8) as bigint) as i, max(ts) filter (where i = cast(floor(n * 0.8) as bigint))::varchar as cutoff, count(*) filter (where i < cast(floor(n * 0.8) as bigint)) as train, count(*) filter (where i >= cast(floor(n * 0.8) as bigint)) as val from r group by n")
def row_at_position(spark, d):
    from tallgrass.operators.windows import at_position

    e = read(spark, d, "events").select("ts", "event_id")
    place = int(e.count() * 0.8)
    cut = at_position(e, ["ts", "event_id"], place)
    early = (F.col("ts") < cut["ts"]) | ((F.col("ts") == cut["ts"]) & (F.col("event_id") < cut["event_id"]))
    return e.agg(F.lit(place).cast("bigint").alias("i"), F.lit(cut["ts"].isoformat(" ")).alias("cutoff"), F.count_if(early).alias("train"), F.count_if(~early).alias("val"))


@query("with e as (select user_id, cast(ts as date) as day, value from events) select user_id, day::varchar as day, n from (select user_id, day, count(*) as n, dense_rank() over (partition by user_id order by day desc) as r from e group by 1, 2) where r <= 3")
def newest_days(spark, d):
    per = read(spark, d, "events").groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(F.count("*").alias("n"))
    rank = F.dense_rank().over(Window.partitionBy("user_id").orderBy(F.desc("day")))
    return per.withColumn("_r", rank).where("_r <= 3").select("user_id", F.col("day").cast("string").alias("day"), "n")


@query("with t as (select id, text, case when id in ('None', '-1') then null when hash_free then null else id end as kept from (select id, text, contains(id, '7') as hash_free from bluesky)) select count(*) as n, count(kept) as kept from t")
def null_values(spark, d):
    b = read(spark, d, "bluesky").select(F.when(F.contains("id", F.lit("7")), F.lit("-1")).otherwise(F.col("id")).alias("id"))
    return b.select(text.without_values(F.col("id"), ["None", "-1"]).alias("kept")).agg(F.count("*").alias("n"), F.count("kept").alias("kept"))


@query("select distinct id, platform, case platform when 'twitter' then 'https://platform.twitter.com/embed/Tweet.html?id=' || id when 'tiktok' then 'https://www.tiktok.com/embed/v2/' || id when 'bluesky' then 'https://embed.bsky.app/embed/' || split_part(id, '/', 1) || '/app.bsky.feed.post/' || split_part(id, '/', -1) end as url from doc_targets where regexp_matches(id, case platform when 'bluesky' then '^[^/]+(/.*)?/[^/]+$' else '^[0-9]+$' end) and platform <> 'instagram'")
def embed_links(spark, d):
    t = read(spark, d, "doc_targets").where("platform <> 'instagram'").where(F.when(F.col("platform") == "bluesky", F.col("id").rlike("^[^/]+(/.*)?/[^/]+$")).otherwise(F.col("id").rlike("^[0-9]+$")))
    return t.select("id", "platform", text.embed_link(text.permalink(F.col("platform"), F.lit("someone"), F.col("id"))).alias("url")).distinct()


@query("with l as (select vec_id, unnest(embedding)::double as l, generate_subscripts(embedding, 1) as i from embeddings), r as (select *, row_number() over (partition by vec_id order by abs(l) desc, 'd' || i) as r from l) select vec_id, string_agg(case when l < 0 then '-' else '+' end || 'd' || i, ', ' order by r) as label from r where r <= 3 group by 1")
def axis_labels(spark, d):
    v = F.col("embedding").cast("array<double>")
    names = F.transform(F.sequence(F.lit(1), F.size(v)), lambda i: F.concat(F.lit("d"), i.cast("string")))
    return read(spark, d, "embeddings").select("vec_id", text.axis_label(names, v).alias("label"))


FAMILIES = [("bloc", "bloc"), ("civic", "civic|commonweal"), ("regional", "prairie|harbour")]


@query("select distinct seed.Party as party, case when regexp_matches(lower(seed.Party), 'bloc') then 'bloc' when regexp_matches(lower(seed.Party), 'civic|commonweal') then 'civic' when regexp_matches(lower(seed.Party), 'prairie|harbour') then 'regional' else seed.Party end as family from doc_targets")
def party_families(spark, d):
    p = F.col("seed.Party")
    return read(spark, d, "doc_targets").select(p.alias("party"), text.first_match(p, FAMILIES, p).alias("family")).distinct()


@query("select y as year, count(*) as n, count(distinct SeedName) as accounts from (select *, unnest([2021, 2022, 2023, 2024]) as y from cells) where abs(date_diff('day', make_date(y, 7, 1), cast(bin as date))) <= 365 group by 1")
def yearly_windows(spark, d):
    c = read(spark, d, "cells").withColumn("year", F.explode(time.centred_years(F.col("bin").cast("date"), 2021, 2024)))
    return c.groupBy("year").agg(F.count("*").alias("n"), F.countDistinct("SeedName").alias("accounts"))


@query("select vec_id, len(embedding) as n, embedding[1]::double as first, embedding[len(embedding)]::double as last, round(list_sum(list_transform(embedding::double[], lambda x: x * x)), 6) as square from embeddings where len(embedding) = 64")
def fixed_arrays(spark, d):
    v = F.col("embedding").cast("array<double>")
    columns = [F.get(v, F.lit(i)).alias(f"x{i}") for i in range(64)]
    wide = read(spark, d, "embeddings").where(F.size("embedding") == 64).select("vec_id", *columns)
    back = wide.select("vec_id", F.array(*[f"x{i}" for i in range(64)]).alias("v"))
    return back.select("vec_id", F.size("v").cast("bigint").alias("n"), F.get("v", F.lit(0)).alias("first"), F.get("v", F.lit(63)).alias("last"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x), 6).alias("square"))


@query("with p as (select cast(event_id as varchar) as id, event_id, user_id, case when event_id % 5 = 0 then 'None' when event_id % 7 = 0 then '-1' else cast(event_id // 2 as varchar) end as answered, 'RT @u' || user_id || ': see https://t.co/' || event_type || ' now' as raw, case when event_id % 3 = 0 then 'quoted ' || user_id end as quoted from events) select p.id, 'see URL now' as Document, case when q.raw is not null then 'see URL now' else p.quoted end as ParentDocument from p left join p q on p.answered = q.id")
def documents_twitter(spark, d):
    e = read(spark, d, "events")
    raw = F.concat(F.lit("RT @u"), F.col("user_id"), F.lit(": see https://t.co/"), F.col("event_type"), F.lit(" now"))
    answered = F.when(F.col("event_id") % 5 == 0, "None").when(F.col("event_id") % 7 == 0, "-1").otherwise(F.floor(F.col("event_id") / 2).cast("string"))
    quoted = F.struct(F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("quoted "), F.col("user_id"))).alias("rawContent"))
    posts = e.select(F.col("event_id").cast("string").alias("id"), F.col("ts").cast("string").alias("date"), raw.alias("rawContent"), answered.alias("inReplyToTweetId"), quoted.alias("quotedTweet"), F.struct(F.lit("a").alias("SeedName")).alias("seed"))
    return documents.twitter_documents(posts).select("id", "Document", "ParentDocument")


@query(r"with t as (select target, avg(case when model_stance = 'FAVOR' then 1.0 else 0.0 end) as share from coded_pairs where target is not null group by 1) select target, regexp_matches(target, '\p{L}') and length(target) <= 300 and not starts_with(target, '@') and not regexp_matches(target, '(^|\s)\S*\d\S*') and (regexp_matches(target, '[^\x00-\x{24F}\x{2000}-\x{206F}]') or share >= 0.4) as candidate from t")
def translation_candidates(spark, d):
    t = read(spark, d, "coded_pairs").where("target is not null").groupBy("target").agg(F.avg((F.col("model_stance") == "FAVOR").cast("double")).alias("share"))
    return t.select("target", documents.to_translate(F.col("target"), F.coalesce("share", F.lit(0.0))).alias("candidate"))


@query(r"with t as (select distinct unnest(Targets) as t from doc_targets) select t as target from t where t is not null and regexp_matches(t, '\p{L}') and length(trim(t)) between 3 and 300 and not regexp_matches(t, '^(https?://|@|#)') and lower(trim(t)) not in ('none', 'n/a', 'unknown', 'url')")
def usable_targets(spark, d):
    t = read(spark, d, "doc_targets").select(F.explode("Targets").alias("target")).distinct()
    return t.where(documents.usable_target(F.col("target")))


@query("select doc_id, case when text is null then null when length(replace_first) > 300 then substr(replace_first, 1, 297) || '...' else replace_first end as short from (select doc_id, text, regexp_replace(regexp_replace(text, '<', '&lt;'), '>', '&gt;') as replace_first from documents)")
def shortened_texts(spark, d):
    return read(spark, d, "documents").select("doc_id", text.shortened(F.col("text")).alias("short"))


@query(r"with t as (select doc_id, text, regexp_replace(substr(text, 1, 200), '^[\s\x{A0}\x{2000}-\x{200A}\x{202F}\x{3000}]+|[\s\x{A0}\x{2000}-\x{200A}\x{202F}\x{3000}]+$', '', 'g') as cut from documents), b as (select *, coalesce(nullif(regexp_extract(cut, '(?s)^(.*[.!?…。！？])(?:\s|$)', 1), ''), nullif(regexp_extract(cut, '(?s)^(.*)\n', 1), ''), nullif(regexp_extract(cut, '(?s)^(.*)\s', 1), '')) as raw from t), e as (select *, regexp_replace(raw, '^[\s\x{A0}\x{2000}-\x{200A}\x{202F}\x{3000}]+|[\s\x{A0}\x{2000}-\x{200A}\x{202F}\x{3000}]+$', '', 'g') as edge from b) select doc_id, case when length(text) > 200 then case when length(edge) >= 0.5 * length(cut) then edge else cut end else text end as cut from e")
def boundary_texts(spark, d):
    return read(spark, d, "documents").select("doc_id", text.cut_at_boundary(F.col("text"), 200).alias("cut"))


@query("with recursive c(id, n, code) as (select distinct id, cast(id as hugeint), '' from instagram where regexp_matches(id, '^[0-9]{1,19}$') union all select id, n // 64, substr('ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_', cast(n % 64 as int) + 1, 1) || code from c where n > 0) select id, code from c where n = 0")
def short_code_digits(spark, d):
    ids = read(spark, d, "instagram").where(F.col("id").rlike("^[0-9]{1,19}$")).select("id").distinct()
    return ids.select("id", text.short_code(F.col("id").cast("bigint")).alias("code"))


# the file layer: written into the shared folder, read again


@query("select event_type, count(*) as n from events group by 1")
def scan_missing_columns(spark, d):
    out = _folder(spark, "parts")
    e = read(spark, d, "events")
    e.where("event_id % 2 = 0").select("event_type").write.parquet(f"{out}/a")
    e.where("event_id % 2 = 1").select("event_type", "value").write.parquet(f"{out}/b")
    both = files.scan(spark, f"{out}/a", f"{out}/b", columns=["event_type", "value", "absent"])
    return both.where("absent is null").groupBy("event_type").agg(F.count("*").alias("n"))


@query("select event_type, count(*) as n from events where event_id % 2 = 0 group by 1")
def scan_unreadable(spark, d):
    out = _folder(spark, "broken")
    read(spark, d, "events").where("event_id % 2 = 0").select("event_type").write.parquet(f"{out}/good")
    spark.createDataFrame([("no parquet",)], "value string").write.text(f"{out}/bad.parquet")
    return files.scan_tolerant(spark, [f"{out}/good", f"{out}/bad.parquet", f"{out}/absent"]).groupBy("event_type").agg(F.count("*").alias("n"))


@query("select 5 as n, true as typed")
def head_scan(spark, d):
    h = files.head(spark, f"{d}/events.parquet", 5)
    return h.agg(F.count("*").cast("int").alias("n"), F.lit(h.schema == read(spark, d, "events").schema).alias("typed"))


@query("select r_regionkey, r_name, case when r_regionkey % 2 = 0 then r_name end as sometimes from region")
def json_round_trip(spark, d):
    out = _folder(spark, "json")
    r = read(spark, d, "region").select("r_regionkey", "r_name", F.when(F.col("r_regionkey") % 2 == 0, F.col("r_name")).alias("sometimes"))
    files.write_json(r, out)
    return files.read_json(spark, out, r.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "))


@query("select n_regionkey as region, count(*) as nations from nation group by 1")
def json_documents(spark, d):
    out = _folder(spark, "metadata")
    per = read(spark, d, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(F.count("*").alias("nations"))
    spark.createDataFrame([(files.to_json_document(per),)], "value string").coalesce(1).write.text(out)
    return files.read_json(spark, out, "region bigint, nations bigint", whole=True)


@query("select 'id' || event_id as id, case when event_id % 3 = 0 then cast(9007199254740993 + event_id as varchar) else cast(9007199254740992 as varchar) end as long_id, event_type from events")
def docvalue_merge(spark, d):
    e = read(spark, d, "events")
    exact = F.when(F.col("event_id") % 3 == 0, F.array((F.lit(9007199254740993) + F.col("event_id")).cast("string"))).otherwise(F.array().cast("array<string>"))
    hits = e.select(F.struct(F.concat(F.lit("id"), F.col("event_id")).alias("id"), F.lit(9007199254740992).alias("long_id"), "event_type").alias("_source"), F.struct(exact.alias("long_id")).alias("fields"))
    return files.merged_fields(hits)


@query("select cast(region as varchar) as region, split_part(name, '_', 1) as kind, n from (select n_regionkey as region, 'nation_' || n_regionkey as name, count(*) as n from nation group by 1)")
def name_partitions(spark, d):
    out = _folder(spark, "named")
    for r in range(5):
        read(spark, d, "nation").where(F.col("n_regionkey") == r).coalesce(1).write.parquet(f"{out}/nation_{r}.parquet")
    folder = F.element_at(F.split(F.input_file_name(), "/"), -2)
    rows = spark.read.option("recursiveFileLookup", "true").parquet(out).select(F.regexp_extract(folder, r"^([a-z]+)_(\d+)", 1).alias("kind"), F.regexp_extract(folder, r"^([a-z]+)_(\d+)", 2).alias("region"))
    return rows.groupBy("region", "kind").agg(F.count("*").alias("n"))


@query("select * from (values (2024, 2, true), (2024, 10, true), (2024, 3, false)) t(year, week, paired)")
def weekly_pairs(spark, d):
    stance = spark.createDataFrame([("s/x_stance_2024_02.parquet", "x_stance_2024_02.parquet"), ("s/x_2024-10.parquet", "x_2024-10.parquet"), ("s/x_2024_3.parquet", "x_2024_3.parquet"), ("s/notes.txt", "notes.txt")], "path string, name string")
    probs = spark.createDataFrame([("p/y_2024_2.parquet", "y_2024_2.parquet"), ("p/y_2024_10.parquet", "y_2024_10.parquet"), ("p/y_2023_3.parquet", "y_2023_3.parquet")], "path string, name string")
    pairs, dropped = files.paired_weeks(stance, probs)
    return pairs.select("year", "week", F.lit(True).alias("paired")).unionByName(dropped.withColumn("paired", F.lit(False)))


@query("select * from (values ('a_2024-1-5.csv', 'a_2024-01-05.csv'), ('2024-11-3', '2024-11-03'), ('x2024-12-25y', 'x2024-12-25y'), ('12024-1-5', '12024-1-5')) t(name, padded)")
def padded_names(spark, d):
    n = spark.createDataFrame([("a_2024-1-5.csv",), ("2024-11-3",), ("x2024-12-25y",), ("12024-1-5",)], "name string")
    return n.withColumn("padded", files.padded_date(F.col("name")))


@query("select r_regionkey as region, count(*) as rows from nation join region on n_regionkey = r_regionkey where n_name > 'J' group by 1")
def filtered_files(spark, d):
    out, copied = _folder(spark, "sources"), _folder(spark, "copied")
    for r in range(5):
        for word in ("keep", "skip"):
            read(spark, d, "nation").where(F.col("n_regionkey") == r).coalesce(1).write.parquet(f"{out}/{word}{r}")
    found = files.filtered_copy(spark, out, ".parquet", F.col("n_name") > "J", copied)
    found.count()
    kept = spark.read.parquet(copied).select("n_nationkey", "n_regionkey").distinct()
    return kept.groupBy(F.col("n_regionkey").alias("region")).agg(F.count("*").alias("rows"))


@query("select strftime(ts, '%Y-%m') as month, count(*) as n, count(distinct cast(ts as date)) as days from events group by 1")
def monthly_files(spark, d):
    daily, monthly = _folder(spark, "daily"), _folder(spark, "monthly")
    files.publish(read(spark, d, "events").select("event_id", F.col("ts").cast("date").alias("day")), daily, ["day"])
    files.compact_months(spark, daily, "day", monthly)
    m = spark.read.parquet(monthly)
    return m.groupBy(F.col("month").cast("string").alias("month")).agg(F.count("*").alias("n"), F.countDistinct("day").alias("days"))


@query("select event_type, count(*) as n, round(sum(value), 4) as total from events group by 1")
def gzip_round_trip(spark, d):
    out = _folder(spark, "gz")
    files.write_gzip(read(spark, d, "events"), out)
    return spark.read.parquet(out).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("select vec_id as row, embedding[1]::double as first from embeddings where vec_id < 50")
def array_round_trip(spark, d):
    e = read(spark, d, "embeddings").where("vec_id < 50")
    matrix = files.to_array(e.select("vec_id", F.col("embedding").cast("array<double>").alias("v")), "vec_id", "v")
    return files.from_array(spark, np.asarray(matrix)).select("row", F.get("v", F.lit(0)).alias("first"))


@query("select count(*) as n, sum(case when event_type = 'view' then 1 else 0 end)::bigint as first_time from (select distinct event_type from events)")
def outputs_missing(spark, d):
    e = read(spark, d, "events")
    wanted, done = e.select("event_type"), e.where("event_type <> 'view'").select("event_type")
    todo = files.missing_parts(wanted, done, ["event_type"])
    return wanted.distinct().agg(F.count("*").alias("n")).join(F.broadcast(todo.agg(F.count("*").alias("first_time"))))


@query("select r_name as name, '[' || string_agg('{\"n_name\":\"' || n_name || '\"}', ',' order by n_name) || ']' as entries from nation join region on n_regionkey = r_regionkey group by 1")
def page_entries(spark, d):
    n = read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("name"), "n_name")
    return files.page_groups(n, "name", ["n_name"], ["n_name"])


@query(r"select r_name || ' & ' || count(*) || ' \\' as line from nation join region on n_regionkey = r_regionkey group by r_name")
def latex_rows(spark, d):
    n = read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.count("*").alias("n"))
    lines = files.latex_table(n, ["r_name", "n"]).split("\n")[2:-1]
    return spark.createDataFrame([(x,) for x in lines], "line string")


@query("select 'run' || n_regionkey as run, 'nations' as key, cast(count(*) as varchar) as value from nation group by 1")
def run_records(spark, d):
    out = _folder(spark, "runs")
    for r in read(spark, d, "nation").groupBy("n_regionkey").count().collect():  # one row per region
        spark.createDataFrame([(json.dumps({"nations": r["count"]}),)], "value string").coalesce(1).write.text(f"{out}/run{r['n_regionkey']}.json")
    return files.runs(spark, out)


@query("select '6.0' as a, true as same, true as other")
def config_keys(spark, d):
    one = files.config_key({"bins": 6, "seed": 1, "note": "x"}, ["bins", "seed"])
    same = one == files.config_key({"seed": 1.0, "bins": 6.0}, ["bins", "seed"])
    return spark.createDataFrame([("6.0", same, one != files.config_key({"bins": 7, "seed": 1}))], "a string, same boolean, other boolean")


@query("with k as (select id, platform, ParentDocument, Document from doc_targets) select count(distinct coalesce(ParentDocument, '') || chr(0) || coalesce(Document, '') || chr(0) || platform) as keys from k")
def content_keys(spark, d):
    k = text.content_key(F.col("ParentDocument"), F.col("Document"), F.col("platform"))
    return read(spark, d, "doc_targets").agg(F.countDistinct(k).alias("keys"))


@query("select distinct id, platform, case when ParentDocument is not null then ParentDocument || '; ' || Document else Document end as text from doc_targets where regexp_matches(Document, '\\p{L}')")
def combined_texts(spark, d):
    t = documents.usable(read(spark, d, "doc_targets"))
    return t.select("id", "platform", documents.all_text(F.col("ParentDocument"), F.col("Document")).alias("text")).distinct()
