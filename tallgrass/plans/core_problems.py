"""Queries of the general problems 2, 3 and 4 over the whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallgrass.operators import hot_keys, timestamps, trailing


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hot_keys.heavy_keys(read(spark, sf_dir, "cells"))


def p2_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = hot_keys.key_totals(read(spark, sf_dir, "cells"))
    return t.select("field", "key_value", "rows", "posts", F.round("s_sum", 3).alias("s_sum"), "bins", "first_bin", "last_bin", F.round("widest_gap_days", 6).alias("widest_gap_days"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = timestamps.post_times(read(spark, sf_dir, "bluesky"), read(spark, sf_dir, "instagram"), read(spark, sf_dir, "tiktok"), read(spark, sf_dir, "province_zones"))
    return t.select("platform", "id", "utc_us")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trailing.quiet_days(read(spark, sf_dir, "target_df"))


def p4_trailing(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trailing.trailing_totals(read(spark, sf_dir, "target_df"))
    return t.select("filter_value", F.date_format("day", "yyyy-MM-dd").alias("day"), "readings", "readings_7", "readings_30", *[F.round(f"avg_{p}_{i}", 6).alias(f"avg_{p}_{i}") for p in (7, 30) for i in range(4)])


QUERIES = {"p2_found": p2_found, "p2_totals": p2_totals, "p3_found": p3_found, "p4_found": p4_found, "p4_trailing": p4_trailing}

_STACKED = """
stacked as (select 'SeedName' as field, SeedName as key_value, bin, n, s_sum from cells
            union all select 'target', target, bin, n, s_sum from cells)
"""
_READINGS = """
once as (select distinct filter_value, createtime, x0 from target_df
         where filter_value is not null and trim(filter_value) <> '' and createtime is not null
           and x0[1] is not null and not isnan(x0[1])),
daily as (select filter_value, cast(createtime as date) as day, count(*) as readings,
                 sum(case when x0[1] is null or isnan(x0[1]) then 0 else x0[1] end) as c0,
                 sum(case when x0[2] is null or isnan(x0[2]) then 0 else x0[2] end) as c1,
                 sum(case when x0[3] is null or isnan(x0[3]) then 0 else x0[3] end) as c2,
                 sum(case when x0[4] is null or isnan(x0[4]) then 0 else x0[4] end) as c3
          from once group by 1, 2),
spans as (select filter_value, min(day) as lo, max(day) as hi from daily group by 1),
days as (select filter_value, cast(unnest(generate_series(lo, hi, interval 1 day)) as date) as day from spans),
dense as (select filter_value, day, coalesce(readings, 0) as readings, coalesce(c0, 0) as c0, coalesce(c1, 0) as c1,
                 coalesce(c2, 0) as c2, coalesce(c3, 0) as c3
          from days left join daily using (filter_value, day))
"""
SQL = {
    "p2_found": f"""
with {_STACKED},
totals as (select field, count(*) as all_rows, sum(n) as all_posts from stacked group by 1),
per_key as (select field, key_value, count(*) as key_rows, coalesce(sum(n), 0) as posts from stacked
            where key_value is not null and trim(key_value) <> '' group by 1, 2),
joined as (select * from per_key join totals using (field))
select field, key_value, 'rows' as measure from joined where key_rows * 100 >= all_rows * 2
union all select field, key_value, 'posts' from joined where posts * 100 >= all_posts * 2 and all_posts > 0
""",
    "p2_totals": f"""
with {_STACKED},
sums as (select field, key_value, count(*) as rows, cast(coalesce(sum(n), 0) as bigint) as posts, round(coalesce(sum(s_sum), 0), 3) as s_sum
         from stacked group by 1, 2),
bins as (select distinct field, key_value, epoch_us(bin) as us from stacked where bin is not null),
gaps as (select *, us - lag(us) over (partition by field, key_value order by us) as gap from bins),
spans as (select field, key_value, count(*) as bins, min(us) as first_bin, max(us) as last_bin, max(gap) as widest from gaps group by 1, 2)
select s.field, s.key_value, s.rows, s.posts, s.s_sum, coalesce(g.bins, 0) as bins, g.first_bin, g.last_bin,
       round(g.widest / 86400000000.0, 6) as widest_gap_days
from sums s left join spans g on s.field = g.field and s.key_value is not distinct from g.key_value
""",
    "p4_found": f"""
with {_READINGS},
framed as (select filter_value, day,
    sum(readings) over (partition by filter_value order by day rows between 6 preceding and current row) as r7,
    sum(readings) over (partition by filter_value order by day rows between 29 preceding and current row) as r30 from dense)
select filter_value, strftime(day, '%Y-%m-%d') as day from framed where r7 = 0 and r30 > 0
""",
    "p4_trailing": f"""
with {_READINGS}
select filter_value, strftime(day, '%Y-%m-%d') as day, readings,
  cast(sum(readings) over w7 as bigint) as readings_7, cast(sum(readings) over w30 as bigint) as readings_30,
  {", ".join(f"round(sum(c{i}) over w{p} / {p}.0, 6) as avg_{p}_{i}" for p in (7, 30) for i in range(4))}
from dense
window w7 as (partition by filter_value order by day rows between 6 preceding and current row),
       w30 as (partition by filter_value order by day rows between 29 preceding and current row)
""",
}
