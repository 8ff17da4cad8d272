"""How the catalogue reads the test tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallgrass.functions.time import micros


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with ``us`` (micros since 1970) and ``day`` (whole days since 1970)."""
    e = read(spark, sf_dir, "events").withColumn("us", micros("ts"))
    return e.withColumn("day", F.floor(F.col("us") / 86_400_000_000))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, day, n, x (mean value), the daily state of an account."""
    return events(spark, sf_dir).groupBy("user_id", "day").agg(F.count("*").alias("n"), F.avg("value").alias("x"))


# The same as common table expressions.
EVENTS = "ev as (select *, epoch_us(ts) as us, cast(floor(epoch_us(ts) / 86400000000.0) as bigint) as day from events)"
DAILY = EVENTS + ", daily as (select user_id, day, count(*) as n, avg(value) as x from ev group by 1, 2)"
