"""Bootstrap by clusters as plain SQL: every cluster draws a Poisson weight per replicate from a digest of its name.

Rows are first summed per cluster, so replicates multiply clusters and not rows; weighted sums combine before they are
shuffled, and what is left is one row per replicate.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def digest_unit(*parts: Column) -> Column:
    """A number in [0, 1) from the MD5 digest of the parts joined by colons, the same in any engine and on any run."""
    digest = F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(2**32))


def poisson_weight(u: Column, most: int = 8) -> Column:
    """How often a cluster is drawn: Poisson with mean 1, by its distribution function (at most ``most``)."""
    total, out = 0.0, F.lit(most)
    steps = []
    for k in range(most):
        total += math.exp(-1) / math.factorial(k)
        steps.append((k, total))
    for k, edge in reversed(steps):
        out = F.when(u < edge, k).otherwise(out)
    return out


def replicate_sums(sums: DataFrame, cluster: str, values: Sequence[str], by: Sequence[str] = (), replicates: int = 200, seed: int = 1) -> DataFrame:
    """(by, rep, values): sums over clusters, weighted per replicate; replicate 0 has every cluster once.

    ``sums`` has one row per cluster and ``by``.
    """
    drawn = sums.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates))))
    w = F.when(F.col("rep") == 0, 1).otherwise(poisson_weight(digest_unit(F.lit(seed), F.col(cluster), F.col("rep"))))
    return drawn.withColumn("_times_drawn", w).where("_times_drawn > 0").groupBy(*by, "rep").agg(*[F.sum(F.col("_times_drawn") * F.col(v)).alias(v) for v in values])


def interval(replicated: DataFrame, value: Column, by: Sequence[str] = ()) -> DataFrame:
    """(by, value, low, high): the value of all clusters and the 95 % range over replicates."""
    rows = replicated.select(*by, "rep", value.alias("_v"))
    drawn = F.when(F.col("rep") > 0, F.col("_v"))
    cuts = F.percentile(drawn, F.array(F.lit(0.025), F.lit(0.975)))
    out = rows.groupBy(*by).agg(F.max(F.when(F.col("rep") == 0, F.col("_v"))).alias("value"), cuts.alias("_q"))
    return out.select(*by, "value", F.col("_q")[0].alias("low"), F.col("_q")[1].alias("high"))


def mean_interval(rows: DataFrame, cluster: str, value: str, by: Sequence[str] = (), replicates: int = 200, seed: int = 1) -> DataFrame:
    """(by, value, low, high) of a mean, clusters being drawn."""
    sums = rows.groupBy(*by, cluster).agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    return interval(replicate_sums(sums, cluster, ["_s", "_n"], by, replicates, seed), F.col("_s") / F.col("_n"), by)


def resolution_interval(rows: DataFrame, cluster: str, bins: Sequence[str], scores: Sequence[str], outcome: str, replicates: int = 100, seed: int = 1) -> DataFrame:
    """(part, value, low, high): differences of reliability and of resolution of two scores, clusters being drawn.

    Each score comes with its bin; sums per cluster and bin are all that replicates need.
    """
    sides = F.array(*[F.struct(F.lit(i).alias("side"), F.col(b).cast("bigint").alias("bin"), F.col(s).cast("double").alias("p")) for i, (b, s) in enumerate(zip(bins, scores))])
    long = rows.select(cluster, F.col(outcome).cast("double").alias("o"), F.explode(sides).alias("_s")).select(cluster, "o", "_s.*")
    sums = long.groupBy("side", "bin", cluster).agg(F.count("*").alias("n"), F.sum("p").alias("p"), F.sum("o").alias("o"))
    rep = replicate_sums(sums, cluster, ["n", "p", "o"], ["side", "bin"], replicates, seed)
    whole = rep.groupBy("side", "rep").agg(F.sum("n").alias("_n"), (F.sum("o") / F.sum("n")).alias("_base"))
    n = F.col("n") / F.col("_n")
    parts = rep.join(whole, ["side", "rep"]).groupBy("side", "rep").agg(
        F.sum(n * F.pow((F.col("p") - F.col("o")) / F.col("n"), 2)).alias("reliability"), F.sum(n * F.pow(F.col("o") / F.col("n") - F.col("_base"), 2)).alias("resolution")
    )
    sign = F.when(F.col("side") == 0, 1).otherwise(-1)
    differences = parts.groupBy("rep").agg(F.sum(sign * F.col("reliability")).alias("reliability"), F.sum(sign * F.col("resolution")).alias("resolution"))
    table = F.explode(F.array(*[F.struct(F.lit(p).alias("part"), F.col(p).alias("_d")) for p in ("reliability", "resolution")]))
    return interval(differences.select("rep", table.alias("_t")).select("rep", "_t.*"), F.col("_d"), ["part"])
