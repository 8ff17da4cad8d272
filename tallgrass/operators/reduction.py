"""Linear reductions of array states: moments are summed where the rows lie, small matrices are solved on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallgrass.operators.joins import dot
from tallgrass.staging import settle


def _sums(rows: DataFrame, a: str, b: str, width: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """(n, sum of a, sum of b, sum of a b') over all rows, by partial sums of one row per partition."""

    def run(batches):
        import pandas as pd

        n, sa, sb, ab = 0, np.zeros(width), np.zeros(width), np.zeros((width, width))
        for batch in batches:
            if len(batch):
                x, y = np.array(batch["a"].tolist(), float), np.array(batch["b"].tolist(), float)
                n, sa, sb, ab = n + len(x), sa + x.sum(0), sb + y.sum(0), ab + x.T @ y
        yield pd.DataFrame({"slot": range(1 + 2 * width + width * width), "v": np.concatenate([[n], sa, sb, ab.ravel()])})

    t = rows.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    v = t.mapInPandas(run, "slot int, v double").groupBy("slot").agg(F.sum("v").alias("v")).orderBy("slot").toPandas()["v"].to_numpy()
    if not len(v):
        v = np.zeros(1 + 2 * width + width * width)
    return int(v[0]), v[1 : 1 + width], v[1 + width : 1 + 2 * width], v[1 + 2 * width :].reshape(width, width)


def covariance(rows: DataFrame, a: str, b: str, width: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """(n, mean of a, mean of b, covariance of a and b)."""
    n, sa, sb, ab = _sums(rows, a, b, width)
    ma, mb = sa / max(n, 1), sb / max(n, 1)
    return n, ma, mb, ab / max(n, 1) - np.outer(ma, mb)


def principal(rows: DataFrame, vector: str, width: int, dims: int) -> dict:
    """mean, components (rows) and the shares of variance they explain; each component's largest entry is positive."""
    _, mean, _, c = covariance(rows, vector, vector, width)
    values, vectors = np.linalg.eigh((c + c.T) / 2)
    order = np.argsort(-values)[:dims]
    parts = vectors[:, order].T
    parts = parts * np.sign(parts[np.arange(len(parts)), np.abs(parts).argmax(axis=1)])[:, None]
    return {"mean": mean, "components": parts, "explained": values[order] / max(values.sum(), 1e-12)}


def project(vector: Column, model: dict) -> Column:
    """Coordinates of a vector under a fitted reduction, as an array; stays in the JVM."""
    centred = F.zip_with(vector, F.array(*[F.lit(float(m)) for m in model["mean"]]), lambda x, m: F.coalesce(x, m) - m)
    return F.array(*[dot(centred, F.array(*[F.lit(float(v)) for v in c])) for c in model["components"]])


def slow_features(rows: DataFrame, key: str, at: str, vector: str, width: int, dims: int) -> dict:
    """Directions of unit variance that change least from one state of an account to its next; slowest first."""
    _, mean, _, c = covariance(rows, vector, vector, width)
    values, vectors = np.linalg.eigh((c + c.T) / 2)
    keep = values > 1e-9 * max(values.max(), 1e-12)
    white = vectors[:, keep] / np.sqrt(values[keep])
    w = Window.partitionBy(key).orderBy(at)
    step = rows.select(F.zip_with(F.lead(vector).over(w), F.col(vector), lambda a, b: a - b).alias("d")).where("d is not null")
    n, _, _, raw = _sums(step, "d", "d", width)
    speed, turn = np.linalg.eigh(white.T @ (raw / max(n, 1)) @ white)
    return {"mean": mean, "components": (white @ turn[:, :dims]).T, "speed": speed[:dims]}


def lagged_correlations(rows: DataFrame, key: str, at: str, vector: str, width: int, lag: int) -> np.ndarray:
    """Singular values of the whitened covariance between states and those ``lag`` rows later, account by account; none
    where no more than ``width`` pairs are that far apart."""
    w = Window.partitionBy(key).orderBy(at)
    pairs = rows.select(F.col(vector).alias("x"), F.lead(vector, lag).over(w).alias("y")).where("y is not null")
    pairs = settle(pairs)
    if pairs.count() <= width:
        return np.zeros(0)
    _, _, _, c00 = covariance(pairs, "x", "x", width)
    _, _, _, c11 = covariance(pairs, "y", "y", width)
    _, _, _, c01 = covariance(pairs, "x", "y", width)

    def half(c: np.ndarray) -> np.ndarray:
        values, vectors = np.linalg.eigh((c + c.T) / 2)
        keep = values > 1e-9 * max(values.max(), 1e-12)
        return vectors[:, keep] / np.sqrt(values[keep]) @ vectors[:, keep].T

    return np.linalg.svd(half(c00) @ c01 @ half(c11), compute_uv=False)


def filled_with_means(rows: DataFrame, vector: str, width: int) -> DataFrame:
    """Null and NaN entries of an array replaced by the entry's mean over all rows."""
    means = rows.agg(*[F.avg(F.nanvl(F.col(vector)[i], F.lit(None).cast("double"))).alias(f"m{i}") for i in range(width)])
    fill = F.array(*[F.coalesce(F.nanvl(F.col(vector)[i], F.lit(None).cast("double")), F.col(f"m{i}"), F.lit(0.0)) for i in range(width)])
    return rows.join(F.broadcast(means)).withColumn(vector, fill).drop(*[f"m{i}" for i in range(width)])
