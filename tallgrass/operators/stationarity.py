"""Do accounts' series wander or return? Panel tests with block draws that all accounts share.

Series lie on one grid of times. Every draw takes the same blocks of time for all accounts, so that what they have in
common stays in the draws; statistics per account and draw are averaged over accounts, and only draws reach the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallgrass.operators.models import break_point

DRAWS = 199
LEAST_TIMES = 8
FLAT = 1e-10  # a series whose spread is below this share of the greatest is degenerate


def block_length(times: int) -> int:
    """Cube root of the number of times, at least two."""
    return max(2, round(times ** (1 / 3)))


def shared_blocks(times: int, draws: int, block: int, seed: int = 0) -> np.ndarray:
    """(draws, times) places of whole blocks; the same for every account."""
    rng = np.random.default_rng(seed)
    starts = rng.integers(0, times - block + 1, (draws, -(-times // block)))
    return (starts[:, :, None] + np.arange(block)).reshape(draws, -1)[:, :times]


def _slope_t(x: np.ndarray, d: np.ndarray, column: int) -> np.ndarray:
    """t values of one coefficient in many regressions at once: x (series, times, regressors), d (series, times)."""
    inverse = np.linalg.pinv(np.einsum("rni,rnk->rik", x, x), hermitian=True)
    beta = np.einsum("rik,rnk,rn->ri", inverse, x, d)
    rest = d - np.einsum("rni,ri->rn", x, beta)
    var = (rest * rest).sum(1) / max(x.shape[1] - x.shape[2], 1) * inverse[:, column, column]
    return beta[:, column] / np.sqrt(np.maximum(var, 1e-300))


def unit_roots(y: np.ndarray) -> np.ndarray:
    """Dickey-Fuller t with a constant and one lagged difference, of each row of a matrix of series."""
    d = np.diff(y, axis=1)
    x = np.stack([np.ones_like(d[:, 1:]), y[:, 1:-1], d[:, :-1]], axis=2)
    return _slope_t(x, d[:, 1:], 1)


def cross_augmented(y: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Dickey-Fuller t with the panel's mean, lagged and differenced, beside each series (both one row per series)."""
    d, m = np.diff(y, axis=1), np.diff(mean, axis=1)
    return _slope_t(np.stack([np.ones_like(d), y[:, :-1], mean[:, :-1], m], axis=2), d, 1)


def level_stationarity(y: np.ndarray) -> np.ndarray:
    """KPSS statistic around a level, Bartlett weights of 4 (n / 100)^(1/4) lags, of each row."""
    n = y.shape[1]
    e = y - y.mean(1, keepdims=True)
    lags = int(4 * (n / 100) ** 0.25)
    s = (e * e).sum(1) / n + sum((2 * (1 - k / (lags + 1)) * (e[:, k:] * e[:, :-k]).sum(1) / n for k in range(1, lags + 1)), np.zeros(len(y)))
    return (np.cumsum(e, axis=1) ** 2).sum(1) / (n * n * np.maximum(s, 1e-300))


def balanced(states: DataFrame, key: str, at: str, value: str, times: Sequence[int]) -> DataFrame:
    """(key, y): values at all the times of a list, for the keys that have every one of them."""
    rows = states.where(F.col(at).isin(*times) & F.col(value).isNotNull()).groupBy(key, at).agg(F.avg(value).alias("_v"))
    lists = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(at, "_v"))).alias("_l"))
    return lists.where(F.size("_l") == len(times)).select(key, F.transform("_l", lambda r: r["_v"]).alias("y"))


def panel_statistics(series: DataFrame, key: str, times: int, draws: int = DRAWS, seed: int = 0) -> DataFrame:
    """(test, statistic, p, accounts) for adf, cips and kpss: means over accounts, against (1 + hits) / (1 + draws).

    Under a unit root (adf, cips) differences are drawn, centred, and summed up again; under stationarity (kpss) deviations
    from the mean are. Degenerate series are left out; fewer than ``LEAST_TIMES`` times show nothing and give no rows.
    """
    if times < LEAST_TIMES:
        return series.sparkSession.createDataFrame([], "test string, statistic double, p double, accounts bigint")
    block = block_length(times)
    picks, deviations = shared_blocks(times - 1, draws, min(block, times - 1), seed), shared_blocks(times, draws, block, seed + 1)
    spread = series.select(key, "y", (F.array_max("y") - F.array_min("y")).alias("_r"))
    top = spread.agg(F.max("_r")).first()[0] or 0.0
    used = spread.where(F.col("_r") > FLAT * top).drop("_r")
    place = used.select(F.posexplode("y").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("v")).orderBy("i").collect()  # a row per time
    mean = np.array([r["v"] for r in place])
    if not len(mean):
        return series.sparkSession.createDataFrame([], "test string, statistic double, p double, accounts bigint")
    drift = np.diff(mean) - np.diff(mean).mean()
    means = np.concatenate([np.zeros((draws, 1)), np.cumsum(drift[picks], axis=1)], axis=1)

    def run(batches):
        sums, n = np.zeros((3, draws + 1)), 0
        for b in batches:
            for y in map(np.asarray, b["y"]):
                d, e = np.diff(y) - np.diff(y).mean(), y - y.mean()
                walks = y[0] + np.concatenate([np.zeros((draws, 1)), np.cumsum(d[picks], axis=1)], axis=1)
                every = np.vstack([y, walks])
                sums[0] += unit_roots(every)
                sums[1] += cross_augmented(every, np.vstack([mean, means]))
                sums[2] += level_stationarity(np.vstack([y, e[deviations]]))
                n += 1
        yield pd.DataFrame({"test": np.repeat(["adf", "cips", "kpss"], draws + 1), "draw": np.tile(np.arange(draws + 1), 3), "s": sums.ravel(), "n": n})

    found = used.mapInPandas(run, "test string, draw int, s double, n bigint").groupBy("test", "draw").agg((F.sum("s") / F.sum("n")).alias("m"), F.sum("n").alias("n"))
    own = F.max(F.when(F.col("draw") == 0, F.col("m"))).over(Window.partitionBy("test"))
    hit = F.when(F.col("test") == "kpss", F.col("m") >= F.col("_own")).otherwise(F.col("m") <= F.col("_own"))
    return found.withColumn("_own", own).groupBy("test").agg(F.max("_own").alias("statistic"), ((1 + F.count_if(hit & (F.col("draw") > 0))) / (1 + draws)).alias("p"), F.max("n").alias("accounts"))


def verdict(tests: dict[str, float], level: float = 0.05) -> str:
    """What unit-root and stationarity tests say together: stationary, unit root, both rejected, or undecided."""
    root, level_test = min(tests["adf"], tests["cips"]) <= level, tests["kpss"] <= level
    return {(True, False): "stationary", (False, True): "unit root", (True, True): "both rejected", (False, False): "undecided"}[root, level_test]


def common_break(series: DataFrame, key: str) -> tuple[int, float]:
    """(place, t) of the clearest break of the panel's mean."""
    mean = [r["v"] for r in series.select(F.posexplode("y").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("v")).orderBy("i").collect()]  # a row per time
    return break_point(np.array(mean, float))


def drift_and_diffusion(curve: Sequence[tuple[float, float, float]]) -> tuple[float, float]:
    """(diffusion, drift speed) of mean squared displacements (lag, value, weight): 2 D lag + v^2 lag^2 with neither part
    below zero, by weighted least squares."""
    lag, y, w = (np.array(c, float) for c in zip(*curve))
    x = np.column_stack([2 * lag, lag * lag])
    best = None
    for use in ((0, 1), (0,), (1,), ()):
        b = np.zeros(2)
        if use:
            s = x[:, use] * np.sqrt(w)[:, None]
            b[list(use)] = np.linalg.lstsq(s, y * np.sqrt(w), rcond=None)[0]
        loss = float((w * (y - x @ b) ** 2).sum())
        if (b >= 0).all() and (best is None or loss < best[0] - 1e-15):
            best = (loss, b)
    return float(best[1][0]), float(np.sqrt(best[1][1]))
