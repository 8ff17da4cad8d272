"""Trajectories in several dimensions under a linear observation model: block priors, smoothing, and joint fitting.

A cell (account, time, target) shows the product of the account's coordinates at the time and the target's loading.
Cells meet loadings by a join and are summed to one small block per account and time; accounts are then smoothed each
on its own, all at once, and loadings are solved from sums per target. Only loadings and states travel between steps.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallgrass.operators.models import prior_block
from tallgrass.operators.numeric import normal_cdf
from tallgrass.staging import settle

DAMPING = 0.6
RIDGE = 1.0


def assembled(kinds: Sequence[str], dt: float, taus: Sequence[float], scales: Sequence[float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(transition, noise, readout) of the dimensions' priors as diagonal blocks; the readout picks each block's level."""
    parts = [prior_block(k, dt, t, s) for k, t, s in zip(kinds, taus, scales)]
    sizes = [a.shape[0] for a, _ in parts]
    n = sum(sizes)
    move, noise, read = np.zeros((n, n)), np.zeros((n, n)), np.zeros((len(parts), n))
    at = 0
    for i, ((a, q), size) in enumerate(zip(parts, sizes)):
        move[at : at + size, at : at + size], noise[at : at + size, at : at + size], read[i, at] = a, q, 1.0
        at += size
    return move, noise, read


def smooth_blocks(times: np.ndarray, precision: np.ndarray, shift: np.ndarray, kinds: Sequence[str], taus: Sequence[float], scales: Sequence[float], start: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(filtered means, smoothed means, smoothed covariances) of the levels from each time's information: ``precision``
    (time, K, K) and ``shift`` (time, K), sums over the cells of w w' p and of w y p."""
    _, _, read = assembled(kinds, 1.0, taus, scales)
    n = read.shape[1]
    mean, cov = np.zeros(n), np.eye(n) * start
    filtered, predicted, moves = [], [], []
    for i in range(len(times)):
        move = np.eye(n)
        if i:
            move, noise, _ = assembled(kinds, float(times[i] - times[i - 1]), taus, scales)
            mean, cov = move @ mean, move @ cov @ move.T + noise
        predicted.append((mean, cov))
        moves.append(move)
        # (C^-1 + R' J R)^-1 without inverting C, which may be singular
        gain = np.linalg.solve(np.eye(n) + cov @ read.T @ precision[i] @ read, np.eye(n))
        new = gain @ cov
        mean, cov = gain @ mean + new @ read.T @ shift[i], (new + new.T) / 2
        filtered.append((mean, cov))
    out = [filtered[-1]]
    for i in range(len(times) - 2, -1, -1):
        m, p = filtered[i]
        g = p @ moves[i + 1].T @ np.linalg.pinv(predicted[i + 1][1], hermitian=True)
        out.append((m + g @ (out[-1][0] - predicted[i + 1][0]), p + g @ (out[-1][1] - predicted[i + 1][1]) @ g.T))
    out.reverse()
    return np.array([read @ m for m, _ in filtered]), np.array([read @ m for m, _ in out]), np.array([read @ p @ read.T for _, p in out])


def _dot(a: str, b: str, n: int) -> Column:
    return sum((F.get(F.col(a), F.lit(i)) * F.get(F.col(b), F.lit(i)) for i in range(1, n)), F.get(F.col(a), F.lit(0)) * F.get(F.col(b), F.lit(0)))


def inferred(cells: DataFrame, loadings: DataFrame, dims: int, kinds: Sequence[str], taus: Sequence[float], scales: Sequence[float]) -> DataFrame:
    """(account, t, z, causal, cov): states under loadings (target, w, b) that stay as they are.

    ``cells`` has account, t, target, y and p (precision). An account's times are its own group, one row each.
    """
    j = cells.join(loadings, "target")
    at = lambda i: F.get("w", F.lit(i))
    pairs = [(i, k) for i in range(dims) for k in range(i, dims)]
    sums = j.groupBy("account", "t").agg(F.array(*[F.sum(F.col("p") * at(i) * at(k)) for i, k in pairs]).alias("j"), F.array(*[F.sum(F.col("p") * at(i) * (F.col("y") - F.col("b"))) for i in range(dims)]).alias("h"))
    kind = {f.name: f.dataType.simpleString() for f in cells.schema}

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("t")
        precision = np.zeros((len(g), dims, dims))
        flat = np.array(g["j"].tolist())
        for c, (i, k) in enumerate(pairs):
            precision[:, i, k] = precision[:, k, i] = flat[:, c]
        causal, z, cov = smooth_blocks(g["t"].to_numpy(float), precision, np.array(g["h"].tolist()), kinds, taus, scales)
        return pd.DataFrame({"account": g["account"], "t": g["t"], "z": z.tolist(), "causal": causal.tolist(), "cov": cov.reshape(len(g), -1).tolist()})

    return sums.groupBy("account").applyInPandas(run, f"account {kind['account']}, t {kind['t']}, z array<double>, causal array<double>, cov array<double>")


def refitted(cells: DataFrame, states: DataFrame, dims: int, ridge: float = RIDGE) -> DataFrame:
    """(target, w, b) by weighted least squares with an absolute ridge, the states' uncertainty counted in."""
    j = cells.join(states, ["account", "t"])
    z = lambda i: F.get("z", F.lit(i)) if i < dims else F.lit(1.0)
    size = dims + 1
    second = lambda i, k: z(i) * z(k) + (F.get("cov", F.lit(i * dims + k)) if i < dims and k < dims else F.lit(0.0))
    sums = j.groupBy("target").agg(F.array(*[F.sum(F.col("p") * second(i, k)) for i in range(size) for k in range(size)]).alias("xx"), F.array(*[F.sum(F.col("p") * z(i) * F.col("y")) for i in range(size)]).alias("xy"))
    kind = cells.schema["target"].dataType.simpleString()

    def solve(batches):
        for b in batches:
            found = [np.linalg.solve(np.reshape(np.array(x, float), (size, size)) + ridge * np.eye(size), np.array(y, float)) for x, y in zip(b["xx"], b["xy"])]
            yield pd.DataFrame({"target": b["target"], "w": pd.Series([v[:dims].tolist() for v in found], dtype=object), "b": pd.Series([float(v[dims]) for v in found], dtype=float)})

    return sums.mapInPandas(solve, f"target {kind}, w array<double>, b double")


def fitted(cells: DataFrame, dims: int, kinds: Sequence[str], taus: Sequence[float], scales: Sequence[float], passes: int = 30, tolerance: float = 1e-3, damping: float = DAMPING, ridge: float = RIDGE) -> tuple[DataFrame, DataFrame]:
    """(states, loadings), fitted together by expectation-maximisation; each pass moves the loadings by ``damping`` of the
    way and ends when none moves by more than ``tolerance``. ``passes`` without an end are an error."""
    cells = settle(cells.select("account", "t", "target", "y", "p").where("y is not null and p > 0"))
    first = F.array(*[(F.pmod(F.xxhash64(F.lit(i), "target"), F.lit(2001)) / 1000.0 - 1.0) for i in range(dims)])
    start = cells.groupBy("target").agg((F.sum(F.col("p") * F.col("y")) / F.sum("p")).alias("b"))
    loadings = settle(start.select("target", first.alias("w"), "b"))
    for _ in range(passes):
        states = settle(inferred(cells, loadings, dims, kinds, taus, scales))
        new = refitted(cells, states, dims, ridge).withColumnsRenamed({"w": "_w", "b": "_b"})
        both = loadings.join(new, "target")
        mixed = lambda a, b: (1 - damping) * a + damping * b
        moved = settle(both.select("target", F.zip_with("w", "_w", mixed).alias("w"), mixed(F.col("b"), F.col("_b")).alias("b"), F.aggregate(F.zip_with("w", "_w", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda a, b: F.greatest(a, b)).alias("_d")))
        loadings = moved.drop("_d")
        if (moved.agg(F.max("_d")).first()[0] or 0.0) * damping <= tolerance:
            return settle(inferred(cells, loadings, dims, kinds, taus, scales)), loadings
    raise RuntimeError(f"the loadings do not settle within {passes} passes")


def whitened(states: DataFrame, loadings: DataFrame, dims: int) -> tuple[DataFrame, DataFrame]:
    """States of unit covariance whose axes are ordered by the energy of the loadings; their products stay the same.

    The two small matrices behind it come from one aggregation each.
    """
    z = lambda i: F.get("z", F.lit(i))
    m = states.agg(*[F.avg(z(i)) for i in range(dims)], *[F.avg(z(i) * z(k)) for i in range(dims) for k in range(dims)]).first()
    mean = np.array(m[:dims], float)
    cov = np.array(m[dims:], float).reshape(dims, dims) - np.outer(mean, mean)
    values, axes = np.linalg.eigh(cov)
    root = axes * np.sqrt(np.maximum(values, 1e-12))  # cov = root root'
    w = lambda i: F.get("w", F.lit(i))
    second = np.array(loadings.agg(*[F.sum(w(i) * w(k)) for i in range(dims) for k in range(dims)]).first(), float).reshape(dims, dims)
    energy, turn = np.linalg.eigh(root.T @ second @ root)
    turn = turn[:, ::-1]
    forward, back = (root @ turn).T, turn.T @ np.linalg.inv(root)  # w' = forward w, z' = back (z - mean)
    times = lambda matrix, c: F.array(*[sum((F.get(F.col(c), F.lit(k)) * float(matrix[i, k]) for k in range(1, dims)), F.get(F.col(c), F.lit(0)) * float(matrix[i, 0])) for i in range(dims)])
    moved = states.withColumn("z", F.transform("z", lambda x, i: x - F.get(F.array(*[F.lit(float(v)) for v in mean]), i)))
    offset = sum((F.get("w", F.lit(i)) * float(mean[i]) for i in range(1, dims)), F.get("w", F.lit(0)) * float(mean[0]))
    return moved.withColumn("z", times(back, "z")), loadings.select("target", times(forward, "w").alias("w"), (F.col("b") + offset).alias("b"))


def predicted(cells: DataFrame, states: DataFrame, loadings: DataFrame, dims: int, threshold: float, noise: float) -> DataFrame:
    """``cells`` with p_neg, p_neu and p_pos by an ordered probit around the product of state and loading, widened by the
    state's own uncertainty."""
    j = cells.join(states.select("account", "t", "z", "cov"), ["account", "t"]).join(loadings, "target")
    spread = sum((F.get("w", F.lit(i)) * F.get("w", F.lit(k)) * F.get("cov", F.lit(i * dims + k)) for i in range(dims) for k in range(dims)), F.lit(0.0))
    return with_chances(j.withColumns({"_m": _dot("z", "w", dims) + F.col("b"), "_s": F.sqrt(spread + noise * noise)}), "_m", "_s", threshold).drop("z", "cov", "w", "b", "_m", "_s")


def with_chances(rows: DataFrame, mean: str, sd: str, threshold: float) -> DataFrame:
    """``rows`` with the chances that a normal falls below, between and above -threshold and threshold."""
    low, high = normal_cdf((-threshold - F.col(mean)) / F.col(sd)), normal_cdf((threshold - F.col(mean)) / F.col(sd))
    return rows.withColumns({"p_neg": low, "p_neu": high - low, "p_pos": 1 - high})


def lattice_points(resolution: int) -> list[tuple[float, float, float]]:
    return [(i / resolution, j / resolution, (resolution - i - j) / resolution) for i in range(resolution + 1) for j in range(resolution + 1 - i)]


def observed_counts(cells: DataFrame, resolution: int, how: str, channel: Sequence[Sequence[float]] | None = None) -> DataFrame:
    """``cells`` with n_against, n_neutral and n_favor from its lattice counts q0..: ``hard`` by each point's greatest
    probability (ties: the first), ``soft`` by the probabilities themselves, ``channel`` by the chances ``channel[k]`` of
    true labels given the hard label k."""
    names = ("n_against", "n_neutral", "n_favor")
    shares = []
    for p in lattice_points(resolution):
        top = max(range(3), key=lambda k: (p[k], -k))
        shares.append(p if how == "soft" else tuple(float(k == top) for k in range(3)) if how == "hard" else tuple(channel[top]))
    total = lambda k: sum((F.coalesce(F.col(f"q{i}"), F.lit(0.0)) * float(s[k]) for i, s in enumerate(shares) if s[k]), F.lit(0.0))
    return cells.withColumns({name: total(k) for k, name in enumerate(names)})


def mixture_counts(cells: DataFrame, resolution: int, prior: Sequence[str]) -> DataFrame:
    """``cells`` with the labels expected behind its lattice counts under each row's own label chances (three columns), and
    ``loglik``: a point with probabilities p stands for label k with weight p_k times the chance of k."""
    pi = [F.col(c) for c in prior]
    names = ("n_against", "n_neutral", "n_favor")
    parts, fit = {n: F.lit(0.0) for n in names}, F.lit(0.0)
    for i, p in enumerate(lattice_points(resolution)):
        whole = sum((c * v for c, v in zip(pi, p) if v), F.lit(0.0))
        q = F.coalesce(F.col(f"q{i}"), F.lit(0.0))
        for n, c, v in zip(names, pi, p):
            if v:
                parts[n] = parts[n] + q * c * v / F.greatest(whole, F.lit(1e-300))
        fit = fit + q * F.log(F.greatest(whole, F.lit(1e-300)))
    return cells.withColumns(parts | {"loglik": fit})
