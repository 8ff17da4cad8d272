"""Latent trajectories, panel tests, special functions and resampling against closed forms and brute force."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallgrass.operators import latent, numeric, resampling, scores, stationarity
from tallgrass.operators.models import prior_block

KINDS, TAUS, SCALES = ["wiener", "ou", "matern32"], [10.0, 5.0, 8.0], [0.3, 1.2, 0.7]


def test_smoothing_is_the_conditional_mean_of_the_joint_normal():
    rng = np.random.default_rng(3)
    times = np.array([0.0, 1.0, 2.5, 7.0])
    loads = [rng.normal(size=(rng.integers(0, 4), 3)) for _ in times]
    y = [w @ rng.normal(size=3) + rng.normal(size=len(w)) for w in loads]
    precision = np.array([w.T @ w / 0.5 for w in loads])
    shift = np.array([w.T @ v / 0.5 for w, v in zip(loads, y)])
    causal, level, cov = latent.smooth_blocks(times, precision, shift, KINDS, TAUS, SCALES, start=2.0)
    _, _, read = latent.assembled(KINDS, 1.0, TAUS, SCALES)
    n = read.shape[1]
    joint, at = np.zeros((4 * n, 4 * n)), np.eye(n) * 2.0
    joint[:n, :n] = at
    for i in range(1, 4):
        move, noise, _ = latent.assembled(KINDS, times[i] - times[i - 1], TAUS, SCALES)
        joint[i * n : (i + 1) * n, : i * n] = move @ joint[(i - 1) * n : i * n, : i * n]
        joint[: i * n, i * n : (i + 1) * n] = joint[i * n : (i + 1) * n, : i * n].T
        at = move @ at @ move.T + noise
        joint[i * n : (i + 1) * n, i * n : (i + 1) * n] = at
    for upto, got in ((4, level), (2, causal[:2])):
        h = np.vstack([np.hstack([loads[i] @ read if k == i else np.zeros((len(loads[i]), n)) for k in range(4)]) for i in range(upto)])
        gain = joint @ h.T @ np.linalg.inv(h @ joint @ h.T + 0.5 * np.eye(len(h)))
        mean, after = gain @ np.concatenate(y[:upto]), joint - gain @ h @ joint
        want = [read @ mean[i * n : (i + 1) * n] for i in range(4)]
        assert np.allclose(got[-1], want[upto - 1])
        if upto == 4:
            assert np.allclose(level, want)
            assert np.allclose(cov, [read @ after[i * n : (i + 1) * n, i * n : (i + 1) * n] @ read.T for i in range(4)])


def test_prior_blocks_over_two_steps_are_one_step():
    for kind in ("const", "wiener", "iwp2", "ou", "matern32"):
        (a1, q1), (a2, q2), (a, q) = (prior_block(kind, d, 4.0, 0.6) for d in (1.0, 2.0, 3.0))
        assert np.allclose(a2 @ a1, a) and np.allclose(a2 @ q1 @ a2.T + q2, q)


def sample(spark, seed=1):
    rng = np.random.default_rng(seed)
    w = rng.normal(size=(25, 2)) * [2.0, 0.7]
    rows = []
    for a in range(12):
        z = np.cumsum(rng.normal(size=(15, 2)) * 0.3, axis=0) + rng.normal(size=2)
        for t in range(15):
            for j in rng.choice(25, 12, replace=False):
                rows.append((f"a{a}", t, f"t{j}", float(z[t] @ w[j] + 0.5 + rng.normal() * 0.3), 1 / 0.09))
    return spark.createDataFrame(rows, "account string, t int, target string, y double, p double"), rows


def test_joint_fit_explains_the_cells_and_whitening_keeps_it(spark):
    df, rows = sample(spark)
    states, loadings = latent.fitted(df, 2, ["wiener"] * 2, [1.0] * 2, [0.1] * 2, passes=200, tolerance=5e-3)

    def guess(s, w):
        z = {(r["account"], r["t"]): np.array(r["z"]) for r in s.collect()}
        load = {r["target"]: (np.array(r["w"]), r["b"]) for r in w.collect()}
        return np.array([z[a, t] @ load[j][0] + load[j][1] for a, t, j, _, _ in rows]), np.array(list(z.values())), load

    fit, _, _ = guess(states, loadings)
    y = np.array([r[3] for r in rows])
    assert ((fit - y) ** 2).mean() < 0.15 < y.var() / 10
    white, turned = latent.whitened(states, loadings, 2)
    same, z, load = guess(white, turned)
    assert np.allclose(same, fit, atol=1e-6)
    assert np.allclose(np.cov(z.T, bias=True), np.eye(2), atol=1e-6)
    energy = sum(w * w for w, _ in load.values())
    assert energy[0] >= energy[1]
    again = {(r["account"], r["t"]): r["z"] for r in latent.inferred(df, loadings, 2, ["wiener"] * 2, [1.0] * 2, [0.1] * 2).collect()}
    assert all(np.allclose(again[r["account"], r["t"]], r["z"]) for r in states.collect())
    chances = latent.predicted(df, states, loadings, 2, 0.5, 0.3).limit(50).collect()
    assert all(abs(r["p_neg"] + r["p_neu"] + r["p_pos"] - 1) < 1e-9 for r in chances)
    with pytest.raises(RuntimeError):
        latent.fitted(df, 2, ["wiener"] * 2, [1.0] * 2, [0.1] * 2, passes=1, tolerance=1e-9)


def panel(spark, phi):
    rng = np.random.default_rng(8)
    rows = []
    for a in range(20):
        x = 0.0
        for t in range(60):
            x = phi * x + rng.normal()
            rows.append((f"a{a}", t, x))
    rows += [("flat", t, 1.0) for t in range(60)] + [("short", t, 1.0) for t in range(59)]
    df = spark.createDataFrame(rows, "k string, t int, x double")
    return stationarity.balanced(df, "k", "t", "x", range(60))


@pytest.mark.parametrize("phi, found", [(0.3, "stationary"), (1.0, "unit root")])
def test_panel_tests_tell_walks_from_returning_series(spark, phi, found):
    series = panel(spark, phi)
    assert series.count() == 21
    tests = {r["test"]: r for r in stationarity.panel_statistics(series, "k", 60).collect()}
    assert {r["accounts"] for r in tests.values()} == {20}
    p = {k: r["p"] for k, r in tests.items()}
    assert all(1 / 200 <= v <= 1 for v in p.values())
    assert stationarity.verdict(p) == found
    again = {r["test"]: r["p"] for r in stationarity.panel_statistics(series.repartition(3), "k", 60).collect()}
    assert again == p
    assert stationarity.panel_statistics(series.limit(0), "k", 60).count() == 0
    assert stationarity.panel_statistics(series, "k", 5).count() == 0


def test_statistics_of_many_series_equal_those_of_one():
    from tallgrass.operators.models import stationarity as one_kpss
    from tallgrass.operators.models import unit_root

    y = np.cumsum(np.random.default_rng(2).normal(size=(5, 40)), axis=1)
    assert np.allclose(stationarity.unit_roots(y), [unit_root(v) for v in y])
    assert np.allclose(stationarity.level_stationarity(y), [one_kpss(v) for v in y])


def test_drift_and_diffusion():
    lags = range(1, 9)
    d, v = stationarity.drift_and_diffusion([(k, 2 * 0.7 * k + 0.09 * k * k, 5.0) for k in lags])
    assert (d, v) == (pytest.approx(0.7), pytest.approx(0.3))
    assert stationarity.drift_and_diffusion([(k, 4.0 * k - 0.1 * k * k, 1.0) for k in lags])[1] == 0.0


def test_special_functions(spark):
    xs = [-8.0, -3.0, -0.5, 0.0, 0.2, 1.0, 2.5, 6.0]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", numeric.normal_cdf(F.col("x")).alias("c"), numeric.log_interval(F.col("x"), F.col("x") + 0.5).alias("l")).collect()
    for r in got:
        assert r["c"] == pytest.approx(0.5 * math.erfc(-r["x"] / math.sqrt(2)), rel=2e-7)
        a, b = sorted((abs(r["x"]), abs(r["x"] + 0.5))) if r["x"] >= 0 or r["x"] + 0.5 <= 0 else (None, None)
        if a is not None:
            assert r["l"] == pytest.approx(math.log(0.5 * (math.erfc(a / math.sqrt(2)) - math.erfc(b / math.sqrt(2)))), abs=1e-5)
    gs = [0.1, 0.5, 1.0, 2.0, 7.3, 50.0, 1e6]
    for r in spark.createDataFrame([(x,) for x in gs], "x double").select("x", numeric.log_gamma(F.col("x")).alias("g")).collect():
        assert r["g"] == pytest.approx(math.lgamma(r["x"]), rel=1e-11, abs=1e-11)
    for r in spark.createDataFrame([(x, k) for x in (0.5, 3.0, 20.0) for k in range(1, 9)], "x double, k int").select("x", "k", numeric.chi2_tail(F.col("x"), F.col("k")).alias("p")).collect():
        h, k = r["x"] / 2, r["k"]
        want = sum(math.exp(-h) * h**i / math.factorial(i) for i in range(k // 2)) if k % 2 == 0 else math.erfc(math.sqrt(h)) + sum(math.exp(-h) * h ** (i - 0.5) / math.gamma(i + 0.5) for i in range(1, (k + 1) // 2))
        assert r["p"] == pytest.approx(want, rel=3e-7)


@pytest.mark.parametrize("blocks", [1, 5])
def test_running_values_against_plain_ones(spark, blocks):
    rng = np.random.default_rng(4)
    rows = [(i, None if i % 9 == 0 else "hot" if i % 3 else "k", int(rng.integers(0, 20)), float(rng.integers(-5, 6))) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, k string, o int, v double")
    sums = {r["id"]: r["s"] for r in numeric.running_sums(df, ["k"], ["o", "id"], {"s": F.col("v")}, blocks).collect()}
    least = {r["id"]: r["m"] for r in numeric.running_least(df, ["k"], ["o", "id"], {"m": F.col("v")}, blocks).collect()}
    for i, k, o, _ in rows:
        before = [v for j, q, p, v in rows if q == k and (p, j) < (o, i)]
        assert sums[i] == sum(before) and least[i] == (min(before) if before else None)
    assert numeric.running_sums(df.limit(0), [], ["o"], {"s": F.lit(1)}, blocks).count() == 0


def test_exact_test_against_fractions(spark):
    rng = np.random.default_rng(6)
    tables = [(f"t{i}", *(int(x) for x in rng.integers(0, 12, 4))) for i in range(25)] + [("wide", 400, 300, 250, 420), ("zero", 0, 0, 0, 0), ("one", 0, 5, 0, 7)]
    got = {r["k"]: r["p"] for r in scores.fisher_exact(spark.createDataFrame(tables, "k string, a bigint, b bigint, c bigint, d bigint"), "a", "b", "c", "d").collect()}
    assert "zero" not in got
    for k, a, b, c, d in tables:
        if k != "zero":
            r, s, n = a + b, a + c, a + b + c + d
            ways = {x: math.comb(r, x) * math.comb(n - r, s - x) for x in range(max(0, r + s - n), min(r, s) + 1)}
            assert got[k] == pytest.approx(float(Fraction(sum(w for w in ways.values() if w <= ways[a]), math.comb(n, s))), rel=1e-6)


def test_replicates_draw_clusters_with_mean_one(spark):
    rows = spark.range(2000).select(F.col("id").alias("c"), F.lit(1.0).alias("v"))
    w = resampling.replicate_sums(rows, "c", ["v"], replicates=20).collect()
    drawn = {r["rep"]: r["v"] for r in w}
    assert drawn[0] == 2000 and all(abs(v - 2000) < 5 * math.sqrt(2000) for v in drawn.values()) and len(set(drawn.values())) > 10
    one = resampling.mean_interval(rows.withColumn("v", F.col("c") % 7 * 1.0), "c", "v").first()
    assert one["low"] < one["value"] < one["high"]
    assert resampling.mean_interval(rows.limit(0), "c", "v").first()["value"] is None


def test_partition_polarization_against_every_cut(spark):
    rng = np.random.default_rng(9)
    v = rng.normal(size=(30, 4))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id int, v array<double>")
    got = {r["side"]: r["polarization"] for r in scores.partition_polarization(df, "id", "v", 4).collect()}
    assert set(got) == {m for m in range(2, 16) if not m & 1}
    for m, p in got.items():
        y = np.sort(v[:, [i for i in range(4) if m >> i & 1]].mean(1))
        assert p == pytest.approx(max((k * y[k:].sum() - (30 - k) * y[:k].sum()) / (4 * 900) for k in range(1, 30)))
