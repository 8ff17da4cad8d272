"""Panel and model operators without SQL against small worked cases."""

from __future__ import annotations

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallgrass.operators import clusters, models, panel


def test_balanced_panel_beats_no_candidate(spark):
    rng = random.Random(4)
    spans = {i: sorted(rng.sample(range(40), 2)) for i in range(30)}
    df = spark.createDataFrame([(i, t) for i, (a, b) in spans.items() for t in (a, b)], "k int, t int")
    got = panel.balanced_panel(df, "k", "t").first()
    count = sum(a <= got["start"] and b >= got["end"] for a, b in spans.values())
    assert got["accounts"] == count and got["size"] == count * (got["end"] - got["start"] + 1)
    starts, ends = np.quantile([a for a, _ in spans.values()], np.linspace(0, 1, 21)), np.quantile([b for _, b in spans.values()], np.linspace(0, 1, 21))
    best = max(sum(a <= math.ceil(s) and b >= math.floor(e) for a, b in spans.values()) * (math.floor(e) - math.ceil(s) + 1) for s, e in itertools.product(starts, ends) if e > s)
    assert got["size"] == best
    assert panel.balanced_panel(df.limit(0), "k", "t").count() == 0


def test_hidden_chain_finds_sticky_states(spark):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(30):
        state = rng.integers(2)
        for t in range(40):
            state = state if rng.random() < 0.95 else 1 - state
            rows.append((k, t, int(rng.choice(2, p=[0.9, 0.1] if state == 0 else [0.1, 0.9]))))
    _, move, emit = panel.hidden_chain(spark.createDataFrame(rows, "k int, t int, s int"), "k", ["t"], "s", 2, passes=15)
    assert np.allclose(move.sum(1), 1) and np.allclose(emit.sum(1), 1)
    assert np.diag(move).min() > 0.85 and abs(emit[0, 0] - emit[1, 0]) > 0.6


def test_factor_model_fills_a_low_rank_table(spark):
    rng = np.random.default_rng(0)
    z, w, c = rng.normal(size=(25, 2)), rng.normal(size=(12, 2)), rng.normal(size=12)
    full = z @ w.T + c
    rows = [(f"a{i}", f"t{j}", float(full[i, j]), 50.0) for i in range(25) for j in range(12) if rng.random() < 0.8]
    got = panel.imputed(spark.createDataFrame(rows, "a string, t string, y double, n double"), "a", "t", "y", "n", passes=25).collect()
    assert len(got) == 300
    errors = [abs(r["value"] - full[int(r["a"][1:]), int(r["t"][1:])]) for r in got if not r["known"]]
    assert np.median(errors) < 0.25 * full.std()


def test_probit_grid_finds_the_threshold(spark):
    rng = np.random.default_rng(2)
    rows = []
    for x in rng.normal(size=300):
        s = x + rng.normal(size=20)
        rows.append((float(x), float((s < -0.5).sum()), float((abs(s) <= 0.5).sum()), float((s > 0.5).sum())))
    fit = {r["threshold"]: r["loglik"] for r in panel.probit_fit(spark.createDataFrame(rows, "x double, a double, n double, f double"), "x", "a", "n", "f", [0.2, 0.5, 1.0]).collect()}
    assert max(fit, key=fit.get) == 0.5


def test_unit_root_break_and_stationarity(spark):
    rng = np.random.default_rng(1)
    walk, noise = np.cumsum(rng.normal(size=200)), rng.normal(size=200)
    assert models.unit_root(noise) < -5 < models.unit_root(walk)
    assert models.stationarity(noise) < 0.5 < models.stationarity(walk)
    series = [(k, t, float(v)) for k, y in (("noise", noise), ("walk", walk), ("flat", np.ones(30)), ("short", noise[:5])) for t, v in enumerate(y)]
    tests = {r["k"]: r for r in models.panel_tests(spark.createDataFrame(series, "k string, t int, v double"), "k", "t", "v").collect()}
    assert tests["noise"]["adf_p"] <= 0.05 < tests["walk"]["adf_p"] and tests["walk"]["kpss_p"] <= 0.01 < tests["noise"]["kpss_p"]
    assert all(tests[k]["adf_p"] is None or math.isnan(tests[k]["adf_p"]) for k in ("flat", "short"))
    step = rng.normal(size=120) * 0.2 + (np.arange(120) > 70) * 5
    place, _ = models.break_point(step)
    assert abs(place - 70) <= 3
    assert math.isnan(models.unit_root(np.ones(30))) and models.break_point(np.ones(30))[0] == -1


def test_eps_with_most_right_pairs(spark):
    rng = np.random.default_rng(5)
    centres = np.eye(4)
    rows = [(i, [float(x) for x in centres[i % 4] + rng.normal(size=4) * 0.05]) for i in range(40)] + [(99, None), (98, [float("nan")] * 4)]
    df = spark.createDataFrame(rows, "id bigint, v array<double>")
    pairs = spark.createDataFrame([(i, j, i % 4 == j % 4) for i in range(8) for j in range(i + 1, 8)], "a bigint, b bigint, same boolean")
    got = {r["eps"]: r["accuracy"] for r in clusters.choose_eps(df, "id", "v", pairs, [0.00001, 0.1, 1.5]).collect()}
    assert got[0.1] == 1.0 and got[1.5] < 1.0 and got[0.00001] < 1.0


def test_forecast_falls_back_and_text_helpers(spark):
    assert models.damped_trend(np.array([1.0, 2.0, 3.0, 4.0, 5.0]), 3) == pytest.approx(7, abs=1.5)
    df = spark.createDataFrame([("one two three four", "Sure, here is the answer: \"The park\"", "le parc"), ("one", "As an AI I cannot", "x")], "t string, r string, q string")
    got = [tuple(r) for r in df.select(panel.token_cut(F.col("t"), 2), panel.clean_reply(F.col("r"), F.col("q"))).collect()]
    assert got == [("one two", "park"), ("one", None)]
