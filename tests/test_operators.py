"""Operators without SQL against brute force."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallgrass.operators import clusters, joins, models, reduction, sampling
from tallgrass.sources import files, search_index


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)] + [(7, 7)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            ra, rb = root(a), root(b)
            parent[max(ra, rb)] = min(ra, rb)
    want = {x: min(y for y in parent if root(y) == root(x)) for x in parent}
    got = {r["node"]: r["component"] for r in clusters.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == want


def test_near_duplicates_lose_no_link(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    base = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(8)]
    texts = []
    for i, t in enumerate(base):
        texts += [t, t]
        for _ in range(4):
            w = t.split()
            w[rng.randrange(60)] = "zz"
            texts.append(" ".join(w))
    texts += ["one two", "one two", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc bigint, text string")
    got = {r["doc"]: (r["class_id"], r["links"]) for r in clusters.near_duplicates(df, "doc", "text").collect()}

    def shingles(t):
        w = t.split()
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))

    sets = {i: shingles(t) for i, t in enumerate(texts) if t}
    assert set(got) == set(sets)
    for i, s in sets.items():
        others = {o for o in sets.values() if o != s and len(s & o) / len(s | o) >= 0.8}
        assert got[i][1] == len(others)
    for i, j in itertools.combinations(sets, 2):
        if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
            assert got[i][0] == got[j][0]


def test_lag_pairs_equal_all_pairs(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), rng.randrange(-20, 60)) for _ in range(80)]
    got = sorted((r["k"], r["t"], r["lag"]) for r in joins.lag_pairs(spark.createDataFrame(rows, "k string, t bigint"), ["k"], "t", 7).collect())
    want = sorted((a[0], a[1], b[1] - a[1]) for a in rows for b in rows if a[0] == b[0] and 0 < b[1] - a[1] <= 7)
    assert got == want


def test_lists_of_different_length_raise(spark):
    df = spark.createDataFrame([(1, ["a"], [1, 2])], "i int, a array<string>, b array<int>")
    with pytest.raises(Exception, match="differ in length"):
        joins.explode_together(df, ["a", "b"], ["i"]).collect()


def test_quotas_are_even_and_within_capacity():
    for counts, total in (({"a": 3, "b": 100, "c": 50}, 40), ({"a": 1, "b": 1}, 10), ({}, 5), ({"a": 7, "b": 7, "c": 7}, 8)):
        q = sampling.quotas(counts, total)
        assert sum(q.values()) == min(total, sum(counts.values()))
        assert all(q[k] <= counts[k] for k in counts)
        open_ = [q[k] for k in counts if q[k] < counts[k]]
        assert not open_ or max(q.values()) - min(open_) <= 1


def test_smoother_equals_the_dense_posterior():
    rng = np.random.default_rng(0)
    t = np.cumsum(rng.integers(1, 4, 12)).astype(float)
    y = rng.normal(size=12)
    y[3] = np.nan
    noise = rng.uniform(0.5, 1.5, 12)
    _, level, sd = models.smooth(t, y, noise, "wiener", scale=0.3, start=2.0)
    prior = 2.0 + 0.3 * (np.minimum.outer(t, t) - t[0])
    seen = ~np.isnan(y)
    k = prior[:, seen] @ np.linalg.inv(prior[np.ix_(seen, seen)] + np.diag(noise[seen]))
    assert np.allclose(level, k @ y[seen])
    assert np.allclose(sd**2, np.diag(prior - k @ prior[seen]))


def test_plain_numbers_equal_matrices(monkeypatch):
    rng = np.random.default_rng(4)
    t, y, r = np.cumsum(rng.integers(1, 5, 30)).astype(float), rng.normal(size=30), rng.uniform(0.2, 2, 30)
    y[[2, 9]] = np.nan
    for kind in ("const", "wiener", "ou"):
        fast = models.smooth(t, y, r, kind, 5.0, 0.4, 3.0)
        with monkeypatch.context() as m:
            block = models.prior_block
            m.setattr(models, "prior_block", lambda k, *a, kind=kind: block(kind, *a))
            slow = models.smooth(t, y, r, "matrix", 5.0, 0.4, 3.0)
        for a, b in zip(fast, slow):
            assert np.allclose(a, b)


@pytest.mark.parametrize("kind", ["const", "wiener", "iwp2", "ou", "matern32"])
def test_priors_compose(kind):
    a1, q1 = models.prior_block(kind, 0.7, 2.0, 0.4)
    a2, q2 = models.prior_block(kind, 1.4, 2.0, 0.4)
    assert np.allclose(a2, a1 @ a1) and np.allclose(q2, a1 @ q1 @ a1.T + q1)


def test_principal_components(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 4)) @ np.diag([3, 2, 1, 0.1])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "i int, v array<double>")
    m = reduction.principal(df, "v", 4, 2)
    c = np.cov(x.T, bias=True)
    assert np.allclose(m["explained"], np.linalg.eigvalsh(c)[::-1][:2] / np.trace(c))
    assert np.allclose(m["components"] @ m["components"].T, np.eye(2), atol=1e-9)
    got = np.array([r["p"] for r in df.select("i", reduction.project(F.col("v"), m).alias("p")).orderBy("i").collect()])
    assert np.allclose(got, (x - x.mean(0)) @ m["components"].T)


def test_search_halves_full_windows():
    calls = []

    def client(low, high, limit):
        calls.append((low, high))
        return [(i,) for i in range(low, high)][:limit]

    assert [r[0] for r in search_index.bisected(client, 0, 1000, 64)] == list(range(1000))
    waits = []

    def flaky():
        if len(waits) < 2:
            raise search_index.Refused(503)
        return "done"

    assert search_index.with_retries(flaky, sleep=waits.append) == "done" and waits == [1.0, 2.0]
    with pytest.raises(search_index.Refused):
        search_index.with_retries(lambda: (_ for _ in ()).throw(search_index.Refused(404)), sleep=waits.append)


def test_config_key_ignores_order_and_unread_fields():
    assert files.config_key({"a": 1, "b": {"c": 2}}) == files.config_key({"b": {"c": 2.0}, "a": 1.0})
    assert files.config_key({"a": 1, "x": 2}, ["a"]) == files.config_key({"a": 1}, ["a"])
    assert files.config_key({"a": 1}) != files.config_key({"a": 2})


def test_tolerant_scan(spark, tmp_path):
    good, bad = str(tmp_path / "good"), tmp_path / "bad.parquet"
    spark.range(5).write.parquet(good)
    bad.write_bytes(b"not parquet")
    with pytest.warns(UserWarning):
        assert files.scan_tolerant(spark, [good, str(bad), str(tmp_path / "none")]).count() == 5
    assert files.scan(spark, good, columns=["id", "other"]).columns == ["id", "other"]
