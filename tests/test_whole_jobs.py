"""Queries do the whole job: all labels, moves, query vectors, passes and settings."""

from __future__ import annotations

import os

import numpy as np
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
if not os.path.isdir(DATA):
    pytest.skip("no test tables", allow_module_level=True)


def vectors(spark):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").orderBy("vec_id").collect()
    return np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float), np.array([r["label"] for r in rows])


def test_every_label_has_a_centre(spark):
    ids, v, labels = vectors(spark)
    names = np.unique(labels)
    d = np.linalg.norm(v[:, None] - np.array([v[labels == n].mean(0) for n in names])[None], axis=2)
    got = {r["vec_id"]: r for r in entry.queries()["nearest_centroid_all"](spark, DATA).collect()}
    assert len(got) == len(ids) and {r["centre"] for r in got.values()} == set(names.tolist())
    for i, k in enumerate(ids.tolist()):
        assert got[k]["centre"] == names[d[i].argmin()] and abs(got[k]["distance"] - d[i].min()) < 1e-3


def test_flow_field_holds_all_moves(spark):
    from tallgrass.operators import panel

    rng = np.random.default_rng(7)
    rows = [(k, t, float(rng.exponential(60)), float(rng.integers(1, 6) * 10)) for k in range(40) for t in range(8)]
    df = spark.createDataFrame(rows, "k int, t int, x double, y double")
    p = np.array([r[2:] for r in rows]).reshape(40, 8, 2)
    at, move = p[:, :-1].reshape(-1, 2), np.diff(p, axis=1).reshape(-1, 2)
    move = np.clip(move, np.percentile(move, 1, axis=0), np.percentile(move, 99, axis=0))
    low, high = at.min(0), at.max(0)
    axes = [np.linspace(a - 0.1 * (b - a), b + 0.1 * (b - a), 50) for a, b in zip(low, high)]
    want = {}
    for i, gx in enumerate(axes[0]):
        for j, gy in enumerate(axes[1]):
            d2 = ((at - [gx, gy]) ** 2).sum(1)
            k = np.exp(-d2 / 50) * (d2 <= 225)
            if (d2 <= 225).any():
                want[i, j] = (*(k @ move / (k.sum() + 1)), k.sum())
    got = {(r["i"], r["j"]): (r["dx"], r["dy"], r["weight"]) for r in panel.flow_field(df, "k", "t", "x", "y", 50, 5.0).collect()}
    assert set(got) == set(want) and max(i for i, _ in got) > 40
    assert all(np.allclose(got[c], want[c], atol=1e-6) for c in want)
    assert panel.flow_field(df.where("t = 0"), "k", "t", "x", "y", 50, 5.0).count() == 0


def test_search_answers_every_query(spark):
    from tallgrass.operators import panel

    ids, v, _ = vectors(spark)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = set()
    for q in ids[ids % 100 == 0]:
        score = u @ u[ids == q][0]
        best = [i for i in np.lexsort((ids, -score)) if score[i] > 0.2]
        want |= {(int(q), int(ids[i])) for i in best[5:10]}
    assert len({q for q, _ in want}) == 5
    got = {(r["query"], r["vec_id"]) for r in entry.queries()["semantic_pages"](spark, DATA).collect()}
    assert got == want
    e = spark.read.parquet(f"{DATA}/embeddings.parquet")
    small = panel.similar_pages(e, e.where("vec_id % 100 = 0"), "vec_id", "embedding", 0.2, 1, 5, block=3 * 37)
    assert {(r["query"], r["vec_id"]) for r in small.collect()} == want


def test_iterations_end_by_tolerance(spark):
    from tallgrass.operators import panel

    rng = np.random.default_rng(1)
    full = rng.normal(size=(40, 3)) @ rng.normal(size=(3, 30)) * 2
    rows = [(f"a{i}", f"t{j}", float(full[i, j]), 50.0) for i in range(40) for j in range(30) if rng.random() < 0.7]
    df = spark.createDataFrame(rows, "a string, t string, y double, n double")
    error = lambda **k: np.median([abs(r["value"] - full[int(r["a"][1:]), int(r["t"][1:])]) for r in panel.imputed(df, "a", "t", "y", "n", **k).collect() if not r["known"]])
    assert error(passes=200, tolerance=1e-3) < 0.05 * full.std()  # 30 targets are of rank 3
    with pytest.raises(RuntimeError):
        panel.factor_model(df, "a", "t", "y", "n", passes=2, tolerance=1e-9)
    chain = spark.createDataFrame([(k, t, int(rng.random() < (0.9 if t // 10 % 2 else 0.1))) for k in range(10) for t in range(40 + k)], "k int, t int, s int")
    far = panel.hidden_chain(chain, "k", ["t"], "s", 2, passes=150)
    done = panel.hidden_chain(chain, "k", ["t"], "s", 2, passes=150, tolerance=1e-8)
    assert all(np.abs(a - b).max() < 1e-2 for a, b in zip(far, done))
    with pytest.raises(RuntimeError):
        panel.hidden_chain(chain, "k", ["t"], "s", 2, passes=1, tolerance=1e-6)


def test_eps_grid_counts_all_pairs(spark):
    from tallgrass.operators import clusters

    rng = np.random.default_rng(5)
    v = np.eye(6)[np.arange(60) % 6] + rng.normal(size=(60, 6)) * 0.22
    label = [None if i % 7 == 0 else int(i % 6) for i in range(60)]
    df = spark.createDataFrame([(i, v[i].tolist(), label[i]) for i in range(60)], "id bigint, v array<double>, label int")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    got = {r["eps"]: r["accuracy"] for r in clusters.eps_by_labels(df, "id", "v", "label", clusters.EPS_GRID[::6]).collect()}
    units = clusters.unit_vectors(df, "id", "v")
    edges = clusters.link_forest(units, "id", 0.5, block=17).collect()
    for eps in clusters.EPS_GRID[::6]:
        def groups(links):
            c = np.arange(60)
            for a, b in links:
                c[c == c[b]] = c[a]
            return c[:, None] == c[None]
        together = groups(np.argwhere(u @ u.T >= 1 - eps))
        assert (groups([(r["a"], r["b"]) for r in edges if r["cosine"] >= 1 - eps]) == together).all()
        judged = [together[i, j] == (label[i] == label[j]) for i in range(60) for j in range(i) if not (label[i] is None and label[j] is None)]
        assert got[eps] == pytest.approx(np.mean(judged))
    assert len(set(got.values())) > 1


def test_eps_is_chosen_from_the_full_grid(spark):
    got = sorted(r["eps"] for r in entry.queries()["chosen_eps"](spark, DATA).collect())
    assert np.allclose(got, np.linspace(0.1, 0.5, 20))


def test_replies_are_cleaned_whole(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = {r["doc_id"]: r["reply"] for r in entry.queries()["budget_cut"](spark, DATA).collect()}
    lines = {k: (t.split("\n")[0].rstrip(" \"'“”‘’.`*"), got[k]) for k, t in texts.items() if t and got[k]}
    assert max(len(r) for _, r in lines.values()) > 40
    assert all(line.endswith(r) for line, r in lines.values() if r and len(line) > 60)


def test_timestamps_walk_decides_at_a_lower_cost(spark, monkeypatch):
    from tallgrass.operators import timestamps as ts

    posts = spark.createDataFrame([("b", str(i), t, "x", "Quebec") for i, t in enumerate(["2024-11-03T05:50:00Z", "2024-11-03 01:30:00", "2024-11-03T06:45:00Z"])], "platform string, id string, value string, account string, province string")
    zones = spark.createDataFrame([("Quebec", "America/Toronto")], "province string, zone string")
    middle = lambda: {r["id"]: r["utc_us"] for r in ts.normalise(posts, zones, blocks=2).collect()}["1"]
    early = middle()
    monkeypatch.setattr(ts, "SECOND_PASS_COST", 0.5)
    assert middle() == early + 3_600_000_000


def test_entropy_of_accounts_without_variance(spark, tmp_path):
    import duckdb

    # b has an account of one reading, c one whose readings are all the same
    rows = [("1-a-x", t, [float(t), t * 2.0]) for t in range(4)] + [("2-b-x", 0, [1.0, 2.0])] + [("3-b-y", t, [t * 1.5, 1.0 + t * t]) for t in range(5)]
    rows += [("4-c-x", t, [0.1, 0.2]) for t in range(3)] + [("5-a-y", t, [t * 3.0, 1.0 - t]) for t in range(3)]
    df = spark.createDataFrame(rows, "filter_value string, t int, x0 array<double>")
    df.selectExpr("filter_value", "cast(timestamp_seconds(1700000000 + t) as timestamp_ntz) as createtime", "x0").write.parquet(str(tmp_path / "target_df.parquet"))
    got = sorted(str(tuple(r)) for r in entry.queries()["group_entropy"](spark, str(tmp_path)).collect())
    c = duckdb.connect()
    c.execute(f"create view target_df as from '{tmp_path}/target_df.parquet/*.parquet'")
    assert got == sorted(str(r) for r in c.execute(entry.oracle_sql()["group_entropy"]).fetchall())
    assert len(got) == 3 and "nan" in got[1]


def test_cluster_levels_in_blocks_with_flags_and_equal_vectors(spark):
    from tallgrass.operators import clusters

    rng = np.random.default_rng(11)
    v = np.eye(7)[np.arange(90) % 7] + rng.normal(size=(90, 7)) * 0.24
    v[80:] = v[:10]  # equal vectors
    rows = [(f"s{i:02}", v[i].tolist(), i % 5 > 0) for i in range(90)] + [("bad", [float("nan")] * 7, True), ("zero", [0.0] * 7, True), ("none", None, True)]
    df = spark.createDataFrame(rows, "id string, v array<double>, flag boolean")
    found = clusters.cluster_levels(df, "id", "v", clusters.EPS_GRID[::3], "flag", block=13).orderBy("id").collect()
    assert [r["id"] for r in found] == [f"s{i:02}" for i in range(90)]
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    sizes = set()
    for k, eps in enumerate(clusters.EPS_GRID[::3]):
        for column, kept in (("clusters", np.arange(90)), ("known_clusters", np.array([i for i in range(90) if i % 5]))):
            reach = u[kept] @ u[kept].T >= 1 - eps
            for _ in range(7):
                reach = reach @ reach
            names = np.array([found[i][column][k] for i in kept])
            assert ((names[:, None] == names[None]) == reach).all()
            sizes.add(len(set(names.tolist())))
    assert len(sizes) > 4
    empty = clusters.cluster_levels(df.limit(0), "id", "v", [0.1, 0.2], "flag")
    assert empty.collect() == [] and set(empty.columns) == {"id", "flag", "clusters", "known_clusters"}


def test_speakers_are_grouped_in_few_jobs(spark):
    """One comparison of all vectors serves all radii: the number of jobs doesn't grow with grid and rounds."""
    tracker, group = spark.sparkContext.statusTracker(), "speaker-jobs"
    spark.sparkContext.setJobGroup(group, group)
    try:
        entry.queries()["speaker_groups"](spark, DATA).collect()
        assert len(tracker.getJobIdsForGroup(group)) < 60
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
