"""Hot keys: chunk merging against plain counting, and the defined edge cases."""

from __future__ import annotations

import datetime as dt
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tallgrass.operators import hot_keys

SCHEMA = "SeedName string, target string, bin timestamp_ntz, s_sum double, s2_sum double, n bigint, _block string, rows string, chunk string, _tie string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z", None) for r in rows], SCHEMA)


def random_rows(n, seed=0):
    rng = random.Random(seed)
    day = dt.datetime(2024, 1, 1)
    names = ["hot"] * 6 + ["b", "c", "", "  ", None]
    return [(rng.choice(names), rng.choice(["t1", "t2", None]), rng.choice([None, *[day + dt.timedelta(days=2 * rng.randrange(30)) for _ in range(9)]]), float(rng.randrange(-3, 4)), 1.0, rng.choice([None, 0, 1, 5])) for _ in range(n)]


@pytest.mark.parametrize("chunk_rows", [1, 7, 1000])
def test_totals_equal_plain_counting(spark, chunk_rows):
    rows = random_rows(400)
    got = {(r["field"], r["key_value"]): r for r in hot_keys.key_totals(table(spark, rows), chunk_rows=chunk_rows, blocks=5).collect()}
    want = defaultdict(list)
    for r in rows:
        want["SeedName", r[0]].append(r)
        want["target", r[1]].append(r)
    assert set(got) == set(want)
    for key, own in want.items():
        g = got[key]
        bins = sorted({r[2] for r in own if r[2]})
        assert (g["rows"], g["posts"], g["bins"]) == (len(own), sum(r[5] or 0 for r in own), len(bins))
        assert g["s_sum"] == pytest.approx(sum(r[3] for r in own))
        gaps = [(b - a).days for a, b in zip(bins, bins[1:])]
        assert g["widest_gap_days"] == (max(gaps) if gaps else None) or (gaps == [] and g["widest_gap_days"] in (None, 0))


def test_numbers_are_exact_and_ordered(spark):
    rows = [("k" if i % 3 else "j", i // 5) for i in range(300)] + [("k", 7)] * 100
    df = spark.createDataFrame(rows, "k string, o int")
    out = hot_keys.number_rows(df, ["k"], ["o"], blocks=6).collect()
    by = defaultdict(list)
    for r in out:
        by[r["k"]].append((r["_number"], r["o"]))
    for own in by.values():
        own.sort()
        assert [n for n, _ in own] == list(range(len(own)))
        assert [o for _, o in own] == sorted(o for _, o in own)


def test_heavy_keys_at_the_border_blanks_and_ties(spark):
    day = dt.datetime(2024, 1, 1)
    rows = [("two", "t", day, 0.0, 0.0, 0)] * 2 + [("", "t", day, 0.0, 0.0, 1)] * 50 + [(None, None, day, 0.0, 0.0, 1)] * 30 + [(f"k{i}", "u", day, 0.0, 0.0, 1) for i in range(18)]
    got = {tuple(r) for r in hot_keys.heavy_keys(table(spark, rows)).collect()}
    assert ("SeedName", "two", "rows") in got and ("SeedName", "two", "posts") not in got
    assert not any(r[1] is None or not r[1].strip() for r in got)
    assert ("target", "t", "rows") in got and ("target", "u", "posts") in got
    assert not any(r[1].startswith("k") for r in got)


def test_equal_on_any_number_of_blocks(spark):
    rows = random_rows(200, 3) + random_rows(1, 4) * 200
    a, b = (Counter(tuple(r) for r in hot_keys.heavy_keys(table(spark, rows).repartition(n), chunk_rows=c).collect()) for c, n in ((3, 2), (50, 9)))
    assert a == b
    a, b = (Counter(tuple(r) for r in hot_keys.key_totals(table(spark, rows), chunk_rows=c, blocks=n).collect()) for c, n in ((3, 2), (50, 9)))
    assert a == b


@pytest.mark.parametrize("parts", [1, 4, 13])
def test_stored_chunks_are_full_and_exact(spark, parts, tmp_path):
    rows = [("hot", 1)] * 1000 + [(None, 2)] * 30 + [(f"k{i % 40}", i) for i in range(400)]
    random.Random(1).shuffle(rows)
    spark.createDataFrame(rows, "k string, v int").repartition(parts).write.parquet(f"{tmp_path}/rows")
    df = spark.read.parquet(f"{tmp_path}/rows")
    got = hot_keys.stored_chunks(df, ["k"], {"v": F.col("v")}, chunk_rows=64).collect()
    want = defaultdict(list)
    for k, v in rows:
        want[k].append(v)
    for k, own in want.items():
        chunks = sorted((r["chunk"], r["rows"]) for r in got if r["k"] == k)
        assert [c for c, _ in chunks] == list(range(-(-len(own) // 64)))
        assert all(n == 64 for _, n in chunks[:-1]) and sum(n for _, n in chunks) == len(own)
        assert sum(r["v"] for r in got if r["k"] == k) == sum(own)


def test_empty_table(spark):
    assert hot_keys.heavy_keys(table(spark, [])).count() == 0
    assert hot_keys.key_totals(table(spark, [])).count() == 0
