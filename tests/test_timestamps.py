"""Timestamps: each format by hand, and the block-wise Viterbi walk against all chains."""

from __future__ import annotations

import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from tallgrass.operators import timestamps as ts


def us(*a):
    return int(dt.datetime(*a, tzinfo=dt.timezone.utc).timestamp()) * 1_000_000


CASES = [
    ("2024-03-10T07:16:04Z", "UTC", us(2024, 3, 10, 7, 16, 4)),
    (" 2024-03-10 07:16:04 +0000 ", "America/Toronto", us(2024, 3, 10, 7, 16, 4)),
    ("2024-07-01 12:00:00", "America/St_Johns", us(2024, 7, 1, 14, 30)),
    ("2024-07-01T12:00", "America/Toronto", us(2024, 7, 1, 16)),
    ("2024-07-01 12:00:00.5 NDT", "America/Toronto", us(2024, 7, 1, 14, 30) + 500_000),
    ("2023-02-06T17:00:00-03:30[America/St_Johns]", "UTC", us(2023, 2, 6, 20, 30)),
    ("2024-07-01 12:00:00 America/Regina", "America/Toronto", us(2024, 7, 1, 18)),
    ("2025-02-17T11:47:10,763Z", "UTC", us(2025, 2, 17, 11, 47, 10) + 763_000),
    ("2023-07-04T11:51:23.950590999Z", "UTC", us(2023, 7, 4, 11, 51, 23) + 950_590),
    ("20250624T165650Z", "America/Toronto", us(2025, 6, 24, 16, 56, 50)),
    ("20230921040803", "America/Toronto", us(2023, 9, 21, 8, 8, 3)),
    ("05/02/2025 10:58:10", "UTC", us(2025, 2, 5, 10, 58, 10)),
    ("29/12/2023 07:33", "UTC", us(2023, 12, 29, 7, 33)),
    ("12/29/2023 07:33", "UTC", None),
    ("Sat, 19 Nov 2022 18:20:00 -0500", "UTC", us(2022, 11, 19, 23, 20)),
    ("Wed Jul 17 18:10:08 +0000 2024", "America/Toronto", us(2024, 7, 17, 18, 10, 8)),
    ("Nov 19, 2022 12:20:00 AM", "UTC", us(2022, 11, 19, 0, 20)),
    ("Nov 19, 2022 12:20:00 PM", "UTC", us(2022, 11, 19, 12, 20)),
    ("9 mai 2023 à 5 h 43", "America/Toronto", us(2023, 5, 9, 9, 43)),
    ("25 février 2022 à 20 h 04", "UTC", us(2022, 2, 25, 20, 4)),
    ("1700000000", "America/Toronto", 1_700_000_000_000_000),
    ("1700000000123", "UTC", 1_700_000_000_123_000),
    ("1700000000.25", "UTC", 1_700_000_000_250_000),
    ("1700000000123456", "UTC", 1_700_000_000_123_456),
    ("1700000000123456789", "UTC", 1_700_000_000_123_456),
    ("2023-11-05 01:30:00", "America/Toronto", us(2023, 11, 5, 5, 30)),  # occurs twice: the earlier one
    ("2023-03-12 02:30:00", "America/Toronto", us(2023, 3, 12, 7, 30)),  # skipped: the offset before the change
    ("2023-02-30 02:30:00", "UTC", None), ("2023-02-20 24:30:00", "UTC", None), ("0000-00-00 00:00:00", "UTC", None),
    ("0", "UTC", None), ("-1", "UTC", None), ("None", "UTC", None), ("n/a", "UTC", None), ("Invalid date", "UTC", None), ("", "UTC", None), (None, "UTC", None),
    ("2019-12-31 23:59:59", "UTC", None), ("2026-01-01T00:00:00Z", "UTC", None), ("2024-07-01 12:00:00 XYZ", "UTC", None), ("9" * 5000, "UTC", None),
    ("2024-07-01 12:00:00 Mars/Base", "UTC", None),
]


def test_formats(spark):
    df = spark.createDataFrame([(i, v, z) for i, (v, z, _) in enumerate(CASES)], "i int, value string, zone string")
    got = {r["i"]: r["readings"] for r in ts.with_readings(df, "value", "zone").collect()}
    for i, (value, _, want) in enumerate(CASES):
        first = sorted(got[i], key=lambda r: r["cost"])[0]["us"] if got[i] else None
        assert first == want, (value, first, want)


POST = "platform string, id string, value string, account string, province string, us string, _block int, readings string"
ZONES = [("Quebec", "America/Toronto", "z"), ("Manitoba", "America/Winnipeg", "z"), (None, "America/Toronto", "z"), ("Nowhere", "No/Zone", "z")]


def normal(spark, rows):
    posts = spark.createDataFrame([(*r, "u", 1, "r") for r in rows], POST)
    zones = spark.createDataFrame(ZONES, "province string, zone string, platform string")
    return {(r["platform"], r["id"]): r["utc_us"] for r in ts.normalise(posts, zones, blocks=3).collect()}


def test_posts_fetched_again_nulls_and_unknown_provinces(spark):
    got = normal(spark, [
        ("b", "1", "2024-07-01 12:00:00", "x", "Quebec"), ("b", "1", "2024-07-01T16:00:00Z", "x", "Quebec"), ("b", "1", "2024-07-01T16:00:00Z", "x", "Quebec"),
        ("b", "2", None, "x", "Quebec"), ("b", "2", "n/a", "x", "Quebec"), ("b", "3", "n/a", None, None), ("b", "3", "1700000000", None, None),
        ("b", "4", "2024-07-01 12:00:00", None, ""), ("b", "5", "2024-07-01 12:00:00", None, "Nowhere"), ("b", None, "1700000000", "x", "Quebec"),
    ])
    assert got == {("b", "1"): us(2024, 7, 1, 16), ("b", "3"): 1_700_000_000_000_000, ("b", "4"): us(2024, 7, 1, 12), ("b", "5"): us(2024, 7, 1, 12)}


def test_short_dates_are_read_as_their_neighbours_are(spark):
    """A year of two digits may stand first or last: the walk decides, which no record's cheapest reading alone does."""
    around = {"y": ("2022-01-05 08:00:00", "2024-01-05 08:00:00"), "d": ("05/01/2022 08:00:00", "05/01/2024 08:00:00")}
    rows = []
    for account, (before, after) in around.items():
        values = [before, "21-02-23 10:00:00", "23.02.22 7:30 PM", after, "25/12/19 10:00", "19/12/25 10:00", "23-20-21 10:00", "5/2/25 10:00 -0330"]
        rows += [("b", f"{account}{i}", v, account, "Quebec") for i, v in enumerate(values)]
    rows += [("b", "z", v, "z", "Quebec") for v in ("21-02-23 10:00:00 EST", "Feb 21, 2023 10:00:00 AM")]  # the other fetch can be read one way only
    got = {i: t for (_, i), t in normal(spark, rows).items()}
    assert (got["y1"], got["y2"]) == (us(2021, 2, 23, 15), us(2023, 2, 23, 0, 30))
    assert (got["d1"], got["d2"]) == (us(2023, 2, 21, 15), us(2022, 2, 24, 0, 30))
    for a in "yd":
        assert (got[a + "4"], got[a + "5"], got[a + "7"]) == (us(2025, 12, 19, 15), us(2025, 12, 19, 15), us(2025, 2, 5, 13, 30))
        assert a + "6" not in got
    assert got["z"] == us(2023, 2, 21, 15)


def test_empty_table(spark):
    assert normal(spark, []) == {}


def cheapest(chain):
    best = None
    for pick in itertools.product(*chain):
        cost = sum(c[1] for c in pick) + sum(ts._penalty(a[2], a[0], b[2], b[0]) for a, b in zip(pick, pick[1:]))
        best = cost if best is None else min(best, cost)
    return best


@pytest.mark.parametrize("seed,blocks", [(1, 1), (2, 3), (3, 7), (4, 12)])
def test_block_walk_is_as_cheap_as_the_best_chain(spark, seed, blocks):
    rng = random.Random(seed)
    rows, chains = [], {}
    for source in ("a", "b", "c"):
        chain = []
        for i in range(9):
            k = rng.choice([1, 2, 3]) if source != "c" else 2
            own = [(rng.randrange(10), rng.choice([0.0, 0.5, 1.5]) if k > 1 else 0.0, rng.choice("xy")) for _ in range(k)]
            own = [(u * 10 + j, c, f) for j, (u, c, f) in enumerate(own)]
            chain.append(own)
            rows.append((source, i, [(u, c, f, False) for u, c, f in own]))
        chains[source] = chain
    df = spark.createDataFrame(rows, "s string, o int, readings array<struct<us:bigint,cost:double,form:string,zoned:boolean>>")
    got = ts.resolve(df, ["s"], ["o"], blocks).orderBy("s", "o").collect()
    assert len(got) == len(rows)
    for source, chain in chains.items():
        picked = [next(c for c in own if (c[0], c[2]) == (r["us"], r["form"])) for own, r in zip(chain, [g for g in got if g["s"] == source])]
        assert cheapest([[p] for p in picked]) == pytest.approx(cheapest(chain)), source
