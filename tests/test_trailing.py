"""Trailing totals against a walk over the calendar, and the defined edge cases."""

from __future__ import annotations

import datetime as dt
import math
import random
from collections import defaultdict

import pytest

from tallgrass.operators import trailing

SCHEMA = "createtime timestamp_ntz, filter_value string, x0 array<double>, day string, readings int, _end string"
NAN = float("nan")


def table(spark, rows):
    return spark.createDataFrame([(*r, "d", 3, None) for r in rows], SCHEMA)


def rows_of(seed):
    rng = random.Random(seed)
    out = []
    for who in ("a", "b", "", " ", None):
        at = dt.datetime(2024, 1, 1)
        for _ in range(25):
            at += dt.timedelta(hours=rng.choice([1, 5, 30, 24 * 9, 24 * 33]))
            x = rng.choice([[1.0, 2.0, NAN, None], [3.0, -1.0, 0.5, 2.0], [NAN, 1.0, 1.0, 1.0], [None, 1.0, 1.0, 1.0], None, []])
            out += [(at, who, x)] * rng.choice([1, 1, 2])
    rng.shuffle(out)
    return out


def walk(rows):
    """{(account, day): (readings today, {period: (readings, sums)})} by brute force."""
    seen, daily = set(), defaultdict(lambda: defaultdict(list))
    for at, who, x in rows:
        if not who or not who.strip() or not x or x[0] is None or math.isnan(x[0]) or (key := (at, who, repr(x))) in seen:
            continue
        seen.add(key)
        daily[who][at.date()].append([0.0 if v is None or math.isnan(v) else v for v in x])
    out = {}
    for who, days in daily.items():
        d = min(days)
        while d <= max(days):
            per = {}
            for p in (7, 30):
                own = [x for k in range(p) for x in days.get(d - dt.timedelta(days=k), [])]
                per[p] = (len(own), [sum(x[i] for x in own) for i in range(4)])
            out[who, d] = (len(days.get(d, [])), per)
            d += dt.timedelta(days=1)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_totals_against_a_walk(spark, seed):
    rows = rows_of(seed)
    want = walk(rows)
    got = {(r["filter_value"], r["day"]): r for r in trailing.trailing_totals(table(spark, rows)).collect()}
    assert set(got) == set(want)
    for key, (n, per) in want.items():
        assert got[key]["readings"] == n
        for p, (count, sums) in per.items():
            assert got[key][f"readings_{p}"] == count
            for i, s in enumerate(sums):
                assert got[key][f"sum_{p}_{i}"] == pytest.approx(s)
                assert got[key][f"avg_{p}_{i}"] == pytest.approx(s / p)


def test_quiet_days(spark):
    rows = rows_of(5)
    want = {(who, str(d)) for (who, d), (_, per) in walk(rows).items() if per[7][0] == 0 and per[30][0] > 0}
    assert {tuple(r) for r in trailing.quiet_days(table(spark, rows)).collect()} == want


def test_empty_and_one_reading(spark):
    assert trailing.trailing_totals(table(spark, [])).count() == 0
    one = trailing.trailing_totals(table(spark, [(dt.datetime(2024, 3, 1), "a", [1.0])])).collect()
    assert [(str(r["day"]), r["readings_30"], r["sum_30_1"]) for r in one] == [("2024-03-01", 1, 0.0)]
    assert trailing.trailing_totals(table(spark, [(None, "a", [1.0]), (dt.datetime(2024, 3, 1), None, [1.0])])).count() == 0
