"""Every catalogued query against its SQL on the smallest tables."""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
if not os.path.isdir(DATA):
    pytest.skip("no test tables", allow_module_level=True)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as from '{p}'")
    return c


def plain(v):
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else round(v, 4) + 0.0
    return v.isoformat() if isinstance(v, (datetime.date, datetime.datetime)) else v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(str([plain(r[i]) for i in order]) for r in data)


@pytest.mark.parametrize("name", sorted(set(entry.oracle_sql()) & set(entry.queries())))
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    result = duck.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, df.collect()) == rows(columns, result.fetchall())


# what queries without SQL give on these tables at least: rows, and a fact that a wrong result would break
FACTS = {
    "stratified_quota": lambda r: len({x["doc_id"] for x in r}) == len(r) and max(n for _, n in counted(r, "lang", "source")) <= 200,
    "unit_root_tests": lambda r: all(x["n"] > 0 and (math.isnan(x["adf_p"]) or 0 < x["adf_p"] <= 1) for x in r),
    "pca_coords": lambda r: all(len(x["coords"]) == 3 for x in r) and abs(sum(x["coords"][0] for x in r)) < 1e-6 * len(r),
    "pca_explained": lambda r: all(a["explained"] >= b["explained"] > 0 for a, b in zip(r, r[1:])) and sum(x["explained"] for x in r) <= 1,
    "slow_features": lambda r: all(len(x["slow"]) == 2 for x in r),
    "lagged_correlations": lambda r: all(-1e-9 <= x["correlation"] <= 1 + 1e-9 for x in r),
    "hidden_chain": lambda r: all(abs(sum(x["p"] for x in r if x["before"] == i) - 1) < 1e-9 for i in (0, 1)),
    "factor_model": lambda r: all(len(x["z"]) == 3 for x in r),
    "blake_split": lambda r: all(0 <= x["u"] < 1 for x in r) and 0.3 < sum(x["u"] for x in r) / len(r) < 0.7,
    "panel_verdict": lambda r: {x["test"] for x in r} == {"adf", "cips", "kpss"} and all(1 / 200 <= x["p"] <= 1 for x in r),
    "p3_found": lambda r: len({(x["platform"], x["id"]) for x in r}) == len(r) and all(1_577_836_800_000_000 <= x["utc_us"] < 1_767_225_600_000_000 for x in r),
    "speaker_groups": lambda r: all(x["videos"] >= 2 for x in r),
}
# iterative fits that take half a minute: tests/test_whole_jobs.py and tests/test_latent.py check their operators on small tables
ELSEWHERE = {"chosen_eps", "imputed_cells", "latent_trajectories", "latent_forecasts"}
EMPTY = {"speaker_groups"}  # no account of the smallest tables has a voice in enough videos


def counted(rows, *names):
    found = {}
    for r in rows:
        found[tuple(r[n] for n in names)] = found.get(tuple(r[n] for n in names), 0) + 1
    return found.items()


def dealt(name):
    return name[0] == "p" and name[1].isdigit() and name.split("_")[0] in {f"p{n}" for n in (1, 5, 6, 7, 8, 9, 10)}


@pytest.mark.parametrize("name", sorted(n for n in set(entry.queries()) - set(entry.oracle_sql()) if not dealt(n) and n not in ELSEWHERE))
def test_query_without_sql(spark, name):
    found = entry.queries()[name](spark, DATA).collect()
    assert found or name in EMPTY
    assert name in FACTS, "a query without SQL needs a fact to check"
    assert FACTS[name](found)


def test_every_query_is_catalogued_once():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
