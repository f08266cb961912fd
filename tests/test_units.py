import datetime as dt
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from basinweave.operators import units as U

CASES = {
    "12,5 km": ("length", 12_500_000), "0.05degrees × 0.1degrees": ("length", 11_132_000), "version 2 product, 10 Km": ("length", 10_000_000), "between 15 and 20 m.": ("length", 20_000),
    "1/12 deg": ("length", 9_276_667), "30M": ("length", 30_000), "30\"": ("length", 927_667), "0,5'": ("length", 927_667), "half-degree": ("length", 55_660_000),
    "one-tenth of a degree": ("length", 11_132_000), "half a kilometre": ("length", 500_000), "one hundred kilometres": ("length", 100_000_000), "1,000 m": ("length", 1_000_000),
    "5 NM": ("length", 9_260_000), "10 ft": ("length", 3048), "T1279": None, "level 4 tiles": None, "250": None, "": None, "see documentation": None, "5 m/s": None,
}
RESOLUTIONS = [
    ({"value": 15, "unit": "minute"}, ("time", 900)), ({"value": "PT3H", "unit": "text"}, ("time", 10_800)), ({"value": "twice daily"}, ("time", 43_200)),
    ({"value": "every other day", "unit": ""}, ("time", 172_800)), ({"value": 2, "unit": "x100 m"}, ("length", 200_000)), ({"value": 2, "unit": "10^3 m"}, ("length", 2_000_000)),
    ({"value": "~8", "unit": "km (nominal)"}, ("length", 8_000_000)), ({"value": 2, "unit": None, "nativeResolution": "stored at 2 wk"}, ("time", 1_209_600)),
    ({"value": 3, "unit": "", "description": "values are given in dd"}, ("length", 333_960_000)), ({"value": 3, "unit": "px"}, None), ({"value": None, "unit": "km"}, None),
    ({"value": 3, "unit": None}, None), ({"value": True, "unit": "m"}, None), ({"value": "1.5e+01", "unit": "m."}, ("length", 15_000)), ({"value": 1, "unit": "mon"}, ("time", 2_592_000)),
]


@pytest.mark.parametrize(("text", "want"), CASES.items())
def test_coverage_texts(text, want):
    assert U.record_quantity(json.dumps({"spatialResolution": text}), ("spatialResolution",), None, None, ()) == want


@pytest.mark.parametrize(("record", "want"), RESOLUTIONS)
def test_resolutions(record, want):
    assert U.record_quantity(json.dumps(record), (), "value", "unit", ("nativeResolution", "description")) == want


def test_entities(spark):
    rows = [
        ("a", "Resolution", '{"value": 5, "unit": "km"}', 1), ("a", "Resolution", '{"value": 5, "unit": "km"}', 1), ("b", "type:Dataset", '{"spatialResolution": "30 m"}', 1),
        ("c", "Measurement", '{"value": 5, "unit": "km"}', 1), ("d", "Resolution", None, 1), ("e", "Resolution", "{broken", 1), ("f", None, '{"value": 5, "unit": "km"}', 1),
        ("g", "Dataset", "[1]", 1), (None, "Resolution", '{"value": 5, "unit": "km"}', 1), ("h", "Dtaset", '{"spatialResolution": 30}', 1), ("i", "gridsize", json.dumps({"value": "9 km", "unit": "x" * 50000}), 1),
    ]
    df = spark.createDataFrame(rows, "id string, type string, attributes string, amount int")
    assert sorted(tuple(r) for r in U.read_quantities(df).collect()) == [("a", "length", 5_000_000), ("b", "length", 30_000), ("i", "length", 9_000_000)]
    assert U.read_quantities(df.limit(0)).count() == 0


def brute_cost(x, cuts, penalty):
    return sum(((x[a:b] - x[a:b].mean()) ** 2).sum() + penalty for a, b in zip(cuts, [*cuts[1:], len(x)]))


def test_changepoints_are_optimal():
    rng = np.random.default_rng(3)
    for _ in range(40):
        x = rng.normal(size=rng.integers(1, 9)) * 3
        best = min(brute_cost(x, [0, *[i + 1 for i in range(len(x) - 1) if m >> i & 1]], 2.0) for m in range(2 ** (len(x) - 1)))
        assert brute_cost(x, U.changepoints(x, 2.0), 2.0) == pytest.approx(best)


def test_unit_shifts(spark):
    rng = random.Random(1)
    start = dt.datetime(2024, 3, 1)
    rows = [("s", start + dt.timedelta(minutes=i), (5 if i < 300 else 5000) * math.exp(rng.gauss(0, 0.02)), 1) for i in range(600)]
    rows += [("flat", start + dt.timedelta(minutes=i), 2.0, 1) for i in range(50)] + [("s", start, None, 1), ("s", None, 2.0, 1), (None, start, 2.0, 1), ("neg", start, -1.0, 1)]
    df = spark.createDataFrame(rows, "source string, at timestamp, v double, level int")
    got = U.unit_shifts(df, "source", "at", F.col("v")).orderBy("source", "segment").collect()
    assert [(r.source, r.segment, r.rows, r.factor) for r in got] == [("flat", 0, 50, None), ("s", 0, 300, None), ("s", 1, 300, "1000")]
    assert got[-1].reverse_by == pytest.approx(1e-3)
    parts = U.unit_shifts(df, "source", "at", F.col("v"), max_block=64).groupBy("source").agg(F.sum("rows").alias("n")).collect()
    assert {r.source: r.n for r in parts} == {"flat": 50, "s": 600}
    assert U.unit_shifts(df.limit(0), "source", "at", F.col("v")).count() == 0


def test_long_searches_are_optimal_and_settle():
    rng = np.random.default_rng(5)
    for noise in (0.0, 0.05, 1.0, 3.0):
        x = np.concatenate([rng.normal(m, noise, 40) for m in (0, 7, 7, -3)])
        best = [-6.0]
        for t in range(1, len(x) + 1):
            costs = [best[a] + ((x[a:t] - x[a:t].mean()) ** 2).sum() + 6.0 for a in range(t)]
            best.append(min(costs))
        search, done = U.LevelSearch(6.0), []
        for v in x.tolist():
            search.add(v)
            if len(search.back) >= 8:
                done += search.starts(cut := search.settled())
                search.forget(cut)
        done += search.starts(len(x))
        assert done == U.changepoints(x, 6.0)
        assert brute_cost(x, done, 6.0) - 6.0 == pytest.approx(best[-1])


def test_unit_shifts_cross_months_and_sizes(spark):
    rng = random.Random(2)
    start, rows = dt.datetime(2024, 1, 30), []
    for i in range(12):  # one value a day: a change between two months and one within
        rows.append(("m", start + dt.timedelta(days=i), (5 if i < 2 else 5000) * math.exp(rng.gauss(0, 0.02))))
    for i in range(3000):  # the unit changes at 1024 rows and back at 2500
        rows.append(("hot", start + dt.timedelta(minutes=i), (7000 if 1024 <= i < 2500 else 7) * math.exp(rng.gauss(0, 0.5))))
    for i in range(400):
        rows.append(("wild", start + dt.timedelta(hours=5 * i), math.exp(rng.gauss(0, 2))))
    df = spark.createDataFrame(rows, "source string, at timestamp, v double")
    got = {m: sorted(tuple(r) for r in U.unit_shifts(df, "source", "at", F.col("v"), max_block=m).collect()) for m in (1, 64, 1024, 4096)}
    assert got[1] == got[64] == got[1024] == got[4096]
    hits = [(r[0], r[1], r[4], r[6], round(r[7], 6)) for r in got[64] if r[0] != "wild"]
    assert hits == [("hot", "2024-01", 1024, None, 1.0), ("hot", "2024-01", 1476, "1000", 0.001), ("hot", "2024-01", 500, "1000", 1.0), ("m", "2024-01", 2, None, 1.0), ("m", "2024-02", 10, "1000", 0.001)]
    wild = np.log([v for s, _, v in rows if s == "wild"])
    assert [r[4] for r in got[64] if r[0] == "wild"] == np.diff([*U.changepoints(wild, 6.0), len(wild)]).tolist()


def test_planted_unit_changes_are_found_and_reversed(spark):
    """Recall and precision of planted changes, and values brought back to the first unit, at several block sizes."""
    rng = random.Random(11)
    start, rows, planted, truth = dt.datetime(2024, 1, 1), [], set(), {}
    for k in range(40):
        base, factor, at = math.exp(rng.uniform(0, 6)), 1.0, 0
        cuts = sorted(rng.sample(range(30, 270, 30), rng.randint(0, 2)))
        for i in range(300):
            if i in cuts:
                factor = factor * rng.choice([1000.0, 3600.0, 1 / 1000.0, 100.0]) if factor == 1 else 1.0
                planted.add((f"s{k}", i))
            v = base * math.exp(rng.gauss(0, 0.1))
            rows.append((f"s{k}", f"s{k}-{i}", start + dt.timedelta(hours=i), v * factor))
            truth[f"s{k}-{i}"] = v
    df = spark.createDataFrame(rows, "source string, id string, at timestamp, v double")
    shifts = U.unit_shifts(df, "source", "at", F.col("v")).where("factor is not null").collect()
    found = {(r.source, int((r.start_at - start).total_seconds() // 3600)) for r in shifts}
    assert len(found & planted) >= 0.99 * len(planted) and len(found & planted) >= 0.99 * len(found)
    for size in (64, 4096):
        got = {r.ident: r.converted for r in U.convert_units(df, "source", "at", F.col("v"), "id", max_block=size).collect()}
        assert set(got) == set(truth)
        assert sum(abs(math.log(got[k] / truth[k])) < 1e-6 for k in truth) >= 0.99 * len(truth)
    assert U.convert_units(df.limit(0), "source", "at", F.col("v"), "id").count() == 0
