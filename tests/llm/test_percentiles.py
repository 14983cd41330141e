import math
import random

import pytest
from pyspark.sql import functions as F

from posegrain.llm import percentiles as P

SCHEMA = "g string, h int, x double, value double, column_name string"
WANT = [0.0, 0.01, 0.25, 0.5, 0.95, 1.0]


def values(spark, rows):
    d = spark.createDataFrame([(g, h, x, 0.0, "clash") for g, h, x in rows], SCHEMA)
    return P.long_values(d, {"g": F.col("g"), "h": F.col("h")}, ["x"])


def brute(rows):
    out = {}
    for key in {(g, h) for g, h, _ in rows}:
        s = sorted(x for g, h, x in rows if (g, h) == key and x is not None and not math.isnan(x))
        for p in WANT if s else []:
            out[(*key, p)] = (len(s), s[max(1, math.ceil(p * len(s))) - 1])
    return out


def data(n=3000, seed=1):
    rng = random.Random(seed)
    kinds = [lambda: rng.gauss(0, 1), lambda: rng.lognormvariate(0, 30), lambda: 0.5, lambda: -1e308 * rng.random(), lambda: float("inf"), lambda: -float("inf"), lambda: 5e-324, lambda: None, lambda: float("nan"), lambda: 1 + rng.random() * 1e-12]
    return [(rng.choice(["a", "a", "a", None, "b"]), rng.choice([1, None]), rng.choice(kinds)()) for _ in range(n)] + [("lone", 1, 3.5), ("void", 1, None)]


def collect(d):
    return {(r.g, r.h, r.percentile): (r.n_rows, r.value) for r in d.collect()}


@pytest.mark.parametrize("fanout", [32, 1024])
def test_exact_against_sorting(spark, fanout):
    rows = data()
    d = P.percentiles([values(spark, rows)], ["g", "h", "column_name"], WANT, fanout=fanout)
    assert collect(d) == brute(rows)
    assert {r.max_error for r in d.collect()} == {0.0}


def test_more_intervals_than_may_be_broadcast(spark, monkeypatch):
    monkeypatch.setattr(P, "BROADCAST_SPANS", 0)
    rows = data(1000, seed=5)
    assert collect(P.percentiles([values(spark, rows)], ["g", "h", "column_name"], WANT)) == brute(rows)


def test_separate_loads_give_the_same(spark):
    rows = data(seed=2)
    parts = [values(spark, rows[i::3]) for i in range(3)] + [values(spark, [])]
    assert collect(P.percentiles(parts, ["g", "h", "column_name"], WANT)) == brute(rows)


def test_stated_error_holds(spark):
    rows = [("a", 1, random.Random(4).random() * 1000 + i / 7) for i in range(2000)]
    want = brute(rows)
    for r in P.percentiles([values(spark, rows)], ["g", "h", "column_name"], WANT, max_error=30.0).collect():
        assert r.value <= want[r.g, r.h, r.percentile][1] <= r.value + r.max_error and r.max_error <= 30.0


def test_stored_counts_merge(spark):
    rows = [("a", 1, float(i % 13)) for i in range(500)]
    groups = ["g", "h", "column_name"]
    merged = P.merge_counts([P.bin_counts(values(spark, rows[:100]), groups), P.bin_counts(values(spark, rows[100:]), groups)], groups)
    for r in P.locate(merged, groups, WANT).collect():
        assert r.lo <= brute(rows)[r.g, r.h, r.percentile][1] <= r.hi


def test_empty(spark):
    assert P.percentiles([values(spark, [])], ["g", "h", "column_name"], WANT).count() == 0
