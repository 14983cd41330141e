import math

import pytest

from posegrain.operators import profile as P

SCHEMA = "load_id int, a double, b double, s string, num double"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def rows_of(spark, df):
    return {(r.column_name, r.load_id): r.asDict() for r in P.profile(P.ValueCountStore(spark).apply(df)).collect()}


def test_exact_metrics(spark):
    nan, inf = float("nan"), float("inf")
    d = frame(spark, [(1, 1.0, -0.0, "1.5e-3", 0.0), (1, 1.0, 0.0, "1,5", 0.0), (1, nan, 2.0, None, 0.0), (1, 3.0, None, "-2", 0.0), (1, 7.0, -inf, "1.\n", 0.0), (2, None, nan, None, 0.0), (2, inf, 5.0, "", 0.0)])
    p = rows_of(spark, P.value_counts(d, "t", ["a", "b"], ["s"]))
    a = p["a", 1]
    assert (a["n_rows"], a["n_null"], a["n_values"], a["n_distinct"], a["min"], a["max"], a["median"], a["n_above_1"]) == (5, 1, 4, 3, 1.0, 7.0, 2.0, 2)
    assert a["entropy"] == pytest.approx(-(0.5 * math.log(0.5) + 2 * 0.25 * math.log(0.25)))
    assert p["b", 1]["n_distinct"] == 3 and p["b", 1]["n_below_0"] == 1 and p["b", 1]["n_infinite"] == 1 and p["b", 1]["median"] == 0.0
    assert p["s", 1]["n_bad_text"] == 2 and p["s", 1]["n_null"] == 1 and p["s", 1]["median"] is None
    assert p["s", 2]["n_bad_text"] == 1 and p["a", 2]["median"] == inf and p["b", 2]["median"] == 5.0


def test_signed_deltas(spark):
    one = frame(spark, [(1, float(i % 7), 0.5, "x", 0.0) for i in range(50)])
    two = frame(spark, [(1, float(i % 5), 0.5, "y", 0.0) for i in range(30)])
    store = P.ValueCountStore(spark)
    store.apply(P.value_counts(one, "t", ["a"], ["s"]))
    store.apply(P.value_counts(two, "t", ["a"], ["s"]))
    left = store.apply(P.value_counts(one, "t", ["a"], ["s"], sign=-1))
    want = P.value_counts(two, "t", ["a"], ["s"])
    key = lambda d: sorted((str(x) for x in d.select("column_name", "load_id", "num", "txt", "n").collect()))
    assert key(left) == key(want)
    with pytest.raises(Exception, match="taken back"):
        store.apply(P.value_counts(one, "t", ["a"], ["s"], sign=-1)).collect()


def test_load_by_load_through_a_reopened_store(spark, tmp_path):
    """Loads come one by one, one comes again with more rows, one is taken back; each time the store is opened by its path."""
    path = "file://" + str(tmp_path / "counts")
    loads = {k: frame(spark, [(k, float(i % (k + 2)), None, "x", 0.0) for i in range(10 * k)]) for k in (1, 2, 3)}
    delta = lambda k, sign=1: P.value_counts(loads[k], "a/t", ["a"], ["s"], sign=sign)
    for k in (1, 2, 3):
        P.ValueCountStore(spark, path).apply(delta(k))
    old = P.ValueCountStore(spark, path)
    P.ValueCountStore(spark, path).apply(delta(2))
    after = P.ValueCountStore(spark, path).apply(delta(1, -1))
    key = lambda d: sorted(str(x) for x in d.select("load_id", "column_name", "num", "txt", "n").collect())
    assert key(after) == key(delta(2).withColumn("n", P.F.col("n") * 2).unionByName(delta(3)))
    assert key(old.read()) == key(delta(1).unionByName(delta(2)).unionByName(delta(3)))  # readers keep their version
    store = P.ValueCountStore(spark, path)
    assert store.version == 5 and sorted(int(k.split("_")[1]) for k in store.loads) == [2, 3]
    assert {p.split("/")[1] for p in store.loads.values()} == {"v3", "v4"}  # load 3 was not written again
    assert P.ValueCountStore(spark, path).apply(delta(1)).where("load_id = 1").count() == delta(1).count()


def test_findings(spark):
    rows = [(1, 0.5 + i / 1000, 0.5, None, 0.0) for i in range(20)] + [(3, 2.0 + i / 1000 if i > 4 else None, 0.5, "bad", 0.0) for i in range(20)]
    f = P.findings(P.profile(P.value_counts(frame(spark, rows), "t", ["a", "b"], ["s"])), ["a", "b"], [], ["s"])
    got = {(r.column_name, r.load_id, r.finding) for r in f.collect()}
    assert got == {("a", 3, "null_rate"), ("a", 3, "range"), ("a", 3, "shift"), ("b", 1, "distinct"), ("b", 3, "distinct"), ("s", 3, "pattern")}


def test_medians_against_sorting(spark):
    import random

    rng = random.Random(3)
    vals = [rng.choice([rng.gauss(0, 1), rng.lognormvariate(0, 6), -1e300 * rng.random(), 0.0, 5.0]) for _ in range(501)]
    d = frame(spark, [(i % 2, v, None, None, 0.0) for i, v in enumerate(vals)])
    p = rows_of(spark, P.value_counts(d, "t", ["a", "b"]))
    for load in (0, 1):
        s = sorted(vals[load::2])
        n = len(s)
        assert p["a", load]["median"] == (s[(n - 1) // 2] if n % 2 else (s[n // 2 - 1] + s[n // 2]) / 2)
        assert p["b", load]["median"] is None and p["b", load]["n_null"] == n


def test_empty(spark):
    d = P.value_counts(frame(spark, []), "t", ["a"], ["s"])
    assert P.profile(d).count() == 0 and P.findings(P.profile(d), ["a"], [], ["s"]).count() == 0
