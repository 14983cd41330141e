import random

import numpy as np
from pyspark.sql import functions as F

from posegrain.operators import calibration as C
from posegrain.operators.prefix import BIN, cumulate, quantiles


def test_prefix_sums_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(g, v, rng.randint(1, 5), rng.random()) for g in ("a", None, "b") for v in {round(rng.gauss(0, 3), 2) for _ in range(400 if g == "a" else 60)} | {float("inf"), -0.5}]
    d = spark.createDataFrame(rows, "g string, v double, n bigint, e double")
    for down in (False, True):
        for r in cumulate(d, ["g"], "v", ["n", "e"], descending=down).collect():
            own = [x for x in rows if x[0] == r.g]
            before = [x for x in own if (x[1] > r.v if down else x[1] < r.v)]
            assert r.n_before == sum(x[2] for x in before) and r.n_all == sum(x[2] for x in own)
            assert abs(r.e_before - sum(x[3] for x in before)) < 1e-9


def test_ranges_follow_the_data(spark):
    """All values in a narrow interval of one group are still spread over the ranges."""
    d = spark.range(40_000).select(F.lit("x").alias("g"), (F.lit(0.9) + F.col("id") / 400_000).alias("v"), F.lit(1).cast("bigint").alias("n"))
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else ranges this small are put together again
    try:
        sizes = [r["count"] for r in d.repartitionByRange("g", "v").groupBy(F.spark_partition_id().alias(BIN)).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
    assert len(sizes) == 4 and max(sizes) < 15_000
    got = cumulate(d, ["g"], "v", ["n"]).agg(F.max("n_before"), F.countDistinct("n_before")).first()
    assert list(got) == [39_999, 40_000]


def test_quantiles_and_empty(spark):
    v = [0.91, 0.92, 0.92, 0.97, None, float("nan")]
    d = spark.createDataFrame([("g", x) for x in v], "g string, x double")
    got = {r.prob: r.value for r in quantiles(d, ["g"], "x", [0.0, 0.3, 0.5, 1.0]).collect()}
    assert np.allclose([got[p] for p in (0.0, 0.3, 0.5, 1.0)], np.quantile([0.91, 0.92, 0.92, 0.97], [0.0, 0.3, 0.5, 1.0]))
    assert quantiles(d.limit(0), ["g"], "x", [0.5]).collect() == []


def test_rank_correlation_with_ties_and_hot_values(spark):
    import pandas as pd

    rng = random.Random(2)
    rows = [("a", rng.choice([0.0, 0.0, rng.random()]), round(rng.random(), 1)) for _ in range(500)] + [("b", 1.0, 2.0), ("c", 1.0, 2.0), ("c", 1.0, 3.0)]
    d = spark.createDataFrame(rows, "k string, x double, y double")
    got = {r.k: r.spearman for r in C.spearman(d, ["k"], "x", "y").collect()}
    p = pd.DataFrame(rows, columns=["k", "x", "y"]).query("k == 'a'")
    assert abs(got["a"] - p.x.rank().corr(p.y.rank())) < 1e-9
    assert got["b"] is None and got["c"] is None
