"""A query whose result alone was beyond the disk returns the same rows in fewer bytes."""

import math

import numpy as np
from pyspark.sql import functions as F


def test_rounded_is_round_to_the_same_bit(spark):
    from posegrain.functions import scalars as S

    rng = np.random.default_rng(3)
    ties = (rng.integers(-(10**9), 10**9, 20_000) + 0.5) / 1e6
    values = [*rng.uniform(-60, 60, 20_000), *ties, *np.nextafter(ties, math.inf), *rng.uniform(-1e14, 1e14, 5_000), *rng.uniform(-2e6, 2e6, 5_000), 0.0, -0.0, -1e-7, 5e-7, -5e-7, math.nan, math.inf, -math.inf, 1e300]
    d = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
    d = d.select("v", F.expr(S.rounded("v")).cast("string").alias("got"), (F.round("v", 6) + F.lit(0.0)).cast("string").alias("want"))
    assert d.where("not got <=> want").collect() == []


def _line_items(spark, path, copies):
    """3,000 components; each copy has other order keys."""
    d = spark.range(3000 * copies).selectExpr("id div 3000 as r", "id % 3000 as i")
    d = d.selectExpr("(i div 3) + r * 1000 as l_orderkey", "cast(i % 2 + 1 as int) as l_linenumber", "i as l_partkey", "i % 7 as l_suppkey", "cast(1 + i % 50 as double) as l_quantity", "900 + pmod(hash(i), 9000000) / 100D as l_extendedprice", "(i % 11) / 100D as l_discount", "(i % 9) / 100D as l_tax")
    d.repartition(4, F.rand(5)).write.parquet(f"{path}/lineitem.parquet")


def test_ellipses_of_one_shape_stand_together(spark, tmp_path):
    from posegrain.functions import mixtures as G
    from posegrain.plans import pose_queries as Q

    _line_items(spark, tmp_path, 30)
    q = Q.ref_ellipse_all(spark, str(tmp_path))
    q.write.parquet(str(tmp_path / "out"))
    got = spark.read.parquet(str(tmp_path / "out"))
    c = Q.components(spark, str(tmp_path)).select("image_id", "kp_idx", "cand_idx", F.posexplode(F.expr(G.ellipse())).alias("vertex", "p"))
    want = Q.rounded(c.select("image_id", "kp_idx", "cand_idx", "vertex", "p.x", "p.y"))
    assert q.dtypes == want.dtypes and got.count() == want.count() == 90_000 * 64
    sums = [d.select(F.sum(F.xxhash64(*d.columns).cast("decimal(38,0)"))).first()[0] for d in (got, want)]
    assert sums[0] == sums[1]
    size = sum(p.stat().st_size for p in (tmp_path / "out").glob("*.parquet"))
    assert size < 150 * 90_000  # a component's 64 vertices; 8 bytes for x and y each would be 1,024


def test_ellipses_of_no_and_of_equal_line_items(spark, tmp_path):
    from posegrain.plans import pose_queries as Q

    _line_items(spark, tmp_path / "none", 0)
    assert Q.ref_ellipse_all(spark, str(tmp_path / "none")).count() == 0
    spark.range(5).selectExpr("1L as l_orderkey", "2 as l_linenumber", "3L as l_partkey", "4L as l_suppkey", "5D as l_quantity", "cast(null as double) as l_extendedprice", "0D as l_discount", "0D as l_tax").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = Q.ref_ellipse_all(spark, str(tmp_path)).collect()
    assert sorted((r.cand_idx, r.vertex) for r in got) == [(c, v) for c in range(5) for v in range(64)]
    assert all(r.x is not None and r.y is None for r in got)


def test_a_frequent_shape_is_spread_over_tasks(spark, tmp_path, monkeypatch):
    from posegrain.plans import pose_queries as Q

    monkeypatch.setattr(Q, "ELLIPSES", 500)
    spark.range(4000).selectExpr("id as l_orderkey", "1 as l_linenumber", "3L as l_partkey", "4L as l_suppkey", "5D as l_quantity", "6D as l_extendedprice", "0D as l_discount", "0D as l_tax").write.parquet(str(tmp_path / "lineitem.parquet"))
    rows = Q.ref_ellipse_all(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in rows) == 4000 * 64 and max(r["count"] for r in rows) < 1200 * 64


def test_a_written_table_keeps_no_shuffle(spark):
    from posegrain import session

    kept = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().size()
    set_before, n = spark.conf.get(session.ENDS_SHUFFLES), kept()
    d = session.materialize(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "kept", end_shuffles=True)
    assert kept() <= n and d.count() == 7 and spark.conf.get(session.ENDS_SHUFFLES) == set_before
