"""Operators without SQL, on small tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from posegrain.operators import augment, cohorts, heatmap_ops, mining
from posegrain.operators import calibration as C
from posegrain.operators.mixture_fit import generator

MAPS = "id int, hm array<double>, hm_w int, hm_h int"


def test_focus_groups_are_disjoint_and_bounded(spark):
    rng = np.random.default_rng(1)
    rows = [(i, float(a), float(b), float(c)) for i, (a, b, c) in enumerate(rng.random((300, 3)))]
    d = spark.createDataFrame(rows, "packet_id int, oks_ours double, oks_base double, covariance_volume double")
    got = cohorts.focus_groups(d, "packet_id", n=20).collect()
    assert len({r.packet_id for r in got}) == len(got) and all(sum(r.group_name == g for r in got) == 20 for g in ("Wins", "Regressions", "High_Uncertainty", "Edge_Cases"))
    by = dict((r[0], r) for r in rows)
    assert all(by[r.packet_id][1] > by[r.packet_id][2] + 0.1 for r in got if r.group_name == "Wins")
    assert sorted(map(str, got)) == sorted(map(str, cohorts.focus_groups(d.repartition(5), "packet_id", n=20).collect()))
    assert cohorts.focus_groups(d.where("false"), "packet_id").count() == 0


def test_beta_search_both_ways(spark):
    rng = np.random.default_rng(2)
    rows = [("s", 1, float(a), float(b * 9), float(np.round(c, 1)), int(k)) for a, b, c, k in zip(*rng.random((3, 150)), rng.integers(1, 3, 150))]
    rows += [("s", 1, float("nan"), 1.0, 0.5, 1), ("s", 1, 0.5, float("nan"), 0.5, 2), ("s", 1, 0.5, 1.0, None, 2)]
    d = spark.createDataFrame(rows, "scope string, vis int, oks_ours double, cov_det double, base_score double, n_components int")
    key = lambda r: (r.strategy, r.beta, r.tau or 0)
    near = {key(r): r.ause for r in C.beta_search(d, ["scope"], [0.1, 2.0], [0.2]).collect()}
    far = {key(r): r.ause for r in C.beta_search(d, ["scope"], [0.1, 2.0], [0.2], group_rows=1).collect()}
    assert near.keys() == far.keys() and len(near) == 8 and all(near[k] == pytest.approx(far[k], abs=1e-9) for k in near)
    best = {r.strategy: r.ause for r in C.best_beta(C.beta_search(d, ["scope"], [0.1, 2.0], [0.2]), ["scope"]).collect()}
    assert best["softmax"] == min(v for k, v in near.items() if k[0] == "softmax")


def test_warp_and_blur(spark):
    rng = np.random.default_rng(3)
    hm = rng.random(12).tolist()
    d = spark.createDataFrame([(1, hm, 4, 3), (2, [2.0] * 12, 4, 3)], MAPS)
    blurred = {r.id: r.hm for r in heatmap_ops.blur(d, 4).collect()}
    assert blurred[2] == pytest.approx([2.0] * 12) and np.var(blurred[1]) < np.var(hm)
    for c, v in {"cx": 2.0, "cy": 1.5, "sx": 4.0, "sy": 3.0, "px": 1.0, "py": 1.0}.items():
        d = d.withColumn(f"o{c}", F.lit(v)).withColumn(f"s{c}", F.lit(v))
    assert {r.id: r.hm for r in heatmap_ops.warp(d).collect()}[1] == pytest.approx(hm)
    moved = heatmap_ops.warp(d.withColumn("scx", F.lit(3.0))).where("id = 1").first().hm
    assert moved[1] == pytest.approx(hm[0]) and moved[0] == 0.0


def test_images(spark):
    img = np.linspace(0, 255, 64).reshape(8, 8)
    for name in ("identity", "brightness", "contrast", "noise", "blur"):
        a, b = (augment.photometric(img, name, generator(1, name)) for _ in range(2))
        assert np.array_equal(a, b) and a.min() >= 0 and a.max() <= 255
    assert np.array_equal(augment.photometric(img, "identity", generator(1)), np.round(img)) and augment.odd(4) == 5
    assert augment.degraded(img, generator(1), contrast=0.5).std() < img.std()
    with pytest.raises(ValueError):
        augment.photometric(img, "invert", generator(1))


def test_packet_features(spark):
    p = spark.createDataFrame([(1,), (2,)], "packet_id int")
    c = spark.createDataFrame([(1, 0, 4, 0, 0.0, 0.0, 0.6), (1, 0, 4, 1, 9.0, 0.0, 0.4), (1, 1, 5, 0, 0.0, 0.0, 0.6), (1, 1, 5, 1, 1.0, 0.0, 0.4), (2, 0, 3, 0, 0.0, 0.0, 1.0)], "packet_id int, potential_idx int, kp_idx int, cand_idx int, mx double, my double, weight double")
    got = {r.packet_id: (r.n_bimodal, r.first_bimodal) for r in mining.packet_features(p, c).collect()}
    assert got == {1: (1, 4), 2: (0, None)}


def test_configurations_with_a_key_set(spark):
    from pyspark.sql import functions as F

    from posegrain.functions import scalars as S

    rows = ['{"a":{"b":1,"c":[1,2]},"d":"x"}', '{"a":5}', "no json", None]
    d = spark.createDataFrame([(r,) for r in rows], "config string")
    import json

    got = [json.loads(r[0]) for r in d.select(S.config_with("config", "a.b", '{"k": "it\'s"}')).collect()]
    assert got == [{"a": {"b": {"k": "it's"}, "c": [1, 2]}, "d": "x"}, {"a": {"b": {"k": "it's"}}}, {"a": {"b": {"k": "it's"}}}, {"a": {"b": {"k": "it's"}}}]
    assert d.select(F.col("config")).count() == 4


def test_phantoms_of_images_without_swaps(spark):
    from posegrain.operators import mining
    from posegrain.schema import joint_dim

    j = spark.createDataFrame([(i, 7, 0, 0.9, 2.0) for i in (1, 2, 3)], "image_id int, kp_idx int, vis int, base_score double, cov_det double")
    images = spark.createDataFrame([(1, 0, 0.5), (2, 1, 0.5), (3, 0, 0.1)], "image_id int, swaps_base int, oks_ours double")
    assert [r.image_id for r in mining.phantom_joints(j, joint_dim(spark), ["image_id"], images=images).collect()] == [1]
    d = spark.createDataFrame([(1, 3.0), (1, 5.0), (2, 1.0), (2, None)], "k int, v double")
    assert sorted(tuple(r) for r in mining.best_of_each(d, ["k"], [d.v.desc_nulls_last()]).collect()) == [(1, 5.0), (2, 1.0)]
