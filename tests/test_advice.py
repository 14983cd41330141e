"""Registered queries do the whole of their job."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from posegrain.operators import mining, profile
from posegrain.plans import pose_queries as Q
from posegrain.sources import models


def test_mock_source_has_all_parts(spark, tmp_path):
    spark.createDataFrame([(7, 1), (8, 2), (9, 50)], "p_partkey bigint, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    got = {(r.image_id, r.kp_idx): r.entropy for r in Q.ref_mock_source(spark, str(tmp_path)).collect()}
    assert set(got) == {(i, k) for i in (7, 8, 9) for k in range(17)}
    maps = models.mock_heatmaps(spark.createDataFrame([(8,), (9,)], "image_id bigint"), "bimodal", 48, 64, noise=0.05).where("kp_idx in (0, 16)")
    for r in maps.collect():
        p = np.array(r.hm) / np.sum(r.hm)
        assert p.size == 3072 and got[r.image_id, r.kp_idx] == pytest.approx(-(p[p > 0] * np.log(p[p > 0])).sum(), abs=2e-6)


def test_noise_of_mock_maps_is_seeded_by_image_joint_and_place(spark):
    ids = spark.createDataFrame([(3,), (4,)], "image_id bigint")
    n = {(r.image_id, r.kp_idx): r.n for r in ids.crossJoin(spark.range(17).selectExpr("cast(id as int) as kp_idx")).selectExpr("image_id", "kp_idx", "transform(sequence(0, 29), i -> shiftrightunsigned(xxhash64(image_id, kp_idx, i, 0), 11) / 9007199254740992D) as n").collect()}
    base = np.array(spark.range(1).select(F.expr(models.mock("bimodal", 5, 6))).first()[0])
    for r in models.mock_heatmaps(ids, "bimodal", 5, 6, noise=0.1).collect():
        want = base + 0.1 * np.array(n[r.image_id, r.kp_idx])
        assert r.hm == pytest.approx(want / want.max())


def test_ellipse_has_all_components_and_both_coordinates(spark, tmp_path):
    rows = [(1, 1, 5, 1, 10.0, 1000.0, 0.05, 0.02), (1, 1, 6, 1, 20.0, 1010.0, 0.1, 0.0), (1, 1, 7, 1, 30.0, 1020.0, 0.0, 0.08), (1, 2, 5, 1, 4.0, 500.0, 0.03, 0.01)]
    spark.createDataFrame(rows, "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_quantity double, l_extendedprice double, l_discount double, l_tax double").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = Q.ref_ellipse_all(spark, str(tmp_path)).collect()
    comps = {(r[0], r[1] - 1, i): r for r, i in zip(rows, (0, 1, 2, 0))}
    assert {(r.image_id, r.kp_idx, r.cand_idx, r.vertex) for r in got} == {(*k, v) for k in comps for v in range(64)} and len(got) == 256
    for r in got:
        _, _, _, _, quantity, price, discount, tax = comps[r.image_id, r.kp_idx, r.cand_idx]
        d = np.array([r.x - quantity, r.y - price % 48])
        cov = np.array([[1 + 50 * discount, 10 * discount - 0.5], [10 * discount - 0.5, 1 + 40 * tax]])
        assert d @ np.linalg.inv(cov) @ d == pytest.approx(4, abs=1e-4)


def test_cross_model_wants_three_models_of_one_dataset(spark, tmp_path):
    rows = [(1, "coco", "hrnet_w32", 0.1), (1, " COCO", "ResNet50", 0.2), (1, "coco", "vitpose_small", 0.6), (1, "coco", "vitpose_small", 0.4), (1, "crowd", "hrnet_w32", 0.9)]
    rows += [(2, "coco", "hrnet_w32", 0.1), (2, "coco", "resnet50", 0.2)]  # two models
    rows += [(3, "coco", "hrnet_w32", 0.1), (3, "coco", "resnet50", 0.2), (3, "crowd", "vitpose_small", 0.3)]  # three models, of two datasets
    rows += [(4, None, m, 0.1) for m in ("hrnet_w32", "resnet50", "vitpose_small")]
    p = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "packet_id bigint, image_id bigint, dataset string, model_name string, delta_oks double")
    rest = {c: F.lit(None).cast("double") for c in ("oks_base", "oks_ours", "nll", "entropy", "covariance_volume")}
    p.withColumns(rest | {"load_id": F.lit(1), "loaded_at": F.lit("2024-01-01").cast("timestamp")}).write.parquet(str(tmp_path / "packet_metric.parquet"))
    got = [tuple(r) for r in Q.ref_cross_model_all(spark, str(tmp_path)).collect()]
    assert got == [(1, "coco", 0.1, 0.2, 0.5, pytest.approx(0.8 / 3, abs=1e-6))]


def test_config_values_are_of_events_of_all_types(spark, tmp_path):
    rows = [(1, "2024-01-02 23:59:59", "error", '{"k": 1}'), (2, "2024-01-03 00:00:00", "error", '{"k": 2}'), (3, "2024-01-04 12:00:00", "click", '{"k": 3}'), (4, "2024-01-05 12:00:00", None, '{"k": 4}')]
    d = spark.createDataFrame(rows, "event_id bigint, ts string, event_type string, props string")
    d.withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(tmp_path / "events.parquet"))
    assert {r.event_id: str(r.k) for r in Q.ref_config_values_all(spark, str(tmp_path)).collect()} == {2: "2", 3: "3", 4: "4"}


def test_joint_features(spark):
    p = spark.createDataFrame([(1, 7), (2, 8), (3, 9)], "packet_id int, image_id int")
    rows = [(7, 1, 0, 1, 0.1, 0.9), (7, 2, 0, 2, 0.1, 0.2), (7, 2, 3, 1, 0.2, 0.7), (7, 2, 4, 1, 0.2, 0.7), (7, 2, 5, 1, None, 0.9), (8, 1, 0, 2, 0.5, 0.4)]
    j = spark.createDataFrame(rows, "image_id int, run_id int, kp_idx int, vis int, oks_base double, oks_ours double")
    got = {r.packet_id: (r.n_occluded, round(r.max_jump, 6), r.max_jump_kp) for r in mining.joint_features(p, j, ["image_id"]).collect()}
    assert got == {1: (3, 0.5, 3), 2: (0, 0.0, None), 3: (0, 0.0, None)}


def test_packet_mining_has_occluded_and_single_joint_lists(spark):
    got = {(r.query, r.place) for r in Q.ref_packet_mining(spark, "/root/testdata/sf0.01").collect()}
    assert {q for q, _ in got} >= {"wins", "bimodal", "regressions", "single_joint"} and ("single_joint", 20) in got


def test_fits_and_samples_draw_1000_points(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(1)
    spark.createDataFrame([(i, "a", rng.random(64).tolist()) for i in range(2)], "vec_id bigint, label string, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    assert {r["count"] for r in Q.ref_samples(spark, str(tmp_path)).groupBy("vec_id").count().collect()} == {1000}
    used = []
    fit = Q.mixture_fit.fit_heatmaps
    monkeypatch.setattr(Q.mixture_fit, "fit_heatmaps", lambda *a, n=1000, **how: used.append(n) or fit(*a, n=n, **how))
    for q in (Q.ref_fit, Q.ref_fit_repeats, Q.ref_image_pipeline):
        q(spark, str(tmp_path))
    assert used == [1000, 1000, 1000]


def test_value_counts_are_kept_across_openings(spark, tmp_path):
    path = str(tmp_path / "store")
    delta = lambda load: spark.createDataFrame([("t", "c", load, 1.0, None, 2)], "table_name string, column_name string, load_id int, num double, txt string, n bigint")
    profile.ValueCountStore(spark, path).apply(delta(1))
    (tmp_path / "store" / "data" / "v2").mkdir()  # a version that was not written to its end
    again = profile.ValueCountStore(spark, path)
    assert again.version == 1
    assert {(r.load_id, r.n) for r in again.apply(delta(2)).collect()} == {(1, 2), (2, 2)}
    assert profile.ValueCountStore(spark, path).version == 2
