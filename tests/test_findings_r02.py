"""Queries that failed on about 1 GB of tables do the same job within less."""

import numpy as np
import pytest

from posegrain.operators import calibration as C

TAUS = [0.2, 0.01, 0.5]


def _areas(err, det, two, ub, betas):
    """Every curve by sorting all rows."""
    oracle = C.retained_error(err, err)
    for beta in betas:
        ug = 1 - np.exp(-beta * det)
        eb, eg = np.exp(ub), np.exp(ug)
        yield ("max_pooling", beta, None), C.ause_array(err, np.maximum(ub, ug), oracle)
        yield ("gating_k", beta, None), C.ause_array(err, np.where(two, ug, ub), oracle)
        yield ("softmax", beta, None), C.ause_array(err, (eb * ub + eg * ug) / (eb + eg), oracle)
        for t in TAUS:
            yield ("gating_tau", beta, t), C.ause_array(err, np.where(two | (ug > t), ug, ub), oracle)


@pytest.mark.parametrize("rows, held, apart", [(2, 1 << 20, 1 << 20), (73, 1 << 20, 1 << 20), (5000, 1 << 20, 1 << 20), (5000, 0, 40)])
@pytest.mark.parametrize("outside", [False, True])
def test_areas_from_bins_are_those_of_sorted_rows(monkeypatch, rows, held, apart, outside):
    from posegrain.operators import grid

    monkeypatch.setattr(grid, "HELD", held)
    monkeypatch.setattr(grid, "APART", apart)
    rng = np.random.default_rng(rows)
    err, det, two, ub = rng.random(rows), np.exp(rng.normal(0, 4, rows)), rng.random(rows) < 0.3, np.round(rng.random(rows), 3)
    err[::3], det[::5], ub[::11] = 0.25, 0.0, 1.0
    if outside:  # scores that are no probabilities
        ub[::7] = rng.normal(0, 3, len(ub[::7]))
    betas = [1e-6, 0.1, 2.0, 1e4]
    got = grid.areas(lambda: ((err[i : i + 97], det[i : i + 97], two[i : i + 97], ub[i : i + 97]) for i in range(0, rows, 97)), rows, betas, TAUS)
    want = dict(_areas(err, det, two, ub, betas))
    assert {x[:3] for x in got} == want.keys()
    for *key, area in got:
        assert area == pytest.approx(want[tuple(key)], abs=1e-9)


def test_rows_of_large_groups_are_not_multiplied_by_the_grid(spark):
    rng = np.random.default_rng(4)
    rows = [(None if i % 2 else "s", 1, *map(float, rng.random(3)), int(rng.integers(1, 3))) for i in range(400)] + [("t", 2, 0.5, 1.0, 0.5, 1)] * 3
    d = spark.createDataFrame(rows, "scope string, vis int, oks_ours double, cov_det double, base_score double, n_components int")
    near, far = (C.beta_search(d, ["scope"], [0.1, 1.0, 2.0], TAUS, chunk=2, **how) for how in ({}, {"group_rows": 10}))
    plan = far._jdf.queryExecution().optimizedPlan().toString()
    assert "beta AS" not in plan and "explode" not in plan.lower()
    key = lambda r: (r.scope, r.strategy, r.beta, r.tau, r.n_rows)
    near, far = ({key(r): r.ause for r in x.collect()} for x in (near, far))
    assert near.keys() == far.keys() and len(near) == 3 * 3 * 6 and all(near[k] == pytest.approx(far[k], abs=1e-9) for k in near)


def test_entropies_of_mock_maps_are_those_of_the_maps_themselves(spark):
    from posegrain.sources import models

    ids = spark.createDataFrame([(0,), (-5,), (1 << 40,), (None,)], "image_id bigint")
    for mode, noise, seed in (("bimodal", 0.05, 0), ("unimodal", 0.3, -7), ("uniform", 0.0, 0), ("noisy", 0.2, 3)):
        got = {(r.image_id, r.kp_idx): r.entropy for r in models.mock_entropy(ids, mode, 7, 9, noise, seed).collect()}
        maps = {(r.image_id, r.kp_idx): np.array(r.hm) for r in models.mock_heatmaps(ids, mode, 7, 9, noise, seed).collect()}
        assert got.keys() == maps.keys() and len(got) == 68
        for k, m in maps.items():
            p = m[m > 0] / m.sum()
            assert got[k] == pytest.approx(-(p * np.log(p)).sum(), abs=1e-9)
    with pytest.raises(ValueError):
        models.mock_entropy(ids, "bimodal", noise=-0.1)


def test_mock_source_makes_no_map_in_a_row_of_its_own(spark, tmp_path):
    from posegrain.plans import pose_queries as Q

    spark.createDataFrame([(7,), (8,)], "p_partkey bigint").write.parquet(str(tmp_path / "part.parquet"))
    plan = Q.ref_mock_source(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan  # lambdas are interpreted for each pixel


def test_ellipse_vertices_are_compiled_and_as_before(spark, tmp_path):
    from pyspark.sql import functions as F

    from posegrain.functions import mixtures as G
    from posegrain.plans import pose_queries as Q

    q = Q.ref_ellipse_all(spark, "/root/testdata/sf0.001")
    assert "lambda" not in q._jdf.queryExecution().optimizedPlan().toString()
    c = Q.components(spark, "/root/testdata/sf0.001").select("image_id", "kp_idx", "cand_idx", F.posexplode(F.expr(G.ellipse())).alias("vertex", "p"))
    c = Q.rounded(c.select("image_id", "kp_idx", "cand_idx", "vertex", "p.x", "p.y"))
    assert q.dtypes == c.dtypes and q.count() == c.count() and q.exceptAll(c).count() == 0
