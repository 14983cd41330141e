"""Operators of poses, heatmaps and mixtures against known answers and brute force."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from posegrain.functions import heatmaps as H
from posegrain.functions import mixtures as G
from posegrain.functions import scalars as S
from posegrain.functions.registry import register
from posegrain.operators import calibration as C
from posegrain.operators import heatmap_ops, poses, prefix, skeleton
from posegrain.operators import mixture_fit as M
from posegrain.schema import KEYPOINTS, edges, joint_dim


def value(spark, column):
    return spark.range(1).select(column).first()[0]


def test_similarity_known_answers(spark):
    assert value(spark, S.l2(F.lit(3.0), F.lit(4.0))) == 5.0
    assert value(spark, S.oks(F.lit(0.0), F.lit(1e4), F.lit(0.05), F.lit(2))) == 1.0
    assert value(spark, S.oks(F.lit(0.0), F.lit(1e4), F.lit(0.05), F.lit(0))) is None and value(spark, S.oks(F.lit(1.0), F.lit(0.0), F.lit(0.05))) is None
    register(spark)
    assert spark.sql("select pg_slug('  a--b c!'), pg_fuse_gate(0.1, 0.9, 2)").first() == ("a_b_c", 0.9)


@pytest.mark.parametrize("row, mode", [((0.9, 1.0, 1, 0.7), "Denoised"), ((0.2, 1.0, 1, 0.2), "Failure"), ((0.9, 1.0, 1, 0.9), "Robust"), ((0.5, 3.5, 2, 0.5), "Ambiguous"), ((0.4, 1.0, 1, 0.4), "Overconfident"), ((0.5, 2.7, 1, 0.5), "Honest_Uncertainty"), ((0.7, 2.2, 1, 0.7), "Robust")])
def test_failure_modes(spark, row, mode):
    assert value(spark, S.failure_mode(*(F.lit(x) for x in row))) == mode


def test_entropy_of_a_unit_gaussian_and_volumes(spark):
    comps = "array(named_struct('mx', 0D, 'my', 0D, 'cxx', 1D, 'cxy', 0D, 'cyy', 1D, 'weight', 1D))"
    assert value(spark, F.expr(G.entropy_bound(comps))) == pytest.approx(math.log(2 * math.pi * math.e), abs=1e-6)
    two = "array(named_struct('cxx', 1D, 'cxy', 0D, 'cyy', 1D, 'weight', 0.8D), named_struct('cxx', 4D, 'cxy', 0D, 'cyy', 4D, 'weight', 0.2D))"
    assert value(spark, F.expr(G.weighted_volume(two))) == pytest.approx(1.6) and value(spark, F.expr(G.dominant_volume(two))) == 1.0


def test_wasserstein_and_kl_of_equal_parts(spark):
    same = spark.sql("select named_struct('mx', 1D, 'my', 2D, 'cxx', 3D, 'cxy', 1D, 'cyy', 2D) a, named_struct('mx', 1D, 'my', 2D, 'cxx', 3D, 'cxy', 1D, 'cyy', 2D) b")
    r = same.select(*(F.expr(e).alias(n) for n, e in G.divergences().items())).first()
    assert abs(r.kl_divergence) < 1e-9 and abs(r.wasserstein_sq) < 1e-6


def test_ause_against_numpy(spark):
    rng = np.random.default_rng(1)
    err, unc = rng.random(257), np.round(rng.random(257), 2)
    d = spark.createDataFrame([("k", float(e), float(u)) for e, u in zip(err, unc)], "k string, err double, unc double")
    assert C.ause(d, ["k"], last_point="clip").first().ause == pytest.approx(C.ause_array(err, unc), abs=1e-9)
    distinct = rng.permutation(257) / 257.0

    def plainly(order):
        left = [err[order][int(f * 257) :].mean() if f < 1 else 0 for f in np.linspace(0, 1, 100)]
        return np.trapezoid(left, np.linspace(0, 1, 100))

    d = spark.createDataFrame([("k", float(e), float(u)) for e, u in zip(err, distinct)], "k string, err double, unc double")
    assert C.ause(d, ["k"]).first().ause == pytest.approx(plainly(np.argsort(-distinct)) - plainly(np.argsort(-err)), abs=1e-9)
    one = spark.createDataFrame([("k", 1.0, 1.0), ("n", None, 1.0), ("m", 1.0, float("nan"))], "k string, err double, unc double")
    assert [tuple(r) for r in C.ause(one, ["k"]).collect()] == [("k", 1, 0.0)]


def test_auroc_and_quantiles(spark):
    rng = np.random.default_rng(2)
    rows = [(None if i % 3 else "g", float(np.round(rng.normal(), 1)), bool(rng.random() < 0.3)) for i in range(300)]
    d = spark.createDataFrame(rows, "g string, s double, p boolean")
    for r in C.auroc(d, ["g"], "s", "p").collect():
        pos, neg = ([s for g, s, p in rows if g == r.g and p == want] for want in (True, False))
        assert r.auroc == pytest.approx(sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg))
    for r in prefix.quantiles(d, ["g"], "s", [0.0, 0.1, 0.5, 0.77, 1.0]).collect():
        assert r.value == pytest.approx(np.quantile([s for g, s, _ in rows if g == r.g], r.prob))


def test_heatmap_functions(spark):
    hm = [0.0, 1.0, 2.0, 0.0, 4.0, 0.0]
    d = spark.createDataFrame([(1, 3, hm, 3, 2), (2, 0, [5.0] * 6, 3, 2), (3, 0, [0.0] * 6, 3, 2)], "id int, kp_idx int, hm array<double>, hm_w int, hm_h int")
    n = {r.id: r.norm for r in heatmap_ops.normalize(d).collect()}
    assert n[1] == [x / 4 for x in hm] and n[2] == [5.0] * 6
    a = heatmap_ops.decode_argmax(d).where("id = 1").first()
    assert (a.px, a.py, a.score) == (1, 1, 4.0)
    e = {r.id: r.e for r in d.select("id", F.expr(H.entropy("hm")).alias("e")).collect()}
    assert e[2] == pytest.approx(math.log(6)) and e[3] == 0.0
    twice = heatmap_ops.inverse_flip(heatmap_ops.inverse_flip(d, joint_dim(spark)), joint_dim(spark))
    assert {r.id: (r.kp_idx, r.hm) for r in twice.collect()} == {r.id: (r.kp_idx, r.hm) for r in d.collect()}
    with pytest.raises(ValueError):
        heatmap_ops.aggregate_scales(d, ["kp_idx"], "median")


def test_coordinates_round_trip(spark):
    for size, hm, dsf in ((192.0, 48.0, None), (256.0, 64.0, 3.9842)):
        px = S.pixel_scale(F.lit(300.0), F.lit(size), F.lit(hm), None if dsf is None else F.lit(dsf))
        image = S.to_image(F.lit(17.25), px, F.lit(55.0), F.lit(300.0))
        assert value(spark, S.to_heatmap(image, px, F.lit(55.0), F.lit(300.0))) == pytest.approx(17.25, abs=1e-9)


def test_mixture_fits():
    rng = np.random.default_rng(42)
    blobs = np.concatenate((rng.normal((5, 10), 2, (500, 2)), rng.normal((25, 10), 2, (500, 2))))
    name, m = M.select(blobs, rng)
    assert name == "bimodal" and np.allclose(sorted(m.mean[:, 0]), [5, 25], atol=0.7)
    one = rng.normal((10, 20), 2, (1000, 2))
    k1 = M.fit(one, 1, rng)
    assert np.allclose(k1.mean[0], [10, 20], atol=0.3) and k1.bic(1000) - k1.aic() == pytest.approx(6 * (math.log(1000) - 2))
    noisy = M.fit(np.concatenate((one, rng.uniform(-50, 50, (100, 2)))), 1, rng)
    assert noisy.uniform > k1.uniform
    x = rng.uniform(0, 10, 100)
    line = M.fit(np.column_stack((x, 1.5 * x - 0.5 + rng.normal(0, 1e-3, 100))), 1, rng)
    assert np.linalg.eigvalsh(line.cov[0]).min() > 0
    with pytest.raises(ValueError):
        M.fit(np.zeros((2, 2)), 2, rng)


@pytest.mark.parametrize("method", sorted(M.SAMPLERS))
def test_samplers_have_the_map_s_mean(method):
    y, x = np.mgrid[0:64, 0:48]
    hm = np.exp(-((x - 24) ** 2 + (y - 32) ** 2) / 32)
    p = M.sample(hm, 4000, method, M.generator(1, "a"))
    assert np.allclose(p.mean(0), [24, 32], atol=0.8) and np.array_equal(p, M.sample(hm, 4000, method, M.generator(1, "a")))
    for bad in (-hm, hm * 0):
        with pytest.raises(ValueError):
            M.sample(bad, 10, method, M.generator(1))


def test_decoding_against_all_combinations(spark):
    rng = np.random.default_rng(5)
    tree = edges(nodes=6)
    rows = [(img, float(rng.integers(1, 5000)), k, c, *(float(v) for v in rng.uniform(0, 60, 2)), 2.0, 0.1, 3.0, float(rng.random())) for img in range(12) for k in range(6) if rng.random() < 0.85 for c in range(rng.integers(1, 4))]
    area = {r[0]: r[1] for r in reversed(rows)}
    rows = [(r[0], area[r[0]], *r[2:]) for r in rows]
    d = spark.createDataFrame(rows, "image_id int, area double, kp_idx int, cand_idx int, mx double, my double, cxx double, cxy double, cyy double, weight double")
    got = {(r.image_id, r.kp_idx): r.cand_idx for r in skeleton.decode(d, tree, ["image_id"]).collect()}
    for img in area:
        cands = {k: [r for r in rows if r[0] == img and r[2] == k] for k in range(6)}
        nodes = [k for k in cands if cands[k]]
        ra = math.sqrt(max(area[img], 1))

        def score(pick):
            s = sum(math.log(r[9]) - 0.5 * math.log(r[6] * r[8] - r[7] ** 2) for r in pick.values())
            return s + sum(-0.5 * ((math.dist(pick[p][4:6], pick[c][4:6]) - m * ra) / (sd * ra)) ** 2 for p, c, m, sd, _ in tree if p in pick and c in pick)

        best = max((dict(zip(nodes, combo)) for combo in itertools.product(*(cands[k] for k in nodes))), key=score)
        assert {k: got[img, k] for k in nodes} == {k: r[3] for k, r in best.items()}


def test_alignment_and_swaps(spark):
    gt = spark.createDataFrame([(1, "left_hip", 1.0, 2.0, 1.0), (1, "neck", 5.0, 5.0, 1.0), (1, "nose", 3.0, 3.0, 0.5)], "image_id int, name string, x double, y double, confidence double")
    a = {r.kp_idx: (r.x, r.y, r.vis) for r in poses.align_to_joints(gt, ["image_id"]).collect()}
    assert len(a) == 17 and a[KEYPOINTS.index("left_hip")] == (1.0, 2.0, 2) and a[0] == (3.0, 3.0, 1) and a[16] == (0.0, 0.0, 0)
    pairs = spark.createDataFrame([(1, 5, 90.0, 0.0, 10.0, 0.0, 2, 1e4, 0.079), (1, 6, 10.0, 0.0, 90.0, 0.0, 2, 1e4, 0.079), (2, 5, 10.0, 0.0, 10.0, 0.0, 0, 1e4, 0.079)], "image_id int, kp_idx int, px double, py double, gx double, gy double, vis int, area double, kappa double")
    from posegrain.schema import pair_dim

    assert [(r.image_id, r.swapped) for r in poses.limb_swaps(pairs, pair_dim(spark), ["image_id"]).collect()] == [(1, True)]
    assert {r.image_id: r.oks for r in poses.image_oks(pairs, ["image_id"]).collect()}[2] == 0.0
