import numpy as np
import pytest

from posegrain.operators import mixture_fit as M
from posegrain.operators import pipeline as P
from posegrain.schema import pair_dim

JOINTS = "image_id bigint, kp_idx int, gx double, gy double, hx double, hy double, bx double, by double, vis int, area double, kappa double"
COMPS = "image_id bigint, kp_idx int, cand_idx int, mx double, my double, cxx double, cxy double, cyy double, weight double"


def plain_rounds(x, mean, cov, weight, uniform, density, rounds, reg):
    """The EM rounds written out point by point and component by component."""
    for _ in range(rounds):
        r = np.zeros((len(x), len(weight) + 1))
        for i, p in enumerate(x):
            for j in range(len(weight)):
                d = p - mean[j]
                r[i, j] = weight[j] * np.exp(-0.5 * d @ np.linalg.inv(cov[j]) @ d) / (2 * np.pi * np.sqrt(np.linalg.det(cov[j])))
            r[i, -1] = uniform * density
            r[i] /= r[i].sum()
        n = r.sum(0)
        mean = np.array([(r[:, j, None] * x).sum(0) / n[j] for j in range(len(weight))])
        cov = np.array([sum(r[i, j] * np.outer(x[i] - mean[j], x[i] - mean[j]) for i in range(len(x))) / n[j] for j in range(len(weight))])
        weight, uniform = n[:-1] / n.sum(), n[-1] / n.sum()
    return mean, cov, weight, uniform


@pytest.mark.parametrize("rounds", [1, 3])
def test_rounds_against_the_formulas(rounds):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal((5, 5), 1, (70, 2)), rng.normal((20, 9), 2, (30, 2))])
    m0, c0, w0, u0 = M.start(x, 2, np.random.default_rng(7), 0.1, 1e-6, "kmeans")
    assert sorted(np.round(w0, 2)) == [0.27, 0.63] and u0 == pytest.approx(0.1)  # shares of the clusters, not equal ones
    got = M.fit(x, 2, np.random.default_rng(7), bbox=(0, 0, 32, 32), max_iter=rounds, tol=0)
    mean, cov, weight, uniform = plain_rounds(x, m0, c0, w0, u0, 1 / 1024, rounds, 1e-6)
    assert np.allclose(got.mean, mean) and np.allclose(got.cov, cov) and np.allclose(got.weight, weight) and got.uniform == pytest.approx(uniform)


def test_known_mixtures_come_back():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal((10, 10), 1.5, (1400, 2)), rng.normal((40, 30), 3, (600, 2))])
    for init in ("kmeans", "random"):
        name, m = M.select(x, np.random.default_rng(3), init=init)
        at = np.argsort(m.mean[:, 0])
        assert name == "bimodal" and np.allclose(m.mean[at], [[10, 10], [40, 30]], atol=0.5) and np.allclose(m.weight[at], [0.7, 0.3], atol=0.05) and m.dead == 0
    assert M.select(x[:1400], np.random.default_rng(3))[0] == "unimodal"
    with pytest.raises(ValueError, match="start"):
        M.fit(x, 2, rng, init="none")


def test_start_of_empty_and_single_clusters():
    x = np.array([[0.0, 0.0]] * 5 + [[9.0, 9.0]])
    mean, cov, weight, uniform = M.start(x, 2, np.random.default_rng(0), 0.2, 1e-6, "kmeans")
    lone = int(np.argmax(mean[:, 0]))
    assert np.allclose(cov[lone], 10 * np.eye(2)) and weight[lone] == pytest.approx(0.8 / 6) and weight.sum() + uniform == pytest.approx(1)


def test_images_from_joints_to_packets(spark):
    """Two images, one degenerate; a joint without candidates keeps the baseline; swaps are corrected."""
    joints = [(1, 5, 0.0, 0.0, 0.0, 0.0, 40.0, 0.0, 2, 900.0, 0.079), (1, 6, 40.0, 0.0, 40.0, 0.0, 0.0, 0.0, 2, 900.0, 0.079), (1, 0, 5.0, 5.0, 5.0, 5.0, 5.0, 5.0, 0, 900.0, 0.026), (2, 0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 2, 0.5, 0.026)]
    comps = [(1, 5, 0, 0.0, 0.0, 4.0, 0.0, 4.0, 0.9), (1, 6, 0, 40.0, 0.0, 4.0, 0.0, 4.0, 0.6), (1, 6, 1, 0.0, 0.0, 1.0, 0.0, 1.0, 0.3)]
    c = spark.createDataFrame(comps, COMPS)
    j = P.usable(spark.createDataFrame(joints, JOINTS))
    j = P.fallback(c.where("cand_idx = 0").selectExpr("image_id", "kp_idx", "mx as x", "my as y"), j, ["image_id"])
    methods = {"base": ("bx", "by"), "ours": ("ox", "oy")}
    m = P.joint_measures(j, P.mixtures_of(c, ["image_id"]), ["image_id"], methods)
    (e,) = (ev := P.evaluate_images(m, pair_dim(spark), ["image_id"], methods)).collect()
    assert (e.image_id, e.n_joints, e.n_visible) == (1, 3, 2) and e.oks_ours == pytest.approx(1) and e.oks_base < 0.01 and e.n_components == 1.5
    assert (e.swaps_base_00, e.swaps_ours_00, e.corrected_ours_00, e.introduced_ours_00) == (1, 0, 1, 0)
    density = 0.1 / 3072 + 0.9 / (2 * np.pi * 4), 0.1 / 3072 + 0.6 / (2 * np.pi * 4)
    assert e.nll == pytest.approx(-np.log(density).mean(), abs=1e-6)
    (p,) = P.deep_packets(m, ev, ["image_id"], methods).collect()
    assert [(t.kp_idx, t.x) for t in p.ground_truth] == [(0, 5.0), (5, 0.0), (6, 40.0)] and [t.x for t in p.predictions["ours"]] == [5.0, 0.0, 40.0]
    assert [(u.kp_idx, len(u.comps)) for u in p.unary] == [(5, 1), (6, 2)] and p.metrics.swaps_base_00 == 1
    (t,) = P.swap_totals(ev, [], "swaps_base_00", "swaps_ours_00").collect()
    assert t.net_reduction_pct == 100.0
    assert P.evaluate_images(m.limit(0), pair_dim(spark), ["image_id"], methods).count() == 0
