"""Sampling of heatmaps and fitting of Gaussian-plus-uniform mixtures.

Iterations stay inside one task: a joint's map comes in, its fitted mixture goes out, and the samples never leave the
worker.  Every random number comes from a generator seeded by the row's own key, so results do not depend on the order
of rows, on partitions or on retries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame

PART = "struct<mx:double,my:double,cxx:double,cxy:double,cyy:double,weight:double,n:int>"
FIT = f"model_type string, uniform_weight double, log_likelihood double, aic double, bic double, n_iterations int, converged boolean, n_dead int, components array<{PART}>"
TINY = 1e-300


def generator(seed: int, *key) -> np.random.Generator:
    """Random numbers that depend on the seed and the row's key only."""
    return np.random.default_rng(xxhash.xxh3_64_intdigest(repr((seed, *key)).encode()))


def spread(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows over some tasks a core: fitting costs far more than moving a map, and input files are few."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *keys)


# ---- sampling


def prepare(hm: np.ndarray, temperature: float = 1.0) -> np.ndarray:
    """A non-negative map with mass as a distribution; errors for other maps."""
    if hm.ndim != 2:
        raise ValueError("a heatmap has two dimensions")
    if (hm < 0).any():
        raise ValueError("a heatmap must not be negative")
    if hm.sum() < 1e-6:
        raise ValueError("a heatmap needs mass")
    p = hm / hm.sum()
    if temperature != 1:
        p = np.maximum(p, 1e-10) ** (1 / temperature)
        p /= p.sum()
    return p


def draw_rejection(p: np.ndarray, n: int, rng: np.random.Generator, batch: int = 5000, max_rounds: int = 100) -> np.ndarray:
    h, w = p.shape
    top, got, have = p.max(), [], 0
    for _ in range(max_rounds):
        at = rng.integers(0, h * w, batch)
        keep = at[rng.random(batch) * top < p.ravel()[at]]
        got.append(keep)
        have += len(keep)
        if have >= n:
            at = np.concatenate(got)[:n]
            return np.column_stack((at % w, at // w)).astype(float)
    raise RuntimeError("rejection sampling found too few points")


def draw_importance(p: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    at = np.minimum(np.searchsorted(np.cumsum(p.ravel()), rng.random(n), side="right"), p.size - 1)
    return np.column_stack((at % p.shape[1], at // p.shape[1])).astype(float)


def cell_masses(p: np.ndarray, cells: int = 8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mass of each cell of a grid, with the grid's row and column edges."""
    ys, xs = (np.linspace(0, s, min(cells, s) + 1).astype(int) for s in p.shape)
    return np.add.reduceat(np.add.reduceat(p, ys[:-1], 0), xs[:-1], 1), ys, xs


def draw_stratified(p: np.ndarray, n: int, rng: np.random.Generator, cells: int = 8) -> np.ndarray:
    mass, ys, xs = cell_masses(p, cells)
    counts = rng.multinomial(n, mass.ravel() / mass.sum())
    cell = np.repeat(np.arange(mass.size), counts)
    r, c = cell // mass.shape[1], cell % mass.shape[1]
    return np.column_stack((xs[c] + rng.random(n) * (xs[c + 1] - xs[c]), ys[r] + rng.random(n) * (ys[r + 1] - ys[r])))


SAMPLERS = {"rejection": draw_rejection, "importance": draw_importance, "stratified": draw_stratified}


def sample(hm: np.ndarray, n: int, method: str, rng: np.random.Generator, temperature: float = 1.0, jitter: float = 0.0) -> np.ndarray:
    """(n, 2) points x, y of a map.  Unknown methods are an error."""
    if method not in SAMPLERS:
        raise ValueError(f"unknown sampler {method!r}")
    points = SAMPLERS[method](prepare(hm, temperature), n, rng)
    return points + rng.uniform(-jitter, jitter, points.shape) if jitter else points


def sample_table(df: DataFrame, keys: list[str], n: int = 1000, method: str = "importance", temperature: float = 1.0, jitter: float = 0.0, seed: int = 0) -> DataFrame:
    """(keys..., sample_idx, x, y): samples of each map; maps that are null, negative or without mass have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.to_dict("records"):
                try:
                    xy = sample(np.asarray(r["hm"], float).reshape(r["hm_h"], r["hm_w"]), n, method, generator(seed, *(r[k] for k in keys)), temperature, jitter)
                except (ValueError, TypeError):
                    continue
                yield pd.DataFrame({k: r[k] for k in keys} | {"sample_idx": np.arange(n, dtype="int32"), "x": xy[:, 0], "y": xy[:, 1]})

    kinds = dict(df.dtypes)
    return spread(df.select(*keys, "hm", "hm_h", "hm_w"), keys).mapInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", sample_idx int, x double, y double")


# ---- mixtures


@dataclass
class Mixture:
    mean: np.ndarray
    cov: np.ndarray
    weight: np.ndarray
    uniform: float
    density: float
    ll: float = -np.inf
    iterations: int = 0
    converged: bool = False
    dead: int = 0
    counts: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def bic(self, n: int) -> float:
        return 6 * len(self.weight) * np.log(n) - 2 * self.ll

    def aic(self) -> float:
        return 12 * len(self.weight) - 2 * self.ll


def regularized(cov: np.ndarray, reg: float = 1e-6) -> np.ndarray:
    """Positive definite 2 x 2 matrices: the smallest eigenvalue is lifted to reg or above."""
    low = (cov[..., 0, 0] + cov[..., 1, 1]) / 2 - np.hypot((cov[..., 0, 0] - cov[..., 1, 1]) / 2, cov[..., 0, 1])
    lift = np.where(low < reg, reg - np.minimum(0, low), 0)
    return cov + lift[..., None, None] * np.eye(2)


def densities(x: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
    """(n, k) Gaussian densities."""
    d = x[:, None, :] - mean[None]
    det = cov[:, 0, 0] * cov[:, 1, 1] - cov[:, 0, 1] ** 2
    ok = det > 0
    safe = np.where(ok, det, 1)
    m = (cov[:, 1, 1] * d[..., 0] ** 2 - 2 * cov[:, 0, 1] * d[..., 0] * d[..., 1] + cov[:, 0, 0] * d[..., 1] ** 2) / safe
    return np.where(ok, np.exp(-0.5 * np.minimum(m, 700)) / (2 * np.pi * np.sqrt(safe)), 0)


def seeds(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k starting means by squared-distance sampling, then a few rounds of nearest-mean averaging."""
    means = [x[rng.integers(len(x))]]
    for _ in range(k - 1):
        d = np.min(((x[:, None] - np.array(means)[None]) ** 2).sum(-1), 1)
        means.append(x[rng.choice(len(x), p=d / d.sum())] if d.sum() > 0 else x[rng.integers(len(x))])
    c = np.array(means)
    for _ in range(10):
        own = ((x[:, None] - c[None]) ** 2).sum(-1).argmin(1)
        c = np.array([x[own == j].mean(0) if (own == j).any() else c[j] for j in range(k)])
    return c


def start(x: np.ndarray, k: int, rng: np.random.Generator, uniform: float, reg: float, init: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Starting means, covariances, weights and uniform share from clusters ("kmeans") or from k of the points ("random").

    Every component takes the mean, covariance and share of its cluster; one point alone spreads by 10, and a cluster without
    points begins as the whole, with an equal share.  All shares together are 1.
    """
    if init not in ("kmeans", "random"):
        raise ValueError(f"unknown start {init!r}")
    mean = seeds(x, k, rng) if init == "kmeans" else x[rng.choice(len(x), k, replace=False)].copy()
    own = ((x[:, None] - mean[None]) ** 2).sum(-1).argmin(1)
    n = np.bincount(own, minlength=k)
    mean = np.where(n[:, None] > 0, mean, x.mean(0))
    whole = np.cov(x.T)
    cov = regularized(np.array([whole if not n[j] else np.cov(x[own == j].T) if n[j] > 1 else 10 * np.eye(2) for j in range(k)]), reg)
    weight = (1 - uniform) * np.where(n > 0, n / len(x), 1 / k)
    total = weight.sum() + uniform
    return mean, cov, weight / total, uniform / total


def fit(x: np.ndarray, k: int, rng: np.random.Generator, bbox: tuple[float, float, float, float] | None = None, uniform: float = 0.1, tol: float = 1e-4, max_iter: int = 100, reg: float = 1e-6, init: str = "kmeans", least_weight: float = 1e-3) -> Mixture:
    """Expectation-maximisation of k Gaussians and a uniform part over a box (the data's, one unit wider, if none is given).

    Stops when the log likelihood changes by less than ``tol`` after the first round.  Needs (n, 2) points, n > k.
    ``dead`` counts the components that end below ``least_weight``.
    """
    x = np.asarray(x, float)
    if x.ndim != 2 or x.shape[1] != 2 or len(x) < k + 1:
        raise ValueError("needs (n, 2) points and more points than components")
    x0, y0, x1, y1 = bbox or (*(x.min(0) - 1), *(x.max(0) + 1))
    mean, cov, weight, share = start(x, k, rng, uniform, reg, init)
    m = Mixture(mean, cov, weight, share, 1 / max((x1 - x0) * (y1 - y0), TINY))
    for i in range(max_iter):
        parts = np.column_stack((densities(x, m.mean, m.cov) * m.weight, np.full(len(x), m.uniform * m.density)))
        p = np.maximum(parts.sum(1), TINY)
        ll = np.log(p).sum()
        m.iterations = i + 1
        done = i > 0 and abs(ll - m.ll) < tol
        m.ll = ll
        if done:
            m.converged = True
            break
        r = parts / p[:, None]
        n_k = r.sum(0)
        for j in range(k):
            if n_k[j] < 1e-10:
                continue
            mu = r[:, j] @ x / n_k[j]
            d = x - mu
            m.mean[j] = mu
            m.cov[j] = (r[:, j, None] * d).T @ d / n_k[j]
        m.cov = regularized(m.cov, reg)
        w = n_k / n_k.sum()
        m.weight, m.uniform = w[:k], float(w[k])
    m.counts = np.round(m.weight * len(x)).astype(int)
    m.dead = int((m.weight < least_weight).sum())
    return m


def select(x: np.ndarray, rng: np.random.Generator, aic_weight: float = 0.0, bic_weight: float = 1.0, **how) -> tuple[str, Mixture]:
    """The better of two components and one by the weighted criteria; two among equals; an error if neither can be fitted."""
    best: tuple[float, str, Mixture] | None = None
    for k, name in ((2, "bimodal"), (1, "unimodal")):
        try:
            m = fit(x, k, rng, **how)
        except (ValueError, np.linalg.LinAlgError):
            continue
        score = aic_weight * m.aic() + bic_weight * m.bic(len(x))
        if best is None or score < best[0]:
            best = (score, name, m)
    if best is None:
        raise ValueError("no mixture could be fitted")
    return best[1], best[2]


def _row(name: str, m: Mixture, n: int) -> dict:
    parts = [{"mx": a[0], "my": a[1], "cxx": c[0, 0], "cxy": c[0, 1], "cyy": c[1, 1], "weight": w, "n": int(k)} for a, c, w, k in zip(m.mean, m.cov, m.weight, m.counts, strict=True)]
    return {"model_type": name, "uniform_weight": m.uniform, "log_likelihood": m.ll, "aic": m.aic(), "bic": m.bic(n), "n_iterations": m.iterations, "converged": m.converged, "n_dead": m.dead, "components": parts}


def fit_heatmaps(df: DataFrame, keys: list[str], n: int = 1000, method: str = "importance", temperature: float = 0.3, jitter: float = 0.5, seed: int = 0, repeats: int = 1, **how) -> DataFrame:
    """(keys..., repeat, mixture): samples each map and fits a mixture, all in one pass.

    A map that cannot be sampled or fitted has a row with null model_type and no components, so that no joint is lost and
    the rest of its image keeps its joint numbers.  ``repeats`` independent draws feed ``combine_repeats``.
    """
    empty = {"model_type": None, "uniform_weight": None, "log_likelihood": None, "aic": None, "bic": None, "n_iterations": 0, "converged": False, "n_dead": 0, "components": []}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.to_dict("records"):
                for t in range(repeats):
                    rng = generator(seed, t, *(r[k] for k in keys))
                    try:
                        h, w = r["hm_h"], r["hm_w"]
                        x = sample(np.asarray(r["hm"], float).reshape(h, w), n, method, rng, temperature, jitter)
                        got = _row(*select(x, rng, **how), n)
                    except (ValueError, TypeError, RuntimeError):
                        got = empty
                    out.append({k: r[k] for k in keys} | {"repeat": t} | got)
            if out:
                yield pd.DataFrame(out)

    kinds = dict(df.dtypes)
    return spread(df.select(*keys, "hm", "hm_h", "hm_w"), keys).mapInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + f", repeat int, {FIT}")


def grid_mode(df: DataFrame, keys: list[str], width: float, height: float, cells: int = 16) -> DataFrame:
    """(keys..., cell, density): the cell of a cells x cells grid over a width x height map where a mixture (``comps``) is densest.

    Cell i lies at (i % cells, i // cells) times the step; the lowest cell among equals; no components, no row.  Mixtures of
    a batch are laid out by their number of components and evaluated together.
    """
    i = np.arange(cells * cells)
    grid = np.column_stack((i % cells * (width / cells), i // cells * (height / cells)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = b["comps"].map(len).to_numpy()
            cell, best = np.zeros(len(b), "int32"), np.zeros(len(b))
            for k in np.unique(rows[rows > 0]):
                at = np.flatnonzero(rows == k)
                c = np.array([[(x["mx"], x["my"], x["cxx"], x["cxy"], x["cyy"], x["weight"]) for x in b["comps"].iloc[j]] for j in at])
                total = np.zeros((len(at), len(grid)))
                for j in range(k):
                    mx, my, cxx, cxy, cyy, w = (c[:, j, f, None] for f in range(6))
                    det = cxx * cyy - cxy * cxy
                    safe = np.where(det > 0, det, 1)
                    dx, dy = grid[:, 0] - mx, grid[:, 1] - my
                    m = (cyy * dx * dx - 2 * cxy * dx * dy + cxx * dy * dy) / safe
                    total += np.where(det > 0, w * np.exp(-0.5 * np.minimum(m, 700)) / (2 * np.pi * np.sqrt(safe)), 0)
                total = np.round(total, 12)
                cell[at] = total.argmax(1)
                best[at] = total.max(1)
            yield b[keys].assign(cell=cell, density=best)[rows > 0]

    kinds = dict(df.dtypes)
    return df.select(*keys, "comps").mapInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", cell int, density double")


def combine_repeats(fits: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., mx, my, cxx, cxy, cyy, model_type, n_iterations, converged, bic): bootstrap summary of repeated fits.

    Mean of the leading means; mean covariance plus the covariance of the means; the commonest model; iterations summed.
    """
    from pyspark.sql import functions as F

    lead = "get(components, cast(array_position(transform(components, c -> c.weight), array_max(transform(components, c -> c.weight))) - 1 as int))"
    d = fits.where("size(components) > 0").withColumn("lead", F.expr(lead))
    cov = lambda a, b: F.coalesce(F.covar_samp(f"lead.{a}", f"lead.{b}"), F.lit(0.0))
    return d.groupBy(*keys).agg(
        F.avg("lead.mx").alias("mx"), F.avg("lead.my").alias("my"),
        (F.avg("lead.cxx") + cov("mx", "mx")).alias("cxx"), (F.avg("lead.cxy") + cov("mx", "my")).alias("cxy"), (F.avg("lead.cyy") + cov("my", "my")).alias("cyy"),
        F.mode("model_type").alias("model_type"), F.sum("n_iterations").alias("n_iterations"), F.bool_and("converged").alias("converged"), F.min("bic").alias("bic"),
    )
