"""Operators over heatmap rows (``hm`` array<double>, ``hm_w``, ``hm_h``): normalisation, decoding, flips, warps, aggregation over augmentations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from posegrain.functions import heatmaps as H


def _with(df: DataFrame, **exprs: str) -> DataFrame:
    return df.select("*", *(F.expr(e).alias(n) for n, e in exprs.items()))


def pixels(df: DataFrame, keys: list, col: str = "hm") -> DataFrame:
    """(keys..., pos, v): one row a pixel.

    The outer form is meant: for the inner one the optimizer infers a filter on the array's size and pushes it down through
    the projections that build the array, where it evaluates nested lambdas once an element.
    """
    return df.select(*keys, F.posexplode_outer(col).alias("pos", "v")).where("pos is not null")


def normalize(df: DataFrame, out: str = "norm") -> DataFrame:
    """Per-map min-max scaling; a constant map is unchanged, an empty or null map gives null."""
    return _with(_with(df, _lo="array_min(hm)", _hi="array_max(hm)"), **{out: H.minmax("hm", "_lo", "_hi")}).drop("_lo", "_hi")


def normalize_tensor(df: DataFrame, keys: list[str], out: str = "norm") -> DataFrame:
    """Min-max scaling with the extremes of all maps of ``keys`` together."""
    ends = df.groupBy(*keys).agg(F.min(F.array_min("hm")).alias("_lo"), F.max(F.array_max("hm")).alias("_hi"))
    return _with(df.join(ends, keys), **{out: H.minmax("hm", "_lo", "_hi")}).drop("_lo", "_hi")


def sharpen(df: DataFrame, t: float, out: str = "sharp") -> DataFrame:
    """Temperature scaling of a map taken as a distribution."""
    d = _with(df, _raised=H.raised("hm", t))
    d = _with(d, _sum=H.total("_raised"))
    return _with(d, **{out: H.scaled("_raised", "_sum")}).drop("_raised", "_sum")


def inverse_flip(df: DataFrame, flip_dim: DataFrame, shift: bool = False, out: str = "hm") -> DataFrame:
    """Undo a mirrored image: columns reversed, left and right joints changed, optionally one pixel to the right."""
    body = H.mirrored("hm", "hm_w")
    d = df.join(F.broadcast(flip_dim.select("kp_idx", "flip_idx")), "kp_idx")  # 17 rows
    d = _with(d, _m=body)
    d = _with(d, _o=H.shifted_right("_m", "hm_w") if shift else "_m")
    keep = [c for c in df.columns if c not in ("hm", "kp_idx")]
    return d.select(*keep, F.col("flip_idx").alias("kp_idx"), F.col("_o").alias(out))


def elementwise_mean(df: DataFrame, keys: list[str], weight: str | None = None) -> DataFrame:
    """(keys..., hm): mean of the maps of each key, pixel by pixel, weighted if asked.

    Weights are scaled to sum 1 a key; equal weights if they sum to 1e-10 or less.  Pixels are averaged by Spark's own
    partial aggregation, so the number of maps a key does not matter.
    """
    w = F.lit(1.0) if weight is None else F.col(weight)
    d = pixels(df, [*keys, w.alias("w")])
    a = d.groupBy(*keys, "pos").agg(F.sum(F.col("w") * F.col("v")).alias("wv"), F.sum("w").alias("w"), F.avg("v").alias("m"))
    a = a.select(*keys, F.struct("pos", F.when(F.col("w") > 1e-10, F.col("wv") / F.col("w")).otherwise(F.col("m")).alias("v")).alias("p"))
    return a.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["v"]).alias("hm"))  # one map a key


def best_scale(df: DataFrame, keys: list[str], confidence: str, order: str) -> DataFrame:
    """(keys..., hm): the map with the highest confidence; the smaller ``order`` among equals."""
    return df.groupBy(*keys).agg(F.max_by("hm", F.struct(F.col(confidence), -F.col(order))).alias("hm"))


def aggregate_scales(df: DataFrame, keys: list[str], method: str = "weighted_mean", sharpness: float = 5.0, alpha: float = 1.0, beta: float = 1.0, order: str = "scale_idx") -> DataFrame:
    """Combine the maps of several scales; any other method is an error."""
    if method not in ("weighted_mean", "max_confidence"):
        raise ValueError(f"unknown method {method!r}")
    d = _with(df, confidence=H.confidence("hm", sharpness, alpha, beta))
    return elementwise_mean(d, keys, "confidence") if method == "weighted_mean" else best_scale(d, keys, "confidence", order)


def decode_argmax(df: DataFrame) -> DataFrame:
    """Adds px, py (first maximum in row-major order) and score."""
    return _with(df, px=H.argmax_x("hm", "hm_w"), py=H.argmax_y("hm", "hm_w"), score="array_max(hm)")


def decode_subpixel(df: DataFrame) -> DataFrame:
    """Adds x, y: the maximum moved by a second-order step of the log map.  The map must be smooth (see ``blur``)."""
    d = decode_argmax(df)
    d = _with(d, **H.taylor_step("hm", "hm_w", "hm_h"))
    d = _with(d, _det="gxx * gyy - gxy * gxy")
    ok = "inner and abs(_det) > 1e-6"
    step = lambda e: f"if({ok}, greatest(-0.5D, least(0.5D, {e})), 0D)"
    d = _with(d, x=f"px + {step('-(gyy * gx - gxy * gy) / _det')}", y=f"py + {step('-(gxx * gy - gxy * gx) / _det')}")
    return d.drop("gx", "gy", "gxx", "gyy", "gxy", "inner", "_det")


def gaussian_kernel(size: int) -> np.ndarray:
    """Kernel of odd ``size`` with the width that goes with it: sigma = 0.3 ((size - 1) / 2 - 1) + 0.8."""
    sigma = 0.3 * ((size - 1) / 2 - 1) + 0.8
    x = np.arange(size) - size // 2
    k = np.exp(-(x**2) / (2 * sigma**2))
    return k / k.sum()


def _blurred(maps: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Separable filter over (n, h, w) with mirrored borders (the edge pixel is not repeated)."""
    r = len(kernel) // 2
    for axis in (1, 2):
        n = maps.shape[axis]
        at = np.abs(np.arange(-r, n + r))
        at = np.where(at >= n, 2 * (n - 1) - at, at) if n > 1 else np.zeros_like(at)
        at = np.clip(at, 0, n - 1)
        padded = maps.take(at, axis=axis)
        maps = sum(kernel[i] * padded.take(range(i, i + n), axis=axis) for i in range(len(kernel)))
    return maps


def blur(df: DataFrame, size: int = 11, out: str = "hm") -> DataFrame:
    """Gaussian smoothing of each map, in Arrow batches grouped by map size; an even size becomes the next odd one, 1 changes nothing."""
    kernel = gaussian_kernel(size + 1 - size % 2)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            maps = [None] * len(b)
            for (h, w), rows in b.reset_index(drop=True).groupby(["hm_h", "hm_w"]).indices.items():
                stack = np.stack([np.asarray(b["hm"].iloc[i], float) for i in rows]).reshape(-1, h, w)
                for i, m in zip(rows, _blurred(stack, kernel) if size > 1 else stack, strict=True):
                    maps[i] = m.ravel()
            b[out] = maps
            yield b

    schema = df.schema if out in df.columns else df.schema.add(out, "array<double>")
    return df.mapInPandas(run, schema)


def warp(df: DataFrame, out: str = "hm") -> DataFrame:
    """Bring each map from its scaled crop back to the original one: bilinear, zero outside.

    Columns hm, hm_h, hm_w and for either crop (o, s) the centre, pixel scale and size: ocx, ocy, osx, osy, opx, opy, and the
    same with s.  Both crops are axis-aligned, so the sampling is separable: two small matrices a map.
    """

    def weights(n: int, at: np.ndarray) -> np.ndarray:
        lo = np.floor(at)
        m = np.zeros((len(at), n))
        for k, share in ((lo, 1 - (at - lo)), (lo + 1, at - lo)):
            ok = (k >= 0) & (k < n)
            m[np.flatnonzero(ok), k[ok].astype(int)] += share[ok]
        return m

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            res = []
            for r in b.itertuples(index=False):
                m = np.asarray(r.hm, float).reshape(r.hm_h, r.hm_w)
                x = (np.arange(r.hm_w) * r.opx + r.ocx - 0.5 * r.osx - r.scx + 0.5 * r.ssx) / r.spx
                y = (np.arange(r.hm_h) * r.opy + r.ocy - 0.5 * r.osy - r.scy + 0.5 * r.ssy) / r.spy
                res.append((weights(r.hm_h, y) @ m @ weights(r.hm_w, x).T).ravel())
            b[out] = res
            yield b

    return df.mapInPandas(run, df.schema)


def flip_agreement(df: DataFrame, keys: list[str], a: str = "hm_a", b: str = "hm_b") -> DataFrame:
    """(keys..., corr, mse, peak_distance, peak_ratio): how well a map and its unflipped twin agree."""
    d = _with(df, corr=H.correlation(a, b), mse=H.squared_error(a, b), _ax=H.argmax_x(a, "hm_w"), _ay=H.argmax_y(a, "hm_w"), _bx=H.argmax_x(b, "hm_w"), _by=H.argmax_y(b, "hm_w"))
    d = _with(d, peak_distance="sqrt(cast(pow(_ax - _bx, 2) + pow(_ay - _by, 2) as double))", peak_ratio=f"if(array_max({a}) > 0, array_max({b}) / array_max({a}), null)")
    return d.select(*keys, "corr", "mse", "peak_distance", "peak_ratio")


def component_joint(components: DataFrame, maps: DataFrame, image: list[str]) -> DataFrame:
    """Adds ``at_kp`` to components (mx, my): the joint whose map is highest at the component's rounded place, cut to the map; the lowest joint among equals.

    ``maps`` has the image's joints (kp_idx, hm, hm_w, hm_h).  An image's maps are gathered once (17 at most); components of
    images without maps have null.
    """
    m = maps.groupBy(*image).agg(F.array_sort(F.collect_list(F.struct("kp_idx", "hm", "hm_w", "hm_h"))).alias("_maps"))  # 17 maps an image
    on = F.lit(True)
    for c in image:
        on = on & F.col(f"c.{c}").eqNullSafe(F.col(f"m.{c}"))
    d = components.alias("c").join(m.alias("m"), on, "left").select("c.*", "_maps")
    cell = lambda v, size: f"greatest(0, least({size} - 1, cast(bround({v}) as int)))"
    best = f"array_max(transform(_maps, m -> named_struct('v', get(m.hm, {cell('my', 'm.hm_h')} * m.hm_w + {cell('mx', 'm.hm_w')}), 'k', -m.kp_idx)))"
    return d.select(*components.columns, (-F.expr(f"{best}.k")).alias("at_kp"))
