"""Heatmaps as row-major arrays of doubles (``hm``) with height and width.  Higher-order functions only, no Python rows.

Expressions are SQL text over a column name, so that they also serve ``selectExpr`` and ``spark.sql``.
"""

from __future__ import annotations


def total(hm: str) -> str:
    return f"aggregate({hm}, 0D, (a, x) -> a + x)"


def minmax(hm: str, lo: str, hi: str) -> str:
    """Scaled to [0, 1] with known extremes; a constant map stays as it is.

    Extremes and sums used inside a lambda must be columns of an earlier projection: Spark evaluates a lambda's body
    anew for every element.
    """
    return f"if({hi} > {lo}, transform({hm}, x -> (x - {lo}) / ({hi} - {lo})), {hm})"


def scaled(hm: str, s: str) -> str:
    """Divided by a known sum; all zero if that is not positive."""
    return f"transform({hm}, x -> if({s} > 0, x / {s}, 0D))"


def entropy(hm: str) -> str:
    """In nats; 0 for a map without mass.  ln S - sum(h ln h) / S, so the map is walked once a sum."""
    s = f"aggregate({hm}, 0D, (a, x) -> a + greatest(x, 0D))"
    return f"if({s} > 0, ln({s}) - aggregate({hm}, 0D, (a, x) -> a + if(x > 0, x * ln(x), 0D)) / {s}, 0D)"


def argmax_x(hm: str, width: str) -> str:
    return f"cast((array_position({hm}, array_max({hm})) - 1) % {width} as int)"


def argmax_y(hm: str, width: str) -> str:
    return f"cast((array_position({hm}, array_max({hm})) - 1) div {width} as int)"


def confidence(hm: str, sharpness: float = 5.0, alpha: float = 1.0, beta: float = 1.0, eps: float = 1e-6) -> str:
    """peak^alpha (1 - 1 / (1 + sharpness of the peak / S))^beta."""
    peak, mean = f"array_max({hm})", f"({total(hm)} / size({hm}))"
    return f"pow({peak}, {alpha}D) * pow(1D - 1D / (1D + {peak} / ({mean} + {eps}D) / {sharpness}D), {beta}D)"


def raised(hm: str, t: float, floor: float = 1e-10) -> str:
    """max(p, floor)^(1 / t); t = 1 changes nothing.  ``scaled`` brings the sum back to 1."""
    return hm if t == 1 else f"transform({hm}, x -> pow(greatest(x, {floor}D), {1 / t!r}D))"


def mirrored(hm: str, width: str) -> str:
    """Columns in reverse order."""
    return f"transform({hm}, (x, i) -> get({hm}, cast(i - i % {width} + {width} - 1 - i % {width} as int)))"


def shifted_right(hm: str, width: str) -> str:
    """One pixel to the right; the left column becomes 0."""
    return f"transform({hm}, (x, i) -> if(i % {width} = 0, 0D, get({hm}, i - 1)))"


def cell(hm: str, x: str, y: str, width: str) -> str:
    return f"get({hm}, cast(({y}) * {width} + ({x}) as int))"


def taylor_step(hm: str, width: str, height: str) -> dict[str, str]:
    """Sub-pixel steps dx, dy of a second-order expansion of the log map about its first maximum.

    ``hm`` must already be smoothed; borders and flat peaks give no step, steps are cut at half a pixel.
    """
    log = lambda dx, dy: f"ln(greatest({cell(hm, f'px + ({dx})', f'py + ({dy})', width)}, 1e-4D))"
    return {
        "gx": f"0.5D * ({log(1, 0)} - {log(-1, 0)})",
        "gy": f"0.5D * ({log(0, 1)} - {log(0, -1)})",
        "gxx": f"{log(1, 0)} - 2D * {log(0, 0)} + {log(-1, 0)}",
        "gyy": f"{log(0, 1)} - 2D * {log(0, 0)} + {log(0, -1)}",
        "gxy": f"0.25D * ({log(1, 1)} - {log(1, -1)} - {log(-1, 1)} + {log(-1, -1)})",
        "inner": f"px >= 1 and px < {width} - 1 and py >= 1 and py < {height} - 1",
    }


def gaussian_map(cx: str, cy: str, sigma: str, width: str, height: str, peak: str = "1D") -> str:
    """s exp(-d^2 / (2 sigma^2)) on a grid."""
    return f"transform(sequence(0, {width} * {height} - 1), i -> {peak} * exp(-(pow(i % {width} - {cx}, 2) + pow(i div {width} - {cy}, 2)) / (2D * {sigma} * {sigma})))"


def _bimodal_peak(width: int, height: int, small: int) -> float:
    """Largest value of the sum of the two bumps on the grid."""
    import math

    bump = lambda x, c: math.exp(-((x - c) ** 2) / (2 * (small / 10) ** 2))
    return max(bump(x, width // 3) + bump(x, 2 * width // 3) for x in range(width))


def mock(mode: str, width: int, height: int) -> str:
    """Deterministic heatmaps of a stand-in model: unimodal, bimodal, uniform; largest value 1."""
    small = min(width, height)
    if mode == "unimodal":
        return gaussian_map(f"{width // 2}D", f"{height // 2}D", f"{small / 8}D", str(width), str(height))
    if mode == "bimodal":
        a = gaussian_map(f"{width // 3}D", f"{height // 2}D", f"{small / 10}D", str(width), str(height))
        b = gaussian_map(f"{2 * width // 3}D", f"{height // 2}D", f"{small / 10}D", str(width), str(height))
        return f"zip_with({a}, {b}, (p, q) -> (p + q) / {_bimodal_peak(width, height, small)}D)"
    if mode == "uniform":
        return f"array_repeat(1D, {width * height})"
    raise ValueError(f"unknown mode {mode!r}")


def moments(hm: str, width: str) -> dict[str, str]:
    """Weighted mean and covariance of the pixels, the map being the weights; null without mass."""
    w = total(hm)
    sx = f"aggregate(transform({hm}, (x, i) -> x * (i % {width})), 0D, (a, x) -> a + x)"
    sy = f"aggregate(transform({hm}, (x, i) -> x * (i div {width})), 0D, (a, x) -> a + x)"
    sxx = f"aggregate(transform({hm}, (x, i) -> x * (i % {width}) * (i % {width})), 0D, (a, x) -> a + x)"
    syy = f"aggregate(transform({hm}, (x, i) -> x * (i div {width}) * (i div {width})), 0D, (a, x) -> a + x)"
    sxy = f"aggregate(transform({hm}, (x, i) -> x * (i % {width}) * (i div {width})), 0D, (a, x) -> a + x)"
    return {"w": w, "sx": sx, "sy": sy, "sxx": sxx, "syy": syy, "sxy": sxy}


def effective_size(hm: str) -> str:
    """(sum w)^2 / sum w^2; 0 if there is no mass."""
    sq = f"aggregate({hm}, 0D, (a, x) -> a + x * x)"
    return f"if({sq} > 0, {total(hm)} * {total(hm)} / {sq}, 0D)"


def correlation(a: str, b: str) -> str:
    """Pearson correlation of two maps of one size."""
    n = f"size({a})"
    ma, mb = f"({total(a)} / {n})", f"({total(b)} / {n})"
    cov = f"aggregate(zip_with({a}, {b}, (p, q) -> p * q), 0D, (s, x) -> s + x) / {n} - {ma} * {mb}"
    va, vb = f"aggregate({a}, 0D, (s, x) -> s + x * x) / {n} - {ma} * {ma}", f"aggregate({b}, 0D, (s, x) -> s + x * x) / {n} - {mb} * {mb}"
    return f"if(({va}) > 0 and ({vb}) > 0, ({cov}) / sqrt(({va}) * ({vb})), null)"


def squared_error(a: str, b: str) -> str:
    return f"aggregate(zip_with({a}, {b}, (p, q) -> (p - q) * (p - q)), 0D, (s, x) -> s + x) / size({a})"
