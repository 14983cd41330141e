"""Closed forms of two-dimensional Gaussian mixtures with a uniform part, as SQL text over scalar columns or component structs.

A component is a struct (mx, my, cxx, cxy, cyy, weight); a mixture is an array of components.
"""

from __future__ import annotations

LOG_2PI_E = 2.8378770664093453
TWO_PI = 6.283185307179586


def det(cxx: str = "cxx", cxy: str = "cxy", cyy: str = "cyy") -> str:
    return f"({cxx} * {cyy} - {cxy} * {cxy})"


def eigenvalue(sign: str, cxx: str = "cxx", cxy: str = "cxy", cyy: str = "cyy") -> str:
    """tr / 2 +- sqrt(tr^2 / 4 - det), with the root written so that rounding cannot make it imaginary."""
    return f"(({cxx} + {cyy}) / 2D {sign} sqrt(pow(({cxx} - {cyy}) / 2D, 2) + {cxy} * {cxy}))"


def regularizer(reg: float, cxx: str = "cxx", cxy: str = "cxy", cyy: str = "cyy") -> str:
    """What to add to the diagonal: reg - min(0, smallest eigenvalue) if that eigenvalue is below reg, else 0."""
    low = eigenvalue("-", cxx, cxy, cyy)
    return f"if({low} < {reg}D, {reg}D - least(0D, {low}), 0D)"


def pdf(x: str, y: str, mx: str = "mx", my: str = "my", cxx: str = "cxx", cxy: str = "cxy", cyy: str = "cyy") -> str:
    """Gaussian density; 0 for a covariance that is not positive; the exponent is cut at 700."""
    d = det(cxx, cxy, cyy)
    dx, dy = f"({x} - {mx})", f"({y} - {my})"
    m = f"(({cyy} * {dx} * {dx} - 2D * {cxy} * {dx} * {dy} + {cxx} * {dy} * {dy}) / {d})"
    return f"if({d} > 0, exp(-0.5D * least({m}, 700D)) / ({TWO_PI}D * sqrt({d})), 0D)"


def criterion(log_likelihood: str, k: str, n: str) -> tuple[str, str]:
    """AIC and BIC with 6 parameters a component."""
    return f"(12D * {k} - 2D * {log_likelihood})", f"(6D * {k} * ln({n}) - 2D * {log_likelihood})"


def entropy_bound(comps: str) -> str:
    """Upper bound of a mixture's entropy: entropy of the weights plus weighted entropies of the parts.

    Weights are scaled to sum 1; nearly singular parts get 1e-3 on the diagonal and log det at least -20; the bound is at
    least 1e-6; null without components.
    """
    w = f"aggregate({comps}, 0D, (a, c) -> a + c.weight)"
    d = det("c.cxx", "c.cxy", "c.cyy")
    fixed = "((c.cxx + 1e-3D) * (c.cyy + 1e-3D) - c.cxy * c.cxy)"
    logdet = f"greatest(if({d} <= 0 or ln(if({d} > 0, {d}, 1D)) < -20D, ln(greatest({fixed}, 1e-300D)), ln(if({d} > 0, {d}, 1D))), -20D)"
    part = f"(c.weight / {w}) * ({LOG_2PI_E}D + 0.5D * {logdet}) - (c.weight / {w}) * ln(c.weight / {w} + 1e-10D)"
    return f"if(size({comps}) > 0, greatest(aggregate({comps}, 0D, (a, c) -> a + {part}), 1e-6D), null)"


def volumes(comps: str) -> str:
    return f"transform({comps}, c -> sqrt(greatest({det('c.cxx', 'c.cxy', 'c.cyy')}, 1e-10D)))"


def dominant_volume(comps: str) -> str:
    """Volume of the first component with the largest weight."""
    return f"get({volumes(comps)}, cast(array_position(transform({comps}, c -> c.weight), array_max(transform({comps}, c -> c.weight))) - 1 as int))"


def weighted_volume(comps: str) -> str:
    w = f"aggregate({comps}, 0D, (a, c) -> a + c.weight)"
    return f"aggregate(zip_with({comps}, {volumes(comps)}, (c, v) -> c.weight * v), 0D, (a, x) -> a + x) / {w}"


def active(comps: str, tau: float = 1e-3) -> str:
    return f"size(filter({comps}, c -> c.weight > {tau}D))"


def log_density(comps: str, uniform: str, uniform_density: str, x: str, y: str) -> str:
    """ln of the mixture's density at a point, at least ln 1e-300."""
    return f"ln(greatest(aggregate({comps}, {uniform} * {uniform_density}, (a, c) -> a + c.weight * {pdf(x, y, 'c.mx', 'c.my', 'c.cxx', 'c.cxy', 'c.cyy')}), 1e-300D))"


def calibrated(comps: str, area: str, kappa: str) -> dict[str, str]:
    """Total covariance of the Gaussian parts over area kappa^2, plus 1e-6 on the diagonal.

    Weights are scaled to sum 1 (equal if they sum to 1e-6 or less); a scale that is not positive counts as 1e-6.
    """
    w = f"aggregate({comps}, 0D, (a, c) -> a + c.weight)"
    weight = f"if({w} > 1e-6D, c.weight / {w}, 1D / size({comps}))"
    mx, my = (f"aggregate({comps}, 0D, (a, c) -> a + {weight} * c.{m})" for m in ("mx", "my"))
    scale = f"if({area} * {kappa} * {kappa} > 0, {area} * {kappa} * {kappa}, 1e-6D)"
    part = lambda c, a, b: f"aggregate({comps}, 0D, (a, c) -> a + {weight} * (c.{c} + {a} * {b})) / {scale}"
    dx, dy = f"(c.mx - {mx})", f"(c.my - {my})"
    return {"xx": f"({part('cxx', dx, dx)} + 1e-6D)", "xy": part("cxy", dx, dy), "yy": f"({part('cyy', dy, dy)} + 1e-6D)"}


def divergences(a: str = "a", b: str = "b") -> dict[str, str]:
    """Kullback-Leibler divergence and squared Wasserstein distance of two components, 1e-6 on each diagonal.

    The trace of the root of a 2 x 2 product M is sqrt(tr M + 2 sqrt(det M)), so no matrix root is needed.
    """
    cov = lambda c: (f"({c}.cxx + 1e-6D)", f"{c}.cxy", f"({c}.cyy + 1e-6D)")
    (axx, axy, ayy), (bxx, bxy, byy) = cov(a), cov(b)
    da, db = f"greatest({det(axx, axy, ayy)}, 1e-6D)", f"greatest({det(bxx, bxy, byy)}, 1e-6D)"
    raw = det(bxx, bxy, byy)
    dx, dy = f"({b}.mx - {a}.mx)", f"({b}.my - {a}.my)"
    trace = f"(({byy} * {axx} - 2D * {bxy} * {axy} + {bxx} * {ayy}) / {raw})"
    maha = f"(({byy} * {dx} * {dx} - 2D * {bxy} * {dx} * {dy} + {bxx} * {dy} * {dy}) / {raw})"
    kl = f"0.5D * (ln({db} / {da}) - 2D + {trace} + {maha})"
    tr = f"({axx} * {bxx} + 2D * {axy} * {bxy} + {ayy} * {byy})"
    root = f"sqrt(greatest({tr} + 2D * sqrt(greatest({det(axx, axy, ayy)} * {raw}, 0D)), 0D))"
    return {"kl_divergence": kl, "wasserstein_sq": f"{dx} * {dx} + {dy} * {dy} + {axx} + {ayy} + {bxx} + {byy} - 2D * {root}"}


def unary_score(weight: str = "weight", cxx: str = "cxx", cxy: str = "cxy", cyy: str = "cyy") -> str:
    return f"(ln(greatest({weight}, 1e-30D)) - 0.5D * ln(greatest({det(cxx, cxy, cyy)}, 1e-30D)))"


def pairwise_score(distance: str, mean: str, std: str, root_area: str, multiplier: float = 1.0) -> str:
    """Spring score of a bone; 0 for a spring without stiffness."""
    s = f"({std} * {multiplier}D * {root_area})"
    return f"if({s} < 1e-6D, 0D, -0.5D * pow(({distance} - {mean} * {root_area}) / {s}, 2))"


def affine(ax: str, ay: str, bx: str, by: str) -> dict[str, str]:
    """A component under x -> ax x + bx, y -> ay y + by."""
    return {"mx": f"{ax} * mx + {bx}", "my": f"{ay} * my + {by}", "cxx": f"cxx * {ax} * {ax}", "cxy": f"cxy * {ax} * {ay}", "cyy": f"cyy * {ay} * {ay}"}


def ellipse(points: int = 64, k: float = 2.0) -> str:
    """Vertices (x, y) of the k-sigma ellipse of (mx, my, cxx, cxy, cyy)."""
    hi, lo = eigenvalue("+"), eigenvalue("-")
    angle = "atan2(2D * cxy, cxx - cyy) / 2D"
    t = f"(i * {TWO_PI}D / {points})"
    a, b = f"{k}D * sqrt(greatest({hi}, 0D)) * cos{t}", f"{k}D * sqrt(greatest({lo}, 0D)) * sin{t}"
    return f"transform(sequence(0, {points - 1}), i -> named_struct('x', mx + {a} * cos({angle}) - {b} * sin({angle}), 'y', my + {a} * sin({angle}) + {b} * cos({angle})))"


def ellipse_axes(k: float = 2.0) -> dict[str, str]:
    """Half axes of the k-sigma ellipse, cosine and sine of its angle: what all vertices of a component share."""
    angle = "atan2(2D * cxy, cxx - cyy) / 2D"
    return {"a": f"{k}D * sqrt(greatest({eigenvalue('+')}, 0D))", "b": f"{k}D * sqrt(greatest({eigenvalue('-')}, 0D))", "turn_cos": f"cos({angle})", "turn_sin": f"sin({angle})"}


def unit_circle(points: int = 64) -> str:
    """Structs (vertex, c, s); without a lambda, so that the optimizer folds the array."""
    return "array(" + ", ".join(f"named_struct('vertex', {i}, 'c', cos({i} * {TWO_PI}D / {points}), 's', sin({i} * {TWO_PI}D / {points}))" for i in range(points)) + ")"


def on_ellipse() -> dict[str, str]:
    """A vertex of ``unit_circle`` on the ellipse of ``ellipse_axes``; operations in the order of ``ellipse``, so to the same bit."""
    return {"x": "mx + a * c * turn_cos - b * s * turn_sin", "y": "my + a * c * turn_sin + b * s * turn_cos"}
