"""Scalar expressions of poses and uncertainties.  All take and return Columns and stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def l2(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)


def oks(d2: Column, area: Column, kappa: Column, vis: Column | None = None) -> Column:
    """exp(-d2 / (2 area kappa^2)); null for joints that are not visible and for areas that are not positive."""
    value = F.when(area > 0, F.exp(-d2 / (2.0 * area * kappa * kappa)))
    return value if vis is None else F.when(vis > 0, value)


def u_gmm(det: Column, beta: float) -> Column:
    return 1.0 - F.exp(-F.lit(float(beta)) * det)


def fuse_max(base: Column, gmm: Column) -> Column:
    return F.when(base.isNotNull() & gmm.isNotNull(), F.greatest(base, gmm))


def fuse_gate(base: Column, gmm: Column, k: Column, tau: float | None = None) -> Column:
    gate = k == 2 if tau is None else (k == 2) | (gmm > float(tau))
    return F.when(gate, gmm).otherwise(base)


def fuse_softmax(base: Column, gmm: Column) -> Column:
    a, b = F.exp(base), F.exp(gmm)
    return (a * base + b * gmm) / (a + b)


def log_volume(det: Column) -> Column:
    return F.log1p(F.when(det > 0, det).otherwise(F.when(det.isNotNull(), F.lit(0.0))))


#: Default thresholds of the failure modes, in order of their rules.
MODES = {"denoised": 0.1, "failure": 0.3, "robust": 0.8, "robust_entropy": 2.0, "ambiguous_entropy": 3.0, "sure_entropy": 1.5, "poor": 0.5, "honest_entropy": 2.5, "good": 0.6}


def failure_mode(ours: Column, entropy: Column, n_active: Column, base: Column | None = None, t: dict[str, float] = MODES) -> Column:
    """First rule that fits: Denoised, Failure, Robust, Ambiguous, Overconfident, Honest_Uncertainty, else Robust; null without a score."""
    rules = F.when(ours.isNull(), F.lit(None).cast("string"))
    if base is not None:
        rules = rules.when(ours > base + t["denoised"], "Denoised")
    rules = rules.when(ours < t["failure"], "Failure").when((ours > t["robust"]) & (entropy < t["robust_entropy"]), "Robust").when((entropy > t["ambiguous_entropy"]) & (n_active > 1), "Ambiguous")
    return rules.when((entropy < t["sure_entropy"]) & (ours < t["poor"]), "Overconfident").when((entropy > t["honest_entropy"]) & (ours < t["good"]), "Honest_Uncertainty").otherwise("Robust")


def visibility_code(v: Column) -> Column:
    """0, 1 or 2; anything else is 2."""
    n = v.cast("string").try_cast("int") if hasattr(v, "try_cast") else v.cast("int")
    return F.when(n.isin(0, 1, 2), n).otherwise(2)


def visibility_tag(code: Column) -> Column:
    return F.element_at(F.array(F.lit("absent"), F.lit("occluded"), F.lit("visible")), code + 1)


def slug(text: Column) -> Column:
    """Runs of other characters become one underscore; none at the ends."""
    return F.regexp_replace(F.regexp_replace(text, "[^a-zA-Z0-9]+", "_"), "^_+|_+$", "")


def file_safe(name: Column) -> Column:
    """Characters that file names do not take."""
    return F.translate(name, " /\\:=,", "______")


def scale_label(i: Column, factor: Column, name: Column) -> Column:
    return F.format_string("Scale%d(x%.3f) %s", i, factor, name)


def run_name(*facets: Column) -> Column:
    """Facets that are there, joined; an automatic tag of a run."""
    return F.concat_ws("-", *facets)


def joint_label(keypoint: Column, idx: Column) -> Column:
    """`L_Elbow (kp=7)`."""
    side = F.regexp_replace(F.regexp_replace(keypoint, "^left_", "l_"), "^right_", "r_")
    return F.concat(F.replace(F.initcap(F.replace(side, F.lit("_"), F.lit(" "))), F.lit(" "), F.lit("_")), F.lit(" (kp="), idx.cast("string"), F.lit(")"))


def config_value(config: Column, path: str) -> Column:
    """A dotted key of a stored JSON configuration, with ``${...}`` references stripped."""
    return F.regexp_replace(F.get_json_object(config, "$." + path), r"\$\{[^}]*\}", "")


def config_with(config: str, path: str, value: str) -> Column:
    """The JSON configuration ``config`` (an SQL expression) with a dotted key set to ``value`` (JSON text).

    Sections that are missing or no objects are made; a configuration that is no object counts as empty; keys come in order.
    """
    text = value.replace("\\", "\\\\").replace("'", "\\'")

    def put(at: str, keys: list[str]) -> str:
        if not keys:
            return f"parse_json('{text}')"
        m = f"coalesce(try_variant_get({at}, '$', 'map<string,variant>'), map())"
        return f"to_variant_object(map_concat(map_filter({m}, (k, v) -> k <> '{keys[0]}'), map('{keys[0]}', {put(f"try_variant_get({at}, '$.{keys[0]}', 'variant')", keys[1:])})))"

    return F.to_json(F.expr(put(f"try_parse_json({config})", path.split("."))))


# ---- boxes and coordinates


def map_affine(bbox: str, hm_w: str, hm_h: str, img_w: str, img_h: str) -> dict[str, str]:
    """Scale and shift (sx, sy, x0, y0) from map cells to image pixels where no stored transform exists, as SQL.

    ``bbox`` is an array x, y, w, h in pixels or, if all four lie in the unit interval, in shares of the image; one that is null,
    too short, not finite or without size stands for the whole image.  Without a map size, coordinates are shares of the image.
    """
    b = [f"get({bbox}, {i})" for i in range(4)]
    finite = " and ".join(f"{x} is not null and not isnan({x}) and abs({x}) < double('Infinity')" for x in b)
    unit = f"{b[0]} between 0 and 1 and {b[1]} between 0 and 1 and {b[2]} <= 1 and {b[3]} <= 1"
    ok = f"({finite} and {b[2]} > 0 and {b[3]} > 0)"
    sized = f"coalesce({hm_w} > 0 and {hm_h} > 0, false)"
    pick = lambda i, size, whole: f"if({ok}, {b[i]} * if({unit}, cast({size} as double), 1D), {whole})"
    return {
        "sx": f"if({sized}, {pick(2, img_w, f'cast({img_w} as double)')} / {hm_w}, cast({img_w} as double))", "sy": f"if({sized}, {pick(3, img_h, f'cast({img_h} as double)')} / {hm_h}, cast({img_h} as double))",
        "x0": pick(0, img_w, "0D"), "y0": pick(1, img_h, "0D"),
    }



def resize(value: Column, scale: Column) -> Column:
    """Annotation coordinates under image scaling; scales that are not positive are an error, 1 changes nothing."""
    return F.when(scale <= 0, F.raise_error(F.lit("scale must be positive")).cast("double")).when(F.abs(scale - 1.0) < 1e-8, value).otherwise(value * scale)


def flip_box(x: Column, w: Column, width: Column) -> Column:
    return width - x - w


def scale_box(x: Column, y: Column, w: Column, h: Column, s: Column, width: Column, height: Column) -> Column:
    """A box scaled about its centre: left and top are clamped without shrinking it, then right and bottom are cut."""
    nw, nh = w * s, h * s
    nx, ny = F.greatest(F.lit(0.0), x + w / 2.0 - nw / 2.0), F.greatest(F.lit(0.0), y + h / 2.0 - nh / 2.0)
    return F.struct(nx.alias("x"), ny.alias("y"), F.when(nx + nw > width, width - nx).otherwise(nw).alias("w"), F.when(ny + nh > height, height - ny).otherwise(nh).alias("h"))


def same_box(a: list[Column], b: list[Column]) -> Column:
    """All sides within one pixel: no scaling took place."""
    out = F.lit(True)
    for x, y in zip(a, b, strict=True):
        out = out & (F.abs(x - y) < 1.0)
    return out


def exit_distance(kx: Column, ky: Column, x: Column, y: Column, w: Column, h: Column) -> Column:
    """How far a joint lies outside a box; 0 inside."""
    zero = F.lit(0.0)
    return l2(F.greatest(zero, x - kx, kx - (x + w)), F.greatest(zero, y - ky, ky - (y + h)))


def pixel_scale(scale: Column, in_size: Column, hm_size: Column, decoder: Column | None = None) -> Column:
    """Image units of one heatmap pixel; the decoder's own factor counts where it is known, else input over heatmap size."""
    factor = in_size / hm_size if decoder is None else F.coalesce(decoder, in_size / hm_size)
    return factor / in_size * scale


def to_image(c: Column, px: Column, center: Column, scale: Column) -> Column:
    return c * px + center - 0.5 * scale


def to_heatmap(c: Column, px: Column, center: Column, scale: Column) -> Column:
    return (c - center + 0.5 * scale) / px


def rounded(x: str, digits: int = 6) -> str:
    """round(x, digits) + 0.0 to the same bit; decimals, which are slow, only near a tie and beyond a million."""
    s = f"({x} * 1e{digits}D)"
    return f"(if(abs({x}) < 1e6D and abs({s} - rint({s})) < 0.499D, rint({s}) / 1e{digits}D, round({x}, {digits})) + 0D)"
