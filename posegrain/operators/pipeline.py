"""Evaluation of whole images: predictions of several decoders against the truth, with the mixtures behind them, and deep packets.

Everything is keyed by (image, joint) until the last aggregate by image, so that the stages share one partitioning and
an image is never larger than its joints.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from posegrain.functions import mixtures as G
from posegrain.functions import scalars as S
from posegrain.operators import poses
from posegrain.operators.prefix import same

MARGINS = (0.0, 0.7)


def usable(joints: DataFrame, smallest: float = 1.0) -> DataFrame:
    """Rows of images whose area is known and not degenerate."""
    return joints.where(F.col("area") >= smallest)


def fallback(decoded: DataFrame, joints: DataFrame, image: list[str], x: str = "bx", y: str = "by") -> DataFrame:
    """(joints' columns, ox, oy): the decoded position of each joint; joints that were not decoded keep the baseline's."""
    both = joints.alias("j").join(decoded.select(*image, "kp_idx", F.col("x").alias("_x"), F.col("y").alias("_y")).alias("d"), same([*image, "kp_idx"], "j", "d"), "left")
    return both.select("j.*", F.coalesce("_x", x).alias("ox"), F.coalesce("_y", y).alias("oy"))


def mixtures_of(candidates: DataFrame, image: list[str]) -> DataFrame:
    """(image..., kp_idx, comps): the candidates of each joint in order."""
    return candidates.groupBy(*image, "kp_idx").agg(F.array_sort(F.collect_list(F.struct("cand_idx", "mx", "my", "cxx", "cxy", "cyy", "weight"))).alias("comps"))  # candidates of one joint


def joint_measures(joints: DataFrame, mixtures: DataFrame, image: list[str], methods: dict[str, tuple[str, str]], uniform: float = 0.1, map_area: float = 3072.0) -> DataFrame:
    """Adds comps, oks_<method>, nll, entropy and volume to every joint.

    ``methods``: name -> columns of its x and y.  The negative log density is taken at (hx, hy), the truth in map
    coordinates, of visible joints only; joints without a mixture have none.
    """
    d = joints.alias("j").join(mixtures.alias("m"), same([*image, "kp_idx"], "j", "m"), "left").select("j.*", "m.comps")
    fit = [S.oks(F.pow(F.col(x) - F.col("gx"), 2) + F.pow(F.col(y) - F.col("gy"), 2), F.col("area"), F.col("kappa"), F.col("vis")).alias(f"oks_{m}") for m, (x, y) in methods.items()]
    nll = f"if(vis > 0 and size(comps) > 0, -{G.log_density('comps', f'{uniform}D', f'(1D / {map_area}D)', 'hx', 'hy')}, null)"
    return d.select("*", *fit, F.expr(nll).alias("nll"), F.expr(G.entropy_bound("comps")).alias("entropy"), F.expr(f"if(size(comps) > 0, {G.weighted_volume('comps')}, null)").alias("volume"))


def evaluate_images(measured: DataFrame, pair_dim: DataFrame, image: list[str], methods: dict[str, tuple[str, str]], base: str = "base", margins: tuple[float, ...] = MARGINS) -> DataFrame:
    """One row an image: n_joints, n_visible, oks_<method>, delta_<method> (against ``base``), nll, entropy, covariance_volume,
    n_components, and for every method and margin the swaps (swaps_<method>_<margin>) with those that were corrected and introduced
    against the base.

    Means over visible joints, 0 for images without one; the mixtures' measures are null where no joint has a mixture.
    """
    a = measured.groupBy(*image).agg(
        F.count(F.lit(1)).alias("n_joints"), F.count(F.when(F.col("vis") > 0, 1)).alias("n_visible"), *(F.coalesce(F.avg(f"oks_{m}"), F.lit(0.0)).alias(f"oks_{m}") for m in methods),
        F.avg("nll").alias("nll"), F.avg("entropy").alias("entropy"), F.avg("volume").alias("covariance_volume"), F.avg(F.when(F.size("comps") > 0, F.size("comps"))).alias("n_components"),
    )
    a = a.select("*", *((F.col(f"oks_{m}") - F.col(f"oks_{base}")).alias(f"delta_{m}") for m in methods if m != base))
    two = poses.limb_pairs(measured, pair_dim, image, list(dict.fromkeys(c for xy in methods.values() for c in xy)))
    swaps = two.select(*image, *(poses.swapped(x, y, g).alias(f"{m}_{str(g).replace('.', '')}") for m, (x, y) in methods.items() for g in margins))
    n = lambda cond, out: F.count(F.when(cond, 1)).alias(out)
    aggs = []
    for m in methods:
        for g in margins:
            t = str(g).replace(".", "")
            own, ref = F.col(f"{m}_{t}"), F.col(f"{base}_{t}")
            aggs += [n(own, f"swaps_{m}_{t}")] + ([n(ref & ~own, f"corrected_{m}_{t}"), n(~ref & own, f"introduced_{m}_{t}")] if m != base else [])
    counts = swaps.groupBy(*image).agg(*aggs)
    names = [c for c in counts.columns if c not in image]
    return a.alias("a").join(counts.alias("s"), same(image, "a", "s"), "left").select("a.*", *(F.coalesce(f"s.{c}", F.lit(0)).alias(c) for c in names))


def deep_packets(measured: DataFrame, evaluated: DataFrame, image: list[str], methods: dict[str, tuple[str, str]]) -> DataFrame:
    """(image..., ground_truth, predictions, unary, metrics): everything known of an image in one row.

    ground_truth: array of joints; predictions: map method -> array of joints with their similarity; unary: array of joints with
    their candidates; metrics: the image's row of ``evaluate_images``.  All arrays are in joint order; an image has few joints.
    """
    joint = lambda *f: F.array_sort(F.collect_list(F.struct("kp_idx", *f)))
    d = measured.groupBy(*image).agg(
        joint(F.col("gx").alias("x"), F.col("gy").alias("y"), "vis").alias("ground_truth"),
        F.create_map(*(e for m, (x, y) in methods.items() for e in (F.lit(m), joint(F.col(x).alias("x"), F.col(y).alias("y"), F.col(f"oks_{m}").alias("oks"))))).alias("predictions"),
        F.array_sort(F.collect_list(F.when(F.size("comps") > 0, F.struct("kp_idx", "comps")))).alias("unary"),
    )
    metrics = F.struct(*(F.col(f"e.{c}").alias(c) for c in evaluated.columns if c not in image))
    return d.alias("d").join(evaluated.alias("e"), same(image, "d", "e")).select("d.*", metrics.alias("metrics"))


def swap_totals(evaluated: DataFrame, keys: list[str], base: str, ours: str) -> DataFrame:
    """(keys..., swaps_base, swaps_ours, net_reduction_pct): totals, and what share of the base's swaps went (of one, if it has none)."""
    t = evaluated.groupBy(*keys).agg(F.sum(base).alias("swaps_base"), F.sum(ours).alias("swaps_ours"))
    return t.withColumn("net_reduction_pct", (F.col("swaps_base") - F.col("swaps_ours")) * 100.0 / F.greatest(F.lit(1), "swaps_base"))


def mixture_summary(fits: DataFrame, image: list[str]) -> DataFrame:
    """(image..., weights, covariances, entropy, covariance_volume, n_components, uniform_weight): the mixtures of an image in one row.

    ``fits`` has kp_idx, uniform_weight and components.  If all joints have the same number of components, weights and
    covariances are the means by place; else those of the first joint.  The count is cut to a whole number.
    """
    f = fits.where("size(components) > 0")
    first = F.min_by(F.col("components"), F.col("kp_idx"))
    a = f.groupBy(*image).agg(
        F.min(F.size("components")).alias("lo"), F.max(F.size("components")).alias("hi"), first.alias("first"), F.collect_list("components").alias("all"),  # one list a joint
        F.avg(F.expr(G.entropy_bound("components"))).alias("entropy"), F.avg(F.expr(G.weighted_volume("components"))).alias("covariance_volume"), F.floor(F.avg(F.size("components"))).cast("int").alias("n_components"), F.avg("uniform_weight").alias("uniform_weight"),
    )
    mean = lambda field: f"if(lo = hi, transform(first, (c, i) -> aggregate(all, 0D, (s, x) -> s + get(x, i).{field}) / size(all)), transform(first, c -> c.{field}))"
    a = a.select(*image, F.expr(mean("weight")).alias("weights"), *(F.expr(mean(c)).alias(c) for c in ("cxx", "cxy", "cyy")), "entropy", "covariance_volume", "n_components", "uniform_weight")
    return a.select(*image, "weights", F.expr("transform(cxx, (v, i) -> named_struct('xx', v, 'xy', get(cxy, i), 'yy', get(cyy, i)))").alias("covariances"), "entropy", "covariance_volume", "n_components", "uniform_weight")
