"""Per-image pose metrics over long joint tables: similarity, limb swaps, correct-keypoint share, ground-truth alignment, image summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from posegrain.functions import scalars as S
from posegrain.schema import KEYPOINTS


def align_to_joints(gt: DataFrame, image: list[str], joints: tuple[str, ...] = KEYPOINTS) -> DataFrame:
    """Ground truth of any layout brought to the joint dimension by name.

    Names the dimension does not know are dropped; joints without ground truth are at (0, 0) with vis 0.  Confidence
    0.9 or more is vis 2, above 0 it is 1, else 0.
    """
    vis = F.when(F.col("confidence") >= 0.9, 2).when(F.col("confidence") > 0, 1).otherwise(0)
    known = gt.select(*image, "name", "x", "y", vis.alias("vis"))
    frame = gt.select(*image).distinct().select(*image, F.inline(F.array(*(F.struct(F.lit(i).alias("kp_idx"), F.lit(n).alias("name")) for i, n in enumerate(joints)))))
    return frame.join(known, [*image, "name"], "left").select(*image, "kp_idx", F.coalesce("x", F.lit(0.0)).alias("x"), F.coalesce("y", F.lit(0.0)).alias("y"), F.coalesce("vis", F.lit(0)).alias("vis"))


def joint_oks(pairs: DataFrame) -> DataFrame:
    """Adds ``oks`` to rows with px, py, gx, gy, area, kappa, vis."""
    return pairs.withColumn("oks", S.oks(F.pow(F.col("px") - F.col("gx"), 2) + F.pow(F.col("py") - F.col("gy"), 2), F.col("area"), F.col("kappa"), F.col("vis")))


def image_oks(pairs: DataFrame, image: list[str]) -> DataFrame:
    """(image..., oks, n_visible): mean over visible joints; 0 if none is visible."""
    return joint_oks(pairs).groupBy(*image).agg(F.coalesce(F.avg("oks"), F.lit(0.0)).alias("oks"), F.count(F.when(F.col("vis") > 0, 1)).alias("n_visible"))


def limb_pairs(pairs: DataFrame, pair_dim: DataFrame, image: list[str], columns: list[str]) -> DataFrame:
    """(image..., pair, left_kappa, right_kappa, area, l<c>, r<c>): both joints of each limb pair in one row.

    Only pairs with both joints visible and a positive area; one aggregate over (image, pair), not a self-join.
    """
    d = F.broadcast(pair_dim)  # 8 rows
    sides = pairs.join(d, (F.col("kp_idx") == F.col("left_idx")) | (F.col("kp_idx") == F.col("right_idx")))
    left = F.col("kp_idx") == F.col("left_idx")
    get = lambda c, cond, out: F.max(F.when(cond, F.col(c))).alias(out)
    every = [*columns, "gx", "gy", "vis"]
    two = sides.groupBy(*image, "pair", "left_kappa", "right_kappa").agg(F.max("area").alias("area"), *(get(c, left, f"l{c}") for c in every), *(get(c, ~left, f"r{c}") for c in every))
    return two.where("lvis > 0 and rvis > 0 and area > 0")


def swapped(x: str, y: str, margin: float, least: float = 0.3) -> Column:
    """Whether a side of a limb pair, as (x, y) predict it, fits the other side's truth better than its own by more than ``margin``, and above ``least``."""
    fit = lambda p, g: S.oks(F.pow(F.col(f"{p}{x}") - F.col(f"{g}gx"), 2) + F.pow(F.col(f"{p}{y}") - F.col(f"{g}gy"), 2), F.col("area"), F.col("left_kappa" if g == "l" else "right_kappa"))
    cross = lambda p, g: (fit(p, g) > fit(p, p) + margin) & (fit(p, g) > least)
    return cross("l", "r") | cross("r", "l")


def limb_swaps(pairs: DataFrame, pair_dim: DataFrame, image: list[str], margin: float = 0.0, least: float = 0.3) -> DataFrame:
    """(image..., pair, swapped) of the prediction px, py: see ``limb_pairs`` and ``swapped``."""
    return limb_pairs(pairs, pair_dim, image, ["px", "py"]).select(*image, "pair", swapped("px", "py", margin, least).alias("swapped"))


def swap_deltas(base: DataFrame, ours: DataFrame, image: list[str]) -> DataFrame:
    """(image..., swaps_base, swaps_ours, corrected, introduced)."""
    b = base.withColumnRenamed("swapped", "b").join(ours.withColumnRenamed("swapped", "o"), [*image, "pair"], "full")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    n = lambda cond, out: F.count(F.when(cond, 1)).alias(out)
    return b.groupBy(*image).agg(n(flag("b"), "swaps_base"), n(flag("o"), "swaps_ours"), n(flag("b") & ~flag("o"), "corrected"), n(~flag("b") & flag("o"), "introduced"))


def correct_share(pairs: DataFrame, image: list[str], threshold: float = 0.2, normalize: str = "torso") -> DataFrame:
    """(image..., pck): share of visible joints within threshold x scale; 0 if none is visible.

    "torso": distance of shoulder and hip centres (joints 5, 6, 11, 12), or the extent if the pose has fewer than 13 joints;
    "bbox": the extent of the truth.  Anything else is an error.
    """
    if normalize not in ("torso", "bbox"):
        raise ValueError(f"unknown normalization {normalize!r}")
    at = lambda c, k: F.max(F.when(F.col("kp_idx") == k, F.col(c)))
    ext = lambda c: F.max(c) - F.min(c)
    s = pairs.groupBy(*image).agg(
        F.count(F.lit(1)).alias("n"), ext("gx").alias("ex"), ext("gy").alias("ey"), *(((at(c, 5) + at(c, 6)) / 2 - (at(c, 11) + at(c, 12)) / 2).alias(f"t{c[1]}") for c in ("gx", "gy"))
    )
    extent = S.l2(F.col("ex"), F.col("ey"))
    s = s.select(*image, (F.when(F.col("n") >= 13, S.l2(F.col("tx"), F.col("ty"))).otherwise(extent) if normalize == "torso" else extent).alias("scale"))
    d = pairs.join(s, image).withColumn("ok", S.l2(F.col("px") - F.col("gx"), F.col("py") - F.col("gy")) < threshold * F.col("scale"))
    return d.groupBy(*image).agg(F.coalesce(F.avg(F.when(F.col("vis") > 0, F.col("ok").cast("double"))), F.lit(0.0)).alias("pck"))


def image_mixture_summary(fits: DataFrame, image: list[str], compat: bool = False) -> DataFrame:
    """(image..., n_components, uniform_weight): means over joints; with ``compat`` the count is cut to a whole number as older tables have it."""
    n = F.avg(F.size("components"))
    return fits.groupBy(*image).agg((F.floor(n).cast("int") if compat else n).alias("n_components"), F.avg("uniform_weight").alias("uniform_weight"))
