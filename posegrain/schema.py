"""Fixed dimensions and relations of the domain: joints, flip pairs, skeleton edges, tiers, and the tables built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from posegrain.session import table

# The 17 joints in index order.
KEYPOINTS = (
    "nose", "left_eye", "right_eye", "left_ear", "right_ear", "left_shoulder", "right_shoulder", "left_elbow", "right_elbow",
    "left_wrist", "right_wrist", "left_hip", "right_hip", "left_knee", "right_knee", "left_ankle", "right_ankle",
)
# Joints that change places in a mirrored image.
FLIP_PAIRS = ((1, 2), (3, 4), (5, 6), (7, 8), (9, 10), (11, 12), (13, 14), (15, 16))
# Tolerance of each joint, in index order.
KAPPA = (0.026, 0.025, 0.025, 0.035, 0.035, 0.079, 0.079, 0.072, 0.072, 0.062, 0.062, 0.107, 0.107, 0.087, 0.087, 0.089, 0.089)
# Parent, child, mean and standard deviation of the bone length over the root of the person's area.
SKELETON = (
    (0, 1, 0.086697, 0.041642),
    (0, 2, 0.086987, 0.040777),
    (1, 3, 0.142436, 0.070436),
    (2, 4, 0.142714, 0.070405),
    (0, 5, 0.375405, 0.154303),
    (0, 6, 0.379020, 0.153544),
    (5, 11, 0.693674, 0.156694),
    (6, 12, 0.690588, 0.157064),
    (5, 7, 0.402244, 0.135029),
    (7, 9, 0.311928, 0.125481),
    (6, 8, 0.401648, 0.136314),
    (8, 10, 0.315018, 0.128668),
    (11, 13, 0.499586, 0.139764),
    (13, 15, 0.514086, 0.133683),
    (12, 14, 0.498670, 0.140628),
    (14, 16, 0.513950, 0.134331),
)
DEFAULT_BONE = (0.3, 0.15)
# Resolution tiers in order of degradation, with their scale.
TIERS = (("clean", 1.0), ("resize_half", 0.5), ("resize_quarter", 0.25), ("resize_eighth", 0.125), ("resize_sixteenth", 0.0625))

MEASURES = ("oks_base", "oks_ours", "cov_det", "uniform_weight", "base_score", "heatmap_entropy", "wasserstein", "kl_div")


def joint_dim(spark: SparkSession) -> DataFrame:
    """(kp_idx, keypoint, kappa, flip_idx): 17 rows."""
    flip = {a: b for a, b in FLIP_PAIRS} | {b: a for a, b in FLIP_PAIRS}
    return spark.createDataFrame([(i, n, KAPPA[i], flip.get(i, i)) for i, n in enumerate(KEYPOINTS)], "kp_idx int, keypoint string, kappa double, flip_idx int")


def pair_dim(spark: SparkSession) -> DataFrame:
    """(pair, left_idx, right_idx, left_kappa, right_kappa): 8 rows."""
    return spark.createDataFrame([(i, a, b, KAPPA[a], KAPPA[b]) for i, (a, b) in enumerate(FLIP_PAIRS)], "pair int, left_idx int, right_idx int, left_kappa double, right_kappa double")


def edges(root: int = 0, bones: tuple = SKELETON, nodes: int = 17) -> list[tuple[int, int, float, float, int]]:
    """(parent, child, mean, std, depth) of a rooted tree, by breadth; nodes that cannot be reached are roots and have no row."""
    children: dict[int, list] = {}
    for p, c, m, s in bones:
        children.setdefault(p, []).append((c, m, s))
    out, level, depth, seen = [], [root], 0, {root}
    while level:
        depth += 1
        nxt = []
        for p in level:
            for c, m, s in children.get(p, []):
                if c not in seen and c < nodes:
                    seen.add(c)
                    out.append((p, c, m, s, depth))
                    nxt.append(c)
        level = nxt
    return out


def edge_dim(spark: SparkSession, **how) -> DataFrame:
    return spark.createDataFrame(edges(**how), "parent int, child int, mean_ratio double, std_ratio double, depth int")


def tier_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, n, s) for i, (n, s) in enumerate(TIERS)], "tier int, experiment_name string, scale double")


def label(c: str):
    """Labels compare without case and outer blanks."""
    return F.lower(F.btrim(F.col(c), F.lit(" \t\r\n")))


def keypoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keypoint table as it stands: of each (run_id, image_id, kp_idx) the row loaded last, NaN as null, dataset labels in one form."""
    k = table(spark, sf_dir, "keypoint")
    w = Window.partitionBy("run_id", "image_id", "kp_idx").orderBy(F.col("loaded_at").desc_nulls_last(), F.col("load_id").desc_nulls_last())
    k = k.withColumn("_rn", F.row_number().over(w)).where("_rn = 1")
    clean = [F.expr(f"nanvl({c}, null)").alias(c) if c in MEASURES else label(c).alias(c) if c == "dataset_name" else F.col(c) for c in k.columns if c not in ("_rn", "loaded_at", "load_id", "evaluated_at")]
    return k.select(*clean)


def unrolled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Joints that can be evaluated: visibility known, covariance known, finite and not a sentinel; component count known or inferred."""
    return keypoints(spark, sf_dir).where("vis >= 0 and cov_det >= 0 and cov_det < double('Infinity')").withColumn("n_components", F.expr(INFER_COMPONENTS))


#: Number of components, else from the distances between two of them.
INFER_COMPONENTS = "coalesce(n_components, if(wasserstein > 0, 2, if(wasserstein is null, null, 1)), if(kl_div > 0, 2, if(kl_div is null, null, 1)))"


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packet metrics as they stand: the delivery loaded last of each packet, NaN as null, labels in one form."""
    p = table(spark, sf_dir, "packet_metric")
    w = Window.partitionBy("packet_id").orderBy(F.col("loaded_at").desc_nulls_last())
    p = p.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "loaded_at", "load_id")
    numbers = ("oks_base", "oks_ours", "delta_oks", "nll", "entropy", "covariance_volume")
    return p.select(*(F.expr(f"nanvl({c}, null)").alias(c) if c in numbers else label(c).alias(c) if c in ("dataset", "model_name") else F.col(c) for c in p.columns))
