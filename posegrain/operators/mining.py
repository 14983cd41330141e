"""Candidate mining: queries over joints, stages, tiers and models that find noteworthy images.  Thresholds are arguments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from posegrain.functions import scalars as S

# Bones whose child joint the stage comparison looks at.
LIMB_BONES = ((5, 7), (6, 8), (7, 9), (8, 10), (11, 13), (12, 14), (13, 15), (14, 16))


def best_swapped_joint(joints: DataFrame, image: list[str]) -> DataFrame:
    """(image..., focus_kp, kp_delta, kp_oks_base, kp_oks_ours, swapped_joint): the limb joint (5 to 16) that gained most; the lower index among equals."""
    d = joints.where("kp_idx between 5 and 16 and oks_ours is not null and oks_base is not null").withColumn("delta", F.expr("oks_ours - oks_base"))
    b = d.groupBy(*image).agg(F.max_by(F.struct("kp_idx", "keypoint", "delta", "oks_base", "oks_ours"), F.struct("delta", -F.col("kp_idx"))).alias("b"))
    return b.select(*image, F.col("b.kp_idx").alias("focus_kp"), F.col("b.delta").alias("kp_delta"), F.col("b.oks_base").alias("kp_oks_base"), F.col("b.oks_ours").alias("kp_oks_ours"), S.joint_label(F.col("b.keypoint"), F.col("b.kp_idx")).alias("swapped_joint"))


def merge_stages(joints: DataFrame, on: list[str], first: str, second: str) -> DataFrame:
    """Joints that two pipeline stages share (an image counts once a stage: its highest run), with both scores."""
    def side(stage: str, tag: str) -> DataFrame:
        w = Window.partitionBy(*on, "kp_idx").orderBy(F.col("run_id").desc())
        s = joints.where(F.col("pipeline_stage") == stage).withColumn("_rn", F.row_number().over(w)).where("_rn = 1")
        return s.select(*on, "kp_idx", F.col("oks_ours").alias(f"oks_{tag}"))

    return side(first, "first").join(side(second, "second"), [*on, "kp_idx"])


def bone_changes(merged: DataFrame, on: list[str], gain: bool = True, parent: float = 0.8, before: float = 0.6, after: float = 0.88, step: float = 0.4) -> DataFrame:
    """Bones whose child joint the second stage rescued (``gain``) or ruined, with a good parent joint."""
    dim = F.array(*(F.struct(F.lit(p).alias("p"), F.lit(c).alias("c")) for p, c in LIMB_BONES))
    kids = merged.select("*", F.explode(dim).alias("e")).where("e.c = kp_idx")
    kids = kids.select(*on, F.col("e.p").alias("parent"), F.col("kp_idx").alias("focus_kp"), F.col("oks_first").alias("before"), F.col("oks_second").alias("after"))
    up = merged.select(*on, F.col("kp_idx").alias("parent"), F.col("oks_second" if gain else "oks_first").alias("parent_oks"))
    d = kids.join(up, [*on, "parent"]).withColumn("delta", F.expr("after - before"))
    rule = f"parent_oks >= {parent}D and before <= {before}D and after >= {after}D and delta >= {step}D" if gain else f"parent_oks >= {parent}D and before >= {before}D and after <= {after}D and delta <= -{step}D"
    return d.where(rule)


def phantom_joints(joints: DataFrame, flip_dim: DataFrame, image: list[str], conf: float = 0.45, det: float = 1.0, images: DataFrame | None = None, oks: float = 0.35) -> DataFrame:
    """Absent limb joints that a decoder was sure of and the mixture was not, with the state of the opposite joint.

    With ``images`` (image columns, swaps_base, oks_ours) only images without swaps and with a similarity of ``oks`` or more count.
    """
    if images is not None:
        joints = joints.join(images.where(f"swaps_base = 0 and oks_ours >= {oks}D").select(*image), image, "left_semi")
    other = joints.select(*image, F.col("kp_idx").alias("flip_idx"), F.col("vis").alias("opp_vis"))
    d = joints.where(f"kp_idx between 5 and 16 and vis = 0 and base_score >= {conf}D and cov_det >= {det}D").join(F.broadcast(flip_dim.select("kp_idx", "flip_idx")), "kp_idx")  # 17 rows
    d = d.join(other, [*image, "flip_idx"], "left").withColumn("both_absent", F.expr("coalesce(opp_vis, 1) = 0"))
    return d.select(*image, F.col("kp_idx").alias("focus_kp"), "both_absent", F.when(F.col("both_absent"), "Both Sides Absent").otherwise("Absent (vis=0)").alias("status"), F.col("base_score").alias("conf"), "cov_det")


def leaving_joints(people: DataFrame, scale: float = 0.85, near: float = 4.0, far: float = 35.0, smallest: float = 15.0) -> DataFrame:
    """Joints inside their box that leave it by a moderate distance when the box is scaled down.

    ``people`` has bx, by, bw, bh, width, height, kx, ky, vis and key columns.
    """
    c = {n: F.col(n) for n in ("bx", "by", "bw", "bh", "kx", "ky")}
    box = S.scale_box(c["bx"], c["by"], c["bw"], c["bh"], F.lit(scale), F.col("width"), F.col("height"))
    d = people.where(f"vis > 0 and bw > {smallest}D and bh > {smallest}D and kx between bx and bx + bw and ky between by and by + bh").withColumn("s", box)
    d = d.withColumn("dist_out", S.exit_distance(c["kx"], c["ky"], F.col("s.x"), F.col("s.y"), F.col("s.w"), F.col("s.h"))).drop("s")
    return d.where((F.col("dist_out") >= near) & (F.col("dist_out") <= far)).withColumn("rel_dist", F.col("dist_out") / F.greatest("bw", "bh"))


def growing_uniform(tiers: DataFrame, keys: list[str], value: str = "value", drop: float = 0.008) -> DataFrame:
    """(keys..., p0 .. p4, corr, gradual_score): series over all five tiers (``tier`` 0 to 4) that grow steadily.

    The five values come side by side by one aggregate; keys without all five tiers are left out.
    """
    p = tiers.groupBy(*keys).agg(F.countDistinct("tier").alias("nt"), *(F.avg(F.when(F.col("tier") == i, F.col(value))).alias(f"p{i}") for i in range(5))).where("nt = 5")
    p = p.where("p4 >= 0.05D and p4 > p3 and p3 >= p1 and (p2 >= 0.002D or p3 >= 0.008D)").where(" and ".join(f"p{i + 1} - p{i} >= -{drop}D" for i in range(4)))
    mean = "((p0 + p1 + p2 + p3 + p4) / 5D)"
    var = "(" + " + ".join(f"(p{i} - {mean}) * (p{i} - {mean})" for i in range(5)) + ")"
    p = p.withColumn("corr", F.expr(f"if(sqrt({var} / 5D) > 1e-6D, (-2D * p0 - p1 + p3 + 2D * p4) / sqrt(10D * {var}), 0D)"))
    return p.select(*keys, *(f"p{i}" for i in range(5)), "corr", F.expr("corr * p4 * (0.3D + 0.7D * (p1 + 2D * p2 + 3D * p3) / (6D * p4 + 1e-6D))").alias("gradual_score"))


def cross_model(df: DataFrame, keys: list[str], model: str, models: list[str], value: str) -> DataFrame:
    """(keys..., one column a model, avg_value): keys that every model has; the models are named, so the pivot needs no extra pass."""
    p = df.groupBy(*keys).pivot(model, models).agg(F.avg(value)).na.drop(subset=models)
    return p.withColumn("avg_value", sum((F.col(m) for m in models), F.lit(0.0)) / len(models))


def catalog(queries: dict[str, tuple[DataFrame, list]], k: int) -> DataFrame:
    """(query, place, record): the first ``k`` rows of each query as JSON; NaN becomes null.  The limit is the feature."""
    out = None
    for name, (df, order) in queries.items():
        top = df.orderBy(*order).limit(k)
        clean = F.struct(*(F.expr(f"nanvl(`{c}`, null)").alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))
        one = top.select(F.lit(name).alias("query"), F.row_number().over(Window.orderBy(*order)).alias("place"), F.to_json(clean).alias("record"))  # k rows
        out = one if out is None else out.unionByName(one)
    return out


def packet_features(packets: DataFrame, candidates: DataFrame, second: float = 0.2, apart: float = 3.0) -> DataFrame:
    """(packet_id, n_bimodal, first_bimodal): joints of each packet whose second weight and mode distance are large enough."""
    c = candidates.where("weight is not null and mx is not null and my is not null").groupBy("packet_id", "potential_idx", "kp_idx").agg(
        F.array_sort(F.collect_list(F.struct("cand_idx", "mx", "my", "weight"))).alias("c")
    )  # candidates of one joint
    c = c.where("size(c) >= 2").withColumn("w2", F.expr("get(sort_array(transform(c, x -> x.weight), false), 1)")).withColumn("apart", F.expr("sqrt(pow(get(c, 0).mx - get(c, 1).mx, 2) + pow(get(c, 0).my - get(c, 1).my, 2))"))
    b = c.where(f"w2 >= {second}D and apart >= {apart}D").groupBy("packet_id").agg(F.count(F.lit(1)).alias("n_bimodal"), F.min("kp_idx").alias("first_bimodal"))
    return packets.join(b, "packet_id", "left").withColumn("n_bimodal", F.coalesce("n_bimodal", F.lit(0)))


def joint_features(packets: DataFrame, joints: DataFrame, keys: list[str]) -> DataFrame:
    """Adds n_occluded, max_jump and max_jump_kp: occluded joints of each packet's image and the largest gain of one joint (0 and null if none gained).

    ``joints`` has ``keys``, run_id, kp_idx, vis, oks_base and oks_ours; of runs of the same joint the highest counts.
    """
    j = joints.groupBy(*keys, "kp_idx").agg(F.max_by(F.struct("vis", F.expr("oks_ours - oks_base").alias("delta")), "run_id").alias("j"))
    gain = F.struct(F.col("j.delta").alias("delta"), (-F.col("kp_idx")).alias("at"))
    j = j.groupBy(*keys).agg(F.count_if(F.col("j.vis") == 1).alias("n_occluded"), F.max(F.when(F.col("j.delta") > 0, gain)).alias("g"))
    d = packets.join(j, keys, "left").withColumn("n_occluded", F.coalesce("n_occluded", F.lit(0)))
    return d.withColumn("max_jump", F.coalesce("g.delta", F.lit(0.0))).withColumn("max_jump_kp", -F.col("g.at")).drop("g")


def focus_joint(wanted, joints: DataFrame, image: list[str], bimodal: DataFrame, default: int = 9) -> DataFrame:
    """(image..., focus_kp): a wanted index or name, else the first bimodal joint, else the largest gain, else ``default``."""
    from posegrain.schema import KEYPOINTS

    text = str(wanted).lower()
    fixed = int(text) if text.isdigit() and int(text) < len(KEYPOINTS) else KEYPOINTS.index(text) if text in KEYPOINTS else None
    best = joints.groupBy(*image).agg(F.max_by("kp_idx", F.when(F.expr("oks_ours is not null and oks_base is not null"), F.struct(F.expr("oks_ours - oks_base"), -F.col("kp_idx")))).alias("gain_kp"))
    return best.join(bimodal.select(*image, "first_bimodal"), image, "left").select(*image, F.coalesce(F.lit(fixed), "first_bimodal", "gain_kp", F.lit(default)).alias("focus_kp"))


def pipeline_mode(has_graph, n_augmentations):
    """tta_mrf, tta or basic."""
    return F.when(has_graph, "tta_mrf").when(n_augmentations > 1, "tta").otherwise("basic")


def stage_costs(timings: DataFrame) -> DataFrame:
    """(stage, n, mean, std, min, max): population standard deviation of stage times in ms."""
    return timings.groupBy("stage").agg(F.count(F.lit(1)).alias("n"), F.avg("ms").alias("mean"), F.stddev_pop("ms").alias("std"), F.min("ms").alias("min"), F.max("ms").alias("max"))


def pipeline_costs(costs: DataFrame, configurations: dict[str, list[str]]) -> DataFrame:
    """(configuration, total_mean, total_std, fps): sums of stage means, root of summed squares of their deviations."""
    dim = [(c, s) for c, stages in configurations.items() for s in stages]
    d = costs.sparkSession.createDataFrame(dim, "configuration string, stage string")
    t = d.join(costs, "stage").groupBy("configuration").agg(F.sum("mean").alias("total_mean"), F.sqrt(F.sum(F.col("std") * F.col("std"))).alias("total_std"))
    return t.withColumn("fps", F.when(F.col("total_mean") > 0, 1000.0 / F.col("total_mean")).otherwise(0.0))


def visibility_slices(joints: DataFrame, image: list[str]) -> DataFrame:
    """(image..., absent, occluded, visible): joint indices of an image by visibility, in order."""
    pick = lambda v, out: F.array_sort(F.collect_list(F.when(F.col("vis") == v, F.col("kp_idx")))).alias(out)
    return joints.groupBy(*image).agg(pick(0, "absent"), pick(1, "occluded"), pick(2, "visible"))


def best_of_each(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in ``order``: one row a key leaves each task (a window with row_number() = 1)."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")
