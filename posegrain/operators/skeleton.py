"""Tree-structured decoding of candidate joints, and bone statistics.

The candidates of an image are gathered once (a few dozen structs) and the tree's fixed edges become a fixed number
of array expressions: one shuffle by image, no join a level, no Python.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from posegrain.functions.mixtures import pairwise_score, unary_score


def decode(candidates: DataFrame, edges: list[tuple[int, int, float, float, int]], image: list[str], multiplier: float = 1.0) -> DataFrame:
    """(image..., kp_idx, cand_idx, score): the best candidate of every joint under the tree, by max-product messages.

    ``candidates`` has the image columns, area, kp_idx, cand_idx, mx, my, cxx, cxy, cyy, weight.  Score: unary of each
    candidate plus spring score of each bone, with bone lengths in units of sqrt(max(area, 1)).  Equal scores go to the
    smaller cand_idx.  A joint whose parent has no candidates is the root of a tree of its own; ``score`` is the best
    belief of a root's tree and null for the other joints.
    """
    nodes = sorted({n for p, c, *_ in edges for n in (p, c)})
    parent_of = {c: p for p, c, *_ in edges}
    first = candidates.select(*image, F.struct("kp_idx", "cand_idx", "mx", "my", F.expr(unary_score()).alias("u")).alias("c"), "area")
    g = first.groupBy(*image).agg(F.array_sort(F.collect_list("c")).alias("all"), F.expr("sqrt(greatest(max(area), 1D))").alias("ra"))
    g = g.select(*image, "ra", *(F.expr(f"filter(all, x -> x.kp_idx = {n})").alias(f"c{n}") for n in nodes))
    g = g.select("*", *(F.expr(f"transform(c{n}, x -> x.u)").alias(f"b{n}") for n in nodes))
    for depth in sorted({e[4] for e in edges}, reverse=True):
        level = [e for e in edges if e[4] == depth]
        spring = lambda m, s: pairwise_score("sqrt((x.mx - y.mx) * (x.mx - y.mx) + (x.my - y.my) * (x.my - y.my))", f"{m}D", f"{s}D", "ra", multiplier)
        best = lambda k, m, s: f"transform(c{parent_of[k]}, x -> array_max(transform(c{k}, (y, j) -> named_struct('s', get(b{k}, j) + {spring(m, s)}, 'j', -j))))"
        g = g.select("*", *(F.expr(best(k, m, s)).alias(f"m{k}") for _, k, m, s, _ in level))
        sums = {p: " + ".join(f"coalesce(get(m{k}, i).s, 0D)" for q, k, *_ in level if q == p) for p in {e[0] for e in level}}
        g = g.select(*(F.expr(f"transform(b{n}, (v, i) -> v + {sums[n]})").alias(c) if (n := int(c[1:]) if c[0] == "b" and c[1:].isdigit() else -1) in sums else F.col(c) for c in g.columns))
    own = "array_max(transform(b{0}, (v, i) -> named_struct('s', v, 'j', -i)))"
    order = [n for n in nodes if n not in parent_of] + [e[1] for e in edges]
    g = g.select("*", *(F.expr(own.format(n)).alias(f"o{n}") for n in nodes))
    for n in order:
        lone = f"-o{n}.j"
        g = g.withColumn(f"p{n}", F.expr(lone if n not in parent_of else f"if(size(c{parent_of[n]}) = 0, {lone}, -get(m{n}, p{parent_of[n]}).j)"))
    is_root = lambda n: "true" if n not in parent_of else f"size(c{parent_of[n]}) = 0"
    rows = ", ".join(f"if(size(c{n}) = 0, null, named_struct('kp_idx', {n}, 'cand_idx', get(c{n}, p{n}).cand_idx, 'score', if({is_root(n)}, o{n}.s, null)))" for n in nodes)
    # outer, for the reason given at heatmap_ops.pixels
    return g.select(*image, F.expr(f"inline_outer(filter(array({rows}), x -> x is not null))")).where("kp_idx is not null")


def decode_pose(candidates: DataFrame, edges: list[tuple[int, int, float, float, int]], image: list[str], multiplier: float = 1.0) -> DataFrame:
    """Images with a joint of two or more candidates are decoded; in the others every joint keeps its only candidate."""
    multi = candidates.groupBy(*image).agg(F.max("cand_idx").alias("m")).where("m > 0").select(*image)
    solved = decode(candidates.join(multi, image, "left_semi"), edges, image, multiplier)
    plain = candidates.join(multi, image, "left_anti").select(*image, "kp_idx", "cand_idx", F.expr(unary_score()).alias("score"))
    return solved.unionByName(plain)


def bone_statistics(joints: DataFrame, edges: DataFrame, image: list[str], least: int = 10) -> DataFrame:
    """(parent, child, n, mean, std, median): bone lengths over sqrt(area) where both ends are visible (vis 2) and area is positive.

    Population standard deviation; fewer than ``least`` bones give mean 0 and standard deviation 1.
    """
    from posegrain.operators.prefix import quantiles

    j = joints.where("vis >= 2 and area > 0")
    e = F.broadcast(edges.select("parent", "child"))  # 16 rows
    a = j.join(e, F.col("kp_idx") == F.col("parent")).select(*image, "parent", "child", "x", "y", "area")
    b = j.select(*image, F.col("kp_idx").alias("child"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    d = a.join(b, [*image, "child"]).select("parent", "child", F.expr("sqrt((x - x2) * (x - x2) + (y - y2) * (y - y2)) / sqrt(area)").alias("ratio"))
    s = d.groupBy("parent", "child").agg(F.count(F.lit(1)).alias("n"), F.avg("ratio").alias("mean"), F.stddev_pop("ratio").alias("std"))
    m = quantiles(d, ["parent", "child"], "ratio", [0.5]).select("parent", "child", F.col("value").alias("median"))
    few = F.col("n") < least
    return s.join(m, ["parent", "child"]).select("parent", "child", "n", F.when(few, 0.0).otherwise(F.col("mean")).alias("mean"), F.when(few, 1.0).otherwise(F.col("std")).alias("std"), "median")
