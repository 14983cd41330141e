"""Cohorts, leaderboards and run reports over image-level metric tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from posegrain.operators.prefix import quantiles


def _scalar(one: DataFrame) -> float | None:
    """The value of a one-row result; null if there is none."""
    row = one.first()
    return None if row is None else float(row["value"])


def focus_groups(df: DataFrame, id_col: str, n: int = 50, seed: int = 42, step: float = 0.1, fail: float = 0.5, quantile: float = 0.9) -> DataFrame:
    """(group_name, id, place): Wins, Regressions, High_Uncertainty and Edge_Cases, disjoint, at most ``n`` each.

    Ids are drawn by a hash of id and seed, so the draw does not depend on partitions.  A row that is eligible for an
    earlier group but not drawn for it stays available for the later ones: its place among the eligible decides.  One
    ranking a group over the eligible rows, of which only the first n leave each task.
    """
    d = df.withColumn("q", F.lit(_scalar(quantiles(df, [], "covariance_volume", [quantile]))).cast("double"))
    rules = {
        "Wins": "oks_ours > oks_base + {0}D".format(step),
        "Regressions": "oks_base > oks_ours + {0}D".format(step),
        "High_Uncertainty": "covariance_volume > q",
        "Edge_Cases": "oks_base < {0}D and oks_ours < {0}D".format(fail),
    }
    h = F.xxhash64(F.col(id_col), F.lit(seed))
    taken: DataFrame | None = None
    out: DataFrame | None = None
    for name, rule in rules.items():
        left = d.where(rule).select(id_col)
        if taken is not None:
            left = left.join(F.broadcast(taken), id_col, "left_anti")  # at most 4 n rows
        drawn = left.select(id_col, h.alias("h")).orderBy("h", id_col).limit(n)
        drawn = drawn.select(F.lit(name).alias("group_name"), id_col, F.row_number().over(Window.orderBy("h", id_col)).alias("place"))  # n rows
        out = drawn if out is None else out.unionByName(drawn)
        taken = drawn.select(id_col) if taken is None else taken.union(drawn.select(id_col))
    return out


def keypoint_outliers(joints: DataFrame, image: list[str], n: int = 50) -> DataFrame:
    """(group_name, image..., keypoint, delta): images with the largest gain and the worst drop at one joint; ties by image."""
    d = joints.where("oks_ours is not null and oks_base is not null").withColumn("delta", F.expr("oks_ours - oks_base"))
    ends = d.groupBy(*image).agg(F.max_by(F.struct("keypoint", "delta"), F.struct("delta", -F.col("kp_idx"))).alias("hi"), F.min_by(F.struct("keypoint", "delta"), F.struct("delta", "kp_idx")).alias("lo"))
    gains = ends.orderBy(F.col("hi.delta").desc(), *image).limit(n).select(F.lit("Top_Single_KP_Gains").alias("group_name"), *image, "hi.*")
    drops = ends.orderBy(F.col("lo.delta").asc(), *image).limit(n).select(F.lit("Worst_Single_KP_Drops").alias("group_name"), *image, "lo.*")
    return gains.unionByName(drops)


def run_report(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys..., n_images, <c>_mean, <c>_std, pct_wins, pct_regressions, pct_ties): a column that is missing gives null."""
    there = [c for c in columns if c in df.columns]
    share = lambda cond: (F.avg(F.coalesce(F.expr(cond).cast("double"), F.lit(0.0))) * 100)
    aggs = [F.count(F.lit(1)).alias("n_images")]
    aggs += [e for c in columns for e in ((F.avg(c) if c in there else F.lit(None).cast("double")).alias(f"{c}_mean"), (F.stddev_samp(c) if c in there else F.lit(None).cast("double")).alias(f"{c}_std"))]
    if "delta_oks" in df.columns:
        aggs += [share("delta_oks > 0").alias("pct_wins"), share("delta_oks < 0").alias("pct_regressions"), share("delta_oks = 0").alias("pct_ties")]
    return df.groupBy(*keys).agg(*aggs)


def ablation_table(df: DataFrame, columns: list[str]) -> DataFrame:
    """(metric, n, mean, std, median, iqr, min, max) of several columns in one pass over one unpivoted table."""
    long = df.unpivot([], [F.col(c).cast("double").alias(c) for c in columns], "metric", "value").where("value is not null")
    a = long.groupBy("metric").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
    q = quantiles(long, ["metric"], "value", [0.25, 0.5, 0.75]).groupBy("metric").agg(*(F.max(F.when(F.col("prob") == p, F.col("value"))).alias(x) for p, x in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))))
    return a.join(q, "metric").select("metric", "n", "mean", "std", "median", (F.col("q3") - F.col("q1")).alias("iqr"), "min", "max")


def cohort_counts(df: DataFrame, step: float = 0.1, fail: float = 0.5, quantile: float = 0.9) -> DataFrame:
    """(cohort, n, pct): overlapping cohorts, counted in one pass."""
    d = df.withColumn("q", F.lit(_scalar(quantiles(df, [], "covariance_volume", [quantile]))).cast("double"))
    rules = [("wins", f"oks_ours > oks_base + {step}D"), ("regressions", f"oks_base > oks_ours + {step}D"), ("high_uncertainty", "covariance_volume > q"), ("edge_cases", f"oks_base < {fail}D and oks_ours < {fail}D")]
    a = d.agg(F.count(F.lit(1)).alias("total"), *(F.count(F.when(F.expr(r), 1)).alias(n) for n, r in rules))
    return a.select("total", F.inline(F.array(*(F.struct(F.lit(n).alias("cohort"), F.col(n).alias("n")) for n, _ in rules)))).select("cohort", "n", (F.col("n") * 100.0 / F.col("total")).alias("pct"))


def run_medians(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys..., metric, n, median) of several columns in one pass over one unpivoted table; nulls and NaN are left out."""
    long = df.unpivot(list(keys), [F.col(c).cast("double").alias(c) for c in columns], "metric", "value")
    return quantiles(long, [*keys, "metric"], "value", [0.5]).select(*keys, "metric", "n", F.col("value").alias("median"))


def swap_sums(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys..., <c>_sum): totals of counts; a column that is missing gives 0."""
    return df.groupBy(*keys).agg(*((F.coalesce(F.sum(c), F.lit(0)) if c in df.columns else F.lit(0)).cast("bigint").alias(f"{c}_sum") for c in columns))
