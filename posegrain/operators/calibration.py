"""Calibration of uncertainties: sparsification, expected calibration error, rank correlation, ROC curves, densities, tier summaries."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from posegrain.operators import grid
from posegrain.operators.prefix import average_ranks, cumulate, quantiles, same
from posegrain.session import materialize

POINTS = 100


def _curves(df: DataFrame, keys: list[str], error: str, uncertainty: str) -> DataFrame:
    """(keys..., side, v, n, err): rows and errors by value, by uncertainty (side model) and by the error itself (side oracle).

    Both sides are rows of one array, so the input is read and shuffled once.
    """
    sides = F.array(*(F.struct(F.lit(s).alias("side"), F.col(c).cast("double").alias("v")) for s, c in (("model", uncertainty), ("oracle", error))))
    d = df.where(f"{error} is not null and {uncertainty} is not null and not isnan({uncertainty}) and not isnan({error})")
    return d.select(*keys, F.col(error).alias("err"), F.inline(sides)).groupBy(*keys, "side", "v").agg(F.count(F.lit(1)).alias("n"), F.sum("err").alias("err"))


def sparsification(df: DataFrame, keys: list[str], error: str = "err", uncertainty: str = "unc") -> DataFrame:
    """(keys..., n_rows, m, i, model, oracle; no key may have one of these names or v, n, err, side): the retained-error curves at i / (m - 1), without their last point (nothing left).

    Rows are removed by descending value.  Rows of one value are removed evenly: a cut inside a tie takes their mean
    error.  So the curves do not depend on the order of equal values, and need one row a value.
    """
    c = cumulate(_curves(df, keys, error, uncertainty), [*keys, "side"], "v", ["n", "err"], descending=True)
    m = F.least(F.col("n_all"), F.lit(POINTS)).cast("int")
    c = c.withColumn("m", m).where("m > 1 or n_before = 0")
    index = "least(cast(floor(i * (1D / greatest(m - 1, 1)) * n_all) as bigint), n_all)"
    first, last = "cast(floor(n_before * (m - 1D) / n_all) as int)", "cast(floor((n_before + n) * (m - 1D) / n_all) as int)"
    near = f"sequence(greatest(0, {first} - 1), least(m - 1, {last} + 1))"
    # plain arithmetic leaves the few values at whose rows a point can lie; only they meet the lambda
    c = c.where("floor((n_before + n + 1) * (m - 1D) / n_all) > floor((n_before - 1) * (m - 1D) / n_all) or m = 1")
    # the last point is 1 exactly, so its index is n and nothing is left
    c = c.withColumn("i", F.explode(F.expr(f"filter({near}, i -> i = 0 or i < m - 1)"))).withColumn("_cut", F.expr(index)).where("_cut >= n_before and _cut < n_before + n")
    left = F.expr("(err_all - err_before - (_cut - n_before) * (err / n)) / (n_all - _cut)")
    value = lambda side: F.max(F.when(F.col("side") == side, left)).alias(side)
    return c.groupBy(*keys, F.col("n_all").alias("n_rows"), "m", "i").agg(value("model"), value("oracle"))


def ause(df: DataFrame, keys: list[str], error: str = "err", uncertainty: str = "unc", last_point: str = "zero") -> DataFrame:
    """(keys..., n_rows, ause): area between the curve by uncertainty and the curve by error, by trapezoids.

    ``last_point`` "zero": both curves end at 0 when everything is removed; "clip": the last point is the last row's error
    (then the rows with the least value stand for the last row).  Empty groups have no row.
    """
    c = sparsification(df, keys, error, uncertainty)
    diff = F.col("model") - F.col("oracle")
    weight = F.when(F.col("m") == 1, 0.0).when(F.col("i") == 0, 0.5).otherwise(1.0) / F.greatest(F.col("m") - 1, F.lit(1))
    area = c.groupBy(*keys, "n_rows", "m").agg(F.sum(diff * weight).alias("area"))
    if last_point == "clip":
        valid = df.where(f"{error} is not null and {uncertainty} is not null and not isnan({uncertainty}) and not isnan({error})")
        low = valid.groupBy(*keys).agg(F.min(error).alias("least_error"), F.min(uncertainty).alias("u"))
        on = same(keys, "d", "l")
        ends = valid.alias("d").join(low.alias("l"), on & (F.col(f"d.{uncertainty}") == F.col("l.u"))).groupBy(*(F.col(f"d.{k}").alias(k) for k in keys)).agg((F.avg(f"d.{error}") - F.first("l.least_error")).alias("end"))
        on = same(keys, "a", "e")
        area = area.alias("a").join(ends.alias("e"), on).select(*(F.col(f"a.{k}").alias(k) for k in keys), "n_rows", (F.col("area") + F.when(F.col("m") > 1, F.col("end") * 0.5 / (F.col("m") - 1)).otherwise(0.0)).alias("area"))
    return area.select(*keys, "n_rows", F.col("area").alias("ause"))


def regimes(df: DataFrame) -> DataFrame:
    """Each joint under every regime it belongs to (all, k1, k2): one pass instead of a filter a regime."""
    tags = F.array_compact(F.array(F.lit("all"), F.when(F.col("n_components") == 1, "k1"), F.when(F.col("n_components") == 2, "k2")))
    return df.select("*", F.explode(tags).alias("regime"))


def predictors(beta: float, tau: float | None = None) -> list[tuple[str, str, str]]:
    """(predictor, uncertainty, error) of the sparsification report: ours against our error, baselines against theirs."""
    gmm, base = f"(1D - exp(-{beta}D * cov_det))", "(1D - base_score)"
    gate = "n_components = 2" if tau is None else f"(n_components = 2 or {gmm} > {tau}D)"
    soft = f"((exp({base}) * {base} + exp({gmm}) * {gmm}) / (exp({base}) + exp({gmm})))"
    return [
        ("gmm_raw", "cov_det", "1D - oks_ours"),
        ("max_pooling", f"if(base_score is null, null, greatest({base}, {gmm}))", "1D - oks_ours"),
        ("gating", f"if({gate}, {gmm}, {base})", "1D - oks_ours"),
        ("softmax", soft, "1D - oks_ours"),
        ("baseline_argmax", "-base_score", "1D - oks_base"),
        ("baseline_entropy", "heatmap_entropy", "1D - oks_base"),
    ]


def sparsification_report(df: DataFrame, keys: list[str], beta: float = 0.1, tau: float | None = None, last_point: str = "zero") -> DataFrame:
    """AUSE of all predictors over visible joints, in one pass: the predictors are rows of an array, not six scans."""
    rows = F.array(*(F.struct(F.lit(n).alias("predictor"), F.expr(u).cast("double").alias("unc"), F.expr(e).cast("double").alias("err")) for n, u, e in predictors(beta, tau)))
    return ause(df.where("vis > 0 and oks_ours is not null and cov_det is not null").select(*keys, F.inline(rows)), [*keys, "predictor"], last_point=last_point)


def quantile_bins(df: DataFrame, keys: list[str], value: str, error: str, bins: int = 10) -> DataFrame:
    """(keys..., bin, mean_unc, mean_err, n): calibration bins between distinct quantile edges; a value on an edge belongs to the lower bin.  Needs at least one key."""
    edges = quantiles(df, keys, value, [i / bins for i in range(bins + 1)]).groupBy(*keys).agg(F.array_sort(F.collect_set("value")).alias("edges"))
    on = same(keys, "d", "e")
    d = df.where(f"{value} is not null and {error} is not null").alias("d").join(edges.alias("e"), on)
    place = F.greatest(F.lit(0), F.size(F.filter("e.edges", lambda x: x < F.col(f"d.{value}"))) - 1)
    d = d.select(*(F.col(f"d.{k}").alias(k) for k in keys), place.alias("bin"), F.col(f"d.{value}").alias("u"), F.col(f"d.{error}").alias("err"))
    return d.groupBy(*keys, "bin").agg(F.avg("u").alias("mean_unc"), F.avg("err").alias("mean_err"), F.count(F.lit(1)).alias("n"))


def expected_calibration_error(bins: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., n, ece): weighted distance between each bin's mean error and its mean uncertainty over the largest one."""
    rows = bins.groupBy(*keys).agg(F.collect_list(F.struct("mean_unc", "mean_err", "n")).alias("b"), F.max("mean_unc").alias("top"))  # at most `bins` rows a key
    gap = F.aggregate("b", F.lit(0.0), lambda a, x: a + x["n"] * F.abs(x["mean_err"] - F.when(F.col("top") > 0, x["mean_unc"] / F.col("top")).otherwise(x["mean_unc"])))
    total = F.aggregate("b", F.lit(0).cast("bigint"), lambda a, x: a + x["n"])
    return rows.select(*keys, total.alias("n"), (gap / total).alias("ece"))


def spearman(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """(keys..., n, spearman): correlation of average ranks; null for fewer than 2 rows and for a side without differences.

    Equal pairs are counted first and written once; ranks are looked up by value, and deviations are taken from the
    mean rank, which is known, so nothing cancels at large n.
    """
    v = df.where(f"{x} is not null and {y} is not null and not isnan({x}) and not isnan({y})")
    pairs = materialize(v.groupBy(*keys, F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count(F.lit(1)).alias("n")), "pairs")
    side = lambda c: average_ranks(pairs.groupBy(*keys, c).agg(F.sum("n").alias("n")), keys, c, f"r{c}")
    r = pairs.alias("p").join(side("x").alias("a"), same([*keys, "x"], "p", "a")).join(side("y").alias("b"), same([*keys, "y"], "p", "b"))
    mid = (F.col("a.n_all") + 1) / 2.0
    r = r.select(*(F.col(f"p.{k}").alias(k) for k in keys), "p.n", (F.col("rx") - mid).alias("dx"), (F.col("ry") - mid).alias("dy"))
    r = r.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum(F.expr("n * dx * dy")).alias("xy"), F.sum(F.expr("n * dx * dx")).alias("xx"), F.sum(F.expr("n * dy * dy")).alias("yy"))
    return r.select(*keys, "n", F.expr("if(n > 1 and xx > 0 and yy > 0, xy / sqrt(xx * yy), null)").alias("spearman"))


def roc_counts(df: DataFrame, keys: list[str], score: str, positive: str) -> DataFrame:
    """(keys..., p, n, u2): positives, negatives and twice the Mann-Whitney statistic; all integers, so exact at any size."""
    c = df.where(f"{score} is not null and not isnan({score}) and {positive} is not null")
    c = c.groupBy(*keys, F.col(score).cast("double").alias("v")).agg(F.count(F.when(F.col(positive), 1)).alias("pos"), F.count(F.when(~F.col(positive), 1)).alias("neg"))
    c = cumulate(c, keys, "v", ["neg"])
    return c.groupBy(*keys).agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"), F.sum(F.col("pos") * (2 * F.col("neg_before") + F.col("neg"))).alias("u2"))


def auroc(df: DataFrame, keys: list[str], score: str, positive: str) -> DataFrame:
    """(keys..., p, n, u2, auroc); null where a class is empty."""
    return roc_counts(df, keys, score, positive).withColumn("auroc", F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("u2") / (2.0 * F.col("p") * F.col("n"))))


ABSENCE_SCORES = (("cov_det", "cov_det"), ("uniform_weight", "uniform_weight"), ("heatmap_entropy", "heatmap_entropy"), ("inv_base_score", "1D - base_score"))


def absence_auroc(df: DataFrame, keys: list[str]) -> DataFrame:
    """How well each score tells absent joints (vis = 0) from present ones."""
    rows = F.array(*(F.struct(F.lit(n).alias("predictor"), F.expr(e).cast("double").alias("score")) for n, e in ABSENCE_SCORES))
    return auroc(df.where("vis is not null").select(*keys, F.expr("vis = 0").alias("absent"), F.inline(rows)), [*keys, "predictor"], "score", "absent")


def threshold_roc(df: DataFrame, score: str, positive: str, points: int = POINTS) -> DataFrame:
    """(i, tpr, fpr) at the percentiles i / (points - 1) of the score: share of each class at or above it.

    Cumulative counts by value replace the comparison of every row with every threshold.
    """
    t = quantiles(df, [], score, [i / (points - 1) for i in range(points)]).select((F.round(F.col("prob") * (points - 1))).cast("int").alias("i"), F.col("value").alias("v"))
    v = df.where(f"{score} is not null").select(F.col(score).cast("double").alias("v"), F.col(positive).alias("pos"))
    # thresholds join the values as rows of their own, with no count
    c = v.groupBy("v").agg(F.count(F.when(F.col("pos"), 1)).alias("p"), F.count(F.when(~F.col("pos"), 1)).alias("n")).unionByName(t.select("v", F.lit(0).cast("bigint").alias("p"), F.lit(0).cast("bigint").alias("n")))
    c = cumulate(c.groupBy("v").agg(F.sum("p").alias("p"), F.sum("n").alias("n")), [], "v", ["p", "n"])
    return t.join(c, "v").select("i", ((F.col("p_all") - F.col("p_before")) / F.col("p_all")).alias("tpr"), ((F.col("n_all") - F.col("n_before")) / F.col("n_all")).alias("fpr"))


def curve_area(curve: DataFrame) -> DataFrame:
    """(auc): trapezoids over fpr of a curve with few points."""
    pts = curve.agg(F.array_sort(F.collect_list(F.struct("fpr", "tpr"))).alias("a"))
    area = "aggregate(sequence(1, size(a) - 1), 0D, (s, j) -> s + (a[j].fpr - a[j - 1].fpr) * (a[j].tpr + a[j - 1].tpr) / 2)"
    return pts.select(F.expr(area).alias("auc"))


def density(df: DataFrame, keys: list[str], value: str, lo: float, hi: float, points: int = 50) -> DataFrame:
    """(keys..., x, density): Gaussian kernel density on a grid, bandwidth n^(-1/5) times the standard deviation.

    Values are counted first; each distinct value meets the grid as an array, so no join multiplies the rows.
    """
    v = df.where(f"{value} is not null").groupBy(*keys, F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    s = df.where(f"{value} is not null").groupBy(*keys).agg((F.stddev_samp(value) * F.pow(F.count(F.lit(1)).cast("double"), F.lit(-0.2))).alias("h"), F.count(F.lit(1)).alias("total"))
    on = same(keys, "v", "s")
    step = (hi - lo) / (points - 1)
    g = v.alias("v").join(s.alias("s"), on).where("h > 0").select(*(F.col(f"v.{k}").alias(k) for k in keys), "v", "n", "h", "total", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("j"))
    x = F.lit(lo) + F.col("j") * F.lit(step)
    k = F.exp(-0.5 * F.pow((x - F.col("v")) / F.col("h"), 2)) * F.col("n") / (F.col("total") * F.col("h") * 2.5066282746310002)
    return g.groupBy(*keys, "j").agg(F.sum(k).alias("density")).select(*keys, "j", (F.lit(lo) + F.col("j") * F.lit(step)).alias("x"), "density")


def summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys..., n, mean, std, min, q1, median, q3, max): std is 0 for a single row."""
    a = df.where(f"{value} is not null").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))
    q = quantiles(df, keys, value, [0.25, 0.5, 0.75]).groupBy(*keys).agg(*(F.max(F.when(F.col("prob") == p, F.col("value"))).alias(n) for p, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))))
    on = same(keys, "a", "q")
    return a.alias("a").join(q.alias("q"), on).select(*(F.col(f"a.{k}").alias(k) for k in keys), "n", "mean", "std", "min", "q1", "median", "q3", "max")


def boxplot(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """summary() with the number of values beyond 1.5 interquartile ranges."""
    s = summary(df, keys, value)
    on = same(keys, "d", "s")
    out = df.alias("d").join(s.alias("s"), on).where(f"d.{value} < s.q1 - 1.5D * (s.q3 - s.q1) or d.{value} > s.q3 + 1.5D * (s.q3 - s.q1)")
    n = out.groupBy(*(F.col(f"s.{k}").alias(k) for k in keys)).agg(F.count(F.lit(1)).alias("n_fliers"))
    on = same(keys, "s", "n")
    return s.alias("s").join(n.alias("n"), on, "left").select("s.*", F.coalesce("n_fliers", F.lit(0)).alias("n_fliers"))


def beta_grid(lo: float = -6.0, hi: float = 4.0, n: int = 300) -> list[float]:
    return [10.0 ** (lo + (hi - lo) * i / (n - 1)) for i in range(n)]


def beta_search(df: DataFrame, keys: list[str], betas: list[float], taus: list[float] = (0.01, 0.05, 0.1, 0.2, 0.5), chunk: int = 25, group_rows: int = 20_000) -> DataFrame:
    """(keys..., strategy, beta, tau, n_rows, ause) for every beta and strategy; ``best_beta`` picks the winners.

    The grid multiplies the rows by some thousands, so it is taken to the rows.  A group of up to ``group_rows`` rows goes
    to one task.  The rows of larger groups are written once, each group in files of its own; a task reads them where they are
    and takes ``chunk`` betas through them (``grid.areas``), so nothing is shuffled once a beta or a task.  Both ways give
    the same areas.  Rows with a null or NaN measure are left out.
    """
    spark = df.sparkSession
    v = df.where("vis > 0").select(*keys, F.expr("1D - oks_ours").alias("err"), F.col("cov_det").alias("det"), (F.coalesce(F.col("n_components"), F.lit(-1)) == 2).alias("two"), F.expr("1D - base_score").alias("ub"))
    v = materialize(v.where(" and ".join(f"{c} is not null and not isnan({c})" for c in ("err", "det", "ub"))), "beta-rows")
    big = v.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > group_rows).collect()  # one row for some thousands at most
    if not big:
        return _grid_in_arrays(v, keys, betas, taus)
    kinds = dict(v.dtypes)
    groups = F.broadcast(spark.createDataFrame([(i, *r[:-1]) for i, r in enumerate(big)], ", ".join(["_g int", *(f"`{k}` {kinds[k]}" for k in keys)])))
    rest = v.alias("v").join(groups.alias("b"), same(keys, "v", "b"), "left_anti")
    large = v.alias("v").join(groups.alias("b"), same(keys, "v", "b")).select("_g", "err", "det", "two", "ub")
    areas = _grid_in_files(large, [r.n for r in big], betas, taus, chunk)
    areas = areas.join(groups, "_g").select(*keys, "strategy", "beta", "tau", "n_rows", "ause")
    return _grid_in_arrays(rest, keys, betas, taus).unionByName(areas)


def retained_error(err: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Mean error of what is left after removal by descending value, at the points of the curve; ties even, last point kept."""
    n = len(err)
    m = min(n, POINTS)
    k = np.floor(np.arange(m - 1) * (1.0 / max(m - 1, 1)) * n).astype(np.int64)
    order = np.argsort(-value)  # the order among equal values does not matter
    v = -value[order]
    gone = np.concatenate(([0.0], np.cumsum(err[order])))
    at = np.append(k, n - 1)
    lo, hi = np.searchsorted(v, v[at], side="left"), np.searchsorted(v, v[at], side="right")
    tie = (gone[hi] - gone[lo]) / (hi - lo)  # mean error among the rows of one value
    tail = (gone[n] - gone[lo[:-1]] - (k - lo[:-1]) * tie[:-1]) / (n - k)
    return np.append(tail, tie[-1])


def ause_array(err: np.ndarray, unc: np.ndarray, oracle: np.ndarray | None = None) -> float:
    """ause() of one group in memory; ``oracle`` is retained_error(err, err), if it is known already."""
    if len(err) < 2:
        return 0.0
    gap = retained_error(err, unc) - (retained_error(err, err) if oracle is None else oracle)
    return float((gap[1:] + gap[:-1]).sum() / 2 / (len(gap) - 1))


def _grid_in_arrays(v: DataFrame, keys: list[str], betas: list[float], taus: list[float]) -> DataFrame:
    names = [*keys, "strategy", "beta", "tau", "n_rows", "ause"]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        err, det, ub = pdf[["err", "det", "ub"]].to_numpy().T.copy()
        two = pdf["two"].to_numpy(bool)
        oracle = retained_error(err, err)
        eb = np.exp(ub)
        out = []
        for beta in betas:
            ug = 1.0 - np.exp(-beta * det)
            eg = np.exp(ug)
            tries = [("max_pooling", None, np.maximum(ub, ug)), ("gating_k", None, np.where(two, ug, ub)), ("softmax", None, (eb * ub + eg * ug) / (eb + eg))]
            tries += [("gating_tau", t, np.where(two | (ug > t), ug, ub)) for t in taus]
            out += [(*key, s, beta, t, len(err), ause_array(err, u, oracle)) for s, t, u in tries]
        return pd.DataFrame(out, columns=names)

    kinds = dict(v.dtypes)
    return v.groupBy(*keys).applyInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", strategy string, beta double, tau double, n_rows bigint, ause double")


def _grid_in_files(rows: DataFrame, sizes: list[int], betas: list[float], taus: list[float], chunk: int) -> DataFrame:
    """(_g, strategy, beta, tau, n_rows, ause) of groups 0 to len(sizes) - 1: a task for each group and ``chunk`` betas."""
    # ordered by ub too, so that a block meets few of its bins
    parts = materialize(rows.repartitionByRange("_g", "ub", "det").sortWithinPartitions("_g", "ub"), "beta-groups", ["_g"])
    files: dict[int, list[str]] = {}
    for f in sorted(parts.inputFiles()):
        files.setdefault(int(re.search(r"/_g=(\d+)/", f)[1]), []).append(f)
    jobs = [(g, sizes[g], betas[lo : lo + chunk], files[g]) for g in files for lo in range(0, len(betas), chunk)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for r in (r for b in batches for r in b.itertuples(index=False)):
            blocks = partial(grid.read_blocks, list(r.files))
            if r.n <= grid.HELD:
                blocks = list(blocks()).__iter__
            out = grid.areas(blocks, r.n, list(r.betas), taus)
            yield pd.DataFrame([(r.g, *x[:3], r.n, x[3]) for x in out], columns=["_g", "strategy", "beta", "tau", "n_rows", "ause"])

    todo = rows.sparkSession.createDataFrame(jobs, "g int, n bigint, betas array<double>, files array<string>").repartition(len(jobs))
    return todo.mapInPandas(run, "_g int, strategy string, beta double, tau double, n_rows bigint, ause double")


def best_beta(history: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., strategy, beta, tau, ause): the least AUSE of each strategy, the smaller beta and tau among equals."""
    best = F.min_by(F.struct("beta", "tau", "ause"), F.struct("ause", "beta", "tau"))
    return history.groupBy(*keys, "strategy").agg(best.alias("b")).select(*keys, "strategy", "b.*")
