"""Queries of the calibration suite over the keypoint table, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from posegrain.functions import scalars as S
from posegrain.operators import calibration as C
from posegrain.operators import cohorts, mining
from posegrain.operators.prefix import quantiles
from posegrain.schema import MEASURES, TIERS, keypoints, packets, tier_dim, unrolled
from posegrain.session import materialize

QUERIES: dict = {}
SQL: dict[str, str] = {}

_NAN = ", ".join(f"case when isnan({c}) then null else {c} end as {c}" for c in MEASURES)
KP = f"""kp as (select run_id, image_id, experiment_name, lower(trim(dataset_name, ' \t\r\n')) as dataset_name, model_arch, pipeline_stage, kp_idx, keypoint, vis, n_components, {_NAN}
 from keypoint qualify row_number() over (partition by run_id, image_id, kp_idx order by loaded_at desc nulls last, load_id desc nulls last) = 1)"""
UN = KP + """, un as (select * replace (coalesce(n_components, case when wasserstein > 0 then 2 when wasserstein is not null then 1 end, case when kl_div > 0 then 2 when kl_div is not null then 1 end) as n_components)
 from kp where vis >= 0 and cov_det >= 0 and cov_det < 'infinity'::double)"""
PK = """pk as (select * replace (lower(trim(dataset, ' \t\r\n')) as dataset, lower(trim(model_name, ' \t\r\n')) as model_name,
 case when isnan(oks_base) then null else oks_base end as oks_base, case when isnan(oks_ours) then null else oks_ours end as oks_ours, case when isnan(delta_oks) then null else delta_oks end as delta_oks,
 case when isnan(nll) then null else nll end as nll, case when isnan(entropy) then null else entropy end as entropy, case when isnan(covariance_volume) then null else covariance_volume end as covariance_volume)
 from packet_metric qualify row_number() over (partition by packet_id order by loaded_at desc nulls last) = 1)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded (and -0.0 made 0.0), for comparison across engines."""
    return df.select(*((F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def rnd(e: str, digits: int = 6) -> str:
    return f"round({e}, {digits}) + 0.0::double"


@query(f"with {UN} select run_id, image_id, kp_idx, keypoint, vis, n_components, oks_ours, oks_base, cov_det, uniform_weight, base_score, heatmap_entropy from un")
def ref_unroll(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evaluable joints in long form."""
    return unrolled(spark, sf_dir).select("run_id", "image_id", "kp_idx", "keypoint", "vis", "n_components", "oks_ours", "oks_base", "cov_det", "uniform_weight", "base_score", "heatmap_entropy")


def _ause(rows: str, keys: str, clip: bool = False) -> str:
    end = ", ends as (select {k}, avg(err) filter (unc = lo) - min(err) as e from (select *, min(unc) over (partition by {k}) as lo from r) group by {k})".format(k=keys) if clip else ""
    area = "sum(case side when 'model' then ml else -ml end * case when m = 1 then 0 when i = 0 then 0.5::double else 1 end / greatest(m - 1, 1))"
    last = f"select {keys}, n_rows, {rnd('a' + (' + case when m > 1 then e * 0.5::double / (m - 1) else 0 end' if clip else ''))} as ause from (select {keys}, n_rows, m, {area} as a from pts group by {keys}, n_rows, m)" + (f" join ends using ({keys})" if clip else "")
    return f"""r as ({rows}), n as (select {keys}, count(*) as n_rows, sum(err) as tot, least(count(*), 100) as m from r group by {keys}),
 cum as (select 'model' as side, *, sum(n) over w - n as nb, sum(e) over w - e as eb from (select {keys}, unc as v, count(*) as n, sum(err) as e from r group by {keys}, unc) window w as (partition by {keys} order by v desc rows unbounded preceding)
 union all select 'oracle', *, sum(n) over w - n, sum(e) over w - e from (select {keys}, err as v, count(*) as n, sum(err) as e from r group by {keys}, err) window w as (partition by {keys} order by v desc rows unbounded preceding)),
 pts as (select *, (tot - eb - (k - nb) * (e / n)) / (n_rows - k) as ml from (select cum.*, n_rows, tot, m, i, floor(i * (1.0::double / greatest(m - 1, 1)) * n_rows)::bigint as k
  from cum join n using ({keys}) join range(0, 100) t(i) on i < greatest(m - 1, 1)) where k >= nb and k < nb + n){end}
 {last}"""


_GMM, _BASE = "(1 - exp(-0.1::double * cov_det))", "(1 - base_score)"
_PREDICTORS = [
    ("gmm_raw", "cov_det", "1 - oks_ours"),
    ("max_pooling", f"case when base_score is not null then greatest({_BASE}, {_GMM}) end", "1 - oks_ours"),
    ("gating", f"case when n_components = 2 then {_GMM} else {_BASE} end", "1 - oks_ours"),
    ("softmax", f"(exp({_BASE}) * {_BASE} + exp({_GMM}) * {_GMM}) / (exp({_BASE}) + exp({_GMM}))", "1 - oks_ours"),
    ("baseline_argmax", "-base_score", "1 - oks_base"),
    ("baseline_entropy", "heatmap_entropy", "1 - oks_base"),
]
_REG = "(select *, unnest(case n_components when 1 then ['all', 'k1'] when 2 then ['all', 'k2'] else ['all'] end) as regime from un)"


def _report_rows(source: str, keys: str) -> str:
    parts = " union all ".join(f"select {keys}, '{n}' as predictor, {u} as unc, {e} as err from {source} where vis > 0 and oks_ours is not null" for n, u, e in _PREDICTORS)
    return f"select * from ({parts}) where unc is not null and err is not null"


@query(f"with {UN}, {_ause(_report_rows(_REG, 'regime'), 'regime, predictor')}")
def ref_ause(spark, sf_dir):
    """Sparsification report: AUSE of six predictors, over all joints and by number of components."""
    return rounded(C.sparsification_report(C.regimes(unrolled(spark, sf_dir)), ["regime"]))


@query(f"with {UN}, {_ause(_report_rows(_REG, 'regime'), 'regime, predictor', clip=True)}")
def ref_ause_fast(spark, sf_dir):
    """The same with the last point kept instead of set to 0."""
    return rounded(C.sparsification_report(C.regimes(unrolled(spark, sf_dir)), ["regime"], last_point="clip"))


_MATRIX = "dataset_name in ('coco', 'crowdpose', 'ochuman')"


@query(f"with {UN}, {_ause(_report_rows('(select * from ' + _REG + ' where ' + _MATRIX + ')', 'dataset_name, regime'), 'dataset_name, regime, predictor')}")
def ref_sparsification_matrix(spark, sf_dir):
    """Datasets by component regimes."""
    return rounded(C.sparsification_report(C.regimes(unrolled(spark, sf_dir).where(_MATRIX)), ["dataset_name", "regime"]))


_CURVE = _ause("select 'all' as regime, cov_det as unc, 1 - oks_ours as err from un where vis > 0 and oks_ours is not null", "regime")


@query(f"with {UN}, {_CURVE.rsplit(chr(10), 1)[0]} select i, {rnd('max(ml) filter (side = ' + repr('model') + ')')} as model, {rnd('max(ml) filter (side = ' + repr('oracle') + ')')} as oracle from pts group by i")
def ref_sparsification_curve(spark, sf_dir):
    """The two curves themselves."""
    d = unrolled(spark, sf_dir).where("vis > 0 and oks_ours is not null").select(F.lit("all").alias("regime"), F.col("cov_det").alias("unc"), F.expr("1D - oks_ours").alias("err"))
    return rounded(C.sparsification(d, ["regime"]).select(F.col("i").cast("bigint"), "model", "oracle"))


def _bins(value: str, source: str, keys: str) -> str:
    edge = f"list_sort(list_distinct(list_transform(range(0, 11), lambda i: quantile_cont(u, i / 10.0::double))))"
    return f"""v as (select {keys}, {value} as u, 1 - oks_ours as err from {source} where vis > 0 and oks_ours is not null and {value} is not null),
 q as (select {keys}, list_sort(list_distinct(quantile_cont(u, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) as edges from v group by {keys}),
 b as (select {keys}, greatest(0, len(list_filter(edges, lambda x: x < u)) - 1)::int as bin, u, err from v join q using ({keys})),
 g as (select {keys}, bin, avg(u) as mean_unc, avg(err) as mean_err, count(*) as n from b group by all)"""


@query(f"with {UN}, {_bins('cov_det', _REG, 'regime')} select regime, bin, {rnd('mean_unc')} as mean_unc, {rnd('mean_err')} as mean_err, n from g")
def ref_ece_bins(spark, sf_dir):
    """Calibration bins of the volume."""
    d = C.regimes(unrolled(spark, sf_dir)).where("vis > 0 and oks_ours is not null").withColumn("err", F.expr("1D - oks_ours"))
    return rounded(C.quantile_bins(d, ["regime"], "cov_det", "err"))


@query(f"""with {UN}, {_bins('cov_det', _REG, 'regime')}, t as (select regime, max(mean_unc) as top from g group by regime)
 select regime, sum(n)::bigint as n, {rnd('sum(n * abs(mean_err - case when top > 0 then mean_unc / top else mean_unc end)) / sum(n)')} as ece from g join t using (regime) group by regime""")
def ref_ece(spark, sf_dir):
    """Expected calibration error by regime."""
    d = C.regimes(unrolled(spark, sf_dir)).where("vis > 0 and oks_ours is not null").withColumn("err", F.expr("1D - oks_ours"))
    return rounded(C.expected_calibration_error(C.quantile_bins(d, ["regime"], "cov_det", "err"), ["regime"]))


@query(f"""with {UN}, {_bins('ln(1 + cov_det)', "(select * from un where n_components = 1)", 'dataset_name')}
 select dataset_name, bin, {rnd('mean_unc', 9)} as mean_unc, {rnd('mean_err', 9)} as mean_err, n from g where dataset_name in (select dataset_name from v group by 1 having count(*) >= 10)""")
def ref_ece_curve(spark, sf_dir):
    """Calibration curves of the log volume, one component, by dataset; datasets with fewer rows than bins are left out."""
    d = unrolled(spark, sf_dir).where("vis > 0 and oks_ours is not null and n_components = 1 and dataset_name is not null").select("dataset_name", S.log_volume(F.col("cov_det")).alias("u"), F.expr("1D - oks_ours").alias("err"))
    enough = d.groupBy("dataset_name").agg(F.count(F.lit(1)).alias("n")).where("n >= 10").select("dataset_name")
    return rounded(C.quantile_bins(d.join(enough, "dataset_name", "left_semi"), ["dataset_name"], "u", "err"), 9)


@query(f"""with {UN}, v as (select regime, cov_det as x, 1 - oks_ours as y from {_REG} where vis > 0 and oks_ours is not null),
 r as (select regime, rank() over (partition by regime order by x) + (count(*) over (partition by regime, x) - 1) / 2.0::double as rx, rank() over (partition by regime order by y) + (count(*) over (partition by regime, y) - 1) / 2.0::double as ry from v)
 select regime, count(*) as n, {rnd('corr(rx, ry)')} as spearman from r group by regime""")
def ref_spearman(spark, sf_dir):
    """Rank correlation of volume and error."""
    return rounded(C.spearman(C.regimes(unrolled(spark, sf_dir)).where("vis > 0 and oks_ours is not null").withColumn("err", F.expr("1D - oks_ours")), ["regime"], "cov_det", "err"))


_SCORES = [("cov_det", "cov_det"), ("uniform_weight", "uniform_weight"), ("heatmap_entropy", "heatmap_entropy"), ("inv_base_score", "1 - base_score")]


def _auroc(source: str, keys: str) -> str:
    rows = " union all ".join(f"select {keys}, '{n}' as predictor, {e} as s, vis = 0 as a from {source}" for n, e in _SCORES)
    return f"""v as (select * from ({rows}) where s is not null),
 r as (select *, rank() over (partition by {keys}, predictor order by s) + (count(*) over (partition by {keys}, predictor, s) - 1) / 2.0::double as k from v),
 c as (select {keys}, predictor, count(*) filter (a) as p, count(*) filter (not a) as n, sum(k) filter (a) as rs from r group by {keys}, predictor)
 select {keys}, predictor, p, n, coalesce((2 * rs - p * (p + 1))::bigint, 0) as u2, case when p > 0 and n > 0 then {rnd('(rs - p * (p + 1) / 2.0::double) / (p * n)')} end as auroc from c"""


def _absence(df: DataFrame, keys: list[str]) -> DataFrame:
    return rounded(C.absence_auroc(df, keys))


@query(f"with {UN}, {_auroc(_REG, 'regime')}")
def ref_absence_auroc(spark, sf_dir):
    """How well four scores tell absent joints from present ones, by regime."""
    return _absence(C.regimes(unrolled(spark, sf_dir)), ["regime"])


@query(f"with {UN}, {_auroc('un', 'experiment_name')}")
def ref_absence_by_tier(spark, sf_dir):
    """The same by resolution tier."""
    return _absence(unrolled(spark, sf_dir), ["experiment_name"])


@query(f"with {UN}, {_auroc('(select * from ' + _REG + ' where ' + _MATRIX + ')', 'dataset_name, regime')}")
def ref_roc_matrix(spark, sf_dir):
    """Datasets by component regimes."""
    return _absence(C.regimes(unrolled(spark, sf_dir).where(_MATRIX)), ["dataset_name", "regime"])


_SWAP = "case when oks_ours is not null then oks_base - oks_ours > 0.02::double end"


@query(f"""with {UN}, v as (select cov_det as s, {_SWAP} as y from un where oks_ours is not null and oks_base is not null),
 t as (select unnest(range(0, 100)) as i, unnest(quantile_cont(s, list_transform(range(0, 100), lambda i: (i / 99.0::double)))) as v from v)
 select i::int as i, {rnd('(select count(*) from v where y and s >= t.v) / (select count(*) from v where y)')} as tpr, {rnd('(select count(*) from v where not y and s >= t.v) / (select count(*) from v where not y)')} as fpr from t""")
def ref_threshold_roc(spark, sf_dir):
    """ROC points at 100 percentiles of the volume, for joints that got worse."""
    d = unrolled(spark, sf_dir).where("oks_ours is not null and oks_base is not null").withColumn("worse", F.expr("oks_base - oks_ours > 0.02D"))
    return rounded(C.threshold_roc(d, "cov_det", "worse"))


SQL["ref_threshold_roc"] = SQL["ref_threshold_roc"].replace("quantile_cont(s, list_transform(range(0, 100), lambda i: (i / 99.0::double)))", "quantile_cont(s, [" + ", ".join(repr(i / 99) + "::double" for i in range(100)) + "])")


@query(f"""with {UN}, v as (select vis = 0 as absent, ln(1 + cov_det) as x from un),
 s as (select absent, stddev_samp(x) * pow(count(*), -0.2::double) as h, count(*) as n from v group by absent)
 select absent, j::int as j, {rnd('j * (8.0::double / 49)')} as x, {rnd('sum(exp(-0.5::double * pow((j * (8.0::double / 49) - x) / h, 2))) / (any_value(n) * any_value(h) * 2.5066282746310002::double)')} as density
 from v join s using (absent), range(0, 50) t(j) group by absent, j""")
def ref_density(spark, sf_dir):
    """Kernel densities of the log volume of absent and present joints."""
    d = unrolled(spark, sf_dir).select(F.expr("vis = 0").alias("absent"), F.log1p("cov_det").alias("x"))
    return rounded(C.density(d, ["absent"], "x", 0.0, 8.0))


_SUM = "count({v}) as n, " + rnd("avg({v})") + " as mean, " + rnd("coalesce(stddev_samp({v}), 0)") + " as std, min({v}) as min, " + ", ".join(rnd(f"quantile_cont({{v}}, {p})") + f" as {n}" for p, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))) + ", max({v}) as max"


@query(f"with {UN} select experiment_name, {_SUM.format(v='uniform_weight')} from un where uniform_weight >= 0 group by 1")
def ref_tier_summary(spark, sf_dir):
    """Uniform weight by tier."""
    return rounded(C.summary(unrolled(spark, sf_dir).where("uniform_weight >= 0"), ["experiment_name"], "uniform_weight"))


@query(f"""with {UN}, u as (select * from un where uniform_weight >= 0 and experiment_name in ({', '.join(repr(t) for t, _ in TIERS)})),
 s as (select experiment_name, {_SUM.format(v='uniform_weight')} from u group by 1),
 e as (select experiment_name, quantile_cont(uniform_weight, 0.25) as a, quantile_cont(uniform_weight, 0.75) as b from u group by 1),
 f as (select experiment_name, count(*) as n_fliers from u join e using (experiment_name) where uniform_weight < a - 1.5::double * (b - a) or uniform_weight > b + 1.5::double * (b - a) group by 1)
 select s.*, coalesce(n_fliers, 0) as n_fliers from s left join f using (experiment_name)""")
def ref_boxplot(spark, sf_dir):
    """Five numbers and fliers of the uniform weight by tier."""
    d = unrolled(spark, sf_dir).where(F.col("experiment_name").isin([t for t, _ in TIERS])).where("uniform_weight >= 0")
    return rounded(C.boxplot(d, ["experiment_name"], "uniform_weight"))


_BETAS = [10.0 ** (-3 + 5 * i / 9) for i in range(10)]
_TAUS = [0.01, 0.05, 0.1, 0.2, 0.5]


def _grid_rows() -> str:
    betas = ", ".join(f"{b!r}::double" for b in _BETAS)
    base = f"select 'all' as scope, 1 - oks_ours as err, n_components as k, 1 - base_score as ub, 1 - exp(-beta * cov_det) as ug, beta from un, (select unnest([{betas}]) as beta) where vis > 0 and oks_ours is not null and base_score is not null"
    rows = [("'max_pooling'", "-1", "greatest(ub, ug)"), ("'gating_k'", "-1", "case when k = 2 then ug else ub end"), ("'softmax'", "-1", "(exp(ub) * ub + exp(ug) * ug) / (exp(ub) + exp(ug))")]
    rows += [("'gating_tau'", repr(t), f"case when k = 2 or ug > {t!r}::double then ug else ub end") for t in _TAUS]
    return " union all ".join(f"select scope, {s} as strategy, beta, {t}::double as tau, {u} as unc, err from ({base})" for s, t, u in rows)


@query(f"with {UN}, h as (with {_ause(_grid_rows(), 'scope, strategy, beta, tau', clip=True)}) select scope, strategy, round(beta, 9) as beta, nullif(tau, -1) as tau, n_rows, ause from h")
def ref_beta_history(spark, sf_dir):
    """AUSE of every strategy on a grid of 10 betas."""
    h = C.beta_search(unrolled(spark, sf_dir).withColumn("scope", F.lit("all")), ["scope"], _BETAS, _TAUS)
    return h.select("scope", "strategy", F.round("beta", 9).alias("beta"), "tau", "n_rows", (F.round("ause", 6) + F.lit(0.0)).alias("ause"))


@query()
def ref_beta_search(spark, sf_dir):
    """The best beta of each strategy on the whole grid of 300, over all, visible and occluded joints, with the gain over the baseline."""
    d = unrolled(spark, sf_dir).where("vis > 0").select("vis", "oks_ours", "oks_base", "cov_det", "base_score", "n_components")
    d = materialize(d, "present-joints")  # read twice
    scopes = F.array_compact(F.array(F.lit("all"), F.when(F.col("vis") == 2, "visible"), F.when(F.col("vis") == 1, "occluded")))
    d = d.select("*", F.explode(scopes).alias("scope"))
    best = C.best_beta(C.beta_search(d, ["scope"], C.beta_grid(), _TAUS), ["scope"])
    base = C.ause(d.where("vis > 0 and oks_base is not null").selectExpr("scope", "1D - oks_base as err", "1D - base_score as unc"), ["scope"], last_point="clip").select("scope", F.col("ause").alias("ause_base"))
    return rounded(best.join(base, "scope").withColumn("improvement", F.expr("(ause_base - ause) / ause_base")))


@query()
def ref_full_evaluation(spark, sf_dir):
    """Tidy report (subset, metric, value): every metric over all, visible, occluded and absent joints."""
    d = unrolled(spark, sf_dir)
    tags = F.array_compact(F.array(F.lit("all"), F.when(F.col("vis") == 2, "visible"), F.when(F.col("vis") == 1, "occluded"), F.when(F.col("vis") > 0, "present")))
    d = d.select("*", F.explode(tags).alias("subset")).withColumn("err", F.expr("1D - oks_ours"))
    seen = d.where("vis > 0 and oks_ours is not null")
    a = C.sparsification_report(seen, ["subset"], beta=0.1).select("subset", F.concat(F.lit("ause_"), "predictor").alias("metric"), F.col("ause").alias("value"))
    e = C.expected_calibration_error(C.quantile_bins(seen, ["subset"], "cov_det", "err"), ["subset"]).select("subset", F.lit("ece").alias("metric"), F.col("ece").alias("value"))
    s = C.spearman(seen, ["subset"], "cov_det", "err").select("subset", F.lit("spearman").alias("metric"), F.col("spearman").alias("value"))
    o = C.absence_auroc(d.where("subset = 'all'"), ["subset"]).select("subset", F.concat(F.lit("auroc_"), "predictor").alias("metric"), F.col("auroc").alias("value"))
    return rounded(a.unionByName(e).unionByName(s).unionByName(o))


@query(f"""with {KP}, t as (select * from (values {', '.join(f"({i}, '{n}', {s}::double)" for i, (n, s) in enumerate(TIERS))}) as t(tier, experiment_name, scale))
 select tier, scale, count(oks_ours) as n, {rnd('avg(oks_base)')} as oks_base, {rnd('avg(oks_ours)')} as oks_ours from t left join kp using (experiment_name) group by tier, scale""")
def ref_tier_means(spark, sf_dir):
    """Mean similarity by tier, all tiers kept."""
    t = F.broadcast(tier_dim(spark))  # 5 rows
    d = keypoints(spark, sf_dir).select("experiment_name", "oks_base", "oks_ours")
    got = d.groupBy("experiment_name").agg(F.count("oks_ours").alias("n"), F.avg("oks_base").alias("oks_base"), F.avg("oks_ours").alias("oks_ours"))
    return rounded(t.join(got, "experiment_name", "left").select("tier", "scale", F.coalesce("n", F.lit(0)).alias("n"), "oks_base", "oks_ours"))


@query(f"""with {UN} select run_id, image_id, kp_idx, {rnd('1 - exp(-0.012::double * cov_det)')} as u_gmm, {rnd('case when base_score is not null then greatest(1 - base_score, 1 - exp(-0.012::double * cov_det)) end')} as u_max,
 {rnd('case when n_components = 2 or 1 - exp(-0.012::double * cov_det) > 0.5::double then 1 - exp(-0.012::double * cov_det) else 1 - base_score end')} as u_gate,
 {rnd('(exp(1 - base_score) * (1 - base_score) + exp(1 - exp(-0.012::double * cov_det)) * (1 - exp(-0.012::double * cov_det))) / (exp(1 - base_score) + exp(1 - exp(-0.012::double * cov_det)))')} as u_soft, {rnd('ln(1 + cov_det)')} as log_volume from un""")
def ref_fusion(spark, sf_dir):
    """All fusions of the two uncertainties of a joint."""
    g, b = S.u_gmm(F.col("cov_det"), 0.012), 1.0 - F.col("base_score")
    return rounded(unrolled(spark, sf_dir).select("run_id", "image_id", "kp_idx", g.alias("u_gmm"), S.fuse_max(b, g).alias("u_max"), S.fuse_gate(b, g, F.col("n_components"), 0.5).alias("u_gate"), S.fuse_softmax(b, g).alias("u_soft"), S.log_volume(F.col("cov_det")).alias("log_volume")))


_SOFT_GRID = "(exp(ub) * ub + exp(1 - exp(-0.1::double * det)) * (1 - exp(-0.1::double * det))) / (exp(ub) + exp(1 - exp(-0.1::double * det)))"


@query(f"select i, j, {rnd(_SOFT_GRID)} as u_soft from (select i, j, i * (1.0::double / 99) as ub, j * (50.0::double / 99) as det from range(0, 100) a(i), range(0, 100) b(j))")
def ref_fusion_grid(spark, sf_dir):
    """The softmax fusion over a grid of both inputs (100 x 100 by definition)."""
    g = spark.range(10_000).select((F.col("id") / 100).cast("bigint").alias("i"), (F.col("id") % 100).alias("j"))
    return rounded(g.select("i", "j", S.fuse_softmax(F.col("i") * (1.0 / 99), S.u_gmm(F.col("j") * (50.0 / 99), 0.1)).alias("u_soft")))


# ---- cohorts and run reports over packets


@query(f"""with {PK}, q as (select quantile_cont(covariance_volume, 0.9) as q from pk),
 a as (select count(*) as total, count(*) filter (oks_ours > oks_base + 0.1::double) as wins, count(*) filter (oks_base > oks_ours + 0.1::double) as regressions, count(*) filter (covariance_volume > q) as high_uncertainty, count(*) filter (oks_base < 0.5 and oks_ours < 0.5) as edge_cases from pk, q)
 select cohort, n, {rnd('n * 100.0::double / total')} as pct from (select total, unnest(['wins', 'regressions', 'high_uncertainty', 'edge_cases']) as cohort, unnest([wins, regressions, high_uncertainty, edge_cases]) as n from a)""")
def ref_cohorts(spark, sf_dir):
    """Sizes of the four overlapping cohorts."""
    return rounded(cohorts.cohort_counts(packets(spark, sf_dir)))


@query()
def ref_focus_groups(spark, sf_dir):
    """Disjoint focus groups of up to 50 packets."""
    return cohorts.focus_groups(packets(spark, sf_dir), "packet_id")


_DELTA = "select run_id, image_id, kp_idx, keypoint, oks_ours - oks_base as d from kp where oks_ours is not null and oks_base is not null"


@query(f"""with {KP}, d as ({_DELTA}), hi as (select * from d qualify row_number() over (partition by run_id, image_id order by d desc, kp_idx) = 1), lo as (select * from d qualify row_number() over (partition by run_id, image_id order by d, kp_idx) = 1)
 (select 'Top_Single_KP_Gains' as group_name, run_id, image_id, keypoint, {rnd('d')} as delta from hi order by d desc, run_id, image_id limit 50) union all (select 'Worst_Single_KP_Drops', run_id, image_id, keypoint, {rnd('d')} from lo order by d, run_id, image_id limit 50)""")
def ref_keypoint_outliers(spark, sf_dir):
    """Images with the largest gain and drop at one joint (top 50 of each is the feature)."""
    return rounded(cohorts.keypoint_outliers(keypoints(spark, sf_dir), ["run_id", "image_id"]))


_RUN = ["oks_base", "oks_ours", "delta_oks", "nll", "entropy", "covariance_volume"]


@query(f"with {PK} select model_name, count(*) as n_images, " + ", ".join(f"{rnd(f'avg({c})')} as {c}_mean, {rnd(f'stddev_samp({c})')} as {c}_std" for c in _RUN) + f", {rnd('count(*) filter (delta_oks > 0) * 100.0::double / count(*)')} as pct_wins, {rnd('count(*) filter (delta_oks < 0) * 100.0::double / count(*)')} as pct_regressions, {rnd('count(*) filter (delta_oks = 0) * 100.0::double / count(*)')} as pct_ties from pk group by 1")
def ref_run_report(spark, sf_dir):
    """Means, deviations and shares of wins, regressions and ties by model."""
    return rounded(cohorts.run_report(packets(spark, sf_dir), ["model_name"], _RUN))


@query(f"with {PK} select model_name, metric, count(*) as n, {rnd('median(value)')} as median from (unpivot pk on " + ", ".join(_RUN) + " into name metric value value) where value is not null group by all")
def ref_run_medians(spark, sf_dir):
    """Medians by model."""
    return rounded(cohorts.run_medians(packets(spark, sf_dir), ["model_name"], _RUN))


@query(f"""with {PK} select dataset, model_name, count(*) as n_images, {rnd('avg(oks_ours)', 12)} as oks_ours_mean, {rnd('avg(oks_base)', 12)} as oks_base_mean, {rnd('avg(oks_ours) - avg(oks_base)', 12)} as delta_oks_mean, {rnd('(avg(oks_ours) - avg(oks_base)) / nullif(avg(oks_base), 0) * 100', 9)} as proportional_gain,
 rank() over (order by round(avg(oks_ours), 9) desc nulls last) as place from pk group by dataset, model_name""")
def ref_leaderboard(spark, sf_dir):
    """Experiments (dataset and model) by mean similarity."""
    from pyspark.sql import Window

    g = packets(spark, sf_dir).groupBy("dataset", "model_name").agg(F.count(F.lit(1)).alias("n_images"), F.avg("oks_ours").alias("oks_ours_mean"), F.avg("oks_base").alias("oks_base_mean"))
    g = g.withColumn("delta_oks_mean", F.expr("oks_ours_mean - oks_base_mean")).withColumn("proportional_gain", F.expr("delta_oks_mean / nullif(oks_base_mean, 0D) * 100"))
    g = g.withColumn("proportional_gain", F.round("proportional_gain", 9))
    return rounded(g.withColumn("place", F.rank().over(Window.orderBy(F.round("oks_ours_mean", 9).desc_nulls_last())).cast("bigint")), 12)


_ABL = ["oks_base", "oks_ours", "delta_oks", "entropy"]


@query(f"with {PK} select metric, count(v) as n, {rnd('avg(v)')} as mean, {rnd('stddev_samp(v)')} as std, {rnd('median(v)')} as median, {rnd('quantile_cont(v, 0.75) - quantile_cont(v, 0.25)')} as iqr, {rnd('min(v)')} as min, {rnd('max(v)')} as max from (" + " union all ".join(f"select '{c}' as metric, {c} as v from pk where {c} is not null" for c in _ABL) + ") group by metric")
def ref_ablation_table(spark, sf_dir):
    """One line a metric."""
    return rounded(cohorts.ablation_table(packets(spark, sf_dir), _ABL))


@query(f"with {KP} select keypoint, count(*) as n, {rnd('avg(oks_ours)')} as oks_ours, {rnd('avg(oks_base)')} as oks_base, {rnd('avg(heatmap_entropy)')} as entropy from kp group by 1")
def ref_keypoint_summary(spark, sf_dir):
    """Means by joint."""
    return rounded(keypoints(spark, sf_dir).groupBy("keypoint").agg(F.count(F.lit(1)).alias("n"), F.avg("oks_ours").alias("oks_ours"), F.avg("oks_base").alias("oks_base"), F.avg("heatmap_entropy").alias("entropy")))


@query(f"with {PK}, d as (select packet_id, delta_oks from pk where delta_oks is not null) (select 'win' as kind, * from d order by delta_oks desc, packet_id limit 5) union all (select 'regression', * from d order by delta_oks, packet_id limit 5)")
def ref_top_deltas(spark, sf_dir):
    """The five best and worst packets."""
    d = packets(spark, sf_dir).where("delta_oks is not null").select("packet_id", "delta_oks")
    return d.orderBy(F.col("delta_oks").desc(), "packet_id").limit(5).select(F.lit("win").alias("kind"), "*").unionByName(d.orderBy("delta_oks", "packet_id").limit(5).select(F.lit("regression").alias("kind"), "*"))


@query(f"""with {PK} select packet_id, case when oks_ours is null then null when oks_ours > oks_base + 0.1::double then 'Denoised' when oks_ours < 0.3 then 'Failure' when oks_ours > 0.8 and entropy < 2.0 then 'Robust'
 when entropy > 3.0 and n > 1 then 'Ambiguous' when entropy < 1.5 and oks_ours < 0.5 then 'Overconfident' when entropy > 2.5 and oks_ours < 0.6 then 'Honest_Uncertainty' else 'Robust' end as mode from (select *, case when covariance_volume > 2 then 2 else 1 end as n from pk)""")
def ref_failure_modes(spark, sf_dir):
    """Failure mode of every packet."""
    return packets(spark, sf_dir).select("packet_id", S.failure_mode(F.col("oks_ours"), F.col("entropy"), F.when(F.col("covariance_volume") > 2, 2).otherwise(1), F.col("oks_base")).alias("mode"))


# ---- mining


@query(f"""with {KP}, b as (select run_id, image_id, kp_idx as focus_kp, oks_ours - oks_base as kp_delta, oks_base as kp_oks_base, oks_ours as kp_oks_ours, keypoint from kp
  where kp_idx between 5 and 16 and oks_ours is not null and oks_base is not null qualify row_number() over (partition by run_id, image_id order by oks_ours - oks_base desc, kp_idx) = 1)
 select run_id, image_id, focus_kp, {rnd('kp_delta')} as kp_delta, kp_oks_base, kp_oks_ours, upper(keypoint[1]) || '_' || upper(split_part(keypoint, '_', 2)[1]) || split_part(keypoint, '_', 2)[2:] || ' (kp=' || focus_kp || ')' as swapped_joint from b""")
def ref_best_swapped(spark, sf_dir):
    """The limb joint of each image that gained most."""
    return rounded(mining.best_swapped_joint(keypoints(spark, sf_dir), ["run_id", "image_id"]))


@query(SQL["ref_best_swapped"] + " where kp_delta >= 0.03 and kp_oks_ours >= 0.8 and regexp_matches(keypoint, 'ankle|wrist|elbow')")
def ref_distal_swaps(spark, sf_dir):
    """Those at ankles, wrists and elbows with a clear gain."""
    return rounded(mining.best_swapped_joint(keypoints(spark, sf_dir), ["run_id", "image_id"]).where("kp_delta >= 0.03D and kp_oks_ours >= 0.8D and swapped_joint rlike 'Ankle|Wrist|Elbow'"))


_ON = ["image_id", "dataset_name", "model_arch", "experiment_name"]
_STAGES = f"""m as (select a.image_id, a.dataset_name, a.model_arch, a.experiment_name, a.kp_idx, a.oks_ours as oks_first, b.oks_ours as oks_second
 from (select * from kp where pipeline_stage = 'tta' qualify row_number() over (partition by {', '.join(_ON)}, kp_idx order by run_id desc) = 1) a
 join (select * from kp where pipeline_stage = 'mrf' qualify row_number() over (partition by {', '.join(_ON)}, kp_idx order by run_id desc) = 1) b using (image_id, dataset_name, model_arch, experiment_name, kp_idx))"""


@query(f"with {KP}, {_STAGES} select * from m")
def ref_stage_merge(spark, sf_dir):
    """Joints that two pipeline stages share."""
    return mining.merge_stages(keypoints(spark, sf_dir), _ON, "tta", "mrf")


_BONES = ", ".join(f"({p}, {c})" for p, c in mining.LIMB_BONES)


def _bone_sql(side: str, rule: str) -> str:
    return f"""with {KP}, {_STAGES}, e as (select * from (values {_BONES}) as e(parent, focus_kp))
 select k.image_id, k.dataset_name, k.model_arch, k.experiment_name, e.parent, e.focus_kp, k.oks_first as before, k.oks_second as after, p.oks_{side} as parent_oks, {rnd('k.oks_second - k.oks_first')} as delta
 from m k join e on k.kp_idx = e.focus_kp join m p on p.kp_idx = e.parent and p.image_id = k.image_id and p.dataset_name = k.dataset_name and p.model_arch = k.model_arch and p.experiment_name = k.experiment_name where {rule}"""


@query(_bone_sql("second", "p.oks_second >= 0.5 and k.oks_first <= 0.95 and k.oks_second >= 0.5 and k.oks_second - k.oks_first >= 0.01"))
def ref_bone_rescues(spark, sf_dir):
    """Bones whose child joint the second stage improved (thresholds lowered to what the data has)."""
    return rounded(mining.bone_changes(mining.merge_stages(keypoints(spark, sf_dir), _ON, "tta", "mrf"), _ON, True, 0.5, 0.95, 0.5, 0.01))


@query(_bone_sql("first", "p.oks_first >= 0.5 and k.oks_first >= 0.5 and k.oks_second <= 0.95 and k.oks_second - k.oks_first <= -0.01"))
def ref_bone_failures(spark, sf_dir):
    """Bones whose child joint the second stage made worse."""
    return rounded(mining.bone_changes(mining.merge_stages(keypoints(spark, sf_dir), _ON, "tta", "mrf"), _ON, False, 0.5, 0.5, 0.95, 0.01))


@query(f"""with {KP}, f as (select * from (values {', '.join(f'({a}, {b}), ({b}, {a})' for a, b in ((5, 6), (7, 8), (9, 10), (11, 12), (13, 14), (15, 16)))}) as f(kp_idx, flip_idx))
 select k.run_id, k.image_id, k.kp_idx as focus_kp, coalesce(o.vis, 1) = 0 as both_absent, case when coalesce(o.vis, 1) = 0 then 'Both Sides Absent' else 'Absent (vis=0)' end as status, k.base_score as conf, k.cov_det
 from kp k join f using (kp_idx) left join kp o on o.run_id = k.run_id and o.image_id = k.image_id and o.kp_idx = f.flip_idx where k.vis = 0 and k.base_score >= 0.45 and k.cov_det >= 1.0 and k.cov_det < 'infinity'::double""")
def ref_phantom_joints(spark, sf_dir):
    """Absent joints that the baseline was sure of."""
    from posegrain.schema import joint_dim

    return mining.phantom_joints(keypoints(spark, sf_dir), joint_dim(spark), ["run_id", "image_id"]).where("cov_det < double('Infinity')")


@query(f"with {KP} select run_id, image_id, list_sort(list(kp_idx) filter (vis = 0)) as absent, list_sort(list(kp_idx) filter (vis = 1)) as occluded, list_sort(list(kp_idx) filter (vis = 2)) as visible from kp group by 1, 2")
def _visibility_lists(spark, sf_dir):
    return mining.visibility_slices(keypoints(spark, sf_dir), ["run_id", "image_id"])


del QUERIES["_visibility_lists"], SQL["_visibility_lists"]


@query(f"with {KP} select run_id, image_id, coalesce(string_agg(kp_idx, ',' order by kp_idx) filter (vis = 0), '') as absent, coalesce(string_agg(kp_idx, ',' order by kp_idx) filter (vis = 1), '') as occluded, coalesce(string_agg(kp_idx, ',' order by kp_idx) filter (vis = 2), '') as visible from kp group by 1, 2")
def ref_visibility_slices(spark, sf_dir):
    """Joint indices of each image by visibility, as text."""
    d = _visibility_lists(spark, sf_dir)
    return d.select("run_id", "image_id", *(F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("absent", "occluded", "visible")))


@query(f"""with {KP} select run_id, image_id, case when max((pipeline_stage = 'mrf')::int) = 1 then 'tta_mrf' when max((pipeline_stage = 'tta')::int) = 1 then 'tta' else 'basic' end as mode from kp group by 1, 2""")
def ref_pipeline_mode(spark, sf_dir):
    """How each image of a run was made."""
    d = keypoints(spark, sf_dir).groupBy("run_id", "image_id").agg(F.coalesce(F.bool_or(F.expr("pipeline_stage = 'mrf'")), F.lit(False)).alias("g"), F.coalesce(F.max(F.expr("if(pipeline_stage = 'tta', 2, 1)")), F.lit(1)).alias("n"))
    return d.select("run_id", "image_id", mining.pipeline_mode(F.col("g"), F.col("n")).alias("mode"))


@query(f"with {PK} select p.packet_id, p.oks_ours from pk p where p.image_id in (select image_id from packet_raw r join packet_metric m using (packet_id) where m.image_id is not null)")
def ref_target_ids(spark, sf_dir):
    """Packets of the images that have a nested packet: processing restricted to listed ids by a semi join."""
    from posegrain.session import table

    ids = table(spark, sf_dir, "packet_metric").join(table(spark, sf_dir, "packet_raw").select("packet_id"), "packet_id", "left_semi").select("image_id")
    return packets(spark, sf_dir).join(ids, "image_id", "left_semi").select("packet_id", "oks_ours")


@query(f"with {PK} select dataset, count(*) as n, {rnd('avg(oks_ours)')} as oks_ours from pk where starts_with(dataset, 'coco') or dataset in ('ochuman', 'crowdpose') group by 1")
def ref_subset_select(spark, sf_dir):
    """Experiments picked by prefix or name."""
    d = packets(spark, sf_dir).where(F.col("dataset").startswith("coco") | F.col("dataset").isin("ochuman", "crowdpose"))
    return rounded(d.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.avg("oks_ours").alias("oks_ours")))


@query(f"with {PK}, w as (select packet_id, oks_ours, delta_oks from pk where oks_ours >= 0.7 and delta_oks is not null order by delta_oks desc, packet_id limit 5) select 'wins' as query, row_number() over (order by delta_oks desc, packet_id)::int as place, packet_id from w union all select 'regressions', row_number() over (order by delta_oks, packet_id)::int, packet_id from (select packet_id, delta_oks from pk where delta_oks is not null order by delta_oks, packet_id limit 5)")
def ref_catalog(spark, sf_dir):
    """First rows of several mining queries as one catalogue of JSON records (here their packet ids)."""
    p = packets(spark, sf_dir).where("delta_oks is not null").select("packet_id", "oks_ours", "delta_oks")
    c = mining.catalog({"wins": (p.where("oks_ours >= 0.7D"), [F.col("delta_oks").desc(), F.col("packet_id").asc()]), "regressions": (p, [F.col("delta_oks").asc(), F.col("packet_id").asc()])}, 5)
    return c.select("query", "place", F.get_json_object("record", "$.packet_id").cast("bigint").alias("packet_id"))


@query()
def ref_focus_joint(spark, sf_dir):
    """The joint of each image that a figure would zoom on."""
    k = keypoints(spark, sf_dir)
    two = k.where("n_components = 2").groupBy("run_id", "image_id").agg(F.min("kp_idx").alias("first_bimodal"))
    return mining.focus_joint("auto", k, ["run_id", "image_id"], two)


SQL["ref_focus_joint"] = f"""with {KP}, b as (select run_id, image_id, min(kp_idx) filter (n_components = 2) as f from kp group by 1, 2),
 g as (select run_id, image_id, kp_idx from kp where oks_ours is not null and oks_base is not null qualify row_number() over (partition by run_id, image_id order by oks_ours - oks_base desc, kp_idx) = 1)
 select run_id, image_id, coalesce(f, kp_idx, 9)::int as focus_kp from b left join g using (run_id, image_id)"""


@query(f"""select event_type as stage, count(*) as n, {rnd('avg(value)')} as mean, {rnd('stddev_pop(value)')} as std, {rnd('min(value)')} as min, {rnd('max(value)')} as max from events where value is not null group by 1""")
def ref_stage_costs(spark, sf_dir):
    """Times of stages (event types stand for stages, values for milliseconds)."""
    from posegrain.session import table

    return rounded(mining.stage_costs(table(spark, sf_dir, "events").where("value is not null").select(F.col("event_type").alias("stage"), F.col("value").alias("ms"))))
