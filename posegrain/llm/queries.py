"""Queries of the operators for language-model training data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from posegrain.llm import leakage, mixing, percentiles, skeleton, topn
from posegrain.operators.nested import latest_delivery
from posegrain.session import materialize, table

PERCENTILES = [0.05, 0.25, 0.5, 0.75, 0.95]
_MEASURES = ["oks_ours", "cov_det"]


def _label(name: str):
    """Labels compare without case and outer blanks."""
    return F.lower(F.btrim(F.col(name), F.lit(" \t\r\n")))


def _keypoint_values(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    groups = {"dataset_name": _label("dataset_name"), "model_arch": _label("model_arch")} | {m: F.col(m) for m in more}
    return percentiles.long_values(table(spark, sf_dir, "keypoint"), groups, _MEASURES)


def p1_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of both measures per dataset and model, over everything, per load and per day of evaluation; rows as
    delivered; exact (max_error 0)."""
    k = table(spark, sf_dir, "keypoint")
    day = F.expr("cast(date_add(date'1970-01-01', cast(floor(unix_micros(evaluated_at) / 86400000000) as int)) as string)")
    levels = F.array(F.struct(F.lit("all").alias("level"), F.lit("").alias("period")), F.struct(F.lit("load").alias("level"), F.col("load_id").cast("string").alias("period")), F.struct(F.lit("day").alias("level"), day.alias("period")))
    k = k.select("dataset_name", "model_arch", *_MEASURES, F.inline(levels))
    groups = {"dataset_name": _label("dataset_name"), "model_arch": _label("model_arch"), "level": F.col("level"), "period": F.col("period")}
    return percentiles.percentiles([percentiles.long_values(k, groups, _MEASURES)], [*groups, "column_name"], PERCENTILES)


def p1_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The percentiles over everything, with even and odd loads counted apart and their counts added."""
    v = _keypoint_values(spark, sf_dir, "load_id")
    parts = [v.where("load_id is null or pmod(load_id, 2) = 0").drop("load_id"), v.where("pmod(load_id, 2) = 1").drop("load_id")]
    return percentiles.percentiles(parts, ["dataset_name", "model_arch", "column_name"], PERCENTILES)


def _top_packets(spark: SparkSession, sf_dir: str, payload: list[str]) -> DataFrame:
    columns = ["packet_id", "image_id", "delta_oks", "loaded_at", "dataset", "model_name", *payload]
    d = latest_delivery(table(spark, sf_dir, "packet_metric").select(*columns), tie="image_id")
    d = d.withColumn("dataset", _label("dataset")).withColumn("model_name", _label("model_name"))
    return topn.top_n(d, ["dataset", "model_name"], "delta_oks", ["image_id", "packet_id"], 3, payload)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 3 best packets of each dataset and model."""
    return _top_packets(spark, sf_dir, []).select("packet_id")


def p3_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with their groups, scores and ranks."""
    return _top_packets(spark, sf_dir, ["sample_type"])


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items and the documents that hold 12 consecutive words of them, or all words of a shorter item."""
    found = leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_item"), shingle=5, radius=3)
    return found.where("in_order").select("item_id", "doc_id")


def p7_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items and the documents that hold passages of them word for word or with about one word in ten exchanged, dropped or
    put in, with the number of windows found."""
    return leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_item"))


def _mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[dict]]:
    counted = materialize(mixing.count_tokens(table(spark, sf_dir, "documents"), "doc_id", "text", ["source"]), "token-counts")
    sizes = counted.groupBy("source").agg(F.sum("n_tokens").alias("tokens"))
    plans = mixing.plan(spark, sizes, table(spark, sf_dir, "mix_target"))
    return mixing.draw(spark, counted, plans), plans


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every drawn document of every mix, with its place in the interleaved order."""
    return _mix(spark, sf_dir)[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached share of each source of each mix."""
    drawn, plans = _mix(spark, sf_dir)
    return mixing.shares(drawn, spark, plans)


def _prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skeleton.fingerprints(table(spark, sf_dir, "documents"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that differ as stored and look the same."""
    return skeleton.same_look_pairs(materialize(_prints(spark, sf_dir), "looks"))


def p9_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of same-looking texts of every document, with its size and the document's number of links."""
    return skeleton.classes(materialize(_prints(spark, sf_dir), "looks"))


def p9_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text in its consistent form."""
    return skeleton.with_skeleton(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "skeleton")


QUERIES = {f.__name__: f for f in (p1_percentiles, p1_combined, p3_found, p3_top, p7_found, p7_near, p8_mix, p8_shares, p9_found, p9_classes, p9_texts)}


_P1_ROWS = """select lower(trim(dataset_name, ' \t\r\n')) as dataset_name, lower(trim(model_arch, ' \t\r\n')) as model_arch, load_id, (date '1970-01-01' + (epoch_us(evaluated_at) // 86400000000)::int)::varchar as day, c as column_name, x + 0.0 as x
 from (select dataset_name, model_arch, load_id, evaluated_at, 'oks_ours' as c, oks_ours as x from keypoint union all select dataset_name, model_arch, load_id, evaluated_at, 'cov_det', cov_det from keypoint) where x is not null and not isnan(x)"""


def _p1(by: str, source: str) -> str:
    return f"""
with v as ({source}),
r as (select {by}, x, row_number() over (partition by {by} order by x) as k, count(*) over (partition by {by}) as n_rows from v),
p as (select unnest([0.05::double, 0.25::double, 0.5::double, 0.75::double, 0.95::double]) as percentile)
select {by}, percentile, n_rows, x as value, 0.0::double as max_error from r join p on k = greatest(1, ceil(percentile * n_rows)::bigint)
"""


_P1_LEVELS = " union all ".join(f"select *, '{level}' as level, {period} as period from b" for level, period in (("all", "''"), ("load", "load_id::varchar"), ("day", "day")))

_P3 = """
with d as (select * from packet_metric qualify row_number() over (partition by packet_id order by loaded_at desc nulls last) = 1),
g as (select lower(trim(dataset, ' \t\r\n')) as dataset, lower(trim(model_name, ' \t\r\n')) as model_name, delta_oks, image_id, packet_id, sample_type from d
 where dataset is not null and model_name is not null and delta_oks is not null and not isnan(delta_oks))
select {} from (select *, row_number() over (partition by dataset, model_name order by delta_oks desc, image_id, packet_id) as rank from g) where rank <= 3
"""

_LOOK = skeleton.sql_look("text")

_P7_FOUND = f"""
with i as (select item_id, regexp_extract_all(lower({_LOOK}), '[\\p{{L}}\\p{{N}}]+') as w from eval_item where text is not null),
d as (select doc_id, regexp_extract_all(lower({_LOOK}), '[\\p{{L}}\\p{{N}}]+') as w from documents where text is not null),
s as (select distinct least(12, len(w)) as n from i where len(w) > 0),
ig as (select item_id, n, array_to_string(w[k:k + n - 1], ' ') as g from (select item_id, w, least(12, len(w)) as n, unnest(range(1, len(w) - least(12, len(w)) + 2)) as k from i where len(w) > 0)),
dg as (select doc_id, n, array_to_string(w[k:k + n - 1], ' ') as g from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as k from d, s where len(w) >= n))
select distinct item_id, doc_id from ig join dg using (n, g)
"""

_P9_CLASSES = f"""
with d as (select doc_id, text, {_LOOK} as look from documents where text is not null)
select doc_id, min(doc_id) over c as class_id, count(*) over c as n_documents, (select count(distinct e.text) from d e where e.look = d.look) as n_spellings, count(*) over c - count(*) over (partition by look, text) as n_links from d window c as (partition by look)
"""

_P9_FOUND = f"""
with d as (select doc_id, text, {_LOOK} as look from documents where text is not null)
select a.doc_id as doc_id_a, b.doc_id as doc_id_b from d a join d b on a.look = b.look and a.doc_id < b.doc_id and a.text <> b.text
"""

SQL = {
    "p7_found": _P7_FOUND,
    "p9_found": _P9_FOUND,
    "p9_classes": _P9_CLASSES,
    "p1_percentiles": _p1("dataset_name, model_arch, level, period, column_name", f"with b as ({_P1_ROWS}) {_P1_LEVELS}"),
    "p1_combined": _p1("dataset_name, model_arch, column_name", _P1_ROWS),
    "p3_found": _P3.format("packet_id"),
    "p3_top": _P3.format("dataset, model_name, delta_oks, image_id, packet_id, sample_type, rank"),
}
