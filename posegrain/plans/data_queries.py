"""Queries of the core data-pipeline operators: drifting schemas, nested packets, column profiles, small files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from posegrain.operators import containers, nested, profile, rescue
from posegrain.session import materialize, shared_path, table

#: Target schema of the metric export: the keys and the measures that downstream tables need.
EXPORT_SCHEMA = {"image_id": "bigint", "kp_idx": "int", "n_components": "int", "heatmap_entropy": "double", "base_score": "double", "uniform_weight": "double", "cov_det": "double", "oks_ours": "double", "vis": "int"}


def _ingested(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = rescue.latest_lines(table(spark, sf_dir, "metric_export"))
    return rescue.ingest(lines, EXPORT_SCHEMA, ["producer", "file_id", "exported_at", "arrived_at", "line_no"])


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each change of a file against the file before it of the same producer."""
    return rescue.drift(_ingested(spark, sf_dir)).select("file_id", "field_name", "change_kind")


def rename_closure(renames: list[tuple[str, str]], schema: dict[str, str]) -> dict[str, list[str]]:
    """Names reachable from a target name over renames in either direction; a name that would reach two targets goes to none."""
    near: dict[str, set[str]] = {}
    for a, b in renames:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    owner: dict[str, set[str]] = {}
    for target in schema:
        seen, todo = {target}, [target]
        while todo:
            for x in sorted(near.get(todo.pop(), ())):
                if x not in seen and x not in schema:
                    seen.add(x)
                    todo.append(x)
        for x in seen - {target}:
            owner.setdefault(x, set()).add(target)
    return {t: sorted(x for x, o in owner.items() if o == {t}) for t in schema}


def p2_table(spark: SparkSession, sf_dir: str, max_renames: int = 10_000) -> DataFrame:
    """All export lines in one typed table: renamed fields found by the drift report are approved and replayed from the rescue column.

    Only the distinct (old, new) name pairs come to the driver; more than ``max_renames`` of them are an error.
    """
    data = materialize(_ingested(spark, sf_dir), "ingested")
    pairs = rescue.drift(data).where("change_kind = 'renamed'").select("old_name", "field_name").distinct().limit(max_renames + 1).collect()
    if len(pairs) > max_renames:
        raise ValueError(f"more than {max_renames} different renames; approve names by hand")
    approved = rename_closure([(r.old_name, r.field_name) for r in pairs], EXPORT_SCHEMA)
    return rescue.promote(data, approved, EXPORT_SCHEMA)


def _packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.normalize(nested.latest_delivery(table(spark, sf_dir, "packet_raw"), tie="body"))


def _flat(child: DataFrame) -> DataFrame:
    """A child table with its delivery as a number, which reads alike in every time zone."""
    return child.select("packet_id", F.unix_micros("loaded_at").alias("loaded_us"), *child.columns[2:])


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions that lack x or y of a joint and potentials whose lists differ in length, in the latest deliveries.

    The normalized packets are written once, because three child tables are cut from them.
    """
    return nested.missing_children(materialize(_packets(spark, sf_dir).select("packet_id", "loaded_at", "predictions", "unary"), "packets"))


def p4_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(nested.flatten(_packets(spark, sf_dir))["packets"])


def p4_joints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(nested.child_table(_packets(spark, sf_dir), "joints"))


def p4_potentials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(nested.child_table(_packets(spark, sf_dir), "potentials"))


def p4_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(nested.child_table(_packets(spark, sf_dir), "candidates"))


def p4_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(nested.child_table(_packets(spark, sf_dir), "boxes"))


def p4_tta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(nested.child_table(_packets(spark, sf_dir), "tta"))


def p4_tta_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(nested.child_table(_packets(spark, sf_dir), "tta_params"))


def p4_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of the packets' configurations; their order in an object says nothing."""
    return _flat(nested.child_table(_packets(spark, sf_dir), "config")).drop("config_idx")


#: The columns of problem 5: table -> (numbers, texts).
PROFILED = {"packet_metric": (["oks_ours", "covariance_volume"], ["covariance_volume_src"]), "keypoint": (["cov_det", "uniform_weight"], [])}


def _profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles from a store that is opened again for every load and gets that load's delta, as loads would arrive.

    The rows are counted once; the counts wait by load, so that a delta reads its own load only.
    """
    counts = [profile.value_counts(table(spark, sf_dir, t), t, numeric, text) for t, (numeric, text) in PROFILED.items()]
    waiting = materialize(counts[0].unionByName(counts[1]).withColumn("arrives", F.col("load_id")), "arrivals", ["arrives"])
    path = shared_path(spark, "value-counts")
    for r in waiting.select("arrives").distinct().orderBy(F.col("arrives").asc_nulls_first()).collect():  # one row a load
        profile.ValueCountStore(spark, path).apply(waiting.where(F.col("arrives").eqNullSafe(F.lit(r.arrives))))
    return profile.profile(profile.ValueCountStore(spark, path).read())


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with a column in a load."""
    return profile.findings(_profiles(spark, sf_dir), ["oks_ours", "uniform_weight"], ["cov_det", "covariance_volume"], ["covariance_volume_src"])


def p5_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profile itself: one row a table, column and load."""
    p = _profiles(spark, sf_dir)
    return p.select(*(F.round(c, 6).alias(c) if c in ("min", "max", "median", "entropy") else F.col(c) for c in p.columns))


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containers.write_blocks(containers.pack(table(spark, sf_dir, "packet_file")), shared_path(spark, "blocks"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that stand in two or more files, read from the packed blocks."""
    return containers.repeated_records(containers.packet_records(containers.unpack(_blocks(spark, sf_dir))))


def p6_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record exactly once, read from the packed blocks."""
    return containers.unique_records(containers.packet_records(containers.unpack(_blocks(spark, sf_dir))))


def p6_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of the blocks, each file once."""
    return containers.index(_blocks(spark, sf_dir)).select("file_no", "path", "length", "crc")


QUERIES = {f.__name__: f for f in (p2_found, p2_table, p4_found, p4_packets, p4_joints, p4_potentials, p4_candidates, p4_boxes, p4_tta, p4_tta_params, p4_config, p5_found, p5_profile, p6_found, p6_records, p6_index)}

_LATEST = "l as (select packet_id, epoch_us(loaded_at) as loaded_us, body from packet_raw where json_valid(body) qualify row_number() over (partition by packet_id order by loaded_at desc nulls last) = 1)"
_P4_LIST = "from_json({0}, '[\"json\"]')"

_P4_PACKETS = f"""
with {_LATEST.replace(" where json_valid(body)", "")} select packet_id, loaded_us, try_cast(body->>'$.meta.image_id' as bigint) as image_id, body->>'$.meta.file_name' as file_name, body->>'$.meta.dataset' as dataset, body->>'$.meta.model_name' as model_name,
 body->>'$.meta.sample_type' as sample_type, body->>'$.meta.timestamp' as run_ts, try_cast(body->>'$.ground_truth.area' as double) as area, try_cast(body->>'$.metrics.oks_base' as double) as oks_base, try_cast(body->>'$.metrics.swaps_base' as int) as swaps_base from l
"""

_P4_JOINTS = f"""
{_LATEST},
b as (select packet_id, loaded_us, 'baseline' as branch, json_extract(body, '$.predictions.baseline.coords') as c from l union all select packet_id, loaded_us, 'ours_gmm', json_extract(body, '$.predictions.ours_gmm.coords') from l),
e as (select packet_id, loaded_us, branch, {_P4_LIST.format("c")} as es from b where json_type(c) = 'ARRAY'),
k as (select *, list_filter(list_transform(es, lambda x: json_type(x)), lambda t: t is not null and t <> 'NULL')[1] as kind from e),
j as (select packet_id, loaded_us, branch, kind, unnest(range(0, case when kind in ('ARRAY', 'OBJECT') then len(es) else ceil(len(es) / 3.0)::bigint end)) as i, es from k),
joints as (select packet_id, loaded_us, branch, case kind when 'OBJECT' then try_cast(es[i + 1]->>'kp_idx' as int) else i::int end as kp_idx,
 try_cast(case kind when 'ARRAY' then es[i + 1]->>0 when 'OBJECT' then es[i + 1]->>'x' else es[3 * i + 1]->>'$' end as double) as x,
 try_cast(case kind when 'ARRAY' then es[i + 1]->>1 when 'OBJECT' then es[i + 1]->>'y' else es[3 * i + 2]->>'$' end as double) as y,
 try_cast(case kind when 'ARRAY' then es[i + 1]->>2 when 'OBJECT' then es[i + 1]->>'score' else es[3 * i + 3]->>'$' end as double) as score
 from j where kind is not null and kind not in ('ARRAY', 'OBJECT') or json_type(es[i + 1]) = kind)
"""

_P4_SOME = "list_filter({0}, lambda x: json_type(x) is not null and json_type(x) <> 'NULL')"
_P4_POTENTIALS = f"""
u as (select packet_id, loaded_us, json_extract(body, '$.unary') as u from l),
p as (select packet_id, loaded_us, i::int as potential_idx, null as key, es[i + 1] as r from (select *, unnest(range(0, len(es))) as i from (select packet_id, loaded_us, {_P4_SOME.format(_P4_LIST.format("u"))} as es from u where json_type(u) = 'ARRAY'))
 union all select packet_id, loaded_us, (row_number() over (partition by packet_id order by key) - 1)::int, key, json_extract(u, '$."' || key || '"') from (select *, unnest(json_keys(u)) as key from u where json_type(u) = 'OBJECT') where json_type(json_extract(u, '$."' || key || '"')) <> 'NULL'),
q as (select packet_id, loaded_us, potential_idx, coalesce(try_cast(key as int), try_cast(r->>'kp_idx' as int)) as kp_idx, r->'means' as m, r->'covariances' as c, r->'weights' as w from p),
n as (select *, case when json_type(m) = 'ARRAY' then {_P4_SOME.format(_P4_LIST.format("m"))} else [] end as ms, case when json_type(c) = 'ARRAY' then {_P4_SOME.format(_P4_LIST.format("c"))} else [] end as cs, case when json_type(w) = 'ARRAY' then {_P4_SOME.format(_P4_LIST.format("w"))} else [] end as ws from q),
potentials as (select packet_id, loaded_us, potential_idx, kp_idx,
 (case when json_type(m) = 'OBJECT' then 1 when len(ms) > 0 and json_type(ms[1]) not in ('ARRAY', 'OBJECT') then 1 else len(ms) end)::int as n_means,
 (case when len(cs) > 0 and json_type(cs[1]) = 'ARRAY' and json_type(cs[1]->0) <> 'ARRAY' then 1 else len(cs) end)::int as n_covariances,
 (case when json_type(w) in ('DOUBLE', 'BIGINT', 'UBIGINT') then 1 else len(ws) end)::int as n_weights from n)
"""

_P4_FOUND = f"""
with {_P4_JOINTS}, {_P4_POTENTIALS},
there as (select packet_id, 'baseline' as branch from l where json_type(body, '$.predictions.baseline') <> 'NULL' union all select packet_id, 'ours_gmm' from l where json_type(body, '$.predictions.ours_gmm') <> 'NULL')
select packet_id, branch, kp_idx::int as kp_idx from there, range(0, 17) t(kp_idx) where not exists (select 1 from joints j where j.packet_id = there.packet_id and j.branch = there.branch and j.kp_idx = t.kp_idx and x is not null and y is not null)
union all select distinct packet_id, 'unary', kp_idx from potentials where not (n_means = n_covariances and n_covariances = n_weights)
"""

_P4_BOXES = f"""
with {_LATEST}, b as (select packet_id, loaded_us, {_P4_LIST.format("json_extract(body, '$.ground_truth.bboxes')")} as es from l where json_type(body, '$.ground_truth.bboxes') = 'ARRAY'),
f as (select packet_id, loaded_us, [try_cast(e->>'$' as double) for e in es] as v, unnest(range(0, ceil(len(es) / 4.0)::bigint))::int as i from b)
select packet_id, loaded_us, i as box_idx, v[4 * i + 1] as x, v[4 * i + 2] as y, v[4 * i + 3] as w, v[4 * i + 4] as h from f
"""

_P4_TTA = f"""
{_LATEST}, b as (select packet_id, loaded_us, {_P4_LIST.format("json_extract(body, '$.tta_data')")} as es from l where json_type(body, '$.tta_data') = 'ARRAY'),
t as (select packet_id, loaded_us, unnest(range(0, len(es)))::int as tta_idx, unnest(es) as e from b)
"""

_P4_CONFIG = f"""
with {_LATEST}, s as (select packet_id, loaded_us, section, json_extract(body, '$.config_used."' || section || '"') as c from (select *, unnest(json_keys(body, '$.config_used')) as section from l))
select packet_id, loaded_us, section, name, c->>('$."' || name || '"') as value from (select *, unnest(json_keys(c)) as name from s where json_type(c) = 'OBJECT')
"""

_P5_FOUND = r"""
with v as (
 select 'packet_metric' t,'oks_ours' c,load_id,case when isnan(oks_ours) then null else oks_ours end x from packet_metric
 union all select 'packet_metric','covariance_volume',load_id,case when isnan(covariance_volume) then null else covariance_volume end from packet_metric
 union all select 'keypoint','cov_det',load_id,case when isnan(cov_det) then null else cov_det end from keypoint
 union all select 'keypoint','uniform_weight',load_id,case when isnan(uniform_weight) then null else uniform_weight end from keypoint),
p as (select t,c,load_id,count(*) n,count(x) nv,count(distinct x) nd,median(x) med,
 bool_or(x<0 or (c in ('oks_ours','uniform_weight') and x>1) or (c in ('cov_det','covariance_volume') and isinf(x))) rng from v group by all),
q as (select *, lag((n-nv)/n) over (partition by t,c order by load_id) r0, lag(med) over (partition by t,c order by load_id) m0 from p)
select t as table_name, c as column_name, load_id, 'null_rate' as finding from q where abs((n-nv)/n-r0)>0.10
union all select t,c,load_id,'range' from q where rng
union all select t,c,load_id,'distinct' from q where nd<0.2*nv
union all select t,c,load_id,'shift' from q where med>2*m0 or med<m0/2
union all select distinct 'packet_metric','covariance_volume_src',load_id,'pattern' from packet_metric where covariance_volume_src is not null and not regexp_full_match(covariance_volume_src,'-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?')
"""

_P5_PROFILE = """
with v as (
 select 'packet_metric' as t, 'oks_ours' as c, load_id, case when isnan(oks_ours) then null else oks_ours end as x, null as s from packet_metric
 union all select 'packet_metric', 'covariance_volume', load_id, case when isnan(covariance_volume) then null else covariance_volume end, null from packet_metric
 union all select 'packet_metric', 'covariance_volume_src', load_id, null, covariance_volume_src from packet_metric
 union all select 'keypoint', 'cov_det', load_id, case when isnan(cov_det) then null else cov_det end, null from keypoint
 union all select 'keypoint', 'uniform_weight', load_id, case when isnan(uniform_weight) then null else uniform_weight end, null from keypoint),
n as (select t, c, load_id, x, s, count(*) as k from v group by all),
e as (select t, c, load_id, sum(k) as nv, sum(k * ln(k)) as kl from n where x is not null or s is not null group by all)
select v.t as table_name, v.c as column_name, v.load_id, count(*) as n_rows, count(*) - count(x) - count(s) as n_null, count(x) + count(s) as n_values,
 count(distinct x) + count(distinct s) as n_distinct, round(min(x), 6) as min, round(max(x), 6) as max, count(*) filter (x < 0) as n_below_0, count(*) filter (x > 1) as n_above_1,
 count(*) filter (isinf(x)) as n_infinite, count(*) filter (s is not null and not regexp_full_match(s, '-?[0-9]+(\\.[0-9]+)?([eE][+-]?[0-9]+)?')) as n_bad_text,
 round(median(x), 6) as median, round(any_value(ln(nv) - kl / nv), 6) as entropy
from v left join e on v.t = e.t and v.c = e.c and v.load_id = e.load_id group by v.t, v.c, v.load_id
"""

_P6_RECORDS = r"""
 select file_no, try_cast(json_extract_string(line, '$.image_id') as bigint) as image_id, regexp_extract(json_extract_string(line, '$.file_name'), '[^/\\]*$') as base_name
 from (select file_no, unnest(string_split_regex(content, '\r?\n')) as line from packet_file) where json_valid(line) and json_type(line) = 'OBJECT'
"""

_P6_FOUND = f"select image_id, base_name from ({_P6_RECORDS}) where image_id is not null and base_name is not null group by all having count(distinct file_no) > 1"

_P6_UNIQUE = r"""
with l as (select file_no, unnest(string_split_regex(content, '\r?\n')) as line, generate_subscripts(string_split_regex(content, '\r?\n'), 1) as line_no from packet_file),
r as (select file_no, line_no, try_cast(json_extract_string(line, '$.image_id') as bigint) as image_id, regexp_extract(json_extract_string(line, '$.file_name'), '[^/\\]*$') as base_name,
 json_extract_string(line, '$.dataset') as dataset, json_extract_string(line, '$.model_name') as model_name, json_extract_string(line, '$.timestamp') as ts, try_cast(json_extract_string(line, '$.oks_ours') as double) as oks_ours
 from l where json_valid(line) and json_type(line) = 'OBJECT')
select image_id, base_name, file_no, line_no, dataset, model_name, ts, oks_ours, n_seen from (select *, count(*) over (partition by image_id, base_name) as n_seen,
 row_number() over (partition by image_id, base_name order by coalesce(ts, '') desc, file_no, line_no) as k from r where image_id is not null and base_name is not null) where k = 1
"""

_P6_INDEX = "select file_no, file_path as path, strlen(content)::bigint as length from packet_file"

SQL = {
    "p4_found": _P4_FOUND,
    "p4_packets": _P4_PACKETS,
    "p4_joints": f"with {_P4_JOINTS} select * from joints",
    "p4_potentials": f"with {_LATEST}, {_P4_POTENTIALS} select * from potentials",
    "p4_boxes": _P4_BOXES,
    "p4_tta": f"with {_P4_TTA} select packet_id, loaded_us, tta_idx, try_cast(e->>'aug_id' as int) as aug_id, e->>'label' as label from t where json_type(e) = 'OBJECT'",
    "p4_tta_params": f"with {_P4_TTA} select packet_id, loaded_us, tta_idx, name, e->>('$.params.\"' || name || '\"') as value from (select *, unnest(json_keys(e, '$.params')) as name from t)",
    "p4_config": _P4_CONFIG,
    "p6_records": _P6_UNIQUE, "p5_found": _P5_FOUND, "p5_profile": _P5_PROFILE, "p6_found": _P6_FOUND}
