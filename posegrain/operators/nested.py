"""Flattening of deeply nested packet bodies into related flat tables.

The JSON text is parsed once into a variant (JVM); shapes that differ from record to record (lists of lists,
lists of objects, one flat list, an object keyed by joint, a lone candidate without its outer list) are brought
into one nested array type by element-wise casts.  The nested arrays then reach Arrow, where the child tables are
cut out of the buffers: list offsets give parent indices, the parents' keys follow by a vectorised take, and no
row is visited in Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

BRANCHES = ("baseline", "ours_gmm")
N_JOINTS = 17
KEYS = ("packet_id", "loaded_at")


def latest_delivery(df: DataFrame, key: str = "packet_id", ts: str = "loaded_at", tie: str | None = None) -> DataFrame:
    """The row with the latest ``ts`` of each ``key``; rows with equal ``ts`` are told apart by a hash of ``tie``.

    A window with row_number() = 1: Spark keeps one row a key before the shuffle as well, so a key that was
    delivered a million times costs one row a task.
    """
    order = [F.col(ts).desc_nulls_last()] + ([F.xxhash64(tie).asc()] if tie else [])
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


_SOME = "exists({0}, e -> e is not null)"


def _joints_of(b: str) -> str:
    """Uniform joints of a branch from its three readings: list of lists, list of objects, or one flat list."""
    joint = lambda i, x, y, s: f"named_struct('kp_idx', cast({i} as int), 'x', {x}, 'y', {y}, 'score', {s})"
    triples = f"transform(sequence(0, cast(ceil(size({b}_flat) / 3) as int) - 1), i -> {joint('i', *(f'get({b}_flat, 3 * i + {k})' for k in range(3)))})"
    lists = f"transform({b}_lists, (e, i) -> if(e is null, null, {joint('i', 'get(e, 0)', 'get(e, 1)', 'get(e, 2)')}))"
    return f"case when {_SOME.format(b + '_flat')} then {triples} when {_SOME.format(b + '_lists')} then {lists} when {_SOME.format(b + '_objects')} then {b}_objects end"


#: Readings of a potential's parts; a reading that does not fit is null, or has null elements.
_READINGS = {
    "m_flat": ("means", "array<double>"), "m_lists": ("means", "array<array<double>>"), "m_objects": ("means", "array<struct<x:double,y:double>>"), "m_object": ("means", "struct<x:double,y:double>"),
    "c_deep": ("covariances", "array<array<array<double>>>"), "c_single": ("covariances", "array<array<double>>"), "w_many": ("weights", "array<double>"), "w_one": ("weights", "double"),
}


def _candidates_of() -> str:
    """Uniform means, covariances and weights of one potential r (its readings); null entries stay as null elements."""
    point = "named_struct('x', get({0}, 0), 'y', get({0}, 1))"
    cov = "named_struct('xx', get(get({0}, 0), 0), 'xy', get(get({0}, 0), 1), 'yx', get(get({0}, 1), 0), 'yy', get(get({0}, 1), 1))"
    means = (
        f"case when {_SOME.format('r.m_flat')} then array({point.format('r.m_flat')}) when {_SOME.format('r.m_lists')} then transform(r.m_lists, e -> if(e is null, null, {point.format('e')}))"
        f" when {_SOME.format('r.m_objects')} then r.m_objects when r.m_object is not null then array(r.m_object) end"
    )
    covs = (
        f"case when exists(r.c_deep, e -> exists(e, x -> x is not null)) then transform(r.c_deep, e -> if(e is null, null, {cov.format('e')}))"
        f" when exists(r.c_single, e -> exists(e, x -> x is not null)) then array({cov.format('r.c_single')}) end"
    )
    weights = "case when r.w_many is not null then r.w_many when r.w_one is not null then array(r.w_one) end"
    return f"named_struct('kp_idx', r.kp_idx, 'means', {means}, 'covariances', {covs}, 'weights', {weights})"


_BOX = "named_struct('x', get({0}, {1}), 'y', get({0}, {1} + 1), 'w', get({0}, {1} + 2), 'h', get({0}, {1} + 3))"
#: The other lists of a packet: boxes of the ground truth (one flat list, four numbers a box, or a list of lists), augmentations
#: with their parameters, entries of the configuration by section (a section that is no object has one entry without a name).
_OTHER_LISTS = {
    "boxes": f"case when {_SOME.format('b_flat')} then transform(sequence(0, cast(ceil(size(b_flat) / 4) as int) - 1), i -> {_BOX.format('b_flat', '4 * i')}) when {_SOME.format('b_lists')} then transform(b_lists, e -> if(e is null, null, {_BOX.format('e', '0')})) end",
    "tta": "transform(t, e -> if(e is null, null, named_struct('aug_id', e.aug_id, 'label', e.label, 'params', coalesce(transform(map_entries(e.params), p -> named_struct('name', p.key, 'value', p.value)), array()))))",
    "config": "flatten(transform(map_entries(c), s -> coalesce(transform(map_entries(try_variant_get(s.value, '$', 'map<string,variant>')), p -> named_struct('section', s.key, 'name', p.key, 'value', try_variant_get(p.value, '$', 'string'))), array(named_struct('section', s.key, 'name', cast(null as string), 'value', try_variant_get(s.value, '$', 'string'))))))",
}


def normalize(raw: DataFrame, body: str = "body") -> DataFrame:
    """Packets with one nested type, whatever form their parts had.

    Columns: packet_id, loaded_at, meta fields and metrics, boxes, tta and config (see ``_OTHER_LISTS``), predictions (the
    present and not-null branches with score and joints), unary (the listed potentials).  A body that is no JSON gives a packet without parts; a null or
    missing part gives an empty array.  The readings are columns of their own projection, so that each is
    evaluated once a row and not once an element.
    """
    v = raw.select(*KEYS, F.expr(f"try_parse_json({body})").alias("v"))
    text = lambda path, kind="string": F.expr(f"try_variant_get(v, '{path}', '{kind}')")
    kinds = {"flat": "array<double>", "lists": "array<array<double>>", "objects": "array<struct<kp_idx:int,x:double,y:double,score:double>>"}
    fields = "struct<kp_idx:int,means:variant,covariances:variant,weights:variant>"
    listed = f"filter(try_variant_get(v, '$.unary', 'array<{fields}>'), u -> u is not null)"
    keyed = (
        f"transform(map_entries(map_filter(try_variant_get(v, '$.unary', 'map<string,{fields}>'), (k, x) -> x is not null)),"
        " e -> named_struct('kp_idx', coalesce(try_cast(e.key as int), e.value.kp_idx), 'means', e.value.means, 'covariances', e.value.covariances, 'weights', e.value.weights))"
    )
    first = v.select(
        *KEYS,
        text("$.meta.image_id", "bigint").alias("image_id"),
        text("$.meta.file_name").alias("file_name"),
        text("$.meta.dataset").alias("dataset"),
        text("$.meta.model_name").alias("model_name"),
        text("$.meta.sample_type").alias("sample_type"),
        text("$.meta.timestamp").alias("run_ts"),
        text("$.ground_truth.area", "double").alias("area"),
        text("$.metrics.oks_base", "double").alias("oks_base"),
        text("$.metrics.swaps_base", "int").alias("swaps_base"),
        *(F.expr(f"variant_get(v, '$.predictions.{b}') is not null and not is_variant_null(variant_get(v, '$.predictions.{b}'))").alias(f"{b}_there") for b in BRANCHES),
        *(text(f"$.predictions.{b}.score", "double").alias(f"{b}_score") for b in BRANCHES),
        *(text(f"$.predictions.{b}.coords", kind).alias(f"{b}_{k}") for b in BRANCHES for k, kind in kinds.items()),
        F.expr(f"coalesce({listed}, {keyed})").alias("u"),
        text("$.ground_truth.bboxes", "array<double>").alias("b_flat"),
        text("$.ground_truth.bboxes", "array<array<double>>").alias("b_lists"),
        text("$.tta_data", "array<struct<aug_id:int,label:string,params:map<string,string>>>").alias("t"),
        text("$.config_used", "map<string,variant>").alias("c"),
    )
    meta = [c for c in first.columns if c not in ("u", "b_flat", "b_lists", "t", "c") and not c.startswith(BRANCHES)]
    reading = ", ".join(f"'{k}', try_variant_get(u.{part}, '$', '{kind}')" for k, (part, kind) in _READINGS.items())
    branch = [F.expr(f"if(coalesce({b}_there, false), named_struct('branch', '{b}', 'score', {b}_score, 'joints', {_joints_of(b)}), null)") for b in BRANCHES]
    second = first.select(*meta, *(F.expr(f"coalesce({e}, array())").alias(c) for c, e in _OTHER_LISTS.items()), F.array_compact(F.array(*branch)).alias("predictions"), F.expr(f"transform(u, u -> named_struct('kp_idx', u.kp_idx, {reading}))").alias("readings"))
    return second.select(*meta, *_OTHER_LISTS, "predictions", F.expr(f"coalesce(transform(readings, r -> {_candidates_of()}), array())").alias("unary"))


def _list(column: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Parent index of each child, and the children, of a list column: offsets only, no values looked at."""
    return pc.list_parent_indices(column), pc.list_flatten(column)


def _position(parents: pa.Array) -> pa.Array:
    """Place of each child in its list, from the parents' run starts."""
    import numpy as np

    p = parents.to_numpy(zero_copy_only=False)
    if not len(p):
        return pa.array([], pa.int32())
    starts = np.flatnonzero(np.concatenate(([True], p[1:] != p[:-1])))
    return pa.array((np.arange(len(p)) - np.repeat(starts, np.diff(np.append(starts, len(p))))).astype("int32"))


def _valid(column: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Indices and values of the elements that are not null."""
    keep = pc.indices_nonzero(column.is_valid())
    return keep, column.take(keep)


def _field(column: pa.StructArray, name: str) -> pa.Array:
    return pc.struct_field(column, name)


def _predictions(b: pa.RecordBatch) -> dict[str, pa.Array]:
    parent, child = _list(b.column("predictions"))
    return {k: b.column(k).take(parent) for k in KEYS} | {"branch": _field(child, "branch"), "score": _field(child, "score")}


def _joints(b: pa.RecordBatch) -> dict[str, pa.Array]:
    parent, child = _list(b.column("predictions"))
    up, joint = _list(_field(child, "joints"))
    keep, joint = _valid(joint)
    up = up.take(keep)
    row = parent.take(up)
    return {k: b.column(k).take(row) for k in KEYS} | {"branch": _field(child, "branch").take(up)} | {k: _field(joint, k) for k in ("kp_idx", "x", "y", "score")}


def _counts(column: pa.Array) -> pa.Array:
    """Number of not-null elements of each list; 0 for a null list."""
    import numpy as np

    up, child = _list(column)
    keep, _ = _valid(child)
    return pa.array(np.bincount(up.take(keep).to_numpy(zero_copy_only=False).astype("int64"), minlength=len(column)).astype("int32"))


def _potentials(b: pa.RecordBatch) -> dict[str, pa.Array]:
    parent, child = _list(b.column("unary"))
    out = {k: b.column(k).take(parent) for k in KEYS} | {"potential_idx": _position(parent), "kp_idx": _field(child, "kp_idx")}
    return out | {f"n_{k}": _counts(_field(child, k)) for k in ("means", "covariances", "weights")}


def _candidates_table(b: pa.RecordBatch) -> dict[str, pa.Array]:
    import numpy as np

    parent, child = _list(b.column("unary"))
    lists = [_field(child, k) for k in ("means", "covariances", "weights")]
    sizes = np.stack([np.asarray(pc.fill_null(pc.list_value_length(x), 0)).astype("int64") for x in lists]) if len(child) else np.zeros((3, 0), "int64")
    longest = sizes.max(axis=0)
    up = np.repeat(np.arange(len(longest)), longest)
    place = np.arange(len(up)) - np.repeat(np.cumsum(longest) - longest, longest)
    out = {k: b.column(k).take(parent.take(pa.array(up))) for k in KEYS}
    out |= {"potential_idx": _position(parent).take(pa.array(up)), "kp_idx": _field(child, "kp_idx").take(pa.array(up)), "cand_idx": pa.array(place.astype("int32"))}
    for column, size, fields in zip(lists, sizes, (("x", "y"), ("xx", "xy", "yx", "yy"), None), strict=True):
        _, values = _list(column)
        at = np.repeat(np.cumsum(size) - size, longest) + place
        taken = values.take(pa.array(at, mask=place >= np.repeat(size, longest)))
        out |= {("m" if len(fields) == 2 else "c") + f: _field(taken, f) for f in fields} if fields else {"weight": taken}
    return out


def _flat_list(column: str, fields: tuple[str, ...], place: str):
    """The child table of a list of flat objects: its parents' keys, the place in the list, the fields."""

    def cut(b: pa.RecordBatch) -> dict[str, pa.Array]:
        parent, child = _list(b.column(column))
        at = _position(parent)
        keep, child = _valid(child)
        return {k: b.column(k).take(parent.take(keep)) for k in KEYS} | {place: at.take(keep)} | {f: _field(child, f) for f in fields}

    return cut


def _params(b: pa.RecordBatch) -> dict[str, pa.Array]:
    """The parameters of augmentations, each with the place of its augmentation."""
    parent, child = _list(b.column("tta"))
    at = _position(parent)
    up, param = _list(_field(child, "params"))
    return {k: b.column(k).take(parent.take(up)) for k in KEYS} | {"tta_idx": at.take(up), "name": _field(param, "name"), "value": _field(param, "value")}


_TABLES = {
    "boxes": (_flat_list("boxes", ("x", "y", "w", "h"), "box_idx"), "packet_id bigint, loaded_at timestamp, box_idx int, x double, y double, w double, h double", ["boxes"]),
    "tta": (_flat_list("tta", ("aug_id", "label"), "tta_idx"), "packet_id bigint, loaded_at timestamp, tta_idx int, aug_id int, label string", ["tta"]),
    "tta_params": (_params, "packet_id bigint, loaded_at timestamp, tta_idx int, name string, value string", ["tta"]),
    "config": (_flat_list("config", ("section", "name", "value"), "config_idx"), "packet_id bigint, loaded_at timestamp, config_idx int, section string, name string, value string", ["config"]),
    "predictions": (_predictions, "packet_id bigint, loaded_at timestamp, branch string, score double", ["predictions"]),
    "joints": (_joints, "packet_id bigint, loaded_at timestamp, branch string, kp_idx int, x double, y double, score double", ["predictions"]),
    "potentials": (_potentials, "packet_id bigint, loaded_at timestamp, potential_idx int, kp_idx int, n_means int, n_covariances int, n_weights int", ["unary"]),
    "candidates": (_candidates_table, "packet_id bigint, loaded_at timestamp, potential_idx int, kp_idx int, cand_idx int, mx double, my double, cxx double, cxy double, cyx double, cyy double, weight double", ["unary"]),
}


def child_table(packets: DataFrame, name: str) -> DataFrame:
    """One of boxes, tta, tta_params, config, predictions, joints, potentials, candidates, each row with the keys of its parents."""
    cut, schema, columns = _TABLES[name]
    names = [x.strip().split(" ")[0] for x in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = cut(batch)
            yield pa.RecordBatch.from_arrays([got[n].combine_chunks() if isinstance(got[n], pa.ChunkedArray) else got[n] for n in names], names=names)

    return packets.select(*KEYS, *columns).mapInArrow(run, schema)


def flatten(packets: DataFrame) -> dict[str, DataFrame]:
    """All flat tables: packets and the child tables."""
    return {"packets": packets.drop("predictions", "unary", *_OTHER_LISTS)} | {name: child_table(packets, name) for name in _TABLES}


def missing_children(packets: DataFrame) -> DataFrame:
    """(packet_id, branch, kp_idx): predictions without x or y for a joint, potentials whose lists differ in length.

    A bit mask a branch holds the joints that are there, so the aggregate before the shuffle is one row a
    branch.  Repeated deliveries must have been left out before.
    """
    joints = child_table(packets, "joints").where("x is not null and y is not null and kp_idx between 0 and 16")
    there = joints.groupBy("packet_id", "branch").agg(F.bit_or(F.expr("shiftleft(1L, kp_idx)")).alias("mask"))
    full = child_table(packets, "predictions").select("packet_id", "branch").join(there, ["packet_id", "branch"], "left")
    lacking = full.select("packet_id", "branch", F.explode(F.sequence(F.lit(0), F.lit(N_JOINTS - 1))).alias("kp_idx"), F.coalesce("mask", F.lit(0).cast("bigint")).alias("mask"))
    lacking = lacking.where("(shiftright(mask, kp_idx) & 1) = 0").select("packet_id", "branch", F.col("kp_idx").cast("int"))
    uneven = child_table(packets, "potentials").where("not (n_means = n_covariances and n_covariances = n_weights)")
    return lacking.union(uneven.select("packet_id", F.lit("unary").alias("branch"), "kp_idx").distinct())
