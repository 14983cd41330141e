"""Ingestion of records whose schema drifts, with a rescue column, and a report of every change.

``ingest`` enforces a target schema: a field that fits its declared type becomes a typed column, everything else
(unknown names, foreign types) stays as JSON in ``_rescued``, so nothing is lost.  ``promote`` replays rescued
values into typed columns once their names are approved.  ``drift`` compares each file with the one before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from posegrain.session import materialize

#: JSON types a target type accepts without a cast rule.
_ACCEPTS = {"int": ("integer",), "bigint": ("integer",), "double": ("integer", "double"), "string": ("string",), "boolean": ("boolean",)}
#: Order among types that are equally common.
_TYPES = ("integer", "double", "string", "boolean", "array", "object")


def _json_type(x: str) -> str:
    """integer, double, string, boolean, array, object or null, by the JSON token.  Integers beyond 64 bits are decimals of scale 0 with 19 digits or more."""
    t = f"schema_of_variant({x})"
    big = f"cast(regexp_extract({t}, 'DECIMAL\\\\(([0-9]+),0\\\\)', 1) as int)"
    return (
        f"case when {t} in ('BIGINT', 'INT', 'SMALLINT', 'TINYINT') then 'integer' when {t} like 'DECIMAL%,0)' and {big} >= 19 then 'integer'"
        f" when {t} like 'DECIMAL%' or {t} in ('DOUBLE', 'FLOAT') then 'double' when {t} = 'STRING' then 'string' when {t} = 'BOOLEAN' then 'boolean'"
        f" when {t} like 'ARRAY%' then 'array' when {t} like 'OBJECT%' then 'object' else 'null' end"
    )


def _unwrapped(x: str) -> str:
    """The scalar text of a value: of itself, of its only element, or of its only member."""
    one = f"try_variant_get({x}, '$', 'array<variant>')"
    member = f"map_values(try_variant_get({x}, '$', 'map<string,variant>'))"
    return f"coalesce(if(size({one}) = 1, try_variant_get(get({one}, 0), '$', 'string'), null), if(size({member}) = 1, try_variant_get(get({member}, 0), '$', 'string'), null), try_variant_get({x}, '$', 'string'))"


def latest_lines(lines: DataFrame) -> DataFrame:
    """One row of each (producer, file_id, line_no), the one that arrived last.  Hot producers are spread over their lines."""
    w = Window.partitionBy("producer", "file_id", "line_no").orderBy(F.col("arrived_at").desc_nulls_last(), F.xxhash64("record"))
    return lines.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def ingest(lines: DataFrame, schema: dict[str, str], keep: list[str], record: str = "record") -> DataFrame:
    """Rows with ``keep``, the typed columns of ``schema``, ``_rescued`` (JSON) and ``_seen`` (map name -> JSON type and plain value).

    A record that is no JSON object has null in all typed columns and stands whole in ``_rescued`` under the name
    ``_record``; a record with the same name twice counts as no object.  Names of ``keep`` do not clash: typed
    columns win, for ``keep`` is selected first and only under names that the schema does not have.
    """
    keep = [c for c in keep if c not in schema]
    v = lines.select(*keep, F.col(record).alias("_raw"), F.expr(f"try_variant_get(try_parse_json({record}), '$', 'map<string,variant>')").alias("_m"))
    info = f"named_struct('type', {_json_type('x')}, 'text', {_unwrapped('x')})"
    v = v.select("*", F.expr(f"transform_values(_m, (k, x) -> {info})").alias("_seen"))
    fits = " or ".join(f"(k = '{n}' and _seen[k].type in ({', '.join(map(repr, (*_ACCEPTS[t], 'null')))}))" for n, t in schema.items()) or "false"
    typed = [F.expr(f"if(_seen['{n}'].type in ({', '.join(map(repr, _ACCEPTS[t]))}), try_variant_get(_m['{n}'], '$', '{t}'), null)").alias(n) for n, t in schema.items()]
    rest = f"map_filter(_m, (k, x) -> not ({fits}))"
    rescued = F.expr(f"if(_m is null, if(_raw is null, null, to_json(map('_record', _raw))), if(size({rest}) = 0, null, to_json({rest})))").alias("_rescued")
    return v.select(*keep, *typed, rescued, "_seen")


def promote(ingested: DataFrame, approved: dict[str, list[str]], schema: dict[str, str]) -> DataFrame:
    """Replay rescued values into the typed columns: for each column the first approved name that has a castable value.

    A lone number inside an array or object, or printed as text, counts as the number.  What was replayed leaves
    ``_rescued``; what cannot be cast stays there.
    """
    out = ingested.withColumn("_r", F.expr("try_variant_get(try_parse_json(_rescued), '$', 'map<string,variant>')"))
    used = []
    columns = []
    for name, kind in schema.items():
        tries = []
        for alias in dict.fromkeys([name, *approved.get(name, [])]):
            quoted = alias.replace("\\", "\\\\").replace("'", "\\'")
            number = f"try_cast({_unwrapped(f'''_r['{quoted}']''')} as double)"
            cast = f"if({number} = floor({number}), try_cast({number} as {kind}), null)" if kind in ("int", "bigint") else f"try_cast({_unwrapped(f'''_r['{quoted}']''')} as {kind})"
            tries.append(cast)
            used.append(f"(k = '{quoted}' and {name} is null and {cast} is not null)")
        columns.append(F.expr(f"coalesce({name}, {', '.join(tries)})").alias(name))
    rest = f"map_filter(_r, (k, x) -> not ({' or '.join(used)}))" if used else "_r"
    others = [c for c in ingested.columns if c not in schema and c not in ("_rescued", "_seen")]
    return out.select(*others, *columns, F.expr(f"if(_r is null or size({rest}) = 0, null, to_json({rest}))").alias("_rescued"))


def file_sequence(files: DataFrame) -> DataFrame:
    """(producer, file_id, prev_file_id): each file's predecessor by exported_at, then file_id.

    Two levels (day, then days), so that no task sorts all files of a producer: within a day by a window, across
    days through each day's last file.
    """
    f = files.where("producer is not null and file_id is not null").groupBy("producer", "file_id").agg(F.min("exported_at").alias("exported_at"))
    f = f.withColumn("day", F.coalesce(F.to_date("exported_at"), F.lit("0001-01-01").cast("date")))
    order = [F.col("exported_at").asc_nulls_first(), F.col("file_id").asc()]
    f = f.withColumn("prev_in", F.lag("file_id").over(Window.partitionBy("producer", "day").orderBy(*order)))
    ends = f.groupBy("producer", "day").agg(F.max_by("file_id", F.struct("exported_at", "file_id")).alias("last"))
    ends = ends.withColumn("prev_day_last", F.lag("last").over(Window.partitionBy("producer").orderBy("day"))).drop("last")
    return f.join(ends, ["producer", "day"], "left").select("producer", "file_id", F.coalesce("prev_in", "prev_day_last").alias("prev_file_id"))


def drift(ingested: DataFrame, keys: tuple[str, ...] = ("image_id", "kp_idx")) -> DataFrame:
    """(producer, file_id, field_name, old_name, change_kind): every change of a file against the file before it.

    ``ingested`` has producer, file_id, exported_at, line_no, the key columns and ``_seen``.  A rename is found by
    signatures: number and order-free hash of (key, value) over the rows both files hold, so no value is compared
    pairwise.  Values are compared as numbers where they are numbers; missing and null are alike, and a name that
    is null in all shared rows is no rename; lines without producer or file_id belong to no file and are left out.  If several new names carry the same values they are paired in name order.
    """
    seq = materialize(file_sequence(ingested.select("producer", "file_id", "exported_at")), "file-sequence")
    nxt = seq.where("prev_file_id is not null").select("producer", F.col("prev_file_id").alias("file_id"), F.col("file_id").alias("next_file_id"))
    # a key's neighbours among the files of its producer; one shuffle, spread over the keys
    # rows without a whole key have no neighbours; a random number keeps them from meeting in one task
    known = " and ".join(f"{k} is not null" for k in keys)
    w = Window.partitionBy("producer", *keys, "_lone").orderBy("exported_at", "file_id", "line_no")
    rows = ingested.select("producer", "file_id", "exported_at", "line_no", *keys, "_seen", F.when(~F.expr(known), F.xxhash64("file_id", "line_no")).alias("_lone"))
    rows = rows.select("producer", "file_id", *keys, "_seen", F.when(F.expr(known), F.lag("file_id").over(w)).alias("lag_file"), F.when(F.expr(known), F.lead("file_id").over(w)).alias("lead_file"))
    cells = rows.select("producer", "file_id", *keys, "lag_file", "lead_file", F.explode("_seen").alias("name", "cell")).where(~F.col("name").isin(list(keys)))
    number = F.expr("try_cast(cell.text as double)")
    plain = F.when(number.isNotNull(), (number + F.lit(0.0)).cast("string")).otherwise(F.concat(F.lit("text:"), F.col("cell.text")))
    h = F.xxhash64(*keys, plain)
    there = F.col("cell.type") != "null"
    kinds = [F.count(F.when(F.col("cell.type") == t, 1)).alias(f"n_{t}") for t in _TYPES]
    hashes = [F.count(F.when(there, 1)).alias("n"), F.coalesce(F.sum(F.when(there, F.pmod(h, F.lit(2147483647)))), F.lit(0)).alias("s"), F.coalesce(F.bit_xor(F.when(there, h)), F.lit(0)).alias("x")]
    parts = cells.groupBy("producer", "file_id", "name", "lag_file", "lead_file").agg(*kinds, *hashes)
    # from here on a few rows a file and name
    parts = parts.join(seq, ["producer", "file_id"]).join(nxt, ["producer", "file_id"], "left")
    side = lambda cond, out: [F.coalesce(f(F.when(F.expr(cond), F.col(c))), F.lit(0)).alias(f"{out}_{c}") for c, f in (("n", F.sum), ("s", F.sum), ("x", F.bit_xor))]
    fields = parts.groupBy("producer", "file_id", "name").agg(*(F.sum(f"n_{t}").alias(f"n_{t}") for t in _TYPES), *side("lag_file = prev_file_id", "p"), *side("lead_file = next_file_id", "q"))
    most = F.greatest(*(F.col(f"n_{t}") for t in _TYPES))
    own = F.coalesce(*(F.when((most > 0) & (F.col(f"n_{t}") == most), F.lit(t)) for t in _TYPES))
    fields = materialize(fields.withColumn("own_type", own).drop(*(f"n_{t}" for t in _TYPES)), "file-fields")

    cur = fields.join(seq.where("prev_file_id is not null"), ["producer", "file_id"]).select("producer", "file_id", "prev_file_id", "name", "own_type", "p_n", "p_s", "p_x")
    old = fields.join(nxt, ["producer", "file_id"]).select("producer", F.col("next_file_id").alias("file_id"), F.col("file_id").alias("prev_file_id"), "name", "q_n", "q_s", "q_x")
    both = cur.join(old, ["producer", "file_id", "prev_file_id", "name"], "full")
    new = both.where("q_n is null")
    gone = both.where("p_n is null")
    place = lambda *by: F.row_number().over(Window.partitionBy("producer", "file_id", *by).orderBy("name"))
    a = gone.where("q_n > 0").select("producer", "file_id", F.col("name").alias("old_name"), F.col("q_n").alias("n"), F.col("q_s").alias("s"), F.col("q_x").alias("x"), place("q_n", "q_s", "q_x").alias("k"))
    b = new.where("p_n > 0").select("producer", "file_id", "name", F.col("p_n").alias("n"), F.col("p_s").alias("s"), F.col("p_x").alias("x"), place("p_n", "p_s", "p_x").alias("k"))
    renamed = materialize(b.join(a, ["producer", "file_id", "n", "s", "x", "k"]).select("producer", "file_id", "name", "old_name"), "renames")
    added = new.select("producer", "file_id", "name").join(renamed, ["producer", "file_id", "name"], "left_anti")
    removed = gone.select("producer", "file_id", "name").join(renamed.select("producer", "file_id", F.col("old_name").alias("name")), ["producer", "file_id", "name"], "left_anti")
    kept = both.where("p_n is not null and q_n is not null").select("producer", "file_id", "name", F.col("name").alias("old_name"))
    link = kept.unionByName(renamed)

    # a field's type, carried on from the file before where it has no value: pointer jumping over the few such fields
    chain = fields.select("producer", "file_id", "name", "own_type").join(link, ["producer", "file_id", "name"], "left").join(seq, ["producer", "file_id"])
    chain = materialize(chain.select("producer", "file_id", "name", F.col("own_type").alias("type"), F.when(F.col("old_name").isNotNull(), F.col("prev_file_id")).alias("up_file"), F.col("old_name").alias("up_name")), "types")
    while chain.where("type is null and up_name is not null").limit(1).count():
        up = chain.select("producer", F.col("file_id").alias("up_file"), F.col("name").alias("up_name"), F.col("type").alias("t"), F.col("up_file").alias("f2"), F.col("up_name").alias("n2"))
        open_ = chain.where("type is null and up_name is not null").join(up, ["producer", "up_file", "up_name"], "left")
        open_ = open_.select("producer", "file_id", "name", F.col("t").alias("type"), F.when(F.col("t").isNull(), F.col("f2")).alias("up_file"), F.when(F.col("t").isNull(), F.col("n2")).alias("up_name"))
        chain = materialize(chain.where("not (type is null and up_name is not null)").unionByName(open_), "types")
    types = chain.select("producer", "file_id", "name", "type")
    before_types = types.select("producer", F.col("file_id").alias("prev_file_id"), F.col("name").alias("old_name"), F.col("type").alias("old_type"))
    changed = link.join(seq, ["producer", "file_id"]).join(types, ["producer", "file_id", "name"]).join(before_types, ["producer", "prev_file_id", "old_name"]).where("type <> old_type")
    row = lambda df, kind, old="cast(null as string)": df.selectExpr("producer", "file_id", "name as field_name", f"{old} as old_name", f"'{kind}' as change_kind")
    return row(renamed, "renamed", "old_name").unionByName(row(added, "added")).unionByName(row(removed, "removed")).unionByName(row(changed, "type_changed", "old_name"))
