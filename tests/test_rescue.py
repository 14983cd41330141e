import json
from datetime import datetime, timedelta

from posegrain.operators import rescue as R

T = datetime(2025, 1, 1)
LINES = "producer string, file_id bigint, exported_at timestamp, arrived_at timestamp, line_no int, record string"
SCHEMA = {"image_id": "bigint", "kp_idx": "int", "a": "int", "b": "double"}
KEEP = ["producer", "file_id", "exported_at", "line_no"]


def lines(spark, files, producer="p"):
    rows = [(producer, f, T + timedelta(hours=f * 7), T, i, r if r is None or isinstance(r, str) else json.dumps(r)) for f, recs in enumerate(files) for i, r in enumerate(recs)]
    return spark.createDataFrame(rows, LINES)


def changes(spark, files):
    d = R.drift(R.ingest(R.latest_lines(lines(spark, files)), SCHEMA, KEEP))
    return {(r.file_id, r.field_name, r.change_kind) for r in d.collect()}


def rec(k, **values):
    return {"image_id": k, "kp_idx": 0} | values


def test_ingest_types_and_rescue(spark):
    rows = [rec(1, a=3, b=2), rec(2, a="7", b=[2.5], c={"x": None}), rec(3, a=1.0, b=None), "no json", None, "[1]", rec(4)]
    got = {r.line_no: r for r in R.ingest(lines(spark, [rows]), SCHEMA, KEEP).collect()}
    assert (got[0].a, got[0].b, got[0]._rescued) == (3, 2.0, None)
    assert got[1].a is None and json.loads(got[1]._rescued) == {"a": "7", "b": [2.5], "c": {"x": None}}
    assert got[2].a is None and json.loads(got[2]._rescued)["a"] == 1.0 and got[2].b is None
    assert json.loads(got[3]._rescued) == {"_record": "no json"} and got[4]._rescued is None and json.loads(got[5]._rescued) == {"_record": "[1]"}
    assert got[6]._rescued is None


def test_promote_replays(spark):
    rows = [rec(1, a=3, b=2), rec(2, a="7", bb=[2.5], c=1), rec(3, A=2.0, b="x"), rec(4, a=2.5)]
    d = R.promote(R.ingest(lines(spark, [rows]), SCHEMA, KEEP), {"a": ["A"], "b": ["bb"]}, SCHEMA)
    got = {r.image_id: (r.a, r.b, r._rescued and json.loads(r._rescued)) for r in d.collect()}
    assert got == {1: (3, 2.0, None), 2: (7, 2.5, {"c": 1}), 3: (2, None, {"b": "x"}), 4: (None, None, {"a": 2.5})}


def test_all_kinds_of_change(spark):
    f0 = [rec(k, a=k, b=k / 2 + 0.25, g=1) for k in range(6)]
    f1 = [rec(k, aa=str(k), b=k / 2 + 0.25, n=5.5) for k in range(3, 9)]
    f2 = [rec(k, aa=None, b=k, n=5.5) for k in range(6, 12)]
    f3 = [rec(k, aa=k, b=k, n=5.5) for k in range(9, 15)]
    got = changes(spark, [f0, f1, f2, f3])
    assert got == {(1, "aa", "renamed"), (1, "aa", "type_changed"), (1, "n", "added"), (1, "g", "removed"), (2, "b", "type_changed"), (3, "aa", "type_changed")}


def test_type_without_values_stays(spark):
    f = [[rec(0, a=1), rec(1, a=2)], [rec(1, a=None), rec(2)], [rec(2, a=None)], [rec(2, a="x")], [rec(9, a="y")]]
    assert changes(spark, f) == {(3, "a", "type_changed")}


def test_no_shared_rows_or_all_null_is_no_rename(spark):
    assert changes(spark, [[rec(0, a=1)], [rec(1, aa=1)]]) == {(1, "aa", "added"), (1, "a", "removed")}
    assert changes(spark, [[rec(0, a=None)], [rec(0, aa=None)]]) == {(1, "aa", "added"), (1, "a", "removed")}


def test_repeated_delivery_and_majority(spark):
    f0 = [rec(k, a=1.5) for k in range(3)]
    f1 = [rec(0, a=1.5), rec(1, a="n/a"), rec(2, a=2.5)]
    d = lines(spark, [f0, f1])
    twice = d.unionByName(d.withColumn("arrived_at", d.exported_at))
    got = R.drift(R.ingest(R.latest_lines(twice), SCHEMA, KEEP)).count()
    assert got == 0 and R.latest_lines(twice).count() == 6


def test_several_producers_nulls_and_empty(spark):
    a, b = lines(spark, [[rec(0, a=1)], [rec(0, a=1)]], "p"), lines(spark, [[rec(0, q=1)], [rec(0, a=1)]], "q")
    d = R.drift(R.ingest(a.unionByName(b).unionByName(lines(spark, [[rec(0, z=1)]], None)), SCHEMA, KEEP))
    assert {(r.producer, r.field_name, r.change_kind) for r in d.collect()} == {("q", "a", "renamed")}
    assert R.drift(R.ingest(lines(spark, []), SCHEMA, KEEP)).count() == 0


def test_type_tokens(spark):
    f = [[rec(0, a=1, b=1, c=True)], ['{"image_id": 0, "kp_idx": 0, "a": 1.0, "b": 1e0, "c": true}']]
    assert changes(spark, f) == {(1, "a", "type_changed"), (1, "b", "type_changed")}
