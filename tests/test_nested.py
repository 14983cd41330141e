import json
from datetime import datetime

from posegrain.operators import nested as N

T = datetime(2025, 1, 1)
RAW = "packet_id bigint, loaded_at timestamp, body string"


def packets(spark, bodies):
    rows = [(i, T, b if b is None or isinstance(b, str) else json.dumps(b)) for i, b in enumerate(bodies)]
    return N.normalize(spark.createDataFrame(rows, RAW))


def joints(spark, *coords):
    d = packets(spark, [{"predictions": {"baseline": {"coords": c}}} for c in coords])
    return sorted((r.packet_id, r.kp_idx, r.x, r.y, r.score) for r in N.child_table(d, "joints").collect())


def test_three_forms_of_coordinates_are_one(spark):
    lists, objects, flat = [[1, 2, 0.5], [3, 4.5, 1]], [{"kp_idx": 1, "x": 3, "y": 4.5, "score": 1}, {"kp_idx": 0, "x": 1, "y": 2, "score": 0.5}], [1, 2, 0.5, 3, 4.5, 1]
    got = joints(spark, lists, objects, flat)
    for i in range(3):
        assert [g[1:] for g in got if g[0] == i] == [(0, 1.0, 2.0, 0.5), (1, 3.0, 4.5, 1.0)]


def test_nulls_and_incomplete_parts(spark):
    got = joints(spark, [[1, None, 0.5], None, [2]], [{"kp_idx": 3}], [], None, [None], [1, 2], "text", {"a": 1})
    assert [g[:2] + (g[2], g[3]) for g in got] == [(0, 0, 1.0, None), (0, 2, 2.0, None), (1, 3, None, None), (5, 0, 1.0, 2.0)]


def test_potentials_in_all_forms(spark):
    cov = [[1, 0], [0, 2]]
    listed = [
        {"kp_idx": 0, "means": [[1, 2], [3, 4]], "covariances": [cov, cov], "weights": [0.5, 0.4]},
        {"kp_idx": 1, "means": [1, 2], "covariances": cov, "weights": 0.5},
        {"kp_idx": 2, "means": {"x": 1, "y": 2}, "covariances": [cov], "weights": [0.5]},
        {"kp_idx": 3, "means": [{"x": 1, "y": 2}, None], "covariances": [cov, None], "weights": [0.5, None]},
        {"kp_idx": 4, "means": [], "covariances": None},
        {"kp_idx": 5, "means": [[1, 2]], "covariances": [], "weights": [None]},
        None,
    ]
    keyed = {str(u["kp_idx"]): {k: v for k, v in u.items() if k != "kp_idx"} for u in listed if u}
    d = packets(spark, [{"unary": listed}, {"unary": keyed}, {"unary": None}, {}, None, "no json", {"unary": []}])
    got = {(r.packet_id, r.kp_idx): (r.n_means, r.n_covariances, r.n_weights) for r in N.child_table(d, "potentials").collect()}
    want = {0: (2, 2, 2), 1: (1, 1, 1), 2: (1, 1, 1), 3: (1, 1, 1), 4: (0, 0, 0), 5: (1, 0, 0)}
    assert got == {(p, k): v for p in (0, 1) for k, v in want.items()}
    c = {(r.kp_idx, r.cand_idx): (r.mx, r.my, r.cxx, r.cyy, r.weight) for r in N.child_table(d, "candidates").where("packet_id = 0").collect()}
    assert c[0, 1] == (3.0, 4.0, 1.0, 2.0, 0.4) and c[1, 0] == (1.0, 2.0, 1.0, 2.0, 0.5) and c[5, 0] == (1.0, 2.0, None, None, None) and (4, 0) not in c


def test_the_other_lists(spark):
    one = {"ground_truth": {"bboxes": [1, 2, 3, 4, 5, 6]}, "tta_data": [{"aug_id": 3, "label": "flip", "params": {"a": 1, "b": "x"}}, None, {"label": "blur"}], "config_used": {"tta": {"flip": True}, "seed": 7, "model": {"input": [1, 2]}}}
    d = packets(spark, [one, {"ground_truth": {"bboxes": [[1, 2, 3, 4], None, [5, 6, 7, 8]]}, "tta_data": "none", "config_used": []}, {}])
    rows = lambda t: sorted((tuple(r)[0], *tuple(r)[2:]) for r in N.child_table(d, t).collect())
    assert rows("boxes") == [(0, 0, 1.0, 2.0, 3.0, 4.0), (0, 1, 5.0, 6.0, None, None), (1, 0, 1.0, 2.0, 3.0, 4.0), (1, 2, 5.0, 6.0, 7.0, 8.0)]
    assert rows("tta") == [(0, 0, 3, "flip"), (0, 2, None, "blur")]
    assert rows("tta_params") == [(0, 0, "a", "1"), (0, 0, "b", "x")]
    got = {(r.section, r.name): r.value for r in N.child_table(d, "config").collect()}
    assert got == {("tta", "flip"): "true", ("seed", None): "7", ("model", "input"): "[1,2]"}


def test_missing_children(spark):
    full = [[1, 2, 3]] * 17
    d = packets(spark, [{"predictions": {"baseline": {"coords": full}, "ours_gmm": None}}, {"predictions": {"ours_gmm": {"coords": full[:16]}}}, {"predictions": {"baseline": {}}}, {"unary": [{"kp_idx": 7, "means": [[1, 2]], "weights": []}]}])
    got = sorted(tuple(r) for r in N.missing_children(d).collect())
    assert got == sorted([(1, "ours_gmm", 16)] + [(2, "baseline", k) for k in range(17)] + [(3, "unary", 7)])


def test_latest_delivery_ties_and_empty(spark):
    rows = [(1, T, "a"), (1, datetime(2025, 2, 1), "b"), (2, None, "c"), (2, T, "d"), (3, T, "x"), (3, T, "x")]
    d = N.latest_delivery(spark.createDataFrame(rows, RAW), tie="body")
    assert sorted((r.packet_id, r.body) for r in d.collect()) == [(1, "b"), (2, "d"), (3, "x")]
    empty = N.normalize(spark.createDataFrame([], RAW))
    assert all(t.count() == 0 for t in N.flatten(empty).values()) and N.missing_children(empty).count() == 0


def test_extra_columns_do_not_clash(spark):
    d = spark.createDataFrame([(1, T, "{}", "x", 1)], RAW + ", predictions string, v int")
    assert N.normalize(d).count() == 1
