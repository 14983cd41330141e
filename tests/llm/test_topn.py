import random

from posegrain.llm import topn as T

SCHEMA = "a string, b string, s double, t bigint, u bigint, neg_score int, bucket string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 7, "clash") for r in rows], SCHEMA)


def brute(rows, n):
    groups = {}
    for r in rows:
        if None not in r and r[2] == r[2]:
            groups.setdefault(r[:2], []).append(r)
    return sorted(r for g in groups.values() for r in sorted(g, key=lambda r: (-r[2], r[3], r[4]))[:n])


def top(spark, rows, n, **how):
    d = T.top_n(frame(spark, rows).repartition(3), ["a", "b"], "s", ["t", "u"], n, **how)
    return sorted((r.a, r.b, r.s, r.t, r.u) for r in d.collect())


def test_against_sorting(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot", "hot", "x", "y", "z", "é", "\U0001f600", "", None]), rng.choice(["p", "q", None]), rng.choice([0.5, 0.5, rng.random(), float("nan"), None, -0.0, 0.0]), rng.randint(0, 5), rng.choice([1, 2, None])) for _ in range(4000)]
    for n in (1, 3, 50):
        assert top(spark, rows, n) == brute(rows, n)


def test_more_runs_than_are_merged_at_once(spark):
    rng = random.Random(3)
    rows = [(rng.choice("abcdef"), "h", rng.choice([0.5, rng.random()]), i, i) for i in range(3000)]
    d = frame(spark, rows).repartition(11)
    got = T.top_n(d, ["a", "b"], "s", ["t", "u"], 4, n_buckets=5, fan_in=2)
    assert sorted((r.a, r.b, r.s, r.t, r.u) for r in got.collect()) == brute(rows, 4)


def test_large_groups_seek(spark, monkeypatch):
    monkeypatch.setattr(T, "ROW_GROUP_BYTES", 4096)
    rows = [("hot", "h", float(i * 7919 % 100003), i, i) for i in range(40000)] + [("z", "h", 1.0, 1, 1)]
    assert top(spark, rows, 3, n_buckets=1) == brute(rows, 3)


def test_repeated_rows_and_ranks(spark):
    rows = [("g", "h", 1.0, 1, 1)] * 3 + [("g", "h", 2.0, 9, 9)]
    d = T.top_n(frame(spark, rows), ["a", "b"], "s", ["t", "u"], 3, payload=["neg_score", "bucket"])
    assert sorted((r["rank"], r.s, r.neg_score, r.bucket) for r in d.collect()) == [(1, 2.0, 7, "clash"), (2, 1.0, 7, "clash"), (3, 1.0, 7, "clash")]


def test_empty_and_all_null(spark):
    assert top(spark, [], 3) == [] and top(spark, [(None, "b", 1.0, 1, 1), ("a", "b", None, 1, 1)], 3) == []


def test_loser_tree():
    rng = random.Random(2)
    for k in (0, 1, 2, 3, 5, 8, 13):
        runs = [sorted(((rng.randint(0, 9),), (i,)) for _ in range(rng.randint(0, 20))) for i in range(k)]
        tree, got = T.LoserTree([iter(r) for r in runs]), []
        while (x := tree.pop()) is not None:
            got.append(x)
        assert got == sorted(x for r in runs for x in r)
