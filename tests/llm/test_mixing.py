import random

import pytest
from pyspark.sql import functions as F

from posegrain.llm import mixing as M

DOCS = "doc_id bigint, source string, text string, n_tokens int, h string"


def test_token_counts(spark):
    import base64

    import tiktoken

    texts = ["hello world", None, "", "naïve — ünïcode 日本", "x" * 50_000, "hello world", "<|endoftext|>"]
    docs = spark.createDataFrame([(i, "s", t, 1, "c") for i, t in enumerate(texts)], DOCS)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(M.tokenizer_path(spark), "rb"))}
    code = tiktoken.Encoding("t", pat_str=M.PIECE_PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r.n_tokens for r in M.count_tokens(docs, "doc_id", "text", ["source"]).collect()}
    assert got == {i: len(code.encode_ordinary(t or "")) for i, t in enumerate(texts)}


def test_missing_vocabulary_is_named(spark):
    spark.conf.set(M.TOKENIZERS_CONF, "/nowhere")
    try:
        with pytest.raises(FileNotFoundError, match="posegrain.tokenizers"):
            M.tokenizer_path(spark)
    finally:
        spark.conf.unset(M.TOKENIZERS_CONF)


@pytest.mark.parametrize("blocks", [[7], [5, 5], [900, 50, 47], [700] + [10] * 30, [200, 150, 150, 100, 150, 150, 97], [1, 1000], [3, 0, 5], []])
def test_pfair_deviates_by_less_than_one_block(blocks):
    total = sum(blocks)
    done = [0] * len(blocks)
    for slot, (s, k) in enumerate(M.pfair_period(blocks), 1):
        assert k == done[s]
        done[s] += 1
        for i, n in enumerate(done):
            assert abs(n - slot * blocks[i] / total) < 1
    assert done == blocks


def counted(spark, sizes, seed=1):
    rng = random.Random(seed)
    rows, i = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            rows.append((i, source, rng.randint(0, 60)))
            i += 1
    return spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint")


def plans(spark, c, targets, **how):
    t = spark.createDataFrame(targets, "mix_name string, source string, target_share double, max_repeats int")
    return M.plan(spark, c.groupBy("source").agg(F.sum("n_tokens").alias("tokens")), t, **how)


def test_shares_caps_and_order(spark):
    c = counted(spark, {"big": 3000, "small": 200, "tiny": 40, None: 10})
    p = plans(spark, c, [("m", "big", 5.0, 1), ("m", "small", 3.0, 4), ("m", "tiny", 2.0, 9), ("m", "void", 1.0, 1), ("m", None, 1.0, 1), ("n", "big", 0.5, 0), ("n", "tiny", 0.5, None), ("n", "small", float("nan"), 2)], block_tokens=100)
    assert {(x["mix_name"], x["source"]) for x in p} == {("m", "big"), ("m", "small"), ("m", "tiny"), ("n", "tiny")}
    d = M.draw(spark, c, p)
    got = d.where("mix_name = 'm'").toPandas()
    total = got.n_tokens.sum()
    for x in p[:3]:
        mine = got[got.source == x["source"]]
        assert abs(mine.n_tokens.sum() - x["quota"]) <= 60 and abs(mine.n_tokens.sum() / total - x["target_share"]) < 0.01
        counts = mine.groupby("doc_id").size()
        assert counts.max() <= x["max_repeats"] and not mine.duplicated(["doc_id", "repeat_no"]).any()
    placed = got.sort_values(["slot", "block_no"]).groupby("slot").agg(s=("source", "first"), n=("source", "nunique"))
    assert placed.n.max() == 1
    # on the drawn documents: at every slot, no source is further from its share than a block and a document
    at = {x["source"]: 0 for x in p[:3]}
    for _, rows in got.sort_values("slot").groupby("slot"):
        at[rows.source.iloc[0]] += rows.n_tokens.sum()
        for x in p[:3]:
            assert abs(at[x["source"]] - x["target_share"] * sum(at.values())) < 100 + 2 * 60
    s = {(r.mix_name, r.source): r for r in M.shares(d, spark, p).collect()}
    assert s["m", "big"].repeats == 1 and abs(sum(r.reached_share for r in s.values() if r.mix_name == "m") - 1) < 1e-9


def test_tiny_shares_are_not_lifted(spark):
    """A share of 1e-6 stays one; blocks grow where a mix would have too many."""
    c = spark.createDataFrame([(i, "a" if i % 2 else "b", 1000) for i in range(4000)], "doc_id bigint, source string, n_tokens bigint")
    p = plans(spark, c, [("m", "a", 1.0, None), ("m", "b", 1e-6, None)], block_tokens=10, max_blocks=50)
    assert [x["quota"] for x in p] == [3_999_996, 3] and p[0]["block_tokens"] == 80_000 and [x["blocks"] for x in p] == [50, 1]
    got = {r.source: r.n_docs for r in M.shares(M.draw(spark, c, p), spark, p).collect()}
    assert got == {"a": 4000, "b": 1}


def test_no_caps_and_limits(spark):
    c = counted(spark, {"a": 50, "b": 100})
    p = plans(spark, c, [("m", "a", 1.0, None), ("m", "b", 1.0, None)])
    assert sum(x["quota"] for x in p) in range(sum(x["tokens"] for x in p) - 2, sum(x["tokens"] for x in p) + 1)
    assert sum(x["quota"] for x in plans(spark, c, [("m", "a", 1.0, None), ("m", "b", 1.0, None)], total_tokens=500)) == 500
    with pytest.raises(ValueError, match="targets"):
        plans(spark, c, [("m", "a", 1.0, None), ("m", "b", 1.0, None)], max_targets=1)


def test_empty(spark):
    c = counted(spark, {})
    p = plans(spark, c, [("m", "a", 1.0, 1)])
    assert p == [] and M.draw(spark, c, p).count() == 0 and M.shares(M.draw(spark, c, p), spark, p).count() == 0


def test_stream_positions_cover_the_source(spark, monkeypatch):
    monkeypatch.setattr(M, "BUCKET_DOCS", 7)
    c = counted(spark, {"a": 100, "b": 3})
    got = sorted((r.source, r.start, r.n_tokens) for r in M.stream_positions(c, "doc_id", 3).collect())
    for source in "ab":
        at = 0
        rows = [g for g in got if g[0] == source]
        for _, start, n in sorted(rows, key=lambda g: (g[1], g[2])):
            assert start == at
            at += n
