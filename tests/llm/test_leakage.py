import random
import re

import numpy as np
import pytest

from posegrain.llm import leakage as L

WORDS = [f"w{i}" for i in range(400)]


def found(spark, docs, items, **how):
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string").withColumnRenamed("doc_id", "doc_id")
    i = spark.createDataFrame([(100 + k, t) for k, t in enumerate(items)], "item_id bigint, text string")
    return L.leaks(d, i, **how)


def exact(spark, docs, items, **how):
    return sorted((r.item_id - 100, r.doc_id) for r in found(spark, docs, items, **how).where("in_order").collect())


def brute(docs, items, window=12):
    split = lambda t: re.findall(r"[^\W_]+", L.plain(t or ""))
    out = []
    words = [split(x) for x in docs]
    runs_of = {n: [{tuple(w[k : k + n]) for k in range(len(w) - n + 1)} for w in words] for n in range(1, window + 1)}
    for i, t in enumerate(items):
        w = split(t)
        n = min(window, len(w))
        runs = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()
        out += [(i, d) for d in range(len(docs)) if n and runs & runs_of[n][d]]
    return sorted(out)


def corpus(seed=1):
    rng = random.Random(seed)
    items = [" ".join(rng.choices(WORDS, k=rng.choice([1, 3, 5, 8, 11, 12, 13, 40]))) for _ in range(40)] + ["", None, "!!!", "w1 w1 w1 w1"]
    docs = []
    for _ in range(120):
        w = rng.choices(WORDS, k=rng.randint(0, 60))
        if rng.random() < 0.7:
            item = (rng.choice(items) or "").split()
            n = rng.choice([11, 12, 14, 40])
            at = rng.randint(0, max(0, len(item) - n))
            p = rng.randint(0, len(w))
            w[p:p] = item[at : at + n]
        docs.append(rng.choice([" ", "\n", "... ", " _ "]).join(w))
    return [*docs, None, "", "w1 w1 w1 w1 w1", " ".join(WORDS * 5)], items


@pytest.mark.parametrize("how", [{"radius": 0}, {"radius": 3, "shingle": 5}, {}])
def test_against_brute_force(spark, how):
    docs, items = corpus()
    got = exact(spark, docs, items, **how)
    assert got == brute(docs, items) and len(got) > 40


def test_parts_of_items_and_repeated_rows(spark):
    docs, items = corpus(2)
    items, docs = items + items[:3], docs + docs[:3]
    assert exact(spark, docs, items, part_chars=300) == brute(docs, items)


def test_disguised_text(spark):
    item = "The quick brown fox jumps over the lazy dog and runs far away"
    docs = [item.upper(), item.replace("o", "о"), "x, " + item.replace(" ", " -- ").replace("quick", "qu​ick"), "ｔｈｅ" + item[3:], item.replace("fox", "cat"), item[4:], " ".join(item.split()[:12])]
    assert exact(spark, docs, [item]) == [(0, 0), (0, 1), (0, 2), (0, 3), (0, 5), (0, 6)]


def test_windows_do_not_cross_documents(spark):
    assert exact(spark, ["a b c d e f", "g h i j k l"], ["a b c d e f g h i j k l", "f g"]) == []


def test_all_within_the_radius_are_found():
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(WORDS, 12)) for _ in range(500)]
    (w,) = L.item_windows(texts, 12, 1)
    assert len(w.prints) == 500
    for radius in (0, 1, 3, 7, 11):
        probe = w.prints.copy()
        for i in range(500):
            for b in rng.choice(64, rng.integers(0, radius + 3), replace=False):
                probe[i] ^= np.uint64(1 << int(b))
        got = {(p, u) for x, y in w.near(probe, radius) for p, u in zip(x.tolist(), y.tolist(), strict=True)}
        assert got == {(i, j) for i in range(500) for j in range(500) if int(probe[i] ^ w.prints[j]).bit_count() <= radius}


def test_simhash_is_the_majority():
    rng = np.random.default_rng(2)
    s = rng.integers(0, 2**63, 300).astype(np.uint64)
    for m in (1, 2, 5, 8, 31, 130):
        want = [sum(((sum((int(x) >> b) & 1 for x in s[i : i + m]) * 2 > m) << b) for b in range(64)) for i in range(300 - m + 1)]
        assert L.simhashes(s, m).tolist() == want
        assert L.simhashes(s, m, np.array([3, 7])).tolist() == [want[3], want[7]]
    assert len(L.simhashes(s, 301)) == 0


def test_radius_follows_from_the_window():
    assert L.shared_needed(12, 0.8) == 11 and L.shared_needed(8, 0.8) == 8 and L.shared_needed(12, 1.0) == 12
    assert L.radius_for(8, 0.8) == 3  # all shingles are shared: no bit differs
    rng = np.random.default_rng(4)
    s = rng.integers(0, 2**63, 12 * 2000).astype(np.uint64).reshape(2000, 12)
    t = s.copy()
    t[:, 5] = rng.integers(0, 2**63, 2000).astype(np.uint64)
    a, b = (L.simhashes(x.ravel(), 12, np.arange(2000) * 12) for x in (s, t))
    assert (np.bitwise_count(a ^ b) <= L.radius_for(12, 0.8)).mean() >= 0.95


def test_similar_passages(spark):
    item = " ".join(WORDS[:12])
    d = {r.doc_id: r for r in found(spark, [item, " ".join(WORDS[:12] + ["x"])], [item]).collect()}
    assert d[0].similarity == 1.0 and d[0].n_windows == 1 and d[1].in_order
    assert L.weighted_jaccard(np.array([[1, 1, 2]], np.uint64), np.array([[1, 2, 2]], np.uint64)).tolist() == [0.5]


def test_weighted_jaccard_against_counters():
    from collections import Counter

    rng = np.random.default_rng(5)
    a, b = (rng.integers(0, 6, (200, 9)).astype(np.uint64) for _ in range(2))
    want = [sum((x & y).values()) / sum((x | y).values()) for x, y in ((Counter(p), Counter(q)) for p, q in zip(a.tolist(), b.tolist(), strict=True))]
    assert np.allclose(L.weighted_jaccard(a, b), want)


def edited(rng, words, kind, step):
    """One word in ``step`` exchanged, dropped or put in, beginning at a random one."""
    out, first = [], rng.randrange(step)
    for k, w in enumerate(words):
        hit = k % step == first
        if kind == "put in" and hit:
            out.append("neu%d" % rng.randrange(10**6))
        if not (kind == "dropped" and hit):
            out.append("neu%d" % rng.randrange(10**6) if kind == "exchanged" and hit else w)
    return out


@pytest.mark.parametrize("kind", ["exchanged", "dropped", "put in"])
def test_recall_of_edited_passages(spark, kind):
    """Planted copies with a tenth of their words edited: at least 0.9 of them are found, and no document without a copy."""
    rng = random.Random(kind)
    long = [" ".join(f"v{rng.randrange(3000)}" for _ in range(rng.randint(24, 60))) for _ in range(200)]
    short = [" ".join(f"v{rng.randrange(3000)}" for _ in range(12)) for _ in range(200)]
    filler = lambda: [f"v{rng.randrange(3000)}" for _ in range(40)]
    docs = [" ".join(filler() + edited(rng, t.split(), kind, 10 if t in long else 12) + filler()) for t in [*long, *short]]
    docs += [" ".join(filler()) for _ in range(200)]
    got = {(r.item_id - 100, r.doc_id) for r in found(spark, docs, [*long, *short]).collect()}
    hits = [(k, k) in got for k in range(400)]
    assert sum(hits[:200]) >= 190 and sum(hits[200:]) >= 180
    assert all(i == d for i, d in got)


@pytest.mark.parametrize("at", [0, 6, 11])
def test_one_word_of_twelve_exchanged(spark, at):
    rng = random.Random(at)
    items = [[f"v{rng.randrange(3000)}" for _ in range(12)] for _ in range(200)]
    docs = [" ".join([*w[:at], "anders", *w[at + 1 :]]) for w in items]
    got = {(r.item_id - 100, r.doc_id) for r in found(spark, docs, [" ".join(w) for w in items]).collect()}
    assert sum((k, k) in got for k in range(200)) >= 180


def test_hot_windows_and_clashing_columns(spark):
    """A passage that many items and many places of many documents hold."""
    common = " ".join(WORDS[:14])
    docs = [" ".join([common] * 30)] * 20 + ["nothing"]
    items = [common + f" tail{k}" for k in range(40)]
    got = found(spark, docs, items).collect()
    assert {(r.item_id - 100, r.doc_id) for r in got} == {(i, d) for i in range(40) for d in range(20)}
    assert all(r.in_order and r.n_windows >= 30 * 3 for r in got)
    d = spark.createDataFrame([(1, common, 5, 0.5)], "doc_id bigint, text string, item_id int, similarity double")
    i = spark.createDataFrame([("a", common, 7)], "item_id string, text string, doc_id int")
    assert [(r.item_id, r.doc_id) for r in L.leaks(d, i).collect()] == [("a", 1)]


def test_empty_tables(spark):
    assert exact(spark, [], ["a b"]) == [] and exact(spark, ["a b"], []) == []
