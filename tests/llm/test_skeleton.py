import itertools
import unicodedata

from posegrain.llm import skeleton as K

SAME = [
    ("abc", "ａｂｃ"), ("é", "é"), ("wo​rd", "word"), ("soft­hyphen", "softhyphen"), ("a b", "a b"), ("a b", "a　b"), ("scope", "ѕсоре"), ("None", "Νοne"),
    ("ё", "ë"), ("Å", "Å"), ("（x）", "(x)"), ("a️", "a"), ("ΟΚ", "OK"), ("ｅ́", "é"), ("ộ", "ộ"),
]
OTHER = [("a", "A"), ("e", "é"), ("2", "²"), ("1", "①"), ("a b", "a  b"), ("a b", "ab"), ("l", "1"), ("O", "0"), ("ß", "ss"), ("a\tb", "a b"), ("ﬁ", "fi"), ("м", "M"), ("n", "п")]


def test_same_look():
    for a, b in SAME:
        assert K.skeleton(a) == K.skeleton(b), (a, b)


def test_visible_differences_stay():
    for a, b in OTHER:
        assert K.skeleton(a) != K.skeleton(b), (a, b)


def test_skeleton_is_stable():
    for cp in range(0x30000):
        if not 0xD800 <= cp < 0xE000:
            s = K.skeleton(chr(cp))
            assert K.skeleton(s) == s and unicodedata.normalize("NFD", s) == s


def test_pairs_against_all_pairs(spark):
    texts = ["scope", "ѕсоре", "scope", "ｓcope", "Scope", None, "", "", "x" * 200_000, "x" * 199_999 + "х", "a b", "a b", "only"]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id bigint, text string, look string")
    got = sorted(tuple(r) for r in K.same_look_pairs(K.fingerprints(docs)).collect())
    want = sorted((i, j) for (i, a), (j, b) in itertools.combinations(enumerate(texts), 2) if a is not None and b is not None and a != b and K.skeleton(a) == K.skeleton(b))
    assert got == want and len(got) == 7
    got = {r.doc_id: r for r in K.classes(K.fingerprints(docs)).collect()}
    assert len(got) == len(texts) - 1
    for i, r in got.items():
        look = [j for j, t in enumerate(texts) if t is not None and K.skeleton(t) == K.skeleton(texts[i])]
        assert (r.class_id, r.n_documents, r.n_spellings) == (min(look), len(look), len({texts[j] for j in look}))
        assert r.n_links == sum(texts[j] != texts[i] for j in look) == sum(i in p for p in want)


def test_hot_classes(spark):
    """Two spellings that hundreds of documents share, in a table with a third of all rows the same."""
    texts = ["scope"] * 300 + ["ѕсоре"] * 3 + [f"t{i}" for i in range(500)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert K.same_look_pairs(K.fingerprints(docs)).count() == 900
    assert {r.n_links for r in K.classes(K.fingerprints(docs)).where("n_spellings = 2").collect()} == {3, 300}


def test_empty_and_texts(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert K.same_look_pairs(K.fingerprints(docs)).count() == 0
    d = K.with_skeleton(spark.createDataFrame([(1, "Νοne"), (2, None), (3, "")], "doc_id bigint, text string"))
    assert {r.doc_id: r.skeleton for r in d.collect()} == {1: "None", 2: None, 3: ""}
