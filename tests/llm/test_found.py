"""Phrases, exact top-k and spelling variants against brute force."""

import random

import numpy as np
import pytest

import brute
from cuewise.llm import op11_phrases, op12_pivot_topk, op13_variants


def rows_of(df, *cols):
    return {tuple(r) for r in df.select(*cols).collect()}


PHRASE = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def check_phrases(df, **limits):
    out = op11_phrases.collocations(df, **limits)
    assert tuple(out.columns) == PHRASE
    got = out.collect()
    want = brute.collocations([tuple(r) for r in df.select("lang", "text").collect()], **limits)
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    return want


# ---------------------------------------------------------------- 11: phrases

def test_automata_keep_paths_and_weights():
    rng = np.random.default_rng(5)
    for n in (0, 1, 50, 3000):
        w = rng.integers(1, 9, (n, 4)).astype(np.uint64)
        w[rng.random(n) < 0.3, 3] = 0
        w[(rng.random(n) < 0.2) & (w[:, 3] == 0), 2] = 0
        high, low, weight = op11_phrases._added((w[:, 0] << np.uint64(32)) | w[:, 1], (w[:, 2] << np.uint64(32)) | w[:, 3], rng.integers(1, 900, n))
        back = op11_phrases.paths_of(op11_phrases.automaton(high, low, weight))
        assert all((a == b).all() for a, b in zip(back, (high, low, weight)))


def test_phrases_of_documents(docs):
    assert check_phrases(docs, least=8) != set()


def test_phrases_across_edges_of_ranges(spark, monkeypatch):
    """One pair of words holds most of the text, so it runs over many ranges."""
    rng = random.Random(2)
    rows = [(rng.choice(["en", "de", None]), " ".join(rng.choice(["of the", "of the", f"w{rng.randrange(40)}", "A,", "b. c", "x\ty"]) for _ in range(rng.randrange(60)))) for _ in range(400)]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(7)
    original = op11_phrases.units
    monkeypatch.setattr(op11_phrases, "units", lambda docs: original(docs, 2000))
    want = check_phrases(df, least=5)
    assert any(p == "of the" or "of the" in p for _, _, p, *_ in want)
    check_phrases(df, least=5, most=7)


def test_phrases_of_odd_input(spark, odd_docs, no_docs):
    for least in (1, 2):
        check_phrases(odd_docs.where("n_chars is null").where("length(coalesce(text, '')) < 1000").unionByName(odd_docs.limit(6).where("length(text) < 50 or text is null")), least=least)
    check_phrases(odd_docs, least=30)
    check_phrases(no_docs)
    df = spark.createDataFrame([("en", "É é ß, ß ß É"), ("und", "a b"), (None, "a b a b"), ("en", "\x0b\x0c\r\n;"), ("fr", "a\x00b c d e f")] * 3, "lang string, text string")
    check_phrases(df, least=2)


# ---------------------------------------------------------------- 12: exact top-k

def check_top(df, **kw):
    got = op12_pivot_topk.top_k(df, **kw)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    got = [tuple(r) for r in got.collect()]
    want = brute.best_products([tuple(r) for r in df.select("vec_id", "embedding").collect()], **kw)
    assert set(got) == want and len(got) == len(want)
    return want


def test_top_of_clusters_is_exact_and_skips(spark, monkeypatch):
    monkeypatch.setattr(op12_pivot_topk, "BLOCK", 150)
    monkeypatch.setattr(op12_pivot_topk, "QUERIES", 20)
    rng = np.random.default_rng(8)
    centre = rng.normal(size=(6, 8))
    data = [(i, (centre[i % 6 if i % 3 else 0] + 0.05 * rng.normal(size=8)).tolist()) for i in range(900)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").repartition(5)
    seen = []
    check_top(df, every=10)
    # One block, asked directly: far fewer products than pairs.
    y = np.floor(64 * np.array([e for _, e in data]))
    pivots = op12_pivot_topk._pivots(list(y), 8)
    dist = np.sqrt(((y[:, None] - pivots[None]) ** 2).sum(2))
    original = op12_pivot_topk.products
    monkeypatch.setattr(op12_pivot_topk, "products", lambda q, c: seen.append(len(q) * len(c)) or original(q, c))
    for q in range(0, 900, 90):
        one = [q]
        op12_pivot_topk.search(y[one], dist[one], np.array([-np.inf]), np.array(one), np.arange(900), y, np.ascontiguousarray(dist.T), (y * y).sum(1), 20)
    assert sum(seen) < 0.6 * 900 * 10


@pytest.mark.parametrize("k", [1, 3, 20])
def test_top_with_ties_and_equal_vectors(spark, k):
    rng = np.random.default_rng(k)
    data = [(i, [float(x) for x in (rng.integers(-2, 3, 4) / 64 if i % 3 else np.array([1, 0, 0, 1]) / 64)]) for i in range(-40, 160)]
    check_top(spark.createDataFrame(data, "vec_id long, embedding array<float>"), k=k, every=20)


def test_top_of_odd_vectors(spark):
    rows = [(0, [1.0, 2.0], "x"), (20, [0.5, None], "x"), (1, None, None), (2, [float("nan"), 1.0], None), (3, [float("inf"), 1.0], "y"), (4, [], "y"), (None, [3.0, 3.0], "z"),
            (40, [-1.0], None), (40, [-2.0], None), (5, [1e20, -1e20, 1.0], "t"), (60, [1e16, 1e16, -3.0], "t"), (6, [-0.01, 0.01], "u"), (6, [-0.01, 0.01], "u"), (-20, [0.0, 0.0], "u")]
    df = spark.createDataFrame([(i, e, s, k, k) for k, (i, e, s) in enumerate(rows)], "vec_id long, embedding array<double>, rank string, cell int, part int")
    check_top(df)
    assert op12_pivot_topk.top_k(df.limit(0)).count() == 0
    assert op12_pivot_topk.top_k(df.where("vec_id = 1")).count() == 0
    assert op12_pivot_topk.top_k(df.where("vec_id in (1, 2, 3, 4) or vec_id is null")).count() == 0


def test_top_of_the_given_table(spark, sf):
    check_top(spark.read.parquet(f"{sf}/embeddings.parquet"))


# ---------------------------------------------------------------- 13: spelling variants

VARIANT = ("word", "form", "root", "n", "n_near", "form_n")


def check_variants(df, **kw):
    got = op13_variants.group_variants(op13_variants.count_words(df, **kw))
    assert tuple(got.columns) == VARIANT
    rows = [tuple(r) for r in got.collect()]
    want = brute.spelling_variants([tuple(r) for r in df.select("doc_id", "text").collect()], **kw)
    assert set(rows) == want and len(rows) == len(want)
    return want


def test_variants_of_documents(docs):
    assert any(form for _, form, *_ in check_variants(docs))


@pytest.mark.parametrize("seed", [1, 2])
def test_variants_of_dense_words(spark, seed):
    """Few letters and short words, so that every kind of edit occurs, also within one part and across many."""
    rng = random.Random(seed)
    letters = "abcetiöéÿ" if seed == 1 else "ao"
    rows = [(i, " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(4, 9))) for _ in range(60))) for i in range(150)]
    check_variants(spark.createDataFrame(rows, "doc_id long, text string"), least_chars=4, least_count=1, lose_every=7)


def test_forms_are_followed_to_the_last(spark):
    n, word, text = 1, "abcdefgh", []
    for k in range(6):
        text += [word] * n
        word, n = word[:k] + "x" + word[k + 1:], 5 * n
    df = spark.createDataFrame([(k, " ".join(text[k::3])) for k in range(3)], "doc_id long, text string")
    want = check_variants(df, least_count=1, lose_every=1 << 40)
    assert max(w[3] for w in want) == 5 ** 5 and len({w[2] for w in want if w[1]}) == 1


def test_variants_of_odd_input(spark, odd_docs, no_docs):
    check_variants(odd_docs)
    check_variants(odd_docs, least_chars=1, least_count=1, lose_every=2)
    check_variants(no_docs)
    check_variants(spark.createDataFrame([(1, "ABCÀabc×÷abc İstanbul straße-naïve " * 9), (None, "abcàabc×÷abc straßé Naïves " * 9)], "doc_id long, text string"), least_chars=2, lose_every=3)
