"""The ten operators against brute force, and their defined results for odd input."""

import collections
import json
import math
import random
import zlib

import numpy as np
import pytest

import brute
from cuewise.llm import op1_planes, op2_decontaminate, op3_quality, op4_mixing, op5_tool_calls, op6_lsh_forest, op7_repeats, op8_main_text, op9_embeddings, op10_ngram_lm
from pyspark.sql import functions as F


def rows_of(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def pairs(df):
    return rows_of(df, "doc_id", "text")


# ---------------------------------------------------------------- 1: planes

@pytest.fixture(scope="module")
def tokenizer():
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    return path, Tokenizer.from_file(path)


@pytest.mark.parametrize("bits", [False, True])
def test_planes_round_trip(bits):
    rng = np.random.default_rng(1)
    for ids in (rng.integers(0, 49408, 1000), np.array([2**32 - 1, 0]), np.zeros(7, int), np.array([5])):
        planes = op1_planes.transposed(ids.astype("<u4"), bits)
        assert (op1_planes.restored(planes, len(ids), bits) == ids).all()


def test_ids_equal_the_tokenizer(spark, docs, odd_docs, tokenizer):
    path, tok = tokenizer
    for df in (docs, odd_docs):
        out = op1_planes.encode(df, path, block=1000)
        got = sorted(rows_of(op1_planes.read(spark, out), "start", "doc_id", "n_tokens", "ids_crc32"))
        want = brute.token_rows(pairs(df), tok)
        assert [(s, d, n, c) for s, d, n, c in got if d != 3] == [(s, d, n, c) for d, s, n, c in want if d != 3]
        assert collections.Counter((d, n, c) for _, d, n, c in got) == collections.Counter((d, n, c) for d, _, n, c in want)
        index = spark.read.parquet(f"{out}/index")
        assert index.agg(F.sum("n")).first()[0] == sum(n for *_, n, _ in want)


def test_ids_come_back_with_bit_planes(spark, odd_docs, tokenizer):
    path, tok = tokenizer
    out = op1_planes.encode(odd_docs, path, block=64, bits=True)
    got = collections.Counter((d, tuple(i)) for d, i in rows_of(op1_planes.read(spark, out, "ids", bits=True), "doc_id", "ids"))
    assert got == collections.Counter((d, tuple(tok.encode(t or "", add_special_tokens=False).ids + [1])) for d, t in pairs(odd_docs))


def test_ids_of_separators_added_tokens_and_letters_that_decompose(spark, tokenizer):
    path, tok = tokenizer
    texts = ["alpha\x1cbeta", "a \x1d b\x1e\x1f", "<|STARTOFTEXT|> a", "x<|startoftext|>Y <|endoftext|>", "<|StartOfText|>\x1cÉ", "İ, b", "\u0958, \ufb2a. c", "É, b\x85c\u2003d", "\x1c",
             "don't 'tis IT'S o'é rock'n'roll", "a1b22c\x003 (x).[y]", "É\u0323 e\u0301 ÀÖ×÷ß ªº µ", "中文 字\u3000字 ñandú\xa0ok", "x" * 70000, "İ' 1'2", "a\u200bb"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(rows_of(op1_planes.read(spark, op1_planes.encode(df, path)), "doc_id", "start", "n_tokens", "ids_crc32"))
    assert got == brute.token_rows(list(enumerate(texts)), tok)


def test_words_are_cut_at_the_tokenizers_white_space():
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    assert {c for c in every if c.isspace()} == {c for c in every if op1_planes.SPACE.fullmatch(c)} | set(op1_planes.SEPARATORS)


def test_ids_of_no_documents(spark, no_docs, tokenizer):
    assert op1_planes.read(spark, op1_planes.encode(no_docs, tokenizer[0])).count() == 0


# ---------------------------------------------------------------- 2: decontamination

def test_leaks_equal_containment(spark, docs, doc_rows, sf):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    got = set(rows_of(op2_decontaminate.find_leaks(docs, items), "doc_id", "item_id"))
    assert got == brute.contains(doc_rows, rows_of(items, "item_id", "text")) != set()


def test_retrieval_equals_full_scores():
    rng = random.Random(3)
    vocab = [np.uint64(rng.getrandbits(64)) for _ in range(60)]
    items = [{"item_id": i, "segment": 0, "words": [int(np.array(rng.choice(vocab[: 20 + i])).view(np.int64)) for _ in range(rng.randint(1, 15))], "n_question": 1} for i in range(30)]
    df = collections.Counter(w for r in items for w in set(r["words"]))
    index = op2_decontaminate.Shard(items, df, len(items), 8.0)
    words = np.array([rng.choice(vocab) for _ in range(400)], np.uint64)
    lane = 1 + np.arange(400) // 10
    got = {(x, s): v for x, s, v in index.retrieve(words, lane, 42, 0.4)}
    weight = collections.defaultdict(dict)
    for t in range(len(index.terms)):
        for k in range(index.first[t], index.first[t + 1]):
            weight[int(index.seg[k])][index.terms[t]] = index.weight[k]
    for x in range(42):
        inside = set(words[(lane == x) | (lane == x + 1)].tolist())
        for s, terms in weight.items():
            v = sum(w for t, w in terms.items() if int(t) in inside)
            assert ((x, s) in got) == (v >= 0.4 - 1e-9) and abs(got.get((x, s), v) - v) < 1e-9


def test_leaks_of_odd_input(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "what is it? three"), (2, None), (3, ""), (None, "different text of the same"), (4, "a b c"), (4, "a b c")], "item_id long, text string")
    got = set(rows_of(op2_decontaminate.find_leaks(odd_docs, items), "doc_id", "item_id"))
    assert got == {(3, 4), (3, None)}
    assert op2_decontaminate.find_leaks(no_docs, items).count() == 0
    assert op2_decontaminate.find_leaks(odd_docs, items.limit(0)).count() == 0


def test_left_overs_of_long_items_are_no_leaks(spark):
    words = lambda i, n: [f"item{i}w{k}" for k in range(n)]
    long = {1: [*words(1, 128), "the"], 2: [*words(2, 256), "of", "the", "and", "a"], 3: words(3, 128), 4: [*words(4, 128), "is", "in"]}
    items = spark.createDataFrame([(i, " ".join(w)) for i, w in long.items()], "item_id long, text string")
    sizes = collections.defaultdict(list)
    for i, k, n in sorted(rows_of(op2_decontaminate.segments(items), "item_id", "segment", F.size("words"))):
        sizes[i].append(n)
    assert dict(sizes) == {1: [64, 65], 2: [86, 87, 87], 3: [128], 4: [65, 65]}
    clean = ["the cat sat on the mat", "of the and a", "and so it is in the end of a day", "of the and a " * 90, "the"]
    rows = [(k, t) for k, t in enumerate(clean)]
    rows += [(10 + i, f"{t} {' '.join(long[i])} {t}") for i in long for t in clean[:1]]
    rows += [(20 + i, " ".join(long[i][a:])) for i, a in ((1, 64), (2, 173))]  # whole last parts
    got = set(rows_of(op2_decontaminate.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), items), "doc_id", "item_id"))
    assert got == {(11, 1), (12, 2), (13, 3), (14, 4), (21, 1), (22, 2)}


# ---------------------------------------------------------------- 3: quality

def test_held_out_grades(spark):
    rng = random.Random(1)
    rows = []
    for i in range(900):
        g = rng.choice([0, 1, 2, 2])
        w = ["".join(rng.choice("abcdefg") for _ in range(5)) for _ in range(40)]
        if g == 0:
            w[rng.randrange(40)] = "zzvile" + rng.choice("abc")
        if g == 1:
            w = [x.upper() + "!!" for x in w]
        rows.append((i, " ".join(w), g))
    df = spark.createDataFrame(rows, "doc_id long, text string, grade int")
    model = op3_quality.fit(df, df.where("doc_id < 600").select("doc_id", "grade"))
    assert list(model.thresholds) == sorted(model.thresholds)
    scored = op3_quality.grade(df, model).where("doc_id >= 600")
    wrong = scored.where("(tail >= 0.5) <> (grade = 2)").count()
    assert wrong <= 6
    means = [r[0] for r in scored.groupBy("grade").agg(F.avg("expected_grade").alias("m")).orderBy("grade").select("m").collect()]
    assert means == sorted(means)


def test_grades_of_odd_input(spark, odd_docs, no_docs):
    ratings = spark.createDataFrame([(1, 0, 0), (2, 1, 0), (3, 1, None), (4, None, None), (None, 1, 0), (99, 1, 1), (5, 1, 1), (8, 0, 1)], "doc_id long, quality int, toxic int")
    grades = op3_quality.grades(ratings)
    model = op3_quality.fit(odd_docs, grades)
    out = op3_quality.grade(odd_docs, model)
    assert out.count() == odd_docs.count() and out.where("tail is null").count() == 0
    assert set(out.columns) == set(odd_docs.columns)
    assert op3_quality.fit(odd_docs, grades.limit(0)) is None and op3_quality.fit(no_docs, grades) is None
    assert op3_quality.grade(odd_docs, None).where(op3_quality.keeps()).count() == odd_docs.count()
    assert op3_quality.grade(no_docs, model).count() == 0


# ---------------------------------------------------------------- 4: mixing

def expected_targets(size, epochs=3):
    order = sorted([s for s in size if s is not None]) + [None] * (None in size)
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    total, full = sum(size.values()), set()
    while True:
        free = [s for s in order if s not in full]
        rest = total - sum(epochs * size[s] for s in full)
        over = {s for s in free if rest * weight[s] / sum(weight[f] for f in free) > epochs * size[s]}
        if not over:
            return {s: float(epochs * size[s]) if s in full else rest * weight[s] / sum(weight[f] for f in free) for s in order}
        full |= over


def check_mix(df):
    mixed = op4_mixing.mix(df, F.col("rank") % 3 + 1, F.lit(1.0))
    got = rows_of(mixed, "doc_id", "text", "source", "size", "source_size", "target", "taken")
    size = collections.Counter()
    for _, t, s, *_ in got:
        size[s] += len(brute.words(t))
    want = expected_targets(size)
    taken = collections.Counter()
    for _, t, s, n, total, target, k in got:
        assert n == len(brute.words(t)) and total == size[s] and abs(target - want[s]) <= 1e-6 * max(1, target) and k <= 3 * n and (n == 0 or k % n == 0)
        taken[s] += k
    largest = max((g[3] for g in got), default=0)
    assert all(abs(taken[s] - want[s]) <= largest / 2 + 1e-6 for s in want)
    return sorted(map(repr, got))


def test_mix_meets_targets(docs):
    first = check_mix(docs)
    assert first == check_mix(docs.repartition(3))
    hot = docs.withColumn("source", F.when(F.col("doc_id") % 3 == 0, None).when(F.col("doc_id") % 3 == 1, "hot").otherwise(F.col("source")))
    check_mix(hot)


def test_mix_takes_the_smallest_keys_first(spark):
    df = spark.createDataFrame([(i, "w " * 10, "s", 1.0 + i % 2) for i in range(400)], "doc_id long, text string, source string, q double")
    got = rows_of(op4_mixing.mix(df, F.lit(1.0), F.col("q"), budget=0.5), "doc_id", "q", "copies")
    assert sum(c for *_, c in got) == 200
    assert sum(c for _, q, c in got if q == 2.0) > 110  # weight 2 is likelier


def test_mix_of_equal_rows(spark):
    rows = [(1, "a b c d", "hot")] * 1000 + [(2, "a b", "b")] * 7 + [(3, "x y", None)] * 50 + [(4, "z", "c"), (5, "y z", "c")]
    check_mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5))


def test_mix_of_odd_input(odd_docs, no_docs):
    check_mix(odd_docs)
    assert op4_mixing.mix(no_docs, F.col("rank") % 3 + 1, F.lit(1.0)).count() == 0
    blank = odd_docs.where("doc_id in (1, 2, 7)")
    assert {r[0] for r in rows_of(op4_mixing.mix(blank, F.col("rank") % 3 + 1, F.lit(None).cast("double")), "taken")} == {0}


# ---------------------------------------------------------------- 5: tool calls

def test_calls_link_order_and_validate(spark):
    call = lambda *calls: json.dumps({"tool_calls": [{"id": i, "name": n, "arguments": a} for i, n, a in calls]})
    rows = [
        (1, 0, "assistant", call(("b", "search", {"query": "$result:a", "limit": 2}), ("a", "search", {"limit": 1, "query": "x"}))),
        (1, 1, "tool", '{"call_id": "a", "content": {"z": 1, "y": [1.50, null]}}'), (1, 2, "tool", '{"call_id": "a", "content": "later"}'),
        (1, 3, "assistant", call(("c", "search", {"query": 5, "more": 1}), ("d", "odd", {}), ("e", "search", [1]))),
        (1, 4, "assistant", call(("p", "search", {"query": "$result:q", "limit": 1}), ("q", "search", {"query": "$result:p $result:none", "limit": 1}))),
        (1, 5, "assistant", call(("a", "search", {"query": "again", "limit": 1}), ("", "search", {"query": "", "limit": 1}))),
        (1, 6, "assistant", "no json"), (1, 7, "assistant", "{broken"), (1, 8, "assistant", None), (1, None, None, "{}"),
        (None, 0, "assistant", call(("a", "search", {"query": "é\n\"", "limit": 1}))), (2, 0, "tool", '{"call_id": "a", "content": 1}'),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("level", F.lit("clash")).withColumn("name", F.lit(1))
    tools = spark.createDataFrame(op5_tool_calls.TOOLS, "tool string, param string, type string, required boolean")
    got = {(r.conv_id, r.turn, r.idx): r for r in op5_tool_calls.link(df, tools).collect()}
    assert len(got) == 10
    b, a = got[1, 0, 0], got[1, 0, 1]
    assert (a.level, a.n_results, a.errors, a.valid) == (0, 2, [], True)
    assert a.json == '{"arguments":{"limit":1,"query":"x"},"id":"a","name":"search","result":{"y":[1.5,null],"z":1}}'
    assert (b.level, b.errors) == (1, ["no_result"])
    assert got[1, 3, 0].errors == ["missing:limit", "no_result", "type:query", "unexpected:more"]
    assert got[1, 3, 1].errors == ["no_result", "unknown_tool"] and got[1, 3, 2].errors == ["arguments_not_object", "no_result"]
    assert got[1, 4, 0].level is None and "unresolved" in got[1, 4, 0].errors and "unknown_reference:none" in got[1, 4, 1].errors
    assert got[1, 5, 0].errors == ["duplicate_id"] and got[1, 5, 1].errors == ["no_id"] and got[None, 0, 0].errors == ["no_id"]
    assert json.loads(got[None, 0, 0].json)["arguments"]["query"] == "é\n\""
    assert op5_tool_calls.link(df.limit(0), tools).count() == 0
    assert op5_tool_calls.link(df, tools.limit(0)).where("not array_contains(errors, 'unknown_tool')").count() == 0


def test_long_chains_are_ordered(spark):
    rows = [(1, t, "assistant", json.dumps({"tool_calls": [{"id": f"c{t}", "name": "reply", "arguments": {"text": f"$result:c{t + 1}"}}]})) for t in range(6)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    tools = spark.createDataFrame(op5_tool_calls.TOOLS, "tool string, param string, type string, required boolean")
    assert {r.turn: r.level for r in op5_tool_calls.link(df, tools).collect()} == {t: 5 - t for t in range(6)}


def test_calls_equal_duckdb(spark, sf):
    from check import compare, connect

    assert compare(connect(sf), op5_tool_calls.op5(spark, sf), op5_tool_calls.ORACLE) == ""


# ---------------------------------------------------------------- 6: n-gram Jaccard

def check_links(df):
    got = {r.doc_id: r for r in op6_lsh_forest.link(df).collect()}
    want = brute.near_copies(pairs(df))
    assert {i: (r.n_links, r.class_id) for i, r in got.items()} == want
    assert all(r.kept == (i == r.class_id) for i, r in got.items())


def test_links_equal_all_pairs(docs):
    check_links(docs)


def test_links_in_large_groups(spark):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):  # longer runs than SMALL
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(120)] = f"x{rng.randrange(30)}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, "short text") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.n_links for r in op6_lsh_forest.link(df).collect()}
    want = brute.near_copies(rows)
    found, there = sum(got.values()), sum(n for n, _ in want.values())
    assert all(got[i] <= want[i][0] for i in got) and found >= 0.995 * there


def test_links_of_odd_input(odd_docs, no_docs):
    got = collections.defaultdict(list)
    for r in op6_lsh_forest.link(odd_docs).collect():
        got[r.doc_id].append(r)
    assert sum(map(len, got.values())) == odd_docs.count()
    assert {r.class_id for i in (4, 5, 6) for r in got[i]} == {4} and [r.n_links for i in (4, 5, 6) for r in got[i]] == [2, 2, 2]
    assert {r.class_id for r in got[3]} == {3} and sorted(r.n_links for r in got[3]) == [0, 1, 1]
    assert all(r.n_links == 0 and r.kept for i in (1, 2, 7, None) for r in got[i])
    assert op6_lsh_forest.link(no_docs).count() == 0


# ---------------------------------------------------------------- 7: repeats

def test_difference_sets_are_perfect():
    for q in (2, 3, 5, 7, 11, 13, 17):
        v, found = op7_repeats.difference_set(q)
        assert collections.Counter((a - b) % v for a in found for b in found if a != b) == {d: 1 for d in range(1, v)}


@pytest.mark.parametrize("seed", range(3))
def test_repeats_equal_all_windows(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(40):
        t = "".join(rng.choice("ab") if seed else rng.choice("abcdé") for _ in range(rng.randint(0, 160)))
        if rows and i % 3 == 0:
            old = rng.choice(rows)[1]
            at = rng.randrange(len(old) + 1)
            t = t[: rng.randint(0, 20)] + old[at: at + rng.randint(0, 150)] + t[:5]
        rows.append((i, t))
    rows += [(100, rows[0][1]), (101, "a" * 300), (102, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    length = (16, 24, 70)[seed]
    got = sorted(rows_of(op7_repeats.remove_repeats(df, length), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"))
    assert got == sorted(brute.without_repeats(rows, length))


def test_repeats_of_documents(docs, doc_rows):
    got = sorted(rows_of(op7_repeats.remove_repeats(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"))
    assert got == sorted(brute.without_repeats(doc_rows, 400))


def test_repeats_of_odd_input(odd_docs, no_docs):
    got = collections.Counter(rows_of(op7_repeats.remove_repeats(odd_docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"))
    assert got == collections.Counter(brute.without_repeats(pairs(odd_docs), 400))
    kept = {(r.doc_id, r.n_bytes): r for r in op7_repeats.remove_repeats(odd_docs, what="text").collect()}
    assert bytes(kept[8, 16].kept) == b"One. Two, three!" and kept[8, 16].spans == []
    assert op7_repeats.remove_repeats(no_docs).count() == 0


# ---------------------------------------------------------------- 8: main text

LONG = "This is the long text of an article that has a lot of words and it goes on and on so that it is well over two hundred characters long, and then some more of the words are put into it for the sake of the test"


@pytest.mark.parametrize("page, want", [
    (None, ""), ("", ""), ("<html><body></body></html>", ""),
    (f"<html><head><title>t</title><style>p</style></head><body><nav><a href=x>Home</a></nav><article><h1>A &amp; B</h1><p>{LONG}<br>end&#33;<p>Short.</article><footer>f</footer>", f"A & B {LONG} end! Short."),
    (f"<body><div class='cookie-notice'>{LONG}</div><div class=content><h2>Head</h2><p>{LONG}</p><p>Short one.</p><p>{LONG}</p></div><div id=comments><p>{LONG}</p></div>", f"Head {LONG} Short one. {LONG}"),
    (f"<body><script>var x='<p>{LONG}</p>';</script><p>{LONG}</p><form>{LONG}</form><aside>{LONG}</aside><!-- <p>{LONG}</p> --><p hidden>{LONG}</p>", LONG),
    (f"<body><ul><li><a href=a>{LONG}</a></li></ul><p>{LONG}</p>", LONG),
    (f"<article><p>{LONG}</p><div class='ad'>{LONG}</div><div class='share'>x</div><section class='comments'>{LONG}</section></article>", LONG),
])
def test_main_text(page, want):
    assert op8_main_text.main_text(page) == want


def test_pages_keep_whole_articles(spark, sf):
    import html
    import re

    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r.page_id: r for r in op8_main_text.extract(pages.withColumn("text", F.lit(1)).withColumn("n_chars", F.lit("x"))).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        want = " ".join(html.unescape(re.sub(r"<[^>]+>", " ", article)).split())
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want)


def test_pages_do_without_the_article_tag(spark, sf):
    import html
    import re

    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        want = " ".join(html.unescape(re.sub(r"<[^>]+>", " ", article)).split())
        got = op8_main_text.main_text(re.sub(r"</?article>", "", r.html))
        assert got and len(set(want.split()) & set(got.split())) >= 0.95 * len(set(want.split())) and 0.95 * len(want) <= len(got) <= 1.05 * len(want)


FINNISH = "Talon takana kasvaa vanha puu, jonka varjossa lapset leikkivät kesäisin ja kertovat tarinoita kaukaisista maista, joissa kukaan heistä ei ole koskaan käynyt mutta joista he ovat kuulleet isoäidiltään. "


@pytest.mark.parametrize("page, want", [
    (f'<p>{LONG}</p><div class="post-comments"><p>{LONG} yes</p></div><ul class="commentList"><li>{LONG}</li></ul><div id="entry-comments">{LONG}</div><div class="post-related">{LONG}</div>', LONG),
    (f'<article><section id="side-effects"><p>{LONG}</p></section><div class="search-and-rescue"><p>{LONG} two</p></div></article>', f"{LONG} {LONG} two"),
    (f"<aside><article><p>Teaser. {LONG}</p></article></aside><main><p>{LONG}</p></main>", LONG),
    (f'<p class="lead>One {LONG}</p><p title="<b>x</b>">{LONG}</p><p data-a=\'x > y\' data-b="it\'s">{LONG}</p>', f"One {LONG} {LONG} {LONG}"),
    (f"<html lang=fi><body><nav><a href=/>Koti</a></nav><h1>Puu</h1><p>{FINNISH}</p><p>{FINNISH * 2}</p><div>Kaikki oikeudet</div></body>", " ".join(f"Puu {FINNISH} {FINNISH * 2}".split())),
    (f"<article><p>{LONG}</p></article><p>An other short one.</p><div>All rights</div>", LONG),
    (f"<div><h2>Head</h2><p>{LONG}</p><p>Last</p></div><div>Tagline of the site</div>", f"Head {LONG} Last"),
    ("<div class=content><h1>Only</h1><p>Short.</p></div>", "Only Short."),
    (f"<p>{LONG}</p><ul><li><a href=1>one</a> | <a href=2>two</a></li></ul>", LONG),
])
def test_rules_decide(page, want):
    assert op8_main_text.main_text(page) == want


@pytest.mark.parametrize("piece", ["<noscript>x", '<p class="a>x', "<a <b ", "<script>", "<!--", "<div>", "</p>", "<b>x", "<p title='", "<textarea>", "<h1>", "<td>&amp", "<![CDATA["])
def test_bad_markup_takes_linear_time(piece):
    import time

    def seconds(n):
        began = time.process_time()
        op8_main_text.main_text("<div>" + piece * n)
        return time.process_time() - began

    n = 200_000 // len(piece)
    seconds(n // 10)
    assert seconds(5 * n) < 12 * max(seconds(n), 0.05)


@pytest.mark.parametrize("seed", range(40))
def test_rules_equal_the_plain_version(seed):
    rng = random.Random(seed)
    stop = op8_main_text.STOP_WORDS["en"]

    def words(n):
        return " ".join(rng.choice(stop) if rng.random() < rate else f"w{rng.randrange(99)}" for _ in range(n)) + rng.choice([".", "", "!"])

    def node(depth):
        kind = rng.choice(["p", "p", "p", "h1", "div", "section", "nav", "list"] if depth < 3 else ["p"])
        if kind == "p" or kind == "h1":
            inner = words(rng.choice([2, 5, 9, 20, 60]))
            return f"<{kind}>{inner}{f'<a>{words(rng.randrange(1, 9))}</a>' if rng.random() < 0.3 else ''}</{kind}>"
        name = "div" if kind == "list" else kind
        label = rng.choice(["", ' class="sidebar"', ' class="body"'])
        return f"<{name}{label}>{''.join(node(depth + 1) for _ in range(rng.randrange(1, 4)))}</{name}>"

    rate = rng.choice([0.02, 0.1, 0.3])
    body = "".join(node(0) for _ in range(rng.randrange(1, 7)))
    page = f'<html lang="en"><body>{body}{"<article>" + node(1) + node(1) + "</article>" if rng.random() < 0.5 else ""}<footer>{words(9)}</footer></body></html>'
    assert op8_main_text.main_text(page) == brute.two_pass_text(page, frozenset(stop), {"sidebar"})


def test_odd_pages(spark):
    rows = [(None, None, None), (1, "u", ""), (2, None, "<p>" * 5000), (3, "u", f"<article><p>{LONG * 2000}"), (3, "u", f"<article><p>{LONG * 2000}")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert sorted((r.page_id or 0, r.n_chars) for r in op8_main_text.extract(df).collect()) == [(0, 0), (1, 0), (2, 0), (3, len(LONG) * 2000), (3, len(LONG) * 2000)]
    assert op8_main_text.extract(df.limit(0)).count() == 0


# ---------------------------------------------------------------- 9: embeddings

def test_vectors_equal_all_pairs(spark, sf):
    own = [(r.vec_id, list(r.embedding), r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    rng = np.random.default_rng(2)
    for k in range(300):  # copies and near copies, also in other labels
        _, e, label = own[k % 40]
        own.append((10_000 + k, [float(np.float32(x)) for x in np.array(e) * rng.choice([1, 2]) + rng.normal(0, 0.02, len(e)) * (k % 3)], label if k % 5 else 77))
    nan, inf = float("nan"), float("inf")
    own += [(20_000, None, 1), (20_001, [], 1), (20_002, [0.0] * 64, 1), (20_003, [nan] * 64, 1), (20_004, [inf] * 64, 1), (20_005, [None] * 64, 1),
            (20_006, own[0][1], None), (20_007, [1.0, 0.0], 1), (20_008, [1e-200, 1e-200], 1), (20_009, [1e200, 1e200], 1)]
    df = spark.createDataFrame(own, "vec_id long, embedding array<double>, label int").withColumn("n", F.lit("x")).withColumn("kept", F.lit(1))
    got = {r.vec_id: r for r in op9_embeddings.near_pairs(df).collect()}
    want = brute.cosine_links([r for r in own if r[0] not in (20_008, 20_009)])
    assert {i: (r.n_links, r.component_id) for i, r in got.items() if i in want} == want
    assert got[20_008].n_links == 1 and got[20_009].component_id == 20_008
    assert all(r.kept == (i == r.component_id) for i, r in got.items())
    none = op9_embeddings.near_pairs(df.limit(0))
    assert none.count() == 0 and none.columns == ["vec_id", "n_links", "component_id", "kept"]


def test_cells_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(op9_embeddings, "CELL", 30)
    monkeypatch.setattr(op9_embeddings, "BLOCK", 16)
    rng = np.random.default_rng(4)
    base = rng.normal(0, 1, (40, 8))
    own = [(i, (base[i % 40] + rng.normal(0, 0.25, 8)).tolist(), i % 2) for i in range(400)]
    df = spark.createDataFrame(own, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in op9_embeddings.near_pairs(df).collect()}
    assert got == brute.cosine_links(own)


# ---------------------------------------------------------------- 10: language model

def test_elias_fano():
    rng = np.random.default_rng(1)
    for n, top in ((0, 1), (1, 1), (1000, 2**64 - 1), (1000, 2**40), (500, 600), (3, 2**63)):
        x = np.sort(rng.integers(0, top, n, dtype=np.uint64, endpoint=True))
        ef = op10_ngram_lm.EliasFano(x, top)
        assert (ef.access(np.arange(n)) == x).all()
        y = np.r_[x, rng.integers(0, top, 200, dtype=np.uint64, endpoint=True)]
        place = ef.find(y, ef.begin())
        assert all((p >= 0 and x[p] == v) if v in set(x.tolist()) else p == -1 for p, v in zip(place.tolist(), y.tolist()))


def check_scores(df):
    got = collections.defaultdict(list)
    for r in op10_ngram_lm.score(df).collect():
        got[r.doc_id].append(tuple(r)[1:])
    want = collections.defaultdict(list)
    for i, *r in brute.lm_scores(pairs(df)):
        want[i].append(tuple(r))
    assert got.keys() == want.keys()
    for i in want:
        for a, b in zip(sorted(got[i]), sorted(want[i]), strict=True):
            assert a[:4] == b[:4] and math.isclose(a[4], b[4], rel_tol=1e-9, abs_tol=1e-9) and math.isclose(a[5], b[5], rel_tol=2e-3, abs_tol=1e-3)
    return got


def test_scores_equal_the_formula(docs, odd_docs, no_docs):
    got = check_scores(docs)
    held = [r for rows in got.values() for r in rows if r[0]]
    assert sum(r[5] for r in held) > sum(r[4] for r in held)  # the model beats its base
    check_scores(odd_docs)
    assert op10_ngram_lm.score(no_docs).count() == 0


def test_scores_without_training_text(spark):
    held_out = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    df = spark.createDataFrame([(held_out, "a b")], "doc_id long, text string")
    check_scores(df)
