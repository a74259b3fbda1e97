"""The pipeline's stages against brute force on the smallest tables, and on odd documents."""

import collections

import brute
import pytest
from pyspark.sql import functions as F

cp = pytest.importorskip("corpus_pipeline")


def rows_of(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def test_stages(spark, docs, sf):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    from cuewise.llm.common import settle

    now, seen = docs, {}
    for name, stage in cp.STAGES[:-1]:
        now = settle(stage(spark, now, sf), name)
        assert now.columns == docs.columns
        seen[name] = rows_of(now, "doc_id", "text", "source")
    all_docs = set(rows_of(docs, "doc_id", "text", "source"))
    assert all(set(rows) <= all_docs for rows in seen.values())
    clean = {r[0] for r in rows_of(spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1 and toxic = 0"), "doc_id")}
    gone = all_docs - set(seen["quality"])
    assert len({r[0] for r in gone} & clean) <= 0.02 * len(clean) + 1
    want = {i for i, (_, c) in brute.near_copies([r[:2] for r in seen["quality"]]).items() if i == c}
    assert {r[0] for r in seen["near_duplicates"]} == want and len(seen["near_duplicates"]) == len(want)
    items = rows_of(spark.read.parquet(f"{sf}/benchmark.parquet"), "item_id", "text")
    leaks = {d for d, _ in brute.contains([r[:2] for r in seen["near_duplicates"]], items)}
    assert {r[0] for r in seen["decontaminate"]} == {r[0] for r in seen["near_duplicates"]} - leaks
    times = collections.Counter(r[0] for r in seen["mix"])
    assert set(times) == {r[0] for r in seen["decontaminate"]} and max(times.values()) == 2
    size, taken = collections.Counter(), collections.Counter()
    for _, t, s in seen["decontaminate"]:
        size[s] += len(brute.words(t))
    for _, t, s in seen["mix"]:
        taken[s] += len(brute.words(t))
    longest = max(len(brute.words(r[1])) for r in seen["decontaminate"])
    assert all(abs(taken[s] - size[s] * (1 + k % 3 / 2)) <= longest / 2 for k, s in enumerate(sorted(size)))
    got = rows_of(cp.run(spark, sf), "doc_id", "start", "n_tokens", "ids_crc32")
    want = brute.token_rows([r[:2] for r in seen["mix"]], Tokenizer.from_file(P.path("word_bpe_49k.json")))
    assert sorted(got, key=lambda r: r[1]) == want


def test_stages_on_odd_documents(spark, odd_docs, no_docs, sf):
    from cuewise.llm.common import settle

    for df in (odd_docs, no_docs):
        now = df
        for name, stage in cp.STAGES[:-1]:
            now = settle(stage(spark, now, sf), name)
            assert now.columns == df.columns, name
        assert cp.STAGES[-1][1](spark, now, sf).count() == now.count()
    kept = cp.near_duplicates(spark, odd_docs, sf)
    assert sorted(r[0] or 0 for r in rows_of(kept, "doc_id")) == [0, 0, 1, 2, 3, 3, 4, 7, 8, 9]
    assert cp.decontaminate(spark, odd_docs, sf).count() == odd_docs.count()
    assert rows_of(cp.mix(spark, odd_docs, sf).agg(F.countDistinct(F.coalesce("doc_id", F.lit(-1)))), "*") == [(10,)]


def test_a_decision_touches_only_its_row(spark, sf):
    item = spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").first().text
    leak, clean, other = f"before it {item} after it", "a clean text of words that no item has", "words of quite another clean text"
    rows = [(None, leak, "x"), (None, clean, "x"), (None, None, "x"), (7, leak, "x"), (7, clean, "y"), (8, other, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    got = sorted(rows_of(cp.decontaminate(spark, df, sf), *df.columns), key=key)
    assert got == sorted((r for r in rows if r[1] != leak), key=key)
    big = (1 << 63) - 1
    rows = [(None, clean, "x"), (None, clean, "x"), (None, clean, "y"), (None, other, "x"), (big, other, "x"), (-big - 1, leak, "x"), (5, leak, "x"), (None, None, "x"), (None, None, "x")]
    got = rows_of(cp.near_duplicates(spark, spark.createDataFrame(rows, df.schema), sf), "doc_id", "text")
    same = [(1, clean, "x"), (1, other, "x"), (1, clean, "y"), (2, leak, "x")]
    assert sorted(rows_of(cp.near_duplicates(spark, spark.createDataFrame(same, df.schema), sf), "doc_id", "text")) == sorted([(1, clean), (1, other), (2, leak)])
    assert sorted(got, key=key) == sorted([(None, clean), (big, other), (-big - 1, leak), (None, None), (None, None)], key=key)
