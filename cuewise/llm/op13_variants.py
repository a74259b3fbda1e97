"""Spelling variants by PartEnum signatures of letter multisets.

A word is the set of its letters with their counts, a binary vector with a bit for each (letter, k-th copy). An inserted or
deleted letter changes one bit, a replaced letter two. Letters are dealt to ``PARTS`` parts; two words within Hamming
distance two differ in at most two parts. The signatures of a word are its vectors without each part and without each two
parts, so near words share the signature that leaves out just the parts in which they differ:

    equal lengths, two parts left out    a replaced letter whose old and new letter are of different parts
    equal lengths, one part left out     a replaced letter whose old and new letter are of one part
    lengths n and n + 1, one part        an inserted or deleted letter

Signatures carry the length too and are joined on equality; a pair is kept where its edit distance is one. Each near pair differs
in the parts of one signature alone, so it comes out once and nothing needs to be made distinct. Words of one signature are compared
inside the join; Spark's skew join splits a signature that many words share.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuewise.llm.common import partitions, query, settle, table

PARTS = 6
FREQUENT = "etaoinsrhldcumfpgwybvkxjqz"  # dealt out in turn, so that parts are of like weight; other letters by code point
RUN = "[A-Za-zÀ-ÿ]"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def count_words(docs: DataFrame, least_chars: int = 6, least_count: int = 5, lose_every: int = 199) -> DataFrame:
    """(word, n) of the runs of Latin letters in the rows (doc_id, text), each occurrence counted.

    A run loses a letter where the crc32 of "doc_id:run" is divisible by ``lose_every``. Null texts hold no words, a null doc_id is
    written as nothing, rows that repeat count as often as they occur. Other columns are ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # Shorter runs cannot give a word; matches are still whole runs.
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
                       F.explode(F.regexp_extract_all(text, F.lit(f"({RUN}{{{least_chars},}})"), F.lit(1))).alias("run"))
    low = runs.select("id", F.translate("run", CAPITALS, CAPITALS.lower()).alias("w"))
    low = low.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "w").cast("binary")))
    at = (F.col("h") % F.length("w")).cast("int")
    less = F.concat(F.substring("w", F.lit(1), at), F.substring("w", at + 2, F.length("w")))
    found = low.select(F.when(F.col("h") % lose_every == 0, less).otherwise(F.col("w")).alias("word"))
    return found.where(F.length("word") >= least_chars).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _signatures(words: DataFrame) -> DataFrame:
    """(sig, side, gone, word, n): a row for each signature of each word; gone holds the letters of a single part left out.

    Side 0 meets 0, 1 meets 2 and 3 meets 4. Of the words that differ in two parts one has a letter more in the first of them (1)
    and the other in the second (2), so they also share the number of letters that the first part of side 1 has. Of lengths n and n + 1, side 4
    is the longer.
    """
    place = lambda c: F.call_function("instr", F.lit(FREQUENT), c)
    of = lambda c: F.when(place(c) > 0, place(c)).otherwise(F.ascii(c)) % PARTS
    part = lambda p: F.array_join(F.filter("letters", lambda c: of(c) == p), "")
    dealt = words.repartition(partitions(words.sparkSession), "word").select("word", "n", F.array_sort(F.split("word", "")).alias("letters"))
    parted = dealt.select("word", "n", F.length("word").alias("size"), *[part(p).alias(f"p{p}") for p in range(PARTS)])

    def signature(side: int, out: tuple[int, ...], size: Column, gone: Column, meets: int) -> Column:
        kept = [f"p{p}" for p in range(PARTS) if p not in out]
        return F.struct(F.xxhash64(F.lit(meets), F.lit(",".join(map(str, out))), size, *kept).alias("sig"), F.lit(side).cast("byte").alias("side"),
                        gone.alias("gone"), "word", "n")

    size, none = F.col("size"), F.lit(None).cast("string")
    every = []
    for p in range(PARTS):
        every += [signature(0, (p,), size, F.col(f"p{p}"), 0), signature(3, (p,), size, none, 3), signature(4, (p,), size - 1, none, 3)]
    for p, q in combinations(range(PARTS), 2):
        # The first part's letters tell side 1 from side 2; with the size they fix those of the second part.
        every += [signature(1, (p, q), size * 1000 + F.length(f"p{p}"), none, 1), signature(2, (p, q), size * 1000 + F.length(f"p{p}") + 1, none, 1)]
    return parted.select(F.explode(F.array(*every)).alias("s")).select("s.*")


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n): every two of the distinct words (word, n) that are one inserted, deleted or replaced code point apart, once."""
    s = _signatures(words)
    x = s.where("side in (0, 1, 3)").select("sig", "side", F.col("gone").alias("x"), F.col("word").alias("a"), F.col("n").alias("a_n"))
    y = s.where("side in (0, 2, 4)").select("sig", F.col("side").alias("y_side"), F.col("gone").alias("y"), F.col("word").alias("b"), F.col("n").alias("b_n"))
    met = F.expr("(side = 0 and y_side = 0 and a < b and x <> y) or (side = 1 and y_side = 2) or (side = 3 and y_side = 4)")
    near = F.levenshtein("a", "b", 1) == 1
    # Never broadcast: Spark takes the size of the signatures for that of the words.
    return x.join(y.hint("merge"), (x.sig == y.sig) & met & near).select("a", "a_n", "b", "b_n")


def group_variants(words: DataFrame, ratio: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of distinct words (word, n).

    The form of a word is its near word of the largest n (of equals the first in code-point order) if that is ``ratio`` times its own or
    more; the root is the last of the chain of forms. Forms grow by the ratio, so chains have no cycles and at most
    log(largest n) steps; they are followed by doubling.
    """
    spark = words.sparkSession
    words = settle(words.select("word", F.col("n").cast("long").alias("n")), "words")
    pairs = settle(near_pairs(words), "near")
    each = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")).union(pairs.select("b", "a", "a_n"))
    best = each.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near"))).alias("top"))
    out = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        *[F.when(-F.col("top.m") >= ratio * F.col("n"), c).alias(a) for c, a in ((F.col("top.near"), "form"), (-F.col("top.m"), "form_n"))])
    out = settle(out, "forms")
    steps = out.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        after = steps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        steps = settle(steps.join(after, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        if steps.where("moved").isEmpty():
            break
        steps = steps.select("word", "root")
    out = out.join(steps.select("word", "root"), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


@query("op13_spelling_variants")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_variants(count_words(table(spark, sf_dir, "documents")))
