"""N-gram Jaccard join with a MinHash LSH forest.

A document is the set of its 5-word shingles (lower-cased words; a text of one to four words is one
shingle of all of them). Documents of equal word sequence are one class. Each class has ``TREES`` labels of
up to ``DEPTH`` min-hashes; a forest keeps each tree's labels sorted, and classes that share a prefix of
a label are candidates. All trees start at full depth and prefixes are shortened until a pair at the
threshold is found with probability ``RECALL``: 1 - (1 - t^k)^TREES at depth k.

Pairs are verified on their shingle sets. Runs of a tree of up to ``SMALL`` classes give pairs; longer runs
are cut into blocks, and each pair of blocks is compared inside one task, which returns counts and linking edges but no pairs. A pair is compared in the first tree where it shares a prefix and nowhere else, so counts are exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuewise.llm.common import Roller, bounded_batches, components, joined, mix, partitions, pieces, query, settle, table, words_of

SHINGLE, THRESHOLD = 5, 0.8
TREES, DEPTH, RECALL = 24, 8, 0.999
SMALL, BLOCK = 48, 512
_SALTS = mix(np.arange(1, TREES * DEPTH + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def prefix_depth(threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """The longest prefix that still finds a pair at the threshold with the wanted probability."""
    depth = DEPTH
    while depth > 1 and 1 - (1 - threshold**depth) ** TREES < recall:
        depth -= 1
    return depth


def shingles(words: np.ndarray) -> np.ndarray:
    """Sorted distinct shingle hashes of a word sequence."""
    n = min(SHINGLE, len(words))
    if not n:
        return words[:0]
    out = words[: len(words) - n + 1].copy()
    for j in range(1, n):
        out = mix(out) + words[j: len(words) - n + 1 + j]
    return np.unique(mix(out))


def label_prefixes(sets: np.ndarray, depth: int) -> np.ndarray:
    """The hashed depth-long prefix of each tree's label."""
    low = np.empty((TREES, depth), np.uint64)
    for t in range(TREES):
        for d in range(depth):
            x = sets * _SALTS[t * DEPTH + d]
            low[t, d] = (x ^ (x >> np.uint64(32))).min()
    key = np.zeros(TREES, np.uint64)
    for d in range(depth):
        key = mix(key + low[:, d])
    return key


def packed(sets: np.ndarray) -> bytes:
    """The upper 40 bits of each hash: two of a pair's few thousand shingles hardly ever share them."""
    return np.ascontiguousarray(sets.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 3:]).tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), np.uint8)
    out[:, 3:] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return out.view("<u8").reshape(-1)


def _sequence(words: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for the word sequence."""
    r = Roller.shared()
    raw = words.view(np.uint8)
    s = r.sums(raw)
    a = r.at(s, np.zeros(1, np.int64), np.full(1, len(raw)))
    place = mix(np.arange(1, len(words) + 1, dtype=np.uint64))
    b = np.sum(mix(words ^ place), keepdims=True)
    return int(a.view(np.int64)[0]), int(mix(b).view(np.int64)[0])


def link(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row per row of (doc_id, text): doc_id, class_id, copy_id, n_links, kept.

    copy_id is the smallest doc_id with the same words, class_id the smallest doc_id reachable by links
    of similarity >= ``threshold``, n_links the number of other rows linked directly, kept whether the row's doc_id is
    class_id. Null and wordless texts link with nothing. Rows that repeat a doc_id are joined by it, so
    they share a class. A row of null doc_id keeps null ids, no links, and is kept.
    """
    bounded_batches(docs.sparkSession)
    spark = docs.sparkSession
    depth = prefix_depth(threshold, recall)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def sign(batches):
        for batch in batches:
            for piece in pieces(batch, "text"):
                data, at = joined(piece.column("text"))
                words, start, _ = words_of(data)
                first = np.searchsorted(start, at)
                a, b, keys = [], [], []
                for i, j in zip(first, first[1:]):
                    x, y = _sequence(words[i:j]) if i < j else (None, None)
                    a.append(x), b.append(y)
                    keys.append(label_prefixes(shingles(words[i:j]), depth).view(np.int64) if i < j else None)
                yield pa.record_batch({"doc_id": piece.column("doc_id"), "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()),
                                       "keys": pa.array(keys, pa.list_(pa.int64()))})

    signed = settle(rows.mapInArrow(sign, "doc_id long, a long, b long, keys array<long>"), "signed")
    sound = signed.where("a is not null and doc_id is not null")
    # Groups of equal copies are counted before they are shuffled; c names a class.
    classes = sound.groupBy("a", "b").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"), F.first("keys").alias("keys"))
    classes = settle(classes.withColumn("c", F.col("a").bitwiseXOR(F.col("b"))), "classes")
    places = classes.select("c", F.posexplode("keys").alias("tree", "key"))
    runs = settle(places.groupBy("tree", "key").agg(F.count("*").alias("m")).where("m > 1"), "runs")
    members = settle(places.join(runs, ["tree", "key"]), "members")
    busy = settle(members.select("c").distinct().join(classes.select("c", "rep", "n", "keys"), "c"), "busy")

    def sets(batches):
        for batch in batches:
            for piece in pieces(batch, "text"):
                data, at = joined(piece.column("text"))
                words, start, _ = words_of(data)
                first = np.searchsorted(start, at)
                c, s = [], []
                for i, j in zip(first, first[1:]):
                    x, y = _sequence(words[i:j]) if i < j else (0, 0)
                    c.append(x ^ y), s.append(packed(shingles(words[i:j])))
                out = pa.record_batch({"c": pa.array(c, pa.int64()), "s": pa.array(s, pa.binary())})
                yield out.filter(pc.equal(out.column("c"), piece.column("c")))

    # The shingles of every class that has candidates, once.
    texts = rows.join(busy.select("rep", "c"), F.col("doc_id") == F.col("rep")).select("c", "text")
    texts = settle(texts.mapInArrow(sets, "c long, s binary").dropDuplicates(["c"]), "sets")

    small = members.where(F.col("m") <= SMALL).select("tree", "key", "c")
    x, y = small.alias("l"), small.alias("r")
    pairs = x.join(y, (F.col("l.tree") == F.col("r.tree")) & (F.col("l.key") == F.col("r.key")) & (F.col("l.c") < F.col("r.c")))
    pairs = pairs.select(F.col("l.c").alias("p"), F.col("r.c").alias("q"), F.col("l.tree").alias("tree")).groupBy("p", "q").agg(F.min("tree").alias("tree"))
    end = lambda side, *more: busy.select(F.col("c").alias(side), F.col("rep").alias(f"r{side}"), F.col("n").alias(f"n{side}"), F.col("keys").alias(f"k{side}"))
    first_tree = F.expr("array_position(zip_with(kp, kq, (u, v) -> u = v), true) - 1")
    pairs = settle(pairs.join(end("p"), "p").join(end("q"), "q").where(first_tree == F.col("tree")).drop("kp", "kq", "tree"), "pairs")

    def verify(batches):
        for batch in batches:
            keep = []
            for s, t in zip(batch.column("sp"), batch.column("sq")):
                a, b = unpacked(s.as_py()), unpacked(t.as_py())
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(both >= threshold * (len(a) + len(b) - both) - 1e-9)
            yield batch.filter(pa.array(keep, pa.bool_())).select(["rp", "rq", "p", "q", "np", "nq"])

    both_sets = pairs.join(texts.select(F.col("c").alias("p"), F.col("s").alias("sp")), "p").join(texts.select(F.col("c").alias("q"), F.col("s").alias("sq")), "q")
    linked = both_sets.select("rp", "rq", "p", "q", "np", "nq", "sp", "sq").mapInArrow(verify, "rp long, rq long, p long, q long, np long, nq long")
    linked = settle(linked, "linked")

    # Long runs: blocks of hashed classes, every pair of blocks once.
    large = members.where(F.col("m") > SMALL).withColumn("nb", F.ceil(F.col("m") / BLOCK))
    large = large.withColumn("k", F.pmod(F.xxhash64("c", "tree"), F.col("nb")))
    dealt = large.select("tree", "key", "c", "k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)).alias("o"))
    dealt = dealt.select("tree", "key", "c", "k", F.least("k", "o").alias("i"), F.greatest("k", "o").alias("j"))
    dealt = dealt.join(busy, "c").join(texts, "c")
    group = ["tree", "key", "i", "j"]

    def compare(batches):
        def solve(rows):
            m = len(rows)
            tree, i, j = rows[0]["tree"], rows[0]["i"], rows[0]["j"]
            keys = np.array([r["keys"] for r in rows])
            sets = [unpacked(r["s"]) for r in rows]
            size = np.array([len(s) for s in sets])
            ids, reps, ns = [r["c"] for r in rows], [r["rep"] for r in rows], np.array([r["n"] for r in rows])
            k = np.array([r["k"] for r in rows])
            todo = np.triu(np.ones((m, m), bool), 1)
            if i != j:
                todo &= (k[:, None] != k[None])
            for t in range(tree):  # compared in an earlier tree
                todo &= keys[:, None, t] != keys[None, :, t]
            todo &= np.minimum(size[:, None], size[None]) >= threshold * np.maximum(size[:, None], size[None]) - 1e-9
            if not todo.any():
                return None
            every, col, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
            row = np.repeat(np.arange(m), size)
            # A shingle of one document is in no intersection.
            common = np.flatnonzero(times > 1)
            place = np.full(len(every), -1)
            place[common] = np.arange(len(common))
            row, col = row[place[col] >= 0], place[col[place[col] >= 0]]
            both = np.zeros((m, m), np.float32)
            for lo in range(0, len(common), 4096):  # bounded memory for long texts
                here = (col >= lo) & (col < lo + 4096)
                a = np.zeros((m, 4096), np.float32)
                a[row[here], col[here] - lo] = 1
                both += a @ a.T
            near = todo & (both >= threshold * (size[:, None] + size[None] - both) - 1e-6)
            p, q = np.nonzero(near)
            if not len(p):
                return None
            links = np.bincount(p, ns[q], m) + np.bincount(q, ns[p], m)
            parent = list(range(m))

            def root(v):
                while parent[v] != v:
                    parent[v] = parent[parent[v]]
                    v = parent[v]
                return v

            for u, v in zip(p.tolist(), q.tolist()):
                parent[root(u)] = root(v)
            hit = np.flatnonzero(links)
            return pa.record_batch({"c": pa.array([ids[h] for h in hit], pa.int64()), "links": pa.array(links[hit].astype(np.int64)),
                                    "rep": pa.array([reps[h] for h in hit], pa.int64()), "root": pa.array([reps[root(int(h))] for h in hit], pa.int64())})

        held, now = [], None
        for batch in batches:
            for r in batch.to_pylist():
                g = (r["tree"], r["key"], r["i"], r["j"])
                if g != now:
                    if len(held) > 1 and (out := solve(held)) is not None:
                        yield out
                    held, now = [], g
                held.append(r)
        if len(held) > 1 and (out := solve(held)) is not None:
            yield out

    dealt = dealt.repartition(partitions(spark), *group).sortWithinPartitions(*group)
    dealt = dealt.select(*group, "c", "rep", "k", "n", "keys", "s")
    blocks = settle(dealt.mapInArrow(compare, "c long, links long, rep long, root long"), "blocks")

    links = linked.select(F.col("p").alias("c"), F.col("nq").alias("links")).union(linked.select("q", "np")).union(blocks.select("c", "links"))
    links = links.groupBy("c").agg(F.sum("links").alias("links"))
    copies = settle(sound.select("doc_id", "a", "b").join(classes.join(links, "c", "left").select("a", "b", "rep", "n", "links"), ["a", "b"]).select("doc_id", "rep", "n", "links"), "copies")
    group_of = components(linked.select(F.col("rp").alias("a"), F.col("rq").alias("b")).union(blocks.select("rep", "root")).union(
        copies.where("doc_id <> rep").select("doc_id", "rep").distinct()))
    per = copies.select("doc_id", F.col("rep").alias("copy_id"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    per = per.join(group_of, F.col("doc_id") == F.col("node"), "left").select("doc_id", F.coalesce("root", "doc_id").alias("class_id"), "copy_id", "n_links")
    alone = signed.where("a is null or doc_id is null").select("doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("copy_id"), F.lit(0).cast("long").alias("n_links"))
    return per.union(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))


@query("op6_ngram_jaccard")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "documents"))
