"""Benchmark decontamination: every passage of every document queries a BM25 index of the test items.

The index holds items cut into the fewest segments of near equal length, at most ``SEGMENT`` words each. A posting's weight is its BM25 impact over the
segment's own BM25 score, so a passage that holds all words of a segment scores 1. Segments are sorted by
length into blocks of ``BLOCK``; each term keeps its largest weight overall and per block. A passage is a window of
2 L words at every L words, L the longest segment: any occurrence of a segment lies inside one.

Retrieval is exact for the threshold, by the bounds of block-max WAND: a passage whose terms' largest
weights sum below the threshold is skipped, then every block whose maxima over the passage's terms sum below
it; only segments of the blocks left are scored. Bounds of many passages are summed at once. Retrieved segments are then verified: word 3-grams of the question
part and of the answer part (the last sentence, or last third) must both occur in the passage.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuewise.llm.common import bounded_batches, joined, mix, pieces, query, settle, table, words_of

SEGMENT = 128  # words of an item segment at most
BLOCK = 4  # segments of similar length that share block maxima
SHARD = 60_000  # postings of an index shard, which every task holds (some 45 MB); more items make more shards
THRESHOLD = 0.5  # share of a segment's own BM25 score
OVERLAP = 0.5  # share of the question's and of the answer's 3-grams
K1, B = 1.2, 0.75
GRAM = 3


def _grams(words: np.ndarray, n: int = GRAM) -> np.ndarray:
    """Hashes of the word n-grams."""
    if len(words) < n:
        return words[:0]
    out = words[: len(words) - n + 1].copy()
    for j in range(1, n):
        out = mix(out) + words[j: len(words) - n + 1 + j]
    return mix(out)


def segments(items: DataFrame) -> DataFrame:
    """(item_id, segment, words ARRAY of hashes, n_question) of the items; texts without words have none."""
    def cut(batches):
        for batch in batches:
            rows = []
            for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist()):
                raw = (text or "").encode()
                words, start, _ = words_of(np.frombuffer(raw, np.uint8), plain=True)
                # Parts of near equal length: a left-over of few words would be found in clean texts.
                n_parts = -(-len(words) // SEGMENT)
                cuts = [k * len(words) // n_parts for k in range(n_parts + 1)] if n_parts else []
                for k, (at, end) in enumerate(zip(cuts, cuts[1:])):
                    part = words[at: end]
                    stop = start[at + len(part)] if at + len(part) < len(words) else len(raw)
                    # The answer is what follows the last sentence end (or line) inside the segment.
                    ends = [m.end() for m in re.finditer(rb"[.?!:]\s+|\n+", raw[start[at]: stop].rstrip())]
                    inside = [int(np.searchsorted(start[at: at + len(part)] - start[at], e)) for e in ends]
                    inside = [q for q in inside if GRAM <= q <= len(part) - 1]
                    rows.append((item, k, part.view(np.int64), inside[-1] if inside else max(1, 2 * len(part) // 3)))
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64()))],
                                      names=["item_id", "segment", "words", "n_question"])

    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    return settle(rows.mapInArrow(cut, "item_id long, segment long, words array<long>, n_question long"), "segments")


class Shard:
    """A block-max index of some segments."""

    def __init__(self, rows: list, df: dict[int, int], n: int, mean: float):
        rows = sorted(rows, key=lambda r: (len(r["words"]), r["item_id"] is None, r["item_id"], r["segment"]))
        self.items = [r["item_id"] for r in rows]
        self.grams = []
        for r in rows:
            w = np.array(r["words"], np.int64).view(np.uint64)
            size = min(GRAM, len(w))
            q = min(max(r["n_question"], size), len(w))
            # A short answer is taken with the words before it, so that both parts have a 3-gram.
            self.grams.append((size, np.unique(_grams(w[:q], size)), np.unique(_grams(w[min(q, len(w) - 1) - size + 1:], size))))
        term, seg, weight = [], [], []
        for k, r in enumerate(rows):
            t, tf = np.unique(np.array(r["words"], np.int64).view(np.uint64), return_counts=True)
            d = np.array([df[int(x)] for x in t.view(np.int64)])
            impact = np.log(1 + (n - d + 0.5) / (d + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(r["words"]) / mean))
            term.append(t)
            seg.append(np.full(len(t), k))
            weight.append(impact / impact.sum())
        term, seg, weight = np.concatenate(term), np.concatenate(seg), np.concatenate(weight)
        self.terms, code = np.unique(term, return_inverse=True)
        self.seen = np.zeros(1 << 16, bool)
        self.seen[(self.terms >> np.uint64(48)).astype(np.int64)] = True
        order = np.lexsort((seg, code))
        self.seg, self.weight, code = seg[order], weight[order], code[order]
        self.first = np.searchsorted(code, np.arange(len(self.terms) + 1))
        self.most = np.maximum.reduceat(self.weight, self.first[:-1])
        key = code * (len(rows) // BLOCK + 1) + self.seg // BLOCK
        at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        self.dense = np.zeros((len(self.terms), (len(rows) - 1) // BLOCK + 1), np.float32)
        self.dense[code[at], self.seg[at] // BLOCK] = np.maximum.reduceat(self.weight, at)
        self.longest = max(len(r["words"]) for r in rows)

    def codes(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and term codes of the words that the index has."""
        at = np.flatnonzero(self.seen[(words >> np.uint64(48)).astype(np.int64)])
        code = np.searchsorted(self.terms, words[at])
        code[code == len(self.terms)] = 0
        hit = self.terms[code] == words[at]
        return at[hit], code[hit]

    def retrieve(self, words: np.ndarray, lane: np.ndarray, n: int, threshold: float) -> list[tuple[int, int, float]]:
        """(passage, segment, score) of all scores >= threshold; word i belongs to passages lane[i] and lane[i] - 1."""
        at, code = self.codes(words)
        pair = np.unique(np.concatenate([lane[at], lane[at] - 1]) * len(self.terms) + np.r_[code, code])
        pair = pair[pair >= 0]
        passage, code = pair // len(self.terms), pair % len(self.terms)
        total = np.bincount(passage, self.most[code], n)
        keep = total[passage] >= threshold - 1e-9
        passage, code = passage[keep], code[keep]
        if not len(code):
            return []
        # Block bounds of the remaining passages: one row of block maxima per term, summed by passage.
        start = np.flatnonzero(np.r_[True, passage[1:] != passage[:-1]])
        rows, blocks_of = [], []
        for lo in range(0, len(start), 512):
            hi = min(len(start), lo + 512)
            span = slice(start[lo], start[hi] if hi < len(start) else len(code))
            bound = np.add.reduceat(self.dense[code[span]], start[lo:hi] - start[lo], axis=0)
            r, b = np.nonzero(bound >= threshold - 1e-6)
            rows.append(passage[start[lo:hi]][r])
            blocks_of.append(b)
        rows, blocks_of = np.concatenate(rows), np.concatenate(blocks_of)
        out, wanted = [], np.zeros(self.dense.shape[1], bool)
        where = np.searchsorted(passage, np.arange(n + 1))
        for x in np.unique(rows):
            terms = code[where[x]: where[x + 1]]
            blocks = blocks_of[np.searchsorted(rows, x): np.searchsorted(rows, x, "right")]
            many = self.first[terms + 1] - self.first[terms]
            flat = np.repeat(self.first[terms] - np.cumsum(many) + many, many) + np.arange(many.sum())
            wanted[blocks] = True
            flat = flat[wanted[self.seg[flat] // BLOCK]]
            wanted[blocks] = False
            score = np.bincount(self.seg[flat], self.weight[flat])
            out += [(int(x), int(s), float(score[s])) for s in np.flatnonzero(score >= threshold - 1e-9)]
        return out


def find_leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap, n_passages) of verified leaks.

    score is the best BM25 share of an item's segment in a passage. Null, empty and wordless texts match
    nothing; repeated rows of a doc_id are one document, repeated rows of an item_id are one
    item; null ids are kept as ids. Other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    seg = segments(items)
    terms = seg.select(F.explode(F.array_distinct("words")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    terms = settle(terms, "terms")
    n, mean, postings = seg.agg(F.count("*"), F.avg(F.size("words")), F.sum(F.size("words"))).first()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, n_passages long"
    out = None
    n_shards = max(1, -(-(postings or 0) // SHARD))
    for s in range(n_shards):
        # A shard holds about SHARD postings, whatever the number of items.
        own = seg.where(F.pmod(F.xxhash64("item_id", "segment", F.hash("words")), F.lit(n_shards)) == s)
        rows = own.collect()
        if not rows:
            continue
        df = {r["term"]: r["df"] for r in own.select(F.explode("words").alias("term")).distinct().join(terms, "term").collect()}
        index = docs.sparkSession.sparkContext.broadcast(Shard(rows, df, n, mean))

        def search(batches, index=index):
            shard = index.value
            span = shard.longest
            for batch in batches:
                for piece in pieces(batch, "text"):
                    data, at = joined(piece.column("text"))
                    words, start, _ = words_of(data, plain=True)
                    if not len(words):
                        continue
                    doc = np.searchsorted(at, start, "right") - 1
                    first = np.searchsorted(start, at)
                    lanes = -(-np.diff(first) // span)
                    base = np.r_[0, np.cumsum(lanes + 1)]  # a spare lane keeps documents apart
                    lane = base[doc] + 1 + (np.arange(len(words)) - first[doc]) // span
                    got: dict = {}
                    for x, k, score in shard.retrieve(words, lane, int(base[-1]) + 2, threshold):
                        d = int(np.searchsorted(base, x, "right")) - 1
                        a = first[d] + max(0, x - base[d] - 1) * span
                        b = min(first[d + 1], first[d] + (x - base[d] + 1) * span)
                        size, *parts = shard.grams[k]
                        grams = _grams(words[a:b], size)
                        q, r = (float(np.isin(g, grams).mean()) for g in parts)
                        if q >= overlap and r >= overlap:
                            key = (d, shard.items[k])
                            old = got.get(key, (0.0, 0.0, 0.0, 0))
                            got[key] = (*max(old[:3], (score, q, r)), old[3] + 1)
                    if got:
                        ids = piece.column("doc_id").to_pylist()
                        rows = [(ids[d], i, *v) for (d, i), v in got.items()]
                        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64())
                        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)],
                                              names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "n_passages"])

        part = texts.mapInArrow(search, schema)
        out = part if out is None else out.union(part)
    if out is None:
        out = docs.sparkSession.createDataFrame([], schema)
    best = F.max(F.struct("score", "question_overlap", "answer_overlap"))
    return out.groupBy("doc_id", "item_id").agg(best.alias("b"), F.max("n_passages").alias("n_passages")).select("doc_id", "item_id", "b.*", "n_passages")


@query("op2_decontamination")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return leaks.select("doc_id", "item_id", F.round("score", 9).alias("score"), F.round("question_overlap", 9).alias("question_overlap"),
                        F.round("answer_overlap", 9).alias("answer_overlap"), "n_passages")
