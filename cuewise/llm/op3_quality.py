"""Ordinal quality classifier: cumulative-link regression on hashed text.

A grade y of 0..K-1 has P(y <= k) = sigmoid(threshold_k - score), with one score (shared weights over hashed
features of the whole text) and ordered thresholds. Features are the presence of hashed word beginnings
of 3, 4 and 5 bytes and of word endings of 2 bytes, and a few shares of the text (capitals, symbols, digits, distinct
words, repeated neighbours). The fit has two steps: a score test of each hashed feature against the
thresholds-only model keeps those beyond ``screen`` standard errors, then all weights and thresholds are
fitted together. Counting for the test runs on Spark; the second step sees only kept features of a bounded sample.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuewise.llm.common import _LOWER, Roller, bounded_batches, joined, pieces, query, settle, table, words_of

BITS = 18
TRAIN_ROWS = 12_000  # ratings that the model is fitted on: those with the smallest hashes of their id
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[*range(33, 44), 45, 47, *range(58, 65), *range(91, 97), *range(123, 127)]] = True
N_SHARES = 7
_ROLLERS: list[Roller] = []


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # by hashed feature
    shares: np.ndarray
    thresholds: np.ndarray  # ascending, one fewer than grades


def features(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed features and the shares of one text (bytes)."""
    if not _ROLLERS:
        _ROLLERS.append(Roller(3))
    r = _ROLLERS[0]
    words, start, end = words_of(data)
    sums, parts = r.sums(_LOWER[data]), []
    for k in (3, 4, 5):
        long = end - start >= k
        parts.append(r.at(sums, start[long], start[long] + k) * np.uint64(2 * k + 1))
    long = end - start >= 2
    parts.append(r.at(sums, end[long] - 2, end[long]) * np.uint64(99))
    hashed = np.unique(np.concatenate(parts) >> np.uint64(64 - BITS)).astype(np.int64)
    n, m = max(1, len(data)), max(1, len(words))
    shares = np.array([
        ((data >= 65) & (data <= 90)).sum() / n, _SYMBOL[data].sum() / n, ((data >= 48) & (data <= 57)).sum() / n,
        len(np.unique(words)) / m, (words[1:] == words[:-1]).sum() / m, 1.0, min(1.0, m / 100)])
    return hashed, shares


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_links(row: np.ndarray, col: np.ndarray, width: int, shares: np.ndarray, y: np.ndarray, k: int,
              rounds: int = 300, ridge: float = 1e-4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights, share weights and thresholds that minimise the mean cumulative-link loss (full gradients, Adam).

    (row, col) are the places of ones in the sample's feature matrix. Thresholds are the first plus
    running sums of exponentials, hence ordered.
    """
    n = len(y)
    cum = np.cumsum(np.bincount(y, minlength=k) + 0.5)[:-1] / (n + 0.5 * k)
    start = np.log(cum / (1 - cum))
    p = np.concatenate([np.zeros(width + shares.shape[1]), start[:1], np.log(np.diff(start))])
    first, second = np.zeros_like(p), np.zeros_like(p)
    ns = width + shares.shape[1]
    decay = np.concatenate([np.full(width, ridge), np.full(shares.shape[1], ridge / 10), np.zeros(k - 1)])
    for t in range(1, rounds + 1):
        w, v = p[:width], p[width:ns]
        gaps = np.exp(p[ns + 1:])
        edge = np.concatenate([[-np.inf], p[ns] + np.concatenate([[0.0], np.cumsum(gaps)]), [np.inf]])
        s = np.bincount(row, w[col], n) + shares @ v
        a, b = np.where(y == k - 1, 1.0, _sigmoid(edge[y + 1] - s)), np.where(y == 0, 0.0, _sigmoid(edge[y] - s))
        q, g = np.maximum(a - b, 1e-9), 1 - a - b
        at = np.bincount(y, -a * (1 - a) / q, k)[:-1] + np.bincount(y, b * (1 - b) / q, k)[1:]
        later = np.cumsum(at[::-1])[::-1]
        grad = np.concatenate([np.bincount(col, g[row], width), g @ shares, later[:1], later[1:] * gaps]) / n + decay * p
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad * grad
        p = p - 0.1 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
    return p[:width], p[width:ns], p[ns] + np.concatenate([[0.0], np.cumsum(np.exp(p[ns + 1:]))])


def fit(docs: DataFrame, ratings: DataFrame, rows: int = TRAIN_ROWS, screen: float = 3.5) -> Model | None:
    """Fit on (doc_id, text) and ratings (doc_id, grade INT from 0 without gaps in meaning).

    Null ids and grades are left out; a document rated twice counts twice; ratings without a document
    are ignored. None if fewer than two grades are left to learn from.
    """
    bounded_batches(docs.sparkSession)
    rated = ratings.where("doc_id is not null and grade is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("grade").cast("int").alias("grade"))
    chosen = settle(rated.orderBy(F.xxhash64("doc_id"), "doc_id", "grade").limit(rows), "ratings")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def extract(batches):
        for batch in batches:
            for piece in pieces(batch, "text"):
                data, at = joined(piece.column("text"))
                got = [features(data[a: b - 1]) for a, b in zip(at, at[1:])]
                if got:
                    yield pa.record_batch({"grade": piece.column("grade"), "f": pa.array([f for f, _ in got], pa.list_(pa.int64())),
                                           "shares": pa.array([s for _, s in got], pa.list_(pa.float64()))})

    sample = settle(texts.join(chosen, "doc_id").select("grade", "text").mapInArrow(extract, "grade int, f array<long>, shares array<double>"), "sample")
    counts = {r["grade"]: r["count"] for r in sample.groupBy("grade").count().collect()}
    k = max(counts, default=0) + 1
    if len(counts) < 2:
        return None
    total = sum(counts.values())
    cum = np.cumsum([counts.get(g, 0) + 0.5 for g in range(k)]) / (total + 0.5 * k)
    residual = [1 - (cum[g] if g < k - 1 else 1.0) - (cum[g - 1] if g else 0.0) for g in range(k)]
    r = F.element_at(F.array(*[F.lit(float(x)) for x in residual]), F.col("grade") + 1)
    tested = sample.select(F.explode("f").alias("f"), r.alias("r")).groupBy("f").agg((F.sum("r") / F.sqrt(F.sum(F.col("r") * F.col("r")) + 1e-9)).alias("z"))
    kept = np.array(sorted(x["f"] for x in tested.where(F.abs("z") >= screen).select("f").collect()), np.int64)  # at most 2^BITS
    place = np.full(1 << BITS, -1)
    place[kept] = np.arange(len(kept))

    def slim(batches):
        for batch in batches:
            f = [[int(x) for x in place[np.array(row, np.int64)] if x >= 0] for row in batch.column("f").to_pylist()]
            yield pa.record_batch({"grade": batch.column("grade"), "f": pa.array(f, pa.list_(pa.int64())), "shares": batch.column("shares")})

    design = sample.mapInArrow(slim, sample.schema).toPandas().sort_values("grade", kind="stable")  # bounded by ``rows``
    order = np.lexsort(tuple(np.array([[*s, len(f)] for s, f in zip(design["shares"], design["f"])]).T))
    design = design.iloc[order]
    sizes = design["f"].map(len).to_numpy()
    row = np.repeat(np.arange(len(design)), sizes)
    col = np.concatenate([np.asarray(f, np.int64) for f in design["f"]] or [np.zeros(0, np.int64)])
    w, v, thresholds = fit_links(row, col, len(kept), np.stack(design["shares"].to_numpy()), design["grade"].to_numpy(), k)
    weights = np.zeros(1 << BITS)
    weights[kept] = w
    return Model(weights, v, thresholds)


def grade(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with ``score``, ``expected_grade`` and ``tail`` (the chance of the top grade) of each whole text.

    Null and empty texts are scored as texts without words. Without a model the three columns are null.
    Columns of the input with these names are replaced; all others are kept.
    """
    own = ["score", "expected_grade", "tail"]
    keep = [c for c in docs.columns if c not in own]
    docs = docs.select(*keep)
    if model is None:
        return docs.select("*", *[F.lit(None).cast("double").alias(c) for c in own])

    def run(batches):
        for batch in batches:
            for piece in pieces(batch, "text"):
                data, at = joined(piece.column("text").cast(pa.string()))
                s = np.zeros(piece.num_rows)
                for i, (a, b) in enumerate(zip(at, at[1:])):
                    f, shares = features(data[a: b - 1])
                    s[i] = model.weights[f].sum() + shares @ model.shares
                above = 1 - _sigmoid(model.thresholds[None] - s[:, None])
                yield pa.record_batch([*piece.columns, pa.array(s), pa.array(above.sum(1)), pa.array(above[:, -1])], names=[*keep, *own])

    schema = T.StructType([*docs.schema.fields, *[T.StructField(c, T.DoubleType()) for c in own]])
    return docs.mapInArrow(run, schema)


def grades(labels: DataFrame) -> DataFrame:
    """Grades of (doc_id, quality, toxic): toxic 0, else low quality 1, else 2; null quality has none."""
    g = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    return labels.select("doc_id", g.alias("grade"))


def keeps(threshold: float = 0.5) -> Column:
    """Selection by tail probability; documents without a score stay."""
    return F.coalesce(F.col("tail") >= threshold, F.lit(True))


@query("op3_quality_grade")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, grades(table(spark, sf_dir, "labels")))
    scored = grade(docs.select("doc_id", "text"), model).drop("text")
    return scored.select("doc_id", F.round("score", 9).alias("score"), F.round("expected_grade", 9).alias("expected_grade"),
                         F.round("tail", 9).alias("tail"), keeps().alias("selected"))
