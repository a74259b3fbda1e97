"""Exact top-k search by inner product with a pivot table.

Inner products are distances in disguise: q.c = (|q|^2 + |c|^2 - d(q, c)^2) / 2. The table holds the distance of every row to a few
pivots. By the triangle inequality d(q, c) is at least the largest |d(q, p) - d(c, p)| over the pivots p, which bounds the
score from above, without looking at the candidate's components:

1. Rows form cells by their nearest pivot; a cell of many rows is cut into blocks of bounded size.
2. Each query is scored in one block of its own cell; its k-th best score is a threshold that no later candidate may miss.
3. For each cell the smallest and largest distance to each pivot and the largest norm bound all its scores. A query goes to the blocks of
   those cells whose bound reaches its threshold, and to no others.
4. In a block, candidates are evaluated in the order of their own bounds, in growing batches, until the next bound is below the
   k-th best score. What is left cannot enter the result, so it is exact.

On vectors without structure the bounds exclude little, and the work is that of all products, in blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuewise.llm.common import bounded_batches, query, settle, table

PIVOTS = 16
SAMPLE = 2000  # rows from which pivots are chosen; they decide what is skipped, never the result
BLOCK = 1 << 16  # rows of a block
QUERIES = 1 << 13  # queries that meet a block in one task
FIRST = 64  # candidates of the first batch
TOGETHER = 32  # queries that are searched for at once
EXACT = 2.0 ** 53
NULL_ID = (1 << 63) - 1

ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) y FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id query_id, c.vec_id, list_dot_product(q.y, c.y)::BIGINT score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
"""


def _matrix(column: pa.Array | pa.ChunkedArray, kind: str = "<f8") -> np.ndarray:
    """Equally long binaries as the rows of a matrix."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), kind).reshape(len(rows), -1)


def _whole(embedding: list | None, scale: float) -> np.ndarray | None:
    """floor(scale * x) of each component, or None for vectors that take no part."""
    if embedding is None or any(x is None for x in embedding):
        return None
    with np.errstate(over="ignore", invalid="ignore"):
        y = np.floor(np.array(embedding, float) * scale)
    return y if np.isfinite(y).all() else None


def _pivots(rows: list[np.ndarray], n: int) -> np.ndarray:
    """Rows far from each other: each next one has the largest distance to those taken."""
    data = np.array(rows)
    far, taken = ((data - data.mean(0)) ** 2).sum(1), []
    for _ in range(min(n, len(data))):
        k = int(far.argmax())
        if taken and far[k] <= 0:
            break
        taken.append(k)
        own = ((data - data[k]) ** 2).sum(1)
        far = np.minimum(far, own) if len(taken) > 1 else own
    return data[taken]


def _slack(norms: np.ndarray | float) -> np.ndarray | float:
    """More than rounding can take from a bound on squares of this size."""
    return 1e-9 * norms + 1e-6


def scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products of one whole-number vector with many, clipped to 64 bits; Python's integers where doubles could round."""
    if np.sqrt((q * q).sum() * (c * c).sum(1).max(initial=0)) < EXACT:
        return c @ q
    whole = [int(x) for x in q]
    return np.array([min(max(sum(a * int(b) for a, b in zip(whole, row)), -(1 << 63)), (1 << 63) - 1) for row in c], object)


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-number rows, clipped to 64 bits; a row for each candidate."""
    if np.sqrt((q * q).sum(1).max(initial=0) * (c * c).sum(1).max(initial=0)) < EXACT:
        return c @ q.T
    return np.stack([scores(row, c) for row in q], 1)


def search(q: np.ndarray, q_dist: np.ndarray, floor: np.ndarray, own: np.ndarray, ids: np.ndarray, c: np.ndarray, c_dist: np.ndarray, c_sq: np.ndarray, k: int):
    """For each of some queries the places and scores of its k best candidates with scores of its ``floor`` or more, ties to
    smaller ids, its own id excluded.

    The candidates are taken in the order of their best bound for any of the queries, in batches that grow fourfold, and a batch leaves out what
    no query can use any more; the end is where the next bound is below every floor.
    """
    far = np.zeros((len(q), len(ids)))
    for j in range(q_dist.shape[1]):
        gap = c_dist[j][None] - q_dist[:, j, None]
        np.maximum(far, np.abs(gap, out=gap), out=far)
    sq = (q * q).sum(1)[:, None] + c_sq[None]
    bound = (sq - far * far) / 2 + _slack(sq)
    bound[own[:, None] == ids[None]] = -np.inf
    most, floor = bound.max(0), floor.copy()
    order = np.argsort(-most, kind="stable")
    best = [(np.zeros(0, np.int64), np.zeros(0)) for _ in range(len(q))]
    at, size = 0, FIRST
    while at < len(order) and most[order[at]] >= floor.min() and most[order[at]] > -np.inf:
        now = order[at: at + size]
        at, size = at + size, 4 * size
        now = now[(bound[:, now] >= floor[:, None]).any(0)]
        got = products(q, c[now])
        for i in range(len(q)):
            hit = np.flatnonzero((got[:, i] >= floor[i]) & (bound[i, now] > -np.inf))
            if not len(hit):
                continue
            place, score = np.r_[best[i][0], now[hit]], np.r_[best[i][1], got[hit, i]]
            if len(place) > 4 * k and score.dtype != object:
                enough = np.flatnonzero(score >= -np.partition(-score, k - 1)[k - 1])
                place, score = place[enough], score[enough]
            top = np.lexsort((ids[place], -score))[:k] if score.dtype != object else np.array(sorted(range(len(place)), key=lambda x: (-score[x], ids[place[x]]))[:k])
            best[i] = place[top], score[top]
            if len(top) == k:
                last = float(score[top[-1]])
                floor[i] = max(floor[i], last - _slack(abs(last)))
    return best


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: float = 64.0) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of (vec_id, embedding) whose vec_id is divisible by ``every`` the k rows of
    other ids with the highest inner product of floor(scale * x), ties to smaller ids.

    Vectors that are null or hold null or non-finite components take no part. Shorter vectors count as filled up with zeros. Rows of a
    null vec_id are candidates after all others of their score. Rows that repeat a vec_id are candidates each, and one query (the
    one whose components, as bytes, come first). Scores are exact; those beyond 63 bits count as the largest or smallest LONG. Other columns
    are ignored.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("embedding is not null")
    width = rows.select(F.max(F.size("embedding"))).first()[0]
    schema = "query_id long, rank int, vec_id long, score long"
    sample = rows.orderBy(F.xxhash64("vec_id", "embedding")).limit(SAMPLE).select("embedding").collect()
    sample = [y for y in (_whole(r.embedding, scale) for r in sample) if y is not None]
    pad = lambda y: np.r_[y, np.zeros(width - len(y))]
    pivots = _pivots([pad(y) for y in sample], PIVOTS) if sample else np.zeros((1, width or 0))

    def measure(batches):
        for b in batches:
            got = [(i, y) for i, y in zip(b.column("vec_id").to_pylist(), (_whole(e, scale) for e in b.column("embedding").to_pylist())) if y is not None]
            if not got:
                continue
            y = np.array([pad(v) for _, v in got])
            dist = np.sqrt(np.stack([((y - p) ** 2).sum(1) for p in pivots], 1))
            yield pa.record_batch({
                "vec_id": pa.array([NULL_ID if i is None else i for i, _ in got], pa.int64()), "cell": pa.array(dist.argmin(1).astype(np.int32)),
                "y": pa.array([r.tobytes() for r in y], pa.binary()), "dist": pa.array([r.tobytes() for r in dist], pa.binary()),
                "far": pa.array(dist.tolist(), pa.list_(pa.float64())), "sq": pa.array((y * y).sum(1))})

    points = settle(rows.mapInArrow(measure, "vec_id long, cell int, y binary, dist binary, far array<double>, sq double"), "points")
    # A row for each cell: no more than there are pivots.
    reach = [f"{f}(far[{j}]) as {f}{j}" for j in range(len(pivots)) for f in ("min", "max")]
    cells = points.groupBy("cell").agg(F.count("*").alias("n"), F.max("sq").alias("sq"), *map(F.expr, reach)).collect()
    parts = {r.cell: -(-r.n // BLOCK) for r in cells}
    low, high = (np.array([[r[f"{f}{j}"] for j in range(len(pivots))] for r in cells]).reshape(-1, len(pivots)) for f in ("min", "max"))
    cell_id, cell_sq = [r.cell for r in cells], np.array([r.sq for r in cells])
    cell_parts = F.element_at(F.create_map(*[F.lit(x) for kv in (parts or {0: 1}).items() for x in kv]), F.col("cell"))
    blocks = points.withColumn("part", F.pmod(F.xxhash64("vec_id", "y"), cell_parts).cast("int"))
    asked = points.where(F.col("vec_id") % every == 0).where(F.col("vec_id") != NULL_ID)
    asked = settle(asked.groupBy("vec_id").agg(F.min(F.struct("y", "cell", "dist")).alias("q")).select("vec_id", "q.*"), "queries")

    def meet(q: DataFrame, name: str) -> DataFrame:
        """Score queries (vec_id, y, dist, floor, cell, part, slot) in the block and slot named; each slot has the block's rows."""
        slots = q.groupBy("cell", "part").agg(F.max("slot").alias("slots"))
        copies = blocks.join(slots, ["cell", "part"]).withColumn("slot", F.explode(F.sequence(F.lit(0), "slots")))
        key = ["cell", "part", "slot"]

        def run(_, left, right):
            if not left.num_rows or not right.num_rows:
                return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64()), "place": pa.array([], pa.int32())})
            ids, c = np.asarray(right.column("vec_id")), _matrix(right.column("y"))
            c_dist, c_sq = np.ascontiguousarray(_matrix(right.column("dist")).T), (c * c).sum(1)
            out = {"query_id": [], "vec_id": [], "score": [], "place": []}
            own, floor, y, d = np.asarray(left.column("vec_id")), np.asarray(left.column("floor")), _matrix(left.column("y")), _matrix(left.column("dist"))
            alike = np.lexsort(d.T)  # neighbours ask for the same candidates
            for some in np.array_split(alike, -(-len(alike) // TOGETHER)):
                for i, (at, s) in zip(own[some].tolist(), search(y[some], d[some], floor[some], own[some], ids, c, c_dist, c_sq, k)):
                    out["query_id"] += [i] * len(at)
                    out["vec_id"] += ids[at].tolist()
                    out["score"] += [int(x) for x in s]
                    out["place"] += range(len(at))
            return pa.table({n: pa.array(v, pa.int32() if n == "place" else pa.int64()) for n, v in out.items()})

        left = q.select(*key, "vec_id", "y", "dist", "floor").groupBy(*key)
        right = copies.select(*key, "vec_id", "y", "dist").groupBy(*key)
        return settle(left.cogroup(right).applyInArrow(run, "query_id long, vec_id long, score long, place int"), name)

    home = asked.withColumn("part", F.pmod(F.xxhash64("vec_id"), cell_parts).cast("int")).withColumn("floor", F.lit(float("-inf")))
    first = meet(home.withColumn("slot", F.lit(0)), "home")
    least = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))

    def visits(batches):
        """The cells whose bound reaches a query's threshold."""
        for b in batches:
            y, d = _matrix(b.column("y")), _matrix(b.column("dist"))
            floor = np.array([-np.inf if x is None else float(x) - _slack(abs(float(x))) for x in b.column("least").to_pylist()])
            far = np.maximum(np.maximum(d[:, None] - high[None], low[None] - d[:, None]).max(2), 0)
            sq = (y * y).sum(1)[:, None] + cell_sq[None]
            q, c = np.nonzero((sq - far * far) / 2 + _slack(sq) >= floor[:, None])
            out = b.select(["vec_id", "y", "dist", "home"]).take(pa.array(q))
            yield out.append_column("cell", pa.array([cell_id[x] for x in c], pa.int32())).append_column("floor", pa.array(floor[q]))

    near = home.select("vec_id", "y", "dist", F.struct("cell", "part").alias("home")).join(least, F.col("vec_id") == F.col("query_id"), "left").drop("query_id")
    found = near.mapInArrow(visits, "vec_id long, y binary, dist binary, home struct<cell int, part int>, cell int, floor double")
    found = found.withColumn("part", F.explode(F.sequence(F.lit(0), cell_parts - 1))).where((F.col("home.cell") != F.col("cell")) | (F.col("home.part") != F.col("part")))
    # Queries of a block are dealt to slots by hash, so that no task gets more than about QUERIES of them.
    n_slots = -(-asked.count() // QUERIES)
    rest = meet(found.withColumn("slot", F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(max(1, n_slots))).cast("int")), "rest")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id", "place")
    ranked = first.union(rest).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.when(F.col("vec_id") != NULL_ID, F.col("vec_id")).alias("vec_id"), "score")


@query("op12_pivot_topk", ORACLE)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))
