"""Two-level scans, sliding windows and tiled joins against plain loops, on tiny chunks."""

import random

from pyspark.sql import functions as F

from cuewise.operators.scan import Scan, asof, chunk_of, overlap_join, points_in_ranges, running, sliding


def series(spark, n=40, seed=1):
    r = random.Random(seed)
    rows = [("v", i, r.choice([None, r.randint(0, 9)])) for i in range(n)]
    return rows, spark.createDataFrame(rows, "video_id string, pos long, x long")


def test_running_matches_a_plain_loop(spark):
    rows, df = series(spark)
    out = running(df, ["video_id"], ["pos"], chunk_of("pos", 3), {
        "s": Scan("sum", F.col("x")), "m": Scan("max", F.col("x"), inclusive=True),
        "l": Scan("last", F.col("x")), "f": Scan("first", F.col("x"))}).orderBy("pos").collect()
    xs = [x for _, _, x in rows]
    for i, r in enumerate(out):
        before = [x for x in xs[:i] if x is not None]
        upto = [x for x in xs[: i + 1] if x is not None]
        after = [x for x in xs[i + 1:] if x is not None]
        assert r["s"] == sum(before)
        assert r["m"] == (max(upto) if upto else None)
        assert r["l"] == (before[-1] if before else None)
        assert r["f"] == (after[0] if after else None)


def test_sliding_matches_a_plain_loop(spark):
    rows, df = series(spark)
    out = sliding(df, ["video_id"], "pos", 2, {"n": lambda w: F.count("x").over(w.rowsBetween(-2, 2))}, chunk=5)
    got = {r["pos"]: r["n"] for r in out.collect()}
    xs = [x for _, _, x in rows]
    assert got == {i: sum(x is not None for x in xs[max(i - 2, 0): i + 3]) for i in range(len(xs))}


def test_asof_both_ways(spark):
    r = random.Random(2)
    ev = sorted(r.sample(range(500), 30))
    pts = [("v", i, r.randrange(500)) for i in range(60)]
    events = spark.createDataFrame([("v", t) for t in ev], "video_id string, t long")
    points = spark.createDataFrame(pts, "video_id string, id long, at long")
    back = asof(points, events, ["video_id"], "at", "t", ["t"], "backward", [], 50).collect()
    ahead = asof(points, events, ["video_id"], "at", "t", ["t"], "forward", [], 50).collect()
    for row in back:
        assert row["t"] == max((t for t in ev if t <= row["at"]), default=None)
    for row in ahead:
        assert row["t"] == min((t for t in ev if t >= row["at"]), default=None)


def test_tiled_joins_find_each_pair_once(spark):
    r = random.Random(3)
    a = [(i, s, s + r.randint(1, 60)) for i, s in enumerate(r.randrange(300) for _ in range(40))]
    b = [(i, s, s + r.randint(1, 90)) for i, s in enumerate(r.randrange(300) for _ in range(15))]
    left = spark.createDataFrame([("v", *x) for x in a], "video_id string, i long, s long, e long")
    right = spark.createDataFrame([("v", *x) for x in b], "video_id string, j long, a long, b long")
    got = sorted((x["i"], x["j"]) for x in overlap_join(left, right, ["video_id"], ("s", "e"), ("a", "b"), 20).collect())
    assert got == sorted((i, j) for i, s, e in a for j, c, d in b if e > c and s < d)
    hit = points_in_ranges(left, right, ["video_id"], "s", F.col("a"), F.col("b"), 20)
    assert sorted((x["i"], x["j"]) for x in hit.collect()) == sorted((i, j) for i, s, _ in a for j, c, d in b if c <= s <= d)
