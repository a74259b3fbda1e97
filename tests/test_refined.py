"""Edge refinement, replies, speaker track and other mended cases against plain loops and literal cases."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from cuewise.operators import detect as D
from cuewise.operators import intervals as I
from cuewise.operators import lines as L
from cuewise.operators import outline as O
from cuewise.operators import presence as P
from cuewise.operators import series as S
from cuewise.sources import ingest as G


def quiet(ms, a, b, pref):
    lo, hi = min(a, b), max(a, b)
    pref = min(max(pref, lo), hi)
    i, j = min(max(a // 10, 0), len(ms) - 1), min(b // 10, len(ms) - 1) - 2
    if len(ms) < 3 or b - a < 30 or j < i:
        return pref
    db = {h: max(10 * math.log10(sum(ms[h:h + 3]) / 3 + 1e-10), -100.0) for h in range(i, j + 1) if h + 3 <= len(ms)}
    floor = min(db.values())
    best = min((abs(h * 10 + 15 - pref), h) for h in db if db[h] <= floor + 1.5)
    return min(max(best[1] * 10 + 15, lo), hi)


def refine(keeps, words, ms):
    old, now = list(keeps), list(keeps)
    for i, (a, b) in enumerate(keeps):
        inside = [(s, e) for s, e in words if s < b and e > a]
        first, last = (inside[0][0] if inside else a), max([a, *[e for _, e in inside]])
        before = max((e for _, e in words if e <= min(a, first)), default=-10**9)
        after = min((s for s, _ in words if s >= max(b, last)), default=10**9)
        behind = now[i - 1][1] + 20 if i else -10**9
        if i == 0:
            lo, hi = max(first - 200, before + 30), first
            pref = max(first - 120, lo)
        else:
            lo, hi, pref = max(a - 60, before + 20, behind), min(a + 40, first), a
        na = quiet(ms, lo, hi, min(max(pref, lo), hi)) if hi - lo > 30 else (min(max(lo, 0), a) if i == 0 and lo < a else a)
        if i + 1 == len(keeps):
            lo, hi = last, min(last + 300, after - 30)
            pref = min(last + 200, hi)
        else:
            lo, hi, pref = max(b - 60, last), min(b + 60, after - 20, old[i + 1][0] - 20), b
        nb = quiet(ms, lo, hi, min(max(pref, lo), hi)) if hi - lo > 30 else b
        now[i] = (na, nb) if nb - na >= 200 else (a, b)
    return now


def test_edges_move_to_quiet_instants(spark):
    rng = random.Random(7)
    words, keeps, energy, want = [], [], [], {}
    for v in range(12):
        said, t = [], rng.randrange(0, 300)
        for p in range(30):
            e = t + rng.randrange(60, 400)
            said.append((t, e))
            words.append((v, p, "w", t, e))
            t = e + rng.choice([0, 20, 60, 150, 400])
        ms = [rng.choice([1e-9, 1e-4, 0.01, 0.02]) for _ in range(t // 10 + 40)]
        energy += [(v, h, x) for h, x in enumerate(ms)]
        cuts = sorted(rng.sample(range(said[0][0], t), 8))
        spans = [(a, b - 30) for a, b in zip(cuts, cuts[1:]) if b - a > 60]
        keeps += [(v, 1, k, a, b) for k, (a, b) in enumerate(spans)]
        want |= {(v, k): x for k, x in enumerate(refine(spans, said, ms))}
    removed = [(v, 1, b, keeps[i + 1][3], "pause") for i, (v, _, k, a, b) in enumerate(keeps[:-1]) if keeps[i + 1][0] == v]
    kd = spark.createDataFrame(keeps, "video_id long, rank long, k long, a_ms long, b_ms long")
    rd = spark.createDataFrame(removed, "video_id long, rank long, a_ms long, b_ms long, reason string")
    out, cuts = I.refine_edges(kd, rd, spark.createDataFrame(words, "video_id long, pos long, w string, s_ms long, e_ms long"),
                               spark.createDataFrame(energy, "video_id long, hop long, ms double"))
    got = {(r.video_id, r.k): (r.a_ms, r.b_ms) for r in out.collect()}
    assert got == want and any(got[x] != y for x, y in {(v, k): (a, b) for v, _, k, a, b in keeps}.items())
    ends = {(r.video_id, r.a_ms, r.b_ms) for r in cuts.collect()}
    assert ends <= {(v, got[v, k][1], got[v, k + 1][0]) for v, k in got if (v, k + 1) in got}


def test_replies_use_every_block_and_one_scale(spark):
    clip = '{"start_s":1,"end_s":20,"hook_line":"h","scores":{"hook":7,"retention":6,"value":5,"share":10}}'
    big = clip.replace('"hook":7', '"hook":70')
    rows = [("a", f"x ```json\n[1,\n``` y ```\n{{no\n``` z ```json\n{{\"clips\":[{clip}]}}\n```"), ("b", f"[{big}]"), ("c", "none"), ("d", None)]
    got = {r.video_id: r.scores for r in G.reply_candidates(spark.createDataFrame(rows, "video_id string, reply string")).collect()}
    assert set(got) == {"a", "b"} and tuple(got["a"]) == (70, 60, 50, 100) and got["b"].hook == 70


def test_infinite_chapter_starts_are_left_out(spark):
    rows = [("v", x, t, n) for n, (x, t) in enumerate([(math.inf, "inf"), (0.0, "z"), (0.0, "a"), (50.0, "b"), (-math.inf, "c"), (100.0, "d"), (math.nan, "e")])]
    df = spark.createDataFrame(rows, "video_id string, start_s double, title string, n long")
    got = [r.title for r in O.tidy(df, spark.createDataFrame([("v", 500_000)], "video_id string, duration_ms long")).orderBy("n").collect()]
    assert got == ["z", "b", "d"]


def test_flash_after_a_gap_of_600_ms_inside_a_line(spark, make_words):
    w = make_words("one two a b", pause={1: 550, 2: 100})
    packed = w.withColumn("line", F.when(F.col("pos") < 2, 0).when(F.col("pos") == 2, 2).otherwise(3).cast("long"))
    got = {r.pos: r.line for r in L.merge_flashes(packed, 20, short_ms=500).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 2}


def test_mouth_motion_has_a_row_per_face(spark):
    px = spark.createDataFrame([("v", f, y, x, 0 if f == 1 else 255, 10, 20) for f in (1, 2) for y in range(100) for x in range(100)],
                               "video_id string, frame long, y long, x long, r long, g long, b long")
    box = "struct<x:double,y:double,w:double,h:double,score:double>"
    faces = spark.createDataFrame([("v", 1, 0, (10.0, 10.0, 50.0, 50.0, 1.0)), ("v", 2, 0, (12.0, 10.0, 50.0, 50.0, 1.0)), ("v", 2, 1, (70.0, 70.0, 20.0, 20.0, 1.0)),
                                   ("v", 9, 0, (0.0, 0.0, 0.0, 0.0, 1.0))], f"video_id string, frame long, det long, box {box}")
    got = {(r.frame, r.det): r.motion for r in D.mouth_motion(px, faces, ("r", "g", "b")).collect()}
    assert got == {(1, 0): 0.0, (2, 0): 1.0, (2, 1): 0.0, (9, 0): 0.0}


def test_shots_clear_the_speech_memory(spark):
    rows = [("v", i, i == 2, i == 5) for i in range(10)]
    df = spark.createDataFrame(rows, "video_id string, i long, said boolean, shot boolean")
    got = [r["left"] for r in D.since_last_true(df, "said", 4, "shot").orderBy("i").collect()]
    assert got == [0, 0, 4, 3, 2, 0, 0, 0, 0, 0]


def test_speaker_needs_speech_and_time_to_take_over():
    a, b = [100.0, 100, 80, 100, 0.9, 0.0], [500.0, 100, 80, 100, 0.9, 0.9]
    both = np.array([a, b])
    start = [(0.0, np.array([a]), True)]
    silent = [(k / 15, both, False) for k in range(1, 30)]
    assert {p for p, _ in P.track_speaker(start + silent, 1000.0)} == {0}
    spoken = [(k / 15, both, True) for k in range(1, 30)]
    picks = P.track_speaker(start + spoken, 1000.0)
    assert [k for k, (_, took) in enumerate(picks) if took] == [2] and picks[-1][0] == 1
    back = [(2 + k / 15, np.array([[*a[:5], 0.9], [*b[:5], 0.0]]), True) for k in range(60)]
    took = [k for k, (_, t) in enumerate(P.track_speaker(start + spoken + back, 1000.0)) if t]
    assert took[1] == 40  # the floor is free 2.5 s after the last change, before 0.75 s of leading
    assert P.track_speaker([(0.0, np.zeros((0, 6)), True), (3.0, both, True)], 1000.0)[0] == (None, False)


def test_exponential_and_high_pass_equal_loops(spark):
    rng = random.Random(3)
    x = [rng.random() for _ in range(700)]
    df = spark.createDataFrame([("v", i, v) for i, v in enumerate(x)], "video_id string, i long, x double")
    want = [x[0]]
    for v in x[1:]:
        want.append(0.15 * v + 0.85 * want[-1])
    got = [r.smoothed for r in S.exponential(df, "x", 0.15, chunk=256).orderBy("i").collect()]
    assert np.allclose(got, want)
    for rate in (8000, 192_000):
        n = rate // 4
        y = [math.sin(i * 0.01) + 0.5 for i in range(n)]
        alpha, out, px, py = math.exp(-2 * math.pi * 100 / rate), [], 0.0, 0.0
        for v in y:
            py, px = alpha * (py + v - px), v
            out.append(py * py)
        hop = rate // 100
        want = [sum(out[k:k + hop]) / hop for k in range(0, n, hop)]
        df = spark.createDataFrame([("v", i, v) for i, v in enumerate(y)], "video_id string, i long, x double")
        got = [r.ms for r in S.high_pass_energy(df, rate, chunk=1 << 12).orderBy("hop").collect()]
        assert np.allclose(got, want, atol=1e-8)
