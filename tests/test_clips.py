"""Picking, validation and intervals on small talks with known results."""

import random

import pytest
from pyspark.sql import functions as F

from cuewise.operators import candidates as C
from cuewise.operators import intervals as I
from cuewise.operators import segment
from cuewise.operators import validate as V
from cuewise.sources.testdata import durations

SCORES = "struct<hook:int,retention:int,value:int,share:int>"


def candidate(spark, start, end, hook="h", video="v"):
    df = spark.createDataFrame([(video, 0, start, end, hook, "w")], "video_id string, cand long, start_ms long, end_ms long, hook string, why string")
    return C.candidate_rows(df, "test")


def validated(spark, words, start, end, **rules):
    return V.validate(candidate(spark, start, end), words, durations(words), V.Rules(**rules)).collect()


def test_sentences_break_at_punctuation_and_thirty_words(make_words):
    text = "one two three. " + " ".join(f"w{i}" for i in range(40)) + " end!"
    got = segment.sentences(make_words(text)).orderBy("sent_start").collect()
    assert [(r["sent_start"], r["n_words"]) for r in got] == [(0, 3), (3, 30), (33, 11)]


def test_growth_matches_the_alternating_loop(spark, make_words):
    r = random.Random(5)
    text = " ".join("x" + ("." if r.random() < 0.12 else "") for _ in range(300))
    words = make_words(text)
    sents = [(x["sent_start"], x["sent_start"] + x["n_words"]) for x in segment.sentences(words).orderBy("sent_start").collect()]
    got = {x["hook"] + str(x["cand"]): x for x in C.propose(words, 20).collect()}
    ranked = segment.top_sentences(segment.scored_sentences(words), 20).orderBy("rn").collect()
    assert len(got) == len(ranked)
    for row in ranked:
        a, b = next(s for s in sents if s[0] == row["sent_start"])
        want, n = max(min((b - a) * 3, 60), 8), 300
        while b - a < want and (a > 0 or b < n):
            a = max(a - 1, 0)
            if b - a >= want or b >= n:
                break
            b += 1
        s, e = a * 500, (b - 1) * 500 + 450
        if e - s < 8000 and b < n:
            e = b * 500 + 450
        c = got[row["text"] + str(row["rn"] - 1)]
        assert (c["start_ms"], c["end_ms"]) == (s, e)


def test_hook_guard_skips_leading_fillers(spark, make_words):
    words = make_words("um uh " + " ".join(["go"] * 60))
    assert validated(spark, words, 0, 20_000, complete_gate=False)[0]["start_ms"] == 1000


def test_gate_extends_to_the_sentence_end(spark, make_words):
    words = make_words(" ".join(["go"] * 29 + ["stop."] + ["on"] * 40))
    row = validated(spark, words, 0, 10_000, min_ms=5000)[0]
    assert (row["start_ms"], row["end_ms"]) == (0, 14_950)


def test_without_punctuation_the_gate_changes_nothing(spark, make_words):
    row = validated(spark, make_words(" ".join(["go"] * 100)), 1000, 21_000)[0]
    assert (row["start_ms"], row["end_ms"]) == (500, 20_950) or row["end_ms"] - row["start_ms"] >= 19_000


def test_validation_over_many_tiles_equals_one_tile(spark, make_words, monkeypatch):
    r = random.Random(9)
    text = " ".join(r.choice(["go", "um", "end.", "what?", "so"]) for _ in range(900))
    words = make_words(text, {i: 2500 for i in range(0, 900, 70)})
    rows = [("v", i, s, s + r.randint(1000, 150_000), f"h{i}", "w") for i, s in enumerate(r.randrange(450_000) for _ in range(60))]
    cands = C.candidate_rows(spark.createDataFrame(rows, "video_id string, cand long, start_ms long, end_ms long, hook string, why string"), "t")
    key = lambda df: sorted((x["cand"], x["start_ms"], x["end_ms"]) for x in df.collect())
    wide = key(V.validate(cands, words, durations(words)))
    monkeypatch.setattr(V, "TILE_MS", 30_000)
    assert key(V.validate(cands, words, durations(words))) == wide and wide


def test_tighten_shrinks_a_pause(spark, make_words):
    words = make_words("a b c d e f g h", {4: 3000})
    rng = spark.createDataFrame([("v", 1, 0, 7000)], "video_id string, rank long, a_ms long, b_ms long")
    plan = I.tighten(rng, words).collect()[0]
    assert [(k["a"], k["b"]) for k in plan["keeps"]] == [(0, 2100), (4900, 7000)]
    assert plan["removed"][0]["reason"] == "pause 3.1s->0.25s"


def test_a_gutted_plan_relaxes_to_the_whole_range(spark, make_words):
    words = make_words("a b", {1: 20_000})
    rng = spark.createDataFrame([("v", 1, 0, 21_000)], "video_id string, rank long, a_ms long, b_ms long")
    plan = I.tighten(rng, words, I.Tighten(mode="punchy")).collect()[0]
    assert plan["mode"] == "off" and [(k["a"], k["b"]) for k in plan["keeps"]] == [(0, 21_000)]


def test_ranges_fuse(spark):
    r = spark.createDataFrame([("v", 97_000, 112_000), ("v", 23_800, 38_800), ("v", 86_000, 101_000)], "video_id string, a_ms long, b_ms long")
    assert sorted((x["a_ms"], x["b_ms"]) for x in I.fuse_ranges(r, ["video_id"]).collect()) == [(23_800, 38_800), (86_000, 112_000)]


def test_timecut_parts(spark):
    r = spark.createDataFrame([("v", 0, 200_000)], "video_id string, a_ms long, b_ms long")
    assert segment.timecut(r, 30_000).count() == 7
    short = spark.createDataFrame([("v", 0, 62_000)], "video_id string, a_ms long, b_ms long")
    assert segment.timecut(short, 30_000).count() == 2


def test_random_stream_matches_unsigned_arithmetic(spark):
    mask, x, want = (1 << 64) - 1, 42, []
    for _ in range(6):
        x ^= (x << 13) & mask
        x ^= x >> 7
        x ^= (x << 17) & mask
        want.append(x / float(1 << 64))
    got = spark.range(1).select(C.random_stream(F.lit(42).cast("long"), 6).alias("u")).first()["u"]
    assert got == pytest.approx(want, abs=0)


def test_worst_pick_goes_first(spark):
    rows = [("v", 1, 0, 50_000, 80.0), ("v", 2, 60_000, 100_000, 60.0), ("v", 3, 200_000, 230_000, 60.0)]
    df = spark.createDataFrame(rows, "video_id string, rank long, start_ms long, end_ms long, score_total double")
    assert sorted(r["rank"] for r in I.cap_by_score(df, ["video_id"], 90_000).collect()) == [1, 3]


def plan_of(a, b, ws):
    """The light plan of a range, as a plain loop."""
    if b - a < 1000:
        return [(a, b)]
    cuts, prev, first = [], a, True
    for s, e in [w for w in ws if w[1] > a and w[0] < b]:
        if s - prev > 800:
            ra = prev + (0 if first else 150)
            rb = max(s - (250 if first else 100), ra)
            if rb - ra > 50:
                cuts.append((ra, min(rb, b)))
        prev, first = max(prev, e), False
    if b - prev > 800 and b - prev - 250 > 50:
        cuts.append((prev + 250, b))
    keeps, cur = [], a
    for x, y in cuts:
        if x - cur >= 400:
            keeps.append((cur, x))
        cur = max(cur, y)
    if b - cur >= 400:
        keeps.append((cur, b))
    tight = sum(y - x for x, y in keeps)
    return keeps if keeps and tight >= 4000 and tight * 10 >= (b - a) * 4 else [(a, b)]


def test_exact_fit_matches_a_plain_loop(spark, make_words):
    r = random.Random(11)
    text = " ".join(["go"] * 260)
    words = make_words(text, {i: r.choice([900, 2500, 7000]) for i in range(3, 260, 9)})
    ws = [(x["s_ms"], x["e_ms"]) for x in words.orderBy("pos").collect()]
    dur, target = ws[-1][1], 30_000
    clips = [(i + 1, ws[p][0], ws[p + 12][1]) for i, p in enumerate(range(0, 240, 30))]
    df = spark.createDataFrame([("v", *c) for c in clips], "video_id string, rank long, a_ms long, b_ms long")
    keeps, _ = I.exact_fit(df, words, durations(words), target)
    got = {}
    for x in keeps.orderBy("rank", "k").collect():
        got.setdefault(x["rank"], []).append((x["a_ms"], x["b_ms"]))
    for rank, a, b in clips:
        plan, n = plan_of(a, b, ws), 0
        while sum(y - x for x, y in plan) < target and b < dur and n < 40:
            n += 1
            t = min(b + 5000, dur)
            b = min([e for _, e in ws if e >= t] + [dur])
            plan = plan_of(a, b, ws)
        acc, want = 0, []
        for x, y in plan:
            if acc + y - x <= target:
                want.append((x, y))
                acc += y - x
                continue
            cut = x + target - acc
            cut = next((max(s, x) for s, e in ws if s < cut < e), cut)
            if cut > x + 20:
                want.append((x, cut))
            break
        assert got[rank] == want
