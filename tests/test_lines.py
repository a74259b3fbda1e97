"""Packing words into lines against a plain loop, over chunk borders and batches."""

import random

import pytest

from cuewise.operators import lines as L
from pyspark.sql import functions as F

RULES = {"subtitle": L.SUBTITLE, "srt": L.SRT, "readable": L.READABLE, "block": L.BLOCK, "caption": L.caption_rule(4, 24)}


def plain(words, rule):
    """{(video, pos): line} by walking the words."""
    big, out, last = 1 << 60, {}, None
    for v, pos, w, s, e in sorted(words):
        size = len(w.encode()) if rule.bytes_len else len(w)
        gap = last is not None and last[0] == v and rule.gap_ms is not None and s - last[1] > rule.gap_ms
        if last is None or last[0] != v or gap or done or n >= (rule.max_words or big) or width + size > (rule.max_len or big) or \
                e - s0 > (rule.max_ms or big) or s - s0 > (rule.max_start_ms or big):
            line, n, width, s0 = pos, 0, 0, s
        n, width = n + 1, width + size + 1
        ends = w.endswith((".", "?", "!", "…") if rule.ellipsis else (".", "?", "!"))
        done = ends and ((rule.close_words is not None and n >= rule.close_words) or (rule.close_ms is not None and s - s0 > rule.close_ms)
                         or (rule.block_ms is not None and e - s0 >= rule.block_ms)) or e - s0 >= (rule.block_max_ms or big)
        out[v, pos], last = line, (v, e)
    return out


def talk(seed, videos, n, pauses=0.05):
    rng = random.Random(seed)
    out = []
    for v in range(videos):
        t = rng.randrange(1000)
        for pos in range(n if v == 0 else rng.randrange(1, n)):
            w = "".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 12))) + rng.choice(["", "", "", ".", ",", "?", "…"])
            long = rng.randrange(60, 700)
            out.append((v, pos, w, t, t + long))
            t += long + rng.choice([0, 20, 50, -30] if seed % 2 else [0, 20, 50]) + (rng.choice([700, 900, 1500]) if rng.random() < pauses else 0)
    return out


@pytest.mark.parametrize("name", RULES)
@pytest.mark.parametrize("seed", [1, 2])
def test_lines_equal_the_loop(spark, monkeypatch, name, seed):
    monkeypatch.setattr(L, "CHUNK", 64)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        words = talk(seed, 6, 600)
        df = spark.createDataFrame(words, "video_id long, pos long, w string, s_ms long, e_ms long").repartition(3)
        got = {(r.video_id, r.pos): r.line for r in L.pack(df, RULES[name]).collect()}
        assert got == plain(words, RULES[name])
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_talk_without_pauses_is_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(L, "CHUNK", 64)
    words = talk(4, 1, 900, pauses=0.0)
    df = spark.createDataFrame(words, "video_id long, pos long, w string, s_ms long, e_ms long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # which would join so few rows
    try:
        rows = L.pack(df, L.BLOCK).withColumn("p", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len({r.p for r in rows}) > 1 and {(r.video_id, r.pos): r.line for r in rows} == plain(words, L.BLOCK)


def test_times_that_run_back(spark):
    words = [(0, k, "ab.", s, e) for k, (s, e) in enumerate([(0, 9000), (100, 200), (5000, 5100), (5200, 5300), (4000, 4100), (13000, 13100), (400, 500)])]
    df = spark.createDataFrame(words, "video_id long, pos long, w string, s_ms long, e_ms long")
    for rule in RULES.values():
        assert {(r.video_id, r.pos): r.line for r in L.pack(df, rule).collect()} == plain(words, rule)
    assert L.pack(df.limit(0), L.SRT).count() == 0


def test_chapters_of_long_videos_equal_those_of_whole_ones(spark, monkeypatch):
    """The rounds over chunks against the choice on whole videos, with equal pauses."""
    from cuewise.operators import outline as O

    rng = random.Random(3)
    words = []
    for v in range(5):
        t = 400 * v
        for pos in range(700 if v else 1500):
            words.append((v, pos, "word", t, t + 450))
            t += 500 + rng.choice([0, 0, 600, 600, 1500, 1900])
    df = spark.createDataFrame(words, "video_id long, pos long, w string, s_ms long, e_ms long")
    ends = df.groupBy("video_id").agg(F.max("e_ms").alias("duration_ms"))
    whole = sorted(map(tuple, O.chapter_starts(df, ends).collect()))
    monkeypatch.setattr(O, "CHUNK", 1000)
    assert sorted(map(tuple, O.chapter_starts(df, ends).collect())) == whole
    monkeypatch.setattr(O, "CHUNK", 1)
    assert sorted(map(tuple, O.chapter_starts(df, ends).collect())) == whole and len(whole) > 20
