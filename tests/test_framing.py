"""The framing automaton: its rules, chunks against one pass, and the stream."""

import datetime as dt
import glob
import os
import random
import tempfile

import numpy as np
import pytest

from cuewise.functions.geometry import frame_for
from cuewise.operators import framing as R
from cuewise.streaming import live, ordered
from pyspark.sql import functions as F

TALL = frame_for("9:16", 1920.0, 1080.0)
WIDE = frame_for("16:9", 1920.0, 1080.0)


def face(x, score=0.9, motion=0.3, w=200.0, h=240.0, y=300.0):
    return (x, y, w, h, score, motion)


def run(samples, f=WIDE):
    state = R.begin()
    return [R.frame_sample(state, t, np.array(faces, float).reshape(-1, 6), speech, shot, f) for t, faces, speech, shot in samples], state


def test_a_pair_in_conversation_is_framed_after_four_samples_and_left_after_eight():
    pair = [face(500.0), face(1000.0)]
    rows, _ = run([(k / 15, pair, True, False) for k in range(8)] + [((8 + k) / 15, [face(500.0)], True, False) for k in range(12)])
    grouped, framed = [r[9] for r in rows], [r[8] for r in rows]
    assert grouped == [False] * 3 + [True] * 5 + [False] * 12 and framed[3:8] == [2] * 5
    on = [r for r in rows if r[10]]
    assert len(on) == 7  # the group holds without evidence until the eighth miss
    assert [k for k, r in enumerate(rows) if r[11]] == [3, 15]


def test_silence_freezes_the_group_and_quiet_pairs_are_none():
    pair = [face(500.0), face(1000.0)]
    quiet, _ = run([(k / 15, pair, False, False) for k in range(9)])
    assert not any(r[9] for r in quiet)
    still, _ = run([(k / 15, [face(500.0, motion=0.1), face(1000.0, motion=0.1)], True, False) for k in range(9)])
    assert not any(r[9] for r in still)
    # Speech memory: 30 samples after both moved, the pair no longer counts.
    talk = [(k / 15, pair, True, False) for k in range(5)] + [((5 + k) / 15, [face(500.0, motion=0.0), face(1000.0, motion=0.0)], True, False) for k in range(45)]
    rows, _ = run(talk)
    grouped = [k for k, r in enumerate(rows) if r[9]]
    assert grouped == list(range(3, 5 + 29))


def test_incumbents_may_sit_wider():
    wide = [face(200.0), face(1500.0)]  # 1500 of 1920 pixels: over three quarters, under nine tenths
    assert R.crew_of(np.array(wide), [], 1920.0) == [] and R.crew_of(np.array(wide), [np.array(f) for f in wide], 1920.0) == [0, 1]
    twins = np.array([face(500.0), face(540.0), face(1000.0, h=100.0), face(1100.0, score=0.5)])
    assert R.crew_of(twins, [], 1920.0) == []


def test_after_a_shot_the_base_window_settles():
    rows, _ = run([(k / 16, [face(900.0 if k < 5 else 100.0)], True, k == 5) for k in range(14)], TALL)
    weak = [r[10] for r in rows]
    assert weak == [False] * 5 + [True] * 7 + [False] * 2
    assert rows[5][2:6] == TALL.base and rows[5][11] and rows[5][12] and not rows[12][11]


def test_windows_equal_those_of_the_columns(spark):
    from cuewise.functions.geometry import face_window

    rng = random.Random(4)
    rows = [(i, rng.uniform(0, 1700), rng.uniform(0, 800), rng.uniform(60, 400), rng.uniform(60, 500), rng.uniform(0.4, 1)) for i in range(50)]
    df = spark.createDataFrame(rows, "i long, x double, y double, w double, h double, score double")
    got = {r.i: tuple(r.v) for r in df.select("i", face_window(F.struct("x", "y", "w", "h", "score"), TALL).alias("v")).collect()}
    for i, *f in rows:
        assert got[i] == pytest.approx(R.face_window(np.array(f), TALL))


def story(seed, n, shots):
    """Samples of three people who come, go and talk."""
    rng = random.Random(seed)
    here, samples, faces = {0: 300.0, 1: 800.0}, [], []
    for k in range(n):
        for p in (0, 1, 2):
            if rng.random() < 0.02:
                here.pop(p, None) if p in here else here.update({p: rng.uniform(0, 1600)})
        samples.append((7, k, k / 15, rng.random() < 0.8, bool(shots) and k % shots == shots - 1))
        for d, (p, x) in enumerate(sorted(here.items())):
            if rng.random() < 0.93:
                faces.append((7, k, d, x + rng.uniform(-15, 15), 300.0, 200.0 + 20 * p, 240.0 + 30 * p, rng.uniform(0.55, 0.99), rng.choice([0.0, 0.2, 0.5])))
    return samples, faces


def frames(spark, samples, faces):
    s = spark.createDataFrame(samples, "video_id long, frame long, t_s double, speech boolean, shot boolean")
    f = spark.createDataFrame(faces, "video_id long, frame long, det long, x double, y double, w double, h double, score double, motion double")
    return s, f.select("video_id", "frame", "det", F.struct("x", "y", "w", "h", "score").alias("box"), "motion")


def one_pass(samples, faces):
    per = {}
    for _, k, d, *rest in faces:
        per.setdefault(k, []).append((d, rest))
    state, out = R.begin(), []
    for v, k, t, speech, shot in samples:
        own = sorted(per.get(k, []))
        pick, *row = R.frame_sample(state, t, np.array([r for _, r in own], float).reshape(-1, 6), speech, shot, WIDE)
        out.append((v, k, None if pick is None else own[pick][0], *row))
    return out


@pytest.mark.parametrize("shots", [0, 90])
def test_chunks_of_one_video_equal_one_pass(spark, shots):
    samples, faces = story(3 + shots, 400, shots)
    got = R.frame_rows(*reversed(frames(spark, samples, faces)), WIDE, chunk=25)
    assert got.select("video_id", "frame").distinct().count() == 400
    assert [tuple(r) for r in got.orderBy("frame").collect()] == one_pass(samples, faces)


def test_chunks_run_apart(spark):
    """The samples of one video without shots are run by many tasks."""
    samples, faces = story(5, 300, 0)
    got = R.frame_rows(*reversed(frames(spark, samples, faces)), WIDE, chunk=10)
    assert "hashpartitioning(video_id" in got._jdf.queryExecution().toString() and "chunk" in got._jdf.queryExecution().toString()
    assert [tuple(r) for r in got.orderBy("frame").collect()] == one_pass(samples, faces)
    assert R.frame_rows(*reversed(frames(spark, samples[:0], faces[:0])), WIDE).count() == 0


def test_the_stream_gives_the_batch_rows(spark):
    samples, faces = story(8, 120, 50)
    s, f = frames(spark, samples, faces)
    start = dt.datetime(2024, 1, 1)
    joined = R.with_faces(s, f).withColumn("ts", F.timestamp_millis((F.lit(start.timestamp()) * 1000 + F.col("t_s") * 1000).cast("long")))
    rows = joined.collect()
    random.Random(1).shuffle(rows)  # all within the ten minutes of the watermark
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    end = (-1, 0, 0.0, True, False, None, dt.datetime(2100, 1, 1))
    for k, part in enumerate([rows[:30], rows[30:90], rows[90:], [end]]):
        spark.createDataFrame(part, joined.schema).coalesce(1).write.parquet(f"{folder}/part{k}")
        os.makedirs(f"{folder}/in", exist_ok=True)
        for name in glob.glob(f"{folder}/part{k}/*.parquet"):
            os.rename(name, f"{folder}/in/{k}.parquet")
            os.utime(f"{folder}/in/{k}.parquet", (1_700_000_000 + k,) * 2)
    stream = spark.readStream.schema(joined.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    got = live.run_once(ordered.framed_samples(stream, WIDE, "10 minutes"), folder, [], "append").where("video_id >= 0")
    assert [tuple(r) for r in got.orderBy("frame").collect()] == one_pass(samples, faces)


def test_states_of_last_chunks_are_not_computed(spark, monkeypatch):
    from cuewise.operators import framing

    kept, before = [], framing.cut
    monkeypatch.setattr(framing, "cut", lambda df: kept.append(before(df)) or kept[-1])
    samples = spark.range(60).selectExpr("id % 2 AS video_id", "id div 2 AS frame", "(id div 2) / 15D AS t_s", "false AS speech", "false AS shot").where(
        "video_id = 0 or frame < 10")
    faces = samples.selectExpr("video_id", "frame", "1L AS det", "named_struct('x', 100D, 'y', 100D, 'w', 80D, 'h', 90D, 'score', 0.9D) AS box", "0.2D AS motion")
    rows = framing.frame_rows(faces, samples, framing.Frame(1920, 1080, 1080, 1920), chunk=10)
    assert rows.count() == 40
    ended = next(df for df in kept if df.columns == ["video_id", "chunk", "state"])
    # Of chunks 0, 1, 2 of one video and 0 of the other only those with a successor.
    assert sorted((r.video_id, r.chunk) for r in ended.collect()) == [(0, 0), (0, 1)]


def test_faces_of_a_sample_are_plain_numbers(spark):
    """A sample's faces travel as one array of doubles and are stepped over without arrays of two rows."""
    samples, faces = story(6, 40, 0)
    rows = R.with_faces(*frames(spark, samples, faces)).where("faces is not null").collect()
    assert rows
    for r in rows:
        det, boxes = R._faces(r.faces)
        own = sorted((d, tuple(rest)) for _, k, d, *rest in faces if k == r.frame)
        assert det == [d for d, _ in own] and [tuple(b) for b in boxes] == [b for _, b in own]
    state = R.begin()
    R.frame_sample(state, 0.0, [list(face(500.0)), list(face(1000.0))], True, False, WIDE)
    assert R.frozen_state(R.thawed_state(R.frozen_state(state))) == R.frozen_state(state)
    assert type(state["crew"][0]) is list
