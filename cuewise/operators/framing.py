"""Framing of every sample: who is framed, alone or as a group, in which window, and where the camera jumps.

A sample's row depends on what came before it, so the rules are one automaton with a small typed state. A batch job runs it on
chunks of samples in rounds: every chunk from the state its predecessor ended in when last run, at first from the start. A round runs only
chunks whose start has changed; when none has, all are those of one pass over the whole video. Identities settle within a few samples, so a
second round usually changes nothing. A video without any shot is spread over as many tasks as it has chunks. The same
automaton runs on streams.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuewise.functions.geometry import Frame
from cuewise.operators.presence import FORGET_S, START, measure, speaker_step, steal_hits
from cuewise.sources.staging import cut

CHUNK = 4096
# Fixed values of the framing rules.
SETTLE_S, TALKS, MEMORY, ON_AFTER, OFF_AFTER = 0.4, 0.12, 30, 4, 8
LEAST_SCORE, LEAST_HEIGHT, SAME_HEAD, HEAD_GAP, SPAN, KEPT_SPAN, INCUMBENT, JUMP = 0.6, 0.5, 0.15, 0.6, 0.75, 0.9, 0.25, 0.1

STATE = ("box array<double>, rival array<double>, hits long, seen double, switched double, memory long, grouped boolean, yes long, no long, "
         "shot_at double, window array<double>, anchor array<double>, crew array<array<double>>")
ROW = ("det long, handoff boolean, x double, y double, w double, h double, ax double, ay double, n_faces long, grouped boolean, weak boolean, "
       "cut boolean, hard boolean")
FACE = ("x", "y", "w", "h", "score", "motion")


def begin() -> dict:
    return {**START, "memory": 0, "grouped": False, "yes": 0, "no": 0, "shot_at": -math.inf, "window": None, "anchor": None, "crew": []}


def frozen_state(state: dict) -> tuple:
    """A state as plain values in the order of ``STATE``."""
    plain = lambda v: None if v is None else [float(x) for x in v]
    return (plain(state["box"]), plain(state["rival"]), int(state["hits"]), float(state["seen"]), float(state["switched"]), int(state["memory"]),
            bool(state["grouped"]), int(state["yes"]), int(state["no"]), float(state["shot_at"]), plain(state["window"]), plain(state["anchor"]),
            [plain(m) for m in state["crew"]])


def thawed_state(row) -> dict:
    state = dict(zip([f.split()[0] for f in STATE.split(", ")], row))
    numbers = lambda v: None if v is None else [float(x) for x in v]
    return {**state, "box": numbers(state["box"]), "rival": numbers(state["rival"]), "window": numbers(state["window"]), "anchor": numbers(state["anchor"]),
            "crew": [numbers(m) for m in (state["crew"] if state["crew"] is not None else [])]}


def crew_of(faces: Sequence, before: Sequence, base_w: float) -> list[int]:
    """Faces that share a conversation, as places: the most lively first, confident, of a size, distinct, and together within three
    quarters of the base window; one that was in the crew before may reach nine tenths."""
    if len(faces) < 2:
        return []
    found: list[int] = []
    left, right = math.inf, -math.inf
    least = LEAST_HEIGHT * max(0.0, max(f[3] for f in faces))
    for i in sorted(range(len(faces)), key=lambda i: -(faces[i][4] + faces[i][5])):
        f = faces[i]
        if f[4] < LEAST_SCORE or f[3] < least:
            continue
        x, w = f[0], f[2]
        a, b = min(left, x), max(right, x + w)
        # Nobody may reach beyond nine tenths; the closer looks are for the rest.
        if b - a > KEPT_SPAN * base_w:
            continue
        heads = [measure(f, faces[k]) for k in found]
        if not all(apart > HEAD_GAP * max(faces[k][2], w) and overlap < SAME_HEAD for k, (overlap, apart) in zip(found, heads)):
            continue
        if b - a <= SPAN * base_w or any(measure(f, m)[0] > INCUMBENT for m in before):
            left, right = a, b
            found.append(i)
    return found if len(found) >= 2 else []


def _inside(x: float, size: float, whole: float) -> float:
    return min(max(x, 0.0), max(whole - size, 0.0))


def crew_window(faces: Sequence, f: Frame) -> tuple | None:
    """The base window over a crew, or None where it would cut a member off."""
    _, _, bw, bh = f.base
    first, last = min(m[0] for m in faces), max(m[0] + m[2] for m in faces)
    a, b = first - 0.12 * bw, last + 0.12 * bw
    if b - a > bw:
        return None
    a, b = (0.0, b - a) if a < 0 else (a, b)
    a, b = (a - (b - f.src_w), f.src_w) if b > f.src_w else (a, b)
    w, h = min(bw, f.src_w), min(bh, f.src_h)
    x = _inside((a + b) / 2 - w / 2, w, f.src_w)
    if first < x - 1 or last > x + w + 1:
        return None
    middle = 0.0
    for m in faces:
        middle += m[1] + m[3] / 2
    return x, _inside(middle / len(faces) - h * 0.4, h, f.src_h), w, h


def face_window(face: Sequence, f: Frame) -> tuple:
    """The window of one face, as geometry.face_window."""
    _, _, bw, bh = f.base
    u = min(max((face[4] - 0.5) / 0.3, 0.0), 1.0)
    most = min(1.15 + 0.15 * u * u * (3.0 - 2.0 * u), max(bh / f.min_h, 1.0))
    z = min(max(0.38 / max(face[3] / f.src_h, 0.05), 1.0), most)
    w, h = bw / z, bh / z
    return _inside(face[0] + face[2] / 2 - w / 2, w, f.src_w), _inside(face[1] + face[3] / 2 - h * 0.4, h, f.src_h), w, h


def _group(state: dict, qualifies: bool) -> bool:
    """Step the two-threshold state; whether it turned."""
    state["yes"], state["no"] = (state["yes"] + 1, 0) if qualifies else (0, state["no"] + 1)
    was = state["grouped"]
    state["grouped"] = state["yes"] >= ON_AFTER if not was else state["no"] < OFF_AFTER
    return state["grouped"] != was


def frame_sample(state: dict, t: float, faces: Sequence, speech: bool, shot: bool, f: Frame, hz: int = 15) -> tuple:
    """Move the state by one sample of faces (x, y, w, h, score, motion) and return its row, with the place of the picked face.

    A sample has few faces: plain numbers take a fraction of the time that arrays of two or three rows do.
    """
    if t - state["seen"] > FORGET_S:
        state.update(box=None, rival=None)
    if shot:
        state.update(box=None, rival=None, memory=0, grouped=False, yes=0, no=0, switched=-math.inf, shot_at=t)
    base = f.base
    crew = crew_of(faces, state["crew"], base[2])
    state["crew"] = [faces[i] for i in crew]
    state["memory"] = MEMORY if crew and all(faces[i][5] > TALKS for i in crew) else max(state["memory"] - 1, 0)
    shared = crew_window([faces[i] for i in crew], f) if crew and state["memory"] > 0 else None
    turned = _group(state, shared is not None) if speech else False
    pick, takes, follows = speaker_step(state, t, faces, speech, f.src_w, steal_hits(hz))
    settling, grouped, weak = t - state["shot_at"] < SETTLE_S, False, False
    held = state["window"] if state["window"] is not None else base
    if settling:
        window, weak = base, True
    elif state["grouped"]:
        window, grouped, weak = (shared, True, False) if shared is not None else (held, False, True)
    else:
        window, weak = (face_window(faces[pick], f), False) if pick is not None else (held, True)
    x, y, w, h = (float(v) for v in window)
    if grouped or settling or (pick is None and state["anchor"] is None):
        anchor = (x + w / 2, y + h * 0.4)
    else:
        anchor = (faces[pick][0] + faces[pick][2] / 2, faces[pick][1] + faces[pick][3] / 2) if pick is not None else state["anchor"]
    jumps = not weak and not follows and state["window"] is not None and \
        abs(x + w / 2 - (state["window"][0] + state["window"][2] / 2)) > JUMP * f.src_w
    if not weak:
        state.update(window=(x, y, w, h), anchor=tuple(map(float, anchor)))
    return pick, takes, x, y, w, h, float(anchor[0]), float(anchor[1]), len(crew) if grouped else 1, grouped, weak, bool(shot or turned or jumps), bool(shot)


def _faces(flat) -> tuple[list[int], list[list[float]]]:
    """Numbers and boxes of the faces of a sample, as ``with_faces`` gives them."""
    values = [] if flat is None else flat.tolist() if hasattr(flat, "tolist") else list(flat)
    size = len(FACE) + 1
    return [int(v) for v in values[::size]], [values[k + 1: k + size] for k in range(0, len(values), size)]


def run_samples(state: dict, rows: Iterator[tuple], f: Frame, hz: int) -> Iterator[tuple]:
    """Rows for ordered samples (frame, t_s, faces, speech, shot); the state moves along."""
    for frame, t, faces, speech, shot in rows:
        det, boxes = _faces(faces)
        pick, *rest = frame_sample(state, t, boxes, bool(speech), bool(shot), f, hz)
        yield (frame, None if pick is None else det[pick], *rest)


def with_faces(samples: DataFrame, faces: DataFrame) -> DataFrame:
    """Samples ``(video_id, frame, t_s, speech, shot)`` with the faces ``(video_id, frame, det, box, motion)`` of their frame: ``faces`` holds
    seven numbers of each one after another, by ``det``: det and FACE."""
    box = F.struct("det", *[F.col(f"box.{c}").cast("double").alias(c) for c in FACE[:-1]], F.col("motion").cast("double").alias("motion"))
    flat = F.flatten(F.transform(F.array_sort(F.collect_list(box)), lambda b: F.array(b["det"].cast("double"), *[b[c] for c in FACE])))
    per = faces.groupBy("video_id", "frame").agg(flat.alias("faces"))
    return samples.select("video_id", "frame", "t_s", "speech", "shot").join(per, ["video_id", "frame"], "left")


def frame_rows(faces: DataFrame, samples: DataFrame, f: Frame, hz: int = 15, chunk: int = CHUNK) -> DataFrame:
    """A framing row per sample: the picked face (det) and whether it took over, the window and its anchor, how many faces it frames, whether
    it is a group's, weak (no evidence, the last framing goes on), and whether the camera jumps, and hard at a shot."""
    kind = dict(samples.dtypes)["video_id"]
    rows = cut(with_faces(samples, faces).withColumn("chunk", F.expr(f"frame div {chunk}")))
    order = rows.select("video_id", "chunk").distinct()
    # Chunks follow each other in the order of those that have samples.
    after = cut(order.alias("a").join(order.select("video_id", F.col("chunk").alias("later")), "video_id").where("later > chunk")
                .groupBy("video_id", "chunk").agg(F.min("later").alias("next")))
    names = [c.split()[0] for c in STATE.split(", ")]
    struct = "struct<" + ", ".join(c.replace(" ", ": ", 1) for c in STATE.split(", ")) + ">"

    def start(pdf) -> dict:
        given = pdf["state"].iloc[0]
        return begin() if given is None else thawed_state(tuple(given.values()) if isinstance(given, dict) else tuple(given))

    def samples_of(pdf):
        pdf = pdf.sort_values("frame")
        return zip(*(pdf[c].tolist() for c in ("frame", "t_s", "faces", "speech", "shot")))

    def last_state(pdf: pd.DataFrame) -> pd.DataFrame:
        state = start(pdf)
        for _ in run_samples(state, samples_of(pdf), f, hz):
            pass
        return pd.DataFrame({"video_id": [pdf["video_id"].iloc[0]], "chunk": [pdf["chunk"].iloc[0]],
                             "state": [dict(zip(names, frozen_state(state)))]})

    def rows_of(pdf: pd.DataFrame) -> pd.DataFrame:
        out = list(run_samples(start(pdf), samples_of(pdf), f, hz))
        columns = ["frame", *[c.split()[0] for c in ROW.split(", ")]]
        return pd.DataFrame(out, columns=columns).assign(video_id=pdf["video_id"].iloc[0])[["video_id", *columns]]

    def run(todo: DataFrame) -> DataFrame:
        return cut(todo.groupBy("video_id", "chunk").applyInPandas(lambda p: last_state(p), f"video_id {kind}, chunk long, state {struct}"))

    nothing = F.lit(None).cast(struct)
    # The state at the end of a video's last chunk is nobody's start.
    rows_before = rows.join(after.select("video_id", "chunk"), ["video_id", "chunk"], "left_semi")
    ended = run(rows_before.withColumn("state", nothing))
    given = cut(order.select("video_id", "chunk", nothing.alias("state")))
    while True:
        # What each chunk should start from, now that its predecessor has run again.
        wanted = ended.join(after, ["video_id", "chunk"]).select("video_id", F.col("next").alias("chunk"), F.col("state").alias("wanted"))
        wanted = cut(given.join(wanted, ["video_id", "chunk"], "left"))
        changed = cut(wanted.where(~F.to_json("state").eqNullSafe(F.to_json("wanted"))).select("video_id", "chunk", F.col("wanted").alias("state")))
        if changed.isEmpty():
            break
        again = run(rows_before.join(changed, ["video_id", "chunk"]))
        ended = cut(ended.join(changed.select("video_id", "chunk"), ["video_id", "chunk"], "left_anti").unionByName(again))
        given = cut(wanted.select("video_id", "chunk", F.col("wanted").alias("state")))
    done = rows.join(given, ["video_id", "chunk"])
    return done.groupBy("video_id", "chunk").applyInPandas(lambda p: rows_of(p), f"video_id {kind}, frame long, {ROW}")

