"""Stateful steps over event streams whose rows may come late and out of order.

``Ordered`` holds a key's rows until the watermark has passed their event time and folds them in the order of their ids, so any split into
batches gives the rows of the batch twin. Timers are in event time: one for the next held row, one that clears a key that was silent for
``keep``. Rows behind the watermark are dropped. State is a list of held rows and whatever value and map states a
step declares, in RocksDB; a key's state is small and does not grow with its history.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from cuewise.functions.geometry import Frame
from cuewise.operators import framing

KEEP_MS = 24 * 3_600_000
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _millis(ts) -> int:
    return pd.Timestamp(ts).value // 1_000_000


class Ordered(StatefulProcessor):
    """A fold over a key's rows in the order of ``order``; subclasses declare states and give ``step`` and ``clear``."""

    def __init__(self, rows: StructType, order: str, keep_ms: int = KEEP_MS):
        self.rows, self.order, self.keep_ms = rows, order, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", self.rows)
        self.last = handle.getValueState("last", "ms long")
        self.declare(handle)

    def declare(self, handle: StatefulProcessorHandle) -> None:
        raise NotImplementedError

    def step(self, key: tuple, rows: list[dict]) -> Iterator[tuple]:
        """Fold rows that are in order and yield output rows."""
        raise NotImplementedError

    def clear(self) -> None:
        raise NotImplementedError

    @property
    def output(self) -> list[str]:
        raise NotImplementedError

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed, new = timerValues.getCurrentWatermarkInMs(), []
        names = self.rows.names
        for frame in rows:
            # Arrow hands missing whole numbers over as NaN.
            frame = frame[names].astype(object).where(frame[names].notna(), None)
            new += [tuple(r) for r in frame.itertuples(index=False) if _millis(r.ts) > passed]
        if new:
            whole = {f.name for f in self.rows if f.dataType.typeName() in ("long", "integer")}
            fix = [n in whole for n in names]
            new = [tuple(int(v) if w and v is not None else v.tolist() if hasattr(v, "tolist") else v for v, w in zip(r, fix)) for r in new]
            self.held.appendList(new)
            self.handle.registerTimer(min(_millis(r[names.index("ts")]) for r in new) + 1)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed, names = timerValues.getCurrentWatermarkInMs(), self.rows.names
        held = [dict(zip(names, r)) for r in self.held.get()] if self.held.exists() else []
        due = sorted((r for r in held if _millis(r["ts"]) <= passed), key=lambda r: r[self.order])
        rest = [r for r in held if _millis(r["ts"]) > passed]
        out = list(self.step(key, due)) if due else []
        if due:
            self.last.update((max(_millis(r["ts"]) for r in due),))
            if rest:
                self.held.put([tuple(r[n] for n in names) for r in rest])
                self.handle.registerTimer(min(_millis(r["ts"]) for r in rest) + 1)
            else:
                self.held.clear()
        if not rest and self.last.exists():
            silent = self.last.get()[0] + self.keep_ms
            if silent <= passed:
                self.clear()
                self.last.clear()
            else:
                self.handle.registerTimer(silent)
        return iter([pd.DataFrame(out, columns=self.output)] if out else [])

    def close(self) -> None:
        pass


def run_ordered(rows: DataFrame, key: list[str], columns: list[str], step, schema: str, order: str, late: str, keep_ms: int = KEEP_MS,
                wanted: Column | None = None) -> DataFrame:
    """Apply an ``Ordered`` step class to a stream with event time ``ts``; ``columns`` are what it needs besides the key and ``ts``.
    Only rows that are ``wanted`` reach the steps, but the times of all of them make the watermark."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    kept = rows.select(*key, F.col("ts").cast("timestamp").alias("ts"), *columns).withWatermark("ts", late)
    if wanted is not None:
        # A condition that does not ask for the event time would be pushed below the watermark; rows without a time are dropped in the step.
        kept = kept.filter(wanted | F.col("ts").isNull())
    held = StructType([kept.schema[c] for c in ("ts", *columns)])
    return kept.groupBy(*key).transformWithStateInPandas(step(held, order, keep_ms), schema, "append", "eventTime")


class SettledFiles(Ordered):
    """A path once, when its size is above 0 and held between two polls; files of poll 0 were there before."""

    output = ["path", "poll"]

    def declare(self, handle):
        self.seen = handle.getValueState("seen", "size long, poll long, seen boolean")

    def step(self, key, rows):
        size, poll, seen = self.seen.get() if self.seen.exists() else (-1, -2, False)
        for r in rows:
            if not seen and r["poll"] == 0:
                seen = True
            elif not seen and r["size"] > 0 and r["size"] == size and r["poll"] == poll + 1:
                seen = True
                yield key[0], r["poll"]
            size, poll = r["size"], r["poll"]
        self.seen.update((size, poll, seen))

    def clear(self):
        self.seen.clear()


class ChangedPercents(Ordered):
    """Progress rows whose percent differs from the one before."""

    output = ["job", "rank", "type", "event_id", "pct"]

    def declare(self, handle):
        self.percent = handle.getValueState("percent", "pct long")

    def step(self, key, rows):
        last = self.percent.get()[0] if self.percent.exists() else None
        for r in rows:
            if r["pct"] != last:
                yield *key, r["event_id"], r["pct"]
            last = r["pct"]
        self.percent.update((last,))

    def clear(self):
        self.percent.clear()


STAGES = {"download": "downloading", "provision": "extracting", "audio": "extracting", "transcribe": "transcribing", "pick": "analyzing", "track": "analyzing"}
SOFT_STAGES = ("render", "merge", "kit")
RECORD = "job long, event_id long, what string, status string, was string, rank long, rev long, track_pct long, render_pct long, render_status string, aspect string, file string, gone boolean"


class JobRecords(Ordered):
    """The record of a job: its status, its clips by rank and their variants by aspect.

    Emits a row for whatever changed, with the whole new value of the status, the clip or the variant, or ``gone``: a change log whose newest row of
    (job, what, rank, aspect) is the current one.
    """

    output = [f.split()[0] for f in RECORD.split(", ")]

    def declare(self, handle):
        self.status = handle.getValueState("status", "status string")
        self.clips = handle.getMapState("clips", "rank long", "rev long, track_pct long, render_pct long, render_status string")
        self.variants = handle.getMapState("variants", "rank long, aspect string", "file string")

    def step(self, key, rows):
        was = self.status.get()[0] if self.status.exists() else None
        clips = {k[0]: tuple(v) for k, v in self.clips.iterator()} if self.clips.exists() else {}
        variants = {tuple(k): v[0] for k, v in self.variants.iterator()} if self.variants.exists() else {}
        status, old_clips, old_variants = was or "queued", dict(clips), dict(variants)
        for r in rows:
            kind, rank = r["type"], r["rank"]
            if kind == "stage":
                if r["stage"] in STAGES:
                    status = STAGES[r["stage"]]
                elif r["stage"] in SOFT_STAGES and status != "clips_ready":
                    status = "analyzing"
            elif kind == "clips_picked":
                picked = list(r["ranks"] or [])
                if not r["redo"]:
                    clips = {k: v for k, v in clips.items() if k in picked}
                clips |= {k: (clips[k][0] if k in clips else 0, 0, 0, "pending") for k in picked}
                variants = {k: v for k, v in variants.items() if k[0] in clips and k[0] not in picked}
                status = "clips_ready"
            elif kind == "clip_done":
                clips[rank] = (clips[rank][0] + 1 if rank in clips else 1, 100, 100, "done")
            elif kind == "clip_variant" and rank in clips:
                variants[rank, r["aspect"]] = r["file"]
            elif kind in ("clip_track", "clip_render") and rank in clips:
                rev, track, render, state = clips[rank]
                state = "rendering" if state == "pending" else state
                clips[rank] = (rev, r["pct"], render, state) if kind == "clip_track" else (rev, track, r["pct"], state)
            elif kind in ("job_done", "job_failed"):
                status = "done" if kind == "job_done" else "failed"
        job, at = key[0], rows[-1]["event_id"]
        if status != was:
            self.status.update((status,))
            yield job, at, "job", status, was, None, None, None, None, None, None, None, False
        for k in old_clips.keys() | clips.keys():
            if old_clips.get(k) != clips.get(k):
                if k in clips:
                    self.clips.updateValue((k,), clips[k])
                else:
                    self.clips.removeKey((k,))
                yield (job, at, "clip", None, None, k, *clips.get(k, (None,) * 4), None, None, k not in clips)
        for k in old_variants.keys() | variants.keys():
            if old_variants.get(k) != variants.get(k):
                if k in variants:
                    self.variants.updateValue(k, (variants[k],))
                else:
                    self.variants.removeKey(k)
                yield (job, at, "variant", None, None, k[0], *(None,) * 4, k[1], variants.get(k), k not in variants)

    def clear(self):
        self.status.clear()
        self.clips.clear()
        self.variants.clear()


class FramedSamples(Ordered):
    """A framing row per sample; the state is that of operators.framing, so any split gives the batch rows."""

    output = ["video_id", "frame", *[c.split()[0] for c in framing.ROW.split(", ")]]

    def __init__(self, rows, order, keep_ms, frame: Frame, hz: int):
        super().__init__(rows, order, keep_ms)
        self.frame, self.hz = frame, hz

    def declare(self, handle):
        self.track = handle.getValueState("track", framing.STATE)

    def step(self, key, rows):
        state = framing.thawed_state(self.track.get()) if self.track.exists() else framing.begin()
        for row in framing.run_samples(state, ((r["frame"], r["t_s"], r["faces"], r["speech"], r["shot"]) for r in rows), self.frame, self.hz):
            yield (key[0], *row)
        self.track.update(framing.frozen_state(state))

    def clear(self):
        self.track.clear()


class Tally(StatefulProcessor):
    """A running sum per key; emits the sum after each batch that changes it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.total = handle.getValueState("total", "n long")

    def handleInputRows(self, key, rows, timerValues):
        n = self.total.get()[0] if self.total.exists() else 0
        new = n + sum(int(frame["d"].sum()) for frame in rows)
        if new:
            self.total.update((new,))
        else:
            self.total.clear()
        return iter([pd.DataFrame({"status": [key[0]], "n": [new]})] if new != n else [])

    def close(self) -> None:
        pass


def job_records(events: DataFrame, late: str, keep_ms: int = KEEP_MS) -> DataFrame:
    """Change log of job records from (job, event_id, ts, type, stage, ranks, redo, rank, pct, aspect, file)."""
    columns = ["event_id", "type", "stage", "ranks", "redo", "rank", "pct", "aspect", "file"]
    return run_ordered(events, ["job"], columns, JobRecords, RECORD, "event_id", late, keep_ms)


def framed_samples(samples: DataFrame, frame: Frame, late: str, hz: int = 15, keep_ms: int = KEEP_MS) -> DataFrame:
    """Framing rows of a stream of samples ``(video_id, frame, ts, t_s, faces, speech, shot)``, faces as in ``framing.with_faces``."""
    kind = dict(samples.dtypes)["video_id"]
    step = lambda rows, order, keep: FramedSamples(rows, order, keep, frame, hz)
    return run_ordered(samples, ["video_id"], ["frame", "t_s", "faces", "speech", "shot"], step, f"video_id {kind}, frame long, {framing.ROW}", "frame", late, keep_ms)


def status_counts(changes: DataFrame) -> DataFrame:
    """Live number of jobs per status, from the change log of ``job_records`` in the same stream: each change takes one
    job from its old status and adds one to the new."""
    moves = changes.filter("what = 'job'").select(F.explode(F.array(
        F.struct(F.col("was").alias("status"), F.lit(-1).cast("long").alias("d")), F.struct(F.col("status"), F.lit(1).cast("long").alias("d")))).alias("m"))
    return moves.select("m.*").filter("status is not null").groupBy("status").transformWithStateInPandas(Tally(), "status string, n long", "append", "none")


def current_records(log: DataFrame) -> DataFrame:
    """The rows of a change log that hold now."""
    key = ["job", "what", "rank", "aspect"]
    rest = [c for c in log.columns if c not in key]
    now = log.groupBy(*key).agg(F.max_by(F.struct(*rest), "event_id").alias("v")).select(*key, "v.*")
    return now.filter("not gone").drop("gone", "was")


