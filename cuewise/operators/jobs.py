"""Job events and records: current state, suppression of repeats, lists and counts, reload."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuewise.functions.text import col
from cuewise.operators.scan import Scan, running

FINISHED = ["done", "failed", "cancelled"]


def stage_status(stage, current) -> Column:
    """Status a stage puts a job in; render stages keep ``clips_ready``."""
    s, c = col(stage), col(current)
    return (
        F.when(s == "download", "downloading").when(s.isin("provision", "audio"), "extracting")
        .when(s == "transcribe", "transcribing").when(s.isin("pick", "track"), "analyzing")
        .when(s.isin("render", "merge", "kit"), F.when(c == "clips_ready", c).otherwise("analyzing"))
        .otherwise(c)
    )


def changed_percents(events: DataFrame, key: list[str], order: str, chunk: Column) -> DataFrame:
    """Progress rows whose percent differs from the one before."""
    rows = running(events, key, [order], chunk, {"was": Scan("last", F.col("pct"))})
    return rows.filter(F.col("was").isNull() | (F.col("was") != F.col("pct"))).drop("was")


def clip_states(events: DataFrame) -> DataFrame:
    """Current state of every clip ``(job, rank)`` of an event log.

    ``clips_picked`` resets a clip to pending and keeps its revision, progress counts from the last
    reset on and only once the clip exists, ``clip_done`` completes it and adds a revision. Each
    value depends on the latest event of its kind, so the log reduces by key with partial sums.
    """
    e = events.withColumn("picked_at", F.when(F.col("type") == "clips_picked", F.col("event_id")))
    done = F.col("type") == "clip_done"
    born = e.filter(F.col("type").isin("clips_picked", "clip_done")).groupBy("job", "rank").agg(
        F.min("event_id").alias("born"), F.max(F.when(~done, F.col("event_id"))).alias("reset"),
        F.max(F.when(done, F.col("event_id"))).alias("done_at"), F.sum(F.when(done, 1).otherwise(0)).alias("rev"))
    born = born.withColumn("base", F.greatest("reset", "done_at"))
    after = e.join(born, ["job", "rank"]).filter(F.col("type").isin("clip_track", "clip_render") & (F.col("event_id") > F.col("base")))
    pct = lambda kind: F.max(F.when(F.col("type") == kind, F.struct("event_id", "pct")))
    late = after.groupBy("job", "rank").agg(pct("clip_track").alias("t"), pct("clip_render").alias("r"))
    rows = born.join(late, ["job", "rank"], "left")
    complete = F.coalesce(F.col("done_at") == F.col("base"), F.lit(False))
    start = F.when(complete, 100).otherwise(0).cast("long")
    moving = F.col("t").isNotNull() | F.col("r").isNotNull()
    return rows.select(
        "job", "rank", "rev", F.coalesce("t.pct", start).alias("track_pct"), F.coalesce("r.pct", start).alias("render_pct"),
        F.when(complete, "done").when(moving, "rendering").otherwise("pending").alias("render_status"))


def job_states(events: DataFrame) -> DataFrame:
    """Current job status: the last event that sets one decides."""
    sets = events.filter(F.col("type").isin("clips_picked", "job_done", "job_failed"))
    status = F.when(F.col("type") == "clips_picked", "clips_ready").when(F.col("type") == "job_done", "done").otherwise("failed")
    last = sets.groupBy("job").agg(F.max_by(status, "event_id").alias("status"))
    seen = events.groupBy("job").agg(F.min("ts").alias("created"), F.count("*").alias("events"))
    return seen.join(last, "job", "left").select("job", F.coalesce("status", F.lit("queued")).alias("status"), "created", "events")


def job_records(events: DataFrame) -> DataFrame:
    """Records of a whole event log: ``(job, status, rank, rev, track_pct, render_pct, render_status, variants)``, a row per clip, one
    with a null rank for a job without clips; variants is an array of ``(aspect, file)`` by aspect.

    The twin of the streamed fold, without one: a clip is decided by its events since the last pick that left it out, its progress by
    those since its last reset or completion, its variants by those since it last began.
    """
    const = (F.when(F.col("type") == "clips_picked", "clips_ready").when(F.col("type") == "job_done", "done").when(F.col("type") == "job_failed", "failed")
             .when(F.col("type") == "stage", F.when(~F.col("stage").isin("render", "merge", "kit"), stage_status("stage", F.lit(None).cast("string")))))
    soft = (F.col("type") == "stage") & F.col("stage").isin("render", "merge", "kit")
    said = events.groupBy("job").agg(F.max_by(F.when(const.isNotNull(), const), F.when(const.isNotNull(), F.col("event_id"))).alias("c"),
                                     F.max(F.when(const.isNotNull(), F.col("event_id"))).alias("c_at"), F.max(F.when(soft, F.col("event_id"))).alias("s_at"))
    known = F.coalesce("c", F.lit("queued"))
    status = said.select("job", F.when((F.col("s_at") > F.coalesce("c_at", F.lit(-1))) & (known != "clips_ready"), "analyzing").otherwise(known).alias("status"))

    picks = events.filter("type = 'clips_picked'").select("job", "event_id", "ranks", "redo")
    done = events.filter("type = 'clip_done'").select("job", "rank", F.col("event_id").alias("at"))
    picked = picks.select("job", F.explode("ranks").alias("rank"), F.col("event_id").alias("at"))
    clips = picked.select("job", "rank").union(done.select("job", "rank")).distinct()
    left_out = clips.join(picks.filter("not redo"), "job").filter("not array_contains(ranks, rank)").groupBy("job", "rank").agg(F.max("event_id").alias("void"))
    marks = picked.withColumn("pick", F.lit(True)).unionByName(done.withColumn("pick", F.lit(False))).join(left_out, ["job", "rank"], "left")
    live = marks.filter("void is null or at > void").groupBy("job", "rank").agg(
        F.max(F.when(F.col("pick"), F.col("at"))).alias("reset"), F.max(F.when(~F.col("pick"), F.col("at"))).alias("done_at"),
        F.min(F.when(~F.col("pick"), F.col("at"))).alias("first_done"), F.count_if(~F.col("pick")).alias("rev"))
    live = live.withColumn("base", F.greatest("reset", "done_at")).withColumn("since", F.coalesce("reset", "first_done"))

    moves = events.filter(F.col("type").isin("clip_track", "clip_render", "clip_variant")).select("job", "rank", "event_id", "type", "pct", "aspect", "file")
    moves = moves.join(live.select("job", "rank", "base", "since"), ["job", "rank"])
    progress = moves.filter("event_id > base").groupBy("job", "rank").agg(
        *[F.max(F.when(F.col("type") == k, F.struct("event_id", "pct"))).alias(k) for k in ("clip_track", "clip_render")])
    files = moves.filter("type = 'clip_variant' and event_id > since").groupBy("job", "rank", "aspect").agg(F.max_by("file", "event_id").alias("file"))
    files = files.groupBy("job", "rank").agg(F.array_sort(F.collect_list(F.struct("aspect", "file"))).alias("variants"))
    complete = F.coalesce(F.col("done_at") == F.col("base"), F.lit(False))
    start = F.when(complete, 100).otherwise(0).cast("long")
    state = live.join(progress, ["job", "rank"], "left").join(files, ["job", "rank"], "left").select(
        "job", "rank", "rev", F.coalesce("clip_track.pct", start).alias("track_pct"), F.coalesce("clip_render.pct", start).alias("render_pct"),
        F.when(complete, "done").when(F.col("clip_track").isNotNull() | F.col("clip_render").isNotNull(), "rendering").otherwise("pending").alias("render_status"),
        "variants")
    return status.join(state, "job", "left")


def finalize(records: DataFrame) -> DataFrame:
    """Outcome of a finished run ``(status, ok, cancelled, edit)``: done or cancelled; an error fails
    the job, but a failed edit leaves it done."""
    status = (F.when(F.col("ok") & F.col("cancelled"), "cancelled").when(F.col("ok") | F.col("edit"), "done")
              .when(F.col("cancelled"), "cancelled").otherwise("failed"))
    return records.withColumn("status", status)


def failed_edit_clips(clips: DataFrame, edits: DataFrame) -> DataFrame:
    """Clips a failed edit touched ``(job, rank)`` that are not done show as failed."""
    hit = edits.select("job", "rank", F.lit(True).alias("__e"))
    rows = clips.join(hit, ["job", "rank"], "left")
    bad = F.col("__e").isNotNull() & (F.col("render_status") != "done")
    return rows.withColumn("render_status", F.when(bad, "failed").otherwise(F.col("render_status"))).drop("__e")


def status_counts(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("status").agg(F.count("*").alias("n"))


def active(jobs: DataFrame) -> DataFrame:
    return jobs.filter(~F.col("status").isin(FINISHED))


def summaries(jobs: DataFrame, clips: DataFrame) -> DataFrame:
    c = clips.groupBy("job").agg(F.count("*").alias("clips"), F.count_if(F.col("render_status") == "done").alias("clips_rendered"))
    zero = F.lit(0).cast("long")
    return jobs.join(c, "job", "left").select(*jobs.columns, F.coalesce("clips", zero).alias("clips"),
                                              F.coalesce("clips_rendered", zero).alias("clips_rendered"))


def newest(jobs: DataFrame, limit: int = 20, status: str | None = None) -> DataFrame:
    """The newest jobs, of one status or the active ones; ``limit`` is 1 to 500."""
    rows = jobs
    if status == "active":
        rows = active(jobs)
    elif status not in (None, "", "all"):
        rows = jobs.filter(F.col("status") == status)
    return rows.orderBy(F.desc("created"), "job").limit(min(max(limit, 1), 500))


def listing(jobs: DataFrame, limit: int = 20, status: str | None = None) -> DataFrame:
    """The rows of ``newest`` with ``total``, the number of all jobs before the filter."""
    total = jobs.agg(F.count("*").alias("total"))
    return newest(jobs, limit, status).crossJoin(F.broadcast(total))  # one row against at most 500


def reload(records: DataFrame) -> DataFrame:
    """Records after a restart: an unfinished job is done when all its clips are, else failed."""
    all_done = (F.size("clips") > 0) & F.forall("clips", lambda c: c["render_status"] == "done")
    open_ = ~F.col("status").isin(FINISHED)
    lost = open_ & ~all_done
    return records.withColumn("error", F.when(lost, "interrupted by server restart").otherwise(F.col("error"))).withColumn(
        "status", F.when(lost, "failed").when(open_, "done").otherwise(F.col("status")))


def call_log(events: DataFrame, keep: int = 50) -> DataFrame:
    """Newest tool calls from start/end rows ``(seq, at_ms, phase, tool, ok, detail)``."""
    ended = F.col("phase") == "end"
    calls = events.groupBy("seq").agg(
        F.max(F.when(~ended, F.col("at_ms"))).alias("at_ms"), F.max("tool").alias("tool"),
        F.max(F.when(ended, F.col("at_ms"))).alias("__end"), F.bool_and(F.when(ended, F.col("ok"))).alias("__ok"),
        F.max(F.when(ended, F.substring("detail", 1, 160))).alias("detail"))
    state = F.when(F.col("__end").isNull(), "running").when(F.col("__ok"), "ok").otherwise("error")
    ms = F.when(F.col("__end").isNull(), 0).otherwise(F.greatest(F.col("__end") - F.col("at_ms"), F.lit(0)))
    return calls.select("seq", "at_ms", "tool", state.alias("state"), "detail", ms.alias("ms")).orderBy(F.desc("seq")).limit(keep)
