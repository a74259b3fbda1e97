"""Edits: caption fixes, hand-made clips, upserts by rank, transcript agreement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuewise.functions.text import style_or, words_in_order
from cuewise.operators.scan import overlap_join, points_in_ranges


def apply_fixes(words: DataFrame, fixes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fixes ``(video_id, fix, s_ms, w)`` replace the first word starting within 10 ms; an empty text
    deletes it. Of several fixes of a word the last counts. Also returns the unmatched fixes."""
    hit = points_in_ranges(words.select("video_id", "pos", F.col("s_ms").alias("ws")), fixes.select("video_id", "fix", "s_ms", F.trim("w").alias("text")),
                           ["video_id"], "ws", F.col("s_ms") - 10, F.col("s_ms") + 10)
    first = hit.groupBy("video_id", "fix", "text").agg(F.min("pos").alias("pos"))
    last = first.groupBy("video_id", "pos").agg(F.max_by("text", "fix").alias("text"))
    out = words.join(last, ["video_id", "pos"], "left").filter("text is null or text <> ''")
    out = out.withColumn("w", F.coalesce("text", "w")).drop("text")
    return out, fixes.join(first.select("video_id", "fix"), ["video_id", "fix"], "left_anti")


def spec_clips(specs: DataFrame, words: DataFrame, durations: DataFrame, style: str = "tiktok") -> tuple[DataFrame, DataFrame]:
    """Edit specs ``(video_id, rank, start_ms, end_ms, hook, title, why, style, source, score, ...)`` to
    clips; rejects are shorter than 1 s after clamping or hold no speech."""
    a, b = F.greatest("start_ms", F.lit(0)), F.when(F.col("duration_ms") > 0, F.least("end_ms", "duration_ms")).otherwise(F.col("end_ms"))
    rows = specs.join(durations, "video_id", "left").withColumn("duration_ms", F.coalesce("duration_ms", F.lit(0)))
    rows = rows.withColumn("start_ms", a).withColumn("end_ms", b)
    long = rows.filter("end_ms - start_ms >= 1000")
    said = overlap_join(words.select("video_id", "pos", "w", "s_ms", "e_ms"), long.select("video_id", "rank", "start_ms", "end_ms"),
                        ["video_id"], ("s_ms", "e_ms"), ("start_ms", "end_ms"))
    pairs = F.slice(F.array_sort(F.collect_list(F.struct("pos", "w"))), 1, 14)
    text = said.groupBy("video_id", "rank").agg(F.array_join(F.transform(pairs, lambda p: p["w"]), " ").alias("said"))
    rows = rows.join(text, ["video_id", "rank"], "left")
    reason = F.when(F.col("end_ms") - F.col("start_ms") < 1000, "shorter than 1 s").when(F.col("said").isNull(), "no speech")
    rows = rows.withColumn("reason", reason)
    hook = F.when(F.trim("hook") != "", F.col("hook"))
    title = F.when(F.trim("title") != "", F.trim("title"))
    clips = rows.filter("reason is null").select(
        "video_id", "rank", "start_ms", "end_ms", F.coalesce(hook, "said").alias("hook"),
        F.coalesce("why", F.lit("Picked by hand from the transcript.")).alias("why"), F.coalesce("score", F.lit(0.0)).alias("score_total"),
        title.alias("title"), style_or(F.coalesce("style", F.lit(style)), "tiktok").alias("style"), F.coalesce("source", F.lit("custom")).alias("source"))
    return clips, rows.filter("reason is not null").select("video_id", "rank", "reason")


def upsert(existing: DataFrame, fresh: DataFrame, key: list[str]) -> DataFrame:
    """Fresh rows replace existing ones of the same key and are added where there are none."""
    return existing.join(fresh.select(*key), key, "left_anti").unionByName(fresh)


def agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """Share of ``b``'s words found in ``a`` (lower case) per video, and the gap of the last ends."""
    known = a.select("video_id", F.lower("w").alias("l")).distinct().withColumn("hit", F.lit(1))
    other = b.withColumn("l", F.lower("w")).groupBy("video_id", "l").agg(F.count("*").alias("n"), F.max("e_ms").alias("e"))
    per = other.join(known, ["video_id", "l"], "left").groupBy("video_id").agg(
        F.sum(F.col("n") * F.coalesce("hit", F.lit(0))).alias("hits"), F.sum("n").alias("words"), F.max("e").alias("e_b"))
    ends = a.groupBy("video_id").agg(F.max("e_ms").alias("e_a"))
    return per.join(ends, "video_id").select("video_id", "hits", "words", F.abs(F.col("e_a") - F.col("e_b")).alias("end_gap_ms"))


def clip_documents(clips: DataFrame) -> DataFrame:
    """Clips of a video as one sorted array, for a JSON sink (a video has tens of clips)."""
    return clips.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct(
        "rank", *[c for c in clips.columns if c not in ("video_id", "rank")]))).alias("clips"))
