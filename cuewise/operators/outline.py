"""Outline of a talk: summary, chapters on the longest pauses, tidy chapter lists, upload texts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuewise.functions.text import capitalize, ends_line_sentence, joined, words_in_order
from cuewise.functions.timefmt import clock
from cuewise.operators import segment
from cuewise.operators.scan import WORDS_PER_CHUNK, chunk_in, chunk_of
from cuewise.sources.staging import cut

MIN_CHAPTERS, MIN_CHAPTER_S, MIN_VIDEO_MS = 3, 10, 90_000
CHUNK = 1 << 18  # words that one task may hold of a video: five numbers each, 10 MB


def summaries(words: DataFrame) -> DataFrame:
    """Opening words up to a sentence end at 25 or more, at most 60."""
    said = F.array_sort(F.collect_list(F.struct("pos", "w", ((F.col("pos") >= 24) & ends_line_sentence("w")).alias("stop"))))
    head = words.filter("pos < 60").groupBy("video_id").agg(said.alias("p"))
    stop = F.get(F.filter("p", lambda x: x["stop"]), F.lit(0))["pos"]
    kept = F.filter("p", lambda x: F.col("stop").isNull() | (x["pos"] <= F.col("stop")))
    return head.withColumn("stop", stop).select("video_id", joined(kept).alias("summary"))


def _picked(t: np.ndarray, gap: np.ndarray, n: int, spacing: float) -> list[int]:
    """Places of a video's chapter starts: the first word, then the longest pauses kept apart."""
    free = (t > spacing) & (np.abs(t - t[0]) >= spacing)
    free[0] = False
    found = [0]
    while len(found) < n and free.any():
        i = int(np.argmax(np.where(free, gap, -1)))
        found.append(i)
        free &= np.abs(t - t[i]) >= spacing
    return found


def _short_starts(batches):
    """Chapter starts of whole videos of at most a chunk of words, in order; one video is held at a time. A video's first row is its plan (chunk -1);
    places and times of its words are steps from the first of each chunk."""
    names, held, key, plan = ["at", "pos0", "s0", "ps", "ss", "gs"], [], object(), None

    def out():
        at, pos0, s0, ps, ss, gap = (np.concatenate(c).astype(np.int64) for c in zip(*held))
        first = np.maximum.accumulate(np.where(at == 0, np.arange(len(at)), 0))
        pos, t = (start + steps.cumsum() - steps.cumsum()[first] for start, steps in ((pos0, ps), (s0, ss)))
        found = _picked(t, gap, *plan)
        return pd.DataFrame({"video_id": [key] * len(found), "pos": pos[found], "start_ms": np.r_[0, t[found[1:]]].astype(np.int64)})

    for pdf in batches:
        video, chunk = pdf["video_id"].to_numpy(), pdf["chunk"].to_numpy()
        arrays = [pdf[c].to_numpy() for c in names]
        cuts = [0, *(np.flatnonzero(video[1:] != video[:-1]) + 1).tolist(), len(pdf)] if len(pdf) else [0]
        done = []
        for a, b in zip(cuts, cuts[1:]):
            if video[a] != key:
                if held:
                    done.append(out())
                held, key, plan = [], video[a], None
                if chunk[a] < 0:
                    plan, a = (int(pdf["n"].iloc[a]), float(pdf["spacing"].iloc[a])), a + 1
            if plan and a < b:
                held.append([x[a:b] for x in arrays])
        if done:
            yield pd.concat(done)
    if held:
        yield out()


def chapter_starts(words: DataFrame, durations: DataFrame) -> DataFrame:
    """Chapter starts: the first word, then the longest pauses kept apart by the spacing.

    Videos of a chunk of words are picked from as a whole. In longer ones a round picks one pause in all videos: each task finds the
    longest free one among its own words, so no video is gathered; there are ten starts and so nine rounds at most.
    """
    long = durations.filter(F.col("duration_ms") >= MIN_VIDEO_MS)
    # Half away from zero, as for every rounding here.
    n = F.least(F.greatest(F.floor(F.col("duration_ms") / 240_000 + 0.5), F.lit(MIN_CHAPTERS)), F.lit(10)).cast("int")
    plan = long.join(words.groupBy("video_id").agg(F.max("pos").alias("last")), "video_id").select(
        "video_id", "last", n.alias("n"), (F.col("duration_ms") / (n * 2.0)).alias("spacing"))
    pauses = segment.gap_before(words).select("video_id", chunk_in(words).alias("chunk"), "pos", "s_ms", F.coalesce("gap_ms", F.lit(0)).alias("gap_ms"))
    kind = dict(words.dtypes)["video_id"]
    # Moved once, as a row per chunk: steps from word to word, which are mostly alike. A video's plan goes before its chunks.
    packed = pauses.groupBy("video_id", "chunk").agg(F.array_sort(F.collect_list(F.struct("pos", "s_ms", "gap_ms"))).alias("p"))
    step = lambda c: F.transform("p", lambda x, i: (x[c] - F.coalesce(F.get("p", i - 1)[c], x[c])).cast("int"))
    packed = packed.select("video_id", "chunk", F.col("p")[0]["pos"].alias("pos0"), F.col("p")[0]["s_ms"].alias("s0"), step("pos").alias("ps"), step("s_ms").alias("ss"),
                           F.transform("p", lambda x: x["gap_ms"].cast("int")).alias("gs"), F.lit(None).cast("int").alias("n"), F.lit(None).cast("double").alias("spacing"))
    zero, none = F.lit(0).cast("long"), F.array(F.lit(0))
    plans = plan.where(F.col("last") < CHUNK).select(
        "video_id", F.lit(-1).cast("long").alias("chunk"), zero.alias("pos0"), zero.alias("s0"), none.alias("ps"), none.alias("ss"), none.alias("gs"), "n", "spacing")
    rows = packed.unionByName(plans).repartition("video_id").sortWithinPartitions("video_id", "chunk")
    short = rows.select("video_id", "chunk", "pos0", "s0", "n", "spacing", F.posexplode(F.arrays_zip("ps", "ss", "gs")).alias("at", "x")).select(
        "video_id", "chunk", "at", "pos0", "s0", "x.ps", "x.ss", "x.gs", "n", "spacing")
    starts = short.mapInPandas(_short_starts, f"video_id {kind}, pos long, start_ms long")
    if words.where(F.col("pos") >= CHUNK).isEmpty():
        return starts
    rest = cut(pauses.join(plan.where(F.col("last") >= CHUNK), "video_id").select("video_id", "pos", "s_ms", "gap_ms", "n", "spacing"))
    taken = cut(rest.groupBy("video_id").agg(F.array(F.min(F.struct("pos", "s_ms"))).alias("taken")))
    for _ in range(9):
        clear = F.forall("taken", lambda x: F.abs(F.col("s_ms") - x["s_ms"]) >= F.col("spacing")) & (F.col("s_ms") > F.col("spacing"))
        free = rest.join(taken, "video_id").where((F.size("taken") < F.col("n")) & clear)
        best = free.groupBy("video_id").agg(F.max_by(F.struct("pos", "s_ms"), F.struct("gap_ms", -F.col("pos"))).alias("best"))
        taken = cut(taken.join(best, "video_id", "left").select(
            "video_id", F.when(F.col("best").isNull(), F.col("taken")).otherwise(F.array_append("taken", F.col("best"))).alias("taken"), F.col("best").isNotNull().alias("more")))
        if taken.where("more").isEmpty():
            break
        taken = taken.drop("more")
    each = taken.select("video_id", F.posexplode("taken").alias("k", "x"))
    return starts.union(each.select("video_id", "x.pos", F.when(F.col("k") == 0, 0).otherwise(F.col("x.s_ms")).alias("start_ms")))


def titled(starts: DataFrame, words: DataFrame) -> DataFrame:
    """Chapter titles from the six words at each start."""
    spots = starts.withColumn("at", F.explode(F.sequence(F.col("pos"), F.col("pos") + 5)))
    w = words.select("video_id", chunk_in(words).alias("chunk"), F.col("pos").alias("at"), F.regexp_replace("w", r"[,.?!;]+$", "").alias("w"))
    # The few places are brought to the chunks of the words.
    asked = spots.groupBy("video_id", chunk_of("at", WORDS_PER_CHUNK).alias("chunk")).agg(F.collect_set("at").alias("asked"))
    w = w.join(asked, ["video_id", "chunk"]).where(F.array_contains("asked", F.col("at"))).select("video_id", "at", "w")
    rows = spots.join(w, ["video_id", "at"]).groupBy("video_id", "pos", "start_ms").agg(
        words_in_order("at").alias("t"))
    return rows.select("video_id", (F.col("start_ms") / 1000).alias("start_s"), capitalize("t").alias("title"))


def tidy(chapters: DataFrame, durations: DataFrame) -> DataFrame:
    """Chapters sorted, the first at 0, each 10 s or longer, titles trimmed; none under three.

    Equal starts stay in the order of column ``n`` where the input has one.
    """
    tie = F.col("n") if "n" in chapters.columns else F.lit(0)
    finite = ~F.isnan("start_s") & (F.abs("start_s") < float("inf"))
    ok = chapters.filter(F.col("start_s").isNotNull() & finite & (F.trim("title") != ""))
    title = F.substring(F.regexp_replace(F.trim("title"), r"[.:]+$", ""), 1, 80)
    rows = ok.select("video_id", F.floor(F.greatest("start_s", F.lit(0.0))).alias("start"), title.alias("title"), "start_s", tie.cast("long").alias("tie"))
    packed = rows.groupBy("video_id").agg(
        F.array_sort(F.collect_list(F.struct("start_s", "tie", "start", "title"))).alias("all"))
    packed = packed.join(durations, "video_id")

    def step(kept: Column, c: Column) -> Column:
        first = F.size(kept) == 0
        start = F.when(first, F.lit(0).cast("long")).otherwise(c["start"])
        last = F.element_at(kept, -1)["start"]
        close = (c["start"] - last < MIN_CHAPTER_S) | (F.col("duration_ms") - c["start"] * 1000 < MIN_CHAPTER_S * 1000)
        row = F.struct(start.alias("start"), c["title"].alias("title"))
        return F.when(first, F.array(row)).when(close, kept).otherwise(F.array_append(kept, row))

    empty = F.array().cast("array<struct<start:bigint,title:string>>")
    kept = packed.withColumn("kept", F.aggregate("all", empty, step)).filter(F.size("kept") >= MIN_CHAPTERS)
    return kept.select("video_id", F.posexplode("kept").alias("n", "c")).select(
        "video_id", F.col("n").cast("long").alias("n"), "c.start", "c.title")


def chapters(words: DataFrame, durations: DataFrame) -> DataFrame:
    return tidy(titled(chapter_starts(words, durations), words), durations)


def kit_texts(titles: DataFrame, summaries_df: DataFrame, chapters_df: DataFrame) -> DataFrame:
    """Upload text of a full video: title, summary, chapter lines."""
    line = F.concat(clock(F.col("start") * 1000), F.lit(" "), F.col("title"), F.lit("\n"))
    lists = chapters_df.withColumn("line", line).groupBy("video_id").agg(
        words_in_order("n", "line", "").alias("lines"))
    rows = titles.join(summaries_df, "video_id").join(lists, "video_id", "left")
    body = F.concat(F.trim("title"), F.lit("\n\n"), F.trim("summary"), F.lit("\n"))
    return rows.select("video_id", F.concat(
        body, F.coalesce(F.concat(F.lit("\nChapters\n"), F.col("lines")), F.lit(""))).alias("text"))
