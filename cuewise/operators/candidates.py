"""Candidate clips: sentence picks, complete thoughts, seeded moments, timecuts, topic bumps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuewise.functions.score import bump, score_signs, scorecard, word_set
from cuewise.functions.text import has_digit, mentions_any, words_in_order
from cuewise.operators import segment
from cuewise.operators.scan import WORDS_PER_CHUNK, chunk_in, chunk_of, points_in_ranges
from cuewise.sources.staging import cut

TARGET_MAX_MS = 45_000
HEURISTIC_WHY = "Offline heuristic pick (no LLM key set)."
COMPLETE_WHY = "Complete thought, sentence-snapped boundaries."
COLUMNS = ("video_id cand start_ms end_ms hook why scores title hashtags style source").split()


def candidate_rows(df: DataFrame, source: str, scores: Column | None = None) -> DataFrame:
    """Complete a picker's rows to the candidate schema."""
    card = "struct<hook:int,retention:int,value:int,share:int>"
    return df.select(
        "video_id", F.col("cand").cast("long").alias("cand"), "start_ms", "end_ms",
        F.substring("hook", 1, 200).alias("hook"), "why",
        (F.lit(None) if scores is None else scores).cast(card).alias("scores"),
        F.lit(None).cast("string").alias("title"),
        F.lit(None).cast("array<string>").alias("hashtags"),
        F.lit("karaoke").alias("style"), F.lit(source).alias("source"),
    )


def range_text(
    words: DataFrame, ranges: DataFrame, key: list[str], lo: Column, hi: Column,
    max_words: int | None = None, ends_by: Column | None = None, trim: bool = False,
) -> DataFrame:
    """Text of the words of each range: start in ``[lo, hi]`` and, with ``ends_by``, end at or
    before it. Adds ``text`` and ``n_words``; ranges without words are absent."""
    span = ranges.select(*key, lo.alias("__a"), hi.alias("__b"),
                         (hi if ends_by is None else ends_by).alias("__e"))
    w = words.select("video_id", "pos", "s_ms", "e_ms", (F.trim("w") if trim else F.col("w")).alias("w"),
                     *(["chunk"] if "chunk" in words.columns else []))
    hit = points_in_ranges(w, span, ["video_id"], "s_ms", F.col("__a"), F.col("__b"))
    if ends_by is not None:
        hit = hit.filter("e_ms <= __e")
    # Joined first inside each chunk, where stored words lie together; of these only the first words are ever needed.
    said = F.transform(F.array_sort(F.collect_list(F.struct("pos", "w"))), lambda x: x["w"])
    said = F.slice(said, 1, max_words) if max_words else said
    parts = hit.groupBy("video_id", chunk_in(words).alias("__chunk"), *[k for k in key if k != "video_id"]).agg(said.alias("__p"))
    if not max_words:
        parts = parts.withColumns({"__n": F.size("__p"), "__p": F.array_join("__p", " ")})
        return parts.groupBy(*key).agg(words_in_order("__chunk", "__p").alias("text"), F.sum("__n").cast("int").alias("n_words"))
    whole = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("__chunk", "__p"))), lambda x: x["__p"]))
    whole = parts.groupBy(*key).agg(F.slice(whole, 1, max_words).alias("__p"))
    return whole.select(*key, F.array_join("__p", " ").alias("text"), F.size("__p").alias("n_words"))


def _words_at(words: DataFrame, spots: DataFrame) -> DataFrame:
    """Spots ``(video_id, pos, ...)`` with the times of their words. A chunk's few spots are brought to its words."""
    rest = [c for c in spots.columns if c not in ("video_id", "pos")]
    asked = spots.groupBy("video_id", chunk_of("pos", WORDS_PER_CHUNK).alias("__chunk")).agg(
        F.array_distinct(F.collect_list("pos")).alias("__at"))
    w = words.select("video_id", "pos", "s_ms", "e_ms", chunk_in(words).alias("__chunk"))
    found = w.join(asked, ["video_id", "__chunk"]).filter(F.array_contains("__at", F.col("pos"))).drop("__chunk", "__at")
    return spots.select("video_id", "pos", *rest).join(found, ["video_id", "pos"])


def propose(words: DataFrame, count: int, focus: list[str] = ()) -> DataFrame:
    """Best sentences, each grown by words on both sides to three times its length."""
    scored = segment.scored_sentences(words, focus)
    top = segment.top_sentences(scored, count).select(
        "video_id", (F.col("rn") - 1).alias("cand"), F.col("sent_start").alias("a"),
        (F.col("sent_start") + F.col("n_words")).alias("b"), "n_words", "score", "text",
    )
    sizes = words.groupBy("video_id").agg(F.count("*").alias("n"))
    want = F.greatest(F.least(F.col("n_words") * 3, F.lit(60)), F.lit(8))
    grown = top.join(sizes, "video_id").withColumn("d", want - F.col("n_words"))
    grown = grown.withColumn("h", F.expr("d div 2")).withColumn("r", F.col("n") - F.col("b"))
    roomy = F.col("r") >= F.col("h")
    left = F.when(roomy, F.least("a", F.col("d") - F.col("h"))).otherwise(
        F.least("a", F.col("r") + 1))
    right = F.when(roomy, F.least("r", F.greatest("h", F.col("d") - F.col("a")))).otherwise(
        F.col("r"))
    # A few rows per video, needed twice.
    grown = cut(grown.select("video_id", "cand", "score", "text", (F.col("a") - left).alias("first"),
                             (F.col("b") + right).alias("stop")))
    spots = grown.select(
        "*", F.explode(F.array(F.col("first"), F.col("stop") - 1, F.col("stop"))).alias("pos"))
    at = _words_at(words, spots)

    def value(c: str, pos: Column) -> Column:
        return F.max(F.when(F.col("pos") == pos, F.col(c)))

    out = at.groupBy("video_id", "cand").agg(
        value("s_ms", F.col("first")).alias("s"),
        value("e_ms", F.col("stop") - 1).alias("e"),
        value("e_ms", F.col("stop")).alias("e_more"),
        F.first("score").alias("score"), F.first("text").alias("hook"),
    )
    short = F.col("e") - F.col("s") < 8000
    end = F.when(short, F.coalesce("e_more", "e")).otherwise(F.col("e"))
    end = F.when(end - F.col("s") > TARGET_MAX_MS + 20_000, F.col("s") + TARGET_MAX_MS).otherwise(end)
    out = out.withColumn("start_ms", F.col("s")).withColumn("end_ms", end)
    return candidate_rows(out.withColumn("why", F.lit(HEURISTIC_WHY)), "heuristic",
                          scorecard("score"))


def propose_complete(words: DataFrame, count: int, focus: list[str] = ()) -> DataFrame:
    """Best sentences grown by whole sentences, forward then backward, to 20-120 s."""
    # What a text adds to a score, so that texts need not be put together for it.
    scored = cut(segment.scored_sentences(words, focus).select(
        "video_id", "sent_start", "s_ms", "e_ms", "text", "score", F.col("text").contains("?").alias("asks"), F.col("text").contains("!").alias("calls"),
        has_digit("text").alias("counts"), F.size(F.filter(F.split("text", r"\s+"), lambda t: t != "")).alias("n")))
    top = segment.top_sentences(scored, count).select(
        "video_id", (F.col("rn") - 1).alias("cand"), F.col("sent_start").alias("i"),
        F.col("s_ms").alias("s_i"), F.col("e_ms").alias("e_i"))
    marks = scored.select("video_id", "sent_start", "s_ms", "e_ms")

    # Forward: the first sentence ending 20 s on, or the last one ending within 120 s.
    ahead = points_in_ranges(marks, top, ["video_id"], "e_ms", F.col("s_i"),
                             F.greatest(F.col("s_i") + 120_000, F.col("e_i")), 60_000)
    fits = (F.col("sent_start") >= F.col("i")) & (
        (F.col("e_ms") <= F.col("s_i") + 120_000) | (F.col("sent_start") == F.col("i")))
    long = fits & (F.col("e_ms") >= F.col("s_i") + 20_000)
    fwd = ahead.groupBy("video_id", "cand", "i", "s_i", "e_i").agg(
        F.min(F.when(long, F.struct("sent_start", "e_ms"))).alias("f"),
        F.max(F.when(fits, F.struct("sent_start", "e_ms"))).alias("m"),
    )
    fwd = fwd.withColumn("b", F.coalesce("f", "m")).select(
        "video_id", "cand", "i", "s_i", F.col("b.sent_start").alias("b"), F.col("b.e_ms").alias("e_b"))

    # Backward, only for those still short.
    short = fwd.filter(F.col("e_b") - F.col("s_i") < 20_000)
    behind = points_in_ranges(marks, short, ["video_id"], "s_ms",
                              F.least(F.col("e_b") - 120_000, F.col("s_i")), F.col("s_i"), 60_000)
    fits = (F.col("sent_start") <= F.col("i")) & (
        (F.col("s_ms") >= F.col("e_b") - 120_000) | (F.col("sent_start") == F.col("i")))
    enough = fits & (F.col("s_ms") <= F.col("e_b") - 20_000)
    back = behind.groupBy("video_id", "cand").agg(
        F.coalesce(F.max(F.when(enough, F.struct("sent_start", "s_ms"))),
                   F.min(F.when(fits, F.struct("sent_start", "s_ms")))).alias("back"))
    span = fwd.join(back, ["video_id", "cand"], "left").select(
        "video_id", "cand",
        F.coalesce("back.s_ms", "s_i").alias("start_ms"), F.col("e_b").alias("end_ms"),
        F.coalesce("back.sent_start", "i").alias("a"), "b",
    ).filter("end_ms - start_ms >= 8000")

    signs = scored.select("video_id", "sent_start", "s_ms", "asks", "calls", "counts", "n")
    inside = points_in_ranges(signs, span, ["video_id"], "s_ms", F.col("start_ms"),
                              F.col("end_ms"), 60_000).filter("sent_start between a and b")
    out = inside.groupBy("video_id", "cand", "start_ms", "end_ms", F.col("a").alias("sent_start")).agg(
        F.bool_or("asks").alias("asks"), F.bool_or("calls").alias("calls"), F.bool_or("counts").alias("counts"), F.sum("n").alias("n"))
    # Only the sentence it opens with is needed as text.
    out = out.join(scored.select("video_id", "sent_start", F.col("text").alias("hook")), ["video_id", "sent_start"])
    out = out.withColumn("why", F.lit(COMPLETE_WHY))
    return candidate_rows(out, "heuristic-complete", scorecard(score_signs("asks", "calls", "counts", "n")))


def _unsigned(x: Column) -> Column:
    wide = x.cast("decimal(20,0)")
    return F.when(x < 0, wide + F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(wide)


def random_stream(seed: Column, n: int) -> Column:
    """``n`` numbers in [0, 1] of a 64-bit xorshift stream (shifts 13, 7, 17)."""
    def step(acc: Column, _: Column) -> Column:
        x = acc["x"]
        x = x.bitwiseXOR(F.shiftleft(x, 13))
        x = x.bitwiseXOR(F.shiftrightunsigned(x, 7))
        x = x.bitwiseXOR(F.shiftleft(x, 17))
        return F.struct(x.alias("x"), F.array_append(acc["out"], x).alias("out"))

    start = F.struct(F.when(seed == 0, F.lit(1)).otherwise(seed).cast("long").alias("x"),
                     F.array().cast("array<bigint>").alias("out"))
    raw = F.aggregate(F.sequence(F.lit(1), F.lit(n)), start, step, lambda a: a["out"])
    top = 2.0 ** 64
    return F.transform(raw, lambda x: _unsigned(x).cast("double") / top)


def propose_moments(words: DataFrame, count: int, seed: int) -> DataFrame:
    """Seeded random windows of 15-45 s; videos of at most 8 s use :func:`propose`."""
    videos = words.groupBy("video_id").agg(F.max("e_ms").alias("dur_ms"))
    long = videos.filter("dur_ms > 8000").withColumn(
        "u", random_stream(F.lit(seed).cast("long"), 2 * count))
    draws = long.select("video_id", (F.col("dur_ms") / 1000).alias("dur"), "u", F.explode(
        F.sequence(F.lit(0), F.lit(count - 1))).alias("cand"))
    length = F.least(15.0 + F.element_at("u", F.col("cand") * 2 + 1) * 30.0, F.col("dur"))
    draws = draws.withColumn("len", length)
    start = F.element_at("u", F.col("cand") * 2 + 2) * F.greatest(F.col("dur") - F.col("len"), F.lit(0.0))
    draws = draws.withColumn("s", start)
    ms = draws.select(
        "video_id", "cand", F.round(F.col("s") * 1000).cast("long").alias("start_ms"),
        F.round(F.least(F.col("s") + F.col("len"), F.col("dur")) * 1000).cast("long").alias("end_ms"))
    said = range_text(words, ms, ["video_id", "cand"], F.col("start_ms"),
                      F.col("start_ms") + 5999, max_words=12)
    number = F.col("cand") + 1
    out = ms.join(said, ["video_id", "cand"], "left").select(
        "video_id", "cand", "start_ms", "end_ms",
        F.coalesce("text", F.concat(F.lit("Random moment "), number)).alias("hook"),
        F.concat(F.lit("Random moment #"), number, F.lit(f" (seed {seed}).")).alias("why"))
    tiny = words.join(videos.filter("dur_ms <= 8000"), "video_id", "left_semi")
    return candidate_rows(out, f"moments:{seed}").unionByName(propose(tiny, count))


def propose_timecut(words: DataFrame, spans: DataFrame, len_ms: int) -> DataFrame:
    """Equal parts of each span, hooked with their first words."""
    parts = segment.timecut(spans, len_ms).withColumn("cand", F.col("part"))
    said = range_text(words, parts, ["video_id", "cand"], F.col("start_ms"),
                      F.col("start_ms") + 7999, max_words=14)
    number = F.col("part") + 1
    secs = F.format_string("%.0f", F.lit(max(len_ms, 5000) / 1000))
    out = parts.join(said, ["video_id", "cand"], "left").select(
        "video_id", "cand", "start_ms", "end_ms",
        F.coalesce("text", F.concat(F.lit("Part "), number)).alias("hook"),
        F.concat(F.lit("Uniform timecut part "), number, F.lit("/"), F.col("n_parts"),
                 F.lit(" ("), secs, F.lit("s).")).alias("why"))
    return candidate_rows(out, "timecut")


def apply_focus(candidates: DataFrame, words: DataFrame, terms: list[str]) -> DataFrame:
    """Raise every score by 15 where the candidate's words mention a topic term."""
    key = ["video_id", "cand"]
    candidates = cut(candidates)
    said = range_text(words, candidates, key, F.col("start_ms") - 50, F.col("end_ms") + 50,
                      ends_by=F.col("end_ms") + 50)
    hits = said.filter(mentions_any("text", terms)).select(*key, F.lit(True).alias("on_topic"))
    out = candidates.join(hits, key, "left").withColumn("on_topic", F.coalesce("on_topic", F.lit(False)))
    return out.withColumn("scores", F.when(F.col("on_topic"), bump("scores")).otherwise(F.col("scores")))


def hook_words(candidates: DataFrame) -> DataFrame:
    return candidates.withColumn("hook_set", word_set("hook"))
