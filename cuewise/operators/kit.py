"""Upload kit of a clip: title, hashtags, headline, body."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuewise.functions import fixed_values as V
from cuewise.functions.text import bare, capitalize, clean, col, ends_sentence, is_keyword, words_in_order
from cuewise.operators.scan import WORDS_PER_CHUNK, points_in_ranges

CLIP = ["video_id", "rank"]
HEADLINE_CHARS = 48


def _started(clips: DataFrame, words: DataFrame) -> DataFrame:
    """Words that start in each clip, with its small margins; stored words stay in their chunks."""
    span = clips.select(*CLIP, "start_ms", "end_ms")
    w = words.select("video_id", "pos", "w", "s_ms", "e_ms", *(["chunk"] if "chunk" in words.columns else []))
    return points_in_ranges(w, span, ["video_id"], "s_ms", F.col("start_ms") - 50, F.col("end_ms") + 350)


def clip_words(clips: DataFrame, words: DataFrame) -> DataFrame:
    """Words of each clip, with its small margins."""
    return _started(clips, words).filter("e_ms <= end_ms + 350")


def _up_to_stop(said: DataFrame, key: list[str]) -> DataFrame:
    """The first words of each group, up to a sentence end or the one that fills a title."""
    w = Window.partitionBy(*key).orderBy("pos")
    length = F.sum(F.octet_length("w") + 1).over(w) - 1
    said = said.withColumn("stop", (ends_sentence("w") | (length >= 70)).cast("int"))
    earlier = F.coalesce(F.sum("stop").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return said.withColumn("earlier", earlier).filter("earlier = 0").drop("stop", "earlier")


def _tag_counts(clips: DataFrame, words: DataFrame) -> DataFrame:
    """How often each clip says a content word twice or more ``(video_id, rank, c, n)``; at most its 16 leading ones are certain to be there."""
    bare = clean("w")
    content = (F.col("e_ms") <= F.col("end_ms") + 350) & (F.octet_length(bare) >= 5) & ~bare.isin(V.TAG_STOP)
    said = _started(clips, words).withColumn("c", F.when(content, bare))
    if "chunk" in words.columns:
        # Counted in the chunk. A clip that holds neither the first nor the last place of it lies in it whole: of this one the leading words are
        # enough; of the others every count goes on.
        place = F.expr(f"pos - chunk * {WORDS_PER_CHUNK}")
        edge = ((place == 0) & (F.col("chunk") > 0)) | (place == WORDS_PER_CHUNK - 1)
        counts = said.groupBy(*CLIP, "chunk", "c").agg(F.count("*").alias("n"), F.bool_or(edge).alias("edge"))
        pair = F.when(F.col("c").isNotNull(), F.struct((-F.col("n")).alias("less"), "c"))
        per = counts.groupBy(*CLIP, "chunk").agg(F.collect_list(pair).alias("all"), F.bool_or("edge").alias("edge"))
        first = F.slice(F.array_sort(F.filter("all", lambda x: x["less"] <= -2)), 1, 16)
        rows = per.select(*CLIP, F.explode(F.when(F.col("edge"), F.col("all")).otherwise(first)).alias("x"))
        found = rows.groupBy(*CLIP, F.col("x.c").alias("c")).agg(F.sum(-F.col("x.less")).alias("n"))
    else:
        found = said.filter("c is not null").groupBy(*CLIP, "c").agg(F.count("*").alias("n"))
    return found.filter("n >= 2")


def clamp_title(c, limit: int = 70) -> Column:
    """End punctuation off; a long title is cut at its last space within ``limit`` bytes."""
    t = F.trim(F.regexp_replace(F.trim(col(c)), r"[.!?…,]+$", ""))
    ws = F.split(t, " ")
    fits = F.filter(F.sequence(F.lit(1), F.size(ws)),
                    lambda i: F.octet_length(F.array_join(F.slice(ws, F.lit(1), i), " ")) < limit)
    cut = F.when(F.size(fits) > 0, F.array_join(F.slice(ws, F.lit(1), F.array_max(fits)), " "))
    return F.when(F.octet_length(t) <= limit, t).otherwise(F.coalesce(cut, F.substring(t, 1, limit)))


def titles(clips: DataFrame, words: DataFrame) -> DataFrame:
    """Picker title, else the first sentence, else the hook."""
    said = clip_words(clips, words)
    if "chunk" in words.columns:
        # What follows a stop inside a chunk follows one in the clip; only the words before it move.
        said = _up_to_stop(said, [*CLIP, "chunk"])
    first = _up_to_stop(said.select(*CLIP, "pos", "w"), CLIP).groupBy(*CLIP).agg(words_in_order().alias("sent"))
    given = F.regexp_replace(F.trim("title"), r'^["\s]+|["\s]+$', "")
    rows = clips.join(first, CLIP, "left")
    text = F.when(F.coalesce("sent", F.lit("")) == "", F.col("hook")).otherwise(F.col("sent"))
    return rows.select(*CLIP, F.when(F.coalesce(given, F.lit("")) != "", F.substring(given, 1, 100))
                       .otherwise(clamp_title(text)).alias("title"))


def clip_hashtags(clips: DataFrame, words: DataFrame) -> DataFrame:
    """Picker tags first, then the clip's frequent content words; at most eight."""
    freq = _tag_counts(clips, words)
    top = Window.partitionBy(*CLIP).orderBy(F.desc("n"), "c")
    # Eight picker tags at most can repeat a word, so sixteen words always suffice.
    freq = freq.withColumn("r", F.row_number().over(top)).filter("r <= 16")
    said = freq.groupBy(*CLIP).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("r", "c"))), lambda x: F.concat(F.lit("#"), x["c"])).alias("said"))
    own = F.transform(F.coalesce("hashtags", F.array().cast("array<string>")),
                      lambda h: F.lower(F.ltrim(F.trim(h), F.lit("#"))))
    own = F.filter(own, lambda h: (F.octet_length(h) > 1) & h.rlike(r"^[\p{L}\p{N}_]+$"))
    own = F.array_distinct(F.transform(own, lambda h: F.concat(F.lit("#"), h)))
    rows = clips.join(said, CLIP, "left").withColumn("own", own)
    room = F.greatest(F.lit(8) - F.size("own"), F.lit(0))
    extra = F.slice(F.array_except(F.coalesce("said", F.array().cast("array<string>")), "own"), F.lit(1), room)
    return rows.select(*CLIP, F.concat("own", extra).alias("tags"))


def bodies(clips: DataFrame, words: DataFrame) -> DataFrame:
    """Copy-paste body: title, hook and why (picker notes left out), hashtags."""
    rows = clips.join(titles(clips.withColumn("title", F.col("title")), words).withColumnRenamed("title", "t"), CLIP)
    rows = rows.join(clip_hashtags(clips, words), CLIP)
    why = F.trim("why")
    note = why.startswith("Offline heuristic") | why.contains("Judged by ")
    shown = F.when(note | (why == ""), None).otherwise(why)
    hook = F.trim("hook")
    desc = F.concat_ws(" ", F.when(hook != "", hook), shown)
    tags = F.array_join("tags", " ")
    return rows.select(*CLIP, F.concat(F.col("t"), F.lit("\n\n"), desc, F.lit("\n"), F.when(
        tags == "", "").otherwise(F.concat(F.lit("\n"), tags, F.lit("\n")))).alias("body"))


def with_headline_candidate(df: DataFrame, sentence: str, at_s: Column) -> DataFrame:
    """Add ``headline`` and ``headline_score`` where the sentence stands on its own, else NULL."""
    rows = df.withColumn("__w", F.filter(F.split(sentence, r"\s+"), lambda t: t != ""))
    # Drop filler openers, and openers with a comma while more than three words stay.
    solid = F.filter(
        F.transform("__w", lambda w, i: F.when(
            clean(w).isin(V.FILLER_OPEN) | (w.endswith(",") & (F.size("__w") - i > 3)), F.lit(-1)).otherwise(i)),
        lambda i: i >= 0)
    rows = rows.withColumn("__from", F.get(solid, F.lit(0)))
    rows = rows.withColumn("__ws", F.when(F.col("__from").isNotNull(), F.slice(
        "__w", F.col("__from") + 1, F.greatest(F.size("__w"), F.lit(1)))))
    rows = rows.withColumn("__c", F.transform("__ws", clean)).withColumn("__t", F.array_join("__ws", " "))
    first, last, n = F.get("__c", F.lit(0)), F.element_at("__c", -1), F.size("__ws")
    question = F.col("__t").endswith("?")
    closed = F.element_at("__w", -1).rlike("[.!?]$")
    ok = (
        closed & n.between(4, 9) & (F.char_length("__t") <= HEADLINE_CHARS)
        & ~first.isin(V.DANGLING_OPEN) & ~last.isin(V.DANGLING_TAIL)
        & ~F.exists("__c", lambda c: c.isin(V.HEADLINE_FILLERS))
        & ~F.exists("__ws", lambda w: w.contains("--") | w.contains("—"))
        & (~question | (first.isin(V.QUESTION_OPEN) & ~last.isin(V.TAG_TAIL)))
    )
    keys = F.size(F.filter("__ws", lambda w, i: (i > 0) & is_keyword(w, F.lit(False))))
    score = (
        F.when(question, 2.0).otherwise(0.0) + F.when(F.col("__t").endswith("!"), 1.0).otherwise(0.0)
        + F.least(keys, F.lit(2)) - 0.2 * F.abs(n - 6) - 0.04 * at_s
    )
    ok = F.when(F.size("__w") > 0, F.coalesce(ok, F.lit(False))).otherwise(False)
    return rows.select(*df.columns, F.when(ok, F.col("__t")).alias("headline"),
                       F.when(ok, score).alias("headline_score"))


def with_headline_text(df: DataFrame, raw: str, name: str, limit: int = HEADLINE_CHARS) -> DataFrame:
    """Clean headline of at most ``limit`` characters, cut at a clause break or before a dangling tail."""
    plain = F.regexp_replace(raw, r'[{}\\*"“”]', "")
    rows = df.withColumn("__w", F.filter(F.split(plain, r"\s+"), lambda t: t != ""))
    upto = lambda i: F.char_length(F.array_join(F.slice("__w", F.lit(1), i), " "))
    sizes = F.sequence(F.lit(1), F.greatest(F.size("__w"), F.lit(1)))
    rows = rows.withColumn("__n", F.coalesce(F.array_max(F.filter(sizes, lambda i: upto(i) <= limit)), F.lit(0)))
    rows = rows.withColumn("__n", F.least("__n", F.size("__w")))
    cuts = F.filter(F.sequence(F.lit(1), F.greatest("__n", F.lit(1))), lambda i: (i >= 3) & (i <= F.col("__n")) & (
        F.get("__w", i - 1).rlike("[,;:.!?—]$")))
    # Without a clause break the dangling tail goes, down to two words.
    firm = F.filter(F.sequence(F.lit(1), F.greatest("__n", F.lit(1))), lambda i: (i <= F.col("__n")) & (
        (i <= 2) | ~bare(F.get("__w", i - 1)).isin(V.DANGLING)))
    keep = F.when(F.col("__n") == F.size("__w"), F.col("__n")).otherwise(
        F.coalesce(F.array_max(cuts), F.array_max(firm), F.col("__n")))
    text = F.when(keep > 0, F.array_join(F.slice("__w", F.lit(1), keep), " ")).otherwise("")
    text = F.trim(F.regexp_replace(text, "[,;:.—…-]+$", ""))
    return rows.withColumn("__k", text).select(*df.columns, capitalize("__k").alias(name))


def accent_word(c) -> Column:
    """Index of the headline word to accent: a keyword after the first, else the longest word."""
    ws = F.split(col(c), " ")
    marked = F.filter(F.transform(ws, lambda w, i: F.when(
        (i > 0) & is_keyword(w, F.lit(False)) & ~bare(w).startswith("i'") & (bare(w) != "i"), i).otherwise(-1)),
        lambda i: i >= 0)
    longest = F.array_min(F.filter(F.transform(ws, lambda w, i: F.struct(
        F.when((F.char_length(bare(w)) >= 5) & ~bare(w).isin(V.DANGLING), -F.char_length(w)).otherwise(0).alias("l"),
        i.alias("i"))), lambda x: x["l"] < 0))
    return F.coalesce(F.get(marked, F.lit(0)), longest["i"])


def spoken_sentences(retimed: DataFrame) -> DataFrame:
    """Whole sentences ``(video_id, rank, n, at_s, text)`` of each clip's retimed words ``(video_id, rank, pos, w, s_ms, e_ms)``; ``n`` is the
    first word's place. They end only at end marks, however long they are; words after a clip's last mark make none."""
    w = Window.partitionBy(*CLIP).orderBy("pos")
    ends = ends_sentence("w").cast("int")
    rows = retimed.select(*CLIP, "pos", F.trim("w").alias("w"), "s_ms", ends.alias("ends"))
    rows = rows.withColumn("part", F.coalesce(F.sum("ends").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    whole = rows.groupBy(*CLIP, "part").agg(
        F.min("pos").alias("n"), (F.min_by("s_ms", "pos") / 1000).alias("at_s"), words_in_order().alias("text"), F.max("ends").alias("ends"))
    return whole.filter("ends = 1").select(*CLIP, "n", "at_s", "text")


def headlines(hooks: DataFrame, sentences: DataFrame) -> DataFrame:
    """Headline per clip: its hook when that stands alone, else the best early sentence (the
    earlier on ties). ``sentences(video_id, rank, n, at_s, text)`` on the clip's clock."""
    own = with_headline_candidate(hooks, "hook", F.lit(0.0)).select(*CLIP, F.col("headline").alias("own"))
    cand = with_headline_candidate(sentences.filter("at_s <= 25"), "text", F.col("at_s"))
    best = cand.filter("headline is not null").groupBy(*CLIP).agg(
        F.max_by("headline", F.struct("headline_score", -F.col("n"))).alias("best"))
    rows = own.join(best, CLIP, "left").withColumn("pick", F.coalesce("own", "best")).filter("pick is not null")
    return with_headline_text(rows, "pick", "headline").select(*CLIP, "headline").filter("headline <> ''")
