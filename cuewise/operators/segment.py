"""Words to sentences, islands and buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuewise.functions.score import score_sentence
from cuewise.functions.text import ends_sentence, mentions_any, words_in_order
from cuewise.operators.scan import WORDS_PER_CHUNK, Scan, chunk_in, running

SENTENCE_WORDS = 30
KEY = ["video_id"]


def scan_words(words: DataFrame, **scans: Scan) -> DataFrame:
    """Running values along each video's words."""
    return running(words, KEY, ["pos"], chunk_in(words), scans)


def with_sentence(words: DataFrame) -> DataFrame:
    """Add ``sent_start``, the position of the sentence's first word (its id and order).

    A sentence ends at its punctuation or after 30 words.
    """
    after_end = F.when(ends_sentence("w"), F.col("pos") + 1)
    out = scan_words(words, __isl=Scan("max", after_end))
    isl = F.coalesce("__isl", F.lit(0))
    step = F.floor((F.col("pos") - isl) / SENTENCE_WORDS) * SENTENCE_WORDS
    return out.withColumn("sent_start", isl + step).drop("__isl")


def sentences(words: DataFrame) -> DataFrame:
    """One row per sentence: text in order, span, word count.

    A sentence is first joined inside each chunk of its video, where the words lie together.
    """
    parts = with_sentence(words).withColumn("__chunk", chunk_in(words)).groupBy("video_id", "__chunk", "sent_start").agg(
        F.count("*").alias("n_words"), F.min("s_ms").alias("s_ms"), F.max("e_ms").alias("e_ms"), words_in_order().alias("text"))
    if "chunk" in words.columns:
        # Stored words have every position and a sentence 30 words at most: one sentence a chunk, if any, goes on in the next, and only its
        # later words move.
        home = F.expr(f"sent_start div {WORDS_PER_CHUNK}")
        rest = parts.where(home < F.col("__chunk")).select(
            "video_id", home.alias("__chunk"), F.col("sent_start").alias("__of"), F.col("n_words").alias("__n"), F.col("e_ms").alias("__e"), F.col("text").alias("__more"))
        whole = parts.where(home == F.col("__chunk")).join(rest, ["video_id", "__chunk"], "left")
        its = F.coalesce(F.col("__of") == F.col("sent_start"), F.lit(False))
        return whole.select(
            "video_id", "sent_start", (F.col("n_words") + F.when(its, F.col("__n")).otherwise(0)).alias("n_words"), "s_ms",
            F.greatest("e_ms", F.when(its, F.col("__e"))).alias("e_ms"), F.concat_ws(" ", "text", F.when(its, F.col("__more"))).alias("text"))
    return parts.groupBy("video_id", "sent_start").agg(
        F.sum("n_words").alias("n_words"),
        F.min("s_ms").alias("s_ms"),
        F.max("e_ms").alias("e_ms"),
        words_in_order("__chunk", "text").alias("text"),
    )


def scored_sentences(words: DataFrame, focus: list[str] = ()) -> DataFrame:
    bonus = F.when(mentions_any("text", list(focus)), 25).otherwise(0)
    return sentences(words).withColumn(
        "score", (score_sentence("text", "n_words") + bonus).cast("long")
    )


def islands(words: DataFrame, breaks: Column, name: str) -> DataFrame:
    """Number runs by the position where ``breaks`` (true on a run's first word) last held."""
    out = scan_words(words, __at=Scan("max", F.when(breaks, F.col("pos")), inclusive=True))
    return out.withColumn(name, F.coalesce("__at", F.lit(0))).drop("__at")


def gap_before(words: DataFrame) -> DataFrame:
    """Add the previous word's end and the gap to it (NULL on the first word)."""
    out = scan_words(words, prev_e=Scan("last", F.col("e_ms")))
    return out.withColumn("gap_ms", F.col("s_ms") - F.col("prev_e"))


def gap_to_running_end(words: DataFrame) -> DataFrame:
    """Gap to the latest end so far (words may overlap); the first word counts from 0."""
    out = scan_words(words, max_e=Scan("max", F.col("e_ms")))
    return out.withColumn("gap_ms", F.col("s_ms") - F.coalesce("max_e", F.lit(0)))


def onsets(words: DataFrame, beat_ms: int = 250) -> DataFrame:
    """Word starts after a beat of silence."""
    out = scan_words(words, max_e=Scan("max", F.col("e_ms")))
    quiet = F.col("max_e").isNull() | (F.col("s_ms") - F.col("max_e") >= beat_ms)
    return out.filter(quiet).select("video_id", "pos", "s_ms")


def attach_punctuation(words: DataFrame, dealt: bool = False) -> DataFrame:
    """Punctuation-only tokens join the word before; a leading one stays a word. ``dealt`` keeps the ``chunk`` of stored words."""
    punct = (F.col("w") != "") & ~F.col("w").rlike(r"[\p{L}\p{N}]")
    led = islands(words, ~punct | (F.col("pos") == 0), "head")
    if "chunk" in words.columns:
        # Stored words have every position, so a word's tokens lie in its own chunk but for those that open the next ones: at most one word a chunk
        # has such, and they are brought to it.
        parts = led.groupBy("video_id", "chunk", "head").agg(
            words_in_order(sep="").alias("w"), F.min_by("s_ms", "pos").alias("s_ms"), F.max("e_ms").alias("e_ms"))
        home = F.expr(f"head div {WORDS_PER_CHUNK}")
        rest = parts.filter(home < F.col("chunk")).groupBy("video_id", "head").agg(
            words_in_order("chunk", sep="").alias("more"), F.max("e_ms").alias("more_e"))
        rest = rest.select("video_id", home.alias("chunk"), F.col("head").alias("of"), "more", "more_e")
        all_ = parts.filter(home == F.col("chunk")).join(rest, ["video_id", "chunk"], "left")
        its = F.coalesce(F.col("of") == F.col("head"), F.lit(False))
        return all_.select("video_id", F.col("head").alias("pos"), F.concat("w", F.when(its, F.col("more")).otherwise("")).alias("w"), "s_ms",
                           F.greatest("e_ms", F.when(its, F.col("more_e"))).alias("e_ms"), *(["chunk"] if dealt else []))
    return led.groupBy("video_id", F.col("head").alias("pos")).agg(
        words_in_order(sep="").alias("w"),
        F.min_by("s_ms", "pos").alias("s_ms"),
        F.max("e_ms").alias("e_ms"),
    )


def text_buckets(words: DataFrame, size_ms: int = 10_000) -> DataFrame:
    """Tumbling buckets of text by word start."""
    return words.groupBy("video_id", F.floor(F.col("s_ms") / size_ms).alias("bucket")).agg(
        words_in_order().alias("text"), F.count("*").alias("n_words")
    )


def timecut(ranges: DataFrame, len_ms: int) -> DataFrame:
    """Slice each ``[a_ms, b_ms)`` into equal parts; parts under 5 s are dropped."""
    size = max(len_ms, 5000)
    a, b = F.greatest("a_ms", F.lit(0)), F.greatest("b_ms", F.lit(0))
    n = F.greatest(F.ceil((b - a) / size), F.lit(1)).cast("long")
    parts = ranges.filter(b - a >= 5000).select(
        *[c for c in ranges.columns if c not in ("a_ms", "b_ms")], a.alias("__a"), b.alias("__b"),
        n.alias("n_parts"), F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("part"),
    )
    start = F.col("__a") + F.col("part") * size
    out = parts.withColumn("start_ms", start).withColumn(
        "end_ms", F.least(start + size, F.col("__b"))
    )
    return out.filter("end_ms - start_ms >= 5000").drop("__a", "__b")


def top_sentences(scored: DataFrame, count: int) -> DataFrame:
    """The best ``3 * count`` sentences per video (over-proposal), earlier first on ties."""
    best = Window.partitionBy("video_id").orderBy(F.desc("score"), "sent_start")
    ranked = scored.withColumn("rn", F.row_number().over(best))
    return ranked.filter(F.col("rn") <= 3 * count).withColumn("rn", F.col("rn").cast("long"))


def fingerprint(words: DataFrame) -> DataFrame:
    """Order-aware hash of each video's (word, start) sequence.

    Every row hashes its position with its content to 64 bits; their exact sum and their exclusive or
    make the fingerprint, so no video is gathered in one place.
    """
    h = F.xxhash64("pos", "w", "s_ms")
    both = F.concat_ws(":", F.sum(h.cast("decimal(38,0)")).cast("string"), F.bit_xor(h).cast("string"))
    return words.groupBy("video_id").agg(both.alias("fingerprint"), F.count("*").alias("n"))
