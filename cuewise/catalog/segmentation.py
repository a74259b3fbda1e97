"""Words, sentences, islands, buckets."""

from pyspark.sql import functions as F

from cuewise.catalog.registry import query
from cuewise.catalog.sql import with_sentences, with_words
from cuewise.operators import segment
from cuewise.sources import testdata as td


@query("timed_words", with_words("""
SELECT video_id, count(*) AS n, min(pos) AS p0, max(e_ms) AS last_e, CAST(sum(s_ms) AS BIGINT) AS sum_s,
       CAST(sum(length(w)) AS BIGINT) AS chars FROM words GROUP BY 1"""))
def timed_words(spark, sf):
    return td.ingest_words(spark, sf).groupBy("video_id").agg(
        F.count("*").alias("n"), F.min("pos").alias("p0"), F.max("e_ms").alias("last_e"),
        F.sum("s_ms").alias("sum_s"), F.sum(F.char_length("w")).alias("chars"))


@query("sentences", with_sentences(
    "SELECT video_id, sent_start, n_words, s_ms, e_ms, text, score FROM scored"))
def sentences(spark, sf):
    return segment.scored_sentences(td.words(spark, sf))


@query("top_sentences", with_sentences("""
SELECT video_id, sent_start, score, text, CAST(rn AS BIGINT) AS rn FROM (
  SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, sent_start) AS rn FROM scored)
WHERE rn <= 9"""))
def top_sentences(spark, sf):
    return segment.top_sentences(segment.scored_sentences(td.words(spark, sf)), 3).select(
        "video_id", "sent_start", "score", "text", "rn")


@query("pauses", with_words("""
SELECT video_id, pos, s_ms - lag(e_ms) OVER (PARTITION BY video_id ORDER BY pos) AS gap_ms FROM words"""))
def pauses(spark, sf):
    return segment.gap_before(td.words(spark, sf)).select("video_id", "pos", "gap_ms")


@query("running_end_gaps", with_words("""
SELECT video_id, pos, s_ms - coalesce(max(e_ms) OVER (PARTITION BY video_id ORDER BY pos
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gap_ms FROM words"""))
def running_end_gaps(spark, sf):
    return segment.gap_to_running_end(td.words(spark, sf)).select("video_id", "pos", "gap_ms")


@query("utterance_onsets", with_words("""
SELECT video_id, pos, s_ms FROM (SELECT *, max(e_ms) OVER (PARTITION BY video_id ORDER BY pos
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM words)
WHERE m IS NULL OR s_ms - m >= 250"""))
def utterance_onsets(spark, sf):
    return segment.onsets(td.words(spark, sf))


@query("attached_punctuation", with_words(r"""
, f AS (SELECT *, NOT (w <> '' AND NOT regexp_matches(w, '[\p{L}\p{N}]')) OR pos = 0 AS head FROM words),
g AS (SELECT *, max(CASE WHEN head THEN pos END) OVER (PARTITION BY video_id ORDER BY pos) AS h FROM f)
SELECT video_id, h AS pos, string_agg(w, '' ORDER BY pos) AS w, min(s_ms) AS s_ms, max(e_ms) AS e_ms
FROM g GROUP BY 1, 2"""))
def attached_punctuation(spark, sf):
    return segment.attach_punctuation(td.words(spark, sf))


@query("text_buckets", with_words("""
SELECT video_id, s_ms // 10000 AS bucket, string_agg(w, ' ' ORDER BY pos) AS text, count(*) AS n_words
FROM words GROUP BY 1, 2"""))
def text_buckets(spark, sf):
    return segment.text_buckets(td.words(spark, sf))


@query("timecut_parts", with_words("""
, d AS (SELECT video_id, max(e_ms) AS b FROM words GROUP BY 1),
p AS (SELECT video_id, b, n, unnest(range(0, n)) AS part FROM (
  SELECT video_id, b, CAST(greatest(ceil(b / 30000.0), 1) AS BIGINT) AS n FROM d WHERE b >= 5000))
SELECT video_id, n AS n_parts, part, part * 30000 AS start_ms, least(part * 30000 + 30000, b) AS end_ms
FROM p WHERE least(part * 30000 + 30000, b) - part * 30000 >= 5000"""))
def timecut_parts(spark, sf):
    spans = td.durations(td.words(spark, sf)).select(
        "video_id", F.lit(0).cast("long").alias("a_ms"), F.col("duration_ms").alias("b_ms"))
    return segment.timecut(spans, 30_000)
