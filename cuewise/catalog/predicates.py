"""Word and text predicates, normalisers, stamps."""

from pyspark.sql import functions as F

from cuewise.catalog.registry import query
from cuewise.catalog.sql import clean, with_sentences, with_words
from cuewise.functions import fixed_values as V
from cuewise.functions import score as S
from cuewise.functions import text as T
from cuewise.functions import timefmt as X
from cuewise.operators import ranges as R
from cuewise.operators import segment
from cuewise.sources import testdata as td

FOCUS = "Thation, the moments of Ouest en areas"
KNOWN_KEY = "key-0123456789"
JUDGES = ["hosted", "local"]


def quoted(words):
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


@query("word_flags", with_words(rf"""
, c AS (SELECT *, {clean('w')} AS c FROM words)
SELECT video_id,
  CAST(sum(CASE WHEN right(w, 1) IN ('.', '!', '?', '…') THEN 1 ELSE 0 END) AS BIGINT) AS ends,
  CAST(sum(CASE WHEN right(w, 1) IN ('.', '!', '?') THEN 1 ELSE 0 END) AS BIGINT) AS line_ends,
  CAST(sum(length(c)) AS BIGINT) AS clean_chars,
  CAST(sum(CASE WHEN c IN ({quoted(V.HOOK_FILLERS)}) THEN 1 ELSE 0 END) AS BIGINT) AS hook_fillers,
  CAST(sum(CASE WHEN c IN ({quoted(V.TIGHTEN_FILLERS)}) THEN 1 ELSE 0 END) AS BIGINT) AS cut_fillers
FROM c GROUP BY 1"""))
def word_flags(spark, sf):
    def n(cond):
        return F.sum(F.when(cond, 1).otherwise(0))

    w = td.words(spark, sf).withColumn("c", T.clean("w"))
    return w.groupBy("video_id").agg(
        n(T.ends_sentence("w")).alias("ends"), n(T.ends_line_sentence("w")).alias("line_ends"),
        F.sum(F.char_length("c")).alias("clean_chars"),
        n(F.col("c").isin(V.HOOK_FILLERS)).alias("hook_fillers"),
        n(F.col("c").isin(V.TIGHTEN_FILLERS)).alias("cut_fillers"))


@query("keywords", with_sentences(rf"""
, k AS (SELECT video_id, pos, w, pos = sent_start AS opens, {clean('w')} AS c, left(trim(w), 1) AS f FROM sw)
SELECT video_id, pos, w FROM k WHERE c <> '' AND (regexp_matches(c, '[0-9]')
  OR c IN ({quoted(V.POWER_WORDS)}) OR (NOT opens AND f <> lower(f) AND strlen(c) > 1))"""))
def keywords(spark, sf):
    w = segment.with_sentence(td.words(spark, sf))
    w = w.withColumn("opens", F.col("pos") == F.col("sent_start"))
    return w.filter(T.is_keyword("w", "opens")).select("video_id", "pos", "w")


STEM = "CASE " + " ".join(
    f"WHEN ends_with(t, '{x}') AND length(t) - {len(x)} >= 4 THEN left(t, length(t) - {len(x)})"
    for x in V.FOCUS_SUFFIXES) + " ELSE t END"


@query("focus_terms", rf"""
WITH l AS (SELECT item_id, unnest(a) AS t, unnest(range(0, len(a))) AS i FROM
  (SELECT item_id, string_split_regex(lower(text), '[^\p{{L}}\p{{N}}]+') AS a FROM benchmark)),
s AS (SELECT item_id, i, {STEM} AS s FROM l WHERE t <> '' AND t NOT IN ({quoted(V.FOCUS_STOP)})),
d AS (SELECT item_id, s, min(i) AS i FROM s GROUP BY 1, 2)
SELECT b.item_id, coalesce(string_agg(d.s, ' ' ORDER BY d.i), '') AS terms
FROM benchmark b LEFT JOIN d USING (item_id) GROUP BY 1""")
def focus_terms(spark, sf):
    return td.table(spark, sf, "benchmark").select(
        "item_id", F.array_join(T.focus_terms("text"), " ").alias("terms"))


# Terms of FOCUS: thation, ouest, area (stop words out, one suffix off).
@query("focus_sentences", with_sentences(r"""
, t AS (SELECT video_id, sent_start, n_words, score, unnest(string_split_regex(lower(text), '[^\p{L}\p{N}]+')) AS t FROM scored),
h AS (SELECT DISTINCT video_id, sent_start FROM t WHERE starts_with(t, 'thation') OR starts_with(t, 'ouest')
      OR t = 'en' OR starts_with(t, 'area'))
SELECT s.video_id, s.sent_start, s.score + CASE WHEN h.video_id IS NULL THEN 0 ELSE 25 END AS score
FROM scored s LEFT JOIN h USING (video_id, sent_start)"""))
def focus_sentences(spark, sf):
    return segment.scored_sentences(td.words(spark, sf), ["thation", "ouest", "en", "area"]).select(
        "video_id", "sent_start", "score")


@query("focus_mentions_by_table", rf"""
WITH l AS (SELECT item_id, unnest(a) AS t, unnest(range(0, len(a))) AS i FROM
  (SELECT item_id, string_split_regex(lower(text), '[^\p{{L}}\p{{N}}]+') AS a FROM benchmark)),
s AS (SELECT DISTINCT item_id, {STEM} AS s FROM l WHERE t <> '' AND t NOT IN ({quoted(V.FOCUS_STOP)})),
d AS (SELECT DISTINCT doc_id, unnest(string_split_regex(lower(text), '[^\p{{L}}\p{{N}}]+')) AS t FROM documents)
SELECT item_id, count(DISTINCT doc_id) AS n_docs FROM s JOIN d
  ON (length(s.s) <= 3 AND d.t = s.s) OR (length(s.s) > 3 AND starts_with(d.t, s.s)) GROUP BY 1""")
def focus_mentions_by_table(spark, sf):
    """Every benchmark text as a topic, against every document: a token join, not all pairs."""
    terms = td.table(spark, sf, "benchmark").select(
        "item_id", F.explode(T.focus_terms("text")).alias("term"))
    docs = td.table(spark, sf, "documents").repartition("doc_id").select("doc_id", "text")
    return R.mentions(docs, "doc_id", "text", terms).groupBy("item_id").agg(
        F.count("doc_id").alias("n_docs"))


@query("score_totals", """
SELECT vec_id, round(CASE WHEN label = 3 THEN 50.0 ELSE .4*a + .25*b + .2*c + .15*d END, 6) AS total,
  CAST(CASE WHEN a BETWEEN 0 AND 10 AND b BETWEEN 0 AND 10 AND c BETWEEN 0 AND 10 AND d BETWEEN 0 AND 10
    THEN a * 10 ELSE a END AS BIGINT) AS hook_100
FROM (SELECT vec_id, label, CAST(floor(abs(embedding[1]::DOUBLE) * 60) AS INT) AS a,
  CAST(floor(abs(embedding[2]::DOUBLE) * 60) AS INT) AS b, CAST(floor(abs(embedding[3]::DOUBLE) * 60) AS INT) AS c,
  CAST(floor(abs(embedding[4]::DOUBLE) * 60) AS INT) AS d FROM embeddings)""")
def score_totals(spark, sf):
    v = td.table(spark, sf, "embeddings")
    dims = [F.floor(F.abs(F.col("embedding")[i].cast("double")) * 60).cast("int").alias(d)
            for i, d in enumerate(S.DIMENSIONS)]
    v = v.select("vec_id", "label", F.struct(*dims).alias("s"))
    v = v.withColumn("known", F.when(F.col("label") != 3, F.col("s")))
    return v.select("vec_id", F.round(S.total_of("known"), 6).alias("total"),
                    S.unify_scale("s")["hook"].cast("long").alias("hook_100"))


@query("styles_and_tags", """
SELECT event_id, CASE WHEN s IN ('tiktok','karaoke','hormozi','minimal','beast','neon','highlight','ghost') THEN s ELSE 'karaoke' END AS pick_style,
 CASE WHEN s IN ('tiktok','karaoke','hormozi','minimal','beast','neon','highlight','ghost') THEN s ELSE 'tiktok' END AS caption_style,
 '#' || event_type || CASE WHEN user_id % 7 = 0 THEN '' ELSE ' #u' || user_id END AS tags
FROM (SELECT *, CASE event_id % 4 WHEN 0 THEN 'neon' WHEN 1 THEN 'ghost' WHEN 2 THEN event_type ELSE NULL END AS s FROM events)""")
def styles_and_tags(spark, sf):
    e = td.table(spark, sf, "events")
    style = (F.when(F.expr("event_id % 4 = 0"), "neon").when(F.expr("event_id % 4 = 1"), "ghost")
             .when(F.expr("event_id % 4 = 2"), F.col("event_type")))
    user = F.when(F.expr("user_id % 7 = 0"), " # ").otherwise(F.concat(F.lit(" ##u"), F.col("user_id")))
    tags = F.array(F.concat(F.lit(" "), F.col("event_type")), user)
    return e.select("event_id", T.style_or(style, "karaoke").alias("pick_style"),
                    T.style_or(style, "tiktok").alias("caption_style"),
                    F.array_join(T.hashtags(tags), " ").alias("tags"))


@query("transcript_range", with_words(
    "SELECT video_id, pos, w FROM words WHERE s_ms BETWEEN 60000 AND 90000"))
def transcript_range(spark, sf):
    return R.transcript_between(td.words(spark, sf), 60_000, 90_000).select("video_id", "pos", "w")


RANGE_TEXT = "(user_id % 90) || '-' || (event_id % 120) || ', ' || value || '-' || (value + 40) || ',x-5'"


@query("parsed_ranges", f"""
WITH r AS (SELECT event_id, 100.0 AS dur, unnest(string_split({RANGE_TEXT}, ',')) AS p FROM events),
q AS (SELECT event_id, dur, try_cast(trim(split_part(p, '-', 1)) AS DOUBLE) AS a,
        try_cast(trim(split_part(p, '-', 2)) AS DOUBLE) AS b FROM r)
SELECT event_id, CAST(round(greatest(least(a, b), 0) * 1000) AS BIGINT) AS a_ms,
  CAST(round(least(greatest(a, b), dur) * 1000) AS BIGINT) AS b_ms
FROM q WHERE a IS NOT NULL AND b IS NOT NULL
  AND round(least(greatest(a, b), dur) * 1000) - round(greatest(least(a, b), 0) * 1000) >= 3000""")
def parsed_ranges(spark, sf):
    e = td.table(spark, sf, "events").select(
        "event_id", F.lit(100_000).alias("duration_ms"), F.expr(RANGE_TEXT).alias("ranges"))
    return R.parse_ranges(e, "ranges", "duration_ms").select("event_id", "a_ms", "b_ms")


@query("parsed_spans", """
WITH q AS (SELECT event_id, event_id % 80 AS a, CAST(user_id % 100 AS BIGINT) AS b, event_type FROM events),
p AS (SELECT *, event_type <> 'view' AND least(greatest(a, b), 90) - greatest(least(a, b), 0) >= 5 AS ok FROM q)
SELECT event_id, CAST(CASE WHEN ok THEN least(a, b) * 1000 ELSE 0 END AS BIGINT) AS a_ms,
  CAST(CASE WHEN ok THEN least(greatest(a, b), 90) * 1000 ELSE 90000 END AS BIGINT) AS b_ms FROM p""")
def parsed_spans(spark, sf):
    e = td.table(spark, sf, "events").selectExpr(
        "event_id", "90000L AS duration_ms",
        "if(event_type = 'view', 'bad', concat(event_id % 80, ' - ', user_id % 100)) AS span")
    return R.parse_span(e, "span", "duration_ms").select("event_id", "a_ms", "b_ms")


@query("codes", """
SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE lang END AS lang_ok,
 CASE WHEN doc_id % 3 = 0 THEN 'local' WHEN doc_id % 3 = 1 THEN 'off' END AS judge_ok,
 CASE WHEN doc_id % 4 = 0 THEN NULL ELSE lang END AS target,
 CASE lang WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' WHEN 'fr' THEN 'French' WHEN 'es' THEN 'Spanish' ELSE lang END AS lang_name
FROM documents""")
def codes(spark, sf):
    d = td.table(spark, sf, "documents")
    lang = F.when(F.expr("doc_id % 5 = 0"), "e1").otherwise(F.concat(F.lit(" "), F.upper("lang")))
    judge = F.expr("element_at(array('Local', ' OFF', 'unknown'), int(doc_id % 3) + 1)")
    target = F.when(F.expr("doc_id % 4 = 0"), "None").otherwise(F.upper("lang"))
    return T.with_language_name(d, "lang", "lang_name").select(
        "doc_id", T.valid_language(lang).alias("lang_ok"), T.valid_decider(judge, JUDGES).alias("judge_ok"),
        T.subtitle_target(target).alias("target"), "lang_name")


@query("page_hosts", r"""
SELECT page_id, regexp_matches(trim(url), '^https?://[^/ ]*\.[^/ ]*(/[^ ]*)?$') AS is_url,
  regexp_replace(split_part(split_part(split_part(split_part(trim(url), '://', 2), '/', 1), '?', 1), '#', 1),
    '^(www\.)*(m\.)*', '') AS host FROM pages""")
def page_hosts(spark, sf):
    return td.table(spark, sf, "pages").select(
        "page_id", T.is_url("url").alias("is_url"), T.host("url").alias("host"))


@query("redacted_logs", """
SELECT page_id, url || ' auth Bearer [REDACTED] key [REDACTED] sk-[REDACTED] sk-short ' || page_id AS line FROM pages""")
def redacted_logs(spark, sf):
    line = F.concat(F.col("url"), F.lit(f" auth Bearer abcDEF_123-{'x' * 9} key {KNOWN_KEY} sk-"),
                    F.lpad(F.col("page_id").cast("string"), 9, "0"), F.lit(" sk-short "), F.col("page_id"))
    return td.table(spark, sf, "pages").select("page_id", T.redact(line, [KNOWN_KEY]).alias("line"))


@query("redacted_documents", r"""
SELECT doc_id, regexp_replace(text, '(sk-|Bearer )[A-Za-z0-9_-]{8,}', '\1[REDACTED]', 'g') AS text FROM documents""")
def redacted_documents(spark, sf):
    return td.table(spark, sf, "documents").select("doc_id", T.redact("text").alias("text"))


@query("preview_windows", """
SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 0 ELSE greatest(round(value - 3, 4), 0) END AS start_s,
  least(round(value * 100, 4), 3600) AS len_s,
  CASE WHEN event_id % 13 = 0 THEN 0 ELSE least(greatest(event_id % 900 - 5, 0), least(round(value * 100, 4), 3600)) END::DOUBLE AS t
FROM events WHERE value > 0""")
def preview_windows(spark, sf):
    e = td.table(spark, sf, "events")
    nan = F.lit(float("nan"))
    start = F.when(F.expr("event_id % 11 = 0"), nan).otherwise(F.round(F.col("value") - 3, 4))
    t = F.when(F.expr("event_id % 13 = 0"), nan).otherwise((F.col("event_id") % 900 - 5).cast("double"))
    e = e.select("event_id", start.alias("start_s"), F.round(F.col("value") * 100, 4).alias("len_s"), t.alias("t"))
    return R.preview_window(e)


# Minutes and hours are unbounded, so they are padded and never cut; hundredths are rounded.
@query("stamps", with_words("""
SELECT video_id, pos,
 CASE WHEN e_ms >= 3600000 THEN (e_ms // 3600000) || ':' || lpad((e_ms // 60000 % 60)::VARCHAR, 2, '0') || ':' || lpad((e_ms // 1000 % 60)::VARCHAR, 2, '0')
   ELSE (e_ms // 60000) || ':' || lpad((e_ms // 1000 % 60)::VARCHAR, 2, '0') END AS clock,
 lpad((e_ms // 60000)::VARCHAR, greatest(length((e_ms // 60000)::VARCHAR), 2)::INT, '0') || ':' || lpad((e_ms // 1000 % 60)::VARCHAR, 2, '0') AS minute,
 lpad((e_ms // 3600000)::VARCHAR, greatest(length((e_ms // 3600000)::VARCHAR), 2)::INT, '0') || ':' || lpad((e_ms // 60000 % 60)::VARCHAR, 2, '0') || ':' || lpad((e_ms // 1000 % 60)::VARCHAR, 2, '0') || ',' || lpad((e_ms % 1000)::VARCHAR, 3, '0') AS srt,
 ((e_ms + 5) // 3600000) || ':' || lpad(((e_ms + 5) // 60000 % 60)::VARCHAR, 2, '0') || ':' || lpad(((e_ms + 5) // 1000 % 60)::VARCHAR, 2, '0') || '.' || lpad(((e_ms + 5) // 10 % 100)::VARCHAR, 2, '0') AS centi
FROM words"""))
def stamps(spark, sf):
    return td.words(spark, sf).select(
        "video_id", "pos", X.clock("e_ms").alias("clock"), X.minute("e_ms").alias("minute"),
        X.srt("e_ms").alias("srt"), X.centi("e_ms").alias("centi"))


@query("stamp_seconds", """
SELECT event_id, CAST(CASE event_id % 4 WHEN 3 THEN 0 WHEN 2 THEN (event_id % 60) * 60000 + (event_id % 50) * 1000 + 250
   ELSE (user_id % 9) * 3600000 + (event_id % 60) * 60000 + (user_id % 60) * 1000 + event_id % 1000 END AS BIGINT) AS ms
FROM events""")
def stamp_seconds(spark, sf):
    e = td.table(spark, sf, "events")
    full = F.format_string("%02d:%02d:%02d,%03d", F.expr("user_id % 9"), F.expr("event_id % 60"),
                           F.expr("user_id % 60"), F.expr("event_id % 1000"))
    short = F.format_string(" %02d:%02d.25", F.expr("event_id % 60"), F.expr("event_id % 50"))
    text = (F.when(F.expr("event_id % 4 = 3"), "soon").when(F.expr("event_id % 4 = 2"), short).otherwise(full))
    return e.select("event_id", X.stamp_ms(text).alias("ms"))


@query("headline_fallback", """
SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 5 = 1 THEN 'Option ' || lang
  WHEN doc_id % 3 = 0 THEN 'Job ' || source ELSE 'Clip ' || doc_id END AS headline FROM documents""")
def headline_fallback(spark, sf):
    d = td.table(spark, sf, "documents")
    option = (F.when(F.expr("doc_id % 5 = 1"), F.concat(F.lit(" Option "), F.col("lang")))
              .when(F.expr("doc_id % 5 > 1"), "  "))
    clip = F.when(F.expr("doc_id % 3 = 0"), " ").otherwise(F.concat(F.lit("Clip "), F.col("doc_id")))
    return d.select("doc_id", T.headline_choice(option, clip, F.concat(F.lit("Job "), F.col("source"))).alias("headline"))


@query("capitalized_sentences", with_sentences("""
SELECT video_id, sent_start, CASE WHEN left(t, 1) = 'ß' THEN 'SS' ELSE upper(left(t, 1)) END || substr(t, 2) AS text FROM
 (SELECT video_id, sent_start, lower(text) AS t FROM sentences)"""))
def capitalized_sentences(spark, sf):
    return segment.sentences(td.words(spark, sf)).select(
        "video_id", "sent_start", T.capitalize(F.lower("text")).alias("text"))


@query("word_fingerprints")
def word_fingerprints(spark, sf):
    return segment.fingerprint(td.words(spark, sf))
