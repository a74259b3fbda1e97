"""Lines, cues, outlines and upload kits."""

import uuid

from pyspark.sql import functions as F

from cuewise.catalog.intervals import PARTS, minute_parts, plans
from cuewise.catalog.registry import query
from cuewise.catalog.sql import capitalized, clean, rec, with_sentences, with_words
from cuewise.functions.fixed_values import TAG_STOP
from cuewise.operators import intervals as I
from cuewise.operators import kit as K
from cuewise.operators import lines as L
from cuewise.operators import outline as O
from cuewise.operators import segment
from cuewise.plans.jobs import read_srt, write_srt
from cuewise.session import checkpoint_dir
from cuewise.sources import testdata as td


def folded(brk, src="words"):
    """A packing rule as a recursive scan; ``brk`` sees p (line so far) and w (next word)."""
    return f""", wd AS (SELECT *, lag(e_ms) OVER (PARTITION BY video_id ORDER BY pos) AS le, lag(w) OVER (PARTITION BY video_id ORDER BY pos) AS lw FROM {src}),
pk AS (SELECT video_id, pos, pos AS line, 1 AS n, CAST(strlen(w) + 1 AS BIGINT) AS width, s_ms AS s0, e_ms AS pe FROM wd WHERE pos = 0
 UNION ALL SELECT video_id, pos, CASE WHEN b THEN pos ELSE line END, CASE WHEN b THEN 1 ELSE n + 1 END, CASE WHEN b THEN strlen(w) + 1 ELSE width + strlen(w) + 1 END, CASE WHEN b THEN s_ms ELSE s0 END, e_ms
 FROM (SELECT w.*, p.line, p.n, p.width, p.s0, ({brk}) AS b FROM pk p JOIN wd w ON w.video_id = p.video_id AND w.pos = p.pos + 1)),
ln AS (SELECT p.video_id, line, string_agg(w, ' ' ORDER BY w.pos) AS text, min(s_ms) AS s_ms, max(e_ms) AS e_ms, count(*) AS n_words FROM pk p JOIN words w USING (video_id, pos) GROUP BY 1, 2)"""


SUB = "w.s_ms - w.le > 600 OR p.n >= 16 OR (p.n >= 4 AND right(w.lw, 1) IN ('.', '?', '!'))"
SRT = "p.n >= 8 OR p.width + strlen(w.w) > 42 OR w.s_ms - w.le > 800 OR w.e_ms - p.s0 > 5000"
CAP = "p.n >= 4 OR p.width + strlen(w.w) > 24 OR w.s_ms - w.le > 600 OR w.e_ms - p.s0 > 4000"
READ = "w.s_ms - w.le > 1000 OR w.s_ms - p.s0 > 12000 OR (right(w.lw, 1) IN ('.', '?', '!', '…') AND (w.le - 450) - p.s0 > 3000)"
BLOCK = "(p.pe - p.s0 >= 20000 AND right(w.lw, 1) IN ('.', '?', '!')) OR p.pe - p.s0 >= 40000"
LINE_COLS = " SELECT video_id, line, text, s_ms, e_ms, n_words FROM ln"


def lines_query(name, rule, brk):
    @query(name, rec(with_words(folded(brk) + LINE_COLS)))
    def run(spark, sf):
        return L.packed_lines(td.words(spark, sf), rule)


lines_query("subtitle_lines", L.SUBTITLE, SUB)
lines_query("caption_lines", L.caption_rule(4, 24), CAP)
lines_query("readable_lines", L.READABLE, READ)
lines_query("transcript_blocks", L.BLOCK, BLOCK)


def _srt_time(c):
    return f"lpad(({c} // 3600000)::VARCHAR, 2, '0') || ':' || lpad(({c} // 60000 % 60)::VARCHAR, 2, '0') || ':' || lpad(({c} // 1000 % 60)::VARCHAR, 2, '0') || ',' || lpad(({c} % 1000)::VARCHAR, 3, '0')"


# A cue over 42 bytes breaks at the space nearest to its middle byte, the earlier one on ties.
CUES = f""", cu AS (SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY line) AS n, s_ms, e_ms, text, string_split(text, ' ') AS ws FROM ln),
cb AS (SELECT *, CASE WHEN strlen(text) > 42 AND len(ws) > 1 THEN list_sort(list_transform(range(1, len(ws)), lambda i: {{'d': abs(strlen(array_to_string(ws[1:i], ' ')) - strlen(text) // 2), 'i': i}}))[1].i END AS brk FROM cu),
cc AS (SELECT *, CASE WHEN brk IS NULL THEN text ELSE array_to_string(ws[1:brk], ' ') || chr(10) || array_to_string(ws[brk + 1:], ' ') END AS body FROM cb)
SELECT video_id, n, s_ms, e_ms, body, n || chr(10) || {_srt_time('s_ms')} || ' --> ' || {_srt_time('e_ms')} || chr(10) || body || chr(10) AS cue FROM cc"""


@query("srt_cues", rec(with_words(folded(SRT) + """
""" + CUES)))
def srt_cues(spark, sf):
    return L.srt_cues(td.words(spark, sf))


@query("stored_cues", rec(with_words(folded(SRT) + CUES.replace("SELECT video_id, n, s_ms, e_ms, body, n ||", "SELECT video_id, n, n ||"))))
def stored_cues(spark, sf):
    """Cues written to the shared folder as a table clustered by video, and read back."""
    path = f"{checkpoint_dir(spark)}/cuewise/{spark.sparkContext.applicationId}/cues-{uuid.uuid4().hex}"
    write_srt(L.srt_cues(td.words(spark, sf)), path)
    return read_srt(spark, path)


@query("sentence_split_captions", rec(with_words(folded(CAP) + """
, sp AS (SELECT video_id, pos, w, coalesce(max(CASE WHEN right(w, 1) IN ('.', '!', '?', '…') THEN pos + 1 END) OVER (PARTITION BY video_id, line ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), line) AS line FROM pk JOIN words USING (video_id, pos))
SELECT video_id, line, string_agg(w, ' ' ORDER BY pos) AS text FROM sp GROUP BY 1, 2""")))
def sentence_split_captions(spark, sf):
    return L.packed_lines(td.words(spark, sf), L.caption_rule(4, 24), split=True).select("video_id", "line", "text")


@query("held_captions")
def held_captions(spark, sf):
    w = segment.attach_punctuation(td.words(spark, sf), dealt=True)
    lines = L.merge_flash_lines(L.packed_lines(w, L.caption_rule(4, 24), split=True), 24)
    ends = td.durations(w).withColumnRenamed("duration_ms", "end_ms")
    return L.hold_lines(lines, ends).select("video_id", "line", "text", "s_ms", "off_ms")


@query("prompt_lines", with_words("""
, b AS (SELECT video_id, s_ms // 10000 AS bucket, string_agg(w, ' ' ORDER BY pos) AS t FROM words GROUP BY 1, 2),
l AS (SELECT video_id, bucket, '[' || lpad((bucket * 10 // 60)::VARCHAR, 2, '0') || ':' || lpad((bucket * 10 % 60)::VARCHAR, 2, '0') || '] ' || trim(t) || chr(10) AS line FROM b),
u AS (SELECT *, coalesce(sum(strlen(line)) OVER (PARTITION BY video_id ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM l)
SELECT video_id, bucket, CASE WHEN used + strlen(line) <= 2000 THEN line ELSE '[...truncated...]' END AS line FROM u WHERE used <= 2000"""))
def prompt_lines(spark, sf):
    return L.prompt_lines(segment.text_buckets(td.words(spark, sf)), 2000)


@query("balanced_breaks", with_sentences("""
, w AS (SELECT video_id, sent_start, text, string_split(text, ' ') AS ws FROM sentences WHERE length(text) > 18),
c AS (SELECT *, unnest(range(1, len(ws))) AS i FROM w),
d AS (SELECT *, length(array_to_string(ws[1:i], ' ')) AS a FROM c)
SELECT video_id, sent_start, CAST(arg_min(i, greatest(a, length(text) - a - 1) * 10000 + i) AS INT) AS brk FROM d GROUP BY 1, 2"""))
def balanced_breaks(spark, sf):
    return segment.sentences(td.words(spark, sf)).select(
        "video_id", "sent_start", L.balanced_break("text").alias("brk")).filter("brk is not null")


@query("summaries", with_words("""
, h AS (SELECT * FROM words WHERE pos < 60), s AS (SELECT video_id, min(CASE WHEN pos >= 24 AND right(w, 1) IN ('.', '?', '!') THEN pos END) AS stop FROM h GROUP BY 1)
SELECT video_id, string_agg(w, ' ' ORDER BY pos) AS summary FROM h JOIN s USING (video_id) WHERE stop IS NULL OR pos <= stop GROUP BY 1"""))
def summaries(spark, sf):
    return O.summaries(td.words(spark, sf))


def chapter_rounds():
    """Nine rounds, each taking the longest pause still far enough from all starts."""
    out = ""
    for k in range(1, 10):
        out += f""",
r{k} AS (SELECT g.video_id, arg_max(g.pos, (gap, -g.pos)) AS pos, arg_max(g.s_ms, (gap, -g.pos)) AS s FROM gp g JOIN p{k - 1} p ON p.video_id = g.video_id
  WHERE g.pos > 0 AND g.s_ms > spc AND len(ts) < n AND len(list_filter(ts, lambda t: abs(t - g.s_ms) < spc)) = 0 GROUP BY 1),
p{k} AS (SELECT p.video_id, CASE WHEN r.s IS NULL THEN ts ELSE list_append(ts, r.s) END AS ts, CASE WHEN r.s IS NULL THEN ps ELSE list_append(ps, r.pos) END AS ps
  FROM p{k - 1} p LEFT JOIN r{k} r USING (video_id))"""
    return out


CHAPTERS = """
, dd AS (SELECT video_id, max(e_ms) AS dur, least(greatest(CAST(floor(max(e_ms) / 240000.0 + 0.5) AS INT), 3), 10) AS n FROM words GROUP BY 1 HAVING max(e_ms) >= 90000),
gp AS MATERIALIZED (SELECT w.video_id, pos, s_ms, s_ms - lag(e_ms) OVER (PARTITION BY w.video_id ORDER BY pos) AS gap, dur / (n * 2.0) AS spc, n FROM words w JOIN dd USING (video_id)),
p0 AS (SELECT video_id, [s_ms] AS ts, [pos] AS ps FROM gp WHERE pos = 0)""" + chapter_rounds() + """,
cs AS (SELECT video_id, unnest(ps) AS pos, unnest(ts) AS s FROM p9),
ct AS (SELECT c.video_id, c.pos, CASE WHEN c.pos = 0 THEN 0 ELSE c.s END AS s, string_agg(regexp_replace(w, '[,.?!;]+$', ''), ' ' ORDER BY w.pos) AS t
  FROM cs c JOIN words w ON w.video_id = c.video_id AND w.pos BETWEEN c.pos AND c.pos + 5 GROUP BY 1, 2, 3),
co AS (SELECT video_id, s // 1000 AS start, left(regexp_replace(trim(""" + capitalized("t") + """), '[.:]+$', ''), 80) AS title, row_number() OVER (PARTITION BY video_id ORDER BY s) AS k FROM ct WHERE trim(t) <> ''),
td AS (SELECT video_id, k, 0::BIGINT AS last, [struct_pack(start := 0::BIGINT, title := title)] AS kept FROM co WHERE k = 1
 UNION ALL SELECT c.video_id, c.k, CASE WHEN ok THEN c.start ELSE last END, CASE WHEN ok THEN list_append(kept, struct_pack(start := c.start, title := c.title)) ELSE kept END
 FROM td t JOIN co c ON c.video_id = t.video_id AND c.k = t.k + 1 JOIN dd ON dd.video_id = t.video_id, LATERAL (SELECT NOT (c.start - t.last < 10 OR dur - c.start * 1000 < 10000) AS ok)),
tl AS (SELECT video_id, arg_max(kept, k) AS kept FROM td GROUP BY 1),
chapters AS (SELECT video_id, unnest(range(0, len(kept))) AS n, unnest(kept) AS c FROM tl WHERE len(kept) >= 3)"""


@query("chapters", rec(with_words(CHAPTERS + " SELECT video_id, n, c.start AS start, c.title AS title FROM chapters")))
def chapters(spark, sf):
    w = td.words(spark, sf)
    return O.chapters(w, td.durations(w))


@query("upload_texts")
def upload_texts(spark, sf):
    w = td.words(spark, sf)
    names = td.table(spark, sf, "documents").select(F.col("doc_id").alias("video_id"), F.concat(F.lit("Talk "), "doc_id").alias("title"))
    return O.kit_texts(names, O.summaries(w), O.chapters(w, td.durations(w)))


def part_clips(w):
    hooked = minute_parts(w).withColumnRenamed("a_ms", "start_ms").withColumnRenamed("b_ms", "end_ms")
    return hooked.select("*", F.concat(F.lit("Part "), "rank").alias("hook"), F.lit("Offline heuristic note.").alias("why"),
                         F.lit(None).cast("string").alias("title"), F.array(F.lit("#Talk"), F.lit("bad tag"), F.lit(" #talk")).alias("hashtags"))


@query("clip_hashtags", with_words(PARTS + rf"""
, c AS (SELECT r.video_id, r.rank, {clean('w')} AS c FROM words w JOIN ranges r ON w.video_id = r.video_id AND s_ms >= a_ms - 50 AND s_ms <= b_ms + 350 AND e_ms <= b_ms + 350),
f AS (SELECT video_id, rank, c, count(*) AS n FROM c WHERE strlen(c) >= 5 AND c NOT IN ({', '.join(repr(x) for x in TAG_STOP)}) GROUP BY 1, 2, 3 HAVING count(*) >= 2),
o AS (SELECT *, row_number() OVER (PARTITION BY video_id, rank ORDER BY n DESC, c) AS k FROM f),
s AS (SELECT video_id, rank, string_agg('#' || c, ' ' ORDER BY k) AS t FROM o WHERE k <= 7 GROUP BY 1, 2)
SELECT video_id, rank, '#talk' || coalesce(' ' || t, '') AS tags FROM ranges LEFT JOIN s USING (video_id, rank)"""))
def clip_hashtags(spark, sf):
    w = td.words(spark, sf)
    return K.clip_hashtags(part_clips(w), w).select("video_id", "rank", F.array_join("tags", " ").alias("tags"))


@query("clip_bodies")
def clip_bodies(spark, sf):
    w = td.words(spark, sf)
    return K.bodies(part_clips(w), w)


@query("headlines")
def headlines(spark, sf):
    w = td.words(spark, sf)
    s = K.spoken_sentences(I.retime(w, I.keep_rows(plans(spark, sf, "punchy"))))
    return K.headlines(part_clips(w), s).withColumn("accent", K.accent_word("headline"))


@query("respread_lines")
def respread_lines(spark, sf):
    """Subtitle lines 'translated' by reversing them; every seventh translation is blank."""
    w = td.words(spark, sf)
    lines = L.packed_lines(w, L.SUBTITLE)
    t = lines.select("video_id", "line", F.when(F.expr("line % 7 = 3"), " ").otherwise(F.reverse("text")).alias("translated"))
    # Only words of lines that may keep them.
    kept = L.words_of_lines(lines.join(t.filter(F.trim("translated") == ""), ["video_id", "line"], "left_semi"), w)
    return I.translated_words(lines.select("video_id", "line", "s_ms", "e_ms"), t, kept)
