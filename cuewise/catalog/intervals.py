"""Interval algebra queries, on one-minute parts of every video."""

from pyspark.sql import functions as F

from cuewise.catalog.registry import query
from cuewise.catalog.sql import clean, with_words
from cuewise.functions.fixed_values import TIGHTEN_FILLERS
from cuewise.operators import intervals as I
from cuewise.operators import segment
from cuewise.sources import testdata as td
from cuewise.sources.staging import cut

PARTS = """
, d AS (SELECT video_id, max(e_ms) AS dur FROM words GROUP BY 1),
pp AS (SELECT video_id, dur, unnest(range(0, CAST(greatest(ceil(dur / 60000.0), 1) AS BIGINT))) AS part FROM d WHERE dur >= 5000),
ranges AS (SELECT video_id, part + 1 AS rank, part * 60000 AS a_ms, least(part * 60000 + 60000, dur) AS b_ms FROM pp
  WHERE least(part * 60000 + 60000, dur) - part * 60000 >= 5000)"""


def minute_parts(w):
    spans = td.durations(w).select("video_id", F.lit(0).cast("long").alias("a_ms"), F.col("duration_ms").alias("b_ms"))
    return segment.timecut(spans, 60_000).select(
        "video_id", (F.col("part") + 1).alias("rank"), F.col("start_ms").alias("a_ms"), F.col("end_ms").alias("b_ms"))


def tenths(x):
    return f"(({x} + 50) // 100 // 10) || '.' || (({x} + 50) // 100 % 10)"


def plan_sql(mode):
    fill = "" if mode == "light" else f"""
 UNION ALL SELECT video_id, rank, fa, fb, 2, 'filler ''' || c || '''' FROM (SELECT *, {clean('w')} AS c,
    greatest(s_ms - 80, a_ms, coalesce(le, a_ms)) AS fa, least(e_ms + 80, b_ms, coalesce(ns, b_ms)) AS fb FROM sd)
  WHERE c IN ({', '.join(repr(x) for x in TIGHTEN_FILLERS)}) AND fb - fa > 20"""
    lv = "'light'" if mode == "light" else "'punchy', 'light'"
    return PARTS + f"""
, sd AS (SELECT r.video_id, r.rank, a_ms, b_ms, pos, w, s_ms, e_ms,
   greatest(a_ms, max(e_ms) OVER (PARTITION BY r.video_id, r.rank ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS pe,
   lag(e_ms) OVER (PARTITION BY r.video_id, r.rank ORDER BY pos) AS le, lead(s_ms) OVER (PARTITION BY r.video_id, r.rank ORDER BY pos) AS ns
  FROM words w JOIN ranges r ON w.video_id = r.video_id AND e_ms > a_ms AND s_ms < b_ms),
p1 AS (SELECT *, s_ms - coalesce(pe, a_ms) AS gap, coalesce(pe, a_ms) + CASE WHEN le IS NULL THEN 0 ELSE 150 END AS ra FROM sd),
p2 AS (SELECT *, greatest(s_ms - CASE WHEN le IS NULL THEN 250 ELSE 100 END, ra) AS rb FROM p1 WHERE gap > 800),
tl AS (SELECT r.video_id, r.rank, r.b_ms, greatest(r.a_ms, coalesce(max(s.e_ms), r.a_ms)) AS la FROM ranges r LEFT JOIN sd s USING (video_id, rank) GROUP BY r.video_id, r.rank, r.a_ms, r.b_ms),
rm AS (SELECT video_id, rank, ra AS a, rb AS b, 0 AS seq, 'pause ' || {tenths('gap')} || 's->0.25s' AS reason FROM p2 WHERE rb - ra > 50
 UNION ALL SELECT video_id, rank, la + 250, b_ms, 1, 'tail pause ' || {tenths('(b_ms - la)')} || 's' FROM tl WHERE b_ms - la > 800 AND b_ms - la - 250 > 50{fill}),
rl AS (SELECT rm.video_id, rm.rank, level, greatest(a, a_ms) AS a, least(b, b_ms) AS b, seq, reason FROM rm JOIN ranges USING (video_id, rank),
  (SELECT unnest([{lv}]) AS level) WHERE level = 'punchy' OR seq < 2),
m1 AS (SELECT *, max(b) OVER (PARTITION BY video_id, rank, level ORDER BY a, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ot FROM rl WHERE b > a),
m2 AS (SELECT *, sum(CASE WHEN ot IS NULL OR a > ot + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY video_id, rank, level ORDER BY a, seq) AS isl FROM m1),
m3 AS (SELECT video_id, rank, level, isl, reason, min(a) AS a, max(b) AS b, min((a, seq)) AS o FROM m2 GROUP BY 1, 2, 3, 4, 5),
mg AS (SELECT video_id, rank, level, min(a) AS a, max(b) AS b, string_agg(reason, ' + ' ORDER BY o) AS reason FROM m3 GROUP BY video_id, rank, level, isl),
lv AS (SELECT * FROM ranges, (SELECT unnest([{lv}]) AS level)),
pc AS (SELECT video_id, rank, level, coalesce(lag(b) OVER w, a_ms) AS a, a AS b FROM mg JOIN ranges USING (video_id, rank) WINDOW w AS (PARTITION BY video_id, rank, level ORDER BY a)
  UNION ALL SELECT l.video_id, l.rank, l.level, coalesce(max(mg.b), l.a_ms), l.b_ms FROM lv l LEFT JOIN mg USING (video_id, rank, level) GROUP BY l.video_id, l.rank, l.level, l.a_ms, l.b_ms),
kp AS (SELECT * FROM pc WHERE b - a >= 400),
tot AS (SELECT l.video_id, l.rank, l.level, l.a_ms, l.b_ms, count(kp.a) AS n, coalesce(sum(kp.b - kp.a), l.b_ms - l.a_ms) AS tight FROM lv l LEFT JOIN kp USING (video_id, rank, level) GROUP BY l.video_id, l.rank, l.level, l.a_ms, l.b_ms),
okp AS (SELECT video_id, rank, min(CASE WHEN level = 'punchy' THEN 0 ELSE 1 END) AS lvl FROM tot WHERE NOT (tight < 4000 OR tight * 10 < (b_ms - a_ms) * 4) GROUP BY 1, 2),
ch AS (SELECT r.video_id, r.rank, a_ms, b_ms, CASE lvl WHEN 0 THEN 'punchy' WHEN 1 THEN 'light' ELSE 'off' END AS mode FROM ranges r LEFT JOIN okp USING (video_id, rank)),
keeps0 AS (SELECT c.video_id, c.rank, kp.a, kp.b FROM ch c JOIN kp ON kp.video_id = c.video_id AND kp.rank = c.rank AND kp.level = c.mode
  UNION ALL SELECT c.video_id, c.rank, c.a_ms, c.b_ms FROM ch c LEFT JOIN tot t ON t.video_id = c.video_id AND t.rank = c.rank AND t.level = c.mode WHERE c.mode = 'off' OR t.n = 0),
keeps AS (SELECT video_id, rank, row_number() OVER (PARTITION BY video_id, rank ORDER BY a) - 1 AS k, a AS a_ms, b AS b_ms FROM keeps0),
removed AS (SELECT c.video_id, c.rank, row_number() OVER (PARTITION BY c.video_id, c.rank ORDER BY mg.a) - 1 AS r, mg.a AS a_ms, mg.b AS b_ms, mg.reason
  FROM ch c JOIN mg ON mg.video_id = c.video_id AND mg.rank = c.rank AND mg.level = c.mode JOIN tot t ON t.video_id = c.video_id AND t.rank = c.rank AND t.level = c.mode WHERE t.n > 0)
"""


LIGHT, PUNCHY = plan_sql("light"), plan_sql("punchy")


def plans(spark, sf, mode):
    w = td.words(spark, sf)
    return I.tighten(minute_parts(w), w, I.Tighten(mode=mode))


@query("light_keeps", with_words(LIGHT + " SELECT * FROM keeps"))
def light_keeps(spark, sf):
    return I.keep_rows(plans(spark, sf, "light"))


@query("punchy_keeps", with_words(PUNCHY + " SELECT * FROM keeps"))
def punchy_keeps(spark, sf):
    return I.keep_rows(plans(spark, sf, "punchy"))


def refined(spark, sf):
    """Cut plans of minute parts, their edges moved to quiet instants."""
    w = td.words(spark, sf)
    p = cut(plans(spark, sf, "light"))
    return I.refine_edges(I.keep_rows(p), I.removed_rows(p), w, td.energy_runs(spark, sf))


@query("refined_keeps")
def refined_keeps(spark, sf):
    return refined(spark, sf)[0]


@query("refined_removed")
def refined_removed(spark, sf):
    return refined(spark, sf)[1]


@query("punchy_removed", with_words(PUNCHY + " SELECT * FROM removed"))
def punchy_removed(spark, sf):
    return I.removed_rows(plans(spark, sf, "punchy"))


@query("kept_time", with_words(PUNCHY + """
SELECT c.video_id, c.rank, c.mode, CAST(sum(k.b_ms - k.a_ms) AS BIGINT) AS tight_ms,
  round(1 - sum(k.b_ms - k.a_ms)::DOUBLE / (c.b_ms - c.a_ms), 6) AS removed_frac
FROM ch c JOIN keeps k USING (video_id, rank) GROUP BY c.video_id, c.rank, c.mode, c.a_ms, c.b_ms"""))
def kept_time(spark, sf):
    p = plans(spark, sf, "punchy")
    return p.select("video_id", "rank", "mode", "tight_ms", F.round(
        1 - F.col("tight_ms") / (F.col("b_ms") - F.col("a_ms")), 6).alias("removed_frac"))


@query("frame_snapped_keeps", with_words(LIGHT + """
, f AS (SELECT *, CAST(round(a_ms * 30000 / (1000.0 * 1001)) AS BIGINT) AS fa FROM keeps),
f2 AS (SELECT *, greatest(CAST(round(b_ms * 30000 / (1000.0 * 1001)) AS BIGINT), fa + 1) AS fb FROM f),
f3 AS (SELECT *, lag(b_ms) OVER (PARTITION BY video_id, rank ORDER BY k) AS pb, max(fb) OVER (PARTITION BY video_id, rank ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ot FROM f2),
f4 AS (SELECT *, sum(CASE WHEN (a_ms - pb) * 30000 < 1000 * 1001 OR fa <= ot THEN 0 ELSE 1 END) OVER (PARTITION BY video_id, rank ORDER BY k) AS isl FROM f3)
SELECT video_id, rank, CAST(isl - 1 AS BIGINT) AS k, min(fa) AS fa, max(fb) AS fb FROM f4 GROUP BY video_id, rank, isl"""))
def frame_snapped_keeps(spark, sf):
    return I.snap_keeps(I.keep_rows(plans(spark, sf, "light")), (30000, 1001))


@query("frame_spans", with_words(LIGHT + """
, c AS (SELECT *, CAST(round(sum(b_ms - a_ms) OVER (PARTITION BY video_id, rank ORDER BY k) * 30000 / (1000.0 * 1001)) AS BIGINT) AS stop FROM keeps),
e AS (SELECT *, stop - coalesce(max(stop) OVER (PARTITION BY video_id, rank ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS frames FROM c)
SELECT video_id, rank, k, a_ms, frames FROM e WHERE frames > 0"""))
def frame_spans(spark, sf):
    return I.frame_spans(I.keep_rows(plans(spark, sf, "light")), (30000, 1001))


OFFSETS = """
, ko AS (SELECT *, CAST(coalesce(sum(b_ms - a_ms) OVER (PARTITION BY video_id, rank ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off FROM keeps)"""


@query("retimed_words", with_words(PUNCHY + OFFSETS + """
, h AS (SELECT w.video_id, rank, pos, w, off + s_ms - a_ms AS s, off + least(e_ms, b_ms) - a_ms AS e,
   row_number() OVER (PARTITION BY w.video_id, rank, pos ORDER BY k) AS rn FROM words w JOIN ko ON ko.video_id = w.video_id AND s_ms BETWEEN a_ms AND b_ms)
SELECT video_id, rank, pos, w, s AS s_ms, e AS e_ms FROM h WHERE rn = 1 AND e - s >= 20"""))
def retimed_words(spark, sf):
    return I.retime(td.words(spark, sf), I.keep_rows(plans(spark, sf, "punchy")))


@query("tight_clock_of_sentence_ends", with_words(PUNCHY + OFFSETS + """
, h AS (SELECT w.video_id, rank, pos, off + e_ms - a_ms AS t, row_number() OVER (PARTITION BY w.video_id, rank, pos ORDER BY k) AS rn
  FROM words w JOIN ko ON ko.video_id = w.video_id AND e_ms BETWEEN a_ms AND b_ms WHERE right(w, 1) IN ('.', '!', '?', '…'))
SELECT video_id, rank, pos, t AS tight_ms FROM h WHERE rn = 1"""))
def tight_clock_of_sentence_ends(spark, sf):
    from cuewise.functions.text import ends_sentence

    ends = td.words(spark, sf).filter(ends_sentence("w"))
    return I.tight_clock(ends, I.keep_rows(plans(spark, sf, "punchy")), ["pos"], "e_ms")


@query("emphasis_on_output_clock", with_words(PUNCHY + OFFSETS + """
, wn AS (SELECT video_id, s_ms // 60000 + 1 AS rank, pos AS win, greatest(s_ms - 150, 0) AS s, e_ms + 450 AS e FROM words),
h AS (SELECT wn.*, a_ms, b_ms, off, row_number() OVER (PARTITION BY wn.video_id, wn.win ORDER BY k) AS rn FROM wn JOIN ko USING (video_id, rank) WHERE s < b_ms),
o AS (SELECT video_id, rank, win, off + greatest(s - a_ms, 0) AS os, greatest(least(e, b_ms) - greatest(s, a_ms), 0) AS len FROM h WHERE rn = 1)
SELECT video_id, rank, win, os AS out_s_ms, os + len AS out_e_ms FROM o WHERE len > 200"""))
def emphasis_on_output_clock(spark, sf):
    wins = td.words(spark, sf).select(
        "video_id", F.expr("s_ms div 60000 + 1").alias("rank"), F.col("pos").alias("win"),
        F.greatest(F.col("s_ms") - 150, F.lit(0)).alias("s_ms"), (F.col("e_ms") + 450).alias("e_ms"), "chunk")
    return I.map_forward(wins, I.keep_rows(plans(spark, sf, "punchy")))


@query("fused_ranges", """
WITH r AS (SELECT l_suppkey AS video_id, l_orderkey * 10 AS a, l_orderkey * 10 + CAST(l_quantity * 100 AS BIGINT) AS b FROM lineitem),
d AS (SELECT DISTINCT * FROM r WHERE b - a >= 500),
o AS (SELECT *, max(b) OVER (PARTITION BY video_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ot FROM d),
i AS (SELECT *, sum(CASE WHEN ot IS NULL OR a > ot + 1000 THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY a, b) AS isl FROM o)
SELECT video_id, min(a) AS a_ms, max(b) AS b_ms FROM i GROUP BY video_id, isl""")
def fused_ranges(spark, sf):
    r = td.table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("video_id"), (F.col("l_orderkey") * 10).alias("a_ms"),
        (F.col("l_orderkey") * 10 + (F.col("l_quantity") * 100).cast("long")).alias("b_ms"))
    return I.fuse_ranges(r, ["video_id"])


# Order lines as scored picks of an order.
PICKS_SQL = """
picks AS (SELECT l_orderkey AS video_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS rank,
  l_linenumber * 20000 AS start_ms, l_linenumber * 20000 + CAST(l_quantity * 1000 AS BIGINT) AS end_ms,
  round(l_discount * 100) AS score_total, l_returnflag || l_linestatus AS hook, ['#' || l_returnflag, '#s' || (l_suppkey % 5)] AS hashtags FROM lineitem)"""


def picks(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    start = (F.col("l_linenumber") * 20000).cast("long")
    return td.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("video_id"), F.row_number().over(w).cast("long").alias("rank"), start.alias("start_ms"),
        (start + (F.col("l_quantity") * 1000).cast("long")).alias("end_ms"), F.round(F.col("l_discount") * 100).alias("score_total"),
        F.concat("l_returnflag", "l_linestatus").alias("hook"),
        F.array(F.concat(F.lit("#"), F.col("l_returnflag")), F.concat(F.lit("#s"), F.col("l_suppkey") % 5)).alias("hashtags"))


CAPPED = PICKS_SQL + """,
cs AS (SELECT *, sum(end_ms - start_ms) OVER (PARTITION BY video_id ORDER BY score_total DESC, start_ms DESC, rank DESC) AS rest,
   row_number() OVER (PARTITION BY video_id ORDER BY score_total DESC, start_ms DESC, rank DESC) AS rn FROM picks),
capped AS (SELECT * FROM cs WHERE rest <= 90000 OR rn = 1)"""


@query("score_capped_picks", f"WITH {CAPPED} SELECT video_id, rank, start_ms, end_ms FROM capped")
def score_capped_picks(spark, sf):
    return I.cap_by_score(picks(spark, sf), ["video_id"], 90_000).select("video_id", "rank", "start_ms", "end_ms")


@query("tail_capped_ranges", f"""WITH {PICKS_SQL}, t AS (SELECT *, sum(end_ms - start_ms) OVER (PARTITION BY video_id ORDER BY rank) AS sm FROM picks)
SELECT video_id, rank, start_ms AS a_ms, end_ms AS b_ms FROM t WHERE sm <= 90000 OR rank = 1""")
def tail_capped_ranges(spark, sf):
    r = picks(spark, sf).select("video_id", "rank", F.col("start_ms").alias("a_ms"), F.col("end_ms").alias("b_ms"))
    return I.cap_by_tail(r, ["video_id"], "rank", 90_000)


@query("compilations", f"""WITH {CAPPED},
tg AS (SELECT video_id, unnest(hashtags) AS h, unnest([0, 1]) AS i, start_ms, rank FROM capped),
td AS (SELECT video_id, h, min((start_ms, rank, i)) AS o FROM tg GROUP BY 1, 2),
ta AS (SELECT video_id, array_to_string(list_slice(list(h ORDER BY o), 1, 8), ' ') AS tags FROM td GROUP BY 1)
SELECT c.video_id, arg_max(hook, (score_total, start_ms, rank)) AS hook, round(avg(score_total), 6) AS score_total, tags,
  min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n FROM capped c JOIN ta USING (video_id) GROUP BY c.video_id, tags""")
def compilations(spark, sf):
    kept = I.cap_by_score(picks(spark, sf), ["video_id"], 90_000)
    return I.compilation(kept, ["video_id"]).select(
        "video_id", "hook", F.round("score_total", 6).alias("score_total"),
        F.array_join("hashtags", " ").alias("tags"), "start_ms", "end_ms", "n")
