"""Candidates, validation, the flagship clips query."""

from pyspark.sql import functions as F

from cuewise.catalog.registry import query
from cuewise.catalog.sql import with_sentences, with_words
from cuewise.functions.fixed_values import AUTO_KEEP_SCORE, HOOK_FILLERS
from cuewise.catalog.sql import clean
from cuewise.operators import candidates as C
from cuewise.operators import validate as V
from cuewise.sources import testdata as td

COUNT = 5

TOP = f"""
, nn AS (SELECT video_id, count(*) AS n, max(e_ms) AS dur FROM words GROUP BY 1),
top AS (SELECT *, rn - 1 AS cand, sent_start AS a, sent_start + n_words AS b FROM (
  SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, sent_start) AS rn FROM scored)
  WHERE rn <= {3 * COUNT})"""
PROPOSE = TOP + """
, g0 AS (SELECT t.*, n, least(greatest(n_words * 3, 8), 60) - n_words AS d, n - b AS r FROM top t JOIN nn USING (video_id)),
g1 AS (SELECT *, CASE WHEN r >= d // 2 THEN least(a, d - d // 2) ELSE least(a, r + 1) END AS lft,
  CASE WHEN r >= d // 2 THEN least(r, greatest(d // 2, d - a)) ELSE r END AS rgt FROM g0),
g2 AS (SELECT g.video_id, g.cand, g.score, g.text, x.s_ms AS s, y.e_ms AS e, z.e_ms AS em FROM g1 g
  JOIN words x ON x.video_id = g.video_id AND x.pos = a - lft
  JOIN words y ON y.video_id = g.video_id AND y.pos = b + rgt - 1
  LEFT JOIN words z ON z.video_id = g.video_id AND z.pos = b + rgt),
g3 AS (SELECT video_id, cand, score, text, s, CASE WHEN e - s < 8000 THEN coalesce(em, e) ELSE e END AS e FROM g2),
cands AS (SELECT video_id, cand, s AS start_ms, CASE WHEN e - s > 65000 THEN s + 45000 ELSE e END AS end_ms,
  left(text, 200) AS hook, score AS h, score - 5 AS rt, score - 8 AS vl, score - 10 AS sh FROM g3)"""


@query("heuristic_candidates", with_sentences(
    PROPOSE + " SELECT video_id, cand, start_ms, end_ms, hook, h AS score FROM cands"))
def heuristic_candidates(spark, sf):
    return C.propose(td.words(spark, sf), COUNT).select(
        "video_id", "cand", "start_ms", "end_ms", "hook", F.col("scores.hook").alias("score"))


COMPLETE = TOP + """
, si AS (SELECT t.video_id, t.cand, t.sent_start AS i, t.s_ms AS s_i FROM top t),
f AS (SELECT si.*, arg_min(x.e_ms, x.sent_start) FILTER (x.e_ms >= s_i + 20000) AS f_e,
   min(x.sent_start) FILTER (x.e_ms >= s_i + 20000) AS f_i,
   max(x.e_ms) AS m_e, max(x.sent_start) AS m_i
  FROM si JOIN scored x ON x.video_id = si.video_id AND x.sent_start >= i AND (x.e_ms <= s_i + 120000 OR x.sent_start = i)
  GROUP BY ALL),
fw AS (SELECT video_id, cand, i, s_i, coalesce(f_i, m_i) AS b, coalesce(f_e, m_e) AS e_b FROM f),
bk AS (SELECT fw.video_id, fw.cand, coalesce(max(x.sent_start) FILTER (x.s_ms <= e_b - 20000), min(x.sent_start)) AS a
  FROM fw JOIN scored x ON x.video_id = fw.video_id AND x.sent_start <= i AND (x.s_ms >= e_b - 120000 OR x.sent_start = i)
  WHERE e_b - s_i < 20000 GROUP BY 1, 2),
sp AS (SELECT fw.video_id, fw.cand, coalesce(bk.a, i) AS a, b, e_b FROM fw LEFT JOIN bk USING (video_id, cand)),
ct AS (SELECT sp.video_id, sp.cand, min(x.s_ms) AS start_ms, e_b AS end_ms, string_agg(x.text, ' ' ORDER BY x.sent_start) AS full_text,
   arg_min(x.text, x.sent_start) AS hook
  FROM sp JOIN scored x ON x.video_id = sp.video_id AND x.sent_start BETWEEN sp.a AND sp.b GROUP BY 1, 2, e_b)
SELECT video_id, cand, start_ms, end_ms, left(hook, 200) AS hook,
 CAST(least(92, 55 + CASE WHEN contains(full_text, '?') THEN 12 ELSE 0 END + CASE WHEN contains(full_text, '!') THEN 6 ELSE 0 END
   + CASE WHEN regexp_matches(full_text, '[0-9]') THEN 6 ELSE 0 END
   + CASE WHEN len(list_filter(string_split_regex(full_text, '\\s+'), lambda t: t <> '')) BETWEEN 8 AND 25 THEN 6 ELSE 0 END) AS INT) AS score
FROM ct WHERE end_ms - start_ms >= 8000"""


@query("complete_candidates", with_sentences(COMPLETE))
def complete_candidates(spark, sf):
    return C.propose_complete(td.words(spark, sf), COUNT).select(
        "video_id", "cand", "start_ms", "end_ms", "hook", F.col("scores.hook").alias("score"))


@query("seeded_moments")
def seeded_moments(spark, sf):
    return C.propose_moments(td.words(spark, sf), 3, 42).select("video_id", "cand", "start_ms", "end_ms", "hook", "why")


@query("timecut_candidates", with_words("""
, d AS (SELECT video_id, max(e_ms) AS dur FROM words GROUP BY 1),
p AS (SELECT video_id, dur, n, unnest(range(0, n)) AS part FROM (
  SELECT *, CAST(greatest(ceil(dur / 45000.0), 1) AS BIGINT) AS n FROM d WHERE dur >= 5000)),
q AS (SELECT *, part * 45000 AS a, least(part * 45000 + 45000, dur) AS b FROM p),
h AS (SELECT q.video_id, q.part, array_to_string(list_slice(list(w ORDER BY pos), 1, 14), ' ') AS hook FROM q JOIN words x
  ON x.video_id = q.video_id AND x.s_ms >= q.a AND x.s_ms < q.a + 8000 GROUP BY 1, 2)
SELECT q.video_id, q.part AS cand, a AS start_ms, b AS end_ms, left(coalesce(hook, 'Part ' || (q.part + 1)), 200) AS hook,
  'Uniform timecut part ' || (q.part + 1) || '/' || n || ' (45s).' AS why
FROM q LEFT JOIN h USING (video_id, part) WHERE b - a >= 5000"""))
def timecut_candidates(spark, sf):
    w = td.words(spark, sf)
    spans = td.durations(w).select("video_id", F.lit(0).cast("long").alias("a_ms"), F.col("duration_ms").alias("b_ms"))
    return C.propose_timecut(w, spans, 45_000).select("video_id", "cand", "start_ms", "end_ms", "hook", "why")


@query("focus_bumped_candidates", with_sentences(PROPOSE + r"""
, tx AS (SELECT c.video_id, c.cand, unnest(string_split_regex(lower(string_agg(w, ' ' ORDER BY pos)), '[^\p{L}\p{N}]+')) AS t
  FROM cands c JOIN words x ON x.video_id = c.video_id AND x.s_ms >= c.start_ms - 50 AND x.e_ms <= c.end_ms + 50 GROUP BY 1, 2),
hit AS (SELECT DISTINCT video_id, cand FROM tx WHERE starts_with(t, 'thation') OR starts_with(t, 'ouest'))
SELECT c.video_id, c.cand, hit.cand IS NOT NULL AS on_topic,
  CAST(CASE WHEN hit.cand IS NULL THEN h ELSE least(h + 15, 100) END AS INT) AS hook_score
FROM cands c LEFT JOIN hit USING (video_id, cand)"""))
def focus_bumped_candidates(spark, sf):
    w = td.words(spark, sf)
    return C.apply_focus(C.propose(w, COUNT), w, ["thation", "ouest"]).select(
        "video_id", "cand", "on_topic", F.col("scores.hook").alias("hook_score"))


FILLER_LIST = ", ".join(f"'{w}'" for w in HOOK_FILLERS)
VALIDATE = PROPOSE + rf"""
, wx AS (SELECT *, right(w, 1) IN ('.', '!', '?', '…') AS ends, {clean('w')} IN ({FILLER_LIST}) AS filler FROM words),
v0 AS (SELECT c.*, dur, least(greatest(start_ms, 0), dur) AS s0, least(greatest(end_ms, 0), dur) AS e0 FROM cands c JOIN nn USING (video_id)),
v1 AS (SELECT v.video_id, v.cand, v.dur,
   arg_min(x.s_ms, abs(x.s_ms - greatest(s0 - 250, 0)) * 1000000 + x.pos) AS s1,
   arg_min(x.e_ms, abs(x.e_ms - least(e0 + 250, dur)) * 1000000 + x.pos) AS e1
  FROM v0 v JOIN wx x ON x.video_id = v.video_id WHERE e0 > s0 GROUP BY 1, 2, 3),
v2 AS (SELECT v.video_id, v.cand, v.dur, s1, e1,
   arg_min(x.e_ms, x.pos) FILTER (x.ends AND x.e_ms >= e1) AS se,
   arg_max(x.e_ms, x.pos) FILTER (x.ends AND x.s_ms <= e1) AS sb,
   arg_max(x.e_ms, x.pos) FILTER (x.ends AND x.s_ms <= s1 - 10) AS pe
  FROM v1 v JOIN wx x ON x.video_id = v.video_id GROUP BY 1, 2, 3, 4, 5),
v3 AS (SELECT *, CASE WHEN se IS NOT NULL AND se <= e1 + 30000 AND se - s1 <= 120000 THEN se
    WHEN sb IS NOT NULL AND sb - s1 >= 15000 THEN sb ELSE e1 END AS e2 FROM v2),
v4 AS (SELECT v.video_id, v.cand, v.dur, s1, e2, arg_min(x.s_ms, x.pos) FILTER (x.s_ms >= pe) AS ws
  FROM v3 v JOIN wx x ON x.video_id = v.video_id GROUP BY 1, 2, 3, 4, 5),
v5 AS (SELECT video_id, cand, dur, e2, CASE WHEN ws IS NOT NULL AND s1 - ws <= 2000 AND ws < e2 THEN ws ELSE s1 END AS s2 FROM v4),
v6 AS (SELECT v.video_id, v.cand, v.dur, e2, s2, min(x.pos) FILTER (x.e_ms >= s2 AND x.s_ms < e2) AS i
  FROM v5 v JOIN wx x ON x.video_id = v.video_id GROUP BY 1, 2, 3, 4, 5),
v7 AS (SELECT v.video_id, v.cand, v.dur, e2, s2, i,
   min(x.pos) FILTER (x.pos >= i AND (NOT x.filler OR x.s_ms >= least(e2, s2 + 4000))) AS j
  FROM v6 v JOIN wx x ON x.video_id = v.video_id GROUP BY 1, 2, 3, 4, 5, 6),
v8 AS (SELECT v.video_id, v.cand, v.dur, e2, CASE WHEN j > i AND x.s_ms < e2 THEN x.s_ms ELSE s2 END AS s3
  FROM v7 v LEFT JOIN wx x ON x.video_id = v.video_id AND x.pos = v.j),
v9 AS (SELECT v.video_id, v.cand, v.dur, e2, s3, least(coalesce(min(x.e_ms) FILTER (x.e_ms >= s3 + 15000), dur), dur) AS ge
  FROM v8 v JOIN wx x ON x.video_id = v.video_id GROUP BY 1, 2, 3, 4, 5),
v10 AS (SELECT *, e2 - s3 < 15000 AS small FROM v9),
v11 AS (SELECT video_id, cand, CASE WHEN small THEN ge ELSE e2 END AS e3,
   CASE WHEN small AND ge - s3 < 15000 THEN greatest(ge - 15000, 0) ELSE s3 END AS s4, small FROM v10),
v12 AS (SELECT * FROM v11 WHERE NOT (small AND e3 - s4 < 15000)),
v13 AS (SELECT v.video_id, v.cand, s4, e3,
   max(x.e_ms) FILTER (x.e_ms <= s4 + 90000 AND x.e_ms > s4) AS wd,
   max(x.e_ms) FILTER (x.e_ms <= s4 + 90000 AND x.e_ms > s4 AND x.ends AND x.e_ms >= s4 + 85000) AS st
  FROM v12 v JOIN wx x ON x.video_id = v.video_id GROUP BY 1, 2, 3, 4),
valid AS (SELECT v.video_id, v.cand, (s4 + 5) // 10 * 10 AS start_ms,
   (CASE WHEN e3 - s4 > 90000 THEN CASE WHEN st IS NOT NULL THEN st WHEN wd IS NOT NULL AND wd - s4 >= 15000 THEN wd ELSE s4 + 90000 END ELSE e3 END + 5) // 10 * 10 AS end_ms,
   hook, .4 * h + .25 * rt + .2 * vl + .15 * sh AS score_total FROM v13 v JOIN cands USING (video_id, cand))"""
GREEDY = VALIDATE + rf"""
, rk AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY score_total DESC, cand) AS rn,
   list_distinct(list_filter(string_split_regex(hook, '\s+'), lambda t: t <> '')) AS hs FROM valid),
step AS (
  SELECT video_id, rn, [struct_pack(cand := cand, a := start_ms, b := end_ms, hs := hs)] AS kept FROM rk WHERE rn = 1
  UNION ALL
  SELECT r.video_id, r.rn, CASE WHEN len(kept) >= {COUNT} OR len(list_filter(kept, lambda k:
      greatest(least(k.b, r.end_ms) - greatest(k.a, r.start_ms), 0) / greatest(least(k.b - k.a, r.end_ms - r.start_ms), 1000)::DOUBLE > 0.5
      OR (CASE WHEN len(r.hs) + len(k.hs) = 0 THEN 1.0 ELSE len(list_intersect(r.hs, k.hs))::DOUBLE / len(list_distinct(list_concat(r.hs, k.hs))) END) > 0.8)) > 0
    THEN kept ELSE list_append(kept, struct_pack(cand := r.cand, a := r.start_ms, b := r.end_ms, hs := r.hs)) END
  FROM step s JOIN rk r ON r.video_id = s.video_id AND r.rn = s.rn + 1),
fin AS (SELECT video_id, arg_max(kept, rn) AS kept FROM step GROUP BY 1),
kp AS (SELECT video_id, unnest(kept) AS k, unnest(range(1, len(kept) + 1)) AS rank FROM fin),
clips AS (SELECT v.video_id, kp.rank, v.cand, v.start_ms, v.end_ms, v.hook, round(v.score_total, 6) AS score_total
  FROM kp JOIN valid v ON v.video_id = kp.video_id AND v.cand = kp.k.cand)"""


def with_clips(body):
    return "WITH RECURSIVE " + with_sentences(GREEDY + body)[len("WITH "):]


def heuristic_clips(spark, sf):
    w = td.words(spark, sf)
    return V.normalize(C.propose(w, COUNT), w, td.durations(w), COUNT)


@query("validated_candidates", with_sentences(VALIDATE + """
 SELECT video_id, cand, start_ms, end_ms, round(score_total, 6) AS score_total FROM valid"""))
def validated_candidates(spark, sf):
    w = td.words(spark, sf)
    return V.validate(C.propose(w, COUNT), w, td.durations(w)).select(
        "video_id", "cand", "start_ms", "end_ms", F.round("score_total", 6).alias("score_total"))


@query("clips", with_clips(" SELECT video_id, rank, cand, start_ms, end_ms, hook, score_total FROM clips"))
def clips(spark, sf):
    return heuristic_clips(spark, sf).select(
        "video_id", "rank", "cand", "start_ms", "end_ms", "hook", F.round("score_total", 6).alias("score_total"))


@query("merit_clips", with_clips(f"""
, mk AS (SELECT * FROM clips WHERE score_total >= {AUTO_KEEP_SCORE} OR rank = 1)
SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY rank) AS rank, start_ms, end_ms FROM mk"""))
def merit_clips(spark, sf):
    return V.merit_keep(heuristic_clips(spark, sf), AUTO_KEEP_SCORE).select("video_id", "rank", "start_ms", "end_ms")
