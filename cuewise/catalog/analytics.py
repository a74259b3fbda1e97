"""Energy, loudness, judge and job queries."""

from pyspark.sql import functions as F

from cuewise.catalog.clips import COUNT, PROPOSE
from cuewise.catalog.detection import FLAGS, flags, r6
from cuewise.catalog.registry import query
from cuewise.catalog.sql import DETECTIONS, JOB_EVENTS, rec, with_sentences, with_words
from cuewise.operators import candidates as C
from cuewise.operators import jobs as J
from cuewise.operators import judge as Q
from cuewise.operators import series as S
from cuewise.sources import testdata as td

ENERGY = """
, ew AS (SELECT *, lead(s_ms) OVER (PARTITION BY video_id ORDER BY pos) AS ns FROM words),
energy AS (SELECT video_id, unnest(range(s_ms // 10, e_ms // 10)) AS hop, 0.01::DOUBLE * (1 + pos % 7) AS ms FROM ew
 UNION ALL SELECT video_id, unnest(range(e_ms // 10, ns // 10)), 1e-9::DOUBLE FROM ew WHERE ns > e_ms)"""
DB = "greatest(10.0::DOUBLE * log10({} + 1e-10::DOUBLE), -100.0)"
LOUD = ENERGY + f""", lo AS (SELECT video_id, hop, avg(ms) OVER (PARTITION BY video_id ORDER BY hop ROWS BETWEEN 20 PRECEDING AND 19 FOLLOWING) AS m, count(*) OVER (PARTITION BY video_id) AS n FROM energy),
loudness AS (SELECT video_id, hop // 10 - 2 AS i, hop * 10 AS t_ms, {DB.format('m')} AS db FROM lo WHERE hop % 10 = 0 AND hop >= 20 AND hop <= n - 20)"""


@query("word_levels", with_words(ENERGY + f""", r AS (SELECT w.video_id, pos, least(s_ms // 10, n - 1) AS i, least(e_ms // 10, n - 1) AS j FROM words w JOIN (SELECT video_id, max(hop) + 1 AS n FROM energy GROUP BY 1) USING (video_id))
SELECT r.video_id, pos, round({DB.format('avg(ms)')}, 6) AS db FROM r JOIN energy e ON e.video_id = r.video_id AND e.hop BETWEEN i AND greatest(j, i + 1) - 1 GROUP BY 1, 2"""))
def word_levels(spark, sf):
    w = td.words(spark, sf).select("video_id", "pos", "chunk", F.col("s_ms").alias("a_ms"), F.col("e_ms").alias("b_ms"))
    return S.range_level(w, td.energy_runs(spark, sf), ["pos"]).select("video_id", "pos", r6("db").alias("db"))


@query("loudness", with_words(LOUD + " SELECT video_id, i, t_ms, round(db, 6) AS db FROM loudness"))
def loudness(spark, sf):
    return S.loudness(td.energy_runs(spark, sf)).withColumn("db", r6("db"))


@query("smoothed_loudness", with_words(LOUD + " SELECT video_id, i, round(avg(db) OVER (PARTITION BY video_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS sm FROM loudness"))
def smoothed_loudness(spark, sf):
    return S.smoothed_loudness(td.energy_runs(spark, sf)).select("video_id", "i", r6("sm").alias("sm"))


# Levels rounded to 1e-6 dB before comparing, so both engines see the same ties.
PEAKS = LOUD + """, s1 AS (SELECT video_id, i, t_ms, round(avg(db) OVER (PARTITION BY video_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS sm FROM loudness),
s2 AS (SELECT *, max(sm) OVER (PARTITION BY video_id ORDER BY i ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS pk, list_sort(list(sm) OVER (PARTITION BY video_id ORDER BY i ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING)) AS ar FROM s1),
s3 AS (SELECT video_id, i, t_ms, sm FROM s2 WHERE sm = pk AND sm > -60 AND sm - ar[len(ar) // 2 + 1] >= 3)"""


SPACED = PEAKS + """, rk AS (SELECT video_id, i, t_ms, sm, row_number() OVER (PARTITION BY video_id ORDER BY sm DESC, i) AS n FROM s3 JOIN (SELECT video_id FROM loudness GROUP BY 1 HAVING count(*) >= 10) USING (video_id)),
st AS (SELECT video_id, n, [t_ms] AS kept FROM rk WHERE n = 1 UNION ALL
 SELECT r.video_id, r.n, CASE WHEN len(list_filter(s.kept, lambda k: abs(k - r.t_ms) < 4000)) = 0 THEN list_append(s.kept, r.t_ms) ELSE s.kept END FROM st s JOIN rk r ON r.video_id = s.video_id AND r.n = s.n + 1),
fn AS (SELECT video_id, unnest(arg_max(kept, n)) AS t_ms FROM st GROUP BY 1)"""


@query("emphasis_peaks", rec(with_words(SPACED + " SELECT rk.video_id, rk.i, rk.t_ms, rk.sm FROM fn JOIN rk USING (video_id, t_ms)")))
def emphasis_peaks(spark, sf):
    return S.energy_peaks(td.energy_runs(spark, sf), 3.0).withColumn("sm", r6("sm"))


@query("punch_windows")
def punch_windows(spark, sf):
    p = S.energy_peaks(td.energy_runs(spark, sf), 3.0)
    return S.punch_windows(p, td.words(spark, sf), None, 5)


@query("quiet_points", with_words(ENERGY + f""", q AS (SELECT video_id, hop, {DB.format('avg(ms) OVER w')} AS db, count(*) OVER w AS c FROM energy WINDOW w AS (PARTITION BY video_id ORDER BY hop ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)),
n AS (SELECT video_id, max(hop) + 1 AS n FROM energy GROUP BY 1),
s AS (SELECT w.video_id, pos, s_ms - 60 AS a, s_ms + 40 AS b, s_ms AS p, least((s_ms - 60) // 10, n - 1) AS i, least((s_ms + 40) // 10, n - 1) - 2 AS j FROM words w JOIN n USING (video_id) WHERE pos > 0),
sh AS (SELECT video_id, pos, p, unnest(range(i, j + 1)) AS hop FROM s),
h AS (SELECT sh.*, db, min(db) OVER (PARTITION BY sh.video_id, pos) AS fl FROM sh JOIN q ON q.video_id = sh.video_id AND q.hop = sh.hop WHERE c = 3),
x AS (SELECT video_id, pos, arg_min(hop * 10 + 15, (abs(hop * 10 + 15 - p), hop)) AS qa FROM h WHERE db <= fl + 1.5 GROUP BY 1, 2)
SELECT s.video_id, s.pos, least(greatest(coalesce(qa, p), a), b) AS quiet_ms FROM s LEFT JOIN x USING (video_id, pos)"""))
def quiet_points(spark, sf):
    w = td.words(spark, sf).filter("pos > 0")
    spans = w.select("video_id", "pos", (F.col("s_ms") - 60).alias("a_ms"), (F.col("s_ms") + 40).alias("b_ms"), F.col("s_ms").alias("pref_ms"), "chunk")
    return S.quietest(spans, td.energy_runs(spark, sf), ["pos"])


@query("ema_crop", """
WITH RECURSIVE s AS (SELECT o_orderkey // 1000 AS video_id, o_orderkey % 1000 AS i, floor(o_totalprice)::DOUBLE AS x FROM orders),
k AS (SELECT video_id, i, row_number() OVER (PARTITION BY video_id ORDER BY i) - 1 AS n, x FROM s),
e AS (SELECT video_id, n, x AS a FROM k WHERE n = 0 UNION ALL SELECT k.video_id, k.n, 0.15::DOUBLE * k.x + 0.85::DOUBLE * e.a FROM e JOIN k ON k.video_id = e.video_id AND k.n = e.n + 1)
SELECT video_id, n AS i, round(a, 4) AS smoothed FROM e""")
def ema_crop(spark, sf):
    from cuewise.operators.scan import Scan, chunk_of, running

    s = td.table(spark, sf, "orders").select(F.expr("o_orderkey div 1000").alias("video_id"), F.col("o_orderkey").alias("k"), F.floor("o_totalprice").cast("double").alias("x"))
    s = running(s, ["video_id"], ["k"], chunk_of("k", 4096), {"i": Scan("sum", F.lit(1).cast("long"))})
    return S.exponential(s.select("video_id", "i", "x"), "x", 0.15).withColumn("smoothed", F.round("smoothed", 4))


@query("group_hysteresis", f"""WITH RECURSIVE {DETECTIONS}, {FLAGS}, k AS (SELECT video_id, i, face, row_number() OVER (PARTITION BY video_id ORDER BY i) AS n FROM fl),
h AS (SELECT video_id, n, i, face::INT AS yes, (NOT face)::INT AS no, false AS "on", false AS edge FROM k WHERE n = 1
 UNION ALL SELECT video_id, n, i, y, z, nw, nw <> "on" FROM (SELECT k.video_id, k.n, k.i, h."on", CASE WHEN k.face THEN h.yes + 1 ELSE 0 END AS y, CASE WHEN k.face THEN 0 ELSE h.no + 1 END AS z,
   (h."on" OR (k.face AND h.yes + 1 >= 4)) AND NOT (h."on" AND NOT k.face AND h.no + 1 >= 8) AS nw FROM h JOIN k ON k.video_id = h.video_id AND k.n = h.n + 1))
SELECT video_id, i, "on", edge FROM h""")
def group_hysteresis(spark, sf):
    return S.hysteresis(flags(spark, sf))


LOGIT = """lg AS (SELECT vec_id AS cand, label, unnest(range(0, 64)) AS k, exp(unnest(embedding)::DOUBLE / (0.5::DOUBLE + 0.1 * label)) AS e FROM embeddings),
pr AS (SELECT cand, label, k, e / sum(e) OVER (PARTITION BY cand) AS p FROM lg)"""


@query("judge_answers", f"""WITH {LOGIT} SELECT cand, CAST(arg_max(k, (p, k)) AS INT) AS choice, round(sum(k * p), 6) AS level, round(max(CASE WHEN k = 1 THEN p END), 6) AS p_true,
 round(1 + sum(p * ln(p)) / ln(64), 6) AS confidence FROM pr GROUP BY cand""")
def judge_answers(spark, sf):
    p = td.logits(spark, sf).withColumn("p", Q.softmax("z", "temp"))
    return p.select("cand", Q.choice("p").alias("choice"), r6(Q.expected_level("p")).alias("level"), r6(F.get("p", F.lit(1))).alias("p_true"), r6(Q.confidence("p")).alias("confidence"))


NAMES = ["hook", "standalone", "complete", "value", "share"]
VERDICT = LOGIT + """, an AS (SELECT cand // 5 AS c, ['hook','standalone','complete','value','share'][cand % 5 + 1] AS name, sum(k * p) / 63 AS lv, max(CASE WHEN k = 1 THEN p END) AS pt FROM pr WHERE cand % 11 <> 3 GROUP BY cand),
vd AS (SELECT c AS cand, coalesce(max(lv) FILTER (name = 'hook'), 0.5) AS hook, coalesce(max(pt) FILTER (name = 'standalone'), 0.5) AS standalone, coalesce(max(pt) FILTER (name = 'complete'), 0.5) AS complete,
  coalesce(max(lv) FILTER (name = 'value'), 0.5) AS value, coalesce(max(pt) FILTER (name = 'share'), 0.5) AS share FROM an GROUP BY c)"""


def verdict_rows(spark, sf):
    p = td.logits(spark, sf).withColumn("p", Q.softmax("z", "temp")).filter("cand % 11 <> 3")
    name = F.element_at(F.array(*[F.lit(n) for n in NAMES]), (F.col("cand") % 5 + 1).cast("int"))
    p = p.select(F.expr("cand div 5").alias("cand"), name.alias("name"), "p").withColumn("kind", F.when(F.col("name").isin("hook", "value"), "score").otherwise("yes_no"))
    return Q.verdicts(p, ["cand"])


@query("verdicts", f"WITH {VERDICT} SELECT cand, round(hook, 6) AS hook, round(standalone, 6) AS standalone, round(complete, 6) AS complete, round(value, 6) AS value, round(share, 6) AS share FROM vd")
def verdicts(spark, sf):
    return verdict_rows(spark, sf).select("cand", *[r6(n).alias(n) for n in NAMES])


def pct(x):
    return f"CAST(least(greatest(round(({x}) * 100), 1), 100) AS INT)"


@query("verdict_scorecards", f"""WITH {VERDICT} SELECT cand, {pct('hook')} AS hook, {pct('0.5::DOUBLE * standalone + 0.5 * complete')} AS retention, {pct('value')} AS value, {pct('share')} AS share,
 CAST(round((70 + {pct('hook')}) / 2.0) AS INT) AS blended_hook FROM vd""")
def verdict_scorecards(spark, sf):
    model = F.struct(F.lit(7).alias("hook"), F.lit(50).alias("retention"), F.lit(9).alias("value"), F.lit(10).alias("share"))
    v = verdict_rows(spark, sf).withColumn("s", Q.verdict_scores()).withColumn("m", model)
    return v.select("cand", "s.*", Q.blend("m", "s")["hook"].alias("blended_hook"))


@query("verdict_reasons", f"""WITH {VERDICT}, l AS (SELECT cand, unnest([hook, value, standalone, complete, share]) AS v, unnest(range(0, 5)) AS i,
  unnest(['strong opening hook','clear payoff','stands on its own','ends on a finished thought','likely to be shared']) AS y, unnest(['slow opening','light payoff','needs context','ends mid-point','low share pull']) AS n FROM vd),
g AS (SELECT cand, string_agg(CASE WHEN r <= 3 AND v >= 0.6 THEN y || ' (' || CAST(round(v * 100) AS BIGINT) || '%)' END, ', ' ORDER BY r) AS good, string_agg(CASE WHEN v < 0.35 THEN n END, ', ' ORDER BY i) AS weak
  FROM (SELECT *, row_number() OVER (PARTITION BY cand ORDER BY v DESC, i) AS r FROM l) GROUP BY 1)
SELECT cand, coalesce(upper(left(good, 1)) || substr(good, 2), 'No standout strengths') || coalesce('; watch for: ' || weak, '') || '. Judged by tests.' AS why FROM g""")
def verdict_reasons(spark, sf):
    return verdict_rows(spark, sf).select("cand", Q.why("tests").alias("why"))


@query("judge_texts", with_sentences(PROPOSE + """
, t AS (SELECT c.video_id, c.cand, string_agg(trim(w), ' ' ORDER BY pos) AS t FROM cands c JOIN words x ON x.video_id = c.video_id AND x.s_ms >= c.start_ms - 50 AND x.e_ms <= c.end_ms + 50 GROUP BY 1, 2)
SELECT c.video_id, c.cand, 'Short video clip, ' || ((end_ms - start_ms + 500) // 1000) || ' seconds. Transcript: ' || coalesce(t, '') AS state FROM cands c LEFT JOIN t USING (video_id, cand)"""))
def judge_texts(spark, sf):
    w = td.words(spark, sf)
    return Q.judge_texts(C.propose(w, COUNT), w)


@query("judged_candidates")
def judged_candidates(spark, sf):
    """Candidates judged by a stand-in whose answers depend on the text's hash."""
    w = td.words(spark, sf)

    def ask(state):
        part = lambda k: (F.pmod(F.xxhash64(state, F.lit(k)), F.lit(1000)) / 1000).alias(k)
        return F.struct(*[part(n) for n in NAMES])

    return Q.judge(C.propose(w, COUNT), w, ask, "tests").select("video_id", "cand", "scores.*", "why")


@query("changed_percents", f"""WITH {JOB_EVENTS}, p AS (SELECT *, lag(pct) OVER (PARTITION BY job, rank, type ORDER BY event_id) AS was FROM job_events WHERE type IN ('clip_track', 'clip_render'))
SELECT job, rank, type, event_id, pct FROM p WHERE was IS NULL OR was <> pct""")
def changed_percents(spark, sf):
    e = td.job_events(spark, sf).filter(F.col("type").isin("clip_track", "clip_render"))
    return J.changed_percents(e, ["job", "rank", "type"], "event_id", F.expr("event_id div 1000000")).select("job", "rank", "type", "event_id", "pct")


CLIP_STATES = JOB_EVENTS + """, bo AS (SELECT job, rank, max(CASE WHEN type = 'clips_picked' THEN event_id END) AS rs, max(CASE WHEN type = 'clip_done' THEN event_id END) AS dn, sum(CASE WHEN type = 'clip_done' THEN 1 ELSE 0 END) AS rev
   FROM job_events WHERE type IN ('clips_picked', 'clip_done') GROUP BY 1, 2),
bs AS (SELECT *, greatest(coalesce(rs, -1), coalesce(dn, -1)) AS base FROM bo),
la AS (SELECT b.job, b.rank, arg_max(pct, event_id) FILTER (type = 'clip_track') AS t, arg_max(pct, event_id) FILTER (type = 'clip_render') AS r FROM bs b JOIN job_events e ON e.job = b.job AND e.rank = b.rank AND e.event_id > base AND type IN ('clip_track', 'clip_render') GROUP BY 1, 2),
clip_states AS (SELECT job, rank, CAST(rev AS BIGINT) AS rev, coalesce(t, CASE WHEN dn = base THEN 100 ELSE 0 END) AS track_pct, coalesce(r, CASE WHEN dn = base THEN 100 ELSE 0 END) AS render_pct,
  CASE WHEN dn = base THEN 'done' WHEN t IS NOT NULL OR r IS NOT NULL THEN 'rendering' ELSE 'pending' END AS render_status FROM bs LEFT JOIN la USING (job, rank)),
jobs AS (SELECT job, coalesce(arg_max(CASE type WHEN 'clips_picked' THEN 'clips_ready' ELSE 'failed' END, event_id) FILTER (type IN ('clips_picked', 'job_failed')), 'queued') AS status, min(ts) AS created, count(*) AS events FROM job_events GROUP BY 1)"""


@query("clip_states", f"WITH {CLIP_STATES} SELECT * FROM clip_states")
def clip_states(spark, sf):
    return J.clip_states(td.job_events(spark, sf))


RECORDS = """
re AS (SELECT user_id AS job, event_id, CASE event_type WHEN 'view' THEN CASE WHEN event_id % 3 = 0 THEN 'stage' ELSE 'clip_track' END
    WHEN 'click' THEN CASE WHEN event_id % 4 = 0 THEN 'clip_variant' ELSE 'clip_render' END WHEN 'signup' THEN 'clips_picked' WHEN 'purchase' THEN 'clip_done'
    ELSE CASE WHEN event_id % 2 = 0 THEN 'job_done' ELSE 'job_failed' END END AS type,
  ['download', 'audio', 'transcribe', 'pick', 'track', 'render', 'merge', 'kit', 'done'][event_id // 3 % 9 + 1] AS stage, range(1, 2 + event_id % 4) AS ranks,
  event_id % 3 = 1 AS redo, event_id % 3 + 1 AS rank, CAST(floor(value) AS BIGINT) % 101 AS pct, ['9:16', '1:1', '16:9'][event_id // 4 % 3 + 1] AS aspect, 'v' || event_id AS file FROM events),
picks AS (SELECT * FROM re WHERE type = 'clips_picked'), dones AS (SELECT * FROM re WHERE type = 'clip_done'),
jr AS (SELECT DISTINCT job, unnest(ranks) AS rank FROM picks UNION SELECT job, rank FROM dones),
base AS (SELECT jr.job, jr.rank, coalesce(max(p.event_id), -1) AS v FROM jr LEFT JOIN picks p ON p.job = jr.job AND NOT p.redo AND NOT list_contains(p.ranks, jr.rank) GROUP BY 1, 2),
pk AS (SELECT b.job, b.rank, max(event_id) AS rs FROM base b JOIN picks p ON p.job = b.job AND list_contains(p.ranks, b.rank) AND event_id > v GROUP BY 1, 2),
dn AS (SELECT b.job, b.rank, max(event_id) AS dn, min(event_id) AS d0, count(*) AS rev FROM base b JOIN dones d ON d.job = b.job AND d.rank = b.rank AND event_id > v GROUP BY 1, 2),
cl AS (SELECT job, rank, coalesce(rev, 0) AS rev, dn, greatest(coalesce(rs, -1), coalesce(dn, -1)) AS bs, coalesce(rs, d0) AS since FROM pk FULL JOIN dn USING (job, rank)),
pr AS (SELECT c.job, c.rank, arg_max(pct, event_id) FILTER (type = 'clip_track') AS t, arg_max(pct, event_id) FILTER (type = 'clip_render') AS r
  FROM cl c JOIN re e ON e.job = c.job AND e.rank = c.rank AND event_id > bs AND type IN ('clip_track', 'clip_render') GROUP BY 1, 2),
va AS (SELECT c.job, c.rank, aspect, arg_max(file, event_id) AS f FROM cl c JOIN re e ON e.job = c.job AND e.rank = c.rank AND event_id > since AND type = 'clip_variant' GROUP BY 1, 2, 3),
vs AS (SELECT job, rank, string_agg(aspect || '=' || f, ' ' ORDER BY aspect) AS variants FROM va GROUP BY 1, 2),
se AS (SELECT *, CASE WHEN type = 'clips_picked' THEN 'clips_ready' WHEN type = 'job_done' THEN 'done' WHEN type = 'job_failed' THEN 'failed'
  WHEN type = 'stage' THEN CASE WHEN stage = 'download' THEN 'downloading' WHEN stage = 'audio' THEN 'extracting' WHEN stage = 'transcribe' THEN 'transcribing' WHEN stage IN ('pick', 'track') THEN 'analyzing' END END AS const,
  type = 'stage' AND stage IN ('render', 'merge', 'kit') AS soft FROM re),
st AS (SELECT job, arg_max(const, event_id) AS c, max(event_id) FILTER (const IS NOT NULL) AS ca, max(event_id) FILTER (soft) AS sa FROM se GROUP BY 1),
js AS (SELECT job, CASE WHEN sa > coalesce(ca, -1) AND coalesce(c, 'queued') <> 'clips_ready' THEN 'analyzing' ELSE coalesce(c, 'queued') END AS status FROM st),
records AS (SELECT js.job, status, cl.rank, rev, coalesce(t, CASE WHEN dn = bs THEN 100 ELSE 0 END) AS track_pct, coalesce(r, CASE WHEN dn = bs THEN 100 ELSE 0 END) AS render_pct,
  CASE WHEN dn = bs THEN 'done' WHEN t IS NOT NULL OR r IS NOT NULL THEN 'rendering' ELSE 'pending' END AS render_status, coalesce(variants, '') AS variants
  FROM js LEFT JOIN cl ON cl.job = js.job LEFT JOIN pr ON pr.job = cl.job AND pr.rank = cl.rank LEFT JOIN vs ON vs.job = cl.job AND vs.rank = cl.rank)"""
RECORD_ROWS = "SELECT job, status, rank, CAST(rev AS BIGINT) AS rev, CAST(track_pct AS BIGINT) AS track_pct, CAST(render_pct AS BIGINT) AS render_pct, render_status, variants FROM records WHERE rank IS NOT NULL"


def record_rows(records):
    """Clips with their variants as text."""
    text = F.array_join(F.transform("variants", lambda v: F.concat(v["aspect"], F.lit("="), v["file"])), " ")
    return records.filter("rank is not null").withColumn("variants", F.coalesce(text, F.lit("")))


@query("job_records", f"WITH {RECORDS} {RECORD_ROWS}")
def job_records(spark, sf):
    return record_rows(J.job_records(td.record_events(spark, sf)))


@query("job_status_counts", f"WITH {CLIP_STATES} SELECT status, count(*) AS n FROM jobs GROUP BY 1")
def job_status_counts(spark, sf):
    return J.status_counts(J.job_states(td.job_events(spark, sf)))


@query("job_summaries", f"""WITH {CLIP_STATES} SELECT j.job, status, events, count(c.rank) AS clips, count(*) FILTER (render_status = 'done') AS clips_rendered FROM jobs j LEFT JOIN clip_states c USING (job) GROUP BY 1, 2, 3""")
def job_summaries(spark, sf):
    e = td.job_events(spark, sf)
    return J.summaries(J.job_states(e), J.clip_states(e)).drop("created")


@query("newest_active_jobs", f"WITH {CLIP_STATES} SELECT job, status, events FROM jobs WHERE status NOT IN ('done', 'failed', 'cancelled') ORDER BY created DESC, job LIMIT 20")
def newest_active_jobs(spark, sf):
    return J.newest(J.job_states(td.job_events(spark, sf)), 20, "active").drop("created")


@query("reloaded_jobs", f"""WITH {CLIP_STATES}, c AS (SELECT job, bool_and(render_status = 'done') AS alld FROM clip_states GROUP BY 1)
SELECT job, CASE WHEN status IN ('done', 'failed', 'cancelled') THEN status WHEN alld THEN 'done' ELSE 'failed' END AS status,
 CASE WHEN status NOT IN ('done', 'failed', 'cancelled') AND NOT coalesce(alld, false) THEN 'interrupted by server restart' END AS error FROM jobs LEFT JOIN c USING (job)""")
def reloaded_jobs(spark, sf):
    e = td.job_events(spark, sf)
    clips = J.clip_states(e).groupBy("job").agg(F.collect_list(F.struct("rank", "render_status")).alias("clips"))
    none = F.array().cast("array<struct<rank:bigint,render_status:string>>")
    r = J.job_states(e).join(clips, "job", "left").withColumn("clips", F.coalesce("clips", none)).withColumn("error", F.lit(None).cast("string"))
    return J.reload(r).select("job", "status", "error")


@query("stage_statuses", """SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'downloading' WHEN 1 THEN 'extracting' WHEN 2 THEN 'extracting' WHEN 3 THEN 'transcribing' WHEN 4 THEN 'analyzing' WHEN 5 THEN 'analyzing'
  WHEN 6 THEN CASE WHEN user_id % 2 = 0 THEN 'clips_ready' ELSE 'analyzing' END ELSE CASE WHEN user_id % 2 = 0 THEN 'clips_ready' ELSE 'queued' END END AS status FROM events""")
def stage_statuses(spark, sf):
    stage = F.element_at(F.array(*[F.lit(s) for s in "download provision audio transcribe pick track render done".split()]), (F.col("event_id") % 8 + 1).cast("int"))
    now = F.when(F.col("user_id") % 2 == 0, "clips_ready").otherwise("queued")
    return td.table(spark, sf, "events").select("event_id", J.stage_status(stage, now).alias("status"))


@query("listed_jobs", f"WITH {CLIP_STATES} SELECT job, status, events, (SELECT count(*) FROM jobs) AS total FROM jobs WHERE status = 'failed' ORDER BY created DESC, job LIMIT 50")
def listed_jobs(spark, sf):
    return J.listing(J.job_states(td.job_events(spark, sf)), 50, "failed").drop("created")


@query("finalized_jobs", """SELECT event_id, CASE WHEN event_id % 3 > 0 AND user_id % 5 = 0 THEN 'cancelled' WHEN event_id % 3 > 0 OR user_id % 4 = 0 THEN 'done' WHEN user_id % 5 = 0 THEN 'cancelled' ELSE 'failed' END AS status FROM events""")
def finalized_jobs(spark, sf):
    e = td.table(spark, sf, "events").selectExpr("event_id", "'analyzing' AS status", "event_id % 3 > 0 AS ok", "user_id % 5 = 0 AS cancelled", "user_id % 4 = 0 AS edit")
    return J.finalize(e).select("event_id", "status")


@query("tool_calls", """WITH c AS (SELECT event_id // 2 AS seq, max(CASE WHEN event_id % 2 = 0 THEN epoch_us(ts) // 1000 END) AS at_ms, max(CASE WHEN event_id % 2 = 0 THEN event_type END) AS tool,
  max(CASE WHEN event_id % 2 = 1 THEN epoch_us(ts) // 1000 END) AS en, bool_and(CASE WHEN event_id % 2 = 1 THEN event_type <> 'error' END) AS ok FROM events GROUP BY 1)
SELECT seq, tool, CASE WHEN en IS NULL THEN 'running' WHEN ok THEN 'ok' ELSE 'error' END AS state, coalesce(greatest(en - at_ms, 0), 0) AS ms FROM c ORDER BY seq DESC LIMIT 50""")
def tool_calls(spark, sf):
    e = td.table(spark, sf, "events").select(
        F.expr("event_id div 2").alias("seq"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"), F.expr("if(event_id % 2 = 0, 'start', 'end')").alias("phase"),
        F.expr("if(event_id % 2 = 0, event_type, null)").alias("tool"), (F.col("event_type") != "error").alias("ok"), F.col("props").alias("detail"))
    return J.call_log(e).select("seq", "tool", "state", "ms")
