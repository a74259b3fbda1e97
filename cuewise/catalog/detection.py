"""Detection queries. Order lines are faces, orders are frames, embeddings are 8x8 images."""

from pyspark.sql import functions as F

from cuewise.catalog.registry import query
from cuewise.catalog.sql import DETECTIONS, with_words
from cuewise.functions import geometry as G
from cuewise.operators import detect as D
from cuewise.operators import framing as R
from cuewise.operators import presence as P
from cuewise.sources import testdata as td

SRC_W, SRC_H = 1920.0, 1080.0
TALL = G.frame_for("9:16", SRC_W, SRC_H)
BX, BY, BW, BH = TALL.base
MINH = TALL.min_h


def r6(c):
    return F.round(c, 6)


def faces(spark, sf):
    return D.boxed(td.detections(spark, sf))


def iou_sql(a, b):
    i = (f"(greatest(least({a}.x + {a}.w, {b}.x + {b}.w) - greatest({a}.x, {b}.x), 0) * "
         f"greatest(least({a}.y + {a}.h, {b}.y + {b}.h) - greatest({a}.y, {b}.y), 0))")
    return f"({i} / greatest({a}.w * {a}.h + {b}.w * {b}.h - {i}, 1e-9))"


PREV = "p.video_id = d.video_id AND p.frame = d.frame - 1"
KEPT = DETECTIONS + f""", kept AS (SELECT * FROM dets d WHERE score >= 0.65 OR EXISTS (SELECT 1 FROM dets p WHERE {PREV} AND {iou_sql('d', 'p')} > 0.3))"""


@query("confirmed_faces", f"WITH {KEPT} SELECT video_id, frame, det FROM kept")
def confirmed_faces(spark, sf):
    return D.confirm(faces(spark, sf)).select("video_id", "frame", "det")


@query("adjacent_overlaps", f"""WITH {DETECTIONS}
SELECT d.video_id, d.frame, d.det, round(max({iou_sql('d', 'p')}), 6) AS best FROM dets d JOIN dets p ON {PREV} GROUP BY 1, 2, 3""")
def adjacent_overlaps(spark, sf):
    f = faces(spark, sf)
    p = D._previous(f)
    return f.join(p, (F.col("video_id") == F.col("pv")) & (F.col("frame") == F.col("pf"))).groupBy(
        "video_id", "frame", "det").agg(r6(F.max(G.iou("box", "pbox"))).alias("best"))


HASHES = "hs AS (SELECT o_orderkey // 1000 AS video_id, o_orderkey AS frame, (o_orderkey // 40) * 2654435761 % 4611686018427387904 + o_orderkey % 3 AS h FROM orders)"


@query("shot_candidates", f"""WITH {KEPT}, {HASHES}
SELECT a.video_id, a.frame FROM hs a JOIN hs b ON b.video_id = a.video_id AND b.frame = a.frame - 1 WHERE bit_count(xor(a.h, b.h)) > 16
 AND NOT EXISTS (SELECT 1 FROM kept d JOIN kept p ON {PREV} WHERE d.video_id = a.video_id AND d.frame = a.frame AND {iou_sql('d', 'p')} >= 0.15)""")
def shot_candidates(spark, sf):
    h = td.table(spark, sf, "orders").select(
        F.expr("o_orderkey div 1000").alias("video_id"), F.col("o_orderkey").alias("frame"),
        F.expr("(o_orderkey div 40) * 2654435761 % 4611686018427387904 + o_orderkey % 3").alias("hash"))
    return D.shot_candidates(h, D.confirm(faces(spark, sf)))


PAIRS = DETECTIONS + f""", r2 AS (SELECT *, row_number() OVER (PARTITION BY video_id, frame ORDER BY w * h * score DESC, det) AS n FROM dets WHERE score >= 0.6),
pr AS (SELECT a.video_id, a.frame, CASE WHEN a.x + a.w / 2 <= b.x + b.w / 2 THEN a ELSE b END AS l, CASE WHEN a.x + a.w / 2 <= b.x + b.w / 2 THEN b ELSE a END AS r
  FROM r2 a JOIN r2 b ON a.video_id = b.video_id AND a.frame = b.frame AND a.n = 1 AND b.n = 2
  WHERE least(a.h, b.h) >= 0.6 * greatest(a.h, b.h) AND abs((a.x + a.w / 2) - (b.x + b.w / 2)) >= 0.2 * {SRC_W})"""


@query("side_by_side_pairs", f"WITH {PAIRS} SELECT video_id, frame, round(l.x, 6) AS lx, round(l.h, 6) AS lh, round(r.x, 6) AS rx, round(r.score, 6) AS rs FROM pr")
def side_by_side_pairs(spark, sf):
    return D.pairs(faces(spark, sf), SRC_W).select(
        "video_id", "frame", r6("l.x").alias("lx"), r6("l.h").alias("lh"), r6("r.x").alias("rx"), r6("r.score").alias("rs"))


@query("pair_share", f"""WITH {PAIRS}, n AS (SELECT o_orderkey // 1000 AS video_id, count(*) AS samples FROM orders GROUP BY 1),
d AS (SELECT video_id, count(*) AS c FROM pr GROUP BY 1)
SELECT video_id, samples, coalesce(c, 0) AS pairs, coalesce(c, 0) >= 10 AND coalesce(c, 0)::DOUBLE / samples >= 0.6 AS split_auto, coalesce(c, 0) >= 3 AS split_forced FROM n LEFT JOIN d USING (video_id)""")
def pair_share(spark, sf):
    return D.pair_share(frames(spark, sf), D.pairs(faces(spark, sf), SRC_W))


def frames(spark, sf):
    return td.table(spark, sf, "orders").select(F.expr("o_orderkey div 1000").alias("video_id"), F.col("o_orderkey").alias("frame"))


@query("suppressed_faces", f"""WITH RECURSIVE {DETECTIONS},
rk AS (SELECT video_id, frame, det, {{'x': x, 'y': y, 'w': w, 'h': h, 'det': det}} AS f, row_number() OVER (PARTITION BY video_id, frame ORDER BY score DESC, det) AS n FROM dets),
st AS (SELECT video_id, frame, n, [f] AS kept FROM rk WHERE n = 1 UNION ALL
 SELECT r.video_id, r.frame, r.n, CASE WHEN len(list_filter(s.kept, lambda k: {iou_sql('r.f', 'k')} >= 0.3)) = 0 THEN list_append(s.kept, r.f) ELSE s.kept END
 FROM st s JOIN rk r ON r.video_id = s.video_id AND r.frame = s.frame AND r.n = s.n + 1 AND r.n <= 5),
fn AS (SELECT video_id, frame, unnest(arg_max(kept, n)) AS k FROM st GROUP BY 1, 2)
SELECT video_id, frame, k.det AS det FROM fn""")
def suppressed_faces(spark, sf):
    return D.suppress(faces(spark, sf), 0.3, 5).select("video_id", "frame", "det")


@query("conversation_groups")
def conversation_groups(spark, sf):
    return D.cluster_members(faces(spark, sf), SRC_W).select("video_id", "frame", F.col("n").cast("long").alias("n"), "det")


@query("group_windows", f"""WITH {DETECTIONS},
g0 AS (SELECT video_id, frame, min(x) AS lo, max(x + w) AS hi, avg(y + h / 2) AS cy, count(*) AS n FROM dets GROUP BY 1, 2),
g1 AS (SELECT *, lo - 0.12 * {BW} AS x1, hi + 0.12 * {BW} AS x2 FROM g0 WHERE n >= 2 AND (hi + 0.12 * {BW}) - (lo - 0.12 * {BW}) <= {BW}),
g2 AS (SELECT * EXCLUDE (x1, x2), greatest(x1, 0) AS x1, CASE WHEN x1 < 0 THEN x2 - x1 ELSE x2 END AS x2 FROM g1),
g3 AS (SELECT *, least(greatest((CASE WHEN x2 > {SRC_W} THEN x1 - (x2 - {SRC_W}) ELSE x1 END + least(x2, {SRC_W})) / 2 - {BW} / 2, 0), {SRC_W - BW}) AS x FROM g2)
SELECT video_id, frame, round(x, 6) AS x, round(least(greatest(cy - {BH} * 0.4, 0), {SRC_H - BH}), 6) AS y FROM g3 WHERE lo >= x - 1 AND hi <= x + {BW} + 1""")
def group_windows(spark, sf):
    return D.group_windows(faces(spark, sf), TALL).select("video_id", "frame", r6("x").alias("x"), r6("y").alias("y"))


FW = f"""z0 AS (SELECT *, least(greatest((score - 0.5) / 0.3, 0), 1) AS u FROM dets),
z1 AS (SELECT *, least(greatest(0.38 / greatest(h / {SRC_H}, 0.05), 1), least(1.15 + 0.15 * u * u * (3.0 - 2.0 * u), {max(BH / MINH, 1.0)})) AS z FROM z0),
z2 AS (SELECT video_id, frame, det, x + w / 2 AS cx, y + h / 2 AS cy, {BW} / z AS ww, {BH} / z AS hh FROM z1),
fw AS (SELECT *, least(greatest(cx - ww / 2, 0), greatest({SRC_W} - ww, 0)) AS wx, least(greatest(cy - hh * 0.4, 0), greatest({SRC_H} - hh, 0)) AS wy FROM z2)"""


@query("face_windows", f"WITH {DETECTIONS}, {FW} SELECT video_id, frame, det, round(wx, 6) AS x, round(wy, 6) AS y, round(ww, 6) AS w, round(hh, 6) AS h FROM fw")
def face_windows(spark, sf):
    f = faces(spark, sf).withColumn("win", G.face_window("box", TALL))
    return f.select("video_id", "frame", "det", *[r6(F.col(f"win.{c}")).alias(c) for c in "xywh"])


@query("zoomed_windows", f"""WITH {DETECTIONS}, {FW}, zz AS (SELECT *, {BW} / ww AS z0 FROM fw),
zy AS (SELECT *, greatest(least(z0 * 1.2, greatest({max(BH / MINH, 1.0)}, z0)), 1.0) AS z FROM zz)
SELECT video_id, frame, det, round(CASE WHEN z = z0 THEN ww ELSE {BW} / z END, 6) AS w, round(CASE WHEN z = z0 THEN wx ELSE least(greatest(cx - {BW} / z / 2, 0), greatest({SRC_W} - {BW} / z, 0)) END, 6) AS x FROM zy""")
def zoomed_windows(spark, sf):
    f = faces(spark, sf).withColumn("win", G.face_window("box", TALL))
    cx, cy = F.col("box.x") + F.col("box.w") / 2, F.col("box.y") + F.col("box.h") / 2
    f = f.withColumn("z", G.zoom_window("win", cx, cy, 1.2, TALL))
    return f.select("video_id", "frame", "det", r6("z.w").alias("w"), r6("z.x").alias("x"))


@query("recall_report", f"""WITH {DETECTIONS}, f AS (SELECT o_orderkey // 1000 AS video_id, o_orderkey AS frame FROM orders),
p AS (SELECT video_id, frame, count(*) AS n, sum(CASE WHEN w < 0.06 * 3200 THEN 1 ELSE 0 END) AS small FROM dets GROUP BY 1, 2)
SELECT video_id, count(*) AS frames, round(100.0::DOUBLE * count(n) / count(*), 6) AS recall_pct, round(sum(coalesce(n, 0))::DOUBLE / count(*), 6) AS faces_per_frame,
 CAST(coalesce(sum(small), 0) AS BIGINT) AS small FROM f LEFT JOIN p USING (video_id, frame) GROUP BY 1""")
def recall_report(spark, sf):
    return D.recall_report(frames(spark, sf), faces(spark, sf), 3200.0)


FLAGS = "fl AS (SELECT o_orderkey // 1000 AS video_id, o_orderkey AS i, coalesce(f, false) AS face, o_orderkey * 250 AS t_ms FROM orders LEFT JOIN (SELECT frame, bool_or(score >= 0.85) AS f FROM dets GROUP BY 1) ON frame = o_orderkey)"


def flags(spark, sf):
    seen = faces(spark, sf).groupBy("frame").agg(F.bool_or(F.col("box.score") >= 0.85).alias("face"))
    return frames(spark, sf).join(seen, "frame", "left").select(
        "video_id", F.col("frame").alias("i"), F.coalesce("face", F.lit(False)).alias("face"), (F.col("frame") * 250).alias("t_ms"))


VOTED = FLAGS + """, vt AS (SELECT *, sum(CASE WHEN face THEN 1 ELSE 0 END) OVER w * 2 >= count(*) OVER w AS voted FROM fl
  WINDOW w AS (PARTITION BY video_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))"""


@query("voted_presence", f"WITH {DETECTIONS}, {VOTED} SELECT video_id, i, voted FROM vt")
def voted_presence(spark, sf):
    return D.majority_vote(flags(spark, sf)).select("video_id", "i", "voted")


@query("presence_runs", f"""WITH {DETECTIONS}, {VOTED}, ch AS (SELECT *, coalesce(voted <> lag(voted) OVER (PARTITION BY video_id ORDER BY i), true) AS o FROM vt),
g AS (SELECT *, sum(CASE WHEN o THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY i) AS k FROM ch)
SELECT video_id, min(i) AS i0, max(i) AS i1, voted, count(*) AS n, min(t_ms) AS t0_ms, max(t_ms) AS t1_ms FROM g GROUP BY video_id, k, voted""")
def presence_runs(spark, sf):
    return D.runs(D.majority_vote(flags(spark, sf)), "voted")


@query("group_shot_runs", f"""WITH {DETECTIONS}, n AS (SELECT o_orderkey // 1000 AS video_id, o_orderkey AS i, o_orderkey * 250 AS t_ms, coalesce(c, 0) >= 2 AS g FROM orders
  LEFT JOIN (SELECT frame, count(*) AS c FROM dets GROUP BY 1) ON frame = o_orderkey),
ch AS (SELECT *, coalesce(g <> lag(g) OVER (PARTITION BY video_id ORDER BY i), true) AS o FROM n),
k AS (SELECT *, sum(CASE WHEN o THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY i) AS k FROM ch),
r AS (SELECT video_id, k, g, min(t_ms) AS t0 FROM k GROUP BY 1, 2, 3), e AS (SELECT *, lead(t0) OVER (PARTITION BY video_id ORDER BY k) AS t1 FROM r)
SELECT video_id, t0 AS start_ms, t1 AS end_ms FROM e WHERE g AND t1 - t0 >= 800""")
def group_shot_runs(spark, sf):
    n = faces(spark, sf).groupBy("frame").agg(F.count("*").alias("n_faces"))
    f = frames(spark, sf).join(n, "frame", "left").select(
        "video_id", F.col("frame").alias("i"), (F.col("frame") * 250).alias("t_ms"), F.coalesce("n_faces", F.lit(0)).alias("n_faces"))
    return D.group_runs(f)


@query("speech_memory", f"""WITH {DETECTIONS}, {FLAGS}, m AS (SELECT video_id, i, max(CASE WHEN face THEN i END) OVER w AS a, max(CASE WHEN i % 40 = 0 THEN i END) OVER w AS s FROM fl WINDOW w AS (PARTITION BY video_id ORDER BY i))
SELECT video_id, i, CASE WHEN s IS NULL OR a >= s THEN coalesce(greatest(30 - (i - a), 0), 0) ELSE 0 END AS "left" FROM m""")
def speech_memory(spark, sf):
    """Faces as the flag; a shot every 40 frames clears the memory."""
    return D.since_last_true(flags(spark, sf).withColumn("shot", F.col("i") % 40 == 0), "face", reset="shot").select("video_id", "i", "left")


PIX = """px AS (SELECT 0 AS video_id, vec_id AS frame, k // 8 AS y, k % 8 AS x, CAST(floor(abs(embedding[k + 1]::DOUBLE) * 1000) AS BIGINT) % 256 AS luma
 FROM embeddings, (SELECT unnest(range(0, 64)) AS k))"""


def pixels(spark, sf):
    e = td.table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("k", "v"))
    return e.select(F.lit(0).cast("long").alias("video_id"), F.col("vec_id").alias("frame"), F.expr("bigint(k div 8)").alias("y"),
                    F.expr("bigint(k % 8)").alias("x"), (F.floor(F.abs(F.col("v").cast("double")) * 1000).cast("long") % 256).alias("luma"))


@query("average_hashes", f"""WITH {PIX}, c AS (SELECT frame, y * 8 + x AS cell, luma AS m FROM px), a AS (SELECT frame, sum(m) // 64 AS av FROM c GROUP BY 1)
SELECT 0 AS video_id, frame, CAST(sum(CASE WHEN m > av AND cell < 63 THEN (1::HUGEINT << cell::INT) WHEN m > av THEN -9223372036854775808::HUGEINT ELSE 0 END) AS BIGINT) AS hash FROM c JOIN a USING (frame) GROUP BY frame""")
def average_hashes(spark, sf):
    return D.average_hash(pixels(spark, sf), 8, 8)


CHG = PIX + """, df AS (SELECT a.frame, avg(abs(a.luma - b.luma)) AS diff FROM px a JOIN px b ON b.frame = a.frame + 1 AND a.y = b.y AND a.x = b.x GROUP BY 1),
bn AS (SELECT frame, luma // 16 AS bin, count(*) / 64.0::DOUBLE AS p FROM px GROUP BY 1, 2),
tn AS (SELECT frame, sum(abs(d)) AS turnover FROM (SELECT frame, bin, sum(p) AS d FROM (SELECT * FROM bn UNION ALL SELECT frame - 1, bin, -p FROM bn) GROUP BY 1, 2) GROUP BY 1),
ch AS (SELECT frame, diff, turnover FROM df JOIN tn USING (frame))"""


@query("frame_changes", f"WITH {CHG} SELECT 0 AS video_id, frame, round(diff, 6) AS diff, round(turnover, 6) AS turnover FROM ch")
def frame_changes(spark, sf):
    return D.frame_changes(pixels(spark, sf)).select("video_id", "frame", r6("diff").alias("diff"), r6("turnover").alias("turnover"))


@query("frame_cuts", f"""WITH {CHG}, p AS (SELECT frame // 40 AS profile, frame AS i, diff, turnover FROM ch),
pk AS (SELECT profile, arg_max(i, (diff, -i)) AS pi, max(diff) AS d, arg_max(turnover, (diff, -i)) AS tn FROM p WHERE i % 40 BETWEEN 5 AND 35 GROUP BY 1),
ot AS (SELECT p.profile, list_sort(list(p.diff)) AS v FROM p JOIN pk USING (profile) WHERE abs(i - pi) > 1 AND p.diff > 0.5 GROUP BY 1)
SELECT profile, pi * 40 AS cut_ms FROM pk LEFT JOIN ot USING (profile) WHERE d >= 6 AND (d >= 2.5 * coalesce(v[len(v) // 2 + 1], 0) OR tn >= 0.6)""")
def frame_cuts(spark, sf):
    c = D.frame_changes(pixels(spark, sf)).select(
        F.expr("frame div 40").alias("profile"), F.col("frame").alias("i"), (F.col("frame") * 40).alias("t_ms"),
        F.round("diff", 9).alias("diff"), F.round("turnover", 9).alias("turnover"))
    lo = F.col("profile") * 1600
    return D.classify_cuts(c, ["profile"], lo + 200, lo + 1400)


@query("mouth_motion", f"""WITH {PIX}, b AS (SELECT vec_id AS frame, (vec_id % 3)::DOUBLE AS x, (vec_id % 2)::DOUBLE AS y, 5.0::DOUBLE AS w, 6.0::DOUBLE AS h FROM embeddings),
st AS (SELECT a.* FROM b a JOIN b c ON c.frame = a.frame - 1 WHERE (5.0 - abs(a.x - c.x)) * (6.0 - abs(a.y - c.y)) / (60.0 - (5.0 - abs(a.x - c.x)) * (6.0 - abs(a.y - c.y))) > 0.35),
mo AS (SELECT b.frame, least(avg(abs(p.luma - q.luma)) / 255.0::DOUBLE * 8.0, 1.0) AS motion FROM st b JOIN px p ON p.frame = b.frame JOIN px q ON q.frame = b.frame - 1 AND q.y = p.y AND q.x = p.x
WHERE p.x >= floor(b.x + w * 0.25) AND p.x < floor(b.x + w * 0.75) AND p.y >= floor(b.y + h * 0.55) AND p.y < floor(b.y + h * 0.92) GROUP BY b.frame)
SELECT 0 AS video_id, b.frame, 0 AS det, round(coalesce(motion, 0.0), 6) AS motion FROM b LEFT JOIN mo USING (frame)""")
def mouth_motion(spark, sf):
    box = F.struct((F.col("vec_id") % 3).cast("double").alias("x"), (F.col("vec_id") % 2).cast("double").alias("y"),
                   F.lit(5.0).alias("w"), F.lit(6.0).alias("h"), F.lit(1.0).alias("score"))
    f = td.table(spark, sf, "embeddings").select(F.lit(0).cast("long").alias("video_id"), F.col("vec_id").alias("frame"), F.lit(0).cast("long").alias("det"), box.alias("box"))
    return D.mouth_motion(pixels(spark, sf), f).withColumn("motion", r6("motion"))


@query("panel_crops")
def panel_crops(spark, sf):
    """Two-panel crops of every shot (a shot: 40 frames of a video)."""
    shots = frames(spark, sf).select("video_id", F.greatest(F.expr("frame div 40 * 40"), F.expr("video_id * 1000")).alias("shot_frame")).distinct()
    p = D.shot_panels(D.pairs(faces(spark, sf), SRC_W), shots, TALL)
    return p.select("video_id", "shot_frame", *[r6(f"{s}.{c}").alias(f"{s}_{c}") for s in ("top", "bottom") for c in "xywh"])


MEDIANS = {f"{s}{n}": e.format(s=s) for s in "lr" for n, e in (("x", "{s}.x + {s}.w / 2"), ("y", "{s}.y + {s}.h / 2"), ("w", "{s}.w"), ("h", "{s}.h"))}


@query("typical_pairs", f"""WITH {PAIRS}, a AS (SELECT video_id, {", ".join(f"list_sort(list({e})) AS {c}" for c, e in MEDIANS.items())} FROM pr GROUP BY 1)
SELECT video_id, {", ".join(f"round({c}[len({c}) // 2 + 1], 6) AS {c}" for c in MEDIANS)} FROM a""")
def typical_pairs(spark, sf):
    return D.typical_faces(D.pairs(faces(spark, sf), SRC_W), ["video_id"]).select("video_id", *[r6(c).alias(c) for c in MEDIANS])


@query("frame_rates", """
WITH q AS (SELECT event_id, CAST(floor(value * 100) AS BIGINT) AS n, CASE WHEN event_id % 2 = 0 THEN 1001 ELSE 100 END AS d FROM events),
s AS (SELECT unnest([24000,24,25,30000,30,50,60000,60]) AS sn, unnest([1001,1,1,1001,1,1,1001,1]) AS sd, unnest(range(0,8)) AS i),
f AS (SELECT event_id, n, d, n::DOUBLE / d AS f FROM q), e AS (SELECT event_id, f, n, arg_min(sn, (abs(sn::DOUBLE / sd - f) / f, i)) AS sn, arg_min(sd, (abs(sn::DOUBLE / sd - f) / f, i)) AS sd, min(abs(sn::DOUBLE / sd - f) / f) AS er FROM f, s WHERE n > 0 GROUP BY 1, 2, 3)
SELECT q.event_id, CASE WHEN q.n <= 0 OR f NOT BETWEEN 9 AND 1000 THEN 30 WHEN f > 61 THEN 60 WHEN er < 0.03 THEN sn ELSE 30 END AS fps_n,
 CASE WHEN q.n <= 0 OR f NOT BETWEEN 9 AND 1000 THEN 1 WHEN f > 61 THEN 1 WHEN er < 0.03 THEN sd ELSE 1 END AS fps_d FROM q LEFT JOIN e USING (event_id)""")
def frame_rates(spark, sf):
    e = td.table(spark, sf, "events").select("event_id", F.floor(F.col("value") * 100).alias("n"), F.expr("if(event_id % 2 = 0, 1001, 100)").alias("d"))
    return G.nearest_rate(e, "n", "d").select("event_id", "fps_n", "fps_d")


@query("reacquire_radius", "SELECT event_id, round(least(0.08::DOUBLE + 0.25 * greatest(value / 100 - 0.1, 0), 0.2), 6) AS radius FROM events")
def reacquire_radius(spark, sf):
    return td.table(spark, sf, "events").select("event_id", r6(G.reacquire_frac(F.col("value") / 100 - 0.1)).alias("radius"))


@query("presence_segments")
def presence_segments(spark, sf):
    """Presence of a confident face per video; a shot cut every 40 frames."""
    f = frames(spark, sf)
    shots = f.filter("frame % 40 = 0").select("video_id", (F.col("frame") * 250 + 100).alias("t_ms"))
    ends = f.groupBy("video_id").agg((F.max("frame") * 250 + 250).alias("end_ms"))
    return P.presence_segments(flags(spark, sf), shots, ends)


@query("presence_pieces")
def presence_pieces(spark, sf):
    """Ranges of 25 s that tile each video."""
    f = frames(spark, sf)
    ranges = f.filter("frame % 100 = 0").select("video_id", F.col("frame").alias("rank"), (F.col("frame") * 250).alias("a_ms"), (F.col("frame") * 250 + 25_000).alias("b_ms"))
    return P.clip_pieces(presence_segments(spark, sf), ranges)


CLOCK = "(frame - video_id * 1000) * 1000 // 15"


def spoken(spark, sf):
    """Every frame at 15 Hz on its video's clock, and whether the talk of the same id says a word then."""
    t = F.expr("(frame - video_id * 1000) * 1000 div 15")
    return P.speech_samples(frames(spark, sf).withColumn("t_ms", t), td.words(spark, sf))


@query("spoken_samples", with_words(f""", f AS (SELECT o_orderkey // 1000 AS video_id, o_orderkey AS frame FROM orders), t AS (SELECT *, {CLOCK} AS t_ms FROM f)
SELECT t.*, EXISTS (SELECT 1 FROM words w WHERE w.video_id = t.video_id AND t.t_ms > w.s_ms - 400 AND t.t_ms < w.e_ms + 400) AS speech FROM t"""))
def spoken_samples(spark, sf):
    return spoken(spark, sf).select("video_id", "frame", "t_ms", "speech")


def speaker_samples(spark, sf):
    """Samples and faces of the order lines; motion from the box, speech from the talk's words, a shot every 40 samples of every second video."""
    shot = (F.col("frame") % 40 == 0) & (F.col("video_id") % 2 == 0)
    s = spoken(spark, sf).select("video_id", "frame", (F.col("t_ms") / 1000).alias("t_s"), "speech", shot.alias("shot"))
    return D.confirm(faces(spark, sf)).withColumn("motion", F.col("box.w") % 7 / 10), s


@query("active_speaker")
def active_speaker(spark, sf):
    """The face that is followed in each sample and where it changes."""
    rows = R.frame_rows(*speaker_samples(spark, sf), TALL)
    return rows.where("det is not null").select("video_id", "frame", "det", "handoff")


@query("framed_samples")
def framed_samples(spark, sf):
    """The framing of every sample."""
    return R.frame_rows(*speaker_samples(spark, sf), TALL)
