"""Ingest, edit and streaming queries. Documents of every format are derived from the tables."""

import datetime
import uuid

from pyspark.sql import functions as F

from cuewise.catalog.intervals import minute_parts
from cuewise.catalog.registry import query
from cuewise.catalog.sql import with_sentences, with_words
from cuewise.catalog.analytics import CLIP_STATES, RECORD_ROWS, RECORDS, record_rows
from cuewise.functions.text import words_in_order
from cuewise.functions.timefmt import srt
from cuewise.operators import edits as E
from cuewise.operators import intervals as I
from cuewise.operators import segment
from cuewise.session import checkpoint_dir
from cuewise.sources.staging import cut
from cuewise.sources import ingest as G
from cuewise.sources import testdata as td
from cuewise.streaming import live, ordered

MONTHS = 90 * 86_400_000  # the events of a job are hours to days apart
FAR = datetime.datetime(2100, 1, 1)  # a time past every row's, which ends all waiting
NEAR = ("video_id", "block")  # neighbouring words


def recogniser_docs(spark, sf):
    """Words as recogniser JSON: sentences are segments, each word two pieces; every third
    video's documents have no tokens."""
    w = segment.with_sentence(td.words(spark, sf))
    in_order = F.array_sort(F.collect_list(F.struct("pos", "w", "s_ms", "e_ms")))
    parts = w.groupBy("video_id", "chunk", "sent_start").agg(in_order.alias("p")).select(
        "video_id", "sent_start", "chunk", F.array_join("p.w", " ").alias("t"), F.col("p.s_ms").alias("a"), F.col("p.e_ms").alias("b"))
    # What moves, once, is the text and the times of a sentence; tokens are made where the document is put together.
    whole = lambda c: F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chunk", c))), lambda x: x[c])).alias(c)
    seg = parts.repartition("video_id").groupBy("video_id", "sent_start").agg(
        words_in_order("chunk", "t").alias("text"), whole("a"), whole("b"), F.min(F.array_min("a")).alias("s"), F.max(F.array_max("b")).alias("e"))
    seg = seg.withColumn("p", F.arrays_zip(F.split("text", " ").alias("w"), F.col("a").alias("s_ms"), F.col("b").alias("e_ms")))

    def tokens(x):
        stamp = F.struct(srt(x["s_ms"]).alias("from"), srt(x["e_ms"]).alias("to"))
        piece = lambda t: F.struct(t.alias("text"), stamp.alias("timestamps"), F.lit(0.9).alias("p"))
        return F.array(piece(F.concat(F.lit(" "), F.substring(x["w"], 1, 2))), piece(F.substring(x["w"], 3, 1 << 30)))

    mark = F.array(F.struct(F.lit("[_BEG_]").alias("text"), F.struct(srt("s").alias("from"), srt("s").alias("to")).alias("timestamps"), F.lit(0.9).alias("p")))
    tokens = F.when(F.col("video_id") % 3 != 0, F.concat(mark, F.flatten(F.transform("p", tokens))))
    body = F.struct("text", F.struct(srt("s").alias("from"), srt("e").alias("to")).alias("timestamps"), tokens.alias("tokens"))
    docs = seg.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("sent_start", body.alias("b")))).alias("a"))
    return docs.select("video_id", F.to_json(F.struct(F.transform("a", lambda x: x["b"]).alias("transcription"))).alias("doc"))


@query("recogniser_words", with_sentences("""
, sg AS (SELECT video_id, sent_start, min(s_ms) AS s, max(e_ms) AS e, count(*) AS n FROM sw GROUP BY 1, 2)
SELECT w.video_id, w.w, CASE WHEN w.video_id % 3 <> 0 THEN w.s_ms ELSE CAST(round(s + (e - s) * (pos - w.sent_start) / n::DOUBLE) AS BIGINT) END AS s_ms,
 CASE WHEN w.video_id % 3 <> 0 THEN w.e_ms ELSE CAST(round(s + (e - s) * (pos - w.sent_start + 1) / n::DOUBLE) AS BIGINT) END AS e_ms
FROM sw w JOIN sg USING (video_id, sent_start) WHERE w <> ''"""))
def recogniser_words(spark, sf):
    return G.recogniser_words(recogniser_docs(spark, sf)).select("video_id", "w", "s_ms", "e_ms")


@query("recogniser_segments", with_sentences("""
SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY sent_start) - 1 AS seg, s_ms, e_ms, text FROM sentences WHERE text <> ''"""))
def recogniser_segments(spark, sf):
    return G.recogniser_segments(recogniser_docs(spark, sf))


@query("media_probes", """
SELECT event_id AS video_id, round(value * 10, 2) AS duration_s, CAST(CASE WHEN event_id % 4 IN (1, 3) THEN 1080 ELSE 1920 END AS INT) AS width, CAST(CASE WHEN event_id % 4 IN (1, 3) THEN 1920 ELSE 1080 END AS INT) AS height,
 CAST(CASE WHEN event_id % 2 = 0 THEN 30000 ELSE 25 END AS INT) AS fps_n, CAST(CASE WHEN event_id % 2 = 0 THEN 1001 ELSE 1 END AS INT) AS fps_d, event_id % 3 > 0 AS has_audio, CASE WHEN event_id % 5 > 0 THEN 'bt709' END AS color_space FROM events""")
def media_probes(spark, sf):
    turn = "case event_id % 4 when 1 then ',\"side_data_list\":[{\"x\":1},{\"rotation\":-90}]' when 3 then ',\"tags\":{\"rotate\":\"270\"}' else '' end"
    doc = f"""concat('{{"format":{{"duration":"', round(value * 10, 4), '"}},"streams":[{{"codec_type":"video","width":5,"disposition":{{"attached_pic":1}}}},',
      '{{"codec_type":"video","width":', if(event_id % 2 = 0, '1920', '"1920"'), ',"height":1080,"avg_frame_rate":"', if(event_id % 2 = 0, '30000/1001', '0/0'), '","r_frame_rate":"25/1","color_space":"',
      if(event_id % 5 > 0, 'bt709', 'unknown'), '"', {turn}, '}}', if(event_id % 3 > 0, ',{{"codec_type":"audio"}}', ''), ']}}')"""
    return G.media_probes(td.table(spark, sf, "events").select(F.col("event_id").alias("video_id"), F.expr(doc).alias("doc")))


LISTING = "'/media/' || source || '/' || lang || (doc_id % 200) || CASE WHEN doc_id % 3 = 0 THEN '.MP4' WHEN doc_id % 3 = 1 THEN '.mov' ELSE '.txt' END"


@query("media_outputs", f"""WITH l AS (SELECT DISTINCT {LISTING} AS path FROM documents), r AS (SELECT path, regexp_replace(split_part(path, '/', 4), '\\.[^.]*$', '') AS stem, regexp_extract(path, '\\.([^.]*)$', 1) AS ext FROM l),
m AS (SELECT *, count(*) OVER (PARTITION BY stem) AS c FROM r WHERE lower(ext) IN ('mp4', 'mov')) SELECT path, stem || CASE WHEN c > 1 THEN '-' || ext ELSE '' END || '-clips' AS output FROM m""")
def media_outputs(spark, sf):
    return G.media_outputs(td.table(spark, sf, "documents").select(F.expr(LISTING).alias("path")))


def specs(spark, sf):
    """Events as edit specs of documents."""
    return td.table(spark, sf, "events").selectExpr(
        "event_id % 1000 AS video_id", "event_id % 7 AS rank", "cast(round(value * 1000) as bigint) - 500 AS start_ms", "cast(round(value * 1000) as bigint) + 800 * (user_id % 5) AS end_ms",
        "if(user_id % 2 = 0, concat('Hook ', event_id), ' ') AS hook", "' T ' AS title", "cast(null as string) AS why", "event_type AS style", "cast(null as string) AS source", "cast(null as double) AS score", "event_id")


SPECS = """sp AS (SELECT event_id % 1000 AS video_id, event_id % 7 AS rank, CAST(round(value * 1000) AS BIGINT) - 500 AS a, CAST(round(value * 1000) AS BIGINT) + 800 * (user_id % 5) AS b, CASE WHEN user_id % 2 = 0 THEN 'Hook ' || event_id END AS hook, event_id FROM events),
sn AS (SELECT *, count(*) OVER (PARTITION BY video_id, rank) AS n FROM sp)"""


@query("rejected_specs", f"WITH {SPECS} SELECT video_id, rank, event_id, CASE WHEN rank < 1 THEN 'rank must be 1 or more' ELSE 'rank given twice' END AS reason FROM sn WHERE rank < 1 OR n > 1")
def rejected_specs(spark, sf):
    return G.check_edit_specs(specs(spark, sf))[1].select("video_id", "rank", "event_id", "reason")


@query("hand_made_clips", with_words(f""", {SPECS}, d AS (SELECT video_id, max(e_ms) AS dur FROM words GROUP BY 1),
c AS (SELECT sn.video_id, rank, greatest(a, 0) AS a, least(b, dur) AS b, hook FROM sn JOIN d USING (video_id) WHERE rank >= 1 AND n = 1),
t AS (SELECT c.video_id, rank, array_to_string((list(w ORDER BY pos))[1:14], ' ') AS said FROM c JOIN words w ON w.video_id = c.video_id AND e_ms > a AND s_ms < b WHERE b - a >= 1000 GROUP BY 1, 2)
SELECT c.video_id, c.rank, a AS start_ms, b AS end_ms, coalesce(hook, said) AS hook, 'T' AS title, 'tiktok' AS style, 'custom' AS source FROM c JOIN t USING (video_id, rank)"""))
def hand_made_clips(spark, sf):
    w = td.words(spark, sf)
    good, _ = G.check_edit_specs(specs(spark, sf))
    return E.spec_clips(good, w, td.durations(w))[0].select("video_id", "rank", "start_ms", "end_ms", "hook", "title", "style", "source")


@query("focus_replies", """SELECT o_orderkey AS video_id, round(least(greatest(o_custkey % 300 / 200.0 - 0.2, 0), 1), 6)::DOUBLE AS x01, round(least(greatest(o_custkey % 7 / 5.0, 0), 1), 6)::DOUBLE AS zoom,
  CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE left(repeat(o_orderpriority || ' ', 30), 200) END AS reason FROM orders WHERE o_orderkey % 5 > 0""")
def focus_replies(spark, sf):
    """Replies in a fence, bare, and in prose; every third without a reason, every fifth without a zoom."""
    body = """concat('{"focus_x": ', format_string('%.4f', o_custkey % 300 / 200D - 0.2), if(o_orderkey % 5 = 0, '', concat(', "zoom": ', format_string('%.4f', o_custkey % 7 / 5D))),
      if(o_orderkey % 3 = 0, '', concat(', "reason": "', repeat(concat(o_orderpriority, ' '), 30), '"')), '}')"""
    reply = f"CASE o_orderkey % 3 WHEN 0 THEN {body} WHEN 1 THEN concat('Here it is:\n```json\n', {body}, '\n```\nDone.') ELSE concat('I would say ', {body}, ' fits.') END"
    r = G.focus_replies(td.table(spark, sf, "orders").select(F.col("o_orderkey").alias("video_id"), F.expr(reply).alias("reply")))
    return r.withColumns({c: F.round(c, 6) for c in ("x01", "zoom")})


@query("crop_points", "SELECT o_orderkey AS video_id, i, i * 500 AS t_ms, o_custkey::DOUBLE + i AS x FROM orders, (SELECT unnest(range(0, 2)) AS i) WHERE o_orderkey % 3 > 0")
def crop_points(spark, sf):
    doc = "if(o_orderkey % 3 > 0, concat('{\"tracks\":[{\"t\":0.0,\"x\":', o_custkey, '},{\"t\":0.5,\"x\":', o_custkey + 1, '}]}'), '{\"tracks\":[]}')"
    return G.crop_plans(td.table(spark, sf, "orders").select(F.col("o_orderkey").alias("video_id"), F.expr(doc).alias("doc")))


@query("reply_candidates", "SELECT event_id AS video_id, 0 AS cand, CAST(round(value * 1000) AS BIGINT) AS start_ms, CAST(round(value * 1000) AS BIGINT) + 20000 AS end_ms, 'h' || event_id AS hook, 70 AS hook_score FROM events WHERE event_id % 5 < 4")
def reply_candidates(spark, sf):
    clip = "concat('{\"start_s\":', value, ',\"end_s\":', value + 20, ',\"hook_line\":\"h', event_id, '\",\"scores\":{\"hook\":7,\"retention\":6,\"value\":5,\"share\":4}}')"
    body = f"concat('{{\"clips\":[', {clip}, ']}}')"
    reply = f"""case event_id % 5 when 0 then {body} when 1 then concat('[', {clip}, ']') when 2 then concat('Sure:\\n```json\\n[1,\\n``` or ```\\n{{no\\n``` so\\n```json\\n', {body}, '\\n```\\nDone.')
      when 3 then concat('Here it is ', {body}, ' bye') else 'no json here' end"""
    r = td.table(spark, sf, "events").select(F.col("event_id").alias("video_id"), F.expr(reply).alias("reply"))
    return G.reply_candidates(r).select("video_id", "cand", "start_ms", "end_ms", "hook", F.col("scores.hook").alias("hook_score"))


@query("uncached_media", "SELECT doc_id AS video_id FROM documents WHERE NOT (doc_id % 2 = 0 AND lang = 'en')")
def uncached_media(spark, sf):
    d = td.table(spark, sf, "documents").select(F.col("doc_id").alias("video_id"), F.col("n_chars").alias("size"), "lang", "doc_id")
    cache = d.filter("doc_id % 2 = 0").select("video_id", "size", F.lit("en").alias("lang"), F.lit(5).alias("n_words"))
    return G.cached_and_new(d, cache, ["video_id", "size", "lang"])[1].select("video_id")


@query("caption_fixes", with_words("""
SELECT video_id, pos, CASE WHEN pos % 50 = 3 THEN 'fixed' ELSE w END AS w FROM words WHERE pos % 50 <> 4"""))
def caption_fixes(spark, sf):
    w = td.words(spark, sf)
    fixes = w.filter("pos % 50 in (3, 4)").select("video_id", F.col("pos").alias("fix"), (F.col("s_ms") + 7).alias("s_ms"), F.expr("if(pos % 50 = 3, ' fixed ', ' ')").alias("w"))
    return E.apply_fixes(w, fixes)[0].select("video_id", "pos", "w")


@query("transcript_agreement", with_words("""
, k AS (SELECT DISTINCT video_id, lower(w) AS l FROM words), o AS (SELECT video_id - 1 AS video_id, lower(w) AS l, e_ms FROM words)
SELECT o.video_id, count(k.l) AS hits, count(*) AS words, abs(max(o.e_ms) - max(e.e)) AS end_gap_ms FROM o LEFT JOIN k ON k.video_id = o.video_id AND k.l = o.l JOIN (SELECT video_id, max(e_ms) AS e FROM words GROUP BY 1) e ON e.video_id = o.video_id GROUP BY 1"""))
def transcript_agreement(spark, sf):
    """Each talk against the next one's words."""
    a = td.words(spark, sf)
    return E.agreement(a, a.withColumn("video_id", F.col("video_id") - 1))


@query("upserted_clips", """WITH o AS (SELECT l_orderkey AS video_id, l_linenumber AS rank, max(l_quantity) AS q FROM lineitem GROUP BY 1, 2)
SELECT video_id, rank, CASE WHEN rank % 2 = 0 THEN q + 100 ELSE q END AS q FROM o UNION ALL SELECT DISTINCT video_id, 99, 1.0 FROM o WHERE rank = 2""")
def upserted_clips(spark, sf):
    o = td.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("video_id"), F.col("l_linenumber").alias("rank")).agg(F.max("l_quantity").alias("q"))
    fresh = o.filter("rank % 2 = 0").withColumn("q", F.col("q") + 100)
    added = o.filter("rank = 2").select("video_id", F.lit(99).alias("rank"), F.lit(1.0).alias("q"))
    return E.upsert(o, fresh.unionByName(added), ["video_id", "rank"])


def fresh_folder(spark):
    return f"{checkpoint_dir(spark)}/cuewise/stream-{uuid.uuid4().hex}"


def streamed_table(spark, df, order, parts=3, closing=None, stored=False, together=()):
    """A table written to the shared folder in the order of a column, ``parts`` writes one after another, and read
    back as a stream of one such write per micro-batch. ``closing`` is a last row, whose time ends every
    open window. ``stored`` says that ``df`` only reads a stored table; rows equal in ``together`` share a file."""
    path, files = fresh_folder(spark), int(spark.conf.get("spark.sql.shuffle.partitions"))
    df = df if stored else cut(df)
    along = F.col(order).cast("double")
    at = df.select(F.percentile_approx(along, [k / parts for k in range(1, parts)]).alias("p")).first()["p"] or []
    part = sum((F.when(along > F.lit(x), 1).otherwise(0) for x in at), F.lit(0))
    for k in range(parts):
        df.filter(part == k).repartition(files, *together).write.mode("append").parquet(path)
        # A micro-batch takes as many files, whatever they hold: a write that has fewer would let rows of the next in, and with them its watermark.
        for _ in range((k + 1) * files - len(spark.read.schema(df.schema).parquet(path).inputFiles())):
            spark.createDataFrame([], df.schema).coalesce(1).write.mode("append").parquet(path)
    if closing is not None:
        spark.createDataFrame([closing], df.schema).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(path)


@query("streamed_clip_states", f"WITH {CLIP_STATES} SELECT * FROM clip_states")
def streamed_clip_states(spark, sf):
    s = streamed_table(spark, td.job_events(spark, sf), "event_id")
    return live.run_once(live.clip_states(s), fresh_folder(spark), ["job", "rank"], "update")


@query("streamed_percents", """WITH """ + CLIP_STATES + """, p AS (SELECT *, lag(pct) OVER (PARTITION BY job, rank, type ORDER BY event_id) AS was FROM job_events WHERE type IN ('clip_track', 'clip_render'))
SELECT job, rank, type, event_id, pct FROM p WHERE was IS NULL OR was <> pct""")
def streamed_percents(spark, sf):
    last = (-1, -1, FAR, "clip_track", 0, 0)
    s = streamed_table(spark, td.job_events(spark, sf), "event_id", closing=last)
    return live.run_once(live.changed_percents(s, keep_ms=MONTHS), fresh_folder(spark), [], "append").filter("job >= 0")


def streamed_records(spark, sf):
    """The change log of all job records."""
    last = (-1, -1, FAR, "stage", "done", None, None, None, None, None, None)
    return ordered.job_records(streamed_table(spark, td.record_events(spark, sf), "event_id", closing=last), live.WATERMARK, MONTHS)


@query("streamed_job_records", f"WITH {RECORDS} {RECORD_ROWS}")
def streamed_job_records(spark, sf):
    """The records that hold after the last change, put together from the log."""
    now = cut(ordered.current_records(live.run_once(streamed_records(spark, sf), fresh_folder(spark), [], "append")))
    status = now.filter("what = 'job'").select("job", "status")
    files = now.filter("what = 'variant'").groupBy("job", "rank").agg(F.array_sort(F.collect_list(F.struct("aspect", "file"))).alias("variants"))
    clips = now.filter("what = 'clip'").select("job", "rank", "rev", "track_pct", "render_pct", "render_status")
    return record_rows(status.join(clips, "job").join(files, ["job", "rank"], "left"))


@query("streamed_status_counts", f"WITH {RECORDS} SELECT status, count(*) AS n FROM js GROUP BY 1")
def streamed_status_counts(spark, sf):
    counts = live.run_once(ordered.status_counts(streamed_records(spark, sf)), fresh_folder(spark), ["status"], "append")
    return counts.filter("n > 0")


@query("streamed_text_windows", with_words("SELECT video_id, s_ms // 10000 AS bucket, string_agg(w, ' ' ORDER BY pos) AS text, count(*) AS n_words FROM words GROUP BY 1, 2"))
def streamed_text_windows(spark, sf):
    w = td.words(spark, sf).select("video_id", "pos", "w", F.timestamp_millis("s_ms").alias("ts"))
    stream = streamed_table(spark, w.withColumn("block", F.expr("pos div 256")), "ts", stored=True, together=NEAR)
    out = live.run_once(live.text_windows(stream), fresh_folder(spark), ["video_id", "win"], "update")
    return out.select("video_id", (F.unix_millis("win.start") / 10000).cast("long").alias("bucket"), "text", "n_words")


@query("streamed_lines", with_words("""
, g AS (SELECT *, s_ms - lag(s_ms) OVER (PARTITION BY video_id ORDER BY pos) AS gap FROM words), i AS (SELECT *, sum(CASE WHEN gap >= 1000 OR gap IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY pos) AS k FROM g)
SELECT video_id, min(pos) AS pos, count(*) AS n_words FROM i GROUP BY video_id, k"""))
def streamed_lines(spark, sf):
    w = td.words(spark, sf).select("video_id", "pos", F.timestamp_millis("s_ms").alias("ts"))
    stream = streamed_table(spark, w.withColumn("block", F.expr("pos div 256")), "ts", closing=(-1, 0, FAR, 0), stored=True, together=NEAR)
    lines = live.run_once(live.spoken_lines(stream), fresh_folder(spark), [], "append")
    return lines.filter("video_id >= 0").select("video_id", "pos", "n_words")
