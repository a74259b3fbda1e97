"""Words stored in buckets of their chunks: what looks along a video moves no word."""

import pytest
from pyspark.sql import functions as F

from cuewise.operators import candidates as C
from cuewise.operators import intervals as I
from cuewise.operators import lines as L
from cuewise.operators import segment
from cuewise.operators import series as S
from cuewise.sources import testdata as td

TEXT = " ".join(("well this is a talk, no?" if k % 9 == 4 else "one two three. four") + " five" for k in range(2500))


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    rows = [(1, TEXT), (2, "Only a few words. Here they end."), (3, None), (4, ""), (5, " \n spaced  out ")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    return folder


def plan_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_the_stored_words_are_the_ingested_ones(spark, sf):
    want = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]
    got = td.words(spark, sf).filter("pos % 37 <> 11 and pos % 41 <> 7 and pos % 5 > 0").collect()
    for r in got:
        assert want[r.video_id - 1].strip(" ").split()[r.pos - (r.video_id == 5)] == r.w
    assert {r.chunk for r in got} == {0, 1, 2, 3} and all(r.chunk == r.pos // 4096 for r in got)
    assert td.words(spark, sf).filter("video_id = 4").collect()[0].w == "" and td.words(spark, sf).filter("video_id = 3").isEmpty()


def test_scans_move_one_row_a_chunk(spark, sf):
    plan = plan_of(segment.gap_before(td.words(spark, sf)).agg(F.sum("gap_ms")))
    # Carries go to the video and back; words stay.
    exchanges = [x for x in plan.split("Final Plan")[-1].split("Initial Plan")[0].splitlines() if "Exchange hashpartitioning" in x]
    assert "Bucketed: true" in plan and len(exchanges) <= 2, plan


@pytest.mark.parametrize("rule", [L.SUBTITLE, L.SRT, L.READABLE, L.BLOCK, L.caption_rule(4, 24)])
def test_lines_joined_where_they_are_packed(spark, sf, rule):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "700")
    try:
        w = td.words(spark, sf)
        packed = L.pack(w, rule)
        key = lambda df: sorted(map(tuple, df.select("video_id", "line", "text", "s_ms", "e_ms", "n_words").collect()))
        assert key(L.packed_lines(w, rule)) == key(L.line_rows(packed))
        assert key(L.packed_lines(w, rule, split=True)) == key(L.line_rows(L.split_at_sentences(packed)))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def rows_of(df):
    return sorted(map(tuple, df.select(sorted(df.columns)).collect()), key=repr)


def test_texts_of_ranges_read_chunks_where_they_lie(spark, sf):
    w = td.words(spark, sf)
    spans = w.filter("pos % 300 = 0").selectExpr("video_id", "pos AS cand", "s_ms - 40 AS start_ms", "s_ms + 70000 AS end_ms")
    for most in (None, 14):
        said = lambda x: C.range_text(x, spans, ["video_id", "cand"], F.col("start_ms"), F.col("end_ms"), max_words=most, ends_by=F.col("end_ms"))
        assert rows_of(said(w)) == rows_of(said(w.drop("chunk"))) and "Bucketed: true" in plan_of(said(w))
    assert rows_of(C.propose(w, 3)) == rows_of(C.propose(w.drop("chunk"), 3))


def test_cut_plans_and_the_tight_clock_read_chunks_where_they_lie(spark, sf):
    w = td.words(spark, sf)
    parts = w.groupBy("video_id").agg(F.max("e_ms").alias("d")).selectExpr("video_id", "explode(sequence(0L, d div 60000)) AS r", "d").selectExpr(
        "video_id", "r + 1 AS rank", "r * 60000 AS a_ms", "least(r * 60000 + 60000, d) AS b_ms")

    def all_of(x):
        p = I.tighten(parts, x, I.Tighten(mode="punchy"))
        k = I.keep_rows(p)
        here = ["chunk"] if "chunk" in x.columns else []
        wins = x.select("video_id", F.expr("s_ms div 60000 + 1").alias("rank"), F.col("pos").alias("win"), "s_ms", "e_ms", *here)
        return p.select("video_id", "rank", "mode", "tight_ms", "removed", "keeps"), I.retime(x, k), I.tight_clock(x, k, ["pos"], "e_ms"), I.map_forward(wins, k)

    for stored, plain in zip(all_of(w), all_of(w.drop("chunk"))):
        assert rows_of(stored) == rows_of(plain) and "Bucketed: true" in plan_of(stored)


def test_punctuation_across_a_chunk(spark):
    rows = [(1, k, "?" if 4090 <= k < 4100 and k > 4093 else f"w{k}", k * 500, k * 500 + 450, k // 4096) for k in range(4110)]
    w = spark.createDataFrame(rows, "video_id long, pos long, w string, s_ms long, e_ms long, chunk long")
    got = segment.attach_punctuation(w)
    assert rows_of(got) == rows_of(segment.attach_punctuation(w.drop("chunk")))
    assert got.filter("pos = 4093").collect()[0].w == "w4093??????"


def test_stamps_past_a_hundred_minutes_agree_with_their_sql(spark, sf):
    import duckdb

    from cuewise.catalog import ORACLES, QUERIES
    from tests.check import compare

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet/*.parquet'")
    assert QUERIES["stamps"](spark, sf).filter("minute like '1__:%'").count() > 0
    assert compare(con, QUERIES["stamps"](spark, sf), ORACLES["stamps"]) == ""


@pytest.mark.parametrize("smoothed", [False, True])
def test_loudness_stays_in_chunks(spark, sf, smoothed):
    e = td.chunked_energy(spark, sf)
    kept = S.smoothed_loudness(e) if smoothed else S.loudness(e)
    plain = S.loudness(e.drop("chunk"))
    plain = S.smooth(plain).select(kept.columns) if smoothed else plain
    values = lambda df: {(r.video_id, r.i): (r.t_ms, *[round(r[c], 9) for c in kept.columns[3:]]) for r in df.collect()}
    got = values(kept)
    assert got == values(plain) and len(got) == kept.count() > 20_000
    # Whatever goes to another task by time is an edge of a chunk; the levels of the rest are made where the words lie.
    tally = lambda df: sum(s.shuffleWriteRecords() for s in stages_of(spark, df))
    assert tally(kept) * 20 < tally(plain)


def stages_of(spark, df):
    """The stages that a query takes."""
    store = spark.sparkContext._jsc.sc().statusStore()

    def ids():
        none = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
        found = store.stageList(None, False, False, none, None)
        return {found.apply(k).stageId(): found.apply(k) for k in range(found.size())}

    before = set(ids())
    df.write.format("noop").mode("overwrite").save()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return [s for k, s in ids().items() if k not in before]


def test_validation_whatever_the_chunks(spark, sf):
    from cuewise.operators import validate as V

    w = td.words(spark, sf).drop("chunk").filter("video_id < 3").cache()
    at = w.filter("pos % 97 = 5").select("video_id", F.col("pos").alias("cand"), (F.col("s_ms") + 133).alias("start_ms"),
                                         (F.col("s_ms") + 3_000 + F.col("pos") % 11 * 10_000).alias("end_ms"))
    card = "cast(null as struct<hook:int,retention:int,value:int,share:int>) AS scores"
    cands = at.selectExpr("*", "'h' AS hook", "'' AS why", card, "cast(null as string) AS title", "cast(null as array<string>) AS hashtags",
                          "'karaoke' AS style", "'x' AS source")
    found = {}
    for size in (100_000, 4096, 60):
        chunked = w.withColumn("chunk", F.expr(f"pos div {size}"))
        out = V.validate(cands, chunked, td.durations(w), V.Rules())
        found[size] = sorted(map(tuple, out.select("video_id", "cand", "start_ms", "end_ms").collect()))
    assert found[100_000] == found[4096] == found[60] and len(found[60]) > 100


def test_validation_moves_no_word(spark, sf):
    from cuewise.operators import validate as V

    w = td.words(spark, sf)
    cands = C.propose(w, 5).localCheckpoint()
    n = w.count()
    assert n > 10_000
    assert max(s.shuffleWriteRecords() for s in stages_of(spark, V.validate(cands, w, td.durations(w)))) < n / 20


def records(spark, df):
    return sum(s.shuffleWriteRecords() for s in stages_of(spark, df))


def test_flashes_are_merged_by_line(spark, sf):
    w = segment.attach_punctuation(td.words(spark, sf), dealt=True)
    w = w.withColumn("e_ms", F.when(F.expr("pos % 3 = 0"), F.col("s_ms") + 40).otherwise(F.col("e_ms")))
    rule = L.LineRule(gap_ms=600, max_words=2, max_len=24, max_ms=4000)
    old = L.line_rows(L.merge_flashes(L.split_at_sentences(L.pack(w, rule)), 24))
    new = L.merge_flash_lines(L.packed_lines(w, rule, split=True), 24)
    assert rows_of(old) == rows_of(new)
    assert new.count() < L.packed_lines(w, rule, split=True).count()


def test_held_captions_and_respread_lines_move_lines(spark, sf):
    from cuewise.catalog import QUERIES

    n = td.words(spark, sf).count()
    assert max(s.shuffleWriteRecords() for s in stages_of(spark, QUERIES["held_captions"](spark, sf))) < n * 0.7
    assert max(s.shuffleWriteRecords() for s in stages_of(spark, QUERIES["respread_lines"](spark, sf))) < n * 0.5


def test_words_of_lines(spark, sf):
    w = td.words(spark, sf)
    lines = L.packed_lines(w, L.BLOCK).filter("line % 3 = 0")
    want = L.pack(w, L.BLOCK).filter("line % 3 = 0")
    assert rows_of(L.words_of_lines(lines, w)) == rows_of(want)


def test_recogniser_documents_move_sentences_once(spark, sf):
    from cuewise.catalog.ingest import recogniser_docs

    docs = recogniser_docs(spark, sf)
    assert records(spark, docs) < td.words(spark, sf).count() / 4
    got = {r.video_id: r.doc for r in docs.collect()}
    assert '"text":"  spaced"' not in got[5] and '"text":" ou"' in got[5] and '"tokens"' not in got.get(3, "") and "[_BEG_]" in got[1]


def test_open_lines_are_found_beside_their_words(spark, sf):
    w = td.words(spark, sf)
    # Packing alone moves no word, though a talk of several chunks takes rounds.
    assert records(spark, L.packed_lines(w, L.BLOCK)) < w.count() / 10
    before = L.cut
    sizes = []
    L.cut = lambda df: sizes.append(before(df)) or sizes[-1]
    try:
        L.packed_lines(w, L.BLOCK).count()
    finally:
        L.cut = before
    assert sizes and max(df.count() for df in sizes) < 100


def test_balanced_breaks_against_a_loop(spark):
    texts = ["aa bb cc dd ee ff gg", "one", "a  b   c and more of it", "x" * 30, "y" * 20 + " z", "", "ä ö ü und noch ein Wort", " leads with space and more"]

    def plain(t):
        ws = t.split(" ")
        if len(t) <= 18 or len(ws) < 2:
            return None
        return min((max(len(" ".join(ws[:i])), len(t) - len(" ".join(ws[:i])) - 1), i) for i in range(1, len(ws)))[1]

    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, t string").withColumn("b", L.balanced_break("t"))
    assert {r.k: r.b for r in df.collect()} == {k: plain(t) for k, t in enumerate(texts)}
    # The text is taken apart once, however many words it has.
    long = spark.createDataFrame([(" ".join(["word"] * 20_000),)], "t string").select(L.balanced_break("t").alias("b"))
    assert long.first().b == 10_000


def test_only_words_near_the_samples_leave_their_chunks(spark, sf):
    from cuewise.operators import presence as P

    at = spark.range(0, 40).selectExpr("1 + id % 2 AS video_id", "id AS frame", "id * 400 AS t_ms")
    w = td.words(spark, sf)
    got = P.speech_samples(at, w)
    assert rows_of(got) == rows_of(P.speech_samples(at, w.drop("chunk")))
    assert got.where("speech").count() > 0
    assert "__first" in plan_of(got) and "Bucketed: true" in plan_of(got)


def shuffled_rows(df):
    """Rows that the exchanges of a plan move, each counted once."""
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    seen, todo, n = set(), [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        p = todo.pop()
        name = p.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
            continue
        if name.endswith("QueryStageExec"):
            todo.append(p.plan())
            continue
        if name == "ShuffleExchangeExec" and p.id() not in seen:
            seen.add(p.id())
            n += p.metrics().apply("shuffleRecordsWritten").value()
        kids = p.children()
        todo += [kids.apply(i) for i in range(kids.size())]
    return n


def test_sentences_stay_in_their_chunks(spark, sf):
    """only the one that goes on in the next chunk moves."""
    w = td.words(spark, sf)
    assert rows_of(segment.sentences(w)) == rows_of(segment.sentences(w.drop("chunk")))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert shuffled_rows(segment.sentences(w)) < 100
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_complete_candidates_of_stored_words(spark, sf):
    w = td.words(spark, sf)
    got = C.propose_complete(w, 5)
    assert rows_of(got) == rows_of(C.propose_complete(w.drop("chunk"), 5)) and not got.isEmpty()


def test_tags_and_titles_count_words_in_their_chunks(spark, sf):
    """clips that cross chunks and clips that do not, against words without chunks."""
    from cuewise.catalog.texts import part_clips
    from cuewise.operators import kit as K

    w = td.words(spark, sf)
    # Four clips of video 1 reach over the edges of its four chunks and several of them.
    more = spark.createDataFrame([(1, 900, 0, 9_000_000), (1, 901, 2_000_000, 4_900_000), (2, 902, 0, 4_000)], "video_id long, rank long, start_ms long, end_ms long")
    clips = part_clips(w).unionByName(more, allowMissingColumns=True).withColumn("hook", F.coalesce("hook", F.lit("h"))).withColumn("why", F.lit("why"))
    for make in (K.titles, K.clip_hashtags, K.bodies):
        assert rows_of(make(clips, w)) == rows_of(make(clips, w.drop("chunk")))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        parts = part_clips(w)
        assert shuffled_rows(K.clip_hashtags(parts, w)) < shuffled_rows(K.clip_hashtags(parts, w.drop("chunk"))) / 5
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_chapters_move_a_row_a_chunk(spark, sf):
    """one row of steps per chunk, not one per word."""
    from cuewise.operators import outline as O

    w = td.words(spark, sf)
    d = td.durations(w)
    got = rows_of(O.chapters(w, d))
    assert got and got == rows_of(O.chapters(w.drop("chunk"), d))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert shuffled_rows(O.chapter_starts(w, d)) < 100
        assert shuffled_rows(O.titled(O.chapter_starts(w, d), w)) < 600
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_chapter_titles_with_capitals_of_several_letters_agree_with_their_sql(spark, tmp_path):
    """DuckDB's upper() makes one letter of ß, a full capital is SS."""
    import duckdb

    from cuewise.catalog import ORACLES, QUERIES
    from cuewise.catalog.sql import CAPITALS
    from tests.check import compare

    rows = [(k, " ".join([f"{c}heit", *["nicht"] * 30, "kam."] * 12)) for k, c in enumerate([*CAPITALS, "ä", "z", "É", "7"])]
    folder = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    got = QUERIES["chapters"](spark, folder)
    assert got.filter("title like 'SSheit%'").count() > 0 and got.select("video_id").distinct().count() == len(rows)
    assert compare(con, got, ORACLES["chapters"]) == ""


def test_a_long_segment_is_tiled_only_where_ranges_are(spark):
    """a first segment from 0 to a video late on a common clock."""
    from cuewise.operators import presence as P

    late = 10_000_000_000
    segs = [(1, 1, 0, 40_000_000, "wide"), (1, 2, 40_000_000, 40_006_000, "track"), (1, 3, 40_006_000, late, "wide"), (2, 1, 0, late, "track"), (3, 1, 0, 5_000, "wide")]
    ranges = [(1, 1, 39_995_000, 40_020_000), (1, 2, 40_020_000, 40_045_000), (2, 1, late - 9_000, late + 1_000), (3, 1, 5_000, 9_000), (4, 1, 0, 1_000)]
    s = spark.createDataFrame(segs, "video_id long, seg long, t0_ms long, t1_ms long, kind string")
    r = spark.createDataFrame(ranges, "video_id long, rank long, a_ms long, b_ms long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = P.clip_pieces(s, r)
        assert shuffled_rows(got) < 200
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(map(tuple, got.collect())) == [
        (1, 1, 0, 39_995_000, 40_000_000, "wide"), (1, 1, 1, 40_000_000, 40_006_000, "track"), (1, 1, 2, 40_006_000, 40_020_000, "wide"),
        (1, 2, 0, 40_020_000, 40_045_000, "wide"), (2, 1, 0, late - 9_000, late, "track"), (3, 1, 0, 5_000, 9_000, "track"), (4, 1, 0, 0, 1_000, "track")]


def test_runs_of_energy_say_what_its_hops_say(spark):
    # Three videos, one of two chunks; runs of 1 to 40 hops, some quiet.
    rows, hops = [], []
    for v in range(3):
        at = 0
        for k in range(160):
            n, ms = 1 + (k * 7 + v) % 40, 1e-9 if k % 3 == 2 else 0.01 * (1 + (k * k + v) % 9)
            chunk = int(v == 1 and k >= 80)
            rows.append((v, at, n, ms, chunk))
            hops += [(v, at + j, ms, chunk) for j in range(n)]
            at += n
    runs = spark.createDataFrame(rows, "video_id long, hop long, n long, ms double, chunk long")
    plain = spark.createDataFrame(hops, "video_id long, hop long, ms double, chunk long").drop("chunk")
    values = lambda df: sorted(tuple(round(x, 7) for x in r) for r in df.collect())
    assert values(S.loudness(runs)) == values(S.loudness(plain)) == values(S.loudness(runs.drop("chunk")))
    assert values(S.smoothed_loudness(runs)) == values(S.smoothed_loudness(plain))
    for above in (0.5, 3.0):
        found = values(S.energy_peaks(runs, above, 1500))
        assert found == values(S.peaks(S.loudness(plain), above, 1500)) and {r[0] for r in found} == {0, 1, 2}


def chunked_runs(spark):
    """Runs of energy of two videos, the first in three chunks, and the hops they stand for."""
    rows, hops = [], []
    for v in range(2):
        at = 0
        for k in range(150):
            n, ms = 1 + (k * 7 + v) % 23, 1e-9 if k % 3 == 2 else 0.01 * (1 + (k * k + v) % 9)
            rows.append((v, at, n, ms, k // 50 if v == 0 else 0))
            hops += [(v, at + j, ms) for j in range(n)]
            at += n
    return (spark.createDataFrame(rows, "video_id long, hop long, n long, ms double, chunk long"),
            spark.createDataFrame(hops, "video_id long, hop long, ms double"))


def spans_over(runs):
    """Spans of many lengths from before the first hop to past the last, some across chunks."""
    return runs.selectExpr("video_id", "hop * 10 AS id", "hop * 10 - 60 AS a_ms", "hop * 10 - 60 + (hop * 7) % 900 AS b_ms", "hop * 10 + 13 AS pref_ms", "chunk")


def test_levels_of_ranges_stay_in_chunks(spark):
    runs, hops = chunked_runs(spark)
    spans = spans_over(runs).drop("pref_ms")
    values = lambda df: sorted((r.video_id, r.id, round(r.db, 9)) for r in df.collect())
    want = values(S.range_level(spans.drop("chunk"), hops, ["id"]))
    assert values(S.range_level(spans, runs, ["id"])) == values(S.range_level(spans.drop("chunk"), runs, ["id"])) == want and len(want) == 300


def test_quiet_instants_stay_in_chunks(spark):
    runs, hops = chunked_runs(spark)
    spans = spans_over(runs)
    want = rows_of(S.quietest(spans.drop("chunk"), hops, ["id"]))
    assert rows_of(S.quietest(spans, runs, ["id"])) == rows_of(S.quietest(spans.drop("chunk"), runs, ["id"])) == want and len(want) == 300


def test_clips_are_settled_beside_their_words(spark, sf):
    from cuewise.operators import validate as V

    w = td.words(spark, sf)
    c = C.propose(w, 3)
    got = V.validate(c, w, td.durations(w))
    # Words do not go to Python by groups of a chunk, of which a corpus has millions.
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and plan.count("FlatMapCoGroupsInPandas") == 1
    assert rows_of(got) == rows_of(V.validate(c, w.drop("chunk"), td.durations(w))) != []


def test_edges_are_refined_beside_their_words(spark):
    # A talk in three chunks, the second of which begins inside a keep; pauses of several lengths.
    rows, at = [], 300
    for k in range(240):
        rows.append((7, k, f"w{k}", at, at + 300, k // 80))
        at += 300 + (40, 90, 700, 1900)[k * k % 4 if k % 5 else 3]
    w = spark.createDataFrame(rows, "video_id long, pos long, w string, s_ms long, e_ms long, chunk long").cache()
    hops = [(7, h, 0.01 if any(r[3] <= h * 10 < r[4] for r in rows[max(h * 10 // 2200 - 3, 0):]) else 1e-9 * (1 + h % 5)) for h in range(at // 10)]
    parts = spark.range(0, at, 20_000).selectExpr("7L AS video_id", "id div 20000 + 1 AS rank", "id AS a_ms", f"least(id + 20000, {at}L) AS b_ms").filter("b_ms - a_ms > 5000")
    energy = spark.createDataFrame(hops, "video_id long, hop long, ms double").cache()
    plans = I.tighten(parts, w.drop("chunk")).cache()
    moved = [I.refine_edges(I.keep_rows(plans), I.removed_rows(plans), x, energy) for x in (w, w.drop("chunk"))]
    for stored, plain in zip(*moved):
        assert rows_of(stored) == rows_of(plain) != []
    assert "FlatMap" not in plan_of(moved[0][0])


def test_streamed_loudness_of_tenths_is_that_of_hops(spark):
    from cuewise.streaming import live

    runs, hops = chunked_runs(spark)
    tenths = S.tenth_sums(runs)
    # Two rows for a tenth in two chunks.
    assert tenths.count() * 5 < hops.count()
    at = lambda c, ms: F.timestamp_millis(F.col(c) * ms).alias("ts")
    values = lambda df: sorted((r.video_id, r.win.start, round(r.ms, 12), r.hops) for r in df.collect())
    got = values(live.loudness_windows(tenths.select("video_id", "ms", "hops", at("c", 100))))
    assert got == values(live.loudness_windows(hops.select("video_id", "ms", at("hop", 10)))) and any(r[3] == 40 for r in got)
