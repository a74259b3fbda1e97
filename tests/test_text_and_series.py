"""Lines, headlines, ingest, series and streaming on small inputs."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from cuewise.functions import text as T
from cuewise.operators import kit as K
from cuewise.operators import lines as L
from cuewise.operators import outline as O
from cuewise.operators import series as S
from cuewise.plans import jobs as P
from cuewise.sources import ingest as G
from cuewise.streaming import live


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_focus_terms_and_mentions(spark):
    assert one(spark, T.focus_terms(F.lit("pricing, AI agents and the AI"))) == ["pric", "ai", "agent"]
    assert one(spark, T.mentions_any(F.lit("Our investors said"), ["invest"]))
    assert not one(spark, T.mentions_any(F.lit("He said again"), ["ai"]))
    assert one(spark, T.mentions_focus(F.lit("AI!"), F.array(F.lit("ai"))))


def test_redaction(spark):
    got = one(spark, T.redact(F.lit("sk-abcdefgh1 Bearer abcdefghij sk-abc mykey-123"), ["mykey-123"]))
    assert got == "sk-[REDACTED] Bearer [REDACTED] sk-abc [REDACTED]"


def test_flash_lines_merge_forward(spark, make_words):
    w = make_words("I'm kindergarten teacher. Raise")
    p = L.merge_flashes(L.split_at_sentences(L.pack(w, L.caption_rule(1, 40))), 24, short_ms=460)
    assert [r["text"] for r in L.line_rows(p).orderBy("line").collect()] == ["I'm kindergarten teacher.", "Raise"]


def test_two_line_cues(spark):
    text = "this line is certainly longer than forty two bytes"
    got = spark.createDataFrame([(text,)], "t string").select(L.two_lines("t").alias("x")).first()["x"]
    mid = len(text) // 2
    at = min((j for j, c in enumerate(text) if c == " "), key=lambda j: (abs(j - mid), j))
    assert got == text[:at] + "\n" + text[at + 1:]


def test_chapters_tidy(spark):
    rows = [("v", 65.4, "Second."), ("v", 3.0, "First:"), ("v", 70.0, "Too close"), ("v", 130.0, "Third"), ("v", 296.0, "End"), ("v", 90.0, " ")]
    df = spark.createDataFrame(rows, "video_id string, start_s double, title string")
    dur = spark.createDataFrame([("v", 300_000)], "video_id string, duration_ms long")
    got = [(r["start"], r["title"]) for r in O.tidy(df, dur).orderBy("n").collect()]
    assert got == [(0, "First"), (65, "Second"), (130, "Third")]


def test_headlines(spark):
    def pick(s):
        df = spark.createDataFrame([(s,)], "s string")
        return K.with_headline_candidate(df, "s", F.lit(0.0)).first()["headline"]

    assert pick("So, why do most startups fail?") == "why do most startups fail?"
    assert pick("It was the best day ever.") is None
    assert pick("You went there on Monday, right?") is None
    assert pick("No end mark here at all") is None
    df = spark.createDataFrame([("the secret of good soup is, in the end, patience and salt and time",)], "s string")
    assert K.with_headline_text(df, "s", "h").first()["h"] == "The secret of good soup is, in the end"


def test_word_pieces_join_as_bytes(spark):
    e = "é".encode()
    rows = [("v", 0, 0, b" It", 0, 100, 0.9), ("v", 0, 1, b"'d", 100, 200, 0.7), ("v", 0, 2, b" caf" + e[:1], 200, 300, None),
            ("v", 0, 3, e[1:], 300, 420, 0.5), ("v", 0, 4, b"[_TT_1]", 420, 420, 0.1), ("v", 0, 5, b" lost", None, None, 0.9),
            ("v", 0, 6, b"tail", 500, 600, 0.9), ("v", 1, 0, b"new", 700, 800, 0.8)]
    df = spark.createDataFrame(rows, "video_id string, seg long, tok int, piece binary, s_ms long, e_ms long, conf double")
    got = [(r["w"], r["s_ms"], r["e_ms"], r["conf"]) for r in G.join_pieces(df).orderBy("s_ms").collect()]
    assert got == [("It'd", 0, 200, 0.7), ("café", 200, 420, 0.5), ("new", 700, 800, 0.8)]


def test_stored_transcripts(spark, tmp_path):
    d = tmp_path / "talk1"
    d.mkdir()
    (d / "transcript.json").write_text('{"words":[{"w":"hi","s":0.5,"e":0.95,"conf":null}],"segments":[],"language":"en","model":"m"}')
    rows = G.document_words(G.read_transcripts(spark, str(tmp_path / "*" / "transcript.json"))).collect()
    assert [tuple(r) for r in rows] == [("talk1", 0, "hi", 500, 950, None)]


def test_high_pass_energy_is_the_same_in_chunks(spark):
    r = random.Random(4)
    x = [math.sin(i / 3) * 0.3 + r.random() * 0.1 for i in range(6000)]
    df = spark.createDataFrame([("v", i, v) for i, v in enumerate(x)], "video_id string, i long, x double")
    got = [v["ms"] for v in S.high_pass_energy(df, 16_000, chunk=1600).orderBy("hop").collect()]
    alpha, px, py, ys = math.exp(-2 * math.pi * 100 / 16_000), 0.0, 0.0, []
    for v in x:
        py = alpha * (py + v - px)
        px = v
        ys.append(py * py)
    want = [np.mean(ys[i: i + 160]) for i in range(0, 6000, 160)]
    assert np.allclose(got, want, rtol=1e-6, atol=1e-12)


def test_smoothing_and_hysteresis_across_chunks(spark):
    r = random.Random(6)
    xs = [r.random() for _ in range(50)]
    df = spark.createDataFrame([("v", i, x) for i, x in enumerate(xs)], "video_id string, i long, x double")
    got = [v["smoothed"] for v in S.exponential(df, "x", 0.15, chunk=7).orderBy("i").collect()]
    acc, want = None, []
    for x in xs:
        acc = x if acc is None else 0.15 * x + 0.85 * acc
        want.append(acc)
    assert np.allclose(got, want)
    flags = [r.random() < (0.8 if (i // 30) % 2 else 0.1) for i in range(200)]
    fl = spark.createDataFrame([("v", i, f) for i, f in enumerate(flags)], "video_id string, i long, face boolean")
    got = [(v["on"], v["edge"]) for v in S.hysteresis(fl).orderBy("i").collect()]
    on, yes, no, want = False, 0, 0, []
    for f in flags:
        yes, no = (yes + 1, 0) if f else (0, no + 1)
        was = on
        if not on and yes >= 4:
            on = True
        if on and no >= 8:
            on = False
        want.append((on, on != was))
    assert got == want


def test_peaks_stand_out_and_keep_their_distance(spark):
    rows = [("v", i, i * 100, -12.0 if i in (50, 51, 52, 70, 71, 120, 121, 122) else -30.0) for i in range(200)]
    df = spark.createDataFrame(rows, "video_id string, i long, t_ms long, db double")
    got = sorted(r["t_ms"] for r in S.peaks(df, 3.0).collect())
    assert len(got) == 2 and abs(got[0] - 5100) <= 200 and abs(got[1] - 12_100) <= 200


def test_a_translation_of_another_length_keeps_the_words(spark, make_words):
    w = make_words("one two three four. five six seven eight.")
    assert sorted(r["w"] for r in P.translate(w, lambda ls: ls[:-1]).collect()) == sorted("one two three four. five six seven eight.".split())
    up = P.translate(w, lambda ls: [x.upper() for x in ls]).orderBy("s_ms").collect()
    assert " ".join(r["w"] for r in up) == "ONE TWO THREE FOUR. FIVE SIX SEVEN EIGHT."


def test_settled_files(spark, tmp_path):
    polls = [("old", 5, 0), ("new", 3, 1), ("new", 9, 2), ("new", 9, 3), ("new", 9, 4), ("gone", 4, 1), ("gone", 4, 3), ("empty", 0, 1), ("empty", 0, 2)]
    # Polls carry their time; the last file ends the waiting for late ones.
    df = spark.createDataFrame(polls, "path string, size long, poll long").selectExpr("*", "timestamp_seconds((poll + 1) * 60) AS ts")
    df.union(spark.sql("SELECT '' AS path, -1L AS size, 0L AS poll, timestamp '2100-01-01' AS ts")).repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    got = live.run_once(live.settled_files(stream), str(tmp_path / "run"), [], "append").collect()
    assert [tuple(r) for r in got] == [("new", 3)]


def test_edit_documents_without_clips_are_rejected(spark):
    from cuewise.sources import ingest as G

    specs = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 0, "c")], "video_id long, rank long, hook string")
    good, bad = G.check_edit_specs(specs, spark.createDataFrame([(1,), (2,), (3,)], "video_id long"))
    assert sorted(r.rank for r in good.collect()) == [1, 2]
    assert {(r.video_id, r.reason) for r in bad.collect()} == {(2, "rank must be 1 or more"), (3, "no clips listed")}


def test_spans_that_render(spark):
    from cuewise.plans import jobs as P

    keeps = spark.createDataFrame([(1, 1, 0, 1004, 2000), (1, 1, 1, 3000, 4996)], "video_id long, rank long, k long, a_ms long, b_ms long")
    assert [tuple(r) for r in P.rendered_spans(keeps).collect()] == [(1, 1, 1000, 5000)]


def test_cut_plans_with_energy_render_whole_spans(spark):
    """Ten words with a second of silence after the fifth; energy of the words, quiet between them."""
    from cuewise.plans import jobs as P

    starts = [1000 + 500 * i + (1000 if i > 4 else 0) for i in range(10)]
    words = spark.createDataFrame([(1, i, f"w{i}", s, s + 450, 0.9) for i, s in enumerate(starts)],
                                  "video_id long, pos long, w string, s_ms long, e_ms long, conf double")
    loud = {h for s in starts for h in range(s // 10, s // 10 + 45)}
    energy = spark.createDataFrame([(1, h, 0.01 if h in loud else 1e-9) for h in range(800)], "video_id long, hop long, ms double")
    clips = spark.createDataFrame([(1, 1, 900, 7200)], "video_id long, rank long, start_ms long, end_ms long")
    plans = P.cut_plans(clips, words, energy=energy)
    rows = sorted((r.k, r.fa, r.fb) for r in plans.collect())
    assert len(rows) == 2 and all(fb > fa for _, fa, fb in rows)
    # No edge lies inside a word.
    for _, fa, fb in rows:
        assert not any(s < t * 100 / 3 < s + 450 for s in starts for t in (fa, fb))
    spans = [tuple(r) for r in P.rendered_spans(P.frame_times(plans, (30, 1))).collect()]
    first, last = rows[0][1] * 100 / 3, rows[-1][2] * 100 / 3
    assert spans == [(1, 1, round(first / 10) * 10, round(last / 10) * 10)]


def test_sentences_of_clips_end_only_at_marks(spark):
    from cuewise.operators import kit as K

    texts = {(1, 1): ["so"] * 40 + ["done."] + "Good soup needs salt and time. And then".split(),
             (1, 2): "Really? Yes! no mark here".split(), (2, 1): ["nothing", "ends"], (3, 1): ["Wait\u2026", "What?"]}
    rows = [(v, r, 100 + i, w, 500 * i, 500 * i + 450) for (v, r), ws in texts.items() for i, w in enumerate(ws)]
    words = spark.createDataFrame(rows, "video_id long, rank long, pos long, w string, s_ms long, e_ms long")
    want = []
    for (v, r), ws in texts.items():
        sent = []
        for i, w in enumerate(ws):
            sent.append((i, w))
            if w.endswith((".", "!", "?", "\u2026")):
                want.append((v, r, 100 + sent[0][0], sent[0][0] * 0.5, " ".join(x for _, x in sent)))
                sent = []
    got = K.spoken_sentences(words)
    assert sorted(tuple(x) for x in got.collect()) == sorted(want)
    hooks = spark.createDataFrame([(1, 1, "and"), (1, 2, "and"), (2, 1, "and")], "video_id long, rank long, hook string")
    assert [tuple(x) for x in K.headlines(hooks, got).collect()] == [(1, 1, "Good soup needs salt and time")]
