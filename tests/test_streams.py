"""Stateful streams: any order within the watermark, late rows, replayed batches, state that ends."""

import datetime as dt
import glob
import os
import random
import tempfile

import pytest

from cuewise.operators import jobs as J
from cuewise.streaming import live, ordered
from pyspark.sql import functions as F

SCHEMA = "job long, event_id long, ts timestamp, type string, stage string, ranks array<long>, redo boolean, rank long, pct long, aspect string, file string"
START = dt.datetime(2024, 1, 1)
END = (-1, -1, dt.datetime(2100, 1, 1), "stage", "done", None, None, None, None, None, None)


def events(n, seed, jobs=5):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        kind = rng.choice(["stage", "clips_picked", "clip_track", "clip_render", "clip_done", "clip_variant", "clip_track", "clip_variant", "job_done", "job_failed"])
        out.append((rng.randrange(jobs), i, START + dt.timedelta(minutes=i), kind, rng.choice(["download", "audio", "render", "kit", "merge", "done", "track"]),
                    sorted(rng.sample([1, 2, 3, 4], rng.randrange(4))), rng.random() < 0.3, rng.randrange(1, 4), rng.randrange(3), rng.choice(["9:16", "1:1"]), f"v{i}"))
    return out


@pytest.fixture
def source(spark):
    """Batches of rows as a stream, a file each, in the order given."""
    folders = []

    def make(batches, schema=SCHEMA):
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        folders.append(folder)
        for k, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/part{k}")
            for f in glob.glob(f"{folder}/part{k}/*.parquet"):
                os.makedirs(f"{folder}/in", exist_ok=True)
                at = f"{folder}/in/{k:03}.parquet"
                os.rename(f, at)
                os.utime(at, (1_700_000_000 + 10 * k,) * 2)
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in"), folder

    return make


def shuffled(rows, near=8, seed=1):
    """Rows out of order by less than ten minutes."""
    rng = random.Random(seed)
    return sorted(rows, key=lambda r: r[1] + rng.random() * near)


def halves(rows, n):
    return [rows[k * len(rows) // n: (k + 1) * len(rows) // n] for k in range(n)]


def record_set(df):
    text = lambda v: None if v is None else [(x["aspect"], x["file"]) for x in v]
    return sorted(((r.job, r.status, r.rank, r.rev, r.track_pct, r.render_pct, r.render_status, text(r.variants)) for r in df.collect()), key=repr)


def from_log(log):
    now = ordered.current_records(log)
    files = now.filter("what = 'variant'").groupBy("job", "rank").agg(F.array_sort(F.collect_list(F.struct("aspect", "file"))).alias("variants"))
    clips = now.filter("what = 'clip'").select("job", "rank", "rev", "track_pct", "render_pct", "render_status")
    return now.filter("what = 'job'").select("job", "status").join(clips, "job", "left").join(files, ["job", "rank"], "left")


def fold(rows):
    """Records by a plain loop over ordered rows."""
    out = {}
    for job, _, _, kind, stage, ranks, redo, rank, pct, aspect, file in sorted(rows, key=lambda r: r[1]):
        rec = out.setdefault(job, {"status": "queued", "clips": {}})
        clips = rec["clips"]
        clip = clips.get(rank)
        if kind == "stage":
            if stage in ("render", "merge", "kit"):
                rec["status"] = "clips_ready" if rec["status"] == "clips_ready" else "analyzing"
            elif stage != "done":
                rec["status"] = {"download": "downloading", "audio": "extracting", "track": "analyzing"}[stage]
        elif kind == "clips_picked":
            fresh = {r: [clips[r][0] if r in clips else 0, 0, 0, "pending", {}] for r in ranks}
            rec["clips"] = {**clips, **fresh} if redo else fresh
            rec["status"] = "clips_ready"
        elif kind == "clip_done":
            clips[rank] = [clip[0] + 1 if clip else 1, 100, 100, "done", clip[4] if clip else {}]
        elif kind == "clip_variant" and clip:
            clip[4][aspect] = file
        elif kind in ("clip_track", "clip_render") and clip:
            clip[1 if kind == "clip_track" else 2] = pct
            clip[3] = "rendering" if clip[3] == "pending" else clip[3]
        elif kind in ("job_done", "job_failed"):
            rec["status"] = kind[4:]
    rows = []
    for job, rec in out.items():
        rows += [(job, rec["status"], r, *c[:4], sorted(c[4].items()) or None) for r, c in rec["clips"].items()] or [(job, rec["status"], *(None,) * 6)]
    return sorted(rows, key=repr)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_batch_records_equal_the_fold(spark, seed):
    rows = events(120, seed)
    assert record_set(J.job_records(spark.createDataFrame(rows, SCHEMA))) == fold(rows)


def test_streamed_records_in_any_order_and_after_a_replay(spark, source):
    rows = events(150, 7)
    late = (2, 500, START, "job_failed", None, None, None, None, None, None, None)  # far behind the watermark of the third batch
    first, second, third = halves(shuffled(rows), 3)
    stream, folder = source([first, second, [*third, late], [END]])
    log = live.run_once(ordered.job_records(stream, "10 minutes"), folder, [], "append")
    assert record_set(from_log(log).filter("job >= 0")) == fold(rows)
    # The last batch is run again: its commit is taken back.
    commits = sorted(int(os.path.basename(f)) for f in glob.glob(f"{folder}/checkpoint/commits/[0-9]*"))
    before = sorted(map(repr, log.collect()))
    for f in (f"{commits[-1]}", f".{commits[-1]}.crc"):
        os.remove(f"{folder}/checkpoint/commits/{f}")
    again = live.run_once(ordered.job_records(stream, "10 minutes"), folder, [], "append")
    assert sorted(map(repr, again.collect())) == before


def test_live_counts_after_each_batch(spark, source):
    rows = events(120, 9, jobs=12)
    parts = halves(rows, 3)
    # A closing row per batch lets all of it pass.
    marks = [(-1, -k, START + dt.timedelta(minutes=40 * k + 39, hours=0, seconds=1) + dt.timedelta(minutes=10), "stage", "done", *(None,) * 6) for k in range(3)]
    batches = []
    for part, mark in zip(parts, marks):
        batches += [[*part], [mark]]
    stream, folder = source(batches)
    seen = {}

    def look(batch, n):
        for r in batch.collect():
            seen.setdefault(n, {})[r.status] = r.n

    q = ordered.status_counts(ordered.job_records(stream, "10 minutes").filter("job >= 0")).writeStream.outputMode("append").foreachBatch(look).option(
        "checkpointLocation", f"{folder}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    now, after = {}, []
    for n in sorted(seen):
        now = {k: v for k, v in {**now, **seen[n]}.items() if v}
        after.append(now)
    for k in range(3):
        whole = [r for part in parts[: k + 1] for r in part]
        want = {}
        for job in {r[0] for r in whole}:
            status = next(r[1] for r in fold([x for x in whole if x[0] == job]))
            want[status] = want.get(status, 0) + 1
        assert want in after


def test_state_of_silent_keys_ends(spark, source):
    rows = [(k, k, START + dt.timedelta(hours=k), "clip_track", None, None, None, 1, k % 3, None, None) for k in range(60)]
    stream, folder = source([*halves(rows, 4), [(-1, 99, START + dt.timedelta(hours=200), "clip_track", None, None, None, 1, 0, None, None)]])
    q = live.changed_percents(stream, keep_ms=3_600_000).writeStream.outputMode("append").foreachBatch(lambda b, n: b.count()).option(
        "checkpointLocation", f"{folder}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert max(kept) > 10 and kept[-1] <= 6


def test_percents_across_batches_and_out_of_order(spark, source):
    rows = [(1, k, START + dt.timedelta(minutes=k), "clip_track", None, None, None, 1, p, None, None) for k, p in enumerate([5, 5, 7, 7, 5, 5, 9, 9, 9, 2, 2, 9])]
    stream, folder = source([*halves(shuffled(rows, 5), 3), [END]])
    got = live.run_once(live.changed_percents(stream), folder, [], "append").filter("job >= 0").orderBy("event_id").collect()
    assert [(r.event_id, r.pct) for r in got] == [(0, 5), (2, 7), (4, 5), (6, 9), (9, 2), (11, 9)]


def test_settled_files_across_batches(spark, source):
    at = lambda poll: START + dt.timedelta(minutes=poll)
    sizes = {"old": [9, 9, 9, 9], "new": [None, 100, 250, 250], "empty": [None, 0, 0, 0], "gap": [None, 5, None, 5], "grows": [None, 1, 2, 3]}
    rows = [(p, s, k, at(k)) for p, every in sizes.items() for k, s in enumerate(every) if s is not None]
    rows.sort(key=lambda r: -r[2])  # the newest poll comes first
    schema = "path string, size long, poll long, ts timestamp"
    stream, folder = source([rows, [("", -1, 0, dt.datetime(2100, 1, 1))]], schema)
    got = live.run_once(live.settled_files(stream), folder, [], "append").collect()
    assert [(r.path, r.poll) for r in got] == [("new", 3)]


def test_clip_states_do_not_depend_on_the_order_of_batches(spark, source):
    """the state is a few maxima, so a batch of older events that comes last changes nothing it should not."""
    kinds = ["clip_track", "clips_picked", "clip_track", "clip_render", "clip_done", "clip_track", "clips_picked", "clip_render"]
    rng = random.Random(3)
    rows = [(k % 4, k, START + dt.timedelta(minutes=k), rng.choice(kinds), None, None, None, 1, k % 100, None, None) for k in range(80)]
    want = sorted(map(tuple, J.clip_states(spark.createDataFrame(rows, SCHEMA)).select("job", "rank", "rev", "track_pct", "render_pct", "render_status").collect()))
    first, second, third = halves(rows, 3)
    stream, folder = source([third, first, second])
    got = live.run_once(live.clip_states(stream), folder, ["job", "rank"], "update")
    assert want and sorted(map(tuple, got.select("job", "rank", "rev", "track_pct", "render_pct", "render_status").collect())) == want


def test_every_write_of_a_streamed_table_is_a_batch(spark):
    """a write with fewer rows than files lets no row of the next one in."""
    from cuewise.catalog.ingest import streamed_table

    files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df = spark.range(9).selectExpr("id", "id AS at", "id % 1 AS one")
    seen = []
    q = streamed_table(spark, df, "at", together=("one",)).writeStream.foreachBatch(lambda b, n: seen.append(sorted(r.id for r in b.collect()))).option(
        "checkpointLocation", tempfile.mkdtemp(prefix="spark-", dir="/tmp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert files > 1 and len(seen) == 3 and sum(seen, []) == list(range(9))
