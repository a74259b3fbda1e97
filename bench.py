"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from cuewise.catalog import QUERIES
from cuewise.session import local_session

HEADLINE = (
    "sentences top_sentences heuristic_candidates clips punchy_keeps retimed_words subtitle_lines srt_cues "
    "chapters clip_hashtags confirmed_faces suppressed_faces face_windows presence_runs loudness "
    "judge_answers clip_states fused_ranges redacted_documents"
).split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cores=cpus, partitions=cpus)
    spark.range(1000).selectExpr("sum(id)").collect()
    from cuewise.sources import testdata as td

    times = {}
    # The ingest (text to timed words, written once) is timed on its own.
    t0 = time.perf_counter()
    td.words(spark, sf_dir)
    times["ingest_words"] = round(time.perf_counter() - t0, 3)
    for name in HEADLINE:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
    }))


if __name__ == "__main__":
    main()
