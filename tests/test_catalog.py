"""A cross-section of the registered queries equals DuckDB on the smallest tables.

``python tests/check.py`` compares all of them.
"""

import os

import pytest

from check import compare, connect

SF = "/root/testdata/sf0.001"
NAMES = """sentences top_sentences keywords focus_sentences clips merit_clips complete_candidates punchy_keeps
punchy_removed retimed_words srt_cues subtitle_lines chapters clip_hashtags confirmed_faces suppressed_faces
presence_runs loudness quiet_points judge_answers verdict_reasons clip_states reloaded_jobs recogniser_words
reply_candidates caption_fixes streamed_clip_states streamed_text_windows""".split()


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_duckdb(spark, con, name):
    from cuewise.catalog import ORACLES, QUERIES

    assert compare(con, QUERIES[name](spark, SF), ORACLES[name]) == ""


def test_every_query_is_described():
    from cuewise.catalog import ORACLES, QUERIES

    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) > 120
