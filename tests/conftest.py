import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from cuewise.session import local_session

    s = local_session(cores=4, partitions=4, memory="4g")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def make_words(spark):
    """Words half a second apart, 0.45 s long, from a text; ``pause`` adds a gap before a position."""
    def make(text, pause=None, video="v"):
        rows, t = [], 0
        for i, w in enumerate(text.split()):
            t += (pause or {}).get(i, 0)
            rows.append((video, i, w, t, t + 450, 0.9))
            t += 500
        return spark.createDataFrame(rows, "video_id string, pos long, w string, s_ms long, e_ms long, conf double")

    return make
