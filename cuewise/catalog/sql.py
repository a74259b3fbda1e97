"""Shared CTEs of the DuckDB checks."""

WORDS = r"""
toks AS (
  SELECT doc_id AS video_id, unnest(a) AS w0, unnest(range(0, len(a))) AS pos
  FROM (SELECT doc_id, string_split_regex(trim(text), '\s+') AS a FROM documents)),
toks2 AS (
  SELECT video_id, pos,
    CASE WHEN pos % 37 = 11 THEN 'Um,' WHEN pos % 41 = 7 THEN '100'
         WHEN pos % 5 = 0 AND right(w0, 1) = '.' THEN left(w0, length(w0) - 1) || '?'
         ELSE w0 END AS w
  FROM toks),
toks3 AS (
  SELECT *, CASE WHEN right(w, 1) IN ('.', '?', '!') THEN (CASE WHEN pos % 2 = 0 THEN 900 ELSE 1900 END)
                 WHEN right(w, 1) = ',' THEN 600 ELSE 0 END AS pause
  FROM toks2),
words AS (
  SELECT video_id, pos, w, s_ms, s_ms + 450 AS e_ms FROM (
    SELECT video_id, pos, w, CAST(pos * 500 + coalesce(sum(pause) OVER (
      PARTITION BY video_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
      AS BIGINT) AS s_ms FROM toks3))
"""

ENDS = "right({w}, 1) IN ('.', '!', '?', '…')"
EDGE = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"


def clean(w: str) -> str:
    return rf"lower(regexp_replace(trim({w}), '{EDGE}', '', 'g'))"


SENTENCES = WORDS + rf""",
sw0 AS (
  SELECT *, coalesce(max(CASE WHEN right(w, 1) IN ('.', '!', '?', '…') THEN pos + 1 END) OVER (
    PARTITION BY video_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS isl
  FROM words),
sw AS (SELECT *, isl + 30 * ((pos - isl) // 30) AS sent_start FROM sw0),
sentences AS (
  SELECT video_id, sent_start, CAST(count(*) AS BIGINT) AS n_words, min(s_ms) AS s_ms, max(e_ms) AS e_ms,
         string_agg(w, ' ' ORDER BY pos) AS text
  FROM sw GROUP BY 1, 2),
scored AS (
  SELECT *, CAST(least(92, 55 + CASE WHEN contains(text, '?') THEN 12 ELSE 0 END
     + CASE WHEN contains(text, '!') THEN 6 ELSE 0 END
     + CASE WHEN regexp_matches(text, '[0-9]') THEN 6 ELSE 0 END
     + CASE WHEN n_words BETWEEN 8 AND 25 THEN 6 ELSE 0 END) AS BIGINT) AS score
  FROM sentences)
"""


# Letters whose capital is several letters (ß is SS). DuckDB's upper() leaves them or knows another single letter.
CAPITALS = {c: c.upper() for c in map(chr, range(1 << 16)) if len(c.upper()) > 1}


def capitalized(t: str) -> str:
    """``t`` with its first letter as the full capital, as text.capitalize writes it."""
    several = " ".join(f"WHEN '{c}' THEN '{u}'" for c, u in CAPITALS.items())
    return f"CASE left({t}, 1) {several} ELSE upper(left({t}, 1)) END || substr({t}, 2)"


def with_words(body: str) -> str:
    return f"WITH {WORDS} {body}"


def with_sentences(body: str) -> str:
    return f"WITH {SENTENCES} {body}"


DETECTIONS = """
dets AS (
  SELECT l_orderkey // 1000 AS video_id, l_orderkey AS frame,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
                       l_extendedprice, l_shipdate) AS det,
    (l_linenumber - 1) * 260 + l_quantity AS x, 200 + l_tax * 1000 AS y,
    180 + l_quantity AS w, 200 + l_discount * 400 AS h, 0.5::DOUBLE + l_discount * 5 AS score
  FROM lineitem)
"""

JOB_EVENTS = """
job_events AS (
  SELECT user_id AS job, event_id, ts,
    CASE event_type WHEN 'view' THEN 'clip_track' WHEN 'click' THEN 'clip_render'
      WHEN 'signup' THEN 'clips_picked' WHEN 'purchase' THEN 'clip_done' ELSE 'job_failed' END AS type,
    event_id % 3 + 1 AS rank, CAST(floor(value) AS BIGINT) % 101 AS pct
  FROM events)
"""


def rec(sql: str) -> str:
    """The statement with recursive common table expressions allowed."""
    return "WITH RECURSIVE " + sql[len("WITH "):]
