"""Clip validation: snap, complete, guard, size, then greedy de-duplication and ranking.

Lookups that may reach far (nearest word, sentence end before or after) go to the ends of the video's chunks first and then to the words
of one chunk. What is left looks at most a few minutes around the start, so it runs on sorted arrays: beside the words of a chunk, or, where
it needs those of more, per (video, ten-minute tile). Words must be in time order.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuewise.functions.score import total_of, word_set, word_set_jaccard
from cuewise.functions.text import ends_sentence, hashtags, is_hook_filler, style_or
from cuewise.operators.scan import chunk_in, in_place
from cuewise.sources.staging import cut

TILE_MS = 600_000
REACH_BACK_MS = 2_000
STRETCH = 1 << 38
FAR = np.iinfo(np.int64).max // 4


@dataclass(frozen=True)
class Rules:
    min_ms: int = 15_000
    max_ms: int = 90_000
    pad_ms: int = 250
    complete_gate: bool = True
    hook_guard: bool = True
    gate_grow_ms: int = 30_000


def _around(points: DataFrame, words: DataFrame, axes: list[tuple[str, str, str]]) -> DataFrame:
    """What the words say before and after each point ``(video_id, cand, kind, axis, t)``: ``back`` the latest value at or before t, ``next`` the
    first after it.

    Each of the axes names the words' columns for the time, the value and the order of values. A chunk that ends before t or begins after it is
    known by its ends; only points inside a chunk are brought to its words, so no word moves.
    """
    key = ["video_id", "cand", "kind"]
    w = words.withColumn("chunk", chunk_in(words))
    ends = [F.struct(F.min(at).alias("lo"), F.max(at).alias("hi"), F.struct(F.min(o).alias("o"), F.min_by(v, o).alias("v")).alias("first"),
                     F.struct(F.max(o).alias("o"), F.max_by(v, o).alias("v")).alias("last")).alias(f"__{k}") for k, (at, v, o) in enumerate(axes)]
    cells = w.groupBy("video_id", "chunk").agg(*ends)
    # A row per chunk and axis, needed twice.
    cells = cut(cells.select("video_id", "chunk", F.posexplode(F.array(*[f"__{k}" for k in range(len(axes))])).alias("axis", "c"))
                .select("video_id", "chunk", "axis", "c.*"))
    met = points.join(cells, ["video_id", "axis"])
    far = met.groupBy(*key).agg(F.max(F.when(F.col("hi") <= F.col("t"), F.col("last"))).alias("back"),
                                F.min(F.when(F.col("lo") > F.col("t"), F.col("first"))).alias("next"))
    at, v, o = (F.element_at(F.array(*names), F.col("axis") + 1) for names in zip(*axes))
    near = w.join(met.filter("lo <= t and t < hi").select("chunk", *key, "axis", "t"), ["video_id", "chunk"])
    near = near.select("chunk", *key, (at <= F.col("t")).alias("early"), v.alias("v"), o.alias("o"))
    old, new = F.when(F.col("early"), F.col("o")), F.when(~F.col("early"), F.col("o"))
    # Single numbers, so that pairs stay in a hash aggregate.
    near = near.groupBy("chunk", *key).agg(F.max(old).alias("o0"), F.max_by("v", old).alias("v0"), F.min(new).alias("o1"), F.min_by("v", new).alias("v1"))
    near = near.select(*key, *[F.when(F.col(f"o{k}").isNotNull(), F.struct(F.col(f"o{k}").alias("o"), F.col(f"v{k}").alias("v"))).alias(name)
                               for k, name in enumerate(["back", "next"])])
    both = far.unionByName(near).groupBy(*key).agg(F.max("back")["v"].alias("back"), F.min("next")["v"].alias("next"))
    return points.join(both, key, "left")


def nearest_word_edges(candidates: DataFrame, words: DataFrame, pad_ms: int) -> DataFrame:
    """Snap padded starts to the nearest word start and ends to the nearest word end, the earlier
    one on ties."""
    a = F.greatest(F.col("s0") - pad_ms, F.lit(0))
    b = F.least(F.col("e0") + pad_ms, F.col("duration_ms"))
    points = candidates.select("video_id", "cand", F.posexplode(F.array(a, b)).alias("axis", "t")).withColumn("kind", F.col("axis"))
    found = _around(points, words, [("s_ms",) * 3, ("e_ms",) * 3])
    late = F.coalesce(F.col("next") - F.col("t") < F.col("t") - F.col("back"), F.lit(False))
    value = F.when(F.col("back").isNull() | late, F.col("next")).otherwise(F.col("back"))
    # Without words a point stays where it is.
    value = F.greatest(F.coalesce(value, "t"), F.lit(0))
    return found.groupBy("video_id", "cand").agg(
        F.max(F.when(F.col("kind") == 0, value)).alias("s1"), F.max(F.when(F.col("kind") == 1, value)).alias("e1"))


def sentence_marks(snapped: DataFrame, words: DataFrame) -> DataFrame:
    """Sentence ends around the snapped edges: ``se`` the first ending at or after ``e1``, ``sb``
    the last whose word starts at or before ``e1``, ``pe`` the last whose word starts 10 ms or
    more before ``s1``."""
    at = F.array(F.struct(F.lit(0).alias("axis"), (F.col("s1") - 10).alias("t")), F.struct(F.lit(0).alias("axis"), F.col("e1").alias("t")),
                 F.struct(F.lit(1).alias("axis"), (F.col("e1") - 1).alias("t")))
    points = snapped.select("video_id", "cand", F.posexplode(at).alias("kind", "x")).select("video_id", "cand", "kind", "x.*")
    found = _around(points, words.filter(ends_sentence("w")), [("s_ms", "e_ms", "pos"), ("e_ms",) * 3])
    marks = found.groupBy("video_id", "cand").agg(
        F.max(F.when(F.col("kind") == 0, F.col("back"))).alias("pe"),
        F.max(F.when(F.col("kind") == 1, F.col("back"))).alias("sb"),
        F.max(F.when(F.col("kind") == 2, F.col("next"))).alias("se"),
    )
    return snapped.join(marks, ["video_id", "cand"])


def _marked(words: DataFrame, tile: Column) -> DataFrame:
    return words.select("video_id", "pos", "s_ms", "e_ms", ends_sentence("w").alias("ends"), is_hook_filler("w").alias("filler"), tile)


def _at_home(snapped: DataFrame, words: DataFrame, reach_ms: int) -> DataFrame:
    """Add ``homes``, the chunks that hold words from 2 s before ``s1`` to ``reach_ms`` after it, ``tile``, the first of them, and ``before_s``,
    the last word start before that."""
    cells = words.groupBy("video_id", chunk_in(words).alias("chunk")).agg(
        F.min("s_ms").alias("lo"), F.max("s_ms").alias("last_s"), F.max(F.greatest("s_ms", "e_ms")).alias("hi"))
    earlier = Window.partitionBy("video_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("before_s", F.max("last_s").over(earlier))
    home = F.when((F.col("hi") >= F.col("s1") - REACH_BACK_MS) & (F.col("lo") <= F.col("s1") + reach_ms), F.col("chunk"))
    homes = snapped.join(cells, "video_id").groupBy("video_id", "cand").agg(
        F.collect_set(home).alias("homes"), F.coalesce(F.min(home), F.lit(-1)).alias("tile"), F.min_by("before_s", home).alias("before_s"))
    return cut(snapped.join(homes, ["video_id", "cand"]))


def _beside(apart: DataFrame, words: DataFrame, reach_ms: int) -> tuple[DataFrame, DataFrame]:
    """The candidates that need words of several chunks, with ``before_s`` moved to the last word start that is left out, and these words."""
    apart = apart.withColumn("tile", F.floor(F.col("s1") / TILE_MS))
    spans = apart.select("video_id", "tile", F.explode("homes").alias("chunk"), "s1").groupBy("video_id", "tile", "chunk").agg(
        (F.min("s1") - REACH_BACK_MS).alias("lo"), (F.max("s1") + reach_ms).alias("hi"))
    met = words.withColumn("chunk", chunk_in(words)).join(cut(spans), ["video_id", "chunk"])
    early = (F.col("e_ms") < F.col("lo")) & (F.col("s_ms") < F.col("lo"))
    skipped = met.filter(early).groupBy("video_id", "tile").agg(F.max("s_ms").alias("__s"))
    apart = apart.join(skipped, ["video_id", "tile"], "left").withColumn("before_s", F.greatest("before_s", "__s")).drop("__s")
    return apart, _marked(met.filter(~early & (F.col("s_ms") <= F.col("hi"))), F.col("tile"))


def _finish(rules: Rules):
    def per_cell(cand: pd.DataFrame, w: pd.DataFrame) -> pd.DataFrame:
        # All tiles of the cell at once: each gets its own stretch of one long time axis.
        tags = pd.concat([cand[["video_id", "tile"]], w[["video_id", "tile"]]])
        base = tags.groupby(["video_id", "tile"]).ngroup().to_numpy(np.int64) * STRETCH
        c_base, w_base = base[: len(cand)], base[len(cand):]
        order = np.lexsort((w["pos"].to_numpy(), w_base))
        w, w_base = w.iloc[order], w_base[order]
        s = w["s_ms"].to_numpy(np.int64) + w_base
        e = w["e_ms"].to_numpy(np.int64) + w_base
        ends, filler = w["ends"].to_numpy(bool), w["filler"].to_numpy(bool)
        n = len(w)
        # First non-filler at or after each word; sentinels close every array.
        idx = np.where(filler, n, np.arange(n))
        clear = np.minimum.accumulate(np.append(idx, n)[::-1])[::-1] if n else np.array([0])
        s_x, e_x = np.append(s, FAR), np.append(e, FAR)
        close_e = e[ends]

        a = cand["s1"].to_numpy(np.int64) + c_base
        b = cand["e1"].to_numpy(np.int64) + c_base
        dur = cand["duration_ms"].to_numpy(np.int64) + c_base

        def opt(col):
            v = cand[col]
            return v.fillna(-1).to_numpy(np.int64) + c_base, v.notna().to_numpy()

        if rules.complete_gate:
            (se, has_se), (sb, has_sb), (pe, has_pe) = opt("se"), opt("sb"), opt("pe")
            prev, has_prev = opt("before_s")
            reach = has_se & (se <= b + rules.gate_grow_ms) & (se - a <= rules.max_ms + rules.gate_grow_ms)
            trim = ~reach & has_sb & (sb - a >= rules.min_ms)
            b = np.where(reach, se, np.where(trim, sb, b))
            open_s = s_x[np.searchsorted(s, pe, "left")] if n else np.full(len(a), FAR)
            # A word between the sentence end and the tile's reach is too far back to move to.
            near = ~(has_prev & (prev >= pe))
            move = has_pe & near & (a - open_s <= 2000) & (open_s < b) & (open_s < FAR)
            a = np.where(move, open_s, a)
        if rules.hook_guard and n:
            i = np.searchsorted(e, a, "left")
            i_ok = (i < n) & (s_x[i] < b)
            limit = np.minimum(b, a + 4000)
            j = np.minimum(clear[np.minimum(i, n)], np.maximum(np.searchsorted(s, limit, "left"), i))
            shift = i_ok & (j > i) & (j < n) & (s_x[j] < b)
            a = np.where(shift, s_x[j], a)
        small = b - a < rules.min_ms
        want = a + rules.min_ms
        grown = np.minimum(e_x[np.searchsorted(e, want, "left")], dur)
        b = np.where(small, grown, b)
        still = small & (b - a < rules.min_ms)
        a = np.where(still, np.maximum(b - rules.min_ms, c_base), a)
        keep = ~(small & (b - a < rules.min_ms))
        big = b - a > rules.max_ms
        cap = a + rules.max_ms

        def last_at_most(v, hi):
            if not len(v):
                return np.full(len(hi), -FAR)
            k = np.searchsorted(v, hi, "right")
            return np.where(k > 0, v[np.maximum(k - 1, 0)], -FAR)

        sent = last_at_most(close_e, cap)
        sent_ok = (sent >= cap - 5000) & (sent > a)
        word = last_at_most(e, cap)
        word_ok = (word > a) & (word - a >= rules.min_ms)
        b = np.where(big, np.where(sent_ok, sent, np.where(word_ok, word, cap)), b)
        return pd.DataFrame({"video_id": cand["video_id"], "cand": cand["cand"], "s": a - c_base, "e": b - c_base, "__kept": keep})

    return per_cell


def validate(candidates: DataFrame, words: DataFrame, durations: DataFrame,
             rules: Rules = Rules()) -> DataFrame:
    """Validated candidates: final ``start_ms``/``end_ms`` (to 10 ms), cleaned fields, total."""
    dur = F.col("duration_ms")
    c = candidates.join(durations, "video_id").filter(dur > 0)
    clamp = lambda x: F.least(F.greatest(F.col(x), F.lit(0)), dur)
    c = c.withColumn("s0", clamp("start_ms")).withColumn("e0", clamp("end_ms")).filter("e0 > s0")
    # A few rows per video, needed by every lookup below.
    c = cut(c)
    span = c.select("video_id", "cand", "s0", "e0", "duration_ms")
    snapped = cut(nearest_word_edges(span, words, rules.pad_ms))
    snapped = sentence_marks(snapped, words)
    snapped = snapped.join(span.select("video_id", "cand", "duration_ms"), ["video_id", "cand"])
    reach = rules.max_ms + rules.gate_grow_ms + 5_000
    snapped = _at_home(snapped, words, reach)
    id_type = dict(candidates.dtypes)["video_id"]
    rest = ["video_id", "cand", "tile", "s1", "e1", "duration_ms", "se", "sb", "pe", "before_s"]

    settle = _finish(rules)

    def beside(cols, group, asked, own):
        cand, w = (pa.table(x).to_pandas() for x in (asked, cols))
        done = settle(cand, w)
        kept = done.pop("__kept").to_numpy(bool)
        done, at = done[kept], pa.array(np.flatnonzero(kept))
        return pa.record_batch([asked["video_id"].take(at), asked["cand"].take(at), *[pa.array(done[c], pa.int64()) for c in ("s", "e")]],
                               names=["video_id", "cand", "s", "e"])

    def apart(cands: DataFrame, near: DataFrame) -> DataFrame:
        # Many tiles are settled at once: a group of two tables takes longer to begin than most tiles to settle.
        near = near.join(cands.select("video_id", "tile").distinct(), ["video_id", "tile"], "left_semi")
        parts = 64 * int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        cell = F.pmod(F.xxhash64("video_id", "tile"), F.lit(parts)).alias("__cell")
        # Fresh column ids: the cogrouped sides share their source.
        left = cands.select(*[F.col(c).alias(c) for c in rest], cell)
        right = near.select(*[F.col(c).alias(c) for c in near.columns], cell)
        return left.groupBy("__cell").cogroup(right.groupBy("__cell")).applyInPandas(
            lambda c, w: (lambda out: out[out.pop("__kept")])(settle(c, w)), f"video_id {id_type}, cand long, s long, e long")

    # Most candidates see the words of one chunk alone and are settled where these lie; the rest with
    # what a ten-minute tile needs around the edge of a chunk. A candidate that no chunk is near to has no words.
    homes = F.size("homes")
    here = _marked(words, chunk_in(words).alias("tile"))
    final = in_place(here, snapped.filter(homes == 1).select(*rest), ["video_id", "tile"], "pos", beside, f"video_id {id_type}, cand long, s long, e long")
    final = final.unionByName(apart(*_beside(snapped.filter(homes != 1), words, reach)))
    hundredth = lambda x: (F.floor((F.col(x) + 5) / 10) * 10).cast("long")
    rest = c.drop("start_ms", "end_ms", "s0", "e0", "duration_ms")
    return rest.join(final, ["video_id", "cand"]).select(
        "video_id", "cand", hundredth("s").alias("start_ms"), hundredth("e").alias("end_ms"),
        F.substring(F.coalesce("hook", F.lit("")), 1, 200).alias("hook"),
        F.substring(F.coalesce("why", F.lit("")), 1, 500).alias("why"),
        total_of("scores").alias("score_total"), "scores", "title",
        F.coalesce(hashtags("hashtags"), F.array().cast("array<string>")).alias("hashtags"),
        style_or("style", "karaoke").alias("style"), "source",
    )


def greedy_distinct(rows: DataFrame, group: list[str], order: list[Column], item: list[str],
                    conflicts, count: int | None) -> DataFrame:
    """Keep rows best first, dropping those in conflict with a kept one, until ``count`` are kept.

    The fold runs on one group's ranked candidates: pickers propose at most three times the count.
    """
    ranked = rows.withColumn("__rn", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    rest = [c for c in rows.columns if c not in group and c not in item]
    # The whole row rides along, so the input is computed once.
    packed = ranked.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct(
        "__rn", *item, F.struct(*rest).alias("__rest")))).alias("__all"))
    empty = F.filter("__all", lambda x: F.lit(False))

    def step(kept: Column, x: Column) -> Column:
        clash = F.exists(kept, lambda k: conflicts(x, k))
        full = F.lit(False) if count is None else F.size(kept) >= count
        return F.when(full | clash, kept).otherwise(F.array_append(kept, x))

    kept = packed.select(*group, F.posexplode(F.aggregate("__all", empty, step)).alias("__i", "__k"))
    return kept.select(*group, *[F.col(f"__k.{c}").alias(c) for c in item],
                       *[F.col(f"__k.__rest.{c}").alias(c) for c in rest], (F.col("__i") + 1).cast("long").alias("rank"))


def same_moment(x: Column, k: Column) -> Column:
    """Over half of the shorter clip overlaps, or the hooks share over 80 % of their words."""
    overlap = F.least(x["end_ms"], k["end_ms"]) - F.greatest(x["start_ms"], k["start_ms"])
    shorter = F.greatest(
        F.least(x["end_ms"] - x["start_ms"], k["end_ms"] - k["start_ms"]), F.lit(1000))
    return (F.greatest(overlap, F.lit(0)) / shorter > 0.5) | (
        word_set_jaccard(x["hook_set"], k["hook_set"]) > 0.8)


def normalize(candidates: DataFrame, words: DataFrame, durations: DataFrame, count: int,
              rules: Rules = Rules()) -> DataFrame:
    """Validate, drop repeats in score order, keep ``count`` per video, rank from 1."""
    ok = validate(candidates, words, durations, rules).withColumn("hook_set", word_set("hook"))
    order = [F.desc("score_total"), F.col("cand")]
    out = greedy_distinct(ok, ["video_id"], order, ["start_ms", "end_ms", "hook_set"], same_moment, count)
    return out.drop("hook_set")


def merit_keep(clips: DataFrame, bar: float) -> DataFrame:
    """Clips at or above the bar; the best one where none is. Ranks restart from 1."""
    best = clips.filter((F.col("score_total") >= bar) | (F.col("rank") == 1))
    w = Window.partitionBy("video_id").orderBy("rank")
    # Rank 1 is the best, so when it passes every other passing clip follows it.
    return best.withColumn("rank", F.row_number().over(w).cast("long"))
