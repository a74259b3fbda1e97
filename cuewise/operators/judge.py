"""Judge answers: softmax, confidence, verdicts, scorecards, reasons; a pluggable judge."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuewise.functions.fixed_values import JUDGE_MAX
from cuewise.functions.text import col
from cuewise.sources.staging import cut

TOPICS = [("hook", "strong opening hook", "slow opening"), ("value", "clear payoff", "light payoff"),
          ("standalone", "stands on its own", "needs context"),
          ("complete", "ends on a finished thought", "ends mid-point"),
          ("share", "likely to be shared", "low share pull")]


def _held(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once; named in a lambda's body it would be computed again for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def softmax(z, temperature) -> Column:
    scaled = F.transform(col(z), lambda v: v / col(temperature))
    e = _held(scaled, lambda s: _held(F.array_max(s), lambda top: F.transform(s, lambda v: F.exp(v - top))))
    return _held(e, lambda e: _held(F.aggregate(e, F.lit(0.0), lambda a, v: a + v), lambda total: F.transform(e, lambda v: v / total)))


def confidence(p) -> Column:
    """One minus the normalised entropy; 1 with fewer than two options."""
    p = col(p)
    ent = F.aggregate(p, F.lit(0.0), lambda a, x: a - x * F.ln(F.greatest(x, F.lit(1e-12))))
    return F.when(F.size(p) < 2, 1.0).otherwise(1.0 - ent / F.ln(F.size(p)))


def choice(p) -> Column:
    """Index of the largest probability, the last on ties."""
    return F.array_max(F.transform(col(p), lambda x, i: F.struct(x.alias("x"), i.alias("i"))))["i"]


def expected_level(p) -> Column:
    return F.aggregate(F.transform(col(p), lambda x, i: x * i), F.lit(0.0), lambda a, x: a + x)


def verdicts(answers: DataFrame, key: list[str]) -> DataFrame:
    """Answers ``(key, name, kind, p)`` to one row per candidate; a missing answer is 0.5."""
    level = expected_level("p") / F.greatest(F.size("p") - 1, F.lit(1))
    value = F.when(F.col("kind") == "score", F.least(F.greatest(level, F.lit(0.0)), F.lit(1.0))).otherwise(F.get("p", F.lit(1)))
    names = [n for n, _, _ in TOPICS]
    wide = answers.withColumn("v", value).groupBy(*key).pivot("name", [*names, "focus"]).agg(F.max("v"))
    return wide.select(*key, *[F.coalesce(n, F.lit(0.5)).alias(n) for n in names], "focus")


def _pct(x) -> Column:
    return F.least(F.greatest(F.round(x * 100), F.lit(1.0)), F.lit(100.0)).cast("int")


def verdict_scores() -> Column:
    return F.struct(_pct(F.col("hook")).alias("hook"), _pct(0.5 * F.col("standalone") + 0.5 * F.col("complete")).alias("retention"),
                    _pct(F.col("value")).alias("value"), _pct(F.col("share")).alias("share"))


def blend(model, verdict) -> Column:
    """Mean of a model's scorecard (0-10 moves to 0-100) and the verdict's."""
    def one(d: str) -> Column:
        m = col(model)[d]
        return F.round((F.when(m <= 10, m * 10).otherwise(m) + col(verdict)[d]) / 2.0).cast("int").alias(d)

    return F.struct(*[one(d) for d in ("hook", "retention", "value", "share")])


def why(by: str) -> Column:
    """Reasons from a verdict: the three strongest, and what is weak."""
    good = F.array(*[F.when(F.col(n) >= 0.6, F.struct((-F.col(n)).alias("v"), F.lit(i).alias("i"), F.concat(
        F.lit(f"{yes} ("), F.round(F.col(n) * 100).cast("long").cast("string"), F.lit("%)")).alias("t")))
        for i, (n, yes, _) in enumerate(TOPICS)])
    good = F.slice(F.array_sort(F.filter(good, lambda g: g.isNotNull())), 1, 3)
    text = F.array_join(F.transform(good, lambda g: g["t"]), ", ")
    weak = F.array_join(F.array(*[F.when(F.col(n) < 0.35, F.lit(no)) for n, _, no in TOPICS]), ", ")
    head = F.when(text == "", "No standout strengths").otherwise(F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, F.lit(2), F.length(text))))
    return F.concat(head, F.when(weak == "", "").otherwise(F.concat(F.lit("; watch for: "), weak)), F.lit(f". Judged by {by}."))


def judge_texts(candidates: DataFrame, words: DataFrame) -> DataFrame:
    """The text a candidate is judged on."""
    from cuewise.operators.candidates import range_text

    key = ["video_id", "cand"]
    candidates = cut(candidates.select(*key, "start_ms", "end_ms"))
    said = range_text(words, candidates, key, F.col("start_ms") - 50, F.col("end_ms") + 50, ends_by=F.col("end_ms") + 50, trim=True)
    secs = F.floor((F.greatest(F.col("end_ms") - F.col("start_ms"), F.lit(0)) + 500) / 1000)
    return candidates.join(said, key, "left").select(*key, F.concat(
        F.lit("Short video clip, "), secs.cast("string"), F.lit(" seconds. Transcript: "), F.coalesce("text", F.lit(""))).alias("state"))


def to_judge(candidates: DataFrame) -> DataFrame:
    """The candidates judged per video: at most 24, in the picker's order."""
    w = Window.partitionBy("video_id").orderBy("cand")
    return candidates.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= JUDGE_MAX).drop("__n")


def judge(candidates: DataFrame, words: DataFrame, ask: Callable[[Column], Column], by: str,
          from_model: bool = False) -> DataFrame:
    """Judge candidates with a user's ``ask(state) -> struct`` (a pandas UDF or an expression giving
    hook, standalone, complete, value, share in 0..1); the rest keep their scores."""
    key = ["video_id", "cand"]
    candidates = cut(candidates)
    chosen = to_judge(candidates)
    v = judge_texts(chosen, words).select(*key, ask(F.col("state")).alias("v")).select(*key, "v.*")
    v = v.select(*key, verdict_scores().alias("vs"), why(by).alias("vwhy"))
    rows = candidates.join(v, key, "left")
    fresh = F.when(F.col("scores").isNotNull() & F.lit(from_model), blend("scores", "vs")).otherwise(F.col("vs"))
    placeholder = F.col("why").isNull() | (F.trim("why") == "") | F.col("why").startswith("Offline heuristic")
    told = F.col("vs").isNotNull() & (F.lit(not from_model) | placeholder)
    return rows.withColumn("scores", F.when(F.col("vs").isNotNull(), fresh).otherwise(F.col("scores"))).withColumn(
        "why", F.when(told, F.col("vwhy")).otherwise(F.col("why"))).drop("vs", "vwhy")
