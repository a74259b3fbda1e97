"""Score columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cuewise.functions.text import col, has_digit

DIMENSIONS = ("hook", "retention", "value", "share")


def score_sentence(text, n_words) -> Column:
    """55 plus bonuses for a question, an exclamation, a digit and a good length; at most 92."""
    text = col(text)
    return score_signs(text.contains("?"), text.contains("!"), has_digit(text), n_words)


def score_signs(question, exclamation, digit, n_words) -> Column:
    """As :func:`score_sentence`, from what its text holds."""
    bonus = (
        F.when(col(question), 12).otherwise(0)
        + F.when(col(exclamation), 6).otherwise(0)
        + F.when(col(digit), 6).otherwise(0)
        + F.when(col(n_words).between(8, 25), 6).otherwise(0)
    )
    return F.least(F.lit(92), F.lit(55) + bonus)


def scorecard(score) -> Column:
    """A picker's four scores from one sentence score."""
    s = col(score).cast("int")
    return F.struct(s.alias("hook"), (s - 5).alias("retention"), (s - 8).alias("value"),
                    (s - 10).alias("share"))


def total_of(scores) -> Column:
    """Weighted total; 50 without a scorecard."""
    s = col(scores)
    total = 0.4 * s["hook"] + 0.25 * s["retention"] + 0.2 * s["value"] + 0.15 * s["share"]
    return F.when(s.isNull(), 50.0).otherwise(total)


def unify_scale(scores) -> Column:
    """A scorecard given on 0-10 moves to 0-100; any other passes through."""
    s = col(scores)
    small = F.lit(True)
    for d in DIMENSIONS:
        small = small & s[d].between(0, 10)
    up = F.struct(*[(s[d] * 10).alias(d) for d in DIMENSIONS])
    return F.when(small, up).otherwise(s)


def bump(scores, amount: int = 15) -> Column:
    """Topic bump on every dimension (missing counts as 50), at most 100."""
    s = col(scores)
    return F.struct(*[
        F.least(F.coalesce(s[d], F.lit(50)) + amount, F.lit(100)).cast("int").alias(d)
        for d in DIMENSIONS
    ])


def word_set_jaccard(a: Column, b: Column) -> Column:
    """Jaccard of two distinct-word arrays; two empty ones are alike."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def word_set(text) -> Column:
    return F.array_distinct(F.filter(F.split(col(text), r"\s+"), lambda t: t != ""))
