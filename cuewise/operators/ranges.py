"""Range texts, time filters and topic mentions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuewise.functions.text import tokens

PREVIEW_MAX_S = 3600.0


def transcript_between(words: DataFrame, from_ms: int, to_ms: int) -> DataFrame:
    return words.filter(F.col("s_ms").between(from_ms, to_ms))


def _ms(text: Column) -> Column:
    return F.trim(text).try_cast("double") * 1000


def _bounds(a: Column, b: Column, duration: Column) -> tuple[Column, Column]:
    lo = F.greatest(F.least(a, b), F.lit(0.0))
    hi = F.least(F.greatest(a, b), duration)
    return F.round(lo).cast("long"), F.round(hi).cast("long")


def parse_ranges(df: DataFrame, text: str, duration: str, min_ms: int = 3000) -> DataFrame:
    """One row per ``A-B`` of a comma list, in seconds: ordered, clamped, at least 3 s."""
    rows = df.withColumn("__p", F.explode(F.split(text, ",")))
    parts = F.split("__p", "-")
    a, b = _ms(F.get(parts, 0)), _ms(F.get(parts, 1))
    lo, hi = _bounds(a, b, F.col(duration))
    rows = rows.filter(a.isNotNull() & b.isNotNull()).withColumn("a_ms", lo).withColumn("b_ms", hi)
    return rows.filter(F.col("b_ms") - F.col("a_ms") >= min_ms).drop("__p")


def parse_span(df: DataFrame, text: str, duration: str, min_ms: int = 5000) -> DataFrame:
    """One ``A-B`` span; the whole video when it is malformed or under 5 s."""
    parts = F.split(text, "-")
    a, b = _ms(F.get(parts, 0)), _ms(F.get(parts, 1))
    lo, hi = _bounds(a, b, F.col(duration))
    ok = F.coalesce(a.isNotNull() & b.isNotNull() & (hi - lo >= min_ms), F.lit(False))
    return df.withColumn("a_ms", F.when(ok, lo).otherwise(F.lit(0).cast("long"))).withColumn(
        "b_ms", F.when(ok, hi).otherwise(F.col(duration).cast("long"))
    )


def preview_window(df: DataFrame) -> DataFrame:
    """Safe ``(start_s, len_s, t)``: bad starts are 0, the window is at most an hour, ``t`` lies
    inside; rows without a length are rejected."""
    inf = float("inf")

    def finite(c: str) -> Column:
        return ~F.isnan(c) & ~F.col(c).isin(inf, -inf)

    ok = df.filter(finite("len_s") & (F.col("len_s") > 0))
    length = F.least("len_s", F.lit(PREVIEW_MAX_S))
    start = F.when(finite("start_s"), F.greatest("start_s", F.lit(0.0))).otherwise(0.0)
    t = F.when(finite("t"), F.least(F.greatest("t", F.lit(0.0)), length)).otherwise(0.0)
    rest = [c for c in df.columns if c not in ("start_s", "len_s", "t")]
    return ok.select(*rest, start.alias("start_s"), length.alias("len_s"), t.alias("t"))


def mentions(texts: DataFrame, doc: str, text: str, terms: DataFrame) -> DataFrame:
    """Distinct (term row, document) pairs where a document mentions a term of a term table.

    Documents become distinct tokens. A term of at most 3 characters equals a token; a longer one
    meets the tokens sharing its first 4 characters and must start them.
    """
    token = texts.select(doc, F.explode(F.array_distinct(tokens(text))).alias("__token"))
    short = terms.filter(F.char_length("term") <= 3).distinct()
    long = terms.filter(F.char_length("term") > 3).distinct()
    equal = token.join(short, F.col("__token") == F.col("term"))
    starts = token.join(
        long,
        (F.substring("__token", 1, 4) == F.substring("term", 1, 4))
        & F.col("__token").startswith(F.col("term")),
    )
    return equal.unionByName(starts).drop("term", "__token").distinct()
