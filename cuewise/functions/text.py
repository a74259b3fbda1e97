"""Column functions on words and texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cuewise.functions import fixed_values as V

EDGE = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"
BARE_EDGE = r"^[^\p{L}\p{N}']+|[^\p{L}\p{N}']+$"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ends_with_any(c, marks: str) -> Column:
    out = F.lit(False)
    for m in marks:
        out = out | col(c).endswith(m)
    return out


def ends_sentence(c) -> Column:
    """The word closes a sentence."""
    return ends_with_any(c, ".!?…")


def ends_line_sentence(c) -> Column:
    """As :func:`ends_sentence`, without the ellipsis (outline, subtitle lines)."""
    return ends_with_any(c, ".?!")


def clean(c) -> Column:
    return F.lower(F.regexp_replace(F.trim(col(c)), EDGE, ""))


def bare(c) -> Column:
    return F.lower(F.regexp_replace(col(c), BARE_EDGE, ""))


def is_hook_filler(c) -> Column:
    return clean(c).isin(V.HOOK_FILLERS)


def is_keyword(c, sentence_start) -> Column:
    raw, t = F.trim(col(c)), clean(c)
    first = F.substring(raw, 1, 1)
    proper = (first != F.lower(first)) & (F.octet_length(t) > 1)
    return F.when(t == "", False).otherwise(
        t.rlike("[0-9]") | t.isin(V.POWER_WORDS) | (~col(sentence_start) & proper)
    )


def tokens(c) -> Column:
    """Lower-case alphanumeric tokens of a text."""
    return F.filter(F.split(F.lower(col(c)), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def _stem(w: Column) -> Column:
    out = None
    for suffix in V.FOCUS_SUFFIXES:
        hit = w.endswith(suffix) & (F.char_length(w) - len(suffix) >= 4)
        cut = F.substring(w, F.lit(1), F.char_length(w) - len(suffix))
        out = F.when(hit, cut) if out is None else out.when(hit, cut)
    return out.otherwise(w)


def focus_terms(c) -> Column:
    kept = F.filter(tokens(c), lambda t: ~t.isin(V.FOCUS_STOP))
    return F.array_distinct(F.transform(kept, _stem))


def mentions_focus(text, terms) -> Column:
    """Any token equals a short term or starts with a longer one."""
    terms = col(terms)
    return F.exists(
        tokens(text),
        lambda w: F.exists(
            terms, lambda t: F.when(F.char_length(t) <= 3, w == t).otherwise(w.startswith(t))
        ),
    )


def mentions_any(text, terms: list[str]) -> Column:
    """As :func:`mentions_focus` for a literal term list: one regex over the text."""
    if not terms:
        return F.lit(False)
    # Tokens are alphanumeric, so a term is matched at a token start (and end when short).
    alts = [f"{t}(?![\\p{{L}}\\p{{N}}])" if len(t) <= 3 else t for t in terms]
    return F.lower(col(text)).rlike(r"(?<![\p{L}\p{N}])(?:" + "|".join(alts) + ")")


def has_digit(c) -> Column:
    return col(c).rlike("[0-9]")


def joined(pairs, field: str = "w", sep: str = " ") -> Column:
    """Text of an ordered array of structs."""
    return F.array_join(F.transform(pairs, lambda x: x[field]), sep)


def words_in_order(order: str = "pos", word: str = "w", sep: str = " ") -> Column:
    """Aggregate: the group's words joined in order."""
    return joined(F.array_sort(F.collect_list(F.struct(F.col(order), F.col(word).alias("w")))),
                  "w", sep)


def capitalize(c) -> Column:
    c = col(c)
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, F.lit(2), F.char_length(c)))


def style_or(c, default: str) -> Column:
    return F.when(col(c).isin(V.STYLES), col(c)).otherwise(F.lit(default))


def hashtags(arr, limit: int = 8) -> Column:
    """``#tag`` forms of a picker's tags: trimmed, one leading ``#``, non-empty, first eight."""
    tags = F.transform(col(arr), lambda h: F.concat(F.lit("#"), F.ltrim(F.trim(h), F.lit("#"))))
    return F.slice(F.filter(tags, lambda h: F.octet_length(h) > 1), 1, limit)


def valid_language(c) -> Column:
    v = F.lower(F.trim(col(c)))
    return F.when((v == "auto") | v.rlike("^[a-z]{2,3}$"), v)


def valid_decider(c, names: list[str]) -> Column:
    """A known judge name (``auto`` and ``off`` always are), else NULL."""
    v = F.lower(F.trim(col(c)))
    return F.when(v.isin("auto", "off", *names), v)


def subtitle_target(c) -> Column:
    v = F.lower(F.trim(col(c)))
    return F.when((v != "") & ~v.isin("off", "none", "original"), v)


def is_url(c) -> Column:
    return F.trim(col(c)).rlike(r"^https?://[^/ ]*\.[^/ ]*(/[^ ]*)?$")


def host(c) -> Column:
    rest = F.regexp_replace(F.trim(col(c)), "^(https://)*(http://)*", "")
    name = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.regexp_replace(name, r"^(www\.)*(m\.)*", "")


def redact(c, keys: list[str] = ()) -> Column:
    """Blank out known keys, ``sk-`` tokens and bearer headers."""
    out = col(c)
    for k in keys:
        k = k.strip()
        if len(k.encode()) >= 8:
            out = F.replace(out, F.lit(k), F.lit("[REDACTED]"))
    return F.regexp_replace(out, r"(sk-|Bearer )[A-Za-z0-9_-]{8,}", "$1[REDACTED]")


def headline_choice(option, clip_title, job_title) -> Column:
    """Nothing without an option; the option's text, else the clip's title, else the job's."""
    def text(c):
        t = F.trim(col(c))
        return F.when(t != "", t)

    return F.when(col(option).isNotNull(),
                  F.coalesce(text(option), text(clip_title), text(job_title)))


def with_language_name(df, code: str, name: str):
    """Add the language's English name; unknown codes pass through."""
    table = df.sparkSession.createDataFrame(V.LANGUAGES, f"__code string, `{name}` string")
    out = df.join(F.broadcast(table), F.col(code) == F.col("__code"), "left")
    return out.withColumn(name, F.coalesce(name, code)).drop("__code")
