"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. Pass one classifies each block by its own measures: stop-word density, length and link
density make it good, near-good, short or bad; long blocks of few stop words count as short. Pass two decides the ambiguous ones: near-good and short blocks inherit the label of the nearest decided
neighbours, those of their own container first; a heading goes with what follows it. Text in elements that by name never hold an article
(menus, headers and footers of the page, sidebars, forms, scripts, notices, adverts, comments) is no block at all and votes for none.

The rules are the same inside and outside ``<article>`` and ``<main>``. The tag is a hint to two of them: inside it a long block of few stop words is near-good
instead of ambiguous, and where it holds good text, ambiguous blocks outside are bad. On a page without good blocks the near-good ones are taken for
good, or else the short ones. Stop words are those of the page's language, if listed, or of any; on a page that hardly has any of them, whose
language is not listed, the end of a sentence stands in for them.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuewise.llm.common import bounded_batches, pieces, query, table

# Frequent function words by language.
STOP_WORDS = {
    "en": "a about after all also an and are as at be been but by can for from had has have he her his i if in into is it its more no not of on one or other she so some such than that the their them then there these they this to up was we were what when which who will with would you".split(),
    "fr": "a au aux avec ce ces comme dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou par pas plus pour qu que qui sa se ses son sont sur un une vous y été être".split(),
    "de": "aber als am an auch auf aus bei das dass dem den der des die durch ein eine einem einen einer er es für hat ich ihr im in ist mit nach nicht noch nur oder sich sie sind so über um und von vor war was wie wir wird zu zum zur".split(),
    "es": "a al como con de del el ella en entre era es esta este ha hay la las le lo los más me mi muy no o para pero por que qué se si sin sobre su sus también te un una y ya yo".split(),
}
ANY = frozenset(w for words in STOP_WORDS.values() for w in words)
BLOCK_TAGS = frozenset(
    "address article aside blockquote body br button caption center col colgroup dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu "
    "nav noframes noscript ol optgroup option p pre section select summary table tbody td textarea tfoot th thead title tr ul".split())
#: br parts lines of one block, not blocks.
BREAKS = frozenset(["br"])
RAW = frozenset("script style noscript template svg math iframe object canvas textarea select title head".split())
ENDLESS = frozenset("script style textarea svg iframe".split())  # these run to the end of the page if they are not closed
SKIPPED = frozenset("nav aside footer form button menu dialog fieldset legend label".split()) | RAW
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
HOLDERS = frozenset("address article aside blockquote body center dd details dir div dl figure footer form header html main nav ol section table tbody td th tr ul".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
# What the last word of a class or id says. "post-comments" are comments, "side-effects" are no side.
BOILERPLATE = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notification popup modal overlay "
    "newsletter subscribe subscription signup login nav navbar navigation menu breadcrumb breadcrumbs pagination pager sidebar side widget widgets related recommended share "
    "sharing social comment comments commentlist disqus replies reply respond footer masthead copyright legal disclaimer skip toolbar tags search".split())
# Words that only say that it is a part of something: "comment-list" is comments.
NEUTRAL = frozenset("area bar block body box container content form group holder inner item items left link links list main outer panel post posts right row section text top bottom wrap wrapper".split())
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)", re.S)
# A quoted value ends where its quote is followed by space or the end of the tag; else the quote was never closed and is a character.
ATTRIBUTE = re.compile(r"[\s/]*([^\s=/>]+)(?:\s*=\s*(?:\"([^\"]*)\"(?=[\s/>])|'([^']*)'(?=[\s/>])|([^\s>]*)))?")
SPACE = re.compile(r"\s+")
WORDS = re.compile(r"\w+")
SENTENCE = re.compile(r"[.!?\u2026\u3002\uff01\uff1f\u0964\u06d4][\"')\]\u201d\u2019]*$")

LINK_DENSITY, STOP_LOW, STOP_HIGH, SHORT, LONG = 0.5, 0.05, 0.2, 70, 200


def shuts(label: str) -> bool:
    """Whether a class or id names something that is no part of an article."""
    for name in label.split():
        words = [w.lower() for w in PARTS.findall(name)]
        while len(words) > 1 and words[-1] in NEUTRAL:
            words.pop()
        if words and words[-1] in BOILERPLATE:
            return True
    return False


def blocks_of(page: str) -> list[dict]:
    """Blocks of a page in order: text, share of characters in links, container, and whether it is a heading or in the article.

    Tags are read as a browser would, in one pass: each character is looked at a bounded number of times, whatever is left open.
    """
    out, stack, parts = [], [], []
    linked = depth_a = skip = inside = heading = holders = 0
    low = page.lower()
    last_end: dict[str, int] = {}
    is_open: dict[str, int] = {}

    def close():
        nonlocal parts, linked
        raw = "".join(parts)
        text = SPACE.sub(" ", entities.unescape(raw)).strip()
        if text and not skip:
            out.append({"text": text, "links": linked / len(raw), "holder": stack[-1][3] if stack else 0, "inside": bool(inside), "heading": bool(heading)})
        parts, linked = [], 0

    def attributes(at: int) -> tuple[dict, bool, int]:
        """The attributes of a tag, whether it closes itself, and where it ends."""
        attrs: dict[str, str] = {}
        while True:
            m = ATTRIBUTE.match(page, at)
            if not m:
                break
            attrs.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
            at = m.end()
        end = page.find(">", at)
        return (attrs, page[at: end].rstrip().endswith("/"), end + 1) if end >= 0 else (attrs, False, len(page))

    at, n = 0, len(page)
    while at < n:
        m = MARKUP.search(page, at)
        piece = page[at: m.start() if m else n]
        if piece:
            parts.append(piece)
            linked += len(piece) if depth_a else 0
        if not m:
            break
        name = (m[2] or "").lower()
        if not name:
            at = m.end()
            if m[0].startswith("<![CDATA["):
                parts.append(" ")
            continue
        attrs, itself, at = attributes(m.end())
        if name in BREAKS:
            parts.append(" ")
            continue
        if m[1]:
            if name in BLOCK_TAGS:
                close()
            if name == "a":
                depth_a = max(0, depth_a - 1)
            if is_open.get(name):
                while True:
                    s, shut, body, _ = stack.pop()
                    is_open[s] -= 1
                    skip, inside, heading = skip - shut, inside - body, heading - (s in HEADINGS)
                    if s == name:
                        break
            continue
        if name in VOID:
            if name == "hr":
                close()
            continue
        if name in RAW:
            close()
            if name not in last_end:
                last_end[name] = low.rfind(f"</{name}")
            if at <= last_end[name]:
                at = low.find(">", low.find(f"</{name}", at)) + 1 or n
            elif name in ENDLESS:
                at = n
            continue
        if itself and name not in BLOCK_TAGS:
            continue
        if name == "a":
            depth_a += 1
        if name in BLOCK_TAGS:
            close()
        if name in ("p", "li") and stack and stack[-1][0] == name:
            _, shut, *_ = stack.pop()
            skip, is_open[name] = skip - shut, is_open[name] - 1
        shut = name in SKIPPED or (name == "header" and not inside) or attrs.get("role", "").lower() in ROLES or "hidden" in attrs or \
            attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower() or \
            (name in BLOCK_TAGS and name not in ("body", "html", "article", "main") and (shuts(attrs.get("class", "")) or shuts(attrs.get("id", ""))))
        body = name in ("article", "main") and not skip and not shut
        holders += 1
        stack.append((name, shut, body, holders if name in HOLDERS else stack[-1][3] if stack else 0))
        is_open[name] = is_open.get(name, 0) + 1
        skip, inside, heading = skip + shut, inside + body, heading + (name in HEADINGS)
    close()
    return out


def stop_list(page: str) -> frozenset:
    m = re.search(r"<html[^>]*\blang\s*=\s*[\"']?([a-zA-Z]{2})", page[:2000])
    return frozenset(STOP_WORDS.get(m.group(1).lower(), ANY)) if m else ANY


def first_pass(blocks: list[dict], stop: frozenset) -> list[str]:
    """good, near, short or bad for each block, from its own measures."""
    words = [WORDS.findall(b["text"].lower()) for b in blocks]
    hits = [sum(w in stop for w in own) for own in words]
    foreign = sum(hits) < STOP_LOW * sum(map(len, words))
    out = []
    for b, own, hit in zip(blocks, words, hits):
        text, density = b["text"], hit / max(1, len(own))
        if foreign:
            density = STOP_HIGH if SENTENCE.search(text) else 0.0
        if b["links"] > LINK_DENSITY or text.startswith("©"):
            out.append("bad")
        elif len(text) < SHORT or density < STOP_LOW:
            # Long blocks of few stop words are as ambiguous as short ones: other languages, tables, verse.
            out.append("bad" if b["links"] > 0.2 else "near" if len(text) >= SHORT and b["inside"] else "short")
        else:
            out.append("good" if density >= STOP_HIGH and len(text) > LONG else "near")
    return out


def _nearest(blocks: list[dict], label: list[str], order: range) -> list[tuple[bool, int, str] | None]:
    """For each block of an order the last decided one before it: (in another container, distance, label), its own container's first."""
    out, last, of = {}, None, {}
    for n, i in enumerate(order):
        holder = blocks[i]["holder"]
        same = of.get(holder)
        out[i] = (False, n - same[0], same[1]) if same else (True, n - last[0], last[1]) if last else None
        if label[i] in ("good", "bad"):
            last = of[holder] = (n, label[i])
    return [out[i] for i in range(len(blocks))]


def classify(blocks: list[dict], stop: frozenset) -> list[bool]:
    """Whether each block belongs to the main text."""
    label = first_pass(blocks, stop)
    if "good" not in label:
        best = "near" if "near" in label else "short"
        label = ["good" if k == best else k for k in label]
    marked = any(b["inside"] and k == "good" for b, k in zip(blocks, label))
    before, after = _nearest(blocks, label, range(len(blocks))), _nearest(blocks, label, range(len(blocks) - 1, -1, -1))
    out = []
    for b, kind, left, right in zip(blocks, label, before, after):
        if kind in ("near", "short"):
            if marked and not b["inside"]:
                kind = "bad"
            elif b["heading"] and right:
                kind = right[2]
            elif kind == "near":
                kind = "good" if "good" in [x[2] for x in (left, right) if x] else "bad"
            else:
                # The nearer one, the good one of two as near; a short line of another container must at least be a sentence.
                far, _, kind = min((x for x in (left, right) if x), key=lambda x: (*x[:2], x[2] == "bad"))
                kind = "bad" if far and not SENTENCE.search(b["text"]) else kind
        out.append(kind == "good")
    return out


def main_text(page: str | None) -> str:
    """The main text of one page: kept blocks in page order, joined by one space; '' if there is none."""
    if not page:
        return ""
    blocks = blocks_of(page)
    return " ".join(b["text"] for b, keep in zip(blocks, classify(blocks, stop_list(page))) if keep)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of each row of pages (page_id, url, html).

    Null and empty pages give an empty text. Rows are independent: repeated rows repeat, null
    ids and urls stay null, other columns are dropped.
    """
    bounded_batches(pages.sparkSession)

    def run(batches):
        for batch in batches:
            for piece in pieces(batch, "html"):
                texts = [main_text(h) for h in piece.column("html").to_pylist()]
                yield pa.record_batch({"page_id": piece.column("page_id"), "url": piece.column("url"),
                                       "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


@query("op8_main_text")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
