"""Plain-Python versions of the operators, for small inputs."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def words(text):
    return (text or "").encode().translate(LOWER).split()


class Groups:
    def __init__(self):
        self.parent = {}

    def root(self, x):
        while self.parent.get(x, x) != x:
            x = self.parent[x]
        return x

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)


def token_rows(rows, tokenizer, end=1):
    out, start = [], 0
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [end]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def near_copies(rows, threshold=0.8):
    """{doc_id: (n_links, class_id)} of rows (doc_id, text) with distinct ids."""
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    n, g = collections.Counter(), Groups()
    ids = [i for i in sets if sets[i]]
    for x, i in enumerate(ids):
        for j in ids[:x]:
            a, b = sets[i], sets[j]
            if min(len(a), len(b)) >= threshold * max(len(a), len(b)) and len(a & b) >= threshold * len(a | b):
                n[i] += 1
                n[j] += 1
                g.join(i, j)
    return {i: (n[i], g.root(i)) for i in sets}


def without_repeats(rows, length):
    """[(doc_id, n_bytes, n_removed, n_spans, sha256)] in the order of rows."""
    texts = [(i, (t or "").encode()) for i, t in rows]
    count = collections.Counter(t[k:k + length] for _, t in texts for k in range(len(t) - length + 1))
    out = []
    for i, t in texts:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - length + 1):
            if count[t[k:k + length]] > 1:
                gone[k:k + length] = True
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        out.append((i, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def cosine_links(rows, threshold=0.93):
    """{vec_id: (n_links, component)} of rows (vec_id, embedding, label) with distinct ids."""
    n, g = collections.Counter(), Groups()
    sound = []
    for i, e, label in rows:
        if e is None or label is None or any(x is None or not math.isfinite(x) for x in e) or not any(e):
            continue
        x = np.array(e, float)
        sound.append((i, label, x / np.linalg.norm(x)))
    for k, (i, a, x) in enumerate(sound):
        for j, b, y in sound[:k]:
            if a == b and len(x) == len(y) and x @ y >= threshold:
                n[i] += 1
                n[j] += 1
                g.join(i, j)
    return {i: (n[i], g.root(i)) for i, _, _ in rows}


def lm_scores(rows, discount=0.75):
    """[(doc_id, held_out, n_tokens, n_known, N, base, score)]."""
    held = [zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1 for i, _ in rows]
    tokens = [words(t) + [0] for _, t in rows]
    c, c2 = collections.Counter(), collections.Counter()
    for h, t in zip(held, tokens):
        if not h:
            c.update(t)
            c2.update(zip([0] + t[:-1], t))
    n, v = sum(c.values()), len(c)
    kinds = collections.Counter(u for u, _ in c2)
    out = []
    for (i, _), h, t in zip(rows, held, tokens):
        p1 = {w: (c[w] + 0.5) / (n + 0.5 * (v + 1)) for w in t}
        score = sum(math.log10(max(c2[u, w] - discount, 0) / c[u] + discount * kinds[u] / c[u] * p1[w] if c[u] else p1[w]) for u, w in zip([0] + t[:-1], t))
        out.append((i, h, len(t), sum(c[w] > 0 for w in t), n, sum(math.log10(p1[w]) for w in t), score))
    return out


def contains(docs, items):
    """{(doc_id, item_id)} where all words of the item follow each other in the document."""
    plain = lambda t: re.sub(rb"[!-/:-@\[-`{-~]", b" ", (t or "").encode().translate(LOWER)).split()
    texts = [(d, b" " + b" ".join(plain(t)) + b" ") for d, t in docs]
    return {(d, i) for i, t in items if plain(t) for d, x in texts if b" " + b" ".join(plain(t)) + b" " in x}


def collocations(rows, least=30, most=2000, inside=80):
    """Rows (lang, rank, phrase, a, l, r, n, score) from rows (lang, text)."""
    grams, total = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        total[lang] += 0
        for piece in re.split(rb"[.,;:!?\x0A-\x0D]", (text or "").encode().translate(LOWER)):
            w = [x for x in re.split(rb"[\x20\x09]+", piece) if x]
            total[lang] += len(w)
            grams.update((lang, *w[i:i + k]) for k in (1, 2, 3, 4) for i in range(len(w) - k + 1))
    often = {g for g, f in grams.items() if f >= least and len(g) > 2}
    covered = collections.Counter()
    for g in often:
        for m in range(2, len(g) - 1):
            for i in range(1, len(g) - m + 1):
                key = (g[0], *g[i:i + m])
                covered[key] = max(covered[key], grams[g])
    found = collections.defaultdict(list)
    for g in often:
        lang, a = g[0], grams[g]
        score, _, l, r = min((2000000 * a // (grams[g[:k + 1]] + grams[lang, *g[k + 1:]]), k, grams[g[:k + 1]], grams[lang, *g[k + 1:]]) for k in range(1, len(g) - 1))
        if 100 * covered[g] < inside * a:
            found[lang].append((-score, -a, b" ".join(g[1:]), l, r))
    return {(lang, k + 1, p.decode(), -a, l, r, total[lang], -s) for lang, every in found.items() for k, (s, a, p, l, r) in enumerate(sorted(every)[:most])}


def best_products(rows, k=20, every=20, scale=64):
    """{(query_id, rank, vec_id, score)} of rows (vec_id, embedding)."""
    whole = []
    for i, e in rows:
        if e is not None and all(x is not None and math.isfinite(x) for x in e):
            whole.append((i, tuple(math.floor(scale * x) for x in e)))
    out, width = set(), max((len(e) for _, e in rows if e is not None), default=0)
    for q in {i for i, _ in whole if i is not None and i % every == 0}:
        y = min((v for i, v in whole if i == q), key=lambda v: np.r_[np.array(v, float), np.zeros(width - len(v))].tobytes())
        clipped = lambda s: min(max(s, -2**63), 2**63 - 1)
        scored = sorted((-clipped(sum(a * b for a, b in zip(y, v))), i is None, i or 0) for i, v in whole if i != q)
        out |= {(q, r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(scored[:k])}
    return out


def spelling_variants(rows, least_chars=6, least_count=5, lose_every=199, ratio=5):
    """{(word, form, root, n, n_near, form_n)} of rows (doc_id, text)."""
    n = collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % lose_every == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            n[w] += 1
    n = {w: c for w, c in n.items() if len(w) >= least_chars and c >= least_count}
    holes = collections.defaultdict(set)
    for w in n:
        for k in range(len(w)):
            holes[w[:k] + "*" + w[k + 1:]].add(w)  # replaced
            holes[w[:k] + w[k + 1:]].add(w)  # deleted
    near = collections.defaultdict(set)
    for key, every in holes.items():
        for a in every:
            others = every if "*" in key else ({key} if key in n else set())
            for b in others - {a}:
                near[a].add(b)
                near[b].add(a)
    form = {}
    for w in n:
        top = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = top if top is not None and n[top] >= ratio * n[w] else None
    root = lambda w: w if form[w] is None else root(form[w])
    return {(w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def two_pass_text(page, stop, shut_names, link_share=0.5, low=0.05, high=0.2, short=70, long=200):
    """The block rules, plainly, for well-formed pages of div, p, h1, a, article, nav, footer, section and span."""
    import html.parser

    blocks, path, ids = [], [], [0]

    class Reader(html.parser.HTMLParser):
        text, linked, now = "", 0, None

        def flush(self):
            t = " ".join(self.text.split())
            if t and not any(s for _, s, _ in path):
                holder = next((i for n, _, i in reversed(path) if n in ("div", "article", "section", "body")), 0)
                blocks.append((t, self.linked / len(self.text), holder, any(n == "article" for n, *_ in path), any(n == "h1" for n, *_ in path)))
            self.text, self.linked = "", 0

        def handle_starttag(self, name, attrs):
            if name not in ("a", "span"):
                self.flush()
            ids[0] += 1
            path.append((name, name in ("nav", "footer") or dict(attrs).get("class") in shut_names, ids[0]))

        def handle_endtag(self, name):
            if name not in ("a", "span"):
                self.flush()
            path.pop()

        def handle_data(self, data):
            self.text += data
            self.linked += len(data) if any(n == "a" for n, *_ in path) else 0

    r = Reader()
    r.feed(page)
    r.flush()
    words = [re.findall(r"\w+", t.lower()) for t, *_ in blocks]
    hits = [sum(w in stop for w in own) for own in words]
    foreign = sum(hits) < low * sum(map(len, words))
    label = []
    for (t, links, _, inside, _), own, hit in zip(blocks, words, hits):
        density = hit / max(1, len(own)) if not foreign else high * (t[-1] in ".!?")
        if links > link_share:
            label.append("bad")
        elif len(t) < short or density < low:
            label.append("bad" if links > 0.2 else "near" if len(t) >= short and inside else "short")
        else:
            label.append("good" if density >= high and len(t) > long else "near")
    if "good" not in label:
        best = "near" if "near" in label else "short"
        label = ["good" if k == best else k for k in label]
    marked = any(b[3] and k == "good" for b, k in zip(blocks, label))
    kept = []
    for i, (t, _, holder, inside, heading) in enumerate(blocks):
        kind = label[i]
        if kind in ("near", "short"):
            sides = []
            for every in (range(i - 1, -1, -1), range(i + 1, len(blocks))):
                decided = [j for j in every if label[j] in ("good", "bad")]
                own = [j for j in decided if blocks[j][2] == holder]
                sides.append((not own, abs(i - (own or decided)[0]), label[(own or decided)[0]]) if decided else None)
            some = [s for s in sides if s]
            if marked and not inside:
                kind = "bad"
            elif heading and sides[1]:
                kind = sides[1][2]
            elif kind == "near":
                kind = "good" if any(s[2] == "good" for s in some) else "bad"
            else:
                far, _, kind = min(some, key=lambda s: (s[0], s[1], s[2] == "bad"))
                kind = "bad" if far and t[-1] not in ".!?" else kind
        if kind == "good":
            kept.append(t)
    return " ".join(kept)
