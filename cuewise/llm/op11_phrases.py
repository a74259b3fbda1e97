"""Phrase collocations from weighted acyclic automata of word sequences.

1. Words. Each unit of texts (see common.units) sends its distinct words with their counts; words of ``least`` occurrences and more get numbers
   in the order of their hashes. Rarer words cannot be in a phrase of ``least`` occurrences and end the sequences around them.
2. Shard automata. The sequences of up to four words that start at each word of a unit are sorted, equal ones added up, and stored as an acyclic
   automaton of four levels: labels, how many arcs leave each state, and a weight for each whole path. The weight of a prefix is
   the sum over its range of paths, so one automaton counts all lengths at once.
3. Union. Automata are cut at the same prefixes everywhere, and the pieces of a range are merged, weights added, by one task.
   A prefix that runs over the edge of a range is counted in each of them and added up afterwards, so no prefix, however frequent, is bound to a task. The
   edges come from a bounded sample; they decide who does the work, never the counts.
4. Composition. Frequent paths, as rows, are joined with the paths of their first and of their remaining words.

Tails are not merged: four words deep, most states have one way out, and its label takes the room of a pointer. Words are known by 64-bit hashes
of their language and letters.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuewise.llm.common import Ask, Roller, bounded_batches, expanded, mix, partitions, query, settle, squeezed, table, units, with_answers

LEAST = 30
LONGEST = 4
EDGE_UNITS = 64  # units whose sequences set the edges of ranges
EDGE_PATHS = 512  # sequences taken of each
_32 = np.uint64(32)

_KIND = np.zeros(256, np.uint8)
_KIND[[9, 32]] = 1
_KIND[[ord(c) for c in ".,;:!?"] + [10, 11, 12, 13]] = 2
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32

ORACLE = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) piece
  FROM documents
), w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') ws FROM p),
total AS (SELECT lang, sum(len(ws))::BIGINT n FROM w GROUP BY lang),
g AS (
  SELECT lang, list_slice(ws, i, i + k - 1) g, count(*) f
  FROM w, unnest(range(1, 5)) a(k), unnest(range(1, len(ws) - k + 2)) b(i) GROUP BY ALL HAVING count(*) >= 30
), cut AS (
  SELECT c.lang, c.g, c.f a, k, l.f l, r.f r, (2000000::HUGEINT * c.f // (l.f + r.f))::BIGINT score
  FROM g c, unnest(range(1, len(c.g))) x(k)
  JOIN g l ON l.lang = c.lang AND l.g = list_slice(c.g, 1, k) JOIN g r ON r.lang = c.lang AND r.g = list_slice(c.g, k + 1, len(c.g))
), one AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
inside AS (
  SELECT lang, list_slice(g, i, i + m - 1) g, max(f) f FROM g, unnest(range(2, len(g))) x(m), unnest(range(1, len(g) - m + 2)) y(i) GROUP BY ALL
), kept AS (SELECT o.* FROM one o LEFT JOIN inside i ON i.lang = o.lang AND i.g = o.g WHERE i.f IS NULL OR 100 * i.f < 80 * o.a),
ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank, array_to_string(g, ' ') phrase, a, l, r, score FROM kept
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""


def _framed(*parts: bytes) -> bytes:
    return struct.pack(f"<{len(parts)}I", *map(len, parts)) + b"".join(parts)


def _unframed(raw: bytes, n: int) -> list[bytes]:
    sizes, at = struct.unpack(f"<{n}I", raw[: 4 * n]), 4 * n
    return [raw[at + sum(sizes[:k]): at + sum(sizes[: k + 1])] for k in range(n)]


class Unit:
    """The words of a unit's texts as places in its sorted distinct words, and the piece that each stands in."""

    def __init__(self, row: dict):
        self.data = _LOW[np.frombuffer(row["blob"], np.uint8)]
        at = np.r_[0, np.cumsum(np.array(row["length"], np.int64) + 1)]
        keys = np.array(row["doc_id"], np.int64)
        roller, hashes, starts, ends, piece, lang, breaks, i = Roller.shared(), [], [], [], [], [], 0, 0
        while i < len(keys):  # a megabyte of texts at a time; the line feed after each text ends its last piece
            j = max(i + 1, int(np.searchsorted(at, at[i] + (1 << 20), "right")) - 1)
            part = self.data[at[i]: at[j]]
            kind = _KIND[part]
            step = np.diff(np.r_[0, kind == 0, 0].astype(np.int8))
            s, e = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
            own = keys[i + np.searchsorted(at[i + 1: j + 1] - at[i], s, "right")]
            before = np.cumsum(kind == 2)
            hashes.append(mix(roller.at(roller.sums(part), s, e) ^ mix(own.view(np.uint64))))
            starts.append(s + at[i]), ends.append(e + at[i]), lang.append(own), piece.append(before[s] + breaks)
            breaks += int(before[-1]) if len(before) else 0
            i = j
        join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        tokens = join(hashes, np.uint64)
        self.piece = join(piece, np.int64)
        self.words, first, self.place, self.count = np.unique(tokens, return_index=True, return_inverse=True, return_counts=True)
        self.start, self.end, self.lang = (join(x, np.int64)[first] for x in (starts, ends, lang))

    def described(self, which: np.ndarray) -> bytes:
        """Counts, languages and letters of some words."""
        langs, own = np.unique(self.lang[which], return_inverse=True)
        letters = b"".join(self.data[a:b].tobytes() for a, b in zip(self.start[which].tolist(), self.end[which].tolist()))
        return _framed(squeezed(self.count[which]), langs.tobytes(), own.astype("<u4").tobytes() if len(langs) > 1 else b"", squeezed((self.end - self.start)[which]), letters)

    def paths(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct sequences of two to four numbered words, as (first two, last two; 0 where it ends), with counts."""
        word = number[self.place].astype(np.uint64)
        n = len(word)
        along = np.zeros((LONGEST, n), np.uint64)
        along[0] = word
        for k in range(1, LONGEST):
            if n > k:
                along[k, :-k] = np.where((along[k - 1, :-k] > 0) & (self.piece[k:] == self.piece[:-k]), word[k:], 0)
        use = along[1] > 0
        return _added((along[0, use] << _32) | along[1, use], (along[2, use] << _32) | along[3, use], np.ones(int(use.sum()), np.int64))


def _added(high: np.ndarray, low: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct paths with summed weights."""
    order = np.lexsort((low, high))
    high, low = high[order], low[order]
    first = np.flatnonzero(np.r_[True, (high[1:] != high[:-1]) | (low[1:] != low[:-1])]) if len(high) else np.zeros(0, np.int64)
    return high[first], low[first], np.add.reduceat(weight[order], first) if len(first) else weight


def automaton(high: np.ndarray, low: np.ndarray, weight: np.ndarray) -> bytes:
    """Sorted distinct paths as levels of arcs: each level's labels, and for all but the last how many arcs follow each."""
    labels = [high >> _32, high & np.uint64(0xFFFFFFFF), low >> _32, low & np.uint64(0xFFFFFFFF)]
    new, begins = np.zeros(len(high), bool), []
    for level in labels:
        new = new | np.r_[True, level[1:] != level[:-1]][: len(high)]
        begins.append(np.flatnonzero(new))
    out = []
    for k, (level, begin) in enumerate(zip(labels, begins)):
        out.append(level[begin].astype("<u4").tobytes())
        if k + 1 < LONGEST:
            inner = np.searchsorted(begins[k + 1], begin)
            out.append(squeezed(np.diff(np.r_[inner, len(begins[k + 1])])))
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(_framed(*out, squeezed(weight)))


def paths_of(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sorted paths of an automaton and their weights."""
    import zstandard

    parts = _unframed(zstandard.ZstdDecompressor().decompress(raw), 2 * LONGEST)
    walked: list[np.ndarray] = []
    for k in range(LONGEST):
        label = np.frombuffer(parts[2 * k], "<u4").astype(np.uint64)
        if k:
            fan = expanded(parts[2 * k - 1], len(walked[-1]))
            walked = [np.repeat(w, fan) for w in walked]
        walked.append(label)
    a, b, c, d = walked
    return (a << _32) | b, (c << _32) | d, expanded(parts[-1], len(a))


def _numbered(bits: int, least: int):
    """Answer each packet with the numbers of its words (0: too rare); the bucket's own row lists numbered words and words per language."""
    def solve(parts: list) -> list[bytes]:
        every = np.concatenate([h for h, _ in parts])
        count, lang, size, letters = [], [], [], []
        for h, x in parts:
            c, table_, own, n, text = _unframed(x, 5)
            langs = np.frombuffer(table_, np.int64)
            count.append(expanded(c, len(h))), size.append(expanded(n, len(h))), letters.append(text)
            lang.append(langs[np.frombuffer(own, "<u4")] if own else np.repeat(langs, len(h)))
        count, lang, size, text = np.concatenate(count), np.concatenate(lang), np.concatenate(size), b"".join(letters)
        order = np.argsort(every, kind="stable")
        first = np.flatnonzero(np.r_[True, every[order][1:] != every[order][:-1]])
        total = np.add.reduceat(count[order], first)
        often = total >= least
        if often.sum() >= 1 << (32 - bits):
            raise OverflowError("too many frequent words for 32-bit numbers")
        number = np.where(often, (int(every[0] >> np.uint64(64 - bits)) << (32 - bits)) + np.cumsum(often), 0)
        per = np.empty(len(every), "<u4")
        per[order] = np.repeat(number, np.diff(np.r_[first, len(every)]))
        cut = np.cumsum([len(h) for h, _ in parts])[:-1]
        at, end = order[first[often]], np.cumsum(size)
        words = [text[end[k] - size[k]: end[k]] for k in at.tolist()]
        langs, whose = np.unique(lang, return_inverse=True)
        sums = np.bincount(whose, count, len(langs)).astype(np.int64) if count.sum() < 1 << 53 else np.array([count[whose == k].sum() for k in range(len(langs))])
        own = _framed(number[often].astype("<i8").tobytes(), total[often].astype("<i8").tobytes(), lang[at].tobytes(),
                      squeezed(np.array([len(w) for w in words], np.int64)), b"".join(words), langs.tobytes(), sums.tobytes())
        return [*[p.tobytes() for p in np.split(per, cut)], own]

    return solve


def _part(words: list[Column], start: int, n: int) -> list[Column]:
    """Both halves of the key of n words from ``start``."""
    get = lambda k: words[start + k] if k < n else F.lit(0).cast("long")
    return [F.shiftleft(get(0), 32).bitwiseOR(get(1)).alias("ph"), F.shiftleft(get(2), 32).bitwiseOR(get(3)).alias("pl")]


def frequent_phrases(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From (lang, text): counted words and phrases (high, low, f), words (id, lang_key, word) and totals (lang_key, n)."""
    spark = docs.sparkSession
    packed = units(docs.select(F.xxhash64(F.coalesce("lang", F.lit("und"))).alias("doc_id"), "text"))
    ask = Ask(spark)
    bits = ask.bits

    def rows_of(batches):
        for b in batches:
            for k in range(b.num_rows):
                yield {c: b.column(c)[k].as_py() for c in b.schema.names}

    def send_words(batches):
        for r in rows_of(batches):
            u = Unit(r)
            yield ask.packets(r["unit"], u.words, np.arange(len(u.words)), u.described)

    numbered = ask.answers(packed.mapInArrow(send_words, Ask.PACKETS), _numbered(bits, least), "words")

    def own_rows(names: list[str]):
        def run(batches):
            for b in batches:
                for answers in b.column("answers").to_pylist():
                    for a in answers:
                        ids, total, lang, size, text, langs, sums = _unframed(a["answer"], 7)
                        if names[0] == "id":
                            end = np.cumsum(expanded(size, len(ids) // 8)).tolist()
                            words = [text[x:y].decode("utf-8", "replace") for x, y in zip([0, *end], end)]
                            columns = [pa.array(np.frombuffer(ids, "<i8")), pa.array(np.frombuffer(total, "<i8")), pa.array(np.frombuffer(lang, np.int64)), pa.array(words, pa.string())]
                        else:
                            columns = [pa.array(np.frombuffer(langs, np.int64)), pa.array(np.frombuffer(sums, np.int64))]
                        yield pa.record_batch(columns, names=names)

        return run

    own = numbered.where("unit < 0").select("answers")
    words = settle(own.mapInArrow(own_rows(["id", "f", "lang_key", "word"]), "id long, f long, lang_key long, word string"), "dictionary")
    totals = own.mapInArrow(own_rows(["lang_key", "n"]), "lang_key long, n long").groupBy("lang_key").agg(F.sum("n").alias("n"))
    asked = with_answers(packed, words=numbered)

    def sequences(r):
        u = Unit(r)
        got = Ask.joined(r["words"])
        return u.paths(np.frombuffer(b"".join(got), "<u4"))

    def edges(batches):
        for r in rows_of(batches):
            high, low, _ = sequences(r)
            at = np.unique(np.linspace(0, len(high) - 1, EDGE_PATHS).astype(np.int64)) if len(high) else np.zeros(0, np.int64)
            yield pa.record_batch({"high": pa.array(high[at].view(np.int64)), "low": pa.array(low[at].view(np.int64))})

    ids = [r.unit for r in packed.select("unit").orderBy(F.xxhash64("unit")).limit(EDGE_UNITS).collect()]
    sampled = asked.where(F.col("unit").isin(ids)).mapInArrow(edges, "high long, low long").collect()
    some = np.array(sorted((r.high % (1 << 64), r.low % (1 << 64)) for r in sampled), np.uint64).reshape(-1, 2)
    ranges = min(4 * partitions(spark), len(some))
    edge = np.unique(some[np.arange(1, ranges) * len(some) // max(1, ranges)], axis=0) if ranges > 1 else np.zeros((0, 2), np.uint64)

    def send_paths(batches):
        for r in rows_of(batches):
            high, low, weight = sequences(r)
            left, right = np.searchsorted(high, edge[:, 0]), np.searchsorted(high, edge[:, 0], "right")
            cut = [a + int(np.searchsorted(low[a:b], x)) for a, b, x in zip(left.tolist(), right.tolist(), edge[:, 1])]
            cut = [0, *cut, len(high)]
            full = [k for k in range(len(cut) - 1) if cut[k] < cut[k + 1]]
            yield pa.record_batch({"range": pa.array(full, pa.int64()), "paths": pa.array(
                [automaton(*(x[cut[k]: cut[k + 1]] for x in (high, low, weight))) for k in full], pa.binary())})

    def unite(batches):
        held, now = [], None

        def out():
            high, low, weight = _added(*map(np.concatenate, zip(*map(paths_of, held))))
            third = low >> _32
            keys = [(high, np.zeros_like(low)), (high, third << _32), (high, low)]
            new, rows = np.zeros(len(high), bool), []
            for k, (h, l) in enumerate(keys):
                new = new | np.r_[True, (h[1:] != h[:-1]) | (l[1:] != l[:-1])]
                first = np.flatnonzero(new)
                f = np.add.reduceat(weight, first)
                # The first and the last may go on in other ranges.
                keep = f >= least
                keep[[0, -1]] = True
                keep &= (True, third[first] > 0, (low[first] & np.uint64(0xFFFFFFFF)) > 0)[k]
                rows.append((h[first][keep], l[first][keep], f[keep]))
            h, l, f = map(np.concatenate, zip(*rows))
            return pa.record_batch({"high": pa.array(h.view(np.int64)), "low": pa.array(l.view(np.int64)), "f": pa.array(f)})

        for b in batches:
            for k, raw in zip(b.column("range").to_pylist(), b.column("paths").to_pylist()):
                if k != now:
                    if held:
                        yield out()
                    held, now = [], k
                held.append(raw)
        if held:
            yield out()

    dealt = asked.mapInArrow(send_paths, "range long, paths binary").repartition(partitions(spark), "range").sortWithinPartitions("range")
    counted = dealt.mapInArrow(unite, "high long, low long, f long").groupBy("high", "low").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    single = words.select(F.shiftleft("id", 32).alias("high"), F.lit(0).cast("long").alias("low"), "f")
    return settle(counted.union(single), "phrases"), words, totals


def collocations(docs: DataFrame, least: int = LEAST, most: int = 2000, inside: int = 80) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best ``most`` phrases of two to four words of each lang of (lang, text).

    a, l, r count the phrase, its first and its remaining words at the cut of lowest score floor(2000000 a / (l + r)), n all words of
    the lang. A phrase goes if it lies inside a longer counted phrase of ``inside`` percent of its occurrences or more. Null langs are
    ``und``, null texts empty; rows that repeat count as often as they occur; ties in score go by a, then by the phrase. Other columns
    are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    counted, words, totals = frequent_phrases(docs, least)
    whole = lambda h: [F.shiftrightunsigned(h, 32), F.col(h).bitwiseAND(F.lit(0xFFFFFFFF))]
    w = [*whole("high"), *whole("low")]
    size = sum(F.when(x != 0, 1).otherwise(0) for x in w)
    phrases = counted.where(w[1] != 0).withColumn("k", size).withColumnRenamed("f", "a")

    def parts(k: int) -> Column:
        every = [(c, side, s, n) for c in range(1, k) for side, s, n in ((0, 0, c), (1, c, k - c))]
        return F.array(*[F.struct(F.lit(c).alias("cut"), F.lit(side).alias("side"), *_part(w, s, n)) for c, side, s, n in every])

    by_size = lambda f: F.when(F.col("k") == 2, f(2)).when(F.col("k") == 3, f(3)).otherwise(f(4))
    asked = phrases.select("high", "low", "a", "k", F.explode(by_size(parts)).alias("p")).select("high", "low", "a", "k", "p.*")
    found = asked.join(counted.select(F.col("high").alias("ph"), F.col("low").alias("pl"), "f"), ["ph", "pl"])
    of = lambda c, side: F.max(F.when((F.col("cut") == c) & (F.col("side") == side), F.col("f"))).alias(f"f{c}{side}")
    sides = found.groupBy("high", "low", "a", "k").agg(*[of(c, side) for c in (1, 2, 3) for side in (0, 1)])
    wide = "decimal(38,0)"
    score = lambda c: F.expr(f"(cast(a as decimal(20,0)) * 2000000) div (cast(f{c}0 as decimal(20,0)) + f{c}1)")
    cut = lambda c: F.when(F.col("k") > c, F.struct(score(c).alias("score"), F.lit(c).alias("cut"), F.col(f"f{c}0").alias("l"), F.col(f"f{c}1").alias("r")))
    scored = sides.select("high", "low", "a", F.array_min(F.array(*map(cut, (1, 2, 3)))).alias("m")).select("high", "low", "a", "m.score", "m.l", "m.r")

    def within(k: int) -> Column:
        return F.array(*[F.struct(*_part(w, s, n)) for n in range(2, k) for s in range(k - n + 1)])

    longer = phrases.where("k > 2").select("a", F.explode(F.when(F.col("k") == 3, within(3)).otherwise(within(4))).alias("p"))
    longer = longer.groupBy(F.col("p.ph").alias("high"), F.col("p.pl").alias("low")).agg(F.max("a").alias("most"))
    kept = scored.join(longer, ["high", "low"], "left").where(
        F.col("most").isNull() | (F.col("most").cast(wide) * 100 < F.col("a").cast(wide) * inside)).drop("most")
    langs = words.select(F.col("id"), "lang_key")
    kept = settle(kept.withColumn("id", w[0]).join(langs, "id").drop("id"), "scored")
    # The least (score, a) that can be in: the best of each slice of a lang, then the best of those. All that tie with it go on to be told apart by
    # their words, again in slices, so that no lang is gathered anywhere.
    slices = F.pmod(F.xxhash64("high", "low"), F.lit(partitions(spark)))
    best = lambda df, keys, order: df.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__k") <= most)
    by_score = [F.desc("score"), F.desc("a")]
    sliced = kept.withColumn("slice", slices)
    top = best(best(sliced, ["lang_key", "slice"], by_score), ["lang_key"], by_score)
    least_in = top.groupBy("lang_key").agg(F.min(F.struct("score", "a")).alias("least"))
    named = sliced.join(least_in, "lang_key").where(F.struct("score", "a") >= F.col("least")).drop("least")
    for i, x in enumerate(w):
        named = named.withColumn("id", x).join(words.select("id", F.col("word").alias(f"w{i}")), "id", "left").drop("id")
    named = named.withColumn("phrase", F.concat_ws(" ", "w0", "w1", "w2", "w3"))
    order = [*by_score, "phrase"]
    ranked = best(best(named, ["lang_key", "slice"], order), ["lang_key"], order).withColumn("rank", F.col("__k").cast("long"))
    names = docs.select(F.coalesce("lang", F.lit("und")).alias("lang")).distinct().withColumn("lang_key", F.xxhash64("lang"))
    return ranked.join(names, "lang_key").join(totals, "lang_key").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


@query("op11_phrases", ORACLE)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))
