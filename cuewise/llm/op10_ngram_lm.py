"""Language-model scoring with an Elias-Fano n-gram trie.

The model is an interpolated bigram model with absolute discounting,

    p(w | u) = max(c(uw) - D, 0) / c(u) + D n(u) / c(u) * p1(w),    p1(w) = (c(w) + 1/2) / (N + (V + 1) / 2),

n(u) being the distinct successors of u in training; an unseen context has p = p1. Its upper level
is a trie: sorted contexts, monotone pointers to their successors, and the successors of all contexts as one monotone
sequence (place of the context, word), all three in Elias-Fano form, with 16-bit quantised log probabilities and back-off
weights beside them. A level is a handful of flat arrays that can be mapped from a file.

The trie is cut by context into shards. Texts stay where they are: each unit of texts sends every shard its distinct
bigrams with their training counts; the shard merges them, builds its part of the trie, looks the unit's bigrams
up by context-relative successor search, and answers with codes. A context with more than a shard's share of all tokens is spread
over the shards by its successors.

Words are 64-bit hashes, successors within a context 40-bit hashes. A token after the last word of a
text is its end, which is also the context of its first word.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuewise.llm.common import Ask, bounded_batches, expanded, mix, query, squeezed, table, units, with_answers, words_of

DISCOUNT = 0.75
STEP = 4096.0  # codes per power of ten
UNSEEN = 65535
END = np.uint64(0x5E4D_0000_0000_0001)
_40 = np.uint64((1 << 40) - 1)


class EliasFano:
    """A sorted sequence of unsigned 64-bit numbers: low bits packed, high bits as a unary bit vector."""

    def __init__(self, values: np.ndarray, limit: int):
        n = len(values)
        self.n, self.low_bits = n, max(0, min(63, (max(1, limit) // max(1, n)).bit_length() - 1))
        low = np.uint64(self.low_bits)
        high = (values >> low).astype(np.int64)
        self.top = int(limit >> self.low_bits) + 1
        bit = np.zeros(n + self.top + 1, np.uint8)
        bit[high + np.arange(n)] = 1
        self.high = np.packbits(bit, bitorder="little")
        at = np.arange(n, dtype=np.uint64) * low
        self.low = np.zeros((n * self.low_bits) // 64 + 2, np.uint64)
        if self.low_bits:
            part = values & ((np.uint64(1) << low) - np.uint64(1))
            word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            np.bitwise_or.at(self.low, word, part << shift)
            over = np.flatnonzero(shift > np.uint64(64) - low)
            np.bitwise_or.at(self.low, word[over] + 1, part[over] >> (np.uint64(64) - shift[over]))

    def begin(self) -> np.ndarray:
        """For each high part where its entries begin: the zeros of the bit vector, selected."""
        bit = np.unpackbits(self.high, count=self.n + self.top + 1, bitorder="little")
        zero = np.flatnonzero(bit == 0)
        return np.r_[0, zero - np.arange(len(zero))]

    def low_at(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        low = np.uint64(self.low_bits)
        at = i.astype(np.uint64) * low
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        out = self.low[word] >> shift
        over = shift > np.uint64(64) - low
        out[over] |= self.low[word[over] + 1] << (np.uint64(64) - shift[over])
        return out & ((np.uint64(1) << low) - np.uint64(1))

    def access(self, i: np.ndarray) -> np.ndarray:
        bit = np.unpackbits(self.high, bitorder="little")
        one = np.flatnonzero(bit)[i]
        return ((one - i).astype(np.uint64) << np.uint64(self.low_bits)) | self.low_at(i)

    def find(self, x: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """The place of each x, or -1: a successor search among the entries of its high part."""
        out = np.full(len(x), -1)
        if not self.n:
            return out
        high = (x >> np.uint64(self.low_bits)).astype(np.int64)
        want = x & ((np.uint64(1) << np.uint64(self.low_bits)) - np.uint64(1))
        high = np.minimum(high, self.top)
        at, end = begin[high], begin[high + 1]
        last = end.copy()
        live = np.flatnonzero(at < end)
        while len(live):  # halving: a frequent context has many successors in one high part
            middle = (at[live] + end[live]) >> 1
            less = self.low_at(middle) < want[live]
            at[live[less]] = middle[less] + 1
            end[live[~less]] = middle[~less]
            live = live[at[live] < end[live]]
        inside = np.flatnonzero(at < last)
        hit = inside[self.low_at(at[inside]) == want[inside]]
        out[hit] = at[hit]
        return out


class Trie:
    """One shard of the bigram level, from sorted distinct (u, w) with counts and their contexts' counts."""

    def __init__(self, u: np.ndarray, w: np.ndarray, count: np.ndarray, c_u: np.ndarray):
        first = np.flatnonzero(np.r_[True, u[1:] != u[:-1]]) if len(u) else np.zeros(0, np.int64)
        size = np.diff(np.r_[first, len(u)])
        self.contexts = EliasFano(u[first], (1 << 64) - 1)
        self.pointers = EliasFano(np.r_[0, np.cumsum(size)].astype(np.uint64), max(1, len(u)))
        place = np.repeat(np.arange(len(first), dtype=np.uint64), size)
        self.successors = EliasFano((place << np.uint64(40)) | w, max(1, len(first)) << 40)
        self.code = _coded(np.maximum(count - DISCOUNT, 0) / np.maximum(c_u, 1))
        self.back_off = _coded(DISCOUNT * size / np.maximum(c_u[first], 1))
        self.kinds = size

    def lookup(self, u: np.ndarray, context_of: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes of (u[context_of], w), and back-off codes and successor counts of each u."""
        place = self.contexts.find(u, self.contexts.begin())
        known = place >= 0
        back, n = np.full(len(u), UNSEEN, np.uint16), np.zeros(len(u), np.int64)
        back[known] = self.back_off[place[known]]
        if known.any():
            n[known] = (self.pointers.access(place[known] + 1) - self.pointers.access(place[known])).astype(np.int64)
        code = np.full(len(w), UNSEEN, np.uint16)
        ask = np.flatnonzero(known[context_of])
        at = self.successors.find((place[context_of[ask]].astype(np.uint64) << np.uint64(40)) | w[ask], self.successors.begin())
        code[ask[at >= 0]] = self.code[at[at >= 0]]
        return code, back, n


def _coded(p: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-np.log10(np.maximum(p, 1e-300)) * STEP), 0, UNSEEN - 1).astype(np.uint16)


def _value(code: np.ndarray) -> np.ndarray:
    return np.where(code == UNSEEN, 0.0, 10.0 ** (-code.astype(float) / STEP))


def _packed(*parts: bytes) -> bytes:
    return struct.pack(f"<{len(parts)}I", *map(len, parts)) + b"".join(parts)


def _unpacked(raw: bytes, n: int) -> list[bytes]:
    out, at = [], 4 * n
    for k in struct.unpack(f"<{n}I", raw[: 4 * n]):
        out.append(raw[at: at + k])
        at += k
    return out


def _five(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _from_five(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return out.view("<u8").reshape(-1)


class Unit:
    """Tokens of a unit's texts as places in its sorted distinct words."""

    def __init__(self, row: dict, folds: int, fold: int):
        data = np.frombuffer(row["blob"], np.uint8)
        at = np.r_[0, np.cumsum(np.array(row["length"], np.int64) + 1)]
        n_docs = len(at) - 1
        # Hashed a megabyte of texts at a time: a hash needs some 40 bytes of work space per byte of text.
        words, per, i = [], [np.zeros(0, np.int64)], 0
        while i < n_docs:
            j = max(i + 1, int(np.searchsorted(at, at[i] + (1 << 20), "right")) - 1)
            got, start, _ = words_of(data[at[i]: at[j]])
            words.append(got)
            per.append(np.diff(np.searchsorted(start, at[i: j + 1] - at[i])))
            i = j
        words, per = np.concatenate(words or [np.zeros(0, np.uint64)]), np.concatenate(per)
        self.end = np.cumsum(per + 1) - 1
        tokens = np.empty(len(words) + n_docs, np.uint64)
        inner = np.ones(len(tokens), bool)
        inner[self.end] = False
        tokens[inner], tokens[self.end] = words, END
        self.n_tokens = per + 1
        self.doc = np.repeat(np.arange(n_docs), self.n_tokens)
        self.held_out = np.array([zlib.crc32(b"" if d is None else str(d).encode()) % folds == fold for d in row["doc_id"]], bool)
        self.train = ~self.held_out[self.doc]
        self.words, self.id = np.unique(tokens, return_inverse=True)
        self.count = np.bincount(self.id[self.train], minlength=len(self.words))
        before = np.r_[0, self.id[:-1]] if len(self.id) else self.id
        if n_docs:
            before[np.r_[0, self.end[:-1] + 1]] = np.searchsorted(self.words, END)
        self.key = (before.astype(np.int64) << 32) | self.id

    def bigrams(self, total: np.ndarray, n: int, bits: int):
        """Distinct bigrams in shard order: (keys, order by shard, shard of each, training counts)."""
        key, inverse = np.unique(self.key, return_inverse=True)
        count = np.bincount(inverse[self.train], minlength=len(key))
        u, w = key >> 32, key & 0xFFFFFFFF
        hot = total[u] * (1 << bits) > n
        where = np.where(hot, mix(self.words[u] ^ mix(self.words[w])), self.words[u])
        shard = (where >> np.uint64(64 - bits)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        return inverse, u, w, count, order, shard


def score(docs: DataFrame, folds: int = 5, fold: int = 1) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row of (doc_id, text).

    Training texts are those whose crc32 of the doc_id in decimal, mod ``folds``, is not ``fold`` (a null id
    counts as the empty string). Null and empty texts have one token, their end. Scores are log10 probabilities. With no
    training text at all the scores are those of the formulas with zero counts. Repeated rows count
    as often as they occur. Other columns are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    packed, ask = units(docs, 6 << 20), Ask(spark)
    bits = ask.bits

    def rows_of(batches):
        for b in batches:
            for k in range(b.num_rows):
                yield {c: b.column(c)[k].as_py() for c in b.schema.names}

    def ask_words(batches):
        for r in rows_of(batches):
            u = Unit(r, folds, fold)
            yield ask.packets(r["unit"], u.words, u.count, squeezed)

    def add_words(parts):
        every = np.concatenate([h for h, _ in parts])
        count = np.concatenate([expanded(x, len(h)) for h, x in parts])
        order = np.argsort(every)
        first = np.flatnonzero(np.r_[True, every[order][1:] != every[order][:-1]])
        sums = np.add.reduceat(count[order], first)
        total = np.empty(len(every), np.int64)
        total[order] = np.repeat(sums, np.diff(np.r_[first, len(every)]))
        cut = np.cumsum([len(h) for h, _ in parts])[:-1]
        return [*[squeezed(t) for t in np.split(total, cut)], struct.pack("<qq", int(sums.sum()), int((sums > 0).sum()))]

    counted = ask.answers(packed.mapInArrow(ask_words, Ask.PACKETS), add_words, "words")
    # N and V: two numbers per bucket, added up on Spark.
    whole = counted.where("unit < 0").select(F.explode("answers").alias("a")).select(F.hex("a.answer").alias("x"))
    number = lambda at: F.conv(F.concat(*[F.substring("x", at + 2 * (7 - k) + 1, 2) for k in range(8)]), 16, 10).cast("long")
    n, v = whole.select(F.sum(number(0)), F.sum(number(16))).first()
    n, v = n or 0, v or 0

    def totals(r, u):
        per = np.bincount((u.words >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
        got = [expanded(raw, k) for raw, k in zip(Ask.joined(r["words"]), per[per > 0].tolist())]
        return np.concatenate(got) if got else np.zeros(0, np.int64)

    def ask_bigrams(batches):
        for r in rows_of(batches):
            u = Unit(r, folds, fold)
            total = totals(r, u)
            _, left, right, count, order, shard = u.bigrams(total, n, bits)
            cut = np.r_[0, np.flatnonzero(np.diff(shard[order])) + 1, len(order)]
            rows = []
            for a, b in zip(cut, cut[1:]):
                if a == b:
                    continue
                here = order[a:b]
                first = np.flatnonzero(np.r_[True, left[here][1:] != left[here][:-1]])
                contexts = left[here][first]
                rows.append((int(shard[here[0]]), u.words[contexts].tobytes(), _packed(
                    squeezed(np.diff(np.r_[first, len(here)])), squeezed(total[contexts]), _five(u.words[right[here]] & _40), squeezed(count[here]))))
            yield pa.record_batch({"bucket": pa.array([x for x, *_ in rows], pa.int64()), "unit": pa.array([r["unit"]] * len(rows), pa.int64()),
                                   "hashes": pa.array([x for _, x, _ in rows], pa.binary()), "extra": pa.array([x for *_, x in rows], pa.binary())})

    def add_bigrams(parts):
        us, cs, ctx, ws, ks, n_ctx, n_big, offset = [], [], [], [], [], [], [], 0
        for h, x in parts:
            sizes, c, w, k = _unpacked(x, 4)
            size = expanded(sizes, len(h))
            us.append(h), cs.append(expanded(c, len(h))), ws.append(_from_five(w)), ks.append(expanded(k, int(size.sum())))
            ctx.append(np.repeat(np.arange(len(h)) + offset, size))
            offset += len(h)
            n_ctx.append(len(h)), n_big.append(int(size.sum()))
        us, cs, ctx, ws, ks = map(np.concatenate, (us, cs, ctx, ws, ks))
        order = np.lexsort((ws, us[ctx]))
        u, w = us[ctx[order]], ws[order]
        first = np.flatnonzero(np.r_[True, (u[1:] != u[:-1]) | (w[1:] != w[:-1])])
        sums = np.add.reduceat(ks[order], first)
        seen = first[sums > 0]
        trie = Trie(u[seen], w[seen], sums[sums > 0], cs[ctx[order[seen]]])
        code, back, kinds = trie.lookup(us, ctx, ws)
        out, at, big = [], 0, 0
        for m, b in zip(n_ctx, n_big):
            out.append(_packed(code[big: big + b].tobytes(), back[at: at + m].tobytes()))
            at, big = at + m, big + b
        # Contexts that are spread over shards: their successors seen here, once each.
        hot, place = np.unique(us[cs * (1 << bits) > n], return_index=True)
        return [*out, hot.tobytes() + kinds[cs * (1 << bits) > n][place].astype(np.int64).tobytes()]

    pairs = ask.answers(with_answers(packed, words=counted).mapInArrow(ask_bigrams, Ask.PACKETS), add_bigrams, "bigrams")

    def spread(batches):
        for b in batches:
            for answers in b.column("answers").to_pylist():
                for a in answers:
                    raw = np.frombuffer(a["answer"], np.int64).reshape(2, -1)
                    yield pa.record_batch({"u": pa.array(raw[0]), "n": pa.array(raw[1])})

    # Fewer than 2^bits contexts have more than a 2^-bits share of the tokens.
    hot = pairs.where("unit < 0").mapInArrow(spread, "u long, n long").groupBy("u").agg(F.sum("n").alias("n")).collect()
    by_word = {r["u"] % (1 << 64): r["n"] for r in hot}
    hot_words = np.array(sorted(by_word), np.uint64)
    hot_kinds = np.array([by_word[int(x)] for x in hot_words], np.int64)

    def finish(batches):
        for r in rows_of(batches):
            u = Unit(r, folds, fold)
            total = totals(r, u)
            inverse, left, right, count, order, shard = u.bigrams(total, n, bits)
            here = left[order]
            # The back-off weight of a context comes with each shard that has one of its bigrams.
            code, back = np.empty(len(order), np.uint16), np.empty(len(order), np.uint16)
            cut = np.r_[0, np.flatnonzero(np.diff(shard[order])) + 1, len(order)]
            for raw, a, b in zip(Ask.joined(r["bigrams"]), cut, cut[1:]):
                c, w = _unpacked(raw, 2)
                code[a:b] = np.frombuffer(c, np.uint16)
                new = np.r_[True, here[a + 1: b] != here[a: b - 1]]
                back[a:b] = np.frombuffer(w, np.uint16)[np.cumsum(new) - 1]
            seen, weight = np.empty(len(order)), np.empty(len(order))
            seen[order], weight[order] = _value(code), _value(back)
            weight[total[left] == 0] = 1.0
            if len(hot_words):
                at = np.minimum(np.searchsorted(hot_words, u.words), len(hot_words) - 1)
                lam = np.where(hot_words[at] == u.words, DISCOUNT * hot_kinds[at] / np.maximum(total, 1), -1.0)
                weight = np.where(lam[left] >= 0, lam[left], weight)
            p1 = (total + 0.5) / (n + 0.5 * (v + 1))
            logp = np.log10(seen + weight * p1[right])[inverse]
            base = np.log10(p1)[u.id]
            first = np.r_[0, u.end[:-1] + 1] if len(u.end) else u.end
            add = lambda x: np.add.reduceat(x, first) if len(first) else x
            yield pa.record_batch({
                "doc_id": pa.array(r["doc_id"], pa.int64()), "held_out": pa.array(u.held_out), "n_tokens": pa.array(u.n_tokens.astype(np.int64)),
                "n_known": pa.array(add((total > 0)[u.id].astype(np.int64))), "train_tokens": pa.array(np.full(len(first), n)),
                "base_score": pa.array(add(base)), "score": pa.array(add(logp))})

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return with_answers(packed, words=counted, bigrams=pairs).mapInArrow(finish, schema)


@query("op10_ngram_lm")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
