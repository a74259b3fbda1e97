"""Removal of repeated byte strings with a difference-cover sample of suffixes.

A byte goes if it is covered by a string of ``length`` bytes that also starts somewhere else. The
distributed difference-cover algorithm sorts a sample of all suffixes, names them recursively and derives the rest
from them. Only equality of ``length``-byte prefixes is asked here, so names are 64-bit hashes and
suffixes are sorted by name:

1. Suffixes at positions (inside a document) whose residue mod v lies in a perfect difference set are sampled:
   q + 1 of every v = q^2 + q + 1. For any two positions some shift below v puts both into the sample. Their
   first length - v + 1 bytes are named, and the sorted names show which occur again.
2. Recursion: around each sampled suffix whose name occurs again, the longer string of all windows that hold the
   sample at a shift below v is named. If that occurs again, all its windows do. Sorting the first names once more tells
   which of these decided samples share their name with an undecided one.
3. The remaining suffixes are merged in: undecided windows near a repeated sample are named whole, with one
   copy of the decided windows they could be equal to, and equal neighbours in sorted order are repeats.

Names travel as packets of sorted hashes (see common.Ask); answers come back as one bit per name, so text is
never shuffled and a string that fills the corpus is sent once per unit of 4 MB.
Two different strings share a 64-bit name with a chance of 2^-64: among n windows asked in step 3 some n^2 / 2^65
wrong removals are to be expected. Steps 1 and 2 use other hash families than step 3.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from cuewise.llm.common import Ask, Roller, bounded_batches, distinct_sorted, query, table, units, with_answers

LENGTH = 400
_KEEP: dict = {}


def difference_set(q: int) -> tuple[int, np.ndarray]:
    """v = q^2 + q + 1 and a perfect difference set mod v of q + 1 residues, for a prime q (Singer's construction)."""
    v = q * q + q + 1
    for a in range(q):
        for b in range(q):
            for c in range(1, q):
                # Powers of x modulo x^3 = a x^2 + b x + c; those without an x^2 term form a line.
                x, found = (1, 0, 0), []
                for i in range(v):
                    if x[2] == 0:
                        found.append(i)
                    x = (c * x[2] % q, (x[0] + b * x[2]) % q, (x[1] + a * x[2]) % q)
                if len(found) == q + 1 and len({(i - j) % v for i in found for j in found}) == v:
                    return v, np.array(found)
    raise ValueError("q must be prime")


def _prime_for(length: int) -> int:
    """The largest prime q up to 17 whose sample names keep at least a fifth of ``length``."""
    return max(q for q in (2, 3, 5, 7, 11, 13, 17) if q == 2 or q * q + q + 1 <= 0.8 * length)


class Unit:
    """A unit's texts, their prefix sums and the repeats known so far."""

    def __init__(self, blob: bytes, length: list[int], want: int):
        if want not in _KEEP:
            _KEEP[want] = (*difference_set(_prime_for(want)), Roller(11), Roller(12))
        self.v, cover, self.r1, self.r3 = _KEEP[want]
        self.data, self.want = np.frombuffer(blob, np.uint8), want
        self.size = np.array(length, np.int64)
        self.start = np.r_[0, np.cumsum(self.size + 1)][:-1]
        self.name = want - self.v + 1
        long = np.flatnonzero(self.size >= want)
        most = int(self.size.max()) if len(self.size) else 0
        pattern = (np.arange(0, most + self.v, self.v)[:, None] + cover[None]).ravel()
        pattern.sort()
        ends = np.searchsorted(pattern, self.size[long] - self.name, "right")
        self.p = np.concatenate([pattern[:e] + s for e, s in zip(ends, self.start[long])] or [np.zeros(0, np.int64)])
        self.doc = np.repeat(long, ends)
        self.sums = self.r1.sums(self.data)

    def names(self) -> np.ndarray:
        return self.r1.at(self.sums, self.p, self.p + self.name)

    def spans(self, again: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Name, first byte and end of the string of windows around each sample that occurs again."""
        self.p, self.doc = self.p[again], self.doc[again]
        first, end = self.start[self.doc], self.start[self.doc] + self.size[self.doc]
        a, b = np.maximum(first, self.p - self.v + 1), np.minimum(end, self.p + self.want)
        a = np.minimum(a, b - self.want)
        return self.r1.at(self.sums, a, b), a, b

    def _union(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        n = len(self.data)
        mark = np.bincount(lo, minlength=n + 1) - np.bincount(hi, minlength=n + 1)
        return np.cumsum(mark[:n]) > 0

    def _reach(self, which: np.ndarray) -> np.ndarray:
        """The windows that hold the name of one of these samples."""
        first, last = self.start[self.doc[which]], self.start[self.doc[which]] + self.size[self.doc[which]] - self.want
        lo, hi = np.maximum(first, self.p[which] - self.v + 1), np.minimum(last, self.p[which]) + 1
        ok = lo < hi
        return self._union(lo[ok], hi[ok])

    def windows(self, a: np.ndarray, b: np.ndarray, whole: np.ndarray, show: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which positions are windows known to be repeated, which are to be asked, and which known ones to be shown."""
        known = self._union(a[whole], b[whole] - self.want + 1)
        near = self._reach(np.flatnonzero(~whole))
        shown = (near | self._reach(np.flatnonzero(show))) & known
        return known, np.flatnonzero(near & ~known), np.flatnonzero(shown)

    def window_names(self, at: np.ndarray) -> np.ndarray:
        return self.r3.at(self.r3.sums(self.data), at, at + self.want)


def _question(hashes: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes with their summed weights (1 each by default), 2 at most."""
    if not len(hashes):
        return hashes, np.zeros(0, np.uint8)
    order = np.argsort(hashes)
    ordered = hashes[order]
    first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    total = np.diff(np.r_[first, len(hashes)]) if weight is None else np.add.reduceat(weight[order].astype(np.int64), first)
    return ordered[first], np.minimum(total, 2).astype(np.uint8)


def _tally(least: int):
    """Two bits per hash of each packet: whether its weights in all packets sum to ``least``, and whether the packet is the first that has it."""
    def solve(parts: list) -> list[bytes]:
        every = np.concatenate([h for h, _ in parts])
        weight = np.concatenate([np.frombuffer(x, np.uint8) for _, x in parts]).astype(np.int64)
        order = np.argsort(every, kind="stable")
        first = np.flatnonzero(np.r_[True, every[order][1:] != every[order][:-1]])
        enough, owner = np.empty(len(every), bool), np.zeros(len(every), bool)
        enough[order] = np.repeat(np.add.reduceat(weight[order], first) >= least, np.diff(np.r_[first, len(every)]))
        owner[order[first]] = True
        cut = np.cumsum([len(h) for h, _ in parts])[:-1]
        return [np.packbits(e).tobytes() + np.packbits(o).tobytes() for e, o in zip(np.split(enough, cut), np.split(owner, cut))]

    return solve


def _flags(answers, hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A round's two bits for each of the hashes, in their own order."""
    distinct, _ = distinct_sorted(hashes)
    if not len(distinct):
        return np.zeros(0, bool), np.zeros(0, bool)
    n = np.bincount((distinct >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    enough, owner = [], []
    for raw, k in zip(Ask.joined(answers), n[n > 0].tolist()):
        both = np.frombuffer(raw, np.uint8)
        enough.append(np.unpackbits(both[: len(both) // 2], count=k))
        owner.append(np.unpackbits(both[len(both) // 2:], count=k))
    at = np.searchsorted(distinct, hashes)
    return np.concatenate(enough).astype(bool)[at], np.concatenate(owner).astype(bool)[at]


def remove_repeats(docs: DataFrame, length: int = LENGTH, what: str = "digest") -> DataFrame:
    """One row per row of (doc_id, text): doc_id, n_bytes, n_removed, n_spans and kept_sha256, or with
    ``what="text"`` instead of the digest kept BINARY and spans ARRAY<[first, end)>.

    Null texts count as empty; texts shorter than ``length`` lose nothing. Repeated rows are documents of their
    own, so equal long texts lose all. Other columns are ignored, null ids stay null.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    packed, ask = units(docs), Ask(spark)
    bits = ask.bits

    def rows_of(batches):
        for b in batches:
            for k in range(b.num_rows):
                yield {c: b.column(c)[k].as_py() for c in b.schema.names}

    def ask1(batches):
        for r in rows_of(batches):
            yield ask.packets(r["unit"], *_question(Unit(r["blob"], r["length"], length).names()))

    def spans(r):
        u = Unit(r["blob"], r["length"], length)
        first = u.names()
        again = _flags(r["one"], first, bits)[0]
        return (u, first[again], *u.spans(again))

    def ask2(batches):
        for r in rows_of(batches):
            u, _, name, a, b = spans(r)
            # Near the ends of a document several samples have the same string; it is one occurrence.
            place = np.unique(a * (len(u.data) + 1) + b, return_index=True)[1]
            yield ask.packets(r["unit"], *_question(name[place]))

    def ask2b(batches):
        for r in rows_of(batches):
            _, first, name, *_ = spans(r)
            yield ask.packets(r["unit"], *_question(first, ~_flags(r["two"], name, bits)[0]))

    def decided(r):
        u, first, name, a, b = spans(r)
        whole, owner = _flags(r["two"], name, bits)
        mixed = _flags(r["mixed"], first, bits)[0]
        return (u, *u.windows(a, b, whole, whole & owner & mixed))

    def ask3(batches):
        for r in rows_of(batches):
            u, _, asked, shown = decided(r)
            names = u.window_names(np.r_[asked, shown])
            yield ask.packets(r["unit"], *_question(names, np.r_[np.ones(len(asked), np.uint8), np.full(len(shown), 2, np.uint8)]))

    def finish(batches):
        for r in rows_of(batches):
            u, known, asked, shown = decided(r)
            again = _flags(r["three"], u.window_names(np.r_[asked, shown]), bits)[0]
            known[asked[again[: len(asked)]]] = True
            mark = np.zeros(len(u.data) + length + 1, np.int32)
            hit = np.flatnonzero(known)
            mark[hit] += 1
            mark[hit + length] -= 1
            gone = np.cumsum(mark[: len(u.data)]) > 0
            out = {c: [] for c in schema_names}
            for doc, s, n in zip(r["doc_id"], u.start.tolist(), u.size.tolist()):
                g, t = gone[s: s + n], u.data[s: s + n]
                edge = np.flatnonzero(np.diff(np.r_[False, g, False]))
                kept = t[~g].tobytes()
                row = [doc, n, int(g.sum()), len(edge) // 2]
                row += [hashlib.sha256(kept).hexdigest()] if what == "digest" else [kept, edge.reshape(-1, 2).tolist()]
                for c, value in zip(schema_names, row):
                    out[c].append(value)
            yield pa.record_batch([pa.array(out[c], t) for c, t in zip(schema_names, kinds)], names=schema_names)

    tail = "kept_sha256 string" if what == "digest" else "kept binary, spans array<array<long>>"
    kinds = [pa.int64()] * 4 + ([pa.string()] if what == "digest" else [pa.binary(), pa.list_(pa.list_(pa.int64()))])
    schema_names = ["doc_id", "n_bytes", "n_removed", "n_spans", *(["kept_sha256"] if what == "digest" else ["kept", "spans"])]
    one = ask.answers(packed.mapInArrow(ask1, Ask.PACKETS), _tally(2), "names")
    two = ask.answers(with_answers(packed, one=one).mapInArrow(ask2, Ask.PACKETS), _tally(2), "spans")
    mixed = ask.answers(with_answers(packed, one=one, two=two).mapInArrow(ask2b, Ask.PACKETS), _tally(1), "mixed")
    three = ask.answers(with_answers(packed, one=one, two=two, mixed=mixed).mapInArrow(ask3, Ask.PACKETS), _tally(2), "windows")
    all_rounds = with_answers(packed, one=one, two=two, mixed=mixed, three=three)
    return all_rounds.mapInArrow(finish, f"doc_id long, n_bytes long, n_removed long, n_spans long, {tail}")


@query("op7_repeat_removal")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
