"""Token ids in plane-shuffled blocks.

Ids are stored as rows of a Parquet table, one row per block of at most ``block`` ids:

    shard INT, block INT       blocks of a shard follow each other; shards follow in doc_id order
    first LONG                 ids of the shard before this block
    n INT, width INT           ids in the block; planes kept (the highest plane with a set bit, plus one)
    planes BINARY, ends ARRAY  the planes one after another, each compressed with zstandard; where each ends
    doc_id, length ARRAY       documents that begin in this block, with all their ids counted

An id block is transposed into planes: plane j holds byte (or bit) j of every id, so that the nearly
constant high planes shrink to a few bytes. The chunk index is a second table (shard, block, first,
start, n, bytes) with the global position of every block, read without touching the planes.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuewise.llm.common import Roller, bounded_batches, joined, partitions, pieces, query, shared_path, table

BLOCK = 1 << 16
KNOWN = 2_000_000  # entries of a worker's cache; it starts anew beyond that

# What the tokenizer's \s takes for space; of what str.isspace() takes besides, it takes nothing.
SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
SEPARATORS = "\x1c\x1d\x1e\x1f"
# Bytes that may begin space outside ASCII or an added token.
RARE = re.compile(rb"<\||\xc2[\x85\xa0]|\xe1\x9a|\xe2[\x80\x81]|\xe3\x80")

_STATE: dict = {}

# Kinds of bytes, as the tokenizer's pattern parts them: space, letters, digits (each alone), anything else; words with bytes of the last kind
# (apostrophes, which begin contractions, and what is neither ASCII nor a Latin-1 letter) are left whole.
_SPACE_, _LETTER, _DIGIT, _OTHER, _WHOLE = range(5)
_KINDS = np.full(256, _OTHER, np.uint8)
_KINDS[[9, 10, 11, 12, 13, 32]] = _SPACE_
_KINDS[[*range(65, 91), *range(97, 123)]] = _LETTER
_KINDS[48:58] = _DIGIT
_KINDS[128:] = _WHOLE
_KINDS[ord("'")] = _WHOLE


def _lowered(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes with A-Z and the capitals of Latin-1 lower-cased, and the kind of each."""
    data, kind = data.copy(), _KINDS[data]
    data[(data >= 65) & (data <= 90)] += 32
    lead = np.flatnonzero(data[:-1] == 0xC3) if len(data) else np.zeros(0, np.int64)
    last = data[lead + 1]
    letter = (last != 0x97) & (last != 0xB7)
    kind[lead[letter]], kind[lead[letter] + 1] = _LETTER, _LETTER
    data[lead[letter & (last < 0x9F)] + 1] += 32
    return data, kind


def _cut(kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the parts that the tokenizer encodes on their own, or of whole words."""
    inside = np.r_[False, kind != _SPACE_, False]
    step = np.diff(inside.astype(np.int8))
    first, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    begins = (np.r_[True, kind[1:] != kind[:-1]] | (kind == _DIGIT))[: len(kind)] & (kind != _SPACE_)
    odd = np.r_[0, np.cumsum(kind == _WHOLE)]
    whole = np.flatnonzero(odd[end] > odd[first])
    for a, b in zip(first[whole].tolist(), end[whole].tolist()):
        begins[a + 1: b] = False
    start = np.flatnonzero(begins)
    stop = np.r_[start[1:], 0]
    last = np.searchsorted(start, end) - 1
    stop[last] = end
    return start, stop


def transposed(ids: np.ndarray, bits: bool) -> list[bytes]:
    """The planes of a block of unsigned 32-bit ids, lowest first, without the empty high ones."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if bits:
        raw = np.unpackbits(raw, axis=1, bitorder="little")
    planes = [np.ascontiguousarray(raw[:, j]) for j in range(raw.shape[1])]
    while planes and not planes[-1].any():
        planes.pop()
    return [(np.packbits(p, bitorder="little") if bits else p).tobytes() for p in planes]


def restored(planes: list[bytes], n: int, bits: bool) -> np.ndarray:
    """The block whose planes these are."""
    out = np.zeros((n, 32 if bits else 4), np.uint8)
    for j, p in enumerate(planes):
        a = np.frombuffer(p, np.uint8)
        out[:, j] = np.unpackbits(a, count=n, bitorder="little") if bits else a
    if bits:
        out = np.packbits(out, axis=1, bitorder="little")
    return np.ascontiguousarray(out).view("<u4").reshape(-1)


class Encoder:
    """The ids of whole texts, part by part.

    The tokenizer turns space into blanks, lower-cases, cuts texts into letters, digits and the rest, and never joins across a cut, so the
    ids of a text are those of its parts one after another. A worker keeps the ids of parts by their 64-bit hashes in flat arrays. New
    parts of letters are encoded many at a time by the tokenizer's model alone; others, and words that are left whole, by all of it.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole, self.model = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.model.normalizer = None
        self.model.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.closes = np.zeros(self.whole.get_vocab_size() + 1, bool)  # ids that end a part
        self.closes[[i for t, i in self.whole.get_vocab().items() if t.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.hashes, self.first, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat, self.used = np.zeros(1 << 16, "<u4"), 0

    def _ids(self, parts: list[str], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the parts and how many each has."""
        n = np.zeros(len(parts), np.int64)
        plain, rest = np.flatnonzero(letters), np.flatnonzero(~letters)
        ids = np.array(self.model.encode_batch_fast([" ".join(parts[k] for k in plain)], add_special_tokens=False)[0].ids, "<u4") if len(plain) else np.zeros(0, "<u4")
        end = np.flatnonzero(self.closes[ids]) + 1
        if len(end) != len(plain):
            rest, plain, ids, end = np.arange(len(parts)), plain[:0], ids[:0], end[:0]
        n[plain] = np.diff(np.r_[0, end])
        others = [e.ids for e in self.whole.encode_batch_fast([parts[k] for k in rest], add_special_tokens=False)]
        n[rest] = [len(x) for x in others]
        out, at = np.empty(int(n.sum()), "<u4"), np.cumsum(n) - n
        out[np.repeat(at[plain] - (np.cumsum(n[plain]) - n[plain]), n[plain]) + np.arange(len(ids))] = ids
        for k, x in zip(rest.tolist(), others):
            out[at[k]: at[k] + len(x)] = x
        return out, n

    def _learn(self, hashes: np.ndarray, parts: list[str], letters: np.ndarray) -> None:
        """Keep the ids of parts with these sorted, distinct, unknown hashes."""
        ids, n = self._ids(parts, letters)
        if self.used + len(ids) > len(self.flat):
            self.flat = np.r_[self.flat[: self.used], np.zeros(max(len(ids), self.used) + (1 << 16), "<u4")]
        self.flat[self.used: self.used + len(ids)] = ids
        at = np.searchsorted(self.hashes, hashes)
        self.first = np.insert(self.first, at, self.used + np.cumsum(n) - n)
        self.n, self.hashes = np.insert(self.n, at, n), np.insert(self.hashes, at, hashes)
        self.used += len(ids)

    def __call__(self, column: pa.Array | pa.ChunkedArray) -> list[np.ndarray]:
        """The ids of each text of a column of some megabyte; null texts have none."""
        if len(self.hashes) > KNOWN:
            self.forget()
        data, offsets = joined(column)
        special = {}
        if RARE.search(data.tobytes()):
            # Other white space becomes blanks. Added tokens are found in the text as it stands, so texts that may hold one go to the tokenizer whole.
            texts = [t or "" for t in column.to_pylist()]
            special = {k: t for k, t in enumerate(texts) if "<|" in t}
            data, offsets = joined(pa.array(["" if k in special else SPACE.sub(" ", t) for k, t in enumerate(texts)], pa.large_string()))
        data, kind = _lowered(data)
        start, stop = _cut(kind)
        roller = Roller.shared()
        hashes = roller.at(roller.sums(data), start, stop)
        place = np.minimum(np.searchsorted(self.hashes, hashes), max(0, len(self.hashes) - 1))
        new = np.flatnonzero(self.hashes[place] != hashes) if len(self.hashes) else np.arange(len(hashes))
        if len(new):
            distinct, at = np.unique(hashes[new], return_index=True)
            a, b = start[new[at]], stop[new[at]]
            raw, other = data.tobytes(), np.r_[0, np.cumsum(kind != _LETTER)]
            self._learn(distinct, [raw[x:y].decode() for x, y in zip(a.tolist(), b.tolist())], other[a] == other[b])
            place = np.searchsorted(self.hashes, hashes)
        n = self.n[place] if len(place) else np.zeros(0, np.int64)
        end = np.cumsum(n)
        ids = self.flat[np.repeat(self.first[place] - (end - n), n) + np.arange(int(end[-1]))] if len(place) else self.flat[:0]
        cut = np.r_[0, end][np.searchsorted(start, offsets)].tolist()
        out = [ids[a:b] for a, b in zip(cut, cut[1:])]
        for k, t in special.items():
            out[k] = np.array(self.whole.encode(t, add_special_tokens=False).ids, "<u4")
        return out


def _encoder(path: str) -> Encoder:
    """The worker's encoder of a tokenizer file."""
    if _STATE.get("path") != path:
        _STATE.update(path=path, encoder=Encoder(path))
    return _STATE["encoder"]


def encode(docs: DataFrame, tokenizer: str, end_id: int = 1, block: int = BLOCK, bits: bool = False,
           level: int = 3, path: str | None = None) -> str:
    """Tokenize (doc_id, text), write the blocks in ascending doc_id order and return their folder.

    Null doc_ids come first, rows of equal doc_id in an order fixed by their text. A null or empty
    text has only the end id. Other columns are ignored. Each range of doc_ids is a shard, written
    by one task with Spark's commit protocol, so that a repeated task leaves no second copy.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    path = path or shared_path(spark, "ids")
    schema = ("shard int, block int, first long, n int, width int, planes binary, ends array<int>, "
              "doc_id array<long>, length array<long>")

    def write(batches):
        import zstandard
        from pyspark import TaskContext

        shard, packer, run = TaskContext.get().partitionId(), zstandard.ZstdCompressor(level=level), _encoder(tokenizer)
        held, n_held, k, first, docs_here = [], 0, 0, 0, []

        def cut(ids: np.ndarray, begun: list) -> pa.RecordBatch:
            nonlocal k, first
            packed = [packer.compress(p) for p in transposed(ids, bits)]
            row = {"shard": shard, "block": k, "first": first, "n": len(ids), "width": len(packed), "planes": b"".join(packed),
                   "ends": np.cumsum([len(p) for p in packed]).tolist(), "doc_id": [i for _, i, _ in begun], "length": [n for *_, n in begun]}
            k, first = k + 1, first + len(ids)
            return pa.RecordBatch.from_pylist([row], schema=ARROW)

        for batch in batches:
            for piece in pieces(batch, "text"):
                for doc, ids in zip(piece.column("doc_id").to_pylist(), run(piece.column("text"))):
                    docs_here.append((first + n_held, doc, len(ids) + 1))
                    held += [ids, np.array([end_id], "<u4")]
                    n_held += len(ids) + 1
                    if n_held >= block:
                        every = np.concatenate(held)
                        at = 0
                        while n_held - at >= block:
                            begun = [d for d in docs_here if d[0] < first + block]
                            docs_here = docs_here[len(begun):]
                            yield cut(every[at: at + block], begun)
                            at += block
                        held, n_held = [every[at:]], n_held - at
        if n_held:
            yield cut(np.concatenate(held), docs_here)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tie = F.xxhash64("text")
    ranged = rows.withColumn("tie", tie).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    ranged.select("doc_id", "text").mapInArrow(write, schema).write.option("compression", "none").parquet(f"{path}/blocks")
    blocks = spark.read.parquet(f"{path}/blocks")
    _with_start(blocks).select("shard", "block", "first", "start", "n", F.element_at("ends", -1).alias("bytes")).write.parquet(f"{path}/index")
    return path


ARROW = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("n", pa.int32()), ("width", pa.int32()),
                   ("planes", pa.binary()), ("ends", pa.list_(pa.int32())), ("doc_id", pa.list_(pa.int64())), ("length", pa.list_(pa.int64()))])


def _with_start(blocks: DataFrame) -> DataFrame:
    """Add ``start``, the ids before a block in the whole file: one row per shard is scanned."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = blocks.groupBy("shard").agg(F.sum("n").alias("n")).select(
        "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return blocks.join(F.broadcast(shards), "shard").withColumn("start", F.col("base") + F.col("first")).drop("base")


def read(spark: SparkSession, path: str, what: str = "digest", bits: bool = False) -> DataFrame:
    """Documents from the files: (doc_id, start, n_tokens, ids_crc32), and with ``what="ids"`` their ids.

    Blocks of a shard go to one task in their order and are undone one at a time; a document that
    runs over many blocks is summed on the way, never held (with ids, only it is held).
    """
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if what == "ids" else "")
    arrow = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
    arrow += [("ids", pa.list_(pa.int64()))] if what == "ids" else []

    def decode(batches):
        import zstandard

        unpack, open_docs, out, at, kept = zstandard.ZstdDecompressor(), [], [], 0, []
        crc, need = 0, 0
        for batch in batches:
            for row in batch.to_pylist():
                cuts = [0, *row["ends"]]
                ids = restored([unpack.decompress(row["planes"][a:b]) for a, b in zip(cuts, cuts[1:])], row["n"], bits)
                if row["block"] == 0:
                    open_docs, at, crc, need, kept = [], row["start"], 0, 0, []
                open_docs += zip(row["doc_id"], row["length"])
                used = 0
                while open_docs and used < len(ids):
                    doc, n = open_docs[0]
                    need = need or n
                    part = ids[used: used + need]
                    crc, need, used = zlib.crc32(part.tobytes(), crc), need - len(part), used + len(part)
                    if what == "ids":
                        kept.append(part.astype(np.int64))
                    if not need:
                        out.append((doc, at, n, crc, *([np.concatenate(kept)] if what == "ids" else [])))
                        open_docs.pop(0)
                        at, crc, kept = at + n, 0, []
            if out:
                yield pa.record_batch([pa.array(c, t) for c, (_, t) in zip(zip(*out), arrow)], names=[n for n, _ in arrow])
                out = []

    blocks = _with_start(spark.read.parquet(f"{path}/blocks"))
    shards = blocks.repartition(partitions(spark), "shard").sortWithinPartitions("shard", "block")
    return shards.select("shard", "block", "start", "n", "planes", "ends", "doc_id", "length").mapInArrow(decode, schema)


@query("op1_token_planes")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = encode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return read(spark, path)
