"""Helpers shared by the training-data operators: stage tables, blobs of words, hashes, components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuewise.session import checkpoint_dir

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a query of this subpackage, with its SQL where SQL can express it."""
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def bounded_batches(spark: SparkSession, size: int = 8 << 20) -> None:
    """Hand texts to Python in batches of bounded bytes, however long single texts are."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(key, str(size))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the cluster's shared folder; Spark deletes it when the application ends."""
    path = f"{checkpoint_dir(spark)}/cuewise-llm/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def settle(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write an intermediate table to the shared folder and read it back.

    Lineage ends there: a lost executor re-reads files, and every later branch reads the same rows.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files of a settled table that no later step reads."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/cuewise-llm/" in folder:
            hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---------------------------------------------------------------- word and byte hashes

U64 = np.uint64
_MASK = (1 << 64) - 1


def _splitmix(n: int, seed: int) -> np.ndarray:
    out = np.empty(n, U64)
    x = seed & _MASK
    for i in range(n):
        x = (x + 0x9E3779B97F4A7C15) & _MASK
        z = x
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & _MASK
        out[i] = z ^ (z >> 31)
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every input bit reaches every output bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class Roller:
    """Polynomial hashes modulo 2^64 of any stretch of a byte array, in constant time each.

    ``key`` picks one of a family of independent tables. The powers are kept between calls.
    """

    KEEP = 6 << 20

    def __init__(self, key: int = 0):
        self.code = _splitmix(256, 1000 + key)
        self.base = int(_splitmix(1, 77 + key)[0]) | 5
        self.inverse = pow(self.base, -1, 1 << 64)
        self.up, self.down = np.ones(1, U64), np.ones(1, U64)

    @staticmethod
    def shared() -> Roller:
        if not _ROLLER:
            _ROLLER.append(Roller())
        return _ROLLER[0]

    def _grow(self, n: int) -> None:
        # Powers for a long text go again with the next short one.
        if len(self.up) < n or len(self.up) > max(2 * n, self.KEEP):
            size = max(n, 1 << 16)
            for name, b in (("up", self.base), ("down", self.inverse)):
                p = np.full(size, b, U64)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))

    def sums(self, data: np.ndarray) -> np.ndarray:
        """Prefix sums of a byte array, one longer than it."""
        self._grow(len(data) + 1)
        out = np.zeros(len(data) + 1, U64)
        np.cumsum(self.code[data] * self.up[: len(data)], out=out[1:])
        return out

    def at(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Mixed hashes of the stretches [start, end)."""
        return mix((sums[end] - sums[start]) * self.down[start] + (end - start).astype(U64))


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PLAIN = _LOWER.copy()
_PLAIN[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 32
_ROLLER: list[Roller] = []


def words_of(data: np.ndarray, plain: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes, starts and ends of the words of a byte array.

    A word is a run of bytes outside 0x20 and 0x09-0x0D; A-Z are lower-cased first. ``plain`` counts
    ASCII punctuation as space.
    """
    data = (_PLAIN if plain else _LOWER)[data]
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~_SPACE[data]
    step = np.diff(inside)
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    r = Roller.shared()
    return r.at(r.sums(data), start, end), start, end


def joined(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The texts of a column, each followed by a line feed, as one byte array, with the n+1 offsets.

    Null texts count as empty. The line feed keeps words of neighbours apart.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    texts = column.cast(pa.large_binary())
    n = len(texts)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset: texts.offset + n + 1]
    size = np.diff(at)
    if column.null_count:
        size = np.where(np.asarray(column.is_valid()), size, 0)
    offsets = np.zeros(n + 1, np.int64)
    np.cumsum(size + 1, out=offsets[1:])
    out = np.full(offsets[-1], 10, np.uint8)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    if column.null_count or size.sum() != at[-1] - at[0]:
        for i in np.flatnonzero(size):
            out[offsets[i]: offsets[i] + size[i]] = raw[at[i]: at[i] + size[i]]
    else:
        keep = np.ones(len(out), bool)
        keep[offsets[1:] - 1] = False
        out[keep] = raw[at[0]: at[-1]]
    return out, offsets


def pieces(batch: pa.RecordBatch, column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each piece holds about ``limit`` bytes of text, or one row."""
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
    first, total = 0, 0
    for i, s in enumerate(size):
        if total and total + s > limit:
            yield batch.slice(first, i - first)
            first, total = i, 0
        total += s
    if first < batch.num_rows:
        yield batch.slice(first)


def distinct_sorted(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and how often each occurs."""
    if not len(x):
        return x, np.zeros(0, np.int64)
    x = np.sort(x)
    first = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
    return x[first], np.diff(np.r_[first, len(x)])


# ---------------------------------------------------------------- units of texts

def units(docs: DataFrame, size: int = 4 << 20) -> DataFrame:
    """Pack the rows (doc_id, text) into rows of about ``size`` bytes, written to the shared folder.

    One row is (unit LONG, doc_id ARRAY, length ARRAY, blob BINARY): whole texts one after another,
    each closed by a line feed. A row is never split, so a later stage can name an entry by its place in its unit and get
    answers back for that unit in that order. Null texts are empty.
    """
    schema = "unit long, doc_id array<long>, length array<long>, blob binary"

    def pack(batches):
        from pyspark import TaskContext

        part, k = TaskContext.get().partitionId(), 0
        ids, data, total = [], [], 0

        def row():
            nonlocal ids, data, total, k
            blob = np.concatenate(data) if data else np.zeros(0, np.uint8)
            out = pa.record_batch({
                "unit": pa.array([(part << 32) + k], pa.int64()), "doc_id": pa.array([[i for i, _ in ids]], pa.list_(pa.int64())),
                "length": pa.array([[n for _, n in ids]], pa.list_(pa.int64())), "blob": pa.array([blob.tobytes()], pa.binary())})
            ids, data, total, k = [], [], 0, k + 1
            return out

        for batch in batches:
            for piece in pieces(batch, "text", size):
                blob, offsets = joined(piece.column("text"))
                if total and total + len(blob) > size:
                    yield row()
                ids += zip(piece.column("doc_id").to_pylist(), (np.diff(offsets) - 1).tolist())
                data.append(blob)
                total += len(blob)
        if ids:
            yield row()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spark = docs.sparkSession
    name = f"units_{uuid.uuid4().hex}"
    # Bucketed, so that answers are brought to their units and texts are never shuffled.
    writer = rows.mapInArrow(pack, schema).write.bucketBy(partitions(spark), "unit").option("compression", "zstd")
    writer.option("path", shared_path(spark, "units")).saveAsTable(name)
    return spark.table(name)


class Ask:
    """One round of questions: which of a unit's hashes occur how often in all units.

    Each unit sends its distinct hashes, sorted and cut by their leading bits into packets; a packet is one row, so
    that the exchange carries 8 bytes a hash. All packets of a bucket meet in one task, which holds one bucket at
    a time and answers each packet in its own order. A hash that fills the corpus is sent once per unit.
    """

    PACKETS = "bucket long, unit long, hashes binary, extra binary"
    ANSWERS = "bucket long, unit long, answer binary"

    def __init__(self, spark: SparkSession):
        self.bits = max(4, (4 * partitions(spark) - 1).bit_length())

    def packets(self, unit: int, hashes: np.ndarray, extra: np.ndarray, code=np.ndarray.tobytes) -> pa.RecordBatch:
        """Rows for sorted distinct hashes with a number each, written by ``code``."""
        cut = np.searchsorted(hashes, np.arange(1, 1 << self.bits, dtype=np.uint64) << U64(64 - self.bits))
        cut = np.r_[0, cut, len(hashes)]
        full = np.flatnonzero(np.diff(cut))
        return pa.record_batch({
            "bucket": pa.array(full, pa.int64()), "unit": pa.array(np.full(len(full), unit), pa.int64()),
            "hashes": pa.array([hashes[cut[k]: cut[k + 1]].tobytes() for k in full], pa.binary()),
            "extra": pa.array([code(extra[cut[k]: cut[k + 1]]) for k in full], pa.binary())})

    def answers(self, packets: DataFrame, solve, name: str = "answers") -> DataFrame:
        """(unit, answers ARRAY<STRUCT<bucket, answer>>); solve(list of (hashes, extra)) gives one bytes answer
        for each, and may add one for the bucket, which is filed under unit -1."""
        def run(batches):
            held, now = [], None

            def out():
                got = solve([(np.frombuffer(h, U64), x) for _, h, x in held])
                whose = [u for u, *_ in held] + [-1] * (len(got) - len(held))
                return pa.record_batch({"bucket": pa.array([now] * len(got), pa.int64()), "unit": pa.array(whose, pa.int64()),
                                        "answer": pa.array(got, pa.binary())})

            for b in batches:
                for bucket, unit, h, x in zip(*(b.column(c).to_pylist() for c in ("bucket", "unit", "hashes", "extra"))):
                    if bucket != now:
                        if held:
                            yield out()
                        held, now = [], bucket
                    held.append((unit, h, x))
            if held:
                yield out()

        spark = packets.sparkSession
        dealt = packets.repartition(partitions(spark), "bucket").sortWithinPartitions("bucket", "unit")
        got = dealt.mapInArrow(run, self.ANSWERS)
        # One of a bucket's own rows per group: they are never gathered.
        own = F.when(F.col("unit") < 0, F.col("bucket"))
        grouped = got.groupBy("unit", own.alias("own")).agg(F.collect_list(F.struct("bucket", "answer")).alias("answers"))
        return settle(grouped.select("unit", "answers"), name)

    @staticmethod
    def joined(answers: list[dict] | None) -> list[bytes]:
        """A unit's answers in the order of its sorted hashes."""
        return [a["answer"] for a in sorted(answers or [], key=lambda a: a["bucket"])]


def squeezed(counts: np.ndarray) -> bytes:
    """Whole numbers as bytes; those of 255 and more follow in full."""
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[counts >= 255].astype("<u8").tobytes()


def expanded(raw: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(raw, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(raw, "<u8", offset=n).astype(np.int64)
    return out


def with_answers(asked: DataFrame, **answers: DataFrame) -> DataFrame:
    """Bring each unit the answers of earlier rounds, as one array column per round."""
    for name, a in answers.items():
        # Rows of the buckets' own, unit -1, would meet in one task.
        asked = asked.join(a.where("unit >= 0").select("unit", F.col("answers").alias(name)).hint("shuffle_hash"), "unit", "left")
    return asked


# ---------------------------------------------------------------- order and components

def totals_before(df: DataFrame, keys: list, sums: dict[str, str], name: str = "scan") -> DataFrame:
    """Add, for each name of ``sums``, the sum of its column over all rows that sort before.

    The rows are dealt out by ranges of ``keys`` and settled; each range adds up on its own and one
    row per range is scanned. Rows that tie on all keys stand in any order.
    """
    ranged = df.repartitionByRange(*keys)
    parts = settle(ranged.withColumn("__p", F.spark_partition_id()), name)
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    carry = parts.groupBy("__p").agg(*[F.sum(c).alias(f"__t_{n}") for n, c in sums.items()]).select(
        "__p", *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__t_{n}") for n in sums])
    inner = Window.partitionBy("__p").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    out = parts.select("*", *[F.coalesce(F.sum(c).over(inner), F.lit(0)).alias(f"__l_{n}") for n, c in sums.items()])
    out = out.join(F.broadcast(carry), "__p")  # a row per partition
    return out.select(*df.columns, *[(F.col(f"__l_{n}") + F.col(f"__t_{n}")).alias(n) for n in sums])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected edges (a LONG, b LONG); root is the smallest node.

    Rounds of large-star and small-star: each is two grouped minima and joins, so no group is
    gathered anywhere, and each round is settled. Rounds grow with the logarithm of the longest chain.
    """
    links = settle(edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "edges")

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            e = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(e.select("lo", "hi"))
        else:
            e = e.select(F.col("hi").alias("u"), F.col("lo").alias("v"))
        least = e.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        j = e.join(least, "u")
        if large:
            out = j.where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        else:
            out = j.where("v <> m").select(F.col("v").alias("hi"), F.col("m").alias("lo")).union(
                least.select(F.col("u").alias("hi"), F.col("m").alias("lo")))
        return out.where("hi <> lo").distinct()

    def state(df: DataFrame) -> tuple:
        # The number of edges and sums of their ends; a star forest reproduces itself.
        return tuple(df.agg(F.count("*"), F.sum(F.col("lo").cast("decimal(38,0)")), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())

    now = state(links)
    while now[0]:
        links = settle(star(star(links, True), False), "edges")
        then, now = now, state(links)
        if then == now:
            break
    nodes = links.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return nodes.union(links.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())


def hash_unit(*cols) -> Column:
    """A number in (0, 1) that depends on the columns alone."""
    return (F.shiftrightunsigned(F.xxhash64(*cols), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
