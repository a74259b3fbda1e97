"""The driver's parquet tables read as timed words, detections, energy and job events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuewise.functions.text import ends_with_any
from cuewise.operators.scan import WORDS_PER_CHUNK, Scan, chunk_in, running
from cuewise.sources.staging import staged

BUCKET_BYTES = 8 << 20  # text of a bucket of words


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def timed_words(texts: DataFrame, parts: int | None = None) -> DataFrame:
    """``(video_id, text)`` to ``words(video_id, pos, w, s_ms, e_ms, conf, chunk)``.

    Half a second per word, pauses after punctuation, fillers and numbers at fixed positions. Texts are dealt in chunks
    of words before they are taken apart, so a word is never shuffled on its own.
    """
    said = texts.select("video_id", F.split(F.trim("text"), r"\s+").alias("ws"))
    last = F.expr(f"(size(ws) - 1) div {WORDS_PER_CHUNK}")
    cells = said.select("video_id", F.posexplode(F.transform(
        F.sequence(F.lit(0).cast("long"), last),
        lambda k: F.array_join(F.slice("ws", (k * WORDS_PER_CHUNK + 1).cast("int"), F.lit(WORDS_PER_CHUNK)), " "))).alias("chunk", "ws"))
    cells = cells.withColumn("chunk", F.col("chunk").cast("long"))
    keys = ["video_id", "chunk"]
    cells = cells.repartition(*keys) if parts is None else cells.repartition(parts, *keys)
    raw = cells.select("video_id", "chunk", F.posexplode(F.split("ws", " ")).alias("at", "w0")).select(
        "video_id", "chunk", (F.col("chunk") * WORDS_PER_CHUNK + F.col("at")).alias("pos"), "w0")
    word = (
        F.when(F.expr("pos % 37 = 11"), "Um,")
        .when(F.expr("pos % 41 = 7"), "100")
        .when(F.expr("pos % 5 = 0 and endswith(w0, '.')"),
              F.expr("concat(substring(w0, 1, char_length(w0) - 1), '?')"))
        .otherwise(F.col("w0"))
    )
    pause = (
        F.when(ends_with_any("w", ".?!"), F.expr("if(pos % 2 = 0, 900L, 1900L)"))
        .when(F.col("w").endswith(","), F.lit(600).cast("long"))
        .otherwise(F.lit(0).cast("long"))
    )
    worded = raw.select("video_id", "pos", "chunk", word.alias("w")).withColumn("pause", pause)
    timed = running(worded, ["video_id"], ["pos"], F.col("chunk"), {"waited": Scan("sum", F.col("pause"))})
    start = F.col("pos") * 500 + F.col("waited")
    return timed.select("video_id", "pos", "w", start.alias("s_ms"), (start + 450).alias("e_ms"),
                        F.lit(0.9).alias("conf"), "chunk")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("video_id"), "text")


def ingest_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timed_words(_texts(spark, sf_dir))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words table of the documents, one video each, stored in buckets of ``(video_id, chunk)``: what looks along a
    video reads its chunks where they lie. Buckets grow in number with the texts, not in size."""
    def build() -> tuple[DataFrame, int]:
        texts = _texts(spark, sf_dir)
        size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
        return timed_words(texts, parts), parts

    return staged(spark, sf_dir, "words", build, ["video_id", "chunk"], "pos")


def talk_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second word source: one video per conversation, its turns in order."""
    turns = table(spark, sf_dir, "conversations")
    text = F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda t: t["text"]),
        " ",
    )
    return timed_words(turns.groupBy(F.col("conv_id").alias("video_id")).agg(text.alias("text")))


def durations(words_df: DataFrame) -> DataFrame:
    """Video length: the last word's end."""
    return words_df.groupBy("video_id").agg(F.max("e_ms").alias("duration_ms"))


def energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One mean-square value per 10 ms hop of every video, from its first word to its last."""
    return chunked_energy(spark, sf_dir).drop("chunk")


def chunked_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The energy with the ``chunk`` of each hop's word, where it lies."""
    runs = energy_runs(spark, sf_dir)
    return runs.select("video_id", F.explode(F.sequence(F.col("hop"), F.col("hop") + F.col("n") - 1)).alias("hop"), "ms", "chunk")


def energy_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The energy as runs: ``n`` hops of equal power from ``hop`` on, a row for a word and one for the silence after it."""
    w = words(spark, sf_dir)
    # Silence before the next word: the hops from this word's end to the next word's start, which for a chunk's last word is in the next chunk.
    starts = w.filter("chunk > 0").groupBy("video_id", (F.col("chunk") - 1).alias("chunk")).agg(F.min_by("s_ms", "pos").alias("after_s"))
    along = F.lead("s_ms").over(Window.partitionBy("video_id", "chunk").orderBy("pos"))
    timed = w.select("video_id", "chunk", "pos", "s_ms", "e_ms", along.alias("next_s")).join(starts, ["video_id", "chunk"], "left")
    first, end, stop = F.expr("s_ms div 10"), F.expr("e_ms div 10"), F.expr("greatest(e_ms, coalesce(next_s, after_s, e_ms)) div 10")
    run = lambda a, b, ms: F.struct(a.alias("hop"), (b - a).alias("n"), ms.alias("ms"))
    both = F.array(run(first, end, 0.01 * (1 + F.col("pos") % 7)), run(end, stop, F.lit(1e-9)))
    return timed.select("video_id", "chunk", F.explode(both).alias("x")).select("video_id", "x.*", "chunk").filter("n > 0")


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Face detections: order lines as boxes, orders as frames."""
    li = table(spark, sf_dir, "lineitem")
    order = Window.partitionBy("l_orderkey").orderBy(
        "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"
    )
    return li.select(
        F.expr("l_orderkey div 1000").alias("video_id"),
        F.col("l_orderkey").alias("frame"),
        F.row_number().over(order).cast("long").alias("det"),
        ((F.col("l_linenumber") - 1) * 260 + F.col("l_quantity")).alias("x"),
        (200 + F.col("l_tax") * 1000).alias("y"),
        (180 + F.col("l_quantity")).alias("w"),
        (200 + F.col("l_discount") * 400).alias("h"),
        (0.5 + F.col("l_discount") * 5).alias("score"),
    )


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_job_events(table(spark, sf_dir, "events"))


def as_job_events(events: DataFrame) -> DataFrame:
    """Works on batch and streaming input."""
    kind = (
        F.when(F.col("event_type") == "view", "clip_track")
        .when(F.col("event_type") == "click", "clip_render")
        .when(F.col("event_type") == "signup", "clips_picked")
        .when(F.col("event_type") == "purchase", "clip_done")
        .otherwise("job_failed")
    )
    return events.select(
        F.col("user_id").alias("job"), "event_id", "ts", kind.alias("type"),
        (F.col("event_id") % 3 + 1).alias("rank"),
        (F.floor("value").cast("long") % 101).alias("pct"),
    )


def record_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as the whole log of a job: stages, picks of one to four ranks (every third one a redo), progress, finished clips and variants."""
    kind = """CASE event_type WHEN 'view' THEN if(event_id % 3 = 0, 'stage', 'clip_track') WHEN 'click' THEN if(event_id % 4 = 0, 'clip_variant', 'clip_render')
      WHEN 'signup' THEN 'clips_picked' WHEN 'purchase' THEN 'clip_done' ELSE if(event_id % 2 = 0, 'job_done', 'job_failed') END"""
    stages = "array('download', 'audio', 'transcribe', 'pick', 'track', 'render', 'merge', 'kit', 'done')"
    return table(spark, sf_dir, "events").selectExpr(
        "user_id AS job", "event_id", "ts", f"{kind} AS type", f"{stages}[cast(event_id div 3 % 9 as int)] AS stage",
        "sequence(1L, 1L + event_id % 4) AS ranks", "event_id % 3 = 1 AS redo", "event_id % 3 + 1 AS rank",
        "cast(floor(value) as long) % 101 AS pct", "array('9:16', '1:1', '16:9')[cast(event_id div 4 % 3 as int)] AS aspect", "concat('v', event_id) AS file")


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge logits: the numbers of each embedding."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("cand"),
        F.transform("embedding", lambda x: x.cast("double")).alias("z"),
        (0.5 + 0.1 * F.col("label")).alias("temp"),
    )
