"""A corpus pipeline: quality, near duplicates, benchmark leaks, source mix, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again before the next. All but
the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuewise.llm import op1_planes, op2_decontaminate, op3_quality, op4_mixing, op6_lsh_forest
from cuewise.llm.common import settle, table

ORACLE_SQL = None


def _keyed(docs: DataFrame) -> DataFrame:
    """docs, written, with a key of its own for each row, ascending in their order."""
    return settle(docs.withColumn("__row", F.monotonically_increasing_id()), "keyed")


def _by_key(keyed: DataFrame) -> DataFrame:
    return keyed.select(F.col("__row").alias("doc_id"), "text")


def _without(keyed: DataFrame, found: DataFrame) -> DataFrame:
    """The rows whose keys are not among found's doc_ids."""
    gone = settle(found.select(F.col("doc_id").alias("__row")).distinct(), "gone")
    return keyed.join(gone, "__row", "left_anti").drop("__row")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose chance of the top grade is at least a half; the model is fitted on the labelled ones."""
    model = op3_quality.fit(docs, op3_quality.grades(table(spark, sf_dir, "labels")))
    return op3_quality.grade(docs, model).where(op3_quality.keeps()).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: the one of the smallest doc_id; null doc_ids come last.

    Each row is a document of its own, decided by its text: of rows that share a doc_id and differ in text all stay. Rows without words
    stay.
    """
    # Keys in the order of doc_id, so that the smallest key of a group is the row that stays; equal rows in any order.
    order = [F.col("doc_id").asc_nulls_last(), F.col("__tie"), F.col("__at")]
    tied = docs.withColumn("__tie", F.xxhash64(*docs.columns)).withColumn("__at", F.monotonically_increasing_id())
    keyed = _keyed(tied.repartitionByRange(*order).sortWithinPartitions(*order).drop("__tie", "__at"))
    return _without(keyed, op6_lsh_forest.link(_by_key(keyed)).where("not kept"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a verified passage of a benchmark item, each judged by its own text whatever its doc_id."""
    keyed = _keyed(docs)
    return _without(keyed, op2_decontaminate.find_leaks(_by_key(keyed), table(spark, sf_dir, "benchmark")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once or more: sources in code point order get 1, 1.5 and 2 times their size, repeating.

    What goes beyond a source's complete epoch is drawn by quality weight. A document taken twice stands twice.
    """
    weight = (1 + (F.col("rank") % 3) / 2) * F.col("source_size")
    mixed = op4_mixing.mix(docs, weight, op4_mixing.readable(F.col("text")), budget=None)
    # Texts of no words have no size to be drawn by; they stay once.
    times = F.greatest(F.col("copies"), F.when(F.col("size") == 0, F.lit(1)).otherwise(F.lit(0)))
    return mixed.withColumn("__n", F.explode(F.array_repeat(F.lit(1), times.cast("int")))).select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed documents as plane-shuffled token ids; returns each one's place, length and checksum, read from the files."""
    import public_tokenizers

    path = op1_planes.encode(docs, public_tokenizers.path("word_bpe_49k.json"))
    return op1_planes.read(spark, path)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("mix", mix), ("token_ids", token_ids)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = settle(docs, name)
    return docs
