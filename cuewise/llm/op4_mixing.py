"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document gets the key -ln(u) / weight, u in (0, 1) from a hash of the document: taking documents in
ascending order of the key is sampling without replacement with chances proportional to the weights.
A source's target of k times its size plus a rest is met by k complete epochs and then by documents
in key order until their summed size comes nearest to the rest.

Nothing is sorted whole. Each source's keys fall into about sqrt(n) buckets by the key's place in
(0, 1); sizes are summed by bucket, so that one bucket of a source holds the cut, and only that
bucket's documents are sorted. Buckets before it are taken, buckets after it are not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuewise.llm.common import hash_unit, query, settle, table, totals_before

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Runs of bytes outside 0x20 and 0x09-0x0D; 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weight: Column, budget: float | None = 1.0, epochs: int = 3) -> DataFrame:
    """Add ``target`` to (source, source_size): shares of ``budget`` times all sizes, by ``weight``.
    Without a budget the weights are themselves the words wanted.

    ``weight`` may use ``rank``, the 0-based place of the source by code point, null last. No target
    exceeds ``epochs`` times its source's size; what is above goes to the others by weight until none
    is above. That end state is target = least(cap, weight * level) for one level, found from the
    running sums of caps and weights in the order of cap / weight.
    """
    ranked = totals_before(sources.withColumn("one", F.lit(1).cast("long")), [F.asc_nulls_last("source")], {"rank": "one"})
    ranked = ranked.select("source", "source_size", weight.cast("double").alias("w"), (F.lit(epochs) * F.col("source_size")).cast("double").alias("cap")).withColumn("w", F.greatest("w", F.lit(0.0)))
    ranked = settle(ranked.withColumns({"ratio": F.try_divide("cap", "w"), "one": F.lit(1).cast("long")}))
    whole = ranked.agg(F.sum("w").alias("all_w"), (F.sum("w") if budget is None else F.sum("source_size") * F.lit(budget)).alias("total"))
    filled = totals_before(ranked, ["ratio", F.asc_nulls_last("source")], {"caps": "cap", "ws": "w", "nth": "one"})
    # Sources before the first that stays below its cap are full; its level serves all that follow.
    level = F.try_divide(F.col("total") - F.col("caps"), F.col("all_w") - F.col("ws"))
    levels = filled.crossJoin(F.broadcast(whole)).withColumn("level", level)  # one row against the sources
    found = levels.where("level <= ratio").agg(F.min_by("level", "nth").alias("level"))
    return ranked.crossJoin(F.broadcast(found)).select(
        "source", "source_size", F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("w") * F.col("level"))).alias("target"))


def mix(docs: DataFrame, source_weight: Column, quality: Column, budget: float | None = 1.0, epochs: int = 3, seed: int = 1,
        size: Column | None = None, tie: Column | None = None) -> DataFrame:
    """Return docs (doc_id, text, source, ...) with size, source_size, target, taken and copies.

    ``size`` (words of the text) and ``tie`` (a hash of the text) can be given as columns of docs, so
    that texts need not be read again.
    ``source_weight`` is a column over ``rank``, or over source_size; ``quality`` a positive column over docs (null or not
    positive counts as 1e-6). A null source is a source of its own; a null or blank text has size 0 and
    is taken in complete epochs only. Rows that are equal in all columns are separate documents with equal keys,
    of which as many are taken as fit.
    Columns of the input named like those added are replaced.
    """
    own = ["size", "source_size", "target", "taken", "copies"]
    size, tie = word_count(F.col("text")) if size is None else size, F.xxhash64("text") if tie is None else tie
    weight = F.greatest(F.coalesce(quality.cast("double"), F.lit(1e-6)), F.lit(1e-6))
    base = docs.withColumns({"__size": size, "__w": weight, "__h": tie}).drop(*own).withColumnRenamed("__size", "size")
    # u^(1/w) in (0, 1) falls as the key -ln(u)/w grows.
    base = base.withColumn("__u", F.lit(1.0) - F.pow(hash_unit(F.lit(seed), "doc_id", "__h"), F.lit(1.0) / F.col("__w")))
    slim = settle(base.select("source", "doc_id", F.col("__h").alias("h"), "size", "__u"))
    per = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    per = settle(per)
    goal = targets(per.select("source", "source_size"), source_weight, budget, epochs)
    plan = goal.join(per.select(F.col("source").alias("s2"), "n"), F.col("source").eqNullSafe(F.col("s2"))).drop("s2")
    plan = plan.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    plan = plan.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")).withColumn("nb", F.ceil(F.sqrt("n")))
    plan = settle(plan)

    def with_plan(df: DataFrame, p: DataFrame) -> DataFrame:
        q = p.withColumnRenamed("source", "__s")
        return df.join(q, F.col("source").eqNullSafe(F.col("__s"))).drop("__s")

    bucket = F.least(F.floor(F.col("__u") * F.col("nb")), F.col("nb") - 1)
    placed = with_plan(slim, plan.select("source", "nb", "rest", "epochs")).withColumn("bucket", bucket)
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy("source", "bucket").agg(F.sum("size").alias("b_size")).withColumn("b_before", F.coalesce(F.sum("b_size").over(before), F.lit(0)))
    # The cut lies in the last bucket that starts before the rest is met.
    cut = with_plan(sums, plan.select("source", "rest")).where("b_before < rest").groupBy("source").agg(F.max(F.struct("bucket", "b_before")).alias("c"))
    cut = settle(cut.select("source", F.col("c.bucket").alias("cut_bucket"), F.col("c.b_before").alias("cut_before")))
    goal = settle(plan.join(cut.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s")
                  .select("source", "source_size", "target", "epochs", "rest", "nb", "cut_bucket", "cut_before"))
    edge = with_plan(slim, goal.select("source", "nb", "rest", "cut_bucket", "cut_before")).where(bucket == F.col("cut_bucket"))
    along = Window.partitionBy("source").orderBy("__u", "doc_id", "h").rowsBetween(Window.unboundedPreceding, -1)
    edge = edge.withColumn("ahead", F.col("cut_before") + F.coalesce(F.sum("size").over(along), F.lit(0)))
    keyed = edge.groupBy("source", F.struct("__u", "doc_id", "h").alias("key")).agg(
        F.count("*").alias("rows"), F.count_if(F.expr("ahead + size / 2 <= rest")).alias("fit"))
    last = keyed.where("fit > 0").groupBy("source").agg(F.max(F.struct("key", "rows", "fit")).alias("l")).select(
        "source", F.col("l.key").alias("last"), "l.rows", "l.fit")
    goal = settle(goal.join(last.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s"))
    full = with_plan(base, goal).withColumn("__b", bucket)
    here = F.struct(F.col("__u"), F.col("doc_id"), F.col("__h").alias("h"))
    more = F.when(F.col("cut_bucket").isNull(), F.lit(0)).when(F.col("__b") < F.col("cut_bucket"), F.lit(1)).when(
        (F.col("__b") == F.col("cut_bucket")) & (here <= F.col("last")), F.lit(1)).otherwise(F.lit(0))
    full = full.withColumn("more", F.coalesce(more, F.lit(0)))
    if not goal.where("fit < rows").isEmpty():
        # Rows with the key of the cut of which only some fit: numbered, so that just as many are taken.
        split = (F.col("fit") < F.col("rows")) & (here == F.col("last")) & (F.col("__b") == F.col("cut_bucket"))
        tied = settle(full.where(F.coalesce(split, F.lit(False))).withColumns({"__id": F.monotonically_increasing_id(), "__one": F.lit(1).cast("long")}))
        numbered = totals_before(tied, [F.asc_nulls_first("source"), F.col("__id")], {"__nth": "__one"})
        first = numbered.groupBy("source").agg(F.min("__nth").alias("__first")).withColumnRenamed("source", "__s")
        numbered = numbered.join(first, F.col("source").eqNullSafe(F.col("__s"))).withColumn(
            "more", F.when(F.col("__nth") - F.col("__first") < F.col("fit"), 1).otherwise(0))
        full = full.where(~F.coalesce(split, F.lit(False))).unionByName(numbered.select(*full.columns))
    full = full.withColumn("copies", F.col("epochs") + F.col("more")).withColumn("taken", F.col("copies") * F.col("size"))
    return full.select(*[c for c in docs.columns if c not in own and c not in ("__size", "__w", "__u", "__h")], *own)


def readable(text: Column) -> Column:
    """A quality weight in [0.05, 1]: the share of characters that are no ASCII digits or symbols."""
    odd = "0123456789!\"#$%&()*+/:;<=>?@[]^_`{|}~\\"
    plain = F.length(F.translate(text, odd, "")) / F.greatest(F.length(text), F.lit(1))
    return F.greatest(F.coalesce(plain, F.lit(0.05)), F.lit(0.05))


@query("op4_source_mix")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    measured = settle(docs.select("doc_id", "source", word_count(F.col("text")).alias("words"), readable(F.col("text")).alias("quality"),
                                  F.xxhash64("text").alias("tie")))
    mixed = mix(measured, F.col("rank") % 3 + 1, F.col("quality"), size=F.col("words"), tie=F.col("tie"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")
