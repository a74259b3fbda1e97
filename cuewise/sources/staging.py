"""Tables written once per application to the shared folder and read by every later query.

Ingest is the costly, shared first step (text to timed words). Writing it cuts the lineage: a lost
executor re-reads files instead of repeating the ingest, and every branch of a plan scans columns
with pushed filters instead of exploding texts again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cuewise.session import checkpoint_dir

_WRITTEN: dict[tuple[str, str, str], str] = {}


def staged(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], tuple[DataFrame, int]],
           keys: list[str], order: str) -> DataFrame:
    """The table ``name`` of a folder, built at first use: its rows and the number of buckets of ``keys`` to store them in."""
    app = spark.sparkContext.applicationId
    key = (app, sf_dir, name)
    if key not in _WRITTEN:
        rows, buckets = build()
        stored = f"cuewise_{name}_{uuid.uuid4().hex}"
        path = f"{checkpoint_dir(spark)}/cuewise/{app}/{stored}"
        rows.write.bucketBy(buckets, *keys).sortBy(*keys, order).option("path", path).saveAsTable(stored)
        _WRITTEN[key] = stored
    return spark.table(_WRITTEN[key])


def cut(df: DataFrame) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back.

    For small tables that several branches of a plan need: it is computed once, and a lost
    executor re-reads it.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/cuewise/{spark.sparkContext.applicationId}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
