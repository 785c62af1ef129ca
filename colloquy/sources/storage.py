"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_LOCAL: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where it is unset, a local master (tests) gets a folder of its own; a cluster gets an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _LOCAL:
        _LOCAL.append("file://" + tempfile.mkdtemp(prefix="colloquy-"))
    return _LOCAL[0]


def written(df: DataFrame, name: str, schema: StructType | None = None, **options: str) -> DataFrame:
    """df as a Parquet table that is read again (as schema, if given): worked out once, whoever reads it, and safe from lost executors. options: of the writer."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(schema or df.schema).parquet(path)


def numbered(df: DataFrame, order: str, number: str) -> DataFrame:
    """df with the place (from 0) of its rows in the order of a column of different values.

    Ranges of the column are sorted side by side and written with their rows' places; the sizes of the ranges before are
    one number per range.
    """
    ranges = df.repartitionByRange(order).sortWithinPartitions(order).withColumn("__row", F.monotonically_increasing_id())
    held = written(ranges.select("*", F.shiftright("__row", 33).alias("__range"), F.expr("__row & ((1L << 33) - 1)").alias("__at")).drop("__row"), "numbered")
    sizes = {r["__range"]: r["n"] for r in held.groupBy("__range").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per range
    before, total = [], 0
    for k in sorted(sizes):
        before.append((k, total))
        total += sizes[k]
    if not before:
        return held.drop("__range").withColumnRenamed("__at", number)
    first = df.sparkSession.createDataFrame(before, "__range long, __before long")
    return held.join(F.broadcast(first), "__range").withColumn(number, F.col("__at") + F.col("__before")).drop("__range", "__at", "__before")
