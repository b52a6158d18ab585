"""Consecutive numbers and order checks over whole tables without a single-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callstrata.session import checkpointed


def ranged(df: DataFrame, key: str, width: int) -> DataFrame:
    """The rows in ranges of ``key`` of about ``width`` rows, whatever the values, with the range's number ``_rango``.

    Spark samples the key for the borders; the result is written, so that the
    numbers stay what they are when a task is repeated.
    """
    n = max(1, -(-df.count() // width))
    return checkpointed(df.repartitionByRange(n, key).withColumn("_rango", F.spark_partition_id()))


def number_rows(df: DataFrame, key: str, out: str = "n", width: int = 1_000_000) -> DataFrame:
    """1-based position of each row in the order of a unique ``key``.

    Rows are numbered inside ranges of about ``width`` rows and shifted by the
    size of the earlier ranges; only the list of range sizes is ordered as a whole.
    """
    part = ranged(df, key, width)
    sizes = part.groupBy("_rango").agg(F.count(F.lit(1)).alias("_t"))
    before = Window.orderBy("_rango").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_rango", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_antes"))
    inside = F.row_number().over(Window.partitionBy("_rango").orderBy(key))
    return part.withColumn("_pos", inside).join(offsets, "_rango").withColumn(
        out, F.col("_pos") + F.col("_antes")).drop("_rango", "_pos", "_antes")


def disorder(df: DataFrame, seq: str, value: str, width: int = 1_000_000) -> DataFrame:
    """One row: rows, steps that go back in ``value`` when read by ``seq``, and whether it is in order."""
    part = ranged(df.select(F.col(seq).alias("_s"), F.col(value).alias("_v")), "_s", width)
    w = Window.partitionBy("_rango").orderBy("_s")
    stepped = part.withColumn("_back", (F.lag("_v").over(w) > F.col("_v")).cast("long"))
    ranges = stepped.groupBy("_rango").agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("_back"), F.lit(0)).alias("back"),
        F.min_by("_v", "_s").alias("first"), F.max_by("_v", "_s").alias("last"))
    seam = (F.lag("last").over(Window.orderBy("_rango")) > F.col("first")).cast("long")
    return ranges.withColumn("seam", F.coalesce(seam, F.lit(0))).agg(
        F.sum("n").alias("filas"), F.sum(F.col("back") + F.col("seam")).alias("retrocesos")
    ).withColumn("ordenado", F.col("retrocesos") == 0)
