"""Equal rows by fingerprint: whole rows meet only where a 128-bit fingerprint repeats."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callstrata.session import checkpointed

#: Repeated fingerprints (16 bytes each) up to which they are broadcast.
SMALL = 200_000


def fingerprint(df: DataFrame) -> tuple[Column, Column]:
    """128 bits of all columns; nulls, their places and negative zeros are told apart or alike as grouping does."""
    parts: list[Column] = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(F.isnan(c), F.lit(float("nan"))).otherwise(c + F.lit(0.0))
        parts += [c.isNull(), c]
    return F.xxhash64(F.lit(1), *parts), F.xxhash64(F.lit(2), *reversed(parts))


def marked(df: DataFrame, of: Callable[[DataFrame], tuple[Column, Column]] = fingerprint) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows whose fingerprint no other row has, the other rows, and (h1, h2, n) of all fingerprints. Only fingerprints are counted over a shuffle."""
    h1, h2 = of(df)
    counts = checkpointed(df.select(h1.alias("_h1"), h2.alias("_h2")).groupBy("_h1", "_h2").agg(F.count(F.lit(1)).alias("_n")))
    often = counts.where("_n > 1").select("_h1", "_h2")
    often = F.broadcast(often) if often.count() <= SMALL else often
    rows = df.withColumns({"_a": h1, "_b": h2})
    same = (F.col("_a") == F.col("_h1")) & (F.col("_b") == F.col("_h2"))
    return rows.join(often, same, "left_anti").drop("_a", "_b"), rows.join(often, same, "left_semi").drop("_a", "_b"), counts


def distinct_rows(df: DataFrame, of: Callable[[DataFrame], tuple[Column, Column]] = fingerprint) -> DataFrame:
    """One row of each set of equal rows. Rows that stand alone stay where they are; the rest are compared whole."""
    alone, rest, _ = marked(df, of)
    return alone.unionByName(rest.dropDuplicates())


def count_rows(df: DataFrame, of: Callable[[DataFrame], tuple[Column, Column]] = fingerprint) -> DataFrame:
    """One row: filas and distintas."""
    _, rest, counts = marked(df, of)
    single = counts.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("filas"), F.count_if(F.col("_n") == 1).alias("solas"))
    several = rest.dropDuplicates().agg(F.count(F.lit(1)).alias("varias"))
    return single.withColumn("_k", F.lit(1)).join(several.withColumn("_k", F.lit(1)), "_k").select("filas", (F.col("solas") + F.col("varias")).alias("distintas"))
