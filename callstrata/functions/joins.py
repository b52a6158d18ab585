"""Joins whose hot keys are spread over several tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS_PER_SALT = 500_000


def salted_left_join(fact: DataFrame, dim: DataFrame, on: str, salt_from: str, salts: int | None = None) -> DataFrame:
    """Left join that splits each key of ``fact`` into ``salts`` parts.

    A key may hold a third of all fact rows; the salt, taken from a stable row
    id so that a retried task repeats it, spreads those rows, and the dimension
    is repeated once per salt. Without a number given, the largest key is
    counted and gets a salt per ``ROWS_PER_SALT`` rows. Rows with a null key
    match nothing and stay out of the join. Nothing is broadcast here: where the
    dimension turns out small at run time, adaptive execution does so itself.
    """
    known = fact.where(F.col(on).isNotNull())
    if salts is None:
        most = known.groupBy(on).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
        salts = max(1, -(-most // ROWS_PER_SALT))
    left = known.withColumn("_sal", F.pmod(F.xxhash64(salt_from), F.lit(salts)).cast("int"))
    right = dim.withColumn("_sal", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    joined = left.join(right, [on, "_sal"], "left").drop("_sal")
    return joined.unionByName(fact.where(F.col(on).isNull()), allowMissingColumns=True)
