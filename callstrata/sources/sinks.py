"""Writers for tables, nested reports and fitted models. All write folders in parallel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, by: str | None = None, sep: str = ",", encoding: str = "UTF-8") -> str:
    """Delimited text with a header, one folder per value of ``by``."""
    writer = df.write.mode("overwrite").option("header", True).option("sep", sep).option("encoding", encoding)
    (writer.partitionBy(by) if by else writer).csv(path)
    return path


def write_report(report: DataFrame, path: str) -> str:
    """Nested report rows as JSON; nulls stay visible."""
    report.write.mode("overwrite").option("ignoreNullFields", False).json(path)
    return path


def nested_report(spark: SparkSession, **sections: DataFrame) -> DataFrame:
    """One row whose columns are the sections, each a sorted list of structs.

    Sections are summaries of a few rows; each is a subquery of its own.
    """
    lists = {n: df.agg(F.array_sort(F.collect_list(F.struct(*df.columns)))).scalar() for n, df in sections.items()}
    return spark.range(1).select(*[c.alias(n) for n, c in lists.items()])


def save_model(model, path: str) -> str:
    model.write().overwrite().save(path)
    return path
