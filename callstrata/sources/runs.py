"""Results of runs behind a commit log: a reader sees the tables of committed runs only.

A run writes its tables into a folder of its own attempt, reads them back to count rows and take checksums per file, and then adds one
file to the log, which appears whole or not at all. What a killed run leaves behind is in no log and so is never read; the run may simply be
repeated. The log holds a row per file and is what inventories and "the newest result" are read from.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LOG = "corrida string, intento string, tabla string, formato string, archivo string, filas bigint, suma bigint, orden bigint"


def write_run(spark: SparkSession, root: str, run: str, tables: Mapping[str, DataFrame], fmt: str = "json", by: Mapping[str, str] | None = None) -> DataFrame:
    """Write the tables of a run (csv, json or parquet; ``by`` names a partition column) and commit them. Returns the run's rows of the log.

    A run of a name that is already committed replaces it for readers.
    """
    attempt = uuid.uuid4().hex[:12]
    parts = [_written(spark, root, run, attempt, name, df, fmt, (by or {}).get(name)) for name, df in tables.items()]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    order = spark.sql("SELECT unix_micros(current_timestamp())").first()[0]
    shaped = rows.withColumn("orden", F.lit(order)).select(*[c.split()[0] for c in LOG.split(", ")])
    shaped.coalesce(1).write.mode("append").parquet(f"{root}/log")
    return committed(spark, root, run).where(F.col("intento") == attempt)


def _written(spark: SparkSession, root: str, run: str, attempt: str, name: str, df: DataFrame, fmt: str, by: str | None) -> DataFrame:
    path = f"{root}/data/{run}/{attempt}/{name}"
    writer = df.write.format(fmt).option("header", True).option("ignoreNullFields", False)
    (writer.partitionBy(by) if by else writer).save(path)
    if fmt == "parquet":
        back = spark.read.schema(df.schema).parquet(path)
        back = back.select(F.col("_metadata.file_path").alias("_f"), F.xxhash64(*[c for c in df.columns if c != by]).alias("_h"))
    else:
        lines = spark.read.text(path, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("_f"), "value")
        back = lines.select("_f", F.xxhash64("value").alias("_h"))
    # equal rows would cancel out in an exclusive or; a sum of half the bits has room for 2^31 rows
    files = back.groupBy("_f").agg(F.count(F.lit(1)).alias("filas"), F.sum(F.col("_h").bitwiseAND(0xFFFFFFFF)).alias("suma"))
    header = 1 if fmt == "csv" else 0
    # a row of the table itself, so that an empty one is in the log too
    files = files.unionByName(spark.range(1).select(F.lit(None).cast("string").alias("_f"), F.lit(header).cast("long").alias("filas"), F.lit(0).cast("long").alias("suma")))
    return files.select(F.lit(run).alias("corrida"), F.lit(attempt).alias("intento"), F.lit(name).alias("tabla"), F.lit(fmt).alias("formato"),
                        F.col("_f").alias("archivo"), (F.col("filas") - header).alias("filas"), "suma")


def committed(spark: SparkSession, root: str, run: str | None = None) -> DataFrame:
    """The log's rows of the last committed attempt of every run, or of one run."""
    log = spark.read.schema(LOG).parquet(f"{root}/log")
    log = log if run is None else log.where(F.col("corrida") == run)
    newest = F.max(F.struct("orden", "intento")).over(Window.partitionBy("corrida"))
    return log.withColumn("_n", newest["intento"]).where(F.col("intento") == F.col("_n")).drop("_n")


def inventory(spark: SparkSession, root: str) -> DataFrame:
    """(corrida, tabla, archivos, filas) of the committed runs, from the log alone."""
    return committed(spark, root).groupBy("corrida", "tabla").agg(F.count("archivo").alias("archivos"), F.sum("filas").alias("filas"))


def read_run(spark: SparkSession, root: str, table: str, schema, run: str | None = None) -> DataFrame:
    """A table of a run, by default of the one committed last that has it."""
    own = committed(spark, root, run).where(F.col("tabla") == table)
    newest = own.agg(F.max(F.struct("orden", "corrida", "intento", "formato"))).first()[0]
    if newest is None:
        raise FileNotFoundError(f"no committed run with table {table} under {root}")
    return spark.read.schema(schema).option("header", True).format(newest["formato"]).load(f"{root}/data/{newest['corrida']}/{newest['intento']}/{table}")


def damaged(spark: SparkSession, root: str, run: str) -> DataFrame:
    """Files of a committed run that are gone or no longer hold the lines that were committed (csv, json)."""
    log = committed(spark, root, run).where((F.col("formato") != "parquet") & F.col("archivo").isNotNull())
    folders = [r[0] for r in log.select("intento").distinct().collect()]  # one attempt
    if not folders:
        return log.select("tabla", "archivo")
    lines = spark.read.text(f"{root}/data/{run}/{folders[0]}", recursiveFileLookup=True)
    now = lines.groupBy(F.col("_metadata.file_path").alias("_f")).agg(F.sum(F.xxhash64("value").bitwiseAND(0xFFFFFFFF)).alias("_s"))
    return log.join(now, F.col("archivo") == F.col("_f"), "left").where(~F.col("suma").eqNullSafe(F.col("_s"))).select("tabla", "archivo")
