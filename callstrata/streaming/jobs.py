"""Structured Streaming jobs. Each reads a landing folder, runs to its end, and writes a table.

All use the available-now trigger, so a scheduler can start them every quarter
of an hour; checkpoints and outputs live on shared storage, and a batch that is
run again writes the same files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callstrata.schema import BLOCK_AFTER, BLOCK_FACTOR, BLOCK_MAX_STEPS, BLOCK_MINUTES, HOUR_LIMIT


def land(df: DataFrame, path: str) -> str:
    """Append a batch of rows to a landing folder."""
    df.write.mode("append").parquet(path)
    return path


def landed(spark: SparkSession, path: str, schema: T.StructType, ts: str, files_per_batch: int | None = None) -> DataFrame:
    """Stream over a landing folder with the event time as a zoned timestamp, which a watermark needs."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path).withColumn(ts, F.col(ts).cast("timestamp"))


def run_to_table(stream: DataFrame, root: str) -> DataFrame:
    """Append the finished rows of a stream to a table and return the table."""
    spark, out = stream.sparkSession, f"{root}/out"
    (stream.writeStream.outputMode("append").format("parquet").option("path", out)
     .option("checkpointLocation", f"{root}/progress").trigger(availableNow=True).start().awaitTermination())
    return spark.read.schema(stream.schema).parquet(out)


def daily_counts(calls: DataFrame, late: str = "1 day") -> DataFrame:
    """Calls, and answered calls, per direction and day; a day is final once the watermark passes its end."""
    return calls.where(F.col("SENTIDO").isNotNull()).withWatermark("FECHA", late).groupBy(
        F.window("FECHA", "1 day").alias("w"), F.col("SENTIDO").alias("serie")).agg(
        F.count("TELEFONO").alias("y"), F.count_if(F.col("ATENDIDA") == "Si").alias("atendidas")).select(
        F.col("w.start").alias("desde"), "serie", "y", "atendidas")


def sliding_counts(requests: DataFrame, key: str, ts: str, late: str = "10 minutes", limit: int = HOUR_LIMIT) -> DataFrame:
    """Requests per key in one-hour windows that start every ten minutes, and whether the limit is passed."""
    return requests.withWatermark(ts, late).groupBy(
        F.window(ts, "1 hour", "10 minutes").alias("w"), F.col(key).alias("clave")).agg(
        F.count(F.lit(1)).alias("n")).select(
        F.col("w.start").alias("desde"), F.col("w.end").alias("hasta"), "clave", "n", (F.col("n") > limit).alias("excede"))


def sessions(events: DataFrame, key: str, ts: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Runs of activity per key that the watermark has closed. ``build_session`` has sessions merged before the shuffle too.

    The last session of a key appears once later events have moved the watermark past its end.
    """
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), F.col(key).alias("clave")).agg(
        F.count(F.lit(1)).alias("eventos")).select(
        F.col("w.start").alias("inicio"), F.col("w.end").alias("cierre"), "clave", "eventos")


def split_future(calls: DataFrame, as_of: str, root: str, ts: str = "FECHA") -> tuple[DataFrame, DataFrame]:
    """Rows dated up to ``as_of`` and, apart, the rows dated later.

    Each batch writes a folder of its own with overwrite, so a repeated batch
    replaces itself.
    """
    spark, schema = calls.sparkSession, calls.schema
    end = F.date_add(F.lit(as_of).cast("date"), 1).cast("timestamp")

    def write(batch: DataFrame, batch_id: int) -> None:
        marked = batch.withColumn("futura", F.coalesce(F.col(ts) >= end, F.lit(False)))
        marked.write.mode("overwrite").partitionBy("futura").parquet(f"{root}/rows/batch={batch_id}")

    (calls.writeStream.foreachBatch(write).option("checkpointLocation", f"{root}/progress")
     .trigger(availableNow=True).start().awaitTermination())
    full = T.StructType([*schema.fields, T.StructField("batch", T.IntegerType()), T.StructField("futura", T.BooleanType())])
    rows = spark.read.schema(full).parquet(f"{root}/rows").drop("batch")
    return rows.where(~F.col("futura")).drop("futura"), rows.where("futura").drop("futura")


def blocks(windows: DataFrame, root: str) -> DataFrame:
    """Blocks that follow from windows over the limit, with the running count of violations per key.

    ``windows`` is a stream of closed windows (sliding or tumbling counts), so a
    busy key arrives as one row per window. The running counts are a table with
    one version per batch: a batch reads the version before its own and writes
    its own, and may be repeated at any time.
    """
    spark = windows.sparkSession
    state_schema, out_schema = "clave string, total bigint", "clave string, desde timestamp, acumulado bigint, minutos int"

    def write(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        before = (session.read.schema(state_schema).parquet(f"{root}/state/v{batch_id - 1}") if batch_id
                  else session.createDataFrame([], state_schema))
        bad = batch.where("excede").select("clave", "desde")
        counts = bad.groupBy("clave").agg(F.count(F.lit(1)).alias("nuevas"))
        before.join(counts, "clave", "full").select(
            "clave", (F.coalesce("total", F.lit(0)) + F.coalesce("nuevas", F.lit(0))).alias("total")
        ).write.mode("overwrite").parquet(f"{root}/state/v{batch_id}")
        w = Window.partitionBy("clave").orderBy("desde")
        running = F.row_number().over(w) + F.coalesce("total", F.lit(0))
        minutes = (BLOCK_MINUTES * F.pow(F.lit(BLOCK_FACTOR), F.least(F.col("acumulado"), F.lit(BLOCK_MAX_STEPS)))).cast("int")
        bad.join(before, "clave", "left").withColumn("acumulado", running).select(
            "clave", "desde", F.col("acumulado").cast("long").alias("acumulado"),
            F.when(F.col("acumulado") >= BLOCK_AFTER, minutes).alias("minutos")
        ).write.mode("overwrite").parquet(f"{root}/out/batch={batch_id}")

    (windows.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", f"{root}/progress")
     .trigger(availableNow=True).start().awaitTermination())
    return spark.read.schema(out_schema).parquet(f"{root}/out").select("clave", "desde", "acumulado", "minutos")
