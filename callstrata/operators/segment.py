"""Direction rules and the daily series built from the call log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callstrata.functions.dates import dow0, is_business, month_start_flag, month_week
from callstrata.functions.stats import arg_max, arg_min, pct

CALL_TYPES = ["ENTRANTE", "SALIENTE", "INDETERMINADA"]


def incoming_chance(hour: Column) -> Column:
    """Share of incoming calls expected at an hour of the day."""
    return F.when(hour.between(8, 17), 0.8).when(hour.between(18, 19), 0.3).when(hour.isNotNull(), 0.1)


def segment_calls(calls: DataFrame) -> DataFrame:
    """Call type and confidence: the stated direction first, else the likelier one for the hour."""
    said = F.lower(F.trim("SENTIDO"))
    p_in = incoming_chance(F.hour("FECHA"))
    p_out = 1 - p_in
    kind = (F.when(said == "in", "ENTRANTE").when(said == "out", "SALIENTE")
            .when(p_in > 0.6, "ENTRANTE").when(p_out > 0.6, "SALIENTE").otherwise("INDETERMINADA"))
    sure = (F.when(said.isin("in", "out"), 0.9).when(p_in > 0.6, p_in).when(p_out > 0.6, p_out)
            .otherwise(0.0))
    return calls.withColumns({"tipo_llamada": kind, "confianza_segmentacion": sure, "hora": F.hour("FECHA")})


def hourly_profile(calls: DataFrame) -> DataFrame:
    """Peak and valley hour and share of business-hours calls (8-17)."""
    per_hour = calls.groupBy(F.hour("FECHA").alias("hora")).agg(F.count(F.lit(1)).alias("n"))
    business = F.sum(F.when(F.col("hora").between(8, 17), F.col("n")).otherwise(0))
    return per_hour.agg(
        arg_max("hora", "n").alias("hora_pico"), F.max("n").alias("llamadas_pico"),
        arg_min("hora", "n").alias("hora_valle"), F.min("n").alias("llamadas_valle"),
        pct(business, F.sum("n")).alias("pct_horario_laboral"))


def calls_per_hour(calls: DataFrame) -> DataFrame:
    return calls.groupBy(F.hour("FECHA").alias("hora")).agg(F.count(F.lit(1)).alias("n"))


def segment_summary(seg: DataFrame) -> DataFrame:
    """Per call type: calls and share; with the overall confidence statistics on every row.

    Confidence has a handful of values, so the log is first reduced to
    (type, confidence) counts and the median is read off those counts.
    """
    groups = seg.groupBy("tipo_llamada", "confianza_segmentacion").agg(F.count(F.lit(1)).alias("n"))
    c, n = F.col("confianza_segmentacion"), F.col("n")
    known = F.col("tipo_llamada") != "INDETERMINADA"
    rows = F.collect_list(F.struct("tipo_llamada", "n"))
    total = groups.agg(
        rows.alias("_g"), F.sum("n").alias("_t"),
        (F.sum(F.when(known, c * n)) / F.sum(F.when(known, n))).alias("confianza_promedio"),
        F.percentile(c, F.lit(0.5), n).alias("confianza_mediana"),
        F.sum(F.when(c > 0.8, n).otherwise(0)).alias("alta_confianza"),
        F.sum(F.when(c < 0.5, n).otherwise(0)).alias("baja_confianza"))
    return total.select(F.inline("_g"), "_t", "confianza_promedio", "confianza_mediana",
                        "alta_confianza", "baja_confianza").groupBy(
        "tipo_llamada", "_t", "confianza_promedio", "confianza_mediana", "alta_confianza", "baja_confianza"
    ).agg(F.sum("n").alias("llamadas")).withColumn("pct", pct(F.col("llamadas"), F.col("_t"))).drop("_t")


def segment_hours(seg: DataFrame) -> DataFrame:
    """Calls by hour for incoming and outgoing."""
    return seg.where(F.col("tipo_llamada").isin("ENTRANTE", "SALIENTE")).groupBy("tipo_llamada", "hora").agg(
        F.count(F.lit(1)).alias("n"))


def daily_by_type(seg: DataFrame) -> DataFrame:
    """Business-day series per call type with the regressors of the trend model."""
    days = seg.withColumn("ds", F.to_date("FECHA")).where(is_business(F.col("ds"))).groupBy(
        F.col("tipo_llamada").alias("serie"), "ds").agg(
        F.count(F.lit(1)).alias("y"), F.avg("confianza_segmentacion").alias("confianza_promedio"))
    return days.withColumns({"dia_semana": dow0(F.col("ds")) + 1, "es_inicio_mes": month_start_flag(F.col("ds")),
                             "semana_mes": month_week(F.col("ds"))})


def daily_calls(calls: DataFrame) -> DataFrame:
    """Per direction and day: calls with a phone, answered calls, mean hour.

    The group count is combined before the shuffle, so one direction holding
    most rows costs a few partial rows per task.
    """
    return calls.where(F.col("SENTIDO").isNotNull()).groupBy(
        F.col("SENTIDO").alias("serie"), F.to_date("FECHA").alias("ds")).agg(
        F.count("TELEFONO").alias("y"), F.count_if(F.col("ATENDIDA") == "Si").alias("atendidas"),
        F.avg(F.hour("FECHA")).alias("hora_promedio"))


def segmentation_totals(daily: DataFrame) -> DataFrame:
    return daily.groupBy("serie").agg(
        F.sum("y").alias("total"), F.avg("y").alias("promedio_diario"), F.count(F.lit(1)).alias("dias"),
        F.sum("atendidas").alias("atendidas"), F.min("ds").alias("desde"), F.max("ds").alias("hasta"))


def daily_pivot(seg: DataFrame) -> DataFrame:
    """Day x call type counts with the total."""
    wide = seg.groupBy(F.to_date("FECHA").alias("ds")).pivot("tipo_llamada", CALL_TYPES).agg(
        F.count(F.lit(1))).fillna(0)
    return wide.withColumn("total", F.col("ENTRANTE") + F.col("SALIENTE") + F.col("INDETERMINADA"))


def history(calls: DataFrame, tipo: str) -> DataFrame:
    """Plain day counts of one direction."""
    return calls.where(F.col("SENTIDO") == tipo).groupBy(F.to_date("FECHA").alias("ds")).agg(
        F.count(F.lit(1)).alias("y"))
