"""Window features of the daily series. All windows are per series; a series has one row per day."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callstrata.functions.dates import month_start_flag, month_week, wave
from callstrata.functions.stats import beyond_deviations, full_frame

LAGS = (1, 2, 3, 7, 14)
ROLLS = (3, 7, 14)
CALENDAR = ["dia_semana", "dia_mes", "semana_ano", "mes", "trimestre",
            "dia_semana_sin", "dia_semana_cos", "mes_sin", "mes_cos"]
LAG_COLS = [f"lag_{k}" for k in LAGS]
ROLL_COLS = [f"{s}_movil_{n}" for n in ROLLS for s in ("media", "std")]


def _w():
    return Window.partitionBy("serie").orderBy("ds")


def calendar_features(df: DataFrame) -> DataFrame:
    """Weekday 1-7, day, ISO week, month, quarter and the cyclic pairs."""
    d = F.col("ds")
    dow, month = F.weekday(d) + 1, F.month(d)
    return df.withColumns({
        "dia_semana": dow, "dia_mes": F.dayofmonth(d), "semana_ano": F.weekofyear(d), "mes": month,
        "trimestre": F.quarter(d),
        "dia_semana_sin": wave(F.sin, dow, 7), "dia_semana_cos": wave(F.cos, dow, 7),
        "mes_sin": wave(F.sin, month, 12), "mes_cos": wave(F.cos, month, 12)})


def month_position(df: DataFrame) -> DataFrame:
    return df.withColumns({"es_inicio_mes": month_start_flag(F.col("ds")), "semana_mes": month_week(F.col("ds"))})


def lag_features(daily: DataFrame) -> DataFrame:
    return daily.withColumns({f"lag_{k}": F.lag("y", k).over(_w()) for k in LAGS})


def rolling_mean_std(daily: DataFrame, shift: int = 0) -> DataFrame:
    """Rolling mean and deviation over full frames, ending ``shift`` rows before the current one."""
    out = {}
    for n in ROLLS:
        w = _w().rowsBetween(-(n - 1) - shift, -shift)
        out[f"media_movil_{n}"] = full_frame(F.avg("y"), w, n)
        out[f"std_movil_{n}"] = full_frame(F.stddev_samp("y"), w, n)
    return daily.withColumns(out)


def rolling_slope(daily: DataFrame, rows: int = 7, shift: int = 0) -> DataFrame:
    """Least-squares slope over the last ``rows`` rows."""
    pos = daily.withColumn("_p", F.row_number().over(_w()))
    w = _w().rowsBetween(-(rows - 1) - shift, -shift)
    return pos.withColumn("tendencia_7d", full_frame(F.regr_slope("y", "_p"), w, rows)).drop("_p")


def weekday_mean_dev(daily: DataFrame) -> DataFrame:
    """Mean of the weekday over the whole series and the deviation from it."""
    mean = F.avg("y").over(Window.partitionBy("serie", F.weekday("ds")))
    return daily.withColumn("promedio_dia_semana", mean).withColumn(
        "desviacion_vs_promedio_dia", F.col("y") - F.col("promedio_dia_semana"))


def centered_zscore(daily: DataFrame, rows: int = 14) -> DataFrame:
    """z against a centred frame (half before, the rest from the current row on) and the |z| > 2 flag."""
    w = _w().rowsBetween(-(rows // 2), rows - rows // 2 - 1)
    m, s = full_frame(F.avg("y"), w, rows), full_frame(F.stddev_samp("y"), w, rows)
    far = beyond_deviations(F.col("y"), w, 2) & (F.count(F.lit(1)).over(w) == rows)
    return daily.withColumns({"_m": m, "_s": s, "es_outlier": far.cast("int")}).withColumn(
        "z_score", F.try_divide(F.col("y") - F.col("_m"), F.col("_s"))).drop("_m", "_s")


def feature_matrix(daily: DataFrame) -> DataFrame:
    """Every feature, complete rows only: the analysis table of the series."""
    base = daily.select("serie", "ds", "y")
    out = centered_zscore(weekday_mean_dev(rolling_slope(rolling_mean_std(lag_features(calendar_features(base))))))
    return out.dropna()


def training_features(daily: DataFrame, *keep: str) -> DataFrame:
    """Features known before the day they describe: rolling frames end one row earlier, no centred z.

    ``dow_previa`` is the mean of the earlier rows of the same weekday; ``keep``
    names further columns to carry along.
    """
    base = daily.select("serie", "ds", F.col("y").cast("double").alias("y"), *keep)
    same = Window.partitionBy("serie", F.weekday("ds")).orderBy("ds").rowsBetween(Window.unboundedPreceding, -1)
    out = rolling_slope(rolling_mean_std(lag_features(calendar_features(base)), shift=1), shift=1)
    return out.withColumn("dow_previa", F.avg("y").over(same)).dropna()


TRAIN_COLS = CALENDAR + LAG_COLS + ROLL_COLS + ["tendencia_7d", "dow_previa"]
