"""Baseline forecast, error metrics, fold assignment, weights and the combined forecast."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callstrata.functions.stats import pct
from callstrata.operators.calendar import future_days, mark_holidays
from callstrata.schema import WEIGHT_MAX, WEIGHT_MIN, Z95


def weekday_baseline(days: DataFrame, hist: DataFrame) -> DataFrame:
    """Attach to each (serie, ds) the historical mean of its weekday, or the overall mean.

    The history shrinks to at most eight rows per series before the join.
    """
    per_dow = hist.groupBy("serie", F.weekday("ds").alias("_d")).agg(
        F.sum("y").alias("_s"), F.count("y").alias("_n"))
    means = per_dow.select("serie", "_d", (F.col("_s") / F.col("_n")).alias("_m"))
    overall = per_dow.groupBy("serie").agg((F.sum("_s") / F.sum("_n")).alias("_o"))
    return days.withColumn("_d", F.weekday("ds")).join(overall, "serie").join(
        means, ["serie", "_d"], "left").withColumn("base", F.coalesce("_m", "_o")).drop("_d", "_m", "_o")


def baseline_forecast(daily: DataFrame, hol: DataFrame, n: int = 28, outgoing=("out", "saliente", "SALIENTE")) -> DataFrame:
    """Weekday mean for the next ``n`` days, lowered on holidays, with a 15 % band."""
    future = mark_holidays(future_days(daily, n), hol)
    based = weekday_baseline(future, daily)
    factor = F.when(~F.col("es_feriado"), 1.0).when(F.col("serie").isin(*outgoing), 0.3).otherwise(0.7)
    yhat = F.greatest(F.lit(0.0), F.col("base") * factor)
    return based.select("serie", "ds", "es_feriado", F.round(yhat, 1).alias("yhat_ensemble"),
                        F.round(yhat * 0.85, 1).alias("yhat_lower"), F.round(yhat * 1.15, 1).alias("yhat_upper"))


def error_metrics(pairs: DataFrame, by=("serie", "modelo")) -> DataFrame:
    """MAE, RMSE, MAPE over days with calls, R2 and the row counts of (y, yhat) pairs."""
    y, e = F.col("y").cast("double"), F.col("y") - F.col("yhat")
    return pairs.groupBy(*by).agg(
        F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
        (F.avg(F.when(y != 0, F.abs(e) / F.abs(y))) * 100).alias("mape"),
        (1 - F.try_divide(F.sum(e * e), F.var_pop(y) * F.count(y))).alias("r2"),
        F.count(F.lit(1)).alias("n"), F.count_if(y == 0).alias("dias_cero"))


def evaluate_folds(pairs: DataFrame) -> DataFrame:
    """Pooled metrics plus mean and spread of the per-fold squared error."""
    per_fold = pairs.groupBy("serie", "modelo", "fold").agg(F.avg(F.pow(F.col("y") - F.col("yhat"), 2)).alias("mse"))
    spread = per_fold.groupBy("serie", "modelo").agg(
        F.sqrt(F.avg("mse")).alias("cv_rmse_mean"), F.sqrt(F.stddev_pop("mse")).alias("cv_rmse_std"),
        F.count(F.lit(1)).alias("folds"))
    return error_metrics(pairs).join(spread, ["serie", "modelo"])


def time_split(df: DataFrame, share: float = 0.8) -> DataFrame:
    """Mark the first ``share`` of the rows of each series as training rows, in time order."""
    w = Window.partitionBy("serie")
    cut = F.floor(F.count(F.lit(1)).over(w) * share)
    return df.withColumn("parte", F.when(F.row_number().over(w.orderBy("ds")) <= cut, "train").otherwise("test"))


def numbered(daily: DataFrame) -> DataFrame:
    """Rows with their position ``_r`` in time and the length ``_n`` of their series."""
    w = Window.partitionBy("serie")
    return daily.withColumns({"_n": F.count(F.lit(1)).over(w), "_r": F.row_number().over(w.orderBy("ds"))})


def cv_folds(daily: DataFrame, splits: int = 5, gap: int = 7) -> DataFrame:
    """Backward folds: each row once per fold in which it trains or tests."""
    size = F.floor(F.col("_n") / (splits + 1))
    end = F.col("_n") - F.col("fold") * size
    train_end = end - size - gap
    part = F.when(F.col("_r") <= train_end, "train").when((F.col("_r") > end - size) & (F.col("_r") <= end), "test")
    out = numbered(daily).withColumn("fold", F.explode(F.array(*[F.lit(i) for i in range(splits)])))
    return out.where((train_end >= size) & (size > 0)).withColumn("parte", part).where(
        F.col("parte").isNotNull()).drop("_n", "_r")


def expanding_folds(daily: DataFrame, k: int = 5, min_rows: int = 100) -> DataFrame:
    """Expanding-window folds; series of at most ``min_rows`` rows get k plain contiguous folds.

    ``min_rows=0`` expands at every size, so that no training row follows a test row.
    """
    n, r, f = F.col("_n"), F.col("_r"), F.col("fold")
    size = F.floor(n / (k + 1))
    start = n - (k - f) * size
    grow = F.when(r <= start, "train").when(r <= start + size, "test")
    small, extra = F.floor(n / k), n % k
    lo = f * small + F.least(f, extra)
    plain = F.when((r > lo) & (r <= lo + small + F.when(f < extra, 1).otherwise(0)), "test").otherwise("train")
    out = numbered(daily).withColumn("fold", F.explode(F.array(*[F.lit(i) for i in range(k)])))
    return out.withColumn("parte", F.when(n > min_rows, grow).otherwise(plain)).where(
        F.col("parte").isNotNull()).drop("_n", "_r")


def ensemble_weights(metrics: DataFrame, lo: float = WEIGHT_MIN, hi: float = WEIGHT_MAX) -> DataFrame:
    """Inverse-MAE weights, clipped to [lo, hi] and normalised again.

    Where models are without error they share the whole weight evenly and the others get none.
    """
    w = Window.partitionBy("serie")
    perfect = F.count_if(F.col("mae") == 0).over(w)
    raw = metrics.where(F.col("mae").isNotNull()).withColumns({"_i": F.try_divide(F.lit(1.0), F.col("mae")), "_p": perfect})
    clipped = F.greatest(F.lit(lo), F.least(F.lit(hi), F.col("_i") / F.sum("_i").over(w)))
    share = raw.withColumn("_s", F.when(F.col("_p") == 0, clipped).otherwise((F.col("mae") == 0).cast("double")))
    return share.select("serie", "modelo", "mae", (F.col("_s") / F.sum("_s").over(w)).alias("peso"))


def simple_weights(metrics: DataFrame) -> DataFrame:
    """min(MAE) / MAE, normalised."""
    w = Window.partitionBy("serie")
    raw = metrics.withColumn("_s", F.try_divide(F.min("mae").over(w), F.col("mae")))
    return raw.select("serie", "modelo", "mae", (F.col("_s") / F.sum("_s").over(w)).alias("peso"))


def combine(pred: DataFrame, weights: DataFrame) -> DataFrame:
    """Weighted mean over the models that have both a prediction and a weight."""
    return pred.join(weights.select("serie", "modelo", "peso"), ["serie", "modelo"]).groupBy("serie", "ds").agg(
        (F.sum(F.col("peso") * F.col("yhat")) / F.sum("peso")).alias("yhat_ensemble"))


def spread(pred: DataFrame) -> DataFrame:
    """Population deviation across models and the interval around their mean."""
    return pred.groupBy("serie", "ds").agg(F.avg("yhat").alias("yhat_media"), F.stddev_pop("yhat").alias("yhat_std")).select(
        "serie", "ds", "yhat_media", "yhat_std",
        F.greatest(F.lit(0.0), F.col("yhat_media") - Z95 * F.col("yhat_std")).alias("yhat_lower"),
        (F.col("yhat_media") + Z95 * F.col("yhat_std")).alias("yhat_upper"))


def forecast_table(pred: DataFrame, weights: DataFrame, models: list[str]) -> DataFrame:
    """ds, weighted forecast, spread, interval and one column per model; one shuffle on (serie, ds)."""
    y, p = F.col("yhat"), F.col("peso")
    joined = pred.join(weights.select("serie", "modelo", "peso"), ["serie", "modelo"])
    wide = joined.groupBy("serie", "ds").agg(
        (F.sum(p * y) / F.sum(p)).alias("_e"), F.stddev_pop(y).alias("yhat_std"),
        *[F.max(F.when(F.col("modelo") == m, y)).alias(f"yhat_{m}") for m in models])
    e = F.col("_e")
    return wide.select(
        "serie", "ds", F.greatest(F.lit(0.0), e).alias("yhat_ensemble"), "yhat_std",
        F.greatest(F.lit(0.0), e - Z95 * F.col("yhat_std")).alias("yhat_lower"),
        (e + Z95 * F.col("yhat_std")).alias("yhat_upper"), *[f"yhat_{m}" for m in models])


def interval_width(fc: DataFrame) -> DataFrame:
    return fc.withColumn("ancho", F.col("yhat_upper") - F.col("yhat_lower"))


def model_means(fc: DataFrame, models: list[str]) -> DataFrame:
    """Mean prediction per model column."""
    long = fc.select("serie", F.inline(F.array(*[
        F.struct(F.lit(m).alias("modelo"), F.col(f"yhat_{m}").alias("v")) for m in models])))
    return long.groupBy("serie", "modelo").agg(F.avg("v").alias("media"))


def no_overlap(fc: DataFrame, daily: DataFrame) -> DataFrame:
    """Whether every forecast date of a series lies after its history."""
    a = fc.groupBy("serie").agg(F.min("ds").alias("primer_pronostico"))
    b = daily.groupBy("serie").agg(F.max("ds").alias("ultimo_historico"))
    return a.join(b, "serie").withColumn("valido", F.col("primer_pronostico") > F.col("ultimo_historico"))


def rank_models(metrics: DataFrame, n: int = 3) -> DataFrame:
    """The ``n`` best models of each series by R2."""
    w = Window.partitionBy("serie").orderBy(F.desc("r2"), "modelo")
    return metrics.withColumn("puesto", F.row_number().over(w)).where(F.col("puesto") <= n)


def interpret(metrics: DataFrame) -> DataFrame:
    """Verbal classes of R2 and MAPE."""
    r, m = F.col("r2"), F.col("mape")
    return metrics.select(
        "serie", "modelo", "r2", "mape",
        F.when(r > 0.85, "Excelente").when(r >= 0.80, "Bueno").otherwise("Mejorable").alias("clase_r2"),
        F.when(m < 12, "Excelente").when(m <= 15, "Aceptable").otherwise("Mejorable").alias("clase_mape"))


def forecast_summary(fc: DataFrame, alerts: DataFrame) -> DataFrame:
    """Figures of a forecast with its alert counts."""
    y = F.col("yhat_ensemble")
    peak = F.min(F.struct((-y).alias("v"), F.col("ds").alias("d")))["d"]
    base = fc.groupBy("serie").agg(
        F.avg(y).alias("media"), F.max(y).alias("maximo"), F.min(y).alias("minimo"), F.stddev_samp(y).alias("desviacion"),
        F.sum(y).alias("total"), F.date_format(peak, "EEEE yyyy-MM-dd").alias("dia_pico"))
    counts = alerts.groupBy("serie").agg(F.count_if(F.col("severidad") == "CRITICA").alias("criticas"),
                                         F.count_if(F.col("severidad") == "ALTA").alias("altas"))
    return base.join(counts, "serie", "left").fillna(0, ["criticas", "altas"])
