"""Calendar operators: gap-free days, holiday marks, day types and future dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callstrata.functions.dates import is_business
from callstrata.schema import DAY_LABOUR, DAY_LONG, DAY_POST, DAY_PRE, DAY_WEEKEND


def complete_calendar(daily: DataFrame, weekdays_only: bool = False, by: str = "serie",
                      zero=("y", "atendidas")) -> DataFrame:
    """One row for every day between the first and last day of a series; added days count 0.

    Each row emits itself and the missing days up to the next row, so the
    series is read once and neither a date table nor a join is needed.
    """
    nxt = F.lead("ds").over(Window.partitionBy(by).orderBy("ds"))
    spread = daily.withColumn("_fin", F.coalesce(F.date_sub(nxt, 1), F.col("ds"))).withColumn(
        "_d", F.explode(F.sequence("ds", "_fin")))
    own = F.col("_d") == F.col("ds")
    cols = []
    for c in daily.columns:
        if c == "ds":
            cols.append(F.col("_d").alias("ds"))
        elif c == by:
            cols.append(F.col(c))
        elif c in zero:
            cols.append(F.when(own, F.col(c)).otherwise(F.lit(0)).cast(daily.schema[c].dataType).alias(c))
        else:
            cols.append(F.when(own, F.col(c)).alias(c))
    out = spread.select(*cols)
    return out.where(is_business(F.col("ds"))) if weekdays_only else out


def holiday_neighbours(hol: DataFrame) -> DataFrame:
    """date -> holiday flag, description, category, and flags of the day before and after a holiday."""
    near = hol.select(F.inline(F.array(*[
        F.struct(F.date_add("fecha", k).alias("_f"), F.lit(k).alias("_k"),
                 F.when(F.lit(k == 0), F.col("descripcion")).alias("_d"),
                 F.when(F.lit(k == 0), F.col("categoria")).alias("_c"))
        for k in (-1, 0, 1)
    ])))
    return near.groupBy("_f").agg(
        F.bool_or(F.col("_k") == 0).alias("es_feriado"),
        F.max("_d").alias("feriado_descripcion"),
        F.max("_c").alias("feriado_categoria"),
        F.bool_or(F.col("_k") == -1).alias("pre_feriado"),
        F.bool_or(F.col("_k") == 1).alias("post_feriado"),
    )


def mark_holidays(df: DataFrame, hol: DataFrame, date_col: str = "ds") -> DataFrame:
    """Attach the holiday flags. The dimension has at most three rows per calendar date, hence the broadcast."""
    dim = F.broadcast(holiday_neighbours(hol))
    no = F.lit(False)
    return df.join(dim, F.col(date_col) == F.col("_f"), "left").drop("_f").withColumns({
        "es_feriado": F.coalesce("es_feriado", no),
        "pre_feriado": F.coalesce("pre_feriado", no),
        "post_feriado": F.coalesce("post_feriado", no),
        "feriado_categoria": F.coalesce("feriado_categoria", F.lit("Normal")),
    })


def long_weekend(date: Column) -> Column:
    """Holiday on Friday or Monday, or a weekend day beside a holiday."""
    w = F.weekday(date)
    beside = F.col("pre_feriado") | F.col("post_feriado")
    return (F.col("es_feriado") & w.isin(0, 4)) | (w.isin(5, 6) & beside)


def day_type(date: Column) -> Column:
    """Label by precedence: holiday, long weekend, day before, day after, weekend, working day."""
    return (
        F.when(F.col("es_feriado"), F.concat(F.lit("Feriado ("), F.col("feriado_categoria"), F.lit(")")))
        .when(long_weekend(date), DAY_LONG)
        .when(F.col("pre_feriado"), DAY_PRE)
        .when(F.col("post_feriado"), DAY_POST)
        .when(F.weekday(date).isin(5, 6), DAY_WEEKEND)
        .otherwise(DAY_LABOUR)
    )


def mark_days(df: DataFrame, hol: DataFrame, date_col: str = "ds") -> DataFrame:
    """Holiday flags plus long-weekend flag and day type."""
    d = F.col(date_col)
    return mark_holidays(df, hol, date_col).withColumns({"fin_semana_largo": long_weekend(d), "tipo_dia": day_type(d)})


def training_flags(marked: DataFrame, direction_col: str | None = None, outgoing_only: bool = False) -> DataFrame:
    """Whether a day leaves the training set: as a whole, and by the direction of the row."""
    special = F.col("es_feriado") | F.col("pre_feriado") | F.col("post_feriado")
    drop = special if outgoing_only else F.lit(False)
    by_row = drop
    if direction_col is not None:
        outgoing = F.lower(direction_col).isin("out", "saliente", "outbound")
        by_row = special & F.coalesce(outgoing, F.lit(False))
    return marked.withColumns({"excluir_de_entrenamiento": drop, "aplicar_filtro_feriados": by_row})


def training_filter(daily: DataFrame, hol: DataFrame, direction_col: str = "serie") -> DataFrame:
    """Training rows: incoming keeps all days, outgoing drops holidays and their neighbours."""
    flagged = training_flags(mark_holidays(daily, hol), direction_col)
    return flagged.where(~F.col("aplicar_filtro_feriados")).select(*daily.columns)


def training_mask(daily: DataFrame, hol: DataFrame, direction_col: str = "serie") -> DataFrame:
    """The series on its whole calendar with ``entrena``: whether a day's calls may train and test a model.

    Days that ``training_filter`` would drop stay as rows, so that lags remain
    days; they carry the mean of the kept days of their weekday instead of their calls.
    """
    flagged = training_flags(mark_holidays(daily, hol), direction_col).withColumn("entrena", ~F.col("aplicar_filtro_feriados"))
    kept, series = F.when(F.col("entrena"), F.col("y")), Window.partitionBy(direction_col)
    usual = F.coalesce(F.avg(kept).over(Window.partitionBy(direction_col, F.weekday("ds"))), F.avg(kept).over(series), F.col("y"))
    filled = F.when(F.col("entrena"), F.col("y").cast("double")).otherwise(usual)
    return flagged.withColumn("y", filled).select(*daily.columns, "entrena")


def holiday_calendar(years: DataFrame, hol: DataFrame) -> DataFrame:
    """One row per day of each year in ``years(anio)`` with its flags and its row in a month grid."""
    days = years.select(F.explode(F.sequence(F.make_date("anio", F.lit(1), F.lit(1)),
                                             F.make_date("anio", F.lit(12), F.lit(31)))).alias("ds"))
    first_dow = F.weekday(F.trunc("ds", "month"))
    return mark_days(days, hol).select(
        "ds", F.month("ds").alias("mes"), F.dayofmonth("ds").alias("dia"), F.weekday("ds").alias("dia_semana"),
        F.floor((F.dayofmonth("ds") - 1 + first_dow) / 7).cast("int").alias("semana_mes"),
        "es_feriado", "pre_feriado", "post_feriado", "tipo_dia", "feriado_categoria")


def future_days(daily: DataFrame, n: int, business: bool = False, by: str = "serie") -> DataFrame:
    """The next ``n`` days, or business days, after the last day of each series."""
    last = daily.groupBy(by).agg(F.max("ds").alias("_last"))
    span = n if not business else (n // 5 + 2) * 7
    days = last.select(by, F.explode(F.sequence(F.date_add("_last", 1), F.date_add("_last", span))).alias("ds"))
    if not business:
        return days
    w = Window.partitionBy(by).orderBy("ds")
    return days.where(is_business(F.col("ds"))).withColumn("_k", F.row_number().over(w)).where(
        F.col("_k") <= n).drop("_k")
