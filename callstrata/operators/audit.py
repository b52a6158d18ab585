"""Quality audit of the call log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callstrata.functions import fingerprints
from callstrata.functions.dates import is_business
from callstrata.functions.stats import arg_max, arg_min, pct


def audit_summary(calls: DataFrame) -> DataFrame:
    """Totals of the log in one aggregate."""
    return calls.agg(
        F.count(F.lit(1)).alias("total"), F.min("FECHA").alias("desde"), F.max("FECHA").alias("hasta"),
        F.countDistinct(F.to_date("FECHA")).alias("dias"),
        F.count_if(F.col("SENTIDO") == "in").alias("entrantes"),
        F.count_if(F.col("SENTIDO") == "out").alias("salientes"),
        F.count_if(F.col("ATENDIDA") == "Si").alias("atendidas"))


def temporal_profile(calls: DataFrame) -> DataFrame:
    """(metrica, clave, valor): range, days, null dates, calls per weekday name and month name.

    The log becomes one count per day; each day then feeds its weekday, its
    month and the overall range, so everything comes from one scan.
    """
    days = calls.groupBy(F.to_date("FECHA").alias("ds")).agg(F.count(F.lit(1)).alias("n"))
    feed = lambda m, k: F.struct(F.lit(m).alias("metrica"), k.cast("string").alias("clave"))
    dated = F.col("ds").isNotNull()
    fed = days.select("ds", "n", F.inline(F.array_compact(F.array(
        F.when(dated, feed("dia_semana", F.date_format("ds", "EEEE"))),
        F.when(dated, feed("mes", F.date_format("ds", "MMMM"))),
        feed("rango", F.lit(None))))))
    groups = fed.groupBy("metrica", "clave").agg(
        F.sum("n").alias("n"), F.min("ds").alias("a"), F.max("ds").alias("b"), F.count("ds").alias("d"),
        F.coalesce(F.sum(F.when(F.col("ds").isNull(), F.col("n"))), F.lit(0)).alias("z"))
    row = lambda m, v, k=None: F.struct(
        (F.lit(m) if isinstance(m, str) else m).alias("metrica"),
        (F.lit(None) if k is None else k).cast("string").alias("clave"), v.cast("string").alias("valor"))
    span = F.array(row("fecha_minima", F.col("a")), row("fecha_maxima", F.col("b")),
                   row("dias_totales", F.datediff("b", "a")), row("dias_unicos", F.col("d")),
                   row("fechas_nulas", F.col("z")))
    one = F.array(row(F.col("metrica"), F.col("n"), F.col("clave")))
    return groups.select(F.inline(F.when(F.col("metrica") == "rango", span).otherwise(one)))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(F.col(col).alias("valor")).agg(F.count(F.lit(1)).alias("n"))


def value_counts_all(df: DataFrame, cols=("SENTIDO", "ATENDIDA", "STATUS")) -> DataFrame:
    """Frequencies of several columns, one scan: grouping sets fold each column map-side."""
    sets = [[F.col(c)] for c in cols]
    label = F.concat(*[F.when(F.grouping(c) == 0, c).otherwise("") for c in cols])
    value = F.coalesce(*[F.when(F.grouping(c) == 0, F.col(c)) for c in cols])
    return df.groupingSets(sets, *[F.col(c) for c in cols]).agg(
        F.count(F.lit(1)).alias("n"), label.alias("columna"), value.alias("valor")).select("columna", "valor", "n")


def phone_prefixes(calls: DataFrame, n: int = 10, width: int = 3) -> DataFrame:
    """Most common phone prefixes; the smaller prefix wins a tie."""
    return calls.where(F.col("TELEFONO").isNotNull()).groupBy(
        F.substring("TELEFONO", 1, width).alias("prefijo")).agg(F.count(F.lit(1)).alias("n")).orderBy(
        F.desc("n"), "prefijo").limit(n)


def phone_lengths(calls: DataFrame) -> DataFrame:
    """Length of the first digit run: mean, mode, and the ten most common lengths."""
    size = F.length(F.nullif(F.regexp_extract("TELEFONO", r"(\d+)", 1), F.lit("")))
    counts = calls.groupBy(size.alias("longitud")).agg(F.count(F.lit(1)).alias("n")).where(
        F.col("longitud").isNotNull())
    # At most a few dozen lengths exist, so one window over them is a small task.
    every = Window.partitionBy(F.lit(1))
    ranked = counts.withColumns({
        "promedio": F.sum(F.col("longitud") * F.col("n")).over(every) / F.sum("n").over(every),
        "puesto": F.row_number().over(every.orderBy(F.desc("n"), "longitud"))})
    return ranked.withColumn("moda", F.min(F.when(F.col("puesto") == 1, F.col("longitud"))).over(every)).where(
        F.col("puesto") <= 10).select("longitud", "n", "promedio", "moda")


def business_days(calls: DataFrame) -> DataFrame:
    """Calls per business day."""
    return calls.where(F.col("FECHA").isNotNull()).groupBy(F.to_date("FECHA").alias("ds")).agg(
        F.count(F.lit(1)).alias("y")).where(is_business(F.col("ds")))


def daily_stats(days: DataFrame) -> DataFrame:
    """Volume statistics over daily counts; the first day wins a tie."""
    return days.agg(
        F.avg("y").alias("promedio"), F.median("y").alias("mediana"), F.stddev_samp("y").alias("desviacion"),
        F.try_divide(F.stddev_samp("y"), F.avg("y")).alias("coef_variacion"),
        arg_max("ds", "y").alias("dia_max"), F.max("y").alias("max"),
        arg_min("ds", "y").alias("dia_min"), F.min("y").alias("min"),
        F.count(F.lit(1)).alias("dias"), F.count_if(F.col("y") == 0).alias("dias_sin_llamadas"))


def iqr_outliers(daily: DataFrame, *by: str) -> DataFrame:
    """Days outside the quartile fences of their series; the fences come from a window, so the series is read once."""
    quartiles = F.percentile("y", F.array(F.lit(0.25), F.lit(0.75))).over(Window.partitionBy(*by))
    low, high = F.col("_q")[0], F.col("_q")[1]
    return daily.withColumn("_q", quartiles).withColumns({
        "limite_inferior": low - 1.5 * (high - low), "limite_superior": high + 1.5 * (high - low)}).withColumn(
        "lado", F.when(F.col("y") > F.col("limite_superior"), "superior")
        .when(F.col("y") < F.col("limite_inferior"), "inferior")).where(F.col("lado").isNotNull()).drop("_q")


def seasonal_profile(calls: DataFrame) -> DataFrame:
    """(dimension, clave, n) over business-day calls: hour, weekday, day of month, ISO week."""
    cells = calls.groupBy(F.to_date("FECHA").alias("ds"), F.hour("FECHA").alias("hora")).agg(
        F.count(F.lit(1)).alias("n")).where(is_business(F.col("ds")))
    keys = F.inline(F.array(*[
        F.struct(F.lit(d).alias("dimension"), k.cast("int").alias("clave")) for d, k in (
            ("hora", F.col("hora")), ("dia_semana", F.weekday("ds")),
            ("dia_mes", F.dayofmonth("ds")), ("semana", F.weekofyear("ds")))]))
    return cells.select("n", keys).groupBy("dimension", "clave").agg(F.sum("n").alias("n"))


def peak_valley(seasonal: DataFrame) -> DataFrame:
    """Top and bottom three hours, top three weekdays, and the variability of each dimension."""
    by = Window.partitionBy("dimension")
    ranked = seasonal.where(F.col("dimension").isin("hora", "dia_semana")).withColumns({
        "pico": F.row_number().over(by.orderBy(F.desc("n"), "clave")),
        "valle": F.row_number().over(by.orderBy("n", "clave")),
        "variabilidad": F.try_divide(F.stddev_samp("n").over(by), F.avg("n").over(by))})
    row = lambda kind, rank: F.struct(F.lit(kind).alias("clase"), F.col(rank).alias("puesto"))
    picked = F.array_compact(F.array(
        F.when(F.col("pico") <= 3, row("pico", "pico")),
        F.when((F.col("valle") <= 3) & (F.col("dimension") == "hora"), row("valle", "valle"))))
    return ranked.select("dimension", "clave", "n", "variabilidad", F.inline(picked))


def completeness(df: DataFrame) -> DataFrame:
    """Null count, null share and score of every column, and the mean score; one aggregate."""
    cols = df.columns
    one = df.agg(F.count(F.lit(1)).alias("_t"), *[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    mean = sum((F.col(c) for c in cols[1:]), F.col(cols[0])) / len(cols)
    return one.select("_t", (100 - pct(mean, F.col("_t"))).alias("score_promedio"), F.inline(F.array(*[
        F.struct(F.lit(c).alias("columna"), F.col(c).alias("nulos")) for c in cols]))).select(
        "columna", "nulos", pct(F.col("nulos"), F.col("_t")).alias("pct_nulos"),
        (100 - pct(F.col("nulos"), F.col("_t"))).alias("score"), "score_promedio")


def duplicate_count(df: DataFrame) -> DataFrame:
    """Rows that repeat an earlier row in full. Fingerprints are counted; whole rows are compared only where these repeat."""
    return fingerprints.count_rows(df).select((F.col("filas") - F.col("distintas")).alias("duplicados"), "filas")


def numeric_quality(df: DataFrame, cols: list[str], limit: float = 3.0) -> DataFrame:
    """Negatives, zeros and values more than ``limit`` deviations from the mean, per numeric column.

    Means and deviations are one row, taken for all columns at once and used as a scalar; no row is multiplied by the columns.
    """
    v = {c: F.col(c).cast("double") for c in cols}
    stats = df.agg(F.struct(*[F.struct(F.avg(v[c]).alias("m"), F.stddev_samp(v[c]).alias("s")).alias(f"k{i}") for i, c in enumerate(cols)]).alias("t"))
    known = df.select(*cols, stats.scalar().alias("_t"))

    def z(i, c):
        t = F.col("_t")[f"k{i}"]
        return F.abs(F.try_divide(v[c] - t["m"], t["s"]))

    wide = known.agg(*[F.struct(
        F.lit(c).alias("columna"), F.count_if(v[c] < 0).alias("negativos"), F.count_if(v[c] == 0).alias("ceros"),
        F.count_if(z(i, c) > limit).alias("atipicos")).alias(f"k{i}") for i, c in enumerate(cols)])
    return wide.select(F.inline(F.array(*[f"k{i}" for i in range(len(cols))])))


def overview(df: DataFrame) -> DataFrame:
    """Rows, columns and total nulls."""
    nulls = sum((F.count_if(F.col(c).isNull()) for c in df.columns[1:]), F.count_if(F.col(df.columns[0]).isNull()))
    return df.agg(F.count(F.lit(1)).alias("filas"), F.lit(len(df.columns)).alias("columnas"), nulls.alias("nulos"))
